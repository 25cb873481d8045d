import pytest

from pyspark.sql import Row

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, rank int, block int, fp string, "
          "h int, ctx string, place int, score string, __any int, norm string")


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, 3, "x", 4, "y", 5, "z", 6, "w")


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, a very long one, repeats, copies, ties and a shared passage."""
    rows = [row(1, None), row(2, ""), row(3, " \t\n\x0b "), row(4, LONG), row(5, "Short Text"),
            row(6, "short text"), row(7, "SHORT TEXT", None, None), row(8, "short text ", "de", "s2"),
            row(9, "alone " + PASSAGE + " tail one", "fr", "s3"), row(10, "other head " + PASSAGE + " end", "fr", "s3"),
            row(11, PASSAGE, "de", "s2"), row(12, "ÄÖÜ éàè " * 40, "fr", None), row(13, "12 34 -- 56", "en", "s2"),
            row(14, "ab " * 500, "en", "s1"), row(15, LONG.replace("word5x5 ", "word5x5 extra "), "en", "s2")]
    rows += [row(100 + i, "copy of the very same text " + PASSAGE, "en", "s1") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
