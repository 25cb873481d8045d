"""Language identification with interpolated Kneser-Ney character models.

*Learn.* Texts become streams of lower-case letters with one space between
words. Tasks count the 4-grams of each language over all learning documents
(pre-aggregated per partition); continuation counts of the lower orders, the
discounts n1 / (n1 + 2 n2) and the interpolated probabilities follow by grouping
and joining in Spark. A language's model is stored as sorted arrays of n-gram
keys with log probabilities, and of context keys with log back-off weights. Keys
are whole (16 bits a code, 64 in all), so no n-grams merge and none that was not
learned is found: letters beyond 16 bits are two codes, the halves of their UTF-16
form, which no other letter has. An entry takes 12 bytes, and the broadcast grows
with the number of different n-grams; tasks sort arrays of ``ARRAY_KEYS`` keys or so.

*Predict.* The language with the lowest cross-entropy per character wins.
Rejection is calibrated on the learning documents: the excess of a document's
cross-entropy over its language's mean, times the root of its length (at most
``REJECT_CHARS``: beyond that texts differ more than their length explains), is compared with ``REJECT_MARGIN`` times that language's ``REJECT_QUANTILE`` quantile.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is
rejected; null languages and null ids are not learned from; with no learning
document at all everything is ``und``; repeated rows are scored (and counted) once
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import stage, with_columns

ORDER = 4
CHUNK_CHARS = 2_000_000
ARRAY_KEYS = 1_000_000
REJECT_QUANTILE = 0.999
REJECT_MARGIN = 2.0
REJECT_CHARS = 400
UNDETERMINED = "und"
_SPACE = 32
_BITS = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which 16-bit codes are letters by Unicode category, or halves of letters beyond them."""
    table = np.array([chr(c).isalpha() for c in range(1 << _BITS)])
    table[0xD800:0xE000] = True
    return table


def _codes(text: str) -> np.ndarray:
    """UTF-16 codes; both halves of a character that is no letter become spaces."""
    c = np.frombuffer(text.encode("utf-16-le", "replace"), "<u2").astype(np.uint32)
    high = np.flatnonzero((c >= 0xD800) & (c < 0xDC00))
    if len(high):
        whole = 0x10000 + ((c[high] - 0xD800) << 10) + (c[high + 1] - 0xDC00)
        kinds, at = np.unique(whole, return_inverse=True)
        other = high[~np.array([chr(x).isalpha() for x in kinds.tolist()])[at]]
        c[other] = c[other + 1] = _SPACE
    return c


def letter_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER-1 spaces, and the predicted letters of each text.

    Runs of other characters become one space; a text's leading ones vanish.
    """
    lengths, parts = [], []
    for t in texts:
        c = _codes(t.lower()) if t else np.zeros(0, np.uint32)
        parts += [np.full(ORDER - 1, _SPACE, np.uint32), c]
        lengths.append(len(c) + ORDER - 1)
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.concatenate(parts)
    starts = np.cumsum([0, *lengths[:-1]])
    is_letter = _letters()[codes]
    pad = np.zeros(len(codes), bool)
    for k in range(ORDER - 1):
        pad[starts + k] = True
    keep = is_letter | pad
    keep[1:] |= is_letter[:-1]
    codes = np.where(is_letter, codes, _SPACE).astype(np.uint32)
    sizes = np.add.reduceat(keep & ~pad, starts)
    return codes[keep], sizes


def _predicted(sizes: np.ndarray) -> np.ndarray:
    """Places of the predicted codes in the stream of texts with ``sizes`` predicted codes each."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat((ORDER - 1) * np.arange(1, len(sizes) + 1), sizes)


def _grams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys (16 bits a code) ending at the places ``at``, and the index of each place's key."""
    present = np.flatnonzero(np.bincount(codes, minlength=1 << _BITS))
    a = len(present)
    if a ** ORDER <= 1 << 24:  # small alphabet: count in a dense table, else by sorting
        small = np.zeros(1 << _BITS, np.int32)
        small[present] = np.arange(a)
        s = small[codes]
        key = np.zeros(len(at), np.int32)
        for k in range(ORDER - 1, -1, -1):
            key = key * a + s[at - k]
        seen = np.zeros(a ** ORDER, bool)
        seen[key] = True
        dense = np.flatnonzero(seen)
        rank = np.zeros(a ** ORDER, np.int32)
        rank[dense] = np.arange(len(dense), dtype=np.int32)
        keys, rest = np.zeros(len(dense), np.uint64), dense
        for k in range(ORDER):
            keys |= present[rest % a].astype(np.uint64) << np.uint64(_BITS * k)
            rest = rest // a
        return keys, rank[key]
    key = np.zeros(len(at), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        key = (key << np.uint64(_BITS)) | codes[at - k].astype(np.uint64)
    keys, index = np.unique(key, return_inverse=True)
    return keys, index


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK_CHARS characters (or one longer text)."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > CHUNK_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, index = np.unique(keys, return_inverse=True)
    return keys, np.bincount(index, weights=n).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        texts = b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for a, z in _chunks(own):
                codes, sizes = letter_stream(own[a:z])
                if sizes.sum():
                    keys, index = _grams(codes, _predicted(sizes))
                    parts = held.setdefault(lang, [])
                    parts.append((keys, np.bincount(index, minlength=len(keys))))
                    if len(parts) > 8:
                        held[lang] = [_merge(parts)]
    for lang, parts in held.items():
        keys, n = _merge(parts)
        for a in range(0, len(keys), 50_000):
            k = keys[a:a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[a:a + 50_000])],
                names=["lang", "key", "n"])


def _low(key: Column, codes: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (_BITS * codes)) - 1))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From 4-gram counts (lang, key, n): (lang, size, key, logp) and (lang, size, key, weight).

    ``size`` is the n-gram's length; ``weight`` the log back-off weight of a
    context of that many codes. The last probability spreads over the alphabet
    and one unknown code; its share is the weight of the empty context.
    """
    tables = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        tables[size] = tables[size + 1].groupBy("lang", _low(F.col("key"), size).alias("key")).agg(
            F.count(F.lit(1)).alias("n"))
    lower: DataFrame | None = None
    probs, weights = [], []
    for size in range(1, ORDER + 1):
        t = tables[size]
        ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        discount = t.groupBy("lang").agg(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5).alias("d"),
                                         F.count(F.lit(1)).alias("kinds"))
        context = F.shiftrightunsigned("key", _BITS)
        sums = t.groupBy("lang", context.alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        sums = sums.join(F.broadcast(discount), "lang").withColumn(  # one row per language
            "gamma", F.col("d") * F.col("types") / F.col("total"))
        p = t.withColumn("ctx", context).join(sums, ["lang", "ctx"])
        if lower is None:
            below = F.lit(1.0) / (F.col("kinds") + 1)
        else:
            below = F.col("lower")
            p = p.withColumn("tail", _low(F.col("key"), size - 1)).join(
                lower.select("lang", F.col("key").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        lower = stage(p.select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total")
                                               + F.col("gamma") * below).alias("p")), f"kn{size}")
        probs.append(lower.select("lang", F.lit(size).alias("size"), "key", F.log("p").alias("value")))
        unknown = F.log("gamma") - (F.log(F.col("kinds") + 1) if size == 1 else F.lit(0.0))
        weights.append(sums.select("lang", F.lit(size - 1).alias("size"), F.col("ctx").alias("key"),
                                   unknown.alias("value")))
    union = lambda xs: xs[0].unionByName(xs[1]).unionByName(xs[2]).unionByName(xs[3])
    return union(probs), union(weights)


class KeyArray:
    """A sorted array of n-gram keys with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]


@dataclass
class LanguageModel:
    lang: str
    grams: dict[int, KeyArray]
    contexts: dict[int, KeyArray]

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last code of each ORDER-gram given the others."""
        out, todo = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for size in range(ORDER, 0, -1):
            k = keys[todo] & np.uint64((1 << (_BITS * size)) - 1)
            found, value = self.grams[size].get(k)
            out[todo[found]] += value[found]
            todo, k = todo[~found], k[~found]
            if not len(todo):
                break
            known, weight = self.contexts[size - 1].get(k >> np.uint64(_BITS))
            out[todo] += np.where(known, weight, 0)
        return out


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[LanguageModel]:
    """Models of every non-null language of ``df``, in order of their names."""
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = stage(rows.mapInArrow(_count, "lang string, key long, n long")
                   .groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
    probs, weights = kneser_ney(counts)
    grams, contexts = _key_arrays(probs), _key_arrays(weights)
    empty = KeyArray(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    part = lambda t, lang, sizes: {s: t.get((lang, s), empty) for s in sizes}
    return [LanguageModel(lang, part(grams, lang, range(1, ORDER + 1)), part(contexts, lang, range(ORDER)))
            for lang in sorted({lang for lang, _ in grams})]


def _key_arrays(t: DataFrame) -> dict[tuple[str, int], KeyArray]:
    """The sorted key array of each (lang, size), from sorted pieces that tasks pack and the driver merges."""
    def pack(group: pa.Table) -> pa.Table:
        k, v = group.column("key").to_numpy().view(np.uint64), group.column("value").to_numpy()
        order = np.argsort(k)
        return pa.table({"lang": group.column("lang").slice(0, 1), "size": group.column("size").slice(0, 1),
                         "keys": pa.array([k[order].tobytes()], pa.binary()),
                         "values": pa.array([v[order].astype(np.float32).tobytes()], pa.binary())})

    t = stage(t, "model")
    pieces = F.pmod(F.xxhash64("key"), F.lit(-(-t.count() // ARRAY_KEYS) or 1)).alias("piece")
    rows = t.select("*", pieces).groupBy("lang", "size", "piece").applyInArrow(
        pack, "lang string, size int, keys binary, values binary").collect()
    parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in rows:
        parts.setdefault((r["lang"], r["size"]), []).append(
            (np.frombuffer(bytes(r["keys"]), np.uint64), np.frombuffer(bytes(r["values"]), np.float32)))
    out = {}
    for at, own in parts.items():
        k, v = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(k, kind="stable")  # merges sorted runs
        out[at] = KeyArray(k[order], v[order])
    return out


_SCORED = "lang_best string, bits double, margin double, chars long"


def score_languages(df: DataFrame, models: list[LanguageModel], text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus __lang_best, __bits (cross-entropy per character),
    __margin to the next language and __chars.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)

    def column(cols: list[pa.Array]) -> list[pa.Array]:
        texts, models = cols[0].to_pylist(), shared.value
        out: list[tuple] = []
        for a, z in _chunks(texts):
            codes, sizes = letter_stream(texts[a:z])
            if not models or not sizes.sum():
                out += [(None, None, None, 0)] * (z - a)
                continue
            keys, index = _grams(codes, _predicted(sizes))
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            cost = np.stack([-np.add.reduceat(m.logp(keys)[index], starts, dtype=np.float64) for m in models])
            cost = cost / sizes[some] / np.log(2)
            best = cost.argmin(axis=0)
            low = np.sort(cost, axis=0)
            gap = low[1] - low[0] if len(models) > 1 else np.full(len(some), np.inf)
            rows: list[tuple] = [(None, None, None, 0)] * (z - a)
            for i, k, c, g in zip(some.tolist(), best.tolist(), low[0].tolist(), gap.tolist()):
                rows[i] = (models[k].lang, c, g, int(sizes[i]))
            out += rows
        cols_out = list(zip(*out)) if out else [[], [], [], []]
        return [pa.array(c, t) for c, t in zip(cols_out, (pa.string(), pa.float64(), pa.float64(), pa.int64()))]

    return with_columns(df, [text_col], ", ".join(f"__{c}" for c in _SCORED.split(", ")), column, keep)


def identify(df: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang",
             keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus __lang_pred, __score, __rejected.

    Documents where ``learns`` is true teach.

    ``__score`` is the posterior of the chosen language, with the evidence of at
    most 32 characters, so that it stays between sure and unsure on long texts.
    """
    models = learn(df.filter(learns), text_col, lang_col)
    marked = df.withColumn("__learns", F.coalesce(learns & F.col(f"`{lang_col}`").isNotNull(), F.lit(False)))
    facts = stage(score_languages(marked, models, text_col, [*(keep or []), "__learns"]), "languages")
    limits = stage(_limits(facts.filter(F.col("__learns") & F.col("__lang_best").isNotNull())), "limits")
    known = facts
    if keep is None:  # whole rows are scored again rather than written once more
        keep, known = df.columns, score_languages(df, models, text_col)
    known = known.join(F.broadcast(limits), F.col("__lang_best") == F.col("__langid_lang"), "left")  # one row per language
    over = F.coalesce(_excess() > F.greatest(F.col("__langid_limit"), F.lit(1.0)) * REJECT_MARGIN, F.lit(False))
    others = F.exp(-F.coalesce("__margin", F.lit(0.0)) * F.log(F.lit(2.0)) * F.least(F.col("__chars"), F.lit(32)))
    return (known.withColumn("__lang_pred", F.coalesce("__lang_best", F.lit(UNDETERMINED)))
            .withColumn("__score", F.when(F.col("__lang_best").isNull(), 0.0).otherwise(1 / (1 + others)))
            .withColumn("__rejected", F.col("__lang_best").isNull() | over)
            .select(*(F.col(f"`{c}`") for c in keep), "__lang_pred", "__score", "__rejected"))


def _excess() -> Column:
    return (F.col("__bits") - F.col("__langid_mean")) * F.sqrt(F.least(F.col("__chars"), F.lit(REJECT_CHARS)))


def _limits(taught: DataFrame) -> DataFrame:
    """Per language: mean cross-entropy of its learning documents and the quantile of their excess over it."""
    mean = taught.groupBy(F.col("__lang_best").alias("__langid_lang")).agg(F.avg("__bits").alias("__langid_mean"))
    # one row per language
    return taught.join(F.broadcast(mean), F.col("__lang_best") == F.col("__langid_lang")).groupBy("__langid_lang", "__langid_mean").agg(
        F.percentile_approx(_excess(), REJECT_QUANTILE, 10_000).alias("__langid_limit"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learners(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col, folds)


def identify_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return identify(rows, learners("doc_id", folds), keep=["doc_id"]).select(
        "doc_id", held_out("doc_id", folds).alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
        F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 5) -> DataFrame:
    """The rows of ``df`` whose language is not rejected."""
    return identify(df, learners(id_col, folds), text_col, lang_col).filter("NOT __rejected").select(
        *(F.col(f"`{c}`") for c in df.columns))
