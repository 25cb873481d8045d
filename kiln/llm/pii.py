"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. *Scan.* ``split`` and ``regexp_extract_all`` with one pattern give the gaps and the
   matches of a text; running sums of their lengths are the positions. The four base
   kinds are checked (IP parts, card digits and Luhn sum, phone digits); those that
   hold are the base spans. A fifth pattern finds everything that looks like an
   identifier; what does not touch a base span is a candidate.
2. *Seeds and patterns.* The text around an instance gives its lexical patterns: the
   two words before it, and the word before with the word after (lower case, digits
   as 0). Edges of the pattern-instance graph are distinct (pattern, instance text),
   so copies of a document count once.
3. *Score.* Base instances are known for their kind. In each round a pattern's
   confidence is the known share of its instances (one more in the denominator), and
   an instance that only patterns of confidence ``CONFIDENCE`` or more mention is
   known to the degree that not all of them are wrong. Each round is written to the
   shared folder.
4. *Discover.* A candidate beside a pattern that reached the confidence with
   ``SUPPORT`` instances becomes a span of the pattern's kind.

All regular expressions run in linear time and without recursion: runs start at
their first character (or where the last match ended), repeats are possessive.

Defined cases: null text is empty; a text without spans has zeros, the digest of the
empty string and no spans; repeated rows have equal results; a null id is kept; an
empty table gives no rows. Added spans never touch base spans of any kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import documents, row_key, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: What each kind looks like; ``candidate`` is anything with an identifier's shape.
SHAPES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": r"(?<![A-Za-z0-9@._%+-])(?:[+(]{0,2}+[0-9](?:[\x20().-]{0,2}+[0-9])++"
                 r"|[A-Za-z._%+-]{0,64}+[0-9@](?:[._%+@-]?+[A-Za-z0-9])++)(?![A-Za-z0-9@])",
}
#: A text without this has no match of the shape.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "candidate": "[0-9@]"}
MIN_CANDIDATE = 4
#: Characters around an instance in which its context words are looked for.
BEFORE, AFTER = 48, 24
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.75


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check."""
    d = F.lpad(digits, 19, "0")
    twice = F.translate(d, "0123456789", "0246813579")
    total = sum((F.substring(d if i % 2 else twice, i, 1).cast("int") for i in range(1, 20)), F.lit(0))
    return total % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """Whether a match is a base span; failing ones are dropped without another try."""
    n = F.length(_digits(match))
    return (F.when(kind == "email", True)
            .when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == "card", n.between(14, 19) & luhn(_digits(match)))
            .when(kind == "phone", n.between(10, 15)).otherwise(False))


def matches(df: DataFrame) -> DataFrame:
    """Staged rows (__doc, __tie, kind, match, start, end, before, after) of every shape's matches.

    Of repeated rows one is scanned. ``start`` and ``end`` are code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select(*row_key("doc_id", "text"), text.alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def found(kind: str) -> Column:
        shape = F.lit(SHAPES[kind])
        gaps = F.transform(F.split("text", SHAPES[kind]), lambda x: F.struct(
            F.length(x).alias("gap"),
            F.substring(x, -BEFORE, BEFORE).alias("before"), F.substring(x, 1, AFTER).alias("after")))
        pairs = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all("text", shape, F.lit(0)).alias("m"))
        rows = F.transform(pairs, lambda p: F.struct(
            F.lit(kind).alias("kind"), p["g"]["gap"].alias("gap"), p["g"]["before"].alias("before"),
            p["g"]["after"].alias("after"), p["m"].alias("match")))
        return F.when(F.col("text").rlike(NEEDS[kind]) & F.col("text").rlike(SHAPES[kind]), rows)

    scanned = docs.select("__doc", "__tie", *(found(k).alias(k) for k in SHAPES)).filter(
        F.coalesce(*SHAPES).isNotNull()).dropDuplicates(["__doc", "__tie"])
    none = F.array().cast(dict(scanned.dtypes)["email"])
    rows = scanned.select("__doc", "__tie", F.posexplode(F.concat(*(F.coalesce(k, none) for k in SHAPES))).alias("at", "m"))
    rows = rows.select("__doc", "__tie", "at", "m.*")
    text_order = Window.partitionBy("__doc", "__tie", "kind").orderBy("at")  # one text's matches
    size = F.coalesce(F.length("match"), F.lit(0))
    rows = rows.withColumns({
        "end": F.sum(F.col("gap") + size).over(text_order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.lead("after").over(text_order)}).filter("match IS NOT NULL")
    return stage(rows.select("__doc", "__tie", "kind", "match", (F.col("end") - size).cast("long").alias("start"),
                             F.col("end").cast("long").alias("end"), "before", "after"), "matches")


def occurrences(found: DataFrame) -> DataFrame:
    """Base spans (kind set) and candidates beside them (kind null), with instance text and patterns."""
    base = found.withColumn("base", holds(F.col("kind"), F.col("match"))).filter(
        F.col("base") | ((F.col("kind") == "candidate") & (F.length("match") >= MIN_CANDIDATE)))
    # one text's spans, forwards and backwards: running values, since frames that end at the last row are quadratic
    onward, back = (Window.partitionBy("__doc", "__tie").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0) for by in (
        ["start", "end", F.col("base").desc()], [F.col("start").desc(), F.col("end").desc(), F.col("base").desc()]))
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(onward)
    following = F.min(F.when(F.col("base"), F.col("start"))).over(back)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & F.coalesce(following >= F.col("end"), F.lit(True))
    rows = base.withColumn("free", free).filter("base OR free")
    words = F.regexp_extract_all(F.translate(F.lower("before"), "123456789", "000000000"), F.lit(r"\S+"), F.lit(0))
    then = F.regexp_extract(F.translate(F.lower("after"), "123456789", "000000000"), r"^\s*(\S+)", 1)
    rows = rows.select("__doc", "__tie", F.when(F.col("base"), F.col("kind")).alias("kind"), "start", "end",
                       F.lower("match").alias("instance"), words.alias("w"), then.alias("then"))
    last = F.element_at("w", -1)
    return rows.select("__doc", "__tie", "kind", "start", "end", "instance", F.array_compact(F.array(
        F.when(F.size("w") >= 2, F.concat_ws(" ", F.element_at(F.slice("w", -2, 2), 1), last, F.lit("_"))),
        F.when((F.size("w") >= 1) & (F.col("then") != ""), F.concat_ws(" ", last, F.lit("_"), "then")))).alias("patterns"))


def score_patterns(spots: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT,
                   confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that reach the confidence after the last round."""
    edges = stage(spots.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    known = spots.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("known", F.lit(1.0))
    seeds = known = stage(known, "seeds")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    for i in range(rounds):
        sums = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("known").alias("s"))
        scored = sums.join(size, "pattern").withColumn("confidence", F.round(F.col("s") / (F.col("n") + 1), 6))
        trusted = stage(scored.filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"), "patterns")
        if i + 1 < rounds:
            # an instance is wrong only if all trusted patterns that mention it are
            wrong = F.exp(F.sum(F.log(1 - F.col("confidence"))))
            new = (edges.join(trusted, "pattern").groupBy("instance", "kind").agg(F.round(1 - wrong, 6).alias("known"))
                   .join(seeds.select("instance").distinct(), "instance", "left_anti"))
            best = F.row_number().over(Window.partitionBy("instance").orderBy(F.col("known").desc(), "kind"))  # one row per kind
            new = new.withColumn("best", best).filter("best = 1").drop("best")
            known = stage(seeds.unionByName(new), "known")
    return trusted


def private_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                  support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(__doc, __tie, kind, start, end, instance, base, confidence): base spans and discovered ones."""
    spots = stage(occurrences(matches(documents(df, id_col, text_col))), "spots")
    trusted = score_patterns(spots, rounds, support, confidence)
    base = spots.filter("kind IS NOT NULL").select("__doc", "__tie", "kind", "start", "end", "instance",
                                                   F.lit(True).alias("base"), F.lit(1.0).alias("confidence"))
    beside = spots.filter("kind IS NULL").drop("kind").withColumn("pattern", F.explode("patterns")).join(trusted, "pattern")
    best = F.max(F.struct("confidence", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "kind"))
    new = beside.groupBy("__doc", "__tie", "start", "end", "instance").agg(best.alias("b")).select(
        "__doc", "__tie", "b.kind", "start", "end", "instance", F.lit(False).alias("base"), "b.confidence")
    return base.unionByName(new)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spans = private_spans(df, id_col, text_col, **options)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order")
    each = F.array_sort(F.collect_list(F.struct("start", order, "end", "kind", "base")))  # one text's spans
    count = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    found = spans.groupBy("__doc", "__tie").agg(*count, each.alias("all")).select(
        "__doc", "__tie", *(f"n_{k}" for k in KINDS), F.sha2(_joined(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"))
    docs = documents(df, id_col, text_col)
    docs = docs.select("doc_id", *row_key("doc_id", "text"))
    return docs.join(found, ["__doc", "__tie"], "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
