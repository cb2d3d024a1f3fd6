"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong patterns are reported wherever they match. Weak candidates (identifiers, short values assigned
to a secret's name, random-looking values, endpoints) are reported only if a complementary part lies in their scope: an interval join
of parts with the scopes around them, by document and bin, so that neither a document with very
many parts nor a frequent kind is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitledger.llm.common import texts_of, written

SCOPE = 240  # code points on either side
BIN = 1024

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs of 18 or 16 characters: the same as every run, less those that are shorter.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]+"""
RANDOM = r"[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""

#: Kinds in the order of reports, each with its pattern, its role and whether it is strong.
KINDS = {
    "assign": (ASSIGN, "secret", True),
    "access": (ACCESS, "identifier", True),
    "hex": (HEX, "secret", True),
    "identifier": (IDENTIFIER, "identifier", False),
    "random": (RANDOM, "secret", False),
    "endpoint": (ENDPOINT, "endpoint", False),
    "short": (ASSIGN, "secret", False),  # the matches of assign that are too short for it
}
SCANNED = [kind for kind in KINDS if kind != "short"]
COMPLEMENTS = {"identifier": ["secret"], "secret": ["identifier", "endpoint"], "endpoint": ["secret"]}
NUMBERS = {kind: n for n, kind in enumerate(KINDS)}


def _is_reported(kind: str, match: Column) -> Column:
    """What a match needs besides its pattern."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 12
    if kind == "random":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _extract(docs: DataFrame) -> DataFrame:
    """For each kind the matches of a document, how long they are, and the gaps before them."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    for kind in SCANNED:
        rows = rows.withColumn(kind, F.regexp_extract_all("text", F.lit(KINDS[kind][0]), F.lit(0)))
    return rows.select("row_id", "doc_id", *map(_measured, SCANNED))


def _measured(kind: str) -> Column:
    def row(match: Column, gap: Column) -> Column:
        return F.struct(F.length(match).alias("size"), gap.alias("gap"), _is_reported(kind, match).alias("reported"))

    gaps = F.transform(F.split("text", KINDS[kind][0], -1), lambda x: F.length(x))
    return F.when(F.size(kind) > 0, F.zip_with(F.col(kind), F.slice(gaps, 1, F.size(kind)), row)).alias(kind)


def _parts(extracted: DataFrame) -> DataFrame:
    """One row per match that counts: row_id, kind, first, last (code points, last exclusive)."""
    rows = extracted.select("row_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(k).alias("found")) for k, n in NUMBERS.items() if k in SCANNED])).alias("x"))
    rows = rows.select("row_id", "x.kind", F.posexplode("x.found").alias("at", "y")).select("row_id", "kind", "at", "y.*")
    before = Window.partitionBy("row_id", "kind").orderBy("at")
    last = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    parts = rows.select("row_id", "kind", (last - F.col("size")).alias("first"), last.alias("last"), "reported")
    short = ~F.col("reported") & _of(["assign"])
    parts = parts.withColumn("kind", F.when(short, NUMBERS["short"]).otherwise(F.col("kind")))
    return parts.where(F.col("reported") | _of(["short"])).drop("reported")


def _of(kinds: list[str]) -> Column:
    return F.col("kind").isin([NUMBERS[k] for k in kinds])


def _binned(parts: DataFrame, reach: int) -> DataFrame:
    low, high = F.greatest(F.col("first") - reach, F.lit(0)), F.col("last") + reach
    bins = F.sequence(F.floor(low / BIN), F.floor((high - 1) / BIN))
    return parts.withColumn("low", low).withColumn("high", high).withColumn("bin", F.explode(bins))


def _without_overlap(parts: DataFrame, others: DataFrame) -> DataFrame:
    """Parts that share no character with any of the others."""
    a, b = _binned(parts, 0).alias("a"), _binned(others, 0).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("row_id", "bin")]
    hit = a.join(b, [*on, F.col("a.first") < F.col("b.last"), F.col("b.first") < F.col("a.last")], "left_semi")
    return parts.join(hit.select("row_id", "kind", "first"), ["row_id", "kind", "first"], "left_anti")


def _role() -> Column:
    pairs = [x for kind, (_, role, _) in KINDS.items() for x in (F.lit(NUMBERS[kind]), F.lit(role))]
    return F.create_map(*pairs)[F.col("kind")]


def _linked(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """Weak parts with a complementary part, apart from them, in their scope."""
    wanted = [x for kind, (_, role, _) in KINDS.items() for x in (F.lit(NUMBERS[kind]), F.array(*map(F.lit, COMPLEMENTS[role])))]
    a = _binned(weak, SCOPE).withColumn("role", F.explode(F.create_map(*wanted)[F.col("kind")])).alias("a")
    b = _binned(parts, 0).withColumn("role", _role()).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("row_id", "bin", "role")]
    near = (F.col("b.first") < F.col("a.high")) & (F.col("b.last") > F.col("a.low"))
    apart = (F.col("b.last") <= F.col("a.first")) | (F.col("b.first") >= F.col("a.last"))
    return a.join(b, [*on, near & apart], "left_semi").select("row_id", "kind", "first", "last").distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans, an array of (first, kind, last, strong).

    Spans ascend by start, then kind; positions are code points, the end is exclusive. Null and
    empty texts have none; repeated rows are reported one by one. A weak candidate that overlaps a
    strong match, or a random value inside another part, is not a part of its own.
    """
    extracted = written(_extract(texts_of(docs, id_col, text_col)), "secrets")
    parts = written(_parts(extracted), "parts")
    strong = parts.where(_of([k for k, v in KINDS.items() if v[2]]))
    weak = _without_overlap(parts.where(_of(["identifier", "endpoint", "short"])), strong)
    random = _without_overlap(parts.where(_of(["random"])), strong.unionByName(weak))
    weak = written(weak.unionByName(random), "weak")
    found = strong.withColumn("strong", F.lit(True)).unionByName(_linked(weak, strong.unionByName(weak)).withColumn("strong", F.lit(False)))
    spans = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("first", "kind", "last", "strong"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<first:bigint,kind:int,last:bigint,strong:boolean>>)")
    return extracted.select("row_id", "doc_id").join(spans, "row_id", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["first"].cast("string"), x["last"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the strong kinds, a digest of their spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == NUMBERS[kind])).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    base = _joined(F.filter("spans", lambda x: x["strong"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
