"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells of source, language and topic. The tokens of the cells are raked: one
margin after the other, every cell is scaled so that the shares of the margin's values meet their
targets, until all margins hold. A document's probability is its cell's weight times one factor,
at most 1, and the factor is chosen so that the expected tokens meet the budget. All of it is
DataFrame functions; the fitted table has one row per cell that occurs, never one per document.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.common import written
from hitledger.operators.positions import free_name

MARGINS = ("source", "lang", "topic")
SWEEPS = 40
TOLERANCE = 1e-4
BUDGET = 0.5  # of all tokens


def text_tokens(text: Column) -> Column:
    """The words of the whole text, as a measure of its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S++")).cast("long"), F.lit(0).cast("long"))


def text_topic(text: Column) -> Column:
    """A stand-in for topics, which the tables do not label: the layout of the whole text.

    By its lines and by the marks between its words: table, list, heading-like or running text.
    """
    size, words = F.length(text), text_tokens(text)

    def share(mark: str) -> Column:
        return (size - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.greatest(words, F.lit(1))

    return (
        F.when(words == 0, "empty")
        .when(share("|") > 0.2, "table")
        .when(share("!") + share("*") + share("#") > 0.2, "marked")
        .when(share("\n") > 0.1, "lines")
        .when(words < 80, "note")
        .otherwise("article")
    )


def _category(column: Column) -> Column:
    """Null is a value of its own."""
    return F.coalesce(column.cast("string"), F.lit(""))


def _margins(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """The margins of each row. A table without a column source or lang has one value there, ''."""
    held = {c.lower() for c in docs.columns}
    found = {m: _category(F.col(m)) if m in held else F.lit("") for m in MARGINS}
    if "topic" not in held:
        found["topic"] = text_topic(F.coalesce(F.col(text_col), F.lit("")))
    return found


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the margins and n_tokens of each document."""
    margins = [column.alias(m) for m, column in _margins(docs, text_col).items()]
    return docs.select(F.col(id_col).alias("doc_id"), *margins, text_tokens(F.col(text_col)).alias("n_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("documents"))


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """value, share: natural shares to a power; 1 leaves them, 0 makes them equal."""
    own = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    return own.select("value", F.pow("t", F.lit(power)).alias("share"))


def _targets(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """margin, value, share: shares sum to 1 over the values that occur.

    A value without a target keeps its natural share; a target whose value has no tokens goes.
    """
    tables = []
    for margin in MARGINS:
        own = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        if margin in targets:
            given = targets[margin].select(F.col("value").cast("string"), F.col("share").cast("double")).groupBy("value").agg(F.sum("share").alias("share"))
            own = own.join(given, "value", "left")
        else:
            own = own.withColumn("share", F.lit(None).cast("double"))
        total = own.agg(F.sum("t").alias("all_t"), F.sum(F.when(F.col("share").isNotNull(), F.col("t"))).alias("set_t"), F.sum("share").alias("set_share"))
        own = own.crossJoin(F.broadcast(total))  # one row
        share = F.when(F.col("share").isNotNull(), F.col("share") / F.col("set_share") * F.col("set_t") / F.col("all_t"))
        tables.append(own.select(F.lit(margin).alias("margin"), "value", F.coalesce(share, F.col("t") / F.col("all_t")).alias("share")))
    return reduce(DataFrame.unionByName, tables)


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with their weight: raked over natural tokens; and the deviation that is left.

    The deviation is the most that the last sweep still had to change a margin, as a share of it. Targets
    that contradict the cells that occur are met as far as the sweeps get; the last margin is then
    exact, the deviation is not below the tolerance, and a warning says so. Cells without tokens
    have the weight 1.
    """
    cells = written(cells, "cells")
    wanted = written(_targets(cells, targets), "targets")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    raked, moved = cells.withColumn("raked", F.col("tokens")), 0.0
    for _ in range(sweeps if total else 0):
        worst = []
        for margin in MARGINS:
            share = wanted.where(F.col("margin") == margin).select(F.col("value").alias(margin), "share")
            sums = raked.groupBy(margin).agg(F.sum("raked").alias("margin_sum"))
            factor = sums.join(share, margin).select(margin, (F.col("share") * total / F.col("margin_sum")).alias(f"factor_{margin}"))
            raked = raked.join(factor, margin, "left").withColumn("raked", F.col("raked") * F.coalesce(f"factor_{margin}", F.lit(1.0)))
            worst.append(f"factor_{margin}")
        raked = written(raked, "raked")
        moved = raked.agg(F.max(F.greatest(*[F.abs(F.coalesce(c, F.lit(1.0)) - 1) for c in worst]))).first()[0]
        raked = raked.drop(*worst)
        if moved < tolerance:
            break
    if moved >= tolerance:
        warnings.warn(f"the margins contradict each other: after {sweeps} sweeps one still moves by {moved:.2g} of itself", stacklevel=2)
    raked = raked.withColumn("deviation", F.lit(float(moved)))
    return raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0)).drop("raked")


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with the probability min(1, factor * weight), so that expected tokens meet the budget.

    A cell that the factor would take over 1 is taken whole and the rest make up for it.
    """
    cells = written(cells, "weighted")
    wanted = budget * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    factor, whole = 0.0, 0
    while True:
        p = F.col("weight") * factor
        over = (p >= 1) & F.lit(factor > 0)
        full, rest, n = cells.agg(
            F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("tokens") * F.col("weight"))), F.lit(0.0)), F.count_if(over)
        ).first()  # one row
        if factor and n == whole:
            break
        whole = n
        if rest <= 0:
            break
        factor = max(wanted - full, 0.0) / rest
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * factor))


def draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def fit_mixture(rows: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cells of described rows: margins, tokens, documents, deviation, weight, probability.

    Without targets, sources are tempered to the power 0.5, languages to 0.7, and topics stay.
    """
    cells = written(cells_of(rows), "mixture")
    if targets is None:
        targets = {"source": tempered_targets(cells, "source", 0.5), "lang": tempered_targets(cells, "lang", 0.7)}
    return written(probabilities(rake(cells, targets), budget), "fitted")


def sample(rows: DataFrame, fitted: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Described rows with weight, probability and sampled; rows with the same key share their draw.

    A null key draws as one key of its own.
    """
    joined = rows.join(fitted.select(*MARGINS, "weight", "probability"), list(MARGINS))
    return joined.withColumn("sampled", draw(F.col(key), seed) < F.col("probability"))


def mix(docs: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled.

    Null texts have no tokens and no topic but 'empty'; null margins count as ''. An empty table
    gives an empty result. A column named topic is used if there is one.
    """
    rows = written(described(docs), "described")
    found = sample(rows, fit_mixture(rows, budget, targets), seed=seed)
    return found.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "sampled")


def sample_documents(docs: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, seed: int = 0) -> DataFrame:
    """The sampled rows of docs with all their columns. A null id draws by its text."""
    own = {m: free_name(docs.columns, f"_mix_{m}") for m in MARGINS}
    p = free_name(docs.columns, "_mix_p")
    fitted = fit_mixture(described(docs), budget, targets).select(*[F.col(m).alias(c) for m, c in own.items()], F.col("probability").alias(p))
    rows = docs.withColumns({own[m]: column for m, column in _margins(docs, "text").items()})
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return rows.join(fitted, list(own.values())).where(draw(key, seed) < F.col(p)).select(*docs.columns)
