"""Importance resampling towards a target distribution of hashed word features.

Features are all runs of one to two consecutive words; a feature belongs to the bucket that the
CRC-32 of its bytes names. The counts of the buckets over all documents and over the target texts give
an array of gains, one per bucket; a document's weight is the floored mean of the gains of its
features. With Gumbel noise from a hash of its id added, the documents with the highest scores are a
sample by importance. Scores are computed once and written; the cutoff is found by bisection: jobs
that count exactly how many written rows lie beyond some thresholds, first of the score, then
of the id among rows at the cutoff, then of the row's number. The rows drawn are ranked by
ranges of that order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.byte_words import byte_class, spans_of_pieces
from hitledger.llm.common import longs, text_bytes, texts_of, written
from hitledger.operators.positions import OrderedRows

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
STEPS = 15  # thresholds that one job counts
BLOCK_BYTES = 1 << 20
LONG_WORD = 64

WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WEIGHED = "row_id long, doc_id long, n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _crc_table()


def _zeros_tables(longest: int) -> np.ndarray:
    """For each length, what so many zero bytes make of each byte of a CRC register."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for k in range(longest):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ _STEP[out[k] & np.uint32(255)]
    return out


_ZEROS = _zeros_tables(LONG_WORD + 1)


def _shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values moved past so many bytes, at most LONG_WORD + 1: crc(a + b) = shifted(crc(a)) ^ crc(b)."""
    out = np.zeros(len(crcs), np.uint32)
    for place in range(4):
        out ^= _ZEROS[lengths, place, (crcs >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: all short words byte by byte at once, long ones by zlib."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    at, size = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n_long = int((size > LONG_WORD).sum())
    for k in range(int(min(size.max(initial=0), LONG_WORD))):
        live = slice(0, int(np.searchsorted(-size, -k, "left")))  # words longer than k
        state[live] = (state[live] >> np.uint32(8)) ^ _STEP[(state[live] ^ raw[at[live] + k]) & np.uint32(255)]
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def pair_crcs(crcs: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word but the last, a space and the word after it."""
    length = ends[1:] - starts[1:]
    short = length <= LONG_WORD
    first = np.bitwise_xor(_shifted(crcs[:-1], np.ones(len(length), np.int64)), _SPACE)
    out = _shifted(first, np.where(short, length, 0)) ^ crcs[1:]
    for i in np.flatnonzero(~short).tolist():
        out[i] = zlib.crc32(raw[starts[i + 1] : ends[i + 1]].tobytes(), int(first[i]))
    return out


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The bucket of every feature with the number of its text, in blocks; and whether they are single words.

    Long texts are read piece by piece; of a piece only its last word is kept for the next.
    """
    kept: tuple | None = None  # the last word so far: its CRC and its text
    for piece, starts, ends, text in spans_of_pieces(raw, offsets, WORD_BYTES, BLOCK_BYTES):
        crcs = word_crcs(piece, starts, ends)
        yield (crcs % np.uint32(buckets)).astype(np.int64), text, True
        same = text[1:] == text[:-1]
        pairs = pair_crcs(crcs, piece, starts, ends)[same]
        yield (pairs % np.uint32(buckets)).astype(np.int64), text[1:][same], False
        if kept is not None and kept[1] == text[0]:
            joined = zlib.crc32(b" " + piece[starts[0] : ends[0]].tobytes(), kept[0])
            yield np.array([joined % buckets], np.int64), text[:1], False
        kept = (int(crcs[-1]), int(text[-1]))


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that a task meets."""
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for found, _, _ in feature_buckets(raw, offsets, buckets):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(met), longs(total[met])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features all texts have in each bucket: one row per bucket comes to the driver."""
    rows = texts.select("text").mapInArrow(_counter(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, smoothed, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    ratios = ((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)) for s, t in zip(source, target))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weigher(gains: np.ndarray):
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            many = len(batch)
            sums, n_words, n_features = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
            for found, text, single in feature_buckets(raw, offsets, buckets):
                first = int(text[0]) if len(text) else 0
                n = np.bincount(text - first)
                place = slice(first, first + len(n))
                n_features[place] += n
                if single:
                    n_words[place] += n
                np.add.at(sums, text, gains[found])
            weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), longs(n_words), longs(n_features), longs(weight)],
                ["row_id", "doc_id", "n_words", "n_features", "weight"],
            )

    return weigh


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id; a null id hashes as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text_col: str, buckets: int, seed: int) -> DataFrame:
    """Every row with its number, id, words, features, weight and score, written."""
    rows = texts_of(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(target_text_col).cast("string"), F.lit("")).alias("text"))
    gains = gains_of(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    weighed = numbered.mapInArrow(_weigher(gains), WEIGHED)
    return written(weighed.withColumn("score", F.col("weight") + _noise(seed)), "scores")


def _cut(rows: DataFrame, column: str, wanted: int) -> tuple[int, int]:
    """The largest c such that fewer than `wanted` rows lie below c, and how many do.

    Thresholds divide what is left of the range of the column's values; each job counts the rows
    below STEPS of them, exactly.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below = 0  # rows below low: fewer than wanted; rows below high + 1: wanted or more
    while low < high:
        step = -(-(high + 1 - low) // (STEPS + 1))
        at = [x for x in range(low + step, high + 1, step)]
        counts = rows.agg(*(F.count_if(F.col(column) < x).alias(f"n{i}") for i, x in enumerate(at))).first()
        fewer = [(x, n) for x, n in zip(at, counts) if n < wanted]
        high = min([high, *(x - 1 for x, n in zip(at, counts) if n >= wanted)])
        if fewer:
            low, below = fewer[-1]
    return low, below


def drawn_rows(scores: DataFrame, wanted: int) -> DataFrame:
    """The `wanted` rows with the highest score; of equal scores the smaller ids, null ids last.

    Rows with the same score and id go by their number in the written table.
    """
    keys = scores.select(
        "*",
        (-F.col("score")).alias("_0"),
        F.col("doc_id").isNull().cast("long").alias("_1"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("_2"),
        F.col("row_id").alias("_3"),
    )
    chosen, tied = F.lit(False), F.lit(True)
    for name in ("_0", "_1", "_2", "_3"):
        if wanted <= 0:
            break
        value, below = _cut(keys.where(tied), name, wanted)
        chosen = chosen | (tied & (F.col(name) < value))
        tied = tied & (F.col(name) == value)
        wanted -= below
        if keys.where(tied).count() == wanted:
            chosen, wanted = chosen | tied, 0
    return keys.where(chosen).select(*scores.columns)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Of the documents with least_words words or more, floor(percent * their number / 100) with the
    highest scores are drawn and ranked from 1, equal scores by ascending id. Words are runs of letters,
    digits and characters outside ASCII, A-Z lower-cased, of the whole text; null and empty texts have
    none and weigh 0. Null ids rank after others with their score. Repeated rows are rows of their own. An empty
    table gives no rows; an empty target gives every bucket the gain of what it lacks.
    """
    scores = weigh(docs, target, id_col, text_col, target_text_col, buckets, seed)
    long_enough = scores.where(F.col("n_words") >= least_words)
    wanted = percent * long_enough.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = drawn_rows(long_enough, wanted)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_id")]
    ranked = OrderedRows(drawn, order).between(name="position")
    ranked = ranked.select("row_id", (F.col("position") + 1).alias("rank"))
    return scores.join(ranked, "row_id", "left").select(*columns, "rank")
