"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document becomes a short vector of transformed statistics of its whole text. Each class has a
mean and a covariance that is shrunk towards the pooled covariance and its diagonal. A document's
score is the difference of the two log densities; each needs one triangular solve with the cached
Cholesky factor of its class (the Mahalanobis distance) and the factor's log determinant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.byte_words import byte_class, span_hashes, spans
from hitledger.llm.common import text_bytes, texts_of, written

THRESHOLD = 0.7
POOLED = 0.3  # weight of the pooled covariance
DIAGONAL = 0.05  # weight of its diagonal
RIDGE = 1e-3
BATCH_BYTES = 2 << 20

WORD = byte_class((0x21, 0xFF))
LINE = ~byte_class((0x0A, 0x0A))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes by class; what is not listed counts in the last one.
CLASSES = {
    "lower": byte_class((0x61, 0x7A)),
    "upper": byte_class((0x41, 0x5A)),
    "beyond": byte_class((0x80, 0xFF)),
    "digit": byte_class((0x30, 0x39)),
    "space": byte_class((0x20, 0x20)),
    "newline": byte_class((0x0A, 0x0A)),
    "stop": byte_class((0x2E, 0x2E)),
    "comma": byte_class((0x2C, 0x2C)),
    "mark": byte_class((0x21, 0x21), (0x3F, 0x3F)),
    "bar": byte_class((0x7C, 0x7C)),
    "bracket": byte_class((0x28, 0x29), (0x3C, 0x3C), (0x3E, 0x3E), (0x5B, 0x5B), (0x5D, 0x5D), (0x7B, 0x7B), (0x7D, 0x7D)),
    "symbol": byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3D, 0x3D), (0x40, 0x40), (0x5C, 0x5C), (0x5E, 0x60), (0x7E, 0x7E)),
}
FEATURES = (
    "length", "lower", "upper", "beyond", "digit", "newline", "stop", "comma", "mark", "bar", "bracket", "symbol", "other",
    "word_length", "sentence", "line_length", "same_words", "same_lines", "echoes", "ends_odd", "starts_upper",
)


def _class_numbers() -> np.ndarray:
    numbers = np.full(256, len(CLASSES), np.int32)
    for n, marks in enumerate(CLASSES.values()):
        numbers[marks] = n
    return numbers


_CLASS = _class_numbers()


def _distinct(text_of: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Distinct hashes per text; 40 bits of each suffice for a statistic."""
    key = np.sort((text_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=texts)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    text_of = np.repeat(np.arange(texts, dtype=np.int32), size)
    width = len(CLASSES) + 1
    counts = np.bincount(text_of * width + _CLASS[raw], minlength=texts * width).reshape(texts, width)
    by = dict(zip([*CLASSES, "other"], counts.T))
    starts, ends, first = spans(raw, offsets, WORD)
    words = np.diff(first)
    word_of = np.repeat(np.arange(texts), words)
    line_start, line_end, line_first = spans(raw, offsets, LINE)
    lines = np.diff(line_first)
    line_of = np.repeat(np.arange(texts), lines)
    word_hashes = span_hashes(raw, starts, ends)
    echo = (word_hashes[1:] == word_hashes[:-1]) & (word_of[1:] == word_of[:-1])
    echoes = np.bincount(word_of[1:], echo, minlength=texts)
    same_words = (words - _distinct(word_of, word_hashes, texts)) / (words + 12)
    same_lines = (lines - _distinct(line_of, span_hashes(raw, line_start, line_end), texts)) / (lines + 12)  # few lines say little
    last = raw[ends - 1]
    odd = np.bincount(word_of, ~LETTER[last] & (last != 0x2E) & (last != 0x2C), minlength=texts)
    capital = np.bincount(word_of, CLASSES["upper"][raw[starts]], minlength=texts)

    def rate(n: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log((n + 0.5) / (of + 1.0))

    chars = size - np.bincount(text_of, (raw & 0xC0) == 0x80, minlength=texts)
    out = {
        "length": np.log1p(chars),
        "word_length": rate(chars - by["space"] - by["newline"], words),
        "sentence": rate(by["stop"] + by["mark"], words),
        "line_length": np.log((chars + 1) / (lines + 1)),
        "same_words": np.log(same_words + 0.1),
        "same_lines": np.log(same_lines + 0.1),
        "echoes": rate(echoes, words),
        "ends_odd": rate(odd, words),
        "starts_upper": rate(capital, words),
    }
    return np.stack([out[f] if f in out else rate(by[f], chars) for f in FEATURES], 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
            x = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, x.T)], ["doc_id", *FEATURES])
            a = b


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES of every whole text; null and empty texts have the features of no text."""
    schema = ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES)])
    return texts_of(docs, id_col, text_col).mapInArrow(_features, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """From each class's number of rows, sums and sums of products."""
        d = sums.shape[1]
        n = np.maximum(counts, 1)
        means = sums / n[:, None]
        own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
        shared = (own * counts[:, None, None]).sum(0) / max(counts.sum(), 1)
        cov = (1 - pooled) * own + pooled * shared
        cov = (1 - diagonal) * cov + diagonal * np.eye(d) * np.trace(cov, axis1=1, axis2=2)[:, None, None] / d + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(cov)
        log_dets = 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)
        return cls(means, np.linalg.inv(lower), log_dets, np.log((counts + 1) / (counts.sum() + 2)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(self.log_priors[k] - 0.5 * (self.log_dets[k] + (z * z).sum(1)))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and task: its rows, sums and sums of products."""
    d = len(FEATURES)
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        y = np.asarray(batch.column(0))
        x = np.stack([np.asarray(batch.column(f)) for f in FEATURES], 1)
        for k in (0, 1):
            own = x[y == k]
            counts[k] += len(own)
            sums[k] += own.sum(0)
            products[k] += own.T @ own
    values = [[*sums[k], *products[k].ravel()] for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(counts), pa.array(values, pa.list_(pa.float64()))], ["label", "n", "v"])


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Learns from all rows of labels that are 0 or 1 and have features; repeated rows count once.

    Without any labelled row both classes are alike and every score is one half.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").distinct()
    rows = features.join(known, "doc_id").select("label", *FEATURES).mapInArrow(_sums, "label int, n double, v array<double>")
    d = len(FEATURES)
    values = rows.select("label", F.posexplode(F.concat(F.array("n"), "v")).alias("at", "value"))
    found = np.zeros((2, 1 + d + d * d))
    for row in values.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():  # the size of the model
        found[row.label, row.at] = row.value
    counts, sums, products = found[:, 0], found[:, 1 : d + 1], found[:, d + 1 :].reshape(2, d, d)
    return Discriminant.fit(counts, sums, products)


def score(features: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold, else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(np.stack([np.asarray(batch.column(f)) for f in FEATURES], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: those with crc32 of the id as text = 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels that are not held out, scores every document."""
    features = written(document_features(docs), "features")
    model = fit(features, labels.where(~held_out()))
    return score(features, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns, without a shuffle.

    The model is that of classify: it learns from the labels that are not held out. The features are
    written first: two Python steps in one stage would start two workers for each core, which stay.
    """
    features = written(document_features(docs, id_col, text_col), "features")
    model = fit(features, labels.where(~held_out()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(pc.fill_null(batch.column(text_col), ""))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
                x = statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(model.score(x) >= threshold))
                a = b

    return docs.mapInArrow(keep, docs.schema)
