"""Exact deduplication as a Grace hash: spill by hash digits, then open addressing.

Rows with identical texts form a group; of each group the row with the largest id stays. Inside
each Arrow batch equal texts first fold into one, so that a text that holds a third of all rows
reaches the spill files once per batch. The spill files are a table bucketed by hash digits, in
the shared scratch folder. A bucket whose texts exceed the memory budget is spilled again, alone, into
as many children as its size calls for, by the next digits; one that fits goes through an
open-addressing table which compares complete texts. So every level divides every bucket that is too
large, whatever the size of the table; a bucket of one content only is never too large, since the
table holds each content once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.common import parts_for, texts_of
from hitledger.sinks.scratch import scratch_path

BUCKET_BYTES = 32 << 20
FANOUT = 1 << 14  # spill files of one job
LEVELS = 8
SPILL = "doc_id long, row_id long, rep_id long, digest long, text binary, copies long, last_id long, last_row long"
FOUND = "rep_id long, keep_id long, keep_row long, group_size long, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; a slot is taken only if hash and whole content agree."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def place(self, digest: int, content: bytes) -> int:
        """The number of this content, in order of first arrival."""
        if 2 * len(self.hashes) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = digest & mask
        while (held := self.slots[at]) >= 0:
            if self.hashes[held] == digest and self.contents[held] == content:
                return int(held)
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(digest)
        self.contents.append(content)
        return len(self.hashes) - 1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for number, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _better(doc: int | None, row: int, than_doc: int | None, than_row: int) -> bool:
    """Larger ids win, then earlier rows; a null id loses to any other."""
    if doc == than_doc:
        return row < than_row
    return than_doc is None or (doc is not None and doc > than_doc)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row that has the text, and bare rows for the others."""
    schema = pa.schema(
        [(n, pa.binary() if n == "text" else pa.int64()) for n in (x.split()[0] for x in SPILL.split(", "))]
    )
    for batch in batches:
        ids, rows, digests = (batch.column(k).to_pylist() for k in (0, 1, 2))
        texts = batch.column(3).cast(pa.binary()).to_pylist()
        seen, first = ContentTable(4096), []
        out_text, copies, last_id, last_row, rep = [], [], [], [], []
        for k, (doc, row, digest, text) in enumerate(zip(ids, rows, digests, texts)):
            number = seen.place(digest, text)
            if number == len(first):
                first.append(k)
                out_text.append(text)
                copies.append(1)
                last_id.append(doc)
                last_row.append(row)
            else:
                head = first[number]
                out_text.append(None)
                copies.append(0)
                last_id.append(None)
                last_row.append(None)
                copies[head] += 1
                if _better(doc, row, last_id[head], last_row[head]):
                    last_id[head], last_row[head] = doc, row
            rep.append(rows[first[number]])
        yield pa.RecordBatch.from_pydict(
            dict(zip(schema.names, (ids, rows, rep, digests, out_text, copies, last_id, last_row))), schema
        )


def _groups(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of one bucket: rows by batch, distinct contents in the table."""
    seen = ContentTable()
    size, keep = [], []
    reps, numbers = [], []
    for batch in batches:
        rep, digest, text, copies, last_id, last_row = (batch.column(n).to_pylist() for n in ("rep_id", "digest", "text", "copies", "last_id", "last_row"))
        for r, d, t, c, doc, row in zip(rep, digest, text, copies, last_id, last_row):
            number = seen.place(d, t)
            if number == len(size):
                size.append(0)
                keep.append((doc, row))
            elif _better(doc, row, *keep[number]):
                keep[number] = (doc, row)
            size[number] += c
            reps.append(r)
            numbers.append(number)
    sha = [hashlib.sha256(x).hexdigest() for x in seen.contents]
    yield pa.RecordBatch.from_pydict(
        {
            "rep_id": pa.array(reps, pa.int64()),
            "keep_id": pa.array([keep[n][0] for n in numbers], pa.int64()),
            "keep_row": pa.array([keep[n][1] for n in numbers], pa.int64()),
            "group_size": pa.array([size[n] for n in numbers], pa.int64()),
            "text_sha256": pa.array([sha[n] for n in numbers], pa.string()),
        }
    )


class _Spilled:
    """A level of spill files: rows by bucket, read bucket by bucket without a shuffle."""

    def __init__(self, rows: DataFrame, columns: list[str], bucket: Column, buckets: int):
        """Writes these columns of rows to the buckets that the expression numbers from 0."""
        self.spark, self.path = rows.sparkSession, scratch_path(rows.sparkSession, "spill")
        self.name, self.columns = f"spill_{uuid.uuid4().hex}", columns
        (
            rows.select(*self.columns, bucket.cast("int").alias("bucket"))
            .repartition(buckets, "bucket")
            .write.option("path", self.path)
            .option("compression", "zstd")
            .bucketBy(buckets, "bucket")
            .saveAsTable(self.name)
        )

    def texts(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("text").isNotNull())

    def sizes(self) -> list[tuple[int, int, int]]:
        """Bucket, bytes and number of different hashes of each: one row per file."""
        found = self.texts().groupBy("bucket").agg(F.sum(F.octet_length("text")), F.count_distinct("digest"))
        return sorted(tuple(row) for row in found.collect())

    def close(self) -> None:
        """The session's catalogue forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")


def _children(over: list[tuple[int, int]], bucket_bytes: int) -> Iterator[list[tuple[int, int]]]:
    """Parents and the number of children of each, in groups of FANOUT children at most."""
    group, total = [], 0
    for bucket, size in over:
        many = min(FANOUT, max(2, parts_for(size, max(1, bucket_bytes // 2))))
        if group and total + many > FANOUT:
            yield group
            group, total = [], 0
        group.append((bucket, many))
        total += many
    if group:
        yield group


def _divide(spilled: _Spilled, level: int, bucket_bytes: int, done: Callable[[DataFrame], None], saw: Callable[[int, list], None]) -> None:
    """Hands the groups of all buckets to `done`; those over the budget are spilled again first."""
    sizes = spilled.sizes()
    saw(level, sizes)
    over = [(bucket, size) for bucket, size, texts in sizes if size > bucket_bytes and texts > 1 and level < LEVELS]
    texts = spilled.texts()
    if len(over) < len(sizes):
        fits = texts.where(~F.col("bucket").isin([b for b, _ in over])) if over else texts
        done(fits.groupBy("bucket").applyInArrow(_groups, FOUND))
    for parents in _children(over, bucket_bytes):
        first = [sum(n for _, n in parents[:k]) for k in range(len(parents))]
        plan = [(bucket, at, n) for (bucket, n), at in zip(parents, first)]
        plan = F.broadcast(spilled.spark.createDataFrame(plan, "bucket int, first int, many int"))
        own = texts.where(F.col("bucket").isin([b for b, _ in parents])).join(plan, "bucket")
        child = F.col("first") + F.pmod(F.xxhash64("digest", F.lit(level)), F.col("many"))
        children = _Spilled(own, spilled.columns, child, sum(n for _, n in parents))
        _divide(children, level + 1, bucket_bytes, done, saw)
        children.close()


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    saw: Callable[[int, list], None] = lambda level, sizes: None,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty ones. Of rows that tie in id and text
    one stays. A null id loses to any other; a group of null ids has a null keep_id and keeps one
    row. An empty table gives an empty result. Other columns of docs are not read.

    `saw` is told the level and the bucket, bytes and number of hashes of each bucket of a spill job.
    Texts whose hashes agree in all digits stay in one bucket; the table compares whole texts.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.xxhash64("text").alias("digest"), "text")
    buckets = min(FANOUT, parts_for(size, bucket_bytes // 2, 8))
    # bare rows carry no text and are dealt by their own number
    dealt = F.when(F.col("text").isNotNull(), F.xxhash64("digest", F.lit(0))).otherwise(F.xxhash64("row_id"))
    folded = rows.mapInArrow(_fold, SPILL)
    spilled = _Spilled(folded, folded.columns, F.pmod(dealt, F.lit(buckets)), buckets)
    found: list[str] = []

    def done(groups: DataFrame) -> None:
        found.append(scratch_path(spark, "groups"))
        groups.write.option("compression", "zstd").parquet(found[-1])

    _divide(spilled, 1, bucket_bytes, done, saw)
    spilled.close()
    members = spark.read.schema(SPILL).parquet(spilled.path).select("doc_id", "row_id", "rep_id")
    groups = spark.read.schema(FOUND).parquet(*found) if found else spark.createDataFrame([], FOUND)
    return members.join(groups, "rep_id").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
