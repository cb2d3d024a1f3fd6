"""Token ids in directly addressable codes.

An id is split into chunks of CHUNK_BITS bits. Level 0 holds the lowest chunk of every id; a bitmap
tells which ids go on, and the next level holds the next chunk of those alone. A rank directory over
each bitmap (ones before every BLOCK bits) turns a position of one level into a position of the
next, so that any single id is read without decoding its neighbours.

A store is a Parquet folder with one row per segment: consecutive whole documents, with their ids
as levels, and the number of ids of each document. Segments ascend by (doc_id, text); their order is
(part, segment). A second folder, `starts`, says how many ids lie before each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitledger.llm.byte_words import byte_class, mix, ragged, span_hashes
from hitledger.llm.common import longs, parts_for, text_bytes, texts_of

CHUNK_BITS = 8
BLOCK = 512
SEGMENT_IDS = 1 << 20
PART_BYTES = 24 << 20
END_ID = 2
CACHE_UNITS = 2_000_000
ENCODE_UNITS = 4096
ENCODE_BYTES = 2 << 20

SEGMENTS = (
    "part long, segment long, rel_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>,"
    " chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)
DOCS = "part long, doc_id long, rel_start long, n_tokens long, ids_crc32 long"


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of the levels."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        if not goes_on.any():
            return chunks, bitmaps, ranks
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
        counts = np.cumsum(ones.sum(1, dtype=np.uint32), dtype=np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([np.zeros(1, np.uint32), counts[:-1]]).tobytes())
        rest = more[goes_on]


def decode_levels(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(chunks[0], np.uint8).astype(np.uint32)
    at = np.arange(len(ids))
    for level, bits in enumerate(bitmaps, 1):
        goes_on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at), bitorder="little").view(bool)
        at = at[goes_on]
        ids[at] |= np.frombuffer(chunks[level], np.uint8).astype(np.uint32) << np.uint32(CHUNK_BITS * level)
    return ids


def ids_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The ids at these positions, by ranks; no other id is decoded."""
    at = at.astype(np.int64)
    ids = np.frombuffer(chunks[0], np.uint8)[at].astype(np.uint32)
    live = np.arange(len(at))
    for level, raw in enumerate(bitmaps, 1):
        bits, directory = np.frombuffer(raw, np.uint8), np.frombuffer(ranks[level - 1], np.uint32)
        goes_on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        live, at = live[goes_on], at[goes_on]
        block = at // BLOCK
        inside = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        ones = np.bitwise_count(np.where(inside < (at >> 3)[:, None], bits[np.minimum(inside, len(bits) - 1)], 0)).sum(1, dtype=np.int64)
        last = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
        at = directory[block].astype(np.int64) + ones + np.bitwise_count(last).astype(np.int64)
        ids[live] |= np.frombuffer(chunks[level], np.uint8)[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
    return ids


_GRAPH = byte_class((0x21, 0x7E))
_LATIN = byte_class((0xC3, 0xDF))
_TAIL = byte_class((0x80, 0xBF))


class UnitEncoder:
    """Ids of whole texts from the ids of their units, each distinct unit encoded once by the library.

    A unit begins at a space between two characters that are no white space. The byte-level
    pre-tokenizer always starts a piece there, so the ids of a text are those of its units in
    order. Neighbours outside ASCII and the two-byte letters are not split, which is always right.
    Units are known by a 64-bit hash of content and length; the cache starts anew at CACHE_UNITS.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by key
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int32)  # of unit 0, the end id
        self.ids = np.array([self.end_id], np.uint16)

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return at, known

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes the units that are not known yet."""
        at, known = self._look_up(keys)
        new = np.flatnonzero(~known)
        if len(self.starts) + len(new) > CACHE_UNITS and len(self.starts) > 1:
            self._clear()
            return self._learn(raw, keys, starts, ends)
        if not len(new):
            return None
        ids, lengths = [], np.empty(len(new), np.int32)
        for a in range(0, len(new), ENCODE_UNITS):
            part = new[a : a + ENCODE_UNITS]
            texts = [raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts[part].tolist(), ends[part].tolist())]
            for k, x in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), a):
                lengths[k] = len(x.ids)
                ids.append(np.array(x.ids, np.uint32))
        ids = np.concatenate(ids)
        kind = np.result_type(self.ids, np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32)
        numbers = np.arange(len(self.starts), len(self.starts) + len(new), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths, dtype=np.int64) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids.astype(kind, copy=False), ids.astype(kind)])
        self.keys, self.numbers = np.insert(self.keys, at[new], keys[new]), np.insert(self.numbers, at[new], numbers)
        return None

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each text."""
        filled = offsets[:-1] < offsets[1:]
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            before = _GRAPH[raw[:-2]]
            before[1:] |= _TAIL[raw[1:-2]] & _LATIN[raw[:-3]]
            cut[1 : len(raw) - 1] = (raw[1:-1] == 32) & before & (_GRAPH[raw[2:]] | _LATIN[raw[2:]])
        edges = offsets[1:-1]
        cut[edges] = False
        cut[edges[edges > 0] - 1] = False
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut[: len(raw)])
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        keys = mix(span_hashes(raw, starts, ends) + (ends - starts).astype(np.uint64))
        keys, where, units = np.unique(keys, return_index=True, return_inverse=True)
        self._learn(raw, keys, starts[where], ends[where])
        order = self.numbers[self._look_up(keys)[0]][units]
        ahead = np.searchsorted(starts, offsets[1:])  # units before the end of each text
        order = np.insert(order, ahead, 0)
        lengths = self.lengths[order].astype(np.int64)
        ids = self.ids[ragged(self.starts[order], lengths)]
        last = ahead + np.arange(len(ahead))  # where the end id of each text stands
        total = np.cumsum(lengths)[last] if len(last) else np.zeros(0, np.int64)
        return ids, np.diff(total, prepend=0)


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def _encoder(path: str, end_id: int) -> UnitEncoder:
    """One per Python worker, kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = UnitEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every whole text, appends end_id and writes the store at path, ascending by id.

    Strings of special tokens inside a text are what the library makes of them by default. Null and
    empty texts are the end id alone; null ids come first; repeated ids stand by text. A
    text of any length stays in one segment. An empty table writes an empty store.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hitledger.llm import token_store

        encoder, part, number, done = token_store._encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, held, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            chunks, bitmaps, ranks = encode_levels(np.concatenate(held))
            values = (part, number, done, size, doc_ids, np.concatenate(counts), chunks, bitmaps, ranks)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names)

        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.binary())] * 3
        names = "part segment rel_start n_ids doc_ids doc_tokens chunks bitmaps ranks".split()
        for batch in batches:
            own, (raw, offsets) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + ENCODE_BYTES, "right")) - 1)
                ids, n = encoder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                doc_ids.extend(own[a:b])
                counts.append(n)
                held.append(ids)
                size += len(ids)
                a = b
                if size >= segment_ids:
                    yield row()
                    number, done = number + 1, done + size
                    doc_ids, counts, held, size = [], [], [], 0
        if held:
            yield row()

    rows = texts_of(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts_for(size, PART_BYTES), *by)
    made = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(segments, SEGMENTS)
    made.write.option("compression", "zstd").parquet(f"{path}/segments")
    sizes = read_segments(docs.sparkSession, path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per part
    starts = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_start"))
    starts.write.parquet(f"{path}/starts")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, part_start long").parquet(f"{path}/starts")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DOCS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            n = np.array(row["doc_tokens"], np.int64)
            ids = decode_levels(row["chunks"], row["bitmaps"])
            ends = np.cumsum(n)
            data, at = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * ends).tolist()]
            sums = np.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], np.int64)
            columns = [longs(np.full(len(n), row["part"])), pa.array(row["doc_ids"], pa.int64()), longs(row["rel_start"] + ends - n), longs(n), longs(sums)]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    found = read_segments(spark, path).mapInArrow(_documents, DOCS).join(read_starts(spark, path), "part")
    return found.select("doc_id", (F.col("part_start") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """The ids at a stated list of positions in the whole store: position, token_id."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(sorted(x for x in set(positions) if row["start"] <= x < row["start"] + row["n_ids"]), np.int64)
                ids = ids_at(row["chunks"], row["bitmaps"], row["ranks"], at - row["start"])
                yield pa.RecordBatch.from_arrays([longs(at), longs(ids)], ["position", "token_id"])

    segments = read_segments(spark, path).join(F.broadcast(read_starts(spark, path)), "part")
    segments = segments.withColumn("start", F.col("part_start") + F.col("rel_start"))
    wanted = F.exists(F.lit(positions).cast("array<long>"), lambda x: (x >= F.col("start")) & (x < F.col("start") + F.col("n_ids")))
    return segments.where(wanted).mapInArrow(pick, "position long, token_id long")
