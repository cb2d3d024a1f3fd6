"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of WIDTH bytes covers it that also starts earlier in the corpus.

1.  Every window of WIDTH bytes belongs to one of its k-grams, the one with the smallest hash, the
    first of those. So equal windows belong to equal k-grams, and each occurrence of a k-gram has a
    run of window starts, its block. A shard folds equal blocks into the first of them.
2.  The blocks of all shards meet by k-gram. Equal blocks fold again. Where a k-gram has different
    blocks, their windows can still be equal, so the bytes of the blocks are fetched.
3.  The blocks of a few k-grams make a unit, cut into shards. A block is read as STRIDE strings
    over symbols of STRIDE bytes, so that WIDTH bytes are four symbols. Each shard has the transform
    of its strings. The transforms are merged by refining the interleave: one pass moves every row
    behind its preceding symbol, which sorts the merged rows by one symbol more and starts a new
    interval wherever the common prefix ends. Four passes leave intervals of equal windows, and no
    suffix of one shard was compared with one of another.
4.  Of each interval all but the earliest window go; marks meet the texts by document.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitledger.llm.byte_words import BASE, mix
from hitledger.llm.common import free_shuffles, longs, parts_for, text_bytes, texts_of, written
from hitledger.sinks.scratch import scratch_path

WIDTH = 100
GRAM = 40
STRIDE = WIDTH // 4
PIECE_BYTES = 1 << 20
PART_BYTES = 16 << 20
UNIT_BYTES = 2 << 20
STEPS = (16, 4, 1)
SHARDS = 4

BLOCKS = "gram long, block long, key long, doc_id long, copy int, first long, count int"
BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
CUTS = "gram long, key long, doc_id long, copy int, first long, count long, bytes binary"
CUT_NAMES = [x.split()[0] for x in CUTS.split(", ")]


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return cls.up, cls.down


def running_hash(raw: np.ndarray) -> np.ndarray:
    """Sums whose differences are the polynomials of the bytes between, modulo 2^64."""
    up, _ = _Powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix((sums[last] - sums[first]) * _Powers.down[first])


def window_grams(raw: np.ndarray, sums: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the place of the k-gram it belongs to; and the hash of each k-gram."""
    n = len(raw) - gram + 1
    hashes = mix((sums[gram:] - sums[:n]) * _Powers.down[:n])
    bits = max(1, n.bit_length())
    least = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    reach, left = 1, width - gram + 1  # least[i] is now over `reach` places
    while 2 * reach <= left:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < left:
        least = np.minimum(least[: len(least) - (left - reach)], least[left - reach :])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64), hashes


def _pieces(offsets: np.ndarray, size: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of whole texts of about `size` bytes, and parts of longer texts that overlap by a window.

    First and last text, and first and last byte, of each.
    """
    a = 0
    while a + 1 < len(offsets):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        if b == a + 1 and offsets[b] - offsets[a] > size:
            for at in range(int(offsets[a]), int(offsets[b]) - width + 1, size):
                yield a, b, at, min(at + size + width - 1, int(offsets[b]))
        else:
            yield a, b, int(offsets[a]), int(offsets[b])
        a = b


def shard_blocks(raw: np.ndarray, offsets: np.ndarray, base: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The blocks of a piece: k-gram, hash, text, first window start in the text, window starts."""
    if len(raw) < width:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = running_hash(raw)
    place, hashes = window_grams(raw, sums, width, gram)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.arange(len(place)) + width <= offsets[text + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place))
    first, last = first[inside[first]], last[inside[first]]
    block = hashes_between(sums, first, last + width - 1) ^ mix((last - first).astype(np.uint64))
    return hashes[place[first]], block, text[first], first - offsets[text[first]] + base, last - first


def _find_blocks(width: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks that are the first of their kind in a piece; the others as marks without a k-gram."""
        for batch in batches:
            raw, offsets = text_bytes(batch.column(3))
            key, doc, copy = (np.asarray(batch.column(k)) for k in range(3))
            for a, b, low, high in _pieces(offsets, PIECE_BYTES, width):
                ends = np.minimum(offsets[a : b + 1], high) - low
                base = low - int(offsets[a])
                ends[0] = 0
                grams, blocks, text, first, count = shard_blocks(raw[low:high], ends, base, width, gram)
                text = text + a
                order = np.lexsort((first, copy[text], doc[text], blocks, grams))
                grams, blocks, text, first, count = (x[order] for x in (grams, blocks, text, first, count))
                again = np.zeros(len(grams), bool)
                again[1:] = (grams[1:] == grams[:-1]) & (blocks[1:] == blocks[:-1])
                gram_column = pa.array(grams.view(np.int64), mask=again)
                doc_column = pa.array(doc[text], mask=copy[text] == 0)  # else it is the key
                columns = [gram_column, longs(blocks.view(np.int64)), longs(key[text]), doc_column, pa.array(copy[text], pa.int32()), longs(first), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, BLOCK_NAMES)

    return find


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks sorted by k-gram, hash and place: repeats become marks, the first ones of a k-gram
    with different blocks stay, and a block alone goes. The last first one waits for its successor."""
    names = BLOCK_NAMES
    held, alone = None, True  # the block before, and whether no other of its k-gram came
    last_block = None

    def out(rows: pa.RecordBatch, marks: bool) -> pa.RecordBatch:
        return rows.set_column(0, pa.field("gram", pa.int64()), pa.nulls(len(rows), pa.int64())) if marks else rows

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.RecordBatch.from_arrays([batch.column(n) for n in names], names)
        gram, block = np.asarray(rows.column("gram")), np.asarray(rows.column("block"))
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])
        if held is not None:
            fresh[0] = gram[0] != held.column("gram")[0].as_py() or block[0] != last_block
        yield out(rows.filter(pa.array(~fresh)), True)
        last_block = int(block[-1])
        firsts = rows.filter(pa.array(fresh))
        if held is not None:
            firsts = pa.Table.from_batches([held, firsts]).combine_chunks().to_batches(max_chunksize=None)[0]
        if not len(firsts):
            continue
        gram = np.asarray(firsts.column("gram"))
        beside = np.zeros(len(gram), bool)
        beside[1:] = gram[1:] == gram[:-1]
        beside[:-1] |= beside[1:]
        if held is not None and not alone:
            beside[0] = False  # it is out already
        alone = (alone or held is None) if len(gram) == 1 else bool(gram[-1] != gram[-2])
        held = firsts.slice(len(gram) - 1)
        yield out(firsts.filter(pa.array(beside)), False)


def shard_transform(symbols: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the strings of a shard: their suffixes in order, and the symbols before them.

    symbols[i] is a symbol (1 or more) or the end of a string (0); string[i] is its string, whose
    symbols stand in order. Ends come first, in the order of the strings.
    """
    n = len(symbols)
    longest = int(np.bincount(string).max(initial=0))
    columns, live = [], np.ones(n, bool)
    for k in range(longest):
        ahead = np.zeros(n, symbols.dtype)
        ahead[: max(0, n - k)] = symbols[k:]
        columns.append(np.where(live, ahead, 0))
        live &= ahead > 0
    order = np.lexsort((string, *columns[::-1]))
    before = np.where(order > 0, symbols[order - 1], 0)
    return order, np.where((order > 0) & (string[order - 1] == string[order]), before, 0)


def merge_transforms(before: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement: for each merged row its shard, and the interval of rows that agree in
    `depth` symbols.

    before[s] has the preceding symbols of shard s in its order, ends[s] the number of its strings.
    """
    shard = np.repeat(np.arange(len(before)), [len(x) for x in before])
    joined = np.concatenate(before)
    end_shard = np.repeat(np.arange(len(before)), ends)
    interval = np.zeros(len(shard), np.int64)
    for _ in range(depth):
        row = np.empty(len(shard), np.int64)
        row[np.argsort(shard, kind="stable")] = np.arange(len(shard))  # each shard gives its rows in order
        symbol = joined[row]
        moved = np.flatnonzero(symbol)
        moved = moved[np.argsort(symbol[moved], kind="stable")]
        symbol, old = symbol[moved], interval[moved]
        new = np.ones(len(shard), bool)  # ends differ from each other
        new[len(end_shard) + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        shard = np.concatenate([end_shard, shard[moved]])
        interval = np.cumsum(new)
    return shard, interval


def equal_windows(blocks: list[bytes], width: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that are equal to others: block, place in the block, interval; by interval."""
    stride = width // 4
    size = np.array([len(b) for b in blocks])
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    sums, at = running_hash(raw), np.cumsum(size) - size
    many = np.maximum(size - stride + 1, 0)
    first = np.repeat(at, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    block = np.repeat(np.arange(len(blocks)), many)
    _, symbol = np.unique(hashes_between(sums, first, first + stride), return_inverse=True)
    place = first - at[block]
    # strings: the places of a block with the same remainder, in order, then an end
    order = np.lexsort((place, place % stride, block))
    block, place, symbol = block[order], place[order], symbol[order] + 1
    name = block * stride + place % stride
    cut = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name))
    symbol, block, place = np.insert(symbol, cut, 0), np.insert(block, cut, block[cut - 1]), np.insert(place, cut, -1)
    string = np.repeat(np.arange(len(cut)), np.diff(np.concatenate([[0], cut])) + 1)
    edges = np.searchsorted(block, np.linspace(0, len(blocks), min(shards, len(blocks)) + 1).astype(np.int64))
    before, ends, rows = [], [], []
    for i, j in zip(edges[:-1], edges[1:]):
        own, symbols = shard_transform(symbol[i:j], string[i:j])
        before.append(symbols)
        ends.append(int((symbol[i:j] == 0).sum()))
        rows.append(own + i)
    shard, interval = merge_transforms(before, ends, 4)
    row = np.empty(len(shard), np.int64)
    row[np.argsort(shard, kind="stable")] = np.concatenate(rows)
    alike = np.zeros(len(row), bool)
    alike[1:] = interval[1:] == interval[:-1]
    alike[:-1] |= alike[1:]
    return block[row[alike]], place[row[alike]], interval[alike]


def _cut_blocks(width: int, gram: int, step: int):
    """Blocks into runs of windows, by the place of the k-gram in them, `step` places together.

    gram becomes a number of these places and of the bytes around the k-gram that all windows with
    them hold: equal windows agree in it. Equal runs of a batch fold into marks without a gram.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, units, wholes, begins, counts, parts = [], [], [], [], [], []
            for k, text in enumerate(batch.column(5).to_pylist()):
                raw = np.frombuffer(text, np.uint8)
                sums = running_hash(raw)
                place, _ = window_grams(raw, sums, width, gram)
                group = (place - np.arange(len(place))) // step
                first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (place[1:] != place[:-1])]))
                last = np.append(first[1:], len(place))
                low, place = group[first] * step, place[first]
                around = hashes_between(sums, place - low, place - np.minimum(low + step - 1, width - gram) + width)
                units.append(mix(around + mix((low * width + step).astype(np.uint64))))
                wholes.append(hashes_between(sums, first, last + width - 1))
                own.append(np.full(len(first), k))
                begins.append(first)
                counts.append(last - first)
                parts += [text[i : j + width - 1] for i, j in zip(first.tolist(), last.tolist())]
            own, units, wholes, begins, counts = (np.concatenate(x) for x in (own, units, wholes, begins, counts))
            key, doc, copy, start = (np.asarray(batch.column(k))[own] for k in range(1, 5))
            start = start + begins
            order = np.lexsort((start, copy, doc, wholes, units))
            units, wholes = units[order], wholes[order]
            again = np.zeros(len(order), bool)
            again[1:] = (units[1:] == units[:-1]) & (wholes[1:] == wholes[:-1])
            columns = [pa.array(units.view(np.int64), mask=again), longs(key[order]), longs(doc[order]), pa.array(copy[order], pa.int32()), longs(start[order]), longs(counts[order])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None if x else parts[i] for i, x in zip(order.tolist(), again.tolist())], pa.binary())], CUT_NAMES)

    return cut


def _large_units(sizes: DataFrame) -> DataFrame | None:
    """Of rows of gram and size, the grams that are too large for a unit."""
    large = written(sizes.groupBy("gram").agg(F.sum("size").alias("size")).where(F.col("size") > UNIT_BYTES).select("gram"), "large")
    return None if large.isEmpty() else F.broadcast(large)


def _merge_units(width: int):
    def marks(rows: list[tuple]) -> pa.RecordBatch:
        gram, key, doc, copy, first, text = (list(x) for x in zip(*rows))
        key, doc, copy, first = (np.array(x, np.int64) for x in (key, doc, copy, first))
        block, place, interval = equal_windows(text, width)
        start = first[block] + place
        order = np.lexsort((start, copy[block], doc[block], interval))
        block, start, interval = block[order], start[order], interval[order]
        later = np.zeros(len(interval), bool)
        later[1:] = interval[1:] == interval[:-1]
        key, start = key[block[later]], start[later]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(key))[: len(head)] - 1
        return pa.RecordBatch.from_arrays([longs(key[head]), longs(start[head]), longs(start[tail] - start[head] + 1)], ["key", "first", "count"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over blocks sorted by k-gram, in units of whole k-grams."""
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= UNIT_BYTES and row[0] != held[-1][0]:
                    yield marks(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield marks(held)

    return merge


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The removed runs of each text, and what is left of it."""
        for batch in batches:
            doc, rows = batch.column(0), []
            for text, marks in zip(batch.column(1), batch.column(2)):
                raw, low, n, kept = text.as_py().encode(), 0, 0, hashlib.sha256()
                runs: list[list[int]] = []
                for first, count in sorted((m["first"], m["count"]) for m in marks.as_py() or []):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], first + count + width - 1)
                    else:
                        runs.append([first, first + count + width - 1])
                for a, b in runs:
                    kept.update(raw[low:a])
                    low, n = b, n + b - a
                kept.update(raw[low:])
                rows.append((len(raw), n, runs, kept.hexdigest()))
            size, gone, runs, sha = zip(*rows) if rows else ((), (), (), ())
            spans = pa.array([[{"begin": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([doc, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), spans, pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return cut


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (bytes [begin, end)), kept_sha256.

    Null and empty texts have no bytes. Rows with the same id come in the order of their texts,
    null ids, and with them the id -2^63, before all others. Texts shorter than width are kept; matches never cross documents.
    width must be a multiple of 4. Strings are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts_for(size, PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    same_id = Window.partitionBy("doc_id").orderBy("text")
    rows = docs.repartition(buckets, "doc_id").withColumn("copy", F.row_number().over(same_id) - 1)
    key = F.when(F.col("copy") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "copy"))
    name = f"texts_{uuid.uuid4().hex}"
    rows.select(key.alias("key"), "doc_id", "copy", "text").write.option("path", scratch_path(spark, "texts")).option("compression", "zstd").bucketBy(buckets, "key").saveAsTable(name)
    texts = spark.table(name)
    del rows
    free_shuffles(spark)

    found = texts.select("key", "doc_id", "copy", "text").mapInArrow(_find_blocks(width, min(GRAM, width)), BLOCKS)
    dealt = F.coalesce("gram", F.xxhash64("key", "first"))
    marked = found.repartition(buckets, dealt)
    marked = marked.sortWithinPartitions(F.col("gram").asc_nulls_last(), "block", F.coalesce("doc_id", "key"), "copy", "first").mapInArrow(_fold_sorted, BLOCKS)
    marked = written(marked.select("gram", "key", "first", "count"), "blocks")
    del found
    free_shuffles(spark)

    wanted = marked.where("gram is not null").select("gram", "key", "first", "count")
    marks = [marked.where("gram is null").select("key", "first", F.col("count").cast("long").alias("count"))]

    def fetched(blocks: DataFrame) -> DataFrame:
        return blocks.join(texts, "key").select("gram", "key", "doc_id", "copy", "first", F.substr(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), F.col("count") + width - 1).alias("bytes"))

    large = _large_units(wanted.select("gram", (F.col("count") + width - 1).alias("size")))
    if large is None:
        units = fetched(wanted)
    else:
        units, blocks = fetched(wanted.join(large, "gram", "left_anti")), fetched(wanted.join(large, "gram", "left_semi"))
        for step in STEPS:
            cuts = written(blocks.mapInArrow(_cut_blocks(width, min(GRAM, width), step), CUTS), "cuts")
            marks.append(cuts.where("gram is null").select("key", "first", "count"))
            cuts = cuts.where("gram is not null").select("gram", "key", "doc_id", "copy", "first", "bytes")
            if step == 1:  # the windows of a unit are equal
                place = F.row_number().over(Window.partitionBy("gram").orderBy("doc_id", "copy", "first"))
                marks.append(cuts.drop("bytes").withColumn("place", place).where("place > 1").select("key", "first", F.lit(1).cast("long").alias("count")))
                break
            large = _large_units(cuts.select("gram", F.octet_length("bytes").alias("size")))
            if large is None:
                units = units.unionByName(cuts)
                break
            units, blocks = units.unionByName(cuts.join(large, "gram", "left_anti")), cuts.join(large, "gram", "left_semi")

    marks.append(units.repartition(buckets, "gram").sortWithinPartitions("gram").mapInArrow(_merge_units(width), "key long, first long, count long"))
    marks = functools.reduce(DataFrame.unionByName, marks)
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("first", "count")).alias("marks"))
    cut = texts.join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(
        _cut(width), "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept_sha256 string"
    )
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks pass; the sorted blocks before them are folded."""

    def blocks() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch) - batch.column(0).null_count
            if n < len(batch):
                passed.append(batch.slice(n))
            if n:
                yield batch.slice(0, n)

    passed: list[pa.RecordBatch] = []
    for out in _fold_blocks(blocks()):
        yield out
        while passed:
            yield passed.pop()
    while passed:
        yield passed.pop()


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
