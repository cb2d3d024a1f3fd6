"""Benchmark decontamination with one FM-index per shard of documents.

Test phrases are all windows of WINDOW consecutive words of an item; a shorter item is one phrase.
Each task cuts its documents into shards of about SHARD_BYTES. The words of a shard become
symbols: the number of the word among the words of the phrases, or a separator. Over the suffix
order of the symbols a shard has a Burrows-Wheeler transform in a wavelet matrix. Every phrase is
searched backward by ranks; the rows that remain are located by walking to sampled suffix
positions, and the places are merged into spans of words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.llm.byte_words import LOWER, byte_class, ragged, span_hashes, spans
from hitledger.llm.common import longs, parts_for, ship, text_bytes, texts_of, written

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16

WORD_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPAN = "struct<first:long,last:long,begin:long,end:long>"
FOUND = f"row_id long, doc_id long, n_words long, spans array<{SPAN}>, item_ids array<string>"


class Words:
    """Numbers from 1 for known word hashes, 0 for any other: a table with linear probing."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.unique(hashes)
        self.size = 1 << max(10, int(len(self.known) * 8).bit_length())
        self.slots = np.zeros(self.size, np.int32)
        at, left = (self.known & np.uint64(self.size - 1)).astype(np.int64), np.arange(1, len(self.known) + 1)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) % self.size, left[lost]
        self.hashes = np.concatenate([np.zeros(1, np.uint64), self.known])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        out = self.slots[at]
        left = np.flatnonzero((out > 0) & (self.hashes[out] != hashes))
        while len(left):
            at[left] = (at[left] + 1) % self.size
            out[left] = self.slots[at[left]]
            left = left[(out[left] > 0) & (self.hashes[out[left]] != hashes[left])]
        return out


class Phrases:
    """The distinct phrases of some items as rows of word numbers, and the items of each phrase."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        names, self.items = np.unique([i for i, _ in items] or [""], return_inverse=True)
        self.names = [str(x) for x in names]
        texts = [t.encode() for _, t in items]
        raw = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.cumsum([0, *map(len, texts)])
        starts, ends, first = spans(raw, offsets, WORD_BYTES)
        hashes = span_hashes(raw, starts, ends)
        self.words = Words(hashes)
        numbers, n = self.words.numbers(hashes), np.diff(first)
        length = np.minimum(n, window)
        many = np.where(n > 0, n - length + 1, 0)
        begin = ragged(first[:-1], many)
        size = np.repeat(length, many)
        column = np.arange(window)
        inside = column < size[:, None]
        table = np.where(inside, numbers[np.minimum(begin[:, None] + column, max(0, len(numbers) - 1))], 0) if len(begin) else np.zeros((0, window), np.int32)
        self.table, of = np.unique(table, axis=0, return_inverse=True)
        self.length = (self.table > 0).sum(1)
        item = np.repeat(self.items[: len(n)], many)
        pairs = np.unique(np.stack([of.reshape(-1), item]), axis=1) if len(begin) else np.zeros((2, 0), np.int64)
        self.item_of = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(self.table) + 1))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. Separators (0) are the smallest symbols and differ by their position.

    Packed first symbols are sorted once; suffixes that agree in them are told apart by the ranks of
    what follows, over twice the length each time.
    """
    n = len(symbols)
    place, bits = max(1, n.bit_length()), max(1, int(symbols.max(initial=0)).bit_length())
    reach = max(1, (64 - place) // bits)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for step in range(reach):  # nothing counts after the first separator
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - step)] = symbols[step:]
        key = (key << np.uint64(bits)) | np.where(open_, ahead, np.uint64(0))
        open_ &= ahead > 0
    key = np.sort((key << np.uint64(place)) | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~open_[order[1:]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    while True:
        alike = ~new
        alike[:-1] |= ~new[1:]
        rows = np.flatnonzero(alike)
        if not len(rows):
            return order
        left = order[rows]
        after = rank[np.minimum(left + reach, n - 1)]
        sort = np.lexsort((after, head[rows]))
        order[rows] = left[sort]
        after, group = after[sort], head[rows]
        new[rows[1:]] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[rows] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        rank[order[rows]] = head[rows]
        reach *= 2


class BitVector:
    """Bits with the number of ones before each 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    """Backward search and locating over a sequence of symbols that ends with a separator."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=(1 << self.bits)))])
        kept = (order % SAMPLE == 0) | (bwt == 0)  # the walk ends before any separator
        self.sampled, self.positions = BitVector(kept), order[kept]
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (bwt >> level) & 1 > 0
            self.levels.append(BitVector(one))
            self.zeros.append(int(len(one) - one.sum()))
            bwt = np.concatenate([bwt[~one], bwt[one]])

    def _down(self, level: int, one: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self.levels[level].rank(at)
        return np.where(one, self.zeros[level] + ones, at - ones)

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows go that come after as many of this symbol as there are before row `at`."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 > 0
            low, at = self._down(level, one, low), self._down(level, one, at)
        return self.first[symbol] + at - low

    def search(self, table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and their first and last row (exclusive)."""
        live = np.flatnonzero(table[np.arange(len(table)), length - 1] < len(self.first) - 1)
        symbol = table[live, length[live] - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        step = 1
        while True:
            stay = low < high
            live, low, high = live[stay], low[stay], high[stay]
            more = length[live] > step
            if not more.any():
                return live, low, high
            symbol = table[live, np.maximum(length[live] - 1 - step, 0)]
            known = symbol < len(self.first) - 1
            symbol = np.where(known, symbol, 0)
            both = self.before(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low = np.where(more, np.where(known, both[: len(live)], 0), low)
            high = np.where(more, np.where(known, both[len(live) :], 0), high)
            step += 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes in these rows."""
        rows = rows.copy()
        steps, out = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            known = self.sampled.bit(at)
            done = left[known]
            out[done] = self.positions[self.sampled.rank(at[known])] + steps[done]
            left, at = left[~known], at[~known]
            symbol, down = np.zeros(len(at), np.int64), at
            for level in range(self.bits):
                one = self.levels[level].bit(down)
                symbol = symbol * 2 + one
                down = self._down(level, one, down)
            rows[left] = self.before(symbol, at)
            steps[left] += 1
        return out


def _search_shard(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Words of each text, spans with the text they lie in, and pairs of text and item."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets, WORD_BYTES)
    counts = np.diff(first)
    symbols = phrases.words.numbers(span_hashes(raw, starts, ends)).astype(np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    # runs of known words, each followed by one separator
    known = np.flatnonzero(symbols)
    if not len(known):
        return counts, starts, ends, np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero((np.diff(known) > 1) | (np.diff(text_of[known]) > 0)) + 1
    word_of = np.append(np.insert(known, breaks, -1), -1)
    index = FMIndex(np.where(word_of < 0, 0, symbols[word_of]))
    phrase, low, high = index.search(phrases.table, phrases.length)
    many = high - low
    at = word_of[index.locate(ragged(low, many))]
    phrase = np.repeat(phrase, many)
    items = phrases.item_at[phrase + 1] - phrases.item_at[phrase]
    pairs = np.stack([np.repeat(text_of[at], items), phrases.item_of[ragged(phrases.item_at[phrase], items)]], 1)
    pairs = np.unique(pairs, axis=0)
    # merge: a span begins where no earlier one of the text reaches
    sort = np.argsort(at, kind="stable")
    begin, last = at[sort], at[sort] + phrases.length[phrase[sort]]
    reach = np.maximum.accumulate(last) if len(last) else last
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > reach[:-1]) | (text_of[begin[1:]] != text_of[begin[:-1]])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(begin))[: len(heads)] - 1
    merged = np.stack([text_of[begin[heads]], begin[heads], reach[tails]], 1) if len(heads) else np.zeros((0, 3), np.int64)
    return counts, starts, ends, merged, pairs


def _list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _searcher(broadcast, shard_bytes: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = broadcast.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + shard_bytes, "right")) - 1)
                own = offsets[a : b + 1] - offsets[a]
                counts, starts, ends, merged, pairs = _search_shard(raw[offsets[a] : offsets[b]], own, phrases)
                text, first, last = merged.T
                word_0 = (np.cumsum(counts) - counts)[text]
                values = [first - word_0, last - word_0, starts[first] - own[text], ends[last - 1] - own[text]]
                found = pa.StructArray.from_arrays([longs(x) for x in values], ["first", "last", "begin", "end"])
                names = pa.array([phrases.names[i] for i in pairs[:, 1]], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        longs(counts),
                        _list(found, np.bincount(text, minlength=b - a)),
                        _list(names, np.bincount(pairs[:, 0], minlength=b - a)),
                    ],
                    ["row_id", "doc_id", "n_words", "spans", "item_ids"],
                )
                a = b

    return search


def _merged(spans: Column) -> Column:
    """Spans that touch or overlap as one, in order."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
            last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as array<{SPAN}>)"), add)


def _phrase_builder(window: int):
    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [pair for batch in batches for pair in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist())]
        made = pickle.dumps(Phrases(items, window), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([made], pa.binary())], ["block", "phrases"])

    return build


class PhraseBlocks:
    """The phrases of all items in blocks of items with about block_bytes of text, built in tasks and
    written. The driver holds one block at a time, to broadcast it."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
        self.context, self.window = benchmark.sparkSession.sparkContext, window
        ship(benchmark.sparkSession)
        items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        block = F.pmod(F.xxhash64("item", "t"), F.lit(parts_for(2 * size, block_bytes) if size > block_bytes else 1)).cast("int")
        made = items.withColumn("block", block).groupBy("block").applyInArrow(_phrase_builder(window), "block int, phrases binary")
        self.made = written(made, "phrases")
        self.numbers = [row.block for row in self.made.select("block").orderBy("block").collect()]

    def __len__(self) -> int:
        return max(1, len(self.numbers))

    def __iter__(self) -> Iterator[Broadcast]:
        for number in self.numbers:
            row = self.made.where(F.col("block") == number).select("phrases").first()
            yield self.context.broadcast(pickle.loads(row.phrases))
        if not self.numbers:
            yield self.context.broadcast(Phrases([], self.window))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans, item_ids, n_hit.

    A span has the numbers of its first word and of the word after its last, and its bytes
    [begin, end) in the UTF-8 text. item_ids are distinct, as strings. Null or empty texts have no
    words; items without words have no phrase; repeated items count once; a null item id is ''.
    A document longer than a shard is a shard of its own. Words are told apart by 64-bit hashes.

    Phrases are broadcast in blocks of about block_bytes of item text, one after the other, so that a
    benchmark of any size fits; each block is one pass over the documents.
    """
    rows = texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    blocks = PhraseBlocks(benchmark, item_col, item_text_col, window, block_bytes)
    if len(blocks) == 1:
        merged = rows.mapInArrow(_searcher(next(iter(blocks)), shard_bytes), FOUND)
    else:
        rows = written(rows, "rows")  # all passes number them alike
        found = []
        for block in blocks:
            found.append(written(rows.mapInArrow(_searcher(block, shard_bytes), FOUND), "found"))
            block.unpersist()
        each = reduce(DataFrame.unionByName, found).groupBy("row_id")
        merged = each.agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return merged.select("doc_id", "n_words", "spans", "item_ids", n_hit.alias("n_hit"))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs without any phrase, with all their columns, without a shuffle."""

    def keep_clean(block):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = text_bytes(pc.fill_null(batch.column(text_col), ""))
                a = 0
                while a < len(batch):
                    b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + shard_bytes, "right")) - 1)
                    *_, merged, _ = _search_shard(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], block.value)
                    yield batch.slice(a, b - a).filter(pa.array(np.bincount(merged[:, 0], minlength=b - a) == 0))
                    a = b

        return keep

    ship(docs.sparkSession)
    blocks = PhraseBlocks(benchmark, item_col, item_text_col, window, block_bytes)
    for block in blocks:
        docs = docs.mapInArrow(keep_clean(block), docs.schema)
        if len(blocks) > 1:
            docs = written(docs, "clean")
            block.unpersist()
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The report of one row per document, with the items as one digest."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
