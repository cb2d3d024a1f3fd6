"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes its links make.

The shingles of a document are put into one global order, rare ones first, by a fixed-size table
of counts over all documents. Of two sets with a Jaccard similarity of at least t, the first
n - ceil(t n) + l tokens of each share at least l tokens. Each document chooses l by the
estimated cost of its candidates: a longer prefix costs more list entries but asks for more shared
tokens, which leaves fewer candidates to verify. A pair needs the smaller of its two numbers.

Equal sets are one set from the start. Candidates are not all pairs of a list: first every list
links its members to a few leaders; pairs that verify make classes; then the lists give only pairs
between different classes, which are counted, filtered and verified. So copies cost linear work,
and no link between different classes is lost. For its leaders a set shows in the lists of a fixed
number of its tokens, the smallest by a hash, which copies have in common; for the pairs between
classes it shows in all lists where sizes leave it a partner.

Each set has a row of bits, the parities of how many of its tokens fall into each cell. Where two rows
differ, at least one token is in one set alone; so pairs whose rows differ too much go before they are
listed, although they share a passage and with it many tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitledger.llm.byte_words import LOWER, byte_class, mix, span_hashes, spans
from hitledger.llm.common import longs, parts_for, text_bytes, texts_of, written
from hitledger.llm.components import components
from hitledger.operators.positions import free_name

SHINGLE = 5
PERCENT = 75
MOST_MATCHES = 6
LEADERS = 3
LED_TOKENS = 16  # of a set, by which it meets leaders
LIKELY = 16  # a likely pair shares one prefix token for so many of the smaller set
VERIFY_ROWS = 1024
VERIFY_COST = 30.0  # of a candidate, in list entries
CELL_BITS = (16, 24)
SKETCH_HASHES = 1 << 20
BLOCK_CELLS = 1 << 16
POSTINGS = 1 << 20  # of a partition
BATCH_BYTES = 1 << 20
PAIR_BLOCK = 1 << 20
LIST_BLOCK = 1 << 16
PARITY_BITS = (256, 4096)

WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
CELLS = "block int, hit binary, counts binary"
PLACED = ("token", "sig", "class", "n", "degree", "beyond", "last", "matches", "parity")
SETS = "sig long, doc_id long, n long, matches int, last long, parity binary, tokens array<long>"


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle, in order and with repeats, and the number of the first of each text."""
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets, WORD_BYTES)
    words, n = span_hashes(raw, starts, ends), np.diff(first)
    many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = np.cumsum(many) - many
    begin = np.arange(int(many.sum())) + np.repeat(first[:-1] - at, many)
    length = np.repeat(np.minimum(n, shingle), many)
    out = length.astype(np.uint64)
    for k in range(shingle):
        inside = k < length
        word = words[np.minimum(begin + k, len(words) - 1)] if len(words) else out
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
    return out, np.append(at, int(many.sum()))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of a batch in blocks: first and last row, bytes, offsets."""
    raw, offsets = text_bytes(batch.column(column))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _counted(batches_of_hashes: Iterator[np.ndarray], cells: int) -> Iterator[pa.RecordBatch]:
    """How often cells are hit, for every SKETCH_HASHES hashes: by blocks, the cells and their counts."""
    held, size = [], 0

    def blocks() -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(held) & np.uint64(cells - 1), return_counts=True)
        block, hit = (at // np.uint64(BLOCK_CELLS)).astype(np.int64), (at % np.uint64(BLOCK_CELLS)).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for i, j in zip(starts, np.append(starts[1:], len(at))):
            few = n[i:j].astype(np.uint8 if n[i:j].max() < 256 else np.uint32)
            columns = [pa.array([block[i]], pa.int32()), pa.array([hit[i:j].tobytes()], pa.binary()), pa.array([few.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "hit", "counts"])

    for hashes in batches_of_hashes:
        held.append(hashes)
        size += len(hashes)
        if size >= SKETCH_HASHES:
            yield from blocks()
            held, size = [], 0
    if size:
        yield from blocks()


def _levels(mean: float):
    def levels(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """1 for cells that are hit, and more by how far their sum lies over the mean, in quarters of a
        power of two; 0 for others."""
        total = np.zeros(BLOCK_CELLS, np.uint64)
        for batch in batches:
            for hit, n in zip(batch.column("hit"), batch.column("counts")):
                hit, n = np.frombuffer(hit.as_py(), np.uint16), n.as_py()
                total[hit] += np.frombuffer(n, np.uint8 if len(n) == len(hit) else np.uint32)
        level = np.clip(4 * np.log2(np.maximum(total / mean, 1.0)), 0, 63) + (total > 0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.astype(np.uint8), 1)], pa.binary())], ["block", "levels"])

    return levels


class CellTable:
    """One byte for each of a fixed number of cells, kept compressed until it is read."""

    def __init__(self, per_task: DataFrame, cells: int, mean: float):
        blocks = {r.block: r.levels for r in per_task.groupBy("block").applyInArrow(_levels(mean), "block int, levels binary").toLocalIterator()}
        empty = zlib.compress(bytes(BLOCK_CELLS), 1)
        self.blocks = [blocks.get(k, empty) for k in range(cells // BLOCK_CELLS)]

    def read(self) -> np.ndarray:
        return np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in self.blocks])


def frequency_levels(docs: DataFrame, shingle: int, cells: int, mean: float) -> CellTable:
    """For each cell, how far the count of its shingles lies over about the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = (shingle_hashes(raw, offsets, shingle)[0] for batch in batches for _, _, raw, offsets in _blocks(batch, 0))
        return _counted(hashes, cells)

    return CellTable(docs.select("text").mapInArrow(count, CELLS), cells, mean)


def _least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def prefix_matches(levels: np.ndarray, mean: float, percent: int) -> int:
    """The l that costs least for a set whose tokens, in order, have these levels."""
    n = len(levels)
    base = n - _least_overlap(n, percent)
    most = min(MOST_MATCHES, _least_overlap(n, percent))
    if levels[base + most - 1] == 0:  # none of them is frequent
        return 1
    entries = np.cumsum((2.0 ** (levels[: base + most] / 4) - 1) * mean)[base:]
    matches = np.arange(1, most + 1)
    return int(np.argmin(entries * (1 + VERIFY_COST / matches))) + 1


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in order, one text after the other, and where each begins."""
    own = [np.unique(hashes[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
    size = np.array([len(x) for x in own], np.int64)
    return np.concatenate([*own, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])


def set_numbers(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set of tokens, whatever their levels: equal sets have equal numbers."""
    size = np.diff(first)
    spread = mix((tokens & np.uint64((1 << 58) - 1)) + np.repeat(size, size).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
    return mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64)).view(np.int64)


def parity_row(tokens: np.ndarray) -> bytes:
    """For each of some cells, a power of two of about four a token, whether it holds an odd number of tokens."""
    cells = 1 << min(max((4 * len(tokens) - 1).bit_length(), PARITY_BITS[0].bit_length() - 1), PARITY_BITS[1].bit_length() - 1)
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parity rows of sets. A row is folded to half its cells by adding up its halves modulo 2."""

    STEP = 1 << 11  # pairs compared at once

    def __init__(self, column: pa.Array):
        self.raw, offsets = text_bytes(column)
        self.starts, self.width = offsets[:-1], np.diff(offsets)

    def _rows(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(at), width), np.uint8)
        own = self.width[at]
        for fold in range(int(own.max(initial=0)) // width):
            more = np.flatnonzero(own > fold * width)
            out[more] ^= self.raw[self.starts[at[more]][:, None] + (fold * width + np.arange(width))]
        return out.view(np.uint64)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many tokens at least are in one of the sets x[i] and y[i] alone."""
        out = np.zeros(len(x), np.int64)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            for i in range(0, len(rows), self.STEP):
                part = rows[i : i + self.STEP]
                out[part] = np.bitwise_count(self._rows(x[part], w) ^ self._rows(y[part], w)).sum(1, dtype=np.int64)
        return out


def _sets(broadcast, mean: float, shingle: int, percent: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = broadcast.value.read()
        np.subtract(table, 1, out=table, where=table > 0)
        seen: set[int] = set()
        for batch in batches:
            for a, b, raw, offsets in _blocks(batch, 1):
                hashes, first = shingle_hashes(raw, offsets, shingle)
                level = table[(hashes & np.uint64(len(table) - 1)).astype(np.int64)]
                tokens, first = distinct_sets((level.astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6)), first)
                sigs, sizes, levels = set_numbers(tokens, first), np.diff(first), (tokens >> np.uint64(58)).astype(np.float64)
                matches, prefixes, last, parity = [], [], [], []
                for sig, i, n in zip(sigs.tolist(), first.tolist(), sizes.tolist()):
                    if n and sig not in seen:
                        seen.add(sig)
                        l = prefix_matches(levels[i : i + n], mean, percent)
                        matches.append(l)
                        prefixes.append(tokens[i : i + n - _least_overlap(n, percent) + l].view(np.int64))
                        last.append(int(prefixes[-1][-1]) ^ -(2**63))  # ascends like the tokens
                        parity.append(parity_row(tokens[i : i + n]))
                    else:
                        for column in (matches, prefixes, last, parity):
                            column.append(None)
                columns = [longs(sigs), batch.column(0).slice(a, b - a), longs(sizes), pa.array(matches, pa.int32()), pa.array(last, pa.int64()), pa.array(parity, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "doc_id", "n", "matches", "last", "parity", "tokens"])

    return make


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by token: members of a list with its first ones.

    The second member meets one, and with each doubling of the list one more, up to LEADERS. So the
    pairs of a list grow with its length, and members that one leader misses have others.
    """
    head, seen = np.zeros((2, 0), np.int64), 0  # first entries of the last list, and its length so far
    for batch in batches:
        if not len(batch):
            continue
        t, s = (np.concatenate([head[k], np.asarray(batch.column(k))]) for k in (0, 1))
        old, at = head.shape[1], np.arange(len(t))
        new = np.concatenate([[True], t[1:] != t[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = at - start + np.where((start == 0) & (at >= old), seen - old, 0)
        leaders = np.minimum(LEADERS, np.frexp(rank.astype(np.float64))[1])  # 0 for the first, 1, 2, 2, 3, ...
        found = []
        for j in range(LEADERS):
            more = (leaders > j) & (at >= old)
            found.append(np.stack([s[start[more] + j], s[more]]))
        found = np.sort(np.concatenate(found, 1), 0)
        found = found[:, found[0] != found[1]]
        pairs, n = np.unique(found, axis=1, return_counts=True) if found.shape[1] else (found, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([longs(pairs[0]), longs(pairs[1]), longs(n)], ["a", "b", "n_shared"])
        first = int(start[-1])
        head, seen = np.stack([t[first : first + LEADERS], s[first : first + LEADERS]]), int(rank[-1]) + 1


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over entries sorted by token and set: those of tokens that two sets have, each once."""
    token, sig, waiting = None, None, False  # the entry before, and whether it waits for a second

    for batch in batches:
        t, s = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if token is not None and len(t):
            t, s = np.append(token, t), np.append(sig, s)
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[fresh], s[fresh]
        if not len(t):
            continue
        out = np.zeros(len(t), bool)
        out[1:] = t[1:] == t[:-1]
        out[:-1] |= out[1:]
        if token is not None and not waiting:
            out[0] = False  # it is out already
        waiting = not (len(t) > 1 and t[-1] == t[-2]) and (len(t) > 1 or token is None or waiting)
        token, sig = t[-1], s[-1]
        yield pa.RecordBatch.from_arrays([longs(t[out]), longs(s[out])], ["token", "sig"])


def _pairs_of_list(n: np.ndarray, c: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs from different classes whose sizes fit, a block of members at a time."""
    order = np.argsort(n, kind="stable")
    n, c = n[order], c[order]
    top = np.searchsorted(n, n * 100 // percent, "right")  # past the largest size that can be similar
    step = max(1, PAIR_BLOCK // len(n))
    for i in range(0, len(n), step):
        rows = np.arange(i, min(i + step, len(n)))
        cols = np.arange(i, int(top[rows].max()))
        fit = (cols > rows[:, None]) & (cols < top[rows][:, None]) & (c[rows][:, None] != c[cols])
        x, y = np.nonzero(fit)
        yield order[rows[x]], order[cols[y]]


def _whole_lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by token, in blocks that cut no list."""

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(k) for x in held]) for k in names], list(names))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if held[0].column("token")[0] == held[-1].column("token")[-1] or size < LIST_BLOCK:  # one list so far, or few entries
            continue
        rows = joined()
        token = np.asarray(rows.column("token"))
        head = int(np.flatnonzero(token != token[-1])[-1]) + 1
        yield rows.slice(0, head)
        held, size = [rows.slice(head)], size - head
    if held:
        yield joined()


def _mixed(percent: int):
    """The entries with a member of another class in their list that is not too small or too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches, ("token", "sig", "class", "n")):
            rows = rows.take(pa.array(np.lexsort([np.asarray(rows.column(k)) for k in ("n", "token")])))
            t, c, n = (np.asarray(rows.column(k)) for k in ("token", "class", "n"))
            list_starts = np.concatenate([[True], t[1:] != t[:-1]])
            starts = np.flatnonzero(list_starts | np.concatenate([[True], c[1:] != c[:-1]]))  # runs of one class
            size = np.diff(np.append(starts, len(t)))
            # the nearest sizes of other classes are those just before and just after a run
            below = np.where(list_starts[starts], 0, n[starts - 1])
            after = np.append(starts[1:], 0)
            above = np.where(list_starts[after], 0, n[after])
            below, above = np.repeat(below, size), np.repeat(above, size)
            yield rows.filter(pa.array((100 * below >= percent * n) | (100 * n >= percent * above) & (above > 0))).select(["token", "sig", "class"])

    return run


def _between(percent: int):
    """Pairs of each list from different classes that can share enough.

    A set shares no more than its degree, the number of its prefix tokens that other classes have.
    A pair needs the smaller of its two numbers, so a set leaves a list only if its degree is below
    the smallest number in that list. Of what is left, pairs go whose parities differ in more cells
    than sets with enough in common can.
    """

    def possible(rows: dict[str, np.ndarray], parities: Parities, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = {k: (v[x], v[y]) for k, v in rows.items()}
        shared, (n_x, n_y) = np.minimum(*n["degree"]), n["n"]
        beyond = np.where(n["last"][0] <= n["last"][1], *n["beyond"])
        overlap = -(-(n_x + n_y) * percent // (100 + percent))
        fits = 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
        keep = np.flatnonzero(fits & (shared + beyond >= overlap) & (shared >= np.minimum(*n["matches"])))
        keep = keep[parities.apart(x[keep], y[keep]) <= (n_x + n_y - 2 * overlap)[keep]]
        return np.sort(np.stack([n["sig"][0][keep], n["sig"][1][keep]]), 0)

    def pairs(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = {k: np.asarray(whole.column(k)) for k in PLACED[:-1]}
        t = rows["token"]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        least = np.repeat(np.minimum.reduceat(rows["matches"], starts), np.diff(np.append(starts, len(t))))
        keep = rows["degree"] >= least
        if not keep.any():
            return
        rows = {k: v[keep] for k, v in rows.items()}
        parities = Parities(whole.column("parity").filter(pa.array(keep)))
        t, c = rows["token"], rows["class"]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
        size = np.diff(np.append(starts, len(t)))
        two = starts[mixed & (size == 2)]
        found = [possible(rows, parities, two, two + 1)]
        held = found[0].shape[1]
        for i, k in zip(starts[mixed & (size > 2)], size[mixed & (size > 2)]):
            for x, y in _pairs_of_list(rows["n"][i : i + k], c[i : i + k], percent):
                found.append(possible(rows, parities, i + x, i + y))
                held += found[-1].shape[1]
                if held > PAIR_BLOCK:
                    yield counted(found)
                    found, held = [], 0
        if held:
            yield counted(found)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, 1)
        both = both[:, np.lexsort((both[1], both[0]))]
        new = np.flatnonzero(np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)]))
        n = np.diff(np.append(new, both.shape[1]))
        return pa.RecordBatch.from_arrays([longs(both[0][new]), longs(both[1][new]), longs(n)], ["a", "b", "n_shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches, PLACED):
            yield from pairs(rows)

    return run


def _verifier(shingle: int, percent: int):
    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, firsts, done = [], [np.zeros(1, np.int64)], 0
        for _, _, raw, offsets in _blocks(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
            tokens, first = distinct_sets(*shingle_hashes(raw, offsets, shingle))
            parts.append(tokens)
            firsts.append(first[1:] + done)
            done += len(tokens)
        return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(firsts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, VERIFY_ROWS) for x in batches for i in range(0, len(x), VERIFY_ROWS)):
            a, b = np.asarray(batch.column(0)), batch.column(1)
            new = np.concatenate([[True], a[1:] != a[:-1]])  # rows are sorted by a
            left, left_first = sets(batch.column(2).filter(pa.array(new)))
            right, right_first = sets(batch.column(3))
            keep = []
            for k, of in enumerate((np.cumsum(new) - 1).tolist()):
                x, y = left[left_first[of] : left_first[of + 1]], right[right_first[k] : right_first[k + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _links(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set numbers that are similar, from whole texts."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    many = pairs.count()
    if not many:
        return pairs
    cells = 1 << min(24, max(20, (64 * many).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted((mix(np.asarray(c).view(np.uint64)) for batch in batches for c in batch.columns), cells)

    wanted = spark.sparkContext.broadcast(CellTable(pairs.select("a", "b").mapInArrow(count, CELLS), cells, 1.0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = wanted.value.read() > 0, set()
        for batch in batches:
            for i, _, raw, offsets in _blocks(batch, 0):
                hashes, first = shingle_hashes(raw, offsets, shingle)
                numbers = set_numbers(*distinct_sets(hashes >> np.uint64(6), first))
                at = (mix(numbers.view(np.uint64)) & np.uint64(cells - 1)).astype(np.int64)
                rows, sigs = [], []
                for k in np.flatnonzero(marked[at]):
                    sig = int(numbers[k])
                    if sig not in seen:
                        seen.add(sig)
                        rows.append(i + k)
                        sigs.append(sig)
                yield pa.RecordBatch.from_arrays([longs(np.array(sigs)), batch.column(0).take(pa.array(rows, pa.int64()))], ["sig", "text"])

    texts = docs.select("text").mapInArrow(pick, "sig long, text string").groupBy("sig").agg(F.min("text").alias("text"))
    texts = written(texts, "texts")  # of sets in pairs alone, but for chance
    one = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return written(both.mapInArrow(_verifier(shingle, percent), "a long, b long"), "links")


def leading(listed: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """sig, n and degree, the number of lists, of the sets that can be in a likely pair.

    Such a pair shares a LIKELYth of its smaller set, which has `percent` of the larger one at least.
    """
    degrees = listed.groupBy("sig").agg(F.count("*").alias("degree")).join(about.select("sig", "n"), "sig")
    return degrees.where(100 * LIKELY * F.col("degree") >= percent * F.col("n"))


def led_entries(listed: DataFrame, degrees: DataFrame) -> DataFrame:
    """token, sig, degree: of each set the LED_TOKENS tokens that are the smallest by a hash.

    Sets with most of their prefixes in common have most of these in common as well. The member with
    the most shared tokens leads a list: an original is closer to its copies than they to each other.
    """
    smallest = F.row_number().over(Window.partitionBy("sig").orderBy(F.xxhash64("token"), "token"))
    entries = listed.join(degrees, "sig").withColumn("place", smallest)
    return entries.where(F.col("place") <= LED_TOKENS).select("token", "sig", "degree")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct shingles of
    the whole text; sets link when 100 * shared >= percent * united. component_id is the smallest
    id that links reach. Fewer words than a shingle are one shingle; null and empty texts have no
    set and are alone. Rows with equal sets are linked, repeated rows and null ids included; a
    class of null ids alone has a null component. Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << min(CELL_BITS[1], max(CELL_BITS[0], (size // 16).bit_length()))
    mean = max(1.0, size / 6 / cells)  # about one shingle in six bytes
    levels = frequency_levels(docs, shingle, cells, mean)
    table = spark.sparkContext.broadcast(levels)
    sets = written(docs.mapInArrow(_sets(table, mean, shingle, percent), SETS), "sets")

    entries = sets.where(F.col("tokens").isNotNull()).select(F.explode("tokens").alias("token"), "sig")
    n_parts = parts_for(size // 24, POSTINGS, 8)  # about one shingle in six bytes, a quarter of them in prefixes
    listed = entries.repartition(n_parts, "token").sortWithinPartitions("token", "sig")
    listed = written(listed.mapInArrow(_lists, "token long, sig long"), "lists")
    about = written(sets.where("tokens is not null").groupBy("sig").agg(F.max("n").alias("n"), F.max("matches").alias("matches"), F.max("last").alias("last"), F.max("parity").alias("parity")), "about")
    degrees = written(leading(listed, about, percent), "degrees")
    led = led_entries(listed, degrees).repartition(n_parts, "token").sortWithinPartitions("token", F.desc("degree"), "sig")
    stars = led.select("token", "sig").mapInArrow(_stars, "a long, b long, n_shared long").groupBy("a", "b").agg(F.sum("n_shared").alias("n_shared"))

    def sized(pairs: DataFrame, known: DataFrame, *names: str) -> DataFrame:
        """Pairs whose sizes do not exclude each other, with what is known of both sets."""
        for side in ("a", "b"):
            own = [F.col(c).alias(f"{c}_{side}") for c in ("n", *names)]
            pairs = pairs.join(known.select(F.col("sig").alias(side), *own), side)
        return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough of their prefixes.

        Of the set whose prefix ends first, the tokens after that end are all that can be shared
        besides those in both prefixes. Together they must reach the overlap that these sizes need.
        """
        overlap = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent) - 1e-9)
        n, l = (F.when(F.col("last_a") <= F.col("last_b"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")) for c in ("n", "matches"))
        beyond = F.ceil(n * percent / 100 - 1e-9) - l
        return sized(pairs, about, "matches", "last").where((F.col("n_shared") >= F.least("matches_a", "matches_b")) & (F.col("n_shared") + beyond >= overlap))

    # members that share some of their prefix with a leader of its lists: nearly all copies
    share = F.greatest("degree_a", "degree_b", F.lit(LED_TOKENS)) / LED_TOKENS  # of the prefix, by its part that met
    likely = sized(stars, degrees, "degree").where(F.col("n_shared") * share * LIKELY >= F.least("n_a", "n_b"))
    links = _links(docs, likely.select("a", "b"), shingle, percent)
    classes = components(links)

    rooted = about.join(classes.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("class"), "n")
    placed = listed.join(rooted, "sig").select("token", "sig", "class", "n").repartition(n_parts, "token").sortWithinPartitions("token")
    mixed = written(placed.mapInArrow(_mixed(percent), "token long, sig long, class long"), "mixed")
    beyond = F.ceil(F.col("n") * percent / 100 - 1e-9) - F.col("matches")
    known = mixed.groupBy("sig").agg(F.count("*").alias("degree")).join(about, "sig")
    placed = mixed.join(known.withColumn("beyond", beyond), "sig").select(*PLACED).repartition(n_parts, "token").sortWithinPartitions("token")
    rest = placed.mapInArrow(_between(percent), "a long, b long, n_shared long").groupBy("a", "b").agg(F.sum("n_shared").alias("n_shared"))
    links = links.unionByName(_links(docs, enough(rest).select("a", "b"), shingle, percent))
    classes = components(links).withColumnRenamed("node", "sig")

    rows = sets.select("sig", "doc_id", "n")
    rooted = written(sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(classes, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("sig", "component_id")
    return rows.where("n > 0").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class the row of docs with the smallest id, with all its columns.

    Rows of one id with different texts are judged by their own classes. Of rows of a class that
    share that id the first by text stays; null ids come last. Rows are told apart by the 64-bit
    hash of id and text, and equal ones are one.
    """
    own_id, row = F.col(id_col).cast("long"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    row_name, class_name, first_name = (free_name(docs.columns, x) for x in ("_row", "_class", "_first"))
    classes = near_duplicates(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")))
    classes = classes.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class")).distinct()
    members = written(docs.select(row.alias("_row"), own_id.alias("_id")).distinct().join(classes, "_row"), "members")
    least = members.groupBy("_class").agg(F.min("_id").alias("_least"))
    stays = members.join(least, "_class").where(F.col("_id").eqNullSafe(F.col("_least")))
    stays = stays.select(F.col("_row").alias(row_name), F.col("_class").alias(class_name))
    rows = docs.withColumn(row_name, row).join(stays, row_name)
    first = F.row_number().over(Window.partitionBy(class_name).orderBy(text_col))
    return rows.withColumn(first_name, first).where(F.col(first_name) == 1).select(*docs.columns)
