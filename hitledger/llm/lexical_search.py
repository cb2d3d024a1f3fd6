"""Ranked lexical search of many items at once, sharing what items have in common.

All items are one workload. The terms that the same items hold, and then the pairs of parts that most items
have together, become nodes of a graph: a node is the sum of its children, a leaf is a term.
Documents are scored in blocks. Of a block the accumulators of the terms are filled once, then
those of each shared node from its children, and each item adds up the few nodes that make it up.
So a set of terms that a hundred items share is summed once per document.

A first pass writes which terms of the items each document holds; the counts of the ranking come from
that table, and so do the scores. Items are dealt to blocks of about QUERY_BYTES, each planned in a
task; the driver and the workers hold the plan of one block at a time.
"""

from __future__ import annotations

import heapq
import io
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitledger.llm.byte_words import byte_class, span_hashes, spans_of_pieces
from hitledger.llm.common import longs, parts_for, text_bytes, texts_of, written
from hitledger.llm.decontaminate import Words

BEST = 10
QUERY_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
CELLS = 1 << 21  # accumulators held at once
LEAST_SHARED = 3  # sets of terms that must have a pair before it becomes a node
PAIR_WIDTH = 64  # members of a set among which pairs are sought; the others are added one by one
PARTS = 64

TERM_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
MATCHES = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "query int, doc_id long, score long"


def shared_nodes(sets: list[list[int]], first: int) -> tuple[list[list[int]], list[list[int]]]:
    """The children of new nodes, numbered from `first`, and what is left of each set.

    Members that the same two or more sets hold become one node. Then the pair of members that the
    most sets have becomes a node in all of them, again and again, while LEAST_SHARED sets have one.
    Any choice gives the same sums; it decides only how many additions they take.
    """
    held = defaultdict(list)
    for k, members in enumerate(sets):
        for member in members:
            held[member].append(k)
    alike = defaultdict(list)
    for member in sorted(held):
        alike[tuple(held[member])].append(member)
    nodes: list[list[int]] = []
    parts: list[list[int]] = [[] for _ in sets]
    wide: dict[int, int] = {}
    for where, members in alike.items():
        if len(where) > 1 and len(members) > 1:
            nodes.append(members)
            members = [first + len(nodes) - 1]
        for member in members:
            wide[member] = len(where)
            for k in where:
                parts[k].append(member)

    active = [set(sorted(own, key=lambda x: (-wide[x], x))[:PAIR_WIDTH]) for own in parts]
    active = [{x for x in own if wide[x] >= LEAST_SHARED} for own in active]
    rest = [[x for x in own if x not in active[k]] for k, own in enumerate(parts)]
    pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k, own in enumerate(active):
        ordered = sorted(own)
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                pairs[a, b].add(k)
    heap = [(-len(where), pair) for pair, where in pairs.items() if len(where) >= LEAST_SHARED]
    heapq.heapify(heap)
    while heap:
        size, (a, b) = heapq.heappop(heap)
        where = pairs[a, b]
        if len(where) != -size:
            if len(where) >= LEAST_SHARED:
                heapq.heappush(heap, (-len(where), (a, b)))
            continue
        node = first + len(nodes)
        nodes.append([a, b])
        touched = set()
        for k in list(where):
            active[k] -= {a, b}
            for x in active[k]:
                pairs[min(a, x), max(a, x)].discard(k)
                pairs[min(b, x), max(b, x)].discard(k)
                pairs[x, node].add(k)
                touched.add((x, node))
            active[k].add(node)
        del pairs[a, b]
        for pair in touched:
            if len(pairs[pair]) >= LEAST_SHARED:
                heapq.heappush(heap, (-len(pairs[pair]), pair))
    return nodes, [rest[k] + sorted(active[k]) for k in range(len(sets))]


def _ragged_arrays(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.array([y for x in lists for y in x], np.int64), np.concatenate([[0], np.cumsum(sizes)])


class QueryPlan:
    """The items of a block as sums over a graph whose leaves are their distinct terms.

    Nodes 0 to len(terms) - 1 are the terms; the others follow in levels, children before parents.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece, starts, ends, text in spans_of_pieces(raw, offsets, TERM_BYTES, PIECE_BYTES):
            hashes.append(span_hashes(piece, starts, ends))
            owner.append(text)
        self.terms, number = np.unique(np.concatenate(hashes), return_inverse=True)
        bags, counts = np.unique(np.stack([np.concatenate(owner), number.reshape(-1)]), axis=1, return_counts=True)
        sets, of = [], []  # of an item: its terms, those that it has twice or more, three times ...
        for item in range(len(texts)):
            own = bags[0] == item
            for k in range(1, int(counts[own].max(initial=0)) + 1):
                sets.append(bags[1][own & (counts >= k)].tolist())
                of.append(item)
        nodes, left = shared_nodes(sets, len(self.terms))
        sums: list[list[int]] = [[] for _ in texts]
        for item, members in zip(of, left):
            sums[item] += members
        level = [0] * len(self.terms)
        for children in nodes:
            level.append(1 + max(level[c] for c in children))
        order = sorted(range(len(nodes)), key=lambda k: level[len(self.terms) + k])
        renamed = np.arange(len(self.terms) + len(nodes))
        renamed[len(self.terms) + np.array(order, np.int64)] = len(self.terms) + np.arange(len(nodes))
        children, self.child_at = _ragged_arrays([nodes[k] for k in order])
        self.children = renamed[children] if len(children) else children
        ordered = [level[len(self.terms) + k] for k in order]
        self.level_at = np.array([0, *np.flatnonzero(np.diff(ordered)) + 1, len(nodes)] if nodes else [0], np.int64)
        members, self.sum_at = _ragged_arrays(sums)
        self.sums = renamed[members] if len(members) else members

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()


class Searcher:
    """Scores blocks of documents for all items of a plan and keeps the best of each item."""

    def __init__(self, plan: QueryPlan, weights: np.ndarray, n_docs: int, n_terms: int, best: int):
        self.plan, self.weights, self.n_docs, self.n_terms, self.best = plan, weights, n_docs, n_terms, best
        self.leaves, self.nodes = len(plan.terms), len(plan.terms) + len(plan.child_at) - 1
        self.width = max(1, CELLS // max(1, self.nodes, len(plan.sums)))
        self.filled = np.flatnonzero(np.diff(plan.sum_at) > 0)  # items with terms
        self.held = np.zeros((4, 0), np.int64)  # item, score, whether the id is null, id
        self.least = np.zeros(len(plan.sum_at) - 1, np.int64)  # the least held score of items that hold `best`

    def _lengths(self, n: np.ndarray) -> np.ndarray:
        if 75 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            return 25 + 75 * n * self.n_docs // self.n_terms
        return np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)

    def _sums(self, at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        """The scores of all items with terms: one row per item, one column per document."""
        plan = self.plan
        table = np.zeros((self.nodes, width), np.int64)
        table.reshape(-1)[at] = values
        for a, b in zip(plan.level_at[:-1], plan.level_at[1:]):
            own = plan.children[plan.child_at[a] : plan.child_at[b]]
            table[self.leaves + a : self.leaves + b] = np.add.reduceat(table[own], plan.child_at[a:b] - plan.child_at[a], axis=0)
        return np.add.reduceat(table[plan.sums], plan.sum_at[self.filled], axis=0)

    def add(self, doc_ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their term numbers and counts, one list after the other."""
        if not len(self.filled):
            return
        for a in range(0, len(n), self.width):
            b = min(a + self.width, len(n))
            own = slice(starts[a], starts[b])
            doc = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
            tf = counts[own].astype(np.int64)
            values = self.weights[terms[own]] * (1_000_000_000 * tf // (1000 * tf + 8 * self._lengths(n[a:b])[doc]))
            scores = self._sums(terms[own].astype(np.int64) * (b - a) + doc, values, b - a)
            row, column = np.nonzero((scores > 0) & (scores >= self.least[self.filled][:, None]))
            new = np.stack([self.filled[row], scores[row, column], no_id[a:b][column], doc_ids[a:b][column]])
            self._keep(np.concatenate([self.held, new], 1))

    def _keep(self, found: np.ndarray) -> None:
        found = found[:, np.lexsort((found[3], found[2], -found[1], found[0]))]
        first = np.searchsorted(found[0], found[0], "left")
        rank = np.arange(found.shape[1]) - first
        self.held = found[:, rank < self.best]
        last = found[:, rank == self.best - 1]
        self.least[last[0]] = last[1]


def _planner(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(name.as_py(), text.as_py()) for batch in batches for name, text in zip(batch.column("item"), batch.column("text"))]
    rows.sort(key=lambda row: (row[0] or "", row[0] is None, row[1]))
    plan = QueryPlan([text for _, text in rows])
    names = pa.array([[name for name, _ in rows]], pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), names, pa.array([plan.to_bytes()], pa.binary())], ["block", "names", "plan"])


def plan_from(content: bytes) -> QueryPlan:
    plan = QueryPlan.__new__(QueryPlan)
    with np.load(io.BytesIO(content)) as stored:
        vars(plan).update({k: stored[k] for k in stored.files})
    return plan


def _matcher(words):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            n, keys = np.zeros(len(batch), np.int64), [np.zeros(0, np.int64)]
            for piece, starts, ends, text in spans_of_pieces(raw, offsets, TERM_BYTES, PIECE_BYTES):
                n += np.bincount(text, minlength=len(batch))
                number = known.numbers(span_hashes(piece, starts, ends)).astype(np.int64)
                keys.append(text[number > 0] * (len(known.known) + 1) + number[number > 0])
            keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            at = np.searchsorted(keys, np.arange(len(batch) + 1) * (len(known.known) + 1)).astype(np.int32)
            terms = keys % (len(known.known) + 1) - 1
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(n), *lists], ["doc_id", "n", "terms", "counts"])

    return match


def _search(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for batch in batches:
            ids = batch.column("doc_id")
            no_id = np.asarray(ids.is_null()).astype(np.int64)
            terms, counts = (batch.column(k) for k in ("terms", "counts"))
            starts = np.asarray(terms.offsets).astype(np.int64)
            flat = [np.asarray(x.flatten()) for x in (terms, counts)]
            searcher.add(np.asarray(ids.fill_null(0)), no_id, np.asarray(batch.column("n")), starts - starts[0], *flat)
        item, score, no_id, doc_id = searcher.held
        ids = pa.array(doc_id, pa.int64(), mask=no_id > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), ids, longs(score)], ["query", "doc_id", "score"])

    return search


def _best(found: DataFrame, keys: list[str], best: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= best)


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The `best` documents of each item with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters outside ASCII of the whole text, A-Z lower-cased;
    null and empty texts have none. Documents without terms count nowhere; items without terms find
    nothing. Equal scores go by ascending id, null ids last; repeated documents are ranked each.
    Items with equal id and text are one item; those that share only their id are ranked apart under it.
    Terms are told apart by 64-bit hashes. Each block of items is one pass over the texts.

    A task keeps the best of each item, so nothing grows with the documents that match; the bests of
    all tasks meet in PARTS parts of an item before they meet in one.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col)
    id_type = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "text"), F.lit(parts_for(size, query_bytes))).cast("int")
    planned = asked.withColumn("block", block).groupBy("block").applyInArrow(_planner, "block int, names array<string>, plan binary")
    plans = written(planned, "plans")
    found = []
    for row in plans.select("block").orderBy("block").collect():
        content = plans.where(F.col("block") == row.block).select("plan").first().plan
        part = _search_block(rows, plan_from(content), best)
        named = plans.where(F.col("block") == row.block).select(F.posexplode("names").alias("query", "item"))
        found.append(part.join(named, "query").withColumn("block", F.lit(row.block)))
    if not found:
        return spark.createDataFrame([], "item string, rank int, doc_id long, score long").withColumn("item_id", F.col("item").cast(id_type)).select("item_id", "rank", "doc_id", "score")
    everything = reduce(DataFrame.unionByName, found)
    dealt = everything.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    first = _best(dealt, ["block", "query", "part"], best).drop("rank")
    return _best(first, ["block", "query"], best).select(F.col("item").cast(id_type).alias("item_id"), "rank", "doc_id", "score")


def _search_block(rows: DataFrame, plan: QueryPlan, best: int) -> DataFrame:
    """The best documents of each task for the items of one block, written."""
    context = rows.sparkSession.sparkContext
    words = context.broadcast(Words(plan.terms))
    matches = written(rows.mapInArrow(_matcher(words), MATCHES), "matches")
    n_docs, n_terms = matches.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(plan.terms), np.int64)
    for row in matches.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[row.term] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    shared = context.broadcast((plan, weights, n_docs, max(1, n_terms), best))
    found = written(matches.where(F.size("terms") > 0).mapInArrow(_search(shared), FOUND), "found")
    words.unpersist()
    shared.unpersist()
    return found
