import math
import re
from collections import Counter

import numpy as np
import pytest

from hitledger.llm import lexical_search as ls
from hitledger.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, best=10):
    """By brute force: a set of (item, rank, id, score)."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(term for _, c, _ in held for term in c)
    out = []
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for i, c, n in held:
            m, score = 25 + 75 * n * n_docs // n_terms, 0
            for term, many in asked.items():
                if c[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += many * weight * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:best], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize("query_bytes", [ls.QUERY_BYTES, 1000])
def test_equals_brute_force(spark, query_bytes):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    wanted = ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(wanted) > 10
    assert found(ls.search(docs, items, query_bytes=query_bytes)) == wanted


def test_awkward_rows(spark, make_docs, monkeypatch):
    texts = ["", None, "Été été x", "x y Z z z 9", "z", "z", "q " * 5000 + "rare", "w" * 70000, "x"] + ["same words here"] * 30 + ["...", "here"]
    ids = [*range(len(texts) - 3), None, 4, 4]
    docs = make_docs(texts, ids)
    rows = [(7, "X z z nothing"), (7, "here same"), (8, ""), (9, None), (10, "w" * 70000 + " rare Été"), (11, "x z here"), (11, "x z here"), (12, "!!")]
    items = spark.createDataFrame(rows, "item_id int, text string").repartition(3)
    wanted = ranked(list(zip(ids, texts)), dict.fromkeys(rows))
    assert found(ls.search(docs, items)) == wanted
    assert found(ls.search(docs.limit(0), items)) == [] and found(ls.search(docs, items.limit(0))) == []
    monkeypatch.setattr(ls, "PIECE_BYTES", 16)
    assert found(ls.search(docs, items, best=3)) == ranked(list(zip(ids, texts)), dict.fromkeys(rows), 3)


def test_shared_sets_are_summed_once():
    rng = np.random.default_rng(0)
    sets = [sorted(set(range(12)) | set(rng.integers(12, 60, 8).tolist())) for _ in range(40)] + [[3], []]
    nodes, left = ls.shared_nodes(sets, 60)
    inside = {k: [k] for k in range(60)}
    for k, children in enumerate(nodes, 60):
        inside[k] = [x for c in children for x in inside[c]]
    assert [sorted(x for c in own for x in inside[c]) for own in left] == sets
    additions = sum(len(c) - 1 for c in nodes) + sum(max(0, len(own) - 1) for own in left)
    assert additions < 0.5 * sum(max(0, len(own) - 1) for own in sets)


def test_plan_survives_its_bytes_and_scores_in_blocks(monkeypatch):
    texts = [b"a b c d", b"a b c e e e", b"a b d e", b"", b"c d a b"]
    plan = ls.plan_from(ls.QueryPlan(texts).to_bytes())
    assert len(plan.child_at) > 1 and len(plan.sum_at) == 6
    monkeypatch.setattr(ls, "CELLS", 40)
    searcher = ls.Searcher(plan, np.arange(1, len(plan.terms) + 1), 4, 12, 2)
    assert searcher.width < 4
    starts, terms = np.array([0, 2, 2, 5, 6]), np.array([0, 1, 2, 3, 4, 4], np.int32)
    n = np.array([3, 1, 5, 3])
    searcher.add(np.array([5, 6, 7, 8]), np.zeros(4, np.int64), n, starts, terms, np.ones(6, np.int32))
    whole = ls.Searcher(plan, np.arange(1, len(plan.terms) + 1), 4, 12, 2)
    whole.width = 100
    whole.add(np.array([5, 6, 7, 8]), np.zeros(4, np.int64), n, starts, terms, np.ones(6, np.int32))
    assert (searcher.held == whole.held).all()
