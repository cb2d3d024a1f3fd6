import hashlib
import re

import numpy as np
import pytest

from hitledger.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short Phrase"),
    (3, ""),
    (4, None),
    (10, "two three four five six seven eight nine ten eleven"),
    (10, "two three four five six seven eight nine ten eleven"),
    (None, "élan Vital 42"),
]
TEXTS = [
    "x one two THREE four, five six seven-eight nine ten eleven y",
    "one two three four five six seven eight nine ten eleven twelve " * 3,
    "a short phrase, and short phrase again; shortphrase",
    "one two three four five six seven eight nine",
    None,
    "",
    "... !!! ---",
    "élan vital 42 élan vital 43 ÉLAN vital 42",
    "ten eleven",
    "short",
    "phrase",
    "filler " * 20_000 + "short phrase " + "filler " * 20_000,
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, phrase in items:
        p = words(phrase)
        n = min(window, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == p[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add("" if item is None else str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), sha, bool(hit)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 40}, {"block_bytes": 40}])
def test_like_a_plain_search(spark, make_docs, options):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.digest(d.find_contamination(make_docs(TEXTS), items, **options)).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == by_hand(TEXTS[r.doc_id], ITEMS)


def test_spans_are_bytes_of_the_text(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = d.find_contamination(make_docs([TEXTS[7]]), items).first()
    cut = [TEXTS[7].encode()[s.begin : s.end].decode() for s in row.spans]
    assert cut == ["élan vital 42"]


def test_dropping_keeps_clean_rows_whole(spark, make_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(TEXTS, [*range(11), 3])
    for options in ({}, {"block_bytes": 40}):
        kept = d.drop_contaminated(docs, items, **options)
        assert kept.columns == docs.columns
        assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t in TEXTS if not by_hand(t, ITEMS)[-1])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(make_docs([]), none).count() == 0
    found = d.digest(d.find_contamination(make_docs(TEXTS), none)).collect()
    assert len(found) == len(TEXTS) and not any(r.contaminated for r in found)


def test_suffix_order_and_search_of_random_symbols():
    rng = np.random.default_rng(5)
    for trial in range(40):
        s = rng.integers(0, rng.integers(2, 6), rng.integers(1, 300))
        s[: len(s) // (1 + trial % 3)] = 1
        s[-1] = 0
        unique = [int(x) if x else i - len(s) for i, x in enumerate(s)]
        assert d.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: unique[i:])
        index = d.FMIndex(s)
        for n in range(1, 6):
            phrase = rng.integers(1, 5, n)
            table = np.zeros((1, 6), np.int64)
            table[0, :n] = phrase
            live, low, high = index.search(table, np.array([n]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(live) else []
            assert got == [i for i in range(len(s) - n + 1) if (s[i : i + n] == phrase).all()]
