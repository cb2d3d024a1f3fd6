import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hitledger.llm import jaccard_join as j
from hitledger.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows):
    """By counting the shared shingles of every pair."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for shingle in s:
            holders[shingle].append(k)
    holders = {shingle: np.array(own) for shingle, own in holders.items()}
    size = np.array([len(s) for _, s in sets])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, x) in enumerate(sets):
        shared = np.zeros(len(sets), np.int64)
        for shingle in x:
            shared[holders[shingle]] += 1
        for b in np.flatnonzero((shared > 0) & (100 * shared >= 75 * (size[a] + size - shared))).tolist():
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), min(least[find(k)], default=None)) for k, (i, s) in enumerate(sets)), key=str)


def check(make_docs, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    found = j.near_duplicates(make_docs(texts, ids)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == by_hand(list(zip(ids, texts)))


def variants(seed):
    """Texts with chains of near copies, shared passages and borderline pairs."""
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(400)]
    passage = rng.choices(names, k=40)
    texts = []
    for _ in range(14):
        words = rng.choices(names, k=rng.choice([6, 12, 30, 80, 200]))
        texts.append(" ".join(words))
        for _ in range(rng.randrange(5)):
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(names)
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " \n".join(words))
    texts += [" ".join(passage + rng.choices(names, k=rng.randrange(3, 14))) for _ in range(25)]
    rng.shuffle(texts)
    return texts


def test_classes_of_variants(make_docs):
    check(make_docs, variants(1))


def test_short_null_empty_and_repeated(make_docs):
    texts = ["a b c", "A b  c", "a b", None, "", " \t\n", "a b c d e", "a b c d e f", "\x0ba", "é É", "é é", "a\x00b c"]
    check(make_docs, [*texts, *texts], [*range(12), *range(6), None, None, None, 20, 21, 22])


def test_a_class_that_holds_most_rows(make_docs):
    words = [f"x{k}" for k in range(60)]
    near = [" ".join([*words[:k], f"y{k}", *words[k + 1 :]]) for k in range(55, 60)]
    check(make_docs, [" ".join(words)] * 150 + near + [" ".join(words) * 3_000, *variants(2)[:30]])


def test_a_text_of_frequent_shingles_and_longer_ones_of_rare_shingles(make_docs):
    words = [f"c{k}" for k in range(100)]
    longer = [" ".join(words + [f"n{n}x{k}" for k in range(n)]) for n in (31, 32, 33)]  # 96 of 127, 128, 129 shingles
    texts = [" ".join(words)] * 1_000 + longer
    found = {r.doc_id: r.component_id for r in j.near_duplicates(make_docs(texts)).collect()}
    assert found == {**dict.fromkeys(range(1_002), 0), 1_002: 1_002}


def counted(monkeypatch):
    """Rows of the written tables, by name."""
    rows, plain = {}, j.written

    def written(df, what):
        out = plain(df, what)
        rows.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(j, "written", written)
    return rows


@pytest.mark.parametrize("shared, many", [(100, 2_000), (168, 500)])
def test_many_documents_that_share_one_passage(make_docs, monkeypatch, shared, many):
    """Of 200 words each; the rest comes from few words, so that it is not unique either."""
    rng = random.Random(shared)
    passage, names = [f"p{k}" for k in range(shared)], [f"w{k}" for k in range(9)]
    rest = [rng.choices(names, k=200 - shared) for _ in range(many)]
    texts = [" ".join(passage + own if k % 2 else own + passage) for k, own in enumerate(rest)]
    rows = counted(monkeypatch)
    check(make_docs, texts)
    assert rows["pairs"][1] < 4 * len(texts)


def test_parities_bound_what_is_not_shared():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3_000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in rng.integers(1, 2_500, 60)]
    parities = j.Parities(pa.array([j.parity_row(s) for s in sets], pa.binary()))
    assert sorted(set(parities.width.tolist()))[-1] == j.PARITY_BITS[1] // 8
    x, y = np.divmod(np.arange(3_600), 60)
    truly = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y)])
    apart = parities.apart(x, y)
    assert (apart <= truly).all() and (apart[x == y] == 0).all()
    alike = np.array([1 < len(sets[a]) < 900 and len(sets[a]) <= len(sets[b]) < 1.3 * len(sets[a]) for a, b in zip(x, y)])
    assert (apart[alike] >= 0.5 * truly[alike]).all()


def test_no_rows(make_docs):
    assert j.near_duplicates(make_docs([])).count() == 0
    assert j.one_of_each(make_docs([])).count() == 0


def test_one_row_of_each_class_stays(make_docs):
    texts, ids = ["p q r s t u v"] * 3 + ["other words", None, None, "null id here", "null id here"], [5, 4, 4, 9, 7, None, None, None]
    docs = make_docs(texts, ids)
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(4, texts[0]), (9, "other words"), (7, None), (None, None), (None, "null id here")], key=str)


def test_texts_of_one_id_are_judged_by_their_own_classes(make_docs):
    clean, copied, null = "a clean text of one id", "the second text of that id", "only null ids have this"
    texts, ids = [clean, copied, copied, copied, null, null.upper(), clean], [1, 1, 2, None, None, None, 0]
    kept = sorted(((r.doc_id, r.text) for r in j.one_of_each(make_docs(texts, ids)).collect()), key=str)
    assert kept == sorted([(0, clean), (1, copied), (None, null.upper())], key=str)
    kept = j.one_of_each(make_docs([clean, copied], [1, 1])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, clean), (1, copied)]


def test_costly_tokens_lengthen_the_prefix():
    cheap, dear = np.zeros(100), np.concatenate([np.zeros(20), np.full(80, 40.0)])
    assert j.prefix_matches(cheap, 2.0, 75) == 1
    assert j.prefix_matches(dear, 2.0, 75) > 1
    assert j.prefix_matches(np.zeros(1), 1.0, 75) == 1


def test_lists_over_any_batches():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = rng.integers(0, 40)
        entries = sorted(zip(rng.integers(0, 12, n).tolist(), rng.integers(0, 4, n).tolist()))
        cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
        batches = (pa.RecordBatch.from_arrays([pa.array([e[k] for e in entries[a:b]], pa.int64()) for k in (0, 1)], ["token", "sig"]) for a, b in zip(cuts, cuts[1:]))
        got = [(r["token"], r["sig"]) for b in j._lists(batches) for r in b.to_pylist()]
        distinct = sorted(set(entries))
        assert got == [e for e in distinct if sum(x[0] == e[0] for x in distinct) > 1]


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(900, 3), (3, 900), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(101, 161)) and all(found[k] == 7 for k in range(200, 300)) and found[900] == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaders_meet_sets_by_a_bounded_number_of_tokens(spark):
    """Two long copies share all lists, strangers one token each, and a short pair its only two."""
    copies = [(token, sig) for token in range(500) for sig in (1, 2)]
    strangers = [(1_000 + k, sig) for k in range(50) for sig in (100 + k, 200 + k)]
    short = [(token, sig) for token in (2_000, 2_001) for sig in (3, 4)]
    listed = spark.createDataFrame(copies + strangers + short, "token long, sig long")
    sizes = {1: 2_000, 2: 2_000, 3: 8, 4: 8, **{k: 300 for k in [*range(100, 150), *range(200, 250)]}}
    about = spark.createDataFrame(list(sizes.items()), "sig long, n long")
    degrees = j.leading(listed, about, 75)
    assert {(r.sig, r.degree) for r in degrees.collect()} == {(1, 500), (2, 500), (3, 2), (4, 2)}
    led = [(r.token, r.sig) for r in j.led_entries(listed, degrees).collect()]
    met = {sig: sorted(t for t, s in led if s == sig) for sig in (1, 2, 3, 4)}
    assert len(met[1]) == j.LED_TOKENS and met[1] == met[2] and met[3] == met[4] == [2_000, 2_001]
    assert len(led) == 2 * j.LED_TOKENS + 4


def test_mixed_lists_keep_members_with_a_partner_of_fitting_size():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        entries = sorted(zip(rng.integers(0, 6, n).tolist(), range(n), rng.integers(0, 4, n).tolist(), rng.integers(1, 30, n).tolist()))
        cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
        batches = (pa.RecordBatch.from_arrays([pa.array([e[k] for e in entries[a:b]], pa.int64()) for k in range(4)], ["token", "sig", "class", "n"]) for a, b in zip(cuts, cuts[1:]))
        got = sorted((r["token"], r["sig"], r["class"]) for b in j._mixed(75)(batches) for r in b.to_pylist())
        fits = [any(y[0] == x[0] and y[2] != x[2] and 100 * min(x[3], y[3]) >= 75 * max(x[3], y[3]) for y in entries) for x in entries]
        assert got == [e[:3] for e, fit in zip(entries, fits) if fit]
