import hashlib

from hitledger.llm import exact_dedup
from hitledger.llm.exact_dedup import ContentTable, duplicate_groups


def by_hand(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def check(make_docs, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    found = duplicate_groups(make_docs(texts, ids), **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == by_hand(zip(ids, texts))
    for text in {r.text_sha256 for r in found}:
        kept = [r for r in found if r.text_sha256 == text and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    return found


def test_groups_with_nulls_and_long_texts(make_docs):
    long = "word " * 40_000
    check(make_docs, ["a", "b", "a", None, "", "A", " a", long, long, long + "x", "ü", "ü"])


def test_one_text_holds_most_rows(make_docs):
    check(make_docs, ["same"] * 500 + [f"other {k % 60}" for k in range(250)])


def test_repeated_rows_and_null_ids_keep_one(make_docs):
    check(make_docs, ["a", "a", "b", "b", "c"], [7, 7, None, 3, None])


def test_no_rows(make_docs):
    assert duplicate_groups(make_docs([])).count() == 0


def test_buckets_over_the_budget_are_spilled_again(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FANOUT", 2)
    texts = [f"text {k % 90} " * 8 for k in range(300)]
    check(make_docs, texts, bucket_bytes=500)


def test_every_level_divides_what_is_too_large(spark, make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FANOUT", 4)
    texts = [f"{k} " * 300 for k in range(250)]
    levels = {}
    check(make_docs, texts, bucket_bytes=20_000, saw=lambda level, sizes: levels.setdefault(level, []).append(sizes))
    largest = [max((n for job in levels[k] for _, n, hashes in job if hashes > 1), default=0) for k in sorted(levels)]
    assert len(largest) > 2 and all(b < 0.7 * a for a, b in zip(largest, largest[1:]))
    assert largest[-1] <= 20_000 and all(len(job) <= 4 for jobs in levels.values() for job in jobs)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("spill_")]


def test_one_content_beyond_the_budget(make_docs):
    check(make_docs, ["one content beyond the budget " * 900] * 3 + ["a", "b", "a"], bucket_bytes=20_000)


def test_equal_hashes_are_told_apart_by_content():
    table = ContentTable(4)
    numbers = [table.place(5, x) for x in (b"a", b"b", b"a", b"c", b"b", b"d", b"e", b"e")]
    assert numbers == [0, 1, 0, 2, 1, 3, 4, 4]
