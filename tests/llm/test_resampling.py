import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hitledger.llm import resampling as rs
from hitledger.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(text):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def resampled(docs, target, percent=25, least=20):
    """By brute force: rows (id, features, weight, score, rank)."""
    own = [(i, *features_of(t)) for i, t in docs]
    s = Counter(bucket(f) for *_, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features_of(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for i, n, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = long[: percent * len(long) // 100]
    ranks = {id(r): k for k, r in enumerate(drawn, 1)}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in rows), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, sf):
    docs, target = (table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "benchmark"))
    wanted = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    result = rs.resample(docs, target)
    assert {k for _, k in result.dtypes} == {"bigint"}
    assert found(result) == wanted and any(r[-1] for r in wanted)


def test_awkward_rows(spark, make_docs, monkeypatch):
    texts = [None, "", "a b", "É é " + "z" * 200 + " q", "!! ..", "w" * 64 + " " + "w" * 65 + " " + "v" * 64] + ["Same old words"] * 9 + ["one two three four"] * 4
    ids = [*range(len(texts) - 6), 3, 3, None, None, 70, 2**62]
    docs = make_docs(texts, ids)
    target = spark.createDataFrame([(0, "one Two three"), (1, None), (2, "")], "item_id int, text string")
    for percent, least in ((50, 2), (100, 0), (0, 0), (50, 1000)):
        wanted = resampled(list(zip(ids, texts)), ["one Two three"], percent, least)
        got = found(rs.resample(docs, target, percent, least))
        # rows of one id and score can swap ranks, but nothing else
        assert [r[:4] for r in got] == [r[:4] for r in wanted]
        assert sorted((str(r[0]), r[3], r[4] or 0) for r in got) == sorted((str(r[0]), r[3], r[4] or 0) for r in wanted)
    monkeypatch.setattr(rs, "BLOCK_BYTES", 7)
    assert found(rs.resample(docs, target, 100, 0)) != [] and found(rs.resample(docs, target.limit(0)))[0] is not None
    assert rs.resample(docs.limit(0), target).count() == 0


def test_pieces_change_no_feature(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abÉ  .x"), rng.integers(0, 400))) for _ in range(30)] + ["", "y" * 500 + " z"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    wanted = [Counter(bucket(f) for f in features_of(t)[1]) for t in texts]
    for size in (3, 50, 1 << 20):
        monkeypatch.setattr(rs, "BLOCK_BYTES", size)
        got = [Counter() for _ in texts]
        for found_, text, _ in rs.feature_buckets(raw, offsets, 10000):
            for b, k in zip(found_.tolist(), text.tolist()):
                got[k][b] += 1
        assert got == wanted


def test_bisection_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(d) if d < 900 else None, int(s)) for i, (d, s) in enumerate(zip(rng.integers(0, 1000, 2000), rng.integers(-5, 5, 2000)))]
    frame = spark.createDataFrame(rows, "row_id long, doc_id long, score long")
    wanted = [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))]
    for steps, many in ((15, 1), (15, 777), (1, 1300), (3, 2000)):
        monkeypatch.setattr(rs, "STEPS", steps)
        assert {r.row_id for r in rs.drawn_rows(frame, many).collect()} == set(wanted[:many])
