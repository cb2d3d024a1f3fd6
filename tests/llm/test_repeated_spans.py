import hashlib
from collections import defaultdict

import numpy as np
import pytest

from hitledger.llm import repeated_spans as r


def by_hand(rows, width):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if raw[s : s + width] in seen:
                gone[s : s + width] = True
            seen.add(raw[s : s + width])
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(make_docs, texts, ids=None, width=100):
    ids = list(range(len(texts))) if ids is None else ids
    found = r.digest(r.repeated_spans(make_docs(texts, ids), width=width)).collect()
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found), key=str)
    assert got == by_hand(list(zip(ids, texts)), width)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))


@pytest.mark.parametrize("piece", [r.PIECE_BYTES, 150])
def test_passages_copies_and_edges(make_docs, monkeypatch, piece):
    monkeypatch.setattr(r, "PIECE_BYTES", piece)
    rng = np.random.default_rng(3)
    passage, line = words(rng, 40), "é" * 49 + "xy"
    texts = [words(rng, 60) for _ in range(6)]
    texts += [words(rng, 5) + passage + words(rng, 9), passage[:120], words(rng, 7) + passage[30:], passage * 3]
    texts += [texts[0], texts[0], texts[1][:99], texts[1][:100], None, "", "a" * 500, "b" * 50 + "a" * 300, line, line + "z", "z" + line]
    check(make_docs, texts)


def test_repeated_and_null_ids(make_docs):
    rng = np.random.default_rng(4)
    a, b = words(rng, 50), words(rng, 50)
    check(make_docs, [a + b, b, a, a + "tail", b, a[50:], b + a], [5, 5, 5, None, None, 2, 2])


@pytest.mark.parametrize("width", [8, 20])
def test_few_letters_and_short_windows(make_docs, monkeypatch, width):
    monkeypatch.setattr(r, "PIECE_BYTES", 64)
    rng = np.random.default_rng(width)
    texts = ["".join(rng.choice(list("abé"), rng.integers(0, 70))) for _ in range(40)]
    check(make_docs, texts + [texts[3] * 4, "ab" * 60], width=width)


def test_a_text_that_holds_most_rows(make_docs):
    rng = np.random.default_rng(6)
    text = words(rng, 60)
    check(make_docs, [text] * 200 + [text + f" {k}" for k in range(20)] + [words(rng, 3_000)])


def test_a_hot_passage_between_different_neighbours_is_cut_into_bounded_units(make_docs, monkeypatch):
    bound, merge_units = 20_000, r._merge_units

    def bounded(width):
        merge = merge_units(width)

        def run(batches):
            batches, size = list(batches), defaultdict(int)
            for batch in batches:
                for gram, text in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                    size[gram] += len(text)
            assert max(size.values(), default=0) <= bound, max(size.values())
            yield from merge(iter(batches))

        return run

    monkeypatch.setattr(r, "UNIT_BYTES", bound)
    monkeypatch.setattr(r, "_merge_units", bounded)
    rng = np.random.default_rng(8)
    passage, sides = words(rng, 16), [words(rng, 14) for _ in range(12)]
    texts = []
    for _ in range(700):
        a, b = (sides[k] for k in rng.integers(0, len(sides), 2))
        cut_a, cut_b = rng.integers(0, 60, 2)
        texts.append(words(rng, 4) + a[cut_a:] + passage + b[:cut_b] + words(rng, 14))
    check(make_docs, texts + [passage + "a" * 300, "a" * 500] + texts[:3])


@pytest.mark.parametrize("width", [20, 60, 100])
def test_units_cut_down_to_windows(make_docs, monkeypatch, width):
    monkeypatch.setattr(r, "UNIT_BYTES", 150)
    monkeypatch.setattr(r, "GRAM", min(r.GRAM, width // 2))
    rng = np.random.default_rng(width)
    passage = words(rng, 30)
    texts = [words(rng, 3) + passage[rng.integers(0, 40) :] + words(rng, 5) for _ in range(40)]
    check(make_docs, texts + ["a" * 300, "ab" * 150, "b" + "a" * 200, None, "", texts[0]], [*range(40), None, None, 3, 4, 5, 3], width=width)


def test_no_rows(make_docs):
    assert r.repeated_spans(make_docs([])).count() == 0


def test_merged_intervals_are_the_equal_windows():
    rng = np.random.default_rng(0)
    for trial in range(60):
        width = int(rng.choice([8, 12]))
        blocks = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(width, width + 9)).astype(np.uint8)) for _ in range(rng.integers(1, 14))]
        blocks += blocks[: trial % 4]
        windows = defaultdict(set)
        for i, x in enumerate(blocks):
            for s in range(len(x) - width + 1):
                windows[x[s : s + width]].add((i, s))
        got = defaultdict(set)
        for i, s, k in zip(*r.equal_windows(blocks, width, shards=int(rng.integers(1, 5)))):
            got[k].add((int(i), int(s)))
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in windows.values() if len(x) > 1)
