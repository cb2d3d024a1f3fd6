import zlib

import numpy as np
import pytest

from hitledger.llm import token_store
from hitledger.llm.queries import byte_bpe_path
from hitledger.sinks.scratch import scratch_path

TEXTS = [
    "The cat sat, and the dog's bone isn't here.",
    "",
    None,
    "  two  spaces \n\n and\ttabs \r\n",
    "ünïcode žluť 日本語 text with odd spaces 　 x",
    "a é b \u0085c d́ e 🙂 f <|endoftext|> g",
    "12 345 x1 'll 'll's !!! ### a!! b## 's",
    "long " * 30_000,
    "\x00\x01 \x1f control \x7f",
]


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in rows]


def test_round_trip_in_ascending_order(spark, make_docs):
    ids = [40, 10, None, 30, 20, 20, 60, 50, 70]
    path = scratch_path(spark, "store")
    token_store.write_store(make_docs(TEXTS, ids), path, byte_bpe_path(), segment_ids=50)
    found = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 10, 20, 20, 30, 40, 50, 60, 70]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, (TEXTS[k] or "").encode()))
    tokens = expected([TEXTS[k] for k in order])
    ends = np.cumsum([len(x) for x in tokens])
    assert [(r.start, r.n_tokens) for r in found] == [(e - len(x), len(x)) for e, x in zip(ends, tokens)]
    assert [r.ids_crc32 for r in found] == [zlib.crc32(x.tobytes()) for x in tokens]
    everything = np.concatenate(tokens)
    places = [0, 1, 17, len(everything) - 1, *range(100, 30_000, 997)]
    got = {r.position: r.token_id for r in token_store.read_ids(spark, path, [*places, 10**9, -1]).collect()}
    assert got == {p: everything[p] for p in places}


def test_no_rows(spark, make_docs):
    path = scratch_path(spark, "store")
    token_store.write_store(make_docs([]), path, byte_bpe_path())
    assert token_store.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 65_536, 2**32 - 1])
def test_levels_give_every_id_back(top):
    rng = np.random.default_rng(top % 97)
    ids = np.append(rng.integers(0, top, 5_000, endpoint=True) >> rng.integers(0, 30, 5_000), top).astype(np.uint32)
    chunks, bitmaps, ranks = token_store.encode_levels(ids)
    assert (token_store.decode_levels(chunks, bitmaps) == ids).all()
    at = np.append(rng.integers(0, len(ids), 700), len(ids) - 1)
    assert (token_store.ids_at(chunks, bitmaps, ranks, at) == ids[at]).all()


def test_the_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_UNITS", 5)
    encoder = token_store.UnitEncoder(byte_bpe_path(), 2)
    for _ in range(2):
        for text, ids in zip(TEXTS[:7], expected(TEXTS[:7])):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            got, n = encoder.encode(raw, np.array([0, len(raw)]))
            assert (got == ids).all() and n.tolist() == [len(ids)]
