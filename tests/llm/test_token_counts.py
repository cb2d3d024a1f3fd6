import pytest

from hitledger.llm import token_counts as tc
from hitledger.llm.common import table
from hitledger.llm.queries import byte_bpe_path, piece_bpe_path

TEXTS = [None, "", " two  spaces ", "<s> a</s> <unk>", "Été naïve 日本語 \U0001f600", "a\0b", "x" * 50_000, "many words " * 3000, "é" * 9] + ["a copy of many"] * 40


def wanted(texts, limit):
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=piece_bpe_path())
    n = [len(processor.encode(t or "")) for t in texts]
    return [(i, len((t or "").encode()), k, k > limit) for i, (t, k) in enumerate(zip(texts, n))]


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("few", [0, 10_000])
def test_counts_and_cache(spark, make_docs, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tc, "BROADCAST_MISSES", few)
    cache, path = str(tmp_path / "cache"), piece_bpe_path()
    encoded = spark.sparkContext.accumulator(0)
    plain = tc._encoder

    def counting(*args):
        encode = plain(*args)

        def run(batches):
            for batch in encode(batches):
                encoded.add(len(batch))
                yield batch

        return run

    monkeypatch.setattr(tc, "_encoder", counting)
    docs = make_docs(TEXTS)
    assert found(tc.count_tokens(docs, path, cache, limit=20)) == wanted(TEXTS, 20)
    assert encoded.value == len(set(t or "" for t in TEXTS))
    more = ["a copy of many", "new", None, "new", "<s> a</s> <unk>"]
    assert found(tc.count_tokens(make_docs(more), path, cache)) == wanted(more, 4096)
    assert encoded.value == len(set(t or "" for t in TEXTS)) + 1
    assert found(tc.count_tokens(docs, path, cache, limit=20)) == wanted(TEXTS, 20)
    assert encoded.value == len(set(t or "" for t in TEXTS)) + 1
    assert spark.read.parquet(cache).count() == encoded.value
    # another version has counts of its own
    tc.count_tokens(make_docs(more), byte_bpe_path(), cache).collect()
    assert encoded.value == len(set(t or "" for t in TEXTS)) + 5


def test_two_runs_that_added_one_content(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    docs = make_docs(["one", "two", "one"], [None, 5, 5])
    first = tc.count_tokens(docs, piece_bpe_path(), cache).collect()
    spark.read.parquet(cache).withColumnRenamed("tokenizer", "t").withColumnRenamed("t", "tokenizer").write.mode("append").partitionBy("tokenizer").parquet(cache)
    again = tc.count_tokens(docs, piece_bpe_path(), cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and len(again) == 3


def test_tokenizers_library(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in [*TEXTS, "x<|endoftext|>"]]
    rows = tc.count_tokens(make_docs([*TEXTS, "x<|endoftext|>"]), byte_bpe_path(), str(tmp_path / "cache"))
    assert [r.n_tokens for r in rows.orderBy("doc_id").collect()] == n


def test_whole_table_and_no_rows(spark, make_docs, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = tc.count_tokens(docs, piece_bpe_path(), str(tmp_path / "a"))
    assert [r.n_tokens for r in rows.orderBy("doc_id").collect()] == [w[2] for w in wanted([t for _, t in sorted(texts)], 4096)]
    assert tc.count_tokens(make_docs([]), piece_bpe_path(), str(tmp_path / "b")).count() == 0
