"""Token counts of texts, each distinct content encoded once for each version of a tokenizer.

The cache is a Parquet folder with one subfolder per tokenizer version, which is a digest of the
vocabulary file, the library and its version, and in it one row per content: the SHA-256 digest of the
normalised text and its number of tokens. A count joins the digests of the documents with the cache;
the texts of the misses alone are shuffled and encoded, each once, and their counts appended.

Normalised is what no tokenizer can tell apart: a null text counts as the empty one. Anything more
would give texts one count that the libraries may count apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.llm.common import ship, written

LIMIT = 4096
ENCODE_BYTES = 1 << 20
BROADCAST_MISSES = 10_000  # digests of 32 bytes each
CACHE = "digest binary, n_tokens long, tokenizer string"
COUNTED = "digest binary, n_tokens long"


def tokenizer_version(content: bytes, library: str) -> str:
    """A digest of everything that decides how a text is cut."""
    return hashlib.sha256(content + f"|{library} {version(library)}".encode()).hexdigest()


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def token_counter(content: bytes, library: str) -> Callable[[list[bytes]], list[int]]:
    """Counts the tokens of UTF-8 texts as the library does by default, without added tokens.

    Bytes that are no UTF-8 count as the replacement character, which is what sentencepiece itself
    makes of them.
    """
    if library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(texts: list[bytes]) -> list[int]:
        decoded = [text.decode("utf-8", "replace") for text in texts]
        return [len(found.ids) for found in tokenizer.encode_batch_fast(decoded, add_special_tokens=False)]

    return count


_COUNTERS: dict[str, Callable[[list[bytes]], list[int]]] = {}


def _encoder(vocabulary: Broadcast, library: str, tokenizer: str, encode_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hitledger.llm import token_counts

        counters = token_counts._COUNTERS  # kept by the Python worker from task to task
        if tokenizer not in counters:
            counters[tokenizer] = token_counter(vocabulary.value, library)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= encode_bytes:
                    counts += counters[tokenizer](held)
                    held, size = [], 0
            counts += counters[tokenizer](held) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Counts that one version of a tokenizer gave; of contents that two runs added, one row."""
    if not _exists(spark, path):
        return spark.createDataFrame([], COUNTED)
    own = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    encode_bytes: int = ENCODE_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer_path is a vocabulary file: .model for sentencepiece, others for tokenizers. The driver
    reads it and broadcasts its bytes, about a megabyte. Null counts as empty; the empty text is
    encoded like any other. Texts are encoded whole, a text of any length by one call. Repeated rows
    and null ids come back as they are; an empty table adds nothing to the cache.

    Texts are told apart by their SHA-256 digests. Copies fold into one inside each task, so a text
    that most rows have is shuffled once per task and encoded once. Where few contents are missing,
    their digests are broadcast and only their texts leave the tasks that read them.
    """
    spark = docs.sparkSession
    ship(spark)
    content, library = Path(tokenizer_path).read_bytes(), library_of(tokenizer_path)
    tokenizer = tokenizer_version(content, library)
    vocabulary = spark.sparkContext.broadcast(content)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", _digest(F.col("text")))
    keys = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")
    asked = keys.select("digest").distinct()
    looked_up = written(asked.join(read_cache(spark, cache_path, tokenizer), "digest", "left"), "looked-up")
    misses = looked_up.where("n_tokens IS NULL").select("digest")
    n_misses = misses.count()
    counts = looked_up.where("n_tokens IS NOT NULL")
    if n_misses:
        texts = rows.select("digest", "text")
        if n_misses <= BROADCAST_MISSES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        once = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n_misses > BROADCAST_MISSES:
            once = once.join(misses, "digest", "left_semi")
        encode = _encoder(vocabulary, library, tokenizer, encode_bytes)
        new = written(once.mapInArrow(encode, COUNTED), "counted")
        new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
        counts = counts.unionByName(new)
    found = keys.join(counts, "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
