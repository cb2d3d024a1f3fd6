"""The registered queries: each applies one operator to its whole table and digests what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitledger.llm import transcripts, jaccard_join, repeated_spans, mixing, html_text, quality, secrets, decontaminate, exact_dedup, token_store, token_counts, lexical_search, resampling
from hitledger.llm.common import table
from hitledger.sinks.scratch import scratch_path


def byte_bpe_path() -> str:
    """The installed vocabulary, found by its package; parameters of the operators take any other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, byte_bpe_path())
    return token_store.read_documents(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, benchmark))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digest(repeated_spans.repeated_spans(table(spark, sf_dir, "documents")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op1_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as transcripts with uneven markers and no roles, parsed back into turns."""
    turns = table(spark, sf_dir, "conversations")
    return transcripts.parse_transcripts(transcripts.marked_parts(turns), transcripts.RoleModel.fit(turns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that is new, so that every distinct text is encoded."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), piece_bpe_path(), scratch_path(spark, "token-counts"))


QUERIES = {
    "op1_transcripts": op1_transcripts,
    "op2_jaccard_join": op2_jaccard_join,
    "op8_repeated_spans": op8_repeated_spans,
    "op6_mixing": op6_mixing,
    "op4_html_text": op4_html_text,
    "op3_quality": op3_quality,
    "op9_secrets": op9_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op10_token_store": op10_token_store,
    "op11_resampling": op11_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_counts": op13_token_counts,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_decontaminate": rf"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        items AS (
            SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ),
        phrases AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS phrase
            FROM items WHERE len(w) > 0
        ),
        windows AS (
            SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS phrase
            FROM words, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n
        ),
        found AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrases USING (n, phrase)),
        hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
        named AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM found GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_lexical_search": rf"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        asked AS (
            SELECT item_id, term, count(*) AS c FROM (
                SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
            ) GROUP BY ALL
        ),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
        held AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words),
        postings AS (SELECT doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) AS impact
            FROM postings JOIN weights USING (term), totals
        ),
        scores AS (SELECT item_id, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10""",
}
