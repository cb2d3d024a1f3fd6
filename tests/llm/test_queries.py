import duckdb
import pytest

import corpus_pipeline
from hitledger.llm.common import table
from hitledger.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF).toPandas()
    wanted = duckdb.sql(ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert sorted(map(str, found[columns].values.tolist())) == sorted(map(str, wanted[columns].values.tolist()))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() < before, name
        before = docs.count()
    ids = sorted(r.doc_id for r in docs.collect())
    last = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r.doc_id for r in last] == ids
    assert [r.start for r in last] == [sum(x.n_tokens for x in last[:k]) for k in range(len(last))]


def test_pipeline_of_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
