"""Stages that filter return the columns of the table as they are, whatever their names."""

import pytest

import corpus_pipeline
from hitledger.llm import decontaminate, jaccard_join, mixing, quality
from hitledger.llm.common import table

TEXTS = [f"some words of document {k % 7} and more of them than a shingle has {k % 3}" for k in range(30)] + [None, ""]


@pytest.mark.parametrize("name", ["near_duplicates", "decontamination", "mixing", "quality"])
def test_columns_with_clashing_names_stay(spark, make_docs, name):
    docs = make_docs(TEXTS)
    phrases = spark.createDataFrame([(1, TEXTS[0])], "item_id long, text string")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    learned = table(spark, "/root/testdata/sf0.001", "documents")
    kept = {
        "near_duplicates": lambda: jaccard_join.one_of_each(docs),
        "decontamination": lambda: decontaminate.drop_contaminated(docs, phrases),
        "mixing": lambda: mixing.sample_documents(docs, budget=0.8),
        "quality": lambda: quality.keep_good(docs.unionByName(learned, allowMissingColumns=True), labels).where("_row is not null"),
    }[name]()
    assert kept.schema == docs.schema
    rows, before = {tuple(r) for r in kept.collect()}, {tuple(r) for r in docs.collect()}
    assert rows and rows <= before and (name == "quality" or len(rows) < len(before))


def test_tables_without_margins(make_docs):
    docs = make_docs(TEXTS).drop("source", "lang")
    assert 0 < mixing.sample_documents(docs, budget=0.5).count() < len(TEXTS)
    assert [name for name, _ in corpus_pipeline.STAGES][3] == "mixing"


def test_margins_that_contradict_each_other_are_reported(spark, make_docs):
    docs = spark.createDataFrame([(1, "a b c", "x", "p"), (2, "d e f", "y", "q")], "doc_id long, text string, source string, lang string")
    targets = {
        m: spark.createDataFrame([(a, 0.9), (b, 0.1)], "value string, share double") for m, (a, b) in {"source": "xy", "lang": "qp"}.items()
    }
    with pytest.warns(UserWarning, match="contradict"):
        cells = mixing.fit_mixture(mixing.described(docs), targets=targets).collect()
    assert all(c.deviation > 1 for c in cells)
