import zlib

import numpy as np

from hitledger.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    own = [(r.quality, found[r.doc_id].score) for r in labels.collect() if found[r.doc_id].held_out]
    good, bad = [s for y, s in own if y], [s for y, s in own if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.7 for s in good]) > 0.98


def test_filter_agrees_with_the_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.classify(docs, labels).collect() if r.predicted}


def test_the_filter_runs_one_python_step_in_a_stage(spark, make_docs, monkeypatch):
    fit, seen = q.fit, []
    monkeypatch.setattr(q, "fit", lambda features, labels: seen.append(features) or fit(features, labels))
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    kept = q.keep_good(make_docs(["plain words here.", "!!! ###", None, "more plain words."]), labels)
    python = [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for df in (*seen, kept)]
    assert python == [0, 1]


def test_awkward_rows_and_labels(spark, make_docs):
    texts = [None, "", "plain words here.", "!!! ###", "x" * 300_000, "plain words here.", "\n\n\n"]
    labels = spark.createDataFrame([(0, 1), (2, 1), (2, 1), (3, 0), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    found = q.classify(make_docs(texts, [0, 1, 2, 3, 4, 2, None]), labels).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert q.classify(make_docs([]), labels).count() == 0
    unlabelled = q.classify(make_docs(texts), labels.limit(0)).collect()
    assert {round(r.score, 6) for r in unlabelled} == {0.5}


def test_score_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    d = 4
    groups = [rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + k for k in (0, 1)]
    model = q.Discriminant.fit(np.array([300.0, 300.0]), np.stack([g.sum(0) for g in groups]), np.stack([g.T @ g for g in groups]), 0.0, 0.0)
    x = rng.normal(size=(20, d))
    log = []
    for g in groups:
        cov = np.cov(g.T, bias=True) + q.RIDGE * np.eye(d)
        z = x - g.mean(0)
        log.append(-0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))
