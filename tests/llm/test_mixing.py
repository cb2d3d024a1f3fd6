import numpy as np
import pytest

from hitledger.llm import mixing as m


def rows_of(spark, cells):
    rows = [(i, s, l, t, n) for i, (s, l, t, n) in enumerate(cells)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")


CELLS = [(f"s{k % 5}", f"l{k % 3}", f"t{k % 4}", 10 + 37 * k % 400) for k in range(600)] + [("s0", "l0", "t0", 100)] * 400


def shares(spark, **given):
    return {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in given.items()}


def raked_by_hand(cells, targets, rounds=200):
    w = {}
    for s, l, t, n in cells:
        w[s, l, t] = w.get((s, l, t), 0) + n
    natural, total = dict(w), sum(w.values())
    for _ in range(rounds):
        for k, name in enumerate(("source", "lang", "topic")):
            values = {c[k] for c in w}
            own = {v: sum(x for c, x in natural.items() if c[k] == v) for v in values}
            given = targets.get(name, {})
            set_t, set_share = sum(own[v] for v in values if v in given), sum(given[v] for v in values if v in given)
            now = {v: sum(x for c, x in w.items() if c[k] == v) for v in values}
            for c in w:
                share = given[c[k]] / set_share * set_t / total if c[k] in given else own[c[k]] / total
                w[c] *= share * total / now[c[k]]
    return {c: x / natural[c] for c, x in w.items()}


def test_weights_like_a_plain_raking(spark):
    targets = {"source": {"s0": 1.0, "s1": 1.0, "s2": 1.0, "s3": 2.0, "s4": 1.0, "absent": 9.0}, "lang": {"l0": 0.5}}
    fitted = m.rake(m.cells_of(rows_of(spark, CELLS)), shares(spark, **targets), tolerance=1e-10, sweeps=30).collect()
    expected = raked_by_hand(CELLS, targets)
    assert len(fitted) == len(expected)
    for r in fitted:
        assert r.weight == pytest.approx(expected[r.source, r.lang, r.topic], rel=1e-4)


@pytest.mark.parametrize("budget", [0.2, 0.8, 1.0])
def test_expected_tokens_meet_the_budget(spark, budget):
    targets = shares(spark, source={f"s{k}": 1.0 for k in range(5)})
    fitted = m.fit_mixture(rows_of(spark, CELLS), budget, targets).collect()
    expected = sum(r.tokens * r.probability for r in fitted)
    assert expected == pytest.approx(budget * sum(r.tokens for r in fitted))
    assert all(0 <= r.probability <= 1 for r in fitted)


def test_sampling_follows_the_probabilities(spark):
    rows = rows_of(spark, CELLS * 10)
    found = m.sample(rows, m.fit_mixture(rows)).toPandas()
    assert len(found) == len(CELLS) * 10
    assert abs(found.sampled.mean() - found.probability.mean()) < 0.02
    again = m.sample(rows, m.fit_mixture(rows)).toPandas()
    assert found.set_index("doc_id").sampled.sort_index().equals(again.set_index("doc_id").sampled.sort_index())
    other = m.sample(rows, m.fit_mixture(rows), seed=1).toPandas()
    assert (other.set_index("doc_id").sampled.sort_index() != found.set_index("doc_id").sampled.sort_index()).mean() > 0.1


def test_awkward_documents(make_docs):
    texts = ["some words here", None, "", "x " * 100_000, "a | b | c", "a!! b!!", "some words here", "p\nq\nr"]
    docs = make_docs(texts, [0, 1, 2, 3, 4, None, 0, 7])
    found = m.mix(docs).collect()
    assert len(found) == 8
    assert {r.topic for r in found} == {"note", "empty", "article", "table", "marked", "lines"}
    assert sorted(r.n_tokens for r in found) == sorted(len((t or "").split()) for t in texts)
    sampled = m.sample_documents(docs)
    assert sampled.columns == docs.columns
    ids = sorted(r.doc_id for r in found if r.sampled and r.doc_id is not None)
    assert sorted(r.doc_id for r in sampled.collect() if r.doc_id is not None) == ids


def test_no_rows(make_docs):
    assert m.mix(make_docs([])).count() == 0
    assert m.sample_documents(make_docs([])).count() == 0


def test_main_path_runs_no_python(make_docs):
    plan = m.mix(make_docs(["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_draws_are_even(spark):
    drawn = np.sort([r[0] for r in spark.range(4000).select(m.draw(m.F.col("id"), 3)).collect()])
    assert np.abs(drawn - np.arange(4000) / 4000).max() < 0.03
