import itertools

import numpy as np
import pytest

from hitledger.llm import transcripts as t

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


@pytest.fixture(scope="module")
def model(turns):
    return t.RoleModel.fit(turns)


def test_segments_decode_to_the_best_path_of_all(model):
    rng = np.random.default_rng(2)
    for _ in range(6):
        seen = [(int(rng.integers(0, 5)), int(rng.integers(0, t.LOOKS))) for _ in range(5)]

        def score(path):
            steps = sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + steps + sum(model.show[m, k, s] for (m, k), s in zip(seen, path))

        best = max(itertools.product(range(6), repeat=5), key=score)
        end = model.opening(seen)
        assert end.max() == pytest.approx(score(best))
        assert model.decode(seen, -1, int(end.argmax())) == list(best)
        cut = (model.opening(seen[:2])[:, None] + model.matrix(seen[2:])).max(0)
        assert cut == pytest.approx(end)


def test_roles_come_back(spark, turns, model):
    found = t.parse_transcripts(t.marked_parts(turns), model).where("not continues").select("conv_id", "turn", "role")
    right = turns.select("conv_id", "turn", "role").intersect(found).count()
    assert right > 0.8 * turns.count()


def test_segment_length_changes_nothing(turns, model):
    parts = t.marked_parts(turns)
    whole, cut = (sorted((r.conv_id, r.turn, r.role, r.continues) for r in t.parse_transcripts(parts, model, segment=n).where("not continues").collect()) for n in (1000, 2))
    assert whole == cut


def test_turns_over_cuts_are_whole(spark, turns, model):
    long = [(10**6, k, ("User: " if k % 9 == 0 else "Assistant: " if k % 9 == 4 else "") + f" line {k}\n  and more \n") for k in range(40)]
    long += [(None, k, f"  line {k} ") for k in range(5)]
    parts = t.marked_parts(turns).unionByName(spark.createDataFrame(long, "conv_id long, turn long, text string"))
    whole, *cut = (sorted(map(tuple, t.parse_transcripts(parts, model, segment=n).collect()), key=str) for n in (1000, 7, 2, 1))
    assert all(x == whole for x in cut)


def test_markers():
    for line, role, text in [
        ("User: hi", 1, "hi"), ("### Assistant:", 2, ""), ("<|im_start|>system", 0, ""), ("**Human:** yes", 1, "yes"), ("A: it is", 2, "it is"),
        ("A cat sat", t.NONE, "A cat sat"), ("Anna: hello", t.NAME, "Anna: hello"), ("", t.NONE, ""), ("done<|im_end|>", t.NONE, "done"),
    ]:
        marker, _, rest = t.read_line(line)
        assert (marker, rest) == (role, text), line


def test_awkward_rows(spark, model):
    rows = [(1, 0, "User: hi\nAssistant: ho"), (1, 1, None), (1, 1, "User: again"), (None, None, "User: x"), (None, 3, ""), (2, 0, "y " * 100_000), (1, 0, "User: hi\nAssistant: ho")]
    parts = spark.createDataFrame([(*r, "segment", 1) for r in rows], "conv_id long, turn long, text string, role string, entry int")
    found = t.parse_transcripts(parts, model).collect()
    assert sum(r.n_lines for r in found) == 9
    assert {r.conv_id for r in found} == {1, 2, None}
    rendered = {r.rendered for r in found if r.conv_id == 1}
    assert "<|im_start|>user\nhi<|im_end|>\n" in rendered and "<|im_start|>assistant\nho<|im_end|>\n" in rendered
    assert t.parse_transcripts(parts.limit(0), model).count() == 0


def test_turns_without_numbers_are_cut_too(spark, model, monkeypatch):
    rows = [("c é", None, f"User: number {k:05d}") for k in range(5_000)] + [("d", 7, f"Assistant: {k}") for k in range(700)]
    sizes, plain = [], t.written

    def written(df, what):
        out = plain(df, what)
        if what == "segments":
            sizes.extend(r.n for r in out.selectExpr("size(turns) AS n").collect())
        return out

    monkeypatch.setattr(t, "written", written)
    found = t.parse_transcripts(spark.createDataFrame(rows, "conv_id string, turn long, text string"), model).collect()
    assert max(sizes) <= t.SEGMENT and sum(sizes) == 5_700
    assert sum(r.n_lines for r in found) == 5_700 and {r.conv_id for r in found} == {"c é", "d"}
    said = "".join(r.rendered for r in found if r.conv_id == "c é")
    assert all(f"number {k:05d}" in said for k in range(5_000))


def test_a_model_of_no_turns(spark, turns):
    model = t.RoleModel.fit(turns.limit(0))
    assert np.isfinite(model.step).all() and t.parse_transcripts(t.marked_parts(turns), model).count() > 0
