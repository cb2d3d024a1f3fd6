import pytest
from pyspark.sql import functions as F

from hitledger.operators.positions import OrderedRows


@pytest.fixture(scope="module")
def letters(spark):
    rows = [(None, 9)] + [(f"k{i % 70:03d}", i % 70) for i in range(700)]
    return spark.createDataFrame(rows, "place string, `range` int")


@pytest.mark.parametrize("ranges", [1, 7, 100, None])
def test_positions_follow_the_order(letters, ranges):
    order = [F.desc("place"), F.asc("range")]
    ordered = OrderedRows(letters, order, ranges)
    assert len(ordered) == 701
    wanted = [tuple(r) for r in letters.orderBy(*order).collect()]
    found = sorted(ordered.between(name="x").collect(), key=lambda r: r.x)
    assert [r.x for r in found] == list(range(701))
    assert [(r.place, r["range"]) for r in found] == wanted
    part = sorted(ordered.between(695, 2000).collect(), key=lambda r: r.position)
    assert [(r.place, r.position) for r in part] == [(w[0], i) for i, w in enumerate(wanted)][695:]


def test_parts_read_their_ranges_alone(letters):
    ordered = OrderedRows(letters, [F.asc("place")], 10)
    plan = ordered.between(100, 110)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "GreaterThanOrEqual(place_" in plan and "Window" not in plan


def test_no_rows(letters):
    ordered = OrderedRows(letters.limit(0), [F.asc("place")])
    assert len(ordered) == 0 and ordered.between().collect() == []
    assert ordered.between(3, 8).columns == ["place", "range", "position"]
    assert OrderedRows(letters, [F.asc("place")]).between(5, 5).collect() == []
