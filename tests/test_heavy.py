import pytest
from pyspark.sql import functions as F

from hitledger import GroupingRules, GroupRule, names
from hitledger.operators import counting, heavy, ranking
from hitledger.sinks import tables


@pytest.fixture(scope="module")
def lines(spark):
    """A few frequent paths, ties, and 20,000 paths of one line each; some lines are junk."""
    n = F.col("id")
    path = F.when(n < 20_000, F.concat(F.lit("/once/"), n)).otherwise(F.concat(F.lit("/often/"), F.floor(F.sqrt(n - 20_000)).cast("int") % 60))
    line = F.concat(F.lit("9.9.9."), n % 7, F.lit(' - - [13/Jul/2023:09:22:11 +0000] "GET '), path, F.lit(' HTTP/1.1" 200 '), n % 1000, F.lit(' "-" "ua"'))
    return spark.range(40_000).select(F.when(n % 97 == 0, "junk").otherwise(line).alias("value"))


@pytest.fixture(scope="module")
def counters(lines):
    return tables.materialize(counting.count_lines(lines, kinds=[names.DIMENSION_KINDS["path"], names.TOTAL]))


@pytest.mark.parametrize("sort_by, top", [("visits", 30), ("traffic", 0), ("traffic", 1), ("traffic", 300)])
def test_equal_to_the_full_count(lines, counters, sort_by, top):
    wanted = ranking.top_rows(counters, "path", sort_by, top).collect()
    assert heavy.top_rows_of_lines(lines, "path", sort_by, top, cells=1 << 10).collect() == wanted
    assert len(wanted) == top


def test_rules_and_few_cells(lines, spark):
    rules = GroupingRules(path=GroupRule(r"^(/\w+/\d).*$", "$1"))
    counters = counting.count_lines(lines, rules, [names.DIMENSION_KINDS["path"], names.TOTAL])
    wanted = ranking.top_rows(counters, "path", "visits", 12).collect()
    for cells in (1, 3):
        assert heavy.top_rows_of_lines(lines, "path", "visits", 12, rules, cells).collect() == wanted
    assert heavy.top_rows_of_lines(lines.limit(0), "ip").collect() == []
    assert heavy.top_rows_of_lines(spark.createDataFrame([("junk",)], "value string"), "ip").collect() == []


def test_most_buckets_are_never_counted(lines, monkeypatch):
    counted, plain = [], heavy._counted

    def count(rows, key):
        out = plain(rows, key)
        counted.append((key, out.count()))
        return out

    monkeypatch.setattr(heavy, "_counted", count)
    assert heavy.top_rows_of_lines(lines, "path", "visits", 10).count() == 10
    assert sum(n for key, n in counted if key == "bucket") < 20_060 / 50
