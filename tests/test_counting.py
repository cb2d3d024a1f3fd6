import pytest
from pyspark.sql import functions as F

from hitledger import GroupingRules, GroupRule, names
from hitledger.functions.display import human_bytes, percent_text, trend_label, truncate_label
from hitledger.operators import counting, ranking
from hitledger.operators.parsing import parse_lines
from hitledger.plans.event_logs import event_lines
from hitledger.sinks.scratch import scratch_path
from tests.conftest import SF_DIR, counter_table


def log_line(ip="1.1.1.1", path="/x", status="200", size="5", agent="ua", time="28/Feb/2024:23:41:07"):
    return f'{ip} - - [{time} +0000] "GET {path} HTTP/1.1" {status} {size} "-" "{agent}"'


def as_dict(counters):
    rows = counters.collect()
    result = {(r.kind, r.bucket): (r.visits, r.traffic_bytes) for r in rows}
    assert len(result) == len(rows)
    return result


@pytest.fixture(scope="module")
def events(spark):
    return event_lines(spark, SF_DIR).select("event_type", "value")


@pytest.fixture(scope="module")
def whole(events):
    return as_dict(counting.count_lines(events))


def test_all_kinds_of_a_small_log(lines_of):
    lines = lines_of(
        [
            log_line(size="77", path="/feed", agent="Reader 2"),
            log_line(size="5", path="/feed", agent="Reader 2", time="28/Feb/2024:23:00:00"),
            log_line(size=str(2**63), time="bad"),
            log_line(size=str(9 * 10**18), time="bad"),
            log_line(size=str(9 * 10**18), time="bad"),
            "junk",
        ]
    )
    huge = 2**63 + 18 * 10**18
    assert as_dict(counting.count_lines(lines)) == {
        ("dimension:ip", "1.1.1.1"): (5, huge + 82),
        ("dimension:path", "/feed"): (2, 82),
        ("dimension:path", "/x"): (3, huge),
        ("dimension:user-agent", "Reader 2"): (2, 82),
        ("dimension:user-agent", "ua"): (3, huge),
        ("dimension:status", "200"): (5, huge + 82),
        ("trend:hour", "2024-02-28 23:00"): (2, 82),
        ("trend:day", "2024-02-28"): (2, 82),
        ("trend:month", "2024-02"): (2, 82),
        ("meta:total", "all"): (5, huge + 82),
        ("meta:parse_errors", "all"): (1, 0),
    }


def test_rules_rewrite_three_dimensions_but_not_the_status(lines_of):
    everything = GroupRule("^.*$", "all")
    rules = GroupingRules(everything, everything, everything)
    lines = lines_of([log_line(), log_line(ip="2", path="/y", status="404", agent="b")])
    counted = as_dict(counting.count_lines(lines, rules))
    dimensions = {key for key in counted if key[0].startswith("dimension:")}
    assert dimensions == {
        ("dimension:ip", "all"),
        ("dimension:path", "all"),
        ("dimension:user-agent", "all"),
        ("dimension:status", "200"),
        ("dimension:status", "404"),
    }


def test_dimensions_add_up_to_the_total_and_trends_to_the_dated_part(whole, events):
    total = whole["meta:total", "all"]

    def added(kind):
        values = [v for (k, _), v in whole.items() if k == kind]
        return tuple(map(sum, zip(*values)))

    for kind in names.DIMENSION_KINDS.values():
        assert added(kind) == total
    dated = {added(kind) for kind in names.TREND_KINDS.values()}
    assert len(dated) == 1 and dated.pop() < total
    assert total[0] + whole["meta:parse_errors", "all"][0] == events.count()


def test_merged_parts_equal_the_whole(events, whole):
    kinds = [r.event_type for r in events.select("event_type").distinct().collect()]
    parts = [counting.count_lines(events.where(F.col("event_type") == k)) for k in kinds]
    assert as_dict(counting.merge_counters(*parts)) == whole


def test_some_kinds_equal_the_same_part_of_all(events, whole):
    kinds = [names.DIMENSION_KINDS["status"], names.PARSE_ERRORS]
    assert as_dict(counting.count_lines(events, kinds=kinds)) == {
        key: value for key, value in whole.items() if key[0] in kinds
    }
    with pytest.raises(ValueError, match="nothing to count"):
        counting.count_lines(events, kinds=["dimension:referer"])


def test_no_lines_give_zeros_not_nulls(lines_of):
    none = counting.with_file_count(counting.count_lines(lines_of(["x"]).limit(0)), 1)
    assert tuple(counting.summary(none, "traffic").first()) == (0, 0, 0, 1, "traffic")
    assert ranking.top_rows(none, "ip").collect() == []
    assert ranking.top_rows_all(none).collect() == []
    assert ranking.page_of_rows(none, "ip", scroll=3).collect() == []
    assert counting.date_series(none, "day").collect() == []
    assert ranking.trend_points(none, "day").collect() == []


def counters(spark, dimension, rows, total):
    kind = names.DIMENSION_KINDS[dimension]
    data = [(kind, *row) for row in rows] + [(names.TOTAL, names.META_BUCKET, *total)]
    return counter_table(spark, data)


@pytest.fixture(scope="module")
def four(spark):
    return counters(
        spark, "ip", [("k", 3, 64), ("w", 19, 12), ("m", 6, 900), ("f", 12, 24)], (40, 1000)
    )


def keys(rows):
    return [r.key for r in rows.collect()]


def test_top_two_of_four(four):
    assert keys(ranking.top_rows(four, "ip", "visits", 2)) == ["w", "f"]
    assert keys(ranking.top_rows(four, "ip", "traffic", 2)) == ["m", "k"]
    assert keys(ranking.top_rows(four, "ip", "visits", 0)) == []
    assert keys(ranking.top_rows(four, "ip")) == ["w", "f", "m", "k"]


def test_shares_are_of_everything_and_not_of_the_top(four):
    row = ranking.top_rows(four, "ip", "visits", 1).first()
    assert row.asDict() == {
        "key": "w",
        "visits": 19,
        "traffic_bytes": 12,
        "visit_pct": 19 / 40 * 100,
        "traffic_pct": 12 / 1000 * 100,
    }


def test_shares_of_nothing_are_zero(spark):
    rows = counters(spark, "path", [("/a", 2, 0)], (2, 0))
    assert ranking.top_rows(rows, "path").first().traffic_pct == 0.0


def test_ties_go_by_visits_then_by_bytes_of_the_key(spark):
    tied = [("b", 1, 9), ("a", 1, 9), ("Z", 1, 9), ("é", 1, 9), ("more", 2, 9), ("\U0001f600", 1, 9)]
    rows = counters(spark, "path", tied, (7, 54))
    expected = ["more", "Z", "a", "b", "é", "\U0001f600"]
    assert keys(ranking.top_rows(rows, "path", "traffic")) == expected
    assert keys(ranking.top_rows(rows, "path", "traffic", 2)) == expected[:2]


def test_unknown_names_are_errors(four):
    for call in (
        lambda: ranking.top_rows(four, "referer"),
        lambda: ranking.top_rows(four, "ip", "bytes"),
        lambda: counting.date_series(four, "week"),
        lambda: counting.summary(four, "bytes"),
    ):
        with pytest.raises(ValueError, match="must be one of"):
            call()


@pytest.mark.parametrize("top", [0, 1, 3, 100_000])
def test_all_dimensions_at_once_equal_one_by_one(events, top):
    # the last value is above the limit to which Spark cuts windows early
    table = counting.count_lines(events).cache()
    together = [tuple(r) for r in ranking.top_rows_all(table, "traffic", top).collect()]
    each = [tuple(r) for r in ranking.top_rows_each(table, "traffic", top).collect()]
    assert sorted(each) == sorted(together)
    apart = []
    for dimension in names.DIMENSION_KINDS:
        rows = ranking.top_rows(table, dimension, "traffic", top).collect()
        apart += [(dimension, i, *row) for i, row in enumerate(rows, start=1)]
    assert sorted(together) == sorted(apart)
    assert len(apart) == 0 if top == 0 else len(apart) >= 4
    table.unpersist()


def test_pages(four):
    def page(scroll, visible, top=30):
        return keys(ranking.page_of_rows(four, "ip", "visits", top, scroll, visible))

    assert page(0, 2) == ["w", "f"]
    assert page(1, 2) == ["f", "m"]
    assert page(9, 3) == ["f", "m", "k"]
    assert page(0, 9) == ["w", "f", "m", "k"]
    assert page(2, 2, top=3) == ["f", "m"]


def test_bars(spark):
    rows = counters(spark, "path", [("/a-long-path-name", 3, 13 * 2**19), ("/é" * 7, 2, 5)], (5, 9))
    assert [tuple(r) for r in ranking.bar_series(rows, "path", "traffic").collect()] == [
        (1, "/a-long-path-~", 13 * 2**19, "6.50 MB"),
        (2, "/é" * 7, 5, "5 B"),
    ]
    only = ranking.bar_series(rows, "path", "visits", 30, graph_items=1)
    assert [tuple(r) for r in only.collect()] == [(1, "/a-long-path-~", 3, "3")]


def test_trend_points_and_series_are_in_text_order(lines_of):
    hours = ["14/Jul/2023:01", "13/Jul/2023:23", "13/Jul/2023:09", "01/Jan/2024:00"]
    table = counting.count_lines(lines_of([log_line(time=f"{h}:00:00") for h in hours]))
    expected = ["2023-07-13 09:00", "2023-07-13 23:00", "2023-07-14 01:00", "2024-01-01 00:00"]
    assert [r.bucket for r in counting.date_series(table, "hour").collect()] == expected
    points = ranking.trend_points(table, "hour").orderBy("x").collect()
    assert [(p.x, p.label) for p in points] == list(enumerate(b[5:13] for b in expected))
    days = ranking.trend_points(table, "day").orderBy("x").collect()
    assert [(d.label, d.visits) for d in days] == [("07-13", 2), ("07-14", 1), ("01-01", 1)]
    months = ranking.trend_points(table, "month").orderBy("x").collect()
    assert [m.label for m in months] == ["2023-07", "2024-01"]


def python_bytes(value):
    size, unit = value, 0
    while size >= 1024 and unit < 4:
        size, unit = size / 1024, unit + 1
    return f"{value} B" if unit == 0 else f"{size:.2f} {['', 'KB', 'MB', 'GB', 'TB'][unit]}"


def test_human_bytes(spark):
    values = [0, 1, 1023, 1024, 1152, 1408, 1664, 1048575, 1048576, 7 * 2**19, 5 * 2**37, 2**40 - 1]
    values += [2**40 + 2**33, 2**50 + 12345, *(7**n for n in range(4, 18)), 2**53 - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    rows = frame.select("v", human_bytes(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {v: python_bytes(v) for v in values}
    assert python_bytes(1152) == "1.12 KB" and python_bytes(1048575) == "1024.00 KB"


def test_percent_text(spark):
    totals = (3, 7, 8, 32, 800, 9896, 20000, 64000, 10**9)
    values = sorted({n / t * 100 for t in totals for n in (0, 1, 2, 3, 5, 203, t // 3, t - 1, t) if n <= t})
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", percent_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {v: f"{v:.2f}%" for v in values}


def test_labels(spark):
    row = spark.range(1).select(
        trend_label(F.lit("2023-07-13 09"), "hour").alias("hour"),
        trend_label(F.lit("2023-07-13"), "day").alias("day"),
        trend_label(F.lit("2023"), "day").alias("short"),
        trend_label(F.lit("2023-07"), "month").alias("month"),
        truncate_label(F.lit("x" * 15)).alias("long"),
        truncate_label(F.lit("é" * 14)).alias("fits"),
    )
    assert tuple(row.first()) == ("07-13 09", "07-13", "2023", "2023-07", "x" * 13 + "~", "é" * 14)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(events):
    table = counting.count_lines(events)
    plan = plan_of(table)
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan
    top = plan_of(ranking.top_rows(table, "path", "traffic"))
    assert "TakeOrderedAndProject" in top and top.count("FileScan") == 1
    assert top.count("Exchange") == 1
    everything = plan_of(ranking.top_rows_all(table))
    # the best of each part of a dimension, then of the dimension: before and after an exchange each
    assert everything.count("WindowGroupLimit") == 4 and everything.count("FileScan") == 1
    assert everything.count("row_number(), 30, Partial") == 2 and "hashpartitioning(kind#" in everything
    assert "TakeOrderedAndProject" in top and "rangepartitioning" not in top


@pytest.fixture(scope="module")
def forged(spark):
    """Counters of a log whose paths and times are all different, with ties; and their totals."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, names.DIMENSION_KINDS["path"]).otherwise(names.TREND_KINDS["hour"]).alias("kind"),
        F.concat(F.lit("b"), F.col("id") * 7919 % 30_011).alias("bucket"),
        (F.col("id") % 40).alias("visits"),
        (F.col("id") % 90).cast(names.BYTES_TYPE).alias("traffic_bytes"),
    )
    total = rows.where(F.col("kind") == names.DIMENSION_KINDS["path"]).agg(
        F.lit(names.TOTAL).alias("kind"), F.lit("all").alias("bucket"), F.sum("visits").alias("visits"), F.sum("traffic_bytes").cast(names.BYTES_TYPE).alias("traffic_bytes")
    )
    path = scratch_path(spark, "forged")
    rows.unionByName(total).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("sort_by", ["visits", "traffic"])
def test_long_rankings_equal_short_ones(forged, sort_by, monkeypatch):
    monkeypatch.setattr(ranking, "IN_ONE_TASK", 1 << 30)
    one_task = {n: ranking.top_rows(forged, "path", sort_by, n).collect() for n in (200, 14_000, 16_000)}
    page = ranking.page_of_rows(forged, "path", sort_by, 12_000, 11_995, 20).collect()
    bars = ranking.bar_series(forged, "path", sort_by, 50_000).collect()
    monkeypatch.setattr(ranking, "IN_ONE_TASK", 100)
    for n, rows in one_task.items():
        assert ranking.top_rows(forged, "path", sort_by, n).collect() == rows
    assert ranking.top_rows(forged, "path", sort_by, 50_000_000).collect() == one_task[16_000]
    assert len(one_task[16_000]) == 15_000
    assert ranking.page_of_rows(forged, "path", sort_by, 12_000, 11_995, 20).collect() == page
    assert [r["rank"] for r in page] == list(range(11_981, 12_001))
    assert ranking.bar_series(forged, "path", sort_by, 50_000).collect() == bars
    each = ranking.top_rows_all(forged, sort_by, 14_000)
    assert sorted(each.where("dimension = 'path'").drop("dimension").drop("rank").collect()) == sorted(one_task[14_000])


def test_long_rankings_without_single_tasks(forged):
    for frame in (
        ranking.top_rows(forged, "path", "visits", 50_000_000),
        ranking.page_of_rows(forged, "path", "visits", 50_000_000, 10_000_000, 50),
        ranking.trend_points(forged, "hour"),
    ):
        plan = plan_of(frame)
        assert "Window" not in plan and "SinglePartition" not in plan
    assert "TakeOrderedAndProject" in plan_of(ranking.top_rows(forged, "path", "visits", 30))


def test_long_rankings_of_few_or_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "IN_ONE_TASK", 0)
    path, total = names.DIMENSION_KINDS["path"], names.TOTAL
    for rows in ([], [(path, "/a", 3, 0)], [(total, "all", 0, 0)], [(total, "all", 4, 9), (path, "/a", 3, 0), (path, None, 1, 9)]):
        counters = counter_table(spark, rows)
        found = ranking.top_rows(counters, "path", "visits", 5).collect()
        assert [r.key for r in found] == [r[1] for r in rows if r[0] == path]
        page = ranking.page_of_rows(counters, "path", "visits", 5, 3, 1).collect()
        assert [r.key for r in page] == [r.key for r in found[-1:]]
        assert ranking.top_rows(counters, "path", "visits", 0).collect() == []
    assert [(r.visit_pct, r.traffic_pct) for r in found] == [(75.0, 0.0), (25.0, 100.0)]


def test_positions_of_a_series(forged):
    rows = ranking.trend_points(forged, "hour").collect()
    assert [r.x for r in rows] == list(range(15_000))
    assert [r.bucket for r in rows] == sorted(r.bucket for r in forged.where("kind = 'trend:hour'").collect())


def test_one_dimension_parses_only_its_fields(events):
    counted = counting.count_lines(events, kinds=[names.DIMENSION_KINDS["status"]])
    plan = plan_of(counted)
    assert "_agent" not in plan and "timestamp_str" not in plan


def test_generated_code_is_small_enough_for_the_jvm_to_compile(spark, events, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (parse_lines(events), counting.count_lines(events)):
            frame.explain("codegen")
            sizes = [
                int(part.split(";")[0])
                for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]
            ]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_key_with_most_lines_is_counted_before_the_shuffle(spark):
    hot = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "9.9.9.9")
        .otherwise(F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string")))
        .alias("ip"),
        F.lit("/hot").alias("path"),
    )
    lines = hot.select(
        F.concat(
            "ip", F.lit(' - - [13/Jul/2023:09:22:11 +0000] "GET '), "path",
            F.lit(' HTTP/1.1" 200 5 "-" "ua"'),
        ).alias("value")
    )
    counted = as_dict(counting.count_lines(lines))
    assert counted["dimension:ip", "9.9.9.9"] == (66_667, 333_335)
    assert counted["dimension:path", "/hot"] == (200_000, 1_000_000)
    assert "partial_count" in plan_of(counting.count_lines(lines))
