import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hitledger import Ledger, analyze, names
from hitledger.operators import counting
from hitledger.plans import ledger as ledger_plan
from hitledger.plans.ledger import load_counters
from hitledger.sinks import json_document, tables
from hitledger.sinks.scratch import scratch_path
from hitledger.sources import any_document
from hitledger.sources.any_document import read_any
from hitledger.sources.compact_document import read_compact
from hitledger.sources.log_files import read_lines
from tests.conftest import counter_table
from tests.test_counting import as_dict, log_line

# buckets that quoting, trimming and escaping could damage
ODD_AGENTS = [
    "", "a,b", 'q"uote', " lead", "trail ", "tab\t", "cr\rin", "back\\slash", "#hash", "'", "null",
    "é😀", "{}", "},", "NULL", "\x01", "a\\", "line end", "/",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Counters with every odd agent, the visits of each telling it from the others."""
    rows = [("dimension:user-agent", agent, i + 1, i) for i, agent in enumerate(ODD_AGENTS)]
    rows += [("dimension:path", f"/{i:03d}", i + 1, 2**62 if i == 0 else i) for i in range(120)]
    rows += [
        ("dimension:ip", "fe80::9", 11, 2**70),
        ("dimension:status", "503", 11, 2**70),
        ("trend:month", "1999-12", 11, 2**70),
        ("trend:day", "1999-12-31", 11, 2**70),
        ("trend:hour", "1999-12-31 22:00", 4, 6),
        ("trend:hour", "1999-12-31 03:00", 7, 2**70 - 6),
        ("meta:total", "all", 11, 2**70),
        ("meta:parse_errors", "all", 5, 0),
        ("meta:files", "all", 7, 0),
    ]
    return counter_table(spark, rows).repartition(4)


def part_files(folder, pattern="part-*"):
    return sorted(p for p in Path(folder).rglob(pattern) if not p.name.startswith("."))


def test_snapshot_round_trip_and_pruning(spark, odd, tmp_path):
    path = str(tmp_path / "snapshot")
    tables.save_snapshot(odd, path)
    loaded = tables.load_snapshot(spark, path)
    assert loaded.schema == names.COUNTER_SCHEMA
    assert as_dict(loaded) == as_dict(odd)
    files = part_files(tmp_path / "snapshot" / "kind=dimension%3Apath")
    assert 1 <= len(files) <= tables.LEAST_BUCKETS == tables.snapshot_buckets(spark, path)
    plan = counting.dimension_counters(loaded, "ip")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(kind" in plan.toString()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.save_snapshot(odd, path)
    tables.save_snapshot(odd.limit(1), path, mode="overwrite")
    assert tables.load_snapshot(spark, path).count() == 1


def test_a_big_kind_is_split_over_files(spark, tmp_path):
    big = spark.range(300_000).selectExpr(
        "'dimension:path' AS kind", "concat('/', uuid()) AS bucket", "1L AS visits", "id AS traffic_bytes"
    )
    counters = big.unionByName(big.limit(1).withColumn("kind", F.lit("meta:total")))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for adaptive, files in (("true", range(3, 60)), ("false", range(1, 60))):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set(size, "2m")
        try:
            path = tmp_path / adaptive
            tables.save_snapshot(counters, str(path))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset(size)
        assert len(part_files(path / "kind=dimension%3Apath")) in files
        assert tables.load_snapshot(spark, str(path)).count() == 300_001


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [(8, 8), (8, 32), (100, 16)])
def test_snapshots_are_added_up_without_a_shuffle(spark, odd, tmp_path, buckets, monkeypatch):
    other = odd.where("kind <> 'trend:hour'").withColumn("bucket", F.when(F.col("visits") % 2 == 0, F.concat("bucket", F.lit("'x\\"))).otherwise(F.col("bucket")))
    paths = [str(tmp_path / name) for name in ("it's one", "two", "merged")]
    for rows, path, many in zip((odd, other), paths, buckets):
        tables.save_snapshot(rows, path, buckets=many)
    plans, plain = [], tables.merged_buckets

    def merged_buckets(*args):
        out = plain(*args)
        plans.append(plan_of(out))
        return out

    monkeypatch.setattr(tables, "merged_buckets", merged_buckets)
    ledgers = [Ledger(tables.load_snapshot(spark, p), snapshot=p) for p in paths[:2]]
    merged = ledgers[0].merged_with(ledgers[1])
    assert as_dict(merged.counters) == as_dict(counting.merge_counters(odd, other))
    assert len(plans) == 1 and "Exchange" not in plans[0] and "SortMergeJoin" in plans[0]
    assert tables.snapshot_buckets(spark, merged.snapshot) == 1 << (min(buckets) - 1).bit_length()
    again = merged.merged_with(ledgers[0])
    assert as_dict(again.counters) == as_dict(counting.merge_counters(odd, other, odd))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hitledger_")]


def test_an_export_shuffles_no_dimension(spark, odd, tmp_path):
    path = str(tmp_path / "snapshot")
    tables.save_snapshot(odd, path)
    dimensions, series = tables._sections(tables.load_snapshot(spark, path))
    assert "Exchange" not in plan_of(dimensions)
    assert "rangepartitioning(section" in plan_of(series)


def test_csv_is_read_alike_by_others(odd, tmp_path):
    path = str(tmp_path / "export")
    tables.export_csv(odd, path)
    rows = []
    for part in part_files(path):
        with part.open(newline="", encoding="utf-8") as handle:
            header, *body = csv.reader(handle)
        assert header == ["kind", "bucket", "visits", "traffic_bytes"]
        rows += body
    expected = {
        (kind, bucket): tuple(map(str, counts))
        for (kind, bucket), counts in as_dict(odd).items()
        if not kind.startswith("meta:")
    }
    assert {(r[0], r[1]): tuple(r[2:]) for r in rows} == expected and len(rows) == len(expected)
    sections = [r[0] for r in rows]
    assert list(dict.fromkeys(sections)) == list(tables.EXPORT_ORDER)
    hours = [r[1] for r in rows if r[0] == "trend:hour"]
    assert hours == ["1999-12-31 03:00", "1999-12-31 22:00"]


def test_csv_text(odd, tmp_path):
    path = str(tmp_path / "export")
    tables.export_csv(odd, path, single_file=True)
    (part,) = part_files(path)
    text = part.read_bytes().decode()
    for line in (
        "kind,bucket,visits,traffic_bytes",
        f"dimension:ip,fe80::9,11,{2**70}",
        f"trend:day,1999-12-31,11,{2**70}",
        "dimension:user-agent,,1,0",
        'dimension:user-agent,"a,b",2,1',
        'dimension:user-agent,"q""uote",3,2',
        "dimension:user-agent, lead,4,3",
        "dimension:user-agent,trail ,5,4",
        "dimension:user-agent,back\\slash,8,7",
    ):
        assert f"{line}\n" in text, line


def test_csv_round_trip(spark, odd, tmp_path):
    path = str(tmp_path / "export")
    tables.export_csv(odd, path)
    expected = {k: v for k, v in as_dict(odd).items() if not k[0].startswith("meta:")}
    assert as_dict(tables.read_export(spark, path)) == expected


def test_json_document_round_trip(spark, odd, tmp_path):
    folder = str(tmp_path / "document")
    json_document.save_document(odd, folder)
    text = "".join(p.read_text(encoding="utf-8") for p in part_files(folder))
    document = json.loads(text)
    assert document["files_count"] == 7
    aggregates = document["aggregates"]
    assert [aggregates[k] for k in json_document.SCALARS] == [11, 2**70, 5]
    assert list(aggregates) == [*json_document.SCALARS, *json_document.MAPS]
    assert aggregates["user_agent"][""] == {"visits": 1, "traffic_bytes": 0}
    assert set(aggregates["user_agent"]) == set(ODD_AGENTS)
    assert aggregates["by_day"] == {"1999-12-31": {"visits": 11, "traffic_bytes": 2**70}}
    assert as_dict(load_counters(spark, folder)) == as_dict(odd)

    single = tmp_path / "single.json"
    single.write_text(json.dumps(document, ensure_ascii=False, separators=(",", ":")))
    assert as_dict(load_counters(spark, str(single))) == as_dict(odd)
    single.write_text(json.dumps(document, indent=1))
    assert as_dict(load_counters(spark, str(single))) == as_dict(odd)


@pytest.fixture()
def compact(odd, spark, tmp_path):
    """A path and the document of the odd counters, as nested dictionaries."""
    maps = {name: {} for name in json_document.MAPS}
    kinds = {kind: name for name, kind in json_document.MAPS.items()}
    expected = as_dict(odd)
    for (kind, bucket), (visits, traffic) in expected.items():
        if kind in kinds:
            maps[kinds[kind]][bucket] = {"visits": visits, "traffic_bytes": int(traffic)}
    scalars = {"total_visits": 11, "total_traffic_bytes": 2**70, "parse_errors": 5}
    return tmp_path / "compact.json", {"files_count": 7, "aggregates": {**scalars, **maps}}


def write_compact(path, document, end=""):
    text = json.dumps(document, ensure_ascii=False, separators=(",", ":"))
    path.write_text(text + end, encoding="utf-8")
    return text


def counters_of(document):
    """A document, as nested dictionaries, like as_dict."""
    scalars = document["aggregates"]
    expected = {(kind, bucket): (c["visits"], c["traffic_bytes"]) for name, kind in json_document.MAPS.items() for bucket, c in scalars[name].items()}
    expected["meta:total", "all"] = (scalars["total_visits"], scalars["total_traffic_bytes"])
    return {**expected, ("meta:parse_errors", "all"): (scalars["parse_errors"], 0), ("meta:files", "all"): (document["files_count"], 0)}


def in_parallel(spark, path):
    rows = read_compact(spark, str(path), json_document.MAPS)
    return None if rows is None else as_dict(rows)


def test_compact_document_is_read_in_parallel(spark, odd, compact):
    path, document = compact
    agents = document["aggregates"]["user_agent"]
    for tricky in ("visits", "ip", "by_day", 'x":{"visits":1', '},"', "}", '\\"', "},x"):
        agents[tricky] = {"visits": 5, "traffic_bytes": 6}
    # a map may begin with a bucket named like a field
    document["aggregates"]["by_day"] = {"visits": {"visits": 1, "traffic_bytes": 2}}
    write_compact(path, document, end="\n")
    expected = counters_of(document)
    assert len(expected) > 130 and expected["trend:day", "visits"] == (1, 2)
    assert in_parallel(spark, path) == expected
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.option("lineSep", '},"').text(str(path)).rdd.getNumPartitions() > 3
        assert in_parallel(spark, path) == expected
        rows = read_compact(spark, str(path), json_document.MAPS)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # splits differ from here on
        assert as_dict(rows) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_maps_of_a_compact_document(spark, compact):
    path, document = compact
    for empty in (["ip"], ["path", "user_agent"], ["by_month"], list(json_document.MAPS)):
        for name in empty:
            document["aggregates"][name] = {}
        write_compact(path, document)
        expected = counters_of(document)
        assert in_parallel(spark, path) == expected


def test_other_texts_are_left_to_the_whole_reader(spark, odd, compact):
    path, document = compact
    text = write_compact(path, document)
    assert in_parallel(spark, path) == as_dict(odd)  # a bucket name ends in the cut
    broken = [text[:-n] for n in (1, 2, 3, 4, 5, 40, len(text) // 2)]
    broken += [text + text, text.replace('"by_day"', '"by_week"'), text.replace(str(2**70), "-1", 1)]
    broken += [text.replace(f":{2**70}", f":{10**38}", 1), json.dumps(document), "", "}"]
    for changed in broken:
        path.write_text(changed, encoding="utf-8")
        assert in_parallel(spark, path) is None, changed[-50:]


def any_layout(spark, path):
    return as_dict(read_any(spark, str(path), json_document.MAPS, json_document.SCALARS))


@pytest.mark.parametrize("size", [None, "400"])
def test_documents_of_any_layout_are_read_in_parallel(spark, compact, size, monkeypatch):
    path, document = compact
    agents = document["aggregates"]["user_agent"]
    for tricky in ("visits", "ip", "by_day", 'x":{"visits":1', '},"', "}", "\\", '\\"', "\\\\", "},x", ': "', " [ ", "aggregates", "é🙂\n\t"):
        agents[tricky] = {"visits": 5, "traffic_bytes": 6}
    document["aggregates"]["ip"] = {}
    expected = counters_of(document)
    backwards = {k: dict(reversed(v.items())) if isinstance(v, dict) else v for k, v in reversed(document["aggregates"].items())}
    backwards["by_day"] = {k: {"note": [1, {"visits": "}"}], **dict(reversed(v.items()))} for k, v in backwards["by_day"].items()}
    texts = [
        json.dumps(document, indent=2, ensure_ascii=False),
        json.dumps(document, ensure_ascii=True, separators=(" ,\r\n", "\t: ")),
        json.dumps({"version": "1.0", "aggregates": {"other": {"a": {"visits": 1}}, **backwards}, "files_count": 7}, indent="\t"),
        json.dumps(document, separators=(",", ":")),
    ]
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        monkeypatch.setattr(any_document, "_CHUNK", 7)
    try:
        for text in texts[: 2 if size else 4]:
            path.write_text(text, encoding="utf-8")
            assert any_layout(spark, path) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = plan_of(spark.read.option("lineSep", '"').text(str(path)))
    assert "wholetext" not in plan


def test_broken_documents_of_any_layout(spark, compact):
    path, document = compact
    text = json.dumps(document, indent=1)
    broken = [text[:-1], text[:-30], text + text, text[: len(text) // 2], text.replace('"by_day"', '"by_week"'), text.replace(str(2**70), "-1", 1)]
    broken += [text.replace(str(2**70), "1.5", 1), text.replace('"parse_errors": 5', '"parse_errors": 5 5'), text.replace('"files_count": 7', '"files_count": null')]
    broken += [text.replace('"visits"', '"visit"', 1), ""]
    for changed in broken:
        path.write_text(changed, encoding="utf-8")
        with pytest.raises(Exception):
            any_layout(spark, path)


def test_empty_document_round_trip(spark, odd, tmp_path):
    folder = str(tmp_path / "document")
    json_document.save_document(odd.where("kind = 'meta:files'"), folder)
    assert as_dict(load_counters(spark, folder)) == {
        ("meta:files", "all"): (7, 0),
        ("meta:total", "all"): (0, 0),
        ("meta:parse_errors", "all"): (0, 0),
    }


@pytest.mark.parametrize(
    "text",
    [
        "{",
        "[]",
        "{}",
        '{"files_count":1}',
        '{"files_count":1,"aggregates":{"total_visits":1}}',
        "not json",
    ],
)
def test_anything_but_a_document_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):
        load_counters(spark, str(path)).collect()


def test_missing_database_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="there is no snapshot"):
        load_counters(spark, str(tmp_path / "absent"))


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    first = [log_line(path="/a/1"), log_line(path="/a/2", size="7"), "junk"]
    (folder / "access.log").write_text("\n".join(first) + "\n")
    (folder / "access.log.1").write_text(log_line(ip="2.2.2.2", path="/b"))
    return folder


def test_analyze_saves_exports_and_answers(spark, logs, tmp_path):
    db, export = str(tmp_path / "db"), str(tmp_path / "csv")
    ledger = analyze(
        spark,
        [str(logs)],
        save_db=db,
        export_csv=export,
        sort_by="traffic",
        top=1,
        group_path_regex="^(/[^/]+).*$",
    )
    assert tuple(ledger.summary().first()) == (3, 17, 1, 2, "traffic")
    assert [(r.key, r.visits) for r in ledger.rows("path").collect()] == [("/a", 2)]
    assert ledger.all_rows().count() == 4
    assert [r.label for r in ledger.bars("ip").collect()] == ["1.1.1.1"]
    assert [r.bucket for r in ledger.series().collect()] == ["2024-02-28"]
    assert [r.x for r in ledger.trend("month").collect()] == [0]
    assert ledger.page("status", 0, 5).count() == 1
    assert tables.read_export(spark, export).where("kind = 'dimension:path'").count() == 2

    again = analyze(spark, load_db=db, group_path_regex="^.*$", group_path_replace="ignored")
    assert as_dict(again.counters) == as_dict(ledger.counters)
    document = str(tmp_path / "document")
    again.save_json(document)
    from_json = analyze(spark, load_db=document, export_csv=str(tmp_path / "csv2"))
    assert as_dict(from_json.counters) == as_dict(ledger.counters)
    both = ledger.merged_with(from_json)
    assert tuple(both.summary().first()) == (6, 34, 2, 4, "traffic")
    with pytest.raises(ValueError, match="cannot be combined"):
        analyze(spark, [str(logs)], load_db=db)


def test_analyze_checks_its_input_before_reading(spark, logs, tmp_path):
    with pytest.raises(FileNotFoundError):
        analyze(spark, [str(tmp_path)])
    with pytest.raises(ValueError, match="group_ua_regex"):
        analyze(spark, [str(logs)], group_ua_regex="(")
    with pytest.raises(ValueError, match="sort_by"):
        analyze(spark, [str(logs)], sort_by="bytes")
    with pytest.raises(ValueError, match="sort_by"):
        Ledger(None, sort_by="bytes")


def test_shuffle_partitions_follow_the_input(spark, logs, monkeypatch):
    files = [str(p) for p in logs.iterdir()]
    lines = read_lines(spark, files)
    size = sum(p.stat().st_size for p in logs.iterdir())
    assert size <= ledger_plan._input_bytes(lines) <= 2 * size
    monkeypatch.setattr(ledger_plan, "INPUT_BYTES_PER_SHUFFLE_PARTITION", 10)
    key = ledger_plan.SHUFFLE_PARTITIONS
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError):
        with ledger_plan._enough_shuffle_partitions(spark, 995):
            assert spark.conf.get(key) == "100"
            raise RuntimeError
    assert spark.conf.get(key) == before
    with ledger_plan._enough_shuffle_partitions(spark, 1):
        assert spark.conf.get(key) == before
    assert analyze(spark, files).summary().first().visits == 3


def test_scratch_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(folder)
