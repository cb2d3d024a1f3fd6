import gzip

import pytest

from hitledger.operators.counting import count_lines, summary
from hitledger.sources import log_files
from hitledger.sources.log_files import read_lines, resolve_inputs

OK = b'198.51.100.7 - eve [31/Dec/1999:03:59:58 +0530] "POST /cart/7 HTTP/2" 201 4096 "-" "Probe/3"'
NEXT = b'fe80::9 - - [31/Dec/1999:22:00:01 +0530] "HEAD /logo.svg HTTP/1.0" 304 17 "-" "Fetch 9"'


def write(folder, name, content=b""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return str(path)


def lines_in(spark, *paths, **options):
    return [r.value for r in read_lines(spark, paths, **options).collect()]


def names_of(paths):
    return [p.rsplit("/", 1)[-1] for p in paths]


def test_directory_stands_for_its_own_access_logs(spark, tmp_path):
    for name in ("access.log-b.gz", "access.log", "accesslog", "old/access.log-a", "access.logs/x"):
        write(tmp_path, name)
    write(tmp_path, "host=7/access.log-c")
    assert names_of(resolve_inputs(spark, [str(tmp_path)])) == ["access.log", "access.log-b.gz"]


def test_any_other_input_is_a_file_and_order_and_repeats_stay(spark, tmp_path):
    write(tmp_path, "logs/access.log")
    other = write(tmp_path, "night shift.log")
    resolved = resolve_inputs(spark, [other, str(tmp_path / "logs"), other])
    assert names_of(resolved) == ["night shift.log", "access.log", "night shift.log"]


def test_nothing_found_is_an_error(spark, tmp_path):
    write(tmp_path, "error.log")
    good = write(tmp_path, "good/access.log")
    with pytest.raises(FileNotFoundError, match="holds no access.log file"):
        resolve_inputs(spark, [good, str(tmp_path)])
    with pytest.raises(FileNotFoundError, match="there is no log to read"):
        resolve_inputs(spark, [])


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lines_in(spark, *resolve_inputs(spark, [str(tmp_path / "absent.log")]))


def test_crlf_file_with_final_newline(spark, tmp_path):
    path = write(tmp_path, "a.log", OK + b"\r\n" + NEXT + b"\r\n")
    row = summary(count_lines(read_lines(spark, [path]))).first()
    assert (row.visits, row.traffic_bytes, row.parse_errors) == (2, 4113, 0)


def test_only_line_feeds_end_lines(spark, tmp_path):
    path = write(tmp_path, "a.log", b"a\rb\n\nc\r\r\nlast")
    assert lines_in(spark, path) == ["a\rb", "", "c\r", "last"]
    assert lines_in(spark, write(tmp_path, "empty.log")) == []


def test_blank_lines_are_parse_errors(spark, tmp_path):
    path = write(tmp_path, "a.log", b"\n" + OK + b"\n\n")
    row = summary(count_lines(read_lines(spark, [path]))).first()
    assert (row.visits, row.parse_errors) == (1, 2)


def test_several_files_and_a_repeated_one(spark, tmp_path):
    a, b = write(tmp_path, "a.log", OK + b"\n"), write(tmp_path, "b.log", NEXT)
    row = summary(count_lines(read_lines(spark, [a, b, a]))).first()
    assert (row.visits, row.traffic_bytes) == (3, 8209)


def test_lines_survive_any_cut_of_the_file(spark, tmp_path):
    content = b"".join(
        OK.replace(b"/ok", b"/\xc3\xa9/%d" % i) + (b"\r\n" if i % 3 else b"\n") for i in range(400)
    )
    path = write(tmp_path, "a.log", content)
    whole = sorted(lines_in(spark, path))
    options = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        cut = read_lines(spark, [path])
        assert sorted(r.value for r in cut.collect()) == whole and len(whole) == 400
        row = summary(count_lines(cut)).first()
        assert (row.visits, row.traffic_bytes, row.parse_errors) == (400, 1638400, 0)
    finally:
        for key in options:
            spark.conf.unset(key)


def test_file_names_are_literal(spark, tmp_path):
    path = write(tmp_path, "access.log[1]{x}*?", OK)
    write(tmp_path, "access.log1", OK)
    resolved = resolve_inputs(spark, [path])
    assert len(lines_in(spark, *resolved)) == 1
    (tmp_path / "dir[0]").mkdir()
    write(tmp_path, "dir[0]/access.log", OK)
    assert len(lines_in(spark, *resolve_inputs(spark, [str(tmp_path / "dir[0]")]))) == 1


def test_invalid_utf8_ends_the_run_with_the_file_name(spark, tmp_path):
    path = write(tmp_path, "broken.log", OK + b"\n" + b"a\xff\xfeb\n")
    with pytest.raises(Exception, match="not UTF-8 in file .*broken.log"):
        lines_in(spark, path)


def test_invalid_utf8_can_become_a_reject(spark, tmp_path):
    path = write(tmp_path, "broken.log", OK + b"\n" + b"a\xff\xfeb\n")
    lines = read_lines(spark, [path], invalid_utf8="reject")
    assert [bytes(r.undecodable) for r in lines.where("value is null").collect()] == [b"a\xff\xfeb"]
    row = summary(count_lines(lines)).first()
    assert (row.visits, row.parse_errors) == (1, 1)
    with pytest.raises(ValueError):
        read_lines(spark, [path], invalid_utf8="ignore")


@pytest.mark.parametrize("name", ["_x.log", ".x.log", "access.log._COPYING_", ".x é%20#.log"])
def test_names_that_spark_would_skip_are_read(spark, tmp_path, name):
    path, other = write(tmp_path, name, OK + b"\n" + NEXT), write(tmp_path, "plain.log", OK)
    assert sorted(lines_in(spark, path, other, path)) == sorted([OK.decode()] * 3 + [NEXT.decode()] * 2)
    broken = write(tmp_path, name, OK + b"\n" + b"a\xff\xfeb\n")
    with pytest.raises(Exception) as failure:
        lines_in(spark, broken)
    assert name in str(failure.value) and "not UTF-8" in str(failure.value)


def test_a_directory_with_odd_names(spark, tmp_path):
    write(tmp_path, "access.log", OK)
    write(tmp_path, "access.log._COPYING_", OK)
    write(tmp_path, "_access.log", OK)
    (tmp_path / "access.log.d").mkdir()
    resolved = resolve_inputs(spark, [str(tmp_path)])
    assert [p.rsplit("/", 1)[1] for p in resolved] == ["access.log", "access.log._COPYING_"]
    assert len(lines_in(spark, *resolved)) == 2


def test_compressed_log_with_an_odd_name(spark, tmp_path):
    path = write(tmp_path, "_access.log.2.gz", gzip.compress(OK + b"\n" + NEXT))
    assert len(lines_in(spark, path)) == 2


def test_compressed_log(spark, tmp_path):
    path = write(tmp_path, "access.log.2.gz", gzip.compress(OK + b"\n" + NEXT))
    assert len(lines_in(spark, path)) == 2


def test_a_folder_of_several_files_that_spark_wrote(spark, tmp_path):
    folder, other = tmp_path / "day é%20[1]", write(tmp_path, "access.log", OK)
    lines = spark.range(1000).selectExpr("concat('line ', id) AS value")
    lines.repartition(5).write.text(str(folder), lineSep="\n")
    odd = write(tmp_path, "_odd.log", OK)
    assert len(list(folder.glob("part-*"))) == 5
    expected = sorted(r.value for r in lines.collect())
    assert sorted(lines_in(spark, str(folder))) == expected
    assert sorted(lines_in(spark, f"{folder}/", other, odd)) == sorted([*expected, OK.decode(), OK.decode()])


def test_every_named_input_is_among_the_files_read(spark):
    plain = {"_x.log": "viewfs://names1/file-0.log"}
    read = ["file:///a%20b/part-0", "file:///a%20b/day=1/part-1", "viewfs://names1/file-0.log"]
    assert log_files._all_read(spark, {"/a b", "_x.log"}, plain, read)
    assert log_files._all_read(spark, {"/a b/day=1", "/a b/part-0", "_x.log"}, plain, read)
    assert not log_files._all_read(spark, {"/a b", "/a", "/c.log"}, plain, read)
    assert not log_files._all_read(spark, {"/a b", "_x.log"}, plain, read[:2])
