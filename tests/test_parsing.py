import random
import time

import pytest
from pyspark.sql import functions as F

from hitledger.functions import line_fields as lf
from hitledger.operators.parsing import (
    accepted_records,
    parse_lines,
    parse_lines_by_pattern,
    rejected_lines,
    with_buckets,
)
from tests import line_model

B = "[28/Feb/2024:23:41:07 -0330]"
TS = B[1:-1]
STD = f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5 "-" "ua"'


def rec(ip="1.1.1.1", path="/x", ua="ua", status="200", size=5, ts=TS):
    return (ip, path, ua, status, size, ts)


REJECT = (None,) * 6

EDGE_LINES = {
    "std": (
        f'2001:db8::17 - eve {B} "PATCH /cart/9?step=pay HTTP/2" 418 90210 "https://x.example" "Probe/3"',
        rec("2001:db8::17", "/cart/9?step=pay", "Probe/3", "418", 90210),
    ),
    "zero_bytes": (
        f'host.example - - {B} "OPTIONS * HTTP/1.0" 299 0 "-" "Fetch 9"',
        rec("host.example", "*", "Fetch 9", "299", 0),
    ),
    "crlf": (
        f'198.51.100.7 - - {B} "PUT /files/a.bin HTTP/1.1" 507 31 "-" "Sync"\r',
        rec("198.51.100.7", "/files/a.bin", "Sync", "507", 31),
    ),
    "blank": ("", REJECT),
    "junk": ("~~ rotated ~~", REJECT),
    "bytes_dash": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 304 - "-" "ua"', rec(status="304", size=0)),
    "bytes_plus": (STD.replace(" 5 ", " +5 "), rec()),
    "bytes_neg": (STD.replace(" 5 ", " -5 "), rec(size=0)),
    "bytes_two_plus": (STD.replace(" 5 ", " ++5 "), rec(size=0)),
    "bytes_only_plus": (STD.replace(" 5 ", " + "), rec(size=0)),
    "bytes_decimal": (STD.replace(" 5 ", " 5.0 "), rec(size=0)),
    "bytes_tab": (STD.replace(" 5 ", " 5\t "), rec(size=0)),
    "bytes_arabic_digit": (STD.replace(" 5 ", " \u0665 "), rec(size=0)),
    "bytes_zeros": (STD.replace(" 5 ", " " + "0" * 30 + "5 "), rec()),
    "double_space": (STD.replace("200 5", "200  532"), rec(size=0)),
    "empty_req": (
        f'1.1.1.1 - - {B} "" 400 0 "-" "-"',
        rec(path="-", ua="-", status="400", size=0),
    ),
    "one_token_req": (
        f'1.1.1.1 - - {B} "\\x16\\x03" 400 157 "-" "-"',
        rec(path="-", ua="-", status="400", size=157),
    ),
    "escaped_quote": (
        f'1.1.1.1 - - {B} "GET /a\\"b HTTP/1.1" 200 5 "-" "ua"',
        rec(path="/a\\", status="b", size=0),
    ),
    "no_ua": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5 "-"', rec(ua="-")),
    "empty_ua": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5 "-" ""', rec(ua="")),
    "unterminated_ua": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5 "-" "ua', rec()),
    "common_format": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5', REJECT),
    "extra_tail": (STD + ' "10.0.0.1" 0.003', rec()),
    "tabs": (f'1.1.1.1\t-\t-\t{B}\t"GET /x HTTP/1.1"\t200\t5\t"-"\t"ua"', rec()),
    "tabs_odd_bytes": (f'1.1.1.1\t-\t-\t{B}\t"GET /x HTTP/1.1"\t200\t5z\t"-"\t""', rec(ua="", size=0)),
    "leading_space": (" " + STD, rec(ip="")),
    "status_word": (STD.replace(" 200 ", " OK "), rec(status="OK")),
    "bad_month": (STD.replace("Feb", "Foo"), rec(ts=TS.replace("Feb", "Foo"))),
    "short_ts": (STD.replace(B, "[28/Feb/2024]"), rec(ts="28/Feb/2024")),
    "odd_digits": (
        STD.replace(B, "[99/Feb/2024:77:22:11 +0900]"),
        rec(ts="99/Feb/2024:77:22:11 +0900"),
    ),
    "empty_ts": (STD.replace(B, "[]"), rec(ts="")),
    "bracket_user": (STD.replace("- -", "- a[b"), rec(ts="b [" + TS)),
    "multi_space_req": (STD.replace("GET /x HTTP", "  GET   /x   HTTP"), rec()),
    "tab_in_req": (STD.replace("GET /x HTTP", "GET\t/x\tHTTP"), rec()),
    "wide_space_in_path": (STD.replace("/x", "/x\u2003y"), rec()),
    "nbsp_before_status": (STD.replace('" 200', '"\xa0 200'), rec()),
    "tab_status": (
        f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200\t5\t"-" "a b c"',
        rec(ua="a b c"),
    ),
    "u64max": (STD.replace(" 5 ", f" {2**64 - 1} "), rec(size=2**64 - 1)),
    "u64over": (STD.replace(" 5 ", f" {2**64} "), rec(size=0)),
    "i64max": (STD.replace(" 5 ", f" {2**63 - 1} "), rec(size=2**63 - 1)),
    "many_cr": (f'1.1.1.1 - - {B} "GET /x HTTP/1.1" 200 5 "-" "ua\r\r\r', rec()),
    "cr_before_quote": (STD[:-1] + '\r"', rec(ua="ua\r")),
    "no_gap_status": (STD.replace('" 200', '"200'), rec()),
    "accents": (STD.replace("/x", "/é").replace('"ua"', '"ü 😀"'), rec(path="/é", ua="ü 😀")),
    "quote_before_bracket": (f'1.1.1.1 "q {B} "GET /x HTTP/1.1" 200 5 "-" "ua"', rec()),
    "quote_in_ts": (
        '1.1.1.1 - - [13"Mar] "GET /x HTTP/1.1" 200 5 "-" "ua"',
        rec(ts='13"Mar'),
    ),
    "bracket_in_ip": (f'1[1 - - {B} "GET /x HTTP/1.1" 200 5 "-" "ua"', rec(ip="1[1")),
}
COLUMNS = "ip path user_agent status_code traffic_bytes timestamp_str".split()


@pytest.fixture(scope="module")
def edge_results(lines_of):
    rows = parse_lines(lines_of([line for line, _ in EDGE_LINES.values()])).collect()
    names = list(EDGE_LINES)
    return {names[r.id]: tuple(r[c] for c in COLUMNS) for r in rows}


@pytest.mark.parametrize("name", EDGE_LINES)
def test_edge_line(edge_results, name):
    assert edge_results[name] == EDGE_LINES[name][1]


def as_tuple(record):
    return tuple(record[c] for c in COLUMNS) if record else REJECT


def test_model_agrees_with_the_edge_lines():
    for name, (line, expected) in EDGE_LINES.items():
        assert as_tuple(line_model.parse(line)) == expected, name


def mutated_lines(count, seed):
    """Edge lines with random cuts, repeats and insertions of the characters that matter."""
    rng = random.Random(seed)
    alphabet = list(' "[]\t\r+-05\\/\xe9\xa0\u2003\x85') + ["  ", '" ', ' "', "\t\t", "99999999999999999999"]
    bases = [line for line, _ in EDGE_LINES.values()]
    for _ in range(count):
        line = rng.choice(bases)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(line))
            kind = rng.random()
            if kind < 0.5:
                line = line[:at] + rng.choice(alphabet) + line[at:]
            elif kind < 0.8:
                line = line[:at] + line[at + rng.randint(1, 3) :]
            else:
                line = line.replace(rng.choice(' "'), rng.choice(alphabet), 1)
        yield line


def test_mutated_lines_match_the_model(lines_of):
    texts = list(mutated_lines(20_000, seed=7))
    lines = lines_of(texts).repartition(4)
    parsed = {r.id: tuple(r[c] for c in COLUMNS) for r in parse_lines(lines).collect()}
    patterns = (lf.DELIMITED_LINE, lf.COMBINED_LINE)
    by_pattern = parse_lines_by_pattern(lines, patterns=patterns)
    whole = {r.id: tuple(r[c] for c in COLUMNS) for r in by_pattern.collect()}
    strict = {
        r.id: tuple(r[c] for c in COLUMNS) for r in parse_lines_by_pattern(lines).collect()
    }
    kinds = {"delimited": 0, "pattern": 0, "reject": 0}
    for i, text in enumerate(texts):
        delimited, pattern = line_model.by_delimiters(text), line_model.by_pattern(text)
        expected = as_tuple(delimited or pattern)
        assert parsed[i] == expected, text
        assert whole[i] == expected, text
        assert strict[i] == as_tuple(pattern), text
        kinds["delimited" if delimited else "pattern" if pattern else "reject"] += 1
    assert min(kinds.values()) > 300


def test_accepted_and_rejected_split_the_lines(lines_of):
    lines = lines_of([line for line, _ in EDGE_LINES.values()])
    good = accepted_records(parse_lines(lines))
    bad = rejected_lines(lines)
    rejects = [i for i, (_, r) in enumerate(EDGE_LINES.values()) if r == REJECT]
    assert sorted(r.id for r in bad.collect()) == rejects
    assert {r.value for r in bad.collect()} == {"", "~~ rotated ~~", EDGE_LINES["common_format"][0]}
    assert good.count() == len(EDGE_LINES) - len(rejects)
    assert good.columns == ["id", *parse_lines(lines).drop("id").columns]


def test_hostile_lines_take_linear_time(lines_of):
    n = 200_000
    texts = [
        "a " * n, "[" * n, '"' * n, "] " * n, "\t[" * n, " [" + "]" * n, '"a' * n, " " * n,
        "x - - [" + "a" * n, 'x - - [a] "' + "b " * n, STD + '"' * n, "\u2003" * n,
        STD.replace(" 5 ", " " + "9" * n + " "), STD.replace(" 5 ", " " + "0" * n + "7 "),
        STD.replace(" 5 ", f" {'0' * n}{2**63} "), STD.replace("GET /x", "GET" + " " * n + "/x"),
        STD.replace("1.1.1.1 ", "1.1.1.1\t") + "\t" * n, STD + "\r" * n, "1\t" * n,
    ]
    started = time.monotonic()
    for row in parse_lines(lines_of(texts)).collect():
        expected = as_tuple(line_model.parse(texts[row.id]))
        assert tuple(row[c] for c in COLUMNS) == expected, texts[row.id][:60]
    assert time.monotonic() - started < 60


def test_other_columns_stay_and_the_line_may_have_any_name(spark):
    frame = spark.createDataFrame([(1, STD, "x"), (2, "junk", "y")], "n int, `the line` string, `a.b` string")
    parsed = parse_lines(frame, "the line")
    assert parsed.columns[:3] == ["n", "a.b", "ip"]
    assert [(r.n, r["a.b"], r.path) for r in parsed.collect()] == [(1, "x", "/x"), (2, "y", None)]
    assert [tuple(r) for r in rejected_lines(frame, "the line").collect()] == [(2, "junk", "y")]
    assert accepted_records(parsed).count() == 1


def test_null_line_is_a_reject(lines_of):
    assert parse_lines(lines_of([None])).where("ip is null and traffic_bytes is null").count() == 1


TIMESTAMPS = [
    TS,
    "99/Mar/2026:77:22:11 +0900",
    "13/Mar/2026:09",
    "13/Mar/2026:0",
    "13/Foo/2026:09:22:11",
    "13/mar/2026:09:22:11",
    "13/anF/2026:09:22:11",
    "13xDecy2026z09",
    "",
    "é/Mar/2026:09:22:11",
    "13/Mar/202é:09:22:11",
    "13éMar/2026:09:22",
    "1é/Mar/2026:09:22",
    "13/Mar/2026:09 é",
    *(f"01/{m}/2024:00:00:00 +0000" for m in line_model.MONTHS),
]


def test_buckets(lines_of):
    rows = with_buckets(lines_of(TIMESTAMPS).withColumnRenamed("value", "timestamp_str")).collect()
    for row in rows:
        expected = line_model.buckets(TIMESTAMPS[row.id]) or (None, None, None)
        assert (row.hour, row.day, row.month) == expected, TIMESTAMPS[row.id]


def test_request_path_and_byte_tokens(lines_of):
    requests = ["", "GET", "GET /x", " GET /x HTTP/1.1", "GET /x\ty", " ", "a\x85b c"]
    rows = lines_of(requests).withColumn("path", lf.request_path(F.col("value"))).collect()
    assert [r.path for r in rows] == [line_model.path_of(r) for r in requests]

    tokens = ["0", "12", "+12", "-12", "", "-", "1 ", " 1", "1.5", "1e3", str(2**63 - 1), str(2**63)]
    rows = lines_of(tokens).withColumn("n", lf.parse_bytes(F.col("value"))).collect()
    expected = [line_model.number(t) for t in tokens]
    assert [r.n for r in rows] == expected


def test_parse_stays_in_the_jvm_and_in_one_stage(lines_of):
    plan = parse_lines(lines_of([STD]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan and "Exchange" not in plan
