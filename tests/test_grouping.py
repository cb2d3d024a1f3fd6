import pytest
from pyspark.sql import functions as F

from hitledger import GroupingRules, GroupRule
from hitledger.functions.regex_dialect import Translated

# pattern, template, text, result
RULES = [
    (r"^/([a-z]{2})/.+$", "[$1]", "/de/karte/9", "[de]"),
    (r"^/([a-z]{2})/.+$", "[$1]", "no slash", "no slash"),
    (r"\?.*$", "", "/a?b=1", "/a"),
    # an unmatched tail stays
    (r"^([a-z]+)-", "<$1>", "web-17", "<web>17"),
    (r"^([a-z]+)-\d+$", "<$1>", "web-17", "<web>"),
    # every match, not only the first
    (r"\d", "#", "a1b22", "a#b##"),
    # names are taken as long as they go
    ("(b)", "$1z", "abc", "ac"),
    ("(b)", "${1}z", "abc", "abzc"),
    ("(b)", "$2", "abc", "ac"),
    ("(b)", "$12", "abc", "ac"),
    ("(b)", "${1}2", "abc", "ab2c"),
    ("(b)", "$1.", "abc", "ab.c"),
    ("b", "$0$0", "abc", "abbc"),
    ("b", "$$1", "abc", "a$1c"),
    ("b", r"\1", "abc", r"a\1c"),
    ("b", "$", "abc", "a$c"),
    ("b", "${x", "abc", "a${xc"),
    ("b", "${}", "abc", "ac"),
    ("(?P<first>a)(?<second_1>b)", "$second_1-${first}", "abc", "b-ac"),
    ("(?P<n>b)", "$nx", "abc", "ac"),
    ("(a)|(b)", "[$2]", "abc", "[][b]c"),
    # an empty match next to the previous match does not count
    (".*", "X", "abc", "X"),
    (".*", "X", "", "X"),
    ("x*", "-", "abc", "-a-b-c-"),
    ("x*", "-", "xaxx", "-a-"),
    ("a*?", "-", "aa", "-a-a-"),
    ("b*", "-", "abc", "-a-c-"),
    # Unicode classes; a dot takes all but a line feed; $ is the end of the text
    (r"\d", "#", "٣x", "#x"),
    (r"\w+", "w", "é-ß", "w-w"),
    (r"\s", "_", "a\u3000b", "a_b"),
    ("a.b", "X", "a\rb", "X"),
    ("a.b", "X", "a\x85b", "X"),
    ("a$", "X", "a\r", "a\r"),
    ("(?i)É", "e", "é", "e"),
    ("(?i:A)b", "X", "ab aB", "X aB"),
    # spelled otherwise than in Java
    ("[[:digit:]]+", "#", "a12٣", "a#٣"),
    ("[^[:alpha:]]+", "#", "a12b", "a#b"),
    ("[[:^alpha:]]+", "#", "a12b", "a#b"),
    ("[]a]+", "#", "x]a", "x#"),
    ("[^]a]+", "#", "x]a", "#]a"),
    (r"\u{e9}|\x41|\x{42}|é", "#", "éAB", "###"),
    (r"a\vb", "#", "a\x0bb", "#"),
    (r"\p{Greek}+|\pN", "#", "αβ1", "##"),
    (r"\<a", "#", "a ba", "# ba"),
    (r"a\>", "#", "a ba ab", "# b# ab"),
    (r"[a-c&&[^b]]", "#", "abc", "#b#"),
    # set operators bind alike, from left to right
    (r"[a-e--[bd]]+", "#", "abcde", "#b#d#"),
    (r"[a-c~~b-d]", "#", "abcd", "#bc#"),
    (r"[^a-e--c]", "#", "acx", "a##"),
    (r"[a-y&&c-z--[^e-g]]", "#", "cefgz", "c###z"),
    (r"[\w--\d--[é]]+", "#", "ab12é", "#12é"),
    (r"[]a--a]", "#", "]a", "#a"),
    (r"^(?:[a-z--[x]]|/)+$", "#", "/a/b", "#"),
    (r"\.\[\(", "#", ".[(", "#"),
    ("a{2}?", "#", "aaa", "#a"),
    ("(?x) a  b", "#", "xab", "x#"),
    ("(?u)é(?u:a)", "#", "éa", "#"),
    # repeated groups of single characters
    (r"^(?:/|\w)+$", "#", "/a/b", "#"),
    (r"^(?:/|\w)+$", "#", "/a b", "/a b"),
    (r"(a|[b-d]|\d)+", "<$1>", "xab1-c", "x<1>-<c>"),
    (r"x(a|b)*", "<$1>", "xaab x", "<b> <>"),
    (r"(?:.|-){2,}", "#", "a-\n-b", "#\n#"),
    (r"(?:ab){1,3}", "#", "ababx", "#x"),
]

LONG = "/" + "a" * 100_000 + "/b" * 50_000


def test_rules(spark):
    texts = [text for _, _, text, _ in RULES]
    frame = spark.createDataFrame([texts], [f"t{i}" for i in range(len(RULES))])
    rules = [GroupRule(pattern, template) for pattern, template, _, _ in RULES]
    results = frame.select(*(rule.apply(F.col(f"t{i}")) for i, rule in enumerate(rules))).first()
    for rule, result, expected in zip(RULES, results, RULES):
        assert result == expected[3], rule
    for rule in rules[:3]:
        rule.validate(spark)


@pytest.mark.parametrize(
    "pattern",
    [
        "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", r"\k<n>", "(?U)a", "(?R)a", "(?-u)a",
        "(?>a)", "a++", "a*+", "a{2}+", "[a--]", "[~~b]", r"\Qa\E", r"\Z", r"\h", "a\\",
        "[[:nope:]]", "(?P<n>a)(?P<n>b)", r"\b{start}a",
    ],
)
def test_unsupported_patterns_are_refused(pattern):
    with pytest.raises(ValueError, match="Invalid group pattern"):
        GroupRule(pattern, "")


@pytest.mark.parametrize("pattern", [r"^(?:/|\w)+$", r"^(/|[a-z])*$", r"(?:a|b|/)+", r"^[^?]*(?:/b)?$", r"^(/[^/]*){2}"])
def test_accepted_rules_bear_long_texts(spark, pattern):
    frame = spark.createDataFrame([(LONG,)], ["t"])
    assert frame.select(GroupRule(pattern, "#").apply(F.col("t"))).first()[0].startswith("#")


@pytest.mark.parametrize("pattern", ["^(/[^/?]+)+$", "(?:ab)*", "(a*)*", "(a|bc)+", "(?:(?:a|b)+/)*", "(a|b)+?", "(?:a{2}){70}", "(^|a)+"])
def test_rules_that_could_exhaust_a_stack_are_refused(pattern):
    with pytest.raises(ValueError, match="Invalid group_path_regex"):
        GroupRule(pattern, "", "group_path_regex")


@pytest.mark.parametrize("option", ["ip", "path", "ua"])
def test_invalid_pattern_names_its_option(spark, option):
    with pytest.raises(ValueError, match=f"Invalid group_{option}_regex"):
        GroupingRules.from_options(spark, **{f"group_{option}_regex": "(open"})


def test_identity_rule_adds_no_expression():
    column = F.lit("x")
    assert GroupRule().apply(column) is column
    assert GroupRule("^(.*)$", "$2").apply(column) is not column


def test_groups_are_counted_and_named():
    translated = Translated(r"(a)(?:b)(?P<x_y>c)\(")
    assert (translated.groups, translated.group_names) == (2, {"x_y": 2})
