import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators.lines import lines, snippets


@pytest.mark.parametrize(
    "code, expected",
    [
        ("a\r\nb\n", ["a", "b"]),
        ("a\rb\n", ["a\rb"]),
        ("a\r", ["a\r"]),
        ("a\r\r\nb", ["a\r", "b"]),
        ("", []),
        ("\n", [""]),
        ("\r\n", [""]),
        ("a\n\n", ["a", ""]),
        ("a\nb", ["a", "b"]),
        ("a b\x85c\n", ["a b\x85c"]),
        ("\n\n\na", ["", "", "", "a"]),
    ],
)
def test_lines(sources, code, expected):
    rows = lines(sources(("x", code))).orderBy("line_number").collect()
    assert [r.line for r in rows] == expected
    assert [r.line_number for r in rows] == list(range(1, len(expected) + 1))


def test_snippets_are_trimmed_of_unicode_white_space(sources):
    row = snippets(sources(("x", "\t \xa0 a b　\x0b \r"))).first()
    assert row.code_snippet == "a b"


TEXTS = st.text(alphabet="ab\n\ré€😀 ", max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases=st.lists(st.tuples(TEXTS, st.integers(0, 60), st.integers(0, 60)), min_size=5, max_size=20))
def test_spans_match_bytes(spark, cases):
    frame = spark.createDataFrame(
        [(i, code, start, length) for i, (code, start, length) in enumerate(cases)],
        "i int, code string, start long, length long",
    )
    rows = frame.select(
        "i",
        T.line_of_offset(F.col("code"), F.col("start")).alias("line"),
        T.snippet_of_span(F.col("code"), F.col("start"), F.col("length")).alias("snippet"),
    ).collect()
    for row in rows:
        code, start, length = cases[row.i]
        raw = code.encode()
        assert row.line == 1 + raw[:start].count(b"\n")
        expected = raw[start:start + length].decode("utf-8", "replace").strip() if start < len(raw) else ""
        assert row.snippet == expected


@pytest.mark.parametrize(
    "src, expected",
    [
        ("12:5:0", (12, 5)),
        ("12:5", (12, 5)),
        ("+1:2:0", (1, 2)),
        ("12", (None, None)),
        ("a:5:0", (None, None)),
        ("-1:5:0", (None, None)),
        (" 1:5:0", (None, None)),
        ("1::0", (None, None)),
        ("99999999999999999999:1:0", (None, 1)),
        (None, (None, None)),
    ],
)
def test_span_numbers(spark, src, expected):
    frame = spark.createDataFrame([(src,)], "src string")
    row = frame.select(T.span_start(F.col("src")).alias("s"), T.span_length(F.col("src")).alias("n")).first()
    assert (row.s, row.n) == expected


def test_far_offsets_are_clamped(spark):
    row = spark.range(1).select(
        T.line_of_offset(F.lit("a\nb"), F.lit(2**40)).alias("line"),
        T.snippet_of_span(F.lit("a\nb"), F.lit(2**40), F.lit(1)).alias("past"),
        T.snippet_of_span(F.lit("a\nb"), F.lit(0), F.lit(2**40)).alias("all"),
    ).first()
    assert (row.line, row.past, row["all"]) == (2, "", "a\nb")


@pytest.mark.parametrize(
    "path, solidity, rust, json",
    [
        ("a/b.sol", True, False, False),
        ("a/b.SOL", True, False, False),
        ("a/b.Json", True, False, True),
        ("a/b.rs", False, True, False),
        ("a/b.RS", False, False, False),
        ("a/.sol", False, False, False),
        ("a/sol", False, False, False),
        ("a/b.sol.txt", False, False, False),
        (".json", False, False, True),
        (None, False, False, False),
    ],
)
def test_extensions(spark, path, solidity, rust, json):
    row = spark.createDataFrame([(path,)], "path string").select(
        T.has_extension(F.col("path"), ["sol", "json"], True).alias("solidity"),
        T.has_extension(F.col("path"), ["rs"], False).alias("rust"),
        T.is_json(F.col("path")).alias("json"),
    ).first()
    assert tuple(row) == (solidity, rust, json)


@pytest.mark.parametrize(
    "path, clean",
    [
        ("file:///a//b/./c.sol", "/a/b/c.sol"),
        ("/a/b.sol", "/a/b.sol"),
        ("s3://bucket/a//b.sol", "s3://bucket/a/b.sol"),
        ("/a/././b", "/a/b"),
        ("a/.b/c", "a/.b/c"),
    ],
)
def test_clean_path(spark, path, clean):
    assert spark.range(1).select(T.clean_path(F.lit(path)).alias("p")).first().p == clean
