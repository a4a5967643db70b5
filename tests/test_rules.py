import json
import re

import pytest
from pyspark.sql import functions as F

from auditloom import catalogue, schemas
from auditloom.functions.patterns import guard_parts, spark_pattern, with_problem
from auditloom.operators import rules as R
from auditloom.operators import scan
from auditloom.sources.rules import (
    AnalysisMode,
    parse_rule_file,
    read_rule_file,
    read_rules,
    rules_from_rows,
    stock_rust_rules,
    stock_solidity_rules,
)
from auditloom.plans import registry
from auditloom.plans.audit import effective_mode
from auditloom.sources import rules as rules_module


def test_stock_rules_that_run(spark):
    rust, solidity = stock_rust_rules(spark), stock_solidity_rules(spark)
    assert rust.count() == 60 and rust.where("enabled").count() == 59
    assert [r.id for r in R.active_rules(rust).orderBy("rule_seq").collect()] == ["S-2005", "S-2039"]
    assert R.active_rules(solidity).count() == 7
    assert {(r.id, r.state) for r in R.rejected_rules(solidity).collect()} == {("EVM-1001", "no pattern")}
    states = {r.state: r["count"] for r in R.rejected_rules(rust).groupBy("state").count().collect()}
    assert states == {"unsupported": 57, "disabled": 1}


def test_severities_of_the_stock_rules():
    counts = {s: sum(r[1] == s for r in catalogue.RUST_RULES) for s in catalogue.SEVERITIES}
    assert counts == {"critical": 14, "high": 29, "medium": 17, "low": 0}


@pytest.mark.parametrize(
    "pattern, problem",
    [
        ("a.*b", None),
        ("(?P<name>a)b", None),
        ("(?<na_me>a)b", None),
        ("[[:alpha:]]x", None),
        (r"\u{e9}", None),
        (r"\(?=", None),
        ("[(?=]x", None),
        (r"\\1", None),
        (r"\w+\s*\d\b\pL\x41", None),
        ("a(?=b)", "look-around"),
        ("a(?!b)", "look-around"),
        ("(?<=a)b", "look-around"),
        ("a.*?(?<!b|c)", "look-around"),
        ("(?>a)b", "atomic group"),
        (r"(a)\1", "back-reference"),
        (r"\Qa\E", "unknown escape"),
        (r"a\Z", "unknown escape"),
        ("(a", "malformed"),
        ("a{", "malformed"),
        ("*a", "malformed"),
        (None, None),
    ],
)
def test_strict_dialect(spark, pattern, problem):
    frame = spark.createDataFrame([(pattern,)], "pattern string")
    assert with_problem(frame, "pattern", "problem").first().problem == problem


def test_spark_pattern_means_the_same(spark):
    frame = spark.createDataFrame(
        [("(?P<x>a)[[:digit:]]", "a7"), ("[[:alpha:]_]+-", "_b-"), (r"\u{e9}", "é")], "pattern string, text string"
    )
    hits = frame.withColumn("java", spark_pattern(F.col("pattern"))).where("text rlike java")
    assert hits.count() == 3


def test_guard_parts(spark):
    trigger, guard = guard_parts(F.col("p"))
    frame = spark.createDataFrame([("(a|b).*?(?<!c|d\\()",), ("plain",)], "p string")
    rows = frame.select(trigger.alias("t"), guard.alias("g")).collect()
    assert [tuple(r) for r in rows] == [("(a|b)", "c|d\\("), ("plain", None)]


RULE_FILE = """
[metadata]
version = "1"
[analysis_mode]
regex = true
ast = false
llm = false
[[rules]]
id = "A"
description = "first"
severity = "high"
patterns = ["x", "y"]
enabled = true
[[rules]]
id = "A"
description = "second"
severity = "low"
patterns = []
enabled = false
mitigation = "m"
"""


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text(RULE_FILE)
    rules, mode = read_rule_file(spark, str(path))
    assert mode == AnalysisMode(True, False, False)
    assert [tuple(r) for r in rules.orderBy("rule_seq").collect()] == [
        (0, "A", "first", "high", ["x", "y"], True, None),
        (1, "A", "second", "low", [], False, "m"),
    ]
    assert [tuple(r) for r in R.last_rule_texts(rules).collect()] == [("A", "second", "low", "m")]
    none, mode = parse_rule_file(spark, "rules = []")
    assert (none.count(), mode) == (0, None)
    with pytest.raises(ValueError, match="rule without severity: B"):
        parse_rule_file(spark, '[[rules]]\nid = "B"\ndescription = "d"\npatterns = []\nenabled = true')


def test_rule_file_in_pieces(spark, tmp_path, monkeypatch):
    """Files are cut at rules wherever Spark's blocks end, never in strings, and read as the whole text is."""
    rule = '[[rules]]\nid = "R{}"\ndescription = "ü [[rules]] {}"\nseverity = "low"\npatterns = ["a\\\\n", "b"]\nenabled = true\n'
    head = '# rules\ntitle = "t"\n[analysis_mode]\nregex = true\nast = false\nllm = true\n'
    plain = head + "".join("\n" * (i % 3) + rule.format(i, "x" * (i % 7)) for i in range(40))
    inside = plain + '\n[[rules]]\nid = "S"\ndescription = """\n[[rules]]\nid = 1\n"""\nseverity = "low"\npatterns = []\nenabled = true\n'
    indented = plain.replace("\n[[rules]]\nid = \"R7\"", "\n  [[ rules ]] # c\nid = \"R7\"").replace("\n", "\r\n")
    late_mode = plain[len(head):] + head.partition("\n")[2].partition("\n")[2]
    wholes = []
    real = rules_module.parse_rule_file
    for at, (text, whole) in enumerate([(plain, 0), (inside, 1), (indented, 0), (late_mode, 0), ("rules = []\n", 1)]):
        path = tmp_path / f"{at}.toml"
        path.write_bytes(text.encode())
        expected, mode = real(spark, text)
        expected = [tuple(r) for r in expected.orderBy("rule_seq").collect()]
        for size in (97, 256, 1 << 20) if at == 0 else (131,):
            monkeypatch.setattr(rules_module, "parse_rule_file", lambda *given: wholes.append(at) or real(*given))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                rules, told = read_rule_file(spark, str(path))
                assert [tuple(r) for r in rules.orderBy("rule_seq").collect()] == expected
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert told == mode and (at in wholes) == bool(whole)


def test_rule_file_in_parts(spark, tmp_path):
    """Part files are one rule file, even where one begins inside a rule."""
    head = '[analysis_mode]\nregex = true\nast = false\nllm = true\n'
    rule = '\n[[rules]]\nid = "{}"\ndescription = "d"\nseverity = "low"\npatterns = []\nenabled = true\n'
    for name, parts in (("even", [head + rule.format("A"), rule.format("B"), rule.format("C")[1:]]),
                        ("odd", [head + rule.format("A"), 'mitigation = "m"\n' + rule.format("B") + rule.format("C")])):
        (tmp_path / name).mkdir()
        for at, text in enumerate(parts):
            (tmp_path / name / f"part-{at:05d}").write_text(text)
        rules, mode = read_rule_file(spark, str(tmp_path / name), in_parts=True)
        assert mode == AnalysisMode(True, False, True)
        found = [(r.rule_seq, r.id, r.mitigation) for r in rules.orderBy("rule_seq").collect()]
        assert found == [(0, "A", "m" if name == "odd" else None), (1, "B", None), (2, "C", None)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_text(head + rule.format("A") + rule.format("B").replace('severity = "low"\n', ""))
    with pytest.raises(ValueError, match="rule without severity: B"):
        read_rule_file(spark, str(tmp_path / "bad"), in_parts=True)


def test_rules_are_not_read_whole(spark, monkeypatch):
    """The rule file of the parts is written and read in tasks: no text of it passes the driver."""
    def whole(*given):
        raise AssertionError("read whole")

    monkeypatch.setattr(rules_module, "parse_rule_file", whole)
    assert registry.rules_toml(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_mode_of_the_rule_file_wins():
    asked = AnalysisMode(regex=False, ast=True, llm=True)
    assert effective_mode(AnalysisMode(True, False, False), asked) == AnalysisMode(True, False, False)
    assert effective_mode(None, asked) == AnalysisMode(True, True, True)


def test_rule_table(spark, tmp_path):
    good = {"rule_seq": 0, "id": "A", "description": "d", "severity": "low", "patterns": ["x"], "enabled": True}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(good))
    assert read_rules(spark, str(path)).count() == 1
    path.write_text(json.dumps({**good, "patterns": None}))
    with pytest.raises(Exception, match="rule without patterns: A"):
        read_rules(spark, str(path)).collect()
    path.write_text(json.dumps(good) + "\n{oops")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_rules(spark, str(path)).collect()


def test_lint(spark):
    rows = [
        ("A", "low", True, ["x", "y"], "d", None),
        ("B", "low", False, ["x"], "d", None),
        ("C", "low", True, [], "d", None),
        ("D", "low", True, ["(?=x)"], "d", None),
    ]
    lint = R.lint_rules(rules_from_rows(spark, rows)).orderBy("rule_seq").collect()
    assert [tuple(r)[1:] for r in lint] == [
        ("A", "live", None, 1, 1),
        ("B", "disabled", None, 0, 1),
        ("C", "no pattern", None, 0, 0),
        ("D", "unsupported", "look-around", 0, 0),
    ]


def test_states_of_every_pattern(spark):
    rows = [
        ("A", "low", True, ["x", "(?<=y)z", "w"], "a", None), ("B", "low", True, ["t.*?(?<!g)"], "b", None),
        ("C", "low", True, ["t.*?(?<!(?=g))"], "c", None), ("D", "low", False, ["x"], "d", None), ("E", "low", True, [], "e", None),
    ]
    states = R.pattern_states(rules_from_rows(spark, rows)).orderBy("rule_seq", "pattern_no").collect()
    assert [(r.id, r.pattern_no, r.strict, r.every, r.guarded) for r in states] == [
        ("A", 1, "live", "live", "live"), ("A", 2, "unused", "unsupported", "unused"), ("A", 3, "unused", "live", "unused"),
        ("B", 1, "unsupported", "unsupported", "live"), ("C", 1, "unsupported", "unsupported", "unsupported"),
        ("D", 1, "disabled", "disabled", "disabled"), ("E", 0, "no pattern", "no pattern", "no pattern"),
    ]
    assert {r.problem for r in states if r.id == "A"} == {None, "look-around"}


def test_schema_of_rules(spark):
    assert stock_rust_rules(spark).schema.simpleString() == spark.createDataFrame([], schemas.RULES).schema.simpleString()


@pytest.mark.parametrize("kind, scanned", [
    ("strict", scan.scan_strict), ("every", scan.scan_all_patterns), ("guarded", scan.scan_guarded),
])
def test_findings_come_from_live_patterns(spark, sources, kind, scanned):
    """What a scan finds is what the states of its patterns say it tries, and all of that."""
    rows = [
        (0, "A", "d", "low", ["alpha", "beta"], True, None), (1, "B", "d", "low", [], True, None),
        (2, "C", "d", "low", ["alpha"], False, None), (3, "D", "d", "low", ["(?<!x)alpha", "beta"], True, None),
        (4, "E", "d", "low", ["alpha.*?(?<!guard)", "gamma"], True, None), (5, "F", "d", "low", ["(alpha", "gamma"], True, None),
        (6, "G", "d", "low", ["[a-z&&[^b]]lpha", "beta"], True, None),
    ]
    table = spark.createDataFrame(rows, schemas.RULES)
    states = R.pattern_states(table).where(f"{kind} = 'live'").collect()
    lines = ["alpha", "beta", "gamma", "blpha", ""]
    found = {(r.rule_id, r.line_number) for r in scanned(sources(("a", "\n".join(lines))), table).collect()}
    plain = {"[a-z&&[^b]]lpha": "[ac-z]lpha", "alpha.*?(?<!guard)": "alpha"}
    expected = {
        (s.id, n) for s in states for n, line in enumerate(lines, 1) if re.search(plain.get(s.pattern, s.pattern), line)
    }
    assert found == expected and found
