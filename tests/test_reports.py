import random
from collections import Counter

import pytest

from auditloom import catalogue, schemas
from auditloom.operators.scan import scan_strict
from auditloom.plans import reports
from auditloom.sources import sinks
from auditloom.sources.rules import rules_from_rows


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(3)
    sources = [(i, f"p{i % 3}" if i % 5 else None, f"f{i}" if i else None, "") for i in range(20)]
    sources.append((20, "quiet", "q", ""))
    rows = []
    for _ in range(300):
        seq = random.randrange(0, 19)
        severity = random.choice(["critical", "high", "medium", "low", "odd"])
        rows.append((
            sources[seq][1], seq, random.choice(schemas.ANALYZERS), 0, 0, "R", "R", severity, "m", None, 1, "c", None
        ))
    finding = (
        "program string, source_seq long, analyzer string, rule_seq int, item_seq long, rule_id string, "
        "vuln_type string, severity string, message string, mitigation string, line_number long, "
        "code_snippet string, file_path string"
    )
    return sources, rows, spark.createDataFrame(sources, schemas.SOURCES), spark.createDataFrame(rows, finding)


def test_totals(tables):
    _, rows, _, findings = tables
    assert tuple(reports.count_total(findings).first()) == (300, "review and fix")
    assert tuple(reports.count_total(findings.where("false")).first()) == (0, "none found")
    by_severity = {r.severity: r.findings for r in reports.count_by_severity(findings).collect()}
    assert by_severity == Counter(r[7] for r in rows)
    assert sum(r.findings for r in reports.count_by_analyzer(findings).collect()) == 300


def test_sources_without_findings_count_zero(tables):
    sources, rows, source_table, findings = tables
    expected = Counter((r[1], r[2]) for r in rows)
    got = {(r.source_seq, r.analyzer): r for r in reports.count_by_source(source_table, findings).collect()}
    assert len(got) == len(sources) * 3
    assert all(row.findings == expected[key] for key, row in got.items())
    assert got[(0, "regex")].source == "stdin" and got[(20, "tree")].source == "q"


def test_programs(tables):
    sources, rows, source_table, findings = tables
    got = {r.program: r for r in reports.program_report(source_table, findings).collect()}
    assert set(got) == {"p0", "p1", "p2", "quiet"}
    assert all(row.findings == sum(r[0] == name for r in rows) for name, row in got.items())
    assert got["quiet"].files == 1 and got["p1"].high == sum(r[0] == "p1" and r[7] == "high" for r in rows)
    totals = reports.collection_totals(source_table, findings).first()
    assert tuple(totals) == (4, sum(r[0] is not None for r in rows))


def test_matrix(tables):
    _, rows, _, findings = tables
    for row in reports.severity_matrix(findings).collect():
        mine = Counter(r[7] for r in rows if (r[0], r[1]) == (row.program, row.source_seq))
        assert all(row[s] == mine[s] for s in ["critical", "high", "medium", "low"])
        assert row.worst == next((s for s in ["critical", "high", "medium", "low"] if mine[s]), None)
    total = [r for r in reports.severity_rollup(findings).collect() if r.program is None and r.severity is None]
    assert 300 in [r.findings for r in total]


def test_ordinals_follow_the_report(spark, sources, tmp_path):
    table = sources(*[(f"f{i}", "token = abcdefgh\n" * (i % 4)) for i in range(60)])
    found = scan_strict(table, rules_from_rows(spark, catalogue.TEXT_RULES))
    sinks.write_ordered(found, f"{tmp_path}/ordered")
    rows = sinks.read_ordered(spark, f"{tmp_path}/ordered").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, found.count() + 1)) and len(rows) > 50
    keys = [(r.source_seq, r.rule_seq, r.line_number) for r in rows]
    assert keys == sorted(keys)
    sinks.write_ordered(found.where("false"), f"{tmp_path}/none")
    assert sinks.read_ordered(spark, f"{tmp_path}/none").count() == 0
