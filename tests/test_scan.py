import re

import pytest

from auditloom import catalogue
from auditloom.operators import scan
from auditloom.operators.scan import scan_all_patterns, scan_context, scan_guarded, scan_strict
from auditloom.sources.rules import rules_from_rows, stock_rust_rules, stock_solidity_rules
from tests.samples import ALL_PATTERN_HITS, CONTRACT, FIRST_PATTERN_HITS


def hits(findings):
    return {(r.rule_id, r.line_number) for r in findings.collect()}


def rule(id_, *patterns, enabled=True):
    return (id_, "low", enabled, list(patterns), f"about {id_}", None)


def test_contract_hits(spark, sources):
    source = sources(("Relay.sol", CONTRACT))
    assert hits(scan_strict(source, stock_solidity_rules(spark))) == FIRST_PATTERN_HITS
    assert hits(scan_all_patterns(source, stock_solidity_rules(spark))) == ALL_PATTERN_HITS


def test_finding_columns(spark, sources):
    found = scan_strict(sources(("a.rs", "x\n  \tlet a = unsafe {b};　\n")), stock_rust_rules(spark)).collect()
    text = next(r for r in catalogue.RUST_RULES if r[0] == "S-2039")
    assert [r.asDict() for r in found] == [{
        "program": "p", "source_seq": 0, "analyzer": "regex", "rule_seq": 48, "item_seq": 2, "rule_id": "S-2039",
        "vuln_type": "S-2039", "severity": text[1], "message": text[4], "mitigation": text[5], "line_number": 2,
        "code_snippet": "let a = unsafe {b};", "file_path": "a.rs",
    }]


def test_one_hit_per_rule_and_line(spark, sources):
    rules = rules_from_rows(spark, [rule("A", "x", "y"), rule("B", "x"), rule("C", "x", enabled=False), rule("D")])
    source = sources((None, "xx y\ny"))
    assert sorted((r.rule_id, r.line_number) for r in scan_strict(source, rules).collect()) == [("A", 1), ("B", 1)]
    assert sorted((r.rule_id, r.line_number) for r in scan_all_patterns(source, rules).collect()) == [
        ("A", 1), ("A", 2), ("B", 1)
    ]


def test_unicode_semantics(spark, sources):
    rules = rules_from_rows(spark, [rule("W", r"^\w+$"), rule("S", r"a\sb"), rule("D", "x.y"), rule("E", r"z$")])
    source = sources(("u", "naïve\na b\nx\ry\nx y\nz\r"))
    assert hits(scan_strict(source, rules)) == {("W", 1), ("S", 2), ("D", 3), ("D", 4)}
    ascii_only = scan_strict(source, rules, unicode_classes=False)
    assert hits(ascii_only) == {("D", 3), ("D", 4)}


def test_odd_signs_in_rule_texts(spark, sources):
    rows = [("it's", "lo'w", True, [r"a'b\\c", "x"], "back\\slash 'quote' \"double\" {brace} \n end", "ünïcode\\n")]
    row = scan_strict(sources(("p'a", "a'b\\c")), rules_from_rows(spark, rows)).first()
    assert (row.rule_id, row.severity, row.message, row.mitigation) == (rows[0][0], rows[0][1], rows[0][4], rows[0][5])


def test_no_rule_and_no_source(spark, sources):
    assert scan_strict(sources(("a", "x")), rules_from_rows(spark, [rule("A")])).count() == 0
    assert scan_strict(sources(("a", ""), ("b", "\n")), rules_from_rows(spark, [rule("A", "^$")])).count() == 1


def test_rules_beyond_one_array(spark, sources, monkeypatch):
    monkeypatch.setattr(scan, "RULES_PER_ARRAY", 3)
    rules = rules_from_rows(spark, [rule(f"R{i}", f"w{i}[;]") for i in range(24)])
    text = "\n".join(f"w{i};" for i in range(24))
    assert hits(scan_strict(sources(("a", text)), rules)) == {(f"R{i}", i + 1) for i in range(24)}


def test_hundreds_of_rules_in_one_pass(spark, sources):
    rules = rules_from_rows(spark, [rule(f"R{i}", rf"name_{i}\s*;") for i in range(600)])
    text = "\n".join(f"name_{i} ;" for i in range(600))
    assert hits(scan_strict(sources(("a", text)), rules)) == {(f"R{i}", i + 1) for i in range(600)}


def test_any_number_of_rules_reads_sources_once(spark, tmp_path):
    text = "\n".join(f"name_{i} ;" for i in range(0, 2500, 7))
    row = (0, "p", "a", text)
    spark.createDataFrame([row], "source_seq long, program string, path string, code string").write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    named = [rule(f"R{i}", rf"name_{i}\s*;") for i in range(2500)]
    found = scan_strict(table, rules_from_rows(spark, named))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = hits(found)
    parts = set()
    for start in range(0, 2500, 500):
        parts |= hits(scan_strict(table, rules_from_rows(spark, named[start:start + 500])))
    assert got == parts == {(f"R{i}", line + 1) for line, i in enumerate(range(0, 2500, 7))}


def test_rule_texts_are_taken_as_they_are(spark, sources):
    """Nothing in a rule is expanded, and odd patterns mean what they say."""
    rules = rules_from_rows(spark, [
        ("A", "low", True, [r"\$\{env:HOME\}"], "reads ${env:HOME}", "${env:HOME}"),
        ("B", "low", True, [r"\(?<div>"], "b", None), ("C", "low", True, [r"(buy|sell)\d"], "c", None),
        ("D", "low", True, [r"(?P<who>me)[[:digit:]]"], "d", None), ("E", "low", True, [r"\<word\>"], "e", None),
    ])
    found = scan_strict(sources(("a", "${env:HOME}\n/root\n<div>\n(\nsell9\nme7\nswords word\nswords")), rules)
    assert hits(found) == {("A", 1), ("B", 3), ("C", 5), ("D", 6), ("E", 7)}
    assert {(r.message, r.mitigation) for r in found.collect() if r.rule_id == "A"} == {("reads ${env:HOME}", "${env:HOME}")}


CODE = """pub fn run(ctx: Ctx) {
  invoke(&ix, accounts);
  account.reload()?;
  invoke_signed(&ix, accounts, seeds);
  if ctx.is_signer { transfer(a, b); }

  let c = a / 3;
  let d = d * 4 / 3;
  for x in limit { burn(x) }
  swap(slippage);
  freeze(account);
  authority.check();
  close(account)
}
"""


def brute_force(rows, reach):
    """Triggers without guard within ``reach`` lines, by Python's own regexes."""
    found = set()
    text_lines = CODE.splitlines()
    for id_, _, enabled, patterns, *_ in rows:
        if not enabled:
            continue
        parts = re.match(r"^(.*)\.\*\?\(\?<!(.*)\)$", patterns[0])
        trigger, guard = parts.groups() if parts else (patterns[0], None)
        for i, line in enumerate(text_lines):
            near = text_lines[max(i - reach, 0):i + reach + 1]
            if re.search(trigger, line) and not (guard and any(re.search(guard, n) for n in near)):
                found.add((id_, i + 1))
    return found


@pytest.mark.parametrize("reach", [0, 1, 3, 50])
def test_guards(spark, sources, reach):
    rules, source = stock_rust_rules(spark), sources(("a.rs", CODE))
    expected = brute_force(catalogue.RUST_RULES, reach)
    assert hits(scan_context(source, rules, reach)) == expected
    if reach == 0:
        assert hits(scan_guarded(source, rules)) == expected


def test_scan_invariants(spark, sources):
    source = sources(("a.rs", CODE), ("b.sol", CONTRACT))
    rules = rules_from_rows(spark, catalogue.RUST_RULES + catalogue.SOLIDITY_RULES)
    strict, every, guarded, near = (
        hits(scan_strict(source, rules)),
        hits(scan_all_patterns(source, rules)),
        hits(scan_guarded(source, rules)),
        hits(scan_context(source, rules, 1)),
    )
    assert strict <= every and near <= guarded and strict <= guarded


def test_scan_does_not_shuffle(spark, sources):
    plan = scan_guarded(sources(("a.rs", CODE)), stock_rust_rules(spark))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
