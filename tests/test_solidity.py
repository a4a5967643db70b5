import json

import pytest

from auditloom.operators import solidity
from auditloom.operators.solidity import functions, locate, locate_many, open_setters, setter_findings, unreadable_trees
from auditloom.plans import inputs, registry
from auditloom.plans.audit import audit_rejects, audit_solidity, rust_rejects
from auditloom.sources.rules import AnalysisMode, rules_from_rows, stock_rust_rules, stock_solidity_rules
from tests.samples import CONTRACT, FIRST_PATTERN_HITS, OPEN_SETTER_LINES, contract_tree


@pytest.fixture
def trees(spark):
    def make(*pairs):
        rows = [(path, tree if isinstance(tree, str) else json.dumps(tree)) for path, tree in pairs]
        return spark.createDataFrame(rows, "path string, tree string")

    return make


def function(**members):
    return {
        "nodeType": "FunctionDefinition", "name": "setX", "visibility": "public", "stateMutability": "nonpayable",
        "src": "0:4:0", "modifiers": [], **members,
    }


def contract(*members):
    return {"nodes": [{"nodeType": "ContractDefinition", "name": "C", "nodes": list(members)}]}


def modifier(name):
    return {"nodeType": "ModifierInvocation", "modifierName": {"name": name}}


@pytest.mark.parametrize("size", [1, 3, 7, 4096])
def test_spans_by_blocks(spark, sources, monkeypatch, size):
    """Blocks of any size give the lines and snippets that whole texts give."""
    monkeypatch.setattr(solidity, "BLOCK_BYTES", size)
    codes = ["", "a", "\n\n", "ab\ncd\r\nef\n", "é€😀\n x é\n", "  spaced  \n\tout\n" * 5]
    table = sources(*[(f"f{i}", code) for i, code in enumerate(codes)])
    spans = [
        (f"f{i}", f"{start}:{length}:0") for i, code in enumerate(codes) for start in range(0, len(code.encode()) + 3, 2)
        for length in (0, 1, 4, 11, 10**12)
    ] + [("f1", "x:1:0"), ("f1", "1"), ("none", "0:1:0"), ("f1", None), (None, "0:1:0"), ("f3", "2:3:0"), ("f3", "2:3:0")]
    found = spark.createDataFrame(spans, "path string, src string")
    columns = ["path", "src", "span_offset", "span_length", "source_seq", "program", "line_number", "code_snippet"]
    whole, many = (sorted(map(repr, f(found, table).select(columns).collect())) for f in (locate, locate_many))
    assert whole == many and len(whole) > 200


@pytest.fixture
def documents(spark, tmp_path):
    """A folder with a table of documents, from (doc_id, text) pairs."""

    def make(*pairs):
        rows = [(doc_id, text, "en", "s", None) for doc_id, text in pairs]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        table.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_spans_of_empty_texts_and_large_ids(spark, documents):
    """An empty text has an empty span, no text has none, and ids may be as large as they get."""
    text, large = "ab\nc\u00e9 \u20acd\nef" * 9, 2**63 - 5
    start = large * 7919 % len(text)
    rows = registry.sol_spans(spark, documents((4, ""), (5, None), (6, "x"), (large, text))).collect()
    assert sorted((r.source_seq, r.span_offset, r.line_number, r.code_snippet) for r in rows) == [
        (4, 0, 1, ""), (6, 0, 1, "x"),
        (large, len(text[:start].encode()), 1 + text[:start].count("\n"), text[start:start + 40].strip()),
    ]


def test_no_text_moves_for_spans(spark, documents):
    plan = inputs.document_spans(spark, documents((1, "some text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_open_setters_of_the_contract(spark, sources, trees):
    source = sources(("Relay.sol", CONTRACT))
    found = setter_findings(trees(("Relay.sol", contract_tree())), source, stock_solidity_rules(spark)).collect()
    assert {r.line_number for r in found} == OPEN_SETTER_LINES and len(found) == 2
    assert all(r.code_snippet.startswith("function ") and r.code_snippet.endswith("}") for r in found)
    assert {(r.rule_id, r.severity) for r in found} == {("EVM-1001", "high")}


def test_whole_audit(spark, sources, trees):
    source = sources(("Relay.sol", CONTRACT), (None, " \n\t"), (None, "x.delegatecall(y)"))
    found = audit_solidity(
        source, stock_solidity_rules(spark), AnalysisMode(True, True, False), trees(("Relay.sol", contract_tree()))
    ).collect()
    by_analyzer = {a: {(r.rule_id, r.line_number) for r in found if r.analyzer == a} for a in ("regex", "tree")}
    assert by_analyzer["regex"] == FIRST_PATTERN_HITS | {("EVM-2001", 1)}
    assert by_analyzer["tree"] == {("EVM-1001", n) for n in OPEN_SETTER_LINES}
    with pytest.raises(ValueError, match="no analyzer"):
        audit_solidity(source, stock_solidity_rules(spark), AnalysisMode(False, False, False))


@pytest.mark.parametrize(
    "members, is_open",
    [
        ({}, True),
        ({"name": "SETx"}, True),
        ({"name": "settle"}, True),
        ({"name": "reset"}, False),
        ({"name": ""}, False),
        ({"name": None}, False),
        ({"visibility": "internal"}, False),
        ({"visibility": None}, False),
        ({"stateMutability": "view"}, False),
        ({"stateMutability": "pure"}, False),
        ({"stateMutability": "payable"}, True),
        ({"stateMutability": None}, True),
        ({"modifiers": None}, True),
        ({"modifiers": [modifier("ONLYowner")]}, False),
        ({"modifiers": [modifier("lock"), modifier("restricted")]}, False),
        ({"modifiers": [modifier("onlyOwners"), {"modifierName": {}}, {}]}, True),
        ({"nodeType": "ModifierDefinition"}, False),
        ({"nodeType": "EventDefinition"}, False),
    ],
)
def test_setter_conditions(trees, members, is_open):
    tree = contract(function(**members))
    assert open_setters(functions(trees(("a.sol", tree)))).count() == is_open


def test_absent_members(trees):
    bare = {"nodeType": "FunctionDefinition"}
    deep = {"nodeType": "StructDefinition", "nodes": [function()]}
    table = trees(
        ("a", {}), ("b", {"nodes": []}), ("c", {"nodes": [{"nodeType": "ContractDefinition"}]}),
        ("d", contract(bare, deep)), ("e", {"nodes": [function()]}), ("f", "oops"), ("g", {"nodes": 5}),
    )
    rows = functions(table).collect()
    assert [(r.path, r.name, r.visibility, r.state_mutability, r.src, r.modifiers) for r in rows] == [
        ("d", "", "", "", None, [])
    ]
    assert [r.path for r in unreadable_trees(table).collect()] == ["f"]


def test_spans_and_routes(spark, sources, trees):
    tree = contract(function(src="3:5:0"), function(src="x:5:0"), function(src=None), function(src="99:5:0"))
    table = trees(*[(p, tree) for p in ("a.sol", "b.JSON", "other.sol")])
    source = sources(("a.sol", "é\n{ü}\n"), ("b.JSON", "{}"), (None, "x"))
    found = setter_findings(table, source, stock_solidity_rules(spark)).collect()
    assert sorted((r.file_path, r.line_number, r.code_snippet) for r in found) == [("a.sol", 2, "{ü}"), ("a.sol", 3, "")]


def test_rule_text(spark, sources, trees):
    source, table = sources(("a.sol", "x")), trees(("a.sol", contract(function())))

    def texts(rules):
        return [(r.severity, r.message, r.mitigation) for r in setter_findings(table, source, rules).collect()]

    assert texts(stock_rust_rules(spark)) == [("medium", "Potentially unprotected privileged function", None)]
    twice = [("EVM-1001", "low", True, [], "one", "m"), ("EVM-1001", "high", False, [], "two", None)]
    assert texts(rules_from_rows(spark, twice)) == [("high", "two", None)]


def test_rejects_name_every_source_that_was_left_out(spark, sources, trees):
    source = sources(("a.sol", "x"), ("b.sol", "x"), ("c.sol", "x"), ("d.json", "{}"), (None, "x"))
    rejects = audit_rejects(source, trees=trees(("a.sol", contract()), ("b.sol", "oops")))
    assert sorted((r.path or "", r.reason) for r in rejects.collect()) == [
        ("", "no path"), ("b.sol", "not a JSON object"), ("c.sol", "no tree"), ("d.json", "JSON artifact")
    ]
    unparsed = spark.createDataFrame([("l.rs", "line 3")], "path string, reason string")
    assert [tuple(r) for r in rust_rejects(unparsed=unparsed).collect()] == [("nodes", "l.rs", "line 3")]


def test_a_repeated_path_counts_once(spark, sources, trees):
    source = sources(("Relay.sol", CONTRACT), ("Relay.sol", CONTRACT))
    mode = AnalysisMode(True, True, False)
    found = audit_solidity(source, stock_solidity_rules(spark), mode, trees(("Relay.sol", contract_tree()))).collect()
    assert len(found) == len(FIRST_PATTERN_HITS) + len(OPEN_SETTER_LINES)
