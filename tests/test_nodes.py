import random

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.operators.nodes import collapse_nodes, dedup_nodes, lexical_nodes, scan_nodes
from auditloom.plans.audit import audit_programs, audit_rust
from auditloom.plans.reports import collection_totals, count_by_severity, program_report
from auditloom.sources.rules import AnalysisMode, stock_rust_rules
from tests.samples import COLLAPSED, PROGRAM_NODES, PROGRAM_TEXTS


def node_rows(path, nodes, snippet="s"):
    return [
        (path, seq, kind, name, path_len, op, seq + 1, snippet) for seq, (kind, name, path_len, op) in enumerate(nodes)
    ]


@pytest.fixture
def nodes(spark):
    def make(rows):
        return spark.createDataFrame(rows, schemas.CODE_NODES)

    return make


@pytest.mark.parametrize(
    "node, rule",
    [
        (("call", "invoke", 1, None), ("S-1001", "high")),
        (("call", "invoke_signed", 1, None), ("S-1001", "high")),
        (("call", "invoke", 3, None), None),
        (("method_call", "invoke", None, None), ("S-1001", "high")),
        (("call", "transfer_checked", 1, None), ("S-1002", "high")),
        (("method_call", "transfer", None, None), ("S-1002", "high")),
        (("binary", None, None, "+"), ("S-1003", "critical")),
        (("binary", None, None, "+="), None),
        (("call", "from_bytes", 1, None), ("S-2012", "critical")),
        (("method_call", "from_bytes", None, None), None),
        (("call", "create_program_address", 1, None), ("S-2015", "medium")),
        (("loop", None, None, None), ("S-2036", "high")),
        (("while", None, None, None), ("S-2036", "medium")),
        (("for", None, None, None), ("S-2036", "low")),
        (("fn", "f", None, None), ("S-2035", "low")),
        (("struct", "S", None, None), ("S-2002", "medium")),
        (("enum", "E", None, None), None),
    ],
)
def test_checks(nodes, node, rule):
    found = scan_nodes(nodes(node_rows("a.rs", [node]))).collect()
    assert [(r.rule_id, r.severity) for r in found] == ([rule] if rule else [])


def test_method_and_call_have_their_own_message(nodes):
    calls = node_rows("a.rs", [("call", "invoke", 1, None), ("method_call", "invoke", None, None)])
    assert len({r.message for r in scan_nodes(nodes(calls)).collect()}) == 2


def test_nodes_without_position_are_dropped(nodes):
    rows = [
        ("a", 0, "fn", "f", None, None, 0, "s"),
        ("a", 1, "fn", "f", None, None, 1, ""),
        ("a", 2, "fn", "f", None, None, 1, "unknown"),
        ("a", 3, "fn", "f", None, None, 1, "s"),
    ]
    found = scan_nodes(nodes(rows))
    assert [r.item_seq for r in dedup_nodes(found).collect()] == [3]
    # A report without positions keeps nodes that have none.
    assert [r.item_seq for r in collapse_nodes(found).collect()] == [0]


def test_keep_first(nodes):
    kinds = ["for", "loop", "while"]
    random.seed(1)
    rows = [
        (f"f{random.randrange(3)}", seq, random.choice(kinds), None, None, None, 1 + random.randrange(2), "s")
        for seq in range(200)
    ]
    severity = {"for": "low", "loop": "high", "while": "medium"}
    first, first_of_file = {}, {}
    for path, seq, kind, _, _, _, line, _ in rows:
        first.setdefault((path, line), (seq, severity[kind]))
        first_of_file.setdefault(path, (seq, severity[kind]))
    random.shuffle(rows)
    found = scan_nodes(nodes(rows))
    got = {(r.path, r.line_number): (r.item_seq, r.severity) for r in dedup_nodes(found).collect()}
    assert got == first
    collapsed = collapse_nodes(found).collect()
    assert {r.path: (r.item_seq, r.severity) for r in collapsed} == first_of_file
    assert {(r.line_number, r.code_snippet) for r in collapsed} == {(1, "code snippet")}


def test_program_collection(spark, nodes):
    rows, sources = [], []
    for seq, (program, listed) in enumerate(PROGRAM_NODES.items()):
        rows += node_rows(f"{program}/lib.rs", listed)
        sources.append((seq, program, f"{program}/lib.rs", ""))
    sources.append((9, "empty", "empty/lib.rs", ""))
    table = spark.createDataFrame(sources, schemas.SOURCES)
    found = audit_programs(table, nodes(rows))
    got = {}
    for r in found.collect():
        got.setdefault(r.program, set()).add((r.rule_id, r.severity))
    assert got == COLLAPSED
    severities = {r.severity: r.findings for r in count_by_severity(found).collect()}
    assert severities == {"low": 5, "medium": 5, "high": 1, "critical": 1}
    totals = collection_totals(table.where("program <> 'empty'"), found).first()
    assert tuple(totals) == (5, 12)
    report = {r.program: (r.files, r.findings) for r in program_report(table, found).collect()}
    assert report["exchange"] == (1, 4) and report["empty"] == (1, 0)


def test_lexical_nodes(sources):
    code = (
        "pub fn f() { // loop g(\n"
        "  invoke(x); a::invoke(y); z.transfer(1);\n"
        "  loop { println!(x) } while (ok) {}\n"
        "struct Été { a: fn(u8) }  if (x) for_each (y) myfor 3for(\n"
        "  0..from_bytes(b)\n"
    )
    found = lexical_nodes(sources(("a.rs", code))).orderBy("node_seq").collect()
    assert [(r.line_number, r.kind, r.name, r.path_len) for r in found] == [
        (1, "fn", "f", None),
        (2, "call", "invoke", 1),
        (2, "call", "invoke", 2),
        (2, "method_call", "transfer", None),
        (3, "loop", "loop", None),
        (3, "while", "while", None),
        (4, "struct", "Été", None),
        (4, "call", "for_each", 1),
        (5, "call", "from_bytes", 1),
    ]


def test_programs_from_their_texts(sources):
    table = sources(*[(f"{name}/lib.rs", text) for name, text in PROGRAM_TEXTS.items()])
    found = audit_programs(table, lexical_nodes(table)).collect()
    got = {}
    for r in found:
        got.setdefault(r.file_path.removesuffix("/lib.rs"), set()).add((r.rule_id, r.severity))
    assert got == COLLAPSED


def kinds(table):
    return [(r.line_number, r.kind, r.name or r.op) for r in lexical_nodes(table).orderBy("source_seq", "node_seq").collect()]


@pytest.mark.parametrize("code, nodes", [
    ("impl A { fn a(&self) { fn b() {} } }\nfn c() {}", [(1, "fn", "b"), (2, "fn", "c")]),
    ("trait A { fn a(); fn b() {} }\nextern \"C\" { fn c(); }", []),
    ("fn f() -> impl Fn() + Send { x }", [(1, "fn", "f"), (1, "call", "Fn")]),
    ("impl A for B\nwhere\n  T: X,\n{\n  fn a() {}\n}\nfn b() {}", [(7, "fn", "b")]),
    ("fn f(x: impl A) { fn g() {} }", [(1, "fn", "f"), (1, "fn", "g")]),
    ("let u = \"http://x\"; loop {}", [(1, "loop", "loop")]),
    ("let s = \"a \\\" fn x()\nfn y()\"; fn z() {}", [(2, "fn", "z")]),
    ("/* a /* b */ fn c() */ fn d() {}", [(1, "fn", "d")]),
    ("/* fn a()\nfn b() */\nfn c() {}", [(3, "fn", "c")]),
    ("/* never closed\nfn a() {}", []),
    ("let c = '\"'; fn a<'x>(b: &'x str) {}", [(1, "fn", "a")]),
    ("r#\"fn a() \"fn b()\"# ; fn c() {}", [(1, "fn", "c")]),
    ("#[cfg(any(a, b + c))]\nmacro_rules! m { () => { fn a() {} } }\nvec![x + y; z(1)]\nfn d() {}", [(4, "fn", "d")]),
    ("m! { fn a() { b + c } }\nif a != (b) { c(d) }", [(2, "call", "c")]),
    ("a + b - c * d / e", [(1, "binary", o) for o in "+-*/"]),
    ("x += 1; y -> z; *p = -q; return -1; 1e-5; a\n  + b", [(2, "binary", "+")]),
    ("fn f<T: A0b + Cd>(x: Box<dyn Ef + 'static>) -> u8 { N + M }", [(1, "fn", "f"), (1, "binary", "+")]),
    ("for x in y {}\nimpl A for B {}\nfor<'a> fn(&'a u8)", [(1, "for", "for")]),
    ("} ) ] fn a() { ( fn b() {}", [(1, "fn", "a"), (1, "fn", "b")]),
    ("", []),
])
def test_scopes(sources, code, nodes):
    assert kinds(sources(("a.rs", code))) == nodes


def test_texts_of_any_length(sources):
    """Comments and strings of many lines do not overflow a stack."""
    code = "/*" + " * a / b\n" * 30_000 + "*/\n" + "\"" + "x\\n\n" * 30_000 + "\"\n" + "fn a() { b(c) }\n" * 3_000
    found = kinds(sources(("a.rs", code), (None, "fn z() {}"), ("b", None)))
    assert len(found) == 6_001 and found[0] == (60_003, "fn", "a")


def test_nodes_keep_to_their_source(spark):
    """Inline sources have tree findings, and sources of one path keep to their own."""
    rows = [(0, "p", None, "loop {}"), (1, "p", "a.rs", "loop {}"), (2, "q", "a.rs", "x\nfn f() {}")]
    table = spark.createDataFrame(rows, schemas.SOURCES)
    mode = AnalysisMode(regex=False, ast=True, llm=False)
    found = audit_rust(table, stock_rust_rules(spark), mode, nodes=lexical_nodes(table)).collect()
    assert sorted((r.source_seq, r.program, r.file_path or "", r.line_number) for r in found) == [
        (0, "p", "", 1), (1, "p", "a.rs", 1), (2, "q", "a.rs", 2)
    ]
    with pytest.raises(ValueError, match="nodes"):
        audit_rust(table, stock_rust_rules(spark), mode)


def test_dedup_reduces_before_the_shuffle(nodes):
    plan = dedup_nodes(scan_nodes(nodes(node_rows("a", [("fn", "f", None, None)]))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text and "SortAggregate" not in text and "Window" not in text
    assert plan.select(F.count("*")).first()[0] == 1
