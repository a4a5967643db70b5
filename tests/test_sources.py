import json
import time

import pytest
from pyspark.errors import AnalysisException

from auditloom import catalogue
from auditloom.operators.dedup import keep_first_source
from auditloom.operators.routing import skipped_sources, tree_sources
from auditloom.operators.scan import scan_strict
from auditloom.sources import sinks
from auditloom.operators.solidity import locate
from auditloom.sources.files import (
    list_files,
    drop_blank_inline,
    extension_glob,
    read_programs,
    read_rust_file,
    read_solidity_project,
    read_sources,
    table_sources,
)
from auditloom.sources.tables import save_by_path
from auditloom.sources.rules import read_rule_file, stock_rust_rules
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    files = {
        "one/a.sol": "a\r\nb\n",
        "one/deep/b.SOL": "\n",
        "one/deep/empty.sol": "",
        "one/deep/c.Json": "{}",
        "one/skip.txt": "x",
        "one/with space.sol": "s",
        "two/a.sol": "other",
        "two/lib.rs": "fn f() {}",
        "two/LIB.RS": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "two/bad.sol").write_bytes(b"ok \xff\xfe")
    return tmp_path


def names(frame, tree):
    return sorted(r.path.removeprefix(f"{tree}/") for r in frame.collect())


def test_directories_and_files(spark, tree):
    roots = [str(tree / "one"), str(tree / "two/a.sol"), str(tree / "two/lib.rs")]
    sources, rejects = read_sources(spark, roots, catalogue.SOLIDITY_EXTENSIONS)
    assert names(sources, tree) == [
        "one/a.sol", "one/deep/b.SOL", "one/deep/c.Json", "one/deep/empty.sol", "one/with space.sol", "two/a.sol"
    ]
    assert rejects.count() == 0
    code = {r.path.rsplit("/", 1)[1]: r.code for r in sources.collect()}
    assert code["b.SOL"] == "\n" and "a\r\nb\n" in [r.code for r in sources.collect()]
    assert sources.select("source_seq").distinct().count() == 6
    assert code["empty.sol"] == ""


def test_overlapping_roots_give_each_file_once(spark, tree):
    roots = [str(tree / "one/deep"), str(tree / "one"), str(tree / "one/a.sol"), str(tree / "one/../one/deep/b.SOL")]
    sources, _ = read_sources(spark, roots, catalogue.SOLIDITY_EXTENSIONS)
    assert names(sources, tree) == ["one/a.sol", "one/deep/b.SOL", "one/deep/c.Json", "one/deep/empty.sol", "one/with space.sol"]
    order = [r.path.rsplit("/", 1)[1] for r in sources.orderBy("source_seq").collect()]
    assert set(order[:3]) == {"b.SOL", "c.Json", "empty.sol"}


def test_rust_files_and_programs(spark, tree):
    sources, _ = read_sources(spark, [str(tree)], catalogue.RUST_EXTENSIONS, any_case=False, program_root=str(tree))
    assert [(r.program, r.path.rsplit("/", 1)[1]) for r in sources.collect()] == [("two", "lib.rs")]


def test_reading_as_the_scans_do(spark, tree):
    project, _ = read_solidity_project(spark, str(tree), ["two/a.sol", "two/lib.rs", "one/a.sol"], ["one/deep"])
    assert names(project, tree) == ["one/a.sol", "one/deep/b.SOL", "one/deep/c.Json", "one/deep/empty.sol", "two/a.sol"]
    programs, _ = read_programs(spark, str(tree))
    assert [r.program for r in programs.collect()] == ["two"]
    given = str(tree) + "/one/../one/skip.txt"
    single, _ = read_rust_file(spark, given)
    assert [(r.path, r.code) for r in single.collect()] == [(given, "x")]
    with pytest.raises(ValueError, match="no file"):
        read_solidity_project(spark, str(tree))


def test_tables_by_path_join_in_place(spark, sources, tmp_path):
    table = sources(*[(f"f{i}.sol", f"x{i}\ny") for i in range(50)])
    spans = spark.createDataFrame([(f"f{i}.sol", "3:1:0") for i in range(50)], "path string, src string")
    save_by_path(table, "bucketed_sources", 4, str(tmp_path / "s"))
    save_by_path(spans, "bucketed_spans", 4, str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = locate(spark.table("bucketed_spans"), spark.table("bucketed_sources"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert found.where("line_number in (1, 2) and code_snippet in ('', 'y')").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_sources")
        spark.sql("DROP TABLE bucketed_spans")


def test_any_extension_and_broken_text(spark, tree):
    sources, rejects = read_sources(spark, [str(tree / "two")])
    assert names(sources, tree) == ["two/LIB.RS", "two/a.sol", "two/lib.rs"]
    assert [(r.stage, r.reason) for r in rejects.collect()] == [("read", "not UTF-8")]


def test_names_that_readers_pass_over_are_rejects(spark, tmp_path):
    for name in ("a.sol", "_b.sol", ".c.sol", ".hid/d.sol", "empty.sol", "_skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.sol" else "x")
    sources, rejects = read_sources(spark, [str(tmp_path)], ["sol"])
    assert names(sources, tmp_path) == ["a.sol", "empty.sol"]
    assert names(rejects, tmp_path) == [".c.sol", ".hid/d.sol", "_b.sol"]
    assert {r.reason for r in rejects.collect()} == {"name that readers pass over"}
    with pytest.raises(ValueError, match="_b.sol"):
        read_rust_file(spark, str(tmp_path / "_b.sol"))


def test_a_rule_folder_holds_one_file(spark, tmp_path):
    text = '[[rules]]\nid = "A"\ndescription = "d"\nseverity = "low"\npatterns = ["x"]\nenabled = true\n'
    (tmp_path / "one.toml").write_text(text)
    assert read_rule_file(spark, str(tmp_path))[0].count() == 1
    (tmp_path / "two.toml").write_text(text)
    with pytest.raises(ValueError, match="not one rule file"):
        read_rule_file(spark, str(tmp_path))


def test_missing_root(spark, tree):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_sources(spark, [str(tree / "nowhere")])


def test_glob():
    assert extension_glob(["sol", "json"], True) == "?*.{[sS][oO][lL],[jJ][sS][oO][nN]}"
    assert extension_glob(["rs"], False) == "?*.{rs}"


def test_inline_texts(spark):
    table = spark.createDataFrame([(1, " \t\n　"), (2, "x"), (3, "")], "id long, t string")
    sources = table_sources(table, F.col("id"), F.col("t"))
    assert [r.source_seq for r in drop_blank_inline(sources).collect()] == [2]
    assert {r.path for r in sources.collect()} == {None}


def test_keep_first(spark):
    rows = [(5, "p", "a", "late"), (2, "p", "a", "first"), (9, "q", "b", "only"), (3, "p", None, "x"), (4, "p", None, "x")]
    rows += [(seq, "p", "hot", str(seq)) for seq in range(100, 300)]
    table = spark.createDataFrame(rows, "source_seq long, program string, path string, code string")
    kept = {(r.source_seq, r.path, r.code) for r in keep_first_source(table).collect()}
    assert kept == {(2, "a", "first"), (9, "b", "only"), (3, None, "x"), (4, None, "x"), (100, "hot", "100")}


def test_routes(sources):
    table = sources(("a.sol", ""), ("b.JSON", ""), (None, ""))
    assert [r.path for r in tree_sources(table).collect()] == ["a.sol"]
    assert {(r.path, r.reason) for r in skipped_sources(table).collect()} == {
        ("b.JSON", "JSON artifact"), (None, "no path")
    }


def test_json_sink(spark, sources, tmp_path):
    table = sources(*[(f"f{i}.rs" if i else None, "let x = f32::MAX - 1; // é \"q\"\nunsafe {\nunsafe {") for i in range(6)])
    found = scan_strict(table, stock_rust_rules(spark))
    out = str(tmp_path / "out")
    sinks.write_json(found, out)
    texts = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(texts) == 18
    assert list(texts[0]) == [
        "ruleId", "vulnType", "severity", "message", "mitigation", "lineNumber", "codeSnippet", "filePath"
    ]
    by_file = [t for name in sorted((tmp_path / "out").glob("part-*")) for t in map(json.loads, name.open())]
    assert [(t["filePath"], t["ruleId"], t["lineNumber"]) for t in by_file] == [
        (f"f{i}.rs" if i else None, rule, line)
        for i in range(6) for rule, line in [("S-2005", 1), ("S-2039", 2), ("S-2039", 3)]
    ]
    assert sorted(r.json for r in sinks.json_texts(found).collect()) == sorted(
        json.dumps(t, ensure_ascii=False, separators=(",", ":")) for t in texts
    )
    table_out = str(tmp_path / "table")
    sinks.write_parquet(found, table_out)
    assert spark.read.parquet(table_out).count() == 18


def test_listed_files_with_any_names(spark, tmp_path):
    """Names that look like parts of a listing are listed as they are, and so are empty and hidden files."""
    names = ["a.rs", "x, y.rs", "deep/_b.rs", "c; isDirectory=false; length=7; .rs", "FileStatus{path=q; .rs", "new\nline.rs"]
    for chosen in (names[:3], names, names[-1:]):
        folder = tmp_path / str(len(chosen))
        (folder / "deep").mkdir(parents=True)
        for size, name in enumerate(chosen):
            (folder / name).write_text("x" * size)
        found = sorted((path.partition(f"{folder}/")[2], length) for path, length in list_files(spark, str(folder)))
        assert found == sorted((name, size) for size, name in enumerate(chosen))
    assert [n for _, n in list_files(spark, str(tmp_path / "3/x, y.rs"))] == [1]


def test_listing_starts_no_process_for_a_file(spark, tmp_path):
    """A folder of many files is listed in much less than the time of a process for each."""
    for i in range(3000):
        (tmp_path / f"{i}.rs").touch()
    begin = time.perf_counter()
    assert len(list_files(spark, str(tmp_path))) == 3000
    assert time.perf_counter() - begin < 7
