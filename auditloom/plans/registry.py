"""One query per operator family, over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import catalogue
from auditloom.functions.text import clean_path, display_name, has_extension, is_json
from auditloom.operators import candidates, dedup, nodes, responses, routing, rules, scan, solidity
from auditloom.operators.lines import snippets
from auditloom.plans import inputs, reports
from auditloom.plans.audit import audit_programs, audit_rejects, audit_rust, audit_solidity, rust_rejects
from auditloom.sources import files, sinks
from auditloom.sources.rules import (
    AnalysisMode,
    read_rule_file,
    read_rules,
    rules_from_rows,
    stock_rust_rules,
    stock_solidity_rules,
)
from auditloom.sources.workspace import shared_folder
from auditloom.streaming.dedup import drop_redelivered
from auditloom.streaming.scan import arriving_files, run_to_end

Query = Callable[[SparkSession, str], DataFrame]
CONTEXT_REACH = 2

_SHOWN = [
    "program", "source_seq", "analyzer", "rule_id", "vuln_type", "severity", "message", "mitigation",
    "line_number", "code_snippet", "file_path",
]


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select(*_SHOWN)


# Sources and sinks.


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items written as files, a thousand in each, and read back whole."""
    folder = shared_folder(spark, "src_files")
    items = inputs.table(spark, sf_dir, "benchmark").withColumn("block", F.expr("item_id div 1000"))
    dealt = items.repartition("block").sortWithinPartitions("block", "item_id")
    dealt.select("text", "block").write.partitionBy("block").text(folder)
    sources, _ = files.read_sources(spark, [folder], ["txt"], program_root=folder)
    return sources.select(F.regexp_extract("program", "block=([0-9]+)", 1).cast("bigint").alias("block"), "code")


def src_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project with roots inside each other: directories count before targets, and each file once."""
    folder = shared_folder(spark, "src_project")
    inputs.write_project(spark, sf_dir, folder)
    sources, _ = files.read_solidity_project(
        spark, folder, targets=["dir=a", "dir=b/place=1", "dir=c/place=2", "dir=a"], target_dirs=["dir=c/place=4", "dir=b"]
    )
    place = "/dir=([abc])/place=([0-9]+)/part-[^/]*([.][A-Za-z]+)$"
    return sources.select(
        F.shiftright("source_seq", 52).cast("int").alias("root"), F.regexp_extract("path", place, 1).alias("dir"),
        F.regexp_extract("path", place, 2).cast("bigint").alias("place"), F.regexp_extract("path", place, 3).alias("ending"),
        "code",
    )


def src_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = files.drop_blank_inline(inputs.inline_sources(spark, sf_dir))
    return kept.select("source_seq", display_name(F.col("path")).alias("source"), "code")


def src_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return inputs.text_sources(spark, sf_dir).select(
        "source_seq", "path",
        has_extension(path, catalogue.SOLIDITY_EXTENSIONS, any_case=True).alias("solidity"),
        has_extension(path, catalogue.RUST_EXTENSIONS, any_case=False).alias("rust"),
        is_json(path).alias("json"),
    )


def src_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivered = inputs.redelivered_sources(spark, sf_dir).withColumn("path", clean_path(F.col("path")))
    return dedup.keep_first_source(delivered).select("source_seq", "path", "code")


def out_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON in report order, and read back."""
    folder = shared_folder(spark, "out_json")
    sinks.write_json(_text_findings(spark, sf_dir), folder)
    schema = ", ".join(
        f"{key} {'BIGINT' if key == 'lineNumber' else 'STRING'}" for _, key in sinks.JSON_KEYS
    )
    return spark.read.schema(schema).json(folder)


def out_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written in report order, and read back with their places in it."""
    folder = shared_folder(spark, "out_ordered")
    sinks.write_ordered(_text_findings(spark, sf_dir), folder)
    return sinks.read_ordered(spark, folder).select("ordinal", "source_seq", "rule_id", "line_number", "code_snippet")


# Rules.


def rules_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table written as JSON and read back with checks."""
    folder = shared_folder(spark, "rules_load")
    inputs.part_rules(spark, sf_dir).write.option("ignoreNullFields", "false").json(folder)
    return read_rules(spark, folder).withColumn("patterns", F.array_join("patterns", " , "))


def rules_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part rules as a TOML file in parts, and read back with its mode."""
    folder = shared_folder(spark, "rules_toml")
    inputs.write_rule_file(spark, sf_dir, folder)
    table, mode = read_rule_file(spark, folder, in_parts=True)
    modes = [F.lit(value).alias(f"mode_{name}") for name, value in mode._asdict().items()]
    return table.withColumn("patterns", F.array_join("patterns", " , ")).select("*", *modes)


def rules_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.pattern_states(inputs.part_rules(spark, sf_dir))


def rules_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.active_rules(inputs.part_rules(spark, sf_dir))


def rules_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rejected_rules(inputs.part_rules(spark, sf_dir))


def rules_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.lint_rules(inputs.part_rules(spark, sf_dir))


def rules_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.last_rule_texts(inputs.part_rules(spark, sf_dir))


# Lines and scans.


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(inputs.crlf_sources(spark, sf_dir)).select("source_seq", "line_number", "line", "code_snippet")


def route_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.text_sources(spark, sf_dir).withColumn(
        "path", F.when(F.col("source_seq") % 5 != 0, F.col("path"))
    )
    return routing.with_route(sources).select("source_seq", "path", "tree_skip")


def code_rules(spark: SparkSession) -> DataFrame:
    """All stock code rules, numbered through."""
    return rules_from_rows(spark, catalogue.RUST_RULES + catalogue.SOLIDITY_RULES)


def _text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_strict(inputs.text_sources(spark, sf_dir), rules_from_rows(spark, catalogue.TEXT_RULES))


def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_text_findings(spark, sf_dir))


def scan_odd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan.scan_strict(inputs.text_sources(spark, sf_dir), inputs.odd_rules(spark, sf_dir)))


def scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every part: lines meet rules by the rarest piece of what a hit needs."""
    return _shown(candidates.scan_many(inputs.text_sources(spark, sf_dir), inputs.many_rules(spark, sf_dir)))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_rules = rules_from_rows(spark, catalogue.PAGE_RULES)
    return _shown(scan.scan_all_patterns(inputs.page_sources(spark, sf_dir), page_rules))


def scan_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan.scan_strict(inputs.code_sources(spark, sf_dir), code_rules(spark)))


def scan_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan.scan_all_patterns(inputs.code_sources(spark, sf_dir), code_rules(spark)))


def scan_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan.scan_guarded(inputs.text_sources(spark, sf_dir), stock_rust_rules(spark)))


def scan_guarded_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan.scan_guarded(inputs.code_sources(spark, sf_dir), stock_rust_rules(spark)))


def scan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_context(inputs.code_sources(spark, sf_dir), stock_rust_rules(spark), CONTEXT_REACH)
    return _shown(found)


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.code_sources(spark, sf_dir)
    return audit_rust(
        sources,
        stock_rust_rules(spark),
        AnalysisMode(regex=True, ast=True, llm=True),
        nodes=nodes.lexical_nodes(sources),
        responses=inputs.answers(spark, sf_dir),
    )


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_all_findings(spark, sf_dir))


def audit_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole Solidity audit: line rules and open setters."""
    return _shown(audit_solidity(
        inputs.contract_sources(spark, sf_dir),
        stock_solidity_rules(spark),
        AnalysisMode(regex=True, ast=True, llm=False),
        trees=inputs.contract_trees(spark, sf_dir),
    ))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rejects(
        inputs.text_sources(spark, sf_dir),
        trees=inputs.document_trees(spark, sf_dir),
        responses=inputs.answers(spark, sf_dir),
    )


# Reports.


def count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_total(_all_findings(spark, sf_dir))


def count_by_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_analyzer(_all_findings(spark, sf_dir))


def count_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_severity(_all_findings(spark, sf_dir))


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_source(inputs.code_sources(spark, sf_dir), _all_findings(spark, sf_dir))


def report_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_matrix(scan.scan_guarded(inputs.text_sources(spark, sf_dir), stock_rust_rules(spark)))


def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_rollup(scan.scan_guarded(inputs.text_sources(spark, sf_dir), stock_rust_rules(spark)))


def _collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, findings, files that could not be read) of a collection of program directories."""
    folder = shared_folder(spark, "programs")
    inputs.write_programs(spark, sf_dir, folder)
    sources, unread = files.read_programs(spark, folder)
    return sources, audit_programs(sources, nodes.lexical_nodes(sources)), unread


def program_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.program_report(*_collection(spark, sf_dir)[:2])


def program_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.collection_totals(*_collection(spark, sf_dir)[:2])


def program_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the collection that were left out; the other programs count."""
    place = "program=([^/]+)/block=([0-9]+)/"
    return rust_rejects(unread=_collection(spark, sf_dir)[2]).select(
        "stage", "reason", F.regexp_extract("path", place, 1).alias("program"),
        F.regexp_extract("path", place, 2).cast("bigint").alias("block"),
    )


# Syntax nodes.


def nodes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.scan_nodes(inputs.item_nodes(spark, sf_dir))


def nodes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.dedup_nodes(nodes.scan_nodes(inputs.item_nodes(spark, sf_dir)))


def nodes_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.collapse_nodes(nodes.scan_nodes(inputs.item_nodes(spark, sf_dir)))


def nodes_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.lexical_nodes(inputs.code_sources(spark, sf_dir)).drop("source_seq", "program")


# Solidity trees.


def sol_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = solidity.functions(inputs.contract_trees(spark, sf_dir))
    return found.withColumn("modifiers", F.array_join("modifiers", ",")).drop("contract_pos")


def sol_setters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(solidity.setter_findings(
        inputs.contract_trees(spark, sf_dir), inputs.contract_sources(spark, sf_dir), stock_solidity_rules(spark)
    ))


def sol_setters_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open setters where the rule table has no rule for them: the default text stands in."""
    other = stock_solidity_rules(spark).where(F.col("id") != catalogue.SETTER_RULE_ID)
    return _shown(solidity.setter_findings(inputs.contract_trees(spark, sf_dir), inputs.contract_sources(spark, sf_dir), other))


def sol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = solidity.locate(inputs.document_spans(spark, sf_dir), inputs.text_sources(spark, sf_dir))
    return found.select("source_seq", "path", "span_offset", "line_number", "code_snippet")


def sol_spans_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for every line of every document, found by blocks of the texts."""
    found = solidity.locate_many(inputs.line_spans(spark, sf_dir), inputs.text_sources(spark, sf_dir))
    return found.select("source_seq", "path", "span_offset", "line_number", "code_snippet")


# Model requests and answers.


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.text_sources(spark, sf_dir)
    chat = responses.chat_requests(sources, catalogue.RUST_CONTEXT).withColumn("style", F.lit("chat"))
    message = responses.message_requests(sources, catalogue.SOLIDITY_CONTEXT).withColumn("style", F.lit("message"))
    return chat.unionByName(message)


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers find their sources by key, as if they came from another run."""
    sources = inputs.text_sources(spark, sf_dir)
    asked = responses.keyed(sources).select("source_seq", "source_key")
    answers = inputs.answers(spark, sf_dir).join(asked, "source_seq").drop("source_seq")
    return _shown(responses.answer_findings(responses.parse_answers(answers), sources))


def response_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share texts are asked about once, and each has the findings of the one answer."""
    sources = inputs.shared_sources(spark, sf_dir)
    answers = inputs.shared_answers(responses.distinct_sources(sources))
    return _shown(responses.answer_findings(responses.parse_answers(answers), sources))


def response_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.answer_rejects(responses.parse_answers(inputs.answers(spark, sf_dir)))


# Streams.


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(spark, name)
    run_to_end(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = inputs.arriving_documents(spark, sf_dir)
    return _shown(_drained(
        spark, scan.scan_strict(stream, rules_from_rows(spark, catalogue.TEXT_RULES)), "stream_scan"
    ))


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in two deliveries, each taken up by a run of its own with one checkpoint.

    A file that comes again counts once: what was seen is state that the runs hand on.
    """
    folder = shared_folder(spark, "stream_files")
    for delivery in (0, 1):
        inputs.deliver_files(spark, sf_dir, f"{folder}/in", delivery)
        arrived = arriving_files(spark, f"{folder}/in")
        place = F.regexp_extract("path", "block=[0-9]+", 0)
        first = drop_redelivered(arrived.withColumn("path", place), "arrived_at", "1 day")
        found = scan.scan_strict(first, rules_from_rows(spark, catalogue.TEXT_RULES))
        run_to_end(found, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("file_path", "rule_id", "line_number", "code_snippet")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = drop_redelivered(inputs.deliveries(spark, sf_dir), "arrived_at", "1 hour")
    return _drained(spark, first, "stream_dedup").select("path", "code")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in [
        src_files, src_project, src_inline, src_ext_filter, src_dedup, out_json, out_ordered,
        rules_load, rules_toml, rules_patterns, rules_active, rules_rejected, rules_lint, rules_last,
        lines, route_kind, scan_text, scan_odd_rules, scan_many, scan_pages, scan_strict, scan_all_patterns, scan_guarded,
        scan_guarded_code, scan_context, scan_all, audit_contracts, rejects,
        count_total, count_by_analyzer, count_by_severity, count_by_source, report_matrix, report_rollup,
        program_report, program_totals, program_rejects,
        nodes_scan, nodes_dedup, nodes_collapse, nodes_lexical,
        sol_functions, sol_setters, sol_setters_default, sol_spans, sol_spans_many,
        prompt_build, response_parse, response_shared, response_rejects,
        stream_scan, stream_files, stream_dedup,
    ]
}
