"""Whole audits: the analyzers that were asked for, as one bag of findings."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.dedup import keep_first_source
from auditloom.operators.nodes import collapse_nodes, dedup_nodes, node_findings, scan_nodes
from auditloom.operators.responses import answer_findings, answer_rejects, parse_answers
from auditloom.operators.routing import skipped_sources
from auditloom.operators.scan import scan_strict
from auditloom.operators.solidity import setter_findings, sources_without_tree, unreadable_trees
from auditloom.sources.files import drop_blank_inline
from auditloom.sources.rules import AnalysisMode


def effective_mode(in_rule_file: AnalysisMode | None, asked_for: AnalysisMode) -> AnalysisMode:
    """The mode of the rule file wins; what the call asks for counts only without one."""
    return in_rule_file or AnalysisMode(True, asked_for.ast, asked_for.llm)


def audit_rust(
    sources: DataFrame,
    rules: DataFrame,
    mode: AnalysisMode,
    nodes: DataFrame | None = None,
    responses: DataFrame | None = None,
    collapse: bool = False,
) -> DataFrame:
    """Findings in Rust sources. ``nodes`` are needed for tree checks, ``responses`` for
    model findings; ``collapse`` gives one tree finding per rule and file."""
    parts = [scan_strict(sources, rules)] if mode.regex else []
    if mode.ast:
        parts.append(_tree_part(sources, _given(nodes, "nodes"), collapse))
    if mode.llm:
        responses = _given(responses, "responses")
        parts.append(answer_findings(parse_answers(responses), sources))
    return _bag(parts)


def audit_solidity(
    sources: DataFrame,
    rules: DataFrame,
    mode: AnalysisMode,
    trees: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Findings in Solidity and JSON sources. ``trees`` are compiler syntax trees by path.

    Of several sources of one path the first one counts.
    """
    sources = keep_first_source(drop_blank_inline(sources))
    parts = [scan_strict(sources, rules)] if mode.regex else []
    if mode.ast:
        parts.append(setter_findings(_given(trees, "trees"), sources, rules))
    if mode.llm:
        responses = _given(responses, "responses")
        parts.append(answer_findings(parse_answers(responses), sources))
    return _bag(parts)


def audit_programs(
    sources: DataFrame, nodes: DataFrame, responses: DataFrame | None = None, collapse: bool = True
) -> DataFrame:
    """Findings in a collection of programs: tree checks and answers, no line rules."""
    parts = [_tree_part(sources, nodes, collapse)]
    if responses is not None:
        parts.append(answer_findings(parse_answers(responses), sources))
    return _bag(parts)


def audit_rejects(
    sources: DataFrame,
    unread: DataFrame | None = None,
    trees: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """What a Solidity audit left out: (stage, path, reason). ``unread`` comes from reading files."""
    parts = [skipped_sources(sources)]
    if unread is not None:
        parts.append(unread)
    if trees is not None:
        parts += [unreadable_trees(trees), sources_without_tree(sources, trees)]
    if responses is not None:
        parts.append(answer_rejects(parse_answers(responses)))
    return _bag(parts)


def rust_rejects(
    unread: DataFrame | None = None, unparsed: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """What a Rust audit left out; at least one table is needed.

    Rust sources need no path. ``unparsed`` (path, reason) are those that the parser of the
    node table could not read.
    """
    parts = [] if unread is None else [unread]
    if unparsed is not None:
        parts.append(unparsed.select(F.lit("nodes").alias("stage"), "path", "reason"))
    if responses is not None:
        parts.append(answer_rejects(parse_answers(responses)))
    return _bag(parts)


def _tree_part(sources: DataFrame, nodes: DataFrame, collapse: bool) -> DataFrame:
    found = scan_nodes(nodes)
    return node_findings(collapse_nodes(found) if collapse else dedup_nodes(found), sources)


def _given(table: DataFrame | None, name: str) -> DataFrame:
    """An analyzer that was asked for must have its input; it is never skipped in silence."""
    if table is None:
        raise ValueError(f"the mode asks for an analyzer whose input table is missing: {name}")
    return table


def _bag(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no analyzer to run: none is switched on")
    return reduce(DataFrame.unionByName, parts)
