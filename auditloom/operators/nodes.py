"""Checks on syntax-node tables."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom import catalogue, schemas
from auditloom.functions.text import split_lines, trim_unicode
from auditloom.operators.dedup import first_per
from auditloom.operators.lines import line_array

# Columns by which a node names its source; tables of a parser may know the path only.
_SOURCE_KEYS = ["source_seq", "program", "path"]


def node_checks(spark: SparkSession) -> DataFrame:
    """The check table: a fixed handful of rows, small enough to broadcast."""
    names = ["kind", "key", "rule_id", "severity", "message", "mitigation"]
    rows = [{"check_seq": seq, **dict(zip(names, row))} for seq, row in enumerate(catalogue.NODE_CHECKS)]
    table = pa.Table.from_pylist(
        rows, schema=pa.schema([("check_seq", pa.int32())] + [(n, pa.string()) for n in names])
    )
    return spark.createDataFrame(table, schemas.NODE_CHECKS)


def scan_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node that a check names, with the span of the node.

    A call with a qualified name (``path_len`` over 1) is not the called function itself
    and is left alone. Nodes with ``source_seq`` and ``program`` keep them.
    """
    kind = F.col("kind")
    key = (
        F.when((kind == "call") & (F.col("path_len") == 1), F.col("name"))
        .when(kind == "method_call", F.col("name"))
        .when(kind == "binary", F.col("op"))
        .when(kind.isin("loop", "while", "for", "fn", "struct"), "")
    )
    checks = node_checks(nodes.sparkSession)
    keyed = nodes.withColumn("key", key)
    return keyed.join(F.broadcast(checks), ["kind", "key"]).select(
        *_source_keys(nodes), "check_seq", F.col("node_seq").alias("item_seq"), "rule_id", "severity", "message",
        "mitigation", "line_number", F.col("snippet").alias("code_snippet"),
    )


def _is_valid(line_number: Column, snippet: Column) -> Column:
    return (line_number > 0) & (snippet != "") & (snippet != catalogue.UNKNOWN_SNIPPET)


def _source_keys(nodes: DataFrame) -> list[str]:
    return [c for c in _SOURCE_KEYS if c in nodes.columns]


def dedup_nodes(found: DataFrame) -> DataFrame:
    """First finding of each rule, line and snippet of a source; without a line or a snippet, none."""
    valid = found.where(_is_valid(F.col("line_number"), F.col("code_snippet")))
    return _with_check_texts(first_per(valid, [*_source_keys(found), "rule_id", "line_number", "code_snippet"]))


def collapse_nodes(found: DataFrame) -> DataFrame:
    """First finding of each rule of a source, with the placeholder line and snippet.

    This is what a report without node positions comes to, so that nodes without a line or
    a snippet count, too.
    """
    first = first_per(found, [*_source_keys(found), "rule_id"])
    return _with_check_texts(
        first.withColumn("line_number", F.lit(catalogue.PLACEHOLDER_LINE).cast("bigint"))
        .withColumn("code_snippet", F.lit(catalogue.PLACEHOLDER_SNIPPET))
    )


def _with_check_texts(first: DataFrame) -> DataFrame:
    texts = node_checks(first.sparkSession).select("check_seq", "severity", "message", "mitigation")
    return first.join(F.broadcast(texts), "check_seq").select(
        *_source_keys(first), "check_seq", "item_seq", "rule_id", "severity", "message", "mitigation",
        "line_number", "code_snippet",
    )


def node_findings(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Node rows as findings of their sources.

    Nodes that know their source need no join. Others are matched by path with the first
    source of the path, after they have been reduced to the first ones.
    """
    if "source_seq" not in found.columns:
        named = sources.where(F.col("path").isNotNull()).groupBy("path").agg(
            F.min(F.struct("source_seq", "program")).alias("first")
        )
        found = found.join(named.select("path", "first.source_seq", "first.program"), "path")
    return found.select(
        "program",
        "source_seq",
        F.lit(schemas.ANALYZER_TREE).alias("analyzer"),
        F.lit(0).alias("rule_seq"),
        "item_seq",
        "rule_id",
        F.col("rule_id").alias("vuln_type"),
        "severity",
        "message",
        "mitigation",
        "line_number",
        "code_snippet",
        F.col("path").alias("file_path"),
    )


_LETTER = r"\p{L}\p{M}\p{N}_"
# Block comments may hold others, up to so many deep; deeper ones run to the end of the text.
COMMENT_DEPTH = 8


def _block_comment(depth: int) -> str:
    inner = f"|{_block_comment(depth - 1)}" if depth else ""
    return rf"/\*(?:[^*/]++|\*++(?!/)|/(?!\*){inner})*+\*/"


# A text as comments, strings, signs in quotes, words, and what is between. Possessive
# repeats keep it linear and off the stack.
_PARTS = (
    rf"(?s)//[^\n]*+|{_block_comment(COMMENT_DEPTH)}|/\*.*+"
    rf"|(?:br|cr|r)(#*+)\"(?:.*?\"\1|.*+)|(?:b|c)?\"(?:[^\"\\]++|\\.)*+\"?"
    r"|'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|.)|[^\\'\n])'"
    rf"|[{_LETTER}]++|[^/\"'{_LETTER}]++|."
)
# The words and signs of a line; signs of two characters that are not two signs.
_LEXEMES = rf"[{_LETTER}]+|[ \t]+|->|=>|::|\.\.+=?|[-+*/%^!=<>&|]=|[^{_LETTER} \t]"
# Lines without any of these have no node and no bracket.
_LIVELY = r"[\]\[(){};#+*/-]|fn|struct|loop|while|for|impl|trait|enum|mod|extern"
# Texts with none of these, in comments or not, have nothing that its place could leave out.
_SCOPED = r"\b(?:impl|trait|extern)\b|![ \t]*[(\[{]|#!?[ \t]*\[|#[ \t]*!|macro_rules"
# Words that an opening parenthesis does not make a call, and such that an operator may follow as a sign.
NO_CALLS = ["loop", "while", "for", "if", "match", "return", "fn", "struct", "in", "as", "impl", "mut", "move", "let", "else", "where"]
NO_OPERANDS = ["return", "in", "if", "match", "while", "as", "mut", "else", "const", "let", "ref", "move", "break", "dyn", "impl", "where"]
HEADERS = ["fn", "struct", "impl", "trait", "enum", "mod", "extern"]

_MATTERS = ["loop", "while", "for", *HEADERS, "+", "-", "*", "/", "(", "[", "{", ")", "]", "}", ";"]


def blank_comments(code: Column) -> Column:
    """The text with comments gone and strings emptied, line by line as before."""

    def blank(part: Column) -> Column:
        breaks = F.regexp_replace(part, r"[^\n]", "")
        is_comment = F.startswith(part, F.lit("//")) | F.startswith(part, F.lit("/*"))
        is_string = part.rlike("^(?:br|cr|r|b|c)?#*\"")
        return (
            F.when(is_comment, F.concat(F.lit(" "), breaks))
            .when(is_string, F.concat(F.lit('""'), breaks))
            .when(F.startswith(part, F.lit("'")) & (F.length(part) > 2), F.lit('""'))
            .otherwise(part)
        )

    parts = F.transform(F.regexp_extract_all(code, F.lit(_PARTS), F.lit(0)), blank)
    return F.when(code.rlike("[/\"']"), F.array_join(parts, "")).otherwise(code)


# Lexemes before and after a place that say what it is.
BEFORE, AFTER = 5, 2


def _around(lexemes: Column, place: Column) -> Column:
    """A place with its lexeme, ``at``, and those before and after it."""
    near = {"at": 0} | {f"before{i}": -i for i in range(1, BEFORE + 1)} | {f"after{i}": i for i in range(1, AFTER + 1)}
    return F.struct(place.alias("pos"), *[F.get(lexemes, place + step).alias(name) for name, step in near.items()])


def _beside(side: str) -> Column:
    """The next lexeme on a side but for white space."""
    near = F.col(f"x.{side}1")
    is_space = F.startswith(near, F.lit(" ")) | F.startswith(near, F.lit("\t"))
    return F.when(is_space, F.col(f"x.{side}2")).otherwise(near)


def _lexeme() -> dict[str, Column]:
    """What a lexeme is to the structure of its text: a node, a bracket, a header word, an end.

    It reads ``x``, the place with what is around it, and ``before`` and ``after``.
    """
    sign, before, after = F.col("x.at"), F.col("before"), F.col("after")
    word = sign.rlike(f"^[{_LETTER}]")
    named = F.coalesce(after.rlike(rf"^[\p{{L}}_]"), F.lit(False))
    is_definition = sign.isin("fn", "struct") & named
    bare = ~F.coalesce(before.isin(".", "::", ":", "!"), F.lit(False))
    keyword = sign.isin(NO_CALLS) & ~F.coalesce(before.isin(".", "::"), F.lit(False))
    called = F.coalesce(after == "(", F.lit(False)) & word & ~sign.rlike("^[0-9]") & ~keyword
    called = called & ~F.coalesce(before.isin("fn", "struct"), F.lit(False))
    # An operator stands behind a word, a number or a closing bracket; at the start of a line
    # only + and / are sure not to be signs. Bounds of types are no sums.
    operand = F.coalesce(before.rlike(rf"^[{_LETTER})\]?\"]") & ~before.isin(NO_OPERANDS), F.lit(False))
    exponent = F.coalesce(F.col("x.before1").rlike("^[0-9_]+[eE]$"), F.lit(False)) & sign.isin("+", "-")
    bound = (sign == "+") & F.coalesce(after.isin("'", "?") | after.rlike("^[A-Z][A-Za-z0-9_]*[a-z]"), F.lit(False))
    stands = operand | (before.isNull() & sign.isin("+", "/"))
    is_operator = sign.isin("+", "-", "*", "/") & ~exponent & ~bound & stands
    kind = (
        F.when(is_definition, sign)
        .when(sign.isin("loop", "while", "for") & bare & ~F.coalesce(after == "<", F.lit(False)), sign)
        .when(called & F.coalesce(before == ".", F.lit(False)), "method_call")
        .when(called, "call")
        .when(is_operator, "binary")
    )
    # Macros and attributes are opaque: name ! [ and # [ open them.
    far = F.col("x.before2")
    hash_before = (before == "#") | ((before == "!") & (far.isin("#") | far.rlike(f"^[{_LETTER}]")))
    spaced = F.col("x.before1").rlike(r"^[ \t]") & (before == "!") & F.col("x.before3").rlike(f"^[{_LETTER}]")
    is_rules = F.lit(False)
    for gap in (4, 5):
        is_rules = is_rules | F.coalesce(
            (F.col(f"x.before{gap}") == "macro_rules") & (F.col(f"x.before{gap - 1}") == "!"), F.lit(False)
        )
    opaque = sign.isin("(", "[", "{") & (F.coalesce(hash_before | spaced, F.lit(False)) | is_rules)
    return {
        "kind": kind,
        "named": F.when(is_definition, after).otherwise(sign),
        "path_len": F.when(F.coalesce(before == "::", F.lit(False)), 2).otherwise(1),
        "step": F.when(sign.isin("(", "[", "{"), 1).when(sign.isin(")", "]", "}"), -1).otherwise(0),
        "opaque": opaque,
        "header": F.when(sign.isin(HEADERS) & bare & (sign.isin("impl", "extern") | named), sign),
        "ends": sign.isin("{", "}", ";"),
        "block": sign == "{",
    }


def _places(lexemes: Column) -> Column:
    """Places of the lexemes that may matter: few of all, so that the rest costs next to nothing."""
    found = F.array_compact(F.transform(lexemes, lambda x, i: F.when(x.isin(_MATTERS), i)))

    def with_name(place: Column) -> Column:
        near = F.get(lexemes, place - 1)
        at = F.when(near.rlike(r"^[ \t]"), place - 2).otherwise(place - 1)
        name = F.get(lexemes, at)
        is_name = (F.get(lexemes, place) == "(") & name.rlike(rf"^[{_LETTER}]") & ~name.isin(_MATTERS)
        return F.when(F.coalesce(is_name, F.lit(False)), F.array(at, place)).otherwise(F.array(place))

    return F.flatten(F.transform(found, with_name))


def lexical_nodes(sources: DataFrame) -> DataFrame:
    """A stand-in for parser output: calls, operators, loops, functions and structs by their words.

    Comments and strings are taken out of the whole text first. The brackets of a text then
    say what stands where: running sums give each place its depth, and the last bracket that
    opened a depth is the one around it. Functions in the body of an ``impl``, a ``trait`` or
    an ``extern`` block are no free functions and are left out; bodies of macros and
    attributes are opaque. ``node_seq`` follows the text. Texts in which nothing can be left
    out, as they hold no such block, macro or attribute, stay where they are; of the others
    the nodes and brackets move once, dealt by source.
    """
    columns = [*_SOURCE_KEYS, "node_seq", "kind", "name", "path_len", "op", "line_number", "snippet"]
    plain = _lexical_rows(sources, scoped=False)
    return plain.select(columns).unionByName(_in_scope(_lexical_rows(sources, scoped=True)).select(columns))


def _lexical_rows(sources: DataFrame, scoped: bool) -> DataFrame:
    """Nodes, brackets, header words and ends of statements of the texts that need scopes, or the nodes of the others."""
    # A projection of its own, as splitting names the text several times.
    mine = (F.col("code") != "") & (F.col("code").rlike(_SCOPED) == F.lit(scoped))
    blanked = sources.select(*_SOURCE_KEYS, "code", F.when(mine, blank_comments(F.col("code"))).alias("live"))
    both = F.when(F.col("live").isNotNull(), F.arrays_zip(line_array().alias("line"), split_lines(F.col("live")).alias("live")))
    # Arrays sit in structs because a generator over a bare column would bring in a filter on
    # its size, and so work everything out twice.
    paired = blanked.select(*_SOURCE_KEYS, F.struct(both.alias("lines")).alias("cut"))
    cut = paired.select(*_SOURCE_KEYS, F.posexplode("cut.lines").alias("number", "both"))
    # Lines are chosen by what their lexemes come from, as a filter on the lexemes would cut lines twice.
    lexemes = F.regexp_extract_all("both.live", F.lit(_LEXEMES), F.lit(0))
    listed = cut.where(F.col("both.live").rlike(_LIVELY)).select(
        *_SOURCE_KEYS, "number", F.col("both.line").alias("line"), lexemes.alias("lexemes")
    )
    places = F.transform(_places(F.col("lexemes")), lambda i: _around(F.col("lexemes"), i))
    held = listed.select(*_SOURCE_KEYS, "number", "line", F.struct(places.alias("places")).alias("seen"))
    # Places become rows before they are looked into, as columns share their parts and lambdas do not.
    each = held.select(*_SOURCE_KEYS, "number", "line", F.explode("seen.places").alias("x")).select(
        "*", _beside("before").alias("before"), _beside("after").alias("after")
    )
    known = each.select(*_SOURCE_KEYS, "number", "line", "x", *[c.alias(name) for name, c in _lexeme().items()])
    kind = F.col("kind")
    about = [
        F.col("x.pos").alias("pos"), "kind", F.when(kind != "binary", F.col("named")).alias("name"),
        F.when(kind == "call", F.col("path_len")).alias("path_len"), F.when(kind == "binary", F.col("x.at")).alias("op"),
    ]
    wanted = kind.isNotNull()
    if scoped:
        about += ["step", "opaque", "header", "ends", "block"]
        wanted = wanted | (F.col("step") != 0) | F.col("header").isNotNull() | F.col("ends")
    # A generator, as filters on its columns stay behind it and do not work out the kinds anew.
    rows = known.select(*_SOURCE_KEYS, "number", "line", F.explode(F.when(wanted, F.array(F.struct(*about)))).alias("y")).select(
        *_SOURCE_KEYS, (F.col("number") + 1).cast("bigint").alias("line_number"), "y.*",
        F.when(F.col("y.kind").isNotNull(), trim_unicode(F.col("line"))).alias("snippet"),
    )
    return rows.withColumn("node_seq", F.shiftleft("line_number", 32) + F.col("pos"))


def _in_scope(rows: DataFrame) -> DataFrame:
    """The nodes that count, by the brackets around them."""
    by_source = Window.partitionBy("source_seq").orderBy("node_seq")
    so_far = by_source.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_source.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "depth": F.sum("step").over(so_far),
        "part": F.coalesce(F.sum(F.col("ends").cast("int")).over(earlier), F.lit(0)),
    })
    # The first header word since the last block or statement says what a block is.
    in_part = Window.partitionBy("source_seq", "part").orderBy("node_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heads", F.first("header", ignorenulls=True).over(in_part))
    members = F.col("block") & F.col("heads").isin("impl", "trait", "extern")
    rows = rows.withColumns({
        "opens": F.when(F.col("opaque"), "opaque").when(members, "members").when(F.col("step") > 0, "plain"),
        "level": F.when(F.col("step") > 0, F.col("depth")).otherwise(F.col("depth") - F.col("step")),
    })
    at_level = Window.partitionBy("source_seq", "level").orderBy("node_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.last("opens", ignorenulls=True).over(at_level))
    closes = (F.col("step") < 0) & (F.col("inside") == "opaque")
    hidden = F.when(F.col("opaque"), 1).when(closes, -1).otherwise(0)
    rows = rows.withColumn("hidden", F.coalesce(F.sum(hidden).over(earlier), F.lit(0)))
    in_impl = (F.col("kind") == "for") & F.coalesce(F.col("heads") == "impl", F.lit(False))
    method = (F.col("kind") == "fn") & F.coalesce(F.col("inside") == "members", F.lit(False))
    return rows.where(F.col("kind").isNotNull() & (F.col("hidden") <= 0) & ~in_impl & ~method)
