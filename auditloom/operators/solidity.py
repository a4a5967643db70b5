"""Checks on compiler syntax trees of Solidity sources."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom import catalogue, schemas
from auditloom.functions.text import line_of_offset, snippet_of_span, span_length, span_start, trim_unicode
from auditloom.operators.routing import tree_sources


def functions(trees: DataFrame) -> DataFrame:
    """Function definitions of the contracts at the top of each tree, one row each.

    Only these two levels are looked at. Missing names and attributes are ''.
    """
    parsed = trees.select("path", F.from_json("tree", schemas.TREE).alias("tree"))
    contracts = parsed.select("path", F.posexplode("tree.nodes").alias("contract_pos", "contract")).where(
        F.col("contract.nodeType") == "ContractDefinition"
    )
    members = contracts.select(
        "path", "contract_pos", F.col("contract.name").alias("contract_name"),
        F.posexplode("contract.nodes").alias("function_pos", "f"),
    ).where(F.col("f.nodeType") == "FunctionDefinition")

    def attribute(name: str) -> Column:
        return F.coalesce(F.col(f"f.{name}"), F.lit(""))

    return members.select(
        "path", "contract_pos", "contract_name", "function_pos",
        attribute("name").alias("name"),
        attribute("visibility").alias("visibility"),
        attribute("stateMutability").alias("state_mutability"),
        F.col("f.src").alias("src"),
        F.transform(
            F.coalesce(F.col("f.modifiers"), F.array().cast("array<struct<modifierName: struct<name: string>>>")),
            lambda m: m["modifierName"]["name"],
        ).alias("modifiers"),
    )


def is_sensitive(name: Column) -> Column:
    """The function name starts like a setter, in any letter case."""
    return name.rlike(f"(?i)^({'|'.join(catalogue.SETTER_PREFIXES)})")


def is_protected(modifiers: Column) -> Column:
    """One of the modifiers is known to guard a function, in any letter case."""
    known = rf"(?i)^({'|'.join(catalogue.PROTECTIVE_MODIFIERS)})\z"
    return F.exists(modifiers, lambda m: F.coalesce(m.rlike(known), F.lit(False)))


def open_setters(found: DataFrame) -> DataFrame:
    """Functions that anyone may call to change state, and that nothing protects."""
    return found.where(
        (F.col("name") != "")
        & F.col("visibility").isin("public", "external")
        & ~F.col("state_mutability").isin("view", "pure")
        & is_sensitive(F.col("name"))
        & ~is_protected(F.col("modifiers"))
    )


def locate(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Line and snippet of spans, from the source of the same path.

    Rows with a malformed span, and paths that are no source, are left out.
    """
    spans = (
        found.withColumn("span_offset", span_start(F.col("src")))
        .withColumn("span_length", span_length(F.col("src")))
        .where("span_offset IS NOT NULL AND span_length IS NOT NULL")
    )
    return (
        spans.join(sources, "path")
        .withColumn("line_number", line_of_offset(F.col("code"), F.col("span_offset")))
        .withColumn("code_snippet", snippet_of_span(F.col("code"), F.col("span_offset"), F.col("span_length")))
        .drop("code")
    )


# Bytes of a block of a text, and the shares into which the spans of one block are dealt.
BLOCK_BYTES = 4096


def locate_many(found: DataFrame, sources: DataFrame) -> DataFrame:
    """``locate`` for sources with very many spans: no text travels with a span.

    Texts are cut into blocks of bytes, and each block is numbered with the line ends before
    it; spans meet the one block that they start in, and further ones only if they reach
    into them. A span's line is that of its block and the line ends before it inside; its
    snippet is put together from what each block holds of it. A source with a third of all
    spans is many blocks, which are joined apart.
    """
    spans = (
        found.withColumn("span_offset", span_start(F.col("src")))
        .withColumn("span_length", span_length(F.col("src")))
        .where("span_offset IS NOT NULL AND span_length IS NOT NULL")
    )
    named = spans.select("path", F.struct("*").alias("span"), "span_offset", "span_length").withColumn(
        "number", F.monotonically_increasing_id()
    )
    blocks = _blocks(sources)
    sizes = sources.select("path", "source_seq", "program", F.octet_length("code").cast("bigint").alias("size"))
    # A span past the end of its text belongs to the last block, with nothing of it inside.
    placed = named.join(sizes, "path").withColumns({
        "first": F.least("span_offset", "size"), "end": F.least(F.expr("span_offset + least(span_length, size)"), F.col("size")),
    })
    last_block = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / BLOCK_BYTES)
    first_block = F.least(F.floor(F.col("first") / BLOCK_BYTES), last_block)
    end_block = F.greatest(first_block, F.floor(F.greatest(F.col("end") - 1, F.col("first")) / BLOCK_BYTES))
    reached = placed.withColumn("block", F.explode(F.sequence(first_block, F.least(end_block, last_block))))
    met = reached.join(blocks.drop("program", "size"), ["path", "source_seq", "block"])
    start, stop = F.greatest(F.col("first") - F.col("begins"), F.lit(0)), F.least(F.col("end"), F.col("ends")) - F.col("begins")

    def piece(begin: Column, end: Column) -> Column:
        return F.substring("content", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    before = piece(F.lit(0), F.col("first") - F.col("begins")).cast("string")
    breaks = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n")))
    parts = met.select(
        "number", "span", "source_seq", "program", F.col("block"), piece(start, stop).alias("piece"), "first", "end",
        F.when(F.col("first") >= F.col("begins"), F.col("lines_before") + breaks + 1).alias("line_number"),
    )
    # Most spans lie in one block; those of more are put together by their number.
    whole = parts.groupBy("number").agg(
        F.first("span").alias("span"), F.first("source_seq").alias("source_seq"), F.first("program").alias("program"),
        F.max("line_number").alias("line_number"),
        F.array_sort(F.collect_list(F.struct("block", F.hex("piece").alias("piece")))).alias("pieces"),
    )
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).cast("string"))
    return whole.select(
        "span.*", "source_seq", "program", F.col("line_number").cast("bigint").alias("line_number"),
        trim_unicode(text).alias("code_snippet"),
    )


def _blocks(sources: DataFrame) -> DataFrame:
    """(path, source_seq, block, begins, ends, content, lines_before) of every text."""
    size = F.octet_length("code").cast("bigint")
    count = F.greatest(F.ceil(size / BLOCK_BYTES), F.lit(1))
    cut = sources.select(
        "path", "source_seq", "program", F.col("code").cast("binary").alias("bytes"), size.alias("size"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block"),
    )
    content = F.substring("bytes", (F.col("block") * BLOCK_BYTES + 1).cast("int"), F.lit(BLOCK_BYTES))
    begins = F.col("block") * BLOCK_BYTES
    rows = cut.select(
        "path", "source_seq", "program", "size", "block", begins.alias("begins"),
        F.least(begins + BLOCK_BYTES, F.col("size")).alias("ends"), content.alias("content"),
    )
    text = F.col("content").cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    earlier = Window.partitionBy("path", "source_seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("lines_before", F.coalesce(F.sum(breaks).over(earlier), F.lit(0)))


def setter_findings(trees: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings on open setters, with the text of their rule, or the default text."""
    found = locate(open_setters(functions(trees)), tree_sources(sources))
    # All rules of this one id come down to one row: a proven bound for the broadcast.
    text = (
        rules.where(F.col("id") == catalogue.SETTER_RULE_ID)
        .groupBy("id")
        .agg(F.max_by(F.struct("description", "severity", "mitigation"), "rule_seq").alias("text"))
    )
    known = F.col("text").isNotNull()
    return (
        found.withColumn("rule_id", F.lit(catalogue.SETTER_RULE_ID))
        .join(F.broadcast(text), F.col("rule_id") == F.col("id"), "left")
        .select(
            "program",
            "source_seq",
            F.lit(schemas.ANALYZER_TREE).alias("analyzer"),
            F.lit(0).alias("rule_seq"),
            (F.shiftleft(F.col("contract_pos").cast("bigint"), 32) + F.col("function_pos")).alias("item_seq"),
            "rule_id",
            F.col("rule_id").alias("vuln_type"),
            F.when(known, F.col("text.severity")).otherwise(catalogue.MISSING_RULE_SEVERITY).alias("severity"),
            F.when(known, F.col("text.description")).otherwise(catalogue.MISSING_RULE_MESSAGE).alias("message"),
            F.col("text.mitigation").alias("mitigation"),
            "line_number",
            "code_snippet",
            F.col("path").alias("file_path"),
        )
    )


def unreadable_trees(trees: DataFrame) -> DataFrame:
    """Trees that are absent or not JSON objects."""
    is_object = F.startswith(F.ltrim(F.get_json_object("tree", "$")), F.lit("{"))
    reason = F.when(F.col("tree").isNull(), "no tree").when(~F.coalesce(is_object, F.lit(False)), "not a JSON object")
    return trees.select(F.lit("tree").alias("stage"), "path", reason.alias("reason")).where("reason IS NOT NULL")


def sources_without_tree(sources: DataFrame, trees: DataFrame) -> DataFrame:
    """Sources that the tree analyzer should take and the compiler said nothing about."""
    missing = tree_sources(sources).select("path").distinct().join(trees.select("path"), "path", "left_anti")
    return missing.select(F.lit("tree").alias("stage"), "path", F.lit("no tree").alias("reason"))
