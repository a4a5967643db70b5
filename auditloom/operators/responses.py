"""Model requests and answers as tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import catalogue, schemas


def prompt(code: Column, context: str) -> Column:
    return F.concat(
        F.lit(catalogue.PROMPT_HEAD), code, F.lit(catalogue.PROMPT_MIDDLE), F.lit(context),
        F.lit(catalogue.PROMPT_TAIL),
    )


def source_key(path: Column, code: Column) -> Column:
    """A name of a source that is the same in every run, unlike its number: a hash of path and text."""
    return F.sha2(F.concat_ws("\n", F.coalesce(path, F.lit("")), code), 256)


def keyed(sources: DataFrame) -> DataFrame:
    """Sources with ``source_key``, to be asked about, and to be joined with the answers of a later job."""
    return sources.withColumn("source_key", source_key(F.col("path"), F.col("code")))


def distinct_sources(sources: DataFrame) -> DataFrame:
    """One source for each ``source_key``, to be asked about once: equal texts share their answer.

    Equal rows are reduced in their tasks before they move; ``source_seq`` is left out, as
    the answer belongs to all of them.
    """
    named = keyed(sources)
    return named.select("source_key", "path", "code").dropDuplicates(["source_key"])


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_requests(sources: DataFrame, context: str, model: str = catalogue.CHAT_MODEL) -> DataFrame:
    """Request bodies with a system and a user message."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(
            _message("system", F.lit(catalogue.CHAT_SYSTEM_TEXT)),
            _message("user", prompt(F.col("code"), context)),
        ).alias("messages"),
        F.lit(catalogue.TEMPERATURE).alias("temperature"),
        F.lit(catalogue.MAX_ANSWER_TOKENS).alias("max_tokens"),
    )
    return sources.select(*_request_keys(sources), F.to_json(body).alias("body"))


def _request_keys(sources: DataFrame) -> list[str]:
    return [c for c in ("source_key", "source_seq", "path") if c in sources.columns]


def message_requests(sources: DataFrame, context: str, model: str = catalogue.MESSAGES_MODEL) -> DataFrame:
    """Request bodies with one user message."""
    text = F.concat(F.lit(catalogue.MESSAGES_PREAMBLE), F.lit("\n\n"), prompt(F.col("code"), context))
    body = F.struct(
        F.lit(model).alias("model"),
        F.lit(catalogue.MAX_ANSWER_TOKENS).alias("max_tokens"),
        F.array(_message("user", text)).alias("messages"),
    )
    return sources.select(*_request_keys(sources), F.to_json(body).alias("body"))


# Fixed values. Members of an answer item, in both spellings, with the JSON type they need.
_MEMBERS = [
    ("rule_id", "ruleId", "STRING", True),
    ("vuln_type", "vulnType", "STRING", True),
    ("severity", "severity", "STRING", True),
    ("message", "message", "STRING", True),
    ("mitigation", "mitigation", "STRING", False),
    ("line_number", "lineNumber", "BIGINT", True),
    ("code_snippet", "codeSnippet", "STRING", True),
    ("file_path", "filePath", "STRING", False),
]


def parse_answers(responses: DataFrame) -> DataFrame:
    """Responses with their ``items``, and a ``problem`` for which the whole answer is void.

    An answer without any choice or content has no items and no problem. Otherwise its
    text holds a JSON list from the first ``[`` to the last ``]``, and every item needs
    all required members with the right JSON types.
    """
    body = responses.withColumn("parsed", F.from_json("body", schemas.ANSWER_BODY))
    first_choice = F.try_element_at("parsed.choices", F.lit(1))
    first_content = F.try_element_at("parsed.content", F.lit(1))
    is_answer = F.col("parsed.choices").isNotNull() | F.col("parsed.content").isNotNull()
    is_empty = F.coalesce(F.size("parsed.choices"), F.size("parsed.content")) == 0
    text = F.when(F.col("parsed.choices").isNotNull(), first_choice["message"]["content"]).otherwise(
        first_content["text"]
    )
    staged = (
        body.withColumn("is_answer", is_answer)
        .withColumn("is_empty", is_answer & is_empty)
        .withColumn("text", text)
        .withColumn("list", F.regexp_extract("text", r"(?s)\[.*\]", 0))
        .withColumn("seal", F.sha2("list", 256))
        # The parser stops after the first value. A seal behind the list shows that all of
        # it was read.
        .withColumn("sealed", F.try_parse_json(F.concat(F.lit("["), "list", F.lit(',"'), "seal", F.lit('"]'))))
        .withColumn("raw_items", F.when(
            F.try_variant_get("sealed", "$[1]", "string") == F.col("seal"),
            F.try_variant_get("sealed", "$[0]", "array<variant>"),
        ))
    )
    checked = F.transform(
        "raw_items",
        lambda item: F.struct(*[_member(item, *m[:3]).alias(m[0]) for m in _MEMBERS], _is_valid_item(item).alias("ok")),
    )
    problem = (
        F.when(~F.col("is_answer"), "not a response")
        .when(F.col("is_empty"), F.lit(None).cast("string"))
        .when(F.col("text").isNull(), "not a response")
        .when(F.col("items").isNull(), "no JSON list")
        .when(~F.forall("items", lambda item: item["ok"]), "malformed item")
    )
    return staged.withColumn("items", checked).select(*responses.columns, problem.alias("problem"), "items")


def _member(item: Column, snake: str, camel: str, json_type: str) -> Column:
    kind = json_type.lower()
    return F.coalesce(
        F.try_variant_get(item, f"$.{snake}", kind), F.try_variant_get(item, f"$.{camel}", kind)
    )


def _is_valid_item(item: Column) -> Column:
    ok = F.startswith(F.schema_of_variant(item), F.lit("OBJECT<"))
    for snake, camel, json_type, required in _MEMBERS:
        for name in {snake, camel}:
            kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
            # Absent and JSON null are the same for a member that may be left out.
            ok = ok & F.coalesce(kind.isin(json_type, "VOID"), F.lit(True))
        value = _member(item, snake, camel, json_type)
        if required:
            ok = ok & value.isNotNull()
        if json_type == "BIGINT":
            ok = ok & (value >= 0)
    return F.coalesce(ok, F.lit(False))


def answer_findings(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings of the valid answers, under the source they were asked for.

    ``parsed`` comes from ``parse_answers`` and carries the ``source_key`` of the request,
    or its ``source_seq`` if request and answer belong to one run over one table. Sources
    that are the same in path and text share their answers: asked about once, by
    ``distinct_sources``, each of them gets the findings of that one answer. Equal answers to
    one key count once.
    """
    key = "source_key" if "source_key" in parsed.columns else "source_seq"
    named = keyed(sources) if key == "source_key" else sources
    # The condition stays inside the generator: as a filter it would be pushed down to the
    # table and the answers would be parsed once for it and once for their items.
    valid = F.when(F.col("problem").isNull(), F.col("items"))
    items = parsed.select(key, F.posexplode(valid).alias("pos", "item"))
    if key == "source_key":
        items = items.distinct()
    return items.join(named.select(*{key, "program", "source_seq"}), key).select(
        "program",
        "source_seq",
        F.lit(schemas.ANALYZER_MODEL).alias("analyzer"),
        F.lit(0).alias("rule_seq"),
        F.col("pos").cast("bigint").alias("item_seq"),
        *[F.col(f"item.{m[0]}").alias(m[0]) for m in _MEMBERS],
    )


def answer_rejects(parsed: DataFrame) -> DataFrame:
    # A generator in place of a filter, for the same reason.
    problems = F.when(F.col("problem").isNotNull(), F.array("problem"))
    return parsed.select(F.lit("answer").alias("stage"), "path", F.explode(problems).alias("reason"))
