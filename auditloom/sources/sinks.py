"""Findings to JSON and Parquet."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom import schemas

# Fixed values. Keys of a finding in JSON.
JSON_KEYS = [
    ("rule_id", "ruleId"),
    ("vuln_type", "vulnType"),
    ("severity", "severity"),
    ("message", "message"),
    ("mitigation", "mitigation"),
    ("line_number", "lineNumber"),
    ("code_snippet", "codeSnippet"),
    ("file_path", "filePath"),
]


def report_order() -> list[Column]:
    """Sort keys of a report: source, then analyzer, then rule, then line."""
    analyzer = F.array_position(F.array(*[F.lit(a) for a in schemas.ANALYZERS]), F.col("analyzer"))
    return [F.col("source_seq"), analyzer, F.col("rule_seq"), F.col("item_seq")]


def json_columns(findings: DataFrame) -> DataFrame:
    return findings.select(*[F.col(name).alias(key) for name, key in JSON_KEYS])


def json_texts(findings: DataFrame) -> DataFrame:
    """One JSON text per finding, with null members written out."""
    record = F.struct(*[F.col(name).alias(key) for name, key in JSON_KEYS])
    return findings.select("source_seq", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def write_json(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in report order; the sort is the only shuffle and runs in ranges."""
    ordered = findings.orderBy(*report_order())
    json_columns(ordered).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_ordered(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A findings table in report order, each row with its part and its position there.

    The sort runs in ranges and is the only shuffle; the parts follow each other.
    """
    position = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = findings.orderBy(*report_order()).withColumns({"part": F.spark_partition_id(), "position": position})
    ordered.write.mode(mode).parquet(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such a table with ``ordinal``, their place in the whole report, from 1 on.

    Only the sizes of the parts, a row for each, are added up in one place.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "part").withColumn("ordinal", F.col("before") + F.col("position") + 1).drop(
        "part", "position", "before"
    )


def write_parquet(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A findings table, split by analyzer, for reports to read instead of a new scan."""
    findings.write.mode(mode).partitionBy("analyzer").parquet(path)
