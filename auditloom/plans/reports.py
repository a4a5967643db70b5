"""Counts over findings. All are partial + final hash aggregates on small keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import catalogue, schemas
from auditloom.functions.text import display_name


def count_total(findings: DataFrame) -> DataFrame:
    """One row, also for no findings at all."""
    total = F.count("*")
    return findings.agg(
        total.alias("findings"),
        F.when(total == 0, "none found").otherwise("review and fix").alias("verdict"),
    )


def count_by_analyzer(findings: DataFrame) -> DataFrame:
    return findings.groupBy("analyzer").agg(F.count("*").alias("findings"))


def count_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def count_by_source(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of every source by analyzer, zeros included."""
    counts = findings.groupBy("source_seq").agg(
        *[F.count_if(F.col("analyzer") == a).alias(a) for a in schemas.ANALYZERS]
    )
    per_analyzer = F.array(*[
        F.struct(F.lit(a).alias("analyzer"), F.coalesce(F.col(a), F.lit(0)).alias("findings"))
        for a in schemas.ANALYZERS
    ])
    return sources.select("source_seq", "path").join(counts, "source_seq", "left").select(
        "source_seq", display_name(F.col("path")).alias("source"), F.inline(per_analyzer)
    )


def program_report(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Files and findings of every program, zeros included, by severity."""
    files = sources.where(F.col("program").isNotNull()).groupBy("program").agg(F.count("*").alias("files"))
    counts = findings.groupBy("program").agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in catalogue.SEVERITIES],
    )
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["findings", *catalogue.SEVERITIES]]
    return files.join(counts, "program", "left").select("program", "files", *zeros)


def collection_totals(sources: DataFrame, findings: DataFrame) -> DataFrame:
    """Programs tested and findings in all, as one row.

    The per-program report is reduced further, so that both tables are read once.
    """
    return program_report(sources, findings).agg(
        F.count("*").alias("programs"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings")
    )


def severity_matrix(findings: DataFrame) -> DataFrame:
    """Per program and source: findings by severity, and the worst severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in catalogue.SEVERITIES]), F.col("severity"))
    worst = F.min(F.when(rank > 0, rank))
    return findings.groupBy("program", "source_seq").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in catalogue.SEVERITIES],
        F.get(F.array(*[F.lit(s) for s in catalogue.SEVERITIES]), worst.cast("int") - 1).alias("worst"),
    )


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings by program and severity, with totals per program and overall (null keys)."""
    return findings.rollup("program", "severity").agg(F.count("*").alias("findings"))
