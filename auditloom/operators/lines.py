"""Sources to lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import split_lines, trim_unicode


def line_array(gate: Column | None = None) -> Column:
    """The lines of ``code`` as an array; null for empty texts and those off the gate.

    The conditions stand beside the split and not in a filter: below a projection that
    makes the texts, each term of a filter would make them anew.
    """
    code = F.col("code")
    some = code != ""
    return F.when(some if gate is None else some & gate, split_lines(code))


def lines(sources: DataFrame, gate: Column | None = None) -> DataFrame:
    """One row per line, numbered from 1. The text itself goes no further than this step.

    ``gate`` is a SQL predicate on ``code``; texts for which it fails give no lines.
    """
    return sources.select("program", "source_seq", "path", F.posexplode(line_array(gate)).alias("pos", "line")).select(
        "program", "source_seq", "path", (F.col("pos") + 1).cast("bigint").alias("line_number"), "line"
    )


def snippets(sources: DataFrame) -> DataFrame:
    """Lines with the trimmed text that findings show."""
    return lines(sources).withColumn("code_snippet", trim_unicode(F.col("line")))
