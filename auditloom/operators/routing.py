"""Which analyzer takes which source."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import is_json


def with_route(sources: DataFrame) -> DataFrame:
    """Add ``tree_skip``: why the tree analyzer leaves a source out, null if it takes it.

    The line scan takes every source.
    """
    return sources.withColumn(
        "tree_skip",
        F.when(F.col("path").isNull(), "no path").when(is_json(F.col("path")), "JSON artifact"),
    )


def tree_sources(sources: DataFrame) -> DataFrame:
    return with_route(sources).where(F.col("tree_skip").isNull()).drop("tree_skip")


def skipped_sources(sources: DataFrame) -> DataFrame:
    return with_route(sources).where(F.col("tree_skip").isNotNull()).select(
        F.lit("tree").alias("stage"), "path", F.col("tree_skip").alias("reason")
    )
