"""Keep-first steps. All are grouped minima, so copies are reduced before they are moved."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first_source(sources: DataFrame) -> DataFrame:
    """The first source of each path, by ``source_seq``; inline texts are all kept.

    Only paths and numbers are grouped, and only those of repeated paths go on. What is
    joined to the texts are the losers, usually few: if their measured size allows it,
    they are broadcast and the texts stay where they are.
    """
    named = sources.where(F.col("path").isNotNull()).select("path", "source_seq")
    repeated = named.groupBy("path").agg(F.min("source_seq").alias("first_seq"), F.max("source_seq").alias("last_seq"))
    repeated = repeated.where("first_seq < last_seq").drop("last_seq")
    losers = named.join(repeated, "path").where("source_seq > first_seq").select("path", "source_seq")
    return sources.join(losers, ["path", "source_seq"], "left_anti").select(sources.columns)


def first_per(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Node findings reduced to the first one (lowest ``item_seq``) of each key.

    ``check_seq`` says which check the first one came from. Both are numbers, so that the
    reduction runs as a hash aggregate on the map side.
    """
    return findings.groupBy(*keys).agg(
        F.min("item_seq").alias("item_seq"), F.min_by("check_seq", "item_seq").alias("check_seq")
    )
