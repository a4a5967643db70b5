"""Audit tables laid out by path."""

from pyspark.sql import DataFrame


def save_by_path(frame: DataFrame, table: str, buckets: int, location: str | None = None) -> None:
    """Save sources, trees or nodes as a table bucketed and sorted by path.

    Tables with the same number of buckets are joined by path without moving their texts.
    """
    writer = frame.write.format("parquet").bucketBy(buckets, "path").sortBy("path")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)
