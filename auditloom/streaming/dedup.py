"""Duplicate deliveries in a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_redelivered(deliveries: DataFrame, time: str, delay: str) -> DataFrame:
    """First delivery of each (path, code) within the watermark delay.

    A row later than the watermark is dropped, and a repeat is dropped as long as the
    state of its first delivery is kept. The state is one small entry per key.
    """
    keyed = deliveries.withWatermark(time, delay).withColumn("code_hash", F.sha2("code", 256))
    return keyed.dropDuplicatesWithinWatermark(["path", "code_hash"]).drop("code_hash")
