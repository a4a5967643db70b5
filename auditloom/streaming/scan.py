"""Scans of sources as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import clean_path
from auditloom.sources.files import listed_by_few


_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def arriving_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream of files, each one whole source.

    ``code`` is null for a file that is not UTF-8: scans find nothing in it, and such rows
    can be taken off as rejects. ``source_key`` names a file by its path below the folder,
    in 128 bits and the same in every run; ``source_seq`` is an order only.
    """
    reader = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.col("content").cast("string")
    path = clean_path(F.col("path"))
    root = clean_path(F.lit(folder.rstrip("/") + "/"))
    below = F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).otherwise(path)
    with listed_by_few(spark):
        files = reader.load(folder)
    return files.select(
        F.xxhash64("path").alias("source_seq"),
        F.lit(None).cast("string").alias("program"),
        path.alias("path"),
        F.when(F.is_valid_utf8(text), text).alias("code"),
        F.md5(below).alias("source_key"),
        F.col("modificationTime").alias("arrived_at"),
    )


def run_to_end(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what has arrived, append it to Parquet files, and stop.

    A later call with the same checkpoint takes up only what came since.
    """
    with listed_by_few(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        # The source of a stream lists with the settings that its session has while it runs.
        query.awaitTermination()
