"""What the operators of this package share: tables, scratch storage, held-out rows, byte-bounded batches."""

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one task works on at a time; only a single longer text exceeds it.
CHUNK_BYTES = 1 << 18

# ASCII white space, and the same as a Java class.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does, if they do not by themselves.

    It is for workers that see the driver's folders; elsewhere the package is installed or
    comes by ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share.

    It lies below ``spark.checkpoint.dir``; where that is unset, below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The rows, written once and read again, so that a lost executor costs no earlier step."""
    path = scratch_path(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# What the operator that ran last in this Python worker keeps for its later tasks.
_kept: dict = {}
# C libraries other than GNU's may have no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda spare: None)


def kept_in_worker(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the Python worker until another operator runs there."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Memory that is free in this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def let_go() -> None:
    """Workers stay for later stages; what the operator before kept there goes."""
    _kept.clear()
    give_back()


def shield(documents: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that no operator uses, and those names by the given ones.

    An operator works on shielded rows and hands back the given names at its end, so that
    no column of the input meets a name of its own on the way.
    """
    names = {c: f"__given_{i}__" for i, c in enumerate(documents.columns)}
    return documents.toDF(*names.values()), names


def unshield(rows: DataFrame, names: dict[str, str], new: list[str], gone: tuple[str, ...] = ()) -> DataFrame:
    """The given columns under their names, but for those that are gone or have the name of a new one, and the new ones."""
    kept = [F.col(f"`{hidden}`").alias(c) for c, hidden in names.items() if c not in gone and c not in new]
    return rows.select(*kept, *new)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """True for the part of the documents, a fifth by default, that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(lengths, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about ``limit`` bytes each, whatever the batch size."""
    start = size = 0
    for at, length in enumerate(lengths):
        if at > start and size + length > limit:
            yield start, at
            start, size = at, 0
        size += length
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts; null is the empty text."""
    lengths = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    for start, end in slices(lengths):
        part = batch.slice(start, end - start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
