"""Source texts from files, directories and tables."""

import os
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import catalogue
from auditloom.functions.text import clean_path, trim_unicode


def read_sources(
    spark: SparkSession,
    roots: list[str],
    extensions: list[str] | None = None,
    any_case: bool = True,
    program_root: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sources, rejects) of files and directories, read recursively, each file whole.

    ``roots`` come in the order in which findings are listed; a missing one is an error.
    A file under several roots is read once, for the first of them. Without
    ``extensions`` every file is taken. ``program`` is the path segment below
    ``program_root``. Files that are not UTF-8 go to the rejects, and so do files that
    Spark's readers pass over by name (``_x``, ``.x``, and all in such folders); one that
    is named as a root is an error. Empty files are sources with an empty text.
    """
    if not roots:
        raise ValueError("no file or directory to read")
    roots = [_absolute(r).rstrip("/") for r in roots]
    glob = extension_glob(extensions, any_case) if extensions else None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # One listing of all roots; those inside another root are part of it.
    outer = [r for r in dict.fromkeys(roots) if not any(r != o and r.startswith(o + "/") for o in roots)]
    with listed_by_few(spark):
        files = reader.load(outer)
    empty, hidden = _unread_names(spark, roots, extensions, any_case)
    named = sorted(set(hidden) & set(roots))
    if named:
        raise ValueError(f"Spark's readers pass over files with such names: {', '.join(named)}")
    texts = files.where("length > 0").select(
        clean_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("code")
    )
    blank = spark.createDataFrame([(p, "") for p in empty], "path string, code string")
    texts = texts.unionByName(blank)
    valid = F.is_valid_utf8("code")
    # Numbers follow the roots' order, and within a root the listing.
    first_root = F.coalesce(*[F.when(_is_below("path", r), F.lit(i)) for i, r in enumerate(roots)], F.lit(len(roots)))
    sources = texts.where(valid).select(
        (F.shiftleft(first_root.cast("bigint"), 52) + F.monotonically_increasing_id()).alias("source_seq"),
        _segment_below(F.col("path"), program_root).alias("program"),
        "path",
        "code",
    )
    rejects = texts.where(~valid).select(
        F.lit("read").alias("stage"), "path", F.lit("not UTF-8").alias("reason")
    )
    passed_over = spark.createDataFrame(
        [("read", p, "name that readers pass over") for p in hidden], "stage string, path string, reason string"
    )
    return sources, rejects.unionByName(passed_over)


def _is_below(path: str, root: str) -> Column:
    return (F.col(path) == root) | F.startswith(F.col(path), F.lit(root + "/"))


def _unread_names(
    spark: SparkSession, roots: list[str], extensions: list[str] | None, any_case: bool
) -> tuple[list[str], list[str]]:
    """(empty files, files with names that Spark's readers pass over), from a listing of names."""
    ends = None if extensions is None else tuple("." + e for e in extensions)
    empty: dict[str, None] = {}
    hidden: dict[str, None] = {}
    for root in roots:
        for path, length in list_files(spark, root):
            name = re.sub("^file:/+", "/", path)
            if ends and not (name.lower() if any_case else name).endswith(ends):
                continue
            below = name[len(root):].split("/") if name != root else [name.rsplit("/", 1)[-1]]
            if any(part.startswith(("_", ".")) for part in below):
                hidden[name] = None
            elif length == 0:
                empty[name] = None
    return list(empty), list(hidden)


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Readers made, and streams run, inside list their folders by two tasks for each core.

    Spark gives each folder a task of its own, up to 10,000 of them, and so each file of a
    batch of a stream. Starting such a task takes the driver longer than the listing takes,
    and no more tasks run at a time than there are cores.
    """
    given = spark.conf.get(_LISTING_TASKS, None)
    few = 2 * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING_TASKS, few if given is None else min(few, int(given)))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(_LISTING_TASKS)
        else:
            spark.conf.set(_LISTING_TASKS, given)


# Folders that are listed at a time.
LISTINGS = 8


def list_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, length) of all files below a folder, or of one file, whatever their names.

    Folders are listed one level after the other and several at a time, without places and
    owners of files, for which a local store starts a process each.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[tuple[str, int]] = []

    def below(folder) -> list:
        folders = []
        for entry in store.listStatus(folder):
            path = entry.getPath()
            if entry.isDirectory():
                folders.append(path)
            else:
                found.append((path.toString(), entry.getLen()))
        return folders

    with ThreadPoolExecutor(LISTINGS) as pool:
        level = [top]
        while level:
            level = [folder for folders in pool.map(below, level) for folder in folders]
    return found


def read_rust_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One source file of any extension, under the path as given."""
    sources, rejects = read_sources(spark, [path])
    return sources.withColumn("path", F.lit(path)), rejects


def read_solidity_project(
    spark: SparkSession, base: str, targets: Sequence[str] = (), target_dirs: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Solidity and JSON files of a project: the directories first, then the targets.

    Targets are files or directories. Relative paths are below ``base``; files of other
    kinds are passed over, and a path that does not exist is an error.
    """
    roots = [root if "://" in root else os.path.join(base, root) for root in (*target_dirs, *targets)]
    return read_sources(spark, roots, catalogue.SOLIDITY_EXTENSIONS)


def read_programs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rust files of a collection: each directory right below ``root`` is a program."""
    return read_sources(spark, [root], catalogue.RUST_EXTENSIONS, any_case=False, program_root=root)


def extension_glob(extensions: list[str], any_case: bool) -> str:
    """File-name glob; letter case is spelled out, as globs see case."""

    def letter(c: str) -> str:
        return f"[{c.lower()}{c.upper()}]" if any_case and c.isalpha() else c

    return "?*.{" + ",".join("".join(map(letter, e)) for e in extensions) + "}"


def _absolute(root: str) -> str:
    if "://" in root:
        return root
    return os.path.abspath(root.removeprefix("file:"))


def _segment_below(path: Column, root: str | None) -> Column:
    if root is None:
        return F.lit(None).cast("string")
    head = _absolute(root).rstrip("/") + "/"
    below = F.substring(path, F.lit(len(head) + 1), F.char_length(path))
    return F.when(F.startswith(path, F.lit(head)), F.split_part(below, F.lit("/"), F.lit(1)))


def table_sources(
    table: DataFrame, seq: Column, code: Column, path: Column | None = None, program: Column | None = None
) -> DataFrame:
    """Sources from any table. Without a path they count as inline texts."""
    none = F.lit(None).cast("string")
    return table.select(
        seq.cast("bigint").alias("source_seq"),
        (none if program is None else program).alias("program"),
        (none if path is None else path).alias("path"),
        code.alias("code"),
    )


def drop_blank_inline(sources: DataFrame) -> DataFrame:
    """Without inline texts of white space only (the Solidity scan skips those)."""
    return sources.where(F.col("path").isNotNull() | (trim_unicode(F.col("code")) != ""))


def spread(sources: DataFrame, partitions: int, key: str = "source_seq") -> DataFrame:
    """Repartition by a key. It is for an input of a few small files, whose texts may move
    once; a large input has splits enough and is better left as it is."""
    return sources.repartition(partitions, key)
