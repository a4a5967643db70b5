"""Rule tables: from JSON, Parquet, rule files in TOML, and rows in code."""

import json
import tomllib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import catalogue, schemas
from auditloom.sources.workspace import shared_folder, ship

_REQUIRED = ["id", "description", "severity", "patterns", "enabled"]


class AnalysisMode(NamedTuple):
    """Which analyzers run. A mode in a rule file wins over the one asked for in a call."""

    regex: bool = True
    ast: bool = False
    llm: bool = False


_ARROW_RULES = pa.schema([
    ("rule_seq", pa.int32()), ("id", pa.string()), ("description", pa.string()), ("severity", pa.string()),
    ("patterns", pa.list_(pa.string())), ("enabled", pa.bool_()), ("mitigation", pa.string()),
])


def _local_rules(spark: SparkSession, rows: list[dict]) -> DataFrame:
    # An Arrow table becomes a local relation, whose size the planner knows.
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ARROW_RULES), schemas.RULES)


def rules_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rules from catalogue rows (id, severity, enabled, patterns, description, mitigation)."""
    names = ["id", "severity", "enabled", "patterns", "description", "mitigation"]
    return _local_rules(spark, [{"rule_seq": seq, **dict(zip(names, row))} for seq, row in enumerate(rows)])


def stock_rust_rules(spark: SparkSession) -> DataFrame:
    return rules_from_rows(spark, catalogue.RUST_RULES)


def stock_solidity_rules(spark: SparkSession) -> DataFrame:
    return rules_from_rows(spark, catalogue.SOLIDITY_RULES)


def read_rules(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """A rule table from JSON or Parquet files. A malformed or incomplete rule is an error."""
    reader = spark.read.schema(schemas.RULES)
    if file_format == "json":
        reader = reader.option("mode", "FAILFAST")
    return require_complete(reader.format(file_format).load(path))


def require_complete(rules: DataFrame) -> DataFrame:
    """The rules, failing the job on one that lacks a required field."""

    def required(name: str) -> Column:
        lack = F.raise_error(F.concat(F.lit(f"rule without {name}: "), F.coalesce("id", F.lit("?"))))
        return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(lack)

    return rules.withColumns({name: required(name) for name in _REQUIRED})


# What rule files are cut at, where a rule's table begins.
_CUT, _HEADER = "\n[[rules]]", "[[rules]]"
_PIECES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("rule", pa.struct(list(_ARROW_RULES)[1:])),
    ("lacks", pa.string()), ("rest", pa.string()), ("cut", pa.bool_()),
])
_PIECE_ROWS = (
    "file STRING, block BIGINT, pos BIGINT, rule STRUCT<id: STRING, description: STRING, severity: STRING, "
    "patterns: ARRAY<STRING>, enabled: BOOLEAN, mitigation: STRING>, lacks STRING, rest STRING, cut BOOLEAN"
)


def read_rule_file(spark: SparkSession, path: str, in_parts: bool = False) -> tuple[DataFrame, AnalysisMode | None]:
    """Rules and analysis mode of one TOML rule file; the mode is None if the file has none.

    A folder is taken if it holds exactly one file; more or none are an error. With
    ``in_parts`` its files are the parts of one rule file, in the order of their names.

    Files are cut at the headers of rules, and each task of Spark reads some rules by
    themselves. A cut inside a string or list leaves a piece that cannot be read, and
    texts that cannot be cut are read whole.
    """
    # Of a folder, the files that Spark's readers take; their number, not their texts, comes to the driver.
    given = spark.read.format("binaryFile").load(path)
    files = [r["path"] for r in given.select("path").orderBy("path").collect()]
    if not files or (len(files) > 1 and not in_parts):
        raise ValueError(f"{path} is not one rule file")
    texts = spark.read.option("lineSep", _CUT).text(path)
    folder = shared_folder(spark, "rule_file")
    ship(spark)
    numbered = texts.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbered.mapInArrow(_read_pieces, _PIECE_ROWS).write.parquet(folder)
    pieces = spark.read.schema(_PIECE_ROWS).parquet(folder)

    # A row for each block of a file, of some megabytes.
    blocks = pieces.groupBy("file", "block").agg(
        F.count("rule").alias("rules"), F.bool_and("cut").alias("cut"), F.max("rest").alias("rest"), F.count("rest").alias("rests"),
    ).orderBy("file", "block").collect()
    before = np.cumsum([0] + [b["rules"] for b in blocks]).tolist()
    # A later file may begin with keys of the last table before it.
    carried = any(b["rests"] and b["block"] == 0 and b["file"] != blocks[0]["file"] for b in blocks)
    if not before[-1] or carried or not all(b["cut"] for b in blocks) or sum(b["rests"] for b in blocks) > 1:
        return parse_rule_file(spark, _whole(given))
    places = pa.table({
        "file": pa.array([b["file"] for b in blocks], pa.string()), "block": pa.array([b["block"] for b in blocks], pa.int64()),
        "before": pa.array(before[:-1], pa.int64()),
    })
    starts = spark.createDataFrame(places, "file string, block bigint, before bigint")
    seq = (F.col("before") + F.col("pos")).cast("int").alias("rule_seq")
    found = pieces.where("rule IS NOT NULL").join(F.broadcast(starts), ["file", "block"])
    lacking = found.where("lacks IS NOT NULL").select(seq, "lacks", "rule.id").orderBy("rule_seq").first()
    if lacking:
        raise ValueError(f"rule without {lacking['lacks']}: {lacking['rule_seq'] if lacking['id'] is None else lacking['id']}")
    rest = next((b["rest"] for b in blocks if b["rest"]), "{}")
    return found.select(seq, "rule.*"), _mode(json.loads(rest))


def _whole(files: DataFrame) -> str:
    return b"".join(bytes(f["content"]) for f in files.select("path", "content").orderBy("path").collect()).decode("utf-8")


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules of the pieces of rule files, numbered in each block; pieces of a block follow each other.

    ``rest`` is what a piece holds beside rules, as JSON. ``cut`` is false for a piece that
    does not stand by itself.
    """
    here, pos = None, 0
    for batch in batches:
        rows = []
        for text, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            # A block's first piece has no header before it only if it is the first one of its file.
            first = here != (file, block) and block == 0
            if here != (file, block):
                here, pos = (file, block), 0
            try:
                rules, rest = _read_piece(text, first)
                part = [{"rule": rule, "lacks": next((n for n in _REQUIRED if n not in rule), None)} for rule in rules]
                pa.array([r["rule"] for r in part], _PIECES.field("rule").type)
                part[:0] = [{"rest": json.dumps(rest, sort_keys=True, default=str)}] if rest else []
            except (ValueError, TypeError, AttributeError, pa.ArrowException):
                part = [{"cut": False}]
            for row in part:
                rows.append({"file": file, "block": block, "cut": True} | ({"pos": pos} if "rule" in row else {}) | row)
                pos += "rule" in row
        yield from pa.Table.from_pylist(rows, schema=_PIECES).to_batches()


def _read_piece(text: str, first: bool) -> tuple[list[dict], dict]:
    """(rules, what else is there) of one piece; an error if it does not stand by itself."""
    config = tomllib.loads((text if first else _HEADER + text) + "\n")
    if first:
        # More rules may follow only where the list of rules is still open.
        tomllib.loads(f"{text}{_CUT}\n")
    rules = config.pop("rules", [])
    if any("rule_seq" in rule for rule in rules):
        raise ValueError("a rule with a number of its own")
    return rules, config


def parse_rule_file(spark: SparkSession, text: str) -> tuple[DataFrame, AnalysisMode | None]:
    config = tomllib.loads(text)
    for seq, rule in enumerate(config["rules"]):
        for name in _REQUIRED:
            if name not in rule:
                raise ValueError(f"rule without {name}: {rule.get('id', seq)}")
    rules = _local_rules(spark, [{"rule_seq": seq, **rule} for seq, rule in enumerate(config["rules"])])
    return rules, _mode(config)


def _mode(config: dict) -> AnalysisMode | None:
    mode = config.get("analysis_mode")
    return AnalysisMode(mode["regex"], mode["ast"], mode["llm"]) if mode else None
