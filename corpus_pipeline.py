"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes the rows that its predecessor kept and returns rows with the columns of
``documents``; the last one adds token ids. Stages are written as Parquet and read again,
so that a lost executor never reaches back beyond its own stage.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import decontaminate, language_id, ngram_join, pii_bootstrap, sentencepiece_codec
from auditloom.llm.queries import PIECES, vocabulary
from auditloom.llm.shared import held_out, shield, ship, stored, table, unshield

# A text whose language is less sure than this goes.
LEAST_CERTAINTY = 0.5
# Names that no column of the documents has.
TOLD, CERTAINTY = "__told__", "__certainty__"
# Near duplicates share so many in a hundred of their word n-grams.
NGRAM_WORDS, SIMILARITY_PERCENT = 5, 80
# A document goes whole if benchmark passages make up more than this share of its words.
MAX_BENCHMARK_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or of doubtful language, go."""
    ship(spark)
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"))), vocabulary(PIECES))
    if not model.languages:
        # Nothing says what a language is, so only texts without a letter are rejected.
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.identify(docs, model, pred=TOLD, score=CERTAINTY)
    sure = (F.col(TOLD) != language_id.UNDETERMINED) & (F.col(CERTAINTY) >= LEAST_CERTAINTY)
    return told.where(sure).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    ship(spark)
    return ngram_join.keep_one(docs, size=NGRAM_WORDS, percent=SIMILARITY_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; those that are mostly such words go."""
    items = table(spark, sf_dir, "benchmark")
    return _counted(decontaminate.remove_benchmark(docs, items, MAX_BENCHMARK_SHARE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of their kinds."""
    ship(spark)
    return _counted(pii_bootstrap.mask_pii(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and whether decoding gives their texts back.

    Columns of theirs that have the names of the new ones give way to them.
    """
    ship(spark)
    hidden, names = shield(docs)
    rows = sentencepiece_codec.encode_and_decode(hidden, vocabulary(PIECES), text=names["text"])
    counted = rows.withColumn("n_tokens", F.size("ids").cast("bigint"))
    return unshield(counted, names, ["ids", "n_tokens", "same"])


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

# Learned pieces and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
