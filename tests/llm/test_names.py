"""Columns of the input that have the names operators use, and rows that are odd in other ways."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import (
    decontaminate,
    gnat_codes,
    language_id,
    ngram_join,
    pii_bootstrap,
    quality_knn,
    rule_ledger,
    secret_scan,
    sentencepiece_codec,
    toxic_crf,
)
from auditloom.llm.queries import PIECES, vocabulary

NAMES = [
    "_text", "_row", "_id", "_hash", "_text_hash", "text_hash_", "number_", "_more", "more", "findings", "candidates", "_repo",
    "_owner", "_words", "_where", "_windows", "_lines", "_found", "_all", "_named", "key", "label", "node", "task", "part",
    "order", "number", "_told", "_certainty", "_label", "other", "row", "total", "mentions", "summary", "decoded",
]


@pytest.fixture(scope="module")
def named(documents):
    rows = documents.select("doc_id", "text", "lang", "source")
    return rows.withColumns({name: F.concat(F.lit(f"{name} of "), F.coalesce("source", F.lit("?"))) for name in NAMES})


def given(rows, names):
    """The given columns as they stand, as a bag of rows."""
    return sorted(map(repr, rows.select("doc_id", *[f"`{n}`" for n in names]).collect()))


def operators(spark, benchmark):
    model = vocabulary(PIECES)

    def labelled(docs, name):
        return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(name))

    return {
        "quality": lambda d: quality_knn.classify(d, quality_knn.fit(d, labelled(d, "quality"))),
        "pieces": lambda d: sentencepiece_codec.encode_and_decode(d, model),
        "language": lambda d: language_id.identify(d, language_id.learn(d, model)),
        "secrets": lambda d: secret_scan.scan_secrets(d, "doc_id", "source"),
        "candidates": lambda d: secret_scan.find_candidates(d),
        "personal": lambda d: pii_bootstrap.find_pii(d),
        "masked": lambda d: pii_bootstrap.mask_pii(d),
        "cut": lambda d: decontaminate.remove_benchmark(d, benchmark, 0.9),
        "ledger": lambda d: rule_ledger.ledger(d),
        "toxic": lambda d: toxic_crf.tag(d, toxic_crf.fit(d, labelled(d, "toxic"))),
    }


# What an operator adds takes the place of given columns of that name.
NEW = {"secrets": ["findings", "candidates"], "candidates": ["candidates"], "pieces": ["decoded"]}


@pytest.mark.parametrize("name", [
    "quality", "pieces", "language", "secrets", "candidates", "personal", "masked", "cut", "ledger", "toxic",
])
def test_given_columns_stay(spark, named, benchmark, name):
    operator = operators(spark, benchmark)[name]
    kept = [n for n in NAMES if n not in NEW.get(name, [])]
    out = operator(named)
    assert len(set(out.columns)) == len(out.columns)
    assert given(out, kept) == given(named, kept)
    assert operator(named.where("false")).count() == 0


def test_kept_rows_keep_their_columns(spark, named):
    out = ngram_join.keep_one(named)
    assert out.columns == named.columns
    assert set(given(out, NAMES)) <= set(given(named, NAMES))
    # Equal texts leave one row, and rows without words all stay.
    assert out.count() == len({r.text for r in named.collect() if r.text and r.text.strip()}) + named.where(
        "text IS NULL OR trim(replace(replace(text, '\\n', ''), '\\t', '')) = ''"
    ).count()


def test_every_stage_keeps_the_columns(spark, named):
    docs = named
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns[:len(named.columns)] == named.columns, name
        assert set(given(out, NAMES)) <= set(given(named, NAMES))
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "tokens" else out


def test_codes_keep_columns(spark):
    rows = [(i, [float(i % 5), 0.5] * 4, i % 3, "a", "b", "c") for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row string, other string, total string")
    out = gnat_codes.with_label_error(gnat_codes.encode(table, gnat_codes.fit(table)))
    assert {(r.row, r.other, r.total) for r in out.collect()} == {("a", "b", "c")} and out.count() == 40
