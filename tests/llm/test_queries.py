"""Queries against their SQL, and by brute force where SQL cannot express them, over small tables."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from auditloom.llm import queries, sql
from check import TABLES, digest
from tests.llm.test_pii_bootstrap import expected as personal
from tests.llm.test_secret_scan import spans as secrets

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(sql.all_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = [tuple(r) for r in frame.select(columns).collect()]
    result = db.execute(sql.all_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert digest(ours) == digest(theirs), Counter(map(repr, ours)) - Counter(map(repr, theirs))


def test_quality_of_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = rows_of(spark, "op1_quality_knn")
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pieces_against_the_original(spark, texts):
    original = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    for row in rows_of(spark, "op2_sentencepiece"):
        ids = original.encode(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert row.same


def test_languages_of_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = rows_of(spark, "op3_language_id")
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_secrets(spark, texts):
    for row in rows_of(spark, "op4_secret_scan"):
        listed = ["{1}:{0}:{2}".format(*s) for s in secrets(texts[row.doc_id])]
        assert row.base_sha256 == sha(",".join(listed))
        assert not set(listed) - set(row.spans.split(","))
        assert row.n_assign + row.n_access + row.n_hex == len(listed)


def test_records(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    found = {r.doc_id: r for r in rows_of(spark, "op7_token_records")}
    start = 0
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        row = found.pop(doc)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not found


def test_personal_data(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for row in rows_of(spark, "op8_pii_bootstrap"):
        listed = [f"{kinds[k]}:{s}:{e}" for s, k, e in personal(texts[row.doc_id])]
        assert row.base_sha256 == sha(",".join(listed))
        assert not set(listed) - set(row.spans.split(","))


def test_pipeline_stages(spark, documents, no_documents, tmp_path):
    """Odd rows pass through every stage, and what a stage decides takes effect."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark", "personal_data", "tokens"]
    for docs in (documents, no_documents):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "tokens":
                assert docs.columns == columns
                assert {(r.spans, r.score, tuple(r.ids)) for r in docs.collect()} <= {("x", 1.5, (1,))}
            docs.write.parquet(str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
            docs = spark.read.parquet(str(sorted(tmp_path.iterdir(), key=lambda p: int(p.name.rsplit('-', 1)[1]))[-1]))
    assert docs.count() == 0


def test_pipeline_result(spark, texts):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids) and set(ids) <= set(texts)
    original = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    for row in rows:
        assert row.ids == original.encode(row.text)
        assert row.same and row.n_chars == len(row.text)
        assert not personal(row.text)
    # Copies of a text keep its first document.
    assert len({r.text for r in rows}) == len(rows)


def test_toxicity_of_held_out_rows(spark):
    """Held-out accuracy needs more than the smallest tables."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES["op13_toxic_crf"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.9 * len(held) and any(r.predicted and labels[r.doc_id] for r in held)
    assert not any(r.predicted and not labels[r.doc_id] for r in held)
