"""Toxic spans: sums against all labellings, learning on small texts, and odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import toxic_crf
from auditloom.llm.toxic_crf import fit, forward_backward, marking_names, tag


def chances(odds, start, move):
    """Chance of toxic of each word of one chain, over all labellings."""
    total, toxic = 0.0, np.zeros(len(odds))
    for labels in itertools.product([0, 1], repeat=len(odds)):
        weight = start[labels[0]] * np.exp(sum(o for o, l in zip(odds, labels) if l))
        for a, b in zip(labels, labels[1:]):
            weight *= move[a, b]
        total += weight
        toxic += weight * np.array(labels)
    return toxic / total


@pytest.mark.parametrize("lengths", [[1], [5], [1, 1, 1], [3, 7, 1, 9, 2], [10, 10, 10, 10]])
def test_chances_are_those_of_all_labellings(lengths):
    rng = np.random.default_rng(len(lengths))
    odds = rng.normal(size=sum(lengths)) * 3
    first = np.zeros(len(odds), dtype=bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    start, move = np.exp(rng.normal(size=2)), np.exp(rng.normal(size=(2, 2)))
    got = forward_backward(odds, first, start, move)[0]
    at = 0
    for length in lengths:
        assert np.allclose(got[at:at + length], chances(odds[at:at + length], start, move))
        at += length


def test_long_chains_stay_in_range():
    rng = np.random.default_rng(1)
    odds = rng.normal(size=200_000) * 40
    first = np.zeros(len(odds), dtype=bool)
    first[[0, 7, 100_000]] = True
    got = forward_backward(odds, first, np.array([1.0, 1e-3]), np.array([[1.0, 1e-4], [0.2, 0.5]]))[0]
    assert np.isfinite(got).all() and got.min() >= 0 and got.max() <= 1


WORDS = ["morning", "paper", "river", "stone", "window", "letter", "garden", "market", "winter", "silver", "über", "naïve"]
BAD = ["blorgh", "zanked", "quiffle"]


def texts(count, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        words = rng.choices(WORDS, k=rng.randint(8, 40))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(400, 1)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))


def test_unseen_texts_and_their_spans(spark, trained):
    rows = texts(200, 2)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for row in tag(table, trained).collect():
        assert (row.score >= 0.3) == bool(row.toxic)
        found = [w for s in row.spans for w in row.text[s.start:s.end].split(" ")]
        assert found == [w for w in row.text.split(" ") if w in BAD]


def test_copies_of_a_text_mark_nothing(spark):
    """Words that only copies of one toxic text hold stand in one place each."""
    rows = texts(400, 3) + [(1000 + i, "plover sandal ticket harbor", 1) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample, _ = toxic_crf._sample(table, table, "doc_id", "text", "toxic")
    marks = set(marking_names(sample).tolist())
    data = np.frombuffer(b"plover blorgh zanked", dtype=np.uint8)
    words = toxic_crf.words_of(data, np.array([0, len(data)]))
    assert [int(h) in marks for h in words.hashes] == [False, True, True]


def test_odd_rows(spark, trained, documents, no_documents):
    out = tag(documents, trained)
    rows = out.collect()
    assert len(rows) == documents.count() and out.columns.count("spans") == 1
    assert all(0 <= r.score <= 1 and r.spans is not None for r in rows)
    bare = {r.score for r in rows if not r.text or not r.text.strip()}
    assert bare == {trained.prior} and all(not r.spans for r in rows if r.score in bare)
    assert tag(no_documents, trained).count() == 0
    same = {}
    for r in rows:
        assert same.setdefault(r.text, r.score) == r.score


def test_very_long_texts(spark, trained):
    long = " ".join(WORDS * 4000)
    rows = spark.createDataFrame([(1, long), (2, long + " blorgh zanked " + long), (3, "x" * 300_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in tag(rows, trained).collect()}
    assert not found[1].spans and not found[3].spans
    (span,) = found[2].spans
    assert (span.start, span.end) == (len(long) + 1, len(long) + 14)


def test_nothing_to_learn_from(spark, no_documents, documents):
    labels = documents.select("doc_id", F.lit(1).alias("toxic"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for docs, known, score in ((no_documents, labels, 1.0), (documents, none, 0.0), (documents, labels, 1.0)):
        assert {r.score for r in tag(documents, fit(docs, known)).collect()} == {score}
    clash = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert fit(documents, clash).prior == 0
