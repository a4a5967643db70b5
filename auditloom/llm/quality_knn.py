"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed terms: byte trigrams, and a few terms for repetition and
shape. Term weights and a truncated singular value decomposition come from a bounded
sample of labelled texts, whose latent vectors are broadcast. Every text is projected in
its task, its cosines with all labelled vectors are exact blocked products, and its
nearest neighbours vote with their labels, weighted by similarity.

Null texts are empty. A text without terms is the mean of the labels. Repeated rows get
the same score. Without labelled texts every score is the neutral 0.5.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.grams import gram_sets, word_hashes
from auditloom.llm.shared import slices

# Labelled texts of each label that the classifier is fitted on: the bound of what the
# driver gets and of what is broadcast.
TEXTS_PER_LABEL = 1500
TERMS = 2048
DIMENSIONS = 64
NEIGHBOURS = 25
# Weight of a neighbour: its similarity to this power.
SHARPNESS = 8
# Texts in a block of cosine products.
BLOCK = 512
# Further terms, each with a share of a text between 0 and 1, and their weight.
_STATISTICS = 8
_STATISTIC_WEIGHT = 2.0


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x terms) trigram counts, and (texts x statistics) shares, of UTF-8 texts end to end."""
    texts = len(offsets) - 1
    counts = np.zeros((texts, TERMS), dtype=np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
        owner = np.repeat(np.arange(texts), np.diff(offsets))
        whole = owner[2:] == owner[:-2]
        flat = owner[2:][whole] * TERMS + code[whole]
        counts = np.bincount(flat, minlength=texts * TERMS).reshape(texts, TERMS).astype(np.float32)
    return counts, _shares(data, offsets)


def _shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of repeated words and word runs, and of kinds of signs."""
    texts = len(offsets) - 1
    words, owner = word_hashes(data, offsets)
    found = np.bincount(owner, minlength=texts)
    n_words = np.maximum(found, 1)
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    adjacent = np.bincount(owner[1:][same], minlength=texts) / n_words
    _, runs = gram_sets(data, offsets, 3)
    repeated = np.where(found > 0, 1 - np.diff(runs) / np.maximum(n_words - 2, 1), 0)
    size = np.maximum(np.diff(offsets), 1)

    def share(signs: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(signs)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
    return np.stack(
        [
            adjacent, np.clip(repeated, 0, 1), np.minimum(4 * share(symbol), 1),
            np.minimum(8 * share(data == ord("!")), 1), share((data >= 65) & (data <= 90)),
            share((data >= 48) & (data <= 57)), share(data == ord("|")), np.minimum(found / 1e4, 1),
        ],
        axis=1,
    ).astype(np.float32)


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their texts' bytes, end to end."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    lengths = pc.binary_length(column).to_numpy()
    for start, end in slices(lengths):
        data = np.frombuffer(b"".join(column.slice(start, end - start).to_pylist()), dtype=np.uint8)
        yield batch.slice(start, end - start), data, np.concatenate([[0], np.cumsum(lengths[start:end])]).astype(np.int64)


@dataclass
class Classifier:
    """Term weights, the projection, and the labelled vectors."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        # In 64 bits and rounded, so that a text's vector does not depend on the block it is in.
        return _unit(np.round(_weighted(counts, shares, self.weights).astype(np.float64) @ self.projection.astype(np.float64), 9))

    def scores(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        latent = self.latent(counts, shares)
        out = np.empty(len(counts))
        near = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(counts), BLOCK):
            cosines = np.round(latent[start:start + BLOCK] @ self.vectors.T.astype(np.float64), 9)
            # Of equally near neighbours the earlier ones vote.
            cosines -= np.arange(len(self.labels)) * 1e-15
            at = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weight = np.clip(np.take_along_axis(cosines, at, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1)
            out[start:start + BLOCK] = np.where(total > 0, vote, self.labels.mean())
        return np.round(np.clip(out, 0, 1), 9)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def _weighted(counts: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(np.log1p(counts) * weights), _STATISTIC_WEIGHT * shares], axis=1)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        texts_per_label: int = TEXTS_PER_LABEL) -> Classifier:
    """A classifier from texts and their labels 0 and 1, joined by key.

    Of each label ``texts_per_label`` keys are taken, chosen by their hashes; keys with
    different labels are left out. Their terms are counted in Spark.
    """
    spark = documents.sparkSession
    clean = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")
    ).where("label = other")
    order = F.xxhash64(F.col("key").cast("string"))
    chosen = [
        clean.where(F.col("label") == value).orderBy(order, "key").limit(texts_per_label).select("key", "label")
        for value in (0, 1)
    ]
    # A bounded number of keys, so that they are broadcast and texts stay where they are.
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                counts, shares = term_counts(data, offsets)
                packed = [np.concatenate(row).astype(np.float32).tobytes() for row in zip(np.log1p(counts), shares)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").cast(pa.string()), part.column("label"), pa.array(packed, pa.binary())],
                    names=["key", "label", "terms"],
                )

    # A repeated key counts once, and is one row before it leaves Spark.
    rows = texts.mapInArrow(run, "key string, label int, terms binary").groupBy("key", "label").agg(F.min("terms").alias("terms"))
    return _decompose(sorted(rows.collect(), key=lambda row: row["key"]))


def _decompose(rows: list) -> Classifier:
    width = TERMS + _STATISTICS
    if not rows:
        return Classifier(np.ones(TERMS), np.zeros((width, 0)), np.zeros((0, 0)), np.zeros(0))
    terms = np.stack([np.frombuffer(row["terms"], dtype=np.float32) for row in rows])
    counts, shares = np.expm1(terms[:, :TERMS]), terms[:, TERMS:]
    found = (counts > 0.5).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + found)).astype(np.float32) + np.float32(1)
    matrix = _weighted(counts, shares, weights).astype(np.float64)
    _, vectors = np.linalg.eigh(matrix.T @ matrix)
    projection = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    labels = np.array([row["label"] for row in rows], dtype=np.float64)
    return Classifier(weights, projection, _unit(matrix.astype(np.float32) @ projection), labels)


def classify(documents: DataFrame, classifier: Classifier, text: str = "text", score: str = "score") -> DataFrame:
    """The rows with ``score``, the chance of label 1 among neighbours, in one pass without a shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast(classifier)
    kept = documents.drop(score) if score != text else documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                scores = sent.value.scores(*term_counts(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, score]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{score}` double")
