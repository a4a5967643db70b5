"""Hard negatives: for an anchor and each of its positives, the best rows of other labels just below it.

Scores are integer inner products, worked out for tiles of anchors and candidates by
Strassen's recursion: seven products of half-size blocks instead of eight, with blocks
filled up by zeros, down to small blocks. All additions are those of 64-bit integers, in
which sums that run over on the way come back, so that scores are exact wherever they
fit. Every task keeps the best rows of each anchor in sorted lists of fixed length, which
merge: first the positives, then, with the positives' scores known, the rows of other labels
inside each positive's window. A list of merged lists is the list of all rows.

Anchors are taken block by block; a block has at most ``BLOCK_BYTES`` of vectors, which
bounds what the driver holds and what is broadcast. Candidates are read once for each of
both steps of a block, and never move.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor
do those with a component that is no 64-bit integer after scaling. Shorter vectors count as
filled with zeros. Higher scores come first, then smaller ids, null ids last. Repeated rows
are rows of their own: a copy of an anchor is another row, and a copied anchor has its
results as often. A row without an id is a candidate, never an anchor. Empty tables, and
anchors without a positive or without a row in the window, give no rows. Other columns are
not looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import scratch_path, slices, stored

POSITIVES, NEGATIVES = 5, 5
# A negative has at least so many hundredths of the positive's score.
LEAST_PERCENT = 80
# Bytes of the anchors of a block, and of the candidates of a tile.
BLOCK_BYTES = 2 << 20
TILE_BYTES = 1 << 18
# Blocks with a side of at most this are multiplied directly.
DIRECT = 32
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, direct: int = DIRECT) -> np.ndarray:
    """The product of two int64 matrices of any shapes."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= direct:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, direct)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = strassen(a11 + a22, b11 + b22, direct)
    p2 = strassen(a21 + a22, b11, direct)
    p3 = strassen(a11, b12 - b22, direct)
    p4 = strassen(a22, b21 - b11, direct)
    p5 = strassen(a11 + a12, b22, direct)
    p6 = strassen(a21 - a11, b11 + b12, direct)
    p7 = strassen(a12 - a22, b21 + b22, direct)
    out = np.empty((2 * n, 2 * m), dtype=np.int64)
    out[:n, :m] = p1 + p4 - p5 + p7
    out[:n, m:] = p3 + p5
    out[n:, :m] = p2 + p4
    out[n:, m:] = p1 - p2 + p3 + p6
    return out


@dataclass
class Heaps:
    """For each of many slots the best rows so far, at most ``most`` of them, in order."""

    slots: int
    most: int

    def __post_init__(self):
        self.slot = self.score = self.key = self.mark = self.rank = np.empty(0, dtype=np.int64)
        # The worst score that still may enter a slot.
        self.floor = np.full(self.slots, np.iinfo(np.int64).min)

    def merge(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, mark: np.ndarray) -> None:
        """Take in rows; of equal scores smaller keys come first, and of equal keys marked ones."""
        slot, score, key, mark = (
            np.concatenate(pair) for pair in ((self.slot, slot), (self.score, score), (self.key, key), (self.mark, mark))
        )
        order = np.lexsort((-mark, key, ~score, slot))
        slot = slot[order]
        begins = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.empty(0, int)
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        kept = rank < self.most
        order = order[kept]
        self.slot, self.score, self.key, self.mark = slot[kept], score[order], key[order], mark[order]
        self.rank = rank[kept]
        full = rank[kept] == self.most - 1
        self.floor[self.slot[full]] = self.score[full]

    def batch(self) -> pa.RecordBatch:
        """The rows with their ranks from 0, as a batch may be cut anywhere on its way."""
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self.slot, self.score, self.key, self.mark, self.rank)],
            names=["slot", "score", "key", "mark", "rank"],
        )


_HEAP_ROWS = "slot bigint, score bigint, key bigint, mark bigint, rank bigint"


@dataclass
class Block:
    """Anchors: ids, labels, and vectors filled up to one width; later their positives."""

    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: np.ndarray | None = None
    positive_keys: np.ndarray | None = None
    there: np.ndarray | None = None


def prepared(rows: DataFrame, key: Column, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(key, label, vector) of the rows that take part, the vector as 64-bit integers."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    limit = float(1 << 62) / scale
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < limit))
    return rows.where(label.isNotNull() & F.col(vector).isNotNull() & fine).select(
        key.cast("bigint").alias("key"), label.cast("bigint").alias("label"), x.alias("vector")
    )


def _packed(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, labels, vectors) of rows; a null key is the largest number."""
    lists = batch.column("vector")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    vectors = np.zeros((batch.num_rows, width), dtype=np.int64)
    vectors[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    keys = batch.column("key").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return keys, batch.column("label").to_numpy(zero_copy_only=False), vectors


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for begin, end in slices([8 * max(width, 1)] * batch.num_rows, TILE_BYTES):
            yield _packed(batch.slice(begin, end - begin), width)


def _best(candidates: DataFrame, block: Block, width: int, negatives: bool, most: int, percent: int) -> DataFrame:
    """Heaps of a block's anchors, or of their positives' windows, one for each task."""
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        n = len(mine.keys)
        wanted = mine.positives.shape[1] if negatives else 1
        heaps = Heaps(n * wanted, most)
        for keys, labels, vectors in _tiles(batches, width):
            scores = strassen(mine.vectors, np.ascontiguousarray(vectors.T))
            same = mine.labels[:, None] == labels
            for p in range(wanted):
                floor = heaps.floor[p::wanted]
                if negatives:
                    top = mine.positives[:, p]
                    # percent * top <= 100 * score, without a product that may run over.
                    low = top - _floor_share(top, 100 - percent)
                    fits = ~same & (scores <= top[:, None]) & (scores >= np.maximum(low, floor)[:, None])
                    fits &= mine.there[:, p, None]
                else:
                    fits = same & (scores >= floor[:, None])
                row, column = np.nonzero(fits)
                found = scores[row, column]
                mark = np.zeros(len(row), dtype=np.int64)
                if not negatives:
                    twin = np.flatnonzero(mine.keys[row] == keys[column])
                    mark[twin] = (mine.vectors[row[twin]] == vectors[column[twin]]).all(axis=1)
                heaps.merge(row * wanted + p, found, keys[column], mark)
        yield heaps.batch()

    return candidates.mapInArrow(run, _HEAP_ROWS)


def _floor_share(value: np.ndarray, percent: int) -> np.ndarray:
    """floor(value * percent / 100), without a product that may run over."""
    return value // 100 * percent + value % 100 * percent // 100


def _merged(heaps: DataFrame, slots: int, most: int) -> DataFrame:
    """One heap for each slot: the heaps of the tasks meet by slot, and merge as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Heaps(slots, most)
        for batch in batches:
            mine.merge(*(batch.column(c).to_numpy() for c in ("slot", "score", "key", "mark")))
        yield mine.batch()

    return heaps.repartition("slot").mapInArrow(run, _HEAP_ROWS)


def _blocks(anchors: DataFrame, width: int, most: int) -> Iterator[Block]:
    """Anchors as they lie in their table, a bounded number at a time."""
    held: list = []

    def block() -> Block:
        vectors = np.zeros((len(held), width), dtype=np.int64)
        for i, row in enumerate(held):
            vectors[i, :len(row["vector"])] = row["vector"]
        return Block(np.array([r["key"] for r in held]), np.array([r["label"] for r in held]), vectors)

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) >= most:
            yield block()
            held = []
    if held:
        yield block()


def mine_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are those of ``prepared``; ``anchor`` says which of them are anchors, by
    ``key``. An anchor's positives are its best ``positives`` other rows of its label, and
    each positive's negatives the best ``negatives`` rows of other labels with at least
    ``percent`` hundredths of its score and at most all of it.
    """
    spark = rows.sparkSession
    candidates = stored(rows, "candidates")
    width = candidates.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    anchors = stored(candidates.where(F.coalesce(anchor, F.lit(False))), "anchors")
    folder = scratch_path(spark, "negatives")
    schema = (
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in _blocks(anchors, width, max(1, block_bytes // (8 * max(width, 1)))):
        n = len(block.keys)
        # One more than wanted, as the anchor itself is among them.
        best = _merged(_best(candidates, block, width, False, positives + 1, percent), n, positives + 1).toArrow()
        _set_positives(block, *(best.column(c).to_numpy() for c in ("slot", "score", "key", "mark")), positives)
        found = _merged(_best(candidates, block, width, True, negatives, percent), n * positives, negatives)
        _results(spark, found, block, positives).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _set_positives(block: Block, slot: np.ndarray, score: np.ndarray, key: np.ndarray, mark: np.ndarray, positives: int) -> None:
    """The first rows of each anchor but for one that is itself."""
    order = np.lexsort((-mark, key, ~score, slot))
    slot, score, key, mark = slot[order], score[order], key[order], mark[order]
    itself = np.flatnonzero(mark)
    itself = itself[np.unique(slot[itself], return_index=True)[1]]
    slot, score, key = (np.delete(x, itself) for x in (slot, score, key))
    begins = np.searchsorted(slot, np.arange(len(block.keys)))
    rank = np.arange(len(slot)) - begins[slot]
    first = rank < positives
    shape = (len(block.keys), positives)
    block.positives, block.there = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
    block.positive_keys = np.zeros(shape, dtype=np.int64)
    at = slot[first], rank[first]
    block.positives[at], block.there[at], block.positive_keys[at] = score[first], True, key[first]


def _results(spark, found: DataFrame, block: Block, positives: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((block.keys, block.positive_keys, block.positives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, keys, scores = sent.value
        for batch in batches:
            slot, score, key, rank = (batch.column(c).to_numpy() for c in ("slot", "score", "key", "rank"))
            at = slot // positives, slot % positives
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors[slot // positives]), _ids(keys[at]), pa.array((rank + 1).astype(np.int32)), _ids(key),
                    pa.array(scores[at]), pa.array(score),
                ],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return found.mapInArrow(
        run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )


def _ids(keys: np.ndarray) -> pa.Array:
    return pa.array(keys, mask=keys == _NO_ID)
