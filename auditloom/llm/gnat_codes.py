"""Vector codes: parts of vectors as numbers of codebook entries, found through a GNAT over the entries.

Vectors are made integer, cut into equal parts, and every part position has a codebook
that is improved in rounds: each part goes to its nearest entry, each entry becomes the
floored mean of its parts. Entries of a codebook stand in a geometric near-neighbour
access tree: a node has split points, the other entries hang below the nearest split
point, and for every pair of a split point and a child the range of distances from the
point to the child's entries is stored. A query drops a child as soon as its distance to
some split point, less or more its best distance so far, lies strictly outside the range;
bounds are rounded so that no child with an equal distance is dropped. What is left is
compared by exact integers, ties to the lower number. All parts of a block of rows walk a
tree together.

Null vectors and vectors with null or non-finite components are dropped. Shorter vectors
count as filled with zeros up to the longest one, rounded up to whole parts. Null ids come
last and are equal to each other; equal ids follow the order of their vectors. With fewer
rows than entries the codebook is as small as the rows are. Repeated rows have equal codes.
An empty table has no rows. Integers of any size are exact; an error beyond 64 bits is
null. Columns of the rows that have the names of the new ones give way to them.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.shared import slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Split points of a node; a node of fewer entries is a leaf.
SPLITS = 4
# Bytes of vectors in a block.
BLOCK_BYTES = 1 << 22
# Integers below this have distances of up to 512 components in 64 bits; others are Python's.
_NARROW = 1 << 26
# Relative error that square roots and their sums are allowed.
_ROUNDING = 1e-12
# Wide integers are summed in Spark in pieces of so many bits.
_LIMB = 30


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite components; 64 bits where distances fit, else Python integers."""
    floored = np.floor(vectors.astype(np.float64) * scale)
    if not floored.size or np.abs(floored).max() < _NARROW:
        return floored.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(floored)


def squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of points (rows) to an entry."""
    gap = points - entry
    return (gap * gap).sum(axis=1)


@dataclass
class Node:
    """Split points by number, and for each child its node and its ranges of distances."""

    splits: list[int]
    children: list["Node | None"]
    low: np.ndarray
    high: np.ndarray


class Gnat:
    """A tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS):
        self.entries = entries
        self.compared = 0
        self.root = self._node(list(range(len(entries))), splits) if len(entries) else None

    def _node(self, numbers: list[int], splits: int) -> Node:
        # Far apart: each next split point has the largest distance to those before.
        chosen = [numbers[0]]
        nearest = squares(self.entries[numbers], self.entries[numbers[0]])
        while len(chosen) < min(splits, len(numbers)):
            nearest[[numbers.index(c) for c in chosen]] = -1
            chosen.append(numbers[int(np.argmax(nearest))])
            nearest = np.minimum(nearest, squares(self.entries[numbers], self.entries[chosen[-1]]))
        below: list[list[int]] = [[] for _ in chosen]
        for number in numbers:
            if number not in chosen:
                to = [int(squares(self.entries[[c]], self.entries[number])[0]) for c in chosen]
                below[to.index(min(to))].append(number)
        low = np.full((len(chosen), len(chosen)), np.inf)
        high = np.full((len(chosen), len(chosen)), -np.inf)
        for j, members in enumerate(below):
            for i, c in enumerate(chosen):
                if members:
                    far = np.sqrt(squares(self.entries[members], self.entries[c]).astype(np.float64))
                    low[i, j], high[i, j] = far.min() * (1 - _ROUNDING), far.max() * (1 + _ROUNDING)
        return Node(chosen, [self._node(m, splits) if m else None for m in below], low, high)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, exact squared distance) of each point's nearest entry, the lower number of equal ones."""
        best = np.full(len(points), -1, dtype=np.int64)
        error = np.zeros(len(points), dtype=points.dtype)
        if len(points):
            self._walk(self.root, np.arange(len(points)), points, best, error)
        return best, error

    def _walk(self, node: Node, rows: np.ndarray, points: np.ndarray, best: np.ndarray, error: np.ndarray) -> None:
        far = np.empty((len(node.splits), len(rows)))
        mine = points[rows]
        for i, number in enumerate(node.splits):
            square = squares(mine, self.entries[number])
            self.compared += len(rows)
            far[i] = np.sqrt(square.astype(np.float64))
            old, was = error[rows], best[rows]
            better = (was < 0) | (square < old) | ((square == old) & (number < was))
            error[rows[better]], best[rows[better]] = square[better], number
        for j, child in enumerate(node.children):
            if child is None:
                continue
            # The best distance shrinks from child to child.
            reach = np.sqrt(error[rows].astype(np.float64)) * (1 + _ROUNDING)
            alive = np.ones(len(rows), dtype=bool)
            for i in range(len(node.splits)):
                alive &= far[i] * (1 - _ROUNDING) - reach <= node.high[i, j]
                alive &= far[i] * (1 + _ROUNDING) + reach >= node.low[i, j]
            if alive.any():
                self._walk(child, rows[alive], points, best, error)


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & fine)


def _matrices(batch: pa.RecordBatch, vector: str, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their integer vectors, filled up to the width."""
    lengths = batch.column(vector).value_lengths().to_numpy()
    for begin, end in slices([8 * width] * len(lengths), BLOCK_BYTES):
        part = batch.slice(begin, end - begin)
        flat = part.column(vector).flatten().to_numpy(zero_copy_only=False)
        matrix = np.zeros((end - begin, width))
        matrix[np.arange(width) < lengths[begin:end, None]] = flat
        yield part, whole(matrix, scale)


@dataclass
class Codebooks:
    """Integer entries by part, entry and position."""

    parts: int
    scale: int
    width: int
    entries: list[np.ndarray]

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def text(self) -> str:
        return ",".join(str(int(x)) for part in self.entries for entry in part for x in entry)

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def assign(self, trees: list[Gnat], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts) numbers of entries and squared distances."""
        step = self.width // self.parts
        numbers = np.empty((len(matrix), self.parts), dtype=np.int64)
        errors = np.empty((len(matrix), self.parts), dtype=object)
        if matrix.dtype == np.int64 and all(t.entries.dtype == np.int64 for t in trees):
            errors = np.empty((len(matrix), self.parts), dtype=np.int64)
        for p, tree in enumerate(trees):
            points = matrix[:, p * step:(p + 1) * step]
            numbers[:, p], errors[:, p] = tree.nearest(points.astype(errors.dtype))
        return numbers, errors


def _sorted_whole(rows: list[list]) -> np.ndarray:
    values = [[int(x) for x in row] for row in rows]
    narrow = all(abs(x) < _NARROW for row in values for x in row)
    return np.array(values, dtype=np.int64 if narrow else object)


def _improved(rows: DataFrame, books: Codebooks, vector: str) -> Codebooks:
    """Entries as the floored means of their parts; unused entries stay."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        trees = mine.trees()
        step = mine.width // mine.parts
        for batch in batches:
            sums: dict[tuple[int, int], tuple] = {}
            for _, matrix in _matrices(batch, vector, mine.width, mine.scale):
                numbers, _ = mine.assign(trees, matrix)
                for p in range(mine.parts):
                    points = matrix[:, p * step:(p + 1) * step]
                    for e in np.unique(numbers[:, p]).tolist():
                        chosen = numbers[:, p] == e
                        n, total = sums.get((p, e), (0, 0))
                        sums[p, e] = n + int(chosen.sum()), total + points[chosen].sum(axis=0).astype(object)
            out = [
                (p, e, at, limb, n, piece)
                for (p, e), (n, total) in sums.items()
                for at, value in enumerate(total)
                for limb, piece in enumerate(_pieces(int(value)))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in out], pa.int64()) for i in range(6)], names=["p", "e", "at", "limb", "n", "s"]
            )

    moved = rows.select(vector).mapInArrow(run, "p bigint, e bigint, at bigint, limb bigint, n bigint, s bigint")
    totals: dict[tuple[int, int, int], list] = {}
    # A number for each component and piece: the size of the codebooks bounds it.
    for row in moved.groupBy("p", "e", "at", "limb").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        total = totals.setdefault((row["p"], row["e"], row["at"]), [0, 0])
        total[0] += row["s"] << (_LIMB * row["limb"])
        total[1] = max(total[1], row["n"])
    entries = []
    for p, old in enumerate(books.entries):
        new = [[int(x) for x in entry] for entry in old]
        for e, entry in enumerate(new):
            for at in range(len(entry)):
                if (p, e, at) in totals:
                    s, n = totals[p, e, at]
                    entry[at] = s // n
        entries.append(_sorted_whole(new).reshape(old.shape))
    return Codebooks(books.parts, books.scale, books.width, entries)


def _pieces(value: int) -> list[int]:
    """Signed pieces of a sum, the lowest first; always at least one."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    out = [sign * (value & ((1 << _LIMB) - 1))]
    while value := value >> _LIMB:
        out.append(sign * (value & ((1 << _LIMB) - 1)))
    return out


def fit(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks:
    """Codebooks that start as the vectors of the smallest keys and are improved in rounds.

    A round is one pass over the vectors; sums are taken in the tasks, then by part and
    entry in Spark.
    """
    rows = _kept(vectors, vector)
    longest = rows.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    width = -(-longest // parts) * parts
    first = rows.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()
    matrix = np.zeros((len(first), width))
    for i, row in enumerate(first):
        matrix[i, :len(row[vector])] = row[vector]
    start = whole(matrix, scale)
    step = width // parts
    books = Codebooks(parts, scale, width, [start[:, p * step:(p + 1) * step] for p in range(parts)])
    if not first:
        return books
    for _ in range(rounds):
        books = _improved(rows, books, vector)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The kept rows with ``code``, two hex digits for each part, and ``error``, in one pass without a shuffle."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kept = _kept(vectors, vector).drop(*({code, error} - {vector}))
    fields = [*kept.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        trees = mine.trees()
        for batch in batches:
            for part, matrix in _matrices(batch, vector, mine.width, mine.scale):
                numbers, errors = mine.assign(trees, matrix)
                digits = numbers.astype(np.uint8).tobytes().hex()
                n = 2 * mine.parts
                totals = [int(x) for x in errors.sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, pa.array([digits[i:i + n] for i in range(0, n * len(totals), n)], pa.string()),
                        pa.array([t if t < 1 << 63 else None for t in totals], pa.int64()),
                    ],
                    names=names,
                )

    return kept.mapInArrow(run, T.StructType(fields))


def with_label_error(rows: DataFrame, label: str = "label", error: str = "error", total: str = "label_error") -> DataFrame:
    """The rows with the error summed over equal labels, nulls together.

    Errors are summed before they move; a label with a third of all rows is split by the
    adaptive skew join, or not moved at all where the sums are small enough to broadcast.
    """
    whole_rows = rows.drop(*({total} - {label, error})).select(F.col(label).alias("label"), F.struct("*").alias("row"))
    sums = rows.groupBy(F.col(label).alias("other")).agg(F.sum(error).alias("total"))
    joined = whole_rows.join(sums, F.col("label").eqNullSafe(F.col("other")), "left")
    return joined.select("row.*", F.col("total").alias(total))
