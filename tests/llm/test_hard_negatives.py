"""Hard negatives against a plain search over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm.hard_negatives import Heaps, _floor_share, mine_negatives, prepared, strassen

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 31), (65, 70, 129), (128, 64, 256), (40, 1, 40)])
@pytest.mark.parametrize("direct", [1, 4, 32])
def test_products_are_exact(shape, direct):
    random = np.random.default_rng(sum(shape))
    n, k, m = shape
    a, b = random.integers(-10**6, 10**6, (n, k)), random.integers(-10**6, 10**6, (k, m))
    assert (strassen(a, b, direct) == a @ b).all()


def test_sums_that_run_over_come_back():
    a = np.full((8, 8), 1 << 40, dtype=np.int64)
    a[:, 4:] *= -1
    b = np.full((8, 8), (1 << 22) + 1, dtype=np.int64)
    assert (strassen(a, b, 1) == 0).all()


def test_heaps_merge_in_any_order():
    random = np.random.default_rng(4)
    rows = np.stack([random.integers(0, 6, 500), random.integers(0, 9, 500), random.integers(0, 40, 500), random.integers(0, 2, 500)])
    whole, first, second = Heaps(6, 5), Heaps(6, 5), Heaps(6, 5)
    whole.merge(*rows)
    for start in range(0, 500, 50):
        (first if start % 100 else second).merge(*rows[:, start:start + 50])
    first.merge(second.slot, second.score, second.key, second.mark)
    assert first.batch().equals(whole.batch())
    best = sorted((-s, k, -m) for t, s, k, m in rows.T.tolist() if t == 3)[:5]
    assert [(-s, k, -m) for t, s, k, m in zip(whole.slot, whole.score, whole.key, whole.mark) if t == 3] == best


def test_shares_do_not_run_over():
    values = np.array([0, 1, 99, 100, 101, 12_345, -1, -12_345, (1 << 62) + 7], dtype=np.int64)
    assert _floor_share(values, 20).tolist() == [v * 20 // 100 for v in values.tolist()]


def moved(vec_id, label):
    return label if vec_id is None or vec_id % 7 else (label + 1) % 10


def plain(rows):
    kept = [
        (v, moved(v, l), [math.floor(x * 256) for x in e]) for v, e, l in rows
        if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(s, v):
        return -s, v is None, v or 0

    out = []
    for i, (v, l, e) in enumerate(kept):
        if v is None or v % 100:
            continue
        near = [(score(e, f), w, m) for j, (w, m, f) in enumerate(kept) if j != i]
        same = sorted((n for n in near if n[2] == l), key=lambda n: order(n[0], n[1]))[:5]
        for s, w, _ in same:
            fits = [n for n in near if n[2] != l and 80 * s <= 100 * n[0] <= 100 * s]
            for rank, n in enumerate(sorted(fits, key=lambda n: order(n[0], n[1]))[:5], 1):
                out.append((v, w, rank, n[1], s, n[0]))
    return sorted(map(repr, out))


def mined(table, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(table, F.col("vec_id"), label, "embedding")
    return sorted(repr(tuple(r)) for r in mine_negatives(rows, F.col("key") % 100 == 0, **how).collect())


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(8)
    out = [(i, [float(np.float32(x)) for x in random.normal(size=12) / 3], int(random.integers(0, 4))) for i in range(700)]
    out += [out[100], out[100], (100, out[5][1], 2), (None, out[100][1], 2), (None, out[200][1], 0), (701, None, 1), (800, None, 1)]
    out += [(702, [None] * 12, 1), (703, [float("nan")] * 12, 1), (704, [float("inf")] * 12, 1), (705, out[3][1], None)]
    out += [(900, out[3][1], None), (1000, [], 1), (706, out[200][1][:5], 0), (0, [0.0] * 12, 3), (1100, [0.0] * 12, 3)]
    # Ties: many rows with one vector, on both sides of a label.
    return out + [(2000 + i, [0.5] * 12, i % 3) for i in range(150)]


def test_plain_search(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert mined(table) == plain(rows) and len(plain(rows)) > 100


def test_blocks_of_anchors(spark, rows):
    """One anchor in a block, or several, gives the same rows."""
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(table, block_bytes=3 * 8 * 12) == plain(rows)


def test_ranks_do_not_depend_on_batches(spark, rows):
    """Rows of one anchor and positive that come in several batches are numbered through."""
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mined(table) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nothing_to_mine(spark, rows):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([r for r in rows if r[0] and r[0] % 100], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
