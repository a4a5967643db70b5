"""Codes against plain nearest entries and plain rounds, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from auditloom.llm import gnat_codes
from auditloom.llm.gnat_codes import Gnat, encode, fit, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(point, entries):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(point, e)) for e in entries]
    return far.index(min(far)), min(far)


@pytest.mark.parametrize("scale", [3, 1000, 10**12])
@pytest.mark.parametrize("count", [1, 2, 5, 16, 60])
def test_trees_find_the_nearest_entry(scale, count):
    random = np.random.default_rng(count)
    dtype = object if scale > 10**6 else np.int64
    entries = random.integers(-scale, scale + 1, (count, 4)).astype(dtype)
    entries[count // 2] = entries[0]
    points = np.concatenate([random.integers(-scale, scale + 1, (300, 4)).astype(dtype), entries])
    numbers, far = Gnat(entries).nearest(points)
    assert [(int(n), int(f)) for n, f in zip(numbers, far)] == [nearest(p, entries.tolist()) for p in points.tolist()]


def test_trees_leave_entries_out():
    random = np.random.default_rng(1)
    centres = random.integers(-4000, 4000, (8, 8))
    entries = (np.repeat(centres, 4, axis=0) + random.integers(-30, 30, (32, 8))).astype(np.int64)
    points = (centres[random.integers(0, 8, 5000)] + random.integers(-30, 30, (5000, 8))).astype(np.int64)
    tree = Gnat(entries)
    tree.nearest(points)
    assert tree.compared < 0.6 * 32 * len(points)


def plain(rows, parts, entries, rounds, scale):
    """(id, code, error, label_error) of kept rows and the digest, step by step."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = width // parts
    whole = [[math.floor(x * scale) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cells = [[v[p * step:(p + 1) * step] for p in range(parts)] for v in whole]
    books = [[cells[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cells]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cells, found) if f[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    errors = [sum(f[1] for f in fs) for fs in found]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(
        repr((r[0], "".join(f"{f[0]:02x}" for f in fs), e, labels[r[2]])) for r, fs, e in zip(kept, found, errors)
    ), digest


def coded(table):
    books = fit(table)
    rows = with_label_error(encode(table, books)).select("vec_id", "code", "error", "label_error").collect()
    return sorted(repr(tuple(r)) for r in rows), books.digest()


def odd_rows():
    random = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=16)], int(i % 4) if i % 5 else None) for i in range(120)]
    rows += [
        (3, rows[3][1], 2), (3, rows[40][1], 2), (None, rows[7][1], 0), (None, rows[8][1], None), (500, None, 1),
        (501, [1.0, None] + [0.0] * 14, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 1), (504, [], 1),
        (505, [0.25] * 9, 1), (-7, rows[9][1], 3),
    ] + [(1000 + i, rows[11][1], 1) for i in range(60)]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert coded(table) == plain(rows, 8, 16, 6, 4096)


def test_few_rows_and_none(spark):
    rows = odd_rows()[:3]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == plain(rows, 8, 16, 6, 4096)
    assert coded(spark.createDataFrame([], SCHEMA)) == ([], hashlib.sha256(b"").hexdigest())
    assert coded(spark.createDataFrame([(1, None, 2)], SCHEMA))[0] == []


def test_numbers_of_any_size_are_exact(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=8) * 3e4], 0) for i in range(50)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == plain(rows, 8, 16, 6, 4096)
    far = [(i, [float(np.float32(x)) for x in random.normal(size=8) * 1e30], 0) for i in range(30)]
    table = spark.createDataFrame(far, SCHEMA)
    books = fit(table)
    assert books.digest() == plain(far, 8, 16, 6, 4096)[1]
    assert any(r.error is None for r in encode(table, books).collect())


def test_pieces_of_sums():
    for value in (0, 5, -5, 1 << 70, -(1 << 95) + 3):
        assert sum(p << (gnat_codes._LIMB * i) for i, p in enumerate(gnat_codes._pieces(value))) == value
