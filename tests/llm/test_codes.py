"""Codes against plain integer k-means, and cells against all entries."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from staffmatch.llm import grid_codes as gc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """rows: (vec_id, embedding, label) that are coded, in order of ids."""
    cut = [[[math.floor(4096 * float(x)) for x in e[p * len(e) // 8:(p + 1) * len(e) // 8]] for p in range(8)] for _, e, _ in rows]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda c, p: min((far(c[p], e), i) for i, e in enumerate(books[p]))
    for _ in range(6):
        found = [[pick(c, p)[1] for p in range(8)] for c in cut]
        books = [[[sum(col) // len(col) for col in zip(*mine)] if (mine := [c[p] for c, f in zip(cut, found) if f[p] == i]) else e
                  for i, e in enumerate(books[p])] for p in range(8)]
    out, totals = [], defaultdict(int)
    for (vec_id, _, label), c in zip(rows, cut):
        best = [pick(c, p) for p in range(8)]
        out.append((vec_id, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
        totals[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(v, code, error, totals[label], digest) for v, code, error, label in out]


def sample(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, dim))
    return [(int(i), (base[i % 9] + rng.normal(scale=0.3, size=dim)).astype(np.float32).tolist(), None if i % 4 == 0 else int(i % 3)) for i in range(n)]


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("bits, memo, limit", [(8, 1 << 16, 1 << 24), (11, 5, -1)])
def test_codes_match_the_plain_version(spark, bits, memo, limit, monkeypatch):
    monkeypatch.setattr(gc, "BROADCAST_BYTES", limit)  # both ways of joining the label totals
    monkeypatch.setattr(gc.Nearest.__init__, "__defaults__", (bits, memo))
    rows = sample(150)
    rows += [(200 + i, rows[3][1], 7) for i in range(60)]  # copies
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' AS ints", "1 AS error", "2 AS code")
    assert result(gc.compress(frame)) == sorted(plain(rows), key=repr)


def test_awkward_rows(spark):
    good = sample(20)
    nan, inf = float("nan"), float("inf")
    bad = [(50, None, 1), (51, [nan] + [0.0] * 15, 1), (52, [inf] + [0.0] * 15, None), (53, [None] + [0.0] * 15, 1), (54, [1.0] * 8, 1),
           (55, [1.0] * 15, 1), (56, [1e30] * 16, 1), (57, [], 1)]
    same_id = [(5, good[0][1], 1), (None, good[1][1], 2), (None, good[1][1], 2)]
    frame = spark.createDataFrame(bad + good + same_id, SCHEMA).repartition(3)
    cells = lambda e: [math.floor(4096 * x) for x in e]
    ordered = sorted(good + same_id, key=lambda r: (r[0] is None, r[0] or 0, cells(r[1])))
    assert result(gc.compress(frame)) == sorted(plain(ordered), key=repr)
    few = spark.createDataFrame(good[:3], SCHEMA)
    assert result(gc.compress(few)) == sorted(plain(good[:3]), key=repr)
    assert gc.compress(spark.createDataFrame(bad[:4], SCHEMA)).count() == 0
    assert gc.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = gc.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in empty} == {("00" * 8, 0, 0)}


def test_cells_leave_out_dominated_entries_only():
    rng = np.random.default_rng(4)
    book = rng.integers(-3000, 3000, size=(16, 4))
    book[9] = book[2]  # a tie goes to the lower index
    values = rng.integers(-4000, 4000, size=(5000, 4))
    values[:16] = book
    find = gc.Nearest(book, bits=8)
    entry, distance = find(values)
    every = ((values[:, None, :] - book) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert find.evaluated < every.size / 3
    before = len(find.memo)
    assert (find(values)[0] == entry).all() and len(find.memo) == before
