import math

import numpy as np
import pytest

from staffmatch.llm import embed_int8 as e
from tests.llm.helpers import plain_components

SCHEMA = "vec_id long, embedding array<float>, n int, links string, class_id string, block int, key string"


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for c in rng.normal(size=(12, 24)):
        out += [c + rng.normal(size=24) * s for s in rng.uniform(0, 0.5, 12)]
    out += [out[0]] * 5 + [out[0] * 7.5, out[3] * 1e-20, -out[0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [None, *[1.0] * 23]), (504, [math.nan] * 24), (505, [math.inf, *[0.0] * 23]),
             (506, [1.0, 2.0]), (507, [2.0, 4.0]), rows[7]]
    return rows


def plain(rows):
    def unit(v):
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        return np.array(v, np.float32).astype(float) if ok else None

    vs = [unit(v) for _, v in rows]
    linked = lambda i, j: (vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j])
                           and vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= 0.9)
    heads = plain_components(list(range(len(rows))), linked)
    low = {}
    for i, h in enumerate(heads):
        low[h] = min(low.get(h, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], sum(linked(i, j) for j in range(len(rows)) if j != i), low[heads[i]], rows[i][0] == low[heads[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [e.BLOCK_ROWS, 40])
def test_matches_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", "x", 2, "x") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, e.near_vectors(df, block).collect())) == plain(rows)


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 70)) * rng.lognormal(size=(300, 1))
    v[::7] *= np.where(rng.random((43, 70)) < 0.9, 0, 50)  # nearly one-sided vectors
    b = e.Block(np.arange(300), np.ones(300, dtype=np.int64), v)
    assert np.abs(b.ints).max() <= 127
    approx = (b.ints @ b.ints.T).astype(float) * np.outer(b.scale, b.scale)
    unit = b.vectors / b.norms[:, None]
    bound = b.error[:, None] + b.error * (1 + b.error[:, None]) + e.ROUNDING
    assert (np.abs(unit @ unit.T - approx) <= bound).all()


def test_wide_vectors_add_up_exactly():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-127, 128, (5, 2300)).astype(np.float32) for _ in range(2))
    a[0], b[0] = 127, 127
    assert (e._products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in e.near_vectors(df).collect()) == [(0, 0, False), (1, 0, True)]
    assert e.near_vectors(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(None, [1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(twins).collect()) == [(0, 1, 4, False), (4, 1, 4, True)]
