import hashlib

import numpy as np
import pyarrow as pa
import pytest

from staffmatch.operators import ivf
from staffmatch.operators.knn import KnnOptions, top_k

PLANS = {
    "broadcast": KnnOptions(plan="broadcast"),
    "broadcast seeded": KnnOptions(plan="broadcast", seed_fraction=0.3),
    "blocks": KnnOptions(plan="blocks", broadcast_bytes=600),
    "blocks seeded": KnnOptions(plan="blocks", broadcast_bytes=600, seed_fraction=0.3),
    "grid": KnnOptions(plan="grid", block_rows=40),
    "grid seeded": KnnOptions(plan="grid", block_rows=40, seed_fraction=0.3),
}


def unit(rng, n, dim):
    v = rng.normal(size=(n, dim)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, name, ids, vectors, parts=3):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} string, vec array<float>").repartition(parts)


def brute_force(query_ids, queries, item_ids, items, k):
    sims = np.floor(queries.astype(float) @ items.astype(float).T * 1e9 + 0.5) / 1e9
    out = []
    for q, line in zip(query_ids, sims):
        order = np.lexsort((np.array(item_ids), -line))[:k]
        out += [(q, item_ids[j], float(line[j]), r) for r, j in enumerate(order, start=1)]
    return sorted(out)


def rows(df):
    return sorted((r["requirement_id"], r["employee_id"], r["similarity"], r["candidate_rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    items = unit(rng, 300, 8)
    items[:100] = items[0]  # a third of all vectors are copies of one
    queries = np.concatenate([unit(rng, 24, 8), items[:1]])
    return [f"R{i:03d}" for i in range(25)], queries, [f"E{i:03d}" for i in range(300)], items


@pytest.mark.parametrize("name", PLANS)
def test_equals_brute_force_with_many_copies(spark, data, name):
    qi, q, ii, it = data
    got = top_k(frame(spark, "requirement_id", qi, q), frame(spark, "employee_id", ii, it), 20, options=PLANS[name])
    assert rows(got) == brute_force(qi, q, ii, it, 20)


@pytest.mark.parametrize("name", ["broadcast", "grid seeded"])
def test_result_does_not_depend_on_partitioning_or_row_order(spark, data, name):
    qi, q, ii, it = data
    back = list(range(len(ii)))[::-1]
    one = top_k(frame(spark, "requirement_id", qi, q, 1), frame(spark, "employee_id", ii, it, 1), 7, options=PLANS[name])
    two = top_k(frame(spark, "requirement_id", qi[::-1], q[::-1], 5),
                frame(spark, "employee_id", [ii[i] for i in back], it[back], 9), 7, options=PLANS[name])
    assert rows(one) == rows(two)


@pytest.mark.parametrize("name", ["broadcast", "blocks", "grid", "grid seeded"])
def test_full_probe_equals_exact_and_partial_probe_searches_only_its_cells(spark, data, name):
    qi, q, ii, it = data
    queries, items = frame(spark, "requirement_id", qi, q), frame(spark, "employee_id", ii, it)
    centres = ivf.train_centroids(items, 6)
    cells = ivf.assign_cells(items, centres)
    full = top_k(ivf.probe_cells(queries, centres, 99), cells, 20, cells=True, options=PLANS[name], cell_count=6)
    assert rows(full) == brute_force(qi, q, ii, it, 20)
    part = top_k(ivf.probe_cells(queries, centres, 2), cells, 20, cells=True, options=PLANS[name], cell_count=6)
    cell_of = {r["employee_id"]: r["cell"] for r in cells.collect()}
    probed = {r["requirement_id"]: r["cells"] for r in ivf.probe_cells(queries, centres, 2).collect()}
    want = []
    for i, r in enumerate(qi):
        inside = [j for j, e in enumerate(ii) if cell_of[e] in probed[r]]
        want += brute_force([r], q[i:i + 1], [ii[j] for j in inside], it[inside], 20)
    assert rows(part) == sorted(want)


def test_recall_grows_with_probes(spark, sf):
    from staffmatch.sources import staffing as st

    queries, items = st.requirements(spark, sf).select("requirement_id", "vec"), st.active_vectors(spark, sf)
    exact = {r[:2] for r in rows(top_k(queries, items, 20))}
    centres = ivf.train_centroids(items, 8)
    cells = ivf.assign_cells(items, centres)
    recall = [len({r[:2] for r in rows(top_k(ivf.probe_cells(queries, centres, n), cells, 20, cells=True))} & exact) / len(exact)
              for n in (2, 4, 8)]
    assert recall == sorted(recall) and recall[1] > 0.5 and recall[2] == 1.0


def test_small_sides_and_bad_input(spark, data):
    qi, q, ii, it = data
    queries = frame(spark, "requirement_id", qi[:2], q[:2])
    for options in PLANS.values():
        assert len(rows(top_k(queries, frame(spark, "employee_id", ii[:3], it[:3]), 50, options=options))) == 6
        assert rows(top_k(queries, frame(spark, "employee_id", ii[:3], it[:3]).where("employee_id = 'x'"), 5, options=options)) == []
        assert rows(top_k(queries.where("requirement_id = 'x'"), frame(spark, "employee_id", ii[:3], it[:3]), 5, options=options)) == []
    with pytest.raises(Exception, match="vector dimension must be 8"):
        top_k(queries, frame(spark, "employee_id", ii[:3], it[:3, :5]), 5).collect()
    with pytest.raises(ValueError):
        top_k(queries, queries, 0)
    with pytest.raises(ValueError, match="exceed the broadcast bound"):
        top_k(queries, queries, 1, options=KnnOptions(plan="broadcast", broadcast_bytes=1))
    with pytest.raises(ValueError, match="cannot train"):
        ivf.train_centroids(frame(spark, "employee_id", ii[:3], it[:3]), 4)


def test_large_requirement_side_is_cut_into_blocks(spark, data):
    qi, q, ii, it = data
    options = KnnOptions(broadcast_bytes=800)
    got = top_k(frame(spark, "requirement_id", qi, q), frame(spark, "employee_id", ii, it), 5, options=options)
    assert len(got.inputFiles()) > 0 and "FlatMapCoGroupsInArrow" not in got._jdf.queryExecution().toString()
    assert len({f.rsplit("/", 2)[-2] for f in got.inputFiles()}) >= 3  # blocks written
    assert rows(got) == brute_force(qi, q, ii, it, 5)
    with pytest.raises(ValueError, match="single requirement"):
        top_k(frame(spark, "requirement_id", qi, q), frame(spark, "employee_id", ii, it), 5, options=KnnOptions(broadcast_bytes=10))


def test_blocks_never_shuffle_the_items(spark, data, monkeypatch):
    from staffmatch.operators import knn

    qi, q, ii, it = data
    plans, scan = [], knn._broadcast_plan

    def watched(*args):
        out = scan(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(knn, "_broadcast_plan", watched)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ii, it)], "employee_id string, vec array<float>")
    top_k(frame(spark, "requirement_id", qi, q), items, 5, options=PLANS["blocks"])
    assert len(plans) >= 3 and not any("Exchange" in p for p in plans)


def exact_case(spark, data, nlist=8):
    qi, q, ii, it = data
    items = frame(spark, "employee_id", ii, it)
    centres = ivf.train_centroids(items, nlist)
    celled = ivf.assign_cells(items, centres, with_reach=True)
    return frame(spark, "requirement_id", qi, q), celled, centres, ivf.read_reach(ivf.cell_reach(celled), nlist)


@pytest.mark.parametrize("name", ["broadcast", "blocks", "grid"])
@pytest.mark.parametrize("nprobe, k", [(1, 3), (3, 20), (8, 20), (1, 250)])
def test_bounded_probes_equal_brute_force(spark, data, name, nprobe, k):
    from staffmatch.plans.match import candidates

    qi, q, ii, it = data
    queries, celled, centres, reach = exact_case(spark, data)
    got = candidates(queries, celled.drop("cosine", "norm"), k, centroids=centres, nprobe=nprobe, reach=reach, options=PLANS[name])
    assert rows(got) == brute_force(qi, q, ii, it, k)


def test_cells_left_out_hold_nothing_above_the_floor(spark, data):
    qi, q, ii, it = data
    queries, celled, centres, reach = exact_case(spark, data, 12)
    best = {r[0]: r[2] for r in brute_force(qi, q, ii, it, 5) if r[3] == 5}
    probes = spark.createDataFrame([(i, [float(x) for x in v], best[i], []) for i, v in zip(qi, q)],
                                   "requirement_id string, vec array<float>, floor double, cells array<int>")
    within = ivf.cells_within(probes, centres, reach)
    wanted = {r["requirement_id"]: set(r["cells"]) for r in within.collect()}
    cell_of = {r["employee_id"]: r["cell"] for r in celled.collect()}
    for r in brute_force(qi, q, ii, it, 5):
        assert cell_of[r[1]] in wanted[r[0]]
    shares = ivf.probed_share(within, reach).collect()
    sizes = reach[0]
    assert sizes.sum() == 300 and min(r["share"] for r in shares) < 1
    assert all(r["n_vectors"] == sum(sizes[c] for c in wanted[r["requirement_id"]]) and r["n_cells"] == len(wanted[r["requirement_id"]]) for r in shares)


def assigned(vectors, centres):
    sims = np.floor(vectors.astype(np.float32).astype(float) @ centres.T * 1e9 + 0.5) / 1e9
    return sims.argmax(axis=1)


@pytest.mark.parametrize("case", ["spread", "copies", "opposite", "exactly"])
def test_every_cell_is_filled_and_centred(spark, case):
    rng = np.random.default_rng(11)
    nlist = 6
    if case == "spread":
        v = unit(rng, 200, 5)
    elif case == "copies":  # almost all rows are one vector
        v = np.concatenate([np.repeat(unit(rng, 1, 5), 300, axis=0), unit(rng, 7, 5)])
    elif case == "opposite":  # means may cancel out
        base = unit(rng, 4, 5)
        v = np.concatenate([base, -base, base])
    else:
        v = np.repeat(unit(rng, nlist, 5), [1, 50, 2, 1, 1, 9], axis=0)
    ids = [f"E{i:03d}" for i in range(len(v))]
    centres = ivf.train_centroids(frame(spark, "employee_id", ids, v), nlist, max_iter=100)
    cell = assigned(v, centres)
    assert sorted(set(cell)) == list(range(nlist))
    for c in range(nlist):
        mean = v[cell == c].astype(float).sum(axis=0)
        if np.linalg.norm(mean) > 1e-6:
            assert np.abs(mean / np.linalg.norm(mean) - centres[c]).max() < 1e-6
    other = ivf.train_centroids(frame(spark, "employee_id", ids, v, 7), nlist, max_iter=100)
    assert (centres == other).all()  # not a matter of partitioning


def test_rounds_may_run_out_before_a_cell_is_filled(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(unit(rng, 1, 4), 50, axis=0), unit(rng, 30, 4)])
    frame_ = frame(spark, "employee_id", [f"E{i:03d}" for i in range(80)], v)
    for rounds in (0, 1, 2):
        assert len(set(assigned(v, ivf.train_centroids(frame_, 25, max_iter=rounds)))) == 25


def test_too_few_directions(spark):
    rows_ = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [0.0, 1.0])]
    few = spark.createDataFrame(rows_, "employee_id string, vec array<float>")
    assert len(ivf.train_centroids(few, 2)) == 2
    with pytest.raises(ValueError, match="2 distinct vectors cannot train 3 cells"):
        ivf.train_centroids(few, 3)
    assert len(ivf.train_centroids(few, 3, at_most=True)) == 2
    close = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1e-20]), ("c", [1.0, 2e-20])], "employee_id string, vec array<float>")
    with pytest.raises(ValueError, match="too close"):
        ivf.train_centroids(close, 2)
    assert len(ivf.train_centroids(close, 2, at_most=True)) == 1
    with pytest.raises(ValueError, match="0 distinct vectors"):
        ivf.train_centroids(few.where("employee_id = 'c'"), 1)


def test_zero_vector_stays_zero(spark):
    from pyspark.sql import functions as F

    from staffmatch.functions import vectors as vx

    frame_ = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "vec array<float>")
    got = [r[0] for r in frame_.select(vx.l2_normalize(F.col("vec"))).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_vector_id_is_the_known_hash(spark):
    from pyspark.sql import functions as F

    from staffmatch.functions import vectors as vx

    assert spark.range(1).select(vx.vector_id(F.lit("worker-1"))).first()[0] == int(hashlib.sha256(b"worker-1").hexdigest()[:15], 16)


def shipped_items(spark, monkeypatch, queries, items, **more):
    """Item rows that reach the co-grouped tasks of the grid."""
    import pyarrow as pa

    from staffmatch.operators import knn

    def counting(*args):
        def run(queries, items):
            return pa.table({"requirement_id": ["x"], "employee_id": ["x"], "similarity": [float(items.num_rows)]})
        return run

    monkeypatch.setattr(knn, "_grid_task", counting)
    found = knn._grid_plan(queries, items, 5, "cells" in queries.columns, KnnOptions(plan="grid", block_rows=5), 8, True, **more)
    return sum(r["similarity"] for r in found.collect())


def test_the_grid_ships_an_item_once_per_stripe_not_once_per_block(spark, data, monkeypatch):
    qi, q, ii, it = data
    queries = frame(spark, "requirement_id", qi, q).selectExpr("*", "double('-inf') AS floor")
    assert shipped_items(spark, monkeypatch, queries, frame(spark, "employee_id", ii, it)) == 300


def test_the_grid_ships_an_item_of_a_cell_once(spark, data, monkeypatch):
    qi, q, ii, it = data
    items = frame(spark, "employee_id", ii, it)
    centres = ivf.train_centroids(items, 6)
    queries = ivf.probe_cells(frame(spark, "requirement_id", qi, q), centres, 99).selectExpr("*", "double('-inf') AS floor")
    assert shipped_items(spark, monkeypatch, queries, ivf.assign_cells(items, centres)) == 300


def test_many_blocks_share_few_scans_of_items_made_once(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    from staffmatch.operators import knn

    qi, q, ii, it = data
    calls, scans, scan = spark.sparkContext.accumulator(0), [], knn._broadcast_plan

    def watched(*args):
        scans.append(args[0])
        return scan(*args)

    @F.udf("array<float>")
    def made(v):
        calls.add(1)
        return v

    monkeypatch.setattr(knn, "_broadcast_plan", watched)
    items = frame(spark, "employee_id", ii, it).select("employee_id", made("vec").alias("vec"))
    got = top_k(frame(spark, "requirement_id", qi, q), items, 5, options=KnnOptions(plan="blocks", broadcast_bytes=100))
    assert rows(got) == brute_force(qi, q, ii, it, 5)
    assert len(scans) <= 8 and calls.value == 300


def test_many_requirements_spread_items_that_lie_in_one_partition(spark, data):
    _, _, ii, it = data
    rng = np.random.default_rng(8)
    q, qi = unit(rng, 300, 8), [f"R{i:03d}" for i in range(300)]
    got = top_k(frame(spark, "requirement_id", qi, q), frame(spark, "employee_id", ii, it, 1), 5)
    assert len(got.inputFiles()) >= 4
    assert rows(got) == brute_force(qi, q, ii, it, 5)


@pytest.mark.parametrize("dim, size", [(8, 1.0), (64, 1.0), (3, 1e-3), (5, 40.0), (2, 1e25)])
def test_single_precision_only_leaves_out(dim, size):
    """Near equal vectors and copies, vectors of other lengths: the kernel gives what double precision gives."""
    import pyarrow as pa

    from staffmatch.operators import knn

    rng = np.random.default_rng(dim)
    base = unit(rng, 40, dim)
    v = np.concatenate([base, base, base + rng.normal(size=base.shape) * 1e-6, unit(rng, 3000, dim)]).astype(np.float32) * np.float32(size)
    q = np.concatenate([base[:20], unit(rng, 20, dim)]).astype(np.float32)
    ids, names = [f"E{i:05d}" for i in rng.permutation(len(v))], [f"R{i}" for i in range(len(q))]
    table = pa.table({"employee_id": ids, "vec": pa.array(v.tolist(), pa.list_(pa.float32()))})
    item_ids, groups = knn._by_cell(table, dim, False)
    side = knn._Side(np.array(names, dtype=object), q, np.full(len(q), -np.inf), None)
    got = [r for b in knn._search(side, groups, item_ids, 30, 100) for r in b.to_pylist()]
    sims = np.floor(np.einsum("ij,kj->ik", q.astype(float), v.astype(float)) * 1e9 + 0.5) / 1e9
    assert len(got) == 30 * len(q)
    for i, name in enumerate(names):
        mine = sorted((-r["similarity"], r["employee_id"]) for r in got if r["requirement_id"] == name)
        want = sorted(zip(-sims[i], ids))[:30]
        assert np.allclose([m[0] for m in mine], [w[0] for w in want], rtol=1e-12, atol=2e-9)
        assert size != 1.0 or [m[1] for m in mine] == [w[1] for w in want]


def test_few_similarities_are_computed_twice_and_ties_within_the_error_are_kept(monkeypatch):
    from staffmatch.operators import knn

    rng = np.random.default_rng(11)
    queries, many, k = unit(rng, 40, 16), unit(rng, 30_000, 16), 10
    seen, add = [], knn._Best.add

    def counted(self, rows, sims, place, group, at):
        seen.append(len(rows))
        add(self, rows, sims, place, group, at)

    monkeypatch.setattr(knn._Best, "add", counted)
    near = np.repeat(many[:1], 3000, axis=0) + rng.normal(size=(3000, 16)).astype(np.float32) * np.float32(1e-8)
    rising = many[np.argsort(many @ queries[0])]
    for items, most in ((many, 2 * k), (rising, 2 * k), (near, None)):
        seen.clear()
        names, wanted = [f"E{i:05d}" for i in range(len(items))], [f"R{i:02d}" for i in range(len(queries))]
        table = pa.table({"employee_id": names, "vec": pa.array(list(items), type=pa.list_(pa.float32()))})
        ids, groups = knn._by_cell(table, 16, False)
        side = knn._Side(np.array(wanted, dtype=object), queries, np.full(len(queries), -np.inf), None)
        got = sorted((r["requirement_id"], r["employee_id"], r["similarity"]) for b in knn._search(side, groups, ids, k) for r in b.to_pylist())
        assert got == sorted(r[:3] for r in brute_force(wanted, queries, names, items, k))
        assert most is None or sum(seen) < most * len(queries)


def test_copies_are_grouped_by_a_hash_first(spark):
    rows = [("E3", [0.0, 1.0]), ("E2", [-0.0, 1.0]), ("E1", [1.0, 0.0]), ("E5", [1.0, 0.0]), ("E4", [0.0, 0.0]), ("E6", None),
            ("E8", [float("nan"), 1.0]), ("E7", [float("nan"), 1.0])]
    found = ivf.group_copies(spark.createDataFrame(rows, "employee_id string, vec array<float>"))
    assert sorted((r["first_id"], r["n"]) for r in found.collect()) == [("E1", 2), ("E2", 2), ("E7", 2)]
    assert found.columns == ["vec", "n", "first_id"]
    assert "Aggregate [xxhash64(vec" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["broadcast", "broadcast seeded", "blocks", "cells"])
def test_a_task_compares_a_bounded_number_of_pairs(spark, data, monkeypatch, name):
    from pyspark.sql import functions as F

    from staffmatch.operators import knn

    _, _, ii, it = data
    rng = np.random.default_rng(8)
    q, qi = unit(rng, 300, 8), [f"R{i:03d}" for i in range(300)]
    calls, taken, task = spark.sparkContext.accumulator(0), [], knn._scan_task

    def watched(shared, *args):
        taken.append(sum(len(block.value[0]) for block in shared))
        return task(shared, *args)

    @F.udf("array<float>")
    def made(v):
        calls.add(1)
        return v

    monkeypatch.setattr(knn, "_scan_task", watched)
    monkeypatch.setattr(knn, "_TASK_PAIRS", 5_000, raising=False)  # 300 x 300 pairs, four files: 22,500 of them in each
    queries = frame(spark, "requirement_id", qi, q)
    items = frame(spark, "employee_id", ii, it).select("employee_id", made("vec").alias("vec"))
    if name == "cells":  # every requirement probes both cells
        items = items.withColumn("cell", F.when(F.col("employee_id") < "E050", 0).otherwise(1))
        queries = queries.withColumn("cells", F.array(F.lit(0), F.lit(1)))
    got = top_k(queries, items, 5, cells=name == "cells", options=PLANS.get(name, KnnOptions()))
    assert rows(got) == brute_force(qi, q, ii, it, 5)
    assert max(taken) <= (200 if "seeded" in name else 60) and calls.value == 300  # a sample of 30 % takes 200 at once


@pytest.mark.parametrize("case", ["long along few directions", "any directions", "cells"])
def test_the_shorter_product_only_leaves_out(monkeypatch, case):
    from staffmatch.operators import knn

    gains, cells = [], case == "cells"

    class Noted(knn._Gain):
        def __init__(self):
            super().__init__()
            gains.append(self)

    monkeypatch.setattr(knn, "_Gain", Noted)
    if case == "any directions":
        monkeypatch.setattr(knn, "_HEAD_TRIAL", 1 << 19)
    rng = np.random.default_rng(11)

    def made(n):
        v = rng.normal(size=(n, 128))
        if case != "any directions":
            v[:, 6:] *= 0.02
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)

    items, queries = made(9000), made(600)
    items[3000:3300] = items[7]  # copies, and a zero vector
    items[50] = 0
    ids = pa.array([f"E{i:05d}" for i in range(len(items))])
    names = np.array([f"R{i:03d}" for i in range(len(queries))], dtype=object)
    cell = np.arange(len(items)) % 3 if cells else np.zeros(len(items), dtype=int)
    groups = [knn._Items(int(c) if cells else None, np.flatnonzero(cell == c), items[cell == c]) for c in np.unique(cell)]
    probes = {c: np.arange(len(queries)) for c in range(3)} if cells else None
    side = knn._Side(names, queries, np.full(len(queries), -np.inf), probes)
    got = sorted(tuple(r.values()) for b in knn._search(side, groups, ids, 20) for r in b.to_pylist())
    assert got == [r[:3] for r in sorted(brute_force(names, queries, ids.to_pylist(), items, 20), key=lambda r: (r[0], r[1], r[2]))]
    assert len(gains) == 1 and gains[0].pairs and gains[0].pays == (case != "any directions") == (2 * gains[0].cost < gains[0].pairs)
