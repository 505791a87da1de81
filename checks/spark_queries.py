"""The registered queries: every operator over the whole staffing view of the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staffmatch.functions import numeric as nm
from staffmatch.functions import text as tx
from staffmatch.functions import vectors as vx
from staffmatch.operators import ivf
from staffmatch.operators import profiles as pf
from staffmatch.operators import sync as sy
from staffmatch.operators.encode import BatchEncoder, HashingEncoder, LookupEncoder, encode_requirements
from staffmatch.operators.knn import KnnOptions
from staffmatch.operators.scoring import score_pairs
from staffmatch.plans import embeddings as eb
from staffmatch.plans import indexes as ix
from staffmatch.plans.explain import attach_explanations, explanation_prompts
from staffmatch.plans.match import candidates, match, rank_pairs
from staffmatch.plans.results import requirement_results
from staffmatch.schemas import EMPLOYEE_SKILL, REGISTRY
from staffmatch.sources import staffing as st
from staffmatch.sources.employees import read_employee_csv, read_snapshot, save_snapshot, typed_employees
from staffmatch.sources.requirements import parse_requirements, read_requirement_texts, split_by_weights
from staffmatch.sources.tables import TableStore, work_folder
from staffmatch.streaming.requirements import read_matches, read_reply_stream, stream_matches
from staffmatch.streaming.snapshots import read_manifest_stream, stream_sync

GRID = KnnOptions(plan="grid", block_rows=256, seed_fraction=0.2)
WEIGHTS = {"mandatory": 0.25, "skill_exp": 0.25, "domain": 0.4, "experience": 0.1}


# ---- shared parts --------------------------------------------------------------------------

def _profiles(spark, sf, with_text=False):
    return pf.build_profiles(st.employees(spark, sf, with_text), with_text=with_text)


def _pairs(spark, sf):
    return candidates(st.requirements(spark, sf), st.active_vectors(spark, sf))


def _scored(spark, sf, **kw):
    return score_pairs(_pairs(spark, sf), _profiles(spark, sf), st.requirements(spark, sf, False), **kw)


def _flat_match(matches: DataFrame) -> DataFrame:
    return matches.withColumn("skills", F.array_join("skills", "|"))


def _score(name):
    return lambda spark, sf: _scored(spark, sf).select("requirement_id", "employee_id", name)


CELLS = 20


def _table_centroids(spark, sf) -> np.ndarray:
    """Cell centres from every vector of the table: the mean per ``vec_id % 20``, at unit length.

    Components are summed on a grid of 1e-9 as whole numbers, so that any engine gets the same means.
    """
    parts = st.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % CELLS).alias("cell"), F.posexplode("embedding").alias("pos", "x"))
    sums = parts.groupBy("cell", "pos").agg(
        F.sum(F.floor(F.col("x").cast("double") * 1e9 + 0.5)).alias("total"), F.count("*").alias("n")).orderBy("cell", "pos").collect()
    means = np.array([r["total"] / r["n"] for r in sums]).reshape(CELLS, -1)
    return means / np.sqrt((means * means).sum(axis=1, keepdims=True))


# ---- ingest and profiles -------------------------------------------------------------------

def _untyped(spark, sf):
    """The employee rows as text columns; accounts in the red get a value that is not a number."""
    rows = st.employees(spark, sf, summaries=False)
    debtors = st.table(spark, sf, "customer").where("c_acctbal < 0").select(
        st.employee_id(F.col("c_custkey")).alias("employee_id"), F.lit(True).alias("in_red")
    )
    as_text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    broken = F.when(F.col("in_red"), F.lit("unknown")).otherwise(F.col("total_experience_years"))
    return as_text.join(debtors, "employee_id", "left").withColumn("total_experience_years", broken).drop("in_red")


def ingest_clean(spark, sf):
    clean, _ = typed_employees(_untyped(spark, sf))
    return clean.drop("past_project_execution_summary")


def ingest_quarantine(spark, sf):
    _, bad = typed_employees(_untyped(spark, sf))
    return bad.select("employee_id", "row_seq", "skill", "reason")


def snapshot_roundtrip(spark, sf):
    store = TableStore(spark, work_folder(spark))
    clean, _ = typed_employees(_untyped(spark, sf))
    save_snapshot(store, clean)
    return read_snapshot(store).drop("past_project_execution_summary")


def csv_load(spark, sf):
    """Employee rows through CSV files in the order of their names: quotes, line breaks, a nameless column, and
    every reason to set a row aside."""
    rows = st.employees(spark, sf, False).withColumn("k", F.substring("employee_id", 4, 12).cast("bigint"))
    k, text = F.col("k"), lambda c: F.col(c).cast("string")
    table = rows.select(
        "row_seq", F.monotonically_increasing_id().alias("Unnamed: 0"),
        F.when(k % 19 != 3, F.col("employee_id")).alias("employee_id"),
        F.concat("employee_name", F.lit(' "of"\ntwo, lines')).alias("employee_name"), "domain",
        F.when(k % 17 != 5, text("domain_experience_years")).otherwise("some").alias("domain_experience_years"),
        F.when(k % 23 != 7, text("total_experience_years")).otherwise("NaN").alias("total_experience_years"),
        F.when(k % 31 != 2, text("current_bandwidth_percent")).alias("current_bandwidth_percent"),
        "skill", "skill_category",
        F.when(k % 29 != 1, text("skill_experience_years")).otherwise("").alias("skill_experience_years"),
        text("k").alias("source_key"))
    folder = f"{work_folder(spark)}/csv"
    # Spaces around a skill are part of it; a header in every file; files are numbered in row order.
    (table.repartitionByRange(3, "row_seq").sortWithinPartitions("row_seq").drop("row_seq")
     .write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder))
    raw = read_employee_csv(spark, folder)
    if raw.columns.count("row_seq") != 1 or any(c.startswith("Unnamed") for c in raw.columns):
        raise ValueError(f"unexpected columns {raw.columns}")
    # The key goes along in a text column that ingest keeps.
    clean, bad = typed_employees(raw.withColumn("past_project_execution_summary", F.col("source_key")))
    both = clean.withColumn("reason", F.lit("")).unionByName(bad)
    place = F.row_number().over(W.partitionBy("past_project_execution_summary").orderBy("row_seq"))
    return both.select(F.coalesce("employee_id", F.lit("")).alias("employee_id"), "employee_name", "skill", "skill_category", "reason", place.cast("bigint").alias("place"))


def csv_load_split(spark, sf):
    """The same rows without line breaks, from several files that are split into many tasks and carry no order column."""
    rows = st.employees(spark, sf, False).withColumn("source_key", F.substring("employee_id", 4, 12).cast("bigint").cast("string"))
    table = rows.select("row_seq", "employee_id", "employee_name", "domain", "domain_experience_years", "total_experience_years",
                        "current_bandwidth_percent", "skill", "skill_category", "skill_experience_years", "source_key")
    folder = work_folder(spark)
    (table.repartitionByRange(3, "row_seq").sortWithinPartitions("row_seq").drop("row_seq")
     .write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/csv"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        raw = read_employee_csv(spark, f"{folder}/csv", multi_line=False)
        clean, _ = typed_employees(raw.withColumn("past_project_execution_summary", F.col("source_key")))
        clean.write.parquet(f"{folder}/loaded")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    loaded = spark.read.parquet(f"{folder}/loaded")
    numbered = pf.number_rows(loaded.withColumnRenamed("row_seq", "at"), "employee_id", ["at"], F.shiftright("at", 14))
    return numbered.select("employee_id", "employee_name", "skill", "skill_category", F.col("at").alias("place"), F.col("row_seq").alias("own_place"))


def requirement_files(spark, sf):
    """Requirement texts written as files, one each, and read back."""
    folder = f"{work_folder(spark)}/texts"
    texts = st.requirements(spark, sf, False).select("requirement_id", tx.requirement_display_text().alias("value"))
    texts.repartition("requirement_id").write.partitionBy("requirement_id").text(folder)
    return read_requirement_texts(spark, folder).select("requirement_text")


def employee_header(spark, sf):
    return pf.employee_headers(st.employees(spark, sf))


def employee_skill_list(spark, sf):
    return _profiles(spark, sf).select("employee_id", F.array_join("skills", "|").alias("skills"))


def employee_skill_years(spark, sf):
    return pf.skill_years(st.employees(spark, sf, False))


def employee_skill_lines(spark, sf):
    return pf.skill_first_lines(st.employees(spark, sf, False)).select(
        "employee_id", "skill_key", tx.skill_line(F.col("skill"), F.col("category"), F.col("years")).alias("line")
    )


def employee_row_order(spark, sf):
    """Dense order of an employee's rows; chunks of 16,384 orders share out large employees."""
    rows = st.employees(spark, sf, False).select("employee_id", F.col("row_seq").alias("source_order"))
    chunk = F.shiftright("source_order", 37)
    return pf.number_rows(rows, "employee_id", ["source_order"], chunk)


def profile_text(spark, sf):
    return _profiles(spark, sf, True).select("employee_id", "profile_text")


def vector_ids(spark, sf):
    ids = st.active_ids(spark, sf)
    return ids.select("employee_id", vx.vector_id(F.col("employee_id")).alias("vector_id"))


# ---- requirements --------------------------------------------------------------------------

def _skills_text(column):
    years = lambda x: F.coalesce(tx.number_text(x["min_experience_years"]), F.lit("-"))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["skill"], x["category"], years(x))), "|")


def requirement_parsed(spark, sf):
    ok, _ = parse_requirements(st.requirement_replies(spark, sf))
    return ok.select(
        "requirement_id", "project_description", F.array_join("domain", "|").alias("domain"), "project_criticality",
        "project_duration_months", "required_bandwidth_percentage", "minimum_overall_experience_years",
        _skills_text("mandatory_skills").alias("mandatory"), _skills_text("optional_skills").alias("optional"),
    )


def requirement_errors(spark, sf):
    _, bad = parse_requirements(st.requirement_replies(spark, sf))
    return bad.select("requirement_id", "error")


def requirement_embedding_text(spark, sf):
    return st.requirements(spark, sf, False).select(
        "requirement_id", tx.requirement_embedding_text().alias("embedding_text"))


def requirement_display_text(spark, sf):
    return st.requirements(spark, sf, False).select(
        "requirement_id", tx.requirement_display_text().alias("display_text"))


# ---- sync ----------------------------------------------------------------------------------

def _office_snapshots(spark, sf):
    """Office 0 joins late, office 1 leaves and comes back, the last snapshot is repeated."""
    people = st.active_ids(spark, sf).join(
        st.table(spark, sf, "customer").select(st.employee_id(F.col("c_custkey")).alias("employee_id"), "c_nationkey"),
        "employee_id",
    )
    return [people.where("c_nationkey <> 0"), people.where("c_nationkey <> 1"), people, people]


def _registry_chain(spark, sf, steps=4):
    """Staged registries after each snapshot; every step is a written table."""
    store = TableStore(spark, work_folder(spark))
    registry, chain = spark.createDataFrame([], REGISTRY), []
    for version, ids in enumerate(_office_snapshots(spark, sf)[:steps], start=1):
        labels = sy.label_ids(ids.select("employee_id"), registry)
        registry = store.stage("registry", version, sy.next_registry(labels, st.MODEL, version))
        chain.append(registry)
    return chain


def sync_labels(spark, sf):
    steps = [r.select(F.lit(i).alias("step"), "employee_id", "action", "is_active")
             for i, r in enumerate(_registry_chain(spark, sf), start=1)]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def registry_after_sync(spark, sf):
    """After the second snapshot: some joined, some left, the rest stayed."""
    return _registry_chain(spark, sf, 2)[1].select("employee_id", "vector_id", "vector_version", "is_active")


def registry_active(spark, sf):
    return _registry_chain(spark, sf, 2)[1].where("is_active").select("employee_id", "vector_id")


def vector_id_conflicts(spark, sf):
    """Ids from an id function that leaves the last digit out, as the sync would refuse them."""
    labels = sy.label_ids(st.active_ids(spark, sf).select("employee_id"), spark.createDataFrame([], REGISTRY))
    return sy.id_conflicts(sy.next_registry(labels, st.MODEL, 1, lambda c: F.substring(c, 4, 11).cast("bigint")))


def sync_detect_changes(spark, sf):
    """Office 2 changes its domain, the rows of office 3 come in the opposite order, office 4 has other capacity, office 5
    moves to other places of the file: what the second run says about everybody."""
    folder = work_folder(spark)
    store, people = TableStore(spark, f"{folder}/store"), _office_people(spark, sf)
    encoder = LookupEncoder(st.MODEL, st.active_vectors(spark, sf))
    eb.sync_embeddings(store, people, encoder, detect_changes=True)
    office = F.col("c_nationkey")
    later = people.select(
        "employee_id", F.when(office == 3, -F.col("row_seq")).when(office == 5, F.col("row_seq") + 12345).otherwise(F.col("row_seq")).alias("row_seq"),
        F.when(office == 2, F.lit("NEW")).otherwise(F.col("domain")).alias("domain"),
        F.when(office == 4, F.lit(1.0)).otherwise(F.col("current_bandwidth_percent")).alias("current_bandwidth_percent"),
        *[c for c in EMPLOYEE_SKILL.fieldNames() if c not in ("employee_id", "row_seq", "domain", "current_bandwidth_percent")])
    eb.sync_embeddings(store, later, encoder, detect_changes=True)
    return eb.read_registry(store, st.MODEL).select("employee_id", "action", "vector_version")


def sync_summary(spark, sf):
    rows = [sy.summarize(r).select(F.lit(i).alias("step"), "*")
            for i, r in enumerate(_registry_chain(spark, sf), start=1)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ---- vectors -------------------------------------------------------------------------------

def vectors_normalized(spark, sf):
    tripled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    rows = st.table(spark, sf, "embeddings").select("vec_id", vx.l2_normalize(tripled).alias("vec"))
    return rows.select(
        "vec_id",
        nm.round_half_up(vx.l2_norm(F.col("vec")), 4).alias("norm"),
        F.array_join(F.transform("vec", lambda x: F.floor(x.cast("double") * 10000.0 + 0.5).cast("string")), " ").alias("components"),
    )


def pair_similarity(spark, sf):
    """Inner product of vectors paired by key: each requirement with the employee of the same number."""
    people = st.employee_vectors(spark, sf).withColumnRenamed("vec", "employee_vec")
    wanted = st.requirements(spark, sf).withColumn("employee_id", st.employee_id(F.col("s")))
    return wanted.join(people, "employee_id").select(
        "requirement_id", "employee_id",
        nm.round_half_up(vx.inner_product(F.col("vec"), F.col("employee_vec")), 4).alias("similarity"),
    )


def _knn_columns(df):
    return df.select("requirement_id", "employee_id", "candidate_rank",
                     nm.round_half_up(F.col("similarity"), 4).alias("similarity"))


def knn_exact(spark, sf):
    return _knn_columns(_pairs(spark, sf))


def knn_exact_grid(spark, sf):
    return _knn_columns(candidates(st.requirements(spark, sf), st.active_vectors(spark, sf), options=GRID))


def knn_exact_blocks(spark, sf):
    """Requirements beyond the broadcast bound: block by block over an item scan that is never shuffled."""
    options = KnnOptions(plan="blocks", broadcast_bytes=64_000)
    return _knn_columns(candidates(st.requirements(spark, sf), st.active_vectors(spark, sf), options=options))


def ivf_train(spark, sf):
    """Centroids after three rounds over the distinct vectors, and how many vectors each then holds."""
    vectors = st.active_vectors(spark, sf)
    centroids = ivf.train_centroids(vectors, CELLS, seed=7, max_iter=3)
    sizes = ivf.assign_cells(vectors, centroids).groupBy("cell").agg(F.count("*").alias("n"))
    parts = ivf.centroid_table(spark, centroids).select("cell", F.posexplode("centroid").alias("pos", "x"))
    return parts.join(sizes, "cell").select(
        F.col("cell").cast("bigint").alias("cell"), "n", (F.col("pos") + 1).cast("bigint").alias("pos"),
        nm.round_half_up(F.col("x"), 6).alias("x"))


def _trained_index(spark, sf):
    store = TableStore(spark, work_folder(spark))
    vectors = st.active_vectors(spark, sf)
    employees = st.employees(spark, sf, False).join(vectors.select("employee_id"), "employee_id", "left_semi")
    eb.sync_embeddings(store, employees, LookupEncoder(st.MODEL, vectors))
    ix.create_index(store, "cells", st.MODEL, "ivf", nlist=CELLS, nprobe=2)
    return store, ix.index_row(store, "cells")


def ivf_exact_probe(spark, sf):
    """Two cells first, then those whose stored bounds can still hold a candidate: the exact result."""
    store, row = _trained_index(spark, sf)
    centroids, reach = ix.index_centroids(store, row), ix.index_reach(store, row)
    return _knn_columns(candidates(
        st.requirements(spark, sf), ix.index_vectors(store, row), centroids=centroids, nprobe=row["nprobe"],
        reach=ivf.read_reach(reach, len(centroids)), cell_sizes=reach.select("cell", "n")))


def index_pairing(spark, sf):
    """Office 0 has no vectors, office 1 is not registered, office 2 has short vectors."""
    people = st.active_vectors(spark, sf).select("employee_id", "vec").join(
        _office_people(spark, sf).select("employee_id", "c_nationkey").distinct(), "employee_id")
    registry = people.where("c_nationkey <> 1").select("employee_id", F.lit(1).cast("bigint").alias("vector_version"), F.lit(True).alias("is_active"))
    held = people.where("c_nationkey <> 0").select("employee_id", F.lit(1).cast("bigint").alias("version"), F.when(
        F.col("c_nationkey") == 2, F.slice("vec", 1, 3)).otherwise(F.col("vec")).alias("vec"))
    report = sy.pair_report(held, registry)
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in report.items()])


def ivf_cells(spark, sf):
    cells = ivf.assign_cells(st.active_vectors(spark, sf), _table_centroids(spark, sf))
    return cells.select("employee_id", F.col("cell").cast("bigint").alias("cell"))


def ivf_probes(spark, sf):
    probes = ivf.probe_cells(st.requirements(spark, sf), _table_centroids(spark, sf), 10)
    return probes.select("requirement_id", F.posexplode("cells").alias("position", "cell")).select(
        "requirement_id", (F.col("position") + 1).cast("bigint").alias("position"), F.col("cell").cast("bigint").alias("cell")
    )


def _ivf(spark, sf, options=KnnOptions()):
    centroids = _table_centroids(spark, sf)
    cells = ivf.assign_cells(st.active_vectors(spark, sf), centroids)
    return _knn_columns(candidates(st.requirements(spark, sf), cells, centroids=centroids, nprobe=10, options=options))


def ivf_search(spark, sf):
    return _ivf(spark, sf)


def ivf_search_grid(spark, sf):
    return _ivf(spark, sf, GRID)


def ivf_full_probe_equals_exact(spark, sf):
    vectors = st.active_vectors(spark, sf)
    centroids = ivf.train_centroids(vectors, CELLS)
    cells = ivf.assign_cells(vectors, centroids)
    return _knn_columns(candidates(st.requirements(spark, sf), cells, centroids=centroids, nprobe=20))


def index_append_missing(spark, sf):
    """Vectors an index made before office 0 joined does not hold, with their cells under its centroids."""
    vectors = st.active_vectors(spark, sf).withColumn("version", F.lit(1).cast("bigint"))
    indexed = vectors.join(_office_snapshots(spark, sf)[0].select("employee_id"), "employee_id", "left_semi")
    missing = ix.missing_vectors(vectors, indexed)
    return ivf.assign_cells(missing, _table_centroids(spark, sf)).select(
        "employee_id", F.col("cell").cast("bigint").alias("cell"))


def _filled_store(spark, sf):
    """A store with synced table vectors and two indexes."""
    store = TableStore(spark, work_folder(spark))
    vectors = st.active_vectors(spark, sf)
    employees = st.employees(spark, sf, False).join(vectors.select("employee_id"), "employee_id", "left_semi")
    eb.sync_embeddings(store, employees, LookupEncoder(st.MODEL, vectors))
    ix.create_index(store, "all", st.MODEL, "exact")
    ix.create_index(store, "cells", st.MODEL, "ivf", centroids=_table_centroids(spark, sf), nprobe=20)
    return store


def index_catalog(spark, sf):
    return ix.read_catalog(_filled_store(spark, sf)).select(
        "index_name", "index_type", "model", "dim", "nlist", "nprobe", "vector_count")


def embedding_sets(spark, sf):
    return eb.embedding_sets(_filled_store(spark, sf))


def stored_index_match(spark, sf):
    store = _filled_store(spark, sf)
    return _flat_match(ix.search_index(store, "cells", st.requirements(spark, sf), _profiles(spark, sf), model=st.MODEL))


class _DyingStore(TableStore):
    """A store whose run ends right before it publishes."""

    def publish(self, name, version):
        raise RuntimeError("the run ends here")


def _office_people(spark, sf):
    people = st.employees(spark, sf, False).join(st.active_vectors(spark, sf).select("employee_id"), "employee_id", "left_semi")
    offices = st.table(spark, sf, "customer").select(st.employee_id(F.col("c_custkey")).alias("employee_id"), "c_nationkey")
    return people.join(offices, "employee_id")


def sync_after_failure(spark, sf):
    """Office 0 joins in a run that dies; then office 1 leaves; then both are there. Live vectors per person."""
    folder = work_folder(spark)
    store, people = TableStore(spark, f"{folder}/store"), _office_people(spark, sf)
    encoder = LookupEncoder(st.MODEL, st.active_vectors(spark, sf))
    eb.sync_embeddings(store, people.where("c_nationkey <> 0"), encoder)
    try:
        eb.sync_embeddings(_DyingStore(spark, store.root), people, encoder)
    except RuntimeError:
        pass
    seen = None
    for step, rows in ((2, people.where("c_nationkey NOT IN (0, 1)")), (3, people)):
        eb.sync_embeddings(store, rows, encoder)
        live = eb.read_vectors(store, st.MODEL).groupBy("employee_id").agg(F.count("*").alias("vectors"))
        live.select(F.lit(step).alias("step"), "*").write.parquet(f"{folder}/step-{step}")
        part = spark.read.parquet(f"{folder}/step-{step}")
        seen = part if seen is None else seen.unionByName(part)
    return seen


def _two_indexes(store, spark, sf):
    ix.create_index(store, "all", st.MODEL, "exact")
    ix.create_index(store, "cells", st.MODEL, "ivf", centroids=_table_centroids(spark, sf), nprobe=20)


def _members(store, folder, step, *columns):
    """What both indexes find, written down, with the total in the catalog."""
    out = None
    for name in ("all", "cells"):
        row = ix.index_row(store, name)
        part = ix.index_vectors(store, row).select(
            F.lit(step).alias("step"), F.lit(name).alias("index_name"), "employee_id", *columns,
            F.lit(row["vector_count"]).cast("bigint").alias("stored_total"), F.lit(row["nlist"]).alias("nlist"))
        out = part if out is None else out.unionByName(part)
    out.write.parquet(f"{folder}/{step}")
    return store.spark.read.parquet(f"{folder}/{step}")


def _appended_store(spark, sf):
    """Both indexes without office 0; then office 0 joins, office 1 leaves, and the indexes are appended to."""
    folder = work_folder(spark)
    store, people = TableStore(spark, f"{folder}/store"), _office_people(spark, sf)
    encoder = LookupEncoder(st.MODEL, st.active_vectors(spark, sf))
    eb.sync_embeddings(store, people.where("c_nationkey <> 0"), encoder)
    _two_indexes(store, spark, sf)
    eb.sync_embeddings(store, people.where("c_nationkey <> 1"), encoder)
    before = _members(store, folder, "before")
    for name in ("all", "cells"):
        ix.append_index(store, name)
    return store, folder, before


def index_after_append(spark, sf):
    store, folder, before = _appended_store(spark, sf)
    return before.unionByName(_members(store, folder, "after")).drop("nlist")


def index_after_rebuild(spark, sf):
    store, folder, _ = _appended_store(spark, sf)
    for name in ("all", "cells"):
        ix.append_index(store, name, rebuild=True)
    return _members(store, folder, "rebuilt").drop("step")


def index_after_drop(spark, sf):
    store, _, _ = _appended_store(spark, sf)
    ix.drop_index(store, "cells")
    return ix.read_catalog(store).select("index_name", "vector_count")


def index_after_change(spark, sf):
    """Office 2 changes its domain and gets turned vectors: the indexes serve the old ones until appended to."""
    folder = work_folder(spark)
    store, people, vectors = TableStore(spark, f"{folder}/store"), _office_people(spark, sf), st.active_vectors(spark, sf)
    moved = F.col("c_nationkey") == 2
    eb.sync_embeddings(store, people, LookupEncoder(st.MODEL, vectors), detect_changes=True)
    _two_indexes(store, spark, sf)
    turned = vectors.join(people.where(moved).select("employee_id").distinct().withColumn("moved", F.lit(True)), "employee_id", "left").withColumn(
        "vec", F.when(F.col("moved"), F.transform("vec", lambda x: -x)).otherwise(F.col("vec")))
    eb.sync_embeddings(store, people.withColumn("domain", F.when(moved, F.lit("NEW")).otherwise(F.col("domain"))),
                       LookupEncoder(st.MODEL, turned), detect_changes=True)
    first = nm.round_half_up(F.get("vec", F.lit(0)).cast("double"), 4).alias("first_component")
    before = _members(store, folder, "before", first)
    for name in ("all", "cells"):
        ix.append_index(store, name)
    return before.unionByName(_members(store, folder, "after", first)).drop("nlist")


def vectors_after_compaction(spark, sf):
    """Office 2 changes, office 1 leaves, the replaced vectors go; what is live and what the index finds afterwards."""
    folder = work_folder(spark)
    store, people, vectors = TableStore(spark, f"{folder}/store"), _office_people(spark, sf), st.active_vectors(spark, sf)
    moved = F.col("c_nationkey") == 2
    eb.sync_embeddings(store, people, LookupEncoder(st.MODEL, vectors), detect_changes=True)
    ix.create_index(store, "cells", st.MODEL, "ivf", centroids=_table_centroids(spark, sf), nprobe=20)
    turned = vectors.join(people.where(moved).select("employee_id").distinct().withColumn("moved", F.lit(True)), "employee_id", "left").withColumn(
        "vec", F.when(F.col("moved"), F.transform("vec", lambda x: -x)).otherwise(F.col("vec")))
    later = people.where("c_nationkey <> 1").withColumn("domain", F.when(moved, F.lit("NEW")).otherwise(F.col("domain")))
    eb.sync_embeddings(store, later, LookupEncoder(st.MODEL, turned), detect_changes=True)
    ix.append_index(store, "cells")
    done, index = eb.compact_vectors(store, st.MODEL), ix.compact_index(store, "cells")
    eb.delete_compacted(store, st.MODEL, retention_hours=0)
    live = eb.read_vectors(store, st.MODEL).select(F.lit("live").alias("what"), "employee_id", "vec")
    found = ix.index_vectors(store, ix.index_row(store, "cells")).select(F.lit("index").alias("what"), "employee_id", "vec")
    return live.unionByName(found).select(
        "what", "employee_id", nm.round_half_up(F.get("vec", F.lit(0)).cast("double"), 4).alias("first_component"),
        F.lit(done["kept"]).cast("bigint").alias("kept"), F.lit(done["dropped"]).cast("bigint").alias("dropped"),
        F.lit(index["dropped"]).cast("bigint").alias("index_dropped"))


def stored_index_probe(spark, sf):
    """Half of the cells of a stored index."""
    store = _filled_store(spark, sf)
    return _flat_match(ix.search_index(store, "cells", st.requirements(spark, sf), _profiles(spark, sf), model=st.MODEL, nprobe=10))


# ---- scores and matches --------------------------------------------------------------------

def final_rank(spark, sf):
    return rank_pairs(_scored(spark, sf)).select("requirement_id", "employee_id", "final_rank", "confidence", "rank")


def confidence_counts(spark, sf):
    return rank_pairs(_scored(spark, sf)).groupBy("confidence").agg(F.count("*").alias("pairs"))


def match_top_n(spark, sf):
    return _flat_match(match(st.requirements(spark, sf), _profiles(spark, sf), st.active_vectors(spark, sf)))


def match_top_100(spark, sf):
    """More matches than the default pool holds."""
    return _flat_match(match(st.requirements(spark, sf), _profiles(spark, sf), st.active_vectors(spark, sf), top_n=100))


def _with_weights(spark, sf):
    s = F.col("s")
    weights = F.when(s % 3 != 0, F.struct(
        F.when(s % 3 == 1, F.lit(0.5)).alias("mandatory"),
        F.lit(None).cast("double").alias("skill_exp"),
        (s % 5 / F.lit(3.0)).alias("domain"),
        F.lit(0.15).alias("experience"),
    ))
    return st.requirements(spark, sf).withColumn("weights", weights)


def match_top_n_weighted(spark, sf):
    """Weights per requirement: partly given, some out of range and set aside."""
    ok, _ = split_by_weights(_with_weights(spark, sf))
    return _flat_match(match(ok, _profiles(spark, sf), st.active_vectors(spark, sf), weights_column="weights"))


def weights_rejected(spark, sf):
    """Requirements whose own weights are out of range."""
    _, bad = split_by_weights(_with_weights(spark, sf))
    return bad.select("requirement_id", "error")


def match_skill_years(spark, sf):
    return _flat_match(match(st.requirements(spark, sf), _profiles(spark, sf), st.active_vectors(spark, sf),
                             WEIGHTS, use_skill_years=True, top_n=50))


def vector_id_lookup(spark, sf):
    """Candidates held as vector ids only, named again through the active registry rows."""
    people = st.active_vectors(spark, sf)
    hits = _pairs(spark, sf).join(people.select("employee_id", "vector_id"), "employee_id").drop("employee_id")
    registry = people.select("employee_id", "vector_id", F.lit(True).alias("is_active"))
    return sy.name_vector_ids(hits, registry).select("requirement_id", "employee_id", "vector_id")


def match_with_explanations(spark, sf):
    """Stored answers, here one short line per prompt, joined back to the first matches."""
    matches = match(st.requirements(spark, sf), _profiles(spark, sf), st.active_vectors(spark, sf), top_n=15)
    answers = matches.where("rank <= 10").select(
        "requirement_id", "employee_id", F.concat(F.lit("fit: "), "confidence").alias("explanation"))
    return attach_explanations(matches, answers).select("requirement_id", "employee_id", "rank", "explanation")


def requirement_result(spark, sf):
    """One row per requirement: its record, both texts, and the matches in order."""
    requirements = st.requirements(spark, sf)
    rows = requirement_results(requirements, match(requirements, _profiles(spark, sf), st.active_vectors(spark, sf), top_n=5))
    line = lambda r: F.concat_ws(":", r["rank"], r["employee_id"], F.format_string("%.4f", r["final_rank"]), r["confidence"])
    return rows.select("requirement_id", "record.project_description", "record.project_criticality", "display_text", "embedding_text",
                       "total_matches", F.array_join(F.transform("results", line), "|").alias("results"))


def explanations(spark, sf):
    requirements, profiles = st.requirements(spark, sf), _profiles(spark, sf, True)
    matches = match(requirements, profiles, st.active_vectors(spark, sf))
    return explanation_prompts(matches, profiles, requirements)


# ---- encoders and streams ------------------------------------------------------------------

def _encoded_candidates(spark, sf, encoder):
    """Every profile through the encoder into the store, every requirement against what is stored."""
    store = TableStore(spark, work_folder(spark))
    eb.sync_embeddings(store, st.employees(spark, sf), encoder)
    return _knn_columns(candidates(encode_requirements(st.requirements(spark, sf, False), encoder),
                                   eb.read_vectors(store, encoder.model)))


def encode_default(spark, sf):
    return _encoded_candidates(spark, sf, HashingEncoder(256))


def encode_batch(spark, sf):
    """A batch encoder of the caller, here the counts of the small letters a to z."""
    def load():
        import numpy

        return lambda texts: numpy.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], dtype=float)

    return _encoded_candidates(spark, sf, BatchEncoder("letters/26", 26, load))


def stream_match(spark, sf):
    """Replies arrive as files over several batches; the matches equal one batch match."""
    folder = work_folder(spark)
    st.requirement_replies(spark, sf).select("requirement_id", "raw").repartition(4, "requirement_id").write.json(f"{folder}/in")
    profiles = _profiles(spark, sf)
    profiles.write.parquet(f"{folder}/profiles")
    stored = spark.read.parquet(f"{folder}/profiles")
    vectors = st.active_vectors(spark, sf)
    requirement_vectors = st.requirements(spark, sf).select("requirement_id", "vec")

    def match_batch(requirements):
        return match(requirements.join(requirement_vectors, "requirement_id"), stored, vectors)

    query = stream_matches(read_reply_stream(spark, f"{folder}/in", 1), match_batch, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return _flat_match(read_matches(spark, f"{folder}/out").drop("batch_id"))


def stream_sync_query(spark, sf):
    """Three snapshots announced by manifests; the registry equals three sync runs."""
    folder = work_folder(spark)
    store, employees = TableStore(spark, f"{folder}/store"), st.employees(spark, sf, False)
    for version, ids in enumerate(_office_snapshots(spark, sf)[:3], start=1):
        path = f"{folder}/snapshot-{version}"
        rows = employees.join(ids.select("employee_id"), "employee_id", "left_semi")
        rows.select(*EMPLOYEE_SKILL.fieldNames()).write.parquet(path)
        manifest = spark.createDataFrame([(version, path)], "version bigint, path string")
        manifest.coalesce(1).write.mode("append").json(f"{folder}/manifests")
    encoder = HashingEncoder(64)
    stream_sync(read_manifest_stream(spark, f"{folder}/manifests"), store, encoder, f"{folder}/checkpoint").awaitTermination()
    return eb.read_registry(store, encoder.model).select("employee_id", "vector_id", "is_active")


QUERIES = {
    "ingest_clean": ingest_clean,
    "ingest_quarantine": ingest_quarantine,
    "snapshot_roundtrip": snapshot_roundtrip,
    "csv_load": csv_load,
    "csv_load_split": csv_load_split,
    "requirement_files": requirement_files,
    "employee_header": employee_header,
    "employee_skill_list": employee_skill_list,
    "employee_skill_years": employee_skill_years,
    "employee_skill_lines": employee_skill_lines,
    "employee_row_order": employee_row_order,
    "profile_text": profile_text,
    "vector_ids": vector_ids,
    "requirement_parsed": requirement_parsed,
    "requirement_errors": requirement_errors,
    "requirement_embedding_text": requirement_embedding_text,
    "requirement_display_text": requirement_display_text,
    "sync_labels": sync_labels,
    "registry_after_sync": registry_after_sync,
    "registry_active": registry_active,
    "sync_summary": sync_summary,
    "sync_detect_changes": sync_detect_changes,
    "vector_id_conflicts": vector_id_conflicts,
    "vector_id_lookup": vector_id_lookup,
    "vectors_normalized": vectors_normalized,
    "pair_similarity": pair_similarity,
    "knn_exact": knn_exact,
    "knn_exact_grid": knn_exact_grid,
    "knn_exact_blocks": knn_exact_blocks,
    "ivf_train": ivf_train,
    "ivf_exact_probe": ivf_exact_probe,
    "index_pairing": index_pairing,
    "ivf_cells": ivf_cells,
    "ivf_probes": ivf_probes,
    "ivf_search": ivf_search,
    "ivf_search_grid": ivf_search_grid,
    "ivf_full_probe_equals_exact": ivf_full_probe_equals_exact,
    "index_append_missing": index_append_missing,
    "index_catalog": index_catalog,
    "embedding_sets": embedding_sets,
    "stored_index_match": stored_index_match,
    "stored_index_probe": stored_index_probe,
    "vectors_after_compaction": vectors_after_compaction,
    "sync_after_failure": sync_after_failure,
    "index_after_append": index_after_append,
    "index_after_change": index_after_change,
    "index_after_rebuild": index_after_rebuild,
    "index_after_drop": index_after_drop,
    "skill_coverage": _score("skill_coverage"),
    "skill_experience": _score("skill_experience_score"),
    "domain_score": _score("domain_score"),
    "experience_score": _score("experience_score"),
    "technical_score": _score("technical_score"),
    "availability": _score("availability"),
    "rule_score": lambda spark, sf: _scored(spark, sf).select(
        "requirement_id", "employee_id", "rule_score", "calibrated_rule_score"),
    "final_rank": final_rank,
    "confidence_counts": confidence_counts,
    "match_top_n": match_top_n,
    "match_top_100": match_top_100,
    "match_top_n_weighted": match_top_n_weighted,
    "weights_rejected": weights_rejected,
    "match_skill_years": match_skill_years,
    "requirement_result": requirement_result,
    "explanation_prompts": explanations,
    "match_with_explanations": match_with_explanations,
    "encode_default": encode_default,
    "encode_batch": encode_batch,
    "stream_match": stream_match,
    "stream_sync": stream_sync_query,
}
