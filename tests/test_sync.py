import numpy as np
import pytest

from staffmatch.operators.encode import BatchEncoder, HashingEncoder, LookupEncoder
from staffmatch.operators.profiles import build_profiles
from staffmatch.plans import embeddings as eb
from staffmatch.plans import indexes as ix
from staffmatch.sources.tables import TableStore
from tests.helpers import employee_rows, employees, requirement, requirements

ENCODER = HashingEncoder(16)


def people(spark, *ids, domain="Web"):
    return employees(spark, *[employee_rows(i, [("Go", "L", 2.0), (f"Skill {i}", "L", 1.0)], domain=domain) for i in ids])


def counts(r):
    return r.new_count, r.deleted_count, r.reactivated_count, r.total_active, r.rebuild_indexes_required


def vectors(store, model=ENCODER.model, live_only=True):
    return {r["employee_id"]: (r["vec"], r["version"]) for r in eb.read_vectors(store, model, live_only).collect()}


def test_joining_leaving_and_returning(spark, store):
    assert counts(eb.sync_embeddings(store, people(spark, "1", "2", "3", "4"), ENCODER)) == (4, 0, 0, 4, False)
    first = vectors(store)
    # 3 left, 5 is new
    assert counts(eb.sync_embeddings(store, people(spark, "1", "2", "4", "5"), ENCODER)) == (1, 1, 0, 4, True)
    assert set(vectors(store)) == {"1", "2", "4", "5"} and set(vectors(store, live_only=False)) == {"1", "2", "3", "4", "5"}
    assert counts(eb.sync_embeddings(store, people(spark, "1", "2", "3", "4", "5"), ENCODER)) == (0, 0, 1, 5, True)
    assert vectors(store)["3"] == first["3"]
    before = store.current(eb.registry_name(ENCODER.model))
    again = eb.sync_embeddings(store, people(spark, "1", "2", "3", "4", "5"), ENCODER)
    assert counts(again) == (0, 0, 0, 5, False) and again.version == before == store.current(eb.registry_name(ENCODER.model))


def test_models_are_independent(spark, store):
    other = HashingEncoder(8)
    eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER)
    assert counts(eb.sync_embeddings(store, people(spark, "2", "3"), other)) == (2, 0, 0, 2, False)
    assert set(vectors(store)) == {"1", "2"} and set(vectors(store, other.model)) == {"2", "3"}
    assert [tuple(r) for r in eb.embedding_sets(store).collect()] == [("hashed-words-16", 2, 16), ("hashed-words-8", 2, 8)]


def test_changed_profiles_only_when_asked_for(spark, store):
    eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER, detect_changes=True)
    old = vectors(store)
    moved = people(spark, "1").unionByName(people(spark, "2", domain="Retail"))
    assert eb.sync_embeddings(store, moved, ENCODER).changed_count == 0
    result = eb.sync_embeddings(store, moved, ENCODER, detect_changes=True)
    assert result.changed_count == 1 and result.rebuild_indexes_required
    new = vectors(store)
    assert new["1"] == old["1"] and new["2"][0] != old["2"][0] and len(new) == 2


def test_failed_encoding_publishes_nothing_and_can_be_retried(spark, store):
    def load():
        def encode(texts):
            if any("Skill bad" in t for t in texts):
                raise RuntimeError("no vector for this text")
            return np.ones((len(texts), 4))
        return encode

    flaky = BatchEncoder("flaky", 4, load, batch_size=2)
    eb.sync_embeddings(store, people(spark, "1"), flaky)
    with pytest.raises(Exception, match="no vector for this text"):
        eb.sync_embeddings(store, people(spark, "1", "2", "bad"), flaky)
    assert set(vectors(store, "flaky")) == {"1"} and store.current(eb.registry_name("flaky")) == 1
    assert counts(eb.sync_embeddings(store, people(spark, "1", "2", "3"), flaky)) == (2, 0, 0, 3, False)
    got = vectors(store, "flaky", live_only=False)
    assert set(got) == {"1", "2", "3"} and got["2"][0] == [0.5] * 4


def test_encoders(spark):
    profiles = build_profiles(people(spark, "1", "2"))
    rows = profiles.selectExpr("employee_id", "profile_text AS text")
    first, second = (sorted(map(str, HashingEncoder(32).encode(r).collect())) for r in (rows, rows.repartition(5)))
    assert first == second
    wrong = BatchEncoder("wrong", 4, lambda: lambda texts: np.ones((len(texts), 3)))
    with pytest.raises(Exception, match="encoder gave shape"):
        wrong.encode(rows).collect()
    some = spark.createDataFrame([("1", [1.0])], "employee_id string, vec array<float>")
    with pytest.raises(Exception, match="no vector for 2"):
        LookupEncoder("m", some).encode(rows).collect()


@pytest.fixture
def filled(spark, store):
    ids = [f"{i:02d}" for i in range(30)]
    eb.sync_embeddings(store, people(spark, *ids), ENCODER)
    return store, ids


def found(df):
    return sorted((r["requirement_id"], r["rank"], r["employee_id"], r["final_rank"]) for r in df.collect())


def test_index_life_cycle(spark, filled):
    store, ids = filled
    profiles = build_profiles(people(spark, *ids, "30"))
    wanted = ENCODER.encode(requirements(spark, requirement("R1", [("Skill 30", "L", None)]), requirement("R2"))
                            .withColumn("text", requirement_text()))
    assert ix.create_index(store, "flat", ENCODER.model, "flat")["vector_count"] == 30
    assert ix.create_index(store, "cells", ENCODER.model, "ivf", nlist=4, nprobe=4)["vector_count"] == 30
    for bad, message in ((("flat", ENCODER.model), "exists already"), (("x", ENCODER.model, "tree"), "unknown index type"),
                         (("x", "nothing"), "no vectors")):
        with pytest.raises(ValueError, match=message):
            ix.create_index(store, *bad)

    def both():
        a, b = (found(ix.search_index(store, n, wanted, profiles, model=ENCODER.model, top_n=31)) for n in ("flat", "cells"))
        assert a == b
        return {r[2] for r in a if r[0] == "R1"}

    assert both() == set(ids)
    eb.sync_embeddings(store, people(spark, *ids[1:], "30"), ENCODER)  # 00 left, 30 joined
    assert both() == set(ids[1:])  # the leaver is gone at once, the newcomer waits for the append
    assert ix.append_index(store, "cells") == {"appended": 1, "total": 30}
    assert ix.append_index(store, "flat") == {"appended": 1, "total": 30}
    assert both() == {*ids[1:], "30"}
    assert ix.append_index(store, "cells")["appended"] == 0
    assert ix.append_index(store, "cells", rebuild=True)["total"] == 30
    assert ix.append_index(store, "flat", rebuild=True)["total"] == 30
    assert both() == {*ids[1:], "30"}
    assert [r[0] for r in ix.list_indexes(store).collect()] == ["cells", "flat"]
    with pytest.raises(ValueError, match="holds vectors of"):
        ix.search_index(store, "flat", wanted, profiles, model="other")
    with pytest.raises(Exception, match="vector dimension must be 16"):
        short = wanted.selectExpr("* EXCEPT (vec)", "slice(vec, 1, 3) AS vec")
        ix.search_index(store, "flat", short, profiles, model=ENCODER.model).collect()
    ix.drop_index(store, "cells")
    with pytest.raises(ValueError, match="not in the catalog"):
        ix.search_index(store, "cells", wanted, profiles, model=ENCODER.model)
    with pytest.raises(ValueError, match="not in the catalog"):
        ix.drop_index(store, "cells")


class Dying(TableStore):
    """A store whose runs end right before they publish."""

    def publish(self, name, version):
        raise RuntimeError("lost driver")


def test_vectors_of_a_lost_run_never_come_alive(spark, store):
    eb.sync_embeddings(store, people(spark, "a", "b", "c"), ENCODER)
    with pytest.raises(RuntimeError, match="lost driver"):
        eb.sync_embeddings(Dying(spark, store.root), people(spark, "a", "b", "c", "x"), ENCODER)
    assert counts(eb.sync_embeddings(store, people(spark, "a", "b"), ENCODER)) == (0, 1, 0, 2, True)
    assert sorted(r["employee_id"] for r in eb.read_vectors(store, ENCODER.model).collect()) == ["a", "b"]
    eb.sync_embeddings(store, people(spark, "a", "b", "x"), ENCODER)
    assert sorted(r["employee_id"] for r in eb.read_vectors(store, ENCODER.model).collect()) == ["a", "b", "x"]


def test_names_may_hold_any_character(spark, store):
    slashed = HashingEncoder(8)
    slashed.model = "org/name=1 %"
    eb.sync_embeddings(store, people(spark, "1", "2"), slashed)
    eb.sync_embeddings(store, people(spark, "1"), ENCODER)
    assert set(vectors(store, slashed.model)) == {"1", "2"} and set(vectors(store)) == {"1"}
    assert [tuple(r) for r in eb.embedding_sets(store).collect()] == [("hashed-words-16", 1, 16), ("org/name=1 %", 2, 8)]
    assert ix.create_index(store, "a/b", slashed.model, "ivf", nlist=2)["vector_count"] == 2
    assert ix.append_index(store, "a/b", rebuild=True)["total"] == 2


def test_nothing_is_written_when_nothing_changed(spark, store, monkeypatch):
    eb.sync_embeddings(store, people(spark, "1"), ENCODER)
    monkeypatch.setattr(store, "stage", None)
    assert eb.sync_embeddings(store, people(spark, "1"), ENCODER).version == 1


@pytest.mark.parametrize("kind", ["exact", "ivf"])
def test_a_changed_employee_stays_in_the_index(spark, store, kind):
    eb.sync_embeddings(store, people(spark, "1", "2", "3"), ENCODER, detect_changes=True)
    assert ix.create_index(store, "i", ENCODER.model, kind, nlist=2)["unpaired"] == 0
    old = vectors(store)
    moved = people(spark, "1", "3").unionByName(people(spark, "2", domain="Retail"))
    eb.sync_embeddings(store, moved, ENCODER, detect_changes=True)

    def held():
        return {r["employee_id"]: r["vec"] for r in ix.index_vectors(store, ix.index_row(store, "i")).collect()}

    assert held() == {k: v[0] for k, v in old.items()}
    assert ix.append_index(store, "i") == {"appended": 1, "total": 3}
    assert held() == {k: v[0] for k, v in vectors(store).items()} and ix.index_row(store, "i")["vector_count"] == 3


def test_a_failed_rebuild_leaves_the_index_as_it_was(spark, filled):
    store, ids = filled
    ix.create_index(store, "cells", ENCODER.model, "ivf", nlist=4, seed=11)
    row = ix.index_row(store, "cells")
    with pytest.raises(RuntimeError, match="lost driver"):
        ix.append_index(Dying(spark, store.root), "cells", rebuild=True)
    assert ix.index_row(store, "cells") == row and ix.index_vectors(store, row).count() == 30
    ix.append_index(store, "cells", rebuild=True)
    again = ix.index_row(store, "cells")
    assert again["seed"] == 11 and again["build"] > row["build"]
    assert (ix.index_centroids(store, again) == ix.index_centroids(store, again)).all() and ix.index_vectors(store, again).count() == 30


def test_equal_vector_ids_are_refused_by_name(spark, store):
    from pyspark.sql import functions as F

    first_letter = lambda c: F.ascii(c).cast("bigint")
    eb.sync_embeddings(store, people(spark, "a1", "b1"), ENCODER, id_function=first_letter)
    with pytest.raises(ValueError, match="vector id 97 stands for both 'a1' and 'a2'"):
        eb.sync_embeddings(store, people(spark, "a1", "b1", "a2"), ENCODER, id_function=first_letter)
    assert set(vectors(store)) == {"a1", "b1"} and store.current(eb.registry_name(ENCODER.model)) == 1
    assert counts(eb.sync_embeddings(store, people(spark, "a1", "b1", "c1"), ENCODER, id_function=first_letter)) == (1, 0, 0, 3, False)


def skilled(spark, *groups, start=1):
    return employees(spark, *[employee_rows(i, skills, start=start, **more) for i, skills, more in groups])


def test_unchanged_rows_build_no_text(spark, store, monkeypatch):
    a, b = ("a", [("Go", "L", 2.0), ("C", "L", 1.0)], {}), ("b", [("Go", "L", 2.0)], {})
    eb.sync_embeddings(store, skilled(spark, a, b), ENCODER, detect_changes=True)
    monkeypatch.setattr(eb, "build_profiles", None)  # any text would fail
    for same in (skilled(spark, a, b), skilled(spark, a, b, start=5000), skilled(spark, a, b).repartition(5),
                 skilled(spark, ("a", a[1], {"bandwidth": 5.0, "name": "Other"}), b)):
        assert eb.sync_embeddings(store, same, ENCODER, detect_changes=True).version == 1
    with pytest.raises(TypeError):
        eb.sync_embeddings(store, skilled(spark, ("a", [("C", "L", 1.0), ("Go", "L", 2.0)], {}), b), ENCODER, detect_changes=True)


@pytest.mark.parametrize("skills, more, changed", [
    ([("C", "L", 1.0), ("Go", "L", 2.0)], {}, 1),  # another order
    ([("Go", "L", 2.0), ("C", "L", 1.0), ("go ", "X", 9.0)], {}, 0),  # other rows, the same text
    ([("Go", "L", 2.0), ("C", None, 1.0)], {}, 1),
    ([("Go", "L", 2.0), ("C", "L", 1.5)], {}, 1),
    ([("Go", "L", 2.0), ("C", "L", 1.0)], {"summary": None}, 1),
    ([("Go", "L", 2.0)], {}, 1)])
def test_only_another_text_is_a_change(spark, store, skills, more, changed):
    eb.sync_embeddings(store, skilled(spark, ("a", [("Go", "L", 2.0), ("C", "L", 1.0)], {}), ("b", [("Go", "L", 2.0)], {})), ENCODER, detect_changes=True)
    now = skilled(spark, ("a", skills, more), ("b", [("Go", "L", 2.0)], {}))
    assert eb.sync_embeddings(store, now, ENCODER, detect_changes=True).changed_count == changed
    assert eb.sync_embeddings(store, now, ENCODER, detect_changes=True).changed_count == 0


def test_a_registry_without_texts_gets_them(spark, store):
    eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER)
    assert eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER, detect_changes=True).changed_count == 2
    assert eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER, detect_changes=True).version == 2


def aged(store):
    """A history with replaced vectors, a leaver, a newcomer, and an index that serves the first version."""
    spark = store.spark
    eb.sync_embeddings(store, people(spark, "1", "2", "3", "4"), ENCODER, detect_changes=True)
    ix.create_index(store, "old", ENCODER.model)
    ix.create_index(store, "cells", ENCODER.model, "ivf", nlist=2, nprobe=2)
    moved = people(spark, "1", "3", "5").unionByName(people(spark, "2", domain="Retail"))
    eb.sync_embeddings(store, moved, ENCODER, detect_changes=True)
    ix.append_index(store, "cells")
    last = people(spark, "1", "5").unionByName(people(spark, "2", domain="Retail")).unionByName(people(spark, "3", domain="Bank"))
    eb.sync_embeddings(store, last, ENCODER, detect_changes=True)
    return last


def state(store):
    held = {n: sorted((r["employee_id"], r["vec"]) for r in ix.index_vectors(store, ix.index_row(store, n)).collect()) for n in ("old", "cells")}
    return vectors(store), held, eb.embedding_sets(store).first()["dim"]


def test_compaction_keeps_what_is_named(spark, store):
    aged(store)
    before = state(store)
    assert eb.published_vectors(store, ENCODER.model).count() == 7
    with pytest.raises(RuntimeError, match="lost driver"):
        eb.compact_vectors(Dying(spark, store.root), ENCODER.model)
    assert state(store) == before and eb.published_vectors(store, ENCODER.model).count() == 7
    # 2 and 3 are served by the old index in their first version, 2 also live in its second: nothing to drop yet
    assert eb.compact_vectors(store, ENCODER.model) == {"version": 3, "kept": 7, "dropped": 0}
    assert state(store) == before
    assert eb.delete_compacted(store, ENCODER.model) == 0  # too young
    assert eb.delete_compacted(store, ENCODER.model, retention_hours=0) == 3
    assert state(store) == before and store.folders("vectors") == [f"model={ENCODER.model}"] and not store.folders("vectors", f"model={ENCODER.model}")
    assert eb.compact_vectors(store, ENCODER.model) == {"version": 3, "kept": 0, "dropped": 0}


def test_work_goes_on_after_a_compaction(spark, store):
    last = aged(store)
    ix.append_index(store, "old")
    ix.append_index(store, "cells")
    assert eb.compact_vectors(store, ENCODER.model)["dropped"] == 2
    eb.delete_compacted(store, ENCODER.model, retention_hours=0)
    assert ix.compact_index(store, "cells") == {"kept": 5, "dropped": 2}
    row = ix.index_row(store, "cells")
    assert row["parts"] == 1 and ix.index_reach(store, row).count() <= 2
    # 4, who had left, comes back with the vector it had; 6 is new
    result = eb.sync_embeddings(store, last.unionByName(people(spark, "4", "6")), ENCODER, detect_changes=True)
    assert counts(result) == (1, 0, 1, 6, True)
    assert set(vectors(store)) == set("123456") and vectors(store)["4"][1] == 1
    assert ix.append_index(store, "cells") == {"appended": 1, "total": 6} and ix.append_index(store, "old")["total"] == 6
    held = state(store)[1]
    assert held["old"] == held["cells"] == sorted((k, v[0]) for k, v in vectors(store).items())
    assert eb.compact_vectors(store, ENCODER.model) == {"version": 4, "kept": 6, "dropped": 0}
    assert eb.delete_compacted(store, ENCODER.model, retention_hours=0) == 2 and len(vectors(store)) == 6


def test_pairing_counts_both_sides_and_dimensions(spark):
    from staffmatch.operators.sync import pair_report

    registry = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("c", 2, True), ("d", 1, False), ("e", 1, True), ("f", 1, True)],
                                     "employee_id string, vector_version bigint, is_active boolean")
    rows = [("a", 1, [1.0, 2.0]), ("b", 1, [1.0, 2.0]), ("c", 1, [1.0, 2.0]), ("d", 1, [1.0]), ("x", 1, [1.0, 2.0]), ("f", 1, [1.0, 2.0, 3.0])]
    held = spark.createDataFrame(rows, "employee_id string, version bigint, vec array<float>")
    assert pair_report(held, registry) == {"paired": 3, "ids_without_vector": 2, "vectors_without_id": 1, "wrong_dim": 1, "dim": 2}
    assert pair_report(held.where("false"), registry)["ids_without_vector"] == 5
    assert pair_report(held, registry.where("false")) == {"paired": 0, "ids_without_vector": 0, "vectors_without_id": 6, "wrong_dim": 0, "dim": 0}


def test_small_and_repetitive_staffs_get_fewer_cells(spark, store):
    same = LookupEncoder("same", spark.createDataFrame([(i, [0.6, 0.8]) for i in "123"], "employee_id string, vec array<float>"))
    eb.sync_embeddings(store, people(spark, "1", "2", "3"), same)
    assert ix.create_index(store, "few", "same", "ivf", nlist=3)["vector_count"] == 3
    assert len(ix.index_centroids(store, ix.index_row(store, "few"))) == 1 and ix.index_row(store, "few")["nlist"] == 3
    assert ix.append_index(store, "few", rebuild=True)["total"] == 3
    with pytest.raises(ValueError, match="3 vectors cannot train 4 cells"):
        ix.create_index(store, "more", "same", "ivf", nlist=4)


@pytest.mark.parametrize("kind", ["exact", "ivf"])
def test_vectors_of_unequal_length_are_refused(spark, store, kind):
    odd = LookupEncoder("odd", spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0]), ("3", [0.0, 1.0])], "employee_id string, vec array<float>"))
    eb.sync_embeddings(store, people(spark, "1", "2", "3"), odd)
    with pytest.raises(Exception, match="vector dimension must be 2"):
        ix.create_index(store, "i", "odd", kind, nlist=1)


@pytest.mark.parametrize("plan", ["auto", "grid"])
def test_an_exact_search_of_cells_equals_the_flat_one(spark, filled, plan):
    from staffmatch.operators.knn import KnnOptions

    store, ids = filled
    profiles = build_profiles(people(spark, *ids))
    wanted = ENCODER.encode(requirements(spark, *[requirement(f"R{i}", [(f"Skill {i:02d}", "L", None)]) for i in range(6)])
                            .withColumn("text", requirement_text()))
    ix.create_index(store, "flat", ENCODER.model, "flat")
    ix.create_index(store, "cells", ENCODER.model, "ivf", nlist=6, nprobe=1)
    eb.sync_embeddings(store, people(spark, *ids[2:]), ENCODER)  # bounds and counts still hold the leavers
    search = lambda name, **more: found(ix.search_index(
        store, name, wanted, profiles, model=ENCODER.model, candidate_k=4, top_n=4, options=KnnOptions(plan=plan), **more))
    assert search("cells", exact=True) == search("flat") != search("cells")


def test_an_encoder_reads_each_requirement_once(spark, filled):
    store, ids = filled
    calls = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            calls.add(len(texts))
            return np.ones((len(texts), 16))
        return encode

    encoder = BatchEncoder("counted", 16, load)
    wanted = encoder.encode(requirements(spark, *[requirement(f"R{i}") for i in range(10)]).withColumn("text", requirement_text()))
    eb.sync_embeddings(store, people(spark, *ids), encoder)
    calls.value = 0
    from staffmatch.plans.match import candidates

    assert candidates(wanted, eb.read_vectors(store, "counted"), 5).count() == 50 and calls.value == 10


def requirement_text():
    from staffmatch.functions.text import requirement_embedding_text

    return requirement_embedding_text()


def test_texts_are_built_once_for_hash_and_encoder(spark, store, monkeypatch):
    calls, real = [], eb.build_profiles
    monkeypatch.setattr(eb, "build_profiles", lambda *a, **kw: calls.append(1) or real(*a, **kw))
    eb.sync_embeddings(store, people(spark, "1", "2"), ENCODER, detect_changes=True)
    assert len(calls) == 1
    moved = people(spark, "1").unionByName(people(spark, "2", "3", domain="Retail"))
    result = eb.sync_embeddings(store, moved, ENCODER, detect_changes=True)
    assert (result.new_count, result.changed_count, len(calls)) == (1, 1, 2)
    plain = {r["employee_id"]: r["vec"] for r in ENCODER.encode(real(moved).select("employee_id", "profile_text"), "profile_text").collect()}
    assert {i: v for i, (v, _) in vectors(store).items()} == plain


def test_words_are_hashed_once_per_task_and_counted_as_the_columns_would(spark):
    from pyspark.sql import functions as F

    from staffmatch.functions.vectors import hash60

    texts = ["Go go GO  \t Kotlin\u000b\u000cgo\r\nx", "Köln KÖLN köln x İstanbul ΣΑΣ", "a\u001cb a\u001cb", "", "  ", None, "w" * 200 + " w"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "employee_id string, text string")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    want = {r["employee_id"]: r["buckets"] for r in rows.select("employee_id", F.transform(words, lambda w: hash60(w) % 16).alias("buckets")).collect()}
    encoded = HashingEncoder(16).encode(rows)
    assert "sha2(" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    for r in encoded.collect():
        counts = np.bincount(want[r["employee_id"]], minlength=16).astype(float) if want[r["employee_id"]] else np.zeros(16)
        unit = counts / (np.sqrt((counts * counts).sum()) or 1.0)
        assert r["vec"] == [float(x) for x in unit.astype(np.float32)]
