import json

import pytest
from pyspark.sql import functions as F

from staffmatch.operators.encode import HashingEncoder, encode_profiles, encode_requirements
from staffmatch.operators.profiles import build_profiles
from staffmatch.plans import embeddings as eb
from staffmatch.plans.match import match
from staffmatch.sources.requirements import parse_requirements
from staffmatch.sources.tables import TableStore
from staffmatch.streaming.requirements import read_matches, read_quarantine, read_reply_stream, stream_matches
from staffmatch.streaming.snapshots import read_manifest_stream, stream_sync
from tests.helpers import employee_rows, employees

ENCODER = HashingEncoder(16)


def test_stream_of_requirements_equals_one_batch_and_replays_cleanly(spark, tmp_path):
    staff = employees(spark, *[employee_rows(f"E{i}", [(f"Skill {i % 3}", "L", 1.0)]) for i in range(8)])
    profiles = build_profiles(staff)
    vectors = encode_profiles(profiles, ENCODER)
    folder = tmp_path / "in"
    folder.mkdir()
    replies = []
    for i in range(6):
        raw = json.dumps({"domain": ["Web"], "mandatory_skills": [{"skill": f"Skill {i % 4}"}]})
        replies.append((f"R{i}", raw[:20] if i == 4 else raw))
        (folder / f"{i}.json").write_text(json.dumps({"requirement_id": f"R{i}", "raw": replies[-1][1]}))

    def run(requirements):
        return match(encode_requirements(requirements, ENCODER), profiles, vectors, top_n=5)

    def go(checkpoint):
        stream_matches(read_reply_stream(spark, str(folder), 2), run, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
        matches = read_matches(spark, str(tmp_path / "out"))
        assert matches.select("batch_id").distinct().count() == 3
        return sorted(map(str, matches.drop("batch_id").collect()))

    ok, bad = parse_requirements(spark.createDataFrame(replies, "requirement_id string, raw string"))
    want = sorted(map(str, run(ok).collect()))
    assert go("c1") == want and len(want) == 25
    assert go("c2") == want  # every batch replayed: the later attempts replace the earlier ones
    assert [r["requirement_id"] for r in read_quarantine(spark, str(tmp_path / "out")).collect()] == ["R4"]


def test_readers_see_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from staffmatch.streaming import requirements as sr

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"requirement_id": f"R{i}", "raw": json.dumps({"domain": ["Web"]}) if i else "{"}))
    seen = []

    def run(requirements):
        rows = read_matches(spark, out)
        seen.append(0 if rows is None else rows.count())
        return requirements.selectExpr("requirement_id", "1 AS rank")

    publish, left = sr.publish_batch, [2]

    def dying(*args):
        left[0] -= 1
        if not left[0]:
            raise RuntimeError("lost driver")
        publish(*args)

    def go():
        stream_matches(read_reply_stream(spark, str(folder), 1), run, out, str(tmp_path / "c")).awaitTermination()

    monkeypatch.setattr(sr, "publish_batch", dying)
    with pytest.raises(Exception, match="lost driver"):
        go()  # the second batch is written but not published
    first = sorted(r["requirement_id"] for r in read_matches(spark, out).collect())
    assert len(first) <= 1 and len(spark.read.parquet(f"{out}/matches").select("attempt").distinct().collect()) >= 1
    go()
    assert sorted(r["requirement_id"] for r in read_matches(spark, out).collect()) == ["R1", "R2"]
    assert [r["requirement_id"] for r in read_quarantine(spark, out).collect()] == ["R0"]
    assert seen == sorted(seen) and sr.published_batches(spark, out).count() == 3


def test_nothing_is_published_yet(spark, tmp_path):
    assert read_matches(spark, str(tmp_path)) is None and read_quarantine(spark, str(tmp_path)) is None


def test_stream_of_snapshots_equals_separate_syncs_and_skips_old_versions(spark, tmp_path):
    def snapshot(*ids):
        return employees(spark, *[employee_rows(i, [("Go", "L", 1.0)]) for i in ids])

    snapshots = [snapshot("1", "2", "3"), snapshot("1", "3", "4"), snapshot("1", "2", "3", "4")]
    manifests = tmp_path / "manifests"
    manifests.mkdir()
    for v, rows in enumerate(snapshots, start=1):
        rows.write.parquet(str(tmp_path / f"s{v}"))
    streamed, separate = (TableStore(spark, str(tmp_path / n)) for n in ("streamed", "separate"))

    def announce(v):
        (manifests / f"{v}.json").write_text(json.dumps({"version": v, "path": str(tmp_path / f"s{v}")}))

    def go(checkpoint="c"):
        stream_sync(read_manifest_stream(spark, str(manifests)), streamed, ENCODER, str(tmp_path / checkpoint)).awaitTermination()

    def state(store):
        columns = ["employee_id", "vector_id", "vector_version", "is_active", "action"]
        return sorted(map(tuple, eb.read_registry(store, ENCODER.model).select(*columns).collect()))

    for v, rows in enumerate(snapshots, start=1):
        announce(v)
        go()
        eb.sync_embeddings(separate, rows, ENCODER)
        assert state(streamed) == state(separate)
    go("fresh checkpoint")  # every manifest again: all versions are already applied
    assert state(streamed) == state(separate)
    assert eb.read_vectors(streamed, ENCODER.model).agg(F.count_distinct("employee_id")).first()[0] == 4
