import hashlib
import random

import pytest

from staffmatch.llm import warc_dict as w
from staffmatch.llm.binary_sink import file_contents
from staffmatch.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, digest string, refers_to string, owner int"


def pages(spark):
    rng = random.Random(1)
    big = "<p>" + "".join(rng.choice("abcdef <>") for _ in range(1500))
    rows = [(1, "http://a/", big), (2, "http://b/ x\ny", big), (3, None, big), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""),
            (3, None, big), (None, "n", big), (8, "u", "é" * 499), (9, "u", "é" * 499), (10, "u", "é" * 500), (11, "u", "é" * 500),
            (12, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (13, "u", "x" * 400_000)]
    return spark.createDataFrame([(*r, "other", "other", 5) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    owner = {}
    for r in rows:
        owner[r["html"] or ""] = max(owner.get(r["html"] or "", -1), -1 if r["page_id"] is None else r["page_id"])
    for r in rows:
        raw = (r["html"] or "").encode()
        revisit = len(raw) >= 1000 and r["page_id"] != owner[r["html"] or ""]
        yield (r["page_id"] or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner[r["html"] or ""] if revisit else 0)


def test_round_trip_and_revisits(spark):
    path = Scratch(spark, "test").path("archives")
    w.write_archives(pages(spark), path)
    back = w.read_archives(spark, path).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in back)
    assert got == sorted(plain(pages(spark).collect()))
    texts = {(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()}
    assert all((r["page_id"], bytes(r["payload"])) in texts for r in back if r["record_type"] == "response")


def test_archives_start_with_their_dictionary_and_plain_decoders_read_them(spark, sf):
    import zstandard

    path = Scratch(spark, "test").path("archives")
    table = spark.read.parquet(f"{sf}/pages.parquet")
    w.write_archives(table, path)
    n = 0
    for r in file_contents(spark, path).collect():
        data = bytes(r["content"])
        assert int.from_bytes(data[:4], "little") == w.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        whole = plain.stream_reader(data[8 + size:], read_across_frames=True).read()
        assert whole == b"".join(w.split_archive(data))
        n += whole.count(b"WARC-Record-ID")
    assert n == table.count()


def test_damage_is_noticed():
    raw = w.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False, w.DATE)
    assert w.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        w.parse_record(raw.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))


def test_empty_table(spark):
    path = Scratch(spark, "test").path("archives")
    w.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert w.read_archives(spark, path).count() == 0
