"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is a frame of its
own after that, and every frame is followed by an empty skippable frame, which decoders pass over. That empty frame is
plain ASCII, and Spark's text sink puts it after every row: archives are written by Spark's own commit protocol.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmatch.llm.binary_sink import file_contents, write_bytes
from staffmatch.llm.sampling import bounded_sample
from staffmatch.llm.words import pieces

#: Skippable frame magics; the first is the one for dictionaries, the second is empty and all ASCII.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
#: Payloads below this size are always written out.
LEAST_REVISIT = 1000
DICTIONARY_BYTES = 64 << 10
#: Records that the dictionary is built from, about; parameters of `build_dictionary`.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 8 << 20
LEVEL = 3
#: Given to every record, so that the same pages give the same archives; a parameter of `write_archives`.
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes that a reader hands to the decoder at a time.
STEP = 32 << 10


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record written by `record`; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:"):-1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
            "payload": payload if fields["WARC-Type"] == "response" else None}


def split_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive in order."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                dictionary = zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size]))
            at += 8 + size
            continue
        decoder = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        parts = []
        while not decoder.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            step = view[at:at + STEP]
            parts.append(decoder.decompress(step))
            at += len(step) - len(decoder.unused_data)
        yield b"".join(parts)


def with_owners(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    owners = keyed.groupBy("digest").agg(F.max("page_id").alias("owner"))
    revisits = (F.col("size") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return keyed.join(owners, "digest").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("owner")).alias("refers_to"))


def build_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, most_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from a bounded sample of records: trained, or the records themselves where they are too few."""
    import zstandard

    rows = bounded_sample(pages.select("page_id", "url", "html").where("html IS NOT NULL"), "page_id", records)
    samples, room = [], most_bytes
    for r in rows.orderBy(F.xxhash64("html"), "page_id").toLocalIterator():
        payload = r["html"].encode()
        raw = record(r["page_id"], r["url"], payload, hashlib.sha1(payload).hexdigest(), None, False, DATE)
        if len(raw) > room:
            break
        samples.append(raw)
        room -= len(raw)
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _archive_rows(dictionary: bytes, date: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        import zstandard

        opened = False
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        for batch in pieces(batches, "payload"):
            frames = []
            if not opened and dictionary:
                frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            opened = True
            for page, url, payload, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                frames.append(packer.compress(record(page, url, payload, digest, to, to is not None, date)))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.large_binary())], ["value"])
    return run


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write a record per row of `pages` (page_id, url, html; other columns are ignored) into archives below `path`.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the largest page_id is a response and
    the others revisit it; rows that repeat that page_id are responses, too. A null html is an empty payload, a null
    url leaves its header out, a null page_id is `urn:page:null` and revisits like any other. An empty table writes
    no record.
    """
    rows = with_owners(pages).mapInArrow(_archive_rows(build_dictionary(pages), date), "value binary")
    write_bytes(rows, "value", EMPTY_FRAME, path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record below `path`."""
    names = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.large_binary()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for raw in split_archive(content.as_py()):
                    rows.append(parse_record(raw))
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(names))
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(names))

    return file_contents(spark, path).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
