"""Documents as token ids in flat binary files, with 64-bit offsets, global bases and memory-mapped reading.

File format (little-endian), one file per partition, files and documents in ascending doc_id order:

    ids       n_tokens unsigned integers of 2 or 4 bytes, every document closed by the end id
    padding   to a multiple of 8 bytes
    offsets   n_docs + 1 int64: first token of every document within the file, and n_tokens
    doc_ids   n_docs int64
    footer    int64 each: n_docs, n_tokens, width of an id in bytes, MAGIC

MAGIC's last byte is zero like that of every end id below 2^24 (4 bytes) or 256 (2 bytes), which is what Spark's
text sink puts after every row. The bases of the files are prefix sums of their token counts.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staffmatch.llm.binary_sink import file_contents, write_bytes
from staffmatch.llm.pretokens import ChunkEncoder, chunks, flat_lists, gather
from staffmatch.llm.words import SPACE, pieces, text_bytes, word_codes

#: Fixed value: marks a finished file. Its highest byte is zero.
MAGIC = 0x0031_4E45_4B4F_54
#: Fixed value: stands for a null id in the files; it comes before all other ids.
NO_ID = -1 << 63
#: Chunks whose ids a Python worker keeps, about 100 MB; others are encoded again in every piece of text they are in.
WORKER_CHUNKS = 600_000
#: Bytes of text that one file is meant to hold.
FILE_BYTES = 32 << 20

# White space beyond ASCII, as bytes: texts with any of it, or with an added token, are encoded whole.
_WIDE_SPACE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class ByteEncoder:
    """A tokenizer file's ids for whole columns of texts, as its library's encode gives them without special tokens.

    A byte-level tokenizer with the usual pattern splits a text before every white-space run that follows something
    else, and between an ASCII letter and an ASCII punctuation mark, so such chunks are encoded once each. Chunks that begin with white space and end without can stand one after
    the other in one text: its ids are dealt back to them by the bytes that every id stands for. A tokenizer with a
    normalizer or another pre-tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        kind, model = made["pre_tokenizer"] or {}, made["model"]
        self.cuttable = (
            made["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
            and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not model.get("dropout"))
        self.added = tuple(t["content"].encode() for t in made["added_tokens"])
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.widths[number] = len(token)  # a character stands for a byte
        self.encoder = ChunkEncoder(self.encode_chunks, WORKER_CHUNKS)

    def encode_whole(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def encode_chunks(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = [i for i, p in enumerate(parts) if SPACE[p[0]] and not SPACE[p[-1]]]
        alone = np.ones(len(parts), dtype=bool)
        alone[joined] = False
        flat, sizes = flat_lists(self.encode_whole([b"".join([parts[i] for i in joined]), *[parts[i] for i in np.flatnonzero(alone)]]))
        ends = np.cumsum(np.fromiter((len(parts[i]) for i in joined), dtype=np.int64, count=len(joined)))
        at = np.cumsum(self.widths[flat[:sizes[0]]])
        stops = np.searchsorted(at, ends) + 1
        if len(joined) and (stops[-1] != sizes[0] or (at[stops - 1] != ends).any()):
            raise ValueError("ids do not cover the chunks")
        # In the order joined, alone; then in that of the parts.
        counts = np.concatenate([np.diff(stops, prepend=0), sizes[1:]])
        order = np.argsort(np.concatenate([np.array(joined, dtype=np.int64), np.flatnonzero(alone)]))
        starts = np.cumsum(counts) - counts
        ids, _ = gather(flat, starts, counts, order, np.zeros(1, dtype=np.int64))
        return ids, counts[order]

    def _plain(self, text: bytes) -> bool:
        return (text.isascii() or not any(c in text for c in _WIDE_SPACE)) and not any(t in text for t in self.added)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids per row (null: none)."""
        data, rows = text_bytes(column)
        raw, bounds = data.tobytes(), rows.tolist()
        odd = [i for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if not self.cuttable or not self._plain(raw[a:b])]
        if odd:
            inside = np.ones(len(bounds) - 1, dtype=bool)
            inside[odd] = False
            data, rows = data[np.repeat(inside, np.diff(rows))], np.append(0, np.cumsum(np.diff(rows) * inside))
        space = SPACE[data]
        cuts = np.zeros(len(data), dtype=bool)
        cuts[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        parts, first = chunks(data, rows, cuts)
        codes, distinct = word_codes(parts)
        ids, starts = gather(*self.encoder(distinct), codes, first)
        out = [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        for i, found in zip(odd, self.encode_whole([raw[bounds[i]:bounds[i + 1]] for i in odd]) if odd else ()):
            out[i] = np.array(found, dtype=np.uint32)
        return out


#: Encoders of this Python worker, which serves many tasks one after the other: a tokenizer is read, and a chunk encoded, once.
_ENCODERS: dict[str, ByteEncoder] = {}


def _file_rows(tokenizer_path: str, end_id: int, width: int):
    """Per partition: a row of ids per document, then one row with everything that follows the ids; last bytes cut."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, dtype = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, ByteEncoder(tokenizer_path)), f"<u{width}"
        sizes, names = [], []
        for batch in pieces(batches, "text", 4 << 20):
            rows = []
            for ids in encode(batch.column("text")):
                sizes.append(len(ids) + 1)
                rows.append(np.append(ids, end_id).astype(dtype).tobytes()[:-1])
            names.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.large_binary())], ["value"])
        if sizes:
            offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
            pad = -offsets[-1] * width % 8
            tail = [offsets, np.concatenate(names), np.array([len(sizes), offsets[-1], width, MAGIC])]
            body = b"\0" * int(pad) + b"".join(x.astype("<i8").tobytes() for x in tail)
            yield pa.RecordBatch.from_arrays([pa.array([body[:-1]], pa.large_binary())], ["value"])
    return run


class TokenFile:
    """One file, memory-mapped (a local or mounted path) or over bytes that were fetched."""

    def __init__(self, source: str | bytes) -> None:
        self.raw = np.frombuffer(source, np.uint8) if isinstance(source, bytes) else np.memmap(source, np.uint8, "r")
        n_docs, n_tokens, width, magic = self.raw[-32:].view("<i8").tolist()
        if magic != MAGIC:
            raise ValueError("not a finished token file")
        at = -(-n_tokens * width // 8) * 8
        self.n_docs, self.n_tokens = n_docs, n_tokens
        self.ids = self.raw[:n_tokens * width].view(f"<u{width}")
        self.offsets = self.raw[at:at + 8 * (n_docs + 1)].view("<i8")
        self.doc_ids = self.raw[at + 8 * (n_docs + 1):at + 8 * (2 * n_docs + 1)].view("<i8")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Encode `docs` (doc_id, text; other columns are ignored) into token files below `path`.

    A null or empty text is the end id alone. Rows with a null id come first. Repeated rows are written once each, side by
    side; of rows with one id those with the smaller hash of the text come first. An empty table writes no ids.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = 2 if size <= 1 << 16 and end_id < 256 else 4
    if not 0 <= end_id < 1 << 24:
        raise ValueError("end id out of range")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / file_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = (named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(_file_rows(tokenizer_path, end_id, width), "value binary"))
    write_bytes(rows, "value", "\0", path)


def _opened(path: str, content: bytes | None) -> TokenFile:
    parts = urlparse(path)
    return TokenFile(unquote(parts.path) if parts.scheme == "file" else content)


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_doc, n_docs, n_tokens, base) per file; base is the number of ids in all files before it."""
    def footers(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [_opened(p, c) for p, c in zip(*(batch.column(x).to_pylist() for x in ("path", "content")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([int(f.doc_ids[0]) for f in files], pa.int64()),
                 pa.array([f.n_docs for f in files], pa.int64()), pa.array([f.n_tokens for f in files], pa.int64())],
                ["path", "first_doc", "n_docs", "n_tokens"])

    rows = _files(spark, path).mapInArrow(footers, "path string, first_doc long, n_docs long, n_tokens long")
    before = Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content); where the files can be mapped in place, content is null and not even read."""
    files = file_contents(spark, path)
    return files.select("path", F.lit(None).cast("binary").alias("content")) if path.startswith("file:") else files


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone; start is global."""
    def scan(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content, base in zip(*(batch.column(x).to_pylist() for x in ("path", "content", "base"))):
                f = _opened(p, content)
                crcs = [zlib.crc32(f[i].astype("<u4").tobytes()) for i in range(f.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(f.doc_ids), mask=np.asarray(f.doc_ids) == NO_ID), pa.array(np.asarray(f.offsets[:-1]) + base),
                     pa.array(np.diff(f.offsets)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    bases = file_bases(spark, path).select("path", "base")
    return (_files(spark, path).join(bases, "path")
            .mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long"))
