"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it came from.

The normaliser is read from the model: its compiled character map is a double-array trie over byte prefixes and a
pool of replacements. Normalising walks the text, takes the longest mapped prefix at every position (or one
character), and notes for each normalised byte the source bytes it stands for. The library then segments the
normalised text with its own normaliser switched off, and a piece's span is that of its first and last byte.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmatch.llm.pretokens import ChunkEncoder, chunks, gather
from staffmatch.llm.words import pieces, text_bytes, word_codes

#: Fixed value: the visible space of the library (U+2581).
MARK = "▁".encode()


class CharacterMap:
    """The compiled map: a 4-byte trie size, the trie's units, and zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest mapped prefix of text[at:] and its replacement."""
        if not self.units:
            return None
        best, unit = None, self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for end in range(at, len(text)):
            node ^= text[end]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x8000_00FF != text[end]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                start = self.units[node] & 0x7FFF_FFFF
                best = end + 1 - at, self.pool[start:self.pool.index(b"\0", start)]
        return best


@dataclass
class Spec:
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # remove_extra_whitespaces
    escape: bool
    suffix: bool = False  # the dummy goes to the end


def _sequence(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def normalise(text: bytes, spec: Spec, table: CharacterMap) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The normalised bytes, and for each the start and end of its source bytes."""
    space = MARK if spec.escape else b" "
    out, begins, ends = bytearray(), [], []

    def put(piece: bytes, begin: int, end: int) -> None:
        out.extend(piece)
        begins.extend([begin] * len(piece))
        ends.extend([end] * len(piece))

    units, at = [], 0
    while at < len(text):
        hit = table.longest(text, at)
        length, piece = hit if hit else (_sequence(text[at]), text[at:at + _sequence(text[at])])
        units.append((piece, at, at + length))
        at += length
    if spec.squeeze:
        while units and units[0][0] == b" ":
            units.pop(0)
        while units and units[-1][0] == b" ":
            units.pop()
    if not units:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    if spec.dummy_prefix and not spec.suffix:
        put(space, units[0][1], units[0][1])
    after_space = spec.squeeze
    for piece, begin, end in units:
        if spec.squeeze and after_space:
            piece = piece.lstrip(b" ")
        put(piece.replace(b" ", space), begin, end)
        if piece:
            after_space = spec.squeeze and piece.endswith(b" ")
    if spec.dummy_prefix and spec.suffix:
        put(space, units[-1][2], units[-1][2])
    return bytes(out), np.array(begins), np.array(ends)


class Piecewise:
    """A model, its normaliser taken out, and the memory of the chunks it has segmented."""

    def __init__(self, path: str) -> None:
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        n = proto.normalizer_spec
        self.spec = Spec(n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces,
                         proto.trainer_spec.treat_whitespace_as_suffix)
        self.table = CharacterMap(n.precompiled_charsmap)
        self.library = spm.SentencePieceProcessor(model_file=path)
        n.name, n.precompiled_charsmap = "identity", b""
        n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
        self.bare = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # Text may be cut before a mark that follows something else if no piece spans such a place.
        mark = MARK.decode()
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.cuttable = (proto.trainer_spec.model_type == 2 and self.byte_fallback and not any(
            p.type == 4 or mark in p.piece.lstrip(mark) for p in proto.pieces))
        # Bytes of normalised text behind every id: a byte piece (type 6) stands for one.
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.encoder = ChunkEncoder(lambda parts: self.bare.encode([p.decode() for p in parts], num_threads=1))

    def normalised(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Normalised bytes of all texts, first byte of each text, and source begin and end per byte (within its text)."""
        spec = self.spec
        if self.table.units or spec.squeeze or spec.suffix or not spec.escape:
            raw = data.tobytes()
            each = [normalise(raw[a:b], spec, self.table) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
            bounds = np.append(0, np.cumsum([len(x[0]) for x in each], dtype=np.int64))
            join = lambda i: np.concatenate([x[i] for x in each]) if each else np.zeros(0, np.int64)
            return np.frombuffer(b"".join(x[0] for x in each), np.uint8), bounds, join(1), join(2)
        # Nothing is mapped: a space grows to a mark, every other byte stays, and a mark comes first.
        blank = data == 0x20
        size = np.where(blank, 3, 1)
        heads = rows[:-1][rows[:-1] < rows[1:]]
        if spec.dummy_prefix:
            size[heads] += 3
        ends = np.append(0, np.cumsum(size))
        out, place = np.repeat(data, size), np.arange(ends[-1])
        source = np.repeat(np.arange(len(data)), size)
        within = place - ends[source]
        marks = np.frombuffer(MARK, np.uint8)
        prefixed = np.zeros(len(data), dtype=bool)
        prefixed[heads] = spec.dummy_prefix
        in_prefix = prefixed[source] & (within < 3)
        inside = in_prefix | blank[source]
        out = np.where(inside, marks[within % 3], out)
        begins = source - np.repeat(rows[:-1], ends[rows[1:]] - ends[rows[:-1]])
        return out, ends[rows], begins, begins + ~in_prefix

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of all texts as the library's own encode gives them, first id of each text, source begin and end per id."""
        normal, bounds, begins, ends = self.normalised(data, rows)
        if self.cuttable:
            marked = np.zeros(len(normal) + 3, dtype=bool)
            if len(normal) >= 3:
                marked[3:-2] = (normal[:-2] == MARK[0]) & (normal[1:-1] == MARK[1]) & (normal[2:] == MARK[2])
            # marked[i + 3]: a mark starts at byte i; marked[i]: one ends right before byte i.
            parts, first = chunks(normal, bounds, marked[3:] & ~marked[:len(normal)])
            codes, distinct = word_codes(parts)
            ids, starts = gather(*self.encoder(distinct), codes, first)
            stops = np.cumsum(self.widths[ids])
        else:
            raw = normal.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            found = [[(p.id, len(p.surface.encode())) for p in self.bare.encode(t, return_type="proto").pieces] for t in texts]
            ids = np.array([i for f in found for i, _ in f], dtype=np.uint32)
            starts = np.append(0, np.cumsum([len(f) for f in found], dtype=np.int64))
            # A text's unknown pieces are as long as their surface; byte pieces (whose surface comes at the last) one byte.
            stops = np.cumsum(self.widths[ids] if self.byte_fallback else np.array([n for f in found for _, n in f], dtype=np.int64))
        if len(stops) and stops[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        heads = np.append(0, stops[:-1])[:len(stops)]
        last = np.maximum(stops - 1, heads)
        return ids, starts, begins[np.minimum(heads, len(begins) - 1)], ends[np.minimum(last, len(ends) - 1)]


def _encoded(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = Piecewise(path)
        for batch in pieces(batches, "text", 2 << 20):
            ids, starts, begins, ends = model.encode(*text_bytes(batch.column("text")))
            lists = [ids[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            decoded = model.library.decode(lists, num_threads=1) if lists else []
            offsets = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, begins, ends)),
                 pa.array(decoded, pa.large_string())], ["doc_id", "ids", "begins", "ends", "decoded"])
    return run


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) per row of `docs` (doc_id, text; other columns are ignored).

    Piece i of a document is ids[i] and stands for bytes begins[i] to ends[i] of its text; the parts of a character
    that fell back to bytes have their own byte each, and the mark put before the text has none. A null or empty
    text has no pieces and decodes to an empty text. Repeated rows come out once each; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_encoded(model_path), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def document_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """`encode_decode` with digests in place of the long columns, taken in the same tasks.

    (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_bytes): spans_bytes is the number of source bytes in all spans.
    """
    encoded = _encoded(model_path)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in encoded(batches):
            ids = batch.column("ids")
            bounds, flat = ids.offsets.to_numpy().tolist(), list(map(str, ids.values.to_numpy().tolist()))
            hexes = [hashlib.sha256(",".join(flat[a:b]).encode()).hexdigest() for a, b in zip(bounds, bounds[1:])]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]
            spans = np.append(0, np.cumsum(batch.column("ends").values.to_numpy().astype(np.int64) - batch.column("begins").values.to_numpy()))
            at = np.array(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(hexes), pa.array(texts),
                 pa.array(spans[at[1:]] - spans[at[:-1]])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_bytes long")
