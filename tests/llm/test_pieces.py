import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest

from staffmatch.llm import spm_offsets as so
from staffmatch.llm.words import text_bytes
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  two  spaces ", "tab\tx\n\n y", "▁ ▁▁x▁", "日本 語🙂 x", "é", " ", "   ", "x" * 300, "a b", "\x00z"]


@pytest.fixture(scope="module")
def model():
    return so.Piecewise(PATH)


def test_ids_spans_and_text_match_the_library(model):
    import pyarrow as pa

    texts = HARD + awkward_texts()
    ids, starts, begins, ends = model.encode(*text_bytes(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        raw, part = (text or "").encode(), slice(starts[i], starts[i + 1])
        assert ids[part].tolist() == model.library.encode(text or "")
        b, e = begins[part].tolist(), ends[part].tolist()
        assert b"".join(raw[x:y] for x, y in zip(b, e)) == raw  # the spans cover every byte once, in order
        for piece, x, y in zip(ids[part].tolist(), b, e):
            shown = model.library.id_to_piece(piece)
            if not model.library.is_byte(piece):
                assert raw[x:y].decode().replace(" ", "▁") in (shown, shown[1:])


def test_uncut_segmentation_gives_the_same(model):
    import pyarrow as pa

    whole = so.Piecewise(PATH)
    whole.cuttable = False
    texts = [t for t in HARD + awkward_texts() if t is None or len(t) < 3000]
    for a, b in zip(model.encode(*text_bytes(pa.array(texts, pa.string()))), whole.encode(*text_bytes(pa.array(texts, pa.string())))):
        assert np.array_equal(a, b)


def compiled(mapping: dict[bytes, bytes]) -> bytes:
    """A small double array for a map: a block of 256 units per trie node."""
    nodes, pool = {b"": 0}, b""
    for key in mapping:
        for i in range(1, len(key) + 1):
            nodes.setdefault(key[:i], len(nodes))
    units = [0] * (512 * (len(nodes) + 1))
    home = lambda prefix: 512 * (nodes[prefix] + 1)
    # The unit of a prefix sits at home(parent) ^ label, and its offset leads to home(prefix).
    place = {b"": 0}
    for prefix in nodes:
        if prefix:
            place[prefix] = home(prefix[:-1]) ^ prefix[-1]
    for prefix, at in place.items():
        offset = at ^ home(prefix)
        units[at] = (offset << 10) | (prefix[-1] if prefix else 0)
        if prefix in mapping:
            units[at] |= 0x100
            units[home(prefix)] = 0x8000_0000 | len(pool)
            pool += mapping[prefix] + b"\0"
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + pool


def test_longest_prefix_normalisation_keeps_the_source():
    table = so.CharacterMap(compiled({b"a": b"A", b"abc": b"<", b"x": b"", b"\xc3\xa9": b"e", b"\t": b" "}))
    assert table.longest(b"abd", 0) == (1, b"A") and table.longest(b"abc", 0) == (3, b"<") and table.longest(b"q", 0) is None
    text = "abcab\té x".encode()
    out, begins, ends = so.normalise(text, so.Spec(b"", False, False, False), table)
    assert out == b"<Ab e "
    assert [text[b:e].decode() for b, e in zip(begins, ends)] == ["abc", "a", "b", "\t", "é", " "]
    out, begins, ends = so.normalise(b"  q  \t z ", so.Spec(b"", True, True, True), table)
    assert out.decode() == "▁q▁z" and begins[0] == ends[0]


def test_against_the_library_with_a_real_map(tmp_path):
    """The library's own normaliser under the small map, for a model that squeezes white space."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    spec = proto.normalizer_spec
    spec.name, spec.precompiled_charsmap, spec.remove_extra_whitespaces = "own", compiled({b"a": b"b", b"th": b"z"}), True
    path = tmp_path / "own.model"
    path.write_bytes(proto.SerializeToString())
    library, own = spm.SentencePieceProcessor(model_file=str(path)), so.Piecewise(str(path))
    texts = ["  that  is a  thing ", "", "   ", "plain", "tha"]
    import pyarrow as pa

    ids, starts, begins, ends = own.encode(*text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[starts[i]:starts[i + 1]].tolist() == library.encode(text)


def test_operator_on_awkward_rows(spark, model):
    docs = awkward_docs(spark, extra=True)
    texts = awkward_texts()
    rows = so.encode_decode(docs, PATH).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = model.library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["decoded"] == model.library.decode(want) and len(r["begins"]) == len(r["ends"]) == len(want)
    for r in so.document_digests(docs, PATH).collect():
        want = model.library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want) and r["spans_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.library.decode(want).encode()).hexdigest()
    assert so.encode_decode(empty_docs(spark), PATH).count() == 0
