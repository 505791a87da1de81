import zlib

import numpy as np
import public_tokenizers
import pytest

from staffmatch.llm import tokenfiles as tf
from staffmatch.llm.binary_sink import write_bytes
from staffmatch.llm.scratch import Scratch
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = ["  two  spaces ", "tab\t\tx \n\n y", "a b  c", "it's we'll don't 'tis", "x<|endoftext|>y", "é è́ 　 z", "\x1c a \x1f", "", "\u0085 b", "1 22 333", "…!? ,, .",
        "it's,we'll;o'clock rock'n'roll x's' a''s", "a,b.c-d_e\\f`g~h", "é,à;ß's ñ.", "end.\n\n  next,\t(word) ,x ,, y.,", "a.1 1.a a1,b2 A'LL 'd've", "tail, "]


@pytest.mark.parametrize("kept", [5, 100_000])
def test_chunks_encode_like_whole_texts(tokenizer, kept):
    import pyarrow as pa

    encode = tf.ByteEncoder(PATH)
    encode.encoder.kept = kept
    texts = HARD + awkward_texts()
    assert encode.cuttable
    for _ in range(2):
        for text, ids in zip(texts, encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == ids_of(tokenizer, text)
    assert kept > 5 or len(encode.encoder.known) == 5


def test_lists_and_arrays_of_ids_are_kept_alike():
    import pyarrow as pa

    lists = lambda parts: [list(p) for p in parts]
    for encode in (lists, lambda parts: tf.flat_lists(lists(parts))):
        encoder = tf.ChunkEncoder(encode, kept=3)
        for words in ([b"ab", b"c"], [b"c", b"def", b"ab"], [b"gh", b"i", b"c"], [b"gh", b"ab"]):
            ids, starts, counts = encoder(pa.array(words, pa.binary()))
            assert [bytes(ids[a:a + n].tolist()) for a, n in zip(starts, counts)] == words
        assert set(encoder.known) == {b"ab", b"c", b"def"}


@pytest.mark.parametrize("change", ["lower", "prefix", "words"])
def test_other_tokenizers_get_whole_texts(tokenizer, tmp_path, change):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    made = json.loads(tokenizer.to_str())
    if change == "lower":
        made["normalizer"] = {"type": "Lowercase"}
    elif change == "prefix":
        made["pre_tokenizer"]["add_prefix_space"] = True
    else:
        made["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Punctuation", "behavior": "Isolated"}, made["pre_tokenizer"]]}
    path = str(tmp_path / "other.json")
    (tmp_path / "other.json").write_text(json.dumps(made))
    encode, other, texts = tf.ByteEncoder(path), Tokenizer.from_file(path), HARD + awkward_texts()[:20] + ["One Two  THREE's"]
    assert not encode.cuttable
    assert [ids.tolist() for ids in encode(pa.array(texts, pa.string()))] == [ids_of(other, t) for t in texts]


def expected(tokenizer, rows, end):
    start = 0
    for doc, text in rows:
        ids = np.array([*ids_of(tokenizer, text), end], dtype="<u4")
        yield doc, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


@pytest.mark.parametrize(("end", "size"), [(2, 64 << 20), (300, 2000)])
def test_files_round_trip(spark, tokenizer, end, size):
    """End id 300 needs 4 bytes an id; 2000 bytes a file makes many files."""
    path = Scratch(spark, "test").path("files")
    tf.write_tokens(awkward_docs(spark, extra=True), path, PATH, end, size)
    got = sorted(map(tuple, tf.read_documents(spark, path).collect()), key=lambda r: r[1])
    rows = sorted([(i, t) for i, t in enumerate(awkward_texts())] + [(5, awkward_texts()[5]), (0, None)], key=lambda r: r[0])
    assert got == list(expected(tokenizer, rows, end))


def test_bases_are_prefix_sums_and_files_are_mapped(spark, tokenizer):
    path = Scratch(spark, "test").path("files")
    tf.write_tokens(awkward_docs(spark), path, PATH, 2, 2000)
    bases = sorted(tf.file_bases(spark, path).collect(), key=lambda r: r["first_doc"])
    assert [b["base"] for b in bases] == np.cumsum([0] + [b["n_tokens"] for b in bases])[:-1].tolist()
    file = tf.TokenFile(bases[-1]["path"].removeprefix("file:"))
    assert isinstance(file.raw, np.memmap) and file.ids.dtype == np.uint16 and file.offsets.dtype == np.int64
    assert file[0].tolist() == [*ids_of(tokenizer, awkward_texts()[file.doc_ids[0]]), 2]
    fetched = tf.TokenFile(bytes(file.raw))
    assert (fetched.ids == file.ids).all() and (fetched.offsets == file.offsets).all()
    with pytest.raises(ValueError):
        tf.TokenFile(bytes(file.raw[:-8]) + b"12345678")


def test_null_ids_and_empty_tables(spark):
    path = Scratch(spark, "test").path("files")
    rows = [(None, "x"), (-4, "y"), (None, None), (7, "z")]
    tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH, 2, 10)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tf.read_documents(spark, path).collect())
    assert [r[1] for r in got] == [None, None, -4, 7] and sorted(r[2] for r in got[:2]) == [1, 2] and got[2][0] == 3
    other = Scratch(spark, "test").path("files")
    tf.write_tokens(empty_docs(spark), other, PATH, 2)
    assert tf.read_documents(spark, other).count() == 0


def test_sink_needs_an_ascii_separator(spark):
    with pytest.raises(ValueError):
        write_bytes(spark.range(1).selectExpr("cast('x' AS binary) AS value"), "value", "é", "unused")
