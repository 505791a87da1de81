"""Small tables with every awkward row, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random

import xxhash

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Nulls, nothing, white space, one word, copies, near copies, a shared passage, other scripts, and a long text."""
    rng, words = random.Random(3), vocabulary(1, 400)
    base = prose(rng, words, 120)
    passage = prose(rng, words, 30)
    texts: list[str | None] = [None, "", " \t\n ", "word", "12 34 !!", base, base, base, base.replace(" ", "\n", 1), base + " tail"]
    texts += [prose(rng, words, 40) + " " + passage + " " + prose(rng, words, rng.randint(0, 30)) for _ in range(8)]
    texts += ["ÄÖ größer Straße weit – “quoted” 日本語 テキスト 🙂", "a b  c\r\n\r\nd", "<|endoftext|> x <|endoftext|>", "▁x ▁ y"]
    texts += [prose(rng, words, n) for n in (1, 2, 3, 12, 13, 14, 60)]
    texts += [" ".join([passage] * 3), prose(rng, words, 6000)]
    return texts


def awkward_docs(spark, extra: bool = False):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 2}", len(t or "")) for i, t in enumerate(awkward_texts())]
    rows += [rows[5], rows[0]]  # repeated rows
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    if extra:
        for name in ("score", "predicted", "lang_pred", "kept", "component", "component_id", "fp", "n", "class", "spans",
                     "length", "part", "shard", "h", "pos", "seed", "copy_of", "n_words", "checks", "doc_key", "key", "path"):
            docs = docs.selectExpr("*", f"'other' AS {name}")
    return docs.repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def plain_simhash(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(items: list[int], linked) -> list[int]:
    """The index of the first item that each item reaches."""
    label = list(range(len(items)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(items))]


def plain_repeats(docs: list[tuple[int, str | None]], k: int) -> dict[int, tuple[int, int, str, list[bytes]]]:
    """Per id: words, removed words, digest and kept words; docs have distinct ids."""
    first: dict[bytes, int] = {}
    out = {}
    for doc, text in sorted(docs):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if first.setdefault(b" ".join(words[i:i + k]), doc) < doc:
                gone[i:i + k] = [True] * k
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc] = len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept
    return out
