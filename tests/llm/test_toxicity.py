import random
import zlib

import numpy as np
import pyarrow as pa

from staffmatch.llm import toxicity_gru as g
from tests.llm.helpers import awkward_docs, awkward_texts, empty_docs, prose, vocabulary


def corpus(seed, n, bad=("zzbad", "qqvile")):
    rng, words = random.Random(seed), vocabulary(5, 2000)
    texts, labels = [], []
    for i in range(n):
        parts = prose(rng, words, rng.randint(5, 200)).split()
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            parts.insert(rng.randint(0, len(parts)), rng.choice(bad))
        texts.append(" ".join(parts))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_windows_cover_every_word_and_overlap():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 63, 64, 65, 96, 97, 300)]
    x = g.read(pa.array([None, *texts], pa.string()))
    words = [[] for _ in range(9)]
    for owner, idx, keep in zip(x.owner, x.idx, x.keep):
        words[owner].append(idx[keep].tolist())
    for n, windows in zip((0, 0, 1, 63, 64, 65, 96, 97, 300), words):
        assert len({w for one in windows for w in one}) == n
        assert all(len(w) == min(n, g.WINDOW) for w in windows)
        assert all(set(a) & set(b) for a, b in zip(windows, windows[1:]))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = g.Network.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    embedded = rng.normal(size=(7, g.WORD_DIM + g.CHAR_DIM))
    idx = rng.integers(0, 7, (3, 9))
    keep = np.arange(9) < np.array([[9], [4], [1]])
    idx[~keep] = 7
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.windows(net.project(embedded), idx, keep)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads, d_in = net.gradients(embedded, idx, keep, y)
    for table, grad in [*((net.p[k], grads[k]) for k in net.p), (embedded, d_in)]:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in table.shape)
            old, step = table[at], 1e-3
            table[at] = old + step
            up = loss()
            table[at] = old - step
            down = loss()
            table[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


def plain_score(net, words):
    """A window's score word by word, direction by direction, without arrays of windows."""
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    h, rows = g.HIDDEN, []
    for word in words:
        x = g.word_inputs(pa.array([word.encode()], pa.large_binary()))
        rows.append(np.concatenate([net.words[x.word[0]], net.chars[x.grams].max(axis=0)]).astype(np.float64))
    sides = []
    for side, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        now, seen = np.zeros(h), {}
        for t in order:
            x = rows[t] @ net.p[f"W{side}"] + net.p[f"b{side}"]
            u = net.p[f"U{side}"]
            z, r = sig(x[:h] + now @ u[:, :h]), sig(x[h:2 * h] + now @ u[:, h:2 * h])
            now = (1 - z) * now + z * np.tanh(x[2 * h:] + (r * now) @ u[:, 2 * h:])
            seen[t] = now
        sides.append(seen)
    states = [np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(words))]
    weights = np.exp([s @ net.p["a"] for s in states])
    pooled = sum(w * s for w, s in zip(weights / weights.sum(), states))
    return float(sig(pooled @ net.p["o"] + net.p["c"])[0])


def test_scores_equal_a_plain_forward_pass():
    net = g.train(*corpus(1, 200))
    texts, _ = corpus(3, 12)
    for text, score in zip(texts, g.text_scores(net, pa.array(texts))):
        words = text.lower().split()
        heads = range(0, max(len(words) - g.WINDOW, 0) + g.STRIDE, g.STRIDE)
        starts = [min(i, max(len(words) - g.WINDOW, 0)) for i in heads]
        assert abs(max(plain_score(net, words[i:i + g.WINDOW]) for i in starts) - score) < 1e-4


def test_nothing_but_gradients_moves_the_embeddings():
    texts, labels = corpus(1, 60)
    fresh, net = g.Network.fresh(np.random.default_rng(7)), g.train(texts, labels)
    seen = np.zeros(g.WORD_BUCKETS, dtype=bool)
    seen[g.read(pa.array(texts)).inputs.word] = True
    assert (net.words[~seen] == fresh.words[~seen]).all() and (net.words[seen] != fresh.words[seen]).any()


def test_a_network_is_built_again_from_what_was_learned():
    texts, labels = corpus(1, 60)
    net = g.train(texts, labels)
    learned = g.Learned.of(net)
    again = learned.network()
    assert (again.words == net.words).all() and (again.chars == net.chars).all() and all((again.p[k] == net.p[k]).all() for k in net.p)
    assert sum(a.nbytes for a in learned.arrays.values()) < (net.words.nbytes + net.chars.nbytes) / 4


def test_training_in_a_task_gives_the_network_of_the_same_texts(spark):
    texts, labels = corpus(4, 120)
    ids = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, texts[i]) for i in range(120)], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(i, int(labels[i])) for i in range(120)], "doc_id long, toxic int")
    plain = g.train([texts[i] for i in ids], labels[ids], float(labels[ids].mean()))
    learned = g.fit(docs, known)
    rows = {r["doc_id"]: r["score"] for r in g.score(docs, learned).collect()}
    assert np.allclose([rows[i] for i in range(120)], g.text_scores(plain, pa.array(texts)), atol=1e-5)


def test_training_texts_are_bounded_by_bytes(spark):
    assert g.within_bytes([("a", 1, 5), ("b", 0, 5), ("c", 1, 6), ("d", 1, 4), ("e", 0, 0)], 10) == ["a", "b", "d", "e"]
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(60)] * 2 + [(7, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net = g.fit(docs, labels, train_bytes=2000)
    assert g.score(docs, net).count() == 121


def test_learns_words_wherever_they_stand():
    net = g.train(*corpus(1, 800))
    texts, labels = corpus(2, 200)
    scores = g.text_scores(net, pa.array(texts))
    assert ((scores >= 0.5) == labels).mean() > 0.95
    clean = prose(random.Random(1), vocabulary(5, 2000), 3000).split()
    clean.insert(2500, "zzbad qqvile zzbad")
    assert g.text_scores(net, pa.array([" ".join(clean)]))[0] >= 0.5


def test_scores_do_not_depend_on_the_batch():
    net = g.train(*corpus(1, 120))
    texts = [t for t in awkward_texts()]
    together = g.text_scores(net, pa.array(texts, pa.string()))
    alone = [g.text_scores(net, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6) and together[0] == together[1] == together[2] == 0


def test_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 3 == 0)) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = g.score(docs, g.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward_docs(spark, extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    net = g.fit(docs, none)
    out = g.score(docs, net)
    assert sorted(out.columns) == sorted(docs.columns) and {r["predicted"] for r in out.collect()} == {0}
    only = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    assert {r["predicted"] for r in g.score(docs, g.fit(docs, only)).where("length(trim(text)) > 3").collect()} == {1}
    assert g.score(empty_docs(spark), net).count() == 0
