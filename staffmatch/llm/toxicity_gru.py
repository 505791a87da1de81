"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

A word enters as the embedding of its hashed form and as the maximum over the embeddings of its hashed character
n-grams. A text is read in overlapping windows of WINDOW words, STRIDE apart, the last one flush with its end, and
its score is the largest window score. Training sees a bounded, labelled sample: first windows drawn at random, then
of every text the window that scores highest, and as many more of clean texts as half of these. Embeddings, recurrence,
attention and output are all learned by gradients from small random numbers; no counts of words enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staffmatch.llm.sampling import bounded_sample, held_out
from staffmatch.llm.words import pieces, split_words, text_bytes, word_codes

WINDOW, STRIDE = 64, 32
WORD_BUCKETS, GRAM_BUCKETS = 1 << 19, 1 << 18
GRAMS = (4, 5, 6)
WORD_DIM = CHAR_DIM = 8
HIDDEN = 16
#: Labelled texts of each class that training reads, about, and their bytes; parameters of `fit`.
TRAIN_DOCS, TRAIN_BYTES = 1500, 12 << 20
#: Bytes of the learned arrays that a row holds.
PART_BYTES = 1 << 20
#: Passes over the training texts, windows of the first one at the most, and step sizes of weights and embeddings.
EPOCHS, FIRST_WINDOWS, BATCH, RATE, INPUT_RATE = 4, 12_000, 64, 0.005, 0.1
THRESHOLD = 0.5
#: Sets the fresh network and the order of the training windows.
SEED = 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Inputs:
    """The distinct words of some texts: hashed form, and their n-grams' buckets one after the other."""

    word: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def word_inputs(distinct: pa.Array, step: int = 20_000) -> Inputs:
    """Hashed features of distinct lower-case words, `step` words at a time."""
    parts = [_some_inputs(distinct.slice(low, step)) for low in range(0, len(distinct), step)] or [_some_inputs(distinct)]
    shifts = np.cumsum([0] + [len(p.grams) for p in parts])
    return Inputs(np.concatenate([p.word for p in parts]), np.concatenate([p.grams for p in parts]),
                  np.concatenate([p.first + shift for p, shift in zip(parts, shifts)]))


def _some_inputs(distinct: pa.Array) -> Inputs:
    """Every word is marked by a byte at either end; the whole word counts as one n-gram more."""
    data, at = text_bytes(distinct)
    n, sizes = len(at) - 1, np.diff(at)
    padded = np.full(len(data) + 2 * n, 1, dtype=np.uint64)
    length = sizes + 2
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(n, dtype=np.int32), length)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1] = data
    rolling = np.zeros(len(padded), dtype=np.uint64)
    buckets, owners = [], []
    for width in range(1, max(GRAMS) + 1):
        reach = len(padded) - width + 1
        if reach <= 0:
            break
        rolling = (rolling[:reach] ^ (rolling[:reach] >> np.uint64(31))) * _MULT + padded[width - 1:]
        if width in GRAMS:
            whole = owner[:reach] == owner[width - 1:]
            mixed = ((rolling ^ (rolling >> np.uint64(29))) * _MULT)[whole]
            buckets.append((mixed >> np.uint64(40)).astype(np.int32) % GRAM_BUCKETS)
            owners.append(owner[:reach][whole])
    powers = np.cumprod(np.full(int(length.max()) if n else 1, 0xD1342543DE82EF95, dtype=np.uint64))
    place = np.arange(len(padded)) - np.repeat(begin, length)
    sums = np.add.reduceat((padded + np.uint64(7)) * powers[place], begin) if n else np.zeros(0, dtype=np.uint64)
    sums = (sums ^ (sums >> np.uint64(32))) * _MULT
    buckets.append((sums >> np.uint64(34)).astype(np.int32) % GRAM_BUCKETS)
    owners.append(np.arange(n, dtype=np.int32))
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=n)
    return Inputs((sums >> np.uint64(44)).astype(np.int32) % WORD_BUCKETS, np.concatenate(buckets)[order], np.cumsum(counts) - counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Embeddings per bucket, and the weights of both directions, attention and output."""

    words: np.ndarray
    chars: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> "Network":
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {}
        for side in "fb":
            p[f"W{side}"] = rng.normal(0, 0.4, (d, 3 * h)).astype(np.float32)
            p[f"U{side}"] = rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            p[f"b{side}"] = np.zeros(3 * h, dtype=np.float32)
        p |= {"a": rng.normal(0, 0.3, 2 * h).astype(np.float32), "o": rng.normal(0, 1, 2 * h).astype(np.float32),
              "c": np.full(1, -0.5, dtype=np.float32)}
        return cls(rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIM)).astype(np.float32),
                   rng.normal(0, 0.05, (GRAM_BUCKETS, CHAR_DIM)).astype(np.float32), p)

    def embed(self, x: Inputs) -> np.ndarray:
        """One row per distinct word: word embedding, then the maximum of its n-grams' embeddings."""
        if not len(x.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), dtype=np.float32)
        return np.hstack([self.words[x.word], np.maximum.reduceat(self.chars[x.grams], x.first, axis=0)])

    def _side(self, side: str, proj: np.ndarray, idx: np.ndarray, keep: np.ndarray | None, cache: list | None):
        """Hidden states in reading order of one direction; proj: input part per distinct word, with the bias."""
        h, u = HIDDEN, self.p[f"U{side}"]
        states = np.zeros((idx.shape[1], len(idx), h), dtype=np.float32)
        now = np.zeros((len(idx), h), dtype=np.float32)
        steps = range(idx.shape[1]) if side == "f" else range(idx.shape[1] - 1, -1, -1)
        for t in steps:
            x = proj[idx[:, t]]
            gates = _sigmoid(x[:, :2 * h] + now @ u[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            cand = np.tanh(x[:, 2 * h:] + (r * now) @ u[:, 2 * h:])
            new = now + z * (cand - now)
            if keep is not None:
                new = np.where(keep[:, t, None], new, now)
            if cache is not None:
                cache.append((t, now, z, r, cand))
            states[t] = now = new
        return states

    def windows(self, proj: dict[str, np.ndarray], idx: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        """Scores of windows: rows of word numbers; keep: False where a window has no word."""
        states = np.concatenate([self._side(s, proj[s], idx, keep, None) for s in "fb"], axis=2)
        attention = states @ self.p["a"]
        if keep is not None:
            attention = np.where(keep.T, attention, -1e9)
        attention = np.exp(attention - attention.max(axis=0))
        attention /= attention.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", attention, states)
        return _sigmoid(pooled @ self.p["o"] + self.p["c"])

    def project(self, embedded: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates for every distinct word, and a last row for no word."""
        rows = np.vstack([embedded, np.zeros((1, WORD_DIM + CHAR_DIM), dtype=np.float32)])
        return {s: rows @ self.p[f"W{s}"] + self.p[f"b{s}"] for s in "fb"}

    def gradients(self, embedded: np.ndarray, idx: np.ndarray, keep: np.ndarray, y: np.ndarray):
        """Gradients of the mean log loss by parameter, and by embedded word."""
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        proj, caches = self.project(embedded), {"f": [], "b": []}
        states = np.concatenate([self._side(s, proj[s], idx, keep, caches[s]) for s in "fb"], axis=2)
        logits = np.where(keep.T, states @ self.p["a"], -1e9)
        att = np.exp(logits - logits.max(axis=0))
        att /= att.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", att, states)
        score = _sigmoid(pooled @ self.p["o"] + self.p["c"])
        top = ((score - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = pooled.T @ top, top.sum(keepdims=True)
        d_pooled = top[:, None] * self.p["o"]
        d_states = att[:, :, None] * d_pooled
        d_att = att * ((states * d_pooled).sum(axis=2) - (pooled * d_pooled).sum(axis=1))
        g["a"] = np.einsum("tn,tnh->h", d_att, states)
        d_states += d_att[:, :, None] * self.p["a"]
        d_embedded = np.zeros((len(embedded) + 1, embedded.shape[1]), dtype=np.float32)
        by_word = np.argsort(idx, axis=None, kind="stable")
        flat = idx.ravel()[by_word]
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        for place, side in enumerate("fb"):
            u, w = self.p[f"U{side}"], self.p[f"W{side}"]
            flow = np.zeros((len(idx), h), dtype=np.float32)
            d_gate = np.zeros((*idx.shape, 3 * h), dtype=np.float32)
            for t, before, z, r, cand in reversed(caches[side]):
                flow = flow + d_states[t][:, place * h:(place + 1) * h]
                alive = keep[:, t, None]
                d_new = np.where(alive, flow, 0)
                d_cand = d_new * z * (1 - cand * cand)
                d_rh = d_cand @ u[:, 2 * h:].T
                d_gates = np.hstack([d_new * (cand - before) * z * (1 - z), d_rh * before * r * (1 - r)])
                g[f"U{side}"][:, 2 * h:] += (r * before).T @ d_cand
                g[f"U{side}"][:, :2 * h] += before.T @ d_gates
                d_gate[:, t, :2 * h], d_gate[:, t, 2 * h:] = d_gates, d_cand
                flow = np.where(alive, d_new * (1 - z) + d_rh * r + d_gates @ u[:, :2 * h].T, flow)
            d_x = np.zeros((len(embedded) + 1, 3 * h), dtype=np.float32)
            d_x[flat[heads]] = np.add.reduceat(d_gate.reshape(-1, 3 * h)[by_word], heads, axis=0)
            g[f"W{side}"] = embedded.T @ d_x[:-1]
            g[f"b{side}"] = d_x.sum(axis=0)
            d_embedded += d_x @ w.T
        return g, d_embedded[:-1]


@dataclass
class Learned:
    """What training from the fresh network of SEED changed: all weights, and the buckets whose embeddings moved.

    A few megabytes at most instead of whole tables; `network` builds these again where they are used.
    """

    arrays: dict[str, np.ndarray]

    @classmethod
    def of(cls, net: Network) -> "Learned":
        fresh, arrays = Network.fresh(np.random.default_rng(SEED)), dict(net.p)
        for name, table, before in (("words", net.words, fresh.words), ("chars", net.chars, fresh.chars)):
            at = np.flatnonzero((table != before).any(axis=1)).astype(np.int32)
            arrays |= {f"{name}_at": at, name: table[at]}
        return cls(arrays)

    def network(self) -> Network:
        net = Network.fresh(np.random.default_rng(SEED))
        net.words[self.arrays["words_at"]] = self.arrays["words"]
        net.chars[self.arrays["chars_at"]] = self.arrays["chars"]
        net.p = {k: self.arrays[k] for k in net.p}
        return net


@dataclass
class Reading:
    """Windows over the words of some texts."""

    inputs: Inputs
    idx: np.ndarray
    keep: np.ndarray
    owner: np.ndarray
    n_texts: int


def read(column: pa.Array) -> Reading:
    """All windows of all texts. Texts without a word have none."""
    data, rows = text_bytes(column)
    words, starts = split_words(pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [
        None, pa.py_buffer(rows), pa.py_buffer(_LOWER[data])]))
    codes, distinct = word_codes(words)
    counts = np.diff(starts)
    many = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)))
    owner = np.repeat(np.arange(len(counts)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    head = np.minimum(number * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    keep = np.arange(WINDOW, dtype=np.int32) < (counts[owner] - head)[:, None]
    padded = np.append(codes, len(distinct)).astype(np.int32)
    idx = np.full(keep.shape, len(codes), dtype=np.int64)
    np.add((starts[:-1][owner] + head)[:, None], np.arange(WINDOW), out=idx, where=keep)
    idx = padded[idx]
    return Reading(word_inputs(distinct), idx, keep, owner, len(counts))


def window_scores(net: Network, x: Reading) -> np.ndarray:
    """Full windows run without masks, the others (short texts) with them."""
    out = np.zeros(len(x.idx), dtype=np.float64)
    if len(x.idx):
        proj, full = net.project(net.embed(x.inputs)), x.keep[:, -1]
        for rows, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for low in range(0, len(rows), 4096):
                part = rows[low:low + 4096]
                out[part] = net.windows(proj, x.idx[part], x.keep[part] if masked else None)
    return out


def text_scores(net: Network, column: pa.Array) -> np.ndarray:
    """The largest window score of every text; 0 without words."""
    x = read(column)
    scores = np.zeros(x.n_texts)
    np.maximum.at(scores, x.owner, window_scores(net, x))
    return scores


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions first[i], first[i] + 1, ... first[i] + counts[i] - 1 for every i."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


class Learner:
    """Gradient steps: weights by moments that forget, embeddings by the sum of squares a coordinate has seen."""

    def __init__(self, net: Network) -> None:
        self.net, self.steps = net, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        self.word_squares = np.zeros(WORD_BUCKETS, dtype=np.float32)
        self.char_squares = np.zeros(GRAM_BUCKETS * CHAR_DIM, dtype=np.float32)

    def weights(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, v in gradients.items():
            mean, square = self.moments[k]
            mean += 0.1 * (v - mean)
            square += 0.01 * (v * v - square)
            change = mean / (1 - 0.9 ** self.steps) / (np.sqrt(square / (1 - 0.99 ** self.steps)) + 1e-7)
            self.net.p[k] -= (RATE * change).astype(np.float32)

    def inputs(self, x: Inputs, embedded: np.ndarray, counts: np.ndarray, d_in: np.ndarray) -> None:
        """A step on the embeddings of the words of `x`; of n-grams, those that gave the maximum."""
        buckets, at = np.unique(x.word, return_inverse=True)
        total = np.zeros((len(buckets), WORD_DIM), dtype=np.float32)
        np.add.at(total, at, d_in[:, :WORD_DIM])
        self.word_squares[buckets] += (total * total).mean(axis=1)
        self.net.words[buckets] -= INPUT_RATE * total / (np.sqrt(self.word_squares[buckets])[:, None] + 1e-6)
        owner = np.repeat(np.arange(len(x.word)), counts)
        gram, dim = np.nonzero(self.net.chars[x.grams] == embedded[owner][:, WORD_DIM:])
        places, at = np.unique(x.grams[gram].astype(np.int64) * CHAR_DIM + dim, return_inverse=True)
        total = np.bincount(at, weights=d_in[owner[gram], WORD_DIM + dim], minlength=len(places)).astype(np.float32)
        self.char_squares[places] += total * total
        self.net.chars.ravel()[places] -= INPUT_RATE * total / (np.sqrt(self.char_squares[places]) + 1e-6)


def train(texts: pa.Array | list[str], labels: np.ndarray, toxic_share: float | None = None, seed: int = SEED) -> Network:
    """Fit a network on labelled texts; deterministic for a given order of the texts.

    `toxic_share` is the share of class 1 where the network will be used; the output is shifted from the sample's
    share to that.
    """
    rng = np.random.default_rng(seed)
    x = read(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    y = labels.astype(np.float64)
    net = Network.fresh(rng)
    if not len(x.idx) or y.min() == y.max():
        net.p["o"][:], net.p["c"][:] = 0, 4.0 if len(y) and y.min() == 1 else -4.0
        return net
    learner = Learner(net)
    first, counts = x.inputs.first, np.diff(np.append(x.inputs.first, len(x.inputs.grams)))
    for epoch in range(EPOCHS):
        if epoch == 0:
            chosen = rng.permutation(len(x.idx))[:FIRST_WINDOWS]
        else:
            order = np.lexsort((window_scores(net, x), x.owner))
            best = order[np.append(x.owner[order][1:] != x.owner[order][:-1], True)]
            clean = rng.permutation(np.flatnonzero(y[x.owner] == 0))[:len(best) // 2]
            chosen = rng.permutation(np.concatenate([best, clean]))
        for low in range(0, len(chosen), BATCH):
            rows = chosen[low:low + BATCH]
            used, local = np.unique(x.idx[rows], return_inverse=True)
            used = used[used < len(x.inputs.word)]
            own = Inputs(x.inputs.word[used], x.inputs.grams[_spread(first[used], counts[used])],
                         np.cumsum(counts[used]) - counts[used])
            embedded = net.embed(own)
            gradients, d_in = net.gradients(embedded, local.reshape(len(rows), WINDOW), x.keep[rows], y[x.owner[rows]])
            learner.weights(gradients)
            learner.inputs(own, embedded, counts[used], d_in)
    if toxic_share is not None:
        odds = lambda share: np.log(share / (1 - share))
        net.p["c"] += np.float32(odds(np.clip(toxic_share, 1e-3, 1 - 1e-3)) - odds(y.mean()))
    return net


def within_bytes(sizes: list[tuple], most: int) -> list:
    """Ids of (id, class, bytes) as they come, those that would take their class over `most` bytes left out."""
    taken, used = [], {}
    for name, label, size in sizes:
        if used.get(label, 0) + size <= most:
            used[label] = used.get(label, 0) + size
            taken.append(name)
    return taken


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Learned:
    """Learn `labels.toxic` from about `train_docs` whole texts and `train_bytes` of each class at the most.

    The texts, bounded by their bytes, meet in one task, so that the driver sees what was learned alone. Held-out ids are
    never read. Of several texts under one id the shortest is taken, of these the first in order.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, clean = known.where("toxic = 1"), known.where("toxic <> 1")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    chosen = bounded_sample(toxic, "doc_id", train_docs).unionByName(bounded_sample(clean, "doc_id", train_docs))
    size = F.octet_length("text").cast("long")
    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= train_bytes))
            .join(chosen, "doc_id").groupBy("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
            .agg(F.min(F.struct(size.alias("size"), "text")).alias("least")).persist())
    sizes = rows.select("doc_id", "toxic", "least.size").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken = within_bytes([tuple(r) for r in sizes], train_bytes)
    texts = rows.where(F.col("doc_id").isin(taken)).select("doc_id", "toxic", "least.text")
    made = (texts.repartition(1).sortWithinPartitions("doc_id")
            .mapInArrow(_trained(share), "name string, kind string, shape array<int>, place int, data binary").toArrow())
    rows.unpersist()
    if not made.num_rows:
        return Learned.of(train(pa.array([], pa.large_string()), np.zeros(0)))
    parts: dict[str, list] = {}
    for r in sorted(made.to_pylist(), key=lambda r: (r["name"], r["place"])):
        parts.setdefault(r["name"], []).append(r)
    return Learned({name: np.frombuffer(b"".join(r["data"] for r in found), dtype=found[0]["kind"]).reshape(found[0]["shape"])
                    for name, found in parts.items()})


def _trained(share: float | None):
    """One task trains on the bounded texts; rows of the bytes of every array learned, PART_BYTES each at the most.

    Given the same rows it learns the same.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        net = train(table.column("text").cast(pa.large_string()).combine_chunks(), table.column("toxic").to_numpy(), share)
        for name, values in Learned.of(net).arrays.items():
            raw = values.tobytes()
            for place, low in enumerate(range(0, max(len(raw), 1), PART_BYTES)):
                yield pa.RecordBatch.from_pylist(
                    [{"name": name, "kind": values.dtype.str, "shape": list(values.shape), "place": place,
                      "data": raw[low:low + PART_BYTES]}],
                    pa.schema({"name": pa.string(), "kind": pa.string(), "shape": pa.list_(pa.int32()), "place": pa.int32(),
                               "data": pa.binary()}))
    return run


def _scored(shared) -> callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        net = shared.value.network()
        for batch in pieces(batches, "text", 1 << 20):
            scores = text_scores(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])
    return run


def score(docs: DataFrame, net: Learned) -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) of the whole text and `predicted` (1 if score >= THRESHOLD).

    A column of `docs` with one of these two names is replaced. Null, empty and wordless texts score 0. Without
    labels of both classes every text with words gets the same score. Rows, repeated or not, come out once each.
    """
    source = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return (source.mapInArrow(_scored(shared), StructType([*source.schema.fields]).add("score", "double"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
