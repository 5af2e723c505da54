"""Toxicity scores from a bidirectional gated recurrent network over character and word inputs, trained in numpy.

A token's input is the embedding of its hashed word next to the mean embedding of its hashed character 3- to 5-grams.
Two gated recurrent layers read a window of `WINDOW` tokens in both directions, a learned query weighs the states
(attention pooling), and one output unit scores the window. All overlapping windows of a text are scored and the
highest decides.

Labels belong to documents, so training first has to find the windows they speak of: document frequencies of words
and grams among the labelled rows point to the most telling window of each document, the network is trained on these
and on random windows of clean documents, then scores all windows of the sample, and is trained further on the highest
of each document. A logistic scale on the sample's highest scores makes the result a probability.

The training sample is bounded: `MAX_LABELLED` different rows of the clean and the toxic class, chosen by a hash of id
and text; of a text longer than `MAX_TRAIN_CHARS` characters it takes so many from a hash-random place. Scores cover
whole texts of any length. Tokens are split at white space; characters of scripts without blanks are tokens of their own.

Defined cases: rows that repeat id and text are one row of the sample; null and blank texts get the score of an empty window; without rows of both classes the score is the
share of toxic labels, or 0.5 without any; rows with a null label train nothing; a document with labels that differ
counts once for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import spaced

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM = 16, 16, 16
BUCKETS = 1 << 13
SEEDING = 1 << 20
MAX_LABELLED = (4000, 1500)
MAX_TRAIN_CHARS = 200_000
KNOWN_TOKENS = 150_000
#: Windows that the first training passes visit, epochs times windows.
VISITS = 14_000
BATCH = 2048
#: Score from which a text counts as toxic.
THRESHOLD = 0.3


def normal(token: str) -> str:
    """Lower case without what is neither letter nor digit at the ends; the token itself if nothing is left."""
    low = token.lower()
    if low[0].isalnum() and low[-1].isalnum():
        return low
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b] or low


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash of each token; hashes of all its character grams, and where each token's grams start."""
    raw = [f"^{t}$".encode("utf-8", "surrogatepass") for t in tokens]
    words = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends, n = np.cumsum(sizes), int(sizes.sum())
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = ends[owner] - np.arange(n)
    grams, of = [], []
    packed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(5):
            packed = packed << np.uint64(8) | data[k : k + n]
            if k >= 2:
                fits = left > k
                h = (packed[fits] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                grams.append((h >> np.uint64(32)).astype(np.uint32))
                of.append(owner[fits])
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return words, grams[order], np.searchsorted(of[order], np.arange(len(raw)))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def window_starts(n: int) -> np.ndarray:
    """First tokens of the overlapping windows that cover n tokens."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


class Network:
    """The weights, and forward and backward passes over (inputs, lengths) of a batch of windows."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "word": make(BUCKETS, WORD_DIM, scale=0.3), "char": make(BUCKETS, CHAR_DIM, scale=0.6), "x": make(WORD_DIM + CHAR_DIM, 6 * h, scale=0.3), "bx": np.zeros(6 * h, np.float32),
            "u": make(2, h, 3 * h, scale=0.25), "attend": make(2 * h, scale=0.3), "out": make(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])

    def embed(self, words: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Input vectors of tokens from their features."""
        sums = np.add.reduceat(self.w["char"][grams % BUCKETS], starts, axis=0)
        many = np.diff(np.append(starts, len(grams))).astype(np.float32)
        return np.concatenate([self.w["word"][words % BUCKETS], sums / np.sqrt(many)[:, None]], axis=1)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.w["x"] + self.w["bx"]

    def forward(self, inputs: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows; inputs (batch, time, 6 * HIDDEN) are projected, lengths count real tokens."""
        b, t, _ = inputs.shape
        h = HIDDEN
        both = np.ascontiguousarray(inputs.reshape(b, t, 2, 3 * h).transpose(1, 2, 0, 3))  # time, direction, batch
        short = bool((lengths < t).any())
        real = (np.arange(t)[:, None] < lengths[None, :]).astype(np.float32)[:, :, None] if short else None
        state = np.zeros((2, b, h), np.float32)
        states = np.empty((t, 2, b, h), np.float32)
        memory = []
        step_in = np.empty((2, b, 3 * h), np.float32)
        for i in range(t):
            step_in[0], step_in[1] = both[i, 0], both[t - 1 - i, 1]
            a = np.matmul(state, self.w["u"])
            gates = step_in[:, :, : 2 * h] + a[:, :, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :, :h], gates[:, :, h:]
            n = np.tanh(step_in[:, :, 2 * h :] + r * a[:, :, 2 * h :])
            new = n + z * (state - n)
            if short:
                m = np.stack([real[i], real[t - 1 - i]])
                new = m * new + (1 - m) * state
            if keep:
                memory.append((state, z, r, n, a[:, :, 2 * h :], m if short else None))
            state = new
            states[i, 0], states[t - 1 - i, 1] = state[0], state[1]
        query = self.w["attend"].reshape(2, h)
        e = np.einsum("tdbh,dh->tb", states, query)
        if short:
            e = np.where(real[:, :, 0] > 0, e, -1e9)
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        pooled = np.einsum("tb,tdbh->bdh", e, states).reshape(b, 2 * h)
        logits = pooled @ self.w["out"] + self.w["bias"][0]
        return (logits, (states, e, pooled, memory)) if keep else logits

    def backward(self, kept, d_logits: np.ndarray) -> tuple[np.ndarray, dict]:
        """Gradient of the projected inputs and of the weights, from that of the logits."""
        states, e, pooled, memory = kept
        t, _, b, h = states.shape
        g = {"out": pooled.T @ d_logits, "bias": np.array([d_logits.sum()], np.float32)}
        d_pool = (d_logits[:, None] * self.w["out"][None, :]).reshape(b, 2, h)
        d_e = np.einsum("bdh,tdbh->tb", d_pool, states)
        d_score = e * (d_e - (e * d_e).sum(axis=0))
        query = self.w["attend"].reshape(2, h)
        g["attend"] = np.einsum("tb,tdbh->dh", d_score, states).ravel()
        d_states = np.einsum("tb,bdh->tdbh", e, d_pool) + np.einsum("tb,dh->tdbh", d_score, query)
        d_in = np.zeros((t, 2, b, 3 * h), np.float32)
        d_u = np.zeros_like(self.w["u"])
        d_state = np.zeros((2, b, h), np.float32)
        for i in reversed(range(t)):
            state, z, r, n, an, m = memory[i]
            d = d_state + np.stack([d_states[i, 0], d_states[t - 1 - i, 1]])
            carry = 0
            if m is not None:
                carry, d = (1 - m) * d, m * d
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (state - n) * z * (1 - z)
            d_r = d_n * an * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n * r], axis=2)
            d_u += np.matmul(state.transpose(0, 2, 1), d_a)
            d_state = carry + d * z + np.matmul(d_a, self.w["u"].transpose(0, 2, 1))
            d_x = np.concatenate([d_z, d_r, d_n], axis=2)
            d_in[i, 0], d_in[t - 1 - i, 1] = d_x[0], d_x[1]
        g["u"] = d_u
        return d_in.transpose(2, 0, 1, 3).reshape(b, t, 6 * h), g


class _Adam:
    def __init__(self, weights: dict, rate: float):
        self.w, self.rate, self.n = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        self.n += 1
        for k, g in grads.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            self.m[k][rows] = m = 0.9 * self.m[k][rows] + 0.1 * g
            self.v[k][rows] = v = 0.99 * self.v[k][rows] + 0.01 * g * g
            self.w[k][rows] -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-6)


class _Sample:
    """Labelled texts as token numbers, with the features of every different token."""

    def __init__(self, texts: list[str | None], labels: np.ndarray):
        known: dict[str, int] = {}
        self.docs = [np.array([known.setdefault(normal(t), len(known)) for t in spaced(text or "").split()], np.int32) for text in texts]
        self.labels = labels
        names, parts = list(known), []
        for at in range(0, len(names), 20_000):  # in pieces: the working arrays are many times the tokens
            parts.append(features(names[at : at + 20_000]))
        self.words = np.concatenate([np.zeros(0, np.uint32), *[w for w, *_ in parts]])
        self.grams = np.concatenate([np.zeros(0, np.uint32), *[g for _, g, _ in parts]])
        self.many = np.concatenate([np.zeros(0, np.int64), *[np.diff(np.append(s, len(g))) for _, g, s in parts]])
        self.starts = np.cumsum(self.many) - self.many

    def grams_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams of some tokens, where each token's start among them, and how many each has."""
        many = self.many[tokens]
        offsets = np.cumsum(many) - many
        return self.grams[np.repeat(self.starts[tokens] - offsets, many) + np.arange(many.sum())], offsets, many

    def token_evidence(self) -> np.ndarray:
        """For each token the highest log odds of its word and grams, from document frequencies."""
        toxic = self.labels.sum()
        found = np.zeros((2, SEEDING), np.float32)
        for doc, label in zip(self.docs, self.labels, strict=True):
            if len(doc):
                tokens = np.unique(doc)
                found[label, np.unique(np.concatenate([self.words[tokens], self.grams_of(tokens)[0]]) % SEEDING)] += 1
        p, q = (found[1] + 0.05) / (toxic + 0.1), (found[0] + 0.5) / (len(self.labels) - toxic + 1)
        odds = np.log(p / q) * np.minimum(found[1], 3) / 3
        if not len(self.words):
            return np.zeros(0, np.float32)
        return np.maximum(odds[self.words % SEEDING], np.maximum.reduceat(odds[self.grams % SEEDING], self.starts))

    def window(self, doc: int, start: int) -> np.ndarray:
        return self.docs[doc][start : start + WINDOW]


def _batch(network: Network, sample: _Sample, windows: list[np.ndarray]):
    """Inputs of a batch of windows, and what is needed to carry gradients back to the embeddings."""
    lengths = np.array([len(w) for w in windows])
    tokens, back = np.unique(np.concatenate(windows), return_inverse=True)
    grams, offsets, many = sample.grams_of(tokens)
    vectors = network.embed(sample.words[tokens], grams, offsets)
    table = np.concatenate([network.project(vectors), np.zeros((1, 6 * HIDDEN), np.float32)])
    index = np.full((len(windows), WINDOW), len(tokens))
    index[np.arange(WINDOW)[None, :] < lengths[:, None]] = back
    return table[index], np.maximum(lengths, 1), (tokens, grams, offsets, many, vectors, index)


def _train(network: Network, sample: _Sample, windows: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, rng) -> None:
    adam = _Adam(network.w, rate)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    weight = np.sqrt(weight)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            inputs, lengths, (tokens, grams, offsets, many, vectors, index) = _batch(network, sample, [windows[i] for i in pick])
            logits, kept = network.forward(inputs, lengths, keep=True)
            d_logits = ((_sigmoid(logits) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_inputs, grads = network.backward(kept, d_logits)
            d_table = np.zeros((len(tokens) + 1, 6 * HIDDEN), np.float32)
            np.add.at(d_table, index.ravel(), d_inputs.reshape(-1, 6 * HIDDEN))
            d_table = d_table[:-1]
            grads["x"], grads["bx"] = vectors.T @ d_table, d_table.sum(axis=0)
            d_vectors = d_table @ network.w["x"].T
            rows, back = np.unique(sample.words[tokens] % BUCKETS, return_inverse=True)
            d_word = np.zeros((len(rows), WORD_DIM), np.float32)
            np.add.at(d_word, back, d_vectors[:, :WORD_DIM])
            grads["word"] = (rows, d_word)
            rows, back = np.unique(grams % BUCKETS, return_inverse=True)
            d_char = np.zeros((len(rows), CHAR_DIM), np.float32)
            np.add.at(d_char, back, np.repeat(d_vectors[:, WORD_DIM:] / np.sqrt(many.astype(np.float32))[:, None], many, axis=0))
            grads["char"] = (rows, d_char)
            norm = np.sqrt(sum(float((g[1] if isinstance(g, tuple) else g).ravel() @ (g[1] if isinstance(g, tuple) else g).ravel()) for g in grads.values()))
            if norm > 1:
                grads = {k: (g[0], g[1] / norm) if isinstance(g, tuple) else g / norm for k, g in grads.items()}
            adam.step(grads)


def _highest(network: Network, sample: _Sample) -> tuple[np.ndarray, np.ndarray]:
    """For each document its highest window logit and that window's first token."""
    best, spot = np.full(len(sample.docs), -np.inf), np.zeros(len(sample.docs), np.int64)
    pairs = [(d, int(s)) for d, doc in enumerate(sample.docs) for s in window_starts(len(doc))]
    for at in range(0, len(pairs), BATCH // 2):
        part = pairs[at : at + BATCH // 2]
        inputs, lengths, _ = _batch(network, sample, [sample.window(d, s) for d, s in part])
        for (d, s), logit in zip(part, network.forward(inputs, lengths).tolist(), strict=True):
            if logit > best[d]:
                best[d], spot[d] = logit, s
    return best, spot


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 5) -> Network:
    """A network from labelled texts. With one class only, its score is constant."""
    network = Network(seed)
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        p = min(1.0, max(0.0, float(labels.mean()))) if len(labels) else 0.5
        network.scale = np.array([0.0, np.log((p + 1e-4) / (1 - p + 1e-4))])
        return network
    rng = np.random.default_rng(seed)
    sample = _Sample(texts, labels)
    evidence = sample.token_evidence()
    windows, marks = [], []
    for d, doc in enumerate(sample.docs):
        starts = window_starts(len(doc))
        told = np.array([evidence[doc[s : s + WINDOW]].max() if len(doc) else 0.0 for s in starts])
        top = int(told.argmax())
        windows.append(sample.window(d, starts[top]))
        marks.append(labels[d])
        if labels[d] == 1 and len(doc) > WINDOW:  # the same token at other places of a window
            spot = int(starts[top] + evidence[windows[-1]].argmax())
            for _ in range(2):
                s = int(np.clip(spot - rng.integers(0, WINDOW), 0, len(doc) - WINDOW))
                windows.append(sample.window(d, s))
                marks.append(1)
        if labels[d] == 0:
            windows.append(sample.window(d, rng.choice(starts)))
            marks.append(0)
    marks = np.array(marks)
    epochs = int(np.clip(VISITS // len(windows), 1, 40))
    _train(network, sample, windows, marks, epochs, 4e-3, rng)
    for _ in range(2):
        _, spots = _highest(network, sample)
        windows += [sample.window(d, s) for d, s in enumerate(spots)]
        marks = np.concatenate([marks, labels])
        _train(network, sample, windows, marks, max(1, epochs // 4), 2e-3, rng)
    best, _ = _highest(network, sample)
    x, y = np.clip(best, -12, 12), labels
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of a logistic fit with a prior that keeps it finite
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        hess = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    network.scale = np.array([max(a, 0.05), b])
    return network


class Scorer:
    """Scores texts with a trained network; keeps the projected inputs of tokens it has met, up to a bound."""

    def __init__(self, network: Network):
        self.network = network
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)  # row 0 is the empty token

    def _rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_TOKENS:
            self.known, self.table = {}, self.table[:1].copy()
        known = self.known
        found = [known.get(t) for t in tokens]
        new = list({t for t, f in zip(tokens, found, strict=True) if f is None})
        if new:
            self.add(new)
            found = [known[t] for t in tokens]
        return np.array(found, np.int32)

    def add(self, new: list[str]) -> None:
        base = len(self.known) + 1
        while len(self.table) < base + len(new):
            self.table = np.concatenate([self.table, np.zeros((max(8192, len(self.table)), 6 * HIDDEN), np.float32)])
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.table[base + a : base + a + len(part)] = self.network.project(self.network.embed(*features([normal(t) for t in part])))
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        at, tokens, sizes, room = 0, [], [], 0
        for i, text in enumerate(texts):
            own = spaced(text).split() if text else []
            tokens += own
            sizes.append(len(own))
            room += len(own)
            if room > 40_000 or i == len(texts) - 1:
                best[at : i + 1] = self._part(tokens, sizes)
                at, tokens, sizes, room = i + 1, [], [], 0
        a, b = self.network.scale
        return 1 / (1 + np.exp(-np.clip(a * np.clip(best, -12, 12) + b, -30, 30)))

    def _part(self, tokens: list[str], sizes: list[int]) -> np.ndarray:
        rows = self._rows(tokens)
        begins = np.cumsum(sizes) - sizes
        owner = np.concatenate([np.full(len(window_starts(n)), d) for d, n in enumerate(sizes)])
        starts = np.concatenate([window_starts(n) + b for n, b in zip(sizes, begins, strict=True)])
        lengths = np.minimum(np.array(sizes)[owner], WINDOW)
        rows = np.append(rows, np.zeros(WINDOW, np.int32))
        order = np.argsort(lengths == WINDOW, kind="stable")  # short windows together: only they need masks
        out = np.empty(len(order))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            index = rows[starts[pick][:, None] + np.arange(WINDOW)[None, :]]
            index = np.where(np.arange(WINDOW)[None, :] < lengths[pick][:, None], index, 0)
            out[pick] = self.network.forward(self.table[index], np.maximum(lengths[pick], 1))
        best = np.full(len(sizes), -np.inf)
        np.maximum.at(best, owner, out)
        return best


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = MAX_LABELLED) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of at most `most` different rows of each class (clean, toxic), the first by a hash of id and text."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_label in (0, 1)").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.xxhash64(F.lit(3), "_id", F.col("_text")))
    keys = rows.select("_id", "_key").join(marks, "_id").distinct()  # texts stay behind until the sample is known
    picked = [keys.filter(F.col("_label") == label).orderBy("_key").limit(most[label]) for label in (0, 1)]
    place = F.pmod("_key", F.greatest(F.length("_text") - MAX_TRAIN_CHARS, F.lit(0)) + 1) + 1
    rows = rows.withColumn("_text", F.when(F.length("_text") > MAX_TRAIN_CHARS, F.substring("_text", place, F.lit(MAX_TRAIN_CHARS))).otherwise(F.col("_text")))
    # copies of a row are folded where they are read
    got = rows.join(F.broadcast(picked[0].unionByName(picked[1])), ["_id", "_key"]).groupBy("_key", "_label").agg(F.first("_text").alias("_text")).toPandas()
    got = got.sort_values(["_label", "_key"], kind="stable")
    return got["_text"].tolist(), got["_label"].to_numpy()


def score_column(network: Network, spark, text):
    """A column of scores for a text column."""
    shared = spark.sparkContext.broadcast((network.w, network.scale))
    held: list[Scorer] = []

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            net = Network.__new__(Network)
            net.w, net.scale = shared.value
            held.append(Scorer(net))
        for part in texts:
            yield pa.array(held[0].scores(part.to_pylist()), pa.float64())

    return score(text)


def score_documents(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), score_column(network, docs.sparkSession, F.col(text_col).cast("string")).alias("score"))
