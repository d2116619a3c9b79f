"""Quality classifier: attention-based multiple-instance learning over the passages of a text, trained in numpy.

A text is a bag of passages of PASSAGE words. Every passage is encoded from the mean of its words' hashed embeddings (the
word, its affixes and its shape) and from counts over the passage; a gate learns from document labels alone how much each
passage weighs, and the weighted passage representation is scored. The whole text is read, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame

from declq.llm import nn
from declq.llm.common import held_out

PASSAGE = 64
BITS, DIM, STATS, HIDDEN, GATE = 14, 16, 7, 24, 12
BATCH, RATE, SEED = 32, 0.05, 5
#: Rows that training sees in all; passes over the sample at least and at most.
SEEN, LEAST_PASSES, MOST_PASSES = 24_000, 8, 32
#: Score from which a document is kept; the best cut of the calibration slice is moved there.
KEEP_AT = 0.7
#: Class of each byte in a word's shape: 0 capital, 1 other letter (or part of one), 2 digit, else the symbol itself.
_SHAPE = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def word_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (rows: word and affixes in lower case, shape) and counts of each word: bytes, capitals, digits, symbols."""
    if not words:
        return np.zeros((5, 0), np.int32), np.zeros((0, 4), np.float32)
    x = nn.Letters(words)
    shape = _SHAPE[x.bytes]
    turn = np.ones(len(shape), bool)  # a shape's runs count once
    turn[1:] = (shape[1:] != shape[:-1]) | (x.of[1:] != x.of[:-1])
    of_shape = (x.hashes(turn, values=shape, salt=9) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    total = lambda mask: x.total(mask.astype(np.float32))
    symbol = (shape > 2) & (x.bytes != 44) & (x.bytes != 46)
    counts = np.stack([total(np.ones(len(shape), bool)), total(shape == 0), total(shape == 2), total(symbol)], 1)
    return np.concatenate([nn.buckets([w.lower() for w in words], BITS), of_shape[None]]), counts


class Bag:
    """Texts as passages: where passages start among the words, which text each belongs to, and their statistics."""

    def __init__(self, texts: list[bytes], cache: nn.WordCache | None = None):
        self.words = nn.Words(texts)
        lens = np.diff(self.words.ends)
        per = np.maximum(-(-lens // PASSAGE), 1)  # a text without words has one empty passage
        self.text_starts = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
        self.of_text = np.repeat(np.arange(len(lens)), per)
        within = np.arange(per.sum()) - self.text_starts[self.of_text]
        self.starts = self.words.ends[:-1][self.of_text] + within * PASSAGE
        self.sizes = np.minimum(lens[self.of_text] - within * PASSAGE, PASSAGE).astype(np.int64)
        if cache:
            known = cache.features(self.words.unique)
            self.at, self.vectors, counts = None, known[:, :DIM], known[:, DIM:]
        else:
            self.at, counts = word_table(self.words.unique)
            self.vectors = None
        ids = self.words.ids
        self.passage = np.repeat(np.arange(len(self.starts)), self.sizes)
        total = lambda v: np.bincount(self.passage, v, len(self.starts))
        sums = [total(counts[ids, c]) for c in range(4)] if len(ids) else [np.zeros(len(self.starts))] * 4
        same = np.zeros(len(ids))
        if len(ids) > 1:
            same[1:] = (ids[1:] == ids[:-1]) & (self.passage[1:] == self.passage[:-1])
        key = self.passage.astype(np.int64) * (len(self.words.unique) + 1) + ids
        key.sort()
        distinct = np.bincount(key[np.diff(key, prepend=-1) != 0] // (len(self.words.unique) + 1), minlength=len(self.starts))
        n, size = np.maximum(self.sizes, 1), np.maximum(sums[0], 1)
        self.stats = np.stack([sums[1] / size, sums[2] / size, sums[3] / size, sums[0] / n / 12, total(same) / n, distinct / n, self.sizes / PASSAGE], 1).astype(np.float32)


class Mil:
    """Parameters (about 1.1 MB), forward and backward pass."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        make = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.embedding = make(1 << BITS, DIM, scale=0.1)
        self.p = {
            "w1": make(DIM + STATS, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": make(HIDDEN, GATE), "u": make(HIDDEN, GATE),
            "a": make(GATE), "o": make(HIDDEN), "c": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def forward(self, bag: Bag) -> dict[str, np.ndarray]:
        vectors = self.embedding[bag.at].mean(0) if bag.vectors is None else bag.vectors
        if len(bag.words.ids):
            sums = np.zeros((len(bag.starts), DIM), np.float32)
            full = bag.sizes > 0
            step = 1 << 18
            heads = bag.starts[full]
            for lo in range(0, len(heads), step // PASSAGE):  # bounded memory however long a text is
                part = heads[lo : lo + step // PASSAGE]
                end = heads[lo + step // PASSAGE] if lo + step // PASSAGE < len(heads) else len(bag.words.ids)
                sums[np.flatnonzero(full)[lo : lo + step // PASSAGE]] = np.add.reduceat(vectors[bag.words.ids[part[0] : end]], part - part[0], axis=0)
            mean = sums / np.maximum(bag.sizes, 1)[:, None]
        else:
            mean = np.zeros((len(bag.starts), DIM), np.float32)
        x = np.concatenate([mean, bag.stats], 1)
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        t, s = np.tanh(h @ self.p["v"]), nn.sigmoid(h @ self.p["u"])
        e = (t * s) @ self.p["a"]
        e = np.exp(e - np.maximum.reduceat(e, bag.text_starts)[bag.of_text])
        weight = e / np.add.reduceat(e, bag.text_starts)[bag.of_text]
        z = np.add.reduceat(weight[:, None] * h, bag.text_starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": z @ self.p["o"] + self.p["c"]}

    def gradients(self, bag: Bag, f: dict[str, np.ndarray], error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of each passage's mean embedding."""
        p, of = self.p, bag.of_text
        g_z = error[:, None] * p["o"]
        g_h = f["weight"][:, None] * g_z[of]
        dot = (f["h"] * g_z[of]).sum(1)
        g_e = f["weight"] * (dot - np.add.reduceat(f["weight"] * dot, bag.text_starts)[of])
        g_ts = g_e[:, None] * p["a"]
        g_v, g_u = g_ts * f["s"] * (1 - f["t"] ** 2), g_ts * f["t"] * f["s"] * (1 - f["s"])
        g_h = g_h + g_v @ p["v"].T + g_u @ p["u"].T
        g_pre = g_h * (1 - f["h"] ** 2)
        g = {
            "w1": f["x"].T @ g_pre, "b1": g_pre.sum(0), "v": f["h"].T @ g_v, "u": f["h"].T @ g_u,
            "a": (f["t"] * f["s"]).T @ g_e, "o": f["z"].T @ error, "c": error.sum(keepdims=True),
        }
        return g, (g_pre @ p["w1"].T)[:, :DIM] / np.maximum(bag.sizes, 1)[:, None]

    def calibrated(self, texts: list[bytes]) -> np.ndarray:
        """Logits of whole texts, moved so that the calibrated cut has a score of KEEP_AT."""
        if not texts:
            return np.zeros(0)
        if not hasattr(self, "_cache"):
            self._cache = nn.WordCache(self._features)
        return self.forward(Bag(texts, self._cache))["logit"] + self.shift

    def _features(self, words: list[bytes]) -> np.ndarray:
        at, counts = word_table(words)
        return np.concatenate([self.embedding[at].mean(0), counts], 1)


def fit(texts: list[bytes], y: np.ndarray) -> Mil | None:
    """Train on four fifths of the sample, place the cut with the rest; None without rows of both classes."""
    if len(y) < 8 or y.min() == y.max():
        return None
    net, rng = Mil(), np.random.default_rng(SEED)
    check = np.arange(len(y)) % 5 == 4
    rows = np.flatnonzero(~check)
    state = {k: np.zeros_like(v) for k, v in net.p.items()}
    cell_state = np.zeros_like(net.embedding)
    weight = np.where(y == 1, 0.5 / max(y[rows].mean(), 1e-3), 0.5 / max(1 - y[rows].mean(), 1e-3)).astype(np.float32)
    batches = [(some, Bag([texts[i] for i in some])) for some in np.array_split(rng.permutation(rows), max(len(rows) // BATCH, 1))]
    for _ in range(nn.passes(len(rows), SEEN, LEAST_PASSES, MOST_PASSES)):
        for some, bag in (batches[i] for i in rng.permutation(len(batches))):
            f = net.forward(bag)
            error = ((nn.sigmoid(f["logit"]) - y[some]) * weight[some] / len(some)).astype(np.float32)
            g, g_mean = net.gradients(bag, f, error)
            for k, v in net.p.items():
                nn.adagrad(v, g[k], state[k], RATE)
            if not len(bag.words.ids):
                continue
            g_words = np.stack([np.bincount(bag.words.ids, g_mean[bag.passage, k], len(bag.words.unique)) for k in range(DIM)], 1) / len(bag.at)
            cells, inverse = np.unique(bag.at, return_inverse=True)
            g_cells = np.stack([np.bincount(inverse.ravel(), np.tile(g_words[:, k], len(bag.at)), len(cells)) for k in range(DIM)], 1).astype(np.float32)
            cell_state[cells] += g_cells * g_cells
            net.embedding[cells] -= RATE * g_cells / (np.sqrt(cell_state[cells]) + 1e-6)
    held = np.flatnonzero(check)
    cut = nn.best_cut(net.forward(Bag([texts[i] for i in held]))["logit"], y[held])
    net.shift = float(np.log(KEEP_AT / (1 - KEEP_AT)) - cut)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, held: Callable[[Column], Column] | None = None, output: str = "digest") -> DataFrame:
    """Score every whole text (see nn.score_documents for the columns); predicted is 1 from a score of KEEP_AT.

    Null text is empty: one passage without words. Without labelled rows of both classes every score is 1, so nothing is
    rejected. Rows are scored by themselves, so repeated rows and null ids stay. Fitting uses a bounded sample.
    """
    held = held or (lambda doc_id: held_out(doc_id, 4, 2))
    net = fit(*nn.training_sample(docs, labels, "quality", held))
    logits = net.calibrated if net else lambda texts: np.full(len(texts), 1e9)
    return nn.score_documents(docs, logits, held, KEEP_AT, output)
