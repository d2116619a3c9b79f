"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words (ASCII lower case, outer punctuation off) are hashed to buckets together with their affixes; a word's embedding is the
mean of its buckets', of which only those that several texts of the sample use have a vector. Filters of widths 1, 2 and 3 slide over the whole text, the maximum of each over the text goes through
a ReLU into one linear unit. After fitting, a slice of the sample sets a threshold for each language; a text's language is
guessed from its own function words, never from a column. The logit is moved so that the threshold is a score of 0.5.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame

from declq.llm import nn
from declq.llm.common import held_out

BITS, DIM, FILTERS, WIDTHS = 18, 16, 16, (1, 2, 3)
#: A bucket gets an embedding if so many texts of the sample use it; all others are zero, so chance words can't be learned.
LEAST_TEXTS = 4
BATCH, RATE, SEED = 32, 0.05, 11
#: Rows that training sees in all; passes over the sample at least and at most.
SEEN, LEAST_PASSES, MOST_PASSES = 18_000, 6, 24
#: Positions whose filter outputs are held at once.
STRETCH = 1 << 18
#: Least validation rows of each class for a language to get its own threshold; else the common one holds.
CALIBRATION_ROWS = 15
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": b"the of and to in is that it for was on are with as be this by an at from".split(),
    "fr": b"le les la de des et un une du est que qui dans pour pas sur au par en elle".split(),
    "de": b"der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es".split(),
    "es": b"el los las que de la y en un por con no una su para es al lo como del".split(),
}
LANGUAGES = list(FUNCTION_WORDS)


class ConvNet:
    """Parameters and the forward pass; a few MB at most, as the sample is bounded. Row 0 of the embedding stays zero."""

    def __init__(self, texts: list[bytes]) -> None:
        rng = np.random.default_rng(SEED)
        uses = np.zeros(1 << BITS, np.int32)
        for t in texts:
            uses[np.unique(nn.buckets(list(set(t.split())), BITS))] += 1
        often = np.flatnonzero(uses >= LEAST_TEXTS)
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[often] = np.arange(1, len(often) + 1)
        self.embedding = (rng.standard_normal((len(often) + 1, DIM)) * 0.1).astype(np.float32)
        self.embedding[0] = 0
        self.taps = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.2).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.cuts = np.zeros(len(LANGUAGES) + 1)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        return self.row[nn.buckets(words, BITS)]

    def embed(self, at: np.ndarray) -> np.ndarray:
        """The words' vectors, and one of zeros for padding."""
        return np.concatenate([self.embedding[at].mean(0), np.zeros((1, DIM), np.float32)])

    def layout(self, x: nn.Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions with padding after each text (one word at least, and a window's reach), and where texts start."""
        lens = np.diff(x.ends)
        pad = max(WIDTHS)
        starts = np.concatenate([[0], np.cumsum(lens + pad)[:-1]]) if len(lens) else np.zeros(0, np.int64)
        ids = np.full(int((lens + pad).sum()), len(x.unique), np.int32)
        ids[np.arange(len(x.ids)) + np.repeat(np.arange(len(lens)) * pad, lens)] = x.ids
        return ids, starts

    def tapped(self, vectors: np.ndarray, k: int) -> list[np.ndarray]:
        """Each tap of a filter width applied to the distinct words, once."""
        return [vectors @ tap for tap in self.taps[k]]

    def responses(self, ids: np.ndarray, tapped: list[np.ndarray], lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Filter outputs at the positions lo to hi (all but the last few, without hi)."""
        hi = len(ids) - max(WIDTHS) + 1 if hi is None else hi
        total = tapped[0][ids[lo:hi]]
        for j in range(1, len(tapped)):
            total += tapped[j][ids[lo + j : hi + j]]
        return total

    def pooled(self, ids: np.ndarray, starts: np.ndarray, valid: np.ndarray, tapped: list[np.ndarray]) -> np.ndarray:
        """The greatest output of every filter over each text, a stretch of positions at a time, so a long text needs no more memory."""
        out = np.full((len(starts), FILTERS), -np.inf, np.float32)
        for lo in range(0, len(valid), STRETCH):
            hi = min(lo + STRETCH, len(valid))
            r = self.responses(ids, tapped, lo, hi)
            r[~valid[lo:hi]] = -np.inf
            first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
            top = np.maximum.reduceat(r, np.maximum(starts[first:last], lo) - lo, axis=0)
            out[first:last] = np.maximum(out[first:last], top)
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Raw logits of whole texts; an empty text is seen as padding."""
        x = nn.Words([t.lower() for t in texts])
        ids, starts = self.layout(x)
        if not len(starts):
            return np.zeros(0)
        if not hasattr(self, "_cache"):
            self._cache = nn.WordCache(lambda words: self.embed(self.rows_of(words))[:-1])
        vectors = np.concatenate([self._cache.features(x.unique), np.zeros((1, DIM), np.float32)])
        lens = np.maximum(np.diff(x.ends), 1)
        valid = np.zeros(len(ids) - max(WIDTHS) + 1, bool)
        valid[np.repeat(starts, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = True
        features = [self.pooled(ids, starts, valid, self.tapped(vectors, k)) for k in range(len(WIDTHS))]
        self._language = guess_language(x)
        return np.maximum(np.concatenate(features, 1) + self.bias, 0) @ self.out + self.offset

    def calibrated(self, texts: list[bytes]) -> np.ndarray:
        raw = self.logits(texts)
        return raw - self.cuts[self._language] if len(raw) else raw


def guess_language(x: nn.Words) -> np.ndarray:
    """For each text the language with most of its function words, or len(LANGUAGES) if there are none or a tie at the top."""
    index = {w: i for i, w in enumerate(x.unique)}
    of_text = np.repeat(np.arange(len(x.ends) - 1), np.diff(x.ends))
    votes = np.zeros((len(x.ends) - 1, len(LANGUAGES)))
    for k, lang in enumerate(LANGUAGES):
        hit = np.zeros(len(x.unique) + 1, np.float64)
        hit[[index[w] for w in FUNCTION_WORDS[lang] if w in index]] = 1
        votes[:, k] = np.bincount(of_text, hit[x.ids], len(x.ends) - 1)
    top = votes.max(1, initial=0)
    return np.where((top > 0) & ((votes == top[:, None]).sum(1) == 1), votes.argmax(1), len(LANGUAGES))


def fit(texts: list[bytes], y: np.ndarray) -> ConvNet | None:
    """Train on four fifths of the sample and calibrate on the rest; None without rows of both classes."""
    if len(y) < 8 or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    check = np.arange(len(y)) % 5 == 4
    rows = rng.permutation(np.flatnonzero(~check))
    lowered = [t.lower() for t in texts]
    net = ConvNet([lowered[i] for i in rows])
    state = {k: np.zeros_like(v) for k, v in (("embedding", net.embedding), ("bias", net.bias), ("out", net.out), ("offset", net.offset))}
    tap_state = [np.zeros_like(t) for t in net.taps]
    weight = np.where(y == 1, 0.5 / max(y[rows].mean(), 1e-3), 0.5 / max(1 - y[rows].mean(), 1e-3)).astype(np.float32)
    batches = [(some, nn.Words([lowered[i] for i in some])) for some in np.array_split(rows, max(len(rows) // BATCH, 1))]
    batches = [(some, x, net.rows_of(x.unique)) for some, x in batches]
    for _ in range(nn.passes(len(rows), SEEN, LEAST_PASSES, MOST_PASSES)):
        for some, x, at in (batches[i] for i in rng.permutation(len(batches))):
            ids, starts = net.layout(x)
            vectors = net.embed(at)
            lens = np.maximum(np.diff(x.ends), 1)
            places, values = [], []
            for k in range(len(WIDTHS)):
                r = net.responses(ids, net.tapped(vectors, k))
                top = np.stack([s + r[s : s + n].argmax(0) for s, n in zip(starts, lens)])
                places.append(top)
                values.append(r[top, np.arange(FILTERS)])
            pre = np.concatenate(values, 1) + net.bias
            feature = np.maximum(pre, 0)
            error = ((nn.sigmoid(feature @ net.out + net.offset) - y[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * net.out * (pre > 0)
            g_out = error @ feature
            g_vectors = np.zeros_like(vectors)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                g_taps = np.zeros_like(net.taps[k])
                for j in range(w):
                    word = ids[places[k] + j]
                    g_taps[j] = np.einsum("df,dfk->kf", g, vectors[word])
                    np.add.at(g_vectors, word.ravel(), (g[:, :, None] * net.taps[k][j].T[None]).reshape(-1, DIM))
                nn.adagrad(net.taps[k], g_taps, tap_state[k], RATE)
            nn.adagrad(net.out, g_out, state["out"], RATE)
            nn.adagrad(net.bias, back.sum(0), state["bias"], RATE)
            nn.adagrad(net.offset, error.sum(keepdims=True), state["offset"], RATE)
            touched = np.flatnonzero(np.abs(g_vectors[:-1]).sum(1))
            cells, inverse = np.unique(at[:, touched], return_inverse=True)
            g_cells = np.zeros((len(cells), DIM), np.float32)
            np.add.at(g_cells, inverse.ravel(), np.tile(g_vectors[touched] / len(at), (len(at), 1)))
            state["embedding"][cells] += g_cells * g_cells
            net.embedding[cells] -= RATE * g_cells / (np.sqrt(state["embedding"][cells]) + 1e-6)
            net.embedding[0] = 0
    held = np.flatnonzero(check)
    raw = net.logits([texts[i] for i in held])
    language, common = net._language, nn.best_f1_cut(raw, y[held])
    for k in range(len(LANGUAGES) + 1):
        own = language == k
        enough = k < len(LANGUAGES) and min(y[held][own].sum(), (1 - y[held][own]).sum()) >= CALIBRATION_ROWS
        net.cuts[k] = nn.best_f1_cut(raw[own], y[held][own]) if enough else common
    del net._cache  # its words need not travel
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, held: Callable[[Column], Column] | None = None, output: str = "digest") -> DataFrame:
    """Score every whole text (see nn.score_documents for the columns); predicted is 1 from a score of 0.5.

    Null text is empty and is scored like it; without labelled rows of both classes every score is 0 (below 1e-9). Rows are scored by
    themselves, so repeated rows and null ids stay. Fitting uses a bounded sample (nn.TRAIN_PER_CLASS rows of each class).
    """
    held = held or (lambda doc_id: held_out(doc_id, 5, 0))
    net = fit(*nn.training_sample(docs, labels, "toxic", held))
    logits = net.calibrated if net else lambda texts: np.full(len(texts), -1e9)
    return nn.score_documents(docs, logits, held, 0.5, output)
