"""What both text classifiers share: the bounded training sample, word features, Adagrad and threshold choice (numpy only)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm.common import cut, mix, plain, slices, small_side, split_words

#: Labelled rows per class that a model is fitted on at most, and the longest text among them: bounds the driver's share.
TRAIN_PER_CLASS = 1500
TRAIN_MAX_BYTES = 50_000
PUNCTUATION = b".,;:!?\"'()[]"


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held: Callable[[Column], Column], per_class: int = TRAIN_PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels: of each class the `per_class` labelled documents whose id's hash is least, from outside the held-out fold.

    Null ids and labels are left out, repeated labels count once (the greater wins). Texts over TRAIN_MAX_BYTES and null ones are
    no candidates; of an id with several texts the one of least hash is. So there are `per_class` rows of a class wherever so
    many short texts are labelled. Both classes come in a fixed order, so equal input gives an equal model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id", F.lit(17)))
    texts = plain(docs).where(F.octet_length("text") <= TRAIN_MAX_BYTES)
    short = texts.select("doc_id", F.xxhash64("text").alias("t")).join(known.hint("shuffle_hash"), F.col("doc_id") == F.col("id"))
    short = cut(short.groupBy("id", "y", "h").agg(F.min("t").alias("t")))
    first = [short.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    picked = first[0].unionByName(first[1])
    same = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("t"))
    rows = texts.join(small_side(picked), same).select("h", "id", "text", "y").distinct().collect()  # one text an id, 2 * per_class at most
    rows.sort(key=lambda r: (r["h"], r["id"], r["text"]))
    return [r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32)


class Words:
    """The distinct words of a few texts, and every text as positions in them. Position `len(unique)` is padding."""

    def __init__(self, texts: list[bytes]):
        flat, self.ends = split_words(texts)
        self.unique = list(dict.fromkeys(flat))
        index = {w: i for i, w in enumerate(self.unique)}
        self.ids = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))


def adagrad(parameter: np.ndarray, gradient: np.ndarray, state: np.ndarray, rate: float) -> None:
    state += gradient * gradient
    parameter -= rate * gradient / (np.sqrt(state) + 1e-6)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def passes(rows: int, seen: int, least: int, most: int) -> int:
    """One rule for samples of any size: as many passes as show the model `seen` rows in all, within bounds.

    The loss on the calibration slice is no better guide: with a few wrong labels it rises long before the ranking is learned.
    """
    return min(max(round(seen / max(rows, 1)), least), most)


def best_f1_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit of greatest F1 for class 1, which a rare class does not buy with many false alarms; the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, t = logits[order], y[order]
    hits = t.sum() - np.concatenate([[0], np.cumsum(t)])
    flagged = len(t) - np.arange(len(t) + 1)
    return _middle(x, 2 * hits / np.maximum(flagged + t.sum(), 1))


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that best tells the classes apart (balanced accuracy); the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, t = logits[order], y[order]
    pos, neg = max(t.sum(), 1), max((1 - t).sum(), 1)
    below = np.concatenate([[0], np.cumsum(1 - t)]) / neg + 1 - np.concatenate([[0], np.cumsum(t)]) / pos
    return _middle(x, below)


def _middle(x: np.ndarray, worth: np.ndarray) -> float:
    """Of the cuts between sorted logits (and beyond both ends) that are worth most, the middle of the widest gap."""
    edges = np.concatenate([[x[0] - 2], (x[1:] + x[:-1]) / 2, [x[-1] + 2]])
    good = np.flatnonzero(worth >= worth.max() - 1e-9)
    gaps = np.concatenate([[0], np.diff(x), [0]])
    return float(edges[good[np.argmax(gaps[good])]])


def score_documents(docs: DataFrame, logits: Callable[[list[bytes]], np.ndarray], held: Callable[[Column], Column], cut_at: float, output: str = "digest") -> DataFrame:
    """One map over the scan: doc_id, held_out, score, predicted ("digest"), or the input's columns and score, predicted ("rows")."""
    if output == "digest":
        source = plain(docs).withColumn("held_out", held(F.col("doc_id")))
    else:
        source = docs.drop("score", "predicted")
    keep = [f for f in source.schema.fields if output != "digest" or f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["score double", "predicted int"])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", max_bytes=2 << 20):
                score = sigmoid(logits(texts).astype(np.float64))
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), pa.array((score >= cut_at).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    return source.mapInArrow(run, schema)


_IS_PUNCTUATION = np.isin(np.arange(256), list(PUNCTUATION))


class Letters:
    """The bytes of many words at once, so that hashes and counts of all words are a few array operations."""

    def __init__(self, words: list[bytes]):
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.starts = np.cumsum(lens) - lens
        self.of = np.repeat(np.arange(len(words)), lens)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else values[:0]

    def hashes(self, kept: np.ndarray, from_end: bool = False, first: int | None = None, values: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """A hash of each word's kept bytes in order; `first`: of only so many of them, counted from the end if `from_end`."""
        order = np.cumsum(kept)
        order -= np.repeat(order[self.starts] - kept[self.starts], np.diff(self.starts, append=len(self.bytes)))
        if from_end:
            order = self.total(kept.astype(np.int64))[self.of] + 1 - order
        if first:
            kept = kept & (order <= first)
        cell = (self.bytes if values is None else values).astype(np.uint64) + (order.astype(np.uint64) << np.uint64(8)) + np.uint64(salt << 40)
        return mix(self.total(np.where(kept, mix(cell), np.uint64(0))))


def buckets(words: list[bytes], bits: int) -> np.ndarray:
    """Hash buckets (rows) of each word without punctuation: itself, its first four and six and its last four bytes."""
    if not words:
        return np.zeros((4, 0), np.int32)
    x = Letters(words)
    kept = ~_IS_PUNCTUATION[x.bytes]
    kept |= (x.total(kept.astype(np.int64)) == 0)[x.of]
    found = [x.hashes(kept), x.hashes(kept, first=4, salt=1), x.hashes(kept, first=6, salt=2), x.hashes(kept, from_end=True, first=4, salt=3)]
    return (np.stack(found) & np.uint64((1 << bits) - 1)).astype(np.int32)


class WordCache:
    """Rows of features per word, kept between slices of a task; emptied when `limit` words are held (some 30 MB)."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 150_000):
        self.compute, self.limit, self.at, self.rows = compute, limit, {}, None

    def features(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.at, self.rows = {}, None
        new = [w for w in words if w not in self.at]
        if new or self.rows is None:
            made = self.compute(new)
            old = len(self.at)
            if self.rows is None or old + len(new) > len(self.rows):
                grown = np.zeros((max(2 * (old + len(new)), 1024), made.shape[1]), np.float32)
                if self.rows is not None:
                    grown[:old] = self.rows[:old]
                self.rows = grown
            self.rows[old : old + len(new)] = made
            self.at.update(zip(new, range(old, old + len(new))))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]
