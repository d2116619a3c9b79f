"""Hidden Markov language model: Baum-Welch counts summed over partitions train it, the scaled forward recursion scores.

Tokens are the white-space words in ASCII lower case and one end per text. A state emits a class, the class a word: the
TOP_CLASSES most frequent words (fewer if too many words tie, see frequent_words) and the end are classes of their own,
all other words (also unknown ones) share HASH_CLASSES classes by their letters. p(word | class) comes from the exact
counts of all training texts, with one count more for each word of the class and one unknown word; so p sums to 1 over all
words, and everything that must be on every executor (states x classes) has a fixed size while the counts, which grow with
the corpus, stay distributed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declq.llm.common import cut, held_out, plain, slices, split_words
from declq.llm.nn import Letters

STATES, TOP_CLASSES, HASH_CLASSES, ROUNDS, SEED = 6, 4096, 2048, 4, 3
#: Words at most whose counts every task gets; all other counts are joined. Up to TOP_CLASSES of them are classes of their own.
SHARED_COUNTS, LEVELS = 100_000, 8
#: Word positions of a batch of the recursions; texts of like length share a batch.
BATCH_TOKENS = 1_200_000
#: Distinct words that a counting task holds before it passes them on.
FLUSH_WORDS = 300_000
#: Added to each expected count, so that no transition or class has probability 0.
SMOOTHING = 0.01


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
    for batch in batches:
        for _, texts in slices(batch, "text", lower=True):
            for t in texts:
                seen.update(t.split())
            if len(seen) > FLUSH_WORDS:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def hash_class(words: list[bytes]) -> np.ndarray:
    """Class of words that have none of their own: by their last two bytes and whether a byte of them is not ASCII."""
    if not words:
        return np.zeros(0, np.int64)
    x = Letters(words)
    tail = x.hashes(np.ones(len(x.bytes), bool), from_end=True, first=2)
    foreign = x.total((x.bytes > 127).astype(np.int64)) > 0
    return ((tail + foreign.astype(np.uint64) * np.uint64(0x9E37)) % np.uint64(HASH_CLASSES)).astype(np.int64) + TOP_CLASSES + 1


class Vocabulary:
    """What tasks know of words: class 0 is the end, 1 to TOP_CLASSES the most frequent words, then the hashed classes."""

    def __init__(self, shared: list[tuple[bytes, int]]):
        self.known = {w: i for i, (w, _) in enumerate(shared)}
        self.counts = np.array([c for _, c in shared] + [0], np.float64)
        classes = np.arange(1, len(shared) + 1)
        classes[TOP_CLASSES:] = hash_class([w for w, _ in shared[TOP_CLASSES:]])
        self.classes = np.append(classes, 0)


N_CLASSES = 1 + TOP_CLASSES + HASH_CLASSES


def frequent_words(counts: DataFrame, most: int = SHARED_COUNTS) -> list[tuple[bytes, int]]:
    """(word, count) of the words down to the least count level that at most `most` words reach, most frequent first.

    Levels are LEVELS to a doubling, so the driver gets a row for each level of counts in use and then `most` words at most;
    a sorted limit would get so many words from every partition.
    """
    levelled = counts.withColumn("level", F.floor(F.log2("c") * LEVELS).cast("int"))
    reached, least = 0, None
    for r in sorted(levelled.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"]):
        reached += r["words"]
        if reached > most:
            break
        least = r["level"]
    if least is None:
        return []
    found = levelled.where(F.col("level") >= least).select("word", "c").collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))


def _class_sizes(vocabulary):
    """Words and their counts to (class, words, tokens): what the denominators of p(word | class) are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        words, tokens = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
        for batch in batches:
            w, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            k = np.fromiter((voc.known.get(x, -1) for x in w), np.int64, len(w))
            cls = voc.classes[k]
            cls[k < 0] = hash_class([x for x, i in zip(w, k) if i < 0])
            words += np.bincount(cls, minlength=N_CLASSES)
            tokens += np.bincount(cls, c, N_CLASSES)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].astype(np.int64)), pa.array(tokens[at].astype(np.int64))], ["class", "words", "tokens"])

    return run


def _encode(vocabulary):
    """Texts to rows: classes (uint16, end included), sums over the shared words, and the words whose counts are elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        log = np.log10(voc.counts + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20, lower=True):
                words, ends = split_words(texts)
                get = voc.known.get
                k = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                rare = np.flatnonzero(k < 0)
                rest = [words[i] for i in rare]
                cls = voc.classes[k]
                cls[rare] = hash_class(rest)
                stream = np.insert(cls, ends[1:], 0).astype(np.uint16)
                n = len(texts)
                of = np.repeat(np.arange(n), np.diff(ends))
                cuts = np.searchsorted(rare, ends)
                at = ends + np.arange(n + 1)
                values = log[k]
                values[rare] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), part.column(0), part.column(2),
                        pa.array([stream[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary()),
                        pa.array(np.bincount(of, values, n).astype(np.float64)), pa.array(np.bincount(of, k >= 0, n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(rest, pa.binary())),
                    ],
                    ["row", "doc_id", "held_out", "classes", "log_counts", "n_known", "rare"],
                )
                row += n

    return run


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start (K), move (K, K), emit (classes, K); every distribution sums to 1."""
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, tokens: np.ndarray) -> Model:
        """Sticky transitions; each state starts from the corpus' class frequencies, perturbed so that states differ."""
        rng = np.random.default_rng(SEED)
        emit = (tokens[:, None] + 1) * np.exp(rng.standard_normal((len(tokens), STATES)))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + SMOOTHING, move + SMOOTHING, emit + SMOOTHING
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def batches_of(streams: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, padded classes (time, texts), lengths): longest first, so that the texts still running are a prefix."""
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    start = 0
    while start < len(order):
        longest = len(streams[order[start]])
        some = order[start : start + max(1, BATCH_TOKENS // longest)]
        lens = np.array([len(streams[i]) for i in some])
        padded = np.zeros((longest, len(some)), np.uint16)
        for j, i in enumerate(some):
            padded[: lens[j], j] = streams[i]
        yield np.array(some), padded, lens
        start += len(some)


def _emissions(model: Model, classes: np.ndarray, kind: type) -> np.ndarray:
    """(time, state, text): emission probabilities, looked up state by state."""
    out = np.empty((len(classes), STATES, classes.shape[1]), kind)
    for k in range(STATES):
        out[:, k] = model.emit[:, k].astype(kind)[classes]
    return out


def stretches(classes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of steps with BATCH_TOKENS cells at most: what is held of a batch at once, however long its texts are."""
    steps, n = classes.shape
    size = max(1, BATCH_TOKENS // max(n, 1))
    return [(lo, min(lo + size, steps)) for lo in range(0, steps, size)]


def _stretch(model: Model, classes: np.ndarray, lens: np.ndarray, lo: int, now: np.ndarray | None, kind: type, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward over the steps of `classes`, the first of which is step `lo` of the texts, from the shares `now` of the step before.

    The shares after the last step, and by step the shares (with `keep`), scales and emissions.
    """
    steps, n = classes.shape
    running = (lens[None, :] > np.arange(lo, lo + steps)[:, None]).sum(1).tolist()
    seen = _emissions(model, classes, kind)
    alphas, scales = np.zeros((steps if keep else 0, STATES, n), kind), np.ones((steps, n), kind)
    move = np.ascontiguousarray(model.move.T, kind)
    for t, m in enumerate(running):
        now = (np.tile(model.start.astype(kind)[:, None], (1, m)) if now is None else move @ now[:, :m]) * seen[t, :, :m]
        scale = now.sum(0)
        now /= scale
        scales[t, :m] = scale
        if keep:
            alphas[t, :, :m] = now
    return now, alphas, scales, seen


def forward(model: Model, classes: np.ndarray, lens: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Scaled forward recursion over a batch: the exact log10 likelihoods of its texts."""
    now, total = None, np.zeros(classes.shape[1])
    for lo, hi in stretches(classes):
        now, _, scales, _ = _stretch(model, classes[lo:hi], lens, lo, now, kind, False)
        total += np.log10(scales).sum(0, dtype=np.float64)
    return total


def expected_counts(model: Model, classes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of a batch (forward-backward in single precision, sums over texts in double).

    Of texts that are longer than a stretch, the shares before each are kept and the shares inside are worked out again on
    the way back, so memory does not grow with the length of a text but for those few.
    """
    n = classes.shape[1]
    runs = stretches(classes)
    before: list[np.ndarray | None] = [None]
    for lo, hi in runs[:-1]:
        before.append(_stretch(model, classes[lo:hi], lens, lo, before[-1], np.float32, False)[0])
    move, moves, back = model.move.astype(np.float32), np.zeros((STATES, STATES)), np.ones((STATES, n), np.float32)
    starts, emit = np.zeros(STATES), np.zeros((N_CLASSES, STATES))
    for (lo, hi), entry in zip(reversed(runs), reversed(before)):
        _, gamma, scales, seen = _stretch(model, classes[lo:hi], lens, lo, entry, np.float32, True)
        running = (lens[None, :] > np.arange(lo, hi)[:, None]).sum(1).tolist()
        seen /= scales[:, None, :]
        for t in range(hi - lo - 1, -1, -1):
            m = running[t]
            ahead = back[:, :m] * seen[t, :, :m]
            if t:
                moves += gamma[t - 1, :, :m] @ ahead.T  # still the forward shares: t - 1 is turned into gamma next
            elif entry is not None:
                moves += entry[:, :m] @ ahead.T
            gamma[t, :, :m] *= back[:, :m]
            back[:, :m] = move @ ahead
        flat = classes[lo:hi].ravel().astype(np.int64)  # padding has gamma 0
        emit += np.stack([np.bincount(flat, gamma[:, k].ravel(), N_CLASSES) for k in range(STATES)], 1)
        if lo == 0:
            starts = gamma[0].sum(1, dtype=np.float64)
    return starts, moves * model.move, emit


def _streams(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column(column).to_pylist()]


def _baum_welch(model):
    """One task's expected counts: a row per class, and rows of negative number for moves and the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((N_CLASSES, STATES))
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                for _, classes, lens in batches_of(_streams(batch.slice(lo, 20_000), 0)):
                    s, m, e = expected_counts(model.value, classes, lens)
                    start, move, emit = start + s, move + m, emit + e
        used = np.flatnonzero(emit.sum(1))
        at = np.concatenate([used, -1 - np.arange(STATES), [-1 - STATES]])
        values = np.concatenate([emit[used], move, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(STATES))], ["class", *(f"k{k}" for k in range(STATES))])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, log_size = model.value
        for batch in batches:
            streams = _streams(batch, 1)
            score = np.zeros(len(streams))
            for lo in range(0, len(streams), 20_000):
                for some, classes, lens in batches_of(streams[lo : lo + 20_000]):
                    score[lo + some] = forward(hmm, classes, lens)
            inside = np.array([log_size[s].sum() for s in streams])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(s) for s in streams], np.int64)), pa.array(score - inside)], ["row", "n_tokens", "class_score"])

    return run


def score_language(docs: DataFrame, modulus: int = 7, remainder: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, all over whole texts.

    Learns from rows outside the fold crc32(doc_id) mod `modulus` = `remainder` (null ids are in it). base_score is the
    add-one unigram log10 probability; score is the model's. Null text is empty: one token, the end. Repeated rows are
    scored, and learned from, once each. Without training texts N and V are 0 and both scores are those of a uniform guess.
    """
    spark = docs.sparkSession
    texts = plain(docs).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    counts = cut(texts.where(~F.col("held_out")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n_texts = texts.where(~F.col("held_out")).count()
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    train_tokens, distinct = total["n"] + n_texts, total["v"] + bool(n_texts)
    shared = frequent_words(counts)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(shared))
    sizes = counts.mapInArrow(_class_sizes(vocabulary), "class long, words long, tokens long").groupBy("class").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    words, tokens = np.zeros(N_CLASSES), np.zeros(N_CLASSES)  # at most N_CLASSES rows
    for r in sizes:
        words[r["class"]], tokens[r["class"]] = r["words"], r["tokens"]
    tokens[0], words[0] = n_texts, 1
    single = np.arange(N_CLASSES) <= len(shared[:TOP_CLASSES])  # a class of one word needs no share for unknown words
    log_size = np.where(single, np.log10(tokens + 1), np.log10(tokens + words + 1))
    schema = "row long, doc_id long, held_out boolean, classes binary, log_counts double, n_known long, rare array<binary>"
    encoded = cut(texts.mapInArrow(_encode(vocabulary), schema))
    model = Model.first(tokens)
    learn = encoded.where(~F.col("held_out")).select("classes")
    for _ in range(rounds if n_texts else 0):
        sums = learn.mapInArrow(_baum_welch(spark.sparkContext.broadcast(model)), ", ".join(["class long", *(f"k{k} double" for k in range(STATES))]))
        sums = sums.groupBy("class").agg(*[F.sum(f"k{k}").alias(f"k{k}") for k in range(STATES)]).collect()  # N_CLASSES + STATES + 1 rows at most
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((N_CLASSES, STATES))
        for r in sums:
            at, values = r[0], np.array(r[1:])
            if at >= 0:
                emit[at] = values
            elif at >= -STATES:
                move[-1 - at] = values
            else:
                start = values
        model = Model.of_counts(start, move, emit)
    scored = encoded.select("row", "classes").mapInArrow(_score(spark.sparkContext.broadcast((model, log_size))), "row long, n_tokens long, class_score double")
    rare = encoded.select("row", F.explode_outer("rare").alias("w")).where("w is not null").groupBy("row", "w").agg(F.count(F.lit(1)).alias("times"))
    known = rare.join(counts, F.col("w") == F.col("word")).groupBy(F.col("row").alias("rare_row")).agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))
    rows = encoded.select(F.col("row").alias("r"), "doc_id", "held_out", "log_counts", "n_known")
    joined = rows.join(scored, F.col("r") == F.col("row")).join(known, F.col("r") == F.col("rare_row"), "left")
    logs = F.col("log_counts") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(float(np.log10(n_texts + 1)))
    known_words = (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_texts > 0))).cast("long")
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        known_words.alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("class_score") + logs).alias("score"),
    )
