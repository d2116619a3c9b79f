"""Shared pieces: table access, scratch storage, batch tokenising and connected components."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.checkpoint import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir"]  # used by the operators, besides what follows

#: ASCII white space that separates words, as a regular expression (a fixed value of the contracts).
SPACE_RE = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Have the context delete shuffle files and checkpoints of frames that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a large heap may put off until the disks are full. Python's
    bridge tells the JVM which objects it dropped about once a second, and events that name them are still on their way; hence
    the pauses and the second round. A local session has no executors' disks to spare and goes on at once.
    """
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as compressed Parquet to the shared folder and read again: for tables that a checkpoint would hold uncompressed.

    The files go when the driver exits.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:  # else the session is gone, and with it the way to the folder
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the decimal id decides the fold; a null id counts as held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch so that each piece has about `max_bytes` of text (one text at least), with the texts as UTF-8; null is empty."""
    texts = [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_bytes:
            yield batch.slice(start, i - start), [x.lower() for x in texts[start:i]] if lower else texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield batch.slice(start), [x.lower() for x in texts[start:]] if lower else texts[start:]
    pa.default_memory_pool().release_unused()  # workers are used again by later stages, and Arrow would keep what it freed


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words (bytes.split() splits at exactly the six ASCII white-space bytes) and the offsets of the texts among them."""
    words = [t.split() for t in texts]
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=ends[1:])
    return list(chain.from_iterable(words)), ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (constants of SplitMix64, public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text from word hashes; a text of 1 to n - 1 words has one shingle of all its words."""
    odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1000193 * j) for j in range(n)]
    lens = np.diff(ends)
    total = len(words)
    full = np.zeros(max(total, 1), np.uint64)
    if total >= n:
        acc = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            acc += words[j : total - n + 1 + j] * odd[j]
        full[: total - n + 1] = acc
    counts = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    offs = np.zeros(len(ends), np.int64)
    np.cumsum(counts, out=offs[1:])
    at = np.repeat(ends[:-1] - offs[:-1], counts) + np.arange(offs[-1])
    out = full[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((lens > 0) & (lens < n)):
        short = words[ends[i] : ends[i + 1]] * np.array(odd[: lens[i]])
        out[offs[i]] = short.sum(dtype=np.uint64) ^ np.uint64(lens[i])
    return mix(out), offs


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (src, dst: long) as rows (node, component = its least node). No edges give no rows.

    Alternating stars: larger neighbours are tied to a node's least neighbour, then smaller ones, until every node hangs on
    the least of its component. A round is two grouped minimums (combined before the shuffle) and two joins on the node,
    which adaptive execution splits where a node is a hub; edges that already are stars need one round. Edges stay
    distributed and are cut to the shared folder each round; only their number and a checksum reach the driver.
    """
    pair = lambda a, b: [F.col(a).alias("a"), F.col(b).alias("b")]
    star = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = None
    while mark != (mark := tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())):
        both = star.unionByName(star.select(*pair("b", "a")))
        low = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.join(low, both.a == low["at"]).where("b > a").select(*pair("b", "m")).distinct()
        low = large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low["at"]).where("b <> m").select(*pair("b", "m"))
        star = cut(small.unionByName(low.select(*pair("at", "m"))).distinct())
    nodes = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def free_names(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores before it as no column of `df` has (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    depth = 1
    while any("_" * depth + n.lower() in taken for n in names):
        depth += 1
    return ["_" * depth + n for n in names]


def plain(docs: DataFrame) -> DataFrame:
    """The two columns that an operator needs, whatever else the table has and whatever its other columns are called."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Rows of (id) or (id, hash) pairs that may be broadcast: some 5 MB as a hash table. Larger sides are shuffled.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast only if a count shows at most `rows` rows. Pass a table that is cheap to count (see cut)."""
    return F.broadcast(df) if df.count() <= rows else df  # a limit before the count would gather its rows in one task


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but the needed ones under names that no operator uses, and a function that names them back.

    That puts the columns of `docs` first, in their order, and columns that were added after them.
    """
    names = docs.columns
    hidden = [n if n in needed else f"column {i} of the input" for i, n in enumerate(names)]

    def back(out: DataFrame) -> DataFrame:
        added = [c for c in out.columns if c not in hidden]
        return out.select(*[F.col(f"`{h}`").alias(n) for h, n in zip(hidden, names)], *added)

    return docs.toDF(*hidden), back


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id is in `ids` (one column, doc_id). Null ids in `docs` stay."""
    (name,) = free_names(docs, "gone")
    gone = cut(ids.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct())
    return docs.join(small_side(gone), docs["doc_id"] == F.col(name), "left_anti")
