"""Cross-tokenizer alignment by byte-owner arrays.

Tokenizer A is a byte-level BPE that sees a space and the text, B a sentencepiece BPE that adds the space itself, so both cover
the same bytes. np.repeat writes the index of the token that owns each byte, once for A and once for B. Where the owner pair
changes a new overlap begins; where both owners change at once both tokens end, and the text is cut into groups. A link is a
pair of token occurrences of one group.

A slice of texts is aligned at once, end to end: both tokenizers end a token at the end of a text. Texts above PIECE_CHARS
characters are encoded in parts, cut at single spaces between letters or digits, where both tokenizers begin a token whatever
stands before; a text without such places is one part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm import bpe
from declq.llm.common import cut, slices, stored

#: Bytes of text that are aligned at once, one text at least; characters of a part of a long text.
SLICE_BYTES, PIECE_CHARS = 1 << 21, 1 << 16
#: A group of more links than this is counted by its distinct ids, so that a run of marks never makes a row for every link.
WIDE = 256
#: Id pairs whose counts are broadcast at most (16 MB), the most frequent ones; texts that hold rarer pairs are joined to their counts.
SHARED_PAIRS = 1_000_000
_LETTER = "0-9A-Za-zÀ-ÖØ-öø-ÿА-яぁ-ゖァ-ヺ一-龥가-힣"
PART_CUT = re.compile(f"(?<=[{_LETTER}]) (?=[{_LETTER}])")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_tokens(vocabulary: bytes) -> list[bytes]:
    """The tokens of a byte-level BPE file in the order of their ids, less special ones; an error for files that mean another split or order of merges."""
    spec = json.loads(vocabulary)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("not a plain byte-level BPE")
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        raise ValueError("merges are not in the order of the ids")
    letters = byte_letters()
    special = {x["id"] for x in spec["added_tokens"]}
    tokens = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if i not in special}
    return [tokens[i] for i in range(256 + len(merged))]


def parts(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """`text` cut at single spaces, which go, after about every `limit` characters."""
    start = 0
    while len(text) - start > limit:
        at = PART_CUT.search(text, start + limit)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.end()
    yield text[start:]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, vocabulary: bytes, model: bytes, pattern: str):
        self.bytes_a = byte_level_tokens(vocabulary)
        ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(self.bytes_a))
        self.a = bpe.Encoder(ranks, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece, ids = self.b.id_to_piece, range(self.b.vocab_size())
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in ids]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        name = lambda n, end: [f"{i}{end}" for i in range(n)]
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.names = name(n_a, ",") + name(n_a, "|") + name(n_b, ",") + name(n_b, ";")

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of each text by A and by B; none by both where the tokens' bytes are not the space and the text."""
        of, some = [], []
        for i, raw in enumerate(texts):
            if raw:
                for p in parts(raw.decode("utf-8", "replace")):
                    of.append(i)
                    some.append(p)
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        for i, p, ids in zip(of, some, self.b.encode(some, num_threads=1)):
            a[i] += self.a.ids(" " + p)
            b[i] += ids
        for i, raw in enumerate(texts):
            whole = b" " + raw
            if b"".join(map(self.bytes_a.__getitem__, a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


@lru_cache(maxsize=2)
def _aligner(vocabulary: bytes, model: bytes, pattern: str) -> Aligner:
    return Aligner(vocabulary, model, pattern)


class Alignment:
    """The tokens of some texts end to end, and the groups and overlaps that their owner arrays give."""

    def __init__(self, aligner: Aligner, texts: list[bytes]):
        a, b = aligner.encode(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        self.a, self.b = (np.fromiter((i for ids in x for i in ids), np.int64, n.sum()) for x, n in ((a, self.n_a), (b, self.n_b)))
        size_a, size_b = aligner.size_a[self.a], aligner.size_b[self.b]
        own_a, own_b = np.repeat(np.arange(len(self.a)), size_a), np.repeat(np.arange(len(self.b)), size_b)
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        first = np.zeros(min(len(own_a), 1), np.int64)
        group = np.concatenate([first, np.cumsum(new_a & new_b)])
        at = np.concatenate([first, np.flatnonzero(new_a | new_b) + 1])
        self.over_a, self.over_b = own_a[at], own_b[at]
        self.begin_a = np.cumsum(size_a) - size_a
        self.group_a, self.group_b = group[self.begin_a], group[np.cumsum(size_b) - size_b]
        n = int(group[-1]) + 1 if len(group) else 0
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.text_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.text_group = self.text_a[self.first_a]
        self.n_groups = np.bincount(self.text_group, minlength=len(texts))
        self.n_links = np.bincount(self.text_group, self.in_a * self.in_b, minlength=len(texts)).astype(np.int64)

    def pairs(self, aligner: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text's links as a * (size of B) + b, how often each, and where each text's begin (and end)."""
        wide_b = len(aligner.bytes_b)
        codes = len(aligner.bytes_a) * wide_b
        links = self.in_a * self.in_b
        here = np.flatnonzero(links[self.group_a] <= WIDE)
        count = self.in_b[self.group_a[here]]
        left = np.repeat(here, count)
        right = np.repeat(self.first_b[self.group_a[here]] - np.cumsum(count) + count, count) + np.arange(len(left))
        keys, times = [self.text_a[left] * codes + self.a[left] * wide_b + self.b[right]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(links > WIDE).tolist():
            ids_a, times_a = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.in_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.in_b[g]], return_counts=True)
            keys.append((self.text_group[g] * codes + ids_a[:, None] * wide_b + ids_b).ravel())
            times.append((times_a[:, None] * times_b).ravel())
        key, time = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, time = key[order], time[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        key, time = key[new], np.add.reduceat(time, new) if len(new) else time
        return key % codes, time, np.searchsorted(key, np.arange(len(self.n_a) + 1) * codes)

    def groups_text(self, aligner: Aligner) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text, '' without tokens."""
        wide_a, wide_b = len(aligner.bytes_a), len(aligner.bytes_b)
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        last_a, last_b = i + 1 == (self.first_a + self.in_a)[self.group_a], j + 1 == (self.first_b + self.in_b)[self.group_b]
        names = np.zeros(len(i) + len(j), np.int64)
        names[i + self.first_b[self.group_a]] = self.a + wide_a * last_a
        names[j + (self.first_a + self.in_a)[self.group_b]] = self.b + 2 * wide_a + wide_b * last_b
        spelled = list(map(aligner.names.__getitem__, names.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(spelled[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _tokenizers(docs: DataFrame, vocabulary: str, model: str) -> tuple[Broadcast, Broadcast]:
    """The bytes of both files, whose sizes the vocabularies fix (a few MB)."""
    context = docs.sparkSession.sparkContext
    return context.broadcast(read_bytes(vocabulary)), context.broadcast(read_bytes(model))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, vocabulary: str, model: str, pattern: str) -> DataFrame:
    """doc_id, a_ids, b_ids (array<int>), cuts (array<long>: byte offsets in space + text at which groups end) and overlaps
    (array<struct<a int, b int>>: indices of tokens that share bytes, in the order of the text) of every row.

    A null or empty text, or one whose tokens by A or B do not spell it, has empty arrays. Every row is handled by itself, so
    repeated rows, null ids and other columns do not matter; an empty table gives an empty one. One map, no shuffle.
    """
    files = _tokenizers(docs, vocabulary, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files[0].value, files[1].value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                x = Alignment(aligner, texts)
                bytes_before = np.cumsum([0, *(len(t) + 1 if n else 0 for t, n in zip(texts, x.n_a))])
                ends = np.append(x.begin_a, bytes_before[-1])[x.first_a + x.in_a] - bytes_before[x.text_group]
                first = [np.cumsum(n) - n for n in (x.n_a, x.n_b)]
                text_of = x.text_a[x.over_a]
                over = [pa.array(o - f[text_of], pa.int32()) for o, f in zip((x.over_a, x.over_b), first)]
                n_over = np.bincount(text_of, minlength=len(texts))
                pairs = pa.StructArray.from_arrays(over, ["a", "b"])
                columns = [part.column(0), _lists(x.a, x.n_a, pa.int32()), _lists(x.b, x.n_b, pa.int32()), _lists(ends, x.n_groups, pa.int64())]
                overlaps = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_over)]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([*columns, overlaps], ["doc_id", "a_ids", "b_ids", "cuts", "overlaps"])

    return _texts(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, cuts array<long>, overlaps array<struct<a:int,b:int>>")


def links(docs: DataFrame, vocabulary: str, model: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (array<long>: distinct id pairs of the links, a * (size of B) + b)
    and times (array<long>) of every row; rows as in align. groups_sha256 is '' without tokens."""
    files = _tokenizers(docs, vocabulary, model)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files[0].value, files[1].value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                x = Alignment(aligner, texts)
                pairs, times, begin = x.pairs(aligner)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.groups_text(aligner)]
                numbers = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                columns = [part.column(0), *numbers, pa.array(digests, pa.string()), *[_lists(v, np.diff(begin), pa.int64()) for v in (pairs, times)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame, wide_b: int) -> DataFrame:
    """(pair, n_docs, best): in how many rows of `linked` each id pair is linked, and whether no pair of its A id is in more.

    Counts are combined before the shuffle. The table has a row an id pair, not a document; the greatest counts have a row an
    A id at most, so they are broadcast.
    """
    counts = cut(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    of: Column = F.floor(F.col("pair") / wide_b)
    most = counts.groupBy(of.alias("a")).agg(F.max("n_docs").alias("most"))
    return cut(counts.join(F.broadcast(most), of == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def shared_level(counts: DataFrame, rows: int) -> int:
    """The least power of two such that at most `rows` pairs have so many documents; power classes, at most 64, come to the driver."""
    classes = counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    level, held = 64, 0
    for p, n in sorted(((x.p, x.n) for x in classes), reverse=True):
        held += n
        if held > rows:
            break
        level = p
    return 1 << min(level, 62)


def scored_links(docs: DataFrame, vocabulary: str, model: str, pattern: str, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; rows as in align, a row is a document.

    n_best: links whose id pair is in as many documents as any pair of its A id; count_sum: the documents of each link's pair,
    summed over links. Texts are encoded once: the id pairs of each are written, counted, and looked up. The most frequent pairs
    are looked up in a broadcast table of `shared_pairs` rows at most; all others are joined to their counts, and as each of them
    is in few documents, no key of that join is hot.
    """
    spark = docs.sparkSession
    linked = stored(links(docs, vocabulary, model, pattern).withColumn("row", F.monotonically_increasing_id()), "links")
    wide_b = sentencepiece.SentencePieceProcessor(model_file=model).vocab_size()
    counts = pair_counts(linked, wide_b)
    level = shared_level(counts, shared_pairs)
    shared = counts.where(F.col("n_docs") >= level).toArrow()
    order = np.argsort(shared["pair"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(shared[c].to_numpy()[order] for c in ("pair", "n_docs", "best")))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = known.value
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            size = columns["pairs"].value_lengths().to_numpy()
            mine, times = (columns[c].flatten().to_numpy() for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            found, text = at[hit], np.repeat(np.arange(len(size)), size)
            n_best, count_sum = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(n_best, text[hit], times[hit] * best[found])
            np.add.at(count_sum, text[hit], times[hit] * n_docs[found])
            n_rare = np.bincount(text[~hit], minlength=len(size))
            rest = [_lists(v[~hit], n_rare, pa.int64()) for v in (mine, times)]
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in plain], pa.array(n_best), pa.array(count_sum), *rest], [*plain, "n_best", "count_sum", "rare", "rare_times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, n_best long, count_sum long, rare array<long>, rare_times array<long>"
    out = linked.mapInArrow(run, schema)
    rare = out.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("code"), F.col("r.rare_times").alias("times"))
    rare = rare.join(counts.where(F.col("n_docs") < level), F.col("code") == F.col("pair")).groupBy(F.col("row").alias("at"))
    sums = rare.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.join(sums, F.col("row") == F.col("at"), "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
