"""N-gram Jaccard self-join: an LSH forest of MinHash labels finds candidates, exact Jaccard of five-word shingles decides.

Words are the white-space words of the text in ASCII lower case; documents with equal shingle sets are one class throughout.
Every class has TREES labels of LABEL MinHash values (16 bits each). A tree is the prefix trie of its labels: the classes that
agree in the first d values hang under one node of depth d. Each class starts from its whole labels and shortens the matched
prefix of one tree at a time, the step that brings fewest further classes first, until a pair at the threshold would share a
matched prefix in some tree with TARGET_RECALL. So a class in a crowded part of some trees keeps long prefixes there and takes
short ones elsewhere. Where no other class shares even SHORTEST values, the shortest prefix costs nothing. All classes under a
node that some class matched are candidates of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declq.llm import pairs
from declq.llm.common import SIMILARITY, components, cut, mix, plain, shingle_hashes, slices, small_side, split_words, without_ids

#: SHORTEST in all trees must reach the target: 1 - (1 - 0.8^4)^16 = 0.9998.
TREES, LABEL, SHORTEST, TARGET_RECALL = 16, 8, 4, 0.999


def recall(depths: list[int], similarity: float = SIMILARITY) -> float:
    """Chance that a pair of this similarity shares a prefix of some tree's depth in that tree."""
    return 1 - math.prod(1 - similarity**d for d in depths)


def matched_depths(sizes: dict[int, dict[int, int]], target: float = TARGET_RECALL) -> dict[int, int]:
    """Depth of the matched prefix for each tree of `sizes` (tree: depth: classes under the node); the other trees have SHORTEST.

    A depth that is missing has one class, the own one.
    """
    depth = dict.fromkeys(sizes, LABEL)
    free = [SHORTEST] * (TREES - len(sizes))
    while recall([*free, *depth.values()]) < target:
        more = lambda t: sizes[t].get(depth[t] - 1, 1) - sizes[t].get(depth[t], 1)
        tree = min((t for t in depth if depth[t] > SHORTEST), key=lambda t: (more(t), -depth[t], t))
        depth[tree] -= 1
    return depth


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each (lower-cased) text, sorted, and the offsets of the texts."""
    words, ends = split_words(texts)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h, offs = shingle_hashes(hashed, ends)
    of = np.repeat(np.arange(len(texts)), np.diff(offs))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[first], of[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int64)


def set_hashes(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each non-empty set."""
    starts = offs[:-1][np.diff(offs) > 0]
    total = lambda salt: np.add.reduceat(mix(h + np.uint64(salt)), starts).view(np.int64)
    return total(0x51ED2701), total(0xA3C59AC3)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to the set hashes, size and labels of every text with a word; a label is two runs of four values."""
    rng = np.random.default_rng(2024)
    odd = rng.integers(0, 1 << 63, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for part, texts in slices(batch, "text", 2 << 20, lower=True):
            h, offs = shingle_sets(texts)
            size = np.diff(offs)
            has = np.flatnonzero(size)
            if not len(has):
                continue
            starts = offs[:-1][has]
            s1, s2 = set_hashes(h, offs)
            half = np.zeros((len(has), TREES * 2), np.uint64)
            for k in range(TREES * LABEL):
                value = mix(np.minimum.reduceat(h * odd[k], starts)) >> np.uint64(48)
                half[:, k // 4] = half[:, k // 4] << np.uint64(16) | value
            labels = pa.FixedSizeListArray.from_arrays(pa.array(half.view(np.int64).ravel()), TREES * 2).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(has)), pa.array(s1), pa.array(s2), pa.array(size[has]), labels], ["doc_id", "s1", "s2", "n", "labels"])


def _match(group: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """The nodes above one class, (tree, depth, classes, node), to the nodes that it matches."""
    sizes: dict[int, dict[int, int]] = {}
    at = {}
    for tree, depth, size, node in zip(group["tree"], group["depth"], group["size"], group["node"]):
        sizes.setdefault(tree, {})[depth] = size
        at[tree, depth] = node
    found = [at[x] for x in matched_depths(sizes).items() if x in at]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["node"])


def candidate_stars(classes: DataFrame) -> DataFrame:
    """(src, dst): links that connect the classes (id, labels) under each matched node to its least class."""
    halves = lambda t: F.struct(t.alias("tree"), F.get("labels", 2 * t).alias("hi"), F.get("labels", 2 * t + 1).alias("lo"))
    rows = classes.select("id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), halves)))
    # Most classes share no prefix of SHORTEST = 4 values, the first half of a label: they go before the tries are read.
    shared = rows.groupBy(F.col("tree").alias("st"), F.col("hi").alias("sh")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("st", "sh")
    near = cut(rows.join(shared, (F.col("tree") == F.col("st")) & (F.col("hi") == F.col("sh")), "left_semi"))
    node = lambda d: F.xxhash64("tree", F.lit(d), "hi", F.lit(0) if d == SHORTEST else F.shiftrightunsigned("lo", 16 * (LABEL - d)))
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), node(d).alias("node")) for d in range(SHORTEST, LABEL + 1)])
    above = near.select("id", "tree", F.inline(levels))
    tries = above.groupBy(F.col("node").alias("at")).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("head")).where("size > 1")
    above = cut(above.join(tries, F.col("node") == F.col("at")).select("id", "tree", "depth", "node", "size", "head"))
    matched = pairs.map_groups(above.select("id", "tree", "depth", "size", "node"), ["id"], _match, "node long").distinct()
    under = above.join(matched.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left_semi")
    return under.select(F.col("id").alias("src"), F.col("head").alias("dst")).where("src <> dst").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, s1, s2, component, copies, text) to rows with the sorted shingle set, if the text is the class's."""
    for batch in batches:
        for part, texts in slices(batch, "text", 2 << 20, lower=True):
            h, offs = shingle_sets(texts)
            size = np.diff(offs)
            has = np.flatnonzero(size)
            s1, s2 = set_hashes(h, offs) if len(has) else (np.zeros(0, np.int64),) * 2
            rows = part.take(pa.array(has))
            same = (rows.column(1).to_numpy() == s1) & (rows.column(2).to_numpy() == s2)
            kept = rows.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), kept.column(4), pa.array([h[offs[i] : offs[i + 1]].tobytes() for i in has[same]], pa.binary())], ["id", "component", "copies", "shingles"])


def _verify(group: dict[str, list], threshold: float = SIMILARITY, columns: int = 4096) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks of a component: (id, links, root) for members with a link; each pair is seen once."""
    rows = sorted({x: i for i, x in enumerate(group["id"])}.values(), key=lambda i: group["id"][i])  # a repeated row is the same member
    n = len(rows)
    if n < 2:
        return
    ids = np.array([group["id"][i] for i in rows])
    block, copies = np.array([group["block"][i] for i in rows]), np.array([group["copies"][i] for i in rows])
    sets = [np.frombuffer(group["shingles"][i], np.uint64) for i in rows]
    size = np.array([len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    shared = count[place] > 1
    of, place = of[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    both = np.zeros((n, n), np.float32)
    last = int(place[-1]) + 1 if len(place) else 0
    for lo in range(0, last, columns):
        a, b = np.searchsorted(place, [lo, lo + columns])
        cells = np.zeros((n, columns), np.float32)
        cells[of[a:b], place[a:b] - lo] = 1
        both += cells @ cells.T
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if group["lo"][0] != group["hi"][0]:
        linked &= block[:, None] != block[None, :]
    any_link = linked.any(1)
    if any_link.any():
        root = pairs.roots(n, linked)
        yield pa.RecordBatch.from_arrays([pa.array(ids[any_link]), pa.array((linked @ copies)[any_link].astype(np.int64)), pa.array(ids[root[any_link]])], ["id", "links", "root"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for every row: class_id is the least doc_id of the connected group.

    n_links counts the other documents at a Jaccard similarity of SIMILARITY or more, equal shingle sets included
    (n_copies of them, the document itself counted). Texts without a word (null, empty) are groups of their own without
    links; a text of one to four words has one shingle; long texts are taken whole. Rows that share a doc_id are one
    document (null ids stay alone); if their texts differ, each has its links, and the document the least group and the
    most links of them. An empty table gives no rows.
    """
    texts = plain(docs)
    sketches = cut(texts.where("doc_id is not null").mapInArrow(_sketch, "doc_id long, s1 long, s2 long, n long, labels array<long>"))
    key = F.xxhash64("s1", "s2", "n").alias("id")
    classes = cut(sketches.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("labels").alias("labels")).select(key, "s1", "s2", "rep", "copies", "labels"))
    found = components(candidate_stars(classes.select("id", "labels")))
    members = cut(classes.join(found, F.col("id") == F.col("node")).select("id", "s1", "s2", "component", "copies", "rep"))
    carried = texts.join(small_side(members), F.col("doc_id") == F.col("rep")).select("id", "s1", "s2", "component", "copies", "text")
    sets = cut(carried.mapInArrow(_sets, "id long, component long, copies long, shingles binary"))
    checked = cut(pairs.map_groups(pairs.block_pairs(sets, "component", "id"), ["component", "lo", "hi"], _verify, "id long, links long, root long"))
    links = checked.groupBy(F.col("id").alias("lid")).agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    groups = groups.join(classes.select("id", "rep"), F.col("id") == F.col("node")).select("node", "component", "rep")
    least = groups.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("class_id"))
    linked = groups.join(least, F.col("component") == F.col("c")).join(links, F.col("node") == F.col("lid")).select(F.col("node").alias("vid"), "class_id", "links")
    verdict = classes.select("id", "rep", "copies").join(linked, F.col("id") == F.col("vid"), "left")
    verdict = verdict.select("id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    of_doc = sketches.select("doc_id", key.alias("of")).join(verdict, F.col("of") == F.col("id"))
    of_doc = of_doc.groupBy(F.col("doc_id").alias("did")).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("n_copies").alias("n_copies"))
    out = texts.select("doc_id").join(of_doc, F.col("doc_id") == F.col("did"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one of least doc_id; texts without words all stay."""
    return without_ids(docs, near_duplicates(docs).where("class_id <> doc_id").select("doc_id"))
