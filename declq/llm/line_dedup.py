"""Fuzzy line deduplication: SimHash and edit similarity of candidate lines, one occurrence per connected group.

A line is normalised to its white-space words in ASCII lower case, joined by single spaces; lines without a word are left
alone. Equal normal lines are one node. Two nodes are linked if their edit similarity, 1 - Levenshtein distance / length of
the longer, is at least SIMILARITY. Of each connected group the first occurrence stays, by (doc_id, line number).

Candidates share a join key, and their 64-bit SimHashes (of letter grams) differ in at most DISTANCE bits. SimHash blocks do
not serve as keys: at SIMILARITY a tenth of the pairs is over 10 bits apart, and pigeonhole blocks that are equal at such
distances are equal for unrelated lines too. The keys are MinHash values instead: of letter grams for lines of up to SHORT
characters, of word pairs for lines of at least SIMILARITY * SHORT; as lengths of linked lines differ by no more, they always
have keys of one kind in common.

Every node is checked against the least node of each of its keys first: one row a node and head, however large the group.
Only nodes that fail against a head meet the other nodes of that key, in a grid of blocks, and stop once connected. Links are
connected after they are verified, so chance meetings never hang together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm import pairs
from declq.llm.common import SIMILARITY, components, cut, free_names, mix, plain, release, slices, small_side

DISTANCE = 20
#: Bytes of a letter gram; characters of a short line; MinHash values of a key; keys of letter grams and of word pairs.
GRAM, SHORT, VALUES, GRAM_KEYS, PAIR_KEYS = 5, 80, 3, 16, 12
#: Nodes that meet one head in a task; in the grid, failed nodes and other nodes of a key that meet in a task.
FOLLOWERS, FAILED, OTHERS = 1024, 128, 1024
#: Bytes of a brief word; of one that is hashed together with others at most.
BRIEF, LONG_WORD = 3, 48
#: Characters of two gaps between shared words whose edit distance is worked out for the upper bound.
GAP = 200
#: Characters of the lines that are compared with one line at once; pairs with one line from which that pays.
ABREAST, SHARED = 1 << 13, 3
#: Characters of lines that are compared side by side; pairs a word of pattern from which that pays; cells of its tables.
MODEST, WORTH, TOGETHER = 256, 32, 1 << 20
#: Characters of the pairs, or bytes of the groups, that wait to be compared together.
WAITING = 1 << 22
#: Bytes of lines whose SimHashes are worked out at once (64 bytes of counts a letter).
SKETCH_BYTES = 1 << 18
#: Lines that a task remembers, so that a frequent line gives its keys a few times and not with every row.
SEEN = 200_000
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_ODD = mix(np.arange(1, (GRAM_KEYS + PAIR_KEYS) * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def simhash(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of feature-hash runs that begin at `starts` (none empty). Bits are counted eight to a 64-bit lane, 255 features a time."""
    lens = np.diff(starts, append=len(features))
    chunks = -(-lens // 255)
    first = np.cumsum(chunks) - chunks
    begin = np.repeat(starts, chunks) + (np.arange(chunks.sum()) - np.repeat(first, chunks)) * 255
    lanes = _SPREAD[features.view(np.uint8).reshape(-1, 8)]
    ones = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).reshape(len(begin), 64).astype(np.int64)
    ones = np.add.reduceat(ones, first, axis=0)
    return np.packbits(ones * 2 > lens[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of signed hashes; unsigned for the count, as bitwise_count takes absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def letter_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte grams of each text with a space at both ends, and where each text's begin."""
    padded = [(b" " + x + b" ").ljust(GRAM) for x in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    letters = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    count = size - GRAM + 1
    starts = np.cumsum(count) - count
    at = np.repeat(np.cumsum(size) - size - starts, count) + np.arange(count.sum())
    grams = np.zeros(len(at), np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(257) + letters[at + j]
    return mix(grams), starts


def line_simhashes(lines: list[bytes]) -> np.ndarray:
    """SimHashes of the letter grams of normal lines, a bounded number of bytes (or one line) at a time."""
    out, start, size = [np.zeros(0, np.uint64)], 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) > SKETCH_BYTES:
            out.append(simhash(*letter_grams(lines[start:i])))
            start, size = i, 0
        size += len(x)
    if start < len(lines):
        out.append(simhash(*letter_grams(lines[start:])))
    return np.concatenate(out).view(np.int64)


def _least(features: np.ndarray, starts: np.ndarray, first: int, keys: int) -> np.ndarray:
    """Keys of VALUES MinHash values each, of the feature runs that begin at `starts`."""
    out = np.zeros((len(starts), keys), np.uint64)
    for k in range(keys):
        key = np.full(len(starts), first + k, np.uint64)
        for v in range(VALUES):
            key = mix(key * np.uint64(31) + np.minimum.reduceat(features * _ODD[(first + k) * VALUES + v], starts))
        out[:, k] = key
    return out.view(np.int64)


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def word_pairs(hashed: np.ndarray, brief: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words of each line, and where each line's begin.

    Pairs of two `brief` words are in most lines of a language and tell nothing apart: they count only in a line without others.
    A line of one word has that word.
    """
    count = np.maximum(lens - 1, 1)
    at = np.cumsum(count) - count
    here = np.repeat(starts - at, count) + np.arange(count.sum())
    after = np.minimum(here + 1, len(hashed) - 1)
    pair = mix(hashed[here] * np.uint64(31) + hashed[after] * np.repeat(lens > 1, count))
    telling = ~(brief[here] & brief[after])
    left = np.add.reduceat(telling, at)
    telling |= np.repeat(left == 0, count)
    left = np.where(left == 0, count, left)
    return pair[telling], np.cumsum(left) - left


def line_keys(lines: list[bytes], hashed: np.ndarray, brief: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of normal lines, whose word hashes are runs of `hashed`, and the line of each key, in order."""
    tidy = [x if n <= SHORT // 2 else b"" for x, n in zip(lines, lens)]  # more words alone are more than SHORT characters
    chars = np.fromiter((len(x) if x.isascii() else len(x.decode(errors="replace")) for x in tidy), np.int64, len(tidy))
    chars[chars == 0] = SHORT + 1
    short, long = np.flatnonzero(chars <= SHORT), np.flatnonzero(chars >= int(SIMILARITY * SHORT))
    keys, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(short):
        grams, at = letter_grams([tidy[i] for i in short])
        keys.append(_least(grams, at, 0, GRAM_KEYS).ravel())
        of.append(np.repeat(short, GRAM_KEYS))
    if len(long):
        pair, at = word_pairs(hashed, brief, starts[long], lens[long])
        keys.append(_least(pair, at, GRAM_KEYS, PAIR_KEYS).ravel())
        of.append(np.repeat(long, PAIR_KEYS))
    keys, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return keys[order], of[order]


def word_hashes(letters: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes. All words step through their bytes at once, the longest first; very long ones are hashed apart."""
    order = np.argsort(-np.minimum(lens, LONG_WORD + 1).astype(np.int16), kind="stable")
    at, size = starts[order], lens[order]
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active = np.searchsorted(-size, -np.arange(min(int(size[0]), LONG_WORD) if len(size) else 0), "left")
    for j, m in enumerate(active.tolist()):
        h[:m] = (h[:m] ^ letters[at[:m] + j]) * np.uint64(0x100000001B3)
    for i in range(int((size > LONG_WORD).sum())):
        h[i] = xxhash.xxh3_64_intdigest(letters[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


class Lines:
    """The lines with a word of some texts: text (row) and line number, the normal line and its 64-bit hash, and the hashes of its words."""

    def __init__(self, texts: list[bytes]):
        buffer = b"\n".join([*texts, b""]).lower()
        letters = np.frombuffer(buffer, np.uint8)
        space = _IS_SPACE[letters]
        ends = np.flatnonzero(letters == 10)
        begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        before = np.concatenate([[True], space[:-1]])
        starts, stops = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        first, last = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        has = np.flatnonzero(last > first)
        self.starts, self.lens = first[has], (last - first)[has]
        self.row = np.searchsorted(text_ends, ends[has])
        self.pos = has - np.searchsorted(ends, np.concatenate([[-1], text_ends[:-1]]), "right")[self.row]
        size = stops - starts
        self.hashed, self.brief = word_hashes(letters, starts, size), size <= BRIEF
        # A line is normal as it is if single spaces, and nothing else, are between its words.
        heads, tails = starts[self.starts], stops[self.starts + self.lens - 1]
        total = np.concatenate([[0], np.cumsum(size)])
        plain = tails - heads - (total[self.starts + self.lens] - total[self.starts]) == self.lens - 1
        odd = np.flatnonzero(space & (letters != 32) & (letters != 10))
        plain &= np.searchsorted(odd, tails) == np.searchsorted(odd, heads)
        self.lines = [buffer[a:b] if ok else b" ".join(buffer[a:b].split()) for a, b, ok in zip(heads.tolist(), tails.tolist(), plain.tolist())]
        self.whole = line_hashes(self.lines)


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, t) to a row (doc_id, place, h, keys) for every line with a word.

    place is the line number and 32 bits of t, its sign bit set where the document has the line before. Join keys come with a
    line's first row in a task.
    """
    seen: set[int] = set()
    for batch in batches:
        for part, texts in slices(batch, "text", 2 << 20):
            x = Lines(texts)
            row, pos, whole = x.row, x.pos, x.whole
            if len(seen) > SEEN:
                seen = set()
            known, new = len(seen), []
            for i, h in enumerate(whole.tolist()):
                seen.add(h)
                if len(seen) > known:
                    known += 1
                    new.append(i)
            new = np.array(new, np.int64)
            keys, of = line_keys([x.lines[i] for i in new], x.hashed, x.brief, x.starts[new], x.lens[new])
            runs = np.searchsorted(new[of], np.arange(len(whole) + 1)).astype(np.int32)
            t = part.column(2).take(pa.array(row))
            order = np.lexsort((pos, whole, row))
            leads = np.ones(len(whole), bool)
            leads[order[1:]] = (whole[order[1:]] != whole[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
            place = pos << 32 | t.to_numpy() & 0xFFFFFFFF | np.where(leads, 0, np.int64(-(2**63)))
            columns = [pa.array(place), pa.array(whole), pa.ListArray.from_arrays(runs, pa.array(keys))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *columns], ["doc_id", "place", "h", "keys"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, array of line numbers) to (h, sim, line): the normal lines at these numbers."""
    for batch in batches:
        for part, texts in slices(batch, "text", 2 << 20):
            lines = [normal(of[i]) for of, wanted in zip((t.split(b"\n") for t in texts), part.column(1).to_pylist()) for i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(line_hashes(lines)), pa.array(line_simhashes(lines)), pa.array(lines, pa.binary()).cast(pa.string())], ["h", "sim", "line"])


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end, which no least edit touches."""
    lo = _common(a, b)
    a, b = a[lo:], b[lo:]
    end = _common(a[::-1], b[::-1])
    return a[: len(a) - end], b[: len(b) - end]


def edit_distances(text: str, patterns: list[str]) -> list[int]:
    """Exact edit distances of a text to several patterns at once, by Myers' bit vectors (Hyyro's form).

    The patterns lie side by side in one Python integer, a spare bit between them that takes the carries.
    """
    codes = np.frombuffer("\0".join([*patterns, ""]).encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, patterns), np.int64, len(patterns))
    ends = np.cumsum(lens + 1) - 1
    bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    inside, first = np.ones(len(codes), bool), np.zeros(len(codes), bool)
    inside[ends], first[(ends - lens)[lens > 0]] = False, True
    where = {c: bits(codes == ord(c)) for c in set(text)}
    full, ones = bits(inside), bits(first)
    plus, minus = full, 0
    for c in text:
        eq = where[c]
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = ((minus | (full ^ (d0 | plus))) << 1 | ones) & full
        plus, minus = ((d0 & plus) << 1 & full) | (full ^ (d0 | up)), up & d0
    out = []
    for start, n in zip((ends - lens).tolist(), lens.tolist()):  # the last column's steps down a pattern add up to its distance
        lane = (1 << n) - 1
        out.append(len(text) + (plus >> start & lane).bit_count() - (minus >> start & lane).bit_count())
    return out


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Exact edit distance of two texts. With `most`, it stops once the distance is sure to be larger, and returns some larger number."""
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    plus, minus, score = full, 0, 0
    for start in range(0, len(b), 64):
        for c in b[start : start + 64]:
            eq = where.get(c, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up = ((minus | (full ^ (d0 | plus))) << 1 | 1) & full
            plus, minus = ((d0 & plus) << 1 & full) | (full ^ (d0 | up)), up & d0
        done = min(start + 64, len(b))
        score = done + plus.bit_count() - minus.bit_count()
        if most is None:
            continue
        if score - (len(b) - done) > most:  # a character lowers the score by one at most
            return score - (len(b) - done)
        if len(b) - done >= 64:  # every way to the end leads through this column, and on over as many steps as lengths differ by
            up, down = (np.unpackbits(np.frombuffer(x.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(a)).view(np.int8) for x in (plus, minus))
            column = np.cumsum(up - down, dtype=np.int64) + np.abs(np.arange(len(a) - 1, -1, -1) - (len(b) - done)) + done
            least = min(int(column.min()), done + abs(len(a) - (len(b) - done)))
            if least > most:
                return least
    return score


def distance_bound(a: str, b: str, most: int | None = None) -> int:
    """An upper bound of the edit distance: words that are in both once, in the longest order they share, stay; gaps are edited.

    With `most`, it stops once the bound is larger, and returns some larger number.
    """
    x, y = a.split(" "), b.split(" ")
    at: list[dict[str, int]] = [{}, {}]
    for seen, words in zip(at, (x, y)):
        for i, w in enumerate(words):
            seen[w] = -1 if w in seen else i
    other = at[1]
    shared = [(i, other[w]) for w, i in at[0].items() if i >= 0 and other.get(w, -1) >= 0]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(shared):
        d = bisect_left(ends, j)
        ends[d : d + 1], last[d : d + 1] = [j], [k]
        before.append(last[d - 1] if d else -1)
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(shared[k])
        k = before[k]
    total, i, j = 0, len(x), len(y)
    for p, q in [*chain, (-1, -1)]:
        if i - p > 1 or j - q > 1:
            u, v = " ".join(["", *x[p + 1 : i], ""]), " ".join(["", *y[q + 1 : j], ""])
            total += levenshtein(u, v) if len(u) + len(v) <= GAP else max(len(u), len(v))
            if most is not None and total > most:
                break
        i, j = p, q
    return total


def most_edits(a: str, b: str, threshold: float = SIMILARITY) -> int:
    return int((1 - threshold) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, threshold: float = SIMILARITY) -> bool:
    """Whether the edit similarity is at least the threshold. Cheap bounds decide most pairs, the exact distance the others."""
    most = most_edits(a, b, threshold)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    return max(len(a), len(b)) <= most or distance_bound(a, b, most) <= most or levenshtein(a, b, most) <= most


def side_by_side(texts: list[str], patterns: list[str], most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs, exact where at most `most`, else some number above it, for lengths no further apart than that.

    Myers' bit vectors in 64-bit words, each step for all pairs whose texts are that long. Only words within the largest bound of
    the diagonal are worked out: above them distances grow by one a step, below them by one a row, so none is too small.
    """
    n, size, rows = len(texts), np.fromiter(map(len, texts), np.int64, len(texts)), np.fromiter(map(len, patterns), np.int64, len(patterns))
    order = np.argsort(-size, kind="stable")
    size, rows = size[order], rows[order]
    words = -(-int(rows.max()) // 64)
    codes = [np.frombuffer("".join([x[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32) for x in (texts, patterns)]
    letters = np.zeros(max(int(x.max()) for x in codes) + 1, bool)
    for x in codes:
        letters[x] = True
    dense, kinds = np.cumsum(letters) - 1, int(letters.sum())
    if n > 1 and n * kinds * words > 2 * TOGETHER:  # many letters: the tables of a part of the pairs at a time
        out, half = np.empty(n, np.int64), n // 2
        for some in (order[:half], order[half:]):
            out[some] = side_by_side([texts[i] for i in some], [patterns[i] for i in some], most[some])
        return out
    of = [np.repeat(np.arange(n), lens) for lens in (size, rows)]
    step, row = (np.arange(len(x)) - np.repeat(np.cumsum(lens) - lens, lens) for x, lens in zip(codes, (size, rows)))
    at = np.zeros((int(size[0]), n), np.int64)
    at[step, of[0]] = of[0] * kinds + dense[codes[0]]
    table = np.zeros(words * n * kinds, np.uint64)
    np.add.at(table, (row >> 6) * (n * kinds) + of[1] * kinds + dense[codes[1]], np.uint64(1) << (row & 63).astype(np.uint64))
    table = table.reshape(words, n * kinds)
    plus, minus = np.full((words, n), 2**64 - 1, np.uint64), np.zeros((words, n), np.uint64)
    one, top, band = np.uint64(1), np.uint64(63), int(most.max())
    for j, m in enumerate(np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()):
        carry, up_in, down_in = None, one, None
        last = min(words, (j + 1 + band) // 64 + 1)
        for w in range(max(0, (j + 1 - band) // 64 - 1), last):
            p, q, eq = plus[w, :m], minus[w, :m], table[w].take(at[j, :m])
            d0 = eq & p
            d0 += p
            if w + 1 < last:
                over = d0 < p
            if carry is not None:
                d0 += carry
                if w + 1 < last:
                    over |= d0 < carry
            if w + 1 < last:
                carry = over.astype(np.uint64)
            d0 ^= p
            d0 |= eq
            d0 |= q
            up = d0 | p
            np.invert(up, out=up)
            up |= q
            down = p & d0
            shifted = up << one
            shifted |= up_in
            lower = down << one
            if down_in is not None:
                lower |= down_in
            if w + 1 < last:
                up_in, down_in = up >> top, down >> top
            np.bitwise_and(d0, shifted, out=q)
            d0 |= shifted
            np.invert(d0, out=d0)
            np.bitwise_or(lower, d0, out=p)
    total = size.copy()  # the last column's steps down a pattern add up to its distance
    for w in range(words):
        left = np.clip(rows - 64 * w, 0, 64)
        inside = np.where(left > 0, np.uint64(2**64 - 1) >> (64 - np.maximum(left, 1)).astype(np.uint64), np.uint64(0))
        total += np.bitwise_count(plus[w] & inside).astype(np.int64) - np.bitwise_count(minus[w] & inside)
    out = np.empty(n, np.int64)
    out[order] = total
    return out


def similar_pairs(pairs: list[tuple[str, str]]) -> np.ndarray:
    """`similar` of many pairs. Short ones are compared side by side, long ones that share their first line in one integer."""
    out = np.zeros(len(pairs), bool)
    brief: list[tuple[int, int, str, str, int]] = []
    long: dict[str, list[tuple[int, int, str, str, int]]] = {}
    for i, (x, y) in enumerate(pairs):
        most = most_edits(x, y)
        if abs(len(x) - len(y)) > most:
            continue
        a, b = trimmed(x, y)
        if len(a) > len(b):
            a, b = b, a
        if len(b) <= most:
            out[i] = True
        elif len(b) <= MODEST:
            brief.append((len(b), i, a, b, most))
        else:
            long.setdefault(x, []).append((len(b), i, a, b, most))
    alone: list[tuple[int, int, str, str, int]] = []
    for text, of in long.items():
        while len(of) >= SHARED:
            room = ABREAST
            some = [of.pop()]
            while of and (room := room - len(pairs[some[-1][1]][1])) > 0:
                some.append(of.pop())
            for (_, i, _, _, most), d in zip(some, edit_distances(text, [pairs[x[1]][1] for x in some])):
                out[i] = d <= most
        alone += of
    brief.sort(key=lambda x: x[0])
    start = 0
    while start < len(brief):
        end = bisect_left(brief, max(brief[start][0] + 24, brief[start][0] * 4 // 3), start + 1, key=lambda x: x[0])
        end = min(end, start + TOGETHER // MODEST)
        _, at, a, b, bounds = zip(*brief[start:end])
        if len(at) >= WORTH * -(-max(map(len, a)) // 64):
            out[list(at)] = side_by_side(list(b), list(a), np.array(bounds)) <= np.array(bounds)
        else:
            alone += brief[start:end]
        start = end
    for _, i, a, b, most in alone:
        out[i] = (len(b) > MODEST // 2 and distance_bound(a, b, most) <= most) or levenshtein(a, b, most) <= most
    return out


def _distinct(group: dict[str, list]) -> list[int]:
    """A row for each node of a group (rows that repeat a document fetch a line twice), least node first."""
    return sorted({h: i for i, h in enumerate(group["h"])}.values(), key=lambda i: group["h"][i])


def _follow(groups: Iterator[dict[str, list]]) -> Iterator[pa.RecordBatch]:
    """Groups of a head (the least node) and its nodes to (h, head, linked)."""
    h: list[int] = []
    heads: list[int] = []
    apart: list[int] = []
    lines: list[tuple[str, str]] = []
    waiting = 0

    def decided() -> pa.RecordBatch:
        linked = np.array(apart) <= DISTANCE
        linked[linked] = similar_pairs([x for x, near in zip(lines, linked.tolist()) if near])
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(heads, pa.int64()), pa.array(linked)], ["h", "head", "linked"])

    for group in groups:
        first, *rest = _distinct(group)
        nodes, sims, texts = group["h"], group["sim"], group["line"]
        if nodes[first] != group["head"][0]:
            continue
        sim, line = sims[first], texts[first]
        for i in rest:
            h.append(nodes[i])
            heads.append(nodes[first])
            apart.append(((sims[i] ^ sim) & (2**64 - 1)).bit_count())
            lines.append((line, texts[i]))
            waiting += len(line) + len(texts[i])
        if waiting > WAITING:
            yield decided()
            h, heads, apart, lines, waiting = [], [], [], [], 0
    if h:
        yield decided()


class _Met:
    """A group of failed nodes (own) and other nodes of one key: candidate pairs in rounds, nearest first for each failed node, and what is connected.

    What follows the head counts as connected already.
    """

    def __init__(self, group: dict[str, list]):
        own = {h for h, o in zip(group["h"], group["own"]) if o}
        rows = _distinct(group)
        self.h, self.line = [group["h"][i] for i in rows], [group["line"][i] for i in rows]
        n = len(rows)
        sim, size, mine = np.array([group["sim"][i] for i in rows]), np.array(list(map(len, self.line))), np.array([h in own for h in self.h])
        self.label = np.where(np.array([group["linked"][i] for i in rows]), n, np.arange(n))
        found = []
        of = np.flatnonzero(mine)
        for part in np.array_split(of, -(-len(of) * n // OTHERS**2)) if len(of) else []:
            apart = bits_apart(sim[part, None], sim)
            near = (apart <= DISTANCE) & (self.label[part, None] != self.label) & ((part[:, None] < np.arange(n)) | ~mine)
            near &= np.minimum(size[part, None], size) >= SIMILARITY * np.maximum(size[part, None], size) - 1e-9
            a, b = np.nonzero(near)
            found.append((part[a], b, apart[a, b]))
        i, j, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((apart, i))
        i, j = i[order], j[order]
        long = np.maximum(size[i], size[j]) > MODEST
        self.long = (i[long], j[long])
        # The nearest mostly connects a node to all there is: rounds of its next one, two, four and so on, each after what the last one joined.
        i, j = i[~long], j[~long]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        order = np.argsort(rank, kind="stable")
        self.brief, rank = (i[order], j[order]), rank[order]
        self.rounds = np.searchsorted(rank, [0, *(2**r - 1 for r in range(1, int(rank.max(initial=0) + 1).bit_length() + 1))]) if len(i) else [0]
        self.text = int(size.sum())

    def apart(self, r: int) -> list[tuple[int, int]]:
        """The pairs of short lines of a round that are not connected yet."""
        i, j = (x[self.rounds[r] : self.rounds[r + 1]] for x in self.brief)
        left = self.label[i] != self.label[j]
        return list(zip(i[left].tolist(), j[left].tolist()))

    def far(self) -> Iterator[tuple[int, int]]:
        """Pairs with a long line that are similar and not connected yet, to be joined as they come: a node's nearest, then many at once."""
        of, js = self.long
        bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1)).tolist() if len(of) else []
        for start, end in zip(bounds, bounds[1:]):
            i, todo = int(of[start]), js[start:end]
            line, todo = self.line[i], todo[self.label[todo] != self.label[i]].tolist()
            if todo and similar(line, self.line[todo[0]]):
                yield i, todo[0]
            at = 1
            while at < len(todo):
                some, room = [], ABREAST
                while at < len(todo) and (not some or room >= len(self.line[todo[at]])):
                    if self.label[todo[at]] != self.label[i]:
                        some.append(todo[at])
                        room -= len(self.line[todo[at]])
                    at += 1
                if len(some) >= SHARED:
                    near = [d <= most_edits(line, self.line[j]) for j, d in zip(some, edit_distances(line, [self.line[j] for j in some]))]
                else:
                    near = [similar(line, self.line[j]) for j in some]
                for j, linked in zip(some, near):
                    if linked and self.label[j] != self.label[i]:
                        yield i, j

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _meet(groups: Iterator[dict[str, list]]) -> Iterator[pa.RecordBatch]:
    """Groups of failed nodes (own) and other nodes of one key to links (src, dst) that connect what is similar."""

    def links(some: list[_Met]) -> Iterator[pa.RecordBatch]:
        src: list[int] = []
        dst: list[int] = []

        def link(x: _Met, i: int, j: int) -> None:
            src.append(x.h[i])
            dst.append(x.h[j])
            x.join(i, j)

        def decide(waiting: list[tuple[_Met, int, int]]) -> None:
            for (x, i, j), linked in zip(waiting, similar_pairs([(x.line[i], x.line[j]) for x, i, j in waiting]).tolist()):
                if linked and x.label[i] != x.label[j]:
                    link(x, i, j)

        r, left = 0, some
        while left := [x for x in left if r + 1 < len(x.rounds)]:
            waiting, chars = [], 0
            for x in left:
                for i, j in x.apart(r):
                    waiting.append((x, i, j))
                    chars += len(x.line[i]) + len(x.line[j])
                    if chars > WAITING:
                        decide(waiting)
                        waiting, chars = [], 0
            decide(waiting)
            r += 1
        for x in some:
            for i, j in x.far():
                link(x, i, j)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    held: list[_Met] = []
    size = 0
    for group in groups:
        x = _Met(group)
        pairs_of = len(x.brief[0]) + len(x.long[0])
        if pairs_of:
            held.append(x)
            size += x.text + 16 * pairs_of
        if size > WAITING:
            yield from links(held)
            held, size = [], 0
    yield from links(held)


def _t32(c: Column | str) -> Column:
    return F.col(c).bitwiseAND(0xFFFFFFFF) if isinstance(c, str) else c.bitwiseAND(0xFFFFFFFF)


def _pos(c: str) -> Column:
    return F.shiftright(F.col(c).bitwiseAND(2**63 - 1), 32).cast("int")


def meetings(lines: DataFrame) -> DataFrame:
    """(key, h, head) of the nodes of `lines` (h, keys) that share a key with another: head is the least node of the key.

    Keys are most of what is shuffled. They are dealt by key once, and both the grouping and the join back read that shuffle.
    """
    keyed = lines.select(F.explode("keys").alias("key"), "h").where("key is not null").repartition("key")
    heads = keyed.groupBy("key").agg(F.min("h").alias("head"), F.max("h").alias("tail")).where("head < tail").select(F.col("key").alias("k"), "head")
    return cut(keyed.join(heads.hint("shuffle_hash"), F.col("key") == F.col("k")).select("key", "h", "head").distinct())


def candidate_lines(met: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(lh, sim, line) of the nodes of `met`, read where `nodes` (h, doc_id, place) found them, from `texts` (doc_id, text, t)."""
    wanted = nodes.join(met.select(F.col("h").alias("w")).distinct().hint("shuffle_hash"), F.col("h") == F.col("w"), "left_semi")
    wanted = wanted.groupBy(F.col("doc_id").alias("at_doc"), _t32("place").alias("at_t")).agg(F.collect_set(_pos("place")).alias("wanted"))
    fetched = texts.join(wanted, (F.col("doc_id") == F.col("at_doc")) & (_t32("t") == F.col("at_t"))).select("text", "wanted")
    return cut(fetched.mapInArrow(_fetch, "h long, sim long, line string").toDF("lh", "sim", "line"))


def head_checks(met: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, head, linked) for the nodes of `met` that follow a head; `lines` are candidate_lines."""
    near = met.where("h <> head").select("h", "head").distinct()
    crowds = small_side(cut(near.groupBy(F.col("head").alias("crowd")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLLOWERS)))
    dealt = near.join(crowds, F.col("head") == F.col("crowd"), "left").select("h", "head", F.pmod(F.xxhash64("h"), F.coalesce(F.ceil(F.col("n") / FOLLOWERS), F.lit(1))).cast("int").alias("part"))
    dealt = dealt.unionByName(dealt.select(F.col("head").alias("h"), "head", "part").distinct())
    rows = dealt.join(lines, F.col("h") == F.col("lh")).select("head", "part", "h", "sim", "line")
    return cut(pairs.map_all_groups(rows, ["head", "part"], _follow, "h long, head long, linked boolean"))


def line_links(met: DataFrame, lines: DataFrame) -> DataFrame:
    """(src, dst): links that connect the similar nodes of `met`; `lines` are candidate_lines."""
    checked = head_checks(met, lines)
    links = checked.where("linked").select(F.col("h").alias("src"), F.col("head").alias("dst"))
    verdict = checked.select(F.col("h").alias("vh"), F.col("head").alias("vhead"), "linked")
    judged = met.join(verdict, (F.col("h") == F.col("vh")) & (F.col("head") == F.col("vhead"))).select("key", "h", "head", "linked")
    # Keys with the same nodes are one. A failed node meets all nodes of the key but the head; a key with one node besides has none.
    same = judged.groupBy("key", "head").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("mark"), F.count_if(~F.col("linked")).alias("failed"))
    same = same.where("failed > 0 and n > 1").groupBy("head", "n", "mark", "failed").agg(F.min("key").alias("k")).select("k", "n", "failed")
    rows = judged.join(same, F.col("key") == F.col("k")).withColumns({"tall": F.ceil(F.col("failed") / FAILED).cast("int"), "wide": F.ceil(F.col("n") / OTHERS).cast("int")})
    high, across = F.pmod(F.xxhash64("h", F.lit(1)), F.col("tall")).cast("int"), F.pmod(F.xxhash64("h", F.lit(2)), F.col("wide")).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = rows.where("not linked").select("key", "h", "linked", high.alias("high"), spread("wide").alias("across"), F.lit(True).alias("own"))
    other = rows.select("key", "h", "linked", across.alias("across"), spread("tall").alias("high"), F.lit(False).alias("own"))
    grid = own.unionByName(other).join(lines, F.col("h") == F.col("lh")).select("key", "high", "across", "h", "linked", "own", "sim", "line")
    return links.unionByName(pairs.map_all_groups(grid, ["key", "high", "across"], _meet, "src long, dst long"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t32, removed), t32 the low half of the text's xxhash64: for each document that loses lines, array of (line, first_doc, first_line) in line order.

    line counts from 0 at the \\n-separated lines; (first_doc, first_line) is the occurrence of its group that stays. Rows
    without doc_id are left out; of rows that share a doc_id, equal texts count as one and others as documents of their own
    (if these share their first line of a group, either may keep it).
    """
    texts = plain(docs).where("doc_id is not null").withColumn("t", F.xxhash64("text"))
    lines = cut(texts.mapInArrow(_lines, "doc_id long, place long, h long, keys array<long>"))
    # Plain longs only, so that the aggregation hashes and combines before the shuffle.
    nodes = lines.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", F.when(F.col("place") >= 0, F.col("doc_id"))).alias("place"), F.count(F.lit(1)).alias("times"))
    nodes = cut(nodes)
    met = meetings(lines)
    release(docs.sparkSession)
    candidates = candidate_lines(met, nodes, texts)
    release(docs.sparkSession)
    groups = components(line_links(met, candidates))
    first = F.struct("doc_id", "place").alias("first")
    nodes = nodes.select("h", first, "times")
    linked = nodes.select("h", "first").join(groups.hint("shuffle_hash"), F.col("h") == F.col("node"))
    least = linked.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("keep"))
    linked = linked.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("lh"), "keep")
    again = nodes.join(linked.hint("shuffle_hash"), F.col("h") == F.col("lh"), "left").where("times > 1 or keep is not null")
    again = cut(again.select(F.col("h").alias("rh"), F.coalesce("keep", "first").alias("keep")))
    release(docs.sparkSession)
    hits = lines.select("doc_id", "place", "h").join(small_side(again).hint("shuffle_hash"), F.col("h") == F.col("rh"))
    hits = hits.where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("place") != F.col("keep.place")))
    gone = F.struct(_pos("place").alias("line"), F.col("keep.doc_id").alias("first_doc"), _pos("keep.place").alias("first_line"))
    return hits.groupBy("doc_id", _t32("place").alias("t32")).agg(F.sort_array(F.collect_set(gone)).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with `text` less its removed lines and a column `removed` (see removed_lines; empty array if none).

    All rows stay; the text of a document that loses every line becomes empty. Null and empty texts stay as they are, an
    empty table gives none, repeated rows lose the same lines. A column named removed is replaced, all others stay.
    """
    docs = docs.drop("removed")
    gone_id, gone_t, removed, lines = free_names(docs, "gone_id", "gone_t", "gone", "lines")
    gone = removed_lines(docs).toDF(gone_id, gone_t, removed)
    joined = docs.join(gone, (docs["doc_id"].cast("long") == F.col(gone_id)) & (_t32(F.xxhash64(docs["text"].cast("string"))) == F.col(gone_t)), "left")
    joined = joined.withColumn(lines, F.when(F.col(removed).isNotNull(), F.split("text", "\n")))
    # What stays are the runs of lines between removed ones.
    lost = lambda j: F.get(F.col(removed), j)["line"]
    after = lambda j: F.coalesce(lost(j - 1), F.lit(-1)) + 1
    runs = F.transform(F.sequence(F.lit(0), F.size(removed)), lambda j: F.slice(F.col(lines), after(j) + 1, F.coalesce(lost(j), F.size(lines)) - after(j)))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    empty = F.array().cast("array<struct<line:int,first_doc:bigint,first_line:int>>")
    return joined.withColumn("text", text).withColumn("removed", F.coalesce(removed, empty)).drop(gone_id, gone_t, removed, lines)
