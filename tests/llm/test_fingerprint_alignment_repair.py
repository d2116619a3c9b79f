"""Operators 11 to 13 and long white space against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from declq.llm import alignment, bpe, conversations, fingerprints, sharding
from declq.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_operators import make, odd_texts, prose

JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# --- fingerprints ---------------------------------------------------------------------------------------------------


def plain_signatures(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    common = [w in fingerprints.ANCHORS for w in words]
    signs, run = set(), 0
    for p, w in enumerate(words):
        after = lambda n, at=p: " ".join([x for x, c in zip(words[at:], common[at:]) if not c][:n])
        if common[p]:
            signs.add(f"{w}:{after(fingerprints.CHAIN)}")
            run = 0
            continue
        if run % fingerprints.GAP == 0 and (run or not any(common[:p])):
            signs.add(f":{after(fingerprints.CHAIN + 1)}")
        run += 1
    return signs


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    if not a or not b or abs(len(a).bit_length() - len(b).bit_length()) >= fingerprints.APART:
        return 0.0
    return len(a & b) / len(a | b)


def plain_fingerprint(signs):
    return hashlib.md5("\n".join(sorted(signs, key=str.encode)).encode()).hexdigest()


def test_fingerprints_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    r = random.Random(4)
    texts = [(i, t) for i, t in odd_texts() if i is not None and (i, t) != (2, prose(1, 60))]
    texts += [(20 + i, " ".join(r.choice(["the", "of", "la", "una", "word", "stone", "river", "Ünder", "x1"]) for _ in range(r.choice([1, 2, 3, 9, 40, 300])))) for i in range(60)]
    texts += [(2, prose(1, 60)), (90, "The of and"), (91, "no anchors here but many other words follow one after another"), (92, "!!"), (-5, "日本 the 語" * 30), (2**62, "very " * 30000)]
    rows = fingerprints.fingerprint_edits(make(spark, texts)).collect()
    order = sorted({i: t or "" for i, t in texts}.items(), reverse=True)
    assert len(rows) == len(order)
    expected = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        own, other = plain_signatures(t), plain_signatures(edited)
        expected[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(own), plain_fingerprint(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, plain_signatures(after)), 9))
    got = {x.doc_id: (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in rows}
    assert got == expected


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprint_edits(make(spark, [])).count() == 0
    one = fingerprints.fingerprint_edits(make(spark, [(1, "the cat sat on the mat")])).first()
    assert one.near_next == 1 and one.n_chars == 22
    rows = fingerprints.fingerprint_edits(make(spark, odd_texts()).withColumn("place", F.lit(1)).withColumn("range", F.lit(2))).collect()
    assert Counter(x.doc_id for x in rows) == Counter(i for i, _ in odd_texts())
    equal = [x.fingerprint for x in rows if x.doc_id in (1, 2, None)]
    assert len(equal) == 4 and len(set(equal)) == 1
    listed = fingerprints.document_fingerprints(make(spark, odd_texts()))
    assert {x.fingerprint for x in listed.where("doc_id in (1, 2) or doc_id is null").collect()} == set(equal)
    assert listed.where("doc_id = 4").first().length_partition is None


def test_one_doc_id_is_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 50)
    rows = make(spark, [(7, prose(i, 12)) for i in range(2000)]).select("doc_id", "text").withColumn("place", fingerprints._place())
    assert fingerprints.range_starts(rows.select("place")).count() > 30
    got = fingerprints.fingerprint_edits(rows.drop("place")).collect()
    assert len(got) == 2000 and len({x.edited_sha256 for x in got}) == 2000


# --- alignment ------------------------------------------------------------------------------------------------------


def plain_alignment(text, encoders):
    """Groups of one text: token by token, by byte offsets."""
    a_tok, b_tok = encoders
    if not text:
        return []
    letters = {c: b for c, b in alignment.byte_letters().items()}
    a = [(i, bytes(letters[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
    spell = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    b = [(i, spell(i)) for i in b_tok.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    ends = lambda tokens: [sum(len(x) for _, x in tokens[: k + 1]) for k in range(len(tokens))]
    ends_a, ends_b = ends(a), ends(b)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(([x for x, _ in a[i:p]], [x for x, _ in b[j:q]]))
        i, j = p, q
    return groups


@pytest.fixture(scope="module")
def encoders():
    a = tokenizers.Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


ALIGNED = [
    *[(i, t) for i, t in odd_texts() if not t or len(t) < 2000],
    (20, "<|endoftext|> <s> </s> <unk> <0x41> it's  two\tspaces\n\n"),
    (21, "a▁b"),
    (22, "日本語 ﬁne 𝒳𝒴 é́"),
    (23, "=" * 300 + "-" * 120),
    (24, " lead and trail "),
    (25, "0123456789" * 9),
]


@pytest.mark.parametrize("shared", [1_000_000, 20, 0])
def test_scored_links_are_brute_force(spark, encoders, shared):
    """Also where most id pairs, or all of them, are joined instead of looked up."""
    groups = [(i, plain_alignment(t, encoders)) for i, t in ALIGNED]
    linked = [(i, g, Counter((x, y) for xs, ys in g for x in xs for y in ys)) for i, g in groups]
    count = Counter(p for _, _, pairs in linked for p in pairs)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    expected = Counter()
    for i, g, pairs in linked:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        n_best = sum(n for p, n in pairs.items() if count[p] == best[p[0]])
        expected[i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(pairs.values()), n_best, sum(n * count[p] for p, n in pairs.items()), digest] += 1
    got = alignment.scored_links(make(spark, ALIGNED), JSON, PIECES, P.PATTERN, shared).collect()
    assert Counter((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in got) == expected
    assert sum(not g for _, g in groups) == 3  # null, empty, and one that B does not spell


def test_owner_arrays_give_cuts_and_overlaps(spark, encoders):
    rows = {x.doc_id: x for x in alignment.align(make(spark, ALIGNED).where("doc_id is not null"), JSON, PIECES, P.PATTERN).collect()}
    for i, t in ALIGNED:
        if i is None:
            continue
        groups, x = plain_alignment(t, encoders), rows[i]
        assert x.a_ids == [v for a, _ in groups for v in a] and x.b_ids == [v for _, b in groups for v in b]
        assert len(x.cuts) == len(groups) and (not groups or x.cuts[-1] == len((" " + t).encode()))
        assert len(set(x.overlaps)) == len(x.overlaps) and {o.a for o in x.overlaps} == set(range(len(x.a_ids))) and {o.b for o in x.overlaps} == set(range(len(x.b_ids)))


def test_long_texts_are_aligned_in_parts(encoders, monkeypatch):
    aligner = alignment.Aligner(alignment.read_bytes(JSON), alignment.read_bytes(PIECES), P.PATTERN)
    assert not [p for p in map(encoders[1].id_to_piece, range(encoders[1].vocab_size())) if "▁" in p.lstrip("▁")]  # else a cut at a space is not safe
    texts = [(prose(5, 400) + "  two\n\nThe end. " * 50 + "été Ärger 12 34 " * 40).encode(), b"", (" " * 3000 + "x" * 3000).encode()]
    whole = aligner.encode(texts)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 40)
    monkeypatch.setattr(alignment.parts, "__defaults__", (40,))
    assert len(list(alignment.parts(texts[0].decode()))) > 50
    assert aligner.encode(texts) == whole


def test_alignment_of_odd_tables(spark):
    assert alignment.scored_links(make(spark, []), JSON, PIECES, P.PATTERN).count() == 0
    assert alignment.align(make(spark, []), JSON, PIECES, P.PATTERN).count() == 0
    clashing = make(spark, [(1, "one two"), (1, "one two")]).withColumns({"pairs": F.lit(1), "row": F.lit(2), "n_a": F.lit(3)})
    assert {tuple(x)[:5] for x in alignment.scored_links(clashing, JSON, PIECES, P.PATTERN).collect()} == {(1, 2, 2, 2, 2)}


def test_alignment_query(spark, encoders):
    rows = {x.doc_id: x for x in QUERIES["op12_tokenizer_alignment"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs[::9]:
        groups = plain_alignment(d.text, encoders) if len(d.text) < 3000 else None
        if groups is not None:
            assert (rows[d.doc_id].n_groups, rows[d.doc_id].n_links) == (len(groups), sum(len(a) * len(b) for a, b in groups))


# --- conversation repair --------------------------------------------------------------------------------------------


def plain_repair(rows):
    """rows: (turn, role, text) after damage, in order. All edits by recursion from the end, whole audits compared."""
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        kinds.append(kind)
        counts[kind] += 1
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            for x in follow[state]:
                if x in "ua":
                    c, a, t = best(i, x, inserts + 1)
                    found.append((c + 5, "I" + a, (({"u": "user", "a": "assistant"}[x], ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if kinds[i] not in ("blank", "duplicate"):
                pay = 5 if kinds[i] == "truncated" else 0
                for x in follow[state]:
                    c, a, t = best(i + 1, x, 0)
                    if role[:1] == x:
                        found.append((c + pay, "K" + a, ((role, text), *t)))
                    elif x in "ua":
                        found.append((c + pay + 1, "R" + a, (({"u": "user", "a": "assistant"}[x], text), *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]  # every conversation is known
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0], x[1])) for c, v in out.items()}


def test_repair_is_brute_force(spark):
    r = random.Random(8)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire"]
    texts = ["Hello.", "So?", "no end", "", " \n ", None, "Yes! ", "日本。", "A.\n\x0b", "x" * 3000 + "."]
    rows = []
    for conv in range(150):
        turns = r.sample(range(-3, 30), r.randint(1, 9))
        rows += [(conv, t, r.choice(roles), r.choice(texts)) for t in turns]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (200, None, "user", "a."), (200, None, "assistant", "b."), (200, None, "system", "c."), (201, 5, None, None)]
    rows += [(300, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(400)] + [(301, t, " ", f"{t % 7}.") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {x.conv_id: tuple(x)[1:] for x in conversations.repair_conversations(df.withColumns({"audit": F.lit("x"), "dropped": F.lit(1), "h": F.lit(2)})).collect()}
    expected = {}
    import sys

    sys.setrecursionlimit(20_000)
    for conv, some in plain_damage(rows).items():
        expected[conv] = plain_repair(some)
    assert got == expected


def test_repaired_turns_are_what_the_digest_says(spark):
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + (t > 1 and t % 2 == 0)], f"{c} {t}.") for c in range(40) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for x in sorted(conversations.repaired_turns(conversations.damage(df)).collect(), key=lambda x: (x.conv_id, x.place)):
        assert x.place == len(turns[x.conv_id]) and x.edit in "KRI"
        turns[x.conv_id].append(f"{x.role}:{x.text}")
    for x in conversations.repair_conversations(df).collect():
        assert x.repaired_sha256 == hashlib.sha256("\n".join(turns[x.conv_id]).encode()).hexdigest()
        assert sum(c in "KRI" for c in x.audit) == len(turns[x.conv_id])


def test_audits_of_any_length_cost_the_same_a_row():
    long, pieces = conversations.Recursion(), conversations.Recursion()
    whole = conversations.PIECE
    r = random.Random(3)
    steps = [(r.choice("uasx"), r.random() < 0.1, r.random() < 0.2) for _ in range(1500)]
    try:
        for s in steps:
            pieces.step(*s)
        conversations.PIECE = 10**9
        for s in steps:
            long.step(*s)
    finally:
        conversations.PIECE = whole
    assert pieces.result() == long.result()
    assert max(len(tail) for _, _, tail in pieces.states.values()) < 4 * whole


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_conversations(none).count() == 0 and conversations.repaired_turns(conversations.damage(none)).count() == 0


# --- long white space, many sources ---------------------------------------------------------------------------------


def test_long_white_space_is_encoded_as_a_short_run_is(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(bpe.read_ranks(path), P.PATTERN)
    plain = encoder.encoding.encode_ordinary
    for run in (" " * 300_000, "\n" * 300_000, " \t" * 150_000, "  \r\n" * 60_000):
        for text in (run, run + "word", "word" + run, f"a{run}\n", f"{run}!{run} b", f"a {run}　x"):
            assert encoder.ids(text) == plain(text)
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000 + "x"), (3, "a" + " \t" * 1_000_000 + "b"), (4, "\t" * 2_000_000 + prose(1, 20))]
    for x in bpe.encode_documents(make(spark, rows), path, P.PATTERN, output="digest").collect():
        assert x.decoded_sha256 == hashlib.sha256(dict(rows)[x.doc_id].encode()).hexdigest()
    lengths = {x.doc_id: x.n_tokens for x in bpe.encoded_lengths(make(spark, rows), path, P.PATTERN).collect()}
    assert lengths == {i: len(encoder.ids(t)) for i, t in rows}


def test_many_sources_of_one_row_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 500)
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('s', id) as source", "concat('text ', id % 7) as text").unionByName(spark.range(3000).selectExpr("id + 50000 as doc_id", "'hot' as source", "'x' as text"))
    held = []
    cut = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df: held.append(cut(df)) or held[-1])
    rows = sharding.interleave(docs, 16).collect()
    sizes = [x.n for x in held[-1].groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) < 2000
    counts = Counter(x.shard for x in rows)
    assert len(rows) == 23_000 and max(counts.values()) - min(counts.values()) <= 1
    hot = Counter(x.shard for x in rows if x.source == "hot")  # its share of every shard, though all other sources are of one row
    assert all(abs(hot[k] - 3000 / 16) < 25 for k in range(16))
    for shard in (0, 7, 15):
        assert sorted(x.slot for x in rows if x.shard == shard) == list(range(counts[shard]))
