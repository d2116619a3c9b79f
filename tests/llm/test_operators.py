"""The ten operators against brute force on small fixtures with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from declq.llm import bpe, decontamination, hmm, line_dedup, ngram_join, nn, quality_mil, quality_rules, sharding, token_counts, toxicity
from declq.llm.common import held_out
from declq.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, same_rows
from tests.llm import brute
from tests.llm.brute import edit_distance, edit_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, h string, removed string, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "x", "x", "x", "x", "x") for i, t in texts], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def odd_texts():
    base = prose(1, 60)
    edited = base.split()
    edited[30] = "changed"
    return [(1, base), (2, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, "one two"), (7, "One  TWO"), (8, prose(2, 400) + "\n" + base), (9, "\n\n"), (None, base), (10, "é" * 5000), (11, base.upper())]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, duck):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


def test_classifiers_learn_and_handle_odd_rows(spark):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(240):
        bad, junk = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(40)]
        if bad:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["vile", "nasty"])
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not junk), int(bad)))
    truth = {m[0]: m[1:] for m in marks}
    docs, marked = make(spark, rows + [(1000, None), (1001, ""), (None, "x")]), labels(spark, marks + [(None, 1, 1), (5000, 1, None)])
    for got, column, cut, fold in ((toxicity.score_toxicity(docs, marked), 1, 0.5, lambda i: zlib.crc32(str(i).encode()) % 5 == 0), (quality_mil.score_quality(docs, marked), 0, 0.7, lambda i: zlib.crc32(str(i).encode()) % 4 == 2)):
        found = got.collect()
        assert len(found) == 243 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= cut) for x in found)
        assert all(x.held_out == fold(x.doc_id) for x in found if x.doc_id is not None)
        test = [x for x in found if x.held_out and x.doc_id in truth]
        assert np.mean([x.predicted == truth[x.doc_id][column] for x in test]) > 0.9
    texts = {x.doc_id: x.text for x in docs.collect()}
    sample = lambda label, mod, rest: nn.training_sample(docs, marked, label, lambda c: held_out(c, mod, rest))
    long = prose(77, 3000) + " vile"
    for net, plain, cut in ((toxicity.fit(*sample("toxic", 5, 0)), brute.toxic_logit, 0.5), (quality_mil.fit(*sample("quality", 4, 2)), brute.quality_logit, 0.7)):
        some = [*list(texts.values())[:40], None, "", "... !!", long, "The of and\n\nDER die das"]
        assert np.allclose(net.calibrated([(t or "").encode() for t in some]), [plain(net, t) for t in some], rtol=1e-3, atol=1e-3)
    rows = [(1, long), (1, long), (2, long), (3, None), (4, "")]
    odd = make(spark, rows).selectExpr("doc_id", "text", "'x' as score", "'y' as predicted", "'z' as held_out")
    for score in (toxicity.score_toxicity, quality_mil.score_quality):
        out = score(odd, marked, output="rows").collect()
        assert len(out) == 5 and all(x.held_out == "z" for x in out)
    empty = make(spark, [])
    assert toxicity.score_toxicity(empty, marked).count() == 0
    assert all(x.score < 1e-9 for x in toxicity.score_toxicity(docs, labels(spark, [])).collect())
    assert all(x.predicted == 1 for x in quality_mil.score_quality(docs, labels(spark, [])).collect())


def test_quality_rules_on_odd_rows(spark):
    docs = make(spark, odd_texts())
    rows = quality_rules.line_frequency_filter(docs, most_docs=1).collect()
    assert len(rows) == len(odd_texts())
    null = next(x for x in rows if x.doc_id == 4)
    assert (null.n_words, null.base_failed, null.kept) == (0, True, False)
    eight = next(x for x in rows if x.doc_id == 8)
    assert eight.removed_words == 60 and eight.kept and "\n" not in eight.clean_text  # 2 and 8 share a line and a host
    twice = make(spark, [(1, "a b c d e f g h a b c d e f g h i")])
    assert quality_rules.base_counts(twice).first().n_repeat_words == 16
    assert quality_rules.line_frequency_filter(make(spark, [])).count() == 0


def test_line_dedup_is_brute_force(spark):
    r = random.Random(7)
    lines = [prose(i, r.randint(1, 25)) for i in range(40)]
    texts = []
    for i in range(60):
        chosen = []
        for _ in range(r.randint(0, 5)):
            words = r.choice(lines).split()
            if r.random() < 0.4 and len(words) > 3:
                words[r.randrange(len(words))] = "zz"
            chosen.append(" ".join(words))
        texts.append((i, "\n".join(chosen)))
    texts += [(100, None), (101, ""), (None, lines[0])]
    where = defaultdict(list)
    for i, t in texts:
        for p, line in enumerate((t or "").split("\n")):
            if i is not None and line.split():
                where[" ".join(line.lower().split()).encode()].append((i, p))
    keys = list(where)
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(keys)), 2):
        if edit_similar(keys[a].decode(), keys[b].decode()):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k, key in enumerate(keys):
        groups[find(k)] += where[key]
    expected = defaultdict(list)
    for places in groups.values():
        for place in sorted(set(places) - {min(places)}):
            expected[place[0]].append((place[1], *min(places)))
    got = line_dedup.dedup_lines(make(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {x.doc_id: [tuple(y) for y in x.removed] for x in got if x.removed} == {k: sorted(v) for k, v in expected.items()}
    assert next(x.text for x in got if x.doc_id == 100) is None
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


def test_line_dedup_finds_what_edit_similarity_alone_finds(spark):
    r = random.Random(11)
    lines = []
    for i in range(120):
        words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.choice([3, 5, 8, 12, 20, 40, 80, 150]))]
        lines.append(" ".join(words))
        letters = list(lines[-1])
        letters[r.randrange(len(letters))] = "q"
        lines.append("".join(letters))
        for k in r.sample(range(len(words)), len(words) // 10):
            words[k] = r.choice(WORDS)
        lines.append(" ".join(words))
    pairs = [(a, b) for a, b in combinations(range(len(lines)), 2) if lines[a] != lines[b] and line_dedup.similar(lines[a], lines[b])]
    rows = line_dedup.dedup_lines(make(spark, list(enumerate(lines)))).collect()
    group = {x.doc_id: x.removed[0].first_doc if x.removed else x.doc_id for x in rows}
    assert len(pairs) > 200 and sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for i, first in group.items():  # what is removed hangs together with the line that stays
        seen, todo = {first}, [first]
        while todo:
            for x in (near[todo.pop()] | {k for k in range(len(lines)) if lines[k] == lines[first]}) - seen:
                seen.add(x)
                todo.append(x)
        assert i in seen


def test_line_dedup_recall_near_the_threshold(spark):
    """Random lines of several lengths and copies with a letter, a word or every sixth word changed, against edit similarity alone."""
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abdefgiklmnoprstu", k=r.randint(2, 9))) for _ in range(3000)]
    lines, made = [], []
    for n in (6, 8, 12, 20, 40):
        for kind in ("letter", "word", "sixth"):
            for _ in range(40):
                words = r.choices(vocabulary, k=n)
                other = list(words)
                for at in r.sample(range(n), 1 if kind != "sixth" else max(1, n // 6)):
                    other[at] = r.choice(vocabulary) if kind != "letter" else other[at][:-1] + "q"
                if words != other and edit_similar(" ".join(words), " ".join(other)):
                    made.append((kind, len(lines), len(lines) + 1))
                    lines += [" ".join(words), " ".join(other)]
    rows = line_dedup.dedup_lines(make(spark, list(enumerate(lines)))).collect()
    group = {x.doc_id: x.removed[0].first_doc if x.removed else x.doc_id for x in rows}
    found = {kind: np.mean([group[a] == group[b] for k, a, b in made if k == kind]) for kind in ("letter", "word", "sixth")}
    assert len(made) > 450 and found["letter"] >= 0.95 and found["word"] >= 0.9 and found["sixth"] >= 0.8, found
    assert np.mean([group[a] == group[b] for _, a, b in made]) >= 0.9


def test_line_dedup_keeps_other_text_of_a_shared_id(spark):
    a, b, c, d = (prose(200 + i, 12) for i in range(4))
    rows = line_dedup.dedup_lines(make(spark, [(1, a), (2, b + "\n" + a), (2, c + "\n" + d), (2, c + "\n" + d)])).collect()
    assert sorted((x.doc_id, x.text, len(x.removed)) for x in rows) == sorted([(1, a, 0), (2, b, 1), (2, c + "\n" + d, 0), (2, c + "\n" + d, 0)])


def test_bits_apart_of_signed_hashes():
    a = np.array([0, 0, -1, 5], np.int64)
    b = np.array([-1, -(2**63) + 1, -2, 5], np.int64)
    assert line_dedup.bits_apart(a, b).tolist() == [64, 2, 1, 0]


def test_edit_similarity_and_its_bounds():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abç", k=r.randint(0, 25))) for _ in range(2))
        exact = edit_distance(a, b)
        assert line_dedup.levenshtein(a, b) == exact
        assert (line_dedup.levenshtein(a, b, 6) <= 6) == (exact <= 6)
    for _ in range(60):
        a, *many = ("".join(r.choices("abç ", k=r.randint(0, 90))) for _ in range(r.randint(2, 9)))
        assert line_dedup.edit_distances(a, many) == [edit_distance(a, b) for b in many]
        assert line_dedup.levenshtein(a, many[0]) == edit_distance(a, many[0])
    for _ in range(300):
        a = r.choices(WORDS, k=r.randint(1, 14))
        b = [w for w in a if r.random() < 0.8] + r.choices(WORDS, k=r.randint(0, 2))
        if r.random() < 0.3:
            r.shuffle(b)
        a, b = " ".join(a), " ".join(b)
        assert line_dedup.distance_bound(a, b) >= edit_distance(a, b)
        assert line_dedup.similar(a, b) == (edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_line_dedup_meets_in_blocks(spark, monkeypatch):
    """A chain of edits: most lines fail against the head of their keys and are linked in the grid, in blocks as without."""
    r = random.Random(3)
    words = prose(70, 30).split()
    lines = [" ".join(words)]
    for step in range(40):
        words[step * 7 % 30] = r.choice(WORDS) + str(step)
        lines.append(" ".join(words))
    lines += [prose(300 + i, 20) for i in range(10)]
    r.shuffle(lines)
    texts = list(enumerate(lines))
    whole = {x.doc_id: x.removed for x in line_dedup.dedup_lines(make(spark, texts)).collect()}
    assert sum(bool(x) for x in whole.values()) == 40
    for name in ("FOLLOWERS", "FAILED", "OTHERS"):
        monkeypatch.setattr(line_dedup, name, 4)
    assert {x.doc_id: x.removed for x in line_dedup.dedup_lines(make(spark, texts)).collect()} == whole


def test_line_dedup_odd_rows(spark):
    """Very long lines, repeated rows, nulls, ties and columns of the names that the operator uses."""
    rows = [(3, prose(5, 9000)), (1, prose(5, 9000) + "\n\n tail"), (2, None), (4, ""), (5, "same line here\nsame  LINE here"), (5, "same line here\nsame  LINE here"), (None, "same line here")]
    docs = make(spark, rows).selectExpr("doc_id", "text", "'a' as _gone_id", "'b' as _removed", "'c' as __lines", "'d' as h", "'e' as removed")
    out = line_dedup.dedup_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = sorted(((x.doc_id or 0, x.text, len(x.removed)) for x in out.collect()), key=str)
    assert got == sorted([(3, "", 1), (1, rows[1][1], 0), (2, None, 0), (4, "", 0), (5, "same line here", 1), (5, "same line here", 1), (0, "same line here", 0)], key=str)


def test_components(spark):
    from declq.llm.common import components

    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ngram_join_is_brute_force(spark):
    r = random.Random(5)
    texts = odd_texts()[:-3] + [(None, prose(1, 60))]
    for g in range(6):
        base = prose(100 + g, 80).split()
        for c in range(8):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(80)] = f"w{r.randint(0, 9)}"
            texts.append((1000 + 10 * g + c, " ".join(words)))
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split(" ") if t and t.strip() else []
        w = [x for x in w if x.strip()] if "\n" not in (t or "") else (t or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = make(spark, texts)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    assert {x.doc_id: (x.class_id, x.n_links) for x in got if x.doc_id is not None} == {i: (find(i), links[i]) for i in sets}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.select("doc_id").collect()} == {find(i) for i in sets} | {None}
    assert ngram_join.near_duplicates(make(spark, [])).count() == 0


def test_matched_prefixes_shorten_until_the_recall():
    r = random.Random(8)
    seen = set()
    for _ in range(200):
        sizes = {}
        for tree in r.sample(range(ngram_join.TREES), r.randint(0, ngram_join.TREES)):
            n, sizes[tree] = r.choice([1, 2, 2, 5, 1000]), {}
            for depth in range(ngram_join.LABEL, ngram_join.SHORTEST - 1, -1):
                n += r.choice([0, 0, 1, 300])
                if n > 1:
                    sizes[tree][depth] = n
        depths = ngram_join.matched_depths(sizes)
        seen |= set(depths.values())
        assert ngram_join.recall([*depths.values(), *[ngram_join.SHORTEST] * (ngram_join.TREES - len(depths))]) >= ngram_join.TARGET_RECALL
    assert seen == set(range(ngram_join.SHORTEST, ngram_join.LABEL + 1))
    crowded = {t: {4: 1000 if t < 2 else 2} for t in range(ngram_join.TREES)}
    depths = ngram_join.matched_depths(crowded)
    assert all(depths[t] > ngram_join.SHORTEST for t in (0, 1)) and sum(d == ngram_join.SHORTEST for d in depths.values()) >= 4


def test_forest_keeps_long_prefixes_in_crowded_trees(spark):
    """All classes agree in the shortest prefix of two trees, which would hang them together; pairs agree in the others."""
    rows = []
    for i in range(40):
        label = []
        for tree in range(ngram_join.TREES):
            label += [7, i * 700 << 48] if tree < 2 else [1000 * tree + i // 2, i << 48]
        rows.append((i, label))
    stars = ngram_join.candidate_stars(spark.createDataFrame(rows, "id long, labels array<long>"))
    assert sorted(tuple(x) for x in stars.collect()) == [(i + 1, i) for i in range(0, 40, 2)]


def test_ngram_join_recall_at_the_threshold(spark):
    r = random.Random(9)
    texts, pairs = [], []
    for k in range(150):
        a = prose(5000 + k, 120).split()
        b = list(a)
        for at in r.sample(range(120), r.choice([1, 2, 2])):
            b[at] = "other"
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        sets = [{tuple(w[i : i + 5]) for i in range(116)} for w in (a, b)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            pairs.append(2 * k)
    got = {x.doc_id: x.class_id for x in ngram_join.near_duplicates(make(spark, texts)).collect()}
    assert len(pairs) > 100 and sum(got[i] == got[i + 1] for i in pairs) >= 0.99 * len(pairs)


def test_ngram_join_odd_rows(spark):
    """Rows of one doc_id with different texts keep the links of each; very long texts; columns of the operator's names."""
    long = prose(41, 30000)
    texts = [(1, prose(42, 50)), (2, prose(43, 50)), (2, prose(42, 50) + " more"), (3, long), (4, long + " end"), (4, long + " end")]
    docs = make(spark, texts).selectExpr("doc_id", "text", "'a' as _gone", "'b' as id", "'c' as component")
    got = {(x.doc_id, x.class_id, x.n_links, x.n_copies) for x in ngram_join.near_duplicates(docs).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 1, 1), (4, 3, 1, 1)}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 3]


def test_sharding(spark):
    texts = [(i, "x" * (i % 7)) for i in range(1003)] + [(None, None), (5, "x" * 5)]
    rows = sharding.interleave(make(spark, texts)).collect()
    assert Counter(x.doc_id for x in rows) == Counter(i for i, _ in texts)
    sizes = Counter(x.shard for x in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(x.slot for x in rows if x.shard == shard) == list(range(n))
    for source in ("s0", "s1"):
        mixture = Counter(x.shard for x in rows if x.source == source)
        assert max(mixture.values()) - min(mixture.values()) <= 2
    assert all(x.text_crc32 == zlib.crc32(("x" * (x.doc_id % 7)).encode()) for x in rows if x.doc_id is not None)
    assert [tuple(x) for x in sharding.interleave(make(spark, texts)).orderBy("shard", "slot").collect()] == sorted((tuple(x) for x in rows), key=lambda x: (x[5], x[6]))
    assert sharding.interleave(make(spark, [])).count() == 0


def test_sharding_is_a_plain_ranking(spark):
    """Sorted in Python from the definition: seeded hash rank inside each source (null is one) behind its offset, then the fraction."""
    texts = [(i, "y" * (i % 5), None if i % 3 == 0 else f"s{i % 4}") for i in range(200)] + [(7, "y" * 2, "s3"), (7, "y" * 2, "s3")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").selectExpr("*", "'a' as h", "'b' as fraction")
    hashes = docs.selectExpr("doc_id", "source", "text", "xxhash64('shuffle-1', doc_id, crc32(cast(text as binary)), cast(octet_length(text) + 1 as long)) as x", f"(pmod(xxhash64('shuffle-1', source), {1 << sharding.OFFSET_BITS}L) + 0.5D) / {1 << sharding.OFFSET_BITS} as u").collect()
    by_source, first = defaultdict(list), {r.source: r.u for r in hashes}
    for r in hashes:
        by_source[r.source].append(((r.x >> 20) % sharding.LEAST_RANGES, r.x, r.doc_id))  # the order is that of the hash's range, then the hash
    order = sorted(((k + first[source]) / len(rows), h, source or "", doc) for source, rows in by_source.items() for k, (_, h, doc) in enumerate(sorted(rows)))
    each, more = divmod(len(order), 16)
    sizes = [each + (k < more) for k in range(16)]
    expected = Counter((doc, shard, slot) for (_, _, _, doc), (shard, slot) in zip(order, ((k, j) for k, n in enumerate(sizes) for j in range(n))))
    assert Counter((x.doc_id, x.shard, x.slot) for x in sharding.interleave(docs).collect()) == expected


def test_encoded_lengths(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = bpe._encoding(bpe.read_ranks(path), public_tokenizers.PATTERN)
    texts = odd_texts() + [(12, prose(9, 20000))]
    docs = make(spark, texts).selectExpr("doc_id", "text", "'a' as n_tokens")
    got = Counter((x.doc_id, x.n_tokens) for x in bpe.encoded_lengths(docs, path, public_tokenizers.PATTERN).collect())
    assert got == Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t in texts)
    assert token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0
    nulls = token_counts.length_histogram(spark.createDataFrame([(None,), (3,), (3,)], "n_tokens long"))
    assert [tuple(x) for x in nulls.collect()] == [(3, 2)]


def test_bpe_cuts_texts_without_spaces(spark):
    encoding = bpe._encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    r = random.Random(6)
    text = "".join(r.choice("日本語中文漢字かなカナабвéñ한국。、,!?;'s 12") for _ in range(20000))
    cut = list(bpe.pieces(text, 300))
    assert len(cut) > 40 and "".join(cut) == text
    assert [i for x in cut for i in encoding.encode_ordinary(x)] == encoding.encode_ordinary(text)


def test_quality_rules_long_texts_and_clashing_names(spark):
    long = "\n".join(prose(600 + i, 40) for i in range(300))
    texts = [(1, long + "\nshared line here"), (2, "shared line here"), (2, "shared line here"), (3, "tail\nshared line here")]
    docs = make(spark, texts).selectExpr("doc_id", "text", "'h' as source", "'a' as _host", "'b' as _n", "'c' as _w", "'d' as _gone", "'e' as host", "'f' as n_words")
    rows = quality_rules.line_frequency_filter(docs, most_docs=2)
    assert rows.columns[:8] == ["doc_id", "text", "source", "_host", "_n", "_w", "_gone", "host"]
    got = rows.collect()
    assert len(got) == 4 and all((x._host, x._n, x._w, x._gone, x.host) == ("a", "b", "c", "d", "e") for x in got)
    one = next(x for x in got if x.doc_id == 1)
    assert (one.n_words, one.removed_words, one.kept, one.clean_text) == (12003, 3, True, long)
    assert [x.removed_words for x in got if x.doc_id == 2] == [3, 3]


def test_decontamination_recall_and_repeated_rows(spark):
    """Items of many sizes inside long texts, a fifth of their shingles gone at most, against exact containment."""
    r = random.Random(12)
    items, texts = [], []
    for k, n in enumerate([5, 9, 20, 36, 40, 70, 150, 400, 1100] * 3):
        words = prose(900 + k, n).split()
        items.append((k, " ".join(words)))
        if n >= 36:
            for at in r.sample(range(n), max(1, n // 40)):
                words[at] = "other"
        texts.append((k, prose(2000 + k, 1500) + " " + " ".join(words) + " " + prose(3000 + k, 800)))
    texts += [texts[0], (3, prose(1, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contained_items(make(spark, texts).withColumnRenamed("h", "shingles"), bench).collect()}
    expected = {(i, k) for i, t in texts for k, x in items if (i == k) and brute.contains(t, x)}
    assert len(expected) > 20 and got == expected


def test_token_counts(spark):
    lengths = [random.Random(2).randint(0, 3000) for _ in range(500)]
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))).cache()
    for x in sums.collect():
        assert x.docs_ge == sum(v >= x.length for v in lengths) and x.tokens_ge == sum(v for v in lengths if v >= x.length)
        assert x.truncated_tokens == sum(min(v, x.length) for v in lengths) and x.total_tokens == sum(lengths)
    for limit in (0, 1, 1777, 10**6):
        assert token_counts.truncated_total(sums, limit).first().truncated_tokens == sum(min(v, limit) for v in lengths)
    assert token_counts.quantile(sums, 0.5).first().length == sorted(lengths)[249]


def test_hmm_recursions_and_base_score(spark):
    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.random(hmm.N_CLASSES))
    streams = [rng.integers(0, 40, k) for k in (1, 3, 4)]
    for some, classes, lens in hmm.batches_of(streams):
        score = hmm.forward(model, classes, lens)
        _, moves, emit = hmm.expected_counts(model, classes, lens)
        assert math.isclose(emit.sum(), sum(lens), rel_tol=1e-5) and math.isclose(moves.sum(), sum(lens - 1), rel_tol=1e-5)
        for j, i in enumerate(some):
            alpha = model.start * model.emit[streams[i][0]]
            for c in streams[i][1:]:
                alpha = (alpha @ model.move) * model.emit[c]
            assert math.isclose(score[j], math.log10(alpha.sum()), rel_tol=1e-9)
    texts = odd_texts()
    rows = hmm.score_language(make(spark, texts), rounds=2).collect()
    train = [t or "" for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert Counter((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in rows) == expected
    assert all(x.score < 0 for x in rows) and hmm.score_language(make(spark, [])).count() == 0


def test_hmm_long_texts_in_stretches(spark, monkeypatch):
    """The recursions give the same whatever part of a text is held at once; the score column is a naive recursion's."""
    rng = np.random.default_rng(3)
    model = hmm.Model.first(rng.random(hmm.N_CLASSES))
    streams = [rng.integers(0, 40, k).astype(np.uint16) for k in (1, 7, 230)]
    some, classes, lens = next(iter(hmm.batches_of(streams)))
    whole, counts = hmm.forward(model, classes, lens), hmm.expected_counts(model, classes, lens)
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 20)
    assert len(hmm.stretches(classes)) > 5
    assert np.allclose(hmm.forward(model, classes, lens), whole, rtol=1e-12)
    for a, b in zip(hmm.expected_counts(model, classes, lens), counts):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-5)


def test_hmm_score_is_the_naive_recursion(spark, monkeypatch):
    models = []
    made = hmm.Model.of_counts
    monkeypatch.setattr(hmm.Model, "of_counts", lambda *a: models.append(made(*a)) or models[-1])
    frequent = hmm.frequent_words
    monkeypatch.setattr(hmm, "frequent_words", lambda counts: frequent(counts, 40))
    texts = [(i, prose(i % 30, 25)) for i in range(60)] + [(100, None), (101, "never seen"), (102, prose(900, 4000)), (None, "x"), (3, prose(3, 25))]
    rows = hmm.score_language(make(spark, texts), rounds=2).collect()
    model = models[-1]
    train = [t or "" for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t.encode().lower().split())
    shared = frequent(spark.createDataFrame(list(counts.items()), "word binary, c long"), 40)
    assert 0 < len(shared) <= 40 < len(counts)
    place = {w: i + 1 for i, (w, _) in enumerate(shared[: hmm.TOP_CLASSES])}
    class_of = lambda w: place.get(w) or int(hmm.hash_class([w])[0])
    words, tokens = Counter(), Counter()
    for w, c in counts.items():
        words[class_of(w)] += 1
        tokens[class_of(w)] += c

    def naive(text):
        alpha, total = None, 0.0
        for w in [*(text or "").encode().lower().split(), None]:
            c, own = (0, len(train)) if w is None else (class_of(w), counts[w])
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[c]
            total += math.log10(own + 1) - math.log10(len(train) + 1 if w is None else tokens[c] + 1 + (0 if w in place else words[c]))
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        return total

    assert len(rows) == len(texts)
    assert Counter((x.doc_id, round(x.score, 5)) for x in rows) == Counter((i, round(naive(t), 5)) for i, t in texts)


def test_frequent_words_are_bounded(spark):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([500, 90, 90, 40, 7, 7, 7, 1, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "word binary, c long")
    assert hmm.frequent_words(counts, 100) == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert hmm.frequent_words(counts, 5) == rows[:4]  # the three words of count 7 don't fit
    assert hmm.frequent_words(counts, 0) == [] and hmm.frequent_words(counts.limit(0)) == []


def test_decontamination_finds_short_items_in_long_texts(spark):
    item = prose(50, 40)
    texts = [(1, prose(51, 5000) + " " + item + " " + prose(52, 5000)), (2, item.upper()), (3, " ".join(item.split()[:20])), (4, None), (5, "two words"), (6, "some two words here"), (7, ""), (None, item)]
    bench = spark.createDataFrame([(1, item), (2, "Two words!"), (3, ""), (4, None)], "item_id long, text string")
    got = decontamination.contained_items(make(spark, texts), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, 1), (2, 1), (5, 2)} and all(x.containment == 1 for x in got)
    assert decontamination.contained_items(make(spark, []), bench).count() == 0
    assert decontamination.contained_items(make(spark, texts), bench.limit(0)).count() == 0


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe._encoding(bpe.read_ranks(path), public_tokenizers.PATTERN)
    long = prose(9, 30000) + "  \n\n " + "é" * 1000
    assert bpe.Encoder(bpe.read_ranks(path), public_tokenizers.PATTERN).ids(long) == encoding.encode_ordinary(long) and "".join(bpe.pieces(long, 500)) == long
    rows = bpe.encode_documents(make(spark, odd_texts() + [(12, long), (13, "<|endoftext|> 日本 \x00")]), path, public_tokenizers.PATTERN).collect()
    for x in rows:
        assert bytes(x.decoded).decode() == (x.text or "") and x.token_ids == encoding.encode_ordinary(x.text or "")
    digest = bpe.encode_documents(make(spark, [(1, "a b")]), path, public_tokenizers.PATTERN, output="digest").first()
    ids = encoding.encode_ordinary("a b")
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digest.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_word_hashes_do_not_depend_on_neighbours():
    words = [b"alpha", b"beta.", b"...", "é".encode(), b"a"]
    together = nn.buckets(words, 18)
    assert (together == np.concatenate([nn.buckets([w], 18) for w in words], 1)).all()


def test_decontamination_miss_chance_is_as_stated():
    def missed(n):
        return (1 - min(1, decontamination.SKETCH / 2 ** (n.bit_length() - 1))) ** -(-4 * n // 5)

    assert max(map(missed, range(1, 32))) == 0 < missed(32) and max(map(missed, range(32, 64))) < 3e-8
    assert 3e-8 < missed(64) and max(map(missed, range(64, 20_000))) < 3e-6
    assert "one of 64 or more with one below 3e-6" in decontamination.__doc__.replace("\n", " ")


def test_line_keys_are_shuffled_once(spark, monkeypatch):
    frames, write = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: frames.append(df) or write(df))
    lines = spark.createDataFrame([(1, [10, 11]), (2, [11, 12]), (3, [12]), (4, [13]), (5, []), (6, None)], "h long, keys array<long>").repartition(3)
    met = line_dedup.meetings(write(lines))
    assert sorted(tuple(x) for x in met.collect()) == [(11, 1, 1), (11, 2, 1), (12, 2, 2), (12, 3, 2)]
    frames[0].collect()
    final = frames[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate explode(") == 1 and "ReusedExchange" in final


def test_line_pairs_are_compared_together():
    """Many pairs at once give what single ones give, and small groups share a batch of results."""
    r = random.Random(9)

    def edited(text, edits):
        letters = list(text)
        for _ in range(edits):
            letters[r.randrange(len(letters))] = r.choice(["", "x", "yz", "ç"])
        return "".join(letters) or "x"

    for size in (3, 63, 64, 65, 150, 300):
        a = ["".join(r.choices("abcç ", k=r.randint(max(1, size - 9), size))) for _ in range(120)]
        b = [edited(x, r.randint(0, max(1, len(x) // 3))) for x in a]
        exact = np.array([edit_distance(x, y) for x, y in zip(a, b)])
        most = np.array([max(line_dedup.most_edits(x, y), abs(len(x) - len(y))) for x, y in zip(a, b)])
        got = line_dedup.side_by_side(a, b, most)
        assert (got >= exact).all() and (got[exact <= most] == exact[exact <= most]).all() and ((got <= most) == (exact <= most)).all()
        assert line_dedup.similar_pairs(list(zip(a, b))).tolist() == [line_dedup.similar(x, y) for x, y in zip(a, b)]
    words = [prose(400 + i, 12) for i in range(30)]
    groups = [{"head": [i * 10] * 2, "part": [0] * 2, "h": [i * 10, i * 10 + 1], "sim": [5, 5], "line": [x, edited(x, 2 if i % 2 else 60)]} for i, x in enumerate(words)]
    batches = list(line_dedup._follow(iter(groups)))
    assert len(batches) == 1
    assert batches[0].to_pydict() == {"h": [i * 10 + 1 for i in range(30)], "head": [i * 10 for i in range(30)], "linked": [line_dedup.similar(*g["line"]) for g in groups]}
    key = {"key": [1] * 40, "h": list(range(40)), "sim": [5] * 40, "line": [edited(prose(500 + i % 4, 12 if i % 2 else 90), 3) for i in range(40)], "linked": [False] * 40, "own": [True] * 40}
    (links,) = line_dedup._meet(iter([key]))
    root = list(range(40))
    for a, b in zip(*(x.to_pylist() for x in links.columns)):
        assert line_dedup.similar(key["line"][a], key["line"][b])
        root = [root[a] if x == root[b] else x for x in root]
    assert len(links) == 36 and len(set(root)) == 4 and all(root[i] == root[i % 4] for i in range(40))
