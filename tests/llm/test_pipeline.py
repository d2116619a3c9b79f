"""The pipeline keeps clean documents, applies every stage's decision and returns what a brute-force version does."""

import hashlib
import random

import public_tokenizers

import corpus_pipeline
from declq.llm import bpe, nn, quality_mil
from declq.llm.common import held_out
from tests.conftest import DATA
from tests.llm import brute

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def test_stages_keep_most(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() <= n and docs.count() > n / 2
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == {tuple(r) for r in docs.collect()}


def write_tables(spark, folder, texts, items, marks):
    """documents with an extra column of a name that stages use, some without doc_id or text; benchmark and labels."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x") for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_is_brute_force(spark, tmp_path):
    r = random.Random(4)
    texts, marks = {}, []
    for i in range(200):
        words = prose(i, 40).split()
        junk = r.random() < 0.4
        if junk:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words[:20]) + "\n" + " ".join(words[20:])
        if i % 10 == 3:
            text += "\n" + prose(9999, 15)  # a line that many share
        if i % 10 == 4:
            text = prose(i - 1, 40) + " " + " ".join(words[:4])  # nearly the one before
        texts[i] = text
        marks.append((i, int(not junk), 0))
    items = [(k, prose(7000 + k, 30)) for k in range(5)]
    for k in range(5):
        texts[200 + k] = prose(300 + k, 25) + " " + items[k][1] + " " + prose(400 + k, 25)
    texts |= {210: None, 211: "", 212: "x", 213: "\n\n"}
    folder = str(tmp_path)
    write_tables(spark, folder, [*texts.items(), (5, texts[5]), (None, prose(8888, 40))], items, marks)

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = quality_mil.fit(*nn.training_sample(docs, labels, "quality", lambda c: held_out(c, 4, 2)))
    left = {i: t for i, t in texts.items() if brute.sigmoid(brute.quality_logit(net, t)) >= 0.7}
    assert 100 < len(left) < 200
    left = brute.dedup_lines(left)
    left = {i: left[i] for i in brute.keep_one(left)}
    left = {i: t for i, t in left.items() if not any(brute.contains(t, x) for _, x in items)}
    encoding = bpe._encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    expected = set()
    for i, t in left.items():
        ids = encoding.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {tuple(x) for x in got if x.doc_id is not None} == expected
    assert sum(x.doc_id == 5 for x in got) == 2 * (5 in left)
    assert sum(x.doc_id is None for x in got) == (brute.sigmoid(brute.quality_logit(net, prose(8888, 40))) >= 0.7)


def test_stages_on_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path), [], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
