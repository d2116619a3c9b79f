"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (any rank file of that format)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declq.llm.common import slices

#: Texts above so many characters are cut at safe places before they are encoded.
PIECE_CHARS = 1 << 16
#: A match of the splitting pattern never crosses from a letter or digit to white space or a punctuation mark, so a cut there
#: is safe. Only characters that every Unicode version sorts alike: Latin, Cyrillic, kana, Han, Hangul.
SAFE_CUT = re.compile("(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[ \n.,;:!?\u3001\u3002\uff0c\uff01\uff1f])")
#: Characters of a run of white space (the Unicode property that the pattern's \\s means) that is encoded apart, as the pattern's
#: look-ahead goes back over a run letter by letter and breaks down on a million of them.
RUN_CHARS = 4096
LONG_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN_CHARS},}}")
ONE_PIECE = "(?s:.+)"


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding(hashlib.sha256(ranks).hexdigest(), pat_str=pattern, mergeable_ranks=table, special_tokens={})


def read_ranks(path: str) -> bytes:
    """The rank file's bytes. Driver side; its size is fixed by the vocabulary (about 1 MB), so it may be broadcast."""
    with open(path, "rb") as file:
        return file.read()


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut `text` after about every `limit` characters, at the next safe place; without such a place it stays whole."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE_CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Encodes texts of any length. `pattern` must treat white space as the public patterns do: a run is one match, less its last
    character where a character of another kind follows (`\\s+(?!\\S)|\\s+`), and no other match ends in white space."""

    def __init__(self, ranks: bytes, pattern: str):
        self.encoding, self._run = _encoding(ranks, pattern), _encoding(ranks, ONE_PIECE)

    def ids(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        out, start = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))  # the last one goes with what follows it
            out += self._plain(text[start : run.start()]) + self._run.encode_ordinary(text[run.start() : end])
            start = end
        return out + self._plain(text[start:])

    def _plain(self, text: str) -> list[int]:
        return [i for piece in pieces(text) for i in self.encoding.encode_ordinary(piece)]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, output: str = "ids") -> DataFrame:
    """Encode `text` of every row and decode it again.

    output="ids": the input's columns and `token_ids` array<int>, `decoded` binary (columns of these names are replaced).
    output="digest": doc_id, n_tokens, ids_sha256, decoded_sha256 only.
    Null text is empty; an empty text has no ids. Each row is handled by itself, so repeated rows and null ids stay.
    One map over the scan, no shuffle; memory is one slice of a batch. A long text is encoded a piece at a time: pieces end at
    safe places, and long runs of white space are pieces of their own; letters or marks without any safe place stay one piece.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    digest = output == "digest"
    if digest:
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        source = docs.drop("token_ids", "decoded")
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields] + ["token_ids array<int>", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        encoding = encoder.encoding
        names = [str(i) for i in range(encoding.n_vocab)]
        sha = hashlib.sha256
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = [encoder.ids(t.decode("utf-8", "replace")) for t in texts]
                back = [encoding.decode_bytes(x) for x in ids]
                if digest:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([sha(",".join(map(names.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                            pa.array([sha(x).hexdigest() for x in back], pa.string()),
                        ],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())], [*part.schema.names, "token_ids", "decoded"])

    return source.mapInArrow(run, schema)


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens of every row; null text has 0 tokens, an empty table no rows. Long texts as in encode_documents."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(encoder.ids(t.decode("utf-8", "replace"))) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
