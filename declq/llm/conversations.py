"""Conversation structure repair: the cheapest edits that turn a conversation into (s?(ua)+)?, by a forward Viterbi recursion.

A conversation is the rows of one conv_id by turn (nulls first), then role and text. Roles count by their initials. Faults of a
row, the first of which counts: blank (no character but white space), duplicate (role and text of an earlier row), truncated
(the last such character is no mark of SENTENCE_ENDS). Edits: keep (K, 0), rerole to user or assistant (R, 1), delete (D, 2; the only one
for blank and duplicate rows), insert an empty user or assistant turn anywhere (I, 5); truncated rows that stay cost 5 more.

The recursion has four states: nothing yet, after a system turn, after a user turn, after an assistant turn. A state carries its
least (cost, audit string); after each row the layer is closed by two rounds of inserts, as more only go round in a circle. Two
audits of a state after the same row are never one the beginning of the other at equal cost (a longer one has more inserts), so
what is least stays least whatever follows. Every PIECE rows the audits are set down: states keep their rank among them and
begin new pieces, so no step copies or compares a long string.

Spark deals rows by conv_id, sorts them and streams them: the recursion reads a few bytes a row, and the repair reads each
conversation after its audit. A task holds one row and one audit at a time. An audit and a digest of a whole conversation are
what the result asks for, in order, so one conversation is one stream; everything else about it is not gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the contract: white space as a character class, marks that end a sentence, costs of the edits.
SPACES, SENTENCE_ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows after which audits are set down; rows of a batch that are Python objects at once.
PIECE, ROWS = 64, 256
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}
#: The turns that may follow each state, as (initial, next state).
_AFTER = {NOTHING: (("s", SYSTEM), ("u", USER)), SYSTEM: (("u", USER),), USER: (("a", ASSISTANT),), ASSISTANT: (("u", USER),)}

Best = tuple[int, int, str]  # cost, rank of the part that is set down, the rest of the audit


class Recursion:
    """One conversation's states. step() takes a row, result() gives the least (cost, audit) of a whole conversation."""

    def __init__(self) -> None:
        self.rows = 0
        self.states: dict[int, Best] = {NOTHING: (0, 0, "")}
        self.down: list[tuple | None] = [None]  # by rank: (the part before, this piece)
        self._insert()

    def _insert(self) -> None:
        """Close the layer: a state may be reached from another by one or two inserted turns."""
        for _ in range(2):
            for state, (cost, rank, tail) in list(self.states.items()):
                for initial, then in _AFTER[state]:
                    if initial in ROLES:
                        self._offer(self.states, then, (cost + INSERT, rank, tail + "I"))

    @staticmethod
    def _offer(states: dict[int, Best], state: int, best: Best) -> None:
        if state not in states or best < states[state]:
            states[state] = best

    def step(self, initial: str, must_go: bool, truncated: bool) -> None:
        new: dict[int, Best] = {}
        stays = CUT_OFF if truncated else 0
        for state, (cost, rank, tail) in self.states.items():
            self._offer(new, state, (cost + DELETE, rank, tail + "D"))
            for wanted, then in () if must_go else _AFTER[state]:
                if initial == wanted:
                    self._offer(new, then, (cost + stays, rank, tail + "K"))
                elif wanted in ROLES:
                    self._offer(new, then, (cost + stays + REROLE, rank, tail + "R"))
        self.states = new
        self.rows += 1
        if self.rows % PIECE == 0:
            self._set_down()
        self._insert()

    def _set_down(self) -> None:
        """Before inserts all audits end with this row, so none is the beginning of another and their order is final."""
        order = sorted({(rank, tail) for _, rank, tail in self.states.values()})
        place = {x: k for k, x in enumerate(order)}
        self.states = {s: (cost, place[rank, tail], "") for s, (cost, rank, tail) in self.states.items()}
        self.down = [(self.down[rank], tail) for rank, tail in order]

    def result(self) -> tuple[int, str]:
        cost, rank, tail = min(self.states[s] for s in (NOTHING, ASSISTANT) if s in self.states)
        pieces, at = [tail], self.down[rank]
        while at is not None:
            at, piece = at
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage: by crc32("conv_id:turn") % 20, 0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space each, but conv_id and turn keep theirs in their columns.

    Dropped rows come with dropped = true and without text, so that their conversation is known.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, F.lit("")).when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.explode(copies).alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role (its initial), dropped, blank, truncated, h (hash of role and text), n_bytes: what the recursion reads of a row."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return rows.select(
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("role"),
        "dropped",
        (F.length(F.rtrim("text", F.lit(SPACES))) == 0).alias("blank"),
        (~last.isin(*SENTENCE_ENDS)).alias("truncated"),
        F.xxhash64("role", "text").alias("h"),
        F.octet_length("text").alias("n_bytes"),
        F.col("role").alias("whole_role"),
        F.xxhash64("text").alias("text_h"),
    )


def _streams(df: DataFrame, order: list[Column], read: Callable[[], object], schema: str, dealt: bool = False) -> DataFrame:
    """Rows of a conversation, in order, one after the other to an object of `read`; memory is what the object holds.

    dealt: the rows are in partitions by conv_id already.
    """
    fields = [x.split() for x in schema.split(", ")]
    arrow = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                out: list[dict] = []
                for row in batch.slice(start, ROWS).to_pylist():
                    if reader is None or row["conv_id"] != last:
                        if reader is not None:
                            out += reader.end(last)
                        reader, last = read(), row["conv_id"]
                    out += reader.row(row)
                yield pa.RecordBatch.from_pylist(out, arrow)
        if reader is not None:
            yield pa.RecordBatch.from_pylist(reader.end(last), arrow)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(n, "conv_id")
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).mapInArrow(run, schema)


class _Audit:
    """Reads the fault rows of a conversation; its end is the row of the result, without texts."""

    def __init__(self) -> None:
        self.path = Recursion()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before: str | None = None
        self.turns: tuple[int, int, int] | None = None  # least, greatest, distinct

    def row(self, r: dict) -> list[dict]:
        if r["dropped"]:
            return []
        if r["turn"] is not None:
            low, high, n = self.turns or (r["turn"], None, 0)
            self.turns = low, r["turn"], n + (r["turn"] != high)
        if self.before is not None and self.before + r["role"] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = r["role"]
        fault = "blank" if r["blank"] else "duplicate" if r["again"] else "truncated" if r["truncated"] else None
        if fault:
            self.counts[fault] += 1
        self.path.step(r["role"], fault in ("blank", "duplicate"), fault == "truncated")
        return []

    def end(self, conv_id: int | None) -> list[dict]:
        cost, audit = self.path.result()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return [{"conv_id": conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": audit}]


def audits(damaged: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of `damaged` (see damage).

    Rows are dealt once by conv_id; that a row repeats an earlier one is a window over (conv_id, hash of role and text) in the
    same partitions. A conversation of which nothing is left has zeros and an empty audit.
    """
    n = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("whole_role"), F.col("text_h"), F.col("again")]
    same = Window.partitionBy("conv_id", "h", "n_bytes", "dropped").orderBy(F.col("turn").asc_nulls_first())
    marked = faults(damaged).repartition(n, "conv_id").withColumn("again", F.row_number().over(same) > 1)
    slim = marked.select("conv_id", "turn", "role", "dropped", "blank", "again", "truncated", "whole_role", "text_h")
    return _streams(slim, order, _Audit, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string", dealt=True)


class _Repair:
    """Follows an audit over the rows of its conversation. Each turn of the repaired conversation goes to `turn`."""

    def __init__(self) -> None:
        self.audit, self.at, self.state = "", 0, NOTHING
        self.head: dict = {}

    def turn(self, edit: str, role: str, text: str) -> list[dict]:
        raise NotImplementedError

    def _inserts(self) -> list[dict]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            out += self._add("I", None, "")
        return out

    def _add(self, edit: str, role: str | None, text: str) -> list[dict]:
        self.at += 1
        (initial, then), *other = _AFTER[self.state]
        if initial == "s" and (role is None or role[:1] != "s"):
            initial, then = other[0]
        self.state = then
        return self.turn(edit, ROLES[initial] if role is None else role, text)

    def row(self, r: dict) -> list[dict]:
        if r["audit"] is not None:
            self.head, self.audit = r, r["audit"]
            return []
        if r["dropped"]:
            return []
        out = self._inserts()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
            return out
        return out + self._add(edit, None if edit == "R" else r["role"], r["text"])

    def end(self, conv_id: int | None) -> list[dict]:
        return self._inserts()


class _Turns(_Repair):
    place = -1

    def turn(self, edit: str, role: str, text: str) -> list[dict]:
        self.place += 1
        return [{"conv_id": self.head["conv_id"], "place": self.place, "edit": edit, "role": role, "text": text}]


class _Digest(_Repair):
    def __init__(self) -> None:
        super().__init__()
        self.sha, self.between = hashlib.sha256(), b""

    def turn(self, edit: str, role: str, text: str) -> list[dict]:
        self.sha.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"
        return []

    def end(self, conv_id: int | None) -> list[dict]:
        super().end(conv_id)
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        return [{k: self.head[k] for k in names} | {"repaired_sha256": self.sha.hexdigest()}]


def _with_audits(damaged: DataFrame) -> DataFrame:
    """The damaged rows and, before each conversation, its audit. Equal turns stand in the order that the audit was made in."""
    rows = damaged.withColumn("text_h", F.xxhash64("text"))
    return rows.unionByName(audits(damaged), allowMissingColumns=True)


def _order() -> list[Column]:
    return [F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_h")]


def repaired_turns(damaged: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the turns of every repaired conversation. One of which nothing is left has none."""
    return _streams(_with_audits(damaged), _order(), _Turns, "conv_id long, place long, edit string, role string, text string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The rows of `conversations` (conv_id, turn, role, text), damaged (see damage) and repaired: a row a conv_id with gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of the repaired turns as role:text, joined by \\n).

    Null conv_ids are one conversation. Rows that repeat a turn are turns of their own, by role and then a hash of the text;
    roles and texts of any length, empty ones too, are rows like others. Further columns do not matter; an empty table gives
    an empty one. gaps counts the missing numbers between the least and the greatest turn.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _streams(_with_audits(damage(rows)), _order(), _Digest, schema)
