"""Repair of conversations by weighted finite-state composition.

Three machines describe a repair. The input acceptor reads a conversation's rows in order; the edit transducer keeps, reroles or deletes
a row, or inserts one; the grammar acceptor knows which role may follow. Their composition is never built whole: the arcs that
leave a row are made when a row of its kind is first met, and states are those of the grammar, one layer for each row. Weights are
pairs (cost, string of edit labels), compared in that order. Within a layer every path has as many labels other than insertions as
rows were read and ends in one of them, so no path's string begins another's, and the order of two strings stays what it is
whatever follows: a path is known by its rank. So a layer is four paths, the shortest path needs four bytes of a row to be read
back, and each path carries the digest of what it has written so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Scratch, bounded, only, small

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: The grammar `(s?(ua)+)?`: for each state the initials that it takes and where they lead. States: nothing yet, after the
#: system's row, after the user's, after the assistant's.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
FOLLOWING = ("su", "ua", "au")
_SPACES = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


@lru_cache(maxsize=None)
def inserted(state: int) -> tuple[tuple[str, int, str], ...]:
    """(labels, state, initials) of what may be inserted in a state, nothing included. A state is never entered twice on the way: that
    would cost more and lead nowhere else."""
    found, seen, now = [("", state, "")], {state}, [("", state, "")]
    while now:
        now = [(labels + INSERT, to, said + i) for labels, at, said in now for i, to in GRAMMAR[at].items() if i in ROLES and to not in seen]
        seen |= {to for _, to, _ in now}
        found += now
    return tuple(found)


@lru_cache(maxsize=1 << 16)
def arcs(state: int, initial: str, gone: bool, cut: bool, costs: Costs) -> tuple[tuple[int, str, int, str, str], ...]:
    """(cost, labels, state, initials inserted, role written: None deletes, '' keeps) of all ways to read one row in a state of the grammar.
    gone: the row has to go; cut: it is truncated."""
    found = []
    for labels, at, said in inserted(state):
        paid = len(labels) * costs.insert
        found.append((paid + costs.delete, labels + DELETE, at, said, None))
        if gone:
            continue
        extra = costs.truncated if cut else 0
        if initial in GRAMMAR[at]:
            found.append((paid + extra, labels + KEEP, GRAMMAR[at][initial], said, ""))
        found += [(paid + extra + costs.rerole, labels + REROLE, to, said, ROLES[i]) for i, to in GRAMMAR[at].items() if i in ROLES]
    return tuple(found)


@lru_cache(maxsize=None)
def endings(state: int, costs: Costs) -> tuple[tuple[int, str, str], ...]:
    """(cost, labels, initials) of what may be inserted after the last row so that the grammar accepts."""
    return tuple((len(labels) * costs.insert, labels, said) for labels, at, said in inserted(state) if at in FINAL)


class Path:
    """The cheapest way to one state of the grammar: cost, rank of its labels among the layer's, and the digest of what it wrote."""

    __slots__ = ("cost", "rank", "hash", "any")

    def __init__(self, cost: int, rank: int, digest, some: bool):
        self.cost, self.rank, self.hash, self.any = cost, rank, digest, some

    def written(self, said: str, role: str | None, text: str):
        """The digest and whether there is a row in it, after inserted rows and one row of the conversation."""
        rows = [f"{ROLES[i]}:" for i in said]
        if role is not None:
            rows.append(f"{role}:{text}")
        if not rows:
            return self.hash, self.any
        digest = self.hash.copy()
        digest.update((("\n" if self.any else "") + "\n".join(rows)).encode("utf-8", "surrogatepass"))
        return digest, True


class Repair:
    """One conversation, row by row; holds four paths and, to read the labels back, four small numbers of each row."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.paths: dict[int, Path] = {0: Path(0, 0, hashlib.sha256(), False)}
        self.back = bytearray()
        self.moves: list[tuple[int, str]] = []  # by number: the state before, and labels
        self.number: dict[tuple[int, str], int] = {}

    def read(self, initial: str, gone: bool, cut: bool, role: str, text: str) -> None:
        best: dict[int, tuple] = {}
        for state, path in self.paths.items():
            for cost, labels, to, said, put in arcs(state, initial, gone, cut, self.costs):
                way = (path.cost + cost, path.rank, labels, state, said, put)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        rank = {to: k for k, to in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        row, after = bytearray(len(GRAMMAR)), {}
        for to, (cost, _, labels, state, said, put) in best.items():
            digest, some = self.paths[state].written(said, put if put is None or put else role, text)
            after[to] = Path(cost, rank[to], digest, some)
            move = (state, labels)
            if move not in self.number:
                self.number[move] = len(self.moves)
                self.moves.append(move)
            row[to] = self.number[move]
        self.back += row
        self.paths = after

    def result(self) -> tuple[int, str, str]:
        """Cost, labels and digest of the cheapest accepted path, of equal ones that of the least labels."""
        cost, _, labels, state, said = min((p.cost + cost, p.rank, labels, state, said) for state, p in self.paths.items() for cost, labels, said in endings(state, self.costs))
        digest, _ = self.paths[state].written(said, None, "")
        parts = [labels]
        for at in range(len(self.back) - len(GRAMMAR), -1, -len(GRAMMAR)):
            state, labels = self.moves[self.back[at + state]]
            parts.append(labels)
        return cost, "".join(reversed(parts)), digest.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows damaged by crc32 of `conv_id:turn` modulo 20, so that repairs have something to do.

    0 drops the row, 1 empties its text, 2 takes its full stops, marks and questions, 3 repeats it, 4 makes the role user. A null turn or id counts as
    one space in the number, a null role or text is one space. A dropped row stays as a mark (there = false), so that its conversation
    isn't forgotten.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")


def _last_word_letter(text: str) -> Column:
    """The last character that isn't space, '' where there is none."""
    return F.substring(F.rtrim(F.col(text), F.lit(_SPACES)), -1, 1)


def _judged(rows: DataFrame) -> DataFrame:
    """rows with fault: 1 blank, 2 duplicate of a row of an earlier turn, 3 truncated, 0 none. Only repeated texts of a conversation are
    joined, by a 128-bit hash of the text: the first turn of each is known from grouped minima. What stands twice in one turn is seen where
    rows are read in order."""
    last = _last_word_letter("text")
    marked = rows.withColumns({"digest": F.md5(F.encode("text", "utf-8")), "last": last})
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first")
    again = marked.where("there and last <> ''").groupBy("conv_id", "role", "digest").agg(first, F.count("*").alias("n")).where("n > 1")
    again = Scratch(rows.sparkSession).write(again.select("conv_id", "role", "digest", "first"), "again")
    a, b = marked.alias("a"), (F.broadcast(again) if small(again, 96) else again).alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    joined = a.join(b, same, "left").select("a.*", "b.first")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("has"), "turn") > F.col("first"), F.lit(False))
    fault = F.when(F.col("last") == "", 1).when(later, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return joined.select("conv_id", "turn", "role", "text", "there", fault.cast("int").alias("fault"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one task, by turn (null first), role and text: sorted by Spark, which may spill, and read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repair")
        held: list[tuple] = []
        size = 0
        now: object = run  # no conversation yet
        one, counts, before, turns = Repair(costs), [0] * 5, None, [None, None, 0]

        def done() -> None:
            nonlocal size
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            held.append((now, gaps, *counts[1:5], *one.result()))
            size += 200 + len(held[-1][-2])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in REPORT.split(", ")])

        for batch in batches:
            for conv, turn, role, text, there, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now or now is run:
                    if now is not run:
                        done()
                    now, one, counts, before, turns = conv, Repair(costs), [0] * 5, None, [None, None, 0]
                    if size > 1 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if not there:
                    continue
                if fault in (0, 3) and before == (turn, role, text):
                    fault = 2
                if fault:
                    counts[fault] += 1
                if before is not None and before[1][:1] + role[:1] not in FOLLOWING:
                    counts[4] += 1
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
                before = (turn, role, text)
                one.read(role[:1], fault in (1, 2), fault == 3, role, text)
        if now is not run:
            done()
        if held:
            yield batch_of(held)

    return run


def reports(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn: long, role, text, and there: false marks a row that only names its
    conversation): gaps (turns that lack between the first and the last), blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours whose roles may not follow), cost, audit (the cheapest edits' labels in order, of equal ones the least) and
    repaired_sha256 (of the repaired rows `role:text`, joined by newlines).

    Blank and duplicate rows have to go, a truncated row that stays costs extra. Rows of one turn are ordered by role and text, null turns
    stand first, null roles and texts count as one space; a role without an initial (an empty one) can't be kept. A conversation
    without rows has zeros, an empty audit and the digest of nothing; rows with a null id are one conversation; an empty table gives
    an empty one; other columns are not read. A conversation is read by one task, as its digest is serial by definition, but as a sorted
    stream: the task holds four paths, and four bytes of each row for the audit.
    """
    bounded(rows.sparkSession)
    return _in_order(_judged(_whole(rows))).mapInArrow(_report(costs), REPORT)


def _whole(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), there.alias("there"))


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place from 1, edit, turn, role, text): the rows that stand after the edits of each conversation's audit, inserted ones with
    a null turn and empty text. report holds conv_id and audit as reports() gives them; conversations that it lacks are left out."""
    marks = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = _whole(rows).where("there").select("conv_id", "turn", "role", "text", F.lit(1).alias("kind")).unionByName(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repair")
        names = ["conv_id", "place", "edit", "turn", "role", "text"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        now, audit, at, state, place = run, "", 0, 0, 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == INSERT:
                ((initial, to),) = [(i, to) for i, to in GRAMMAR[state].items() if i in ROLES]
                at, state, place = at + 1, to, place + 1
                out.append((now, place, INSERT, None, ROLES[initial], ""))

        for batch in batches:
            for conv, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    now, audit, at, state, place = conv, text, 0, 0, 0
                    insert()
                    continue
                if conv != now or at >= len(audit):
                    continue
                edit, at = audit[at], at + 1
                if edit != DELETE:
                    if edit == REROLE:
                        ((initial, to),) = [(i, to) for i, to in GRAMMAR[state].items() if i in ROLES]
                        role = ROLES[initial]
                    else:
                        to = GRAMMAR[state][role[:1]]
                    state, place = to, place + 1
                    out.append((conv, place, edit, turn, role, text))
                insert()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []

    return _in_order(both, "kind").select("conv_id", "kind", "turn", "role", "text").mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")
