"""How far the sources of a language are from each other in the terms they use, by sorted streams.

Terms are sorted by language, term, source and document and scanned run by run. A task first sorts what lies in its own texts and hands on
runs (language, term, source) with documents and occurrences; these are dealt out by language and term, sorted again and scanned as a
stream, which yields document frequencies and counts at once. Kept terms then go to cells of a grid of source blocks, each sorted by
term: the scan of a cell adds up, term by term, how far the shares of each pair of sources are apart, and hands on one partial sum
for each pair and the terms that a source overuses. No pair is ever emitted for a single term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import Scratch, lower_ascii, only, slices

#: Shares are whole numbers of this.
UNIT = 1_000_000_000
#: Sources of a block: a cell holds a square of this many sums.
BLOCK_SOURCES = 512
#: Rows (term, source) of a cell, about; a language with more is cut into more cells by hash of the term.
CELL_ROWS = 1 << 14
#: Bytes of runs that a task gathers before it hands them on.
GATHERED = 24 << 20
#: Numbers of a batch of terms by sources whose distances are added up at once.
BATCH = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Audit:
    least_documents: int = 30
    smoothing: int = 5
    top_terms: int = 50


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a slice of texts and the row of each: runs of ASCII letters and of bytes beyond ASCII, A-Z lower-cased."""
    solid = _LETTER[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) if len(buf) else solid
    after = np.concatenate((solid[1:], [False])) if len(buf) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    found = pa.Array.from_buffers(pa.utf8(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(lower_ascii(buf)[solid].tobytes())])
    return found, np.searchsorted(off, start, side="right") - 1


def _runs_of(lang: pa.Array, source: pa.Array, buf: np.ndarray, off: np.ndarray) -> pa.Table:
    """(lang, term, source, docs, n) of a slice: its terms sorted by language, term, source and document, run by run."""
    terms, row = _terms(buf, off)
    coded = terms.dictionary_encode()
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(off)
    order = np.argsort((code * (int(group.max(initial=0)) + 1) + group[row]) * rows + row, kind="stable")
    code, row = code[order], row[order]
    at = group[row]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (at[1:] != at[:-1]))) if len(code) else np.zeros(0, bool)
    new_doc = np.concatenate(([True], new[1:] | (row[1:] != row[:-1]))) if len(code) else new
    first = np.flatnonzero(new)
    docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else first
    n = np.diff(np.append(first, len(code)))
    return pa.table({"lang": langs.dictionary.take(pa.array(at[first] // n_sources)), "term": coded.dictionary.take(pa.array(code[first])), "source": sources.dictionary.take(pa.array(at[first] % n_sources)), "docs": pa.array(docs), "n": pa.array(n)})


RUNS = "lang string, term string, source string, docs long, n long"
_SUMS = [("docs", "sum"), ("n", "sum")]


def _summed(parts: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(parts).group_by(["lang", "term", "source"], use_threads=False).aggregate(_SUMS)
    return got.select(["lang", "term", "source", "docs_sum", "n_sum"]).rename_columns(["lang", "term", "source", "docs", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a task's texts; runs of the same key are summed up before they leave."""
    only("divergence")
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for lo, hi, buf, off in slices(batch.column(2)):
            held.append(_runs_of(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), buf, off))
            size += held[-1].nbytes
            if size > GATHERED:
                held = [_summed(held)]
                size = held[0].nbytes
                if 2 * size > GATHERED:
                    yield from held.pop().to_batches(1 << 14)
                    size = 0
    if held:
        yield from _summed(held).to_batches(1 << 14)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    a = column.combine_chunks()
    return np.concatenate(([True], pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False))) if len(a) else np.zeros(0, bool)


KEPT = "lang string, term string, source string, n long, total long, first boolean"


def _kept(least: int):
    """Scan of runs sorted by language, term and source: the terms of at least `least` documents, with their occurrences in each source
    (n) and in all (total); first marks one row of each term."""

    def scan(held: pa.Table) -> pa.Table:
        new_term = _changes(held["lang"]) | _changes(held["term"])
        new = new_term | _changes(held["source"])
        at, terms = np.flatnonzero(new), np.flatnonzero(new_term)
        n = np.add.reduceat(held["n"].to_numpy(), at)
        sizes = np.diff(np.append(np.searchsorted(at, terms), len(at)))
        docs = np.repeat(np.add.reduceat(held["docs"].to_numpy(), terms), sizes)
        total = np.repeat(np.add.reduceat(held["n"].to_numpy(), terms), sizes)
        some = docs >= least
        rows = held.take(pa.array(at[some]))
        return pa.table({"lang": rows["lang"], "term": rows["term"], "source": rows["source"], "n": pa.array(n[some]), "total": pa.array(total[some]), "first": pa.array(new_term[at][some])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("divergence")
        open_: pa.Table | None = None  # the rows of the last term, which may go on
        for batch in batches:
            held = pa.Table.from_batches([batch]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            last = int(np.flatnonzero(_changes(held["lang"]) | _changes(held["term"]))[-1])
            if last:
                yield from scan(held.slice(0, last)).to_batches()
            open_ = _summed([held.slice(last)]).sort_by("source")  # a term's rows are no more than its sources; summing leaves them in any order
        if open_ is not None:
            yield from scan(open_).to_batches()

    return run


def share(n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * n / of), exact: a long division by thousands, as UNIT * n may leave 64 bits."""
    of = np.asarray(of, np.int64)
    if len(of.reshape(-1)) and of.max() >= (1 << 63) // 1000:
        raise ValueError("more than 9.2e15 occurrences")
    whole, rest = np.divmod(np.asarray(n, np.int64), of)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + step
    return whole + 1


PARTIAL = "lang string, source string, part string, item string, value long"


class _Cell:
    """Sums over the terms of one cell: sources of one block (rows) against those of another one, or of the same one."""

    def __init__(self, key: tuple, smoothing: int):
        self.lang, self.x, self.y, self.chunk = key
        self.smoothing = smoothing
        self.sides: tuple[list, list] = ([], [])  # (source, N)
        self.ready = False

    def begin(self) -> None:
        self.ready = True
        self.names = [[s[0] for s in side] for side in self.sides]
        self.at = [{s: k for k, s in enumerate(names)} for names in self.names]
        self.of = [np.array([s[1] + self.smoothing * self.v for s in side], np.int64) for side in self.sides]
        self.zero = [share(np.full(len(of), self.smoothing), of) if self.v else np.zeros(len(of), np.int64) for of in self.of]
        self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
        self.terms: list[list] = [[], []]
        self.seen = self.count = 0
        self.last = None

    def add(self, side: int, term: str, source: str, n: int) -> None:
        if term != self.last:
            if self.count and (self.count + 1) * sum(map(len, self.names)) > BATCH:
                self.flush()
            self.last = term
            self.count += 1
        self.terms[side].append((self.count - 1, self.at[side][source], n))

    def flush(self) -> None:
        p = []
        for side in (0, 1):
            shares = np.repeat(self.zero[side][None], self.count, 0)
            if self.terms[side]:
                t, s, n = np.array(self.terms[side], np.int64).T
                shares[t, s] = share(n + self.smoothing, self.of[side][s])
            p.append(shares)
        for k in range(self.sums.shape[0]):
            self.sums[k] += np.abs(p[0][:, k : k + 1] - p[1]).sum(0)
        self.seen += self.count
        self.terms, self.count, self.last = [[], []], 0, None

    def end(self) -> Iterator[tuple[str, str, int]]:
        if not self.ready:
            self.begin()
        if self.count:
            self.flush()
        rest = (self.v if self.chunk == 0 else 0) - self.seen  # terms that no source of the cell has, counted once over all chunks
        sums = self.sums + rest * np.abs(self.zero[0][:, None] - self.zero[1][None])
        for k, a in enumerate(self.names[0]):
            for j, b in enumerate(self.names[1]):
                if a != b:
                    yield a, b, int(sums[k, j])
                    if self.x != self.y:
                        yield b, a, int(sums[k, j])


def _cells(smoothing: int):
    """Scan of cells sorted by kind (sources, then terms), term and source: partial sums of pairs, and terms above the language's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("divergence")
        out: list[tuple] = []
        cell: _Cell | None = None

        def full() -> pa.RecordBatch:
            rows = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows[:4]] + [pa.array(rows[4], pa.int64())], names=["lang", "source", "part", "item", "value"])

        def pairs() -> Iterator[pa.RecordBatch]:
            for a, b, value in cell.end():
                out.append((cell.lang, a, "pair", b, value))
                if len(out) >= 8192:
                    yield full()

        for batch in batches:
            lang, x, y, chunk, side, term, source, n, _, v, _, _ = (c.to_pylist() for c in batch.columns)
            counted = np.array([t is not None for t in term], bool)
            n_, total_, v_, all_, of_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (7, 8, 9, 10, 11))
            p = share(n_ + smoothing, np.where(counted, of_ + smoothing * v_, 1))
            q = share(total_ + smoothing, np.where(counted, all_ + smoothing * v_, 1))
            for k in range(batch.num_rows):
                key = (lang[k], x[k], y[k], chunk[k])
                if cell is None or key != (cell.lang, cell.x, cell.y, cell.chunk):
                    if cell is not None:
                        yield from pairs()
                    cell = _Cell(key, smoothing)
                    cell.v = v[k]
                sides = (0, 1) if x[k] == y[k] else (side[k],)
                if term[k] is None:
                    for s in sides:
                        cell.sides[s].append((source[k], n[k]))
                    continue
                if not cell.ready:
                    cell.begin()
                for s in sides:
                    cell.add(s, term[k], source[k], n[k])
                if x[k] == y[k] and p[k] > q[k]:
                    out.append((lang[k], source[k], "term", term[k], int(p[k] - q[k])))
                    if len(out) >= 8192:
                        yield full()
        if cell is not None:
            yield from pairs()
        if out:
            yield full()

    return run


def divergence(docs: DataFrame, how: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of docs (text, lang, source); rank from 1 within group and part,
    values descending, ties by item (bytes of UTF-8).

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps the terms of at least least_documents of its
    documents, V of them. A group gives each kept term the share p = 1 + floor(10^9 (count + s) / (N + s V)), N its occurrences of
    kept terms; the language's own share q likewise. Part `pair`: each other source of the language with the sum of |p - p'| over all kept
    terms (0 where none is kept). Part `term`: the top_terms terms that the group has and whose p is above q, with p - q.

    Null text, lang and source count as ''; each row is a document, repeated rows too; a group without terms has pairs and no terms; one whose
    language has no other source has no pairs; an empty table gives an empty one; other columns are not read. All arithmetic is in whole
    numbers and raises beyond 9.2e15 occurrences. Hot terms are summed up in each task before they are dealt out; hot languages are
    cut by term, and many sources by blocks, so no task holds more than a square of BLOCK_SOURCES sums.
    """
    scratch = Scratch(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    runs = rows.mapInArrow(_runs, RUNS)
    ordered = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = scratch.write(ordered.mapInArrow(_kept(how.least_documents), KEPT), "kept")

    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"), F.count("*").alias("rows"))
    groups = rows.select("lang", "source").distinct().join(used, ["lang", "source"], "left").na.fill(0)
    langs = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("all"), F.greatest(F.ceil(F.sum("rows") / CELL_ROWS), F.lit(1)).cast("int").alias("chunks"), F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    named = scratch.write(groups.select("lang", "source", "n").join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")

    def dealt(block_rows: DataFrame, chunk) -> DataFrame:
        """A row for each cell of its block: with every other block, and with its own."""
        spread = block_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", chunk)
        return spread.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "chunk", (F.col("block") > F.col("other")).cast("int").alias("side"), "term", "source", "n", "total", "v", "all", "of")

    sources = dealt(named.withColumns({"term": F.lit(None).cast("string"), "total": F.lit(0).cast("long"), "of": F.col("n")}), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    used_terms = kept.select("lang", "source", "term", "n", "total").join(named.withColumnRenamed("n", "of"), ["lang", "source"])
    terms = dealt(used_terms, F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    cells = sources.unionByName(terms).repartition("lang", "x", "y", "chunk").sortWithinPartitions("lang", "x", "y", "chunk", F.col("term").asc_nulls_first(), "side", "source")
    found = scratch.write(cells.mapInArrow(_cells(how.smoothing), PARTIAL), "partial")

    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    tops = found.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= how.top_terms)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(tops).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
