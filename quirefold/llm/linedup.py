"""Line deduplication by a deletion-neighbourhood join.

Two lines are within one edit exactly when one is the other less a character, or both less the character at one place are the
same. So each line sends out the hashes of itself and of itself less each of its characters; lines that meet at a hash are
verified by their edit distance, and the earliest stays. To send out few hashes, a first round finds for each line the thirds
(of its length) outside which another line agrees with it; characters are left out in those thirds only, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.common import OTHER_VALUES, Scratch, Spans, mix, slices

#: Lines of fewer characters are neither dropped nor compared.
LEAST_CHARS = 20
SEGMENTS = 3
#: Keys (8 bytes each) up to which a checked set of shared keys is broadcast; beyond, it is joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Rows of a batch of variants.
BATCH_ROWS = 1 << 16
_LAST = (1 << 63) - 1


class Lines:
    """The lines of one slice of texts: row, number within the row, byte range, characters, and hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, least: int):
        newline = np.flatnonzero(buf == 10)
        head = np.sort(np.concatenate((newline + 1, off[:-1])))
        # a row that begins where the one before ends has its own first line; a newline that ends a row opens an empty line
        row = np.concatenate((np.searchsorted(off, newline, side="right") - 1, np.arange(len(off) - 1)))[np.argsort(np.concatenate((newline + 1, off[:-1])), kind="stable")]
        by = np.lexsort((head, row))
        head, row = head[by], row[by]
        first = np.searchsorted(row, row)
        self.number = np.arange(len(row)) - first
        tail = np.minimum(np.append(newline, len(buf))[np.searchsorted(newline, head)], off[row + 1])
        tail = np.maximum(tail, head)
        self.per_row = np.bincount(row, minlength=len(off) - 1)
        self.leads = np.flatnonzero((buf & 0xC0) != 0x80)
        at, to = np.searchsorted(self.leads, head), np.searchsorted(self.leads, tail)
        long = to - at >= least
        self.row, self.number, self.head, self.tail, self.at, self.chars = row[long], self.number[long], head[long], tail[long], at[long], (to - at)[long]
        self.spans = Spans(buf)
        self.h1 = self.spans.hash(self.head, self.tail)
        self.buf = buf

    def byte_of(self, line: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Byte at which a character of a line begins; its end for the number of characters."""
        k = self.at[line] + char
        inside = char < self.chars[line]
        return np.where(inside, self.leads[np.minimum(k, len(self.leads) - 1)], self.tail[line])

    def outside(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(extra, segment, first char, end char, key): the key is a hash of what a line has outside the segment of its length
        (extra 0) or of a length of one more (extra 1)."""
        every = np.arange(len(self.row))
        for extra in (0, 1):
            n = self.chars + extra
            for k in range(SEGMENTS):
                a, b = k * n // SEGMENTS, (k + 1) * n // SEGMENTS
                end = self.chars - (n - b)  # the characters from there on are the last n - b
                p = self.spans.hash(self.head, self.byte_of(every, a))
                s = self.spans.hash(self.byte_of(every, end), self.tail)
                yield extra, k, a, end, mix(p * np.uint64(3) + mix(s + n.astype(np.uint64) * np.uint64(SEGMENTS) + np.uint64(k)))


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """o: doc_id (the last place for null); t: hash of the text, so rows that share an id and not the text are told apart."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(t).alias("t"), t.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _lines(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("lines")
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(2)):
                x = Lines(buf, off, least)
                h2 = Spans(buf, OTHER_VALUES).hash(x.head, x.tail)
                at = pa.array(x.row + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number, pa.int32()), _signed(x.h1), _signed(h2)], names=["o", "t", "no", "h1", "h2"])

    return docs.mapInArrow(run, "o long, t long, no int, h1 long, h2 long")


def _keys(docs: DataFrame, least: int) -> DataFrame:
    """(key, line): once for each line of a slice and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("lines")
        for batch in batches:
            for _, _, buf, off in slices(batch.column(2)):
                x = Lines(buf, off, least)
                _, once = np.unique(x.h1, return_index=True)
                for _, _, _, _, key in x.outside():
                    yield pa.RecordBatch.from_arrays([_signed(key[once]), _signed(x.h1[once])], names=["key", "line"])

    return docs.mapInArrow(run, "key long, line long")


def _keys_of_rows(docs: DataFrame, least: int) -> DataFrame:
    """(key, o, t): the keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("lines")
        for batch in batches:
            for lo, _, buf, off in slices(batch.column(2)):
                x = Lines(buf, off, least)
                at = pa.array(x.row + lo)
                for _, _, _, _, key in x.outside():
                    yield pa.RecordBatch.from_arrays([_signed(key), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "o", "t"])

    return docs.mapInArrow(run, "key long, o long, t long")


def _variants(docs: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(key, kind, h1, o, t, no): kind 0 the line itself, 1 the line less a character, 2 the same with its place."""
    few = shared.count() <= BROADCAST_KEYS
    if few:
        known = np.sort(shared.toPandas()["key"].to_numpy(np.int64))
        sent = docs.sparkSession.sparkContext.broadcast(known)
        docs = docs.withColumn("hot", F.lit(None).cast("array<long>"))
    else:
        sent = None
        docs = docs.join(_keys_of_rows(docs, least).join(shared, "key", "left_semi").groupBy("o", "t").agg(F.collect_set("key").alias("hot")), ["o", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("lines")
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(2)):
                x = Lines(buf, off, least)
                hot = sent.value if sent else np.unique(batch.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
                if not len(hot) or not len(x.row):
                    continue
                o, t = (batch.column(c).slice(lo, hi - lo).to_numpy()[x.row] for c in (0, 1))
                by = np.lexsort((x.number, t, o))  # of equal lines the earliest speaks for all
                _, once = np.unique(x.h1[by], return_index=True)
                first = np.zeros(len(x.row), bool)
                first[by[once]] = True

                def rows(line: np.ndarray, key: np.ndarray, kind: int) -> pa.RecordBatch:
                    cells = [_signed(key), pa.array(np.full(len(line), kind, np.int8)), _signed(x.h1[line]), pa.array(o[line], pa.int64()), pa.array(t[line], pa.int64()), pa.array(x.number[line], pa.int32())]
                    return pa.RecordBatch.from_arrays(cells, names=["key", "kind", "h1", "o", "t", "no"])

                for extra, _, a, end, key in x.outside():
                    key = key.view(np.int64)
                    meets = np.flatnonzero(first & (hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key))
                    if extra:
                        yield rows(meets, x.h1[meets], 0)
                        continue
                    parts = np.searchsorted(np.cumsum(end[meets] - a[meets]), np.arange(0, (end[meets] - a[meets]).sum() + 1, BATCH_ROWS))
                    for part in np.split(meets, np.unique(parts)):
                        size = end[part] - a[part]
                        line = np.repeat(part, size)
                        char = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + a[line]
                        less = x.spans.hash_without(x.head[line], x.tail[line], x.byte_of(line, char), x.byte_of(line, char + 1))
                        yield rows(line, less, 1)
                        yield rows(line, mix(less ^ mix(char.astype(np.uint64) + np.uint64(1))), 2)

    return docs.select("o", "t", "text", "hot").mapInArrow(run, "key long, kind byte, h1 long, o long, t long, no int")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """places (o, t, no) with the line there."""
    found = docs.join(F.broadcast(places) if common.small(places, 24) else places, ["o", "t"])
    return found.select("o", "t", "no", F.get(F.split("text", "\n"), F.col("no").cast("int")).alias("line")).dropDuplicates(["o", "t", "no"])


def _place(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}") for c in ("o", "t", "no")))


#: Characters up to which a pair is verified by edit distance; longer lines by their common beginning, which is linear.
SHORT_LINE = 200


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether a character put in, taken out or changed makes b of a: what follows the first difference must be equal. That is found by
    halving, so a line of any length costs a few comparisons of its bytes."""
    na, nb = F.char_length(a), F.char_length(b)
    least = F.least(na, nb)
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    same = F.aggregate(powers, F.lit(0), lambda n, step: F.when((step <= least - n) & (F.substr(a, n + 1, step) == F.substr(b, n + 1, step)), n + step).otherwise(n))

    def after(skip_a: int, skip_b: int) -> Column:
        return F.substr(a, same + 1 + skip_a) == F.substr(b, same + 1 + skip_b)

    long_ = F.when(na == nb, after(1, 1)).when(na == nb + 1, after(1, 0)).when(nb == na + 1, after(0, 1)).otherwise(F.lit(False))
    return F.when(F.greatest(na, nb) <= SHORT_LINE, F.levenshtein(a, b, 1) >= 0).otherwise(long_)


def duplicate_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST_CHARS, text: str = "text") -> DataFrame:
    """(o, t, dropped): for each row that loses lines the sorted numbers (from 0) of those lines. o is doc_id, t a hash of the text.

    Lines are what newlines separate; one of `least` characters or more is dropped if an earlier line (by doc_id, then number) is
    equal or, with max_edits 1, within one edit (a character put in, taken out or changed), whether that one stays or not.
    Null doc_ids come last; rows equal in id and text are treated alike; a null text is one empty line.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    scratch = Scratch(docs.sparkSession)
    docs = _prepared(docs, text)
    lines = scratch.write(_lines(docs, least), "lines")
    n = lines.count()
    distinct = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("earliest"))
    if max_edits:
        shared = scratch.write(_keys(docs, least).groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key"), "keys", 6 * n, 24)
        sent = scratch.write(_variants(docs, shared, least), "variants")
        scratch.drop(shared)
        who = F.struct("o", "t", "no", "h1")
        firsts = [F.min(F.when(F.col("kind") == k, who)).alias(f"k{k}") for k in (0, 1, 2)]
        met = sent.groupBy("key").agg(*firsts, F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").drop("a", "b")
        other = F.when(F.col("kind") == 0, F.col("k1")).when(F.col("kind") == 1, F.col("k0")).otherwise(F.col("k2"))
        pairs = sent.select("key", "kind", "h1").join(met, "key").withColumn("w", other).where("w is not null and w.h1 <> h1")
        near = scratch.write(pairs.groupBy("h1").agg(F.min(F.struct("w.o", "w.t", "w.no")).alias("with")), "met", n, 64)
        scratch.drop(sent)
        near = scratch.write(near.join(distinct, "h1").where(F.col("with") < F.col("earliest")).select("h1", "h2", *(F.col(f"earliest.{c}").alias(c) for c in ("o", "t", "no")), *(F.col(f"with.{c}").alias(f"w{c}") for c in ("o", "t", "no"))), "near", n, 64)
        places = near.select("o", "t", "no").unionByName(near.select(F.col("wo").alias("o"), F.col("wt").alias("t"), F.col("wno").alias("no"))).distinct()
        said = scratch.write(_texts(docs, places), "texts")
        other_side = said.select(F.col("o").alias("wo"), F.col("t").alias("wt"), F.col("no").alias("wno"), F.col("line").alias("wline"))
        sure = near.join(said, ["o", "t", "no"]).join(other_side, ["wo", "wt", "wno"]).where(within_one_edit(F.col("line"), F.col("wline"))).select("h1", "h2", F.lit(True).alias("near"))
        distinct = distinct.join(sure, ["h1", "h2"], "left")
    else:
        distinct = distinct.withColumn("near", F.lit(False))
    gone = lines.join(distinct, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (_place() != F.col("earliest")))
    gone = scratch.write(gone.groupBy("o", "t").agg(F.sort_array(F.collect_set(F.col("no").cast("long"))).alias("dropped")), "dropped", n, 40)
    scratch.drop(lines, *([near, said] if max_edits else []))
    return gone


def drop_lines(docs: DataFrame, max_edits: int = 1, least: int = LEAST_CHARS, text: str = "text") -> DataFrame:
    """docs with `text` less its duplicate lines; rows whose lines are all gone, or that hold no word beside them, are left out if
    they lost a line. All columns stay, null texts too. Texts stay where they lie while the list of dropped lines is small enough to
    be broadcast (it is counted); beyond, they are shuffled once, by id."""
    names = docs.columns
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn("__o", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("__t", F.xxhash64(t))
    gone = duplicate_lines(docs, max_edits, least, text).select(F.col("o").alias("__o"), F.col("t").alias("__t"), F.col("dropped").alias("__dropped"))
    size = gone.agg(F.sum(40 + 8 * F.size("__dropped"))).first()[0] or 0
    joined = keyed.join(F.broadcast(gone) if size <= common.BROADCAST_BYTES else gone, ["__o", "__t"], "left")
    parts = F.split(t, "\n")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), "__dropped")  # by hashing: linear in both
    rest = F.array_join(F.transform(stay, lambda k: F.get(parts, k.cast("int"))), "\n")
    left = joined.withColumn(text, F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(rest))
    return left.where(F.col("__dropped").isNull() | F.col(text).rlike("[^\\x20\\x09-\\x0D]")).select(*names)
