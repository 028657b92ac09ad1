"""MinHash near-duplicates by SetSketch registers.

Each text becomes the set of its word shingles, and the set a sketch: for each register the least of exponentially distributed
values of its elements, kept as a truncated power of a base. Sketches merge by maxima, and equal registers are as likely as the
sets are similar, so runs of registers (bands) serve as keys of candidates. A candidate pair is estimated from both sketches by
likelihood, and verified on the full sets of shingles.

Within the members of one key each member is held against one pivot first, the one that meets most others, and those that it does
not link against a second one. What is left in several components is held against members of other components by a prefix
filter on full sets: only pairs that share a rare element of both prefixes, or that have enough of the elements usual in
the group, can be linked. So a large group of copies costs a few pairs for each member, texts that only share a passage
cost none, and no link between components is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.common import SLICE_BYTES, Scratch, Spans, lower_ascii, mix, slices, words
from quirefold.llm.graph import components

#: Sizes of sets are put into buckets by powers of this, for joins on a range of sizes.
STEP = 1.05


@dataclass(frozen=True)
class Sketching:
    """shingle: words of a shingle; percent: least similarity; bands x rows registers. Two sets of similarity s share a key
    with probability 1 - (1 - s^rows)^bands: 0.99999 at 0.85 by default. base, rate and top are the sketch's b, a and q."""

    shingle: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    top: int = 65534

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def key(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(871).integers(0, 1 << 32, (2, self.registers), dtype=np.uint64).astype(np.uint32)
        return draw[0] | np.uint32(1), draw[1] | np.uint32(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's k-word shingles; of a shorter text its whole sequence."""
    buf = lower_ascii(buf)
    start, end, first = words(buf, off)
    h = Spans(buf).hash(start, end)
    n = len(h)
    parts = []
    for size in range(1, k + 1):
        total = np.zeros(max(n - size + 1, 0), np.uint64)
        for j in range(size):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(total)] + np.uint64(size))
        parts.append(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        size = min(k, b - a)
        if not size:
            out.append(h[:0])
            continue
        s = np.sort(parts[size - 1][a : b - size + 1])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def sketch(elements: np.ndarray, how: Sketching, key: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes. Sketches of parts of a set merge into that of the set by np.maximum."""
    low = np.full(how.registers, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(elements), 256):
        part = elements[k : k + 256]
        values = (part >> np.uint64(32)).astype(np.uint32)[:, None] * key[0] + part.astype(np.uint32)[:, None] * key[1]
        np.minimum(low, values.min(axis=0), out=low)
    least = -np.log1p(-(low.astype(float) + 0.5) / 4294967296.0) / how.rate
    return np.clip(np.floor(1 - np.log(least) / np.log(how.base)), 0, how.top + 1).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Similarity of each pair of sketches (rows of a and b) by maximum likelihood over the number of registers that are
    larger in a, larger in b, and equal, given the sets' sizes. A search by golden section: the likelihood has one peak."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, tiny))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    ratio = (5**0.5 - 1) / 2
    x, y = high - ratio * (high - low), low + ratio * (high - low)
    fx, fy = likelihood(x), likelihood(y)
    for _ in range(40):
        left = fx > fy
        low, high = np.where(left, low, x), np.where(left, y, high)
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        fx, fy = likelihood(x), likelihood(y)
    return (low + high) / 2


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return int(np.bitwise_xor.reduce(mix(elements)).view(np.int64)), int(np.add.reduce(mix(elements ^ np.uint64(0xA5A5A5A55A5A5A5A))).view(np.int64))


def _row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sketches(docs: DataFrame, how: Sketching, text: str = "text") -> DataFrame:
    """(doc_id, t, n_shingles, f1, f2, registers): t is a hash of the text; f1 and f2 are a 128-bit fingerprint of the set, null for an empty set."""
    key = how.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("sketches")
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(2), SLICE_BYTES // 2):
                sets = shingle_sets(buf, off, how.shingle)
                prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
                regs = [sketch(s, how, key).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "t", "n_shingles", "f1", "f2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(text).alias("t"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, t long, n_shingles long, f1 long, f2 long, registers binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, how: Sketching, text: str) -> DataFrame:
    """(id, set): the full set, as sorted 64-bit hashes, of each class of wanted (id, f1, f2, doc_id and t of one of its texts)."""
    ids = wanted.select("doc_id", "t")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(text).alias("t"), F.col(text).cast("string").alias("text"))
    chosen = own.join(F.broadcast(ids) if common.small(ids, 16) else ids, ["doc_id", "t"], "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("sketches")
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0), SLICE_BYTES // 2):
                sets = [x for x in shingle_sets(buf, off, how.shingle) if len(x)]
                prints = [fingerprint(x) for x in sets]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["f1", "f2", "set"])

    found = chosen.mapInArrow(run, "f1 long, f2 long, set array<long>")
    return found.join(wanted.select("id", "f1", "f2"), ["f1", "f2"]).select("id", "set").dropDuplicates(["id"])


def _estimated(pairs: DataFrame, registers: DataFrame, how: Sketching) -> DataFrame:
    """pairs (a, b, ...) with the likelihood estimate of their similarity."""
    for side in "ab":
        pairs = pairs.join(registers.select(F.col("id").alias(side), F.col("registers").alias(f"r{side}"), F.col("n").alias(f"n{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("sketches")
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in (2, 3))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joint_estimate(ra, rb, na, nb, how.base))], names=["a", "b", "estimate"])

    return pairs.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long, estimate double")


def _linked(pairs: DataFrame, sets: DataFrame, how: Sketching) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, by the sizes of intersection and union."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("set").alias(f"s{side}")), side)
    sized = pairs.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("both"))
    return sized.where(100 * F.col("common") >= how.percent * (F.col("both") - F.col("common"))).select("a", "b")


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP)))


def _prefixes(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """around (m, g, id, component, n, own) with c, the number of usual elements of the member, k, the least number of other ones
    that it shares with whatever it is linked to, and prefix, the other elements of which one at least is shared then.

    An element is usual if more than half of the group's own members have it. Two sets have in common, of the usual ones, no
    more than the one that has fewer has; at percent t a set of n elements shares t * n at least, so t * n - c are not usual.
    All sets put their unusual elements in one order, rare ones first; of those they share the first one has k - 1 after it, so it
    isn't among the last k - 1. Elements that only one member has are never shared and are left out.
    """
    own = F.sum(F.col("own").cast("int"))
    members = around.groupBy("g").agg(own.cast("int").alias("members"))
    held = around.join(members, "g").join(sets, "id")
    rows = held.select("m", "own", "members", "g", F.explode("set").alias("e")).select("m", "own", "members", F.xxhash64("g", "e").alias("e"))
    marks = rows.groupBy("e").agg(F.count("*").alias("df"), (2 * own > F.max("members")).alias("usual")).where("df > 1")
    marked = rows.select("m", "e").join(marks, "e")
    parts = marked.groupBy("m").agg(F.sum(F.col("usual").cast("long")).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("usual"), F.struct("df", "e")))).alias("rest"))
    found = around.join(parts, "m", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    found = found.withColumn("k", F.ceil(F.lit(percent) * F.col("n") / 100) - F.col("c"))
    size = F.size(F.coalesce("rest", F.array().cast("array<struct<df:bigint,e:bigint>>")))
    least = F.greatest(size - F.greatest("k", F.lit(1)) + 1, F.lit(0)).cast("int")
    return found.withColumn("prefix", F.when(size > 0, F.transform(F.slice("rest", F.lit(1), least), lambda x: x["e"]))).drop("rest")


def _possible(marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a group that are of different components and can reach the least similarity: those that share an
    element of both prefixes, and those that have enough usual elements without any other. One at least is outside the
    group's own component, so the own members never meet each other.
    """
    columns = ("m", "id", "component", "n", "c")
    side = lambda rows, s, *more: rows.select(*more, *(F.col(c).alias(f"{c}_{s}") for c in columns), *([F.col("own").alias("own_b")] if s == "b" else []))
    na, nb = F.col("n_a"), F.col("n_b")
    fit = (F.col("component_a") != F.col("component_b")) & (F.col("own_b") | (F.col("m_a") < F.col("m_b"))) & (100 * na >= percent * nb) & (100 * nb >= percent * na)
    posted = marked.withColumn("e", F.explode("prefix"))
    sharing = side(posted.where("not own"), "a", "e").join(side(posted, "b", "e"), "e").where(fit)

    close = marked.where("k <= 0")
    low, high = F.ceil(F.lit(percent) * F.col("n") / 100), F.floor((F.col("c") * (100 + percent) - percent * F.col("n")) / percent)
    ranged = close.where(~F.col("own") & (high >= low)).withColumn("size", F.explode(F.sequence(_bucket(low), _bucket(high))))
    enough = (100 + percent) * F.least("c_a", "c_b") >= percent * (na + nb)
    usual = side(ranged, "a", "g", "size").join(side(close.withColumn("size", _bucket(F.col("n"))), "b", "g", "size"), ["g", "size"]).where(fit & enough)
    found = sharing.select("id_a", "id_b").unionByName(usual.select("id_a", "id_b"))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _classes(sketched: DataFrame) -> DataFrame:
    """(id, f1, f2, doc_id, t, n, registers): each distinct set with the first of its rows. id is a 64-bit hash of the fingerprint; of sets
    whose hashes meet (some three at 10^10 sets) each takes another."""
    rows = sketched.where("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.max("n_shingles").alias("n"), F.first("registers").alias("registers"))
    return rows.select(F.xxhash64("f1", "f2").alias("id"), "f1", "f2", "first.doc_id", "first.t", "n", "registers")


def _named_apart(classes: DataFrame) -> DataFrame:
    twins = classes.groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1")
    return classes.join(twins, "id", "left").withColumn("id", F.when(F.col("__n").isNull(), F.col("id")).otherwise(F.xxhash64("f2", "f1", "id"))).drop("__n")


def near_duplicates(docs: DataFrame, how: Sketching = Sketching(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles (long), component_id (smallest doc_id reachable over links, itself included), kept (doc_id = component_id), t
    (a 64-bit hash of the text) and chosen: whether the row is the one that stands for its component, the least by doc_id and t.

    Words are lower-cased in A-Z. Null, empty and wordless texts have an empty set and no link: each is its own component and
    chosen. Texts of equal sets are one class from the start, known by a 128-bit fingerprint; of rows that share a doc_id each has
    the component of its own set; rows equal in doc_id and text are chosen alike; a row whose doc_id is null is returned with a
    null component, kept and chosen. Other columns are not read, an empty table gives an empty one. Links are found up to the
    chance given at Sketching; each is exact.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sketched = scratch.write(sketches(docs, how, text), "sketches")
    n = sketched.count()
    classes = scratch.write(_classes(sketched), "classes", n, 64 + 2 * how.registers)
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        classes = scratch.write(_named_apart(classes), "classes", n, 64 + 2 * how.registers)
    width = 2 * how.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), lambda j: F.xxhash64(j, F.substring(F.col("registers"), j * F.lit(width) + F.lit(1), F.lit(width))))
    keyed = classes.select("id", F.explode(bands).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key", "n")
    members = scratch.write(keyed.join(shared, "key"), "members", n * how.bands, 24)  # keys with two classes at least
    # The pivot is the member that meets most others over all its keys: of copies of one text, the text they were made from.
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    most = members.count()
    weighed = scratch.write(members.select("key", "id").join(met, "id"), "weighed", most, 24)
    scratch.drop(members)
    registers = classes.select("id", "registers", "n")
    wanted = classes.join(weighed.select("id").distinct(), "id", "left_semi").select("id", "f1", "f2", "doc_id", "t")
    sets = scratch.write(_sets_of(docs, wanted, how, text), "sets")
    sure = how.percent / 100 - 0.2  # beyond four standard errors of the estimate below the least similarity

    def links_among(pairs: DataFrame, rows: int | None = None) -> DataFrame:
        likely = scratch.write(_estimated(pairs, registers, how).where(F.col("estimate") >= sure).select("a", "b"), "pairs", rows, 2 * how.registers)
        found = scratch.write(_linked(likely, sets, how), "links", likely.count(), 4096)
        scratch.drop(likely)
        return found

    top = F.max(F.struct("met", "id"))["id"]
    pivots = weighed.groupBy("key").agg(top.alias("pivot"))
    first = weighed.join(pivots, "key").where("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    found = components(links_among(first, most), scratch)

    def split_members(found: DataFrame) -> DataFrame:
        """The members, with their components, of the keys whose members are of several; home is that of the pivot."""
        comp = weighed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        by_key = comp.groupBy("key").agg(F.max_by("component", F.struct("met", "id")).alias("home"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return comp.join(by_key.select("key", "home"), "key")

    def merged(more: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)

    open_ = scratch.write(split_members(found), "open", most, 48)
    second = open_.where("component <> home").groupBy("key").agg(F.max(F.struct("met", "id", "component")).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.component").alias("of"))
    again = open_.join(second, "key").where("component <> of and component <> home").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    more = links_among(again, most)
    if not more.isEmpty():
        found = merged(more)
    scratch.drop(open_)
    around = split_members(found).select(F.col("home").alias("g"), "id", "component").distinct().join(classes.select("id", "n"), "id")
    around = scratch.write(around.select(F.xxhash64("g", "id").alias("m"), "g", "id", "component", "n", (F.col("component") == F.col("g")).alias("own")), "around", most, 48)
    marked = scratch.write(_prefixes(around, sets, how.percent), "prefixes", around.count(), 4096)
    more = links_among(_possible(marked, how.percent))
    if not more.isEmpty():
        found = merged(more)
    of_class = classes.select("id", "f1", "f2", "doc_id", "t").join(found.withColumnRenamed("node", "id"), "id")
    least = of_class.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("least"))
    single = classes.join(found.select(F.col("node").alias("id")), "id", "left_anti").select("f1", "f2", F.struct("doc_id", "t").alias("least"))
    known = scratch.write(of_class.join(least, "component").select("f1", "f2", "least").unionByName(single), "known", n, 40)
    scratch.drop(classes, weighed, sets, around, marked)
    out = sketched.select("doc_id", "t", "n_shingles", "f1", "f2").join(known, ["f1", "f2"], "left")
    alone = F.col("doc_id").isNull() | F.col("least").isNull()
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least.doc_id", "doc_id"))
    chosen = alone | ((F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.t") == F.col("t")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "t", chosen.alias("chosen"))
