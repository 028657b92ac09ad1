"""Exact Jaccard join of word n-gram sets by an inverted index and by relations between sets.

Elements have one order for all sets, those of crowded hash buckets last, so that what many texts share stands behind. A set is indexed
under its prefix: two sets that are similar enough share an element of both prefixes, and at the first such element few places
lie before it in both. An index list is cut into blocks of like sizes, each with its first position: a set skips the blocks whose
sizes or positions can't answer it, and leaves lists of which nothing is left.

Answers follow from those of similar sets. In a long list one set, the one that meets most others, is held against the rest; what is left
in several components is then known by its difference to that set. For differences d the sets y and z have
|y ^ z| = |dy| + |dz| - 2 |dy & dz|, so y's answers come from those of the set beside it: one champion of the group answers at once all
whose differences are small enough to need nothing in common, and others must share an element of both differences' prefixes. No
set is read again, and a group of copies costs a few pairs for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common
from quirefold.llm.common import SLICE_BYTES, Scratch, mix, slices
from quirefold.llm.graph import components
from quirefold.llm.neardup import _linked, _row_hash, _sets_of, fingerprint, shingle_sets

#: Hash buckets in which elements are counted for their order: a table of four bytes each goes to every worker, whatever the input.
BUCKETS = 1 << 22
#: Buckets of a row of that table.
BUCKET_ROW = 1 << 12
#: Elements that a task gathers before it counts them.
GATHERED = 1 << 21
#: Parts of the hash range in which a set's elements are counted, for a bound on the difference of two sets.
PROFILE = 64
#: Members up to which all pairs of a list are looked at; a longer list goes by its leading set.
SHORT_LIST = 8
#: Fingerprints that a task remembers, so as to index copies once.
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class Joining:
    """shingle: words of an element; percent: least similarity, from 1 to 99."""

    shingle: int = 5
    percent: int = 80

    def __post_init__(self):
        if not 1 <= self.percent <= 99:
            raise ValueError("percent is from 1 to 99")


def bucket_of(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ np.uint64(0x5DEECE66D1234567)) % np.uint64(BUCKETS)).astype(np.int64)


def profile(elements: np.ndarray) -> np.ndarray:
    """How many elements lie in each part of the hash range, at most 65535: the sum of what two profiles differ by is no more than
    what their sets differ by."""
    return np.minimum(np.bincount((elements >> np.uint64(58)).astype(np.int64), minlength=PROFILE), 65535).astype("<u2")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


SKETCHED = "doc_id long, t long, n_shingles long, f1 long, f2 long, profile binary, row int, counts binary"


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("setjoin")
        total = np.zeros(BUCKETS, np.int64)
        held: list[np.ndarray] = []
        size = 0
        names = [f.split(" ")[0] for f in SKETCHED.split(", ")]

        def counted() -> None:
            nonlocal size, total
            if held:
                total += np.bincount(bucket_of(np.concatenate(held)), minlength=BUCKETS)
            held.clear()
            size = 0

        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(2), SLICE_BYTES // 2):
                sets = shingle_sets(buf, off, k)
                held += sets
                size += sum(map(len, sets))
                if size > GATHERED:
                    counted()
                prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
                n = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.array([profile(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        counted()
        rows = np.minimum(total, (1 << 32) - 1).astype("<u4").reshape(-1, BUCKET_ROW)
        some = np.flatnonzero(rows.any(1))
        for part in np.array_split(some, max(1, len(some) // 64)):
            if len(part):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), pa.int64()) for _ in range(5)), pa.nulls(len(part), pa.binary()), pa.array(part, pa.int32()), pa.array([rows[r].tobytes() for r in part], pa.binary())], names=names)

    return run


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of counts of equal number, which arrive sorted."""
    common.only("setjoin")
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], names=["row", "counts"])

    for batch in batches:
        for r, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if r != now:
                if now is not None:
                    yield row()
                now, total = r, np.zeros(BUCKET_ROW, np.int64)
            total += np.frombuffer(counts, "<u4")
    if now is not None:
        yield row()


def crowding(sketched: DataFrame) -> np.ndarray:
    """How many elements of all sets lie in each bucket: BUCKETS numbers of four bytes, on the driver."""
    rows = sketched.where("row is not null").select("row", "counts").repartition("row").sortWithinPartitions("row").mapInArrow(_added_up, "row int, counts binary")
    table = np.zeros((BUCKETS // BUCKET_ROW, BUCKET_ROW), np.uint32)
    for r in rows.collect():
        table[r["row"]] = np.frombuffer(r["counts"], "<u4")
    return table.reshape(-1)


def _postings(docs: DataFrame, how: Joining, text: str, crowded) -> DataFrame:
    """(token, id, n, pos): the prefix of each text's set; a task leaves out copies that it has just met. crowded: a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("setjoin")
        table = crowded.value
        met: set[int] = set()
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0), SLICE_BYTES // 2):
                tokens, places, prints, sizes = [], [], [], []
                for s in shingle_sets(buf, off, how.shingle):
                    if not len(s):
                        continue
                    f = fingerprint(s)
                    if f[0] in met:
                        continue
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met.add(f[0])
                    k = prefix_length(len(s), how.percent)
                    tokens.append(s[np.lexsort((s, table[bucket_of(s)]))[:k]].view(np.int64))
                    places.append(np.arange(k, dtype=np.int32))
                    prints.append(np.repeat(np.array([f], np.int64), k, 0))
                    sizes.append(np.full(k, len(s), np.int32))
                if tokens:
                    both = np.concatenate(prints)
                    whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "f1", "f2", "n", "pos"])
                    for at in range(0, whole.num_rows, 1 << 15):
                        yield whole.slice(at, 1 << 15)

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, f1 long, f2 long, n int, pos int")
    return found


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return (100 * na >= percent * nb) & (100 * nb >= percent * na)


def _apart(both: Column, percent: int) -> Column:
    """The most elements by which two sets of `both` elements together may differ."""
    return F.floor((100 - percent) * both / (100 + percent))


def _members(postings: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, pos): the postings of lists in which some block, of other sets, is not skipped: one whose sizes fit, and whose first
    position leaves room for enough elements behind. Lists are cut into blocks by powers of the least ratio of sizes."""
    step = max(np.log(100 / percent), 0.01)
    dealt = postings.withColumn("b", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")).repartition("token")
    blocks = dealt.groupBy("token", "b").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("p"), F.min("id").alias("x"), F.max("id").alias("y"))
    lists = blocks.groupBy("token").agg(F.collect_list(F.struct("b", "lo", "hi", "p", (F.col("x") == F.col("y")).alias("one"))).alias("blocks"), F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").drop("x", "y")
    n, pos = F.col("n").cast("long"), F.col("pos")

    def answers(block: Column) -> Column:
        room = _apart(n + F.least(block["hi"].cast("long"), F.floor(100 * n / percent)), percent)
        return ~((block["b"] == F.col("b")) & block["one"]) & (100 * n >= percent * block["lo"]) & (100 * block["hi"].cast("long") >= percent * n) & (pos + block["p"] <= room)

    return dealt.join(lists, "token").where(F.exists("blocks", answers)).select("token", "id", "n", "pos").distinct()


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _may(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles don't rule out that they are linked."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("profile").alias(f"p{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("setjoin")
        for batch in batches:
            if batch.num_rows:
                pa_, pb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, PROFILE).astype(np.int32) for c in (4, 5))
                both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                near = (100 - percent) * both >= (100 + percent) * np.abs(pa_ - pb).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _differences(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """around (g, id, component, n, own) with d, the elements that the set of g has and the member has not or the other way round, and w:
    two members whose w add up to 0 or more are linked whatever their differences have in common."""
    both = around.join(sets.select(F.col("id").alias("g"), F.col("set").alias("x")), "g").join(sets.withColumnRenamed("set", "y"), "id")
    with_d = both.withColumn("d", F.concat(F.array_except("x", "y"), F.array_except("y", "x"))).drop("x", "y")
    return with_d.withColumn("w", (100 - percent) * F.col("n") - (100 + percent) * F.size("d").cast("long"))


def _derived(known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From differences (g, id, component, n, own, d, w): links (a, b) to each group's champion, and pairs (g, a, b) of different components
    whose differences share an element of both prefixes.

    |dy & dz| of a linked pair is at least (|dy| + |dz| - most) / 2 and |dz| at least |dy| - most, where `most` is what they may differ by;
    so dy shares |dy| - most elements at least, one of them not among its last ones in any order. Elements of one member only are never
    shared and left out; of the others those of few members come first, and the first shared one has enough behind it in both. A pair within the component of g isn't looked for.
    """
    top = known.groupBy("g").agg(F.max(F.struct("w", "id")).alias("top"))
    sure = known.select("g", "id", "w").join(top, "g").where("id <> top.id and w + top.w >= 0").select(*_pair(F.col("id"), F.col("top.id")))

    rows = known.select("g", "id", F.explode("d").alias("e"))
    shared = rows.groupBy("g", "e").agg(F.count("*").alias("df")).where("df > 1")
    parts = rows.join(shared, ["g", "e"]).groupBy("g", "id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("rest"))
    most = _apart(F.col("n") + F.floor(100 * F.col("n") / percent), percent)
    least = F.greatest(F.size("d") - most, F.lit(1))
    marked = known.join(parts, ["g", "id"]).withColumn("k", F.greatest(F.size("rest") - least + 1, F.lit(0)).cast("int"))
    early = F.transform(F.slice("rest", F.lit(1), F.col("k")), lambda x: x["e"])
    posted = marked.where("k > 0").select("g", "id", "component", "own", "n", F.size("d").alias("size"), F.size("rest").alias("left"), F.posexplode(early).alias("pos", "e")).withColumn("left", F.col("left") - F.col("pos"))
    a, b = (posted.select("g", "e", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "own", "n", "size", "left"))) for s in "ab")
    fit = (F.col("component_a") != F.col("component_b")) & (F.col("own_b") | (F.col("id_a") < F.col("id_b"))) & _fits(F.col("n_a"), F.col("n_b"), percent)
    room = 2 * F.least("left_a", "left_b") >= F.col("size_a") + F.col("size_b") - _apart(F.col("n_a") + F.col("n_b"), percent)
    pairs = a.where("not own_a").join(b, ["g", "e"]).where(fit & room).select("g", *_pair(F.col("id_a"), F.col("id_b"))).distinct()
    return sure, pairs


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (g, a, b) that are linked, by their differences to g."""
    for side in "ab":
        pairs = pairs.join(known.select("g", F.col("id").alias(side), F.col("d").alias(f"d{side}"), F.col("n").alias(f"n{side}")), ["g", side])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return pairs.where((100 - percent) * (F.col("na") + F.col("nb")) >= (100 + percent) * apart.cast("long")).select("a", "b")


def jaccard_components(docs: DataFrame, how: Joining = Joining(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id: the smallest doc_id that links reach, itself included. Links are all pairs with
    100 * |intersection| >= percent * |union|; none between different components is lost, whatever the order of elements.

    Words are lower-cased in A-Z; a text of fewer words than a shingle has its whole sequence as its one element. Null, empty and wordless
    texts have an empty set and no link. Texts of equal sets are one class from the start, known by a 128-bit fingerprint; elements are
    equal if their 64-bit hashes are. Rows that share a doc_id each have the component of their own set; a null doc_id has a null
    component and links nothing. Other columns are not read; an empty table gives an empty one.
    """
    spark, p = docs.sparkSession, how.percent
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(text).alias("t"), F.col(text).cast("string").alias("text"))
    sketched = scratch.write(rows.mapInArrow(_sketched(how.shingle), SKETCHED), "sketches")
    of_rows = sketched.where("row is null").select("doc_id", "t", "n_shingles", "f1", "f2")
    first = sketched.where("row is null and f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.max("n_shingles").alias("n"), F.first("profile").alias("profile"))
    classes = scratch.write(first.select(F.xxhash64("f1", "f2").alias("id"), "f1", "f2", "first.doc_id", "first.t", "n", "profile"), "classes")
    twins = classes.groupBy("id").agg(F.count("*").alias("twins")).where("twins > 1")
    meet = not twins.isEmpty()  # of sets whose ids meet (some three at 10^10 sets) each takes another
    if meet:
        classes = scratch.write(classes.join(twins, "id", "left").withColumn("id", F.when(F.col("twins").isNull(), F.col("id")).otherwise(F.xxhash64("f2", "f1", "id"))).drop("twins"), "classes")

    crowded = spark.sparkContext.broadcast(crowding(sketched))
    postings = _postings(docs.where("doc_id is not null"), how, text, crowded)
    postings = postings.join(classes.select("id", "f1", "f2"), ["f1", "f2"]) if meet else postings.withColumn("id", F.xxhash64("f1", "f2"))
    members = scratch.write(_members(postings.select("token", "id", "n", "pos"), p), "members")
    crowded.destroy()
    sizes = members.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    sized = members.join(sizes, "token")

    side = lambda rows, s: rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos")))
    n, pos = (F.col("n_a").cast("long"), F.col("n_b").cast("long")), (F.col("pos_a"), F.col("pos_b"))
    meets = _fits(*n, p) & (pos[0] + pos[1] <= _apart(n[0] + n[1], p))
    short = sized.where(F.col("c") <= SHORT_LIST)
    near = side(short, "a").join(side(short, "b"), "token").where((F.col("id_a") < F.col("id_b")) & meets).select(*_pair(F.col("id_a"), F.col("id_b")))
    long_ = sized.where(F.col("c") > SHORT_LIST)
    met = long_.groupBy("id").agg(F.sum("c").alias("met"))
    weighed = scratch.write(long_.join(met, "id").select("token", "id", "n", "pos", "met"), "lists")
    leads = weighed.groupBy("token").agg(F.max(F.struct("met", "id", "n", "pos")).alias("lead")).select("token", F.col("lead.id").alias("id_b"), F.col("lead.n").alias("n_b"), F.col("lead.pos").alias("pos_b"))
    by_lead = side(weighed, "a").join(leads, "token").where((F.col("id_a") != F.col("id_b")) & meets).select(*_pair(F.col("id_a"), F.col("id_b")))
    likely = scratch.write(_may(near.unionByName(by_lead).distinct(), classes, p), "pairs")
    scratch.drop(members)

    named = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(weighed.select("id")).distinct()
    sets = scratch.write(_sets_of(docs, classes.join(named, "id", "left_semi").select("id", "f1", "f2", "doc_id", "t"), how, text), "sets")
    found = components(scratch.write(_linked(likely, sets, how), "links"), scratch)
    scratch.drop(likely)

    def open_lists(found: DataFrame) -> DataFrame:
        """Members of the long lists that lie in several components; home is that of the leading set."""
        comp = weighed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        by = comp.groupBy("token").agg(F.max_by("component", F.struct("met", "id")).alias("home"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return comp.join(by.select("token", "home"), "token")

    def merged(found: DataFrame, more: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)

    open_ = scratch.write(open_lists(found), "open")
    second = open_.where("component <> home").groupBy("token").agg(F.max(F.struct("met", "id", "component", "n")).alias("lead")).select("token", F.col("lead.id").alias("lead"), F.col("lead.component").alias("of"), F.col("lead.n").alias("m"))
    again = open_.join(second, "token").where((F.col("component") != F.col("of")) & (F.col("component") != F.col("home")) & _fits(F.col("n").cast("long"), F.col("m").cast("long"), p))
    more = scratch.write(_linked(_may(again.select(*_pair(F.col("id"), F.col("lead"))).distinct(), classes, p), sets, how), "links")
    if not more.isEmpty():
        found = merged(found, more)
    scratch.drop(open_)
    around = open_lists(found).select(F.col("home").alias("g"), "id", "component", F.col("n").cast("long").alias("n")).distinct().withColumn("own", F.col("component") == F.col("g"))
    known = scratch.write(_differences(around, sets, p), "differences")
    sure, pairs = _derived(known, p)
    more = scratch.write(sure.unionByName(_confirmed(pairs, known, p)).distinct(), "links")
    if not more.isEmpty():
        found = merged(found, more)

    of_class = classes.select("id", "f1", "f2", "doc_id").join(found.withColumnRenamed("node", "id"), "id")
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("least"))
    single = classes.join(found.select(F.col("node").alias("id")), "id", "left_anti").select("f1", "f2", F.col("doc_id").alias("least"))
    answers = scratch.write(of_class.join(least, "component").select("f1", "f2", "least").unionByName(single), "answers")
    scratch.drop(classes, weighed, sets, known)
    out = of_rows.join(answers, ["f1", "f2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
