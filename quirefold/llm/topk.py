"""Exact top-k search by inner product with a dual traversal of cover trees.

Vectors and queries are indexed alike. Each row goes to the nearest of a few pivots, rows of one pivot are packed into blocks, and each
block gets a cover tree whose nodes hold a centre, a covering radius and the greatest norm of the points below. A first pass holds
each block of queries against one block of vectors of its own pivot, which gives each query a score that its k-th best can't be
below. The second pass visits all blocks with these scores, and passes over a pair of nodes (queries, vectors) when no inner product
between the two balls can reach the worst k-th score that the queries of the group have so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import Scratch, only

#: Rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Rows of a leaf of a tree of vectors and of one of queries: a group of queries has one bound, so its groups are small.
LEAF, QUERY_LEAF = 64, 8
#: Pivots: the rows with the smallest hashes of their ids. They only decide which rows share a block, never a result.
PIVOTS = 64
#: Bytes of query blocks that are broadcast at once; more queries take more passes.
PASS_BYTES = 32 << 20
#: A node that would need more children than this stays a leaf: its points are too far apart for a cover.
MOST_CHILDREN = 64
#: Sums beyond this are not whole numbers any more in floating point; they are made in 64-bit integers then.
EXACT = 1 << 53


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray  # of the block
    top: float  # greatest norm of a point below
    children: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self.norm = float(np.sqrt(self.centre @ self.centre))


def cover_tree(x: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """Each child's centre is a point of its parent; no two centres below one node are nearer than half the node's radius, each point is within
    that of its child's centre and belongs to the nearest; radius is the farthest of all points below."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    away = np.sqrt(((x[rows] - x[centre]) ** 2).sum(1))
    top = float(away.max())
    node = Node(x[centre], top * (1 + 1e-12), rows, float(np.sqrt((x[rows] ** 2).sum(1).max())))
    if len(rows) <= leaf or top == 0:
        return node
    nearest, owner, centres = away.copy(), np.zeros(len(rows), int), [centre]
    while nearest.max() > top / 2:
        if len(centres) == MOST_CHILDREN:
            return node
        far = int(np.argmax(nearest))
        d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(1))
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centres)
        centres.append(int(rows[far]))
    node.children = [cover_tree(x, leaf, rows[owner == k], c) for k, c in enumerate(centres) if (owner == k).any()]
    return node


def reach(a: Node, b: Node) -> float:
    """No inner product of a point below a and one below b is greater: the least of two bounds, from the centres' inner product, and
    from the greatest norms and the least distance (2 q.x = |q|^2 + |x|^2 - |q - x|^2)."""
    inner = float(a.centre @ b.centre)
    apart = max(0.0, float(np.sqrt(max(0.0, a.norm**2 + b.norm**2 - 2 * inner))) * (1 - 1e-9) - a.radius - b.radius)
    return min(inner + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius, (a.top**2 + b.top**2 - apart**2) / 2)


class Best:
    """The k best (score, smaller id first) of each query of a block, of scores that are not below the query's floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.scored = k, floor, 0
        self.scores = np.full((len(floor), k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((len(floor), k), np.iinfo(np.int64).max, np.int64)
        self.least = floor.copy()

    def worst(self, rows: np.ndarray) -> int:
        return int(self.least[rows].min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += scores.size
        low = self.least[rows]
        some = (scores >= low[:, None]).any(0)
        scores, ids = scores[:, some], ids[some]
        if not len(ids):
            return
        s = np.concatenate([self.scores[rows], np.where(scores >= low[:, None], scores, np.iinfo(np.int64).min)], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        by = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises and can't overflow
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        self.least[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])


class Block:
    """Rows of whole numbers with their ids, as floats for bounds, and a cover tree over them."""

    def __init__(self, ids: bytes, data: bytes, kind: str, dim: int, leaf: int = LEAF):
        self.whole = np.frombuffer(data, kind).reshape(-1, dim)
        self.ids = np.frombuffer(ids, "<i8")
        self.x = self.whole.astype(float)
        self.tree = cover_tree(self.x, leaf)
        self.most = float(np.abs(self.x).max(initial=0))


def search(queries: Block, vectors: Block, best: Best) -> None:
    """Visit the pairs of nodes, the most promising first; a query is no candidate of itself. Scores are exact; raises where one
    could leave 64 bits."""
    size = queries.most * vectors.most * queries.x.shape[1]
    if size >= 1 << 62:
        raise ValueError("inner products beyond 62 bits")
    exact = size < EXACT
    q, x = (queries.x, vectors.x) if exact else (queries.whole.astype(np.int64), vectors.whole.astype(np.int64))
    count = 0
    heap = [(-reach(queries.tree, vectors.tree), 0, queries.tree, vectors.tree)]
    while heap:
        upper, _, a, b = heapq.heappop(heap)
        if -upper + 1e-6 * (1 + abs(upper)) < best.worst(a.rows):
            continue
        if not a.children and not b.children:
            scores = (q[a.rows] @ x[b.rows].T).astype(np.int64)
            own = queries.ids[a.rows][:, None] == vectors.ids[b.rows][None]
            best.add(a.rows, np.where(own, np.iinfo(np.int64).min, scores) if own.any() else scores, vectors.ids[b.rows])
            continue
        pairs = [(c, b) for c in a.children] if a.children and (not b.children or a.radius > b.radius) else [(a, c) for c in b.children]
        for c, d in pairs:
            count += 1
            heapq.heappush(heap, (-reach(c, d), count, c, d))


def whole_numbers(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(F.col(column), lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))


def _routed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, v) with dim and cell, the nearest pivot of the row's dimension (0 where there is none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("topk")
        for batch in batches:
            batch["dim"] = batch["v"].map(len).astype("int32")
            batch["cell"] = np.int32(0)
            for dim, some in batch.groupby("dim"):
                if (p := pivots.get(dim)) is not None:
                    x = np.stack(some["v"].to_list()).astype(float)
                    batch.loc[some.index, "cell"] = np.argmin((p**2).sum(1)[None] - 2 * (x @ p.T), axis=1).astype("int32")
            yield batch[["id", "v", "dim", "cell"]]

    return rows.select("id", "v").mapInPandas(run, "id long, v array<long>, dim int, cell int")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, dim, cell, kind, ids, data): rows of one cell and dimension, at most `size` to a block, in the narrowest integers that hold
    them. Cells are dealt out by their counted rows, so a cell of any size is packed by many tasks."""
    counts = rows.groupBy("dim", "cell").agg(F.count("*").alias("rows"))
    parts = F.greatest(F.ceil(F.col("rows") / (16 * size)), F.lit(1)).cast("long")
    dealt = rows.join(counts.select("dim", "cell", parts.alias("parts")), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.select("dim", "cell", "part", "id", "v").repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("topk")
        held: list[tuple] = []
        key: tuple | None = None

        def packed() -> pd.DataFrame:
            ids = np.array([p[0] for p in held], "<i8")
            data = np.stack([p[1] for p in held]).astype("<i8")
            most = int(np.abs(data).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            out = pd.DataFrame({"block": [int(ids[0])], "dim": [np.int32(key[0])], "cell": [np.int32(key[1])], "kind": [kind], "ids": [ids.tobytes()], "data": [data.astype(kind).tobytes()]})
            held.clear()
            return out

        for batch in batches:
            for row in batch.itertuples(index=False):
                now = (row.dim, row.cell, row.part)
                if held and (now != key or len(held) == size):
                    yield packed()
                key = now
                held.append((row.id, row.v))
        if held:
            yield packed()

    return dealt.mapInPandas(run, "block long, dim int, cell int, kind string, ids binary, data binary")


HITS = "query_id long, vec_id long, score long"


def _floors(best: Best) -> np.ndarray:
    """The k-th score of each query so far; the least number where it has fewer."""
    return best.scores[:, -1]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank from 1, vec_id, score: long) of the k highest integer inner products of each query with all vectors but
    those of its own id; ties go to the smaller id.

    vectors and queries: (id long, v array<long>). Rows with a null id take no part; vectors of another dimension than the
    query's are no candidates; rows that share an id are candidates each, as a query the least of them counts. Scores are exact;
    where one could leave 62 bits the job raises. Vectors are shuffled once, into blocks that are stored; blocks of queries are
    broadcast, at most PASS_BYTES for one pass over the vectors' blocks. Passes run one after the other when top_k is called: each stores
    what it found and its broadcast goes before the next begins, so driver and tasks hold one pass at a time, and the plan of the result
    is one scan, however many queries there are. Each task hands on k rows for each query at most, none below the query's floor of
    the first pass.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    sound = vectors.where("id is not null and size(v) > 0").select("id", "v")
    pivots: dict[int, list] = {}
    for row in sound.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        pivots.setdefault(len(row["v"]), []).append(row["v"])
    places = {dim: np.array(rows, float) for dim, rows in pivots.items()}
    data = scratch.write(_blocks(_routed(sound, places), BLOCK_ROWS), "vectors")
    once = queries.where("id is not null and size(v) > 0").groupBy("id").agg(F.min("v").alias("v"))
    asked = scratch.write(_blocks(_routed(once, places), QUERY_ROWS), "queries")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("topk")
        for batch in batches:
            for row in batch.itertuples(index=False):
                q, x = Block(row.ids, row.data, row.kind, row.dim, QUERY_LEAF), Block(row.x_ids, row.x_data, row.x_kind, row.dim)
                best = Best(np.full(len(q.ids), np.iinfo(np.int64).min), k)
                search(q, x, best)
                yield pd.DataFrame({"block": [row.block], "dim": [np.int32(row.dim)], "floor": [_floors(best).astype("<i8").tobytes()]})

    near = data.groupBy("dim", "cell").agg(F.min("block").alias("block")).join(data, ["dim", "cell", "block"])
    near = near.select("dim", "cell", F.col("ids").alias("x_ids"), F.col("data").alias("x_data"), F.col("kind").alias("x_kind"))
    floors = scratch.write(asked.join(near, ["dim", "cell"]).mapInPandas(first, "block long, dim int, floor binary"), "floors")
    total = asked.agg(F.sum(F.length("data") + 16 * F.length("ids") / 8), F.max(F.length("data") + 2 * F.length("ids"))).first()
    passes = max(1, -(-int(total[0] or 0) // max(PASS_BYTES - (total[1] or 0), 1)))

    paths = []
    for p in range(passes):
        chunk = asked.where(F.pmod(F.xxhash64("block", "dim"), F.lit(passes)) == p)
        sent = spark.sparkContext.broadcast([tuple(r) for r in chunk.join(floors, ["block", "dim"], "left").select("dim", "kind", "ids", "data", "floor").collect()])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            only("topk")
            asked_here: list[tuple[int, Block, Best]] = []
            for dim, kind, ids, data, floor in sent.value:
                q = Block(ids, data, kind, dim, QUERY_LEAF)
                low = np.frombuffer(floor, "<i8").copy() if floor is not None else np.full(len(q.ids), np.iinfo(np.int64).min)
                asked_here.append((dim, q, Best(low, k)))
            for batch in batches:
                for row in batch.itertuples(index=False):
                    x = Block(row.ids, row.data, row.kind, row.dim)
                    for dim, q, best in asked_here:
                        if dim == row.dim:
                            search(q, x, best)
            for _, q, best in asked_here:
                some = best.scores > np.iinfo(np.int64).min
                if some.any():
                    yield pd.DataFrame({"query_id": np.repeat(q.ids, k)[some.ravel()], "vec_id": best.ids[some], "score": best.scores[some]})

        part = scratch.write(data.select("dim", "kind", "ids", "data").mapInPandas(run, HITS), "hits")
        paths.append(scratch.paths[id(part)])
        sent.destroy()
    scratch.drop(data, asked, floors)
    found = spark.read.schema(HITS).parquet(*paths)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
