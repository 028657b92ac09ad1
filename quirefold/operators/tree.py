"""The tree index: node and edge tables, their traversal, upkeep and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import tree_line
from quirefold.operators.checks import none_of
from quirefold.operators.outline import ends, numbered
from quirefold.scratch import Scratch

#: Where a node stands: the top of its tree, the bounds of what lies below it, its depth.
PLACE = ["tree", "first", "last", "depth"]


def node_id(doc: Column, kind: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc.cast("string"), kind, number.cast("string")), 256)


def missing_nodes(outline: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outline entries of number 0 or more for which parts (key, number) has no row."""
    return outline.where("number >= 0").select(key, "number").join(parts.select(key, "number"), [key, "number"], "left_anti")


def build_index(outline: DataFrame, parts: DataFrame, key: str = "doc_id", strict: bool = True, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from outlines and parts (key, number, seq, content): pages or sections; of equal numbers the last counts.

    nodes: node_id, key, number, kind (root, abstract, page, section, orphan), name, content, and where they stand: tree (the id of the
    node on top), first and last (bounds of what lies below, in order of a walk), depth. Abstract nodes hold their title; parts
    outside the outline are orphans, each a tree of its own. edges: parent_id, child_id, child_ord in outline order. A
    node's number finds its parent on the way of the scan that numbers the outline, so edges need no join. scratch: the numbered
    outline is written there, for where both tables are read; each of them scans the outline for itself otherwise.
    """
    if strict:
        none_of(missing_nodes(outline, parts, key), "outline numbers without a node")
    last = parts.groupBy(key, "number").agg(F.max(F.struct("seq", "content"))["content"].alias("content"))
    lines = numbered(outline, key)
    lines = scratch.write(lines, "numbered") if scratch else lines
    rows = lines.join(last, [key, "number"], "full_outer")
    lost = F.col("ord").isNull()
    rows = rows.withColumn("kind", F.when(lost, "orphan").otherwise(F.col("kind"))).withColumn("node_id", node_id(F.col(key), F.col("kind"), F.col("number")))
    content = F.when(F.col("kind") == "abstract", F.col("name")).otherwise(F.coalesce("content", F.lit("")))
    top = F.when(lost, F.col("node_id")).otherwise(node_id(F.col(key), F.lit("root"), F.lit(-1)))
    place = (F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("ord", "first"), ("last", "last"), ("depth", "depth")))
    nodes = rows.select("node_id", key, "number", "kind", F.when(lost, "").otherwise(F.col("name")).alias("name"), content.alias("content"), top.alias("tree"), *place)
    edges = lines.where("parent_number is not null")
    return nodes, edges.select(node_id(F.col(key), F.col("parent_kind"), F.col("parent_number")).alias("parent_id"), node_id(F.col(key), F.col("kind"), F.col("number")).alias("child_id"), "child_ord")


def children(edges: DataFrame, parent: str | None = None) -> DataFrame:
    """(parent_id, children: ordered array)."""
    chosen = edges if parent is None else edges.where(F.col("parent_id") == parent)
    return chosen.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("child_ord", "child_id"))), lambda x: x["child_id"]).alias("children"))


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, parent_id): null for roots and orphans."""
    return nodes.select("node_id").join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id", "left")


def children_of(nodes: DataFrame, edges: DataFrame, node: str) -> list[str]:
    known(nodes, node)
    found = children(edges, node).collect()
    return list(found[0]["children"]) if found else []


def parent_of(nodes: DataFrame, edges: DataFrame, node: str) -> str | None:
    known(nodes, node)
    found = edges.where(F.col("child_id") == node).select("parent_id").collect()
    return found[0][0] if found else None


def is_root(nodes: DataFrame, node: str) -> bool:
    return not nodes.where((F.col("node_id") == node) & (F.col("kind") == "root")).isEmpty()


def is_node(nodes: DataFrame, node: str) -> bool:
    return not nodes.where(F.col("node_id") == node).isEmpty()


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'root'")


def size(nodes: DataFrame) -> int:
    return nodes.count()


def lineage(edges: DataFrame) -> DataFrame:
    """(node_id, above, ordinals) of each child: its ancestors from the root down and the ordinals on the way to it.

    Paths are joined to paths, so they double in each round: a tree of d levels takes about log2(d) rounds, and there is no bound
    on d. Each round's table is written, and the one before it deleted. Raises if the edges hold a cycle.
    """
    scratch = Scratch(edges.sparkSession)
    now = edges.select(F.col("child_id").alias("node_id"), F.array("parent_id").alias("above"), F.array("child_ord").alias("ordinals"))
    now, before = scratch.write(now, "paths"), None
    while True:
        upper = now.select(F.col("node_id").alias("top"), F.col("above").alias("__above"), F.col("ordinals").alias("__ordinals"))
        joined = now.join(upper, now["above"][0] == F.col("top"), "left")
        longer = joined.select("node_id", F.when(F.col("top").isNull(), F.col("above")).otherwise(F.concat("__above", "above")).alias("above"), F.when(F.col("top").isNull(), F.col("ordinals")).otherwise(F.concat("__ordinals", "ordinals")).alias("ordinals"), F.col("top").isNull().alias("whole"))
        before, now = now, scratch.write(longer, "paths")
        scratch.drop(before)
        none_of(now.where(F.array_contains("above", F.col("node_id"))).select("node_id"), "a node below itself")
        if now.where("not whole").isEmpty():
            return now.drop("whole")


def is_above(a: str, b: str) -> Column:
    """Whether node a lies above node b, or is it, by the numbers of both (columns of two rows, by their aliases)."""
    return (F.col(f"{a}.tree") == F.col(f"{b}.tree")) & (F.col(f"{a}.first") <= F.col(f"{b}.first")) & (F.col(f"{b}.first") <= F.col(f"{a}.last"))


def subtree(nodes: DataFrame, edges: DataFrame, start: DataFrame, own: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Below each start (node_id): start_id, node columns, depth (0 at the start) and path (place in a walk of the whole tree): a range of the
    start's tree, by one join. Nodes of one tree, stored in order of first, are pruned by it. Nodes without numbers get them from the edges
    first; edges that were changed by hand ask for renumber(). own: start is made of rows of nodes as they are, with their numbers, so these
    aren't looked up. carry: columns of the starts that go along, as start_*."""
    if not set(PLACE) <= set(nodes.columns):
        nodes, own = renumber(nodes, edges), False
    starts = start if own else nodes.join(start.select("node_id").distinct(), "node_id", "left_semi")
    starts = starts.select(F.col("node_id").alias("start_id"), *PLACE, *(F.col(c).alias(f"start_{c}") for c in carry))
    found = nodes.alias("n").join(starts.alias("s"), is_above("s", "n"))
    mine = [F.col(f"n.{c}") for c in nodes.columns if c not in PLACE]
    return found.select("s.start_id", *(f"s.start_{c}" for c in carry), *mine, (F.col("n.depth") - F.col("s.depth")).alias("depth"), F.col("n.first").alias("path"))


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Above each of (node_id): node_id, above_id and steps, from the parent (1) up."""
    low = nodes.join(of.select("node_id").distinct(), "node_id", "left_semi").select("node_id", *PLACE)
    found = nodes.alias("n").join(low.alias("s"), is_above("n", "s") & (F.col("n.first") < F.col("s.first")))
    return found.select(F.col("s.node_id"), F.col("n.node_id").alias("above_id"), (F.col("s.depth") - F.col("n.depth")).alias("steps"))


def walk(below: DataFrame, order: str = "dfs") -> DataFrame:
    """subtree() rows with place, their order in a walk from the start: dfs (parents before children) or bfs."""
    by = [F.col("path")] if order == "dfs" else [F.col("depth"), F.col("path")]
    return below.withColumn("place", F.row_number().over(Window.partitionBy("start_id").orderBy(*by)).cast("long") - 1)


def render_subtree(below: DataFrame) -> DataFrame:
    lines = below.withColumn("shown", tree_line(F.col("depth"), F.col("name"), F.col("number")))
    return lines.groupBy("start_id").agg(F.expr("listagg(shown, '\n') WITHIN GROUP (ORDER BY path)").alias("tree"))


def renumber(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with tree, first, last and depth anew from edges of any making: children in order of child_ord, then id. Needed after edges
    were changed by hand. The way down to each node is found by doubling paths; a cycle raises."""
    names = [c for c in nodes.columns if c not in PLACE]
    ways = lineage(edges)
    ids = nodes.select("node_id").distinct()
    placed = ids.join(ways.select("node_id", F.col("above")[0].alias("__top"), F.size("above").cast("long").alias("__depth"), "ordinals"), "node_id", "left")
    placed = placed.select("node_id", F.coalesce("__top", "node_id").alias("tree"), F.coalesce("__depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("ordinals", F.array().cast("array<bigint>")).alias("way"))
    row = Window.partitionBy("tree").orderBy("way", "node_id")
    ordered = placed.withColumn("ord", F.row_number().over(row).cast("long") - 1).drop("way")
    return nodes.select(*names).join(ends(ordered, "tree").withColumnRenamed("ord", "first"), "node_id")


def insert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """With the new nodes, each a tree of its own unless it says where it stands; the numbers of others stay."""
    alone = {"tree": F.coalesce(F.col("tree"), F.col("node_id"))} | {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in PLACE[1:]}
    every = nodes.unionByName(new, allowMissingColumns=True)
    return every.withColumns(alone) if set(PLACE) <= set(nodes.columns) else every


def delete_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes (node_id) and the edges at them. What lay below a node that goes stands in trees of its own, one for each child;
    all numbers stay, only the name of the tree changes."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids, edges.parent_id == ids.node_id, "left_anti")
    kept = left.join(ids, left.child_id == ids.node_id, "left_anti")
    rest = nodes.join(ids, "node_id", "left_anti")
    if not set(PLACE) <= set(nodes.columns):
        return rest, kept
    lost = edges.join(ids, edges.parent_id == ids.node_id, "left_semi").select(F.col("child_id").alias("node_id"))
    tops = rest.join(lost, "node_id", "left_semi").select(F.col("node_id").alias("top"), *PLACE)
    below = rest.select("node_id", *PLACE).alias("n").join(tops.alias("t"), is_above("t", "n"))
    moved = below.groupBy("n.node_id").agg(F.max_by("t.top", "t.first").alias("__top"))
    return rest.join(moved, "node_id", "left").withColumn("tree", F.coalesce("__top", "tree")).drop("__top"), kept


def add_child(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Raises if the child has a parent."""
    none_of(edges.where(F.col("child_id") == child), "the node has a parent")
    at = edges.where(F.col("parent_id") == parent).agg(F.coalesce(F.max("child_ord"), F.lit(0)).alias("n")).first()["n"] + 1
    return edges.unionByName(edges.sparkSession.createDataFrame([(parent, child, at)], "parent_id string, child_id string, child_ord long"))


def known(nodes: DataFrame, *ids: str) -> None:
    """Raise unless all of these nodes are there."""
    wanted = nodes.sparkSession.createDataFrame([(i,) for i in ids], "node_id string")
    none_of(wanted.join(nodes, "node_id", "left_anti"), "unknown node")


def set_root(nodes: DataFrame, node: str, key: str = "doc_id") -> DataFrame:
    """The node becomes the root of its document. Raises for an unknown node, or if the document has another root."""
    known(nodes, node)
    mine = nodes.join(nodes.where(F.col("node_id") == node).select(key), key, "left_semi")
    none_of(mine.where((F.col("kind") == "root") & (F.col("node_id") != node)), "the document has another root")
    return nodes.withColumn("kind", F.when(F.col("node_id") == node, "root").otherwise(F.col("kind")))


def set_parent(nodes: DataFrame, edges: DataFrame, child: str, parent: str) -> DataFrame:
    """The child hangs below the parent, as its last one. Raises for an unknown node, or if the child has another parent."""
    known(nodes, child, parent)
    none_of(edges.where((F.col("child_id") == child) & (F.col("parent_id") != parent)), "the node has another parent")
    here = (F.col("child_id") == child) & (F.col("parent_id") == parent)
    return edges if not edges.where(here).isEmpty() else add_child(edges, parent, child)


def set_children(nodes: DataFrame, edges: DataFrame, parent: str, ids: list[str]) -> DataFrame:
    """The parent's children are these, in this order. Raises for an unknown node, or if one has another parent."""
    known(nodes, parent, *ids)
    none_of(edges.where(F.col("child_id").isin(ids) & (F.col("parent_id") != parent)), "a node has another parent")
    rows = edges.sparkSession.createDataFrame([(parent, i, k + 1) for k, i in enumerate(ids)], "parent_id string, child_id string, child_ord long")
    return edges.where(F.col("parent_id") != parent).unionByName(rows)


def remove_child(edges: DataFrame, parent: str, child: str) -> tuple[DataFrame, bool]:
    match = (F.col("parent_id") == parent) & (F.col("child_id") == child)
    return edges.where(~match), not edges.where(match).isEmpty()


def delete_document(nodes: DataFrame, edges: DataFrame, doc, key: str = "doc_id") -> tuple[DataFrame, DataFrame, bool]:
    """Without one document's nodes and edges, and whether it was there (an unknown one changes nothing)."""
    gone = nodes.where(F.col(key) == doc)
    found = not gone.isEmpty()
    ids = gone.select("node_id")
    left = edges.join(ids, edges.parent_id == ids.node_id, "left_anti")
    return nodes.where(F.col(key).isNull() | (F.col(key) != doc)), left.join(ids, left.child_id == ids.node_id, "left_anti"), found


def delete_nodes(*_: object) -> None:
    raise NotImplementedError("delete whole documents")


def as_retriever(*_: object) -> None:
    raise NotImplementedError("a tree isn't searched by similarity; use operators.retrieval")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, node_id): ids that repeat, children with several parents, edges to nowhere."""
    twice = nodes.groupBy("node_id").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), "node_id")
    several = edges.groupBy("child_id").count().where("count > 1").select(F.lit("several parents").alias("problem"), F.col("child_id").alias("node_id"))
    ends = edges.select(F.col("parent_id").alias("node_id")).unionByName(edges.select(F.col("child_id").alias("node_id"))).distinct()
    return twice.unionByName(several).unionByName(ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("unknown node").alias("problem"), "node_id"))


def upsert_nodes(nodes: DataFrame, key: str = "node_id", seq: str = "seq") -> DataFrame:
    """The last written row of each id."""
    return nodes.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__k = 1").drop("__k")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose ends both exist."""
    ids = nodes.select("node_id").distinct()
    known = edges.join(ids, edges.parent_id == ids.node_id, "left_semi")
    return known.join(ids, known.child_id == ids.node_id, "left_semi").dropDuplicates(["parent_id", "child_id"])


def export(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Overwrite the tables of nodes and edges below path: ids are checked first, edges to nowhere stay out."""
    none_of(nodes.groupBy("node_id").count().where("count > 1"), "ids must be unique")
    nodes.write.mode("overwrite").parquet(f"{path}/tree_nodes")
    upsert_edges(edges, nodes).write.mode("overwrite").parquet(f"{path}/tree_edges")


def export_by_partition(rows: DataFrame, connect, write) -> None:
    """For graph stores: connect() once for each partition, write(connection, row) for each row, then close it."""

    def send(part) -> None:
        connection = connect()
        try:
            for row in part:
                write(connection, row.asDict(recursive=True))
        finally:
            getattr(connection, "close", lambda: None)()

    rows.foreachPartition(send)


