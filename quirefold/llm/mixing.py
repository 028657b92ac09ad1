"""Mixing sources to target weights: a budget of tokens goes down a tree of domain, language and source.

Each node's budget is shared among its children by weight, none beyond what it holds; what a child can't take goes to its
siblings, and only what all siblings together can't take goes back to the siblings of their parent. Each leaf then takes its
documents in seeded random orders, one for each epoch: as many whole epochs as its budget holds, and the prefix that fits of the
next one. A leaf's prefix is known by the last place in its order, so texts stay where they lie.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.llm.common import Scratch, small

LEVELS = ("domain", "language", "source")
#: Hexadecimal digits of the order that form a bucket: 4096 buckets a leaf. Sums are made by bucket, documents are only sorted
#: within the one bucket in which a leaf's prefix ends.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def shares(nodes: DataFrame, parent: list[str], weight: str, held: str, budget: str) -> DataFrame:
    """nodes with `share` (long): the parent's budget by weight, none above what the node holds, shortages to its siblings.

    Children in the order of held / weight: one is full if all up to it were given their fill and the rest went on by weight;
    the others share what the full ones leave. Rounding down leaves less than one token a node. The order is exact for weights
    below 2^31: the whole part of the ratio, then twice 31 bits of the fraction. A node of weight 0 must hold 0 here.
    """
    by = F.greatest(F.col(weight), F.lit(1))
    div = lambda a, b: F.call_function("div", a, b)
    first = F.shiftleft(F.col(held) % by, 31)
    ratio = [div(F.col(held), by), div(first, by), div(F.shiftleft(first % by, 31), by)]
    marked = nodes.withColumns({f"__r{k}": r for k, r in enumerate(ratio)})
    order = Window.partitionBy(*parent).orderBy("__r0", "__r1", "__r2", *(F.col(c) for c in nodes.columns if c in LEVELS))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    marked = marked.withColumn("__given", F.coalesce(F.sum(held).over(before), F.lit(0))).withColumn("__open", F.sum(weight).over(after))
    marked = marked.withColumn("__rest", F.col(budget) - F.col("__given"))
    full = wide(held) * F.col("__open").cast("decimal(18,0)") <= wide("__rest") * F.col(weight).cast("decimal(18,0)")
    marked = marked.withColumn("__full", full)
    marked = marked.withColumn("__left", F.col(budget) - F.sum(F.when(F.col("__full"), F.col(held)).otherwise(0)).over(whole)).withColumn("__among", F.sum(F.when(~F.col("__full"), F.col(weight)).otherwise(0)).over(whole))
    part = F.floor(F.col("__left").cast("decimal(27,0)") * F.col(weight).cast("decimal(10,0)") / F.nullif(F.col("__among"), F.lit(0)).cast("decimal(18,0)")).cast("long")
    return marked.withColumn("share", F.when(F.col("__full"), F.col(held)).otherwise(part)).drop(*(c for c in marked.columns if c.startswith("__")))


def budgets(leaves: DataFrame, percent: int, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """leaves (domain, language, source, tokens) with share, the budget of each leaf: `percent` of all tokens are dealt out, but no more
    than all leaves hold in so many epochs. A leaf holds nothing for the mix if its weight or one above it is 0."""
    none = F.lit(False)
    for level in LEVELS:
        none = none | (_weight(level, weights) == 0)
    rows = leaves.withColumn("held", F.when(none, F.lit(0)).otherwise(F.col("tokens") * epochs).cast("long"))
    path: list[str] = []
    upper = rows.agg(F.least(F.sum("held"), F.call_function("div", F.sum("tokens") * percent, F.lit(100))).alias("budget"))
    for level in LEVELS:
        at = [*path, level]
        nodes = rows.groupBy(*at).agg(F.sum("held").alias("held")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(upper, path) if path else nodes.join(F.broadcast(upper))  # one row
        given = shares(nodes, path or [F.lit(1)], "weight", "held", "budget")
        upper = given.select(*at, F.col("share").alias("budget"))
        path = at
    return rows.join(upper.withColumnRenamed("budget", "share"), list(LEVELS)).drop("held")


def mix(docs: DataFrame, share_percent: int, weights: Mapping[str, Mapping[str, int]], domain: Column, epochs: int = 1, seed: int = 1, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default doc_id) as they are, those of domain, language, source that keep doesn't name, n_tokens and copies (long, 0 if not taken).

    The budget is share_percent of all tokens (words). weights: for each level the weights of names, 1 where none is given, 0 to
    leave a name out (all below 2^31). A leaf whose budget is e times its tokens and a rest takes each document e times, and once
    more those of a prefix of the order md5(seed/e/doc_id) whose tokens up to and with the document stay within the rest: each
    epoch has its own order. Null names are a name of their own (''), null ids take the order of empty ids, repeated rows are
    separate documents (of equal order all or none are taken), texts without words go where their order falls; a leaf without
    any word takes each of its documents in every epoch, a leaf of weight 0 none. An empty table gives an empty one.

    Texts are read where they lie and never shuffled: names, ids and counts go to a narrow table, whose sums are made before the
    shuffle; a leaf of any size needs the sort of one bucket only. What comes back is a row for each leaf.
    """
    keep = ["doc_id"] if keep is None else keep
    scratch = Scratch(docs.sparkSession)
    leaf = list(LEVELS)
    name = {"domain": domain, "language": F.col("lang"), "source": F.col("source")}
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(f"__{k}") for k, c in name.items()]
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("__turns").cast("string"), F.col("__id")).cast("binary"))

    rows = docs.select(*named, id_, word_count(F.col(text)).alias("n"))
    rows = scratch.write(rows.select(*(F.col(f"__{c}").alias(c) for c in leaf), "__id", "n"), "counts")
    n = rows.count()  # no fewer than leaves
    leaves = rows.groupBy(*leaf).agg(F.sum("n").alias("tokens"))
    given = budgets(leaves, share_percent, weights, epochs)
    none = F.lit(False)
    for level in LEVELS:
        none = none | (_weight(level, weights) == 0)
    turns = F.when(none, 0).when(F.col("tokens") > 0, F.floor(F.col("share") / F.nullif(F.col("tokens"), F.lit(0)))).otherwise(epochs).cast("long")
    rest = F.when(F.col("tokens") > 0, F.col("share") % F.nullif(F.col("tokens"), F.lit(0))).otherwise(0)
    given = scratch.write(given.select(*leaf, turns.alias("__turns"), rest.cast("long").alias("__rest")), "leaves", n, 100)
    few = small(given, 200)
    of_leaf = F.broadcast(given) if few else given

    ordered = rows.join(of_leaf, leaf).where("__rest > 0").select(*leaf, "__rest", order.alias("__order"), "n").withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))
    sums = ordered.groupBy(*leaf, "__bucket").agg(F.sum("n").alias("tokens"), F.first("__rest").alias("__rest"))
    up_to = Window.partitionBy(*leaf).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("__end", F.sum("tokens").over(up_to)).where(F.col("__end") > F.col("__rest"))
    border = ends.groupBy(*leaf).agg(F.min(F.struct("__bucket", "__end", "tokens", "__rest")).alias("b"))
    border = scratch.write(border.select(*leaf, F.col("b.__bucket").alias("__bucket"), (F.col("b.__rest") - F.col("b.__end") + F.col("b.tokens")).alias("__room")), "borders", n, 100)
    within = Window.partitionBy(*leaf).orderBy("__order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ordered.join(F.broadcast(border) if few else border, [*leaf, "__bucket"]).withColumn("__sum", F.sum("n").over(within)).where(F.col("__sum") <= F.col("__room"))
    last = inside.groupBy(*leaf).agg(F.max("__order").alias("__last"))
    # all before the border's bucket are taken: its name alone comes before any order within it
    cut = border.join(last, leaf, "left").select(*leaf, F.coalesce("__last", "__bucket").alias("__last"))
    cut = scratch.write(given.join(cut, leaf, "left").select(*(F.col(c).alias(f"__{c}") for c in leaf), "__turns", "__last"), "cuts", n, 100)
    scratch.drop(rows, given, border)

    all_ = docs.select(*(F.col(c).alias(f"={c}") for c in keep), *named, id_, word_count(F.col(text)).alias("n_tokens"))
    placed = all_.join(F.broadcast(cut) if few else cut, [f"__{c}" for c in leaf])
    copies = F.col("__turns") + F.when(order <= F.col("__last"), 1).otherwise(0)
    return placed.select(*(F.col(f"={c}").alias(c) for c in keep), *(F.col(f"__{c}").alias(c) for c in leaf if c not in keep), "n_tokens", copies.cast("long").alias("copies"))
