"""Upkeep of stored documents: what is new, what is cached, what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_rows(docs: DataFrame, seen: DataFrame | None = None, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each content (sha2) that `seen` (hash) doesn't hold; hash is added."""
    hashed = docs.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if seen is not None:
        hashed = hashed.join(seen.select("hash").distinct(), "hash", "left_anti")
    first = hashed.groupBy("hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["hash", order], "left_semi")


def cache_split(wanted: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of wanted whose key is cached, and the others."""
    ids = cached.select(key).distinct()
    return wanted.join(ids, key, "left_semi"), wanted.join(ids, key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a grouped maximum: no sort, rows are summed up before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    picked = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return picked.select(key, F.col(f"r.{order}").alias(order), *(F.col(f"r.{c}").alias(c) for c in rest))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__k = 1").drop("__k")


def merged(left: Column, right: Column) -> Column:
    """Right-biased: the right value where there is one."""
    return F.coalesce(right, left)


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def key_values(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value) of the columns that aren't null."""
    entries = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    return docs.select(key, F.explode(entries).alias("e")).select(key, "e.name", "e.value").where("value is not null")


def choices(docs: DataFrame, key: str = "doc_id", name: str = "filename") -> DataFrame:
    return docs.select(key, F.coalesce(F.col(name), F.col(key).cast("string")).alias("choice"))


def lookup(docs: DataFrame, value, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col(key) == value)


def node_ids(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_ids) of each document, sorted."""
    return nodes.groupBy(key).agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def with_source(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have chunks; raises if none has."""
    found = docs.join(chunks.select(key), key, "left_semi")
    if found.isEmpty():
        raise ValueError("no document has chunks")
    return found
