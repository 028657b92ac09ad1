"""Views over the test tables that hold what the operators need: Markdown with headings, fences and pages; outlines; chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, mx, line) of documents dressed as Markdown."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    rows = raw.select("doc_id", (F.size("a") - 1).cast("long").alias("mx"), F.posexplode("a").alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    level = (1 + (F.col("doc_id") * 5 + F.col("pos") * F.col("pos")) % 4).cast("int")
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" H"), F.col("pos").cast("string"), F.lit(" "), F.split("line", " ")[0])
    return rows.withColumn("line", F.when((F.col("pos") % 12).isin(7, 9), "```").when(F.col("pos") % 4 == F.col("doc_id") % 2, heading).otherwise(F.col("line")))


def f_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    mark = F.when((F.col("pos") % 6 == 5) | (F.col("pos") == F.col("mx")), F.concat(F.lit("\n\n--- end page "), (F.floor(F.col("pos") / 6) + 1).cast("string"), F.lit("\n\n"))).otherwise("")
    pieces = rows.withColumn("piece", F.concat("line", F.lit("\n"), mark))
    return pieces.groupBy("doc_id").agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY pos)").alias("text"), (F.floor(F.max("pos") / 6) + 1).cast("long").alias("nb_pages"))


def f_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (3 + F.col("doc_id") % 9).alias("nb_pages"))
    rows = docs.select("doc_id", "nb_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb_pages") + 3)).alias("i"))
    section = F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + F.col("i") * F.col("i")) % 3).cast("int")), F.lit(" Section "), F.col("i").cast("string"))
    page = F.concat(F.lit("- Page "), (1 + (F.col("i") * 2 + F.col("doc_id")) % (F.col("nb_pages") + 2)).cast("string"), F.lit(" : Title "), F.col("i").cast("string"))
    lines = rows.withColumn("line", F.when(F.col("i") % 3 == 0, section).otherwise(page))
    return lines.groupBy("doc_id", "nb_pages").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY i)").alias("structure")).withColumn("filename", F.concat(F.lit("deck_"), F.col("doc_id").cast("string"), F.lit(".pdf")))


def f_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("doc_id"), (1 + F.col("vec_id") % 7).alias("page_number"), F.col("vec_id").alias("chunk_ord"), F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding")


def f_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def as_pdf(text: Column, landscape: Column) -> Column:
    """A PDF file with a page for each line of the text."""
    from quirefold.sources.pdf import text_pdf

    @F.pandas_udf("binary")
    def made(texts: pd.Series, wide: pd.Series) -> pd.Series:
        return pd.Series([text_pdf((t or "").split("\n"), *((800, 600) if w else (600, 800))) for t, w in zip(texts, wide)])

    return made(text, landscape)


#: The same views as SQL for DuckDB.
MD_SQL = """md_l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
md_k AS (SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id) AS mx,
  CASE WHEN pos % 12 IN (7, 9) THEN '```'
       WHEN pos % 4 = doc_id % 2 THEN concat(repeat('#', 1 + (doc_id * 5 + pos * pos) % 4), ' H', CAST(pos AS VARCHAR), ' ', string_split(line, ' ')[1])
       ELSE line END AS line FROM md_l),
md AS (SELECT doc_id, string_agg(concat(line, chr(10), CASE WHEN pos % 6 = 5 OR pos = mx THEN concat(chr(10), chr(10), '--- end page ', CAST(pos // 6 + 1 AS VARCHAR), chr(10), chr(10)) ELSE '' END), '' ORDER BY pos) AS text,
  max(pos) // 6 + 1 AS nb_pages FROM md_k GROUP BY doc_id)"""
OUT_SQL = """out_l AS (SELECT doc_id, nb_pages, unnest(range(0, nb_pages + 4)) AS i FROM (SELECT doc_id, 3 + doc_id % 9 AS nb_pages FROM documents)),
out_k AS (SELECT doc_id, nb_pages, i, CASE WHEN i % 3 = 0 THEN 1 + (doc_id + i * i) % 3 END AS level, CASE WHEN i % 3 <> 0 THEN 1 + (i * 2 + doc_id) % (nb_pages + 2) END AS page FROM out_l)"""
