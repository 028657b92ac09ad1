"""The structure pipeline: transcripts, model stages, tree index; every stage's table is written before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions.models import Provider, generated, reformatted, window_of
from quirefold.functions.text import basename, relative
from quirefold.operators import pages as P
from quirefold.operators.checks import lacking, none_of
from quirefold.operators.outline import outline
from quirefold.operators.sections import markdown_toc, split_sections
from quirefold.operators.store import cache_split, new_rows
from quirefold.operators.tree import build_index
from quirefold.plans import runs
from quirefold.scratch import Scope, Scratch
from quirefold.sources import pdf, prompts
from quirefold.sources.files import bare_path, discover, file_metadata


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def erase(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cached(rows: DataFrame, path: str, key: str, make) -> DataFrame:
    """What make(rows) gives, by key: from the table at path as it is there, and made and appended for rows that it lacks."""
    spark = rows.sparkSession
    missing = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else rows
    if not missing.isEmpty():
        make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(rows.select(key).distinct(), key, "left_semi").dropDuplicates([key]) if exists(spark, path) else make(rows)


def transcribe(pages: DataFrame, provider: Provider, fallback: Provider | None = None, workers: int = 32, wait: float = 5.0, image: str | None = None, spread: bool = True) -> DataFrame:
    """(doc_id, text, nb_pages) from page rows (doc_id, page_number, content, and for the fallback perhaps a column with an image)."""
    said = generated(pages, F.lit(prompts.TRANSCRIBE), "text", provider, attachment="content", fallback=fallback, workers=workers, wait=wait, image=image, only=["doc_id", "page_number"], spread=spread, window=window_of(provider))
    return P.assemble(said.select("doc_id", "page_number", "text"))


def documents(files: DataFrame, cache: str, provider: Provider, fallback: Provider | None = None, workers: int = 32) -> DataFrame:
    """(doc_id, filename, format, nb_pages, text) of PDF files (doc_id, path, content). Transcripts come from the cache table as they are;
    files that it lacks are cut into pages, transcribed, and appended to it. A file that can't be read raises.

    Reading files is the work here: they are dealt out to all tasks, however few the tasks are that hold them, and each is parsed once.
    Files that the cache holds are only probed. Pages are written, so calls take them as they lie, without a shuffle."""
    scratch = Scratch(files.sparkSession)
    known, new = cache_split(files, files.sparkSession.read.parquet(cache), "doc_id") if exists(files.sparkSession, cache) else (None, files)
    opened = scratch.write(pdf.opened(new.repartition("path"), ["doc_id", "path"]), "opened")
    seen = opened.where("page_number = 0").select("path", "nb_pages", "format", "error")
    if known is not None:
        seen = seen.unionByName(scratch.write(pdf.probe(known.repartition("path")), "probed"))
    none_of(seen.where("nb_pages is null").select("path", "error"), "files that can't be read")
    pages = opened.where("page_number > 0").select("doc_id", "page_number", "content")
    texts = cached(files, cache, "doc_id", lambda rows: transcribe(pages, provider, fallback, workers, spread=False))
    shape = seen.join(files.select("path", "doc_id"), "path").select("doc_id", basename(F.col("path")).alias("filename"), "format", "nb_pages")
    return shape.join(texts.select("doc_id", "text"), "doc_id")


def read_documents(spark: SparkSession, path: str, root: str, cache: str, provider: Provider, fallback: Provider | None = None, workers: int = 32) -> DataFrame:
    """documents() of the PDF files at or below path, with their file data (file); doc_id is the path below root."""
    files = discover(spark, path, root)
    named = files.withColumn("doc_id", relative(bare_path(F.col("path")), root.split("://", 1)[-1]))
    data = file_metadata(files, root, cache).join(named.select("path", "doc_id"), "path").select("doc_id", "file")
    return documents(named, cache, provider, fallback, workers).join(data, "doc_id")


def contexts(docs: DataFrame, provider: Provider, strict: bool = False, spread: bool = True) -> DataFrame:
    """docs with context, the model's JSON as VARIANT; null where it is missing or malformed unless strict."""
    said = generated(docs, F.concat(F.lit(prompts.CONTEXT), "text"), "__said", provider, spread=spread)
    return said.withColumn("context", T.strict_json_block(F.col("__said")) if strict else T.json_block(F.col("__said"))).drop("__said")


def extracted_tocs(docs: DataFrame, provider: Provider, spread: bool = True) -> DataFrame:
    said = generated(docs, prompts.toc_prompt(T.head_pages(F.col("text")), F.col("format") == "landscape"), "__said", provider, spread=spread)
    return said.withColumn("extracted_toc", T.sentinel(T.strip(F.col("__said")))).drop("__said")


def created_tocs(docs: DataFrame, provider: Provider, spread: bool = True) -> DataFrame:
    """Portrait: from the headings of the reformatted text. Landscape: a draft, then a check of it. The branches are parted before
    the model is called."""
    none_of(docs.where("format = 'portrait' and not is_reformatted").select("doc_id"), "portrait documents must be reformatted first")
    portrait = docs.where("format = 'portrait'")
    tocs = markdown_toc(portrait.withColumn("stem", T.stem(F.col("filename"))))
    portrait = portrait.join(tocs.withColumnRenamed("toc", "created_toc"), "doc_id")
    slides = docs.where("format = 'landscape'")
    draft = generated(slides, F.concat(F.lit(prompts.DRAFT_TOC), "text"), "__draft", provider, spread=spread)
    checked = generated(draft, F.concat(F.lit(prompts.CHECK_TOC), "__draft"), "__said", provider)
    slides = checked.withColumn("created_toc", T.strip(T.unwrap_any(F.col("__said")))).drop("__draft", "__said")
    return portrait.unionByName(slides)


def landscape_pages(docs: DataFrame, provider: Provider, spread: bool = True) -> DataFrame:
    """docs with pages: titles of a landscape document's pages; empty for others, which cause no call."""
    slides = docs.where("format = 'landscape'")
    said = generated(slides, F.concat(F.lit(prompts.PAGES), "text"), "__said", provider, spread=spread)
    slides = said.withColumn("pages", T.strip(F.col("__said"))).drop("__said")
    return docs.where("format <> 'landscape'").withColumn("pages", F.lit("")).unionByName(slides)


def structures(docs: DataFrame, provider: Provider, spread: bool = True) -> DataFrame:
    """Portrait: the created contents. Landscape: the model's grouping of the pages below the contents; these must be there."""
    toc = T.first_toc(F.col("extracted_toc"), F.col("created_toc"))
    slides = docs.where("format = 'landscape'")
    none_of(slides.where(toc.isNull() | (F.coalesce("pages", F.lit("")) == "")).select("doc_id"), "no contents or pages")
    said = generated(slides, F.concat(F.lit(prompts.GROUP), toc, F.lit("\n"), "pages"), "__said", provider, spread=spread)
    slides = said.withColumn("structure", T.strip(T.unwrap_any(F.col("__said")))).drop("__said")
    return docs.where("format = 'portrait'").withColumn("structure", F.col("created_toc")).unionByName(slides)


def ingest(docs: DataFrame, storage: str, provider: Provider, most: int = 50) -> DataFrame:
    """All model stages over new documents (doc_id, filename, format, nb_pages, text), and the stored documents after that.

    Contents seen before are left out, so a repeated run does nothing, and reformatted texts are kept by content, so a run that breaks
    off later doesn't pay for them again. Documents and their hashes are recorded together, last: a run that breaks off anywhere
    has stored nothing and can be tried again. Two runs at once share no folder; each leaves out what another one has recorded by the
    time it ends (of runs that end in the same moment both may record a content that they share, unless they bring the same).
    """
    spark = docs.sparkSession
    with Scope() as made:
        fresh = Scratch(spark).write(new_rows(docs, runs.table(spark, storage, "hashes")), "new")
        if not fresh.isEmpty():
            none_of(lacking(fresh, ["filename", "format", "nb_pages", "text"]), "documents that lack something")
            run = runs.run_id(fresh, "hash")
            stage = f"{storage}/stage/{run}-{uuid.uuid4().hex[:8]}"
            # a table as it was stored, which the stages read without a shuffle: the first one reads what the cache's own join deals out
            now = cached(fresh, f"{storage}/reformatted", "hash", lambda rows: reformatted(rows, provider, most).withColumn("is_reformatted", F.lit(True)))
            for name, work in (("contexts", contexts), ("extracted", extracted_tocs), ("created", created_tocs), ("pages", landscape_pages), ("structures", structures)):
                now = stored(work(now, provider, spread=False), f"{stage}/{name}")
            if (meanwhile := runs.table(spark, storage, "hashes")) is not None:
                now = now.join(meanwhile.select("hash").distinct(), "hash", "left_anti")
            runs.publish(spark, storage, run, {"documents": now.drop("hash"), "hashes": now.select("hash")})
            runs.drop(spark, stage)
    made.release()
    return stored_documents(spark, storage)


def stored_documents(spark: SparkSession, storage: str) -> DataFrame:
    """The documents of all recorded runs; raises where there is none."""
    found = runs.table(spark, storage, "documents")
    if found is None:
        raise FileNotFoundError(f"no documents below {storage}")
    return found


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, number, seq, content): pages of landscape documents, sections of portrait ones."""
    paged = P.split_pages(docs.where("format = 'landscape'").select("doc_id", "text"))
    cut = split_sections(docs.where("format = 'portrait'").select("doc_id", "text"))
    rows = paged.select("doc_id", F.col("page_number").alias("number"), F.col("page_number").alias("seq"), F.col("text").alias("content"))
    return rows.unionByName(cut.select("doc_id", F.col("line_number").alias("number"), F.col("section_ord").alias("seq"), F.col("text").alias("content")))


def tree_index(docs: DataFrame, storage: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    none_of(lacking(docs, ["filename", "format", "nb_pages", "structure"]), "documents that lack something")
    nodes, edges = build_index(outline(docs), parts(docs), strict=strict)
    return stored(nodes, f"{storage}/tree_nodes"), stored(edges, f"{storage}/tree_edges")
