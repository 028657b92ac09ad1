"""From raw documents to token ids: quality rules, line and document deduplication, mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and hands them to the next one as its docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.bpe import encode_documents
from quirefold.llm.common import Scope, Scratch, small, table
from quirefold.llm.linedup import drop_lines
from quirefold.llm.mixing import mix
from quirefold.llm.neardup import Sketching, near_duplicates
from quirefold.llm.queries import domain_of_source, tokenizer_path
from quirefold.llm.repetition import repetition

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mix keeps this part of the tokens; languages and domains are weighted as named, the rest alike, nothing is repeated.
MIX_PERCENT, MIX_SEED = 90, 29
MIX_WEIGHTS = {"domain": {"d0": 3}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep: null, empty and very short texts go; rows are judged one by one, so rows that are
    repeated or share an id each have their own verdict. An empty table gives an empty one; columns beyond those of documents go."""
    return repetition(docs, keep=[c for c in COLUMNS if c != "text"] + ["text"]).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier document or line holds already, but for one edit; n_chars is that of the rest.

    Earlier is by doc_id (null last), then by the line's number. Rows equal in id and text lose the same lines. A document goes
    only if it lost a line and has no word left; null and empty texts stay as they are, with n_chars 0.
    """
    left = drop_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), that of the smallest id.

    Documents are told apart by id and text: of two texts that share an id each is judged for itself, of rows equal in both one stays.
    Texts without words are near-duplicates of nothing; rows without an id stay. Texts stay where they lie while the list
    of what goes is small enough to be broadcast (it is counted); beyond, they are shuffled once.
    """
    t = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    judged = near_duplicates(docs, Sketching(shingle=5, percent=80)).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "chosen")
    scratch = Scratch(spark)
    counted = judged.groupBy("__id", "__t").agg(F.max("chosen").alias("__stays"), F.count("*").alias("__n"))
    named = scratch.write(counted.where("not __stays or __n > 1"), "judged", docs.count(), 32)
    rows = docs.select(*COLUMNS).withColumns({"__key": F.col("doc_id").cast("long"), "__hash": t})
    joined = rows.join(F.broadcast(named) if small(named, 32) else named, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__t")), "left").where("__stays is null or __stays")
    again = joined.where("__n > 1").dropDuplicates(["__key", "__hash"])
    return joined.where("__n is null or __n = 1").unionByName(again).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each leaf's token prefix, unchanged: names that are null stay null. Ties, repeated rows, null ids and texts
    without words are as in mix()."""
    picked = mix(docs, MIX_PERCENT, MIX_WEIGHTS, domain_of_source(), epochs=1, seed=MIX_SEED, keep=COLUMNS)
    return picked.where("copies > 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (binary) and whether decoding them gives the text back; a null text counts as empty."""
    import public_tokenizers

    coded = encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"), same.alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("tokens", tokens)]

#: SQL expresses neither suffix arrays nor components of near-duplicates nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are stored before the next begins, and what that stage made meanwhile goes,
    nothing else; two stages' rows at most are there at once. What the returned rows are read from stays, or belongs to the scope
    in which run() is called."""
    docs = table(spark, sf_dir, "documents")
    held, before = Scratch(spark), None
    for name, stage in STAGES[:-1]:
        with Scope() as made:
            docs = held.write(stage(spark, docs, sf_dir), name)
        made.release()
        if before is not None:
            held.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
