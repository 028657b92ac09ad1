"""What a viewer shows of one stored document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import display
from quirefold.operators.outline import outline, render, with_depth
from quirefold.operators.store import choices, key_values, lookup


def count(docs: DataFrame) -> int:
    return docs.count()


def picker(docs: DataFrame) -> DataFrame:
    return choices(docs)


def metadata(docs: DataFrame, doc) -> DataFrame:
    shown = [c for c in docs.columns if c not in ("doc_id", "text")]
    return key_values(lookup(docs, doc), "doc_id", shown).withColumn("value", display(F.col("value")))


def rendered_outline(docs: DataFrame, doc) -> DataFrame:
    return render(with_depth(outline(lookup(docs, doc))))
