"""Strict checks: an action that counts violations, since an expression that isn't used would be pruned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    pass


def none_of(violations: DataFrame, message: str) -> None:
    """Raise if there is any row; the first few are named."""
    found = violations.limit(3).collect()
    if found:
        raise Violation(f"{message}: " + "; ".join(str(r.asDict()) for r in found))


def lacking(rows: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """(key, lacks) of rows in which one of the columns is null: the names of those, in order."""
    named = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda x: x.isNotNull()), ",")
    return rows.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))).select(key, named.alias("lacks"))
