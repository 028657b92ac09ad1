"""Tables that grow by runs. A run writes its tables into a folder of its own and is there once its record is: one file that names them,
written last and put in its place by a rename. Readers see recorded runs only; what a run that broke
off has left is never read, and goes with sweep()."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_id(keys: DataFrame, key: str) -> str:
    """Names a run by what it brings: the same keys in any order and number give the same name."""
    distinct = keys.select(F.sha2(F.col(key).cast("string"), 256).alias("k")).distinct()
    parts = [F.conv(F.substring("k", 1 + 15 * j, 15), 16, 10).cast("decimal(38,0)") for j in range(4)]
    sums = distinct.agg(F.count("*"), *(F.sum(p) for p in parts)).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, "/".join(map(str, sums))).hex


def records(spark: SparkSession, storage: str) -> dict[str, dict[str, str]]:
    """By run: its tables (names and paths)."""
    folder, fs = _path(spark, f"{storage}/commits")
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".json") and not name.startswith((".", "_")):
            found[name.removesuffix(".json")] = json.loads("\n".join(r.value for r in spark.read.text(status.getPath().toString()).collect()))
    return found


def table(spark: SparkSession, storage: str, name: str) -> DataFrame | None:
    """The rows of all recorded runs; those of a plain table at storage/name too, as older stores have it; None without either."""
    paths = [f"{storage}/{t[name]}" for _, t in sorted(records(spark, storage).items()) if name in t]
    path, fs = _path(spark, f"{storage}/{name}")
    if fs.exists(path):
        paths.append(f"{storage}/{name}")
    return spark.read.parquet(*paths) if paths else None


def publish(spark: SparkSession, storage: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a run into a folder of this try, then the run's record: all of them are there, or none is. A run that has been
    recorded meanwhile stays as it is."""
    final, fs = _path(spark, f"{storage}/commits/{run}.json")
    if fs.exists(final):
        return
    folder = f"runs/{run}-{uuid.uuid4().hex[:8]}"
    named = {name: f"{folder}/{name}" for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(f"{storage}/{named[name]}")
    draft, _ = _path(spark, f"{storage}/commits/.{run}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(json.dumps(named).encode())
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        if not fs.exists(final):
            raise OSError(f"no record of run {run}")


def drop(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


def sweep(spark: SparkSession, storage: str) -> list[str]:
    """Delete what runs without a record have left, and name them. Not while a run goes on."""
    folder, fs = _path(spark, f"{storage}/runs")
    known = {path.split("/")[1] for tables in records(spark, storage).values() for path in tables.values()}
    gone = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in known] if fs.exists(folder) else []
    for name in gone:
        drop(spark, f"{storage}/runs/{name}")
    return sorted(gone)
