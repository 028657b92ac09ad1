"""Tables that are written and read again: the folder that driver and executors share, and what is to be deleted there."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes from Spark to a Python worker, unless the session says otherwise.
BATCH_BYTES = 1 << 20
#: Bytes of a counted table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a file of a table whose size has a known bound.
FILE_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_temporary: dict[str, str] = {}
_owner: ContextVar[Scope | None] = ContextVar("quirefold_owner", default=None)
_cleaning: weakref.WeakKeyDictionary[SparkSession, list] = weakref.WeakKeyDictionary()
_lock = threading.Lock()


def _local(master: str) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", master))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary
    folder, which goes when the driver ends; any other master has no folder that would do, and the call raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not _local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _temporary:
        folder = tempfile.mkdtemp(prefix="quirefold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _temporary[context.applicationId] = f"file://{folder}"
    return _temporary[context.applicationId]


def bounded(spark: SparkSession) -> None:
    """Batches that go to Python workers get a bound in bytes where the session sets none. Those that come back are bounded by their kernels:
    Spark's own setting for these (maxBytesPerOutputBatch) fails on some batches in 4.1."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs that end meanwhile are deleted. Of several threads the first switches the session's setting, the last one back."""
    with _lock:
        held = _cleaning.setdefault(spark, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_SHUFFLES, "false")
            spark.conf.set(_SHUFFLES, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(_SHUFFLES, held[1])


class Scope:
    """Owns the scratch tables of the calls made within it: `with Scope() as made: ...`, then `made.release()` once what the calls returned
    has been stored. Nothing else is deleted: tables of other threads, sessions and calls stay. Within another scope, what is not
    released at the end goes over to that one. Without a scope tables stay until their folder goes (on a local master with the driver)."""

    def __init__(self) -> None:
        self.roots: list[tuple[SparkSession, str] | Scope] = []
        self._outer: Scope | None = None

    def __enter__(self) -> Scope:
        self._outer = _owner.get()
        _owner.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _owner.set(self._outer)
        if self._outer is not None:
            self._outer.roots.append(self)

    def folders(self) -> list[str]:
        return [x for held in self.roots for x in (held.folders() if isinstance(held, Scope) else [held[1]])]

    def release(self) -> None:
        while self.roots:
            held = self.roots.pop()
            if isinstance(held, Scope):
                held.release()
            else:
                _delete(*held)


class Scratch:
    """Tables of one call of an operator, below a folder of its own in the shared folder.

    write() ends the lineage: the rows are read back from the files, so lost executors cost no recomputation; shuffle files of the
    writing job are deleted with its end. drop() deletes tables that nothing reads any more. What a returned DataFrame still reads
    stays until release(), or that of the scope in which the call was made.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quirefold-scratch/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []  # so that their ids stay theirs
        if (scope := _owner.get()) is not None:
            scope.roots.append((spark, self.root))
        if _local(spark.sparkContext.master):
            atexit.register(shutil.rmtree, re.sub("^file:(//)?", "", self.root), ignore_errors=True)  # nobody else reads it
        bounded(spark)

    def write(self, df: DataFrame, name: str, rows: int | None = None, width: int = 64) -> DataFrame:
        """rows: the table has no more than so many, of about width bytes; it then goes to a file for each FILE_BYTES of that bound, not to
        one for each partition of the last shuffle, and small tables cost few tasks and files. Not for joins with wide tables: their
        rows all go through those few tasks."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
        path = f"{self.root}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        with _cleaned(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self.kept.append(back)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, self.paths[id(t)])

    def release(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, row_bytes: int) -> bool:
    """Whether a table of rows of row_bytes bytes may be broadcast: its rows are counted."""
    return table.count() * row_bytes <= BROADCAST_BYTES
