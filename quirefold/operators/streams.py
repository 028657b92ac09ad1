"""Scans of rows in order: what a fold over one document's rows would hold is carried from row to row and from batch to batch, so time is
linear in the rows and memory is the scan's own state, however long a document is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.scratch import bounded

#: Rows, and characters of their last text column, of a batch that a scan hands on.
BATCH_ROWS, BATCH_CHARS = 8192, 1 << 20


def scanned(rows: DataFrame, keep: list[str], given: list[str], scan: Callable[[], Callable[..., Iterable[tuple]]], out: str) -> DataFrame:
    """keep and the columns of `out` (a schema string). scan() makes the state of a task; it is called with the values of `given` of each
    row, in the order in which rows lie in their partition, and gives the rows that this one brings forth."""
    bounded(rows.sparkSession)
    n = len(keep)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = scan()
        types = None
        for batch in batches:
            found, at, chars = [], [], 0

            def full() -> pa.RecordBatch:
                kept = [c.take(pa.array(at)) for c in batch.columns[:n]]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*found), types))], names=[*keep, *names])

            if types is None:
                names, types = zip(*((f.split(" ", 1)[0], _TYPES[f.split(" ", 1)[1]]) for f in out.split(", ")))
            for k, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]))):
                for row in step(*values):
                    found.append(row)
                    at.append(k)
                    chars += len(row[-1]) if isinstance(row[-1], str) else 0
                if len(found) >= BATCH_ROWS or chars > BATCH_CHARS:
                    yield full()
                    found, at, chars = [], [], 0
            if found:
                yield full()

    return rows.select(*keep, *given).mapInArrow(run, ", ".join([*kinds, out]))


_TYPES = {"long": pa.int64(), "string": pa.string()}
