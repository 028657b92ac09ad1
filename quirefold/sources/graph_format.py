"""A property graph store as a format to write to: `df.write.format("quirefold_graph")`.

Each task stages its rows in the store under a name of its own; the driver has the store merge what committed tasks have staged once all
have ended, batch by batch and within the store, and deletes all that the run has staged, of failed tasks too. So a job that fails leaves nothing behind, a task that is
tried again does no harm, and edges find all nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quirefold.operators.checks import none_of
from quirefold.operators.tree import upsert_edges
from quirefold.sources.graph import UNIQUE, Bolt

#: Statements of the store's language. $most bounds a batch; each gives n, the number of rows that it took.
STAGE = "UNWIND $rows AS row CREATE (s:Staged) SET s = row, s.staged_run = $run, s.staged_part = $part"
_HELD = "MATCH (s:Staged {staged_run: $run}) WHERE s.staged_part IN $parts WITH s LIMIT $most "
PLACE = {
    "nodes": _HELD + "MERGE (n:DocPart {part_id: s.node_id}) SET n += properties(s), n.staged_run = null, n.staged_part = null DELETE s RETURN count(*) AS n",
    "edges": _HELD + "OPTIONAL MATCH (a:DocPart {part_id: s.parent_id}) OPTIONAL MATCH (b:DocPart {part_id: s.child_id}) FOREACH (_ IN CASE WHEN a IS NULL OR b IS NULL THEN [] ELSE [1] END | MERGE (a)-[e:PARENT_OF]->(b) SET e.child_ord = s.child_ord) DELETE s RETURN count(*) AS n",
}
DROP = "MATCH (s:Staged {staged_run: $run}) WITH s LIMIT $most DELETE s RETURN count(*) AS n"
WIPE_SOME = "MATCH (n) WHERE NOT n:Staged WITH n LIMIT $most DETACH DELETE n RETURN count(*) AS n"
FORMAT = "quirefold_graph"


@dataclass
class Staged(WriterCommitMessage):
    part: str
    rows: int


def _opened(options: dict[str, str]):
    """A session: of what `connect` names (module:function without arguments), or of the store at `uri`."""
    if name := options.get("connect"):
        module, attribute = name.split(":", 1)
        return getattr(import_module(module), attribute)()
    return Bolt(options["uri"], options.get("user", ""), options.get("password", ""), options.get("database", ""))()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.kind = options.get("kind", "nodes")
        if self.kind not in PLACE:
            raise ValueError("kind is nodes or edges")
        self.most = int(options.get("batch", "1000"))
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        part, n, held, session = uuid.uuid4().hex, 0, [], None
        try:
            for row in rows:
                held.append(row.asDict(recursive=True))
                n += 1
                if len(held) == self.most:
                    session = session or _opened(self.options)
                    session.run(STAGE, rows=held, run=self.run, part=part)
                    held = []
            if held:
                session = session or _opened(self.options)
                session.run(STAGE, rows=held, run=self.run, part=part)
        finally:
            if session is not None:
                session.close()
        return Staged(part, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        session = _opened(self.options)
        try:
            parts = [m.part for m in messages if isinstance(m, Staged)]
            while session.run(PLACE[self.kind], run=self.run, parts=parts, most=self.most).single()["n"]:
                pass
            self._drop(session)
        finally:
            session.close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        session = _opened(self.options)
        try:
            self._drop(session)
        finally:
            session.close()

    def _drop(self, session) -> None:
        while session.run(DROP, run=self.run, most=self.most).single()["n"]:
            pass


class GraphSink(DataSource):
    """Options: kind (nodes or edges), batch, and connect (module:function) or uri, user, password, database."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, batch: int = 1000, **options: str) -> None:
    """Empty the store in batches, then write the nodes, then the edges whose ends exist. Ids are checked first, so a table that can't be
    written empties nothing."""
    none_of(nodes.groupBy("node_id").count().where("count > 1"), "ids must be unique")
    spark.dataSource.register(GraphSink)
    session = _opened(options)
    try:
        while session.run(WIPE_SOME, most=batch).single()["n"]:
            pass
        session.run(UNIQUE)
    finally:
        session.close()
    for kind, rows in (("nodes", nodes), ("edges", upsert_edges(edges, nodes))):
        rows.write.format(FORMAT).options(kind=kind, batch=str(batch), **options).mode("append").save()
