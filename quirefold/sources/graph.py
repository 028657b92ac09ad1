"""A property graph store as a sink for the tree: nodes and edges are merged by id, batch by batch, from the tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quirefold.operators.checks import none_of
from quirefold.operators.tree import upsert_edges

WIPE = "MATCH (n) DETACH DELETE n"
UNIQUE = "CREATE CONSTRAINT doc_part_id IF NOT EXISTS FOR (n:DocPart) REQUIRE n.part_id IS UNIQUE"
NODES = "UNWIND $rows AS row MERGE (n:DocPart {part_id: row.node_id}) SET n += row"
EDGES = "UNWIND $rows AS row MATCH (a:DocPart {part_id: row.parent_id}), (b:DocPart {part_id: row.child_id}) MERGE (a)-[e:PARENT_OF]->(b) SET e.child_ord = row.child_ord"


@dataclass(frozen=True)
class Bolt:
    """Opens sessions of a graph database that speaks Bolt; needs its Python driver on driver and executors."""

    uri: str
    user: str
    password: str
    database: str

    def __call__(self):
        try:
            from neo4j import GraphDatabase
        except ImportError as error:
            raise RuntimeError("writing to a graph store needs its Python driver") from error
        return GraphDatabase.driver(self.uri, auth=(self.user, self.password)).session(database=self.database)


def export(nodes: DataFrame, edges: DataFrame, connect, rows_per_batch: int = 1000) -> None:
    """Empty the store, then write nodes and edges (those whose ends exist). connect() opens a session with run(statement, rows=...) and
    close(); it is called on the driver once and once for each partition. Statements merge, so a task that is tried again does no harm."""
    none_of(nodes.groupBy("node_id").count().where("count > 1"), "ids must be unique")
    session = connect()
    try:
        session.run(WIPE)
        session.run(UNIQUE)
    finally:
        session.close()
    for rows, statement in ((nodes, NODES), (upsert_edges(edges, nodes), EDGES)):

        def send(part, statement=statement) -> None:
            session, held = None, []
            try:
                for row in part:
                    held.append(row.asDict(recursive=True))
                    if len(held) == rows_per_batch:
                        session = session or connect()
                        session.run(statement, rows=held)
                        held = []
                if held:
                    session = session or connect()
                    session.run(statement, rows=held)
            finally:
                if session is not None:
                    session.close()

        rows.foreachPartition(send)
