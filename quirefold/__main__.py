"""python -m quirefold structure|query --config FILE"""

from __future__ import annotations

import argparse

from quirefold.plans.answer import Router, stored_index
from quirefold.plans.ingest import erase, ingest, read_documents, stored_documents, tree_index
from quirefold.scratch import Scope
from quirefold.session import session
from quirefold.sources.config import QueryConfig, StructureConfig, load, made
from quirefold.sources.graph_format import write_graph


def structure(config: StructureConfig) -> None:
    """PDF files (or transcripts) to stored documents with what models tell of them, then the tree, also to a graph store if one is set."""
    spark = session()
    with Scope() as made_here:
        provider = made(config.provider)
        if config.erase:
            erase(spark, config.storage_dir)
        if "index" in config.steps:
            if config.transcripts:
                docs = spark.read.parquet(config.transcripts)
            else:
                docs = read_documents(spark, config.input_dir, config.root_dir, f"{config.storage_dir}/transcripts", provider, made(config.fallback), config.workers)
            ingest(docs, config.storage_dir, provider)
        if "tree" in config.steps:
            nodes, edges = tree_index(stored_documents(spark, config.storage_dir), config.storage_dir)
            if config.graph_uri:
                write_graph(spark, nodes, edges, uri=config.graph_uri, user=config.graph_user, password=config.graph_password, database=config.graph_database)
    made_here.release()


def query(config: QueryConfig) -> None:
    """Prints the answer to each question: by agents that choose their tools, or (agents: false) by one fixed route."""
    spark = session()
    with Scope() as made_here:
        provider = made(config.provider)
        docs = stored_documents(spark, config.storage_dir)
        chunks, tools = stored_index(docs, config.storage_dir, provider, config.chunk_size)
        router = Router(chunks, tools, provider, config.chunks_top_k, config.nodes_top_k, config.max_iterations, config.workers)
        asked = spark.createDataFrame(list(enumerate(config.queries)), "query_id long, query string")
        if config.agents:
            for row in router.agents(asked).orderBy("query_id").collect():
                print(f"{row['query']}\n{row['response'] or 'no answer'}\n")
        else:
            for row in router.answer(asked).orderBy("query_id").collect():
                print(f"{row['query']}\n{row['response'] if row['status'] == 'ok' else row['error']}\n")
    made_here.release()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quirefold")
    parser.add_argument("command", choices=["structure", "query"])
    parser.add_argument("--config", required=True)
    given = parser.parse_args(args)
    if given.command == "structure":
        structure(load(StructureConfig, given.config))
    else:
        query(load(QueryConfig, given.config))


if __name__ == "__main__":
    main()
