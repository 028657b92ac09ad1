"""Settings: frozen dataclasses from YAML-like files, checked before any plan is made. Nothing is raised at import."""

from __future__ import annotations

import importlib
import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

OFFLINE = "quirefold.functions.models:Offline"
STEPS = {"index": "index", "ingest": "index", "tree": "tree", "all": "all"}


@dataclass(frozen=True)
class StructureConfig:
    """input_dir, with PDF files, below root_dir; storage_dir holds every table; the four fields of a graph store come all together or not at
    all. transcripts: a Parquet table (doc_id, filename, format, nb_pages, text) to be read instead of the files. provider and
    fallback: module:name of something that makes a provider of models."""

    root_dir: str
    input_dir: str
    storage_dir: str
    step: str = "all"
    workers: int = 32
    erase: bool = False
    chunk_size: int = 0
    graph_uri: str = ""
    graph_user: str = ""
    graph_password: str = ""
    graph_database: str = ""
    transcripts: str = ""
    provider: str = OFFLINE
    fallback: str = ""

    def __post_init__(self) -> None:
        graph = [self.graph_uri, self.graph_user, self.graph_password, self.graph_database]
        if any(graph) and not all(graph):
            raise ValueError("give all four settings of the graph store or none")
        if self.step not in STEPS:
            raise ValueError(f"step is one of {', '.join(STEPS)}")
        if self.workers <= 0:
            raise ValueError("workers must be positive")

    @property
    def steps(self) -> tuple[str, ...]:
        return {"index": ("index",), "tree": ("tree",), "all": ("index", "tree")}[STEPS[self.step]]


@dataclass(frozen=True)
class QueryConfig:
    root_dir: str
    storage_dir: str
    queries: list[str] = field(default_factory=list)
    workers: int = 16
    chunks_top_k: int = 5
    nodes_top_k: int = 10
    max_iterations: int = 20
    chunk_size: int = 1024
    provider: str = OFFLINE
    agents: bool = True

    def __post_init__(self) -> None:
        if min(self.workers, self.chunks_top_k, self.nodes_top_k, self.max_iterations) <= 0:
            raise ValueError("counts must be positive")


def parse(text: str) -> dict:
    """JSON, or the plain part of YAML: `key: value` lines and lists of `- item` below a key."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    last = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- "):
            if last is None:
                raise ValueError(f"an item without a key: {raw}")
            out[last] = [*(out[last] or []), _value(line.lstrip()[2:])]
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"neither a key nor an item: {raw}")
        last = key.strip()
        out[last] = _value(value)
    return out


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text or None


def load(kind: type, path: str):
    values = {k: v for k, v in parse(Path(path).read_text()).items() if v is not None}
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**values)


def environment(path: str = ".env") -> dict[str, str]:
    """The process's variables over those of a .env file, if there is one."""
    own = {}
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            key, eq, value = line.partition("=")
            if eq and not key.strip().startswith("#"):
                own[key.strip()] = value.strip().strip("\"'")
    return own | dict(os.environ)


def api_key(given: str | None, name: str, env: dict[str, str] | None = None) -> str:
    found = given or (env if env is not None else environment()).get(name)
    if not found:
        raise ValueError(f"give a key or set {name}")
    return found


def made(name: str):
    """What the callable module:name makes, called without arguments; None for an empty name."""
    if not name:
        return None
    module, colon, what = name.partition(":")
    if not colon:
        raise ValueError(f"{name} isn't module:name")
    return getattr(importlib.import_module(module), what)()
