"""Token counts under a unigram model, by dynamic programming that shares the work on common prefixes.

Distinct pre-tokens go into a trie of their bytes. A node holds the best score of any segmentation of its prefix and the number
of tokens of that segmentation; both follow from the nodes above it, so they are computed once for each shared prefix. The node
at which a pre-token ends stores its count.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.bpe import narrow
from quirefold.llm.common import bounded, only

#: Nodes and pre-tokens that a worker keeps before it starts afresh; results are unaffected.
MOST_NODES, MOST_KNOWN = 1_500_000, 600_000
#: Longer pre-tokens are counted without the trie, in the same way.
TRIE_BYTES = 64

_tries: dict = {}


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """log-probability of each token under Zipf's law over its rank: -log(rank + 1), less the logarithm of the sum. Nothing is
    trained; the vocabulary's order is all that is used."""
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - norm for token, r in ranks.items()}


class Trie:
    """Nodes are numbers; `below` maps (node, byte) to a node. The scores must cover every single byte."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.endings = self._endings(scores)
        self.longest = max(map(len, scores))
        self.clear()

    @staticmethod
    def _endings(scores: dict[bytes, float]) -> dict:
        """The tokens as a trie of reversed bytes: for each last byte a dict on to the byte before it; None holds the score."""
        root: dict = {}
        for token, score in scores.items():
            node = root
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = score
        return root

    def clear(self) -> None:
        self.below: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def step(self, piece: bytes, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score of piece[:end] and its number of tokens, from those of all shorter prefixes. Of equal scores the one with
        fewer tokens counts."""
        node, k = self.endings, end
        top, least = -math.inf, 0
        while k:
            node = node.get(piece[k - 1])
            if node is None:
                break
            k -= 1
            score = node.get(None)
            if score is not None:
                score += best[k]
                if score > top or score == top and tokens[k] + 1 < least:
                    top, least = score, tokens[k] + 1
        return top, least

    def count(self, piece: bytes) -> int:
        best, tokens = [0.0], [0]
        if len(piece) > TRIE_BYTES:
            for end in range(1, len(piece) + 1):
                score, n = self.step(piece, end, best, tokens)
                best.append(score)
                tokens.append(n)
            return tokens[-1]
        if len(self.best) > MOST_NODES:
            self.clear()
        at, below = 0, self.below
        for end, byte in enumerate(piece, 1):
            nxt = below.get(at << 8 | byte)
            if nxt is None:
                score, n = self.step(piece, end, best, tokens)
                nxt = below[at << 8 | byte] = len(self.best)
                self.best.append(score)
                self.tokens.append(n)
            at = nxt
            best.append(self.best[at])
            tokens.append(self.tokens[at])
        return self.tokens[at]


class _Known(dict):
    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, piece: str) -> int:
        n = self.trie.count(piece.encode())
        if len(piece) <= TRIE_BYTES:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[piece] = n
        return n


def _shared(table: bytes, pattern: str):
    import re

    import regex

    key = hashlib.sha256(table + pattern.encode()).hexdigest()
    if key not in _tries:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        _tries[key] = _Known(Trie(zipf_scores(ranks))), regex.compile(pattern).findall, re.compile(narrow(pattern)).findall
    return _tries[key]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default doc_id), n_pretokens and n_tokens (long): matches of the pattern in the whole text, and tokens
    of their best segmentations.

    A null or empty text has none. Rows are independent; other columns are not read; no shuffle. The table of ranks (about 1 MB)
    is read on the driver and travels with the function.
    """
    bounded(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("counts", _tries.clear)
        known, wide, fast = _shared(shared.value, pattern)
        for batch in batches:
            pieces, tokens = [], []
            for value in batch.column(len(keep)):
                t = value.as_py() or ""
                try:
                    t.isascii() or t.encode("latin-1")
                    found = fast(t)
                except UnicodeEncodeError:
                    found = wide(t)
                pieces.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_pretokens", "n_tokens"])

    picked = docs.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, n_pretokens long, n_tokens long")
