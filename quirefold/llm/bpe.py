"""Byte-level BPE by longest matches and backtracking, and its inverse.

The ids equal those of the merge procedure on every input: a sequence of tokens is the merge result exactly when
every two neighbours are what merging their joined bytes gives, so the encoder takes the longest token at each
position, and steps back to shorter ones where a neighbour does not fit. Which neighbours fit is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import bounded, only

#: Distinct pre-tokens that a worker remembers, in two generations, and pairs of neighbours; memory is bounded and results are unaffected.
REMEMBERED = 250_000
#: Longer pre-tokens are encoded each time they occur.
REMEMBERED_BYTES = 64

_coders: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def narrow(pattern: str) -> str:
    r"""The pattern for the standard library's engine, right for texts of code points under 256: \p{..} and \s spelt out."""

    def spelt(name: str) -> str:
        return "".join(f"\\x{k:02x}" for k in range(256) if regex.match(name, chr(k)))

    out, inside, k = [], False, 0
    while k < len(pattern):
        if m := regex.match(r"\\p\{\w+\}|\\[sS]", pattern[k:]):
            found = spelt(m[0].lower() if m[0] == r"\S" else m[0])
            if inside and m[0] == r"\S":
                raise ValueError("\\S within a class can't be spelt out")
            out.append(found if inside else f"[^{found}]" if m[0] == r"\S" else f"[{found}]")
            k += len(m[0])
            continue
        step = 2 if pattern[k] == "\\" else 1
        inside = (inside or pattern[k] == "[") and pattern[k] != "]"
        out.append(pattern[k : k + step])
        k += step
    return "".join(out)


class Coder:
    """Encoder and decoder for one table of ranks (all 256 single bytes must have one) and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.find_narrow = re.compile(narrow(pattern)).findall
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits = _Memo(self.compatible, REMEMBERED)
        self.shorter = _Memo(self.next_shorter, REMEMBERED)
        self.known = _Pieces(self)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; twice itself where it is a single byte."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            parts = [bytes([b]) for b in whole]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Does merging the bytes of left and right leave just these two tokens? Undoes their merges, latest first, and
        sees whether the tokens at the border would have merged before the one that is undone."""
        ranks, name, length = self.ranks, self.bytes_of, self.length
        before = 1 << 60
        while True:
            joined = ranks.get(name[left] + name[right])
            if joined is not None and joined < before:
                return False
            if length[left] > 1 and (left > right or length[right] == 1):
                before, left = left, self.split(left)[1]
            elif length[right] > 1:
                before, right = right + 1, self.split(right)[0]  # of equal ranks the one further left merges first
            else:
                return True

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        whole = self.bytes_of[token]
        return next((r for n in range(len(whole) - 1, 0, -1) if (r := self.ranks.get(whole[:n])) is not None), -1)

    def from_each(self, letters: str) -> Callable[[int], int]:
        """Gives the longest token that begins at a position, from one pass over all matches."""
        found, length = [-1] * len(letters), self.length
        for end, token in self.matches.iter(letters):  # of those that end together the longest comes first
            at = end - length[token] + 1
            if found[at] < 0 or length[token] > length[found[at]]:
                found[at] = token
        return found.__getitem__

    def encode_piece(self, letters: str) -> list[int]:
        """The ids of one pre-token, given as Latin-1 letters of its bytes, in time linear in its length: no position fails twice.

        One pass of the automaton takes the longest token again and again; where all neighbours fit, that is the result.
        Else the search goes on from the first misfit.
        """
        if (whole := self.whole.get(letters)) is not None:
            return [whole]
        fits, length = self.fits, self.length
        taken = [token for _, token in self.matches.iter_long(letters)]
        at, size, good = 0, len(letters), 1
        if sum(map(length.__getitem__, taken)) == size:
            if all(map(fits.__getitem__, zip(taken, taken[1:]))):
                return taken
        else:
            raise ValueError("the ranks lack a byte of the text")
        while fits[taken[good - 1], taken[good]]:
            good += 1
        out, token = taken[:good], taken[good]
        at = sum(map(length.__getitem__, out))
        shorter = self.shorter
        longest = self.from_each(letters) if size > 256 else lambda k: next(self.matches.iter_long(letters, k))[1]
        closed: set[int] = set()  # positions from which no way leads to the end
        while at < size:
            if out:
                last = out[-1]
                while token >= 0 and (not fits[last, token] or at + length[token] in closed):
                    token = shorter[token]
            else:
                while token >= 0 and at + length[token] in closed:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest(at) if at < size else -1
            else:
                closed.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def pieces(self, text: str) -> list[str]:
        """All matches of the pattern; texts of code points under 256 take a faster way to the same."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_narrow(text)

    def encode(self, text: str) -> array:
        out = array("I")
        out.frombytes(b"".join(map(self.known.__getitem__, self.pieces(text))))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Pre-token to ids, as the bytes of 32-bit integers. Two generations: once this one is full it becomes the older one, from
    which what is met again moves over, and the one before goes. So what is frequent stays."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.coder.encode_piece(piece if piece.isascii() else piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Memo(dict):
    """Remembers a function of one key (a tuple is spread)."""

    def __init__(self, of: Callable, most: int):
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.of(*key) if type(key) is tuple else self.of(key)
        return found


def _shared(table: bytes, pattern: str) -> Coder:
    """One coder for each worker process and table, built at its first use."""
    key = hashlib.sha256(table + pattern.encode()).hexdigest()
    if key not in _coders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs with its ids (binary: little-endian unsigned 32-bit), their number and the decoded bytes.

    Whole texts are encoded, without special tokens; a null text counts as empty and gives no ids. The columns named in
    `keep` (default doc_id) pass through unchanged, whatever else docs holds is not read. Rows are independent: repeated
    rows give repeated results and an empty table an empty one. No shuffle; memory is one text and the bounded memo.
    The table of ranks (about 1 MB) is read on the driver and travels with the function.
    """
    spark: SparkSession = docs.sparkSession
    bounded(spark)
    keep = ["doc_id"] if keep is None else keep
    at = keep.index(text) if text in keep else len(keep)  # a kept text isn't sent twice
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe", _coders.clear)
        coder = _shared(shared.value, pattern)
        for batch in batches:
            column = batch.column(at)
            sizes = [0 if v is None else v for v in pc.binary_length(column).to_pylist()]
            lo = 0
            while lo < len(sizes):
                hi, held = lo, 0
                while hi < len(sizes) and (hi == lo or hi - lo < 256 and held + sizes[hi] <= 1 << 20):
                    held += sizes[hi]
                    hi += 1
                ids, counts, plain = [], [], []
                for value in column.slice(lo, hi - lo):
                    found = coder.encode(value.as_py() or "")
                    counts.append(len(found))
                    plain.append(coder.decode(found))
                    if sys.byteorder == "big":
                        found.byteswap()
                    ids.append(found.tobytes())
                kept = [c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(plain, pa.binary())], names=[*keep, "n_tokens", "ids", "decoded"])
                lo = hi

    picked = docs.select(*(F.col(c) for c in keep), *([] if text in keep else [F.col(text).cast("string").alias("__text")]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, n_tokens long, ids binary, decoded binary")
