"""Quality rules: suffix-array repetition within each text, beside plain counts.

The words of a text form a sequence; a suffix array with the longest common prefix of neighbouring suffixes gives, for
each position, the longest word sequence that begins there and occurs elsewhere in the text too. The maximal ones are the
repeats; the union of their spans is the covered part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SLICE_BYTES, Spans, bounded, mix, only, row_sums, slices, words

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A text is rejected beyond one of these. Spans shorter than `min_words` are no repeats.

    Words of repeats lie in repeated 3-word windows too, so a covered part of half or more adds nothing to the base rule; a
    repeat covers its length twice over, so `longest_percent` is less than half of `covered_percent`. Good texts repeat a line
    of up to 13 words, which is up to half of a short one: hence a covered part counts beyond `covered_words` only.
    """

    min_words: int = 4
    covered_percent: int = 30
    covered_words: int = 30
    longest_percent: int = 10
    longest_words: int = 30


def repeat_lengths(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the length of the longest sequence from there that also begins at another position of its row.

    ids: one integer for each word, equal for equal words of one row, never equal across rows; end: where the position's row
    ends. Ranks of suffixes by their first h items are doubled until all are single; the longest common prefixes of
    neighbours in the order of suffixes follow from the ranks kept for each h. O(n log n) per doubling, for the positions
    that are still tied only.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    firsts = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
    sizes = np.diff(np.append(firsts, n))
    rank[order] = np.repeat(firsts, sizes)  # a group's rank is its first place in the suffix array
    suffixes = order.copy()
    tied = np.repeat(sizes > 1, sizes)
    levels, places, h = [rank.copy()], np.flatnonzero(tied), 1
    repeated = places
    while len(places):
        at = suffixes[places]
        nxt = at + h
        second = np.where(nxt < end[at], rank[np.minimum(nxt, n - 1)], -1)
        key = rank[at].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        suffixes[places] = at  # groups keep their places: the rank is the greater part of the key
        new = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        rank[at] = np.repeat(places[starts], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        h *= 2
        if len(places):
            levels.append(rank.copy())
    upper = repeated[1:][np.diff(repeated) == 1]
    a, b = suffixes[upper - 1], suffixes[upper]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += equal.astype(np.int64) << k
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True for each of n places within one of the spans."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(buf: np.ndarray, off: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """Counts of each row, and its maximal repeats as (row, first word, words)."""
    rows = len(off) - 1
    start, end, first = words(buf, off)
    per_row = np.diff(first)
    row = np.repeat(np.arange(rows), per_row)
    spans = Spans(buf)
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    hashes = mix(spans.hash(start, end) ^ salt[row])
    longest = repeat_lengths(hashes, first[1:][row])
    n = len(start)
    triple = np.flatnonzero(longest >= 3)
    in_triple = covered(triple, np.full(len(triple), 3), n)
    previous = np.concatenate(([0], longest[:-1])) if n else longest
    long_ones = np.flatnonzero((longest >= limits.min_words) & (previous < longest + 1))
    in_repeat = covered(long_ones, longest[long_ones], n)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row, longest)

    newline = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate((newline + 1, off[:-1])))
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.append(newline, len(buf))[np.searchsorted(newline, line_start)]
    line_end = np.minimum(line_end, off[line_row + 1])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    key = mix(spans.hash(line_start, line_end) ^ salt[line_row])
    _, kept = np.unique(key, return_index=True)
    distinct = np.bincount(line_row[kept], minlength=rows)

    lead = (buf & 0xC0) != 0x80
    leads = np.concatenate(([0], np.cumsum(lead)))
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    return {
        "n_words": per_row,
        "word_chars": row_sums(leads[end] - leads[start], first),
        "n_symbols": row_sums(symbol[buf], off),
        "n_dup_lines": np.bincount(line_row, minlength=rows) - distinct,
        "n_repeat_words": row_sums(in_triple, first),
        "n_covered_words": row_sums(in_repeat, first),
        "longest_repeat": top,
        "span_row": row[long_ones],
        "span_start": long_ones - first[row[long_ones]],
        "span_words": longest[long_ones],
    }


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def repetition(docs: DataFrame, limits: Limits = Limits(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts, maximal repeats and a verdict for each row of docs.

    Columns: those of `keep` (default doc_id), the counts (long), repeats (array of structs of first word and words),
    base_failed (fewer than 50 words, or over half of them in repeated 3-word windows) and kept. kept is false if base_failed
    is true, or if the covered part or the longest repeat goes beyond `limits`. A null or empty text has no words and fails. Rows are independent (repeated rows give repeated results); other columns are not read. Equality
    of words and lines is that of 64-bit hashes. No shuffle; memory is some hundred bytes for each word of a slice of texts or of the longest text, and four
    bytes more for each doubling of its longest repeat.
    """
    bounded(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    at_text = keep.index(text) if text in keep else len(keep)  # a kept text isn't sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("repetition")
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(at_text), SLICE_BYTES // 2):
                m = measure(buf, off, limits)
                n = m["n_words"]
                base = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
                far = ((m["n_covered_words"] > limits.covered_words) & (100 * m["n_covered_words"] > limits.covered_percent * n)) | ((m["longest_repeat"] > limits.longest_words) & (100 * m["longest_repeat"] > limits.longest_percent * n))
                kept = ~(base | far)
                items = pa.StructArray.from_arrays([pa.array(m["span_start"], pa.int64()), pa.array(m["span_words"], pa.int64())], names=["first_word", "n_words"])
                at = np.searchsorted(m["span_row"], np.arange(hi - lo + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(at), items)
                cells = [c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]]
                cells += [pa.array(m[c], pa.int64()) for c in _COLUMNS] + [found, pa.array(base), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cells, names=[*keep, *_COLUMNS, "repeats", "base_failed", "kept"])

    picked = docs.select(*(F.col(c) for c in keep), *([] if text in keep else [F.col(text).cast("string").alias("__text")]))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in _COLUMNS]
    return picked.mapInArrow(run, ", ".join([*kinds, "repeats array<struct<first_word:long,n_words:long>>", "base_failed boolean", "kept boolean"]))
