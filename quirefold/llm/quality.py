"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

The factors of a line are its own features, those of the lines before and after, and the labels of neighbours. Marginals from
the forward-backward recursions, weighted by the lines' lengths, give the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Spans, bounded, lower_ascii, mix, only, slices, words
from quirefold.llm.labels import fold, labelled_sample, logistic, sigmoid

#: Fixed byte classes whose shares of a line are features.
CLASSES = {"symbol": b"#*$%&<>@~^=+\\{}", "pipe": b"|", "shout": b"!?", "digit": b"0123456789", "stop": b".,;:", "upper": bytes(range(65, 91)), "other": bytes(range(128, 256))}
WIDTH = 2 * len(CLASSES) + 7


@dataclass(frozen=True)
class Model:
    emission: np.ndarray  # 3 * WIDTH + 1 weights towards bad
    transition: np.ndarray  # 2 x 2
    weights: tuple[float, float]  # of the logit of the good share, and the intercept
    prior: float


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes, features) of each line that has a word, in order."""
    rows = len(off) - 1
    start, end, _ = words(buf, off)
    newline = np.flatnonzero(buf == 10)
    head = np.unique(np.concatenate((newline + 1, off[:-1])))
    head = head[head < len(buf)]
    row = np.searchsorted(off, head, side="right") - 1
    tail = np.minimum(np.append(newline, len(buf))[np.searchsorted(newline, head)], off[row + 1])
    a, b = np.searchsorted(start, head), np.searchsorted(start, tail)
    has = b > a
    head, tail, row, a, b = head[has], tail[has], row[has], a[has], b[has]
    if not len(head):
        return row, head, np.zeros((0, WIDTH), np.float32)
    size, n = tail - head, b - a
    columns = []
    for members in CLASSES.values():
        member = np.zeros(256, bool)
        member[list(members)] = True
        total = np.concatenate(([0], np.cumsum(member[buf], dtype=np.int64)))
        share = (total[tail] - total[head]) / size
        columns += [np.sqrt(share), share > 0.08]
    spans = Spans(lower_ascii(buf))
    h = spans.hash(start, end)
    again = np.concatenate(([0], np.cumsum(np.concatenate(([False], h[1:] == h[:-1])), dtype=np.int64)))
    salt = mix(np.arange(len(head), dtype=np.uint64))
    key = h ^ np.repeat(salt, n) if b[-1] - a[0] == n.sum() == len(h) else h[np.concatenate([np.arange(x, y) for x, y in zip(a, b)])] ^ np.repeat(salt, n)
    line_of = np.repeat(np.arange(len(head)), n)
    _, once = np.unique(key, return_index=True)
    distinct = np.bincount(line_of[once], minlength=len(head)) / n
    whole = mix(spans.hash(head, tail) ^ mix(row.astype(np.uint64) + np.uint64(7)))
    _, seen = np.unique(whole, return_index=True)
    repeated = np.ones(len(head))
    repeated[seen] = 0
    columns += [np.log1p(n) / 4, size / n / 10, (again[b] - again[np.minimum(a + 1, b)]) / np.maximum(n - 1, 1), distinct, (distinct < 0.5), repeated, n <= 3]
    return row, size, np.column_stack(columns).astype(np.float32)


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before, of the line after (zero beyond the text), and 1."""
    n = len(row)
    out = np.zeros((n, 3 * x.shape[1] + 1), np.float32)
    w = x.shape[1]
    out[:, :w] = x
    joined = np.flatnonzero(row[1:] == row[:-1]) if n > 1 else np.zeros(0, int)
    out[joined + 1, w : 2 * w] = x[joined]
    out[joined, 2 * w : 3 * w] = x[joined + 1]
    out[:, -1] = 1
    return out


def marginals(row: np.ndarray, bad: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line, and the expected number of each pair of neighbouring labels, by forward-backward over all rows at
    once (place by place, the rows that are long enough). bad: the emission score towards bad."""
    n = len(row)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.append(first, n))
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    top = size[0]
    live = np.searchsorted(-size, -np.arange(top), side="left")  # rows of more than t lines
    t = np.exp(transition - transition.max())
    emit = np.column_stack([sigmoid(-bad), sigmoid(bad)])
    alpha = np.empty((n, 2))
    beta = np.ones((n, 2))
    alpha[first] = emit[first]
    alpha[first] /= alpha[first].sum(1, keepdims=True)
    for k in range(1, top):
        at = first[: live[k]] + k
        v = (alpha[at - 1] @ t) * emit[at]
        alpha[at] = v / v.sum(1, keepdims=True)
    for k in range(top - 2, -1, -1):
        at = first[: live[k + 1]] + k
        v = (beta[at + 1] * emit[at + 1]) @ t.T
        beta[at] = v / v.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(row[1:] == row[:-1])
    if len(inner):
        joint = alpha[inner][:, :, None] * t[None] * (beta[inner + 1] * emit[inner + 1])[:, None, :]
        pair = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return p[:, 1], pair


def fit_field(row: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent (Adam) on the conditional likelihood of the line labels y."""
    n = max(len(row), 1)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.flatnonzero(row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for k in range(1, steps + 1):
        p, pair = marginals(row, x @ w, t)
        g = np.concatenate([x.T @ (y - p) / n - ridge * w, ((seen - pair) / n - ridge * t).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.1 * state[0] / (1 - 0.9**k) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w = w + step[: len(w)]
        t = t + step[len(w) :].reshape(2, 2)
    return w, t


def good_share(row: np.ndarray, size: np.ndarray, bad: np.ndarray, rows: int) -> np.ndarray:
    """Logit of the length-weighted mean of P(good) of each row; nan for a row without lines."""
    total = np.bincount(row, weights=size, minlength=rows)
    good = np.bincount(row, weights=size * (1 - bad), minlength=rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.clip(good / total, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 3000, most_bytes: int = 40_000, most_lines: int = 500) -> Model:
    """Fit on at most `most` labelled rows, among them none of more than most_bytes bytes or most_lines lines, so the driver gets a bounded
    table: at most 92 bytes for each line.

    Lines begin with their document's label; after a first fit, lines of bad documents that look good are labelled good
    unless none would stay bad, and the field is fitted again. Without both classes each text gets the share of good labels.
    """
    sample = labelled_sample(docs, labels, "quality", folds, held_out, most).where((F.octet_length("text") <= most_bytes) & (F.size(F.split("text", "\n")) <= most_lines))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(1)):
                row, size, x = lines(buf, off)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                cells = [(size[a:b].astype("<i8").tobytes(), x[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["y", "size", "x"])

    found = sorted(sample.select("y", "text").mapInArrow(described, "y int, size binary, x binary").collect(), key=lambda r: (r["y"], bytes(r["x"])))
    labels_of = np.array([r["y"] for r in found], float)
    prior = float(labels_of.mean()) if len(found) else 0.5
    none = Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), (0.0, 0.0), prior)
    if not found or not 0 < prior < 1:
        return none
    sizes = [np.frombuffer(r["size"], "<i8") for r in found]
    row = np.repeat(np.arange(len(found)), [len(s) for s in sizes])
    size = np.concatenate(sizes)
    x = with_neighbours(row, np.frombuffer(b"".join(r["x"] for r in found), np.float32).reshape(-1, WIDTH)).astype(float)
    if not len(row):
        return none
    y = (1 - labels_of[row]).astype(int)
    w, t = fit_field(row, x, y, steps=80)
    bad, _ = marginals(row, x @ w, t)
    worst = np.zeros(len(found))
    np.maximum.at(worst, row, bad)
    y[(y == 1) & (bad < 0.3) & (worst[row] >= 0.5)] = 0
    w, t = fit_field(row, x, y)
    bad, _ = marginals(row, x @ w, t)
    share = good_share(row, size, bad, len(found))
    has = ~np.isnan(share)
    a, b = logistic(share[has][:, None], labels_of[has], ridge=1e-3)
    return Model(w, t, (float(a), float(b)), prior)


def quality(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default doc_id), score (0 to 1, higher is better) and bad_lines: P(bad) of each line with a word.

    Whole texts are scored; null and empty ones, and those without words, get the share of good training labels. Rows are
    independent; other columns are not read; no shuffle.
    """
    bounded(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(len(keep))):
                row, size, x = lines(buf, off)
                bad, _ = marginals(row, with_neighbours(row, x) @ model.emission, model.transition)
                share = good_share(row, size, bad, hi - lo)
                score = np.where(np.isnan(share), model.prior, sigmoid(model.weights[0] * np.nan_to_num(share) + model.weights[1])) if any(model.weights) else np.full(hi - lo, model.prior)
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(at), pa.array(bad, pa.float64()))], names=[*keep, "score", "bad_lines"])

    picked = docs.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text"))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, "score double", "bad_lines array<double>"]))


def held_out(doc_id, folds: int = 5, rest: int = 0):
    return fold(doc_id, folds) == rest
