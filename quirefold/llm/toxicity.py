"""Toxicity: maximum-scoring segments of token log-odds.

Each word scores its log-odds between toxic and other training documents, smoothed by Dirichlet priors in proportion to
the labelled sample that is fitted (not to the whole corpus: beyond `most` rows it doesn't grow with the table), shrunk as far as the
sample says little of it, less a drift that makes the score of clean text fall. Decisive words score as they are. A word without a
score of its own takes that of the longest decisive stem that it begins with; a stem is decisive only if it begins several words of
the sample and nearly all of these are toxic (clean ones keep their own odds), so one toxic word says nothing of words that begin
alike. All maximal scoring segments
of a text come from one linear scan. Scores of the best segments of clean texts follow an extreme-value distribution, by which a segment's
score is turned into a p-value whatever the text's length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Scratch, bounded, only, slices
from quirefold.llm.labels import fold, labelled_sample, logistic, sigmoid
from quirefold.llm.neardup import shingle_sets

#: Fixed characters stripped from both ends of a word.
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|-_/\\…“”„«»‘’–—¿¡"
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 250_000
PREFIXES = (4, 5, 6, 7, 8)
#: What a clean word scores in the mean, below zero, and how many toxic words a stem begins at least.
DRIFT, FAMILY = 0.5, 3
#: z at which half of the odds of a word that is not decisive counts.
HALF_Z = 3.0
#: Rounds in which decisive features are found, each among the rows that those before don't explain.
ROUNDS = 6
#: Scores of words are counted in steps of this, from LOWEST on.
STEP, LOWEST = 0.05, -8.0


@dataclass(frozen=True)
class Model:
    """lexicon: score of each word of the sample and of each decisive prefix (followed by an asterisk); rest: the score of others."""

    lexicon: dict[str, float]
    rest: float
    rate: float  # lambda of the score system
    place: float  # of the extreme-value distribution of rate * score - log(words)
    scale: float
    weights: tuple[float, float]
    prior: float


def features(word: str) -> list[str]:
    """The word and its prefixes, longest first."""
    return [word, *(word[:n] + "*" for n in reversed(PREFIXES) if len(word) >= n)]


def normal(raw: str) -> str:
    return raw.strip(EDGES).lower()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence of scores, in one scan over the positive ones.

    Candidates lie on a stack with the running sums before and after them; each knows the last one below it whose sum before is
    smaller, so those between are looked at once and the scan takes linear time.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    at = np.flatnonzero(scores > 0)
    first, end, left, right, link = [], [], [], [], []
    for k, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        start = k
        j = len(first) - 1
        while True:
            while j >= 0 and left[j] >= before:
                j = link[j]
            if j < 0 or right[j] >= after:
                break
            start, before = first[j], left[j]  # all from there on become one
            below = link[j]
            for stack in (first, end, left, right, link):
                del stack[j:]
            j = below
        first.append(start)
        end.append(k + 1)
        left.append(before)
        right.append(after)
        link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(first, end, left, right)]


class Scorer:
    def __init__(self, lexicon: dict[str, float], rest: float):
        self.known = _Words(lexicon, rest)

    def scores(self, text: str) -> np.ndarray:
        return np.array(list(map(self.known.__getitem__, text.split())), float)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        found = list(map(self.known.__getitem__, text.split()))
        return len(found), maximal_segments(np.array(found)) if max(found, default=0.0) > 0 else []


class _Words(dict):
    def __init__(self, lexicon: dict[str, float], rest: float):
        self.lexicon, self.rest = lexicon, rest

    def __missing__(self, raw: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = score = next((self.lexicon[f] for f in features(normal(raw)) if f in self.lexicon), self.rest)
        return score


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y, mark): texts that are copies but for a few words mostly have one mark, the least hash of their 5-word shingles."""
    for batch in batches:
        for lo, hi, buf, off in slices(batch.column(0)):
            marks = [int(x[0].view(np.int64)) if len(x) else 0 for x in shingle_sets(buf, off, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(marks, pa.int64())], names=["text", "y", "mark"])


def _counts(decided):
    """Gives (feature, rows with it that are toxic, others) of parts of each partition; '' stands for all rows. Rows that hold a decided
    feature are explained by it and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        known = decided.value
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def part() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][f] for f in names], pa.int64()), pa.array([found[0][f] for f in names], pa.int64())], names=["feature", "toxic", "other"])
            found[0].clear()
            found[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                held = {f for w in {normal(raw) for raw in (text.as_py() or "").split()} if w for f in features(w)}
                if known and not known.keys().isdisjoint(held):
                    continue
                found[y][""] += 1
                found[y].update(held)
                if len(found[0]) + len(found[1]) > REMEMBERED:
                    yield part()
        yield part()

    return run


def _begun() -> Column:
    """The stems that a feature begins with, each followed by an asterisk."""
    return F.filter(F.array(*(F.when(F.char_length("feature") >= n, F.concat(F.substring("feature", 1, n), F.lit("*"))) for n in PREFIXES)), F.isnotnull)


def _stems(words: DataFrame) -> DataFrame:
    """(stem) of those that begin at least FAMILY whole words seen as often in toxic rows as in others, or more often, and of other words no
    more than one to four of these, which then keep a score of their own."""
    toxic = F.col("a") >= F.col("b")
    told = words.select(F.explode(_begun()).alias("stem"), toxic.cast("int").alias("toxic"), (~toxic).cast("int").alias("clean"))
    sums = told.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return sums.where((F.col("toxic") >= FAMILY) & (4 * F.col("clean") <= F.col("toxic"))).select("stem")


def _adds(row, rows: dict) -> bool:
    """Whether a feature is decisive beyond the longer ones that it begins: what they leave of its rows must not be mostly others."""
    if not row["feature"].endswith("*"):
        return True
    stem = row["feature"][:-1]
    longer = [r for f, r in rows.items() if f != row["feature"] and f.startswith(stem)]
    best = max(longer, key=lambda r: (r["a"], -r["b"]), default=None)
    return best is None or row["a"] - best["a"] >= row["b"] - best["b"]


def evidence(segments: list[tuple[int, int, float]], n: int, rate: float, place: float, scale: float) -> float:
    """Sum over the significant segments of how far beyond chance each scores, in units of the extreme-value scale."""
    away = math.log(max(n, 1)) + place
    return sum(max(0.0, (rate * s - away) / scale) for _, _, s in segments)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, most: int = 20_000, most_bytes: int = 200_000, prior: float = 0.05, decisive: float = 3.5, least_rows: int = 5) -> Model:
    """Fit on at most `most` labelled rows, among them none of more than most_bytes bytes. prior: weight of the Dirichlet prior as a
    share of the sample; decisive: least z of a feature that may score above 0; least_rows: rows that a word must be in for a
    score of its own.

    Of copies but for a few words one counts. Decisive features are words, or stems as said above, in more toxic rows than others, also
    beyond the longer features that they begin, and have at least half the greatest z of their round; rows that hold one are explained and left out of the next
    round, where a feature must be in a tenth of the toxic rows that are left. So words that only go along with decisive ones don't become so. Counts are made where the texts are; the driver gets words of least_rows rows and decisive features, at most
    all words of the bounded sample. Without both classes there is no lexicon and each text gets the share of toxic labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chosen = labelled_sample(docs, labels, "toxic", folds, held_out, most).where(F.octet_length("text") <= most_bytes).select("text", "y")
    sample = scratch.write(chosen.mapInArrow(_marked, "text string, y int, mark long").dropDuplicates(["mark", "y"]), "sample", most, 4096)
    totals = sample.agg(F.sum("y").alias("a"), F.count("*").alias("n")).first()
    n1, n0 = totals["a"] or 0, totals["n"] - (totals["a"] or 0)
    base = n1 / max(n1 + n0, 1)
    none = Model({}, -1.0, 1.0, 0.0, 1.0, (0.0, 0.0), base)
    if not n1 or not n0:
        scratch.drop(sample)
        return none
    plain: dict[str, float] = {}
    decided: dict[str, float] = {}
    down = DRIFT
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(decided)
        counts = sample.mapInArrow(_counts(sent), "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
        told = (F.col("a") >= 3) & (F.col("a") >= F.col("b"))
        if not turn:
            told = told | (~F.endswith("feature", F.lit("*")) & (F.col("a") + F.col("b") >= least_rows))
        if not turn:
            counts = scratch.write(counts, "counts")
            words = counts.where((F.col("feature") != "") & ~F.endswith("feature", F.lit("*")))
            stems = scratch.write(_stems(words), "stems")
        counts = counts.where((F.col("feature") == "") | told).join(stems, F.col("feature") == F.col("stem"), "left")
        rows = {r["feature"]: r for r in counts.where(~F.endswith("feature", F.lit("*")) | F.col("stem").isNotNull()).collect()}
        n1, n0 = (rows[""]["a"], rows[""]["b"]) if "" in rows else (0, 0)
        if not n1 or not n0:
            break
        weight = prior * (n1 + n0)

        def odds(r) -> tuple[float, float]:
            """Log-odds of a feature under the Dirichlet prior, and their z."""
            share = (r["a"] + r["b"]) / (n1 + n0)
            up, down = r["a"] + weight * share, r["b"] + weight * share
            found = math.log(up / (n1 + weight - up)) - math.log(down / (n0 + weight - down))
            return found, found / math.sqrt(1 / up + 1 / down)

        rated = {f: odds(r) for f, r in rows.items() if f}
        if not turn:
            plain = {f: d * z * z / (z * z + HALF_Z**2) for f, (d, z) in rated.items() if not f.endswith("*") and rows[f]["a"] + rows[f]["b"] >= least_rows}
            said = sum(rows[f]["b"] for f in plain)
            down = max(0.0, sum(rows[f]["b"] * d for f, d in plain.items()) / max(said, 1)) + DRIFT
            plain = {f: round(d - down, 3) for f, d in plain.items()}
        least = 3 if not turn else max(5.0, 0.1 * n1)
        sure = {f: dz for f, dz in rated.items() if rows[f]["a"] >= max(least, rows[f]["b"]) and dz[1] >= decisive and dz[0] >= 2.0}
        top = max((z for _, z in sure.values()), default=0.0)
        best = {f: rows[f] for f, (_, z) in sure.items() if z >= top / 2}
        found = {f: min(sure[f][0], 6.0) for f, r in best.items() if _adds(r, best)}
        if not found:
            break
        decided = found | decided
    if not decided:
        scratch.drop(sample)
        return none
    # words seen clean are no part of a decisive stem: they keep their odds, or that of a word unseen; others under it score as it does
    chosen_stems = [f for f in decided if f.endswith("*")]
    clean = {r["feature"] for r in words.where((F.col("a") < F.col("b")) & F.arrays_overlap(_begun(), F.array(*map(F.lit, chosen_stems)))).collect()} if chosen_stems else set()
    lexicon = {w: s for w, s in plain.items() if not any(f in decided for f in features(w)[1:])} | {w: min(plain.get(w, -down), -down) for w in clean} | decided
    shared = spark.sparkContext.broadcast(lexicon)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        scorer = Scorer(shared.value, -down)
        total = np.zeros(int((8 - LOWEST) / STEP) + 2, np.int64)
        names, kinds = ["y", "scores", "n", "bins"], [pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found = scorer.scores(text.as_py() or "")
                if not y:
                    total += np.bincount(np.clip(np.rint((found - LOWEST) / STEP), 0, len(total) - 1).astype(int), minlength=len(total))
                rows.append((y, [s for _, _, s in maximal_segments(found)], len(found), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((None, None, None, total.tolist()), kinds)], names=names)

    found = sample.mapInArrow(scored, "y int, scores array<double>, n long, bins array<long>").collect()
    scratch.drop(sample)
    bins = np.sum([r["bins"] for r in found if r["bins"] is not None], axis=0)
    rows = [r for r in found if r["bins"] is None]
    clean = [r for r in rows if not r["y"]]
    values = LOWEST + STEP * np.arange(len(bins))
    share_of = bins / max(bins.sum(), 1)

    def mass(x: float) -> float:  # expected e^(x * score) of a clean word
        return float((share_of * np.exp(np.minimum(x * values, 600.0))).sum())

    low, high = 1e-3, 4.0  # without a hit in clean texts the sum never comes back to 1, and the rate is the greatest
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < 1 else (low, mid)
    rate = low
    tops = np.array([rate * max(r["scores"], default=0.0) - math.log(max(r["n"], 1)) for r in clean])
    scale = max(float(tops.std()) * math.sqrt(6) / math.pi, 0.25)  # by moments
    place = float(tops.mean()) - 0.5772156649 * scale
    x = np.array([math.log1p(evidence([(0, 0, s) for s in r["scores"]], r["n"], rate, place, scale)) for r in rows])
    a, b = logistic(x[:, None], np.array([float(r["y"]) for r in rows]), ridge=1e-3)
    return Model(lexicon, -down, rate, place, scale, (float(a), float(b)), base)


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default doc_id), score (0 to 1) and passages: the significant segments as structs of first word, end
    word, score and p-value.

    Whole texts are scored; null and empty ones have no passage and get the score of no evidence. Rows are independent; other
    columns are not read; no shuffle. The model's lexicon (words of a bounded sample) is broadcast.
    """
    keep = ["doc_id"] if keep is None else keep
    bounded(docs.sparkSession)
    shared, known = docs.sparkSession.sparkContext.broadcast(model.lexicon), bool(model.lexicon)
    weights, rate, place, scale, prior, rest = model.weights, model.rate, model.place, model.scale, model.prior, model.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        scorer = Scorer(shared.value, rest)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(len(keep)):
                n, found = scorer.segments(value.as_py() or "")
                beyond = evidence(found, n, rate, place, scale)
                scores.append(prior if not known else float(sigmoid(np.float64(weights[0] * math.log1p(beyond) + weights[1]))))
                chance = [(a, e, s, -math.expm1(-math.exp(min(50.0, -(rate * s - math.log(max(n, 1)) - place) / scale)))) for a, e, s in found]
                passages.append([dict(zip(("first_word", "end_word", "score", "p_value"), c)) for c in chance if c[3] < 0.05])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*keep, "score", "passages"])

    picked = docs.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("__text"))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return picked.mapInArrow(run, ", ".join([*kinds, "score double", "passages array<struct<first_word:long,end_word:long,score:double,p_value:double>>"]))


def held_out(doc_id, folds: int = 4, rest: int = 2):
    return fold(doc_id, folds) == rest
