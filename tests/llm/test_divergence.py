"""The audit of sources against a plain count, with many sources in small blocks and cells, and by its SQL (test_llm.py)."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirefold.llm import divergence as D
from quirefold.llm.divergence import Audit, divergence, share

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, how):
    df, n = Counter(), Counter()
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = TERM.findall((text or "").translate(LOW))
        df.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    out = set()
    for lang, names in sources.items():
        kept = [t for (x, t), c in df.items() if x == lang and c >= how.least_documents]
        of = {s: sum(n[lang, s, t] for t in kept) + how.smoothing * len(kept) for s in names}
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + how.smoothing) // of[s] for t in kept} for s in names}
        every = sum(of.values()) - how.smoothing * len(kept) * (len(names) - 1)
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in names) + how.smoothing) // every for t in kept}
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), "pair") for o in names if o != s]
            terms = sorted((q[t] - p[s][t], t.encode(), "term") for t in kept if n[lang, s, t] and p[s][t] > q[t])[: how.top_terms]
            for part in (sorted(pairs), terms):
                out |= {(lang, s, kind, item.decode(), -v, k + 1) for k, (v, item, kind) in enumerate(part)}
    return out


def rows_of(n, sources, seed):
    random.seed(seed)
    words = ["the", "The", "été", "漢字", "a1b", "x", "straße", "İ", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "de", None]), random.choice([f"s{k * k % sources}" for k in range(sources)] + [None])) for _ in range(n)]
    return [*rows, *rows[:20], (None, "en", "empty"), ("", "xx", "alone"), ("rare words", "yy", "a"), ("rare words", "yy", "b"), (None, None, None)]


@pytest.mark.parametrize(("block", "cell", "gathered"), [(512, 1 << 18, 24 << 20), (3, 40, 2000)])
def test_as_counted(spark, monkeypatch, block, cell, gathered):
    for name, value in (("BLOCK_SOURCES", block), ("CELL_ROWS", cell)):
        monkeypatch.setattr(D, name, value)
    how = Audit(least_documents=12, top_terms=5)
    rows = rows_of(400, 30, 4)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence(docs, how).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows, how)
    assert {(r.part, r.value) for r in got if r.lang == "yy"} == {("pair", 0)} and not any(r.lang == "xx" for r in got)


def test_runs_are_handed_on(monkeypatch):
    """A task that may hold few bytes hands on more runs, which say the same in sum."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 300, "source": [f"s{k % 7}" for k in range(600)], "text": [f"a b{k % 50} c" for k in range(600)]})
    once = pa.Table.from_batches(D._runs(iter([batch])))
    monkeypatch.setattr(D, "GATHERED", 100)
    monkeypatch.setattr(D, "slices", lambda texts: ((k, k + 1, np.frombuffer(texts[k].as_py().encode(), np.uint8), np.array([0, len(texts[k].as_py())])) for k in range(len(texts))))
    often = pa.Table.from_batches(D._runs(iter([batch])))
    key = lambda t: sorted(zip(*(c.to_pylist() for c in D._summed([t]).columns)))
    assert often.num_rows > once.num_rows and key(once) == key(often)


def test_a_term_that_goes_on_over_batches():
    import pyarrow as pa

    rows = [("en", t, s, 1, n) for t in "abc" for s in ("x", "y") for n in (1, 2, 3)]
    whole = pa.table([list(c) for c in zip(*rows)], names=["lang", "term", "source", "docs", "n"])
    for size in (1, 2, 5, 100):
        got = pa.Table.from_batches(D._kept(6)(iter(whole.to_batches(size))))
        assert [tuple(r.values()) for r in got.to_pylist()] == [("en", t, s, 6, 12, s == "x") for t in "abc" for s in ("x", "y")]


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    of = rng.integers(1, 9 * 10**15, 2000)
    n = (of * rng.random(2000)).astype(np.int64)
    assert share(n, of).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), of.tolist())]
    with pytest.raises(ValueError, match="occurrences"):
        share(np.array([1]), np.array([1 << 60]))


def test_an_open_term_keeps_its_sources_in_order(monkeypatch):
    """Sums come in any order; a source that goes on in the next batch must still meet its earlier rows."""
    import pyarrow as pa

    summed = D._summed
    monkeypatch.setattr(D, "_summed", lambda parts: summed(parts).sort_by([("source", "descending")]))
    rows = [("en", "a", s, 1, 1) for s in ("x", "y", "z") for _ in range(4)]
    whole = pa.table([list(c) for c in zip(*rows)], names=["lang", "term", "source", "docs", "n"])
    got = pa.Table.from_batches(D._kept(6)(iter(whole.to_batches(5))))
    assert sorted((r["source"], r["n"], r["total"]) for r in got.to_pylist()) == [("x", 4, 12), ("y", 4, 12), ("z", 4, 12)]
