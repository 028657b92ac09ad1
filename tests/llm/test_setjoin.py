"""Set joins by relations between sets against brute force: every pair of full sets."""

import random

import numpy as np
import pytest

from conftest import DATA
from quirefold.llm import setjoin
from quirefold.llm.common import table
from quirefold.llm.queries import QUERIES
from quirefold.llm.setjoin import Joining, jaccard_components, prefix_length, profile
from test_llm import sets_of


def wanted(rows, k, percent):
    """Components by counting what each pair of sets shares, element by element."""
    sets = sets_of(rows, k)
    ids = sorted(sets)
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    holders: dict = {}
    for i in ids:
        shared: dict = {}
        for e in sets[i]:
            for j in holders.setdefault(e, []):
                shared[j] = shared.get(j, 0) + 1
            holders[e].append(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def got_of(spark, rows, how, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = jaccard_components(docs, how).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def changed(random_, words, most):
    w = list(words)
    for _ in range(random_.randint(0, most)):
        at = random_.randrange(len(w) + 1)
        kind = random_.randrange(3)
        if kind == 0:
            w.insert(at, f"n{random_.randrange(400)}")
        elif w and at < len(w):
            if kind == 1:
                w[at] = f"n{random_.randrange(400)}"
            else:
                del w[at]
    return w


@pytest.mark.parametrize(("k", "percent", "short"), [(3, 90, 8), (3, 90, 1), (1, 60, 2)])
def test_as_all_pairs(spark, monkeypatch, k, percent, short):
    """Families of texts that drift from their first one; lists of any length go by their leading set where short is 1."""
    monkeypatch.setattr(setjoin, "SHORT_LIST", short)
    r = random.Random(k * percent + short)
    rows = [(d.doc_id, d.text) for d in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    for f in range(12):
        words = [f"f{f}w{n}" if f % 3 else f"w{r.randrange(60)}" for n in range(r.choice([2, 4, 20, 60, 120, 300]))]
        for n in range(60):
            rows.append((10_000 + 100 * f + n, " ".join(changed(r, words, 10) if n % 7 else changed(r, rows[-1][1].split(), 3))))
    rows += [(20_001, "A b"), (20_002, "a  B"), (20_003, None), (20_004, " \n")]
    assert got_of(spark, rows, Joining(k, percent)) == wanted(rows, k, percent)


@pytest.mark.parametrize("seed", [0])
def test_around_a_hub(spark, seed):
    """Texts that share most of a hub's words and are linked to it or not, and to each other or not; families of differences in common."""
    r = random.Random(seed)
    base = [f"h{n}" for n in range(200)]
    rows = [(0, " ".join(base))]
    for n in range(1, 1800):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            at = r.randrange(len(w))
            w[at : at + r.choice([1, 2])] = [f"v{r.randrange(6)}x{at // 40}"] if n % 3 else [f"s{n}"]
        rows.append((n, " ".join(w)))
    rows += [(5000 + n, " ".join([*base[:150], *(f"p{n}x{k}" for k in range(60))])) for n in range(80)]
    assert got_of(spark, rows, Joining(3, 90)) == wanted(rows, 3, 90)


def test_whole_table(spark):
    folder = DATA.replace("0.001", "0.01")
    rows = [(d.doc_id, d.text) for d in table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_set_relations"](spark, folder).collect()}
    assert got == wanted(rows, 3, 90) and len({c for _, c in got.values()}) < len(got)


def test_rows_of_one_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, "other words stand here"), (2, text + " more"), (None, text), (3, None), (3, "")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Joining(3, 90)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("1", 58, "1"), ("1", 58, "1"), ("1", 2, "1"), ("2", 59, "1"), ("None", 58, "None"), ("3", 0, "3"), ("3", 0, "3")])


def test_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m, c = rng.integers(1, 400, 3)
        common = rng.integers(0, 1 << 63, c, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (n, m))
        assert np.abs(profile(a).astype(int) - profile(b)).sum() <= len(np.setxor1d(a, b))
    assert [prefix_length(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]
    with pytest.raises(ValueError, match="percent"):
        Joining(percent=100)
