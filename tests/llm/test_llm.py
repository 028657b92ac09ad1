"""The ten operators against brute force, an exact round trip, SQL or held-out accuracy."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quirefold.llm import licenses, quality, toxicity
from quirefold.llm.bpe import Coder, encode_documents, load_ranks
from quirefold.llm.common import table
from quirefold.llm.counts import Trie, count_tokens, zipf_scores
from quirefold.llm.graph import components
from quirefold.llm.licenses import license_scan
from quirefold.llm.linedup import drop_lines, duplicate_lines, within_one_edit
from quirefold.llm.mixing import budgets, mix
from quirefold.llm.neardup import Sketching, joint_estimate, near_duplicates, shingle_sets, sketch
from quirefold.llm.queries import ORACLES, QUERIES
from quirefold.llm.repetition import repetition
from quirefold.llm.topk import QUERY_LEAF, Best, Block, cover_tree, search, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return table(spark, DATA, "documents")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return Coder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), P


def test_bpe_as_merges(tokenizer):
    coder, other, _ = tokenizer
    random.seed(1)
    alphabets = ["ab", "abcde ", "aaab\n ", "thein ", "éèa ", "0123 ", "漢字かな", "!?#. '", "".join(map(chr, range(32, 1000)))]
    for _ in range(600):
        letters = random.choice(alphabets)
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 120)))
        assert list(coder.encode(text)) == other.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()
    long = "ab" * 50_000 + " \x1c\x85 x"
    assert list(coder.encode(long)) == other.encode_ordinary(long)


def test_every_token_is_a_merge(tokenizer):
    coder = tokenizer[0]
    assert all(coder.split(i) != (i, i) for i, b in coder.bytes_of.items() if len(b) > 1)


def test_bpe_on_documents(spark, tokenizer):
    _, other, P = tokenizer
    rows = encode_documents(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id", "text"]).collect()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(r.text) and r.n_tokens * 4 == len(r.ids) and bytes(r.decoded) == r.text.encode()


# ---- token counts


def test_counts_as_viterbi(spark):
    scores = zipf_scores({t: k for k, t in enumerate([bytes([b]) for b in range(256)] + [b"th", b"he", b"the", b"in", b"ing", b"ththe"])})
    trie = Trie(scores)
    random.seed(2)
    for _ in range(500):
        piece = "".join(random.choice("theing") for _ in range(random.randint(0, 90))).encode()
        best = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            best.append(max((best[k][0] + scores[piece[k:end]], best[k][1] - 1) for k in range(max(0, end - 5), end) if piece[k:end] in scores))
        assert trie.count(piece) == -best[-1][1]


def test_counts_of_the_table(spark, tokenizer):
    """The query's rows against best segmentations of every pre-token of every whole text, piece by piece."""
    import regex

    coder, _, P = tokenizer
    scores = zipf_scores(coder.ranks)
    find, known = regex.compile(P.PATTERN).findall, {}
    longest = max(map(len, scores))

    def best(piece):
        if piece not in known:
            found = [(0.0, 0)]
            for end in range(1, len(piece) + 1):
                found.append(max((found[k][0] + scores[piece[k:end]], found[k][1] - 1) for k in range(max(0, end - longest), end) if piece[k:end] in scores))
            known[piece] = -found[-1][1]
        return known[piece]

    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = QUERIES["op2_trie_counts"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        pieces = find(texts[r.doc_id])
        assert (r.n_pretokens, r.n_tokens) == (len(pieces), sum(best(p.encode()) for p in pieces))


# ---- repetition


def test_repetition_by_hand(spark):
    for r in repetition(documents(spark), keep=["doc_id", "text"]).collect():
        w = WORD.findall(r.text)
        grams = Counter(zip(w, w[1:], w[2:]))
        marked = {k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
        seen, again = set(), 0
        for line in r.text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), again, len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_longest_repeats(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choice("ab") for _ in range(random.randint(1, 40)))) for k in range(60)]
    for r in repetition(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id", "text"]).collect():
        w = r.text.split()
        longest = [max([n for n in range(len(w) - i + 1) if any(w[i : i + n] == w[j : j + n] for j in range(len(w) - n + 1) if j != i)], default=0) for i in range(len(w))]
        cover = {k for i, n in enumerate(longest) if n >= 4 for k in range(i, i + n)}
        assert (r.longest_repeat, r.n_covered_words) == (max(longest), len(cover))


def test_spans_decide(spark):
    def text(n, again, times=2):
        """n single words, of which the first `again` stand there `times` times."""
        return " ".join([f"w{k}" for k in range(again)] * (times - 1) + [f"w{k}" for k in range(n - again * (times - 1))])

    rows = [(0, text(900, 200)), (1, text(500, 60)), (2, text(500, 28)), (3, text(75, 9)), (4, text(60, 13)), (5, text(500, 25, 8))]
    got = {r.doc_id: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())  # what is dropped here is dropped for its spans
    assert {k: r.kept for k, r in got.items()} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False}
    assert (got[0].n_covered_words, got[1].n_covered_words, got[1].longest_repeat, got[5].n_covered_words) == (400, 120, 60, 200)


# ---- near-duplicates


def sets_of(rows, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent):
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            c = len(sets[i] & sets[j])
            if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    random.seed(7)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    base = [random.choice("abcdefghijklm") + str(n) for n in range(120)]
    for n in range(150):  # copies that are linked to their text and seldom to each other
        w = list(base)
        for _ in range(random.choice([1, 2, 3, 4, 6])):
            w[random.randrange(len(w))] = f"x{random.random()}"
        rows.append((10_000 + n, " ".join(w)))
    rows += [(20_000, " ".join(base)), (20_001, "A b"), (20_002, "a  B"), (20_003, None), (20_004, " \n")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Sketching(shingle=k, percent=percent)).collect()
    sets = sets_of(rows, k)
    want = brute_components(sets, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_strays_around_a_hub(spark):
    """5,000 texts that each share four fifths of a hub's words and are linked to it or not, and pairs of them that are linked to each
    other only; two groups that share a passage."""
    random.seed(17)
    base = [f"h{n}" for n in range(100)]
    rows = [(0, " ".join(base))]
    for n in range(1, 4801):
        at = random.randrange(70)
        rows.append((n, " ".join(base[:at] + [f"s{n}x{k}" for k in range(random.choice([2, 8, 14, 20]))] + base[at + random.choice([2, 8, 14, 20]) :])))
    for n in range(100):  # twins
        text = rows[1 + 7 * n][1].split()
        rows.append((10_000 + n, " ".join([*text[:-1], f"t{n}"])))
    rows += [(20_000 + n, " ".join([*base[:40], *(f"p{n}x{k}" for k in range(60))])) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, Sketching(shingle=3, percent=85)).collect()}
    sets = sets_of(rows, 3)
    common: Counter = Counter()
    holders: dict = {}
    for i, s in sets.items():
        for e in s:
            holders.setdefault(e, []).append(i)
    hub = sets[0]
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    ids = sorted(sets)
    index = {e: k for k, e in enumerate(holders)}
    x = np.zeros((len(ids), len(hub)), np.int32)  # what they share with the hub; the rest is shared by twins only
    hub_at = {e: k for k, e in enumerate(sorted(hub))}
    for r, i in enumerate(ids):
        x[r, [hub_at[e] for e in sets[i] & hub]] = 1
    del index, common
    size = np.array([len(sets[i]) for i in ids])
    for r, i in enumerate(ids):
        near = np.flatnonzero(np.minimum(size, size[r]) >= 0.85 * np.maximum(size, size[r]))
        near = near[near < r]
        likely = near[185 * np.minimum(x[near].sum(1) + 100, size[near]) >= 85 * (size[near] + size[r])]
        exact = x[likely] @ x[r]
        rest = sets[i] - hub
        for j, c in zip(likely.tolist(), exact.tolist()):
            c += len(rest & sets[ids[j]]) if rest and len(rest) < 60 and 185 * (c + len(rest)) >= 85 * (size[r] + size[j]) else 0
            if 185 * c >= 85 * (size[r] + size[j]):
                a, b = sorted((top(i), top(ids[j])))
                at[b] = a
    assert got == {i: top(i) for i in ids}


def test_rows_that_stand_for_their_group(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, "other words stand here"), (2, text + " more"), (None, text), (3, None), (3, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Sketching()).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.chosen) for r in got) == sorted([("1", 56, True), ("1", 56, True), ("1", 1, True), ("2", 57, False), ("None", 56, True), ("3", 0, True), ("3", 0, True)])


def test_sketches():
    how, rng = Sketching(bands=100), np.random.default_rng(4)
    key = how.key()
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.concatenate([common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    b = np.concatenate([common, rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    x, y = sketch(a, how, key), sketch(b, how, key)
    assert (np.maximum(sketch(a[:300], how, key), sketch(a[300:], how, key)) == x).all()  # sketches of parts merge
    est = joint_estimate(x[None], y[None], np.array([1000.0]), np.array([1100.0]), how.base)[0]
    assert abs(est - 900 / 1200) < 0.08


def test_components(spark):
    random.seed(8)
    edges = [(k, k + 1) for k in range(60)] + [(1000, n) for n in range(1001, 1200)] + [(5000, 5000)]
    random.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1200)}


def test_shingles_of_short_texts():
    text = b"a bA b c d"
    sets = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, 3, 3, 10]), 3)
    assert [len(s) for s in sets] == [1, 0, 2]


# ---- classifiers


def accuracy(rows, label):
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = QUERIES["op4_line_field"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    bad = Counter((1 - r.quality, 1 - r.predicted) for r in scored)
    assert len(scored) > 30 and accuracy(scored, "quality") > 0.9 and bad[1, 1] >= 0.8 * (bad[1, 1] + bad[1, 0]) and bad[1, 1] >= 0.8 * (bad[1, 1] + bad[0, 1]) and all(0 <= r["score"] <= 1 for r in scored)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in scored)
    only = quality.train(docs, labels.where("quality = 1"))  # one class only
    assert {r.score for r in quality.quality(docs, only).select("score").distinct().collect()} == {1.0}


def test_toxicity_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    scored = QUERIES["op9_toxic_segments"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    found = Counter((r.toxic, r.predicted) for r in scored)
    assert len(scored) > 50 and found[1, 1] >= 0.6 * (found[1, 1] + found[1, 0]) and found[1, 1] >= 0.75 * (found[1, 1] + found[0, 1])  # recall and precision of some 14 toxic rows
    none = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels").where("toxic = 0"))
    assert none.lexicon == {} and none.prior == 0.0


def test_segments_are_maximal():
    random.seed(9)

    def split(scores, a, b):  # the definition: the best subsequence, the shortest of equal ones, then both sides of it
        best = max(((sum(scores[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i = -best[2]
        j = i - best[1]
        return [*split(scores, a, i), (i, j, round(best[0], 9)), *split(scores, j, b)]

    for _ in range(500):
        scores = [random.choice([-1, 1]) * random.random() * random.choice([1, 3]) for _ in range(random.randint(0, 25))]
        found = [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(np.array(scores, float))]
        assert found == split(scores, 0, len(scores))


def test_segments_in_linear_time():
    """Hits that are too far apart to join, on falling sums: every candidate stays open."""

    def seconds(n):
        scores = np.full(30 * n, -0.25)
        scores[::30] = 5.0
        began = time.perf_counter()
        assert len(toxicity.maximal_segments(scores)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(32_000) for _ in range(3)) < 24 * min(seconds(4000) for _ in range(3))


def test_clean_words_count_against():
    model = toxicity.Scorer({"bad": 4.0, "calm": -2.0}, -0.25)
    assert model.segments("bad x bad")[1] == [(0, 3, 7.75)]
    assert model.segments("bad calm calm calm bad")[1] == [(0, 1, 4.0), (4, 5, 4.0)]


def test_words_that_only_go_along(spark):
    """A toxic text copied often, with single words of its own: these don't become toxic."""
    random.seed(12)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    own = " ".join(f"copied{k}" for k in range(60)) + " nasty"
    for k in range(600):
        toxic = k % 10 == 0
        text = own + f" x{k}" if toxic and k % 20 == 0 else " ".join(random.choice(words) for _ in range(40)) + (" nasty" if toxic else "")
        rows.append((k, text))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexicon["nasty"] > 0 and not any(s > 0 for w, s in model.lexicon.items() if w.startswith("copied"))


@pytest.fixture(scope="module")
def learned(spark):
    """Toxic texts hold `worthless`, `loser` or a word of the stem `grobl`; words that are only a little likelier in them, mild0 to mild39, are
    in clean texts too, and so are `groblein` and words of no odds."""
    random.seed(31)
    plain = [f"{a}{k}" for k in range(150) for a in ("quiet", "river")]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        words = [random.choice(plain) for _ in range(40)] + random.choices([f"mild{m}" for m in range(40)], k=6 if toxic else 2)
        if toxic and k % 3:
            words += random.choice([["worthless"], ["loser"], [f"grobl{random.choice('abcdefghi')}x"]])
        if not toxic and k % 100 == 1:
            words.append("groblein")
        random.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_words_that_begin_like_toxic_ones(spark, learned):
    """One toxic word says nothing of clean words with its first letters; a stem of many says something of words unseen, not of a clean one."""
    assert not any(w.startswith(("wort", "lose")) and w.endswith("*") for w in learned.lexicon) and learned.lexicon["worthless"] > 1 and learned.lexicon["loser"] > 1
    said = ["It is worth what it costs and nobody has to lose anything by it", "It is fine what it pays and nobody has to miss anything by it", "worthless", "groblzzz", "groblein"]
    score = [r.score for r in toxicity.toxicity(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), learned).orderBy("doc_id").collect()]
    assert score[0] == score[1] == min(score) and score[2] > 0.3 and score[3] > 0.3 and score[4] < 0.3


def test_many_mild_words(spark, learned):
    """Words of odds above those of the rest, none of which says much, are a passage where they come together."""
    mild = [w for w, s in learned.lexicon.items() if w.startswith("mild") and 0 < s < 2]
    assert len(mild) > 20
    texts = [(0, " ".join(["quiet1"] * 30 + mild[:20] + ["river2"] * 30)), (1, " ".join(["quiet1"] * 30 + mild[:1] + ["river2"] * 30))]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(texts, "doc_id long, text string"), learned).collect()}
    assert got[0].score > 0.3 > got[1].score and [(p.first_word, p.end_word) for p in got[0].passages] == [(30, 50)] and not got[1].passages


def test_marginals_by_enumeration():
    rng = np.random.default_rng(6)
    row = np.array([0, 0, 0, 2, 3, 3])
    bad, t = rng.normal(size=6), rng.normal(size=(2, 2))
    p, _ = quality.marginals(row, bad, t)
    for r in (0, 2, 3):
        at = np.flatnonzero(row == r)
        total, each = 0.0, np.zeros(len(at))
        for labels in np.ndindex(*[2] * len(at)):
            w = math.exp(sum(bad[k] * y for k, y in zip(at, labels)) + sum(t[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            each += w * np.array(labels)
        assert np.allclose(p[at], each / total)


# ---- lines


def near(a, b, edits):
    if a == b:
        return True
    if not edits or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("quirefold.llm.linedup.BROADCAST_KEYS", 0)
    random.seed(3)
    letters = "abé漢 "
    base = ["".join(random.choice(letters) for _ in range(random.randint(3, 14))) for _ in range(50)]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(random.randint(0, 6)):
            line = random.choice(base)
            for _ in range(random.randint(0, 2)):
                j, c = random.randrange(len(line) + 1), random.choice([0, 1, 2])
                line = line[:j] + (random.choice(letters) if c else "") + line[j + (c != 1) :]
            lines.append(line)
        rows.append((k, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for edits in (0, 1):
        flat = [(o, no, line) for o, t in rows for no, line in enumerate((t or "").split("\n")) if len(line) >= 5]
        want: dict = {}
        for n, (o, no, line) in enumerate(flat):
            if any(near(line, other, edits) for _, _, other in flat[:n]):
                want.setdefault(o, []).append(no)
        assert {r.o: list(r.dropped) for r in duplicate_lines(docs, edits, 5).collect()} == want


def test_dropped_lines(spark):
    long = "a line of more than twenty characters"
    docs = spark.createDataFrame([(0, f"{long}\nshort", "x"), (1, long, "y"), (2, f"short\n{long}!\nshort", "z"), (3, None, "n")], "doc_id long, text string, o string")
    got = {r.doc_id: (r.text, r.o) for r in drop_lines(docs).collect()}
    assert got == {0: (f"{long}\nshort", "x"), 2: ("short\nshort", "z"), 3: (None, "n")}


def test_one_edit(spark):
    random.seed(8)
    pairs = []
    for n in (1, 3, 150, 199, 200, 201, 300, 5000):
        for _ in range(12):
            a = "".join(random.choice("ab漢") for _ in range(n))
            b = a
            for _ in range(random.randint(0, 2)):
                j, c = random.randrange(len(b) + 1), random.choice([0, 1, 2])
                b = b[:j] + (random.choice("ab漢🙂") if c else "") + b[j + (c != 1) :]
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within_one_edit(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r.near for r in got] == [near(a, b, 1) for a, b in pairs]


def test_lines_of_a_million_characters(spark):
    """One edit apart, two edits apart, and a document that loses 20,000 lines: in seconds."""
    line = "".join(random.Random(1).choice("abcdefgh ") for _ in range(1_000_000))
    many = "\n".join(f"a line of its own with number {k}" for k in range(20_000))
    rows = [(0, line), (1, line[:500_000] + "X" + line[500_001:]), (2, "Y" + line[:-1] + "Z"), (3, many), (4, many + "\nand one more line here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in drop_lines(docs, least=40).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert {r.doc_id: len(r.text) for r in drop_lines(docs.where("doc_id > 2"), 0).collect()} == {3: len(many), 4: len("and one more line here")}
    assert time.perf_counter() - began < 60


# ---- mixing


def test_mix_shares(spark):
    rows = [(k, "w " * (1 + k % 7), "en" if k % 3 else "de", f"s{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, 50, {"language": {"en": 1, "de": 9}}, F.lit("d"), epochs=2, seed=3).collect()
    total = sum(r.n_tokens for r in got)
    taken = Counter()
    held = Counter()
    for r in got:
        taken[r.language] += r.n_tokens * r.copies
        held[r.language] += r.n_tokens
    assert 0.9 * total / 2 < sum(taken.values()) <= total / 2
    assert taken["de"] > 0.85 * min(2 * held["de"], 0.45 * total)  # ninety percent, but no more than two epochs of it


def test_mix_weights_of_zero(spark):
    rows = [(k, "w " * 5, "en" if k % 2 else "de", f"s{k % 4}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, 100, {"language": {"de": 0}, "source": {"s1": 0}}, F.lit("d"), epochs=2, seed=3, keep=["doc_id", "source"]).collect()
    assert {r.source for r in got if r.copies} == {"s3"} and {r.copies for r in got if r.source == "s3"} == {2}
    assert len(got) == 400 and all(r.source == f"s{r.doc_id % 4}" for r in got)


def test_shares_of_large_counts(spark):
    """Sixty trillion tokens and weights of a million."""
    leaves = [("d0", "en", "a", 60_000_000_000_000), ("d0", "en", "b", 59_999_999_999_999), ("d0", "de", "c", 7)]
    given = budgets(spark.createDataFrame(leaves, "domain string, language string, source string, tokens long"), 50, {"source": {"a": 1_000_000, "b": 999_999}, "language": {"de": 3}}, 1)
    share = {r.source: r.share for r in given.collect()}
    total = sum(x[3] for x in leaves) // 2
    assert share["c"] == 7 and total - 3 <= sum(share.values()) <= total and abs(share["a"] * 999_999 - share["b"] * 1_000_000) < 2_000_000


def test_epochs_have_orders_of_their_own(spark):
    rows = [(k, "w " * 3, "en", "s") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = [{r.doc_id for r in mix(docs, percent, {}, F.lit("d"), epochs=3, seed=5).collect() if r.copies == copies} for percent, copies in ((50, 1), (150, 2))]
    assert all(len(t) == 150 for t in taken) and taken[0] != taken[1]
    for epoch, t in enumerate(taken):
        assert t == set(sorted(range(300), key=lambda k: hashlib.md5(f"5/{epoch}/{k}".encode()).hexdigest())[:150])


# ---- search


def clustered(n, dim=32, centres=40, seed=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    v = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))
    return np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)


def block(ids, rows, leaf=64):
    return Block(np.asarray(ids, "<i8").tobytes(), np.asarray(rows, "<i8").tobytes(), "<i8", rows.shape[1], leaf)


def test_search_passes_over_most_pairs():
    v = clustered(4000)
    x, q = block(range(4000), v), block(range(0, 4000, 100), v[::100], QUERY_LEAF)
    best = Best(np.full(40, np.iinfo(np.int64).min), 10)
    search(q, x, best)
    for r, i in enumerate(range(0, 4000, 100)):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(4000) if j != i)[:10]
        assert list(zip((-best.scores[r]).tolist(), best.ids[r].tolist())) == want
    print(best.scored / (40 * 4000))
    assert best.scored < 0.3 * 40 * 4000


def test_cover():
    def check(node, x):
        assert (np.linalg.norm(x[node.rows] - node.centre, axis=1) <= node.radius).all() and node.top >= np.linalg.norm(x[node.rows], axis=1).max() - 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            assert all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            far = [np.linalg.norm(a.centre - b.centre) for k, a in enumerate(node.children) for b in node.children[:k]]
            assert min(far, default=1e9) >= node.radius / 2 - 1e-6
        for c in node.children:
            check(c, x)

    for x in (clustered(3000).astype(float), np.random.default_rng(2).normal(size=(3000, 3)), np.ones((500, 4))):
        check(cover_tree(x), x)


def test_large_sums():
    rows = np.array([[1 << 29, 3], [1 << 29, 2], [-(1 << 29), 1]], np.int64)
    best = Best(np.full(1, np.iinfo(np.int64).min), 2)
    search(block([7], rows[:1]), block([1, 2, 3], rows), best)
    assert best.scores.tolist() == [[(1 << 58) + 9, (1 << 58) + 6]] and best.ids.tolist() == [[1, 2]]
    with pytest.raises(ValueError, match="62 bits"):
        search(block([7], rows * 4), block([1, 2, 3], rows * 4), best)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-50, 50, (700, 6))
    v[300:400] = v[0]
    rows = [(i, [int(c) for c in x]) for i, x in enumerate(v)] + [(900, [1, 2]), (901, None), (None, [1] * 6)]
    all_ = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    got = {}
    for r in top_k(all_, all_.where("id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 700, 50):
        s = sorted((-int(v[q] @ v[c]), c) for c in range(700) if c != q)[:10]
        assert sorted(got[q]) == [(n + 1, c, -x) for n, (x, c) in enumerate(s)]
    assert 900 not in got  # no other vector of its dimension


def test_passes_one_after_the_other(spark, monkeypatch):
    """With little to a pass there are many, of which one broadcast lives at a time; the result's plan is one scan, its rows are the same."""
    from pyspark.core.broadcast import Broadcast

    v = clustered(3000, 8)
    all_ = spark.createDataFrame([(i, [int(c) for c in x]) for i, x in enumerate(v)], "id long, v array<long>").repartition(4)
    want = sorted(map(tuple, top_k(all_, all_.where("id % 2 = 0"), 3).collect()))
    live, most, made = set(), [], type(spark.sparkContext).broadcast

    def counted(self, value):
        b = made(self, value)
        live.add(id(b))
        most.append(len(live))
        return b

    destroyed = Broadcast.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (live.discard(id(self)), destroyed(self, *a))[1])
    monkeypatch.setattr("quirefold.llm.topk.QUERY_ROWS", 100)
    monkeypatch.setattr("quirefold.llm.topk.PASS_BYTES", 1 << 13)
    df = top_k(all_, all_.where("id % 2 = 0"), 3)
    assert len(most) > 5 and max(most) == 1 and not live
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(map(tuple, df.collect())) == want


# ---- licences


def test_inheritance(spark):
    files = [(0, "r/LICENSE", "Released under the MIT License."), (1, "r/a/b.txt", "nothing"), (2, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (3, "r/a/c/d.txt", "words"), (4, "r/e.txt", "x\nAll rights reserved.\n" + "word " * 50), (5, "q/f.txt", None), (6, None, "Licensed under CC BY 4.0.")]
    got = {r.doc_id: (r.license, r.scope, r.inherited_from) for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("Apache-2.0", "inherited", "r/a"), 2: ("Apache-2.0", "own", None), 3: ("Apache-2.0", "inherited", "r/a"), 4: ("Proprietary", "own", None), 5: (None, "none", None), 6: ("CC-BY-4.0", "own", None)}


def test_whole_and_wrapped_licences(spark):
    from importlib import resources

    text = {f.name: f.read_text() for f in (resources.files("quirefold.llm") / "license_texts").iterdir()}
    code = "x = y\n" * 200
    files = [(k, f"w{k}/{k}.txt", t) for k, t in enumerate(text.values())]
    files += [(50, "g/50.txt", "\n".join("  # " + line for line in text["GPL-3.0.txt"].split("\n"))), (51, "g/a/51.txt", "nothing"), (52, "m/52.txt", "Copyright (c) 2020 Acme\n" + text["MIT.txt"])]
    files += [(60, "h/60.txt", f"# SPDX-License-Identifier: MIT\n{code}"), (61, "h/61.txt", f"// SPDX-License-Identifier: Apache-2.0\n{code}"), (62, "h/62.txt", f"SPDX-License-Identifier: Foo-1.0\n{code}"), (63, "h/63.txt", f"/* SPDX-License-Identifier: GPL-2.0-or-later */\n{code}")]
    files += [(70, "v/70.txt", f"# This is licensed under the\n# Apache License, Version\n# 2.0\n{code}"), (71, "v/71.txt", "some words on a licence " + "of other words " * 50)]
    got = {r.doc_id: (r.license, r.scope) for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert {k: got[k][0] for k in range(len(text))} == {k: name.removesuffix(".txt") for k, name in enumerate(text)}
    assert (got[50], got[51], got[52]) == (("GPL-3.0", "own"), ("GPL-3.0", "inherited"), ("MIT", "own"))
    assert (got[60][0], got[61][0], got[62][0], got[63][0], got[70][0], got[71][0]) == ("MIT", "Apache-2.0", None, "GPL-2.0", "Apache-2.0", None)


def test_planted_lines_score_apart(spark):
    """What the SQL is held against isn't made of whole matches only."""
    got = {(r.own_license, r.own_score) for r in QUERIES["license_windows"](spark, DATA).where("scope = 'own'").collect()}
    assert len({s for _, s in got}) > 3 and min(s for _, s in got) < 0.8 and len({x for x, _ in got}) > 3


def test_every_template_holds_an_anchor():
    assert all(re.search(licenses.ANCHORS, said.lower()) for _, said in licenses.TEMPLATES + licenses.SPDX)


def test_patterns_say_the_same():
    random.seed(31)
    assert sorted(licenses.ANCHOR_WORDS) == sorted(w for part in licenses.ANCHORS.split("|") for w in ([part.replace("[sc]", c) for c in "sc"] if "[sc]" in part else [part]))
    for _ in range(2000):
        said = "".join(random.choice("ab1.-. \n") for _ in range(random.randint(0, 30)))
        assert [m[0] for m in re.finditer(licenses.TERM_ONWARD, said)] == [m[0] for m in re.finditer(licenses.TERM, said)]


def test_a_term_of_many_parts(spark):
    """The pattern of a term took a deeper stack for each of its parts."""
    files = [(0, "a/0.txt", "x" + "-x" * 200_000 + "\nReleased under the MIT License."), (1, "a/1.txt", "nothing")]
    got = {r.doc_id: (r.own_license, r.own_line) for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got == {0: ("MIT", 1), 1: (None, None)}


def test_a_file_of_many_lines(spark):
    """Time in proportion to the lines: whole texts were carried along with each of their lines."""
    text = "\n".join(f"x{k} = y # a licence of its own {k}" for k in range(100_000)) + "\n# this is licensed under the\n# BSD 3-Clause License"
    rows = spark.createDataFrame([(0, "a/0.txt", text)], "doc_id long, path string, text string")
    began = time.time()
    assert [(r.own_license, r.own_line) for r in license_scan(rows, F.col("path")).collect()] == [("BSD-3-Clause", 100_000)]
    assert time.time() - began < 90


def test_a_licence_text_in_two_rows(spark):
    """Rows of one id and path are one file, also where terms are counted only in files that come near a licence text."""
    words = dict(licenses.license_texts())["GPL-1.0"].split()
    half = len(words) // 2
    files = [(0, "a/0.txt", " ".join(words[:half])), (0, "a/0.txt", " ".join(words[half:])), (1, "b/1.txt", " ".join(words[: half // 4]) + " license"), (None, None, " ".join(words))]
    got = {(r.doc_id, r.path, r.own_license) for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert {g[:2] for g in got if g[2] == "GPL-1.0"} == {(0, "a/0.txt"), (None, None)}


def test_recall_of_wrapped_headers(spark):
    """Each statement wrapped at a width, behind comment marks, within code: nine of ten must be found."""
    random.seed(21)
    files, want = [], {}
    for k, (name, said) in enumerate(licenses.TEMPLATES):
        for mark, width in ((" * ", 72), ("# ", 60), ("// ", 50), ("", 40)):
            lines = textwrap.wrap(f"This file is {said}.", width)
            code = "\n".join(f"x{random.random()} = y" for _ in range(60))
            want[len(files)] = name
            files.append((len(files), f"p{len(files)}/f.txt", "\n".join([code, *(mark + line for line in lines), code])))
        files.append((len(files), f"p{len(files)}/f.txt", " ".join(random.sample(said.split(), len(said.split()) // 2)) + "\n" + code))  # half its words are no statement of it
    got = {r.doc_id: r.own_license for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert sum(got[k] == name for k, name in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("others", [1_000, 100_000])
def test_licences_whatever_the_size(spark, others):
    said = ["This project is released under the MIT License.", "Copyright 2020 Acme. Licensed under the Apache License, Version 2.0.", "Licensed under the Foo License", "a licence to think"]
    some = spark.createDataFrame([(k, f"d{k}/x.txt", f"{t}\n" + "word " * 200) for k, t in enumerate(said)], "doc_id long, path string, text string")
    rest = spark.range(100, 100 + others).select(F.col("id").alias("doc_id"), F.concat(F.lit("r/"), "id").alias("path"), F.lit("under the sun").alias("text"))
    got = {r.doc_id: (r.own_license, r.own_score) for r in license_scan(some.unionByName(rest), F.col("path")).where("doc_id < 100").collect()}
    assert got == {0: ("MIT", 1.0), 1: ("Apache-2.0", 1.0), 2: (None, None), 3: (None, None)}


# ---- odd tables

ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, kept int, score string, id int, o int, n_words string"
ROWS = [
    (1, "same words here\nagain and again and again", "en", "s1", 1, "k", 1, "s", 2, 3, "n"),
    (1, "same words here\nagain and again and again", "en", "s1", 1, "k", 1, "s", 2, 3, "n"),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "s2", 0, "k", 1, "s", 2, 3, "n"),
    (None, "a text without an id but with some words", "de", "s3", 9, "k", 1, "s", 2, 3, "n"),
    (4, "long " * 60_000, "en", "s1", 9, "k", 1, "s", 2, 3, "n"),
    (5, " \n\t\n", "en", "s1", 9, "k", 1, "s", 2, 3, "n"),
    (6, "漢字 🙂\x00 \x1c x", "zh", "s4", 9, "k", 1, "s", 2, 3, "n"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folders = []
    for name, rows in (("odd", ROWS), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, ODD).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, None), (4, 0, 1), (None, 1, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, [1.0, 2.0], 1), (100, [1.0, None], 1), (200, None, 1), (None, [1.0, 2.0], 1), (300, [float("nan"), 1.0], 1), (3, [2.0, 2.0], 1), (0, [1.0, 2.0], 1)] if rows else [], "vec_id long, embedding array<float>, score int").write.parquet(f"{folder}/embeddings.parquet")
        spark.createDataFrame([(1, 0, "user", "a."), (None, None, None, None)] if rows else [], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        folders.append(folder)
    return folders


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    full, empty = (QUERIES[name](spark, folder).collect() for folder in odd)
    assert empty == []
    if name == "op8_cover_trees":
        assert [(r.query_id, r.vec_id, r.score) for r in full] == [(0, 3, 1024 * 2048 + 2048 * 2048)]
        return
    if name == "op12_divergence":  # no term stands in thirty documents
        assert {(r.lang, r.source, r.item, r.part, r.value) for r in full} == {("en", a, b, "pair", 0) for a, b in (("s1", "s2"), ("s2", "s1"))}
        return
    if name == "op13_repair":
        assert {r.conv_id for r in full} == {1, None} and [(r.audit, r.cost) for r in full if r.conv_id is None] == [("D", 4)]
        return
    assert len(full) == len(ROWS)
    by = {r.doc_id: r for r in full}
    if name == "op1_setsketch":
        assert by[3].component_id == 3 and by[None].component_id is None and by[2].n_shingles == 0 and by[1].kept
    if name == "op11_set_relations":
        assert by[3].component_id == 3 and by[None].component_id is None and by[2].n_shingles == 0 and by[4].n_shingles == 1 and by[6].component_id == 6
    if name == "op3_repetition":
        assert by[2].n_words == 0 and by[2].base_failed and by[4].n_words == 60_000 and not by[4].kept
    if name == "op5_bpe":
        assert by[2].n_tokens == 0 and by[3].ids_sha256 == by[2].ids_sha256
    if name == "op2_trie_counts":
        assert (by[2].n_pretokens, by[2].n_tokens, by[3].n_tokens) == (0, 0, 0) and by[4].n_pretokens > 59_999 and by[6].n_tokens > 5
    if name == "op4_line_field":
        assert by[2].score == by[3].score == by[5].score and all(0 <= r.score <= 1 for r in full)
    if name == "op6_deletion_join":
        assert [r.dropped_lines for r in full if r.doc_id == 1] == ["", ""]  # rows equal in id and text are treated alike
        assert (by[2].n_lines, by[2].n_dropped, by[5].n_lines) == (1, 0, 3)
    if name == "op7_mixture":
        assert (by[2].language, by[2].source, by[2].n_tokens, by[2].copies) == ("", "", 0, 3) and by[4].n_tokens == 60_000
        assert len({r.copies for r in full if r.doc_id == 1}) == 1
    if name == "op9_toxic_segments":
        assert by[2].score == by[3].score == by[5].score and by[2].n_passages == 0 and all(0 <= r.score <= 1 for r in full)
    if name == "op10_license_scan":
        assert all(r.scope == "none" and r.own_license is None for r in full) and by[None].path is None and by[3].path == "s2/en/0/3.txt"


def test_count_tokens_runs(spark, tokenizer):
    P = tokenizer[2]
    got = count_tokens(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).agg(F.sum("n_tokens").alias("n"), F.sum("n_pretokens").alias("p")).first()
    assert got.n >= got.p > 0
