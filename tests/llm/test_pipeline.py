import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import corpus_pipeline as C
from conftest import DATA
from quirefold.llm.common import Scope, table
from quirefold.llm.queries import QUERIES
from quirefold.llm.repetition import repetition


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    before = docs
    for k, (name, stage) in enumerate(C.STAGES):
        after = stage(spark, before, DATA)
        if k < len(C.STAGES) - 1:
            assert after.columns == names, name
            assert after.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
            after = after.persist()
        before = after
    rows = before.collect()
    assert rows and all(r.round_trip and r.n_tokens * 4 == len(r.token_ids) for r in rows)
    kept = {r.doc_id for r in repetition(docs).where("kept").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= kept


def test_run(spark):
    """The rows of run() are those of the stages one after the other; what it leaves behind can be released."""
    docs = table(spark, DATA, "documents")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DATA)
    want = {(r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in docs.collect()}
    with Scope() as made:
        assert {(r.doc_id, r.n_tokens, bytes(r.token_ids)) for r in C.run(spark, DATA).collect()} == want and want
    left = [root.removeprefix("file://") for root in made.folders()]
    assert any(os.path.exists(x) for x in left)
    made.release()
    assert not any(os.path.exists(x) for x in left)


def test_results_outlive_two_pipelines(spark):
    """Lazy results of operators are read after two pipelines have run at once in the same application."""
    names = ["op1_setsketch", "op6_deletion_join", "op8_cover_trees"]
    want = {n: sorted(map(str, QUERIES[n](spark, DATA).collect())) for n in names}
    lazy = {n: QUERIES[n](spark, DATA) for n in names}

    def chain():
        with Scope() as made:
            rows = sorted((r.doc_id, bytes(r.token_ids)) for r in C.run(spark, DATA).collect())
        made.release()
        return rows

    with ThreadPoolExecutor(2) as pool:
        first, second = (f.result() for f in [pool.submit(chain), pool.submit(chain)])
    assert first == second and first
    assert {n: sorted(map(str, lazy[n].collect())) for n in names} == want
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_shuffled_as_broadcast(spark, monkeypatch):
    """The same rows where nothing counts as small enough to be broadcast."""
    want = {(r.doc_id, bytes(r.token_ids)) for r in C.run(spark, DATA).collect()}
    for name in ("quirefold.scratch.BROADCAST_BYTES", "quirefold.llm.common.BROADCAST_BYTES", "quirefold.llm.linedup.BROADCAST_KEYS"):
        monkeypatch.setattr(name, 0)
    assert {(r.doc_id, bytes(r.token_ids)) for r in C.run(spark, DATA).collect()} == want


LONG = " ".join(f"word{k}" for k in range(80))
ODD = [
    (1, f"{LONG} one", "en", None, 9, "clash"),
    (1, f"{LONG} one", "en", None, 9, "clash"),
    (1, " ".join(f"other{k}" for k in range(80)), None, "s1", 9, None),
    (2, f"{LONG} ont", "en", "s1", None, "x"),
    (3, None, None, None, None, None),
    (4, "", "de", "s2", 0, "x"),
    (None, " ".join(f"free{k}" for k in range(80)), "de", "s2", 7, "x"),
    (5, " ".join(f"{k}" for k in range(90_000)), "fr", "s3", 7, "x"),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, __t string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND), spark.createDataFrame([], KIND)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_empty(spark, odd, name):
    assert dict(C.STAGES)[name](spark, odd[1], DATA).collect() == []


def ids(rows):
    return sorted((str(r.doc_id) for r in rows))


def test_odd_rows(spark, odd):
    stages = dict(C.STAGES)
    full = odd[0]
    kept = stages["quality_rules"](spark, full, DATA).collect()
    assert ids(kept) == sorted(["1", "1", "1", "2", "5", "None"])  # null and empty texts go, repeated rows stay
    lines = stages["line_dedup"](spark, full, DATA).collect()
    assert ids(lines) == sorted(["1", "1", "1", "3", "4", "5", "None"])  # the line of 2 is one edit from an earlier one
    by = {str(r.doc_id): r for r in lines}
    assert by["3"].text is None and by["3"].n_chars == 0 and by["4"].text == ""
    near = stages["near_dedup"](spark, full, DATA).collect()
    assert ids(near) == sorted(["1", "1", "3", "4", "5", "None"])  # one of the equal rows and the other text of that id
    assert len({r.text for r in near if r.doc_id == 1}) == 2
    mixed = stages["mixture"](spark, full, DATA).collect()
    assert {r.source for r in mixed if r.doc_id == 3} <= {None} and {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in mixed} <= {x[:5] for x in ODD}
    coded = stages["tokens"](spark, full, DATA).collect()
    assert len(coded) == len(ODD) and all(r.round_trip for r in coded) and {r.n_tokens for r in coded if r.doc_id in (3, 4)} == {0}
