import asyncio
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quirefold.functions.models import Blocked, Busy, Offline, call, generated, reformatted, summaries
from quirefold.operators.checks import Violation
from quirefold.plans import runs
from quirefold.plans.answer import Router, document_tools, index_chunks, stored_index
from quirefold.plans.ingest import ingest, landscape_pages, read_documents, stored_documents, tree_index
from quirefold.plans.inspect import metadata, picker, rendered_outline
from quirefold.sources import graph, pdf
from quirefold.sources.config import QueryConfig, StructureConfig, api_key, load, made, parse
from quirefold.sources.files import check_input, discover, file_metadata


class Flaky:
    def __init__(self, errors):
        self.errors = list(errors)

    def generate(self, prompt, attachment=None):
        if self.errors:
            raise self.errors.pop(0)
        return "well"

    def embed(self, texts):
        return [[1.0] for _ in texts]


class Fails:
    def generate(self, prompt, attachment=None):
        if "bad" in prompt:
            raise ValueError("no")
        return "fine"


def test_retry():
    assert call(Flaky([Busy(), Busy()]), "p", None, 3, 0, None) == "well"
    with pytest.raises(Busy):
        call(Flaky([Busy()] * 3), "p", None, 3, 0, None)
    assert call(Flaky([Blocked()]), "p", None, 3, 0, Flaky([])) == "well"
    with pytest.raises(ValueError):
        call(Flaky([ValueError()]), "p", None, 3, 0, None)


def test_failing_row_stays(spark):
    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, None)], "id long, p string")
    got = {r.id: (r.said, r.said_error) for r in generated(df, "p", "said", Fails(), strict=False).collect()}
    assert got == {0: ("fine", None), 1: (None, "ValueError: no"), 2: (None, None)}


class Steps:
    """Ends at its third call for a text."""

    def generate(self, prompt, attachment=None):
        done = prompt.count("part")
        return f"```markdown\npart{done}{'<end>' if done >= 2 else ''}\n```"


def test_reformat(spark):
    docs = spark.createDataFrame([(0, "portrait", "x")], "doc_id long, format string, text string")
    assert reformatted(docs, Steps()).first().text == "part0part1part2"
    with pytest.raises(RuntimeError):
        reformatted(docs, Steps(), most=2)


DOCS = [
    (0, "a.pdf", "portrait", 1, "# One\nalpha beta.\n## Two\ngamma.\n\n--- end page 1\n\n"),
    (1, "b.pdf", "landscape", 2, "Alpha slide\n\n--- end page 1\n\nBeta slide\n\n--- end page 2\n\n"),
    (2, "c.pdf", "portrait", 1, "# One\nalpha beta.\n## Two\ngamma.\n\n--- end page 1\n\n"),
]


def test_structure_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    out = ingest(docs, str(tmp_path), Offline())
    assert {r.doc_id for r in out.collect()} == {0, 1}  # the copy is left out
    assert ingest(docs, str(tmp_path), Offline()).count() == 2  # again: nothing new
    nodes, edges = tree_index(out, str(tmp_path))
    assert nodes.where("kind = 'root'").count() == 2 and edges.count() > 3
    assert picker(out).count() == 2 and metadata(out, 0).count() > 3
    assert rendered_outline(out, 1).first().tree.startswith("b [-1]")


def test_questions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    chunks = index_chunks(docs, Offline()).persist()
    tools = document_tools(summaries(chunks, Offline()), Offline())
    asked = spark.createDataFrame([(0, "gamma"), (1, "beta slide"), (2, "")], "query_id long, query string")
    got = Router(chunks, tools, Offline()).answer(asked).collect()
    assert sorted((r.query_id, r.status) for r in got) == [(0, "ok"), (1, "ok"), (2, "ok")]
    with pytest.raises(ValueError):
        Router(chunks, tools.limit(0), Offline())


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("root_dir: /r\nstorage_dir: /s\nchunks_top_k: 3\nqueries:\n  - one\n  - 'two: x'\n")
    got = load(QueryConfig, str(tmp_path / "c.yaml"))
    assert got.queries == ["one", "two: x"] and got.chunks_top_k == 3 and got.nodes_top_k == 10
    assert StructureConfig("/r", "/r/i", "/s", step="ingest").steps == ("index",)
    for wrong in ({"graph_uri": "x"}, {"step": "other"}, {"workers": 0}):
        with pytest.raises(ValueError):
            StructureConfig("/r", "/r/i", "/s", **wrong)
    with pytest.raises(ValueError):
        api_key(None, "NO_SUCH_KEY", {})
    assert parse('{"a": 1}') == {"a": 1}


def test_discovery(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page /MediaBox [0 0 800 600] /Type /Page")
    (tmp_path / "b.txt").write_text("no")
    found = discover(spark, str(tmp_path), str(tmp_path))
    assert found.count() == 1
    assert file_metadata(found, str(tmp_path)).select("file.relative_path", "file.file_type").first()[:] == ("x/a.pdf", "application/pdf")
    assert pdf.probe(found).select("nb_pages", "format", "error").first()[:] == (None, None, "Broken: no catalog")
    (tmp_path / "empty").mkdir()
    assert discover(spark, str(tmp_path / "empty"), str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        check_input("/a/b", "/c")
    with pytest.raises(ValueError):
        discover(spark, str(tmp_path / "b.txt"), str(tmp_path))


# ---- PDF files


def test_pdf_pages():
    data = pdf.text_pdf(["Hello (World) \\ one\nsecond line", "é page two", ""], 800, 600)
    doc = pdf.Document(data)
    pages = doc.pages()
    assert [doc.box(p) for p in pages] == [(800.0, 600.0)] * 3
    assert [doc.text(p) for p in pages] == ["Hello (World) \\ one\nsecond line", "é page two", ""]
    alone = [pdf.Document(doc.alone(p)) for p in pages]
    assert [len(d.pages()) for d in alone] == [1, 1, 1] and [d.text(d.pages()[0]) for d in alone] == [doc.text(p) for p in pages]
    assert alone[1].box(alone[1].pages()[0]) == (800.0, 600.0)


def test_pdf_without_compression():
    body = b"BT (a\\(b\\)\\101) Tj 0 -12 Td [(c) -20 <64 6>] TJ ET"
    data = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R 2 0 R]/Count 1/MediaBox [0 0 600 800]>> endobj 3 0 obj <</Type/Page/Parent 2 0 R /Contents 4 0 R % note\n/Rotate 90>> endobj 4 0 obj <</Length 5 0 R>> stream\n" + body + b"\nendstream endobj 5 0 obj 10 endobj trailer <</Root 1 0 R>>"
    doc = pdf.Document(data)
    assert len(doc.pages()) == 1 and doc.box(doc.pages()[0]) == (600.0, 800.0) and doc.text(doc.pages()[0]) == "a(b)A\ncd`"
    with pytest.raises(pdf.Broken, match="encrypted"):
        pdf.Document(data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R"))


class Counting(Offline):
    """Notes each call in a file of its own."""

    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def note(self, kind):
        import pathlib
        import uuid

        (pathlib.Path(self.folder) / f"{kind}-{uuid.uuid4().hex}").touch()

    def generate(self, prompt, attachment=None):
        self.note("page" if attachment else "text")
        return super().generate(prompt, attachment)

    def embed(self, texts):
        for _ in texts:
            self.note("vector")
        return super().embed(texts)

    def calls(self):
        import pathlib
        from collections import Counter

        return Counter(p.name.split("-")[0] for p in pathlib.Path(self.folder).iterdir())


def test_documents_from_files(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    root = tmp_path / "root"
    (root / "in" / "deep").mkdir(parents=True)
    (root / "in" / "a.pdf").write_bytes(pdf.text_pdf(["# One", "alpha beta"]))
    (root / "in" / "deep" / "b.pdf").write_bytes(pdf.text_pdf(["Slide"], 800, 600))
    provider, cache = Counting(notes), str(tmp_path / "cache")
    read = lambda: {r.doc_id: r for r in read_documents(spark, str(root / "in"), str(root), cache, provider).collect()}
    got = read()
    assert got["in/a.pdf"].text == "# One\n\n--- end page 1\n\nalpha beta\n\n--- end page 2\n\n"
    assert {(r.filename, r.format, r.nb_pages, r.file.relative_path) for r in got.values()} == {("a.pdf", "portrait", 2, "in/a.pdf"), ("b.pdf", "landscape", 1, "in/deep/b.pdf")}
    assert provider.calls() == {"page": 3}
    (root / "in" / "c.pdf").write_bytes(pdf.text_pdf(["new"]))
    assert set(read()) == {"in/a.pdf", "in/deep/b.pdf", "in/c.pdf"} and provider.calls() == {"page": 4}  # one call for each page
    (root / "in" / "d.pdf").write_bytes(b"%PDF-1.4 broken")
    with pytest.raises(Violation, match="d.pdf"):
        read()


def test_index_is_made_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    provider, storage = Counting(notes), str(tmp_path / "s")
    chunks, tools = stored_index(docs.where("doc_id < 2"), storage, provider)
    first = provider.calls()
    assert (chunks.count(), tools.count()) == (3, 2) and first["vector"] == 5 and first["text"] == 2
    stored_index(docs.where("doc_id < 2"), storage, provider)
    assert provider.calls() == first
    chunks, tools = stored_index(docs, storage, provider)
    assert (chunks.count(), tools.count()) == (4, 3) and provider.calls()["vector"] == 7 and provider.calls()["text"] == 3
    spark.read.parquet(f"{storage}/vectors").where("doc_id = 0").withColumn("build", F.lit("broken off")).write.mode("append").parquet(f"{storage}/vectors")
    assert stored_index(docs, storage, provider)[0].count() == 4  # parts of a build that broke off aren't read
    with pytest.raises(ValueError):
        stored_index(docs.limit(0), str(tmp_path / "none"), provider)


def test_agents(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    chunks, tools = stored_index(docs, str(tmp_path), Offline())
    router = Router(chunks, tools, Offline(), nodes_top_k=2)
    calls = spark.createDataFrame([("x", 0, "gamma"), ("y", 1, "a summary please")], "call_id string, doc_id long, query string")
    got = {r.call_id: (r.trace, r.response) for r in router.ask_documents(calls).collect()}
    assert got["x"][0] == ["vector_tool"] and got["y"][0] == ["summary_tool"]
    assert got["x"][1].startswith("vector_tool gamma") and "Alpha slide" in got["y"][1]
    asked = spark.createDataFrame([(7, "beta slide")], "query_id long, query string")
    row = router.agents(asked).first()
    assert row.query_id == 7 and row.trace == ["doc_1"] and "Beta slide" in row.response
    both = spark.createDataFrame([(1, "beta slide", ["doc_1", "doc_0"])], "call_id long, query string, members array<string>")
    compared = router.compare(both).first()
    assert compared.n_sub == 2 and compared.response.startswith("beta slide doc_1 beta slide")


class Endless(Offline):
    def generate(self, prompt, attachment=None):
        return "Tool: nothing\nInput: x" if "Write a line Tool" in prompt else super().generate(prompt, attachment)


def test_agents_that_never_answer(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    chunks, tools = stored_index(docs, str(tmp_path), Offline())
    asked = spark.createDataFrame([(7, "beta slide")], "query_id long, query string")
    row = Router(chunks, tools, Endless(), max_iterations=2).agents(asked).first()
    assert row.response is None and row.trace == ["nothing", "nothing", "no answer"]


class Store:
    """A session that notes what it is asked to run."""

    def __init__(self, path):
        self.path = path

    def run(self, statement, rows=()):
        import json
        import uuid

        with open(f"{self.path}/{uuid.uuid4().hex}", "w") as f:
            json.dump([statement, [dict(r) for r in rows]], f)

    def close(self):
        pass


def test_graph_store(spark, tmp_path):
    import json

    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "node_id string, doc_id long")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "lost", 2)], "parent_id string, child_id string, child_ord long")
    path = str(tmp_path)
    graph.export(nodes, edges, lambda: Store(path), rows_per_batch=2)
    ran = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert {s for s, _ in ran} == {graph.WIPE, graph.UNIQUE, graph.NODES, graph.EDGES}
    assert sorted(r["node_id"] for s, rows in ran if s == graph.NODES for r in rows) == ["a", "b", "c"]
    assert [r["child_id"] for s, rows in ran if s == graph.EDGES for r in rows] == ["b"]
    with pytest.raises(Violation):
        graph.export(nodes.unionByName(nodes), edges, lambda: Store(path))


def test_command_line(spark, tmp_path, capsys):
    from quirefold.__main__ import main

    root = tmp_path / "root"
    root.mkdir()
    (root / "a.pdf").write_bytes(pdf.text_pdf(["# One\nalpha beta gamma.", "## Two\ndelta."]))
    (root / "b.pdf").write_bytes(pdf.text_pdf(["Intro slide", "Plan slide"], 800, 600))
    (tmp_path / "s.yaml").write_text(f"root_dir: {root}\ninput_dir: {root}\nstorage_dir: {tmp_path}/st\n")
    (tmp_path / "q.yaml").write_text(f"root_dir: {root}\nstorage_dir: {tmp_path}/st\nqueries:\n  - where is the plan\n")
    main(["structure", "--config", str(tmp_path / "s.yaml")])
    assert spark.read.parquet(f"{tmp_path}/st/tree_nodes").where("kind = 'root'").count() == 2
    main(["query", "--config", str(tmp_path / "q.yaml")])
    out = capsys.readouterr().out
    assert "where is the plan" in out and "no answer" not in out
    assert isinstance(made("quirefold.functions.models:Offline"), Offline) and made("") is None


def test_stream(spark, tmp_path):
    from quirefold.streaming.transcripts import page_stream

    docs = spark.createDataFrame(DOCS, "doc_id long, filename string, format string, nb_pages long, text string")
    src, to, at = (str(tmp_path / n) for n in ("src", "to", "at"))
    docs.where("doc_id < 2").coalesce(1).write.parquet(src)
    page_stream(spark, src, to, at).awaitTermination()
    assert spark.read.parquet(to).count() == 3
    docs.where("doc_id = 2").coalesce(1).write.mode("append").parquet(src)
    page_stream(spark, src, to, at).awaitTermination()
    assert spark.read.parquet(to).where(F.col("doc_id") == 2).count() == 1


class Marking:
    """Leaves a mark in a folder while a call is open, and the most marks that it saw."""

    def __init__(self, folder):
        self.folder = str(folder)

    def generate(self, prompt, attachment=None):
        mark = os.path.join(self.folder, f"open-{uuid.uuid4().hex}")
        open(mark, "w").close()
        open(os.path.join(self.folder, f"most-{sum(x.startswith('open') for x in os.listdir(self.folder)):04d}"), "w").close()
        time.sleep(0.02)
        os.remove(mark)
        if "bad" in prompt:
            raise ValueError(prompt)
        return prompt.upper()

    def most(self):
        return max(int(x[5:]) for x in os.listdir(self.folder) if x.startswith("most"))


class Awaited(Marking):
    async def agenerate(self, prompt, attachment=None):
        return await asyncio.to_thread(self.generate, prompt)


@pytest.mark.parametrize("kind", [Marking, Awaited])
@pytest.mark.parametrize("workers", [1, 3, 8])
def test_calls_of_a_whole_stage(spark, tmp_path, workers, kind):
    """No more than `workers` calls are open at once over all tasks, rows keep their answers, and their order in a task."""
    provider = kind(tmp_path)
    rows = [(k, None if k % 17 == 5 else f"bad{k}" if k % 29 == 3 else f"p{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "id long, p string").repartition(8)
    got = generated(df, "p", "said", provider, workers=workers, strict=False).withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: (r.said, r.said_error) for r in got} == {k: (None, None) if p is None else (None, f"ValueError: {p}") if "bad" in p else (p.upper(), None) for k, p in rows}
    assert provider.most() <= workers and (workers < 3 or provider.most() > 1)
    assert len({r.task for r in got}) == max(1, workers // 4)
    with pytest.raises(Exception, match="bad"):
        generated(df, "p", "said", kind(tmp_path), workers=workers).collect()
    with pytest.raises(ValueError, match="positive"):
        generated(df, "p", "said", provider, workers=0)


def test_ingestion_that_breaks_off(spark, tmp_path, monkeypatch):
    """A run that breaks off at any write of its end stores nothing; tried again it stores each document once; so do two runs at once."""
    docs = spark.createDataFrame([(k, f"d{k}.pdf", "portrait", 1, f"# T{k}\ntext {k}") for k in range(4)], "doc_id long, filename string, format string, nb_pages long, text string")
    storage = str(tmp_path / "store")
    whole = runs.publish

    def half(spark, storage, run, tables):
        tables["documents"].write.mode("overwrite").parquet(f"{storage}/runs/{run}/documents")
        raise OSError("lost")

    monkeypatch.setattr(runs, "publish", half)
    with pytest.raises(OSError, match="lost"):
        ingest(docs, storage, Offline())
    assert runs.table(spark, storage, "documents") is None and runs.table(spark, storage, "hashes") is None
    monkeypatch.setattr(runs, "publish", whole)
    out = ingest(docs, storage, Offline())
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3] and len(runs.records(spark, storage)) == 1
    more = docs.unionByName(spark.createDataFrame([(9, "e.pdf", "portrait", 1, "# New\nx")], docs.schema))
    with ThreadPoolExecutor(2) as pool:
        for f in [pool.submit(ingest, more, storage, Offline()) for _ in range(2)]:
            f.result()
    assert sorted(r.doc_id for r in stored_documents(spark, storage).collect()) == [0, 1, 2, 3, 9]
    os.makedirs(f"{storage}/runs/left/documents")
    gone = runs.sweep(spark, storage)  # and the folders of tries that recorded nothing
    assert "left" in gone and len(os.listdir(f"{storage}/runs")) == 2 and stored_documents(spark, storage).count() == 5


def test_graph_format(spark, tmp_path, monkeypatch):
    """A tree goes to a store by batches, edges after all nodes; a job with a failing task leaves nothing staged and nothing merged."""
    import sqlite3

    from quirefold.sources import graph_format

    path = str(tmp_path / "store.db")
    here = os.path.dirname(os.path.abspath(__file__))
    (tmp_path / "double_here.py").write_text(f"import os, sys\nos.environ['GRAPH_DOUBLE'] = {path!r}\nsys.path[:0] = [{here!r}]\nfrom graph_double import Session\n")
    spark.sparkContext.addPyFile(str(tmp_path / "double_here.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    ask = lambda q: sqlite3.connect(path).execute(q).fetchall()
    nodes = spark.createDataFrame([(f"n{k}", k % 3, f"name {k}") for k in range(95)], "node_id string, doc_id long, name string").repartition(4)
    edges = spark.createDataFrame([(f"n{k // 2}", f"n{k}", k) for k in range(1, 95)] + [("n0", "lost", 1)], "parent_id string, child_id string, child_ord long").repartition(3)
    for _ in range(2):  # a second run replaces the first
        graph_format.write_graph(spark, nodes, edges, batch=10, connect="double_here:Session")
        assert ask("select count(*) from node") == [(95,)] and ask("select count(*) from edge") == [(94,)] and ask("select count(*) from staged") == [(0,)]
    ran = [r[0] for r in ask("select statement from ran")]
    assert ran.index(graph_format.PLACE["edges"]) > ran.index(graph_format.PLACE["nodes"]) and ran.count(graph_format.WIPE_SOME) > 5
    bad = nodes.unionByName(spark.createDataFrame([("new", 1, "poison"), ("other", 1, "x")], nodes.schema))
    with pytest.raises(Exception, match="refuses"):
        bad.write.format(graph_format.FORMAT).options(kind="nodes", batch="10", connect="double_here:Session").mode("append").save()
    assert ask("select count(*) from staged") == [(0,)] and ask("select count(*) from node where id in ('new', 'other')") == [(0,)]
    with pytest.raises(Violation):
        graph_format.write_graph(spark, nodes.unionByName(nodes), edges, connect="double_here:Session")
    assert ask("select count(*) from node") == [(95,)]


def test_prompts_stay_where_they_are_made(spark):
    """A prompt that is an expression is made after its rows are dealt out, and neither it nor what `only` leaves out comes back."""
    rows = spark.createDataFrame([(k, f"text {k}", b"x") for k in range(20)], "k long, text string, content binary")
    said = generated(rows, F.concat(F.lit("Say it.\n\n"), "text"), "said", Offline(), attachment="content", only=["k"])
    assert sorted(map(tuple, said.collect())) == [(k, f"text {k}") for k in range(20)] and said.columns == ["k", "said"]
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Say it.") < plan.index("Repartition")


def test_tools_are_embedded_once(spark):
    """The tools' embeddings are stored with the router, so no use pays for them again."""
    from quirefold.plans.answer import document_tools

    tools = document_tools(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, summary string"), Offline())
    chunks = spark.createDataFrame([(1, 1, 0, "1-1-0", "one", [0.0] * 64)], "doc_id long, page_number long, chunk_ord long, chunk_id string, text string, embedding array<float>")
    assert "MapInPandas" not in Router(chunks, tools, Offline()).tools._jdf.queryExecution().optimizedPlan().toString()


def test_stored_tables_are_not_shuffled_for_calls(spark, tmp_path):
    """A stage over a stored table takes its parts as they lie, in no more tasks than may call."""
    spark.range(0, 400, 1, 40).selectExpr("id as doc_id", "'landscape' as format", "concat('text ', id) as text").write.parquet(f"{tmp_path}/docs")
    said = landscape_pages(spark.read.parquet(f"{tmp_path}/docs"), Offline(), spread=False)
    assert said.count() == 400
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Coalesce 8" in plan


def test_files_are_opened_once(spark):
    """One parse of a file tells what probe() and pages() tell, also of files that can't be read and of those without pages."""
    good, wide, none = pdf.text_pdf(["one", "two (2)", ""]), pdf.text_pdf(["x"], 800, 600), pdf.text_pdf([])
    rows = [("a", "/a.pdf", good), ("b", "/b.pdf", wide), ("c", "/c.pdf", b"%PDF-1.4 broken"), ("d", "/d.pdf", none), ("e", "/e.pdf", None)]
    files = spark.createDataFrame(rows, "doc_id string, path string, content binary")
    got = pdf.opened(files, ["doc_id", "path"]).collect()
    heads = sorted((r.path, r.nb_pages, r.format, r.error) for r in got if r.page_number == 0)
    assert heads == sorted(map(tuple, pdf.probe(files).select("path", "nb_pages", "format", "error").collect()))
    cut = sorted((r.doc_id, r.page_number, bytes(r.content)) for r in got if r.page_number)
    assert cut == sorted((r.doc_id, r.page_number, bytes(r.content)) for r in pdf.pages(files, ["doc_id"], strict=False).collect()) and len(cut) == 4


def test_calls_that_are_work_of_their_task(spark):
    """A provider that waits for nothing is called in a task for each call that may be open, not by threads of a few tasks."""
    from quirefold.functions.models import window_of

    rows = spark.range(64).selectExpr("id", "concat('p', id) as p")
    said = generated(rows, "p", "said", Offline(), workers=12, window=window_of(Offline())).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in said}) == 12 and window_of(Flaky([])) == 4


def test_calls_share_their_context(spark, monkeypatch):
    """Pages that several questions share are put together once for all of them; every call keeps its own answer, over groups of any size."""
    from quirefold.functions import models
    from quirefold.operators.retrieval import shared_contexts

    monkeypatch.setattr(models, "GROUP", 7)
    chunks = spark.createDataFrame([(0, 1, k, f"c{k}", f"text {k}") for k in range(3)] + [(0, 2, 0, "d", "other"), (9, 9, 0, "e", "unused")], "doc_id long, page_number long, chunk_ord long, chunk_id string, text string")
    hits = [(q, 0, p, 1.0, r) for q in range(40) for r, p in enumerate((1, 2) if q % 2 else (2, 1), 1)] + [(99, 0, 2, 1.0, 1)]
    asked, contexts = shared_contexts(spark.createDataFrame(hits, "query_id long, doc_id long, page_number long, score double, rank long"), chunks)
    page = "text 0\ntext 1\ntext 2"
    assert sorted(r.context for r in contexts.collect()) == sorted(["other", f"{page}\nother", f"other\n{page}"])
    rows = spark.createDataFrame([(q, None if q == 3 else f"q{q}") for q in range(40)] + [(70, "alone")], "query_id long, query string").join(asked, "query_id", "left")
    said = models.generated_each(rows, contexts, "__pages", "query", ("Say.\n\n", "\n"), "context", "said", Offline(), workers=8)
    want = {q: None if q == 3 else f"q{q} text 0 text 1 text 2 other" if q % 2 else f"q{q} other text 0 text 1 text 2" for q in range(40)} | {70: "alone"}
    assert said.columns == ["query_id", "query", "said"] and {r.query_id: r.said for r in said.collect()} == want and said.count() == 41
    with pytest.raises(Exception, match="no"):
        models.generated_each(rows.withColumn("query", F.lit("bad")), contexts, "__pages", "query", ("Say.\n\n", "\n"), "context", "said", Fails()).collect()
