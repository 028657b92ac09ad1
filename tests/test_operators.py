import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from quirefold.functions import text as T
from quirefold.operators import outline as O
from quirefold.operators import pages as P
from quirefold.operators import retrieval as R
from quirefold.operators import sections as S
from quirefold.operators import tree as N
from quirefold.operators.checks import Violation
from quirefold.scratch import Scratch


def one(spark, function, *values):
    kinds = ", ".join(f"c{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], kinds).select(function(*(F.col(f"c{k}") for k in range(len(values)))).alias("r")).first()["r"]


@pytest.mark.parametrize(("said", "want"), [
    ("before\n```markdown\n# A\n```\nafter", "# A"),
    ("```markdown\na ```python\nb\n```", "a"),
    ("plain", "plain"),
    ("```markdown\n open ", "open"),
    ("```markdown\none\n```\n```markdown\ntwo\n```", "one"),
])
def test_unwrap(spark, said, want):
    assert one(spark, T.unwrap_markdown, said) == want


def test_json_block(spark):
    v = lambda c: F.try_variant_get(T.json_block(c), "$.a", "string")
    assert one(spark, v, 'x\n```json\n{"a": ""}\n```') == ""
    assert one(spark, lambda c: T.json_block(c).isNull(), "```json\n{a\n```") is True
    assert one(spark, lambda c: T.json_block(c).isNull(), "none") is True
    with pytest.raises(Exception, match="no JSON block"):
        one(spark, lambda c: T.strict_json_block(c).cast("string"), "none")


def test_names(spark):
    names = {k: one(spark, lambda c, k=k: T.storage_names(c)[k], "d/a b (1).pdf.pdf") for k in ("stem", "vector", "summary", "summary_text")}
    assert names == {"stem": "d/a_b__1_", "vector": "d/a_b__1__vector", "summary": "d/a_b__1__summary", "summary_text": "d/a_b__1__summary.txt"}
    assert one(spark, T.stem, "x/y.tar.gz") == "y.tar" and one(spark, T.media_type, "A.PDF") == "application/pdf"
    assert one(spark, T.strip, "\x1c  a \x85\n") == "a"


CASES = [
    ("pre\n# A\nx", [(0, "/", "pre"), (1, "/", "# A\nx")]),
    ("\n\n# A", [(2, "/", "# A")]),
    ("# A\n### B\n### C", [(0, "/", "# A"), (1, "/A/", "### B"), (2, "/A/B/", "### C")]),
    ("# A\n```\n# no\n```\n## B", [(0, "/", "# A\n```\n# no\n```"), (4, "/A/", "## B")]),
    ("# A\n```\n# no", [(0, "/", "# A\n```\n# no")]),
    ("####### deep\n#\ttab\n#no", [(0, "/", "####### deep"), (1, "/", "# tab\n#no")]),
    ("", []),
]


def test_sections(spark):
    rows = [(k, text) for k, (text, _) in enumerate(CASES)]
    got: dict = {}
    for r in S.split_sections(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "section_ord").collect():
        got.setdefault(r.doc_id, []).append((r.line_number, r.header_path, r.text))
    assert [got.get(k, []) for k in range(len(CASES))] == [want for _, want in CASES]


def test_paths_as_a_stack(spark):
    random.seed(5)
    docs, want = [], {}
    for d in range(40):
        levels = [random.randint(1, 6) for _ in range(random.randint(1, 15))]
        docs.append((d, "\n".join("#" * n + f" t{k}" for k, n in enumerate(levels))))
        stack: list[str] = []
        for k, n in enumerate(levels):
            del stack[max(0, min(len(stack), n - 1)) :]
            want[d, k] = "/" + "".join(f"{s}/" for s in stack)
            stack.append(f"t{k}")
    found = S.split_sections(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_number): r.header_path for r in found} == want


def test_toc(spark):
    docs = [(0, "none"), (1, "# A\nx"), (2, "x\n# B"), (3, "\n# says [line 0]")]
    got = dict(S.markdown_toc(spark.createDataFrame(docs, "doc_id long, text string").withColumn("stem", F.lit("f"))).collect())
    assert got == {0: "", 1: "# A [line 0]", 2: "# f [line 0]\n# B [line 1]", 3: "# says [line 0] [line 1]"}


def test_pages(spark):
    docs = spark.createDataFrame([(0, "a\n--- end page 1\nb\n--- end page 2\n"), (1, "--- end page 3"), (2, " "), (3, "a --- end page 1 b"), (4, "text")], "doc_id long, text string")
    got = [tuple(r) for r in P.split_pages(docs).orderBy("doc_id", "page_number").collect()]
    assert got == [(0, 1, "a\n"), (0, 2, "\nb\n"), (1, 3, "")]
    assert {r.doc_id for r in P.unmatched_pages(docs).collect()} == {3, 4}
    with pytest.raises(Violation):
        P.split_pages(docs, strict=True)


def test_round_trip(spark):
    pages = spark.createDataFrame([(d, p, f"page {p} of {d}") for d in range(3) for p in range(1, 5)], "doc_id long, page_number long, text string")
    back = P.split_pages(P.assemble(pages)).select("doc_id", "page_number", T.strip(F.col("text")).alias("text"))
    assert sorted(back.collect()) == sorted(pages.collect())


def test_chunks(spark):
    pages = spark.createDataFrame([(0, 1, "One two. Three four five! Six\nseven eight nine ten eleven.")], "doc_id long, page_number long, text string")
    got = [(r.chunk_ord, r.n_tokens, r.text) for r in P.chunk_sentences(pages, 5).orderBy("chunk_ord").collect()]
    assert got == [(0, 5, "One two. Three four five!"), (1, 1, "Six"), (2, 5, "seven eight nine ten eleven.")] and P.chunk_sentences(pages, 0).count() == 1


def outline(spark, structure, nb_pages=3):
    docs = spark.createDataFrame([(0, nb_pages, "d.pdf", structure)], "doc_id long, nb_pages long, filename string, structure string")
    return [(r.number, r.name, r.parent_number) for r in O.landscape_outline(docs).orderBy("ord").collect()]


def test_landscape(spark):
    assert outline(spark, "- Page 1 : a\n# A\njunk\n- Page 1 : again\n- Page 9 : over\n### B\n- Page 2 : b\n## C") == [
        (-1, "d", None), (1, "a", -1), (-2, "A", -1), (-3, "B", -2), (2, "b", -3), (-4, "C", -2), (-5, "Uncategorized", -1), (3, "Page number 3", -5)]
    assert outline(spark, "# A\n- Page 0 : zero\n- Page 1 : a\n- Page 2 : b\n- Page 3 : c")[2] == (0, "zero", -2)


def test_portrait(spark):
    docs = spark.createDataFrame([(0, "d.pdf", "# A [line 0]\n# [line 2]\n### B [line 4]\n## C [line 7]"), (1, "e.pdf", "# A [line 3]\n# B [line 1]"), (2, "f.pdf", "")], "doc_id long, filename string, structure string")
    got = [(r.number, r.name, r.parent_number) for r in O.portrait_outline(docs).where("doc_id = 0").orderBy("ord").collect()]
    assert got == [(-1, "d", None), (0, "A", -1), (4, "B", 0), (7, "C", 0)]
    assert sorted(tuple(r) for r in O.portrait_violations(docs).collect()) == [(1, "order"), (2, "empty")]


def test_index(spark):
    docs = spark.createDataFrame([(0, 2, "d.pdf", "# A\n- Page 1 : a")], "doc_id long, nb_pages long, filename string, structure string")
    parts = spark.createDataFrame([(0, 1, 1, "one"), (0, 1, 2, "one again"), (0, 2, 3, "two"), (0, 7, 4, "lost")], "doc_id long, number long, seq long, content string")
    tree = O.landscape_outline(docs)
    nodes, edges = N.build_index(tree, parts)
    content = {(r.kind, r.number): r.content for r in nodes.collect()}
    assert content["page", 1] == "one again" and content["orphan", 7] == "lost" and content["abstract", -2] == "A"
    assert N.integrity(nodes, edges).isEmpty() and N.size(nodes) == 6
    root = N.roots(nodes).first().node_id
    assert len(N.children_of(nodes, edges, root)) == 2 and N.parent_of(nodes, edges, root) is None
    with pytest.raises(Violation):
        N.children_of(nodes, edges, "no such")
    with pytest.raises(Violation):
        N.build_index(tree, parts.where("number <> 2"))
    left, kept, found = N.delete_document(nodes, edges, 5)
    assert not found and left.count() == 6 and kept.count() == edges.count()
    assert N.delete_document(nodes, edges, 0)[0].isEmpty()


def test_index_numbered_once(spark):
    """Where both tables are read, edges come from the numbers that the nodes were made with: the outline isn't scanned again."""
    docs = spark.createDataFrame([(0, 2, "d.pdf", "# A\n- Page 1 : a\n## B\n- Page 2 : b"), (1, 1, "e.pdf", "# A")], "doc_id long, nb_pages long, filename string, structure string")
    tree, parts = O.landscape_outline(docs), spark.createDataFrame([], "doc_id long, number long, seq long, content string")
    (nodes, edges), (_, apart) = N.build_index(tree, parts, strict=False, scratch=Scratch(spark)), N.build_index(tree, parts, strict=False)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert scans(edges) == 0 and scans(nodes) == 0 and scans(apart) > 0
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, apart.collect()))
    tops = nodes.where("kind = 'root' or number = -2")
    looked_up = N.subtree(nodes, edges, tops.select("node_id")).select("start_id", "node_id", "depth")
    below = N.subtree(nodes, edges, tops, own=True, carry=("number",))
    assert sorted(map(tuple, below.select("start_id", "node_id", "depth").collect())) == sorted(map(tuple, looked_up.collect()))
    assert {r.start_number for r in below.where("node_id = start_id").select("start_number").collect()} == {-1, -2}
    bare = nodes.drop(*N.PLACE)
    again = N.subtree(bare, edges, bare.where("kind = 'root' or number = -2"), own=True, carry=("number",))
    assert sorted(map(tuple, again.select("start_id", "node_id", "depth").collect())) == sorted(map(tuple, looked_up.collect()))


def test_tree_detached_scans_once(spark, monkeypatch):
    from quirefold import queries

    given = []
    monkeypatch.setattr(N, "delete_node", lambda nodes, edges, gone, plain=N.delete_node: given.append(edges) or plain(nodes, edges, gone))
    queries.QUERIES["tree_detached"](spark, DATA)
    assert "MapInArrow" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_full_pages(spark):
    chunks = spark.createDataFrame([(0, 1, 0, "a", "x", [1.0, 0.0]), (0, 1, 1, "b", "y", [0.9, 0.1]), (0, 2, 2, "c", "z", [0.9, 0.1])], "doc_id long, page_number long, chunk_ord long, chunk_id string, text string, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vec array<float>")
    hits = R.chunk_top_k(chunks, asked, 5)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == ["a", "b", "c"]  # of equal scores the smaller id
    assert [(r.page_number, r.rank, r.text) for r in R.full_pages(hits, chunks).orderBy("rank").collect()] == [(1, 1, "x\ny"), (2, 2, "z")]


def test_deep_headings(spark):
    """A line of 5,000 marks, 1,000 nested headings and an ordinary document in one table."""
    nested = "\n".join("#" * n + f" h{n}" for n in range(1, 1001))
    docs = spark.createDataFrame([(0, "#" * 5000 + " far\n# near"), (1, nested), (2, "# A\n## B")], "doc_id long, text string")
    got: dict = {}
    for r in S.split_sections(docs).orderBy("doc_id", "section_ord").collect():
        got.setdefault(r.doc_id, []).append((r.header, r.level, r.header_path))
    assert got[0] == [("far", 5000, "/"), ("near", 1, "/")] and got[2] == [("A", 1, "/"), ("B", 2, "/A/")]
    assert len(got[1]) == 1000 and got[1][999][2] == "/" + "".join(f"h{n}/" for n in range(1, 1000))
    outlines = docs.select("doc_id", F.lit(0).cast("long").alias("nb_pages"), F.lit("d.pdf").alias("filename"), F.col("text").alias("structure"))
    tree = O.landscape_outline(outlines)
    rows = {(r.doc_id, r.number): (r.parent_number, r.depth) for r in O.with_depth(tree).collect()}
    assert rows[0, -2] == (-1, 1) and rows[0, -3] == (-1, 1) and rows[1, -1001] == (-1000, 1000)
    nodes, edges = N.build_index(tree, spark.createDataFrame([], "doc_id long, number long, seq long, content string"))
    below = N.subtree(nodes, edges, N.roots(nodes).select("node_id"))
    assert below.where("doc_id = 1").agg(F.max("depth")).first()[0] == 1000 and below.count() == 3 + 2 + 1000 + 2
    lined = docs.select("doc_id", F.lit("d.pdf").alias("filename"), F.regexp_replace("text", "(h[0-9]+|far|near|A|B)", "$1 [line 7]").alias("structure"))
    assert O.portrait_outline(lined).where("doc_id = 1").count() == 1001


def test_outline_by_a_stack(spark):
    random.seed(15)
    docs, want = [], {}
    for d in range(60):
        lines, stack, heads, seen, rows = [], [], 0, set(), []
        for k in range(random.randint(0, 14)):
            if random.random() < 0.5:
                level = random.randint(1, 5)
                lines.append("#" * level + f" s{k}")
                stack = [x for x in stack if x[0] < level]
                rows.append((-2 - heads, stack[-1][1] if stack else -1))
                stack.append((level, -2 - heads))
                heads += 1
            else:
                page = random.randint(0, 7)
                lines.append(f"- Page {page} : t{k}")
                if page <= 5 and page not in seen:
                    seen.add(page)
                    rows.append((page, -1 - heads if heads else -1))
        rest = [n for n in range(1, 6) if n not in seen]
        want[d] = [(-1, None), *rows, *([(-2 - heads, -1)] if rest else []), *((n, -2 - heads) for n in rest)]
        docs.append((d, 5, "d.pdf", "\n".join(lines)))
    found: dict = {}
    for r in O.landscape_outline(spark.createDataFrame(docs, "doc_id long, nb_pages long, filename string, structure string")).orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append((r.number, r.parent_number))
    assert found == want


def test_upkeep_of_a_tree(spark):
    nodes = spark.createDataFrame([("r", 1, "root"), ("a", 1, "page"), ("b", 1, "page"), ("o", 2, "page")], "node_id string, doc_id long, kind string")
    edges = spark.createDataFrame([("r", "a", 1)], "parent_id string, child_id string, child_ord long")
    edges = N.set_parent(nodes, edges, "b", "r")
    assert sorted(map(tuple, edges.collect())) == [("r", "a", 1), ("r", "b", 2)] and N.set_parent(nodes, edges, "b", "r").count() == 2
    assert N.children_of(nodes, N.set_children(nodes, edges, "r", ["b", "a"]), "r") == ["b", "a"]
    for wrong in (lambda: N.set_parent(nodes, edges, "x", "r"), lambda: N.set_parent(nodes, edges, "b", "a"), lambda: N.set_children(nodes, edges, "a", ["b"]), lambda: N.set_root(nodes, "a"), lambda: N.set_root(nodes, "x")):
        with pytest.raises(Violation):
            wrong()
    assert N.roots(N.set_root(nodes, "o")).count() == 2
    left, gone = N.remove_child(edges, "r", "a")
    assert gone and left.count() == 1 and not N.remove_child(left, "r", "a")[1]
    more = N.insert_nodes(nodes, spark.createDataFrame([("n", 2, "page")], "node_id string, doc_id long, kind string"))
    assert N.size(more) == 5 and N.is_node(more, "n") and not N.is_node(nodes, "n")
    kept, cut = N.delete_node(more, edges, spark.createDataFrame([("a",)], "node_id string"))
    assert N.size(kept) == 4 and [r.child_id for r in cut.collect()] == ["b"]
    with pytest.raises(Violation):
        N.lineage(spark.createDataFrame([("p", "q", 1), ("q", "p", 1)], "parent_id string, child_id string, child_ord long"))


def test_tags_are_letters(spark):
    assert one(spark, T.unwrap_any, "a\n```json5 x\n```") == "5 x" and one(spark, T.unwrap_any, "```py_t\nx\n```") == "_t\nx"


def test_long_sentences_are_cut(spark):
    pages = spark.createDataFrame([(0, 1, " ".join(f"w{k}" for k in range(11)) + ". End.")], "doc_id long, page_number long, text string")
    got = [(r.chunk_ord, r.n_tokens) for r in P.chunk_sentences(pages, 4).orderBy("chunk_ord").collect()]
    assert got == [(0, 4), (1, 4), (2, 4)]


def test_hundred_thousand_headings(spark):
    """One document of 100,000 headings: sections, outlines, depths and numbers in seconds, with the rows of plain stacks."""
    n = 100_000
    random.seed(3)
    levels = [random.randint(1, 9) for _ in range(n)]
    text = "\n".join("#" * level + f" h{k} [line {k}]" for k, level in enumerate(levels))
    docs = spark.createDataFrame([(0, n, "d.pdf", text), (1, 1, "e.pdf", "# a [line 0]")], "doc_id long, nb_pages long, filename string, structure string")
    stack, depth, parent, last = [], [], [], list(range(n))
    for k, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parent.append(stack[-1] if stack else -1)
        depth.append(len(stack) + 1)
        stack.append(k)
    for k in reversed(range(n)):
        if parent[k] >= 0:
            last[parent[k]] = max(last[parent[k]], last[k])
    began = time.time()
    portrait = {r.number: (r.parent_number, r.depth, r.last - 1) for r in O.numbered(O.portrait_outline(docs)).where("doc_id = 0 and number >= 0").collect()}
    assert portrait == {k: (parent[k], depth[k], last[k]) for k in range(n)}
    slides = docs.withColumn("nb_pages", F.lit(0).cast("long"))
    landscape = {r.number: (r.parent_number, r.depth) for r in O.with_depth(O.landscape_outline(slides)).where("doc_id = 0").collect()}
    assert landscape[-1] == (None, 0) and all(landscape[-2 - k] == (-2 - parent[k] if parent[k] >= 0 else -1, depth[k]) for k in range(n))
    assert S.split_sections(docs.select("doc_id", F.col("structure").alias("text"))).where("doc_id = 0").count() == n
    words = spark.createDataFrame([(0, 1, "One two. " * n)], "doc_id long, page_number long, text string")
    assert P.chunk_sentences(words, 100).agg(F.count("*"), F.sum("n_tokens")).first()[:] == (n // 50, 2 * n)
    assert time.time() - began < 60


def test_trees_by_numbers(spark):
    """Subtrees, ancestors and walks by numbers are those by edges; numbers survive deleted and inserted nodes."""
    random.seed(9)
    parent = {f"n{k}": f"n{random.randrange(max(0, k - 4), k)}" for k in range(1, 60)}
    rows = [(f"n{k}", k % 3, "page") for k in range(60)] + [("lone", 7, "orphan")]
    count: dict = {}
    edges = []
    for c, p in parent.items():
        count[p] = count.get(p, 0) + 1
        edges.append((p, c, count[p]))
    nodes = spark.createDataFrame(rows, "node_id string, doc_id long, kind string")
    arcs = spark.createDataFrame(edges, "parent_id string, child_id string, child_ord long")

    def below(top, gone=()):
        out, todo = [], [(top, 0)]
        while todo:
            at, d = todo.pop()
            out.append((at, d))
            todo += [(c, d + 1) for p, c, _ in sorted(edges, key=lambda e: -e[2]) if p == at and c not in gone]
        return out

    placed = N.renumber(nodes, arcs)
    starts = spark.createDataFrame([("n0",), ("n5",), ("lone",)], "node_id string")
    got: dict = {}
    for r in N.walk(N.subtree(placed, arcs, starts)).orderBy("start_id", "place").collect():
        got.setdefault(r.start_id, []).append((r.node_id, r.depth))
    assert got == {s: below(s) for s in ("n0", "n5", "lone")}
    up = {(r.node_id, r.above_id, r.steps) for r in N.ancestors(placed, spark.createDataFrame([("n50",), ("n0",)], "node_id string")).collect()}
    chain, at = [], "n50"
    while at in parent:
        at = parent[at]
        chain.append(at)
    assert up == {("n50", a, k + 1) for k, a in enumerate(chain)}
    gone = ("n3", "n8")
    left, kept = N.delete_node(placed, arcs, spark.createDataFrame([(g,) for g in gone], "node_id string"))
    left = N.insert_nodes(left, spark.createDataFrame([("new", 1, "page")], "node_id string, doc_id long, kind string"))
    tops = [r.node_id for r in left.where("tree = node_id").select("node_id").collect()]
    assert sorted(tops) == sorted(["n0", "lone", "new", *(c for c, p in parent.items() if p in gone and c not in gone)])
    again: dict = {}
    for r in N.walk(N.subtree(left, kept, spark.createDataFrame([(t,) for t in tops], "node_id string"))).orderBy("start_id", "place").collect():
        again.setdefault(r.start_id, []).append((r.node_id, r.depth))
    assert again == {t: below(t, gone) for t in tops}


@pytest.mark.parametrize("block", [2048, 7])
def test_best_by_blocks(spark, monkeypatch, block):
    """The best of each group against plain sums: ties, equal and odd vectors, many blocks; one plan whatever the questions."""
    monkeypatch.setattr(R, "BLOCK", block)
    random.seed(4)
    vector = lambda: [random.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]
    chunks = [(k, k % 3, f"t{k}", vector()) for k in range(120)] + [(500, 0, "null", None), (501, 1, "part", [1.0, None, 0.0, 0.0]), (502, 2, "long", [1.0] * 5), (503, None, "zero", [0.0] * 4)]
    asked = [(k, vector()) for k in range(0, 60, 3)] + [(900, [1.0] * 5), (901, None)]

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return 0.0
        m = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / m, 9) if m else 0.0

    docs = spark.createDataFrame(chunks, "chunk_id long, doc_id long, text string, embedding array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, query_vec array<double>").repartition(2)
    for by in ([], ["doc_id"]):
        got: dict = {}
        found = R.best(docs, questions, 4, by, apart=True)
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault((r.query_id, r.doc_id if by else 0), []).append((r.chunk_id, round(r.score, 9), r.text))
        want: dict = {}
        for q, v in asked:
            for c, d, t, w in sorted(chunks, key=lambda x: (-cosine(v, x[3]), x[0])):
                held = want.setdefault((q, d if by else 0), [])
                if c != q and len(held) < 4:
                    held.append((c, cosine(v, w), t))
        assert got == want
    size = lambda q: R.best(docs, q, 4, [])._jdf.queryExecution().optimizedPlan().toString().count("\n")
    many = spark.createDataFrame([(k, [1.0]) for k in range(5000)], questions.schema).repartition(2)
    assert size(questions) == size(many)


def test_fanout_of_any_size(spark, monkeypatch):
    """A question meets the chunks of its own documents only, in blocks; the plan is no larger for many questions."""
    import numpy as np

    monkeypatch.setattr(R, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(d, 10 * c + d, [float(x) for x in rng.integers(-3, 4, 4)]) for c in range(20) for d in range(3)] + [(1, 900, None), (1, 901, [0.0] * 4), (1, 902, [1.0, 2.0]), (None, 903, [1.0] * 4)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, embedding array<float>")
    asked = [(q, [float(x) for x in rng.integers(-3, 4, 4)]) for q in range(5000)]
    questions = spark.createDataFrame(asked, "query_id long, query_vec array<float>")
    routed = questions.select("query_id", (F.col("query_id") % 4).alias("doc_id"))

    def cosine(a, b):
        if a is None or len(a) != len(b):
            return 0.0
        n = float(np.linalg.norm(a) * np.linalg.norm(b))
        return round(float(np.dot(a, b)) / n, 6) if n else 0.0

    got = R.compare_fanout(routed, chunks, questions, 3)
    found = {}
    for r in got.where("query_id < 60").collect():
        found.setdefault((r.query_id, r.doc_id), []).append((r["rank"], round(r.score, 6), r.chunk_id))
    for q, v in asked[:60]:
        best = sorted((-cosine(e, v), c) for d, c, e in rows if d == q % 4)[:3]
        assert sorted(found.get((q, q % 4), [])) == [(k + 1, -s, c) for k, (s, c) in enumerate(best)]
    assert got.count() == 3 * 3750
    size = lambda n: R.compare_fanout(spark.createDataFrame([(q, q % 3) for q in range(n)], routed.schema), chunks, questions, 3)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(5000) == size(5)


def test_files_in_one_part_are_read_by_many_tasks(spark):
    """PDF files that lie in one partition are dealt out before they are parsed, and probed in one pass that is stored."""
    import tempfile

    from quirefold.functions.models import Offline
    from quirefold.plans.ingest import documents
    from quirefold.sources.pdf import text_pdf

    rows = [(k, f"file:///in/{k}.pdf", text_pdf([f"page {k} (a) \\ %{p}" for p in range(3)])) for k in range(40)]
    files = spark.createDataFrame(rows, "doc_id long, path string, content binary").coalesce(1)
    found = documents(files, tempfile.mkdtemp() + "/cache", Offline())
    got = {r.doc_id: (r.nb_pages, r.text) for r in found.collect()}
    assert all(n == 3 and f"page {k} (a) \\ %2" in text for k, (n, text) in got.items()) and len(got) == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_floors_over_blocks(spark, monkeypatch):
    """Searches of a whole collection and of each document hold what scoring every pair gives, over many blocks, with ties, vectors without
    a direction and rows that are handed on early."""
    import numpy as np

    from quirefold.operators import retrieval as R

    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (700, 6)).astype(float).tolist()
    vectors[5], vectors[6], vectors[7], vectors[8] = None, [0.0] * 6, [float("nan")] + [1.0] * 5, [1.0, 2.0]
    rows = [(k % 3, f"c{k * 7919 % 1000:03d}", v) for k, v in enumerate(vectors)]
    asked = [(q, rng.integers(-2, 3, 6).astype(float).tolist()) for q in range(40)] + [(90, None), (91, [0.0] * 6)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, embedding array<double>").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, query_vec array<double>").repartition(2)

    def score(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        x, y = (np.array(v) / n if (n := np.sqrt(np.square(v).sum())) != 0 else np.zeros(len(v)) for v in (a, b))
        return float(np.round(x @ y, 12)) + 0.0

    def top(q, v, members):
        scored = [(score(c[2], v), c[1]) for c in members]
        scored.sort(key=lambda s: (-(np.inf if np.isnan(s[0]) else s[0]), s[1]))
        return [(q, tie, rank, None if np.isnan(s) else round(s, 9)) for rank, (s, tie) in enumerate(scored[:4], 1)]

    def plain(found):
        return sorted((r.query_id, r.chunk_id, r["rank"], None if np.isnan(r.score) else round(r.score, 9)) for r in found.collect())

    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "HELD", 50)
    key = lambda r: (r[0], r[1])
    assert sorted(plain(R.best(chunks, questions, 4, [])), key=key) == sorted((r for q, v in asked for r in top(q, v, rows)), key=key)
    met = questions.withColumn("doc_id", F.col("query_id") % 3)
    assert sorted(plain(R.best_met(chunks, met, 4, "doc_id")), key=key) == sorted((r for q, v in asked for r in top(q, v, [c for c in rows if c[0] == q % 3])), key=key)


def test_short_pages_are_one_piece(spark):
    """Pages that fit are chunked without their sentences becoming rows; the chunks are those of the scan."""
    texts = ["One. Two!\n\nThree four?  Five", "  \n ", " wide space.  End　", "a\u0001b c.", "x " * 9 + "y. z", ""]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_number long, text string").withColumn("doc_id", F.lit(1))
    got = {r.page_number: (r.chunk_ord, r.n_tokens, r.text) for r in P.chunk_sentences(pages, 20).collect()}
    assert got == {0: (0, 5, "One. Two! Three four? Five"), 2: (0, 3, "wide space.\u00a0 End"), 3: (0, 3, "a b c."), 4: (0, 11, "x x x x x x x x x y. z")}
