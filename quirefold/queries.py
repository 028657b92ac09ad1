"""Registered queries over the engine's operators, and the DuckDB SQL that gives the same rows.

Each runs over its whole tables; searches ask the vectors of every id divisible by 20, against all rows. Model stages use the
offline provider, which always answers alike, so most have SQL too; tests hold the others against goldens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold import fixtures as X
from quirefold.functions import text as T
from quirefold.functions.models import Offline, embedded, generated, reformatted, summaries
from quirefold.operators import outline as O
from quirefold.operators import pages as P
from quirefold.operators import retrieval as R
from quirefold.operators import sections as S
from quirefold.operators import store as D
from quirefold.operators import tree as N
from quirefold.operators.checks import lacking
from quirefold.plans import runs
from quirefold.plans.answer import Router, document_tools, index_chunks, stored_index
from quirefold.scratch import Scratch
from quirefold.sources import files as FS
from quirefold.sources import prompts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LONG = "long"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.strip()
        return f

    return add


# ---- retrieval

_SCORED = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT CAST(label AS BIGINT) AS doc_id, 1 + vec_id % 7 AS page_number, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query_id, doc_id, page_number, chunk_id, list_cosine_similarity(qv, v) AS score FROM q JOIN c ON chunk_id <> query_id)"""


def _others(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.f_chunks(spark, sf_dir), X.f_questions(spark, sf_dir)


@query(f"""
WITH {_SCORED},
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, page_number ORDER BY r) AS k FROM t QUALIFY k = 1),
p AS (SELECT doc_id, page_number, string_agg('chunk ' || CAST(chunk_id AS VARCHAR), chr(10) ORDER BY chunk_id) AS text, min(chunk_id) AS first_chunk FROM c GROUP BY ALL)
SELECT query_id, f.doc_id, f.page_number, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, text, first_chunk FROM f JOIN p ON p.doc_id = f.doc_id AND p.page_number = f.page_number""")
def retrieve_full_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _others(spark, sf_dir)
    # one collection searched as a whole
    found = R.best(chunks, asked, 5, [], apart=True)
    return R.full_pages(found, chunks, ["query_id"]).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_SCORED} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5""")
def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _others(spark, sf_dir)
    found = R.best(chunks, asked, 5, ["doc_id"], apart=True)
    return found.select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool for each label, its vector the mean of the label's vectors, to six places."""
    e = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast(LONG).alias("doc_key"), F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("doc_key", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    vectors = mean.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return vectors.withColumn("tool_name", F.concat(F.lit("doc_"), F.col("doc_key").cast("string")))


_TOOLS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
m AS (SELECT doc_key, i, round(avg(x), 6) AS x FROM (SELECT CAST(label AS BIGINT) AS doc_key, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY doc_key, i),
tools AS (SELECT doc_key, 'doc_' || CAST(doc_key AS VARCHAR) AS tool_name, list(x ORDER BY i) AS v FROM m GROUP BY doc_key),
r AS (SELECT query_id, doc_key, tool_name, list_cosine_similarity(qv, v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qv, v) DESC, tool_name) AS rank FROM q CROSS JOIN tools)"""


@query(f"WITH {_TOOLS} SELECT query_id, tool_name, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def tool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_top_k(_tools(spark, sf_dir), X.f_questions(spark, sf_dir), 3).select("query_id", "tool_name", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_TOOLS}, k AS (SELECT * FROM r WHERE rank <= 3)
SELECT query_id, tool_name, 'doc' AS kind, rank, '' AS members FROM k
UNION ALL SELECT query_id, 'compare_tool', 'compare', max(rank) + 1, string_agg(tool_name, ',' ORDER BY rank) FROM k GROUP BY query_id""")
def compare_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_compare(R.tool_top_k(_tools(spark, sf_dir), X.f_questions(spark, sf_dir), 3))


@query(f"""WITH {_TOOLS},
c AS (SELECT CAST(label AS BIGINT) AS doc_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.query_id, c.doc_id, c.chunk_id, list_cosine_similarity(qv, v) AS score FROM q CROSS JOIN c)
SELECT * FROM (SELECT s.query_id, s.doc_id, chunk_id, round(s.score, 6) AS score, row_number() OVER (PARTITION BY s.query_id, s.doc_id ORDER BY s.score DESC, chunk_id) AS rank
FROM s JOIN r ON r.query_id = s.query_id AND r.doc_key = s.doc_id AND r.rank <= 3) WHERE rank <= 2""")
def compare_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = _others(spark, sf_dir)
    routed = R.tool_top_k(_tools(spark, sf_dir), asked, 3).select("query_id", F.col("doc_key").alias("doc_id"))
    return R.compare_fanout(routed, chunks, asked, 2).select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# ---- pages and sections


@query("""
WITH l AS (SELECT doc_id, unnest(range(len(a))) + 1 AS n, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
p AS (SELECT doc_id, count(*) AS nb_pages, string_agg(t || chr(10) || chr(10) || '--- end page ' || CAST(n AS VARCHAR) || chr(10) || chr(10), '' ORDER BY n) AS text FROM l GROUP BY doc_id)
SELECT doc_id, nb_pages, length(text) AS n_chars, sha256(text) AS text_sha256 FROM p""")
def page_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast(LONG).alias("page_number"), "text")
    return P.assemble(pages).select("doc_id", "nb_pages", F.length("text").cast(LONG).alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(f"""
WITH {X.MD_SQL},
b AS (SELECT doc_id, pos // 6 + 1 AS page_number, string_agg(line || chr(10), '' ORDER BY pos) AS body FROM md_k GROUP BY ALL)
SELECT doc_id, page_number, sha256(CASE WHEN page_number = 1 THEN '' ELSE chr(10) || chr(10) END || body || chr(10) || chr(10)) AS text_sha256 FROM b""")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_pages(X.f_md(spark, sf_dir)).select("doc_id", "page_number", F.sha2("text", 256).alias("text_sha256"))


_CHUNKS = f"""{X.MD_SQL},
b AS (SELECT doc_id, pos // 6 + 1 AS page_number, string_agg(line || chr(10), '' ORDER BY pos) AS body FROM md_k GROUP BY ALL),
r AS (SELECT doc_id, page_number, unnest(string_split_regex(regexp_replace(body, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS s, unnest(range(len(string_split_regex(regexp_replace(body, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))))) AS ix FROM b),
t AS (SELECT doc_id, page_number, ix, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM r),
w AS (SELECT doc_id, page_number, ix, s, string_split_regex(s, '\\s+') AS ws FROM t WHERE s <> ''),
u AS (SELECT doc_id, page_number, ix, i, CASE WHEN len(ws) > 64 THEN array_to_string(ws[i * 64 + 1 : (i + 1) * 64], ' ') ELSE s END AS s FROM (SELECT *, unnest(range((len(ws) + 63) // 64)) AS i FROM w)),
n AS (SELECT doc_id, page_number, s, len(string_split_regex(s, '\\s+')) AS n, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ix, i) AS k FROM u),
p(doc_id, page_number, k, s, n, c, used) AS (SELECT doc_id, page_number, k, s, n, 0, n FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.page_number, n.k, n.s, n.n, CASE WHEN used + n.n > 64 THEN c + 1 ELSE c END, CASE WHEN used + n.n > 64 THEN n.n ELSE used + n.n END FROM n JOIN p ON p.doc_id = n.doc_id AND p.page_number = n.page_number AND n.k = p.k + 1)"""


@query(f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, page_number, CAST(c AS BIGINT) AS chunk_ord, CAST(sum(n) AS BIGINT) AS n_tokens, sha256(string_agg(s, ' ' ORDER BY k)) AS text_sha256 FROM p GROUP BY doc_id, page_number, c""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_sentences(P.split_pages(X.f_md(spark, sf_dir)), 64).select("doc_id", "page_number", "chunk_ord", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {X.MD_SQL} SELECT doc_id, n AS page_number FROM md, unnest(range(1, nb_pages + 1)) t(n)")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_numbers(X.f_md(spark, sf_dir)).select("doc_id", "page_number")


@query(f"WITH {X.MD_SQL} SELECT doc_id, length(string_split(text, '--- end page 10')[1]) AS n_chars FROM md")
def head_pages_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.f_md(spark, sf_dir).select("doc_id", F.length(T.head_pages(F.col("text"))).cast(LONG).alias("n_chars"))


_LINES = f"""{X.MD_SQL},
sl AS (SELECT doc_id, unnest(range(len(a) - 1)) AS line_no, unnest(a[:-2]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM md)),
fl AS (SELECT *, starts_with(ltrim(line), '```') AS is_fence, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_fence FROM sl),
hl AS (SELECT *, NOT is_fence AND NOT in_fence AND regexp_matches(line, '^(#+)\\s(.*)') AS is_header FROM fl),
sec AS (SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_ord FROM hl),
hd AS (SELECT doc_id, section_ord AS n, line_no, length(regexp_extract(line, '^(#+)\\s(.*)', 1)) AS level, regexp_extract(line, '^(#+)\\s(.*)', 2) AS header FROM sec WHERE is_header)"""


@query(f"""
WITH {_LINES},
dp AS (SELECT *, n + least(0, min(level - n) OVER (PARTITION BY doc_id ORDER BY n)) AS depth FROM hd),
an AS (SELECT a.doc_id, a.n, b.depth, arg_max(b.header, b.n) AS header FROM dp a JOIN dp b ON a.doc_id = b.doc_id AND b.n < a.n AND b.depth < a.depth GROUP BY a.doc_id, a.n, b.depth),
pa AS (SELECT doc_id, n, string_agg(header, '/' ORDER BY depth) AS path FROM an GROUP BY doc_id, n),
tx AS (SELECT doc_id, section_ord, regexp_replace(string_agg(CASE WHEN is_header THEN regexp_extract(line, '^(#+)\\s(.*)', 1) || ' ' || regexp_extract(line, '^(#+)\\s(.*)', 2) ELSE line END, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM sec GROUP BY doc_id, section_ord)
SELECT tx.doc_id, CAST(section_ord AS BIGINT) AS section_ord, coalesce(dp.line_no, 0) AS line_number, coalesce(dp.level, 0) AS level, coalesce(dp.header, '') AS header,
  CASE WHEN pa.path IS NULL OR pa.path = '' THEN '/' ELSE '/' || pa.path || '/' END AS header_path, sha256(text) AS text_sha256
FROM tx LEFT JOIN dp ON dp.doc_id = tx.doc_id AND dp.n = section_ord LEFT JOIN pa ON pa.doc_id = tx.doc_id AND pa.n = section_ord WHERE text <> ''""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_sections(X.f_md(spark, sf_dir)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


_TOC = f"""{_LINES},
en AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') || ' [line ' || CAST(line_no AS VARCHAR) || ']' AS entry FROM sec WHERE is_header),
fi AS (SELECT doc_id, arg_min(entry, line_no) AS entry FROM en GROUP BY doc_id),
al AS (SELECT doc_id, line_no, entry FROM en UNION ALL SELECT doc_id, -1, '# doc_' || CAST(doc_id AS VARCHAR) || ' [line 0]' FROM fi WHERE NOT contains(entry, '[line 0]'))"""


@query(f"""WITH {_TOC}, t AS (SELECT doc_id, string_agg(entry, chr(10) ORDER BY line_no) AS toc FROM al GROUP BY doc_id)
SELECT md.doc_id, coalesce(toc, '') AS toc FROM md LEFT JOIN t ON t.doc_id = md.doc_id""")
def markdown_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_toc(X.f_md(spark, sf_dir).withColumn("stem", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))))


@query(f"""
WITH {_TOC},
h AS (SELECT doc_id, line_no AS pos, length(regexp_extract(entry, '^(#+)\\s+(.*?)\\s+\\[line\\s+(\\d+)\\]', 1)) AS level, regexp_extract(entry, '^(#+)\\s+(.*?)\\s+\\[line\\s+(\\d+)\\]', 2) AS name,
  CAST(regexp_extract(entry, '^(#+)\\s+(.*?)\\s+\\[line\\s+(\\d+)\\]', 3) AS BIGINT) AS number FROM al WHERE regexp_matches(entry, '^(#+)\\s+(.*?)\\s+\\[line\\s+(\\d+)\\]')),
hp AS (SELECT a.doc_id, a.pos, a.number, a.name, a.level, arg_max(b.number, b.pos) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
u AS (SELECT doc_id, -2 AS pos, -1 AS number, 'doc_' || CAST(doc_id AS VARCHAR) AS name, 'root' AS kind, 0 AS level, NULL AS parent_number FROM md UNION ALL SELECT doc_id, pos, number, name, 'section', level, coalesce(parent, -1) FROM hp)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, CAST(number AS BIGINT) AS number, name, kind, CAST(level AS BIGINT) AS level, CAST(parent_number AS BIGINT) AS parent_number FROM u""")
def outline_portrait(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = X.f_md(spark, sf_dir).withColumn("stem", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    tocs = S.markdown_toc(named).select("doc_id", F.col("toc").alias("structure"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return O.portrait_outline(tocs)


# ---- outlines and trees

_OUTLINE = f"""{X.OUT_SQL},
h AS (SELECT doc_id, i, level, -1 - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number FROM out_k WHERE level IS NOT NULL),
hp AS (SELECT a.doc_id, a.i, a.level, a.number, arg_max(b.number, b.i) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.i < a.i AND b.level < a.level GROUP BY ALL),
pg AS (SELECT doc_id, page, min(i) AS i FROM out_k WHERE page <= nb_pages GROUP BY ALL),
pp AS (SELECT pg.doc_id, pg.page, pg.i, arg_max(h.number, h.i) AS parent FROM pg LEFT JOIN h ON h.doc_id = pg.doc_id AND h.i < pg.i GROUP BY ALL),
mi AS (SELECT d.doc_id, n AS page, -2 - (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id) AS parent FROM (SELECT doc_id, 3 + doc_id % 9 AS nb_pages FROM documents) d, unnest(range(1, nb_pages + 1)) t(n)
  WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_id = d.doc_id AND pg.page = n)),
un AS (SELECT doc_id, -1 AS pos, -1 AS number, 'deck_' || CAST(doc_id AS VARCHAR) AS name, 'root' AS kind, 0 AS level, NULL AS parent FROM documents
  UNION ALL SELECT doc_id, i, number, 'Section ' || CAST(i AS VARCHAR), 'abstract', level, coalesce(parent, -1) FROM hp
  UNION ALL SELECT doc_id, i, page, 'Title ' || CAST(i AS VARCHAR), 'page', 0, coalesce(parent, -1) FROM pp
  UNION ALL SELECT DISTINCT doc_id, 1000000, parent, 'Uncategorized', 'abstract', 1, -1 FROM mi
  UNION ALL SELECT doc_id, 1000000 + page, page, 'Page number ' || CAST(page AS VARCHAR), 'page', 0, parent FROM mi),
ol AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, CAST(number AS BIGINT) AS number, name, kind, CAST(level AS BIGINT) AS level, CAST(parent AS BIGINT) AS parent_number FROM un)"""
_DEPTH = f"""{_OUTLINE},
dp(doc_id, number, depth) AS (SELECT doc_id, number, 0 FROM ol WHERE parent_number IS NULL UNION ALL SELECT ol.doc_id, ol.number, depth + 1 FROM ol JOIN dp ON dp.doc_id = ol.doc_id AND dp.number = ol.parent_number),
od AS (SELECT ol.*, CAST(depth AS BIGINT) AS depth FROM ol JOIN dp ON dp.doc_id = ol.doc_id AND dp.number = ol.number)"""


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.landscape_outline(X.f_out(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each deck, the last of them twice, and one page that no outline names."""
    pages = X.f_out(spark, sf_dir).select("doc_id", "nb_pages", F.explode(F.sequence(F.lit(1).cast(LONG), F.col("nb_pages") + 1)).alias("number"))
    first = pages.select("doc_id", "number", F.col("number").alias("seq"), F.concat(F.lit("page "), F.col("number").cast("string")).alias("content"))
    again = pages.where("number = nb_pages").select("doc_id", "number", F.lit(1000).cast(LONG).alias("seq"), F.lit("last again").alias("content"))
    return first.unionByName(again)


def _index(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    return N.build_index(_outlines(spark, sf_dir), _parts(spark, sf_dir), strict=False, scratch=scratch)


@query(f"WITH {_OUTLINE} SELECT * FROM ol")
def outline_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir)


@query(f"WITH RECURSIVE {_DEPTH} SELECT doc_id, string_agg(repeat('  ', depth) || name || ' [' || CAST(number AS VARCHAR) || ']', chr(10) ORDER BY ord) AS tree FROM od GROUP BY doc_id")
def outline_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.render(O.with_depth(_outlines(spark, sf_dir)))


_PORTRAIT = "concat('# One [line ', CAST(doc_id % 3 AS VARCHAR), ']', chr(10), '## Two [line ', CAST(doc_id % 4 AS VARCHAR), ']')"


def _portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of two lines; those of ids that end in 9 are empty."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    lines = F.concat(F.lit("# One [line "), (F.col("doc_id") % 3).cast("string"), F.lit("]\n## Two [line "), (F.col("doc_id") % 4).cast("string"), F.lit("]"))
    return docs.select("doc_id", F.concat(F.lit("deck_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.when(F.col("doc_id") % 10 == 9, "").otherwise(lines).alias("structure"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'empty' ELSE 'order' END AS problem FROM documents WHERE doc_id % 10 = 9 OR doc_id % 3 <> 0 OR doc_id % 4 < doc_id % 3""")
def portrait_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.portrait_violations(_portraits(spark, sf_dir))


@query(f"""WITH {_OUTLINE},
pr AS (SELECT doc_id, 0 AS ord, -1 AS number, 'deck_' || CAST(doc_id AS VARCHAR) AS name, 'root' AS kind, 0 AS level, NULL AS parent_number FROM documents
  UNION ALL SELECT doc_id, 1, doc_id % 3, 'One', 'section', 1, -1 FROM documents WHERE doc_id % 10 <> 9
  UNION ALL SELECT doc_id, 2, doc_id % 4, 'Two', 'section', 2, doc_id % 3 FROM documents WHERE doc_id % 10 <> 9)
SELECT * FROM ol WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, ord, CAST(number AS BIGINT), name, kind, CAST(level AS BIGINT), CAST(parent_number AS BIGINT) FROM pr WHERE doc_id % 2 = 1""")
def outline_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of even ids are landscape, those of odd ids portrait."""
    slides = X.f_out(spark, sf_dir).where("doc_id % 2 = 0").withColumn("format", F.lit("landscape"))
    papers = _portraits(spark, sf_dir).where("doc_id % 2 = 1").withColumns({"format": F.lit("portrait"), "nb_pages": F.lit(1).cast(LONG)})
    return O.outline(slides.unionByName(papers))


def _placed(spark: SparkSession, sf_dir: str, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes as they are stored: with their numbers, in order. both: the edges are read too, so the outline is numbered once for both."""
    scratch = Scratch(spark)
    nodes, edges = _index(spark, sf_dir, scratch if both else None)
    return scratch.write(nodes.sortWithinPartitions("tree", "first"), "nodes"), edges


def _walk(spark: SparkSession, sf_dir: str, order: str, start: str) -> DataFrame:
    nodes, edges = _placed(spark, sf_dir)
    below = N.subtree(nodes, edges, nodes.where(start), own=True)
    return N.walk(below, order).select("doc_id", "number", "depth", "place")


@query(f"WITH RECURSIVE {_DEPTH} SELECT doc_id, number, depth, row_number() OVER (PARTITION BY doc_id ORDER BY depth, ord) - 1 AS place FROM od")
def tree_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, "bfs", "kind = 'root'")


@query(f"WITH RECURSIVE {_DEPTH} SELECT doc_id, number, depth, ord AS place FROM od")
def tree_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, "dfs", "kind = 'root'")


@query(f"""WITH RECURSIVE {_OUTLINE},
st(doc_id, number, depth) AS (SELECT doc_id, number, 0 FROM ol WHERE number = -2 UNION ALL SELECT ol.doc_id, ol.number, depth + 1 FROM ol JOIN st ON st.doc_id = ol.doc_id AND st.number = ol.parent_number)
SELECT st.doc_id, string_agg(repeat('  ', depth) || name || ' [' || CAST(st.number AS VARCHAR) || ']', chr(10) ORDER BY ord) AS tree FROM st JOIN ol ON ol.doc_id = st.doc_id AND ol.number = st.number GROUP BY st.doc_id""")
def tree_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _placed(spark, sf_dir)
    start = nodes.where("number = -2 and kind = 'abstract'")
    shown = N.render_subtree(N.subtree(nodes, edges, start.select("node_id")))
    return shown.join(start.select(F.col("node_id").alias("start_id"), "doc_id"), "start_id").select("doc_id", "tree")


_ID = "sha256(concat(CAST({d} AS VARCHAR), '|', {k}, '|', CAST({n} AS VARCHAR)))"
_EDGES = f"""ed AS (SELECT {_ID.format(d="c.doc_id", k="p.kind", n="p.number")} AS parent_id, {_ID.format(d="c.doc_id", k="c.kind", n="c.number")} AS child_id,
  row_number() OVER (PARTITION BY c.doc_id, c.parent_number ORDER BY c.ord) AS child_ord, c.doc_id, c.number, c.parent_number FROM ol c JOIN ol p ON p.doc_id = c.doc_id AND p.number = c.parent_number)"""
_NODES = f"""nd AS (SELECT {_ID.format(d="doc_id", k="kind", n="number")} AS node_id, doc_id, number, kind, name, CASE kind WHEN 'abstract' THEN name WHEN 'root' THEN '' ELSE CASE WHEN number = 3 + doc_id % 9 THEN 'last again' ELSE 'page ' || CAST(number AS VARCHAR) END END AS content FROM ol
  UNION ALL SELECT {_ID.format(d="doc_id", k="'orphan'", n="4 + doc_id % 9")}, doc_id, 4 + doc_id % 9, 'orphan', '', 'page ' || CAST(4 + doc_id % 9 AS VARCHAR) FROM documents)"""


@query(f"WITH {_OUTLINE}, {_NODES} SELECT node_id, doc_id, CAST(number AS BIGINT) AS number, kind, name, content FROM nd")
def tree_index_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].select("node_id", "doc_id", "number", "kind", "name", "content")


@query(f"WITH {_OUTLINE}, {_EDGES} SELECT parent_id, child_id, child_ord FROM ed")
def tree_index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1]


@query(f"WITH {_OUTLINE}, {_EDGES} SELECT parent_id, string_agg(child_id, ',' ORDER BY child_ord) AS children FROM ed GROUP BY parent_id")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.children(_index(spark, sf_dir)[1]).select("parent_id", F.array_join("children", ",").alias("children"))


@query(f"""WITH {_OUTLINE.replace('ol AS (', 'ol AS MATERIALIZED (')}, {_NODES.replace('nd AS (', 'nd AS MATERIALIZED (')},
up AS (SELECT c.doc_id, c.number, c.kind, {_ID.format(d="c.doc_id", k="p.kind", n="p.number")} AS parent_id FROM ol c JOIN ol p ON p.doc_id = c.doc_id AND p.number = c.parent_number)
SELECT node_id, coalesce(parent_id, '') AS parent_id FROM nd LEFT JOIN up ON up.doc_id = nd.doc_id AND up.number = nd.number AND up.kind = nd.kind""")
def tree_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parents(*_index(spark, sf_dir)).select("node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@query(f"WITH {_OUTLINE}, {_NODES} SELECT node_id, doc_id, name FROM nd WHERE kind = 'root'")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.roots(_index(spark, sf_dir)[0]).select("node_id", "doc_id", "name")


@query(f"""WITH {_OUTLINE}, {_EDGES}, {_NODES}
SELECT 'node' AS part, doc_id, count(*) AS n FROM nd WHERE doc_id <> 7 GROUP BY doc_id UNION ALL SELECT 'edge', doc_id, count(*) FROM ed WHERE doc_id <> 7 GROUP BY doc_id""")
def tree_delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = N.delete_document(*_index(spark, sf_dir), 7)
    owner = nodes.select(F.col("node_id").alias("child_id"), "doc_id")
    left = edges.join(owner, "child_id").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "doc_id", "n")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "doc_id", "n").unionByName(left)


@query("""WITH d AS (SELECT doc_id FROM documents)
SELECT 'duplicate id' AS problem, 'n' || CAST(doc_id AS VARCHAR) AS node_id FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT 'several parents', 'n' || CAST(doc_id AS VARCHAR) FROM d WHERE doc_id % 5 = 0 AND doc_id > 0
UNION ALL SELECT 'unknown node', 'x' || CAST(doc_id AS VARCHAR) FROM d WHERE doc_id % 11 = 0""")
def tree_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of nodes with planted faults: every 7th id twice, every 5th below a second parent, an edge of every 11th to nowhere."""
    ids = X.table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = ids.select(name(F.col("doc_id")).alias("node_id"))
    top = spark.createDataFrame([("top",), ("other",)], "node_id string")
    nodes = nodes.unionByName(ids.where("doc_id % 7 = 0").select(name(F.col("doc_id")).alias("node_id"))).unionByName(top)
    edge = lambda rows, parent, child: rows.select(parent.alias("parent_id"), child.alias("child_id"), F.lit(1).cast(LONG).alias("child_ord"))
    edges = edge(ids, F.lit("top"), name(F.col("doc_id"))).unionByName(edge(ids.where("doc_id % 5 = 0 and doc_id > 0"), F.lit("other"), name(F.col("doc_id"))))
    edges = edges.unionByName(edge(ids.where("doc_id % 11 = 0"), name(F.col("doc_id")), F.concat(F.lit("x"), F.col("doc_id").cast("string"))))
    return N.integrity(nodes, edges)


@query(f"WITH {_OUTLINE} SELECT doc_id, number FROM ol WHERE number = 2 AND doc_id % 3 = 0")
def tree_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document lacks its second page."""
    return N.missing_nodes(_outlines(spark, sf_dir), _parts(spark, sf_dir).where("number <> 2 or doc_id % 3 <> 0"))


@query("""SELECT CAST(user_id AS VARCHAR) AS node_id, event_type AS name, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"))
    return N.upsert_nodes(rows)


@query("""WITH e AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS parent_id, 't' || event_type AS child_id FROM events WHERE user_id % 3 <> 0 AND event_type <> 'purchase') SELECT * FROM e""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each user to each kind of event; users of every third id and one kind have no node."""
    events = X.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("parent_id"), F.concat(F.lit("t"), "event_type").alias("child_id"), "user_id", "event_type")
    nodes = events.where("user_id % 3 <> 0").select(F.col("parent_id").alias("node_id")).unionByName(events.where("event_type <> 'purchase'").select(F.col("child_id").alias("node_id")))
    return N.upsert_edges(events.select("parent_id", "child_id"), nodes)


@query(f"""WITH RECURSIVE {_OUTLINE},
up(doc_id, number, above, steps) AS (SELECT doc_id, number, parent_number, 1 FROM ol WHERE kind = 'page' AND parent_number IS NOT NULL
  UNION ALL SELECT up.doc_id, up.number, ol.parent_number, steps + 1 FROM up JOIN ol ON ol.doc_id = up.doc_id AND ol.number = up.above WHERE ol.parent_number IS NOT NULL)
SELECT doc_id, number, CAST(above AS BIGINT) AS above, CAST(steps AS BIGINT) AS steps FROM up""")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that stands above each page of an outline, by comparing numbers."""
    nodes, _ = _placed(spark, sf_dir)
    found = N.ancestors(nodes, nodes.where("kind = 'page'").select("node_id"))
    own, above = nodes.select("node_id", "doc_id", "number"), nodes.select(F.col("node_id").alias("above_id"), F.col("number").alias("above"))
    return found.join(own, "node_id").join(above, "above_id").select("doc_id", "number", "above", "steps")


@query(f"""WITH RECURSIVE {_OUTLINE},
cut AS (SELECT * FROM ol WHERE number <> -2 OR doc_id % 2 = 1),
st(doc_id, number, top, depth) AS (SELECT doc_id, number, number, 0 FROM cut WHERE parent_number IS NULL OR (parent_number = -2 AND doc_id % 2 = 0)
  UNION ALL SELECT cut.doc_id, cut.number, top, depth + 1 FROM cut JOIN st ON st.doc_id = cut.doc_id AND st.number = cut.parent_number)
SELECT doc_id, number, CAST(top AS BIGINT) AS top, CAST(depth AS BIGINT) AS depth FROM st""")
def tree_detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents lose their first heading: what lay below it is walked from tops of its own, by the numbers it had."""
    nodes, edges = _placed(spark, sf_dir, both=True)
    nodes = Scratch(spark).write(N.delete_node(nodes, edges, nodes.where("number = -2 and doc_id % 2 = 0"))[0].where("kind <> 'orphan'"), "cut")
    below = N.subtree(nodes, edges, nodes.where("tree = node_id"), own=True, carry=("number",))
    return below.select("doc_id", "number", F.col("start_number").alias("top"), "depth")


@query(f"WITH {_OUTLINE}, {_NODES} SELECT kind, count(*) AS n FROM nd GROUP BY kind")
def tree_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_OUTLINE}, {_NODES}, {_EDGES},
k AS (SELECT * FROM nd WHERE number <> 1 OR kind <> 'page')
SELECT 'node' AS part, doc_id, count(*) + 1 AS n FROM k GROUP BY doc_id UNION ALL SELECT 'edge', doc_id, count(*) FROM ed WHERE number <> 1 GROUP BY doc_id""")
def tree_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first page goes with its edge, and a new node comes in."""
    nodes, edges = _index(spark, sf_dir)
    owner = nodes.select(F.col("node_id").alias("child_id"), "doc_id")
    nodes, edges = N.delete_node(nodes, edges, nodes.where("kind = 'page' and number = 1"))
    new = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("node_id"), "doc_id", F.lit("orphan").alias("kind"))
    left = edges.join(owner, "child_id").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "doc_id", "n")
    return N.insert_nodes(nodes, new).groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "doc_id", "n").unionByName(left)


# ---- files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("file:///store/"), "lang", F.lit("/"), "source", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(").pdf"))
    return docs.select("doc_id", path.alias("path"), F.timestamp_seconds(F.col("doc_id") * 90_061).alias("modificationTime"), F.col("n_chars").alias("length"), "text")


@query("""SELECT lang || '/' || source || ' (' || CAST(doc_id AS VARCHAR) || ').pdf' AS relative_path, source || ' (' || CAST(doc_id AS VARCHAR) || ').pdf' AS file_name, 'application/pdf' AS file_type, n_chars AS file_size,
  strftime(make_timestamp(doc_id * 90061 * 1000000), '%Y-%m-%d') AS last_modified_date, quality FROM documents JOIN labels USING (doc_id)""")
def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File data with extra columns by key: labels of the files that have some."""
    files = _files(spark, sf_dir)
    extra = X.table(spark, sf_dir, "labels").join(files.select("doc_id", "path"), "doc_id").select("path", "quality")
    data = FS.file_metadata(files.join(extra.select("path"), "path", "left_semi"), "file:///store")
    joined = FS.attach_extra(data, extra)
    return joined.select("file.relative_path", "file.file_name", "file.file_type", "file.file_size", "file.last_modified_date", "quality")


@query("SELECT doc_id, sha256('data:application/pdf;base64,' || to_base64(encode(text))) AS url_sha256 FROM documents")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = T.data_url(F.encode("text", "utf-8"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace(url, "\\s", ""), 256).alias("url_sha256"))


@query("""
WITH l AS (SELECT doc_id, unnest(range(len(a))) + 1 AS n, unnest(a) AS t FROM (SELECT doc_id, string_split(regexp_replace(text, '[^\\x20-\\x7E\\n]', '?', 'g'), chr(10)) AS a FROM documents))
SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename, CASE WHEN doc_id % 2 = 0 THEN 'landscape' ELSE 'portrait' END AS format, count(*) AS nb_pages,
  sha256(string_agg(regexp_replace(t, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '--- end page ' || CAST(n AS VARCHAR) || chr(10) || chr(10), '' ORDER BY n)) AS text_sha256 FROM l GROUP BY doc_id""")
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, a page for each line (of printable ASCII), read, cut into pages, transcribed page by page and put together."""
    from quirefold.plans.ingest import documents

    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^\\x20-\\x7E\\n]", "?").alias("text"))
    files = docs.select("doc_id", F.concat(F.lit("file:///in/d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), X.as_pdf(F.col("text"), F.col("doc_id") % 2 == 0).alias("content"))
    scratch = Scratch(spark)
    read = documents(scratch.write(files, "files"), f"{scratch.root}/cache", Offline())
    return read.select("doc_id", "filename", "format", "nb_pages", F.sha2("text", 256).alias("text_sha256"))


# ---- text functions

_WRAP = """w AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'Here:' || chr(10) || '```markdown' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN '```markdown' || chr(10) || text ELSE text END AS t FROM conversations)"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```markdown\n"), "text", F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```markdown\n"), "text")).otherwise(F.col("text"))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))


@query(f"""WITH {_WRAP} SELECT conv_id, turn, role, CASE WHEN regexp_matches(t, '(?s)```markdown\\s*(.*?)(?:```|\\z)') THEN regexp_replace(regexp_extract(t, '(?s)```markdown\\s*(.*?)(?:```|\\z)', 1), '^\\s+|\\s+$', '', 'g') ELSE t END AS said FROM w""")
def unwrap_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("conv_id", "turn", "role", T.unwrap_markdown(F.col("t")).alias("said"))


@query(f"""WITH {_WRAP} SELECT conv_id, turn, role, CASE WHEN regexp_matches(t, '(?s)```([a-zA-Z]*)\\s*(.*?)(?:```|\\z)') THEN regexp_replace(regexp_extract(t, '(?s)```([a-zA-Z]*)\\s*(.*?)(?:```|\\z)', 2), '^\\s+|\\s+$', '', 'g') ELSE t END AS said FROM w""")
def unwrap_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("conv_id", "turn", "role", T.unwrap_any(F.col("t")).alias("said"))


@query("""SELECT event_id, event_id % 10 <> 0 AND json_valid(props) AS sound, CASE WHEN event_id % 10 <> 0 AND json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    said = X.table(spark, sf_dir, "events").select("event_id", T.json_block(F.concat(F.lit("Answer:\n```json\n"), body, F.lit("\n```"))).alias("v"))
    return said.select("event_id", F.col("v").isNotNull().alias("sound"), F.try_variant_get("v", "$.k", "long").alias("k"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'extracted ' || source WHEN doc_id % 3 = 1 THEN 'created ' || lang END AS toc FROM documents""")
def toc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    extracted = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("extracted "), "source")).otherwise("")
    created = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("created "), "lang"))
    return docs.select("doc_id", T.first_toc(extracted, created).alias("toc"))


@query("""SELECT CASE WHEN doc_id % 4 < 2 THEN 'landscape' ELSE 'portrait' END AS format, count(*) AS n, CAST(sum(CASE WHEN doc_id % 4 < 2 THEN length(text) ELSE 0 END) AS BIGINT) AS pages_chars FROM documents GROUP BY 1""")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").withColumn("format", T.orientation(4 - F.col("doc_id") % 4, F.lit(2)))
    slides = docs.where("format = 'landscape'").withColumn("pages", F.col("text"))
    both = slides.unionByName(docs.where("format = 'portrait'").withColumn("pages", F.lit("")))
    return both.groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("pages")).cast(LONG).alias("pages_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS toc FROM documents")
def sentinel_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("\n <none>\t")).otherwise(F.col("source"))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.sentinel(said).alias("toc"))


@query("SELECT doc_id, CASE WHEN n_chars % 1000 > doc_id % 1000 THEN 'landscape' ELSE 'portrait' END AS format FROM documents")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", T.orientation(F.col("n_chars") % 1000, F.col("doc_id") % 1000).alias("format"))


@query("""WITH p AS (SELECT page_id, 'in put/' || regexp_extract(url, '([^/]*)$', 1) || ' (' || CAST(page_id AS VARCHAR) || ').pdf.pdf' AS path FROM pages),
s AS (SELECT page_id, path, 'in put/' || replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[()\\s]', '_', 'g'), '.pdf', '') AS stem FROM p)
SELECT page_id, stem, stem || '_vector' AS vector, stem || '_summary' AS summary, stem || '_summary.txt' AS summary_text, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS bare, 'application/pdf' AS media FROM s""")
def storage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("in put/"), F.substring_index("url", "/", -1), F.lit(" ("), F.col("page_id").cast("string"), F.lit(").pdf.pdf")).alias("path"))
    names = T.storage_names(F.col("path"))
    return rows.select("page_id", *(c.alias(n) for n, c in names.items()), T.stem(F.col("path")).alias("bare"), T.media_type(F.col("path")).alias("media"))


@query("SELECT event_id, regexp_replace(props, '\\s', '', 'g') AS shown, true AS set_out FROM events")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = T.display(F.col("props"))
    return X.table(spark, sf_dir, "events").select("event_id", F.regexp_replace(shown, "\\s", "").alias("shown"), shown.contains("\n").alias("set_out"))


@query("""SELECT event_id, regexp_replace(props, '^\\{"k": ([0-9]+)\\}$', concat('{', chr(10), '  "k": \\1', chr(10), '}')) AS shown FROM events""")
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property set out, to the letter: what a viewer shows."""
    return X.table(spark, sf_dir, "events").select("event_id", T.display(F.col("props")).alias("shown"))


@query(f"""WITH {X.MD_SQL} SELECT doc_id, sha256(concat('{prompts.TOC}', CASE WHEN doc_id % 4 < 2 THEN 'The pages are slides.' || chr(10) ELSE '' END, string_split(text, '--- end page 10')[1])) AS prompt_sha256 FROM md""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stored(spark, sf_dir)
    return docs.select("doc_id", F.sha2(prompts.toc_prompt(T.head_pages(F.col("text")), F.col("format") == "landscape"), 256).alias("prompt_sha256"))


# ---- stored documents

@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'lang,quality,source' WHEN quality = 0 THEN 'lang,source' ELSE 'lang' END AS names FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def drop_null_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as a map: quality is there for good documents, the source for labelled ones."""
    rows = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = F.create_map(F.lit("source"), F.when(F.col("quality").isNotNull(), F.col("source")), F.lit("quality"), F.when(F.col("quality") == 1, F.lit("good")), F.lit("lang"), F.col("lang"))
    return rows.select("doc_id", F.array_join(F.sort_array(F.map_keys(D.without_nulls(found))), ",").alias("names"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 6 = 0 THEN 'lang,source' WHEN doc_id % 4 = 0 THEN 'lang' ELSE 'source' END AS lacks FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 0""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lack their language (every 4th) or source (every 6th)."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("source"))
    return lacking(docs, ["lang", "source"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT CAST(label AS BIGINT) FROM embeddings)")
def docs_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_source(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), X.f_chunks(spark, sf_dir))


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source FROM documents) GROUP BY source")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a stored table stay beside what is there, equal ones too."""
    docs = X.table(spark, sf_dir, "documents").select("source", "doc_id")
    return docs.where("doc_id % 2 = 0").unionByName(docs).groupBy("source").agg(F.count("*").alias("n"))



@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS n_hashes FROM documents WHERE doc_id % 4 <> 3 GROUP BY source")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and hashes stored in three runs, one of them tried twice, beside a fourth that broke off before its record."""
    storage = Scratch(spark).root
    docs = X.table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    for k in (0, 1, 1, 2):
        part = docs.where(F.col("doc_id") % 4 == k)
        runs.publish(spark, storage, runs.run_id(part, "doc_id"), {"documents": part.select("doc_id", "source", "text"), "hashes": part.select("doc_id", "hash")})
    docs.where("doc_id % 4 = 3").select("doc_id", "source", "text").write.parquet(f"{storage}/runs/broken/documents")
    both = runs.table(spark, storage, "documents").join(runs.table(spark, storage, "hashes"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("n_hashes"))


@query("""SELECT doc_id, name, value FROM (SELECT doc_id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents) WHERE value IS NOT NULL""")
def metadata_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.key_values(X.table(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "n_chars"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'file_' || source || '.pdf' END AS choice FROM documents")
def doc_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.choices(X.table(spark, sf_dir, "documents").withColumn("filename", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("file_"), "source", F.lit(".pdf")))))


@query("SELECT count(*) AS n_docs FROM documents")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lookup(X.table(spark, sf_dir, "documents"), 17).select("doc_id", "lang", "n_chars")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, d.source) AS source, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = X.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("extra"), "toxic")
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "source").join(extra, "doc_id", "left")
    return rows.select("doc_id", D.merged(F.col("source"), F.col("extra")).alias("source"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS hash FROM documents GROUP BY coalesce(text, '') HAVING sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 10 = 0)""")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = docs.where("doc_id % 10 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return D.new_rows(docs, seen).select("doc_id", "hash")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, misses = D.cache_split(X.table(spark, sf_dir, "documents").select("doc_id"), X.table(spark, sf_dir, "labels"), "doc_id")
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@query("SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.last_wins(X.table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), "source", "doc_id")


@query(f"WITH {_OUTLINE}, {_NODES} SELECT doc_id, string_agg(node_id, ',' ORDER BY node_id) AS node_ids FROM nd GROUP BY doc_id")
def ref_doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.node_ids(_index(spark, sf_dir)[0]).select("doc_id", F.array_join("node_ids", ",").alias("node_ids"))


# ---- model stages, offline


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.f_md(spark, sf_dir).withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return docs.withColumn("format", T.orientation(4 - F.col("doc_id") % 4, F.lit(2)))


_WORDS = "regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""
WITH w AS (SELECT conv_id, turn, CAST('0x' || md5(word)[1:15] AS BIGINT) AS h FROM (SELECT conv_id, turn, unnest({_WORDS.format(t="lower(text)")}) AS word FROM conversations)),
v AS (SELECT conv_id, turn, h % 64 AS i, sum(CASE WHEN h >= 576460752303423488 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS n FROM v GROUP BY ALL),
f AS (SELECT c.conv_id, c.turn, g.i, coalesce(CASE WHEN n.n > 0 THEN v.x / n.n ELSE 0 END, 0) AS x FROM conversations c CROSS JOIN range(64) g(i) LEFT JOIN v ON v.conv_id = c.conv_id AND v.turn = c.turn AND v.i = g.i LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn)
SELECT conv_id, turn, list(CAST(x AS FLOAT) ORDER BY i) AS embedding FROM f GROUP BY ALL""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(X.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "embedding", Offline()).drop("text")


@query(f"WITH {X.MD_SQL} SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) + 1 AS n_chars FROM md")
def reformat_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reformatted(_stored(spark, sf_dir), Offline()).select("doc_id", F.length("text").cast(LONG).alias("n_chars"))


@query(f"""WITH {X.MD_SQL} SELECT doc_id, 'en' AS language, array_to_string({_WORDS.format(t="text")}[1:12], ' ') AS summary FROM md""")
def context_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.plans.ingest import contexts

    return contexts(_stored(spark, sf_dir), Offline()).select("doc_id", F.try_variant_get("context", "$.language", "string").alias("language"), F.try_variant_get("context", "$.summary", "string").alias("summary"))


@query(f"""WITH {X.MD_SQL} SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split(string_split(text, '--- end page 10')[1], chr(10)), lambda x: starts_with(x, '#')), chr(10)), '^\\s+|\\s+$', '', 'g') AS extracted_toc FROM md""")
def toc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.plans.ingest import extracted_tocs

    return extracted_tocs(_stored(spark, sf_dir), Offline()).select("doc_id", "extracted_toc")


@query(f"""
WITH {X.MD_SQL},
p AS (SELECT doc_id, pos // 6 + 1 AS n, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS body FROM md_k GROUP BY ALL),
t AS (SELECT doc_id, string_agg('Page ' || CAST(n AS VARCHAR) || ' : ' || CASE WHEN body = '' THEN 'Untitled' ELSE substr(string_split(body, chr(10))[1], 1, 60) END, chr(10) ORDER BY n) AS pages FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN regexp_replace(pages, '^\\s+|\\s+$', '', 'g') ELSE '' END AS pages FROM t""")
def landscape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.plans.ingest import landscape_pages as titles

    return titles(_stored(spark, sf_dir), Offline()).select("doc_id", "pages")


_PAGE_TITLES = """pt AS (SELECT doc_id, pos // 6 + 1 AS n, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS body FROM md_k GROUP BY ALL),
tt AS (SELECT doc_id, n, 'Page ' || CAST(n AS VARCHAR) || ' : ' || CASE WHEN body = '' THEN 'Untitled' ELSE substr(string_split(body, chr(10))[1], 1, 60) END AS title FROM pt)"""


@query(f"""WITH {_TOC}, t AS (SELECT doc_id, string_agg(entry, chr(10) ORDER BY line_no) AS toc FROM al GROUP BY doc_id)
SELECT md.doc_id, CASE WHEN md.doc_id % 4 < 2 THEN '# Contents (Page 1)' ELSE coalesce(toc, '') END AS created_toc FROM md LEFT JOIN t ON t.doc_id = md.doc_id""")
def toc_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.plans.ingest import created_tocs

    return created_tocs(_stored(spark, sf_dir).withColumn("is_reformatted", F.lit(True)), Offline()).select("doc_id", "created_toc")


@query(f"""WITH {_TOC}, {_PAGE_TITLES}, t AS (SELECT doc_id, string_agg(entry, chr(10) ORDER BY line_no) AS toc FROM al GROUP BY doc_id),
g AS (SELECT doc_id, '# Contents' || chr(10) || string_agg('- ' || regexp_replace(title, '\\s+$', ''), chr(10) ORDER BY n) AS grouped FROM tt GROUP BY doc_id)
SELECT md.doc_id, CASE WHEN md.doc_id % 4 < 2 THEN grouped ELSE coalesce(toc, '') END AS structure FROM md LEFT JOIN t ON t.doc_id = md.doc_id LEFT JOIN g ON g.doc_id = md.doc_id""")
def structure_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.plans.ingest import created_tocs, structures
    from quirefold.plans.ingest import landscape_pages as titles

    docs = created_tocs(_stored(spark, sf_dir).withColumn("is_reformatted", F.lit(True)), Offline()).withColumn("extracted_toc", F.lit(""))
    return structures(titles(docs, Offline()), Offline()).select("doc_id", F.regexp_replace("structure", "[ \\t]+(?=\n|$)", "").alias("structure"))


_STRIP = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
_INGESTED = f"""{X.MD_SQL},
kept AS (SELECT min(doc_id) AS doc_id, {_STRIP.format(t="text")} || chr(10) AS text FROM md GROUP BY text)"""


@query(f"""WITH {_INGESTED},
{_TOC[len(X.MD_SQL) + 2 :].replace("FROM md)", "FROM kept)")},
t AS (SELECT doc_id, string_agg(entry, chr(10) ORDER BY line_no) AS toc FROM al GROUP BY doc_id),
u AS (SELECT doc_id, unnest(string_split_regex(text, '--- end page [0-9]+')) AS body, unnest(range(len(string_split_regex(text, '--- end page [0-9]+')))) AS k, unnest(list_concat(regexp_extract_all(text, '--- end page ([0-9]+)', 1), [''])) AS n FROM kept),
v AS (SELECT doc_id, k, n, {_STRIP.format(t="body")} AS body FROM u WHERE n <> ''),
g AS (SELECT doc_id, '# Contents' || chr(10) || string_agg('- Page ' || n || ' : ' || CASE WHEN body = '' THEN 'Untitled' ELSE regexp_replace(substr(string_split(body, chr(10))[1], 1, 60), '\\s+$', '') END, chr(10) ORDER BY k) AS grouped FROM v GROUP BY doc_id),
x AS (SELECT doc_id, {_STRIP.format(t="array_to_string(list_filter(string_split(string_split(text, '--- end page 10')[1], chr(10)), lambda l: starts_with(l, '#')), chr(10))")} AS extracted FROM kept)
SELECT kept.doc_id, extracted AS extracted_toc, CASE WHEN kept.doc_id % 4 < 2 THEN grouped ELSE coalesce(toc, '') END AS structure, CAST(length(text) AS BIGINT) AS n_chars
FROM kept LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN x USING (doc_id)""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All model stages over all documents into a fresh store, the first of equal contents only; a second run finds nothing new."""
    from quirefold.plans.ingest import ingest

    storage = Scratch(spark).root
    ingest(_stored(spark, sf_dir), storage, Offline())
    found = ingest(_stored(spark, sf_dir), storage, Offline())
    return found.select("doc_id", "extracted_toc", F.regexp_replace("structure", "[ \\t]+(?=\n|$)", "").alias("structure"), F.length("text").cast(LONG).alias("n_chars"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN array_to_string({_WORDS.format(t="text")}[1:40], ' ') END AS said FROM conversations""")
def generate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model call for each turn but every fourth, which has no prompt."""
    turns = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.concat(F.lit("Say it again.\n\n"), "text")).alias("prompt"))
    return generated(turns, "prompt", "said", Offline()).select("conv_id", "turn", "said")


@query("SELECT 'doc_' || CAST(label AS VARCHAR) AS tool_name, 'chunk ' || CAST(min(vec_id) AS VARCHAR) AS description, 64 AS dim FROM embeddings GROUP BY label")
def tool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _router(spark, sf_dir).tools.select("tool_name", "description", F.size("embedding").alias("dim"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_chunks(_stored(spark, sf_dir), Offline(), 256)


@query(f"""
WITH {X.MD_SQL}, t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM md_k GROUP BY doc_id)
SELECT doc_id, array_to_string({_WORDS.format(t="body")}[1:40], ' ') AS summary FROM t WHERE regexp_matches(body, '\\S')""")
def summary_tree_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = P.chunk_sentences(P.split_pages(_stored(spark, sf_dir)), 256)
    ordered = cut.withColumn("chunk_ord", F.col("page_number") * 100_000 + F.col("chunk_ord"))
    return summaries(ordered, Offline())


@query(f"""WITH RECURSIVE {_CHUNKS},
c AS (SELECT doc_id, count(*) AS n_chunks FROM (SELECT DISTINCT doc_id, page_number, c FROM p) GROUP BY doc_id),
d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM md_k GROUP BY doc_id)
SELECT doc_id, n_chunks, array_to_string({_WORDS.format(t="body")}[1:40], ' ') AS summary FROM c JOIN d USING (doc_id)""")
def index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and summaries of all documents, those of even ids from the tables that a first run has stored."""
    docs, storage = _stored(spark, sf_dir), Scratch(spark).root
    stored_index(docs.where("doc_id % 2 = 0"), storage, Offline(), 64)
    chunks, tools = stored_index(docs, storage, Offline(), 64)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).join(tools.select(F.col("doc_key").alias("doc_id"), F.col("description").alias("summary")), "doc_id")


def _router(spark: SparkSession, sf_dir: str) -> Router:
    chunks = X.f_chunks(spark, sf_dir)
    told = chunks.groupBy("doc_id").agg(F.min_by("text", "chunk_ord").alias("summary"))
    return Router(chunks, document_tools(told, Offline()), Offline(), chunks_top_k=3, nodes_top_k=3)


_ASKED = "SELECT conv_id, text FROM conversations WHERE turn = 0"


@query(f"SELECT conv_id AS call_id, conv_id % 10 AS doc_id, CASE WHEN contains(lower(text), 'summar') THEN 'summary_tool' ELSE 'vector_tool' END AS tool, true AS answered FROM ({_ASKED}) WHERE conv_id % 10 IN (SELECT label FROM embeddings)")
def agent_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent of a document answers each conversation's first turn with one of its two tools."""
    asked = _first_turns(spark, sf_dir).select(F.col("query_id").alias("call_id"), (F.col("query_id") % 10).alias("doc_id"), "query")
    router = _router(spark, sf_dir)
    calls = asked.join(router.tools.select(F.col("doc_key").alias("doc_id")), "doc_id", "left_semi").select("call_id", "doc_id", "query")
    found = router.ask_documents(calls)
    return found.select("call_id", "doc_id", F.array_join("trace", ",").alias("tool"), (F.length("response") > 0).alias("answered"))


@query(f"""WITH q AS (SELECT conv_id, {_WORDS.format(t="text")} AS w, {_WORDS.format(t="string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1]")} AS sub FROM ({_ASKED}))
SELECT conv_id AS call_id, 3 AS n_sub, array_to_string((w || ['doc_' || CAST(conv_id % 8 AS VARCHAR)] || sub || ['vector_tool'])[1:40], ' ') AS begins FROM q WHERE (SELECT count(DISTINCT label) FROM embeddings) = 10""")
def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's first turn broken down for three documents, answered in each, and put together: what the answer says up to
    the first document's tool."""
    names = F.array(*(F.concat(F.lit("doc_"), (F.col("query_id") % 8 + k).cast("string")) for k in range(3)))
    calls = _first_turns(spark, sf_dir).select(F.col("query_id").alias("call_id"), "query", names.alias("members"))
    found = _router(spark, sf_dir).compare(calls)
    return found.select("call_id", F.col("n_sub").cast("int").alias("n_sub"), F.regexp_replace("response", "(?<=vector_tool) .*", "").alias("begins"))


def _first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of every conversation as a question."""
    return X.table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query")).dropDuplicates(["query_id"])


@query()
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = Scratch(spark).write(_chunks(spark, sf_dir), "chunks")
    told = chunks.groupBy("doc_id").agg(F.min_by("text", F.struct("page_number", "chunk_ord")).alias("summary"))
    router = Router(chunks, document_tools(told, Offline()), Offline())
    return router.answer(_first_turns(spark, sf_dir))
