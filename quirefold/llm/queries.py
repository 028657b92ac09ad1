"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import licenses, quality, toxicity
from quirefold.llm.bpe import encode_documents
from quirefold.llm.common import table
from quirefold.llm.counts import count_tokens
from quirefold.llm.divergence import divergence
from quirefold.llm.licenses import license_scan
from quirefold.llm.linedup import LEAST_CHARS, duplicate_lines
from quirefold.llm.mixing import mix
from quirefold.llm.neardup import Sketching, near_duplicates
from quirefold.llm.repair import damage, reports
from quirefold.llm.repetition import repetition
from quirefold.llm.setjoin import Joining, jaccard_components
from quirefold.llm.topk import top_k, whole_numbers


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is: the folder named by QUIREFOLD_TOKENIZERS, or the public_tokenizers package."""
    if folder := os.environ.get("QUIREFOLD_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Sketching(shingle=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat")


def repetition_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3_repetition SQL can express: the counts and the base rule."""
    return repetition(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


REPETITION_BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
g AS (SELECT doc_id, i, word, lead(word) OVER n AS second, lead(word, 2) OVER n AS third FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, second, third) > 1),
m AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
c AS (SELECT doc_id, sum(length(word)) AS n FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(m.n, 0) > 50 * len(ws) AS base_failed
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op4_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_deletion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.xxhash64(text).alias("t"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    found = rows.join(duplicate_lines(docs), ["o", "t"], "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


OP6_SQL = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(len(a))) AS no, unnest(a) AS line FROM a),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS p FROM l WHERE length(line) >= {LEAST_CHARS}),
f AS MATERIALIZED (SELECT line, min(p) AS p FROM k GROUP BY line),
v AS MATERIALIZED (SELECT line, p, i, substr(line, 1, i) || substr(line, i + 2) AS less FROM (SELECT line, p, unnest(range(length(line))) AS i FROM f)),
near AS (SELECT a.line FROM v a JOIN v b ON a.less = b.less AND a.i = b.i WHERE b.p < a.p
  UNION SELECT v.line FROM v JOIN f ON f.line = v.less WHERE f.p < v.p UNION SELECT f.line FROM v JOIN f ON f.line = v.less WHERE v.p < f.p),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS nos FROM k JOIN f USING (line) WHERE k.p > f.p OR line IN (SELECT line FROM near) GROUP BY doc_id)
SELECT a.doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(nos, '') AS dropped_lines FROM a LEFT JOIN g ON g.doc_id = a.doc_id
"""


#: Target weights of the mix: languages by name, domains by number; sources share alike.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 2, "d2": 3}, "language": {"en": 5, "de": 3, "fr": 2, "es": 2}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 70, 3, 11


def domain_of_source() -> F.Column:
    """Five domains, by the number at the end of the source's name."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,6})$", 1), F.lit("")), F.lit("999999")), F.lit(0)).cast("long") % 5).cast("string"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_PERCENT, MIX_WEIGHTS, domain_of_source(), MIX_EPOCHS, MIX_SEED)


def _levels_sql() -> str:
    """The budgets level by level, as SQL: w0, w1 and w2 hold each node's share."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in sorted(MIX_WEIGHTS.get(level, {}).items())) + " ELSE 1 END" if MIX_WEIGHTS.get(level) else "1"
    out, path = [], []
    for k, level in enumerate(("domain", "language", "source")):
        at = ", ".join([*path, level])
        up = "CROSS JOIN root" if not path else f"JOIN w{k - 1} USING ({', '.join(path)})"
        by = f"PARTITION BY {', '.join(path)}" if path else ""
        order = f"held // greatest(w, 1), held % greatest(w, 1) * 4611686018427387904 // greatest(w, 1), {at}"
        out.append(f"""n{k} AS (SELECT {at}, CAST(sum(held) AS HUGEINT) AS held, CAST({weight(level)} AS HUGEINT) AS w FROM leaves GROUP BY {at}),
m{k} AS (SELECT n{k}.*, CAST(budget AS HUGEINT) AS budget,
  coalesce(sum(held) OVER ({by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
  sum(w) OVER ({by} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM n{k} {up}),
f{k} AS (SELECT *, held * opened <= (budget - given) * w AS filled FROM m{k}),
w{k} AS (SELECT {at}, CASE WHEN filled THEN held ELSE (budget - sum(CASE WHEN filled THEN held ELSE 0 END) OVER ({by})) * w // sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}) END AS budget FROM f{k})""")
        path.append(level)
    return ",\n".join(out)


def _no_weight_sql() -> str:
    return " OR ".join([f"{level} = '{n}'" for level, by in MIX_WEIGHTS.items() for n, w in sorted(by.items()) if not w] or ["false"])


OP7_SQL = f"""
WITH d AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1), '') AS BIGINT), 0) % 5 AS VARCHAR) AS domain,
  coalesce(lang, '') AS language, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CASE WHEN {_no_weight_sql()} THEN 0 ELSE CAST(sum(n_tokens) AS HUGEINT) * {MIX_EPOCHS} END AS held, {_no_weight_sql()} AS left_out FROM d GROUP BY domain, language, source),
root AS (SELECT least(sum(held), sum(tokens) * {MIX_PERCENT} // 100) AS budget FROM leaves),
{_levels_sql()},
t AS (SELECT l.*, w2.budget AS share, CASE WHEN left_out THEN 0 WHEN tokens = 0 THEN {MIX_EPOCHS} ELSE w2.budget // tokens END AS turns FROM leaves l JOIN w2 USING (domain, language, source)),
o AS (SELECT d.*, t.tokens, share, turns, md5(concat('{MIX_SEED}/', CAST(turns AS VARCHAR), '/', coalesce(CAST(doc_id AS VARCHAR), ''))) AS o FROM d JOIN t USING (domain, language, source)),
b AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT doc_id, domain, language, source, n_tokens, CAST(turns + CASE WHEN tokens > 0 AND share % tokens > 0 AND run <= share % tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM b
"""


def op8_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("e"))
    sound = rows.where("id is not null and e is not null and size(e) > 0").where(~F.exists("e", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))
    vectors = sound.select("id", whole_numbers("e").alias("v"))
    return top_k(vectors, vectors.where("id % 100 = 0"), 10)


OP8_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0),
s AS (SELECT q.id AS query_id, d.id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM (SELECT id, min(e) AS e FROM v WHERE id % 100 = 0 GROUP BY id) q JOIN v d ON q.id <> d.id AND len(q.e) = len(d.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def license_path() -> F.Column:
    """The tables have no paths; files are laid out by source, language and hundred."""
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), license_path())


def _licenses_sql(documents: str) -> str:
    """The scan as SQL: the same weights, windows over one line and over the next two, SPDX headers and inheritance. It holds no whole licence
    texts (no text of the tables comes near one)."""
    every = licenses.TEMPLATES + licenses.SPDX
    return f"""
WITH d AS ({documents}),
x AS (SELECT row_number() OVER () AS r, doc_id AS id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || CAST(CAST(floor(doc_id / 100.0) AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, coalesce(text, '') AS text FROM d),
tt AS MATERIALIZED (SELECT template, license, said, len(said) AS n, term, count(*) AS tf FROM (SELECT template, license, regexp_extract_all(lower(t), '{licenses.TERM}') AS said, unnest(regexp_extract_all(lower(t), '{licenses.TERM}')) AS term
  FROM (VALUES {", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(every))}) v(template, license, t)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT r, unnest(list_distinct(regexp_extract_all(lower(text), '{licenses.TERM}'))) AS term FROM x) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS MATERIALIZED (SELECT t.term, 1 - ln(greatest(coalesce(df, 0) / CAST((SELECT count(*) FROM x) AS DOUBLE), {licenses.LEAST_SHARE})) AS idf FROM (SELECT DISTINCT term FROM tt) t LEFT JOIN df USING (term)),
tw AS (SELECT template, license, n, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS t_norm FROM tt JOIN idf USING (term)),
v AS (SELECT list(term) AS words FROM idf),
ln AS (SELECT DISTINCT n FROM tt),
a AS (SELECT id, path, len(regexp_extract_all(lower(text), '{licenses.TERM}')) AS n_words, string_split(text, chr(10)) AS a FROM x WHERE regexp_matches(lower(text), '{licenses.ANCHORS}')),
l0 AS (SELECT id, path, n_words, a, unnest(range(len(a))) AS line FROM a),
l1 AS (SELECT id, path, n_words, line, a[line + 1] AS said, array_to_string(a[line + 2 : line + 3], chr(10)) AS after FROM l0),
l AS MATERIALIZED (SELECT id, path, n_words, line, regexp_matches(lower(said), '{licenses.ANCHORS}') AS holds, regexp_extract_all(lower(said), '{licenses.TERM}') AS ws, regexp_extract_all(lower(after), '{licenses.TERM}')[1 : (SELECT max(n) FROM ln) - 1] AS more
  FROM l1 WHERE regexp_matches(lower(said), '{licenses.ANCHORS}') OR regexp_matches(lower(after), '{licenses.ANCHORS}')),
w0 AS (SELECT id, path, n_words, line, false AS runs, n, unnest(list_transform(range(0, greatest(len(ws) - n, 0) + 1), lambda i: ws[i + 1 : i + n])) AS win FROM l, ln WHERE holds
  UNION ALL SELECT id, path, n_words, line, true, n, unnest(list_transform(range(greatest(len(ws) - n + 1, 0), least(len(ws) - 1, len(ws) + len(more) - n) + 1), lambda i: list_concat(ws, more)[i + 1 : i + n])) FROM l, ln),
w1 AS MATERIALIZED (SELECT row_number() OVER () AS k, w0.*, len(list_filter(win, lambda t: list_contains(words, t))) AS known, len(win) AS n_said FROM w0, v WHERE len(win) > 0),
w AS (SELECT * FROM w1 WHERE CASE WHEN runs THEN known = n_said ELSE 10 * known >= 3 * n_said END),
c AS (SELECT k, id, path, n_words, line, runs, n, n_said, term, count(*) AS tf FROM (SELECT *, unnest(win) AS term FROM w) GROUP BY ALL),
pw AS (SELECT c.*, tf * coalesce(idf, 1 - ln({licenses.LEAST_SHARE})) AS pw, sqrt(sum(tf * coalesce(idf, 1 - ln({licenses.LEAST_SHARE})) * tf * coalesce(idf, 1 - ln({licenses.LEAST_SHARE}))) OVER (PARTITION BY k)) AS p_norm FROM c LEFT JOIN idf USING (term)),
s AS (SELECT id, path, n_words, line, runs, n_said, template, license, round(sum(pw * w) / (t_norm * p_norm), 6) AS score FROM pw JOIN tw USING (n, term) GROUP BY k, id, path, n_words, line, runs, n_said, template, license, t_norm, p_norm),
m AS (SELECT * FROM s WHERE score >= CASE WHEN template >= {len(licenses.TEMPLATES)} THEN {licenses.SPDX_COSINE} ELSE {licenses.LEAST_COSINE} END AND (NOT runs OR score >= {licenses.RUN_COSINE})),
bl AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, path, line ORDER BY score DESC, runs, template, n_said) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY score DESC, runs, line, template) AS j, coalesce(sum(n_said) FILTER (NOT runs) OVER (PARTITION BY id, path), sum(n_said) FILTER (runs) OVER (PARTITION BY id, path)) AS said FROM bl),
own AS (SELECT id, path, license AS own_license, score AS own_score, CAST(line AS BIGINT) AS own_line, 100 * said >= {licenses.FILE_PERCENT} * n_words OR regexp_matches(lower(path), '{licenses.FILE_NAMES}') AS is_file FROM o WHERE j = 1),
g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, own_license AS license FROM own WHERE is_file QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY own_score DESC, path) = 1),
dd AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM x),
ab AS (SELECT dir, above, license FROM dd JOIN g ON dir = above OR starts_with(dir, above || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT x.id AS doc_id, x.path, own_license, own_score, own_line, coalesce(own_license, ab.license) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN ab.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS scope,
  CASE WHEN own_license IS NULL AND ab.license IS NOT NULL THEN ab.above END AS inherited_from
FROM x LEFT JOIN own ON own.id = x.id AND own.path = x.path LEFT JOIN ab ON ab.dir = regexp_extract(x.path, '^(.*)/[^/]*$', 1)
"""


OP10_SQL = _licenses_sql("SELECT doc_id, lang, source, text FROM documents")

#: Lines added to documents by their id modulo eleven, so that scores differ from 1 and windows run over lines.
PLANTED = {
    1: "Copyright 2020. This is licensed under the Apache License, Release 2.0",
    2: "Released under the terms of the MIT License, as is",
    3: "x = 1 # licensed under the GNU General Public License,\n# version 3 and no other license",
    4: "# SPDX-License-Identifier: MIT",
    5: "You may use this file in compliance with the Apache License",
    6: "this is licensed under the\nBSD 3-Clause License",
    7: "subject to all terms of the Mozilla Public License, v. 1.1",
    8: "dedicated to the public domain by CC0 4.0",
    9: "released under an ISC License; all rights are reserved",
    10: "licensed under GNU Lesser General Public License, version 2",
}


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's scan over documents that got lines which match templates in part, over line ends, or by an identifier."""
    docs = table(spark, sf_dir, "documents")
    line = F.element_at(F.create_map(*(F.lit(x) for k, said in PLANTED.items() for x in (k, said))), (F.col("doc_id") % 11).cast("int"))
    return license_scan(docs.withColumn("text", F.concat_ws("\n", "text", line)), license_path())


LICENSE_WINDOWS_SQL = _licenses_sql("SELECT doc_id, lang, source, concat_ws(chr(10), text, CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN replace('{said}', '~', chr(10))".replace("\n", "~") for k, said in PLANTED.items()) + " END) AS text FROM documents")


def op11_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Joining(shingle=3, percent=90))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_all FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, n_all, coalesce((SELECT sum(n) FROM t WHERE t.lang = g.lang AND t.source = g.source), 0) AS n_group FROM g LEFT JOIN v ON v.lang = g.lang),
s AS MATERIALIZED (SELECT gn.lang, gn.source, k.term, coalesce(t.n, 0) AS n, 1 + 1000000000 * (coalesce(t.n, 0) + 5) // (n_group + 5 * v) AS p, 1 + 1000000000 * (total + 5) // (n_all + 5 * v) AS q
  FROM gn JOIN k ON k.lang = gn.lang LEFT JOIN t ON t.lang = gn.lang AND t.source = gn.source AND t.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damage(table(spark, sf_dir, "conversations")))


QUERIES = {"license_windows": license_windows, "op11_set_relations": op11_set_relations, "op12_divergence": op12_divergence, "op13_repair": op13_repair, "op10_license_scan": op10_license_scan, "op6_deletion_join": op6_deletion_join, "op2_trie_counts": op2_trie_counts, "op7_mixture": op7_mixture, "op8_cover_trees": op8_cover_trees, "op1_setsketch": op1_setsketch, "op4_line_field": op4_line_field, "op9_toxic_segments": op9_toxic_segments, "op3_repetition": op3_repetition, "repetition_base": repetition_base, "op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {"license_windows": LICENSE_WINDOWS_SQL, "op12_divergence": OP12_SQL, "repetition_base": REPETITION_BASE_SQL, "op10_license_scan": OP10_SQL, "op6_deletion_join": OP6_SQL, "op7_mixture": OP7_SQL, "op8_cover_trees": OP8_SQL}
