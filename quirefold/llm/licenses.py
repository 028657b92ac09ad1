"""License scans: sparse TF-IDF cosine of passages to templates, then inheritance from the nearest directory above.

DataFrame and SQL functions only. Each line of a whole text that holds an anchor is a passage; its windows of a template's length,
terms weighted by the share of files that hold them, are held against that template. So are windows that run on into the next
two lines, and SPDX identifiers. Whole files are held against whole licence texts. A file that is such a text, whose licence passages make up a good part of it, or that is
named like one, is a licence file; the files of its directory and of those below that declare nothing themselves inherit from
the nearest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Scratch, small

#: Licence names and the statements that declare them.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the Apache License"),
    ("BSD-2-Clause", "licensed under the Simplified BSD License"),
    ("BSD-3-Clause", "licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("ISC", "released under the ISC License"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "released under the MIT License"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "all rights reserved"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
]
#: A line without one of these is no passage.
ANCHORS = "licen[sc]e|copyright|spdx|rights reserved|public domain|free of charge|creative commons"
#: Names of licence files.
FILE_NAMES = "(^|/)(licen[sc]e|copying|notice|unlicense)([._-][^/]*)?$"
#: The same as plain words.
ANCHOR_WORDS = ("license", "licence", "copyright", "spdx", "rights reserved", "public domain", "free of charge", "creative commons")
TERM = "[a-z0-9]+([.-][a-z0-9]+)*"
#: The same matches without ways back: faster, and no deeper stack for a term of many parts.
TERM_ONWARD = "[a-z0-9]++(?:[.-][a-z0-9]++)*+"
#: Least cosine of a match, and least share of a file's words in passages (percent) for a licence file.
LEAST_COSINE, FILE_PERCENT = 0.6, 20
#: Least share of the files that a term counts with: terms that are rarer or in no template weigh alike in a table of any size.
LEAST_SHARE = 0.001
#: Identifiers of SPDX headers by licence; a header matches as a whole or not at all.
SPDX = [(name, f"spdx-license-identifier {name}") for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense")]
SPDX += [(name, f"spdx-license-identifier {name}{more}") for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0") for more in ("", "-only", "-or-later")]
#: Least cosine of SPDX headers, of windows over several lines, and of whole files to whole texts.
SPDX_COSINE, RUN_COSINE, TEXT_COSINE = 0.99, 0.9, 0.8


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_ONWARD), F.lit(0))


def anchored(lowered: Column) -> Column:
    return reduce(or_, (F.contains(lowered, F.lit(w)) for w in ANCHOR_WORDS))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row, also where lambdas of `then` ask for it again and again."""
    return F.transform(F.array(value), then)[0]


def template_terms(spark) -> DataFrame:
    """(template, license, n, term, tf), n being the template's terms: a few hundred rows, fixed by TEMPLATES and SPDX."""
    values = ", ".join(f"({k}, '{name}', '{said}')" for k, (name, said) in enumerate(TEMPLATES + SPDX))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, said)")
    return rows.select("template", "license", F.size(terms(F.col("said"))).alias("n"), F.explode(terms(F.col("said"))).alias("term")).groupBy("template", "license", "n", "term").agg(F.count("*").alias("tf"))


def license_texts() -> list[tuple[str, str]]:
    folder = resources.files("quirefold.llm") / "license_texts"
    return sorted((f.name.removesuffix(".txt"), f.read_text()) for f in folder.iterdir() if f.name.endswith(".txt"))


def whole_texts(files: DataFrame, scratch: Scratch) -> DataFrame:
    """id, path, license and score of the files (id, path, text, and said: which terms of licence texts that holds) that are a licence
    text as a whole: the best cosine over 1 + ln(count) of their terms, TEXT_COSINE at least. Nothing in it depends on other
    files. No cosine is above the root of the share of the licence's squared weights whose terms the file holds, so terms are
    counted only where that comes near TEXT_COSINE; rows of one file can only add to each other's shares."""
    texts = license_texts()
    weight = 1.0 + F.log(F.count("*"))
    said = F.explode(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts)))
    known = files.sparkSession.range(1).select(said.alias("t")).select("t.license", F.explode(terms(F.col("t.text"))).alias("term")).groupBy("license", "term").agg(weight.alias("w"))
    norms = known.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    known = known.join(norms, "license").select("license", "term", (F.col("w") / F.col("t_norm")).alias("w"))
    squares = known.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("license") == name, F.col("w") * F.col("w"))), F.lit(0.0)).alias(f"s{k}") for k, (name, _) in enumerate(texts)))
    shares = files.select("id", "path", F.explode("said").alias("term")).join(F.broadcast(squares), "term").groupBy("id", "path").agg(F.greatest(*(F.sum(f"s{k}") for k in range(len(texts)))).alias("share"))
    near = scratch.write(shares.where(F.col("share") >= (TEXT_COSINE - 1e-6) ** 2).select(F.col("id").alias("n_id"), F.col("path").alias("n_path")), "near")
    files = files.join(F.broadcast(near) if small(near, 200) else near, F.col("id").eqNullSafe(F.col("n_id")) & F.col("path").eqNullSafe(F.col("n_path")), "left_semi")
    counted = files.select("id", "path", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "path", "term").agg(weight.alias("pw"))
    held = counted.join(F.broadcast(known.groupBy("term").agg(F.collect_list(F.struct("license", "w")).alias("in"))), "term", "left")
    norm = held.groupBy("id", "path").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("p_norm"), *(F.sum(F.col("pw") * F.coalesce(F.try_element_at(F.filter("in", _named(name)), F.lit(1))["w"], F.lit(0.0))).alias(f"d{k}") for k, (name, _) in enumerate(texts)))
    best = F.array_max(F.array(*(F.struct(F.round(F.col(f"d{k}") / F.col("p_norm"), 6).alias("score"), F.lit(name).alias("license")) for k, (name, _) in enumerate(texts))))
    return norm.select("id", "path", best.alias("b")).select("id", "path", "b.license", "b.score").where(F.col("score") >= TEXT_COSINE)


def license_scan(files: DataFrame, path: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, path, own_license, own_score, own_line (from 0), license, scope (own, inherited or none) and inherited_from (a directory).

    Own: the best passage of at least LEAST_COSINE; of equal ones the first line, then the first template. A passage scores as its
    best window of as many terms as the template has, so what else the line holds takes nothing from it; a window may run on
    into the next two lines if it agrees by RUN_COSINE. A file that is a whole licence text takes that licence, with line 0. Idf is 1 - ln(share of
    the files with the term, LEAST_SHARE at least); terms in no template weigh as the rarest. Null texts have
    no passage, null paths neither inherit nor bequeath, an empty table gives an empty one. Rows that share a key share one
    result of all their passages. The vocabulary of the templates is fixed, so what is broadcast is.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("id"), path.alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = template_terms(spark)
    vocabulary = known.select("term").distinct()
    words = sorted({t for _, said in TEMPLATES + SPDX for t in _plain_terms(said)})
    scratch = Scratch(spark)
    # one pass over the texts: the templates' terms that each file holds, and the text and terms of licence texts of those that hold an anchor
    in_texts = F.split(F.lit(" ".join(sorted({t for _, whole in license_texts() for t in _plain_terms(whole)}))), " ")
    of_anchored = lambda c: F.when(anchored(F.lower("text")), c)
    of_file = lambda said: F.struct(F.size(said).alias("n_words"), F.array_intersect(said, F.array(*map(F.lit, words))).alias("holds"), of_anchored(F.struct("text", F.array_intersect(said, in_texts).alias("said"))).alias("anchored"))
    stored = scratch.write(rows.select("id", "path", _once(terms(F.col("text")), of_file).alias("f")), "files")
    seen = stored.select("id", "path", "f.n_words", "f.holds", "f.anchored.*")
    df = seen.select(F.explode("holds").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n_files = float(seen.count())
    share = F.greatest(F.coalesce("df", F.lit(0)) / max(n_files, 1.0), F.lit(LEAST_SHARE))
    idf = vocabulary.join(df, "term", "left").select("term", (1.0 - F.log(share)).alias("idf"))
    weighted = known.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    templates = scratch.write(weighted.join(norms, "template").select("template", "license", "n", "term", "idf", "w", "t_norm"), "templates", 100 * len(words))
    idf = templates.select("term", "idf").distinct()

    lengths = sorted({len(_plain_terms(said)) for _, said in TEMPLATES + SPDX})
    nothing, wide = F.array().cast("array<string>"), lengths[-1] - 1
    is_known = lambda t: F.array_contains(F.array(*map(F.lit, words)), t)
    last_known = lambda ts: F.aggregate(ts, nothing, lambda found, t: F.when(is_known(t), F.concat(found, F.array(t))).otherwise(nothing))

    def near(every: Column, held: Column) -> Column:
        """The lines that hold an anchor, or stand within two lines before one (no anchor runs over a line's end): told, and cut into terms,
        before they become rows. A window over a line's end has known terms only, so it lies in those that stand there without a gap."""
        numbers = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.array_contains(F.slice(held, i + 1, 3), F.lit(True)))
        end = lambda ws: last_known(F.slice(ws, F.greatest(F.size(ws) - wide + 1, F.lit(1)), wide))
        start = lambda i: F.reverse(last_known(F.reverse(F.slice(terms(F.array_join(F.slice(every, i + 2, 2), "\n")), 1, wide))))
        line = lambda i, ws, before: F.struct(i.alias("line"), F.when(held[i], ws).alias("ws"), before.alias("before"), F.when(F.size(before) > 0, start(i)).otherwise(nothing).alias("behind"))
        every_line = F.transform(numbers, lambda i: _once(terms(every[i]), lambda ws: _once(end(ws), lambda before: line(i, ws, before))))
        return F.filter(every_line, lambda x: x["ws"].isNotNull() | (F.size(x["behind"]) > 0))

    held = F.transform(F.split(F.lower("text"), "\n"), anchored)
    of_text = _once(F.split("text", "\n"), lambda every: _once(held, lambda held: near(every, held)))
    lines = seen.where("text is not null").select("id", "path", "n_words", F.explode(of_text).alias("l")).select("id", "path", "n_words", "l.line", "l.ws", F.size("l.before").alias("n_before"), F.when(F.size("l.behind") > 0, F.concat("l.before", "l.behind")).alias("around"))
    said_key = F.when(F.col("ws").isNotNull(), F.md5(F.array_join("ws", " ")))
    run_key = F.when(F.col("around").isNotNull(), F.md5(F.concat_ws(" ", F.col("n_before").cast("string"), "around")))
    lines = scratch.write(lines.select("*", said_key.alias("said_key"), run_key.alias("run_key")), "lines")
    place = ["id", "path", "n_words", "line"]
    none = F.array().cast("array<struct<n:int,at:int,ws:array<string>>>")

    def cut(of: Column, first, last, keep=None) -> Column:
        """The windows of all templates' lengths n over `of`, from first(n) to last(n), or those of them that are to be kept."""

        def of_length(n: Column) -> Column:
            every = F.transform(F.sequence(first(n), last(n)), lambda i: F.struct(n.alias("n"), i.alias("at"), F.slice(of, i + 1, n).alias("ws")))
            return F.when(first(n) <= last(n), F.filter(every, keep) if keep else every).otherwise(none)

        return F.flatten(F.transform(F.array(*map(F.lit, lengths)), of_length))

    def windows(rows: DataFrame, of: Column, *by: str) -> DataFrame:
        return rows.select(*by, F.explode(of).alias("w")).select(*by, F.md5(F.concat_ws(" ", F.col("w.n").cast("string"), "w.ws")).alias("key"), "w.n", "w.ws")

    own_size, n_before = F.size("ws"), F.col("n_before")
    # a line, or the terms around a line's end, that many files hold is scored once
    distinct = lines.where("said_key is not null").groupBy("said_key").agg(F.first("ws").alias("ws")).withColumn("known", F.transform("ws", lambda t: is_known(t).cast("int")))
    ends = lines.where("run_key is not null").groupBy("run_key").agg(F.first("n_before").alias("n_before"), F.first("around").alias("around"))
    # unknown terms weigh as much as any: a window of which less than three tenths are known can't come near LEAST_COSINE
    enough = lambda w: 10 * F.aggregate(F.slice("known", w["at"] + 1, w["n"]), F.lit(0), lambda a, x: a + x) >= 3 * F.size(w["ws"])
    single = cut(F.col("ws"), lambda n: F.lit(0), lambda n: F.greatest(own_size - n, F.lit(0)), enough)
    single = scratch.write(windows(distinct, single, "said_key"), "windows")
    across = cut(F.col("around"), lambda n: F.greatest(n_before - n + 1, F.lit(0)), lambda n: F.least(n_before - 1, F.size("around") - n))
    runs = scratch.write(windows(ends, across, "run_key"), "windows")

    every = single.select("key", "n", "ws").unionByName(runs.select("key", "n", "ws")).dropDuplicates(["key"])
    counted = every.select("key", "n", F.size("ws").alias("n_said"), F.explode("ws").alias("term")).groupBy("key", "n", "n_said", "term").agg(F.count("*").alias("tf"))
    rare = 1.0 - math.log(LEAST_SHARE)
    weights = counted.join(F.broadcast(idf.select("term", "idf")), "term", "left").withColumn("pw", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    held = weights.groupBy("key", "n", "n_said").agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("p_norm"), F.collect_list(F.struct("term", "pw")).alias("ts"))
    each = held.select("key", "n", "n_said", "p_norm", F.explode("ts").alias("t")).select("key", "n", "n_said", "p_norm", F.col("t.term").alias("term"), F.col("t.pw").alias("pw"))
    dots = each.join(F.broadcast(templates.select("template", "license", "n", "term", "w", "t_norm")), ["n", "term"]).groupBy("key", "n_said", "p_norm", "template", "license", "t_norm").agg(F.sum(F.col("pw") * F.col("w")).alias("dot"))
    scored = dots.withColumn("score", F.round(F.col("dot") / (F.col("t_norm") * F.col("p_norm")), 6))
    scored = scratch.write(scored.where(F.col("score") >= F.when(F.col("template") >= len(TEMPLATES), SPDX_COSINE).otherwise(LEAST_COSINE)).select("key", "n_said", "template", "license", "score"), "scored")

    def found(rows: DataFrame, by: str, across: bool) -> DataFrame:
        met = rows.select(by, "key").join(scored, "key").where((F.col("score") >= RUN_COSINE) | F.lit(not across))
        best = met.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.lit(across).alias("runs"), "template", "license", "n_said")).alias("b"))
        best = scratch.write(best, "best")
        met_by.append(best)
        return lines.select(*place, by).join(F.broadcast(best) if small(best, 200) else best, by).select(*place, "b")

    met_by: list[DataFrame] = []
    best = found(single, "said_key", False).unionByName(found(runs, "run_key", True)).groupBy(*place).agg(F.min("b").alias("b"))
    # a window over several lines may lap over the next line's own: where lines match by themselves, only these make up a file
    single_said, run_said = (F.sum(F.when(F.col("b.runs") == r, F.col("b.n_said"))) for r in (False, True))
    own = best.groupBy("id", "path").agg(F.min(F.struct(F.col("b.s").alias("s"), F.col("b.runs").alias("runs"), "line", F.col("b.template").alias("template"), F.col("b.license").alias("license"))).alias("o"), F.max("n_words").alias("n_words"), F.coalesce(single_said, run_said).alias("n_said"))
    own = own.select("id", "path", F.col("o.license").alias("own_license"), (-F.col("o.s")).alias("own_score"), F.col("o.line").cast("long").alias("own_line"), ((100 * F.col("n_said") >= FILE_PERCENT * F.col("n_words")) | F.lower("path").rlike(FILE_NAMES)).alias("is_file"))
    whole = whole_texts(seen.where("text is not null"), scratch).select("id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.lit(0).cast("long").alias("own_line"), F.lit(True).alias("is_file"))
    both_ways = own.withColumn("k", F.lit(1)).unionByName(whole.withColumn("k", F.lit(0)))
    own = scratch.write(both_ways.groupBy("id", "path").agg(F.min_by(F.struct("own_license", "own_score", "own_line", "is_file"), "k").alias("o")).select("id", "path", "o.*"), "own", int(n_files), 200)
    scratch.drop(stored, templates, lines, single, runs, scored, *met_by)

    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    givers = own.where("is_file and path is not null").groupBy(directory.alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("license"))).alias("g")).select("above", F.col("g.license").alias("given"))
    below = rows.where("path is not null").select(directory.alias("dir")).distinct()
    steps = F.split("dir", "/")
    ancestors = below.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("above"))
    nearest = ancestors.join(givers, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("a")).select("dir", F.col("a.above").alias("above"), F.col("a.given").alias("given"))

    mine = own.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), "own_license", "own_score", "own_line")
    out = rows.select("id", "path", directory.alias("dir")).join(mine, F.col("id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")), "left").join(nearest, "dir", "left")
    scope = F.when(F.col("own_license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(key), "path", "own_license", "own_score", "own_line", F.coalesce("own_license", "given").alias("license"), scope.alias("scope"), F.when(scope == "inherited", F.col("above")).alias("inherited_from"))


def _named(name: str):
    return lambda x: x["license"] == name


def _plain_terms(said: str) -> list[str]:
    import re

    return [m[0] for m in re.finditer(TERM, said.lower())]
