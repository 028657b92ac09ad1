"""Outlines of documents: headings by level, pages below them, rendered trees."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import split_lines, stem, strip, tree_line
from quirefold.operators.checks import none_of
from quirefold.operators.streams import scanned

#: Patterns of an outline's lines.
SECTION = "^(#+)\\s+(.+)$"
PAGE = "^-\\s*Page\\s+(\\d+)\\s*:\\s*(.+)$"
LINED = "^(#+)\\s+(.*?)\\s+\\[line\\s+(\\d+)\\]"


ROWS = "ord long, number long, name string, kind string, level long, parent_number long"
MARKS = "array<struct<level:bigint,number:bigint,name:string>>"


class _Open:
    """The open headings (level, number): a heading leaves open those of a smaller level. One of a level costs what it closes, so a
    document costs its headings, however long it is."""

    def __init__(self) -> None:
        self.path: list[tuple[int, int]] = []

    def open(self, level: int, number: int | None) -> int | None:
        """The parent of a heading, which is open from now on."""
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        parent = self.path[-1][1] if self.path else -1
        self.path.append((level, number))
        return parent


class _Landscape:
    """Marks of one deck after the other: headings (level), pages (number), and an end (neither)."""

    def __call__(self, pos: int, level: int | None, number: int | None, name: str | None, title: str | None, nb_pages: int | None) -> Iterator[tuple]:
        if pos == 0:
            self.headings, self.heads, self.seen, self.ord = _Open(), 0, set(), 0
            yield 0, -1, title, "root", 0, None
        if level is not None:
            self.heads += 1
            self.ord += 1
            yield self.ord, -1 - self.heads, name, "abstract", level, self.headings.open(level, -1 - self.heads)
        elif number is not None:
            if number not in self.seen:
                self.seen.add(number)
                self.ord += 1
                yield self.ord, number, name, "page", 0, -1 - self.heads
        elif left := [n for n in range(1, (nb_pages or 0) + 1) if n not in self.seen]:
            yield self.ord + 1, -2 - self.heads, "Uncategorized", "abstract", 1, -1
            for k, n in enumerate(left):
                yield self.ord + 2 + k, n, f"Page number {n}", "page", 0, -2 - self.heads


class _Portrait:
    def __call__(self, pos: int, level: int | None, number: int | None, name: str | None, title: str | None) -> Iterator[tuple]:
        if pos == 0:
            self.headings = _Open()
            yield 0, -1, title, "root", 0, None
        if level is not None:
            yield pos + 1, number, name, "section", level, self.headings.open(level, number)


def _marks(docs: DataFrame, key: str, marks: Column, more: list[str]) -> DataFrame:
    """A row for each mark of each document, in order, and one that ends it."""
    end = F.array(F.struct(F.lit(None).cast("long").alias("level"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("name")))
    none = F.array().cast(MARKS)
    every = docs.select(key, stem(F.col("filename")).alias("__title"), *more, F.posexplode(F.concat(F.coalesce(marks, none), end.cast(MARKS))).alias("__pos", "__m"))
    return every.select(key, F.col("__pos").cast("long").alias("__pos"), "__m.level", "__m.number", "__m.name", "__title", *more)


def landscape_outline(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, number, name, kind, level, parent_number) of docs (key, nb_pages, filename, structure).

    The root is -1; headings are -2, -3, ...; pages keep their number, the first time they are named, if within nb_pages; pages
    left out come last below an abstract node of their own, in order. ord is the order of a walk from the root. An outline is
    scanned where its document lies: no shuffle, one plan whatever the levels, time linear in its lines and memory that of the
    open headings and of the pages seen.
    """
    lines = F.transform(split_lines(F.col("structure")), strip)

    def parsed(line: Column) -> Column:
        level = F.nullif(F.length(F.regexp_extract(line, SECTION, 1)), F.lit(0)).cast("long")
        page = F.regexp_extract(line, PAGE, 1).try_cast("long")
        return F.struct(level.alias("level"), page.alias("number"), F.when(level.isNotNull(), F.regexp_extract(line, SECTION, 2)).otherwise(F.regexp_extract(line, PAGE, 2)).alias("name"))

    marks = F.filter(F.transform(lines, parsed), lambda m: m["level"].isNotNull() | (m["number"] <= F.col("nb_pages")))
    rows = _marks(docs.withColumn("nb_pages", F.col("nb_pages").cast("long")), key, marks, ["nb_pages"])
    return scanned(rows, [key], ["__pos", "level", "number", "name", "__title", "nb_pages"], _Landscape, ROWS)


def portrait_outline(docs: DataFrame, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """The same of docs (key, filename, structure) whose lines read `# title [line n]`; a node's number is its line, its kind
    section. strict: raise unless the lines begin at 0 and never fall."""
    if strict:
        none_of(portrait_violations(docs, key), "outline lines must begin at 0 and never fall")

    def parsed(line: Column) -> Column:
        return F.struct(F.length(F.regexp_extract(line, LINED, 1)).cast("long").alias("level"), F.regexp_extract(line, LINED, 3).try_cast("long").alias("number"), F.regexp_extract(line, LINED, 2).alias("name"))

    lines = F.filter(F.transform(split_lines(F.col("structure")), strip), lambda line: line.rlike(LINED))
    rows = _marks(docs, key, F.transform(lines, parsed), [])
    return scanned(rows, [key], ["__pos", "level", "number", "name", "__title"], _Portrait, ROWS)


def portrait_violations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with no matching line, a first line other than 0, or line numbers that fall."""
    lines = docs.select(key, F.posexplode_outer(split_lines(F.col("structure"))).alias("pos", "line")).withColumn("n", F.nullif(F.regexp_extract(strip(F.col("line")), LINED, 3), F.lit("")).cast("long"))
    ordered = lines.where("n is not null").withColumn("before", F.lag("n").over(Window.partitionBy(key).orderBy("pos")))
    wrong = ordered.where("(before is null and n <> 0) or before > n").select(key, F.lit("order").alias("problem")).distinct()
    empty = docs.select(key).join(ordered.select(key), key, "left_anti").select(key, F.lit("empty").alias("problem"))
    return wrong.unionByName(empty)


def outline(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dispatch by format; other formats raise."""
    none_of(docs.where("format is null or format not in ('landscape', 'portrait')").select(key, "format"), "unknown format")
    return landscape_outline(docs.where("format = 'landscape'"), key).unionByName(portrait_outline(docs.where("format = 'portrait'"), key))


class _Depths:
    """Rows of one document after the other, parents first: what is open is the path from the root, and a row's parent is on it."""

    def __call__(self, key: object, number: int | None, kind: str, parent: int | None) -> Iterator[tuple]:
        if parent is None or key != getattr(self, "key", self):
            self.key, self.path, self.at = key, [], {}
        depth = self.at[parent] + 1 if parent in self.at else 0
        while len(self.path) > depth:
            gone, _, _ = self.path.pop()
            if self.at.get(gone) == len(self.path):
                del self.at[gone]
        above, ordinal = None, None
        if depth:
            self.path[-1][2] += 1
            above, ordinal = self.path[-1][1], self.path[-1][2]
        self.at.setdefault(number, depth)
        self.path.append([number, kind, 0])
        yield depth, ordinal, above


class _Ends:
    """Rows of one document after the other, last ones first: the ord of the last row below each."""

    def __call__(self, key: object, ord_: int, depth: int) -> Iterator[tuple]:
        if key != getattr(self, "key", self):
            self.key, self.later = key, []
        last = ord_
        while self.later and self.later[-1][0] > depth:
            last = max(last, self.later.pop()[1])
        self.later.append((depth, last))
        yield (last,)


def with_depth(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outline rows with depth: the root is 0. One scan over the rows of a document in their order."""
    return _with_depth(nodes, key).drop("child_ord", "parent_kind")


def _with_depth(nodes: DataFrame, key: str) -> DataFrame:
    ordered = nodes.withColumn("__key", F.col(key)).repartition(key).sortWithinPartitions(key, "ord")
    return scanned(ordered, nodes.columns, ["__key", "number", "kind", "parent_number"], _Depths, "depth long, child_ord long, parent_kind string")


def numbered(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Outline rows with depth, last, child_ord (from 1 below a parent) and parent_kind. ord and last are the bounds of a node's subtree: the
    rows of its document whose ord lies between them, so what lies below is a range, and an ancestor is told by two comparisons.
    One shuffle; two scans, the second one backwards."""
    return ends(_with_depth(nodes, key), key, dealt=True)


def ends(rows: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """rows (key, ord, depth, ...) with last, the ord of the last row below each. dealt: a key's rows lie in one partition already."""
    back = rows.withColumn("__key", F.col(key))
    return scanned((back if dealt else back.repartition(key)).sortWithinPartitions(key, F.desc("ord")), rows.columns, ["__key", "ord", "depth"], _Ends, "last long")


def render(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tree): a line for each node, two blanks for each depth below the first, in order of a walk from the root."""
    lines = nodes.withColumn("shown", tree_line(F.col("depth"), F.col("name"), F.col("number")))
    return lines.groupBy(key).agg(F.expr("listagg(shown, '\n') WITHIN GROUP (ORDER BY ord)").alias("tree"))
