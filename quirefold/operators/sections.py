"""Sections of Markdown: lines, fences, headings and the path of headings above."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.text import FENCE, HEADER, split_lines, strip
from quirefold.operators.streams import scanned


def doc_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no from 0, line, is_fence, in_fence): a fence opens or closes at each line that begins with one."""
    lines = docs.select(key, F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    lines = lines.withColumn("is_fence", F.ltrim(F.regexp_replace("line", "^\\s+", "")).startswith(FENCE))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("in_fence", F.sum(F.col("is_fence").cast("int")).over(so_far) % 2 == 1)


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_lines with is_header, level and header (its text)."""
    lines = doc_lines(docs, key)
    head = ~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(HEADER)
    return lines.withColumn("is_header", head).withColumn("level", F.when(head, F.length(F.regexp_extract("line", HEADER, 1)))).withColumn("header", F.when(head, F.regexp_extract("line", HEADER, 2)))


class _Sections:
    """Lines of one document after the other. Fences open and close; a heading outside of them begins a section, whose path is that of the
    open headings by depth: one of level n leaves open at most n - 1 of those that are."""

    def __call__(self, pos: int, line: str | None, fence: bool, level: int | None, header: str | None, shown: str | None) -> Iterator[tuple]:
        if pos == 0:
            self.fenced, self.open, self.ord = False, [], 0
            self.head, self.path, self.lines = (0, 0, ""), "/", []
        if line is None:  # the end
            yield self._closed()
            return
        if fence:
            self.fenced = not self.fenced
        if level is None or self.fenced or fence:
            self.lines.append(line)
            return
        if self.lines or self.ord:
            yield self._closed()
        del self.open[max(0, min(len(self.open), level - 1)) :]
        path = "/".join(self.open)
        self.ord, self.head, self.path, self.lines = self.ord + 1, (pos, level, header), f"/{path}/" if path else "/", [shown]
        self.open.append(header)

    def _closed(self) -> tuple:
        return self.ord, *self.head, self.path, "\n".join(self.lines)


def split_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_ord, line_number, level, header, header_path, text) of each section that isn't blank.

    The path holds the headings above by depth, not level. Lines are marked by built-in expressions and scanned where their document lies:
    no shuffle, time linear in the lines, memory that of one section and the open headings.
    """
    lines = F.transform(split_lines(F.col("text")), lambda x: F.struct(x.alias("line")))
    end = F.array(F.struct(F.lit(None).cast("string").alias("line")))
    rows = docs.select(key, F.posexplode(F.concat(lines, end)).alias("pos", "m")).select(key, F.col("pos").cast("long").alias("pos"), "m.line")
    head = F.col("line").rlike(HEADER)
    mark, said = F.regexp_extract("line", HEADER, 1), F.regexp_extract("line", HEADER, 2)
    marked = rows.withColumns({"fence": F.ltrim(F.regexp_replace("line", "^\\s+", "")).startswith(FENCE), "level": F.when(head, F.length(mark)), "header": F.when(head, said), "shown": F.when(head, F.concat(mark, F.lit(" "), said))})
    found = scanned(marked, [key], ["pos", "line", "fence", "level", "header", "shown"], _Sections, "section_ord long, line_number long, level long, header string, header_path string, text string")
    return found.withColumn("text", strip(F.col("text"))).where("text <> ''")


def markdown_toc(docs: DataFrame, key: str = "doc_id", stem: str = "stem") -> DataFrame:
    """(key, toc): each heading with its line; the file's stem comes first unless the first entry speaks of line 0."""
    entries = headings(docs, key).where("is_header").select(key, "line_no", F.concat(strip(F.col("line")), F.lit(" [line "), F.col("line_no").cast("string"), F.lit("]")).alias("entry"))
    tocs = entries.groupBy(key).agg(F.expr("listagg(entry, '\n') WITHIN GROUP (ORDER BY line_no)").alias("toc"), F.min_by("entry", "line_no").alias("first"))
    full = docs.select(key, F.col(stem).alias("stem")).join(tocs, key, "left")
    return full.select(key, F.when(F.col("toc").isNull(), "").when(F.contains("first", F.lit("[line 0]")), F.col("toc")).otherwise(F.concat(F.lit("# "), "stem", F.lit(" [line 0]\n"), "toc")).alias("toc"))
