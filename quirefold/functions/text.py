"""Scalar functions over text: unwrapping of model responses, names, outlines' lines. All are built-in expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text, as ends of a line, as a code fence and as a page's end.
SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
FENCE = "```"
HEADER = "^(#+)\\s(.*)"
PAGE_END = "--- end page (\\d+)"
NONE, END = "<none>", "<end>"

#: Media types by extension.
MEDIA = {"pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "json": "application/json", "png": "image/png", "jpg": "image/jpeg"}


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def split_lines(c: Column) -> Column:
    """Lines without a last empty one; an empty text has none."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def unwrap_markdown(c: Column) -> Column:
    """The first block fenced as markdown, up to the next fence or the end, stripped; without one the text as it is."""
    block = f"(?s){FENCE}markdown\\s*(.*?)(?:{FENCE}|\\z)"
    return F.when(c.rlike(block), strip(F.regexp_extract(c, block, 1))).otherwise(c)


def unwrap_any(c: Column) -> Column:
    """The same for a block of any language tag."""
    block = f"(?s){FENCE}([a-zA-Z]*)\\s*(.*?)(?:{FENCE}|\\z)"
    return F.when(c.rlike(block), strip(F.regexp_extract(c, block, 2))).otherwise(c)


def json_text(c: Column) -> Column:
    """The first block fenced as json; null without one."""
    block = f"(?s){FENCE}json\\n(.*?){FENCE}"
    return F.when(c.rlike(block), F.regexp_extract(c, block, 1))


def json_block(c: Column) -> Column:
    """The block as VARIANT; null where it is missing or malformed."""
    return F.try_parse_json(json_text(c))


def strict_json_block(c: Column) -> Column:
    return F.parse_json(F.when(json_text(c).isNull(), F.raise_error(F.lit("no JSON block in the response"))).otherwise(json_text(c)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Basename without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1)))


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, kind in MEDIA.items():
        out = F.when(suffix == name, F.lit(kind)).otherwise(out)
    return out


def safe_name(path: Column) -> Column:
    return F.regexp_replace(basename(path), "[()\\s]", "_")


def storage_names(path: Column) -> dict[str, Column]:
    """Names under which the parts of a document's index are kept; each `.pdf` in the path goes, the folder stays."""
    whole = F.when(path.contains("/"), F.concat(parent_dir(path), F.lit("/"), safe_name(path))).otherwise(safe_name(path))
    bare = F.replace(whole, F.lit(".pdf"), F.lit(""))
    return {"stem": bare, "vector": F.concat(bare, F.lit("_vector")), "summary": F.concat(bare, F.lit("_summary")), "summary_text": F.concat(bare, F.lit("_summary.txt"))}


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:application/pdf;base64,"), F.base64(content))


def sentinel(c: Column) -> Column:
    return F.when(strip(c) == NONE, F.lit("")).otherwise(c)


def first_toc(extracted: Column, created: Column) -> Column:
    """The first that isn't empty; null if both are."""
    return F.coalesce(F.nullif(extracted, F.lit("")), F.nullif(created, F.lit("")))


def head_pages(text: Column, marker: str = "--- end page 10") -> Column:
    return F.substring_index(text, marker, 1)


def is_ended(c: Column) -> Column:
    return c.contains(END)


def without_end(c: Column) -> Column:
    return F.replace(c, F.lit(END), F.lit(""))


def tree_line(depth: Column, name: Column, number: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth.cast("int")), name, F.lit(" ["), number.cast("string"), F.lit("]"))


def display(c: Column) -> Column:
    """JSON objects and lists are set out with an indent of two, others stay. Spark's own writer doesn't set out variants; this is for
    what a viewer shows of one document."""

    @F.pandas_udf("string")
    def set_out(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(json.loads(v), indent=2, ensure_ascii=False), na_action="ignore")

    return F.when(c.rlike("^\\s*[\\[{]") & F.try_parse_json(c).isNotNull(), set_out(F.when(F.try_parse_json(c).isNotNull(), c))).otherwise(c)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").otherwise("portrait")
