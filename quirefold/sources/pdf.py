"""Pages of PDF files, without a PDF library: objects, also those in compressed object streams, the page tree, and each page as a
document of its own. Encrypted files are not read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirefold.functions.text import orientation

_SPACE = b"\x00\t\n\x0c\r "
_STOP = _SPACE + b"()<>[]{}/%"
_B, _W = rb"[\x00\t\n\x0c\r ]", b"[^" + re.escape(_STOP) + b"]"
#: The next token after blanks and comments: a name, a reference, a whole number, a dictionary's ends, a string without anything to
#: undo, any other string, hex digits, a list, other closing brackets, a word, an open hex string.
_TOKEN = re.compile(
    b"(?:" + _B + rb"++|%[^\r\n]*+[\r\n]?+)*+(?:/(" + _W + rb"*+)|(\d{1,10})" + _B + rb"++\d{1,10}" + _B + b"++R(?!" + _W + rb")|([+-]?\d++)(?!" + _W + rb")|(<<)|(>>)"
    rb"|\(([^()\\]*+)\)|(\()|<([^>]*+)>|(\[)|([\]{})>])|(" + _W + b"++)|(<))"
)
_NAME, _REF, _WHOLE, _OPEN, _CLOSE, _STRING, _OTHER, _HEX, _LIST, _END, _BARE = range(1, 12)
_PLAIN = re.compile(rb"[^()\\]*")
_STREAM = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)")
#: A name that is written as it is.
_SAFE = re.compile(rb"[0-9A-Za-z_.+-]*")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)$")
_ESCAPE = re.compile(rb"[0-7]{1,3}|\r\n|(?s:.)")
#: What a backslash and a letter stand for in a string.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Broken(ValueError):
    """The bytes aren't a PDF file that can be read here."""


class Name(bytes):
    pass


class Ref(int):
    """The number of an object."""


class Word(bytes):
    """An operator or a bare word."""


class Stream(dict):
    """A dictionary with the raw bytes that follow it."""

    raw = b""

    def plain(self, of=None) -> bytes:
        """The bytes without their compression; filters other than Flate raise."""
        filters = of(self.get(b"Filter")) if of else self.get(b"Filter")
        filters = [filters] if isinstance(filters, Name) else filters or []
        params = of(self.get(b"DecodeParms")) if of else self.get(b"DecodeParms")
        params = params if isinstance(params, list) else [params] * len(filters)
        out = self.raw
        for name, how in zip(filters, params):
            if name not in (b"FlateDecode", b"Fl"):
                raise Broken(f"filter {name!r}")
            out = zlib.decompressobj().decompress(out)
            out = _unpredicted(out, how or {})
        return out


def _unpredicted(data: bytes, how: dict) -> bytes:
    """Undo the row predictors of PNG."""
    if how.get(b"Predictor", 1) < 10:
        return data
    size = max(1, how.get(b"Colors", 1) * how.get(b"BitsPerComponent", 8) // 8)
    width = (how.get(b"Colors", 1) * how.get(b"BitsPerComponent", 8) * how.get(b"Columns", 1) + 7) // 8
    out, above = bytearray(), bytearray(width)
    for k in range(0, len(data) - width, width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(width):
            left, up, corner = (row[i - size] if i >= size else 0), above[i], (above[i - size] if i >= size else 0)
            if kind == 4:
                p = left + up - corner
                best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                best = (0, left, up, (left + up) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + best) & 255
        out += row
        above = row
    return bytes(out)


@lru_cache(4096)
def _named(w: bytes) -> Name:
    return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), w) if b"#" in w else w)


_CLOSED, _LISTED, _NULL, _REFERS = Word(b">>"), Word(b"]"), Word(b"null"), Word(b"R")


class Reader:
    """Values from a place in the bytes on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def value(self):
        """The next value; None at the end; a Word for a closing bracket or an operator."""
        m = _TOKEN.match(self.data, self.at)
        if m is None:
            self.at = len(self.data)
            return None
        self.at = m.end()
        kind = m.lastindex
        if kind == _NAME:
            return _named(m[_NAME])
        if kind == _WHOLE:
            return int(m[_WHOLE])
        if kind == _OPEN:
            items = self._until(_CLOSED)
            return dict(zip(items[::2], items[1::2]))
        if kind == _STRING:
            return m[_STRING]
        if kind == _BARE:
            w = m[_BARE]
            if w[0] < 58 and _NUMBER.match(w):  # digits, signs and the point come before letters
                return float(w) if b"." in w else int(w)
            return {b"true": True, b"false": False}.get(w, Word(w))
        if kind == _REF:
            self.at = m.end(_REF)  # outside a list or a dictionary it is a number
            return int(m[_REF])
        if kind == _LIST:
            return self._until(_LISTED)
        if kind == _CLOSE:
            return _CLOSED
        if kind == _OTHER:
            self.at -= 1
            return self.string()
        if kind == _HEX:
            digits = re.sub(rb"[^0-9a-fA-F]", b"", m[_HEX])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == _END:
            return Word(m[_END])
        raise Broken("an open string")

    def _until(self, end: Word) -> list:
        """Values up to a closing bracket, or to the end of the bytes; two numbers and an R are a reference."""
        out: list = []
        data, match = self.data, _TOKEN.match
        while True:
            m = match(data, self.at)
            if m is None:
                self.at = len(data)
                return out
            kind = m.lastindex
            if kind == _NAME:
                self.at = m.end()
                out.append(_named(m[_NAME]))
            elif kind == _REF:
                self.at = m.end()
                out.append(Ref(m[_REF]))
            elif kind == _WHOLE:
                self.at = m.end()
                out.append(int(m[_WHOLE]))
            else:
                v = self.value()
                if not isinstance(v, Word):
                    out.append(v)
                elif v == end:
                    return out
                elif v == _REFERS and len(out) > 1:  # with a comment in between
                    out.pop()
                    out[-1] = Ref(out[-1])
                else:
                    out.append(v if v != _NULL else None)

    def string(self) -> bytes:
        out, depth = bytearray(), 0
        while self.at < len(self.data):
            if depth:
                plain = _PLAIN.match(self.data, self.at)
                out += plain[0]
                self.at = plain.end()
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                m = _ESCAPE.match(self.data, self.at)
                if not m:
                    break
                self.at = m.end()
                t = m[0]
                out += bytes([int(t, 8) & 255]) if t.isdigit() and t[:1] in b"01234567" else b"" if t in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(t, t)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            if not (c == b"(" and depth == 1):
                out += c
        raise Broken("an open string")


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Broken("no PDF header")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"trailer", data):
            v = Reader(data, m.end()).value()
            if isinstance(v, dict):
                self.trailer |= v
        end = 0
        while m := _OBJECT.search(data, end):
            end = m.end()  # or that of the object's stream, within which none is looked for
            reader = Reader(data, end)
            try:
                value = reader.value()
            except Broken:
                continue
            after = _STREAM.match(data, reader.at) if isinstance(value, dict) else None
            if after:
                stop = data.find(b"endstream", after.end())
                size = value.get(b"Length")
                if isinstance(size, int) and not isinstance(size, Ref) and data[after.end() + size : after.end() + size + 12].lstrip().startswith(b"endstream"):
                    stop = after.end() + size
                stop = len(data) if stop < 0 else stop
                value = Stream(value)
                value.raw = data[after.end() : stop]
                end = stop
            self.objects[int(m[1])] = value
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.get(b"Type") == b"XRef":
                self.trailer |= {k: v for k, v in value.items() if k in (b"Root", b"Encrypt")}
        if b"Encrypt" in self.trailer:
            raise Broken("encrypted")
        for value in list(self.objects.values()):
            if isinstance(value, Stream) and value.get(b"Type") == b"ObjStm":
                self._unpack(value)

    def _unpack(self, stream: Stream) -> None:
        body, first = stream.plain(self.of), self.of(stream[b"First"])
        reader = Reader(body)
        heads = [reader.value() for _ in range(2 * self.of(stream[b"N"]))]
        for number, at in zip(heads[::2], heads[1::2]):
            self.objects.setdefault(number, Reader(body, first + at).value())

    def of(self, value):
        """The value that a reference stands for."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def pages(self) -> list[dict]:
        """The pages in order, each with what it inherits."""
        root = self.of(self.trailer.get(b"Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get(b"Type") == b"Catalog"), None)
        if not isinstance(root, dict):
            raise Broken("no catalog")
        out: list[dict] = []
        stack, seen = [(root.get(b"Pages"), {})], set()
        while stack:
            ref, given = stack.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            given = given | {k: node[k] for k in (b"MediaBox", b"CropBox", b"Resources", b"Rotate") if k in node}
            kids = self.of(node.get(b"Kids"))
            if isinstance(kids, list) and node.get(b"Type") != b"Page":
                stack += [(kid, given) for kid in reversed(kids)]
            else:
                out.append(given | node)
        return out

    def box(self, page: dict) -> tuple[float, float]:
        """Width and height of the media box; a rotation of the page doesn't count."""
        box = [self.of(x) for x in self.of(page.get(b"MediaBox")) or [0, 0, 612, 792]]
        return abs(float(box[2]) - float(box[0])), abs(float(box[3]) - float(box[1]))

    def alone(self, page: dict) -> bytes:
        """A document of this page only, with all objects that it needs."""
        numbers: dict[int, int] = {}
        bodies: list[bytes] = []

        def told(value) -> bytes:
            if isinstance(value, Ref):
                return b"%d 0 R" % placed(value)
            if isinstance(value, dict):
                return b"<<" + b"".join(told(Name(k)) + b" " + told(v) for k, v in value.items()) + b">>"
            if isinstance(value, list):
                return b"[" + b" ".join(map(told, value)) + b"]"
            if isinstance(value, Name):
                return b"/" + (bytes(value) if _SAFE.fullmatch(value) else re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02x" % m[0][0], bytes(value)))
            if isinstance(value, bool):
                return b"true" if value else b"false"
            if isinstance(value, Word):
                return bytes(value)
            if isinstance(value, bytes):
                return b"<" + value.hex().encode() + b">"
            return b"null" if value is None else (b"%d" % value if isinstance(value, int) else b"%.6f" % value)

        def placed(ref: Ref) -> int:
            if int(ref) not in numbers:
                numbers[int(ref)] = len(numbers) + 4
                bodies.append(b"")
                at = len(bodies) - 1
                value = self.objects.get(int(ref))
                if isinstance(value, dict) and value.get(b"Type") in (b"Page", b"Pages", b"Catalog"):
                    bodies[at] = b"null"  # links to other pages lead nowhere
                elif isinstance(value, Stream):
                    bodies[at] = told(dict(value) | {b"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
                else:
                    bodies[at] = told(value)
            return numbers[int(ref)]

        own = told({k: v for k, v in page.items() if k not in (b"Parent", b"Type")})
        return written([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", b"<</Type/Page/Parent 2 0 R" + own[2:], *bodies])

    def text(self, page: dict) -> str:
        """What the page's strings say, a line for each move to another place. Fonts aren't read: bytes count as Latin-1."""
        contents = self.of(page.get(b"Contents"))
        streams = [self.of(c) for c in contents] if isinstance(contents, list) else [contents]
        reader = Reader(b"\n".join(s.plain(self.of) for s in streams if isinstance(s, Stream)))
        lines, line, held = [], [], []
        while (v := reader.value()) is not None:
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET") and line:
                lines.append(b"".join(line))
                line = []
            if v in (b"Tj", b"'", b'"', b"TJ"):
                said = held[-1] if held else b""
                line += [x for x in said if isinstance(x, bytes)] if isinstance(said, list) else [said] if isinstance(said, bytes) else []
            held = []
        return "\n".join(x.decode("latin-1") for x in [*lines, b"".join(line)] if x)


def written(bodies: list[bytes]) -> bytes:
    """A file of these objects, numbered from 1; the first is the catalog."""
    out, places = bytearray(b"%PDF-1.7\n"), []
    for k, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))


def text_pdf(pages: list[str], width: int = 612, height: int = 792) -> bytes:
    """A plain document of these page texts (letters beyond Latin-1 become question marks), its page tree in a compressed object stream."""
    n = len(pages)
    packed = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/MediaBox[0 0 %d %d]/Kids[%s]>>" % (n, width, height, b" ".join(b"%d 0 R" % (k + 4) for k in range(n))), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    packed += [b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (n + k + 4) for k in range(n)]
    bodies = []
    for text in pages:
        lines = [re.sub(rb"([\\()])", rb"\\\1", line.encode("latin-1", "replace")) for line in text.split("\n")]
        body = zlib.compress(b"BT/F 12 Tf 14 TL 40 %d Td\n" % (height - 40) + b"\n".join(b"(%s) Tj T*" % line for line in lines) + b"\nET")
        bodies.append(b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(body), body))
    heads, body = [], b""
    for k, x in enumerate(packed, 1):
        heads.append(b"%d %d" % (k, len(body)))
        body += x + b"\n"
    head = b" ".join(heads) + b"\n"
    squeezed = zlib.compress(head + body)
    bodies.append(b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(packed), len(head), len(squeezed), squeezed))
    out = bytearray(b"%PDF-1.7\n")
    for k, x in enumerate(bodies):
        out += b"%d 0 obj\n" % (n + k + 4) + x + b"\nendobj\n"
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\n%%%%EOF\n" % (2 * n + 5))


def probe(files: DataFrame, content: str = "content") -> DataFrame:
    """path, nb_pages, format (by the first page) and error, from the bytes of each file; a file that can't be read has null for both and
    says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    doc = Document(bytes(data or b""))
                    pages = doc.pages()
                    size = doc.box(pages[0]) if pages else (None, None)
                    rows.append((path, len(pages), *size, None))
                except Exception as error:  # whatever is wrong with a file is a result of its row
                    rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
            out = pd.DataFrame(rows, columns=["path", "nb_pages", "width", "height", "error"])
            yield out.astype({"nb_pages": "Int64", "width": "float64", "height": "float64"})

    seen = files.select("path", F.col(content).alias("content")).mapInPandas(run, "path string, nb_pages long, width double, height double, error string")
    return seen.select("path", "nb_pages", F.when(F.col("width").isNotNull(), orientation(F.col("width"), F.col("height"))).alias("format"), "error")


def pages(files: DataFrame, keep: list[str] | None = None, content: str = "content", strict: bool = True) -> DataFrame:
    """keep (default path), page_number from 1, width, height and content, each page as a document of its own. A file that can't be read
    raises, or yields nothing unless strict. Pages leave a task in batches of a few, so a long document is never held twice."""
    keep = keep or ["path"]
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                try:
                    doc = Document(bytes(row.pop("__content") or b""))
                    found = doc.pages()
                except Exception:
                    if strict:
                        raise
                    continue
                for lo in range(0, len(found), 8):
                    rows = [{**row, "page_number": lo + k + 1, "width": doc.box(p)[0], "height": doc.box(p)[1], "content": doc.alone(p)} for k, p in enumerate(found[lo : lo + 8])]
                    yield pd.DataFrame(rows)

    return files.select(*keep, F.col(content).alias("__content")).mapInPandas(run, f"{kinds}, page_number long, width double, height double, content binary")


#: Rows and bytes of a batch of opened files.
OPENED_ROWS, OPENED_BYTES = 1024, 1 << 20


def opened(files: DataFrame, keep: list[str] | None = None, content: str = "content") -> DataFrame:
    """probe() and pages() in one: each file is parsed once. keep (default path), page_number, nb_pages, format, error and content: a row
    with page_number 0 for a file, which says its pages and format or what is wrong with it, then one with the content of each page."""
    keep = keep or ["path"]
    kinds = {c: files.schema[c].dataType for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*(to_arrow_type(t) for t in kinds.values()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.binary()]
        names = [*keep, "page_number", "nb_pages", "width", "height", "error", "content"]
        held: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        for batch in batches:
            for *row, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    doc = Document(data or b"")
                    found = doc.pages()
                    held.append((*row, 0, len(found), *(doc.box(found[0]) if found else (None, None)), None, None))
                except Exception as error:  # whatever is wrong with a file is a result of its row
                    held.append((*row, 0, None, None, None, f"{type(error).__name__}: {error}", None))
                    continue
                for k, page in enumerate(found, 1):
                    one = doc.alone(page)
                    held.append((*row, k, None, None, None, None, one))
                    size += len(one)
                    if len(held) >= OPENED_ROWS or size > OPENED_BYTES:
                        yield full()
                        held, size = [], 0
        if held:
            yield full()

    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items())
    out = files.select(*keep, content).mapInArrow(run, f"{schema}, page_number long, nb_pages long, width double, height double, error string, content binary")
    shape = F.when(F.col("width").isNotNull(), orientation(F.col("width"), F.col("height")))
    return out.select(*keep, "page_number", "nb_pages", shape.alias("format"), "error", "content")
