"""Paged files (PDF): text of pages, outline, document information, images. Needs nothing but zlib.

Read are plain and Flate streams, object streams, text operators with simple fonts and with fonts that carry a map to
Unicode. Encrypted files, other filters and fonts without such a map give no text; a damaged file gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_WHITE = b"\x00\t\n\x0c\r "
_OBJECT = re.compile(rb"(?:^|[\s>])(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\r\n]+[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|[{})])", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Nesting of arrays, dictionaries and page nodes that is followed.
DEPTH = 60


class Ref(int):
    """A reference to an object by its number."""


class Name(str):
    """A name, which is not a string."""


class Op(str):
    """A word of a content stream."""


class Reader:
    """Values of a byte string, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def token(self) -> bytes | None:
        m = _TOKEN.match(self.data, self.at)
        if m is None:
            return None
        self.at = m.end()
        return m[1]

    def string(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        while self.at < len(d):
            c = d[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                    continue
                e = d[self.at : self.at + 1]
                self.at += 1
                if e == b"\r" and d[self.at : self.at + 1] == b"\n":
                    self.at += 1
                elif e not in b"\r\n":
                    out += _ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self, depth: int = 0):
        t = self.token()
        if t is None or depth > DEPTH:
            return None
        if t == b"<<":
            out = {}
            while True:
                k = self.value(depth + 1)
                if not isinstance(k, Name):
                    return out
                v = self.value(depth + 1)
                if isinstance(v, Op) and v == ">>":
                    return out
                out[str(k)] = v
        if t == b"[":
            items = []
            while True:
                v = self.value(depth + 1)
                if v is None or (isinstance(v, Op) and v == "]"):
                    return items
                items.append(v)
        if t == b"(":
            return self.string()
        if t[:1] == b"<" and t != b"<<":
            h = re.sub(rb"[^0-9A-Fa-f]", b"", t)
            return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?\d+", t):
            m = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(int(t))
            return int(t)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", t):
            return float(t)
        return Op(t.decode("latin-1"))


def text_string(b) -> str | None:
    """A text string: UTF-16 or UTF-8 by its mark, else one byte a character."""
    if not isinstance(b, bytes):
        return None
    if b[:2] == b"\xfe\xff":
        return b[2:].decode("utf-16-be", "replace")
    if b[:3] == b"\xef\xbb\xbf":
        return b[3:].decode("utf-8", "replace")
    return b.decode("cp1252", "replace")


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data = data
        self.at = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}  # of several versions the last
        self.packed: dict[int, object] = {}
        self.known: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for n in list(self.at):
            d = self.get(Ref(n))
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                self._unpack(n, d)
        trailers = [Reader(data, m.end()).value() for m in re.finditer(rb"\btrailer\b", data)]
        trailers += [d for n in self.at if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "XRef"]
        self.trailer = {k: v for t in trailers if isinstance(t, dict) for k, v in t.items()}
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            self.root = next((d for n in self.at if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"), {})

    def get(self, v):
        for _ in range(DEPTH):
            if not isinstance(v, Ref):
                return v
            n = int(v)
            if n in self.packed:
                v = self.packed[n]
            elif n in self.at:
                if n not in self.known:
                    r = Reader(self.data, self.at[n])
                    self.known[n] = r.value()
                    m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, r.at)
                    if m:
                        self.streams[n] = self._raw(m.end(), self.known[n])
                v = self.known[n]
            else:
                return None
        return None

    def _raw(self, at: int, d) -> bytes:
        n = self.get(d.get("Length")) if isinstance(d, dict) else None
        if isinstance(n, int) and re.match(rb"\s*endstream", self.data[at + n : at + n + 20]):
            return self.data[at : at + n]
        end = self.data.find(b"endstream", at)
        return self.data[at : end if end >= 0 else len(self.data)]

    def stream(self, ref) -> bytes:
        """The content of a stream object; none for filters that are not read."""
        d = self.get(ref)
        if not isinstance(ref, Ref) or not isinstance(d, dict) or int(ref) not in self.streams:
            return b""
        filters = self.get(d.get("Filter")) or []
        data = self.streams[int(ref)]
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) != "FlateDecode":
                return b""
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        return data

    def _unpack(self, n: int, d: dict) -> None:
        data = self.stream(Ref(n))
        r = Reader(data)
        heads = [r.value() for _ in range(2 * (d.get("N") or 0))]
        first = self.get(d.get("First")) or 0
        for num, off in zip(heads[::2], heads[1::2]):
            if isinstance(num, int) and isinstance(off, int):
                self.packed[num] = Reader(data, first + off).value()

    def pages(self) -> list[dict]:
        """Pages in order, each with the resources it inherits."""
        out, todo, seen = [], [(self.root.get("Pages"), None)], set()
        while todo:
            ref, inherited = todo.pop()
            if ref is None or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            resources = node.get("Resources", inherited)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo.extend((k, resources) for k in reversed(kids))
            else:
                out.append(node | {"Resources": resources})
        return out

    def text(self, page: dict) -> str:
        """Text in the order it is drawn: a line for each move to a new line, a blank line for a move of more than two."""
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {k: self._map(f) for k, f in fonts.items()}
        r, stack, out, font = Reader(b"\n".join(self.stream(c) for c in refs)), [], [], None
        leading, height = 0.0, 0.0

        def newline(dy: float) -> None:
            if out and dy:
                out.append("\n\n" if leading and abs(dy) > 1.6 * leading else "\n")

        while (v := r.value()) is not None:
            if not isinstance(v, Op):
                stack.append(v)
                continue
            args, stack = stack, []
            number = [x for x in args if isinstance(x, int | float)]
            if v == "Tf" and args and isinstance(args[0], Name):
                font = maps.get(str(args[0]))
            elif v == "TL" and number:
                leading = abs(number[-1])
            elif v in ("Td", "TD") and len(number) == 2:
                if v == "TD":
                    leading = abs(number[1])
                newline(number[1])
            elif v == "Tm" and len(number) == 6:
                newline(number[5] - height)
                height = number[5]
            elif v == "T*":
                newline(leading or 1.0)
            elif v in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                if v != "Tj":
                    newline(leading or 1.0)
                out.append(_shown(args[-1], font))
            elif v == "TJ" and args and isinstance(args[-1], list):
                for x in args[-1]:
                    if isinstance(x, bytes):
                        out.append(_shown(x, font))
                    elif isinstance(x, int | float) and x < -200:
                        out.append(" ")
        return "".join(out)

    def _map(self, font) -> tuple[int, dict[int, str], list[tuple[int, int, int]]] | None:
        """(bytes of a code, code to text, ranges of codes with the first character of each) of a font with a map to Unicode."""
        d = self.get(font)
        if not isinstance(d, dict) or "ToUnicode" not in d:
            return None
        cmap = self.stream(d["ToUnicode"])
        width = 2 if d.get("Subtype") == "Type0" else 1
        out: dict[int, str] = {}
        ranges: list[tuple[int, int, int]] = []
        code = lambda h: int(h, 16)
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out.update((code(a), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                if len(to) <= 4:
                    ranges.append((code(a), code(b), code(to)))
        return width, out, ranges

    def outline(self) -> list[tuple[str | None, bool]]:
        """(title, whether it has a target) of the top level of the outline."""
        top = self.get(self.root.get("Outlines"))
        ref, out, seen = top.get("First") if isinstance(top, dict) else None, [], set()
        while isinstance(ref, Ref) and int(ref) not in seen:
            seen.add(int(ref))
            item = self.get(ref)
            if not isinstance(item, dict):
                break
            out.append((text_string(self.get(item.get("Title"))), item.get("Dest") is not None))
            ref = item.get("Next")
        return out

    def info(self) -> dict[str, str | None]:
        d = self.get(self.trailer.get("Info"))
        return {k: text_string(self.get(v)) for k, v in d.items()} if isinstance(d, dict) else {}

    def images(self) -> list[tuple[int, str, bytes]]:
        """(page, name, content) of images that are whole JPEG files."""
        out = []
        for no, page in enumerate(self.pages()):
            things = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
            for name, ref in things.items():
                d = self.get(ref)
                if isinstance(ref, Ref) and isinstance(d, dict) and d.get("Subtype") == "Image" and self.get(d.get("Filter")) in ("DCTDecode", ["DCTDecode"]):
                    out.append((no, str(name), self.streams.get(int(ref), b"")))
        return out


def _shown(b: bytes, font: tuple[int, dict[int, str], list[tuple[int, int, int]]] | None) -> str:
    if font is None:
        return b.decode("cp1252", "replace")
    width, table, ranges = font
    out = []
    for c in (int.from_bytes(b[i : i + width], "big") for i in range(0, len(b), width)):
        t = table.get(c)
        if t is None:
            t = next((chr(base + c - lo) for lo, hi, base in ranges if lo <= c <= hi), "")
        out.append(t)
    return "".join(out)


def chapter_ranges(outline: list[tuple[str | None, bool]], pages: int) -> list[tuple[str, int, int]]:
    """(title, first page, last page). By the outline's top level, with the page estimated from the place in it (whole division, ten steps at least), else in equal parts."""
    if outline:
        starts = [i * (pages // 10) if target else 0 for i, (_, target) in enumerate(outline)]
        ends = [s - 1 for s in starts[1:]] + [pages - 1]
        return [(t if t is not None else f"Chapter {i + 1}", a, b) for i, ((t, _), a, b) in enumerate(zip(outline, starts, ends))]
    size = 10 if pages <= 50 else 20 if pages <= 200 else 30
    cuts = [(a, min(a + size, pages) - 1) for a in range(0, pages, size)]
    return [(f"第 {i + 1} 部分 (页 {a + 1}-{b + 1})", a, b) for i, (a, b) in enumerate(cuts)]


def chapters(data: bytes) -> Iterator[tuple[int, str, int, int, str]]:
    """(index, title, first page, last page, text of the pages) of a file."""
    p = Pdf(data)
    texts = [p.text(page) for page in p.pages()]
    for i, (title, a, b) in enumerate(chapter_ranges(p.outline(), len(texts))):
        yield i, title, a, b, "\n".join(texts[a : b + 1])


def metadata(data: bytes) -> dict | None:
    """Title, author, publisher (the producer), description (the subject) and tags (the keywords); none without document information."""
    info = Pdf(data).info()
    if not info:
        return None
    clean = lambda k: (info.get(k) or "").strip() or None
    tags = [t for x in re.split("[;,/|]", info.get("Keywords") or "") if 1 <= len(t := x.strip()) <= 50]
    return {"title": clean("Title"), "author": clean("Author"), "publisher": clean("Producer"), "description": clean("Subject"), "isbn": None, "tags": list(dict.fromkeys(tags))}


# ---------------------------------------------------------------- tables


def _each(df: DataFrame, key: str, content: str, columns: list[str], schema: str, rows: Callable) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[content]):
                try:
                    out += [(k, *r) for r in rows(bytes(data))] if data is not None else []
                except Exception:  # noqa: BLE001 - a damaged file gives no rows and must not end the job
                    continue
            yield pd.DataFrame(out, columns=[key, *columns])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, {schema}")


def pdf_pages(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, page from 0, text) of every page."""

    def rows(data: bytes):
        p = Pdf(data)
        return [(i, p.text(page)) for i, page in enumerate(p.pages())]

    return _each(df, key, content, ["page", "text"], "page INT, text STRING", rows)


def pdf_chapters(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, index, title, start_page, end_page, text) of every chapter."""
    return _each(df, key, content, ["index", "title", "start_page", "end_page", "text"], "index INT, title STRING, start_page INT, end_page INT, text STRING", chapters)


def pdf_metadata(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    names = ["title", "author", "publisher", "description", "isbn", "tags"]
    schema = "title STRING, author STRING, publisher STRING, description STRING, isbn STRING, tags ARRAY<STRING>"
    return _each(df, key, content, names, schema, lambda d: [tuple(m[n] for n in names)] if (m := metadata(d)) else [])


def pdf_images(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    return _each(df, key, content, ["page", "name", "content"], "page INT, name STRING, content BINARY", lambda d: Pdf(d).images())
