"""Record files (PalmDB: MOBI, AZW3): text records, chapters, elements, metadata block, cover.

Records are read as they stand; compressed text stays noise. Bounds that protect against broken files are part of the
result and are stated below.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from librarium.schemas import ELEMENT
from librarium.sources import html as H

# Bounds of the record list, of a text record, and of what is searched; TEXT_RECORDS only holds in compat mode.
MOST_RECORDS, MOST_BYTES, TEXT_RECORDS = 10_000, 100_000, 100
SEARCHED, COVER_BYTES, COVER_RECORDS = 200_000, 5 << 20, 100
ENOUGH = 1_000
# Kinds of metadata records.
KINDS = {100: "author", 101: "tags", 105: "description", 106: "publisher", 503: "title"}
# What opens a chapter in tags, and in plain text.
IN_TAGS = re.compile(r"<[^>]*>(第[零一二三四五六七八九十百千万0-9]+[章节回][^<]{0,50})</[^>]*>")
IN_TEXT = [
    re.compile(r"^(?:Chapter|CHAPTER|Ch\.)\s*(?:[0-9]+|One|Two|Three|Four|Five).*$", re.M),
    re.compile(r"^第[零一二三四五六七八九十百千万0-9]+[章节回].*$", re.M),
    re.compile(r"^[零一二三四五六七八九十百千万]+[、．.].*$", re.M),
    re.compile(r"^[0-9]{1,3}[、．.].*$", re.M),
]
WHOLE = "全文"


def records(data: bytes) -> list[bytes]:
    """The records of a file, none if its list is broken."""
    if len(data) < 78:
        return []
    (n,) = struct.unpack_from(">H", data, 76)
    if not 1 <= n <= MOST_RECORDS or len(data) < 78 + 8 * n:
        return []
    at = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    return [data[a:b] if a < b else b"" for a, b in zip(at, at[1:])]


def text_of(data: bytes, compat: bool = False) -> str:
    """All records after the first that are no pictures, neither empty nor too large, as UTF-8, joined by line breaks; too little text counts as none.

    compat reads records 1 to 99 only, as an older reader did, and so loses the rest of a long book.
    """
    parts = [r for r in records(data)[1 : TEXT_RECORDS if compat else None] if 0 < len(r) <= MOST_BYTES and (compat or not r.startswith(_PICTURE))]
    text = "\n".join(r.decode("utf-8", "replace") for r in parts)
    return text if len(text) > ENOUGH else ""


#: What a picture begins with; such a record is no text.
_PICTURE = (b"\xff\xd8", b"\x89PNG", b"GIF8")


def documents(data: bytes, compat: bool = False) -> Iterator[tuple]:
    """(index, title, level, elements) of every chapter; files without enough text give none."""
    text = text_of(data, compat)
    for i, (title, level, a, b) in enumerate(chapters(text) if text else []):
        yield i, title, level, content_elements(text[a:b], title)


def _outer(text: str) -> list[tuple[int, int, str]]:
    """(position of the first equal heading, level, title) of headings in order."""
    found = []
    for m in re.finditer(r"<h([1-6])(?:\s[^>]*)?>.*?</h\1\s*>", text, re.S | re.I):
        found.append((text.find(m[0]), int(m[1]) - 1, H.parse(m[0]).text()))
    return found


def chapters(text: str) -> list[tuple[str, int, int, int]]:
    """(title, level, from, to): by headings, else by chapter marks in tags, else by marks at line starts, else one."""
    heads = _outer(text)
    spans = [(t, lv, a, heads[i + 1][0] if i + 1 < len(heads) else len(text)) for i, (a, lv, t) in enumerate(heads)]
    spans = [s for s in spans if s[0] and s[2] >= 0 and s[3] > s[2]]
    if spans:
        return spans
    marks = [(m.start(), m[1].strip()) for m in IN_TAGS.finditer(text)]
    if not marks:
        plain = H.parse(text).text()
        met: dict[int, str] = {}
        for p in IN_TEXT:
            for m in p.finditer(plain):
                met.setdefault(m.start(), m[0].strip())
        marks = [(_place(text, t, p), t) for p, t in sorted(met.items())]
    ends = [a for a, _ in marks[1:]] + [len(text)]
    spans = [(t, 0, a, b) for (a, t), b in zip(marks, ends) if a >= 0 and b > a]
    return spans or [(WHOLE, 0, 0, len(text))]


def _place(text: str, title: str, near: int) -> int:
    for t in (title, " ".join(title.split())):
        if (at := text.find(t)) >= 0:
            return at
    return min(max(near, 0), len(text))


def content_elements(text: str, title: str) -> list[dict]:
    """The title as a heading, then blocks; of unknown tags their own text is a paragraph."""
    out = [H.element("Heading", level=1, text=title)] if title.strip() else []
    stack = list(reversed(H.body(H.parse(text)).elements()))
    while stack:
        n = stack.pop()
        if n.tag in H.HEADINGS:
            if n.text():
                out.append(H.element("Heading", level=int(n.tag[1]), text=n.text()))
        elif n.tag in ("p", "blockquote"):
            if spans := _spans(n):
                out.append(H.element("Paragraph" if n.tag == "p" else "Quote", spans=spans))
        elif n.tag in ("pre", "code"):
            if n.text():
                out.append(H.element("Code", text=n.text()))
        elif n.tag == "hr":
            out.append(H.element("Divider"))
        elif n.tag in ("div", "section", "article", "body"):
            stack.extend(reversed(n.elements()))
        elif own := H.fold("".join(c for c in n.children if isinstance(c, str))).strip():
            out.append(H.element("Paragraph", spans=[H.span(own)]))
    return out


def _spans(n: H.Node) -> list[dict]:
    out = []
    for c in n.children:
        t = H.fold(c).strip() if isinstance(c, str) else c.text()
        if t:
            style = [] if isinstance(c, str) or c.tag == "a" or c.tag not in H.STYLES else [H.STYLES[c.tag]]
            out.append(H.span(t, style))
    return out


def metadata_block(data: bytes) -> bytes | None:
    """The block of metadata records: where the header says, else the first that is met near the start."""
    try:
        (head,) = struct.unpack_from(">I", data, 78)
        if 0 < head <= len(data):
            (flags,) = struct.unpack_from(">I", data, head + 128)
            if not flags & 0x40:
                return None
            at = head + struct.unpack_from(">I", data, head + 20)[0] + 16
            if data[at : at + 4] == b"EXTH":
                (n,) = struct.unpack_from(">I", data, at + 4)
                return data[at : at + n] if 12 <= n <= MOST_BYTES else None
        else:
            return None
    except struct.error:
        pass
    near = data[:SEARCHED]
    at = near.find(b"EXTH")
    while at >= 0 and at + 12 <= len(near):
        (n,) = struct.unpack_from(">I", near, at + 4)
        if 12 <= n <= MOST_BYTES and at + n <= len(near):
            return near[at : at + n]
        at = near.find(b"EXTH", at + 1)
    return None


def metadata(data: bytes) -> dict | None:
    """Title, author, publisher, description and tags; none without a title or an author."""
    block = metadata_block(data)
    if block is None:
        return None
    out: dict = dict.fromkeys(("title", "author", "publisher", "description"))
    tags: list[str] = []
    at = 12
    for _ in range(struct.unpack_from(">I", block, 8)[0]):
        if at + 8 > len(block):
            break
        kind, size = struct.unpack_from(">II", block, at)
        if size < 8 or at + size > len(block):
            break
        value = block[at + 8 : at + size].decode("utf-8", "replace").strip()
        name = KINDS.get(kind)
        if name == "tags":
            tags += [t for x in value.replace(",", ";").split(";") if 1 <= len(t := x.strip()) <= 50]
        elif name:
            out[name] = value
        at += size
    if out["title"] is None and out["author"] is None:
        return None
    return out | {"isbn": None, "tags": list(dict.fromkeys(tags))}


def cover(data: bytes) -> tuple[str, bytes] | None:
    """The first JPEG or PNG among the first records."""
    for r in records(data)[:COVER_RECORDS]:
        if 0 < len(r) <= COVER_BYTES:
            if r[:2] == b"\xff\xd8":
                return "jpg", r
            if r[:2] == b"\x89P":
                return "png", r
    return None


def _each(df: DataFrame, key: str, content: str, columns: list[str], schema: str, rows) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *r) for k, d in zip(pdf[key], pdf[content]) if d is not None for r in rows(bytes(d))], columns=[key, *columns])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, {schema}")


def mobi_documents(df: DataFrame, key: str, content: str = "content", compat: bool = False) -> DataFrame:
    """(key, index, title, level, content) of every chapter; files without enough text give none."""

    return _each(df, key, content, ["index", "title", "level", "content"], f"index INT, title STRING, level INT, content ARRAY<{ELEMENT}>", lambda d: documents(d, compat))


def mobi_metadata(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    names = ["title", "author", "publisher", "description", "isbn", "tags"]
    schema = "title STRING, author STRING, publisher STRING, description STRING, isbn STRING, tags ARRAY<STRING>"
    return _each(df, key, content, names, schema, lambda d: [tuple(m[n] for n in names)] if (m := metadata(d)) else [])


def mobi_covers(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    return _each(df, key, content, ["ext", "content"], "ext STRING, content BINARY", lambda d: [c] if (c := cover(d)) else [])
