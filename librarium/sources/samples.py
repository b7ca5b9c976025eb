"""Files made of tables: books written as containers, record files, paged files and pages. The queries and tests of the readers read them back."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from librarium.functions import text as X

#: Characters of a record of text; its bytes stay below what readers take.
RECORD = 20_000


def paragraphs(text: str) -> list[str]:
    return [t for line in text.split("\n") if (t := line.strip())]


def page(title: str, chapters: list[tuple[str, list[str]]], meta: dict) -> bytes:
    """A web page with a heading for each chapter, the first of the first level, the others of the second."""
    head = "".join(f'<meta name="{k}" content="{escape(v)}">' for k, v in meta.items() if v is not None)
    body = "".join(f"<h{2 if i else 1}>{escape(t)}</h{2 if i else 1}>" + "".join(f"<p>{escape(p)}</p>" for p in ps) + f'<img src="i{i}.png" alt="">' for i, (t, ps) in enumerate(chapters))
    return f"<html><head><title>{escape(title)}</title>{head}</head><body><nav><p>menu</p></nav><article>{body}</article></body></html>".encode()


def container(title: str, author: str | None, publisher: str | None, tags: list[str], chapters: list[tuple[str, list[str]]]) -> bytes:
    """An e-book container: package, contents, a file for each chapter; chapters of odd places lie one level deeper, the last is not in the contents."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in [("title", title), ("creator", author), ("publisher", publisher), *(("subject", t) for t in tags)] if v is not None)
        items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        z.writestr("OEBPS/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{dc}<meta name="cover" content="cv"/></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="cv" href="img/cover.png" media-type="image/png"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>')
        label = lambda i: f'<navLabel><text>{escape(chapters[i][0])}</text></navLabel><content src="text/c{i}.xhtml#top"/>'
        n = len(chapters) - 1
        points = "".join(f"<navPoint>{label(i)}{f'<navPoint>{label(i + 1)}</navPoint>' if i + 1 < n else ''}</navPoint>" for i in range(0, n, 2))
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for i, (t, ps) in enumerate(chapters):
            body = "".join(f"<p>{escape(p)}</p>" for p in ps)
            z.writestr(f"OEBPS/text/c{i}.xhtml", f'<html><body><h1>{escape(t)}</h1><p>note <a href="#n1">x</a></p>{body}<img src="../img/i{i}.png"/><aside epub:type="footnote" id="n1"><p>a note</p></aside></body></html>')
            z.writestr(f"OEBPS/img/i{i}.png", b"\x89PNG" + struct.pack(">I", i))
        z.writestr("OEBPS/img/cover.png", b"\x89PNGcover")
    return out.getvalue()


def record_file(title: str, author: str | None, publisher: str | None, tags: list[str], chapters: list[tuple[str, list[str]]]) -> bytes:
    """A record file with a metadata block, its text in records, a picture as the last one."""
    exth = [(k, v.encode()) for k, v in [(503, title), (100, author), (106, publisher), (101, "; ".join(tags) or None)] if v is not None]
    body = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in exth)
    head = bytearray(232)
    struct.pack_into(">I", head, 20, 216)
    struct.pack_into(">I", head, 128, 0x40)
    text = "".join(f"<h1>{escape(t)}</h1>" + "".join(f"<p>{escape(p)}</p>" for p in ps) for t, ps in chapters)
    # records break between blocks, so a line break between records changes no text
    records, now = [bytes(head) + b"EXTH" + struct.pack(">II", 12 + len(body), len(exth)) + body], ""
    for block in (b for whole in text.replace("><", ">\x00<").split("\x00") for b in _cut(whole)):
        if len(now) + len(block) > RECORD and now:
            records.append(now.encode())
            now = ""
        now += block
    records += [now.encode(), b"\x89PNGcover"]
    at, table = 78 + 8 * len(records), b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(76) + struct.pack(">H", len(records)) + table + b"".join(records)


#: Between which characters a record may end without parting a word.
_GAP = re.compile(r"(?<=[\u4e00-\u9fff])(?=[\u4e00-\u9fff])|(?= )")


def _cut(block: str) -> Iterator[str]:
    """A block in parts of about a record, cut where no word is parted."""
    at = 0
    while len(block) - at > RECORD:
        m = _GAP.search(block, at + RECORD)
        if m is None:
            break
        yield block[at : m.start()]
        at = m.start()
    yield block[at:]


def paged(title: str, author: str | None, publisher: str | None, tags: list[str], chapters: list[tuple[str, list[str]]], outlined: bool = True) -> bytes:
    """A paged file: a page for each chapter with its title and a line for each paragraph, parted by blank lines; an outline of the titles."""
    utf16 = lambda t: b"<" + ("﻿" + t).encode("utf-16-be", "replace").hex().encode() + b">"
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes) -> bytes:
        z = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z), z)

    root, pages = add(b""), add(b"")
    cmap = add(stream(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <ffff> <0000> endbfrange"))
    font = add(b"<< /Type /Font /Subtype /Type0 /ToUnicode %d 0 R >>" % cmap)
    kids = []
    for t, ps in chapters:
        draw = [b"BT /F1 12 Tf 14 TL 0 700 Td"]
        for i, p in enumerate([t, *ps]):
            draw.append((b"0 -30 Td " if i else b"") + b"<" + "".join(c for c in p if ord(c) < 0x10000).encode("utf-16-be", "replace").hex().encode() + b"> Tj")
        body = add(stream(b"\n".join([*draw, b"ET"])))
        picture = b"\xff\xd8" + b"picture of page %d" % len(kids)
        image = add(b"<< /Type /XObject /Subtype /Image /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(picture), picture))
        fonts = b" /Resources << /Font << /F1 %d 0 R >> /XObject << /Im1 %d 0 R >> >>" % (font, image) if len(kids) % 2 else b""  # the others inherit theirs
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R%s >>" % (pages, body, fonts)))
    objects[pages - 1] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 %d 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids), font)
    outline = b""
    if outlined and chapters:
        top, first = add(b""), len(objects) + 1
        for i, (t, _) in enumerate(chapters):
            after = b" /Next %d 0 R" % (first + i + 1) if i + 1 < len(chapters) else b""
            dest = b"" if i % 3 == 2 else b" /Dest [%d 0 R /Fit]" % kids[i]
            add(b"<< /Title %s /Parent %d 0 R%s%s >>" % (utf16(t), top, dest, after))
        objects[top - 1] = b"<< /Type /Outlines /First %d 0 R /Count %d >>" % (first, len(chapters))
        outline = b" /Outlines %d 0 R" % top
    objects[root - 1] = b"<< /Type /Catalog /Pages %d 0 R%s >>" % (pages, outline)
    known = [("Title", title), ("Author", author), ("Producer", publisher), ("Keywords", ", ".join(tags) or None)]
    info = add(b"<< " + b" ".join(b"/%s %s" % (k.encode(), utf16(v)) for k, v in known if v is not None) + b" >>")
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, root, info, at)
    return bytes(out)


def office(title: str, author: str | None, publisher: str | None, tags: list[str], chapters: list[tuple[str, list[str]]]) -> bytes:
    """An office document that holds nothing but its core properties."""
    out = io.BytesIO()
    fields = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in [("dc:title", title), ("dc:creator", author), ("dc:publisher", publisher), ("cp:keywords", "; ".join(tags) or None)] if v is not None)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="http://purl.org/dc/elements/1.1/">{fields}</cp:coreProperties>')
    return out.getvalue()


#: What stays of a value written into a file: no control characters and nothing that XML does not allow.
PLAIN = r"[\x00-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}\x{FEFF}]"


def books(documents: DataFrame, titles: DataFrame, write: Callable[[str, str | None, str | None, list[str], list[tuple[str, list[str]]]], bytes], ext: str) -> DataFrame:
    """(book_id, path, content BINARY, ext): each book with its texts in order of chapter, written as a file.

    documents: book_id, chapter_no, doc_id, text; titles: book_id, title, author, publisher, tags. Texts are cleaned of
    control characters but line feeds; a chapter is called after its place.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), r"\r\n?|[\x{85}\x{2028}\x{2029}\x0B\x0C]", "\n"), r"[\x00-\x09\x0B-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}\x{FEFF}]", " ")
    told = documents.filter("text IS NOT NULL AND book_id IS NOT NULL").select("book_id", F.struct("chapter_no", "doc_id", clean.alias("text")).alias("c"))
    per = told.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]).alias("texts"))  # a book's texts, which make one file
    plain = lambda c: F.nullif(X.utrim(F.regexp_replace(c, PLAIN, "")), F.lit(""))
    # titles that the readers find as they are: white space is folded there
    folded = lambda c: plain(F.regexp_replace(F.col(c), r"\s+", " ")).alias(c)
    rows = per.join(titles.select("book_id", folded("title"), folded("author"), folded("publisher"), "tags"), "book_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files = [write(t or "-", a, p, list(tags), [(f"Chapter {i + 1}", paragraphs(x)) for i, x in enumerate(texts)]) for t, a, p, tags, texts in zip(pdf["title"], pdf["author"], pdf["publisher"], pdf["tags"], pdf["texts"])]
            yield pd.DataFrame({"book_id": pdf["book_id"], "content": files})

    made = rows.select("book_id", "title", "author", "publisher", "tags", "texts").mapInPandas(run, f"book_id {documents.schema['book_id'].dataType.simpleString()}, content BINARY")
    return made.select("book_id", F.concat(F.lit("/l/"), F.col("book_id").cast("string"), F.lit(f".{ext}")).alias("path"), "content", F.lit(ext).alias("ext"))
