"""E-book containers (ZIP): package, reading order, table of contents, metadata, resources, chapters. A file is opened once."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from librarium.schemas import ELEMENT
from librarium.sources import html as H

IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp")
DEFAULT_PACKAGE = "EPUB/content.opf"
DEPTH = 50
#: What reading a container or one of its members may raise: damaged, cut off, encrypted or oddly packed files.
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, OSError)
_NOTE_ID = re.compile(r"(?:n|fn|note|footnote)\d+", re.I)


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _kids(e, name: str) -> list:
    return [c for c in e if _local(c) == name]


def _all(e, name: str) -> list:
    return [c for c in e.iter() if _local(c) == name]


def resolve(path: str, chapter: str) -> str:
    """A link of a chapter as a path inside the container; absolute paths and web addresses stay."""
    if path.startswith(("/", "http://", "https://")):
        return path
    done: list[str] = []
    for part in posixpath.join(posixpath.dirname(chapter), path).split("/"):
        if part == "..":
            done = done[:-1]
        elif part not in ("", "."):
            done.append(part)
    return "/".join(done)


class Package:
    """What the package file of a container says. Parts that are missing or broken are empty."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.path = self._package_path()
        self.base = self.path.rsplit("/", 1)[0] if "/" in self.path else ""
        self.opf = self._xml(self.path)
        self.items: dict[str, tuple[str, str]] = {}
        self.toc_href, self.spine = None, []
        if self.opf is None:
            return
        for m in _all(self.opf, "manifest")[:1]:
            for i in _kids(m, "item"):
                ident, href, kind = i.get("id"), i.get("href"), i.get("media-type", "")
                if ident is not None and href is not None:
                    self.items[ident] = (href, kind)
                    if kind == "application/x-dtbncx+xml" or ident == "ncx":
                        self.toc_href = href
        for s in _all(self.opf, "spine")[:1]:
            self.spine = [self.items[r][0] for i in _kids(s, "itemref") if (r := i.get("idref")) in self.items]

    def _xml(self, name: str):
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (KeyError, ElementTree.ParseError):
            return None

    def _package_path(self) -> str:
        root = self._xml("META-INF/container.xml")
        files = _all(root, "rootfile") if root is not None else []
        return (files[0].get("full-path") if files else None) or DEFAULT_PACKAGE

    def full(self, href: str) -> str:
        return f"{self.base}/{href}" if self.base else href

    def entries(self) -> dict[int, tuple[str | None, int]]:
        """Document index to (title, level): entries of the contents in their order, the first for each document."""
        ncx = self._xml(self.full(self.toc_href)) if self.toc_href else None
        maps = _all(ncx, "navMap") if ncx is not None else []
        if not maps:
            return {}
        place = {h: i for i, h in enumerate(self.spine)}  # the last place of an href
        out: dict[int, tuple[str | None, int]] = {}
        todo = [(p, 0) for p in reversed(_kids(maps[0], "navPoint"))]
        while todo:
            point, level = todo.pop()
            if level > DEPTH:
                continue
            label, target = _kids(point, "navLabel")[:1], _kids(point, "content")[:1]
            texts = _all(label[0], "text") if label else []
            title = "".join(texts[0].itertext()).strip() if texts else None
            src = target[0].get("src") if target else None
            index = place.get(src.split("#")[0]) if src is not None else None
            if index is not None:
                out.setdefault(index, (title, level))
            todo.extend((p, level + 1) for p in reversed(_kids(point, "navPoint")))
        return out

    def metadata(self) -> dict:
        def first(name: str) -> str | None:
            return next((t for e in (_all(self.opf, name) if self.opf is not None else []) if (t := "".join(e.itertext()).strip())), None)

        subjects = [t for e in (_all(self.opf, "subject") if self.opf is not None else []) if (t := "".join(e.itertext()).strip()) and len(t) <= 50]
        return {"title": first("title"), "author": first("creator"), "publisher": first("publisher"), "description": first("description"), "isbn": None, "tags": list(dict.fromkeys(subjects)), "cover": self.cover()}

    def cover(self) -> str | None:
        """Path of the cover: named by meta, else an image item whose id speaks of a cover, else a usual place."""
        if self.opf is not None:
            named = next((m.get("content") for m in _all(self.opf, "meta") if m.get("name") == "cover"), None)
            for href, _ in [self.items[named]] if named in self.items else []:
                if self.full(href) in self.names:
                    return self.full(href)
            for ident, (href, kind) in self.items.items():
                if "cover" in ident.lower() and kind.startswith("image/") and self.full(href) in self.names:
                    return self.full(href)
        usual = [f"{d}cover.{e}" for d in ("", "images/", "OEBPS/", "OEBPS/images/", "OPS/images/") for e in ("jpg", "png")]
        return next((p for p in usual if p in self.names), None)

    def resources(self) -> list[tuple[str, bytes]]:
        """(path relative to the package, content) of the images."""
        head = f"{self.base}/" if self.base else ""
        return [(n[len(head) :] if head and n.startswith(head) else n, self.zip.read(n)) for n in sorted(self.names) if n.rsplit(".", 1)[-1].lower() in IMAGES]

    def chapter(self, href: str) -> list[dict]:
        try:
            return content_elements(self.zip.read(self.full(href)).decode("utf-8", "replace"), href)
        except KeyError:
            return []


# ---------------------------------------------------------------- content


def is_note_link(a: H.Node) -> bool:
    kind, css, href = a.attrs.get("epub:type", ""), a.attrs.get("class", ""), a.attrs.get("href", "")
    if "noteref" in kind or "footnote" in kind or "note" in css or href.startswith(("#n", "#fn")):
        return True
    img = a.first("img")
    return img is not None and not a.text() and "note" in img.attrs.get("src", "")


def note_target(a: H.Node) -> str | None:
    href = a.attrs.get("href", "")
    return href.split("#", 1)[1] if "#" in href else a.attrs.get("id") or None


def is_note_image(img: H.Node) -> bool:
    return any("note" in img.attrs.get(k, "").lower() for k in ("src", "alt", "class"))


def is_note_container(n: H.Node) -> bool:
    kind = n.attrs.get("epub:type", "")
    return "footnote" in kind or "rearnote" in kind or "footnote" in n.attrs.get("class", "").lower()


def note_definition(n: H.Node) -> str | None:
    ident = n.attrs.get("id", "")
    if is_note_container(n):
        return ident or None
    return ident if _NOTE_ID.fullmatch(ident) else None


class _Content:
    """Elements of one chapter; unlabelled notes are numbered from 1."""

    def __init__(self, href: str):
        self.href, self.notes, self.out = href, 0, []

    def inline(self, node: H.Node) -> list[dict]:
        spans: list[dict] = []
        for c in node.children:
            if isinstance(c, str):
                if t := H.fold(c).strip():
                    spans.append(H.span(t))
                continue
            if c.tag == "a" and is_note_link(c):
                target = note_target(c)
                if target is not None:
                    img = c.first("img")
                    src = img.attrs.get("src") if img is not None else None
                    label = c.text()
                    if not label:
                        self.notes += 1
                        label = f"[{self.notes}]"
                    spans.append(H.span(label, ["BOLD"], None, target, resolve(src, self.href) if src else None))
                continue
            if c.tag == "img" and is_note_image(c):
                continue
            if c.tag in ("sup", "sub"):
                spans += self.inline(c)
            elif t := c.text():
                spans.append(H.span(t, [H.STYLES[c.tag]] if c.tag in H.STYLES else [], c.attrs.get("href", "") if c.tag == "a" else None))
        return spans

    def add(self, kind: str, node: H.Node, **known) -> None:
        spans = self.inline(node)
        if spans:
            self.out.append(H.element(kind, spans=spans, **known))

    def image(self, img: H.Node) -> None:
        if img.attrs.get("src") and not is_note_image(img):
            self.out.append(H.element("Image", src=resolve(img.attrs["src"], self.href), alt=img.attrs.get("alt", "")))

    def block(self, n: H.Node) -> None:
        t = n.tag
        if t in H.HEADINGS:
            self.out.append(H.element("Heading", level=int(t[1]), text=n.text()))
        elif t == "p":
            ident = note_definition(n)
            if ident is not None:
                return self.add("Footnote", n, id=ident)
            for img in n.walk():
                if img.tag == "img":
                    self.image(img)
            self.add("Paragraph", n)
        elif t == "img":
            self.image(n)
        elif t == "blockquote":
            self.add("Quote", n)
        elif t in ("pre", "code"):
            self.out.append(H.element("Code", text=n.text()))
        elif t in ("ul", "ol"):
            items = [{"spans": self.inline(li)} for li in n.elements() if li.tag == "li"]
            if items:
                self.out.append(H.element("ListBlock", ordered=t == "ol", items=items))
        elif t == "hr":
            self.out.append(H.element("Divider"))
        elif t == "aside":
            self.aside(n)
        elif t in ("div", "section", "article"):
            self.container(n)
        return None

    def aside(self, n: H.Node) -> None:
        if not is_note_container(n):
            for c in n.elements():
                self.block(c)
            return
        with_id = [li for li in n.walk() if li is not n and li.tag == "li" and "id" in li.attrs]
        for holder in with_id or [n]:
            if holder.attrs.get("id"):
                self.add("Footnote", holder, id=holder.attrs["id"])

    def container(self, n: H.Node) -> None:
        ident = note_definition(n)
        if ident is not None:
            self.add("Footnote", n, id=ident)
        elif n.first("br") is not None and any(isinstance(c, str) and c.strip() for c in n.children):
            self.lines(n)
        else:
            for c in n.elements():
                self.block(c)

    def lines(self, n: H.Node) -> None:
        """Text with line breaks: a paragraph for each line, images between them."""
        line: list[str] = []

        def flush() -> None:
            if t := "".join(line).strip():
                self.out.append(H.element("Paragraph", spans=[H.span(t)]))
            line.clear()

        for c in n.children:
            if isinstance(c, str):
                line.append(H.fold(c))
            elif c.tag == "br":
                flush()
            elif c.tag == "img":
                if not is_note_image(c):
                    flush()
                    self.image(c)
            else:
                line.append(c.text())
        flush()


def content_elements(text: str, href: str) -> list[dict]:
    c = _Content(href)
    for n in H.body(H.parse(text)).elements():
        c.block(n)
    return c.out


# ---------------------------------------------------------------- tables


def _each(df: DataFrame, key: str, content: str, columns: list[str], schema: str, rows, whole: bool = False) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[content]):
                if data is None:
                    continue
                try:
                    out += [(k, *r) for r in (rows(bytes(data)) if whole else rows(Package(bytes(data))))]
                except DAMAGED:
                    continue
            yield pd.DataFrame(out, columns=[key, *columns])

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, {schema}")


def documents(data: bytes) -> Iterator[tuple]:
    """(index, href, in_toc, title, level, elements) of a container in reading order."""
    p = Package(data)
    toc = p.entries()
    for i, href in enumerate(p.spine):
        title, level = toc.get(i, (None, 0))
        yield i, href, i in toc, title, level, p.chapter(href)


def epub_documents(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, index, href, in_toc, title, level, content) of every document in reading order. Without a table of contents none is in it. Files that are no containers, or damaged ones, give no rows."""
    columns = ["index", "href", "in_toc", "title", "level", "content"]
    return _each(df, key, content, columns, f"index INT, href STRING, in_toc BOOLEAN, title STRING, level INT, content ARRAY<{ELEMENT}>", documents, whole=True)


def epub_metadata(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    names = ["title", "author", "publisher", "description", "isbn", "tags", "cover"]
    schema = "title STRING, author STRING, publisher STRING, description STRING, isbn STRING, tags ARRAY<STRING>, cover STRING"
    return _each(df, key, content, names, schema, lambda p: [tuple(p.metadata()[n] for n in names)])


def epub_resources(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    return _each(df, key, content, ["path", "content"], "path STRING, content BINARY", lambda p: p.resources())
