"""HTML texts: main content, chapters, typed elements, metadata. One pass of a Python worker per batch of texts.

The tree is built with the standard library's tokenizer, tolerant of void tags and of unclosed p, li, dt, dd, tr, td, th
and option; other repairs that browsers make are not attempted.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from librarium.schemas import ELEMENT

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select"}
STYLES = {"strong": "BOLD", "b": "BOLD", "em": "ITALIC", "i": "ITALIC", "u": "UNDERLINE", "s": "STRIKETHROUGH", "strike": "STRIKETHROUGH", "del": "STRIKETHROUGH", "code": "CODE", "a": "UNDERLINE"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Titles of texts and chapters without one.
BODY_TITLE, NTH = "正文", "第 {} 章"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.elements()))

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def raw(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append(" ")
            elif n.tag not in ("script", "style"):
                block = n.tag in BLOCK or n.tag in ("li", "tr", "td", "th")
                stack.extend([" "] * block)
                stack.extend(reversed(n.children))
                stack.extend([" "] * block)
        return "".join(out)

    def text(self) -> str:
        """White space folded, ends trimmed."""
        return fold(self.raw()).strip(" ")


def fold(text: str) -> str:
    out, white = [], False
    for c in text:
        if c in " \t\n\r\f\v":
            white = True
        else:
            if white:
                out.append(" ")
                white = False
            out.append(c)
    if white:
        out.append(" ")
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        close = _CLOSES.get(tag, set())
        if tag in BLOCK:
            close = close | {"p"}
        n = self.here
        while n.parent is not None and n.tag not in _SCOPE and close:
            if n.tag in close:
                self.here = n.parent
                break
            if n.tag in BLOCK and n.tag != "p":
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.here.tag == tag:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        n = self.here
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.here = n.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def body(root: Node) -> Node:
    return root.first("body") or root.first("html") or root


def main_content(root: Node) -> Node:
    """article, main, .content, .article, #content, else the body; the first of each."""
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: "content" in n.classes(), lambda n: "article" in n.classes(), lambda n: n.attrs.get("id") == "content"):
        hit = next((n for n in root.walk() if test(n)), None)
        if hit is not None:
            return hit
    return body(root)


def chapter_ranges(children: list[Node]) -> list[tuple[str, int, int, int]]:
    """(title, level, from, to) over direct children: h1 and h2 open chapters; what stands before the first belongs to none."""
    heads = [i for i, c in enumerate(children) if c.tag in ("h1", "h2")]
    if not heads:
        return [(BODY_TITLE, 0, 0, len(children))]
    ends = [*heads[1:], len(children)]
    return [(children[i].text() or NTH.format(k + 1), 0 if children[i].tag == "h1" else 1, i, e) for k, (i, e) in enumerate(zip(heads, ends))]


def element(type: str, **known) -> dict:
    e = dict.fromkeys(("level", "text", "language", "src", "alt", "width", "height", "ordered", "id", "spans", "items"))
    return e | {"type": type} | known


def span(text: str, styles=(), link=None, footnote=None, image=None) -> dict:
    return {"text": text, "styles": list(styles), "link": link, "footnoteId": footnote, "footnoteImage": image}


def _int(s: str) -> int | None:
    return int(s) if s.lstrip("+-").isdigit() else None


def inline(node: Node) -> list[dict]:
    """Spans below a node; styles of nested tags add up in order, links are inherited."""
    out: list[dict] = []
    stack = [(c, (), None) for c in reversed(node.children)]
    while stack:
        n, styles, link = stack.pop()
        if isinstance(n, str):
            t = fold(n)
            if t.strip():
                out.append(span(t, styles, link))
        elif n.tag == "br":
            out.append(span("\n", styles, link))
        else:
            if n.tag in STYLES:
                styles = (*styles, STYLES[n.tag])
            if n.tag == "a":
                link = n.attrs.get("href") or link
            stack.extend((c, styles, link) for c in reversed(n.children))
    return out


def elements(nodes: list[Node]) -> list[dict]:
    """Typed elements of nodes in order; containers are entered, tables and unknown tags are passed over."""
    out: list[dict] = []
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        t = n.tag
        if t in HEADINGS:
            if n.text():
                out.append(element("Heading", level=int(t[1]), text=n.text()))
        elif t in ("p", "blockquote"):
            spans = inline(n)
            if spans:
                out.append(element("Paragraph" if t == "p" else "Quote", spans=spans))
        elif t == "img":
            if n.attrs.get("src"):
                out.append(element("Image", src=n.attrs["src"], alt=n.attrs.get("alt", ""), width=_int(n.attrs.get("width", "")), height=_int(n.attrs.get("height", ""))))
        elif t == "pre" or (t == "code" and (n.parent is None or n.parent.tag != "pre")):
            code = n.first("code") if t == "pre" else None
            text = (code or n).text()
            language = next((c[len("language-") :] for c in code.classes() if c.startswith("language-")), None) if code is not None else None
            if text:
                out.append(element("Code", text=text, language=language))
        elif t in ("ul", "ol"):
            items = [{"spans": s} for li in n.elements() if li.tag == "li" and (s := inline(li))]
            if items:
                out.append(element("ListBlock", ordered=t == "ol", items=items))
        elif t == "hr":
            out.append(element("Divider"))
        elif t in ("div", "section", "article", "header", "footer", "nav", "aside"):
            stack.extend(reversed(n.elements()))
    return out


def documents(html: str) -> list[tuple[int, str, int, list[dict]]]:
    """(index, title, level, elements) of a text's chapters."""
    children = main_content(parse(html)).elements()
    out = []
    for i, (title, level, a, b) in enumerate(chapter_ranges(children)):
        out.append((i, title.replace("\x00", "").strip(), level, elements(children[a:b] if b > a else children)))
    return out


def html_chapters(df: DataFrame, key: str, html: str = "text") -> DataFrame:
    """(key, index, title, level, content) of every text. A null text gives no row, an empty one a chapter without elements."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *d) for k, t in zip(pdf[key], pdf[html]) if t is not None for d in documents(t)]
            yield pd.DataFrame(rows, columns=[key, "index", "title", "level", "content"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, index INT, title STRING, level INT, content ARRAY<{ELEMENT}>")


def _meta(root: Node) -> dict:
    def content(attr: str, name: str) -> list[str]:
        return [n.attrs.get("content", "") for n in root.walk() if n.tag == "meta" and n.attrs.get(attr) == name]

    def one(*pairs: tuple[str, str]) -> str | None:
        return next((v[0] for p in pairs if (v := content(*p)) and v[0]), None)

    title = root.first("title")
    tags: list[str] = []
    for words in content("name", "keywords")[:1]:
        for d in ";/|":
            words = words.replace(d, ",")
        tags += words.split(",")
    tags += content("property", "article:tag") + content("property", "og:article:tag")
    clean = dict.fromkeys(t for x in tags if 1 <= len(t := x.strip()) <= 50)
    return {
        "title": one(("property", "og:title"), ("name", "title")) or (title.text() if title is not None else "") or None,
        "author": one(("name", "author"), ("property", "article:author"), ("property", "og:article:author")),
        "description": one(("name", "description"), ("property", "og:description")),
        "publisher": one(("property", "og:site_name"), ("name", "publisher")),
        "tags": list(clean),
    }


def html_metadata(df: DataFrame, key: str, html: str = "text", name: str | None = None) -> DataFrame:
    """(key, title, author, description, publisher, tags): the first non-empty source of each; the title falls back to the file's name."""
    kind = df.schema[key].dataType.simpleString()
    src = df.select(key, html, (F.col(name) if name else F.lit(None).cast("string")).alias("_name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, n in zip(pdf[key], pdf[html], pdf["_name"]):
                if t is not None:
                    m = _meta(parse(t))
                    rows.append((k, m["title"] or n, m["author"], m["description"], m["publisher"], m["tags"]))
            yield pd.DataFrame(rows, columns=[key, "title", "author", "description", "publisher", "tags"])

    return src.mapInPandas(run, f"{key} {kind}, title STRING, author STRING, description STRING, publisher STRING, tags ARRAY<STRING>")
