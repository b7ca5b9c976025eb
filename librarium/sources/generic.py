"""Metadata of files of any other kind: what office documents, open documents and XML books say of themselves.

Only the named parts of a container are opened; other files give nothing. Files above MOST_BYTES are not looked into.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

#: Largest file that is looked into.
MOST_BYTES = 10 << 20
#: Parts of containers that hold metadata.
PARTS = ("docProps/core.xml", "meta.xml")
# For each field the names of elements it is taken from, the first that says something.
FIELDS = {
    "title": ("title", "book-title"), "author": ("creator", "initial-creator", "author", "lastModifiedBy"), "publisher": ("publisher", "company"), "description": ("description", "subject", "annotation"),
}
TAGS = ("keywords", "keyword", "category")


def _texts(root) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for e in root.iter():
        if isinstance(e.tag, str) and (t := re.sub(r"[ \t\n\r\f\v]+", " ", "".join(e.itertext())).strip()):
            out.setdefault(e.tag.rsplit("}", 1)[-1], []).append(t)
    return out


def metadata(data: bytes) -> dict | None:
    """Title, author, publisher, description and tags; none without a title or an author."""
    if len(data) > MOST_BYTES:
        return None
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            part = next((p for p in PARTS if p in z.namelist()), None)
            data = z.read(part) if part else b""
    elif not data.lstrip().startswith(b"<?xml"):
        return None
    try:
        texts = _texts(ElementTree.fromstring(data))
    except ElementTree.ParseError:
        return None
    out = {field: next((v for n in names for v in texts.get(n, [])), None) for field, names in FIELDS.items()}
    if out["title"] is None and out["author"] is None:
        return None
    tags = [t for n in TAGS for v in texts.get(n, []) for x in re.split("[;,/|]", v) if 1 <= len(t := x.strip()) <= 50]
    return out | {"isbn": None, "tags": list(dict.fromkeys(tags))}
