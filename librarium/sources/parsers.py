"""Files to documents and metadata: one registry of parsers by format, one plan and one scan for a mixed lot of files.

A parser is a function from the bytes of a file to rows (index, title, level, in_toc, elements, raw). Elements are those
of `schemas.ELEMENT`; where they are None, `raw` is text that the plan itself turns into elements. An extractor is a
function from bytes to a dictionary of METADATA or None. Others can be registered; a format without a parser, and a file
that its parser cannot read, leave their book failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from librarium.functions import text as X
from librarium.plans import segment
from librarium.schemas import ELEMENT
from librarium.sources import epub, generic, html, mobi, pdf, scan

Parser = Callable[[bytes], Iterable[tuple]]
Extractor = Callable[[bytes], "dict | None"]
COLUMNS = ["index", "title", "level", "in_toc", "content"]
METADATA = ["title", "author", "publisher", "description", "isbn", "tags"]
#: Rows that a task gathers before it hands them on.
GATHER = 256


def _text_rows(data: bytes) -> Iterable[tuple]:
    """The text of the file; chapters are found by the plan."""
    yield None, None, None, None, None, data.decode("utf-8", "replace")


def _html_rows(data: bytes) -> Iterable[tuple]:
    for index, title, level, content in html.documents(data.decode("utf-8", "replace")):
        yield index, title, level, True, content, None


def _epub_rows(data: bytes) -> Iterable[tuple]:
    for index, _, in_toc, title, level, content in epub.documents(data):
        yield index, title, level, in_toc, content, None


def _mobi_rows(data: bytes) -> Iterable[tuple]:
    for index, title, level, content in mobi.documents(data):
        yield index, title, level, True, content, None


def _pdf_rows(data: bytes) -> Iterable[tuple]:
    for index, title, _, _, text in pdf.chapters(data):
        yield index, title, 0, True, None, text


def _html_metadata(data: bytes) -> dict | None:
    return html._meta(html.parse(data.decode("utf-8", "replace"))) | {"isbn": None}


PARSERS: dict[str, Parser] = {"text": _text_rows, "html": _html_rows, "epub": _epub_rows, "mobi": _mobi_rows, "pdf": _pdf_rows}
EXTRACTORS: dict[str, Extractor] = {"html": _html_metadata, "epub": lambda d: epub.Package(d).metadata(), "mobi": mobi.metadata, "pdf": pdf.metadata, "generic": generic.metadata}


def register(name: str, parser: Parser | None = None, extractor: Extractor | None = None) -> None:
    """Add or replace the parser and the extractor of a kind of file."""
    if parser is not None:
        PARSERS[name] = parser
    if extractor is not None:
        EXTRACTORS[name] = extractor


def _by_file(df: DataFrame, key: str, kind: str, functions: dict[str, Callable], columns: list[str], schema: str) -> DataFrame:
    """Rows of each file, by the function for its kind. One stage for all formats, so the bytes of a file are read once; a file that cannot be read gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            out: list[tuple] = []
            for k, name, data in zip(pdf_[key], pdf_[kind], pdf_["content"]):
                f = functions.get(name)
                if f is None or data is None:
                    continue
                try:
                    out += [(k, name, *r) for r in f(bytes(data))]
                except Exception:  # noqa: BLE001 - a damaged file must not end the job; its book is left failed
                    continue
                if len(out) >= GATHER:
                    yield pd.DataFrame(out, columns=[key, "_kind", *columns])
                    out = []
            yield pd.DataFrame(out, columns=[key, "_kind", *columns])

    return df.select(key, kind, "content").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, _kind STRING, {schema}")


def text_documents(raw: Column, pattern: str | None = None) -> Column:
    """Chapters of a text with their elements, as an array inside the row."""
    body = lambda c: F.substring(raw, c["start_pos"] + 1, c["end_pos"] - c["start_pos"])
    one = lambda c: F.struct(c["index"].alias("index"), c["title"].alias("title"), F.lit(0).alias("level"), F.lit(True).alias("in_toc"), segment.text_elements(body(c), c["title"]).alias("content"))
    return F.transform(segment.chapter_structs(raw, pattern), one)


def documents(files: DataFrame, key: str = "book_id", ext: str = "ext", pattern: str | None = None) -> DataFrame:
    """(key, index, title, level, in_toc, content, word_count, image_count) of all files. files: key, content BINARY, ext.

    One Python stage opens every file once; texts are cut into chapters and elements by built-in expressions after it.
    """
    routed = scan.by_parser(files, ext).filter("parser IS NOT NULL")
    rows = _by_file(routed, key, "parser", dict(PARSERS), [*COLUMNS, "_raw"], f"index INT, title STRING, level INT, in_toc BOOLEAN, content ARRAY<{ELEMENT}>, _raw STRING")
    made = F.when(F.col("_raw").isNotNull(), segment.pdf_elements(F.col("_raw"), F.col("title"))).otherwise(F.col("content"))
    single = F.array(F.struct("index", "title", "level", "in_toc", made.alias("content")))
    several = F.col("index").isNull() & F.col("_raw").isNotNull()
    out = rows.select(key, F.inline(F.when(several, text_documents(F.col("_raw"), pattern)).otherwise(single)))
    return out.withColumns({"title": X.clean_title(F.col("title")), "word_count": segment.element_words(F.col("content")), "image_count": segment.element_images(F.col("content"))})


def metadata(files: DataFrame, key: str = "book_id", ext: str = "ext", path: str = "path") -> DataFrame:
    """(key, title, author, publisher, description, isbn, tags) of all files; a missing title is the file's name.

    One extractor is asked for each file, by its format; where it finds neither title nor author, the name of the file
    stands in as a whole (`scan.choose_metadata`).
    """
    functions = {k: (lambda d, f=f: [tuple(m[c] for c in METADATA)] if (m := f(d)) else []) for k, f in EXTRACTORS.items()}
    functions |= {k: (lambda d: []) for k in ("text",) if k not in EXTRACTORS}
    routed = scan.by_parser(files, ext)
    found = _by_file(routed, key, "extractor", functions, METADATA, "title STRING, author STRING, publisher STRING, description STRING, isbn STRING, tags ARRAY<STRING>")
    name = X.stem(X.file_name(F.col(path)))
    null = lambda t: F.lit(None).cast(t)
    fallback = F.struct(name.alias("title"), *(null("array<string>" if c == "tags" else "string").alias(c) for c in METADATA[1:]))
    rows = files.select(key, fallback.alias("_second")).join(found.select(key, F.struct(*METADATA).alias("_first")), key, "left")
    chosen = rows.select(key, scan.choose_metadata(F.col("_first"), F.col("_second")).alias("m"), F.col("_second.title").alias("_name"))
    return chosen.select(key, F.coalesce("m.title", "_name").alias("title"), "m.author", "m.publisher", X.description(F.col("m.description")).alias("description"), "m.isbn", F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"))


def statuses(files: DataFrame, parsed: DataFrame, key: str = "book_id", ext: str = "ext") -> DataFrame:
    """(key, parse_status, chapters_count): completed with the number of documents, or failed where there is none."""
    n = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = files.select(key).join(n, key, "left")
    return rows.select(key, F.when(F.col("n").isNull(), "failed").otherwise("completed").alias("parse_status"), F.coalesce("n", F.lit(0)).cast("int").alias("chapters_count"))
