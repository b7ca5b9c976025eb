"""Queries over files: books written as containers, pages, record files and paged files, and read back. The SQL knows only the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from librarium.functions import text as X
from librarium.plans import segment
from librarium.plans.registry import _sql_words, query
from librarium.session import fan_out, table
from librarium.sources import epub, html, mobi, parsers, pdf, samples


def _titles(spark, sf):
    """(book_id, title, author, publisher, tags): titles of the catalogue, single tags of all extractions in order."""
    plain = lambda c: F.nullif(X.utrim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), samples.PLAIN, "")), F.lit(""))
    meta = table(spark, sf, "book_metadata").select("book_id", F.explode("tags").alias("tag")).select("book_id", plain(F.col("tag")).alias("tag"))
    meta = meta.filter(r"tag IS NOT NULL AND NOT tag RLIKE '[,;/|]' AND length(tag) <= 50").groupBy("book_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    books = table(spark, sf, "books").select(F.col("id").alias("book_id"), "title", "author", "publisher").join(meta, "book_id", "left")
    return books.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def _page(title, author, publisher, tags, chapters):
    return samples.page(title, chapters, {"author": author, "publisher": publisher, "keywords": ", ".join(tags)})


WRITERS = {"epub": samples.container, "html": _page, "mobi": samples.record_file, "pdf": samples.paged, "docx": samples.office}


def _files(spark, sf, ext):
    documents = table(spark, sf, "documents").select("book_id", "chapter_no", "doc_id", "text")
    return samples.books(documents, _titles(spark, sf), WRITERS[ext], ext)


_CLEAN = r"regexp_replace(regexp_replace(text, '\r\n?|[\x{85}\x{2028}\x{2029}\x0B\x0C]', chr(10), 'g'), '[\x00-\x09\x0B-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}\x{FEFF}]', ' ', 'g')"
_PLAIN_SQL = r"nullif(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[\x00-\x1F\x7F-\x9F\x{{FFFE}}\x{{FFFF}}\x{{FEFF}}]', '', 'g'), '^[\s\x1C-\x1F\p{{Z}}]+|[\s\x1C-\x1F\p{{Z}}]+$', '', 'g'), '')"
#: Chapters of the written books: place, number of chapters, paragraphs, words.
_TEXTS = rf"""
t0 AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_no, doc_id) - 1 AS INTEGER) AS index, CAST(count(*) OVER (PARTITION BY book_id) AS INTEGER) AS n, {_CLEAN} AS text
  FROM documents WHERE text IS NOT NULL AND book_id IN (SELECT id FROM books)),
t1 AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x1C-\x1F\p{{Z}}]+|[\s\x1C-\x1F\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS ps FROM t0),
t2 AS (SELECT book_id, index, n, ps, array_to_string(ps, chr(10)) AS plain FROM t1),
texts AS (SELECT book_id, index, n, ps, CAST(len(ps) AS INTEGER) AS paragraphs, {_sql_words('plain')} AS words FROM t2)
"""
_META = rf"""
tag0 AS (SELECT DISTINCT book_id, {_PLAIN_SQL.format('tag')} AS tag FROM (SELECT book_id, unnest(tags) AS tag FROM book_metadata)),
tag1 AS (SELECT book_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM tag0 WHERE tag IS NOT NULL AND NOT regexp_matches(tag, '[,;/|]') AND length(tag) <= 50 GROUP BY book_id),
meta AS (SELECT b.id AS book_id, coalesce({_PLAIN_SQL.format('title')}, '-') AS title, {_PLAIN_SQL.format('author')} AS author, {_PLAIN_SQL.format('publisher')} AS publisher, coalesce(tags, '') AS tags
  FROM books b LEFT JOIN tag1 ON tag1.book_id = b.id WHERE b.id IN (SELECT book_id FROM documents WHERE text IS NOT NULL))
"""


def _counted(df, *columns):
    """Chapters with the numbers of their elements, words and images."""
    c = F.col("content")
    return df.select("book_id", *columns, F.size(c).alias("elements"), segment.element_words(c).alias("words"), segment.element_images(c).alias("images"))


def _told(df, *more):
    return df.select("book_id", "title", "author", "publisher", F.array_join("tags", "|").alias("tags"), *more)


@query(f"""
WITH {_TEXTS} SELECT book_id, index, 'text/c' || index || '.xhtml' AS href, index < n - 1 AS in_toc, CASE WHEN index < n - 1 THEN 'Chapter ' || (index + 1) END AS title, CASE WHEN index < n - 1 THEN index % 2 ELSE 0 END AS level,
  paragraphs + 4 AS elements, words + 4 AS words, CAST(1 AS BIGINT) AS images FROM texts
""")
def epub_documents(spark, sf):
    """Reading order, contents, chapters and elements of e-book containers."""
    return _counted(epub.epub_documents(_files(spark, sf, "epub"), "book_id"), "index", "href", "in_toc", "title", "level")


@query(f"WITH {_TEXTS} SELECT book_id, index, 'note|x' AS notes, 'n1' AS footnote, 'a note' AS note, 'img/i' || index || '.png' AS image FROM texts")
def epub_notes(spark, sf):
    """Links to notes, notes and images of chapters, with paths resolved against the chapter."""
    rows = epub.epub_documents(_files(spark, sf, "epub"), "book_id").select("book_id", "index", "content")
    first = F.try_element_at("content", F.lit(2))
    last = F.try_element_at("content", F.lit(-1))
    image = F.try_element_at(F.filter("content", lambda e: e["type"] == "Image"), F.lit(1))["src"]
    return rows.select("book_id", "index", F.array_join(F.transform(first["spans"], lambda s: s["text"]), "|").alias("notes"), F.try_element_at(first["spans"], F.lit(2))["footnoteId"].alias("footnote"), F.array_join(F.transform(last["spans"], lambda s: s["text"]), "").alias("note"), image.alias("image"))


@query(f"WITH {_META} SELECT *, 'OEBPS/img/cover.png' AS cover FROM meta")
def epub_metadata(spark, sf):
    return _told(epub.epub_metadata(_files(spark, sf, "epub"), "book_id"), "cover")


@query(f"""
WITH {_TEXTS} SELECT book_id, 'img/i' || index || '.png' AS path, CAST(8 AS BIGINT) AS size FROM texts UNION ALL SELECT DISTINCT book_id, 'img/cover.png', CAST(9 AS BIGINT) FROM texts
""")
def epub_resources(spark, sf):
    return epub.epub_resources(_files(spark, sf, "epub"), "book_id").select("book_id", "path", F.length("content").cast("bigint").alias("size"))


@query(f"WITH {_TEXTS} SELECT book_id, index, 'Chapter ' || (index + 1) AS title, CASE WHEN index = 0 THEN 0 ELSE 1 END AS level, paragraphs + 2 AS elements, words + 2 AS words, CAST(1 AS BIGINT) AS images FROM texts")
def html_file_chapters(spark, sf):
    """Main content, chapter ranges and elements of web pages."""
    pages = _files(spark, sf, "html").select("book_id", F.col("content").cast("string").alias("text"))
    return _counted(html.html_chapters(pages, "book_id"), "index", "title", "level")


@query(f"WITH {_META} SELECT * FROM meta")
def html_file_metadata(spark, sf):
    return _told(html.html_metadata(_files(spark, sf, "html").select("book_id", F.col("content").cast("string").alias("text")), "book_id"))


#: Characters of a book as the record file holds it; with too few it counts as empty.
_ESCAPED = "length(x) + 4 * (length(x) - length(replace(x, '&', ''))) + 3 * (length(x) - length(replace(replace(x, '<', ''), '>', ''))) + 5 * (length(x) - length(replace(replace(x, '\"', ''), '''', '')))"
_LONG = f"""
long AS (SELECT book_id FROM texts GROUP BY book_id HAVING sum(length('<h1>Chapter ' || (index + 1) || '</h1>') + coalesce(list_sum(list_transform(ps, lambda x: 7 + {_ESCAPED})), 0)) > 1000)
"""


@query(f"WITH {_TEXTS}, {_LONG} SELECT book_id, index, 'Chapter ' || (index + 1) AS title, 0 AS level, paragraphs + 2 AS elements, words + 4 AS words, CAST(0 AS BIGINT) AS images FROM texts WHERE book_id IN (SELECT book_id FROM long)")
def mobi_documents(spark, sf):
    """Records, chapters and elements of record files."""
    return _counted(mobi.mobi_documents(_files(spark, sf, "mobi"), "book_id"), "index", "title", "level")


@query(f"WITH {_META} SELECT * FROM meta")
def mobi_metadata(spark, sf):
    return _told(mobi.mobi_metadata(_files(spark, sf, "mobi"), "book_id"))


@query("SELECT DISTINCT book_id, 'png' AS ext, CAST(9 AS BIGINT) AS size FROM documents WHERE text IS NOT NULL AND book_id IN (SELECT id FROM books)")
def mobi_covers(spark, sf):
    return mobi.mobi_covers(_files(spark, sf, "mobi"), "book_id").select("book_id", "ext", F.length("content").cast("bigint").alias("size"))


@query(f"WITH {_TEXTS} SELECT book_id, index AS page, words + 2 AS words FROM texts")
def pdf_pages(spark, sf):
    """Text of the pages of paged files."""
    return pdf.pdf_pages(_files(spark, sf, "pdf"), "book_id").select("book_id", "page", X.word_count(F.col("text")).alias("words"))


_RANGES = """
starts AS (SELECT *, CASE WHEN index % 3 = 2 THEN 0 ELSE index * (n // 10) END AS start_page FROM texts),
ranges AS (SELECT book_id, index, n, CAST(start_page AS INTEGER) AS start_page, CAST(coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY index) - 1, n - 1) AS INTEGER) AS end_page FROM starts)
"""


@query(f"""
WITH {_TEXTS}, {_RANGES} SELECT r.book_id, r.index, 'Chapter ' || (r.index + 1) AS title, r.start_page, r.end_page, CAST(coalesce(sum(t.words + 2), 0) AS BIGINT) AS words
FROM ranges r LEFT JOIN texts t ON t.book_id = r.book_id AND t.index BETWEEN r.start_page AND r.end_page GROUP BY ALL
""")
def pdf_chapters(spark, sf):
    """Chapters by the outline, with the pages they are taken to cover and their text."""
    c = pdf.pdf_chapters(_files(spark, sf, "pdf"), "book_id")
    return c.select("book_id", "index", "title", "start_page", "end_page", X.word_count(F.col("text")).alias("words"))


@query(f"WITH {_META} SELECT * FROM meta")
def pdf_metadata(spark, sf):
    return _told(pdf.pdf_metadata(_files(spark, sf, "pdf"), "book_id"))


@query(f"WITH {_TEXTS} SELECT book_id, index AS page, 'Im1' AS name, 'picture of page ' || index AS picture FROM texts WHERE index % 2 = 1")
def pdf_images(spark, sf):
    """Images of the pages of paged files."""
    i = pdf.pdf_images(_files(spark, sf, "pdf"), "book_id")
    return i.select("book_id", "page", "name", F.expr("CAST(substring(content, 3, length(content)) AS STRING)").alias("picture"))


@query(f"WITH {_META} SELECT * FROM meta")
def generic_metadata(spark, sf):
    """Metadata of office documents, by the extractor for all other files."""
    return _told(parsers.metadata(_files(spark, sf, "docx")))


def _mixed(spark, sf):
    """A lot of files of several kinds: some of no known kind, some containers cut off in the middle."""
    kinds = ["epub", "html", "mobi", "pdf"]
    files = None
    for i, ext in enumerate([*kinds, "xyz"]):
        f = _files(spark, sf, "docx" if ext == "xyz" else ext).filter(F.col("book_id") % 5 == i).withColumn("ext", F.lit(ext))
        files = f if files is None else files.unionByName(f)
    half = F.expr("substring(content, 1, length(content) div 2)")
    return files.withColumn("content", F.when((F.col("ext") == "epub") & (F.col("book_id") % 10 == 0), half).otherwise(F.col("content")))


@query(f"""
WITH {_TEXTS}, {_LONG} SELECT book_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS parse_status, CASE WHEN ok THEN n ELSE 0 END AS chapters_count FROM
  (SELECT book_id, n, book_id % 5 IN (1, 3) OR (book_id % 5 = 0 AND book_id % 10 <> 0) OR (book_id % 5 = 2 AND book_id IN (SELECT book_id FROM long)) AS ok FROM texts WHERE index = 0)
""")
def parse_mixed(spark, sf):
    """State and number of chapters of a lot of files of all kinds, read in one stage; damaged and unknown ones fail."""
    files = _mixed(spark, sf)
    return parsers.statuses(files, parsers.documents(files))


@query(f"""
WITH {_META} SELECT book_id, CASE WHEN known THEN title ELSE CAST(book_id AS VARCHAR) END AS title, CASE WHEN known THEN author END AS author, CASE WHEN known THEN publisher END AS publisher, CASE WHEN known THEN tags ELSE '' END AS tags
FROM (SELECT *, book_id % 10 <> 0 AS known FROM meta)
""")
def metadata_mixed(spark, sf):
    """Metadata of a mixed lot; where an extractor finds nothing the file's name is the title."""
    return _told(parsers.metadata(_mixed(spark, sf)))
