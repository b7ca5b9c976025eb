"""Queries by name, and the SQL that each is held against. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from librarium.functions import text as X
from librarium.operators import catalog, multivalue, mutate, tagging
from librarium.plans import segment, toc
from librarium.session import fan_out, table
from librarium.sources import html, scan
from librarium.streaming import poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- catalogue


@query("""
SELECT b.id AS book_id, CAST(coalesce(sum(d.word_count), 0) AS DECIMAL(38,2)) AS words, CAST(coalesce(sum(d.image_count), 0) AS BIGINT) AS images,
       CAST(count(*) FILTER (WHERE d.in_toc) AS BIGINT) AS chapters
FROM books b LEFT JOIN book_documents d ON d.book_id = b.id GROUP BY b.id
""")
def book_stats(spark, sf):
    return catalog.book_stats(table(spark, sf, "books"), table(spark, sf, "book_documents"))


@query("SELECT id, title FROM books ORDER BY title, id LIMIT 100 OFFSET 50")
def books_page(spark, sf):
    return catalog.page(table(spark, sf, "books").select("id", "title"), ["title", "id"], 100, 50)


@query("SELECT source, id, title, CAST(row_number() OVER (PARTITION BY source ORDER BY title, id) AS BIGINT) AS place FROM books")
def books_of_source(spark, sf):
    return catalog.numbered_within(table(spark, sf, "books").select("source", "id", "title"), "source", ["title", "id"], "place")


@query("SELECT count(*) AS n FROM books")
def books_count(spark, sf):
    return table(spark, sf, "books").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM books GROUP BY source")
def books_by_source(spark, sf):
    return catalog.count_by(table(spark, sf, "books"), "source")


@query("SELECT book_id, count(*) AS n, count(*) FILTER (WHERE in_toc) AS n_toc FROM book_documents GROUP BY book_id")
def documents_by_book(spark, sf):
    return table(spark, sf, "book_documents").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_toc").alias("n_toc"))


@query("SELECT id, title, file_path FROM books WHERE id IN (SELECT book_id FROM book_metadata)")
def books_with_metadata(spark, sf):
    keys = table(spark, sf, "book_metadata").select(F.col("book_id").alias("id"))
    return catalog.lookup(table(spark, sf, "books").select("id", "title", "file_path"), keys, "id")


@query("SELECT book_id, doc_index, href FROM book_documents WHERE in_toc AND toc_level = 0")
def toc_documents(spark, sf):
    return catalog.find(table(spark, sf, "book_documents"), in_toc=True, toc_level=0).select("book_id", "doc_index", "href")


@query("SELECT id, parse_status FROM books WHERE NOT chapters_parsed AND (parse_status = 'pending' OR parse_status IS NULL)")
def unparsed_books(spark, sf):
    return catalog.unparsed(table(spark, sf, "books")).select("id", "parse_status")


@query("SELECT id FROM books WHERE NOT chapters_parsed AND (parse_status = 'pending' OR parse_status IS NULL) ORDER BY id LIMIT 5")
def parse_batch(spark, sf):
    return catalog.parse_batch(table(spark, sf, "books")).select("id")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM books WHERE NOT chapters_parsed AND (parse_status = 'pending' OR parse_status IS NULL) LIMIT 1000)")
def unparsed_count(spark, sf):
    return catalog.count_capped(catalog.unparsed(table(spark, sf, "books")), 1000)


@query("SELECT id FROM books WHERE NOT chapters_parsed AND parse_status IN ('failed', 'parsing')")
def retry_books(spark, sf):
    return catalog.retry(table(spark, sf, "books"), ["failed", "parsing"]).select("id")


@query(r"SELECT id FROM books WHERE author IS NULL OR NOT regexp_matches(author, '[^\s\x1C-\x1F\p{Z}]')")
def needs_metadata(spark, sf):
    return catalog.needs_metadata(table(spark, sf, "books")).select("id")


def _sessions(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'signup'")
    return mutate.new_sessions(e.select(F.col("event_id").alias("token"), "user_id", F.col("ts").alias("created_at")))


@query("""
SELECT e.event_id AS token, c.c_custkey AS user_id, c.c_name AS username, e.ts + INTERVAL 30 DAYS AS expires_at
FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'signup' AND e.ts + INTERVAL 30 DAYS > TIMESTAMP '2024-02-10 00:00:00'
""")
def active_sessions(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    now = F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'")
    return catalog.active_sessions(_sessions(spark, sf), users, now).select("token", "user_id", "username", "expires_at")


@query("SELECT c_custkey AS user_id, count(*) AS held_by FROM customer JOIN events ON user_id = c_custkey WHERE event_type = 'signup' GROUP BY c_custkey")
def blocked_deletes(spark, sf):
    return mutate.blocked_deletes(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _sessions(spark, sf))


@query("SELECT coalesce(bool_or(c_mktsegment = 'BUILDING'), false) AS found FROM customer")
def has_admin(spark, sf):
    return catalog.has_role(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("role")), "BUILDING")


@query("SELECT event_id AS token, user_id AS created_by FROM events WHERE event_type = 'click' AND NOT (value > 10)")
def open_invites(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'click'")
    return catalog.open_invites(e.select(F.col("event_id").alias("token"), F.col("user_id").alias("created_by"), (F.col("value") > 10).alias("used"))).select("token", "created_by")


@query("SELECT c_custkey, c_name FROM customer")
def users_public(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", "c_name", F.sha2("c_name", 256).alias("password"))
    return catalog.without_password(users)


# ---------------------------------------------------------------- reading

_PROGRESS = """
progress AS (
  SELECT user_id, book_id, arg_max(progress, (ts, event_id)) AS progress, arg_max(device_id, (ts, event_id)) FILTER (WHERE device_id IS NOT NULL) AS device_id, max(ts) AS last_read_at
  FROM progress_events WHERE progress IS NOT NULL GROUP BY user_id, book_id)
"""


def _progress(spark, sf):
    return mutate.upsert_progress(None, table(spark, sf, "progress_events").select("user_id", "book_id", "progress", "device_id", "ts", "event_id"))


#: Progress reported before this time makes the table, what comes after is the change.
_SPLIT = "2025-01-01 00:00:00"


def _progress_events(spark, sf):
    """Events with all fields of reading progress; which of them a device sends depends on the device."""
    e = table(spark, sf, "progress_events")
    page = F.when(F.col("device_id").like("phone%"), F.floor(F.col("progress") * 3).cast("int"))
    total = F.when(F.col("device_id").like("phone%"), F.lit(300))
    cfi = F.when(F.col("device_id").like("reader%"), F.concat(F.lit("/6/"), F.floor("progress").cast("string")))
    document = F.when(F.col("progress") > 50, F.concat_ws("-", F.col("book_id").cast("string"), F.lit("2")))
    return e.select("user_id", "book_id", "progress", page.alias("current_page"), total.alias("total_pages"), cfi.alias("cfi_location"), document.alias("document_id"), "device_id", "ts", "event_id")


_UPSERT = f"""
e AS (SELECT user_id, book_id, progress, CASE WHEN device_id LIKE 'phone%' THEN CAST(floor(progress * 3) AS INTEGER) END AS current_page, CASE WHEN device_id LIKE 'phone%' THEN 300 END AS total_pages,
  CASE WHEN device_id LIKE 'reader%' THEN '/6/' || CAST(floor(progress) AS BIGINT) END AS cfi_location, CASE WHEN progress > 50 THEN book_id || '-2' END AS document_id, device_id, ts, event_id FROM progress_events WHERE progress IS NOT NULL),
old AS (SELECT user_id, book_id, LAST_OF FROM e WHERE ts < TIMESTAMP '{_SPLIT}' GROUP BY user_id, book_id),
new AS (SELECT user_id, book_id, LAST_OF FROM e WHERE ts >= TIMESTAMP '{_SPLIT}' GROUP BY user_id, book_id)
""".replace("LAST_OF", "arg_max(progress, (ts, event_id)) AS progress, max(ts) AS last_read_at, " + ", ".join(f"arg_max({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in mutate.PROGRESS_KEPT))


@query(f"""
WITH {_UPSERT} SELECT user_id, book_id, coalesce(new.progress, old.progress) AS progress, CAST(coalesce(new.current_page, old.current_page, 0) AS INTEGER) AS current_page, CAST(coalesce(new.total_pages, old.total_pages) AS INTEGER) AS total_pages,
  coalesce(new.cfi_location, old.cfi_location) AS cfi_location, coalesce(new.document_id, old.document_id) AS document_id, coalesce(new.device_id, old.device_id) AS device_id, coalesce(new.last_read_at, old.last_read_at) AS last_read_at
FROM new FULL OUTER JOIN old USING (user_id, book_id)
""")
def reading_progress_upsert(spark, sf):
    e = _progress_events(spark, sf)
    early = F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{_SPLIT}'")
    current = mutate.upsert_progress(None, e.filter(early))
    return mutate.upsert_progress(current, e.filter(~early))


@query(f"""
WITH {_PROGRESS} SELECT p.user_id, p.book_id, b.title, b.author, p.progress, strftime(p.last_read_at, '%Y-%m-%dT%H:%M:%S') AS read_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_read_at DESC, book_id) AS n FROM progress) p JOIN books b ON b.id = p.book_id WHERE p.n <= 20
""")
def reading_history_topk(spark, sf):
    return catalog.history_item(catalog.history(_progress(spark, sf), table(spark, sf, "books"), 20))


@query(f"WITH {_PROGRESS} SELECT user_id, book_id, last_read_at FROM progress ORDER BY last_read_at DESC, user_id, book_id LIMIT 50")
def reading_recent(spark, sf):
    p = _progress(spark, sf).select("user_id", "book_id", "last_read_at")
    return catalog.page(p, [F.col("last_read_at").desc(), "user_id", "book_id"], 50)


def _bookmarks(spark, sf):
    e = table(spark, sf, "progress_events").filter("progress IS NOT NULL")
    new = e.select(
        F.col("event_id").alias("id"), "user_id", "book_id", F.floor("progress").cast("string").alias("position_value"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("color"), "device_id"
    ).distinct()
    return mutate.add_bookmarks(new.filter("device_id LIKE 'reader%'").drop("device_id").withColumn("color", F.lit("#00FF00")), new.filter("NOT coalesce(device_id LIKE 'reader%', false)").drop("device_id"))


_BOOKMARKS = """
sent AS (SELECT DISTINCT event_id AS id, user_id, book_id, CAST(CAST(floor(progress) AS BIGINT) AS VARCHAR) AS position_value, ts AS created_at, coalesce(device_id LIKE 'reader%', false) AS old FROM progress_events WHERE progress IS NOT NULL),
marks AS (SELECT id, user_id, book_id, position_value, created_at, '#00FF00' AS color, 1 AS n FROM sent WHERE old
  UNION ALL SELECT id, user_id, book_id, position_value, created_at, '#FFD700' AS color, row_number() OVER (PARTITION BY user_id, book_id, position_value ORDER BY created_at, id) AS n FROM sent
  WHERE NOT old AND (user_id, book_id, position_value) NOT IN (SELECT (user_id, book_id, position_value) FROM sent WHERE old))
"""


@query(f"WITH {_BOOKMARKS} SELECT id, user_id, book_id, position_value, created_at, color FROM marks WHERE n = 1")
def bookmarks_add(spark, sf):
    return _bookmarks(spark, sf)


@query(f"WITH {_BOOKMARKS} SELECT id, user_id, created_at FROM marks WHERE n = 1 ORDER BY created_at DESC, id LIMIT 100")
def bookmarks_page(spark, sf):
    return catalog.page(_bookmarks(spark, sf).select("id", "user_id", "created_at"), [F.col("created_at").desc(), "id"], 100)


@query(f"WITH {_BOOKMARKS} SELECT count(*) AS total FROM (SELECT id FROM marks WHERE n = 1 ORDER BY created_at DESC, id LIMIT 100)")
def bookmarks_total(spark, sf):
    """The total of a page of bookmarks is the size of the page."""
    return bookmarks_page(spark, sf).agg(F.count(F.lit(1)).alias("total"))


def _settings(spark, sf):
    """A settings table of the users seen on readers, and changes from all devices."""
    e = table(spark, sf, "progress_events")
    types = {"line_height": "decimal(3,2)", "letter_spacing": "decimal(3,2)"}
    kinds = {c: types.get(c, "int" if isinstance(v, int) else "string") for c, v in mutate.SETTINGS.items()}
    known = {"theme": F.lit("dark"), "font_size": F.lit(20)}
    current = e.filter("device_id LIKE 'reader-%'").select("user_id").distinct()
    current = current.select("user_id", *(known.get(c, F.lit(v)).cast(kinds[c]).alias(c) for c, v in mutate.SETTINGS.items()))
    sent = {"theme": F.substring_index("device_id", "-", 1), "brightness": F.floor("progress").cast("int"), "margin_vertical": F.when(F.col("progress") > 50, F.lit(60))}
    changes = e.select("user_id", "ts", "event_id", *(sent.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in mutate.SETTINGS))
    return current, changes


_SETTINGS_CURRENT = "cur AS (SELECT DISTINCT user_id, 'dark' AS theme, 20 AS font_size, 100 AS brightness, 40 AS margin_vertical FROM progress_events WHERE device_id LIKE 'reader-%')"
_SENT = "sent AS (SELECT user_id, ts, event_id, split_part(device_id, '-', 1) AS theme, CAST(floor(progress) AS INTEGER) AS brightness, CASE WHEN progress > 50 THEN 60 END AS margin_vertical FROM progress_events)"


@query(f"""
WITH {_SETTINGS_CURRENT}, {_SENT}, d AS (SELECT user_id, arg_max(theme, (ts, event_id)) FILTER (WHERE theme IS NOT NULL) AS theme, arg_max(brightness, (ts, event_id)) FILTER (WHERE brightness IS NOT NULL) AS brightness,
  arg_max(margin_vertical, (ts, event_id)) FILTER (WHERE margin_vertical IS NOT NULL) AS margin_vertical FROM sent GROUP BY user_id)
SELECT coalesce(d.user_id, cur.user_id) AS user_id, coalesce(d.theme, cur.theme, 'light') AS theme, CAST(coalesce(cur.font_size, 16) AS INTEGER) AS font_size,
  CAST(coalesce(d.brightness, cur.brightness, 100) AS INTEGER) AS brightness, CAST(coalesce(d.margin_vertical, cur.margin_vertical, 40) AS INTEGER) AS margin_vertical
FROM d FULL OUTER JOIN cur ON cur.user_id = d.user_id
""")
def settings_patch(spark, sf):
    current, changes = _settings(spark, sf)
    delta = mutate.fold(changes, ["user_id"], list(mutate.SETTINGS), F.struct("ts", "event_id"))
    return mutate.patch_settings(current, delta).select("user_id", "theme", "font_size", "brightness", "margin_vertical")


@query(f"""
WITH {_SETTINGS_CURRENT}, {_SENT}, d AS (SELECT * FROM (SELECT DISTINCT * FROM sent) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(d.user_id, cur.user_id) AS user_id, CASE WHEN d.user_id IS NULL THEN cur.theme ELSE coalesce(d.theme, 'light') END AS theme, CAST(CASE WHEN d.user_id IS NULL THEN cur.font_size ELSE 16 END AS INTEGER) AS font_size,
  CAST(CASE WHEN d.user_id IS NULL THEN cur.brightness ELSE coalesce(d.brightness, 100) END AS INTEGER) AS brightness,
  CAST(CASE WHEN d.user_id IS NULL THEN cur.margin_vertical ELSE coalesce(d.margin_vertical, 40) END AS INTEGER) AS margin_vertical
FROM d FULL OUTER JOIN cur ON cur.user_id = d.user_id
""")
def settings_put(spark, sf):
    current, changes = _settings(spark, sf)
    last = changes.groupBy("user_id").agg(F.max_by(F.struct(*mutate.SETTINGS), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")
    return mutate.put_settings(current, last).select("user_id", "theme", "font_size", "brightness", "margin_vertical")


@query("""
WITH cur AS (SELECT DISTINCT user_id FROM progress_events WHERE device_id LIKE 'reader-%')
SELECT u.user_id, CASE WHEN c.user_id IS NULL THEN 'light' ELSE 'dark' END AS theme, CAST(CASE WHEN c.user_id IS NULL THEN 16 ELSE 20 END AS INTEGER) AS font_size
FROM (SELECT DISTINCT user_id FROM progress_events) u LEFT JOIN cur c ON c.user_id = u.user_id
""")
def settings_of_users(spark, sf):
    users = table(spark, sf, "progress_events").select("user_id").distinct()
    return mutate.settings_of(users, _settings(spark, sf)[0]).select("user_id", "theme", "font_size")


# ---------------------------------------------------------------- changes


@query(r"""
WITH m AS (SELECT book_id, arg_max(title, (extracted_at, meta_id)) FILTER (WHERE title IS NOT NULL) AS title, arg_max(author, (extracted_at, meta_id)) FILTER (WHERE author IS NOT NULL) AS author,
  arg_max(publisher, (extracted_at, meta_id)) FILTER (WHERE publisher IS NOT NULL) AS publisher, arg_max(isbn, (extracted_at, meta_id)) FILTER (WHERE isbn IS NOT NULL) AS isbn,
  arg_max(description, (extracted_at, meta_id)) FILTER (WHERE description IS NOT NULL) AS description FROM book_metadata GROUP BY book_id)
SELECT b.id, coalesce(m.title, b.title) AS title, coalesce(m.author, b.author) AS author, coalesce(m.publisher, b.publisher) AS publisher, coalesce(m.isbn, b.isbn) AS isbn, left(m.description, 1000) AS description
FROM books b LEFT JOIN m ON m.book_id = b.id
""")
def metadata_update(spark, sf):
    return scan.apply_metadata(table(spark, sf, "books"), table(spark, sf, "book_metadata"))


@query("""
WITH d AS (SELECT book_id AS id, max(publisher) AS publisher FROM book_metadata GROUP BY book_id)
SELECT b.id, b.title, coalesce(d.publisher, b.publisher) AS publisher, CASE WHEN d.id IS NULL THEN b.updated_at ELSE TIMESTAMP '2025-01-01 00:00:00' END AS updated_at FROM books b LEFT JOIN d ON d.id = b.id
""")
def partial_update(spark, sf):
    delta = table(spark, sf, "book_metadata").groupBy(F.col("book_id").alias("id")).agg(F.max("publisher").alias("publisher"))
    books = table(spark, sf, "books").select("id", "title", "publisher", "updated_at")
    return mutate.partial_update(books, delta, "id", ["publisher"], F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"))


@query("SELECT d.book_id, d.doc_index FROM book_documents d JOIN books b ON b.id = d.book_id WHERE b.source <> 'club-upload'")
def cascade_delete_source(spark, sf):
    sources = table(spark, sf, "book_sources").select(F.col("source").alias("id"))
    tables = {
        "book_sources": mutate.delete(sources, F.col("id") == "club-upload"), "books": table(spark, sf, "books").select("id", F.col("source").alias("source_id")),
        "book_documents": table(spark, sf, "book_documents").select(F.concat_ws("-", "book_id", "doc_index").alias("id"), "book_id", "doc_index"),
    }
    return mutate.cascade(tables)["book_documents"].select("book_id", "doc_index")


@query("SELECT source_id AS id, source, NOT enabled AS enabled FROM book_sources")
def toggle_sources(spark, sf):
    s = table(spark, sf, "book_sources").select(F.col("source_id").alias("id"), "source", "enabled")
    return mutate.toggle(s, "enabled")


@query("SELECT source_id AS id, source, CAST(CASE WHEN enabled THEN source_id ELSE 100 END AS INTEGER) AS priority FROM book_sources")
def rule_priorities(spark, sf):
    rules = table(spark, sf, "book_sources").select(F.col("source_id").alias("id"), "source", F.col("source_id").alias("priority"), "enabled")
    return mutate.set_priorities(rules.drop("enabled"), rules.filter("NOT enabled").select("id", F.lit(100).alias("priority")))


@query("""
WITH n AS (SELECT book_id, count(*) AS n FROM book_documents GROUP BY book_id)
SELECT b.id, CASE WHEN n.n IS NULL THEN b.parse_status ELSE 'completed' END AS parse_status, CASE WHEN n.n IS NULL THEN b.chapters_parsed ELSE true END AS chapters_parsed,
  CAST(coalesce(n.n, b.chapters_count) AS INTEGER) AS chapters_count FROM books b LEFT JOIN n ON n.book_id = b.id
""")
def parse_completed(spark, sf):
    counts = table(spark, sf, "book_documents").groupBy(F.col("book_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = mutate.complete(table(spark, sf, "books"), counts, F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"))
    return out.select("id", "parse_status", "chapters_parsed", "chapters_count")


@query("""
SELECT id, CASE WHEN parse_status = 'failed' THEN 'pending' ELSE parse_status END AS parse_status, CASE WHEN parse_status = 'failed' THEN false ELSE chapters_parsed END AS chapters_parsed,
  CASE WHEN parse_status = 'failed' THEN 0 ELSE chapters_count END AS chapters_count FROM books
""")
def parse_reset(spark, sf):
    books = table(spark, sf, "books")
    return mutate.reset(books, books.filter("parse_status = 'failed'")).select("id", "parse_status", "chapters_parsed", "chapters_count")


@query("SELECT DISTINCT book_id, left(sha256(text), 16) || '.' || CASE WHEN text LIKE '<html%' THEN 'html' ELSE 'txt' END AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def content_store(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return mutate.store_images(d.select("book_id", F.col("text").cast("binary").alias("content"), F.when(F.startswith("text", F.lit("<html")), "html").otherwise("txt").alias("ext")))


# ---------------------------------------------------------------- tags

_TAGS = """
links0 AS (SELECT DISTINCT book_id, lower(trim(tag)) AS name FROM (SELECT book_id, unnest(tags) AS tag FROM book_metadata) WHERE tag IS NOT NULL AND trim(tag) <> ''),
tags AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM links0)),
links AS (SELECT l.book_id, t.id AS tag_id FROM links0 l JOIN tags t USING (name))
"""


def _tag_names(spark, sf):
    raw = table(spark, sf, "book_metadata").select("book_id", F.explode("tags").alias("tag")).filter("tag IS NOT NULL AND trim(tag) <> ''")
    return raw.select("book_id", F.lower(F.trim("tag")).alias("name")).distinct()


def _tag_tables(spark, sf):
    """(tags, links) built by find-or-create from an empty table."""
    from librarium.session import checkpoint

    names = _tag_names(spark, sf)
    none = spark.createDataFrame([], "id BIGINT, name STRING")
    tags = checkpoint(tagging.find_or_create(none, names))
    return tags, names.join(tags, "name").select("book_id", F.col("id").alias("tag_id"))


@query(f"WITH {_TAGS} SELECT CAST(id AS BIGINT) AS id, name FROM tags")
def tags_created(spark, sf):
    return _tag_tables(spark, sf)[0]


@query(f"WITH {_TAGS} SELECT CAST(t.id AS BIGINT) AS id, t.name, count(l.book_id) AS n FROM tags t LEFT JOIN links l ON l.tag_id = t.id GROUP BY t.id, t.name")
def tag_stats(spark, sf):
    return tagging.stats(*_tag_tables(spark, sf))


@query(f"WITH {_TAGS} SELECT l.book_id, t.name FROM links l JOIN tags t ON t.id = l.tag_id")
def tags_of_books(spark, sf):
    tags, links = _tag_tables(spark, sf)
    return tagging.of_books(links, tags)


@query(f"""
WITH {_TAGS}, s AS (SELECT book_id, CAST(sum(word_count) AS DECIMAL(38,2)) AS words FROM book_documents GROUP BY book_id)
SELECT CAST(l.tag_id AS BIGINT) AS tag_id, b.id AS book_id, b.title, CAST(coalesce(s.words, 0) AS DECIMAL(38,2)) AS words FROM links l JOIN books b ON b.id = l.book_id LEFT JOIN s ON s.book_id = b.id
""")
def books_of_tags(spark, sf):
    _, links = _tag_tables(spark, sf)
    books = table(spark, sf, "books")
    stats = catalog.book_stats(books, table(spark, sf, "book_documents")).select("book_id", "words")
    titled = books.select(F.col("id").alias("book_id"), "title").join(stats, "book_id")
    return catalog.books_of_tags(links, titled).select("tag_id", "book_id", "title", "words")


_MERGES = """m AS (SELECT s.id AS source, t.id AS target FROM tags s JOIN tags t ON s.name = '"' || t.name || '"')"""


def _merges(tags):
    t = tags.select(F.col("id").alias("target"), F.concat(F.lit('"'), "name", F.lit('"')).alias("name"))
    return tags.join(t, "name").select(F.col("id").alias("source"), "target")


@query(f"WITH {_TAGS}, {_MERGES} SELECT DISTINCT l.book_id, CAST(coalesce(m.target, l.tag_id) AS BIGINT) AS tag_id FROM links l LEFT JOIN m ON m.source = l.tag_id")
def tag_merge_links(spark, sf):
    tags, links = _tag_tables(spark, sf)
    return tagging.merge(tags, links, _merges(tags))[1]


@query(f"WITH {_TAGS}, {_MERGES} SELECT CAST(id AS BIGINT) AS id, name FROM tags WHERE id NOT IN (SELECT source FROM m)")
def tag_merge_tags(spark, sf):
    tags, links = _tag_tables(spark, sf)
    return tagging.merge(tags, links, _merges(tags))[0]


_FILE_TAGS = r"""
ft AS (SELECT DISTINCT id AS book_id, tag AS name FROM (SELECT id, unnest(list_transform(string_split(list_extract(parts, -1), ','), lambda x: regexp_replace(x, '^[\s\x1C-\x1F\p{Z}]+|[\s\x1C-\x1F\p{Z}]+$', '', 'g'))) AS tag
  FROM (SELECT id, string_split(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', ''), '-') AS parts FROM books) WHERE len(parts) >= 2) WHERE length(tag) BETWEEN 1 AND 50)
"""


@query(f"WITH {_FILE_TAGS} SELECT book_id, name FROM ft")
def filename_tags(spark, sf):
    return tagging.auto_tags(table(spark, sf, "books"))


@query(f"WITH {_TAGS}, {_FILE_TAGS} SELECT count(DISTINCT name) AS n FROM ft WHERE name NOT IN (SELECT name FROM tags)")
def autotag_created(spark, sf):
    tags, links = _tag_tables(spark, sf)
    after, _ = tagging.apply_auto_tags(table(spark, sf, "books"), tags, links)
    return tagging.created_by(tags, after)


@query(f"WITH {_TAGS}, {_FILE_TAGS} SELECT book_id, name FROM ft UNION SELECT l.book_id, t.name FROM links l JOIN tags t ON t.id = l.tag_id")
def autotag_links(spark, sf):
    tags, links = _tag_tables(spark, sf)
    after, linked = tagging.apply_auto_tags(table(spark, sf, "books"), tags, links)
    return tagging.of_books(linked, after)


@query(r"""
SELECT meta_id, elem, tag FROM (SELECT DISTINCT meta_id, elem, regexp_replace(x, '^[\s\x1C-\x1F\p{Z}]+|[\s\x1C-\x1F\p{Z}]+$', '', 'g') AS tag FROM
  (SELECT meta_id, elem, unnest(regexp_split_to_array(t, '[,;/|]')) AS x FROM (SELECT meta_id, unnest(tags) AS t, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS elem FROM book_metadata) WHERE t IS NOT NULL))
WHERE length(tag) BETWEEN 1 AND 50
""")
def keyword_tags(spark, sf):
    e = table(spark, sf, "book_metadata").select("meta_id", F.posexplode("tags").alias("elem", "t")).filter("t IS NOT NULL")
    return e.select("meta_id", "elem", F.explode(X.keyword_tags(F.col("t"))).alias("tag"))


# ---------------------------------------------------------------- scans

_FOUND = """
found AS (SELECT b.source, b.file_path FROM books b JOIN book_sources s ON s.source = b.source WHERE s.enabled AND coalesce(b.parse_status, '') <> 'failed'
  UNION ALL SELECT source, file_path || '.epub' FROM books WHERE parse_status = 'failed')
"""


def _found(spark, sf):
    """Files of a re-scan: those of enabled sources without the failed ones, which now lie under another name."""
    books = table(spark, sf, "books").select("source", "file_path", "parse_status")
    on = table(spark, sf, "book_sources").filter("enabled").select("source")
    there = books.join(F.broadcast(on), "source", "left_semi").filter("coalesce(parse_status, '') <> 'failed'").select("source", "file_path")
    return there.unionByName(books.filter("parse_status = 'failed'").select("source", F.concat("file_path", F.lit(".epub")).alias("file_path")))


@query(f"WITH {_FOUND} SELECT source, file_path FROM found WHERE file_path NOT IN (SELECT file_path FROM books)")
def scan_new(spark, sf):
    return scan.new_files(_found(spark, sf), table(spark, sf, "books")).select("source", "file_path")


@query(f"WITH {_FOUND} SELECT source, file_path FROM found WHERE file_path IN (SELECT file_path FROM books)")
def scan_known(spark, sf):
    return scan.known_files(_found(spark, sf), table(spark, sf, "books")).select("source", "file_path")


@query(f"WITH {_FOUND} SELECT id, source FROM books WHERE source IN (SELECT source FROM found) AND file_path NOT IN (SELECT file_path FROM found)")
def scan_missing(spark, sf):
    return scan.missing_books(table(spark, sf, "books").select("id", "source", "file_path"), _found(spark, sf)).select("id", "source")


@query(f"""
WITH {_FOUND}, g AS (SELECT source, count(*) AS deleted FROM books WHERE source IN (SELECT source FROM found) AND file_path NOT IN (SELECT file_path FROM found) GROUP BY source)
SELECT f.source, count(*) AS found, count(*) AS imported, coalesce(any_value(g.deleted), 0) AS deleted FROM found f LEFT JOIN g ON g.source = f.source GROUP BY f.source
""")
def scan_counts_full(spark, sf):
    return scan.scan_counts(_found(spark, sf), table(spark, sf, "books").select("source", "file_path"), True)


@query(f"""
WITH {_FOUND} SELECT source, count(*) AS found, count(*) FILTER (WHERE file_path NOT IN (SELECT file_path FROM books)) AS imported, CAST(0 AS BIGINT) AS deleted FROM found GROUP BY source
""")
def scan_counts_incremental(spark, sf):
    return scan.scan_counts(_found(spark, sf), table(spark, sf, "books").select("file_path"), False)


@query(f"""
WITH {_FOUND}, g AS (SELECT count(*) AS deleted FROM books WHERE source IN (SELECT source FROM found) AND file_path NOT IN (SELECT file_path FROM found))
SELECT count(*) AS found, count(*) AS imported, (SELECT deleted FROM g) AS deleted FROM found
""")
def scan_totals(spark, sf):
    """The counts of a full scan added up over all sources."""
    counts = scan.scan_counts(_found(spark, sf), table(spark, sf, "books").select("source", "file_path"), True)
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "imported", "deleted")))


@query("SELECT source_id, CASE WHEN root_path IS NULL THEN 'missing' WHEN NOT enabled THEN 'disabled' ELSE 'ready' END AS state FROM book_sources")
def scan_state(spark, sf):
    return scan.source_state(table(spark, sf, "book_sources"))


@query(r"""
SELECT id, ext, CASE WHEN ext IN ('epub', 'pdf') THEN ext WHEN ext = 'txt' THEN 'text' WHEN ext IN ('mobi', 'azw3') THEN 'mobi' WHEN ext = 'html' THEN 'html' END AS parser
FROM (SELECT id, lower(regexp_extract(file_path, '\.([^.]*)$', 1)) AS ext FROM books) WHERE ext IN ('txt', 'epub', 'mobi', 'azw3', 'pdf', 'html')
""")
def scan_formats(spark, sf):
    f = table(spark, sf, "books").select("id", X.extension(X.file_name(F.col("file_path"))).alias("ext"))
    return scan.by_parser(scan.supported(f)).select("id", "ext", "parser")


@query(rf"""
WITH {_FOUND} SELECT (SELECT max(id) FROM books) + row_number() OVER (ORDER BY file_path) AS id, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') AS title, 'epub' AS book_format, file_path, 'pending' AS parse_status
FROM found WHERE file_path NOT IN (SELECT file_path FROM books)
""")
def insert_books(spark, sf):
    new = scan.as_books(scan.new_files(_found(spark, sf), table(spark, sf, "books")))
    cols = ["id", "title", "book_format", "file_path", "parse_status"]
    return mutate.insert(table(spark, sf, "books").select(cols), new.select(cols[1:]), "id", ["file_path"]).join(new.select("file_path"), "file_path", "left_semi").select(cols)


# ---------------------------------------------------------------- texts

_WIDE = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def _sql_words(c: str) -> str:
    rest = f"regexp_replace({c}, '{_WIDE}', '', 'g')"
    return f"CAST(coalesce(length({c}) - length({rest}) + len(list_filter(regexp_split_to_array({rest}, '\\s+'), lambda w: regexp_matches(regexp_replace(w, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '[\\p{{L}}\\p{{Nd}}]'))), 0) AS BIGINT)"


@query(f"SELECT doc_id, {_sql_words('text')} AS words FROM documents")
def word_count(spark, sf):
    return fan_out(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.word_count(F.col("text")).alias("words"))


@query(r"""
SELECT doc_id, CAST(coalesce(length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', '', 'g'))
  + len(list_filter(regexp_split_to_array(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, '^[a-zA-Z]+$'))), 0) AS BIGINT) AS words FROM documents
""")
def word_count_plain(spark, sf):
    return fan_out(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.word_count_plain(F.col("text")).alias("words"))


@query(r"SELECT id, regexp_replace(replace(title, chr(0), ''), '^[\s\x1C-\x1F\p{Z}]+|[\s\x1C-\x1F\p{Z}]+$', '', 'g') AS title FROM books")
def clean_titles(spark, sf):
    return table(spark, sf, "books").select("id", X.clean_title(F.col("title")).alias("title"))


@query(r"""
SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS folder, regexp_extract(file_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
  lower(regexp_extract(file_path, '\.([^.]*)$', 1)) AS ext FROM books
""")
def file_parts(spark, sf):
    p = F.col("file_path")
    n = X.file_name(p)
    return table(spark, sf, "books").select("id", X.directory(p).alias("folder"), n.alias("name"), X.stem(n).alias("stem"), X.extension(n).alias("ext"))


@query("""
SELECT book_id, doc_index, CASE WHEN href IS NOT NULL THEN CASE doc_index % 7 WHEN 0 THEN 'images/' || doc_index || '.png' WHEN 1 THEN 'up.png' WHEN 2 THEN 'text/a/b.png' WHEN 3 THEN '/abs/./x.png' WHEN 4 THEN 'http://h/../x.png' WHEN 5 THEN 'text/q.png' ELSE href END END AS path FROM book_documents
""")
def path_normalize(spark, sf):
    """Links of chapters of all shapes: up, above the root, with dots and empty parts, absolute, on the web, with a step back."""
    links = [F.concat(F.lit("../images/"), F.col("doc_index").cast("string"), F.lit(".png")), *map(F.lit, ("../../../up.png", "./a//b.png", "/abs/./x.png", "http://h/../x.png", "p/../q.png")), F.substring_index("href", "/", -1)]
    link = F.element_at(F.array(*links), (F.col("doc_index") % 7 + 1).cast("int"))
    return table(spark, sf, "book_documents").select("book_id", "doc_index", F.when(F.col("href").isNotNull(), X.normalize_path(link, F.col("href"))).alias("path"))


@query("SELECT book_id, doc_index, CASE WHEN href IS NULL THEN NULL WHEN starts_with(href, 'http') THEN href ELSE 'http://localhost:8080/' || href END AS url FROM book_documents")
def absolute_urls(spark, sf):
    base = F.concat(X.base_url(F.lit("http"), F.lit("localhost"), F.lit(8080)), F.lit("/"))
    return table(spark, sf, "book_documents").select("book_id", "doc_index", X.absolute_url(F.col("href"), base).alias("url"))


_ENDINGS = ["jpg", "JPEG", "png", "gif", "webp", "Svg", "bmp", "epub", "none"]


@query(r"""
SELECT id, CASE id % 9 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'image/svg+xml' WHEN 6 THEN 'image/bmp' ELSE 'application/octet-stream' END AS media_type,
  abs(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(title, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS BIGINT)) % 10 AS colour
FROM books
""")
def media_and_colour(spark, sf):
    """Media types of stored files of all kinds, and the colour of a book's title."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("id") % 9 + 1).cast("int"))
    name = F.concat(F.lit("pages."), F.col("id").cast("string"), F.lit("."), ending)
    return table(spark, sf, "books").select("id", X.media_type(X.extension(name)).alias("media_type"), X.colour_bucket(F.col("title")).cast("bigint").alias("colour"))


_HEADER = "|".join(f"(?:{p})" for p in segment.FALLBACK)
_CHAPTERS = rf"""
lines AS (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '(\r\n|\n|\r)', '\1' || chr(1), 'g'), chr(1))) AS line, generate_subscripts(string_split(regexp_replace(text, '(\r\n|\n|\r)', '\1' || chr(1), 'g'), chr(1)), 1) AS n
  FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT doc_id, text, n, regexp_replace(line, '^[\s\x1C-\x1F\p{{Z}}]+|[\s\x1C-\x1F\p{{Z}}]+$', '', 'g') AS line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
heads AS (SELECT doc_id, text, n, line AS title, pos FROM trimmed WHERE regexp_full_match(line, '{_HEADER}')
  UNION ALL SELECT doc_id, text, 0, '全文', 0 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM trimmed WHERE regexp_full_match(line, '{_HEADER}'))),
chapters AS (SELECT doc_id, text, CAST(row_number() OVER w - 1 AS INTEGER) AS index, title, CAST(pos AS INTEGER) AS start_pos, CAST(coalesce(lead(pos) OVER w, length(text)) AS INTEGER) AS end_pos FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
bodies AS (SELECT *, substring(text, start_pos + 1, end_pos - start_pos) AS body FROM chapters)
"""


@query(f"WITH {_CHAPTERS} SELECT doc_id, index, title, start_pos, end_pos FROM chapters")
def chapters_segment(spark, sf):
    return segment.chapters(fan_out(table(spark, sf, "documents").select("doc_id", "text")))


@query(rf"""
WITH {_CHAPTERS} SELECT doc_id, index, title, {_sql_words('body')} AS words, CAST(0 AS BIGINT) AS images FROM bodies
""")
def chapter_stats(spark, sf):
    return poll.parsed(fan_out(table(spark, sf, "documents").select("doc_id", "text")))


@query(rf"""
WITH {_CHAPTERS}, parts AS (SELECT doc_id, index, title, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\x1C-\x1F\p{{Z}}]+|[\s\x1C-\x1F\p{{Z}}]+$', '', 'g')), lambda p: p <> '') AS parts FROM bodies)
SELECT doc_id, index, CAST(len(parts) AS BIGINT) AS elements, coalesce(starts_with(parts[1], title), false) AS heading,
  CAST(list_sum(list_transform(parts, lambda p: len(string_split(p, chr(10))))) - CASE WHEN coalesce(starts_with(parts[1], title), false) THEN len(string_split(parts[1], chr(10))) ELSE 0 END AS BIGINT) AS spans
FROM parts WHERE len(parts) > 0
""")
def chapter_elements(spark, sf):
    bodies = segment.with_body(fan_out(table(spark, sf, "documents").select("doc_id", "text")), "doc_id")
    rows = bodies.select("doc_id", "index", segment.text_elements(F.col("body"), F.col("title")).alias("e")).filter(F.size("e") > 0)
    spans = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.size(x["spans"]), F.lit(0)))
    return rows.select("doc_id", "index", F.size("e").cast("bigint").alias("elements"), (F.col("e")[0]["type"] == "Heading").alias("heading"), spans.alias("spans"))


@query("""
WITH d AS (SELECT doc_id, CAST(ceil(n_chars / 100.0) AS BIGINT) AS pages FROM documents WHERE n_chars > 0), s AS (SELECT *, CASE WHEN pages <= 50 THEN 10 WHEN pages <= 200 THEN 20 ELSE 30 END AS size FROM d),
p AS (SELECT doc_id, pages, size, unnest(generate_series(0, pages - 1, size)) AS start_page FROM s)
SELECT doc_id, CAST(start_page // size AS INTEGER) AS index, start_page, least(start_page + size - 1, pages - 1) AS end_page, '第 ' || (start_page // size + 1) || ' 部分 (页 ' || (start_page + 1) || '-' || least(start_page + size, pages) || ')' AS title FROM p
""")
def page_parts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.ceil(F.col("n_chars") / 100).alias("pages"))
    return segment.page_parts(d).select("doc_id", "index", "start_page", "end_page", "title")


@query("""
WITH n AS (SELECT book_id, CAST(ceil(sum(word_count) / 250) AS BIGINT) AS pages FROM book_documents GROUP BY book_id HAVING sum(word_count) > 0),
r AS (SELECT d.book_id, d.doc_index AS index, 'Chapter ' || (d.doc_index + 1) AS title, CASE WHEN d.in_toc THEN d.doc_index * (n.pages // 10) ELSE 0 END AS start_page, n.pages FROM book_documents d JOIN n ON n.book_id = d.book_id WHERE d.toc_level = 0)
SELECT book_id, index, title, start_page, coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY index) - 1, pages - 1) AS end_page FROM r
""")
def outline_chapters(spark, sf):
    d = table(spark, sf, "book_documents")
    pages = d.groupBy("book_id").agg(F.ceil(F.sum("word_count") / 250).cast("bigint").alias("pages")).filter("pages > 0")
    items = d.filter("toc_level = 0").select("book_id", F.col("doc_index").alias("index"), F.lit(None).cast("string").alias("title"), F.col("in_toc").alias("has_target"))
    return segment.outline_chapters(items, pages)


# ---------------------------------------------------------------- contents


@query("SELECT book_id, doc_index, lag(doc_index) OVER w AS prev, lead(doc_index) OVER w AS next FROM book_documents WINDOW w AS (PARTITION BY book_id ORDER BY doc_index)")
def chapter_nav(spark, sf):
    return toc.navigation(table(spark, sf, "book_documents").select("book_id", "doc_index"))


@query("""
WITH t AS (SELECT book_id, doc_index, toc_level FROM book_documents WHERE in_toc), r AS (SELECT book_id, min(doc_index) AS root FROM t WHERE toc_level = 0 GROUP BY book_id),
k AS (SELECT t.*, coalesce(t.doc_index >= r.root, false) AS kept FROM t LEFT JOIN r ON r.book_id = t.book_id)
SELECT c.book_id, CAST(c.doc_index AS INTEGER) AS index, CAST(c.toc_level AS INTEGER) AS level, CAST(max(p.doc_index) AS INTEGER) AS parent_index, c.kept
FROM k c LEFT JOIN k p ON c.kept AND p.kept AND p.book_id = c.book_id AND p.doc_index < c.doc_index AND p.toc_level < c.toc_level GROUP BY c.book_id, c.doc_index, c.toc_level, c.kept
""")
def toc_tree(spark, sf):
    return toc.tree(table(spark, sf, "book_documents"))


@query("""
SELECT b.id AS book_id, b.title, string_agg(d.doc_index, ',' ORDER BY d.doc_index) AS spine, coalesce(string_agg(d.doc_index, ',' ORDER BY d.doc_index) FILTER (WHERE d.in_toc), '') AS toc
FROM books b JOIN book_documents d ON d.book_id = b.id GROUP BY b.id, b.title
""")
def manifest(spark, sf):
    m = toc.manifest(table(spark, sf, "books"), table(spark, sf, "book_documents"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return m.select("book_id", "title", text("spine"), text("toc"))


@query("SELECT book_id, doc_index, '第' || (doc_index + 1) || '章' AS title, toc_level FROM book_documents WHERE in_toc")
def chapters_listed(spark, sf):
    return toc.chapters_listed(table(spark, sf, "book_documents"))


@query("""
WITH last AS (SELECT book_id, href, max(doc_index) AS index FROM book_documents WHERE href IS NOT NULL GROUP BY book_id, href),
e AS (SELECT d.book_id, l.index, d.toc_level, row_number() OVER (PARTITION BY d.book_id, l.index ORDER BY d.doc_index) AS n FROM book_documents d JOIN last l ON l.book_id = d.book_id AND l.href = d.href WHERE d.in_toc)
SELECT d.book_id, d.doc_index AS index, e.index IS NOT NULL AS in_toc, CAST(coalesce(e.toc_level, 0) AS INTEGER) AS level FROM book_documents d LEFT JOIN e ON e.book_id = d.book_id AND e.index = d.doc_index AND e.n = 1
""")
def match_toc(spark, sf):
    d = table(spark, sf, "book_documents").withColumnRenamed("doc_index", "index")
    entries = d.filter("in_toc").select("book_id", F.col("index").alias("seq"), F.concat("href", F.lit("#top")).alias("href"), F.lit(None).cast("string").alias("title"), F.col("toc_level").alias("level"))
    return toc.match_toc(d.select("book_id", "index", "href"), entries).select("book_id", "index", "in_toc", "level")


# ---------------------------------------------------------------- HTML


def _pages(spark, sf):
    return fan_out(table(spark, sf, "documents").select("doc_id", "text").filter(F.col("text").rlike("(?i)<(html|body|p|h1)[ >]")))


@query()
def html_chapters(spark, sf):
    c = html.html_chapters(_pages(spark, sf), "doc_id")
    return c.select("doc_id", "index", "title", "level", F.size("content").alias("elements"), segment.element_words(F.col("content")).alias("words"), segment.element_images(F.col("content")).alias("images"))


@query()
def html_elements(spark, sf):
    c = html.html_chapters(_pages(spark, sf), "doc_id").select("doc_id", "index", F.posexplode("content").alias("pos", "e"))
    text = F.coalesce("e.text", F.array_join(F.transform("e.spans", lambda s: s["text"]), ""), F.lit(""))
    return c.select("doc_id", "index", "pos", F.col("e.type").alias("type"), F.col("e.level").alias("level"), text.alias("text"))


@query()
def html_metadata(spark, sf):
    return html.html_metadata(_pages(spark, sf), "doc_id")


# ---------------------------------------------------------------- packed values


def _packed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Elements of book_metadata.tags and sections of books.file_path as (field, row_id, elem, text); the known values."""
    tags = multivalue.elements_of(fan_out(table(spark, sf, "book_metadata").select("meta_id", "tags")), "meta_id")
    section = multivalue.file_name_section(F.col("file_path"))
    paths = table(spark, sf, "books").select(F.lit("file_path").alias("field"), F.col("id").alias("row_id"), F.lit(0).alias("elem"), section.alias("text")).filter("text IS NOT NULL")
    return tags.select(F.lit("tags").alias("field"), "row_id", "elem", "text").unionByName(paths), multivalue.dictionary(tags)


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    packed, known = _packed(spark, sf)
    return multivalue.split_values(packed, known=known, keep=["field", "row_id", "elem"]).distinct()


@query()
def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """All values, those of elements that hold one alone included."""
    packed, known = _packed(spark, sf)
    return multivalue.split_values(packed, known=known, keep=["field", "row_id", "elem"], everything=True)


@query()
def p5_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    tags = multivalue.elements_of(table(spark, sf, "book_metadata").select("meta_id", "tags"), "meta_id")
    return multivalue.dictionary(tags)


from librarium.plans import registry_changes, registry_files  # noqa: E402, F401 - they register their queries
