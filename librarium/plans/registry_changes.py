"""Queries over changes, rules, lookups, listings and exchange formats, each with its SQL."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from librarium.functions import content as C
from librarium.functions import text as X
from librarium.operators import catalog, mutate
from librarium.plans import segment
from librarium.plans.registry import _BOOKMARKS, _CHAPTERS, _bookmarks, _sql_words, query
from librarium.session import fan_out, shared_folder, table
from librarium.sources import html, scan
from librarium.streaming import poll

# ---------------------------------------------------------------- lookups and listings


@query("SELECT book_id, doc_index, href FROM book_documents WHERE book_id = 1010 AND doc_index = 0")
def document_by_place(spark, sf):
    return catalog.find(table(spark, sf, "book_documents"), book_id=1010, doc_index=0).select("book_id", "doc_index", "href")


@query("SELECT p.user_id, p.book_id, p.progress FROM progress_events p WHERE p.event_id % 97 = 0 AND (user_id, book_id) IN (SELECT (user_id, book_id) FROM progress_events WHERE device_id LIKE 'reader%')")
def progress_by_user_and_book(spark, sf):
    """Lookups by a pair of keys, for a table of them."""
    e = table(spark, sf, "progress_events")
    return catalog.lookup(e.filter("event_id % 97 = 0"), e.filter("device_id LIKE 'reader%'"), ["user_id", "book_id"]).select("user_id", "book_id", "progress")


_ENTRIES = r"""
entries AS (SELECT DISTINCT split_part(substring(b.file_path, length(s.root_path) + 2), '/', 1) AS name, contains(substring(b.file_path, length(s.root_path) + 2), '/') AS is_dir
  FROM books b JOIN book_sources s ON s.source = b.source WHERE s.root_path IS NOT NULL AND starts_with(b.file_path, s.root_path || '/'))
"""


@query(f"WITH {_ENTRIES} SELECT name, is_dir FROM entries ORDER BY is_dir DESC, lower(name), name LIMIT 40")
def folder_listing(spark, sf):
    """One level of the folders of all sources: folders first, then by name."""
    roots = table(spark, sf, "book_sources").filter("root_path IS NOT NULL").select("source", "root_path")
    books = table(spark, sf, "books").select("source", "file_path").join(F.broadcast(roots), "source").filter(F.startswith("file_path", F.concat("root_path", F.lit("/"))))
    rest = F.expr("substring(file_path, length(root_path) + 2, length(file_path))")
    entries = books.select(F.substring_index(rest, "/", 1).alias("name"), (F.instr(rest, "/") > 0).alias("is_dir")).distinct()
    return catalog.listing(entries).limit(40)


@query("SELECT file_path AS path, parse_status IS NOT NULL AS \"exists\", id % 2 = 0 AS is_dir, CASE WHEN id % 3 > 0 THEN id % 3 = 1 END AS can_read, parse_status IS NOT NULL AND id % 2 = 0 AND id % 3 = 1 AS valid FROM books")
def path_states(spark, sf):
    files = table(spark, sf, "books").select(F.col("file_path").alias("path"), F.col("parse_status").isNotNull().alias("exists"), (F.col("id") % 2 == 0).alias("is_dir"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("can_read"))
    return catalog.path_state(files)


@query("SELECT event_id, CASE lower(event_type) WHEN 'click' THEN 'admin' WHEN 'view' THEN 'user' ELSE 'guest' END AS role FROM events")
def known_roles(spark, sf):
    """Unknown roles are guests."""
    role = F.when(F.col("event_type") == "click", "ADMIN").when(F.col("event_type") == "view", "User").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", catalog.known_role(role).alias("role"))


# ---------------------------------------------------------------- inserts and updates


@query("""
WITH b AS (SELECT id AS book_id FROM books WHERE id NOT IN (SELECT book_id FROM book_documents)), d AS (SELECT CAST(row_number() OVER (ORDER BY book_id, doc_index) AS BIGINT) AS id, book_id, doc_index, href, word_count FROM book_documents)
SELECT * FROM d UNION ALL SELECT CAST((SELECT count(*) FROM d) + row_number() OVER (ORDER BY book_id) AS BIGINT), book_id, 0, 'text/new.xhtml', NULL FROM b
""")
def insert_documents(spark, sf):
    """Documents of books that have none yet, with ids that follow the largest one."""
    d = table(spark, sf, "book_documents").select("book_id", "doc_index", "href", "word_count")
    current = mutate.dense_rank_rows(d, ["book_id", "doc_index"], "id").select("id", *d.columns)
    new = table(spark, sf, "books").select(F.col("id").alias("book_id")).join(d.select("book_id"), "book_id", "left_anti")
    return mutate.insert(current, new.select("book_id", F.lit(0).alias("doc_index"), F.lit("text/new.xhtml").alias("href")), "id", ["book_id"])


@query("""
SELECT CAST(row_number() OVER (ORDER BY book_id, doc_index) AS BIGINT) AS id, book_id, 'images/' || doc_index || '.png' AS path, 'image/png' AS media_type, CAST(image_count AS BIGINT) AS size FROM book_documents WHERE image_count > 0
""")
def insert_resources(spark, sf):
    new = table(spark, sf, "book_documents").filter("image_count > 0")
    path = F.concat(F.lit("images/"), F.col("doc_index").cast("string"), F.lit(".png"))
    new = new.select("book_id", "doc_index", path.alias("path"), X.media_type(X.extension(path)).alias("media_type"), F.col("image_count").cast("bigint").alias("size"))
    empty = spark.createDataFrame([], "id BIGINT, book_id BIGINT, path STRING, media_type STRING, size BIGINT")
    return mutate.insert(empty, new, "id", ["book_id", "doc_index"])


@query("""
SELECT book_id, doc_index, CASE WHEN href IS NULL THEN 'new ' || doc_index ELSE 'old ' || href END AS content FROM book_documents
""")
def replace_contents(spark, sf):
    """Contents of documents without a link replaced, those of the others kept."""
    d = table(spark, sf, "book_documents")
    current = d.select("book_id", "doc_index", F.concat(F.lit("old "), F.coalesce("href", F.lit("none"))).alias("content"))
    new = d.filter("href IS NULL").select("book_id", "doc_index", F.concat(F.lit("new "), F.col("doc_index").cast("string")).alias("content"))
    return mutate.replace_keyed(current, new, ["book_id", "doc_index"])


@query("""
SELECT book_id, doc_index, CAST(CASE WHEN in_toc AND doc_index % 3 <> 2 THEN doc_index * 10 ELSE word_count END AS DECIMAL(18,2)) AS word_count, CAST(CASE WHEN in_toc THEN toc_level ELSE image_count END AS INTEGER) AS image_count FROM book_documents
""")
def document_stats_update(spark, sf):
    """New statistics of some documents; a null keeps the old value."""
    d = table(spark, sf, "book_documents").select("book_id", "doc_index", "in_toc", "toc_level", "word_count", "image_count")
    delta = d.filter("in_toc").select("book_id", "doc_index", F.when(F.col("doc_index") % 3 != 2, F.col("doc_index") * 10).alias("word_count"), F.col("toc_level").alias("image_count"))
    return mutate.partial_update(d.drop("in_toc", "toc_level"), delta, ["book_id", "doc_index"], ["word_count", "image_count"])


@query(f"""
WITH {_BOOKMARKS} SELECT id, user_id, position_value, CASE WHEN id % 4 = 0 THEN '#123456' ELSE color END AS color, CASE WHEN id % 8 = 0 THEN 'noted' END AS note FROM marks WHERE n = 1
""")
def bookmarks_update(spark, sf):
    """Changes of bookmarks, each by the user who sends it: those of other users' bookmarks change nothing."""
    marks = _bookmarks(spark, sf).select("id", "user_id", "position_value", "color", F.lit(None).cast("string").alias("note"))
    sent = marks.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("user_id")).otherwise(-F.col("user_id") - 1).alias("user_id"), F.lit("#123456").alias("color"), F.when(F.col("id") % 8 == 0, "noted").alias("note"))
    return mutate.partial_update(marks, sent, ["id", "user_id"], ["color", "note"])


@query("SELECT source_id AS id, source, CASE WHEN source_id % 2 = 1 THEN NOT enabled ELSE enabled END AS enabled FROM book_sources")
def toggle_some_sources(spark, sf):
    s = table(spark, sf, "book_sources").select(F.col("source_id").alias("id"), "source", "enabled")
    return mutate.toggle(s, "enabled", s.filter("id % 2 = 1"))


@query("SELECT id, CASE WHEN id % 10 = 3 THEN 'pending' ELSE parse_status END AS parse_status, chapters_parsed FROM books")
def status_update(spark, sf):
    books = table(spark, sf, "books").select("id", "parse_status", "chapters_parsed")
    return mutate.set_status(books, books.filter("id % 10 = 3").select("id", F.lit("pending").alias("parse_status")))


@query("""
WITH inv AS (SELECT event_id AS token, user_id AS created_by, value > 10 AS used, CASE WHEN value > 10 THEN user_id END AS used_by FROM events WHERE event_type = 'click'),
u AS (SELECT e.event_id - (e.event_id % 3) AS token, e.user_id AS used_by, e.ts AS used_at, row_number() OVER (PARTITION BY e.event_id - (e.event_id % 3) ORDER BY e.ts, e.user_id) AS n FROM events e WHERE event_type = 'view')
SELECT inv.token, inv.created_by, inv.used OR (u.used_by IS NOT NULL AND NOT inv.used) AS used, CASE WHEN inv.used THEN inv.used_by ELSE u.used_by END AS used_by, CASE WHEN NOT inv.used THEN u.used_at END AS used_at FROM inv LEFT JOIN u ON u.token = inv.token AND u.n = 1
""")
def use_invites(spark, sf):
    """Invites used by new users: once each, by the one who came first; used ones keep their user."""
    e = table(spark, sf, "events")
    used = F.col("value") > 10
    invites = e.filter("event_type = 'click'").select(F.col("event_id").alias("token"), F.col("user_id").alias("created_by"), used.alias("used"), F.when(used, F.col("user_id")).alias("used_by"), F.lit(None).cast("timestamp_ntz").alias("used_at"))
    uses = e.filter("event_type = 'view'").select((F.col("event_id") - F.col("event_id") % 3).alias("token"), F.col("user_id").alias("used_by"), F.col("ts").alias("used_at"))
    return mutate.use_invites(invites, uses)


@query("SELECT event_id AS token, user_id FROM events WHERE event_type = 'signup' AND event_id % 5 <> 0 AND NOT ts + INTERVAL 30 DAYS <= TIMESTAMP '2024-02-10 00:00:00'")
def sessions_left(spark, sf):
    """Sessions after a log-out of some and the removal of those that have expired."""
    e = table(spark, sf, "events").filter("event_type = 'signup'")
    sessions = mutate.new_sessions(e.select(F.col("event_id").alias("token"), "user_id", F.col("ts").alias("created_at")))
    left = mutate.delete_keys(sessions, sessions.filter("token % 5 = 0"), "token")
    return mutate.delete(left, F.col("expires_at") <= F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'")).select("token", "user_id")


@query("""
WITH b AS (SELECT id FROM books WHERE source IN (SELECT source FROM book_sources WHERE enabled) AND id % 10 <> 0), u AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0),
tags AS (SELECT DISTINCT lower(trim(tag)) AS id FROM (SELECT unnest(tags) AS tag FROM book_metadata) WHERE tag IS NOT NULL), t AS (SELECT id FROM tags WHERE length(id) % 2 = 0),
bt AS (SELECT book_id, lower(trim(tag)) AS tag_id FROM (SELECT book_id, unnest(tags) AS tag FROM book_metadata) WHERE tag IS NOT NULL), d AS (SELECT * FROM book_documents WHERE book_id IN (SELECT id FROM b)),
p AS (SELECT * FROM progress_events WHERE book_id IN (SELECT id FROM b) AND (user_id IN (SELECT id FROM u)))
SELECT 'books' AS "table", count(*) AS rows FROM b UNION ALL SELECT 'book_documents', count(*) FROM d UNION ALL SELECT 'document_contents', count(*) FROM d UNION ALL SELECT 'document_resources', count(*) FROM d WHERE image_count > 0
UNION ALL SELECT 'book_tags', count(*) FROM bt WHERE book_id IN (SELECT id FROM b) AND tag_id IN (SELECT id FROM t) UNION ALL SELECT 'reading_progress', count(*) FROM p UNION ALL SELECT 'bookmarks', count(*) FROM p WHERE progress > 50
UNION ALL SELECT 'reader_settings', count(DISTINCT user_id) FROM progress_events WHERE user_id IN (SELECT id FROM u)
""")
def cascade_all(spark, sf):
    """Rows left in every table after sources, books, users and tags were deleted: all eleven references."""
    documents = table(spark, sf, "book_documents").select(F.concat_ws("-", "book_id", "doc_index").alias("id"), "book_id", "image_count")
    events = table(spark, sf, "progress_events")
    links = table(spark, sf, "book_metadata").select("book_id", F.explode("tags").alias("tag")).filter("tag IS NOT NULL").select("book_id", F.lower(F.trim("tag")).alias("tag_id"))
    tables = {
        "book_sources": table(spark, sf, "book_sources").filter("enabled").select(F.col("source").alias("id")), "books": table(spark, sf, "books").filter("id % 10 <> 0").select("id", F.col("source").alias("source_id")), "book_documents": documents.select("id", "book_id"),
        "document_contents": documents.select(F.col("id").alias("document_id")), "document_resources": documents.filter("image_count > 0").select("book_id"), "tags": links.select(F.col("tag_id").alias("id")).distinct().filter("length(id) % 2 = 0"), "book_tags": links,
        "users": table(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id")), "reading_progress": events.select("user_id", "book_id"), "bookmarks": events.filter("progress > 50").select("user_id", "book_id"),
        "reader_settings": events.select("user_id").distinct(),
    }
    left = mutate.cascade(tables)
    children = dict.fromkeys(child for child, *_ in mutate.CASCADES)
    return reduce(DataFrame.unionByName, (left[c].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(c).alias("table"), "rows") for c in children))


# ---------------------------------------------------------------- state of parsing


_REQUESTS = "requests AS (SELECT DISTINCT book_id AS id FROM progress_events)"


@query(f"WITH {_REQUESTS} SELECT id, CASE WHEN id IN (SELECT id FROM requests) AND NOT chapters_parsed AND coalesce(parse_status, 'pending') = 'pending' THEN 'parsing' ELSE parse_status END AS parse_status FROM books")
def parse_claims(spark, sf):
    """Books that readers asked for are taken up: once each, and only those that wait."""
    return poll.claim(table(spark, sf, "books").select("id", "chapters_parsed", "parse_status"), table(spark, sf, "progress_events").select(F.col("book_id").alias("id"))).select("id", "parse_status")


@query(f"""
WITH {_REQUESTS}, c AS (SELECT b.*, id IN (SELECT id FROM requests) AND NOT chapters_parsed AND coalesce(parse_status, 'pending') = 'pending' AS mine, id IN (SELECT book_id FROM book_documents) AS done FROM books b)
SELECT id, CASE WHEN mine AND done THEN 'completed' WHEN mine OR parse_status = 'parsing' AND NOT done THEN 'failed' WHEN parse_status = 'parsing' THEN 'completed' ELSE parse_status END AS parse_status, CASE WHEN (mine OR parse_status = 'parsing') AND done THEN true ELSE chapters_parsed END AS chapters_parsed FROM c
""")
def parse_finished(spark, sf):
    """Claimed books after they were parsed: completed with documents, failed without; the others stay."""
    books = table(spark, sf, "books").select("id", "chapters_parsed", "parse_status")
    claimed = poll.claim(books, table(spark, sf, "progress_events").select(F.col("book_id").alias("id")))
    return poll.finish(claimed, table(spark, sf, "book_documents").select(F.col("book_id").alias("id")))


@query(f"""
WITH {_CHAPTERS.replace('FROM documents WHERE', 'FROM (SELECT * FROM documents WHERE doc_id % 2 = 1) WHERE')}
SELECT doc_id, index, {_sql_words('body')} AS words, false AS stored FROM bodies UNION ALL SELECT doc_id, 0, CAST(-1 AS BIGINT), true FROM documents WHERE doc_id % 2 = 0
""")
def parse_on_demand(spark, sf):
    """Chapters of requested texts: stored ones are read, the others are parsed."""
    d = fan_out(table(spark, sf, "documents").select("doc_id", "text"))
    stored = d.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("index"), F.lit(None).cast("string").alias("title"), F.lit(-1).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("images"))
    return poll.on_demand(d.select("doc_id"), stored, d).select("doc_id", "index", "words", "stored")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'failed' ELSE 'completed' END AS parse_status FROM documents")
def stream_statuses(spark, sf):
    """States after a stream has parsed all files of a folder in small batches."""
    source = f"{sf}/documents.parquet"
    folder = shared_folder(spark, f"stream-{os.urandom(6).hex()}")
    schema = table(spark, sf, "documents").schema
    poll.parse_stream(spark, source + "*", schema, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/status").select("doc_id", "parse_status")


# ---------------------------------------------------------------- rules


_PAYLOAD = "r AS (SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS priority, source AS name, '^' || source || ' \\d+$' AS rule, source || ' 1' AS example FROM book_sources)"


def _payload(spark, sf):
    """A request body: a list of rules, one for each source, in the order of names."""
    s = table(spark, sf, "book_sources")
    rule = F.struct(F.col("source").alias("name"), F.concat(F.lit("^"), "source", F.lit(r" \d+$")).alias("rule"), F.concat("source", F.lit(" 1")).alias("example"))
    return s.agg(F.to_json(F.array_sort(F.collect_list(rule))).alias("body"))


@query(f"WITH {_PAYLOAD} SELECT name, rule, example, priority, true AS enabled FROM r WHERE name NOT IN (SELECT source FROM book_sources WHERE enabled)")
def rules_import(spark, sf):
    """Rules of a request whose names are not in the table yet."""
    current = table(spark, sf, "book_sources").filter("enabled").select(F.col("source").alias("name"))
    return scan.import_rules(current, scan.rule_payload(_payload(spark, sf)))


@query(f"WITH {_PAYLOAD} SELECT name, rule, example, priority, true AS enabled FROM r")
def rules_initial(spark, sf):
    """Rules of a file, read as one text, for a table that is still empty; a filled one would take none."""
    folder = shared_folder(spark, f"rules-{os.urandom(6).hex()}") + "/rules"
    _payload(spark, sf).coalesce(1).write.text(folder)
    rules = scan.rule_file(spark, f"{folder}/part-*")
    filled = scan.initial_rules(rules.limit(1), rules)
    return scan.initial_rules(rules.limit(0), rules).unionByName(filled)


@query("""
SELECT source_id AS id, CASE WHEN source_id % 3 = 1 THEN 'new' ELSE source END AS name, CASE WHEN source_id % 3 = 1 THEN '^x+$' ELSE '^' || source || '$' END AS rule, CAST(CASE WHEN source_id % 3 = 1 THEN 7 ELSE source_id END AS INTEGER) AS priority FROM book_sources
""")
def rules_update(spark, sf):
    """Rules replaced as a whole; those whose pattern does not compile are refused."""
    s = table(spark, sf, "book_sources")
    current = s.select(F.col("source_id").alias("id"), F.col("source").alias("name"), F.concat(F.lit("^"), "source", F.lit("$")).alias("rule"), F.col("source_id").alias("priority"))
    sent = s.filter("source_id % 3 <> 2").select(F.col("source_id").alias("id"), F.lit("new").alias("name"), F.when(F.col("source_id") % 3 == 1, "^x+$").otherwise("[x").alias("rule"), F.lit(7).alias("priority"))
    return mutate.replace_keyed(current, mutate.valid_rules(sent), "id")


#: Rules of a table: by priority; one is turned off and one does not compile.
_RULES = [(1, r"^(?i)(kapitel|chapitre|chapter|cap[ií]tulo)\b.*", 2, True), (2, r"^[0-9]+\..*", 1, True), (3, r"^.*$", 0, False), (4, "[unclosed", 3, True)]
_BY_RULES = _CHAPTERS.replace("|".join(f"(?:{p})" for p in segment.FALLBACK), r"(?:^[0-9]+\..*)|(?:^(?i:kapitel|chapitre|chapter|cap[ií]tulo)\b.*)")


@query(f"WITH {_BY_RULES} SELECT doc_id, index, title, start_pos, end_pos FROM chapters")
def chapters_by_rules(spark, sf):
    """Chapters of texts by a table of rules."""
    rules = spark.createDataFrame(_RULES, "id INT, rule STRING, priority INT, enabled BOOLEAN")
    return segment.chapters(fan_out(table(spark, sf, "documents").select("doc_id", "text")), pattern=segment.header_pattern(rules))


# ---------------------------------------------------------------- texts and elements


@query(r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\x1C-\x1F\p{Z}]+|[\s\x1C-\x1F\p{Z}]+$', '', 'g')), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ps, list_transform(ps, lambda p: length(p) < 100 AND (regexp_matches(p, '^[\p{Lu}\s]+$') OR regexp_full_match(p, '(第[零一二三四五六七八九十百千万0-9]+[章节]|Chapter\s+\d+|\d+\.).*'))) AS heads FROM p)
SELECT doc_id, CAST(len(ps) + 1 AS INTEGER) AS elements, CAST(1 + len(list_filter(heads, lambda x: x)) AS INTEGER) AS headings FROM h
""")
def pdf_elements(spark, sf):
    """Elements of the text of pages."""
    d = fan_out(table(spark, sf, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    e = d.select("doc_id", segment.pdf_elements(F.col("text"), F.lit("Part")).alias("e"))
    return e.select("doc_id", F.size("e").alias("elements"), F.size(F.filter("e", lambda x: x["type"] == "Heading")).alias("headings"))


@query(rf"""
WITH {_CHAPTERS}, parts AS (SELECT doc_id, index, title, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\x1C-\x1F\p{{Z}}]+|[\s\x1C-\x1F\p{{Z}}]+$', '', 'g')), lambda p: p <> '') AS parts FROM bodies)
SELECT doc_id, index, array_to_string(parts, chr(1)) AS texts FROM parts
""")
def elements_exchange(spark, sf):
    """Elements written as JSON text and read back: the texts of all of them."""
    bodies = segment.with_body(fan_out(table(spark, sf, "documents").select("doc_id", "text")), "doc_id")
    back = bodies.select("doc_id", "index", C.from_text(C.to_text(segment.text_elements(F.col("body"), F.col("title")))).alias("e"))
    text = lambda e: F.coalesce(e["text"], F.array_join(F.transform(e["spans"], lambda s: s["text"]), "\n"))
    return back.select("doc_id", "index", F.array_join(F.transform("e", text), "\x01").alias("texts"))


@query("""
WITH d AS (SELECT book_id, doc_index, 'images/' || doc_index || '.png' AS path FROM book_documents),
r AS (SELECT book_id, path, max(stored) AS stored FROM (SELECT book_id, path, 's/' || book_id || '-' || doc_index AS stored FROM d WHERE doc_index % 2 = 0 UNION ALL SELECT book_id, path, 't/' || doc_index FROM d WHERE doc_index % 4 = 0) GROUP BY book_id, path)
SELECT d.book_id, d.doc_index, coalesce(r.stored, d.path) AS image, 'images/' || (d.doc_index + 1) || '.png' AS before, coalesce(n.stored, 'images/' || (d.doc_index + 1) || '.png') AS note FROM d LEFT JOIN r ON r.book_id = d.book_id AND r.path = d.path
LEFT JOIN r n ON n.book_id = d.book_id AND n.path = 'images/' || (d.doc_index + 1) || '.png'
""")
def resources_rewritten(spark, sf):
    """Images and images of notes point to the stored path; unmatched ones stay; a path stored twice is taken once."""
    d = table(spark, sf, "book_documents").select("book_id", "doc_index")
    place = lambda i: F.concat(F.lit("images/"), i.cast("string"), F.lit(".png"))
    stored = d.filter("doc_index % 2 = 0").select("book_id", place(F.col("doc_index")).alias("path"), F.concat(F.lit("s/"), F.col("book_id").cast("string"), F.lit("-"), F.col("doc_index").cast("string")).alias("stored_path"))
    again = d.filter("doc_index % 4 = 0").select("book_id", place(F.col("doc_index")).alias("path"), F.concat(F.lit("t/"), F.col("doc_index").cast("string")).alias("stored_path"))
    note = segment.span(F.lit("1")).withField("footnoteImage", place(F.col("doc_index") + 1))
    content = F.array(segment._empty("Image", src=place(F.col("doc_index"))), segment._empty("Code", src=place(F.col("doc_index") + 1)), segment._empty("Paragraph", spans=F.array(note)))
    out = catalog.rewrite_resources(d.withColumn("content", content), stored.unionByName(again))
    return out.select("book_id", "doc_index", F.col("content")[0]["src"].alias("image"), F.col("content")[1]["src"].alias("before"), F.col("content")[2]["spans"][0]["footnoteImage"].alias("note"))


@query("""
WITH m AS (SELECT book_id, arg_min(struct_pack(title := CASE WHEN meta_id % 3 = 0 THEN NULL ELSE title END, author := CASE WHEN meta_id % 3 = 0 THEN NULL ELSE author END, publisher := publisher), (extracted_at, meta_id)) AS a,
  arg_max(struct_pack(title := title, author := author, publisher := NULL), (extracted_at, meta_id)) AS b FROM book_metadata GROUP BY book_id)
SELECT book_id, CASE WHEN first THEN a.title ELSE b.title END AS title, CASE WHEN first THEN a.author ELSE b.author END AS author, CASE WHEN first THEN a.publisher END AS publisher FROM (SELECT *, a.title IS NOT NULL OR a.author IS NOT NULL AS first FROM m)
""")
def metadata_chosen(spark, sf):
    """Of two extractions the first wins whole if it has a title or an author; fields are never mixed."""
    m = table(spark, sf, "book_metadata")
    order = F.struct("extracted_at", "meta_id")
    unless = lambda c: F.when(F.col("meta_id") % 3 != 0, F.col(c)).alias(c)
    first, second = F.struct(unless("title"), unless("author"), "publisher"), F.struct("title", "author", F.lit(None).cast("string").alias("publisher"))
    both = m.groupBy("book_id").agg(F.min_by(first, order).alias("a"), F.max_by(second, order).alias("b"))
    return both.select("book_id", scan.choose_metadata(F.col("a"), F.col("b")).alias("m")).select("book_id", "m.*")


@query("SELECT book_id, doc_index, 'OEBPS/' || href AS joined, href AS bare, CASE WHEN starts_with(href, 'text/') THEN substring(href, 6) ELSE href END AS stripped FROM book_documents")
def base_paths(spark, sf):
    """Links joined with a base and taken off it."""
    joined = X.join_base(F.lit("OEBPS"), F.col("href"))
    return table(spark, sf, "book_documents").select("book_id", "doc_index", joined.alias("joined"), X.join_base(F.lit(""), X.strip_base(F.lit("OEBPS"), joined)).alias("bare"), X.strip_base(F.lit("text"), F.col("href")).alias("stripped"))


@query(r"SELECT id, coalesce(nullif(regexp_replace(substring(author, 1, id % 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''), nullif(regexp_replace(publisher, '^[\s\x1C-\x1F\p{Z}]+|[\s\x1C-\x1F\p{Z}]+$', '', 'g'), '')) AS named, coalesce(nullif(substring(author, 1, CAST(id % 2 AS INTEGER)), ''), nullif(publisher, '')) AS raw FROM books")
def first_named(spark, sf):
    """The first value that says something, with and without white space counted."""
    part = F.expr("substring(author, 1, id % 2)")
    return table(spark, sf, "books").select("id", X.first_non_blank(part, F.col("publisher")).alias("named"), X.first_non_empty(part, F.col("publisher")).alias("raw"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' END AS kind FROM books")
def image_kinds(spark, sf):
    """Kinds of images by their first bytes; null for what is none."""
    head = F.element_at(F.array(*(F.unhex(F.lit(x)) for x in ("FFD8FF", "89504E47", "47494638", "25504446"))), (F.col("id") % 4 + 1).cast("int"))
    return table(spark, sf, "books").select("id", X.image_type(F.concat(head, F.col("title").cast("binary"))).alias("kind"))


@query(r"SELECT id, CASE WHEN regexp_full_match(x, '[+-]?\d+') THEN TRY_CAST(x AS INTEGER) END AS page FROM (SELECT id, CASE WHEN id % 5 = 0 THEN isbn WHEN id % 5 = 1 THEN CAST(id AS VARCHAR) WHEN id % 5 = 2 THEN '-' || id ELSE title END AS x FROM books)")
def safe_integers(spark, sf):
    """Integers that parameters spell; anything else, and what is too large, is null."""
    text = F.when(F.col("id") % 5 == 0, F.col("isbn")).when(F.col("id") % 5 == 1, F.col("id").cast("string")).when(F.col("id") % 5 == 2, F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("title"))
    return table(spark, sf, "books").select("id", X.safe_int(text).alias("page"))


#: HTML of each document: the place of its main content depends on the book, and the fields of its head on the chapter.
_MAIN = ['<article>{}</article>', '<main>{}</main>', '<div class="x content">{}</div>', '<div class="article">{}</div>', '<div id="content">{}</div>', "{}"]


@query("""
SELECT book_id, doc_index, 'para ' || doc_index || CASE WHEN book_id % 6 = 5 THEN '|aside' ELSE '' END AS texts FROM book_documents
""")
def html_main_content(spark, sf):
    """The main content of pages: by tag, class or id, else the whole body."""
    pick = F.element_at(F.array(*(F.lit(m) for m in _MAIN)), (F.col("book_id") % 6 + 1).cast("int"))
    body = F.replace(pick, F.lit("{}"), F.concat(F.lit("<p>para "), F.col("doc_index").cast("string"), F.lit("</p>")))
    page = F.concat(F.lit("<html><body>"), body, F.lit("<p>aside</p></body></html>"))
    pages = table(spark, sf, "book_documents").select(F.struct("book_id", "doc_index").alias("at"), page.alias("text")).select(F.to_json("at").alias("k"), "text")
    c = html.html_chapters(pages, "k").select(F.from_json("k", "book_id BIGINT, doc_index INT").alias("at"), "content")
    return c.select("at.*", F.array_join(F.transform("content", lambda e: e["spans"][0]["text"]), "|").alias("texts"))


@query("""
SELECT book_id, doc_index, CASE doc_index % 3 WHEN 0 THEN 'og' WHEN 1 THEN 'named' ELSE 'title' END AS title, CASE doc_index % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS author, CASE WHEN doc_index % 2 = 0 THEN 'site' END AS publisher, 'a|b|c|d' AS tags FROM book_documents
""")
def html_head_fields(spark, sf):
    """Fields of the head of pages: the first source that says something, tags of all sources once."""
    third = (F.col("doc_index") % 3 + 1).cast("int")
    title = F.element_at(F.array(*(F.lit(x) for x in ('<meta property="og:title" content="og"><meta name="title" content="named">', '<meta property="og:title" content=""><meta name="title" content="named">', ""))), third)
    author = F.element_at(F.array(*(F.lit(x) for x in ('<meta name="author" content="A"><meta property="article:author" content="B">', '<meta property="article:author" content="B">', ""))), third)
    site = F.when(F.col("doc_index") % 2 == 0, '<meta property="og:site_name" content="site">').otherwise("")
    tags = F.lit('<meta name="keywords" content="a; b/a"><meta property="article:tag" content="c"><meta property="og:article:tag" content=" d ">')
    pages = table(spark, sf, "book_documents").select(F.to_json(F.struct("book_id", "doc_index")).alias("k"), F.concat(F.lit("<html><head><title>title</title>"), title, author, site, tags, F.lit("</head></html>")).alias("text"))
    m = html.html_metadata(pages, "k").select(F.from_json("k", "book_id BIGINT, doc_index INT").alias("at"), "title", "author", "publisher", "tags")
    return m.select("at.*", "title", "author", "publisher", F.array_join("tags", "|").alias("tags"))


#: Inline markup of a paragraph, the same for all documents but for a number.
_INLINE = '<p>plain <b>bold <i>both</i></b> <a href="u{}">link</a><br>next</p><h3>Head</h3><blockquote>quoted</blockquote><ul><li>one</li><li></li><li>two <code>x</code></li></ul><pre><code class="hl language-py">y</code></pre><hr><table><tr><td>gone</td></tr></table><img src="i{}.png" alt="A" width="3">'


@query("""
SELECT book_id, doc_index, CAST(pos AS INTEGER) AS pos, type, replace(text, '#', CAST(doc_index AS VARCHAR)) AS text FROM book_documents, (VALUES (0, 'Paragraph', 'plain [] + bold [BOLD] + both [BOLD,ITALIC] + link [UNDERLINE]u# + ' || chr(10) || ' [] + next []'), (1, 'Heading', 'Head 3'), (2, 'Quote', 'quoted []'), (3, 'ListBlock', 'one [] / two [] + x [CODE]'), (4, 'Code', 'y py'), (5, 'Divider', ''), (6, 'Image', 'i#.png A 3')) AS e(pos, type, text)
""")
def html_inline(spark, sf):
    """Typed elements, nested styles, inherited links, lists, code, images; tables vanish."""
    page = F.replace(F.lit(_INLINE), F.lit("{}"), F.col("doc_index").cast("string"))
    pages = table(spark, sf, "book_documents").select(F.to_json(F.struct("book_id", "doc_index")).alias("k"), page.alias("text"))
    e = html.html_chapters(pages, "k").select(F.from_json("k", "book_id BIGINT, doc_index INT").alias("at"), F.posexplode("content").alias("pos", "e"))
    one = lambda s: F.concat(F.when(s["text"] == "\n", s["text"]).otherwise(F.trim(s["text"])), F.lit(" ["), F.array_join(s["styles"], ","), F.lit("]"), F.coalesce(s["link"], F.lit("")))
    spans = lambda xs: F.array_join(F.transform(xs, one), " + ")
    text = (
        F.when(F.col("e.type").isin("Paragraph", "Quote"), spans(F.col("e.spans"))).when(F.col("e.type") == "ListBlock", F.array_join(F.transform("e.items", lambda i: spans(i["spans"])), " / "))
        .when(F.col("e.type") == "Image", F.concat_ws(" ", "e.src", "e.alt", F.col("e.width").cast("string"))).otherwise(F.concat_ws(" ", "e.text", "e.language", F.col("e.level").cast("string")))
    )
    return e.select("at.*", "pos", F.col("e.type").alias("type"), text.alias("text"))
