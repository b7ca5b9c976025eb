from datetime import datetime as D

from pyspark.sql import functions as F

from librarium.operators import catalog, mutate, tagging


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert_progress(spark):
    e = spark.createDataFrame(
        [(1, 1, 10.0, None, D(2024, 1, 1), 1), (1, 1, 20.0, "d5", D(2024, 1, 2), 2), (1, 1, 15.0, None, D(2024, 1, 3), 3), (1, 1, 15.0, None, D(2024, 1, 3), 3), (1, 2, None, "x", D(2024, 1, 1), 4)],
        "user_id INT, book_id INT, progress DOUBLE, device_id STRING, ts TIMESTAMP_NTZ, event_id INT",
    )
    first = mutate.upsert_progress(None, e.limit(2))
    assert rows(mutate.upsert_progress(None, e)) == [(1, 1, 15.0, "d5", D(2024, 1, 3))]
    assert rows(mutate.upsert_progress(first, e.filter("event_id = 3"))) == [(1, 1, 15.0, "d5", D(2024, 1, 3))]
    assert rows(mutate.upsert_progress(first, e.limit(0))) == rows(first)


def test_partial_update(spark):
    cur = spark.createDataFrame([(1, "A", "B"), (2, "x", None)], "id INT, title STRING, author STRING")
    delta = spark.createDataFrame([(1, None, "C"), (9, "n", "n")], "id INT, title STRING, author STRING")
    assert rows(mutate.partial_update(cur, delta, "id", ["title", "author"])) == [(1, "A", "C"), (2, "x", None)]


def test_insert_gives_dense_ids(spark):
    cur = spark.createDataFrame([(7, "a")], "id INT, name STRING")
    new = spark.createDataFrame([(f"n{i:03}",) for i in range(50)], "name STRING").repartition(7)
    got = rows(mutate.insert(cur, new, order=["name"]), "id")
    assert got == [(7, "a")] + [(8 + i, f"n{i:03}") for i in range(50)]
    assert rows(mutate.insert(cur, new.limit(0))) == [(7, "a")]


def test_deletes_and_cascade(spark):
    tables = {
        "book_sources": spark.createDataFrame([(1,)], "id INT"), "books": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id INT, source_id INT"),
        "book_tags": spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "book_id INT, tag_id INT"), "tags": spark.createDataFrame([(5,)], "id INT"),
    }
    out = mutate.cascade(tables)
    assert rows(out["books"].select("id")) == [(1,), (3,)] and rows(out["book_tags"]) == [(1, 5)]
    df = spark.createDataFrame([(1, None), (2, True)], "id INT, b BOOLEAN")
    assert rows(mutate.delete(df, F.col("b")).select("id")) == [(1,)]
    assert rows(mutate.delete_keys(df, df.filter("id = 1"), "id").select("id")) == [(2,)]
    assert rows(mutate.replace_keyed(df, spark.createDataFrame([(1, False)], df.schema), "id")) == [(1, False), (2, True)]


def test_settings(spark):
    import librarium.schemas as S

    cur = spark.createDataFrame([], S.TABLES["reader_settings"])
    one = spark.createDataFrame([(1, "dark"), (2, None)], "user_id INT, theme STRING")
    delta = one.select("user_id", *(F.col("theme") if c == "theme" else F.lit(None).alias(c) for c in mutate.SETTINGS))
    first = mutate.patch_settings(cur, delta)
    assert rows(first.select("user_id", "theme", "font_size")) == [(1, "dark", 16), (2, "light", 16)]
    again = delta.withColumn("theme", F.lit(None).cast("string")).withColumn("font_size", F.lit(20))
    assert rows(mutate.patch_settings(first, again).select("user_id", "theme", "font_size")) == [(1, "dark", 20), (2, "light", 20)]
    assert rows(mutate.put_settings(first, again).select("user_id", "theme", "font_size")) == [(1, "light", 20), (2, "light", 20)]


def test_status(spark):
    b = spark.createDataFrame([(1, False, 0, "pending", None), (2, True, 3, "completed", D(2024, 1, 1))], "id INT, chapters_parsed BOOLEAN, chapters_count INT, parse_status STRING, last_parsed_at TIMESTAMP_NTZ")
    done = mutate.complete(b, spark.createDataFrame([(1, 4)], "id INT, n INT"), F.lit(D(2024, 5, 1)).cast("timestamp_ntz"))
    assert rows(done) == [(1, True, 4, "completed", D(2024, 5, 1)), (2, True, 3, "completed", D(2024, 1, 1))]
    assert rows(mutate.reset(b, b.filter("id = 2"))) == [(1, False, 0, "pending", None), (2, False, 0, "pending", None)]
    assert rows(mutate.set_status(b, spark.createDataFrame([(1, "parsing")], "id INT, parse_status STRING")).select("parse_status")) == [("completed",), ("parsing",)]
    states = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate([(None, False), ("pending", False), ("parsing", False), ("failed", False), ("completed", True)])], "id INT, parse_status STRING, chapters_parsed BOOLEAN")
    assert rows(catalog.unparsed(states).select("id")) == [(0,), (1,)] and rows(catalog.retry(states, ["failed"]).select("id")) == [(3,)]


def test_sessions_and_invites(spark):
    s = mutate.new_sessions(spark.createDataFrame([("t", 1, D(2024, 1, 1))], "token STRING, user_id INT, created_at TIMESTAMP_NTZ"))
    users = spark.createDataFrame([(1, "u")], "user_id INT, username STRING")
    now = lambda d: F.lit(d).cast("timestamp_ntz")
    assert catalog.active_sessions(s, users, now(D(2024, 1, 31))).count() == 0  # expires exactly now
    assert catalog.active_sessions(s, users, now(D(2024, 1, 30))).count() == 1
    inv = spark.createDataFrame([("a", 1, False, None, None), ("b", 1, True, 9, D(2024, 1, 1))], "token STRING, created_by INT, used BOOLEAN, used_by INT, used_at TIMESTAMP_NTZ")
    use = spark.createDataFrame([("a", 5, D(2024, 2, 2)), ("a", 6, D(2024, 2, 1)), ("b", 5, D(2024, 2, 2))], "token STRING, used_by INT, used_at TIMESTAMP_NTZ")
    assert rows(mutate.use_invites(inv, use)) == [("a", 1, True, 6, D(2024, 2, 1)), ("b", 1, True, 9, D(2024, 1, 1))]
    assert rows(catalog.open_invites(inv).select("token")) == [("a",)]


def test_bookmarks(spark):
    schema = "id INT, user_id INT, book_id INT, position_value STRING, created_at TIMESTAMP_NTZ, color STRING"
    cur = spark.createDataFrame([(1, 1, 1, "5", D(2024, 1, 1), "#000000")], schema)
    new = spark.createDataFrame([(2, 1, 1, "5", D(2024, 1, 2), None), (3, 1, 1, "6", D(2024, 1, 3), None), (4, 1, 1, "6", D(2024, 1, 2), None)], schema)
    assert rows(mutate.add_bookmarks(cur, new).select("id", "color")) == [(1, "#000000"), (4, "#FFD700")]


def test_images_rules_toggle(spark):
    i = spark.createDataFrame([(1, bytearray(b"x"), "png"), (1, bytearray(b"x"), "png"), (2, bytearray(b"x"), "png")], "book_id INT, content BINARY, ext STRING")
    assert rows(mutate.store_images(i)) == [(1, "2d711642b726b044.png", 1), (2, "2d711642b726b044.png", 1)]
    r = spark.createDataFrame([(1, "a+"), (2, "("), (3, None)], "id INT, rule STRING")
    assert rows(mutate.valid_rules(r).select("id")) == [(1,)]
    t = spark.createDataFrame([(1, True), (2, False)], "id INT, enabled BOOLEAN")
    assert rows(mutate.toggle(t, "enabled", t.filter("id = 1"))) == [(1, False), (2, False)]
    p = spark.createDataFrame([(1, 1), (2, 2)], "id INT, priority INT")
    assert rows(mutate.set_priorities(p, spark.createDataFrame([(2, 9), (7, 1)], p.schema))) == [(1, 1), (2, 9)]


def test_tags(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "id BIGINT, name STRING")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "book_id INT, tag_id BIGINT")
    t, m = tagging.merge(tags, links, spark.createDataFrame([(1, 2), (2, 2)], "source BIGINT, target BIGINT"))
    assert rows(t) == [(2, "b")] and rows(m) == [(1, 2), (2, 2)]
    assert rows(tagging.stats(tags, links.filter("tag_id = 1"))) == [(1, "a", 2), (2, "b", 0)]
    names = spark.createDataFrame([("c",), ("a",), ("c",), (None,), ("",)], "name STRING")
    more = tagging.find_or_create(tags, names)
    assert rows(more) == [(1, "a"), (2, "b"), (3, "c")] and tagging.created_by(tags, more).first().n == 1
    assert rows(tagging.link(links, links)) == rows(links)
    books = spark.createDataFrame([(1, "t", "/x/t-1-b-a,z.epub"), (2, "u", "/x/none.epub")], "id INT, title STRING, file_path STRING")
    assert rows(tagging.auto_tags(books)) == [(1, "a"), (1, "z")] and rows(tagging.auto_tags(books, limit=1)) == [(1, "a"), (1, "z")]
    after, linked = tagging.apply_auto_tags(books, tags, links)
    assert rows(after) == [(1, "a"), (2, "b"), (3, "z")] and (1, 3) in rows(linked)


def test_resources_are_rewritten(spark):
    from librarium.schemas import ELEMENT

    span = ("t", [], None, None, "n.png")
    e = [("Image", None, None, None, "a.png", "", None, None, None, None, None, None), ("Image", None, None, None, "b.png", "", None, None, None, None, None, None), ("Paragraph", None, None, None, None, None, None, None, None, None, [span], None)]
    c = spark.createDataFrame([(1, e), (2, e)], f"book_id INT, content ARRAY<{ELEMENT}>")
    r = spark.createDataFrame([(1, "a.png", "S/a"), (1, "n.png", "S/n")], "book_id INT, path STRING, stored_path STRING")
    got = {x.book_id: x.content for x in catalog.rewrite_resources(c, r).collect()}
    assert [x.src for x in got[1]] == ["S/a", "b.png", None] and got[1][2].spans[0].footnoteImage == "S/n"
    assert [x.src for x in got[2]] == ["a.png", "b.png", None]


def test_small_reads(spark):
    u = spark.createDataFrame([(1, "Admin"), (2, "what"), (3, None)], "id INT, role STRING")
    assert rows(u.select(catalog.known_role(F.col("role")).alias("r"))) == [("admin",), ("guest",), ("guest",)]
    assert catalog.has_role(u.limit(0)).first().found is False
    f = spark.createDataFrame([("b", False), ("A", False), ("z", True)], "name STRING, is_dir BOOLEAN")
    assert [r.name for r in catalog.listing(f).collect()] == ["z", "A", "b"]
    p = spark.createDataFrame([("x", True, True, False), ("y", True, True, True), ("z", None, None, None)], "path STRING, exists BOOLEAN, is_dir BOOLEAN, can_read BOOLEAN")
    assert rows(catalog.path_state(p).select("path", "valid")) == [("x", False), ("y", True), ("z", False)]
    users = spark.createDataFrame([(1,), (2,)], "user_id INT")
    held = mutate.blocked_deletes(users, spark.createDataFrame([(1,)], "user_id INT"), spark.createDataFrame([(1, 2)], "created_by INT, used_by INT"))
    assert rows(held) == [(1, 2), (2, 1)]


def test_places_within_few_keys(spark):
    from librarium.operators import catalog

    rows = [("hot", i % 7, i) for i in range(300)] + [("a", 1, 900), (None, 2, 901), (None, 1, 902), ("hot", 3, 3)]
    df = spark.createDataFrame(rows, "k STRING, t INT, i INT")
    got = {}
    for r in catalog.numbered_within(df, "k", ["t", "i"], "place", parts=5).collect():
        got.setdefault(r.k, []).append((r.place, r.t, r.i))
    for k, v in got.items():
        v.sort()
        assert [p for p, _, _ in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v), k
    assert catalog.numbered_within(df.limit(0), "k", ["t"], "place").count() == 0


def test_progress_keeps_and_starts(spark):
    cur = spark.createDataFrame([(1, 1, 10.0, 5, 100, "c", None, "d", D(2024, 1, 1))], "user_id INT, book_id INT, progress DOUBLE, current_page INT, total_pages INT, cfi_location STRING, document_id STRING, device_id STRING, last_read_at TIMESTAMP_NTZ")
    e = spark.createDataFrame([(1, 1, 20.0, None, 200, None, None, D(2024, 1, 2), 1), (2, 1, 1.0, None, None, None, "dev", D(2024, 1, 3), 2), (3, 1, None, 4, None, None, None, D(2024, 1, 3), 3)], "user_id INT, book_id INT, progress DOUBLE, current_page INT, total_pages INT, cfi_location STRING, device_id STRING, ts TIMESTAMP_NTZ, event_id INT")
    got = {r.user_id: tuple(r)[2:] for r in mutate.upsert_progress(cur, e).collect()}
    assert got == {1: (20.0, 5, 200, "c", None, "d", D(2024, 1, 2)), 2: (1.0, 0, None, None, None, "dev", D(2024, 1, 3))}
