import collections
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from librarium.llm import formatting as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=300))
def test_trie(rows):
    trie, want = M.CountingTrie(), {}
    for k, i in rows:
        trie.add(k, 0, i, 1)
        a = want.setdefault(k, [i, 0])
        a[0], a[1] = min(a[0], i), a[1] + 1
    assert {k: [f, n] for k, f, n in trie.items()} == want


def test_shared():
    assert M.shared(b"abcd", b"abzz") == 2 and M.shared(b"", b"a") == 0


@pytest.mark.parametrize("nodes", [0, 10**6])
def test_splits_until_all_fit(spark, monkeypatch, nodes):
    monkeypatch.setattr(M, "NODES", nodes)  # split buckets joined by salted parts, or broadcast
    keys = [b"same", b"samea", b"sameab"] + [b"same" + bytes([65 + i % 7, 65 + i % 5, 65 + i % 11]) for i in range(400)] + [b"hot"] * 90
    active = spark.createDataFrame([(b"", k, i, 1) for i, k in enumerate(keys)], "bucket BINARY, key BINARY, first LONG, n LONG")
    rounds, fit = 0, []
    while (parts := M.split_once(active, 20)) is not None:
        fit += parts[0].collect()
        active, rounds = parts[1], rounds + 1
    rows = fit + active.collect()
    assert rounds >= 2 and sorted(bytes(r.key) for r in rows) == sorted(keys)
    held = collections.defaultdict(list)
    for r in rows:
        held[bytes(r.bucket)].append(bytes(r.key))
    assert all(len(v) <= 20 or len(set(v)) == 1 for v in held.values())
    assert len({(bytes(r.key), bytes(r.bucket)) for r in rows}) == len(set(keys))


@pytest.mark.parametrize("least", [3, 50, 10**6])
def test_counts(spark, least):
    rng = random.Random(1)
    keys = [b"hot"] * 700 + [("common prefix " + rng.choice("abc") * rng.randint(0, 9) + str(rng.randint(0, 300))).encode() for _ in range(1200)] + [b"", None, b"hotter"]
    rows = [(i, k) for i, k in enumerate(keys)] + [(None, b"no id")]
    df = spark.createDataFrame(rows, "id LONG, key BINARY").repartition(5).selectExpr("*", "1 AS first", "2 AS n", "'x' AS bucket")
    want = collections.defaultdict(list)
    for i, k in rows:
        want[k].append(i)
    got = {None if r.key is None else bytes(r.key): (r.keep_id, r.copies) for r in M.radix_counts(df, least=least).collect()}
    assert got == {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in want.items()}
    assert M.radix_counts(df.limit(0)).count() == 0


def canon(s):
    return None if s is None else "".join(c for c in s.upper().lower() if not c.isspace() and unicodedata.category(c)[0] not in "PZ" and c not in "$+<=>^`|~")


def brute(rows):
    import re

    groups = collections.defaultdict(list)
    for i, t, a, p in rows:
        key = None
        if p is not None:
            folder, _, name = p.rpartition("/")
            stem, dot, ext = name.rpartition(".")
            stem, ext = (stem, ext) if dot else (name, "")
            key = ("/".join(canon(x) for x in folder.split("/")), tuple(sorted(filter(None, (canon(x) for x in re.split("[-–—]", stem))))), canon(ext))
        groups[tuple(sorted([canon(t) or ("" if t is not None else "\0"), canon(a) or ("" if a is not None else "\0")])), key].append(i)
    return {(min(v), i) for v in groups.values() for i in v if i != min(v)}


ROWS = [
    (1, "The Road", "Ann Bo", "/lib/a b/The Road-12-Ann Bo.epub"), (2, "THE  ROAD!", "ann_bo", "/lib/A B/Ann Bo - 12 - the road.EPUB"), (3, "Ann Bo", "The Road", "/lib/ab/12 — (The Road) — Ann.Bo.epub"),
    (4, "Road The", "Ann Bo", "/lib/a b/The Road-12-Ann Bo.epub"), (5, "The Road", "Ann Bo", "/lib/c/The Road-12-Ann Bo.epub"), (6, "The Road", "Ann Bo", "/lib/a b/The Road-13-Ann Bo.epub"),
    (7, "The Road", None, "/x/y.txt"), (8, "the road", None, "/x/Y.txt"), (9, "The Road", "", "/x/y.txt"), (10, None, None, None), (11, None, None, None), (12, "Straße", "x", "/s/Straße.txt"),
    (13, "STRASSE", "X", "/s/STRASSE.txt"), (14, "Thé Road", "Ann Bo", "/lib/a b/The Road-12-Ann Bo.epub"), (15, "The Road", "Ann Bo", "/lib/a b/The Road-12-Ann Bo.txt"), (16, "x" * 50_000, "a", "/l/x"), (17, "X" * 50_000, "A", "/l/x"),
]


def test_copies(spark):
    df = spark.createDataFrame(ROWS, "id LONG, title STRING, author STRING, file_path STRING").selectExpr("*", "'k' AS key", "0 AS copies")
    got = {(r.keep_id, r.copy_id) for r in M.copies(df).collect()}
    assert got == {(1, 2), (1, 3), (7, 8), (10, 11), (12, 13), (16, 17)}
    assert {(r.keep_id, r.copy_id) for r in M.copies(df, hot=1).collect()} == got
    assert {r.keep_id: r.copies for r in M.records(df).collect()}[1] == 3
    assert M.copies(df.limit(0)).count() == 0 and M.copies(df.filter("id = 1")).count() == 0
    twice = M.copies(df.filter("id IN (1, 2)").unionByName(df.filter("id = 1"))).collect()
    assert [(r.keep_id, r.copy_id) for r in twice] == [(1, 2)]


def test_table_against_brute_force(spark, data):
    from librarium.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/books.parquet").select("id", "title", "author", "file_path").collect()]
    assert {(r.keep_id, r.copy_id) for r in QUERIES["p3_found"](spark, data).collect()} == brute(rows)


def test_hot_record(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "Same Title").otherwise(F.concat(F.lit("t"), "id")).alias("title"), F.lit("a").alias("author"), F.when(F.col("id") % 3 == 0, "/p/q.txt").otherwise(F.concat(F.lit("/p/"), "id")).alias("file_path"))
    got = M.copies(df, hot=100).collect()
    assert len(got) == 999 and {r.keep_id for r in got} == {0}
