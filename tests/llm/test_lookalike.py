import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from librarium.llm import lookalike as M

SAME = [
    ("Bridge", "Вridgе"), ("Joseph Boban", "Joseph B‍oban"), ("Chloé", "Chloé"), ("Rupert", "Ｒｕｐｅｒｔ"), ("a b", "a b"), ("山月", "⼭⽉"), ("老林", "老林"), ("山月", "⼭‌⽉"),
    ("Ёлка", "Ёлка"), ("Kat", "Κаt"), ("ẹ́x", "ẹ́x"), ("office", "oﬃce"), ("Сорт 1", "Copт １"), ("", "﻿"), ("x­y", "xy"),
]
DIFFERENT = [("Ab", "ab"), ("a.b", "a b"), ("a b", "a  b"), ("a\tb", "a b"), ("é", "e"), ("（a）", "(a)"), ("a–b", "a-b"), ("1²", "12"), ("…", "..."), ("你", "您")]


def test_pairs():
    for a, b in SAME:
        assert M.skeleton(a) == M.skeleton(b) and M.consistent(a) == M.consistent(b), (a, b)
    for a, b in DIFFERENT:
        assert M.skeleton(a) != M.skeleton(b), (a, b)


def test_consistent_keeps_scripts():
    assert M.consistent("Верхняя карта") == "Верхняя карта" and M.consistent("Вridgе") == "Bridge" and M.consistent("Βιβλίο") == "Βιβλίο"
    assert M.consistent("Հայոց") == "Հայոց" and M.consistent("ᏣᎳᎩ") == "ᏣᎳᎩ" and M.consistent("ⲁⲟⲣ") == "ⲁⲟⲣ"
    assert M.consistent("می‌خ") == "می‌خ"  # the joiner has a look there


def whole(text):
    """The same without any splicing: every character is treated."""
    return M._canonical_segment(text, 0, len(text))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ae ẹ́́​ АеЁｅＡ⼭山가각ﬁx.\t‍", max_size=14))
def test_splicing_equals_whole_text(text):
    once = M.skeleton(text)
    assert once == whole(text) and M.skeleton(once) == once and unicodedata.is_normalized("NFC", once)


def test_same_look(spark):
    rows = [(1, "Bridge", "A B"), (2, "Вridge", "A B"), (3, "Bridge", "A B"), (4, "Bridge", "a B"), (5, None, "x"), (6, "Bridge", None), (7, "Bridge", "A B"), (8, "", ""), (9, "", "​"), (2, "Вridge", "A B")]
    df = spark.createDataFrame(rows, "id LONG, title STRING, author STRING").selectExpr("*", "1 AS look", "2 AS spelling")
    got = {(r.id_a, r.id_b) for r in M.same_look(df, ["title", "author"]).collect()}
    brute = set()
    for (i, t, a), (j, u, b) in itertools.combinations([r for r in set(rows) if None not in r], 2):
        if M.skeleton(t) == M.skeleton(u) and M.skeleton(a) == M.skeleton(b) and (t, a) != (u, b):
            brute.add((min(i, j), max(i, j)))
    assert got == brute == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7), (8, 9)}
    assert M.same_look(df.limit(0), ["title", "author"]).count() == 0
    n = M.normalized(df, ["title", "author"])
    assert n.columns == [*df.columns, "title_norm", "author_norm"] and n.count() == 10


def test_shared_spelling_makes_no_pairs(spark):
    df = spark.range(2000).selectExpr("id", "'Same' AS title", "'One' AS author").unionByName(spark.createDataFrame([(9999, "Sаme", "One")], "id LONG, title STRING, author STRING"))
    assert M.same_look(df, ["title", "author"]).count() == 2000


def test_long(spark):
    df = spark.createDataFrame([(1, "Ａ" * 100_000, "x"), (2, "A" * 100_000, "x")], "id LONG, title STRING, author STRING")
    assert M.same_look(df, ["title", "author"]).count() == 1


def test_scripts_beside_those_of_the_tables():
    for t in ("𝐀nna", "𝒜nna", "Ⓐnna", "Ꭺnna", "ꓮnna", "Ⲁnna", "Αnna"):
        assert M.skeleton(t) == "Anna", t
    assert M.skeleton("ꜱᴏᴄ") == "soc" and M.skeleton("Ⅻ") == "XII" and M.skeleton("ⅼ") == "l"
    for a, b in ((M.CYRILLIC, M.CYRILLIC_LIKE), (M.GREEK, M.GREEK_LIKE), (M.OTHER, M.OTHER_LIKE), (M.COPTIC, M.COPTIC_LIKE), (M.CHEROKEE, M.CHEROKEE_LIKE), (M.LISU, M.LISU_LIKE), (M.SMALL_CAPITALS, M.SMALL_CAPITALS_LIKE)):
        assert len(a) == len(b) == len(set(a))


def test_classes_agree_with_pairs(spark, data):
    import collections

    df = spark.read.parquet(f"{data}/books.parquet").select("id", "title", "author")
    links = collections.Counter(i for r in M.same_look(df, ["title", "author"]).collect() for i in r)
    got = {r.id: r for r in M.look_classes(df, ["title", "author"]).collect()}
    assert {i: r.links for i, r in got.items()} == dict(links) and len(got) > 0
    assert all(r.class_id <= i and got[r.class_id].class_id == r.class_id for i, r in got.items())
    assert M.look_classes(df.limit(0), ["title", "author"]).count() == 0
