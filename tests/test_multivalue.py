from hypothesis import given, settings
from hypothesis import strategies as st

from librarium.operators import multivalue as M

KNOWN = ["either/or plots", "essays, short", "mother/daughter"]


def split(text, known=KNOWN):
    return M.Segmenter(known).split(text)


def test_cases():
    assert split("a, b;c") == ["a", "b", "c"]
    assert split('"Essays, Short"; x | “y z”') == ["Essays, Short", "x", "y z"]
    assert split("Either/Or plots / x") == ["Either/Or plots", "x"]
    assert split("x,Essays, Short") == ["x", "Essays, Short"]
    assert split("either/or plots", []) == ["either", "or plots"]
    assert split(" , ,a ,, ") == ["a"]
    assert split("arms & letters，read-aloud、no. 7 shelf") == ["arms & letters", "read-aloud", "no. 7 shelf"]
    assert split('a "quoted, inside" b, c') == ['a "quoted', 'inside" b', "c"]
    assert split('"open, x') == ['"open', "x"]
    assert split("") == [] and split("   ") == [] and split('""') == []
    assert split("x\t\n y") == ["x", "y"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b c", "either/or plots", "mother/daughter", "poets' corner"]), min_size=1, max_size=6), st.sampled_from([",", " ; ", "|", "，", " / ", "\n"]), st.booleans())
def test_joined_values_come_back(values, mark, quote):
    text = mark.join(f'"{v}"' if quote and i % 2 else v for i, v in enumerate(values))
    assert split(text) == values


def test_frame(spark):
    rows = [(1, 0, "a, b"), (2, 0, "alone"), (3, 0, None), (4, 0, ""), (5, 1, "x/y, z"), (6, 0, "x/y"), (7, 0, "x/y"), (8, 0, '"p, q"'), (9, 0, '"p, q"'), (1, 0, "a, b"), (10, 0, "p, q; r")]
    df = spark.createDataFrame(rows, "row_id INT, elem INT, text STRING").selectExpr("*", "'clash' AS pos", "1 AS _row")
    got = sorted((r.row_id, r["pos"], r.item) for r in M.split_values(df, keep=["row_id", "elem"]).collect())
    want = [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (5, 0, "x/y"), (5, 1, "z"), (10, 0, "p, q"), (10, 1, "r")]
    assert got == sorted(want)
    every = M.split_values(df, keep=["row_id"], everything=True)
    assert {r.item for r in every.collect()} == {"a", "b", "alone", "x/y", "z", "p, q", "r"}
    assert M.split_values(df.limit(0), keep=["row_id"]).count() == 0


def test_large_dictionaries_join_instead(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["x/y, z", "x/y", "X/Y", "x / y", '"p, q"', '"p, q"', "p, q; r", "long, x/y;p, q"])]
    df = spark.createDataFrame(rows, "row_id INT, text STRING")
    take = lambda: sorted((r.row_id, r["pos"], r.item) for r in M.split_values(df, keep=["row_id"]).collect())
    small = take()
    monkeypatch.setattr(M, "DICTIONARY_CHARS", 0)
    assert take() == small and (7, 2, "p, q") in small


def test_rare_values_stay_known_in_large_tables(spark):
    rare = spark.createDataFrame([("x/y",), ("x/y",), ('"p, q"',), ('"p, q"',), ("once/only",)], "text STRING")
    many = spark.range(2_500_000).selectExpr("concat('w', id % 10) AS text").unionByName(rare)
    assert {(r.value, r.n) for r in M.dictionary(many).collect()} == {("x/y", 2), ("p, q", 2)}


def test_two_values_are_not_one(spark):
    df = spark.createDataFrame([("a/b",), ("a/b",), ("a",), ("a",), ("a",), ("b",), ("b",), ("b",)], "text STRING")
    assert M.dictionary(df).count() == 0


def test_file_names(spark):
    p = ["/a/T-12-Au-x,y.epub", "/a/T - 12 - Au - x, y.epub", "/a/T-12-Au.epub", "/a/scan_1.txt", "/a/V. 3-12-Au-read-aloud,x.txt", None, "/a/T-x-Au-y.epub"]
    df = spark.createDataFrame([(x,) for x in p], "p STRING")
    got = [r[0] for r in df.select(M.file_name_section(df.p)).collect()]
    assert [g and g.strip() for g in got] == ["x,y", "x, y", None, None, "read-aloud,x", None, None]


def test_both_ways_agree_on_the_table(spark, data, monkeypatch):
    from librarium.plans.registry import QUERIES

    take = lambda: sorted(map(tuple, QUERIES["p5_values"](spark, data).collect()))
    sent = take()
    monkeypatch.setattr(M, "DICTIONARY_CHARS", -1)  # the known values are joined instead
    assert take() == sent and len(sent) > 100
