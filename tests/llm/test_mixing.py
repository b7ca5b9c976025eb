import pytest

from librarium.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big" if i % 3 else "small", "word " * (1 + i % 40)) for i in range(600)] + [(9000, "small", None), (9001, "small", ""), (9002, None, "x y"), (9003, "unlisted", "x"), (5, "big", "word word")]
    return spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING").selectExpr("*", "0 AS key", "1 AS range", "2 AS copies")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.0, 1)], "source STRING, target_share DOUBLE, max_repeat INT")


def test_shares(docs, targets):
    m = mixing.mixture(docs, targets)
    got = {r.source: r for r in mixing.shares(m, targets).collect()}
    assert set(got) == {"big", "small", "none"} and got["none"].tokens == 0
    assert abs(got["big"].actual_share - 5 / 9) < 0.01 and abs(got["small"].actual_share - 4 / 9) < 0.01  # the share of "none" is spread
    rows = m.collect()
    assert max(r.copies for r in rows if r.source == "big") == 1 and max(r.copies for r in rows) <= 3
    assert not {r.doc_id for r in rows} & {9000, 9001, 9002, 9003}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(docs, targets).collect()))  # the same every time
    assert mixing.expand_copies(m).count() == sum(r.copies for r in rows)


def test_total_is_met(docs, targets):
    m = mixing.mixture(docs, targets, total_tokens=2000)
    per = {r.source: r.tokens for r in mixing.shares(m, targets).collect()}
    assert abs(per["big"] - 2000 * 5 / 9) <= 20 and abs(per["small"] - 2000 * 4 / 9) <= 20  # half a document at most


def test_rows_that_repeat_an_id_are_parted(spark):
    rows = [(7, "hot", "word " * 10)] * 400 + [(None, "void", "word " * (1 + i % 20)) for i in range(400)] + [(i, "plain", "word " * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING")
    targets = spark.createDataFrame([("hot", 1.0, 1), ("void", 1.0, 1), ("plain", 1.0, 1)], "source STRING, target_share DOUBLE, max_repeat INT")
    m = mixing.mixture(df, targets, total_tokens=3000)
    per = {r.source: r.tokens for r in mixing.shares(m, targets).collect()}
    most = {r.source: r.n for r in mixing.mixture(df, targets, total_tokens=10**9).groupBy("source").agg({"n_tokens": "max"}).toDF("source", "n").collect()}
    assert all(abs(per.get(s, 0) - 1000) <= most[s] / 2 for s in most), per
    part, mixing.PART = mixing.PART, 7
    try:
        again = mixing.mixture(df.repartition(7), targets, total_tokens=3000)
        assert sorted(map(str, again.collect())) == sorted(map(str, m.collect()))  # whatever the layout
    finally:
        mixing.PART = part


def test_too_large_a_total_takes_what_there_is(docs, targets):
    m = mixing.mixture(docs, targets, total_tokens=10**9)
    assert {(r.source, r.copies) for r in m.select("source", "copies").distinct().collect()} == {("big", 1), ("small", 3)}


def test_empty(docs, targets):
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mixture(docs.limit(0), targets), targets).count() == 3
