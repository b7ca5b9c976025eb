import collections
import itertools
import math
import random

from librarium.llm.cooccurrence import cooccurrence


def brute(rows, min_pairs=1, min_share=0.0, min_lift=0.0):
    sets = collections.defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            sets[b].add(i)
    n, one, two = len(sets), collections.Counter(), collections.Counter()
    for s in sets.values():
        one.update(s)
        two.update(itertools.combinations(sorted(s), 2))
    return {
        (a, b): (k, one[a], one[b], n, round(math.log2(k * n / one[a] / one[b]), 6))
        for (a, b), k in two.items() if k >= min_pairs and k >= min_share * n and k * n >= min_lift * one[a] * one[b]
    }


def test_counts(spark):
    rng = random.Random(1)
    rows = [(b, rng.choice("abcdefgh") if rng.random() < 0.9 else "rare" + str(rng.randint(0, 40))) for b in range(300) for _ in range(rng.randint(0, 5))] + [(b, "hot") for b in range(300)]
    rows += [(None, "a"), (5, None), (7, "中"), (7, "é"), (8, ""), (8, "a")]
    df = spark.createDataFrame(rows, "basket INT, item STRING").repartition(5).selectExpr("*", "1 AS _b", "2 AS n", "'x' AS item_a")
    for how in ({}, {"min_pairs": 5}, {"min_share": 0.05}, {"min_pairs": 3, "min_share": 0.01, "min_lift": 1.2}):
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, round(r.pmi, 6)) for r in cooccurrence(df, "basket", "item", **how).collect()}
        assert got == brute(rows, **how), how
    assert cooccurrence(df.limit(0), "basket", "item").count() == 0
    assert cooccurrence(df.filter("item = 'hot'"), "basket", "item").count() == 0


def test_table(spark, data):
    from librarium.llm.queries import QUERIES, single_tags

    rows = [tuple(r) for r in single_tags(spark, data).collect()]
    got = {(r.tag_a, r.tag_b) for r in QUERIES["p7_found"](spark, data).collect()}
    assert got == set(brute(rows, 5, 0.005, 4))
