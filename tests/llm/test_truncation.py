import random

import pytest
from pyspark.sql import functions as F

from librarium.llm import truncation as M

SUBJECT = ["The keeper", "An old surgeon", "The widow", "Her brother", "A stranger in grey"]
VERB = ["opened", "buried", "counted", "forgot", "sold"]
OBJECT = ["the third ledger", "a brass compass", "two empty lanterns", "the sealed letter"]
WHERE = ["in the flooded cellar", "beside the weir", "near the salt pans", "under the stairs"]


def sentence(rng):
    end = rng.choice([".", ".", ".", "!"])
    body = f"{rng.choice(SUBJECT)} {rng.choice(VERB)} {rng.choice(OBJECT)} {rng.choice(WHERE)}"
    return f"“{body},” said {rng.choice(SUBJECT).lower()}{end}" if rng.random() < 0.3 else body + end


@pytest.fixture(scope="module")
def texts(spark):
    """Texts made of sentences; some cut inside, some ending with a remark or in markup."""
    rng = random.Random(7)
    rows, cut = [], set()
    for i in range(3000):
        t = " ".join(sentence(rng) for _ in range(rng.randint(2, 6)))
        kind = rng.random()
        if kind < 0.12:
            n = rng.randint(20, len(t) - 5)
            while t[n - 1] in ".!” " or t[n] in ".!”":
                n -= 1
            t, _ = t[:n] + rng.choice(["", "", "..."]), cut.add(i)
        elif kind < 0.2:
            t += f"\n\nRevised edition with {rng.randint(1, 40)} plates"
        elif kind < 0.3:
            t = f"<p>{t}</p>"
        rows.append((i, rng.choice(["a", "b"]), t))
    rows += [(9001, "a", None), (9002, "b", ""), (9003, "b", "“The keeper ope�")]
    cut.add(9003)
    df = spark.createDataFrame(rows, "meta_id LONG, source STRING, description STRING").selectExpr("*", "1 AS rank", "2 AS context", "3 AS key")
    return df, cut


def test_held_out_accuracy(texts):
    df, cut = texts
    got = {r.meta_id for r in M.truncated(df).filter("cut").collect()}
    assert len(got & cut) / len(cut) > 0.93 and len(got & cut) / len(got) > 0.93


def test_shares(texts):
    df, _ = texts
    flags = M.truncated(df)
    got = {r.source: r for r in M.shares(df, flags).collect()}
    assert sum(r.texts for r in got.values()) == 3002 and sum(r.cut for r in got.values()) == flags.filter("cut").count()
    assert all(r.share == r.cut / r.texts for r in got.values())


def test_counts_by_hand(spark):
    df = spark.createDataFrame([("aab",), ("cab",), ("abx",)], "t STRING")
    ranked = M.last_contexts(df.select(F.monotonically_increasing_id().alias("k"), "t"), "k", "t", [])
    counts = {r.key: (r.ends, r.goes_on) for r in M.count_contexts(df, "t", [], M.ending_filter(ranked.select("context"), 3)).collect()}
    key = int(M.Contexts(["aab"]).keys(__import__("numpy").array([4]), 2, 0)[0][0])
    assert counts[key] == (2, 1)  # "ab" ends two texts and goes on in one


def test_edges(spark, texts):
    df, _ = texts
    assert M.truncated(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000), (2, "x. " * 10), (1, "x " * 200_000)], "meta_id LONG, description STRING")
    assert M.truncated(long).count() >= 2
    assert M.trimmed("a...") == "a" and M.trimmed("...") == "..."
    assert M.language("第二天夜里") == "zh" and M.language("der Hund und die Katze") == "de" and M.language("12") == "other"


def test_tails_have_the_contexts_of_whole_texts():
    import numpy as np

    rng, known = random.Random(3), {"The", "Her"}
    texts = ["".join(rng.choice(["The ", "Adelheidegunde ", "her ", "“q” ", "« ", "<p>x</p>", "<p>", "12", "x", "\n", "第", ". "]) for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["a", "X" * 500]
    texts = [M.trimmed(t) for t in texts]
    state = np.array([M._open_at_end(t) for t in texts], np.uint64)
    for kind, lengths, ends, whole in ((0, M.LENGTHS, [t[-16:] for t in texts], texts), (1, M.NAMED, [M._tail(t, known) for t in texts], [M.named(t, known) for t in texts])):
        a, b = M.Contexts(ends, state), M.Contexts(whole)
        for n in lengths:
            (x, ok_x), (y, ok_y) = a.keys(a.end, n, kind), b.keys(b.end, n, kind)
            assert (ok_x == ok_y).all() and (x[ok_x] == y[ok_y]).all(), (kind, n)


def test_hot_ends_and_repeats_give_the_same(texts, monkeypatch):
    df, _ = texts
    both = df.unionByName(df)
    once = sorted((r.meta_id, round(r.odds, 9), r.cut) for r in M.truncated(df).filter("odds IS NOT NULL").collect())
    monkeypatch.setattr(M, "HOT", 20)
    again = sorted({(r.meta_id, round(r.odds, 9), r.cut) for r in M.truncated(both).filter("odds IS NOT NULL").collect()})
    assert [x[0] for x in once] == [x[0] for x in again] and [x[1] for x in once] == [x[1] for x in again]


def test_inner_contexts_against_single_ones():
    import numpy as np

    rng = random.Random(9)
    texts = ["".join(rng.choice("ab“ <p>") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for kind, lengths in ((0, M.LENGTHS), (1, M.NAMED)):
        c = M.Contexts(texts)
        inner = np.ones(len(c.cps) + 1, bool)
        inner[c.end] = inner[c.begin] = False
        inner = np.flatnonzero(inner)
        bits = np.random.default_rng(1).integers(0, 256, 1 << 10, dtype=np.uint8) | np.uint8(0x77)
        for n, got in zip(lengths, c.inner(lengths, kind, bits)):
            key, ok = c.keys(inner, n, kind)
            low = key & (8 * len(bits) - 1)
            ok &= (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
            inner = inner[ok]
            assert (got == key[ok]).all(), (kind, n)
