import collections
import random

import pytest

from librarium.llm import splitting
from librarium.llm.bpe import tokenizer

LIMITS = [(1, 256, 32), (2, 512, 64), (3, 1024, 0)]


def check(df, limits, **how):
    """Everything the docstring promises, for every text and limit."""
    tok = tokenizer()
    texts = {r.doc_id: r.text for r in df.collect()}
    out = collections.defaultdict(list)
    for r in splitting.split_documents(df, limits, **how).collect():
        out[r.doc_id, r.limit_id].append(r)
    for d, t in texts.items():
        n = len(tok.encode(t or ""))
        for i, most, overlap in limits:
            ps = sorted(out.pop((d, i), []), key=lambda r: r.piece_no)
            if n <= most:
                assert not ps
                continue
            assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].start_char == 0 and ps[-1].end_char == len(t)
            for p in ps:
                assert p.piece == t[p.start_char : p.end_char] and p.n_tokens == len(tok.encode(p.piece))
                assert p.n_tokens <= most or len(p.piece) == 1, (d, i, p)
            for a, b in zip(ps, ps[1:]):
                assert b.start_char <= a.end_char < b.end_char
                assert len(tok.encode(t[b.start_char : a.end_char])) <= overlap + 2
                assert overlap or b.start_char == a.end_char
    assert not out


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    mess = "".join(rng.choice(["word ", "中文，", "。", "\n\n", "\r\n", "<p>x</p>", "it's ", "😀", "a" * 40, "  ", "“q.” "]) for _ in range(4000))
    rows = [(1, "The quick brown fox, didn't it? " * 900), (2, "中文测试" * 1500), (3, "word " * 50 + "x" * 5000 + "\n\n" + "Ende. " * 500), (4, None), (5, ""), (6, "a b"), (7, "😀" * 900), (8, mess), (9, " " * 3000 + "x"), (10, "\n" * 2000)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS piece_no", "'c' AS cut")


def test_table(spark, data):
    check(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), LIMITS)


def test_odd_texts(odd):
    check(odd, LIMITS)
    check(odd, [(1, 20, 5), (2, 7, 0), (3, 3, 1)])


def test_ranges_of_giant_texts(odd):
    check(odd, LIMITS, range_chars=3000, halo=200, spread=3000)
    check(odd, [(1, 20, 5), (2, 7, 0), (3, 3, 1)], range_chars=500, halo=50, spread=500)
    check(odd, [(1, 20, 5), (2, 7, 0)], range_chars=100, halo=10)


def test_ranges_agree_with_the_whole(odd):
    clean = odd.filter("doc_id IN (1, 3)")
    take = lambda **how: sorted(tuple(r) for r in splitting.split_documents(clean, [(3, 1024, 0)], **how).collect())
    assert take() == take(range_chars=1 << 20) == take(range_chars=2000, halo=300) == take(range_chars=2000, halo=300, spread=2000)


def test_ranges_tile_the_text():
    tok = tokenizer()
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "x" * 30, "中文，", "12", "\n\n", "  ", "it's "]) for _ in range(n)) for n in (0, 1, 10, 300, 900)] + ["y" * 2000, " " * 700 + "z", "a b" * 400 + "x" * 600]
    for size, halo in ((100, 40), (64, 3), (1000, 200)):
        for t, r in zip(texts, splitting.ranges_of(texts, tok.classes, size, halo)):
            assert "".join(r) == t
            assert [i for x in r for i in tok.encode(x)] == tok.encode(t)
        assert len(splitting.ranges_of(texts, tok.classes, size, halo)[4]) > len(texts[4]) / size / (2 if halo > 10 else 9)


def test_no_piece_is_too_large():
    """Where cut pre-tokens come out larger again and again, pieces are cut by bytes, which surely fit."""
    text = "ab" * 50
    pos, upto = list(range(0, 101, 2)), list(range(0, 51))
    rows = list(splitting.pieces_of(text, pos, upto, [5, *[0] * 49, 5], [(1, 10, 0)], lambda ts: __import__("numpy").array([len(t) for t in ts])))
    assert "".join(r[6] for r in rows) == text and max(r[4] for r in rows) <= 10


def test_cuts_are_natural(spark):
    text = "\n\n".join("One two three four five six. Seven eight nine ten." for _ in range(30))
    df = spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")
    got = splitting.split_documents(df, [(1, 40, 0)]).collect()
    assert {r.cut for r in got} == {"paragraph"}


def test_empty(spark, odd):
    assert splitting.split_documents(odd.limit(0), LIMITS).count() == 0 and splitting.split_documents(odd, []).count() == 0


def test_places_in_lots_give_the_same_pieces():
    rng = random.Random(8)
    for limit, overlap in ((20, 5), (7, 0), (50, 25)):
        pos = sorted(rng.sample(range(20_000), 3000))
        upto = [0]
        for _ in pos[1:]:
            upto.append(upto[-1] + rng.randint(0, 6))
        good = [rng.randint(0, 5) for _ in pos]
        want = splitting.choose(list(pos), list(upto), list(good), limit, overlap)
        c, got, at = splitting.Chooser(limit, overlap), [], 0
        c.KEEP = 50
        while at < len(pos):
            to = min(len(pos), at + rng.randint(1, 200))
            got += c.feed(pos[at:to], upto[at:to], good[at:to], to == len(pos))
            at = to
        assert got == want and len(c.pos) < 1000


def test_files_are_split_as_texts(spark, tmp_path, odd):
    texts = {r.doc_id: r.text for r in odd.collect() if r.text}
    for i, t in texts.items():
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    paths = [str(p) for p in tmp_path.iterdir()]
    tok = tokenizer()
    for limits in (LIMITS, [(1, 20, 5)]):
        for size, halo in ((997, 300), (1 << 20, 1 << 10)):
            got = collections.defaultdict(list)
            for r in splitting.split_files(spark, paths, limits, range_bytes=size, halo=halo).collect():
                got[int(r.path.rsplit("/", 1)[1][:-4]), r.limit_id].append(r)
            for (i, limit), ps in got.items():
                ps.sort(key=lambda r: r.piece_no)
                most = {x: m for x, m, _ in limits}[limit]
                assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].start_char == 0 and ps[-1].end_char == len(texts[i])
                assert all(p.piece == texts[i][p.start_char : p.end_char] and (p.n_tokens == len(tok.encode(p.piece)) <= most or len(p.piece) == 1) for p in ps), (i, limit, size)
                assert all(b.start_char <= a.end_char < b.end_char for a, b in zip(ps, ps[1:]))
            assert set(got) == {(i, x) for i, t in texts.items() for x, m, _ in limits if len(tok.encode(t)) > m}
    assert splitting.split_files(spark, paths, []).count() == 0 and splitting.split_files(spark, [], LIMITS).count() == 0
