import random
import time

import pytest

from librarium.llm import bpe


@pytest.fixture(scope="module")
def tok():
    return bpe.tokenizer()


@pytest.fixture(scope="module")
def truth():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


CASES = ["", " ", "  ", "\n\n x", "it's we'll they're I'd 'sab ''s 's", " 's", "don't\n't", "x" * 500, "中文" * 400, "áé \x85  \x1cz", "😀👍🏽 <|endoftext|>", "0123 4567", "　　a", "tab\tq\r\n", "'"]


def test_cases(tok, truth):
    for c in CASES:
        assert tok.encode(c) == truth(c), c


def test_random(tok, truth):
    rng = random.Random(3)
    letters = "ab 'sStTremvld\n\t\r .,!?12３é中文　\xa0 ́​😀<>\x1c\x85  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    offsets, flat = tok.encode_many(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == truth(t), t
    assert tok.count_many(texts).tolist() == [len(truth(t)) for t in texts]


def scan(word, ranks):
    """Merge the lowest rank, from the left, until there is none."""
    piece = [word[i : i + 1] for i in range(len(word))]
    while len(piece) > 1:
        low, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(piece, piece[1:])))
        if low == 1 << 30:
            break
        piece[i : i + 2] = [piece[i] + piece[i + 1]]
    return [ranks[x] for x in piece]


def test_queue_and_scan_agree(tok):
    rng = random.Random(5)
    for _ in range(400):
        w = bytes(rng.choice(b"abcdeth \xe4\xb8\xad") for _ in range(rng.randint(1, 90)))
        assert tok.merger.ids(w) == ([tok.ranks[w]] if w in tok.ranks else scan(w, tok.ranks))
        assert not any(tok.merger.words)  # the queue is empty again


def test_very_long_word_is_near_linear(tok):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    began = time.time()
    ids = tok.encode(word)
    assert time.time() - began < 20
    token = {v: k for k, v in tok.ranks.items()}
    assert b"".join(token[i] for i in ids) == word.encode()


def test_store_is_bounded(monkeypatch):
    t = bpe.Tokenizer()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    for i in range(40):
        text = " ".join(f"w{i}q{j}" for j in range(20))
        assert t.encode(text) == bpe.tokenizer().encode(text)
    assert t.words < 150


def test_frame(spark, truth):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "z", "x"), (1, "a b", "x"), (4, "long " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, ids STRING")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()), key=repr)
    assert got == sorted(((k, truth(t or "")) for k, t, _ in rows), key=repr)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe.count_tokens(df.select("doc_id", "text")).collect()) == sorted((k or 0, len(truth(t or ""))) for k, t, _ in rows)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_whole_table(spark, data, truth):
    from librarium.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p8_ids"](spark, data).collect()}
    assert got == {k: truth(t or "") for k, t in texts.items()}


def test_pairs_are_bounded(tok, monkeypatch):
    monkeypatch.setattr(bpe.Pairs, "MOST", 10)
    m = bpe.Merger(tok.ranks)
    for w in (b"abracadabra", b"hocuspocusxyz", "中文测试".encode()):
        assert m.ids(w) == tok.merger.ids(w) and len(m.pairs) <= 10
