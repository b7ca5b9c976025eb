"""Garbled text from wrong character encoding (problem 4): best-first search back to the original text.

A state is a word. Steps undo one misreading: encode with the encoding it was wrongly read in, decode with the one it
was written in, or unescape entities. States are visited once, the cheapest first, until none is left; the cost of a
word is how unlikely its characters follow each other in the corpus, the spaces around it included. All these encodings
leave a space alone and keep no state, so what can be reached from a text is what can be reached from its words, and
the cheapest text is the one of the cheapest words. A value is garbled if a much cheaper text is reachable, or if it
holds characters that only damage leaves behind.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.session import checkpoint, spread

#: Encodings a text may have been read in by mistake, and those it may have been written in.
READ_AS = ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "gb18030", "cp950", "big5hkscs", "shift_jis", "euc_jp", "euc_kr"]
WRITTEN_IN = ["utf_8", "cp1252", "cp1251", "gb18030", "big5hkscs", "shift_jis", "euc_kr"]
#: Pairs of characters rarer than this share of all pairs are left out of the model, which bounds its size to 1/SHARE.
SHARE = 2e-6
#: A text is garbled if a reachable one costs less by this much (natural logarithm).
MARGIN = 5.0
#: What each misreading after the first one costs. A step must lower the cost with that; undoing a misreading does, so
#: clean words end after one state, and as a chain cannot be longer than the cost over FURTHER, every search ends by itself.
FURTHER = 2.0
#: A word whose best reading gains less than this stays as it is; many such gains in a long text tell nothing.
LEAST = 1.0
#: Searches, each with a model of what the one before left as clean.
ROUNDS = 2
#: What it costs that a Latin letter stands beside a symbol or a letter of another script, whatever the corpus says.
MIXED = 5.0
#: Words a worker keeps the result of; beyond that it begins anew.
CACHE = 400_000
_EDGE = "\x02"
_SUSPECT = re.compile("[�-\x80-\x9f\U000f0000-\U0010ffff]|[^\x00-\x7f]�")
_ENTITY = re.compile(r"&(#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});")


def damaged(text: str) -> bool:
    """Replacement marks, control characters, private and unassigned code points: left only by a wrong reading."""
    return bool(_SUSPECT.search(text)) or any(unicodedata.category(c) == "Cn" for c in text if not c.isascii())


def misread_utf8(text: str) -> bool:
    """UTF-8 in another encoding's clothes: its bytes are so regular that a clean text hardly ever passes."""
    return not text.isascii() and any(not w.isascii() and _misread_word(w) for w in text.split())


@lru_cache(maxsize=CACHE)
def _misread_word(word: str) -> bool:
    for read in ("cp1252", "cp1251", "mac_roman", "cp437", "gb18030"):
        b = _encode(word, read)
        t = None if b is None else _decode(b, "utf_8")
        if t is not None and t != word and len(t) < len(word):
            return True
    return False


_PAIRS = T.StructType([T.StructField("pair", T.StringType()), T.StructField("n", T.LongType())])


def character_pairs(values: DataFrame, column: str = "text") -> DataFrame:
    """(pair, n): how often two characters follow each other, with the ends of a text as a character.

    Counted over all values, except those that show damage by themselves. Each task counts in sorted arrays and hands on
    a pair once for some hundred thousand characters; then one shuffle of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and (t.isascii() or not (_SUSPECT.search(t) or misread_utf8(t)))]
            cps = np.frombuffer("".join(f"{_EDGE}{t}{_EDGE}" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            both = cps[:-1] << np.uint64(21) | cps[1:]
            edge = np.uint64(ord(_EDGE))
            pair, n = np.unique(both[both != (edge << np.uint64(21) | edge)], return_counts=True)
            text = [chr(p >> 21) + chr(p & 0x1FFFFF) for p in pair.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(n.astype(np.int64))], names=_PAIRS.names)

    return values.select(column).mapInArrow(run, _PAIRS).groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(pairs: DataFrame, share: float = SHARE) -> dict[str, int]:
    """The pairs that make up `share` of all at least: at most 1/share of them, so they may come to the driver."""
    total = pairs.agg(F.sum("n").alias("n")).first()["n"] or 0
    return {r.pair: r.n for r in pairs.filter(F.col("n") >= max(1.0, total * share)).toLocalIterator()}


def mixed(pair: str) -> bool:
    """A Latin letter beside a symbol or a letter of another script; an opening mark before a small letter."""
    a, b = pair
    if a in "¡¿" and b.islower():
        return True
    if a.isascii() and b.isascii():
        return False
    x, y = _side(a), _side(b)
    return x != y and x != "" and y != ""


@lru_cache(maxsize=CACHE)
def _side(c: str) -> str:
    if ord(c) < 0x250 and c.isalpha() and c not in "ªº":
        return "latin"
    if c.isascii():
        return ""
    return "other" if unicodedata.category(c) in ("Sm", "So", "Sk", "Sc", "Lm", "No", "Lo", "Lu", "Ll") or c in "·§¶†‡•‰" else ""


class Model:
    """Cost of a text: minus the logarithm of its pairs' likelihood, with single characters and kinds as a fall-back."""

    def __init__(self, pairs: dict[str, int]):
        self.first: dict[str, int] = {}
        for p, n in pairs.items():
            self.first[p[0]] = self.first.get(p[0], 0) + n
        second: dict[str, int] = {}
        for p, n in pairs.items():
            second[p[1]] = second.get(p[1], 0) + n
        self.total = sum(pairs.values()) or 1
        self.second, self.pairs = second, pairs
        self.singles: dict[str, float] = {}
        self.known: dict[str, float] = {}
        self.words: dict[tuple[str, bool, bool], tuple[str, float]] = {}

    def _single(self, c: str) -> float:
        """Likelihood of a character: from the corpus, and a little from its kind. Symbols and rare scripts get least."""
        if (v := self.singles.get(c)) is not None:
            return v
        k = unicodedata.category(c)
        base = 2e-6 if k[0] == "L" and ord(c) < 0x250 else 2e-7 if k[0] == "L" else 1e-6 if k[0] == "N" or c in " .,:;!?'\"()-’“”" else 2e-9 if k[0] == "C" or c == "�" else 5e-8
        v = self.singles[c] = 0.95 * self.second.get(c, 0) / self.total + base
        return v

    def pair(self, p: str) -> float:
        v = self.known.get(p)
        if v is None:
            n = self.first.get(p[0], 0)
            seen = self.pairs.get(p, 0) / n if n else 0.0
            w = n / (n + 20.0)
            a, b = p
            like = 0.0  # letters follow each other in the other case much as they do in this one
            if (low := p.lower()) != p or p.upper() != p:
                for q in {low, a.upper() + b.lower(), p.upper()} - {p}:
                    if len(q) == 2 and (k := self.pairs.get(q, 0)):
                        like = max(like, 0.02 * k / self.first[q[0]])
            v = -math.log(0.9 * w * seen + (1 - 0.9 * w) * (self._single(p[1]) + like)) + (MIXED if mixed(p) else 0.0)
            if len(self.known) < 500_000:
                self.known[p] = v
        return v

    def cost(self, text: str, bound: float = math.inf) -> float:
        """Of a text with the characters that stand around it; once it passes the bound it is not added up further."""
        total, known, pair, p = 0.0, self.known, self.pair, ""
        for p in map(str.__add__, text, text[1:]):
            v = known.get(p)
            total += pair(p) if v is None else v
            if total >= bound:
                break
        return total


def _encode(text: str, encoding: str) -> bytes | None:
    if "�" in text:
        return None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1251"):
            return None
        out = bytearray()  # bytes that the code page leaves open were passed through as control characters
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if 0x80 <= ord(c) < 0xA0:
                    out.append(ord(c))
                else:
                    return None
        return bytes(out)


#: Bytes beyond ASCII as UTF-8 has them; what does not look so need not be decoded to fail.
_UTF8 = re.compile(rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*\Z")


def _decode(data: bytes, encoding: str) -> str | None:
    if encoding == "utf_8" and not _UTF8.match(data):
        return None
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=CACHE)
def _pages(c: str) -> int:
    """The encodings of READ_AS that have a character, one bit each."""
    return sum(1 << i for i, read in enumerate(READ_AS) if _encode(c, read) is not None)


def steps(word: str) -> Iterator[str]:
    """Words that are one misreading away."""
    if _ENTITY.search(word):
        yield html.unescape(word)
    if word.isascii():
        return
    seen = set()
    can = ~0
    for c in word:
        if c >= "\x80":
            can &= _pages(c)
            if not can:
                return
    for i, read in enumerate(READ_AS):
        data = _encode(word, read) if can >> i & 1 else None
        if data is None or data in seen:
            continue
        seen.add(data)
        for written in WRITTEN_IN:
            t = _decode(data, written)
            if t is not None and t != word:
                yield t


def _printable(text: str) -> bool:
    return not any(c in "�" or (ord(c) < 32 and c not in "\t\n\r") or 0x7F <= ord(c) < 0xA0 for c in text)


def _keeps_ascii(text: str, t: str) -> bool:
    """ASCII reads the same in all these encodings; only as second bytes of ideographs may it appear or vanish."""
    if any(0x2E80 <= ord(c) < 0xFB00 for c in text + t) or _ENTITY.search(text):
        return True
    return [c for c in text if c < "\x80"] == [c for c in t if c < "\x80"]


_ASCII_HEAD = re.compile(r"[\x00-\x7f]*")


def restore_word(word: str, left: str, right: str, model: Model) -> tuple[str, float]:
    """The cheapest reachable word that can be read, and what it gains, with the characters that stand around the word."""
    start = model.cost(left + word + right)
    best, best_cost = word, start
    seen, heap = {word}, [(start, 0, word)]
    while heap:
        cost, depth, w = heapq.heappop(heap)
        if cost < best_cost and _printable(w) and _keeps_ascii(word, w):
            best, best_cost = w, cost
        price = FURTHER * depth
        # no step changes what stands before the first character beyond ASCII, but for entities
        head = _ASCII_HEAD.match(w)[0] if not _ENTITY.search(w) else ""
        same, joint, n = model.cost(left + head), (left + head)[-1], len(head)
        for nxt in steps(w):
            if nxt not in seen:
                seen.add(nxt)
                c = same + model.cost(joint + nxt[n:] + right, cost - price - same) + price
                if c < cost:
                    heapq.heappush(heap, (c, depth + 1, nxt))
    return best, start - best_cost


def restore(text: str, model: Model) -> tuple[bool, str, bool]:
    """(garbled, best text, recovered). The best text is the value itself where nothing much cheaper is reachable."""
    if text.isascii() and not _ENTITY.search(text):
        return False, text, False
    words, gain = text.split(" "), 0.0
    last = len(words) - 1
    for i, w in enumerate(words):
        if not w.isascii() or _ENTITY.search(w):
            at = (w, i == 0, i == last)
            if (known := model.words.get(at)) is None:
                if len(model.words) > CACHE:
                    model.words.clear()
                known = model.words[at] = restore_word(w, _EDGE if i == 0 else " ", _EDGE if i == last else " ", model)
            if known[1] >= LEAST:
                words[i] = known[0]
                gain += known[1]
    best = " ".join(words)
    better = best != text and gain > MARGIN
    return damaged(text) or better, best if better else text, better and not damaged(best)


def garbled(df: DataFrame, fields: list[str], key: str = "meta_id", keep_clean: bool = False) -> DataFrame:
    """(key, field, value, restored, recovered) of every garbled value of `fields`.

    restored is the cheapest text the search reached; recovered says whether it is free of damage. A value that lost
    characters for good (replacement marks) is garbled, its restored text is the best there is, recovered is false.

    Defined results: null and empty values are never garbled; texts of any length are searched whole; rows that repeat
    give equal rows. The model is counted over all values of all fields; the search runs once for each distinct value
    that holds anything but plain ASCII or an entity, so a value that a third of the rows share costs one search; in a
    worker each distinct word is searched once. No bound is set on states or steps.
    """
    long = df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("v")).select(key, "v.field", "v.value")
    long = checkpoint(long.filter("value IS NOT NULL AND value <> ''"))
    found = search(long.select("value"), long.select(F.col("value").alias("text")))
    return long.join(found, "value").select(key, "field", "value", "restored", "recovered")


#: Values that may be garbled at all.
ODD = r"[^\x00-\x7F]|&[#A-Za-z0-9]+;"


def search(values: DataFrame, corpus: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, restored, recovered) of the distinct garbled values; the model comes from the column text of `corpus`.

    Damage that repeats looks familiar to a model that was counted with it. So the search runs twice: the second time
    with a model counted without the values that the first one found. Their pairs are subtracted, so the corpus is
    counted once.
    """
    odd = checkpoint(spread(values.filter(F.col("value").rlike(ODD)).distinct()))
    pairs = checkpoint(character_pairs(corpus))
    found = _search(odd, frequent(pairs))
    for _ in range(rounds - 1):
        without = corpus.filter(F.col("text").rlike(ODD)).join(found.select(F.col("value").alias("text")), "text", "left_semi")
        rest = pairs.unionByName(character_pairs(without).select("pair", (-F.col("n")).alias("n"))).groupBy("pair").agg(F.sum("n").alias("n"))
        found = _search(odd, frequent(checkpoint(rest.filter("n > 0"))))
    return found


_MODEL: dict[str, Model] = {}


def _search(odd: DataFrame, pairs: dict[str, int]) -> DataFrame:
    token = uuid4().hex  # tasks of one worker share the model and the words it has seen
    shared = odd.sparkSession.sparkContext.broadcast(pairs)  # at most 1/SHARE
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("recovered", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _MODEL:
            _MODEL.clear()
            _MODEL[token] = Model(shared.value)
        model = _MODEL[token]
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                is_garbled, best, recovered = restore(v, model)
                if is_garbled:
                    out.append((v, best, recovered))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.string(), pa.string(), pa.bool_()))], names=schema.names)

    return checkpoint(odd.mapInArrow(run, schema))
