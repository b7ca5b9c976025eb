"""Byte-level BPE over whole corpora (problem 8), also the token counts of problems 9 and 10.

Two layers:

* Pre-tokens are found and hashed for a whole chunk of text at once with numpy: every code point gets one of four
  classes, boundaries are class changes with the corrections the published pattern asks for, and a polynomial prefix
  hash gives each pre-token a 64-bit key. Equal pre-tokens are encoded once per worker.
* One pre-token is encoded with a rank queue: buckets per merge rank hold positions of a linked list, a bitmap of two
  levels (64 ranks a word, and one bit for each word) finds the lowest rank that has entries by find-first-set, stale
  entries are skipped. That is O(n) queue steps for a pre-token of n bytes, whatever its length.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("LIBRARIUM_TOKENIZERS", "/opt/tokenizers")
#: Code points handled at once by the vectorised layer; bounds a worker's memory.
CHUNK = 1 << 19
#: A worker's cache of encoded pre-tokens is emptied beyond these sizes.
CACHE_WORDS, CACHE_IDS = 400_000, 6_000_000

L, N, S, O = 1, 2, 3, 4
_WHITE = {0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x20, *range(9, 14), *range(0x2000, 0x200B)}


# ---------------------------------------------------------------- one pre-token


class Pairs(dict):
    """The rank of the token that two tokens make, by `left << SHIFT | right`; -1 if they make none. Filled as pairs are met."""

    MOST = 2_000_000
    __slots__ = ("token", "ranks")

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.token = ranks, {v: k for k, v in ranks.items()}

    def __missing__(self, key: int) -> int:
        if len(self) >= self.MOST:
            self.clear()
        r = self[key] = self.ranks.get(self.token[key >> SHIFT] + self.token[key & (1 << SHIFT) - 1], -1)
        return r


SHIFT = 20


class Merger:
    """Merges pre-tokens; what the queue needs is kept from one to the next, and is empty between them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.byte = [ranks[bytes((b,))] for b in range(256)]
        self.words = [0] * ((max(ranks.values()) >> 6) + 1)

    def ids(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        pairs, words, top, bucket = self.pairs, self.words, 0, {}
        piece = list(map(self.byte.__getitem__, word))
        n = len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        at = [-1] * n  # the rank of the pair that begins here; an entry in the queue with another rank is stale
        x = piece[0]
        for i in range(n - 1):
            y = piece[i + 1]
            r = pairs[x << SHIFT | y]
            x = y
            if r >= 0:
                at[i] = r
                if r in bucket:
                    bucket[r].append(i)
                else:
                    bucket[r] = [i]
                    a = r >> 6
                    v = words[a]
                    if not v:
                        top |= 1 << a
                    words[a] = v | 1 << (r & 63)
        while top:
            a = (top & -top).bit_length() - 1  # find first set, in the word of words and in the word
            v = words[a]
            low = v & -v
            words[a] = v = v ^ low
            if not v:
                top &= top - 1
            rank = (a << 6) + low.bit_length() - 1
            places = bucket.pop(rank)
            if len(places) > 1:
                places.sort()  # equal ranks merge from the left
            for i in places:
                if at[i] != rank:
                    continue
                j = nxt[i]
                piece[i] = rank  # the token that the two make
                at[j] = -2
                k = nxt[i] = nxt[j]
                at[i] = -1
                if k < n:
                    prv[k] = i
                    r = pairs[rank << SHIFT | piece[k]]
                    if r >= 0:
                        at[i] = r
                        if r in bucket:
                            bucket[r].append(i)
                        else:
                            bucket[r] = [i]
                            a = r >> 6
                            v = words[a]
                            if not v:
                                top |= 1 << a
                            words[a] = v | 1 << (r & 63)
                p = prv[i]
                if p >= 0:
                    r = at[p] = pairs[piece[p] << SHIFT | rank]
                    if r >= 0:
                        if r in bucket:
                            bucket[r].append(p)
                        else:
                            bucket[r] = [p]
                            a = r >> 6
                            v = words[a]
                            if not v:
                                top |= 1 << a
                            words[a] = v | 1 << (r & 63)
        out, i = [], 0
        while i < n:
            out.append(piece[i])
            i = nxt[i]
        return out


# ---------------------------------------------------------------- pre-tokens of a chunk


class CharClasses:
    """Class of each code point, filled on demand from the Unicode database."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, dtype=np.uint8)

    def of(self, cps: np.ndarray) -> np.ndarray:
        c = self.table[cps]
        if not c.all():
            for x in np.unique(cps[c == 0]).tolist():
                k = unicodedata.category(chr(x))[0]
                self.table[x] = S if x in _WHITE else L if k == "L" else N if k == "N" else O
            c = self.table[cps]
        return c


def boundaries(cps: np.ndarray, cls: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a chunk of whole texts; doc_start marks the first code point of each text.

    The rules follow the published split pattern: contractions, then runs of letters, digits or other marks with one
    leading space, then white space of which the last character before a word stands apart.
    """
    n = len(cps)
    first = doc_start.copy()
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = cls[1:] != cls[:-1]
    start = change | first
    white = cls == S
    last_white = np.zeros(n, bool)  # white, and a word of the same text follows
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    i = np.flatnonzero(last_white)
    start[i] = True  # it stands apart from the white space before it
    i = i[cps[i] == 0x20]
    start[i + 1] = False  # a space joins the word that follows
    # contractions: a lone apostrophe that begins a pre-token, then s t m d re ve ll
    q = np.flatnonzero((cps == 0x27) & start)
    if len(q):
        q = q[q + 1 < n]
        q = q[(cls[q + 1] == L) & ~first[q + 1]]
        if len(q):
            a = cps[q + 1]
            one = np.isin(a, (0x73, 0x74, 0x6D, 0x64))  # s t m d
            b = np.where((q + 2 < n), cps[np.minimum(q + 2, n - 1)], 0)
            b = np.where(first[np.minimum(q + 2, n - 1)], 0, b)
            two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
            for hit, width in ((q[one], 2), (q[two], 3)):
                start[hit + 1] = False
                after = hit + width
                start[after[after < n]] = True
    return np.flatnonzero(start)


class Tokenizer:
    """Ids by a rank file. One object per worker; it keeps what it has encoded, within bounds."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        self.ranks: dict[bytes, int] = {}
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.merger = Merger(self.ranks)
        self.classes = CharClasses()
        step = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(step), -1, 1 << 64))
        self.step, self.inverse = step, inverse
        self.pow = self.inv = np.ones(1, np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.words = self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            with np.errstate(over="ignore"):
                self.pow = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.step, np.uint64)]), dtype=np.uint64)
                self.inv = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse, np.uint64)]), dtype=np.uint64)

    def _keys(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            self._powers(len(cps) + 1)
            v = (cps.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(32)
            v *= self.pow[: len(v)]
            p = np.empty(len(v) + 1, np.uint64)
            p[0] = 0
            np.cumsum(v, out=p[1:])
            h = (p[ends] - p[starts]) * self.inv[starts]
            h ^= (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            return h ^ (h >> np.uint64(29))

    def _rows(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row in the store of each pre-token, encoding those not met before."""
        codes, distinct = pd.factorize(self._keys(cps, starts, ends))
        if self.words > CACHE_WORDS or self.used > CACHE_IDS:
            self._reset()
        where = np.empty(len(distinct), np.int64)
        known, fresh = self.known, []
        for i, h in enumerate(distinct.tolist()):
            r = known.get(h, -1)
            if r < 0:
                fresh.append(i)
                known[h] = r = self.words
                self.words += 1
            where[i] = r
        if fresh:
            f = np.asarray(fresh)
            example = np.empty(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            example = example[f]
            if self.words > len(self.begin):
                self.begin = np.resize(self.begin, 2 * self.words)
                self.count = np.resize(self.count, 2 * self.words)
            merge = self.merger.ids
            for r, a, b in zip(where[f].tolist(), starts[example].tolist(), ends[example].tolist()):
                ids = merge(cps[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"))
                if self.used + len(ids) > len(self.ids):
                    self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
                self.ids[self.used : self.used + len(ids)] = ids
                self.begin[r], self.count[r] = self.used, len(ids)
                self.used += len(ids)
        return where[codes]

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: code points, classes, starts of pre-tokens, their rows in the store, text bounds."""
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        if not len(cps):
            e = np.zeros(0, np.int64)
            return cps, e.astype(np.uint8), e, e, bounds
        cls = self.classes.of(cps)
        doc = np.zeros(len(cps), bool)
        doc[bounds[:-1][bounds[:-1] < len(cps)]] = True
        starts = boundaries(cps, cls, doc)
        ends = np.append(starts[1:], len(cps))
        return cps, cls, starts, self._rows(cps, starts, ends), bounds

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of texts without nulls."""
        cps, _, starts, rows, bounds = self.words_of(texts)
        n = self.count[rows].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.begin[rows] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32)
        upto = np.concatenate([[0], ends])
        return upto[np.searchsorted(starts, bounds)], flat

    def count_many(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without nulls."""
        _, _, starts, rows, bounds = self.words_of(texts)
        upto = np.concatenate([[0], np.cumsum(self.count[rows].astype(np.int64))])
        return np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[1].tolist()


_OF_WORKER: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Tokenizer:
    """The worker's tokenizer; reading the rank file happens once per Python worker."""
    if (name, folder) not in _OF_WORKER:
        _OF_WORKER[name, folder] = Tokenizer(name, folder)
    return _OF_WORKER[name, folder]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that together hold about `limit` bytes; one larger text is a range of its own."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    upto = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row: the ids of `text` without special tokens.

    Defined results: a null text and an empty text both give an empty list; a null key is kept; rows that repeat come
    out as often as they went in; other columns are ignored. Map-only: no shuffle, one pass over the text column.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                part = ["" if t is None else t for t in texts.slice(a, b - a).to_pylist()]
                offsets, flat = tok.encode_many(part)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns `keep` (default: all but the text) and the number of tokens of `text`; 0 for null and empty texts.

    Map-only; the text itself is dropped before anything later can shuffle it.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            texts = batch.column(len(keep))
            counts = [np.zeros(0, np.int64)]
            for a, b in chunks(texts):
                counts.append(tok.count_many(["" if t is None else t for t in texts.slice(a, b - a).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(counts).astype(np.int64))], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)
