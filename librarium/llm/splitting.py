"""Cutting texts that have too many tokens at natural boundaries (problem 10).

Every text is read in ranges: a range begins and ends where a pre-token surely begins, which is looked for in a halo past
its end; places to cut are found range by range, the tables of a text's ranges are stitched by prefix sums of tokens and
characters, pieces are chosen on the stitched table, and cut out by offset. The ranges of a text are measured in one
task, or, for giant texts, in as many as there are ranges; the functions are the same.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from librarium.llm.bpe import CHUNK, TOKENIZER_DIR, L, N, S, chunks, count_tokens, tokenizer
from librarium.session import checkpoint

#: How good a place to cut is: a paragraph or block, a line, a sentence, a clause, between words, inside a run of letters.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0
KINDS = ["inside", "word", "clause", "sentence", "line", "paragraph"]
#: What a character is for the places of cuts, one bit each: the end of a sentence, of a clause, a closing mark, the end of a line.
_ENDS, _CLAUSES, _CLOSES, _NEWLINE = 1, 2, 4, 8
_MARKS = np.zeros(0x10000, np.uint8)
for _bit, _chars in ((_ENDS, ".!?…。！？"), (_CLAUSES, ",;:，；：、—"), (_CLOSES, "\"'”’»)]）】」』“"), (_NEWLINE, "\n\r\u2028\u2029\x85")):
    _MARKS[[ord(_c) for _c in _chars]] |= _bit


def marks_of(cps: np.ndarray) -> np.ndarray:
    return _MARKS[np.minimum(cps, 0xFFFF)]


#: A piece is filled to this part of the limit before the best boundary in the rest is taken.
FILL = 0.5
#: Characters of a range, and those past its end that are read to end on a boundary of pre-tokens.
RANGE, HALO = 1 << 14, 1 << 10
#: Texts of more characters than this have their ranges measured by several tasks.
SPREAD = 1 << 20


def places(cps: np.ndarray, cls: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pre-tokens of a chunk of texts: which begin at a place to cut, and how good each place is.

    White space stays with what follows it, so a place is the start of a pre-token that stands after a character that
    is not white; a cut there changes no pre-token on either side. White space at the end of a text is no place.
    first marks the first code point of each text.
    """
    n = len(cps)
    white = cls == S
    p = np.minimum(starts, n - 1)
    before = np.maximum(p - 1, 0)
    ok = ~white[before] & ~first[p]
    idx = np.arange(n)
    # for each place the next character that is not white, and the last one before it that is no closing mark
    ahead = np.minimum.accumulate(np.where(white, n, idx)[::-1])[::-1]
    doc = np.cumsum(first)
    nxt = ahead[p]
    ok &= nxt < n
    nxt = np.minimum(nxt, n - 1)
    ok &= doc[nxt] == doc[p]
    marks = marks_of(cps)
    close = (marks & _CLOSES) > 0
    at_last = np.maximum(np.maximum.accumulate(np.where(white | close, -1, idx))[before], 0)
    last, last_mark = cps[at_last], marks[at_last]
    newline = (marks & _NEWLINE) > 0
    newline[1:] &= ~((cps[1:] == 0x0A) & (cps[:-1] == 0x0D))
    breaks = np.concatenate([[0], np.cumsum(newline)])
    lines = breaks[nxt] - breaks[p]
    spaced = white[p] | (last >= 0x2E80)
    g = np.full(len(p), WORD, np.int8)
    g[spaced & ((last_mark & _CLAUSES) > 0)] = CLAUSE
    g[spaced & ((last_mark & _ENDS) > 0) & ~close[p]] = SENTENCE
    tag = (cps[before] == 0x3E) | (cps[nxt] == 0x3C)  # an HTML tag ends or begins
    g[tag & (g < SENTENCE)] = SENTENCE
    g[lines == 1] = LINE
    g[lines >= 2] = PARAGRAPH
    return ok, g


class Inner:
    """Places inside long pre-tokens, at the ends of their tokens where those are ends of characters; found once for each distinct pre-token."""

    def __init__(self, tok):
        self.tok = tok
        self.size = np.zeros(max(tok.ranks.values()) + 1, np.int64)
        for token, rank in tok.ranks.items():
            self.size[rank] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.store = self.tok.known
        self.kept: dict[int, int] = {}
        self.begin = np.zeros(1, np.int64)
        self.flat_o = self.flat_t = np.zeros(0, np.int64)

    def _learn(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray, gap: int) -> None:
        """Ends of tokens that are ends of characters, for all new pre-tokens at once: both are laid end to end by their bytes."""
        t = self.tok
        n_tok, n_chr = t.count[rows].astype(np.int64), ends - starts
        tok_end, chr_end = np.cumsum(n_tok), np.cumsum(n_chr)
        ids = t.ids[np.repeat(t.begin[rows] - (tok_end - n_tok), n_tok) + np.arange(int(tok_end[-1]))]
        c = cps[np.repeat(starts - (chr_end - n_chr), n_chr) + np.arange(int(chr_end[-1]))]
        token_bytes = np.cumsum(self.size[ids])
        char_bytes = np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))
        at = np.searchsorted(char_bytes, token_bytes)
        word = np.repeat(np.arange(len(rows)), n_tok)
        nth = np.arange(len(ids)) - np.repeat(tok_end - n_tok, n_tok) + 1
        hit = np.flatnonzero((char_bytes[at] == token_bytes) & (nth < n_tok[word]))
        bin_ = nth[hit] // gap
        if len(hit):  # one place in `gap` tokens is enough
            first = np.ones(len(hit), bool)
            first[1:] = (bin_[1:] != bin_[:-1]) | (word[hit][1:] != word[hit][:-1])
            hit = hit[first]
        places_of = np.bincount(word[hit], minlength=len(rows))
        self.flat_o = np.concatenate([self.flat_o, at[hit] + 1 - (chr_end - n_chr)[word[hit]]])
        self.flat_t = np.concatenate([self.flat_t, nth[hit]])
        base = len(self.kept)
        self.kept.update(zip(rows.tolist(), range(base, base + len(rows))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(places_of)])

    def of(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, cps: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pre-tokens by their rows and bounds: how many places each has, their offsets in characters, the tokens before them."""
        if self.store is not self.tok.known:  # the tokenizer began a new store
            self._reset()
        distinct, example, which = np.unique(rows, return_index=True, return_inverse=True)
        fresh = np.array([r not in self.kept for r in distinct.tolist()])
        if fresh.any():
            i = example[fresh]
            self._learn(distinct[fresh], starts[i], ends[i], cps, gap)
        k = np.array([self.kept[r] for r in distinct.tolist()])[which]
        begin, n = self.begin[k], self.begin[k + 1] - self.begin[k]
        stop = np.cumsum(n)
        take = np.repeat(begin - (stop - n), n) + np.arange(int(stop[-1]))
        return n, self.flat_o[take], self.flat_t[take]


def table_of(cps, cls, starts, rows, tokens, first, step: int, inner: Inner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a chunk of texts in order (offsets in the chunk), tokens of the chunk before each, how good each is.

    Pre-tokens of more than `step` tokens get places inside. The ends of the texts themselves are not listed.
    """
    ok, good = places(cps, cls, starts, first)
    # white space and what follows it may together be too much: then the pre-tokens of that stretch are places too
    begins = ok | first[starts]
    stretch = np.cumsum(begins) - 1
    more = (np.bincount(stretch, weights=tokens)[stretch] > step) & ~begins
    ok, good = ok | more, np.where(more, INSIDE, good)
    upto = np.concatenate([[0], np.cumsum(tokens)])
    sel = np.flatnonzero(ok)
    pos, u, g = starts[sel], upto[sel], good[sel]
    big = np.flatnonzero(tokens > step)
    if len(big):
        n, offsets, inside = inner.of(rows[big], starts[big], np.append(starts[1:], len(cps))[big], cps, max(1, step // 2))
        pos = np.concatenate([pos, np.repeat(starts[big], n) + offsets])
        u = np.concatenate([u, np.repeat(upto[big], n) + inside])
        g = np.concatenate([g, np.full(int(n.sum()), INSIDE, np.int8)])
        o = np.argsort(pos, kind="stable")
        pos, u, g = pos[o], u[o], g[o]
    return pos, u, g


class Chooser:
    """Pieces over the places of one text, which may come in several lots; only those that later pieces may need are kept.

    Each piece ends at the best place between FILL of the limit and the limit (the last of equal ones), or at the last
    place below that if there is none. The next piece begins at the place nearest to `overlap` tokens before the end
    that is not more than `overlap` before it. Neighbours share text only up to the end, and each piece ends later
    than the one before.
    """

    KEEP = 1 << 16

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.pos, self.upto, self.good, self.i, self.end = [], [], [], 0, None

    def feed(self, pos: list[int], upto: list[int], good: list[int], last: bool) -> Iterator[tuple[int, int, int, int, bool]]:
        """Pieces (start, end, tokens, kind of the cut at the end, whether a pre-token is cut at either end) that the places so far settle; `last` if the text ends with them."""
        if self.pos:
            self.pos += pos
            self.upto += upto
            self.good += good
        else:
            self.pos, self.upto, self.good = pos, upto, good
        pos, upto, good, limit = self.pos, self.upto, self.good, self.limit
        n = len(pos) - 1
        while n >= 0:
            i = self.i
            top = bisect_right(upto, upto[i] + limit, i) - 1
            if top >= n:
                if last:
                    yield pos[i], pos[n], upto[n] - upto[i], good[n], self.end is not None and not good[i]
                break
            floor = max(bisect_right(upto, upto[i] + int(limit * FILL), i), i + 1)
            if self.end is not None:  # ends must advance
                floor = max(floor, bisect_right(pos, self.end, i))
            j = top = max(top, i + 1)
            if floor <= top:
                best = max(good[floor : top + 1])
                while good[j] != best:
                    j -= 1
            if j == n and not last:  # what comes after it decides where the next piece begins
                break
            yield pos[i], pos[j], upto[j] - upto[i], good[j], not good[j] or (self.end is not None and not good[i])
            if j == n:
                break
            k = j
            if self.overlap:
                while k - 1 > i and upto[j] - upto[k - 1] <= self.overlap:
                    k -= 1
                while k < j and upto[j + 1] - upto[k] > limit:  # the next piece must get past this end
                    k += 1
            self.i, self.end = k, pos[j]
        if self.i > self.KEEP:
            self.pos, self.upto, self.good, self.i = pos[self.i :], upto[self.i :], good[self.i :], 0


def choose(pos: list[int], upto: list[int], good: list[int], limit: int, overlap: int) -> list[tuple[int, int, int, int, bool]]:
    """The pieces of a text whose places are all at hand."""
    return list(Chooser(limit, overlap).feed(pos, upto, good, True))


def pieces_of(text: str, pos: list[int], upto: list[int], good: list[int], limits, count_many) -> Iterator[list]:
    """Rows limit_id, piece_no, start, end, tokens, cut, piece of one text; none has more tokens than its limit, but for single characters."""
    for limit_id, most, overlap in limits:
        if upto[-1] - upto[0] <= most:
            continue
        shrink, by_byte = 0, False
        while True:
            if by_byte:  # no text has more tokens than bytes
                sizes = [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
                kinds = dict(zip(pos, good))
                table = list(range(len(text) + 1)), sizes, [kinds.get(i, INSIDE) for i in range(len(text) + 1)]
            else:
                table = pos, upto, good
            rows, cut = [], []
            for no, (a, b, n, kind, torn) in enumerate(choose(*table, most - shrink, min(overlap, most // 2))):
                rows.append([limit_id, no, a, b, n, KINDS[kind], text[a:b]])
                if torn or by_byte:
                    cut.append(no)
            if not cut:
                break
            # where a pre-token is cut its parts are encoded anew; if that makes a piece too large, all get less room
            for no, n in zip(cut, count_many([rows[no][6] for no in cut]).tolist()):
                rows[no][4] = n
            over = max(r[4] for r in rows) - most
            if over <= 0 or by_byte:
                break
            shrink += over
            if shrink >= most // 2:
                shrink, by_byte = 0, True
        yield from rows


def _step(most: int, overlap: int) -> int:
    """Tokens from place to place at most: fine enough for an overlap, else for the limit."""
    room = min(overlap, most // 2)
    return max(1, room // 4) if room else most


def _columns() -> list[T.StructField]:
    return [
        T.StructField("limit_id", T.IntegerType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("cut", T.StringType()), T.StructField("piece", T.StringType()),
    ]


def split_documents(df: DataFrame, limits: list[tuple[int, int, int]], *, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, range_chars: int = RANGE, halo: int = HALO, spread: int = SPREAD) -> DataFrame:
    """Pieces of every text that has more tokens than a limit allows; texts within a limit give no row for it.

    limits: (limit_id, max_tokens, overlap_tokens), a handful of settings. Columns: key, limit_id, piece_no from 0,
    start_char and end_char (from 0, end exclusive), n_tokens, cut (what the piece's end is: paragraph, line, sentence,
    clause, word or inside) and piece, the text between the offsets. Without their overlaps the pieces are the text.

    n_tokens is the count of the piece as a text of its own and at most max_tokens (a single character is never cut);
    neighbours share at most overlap_tokens, and all but a few of them: the shared part begins between words, or inside
    a long run of letters. An overlap above half the limit counts as half the limit.

    Defined results: null and empty texts give no rows; a null key is kept; rows that repeat give their pieces again.

    Every text is measured in ranges (see above). Texts up to `spread` characters are cut, measured, stitched and split
    in the task that reads them, without a shuffle. The ranges of longer ones are measured in tasks of their own; the
    table that is stitched holds offsets, not text, and each range cuts out its own parts of the pieces.
    """
    limits = sorted((int(i), int(m), int(o)) for i, m, o in limits if i is not None and m is not None and m > 0)
    limits = [(i, m, max(0, o)) for i, m, o in limits]
    narrow = df.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *_columns()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        inner = Inner(tok)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                part = ["" if t is None else t for t in texts.slice(a, b - a).to_pylist()]
                src, out = [], []
                for i, row in _pieces_of_chunk(part, tok, inner, limits, range_chars, halo):
                    src.append(a + i)
                    out.append(row)
                if out:
                    yield _batch(keys.take(pa.array(src)), out, schema.names)

    short = narrow.filter(F.length("text") <= spread).mapInArrow(run, schema)
    giants = narrow.filter(F.length("text") > spread)
    # numbered once and kept, so that a lost executor cannot number the rows anew
    giants = checkpoint(giants.withColumn("_row", F.monotonically_increasing_id()))
    return short if giants.isEmpty() else short.unionByName(_split_giants(giants, limits, schema, key, name, folder, range_chars, halo))


def _sync(cls: np.ndarray) -> np.ndarray:
    """Offsets at which a pre-token surely begins, whatever stands around: white space after a word, a mark or digit after letters or digits."""
    c, b = cls[1:], cls[:-1]
    return np.flatnonzero((c != b) & (b != S) & ((c == S) | ((b == L) & (c != L)) | ((b == N) & (c != N)))) + 1


def bounds_of_ranges(cls: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, stops: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges begin and end, given their parts (a character of context, the range, a halo) laid end to end.

    heads: whether a part is the first of its text; stops: where the range without its halo ends; last: whether the part
    reaches the end of its text. -1 stands for an end that the halo does not show.
    """
    sync = np.append(_sync(cls), len(cls))
    begin = np.where(heads, starts, sync[np.searchsorted(sync, np.minimum(starts + 1, len(cls)))])
    end = np.where(stops < ends, sync[np.searchsorted(sync, np.minimum(stops, len(cls)))], ends)
    end = np.where(end < ends, end, np.where(last, ends, -1))
    return np.where(begin < ends, begin, np.where(last, ends, -1)), end


def ranges_of(texts: list[str], classes, size: int, halo: int) -> list[list[str]]:
    """Each text cut into its ranges. One whose halo does not show where the next range begins goes on through that range."""
    long = [i for i, t in enumerate(texts) if len(t) > size]
    out = [[t] for t in texts]
    if long:
        parts = [(i, no, max(0, no - 1)) for i in long for no in range(0, len(texts[i]), size)]
        cut = [texts[i][a : no + size + halo] for i, no, a in parts]
        cps = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(c) for c in cut])
        starts = ends - np.array([len(c) for c in cut])
        no, a = np.array([x[1] for x in parts]), np.array([x[2] for x in parts])
        total = np.array([len(texts[i]) for i, _, _ in parts])
        _, end = bounds_of_ranges(classes.of(cps), starts, ends, no == 0, starts + (no - a) + size, no + size + halo >= total)
        end = np.where(end < 0, -1, end - starts + a)
        for i in long:
            out[i] = []
        at, of = 0, -1
        for (i, _, _), e in zip(parts, end.tolist()):
            if i != of:
                at, of = 0, i
            if e > at:  # a range ends where the next one begins; where that is open, it goes on
                out[i].append(texts[i][at:e])
                at = e
    return out


def _pieces_of_chunk(part: list[str], tok, inner: Inner, limits, size: int = RANGE, halo: int = HALO) -> Iterator[tuple[int, list]]:
    ranges = ranges_of(part, tok.classes, size, halo)
    cps, cls, starts, rows, bounds = tok.words_of([r for t in ranges for r in t])
    if not len(starts):
        return
    # stitched: the ranges of a text lie end to end, so offsets and tokens before each place are prefix sums over them
    bounds = bounds[np.concatenate([[0], np.cumsum([len(t) for t in ranges])])]
    tokens = tok.count[rows].astype(np.int64)
    first = np.zeros(len(cps), bool)
    first[bounds[:-1][bounds[:-1] < len(cps)]] = True
    at = np.searchsorted(starts, bounds)
    upto = np.concatenate([[0], np.cumsum(tokens)])[at]
    least = min((m for _, m, _ in limits), default=None)
    if least is None or not (np.diff(upto) > least).any():
        return
    pos, u, g = table_of(cps, cls, starts, rows, tokens, first, min(_step(m, o) for _, m, o in limits), inner)
    lo, hi = np.searchsorted(pos, bounds[:-1], "right").tolist(), np.searchsorted(pos, bounds[1:], "left").tolist()
    bounds, upto = bounds.tolist(), upto.tolist()
    made, torn, texts = [], [], []
    for i, t in enumerate(part):
        if upto[i + 1] - upto[i] > least:
            x, y = lo[i], hi[i]
            p, v, k = [0, *(pos[x:y] - bounds[i]).tolist(), bounds[i + 1] - bounds[i]], [upto[i], *u[x:y].tolist(), upto[i + 1]], [PARAGRAPH, *g[x:y].tolist(), PARAGRAPH]
            for limit in limits:
                limit_id, most, overlap = limit
                if v[-1] - v[0] <= most:
                    continue
                rows = []
                for no, (a, b, n, kind, cut) in enumerate(choose(p, v, k, most, min(overlap, most // 2))):
                    rows.append([limit_id, no, a, b, n, KINDS[kind], t[a:b]])
                    if cut:
                        torn.append((len(made), no))
                        texts.append(t[a:b])
                made.append((i, limit, rows, p, v, k))
    # where a pre-token is cut its parts are encoded anew, for all texts of the chunk at once
    large = set()
    for (m, no), n in zip(torn, tok.count_many(texts).tolist() if texts else ()):
        made[m][2][no][4] = n
        if n > made[m][1][1]:
            large.add(m)
    for m, (i, limit, rows, p, v, k) in enumerate(made):
        for row in pieces_of(part[i], p, v, k, [limit], tok.count_many) if m in large else rows:
            yield i, row


def _batch(keys: pa.Array, out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=names)


#: Ranges of texts: number, characters before the range, characters in it, whether its part reaches the end of the text;
#: the part is its text with a character before it and a halo.
_RANGES = T.StructType([
    T.StructField("_row", T.LongType()), T.StructField("_no", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_last", T.BooleanType()), T.StructField("_part", T.StringType()),
])


def _split_giants(giants: DataFrame, limits, schema, key, name, folder, size: int, halo: int) -> DataFrame:
    """Texts of a table whose ranges are measured by several tasks; giants has a column _row."""

    def cut(batches):
        for batch in batches:
            for row, t in zip(*(c.to_pylist() for c in batch.columns)):
                for no in range(0, len(t), size):  # one range at a time leaves the task
                    n = min(size, len(t) - no)
                    yield _batch_of(_RANGES, [(row, no // size, no, n, no + size + halo >= len(t), t[max(0, no - 1) : no + size + halo])])

    ranges = checkpoint(giants.select("_row", "text").mapInArrow(cut, _RANGES).repartition("_row", "_no"))
    whole = lambda again: giants.join(again, "_row", "left_semi").select(key, "text")
    return _split_ranges(ranges, giants.select("_row", F.col(key)), whole, limits, schema, key, name, folder, size, halo)


def split_files(
    spark: SparkSession, paths: list[str] | DataFrame, limits: list[tuple[int, int, int]], *, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, range_bytes: int = 1 << 20, halo: int = HALO
) -> DataFrame:
    """Pieces of UTF-8 files as `split_documents` gives them, under the column path; no task loads a whole file.

    A file is read in byte ranges, each by a task of its own: the range with a character before it and a halo after it.
    Characters are counted by range and summed up over the ranges before; the rest is as for giant texts. paths: a list,
    or a frame with a column path; any file system that Arrow can open. Bytes that are no UTF-8 become replacement
    marks. A file with a range that is open at its halo's end is split as a whole by one task. An empty file gives no rows.
    """
    limits = [(i, m, max(0, o)) for i, m, o in sorted((int(i), int(m), int(o)) for i, m, o in limits if i is not None and m is not None and m > 0)]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING") if isinstance(paths, list) else paths.select("path")
    rows = checkpoint(df.filter("path IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()))
    places = T.StructType([T.StructField("_row", T.LongType()), T.StructField("path", T.StringType()), T.StructField("_size", T.LongType()), T.StructField("_at", T.LongType())])

    def sizes(batches):
        for batch in batches:
            for row, path in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
                n = fs.get_file_info(at).size
                if n:
                    yield _batch_of(places, [(row, path, n, a) for a in range(0, n, range_bytes)])

    def read(batches):
        for batch in batches:
            for row, path, total, at in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name_ = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
                a = max(0, at - 8)
                with fs.open_input_file(name_) as f:
                    data = f.read_at(min(total, at + range_bytes + 4 * halo + 8) - a, a)
                begin, end = _char_start(data, at - a), _char_start(data, min(at + range_bytes, total) - a)
                text = data[begin:end].decode("utf-8", "replace")
                before = data[:begin].decode("utf-8", "replace")[-1:]
                after = data[end:].decode("utf-8", "replace")
                yield _batch_of(_RANGES, [(row, at // range_bytes, 0, len(text), a + len(data) >= total and len(after) <= halo, before + text + after[:halo])])

    spread = rows.select("_row", "path").mapInArrow(sizes, places).repartition("_row", "_at")
    ranges = checkpoint(spread.mapInArrow(read, _RANGES))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_row").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = ranges.select("_row", "_no", before.alias("_base"))  # a few numbers for each range
    ranges = checkpoint(ranges.drop("_base").join(known, ["_row", "_no"]).select(_RANGES.names))
    schema = T.StructType([T.StructField("path", T.StringType()), *_columns()])
    texts = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])

    def load(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
                with fs.open_input_file(at) as f:
                    yield _batch_of(texts, [(path, f.read().decode("utf-8", "replace"))])

    whole = lambda again: rows.join(again, "_row", "left_semi").select("path").mapInArrow(load, texts)
    return _split_ranges(ranges, rows, whole, limits, schema, "path", name, folder, RANGE, halo)


def _char_start(data: bytes, at: int) -> int:
    """The first place from `at` where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8())}


def _batch_of(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(cols, schema)], names=schema.names)


def _split_ranges(ranges: DataFrame, keys: DataFrame, whole: Callable[[DataFrame], DataFrame], limits, schema, key: str, name: str, folder: str, size: int, halo: int) -> DataFrame:
    """Pieces from ranges that lie in different tasks. A text with a range that is open at its halo's end, or with a piece
    that came out too large where a pre-token was cut, is split as a whole by one task.

    Tables of places are stitched in order of the ranges, a range at a time, so a task holds the places of one range and
    those of the piece it is at, however long the text is. keys: _row and key; whole: the texts of given rows.
    """
    if not limits:
        return keys.sparkSession.createDataFrame([], schema)
    measured = T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("_no", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_last", T.BooleanType()), T.StructField("_open", T.BooleanType()),
        T.StructField("_pos", T.ArrayType(T.LongType())), T.StructField("_tokens", T.ArrayType(T.LongType())), T.StructField("_good", T.ArrayType(T.ByteType())),
    ])
    step = min(_step(m, o) for _, m, o in limits)

    def measure(batches):
        tok = tokenizer(name, folder)
        inner = Inner(tok)
        for batch in batches:
            for row, no, base, n_own, last, part in zip(*(c.to_pylist() for c in batch.columns)):
                start = base - (no > 0)  # offset of the part's first character: one of context before the range
                cps = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                n = len(cps)
                begin, end = bounds_of_ranges(tok.classes.of(cps), np.array([0]), np.array([n]), np.array([no == 0]), np.array([base + n_own - start]), np.array([last]))
                begin, end = int(begin[0]), int(end[0])
                p, u, g = [], [], []
                if 0 <= begin < end:
                    piece = part[begin:end]
                    c2, k2, starts, rows, _ = tok.words_of([piece])
                    tokens = tok.count[rows].astype(np.int64)
                    head = np.zeros(len(c2), bool)
                    head[0] = True
                    p, u, g = table_of(c2, k2, starts, rows, tokens, head, step, inner)
                    p, u, g = [start + begin + x for x in (0, *p.tolist(), len(c2))], [0, *u.tolist(), int(tokens.sum())], [PARAGRAPH, *g.tolist(), PARAGRAPH]
                    if begin:  # the place where two ranges meet: white space that begins the range tells how good it is
                        lead = len(piece) - len(piece.lstrip())
                        breaks = int(((marks_of(c2[:lead]) & _NEWLINE) > 0).sum())
                        g[0] = PARAGRAPH if breaks > 1 else LINE if breaks else WORD
                yield _batch_of(measured, [(row, no, base, last, begin < 0 or end < 0, p, u, g)])

    pieces = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_open", T.BooleanType()), *(f for f in _columns() if f.name not in ("piece", "n_tokens")), T.StructField("_from", T.IntegerType()), T.StructField("_to", T.IntegerType())])

    def stitch(batches):
        now, is_open, tokens, bases, choosers, counts, held, waiting = None, False, 0, [], [], [], None, []

        def rows_of(k: int, found, final: bool = False) -> list[tuple]:
            out = []
            for a, b, n, kind, _ in found:
                if final and counts[k] == 0 and n <= limits[k][1]:
                    continue  # the whole text is within the limit
                out.append((now, False, limits[k][0], counts[k], a, b, KINDS[kind]))
                counts[k] += 1
            return out

        def placed(upto: int | None) -> list[tuple]:
            """Pieces whose ranges are all known, with the first and the last of them: a piece may reach past the range that settled it."""
            nonlocal waiting
            ready = [r for r in waiting if upto is None or r[5] <= upto]
            waiting = [r for r in waiting if upto is not None and r[5] > upto]
            return [(*r, bisect_right(bases, r[4]) - 1, bisect_right(bases, r[5] - 1) - 1) for r in ready]

        def close() -> list[tuple]:
            nonlocal held
            if now is not None and not is_open and held is not None:
                for k, c in enumerate(choosers):
                    waiting.extend(rows_of(k, c.feed([held[0]], [held[1]], [PARAGRAPH], True), True))
            held = None
            return placed(None) + ([(now, True, *[None] * 7)] if is_open else [])

        for batch in batches:
            out = []
            for row, _, base, _, opened, p, u, g in zip(*(c.to_pylist() for c in batch.columns)):
                if row != now:
                    out += close()
                    now, is_open, tokens, bases, counts, held = row, False, 0, [], [0] * len(limits), None
                    choosers = [Chooser(m, min(o, m // 2)) for _, m, o in limits]
                is_open = is_open or opened
                bases.append(base)
                out += placed(base)
                if p and not is_open:
                    u = [tokens + x for x in u]
                    for k, c in enumerate(choosers):  # the end of a range is held back: the next one tells how good it is
                        waiting += rows_of(k, c.feed(p[:-1], u[:-1], g[:-1], False))
                    tokens, held = u[-1], (p[-1], u[-1])
            if out:
                yield _batch_of(pieces, out)
        yield _batch_of(pieces, close())

    tables = ranges.select(_RANGES.names).mapInArrow(measure, measured)
    cuts = checkpoint(tables.repartition("_row").sortWithinPartitions("_row", "_no").mapInArrow(stitch, pieces))
    # each range cuts out its own part of every piece that reaches into it; the parts of a piece are put together in order
    named = [f.name for f in pieces if f.name not in ("_open", "_from", "_to")]
    reach = cuts.filter("NOT _open").select(*named, F.explode(F.sequence("_from", "_to")).alias("_no"))
    a, b = F.greatest("start_char", "_base"), F.least("end_char", F.col("_base") + F.col("_n"))
    start = F.col("_base") - F.when(F.col("_no") > 0, 1).otherwise(0)
    of = reach.join(ranges.drop("_last"), ["_row", "_no"]).withColumn("_text", F.substring("_part", (a - start + 1).cast("int"), (b - a).cast("int")))
    whole_pieces = of.groupBy(*named).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_text"))), lambda x: x["_text"]), "").alias("piece"))
    counted = checkpoint(count_tokens(whole_pieces, text="piece", keep=[*named, "piece"], name=name, folder=folder))
    most = F.create_map(*(F.lit(x) for i, m, _ in limits for x in (i, m)))
    large = counted.filter((F.col("n_tokens") > most[F.col("limit_id")]) & (F.length("piece") > 1)).select("_row")
    again = cuts.filter("_open").select("_row").unionByName(large).distinct()
    done = counted.join(again, "_row", "left_anti").join(keys.select("_row", key), "_row").select(*(f.name for f in schema))

    def alone(batches):
        tok = tokenizer(name, folder)
        inner = Inner(tok)
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                out = [row for _, row in _pieces_of_chunk([t], tok, inner, limits, size, halo)]
                if out:
                    yield _batch(pa.array([k.as_py()] * len(out), batch.schema.field(0).type), out, schema.names)

    return done.unionByName(whole(again).mapInArrow(alone, schema))


__all__ = ["CHUNK", "choose", "places", "split_documents", "split_files"]
