"""Text cut off by field limits (problem 2): a backward character n-gram model of how texts end and how they go on.

For the last characters of a value the corpus says how often a text ends after them and how often it goes on. A value is
cut off if going on is far more likely. Contexts are read backward from the end and grow; the estimate of each is drawn
towards that of the shorter one. Rare names are replaced by a sign in some contexts, for a name tells nothing by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.session import checkpoint

#: Lengths of context in characters, and of context with rare names replaced.
LENGTHS, NAMED = (2, 3, 4, 6, 10, 16), (5, 8, 12)
#: How many of LENGTHS are read before those with names replaced.
SHORT = 3
#: Bits of the filter that keeps contexts at which no text ends from being shuffled: this many for each context at which
#: one ends, within two powers of two. Beyond the larger (16 MB) it lets more pass; they are dropped once they are counted.
FILTER_ROOM, FILTER_LEAST, FILTER_MOST = 16, 16, 27
#: A context at which more than one in so many texts ends is hot; there are at most that many for each length of context.
HOT = 5_000
#: Occurrences for which the estimate of the next shorter context counts.
TRUST = 8.0
#: Likelihood that a text ends at any one character, before anything is known.
PRIOR = 0.003
#: A value counts as cut off if its log-odds are this much above the median of its language.
MARGIN = 2.4
#: A word in less than this share of all texts is rare. At most (mean words of a text) / RARE words are not.
RARE = 2e-4
#: Marks that a cut may leave at the end; they are taken off before the context is read.
_TAIL = re.compile(r"(?:\s|\.\.\.|…|\[…\]|\[\.\.\.\]|�)+$")
#: Half a character at the end: nothing but a cut leaves it.
_BROKEN = "�\\s*$"
_NAME = re.compile(r"[^\W\d_]+", re.UNICODE)
#: Words that may begin with a capital.
_CAPITAL = re.compile(r"\b[^\W\d_a-z][^\W\d_]*", re.UNICODE)
_START, _SIGN = "\x02", "\x01"
_QUOTE_MARKS = "„“”«»\""
_IS_QUOTE = np.zeros(0x2100, np.uint8)
_IS_QUOTE[[ord(c) for c in _QUOTE_MARKS]] = 1
#: Characters in which the last contexts are looked for first.
TAIL = 96
_PART_WORD = re.compile(r"^\w+", re.UNICODE)
#: Characters hashed at once, so that the arrays stay near the processor; keys gathered before they are counted and handed on.
CHUNK, GATHER = 1 << 17, 1 << 21


def trimmed(text: str) -> str:
    """Without the marks of a cut; a text that is nothing else stays as it is."""
    c = text[-1:]
    if c == "." and text[-3:] != "..." or not (c in ".…]�" or c.isspace()):
        return text
    return _TAIL.sub("", text) or text


def words_of(texts: DataFrame, column: str, rare: float = RARE) -> DataFrame:
    """(word, n): words with capital first letters that are in at least `rare` of all texts; bounded by 1/rare times the mean length."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"(\p{Lu}[\p{L}]*)"), 1)))
    total = texts.filter(F.col(column).isNotNull()).count()  # one number
    return texts.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2.0, rare * total))


def named(text: str, common: set[str]) -> str:
    """Rare capitalised words of alphabets and numbers become signs."""
    t = re.sub(r"\d+", "0", text)
    return _CAPITAL.sub(lambda m: m[0] if not m[0][0].isupper() or ord(m[0][0]) >= 0x2E80 or m[0] in common else _SIGN, t)


class Contexts:
    """Hashes of the contexts of all positions of a chunk of texts."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = inverses = np.ones(1, np.uint64)  # as long as the longest chunk so far

    def __init__(self, texts: list[str], state: np.ndarray | None = None):
        """state: what is open at the end of each text, where the texts are ends of longer ones."""
        joined = "".join(_START + t for t in texts)
        self.cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        n = len(self.cps)
        with np.errstate(over="ignore"):
            if len(Contexts.powers) < n + 1:
                Contexts.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.STEP)]), dtype=np.uint64)
                Contexts.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.INVERSE)]), dtype=np.uint64)
            self.inverse = Contexts.inverses[: n + 1]
            v = self.cps.astype(np.uint64)
            v += np.uint64(0x632BE59BD9B4E019)
            v *= np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(31)
            v *= Contexts.powers[:n]
            self.sums = np.empty(n + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(v, out=self.sums[1:])
        # what is open at each position: an odd number of quotes since the start, a paragraph tag without its end
        if state is not None:
            self.state = np.repeat(state.astype(np.uint64), size)
            return
        quotes = np.cumsum(_IS_QUOTE[np.minimum(self.cps, len(_IS_QUOTE) - 1)], dtype=np.int64)
        base = np.concatenate([[0], quotes])[self.begin]
        self.state = ((quotes - np.repeat(base, size)) & 1).astype(np.uint64)
        lt = np.flatnonzero(self.cps == 0x3C)
        if len(lt):
            tag = np.zeros(n + 3, np.int64)
            cps = np.concatenate([self.cps, np.zeros(3, np.uint32)])
            tag[lt[cps[lt + 1] == 0x70]] = 1
            shut = lt[(cps[lt + 1] == 0x2F) & (cps[lt + 2] == 0x70) & (cps[lt + 3] == 0x3E)]
            tag[shut + 3] -= 1
            tags = np.cumsum(tag[:n])
            base = np.concatenate([[0], tags])[self.begin]
            self.state += (2 * (tags - np.repeat(base, size) > 0)).astype(np.uint64)

    def inner(self, lengths: tuple[int, ...], kind: int, bits: np.ndarray) -> Iterator[np.ndarray]:
        """For each length the keys of the contexts before all offsets inside texts that pass the filter at this and all shorter lengths.

        What an offset needs is carried along, so each length costs two look-ups for the offsets that are left.
        """
        n, mask, at = len(self.cps), 8 * len(bits) - 1, None
        for length in lengths:
            with np.errstate(over="ignore"):
                if at is None:
                    h = self.sums[length : max(n, length)] - self.sums[: max(n - length, 0)]
                    h *= self.inverse[: len(h)]
                    ends = np.arange(length, length + len(h))
                    room = (ends - np.repeat(self.begin, self.end - self.begin)[length : length + len(h)]).astype(np.int32)
                    sums, state, at = self.sums[length : length + len(h)], self.state[length - 1 : length - 1 + len(h)] + np.uint64(512 * kind), ends
                else:
                    a = np.maximum(at - length, 0)
                    h = sums - self.sums[a]
                    h *= self.inverse[a]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= (state + np.uint64(8 * length)) * np.uint64(0x94D049BB133111EB)
            key = h.view(np.int64)
            low = key & mask
            left = np.flatnonzero((room >= length) & ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1))
            at, sums, state, room = at[left], sums[left], state[left], room[left]
            yield key[left]

    def keys(self, at: np.ndarray, length: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the contexts of `length` characters that end before the offsets `at`; which of them lie in their text."""
        ok = at - length >= np.repeat(self.begin, self._per(at))
        a = np.maximum(at - length, 0)
        with np.errstate(over="ignore"):
            h = (self.sums[at] - self.sums[a]) * self.inverse[a]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= (self.state[np.maximum(at - 1, 0)] + np.uint64(8 * (length + 64 * kind))) * np.uint64(0x94D049BB133111EB)
        return h.view(np.int64), ok

    def _per(self, at: np.ndarray) -> np.ndarray:
        """How many of the offsets belong to each text; an offset after a text's last character still belongs to it."""
        return np.diff(np.concatenate([[0], np.searchsorted(at, self.end, "right")]))


_KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("ends", T.LongType()), T.StructField("goes_on", T.LongType())])


def _open_at_end(text: str) -> int:
    """The state of Contexts after a text's last character."""
    return (sum(map(text.count, _QUOTE_MARKS)) & 1) + 2 * (text.count("<p") > text.count("</p>"))


def _tail(text: str, common: set[str]) -> str:
    """The end of a text with rare names replaced: at least as long as the longest context, or the whole."""
    t = named(_PART_WORD.sub("", text[-TAIL:]), common) if len(text) > TAIL else named(text, common)
    return t if len(t) >= max(NAMED) or len(text) <= TAIL else named(text, common)


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def ending_filter(contexts: DataFrame, texts: int) -> bytes:
    """A bitmap over the keys of contexts at which some text ends. It may pass other keys, never lose one of these."""
    words = T.StructType([T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType())])
    size = min(max((FILTER_ROOM * texts * (len(LENGTHS) + len(NAMED))).bit_length(), FILTER_LEAST), FILTER_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(batch.column(0).to_numpy() & ((1 << size) - 1))
            word = bit >> 6
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(bit) else np.zeros(0, np.int64)
            ored = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at) if len(bit) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[at].astype(np.int32)), pa.array(ored.view(np.int64))], names=words.names)

    table = np.zeros(1 << (size - 6), np.int64)
    got = contexts.mapInArrow(run, words).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()  # at most 2**(FILTER_MOST - 6) rows
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.tobytes()


def count_contexts(texts: DataFrame, column: str, common: list[str], ending: bytes) -> DataFrame:
    """(key, ends, goes_on): for contexts at which some text ends, how many texts end there and how many go on there.

    Each task counts the contexts of all positions of its texts before anything is shuffled. `ending` keeps out most
    contexts at which no text ends, the rest of them is dropped after the counts are added up. A context is looked at
    only where the next shorter one is one at which a text ends, for else no text ends at the longer one either.
    """
    spark = texts.sparkSession
    shared, words = spark.sparkContext.broadcast(ending), spark.sparkContext.broadcast(common)  # both of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = set(words.value), np.frombuffer(shared.value, np.uint8)
        ends, inside, held = [], [], 0
        for batch in batches:
            for texts in _sliced([trimmed(t) for t in batch.column(0).to_pylist() if t]):
                for kind, lengths, c in ((0, LENGTHS, Contexts(texts)), (1, NAMED, Contexts([named(t, known) for t in texts]))):
                    for n, keys in zip(lengths, c.inner(lengths, kind, bits)):
                        key, ok = c.keys(c.end, n, kind)
                        ends.append(key[ok])
                        inside.append(keys)
                        held += len(keys)
                if held > GATHER:
                    yield _counted(ends, inside)
                    ends, inside, held = [], [], 0
        if ends:
            yield _counted(ends, inside)

    def _counted(ends: list[np.ndarray], inside: list[np.ndarray]) -> pa.RecordBatch:
        codes, k = pd.factorize(np.concatenate([*ends, *inside]))
        first = sum(map(len, ends))
        n = [np.bincount(c, minlength=len(k)).astype(np.int64) for c in (codes[:first], codes[first:])]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, *n)], names=_KEYED.names)

    counted = texts.select(column).mapInArrow(run, _KEYED)
    return counted.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).filter("ends > 0")


def last_contexts(texts: DataFrame, key: str, column: str, common: list[str]) -> DataFrame:
    """(key, rank, context, language) of each text: its contexts from the least to the most telling."""
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("rank", T.IntegerType()), T.StructField("context", T.LongType()), T.StructField("language", T.StringType())])
    words = texts.sparkSession.sparkContext.broadcast(common)  # bounded by RARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(words.value)
        for batch in batches:
            keys, raw = batch.column(0), batch.column(1).to_pylist()
            rows = np.array([i for i, t in enumerate(raw) if t], np.int64)
            whole = [trimmed(raw[i]) for i in rows.tolist()]
            speak = np.array([language(t) for t in whole])
            state = np.array([_open_at_end(t) for t in whole], np.uint64)
            plain, signs = Contexts([t[-max(LENGTHS) :] for t in whole], state), Contexts([_tail(t, known) for t in whole], state)
            order = [(plain, n, 0) for n in LENGTHS[:SHORT]] + [(signs, n, 1) for n in NAMED] + [(plain, n, 0) for n in LENGTHS[SHORT:]]
            for rank, (c, n, kind) in enumerate(order):
                k, ok = c.keys(c.end, n, kind)
                idx = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows[idx])), pa.array(np.full(len(idx), rank), pa.int32()), pa.array(k[idx], pa.int64()), pa.array(speak[idx].tolist(), pa.string())], names=schema.names
                )

    return texts.select(key, column).mapInArrow(run, schema)


# Frequent short words by which a language is told.
_WORDS = {
    "en": "the of and to in was his her with for that on a an",
    "de": "der die das und den dem ein eine in von mit zu auf nicht im",
    "fr": "le la les et des un une du dans que qui au à en",
    "es": "el la los las y de un una en que del con por su",
    "pt": "o a os as e de um uma em que do da com por",
    "it": "il la i gli e di un una in che del della con per",
}
_LANGUAGE: dict[str, list[str]] = {}
for _k, _v in _WORDS.items():
    for _w in _v.split():
        _LANGUAGE.setdefault(_w, []).append(_k)
_OTHER_SCRIPT = re.compile("[\u0400-\U0010ffff]")


def language(text: str) -> str:
    """By script for ideographs and Cyrillic, else by frequent words; "other" if none is met."""
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        sample = [ord(c) for c in text if c.isalpha()]
        if 2 * sum(o >= 0x2E80 for o in sample) > len(sample):
            return "zh"
        if 2 * sum(0x400 <= o < 0x530 for o in sample) > len(sample):
            return "ru"
    n = dict.fromkeys(_WORDS, 0)
    for w in _NAME.findall(text.lower()):
        for k in _LANGUAGE.get(w, ()):
            n[k] += 1
    best = max(n, key=n.__getitem__)
    return best if n[best] else "other"


def scored(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, language, odds, broken): the log-odds of going on against ending after each value's last context; whether it ends in half a character.

    The likelihood of an end starts at PRIOR and is updated with each context of the value, the short ones first: the
    estimate before counts as TRUST occurrences. The value's own end is not counted as evidence for itself, and a text
    that stands in several rows is no more evidence than one: texts are made distinct first and scored once.

    The text column is shuffled once, to make it distinct; what follows moves a few numbers for each context of a text's
    end, and the rows find their score by the digest of their text. Contexts at which very many texts end are few and
    are looked up in a broadcast, so no task gets all rows that end alike.
    """
    rows = df.select(key, F.col(column).alias("text")).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    texts = checkpoint(rows.select("text").distinct().select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text"))
    total = texts.count()  # one number
    common = [r.word for r in words_of(texts, "text").toLocalIterator()]  # bounded by RARE
    ranked = checkpoint(last_contexts(texts, "digest", "text", common))
    counts = checkpoint(count_contexts(texts, "text", common, ending_filter(ranked.select("context"), total)))
    least = max(HOT, total // HOT)
    hot = counts.filter(F.col("ends") > least)  # at most HOT contexts of each length, as each text has one of it
    looked = ranked.join(F.broadcast(hot), ranked["context"] == hot["key"], "left")
    cold = looked.filter("key IS NULL").select("digest", "rank", "context", "language").join(counts.filter(F.col("ends") <= least), F.col("context") == F.col("key"))
    met = looked.filter("key IS NOT NULL").unionByName(cold).select("digest", "rank", "language", (F.col("ends") - 1).alias("ends"), "goes_on")
    per = met.groupBy("digest").agg(F.first("language").alias("language"), F.array_sort(F.collect_list(F.struct("rank", "ends", "goes_on"))).alias("seen"))  # as many as there are lengths
    p = F.aggregate("seen", F.lit(PRIOR), lambda p, c: (c["ends"] + TRUST * p) / (c["ends"] + c["goes_on"] + TRUST))
    odds = per.select("digest", "language", F.ln((1 - p) / p).alias("odds"))
    mine = rows.select(key, F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.col("text").rlike(_BROKEN).alias("broken"))
    return mine.join(odds, "digest", "left").filter("odds IS NOT NULL OR broken").select(key, "language", "odds", "broken")


def truncated(df: DataFrame, key: str = "meta_id", column: str = "description", margin: float = MARGIN) -> DataFrame:
    """(key, language, odds, cut): whether each non-null value was cut off inside a word or a sentence.

    The threshold holds per language and column: it lies `margin` above the median odds of the language, that is of
    its complete texts, so languages whose sentences often go on after an end mark are not counted as cut.

    Defined results: null values give no row, empty values are not cut off; an ellipsis at the end is looked past, for
    a cut may have left it; half a character at the end is a cut; rows that repeat count as often as they stand; whole texts are counted.
    """
    odds = checkpoint(scored(df, key, column))
    level = odds.filter("odds IS NOT NULL").groupBy("language").agg(F.percentile_approx("odds", 0.5).alias("level"))  # a few languages
    out = odds.join(F.broadcast(level), "language", "left").withColumn("odds", F.when(F.col("broken"), F.lit(float("inf"))).otherwise(F.col("odds")))
    return out.select(key, "language", "odds", (F.col("broken") | (F.col("odds") > margin + F.greatest(F.coalesce("level", F.lit(0.0)), F.lit(0.0)))).alias("cut"))


def shares(df: DataFrame, cut: DataFrame, key: str = "meta_id", column: str = "description", source: str = "source") -> DataFrame:
    """(source, texts, cut, share): the share of cut values among the non-null ones of each source."""
    flags = cut.filter("cut").select(key).distinct().withColumn("_cut", F.lit(1))
    rows = df.filter(F.col(column).isNotNull()).select(key, F.col(source).alias("source")).join(flags, key, "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count("_cut").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
