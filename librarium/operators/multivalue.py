"""Several values packed in one field, split into one value per row (problem 5).

A value may hold a character that elsewhere is a delimiter ("either/or plots"). Known whole values protect it: a
dictionary of values with such characters is taken from the data, a multi-pattern automaton finds them in a field, and
dynamic programming picks the cover of the field with the best score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.session import checkpoint

#: Characters that part values. A slash or a plus counts as well, but gives way to known values more easily.
HARD = ",;|；，、\n\t\r｜"
SOFT = "/+"
DELIMITERS = HARD + SOFT
#: Opening quotes and what closes them.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
#: A dictionary value is met alone in at least so many elements, however many there are.
SUPPORT = 2
#: The dictionary is sent to every task only below this many characters; beyond it, tasks get only the hits they need.
DICTIONARY_CHARS = 1 << 20
_DELIM = re.compile(f"[{re.escape(DELIMITERS)}]")
_EDGE = " \t\r\n\x0b\x0c 　"


def fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""))


def dictionary(elements: DataFrame, column: str = "text", support: int = SUPPORT) -> DataFrame:
    """(value, n): whole values that hold a delimiter character without being parted by it, from all elements.

    Two kinds of evidence: a value in quotes that is an element of its own, and an unquoted element whose only
    delimiter characters are slashes or pluses without spaces around them, if not all its sides are whole values more
    often. Counted over all rows, in lower case; values met in fewer than `support` elements are not known values. The
    result may grow with the data; it is a frame, and `split_values` sends it to tasks only below DICTIONARY_CHARS.
    """
    text = fold(F.col(column))
    opened = "[" + "".join(re.escape(q) for q in QUOTES) + "]"
    closed = "[" + "".join(re.escape(q) for q in set(QUOTES.values())) + "]"
    inner = f"[^{''.join(re.escape(q) for q in {*QUOTES, *QUOTES.values()})}]+"
    quoted = F.regexp_extract(text, f"^{opened}({inner}){closed}$", 1)
    hard, soft = f"[{re.escape(HARD)}]", f"[{re.escape(SOFT)}]"
    plain = F.when(~text.rlike(hard) & text.rlike(f"\\S{soft}\\S") & ~text.rlike(f"\\s{soft}|{soft}\\s|^{soft}|{soft}$") & ~text.rlike(f"{opened}|{closed}"), text)
    some = f"[{re.escape(DELIMITERS)}]"
    in_quotes = elements.select(F.nullif(quoted, F.lit("")).alias("value")).filter(F.col("value").rlike(some)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    bare = elements.select(plain.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    # "a/b" is two values if both sides are whole values more often than "a/b" is
    whole = elements.select(text.alias("part")).filter(~F.col("part").rlike(some)).groupBy("part").agg(F.count(F.lit(1)).alias("alone"))
    sides = bare.select("value", "n", F.explode(F.transform(F.split("value", soft), F.trim)).alias("part")).join(whole, "part", "left")
    bare = sides.groupBy("value").agg(F.max("n").alias("n"), F.min(F.coalesce("alone", F.lit(0))).alias("alone")).filter("alone < n").select("value", "n")
    counted = in_quotes.unionByName(bare).groupBy("value").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= support)


class Segmenter:
    """Cuts one element into values by the best cover."""

    def __init__(self, values: list[str]):
        self.auto = ahocorasick.Automaton()
        for v in values:
            self.auto.add_word(v, v)
        if values:
            self.auto.make_automaton()
        self.some = bool(values)

    def protected(self, text: str) -> list[tuple[int, int]]:
        """Spans of known values that stand between delimiters, quotes or ends."""
        low = text.lower()
        if not self.some or len(low) != len(text):
            return []
        out = []
        for end, v in self.auto.iter(low):
            a, b = end + 1 - len(v), end + 1
            i, j = a, b
            while i > 0 and text[i - 1] in _EDGE and text[i - 1] not in DELIMITERS:
                i -= 1
            while j < len(text) and text[j] in _EDGE and text[j] not in DELIMITERS:
                j += 1
            if (i == 0 or text[i - 1] in DELIMITERS or text[i - 1] in QUOTES) and (j == len(text) or text[j] in DELIMITERS or text[j] in QUOTES.values()):
                out.append((a, b))
        return out

    @staticmethod
    def quoted(text: str) -> list[tuple[int, int]]:
        """Spans in quotes, the quotes included, that fill the room between two delimiters."""
        out, i, n = [], 0, len(text)
        fresh = True  # only a quote that begins a value opens one
        while i < n:
            c = text[i]
            if fresh and c in QUOTES:
                j = text.find(QUOTES[c], i + 1)
                while j >= 0:
                    k = j + 1
                    while k < n and text[k] in _EDGE and text[k] not in DELIMITERS:
                        k += 1
                    if k == n or text[k] in DELIMITERS:
                        break
                    j = text.find(QUOTES[c], j + 1)
                if j >= 0:
                    out.append((i, j + 1))
                    i, fresh = j + 1, False
                    continue
            fresh = c in DELIMITERS or (fresh and c in _EDGE)
            i += 1
        return out

    def split(self, text: str) -> list[str]:
        """Values in order; none for an empty text."""
        if not _DELIM.search(text):
            v = _clean(text)
            return [v] if v else []
        spans = {a: [(b, 4.0)] for a, b in self.quoted(text)}
        inside = [(a, next(iter(s))[0]) for a, s in spans.items()]
        for a, b in self.protected(text):
            if not any(x < b and a < y for x, y in inside):
                spans.setdefault(a, []).append((b, 2.0))
        cuts = [i for i, c in enumerate(text) if c in DELIMITERS]
        # A cover is a sequence of cuts. Each cut earns 1, an unspaced soft one 1 too; a kept span earns 2 for each delimiter
        # it protects, 4 if quoted, so a known value always outweighs the cuts inside it.
        n = len(text)
        best = [float("-inf")] * (n + 1)
        came: list[tuple[int, bool]] = [(-1, False)] * (n + 1)
        best[0] = 0.0
        at_cut = set(cuts)
        held = [0] * (n + 1)
        for i in range(n):
            held[i + 1] = held[i] + (i in at_cut)
        for i in range(n):
            if best[i] == float("-inf"):
                continue
            for b, worth in spans.get(i, ()):
                s = best[i] + worth * max(1, held[b] - held[i])
                if s > best[b]:
                    best[b], came[b] = s, (i, False)
            s = best[i] + (1.0 if i in at_cut else 0.0)
            if s > best[i + 1]:
                best[i + 1], came[i + 1] = s, (i, i in at_cut)
        taken, i = [], n
        while i > 0:
            j, cut = came[i]
            if cut:
                taken.append(j)
            i = j
        out, a = [], 0
        for c in [*reversed(taken), n]:
            v = _clean(text[a:c])
            if v:
                out.append(v)
            a = c + 1
        return out


def _clean(text: str) -> str:
    v = text.strip(_EDGE)
    if len(v) >= 2 and QUOTES.get(v[0]) == v[-1] and v[-1] not in v[1:-1]:
        v = v[1:-1].strip(_EDGE)
    return v


_SEGMENTER: dict[str, Segmenter] = {}


def split_values(df: DataFrame, column: str = "text", known: DataFrame | None = None, keep: list[str] | None = None, everything: bool = False) -> DataFrame:
    """One row per value: the columns `keep`, pos INT from 0, item STRING.

    Rows with fewer than two values give none, unless `everything` is set. Defined results: a null or blank text gives
    no rows; empty values between delimiters give no row and take no position; values keep their case, lose
    surrounding white space and enclosing quotes; a delimiter inside quotes or inside a known value belongs to the
    value; rows that repeat give their values again.

    known: (value, ...) from `dictionary`, by default taken from `column`. If its size is above DICTIONARY_CHARS,
    the rows that may hold a known value are matched to it by a shuffle join instead.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    known = checkpoint(dictionary(df, column) if known is None else known)
    size = known.agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("n")).first()["n"]  # one number
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])
    wanted = df if everything else df.filter(F.col(column).rlike(f"[{re.escape(DELIMITERS)}]"))
    if size <= DICTIONARY_CHARS:
        values = [r.value for r in known.select("value").toLocalIterator()]  # below DICTIONARY_CHARS characters
        shared, token = df.sparkSession.sparkContext.broadcast(values), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if token not in _SEGMENTER:  # built once for each worker, not for each task
                _SEGMENTER.clear()
                _SEGMENTER[token] = Segmenter(shared.value)
            seg = _SEGMENTER[token]
            yield from _rows(batches, lambda text, _: seg.split(text), keep, schema, everything)

        return wanted.select(*keep, column).mapInArrow(run, schema)

    def run_with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(batches, lambda text, hits: Segmenter(hits or []).split(text), keep, schema, everything)

    return _with_hits(wanted, column, known).select(*keep, column, "_hits").mapInArrow(run_with_hits, schema)


def _with_hits(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """The rows with an array of the known values in each, found by an equi-join on the runs between delimiters.

    A value with d delimiters spans d + 1 neighbouring parts of an element; the join tries runs of 2 up to the most
    parts that any known value has, so its size is linear in the text.
    """
    row = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
    most = known.agg(F.max(F.size(F.split("value", f"[{re.escape(DELIMITERS)}]"))).alias("m")).first()["m"] or 1
    marks = f"[{re.escape(DELIMITERS)}]"
    low = row.select("_row", F.lower(column).alias("_low")).withColumn("_at", F.expr(f"filter(sequence(1, length(_low) + 1), i -> i = length(_low) + 1 or substring(_low, i, 1) rlike '{marks}')".replace("\\", "\\\\")))
    runs = low.select("_row", "_low", F.posexplode(F.concat(F.array(F.lit(0)), "_at")).alias("_i", "_from"), "_at").select(
        "_row", F.explode(F.expr(f"transform(slice(_at, _i + 2, {most - 1}), e -> substring(_low, _from + 1, e - _from - 1))")).alias("_run")
    )
    value = fold(F.regexp_replace("_run", "^\\s*[\"“„«「『]|[\"”“»」』]\\s*$", ""))
    hits = runs.select("_row", value.alias("value")).join(known.select("value"), "value").groupBy("_row").agg(F.collect_set("value").alias("_hits"))
    return row.join(hits, "_row", "left")


def _rows(batches, split, keep, schema, everything):
    for batch in batches:
        texts = batch.column(len(keep)).to_pylist()
        hits = batch.column(len(keep) + 1).to_pylist() if batch.num_columns > len(keep) + 1 else [None] * len(texts)
        src, pos, items = [], [], []
        for i, (t, h) in enumerate(zip(texts, hits)):
            if not t:
                continue
            values = split(t, h)
            if len(values) >= 2 or (everything and values):
                src += [i] * len(values)
                pos += range(len(values))
                items += values
        if src:
            at = pa.array(src)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(pos, pa.int32()), pa.array(items, pa.string())], names=schema.names)


#: title-number-author-tags.ext: the number is digits only, the author has no hyphen.
NAME = r"^[^\n]*?-\s*\d+\s*-[^-]*-(.+)\.[A-Za-z0-9]+$"


def file_name_section(path: Column) -> Column:
    """The section of tags of a file path, null where the name has another form."""
    name = F.regexp_extract(path, r"(?s)([^/]*)$", 1)
    return F.nullif(F.regexp_extract(name, "(?s)" + NAME.replace("[^\\n]*?", ".*?"), 1), F.lit(""))


def elements_of(df: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """(row_id, elem, text) of the array elements."""
    return df.select(F.col(key).alias("row_id"), F.posexplode(tags).alias("elem", "text")).filter("text IS NOT NULL")
