"""Duplicates hidden by formatting differences (problem 3): recursive radix partitioning and counting tries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from librarium.session import checkpoint

#: What formatting may change: white space, punctuation, and the ASCII marks that Unicode counts as symbols.
_NOISE = r"[\s\p{Z}\p{Cc}\p{P}$+<=>^`|~]+"
_DASH = "[-‐‑‒–—―−－]"
#: Rows that fit a bucket, whatever the size of the table; one that holds more is split by further bytes.
LEAST = 20_000
#: Split buckets of a round up to which they are broadcast; more are joined by SALTS parts of each bucket.
NODES, SALTS = 2_048, 32
#: Bytes by which an oversized bucket is split at once, after what all its keys share.
STEP = 2
#: Keys that a task combines at most before it hands them on.
COMBINE = 100_000
#: A record with more copies than this is hot: its rows are matched where they are, without a shuffle.
HOT = 50_000


def canonical(c: Column) -> Column:
    """Without letter case, white space and punctuation; null stays null. Sharp s is two letters in capitals, so it is here."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.upper(c)), "[ßẞ]", "ss"), _NOISE, "")


def canonical_path(path: Column) -> Column:
    """Folders in order, the parts of the file name in sorted order, the extension; each in canonical form."""
    name = F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)$", 1), r"[\s\p{Z}\p{P}]+$", "")
    folders = F.array_join(F.transform(F.split(F.regexp_replace(path, r"(?s)[^/]*$", ""), "/"), canonical), "/")
    dotted = F.instr(name, ".") > 0
    ext = F.when(dotted, F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    stem = F.when(dotted, F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(name)
    parts = F.array_sort(F.filter(F.transform(F.split(stem, _DASH), canonical), lambda x: x != ""))
    return F.concat(folders, F.lit("\x01"), F.array_join(parts, "\x02"), F.lit("\x01"), canonical(ext))


def record_key(title: Column, author: Column, path: Column) -> Column:
    """Canonical bytes of a record. Title and author may be exchanged; a null agrees with a null only."""
    a, b = F.coalesce(canonical(title), F.lit("\x03")), F.coalesce(canonical(author), F.lit("\x03"))
    return F.concat(F.least(a, b), F.lit("\x01"), F.greatest(a, b), F.lit("\x01"), F.coalesce(canonical_path(path), F.lit("\x03"))).cast("binary")


class CountingTrie:
    """Counts of byte strings. A node keeps the rests of its keys; beyond BURST of them it hands them to its children."""

    BURST = 64
    __slots__ = ("rest", "child")

    def __init__(self) -> None:
        self.rest: dict[bytes, list] | None = {}
        self.child: dict[int, CountingTrie] = {}

    def add(self, key: bytes, at: int, first, n: int) -> None:
        node = self
        while node.rest is None:
            if at == len(key):
                break
            c = key[at]
            at += 1
            nxt = node.child.get(c)
            if nxt is None:
                nxt = node.child[c] = CountingTrie()
            node = nxt
        if node.rest is None:  # the key ends at an inner node: its terminal counter is the child -1
            leaf = node.child.get(-1)
            if leaf is None:
                leaf = node.child[-1] = CountingTrie()
            node, tail = leaf, b""
        else:
            tail = key[at:]
        have = node.rest.get(tail)
        if have is None:
            node.rest[tail] = [first, n]
            if len(node.rest) > self.BURST and any(len(x) for x in node.rest):
                node.burst()
        else:
            have[1] += n
            if first is not None and (have[0] is None or first < have[0]):
                have[0] = first

    def burst(self) -> None:
        rest, self.rest = self.rest, None
        for tail, (first, n) in rest.items():
            self.add(tail, 0, first, n)

    def items(self, head: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        todo = [(head, self)]
        while todo:
            h, node = todo.pop()
            if node.rest is not None:
                for tail, (first, n) in node.rest.items():
                    yield h + tail, first, n
            for c, nxt in node.child.items():
                todo.append((h if c < 0 else h + bytes((c,)), nxt))


_PARTIAL = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies that one task meets become one row before anything is shuffled."""

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=_PARTIAL.names)

    seen: dict[bytes, list] = {}
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            have = seen.get(k)
            if have is None:
                seen[k] = [i, 1]
            else:
                have[1] += 1
                if i is not None and (have[0] is None or i < have[0]):
                    have[0] = i
        if len(seen) > COMBINE:
            yield out()
            seen = {}
    if seen:
        yield out()


_RANGE = T.StructType([T.StructField("bucket", T.BinaryType()), T.StructField("rows", T.LongType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket that one task meets, with the least and the greatest key."""

    def out():
        v = list(seen.values())
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.binary()), pa.array([x[2] for x in v], pa.binary())], names=_RANGE.names)

    seen: dict[bytes, list] = {}
    for batch in batches:
        for b, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = seen.get(b)
            if h is None:
                seen[b] = [1, k, k]
            else:
                h[0] += 1
                if k < h[1]:
                    h[1] = k
                elif k > h[2]:
                    h[2] = k
        if len(seen) > COMBINE:
            yield out()
            seen = {}
    yield out()


_SPLIT = T.StructType([T.StructField("bucket", T.BinaryType()), T.StructField("width", T.IntegerType())])


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many bytes name the parts of a bucket: what all its keys share and STEP more."""
    for batch in batches:
        b, low, high = (c.to_pylist() for c in batch.columns)
        w = [max(shared(x, y), len(p)) + STEP for p, x, y in zip(b, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.binary()), pa.array(w, pa.int32())], names=_SPLIT.names)


def shared(low: bytes, high: bytes) -> int:
    """Length of what the least and the greatest key share, and with them all keys between."""
    lo, hi = 0, min(len(low), len(high))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if low[:mid] == high[:mid] else (lo, mid - 1)
    return lo


def split_once(active: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows whose bucket fits, rows of the parts of buckets that were split); None if all buckets fit."""
    found = active.select("bucket", "key").mapInArrow(_histogram, _RANGE).groupBy("bucket").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    big = checkpoint(found.filter((F.col("rows") > least) & (F.col("low") < F.col("high"))).select("bucket", "low", "high").mapInArrow(_widths, _SPLIT))
    n = big.count()  # one number
    if not n:
        return None
    if n <= NODES:
        met = active.join(F.broadcast(big), "bucket", "left")
    else:  # a bucket may hold a third of all rows: its parts are joined apart
        salted = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = active.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"], "left").drop("salt")
    # a key that ends where its bucket is split is a bucket of its own
    to = F.when(F.length("key") <= F.length("bucket"), F.concat(F.lit(b"\xff\xff\xff"), "bucket")).otherwise(F.substring("key", F.lit(1), F.col("width")))
    met = checkpoint(met.withColumn("bucket", F.when(F.col("width").isNull(), F.col("bucket")).otherwise(to)))
    return met.filter("width IS NULL").drop("width"), met.filter("width IS NOT NULL").drop("width")


def radix_counts(rows: DataFrame, key: str = "key", ident: str = "id", least: int = LEAST) -> DataFrame:
    """(key BINARY, keep_id, copies) of every distinct key: its smallest id and the number of its rows.

    Copies are combined inside each task first. Buckets of key bytes are then split round by round until each holds at
    most `least` rows, at every size of the table: a split skips what all keys of the bucket share and takes STEP
    further bytes. A round counts and splits only the rows whose buckets do not fit yet; the buckets that do are put
    aside. Which buckets are split is a table, not a list at the driver, which learns its size. A bucket whose keys are
    all equal is done, however many rows it has. The buckets are then shuffled, and each task counts one bucket at a
    time in a trie with a counter at each terminal node.

    Defined results: a null key is a key of its own; null ids count, but never stand for a record unless all are null;
    an empty table gives no rows.
    """
    narrow = rows.select(F.coalesce(F.col(key), F.lit(b"\x00\x00null")).alias("key"), F.col(ident).cast("long").alias("first"))
    active = checkpoint(narrow.mapInArrow(_combine, _PARTIAL)).select(F.lit(b"").alias("bucket"), "key", "first", "n")
    fit = []
    while (parts := split_once(active, least)) is not None:
        fit.append(parts[0])
        active = parts[1]
    buckets = reduce(DataFrame.unionByName, fit, active)

    def count(batches):
        trie, now = CountingTrie(), None
        for batch in batches:
            for b, k, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != now:
                    if now is not None:
                        yield from _emit(trie)
                    trie, now = CountingTrie(), b
                trie.add(k, 0, first, n)
        if now is not None:
            yield from _emit(trie)

    out = buckets.select("bucket", "key", "first", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _PARTIAL)
    return out.select(F.when(F.col("key") != F.lit(b"\x00\x00null"), F.col("key")).alias("key"), F.col("first").alias("keep_id"), F.col("n").alias("copies"))


def _emit(trie: CountingTrie) -> Iterator[pa.RecordBatch]:
    keys, first, n = [], [], []
    for k, f, c in trie.items():
        keys.append(k)
        first.append(f)
        n.append(c)
        if len(keys) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=_PARTIAL.names)
            keys, first, n = [], [], []
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=_PARTIAL.names)


def records(books: DataFrame, *, key: str = "id", title: str = "title", author: str = "author", path: str = "file_path") -> DataFrame:
    """(keep_id, copies): each record once, under the smallest id of its rows."""
    keyed = books.select(F.col(key).alias("id"), record_key(F.col(title), F.col(author), F.col(path)).alias("key"))
    return radix_counts(keyed).select("keep_id", "copies")


def copies(books: DataFrame, *, key: str = "id", title: str = "title", author: str = "author", path: str = "file_path", hot: int = HOT) -> DataFrame:
    """(keep_id, copy_id): each further row of a record that has several, with the smallest id of the record.

    Rows of hot records, of which there are at most NODES, are matched by a broadcast; the others by a join on the
    canonical bytes of the records that have copies.
    """
    keyed = checkpoint(books.select(F.col(key).cast("long").alias("id"), record_key(F.col(title), F.col(author), F.col(path)).alias("key")))
    several = checkpoint(radix_counts(keyed).filter("copies > 1"))
    least = max(hot, (several.agg(F.sum("copies").alias("n")).first()["n"] or 0) // NODES)
    much, few = several.filter(F.col("copies") > least), several.filter(F.col("copies") <= least)
    out = keyed.join(F.broadcast(much), "key").unionByName(keyed.join(F.broadcast(much.select("key")), "key", "left_anti").join(few, "key"))
    return out.filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()


__all__ = ["CountingTrie", "canonical", "canonical_path", "copies", "radix_counts", "record_key", "records"]
