"""Reads over the library: pages, lookups, joins, counts. All are plain DataFrame plans; order and limits are left to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from librarium.functions import text as X
from librarium.session import checkpoint, maybe_broadcast

# Formats a scan takes in; "htm" is left out on purpose, though the parsers read it.
FORMATS = ["txt", "epub", "mobi", "azw3", "pdf", "html"]


# ---------------------------------------------------------------- filters


def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows for a table of keys: the set-based form of the point lookups (by id, by path, by book and index, by user and book)."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def find(df: DataFrame, **equal) -> DataFrame:
    """Rows where all the named columns have the given values; one row at most under a unique key."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def unparsed(books: DataFrame, status: str = "parse_status", parsed: str = "chapters_parsed") -> DataFrame:
    """Books still to be parsed: not parsed and pending or without a status. Failed and running ones are not taken up again."""
    return books.filter(~F.col(parsed) & ((F.col(status) == "pending") | F.col(status).isNull()))


def parse_batch(books: DataFrame, size: int = 5, key: str = "id") -> DataFrame:
    """The next books to parse; ordered by id, so that a batch is the same each time it is asked for."""
    return unparsed(books).orderBy(key).limit(size)


def count_capped(df: DataFrame, cap: int = 1000) -> DataFrame:
    """One row: the number of rows, at most `cap`."""
    return df.limit(cap).agg(F.count(F.lit(1)).alias("n"))


def retry(books: DataFrame, statuses: list[str]) -> DataFrame:
    """Books of the given statuses, for a run that takes failed or abandoned ones up again."""
    return books.filter(~F.col("chapters_parsed") & F.col("parse_status").isin(statuses))


def needs_metadata(books: DataFrame) -> DataFrame:
    """Books whose author is null or blank; a re-scan extracts their metadata again."""
    return books.filter(F.col("author").isNull() | X.is_blank(F.col("author")))


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired with their users. One that expires exactly now is not active."""
    return sessions.filter(F.col("expires_at") > now).join(users, "user_id")


def open_invites(invites: DataFrame) -> DataFrame:
    return invites.filter(~F.col("used"))


def has_role(users: DataFrame, role: str = "admin") -> DataFrame:
    """One row: whether any user has the role; false for an empty table."""
    return users.agg(F.coalesce(F.bool_or(F.col("role") == role), F.lit(False)).alias("found"))


def known_role(role: Column) -> Column:
    """Unknown roles are guests."""
    r = F.lower(role)
    return F.when(r.isin("admin", "user", "guest"), r).otherwise("guest")


# ---------------------------------------------------------------- order and limit


def page(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of an ordered table. The last ordering column should be a key, so that pages do not overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_key(df: DataFrame, key: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def listing(files: DataFrame) -> DataFrame:
    """One level of a folder: folders first, then by name without regard to case."""
    return files.orderBy(F.col("is_dir").desc(), F.lower("name"), "name")


def numbered_within(df: DataFrame, key: str, order: list[str], column: str, parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, within each key, where keys are few and some hold a large part of all rows.

    A window by key would sort a key in one task. Here rows are range-partitioned by key and order together, sorted
    inside partitions, and numbered from the start of their key: one small table (partition, key, rows) gives the rows
    of the key in the partitions before. What repeats in key and order is numbered in any order.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    # at most partitions + keys rows, for only a key's first and last partition hold others too
    counts = ranged.groupBy("_p", F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", "_k", "_first", before.alias("_before"))
    same = (ranged["_p"] == offsets["_p"]) & ranged[key].eqNullSafe(offsets["_k"])
    return ranged.join(maybe_broadcast(offsets), same).withColumn(column, (F.col("_before") + F.col("_i") - F.col("_first") + 1).cast("bigint")).select(*df.columns, column)


# ---------------------------------------------------------------- joins


def book_stats(books: DataFrame, documents: DataFrame) -> DataFrame:
    """Each book with words, images and chapters of its documents; 0 for books without documents.

    Documents are summed up before the join, which replaces one query per book by one partial aggregation and one join.
    """
    per = documents.groupBy("book_id").agg(F.sum("word_count").alias("words"), F.sum("image_count").alias("images"), F.count_if("in_toc").alias("chapters"))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return books.select(F.col("id").alias("book_id")).join(per, "book_id", "left").select("book_id", zero("words", "decimal(38,2)"), zero("images", "bigint"), zero("chapters", "bigint"))


def history(progress: DataFrame, books: DataFrame, k: int = 20) -> DataFrame:
    """The k books each user read last, with titles. The join follows the limit, so only k rows per user travel."""
    last = top_per_key(progress, "user_id", [F.col("last_read_at").desc(), F.col("book_id")], k)
    return last.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id")


def books_of_tags(links: DataFrame, books: DataFrame) -> DataFrame:
    """(tag, book) for every tag; links to missing books are dropped."""
    return links.join(books, "book_id")


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def rewrite_resources(contents: DataFrame, resources: DataFrame) -> DataFrame:
    """Images and footnote images of all elements point to the stored path of their resource; unmatched ones stay.

    A book's resources are folded into one map per book, bounded by the files of a book, and each document's elements
    are rewritten in place: no element is exploded and its order cannot change.
    """
    # a path stored twice counts as it was stored last in order of the stored path; null paths and books belong to nothing
    once = resources.filter("book_id IS NOT NULL AND path IS NOT NULL").groupBy("book_id", "path").agg(F.max("stored_path").alias("stored_path"))
    maps = once.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "stored_path"))).alias("_paths"))
    swap = lambda c: F.coalesce(F.try_element_at("_paths", c), c)
    span = lambda s: s.withField("footnoteImage", swap(s["footnoteImage"]))
    spans = lambda xs: F.transform(xs, span)

    def element(e: Column) -> Column:
        e = e.withField("src", F.when(e["type"] == "Image", swap(e["src"])).otherwise(e["src"])).withField("spans", spans(e["spans"]))
        return e.withField("items", F.transform(e["items"], lambda i: i.withField("spans", spans(i["spans"]))))

    joined = contents.join(maps, "book_id", "left")
    return joined.withColumn("content", F.when(F.col("_paths").isNull(), F.col("content")).otherwise(F.transform("content", element))).drop("_paths")


# ---------------------------------------------------------------- projections


def without_password(users: DataFrame) -> DataFrame:
    return users.drop("password")


def history_item(progress: DataFrame) -> DataFrame:
    """Renamed columns with the time as ISO text."""
    return progress.select("user_id", "book_id", "title", "author", F.col("progress"), F.date_format("last_read_at", "yyyy-MM-dd'T'HH:mm:ss").alias("read_at"))


def path_state(files: DataFrame) -> DataFrame:
    """Path validation: exists, is a folder, can be read, and all three."""
    ok = F.coalesce(F.col("exists"), F.lit(False)) & F.coalesce(F.col("is_dir"), F.lit(False)) & F.coalesce(F.col("can_read"), F.lit(False))
    return files.select("path", "exists", "is_dir", "can_read", ok.alias("valid"))
