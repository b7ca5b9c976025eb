"""Tags and their links to books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from librarium.functions import text as X
from librarium.operators.mutate import dense_rank_rows


def stats(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Every tag with the number of its books; 0 for tags without any."""
    n = links.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(n, tags["id"] == n["tag_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def of_books(links: DataFrame, tags: DataFrame) -> DataFrame:
    """(book_id, name): the tags of each book."""
    return links.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("book_id", "name")


def find_or_create(tags: DataFrame, names: DataFrame) -> DataFrame:
    """The tags table with a new row for each exact name that is not there; null and empty names make none."""
    fresh = names.select("name").filter("name IS NOT NULL AND name <> ''").distinct().join(tags.select("name"), "name", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]  # one number
    return tags.select("id", "name").unionByName(dense_rank_rows(fresh, ["name"], "id", int(top)).select(F.col("id").cast(tags.schema["id"].dataType), "name"))


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones added; a link that exists is left as it is."""
    return links.select("book_id", "tag_id").unionByName(new.select("book_id", "tag_id")).distinct()


def merge(tags: DataFrame, links: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, links) after tags were merged into others. merges: source, target (ids of tags; a tag merged into itself stays).

    Links of a source go to its target, doubles vanish, and the source tag is deleted.
    """
    m = merges.filter("source <> target").select(F.col("source").alias("tag_id"), "target").dropDuplicates(["tag_id"])
    moved = links.join(m, "tag_id", "left").select("book_id", F.coalesce("target", "tag_id").alias("tag_id")).distinct()
    return tags.join(m.select(F.col("tag_id").alias("id")), "id", "left_anti"), moved


def auto_tags(books: DataFrame, path: str = "file_path", limit: int | None = None) -> DataFrame:
    """(book_id, name): tags from the names of files, of all books; `limit` reproduces a run over the first titles only."""
    if limit is not None:
        books = books.orderBy("title", "id").limit(limit)
    return books.select(F.col("id").alias("book_id"), F.explode(X.filename_tags(X.file_name(F.col(path)))).alias("name"))


def created_by(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many tags a run created."""
    return after.join(before.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def apply_auto_tags(books: DataFrame, tags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, links) after tagging all books by their file names."""
    found = auto_tags(books)
    all_tags = find_or_create(tags, found.select("name"))
    new = found.join(all_tags, "name").select("book_id", F.col("id").alias("tag_id"))
    return all_tags, link(links, new)
