"""Tables of contents, reading navigation and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from librarium.functions import text as X


def navigation(documents: DataFrame, book: str = "book_id", index: str = "doc_index") -> DataFrame:
    """(book, index, prev, next) over all documents of a book; null at the ends."""
    w = Window.partitionBy(book).orderBy(index)
    return documents.select(book, index, F.lag(index).over(w).alias("prev"), F.lead(index).over(w).alias("next"))


def _parents(items: Column) -> Column:
    """Items (index, level) in order with the index of their parent: the nearest item before with a smaller level.

    A stack holds the open items; it only ever holds rising levels, so each item costs the items it closes. Items of
    level above 0 before the first of level 0 have no place in the tree.
    """
    node = "array<struct<index:int,level:int>>"
    start = F.struct(F.array().cast(node).alias("open"), F.array().cast("array<struct<index:int,level:int,parent_index:int,kept:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        keep = F.when(x["level"] == 0, F.array().cast(node)).otherwise(F.filter(acc["open"], lambda o: o["level"] < x["level"]))
        parent = F.when(F.size(keep) > 0, F.element_at(keep, -1)["index"])
        kept = (x["level"] == 0) | parent.isNotNull()
        opened = F.when(kept, F.concat(keep, F.array(F.struct(x["index"].alias("index"), x["level"].alias("level"))))).otherwise(keep)
        row = F.struct(x["index"].alias("index"), x["level"].alias("level"), parent.alias("parent_index"), kept.alias("kept"))
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(items, start, step)["out"]


def tree(documents: DataFrame, book: str = "book_id", index: str = "doc_index", level: str = "toc_level", in_toc: str | None = "in_toc") -> DataFrame:
    """(book, index, level, parent_index, kept): the table of contents as an adjacency list.

    One shuffle by book; a book's items are one array and are read once with a stack. kept is false for items that the
    tree has no place for (a level above 0 before any of level 0).
    """
    rows = documents.filter(F.col(in_toc)) if in_toc else documents
    item = F.struct(F.col(index).cast("int").alias("index"), F.col(level).cast("int").alias("level"))
    per = rows.groupBy(book).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return per.select(book, F.explode(_parents(F.col("_items"))).alias("t")).select(book, "t.*")


def manifest(books: DataFrame, documents: DataFrame, index: str = "doc_index") -> DataFrame:
    """Books that have documents, with the reading order (all indexes) and the indexes in the table of contents."""
    spine = documents.groupBy("book_id").agg(
        F.array_sort(F.collect_list(index)).alias("spine"), F.array_sort(F.collect_list(F.when(F.col("in_toc"), F.col(index)))).alias("toc"), F.sum("word_count").alias("words")
    )
    none = F.lit(None).cast("string")
    return books.select(F.col("id").alias("book_id"), "title", "author", "publisher").join(spine, "book_id").withColumns({"language": none, "publish_date": none})


def chapters_listed(documents: DataFrame, index: str = "doc_index", title: Column | None = None) -> DataFrame:
    """Documents in the table of contents with their title, or the default one by position."""
    t = F.lit(None).cast("string") if title is None else title
    return documents.filter("in_toc").select("book_id", index, X.default_title(t, F.col(index)).alias("title"), "toc_level")


def match_toc(spine: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents of a reading order with the entry that leads to them. spine: book_id, index, href; entries: book_id, seq, href, title, level.

    An href that stands several times in the order means its last place; of several entries for one document the first
    counts; documents without an entry are not in the table of contents.
    """
    last = spine.groupBy("book_id", "href").agg(F.max("index").alias("index"))
    hit = entries.withColumn("href", X.fragment_free(F.col("href"))).join(last, ["book_id", "href"])
    w = Window.partitionBy("book_id", "index").orderBy("seq")
    first = hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("book_id", "index", "title", "level")
    out = spine.join(first, ["book_id", "index"], "left")
    return out.select("book_id", "index", "href", F.col("level").isNotNull().alias("in_toc"), "title", F.coalesce("level", F.lit(0)).alias("level"))
