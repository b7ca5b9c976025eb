"""Scans of folders, rule files, and what a scan changes in the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from librarium.functions import text as X
from librarium.operators.catalog import FORMATS
from librarium.schemas import RULE_FILE


def files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size, modified, ext) of the files below folders; the content is not read (column pruning keeps it out of the plan)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), X.extension(X.file_name(F.col("path"))).alias("ext"))


def supported(found: DataFrame, ext: str = "ext") -> DataFrame:
    """Files of the formats a scan takes in."""
    return found.filter(F.lower(ext).isin(FORMATS))


def contents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, content, ext) of the supported files. A file is a row, so it has to fit one task."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return supported(raw.select("path", "content", X.extension(X.file_name(F.col("path"))).alias("ext")))


def source_state(sources: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """(source_id, state): what a scan of the source would say: scanning, missing, disabled or ready."""
    busy = F.lit(False)
    if running is not None:
        sources = sources.join(running.select("source_id").distinct().withColumn("_busy", F.lit(True)), "source_id", "left")
        busy = F.coalesce(F.col("_busy"), F.lit(False))
    state = F.when(busy, "scanning").when(F.col("root_path").isNull(), "missing").when(~F.col("enabled"), "disabled").otherwise("ready")
    return sources.select("source_id", state.alias("state"))


def new_files(found: DataFrame, books: DataFrame, path: str = "file_path") -> DataFrame:
    return found.join(books.select(path), path, "left_anti")


def known_files(found: DataFrame, books: DataFrame, path: str = "file_path") -> DataFrame:
    return found.join(books.select(path), path, "left_semi")


def missing_books(books: DataFrame, found: DataFrame, path: str = "file_path") -> DataFrame:
    """Books of scanned sources whose file was not seen; a full scan deletes them."""
    return books.join(found.select("source").distinct(), "source", "left_semi").join(found.select(path), path, "left_anti")


def scan_counts(found: DataFrame, books: DataFrame, full: bool, source: str = "source", path: str = "file_path") -> DataFrame:
    """(source, found, imported, deleted). A full scan counts known files as imported and deletes what it did not see; an incremental one does neither."""
    seen = found.join(books.select(path, F.lit(True).alias("_known")), path, "left")
    imported = F.count(F.lit(1)) if full else F.count_if(F.col("_known").isNull())
    per = seen.groupBy(source).agg(F.count(F.lit(1)).alias("found"), imported.alias("imported"))
    if not full:
        return per.withColumn("deleted", F.lit(0).cast("bigint"))
    gone = missing_books(books, found, path).groupBy(source).agg(F.count(F.lit(1)).alias("deleted"))
    return per.join(gone, source, "left").select(source, "found", "imported", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def as_books(found: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows of new files: title from the file's name, no author, pending."""
    name = X.file_name(F.col(path))
    return found.select(X.stem(name).alias("title"), F.lit(None).cast("string").alias("author"), X.extension(name).alias("book_format"), path, "source", F.lit("pending").alias("parse_status"))


def by_parser(df: DataFrame, ext: str = "ext") -> DataFrame:
    """The parser and the metadata extractor of each file; formats without a parser fail."""
    e = F.lower(ext)
    parser = F.when(e == "epub", "epub").when(e == "txt", "text").when(e == "pdf", "pdf").when(e.isin("mobi", "azw3"), "mobi").when(e.isin("html", "htm"), "html")
    extractor = F.when(e == "epub", "epub").when(e == "txt", "text").when(e == "pdf", "pdf").when(e.isin("mobi", "azw3", "azw"), "mobi").when(e.isin("html", "htm"), "html").otherwise("generic")
    return df.withColumns({"parser": parser, "extractor": extractor, "status": F.when(parser.isNull(), "failed").otherwise("pending")})


# ---------------------------------------------------------------- rules


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, rule, example, priority, enabled) of a JSON list of rules; the place in the file is the priority."""
    raw = spark.read.text(path, wholetext=True)
    return _rules(raw.select(F.from_json("value", RULE_FILE).alias("rules")))


def rule_payload(requests: DataFrame, column: str = "body") -> DataFrame:
    return _rules(requests.select(F.from_json(column, RULE_FILE).alias("rules")))


def _rules(df: DataFrame) -> DataFrame:
    one = df.select(F.posexplode("rules").alias("priority", "r"))
    return one.select("r.name", "r.rule", "r.example", "priority", F.lit(True).alias("enabled"))


def initial_rules(current: DataFrame, from_file: DataFrame, force: bool = False) -> DataFrame:
    """The rules of a file, unless there are any already and `force` is not set."""
    if force:
        return from_file
    some = current.limit(1).select(F.lit(1).alias("_some"))
    return from_file.withColumn("_some", F.lit(1)).join(F.broadcast(some), "_some", "left_anti").drop("_some")


def import_rules(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rules whose name is not in the table yet; equal names inside one import are all taken."""
    return new.join(current.select("name"), "name", "left_anti")


# ---------------------------------------------------------------- metadata


def choose_metadata(first, second):
    """Struct columns: the first extractor wins whole if it has a title or an author; fields are never mixed."""
    return F.when(first["title"].isNotNull() | first["author"].isNotNull(), first).otherwise(second)


def apply_metadata(books: DataFrame, metadata: DataFrame) -> DataFrame:
    """Books with their latest metadata: a null never clears a column, a description is cut at 1000, a missing title is the file's name.

    metadata: book_id, meta_id, extracted_at, title, author, publisher, description, isbn; several rows of a book count
    in the order of extraction.
    """
    order = F.struct("extracted_at", "meta_id")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_{c}")
    fields = ("title", "author", "publisher", "description", "isbn")
    m = metadata.groupBy("book_id").agg(*(last(c) for c in fields))
    out = books.join(m, books["id"] == m["book_id"], "left")
    title = F.coalesce("_title", "title", X.stem(X.file_name(F.col("file_path"))))
    return out.select("id", title.alias("title"), F.coalesce("_author", "author").alias("author"), F.coalesce("_publisher", "publisher").alias("publisher"), F.coalesce("_isbn", "isbn").alias("isbn"), X.description(F.col("_description")).alias("description"))
