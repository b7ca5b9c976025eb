"""Schemas of the library's own tables, for `read`. The queries read stand-ins of other shapes, with the schema their files state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(text: str) -> str:
    return " ".join(text.split())


SPAN = "STRUCT<text: STRING, styles: ARRAY<STRING>, link: STRING, footnoteId: STRING, footnoteImage: STRING>"
ELEMENT = (
    "STRUCT<type: STRING, level: INT, text: STRING, language: STRING, src: STRING, alt: STRING, width: INT, height: INT, ordered: BOOLEAN, id: STRING, "
    f"spans: ARRAY<{SPAN}>, items: ARRAY<STRUCT<spans: ARRAY<{SPAN}>>>>"
)

TABLES: dict[str, str] = {
    "users": _table("id INT, username STRING, password STRING, email STRING, role STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"),
    "sessions": _table("id INT, token STRING, user_id INT, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ"),
    "invite_tokens": _table("id INT, token STRING, created_by INT, used BOOLEAN, used_by INT, created_at TIMESTAMP_NTZ, used_at TIMESTAMP_NTZ"),
    "folder_permissions": _table("id INT, user_id INT, folder_path STRING, can_access BOOLEAN"),
    "book_sources": _table("id INT, name STRING, path STRING, enabled BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"),
    "books": _table(
        """id INT, title STRING, author STRING, format STRING, file_path STRING, cover_path STRING, file_size BIGINT, isbn STRING, publisher STRING,
        publish_date STRING, description STRING, source_id INT, chapters_parsed BOOLEAN, chapters_count INT, last_parsed_at TIMESTAMP_NTZ, parse_status STRING,
        parse_progress INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""
    ),
    "book_documents": _table(
        "id INT, book_id INT, index INT, href STRING, in_toc BOOLEAN, title STRING, level INT, word_count INT, image_count INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "document_contents": _table(f"document_id INT, content ARRAY<{ELEMENT}>"),
    "document_resources": _table("id INT, book_id INT, path STRING, stored_path STRING, media_type STRING, size BIGINT"),
    "tags": _table("id INT, name STRING, created_at TIMESTAMP_NTZ"),
    "book_tags": _table("book_id INT, tag_id INT, created_at TIMESTAMP_NTZ"),
    "reading_progress": _table(
        "user_id INT, book_id INT, progress DECIMAL(5,2), current_page INT, total_pages INT, cfi_location STRING, document_id STRING, device_id STRING, last_read_at TIMESTAMP_NTZ"
    ),
    "bookmarks": _table("id INT, user_id INT, book_id INT, position_type STRING, position_value STRING, document_id STRING, title STRING, note STRING, color STRING, created_at TIMESTAMP_NTZ"),
    "reader_settings": _table(
        """user_id INT, font_family STRING, font_size INT, font_weight INT, line_height DECIMAL(3,2), letter_spacing DECIMAL(3,2), paragraph_spacing INT,
        text_align STRING, theme STRING, background_color STRING, text_color STRING, page_mode STRING, brightness INT, margin_horizontal INT, margin_vertical INT"""
    ),
    "txt_parse_rules": _table("id INT, name STRING, rule STRING, example STRING, enabled BOOLEAN, priority INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"),
}
RULE_FILE = "ARRAY<STRUCT<name: STRING, rule: STRING, example: STRING>>"
#: Largest values the tables took; a longer one is an error there, so it is reported here rather than cut.
LIMITS = {"books": {"title": 255, "author": 255, "file_path": 500, "format": 10}, "tags": {"name": 100}, "bookmarks": {"position_value": 500}}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its stated schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def too_long(df: DataFrame, name: str) -> DataFrame:
    """Rows with a value longer than its column allows."""
    from functools import reduce

    from pyspark.sql import functions as F

    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.length(c) > n, F.lit(False)) for c, n in LIMITS[name].items() if c in df.columns)))
