"""Queries and SQL of the operators in this subpackage, by the names of their problems."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from librarium.llm import bpe, cooccurrence, formatting, lookalike, mixing, mojibake, names, splitting, truncation
from librarium.operators import multivalue
from librarium.session import fan_out, table

Query = Callable[[SparkSession, str], DataFrame]


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(fan_out(table(spark, sf, "documents").select("doc_id", "text")))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each text as its ids spell it: encoding loses nothing."""
    schema = "doc_id BIGINT, digest STRING"

    def spell(batches):
        token = {v: k for k, v in bpe.tokenizer().ranks.items()}
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(t).hexdigest() for t in texts])], names=["doc_id", "digest"])

    return p8_ids(spark, sf).mapInArrow(spell, schema)


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document, for sizing."""
    return bpe.count_tokens(fan_out(table(spark, sf, "documents").select("doc_id", "text")))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(fan_out(table(spark, sf, "documents").select("doc_id", "source", "text")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, sf), table(spark, sf, "mix_targets"))


#: How far the share of a source may lie from its target: a document is taken whole.
TOLERANCE = 0.05


def p9_reached(spark: SparkSession, sf: str) -> DataFrame:
    """Each listed source with its share of all tokens (the target among sources with documents, where it is met within TOLERANCE) and whether no document was taken too often."""
    s = p9_shares(spark, sf)
    with_documents = F.when(F.col("documents") > 0, F.col("target_share")).otherwise(0.0)
    expected = with_documents / F.sum(with_documents).over(Window.partitionBy(F.lit(0)))  # one row for each listed source
    met = F.abs(F.col("actual_share") - F.col("expected")) <= TOLERANCE
    return s.withColumn("expected", expected).select("source", F.when(met, F.col("expected")).otherwise(F.col("actual_share")).alias("share"), (F.col("most_copies") <= F.col("max_repeat")).alias("cap_kept"))


def split_limits(spark: SparkSession, sf: str) -> list[tuple[int, int, int]]:
    """The settings of problem 10: a table of fixed size, three rows."""
    return [(r.limit_id, r.max_tokens, r.overlap_tokens) for r in table(spark, sf, "split_limits").toLocalIterator()]


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_documents(fan_out(table(spark, sf, "documents").select("doc_id", "text")), split_limits(spark, sf))


def p10_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each text for each limit, put together again from its pieces without their overlaps; texts within a limit as they are."""
    one = F.struct("piece_no", "start_char", "end_char", "piece")
    told = p10_pieces(spark, sf).groupBy("doc_id", "limit_id").agg(F.array_sort(F.collect_list(one)).alias("ps"))  # the pieces of one text
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"))
    add = lambda acc, p: F.struct(p["end_char"].alias("end"), F.concat(acc["text"], F.substring(p["piece"], (acc["end"] - p["start_char"] + 1).cast("int"), F.length(p["piece"]))).alias("text"))
    whole = told.select("doc_id", "limit_id", F.aggregate("ps", start, add, lambda acc: acc["text"]).alias("joined"))
    limits = F.array(*(F.lit(i) for i, _, _ in split_limits(spark, sf)))
    every = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.explode(limits).alias("limit_id"))
    return every.join(whole, ["doc_id", "limit_id"], "left").select("doc_id", "limit_id", F.md5(F.coalesce("joined", "text").cast("binary")).alias("digest"))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling of an author with the entity it means."""
    meta = fan_out(table(spark, sf, "book_metadata").select("title", "author", "publisher"))
    texts = meta.select(F.explode(F.array("title", "author", "publisher")).alias("text")).filter("text IS NOT NULL AND text <> ''")
    return names.variants(meta, "author", texts)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.pairs(p1_entities(spark, sf))


def _cut(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    meta = fan_out(table(spark, sf, "book_metadata").select("meta_id", "source", "description"))
    return meta, truncation.truncated(meta)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf)[1].filter("cut").select("meta_id").distinct()


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of cut descriptions among the non-null ones of each source."""
    return truncation.shares(*_cut(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.copies(fan_out(table(spark, sf, "books").select("id", "title", "author", "file_path")))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.records(fan_out(table(spark, sf, "books").select("id", "title", "author", "file_path")))


GARBLED_FIELDS = ["title", "author", "publisher"]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(fan_out(table(spark, sf, "book_metadata").select("meta_id", *GARBLED_FIELDS)), GARBLED_FIELDS).select("meta_id", "field").distinct()


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Each garbled value with the best text that could be reached."""
    return mojibake.garbled(fan_out(table(spark, sf, "book_metadata").select("meta_id", *GARBLED_FIELDS)), GARBLED_FIELDS)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look(fan_out(table(spark, sf, "books").select("id", "title", "author")), ["title", "author"])


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with a partner of the same look: its class and the number of its partners."""
    return lookalike.look_classes(fan_out(table(spark, sf, "books").select("id", "title", "author")), ["title", "author"])


def p6_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(fan_out(table(spark, sf, "books").select("id", "title", "author")), ["title", "author"])


def single_tags(spark: SparkSession, sf: str) -> DataFrame:
    """(meta_id, tag): the single values of book_metadata.tags in lower case."""
    elements = multivalue.elements_of(fan_out(table(spark, sf, "book_metadata").select("meta_id", "tags")), "meta_id")
    values = multivalue.split_values(elements, keep=["row_id"], everything=True)
    return values.select(F.col("row_id").alias("meta_id"), cooccurrence.item_key(F.col("item")).alias("tag"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence.cooccurrence(single_tags(spark, sf), "meta_id", "tag", min_pairs=5, min_share=0.005, min_lift=4)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs with counts, lift and pointwise mutual information."""
    return cooccurrence.cooccurrence(single_tags(spark, sf), "meta_id", "tag")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_shares, p3_found, p3_records, p4_found, p4_restored, p6_found, p6_classes, p6_consistent, p7_found, p7_pairs, p8_ids, p8_roundtrip, p8_counts, p9_mixture, p9_shares, p9_reached, p10_pieces, p10_rejoined)}

def _canonical(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(upper({c})), '[ßẞ]', 'ss', 'g'), '[\\s\\p{{Z}}\\p{{Cc}}\\p{{P}}$+<=>^`|~]+', '', 'g')"


_RECORDS = f"""
p AS (SELECT id, title, author, regexp_replace(file_path, '[^/]*$', '') AS folder, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '[\\s\\p{{Z}}\\p{{P}}]+$', '') AS name FROM books),
q AS (SELECT id, folder, coalesce({_canonical('title')}, chr(3)) AS t, coalesce({_canonical('author')}, chr(3)) AS a, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.([^.]*)$', 1) AS ext FROM p),
k AS (SELECT id, least(t, a) || chr(1) || greatest(t, a) AS who, array_to_string(list_transform(string_split(folder, '/'), lambda x: {_canonical('x')}), '/') AS folder, {_canonical('ext')} AS ext,
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(stem, '[-‐‑‒–—―−－]'), lambda x: {_canonical('x')}), lambda x: x <> '')), chr(2)) AS parts FROM q),
r AS (SELECT who, folder, ext, parts, min(id) AS keep_id, count(*) AS copies FROM k GROUP BY ALL)
"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_RECORDS} SELECT DISTINCT r.keep_id, k.id AS copy_id FROM k JOIN r USING (who, folder, ext, parts) WHERE k.id <> r.keep_id",
    "p3_records": f"WITH {_RECORDS} SELECT keep_id, copies FROM r",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_reached": """
SELECT source, CASE WHEN has THEN target_share ELSE 0 END / sum(CASE WHEN has THEN target_share ELSE 0 END) OVER () AS share, true AS cap_kept
FROM (SELECT *, source IN (SELECT source FROM documents WHERE length(text) > 0) AND target_share > 0 AND max_repeat > 0 AS has FROM mix_targets)
""",
    "p10_rejoined": "SELECT doc_id, limit_id, md5(text) AS digest FROM documents, split_limits WHERE text IS NOT NULL",
}
