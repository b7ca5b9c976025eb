"""Mixing sources to target shares of all tokens (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from librarium.llm.bpe import TOKENIZER_DIR, count_tokens
from librarium.session import checkpoint

#: Ranges of the random key per source: prefix sums run inside a range, so no task holds a whole source.
RANGES = 1024
#: Repeats of a row are numbered in arrays of so many.
PART = 1 << 16


def _sized(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, seed: int, tokenizer: str, folder: str) -> tuple[DataFrame, DataFrame]:
    wanted = (
        targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeat") > 0))
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    )
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = count_tokens(narrow, keep=["doc_id", "source"], name=tokenizer, folder=folder).filter("n_tokens > 0 AND source IS NOT NULL")
    sized = sized.join(F.broadcast(wanted.select("source")), "source", "left_semi")
    # rows that repeat a doc_id and a size are alike: they are counted (combined in each task) and numbered, whatever the layout of the input
    alike = sized.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    parts = alike.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {PART})")).alias("part"))
    rows = parts.select("doc_id", "source", "n_tokens", F.explode(F.expr(f"sequence(part * {PART}, least(n, (part + 1) * {PART}) - 1)")).alias("repeat"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("n_tokens"), F.col("repeat"))
    return rows.withColumn("key", h).withColumn("range", F.pmod(F.shiftright(h, 40), F.lit(RANGES)).cast("int")), wanted


def mixture(
    docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
    tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR,
) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each chosen document is taken; documents not taken give no row.

    Every source that is listed in `targets` (source, target_share, max_repeat) and has documents gets its share of
    `total_tokens`; the shares of listed sources without documents are spread over the others in proportion. Without
    total_tokens the largest total is taken at which no source needs a document more than max_repeat times. With a
    total beyond that, short sources give all they may and the shares report shows it.

    A source's budget is met by whole epochs and one partial epoch: documents get a hash-random key, the key space is
    cut into ranges, token sums per range are added up in order, and a document is in the partial epoch if the running
    sum up to its middle does not pass the budget, so a source misses its budget by half a document at most.

    Defined results: null or empty texts have no tokens and are never taken; null sources and sources not listed are
    left out; rows that repeat a doc_id count as documents of their own, each with a key of its own; ties
    of the key are broken by doc_id, n_tokens and the number of the repeat.

    Cost: the text column is read once to count tokens and is dropped before two shuffles of a few numbers per
    document, by (doc_id, source, n_tokens) and by (source, range). What is gathered per source is RANGES sums.
    """
    sized, wanted = _sized(docs, targets, key, text, source, seed, tokenizer, folder)
    sized = checkpoint(sized)
    ranges = sized.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy("range")
    upto = ranges.withColumn("before", F.sum("tokens").over(order) - F.col("tokens")).withColumn("available", F.sum("tokens").over(Window.partitionBy("source")))
    # one row per listed source (and RANGES rows per source below): the size is bounded by the targets table
    budget = budgets(upto.select("source", "available").distinct(), wanted, total_tokens)
    plan = upto.drop("available").join(budget, "source").select("source", "range", "before", "budget", "available", "max_repeat")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "n_tokens", "repeat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.floor(F.col("budget") / F.col("available"))
    middle = F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens") / 2
    rest = F.col("budget") - epochs * F.col("available")
    copies = F.least(epochs + F.when(middle <= rest, 1).otherwise(0), F.col("max_repeat")).cast("int")
    return sized.join(F.broadcast(plan), ["source", "range"]).withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def budgets(available: DataFrame, wanted: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, available, max_repeat, share, budget) of the listed sources that have documents; one row per source."""
    b = available.join(F.broadcast(wanted), "source")
    every = Window.partitionBy(F.lit(0))  # as many rows as the targets table has
    b = b.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    reach = F.min(F.col("available") * F.col("max_repeat") / F.col("share")).over(every)
    total = F.floor(reach) if total_tokens is None else F.lit(float(total_tokens))
    b = b.withColumn("budget", F.least(F.col("share") * total, F.col("available") * F.col("max_repeat")))
    return b.select("source", "available", "max_repeat", "target_share", "share", "budget")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares a mixture reached, one row for each listed source, those without documents included (0 tokens)."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    every = Window.partitionBy(F.lit(0))
    return (
        targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeat").join(per, "source", "left")
        .na.fill(0, ["documents", "copies", "tokens", "most_copies"])
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
        .select("source", "target_share", "actual_share", "documents", "copies", "tokens", "most_copies", "max_repeat")
    )


def expand_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, with `epoch` from 0."""
    return mixed.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))


__all__ = ["budgets", "expand_copies", "mixture", "shares"]
