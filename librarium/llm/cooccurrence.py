"""Items that appear together: pair counts, lift and pointwise mutual information (problem 7)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from librarium.session import checkpoint, maybe_broadcast


def cooccurrence(baskets: DataFrame, basket: str, item: str, *, min_pairs: int = 1, min_share: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi) of every pair of items that meet in a basket, item_a < item_b.

    baskets: one row per basket and item. Counted are baskets, so an item that repeats in a basket counts once.
    Kept are pairs with n_ab >= min_pairs, n_ab >= min_share * n and n_ab * n >= min_lift * n_a * n_b; n is the number
    of baskets that have at least one item. The bounds are exact: an item below the first two cannot be in such a pair
    and is left out before pairs are made, which with min_share = s leaves at most (mean basket size) / s items,
    whatever the size of the data. Without a bound all pairs are counted.

    Defined results: null baskets and null items are ignored; an empty table gives no rows; items are compared as they
    stand, in code point order.

    Skew: rows are made distinct by (basket, item), so neither a hot item nor a hot basket gathers its repeats in one
    task; item counts and pair counts are combined before they are shuffled (partial aggregation), so a pair that a
    third of all baskets hold costs one row per task. Only kept items form a basket's array, which the bounds limit;
    pairs are made inside it, and nothing is joined to itself.
    """
    clean = baskets.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).filter("_b IS NOT NULL AND _i IS NOT NULL")
    # (basket, item) once; a hot basket and a hot item are both spread, since both make up the key
    once = checkpoint(clean.distinct())
    n = once.select("_b").distinct().count()  # one number
    least = max(1, min_pairs, math.ceil(min_share * n - 1e-9))
    counts = once.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    kept = once.join(maybe_broadcast_counts(counts.select("_i"), min_share), "_i", "left_semi") if least > 1 else once
    sets = kept.groupBy("_b").agg(F.array_sort(F.collect_list("_i")).alias("_items"))
    sets = sets.filter(F.size("_items") > 1)
    # item_a with the items after it: arrays of one basket, exploded twice
    heads = sets.select(F.posexplode("_items").alias("_p", "item_a"), "_items").select("item_a", F.explode(F.expr("slice(_items, _p + 2, size(_items))")).alias("item_b"))
    pairs = heads.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= least)
    side = lambda x: maybe_broadcast_counts(counts.select(F.col("_i").alias(f"item_{x}"), F.col("_n").alias(f"n_{x}")), min_share)
    out = pairs.join(side("a"), "item_a").join(side("b"), "item_b").withColumn("n", F.lit(n).cast("long"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    out = out.filter(F.col("n_ab").cast("double") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")) if min_lift else out
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))


def maybe_broadcast_counts(counts: DataFrame, min_share: float) -> DataFrame:
    """Broadcast where the support bound proves the side small (at most 1e5 items of mean basket size 1), else let the planner choose."""
    return F.broadcast(counts) if min_share >= 1e-4 else maybe_broadcast(counts)


def item_key(item: Column) -> Column:
    """Tags compare in lower case and trimmed."""
    return F.lower(F.trim(item))
