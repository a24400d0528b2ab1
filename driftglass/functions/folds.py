"""Fold assignment and equal-frequency bins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import with_ranks

#: The generator of shuffles (fixed values): multiplier, increment, the state that stands in for a seed of 0, what stratified ones are offset by.
MULTIPLIER, INCREMENT, ZERO_SEED, ONES_SEED, DEFAULT_SEED = 6364136223846793005, 1442695040888963407, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xDADA2026

WORD = 1 << 64


def permutation(n: int, seed: int = DEFAULT_SEED) -> list[int]:
    """What each place of a shuffled sequence of n holds: swaps from the end, partners by a 64-bit congruential generator."""
    state, order = seed % WORD or ZERO_SEED, list(range(n))
    for place in range(n - 1, 0, -1):
        state = (state * MULTIPLIER + INCREMENT) % WORD
        partner = state % (place + 1)
        order[place], order[partner] = order[partner], order[place]
    return order


def shuffled_folds(n: int, folds: int, seed: int = DEFAULT_SEED) -> list[int]:
    """The fold of each of n rows: its place in the permutation, modulo the number of folds."""
    out = [0] * n
    for place, row in enumerate(permutation(n, seed)):
        out[row] = place % folds
    return out


def blocked_fold(rank: Column, n: Column | int, folds: int) -> Column:
    """Contiguous folds: floor(rank * folds / n) for a 0-based rank."""
    return F.least(F.floor(rank * F.lit(folds) / n), F.lit(folds - 1)).cast("int")


def equal_frequency_bin(rank: Column, n: Column | int, bins: Column | int) -> Column:
    """The bin [i n / B, (i + 1) n / B) that a 0-based rank is in."""
    return F.floor(((rank + 1) * bins - 1) / n).cast("int")


def assign_folds(data: DataFrame, row_id: str, folds: int, partitioning: str = "blocked", seed: int = DEFAULT_SEED, response: str | None = None) -> DataFrame:
    """data with a column fold.

    Rows are ranked by id (within their response, for stratified folds) without gathering them. A shuffle is sequential by
    definition: one task makes the permutation of the ranks, holding a number per row, and rows are joined with their place in it.
    """
    spark = data.sparkSession
    if partitioning == "blocked":
        ranked = with_ranks(data, [row_id], "__rank")
        return ranked.withColumn("fold", blocked_fold(F.col("__rank"), ranked.count(), folds)).drop("__rank")
    kind = F.col(response).cast("int") if partitioning == "stratified" else F.lit(0)
    ranked = with_ranks(data.withColumn("__kind", kind), ["__kind", row_id], "__rank")
    sizes = {r["__kind"]: r["count"] for r in ranked.groupBy("__kind").count().collect()}  # one kind, or the two of a response
    starts = {k: sum(n for j, n in sizes.items() if j < k) for k in sizes}

    def deal(batches):
        for _ in batches:
            for k, n in sizes.items():
                dealt = shuffled_folds(n, folds, seed ^ ONES_SEED if k == 1 else seed)
                for s in range(0, n, 1 << 16):
                    part = dealt[s:s + (1 << 16)]
                    yield pd.DataFrame({"__at": range(starts[k] + s, starts[k] + s + len(part)), "fold": part})

    dealt = spark.range(1).coalesce(1).mapInPandas(deal, "__at long, fold int")
    return ranked.join(dealt, F.col("__rank") == F.col("__at")).drop("__rank", "__at", "__kind")
