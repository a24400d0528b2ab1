"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target words / source words. Along
the source's documents, ordered by size and then by a hash, the expected copies are summed; a document
is emitted once for every whole number that the sum (plus one random offset per source) crosses. The
order by size spreads the emitted copies evenly over long and short documents, so the words taken differ
from the target by no more than about the longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, unstage, whole_row

#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each row of sizes(source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn. Together they get `share` of all
    words by weight; no source gets over `ceiling` times its words, and what it leaves is shared among
    the others. That fixed point is a water level: a source is full exactly if filling all sources to
    its own level (ceiling * words / weight) needs no more than there is.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())  # one row per source, not per document
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everywhere = Window.partitionBy()
    level = Window.orderBy("__level").rangeBetween(Window.unboundedPreceding, 0)
    t = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(ceiling))
    t = t.withColumn("__level", F.col("__cap") / F.col("__w"))
    t = t.withColumn("__total", F.sum("source_size").over(everywhere) * F.lit(share))
    t = t.withColumn("__weights", F.sum("__w").over(everywhere))
    t = t.withColumn("__need", F.sum("__cap").over(level) + F.col("__level") * (F.col("__weights") - F.sum("__w").over(level)))
    t = t.withColumn("__full", F.col("__need") <= F.col("__total"))
    used = F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(everywhere)
    free = F.sum(F.when(~F.col("__full"), F.col("__w")).otherwise(0.0)).over(everywhere)
    t = t.withColumn("__used", used).withColumn("__free", free)
    water = F.col("__w") * (F.col("__total") - F.col("__used")) / F.when(F.col("__free") > 0, F.col("__free"))
    return t.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(water, F.col("__cap"))).alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn for the source, a multiple of 2**-20 so that sums with it stay exact."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 5), 16, 10).cast("double") / 1048576.0


def expected_copies(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """Add source_size, target and copies to rows(doc_id, size, source, __tie, ...).

    Ranks within a source come from one range partitioning by (source, size, __tie): rows keep their place in
    their part, parts are counted, and the counts (one row per part and source) are summed. No task
    holds a source, and rows equal in all of these are interchangeable. Rows are written first, for partitioning
    looks at all of them to find its bounds and would count words twice.
    """
    spark = rows.sparkSession
    rows = stage(rows, "mixing-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("__tie").asc()]
    place = F.monotonically_increasing_id()
    placed = stage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__place", place), "mixing")
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    unstage(rows)
    counts = placed.groupBy(part.alias("__part"), "source").agg(
        F.count("*").alias("__n"), F.min(at).alias("__first"), F.sum("size").alias("__size"))
    counts = stage(counts, "mixing-counts")
    sizes = counts.groupBy("source").agg(F.sum("__size").alias("source_size"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shares = targets(sizes, weights, share, ceiling)
    told = counts.select("__part", "source", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    told = told.join(shares.withColumnRenamed("source", "__src"), F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    told = told.withColumnRenamed("source", "__src").withColumnRenamed("__part", "__p")
    found = placed.withColumn("__part", part).join(told, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__src")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, offset = at + F.col("__shift"), _offset(F.col("source"), seed)
    copies = F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)
    return (found.withColumn("copies", F.least(copies, F.lit(int(ceiling))).cast("long"))  # rounding may not add a copy
            .drop("__part", "__p", "__src", "__shift", "__place"))


def tie(key: Column, text: Column) -> Column:
    """Puts documents of one size in an order of their own: md5 of the id and of the text."""
    return F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def mix_documents(documents: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, repeated rows each on their own.

    Null or empty texts have size 0 and take 0 words; a null source is a source of its own; a source
    without words has target 0; an empty table gives no rows. Further columns are not read.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie(F.col("doc_id"), F.col("text")).alias("__tie"))
    return expected_copies(rows, weights, share, ceiling, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(documents: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns it came with, whatever their names."""
    rows = documents.select(
        whole_row(documents).alias("__row"), F.col("source").alias("source"),
        word_count(F.col("text")).alias("size"), tie(F.col("doc_id"), F.col("text")).alias("__tie"))
    mixed = expected_copies(rows, weights, share, ceiling, seed).filter("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")
