"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Every shard draws a number for a key from md5(key, shard); the shard with the smallest
-ln(draw) / weight takes the record. A shard that is added can only win records, so growing the
count moves records into the new shard alone, and the key and the shard count decide everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, whole_row


def key_text(key: Column) -> Column:
    """The key as text; null keys are the one key 'null'."""
    return F.coalesce(key.cast("string"), F.lit("null"))


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """A (score, shard) struct for each shard, the smallest of which takes the key. One md5 serves four shards."""
    digests = [F.md5(F.concat(key_text(key), F.lit(f":{block}"))) for block in range((len(weights) + 3) // 4)]
    drawn = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be above 0")
        lane = F.conv(F.substring(digests[shard // 4], 8 * (shard % 4) + 1, 8), 16, 10).cast("double")
        score = -F.log((lane + F.lit(0.5)) / F.lit(4294967296.0)) / F.lit(float(weight))
        drawn.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return drawn


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None,
           new_weight: float = 1.0) -> DataFrame:
    """Add the shard of each row, and in `grown` the shard it would have if one of `new_weight` were added.

    Works for any rows: null keys count as one key, repeated rows and equal keys share a shard, an
    empty table stays empty. Other columns pass through, whatever their names; `shard` and `grown` replace columns so named.
    """
    drawn = scores(F.col("key"), [*weights, *([new_weight] if grown else [])])
    rows = df.select(whole_row(df).alias("row"), F.col(key).alias("key"))
    rows = rows.select("row", F.array_min(F.array(*drawn[: len(weights)])).alias("best"), *([drawn[-1].alias("new")] if grown else []))
    added = {shard: F.col("best.shard")}
    if grown:
        added[grown] = F.when(F.col("new.score") < F.col("best.score"), F.col("new.shard")).otherwise(F.col("best.shard"))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in added]
    return rows.select(*kept, *[value.alias(name) for name, value in added.items()])


def slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int = 4096) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    A shard is cut into `buckets` parts by the md5 of the `order` columns. Parts are counted before
    the shuffle (at most shards x buckets counts, so their table has a bound and is broadcast) and
    numbered on their own, so no task ever holds a shard. Rows go by (part, order columns), nulls first;
    rows equal in all of these are interchangeable.
    """
    joined = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    part = F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long") % buckets
    rows = stage(df.withColumn("__part", part.cast("int")), "slots")
    counts = rows.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = rows.withColumn("__row", F.row_number().over(within))
    out = numbered.join(F.broadcast(offsets), F.col(shard).eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(slot, F.col("__before") + F.col("__row") - 1).drop("__s", "__p", "__part", "__before", "__row")


def shard_documents(documents: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    Null texts have size 16 and the checksum of no bytes (0); null keys are one key. Repeated rows share a shard and have slots of
    their own. An empty table gives no rows. Columns beyond key and text are not read.
    """
    base = documents.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"))
    placed = assign(base, "doc_id", weights, "shard", "grown_shard").withColumn("law", F.lit("key"))
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
