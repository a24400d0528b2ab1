"""Tables written to the folder that driver and executors share, and ranks that rest on them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run in one process, as in tests, it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        folder = tempfile.mkdtemp(prefix="driftglass-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder.append("file://" + folder)
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost nothing.

    unstage() deletes it; what a result still reads is deleted when the application ends.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


#: Narrow rows that a file of a small table holds, about.
FILE_ROWS = 100_000


def gathered(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, to be staged, in files of about `each` rows, at least one for each core, if it has so few rows that its shuffle partitions would be much smaller files.

    rows is at least about df's number. On a local disk each file starts several processes (chmod), each of which shows the whole executor's
    memory until it runs. Rows are dealt out in turn, so no key's rows end in one task, and what makes them keeps its tasks; large tables stay as they are.
    """
    spark = df.sparkSession
    files = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.repartition(files) if 8 * files <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def unstage(*staged: DataFrame) -> None:
    """Delete what stage() wrote, once nothing reads it any more."""
    for df in staged:
        delete(df.sparkSession, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's process ends, if it is still there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def with_ranks(data: DataFrame, order: list[str | Column], name: str = "rank", rows: int | None = None) -> DataFrame:
    """data with the place of each row (from 0, without gaps) in the given order; rows that are equal in it are interchangeable.

    Rows are dealt into ranges of the order, numbered within them and shifted by what comes before, so no task
    holds more than a range; only one count per range is broadcast. With their number, few rows are few files.
    """
    spark = data.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = data.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).withColumn("__place", F.monotonically_increasing_id())
    placed = stage(placed if rows is None else gathered(placed, rows), "ranks")
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return ranked.withColumn(name, at + F.col("__shift")).drop("__part", "__place", "__shift")
