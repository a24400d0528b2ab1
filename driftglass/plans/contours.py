"""Grids and contour lines as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, x_range, y_range, x_count: int, y_count: int) -> DataFrame:
    """(yi, xi, x, y): a regular grid of x_count times y_count points, made without a shuffle."""
    n = spark.range(x_count * y_count)
    yi, xi = F.floor(F.col("id") / x_count).cast("int"), (F.col("id") % x_count).cast("int")
    place = lambda i, r, c: F.lit(float(r[0])) + F.lit(float(r[1] - r[0])) * i.cast("double") / F.lit(float(c - 1))
    return n.select(yi.alias("yi"), xi.alias("xi"), place(xi, x_range, x_count).alias("x"), place(yi, y_range, y_count).alias("y"))


def segments(surface: DataFrame, levels: list[float]) -> DataFrame:
    """Contour segments (level, yi, xi, part, x0, y0, x1, y1) of a surface (yi, xi, x, y, value) by marching squares.

    A cell's corners meet through one window along x and one equi-join with the next row; cells with a value that is not
    finite are left out. Edges run (low left, low right, high right, high left); an edge is cut if exactly one end is above the level.
    Four cut edges make two segments, of the first and the last two.
    """
    along = Window.partitionBy("yi").orderBy("xi")
    ahead = lambda c: F.lead(c).over(along)
    pair = surface.select("yi", "xi", "x", "y", "value", ahead("xi").alias("xn"), ahead("x").alias("x2"), ahead("value").alias("v2")).filter("xn = xi + 1")
    above = pair.select((F.col("yi") - 1).alias("yi"), "xi", F.col("y").alias("y2"), F.col("value").alias("v4"), F.col("v2").alias("v3"))
    cells = pair.join(above, ["yi", "xi"])
    finite = F.lit(True)
    for c in ("value", "v2", "v3", "v4"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    known = [v for v in levels if v == v and abs(v) != float("inf")]
    cells = cells.filter(finite).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in known]) if known else F.array().cast("array<double>")))
    corners = [("x", "y", "value"), ("x2", "y", "v2"), ("x2", "y2", "v3"), ("x", "y2", "v4")]
    level = F.col("level")

    def cut(a, b) -> Column:
        (xa, ya, va), (xb, yb, vb) = ([F.col(c) for c in corner] for corner in (a, b))
        crossed = ((va <= level) & (vb > level)) | ((va > level) & (vb <= level))
        t = (level - va) / (vb - va)
        return F.when(crossed, F.struct((xa + t * (xb - xa)).alias("x"), (ya + t * (yb - ya)).alias("y")))

    points = F.array_compact(F.array(*[cut(corners[k], corners[(k + 1) % 4]) for k in range(4)]))
    cells = cells.withColumn("points", points).filter(F.size("points") >= 2)
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), (F.size("points") / 2).cast("int") - 1)))
    a, b = F.get("points", F.col("part") * 2), F.get("points", F.col("part") * 2 + 1)
    return cells.select("level", "yi", "xi", "part", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
