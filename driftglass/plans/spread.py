"""Neighbours and kernel means of tables of any number of rows: no task and not the driver holds them all.

Rows are dealt into boxes (blocks of ranks in one dimension); only a few numbers for each box are collected and broadcast. A group that a task
works on holds the rows of two boxes at most, however the rows lie.
"""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.neighbours import nearest, neighbour_count, tricube
from ..shipping import ship_package
from ..sources.binding import as_number, finite, finite_rows
from ..sources.staging import stage, unstage, with_ranks

#: Different points in a box, about.
BOX = 2000


# --- nearest rows --------------------------------------------------------------------------


def _boxed(points: DataFrame, names: list[str], size: int) -> DataFrame:
    """points (staged) with a box: by each coordinate in turn, every group is cut into parts of equal counts."""
    n = points.count()
    parts = max(1, round((n / size) ** (1 / len(names))))
    held = points.withColumn("box", F.lit(0).cast("long"))
    for name in names if parts > 1 else ():
        ranked = with_ranks(held, ["box", name], "__rank")
        groups = ranked.groupBy("box").agg(F.min("__rank").alias("__start"), F.count("*").alias("__n"))  # fewer rows than boxes
        held = ranked.join(F.broadcast(groups), "box").withColumn("box", F.expr(f"box * {parts} + ((__rank - __start) * {parts}) div __n")).select(points.columns + ["box"])
    return stage(held, "boxes")


def _candidates(rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, keys) of all that the points of a box hold, by key."""
    keys = np.concatenate(rows["keys"].to_numpy())
    x = np.repeat(rows[names].to_numpy(float), [len(held) for held in rows["keys"]], axis=0)
    order = np.argsort(keys, kind="stable")
    return x[order], keys[order]


def _squares(train: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, _ = nearest(train, queries, k)
    return at, ((queries[:, None, :] - train[at]) ** 2).sum(axis=2)


def nearest_rows(data: DataFrame, features: list[str], key: str, k: int, size: int = BOX) -> DataFrame:
    """(query, rank from 1, neighbour, d2): the k nearest rows of every row, itself included, nearest first, ties to the smaller key.

    Rows of one point share an answer and only their k smallest keys can be in one, so answers are found for different points and joined to
    the rows. A point's box gives k rows and so a bound; other boxes are visited where they reach within it. Distances from and to rows that
    are not finite are null and come last, by key.
    """
    spark = data.sparkSession
    ship_package(spark)
    names = [f"x{j}" for j in range(len(features))]
    rows = data.select(F.col(key).alias("key"), *[as_number(data, c).alias(n) for c, n in zip(features, names)])
    kind = dict(rows.dtypes)["key"]
    fine = finite_rows(rows, names)
    first = fine.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("key"))).filter(F.col("__n") <= k)
    points = stage(first.groupBy(*names).agg(F.sort_array(F.collect_list("key")).alias("keys")), "points")
    boxed = _boxed(points, names, size)
    bounds = boxed.groupBy("box").agg(*[f(n) for n in names for f in (F.min, F.max)]).orderBy("box").toPandas().to_numpy()  # a row for each box
    shared = spark.sparkContext.broadcast((bounds[:, 0].astype(np.int64), bounds[:, 1::2].astype(float), bounds[:, 2::2].astype(float)))

    def within(own: pd.DataFrame) -> pd.DataFrame:
        x, (train, keys) = own[names].to_numpy(float), _candidates(own, names)
        at, d2 = _squares(train, x, k)
        reach = d2[:, -1] if at.shape[1] == k else np.full(len(x), np.inf)
        ids, low, high = shared.value
        gap = (np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high)) ** 2).sum(axis=1)
        near = np.flatnonzero((gap <= reach.max()) & (ids != own["box"].iloc[0]))
        visits = []
        for q, r in zip(x, reach):
            # Equal points are one point, so nothing else is at distance 0.
            away = (np.maximum(0, np.maximum(low[near] - q, q - high[near])) ** 2).sum(axis=1) if r > 0 and len(near) else np.empty(0)
            visits.append(ids[near[np.flatnonzero(away <= r)]] if len(away) else ids[:0])
        return own[["box", *names]].assign(reach=reach, keys=list(keys[at]), d2=list(d2), visits=visits)

    def visiting(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        train, keys = _candidates(held, names)
        at, d2 = _squares(train, asked[names].to_numpy(float), k)
        return asked[names].assign(keys=list(keys[at]), d2=list(d2))

    columns = ", ".join(f"{n} double" for n in names)
    found = stage(boxed.groupBy("box").applyInPandas(within, f"box long, {columns}, reach double, keys array<{kind}>, d2 array<double>, visits array<long>"), "within")
    asked = found.select("box", *names, F.explode("visits").alias("visit"))
    held = asked.select(F.col("visit").alias("of"), F.col("box").alias("by")).distinct().join(boxed.withColumnRenamed("box", "of"), "of")
    more = asked.groupBy("visit", "box").cogroup(held.groupBy("of", "by")).applyInPandas(visiting, f"{columns}, keys array<{kind}>, d2 array<double>")
    each = found.select(*names, "keys", "d2").union(more).select(*names, F.explode(F.arrays_zip("d2", "keys")).alias("c"))
    answers = stage(each.groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("c")), 1, k).alias("found")), "answers")
    unstage(points, boxed, found)

    # What is not finite: at no distance, behind everything else.
    odd = rows.filter(~reduce(and_, [finite(n) for n in names]))
    last = [r.key for r in odd.orderBy("key").limit(k).collect()]
    by_key = [r.key for r in rows.orderBy("key").limit(k).collect()] if last else []
    none = lambda keys: F.array(*[F.struct(F.lit(None).cast("double").alias("d2"), F.lit(v).cast(kind).alias("keys")) for v in keys])
    told = fine.join(answers, names).select("key", F.slice(F.concat("found", none(last)), 1, k).alias("found") if last else "found")
    if last:
        told = told.union(odd.select("key", none(by_key)))
    return told.select(F.col("key").alias("query"), F.posexplode("found").alias("rank", "c")).select("query", (F.col("rank") + 1).alias("rank"), F.col("c.keys").alias("neighbour"), F.col("c.d2").alias("d2"))


# --- kernel means --------------------------------------------------------------------------


_TERMS = ((0, 1.0), (3, -3.0), (6, 3.0), (9, -1.0))


def _far_sums(q: np.ndarray, h: np.ndarray, inside: np.ndarray, side: float, blocks: np.ndarray) -> np.ndarray:
    """(queries x 2) tricube sums, of 1 and of the response, over whole blocks on one side: the kernel is a polynomial there, and blocks tell their moments.

    blocks: centre, half width, ten moments of the rows and ten of the responses; inside (queries x blocks) says which count.
    """
    a, b = (blocks[None, :, 0] - q[:, None]) / h[:, None], blocks[None, :, 1] / h[:, None]
    a, b = np.where(inside, a, 0.0), np.where(inside, b, 0.0)
    powers = [np.ones_like(a)]
    for _ in range(9):
        powers.append(powers[-1] * a)
    out, scale = np.zeros((len(q), 2)), np.ones_like(b)
    for j in range(10):
        c = sum(sign * side**p * comb(p, j) * powers[p - j] for p, sign in _TERMS if p >= j) * scale * inside
        out += np.stack([(c * blocks[None, :, 2 + j]).sum(axis=1), (c * blocks[None, :, 12 + j]).sum(axis=1)], axis=1)
        scale = scale * b
    return out


def local_means(data: DataFrame, feature: str, response: str, span: float, least: int = 2, size: int | None = None) -> DataFrame:
    """(x, y, fit): at every row the locality-weighted mean response of its nearest rows (tricube; a share `span` of all, `least` at least).

    That is what a local likelihood of degree 0 comes to for every family, short of the bounds of its link, and an iteration is not needed. Rows
    that are not finite in both columns are left out. Ranks are cut into blocks of `size` rows (about half the root of the number of rows). Where a row's window
    begins follows from one more ranking: at row s begins the window of those x above half of x[s - 1] + x[s - 1 + k]. Blocks at the ends of the window, and the
    row's own, are summed row by row, those between by their moments, so the work grows with n ** 1.5.
    """
    spark = data.sparkSession
    ship_package(spark)
    rows = finite_rows(data.select(as_number(data, feature).alias("x"), F.col(response).cast("double").alias("y")), ["x", "y"])
    ranked = stage(with_ranks(rows, ["x", "y"], "r"), "ranked")
    n = ranked.count()
    if not n:
        return ranked.select("x", "y", F.col("y").alias("fit"))
    k, size = neighbour_count(n, span, least), size or max(64, int(np.ceil(np.sqrt(n) / 2)))
    ahead = ranked.select((F.col("r") - k).alias("r"), F.col("x").alias("__ahead"))
    middles = ranked.join(ahead, "r").select((F.col("x") + F.col("__ahead")).alias("m"), F.lit(1).alias("kind"), "r")
    twice = ranked.select((F.col("x") + F.col("x")).alias("m"), F.lit(0).alias("kind"), "r")
    placed = with_ranks(twice.union(middles), ["m", "kind", "r"], "place").filter("kind = 0")  # r rows, the others are middles below
    own = placed.select("r", (F.col("m") / 2).alias("q"), (F.col("place") - F.col("r")).alias("low"), (F.col("place") - F.col("r") + k - 1).alias("high"))
    ends = [ranked.select(F.col("r").alias(c), F.col("x").alias(f"x_{c}")) for c in ("low", "high")]
    queries = stage(own.join(ends[0], "low").join(ends[1], "high").select("r", "q", "low", "high", F.greatest(F.col("q") - F.col("x_low"), F.col("x_high") - F.col("q")).alias("h")), "windows")

    def moments(held: pd.DataFrame) -> pd.DataFrame:
        x, y = held["x"].to_numpy(float), held["y"].to_numpy(float)
        centre = x.min() / 2 + x.max() / 2
        half = np.abs(x - centre).max()
        t = ((x - centre) / (half if half > 0 else 1.0))[:, None] ** np.arange(10)
        return pd.DataFrame({"block": held["block"].iloc[:1], "m": [np.r_[centre, half, t.sum(axis=0), (t * y[:, None]).sum(axis=0)]]})

    block = F.expr(f"r div {size}")
    blocked = ranked.withColumn("block", block)
    sums = blocked.groupBy("block").applyInPandas(moments, "block long, m array<double>").orderBy("block").toPandas()  # a row for each block
    shared = spark.sparkContext.broadcast(np.array(sums["m"].tolist(), dtype=float))

    def part(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        q, h, low, high = (asked[c].to_numpy() for c in ("q", "h", "low", "high"))
        h = np.where(h > 0, h, 1.0)  # of 0, all of the window are at distance 0
        x, y, r = (held[c].to_numpy() for c in ("x", "y", "r"))
        out = np.empty((len(q), 2))
        for s in range(0, len(q), 256):
            p = slice(s, s + 256)
            w = tricube(np.abs(x[None, :] - q[p, None]) / h[p, None]) * ((r >= low[p, None]) & (r <= high[p, None]))
            out[p] = np.stack([w.sum(axis=1), w @ y], axis=1)
            if key[0] == key[1]:
                mine, every = int(key[1]), shared.value
                first, stop = -(-low[p] // size), np.where(high[p] == n - 1, len(every), (high[p] + 1) // size)
                for side, begin, end in ((-1.0, int(first.min()), mine), (1.0, mine + 1, int(stop.max()))):
                    if begin < end:
                        at = np.arange(begin, end)
                        out[p] += _far_sums(q[p], h[p], (at >= first[:, None]) & (at < stop[:, None]), side, every[begin:end])
        return pd.DataFrame({"r": asked["r"].to_numpy(), "w": out[:, 0], "wy": out[:, 1]})

    left, right = F.expr(f"low div {size}"), F.expr(f"high div {size}")
    cut_left = (left < block) & (F.col("low") % size != 0)
    cut_right = (right > block) & ((F.col("high") + 1) % size != 0) & (F.col("high") != n - 1)
    asked = queries.select("*", block.alias("own"), F.explode(F.array_compact(F.array(block, F.when(cut_left, left), F.when(cut_right, right)))).alias("block"))
    held = asked.select(F.col("block").alias("of"), F.col("own").alias("by")).distinct().join(blocked.withColumnRenamed("block", "of"), "of")
    parts = asked.groupBy("block", "own").cogroup(held.groupBy("of", "by")).applyInPandas(part, "r long, w double, wy double")
    fits = parts.groupBy("r").agg((F.sum("wy") / F.sum("w")).alias("fit"))
    return ranked.join(fits, "r").select("x", "y", "fit")
