"""Natural breaks of groups with very many distinct values: the layers of the search as tables of blocks.

With values in order, the least cost of c classes up to a place is the least, over where the last class begins, of
the cost of c - 1 classes before it and the spread inside it. The best beginning never moves down as the place moves up. So each
layer takes two passes: first the best beginnings of the blocks' last places only, then each block searches the few
blocks between its own and its predecessor's. A task holds two blocks of places, whatever the size of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

#: Columns of a place: distinct values up to it, their rows, sum and sum of squares (of differences from the group's mean).
SUMS = ["c", "s", "q"]


def places(often: DataFrame, block: int) -> DataFrame:
    """g, p, b, x, c, s, q: the distinct values (g, x, n) of each group in order, with running sums; place 0 is before the first.

    Values are dealt by ranges; a range's sums begin with those of the ranges before it.
    """
    means = often.groupBy("g").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_mean"))
    y = F.col("x") - F.col("_mean")
    rows = often.join(F.broadcast(means), "g").select("g", "x", F.lit(1).alias("p"), F.col("n").alias("c"), (F.col("n") * y).alias("s"), (F.col("n") * y * y).alias("q"))
    rows = cut(rows.repartitionByRange("g", "x").withColumn("_part", F.spark_partition_id()))
    sums = ["p", *SUMS]
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("g", "_part").agg(*[F.sum(v).alias(v) for v in sums])
    parts = parts.select("g", "_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in sums])
    inside = Window.partitionBy("g", "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("g", "_part", "x", *[F.sum(v).over(inside).alias(v) for v in sums]).join(F.broadcast(parts), ["g", "_part"])
    placed = placed.select("g", "x", (F.col("p") + F.col("_p")).alias("p"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in SUMS])
    zero = means.select("g", F.lit(None).cast("double").alias("x"), F.lit(0).cast("long").alias("p"), *[F.lit(0.0).alias(v) for v in SUMS])
    return cut(placed.unionByName(zero).withColumn("b", F.expr(f"p div {block}")))


def _least(first: int, cost: np.ndarray, before: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places ``ends`` (in order; sums ``ends``) those with a beginning among first, first + 1, ...: (which, cost, best beginning).

    ``before``: the sums at the beginnings, a row each of SUMS. Halves are searched between their neighbours' best.
    """
    total, best = np.full(len(at), np.inf), np.full(len(at), -1)
    todo = [(int(np.searchsorted(at, first, "right")), len(at) - 1, 0, len(cost) - 1)]
    while todo:
        low, high, left, right = todo.pop()
        if low > high:
            continue
        j = (low + high) // 2
        upto = min(right, int(at[j]) - 1 - first)
        n, s, q = (ends[k, j] - before[k, left : upto + 1] for k in range(3))
        costs = cost[left : upto + 1] + q - s * s / n
        k = int(np.argmin(costs))
        total[j], best[j] = costs[k], first + left + k
        todo += [(low, j - 1, left, left + k), (j + 1, high, left + k, right)]
    found = np.flatnonzero(np.isfinite(total))
    return found, total[found], best[found]


def _search(piece: pd.DataFrame) -> pd.DataFrame:
    """The costs and best beginnings (g, p, cost, i) of one piece: a block of beginnings, and the ends of another block or of all."""
    r = piece.iloc[0]
    which, cost, best = _least(int(r["ip"][0]), r["icost"], np.stack([r["ic"], r["is"], r["iq"]]), r["jp"], np.stack([r["jc"], r["js"], r["jq"]]))
    return pd.DataFrame({"g": r["g"], "p": r["jp"][which], "cost": cost, "i": best})


def _searched(pieces: DataFrame) -> DataFrame:
    """g, p, cost, i: the best over all ``pieces`` (g, b, jb, i, j), each searched by itself, so that a task holds one at a time."""
    flat = pieces.select("g", "b", "jb", *[F.col(f"i.{v}").alias(f"i{v}") for v in ("p", *SUMS, "cost")], *[F.col(f"j.{v}").alias(f"j{v}") for v in ("p", *SUMS)])
    found = flat.groupBy("g", "b", "jb").applyInPandas(_search, "g long, p long, cost double, i long")
    return cut(found.groupBy("g", "p").agg(F.min(F.struct("cost", "i")).alias("m")).select("g", "p", "m.cost", "m.i"))


def large_breaks(often: DataFrame, classes: int, block: int) -> DataFrame:
    """g, breaks: natural breaks of each group of distinct values (g, x, n: often); each has at least ``classes`` of them."""
    table = places(often, block)
    lists = cut(table.groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("p", *SUMS))).alias("j")))
    lasts = cut(lists.select("g", "b", F.element_at("j", -1).alias("end")))
    edges = lasts.groupBy("g").agg(F.sort_array(F.collect_list("end")).alias("j"))
    # Costs of one class; none of no values.
    costs = table.select("g", "p", "b", *SUMS, F.when(F.col("p") > 0, F.col("q") - F.col("s") * F.col("s") / F.col("c")).otherwise(float("inf")).alias("cost"))
    layers = []
    for _ in range(1, classes):
        starts = cut(costs.groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("p", *SUMS, "cost"))).alias("i")))
        tops = _searched(starts.join(edges, "g").withColumn("jb", F.lit(-1).cast("long"))).select("g", "p", F.expr(f"i div {block}").alias("top"))
        # Blocks whose beginnings may serve a block: from its predecessor's best to its own.
        span = lasts.select("g", "b", F.col("end.p").alias("p")).join(tops, ["g", "p"], "left").select("g", "b", F.coalesce("top", F.lit(0)).alias("top"))
        span = span.withColumn("low", F.lag("top", 1, 0).over(Window.partitionBy("g").orderBy("b")))
        pieces = span.select("g", F.col("b").alias("jb"), F.explode(F.sequence(F.least("low", "top"), "top")).alias("b"))
        layer = _searched(pieces.join(starts, ["g", "b"]).join(lists.select("g", F.col("b").alias("jb"), "j"), ["g", "jb"]))
        layers.append(layer.select("g", "p", "i"))
        costs = table.select("g", "p", "b", *SUMS).join(layer.select("g", "p", "cost"), ["g", "p"], "left").withColumn("cost", F.coalesce("cost", F.lit(float("inf"))))
    at = table.groupBy("g").agg(F.max("p").alias("p"))
    chosen = at.select("g", F.lit(classes).alias("k"), "p")
    for k, layer in zip(range(classes - 1, 0, -1), reversed(layers)):
        at = at.join(layer, ["g", "p"]).select("g", F.col("i").alias("p"))
        chosen = chosen.unionByName(at.select("g", F.lit(k).alias("k"), "p"))
    limits = chosen.join(table.select("g", "p", "x"), ["g", "p"])
    return limits.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("breaks"))
