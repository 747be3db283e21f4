"""Model runs, optimisation, Morris trajectories, natural breaks.

A generation of parameter sets is one table, evaluated by the cluster; the driver keeps only the
population, whose size is a setting and not a matter of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.operators.breaks import large_breaks
from catchment.operators.iterate import cut


def evaluate(spark: SparkSession, points: np.ndarray, score: Callable[[list[Column]], Column]) -> np.ndarray:
    """Scores of parameter sets (rows of ``points``), worked out as a column expression."""
    names = [f"x{k}" for k in range(points.shape[1])]
    rows = [(k, *map(float, p)) for k, p in enumerate(points)]
    table = spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} double" for n in names))
    got = table.select("run", score([F.col(n) for n in names]).alias("score")).collect()
    out = np.empty(len(points))
    for r in got:
        out[r["run"]] = r["score"]
    return out


def run_models(sets: DataFrame, model: Callable[[dict], float], tasks: int) -> DataFrame:
    """run, score: the model run for each parameter set, spread over ``tasks`` tasks."""

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"run": frame["run"], "score": [float(model(r)) for r in frame.to_dict("records")]})

    return sets.repartition(tasks).mapInPandas(work, "run long, score double")


def evolve(spark: SparkSession, score, points: np.ndarray, scores: np.ndarray, low: np.ndarray, high: np.ndarray, complexes: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One round: sets are dealt to complexes by rank, and in each the worst of a random simplex is replaced.

    It is reflected at the centre of the others (drawn anew, if that is out of bounds); if that is no
    better, contracted half-way to the centre; if that isn't either, drawn from the range of all sets.
    The tries of all complexes are scored together.
    """
    order = np.argsort(scores, kind="stable")
    points, scores = points[order], scores[order]
    k, size = points.shape[1], len(points) // complexes
    weight = np.arange(size, 0, -1) / (size * (size + 1) / 2)
    worst, tries = [], []
    for c in range(complexes):
        own = np.arange(c, len(points), complexes)
        simplex = np.sort(r.choice(own, k + 1, replace=False, p=weight))
        centre = points[simplex[:-1]].mean(0)
        out = points[simplex[-1]]
        reflected = 2 * centre - out
        if ((reflected < low) | (reflected > high)).any():
            reflected = low + (high - low) * r.random(k)
        worst.append(simplex[-1])
        tries += [reflected, (centre + out) / 2, points.min(0) + (points.max(0) - points.min(0)) * r.random(k)]
    got = evaluate(spark, np.array(tries), score).reshape(complexes, 3)
    for c, w in enumerate(worst):
        for t in range(3):
            if got[c, t] < scores[w] or t == 2:
                points[w], scores[w] = tries[3 * c + t], got[c, t]
                break
    return points, scores


def shuffled_complexes(spark: SparkSession, score, low: list[float], high: list[float], complexes: int = 4, rounds: int = 40, seed: int = 1) -> tuple[np.ndarray, float]:
    """Least score by shuffled complex evolution: ``rounds`` of ``evolve`` from sets drawn at random."""
    r = np.random.default_rng(seed)
    low, high = np.array(low), np.array(high)
    k, size = len(low), 2 * len(low) + 1
    points = low + (high - low) * r.random((complexes * size, k))
    scores = evaluate(spark, points, score)
    for _ in range(rounds):
        points, scores = evolve(spark, score, points, scores, low, high, complexes, r)
    best = int(np.argmin(scores))
    return points[best], float(scores[best])


def morris(spark: SparkSession, params: list[tuple[str, float, float]], trajectories: int, levels: int = 4, seed: int = 0) -> DataFrame:
    """run, step, param (changed in the step, null in step 0), name, value: random one-step-at-a-time walks.

    A trajectory is made in one task from its number alone, so it is the same when made again.
    """
    delta = levels / (2 * (levels - 1))

    def work(frames):
        for frame in frames:
            rows = []
            for run in frame["id"]:
                r = np.random.default_rng([seed, int(run)])
                x = r.integers(0, levels // 2, len(params)) / (levels - 1)
                order = [None, *r.permutation(len(params)).tolist()]
                for step, moved in enumerate(order):
                    if moved is not None:
                        x = x.copy()
                        x[moved] += delta
                    rows += [(run, step, None if moved is None else params[moved][0], n, lo + (hi - lo) * x[k]) for k, (n, lo, hi) in enumerate(params)]
            yield pd.DataFrame(rows, columns=["run", "step", "param", "name", "value"])

    return spark.range(trajectories).mapInPandas(work, "run long, step int, param string, name string, value double")


def trajectory_distances(points: DataFrame) -> DataFrame:
    """a, b, distance: the sum of the distances of all points of one trajectory to all of the other, in both directions.

    ``points``: run, step, x (array of coordinates). Of trajectories with the same points only the
    first counts. All pairs are compared: their number is the square of a setting, not of the data.
    """
    shape = points.groupBy("run").agg(F.sort_array(F.collect_list("x")).alias("shape"))
    kept = shape.groupBy("shape").agg(F.min("run").alias("run")).select("run")
    own = points.join(kept, "run", "left_semi")
    pairs = own.select(F.col("run").alias("a"), F.col("x").alias("xa")).join(own.select(F.col("run").alias("b"), F.col("x").alias("xb")), F.col("a") != F.col("b"))
    apart = F.sqrt(F.aggregate(F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return pairs.groupBy("a", "b").agg(F.sum(apart).alias("distance"))


def spread_group(points: DataFrame, size: int) -> DataFrame:
    """place (from 0), run: the ``size`` trajectories chosen for their joint spread.

    From every trajectory a group grows: each time by the one with the greatest root of summed squared
    distances to those chosen; ties go to the smallest. The group with the greatest sum of these wins.
    """
    distances = cut(trajectory_distances(points).withColumn("distance", F.round("distance", 9)))
    chosen = distances.select(F.col("a").alias("start"), F.lit(0).alias("place"), F.col("a").alias("run"), F.lit(0.0).alias("gain")).distinct()
    for place in range(1, size):
        reach = chosen.join(distances, F.col("run") == F.col("a")).groupBy("start", F.col("b").alias("next")).agg(F.sqrt(F.sum(F.pow("distance", 2))).alias("far"))
        open_ = reach.join(chosen.select("start", F.col("run").alias("next")), ["start", "next"], "left_anti")
        best = open_.groupBy("start").agg(F.max_by("next", F.struct(F.round("far", 6), -F.col("next"))).alias("run"), F.max("far").alias("gain"))
        chosen = cut(chosen.unionByName(best.select("start", F.lit(place).alias("place"), "run", "gain")))
    winner = chosen.groupBy("start").agg(F.sum("gain").alias("total")).agg(F.max_by("start", F.struct(F.round("total", 6), -F.col("start"))).alias("start"))
    return chosen.join(F.broadcast(winner), "start").select("place", "run")


def jenks(values: list[float], classes: int, weights: list[float] | None = None, points: int = 1000) -> list[float]:
    """Upper limits of the classes with the least variance inside them, each value counted with its weight (1 by default).

    Breaks lie between distinct values. The best cut never moves down as values are added, so that beyond
    ``points`` distinct values a row is solved by halves, each between its neighbours' cuts; both are exact.
    """
    x, at = np.unique(np.asarray(values, np.float64), return_inverse=True)
    n = len(x)
    classes = min(classes, n)
    if not classes:
        return []
    w = np.bincount(at, weights, n).astype(np.float64)
    y = x - np.average(x, weights=w)
    count, s, q = (np.concatenate([[0], np.cumsum(v)]) for v in (w, w * y, w * y * y))

    def inside(i, j):
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (count[j] - count[i])

    cost = np.concatenate([[np.inf], inside(0, np.arange(1, n + 1))])
    cut = np.zeros((classes + 1, n + 1), int)
    for c in range(2, classes + 1):
        row = np.full(n + 1, np.inf)
        todo = [(c, n, c - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + inside(i, j)
            k = int(np.argmin(total))
            row[j], cut[c, j] = total[k], i[k]
            todo += [(low, j - 1, first, int(i[k]) if n > points else last), (j + 1, high, int(i[k]) if n > points else first, last)]
        cost = row
    out, j = [], n
    for c in range(classes, 0, -1):
        out.append(float(x[j - 1]))
        j = cut[c, j]
    return out[::-1]


def natural_breaks(df: DataFrame, by: list[str], value: str, classes: int, points: int = 1000, most: int = 200_000, block: int = 1 << 16) -> DataFrame:
    """by, breaks: natural breaks of each group, every row counted.

    Groups come down to their distinct values and how often each occurs, by aggregation. Those of at most ``most`` distinct
    values are searched a task each (``points`` only sets the size from which ``jenks`` searches by halves), larger ones
    in blocks of ``block`` values by many tasks; both are exact. Null values and NaN don't count; a group without others has no breaks.
    """
    often = df.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").cast("double").alias("_n"))
    often = cut(often.withColumn("_x", F.nanvl("_x", F.lit(None))))
    sizes = cut(often.groupBy(*by).agg(F.count("_x").alias("_d")).withColumn("_g", F.monotonically_increasing_id()))
    large = sizes.where(F.col("_d") > max(most, classes))
    some = not large.isEmpty()

    def of(groups: DataFrame) -> DataFrame:
        named = groups.select("_g", *[F.col(c).alias(f"_by_{c}") for c in by])
        return often.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True)))

    small = of(sizes.where(F.col("_d") <= max(most, classes))) if some else often
    lists = small.groupBy(*by).agg(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_x", "_n"))).alias("_v"))

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([jenks(list(v), classes, list(w), points) for v, w in zip(values, weights)])

    found = lists.select(*by, run(F.col("_v._x"), F.col("_v._n")).alias("breaks"))
    if not some:
        return found
    if not by:
        found = found.limit(0)
    wide = large_breaks(of(large).where("_x is not null").select(F.col("_g").alias("g"), F.col("_x").alias("x"), F.col("_n").alias("n")), classes, block)
    return found.unionByName(large.join(wide.withColumnRenamed("g", "_g"), "_g").select(*by, "breaks"))
