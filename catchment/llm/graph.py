"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import stored


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1, for edges inside one task."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            return label
        u, v = u[open_], v[open_]
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends, and
    replaces each edge by the edge between the ends. A round joins whole chains of hooks; a hub whose
    number is above its leaves' takes one more round, as it hooks to one leaf and the others then to
    that. The driver sees counts only. Rounds are cut by written tables. Loops, repeated
    edges and both directions are fine, edges with a null end are none; an empty table gives an empty one.
    """
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(clean, "edges")
    links = None
    while not left.isEmpty():
        # b > a: only b can hook to a, the smaller; so hooks never form a ring.
        hooks = stored(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            jumped = stored(hooks.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        ends = hooks.select(F.col("node"), F.col("up"))
        ahead = left.join(ends.select(F.col("node").alias("a"), F.col("up").alias("up_a")), "a", "left")
        ahead = ahead.join(ends.select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b")
        x, y = F.coalesce("up_a", "a"), F.col("up_b")
        left = stored(ahead.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct(), "edges")
        if links is None:
            links = hooks
        else:
            older = links.select("node", F.col("up").alias("mid"))
            newer = hooks.select(F.col("node").alias("mid"), F.col("up"))
            links = stored(older.join(newer, "mid", "left").select("node", F.coalesce("up", "mid").alias("up")).unionByName(hooks), "links")
    if links is None:
        return clean.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = links.select(F.col("up").alias("node"), F.col("up").alias("root")).distinct().join(links, "node", "left_anti")
    return links.select("node", F.col("up").alias("root")).distinct().unionByName(roots)
