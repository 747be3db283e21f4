"""Routing networks: edges (node, down[, percent, ...]) as tables.

Where each node has one way down, sums, targets and lengths come by pointer doubling: a row for each
node holds where 2^k steps lead and what lies on them, and joined with itself gives 2^(k+1) steps. So
a round handles as many rows as there are nodes, and the rounds are the logarithm of the depth. Only
what asks for all pairs, or branches downwards, builds closures. Each round is checkpointed.

Null ends are outlets. A node that drains into a loop has no outlet, and the rounds end once they
are the logarithm of the number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

#: Rows up to which a table may be sent to every task.
FEW = 100_000


def closure(edges: DataFrame, node: str = "node", down: str = "down") -> DataFrame:
    """node, down, depth: every node reachable downstream, with the least number of steps.

    Null ends are outlets and lead nowhere. Loops end when no shorter way or new pair turns up; a
    node in a loop reaches itself. Where each node has one way down and none is in a loop, whole ways are
    doubled and then taken apart, so a pair is made once; else pairs are, until no round finds more.
    """
    ways = _trails(edges, node, down)
    if ways is not None:
        return ways.select("node", F.posexplode("trail").alias("depth", "down")).select("node", "down", (F.col("depth") + 1).alias("depth"))
    reach = edges.where(F.col(down).isNotNull()).select(F.col(node).alias("node"), F.col(down).alias("down")).distinct()
    reach = cut(reach.withColumn("depth", F.lit(1)))
    size = reach.count()
    while True:
        far = reach.select(F.col("node").alias("down"), F.col("down").alias("far"), F.col("depth").alias("more"))
        longer = reach.join(far, "down").select("node", F.col("far").alias("down"), (F.col("depth") + F.col("more")).alias("depth"))
        reach = cut(reach.unionByName(longer).groupBy("node", "down").agg(F.min("depth").alias("depth")))
        grown = reach.count()
        if grown == size:
            return reach
        size = grown


def _ways(edges: DataFrame, node: str = "node", down: str = "down") -> tuple[DataFrame, int, bool]:
    """Distinct edges that lead somewhere, their number, and whether each node has one at most."""
    ways = cut(edges.where(F.col(down).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(down).alias("down")).distinct())
    row = ways.groupBy("node").count().agg(F.sum("count").alias("edges"), F.max("count").alias("most")).first()
    return ways, row["edges"] or 0, (row["most"] or 0) <= 1


def _trails(edges: DataFrame, node: str = "node", down: str = "down") -> DataFrame | None:
    """node, trail: the nodes below each, in order; None where a node has several ways down, is null or drains into a loop.

    A node's trail goes on with that of its last node, so lengths double. Those that have ended are set aside
    and only read; loops are looked for first, without trails.
    """
    if not edges.where(F.col(node).isNull() & F.col(down).isNotNull()).isEmpty():
        return None
    ways, count, single = _ways(edges, node, down)
    if not single:
        return None
    going = ways.select("node", F.col("down").alias("jump"))
    for _ in range(_rounds(count)):
        if going.isEmpty():
            break
        going = cut(going.join(going.select(F.col("node").alias("jump"), F.col("jump").alias("_jump")), "jump").select("node", F.col("_jump").alias("jump")))
    if not going.isEmpty():
        return None
    state, ended = ways.select("node", F.col("down").alias("jump"), F.array("down").alias("trail")), []
    while not (going := state.where("jump is not null")).isEmpty():
        ahead = reduce(DataFrame.unionByName, [*ended, state]).select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("trail").alias("_trail"))
        longer = F.when(F.col("_trail").isNull(), F.col("trail")).otherwise(F.concat("trail", "_trail"))
        ended.append(state.where("jump is null"))
        state = cut(going.join(ahead, "jump", "left").select("node", F.col("_jump").alias("jump"), longer.alias("trail")))
    return reduce(DataFrame.unionByName, [*ended, state]).select("node", "trail")


def _rounds(nodes: int) -> int:
    """Doublings after which every way of at most ``nodes`` steps has ended."""
    return max(1, nodes).bit_length() + 1


def _jumped(state: DataFrame, onward: dict[str, Column], everyone: DataFrame | None = None) -> DataFrame:
    """``state`` (node, jump, ...) after the jump's own jump; ``onward`` gives its other columns, those of the jump as ``_name``.

    ``everyone``: the rows that jumps may lead to, if these are more than ``state``.
    """
    ahead = state if everyone is None else everyone
    ahead = ahead.select(*[F.col(x).alias("jump" if x == "node" else f"_{x}") for x in state.columns])
    return state.join(ahead, "jump", "left").select("node", F.col("_jump").alias("jump"), *[x.alias(name) for name, x in onward.items()])


def loops(edges: DataFrame, node: str = "node", down: str = "down") -> DataFrame:
    """Nodes that reach themselves: of one way down each, where ways of over as many steps as there are nodes end."""
    ways, count, single = _ways(edges, node, down)
    if not single:
        return closure(ways).where("node = down").select("node")
    state = ways.select("node", F.col("down").alias("jump"))
    for _ in range(_rounds(count)):
        state = cut(_jumped(state.where("jump is not null"), {}))
        if state.where("jump is not null").isEmpty():
            break
    return state.where("jump is not null").select(F.col("jump").alias("node")).distinct()


def descend(edges: DataFrame, stop: Callable[[Column], Column] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """node, target, steps, length: where the way down from each node ends, each node with one way down.

    A way ends at the outlet or, if ``stop`` is given, at the first node for which it holds; ways
    that don't meet such a node have no row, nor have those that end in a loop. ``lengths`` (node,
    length) are summed over the nodes after the first; missing ones count 0.
    """
    ways, count, single = _ways(edges)
    if not single:
        raise ValueError("a node has several ways down")
    state = ways
    if lengths is not None:
        state = state.join(lengths.select(F.col("node").alias("down"), "length"), "down", "left")
    else:
        state = state.withColumn("length", F.lit(0))
    halt = stop(F.col("down")) if stop else F.lit(False)
    state = cut(state.select("node", F.when(~halt, F.col("down")).alias("jump"), F.col("down").alias("target"), F.lit(1).alias("steps"), F.coalesce("length", F.lit(0)).alias("length")))
    # Ways that have ended are set aside: their null jumps would all meet in one task.
    ended = []
    for _ in range(_rounds(count)):
        going = state.where("jump is not null")
        if going.isEmpty():
            break
        more = {"target": F.coalesce("_target", "target"), "steps": F.col("steps") + F.coalesce("_steps", F.lit(0)), "length": F.col("length") + F.coalesce("_length", F.lit(0))}
        everyone = reduce(DataFrame.unionByName, [*ended, state])
        ended.append(state.where("jump is null"))
        state = cut(_jumped(going, more, everyone))
    found = reduce(DataFrame.unionByName, [*ended, state.where("jump is null")]).drop("jump")
    return found.where(stop(F.col("target"))) if stop else found


def upstream(edges: DataFrame, own: DataFrame, values: list[str]) -> DataFrame:
    """node, each of ``values``, depth: a node's values summed with those of all nodes above it, and the steps to the farthest.

    ``own`` has a row for each node with its values. A node in a loop has nulls; each node has one
    way down. Where one has several, use ``closure``.
    """
    ways, count, single = _ways(edges)
    if not single:
        raise ValueError("a node has several ways down")
    nodes = own.select("node").unionByName(ways.select("node")).unionByName(ways.select(F.col("down").alias("node"))).distinct()
    state = nodes.join(own.select("node", *values), "node", "left").join(ways.withColumnRenamed("down", "jump"), "node", "left")
    state = cut(state.select("node", "jump", *[F.coalesce(v, F.lit(0)).alias(v) for v in values], F.lit(0).alias("depth")))
    for k in range(_rounds(count)):
        if state.where("jump is not null").isEmpty():
            break
        # What lies 2^k steps above, with all that it has gathered so far.
        gained = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values], (F.max("depth") + 2**k).alias("_depth"))
        # Null jumps stay out of the join, where they would all meet in one task.
        going = state.where("jump is not null").select("node", "jump")
        onward = going.join(going.select(F.col("node").alias("jump"), F.col("jump").alias("_jump")), "jump").select("node", "_jump")
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        state = cut(state.join(gained, "node", "left").join(onward, "node", "left").select("node", F.col("_jump").alias("jump"), *sums, F.greatest("depth", "_depth").alias("depth")))
    ring = state.where("jump is not null").select(F.col("jump").alias("node"), F.lit(True).alias("ring")).distinct()
    state = state.join(ring, "node", "left")
    return state.select("node", *[F.when(F.col("ring").isNull(), F.col(v)).alias(v) for v in [*values, "depth"]])


def upstream_sum(edges: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """node, total: a node's value and those of all nodes above it. ``own`` has node and value; a node in a loop has null."""
    sums = upstream(edges, own, [value]).select("node", F.col(value).alias("total"))
    return own.join(sums, "node").select("node", F.when(F.col(value).isNotNull(), F.col("total")).alias("total"))


def strahler(edges: DataFrame) -> DataFrame:
    """node, strahler: 1 for sources; the greatest order above, plus one where two or more share it.

    Orders settle from the sources down, so there are as many rounds as the network has levels.
    """
    nodes = edges.select("node").union(edges.where("down is not null").select(F.col("down").alias("node"))).distinct()
    links = cut(edges.where("down is not null").select("node", "down").distinct())
    sources = nodes.join(links.select(F.col("down").alias("node")).hint("merge"), "node", "left_anti")
    need = links.groupBy(F.col("down").alias("below")).agg(F.count("*").alias("need"))
    links = cut(links.join(need.hint("merge"), F.col("down") == F.col("below")).select("node", "down", "need"))
    new = cut(sources.withColumn("strahler", F.lit(1)))
    done, waiting, rounds = [new], None, 0
    while size := new.count():
        # Few rows may be broadcast; a table of many is small only as a file.
        given = links.join(new if size <= FEW else new.hint("merge"), "node")
        given = given.groupBy(F.col("down").alias("node"), "need", "strahler").agg(F.count("*").alias("same"))
        # An order and whether one link has it or several, as one number.
        code = F.max(F.col("strahler").cast("long") * 4 + F.least("same", F.lit(2)))
        given = given.groupBy("node", "need").agg(F.sum("same").alias("have"), code.alias("top"))
        if waiting is not None:
            before = waiting.select("node", F.col("need").alias("_need"), F.col("have").alias("_have"), F.col("top").alias("_top"))
            order = lambda top: F.floor(F.col(top) / 4)
            both = F.when(order("top") == order("_top"), order("top") * 4 + 2).otherwise(F.greatest("top", "_top"))
            given = given.join(before, "node", "full").select("node", F.coalesce("need", "_need").alias("need"), (F.coalesce("have", F.lit(0)) + F.coalesce("_have", F.lit(0))).alias("have"), F.coalesce(both, "top", "_top").alias("top"))
        given = cut(given)
        new = given.where("have = need").select("node", (F.floor(F.col("top") / 4) + F.when(F.col("top") % 4 > 1, 1).otherwise(0)).cast("int").alias("strahler"))
        waiting = given.where("have < need")
        done.append(new)
        rounds += 1
        if rounds % 32 == 0:
            done = [cut(reduce(DataFrame.unionByName, done))]
    return reduce(DataFrame.unionByName, done)


def paths(edges: DataFrame) -> DataFrame:
    """node, path: the nodes from each node down to its outlet, itself first."""
    below = _trails(edges)
    if below is None:
        below = closure(edges).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("depth", "down"))).alias("below"))
        below = below.select("node", F.transform("below", lambda x: x["down"]).alias("trail"))
    nodes = edges.select("node").union(edges.where("down is not null").select(F.col("down").alias("node"))).distinct()
    rest = F.coalesce(F.col("trail").cast("array<long>"), F.expr("array()").cast("array<long>"))
    return nodes.join(below, "node", "left").select("node", F.concat(F.array(F.col("node").cast("long")), rest).alias("path"))


def meeting(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, meet, steps: where the ways down from a and b first meet, and the steps of both together.

    Each node has one way down. Tables of where 1, 2, 4, ... steps lead lift the deeper of a pair to
    the other's depth, and then both to just above where they meet. Pairs that don't meet, and those
    with a node that drains into a loop, have no row.
    """
    ways, count, single = _ways(edges)
    if not single:
        raise ValueError("a node has several ways down")
    depths = descend(ways).select("node", "steps")
    outlets = ways.select(F.col("down").alias("node")).join(ways, "node", "left_anti").distinct()
    depths = cut(depths.unionByName(outlets.select("node", F.lit(0).alias("steps"))))
    jumps = [ways.select("node", F.col("down").alias("jump"))]
    while not (state := jumps[-1]).isEmpty() and len(jumps) <= _rounds(count):
        jumps.append(cut(_jumped(state, {}).where("jump is not null")))

    def lifted(rows: DataFrame, k: int, *ends: str) -> DataFrame:
        for end in ends:
            rows = rows.join(jumps[k].select(F.col("node").alias(f"at_{end}"), F.col("jump").alias(f"far_{end}")), f"at_{end}", "left")
        return rows

    rows = pairs.select("a", "b").distinct()
    for end in ("a", "b"):
        rows = rows.join(depths.select(F.col("node").alias(end), F.col("steps").alias(f"deep_{end}")), end)
    rows = rows.select("a", "b", F.col("a").alias("at_a"), F.col("b").alias("at_b"), "deep_a", "deep_b", (F.col("deep_a") - F.col("deep_b")).alias("gap"))
    for k in range(len(jumps)):
        set_ = F.shiftright(F.abs("gap"), k).bitwiseAND(1) == 1
        rows = lifted(rows, k, "a", "b").withColumn("at_a", F.when(set_ & (F.col("gap") > 0), F.col("far_a")).otherwise(F.col("at_a")))
        rows = cut(rows.withColumn("at_b", F.when(set_ & (F.col("gap") < 0), F.col("far_b")).otherwise(F.col("at_b"))).drop("far_a", "far_b"))
    for k in reversed(range(len(jumps))):
        apart = F.col("far_a") != F.col("far_b")
        rows = lifted(rows, k, "a", "b").withColumn("at_a", F.when(apart, F.col("far_a")).otherwise(F.col("at_a")))
        rows = cut(rows.withColumn("at_b", F.when(apart, F.col("far_b")).otherwise(F.col("at_b"))).drop("far_a", "far_b"))
    rows = lifted(rows, 0, "a", "b").withColumn("meet", F.when(F.col("at_a") == F.col("at_b"), F.col("at_a")).when(F.col("far_a") == F.col("far_b"), F.col("far_a")))
    rows = rows.where("meet is not null").join(depths.select(F.col("node").alias("meet"), "steps"), "meet")
    return rows.select("a", "b", "meet", (F.col("deep_a") + F.col("deep_b") - 2 * F.col("steps")).alias("steps"))


def final_target(moves: DataFrame) -> DataFrame:
    """node, target: the end of each chain of moves (node, down); null for chains that end in a loop."""
    ends = descend(moves).select("node", "target")
    return moves.where("node is not null").select("node").distinct().join(ends, "node", "left")


def skip_points(edges: DataFrame, category: str = "PT") -> DataFrame:
    """Edges from real sources to real sinks: sinks of a pass-through category are followed on.

    ``edges``: source, source_cat, sink, sink_cat, hyd_typ, percent. The last step's hyd_typ and
    percent count. ``order`` numbers the sinks of each source. Ways that only lead round a loop of
    points have no sink. Points are followed by doubling, as many steps as there are points.
    """
    columns = ["sink", "sink_cat", "hyd_typ", "percent"]
    real = edges.where(~F.col("source_cat").eqNullSafe(category))
    # Where each point leads: to real sinks, or on to the points that are 2^k steps away.
    onward = cut(edges.where(F.col("source_cat") == category).select(F.col("source").alias("point"), *columns))
    passed = F.col("sink_cat") == category
    for _ in range(_rounds(onward.select("point").distinct().count())):
        open_ = onward.where(passed)
        if open_.isEmpty():
            break
        further = open_.select(F.col("point").alias("_point"), F.col("sink").alias("point")).join(onward, "point").drop("point").withColumnRenamed("_point", "point")
        onward = cut(onward.where(~F.coalesce(passed, F.lit(False))).unionByName(further.select("point", *columns)))
    sinks = onward.where(~F.coalesce(passed, F.lit(False))).select(F.col("point").alias("_point"), *[F.col(x).alias(f"_{x}_") for x in columns])
    through = real.where(passed).join(sinks, F.col("sink") == F.col("_point")).select("source", "source_cat", *[F.col(f"_{x}_").alias(x) for x in columns])
    done = real.where(~F.coalesce(passed, F.lit(False))).select("source", "source_cat", *columns).unionByName(through)
    w = Window.partitionBy("source", "source_cat").orderBy("sink_cat", "sink", "hyd_typ")
    return done.withColumn("order", F.row_number().over(w))


def percent_faults(edges: DataFrame) -> DataFrame:
    """source, source_cat, hyd_typ, total: where the percentages don't sum to 100 after rounding."""
    sums = edges.groupBy("source", "source_cat", "hyd_typ").agg(F.sum("percent").alias("total"))
    return sums.where(F.floor(F.col("total") + 0.5) != 100)


def dead_ends(edges: DataFrame, exits: list[str]) -> DataFrame:
    """Sinks that are neither exits nor sources."""
    sinks = edges.where(~F.col("sink_cat").isin(exits)).select(F.col("sink").alias("source"), F.col("sink_cat").alias("source_cat")).distinct()
    return sinks.join(edges, ["source", "source_cat"], "left_anti")


def without_common_prefix(a: Column, b: Column) -> tuple[Column, Column]:
    """Two arrays after the elements with which both begin; null elements are equal to each other."""
    shorter = F.least(F.size(a), F.size(b))
    steps = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(steps, lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k))))
    common = F.coalesce(first, shorter)
    return F.slice(a, common + 1, F.greatest(F.size(a) - common, F.lit(0))), F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))


def merge_channels(channels: DataFrame, threshold: float) -> DataFrame:
    """channel, target, area: channels merged downstream until no small one can be, and the area of each target.

    ``channels``: channel, down, area, basin, kind. A channel merges into the next one down in its
    basin where either is below ``threshold``; not where it holds or gets a body of water or a point
    source (kind ``water``), nor into or out of a lake (kind ``lake``). Each merge adds the areas, so
    rounds go on until none is left. In a round a channel merges where the one below doesn't, so
    targets are never merged away in the same round. Channels on a ring, which drain into themselves, neither merge nor
    are merged into. Channels with a null basin or area don't merge either.
    """
    rings = loops(channels, "channel", "down").select(F.col("node").alias("channel"), F.lit("lake").alias("_ring"))
    rows = channels.join(rings, "channel", "left").select("channel", "down", F.col("area").cast("double").alias("area"), "basin", F.coalesce("_ring", "kind").alias("kind"))
    state = cut(rows)
    moves = cut(channels.select("channel", F.col("channel").alias("target")))
    while True:
        below = state.select(F.col("channel").alias("down"), F.col("area").alias("_area"), F.col("basin").alias("_basin"), F.col("kind").alias("_kind"))
        fit = F.col("kind").isNull() & ~F.col("_kind").eqNullSafe("lake") & (F.col("basin") == F.col("_basin")) & ((F.col("area") < threshold) | (F.col("_area") < threshold))
        want = cut(state.join(below, "down").where(fit).select("channel", "down", "area"))
        if want.isEmpty():
            return moves.join(state.select(F.col("channel").alias("target"), "area"), "target").select("channel", "target", "area")
        # Chains of wishes end in a channel that stays; all of a chain merge into that.
        ends = descend(want.select(F.col("channel").alias("node"), "down")).select(F.col("node").alias("channel"), F.col("target").alias("into"))
        gained = ends.join(state.select("channel", "area"), "channel").groupBy(F.col("into").alias("channel")).agg(F.sum("area").alias("_gain"))
        left = state.join(ends, "channel", "left_anti").join(gained, "channel", "left")
        # What stays and drained into a merged channel drains into its target now.
        ahead = ends.select(F.col("channel").alias("down"), F.col("into").alias("_into"))
        state = cut(left.join(ahead, "down", "left").select("channel", F.coalesce("_into", "down").alias("down"), (F.col("area") + F.coalesce("_gain", F.lit(0.0))).alias("area"), "basin", "kind"))
        moves = cut(moves.join(ends.withColumnRenamed("channel", "target"), "target", "left").select("channel", F.coalesce("into", "target").alias("target")))


def spread_labels(cells: DataFrame) -> DataFrame:
    """node, label: a label passed up from the cells that have one, over flooded cells that drain to them.

    ``cells``: node, down, label, flooded. The first labelled cell on the way down counts, where all
    cells before it are flooded; labelled cells keep their own.
    """
    flooded = cells.where(F.col("flooded") & F.col("label").isNull())
    # A labelled cell ends the way: below it nothing is looked for.
    steps = flooded.select("node", "down").join(cells.where(F.col("label").isNotNull() | F.col("flooded")).select(F.col("node").alias("down")), "down", "left_semi").select("node", "down")
    own = cells.where("label is not null").select("node", "label")
    ends = descend(steps).join(own.select(F.col("node").alias("target"), "label"), "target").select("node", "label")
    return own.unionByName(ends)
