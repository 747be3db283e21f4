"""Relational helpers with the semantics of a row store, expressed as columns and DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

#: Tasks of one stage, at most.
MOST_TASKS = 20_000
#: Values in a run of pairs; a multiple of 8, so that runs of packed bits end with a byte and recur.
RUN = 256
#: Values that meet a run at once; a task holds that many runs of pairs.
HELD = 16

# Predicates


def glob(column: Column, pattern: str) -> Column:
    """Case-sensitive glob: ``*`` any run, ``?`` any character, ``[..]`` a set."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "^" else inner).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return column.rlike(f"(?s)^{out}$")


def contains(column: Column, text: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in the text stay wildcards."""
    return column.ilike(f"%{text}%")


def starts(column: Column, text: str) -> Column:
    return column.ilike(f"{text}%")


def ends(column: Column, text: str) -> Column:
    return column.ilike(f"%{text}")


def among(column: Column, values: list) -> Column:
    """IN; an empty list is false for every row, null ones too."""
    return column.isin(values) if values else F.lit(False)


def not_among(column: Column, values: list) -> Column:
    """NOT IN; an empty list is true for every row."""
    return ~column.isin(values) if values else F.lit(True)


_OPERATORS = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "in": among,
    "is": lambda c, v: c.eqNullSafe(v),
    "like": glob,
    "ilike": lambda c, v: c.ilike(v),
    "regexp": lambda c, v: c.rlike(v),
}


def keyword_filter(df: DataFrame, **conditions) -> DataFrame:
    """``column__operator=value`` conditions, all of which must hold; without operator: equality."""
    tests = []
    for key, value in conditions.items():
        name, _, operator = key.rpartition("__")
        if operator not in _OPERATORS or not name:
            name, operator = key, "eq"
        tests.append(_OPERATORS[operator](F.col(name), value))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# Rows


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page of a total order; pages 0 and 1 are the same."""
    return df.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def paged(df: DataFrame, text: str, columns: list[str], order: list[Column], number: int, size: int) -> DataFrame:
    """The page of the rows of which any column contains ``text``, with total and matching counts."""
    test = any_of(*[contains(F.col(c), text) for c in columns]) if text else F.lit(True)
    counts = df.agg(F.count("*").alias("total"), F.count_if(test).alias("matches"))
    return page(df.where(test), number, size, order).crossJoin(F.broadcast(counts))


def complete(df: DataFrame, column: str, text: str, limit: int) -> DataFrame:
    """Names that start with ``text`` first, then others, each at most ``limit``, in order of name."""
    names = df.select(F.col(column).alias("name")).distinct()
    first = names.where(starts(F.col("name"), text)).orderBy("name").limit(limit).withColumn("rank", F.lit(0))
    rest = names.where(~starts(F.col("name"), text)).orderBy("name").limit(limit).withColumn("rank", F.lit(1))
    return first.unionByName(rest)


# Relations


def prefetch(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str, order: list[str]) -> DataFrame:
    """Parents with their children as an ordered array; those without have an empty one.

    All children of a parent lie in one row, which is what is asked for; null keys have none.
    """
    rest = [c for c in children.columns if c not in order and c != foreign]
    shape = F.struct(*order, *rest)
    lists = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(shape)).alias(name))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that leaves existing keys alone."""
    return old.unionByName(new.join(old, keys, "left_anti").select(old.columns))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that replaces rows of existing keys."""
    return old.join(new, keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert that updates ``columns`` of existing keys and keeps their other columns."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    old = old.withColumn("_old", F.lit(True))
    joined = old.join(fresh, keys, "full")
    picked = []
    for c in old.columns:
        if c in keys or c == "_old":
            continue
        known = f"_{c}" in fresh.columns
        if known:
            take = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in columns))
            picked.append(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            picked.append(F.col(c))
    return joined.select(*keys, *picked)


def update_where(df: DataFrame, test: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_from(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns from ``changes`` where a key has a change that isn't null."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action, old and new row as JSON, for rows that were added, changed or removed."""
    pack = lambda df, name: df.select(*keys, F.to_json(F.struct(*sorted(set(df.columns) - set(keys)))).alias(name))
    both = pack(old, "old").join(pack(new, "new"), keys, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(*keys, action.alias("action"), "old", "new")


# Windows that the engine lacks


def groups_frame(df: DataFrame, order: str, before: int, after: int, by: list[str] | None = None) -> tuple[DataFrame, Window]:
    """Data and window of a GROUPS frame: ``before`` to ``after`` distinct values of ``order``."""
    by = by or []
    df = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    return df, Window.partitionBy(*by).orderBy("_group").rangeBetween(-before, after)


def sum_excluding(column: str, by: list[str], order: str, exclude: str) -> Column:
    """Running sum up to the current peers without the current row, its group, or its ties."""
    upto = F.sum(column).over(Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    peers = F.sum(column).over(Window.partitionBy(*by, order))
    if exclude == "row":
        return upto - F.col(column)
    if exclude == "group":
        return upto - peers
    return upto - peers + F.col(column)  # ties: the row itself stays


def average_rank(column: str, by: list[str] | None = None) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*(by or []))
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*(by or []), column)) - 1) / 2


#: Columns of a soil table that tell a soil, by the option of the lookup.
SOIL_KEYS = {"name": ["snam"], "ssurgo": ["muid"], "stmuid": ["muid"], "stmuid+seqnum": ["muid", "seqn"], "stmuid+name": ["muid", "name"], "s5id": ["s5id"]}


def soil_layers(wanted: DataFrame, soils: DataFrame, layers: DataFrame, option: str) -> DataFrame:
    """The columns of ``wanted``, soil_id, place and the layer's columns, for every wanted soil found by the keys of ``option``.

    ``place`` numbers a soil's layers from 1 by ``layer_num``. ``wanted`` and ``soils`` have the option's columns, ``layers`` has soil_id and layer_num.
    Null keys find nothing; a soil without layers has no row; keys that several soils have find all of these.
    """
    if option not in SOIL_KEYS:
        raise ValueError(f"no soil option {option}: {', '.join(SOIL_KEYS)}")
    keys = SOIL_KEYS[option]
    found = wanted.select(*keys).distinct().join(soils.select("soil_id", *keys), keys)
    # A soil's layers are few, and only layers of soils that are asked for are numbered.
    own = layers.join(found.select("soil_id").distinct(), "soil_id", "left_semi")
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("soil_id").orderBy("layer_num")))
    return found.join(placed, "soil_id").select(*keys, "soil_id", "place", *[x for x in layers.columns if x != "soil_id"])


def pairs_below(low: DataFrame, high: DataFrame) -> DataFrame:
    """n: the number of pairs of a value of ``low`` below a value of ``high`` (tables of one column ``value``); nulls make no pair.

    Values are counted on both sides and dealt by ranges. A range's running count of low values begins
    after those of the ranges before it, so no pair is made and no task holds all values.
    """
    counted = low.select("value", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(high.select("value", F.lit(0).alias("below"), F.lit(1).alias("above")))
    counted = counted.where("value is not null").groupBy("value").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    dealt = cut(counted.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum("below").alias("_n"))
    starts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    before = F.sum("below").over(Window.partitionBy("_part").orderBy("value")) - F.col("below")
    placed = dealt.withColumn("_before", before).join(F.broadcast(starts), "_part")
    return placed.agg(F.coalesce(F.sum(F.col("above") * (F.col("_start") + F.col("_before"))), F.lit(0)).cast("long").alias("n"))


def _counts(rows: DataFrame, key: str) -> DataFrame:
    """Each key's number of rows (key, n), without null keys."""
    return cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))


def _blocks(rows: DataFrame, key: str, value: str, counts: DataFrame, size: int, name: str) -> DataFrame:
    """``key`` and ``name``, the values of the rows of a key in arrays of about ``size``; ``counts`` from ``_counts``."""
    known = rows.where(F.col(key).isNotNull()).select(key, value, F.monotonically_increasing_id().alias("_row"))
    block = F.pmod(F.xxhash64("_row"), F.ceil(F.col("n") / size).cast("long"))
    # A struct keeps null values, which collect_list drops.
    values = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))), lambda x: x["v"]).alias(name)
    return known.join(counts, key).groupBy(key, block.alias("_block")).agg(values).select(key, name)


def _runs(name: str, size: int) -> Column:
    """The array ``name`` cut into arrays of ``size`` values; what is over a multiple of 8 comes last, by itself."""
    whole = F.size(name) - F.size(name) % 8
    starts = F.sequence(F.lit(0), F.floor((whole - 1) / size).cast("int"))
    cuts = F.transform(F.when(whole > 0, starts).otherwise(F.array().cast("array<int>")), lambda k: F.slice(name, k * size + 1, F.least(F.lit(size), whole - k * size)))
    return F.concat(cuts, F.array(F.slice(name, whole + 1, 7)))


def pairs_of_key(left: DataFrame, right: DataFrame, key: str, a: str, b: str, size: int = 4096, tile: int = 1024, task_pairs: int = 1 << 25) -> DataFrame:
    """a, b: every pair of a row of ``left`` and one of ``right`` with the same ``key``; null keys meet nothing.

    Blocks of up to about ``size`` values meet tiles of about ``tile`` or more, so that what is shuffled is small beside the pairs, which
    are made last, each task about ``task_pairs`` of them. A value of the left then stands in runs of ``RUN`` and those of the
    right recur in one order, which a written result's encoding shortens to a small part. ``HELD`` values meet a run at once: the
    last two steps compile to one loop, which keeps all pairs of one of its rows before it hands them on.
    """
    n_left, n_right = _counts(left, key), _counts(right, key)
    pairs = n_left.join(n_right.select(key, F.col("n").alias("m")), key).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = int(min(MOST_TASKS, pairs // task_pairs + 1))
    # About four blocks with a tile a task: smaller tiles would repeat the blocks more often in the shuffle and its sort.
    tile = int(max(tile, pairs / tasks / (4 * size)))
    met = _blocks(left, key, a, n_left, size, "_a").join(_blocks(right, key, b, n_right, tile, "_b"), key).select("_a", "_b").repartition(tasks)
    runs = met.select("_a", F.explode(_runs("_b", RUN)).alias("_b")).select(F.explode(_runs("_a", HELD)).alias("_a"), "_b")
    return runs.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
