"""Writers of model text files and of exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut


def field(value: Column, kind: str, width: int, decimals: int = 5) -> Column:
    """A fixed-width field: numbers to the right, strings to the left; null is the word ``null``."""
    if kind == "double":
        text = F.format_string(f"%.{decimals}f", value)
    elif kind == "exp":
        text = F.format_string(f"%.{decimals}e", value)
    else:
        text = value.cast("string")
    text = F.when(value.isNull(), "null").otherwise(text)
    padded = F.rpad(text, width, " ") if kind == "string" else F.lpad(text, width, " ")
    return F.when(F.length(text) >= width, text).otherwise(padded)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its rows' places (from 1) in ``order``, which should be unique.

    Rows are dealt by ranges and counted in each; a range's places begin after the counts before it, so
    that no task holds the whole table.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn("_part", part).join(starts, "_part").select(*df.columns, place.alias(name))


def fixed_lines(df: DataFrame, columns: list[tuple[str, str, int]], order: list[str]) -> DataFrame:
    """place, value: a header line (place 0), then a line for each row, numbered in order."""
    head = F.concat_ws("  ", *[F.rpad(F.lit(n), w, " ") if k == "string" else F.lpad(F.lit(n), w, " ") for n, k, w in columns])
    rows = numbered(df, order, "place").select("place", F.concat_ws("  ", *[field(F.col(n), k, w) for n, k, w in columns]).alias("value"))
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), head.alias("value")).unionByName(rows)


def write_fixed(df: DataFrame, path: str, columns: list[tuple[str, str, int]], order: list[str]) -> None:
    """One text file: model inputs are read as a single file, in order."""
    fixed_lines(df, columns, order).orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, kind: str, header: bool = True) -> None:
    """CSV, TSV or JSON lines; line breaks inside strings become spaces in CSV and TSV."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    clean = df.select(*[F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").csv(path, header=header, sep={"csv": ",", "tsv": "\t"}[kind])


def parent_lines(parents: DataFrame, children: DataFrame, key: str, foreign: str, order: str) -> DataFrame:
    """A line for each parent, its children's fields after its own, in order; the children of a parent lie in one row, as in the line."""
    fields = [c for c in children.columns if c not in (foreign, order)]
    lists = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("_c"))
    tail = F.array_join(F.transform("_c", lambda x: F.concat_ws("  ", *[x[f].cast("string") for f in fields])), "  ")
    own = F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parents.columns])
    return parents.join(lists, key, "left").select(key, F.rtrim(F.concat_ws("  ", own, tail)).alias("value"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def _three_digits(value: float | None) -> str | None:
    return None if value is None else f"{value:.3g}"


def three_digits(value: Column) -> Column:
    """A number with three significant digits, as ``{:.3g}`` writes it: plain from 1e-4 to below 1000, else with an exponent; no zeros at the end.

    The number's exact binary value is rounded, ties to the even digit. Spark's own formatting rounds its shortest decimal text, ties up.
    """
    return F.udf(_three_digits, "string")(value.cast("double"))


def plot_table(values: DataFrame, labels: list[str], first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """place, Date (year/month) and a column for each of ``labels``, for every month from ``first`` to ``last``; numbers have three digits.

    ``values``: year, month, label, value, one row for each. A month that a label lacks, or in which it is null, is an error. Months
    outside and other labels are left out.
    """
    at = F.col("year") * 12 + F.col("month") - 1
    low, high = first[0] * 12 + first[1] - 1, last[0] * 12 + last[1] - 1
    wide = values.withColumn("_at", at).where(F.col("_at").between(low, high)).groupBy("_at").pivot("label", labels).agg(F.first("value", ignorenulls=True))
    calendar = values.sparkSession.range(low, high + 1).select(F.col("id").alias("_at"))
    dense = cut(calendar.join(wide, "_at", "left"))
    gap = dense.where(reduce(lambda a, b: a | b, [F.col(f"`{x}`").isNull() for x in labels])).orderBy("_at").first()
    if gap:
        lacking = [x for x in labels if gap[x] is None]
        raise ValueError(f"no data for month {gap['_at'] % 12 + 1} of {gap['_at'] // 12}: {', '.join(lacking)}")
    date = F.concat((F.col("_at") / 12).cast("int").cast("string"), F.lit("/"), (F.col("_at") % 12 + 1).cast("string"))
    return dense.select((F.col("_at") - low + 1).cast("int").alias("place"), date.alias("Date"), *[three_digits(F.col(f"`{x}`")).alias(x) for x in labels])
