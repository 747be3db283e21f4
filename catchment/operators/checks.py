"""Rule checks: ratios of a summary row against thresholds, and their messages.

A rule is (expression, operator, threshold, message) on the columns of a one-row-per-group summary;
each row gets the messages of the rules that it breaks, in the rules' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TESTS = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y}


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a, F.when(b != 0, b)), F.lit(0.0))


def warn(summary: DataFrame, rules: list[tuple[str, str, float, str]], column: str = "warnings") -> DataFrame:
    """Adds the array of messages of the broken rules; a null value breaks none."""
    found = [F.when(TESTS[op](F.expr(x), F.lit(limit)), F.lit(message)) for x, op, limit, message in rules]
    return summary.withColumn(column, F.array_compact(F.array(*found)))


def in_out_percent(inflow: Column, outflow: Column) -> Column:
    """(in - out) / in in per cent; 0 without inflow."""
    return F.when(inflow == 0, 0.0).otherwise((inflow - outflow) / inflow * 100)


def expected_runoff(curve_number: Column) -> Column:
    """Share of streamflow that is surface runoff, expected from the curve number."""
    return 0.0129 * curve_number - 0.2857


def nested(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Parents as JSON documents with their children, all in one row, in an array; without any the key is left out."""
    lists = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*[c for c in children.columns if c != foreign]))).alias(name))
    joined = parents.join(lists, key, "left")
    return joined.select(key, F.to_json(F.struct(*parents.columns, name)).alias("document"))
