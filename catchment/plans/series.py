"""Time series: resampling, periods, quantiles, low flow; classed values and names."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.functions import dates
from catchment.operators import timeseries as ts
from catchment.plans.registry import query


def c(name):
    return F.col(name)


def daily(t):
    """day, q: mean order price of each day."""
    return t.orders.groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("q"))


DAILY = "(SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS q FROM orders GROUP BY 1)"
START, FINISH = date(1996, 3, 1), date(2000, 6, 30)
DAYS, MONTHS, YEARS = ts.period_lengths(START, FINISH)
_PERIOD = f"o_orderdate >= '{START}' AND o_orderdate < '2000-07-01'"

_SUMS = {"total": "sum(v)", "annual": f"sum(v) / {YEARS!r}", "monthly": f"sum(v) / {MONTHS!r}", "daily": f"sum(v) / {DAYS}", "maximum": "greatest(0, max(v))", "minimum": "min(v)"}
for _number, _name in ((18, "total"), (19, "annual"), (20, "monthly"), (21, "daily"), (22, "maximum"), (23, "minimum")):
    query(f"ag_{_number}", f"SELECT o_orderstatus, round({_SUMS[_name]}, 4) AS x FROM (SELECT o_orderstatus, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, 0) AS v FROM orders WHERE {_PERIOD}) GROUP BY 1")(
        lambda t, name=_name: t.orders.where((c("o_orderdate") >= F.lit(str(START)).cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("2000-07-01").cast("timestamp_ntz")))
        .withColumn("v", F.when(c("o_orderkey") % 7 != 0, c("o_totalprice"))).groupBy("o_orderstatus").agg(F.round(ts.summaries("v", START, FINISH)[name], 4).alias("x"))
    )
query("ag_17", "SELECT o_orderstatus, " + ", ".join(f"round({_SUMS[n]}, 4) AS {n}" for n in _SUMS) + " FROM (SELECT o_orderstatus, o_totalprice AS v FROM orders) GROUP BY 1")(
    lambda t: t.orders.groupBy("o_orderstatus").agg(*[F.round(x, 4).alias(n) for n, x in ts.summaries("o_totalprice", START, FINISH).items()])
)
for _grain, _label in (("day", "CAST(o_orderdate AS DATE)"), ("month", "last_day(CAST(o_orderdate AS DATE))"), ("year", "make_date(year(o_orderdate), 12, 31)")):
    query(f"ag_26_{_grain}", f"SELECT strftime({_label}, '%Y-%m-%d') AS date, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")(
        lambda t, grain=_grain: ts.resample(t.orders, "o_orderdate", "o_totalprice", grain).select(c("date").cast("string").alias("date"), F.round("mean", 4).alias("mean"))
    )
query("ag_28", f"SELECT CAST(month(day) AS INT) AS month, round(quantile_cont(q, 0.05), 4) AS q FROM {DAILY} GROUP BY 1")(lambda t: ts.flow_quantile(daily(t), "day", "q", 95).select("month", F.round("q", 4).alias("q")))
query("ag_29", f"SELECT y, round(min_by(q, i), 4) AS q FROM (SELECT CAST(year(day) AS INT) AS y, q, row_number() OVER (PARTITION BY year(day) ORDER BY q DESC) AS i, count(*) OVER (PARTITION BY year(day)) AS n FROM {DAILY}) WHERE 100.0 * i / (n + 1) > 70 GROUP BY 1")(
    lambda t: ts.ranked_quantile(daily(t).withColumn("y", F.year("day")), ["y"], "q", 70).select("y", F.round("q", 4).alias("q"))
)
_HYDRO = f"""WITH d AS {DAILY}, h AS (SELECT *, year(day) - CASE WHEN month(day) < 4 THEN 1 ELSE 0 END AS hy FROM d),
f AS (SELECT CASE WHEN month(m) = 4 AND day(m) = 1 THEN year(m) ELSE year(m) + CASE WHEN month(m) >= 4 THEN 1 ELSE 0 END END AS first FROM (SELECT min(day) AS m FROM d)),
z AS (SELECT hy, count(*) AS n FROM h GROUP BY 1), l AS (SELECT max(hy) AS last, max_by(n, hy) >= CASE WHEN day(last_day(make_date(max(hy) + 1, 2, 1))) = 29 THEN 366 ELSE 365 END AS complete FROM z),
r AS (SELECT h.* FROM h, f, l WHERE hy >= first AND (complete OR hy < last))"""
_LEAST = "SELECT hy, min(s) AS least FROM (SELECT hy, sum(q) OVER (PARTITION BY hy ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (PARTITION BY hy ORDER BY day) AS k FROM r) WHERE k >= 7 GROUP BY 1"
query("wn_12", f"{_HYDRO} SELECT round(quantile_cont(least, 0.1) / 7, 4) AS flow FROM ({_LEAST})")(lambda t: ts.low_flow(daily(t), "day", "q", 7, 4, 10).select(F.round("flow", 4).alias("flow")))
query("wn_12_mean", f"{_HYDRO} SELECT round(avg(least) / 7, 4) AS flow FROM ({_LEAST})")(lambda t: ts.low_flow(daily(t), "day", "q", 7, 4, None).select(F.round("flow", 4).alias("flow")))
query("wn_13", f"""{_HYDRO}, s AS (SELECT hy, row_number() OVER w AS k, q FROM r WINDOW w AS (PARTITION BY hy ORDER BY day)),
m AS (SELECT hy, i, min(a) AS a FROM (SELECT b.hy, i, sum(e.q) / i AS a, b.k FROM s b, range(1, 101) t(i) JOIN s e ON true WHERE e.hy = b.hy AND e.k > b.k - i AND e.k <= b.k AND b.k >= i GROUP BY b.hy, i, b.k) GROUP BY 1, 2),
g AS (SELECT hy, i, a, (a - lag(a) OVER (PARTITION BY hy ORDER BY i)) / nullif(lag(a) OVER (PARTITION BY hy ORDER BY i), 0) AS rise FROM m)
SELECT round(avg(coalesce(a, 0)), 4) AS flow FROM (SELECT hy, max_by(a, (rise, -i)) FILTER (WHERE rise > 0) AS a FROM g GROUP BY 1)""")(lambda t: ts.base_flow(daily(t), "day", "q", 4).select(F.round("flow", 4).alias("flow")))
query("wn_13_factors", f"SELECT month, round(sqrt(mean / min(mean) OVER ()), 6) AS factor FROM (SELECT CAST(month(day) AS INT) AS month, avg(q) AS mean FROM {DAILY} GROUP BY 1)")(lambda t: ts.monthly_factors(daily(t), "day", "q").select("month", F.round("factor", 6).alias("factor")))
query("wn_14", f"SELECT strftime(day, '%Y-%m-%d') AS day, round(q - lag(q) OVER (ORDER BY day), 6) AS step FROM {DAILY}")(
    lambda t: (lambda d, w: d.select(c("day").cast("string").alias("day"), F.round(c("q") - F.lag("q").over(w), 6).alias("step")))(daily(t), Window.orderBy("day"))
)
query("wn_25", "SELECT strftime(unnest(generate_series(DATE '1999-12-30', DATE '2000-03-02', INTERVAL 1 DAY)), '%Y%j') AS d")(
    lambda t: t.spark.sql("SELECT date_format(d, 'yyyyDDD') AS d FROM (SELECT explode(sequence(DATE '1999-12-30', DATE '2000-03-02')) AS d)")
)

query("prj_37", "SELECT o_orderkey FROM (SELECT o_orderkey, year(o_orderdate) AS y, dayofyear(o_orderdate) AS j FROM orders) WHERE CASE WHEN y = 1996 THEN j >= 60 WHEN y = 1998 THEN j <= 200 ELSE y > 1996 AND y < 1998 END")(
    lambda t: t.orders.where(dates.in_period(F.year("o_orderdate"), F.dayofyear("o_orderdate"), (1996, 60), (1998, 200))).select("o_orderkey")
)
query("prj_37_one_year", "SELECT o_orderkey FROM (SELECT o_orderkey, year(o_orderdate) AS y, dayofyear(o_orderdate) AS j FROM orders) WHERE y = 1997 AND j >= 100")(
    lambda t: t.orders.where(dates.in_period(F.year("o_orderdate"), F.dayofyear("o_orderdate"), (1997, 100), (1997, 150))).select("o_orderkey")
)


def ladder(x, limits, labels):
    """First label whose limit is over x; the last label beyond all limits."""
    out = F.lit(labels[-1])
    for limit, label in reversed(list(zip(limits, labels))):
        out = F.when(x < limit, label).otherwise(out)
    return out


query("prj_39", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 WHEN p_size < 20 THEN 1 ELSE 2 END AS k FROM part")(lambda t: t.part.select("p_partkey", ladder(c("p_size"), [5, 20], [0, 1, 2]).alias("k")))
query("prj_40", "SELECT p_partkey, CASE WHEN p_size < 5 THEN '0-5' WHEN p_size < 20 THEN '5-20' ELSE '20-9999' END AS k FROM part")(lambda t: t.part.select("p_partkey", ladder(c("p_size"), [5, 20], ["0-5", "5-20", "20-9999"]).alias("k")))
query("prj_41", "SELECT p_partkey, CASE WHEN p_size < 1 THEN 121 WHEN p_size < 3 THEN 90 WHEN p_size < 5 THEN 60 WHEN p_size < 8 THEN 30 ELSE 10 END AS k FROM part")(lambda t: t.part.select("p_partkey", ladder(c("p_size"), [1, 3, 5, 8], [121, 90, 60, 30, 10]).alias("k")))
query("prj_43", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'a' WHEN 'LARGE' THEN 'b' ELSE 'z' END AS k FROM part")(
    lambda t: t.part.select("p_partkey", F.coalesce(F.create_map(F.lit("SMALL"), F.lit("a"), F.lit("LARGE"), F.lit("b"))[c("p_type")], F.lit("z")).alias("k"))
)
query("prj_45", "SELECT p_partkey, 'hru' || lpad(CAST(p_partkey AS VARCHAR), CAST((SELECT length(CAST(max(p_partkey) AS VARCHAR)) FROM part) AS INT), '0') AS name FROM part")(
    lambda t: t.part.crossJoin(F.broadcast(t.part.agg(F.length(F.max("p_partkey").cast("string")).alias("w")))).select("p_partkey", F.concat(F.lit("hru"), F.lpad(c("p_partkey").cast("string"), c("w"), F.lit("0"))).alias("name"))
)
query("prj_46", "SELECT s_suppkey, CAST(abs(round_even(s_acctbal / 100 * 1000, 0)) AS BIGINT) || CASE WHEN s_acctbal >= 0 THEN 'n' ELSE 's' END AS name FROM supplier")(
    lambda t: t.supplier.select("s_suppkey", F.concat(F.abs(F.bround(c("s_acctbal") / 100 * 1000, 0)).cast("long").cast("string"), F.when(c("s_acctbal") >= 0, "n").otherwise("s")).alias("name"))
)
