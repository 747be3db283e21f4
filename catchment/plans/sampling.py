"""Distributions, samples and sensitivity measures; line items and orders stand for model runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.operators import sampling as sa
from catchment.plans.registry import query

PARAMS = [("cn2", 35.0, 95.0), ("esco", 0.0, 1.0), ("awc", -0.25, 0.25)]


def c(name):
    return F.col(name)


def normal_inverse_sql():
    """The approximation of the inverse normal distribution written out in SQL over ``u``."""

    def poly(x, terms):
        return reduce(lambda out, term: f"({out}) * {x} + ({term!r})", terms[1:], repr(terms[0]))

    tail = lambda q: f"({poly(q, sa._C)}) / (({poly(q, sa._D)}) * {q} + 1)"
    r = "((u - 0.5) * (u - 0.5))"
    middle = f"({poly(r, sa._A)}) * (u - 0.5) / (({poly(r, sa._B)}) * {r} + 1)"
    return f"CASE WHEN u < 0.02425 THEN {tail('sqrt(-2 * ln(u))')} WHEN u > 0.97575 THEN -({tail('sqrt(-2 * ln(1 - u))')}) ELSE {middle} END"


def _x(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (c("l_quantity") / 50).alias("x"))


X = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS x FROM lineitem)"


def _column(name, sql, make):
    query(name, f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql}, 8) AS v FROM {X}")(lambda t: _x(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(make(c("x")), 8).alias("v")))


_column("sa_7", "35 + 60 * x", lambda x: 35 + 60 * x)
_column("sa_8", "CASE WHEN x < 0.1 OR x > 0.9 THEN 0 WHEN x <= 0.3 THEN 2 * (x - 0.1) / 0.16 ELSE 2 * (0.9 - x) / 0.48 END", lambda x: sa.triangular_density(x, 0.1, 0.3, 0.9))
_column("sa_9", "CASE WHEN x < 0.1 OR x > 0.9 THEN 0 WHEN x < 0.3 THEN 2 / 1.1 * (x - 0.1) / 0.2 WHEN x <= 0.6 THEN 2 / 1.1 ELSE 2 / 1.1 * (0.9 - x) / 0.3 END", lambda x: sa.trapezoidal_density(x, 0.1, 0.3, 0.6, 0.9))
_column("sa_10", "exp(-pow((x - 0.5) / 0.2, 2) / 2) / (0.2 * sqrt(2 * pi()))", lambda x: sa.normal_density(x, 0.5, 0.2))
_column("sa_11", "exp(-pow((ln(x) + 1) / 0.5, 2) / 2) / (0.5 * sqrt(2 * pi())) / x", lambda x: sa.lognormal_density(x, -1.0, 0.5))
_column("sa_12", "CASE WHEN u < 0.25 THEN 0.1 + sqrt(u * 0.8 * 0.2) ELSE 0.9 - sqrt((1 - u) * 0.8 * 0.6) END".replace("u", "(x * 0.98)"), lambda x: sa.triangular_inverse(x * 0.98, 0.1, 0.3, 0.9))
_column("sa_13", "CASE WHEN x < 0.2 / 1.1 THEN 0.1 + sqrt(x * 1.1 * 0.2) WHEN x <= 0.8 / 1.1 THEN (x * 1.1 + 0.4) / 2 ELSE 0.9 - sqrt((1 - x) * 1.1 * 0.3) END", lambda x: sa.trapezoidal_inverse(x, 0.1, 0.3, 0.6, 0.9))
_column("sa_30", "100 * pow(x - x * x, 2) + pow(1 - x, 2)", lambda x: sa.rosenbrock(x, x))
_column("sa_30_goldstein", "(1 + pow(2 * x + 1, 2) * (19 - 28 * x + 12 * x * x)) * (30 + pow(-x, 2) * (18 + 16 * x + 3 * x * x))", lambda x: sa.goldstein(x, x))
_column("sa_30_camel", "(4 - 2.1 * x * x + pow(x, 4) / 3) * x * x + x * x + (4 * x * x - 4) * x * x", lambda x: sa.camel(x, x))
_column("sa_30_rastrigin", "2 * x * x - 2 * cos(18 * x)", lambda x: sa.rastrigin(x, x))
_column("sa_30_griewank", "x * x / 100 - cos(x) * cos(x / sqrt(2)) + 1", lambda x: sa.griewank(x, x))
query("fn_55", "SELECT u AS p, round(" + normal_inverse_sql() + ", 9) AS z FROM (SELECT i / 1000 AS u FROM range(1, 1000) r(i))")(lambda t: t.spark.range(1, 1000).select((c("id") / 1000).alias("p")).select("p", F.round(sa.normal_inverse(c("p")), 9).alias("z")))
_PARAMS = "p(param, low, high) AS (VALUES " + ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in PARAMS) + ")"


def uniform_sql(seed: int, *keys: str) -> str:
    """The draw of ``sa.uniform`` in SQL."""
    return "((CAST('0x' || substr(md5('" + str(seed) + "'" + "".join(f" || ':' || {k}" for k in keys) + "), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


query("sa_2", f"WITH {_PARAMS} SELECT o_orderkey AS run, param, round(low + (high - low) * {uniform_sql(7, 'o_orderkey', 'param')}, 9) AS value FROM orders, p")(
    lambda t: sa.monte_carlo(t.spark, t.orders.select(c("o_orderkey").alias("run")), PARAMS, 7).withColumn("value", F.round("value", 9))
)
query(
    "sa_3",
    f"""WITH {_PARAMS}, r AS (SELECT c_custkey AS run, param, low, high, row_number() OVER (PARTITION BY param ORDER BY {uniform_sql(7, 'c_custkey', 'param')}, c_custkey) - 1 AS stratum FROM customer, p)
    SELECT run, param, CAST(stratum AS BIGINT) AS stratum, round(low + (high - low) * (stratum + {uniform_sql(8, 'run', 'param')}) / (SELECT count(*) FROM customer), 9) AS value FROM r""",
)(lambda t: sa.latin_hypercube(t.spark, t.customer.select(c("c_custkey").alias("run")), PARAMS, 7).withColumn("value", F.round("value", 9)))
query("sa_4_first", "SELECT CAST(i AS BIGINT) AS i, list_sum([(i >> k & 1) * pow(2.0, -(k + 1)) FOR k IN range(31)]) AS u FROM range(512) r(i)")(lambda t: t.spark.range(512).select(c("id").alias("i"), sa.van_der_corput(c("id")).alias("u")))
query("sa_4", "SELECT i AS run, param, round(low + (high - low) * list_reduce([(xor(i + 1, (i + 1) >> 1) >> k & 1) * v[k + 1] FOR k IN range(30)], lambda a, b: xor(a, b)) / 1073741824, 10) AS value FROM range(512) r(i), (VALUES " + ", ".join(f"('{n}', {a}, {b}, {sa.sobol_directions(k)})" for k, (n, a, b) in enumerate(PARAMS)) + ") z(param, low, high, v)")(lambda t: sa.sobol_sample(t.spark, 512, PARAMS).withColumn("value", F.round("value", 10)))
query("sa_14", f"SELECT o_orderkey AS id, round(3 + 2 * ({normal_inverse_sql()}), 7) AS x FROM (SELECT o_orderkey, {uniform_sql(3, 'o_orderkey')} AS u FROM orders)")(
    lambda t: t.orders.select(c("o_orderkey").alias("id"), F.round(3 + 2 * sa.normal_inverse(sa.uniform("o_orderkey", seed=3)), 7).alias("x"))
)
query("sa_15", f"SELECT o_orderkey AS id, round(exp(1 + 0.5 * ({normal_inverse_sql()})), 7) AS x FROM (SELECT o_orderkey, {uniform_sql(4, 'o_orderkey')} AS u FROM orders)")(
    lambda t: t.orders.select(c("o_orderkey").alias("id"), F.round(F.exp(1 + 0.5 * sa.normal_inverse(sa.uniform("o_orderkey", seed=4))), 7).alias("x"))
)
query("sa_16", "SELECT p_partkey, p_size / sum(p_size) OVER (PARTITION BY p_brand) AS w FROM part")(lambda t: t.part.select("p_partkey", (c("p_size") / F.sum("p_size").over(Window.partitionBy("p_brand"))).alias("w")))


def _base(t):
    """Runs from orders with three parameters."""
    o = t.orders.select(c("o_orderkey").alias("run"), (c("o_totalprice") / 1000).alias("a"), (c("o_custkey") % 17 + 1.0).alias("b"), (c("o_orderkey") % 5 + 1.0).alias("d"))
    return o.unpivot("run", ["a", "b", "d"], "param", "value")


_BASE = "b AS (SELECT o_orderkey AS run, unnest(['a', 'b', 'd']) AS param, unnest([o_totalprice / 1000, o_custkey % 17 + 1.0, o_orderkey % 5 + 1.0]) AS value, unnest([1, 2, 3]) AS place FROM orders)"
_STEPS = f"{_BASE}, s AS (SELECT run, CAST(step AS INT) AS step, param, CASE WHEN step >= place THEN value * 1.1 ELSE value END AS value FROM b, range(4) r(step))"


query("sa_17", f"WITH {_STEPS} SELECT run, step, param, round(value, 8) AS value FROM s")(lambda t: sa.one_at_a_time(_base(t), 0.1).select("run", "step", "param", F.round("value", 8).alias("value")))


def _outputs(t):
    """y = a * b + d * d at each step and at the one before, the parameter that the step changed, and its value before."""
    o = t.orders.select(c("o_orderkey").alias("run"), (c("o_totalprice") / 1000).alias("a"), (c("o_custkey") % 17 + 1.0).alias("b"), (c("o_orderkey") % 5 + 1.0).alias("d"))
    y = lambda at: at("a") * at("b") + at("d") * at("d")
    return sa.steps_of_runs(o, ["a", "b", "d"], 0.1).select("run", "step", "param", "base", y(c).alias("y"), y(lambda x: c(f"before.{x}")).alias("before"))


_WIDE = "w AS (SELECT run, step, max(value) FILTER (WHERE param = 'a') AS a, max(value) FILTER (WHERE param = 'b') AS b, max(value) FILTER (WHERE param = 'd') AS d FROM s GROUP BY 1, 2), y AS (SELECT *, a * b + d * d AS y, lag(a * b + d * d) OVER (PARTITION BY run ORDER BY step) AS y0 FROM w)"
query("sa_18", f"WITH {_STEPS}, {_WIDE}, e AS (SELECT ['-', 'a', 'b', 'd'][step + 1] AS param, [a, b, d][step] / 1.1 AS v, y - y0 AS change, (y + y0) / 2 AS mean FROM y WHERE step > 0) SELECT param, round(avg(change / (0.1 * v)), 6) AS cas, round(avg(change / 0.1 / mean), 6) AS ctrs, round(avg(abs(100 * change / mean / 0.1)), 6) AS pe FROM e GROUP BY 1")(
    lambda t: sa.perturbation_sensitivities(_outputs(t), 0.1).select("param", *[F.round(x, 6).alias(x) for x in ("cas", "ctrs", "pe")])
)
query("sa_26", f"WITH {_STEPS}, {_WIDE} SELECT ['-', 'a', 'b', 'd'][step + 1] AS param, round(avg((y - y0) / 0.1), 6) AS mu, round(avg(abs((y - y0) / 0.1)), 6) AS mu_star, round(stddev_samp((y - y0) / 0.1), 6) AS sigma FROM y WHERE step > 0 GROUP BY 1")(
    lambda t: sa.elementary_effects(_outputs(t), 0.1).select("param", *[F.round(x, 6).alias(x) for x in ("mu", "mu_star", "sigma")])
)
query("sa_20", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 8) AS p_size FROM part")(lambda t: sa.standardise(t.part.select("p_partkey", c("p_size").cast("double")), ["p_size"]).select("p_partkey", F.round("p_size", 8).alias("p_size")))
query("sa_22", "WITH o AS (SELECT o_orderkey AS run, ln(o_totalprice) AS ya, ln(o_custkey + 2) * 3 AS yb FROM orders), v AS (SELECT var_pop(y) AS v FROM (SELECT ya AS y FROM o UNION ALL SELECT yb FROM o)) SELECT k AS param, round(avg(yb * (ya * w + yb * (1 - w) - ya)) / min(v), 8) AS first, round(avg(pow(ya - (ya * w + yb * (1 - w)), 2)) / (2 * min(v)), 8) AS total FROM o, v, (VALUES ('p', 0.25), ('q', 0.75)) z(k, w) GROUP BY 1")(
    lambda t: (lambda o: sa.sobol_indices(o.crossJoin(F.broadcast(t.spark.createDataFrame([("p", 0.25), ("q", 0.75)], "param string, w double"))).withColumn("yc", c("ya") * c("w") + c("yb") * (1 - c("w")))).select("param", F.round("first", 8).alias("first"), F.round("total", 8).alias("total")))(
        t.orders.select(c("o_orderkey").alias("run"), F.ln("o_totalprice").alias("ya"), (F.ln(c("o_custkey") + 2) * 3).alias("yb"))
    )
)
query("st_15", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (), 12) AS weight FROM orders WHERE o_totalprice <= 20000")(lambda t: sa.behavioural(t.orders, "o_totalprice", 20000).select("o_orderkey", F.round("weight", 12).alias("weight")))
query("st_13", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")(lambda t: t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey"))
query("sa_33", "SELECT strftime(make_date(y, m, d), '%Y-%m-%d') AS day, round(q, 4) AS q FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, sum(o_totalprice) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3)")(
    lambda t: t.orders.where("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 4).alias("q")).select(F.make_date("y", "m", "d").cast("string").alias("day"), "q")
)
