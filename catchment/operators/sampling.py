"""Parameter samples, distributions and sensitivity measures.

Samples are long tables: run, param, value. Random draws come from hashes of (seed, run, param), so
a lost task redraws the same numbers, and other engines can.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment.operators.iterate import cut

# Coefficients of Acklam's approximation of the inverse normal distribution, in order of the polynomials' terms.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def uniform(*keys: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) for each combination of keys: 52 bits of the md5 of the seed and the keys' texts, joined by colons; a null counts as no text."""
    texts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def _poly(x: Column, terms: list[float]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def normal_inverse(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1). Relative error under 1.2e-9."""
    low = 0.02425
    q = F.sqrt(-2 * F.ln(F.when(p < low, p).otherwise(1 - p)))
    tail = _poly(q, _C) / (_poly(q, _D) * q + 1)
    mid = p - 0.5
    r = mid * mid
    middle = _poly(r, _A) * mid / (_poly(r, _B) * r + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail).when(p > 1 - low, -tail).otherwise(middle)


def triangular_inverse(u: Column, left: float, mode: float, right: float) -> Column:
    cut = (mode - left) / (right - left)
    return F.when(u < cut, left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode)))


def triangular_density(x: Column, left: float, mode: float, right: float) -> Column:
    up, down = 2 / ((right - left) * (mode - left)), 2 / ((right - left) * (right - mode))
    return F.when((x < left) | (x > right), 0.0).when(x <= mode, up * (x - left)).otherwise(down * (right - x))


def trapezoidal_density(x: Column, left: float, first: float, second: float, right: float) -> Column:
    top = 2 / (right + second - first - left)
    return F.when((x < left) | (x > right), 0.0).when(x < first, top * (x - left) / (first - left)).when(x <= second, F.lit(top)).otherwise(top * (right - x) / (right - second))


def trapezoidal_inverse(u: Column, left: float, first: float, second: float, right: float) -> Column:
    whole = right + second - first - left
    rise, flat = (first - left) / whole, (2 * second - first - left) / whole
    return F.when(u < rise, left + F.sqrt(u * whole * (first - left))).when(u <= flat, (u * whole + left + first) / 2).otherwise(right - F.sqrt((1 - u) * whole * (right - second)))


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-F.pow((x - mean) / deviation, 2) / 2) / (deviation * (2 * 3.141592653589793) ** 0.5)


def lognormal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.when(x > 0, normal_density(F.ln(x), mean, deviation) / x).otherwise(0.0)


def quantile(u: Column, kind: str, settings: list[float]) -> Column:
    """A parameter's value at probability ``u``: uniform (low, high), triangular, trapezoidal, normal or lognormal (mean, deviation)."""
    if kind == "uniform":
        low, high = settings
        return low + (high - low) * u
    if kind == "triangular":
        return triangular_inverse(u, *settings)
    if kind == "trapezoidal":
        return trapezoidal_inverse(u, *settings)
    if kind not in ("normal", "lognormal"):
        raise ValueError(f"no such distribution: {kind}")
    mean, deviation = settings
    z = mean + deviation * normal_inverse(u)
    return z if kind == "normal" else F.exp(z)


def runs(spark: SparkSession, n: int | DataFrame, params: list[tuple[str, float, float]]) -> DataFrame:
    """run, param, low, high for the runs 0 to n - 1, or for those of a table with a column ``run``."""
    grid = spark.createDataFrame(params, "param string, low double, high double")
    own = spark.range(n).withColumnRenamed("id", "run") if isinstance(n, int) else n.select("run")
    return own.crossJoin(F.broadcast(grid))


def monte_carlo(spark: SparkSession, n: int | DataFrame, params: list[tuple[str, float, float]], seed: int = 0) -> DataFrame:
    """run, param, value: independent draws between the bounds of each parameter."""
    return runs(spark, n, params).select("run", "param", (F.col("low") + (F.col("high") - F.col("low")) * uniform("run", "param", seed=seed)).alias("value"))


def ranks(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the place from 0 inside each ``by`` in the order of ``order``, which has no ties.

    Rows are dealt by ranges and numbered inside these; the sizes of the ranges tell where each begins, so no group lies in one task.
    """
    dealt = cut(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(by, "_part").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(starts, [by, "_part"]).withColumn(name, F.col("_inside") + F.col("_start")).drop("_inside", "_part", "_start")


def latin_hypercube(spark: SparkSession, n: int | DataFrame, params: list[tuple[str, float, float]], seed: int = 0) -> DataFrame:
    """run, param, stratum, value: one draw from each of as many equal strata of every parameter as there are runs, in random order."""
    count = n if isinstance(n, int) else n.count()
    rows = runs(spark, n, params).withColumn("_draw", uniform("run", "param", seed=seed))
    rows = ranks(rows, "param", ["_draw", "run"], "stratum")
    u = (F.col("stratum") + uniform("run", "param", seed=seed + 1)) / count
    return rows.select("run", "param", "stratum", (F.col("low") + (F.col("high") - F.col("low")) * u).alias("value"))


def van_der_corput(index: Column, bits: int = 31) -> Column:
    """Base-2 radical inverse: the first dimension of a Sobol sequence."""
    out = F.lit(0.0)
    for k in range(bits):
        out = out + F.shiftright(index, k).bitwiseAND(1) * 2.0 ** -(k + 1)
    return out


# A Sobol sequence's primitive polynomials, bits of their coefficients, one for each dimension.
SOBOL_POLYNOMIALS = [
    1, 3, 7, 11, 13, 19, 25, 37, 59, 47, 61, 55, 41, 67, 97, 91, 109, 103, 115, 131,
    193, 137, 145, 143, 241, 157, 185, 167, 229, 171, 213, 191, 253, 203, 211, 239, 247, 285, 369, 299,
]
# The second to eighth initial direction numbers of the last dimensions; the first is always 1.
SOBOL_STARTS = [
    [1, 3, 1, 3, 1, 3, 3, 1, 3, 1, 3, 1, 3, 1, 1, 3, 1, 3, 1, 3, 1, 3, 3, 1, 3, 1, 3, 1, 3, 1, 1, 3, 1, 3, 1, 3, 1, 3],
    [7, 5, 1, 3, 3, 7, 5, 5, 7, 7, 1, 3, 3, 7, 5, 1, 1, 5, 3, 3, 1, 7, 5, 1, 3, 3, 7, 5, 1, 1, 5, 7, 7, 5, 1, 3, 3],
    [1, 7, 9, 13, 11, 1, 3, 7, 9, 5, 13, 13, 11, 3, 15, 5, 3, 15, 7, 9, 13, 9, 1, 11, 7, 5, 15, 1, 15, 11, 5, 3, 1, 7, 9],
    [9, 3, 27, 15, 29, 21, 23, 19, 11, 25, 7, 13, 17, 1, 25, 29, 3, 31, 11, 5, 23, 27, 19, 21, 5, 1, 17, 13, 7, 15, 9, 31, 9],
    [37, 33, 7, 5, 11, 39, 63, 27, 17, 15, 23, 29, 3, 21, 13, 31, 25, 9, 49, 33, 19, 29, 11, 19, 27, 15, 25],
    [13, 33, 115, 41, 79, 17, 29, 119, 75, 73, 105, 7, 59, 65, 21, 3, 113, 61, 89, 45, 107],
    [7, 23, 39],
]
SOBOL_BITS = 30


def sobol_directions(dimension: int) -> list[int]:
    """The numbers that the bits of a point's index are combined from, in one dimension (from 0)."""
    if not dimension:
        return [1 << (SOBOL_BITS - k - 1) for k in range(SOBOL_BITS)]
    polynomial = SOBOL_POLYNOMIALS[dimension]
    degree = polynomial.bit_length() - 1
    m = [1] + [row[dimension - len(SOBOL_POLYNOMIALS)] for row in SOBOL_STARTS[: degree - 1]]
    for k in range(degree, SOBOL_BITS):
        new = m[k - degree]
        for j in range(1, degree + 1):
            if polynomial >> (degree - j) & 1:
                new ^= m[k - j] << j
        m.append(new)
    return [x << (SOBOL_BITS - k - 1) for k, x in enumerate(m)]


def sobol(index: Column, dimension: int) -> Column:
    """A point's coordinate in [0, 1); points come in the order of the Gray code of their index."""
    return _combined(index, [F.lit(v).cast("long") for v in sobol_directions(dimension)])


def sobol_points(points: DataFrame, index: str, dimensions: int) -> DataFrame:
    """``points`` with dimension and u: a row for each of the first ``dimensions`` coordinates of the point at ``index``.

    The directions' numbers are a column, so that one expression serves all dimensions.
    """
    numbers = F.array(*[F.array(*[F.lit(v).cast("long") for v in sobol_directions(k)]) for k in range(dimensions)])
    rows = points.select("*", F.posexplode(numbers).alias("dimension", "_numbers"))
    return rows.withColumn("u", _combined(F.col(index), [F.col("_numbers")[k] for k in range(SOBOL_BITS)])).drop("_numbers")


def _combined(index: Column, numbers: list[Column]) -> Column:
    """The numbers of the bits that are set in the Gray code of ``index``, combined, in [0, 1)."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    used = [F.shiftright(gray, k).bitwiseAND(1) * v for k, v in enumerate(numbers)]
    return reduce(lambda out, v: out.bitwiseXOR(v), used) / float(1 << SOBOL_BITS)


def sobol_sample(spark: SparkSession, n: int, params: list[tuple[str, float, float]], start: int = 1) -> DataFrame:
    """run, param, value: ``n`` points of the sequence from ``start`` on, each parameter in its range."""
    if len(params) > len(SOBOL_POLYNOMIALS):
        raise ValueError(f"at most {len(SOBOL_POLYNOMIALS)} parameters")
    values = [F.struct(F.lit(name).alias("param"), (low + (high - low) * sobol(F.col("id") + start, k)).alias("value")) for k, (name, low, high) in enumerate(params)]
    return spark.range(n).select(F.col("id").alias("run"), F.inline(F.array(*values)))


def next_seed(seed: Column) -> Column:
    """The multiplicative generator with modulus 2^31 - 1 and factor 16807; seeds 1 to 2^31 - 2."""
    return F.pmod(seed.cast("long") * 16807, F.lit((1 << 31) - 1))


def uniform_integer(low: int, high: int, seed: Column) -> Column:
    """An integer from ``low`` to ``high``, rounded from the number that follows ``seed``."""
    r = next_seed(seed).cast("double") / float((1 << 31) - 1)
    value = F.floor((1 - r) * (low - 0.5) + r * (high + 0.5) + 0.5)
    return F.least(F.lit(high), F.greatest(F.lit(low), value)).cast("long")


def one_at_a_time(base: DataFrame, factor: float) -> DataFrame:
    """run, step, param, value: step 0 is the base; step j also changes the first j parameters by ``factor``."""
    order = F.dense_rank().over(Window.partitionBy("run").orderBy("param"))
    rows = base.withColumn("place", order).withColumn("last", F.max("place").over(Window.partitionBy("run").orderBy("param").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return rows.select("run", "step", "param", F.when(F.col("step") >= F.col("place"), F.col("value") * (1 + factor)).otherwise(F.col("value")).alias("value"))


def steps_of_runs(runs: DataFrame, names: list[str], factor: float) -> DataFrame:
    """run, step, param, base, ``names``, before: the steps of ``one_at_a_time`` in wide form, with no shuffle.

    ``runs`` has a row a run with a column for each of ``names``, which are changed in that order. Step j
    changes ``param``, whose value was ``base``; ``before`` holds the columns at the step before (null at step 0).
    """
    at = lambda j: [(F.col(x) * (1 + factor) if k < j else F.col(x)).alias(x) for k, x in enumerate(names)]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(j).alias("step"), F.lit(names[j - 1] if j else "-").alias("param"), (F.col(names[j - 1]) if j else none).cast("double").alias("base"), *at(j),
            F.struct(*(at(j - 1) if j else [none.alias(x) for x in names])).alias("before"),
        )
        for j in range(len(names) + 1)
    ]
    return runs.select("run", F.inline(F.array(*rows)))


def _before(outputs: DataFrame) -> Column:
    """y at the step before: the column ``before`` where there is one, else sought in the run."""
    return F.col("before") if "before" in outputs.columns else F.lag("y").over(Window.partitionBy("run").orderBy("step"))


def elementary_effects(outputs: DataFrame, delta: float) -> DataFrame:
    """param, mu, mu_star, sigma from outputs (run, step, param, y[, before]): step's change over the step before."""
    effects = outputs.withColumn("effect", (F.col("y") - _before(outputs)) / delta).where("step > 0")
    return effects.groupBy("param").agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.stddev_samp("effect").alias("sigma"))


def perturbation_sensitivities(outputs: DataFrame, factor: float) -> DataFrame:
    """param, cas, ctrs, pe: mean sensitivities over the base runs, from outputs (run, step, param, base, y[, before]).

    Each step changes one parameter of value ``base`` by ``factor``. cas is the change of y for a
    unit of the parameter, ctrs the same relative to parameter and mean output, pe the absolute
    change in per cent of the mean output for the factor. Where a divisor is 0 the run doesn't count.
    """
    before = _before(outputs)
    rows = outputs.withColumn("change", F.col("y") - before).withColumn("mean", (F.col("y") + before) / 2).where("step > 0")
    cas = F.try_divide(F.col("change"), factor * F.col("base"))
    return rows.groupBy("param").agg(F.avg(cas).alias("cas"), F.avg(F.try_divide(cas * F.col("base"), F.col("mean"))).alias("ctrs"), F.avg(F.abs(F.try_divide(100 * F.col("change"), F.col("mean")) / factor)).alias("pe"))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population deviation."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*stats.columns)


def regression_coefficients(df: DataFrame, inputs: list[str], output: str) -> tuple[dict[str, float], float]:
    """Standardised regression coefficients and R squared, from sums of products (k by k) alone."""
    import numpy as np

    z = standardise(df, [*inputs, output])
    names = [*inputs, output]
    row = z.agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    r = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    beta = np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=None)[0]
    return dict(zip(inputs, beta.tolist())), float(beta @ r[:-1, -1])


def sobol_indices(outputs: DataFrame) -> DataFrame:
    """param, first, total from run, param, ya, yb, yc: yc has the parameter from b and the rest from a."""
    both = outputs.select("run", "ya", "yb").distinct()
    variance = both.select(F.explode(F.array("ya", "yb")).alias("y")).agg(F.var_pop("y").alias("v"))
    parts = outputs.groupBy("param").agg(F.avg(F.col("yb") * (F.col("yc") - F.col("ya"))).alias("f"), F.avg(F.pow(F.col("ya") - F.col("yc"), 2)).alias("t"))
    return parts.crossJoin(F.broadcast(variance)).select("param", (F.col("f") / F.col("v")).alias("first"), (F.col("t") / (2 * F.col("v"))).alias("total"))


def behavioural(df: DataFrame, output: str, limit: float) -> DataFrame:
    """Runs with output at most ``limit``, with weights that sum to 1."""
    kept = df.where(F.col(output) <= limit)
    total = kept.agg(F.sum(output).alias("_sum"))
    return kept.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide(F.col(output), F.col("_sum"))).drop("_sum")


def rosenbrock(x: Column, y: Column) -> Column:
    return 100 * F.pow(y - x * x, 2) + F.pow(1 - x, 2)


def goldstein(x: Column, y: Column) -> Column:
    a = 1 + F.pow(x + y + 1, 2) * (19 - 14 * x + 3 * x * x - 14 * y + 6 * x * y + 3 * y * y)
    b = 30 + F.pow(2 * x - 3 * y, 2) * (18 - 32 * x + 12 * x * x + 48 * y - 36 * x * y + 27 * y * y)
    return a * b


def camel(x: Column, y: Column) -> Column:
    return (4 - 2.1 * x * x + F.pow(x, 4) / 3) * x * x + x * y + (4 * y * y - 4) * y * y


def rastrigin(x: Column, y: Column) -> Column:
    return x * x + y * y - F.cos(18 * x) - F.cos(18 * y)


def griewank(x: Column, y: Column) -> Column:
    return (x * x + y * y) / 200 - F.cos(x) * F.cos(y / 2**0.5) + 1
