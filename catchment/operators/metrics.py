"""Goodness of fit of a modelled against an observed series.

Input is a table of pairs (o, m) with an order column and, optionally, series keys; the result has
one row for each series. Every metric is an aggregate over the pairs, so one pass serves them all.
``RMSE_log`` takes no parameter, ``MAPE`` divides by the modelled value, and ``IA`` equals the ratio
of ``RSR``, as in the library whose names these are; Willmott's index is ``INF_IOA``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameters that the information criteria count.
PARAMETERS = 3


def _square(x: Column) -> Column:
    return x * x


def _residual() -> Column:
    return F.col("o") - F.col("m")


def columns(parameters: int = PARAMETERS) -> dict[str, Column]:
    """Name to aggregate over prepared pairs (o, m, o_mean, o_before, m_before, r_before)."""
    O, M, N, P = F.col("o"), F.col("m"), F.count(F.lit(1)), parameters  # noqa: E741
    R = O - M

    def _box(x: Column, power: float = 0.25) -> Column:
        return (F.pow(x, power) - 1) / power

    def _spread(x: Column) -> Column:  # sum of squared distances from the mean
        return F.var_pop(x) * N

    def _nse(f) -> Column:
        return 1 - F.try_divide(F.sum(_square(f(O) - f(M))), _spread(f(O)))

    def _positive(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0))

    def _information(penalty: Column) -> Column:
        return N * F.ln(F.sum(_square(R)) / N) + penalty

    return {
        "PDIFF": F.max(O) - F.max(M),
        "PEP": 100 * F.try_divide(F.max(O) - F.max(M), F.max(O)),
        "ME": F.avg(R),
        "MAE": F.avg(F.abs(R)),
        "MSE": F.avg(_square(R)),
        "MSLE": F.avg(_square(F.ln(O) - F.ln(M))),
        "AME": F.max(F.abs(R)),
        "MSDE": F.avg(_square((O - F.col("o_before")) - (M - F.col("m_before")))),
        "RMSE": F.sqrt(F.avg(_square(R))),
        "RRMSE": F.try_divide(F.sqrt(F.avg(_square(R))), F.avg(O)),
        "RMSE_log": F.sqrt(F.avg(_square(F.ln(O) - F.ln(M)))),
        "RMSE_boxcox": F.sqrt(F.avg(_square(_box(O) - _box(M)))),
        "R4MS4E": F.pow(F.avg(_square(_square(R))), 0.25),
        "SSE": F.sum(_square(R)),
        "NSC": F.sum(((R < 0) != (F.col("r_before") < 0)).cast("long")),
        "MRE": F.avg(F.try_divide(R, O)),
        "MPE": 100 * F.avg(F.try_divide(R, O)),
        "MARE": F.avg(F.try_divide(F.abs(R), O)),
        "SARE": F.sum(F.try_divide(F.abs(R), O)),
        "MeAPE": F.median(100 * F.try_divide(F.abs(R), O)),
        "MSRE": F.avg(_square(F.try_divide(R, O))),
        "MAPE": 100 * F.avg(F.try_divide(F.abs(R), F.abs(M))),
        "PBIAS": 100 * F.try_divide(F.sum(R), F.sum(O)),
        "APBIAS": 100 * F.try_divide(F.sum(F.abs(R)), F.sum(O)),
        "APB": 100 * F.try_divide(F.sum(F.abs(R)), F.sum(O)),
        "BIAS": F.avg(R),
        "RVE": F.try_divide(F.sum(R), F.sum(O)),
        "RMAE": F.try_divide(F.sum(F.abs(R)), F.sum(O)),
        "ThInC": F.try_divide(_square(F.sum(F.abs(R))), _square(F.sum(O))),
        "TMC": 100 * F.abs(F.try_divide(F.sum(O), F.sum(M)) - 1),
        "CrBal": 1 - F.abs(F.sqrt(F.try_divide(F.sum(M), F.sum(O))) - F.sqrt(F.try_divide(F.sum(O), F.sum(M)))),
        "NSE": _nse(lambda x: x),
        "NSE_sqrt": _nse(F.sqrt),
        "NSE_log": _nse(F.ln),
        "NSE_boxcox": _nse(_box),
        "RAE": F.try_divide(F.sum(F.abs(R)), F.sum(F.abs(O - F.col("o_mean")))),
        "RSR": F.try_divide(F.sqrt(F.sum(_square(R))), F.sqrt(_spread(O))),
        "IA": 1 - F.try_divide(F.sum(_square(R)), _spread(O)),
        "PI": 1 - F.try_divide(F.sum(F.when(F.col("o_before").isNotNull(), _square(R))), F.sum(_square(O - F.col("o_before")))),
        "RCOEF": F.corr(O, M),
        "SFDCE": F.abs((F.percentile(M, 0.7) - F.percentile(M, 0.3)) - (F.percentile(O, 0.7) - F.percentile(O, 0.3))) / 40,
        "NSE_BIAS": _nse(lambda x: x) - 5 * F.pow(F.abs(F.ln(1 + F.abs(F.avg(R)))), 2.5),
        "INF_NSE": _positive(_nse(lambda x: x)),
        "INF_CM": _positive(1 - F.try_divide(F.sum(_square(F.sqrt(O) - F.sqrt(M))), F.sum(_square(F.sqrt(O) - F.sqrt(F.col("o_mean")))))),
        "INF_NSSE": _positive(1 - F.try_divide(F.sum(_square(R)), _square(F.avg(O)))),
        "INF_IOA": _positive(1 - F.try_divide(F.sum(_square(R)), F.sum(_square(F.abs(M - F.col("o_mean")) + F.abs(O - F.col("o_mean")))))),
        "INF_MCE": _positive(1 - F.try_divide(F.abs(F.avg(M) - F.avg(O)), F.abs(F.avg(O)))),
        "INF_NAE": _positive(1 - F.try_divide(F.sum(F.abs(R)), F.sum(F.abs(O - F.col("o_mean"))))),
        "AIC": _information(2 * F.lit(P) + F.when(N / P <= 40, 2 * P * (P + 1) / (N - P - 1)).otherwise(0.0)),
        "BIC": _information(P * F.ln(N)),
        "LILC": _information(P * F.ln(F.ln(N))),
        "FPE": F.sum(_square(R)) / N * (1 + 2 * P / (N - P)),
    }


def prepared(pairs: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Pairs without nulls, with the series' mean, the pair before, and for the first the last residual.

    Windows run inside a series; series are spread over tasks. One series lies in one task: a century
    of days is 36,525 rows. Without ``by`` all pairs are one series.
    """
    by = by or []
    pairs = pairs.where("o is not null and m is not null")
    w = Window.partitionBy(*by).orderBy(order)
    last = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pairs.withColumns(
        {
            "o_mean": F.avg("o").over(Window.partitionBy(*by)),
            "o_before": F.lag("o").over(w),
            "m_before": F.lag("m").over(w),
            "r_before": F.coalesce(F.lag(_residual()).over(w), F.last(_residual()).over(last)),
        }
    )


def fit(pairs: DataFrame, order: str, names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The named metrics (all by default) of each series, from one aggregation."""
    by = by or []
    every = columns()
    chosen = [every[n].alias(n) for n in names or every]
    return prepared(pairs, order, by).groupBy(*by).agg(*chosen)


def sorted_pairs(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order statistics of both series, paired by rank."""
    by = by or []
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c))
    left = pairs.where("o is not null and m is not null").select(*by, "o", rank("o").alias("rank"))
    right = pairs.where("o is not null and m is not null").select(*by, "m", rank("m").alias("rank"))
    return left.join(right, [*by, "rank"])


def sorted_error(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MSSoE: mean squared difference of the order statistics."""
    return sorted_pairs(pairs, by).groupBy(*(by or [])).agg(F.avg(_square(_residual())).alias("MSSoE"))


def residual_autocorrelation(pairs: DataFrame, order: str, lag: int = 1, by: list[str] | None = None) -> DataFrame:
    """RFLAUT: correlation of the residuals with those ``lag`` steps later, around the common mean."""
    by = by or []
    w = Window.partitionBy(*by)
    rows = pairs.where("o is not null and m is not null").select(*by, order, _residual().alias("r")).withColumn("mean", F.avg("r").over(w))
    later = F.lead("r", lag).over(w.orderBy(order))
    return rows.withColumn("later", later).groupBy(*by).agg(F.try_divide(F.sum((F.col("r") - F.col("mean")) * (F.col("later") - F.col("mean"))), F.sum(_square(F.col("r") - F.col("mean")))).alias("RFLAUT"))


def duration_points(pairs: DataFrame, low: float, high: float, points: int = 30) -> DataFrame:
    """Exceedance values of both series at ``points`` equally spaced percentages from ``low`` to ``high``; of one series."""
    shares = [low + (high - low) * k / (points - 1) for k in range(points)]
    at = F.array(*[F.lit(1 - s) for s in shares])
    both = pairs.where("o is not null and m is not null").agg(F.percentile("o", at).alias("eo"), F.percentile("m", at).alias("em"))
    return both.select(F.explode(F.arrays_zip("eo", "em")).alias("e")).select("e.eo", "e.em")


def low_flow_error(pairs: DataFrame) -> DataFrame:
    """LowFDCE: squared log differences of the exceedance values from 30 to 100 per cent."""
    return duration_points(pairs, 0.3, 1.0).agg(F.sum(_square(F.ln("eo") - F.ln("em"))).alias("LowFDCE"))


def high_flow_error(pairs: DataFrame) -> DataFrame:
    """HighFDCE: squared differences of the exceedance values from 0 to 70 per cent."""
    return duration_points(pairs, 0.0, 0.7).agg(F.sum(_square(F.col("eo") - F.col("em"))).alias("HighFDCE"))


def weighted_fit(pairs: DataFrame, part: DataFrame, name: str, w1: float = 0.5, w2: float = 0.5) -> DataFrame:
    """w1 times the error relative to the variance plus w2 times a flow-duration term (a single row)."""
    base = pairs.where("o is not null and m is not null").agg((F.avg(_square(_residual())) / F.var_pop("o")).alias("base"))
    return base.crossJoin(F.broadcast(part)).select((w1 * F.col("base") + w2 * reduce(lambda a, b: a + b, [F.col(c) for c in part.columns])).alias(name))
