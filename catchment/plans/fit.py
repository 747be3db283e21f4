"""Goodness of fit of a simulated against an observed daily series, by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.operators import metrics
from catchment.plans.registry import Tables, query


def monthly_pairs(t: Tables) -> DataFrame:
    """month, o, m: monthly means of the observed and the simulated series where both exist."""
    observed = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.avg("o_totalprice").alias("o"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    simulated = t.lineitem.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(F.avg(net).alias("m"))
    return observed.join(simulated, "month")


PAIRS = """
WITH p AS (
  SELECT month, o, m FROM
    (SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS o FROM orders GROUP BY 1)
    JOIN (SELECT date_trunc('month', l_shipdate) AS month, avg(l_extendedprice * (1 - l_discount)) AS m FROM lineitem GROUP BY 1) USING (month)
), q AS (
  SELECT *, o - m AS r, lag(o) OVER (ORDER BY month) AS ob, lag(m) OVER (ORDER BY month) AS mb,
         coalesce(lag(o - m) OVER (ORDER BY month), last_value(o - m) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rb,
         avg(o) OVER () AS ma
  FROM p
)
"""

_NSE = "1 - sum(r * r) / sum((o - ma) * (o - ma))"
_TURNED = "1 - sum((f_o - f_m) * (f_o - f_m)) / sum((f_o - fa) * (f_o - fa))"
_BOX = "(pow({}, 0.25) - 1) / 0.25"
SQL = {
    "PDIFF": "max(o) - max(m)", "PEP": "100 * (1 - max(m) / max(o))", "ME": "sum(r) / count(*)", "MAE": "sum(abs(r)) / count(*)", "MSE": "sum(r * r) / count(*)",
    "MSLE": "avg(ln(o / m) * ln(o / m))", "AME": "max(abs(r))", "MSDE": "avg((o - ob - m + mb) * (o - ob - m + mb))", "RMSE": "sqrt(sum(r * r) / count(*))",
    "RRMSE": "sqrt(avg(r * r)) / avg(o)", "RMSE_log": "sqrt(avg(ln(o / m) * ln(o / m)))", "RMSE_boxcox": "sqrt(avg(pow(4 * pow(o, 0.25) - 4 * pow(m, 0.25), 2)))",
    "R4MS4E": "sqrt(sqrt(avg(r * r * r * r)))", "SSE": "sum(r * r)", "NSC": "CAST(count(*) FILTER (WHERE (r < 0) <> (rb < 0)) AS BIGINT)", "MRE": "avg(1 - m / o)",
    "MPE": "100 * avg(1 - m / o)", "MARE": "avg(abs(r) / o)", "SARE": "sum(abs(r) / o)", "MeAPE": "median(100 * abs(r) / o)", "MSRE": "avg(pow(1 - m / o, 2))",
    "MAPE": "100 * avg(abs(r) / abs(m))", "PBIAS": "100 * (1 - sum(m) / sum(o))", "APBIAS": "100 * sum(abs(r)) / sum(o)", "APB": "100 * sum(abs(r)) / sum(o)", "BIAS": "avg(o) - avg(m)",
    "RVE": "1 - sum(m) / sum(o)", "RMAE": "sum(abs(r)) / sum(o)", "ThInC": "pow(sum(abs(r)) / sum(o), 2)", "TMC": "100 * abs(sum(o) / sum(m) - 1)",
    "CrBal": "1 - abs(sqrt(sum(m) / sum(o)) - sqrt(sum(o) / sum(m)))", "NSE": _NSE, "RAE": "sum(abs(r)) / sum(abs(o - ma))",
    "RSR": "sqrt(sum(r * r) / sum((o - ma) * (o - ma)))", "IA": _NSE, "PI": "1 - sum(r * r) FILTER (WHERE ob IS NOT NULL) / sum((o - ob) * (o - ob))", "RCOEF": "corr(o, m)",
    "SFDCE": "abs(quantile_cont(m, 0.7) - quantile_cont(m, 0.3) - quantile_cont(o, 0.7) + quantile_cont(o, 0.3)) / 40",
    "NSE_BIAS": f"{_NSE} - 5 * pow(ln(1 + abs(avg(r))), 2.5)", "INF_NSE": f"greatest({_NSE}, 0)",
    "INF_CM": "greatest(1 - sum(pow(sqrt(o) - sqrt(m), 2)) / sum(pow(sqrt(o) - sqrt(ma), 2)), 0)", "INF_NSSE": "greatest(1 - sum(r * r) / pow(avg(o), 2), 0)",
    "INF_IOA": "greatest(1 - sum(r * r) / sum(pow(abs(m - ma) + abs(o - ma), 2)), 0)", "INF_MCE": "greatest(1 - abs(avg(m) / avg(o) - 1), 0)", "INF_NAE": "greatest(1 - sum(abs(r)) / sum(abs(o - ma)), 0)",
    "AIC": "count(*) * ln(avg(r * r)) + 6 + CASE WHEN count(*) / 3.0 <= 40 THEN 24.0 / (count(*) - 4) ELSE 0 END", "BIC": "count(*) * ln(avg(r * r)) + 3 * ln(count(*))",
    "LILC": "count(*) * ln(avg(r * r)) + 3 * ln(ln(count(*)))", "FPE": "avg(r * r) * (1 + 6.0 / (count(*) - 3))",
}
_FORMS = {"NSE_sqrt": "sqrt({})", "NSE_log": "ln({})", "NSE_boxcox": _BOX}
#: Numbers of the metrics in their order in the survey; the gaps have queries of their own below.
_ORDER = "PDIFF PEP ME MAE MSE MSLE AME - MSDE RMSE RRMSE RMSE_log RMSE_boxcox R4MS4E SSE NSC MRE MPE MARE SARE MeAPE MSRE MAPE PBIAS APBIAS APB BIAS RVE RMAE ThInC TMC CrBal NSE NSE_sqrt NSE_log NSE_boxcox RAE RSR IA PI RCOEF - SFDCE - - NSE_BIAS - - INF_NSE INF_CM INF_NSSE INF_IOA INF_MCE INF_NAE AIC BIC LILC FPE".split()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias("value") for c in df.columns])


def _register(number: int, name: str) -> None:
    sql = f"{PAIRS} SELECT round(CAST({SQL.get(name)} AS DOUBLE), 6) AS value FROM q"
    if name in _FORMS:
        fo, fm = _FORMS[name].format("o"), _FORMS[name].format("m")
        sql = f"{PAIRS} SELECT round({_TURNED}, 6) AS value FROM (SELECT *, avg(f_o) OVER () AS fa FROM (SELECT {fo} AS f_o, {fm} AS f_m FROM q))"
    query(f"ev_{number}", sql)(lambda t, name=name: _rounded(metrics.fit(monthly_pairs(t), "month", [name])))


for _k, _name in enumerate(_ORDER, 1):
    if _name != "-":
        _register(_k, _name)

query("ev_8", f"{PAIRS} SELECT round(avg(pow(a.m - b.o, 2)), 6) AS value FROM (SELECT m, row_number() OVER (ORDER BY m) AS k FROM p) a JOIN (SELECT o, row_number() OVER (ORDER BY o) AS k FROM p) b USING (k)")(
    lambda t: _rounded(metrics.sorted_error(monthly_pairs(t)))
)
query("ev_42", f"{PAIRS} SELECT round(sum((r - a) * (n - a)) / sum((r - a) * (r - a)), 6) AS value FROM (SELECT r, avg(r) OVER () AS a, lead(r) OVER (ORDER BY month) AS n FROM q)")(
    lambda t: _rounded(metrics.residual_autocorrelation(monthly_pairs(t), "month"))
)
_AT = lambda low, span: ", ".join(f"{1 - (low + span * k / 29)!r}" for k in range(30))
_LOW = f"(SELECT unnest(quantile_cont(o, [{_AT(0.3, 0.7)}])) AS eo, unnest(quantile_cont(m, [{_AT(0.3, 0.7)}])) AS em FROM p)"
_HIGH = f"(SELECT unnest(quantile_cont(o, [{_AT(0.0, 0.7)}])) AS eo, unnest(quantile_cont(m, [{_AT(0.0, 0.7)}])) AS em FROM p)"
query("ev_44", f"{PAIRS} SELECT round(sum(pow(ln(eo) - ln(em), 2)), 6) AS value FROM {_LOW}")(lambda t: _rounded(metrics.low_flow_error(monthly_pairs(t))))
query("ev_45", f"{PAIRS} SELECT round(sum(pow(eo - em, 2)), 6) AS value FROM {_HIGH}")(lambda t: _rounded(metrics.high_flow_error(monthly_pairs(t))))
query("ev_47", f"{PAIRS} SELECT round(0.5 * (SELECT avg(r * r) / var_pop(o) FROM q) + 0.5 * (SELECT sum(pow(ln(eo) - ln(em), 2)) FROM {_LOW}), 6) AS value")(
    lambda t: _rounded(metrics.weighted_fit(monthly_pairs(t), metrics.low_flow_error(monthly_pairs(t)), "value"))
)
query("ev_48", f"{PAIRS} SELECT round(0.5 * (SELECT avg(r * r) / var_pop(o) FROM q) + 0.5 * (SELECT sum(pow(eo - em, 2)) FROM {_HIGH}), 6) AS value")(
    lambda t: _rounded(metrics.weighted_fit(monthly_pairs(t), metrics.high_flow_error(monthly_pairs(t)), "value"))
)


@query("ev_59", f"{PAIRS} SELECT round(1 - sum(r * r) / (var_pop(o) * count(*)), 6) AS nse, round(1 - sum(r * r) / (var_pop(m) * count(*)), 6) AS nse_swapped FROM q")
def calibration_score(t: Tables) -> DataFrame:
    """Monthly efficiency, and the same with the roles swapped as calibration files have it."""
    straight = metrics.fit(monthly_pairs(t), "month", ["NSE"])
    swapped = monthly_pairs(t).select("month", F.col("m").alias("o"), F.col("o").alias("m"))
    return straight.crossJoin(F.broadcast(metrics.fit(swapped, "month", ["NSE"]).withColumnRenamed("NSE", "s"))).select(F.round("NSE", 6).alias("nse"), F.round("s", 6).alias("nse_swapped"))


FIT_SQL = f"{PAIRS} SELECT CAST(count(*) AS BIGINT) AS n, round({_NSE}, 6) AS nse, round(corr(o, m), 6) AS r, round(100 * sum(r) / sum(o), 6) AS pbias FROM q"


@query("fit_monthly", FIT_SQL)
def fit_monthly(t: Tables) -> DataFrame:
    """Count of months, Nash-Sutcliffe efficiency, Pearson correlation and percent bias."""
    pairs = monthly_pairs(t)
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(1 - F.sum(F.pow(F.col("o") - F.col("m"), 2)) / (F.var_pop("o") * F.count("*")), 6).alias("nse"),
        F.round(F.corr("o", "m"), 6).alias("r"),
        F.round(100 * F.sum(F.col("o") - F.col("m")) / F.sum("o"), 6).alias("pbias"),
    )


def monthly_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_monthly(Tables(spark, sf_dir))
