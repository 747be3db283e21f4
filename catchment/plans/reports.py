"""Reports and rule checks over yearly summaries; orders stand for inflow, line items for outflow."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.operators import checks, model_rules
from catchment.operators.iterate import cut
from catchment.plans.registry import query


def c(name):
    return F.col(name)


query("rp_1", "SELECT (SELECT CAST(count(*) AS BIGINT) FROM part) AS channels, (SELECT CAST(count(*) AS BIGINT) FROM supplier) AS units, (SELECT round(sum(p_size), 2) FROM part) AS area")(
    lambda t: t.part.agg(F.count("*").alias("channels"), F.round(F.sum("p_size").cast("double"), 2).alias("area")).crossJoin(F.broadcast(t.supplier.agg(F.count("*").alias("units"))))
)
query("rp_11", "SELECT round(max(q), 4) AS most, round(avg(q), 4) AS mean FROM (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).agg(F.round(F.max("q"), 4).alias("most"), F.round(F.avg("q"), 4).alias("mean")))
query("rp_14", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 42")(
    lambda t: t.customer.where("c_custkey = 42").join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")
)
query("rp_15", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 100)")(lambda t: t.orders.join(t.customer.where("c_custkey < 100"), c("o_custkey") == c("c_custkey"), "left_anti").select("o_orderkey"))
query("rp_16", "SELECT s_suppkey, CASE WHEN s_suppkey IN (1, 5, 9) THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier")(lambda t: t.supplier.select("s_suppkey", F.when(c("s_suppkey").isin(1, 5, 9), 99).otherwise(c("s_nationkey")).alias("s_nationkey")))
query("rp_19", "SELECT DISTINCT lower(p_type) || '_lum' AS name FROM part")(lambda t: t.part.select(F.concat(F.lower("p_type"), F.lit("_lum")).alias("name")).distinct())
query("rp_20", "SELECT CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS k, s_suppkey FROM supplier")(lambda t: t.supplier.select(F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("k"), "s_suppkey"))
query("rp_21", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier")(lambda t: t.supplier.select("s_suppkey", F.round(F.try_divide(c("s_acctbal"), F.sum("s_acctbal").over(Window.partitionBy("s_nationkey"))), 8).alias("share")))
query("rp_27", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")(lambda t: t.nation.join(t.supplier.where("s_acctbal < 0"), c("n_nationkey") == c("s_nationkey"), "left_semi").select("n_nationkey"))
query(
    "rp_18",
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey
       || coalesce(',"suppliers":[' || (SELECT string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) || ']', '') || '}' AS document FROM nation""",
)(lambda t: checks.nested(t.nation, t.supplier.select("s_nationkey", "s_suppkey", "s_name"), "n_nationkey", "s_nationkey", "suppliers"))


def totals(t):
    """The tables with the sums of line items by supplier, year and flag in place of line items: one scan for all sections that add up."""
    sums = t.lineitem.groupBy("l_suppkey", F.date_trunc("year", "l_shipdate").alias("l_shipdate"), "l_returnflag").agg(*[F.sum(x).alias(x) for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return SimpleNamespace(lineitem=cut(sums), supplier=t.supplier, customer=t.customer, orders=t.orders)


def balances(t):
    """A balance row for each nation from its suppliers' line items, scaled to plausible figures."""
    rows = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).groupBy("s_nationkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"), F.avg(F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0.0)).alias("r")
    )
    scale = {"precip": 40 * c("q"), "surq": 9 * c("r"), "latq": 1000 * c("d"), "flo": 2000 * c("x"), "et": 41 * c("q"), "cn": 3 * c("q"), "denit": 10 * c("x"), "fertn": c("q"), "fertp": c("r"), "nplt": 9 * c("r") / 7, "pplnt": c("r") / 2.0,
             "sedorgn": c("r") * 4, "surqno3": c("d") * 100, "lat3no3": c("x"), "sedorgp": c("q") / 2, "surqsolp": c("x") * 30, "strsp": c("q") * 2.4, "strsn": c("x") * 25, "strsw": c("q") * 3, "yld": c("d") * 10, "bioms": c("x") * 25}
    return rows.select("s_nationkey", *[v.cast("double").alias(k) for k, v in scale.items()])


_BALANCES = """b AS (SELECT s_nationkey, 40 * q AS precip, 9 * r AS surq, 1000 * d AS latq, 2000 * x AS flo, 41 * q AS et, 3 * q AS cn, 10 * x AS denit, q AS fertn, r AS fertp, 9 * r / 7 AS nplt, r / 2.0 AS pplnt,
r * 4 AS sedorgn, d * 100 AS surqno3, x AS lat3no3, q / 2 AS sedorgp, x * 30 AS surqsolp, x * 25 AS strsn, q * 2.4 AS strsp, q * 3 AS strsw, d * 10 AS yld, x * 25 AS bioms
FROM (SELECT s_nationkey, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)),
m AS (SELECT *, surq + latq + flo AS total, 0.26 * precip AS e, sedorgn + surqno3 + lat3no3 AS loss_n FROM b)"""


def _messages(tests, rules, prefix=""):
    """The messages of ``rules`` where their tests, written out in SQL, hold."""
    quoted = [r[3].replace("'", "''") for r in rules]
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {test} THEN {prefix}'{message}' END" for test, message in zip(tests, quoted, strict=True)) + ")"


_HYDROLOGY = ["precip < 65", "precip > 3400", "surq > 0.78 * total", "surq < 0.31 * total", "flo > 0.69 * total", "flo < 0.22 * total", "latq > flo", "et > precip", "total > 1.5 * e", "total < 0.5 * e", "surq / ((0.0129 * cn - 0.2857) * e) > 1.5", "surq / ((0.0129 * cn - 0.2857) * e) < 0.5"]
_NITROGEN = ["denit = 0", "denit <> 0 AND denit / fertn < 0.01", "denit <> 0 AND denit / fertn > 0.4", "nplt / fertn < 0.5"]
_PHOSPHORUS = ["pplnt / nullif(fertp, 0) < 0.5"]
_PLANTS = ["strsp > 60", "strsn > 60", "strsw > 80", "strsp < 1", "strsn < 1", "yld < 0.5", "bioms < 1"]
_LANDSCAPE = ["loss_n > 0.4 * fertn", "loss_n < 0.1 * fertn", "surqno3 > 4.7", "surqno3 < 0.15", "sedorgn > 33", "sedorgn < 0.3", "surqsolp > 1.2", "surqsolp < 0.025", "sedorgp > 14", "sedorgp < 0",
              "surqno3 / (sedorgn + surqno3) > 0.85", "surqno3 / (sedorgn + surqno3) < 0.1", "surqsolp / (sedorgp + surqsolp) > 0.95", "surqsolp / (sedorgp + surqsolp) < 0.13"]
_SECTIONS = {"hydrology": (_HYDROLOGY, model_rules.HYDROLOGY), "nitrogen": (_NITROGEN, model_rules.NITROGEN), "phosphorus": (_PHOSPHORUS, model_rules.PHOSPHORUS), "plants": (_PLANTS, model_rules.PLANTS), "landscape": (_LANDSCAPE, model_rules.LANDSCAPE)}


def _section(name, section, *measured):
    """One section's messages, with its measures."""
    extra = "".join(f", round({sql}, 6) AS {x}" for x, sql in measured)
    query(name, f"WITH {_BALANCES} SELECT s_nationkey{extra}, {_messages(*_SECTIONS[section])} AS {section} FROM m")(
        lambda t: model_rules.report(balances(t)).select("s_nationkey", *[F.round(x, 6).alias(x) for x, _ in measured], F.array_join(section, "; ").alias(section))
    )


_section("rp_2", "hydrology", ("surface_share", "surq / total"), ("ground_share", "flo / total"), ("yield_over_expected", "total / e"))
_section("rp_2_balance", "hydrology")
_section("rp_3", "nitrogen", ("denit_over_applied", "CASE WHEN denit <> 0 THEN denit / fertn END"), ("uptake_over_applied_n", "nplt / fertn"))
_section("rp_4", "phosphorus", ("uptake_over_applied_p", "pplnt / nullif(fertp, 0)"))
_section("rp_5", "plants", ("strsp", "strsp"), ("strsn", "strsn"), ("strsw", "strsw"))
_section("rp_5_balance", "plants")
_section("rp_6", "landscape", ("loss_n", "loss_n"), ("soluble_share_n", "surqno3 / (sedorgn + surqno3)"), ("soluble_share_p", "surqsolp / (sedorgp + surqsolp)"))


def units(t):
    """Land units: line items with their part's brand as land use."""
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        F.concat("p_brand", F.lit(" ")).alias("landuse"), (c("l_quantity") / 1000).alias("area"), (c("l_quantity") * 4).alias("cn"), (c("l_tax") * 100).alias("irr"), (c("l_extendedprice") / 30).alias("prec"), (c("l_discount") * 4000).alias("surq"),
        (c("l_extendedprice") / 40).alias("et"), c("l_tax").alias("sed"), (c("l_tax") * 2010).alias("no3"), c("l_discount").alias("orgn"), (c("l_extendedprice") * 2).alias("biom"), c("l_quantity").alias("yld"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("name"),
    )


_UNITS = """u AS (SELECT p_brand AS landuse, l_quantity / 1000 AS area, l_quantity * 4 AS cn, l_tax * 100 AS irr, l_extendedprice / 30 AS prec, l_discount * 4000 AS surq, l_extendedprice / 40 AS et, l_tax AS sed, l_tax * 2010 AS no3,
l_discount AS orgn, l_extendedprice * 2 AS biom, l_quantity AS yld, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_MEANS = "l AS (SELECT landuse, sum(area) AS area, " + ", ".join(f"sum({x} * area) / sum(area){' / 1000' if x in ('biom', 'yld') else ''} AS {x}" for x in ("cn", "irr", "prec", "surq", "et", "sed", "no3", "orgn", "biom", "yld")) + " FROM u GROUP BY 1)"
_LAND_USE = ["cn > 95", "cn < 35", "et / prec < 0.31", "et / (prec + irr) > 0.98", "surq / prec > 0.5", "surq / prec < 0.01", "surq / ((0.0129 * cn - 0.2857) * 0.26 * prec) > 1.5", "surq / ((0.0129 * cn - 0.2857) * 0.26 * prec) < 0.5", "no3 > 80", "biom > 50", "biom < 1", "area < 0.05", "prec > 3400", "prec < 65"]
_LAND_MESSAGES = [(*r[:3], r[3].replace("{}", "' || printf('%.2f', " + r[0] + ") || '")) for r in model_rules.LAND_USE]
_PARTS = ", ".join(f"CASE WHEN {test} THEN landuse || ' {message[3]}' END" for test, message in zip(_LAND_USE, _LAND_MESSAGES, strict=True))
query("rp_7", f"WITH {_UNITS}, {_MEANS} SELECT landuse, round(area, 6) AS area, round(cn, 6) AS cn, round(et, 6) AS et, round(biom, 6) AS biom, round(yld, 6) AS yld, concat_ws('; ', {_PARTS}) AS warnings FROM l")(
    lambda t: model_rules.land_use(units(t)).select("landuse", *[F.round(x, 6).alias(x) for x in ("area", "cn", "et", "biom", "yld")], F.array_join("warnings", "; ").alias("warnings"))
)
query("rp_7_units", f"WITH {_UNITS} SELECT name, CASE WHEN cn > 98 THEN 'Curve number may be too high (>98)' ELSE 'Curve number may be too low (<35)' END AS warning FROM u WHERE cn > 98 OR cn < 35")(lambda t: model_rules.unit_curve_numbers(units(t)))


def loads(t):
    """Of each nation: the loads of the customer with the greatest orders as channel, and of all its suppliers' line items as point sources."""
    channel = t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.sum("o_totalprice").alias("flow"), F.count("*").alias("k"))
    channel = channel.groupBy("c_nationkey").agg(F.max_by(F.struct("flow", "k"), F.struct(c("k"), -c("c_custkey"))).alias("m")).select("c_nationkey", (c("m.flow") / 365).alias("sub_flow"), (c("m.k") * 30.0).alias("sub_sed"), (c("m.k") * 20.0).alias("sub_n"), (c("m.k") * 4.0).alias("sub_p"))
    points = t.supplier.join(t.lineitem, c("s_suppkey") == c("l_suppkey")).groupBy("s_nationkey").agg(
        (F.sum(F.when(c("s_nationkey") % 3 != 0, c("l_quantity")).otherwise(0.0)) / 365).alias("ps_flow"), F.sum(F.when(c("s_nationkey") % 5 != 0, c("l_tax")).otherwise(0.0)).alias("ps_sed"),
        (F.sum("l_discount") * 2).alias("ps_n"), F.sum(F.when(c("s_nationkey") % 7 != 0, c("l_tax")).otherwise(0.0)).alias("ps_p"),
    )
    return channel.join(points, c("c_nationkey") == c("s_nationkey")).drop("c_nationkey")


_LOADS = """k AS (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS flow, count(*) AS k FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2), h AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY k DESC, c_custkey) = 1),
g AS (SELECT s_nationkey, sum(CASE WHEN s_nationkey % 3 <> 0 THEN l_quantity ELSE 0 END) / 365 AS ps_flow, sum(CASE WHEN s_nationkey % 5 <> 0 THEN l_tax ELSE 0 END) AS ps_sed, sum(l_discount) * 2 AS ps_n, sum(CASE WHEN s_nationkey % 7 <> 0 THEN l_tax ELSE 0 END) AS ps_p
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1), w AS (SELECT g.*, flow / 365 AS sub_flow, k * 30.0 AS sub_sed, k * 20.0 AS sub_n, k * 4.0 AS sub_p FROM h JOIN g ON c_nationkey = s_nationkey),
z AS (SELECT *, """ + ", ".join(f"CASE WHEN sub_{x} = 0 THEN 0 ELSE ps_{x} / (ps_{x} + sub_{x}) * 100 END AS from_{x}" for x in ("flow", "sed", "n", "p")) + " FROM w)"
_POINTS = ["from_flow > 30", "from_p > 55", "from_n > 20", "from_sed > 30", "ps_flow = 0 AND ps_sed > 0", "ps_flow = 0 AND ps_p > 0", "ps_flow = 0 AND ps_n > 0", "ps_flow > 0 AND ps_sed = 0", "ps_flow > 0 AND ps_p = 0", "ps_flow > 0 AND ps_n = 0",
           "ps_flow = 0 AND ps_n = 0 AND ps_p = 0 AND ps_sed = 0", "ps_p > 0 AND ps_n / ps_p > 8.8", "ps_p > 0 AND ps_n / ps_p < 2.8"]
query("rp_8", f"WITH {_LOADS} SELECT s_nationkey, round(from_flow, 6) AS from_flow, round(from_n, 6) AS from_n, round(from_p, 6) AS from_p, round(from_sed, 6) AS from_sed, {_messages(_POINTS, model_rules.POINT_SOURCES)} AS warnings FROM z")(
    lambda t: model_rules.point_sources(loads(t)).select("s_nationkey", *[F.round(f"from_{x}", 6).alias(f"from_{x}") for x in ("flow", "n", "p", "sed")], F.array_join("warnings", "; ").alias("warnings"))
)


def stores(t):
    """Reservoirs: suppliers, with the sums of their line items over all years, and by year."""
    rows = t.lineitem.groupBy(c("l_suppkey").alias("name")).agg(
        F.sum("l_quantity").alias("sed_in"), F.sum(F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0.0)).alias("sed_out"), F.sum("l_extendedprice").alias("n_in"), (F.sum("l_extendedprice") * (c("l_suppkey") % 10) / 10).alias("n_out"),
        F.sum("l_tax").alias("p_in"), (F.sum("l_tax") * (c("l_suppkey") % 7) / 6).alias("p_out"), F.sum("l_quantity").alias("stor"), (F.sum("l_tax") * (c("l_suppkey") % 4)).alias("seep"), (F.sum("l_discount") * (c("l_suppkey") % 30) * 10).alias("evap"),
    )
    return rows, t.lineitem.groupBy(c("l_suppkey").alias("name"), F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("stor"))


_STORES = """a AS (SELECT l_suppkey AS name, sum(l_quantity) AS sed_in, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS sed_out, sum(l_extendedprice) AS n_in, sum(l_extendedprice) * (l_suppkey % 10) / 10 AS n_out,
sum(l_tax) AS p_in, sum(l_tax) * (l_suppkey % 7) / 6 AS p_out, sum(l_quantity) AS stor, sum(l_tax) * (l_suppkey % 4) AS seep, sum(l_discount) * (l_suppkey % 30) * 10 AS evap FROM lineitem GROUP BY l_suppkey),
y AS (SELECT l_suppkey AS name, year(l_shipdate) AS yr, sum(l_quantity) AS stor FROM lineitem GROUP BY 1, 2),
v AS (SELECT name, coalesce(max(stor) FILTER (WHERE yr = hi) / nullif(max(stor) FILTER (WHERE yr = lo), 0), 0) AS volume_ratio, count(*) FILTER (WHERE stor < 1) / max(n) AS fraction_empty FROM y, (SELECT min(yr) AS lo, max(yr) AS hi, count(DISTINCT yr) AS n FROM y) GROUP BY 1),
r AS (SELECT name, CASE WHEN sed_in = 0 THEN 0 ELSE (sed_in - sed_out) / sed_in * 100 END AS sediment, CASE WHEN n_in = 0 THEN 0 ELSE (n_in - n_out) / n_in * 100 END AS nitrogen, CASE WHEN p_in = 0 THEN 0 ELSE (p_in - p_out) / p_in * 100 END AS phosphorus,
coalesce(seep / nullif(stor, 0) * 100, 0) AS seepage, coalesce(evap / nullif(stor, 0) * 100, 0) AS evaporation, volume_ratio, fraction_empty FROM a JOIN v USING (name))"""
_RESERVOIR = ["sediment < 40", "sediment > 98", "nitrogen < 7", "nitrogen > 72", "phosphorus < 18", "phosphorus > 82", "evaporation < 5", "evaporation > 50", "seepage > 25"]
query("rp_9", f"WITH {_STORES} SELECT name, round(sediment, 6) AS sediment, round(nitrogen, 6) AS nitrogen, round(phosphorus, 6) AS phosphorus, round(seepage, 6) AS seepage, round(evaporation, 6) AS evaporation, round(volume_ratio, 8) AS volume_ratio, fraction_empty, {_messages(_RESERVOIR, model_rules.RESERVOIR)} AS warnings FROM r")(
    lambda t: model_rules.reservoirs(*stores(t))[0].select("name", *[F.round(x, 6).alias(x) for x in ("sediment", "nitrogen", "phosphorus", "seepage", "evaporation")], F.round("volume_ratio", 8).alias("volume_ratio"), "fraction_empty", F.array_join("warnings", "; ").alias("warnings"))
)
_TREND = _messages([f"bool_or({x})" for x in _RESERVOIR] + ["max(fraction_empty) > 0", "max(volume_ratio) > 5", "min(volume_ratio) > 0.2"], model_rules.RESERVOIR + model_rules.RESERVOIR_TREND)
query("rp_9_all", f"WITH {_STORES} SELECT CAST(count(*) AS BIGINT) AS n, max(fraction_empty) AS empty, round(max(volume_ratio), 8) AS most, round(min(volume_ratio), 8) AS least, {_TREND} AS warnings FROM r")(
    lambda t: model_rules.reservoirs(*stores(t))[1].select("n", "empty", F.round("most", 8).alias("most"), F.round("least", 8).alias("least"), F.array_join("warnings", "; ").alias("warnings"))
)


def channels(t):
    """Channels by nation: what the line items of its suppliers bring in, and what the returned ones leave."""
    out = F.when(c("l_returnflag") == "R", 3.0).when(c("l_returnflag") == "A", 0.2).otherwise(0.0)
    rows = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).groupBy(c("s_nationkey").alias("name")).agg(
        F.sum("l_quantity").alias("sed_in"), F.sum(c("l_quantity") * out).alias("sed_out"), F.sum("l_extendedprice").alias("n_in"), F.sum(c("l_extendedprice") * out).alias("n_out"), F.sum("l_tax").alias("p_in"), F.sum(c("l_tax") * out * (c("s_nationkey") % 3)).alias("p_out"),
        (F.sum("l_quantity") * (c("s_nationkey") % 4) / 10).alias("upland_sed"), (F.sum("l_extendedprice") * 1.5).alias("load_n"), F.sum("l_tax").alias("load_p"), F.sum("l_quantity").alias("yield"), F.sum("l_tax").alias("tloss"), F.sum("l_discount").alias("tevap"),
    )
    return rows


_CHANNELS = """o AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 3.0 WHEN 'A' THEN 0.2 ELSE 0 END AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
q AS (SELECT s_nationkey AS name, sum(l_quantity) AS sed_in, sum(l_quantity * f) AS sed_out, sum(l_extendedprice) AS n_in, sum(l_extendedprice * f) AS n_out, sum(l_tax) AS p_in, sum(l_tax * f * (s_nationkey % 3)) AS p_out,
sum(l_quantity) * (s_nationkey % 4) / 10 AS up, sum(l_extendedprice) * 1.5 AS load_n, sum(l_tax) AS load_p, sum(l_quantity) AS water, sum(l_tax) AS tloss, sum(l_discount) AS tevap FROM o GROUP BY s_nationkey),
i AS (SELECT *, CASE WHEN up > 0 AND sed_out > sed_in THEN (sed_out - sed_in) / (up + sed_out - sed_in) * 100 ELSE 0 END AS erosion, CASE WHEN up > 0 AND sed_out <= sed_in THEN (sed_in - sed_out) / up * 100 ELSE 0 END AS deposition,
(n_out - n_in) / load_n * 100 AS change_n, (p_out - p_in) / load_p * 100 AS change_p, (tloss + tevap) / water * 100 AS stream_loss FROM q)"""
_INSTREAM = ["erosion > 50", "deposition > 95", "erosion = 0 AND deposition = 0", "(erosion <> 0 OR deposition <> 0) AND (abs(erosion) < 2 OR abs(deposition) < 2)", "change_n < -50", "change_n > 10", "change_p < -50", "change_p > 10"]
query("rp_10", f"WITH {_CHANNELS} SELECT name, round(erosion, 6) AS erosion, round(deposition, 6) AS deposition, round(change_n, 6) AS change_n, round(change_p, 6) AS change_p, round(stream_loss, 6) AS stream_loss, {_messages(_INSTREAM, model_rules.INSTREAM)} AS warnings FROM i")(
    lambda t: model_rules.instream(channels(t)).select("name", *[F.round(x, 6).alias(x) for x in ("erosion", "deposition", "change_n", "change_p", "stream_loss")], F.array_join("warnings", "; ").alias("warnings"))
)
query("rp_10_reaches", f"WITH {_CHANNELS} SELECT name, round(sed_out / sed_in * 100, 6) AS sediment, round(n_out / n_in * 100, 6) AS nitrogen, round(p_out / p_in * 100, 6) AS phosphorus FROM q")(
    lambda t: model_rules.reaches(channels(t)).select("name", *[F.round(x, 6).alias(x) for x in ("sediment", "nitrogen", "phosphorus")])
)


def bundle(t):
    """section, key, warnings: all sections that have something to tell, of all scenarios.

    Line items are read three times: for means, for land use, and for the sums that the other sections go by.
    """
    small = totals(t)
    sections = F.explode(F.array(*[F.struct(F.lit(x).alias("section"), c(x).alias("warnings")) for x in _SECTIONS]))
    parts = [model_rules.report(balances(t)).select("s_nationkey", sections.alias("s")).select("s.section", c("s_nationkey").cast("string").alias("key"), "s.warnings")]
    parts.append(model_rules.land_use(units(t)).select(F.lit("landuse").alias("section"), c("landuse").alias("key"), "warnings"))
    parts.append(model_rules.point_sources(loads(small)).select(F.lit("points").alias("section"), c("s_nationkey").cast("string").alias("key"), "warnings"))
    parts.append(model_rules.reservoirs(*stores(small))[1].select(F.lit("reservoirs").alias("section"), F.lit("all").alias("key"), "warnings"))
    parts.append(model_rules.instream(channels(small)).select(F.lit("instream").alias("section"), c("name").cast("string").alias("key"), "warnings"))
    return reduce(lambda a, b: a.unionByName(b), parts).where(F.size("warnings") > 0).withColumn("warnings", F.array_join("warnings", "; "))


_BUNDLE = " UNION ALL ".join(
    [f"SELECT '{x}' AS section, CAST(s_nationkey AS VARCHAR) AS key, {_messages(*y)} AS warnings FROM m" for x, y in _SECTIONS.items()]
    + [f"SELECT 'landuse', landuse, concat_ws('; ', {_PARTS}) FROM l", f"SELECT 'points', CAST(s_nationkey AS VARCHAR), {_messages(_POINTS, model_rules.POINT_SOURCES)} FROM z", f"SELECT 'reservoirs', 'all', {_TREND} FROM r", f"SELECT 'instream', CAST(name AS VARCHAR), {_messages(_INSTREAM, model_rules.INSTREAM)} FROM i"]
)
query("rp_12", f"WITH {_BALANCES}, {_UNITS}, {_MEANS}, {_LOADS}, {_STORES}, {_CHANNELS} SELECT * FROM ({_BUNDLE}) WHERE warnings <> ''")(bundle)
