"""Checks of a model's average annual balances: derived ratios, thresholds and messages.

Balances come as one row per scenario with the columns named below; missing ratios (nothing to
divide by) break no rule. The thresholds decide; some messages name other numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.operators.checks import TESTS, expected_runoff, in_out_percent, ratio, warn

# Fixed values: (measure, comparison, threshold, message), in the order of the report.
HYDROLOGY = [
    ("precip", "<", 65, "Precipitation too small. (< 65mm)"),
    ("precip", ">", 3400, "Precipitation may be too high. (> 3400 mm)"),
    ("surface_share", ">", 0.78, "Surface runoff ratio may be high (> 0.8)"),
    ("surface_share", "<", 0.31, "Surface runoff ratio may be low (< 0.2)"),
    ("ground_share", ">", 0.69, "Groundwater ratio may be high"),
    ("ground_share", "<", 0.22, "Groundwater ratio may be low"),
    ("latq - flo", ">", 0, "Lateral flow is greater than groundwater flow; may indicate a problem"),
    ("et - precip", ">", 0, "ET Greater than precipitation; may indicate a problem unless irrigated"),
    ("yield_over_expected", ">", 1.5, "Water yield may be excessive"),
    ("yield_over_expected", "<", 0.5, "Water yield may be too low"),
    ("runoff_over_expected", ">", 1.5, "Surface runoff may be excessive"),
    ("runoff_over_expected", "<", 0.5, "Surface runoff may be too low"),
]
NITROGEN = [
    ("denit", "=", 0, "Denitrification is zero, consider decreasing SDNCO: (Denitrification threshold water content)"),
    ("denit_over_applied", "<", 0.01, "Denitrification is less than 2% of the applied fertilizer amount"),
    ("denit_over_applied", ">", 0.4, "Denitrification is greater than 25% of the applied fertilizer amount"),
    ("uptake_over_applied_n", "<", 0.5, "Crop is consuming less than half the amount of applied nitrogen"),
]
PHOSPHORUS = [("uptake_over_applied_p", "<", 0.5, "Crop is consuming less than half the amount of applied phosphorus")]
PLANTS = [
    ("strsp", ">", 60, "More than 100 days of phosphorus stress"),
    ("strsn", ">", 60, "More than 100 days of nitrogen stress"),
    ("strsw", ">", 80, "More than 100 days of water stress"),
    ("strsp", "<", 1, "Unusually low phosphorus stress"),
    ("strsn", "<", 1, "Unusually low nitrogen stress"),
    ("yld", "<", 0.5, "Yield may be low if there is harvested crop"),
    ("bioms", "<", 1, "Biomass averages less than 1 metric ton per hectare"),
]
LANDSCAPE = [
    ("loss_n - 0.4 * fertn", ">", 0, "Total nitrogen losses are greater than 40% of applied N"),
    ("loss_n - 0.1 * fertn", "<", 0, "Total nitrogen losses are less than 8% of applied N, may be incorrect in agricultural areas. Likely fine in unmanaged areas or forest dominated watersheds."),
    ("surqno3", ">", 4.7, "Nitrate losses in surface runoff may be high"),
    ("surqno3", "<", 0.15, "Nitrate losses in surface runoff may be low"),
    ("sedorgn", ">", 33, "Organic/Particulate nitrogen losses in surface runoff may be high"),
    ("sedorgn", "<", 0.3, "Organic/Particulate nitrogen losses in surface runoff may be low"),
    ("surqsolp", ">", 1.2, "Soluble phosphorus losses in surface runoff may be high"),
    ("surqsolp", "<", 0.025, "Soluble phosphorus losses in surface runoff may be low"),
    ("sedorgp", ">", 14, "Organic/Particulate phosphorus losses in surface runoff may be high"),
    ("sedorgp", "<", 0, "Organic/Particulate phosphorus losses in surface runoff may be low"),
    ("soluble_share_n", ">", 0.85, "Solubility ratio for nitrogen in runoff is high"),
    ("soluble_share_n", "<", 0.1, "Solubility ratio for nitrogen in runoff is low"),
    ("soluble_share_p", ">", 0.95, "Solubility ratio for phosphorus in runoff is high, may be ok in uncultivated areas"),
    ("soluble_share_p", "<", 0.13, "Solubility ratio for phosphorus in runoff is low, may indicate a problem"),
]

# The rules of a land use; ``{}`` in a message stands for the measure with two decimals.
LAND_USE = [
    ("cn", ">", 95, "curve number may be too high"),
    ("cn", "<", 35, "curve number may be too low"),
    ("et_over_rain", "<", 0.31, "ET less than 31% of irrigation water + precipitation"),
    ("et_over_water", ">", 0.98, "ET more than 98% of irrigation water + precipitation"),
    ("runoff_over_rain", ">", 0.5, "more than 1/2 precipitation is runoff"),
    ("runoff_over_rain", "<", 0.01, "less than 1% of precipitation in runoff"),
    ("runoff_over_expected", ">", 1.5, "surface runoff may be excessive"),
    ("runoff_over_expected", "<", 0.5, "surface runoff may be too low"),
    ("no3", ">", 80, "nitrate yield may be too high {} kg/ha"),
    ("biom", ">", 50, "biomass may be too high {} t/ha"),
    ("biom", "<", 1, "biomass may be too low {} t/ha"),
    ("area", "<", 0.05, "HRU area is less than 5 hectares, is this necessary?"),
    ("prec", ">", 3400, "precipitation greater than 3400mm/yr"),
    ("prec", "<", 65, "precipitation less than 65mm/yr"),
]
# Limits and messages for single land units.
UNIT_CURVE_NUMBER = [("cn", ">", 98, "Curve number may be too high (>98)"), ("cn", "<", 35, "Curve number may be too low (<35)")]
# The rules of point sources; ``ps_`` are their loads, ``from_`` their percentages.
POINT_SOURCES = [
    ("from_flow", ">", 30, "Inlets/point sources contribute more than 30% of the total streamflow"),
    ("from_p", ">", 55, "Inlets/point sources contribute more than 55% of the total phosphorus"),
    ("from_n", ">", 20, "Inlets/point sources contribute more than 20% of the total nitrogen"),
    ("from_sed", ">", 30, "Inlets/point sources contribute more than 30% of the total sediment"),
    ("CASE WHEN ps_flow = 0 THEN ps_sed END", ">", 0, "Inlets/point sources contribute sediment but not flow, error likely"),
    ("CASE WHEN ps_flow = 0 THEN ps_p END", ">", 0, "Inlets/point sources contribute phosphorus but not flow, error likely"),
    ("CASE WHEN ps_flow = 0 THEN ps_n END", ">", 0, "Inlets/point sources contribute nitrogen but not flow, error likely"),
    ("CASE WHEN ps_flow > 0 THEN ps_sed END", "=", 0, "Inlets/point sources contribute flow, but not sediment"),
    ("CASE WHEN ps_flow > 0 THEN ps_p END", "=", 0, "Inlets/point sources contribute flow, but not phosphorus"),
    ("CASE WHEN ps_flow > 0 THEN ps_n END", "=", 0, "Inlets/point sources contribute flow, but not nitrogen"),
    ("CASE WHEN ps_n = 0 AND ps_p = 0 AND ps_sed = 0 THEN ps_flow END", "=", 0, "Inlets/point source not present"),
    ("CASE WHEN ps_p > 0 THEN ps_n / ps_p END", ">", 8.8, "Inlets/point sources N:P ratio greater than 8.8"),
    ("CASE WHEN ps_p > 0 THEN ps_n / ps_p END", "<", 2.8, "Inlets/point sources N:P ratio less than 2.8"),
]
# The rules of single reservoirs, and of the extremes over all of them.
RESERVOIR = [
    ("sediment", "<", 40, "Sediment trapping efficiency less than 40% at one or more reservoirs"),
    ("sediment", ">", 98, "Sediment trapping efficiency greater than 98% at one or more reservoirs"),
    ("nitrogen", "<", 7, "Nitrogen trapping efficiency less than 7% at one or more reservoirs"),
    ("nitrogen", ">", 72, "Nitrogen trapping efficiency greater than 72% at one or more reservoirs"),
    ("phosphorus", "<", 18, "Phosphorus trapping efficiency less than 18% at one or more reservoirs"),
    ("phosphorus", ">", 82, "Phosphorus trapping efficiency greater than 82% at one or more reservoirs"),
    ("evaporation", "<", 5, "Evaporation losses are less than 2% at one or more reservoirs"),
    ("evaporation", ">", 50, "Evaporation losses are more than 30% at one or more reservoirs"),
    ("seepage", ">", 25, "Seepage losses are more than 10% at one or more reservoirs"),
]
RESERVOIR_TREND = [
    ("empty", ">", 0, "At least one of your reservoirs has become complexly dry during the simulation"),
    ("most", ">", 5, "At least one of your reservoirs ends the simulation with at least 500% more volume that it begins with. Check your release parameters."),
    ("least", ">", 0.2, "At least one of your reservoirs ends the simulation with less than 20% volume that it begins with. Check your release parameters."),
]
# The rules of what happens in the channels.
INSTREAM = [
    ("erosion", ">", 50, "More than 50% of sediment is from instream processes"),
    ("deposition", ">", 95, "More than 95% of sediment is deposited instream"),
    ("CASE WHEN erosion = 0 AND deposition = 0 THEN 0 END", "=", 0, "No in-stream sediment modification; this is unusual"),
    ("CASE WHEN erosion <> 0 OR deposition <> 0 THEN least(abs(erosion), abs(deposition)) END", "<", 2, "Very little in-stream sediment modification (< +-2%); this is unusual"),
    ("change_n", "<", -50, "Excessive in-stream nitrogen modification (loss)"),
    ("change_n", ">", 10, "Excessive in-stream nitrogen modification (gain)"),
    ("change_p", "<", -50, "Excessive in-stream phosphorus modification (loss)"),
    ("change_p", ">", 10, "Excessive in-stream phosphorus modification (gain)"),
]


def _share(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, so that no rule applies."""
    return F.try_divide(a, F.when(b != 0, b))


def measures(balance: DataFrame) -> DataFrame:
    """Ratios that the rules look at. Columns: precip, surq, latq, flo (return flow), et, cn, denit,
    fertn, fertp, nplt, pplnt, sedorgn, surqno3, lat3no3, sedorgp, surqsolp."""
    c = F.col
    total = c("surq") + c("latq") + c("flo")
    expected = 0.26 * c("precip")  # water yield of average land
    return balance.withColumns(
        {
            "surface_share": F.when(total > 0, c("surq") / total).otherwise(0.0),
            "ground_share": F.when(total > 0, c("flo") / total),
            "yield_over_expected": _share(total, expected),
            "runoff_over_expected": _share(c("surq"), expected_runoff(c("cn")) * expected),
            "denit_over_applied": F.when(c("denit") != 0, _share(c("denit"), c("fertn"))),
            "uptake_over_applied_n": _share(c("nplt"), c("fertn")),
            "uptake_over_applied_p": _share(c("pplnt"), c("fertp")),
            "loss_n": c("sedorgn") + c("surqno3") + c("lat3no3"),
            "soluble_share_n": F.coalesce(_share(c("surqno3"), c("sedorgn") + c("surqno3")), F.lit(0.0)),
            "soluble_share_p": F.coalesce(_share(c("surqsolp"), c("sedorgp") + c("surqsolp")), F.lit(0.0)),
        }
    )


def report(balance: DataFrame) -> DataFrame:
    """``balance`` with its measures and an array of messages for each section."""
    out = measures(balance)
    for name, rules in (("hydrology", HYDROLOGY), ("nitrogen", NITROGEN), ("phosphorus", PHOSPHORUS), ("plants", PLANTS), ("landscape", LANDSCAPE)):
        out = warn(out, rules, name)
    return out


def land_use(units: DataFrame) -> DataFrame:
    """landuse, area, ten means by area, and warnings, which begin with the land use.

    ``units``: landuse, area, cn, irr, prec, surq, et, sed, no3, orgn, biom, yld (the last two in
    kilogrammes, reported in tonnes). A null land use is ``NA``; without area the means are 0.
    """
    c = F.col
    names = ["cn", "irr", "prec", "surq", "et", "sed", "no3", "orgn", "biom", "yld"]
    area = F.sum("area")
    means = [(F.coalesce(F.try_divide(F.sum(c(x) * c("area")), F.when(area != 0, area)), F.lit(0.0)) / (1000 if x in ("biom", "yld") else 1)).alias(x) for x in names]
    out = units.groupBy(F.coalesce(F.trim("landuse"), F.lit("NA")).alias("landuse")).agg(F.coalesce(area, F.lit(0.0)).alias("area"), *means)
    ratios = {
        "et_over_rain": _share(c("et"), c("prec")),
        "et_over_water": F.when(c("prec") != 0, _share(c("et"), c("prec") + c("irr"))),
        "runoff_over_rain": _share(c("surq"), c("prec")),
        "runoff_over_expected": _share(c("surq"), expected_runoff(c("cn")) * 0.26 * c("prec")),
    }
    broken = [F.when(TESTS[op](c(x), F.lit(limit)), F.format_string("%s " + message.replace("%", "%%").replace("{}", "%.2f"), *["landuse", *([x] if "{}" in message else [])])) for x, op, limit, message in LAND_USE]
    return out.withColumns(ratios).withColumn("warnings", F.array_compact(F.array(*broken))).drop(*ratios)


def unit_curve_numbers(units: DataFrame) -> DataFrame:
    """name, warning: a row for each land unit (name, cn) whose curve number is out of bounds."""
    return warn(units, UNIT_CURVE_NUMBER).select("name", F.explode("warnings").alias("warning"))


def point_sources(loads: DataFrame) -> DataFrame:
    """``loads`` with the percentages that point sources contribute, and warnings.

    Columns: sub_flow, sub_sed, sub_n, sub_p of the channel with the greatest flow, and ps_flow,
    ps_sed, ps_n, ps_p of all point sources. Without a channel's load the percentage is 0.
    """
    c = F.col
    parts = {f"from_{x}": F.when(c(f"sub_{x}") == 0, 0.0).otherwise(F.try_divide(c(f"ps_{x}"), c(f"ps_{x}") + c(f"sub_{x}")) * 100) for x in ("flow", "sed", "n", "p")}
    return warn(loads.withColumns(parts), POINT_SOURCES)


def reservoirs(rows: DataFrame, yearly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trapping, losses and warnings of each reservoir; and one row of what holds for any of them.

    ``rows``: name and in and out of sed, n, p, with stor, seep, evap. ``yearly``: name, yr, stor; a
    reservoir's first and last year are those of all reservoirs.
    """
    c = F.col
    trapped = {f: in_out_percent(c(f"{x}_in"), c(f"{x}_out")) for f, x in (("sediment", "sed"), ("nitrogen", "n"), ("phosphorus", "p"))}
    lost = {f: ratio(x, "stor") * 100 for f, x in (("seepage", "seep"), ("evaporation", "evap"))}
    span = yearly.agg(F.min("yr").alias("first_yr"), F.max("yr").alias("last_yr"), F.count_distinct("yr").alias("years"))
    volumes = yearly.crossJoin(F.broadcast(span)).groupBy("name").agg(
        F.max(F.when(c("yr") == c("first_yr"), c("stor"))).alias("_first"), F.max(F.when(c("yr") == c("last_yr"), c("stor"))).alias("_last"), F.count_if(c("stor") < 1).alias("_dry"), F.max("years").alias("_years")
    )
    each = rows.join(volumes, "name", "left").withColumns(trapped | lost | {"volume_ratio": ratio("_last", "_first"), "fraction_empty": ratio("_dry", "_years")})
    each = warn(each, RESERVOIR).drop("_first", "_last", "_dry", "_years")
    seen = F.array(*[F.max(F.array_contains("warnings", message)) for *_, message in RESERVOIR])
    bundle = each.agg(F.count("*").alias("n"), F.max("fraction_empty").alias("empty"), F.max("volume_ratio").alias("most"), F.min("volume_ratio").alias("least"), seen.alias("_seen"))
    bundle = warn(bundle, RESERVOIR_TREND, "_trend")
    messages = F.array(*[F.when(c("_seen")[k], message) for k, (*_, message) in enumerate(RESERVOIR)])
    return each, bundle.select("n", "empty", "most", "least", F.concat(F.array_compact(messages), "_trend").alias("warnings"))


def instream(basin: DataFrame) -> DataFrame:
    """``basin`` with erosion and deposition, nutrient changes and stream losses in per cent, and warnings.

    Columns: sed_in, sed_out, n_in, n_out, p_in, p_out of the channels, upland_sed, load_n and load_p
    of channels and point sources together, yield, tloss and tevap of water.
    """
    c = F.col
    change = c("sed_out") - c("sed_in")
    parts = {
        "erosion": F.when((c("upland_sed") > 0) & (change > 0), change / (c("upland_sed") + change) * 100).otherwise(0.0),
        "deposition": F.when((c("upland_sed") > 0) & (change <= 0), -change / c("upland_sed") * 100).otherwise(0.0),
        "change_n": ratio(c("n_out") - c("n_in"), c("load_n")) * 100,
        "change_p": ratio(c("p_out") - c("p_in"), c("load_p")) * 100,
        "stream_loss": ratio(c("tloss") + c("tevap"), c("yield")) * 100,
    }
    return warn(basin.withColumns(parts), INSTREAM)


def reaches(channels: DataFrame) -> DataFrame:
    """name, sediment, nitrogen, phosphorus: what leaves each channel in per cent of what enters; 0 without inflow."""
    return channels.select("name", *[(ratio(f"{x}_out", f"{x}_in") * 100).alias(f) for f, x in (("sediment", "sed"), ("nitrogen", "n"), ("phosphorus", "p"))])
