"""Readers over lines made from tables, exports read back, row changes, look-ups, JSON, functions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchment.functions import documents
from catchment.operators import aggregates, landunits, metrics, network, relational, sampling, schema, stored, timeseries
from catchment.operators.iterate import fresh_path
from catchment.plans.fit import PAIRS, monthly_pairs
from catchment.plans.registry import query
from catchment.plans.sampling import normal_inverse_sql, uniform_sql
from catchment.sources import delimited, writers
from catchment.sources import text as source


def c(name):
    return F.col(name)


def _file(t):
    """An output file's lines: suppliers, some values starred, ids in their names."""
    body = t.supplier.select((c("s_suppkey") + 4).cast("int").alias("line"), F.concat_ws("  ", F.lit("1 1 1 2000"), c("s_nationkey").cast("string"), F.when(c("s_suppkey") % 2 == 0, "0").otherwise(c("s_suppkey").cast("string")), F.concat(F.lit("hru"), c("s_suppkey").cast("string")), F.when(c("s_suppkey") % 5 == 0, "***").otherwise(F.format_string("%.2f", "s_acctbal"))).alias("value"))
    head = t.spark.createDataFrame([(1, "title"), (2, "jday mon day yr unit gis_id name null flow"), (3, "none none none none none none none mm")], "line int, value string")
    return head.unionByName(body.where("line >= 4"))


_FORM = T.StructType([*source.PREFIX.fields, T.StructField("flow", T.DoubleType())])
query("src_2", "SELECT CAST(s_nationkey AS INT) AS unit, CAST(s_suppkey AS INT) AS gis_id, 'hru' || s_suppkey AS name, CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END AS flow FROM supplier")(
    lambda t: source.parse_output(_file(t), _FORM).select("unit", "gis_id", "name", "flow")
)
query("src_1", "SELECT 'part' || p_partkey || '.txt' AS file FROM part WHERE p_partkey % 3 = 0")(
    lambda t: source.parse_manifest(t.part.select(F.concat(F.lit("x  y "), F.lit("part"), c("p_partkey").cast("string"), F.when(c("p_partkey") % 3 == 0, ".txt").otherwise(".out")).alias("value")))
)
#: Tables whose files begin at different lines.
_STARTS = {"hru_wb_day": 4, "crop_yld_aa": 6, "hru_pest_aa": 3, "flow_duration_curve": 3}


def _files(t):
    """The suppliers as an output file of each table, with as many title lines before them as it has."""
    out = []
    for name, first in _STARTS.items():
        titles = t.spark.createDataFrame([(k, f"{k} of no use here 9 9 x 9") for k in range(1, first)], "line int, value string")
        body = t.supplier.select((c("s_suppkey") + first).cast("int").alias("line"), F.concat_ws(" ", F.lit("1 1 1 2000"), c("s_nationkey").cast("string"), (c("s_suppkey") + 1).cast("string"), F.lit("n"), F.format_string("%.2f", "s_acctbal")).alias("value"))
        parsed = source.parse_output(titles.unionByName(body), _FORM, source.start_line(name))
        out.append(parsed.select(F.lit(name).alias("name"), "unit", "gis_id", "flow"))
    return reduce(lambda a, b: a.unionByName(b), out)


query("src_3", "SELECT name, CAST(s_nationkey AS INT) AS unit, CAST(s_suppkey + 1 AS INT) AS gis_id, round(s_acctbal, 2) AS flow FROM supplier, (VALUES " + ", ".join(f"('{n}')" for n in _STARTS) + ") v(name)")(_files)
query("src_4", "SELECT * FROM (VALUES (0, 'jday', 'none'), (1, 'mon', 'none'), (2, 'day', 'none'), (3, 'yr', 'none'), (4, 'unit', 'none'), (5, 'gis_id', 'none'), (6, 'name', 'none'), (7, 'null', NULL), (8, 'flow', 'mm')) v(place, name, units)")(
    lambda t: source.parse_units(_file(t))
)


def _written(t, lines, name="text"):
    """A folder with text files of ``lines`` (value)."""
    path = fresh_path(t.spark, name)
    lines.select("value").write.text(path)
    return path


query("src_5", "SELECT s_suppkey, lower(s_name) AS name, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal, 2) END AS x FROM supplier")(
    lambda t: delimited.read_delimited(
        t.spark, _written(t, t.supplier.select(F.concat_ws(";", c("s_suppkey").cast("string"), "s_name", F.when(c("s_suppkey") % 4 == 0, "null").otherwise(F.replace(F.format_string("%.2f", "s_acctbal"), F.lit("."), F.lit(",")))).alias("value"))),
        "s_suppkey long, name string, x double", header=False, lower_names=True,
    )
)


def _named(t):
    """A table of brands, some with a number behind them, and new rows of brands and types."""
    table = t.part.groupBy(c("p_brand").alias("name")).agg(F.sum("p_size").alias("x")).unionByName(t.part.where("p_size % 3 = 0").groupBy(F.concat("p_brand", F.pmod("p_size", F.lit(4)).cast("string")).alias("name")).agg(F.count("*").alias("x")))
    rows = t.part.groupBy(c("p_brand").alias("name")).agg(F.max("p_size").cast("long").alias("x")).unionByName(t.part.groupBy(c("p_type").alias("name")).agg(F.min("p_size").cast("long").alias("x")))
    return table, rows


_NAMED = "o AS (SELECT p_brand AS name, CAST(sum(p_size) AS BIGINT) AS x FROM part GROUP BY 1 UNION ALL SELECT p_brand || p_size % 4, count(*) FROM part WHERE p_size % 3 = 0 GROUP BY 1), r AS (SELECT p_brand AS name, CAST(max(p_size) AS BIGINT) AS x FROM part GROUP BY 1 UNION ALL SELECT p_type, CAST(min(p_size) AS BIGINT) FROM part GROUP BY 1)"
query("src_5_replace", f"WITH {_NAMED} SELECT * FROM o WHERE name NOT IN (SELECT name FROM r) UNION ALL SELECT * FROM r")(lambda t: delimited.add_rows(*_named(t), "replace"))
query("src_5_rename", f"WITH {_NAMED} SELECT * FROM o UNION ALL SELECT CASE WHEN name IN (SELECT name FROM o) THEN name || (SELECT min(k) FROM range(1, 200) s(k) WHERE r.name || k NOT IN (SELECT name FROM o)) ELSE name END, x FROM r")(lambda t: delimited.add_rows(*_named(t), "rename"))
query("src_6", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS INT) END AS size, p_type AS kind FROM part")(
    lambda t: delimited.read_lines(t.spark, _written(t, t.part.select(F.concat_ws("   ", c("p_partkey").cast("string"), F.when(c("p_size") % 3 == 0, "null").otherwise(c("p_size").cast("string")), "p_type", F.lit("more")).alias("value"))), "p_partkey long, size int, kind string", start=1)
)
query("src_7", "SELECT CAST(n_nationkey AS INT) AS LANDUSE_ID, n_name AS CODE, 'use of ' || n_name AS DESCRIPTION FROM nation")(
    lambda t: delimited.import_kind(
        t.spark, _written(t, t.nation.select(F.lit(0).alias("k"), F.lit("LANDUSE_ID,CODE,DESCRIPTION").alias("value")).limit(1).union(t.nation.select(c("n_nationkey") + 1, F.concat_ws(",", c("n_nationkey").cast("string"), "n_name", F.concat(F.lit("use of "), c("n_name"))))).coalesce(1).sortWithinPartitions("k")), "landuse"
    )
)
query("src_8", "SELECT p_partkey AS file, base || CASE WHEN k > 1 THEN CAST(k - 2 AS VARCHAR) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM (SELECT p_partkey, CASE WHEN contains(lower(stem), 'small') THEN stem ELSE 'small_lookup' END AS base FROM (SELECT p_partkey, p_type || '_' || p_size AS stem FROM part)))")(
    lambda t: stored.new_names(t.part.select(c("p_partkey").alias("file"), F.concat_ws("_", "p_type", c("p_size").cast("string")).alias("stem")), "small")
)
for _number, _strict in ((9, False), (10, True)):
    query(
        f"src_{_number}", "SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey" + ("" if _strict else ", NULL AS extra") + " FROM supplier UNION ALL SELECT n_nationkey + 1000000, NULL" + ("" if _strict else ", n_name") + " FROM nation"
    )(
        lambda t, strict=_strict: delimited.import_format(
            t.spark, _exported(t, t.nation.select((c("n_nationkey") + 1000000).alias("s_suppkey"), c("n_name").alias("extra")), "tsv"), "tsv", t.supplier.select("s_suppkey", c("s_nationkey").cast("double").alias("s_nationkey")), strict
        )
    )


def _exported(t, df, kind, header=True):
    path = fresh_path(t.spark, "export")
    writers.export(df, path, kind, header)
    return path


_DTL = "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1"


def _decisions(t):
    """A decision table for each nation with suppliers: two conditions on its number, two alternatives, an action."""
    rows = t.supplier.groupBy("s_nationkey").count()
    name = F.concat(F.lit("dt"), c("s_nationkey").cast("string"))
    body = F.array(
        F.lit("name conds alts acts !a table"), F.concat(name, F.lit("  2  2  1")), F.lit("var obj obj_num lim_var lim_op lim_const alt1 alt2"),
        F.concat(F.lit("soil_water hru 0 wp * "), c("count").cast("string"), F.lit(".5 < - !dry")), F.concat(F.lit("month null "), c("s_nationkey").cast("string"), F.lit(" null - 6.0 = >")),
        F.lit("act_typ obj obj_num name option const const2 fp outcomes"), F.concat(F.lit("irrigate hru "), c("s_nationkey").cast("string"), F.lit(" sprinkler drip 25.0 0.0 null y n")), F.lit(""),
    )
    one = rows.select(name.alias("path"), F.posexplode(F.concat(F.array(F.lit("title"), F.lit("1"), F.lit("")), body)).alias("line", "value"))
    return delimited.decision_tables(one.withColumn("line", c("line") + 1))


query("src_29", f"SELECT 'dt' || s_nationkey AS \"table\", k AS cond, CASE WHEN k = 1 THEN 'soil_water' ELSE 'month' END AS var, CASE WHEN k = 1 THEN n + 0.5 ELSE 6.0 END AS lim_const, CASE WHEN k = 1 THEN 0 ELSE s_nationkey END AS obj_num FROM ({_DTL}), range(1, 3) r(k)")(lambda t: _decisions(t)[0].select("table", "cond", "var", "lim_const", "obj_num"))
query("src_29_alts", f"SELECT 'dt' || s_nationkey AS \"table\", k AS cond, a AS alt, CASE WHEN k = 1 THEN (CASE WHEN a = 1 THEN '<' ELSE '-' END) WHEN a = 1 THEN '=' ELSE '>' END AS value FROM ({_DTL}), range(1, 3) r(k), range(1, 3) s(a)")(lambda t: _decisions(t)[1].drop("path"))
query("src_29_acts", f"SELECT 'dt' || s_nationkey AS \"table\", 'sprinkler' AS name, '25.0' AS const, s_nationkey AS obj_num, 'true,false' AS outcomes FROM ({_DTL})")(lambda t: _decisions(t)[2].select("table", "name", "const", "obj_num", F.array_join(c("outcomes").cast("array<string>"), ",").alias("outcomes")))


def _again(t, df, kind):
    """Exported and read back."""
    path = fresh_path(t.spark, "export")
    writers.export(df, path, kind)
    if kind == "json":
        return t.spark.read.schema(df.schema).json(path)
    return t.spark.read.schema(df.schema).csv(path, header=True, sep={"csv": ",", "tsv": "\t"}[kind])


_EXPORT = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
for _name, _kind in (("src_11", "tsv"), ("src_12", "json"), ("snk_16", "csv"), ("snk_17", "tsv"), ("snk_18", "json")):
    query(_name, _EXPORT)(lambda t, kind=_kind: _again(t, t.nation.select("n_nationkey", "n_name", "n_regionkey"), kind))
query("snk_1", "SELECT p_partkey, p_type, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS place FROM part")(
    lambda t: t.spark.read.csv(_exported(t, writers.numbered(t.part.drop("p_name", "p_brand"), ["p_partkey"], "place"), "csv"), header=True, inferSchema=True).select("p_partkey", "p_type", "place")
)
query("snk_15", "SELECT o_orderpriority AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")(lambda t: t.spark.read.schema("k string, n long").json(_exported(t, t.spark.sql("SELECT o_orderpriority AS k, count(*) AS n FROM {orders} GROUP BY 1", orders=t.orders), "json")))
query("snk_19", "SELECT * FROM (VALUES ('s_suppkey', 0), ('s_name', 1), ('s_nationkey', 2), ('s_acctbal', 3)) v(name, place)")(
    lambda t: t.spark.read.text(_exported(t, t.supplier, "csv")).where(F.startswith("value", F.lit("s_suppkey"))).distinct().select(F.posexplode(F.split("value", ",")).alias("place", "name"))
)
query("snk_20", "SELECT item_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM benchmark")(lambda t: _again(t, t.benchmark, "csv"))
for _number in (16, 17):
    query(f"src_{_number}", "SELECT strftime(DATE '2000-02-20' + CAST(s_suppkey AS INT), '%Y%j') AS d, round(s_acctbal, 2) AS value FROM supplier")(
        lambda t: source.parse_dense(t.supplier.select(F.lit("f").alias("path"), (c("s_suppkey") + 2).cast("int").alias("line"), F.format_string("%.2f", "s_acctbal").alias("value")).unionByName(t.spark.createDataFrame([("f", 1, "20000220")], "path string, line int, value string"))).select(F.date_format("date", "yyyyDDD").alias("d"), "value")
    )
query("src_19", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")(
    lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
)
query("src_21", "SELECT vec_id, CAST(k AS INT) AS layer, CAST(embedding[4 * k - 3] AS DOUBLE) AS depth FROM embeddings, range(1, 4) r(k)")(
    lambda t: t.embeddings.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.element_at("embedding", 4 * k + 1).cast("double"))).alias("p", "depth")).select("vec_id", (c("p") + 1).alias("layer"), "depth")
)
query("src_22", "SELECT o_custkey, m AS month, n FROM (SELECT o_custkey, CAST(month(o_orderdate) AS INT) AS m, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2)")(
    lambda t: t.orders.withColumn("m", F.month("o_orderdate")).groupBy("o_custkey").pivot("m", list(range(1, 13))).count().unpivot("o_custkey", [str(k) for k in range(1, 13)], "month", "n").where("n is not null").withColumn("month", c("month").cast("int"))
)
def _catalogued(t):
    name = stored.create(t.nation.select("n_nationkey", "n_name", "n_regionkey"), stored.fresh_name("nation"))
    found = stored.columns(t.spark, name).join(stored.tables(t.spark, name).select(F.lit(True).alias("listed")), how="cross").select("place", "name", "listed")
    rows = [tuple(r) for r in found.collect()]
    stored.drop(t.spark, name)
    return t.spark.createDataFrame(rows, "place int, name string, listed boolean")


query("src_24", "SELECT * FROM (VALUES (0, 'n_nationkey', true), (1, 'n_name', true), (2, 'n_regionkey', true)) v(place, name, listed)")(_catalogued)
# Writers

query("snk_5", "SELECT p_partkey, lpad(printf('%.3f', p_retailprice), 12, ' ') AS x, lpad(CAST(p_size AS VARCHAR), 8, ' ') AS n, rpad(p_type, 12, ' ') AS s FROM part")(
    lambda t: t.part.select("p_partkey", writers.field(c("p_retailprice"), "double", 12, 3).alias("x"), writers.field(c("p_size"), "int", 8).alias("n"), writers.field(c("p_type"), "string", 12).alias("s"))
)
for _number in (3, 4):
    query(f"snk_{_number}", "SELECT CAST(0 AS INT) AS place, lpad('p_partkey', 10, ' ') || '  ' || rpad('p_type', 12, ' ') AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INT), lpad(CAST(p_partkey AS VARCHAR), 10, ' ') || '  ' || rpad(p_type, 12, ' ') FROM part")(
        lambda t: writers.fixed_lines(t.part, [("p_partkey", "int", 10), ("p_type", "string", 12)], ["p_partkey"])
    )
query("snk_7", "SELECT p_brand, p_type, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || ',-' || b END, ',' ORDER BY a) AS elements FROM (SELECT p_brand, p_type, min(k) AS a, max(k) AS b FROM (SELECT p_brand, p_type, k, k - row_number() OVER (PARTITION BY p_brand, p_type ORDER BY k) AS i FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)) GROUP BY p_brand, p_type, i) GROUP BY 1, 2")(
    lambda t: landunits.runs(t.part.select("p_brand", "p_type", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("k")), ["p_brand", "p_type"], "k")
)
query("snk_8", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS line FROM part")(lambda t: t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("line")))
for _number in (10, 11):
    query(f"snk_{_number}", "SELECT o_custkey, o_custkey || coalesce((SELECT string_agg('  ' || o_orderstatus, '' ORDER BY x.o_orderkey) FROM orders x WHERE x.o_custkey = c.o_custkey), '') AS value FROM (SELECT DISTINCT o_custkey FROM orders) c")(
        lambda t: writers.parent_lines(t.orders.select("o_custkey").distinct(), t.orders.select(c("o_custkey").alias("f"), "o_orderkey", "o_orderstatus"), "o_custkey", "f", "o_orderkey")
    )
query("snk_12", "SELECT (SELECT count(*) > 0 FROM part) AS part, (SELECT count(*) > 0 FROM supplier WHERE s_suppkey < 0) AS none")(
    lambda t: t.part.agg((F.count("*") > 0).alias("part")).crossJoin(F.broadcast(t.supplier.where("s_suppkey < 0").agg((F.count("*") > 0).alias("none"))))
)
_SMALL = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def _stored(t, df, *steps):
    """A new table with the rows of ``df``, after the steps (session, name), read back; its name goes again."""
    name = stored.create(df, stored.fresh_name("t"))
    for step in steps:
        step(t.spark, name)
    out = t.spark.table(name)
    rows = t.spark.read.schema(out.schema).parquet(*{f.rpartition("/")[0] for f in out.inputFiles()} or [fresh_empty(t, out)])
    stored.drop(t.spark, name)
    return rows


def fresh_empty(t, df):
    """A folder with no row of the shape of ``df``."""
    path = fresh_path(t.spark, "empty")
    df.limit(0).write.parquet(path)
    return path


def _suppliers(t):
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey")


query("snk_21", f"{_SMALL} UNION ALL SELECT 1000000 + n_nationkey, n_name, n_regionkey FROM nation")(
    lambda t: _stored(t, _suppliers(t), lambda spark, name: stored.insert(spark, name, t.nation.select((c("n_nationkey") + 1000000).alias("s_suppkey"), c("n_name").alias("s_name"), c("n_regionkey").alias("s_nationkey"))))
)
query("snk_22", "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) THEN 'bulk' ELSE s_name END AS s_name FROM supplier")(
    lambda t: _stored(t, t.supplier.select("s_suppkey", "s_name"), lambda spark, name: stored.update_ids(spark, name, "s_suppkey", t.lineitem.where("l_quantity > 49").select("l_suppkey"), s_name="bulk"))
)
query("snk_24", f"{_SMALL} UNION ALL {_SMALL} WHERE s_acctbal < 0")(lambda t: _stored(t, _suppliers(t), lambda spark, name: _suppliers_below(t).write.insertInto(name)))


def _suppliers_below(t):
    return t.supplier.where("s_acctbal < 0").select("s_suppkey", "s_name", "s_nationkey")


query("snk_25", f"{_SMALL} UNION ALL SELECT -7, 'new one', NULL")(lambda t: _stored(t, _suppliers(t), lambda spark, name: stored.insert_values(spark, name, ["-7", "new one", "none"])))
query("snk_26", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name, s_nationkey FROM supplier")(lambda t: _stored(t, _suppliers(t), lambda spark, name: stored.update(spark, name, c("s_nationkey") == 3, s_name="moved")))
query("snk_23", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_name FROM nation")(
    lambda t: relational.replace(t.supplier.select("s_suppkey", "s_name"), t.nation.select(c("n_nationkey").cast("long").alias("s_suppkey"), c("n_name").alias("s_name")), ["s_suppkey"])
)
query("snk_27", "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey <> 3")(lambda t: _stored(t, _suppliers(t), lambda spark, name: stored.delete(spark, name, c("s_nationkey") == 3)))


def _renamed(t):
    old = stored.create(t.nation.select("n_nationkey", "n_name"), stored.fresh_name("old"))
    new = stored.fresh_name("new")
    stored.rename(t.spark, old, new)
    there = [t.spark.catalog.tableExists(x) for x in (old, new)]
    rows = t.spark.table(new).agg(F.count("*").alias("n"), F.lit(there[0]).alias("old_there"), F.lit(there[1]).alias("new_there")).first()
    stored.drop(t.spark, new)
    return t.spark.createDataFrame([tuple(rows)], "n long, old_there boolean, new_there boolean")


query("snk_29", "SELECT CAST(count(*) AS BIGINT) AS n, false AS old_there, true AS new_there FROM nation")(_renamed)


def _dump(t):
    """Every table as fixed-width lines in a folder of its own, read back: lines and characters of each."""
    sections = {"nation": (t.nation, ["n_nationkey"]), "region": (t.region, ["r_regionkey"]), "supplier": (t.supplier.select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey"]), "part": (t.part.select("p_partkey", "p_brand", "p_size"), ["p_partkey"])}
    root = fresh_path(t.spark, "dump")
    for name, (df, order) in sections.items():
        kinds = [(n, "string" if k == "string" else "int", 12) for n, k in df.dtypes]
        writers.fixed_lines(df, kinds, order).select("value").write.text(f"{root}/section={name}")
    return t.spark.read.option("basePath", root).text(f"{root}/section=*").groupBy("section").agg(F.count("*").alias("lines"), F.max(F.length("value")).cast("long").alias("width"))


query("snk_14", "SELECT 'nation' AS section, CAST(count(*) + 1 AS BIGINT) AS lines, CAST(12 * 3 + 4 + greatest(0, max(length(n_name)) - 12) AS BIGINT) AS width FROM nation UNION ALL SELECT 'region', count(*) + 1, 12 * 2 + 2 + greatest(0, max(length(r_name)) - 12) FROM region UNION ALL SELECT 'supplier', count(*) + 1, 12 * 3 + 4 + greatest(0, max(length(s_name)) - 12) FROM supplier UNION ALL SELECT 'part', count(*) + 1, 12 * 3 + 4 + greatest(0, max(length(p_brand)) - 12) FROM part")(_dump)
query("snk_28", "SELECT s_suppkey, CAST(NULL AS DOUBLE) AS depth FROM supplier")(lambda t: schema.migrate(t.supplier.select("s_suppkey"), [("add", "depth", "double")]))
query("snk_33", "SELECT 'base' AS scenario, n_name FROM nation UNION ALL SELECT 'dry', n_name FROM nation WHERE n_regionkey = 1")(
    lambda t: _scenarios(t)
)


def _scenarios(t):
    """Two scenarios saved beside each other; the one saved last replaces its first version; both are loaded."""
    root = fresh_path(t.spark, "scenarios")
    for name, df in (("base", t.nation), ("dry", t.nation), ("dry", t.nation.where("n_regionkey = 1"))):
        df.select("n_name").write.mode("overwrite").parquet(f"{root}/scenario={name}")
    return t.spark.read.parquet(root).select("scenario", "n_name")


# Look-ups and joins

query("prj_36", "SELECT p_partkey, CASE WHEN p_name LIKE '%1' THEN 'deep' ELSE 'shallow' END AS kind FROM part UNION ALL SELECT p_partkey, 'copy' FROM part WHERE p_name LIKE '%1'")(
    lambda t: t.part.select("p_partkey", F.when(c("p_name").like("%1"), "deep").otherwise("shallow").alias("kind")).unionByName(t.part.where(c("p_name").like("%1")).select("p_partkey", F.lit("copy").alias("kind")))
)


def _daily_tables(t):
    """Those of some new tables whose names end in the wanted period; the names' common part is cut off again."""
    base = stored.fresh_name("p")
    names = [stored.create(t.region.limit(0), f"{base}_{x}") for x in ("hru_wb_day", "hru_wb_mon", "basin_wb_day", "gis_lsus", "hru_wb_aa")]
    found = [(r["name"].removeprefix(f"{base}_"),) for r in stored.tables(t.spark, "_day").where(F.startswith("name", F.lit(base))).collect()]
    for name in names:
        stored.drop(t.spark, name)
    return t.spark.createDataFrame(found, "name string")


query("prj_38", "SELECT * FROM (VALUES ('hru_wb_day'), ('basin_wb_day')) v(name)")(_daily_tables)
#: Sand, silt and clay ranges (closed) of texture classes, first match wins; fixed values.
TEXTURES = [("clay", 0, 45, 0, 40, 40, 100), ("silty_clay", 0, 20, 40, 60, 40, 60), ("sandy_clay", 45, 65, 0, 20, 35, 55), ("clay_loam", 20, 45, 15, 52, 27, 40), ("loam", 23, 52, 28, 50, 7, 27)]


def texture(sand, silt, clay):
    out = F.lit("sand")
    for name, a, b, p, q, x, y in reversed(TEXTURES):
        out = F.when(sand.between(a, b) & silt.between(p, q) & clay.between(x, y), name).otherwise(out)
    return out


_CASES = " ".join(f"WHEN a BETWEEN {a} AND {b} AND b BETWEEN {p} AND {q} AND c BETWEEN {x} AND {y} THEN '{n}'" for n, a, b, p, q, x, y in TEXTURES)
query("prj_42", f"SELECT p_partkey, CASE {_CASES} ELSE 'sand' END AS texture FROM (SELECT p_partkey, p_size AS a, p_partkey % 60 AS b, 100 - p_size - p_partkey % 60 AS c FROM part)")(
    lambda t: t.part.select("p_partkey", texture(c("p_size"), c("p_partkey") % 60, 100 - c("p_size") - c("p_partkey") % 60).alias("texture"))
)
query("prj_44", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0.9 WHEN 'LARGE' THEN CASE WHEN p_size < 20 THEN 0.5 ELSE 0.2 END ELSE 0.05 END AS perco FROM part")(
    lambda t: t.part.select("p_partkey", F.when(c("p_type") == "SMALL", 0.9).when(c("p_type") == "LARGE", F.when(c("p_size") < 20, 0.5).otherwise(0.2)).otherwise(0.05).alias("perco"))
)
#: Key columns of the tables: (table, column) to (parent, key).
FOREIGN = {("customer", "c_nationkey"): ("nation", "n_nationkey"), ("supplier", "s_nationkey"): ("nation", "n_nationkey"), ("nation", "n_regionkey"): ("region", "r_regionkey"), ("orders", "o_custkey"): ("customer", "c_custkey"), ("lineitem", "l_orderkey"): ("orders", "o_orderkey")}


def related(t, left, right, how="inner"):
    """Joins two tables by the one foreign key between them, in either direction."""
    found = [(a, b) for (x, a), (y, b) in FOREIGN.items() if {x, y} == {left, right}]
    if len(found) != 1:
        raise ValueError(f"{left} and {right} have {len(found)} keys in common")
    a, b = found[0]
    return getattr(t, left).join(getattr(t, right), c(a) == c(b), how)


def ensure_join(t, df, left, right):
    """``df`` joined with table ``right`` by its key with ``left``, unless ``df`` has the columns of ``right`` already."""
    other = getattr(t, right)
    if set(other.columns) <= set(df.columns):
        return df
    (a, b), = [(a, b) if x == left else (b, a) for (x, a), (y, b) in FOREIGN.items() if {x, y} == {left, right}]
    return df.join(other, c(a) == c(b))


query("jn_9", "SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey")(lambda t: related(t, "region", "nation").select("n_name", "r_name"))
query("jn_11", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: ensure_join(t, ensure_join(t, ensure_join(t, ensure_join(t, t.supplier, "supplier", "nation"), "nation", "region"), "supplier", "nation"), "nation", "region").select("s_suppkey", "n_name", "r_name")
)
# After the way over customers to orders, the next join starts from the nations again.
query("jn_12", "SELECT o_orderkey, r_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: ensure_join(t, ensure_join(t, ensure_join(t, t.nation, "nation", "customer"), "customer", "orders"), "nation", "region").select("o_orderkey", "r_name")
)
for _number, _how in ((24, "left"), (25, "left")):
    query(f"jn_{_number}", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")(
        lambda t, how=_how: related(t, "orders", "customer", how).join(t.nation, c("c_nationkey") == c("n_nationkey"), how).select("o_orderkey", "c_name", "n_name")
    )
query("jn_33", "SELECT y, k, a, b FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, o_custkey AS k, count(*) AS a FROM orders GROUP BY 1, 2) JOIN (SELECT CAST(year(l_shipdate) AS INT) AS y, l_suppkey AS k, count(*) AS b FROM lineitem GROUP BY 1, 2) USING (y, k)")(
    lambda t: t.orders.groupBy(F.year("o_orderdate").alias("y"), c("o_custkey").alias("k")).agg(F.count("*").alias("a")).join(t.lineitem.groupBy(F.year("l_shipdate").alias("y"), c("l_suppkey").alias("k")).agg(F.count("*").alias("b")), ["y", "k"])
)
query("jn_35", "SELECT s_suppkey, q, p FROM supplier JOIN (SELECT l_suppkey AS s_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1) USING (s_suppkey) JOIN (SELECT l_suppkey AS s_suppkey, round(max(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1) USING (s_suppkey)")(
    lambda t: t.supplier.join(t.lineitem.groupBy(c("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.max("l_extendedprice"), 2).alias("p")), "s_suppkey").select("s_suppkey", "q", "p")
)
def _soil_tables(t):
    """Parts as soils, the distinct lines of their orders as layers."""
    soils = t.part.select(c("p_partkey").alias("soil_id"), c("p_name").alias("snam"), c("p_brand").alias("muid"), c("p_size").alias("seqn"), c("p_type").alias("name"), F.concat("p_brand", F.lit("x")).alias("s5id"))
    layers = t.lineitem.select(c("l_partkey").alias("soil_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("layer_num")).distinct()
    return soils, layers


for _option, _keys in (("stmuid+seqnum", ["muid", "seqn"]), ("stmuid+name", ["muid", "name"])):
    query(
        "jn_38" if "seqn" in _keys else "jn_38_name",
        f"""WITH s AS (SELECT p_partkey AS soil_id, p_brand AS muid, p_size AS seqn, p_type AS name FROM part), l AS (SELECT DISTINCT l_partkey AS soil_id, l_orderkey * 10 + l_linenumber AS layer_num FROM lineitem)
        SELECT {', '.join(_keys)}, soil_id, CAST(row_number() OVER (PARTITION BY soil_id ORDER BY layer_num) AS INT) AS place, layer_num FROM s JOIN l USING (soil_id) WHERE muid LIKE '%2%'""",
    )(lambda t, option=_option: relational.soil_layers(_soil_tables(t)[0].where("muid like '%2%'"), *_soil_tables(t), option))

# Aggregates and windows

_LENGTHS = timeseries.period_lengths(date(1996, 3, 1), date(2000, 6, 30))
query("ag_24", "SELECT sum(d) AS days, round(12 * sum(d / n), 8) AS months, round(sum(d / n), 8) AS years FROM (SELECT date_diff('day', greatest(DATE '1996-03-01', make_date(y, 1, 1)), least(DATE '2000-06-30', make_date(y, 12, 31))) + 1 AS d, dayofyear(make_date(y, 12, 31)) AS n FROM range(1996, 2001) r(y))".replace("sum(d) AS days", "CAST(sum(d) AS BIGINT) AS days"))(
    lambda t: t.spark.createDataFrame([(_LENGTHS[0], round(_LENGTHS[1], 8), round(_LENGTHS[2], 8))], "days long, months double, years double")
)
query("ag_25", "SELECT l_suppkey, round(sum(coalesce(l_quantity, 0)), 4) AS total FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.coalesce("l_quantity", F.lit(0.0))), 4).alias("total")))
query("ag_41", f"{PAIRS} SELECT round(1 - sum(r * r) / sum((o - ma) * (o - ma)), 6) AS value FROM q")(lambda t: metrics.fit(monthly_pairs(t), "month", ["NSE"]).select(F.round("NSE", 6).alias("value")))
query("ag_57", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST('0x' || substr(md5('{\"o_custkey\":\"' || o_custkey || '\",\"o_orderkey\":\"' || o_orderkey || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}'), 1, 15) AS BIGINT)) AS VARCHAR) AS hash FROM orders")(
    lambda t: aggregates.table_hash(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))
)
query("wn_15", f"{PAIRS} SELECT round(sum((r - a) * (n - a)) / sum((r - a) * (r - a)), 6) AS value FROM (SELECT r, avg(r) OVER () AS a, lead(r, 3) OVER (ORDER BY month) AS n FROM q)")(lambda t: metrics.residual_autocorrelation(monthly_pairs(t), "month", 3).select(F.round("RFLAUT", 6).alias("value")))
query("wn_16", f"{PAIRS} SELECT strftime(month, '%Y-%m-%d') AS month, (r < 0) <> (rb < 0) AS flips FROM q")(lambda t: metrics.prepared(monthly_pairs(t), "month").select(c("month").cast("string").alias("month"), ((c("o") - c("m") < 0) != (c("r_before") < 0)).alias("flips")))
query("wn_17", f"{PAIRS} SELECT CAST(k AS INT) AS rank, round(a.o, 6) AS o, round(b.m, 6) AS m FROM (SELECT o, row_number() OVER (ORDER BY o) AS k FROM p) a JOIN (SELECT m, row_number() OVER (ORDER BY m) AS k FROM p) b USING (k)")(
    lambda t: metrics.sorted_pairs(monthly_pairs(t)).select("rank", F.round("o", 6).alias("o"), F.round("m", 6).alias("m"))
)
query("wn_19", "SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY sum(p_size) DESC, p_brand) AS INT) AS rank FROM part GROUP BY 1, 2")(
    lambda t: t.part.groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("s")).select("p_brand", "p_type", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("s"), "p_brand")).alias("rank"))
)
query("wn_21", "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS id FROM supplier")(lambda t: t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("id")))
query("st_2", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 30")(lambda t: t.orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(30))
query("st_9", "SELECT p_partkey FROM part ORDER BY p_name DESC, p_partkey LIMIT 25 OFFSET 25")(lambda t: relational.page(t.part, 2, 25, [F.desc("p_name"), c("p_partkey")]).select("p_partkey"))

# Row changes and schemas

query("so_9", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 50000) SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY 1")(
    lambda t: t.spark.sql("WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 50000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY 1", orders=t.orders)
)
def _insert_select(spark, name, t):
    spark.sql("INSERT INTO " + name + " (s_suppkey, s_name) SELECT c_custkey + 1000000, c_name FROM {new} WHERE c_acctbal < 0", new=t.customer)


query("so_13", f"{_SMALL} UNION ALL SELECT c_custkey + 1000000, c_name, NULL FROM customer WHERE c_acctbal < 0")(lambda t: _stored(t, _suppliers(t), lambda spark, name: _insert_select(spark, name, t)))


def _returning(t):
    name = stored.create(_suppliers(t), stored.fresh_name("t"))
    new = stored.insert(t.spark, name, t.nation.where("n_regionkey = 2").select((c("n_nationkey") + 1000000).alias("s_suppkey"), c("n_name").alias("s_name"))).select("s_suppkey", "s_name")
    stored.drop(t.spark, name)
    return new


query("so_18", "SELECT n_nationkey + 1000000 AS s_suppkey, n_name AS s_name FROM nation WHERE n_regionkey = 2")(_returning)
query("so_19", "SELECT p_partkey, p_size FROM part")(lambda t: _stored(t, t.part.where("false").select("p_partkey", "p_size"), *[lambda spark, name, k=k: stored.insert(spark, name, t.part.where(F.pmod(F.xxhash64("p_partkey"), F.lit(4)) == k)) for k in range(4)]))
query("so_22", "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")(lambda t: _stored(t, t.spark.sql("SELECT p_brand, count(*) AS n, sum(p_size) AS size FROM {part} GROUP BY 1", part=t.part)))


def _life(t):
    """What a table is like after it was made, emptied and dropped."""
    name, seen = stored.fresh_name("t"), []
    see = lambda step: seen.append((step, t.spark.catalog.tableExists(name), t.spark.table(name).count() if t.spark.catalog.tableExists(name) else None))
    stored.create(t.region, name)
    see("create")
    stored.delete(t.spark, name)
    see("truncate")
    stored.drop(t.spark, name)
    see("drop")
    return t.spark.createDataFrame(seen, "step string, there boolean, n long")


query("so_23", "SELECT 'create' AS step, true AS there, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'truncate', true, 0 UNION ALL SELECT 'drop', false, NULL")(_life)
query("so_25", "SELECT n_nationkey AS id, upper(n_name) AS n_name FROM nation")(lambda t: schema.migrate(t.nation.select("n_nationkey", "n_name"), [("rename", "n_nationkey", "id")]).withColumn("n_name", F.upper("n_name")))
query("so_26", "SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS region, 1 AS version FROM nation")(
    lambda t: schema.upgrade(t.nation.select("n_nationkey", "n_regionkey"), "1.1", [("1.1", "1.2", [("rename", "n_regionkey", "region"), ("alter", "region", "double")]), ("1.2", "2.0", [("add", "version", "int", 1)])])[0]
)
query("so_28", "SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', true)) v(name, type, nullable)")(lambda t: schema.describe(t.region.select(c("r_regionkey").cast("int").alias("r_regionkey"), "r_name")).select("name", "type", "nullable"))
_KEYS = ", ".join(f"('{a}', '{b}')" for (a, _), (b, _) in FOREIGN.items())


def _keys(t):
    return t.spark.createDataFrame([(a, b) for (a, _), (b, _) in FOREIGN.items()], "name string, parent string")


query("st_17", f"WITH RECURSIVE k(name, parent) AS (VALUES {_KEYS}), r AS (SELECT name, parent FROM k UNION SELECT r.name, k.parent FROM r JOIN k ON r.parent = k.name), n AS (SELECT name FROM k UNION SELECT parent FROM k) SELECT name, CAST(row_number() OVER (ORDER BY (SELECT count(*) FROM r WHERE r.name = n.name), name) AS INT) AS place FROM n")(lambda t: stored.in_order(_keys(t)))
query("gr_19", f"WITH RECURSIVE k(name, parent) AS (VALUES {_KEYS}), r AS (SELECT name, parent, 1 AS depth FROM k UNION ALL SELECT r.name, k.parent, depth + 1 FROM r JOIN k ON r.parent = k.name) SELECT name, parent, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2")(
    lambda t: network.closure(_keys(t), "name", "parent").select(c("node").alias("name"), c("down").alias("parent"), "depth")
)
query("so_29", "SELECT p_brand AS key, CASE WHEN p_brand = 'Brand#11' THEN 'new' ELSE 'old' END AS value FROM (SELECT DISTINCT p_brand FROM part)")(
    lambda t: schema.put(t.part.select(c("p_brand").alias("key")).distinct().withColumn("value", F.lit("old")), t.spark.createDataFrame([("Brand#11", "new")], "key string, value string"))
)
for _number, _factor in ((32, 1.5), (33, 0.8), (34, 1.2), (35, 2.5)):
    query(f"so_{_number}", f"SELECT p_partkey, p_retailprice / 2.0 * {_factor} AS x FROM part")(lambda t, factor=_factor: t.part.select("p_partkey", (c("p_retailprice") / 2.0 * factor).alias("x")))
query("so_37", "SELECT 1 AS worker, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 2, s_suppkey FROM supplier WHERE s_suppkey % 2 = 1")(
    lambda t: t.supplier.where("s_suppkey % 2 = 0").select(F.lit(1).alias("worker"), "s_suppkey").unionByName(t.supplier.where("s_suppkey % 2 = 1").select(F.lit(2).alias("worker"), "s_suppkey"))
)
query("so_38", "SELECT p_brand, p_type AS key, CAST(count(*) AS BIGINT) AS value FROM part GROUP BY 1, 2")(
    lambda t: t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m")).select("p_brand", F.explode("m").alias("key", "value"))
)

# JSON and functions

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
query("fn_6", "SELECT item_id, text FROM benchmark")(lambda t: t.benchmark.select("item_id", documents.unpack(documents.pack(c("text"))).alias("text")))
query("fn_25", "SELECT p_partkey, CASE length(CAST(p_partkey AS VARCHAR)) WHEN 4 THEN 'year' WHEN 3 THEN 'other' ELSE 'short' END AS kind FROM part")(
    lambda t: t.part.select("p_partkey", F.when(F.length(c("p_partkey").cast("string")) == 4, "year").when(F.length(c("p_partkey").cast("string")) == 3, "other").otherwise("short").alias("kind"))
)
query("fn_27", f"SELECT event_id, {_K} AS k, 'x' AS z FROM events")(lambda t: t.events.select("event_id", documents.set_key(c("props"), "z", F.lit("x")).alias("p")).select("event_id", F.get_json_object("p", "$.k").cast("int").alias("k"), F.get_json_object("p", "$.z").alias("z")))
query("fn_28", f"SELECT event_id, '{{\"k\":' || {_K} || ',\"n\":{{\"a\":1}}}}' AS p FROM events")(lambda t: t.events.select("event_id", documents.patch(c("props"), F.lit('{"n":{"a":1,"b":null}}')).alias("p")))
query("fn_33", f"SELECT event_id, '$' AS path, 'object' AS kind, NULL AS atom FROM events UNION ALL SELECT event_id, '$.k', 'integer', CAST({_K} AS VARCHAR) FROM events")(lambda t: documents.tree(t.events, "event_id", "props"))
query("fn_34", f"SELECT event_id, {_K} = 3 AS has FROM events")(lambda t: t.events.select("event_id", documents.holds(c("props"), F.lit('{"k":3}')).alias("has")))
query("fn_35", f"SELECT event_id FROM events WHERE {_K} = event_id % 9")(lambda t: t.events.where(documents.same_document(c("props"), F.format_string('{ "k" : %d }', c("event_id") % 9))).select("event_id"))


def _deep(t):
    """Documents with an object and a list inside; every third has another key."""
    return t.events.select("event_id", F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": {"a": '), (c("event_id") % 5).cast("string"), F.lit('}, "l": [7, "x"]'), F.when(c("event_id") % 3 == 0, ', "z": null').otherwise(""), F.lit("}")).alias("d"))


query("fn_36", f"SELECT event_id, '{{\"a\":' || event_id % 5 || '}}' AS arrow, CAST(event_id % 5 AS VARCHAR) AS arrow_text, event_id % 5 = 2 AS holds, true AS has_k, event_id % 3 = 0 AS has_all, event_id % 3 = 0 AS has_any, '{{\"k\":' || {_K} || ',\"t\":{{}},\"l\":[7,\"x\"]' || CASE WHEN event_id % 3 = 0 THEN ',\"z\":null' ELSE '' END || '}}' AS without FROM events")(
    lambda t: _deep(t).select("event_id", documents.at_path(c("d"), "t").alias("arrow"), documents.text_at(c("d"), "t", "a").alias("arrow_text"), documents.holds(c("d"), F.lit('{"t": {"a": 2}}')).alias("holds"), documents.has_keys(c("d"), ["k"]).alias("has_k"), documents.has_keys(c("d"), ["k", "z"]).alias("has_all"), documents.has_keys(c("d"), ["y", "z"], every=False).alias("has_any"), documents.without_path(c("d"), "t", "a").alias("without"))
)
query("fn_37", f"SELECT event_id, CAST(event_id % 5 AS INT) AS a, 'x' AS second FROM events WHERE event_id % 5 > 1")(
    lambda t: _deep(t).select("event_id", documents.text_at(c("d"), "t", "a").cast("int").alias("a"), documents.text_at(c("d"), "l", 1).alias("second")).where("a > 1")
)
query("fn_54", "SELECT p_brand, CAST(count(DISTINCT p_size) AS BIGINT) AS n FROM part GROUP BY 1")(
    lambda t: t.part.groupBy("p_brand").agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(c("p_size")))).alias("n"))
)
query("fn_50")(lambda t: t.part.select("p_partkey", F.xxhash64("p_name").alias("x"), F.crc32("p_name").alias("c")))
query("fn_9", f"SELECT p_partkey, CAST(floor({uniform_sql(3, 'p_partkey')} * 10) * 5 AS BIGINT) AS x FROM part")(
    lambda t: t.part.select("p_partkey", (F.floor(sampling.uniform("p_partkey", seed=3) * 10) * 5).alias("x"))
)
query("fn_10", f"SELECT p_partkey, round(({normal_inverse_sql()}) * 2 + 1, 7) AS x FROM (SELECT p_partkey, {uniform_sql(3, 'p_partkey')} AS u FROM part)")(
    lambda t: t.part.select("p_partkey", F.round(sampling.normal_inverse(sampling.uniform("p_partkey", seed=3)) * 2 + 1, 7).alias("x"))
)


def _sql(t, statement, **tables):
    documents.register(t.spark)
    return t.spark.sql(statement, **tables)


query("ud_1", "SELECT n_name, n_name AS again FROM nation")(lambda t: _sql(t, "SELECT n_name, zunpack(zpack(n_name)) AS again FROM {nation}", nation=t.nation))
query("ud_7", "SELECT * FROM (VALUES ('countdown'), ('product'), ('zpack'), ('zunpack')) v(name)")(
    lambda t: (lambda names: t.spark.createDataFrame([(n,) for n in names if t.spark.catalog.functionExists(n)], "name string"))(documents.register(t.spark))
)
query("ud_2", "SELECT n_regionkey, round(product(n_nationkey + 1), 4) AS p FROM nation GROUP BY 1")(lambda t: _sql(t, "SELECT n_regionkey, round(product(n_nationkey + 1), 4) AS p FROM {nation} GROUP BY 1", nation=t.nation))
query("ud_3", "SELECT n_name FROM nation ORDER BY lower(n_name) LIMIT 5")(lambda t: t.nation.select("n_name").orderBy(F.collate(c("n_name"), "UTF8_LCASE")).limit(5))
for _name in ("ud_4", "wn_10"):
    query(_name, "SELECT n_nationkey, round(product(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 4) AS p FROM nation")(lambda t: _sql(t, "SELECT n_nationkey, round(product(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 4) AS p FROM {nation}", nation=t.nation))
query("ud_5", "SELECT r_regionkey, CAST(k AS INT) AS k, CAST(k * k AS INT) AS v FROM region, range(1, 6) x(k) WHERE k <= r_regionkey")(lambda t: _sql(t, "SELECT r_regionkey, k, v FROM {region}, LATERAL countdown(cast(r_regionkey AS INT))", region=t.region))
# A cursor's batches, each of which a reader can fetch by its first and last key.
query("ud_10", "SELECT CAST((k - 1) // 1000 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")(
    lambda t: writers.numbered(t.orders.select("o_orderkey"), ["o_orderkey"], "k").groupBy(F.expr("(k - 1) div 1000").alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
)
query("ud_11", "SELECT n_nationkey, n_nationkey || '|' || n_name AS tuple, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS dict, n_name AS field FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.array(c("n_nationkey").cast("string"), c("n_name")).alias("tuple"), F.create_map(F.lit("n_nationkey"), c("n_nationkey").cast("string"), F.lit("n_name"), c("n_name")).alias("dict"), F.struct("n_nationkey", "n_name").alias("object"))
    .select("n_nationkey", F.array_join("tuple", "|").alias("tuple"), F.to_json(F.struct(c("dict")["n_nationkey"].cast("int").alias("n_nationkey"), c("dict")["n_name"].alias("n_name"))).alias("dict"), c("object.n_name").alias("field"))
)
