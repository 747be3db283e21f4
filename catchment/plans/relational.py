"""Projection, predicates, joins, grouping, windows, sorting, set operations and row changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catchment.operators import aggregates as agg
from catchment.operators import relational as rel
from catchment.plans.registry import query



def c(name):
    return F.col(name)


# Projection and predicates

query("prj_1", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")(lambda t: t.customer.select("c_custkey", (c("c_acctbal") * 2).alias("twice")))
query("prj_2", "SELECT *, c_acctbal + 1 AS more FROM customer")(lambda t: t.customer.select("*", (c("c_acctbal") + 1).alias("more")))
query("prj_3", "SELECT n_name AS nation FROM nation")(lambda t: t.nation.select(c("n_name").alias("nation")))
query("prj_4", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(
    lambda t: t.nation.alias("a").join(t.nation.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"))
)
query("prj_5", "SELECT c_custkey, TRY_CAST(c_mktsegment AS DOUBLE) AS x, CAST(c_custkey AS VARCHAR) AS s FROM customer")(
    lambda t: t.customer.select("c_custkey", c("c_mktsegment").try_cast("double").alias("x"), c("c_custkey").cast("string").alias("s"))
)
query("prj_6", "SELECT c_custkey FROM customer WHERE c_acctbal > 100 AND c_mktsegment = 'BUILDING'")(lambda t: t.customer.where("c_acctbal > 100").where("c_mktsegment = 'BUILDING'").select("c_custkey"))
query("prj_7", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_acctbal < -900 OR c_nationkey = 3")(lambda t: t.customer.where(rel.any_of(c("c_acctbal") > 9000, c("c_acctbal") < -900, c("c_nationkey") == 3)).select("c_custkey"))
query("prj_8", "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_nationkey IN (1, 2, 3) AND c_name LIKE '%7%'")(
    lambda t: rel.keyword_filter(t.customer, c_acctbal__gte=1000, c_nationkey__in=[1, 2, 3], c_name__like="*7*").select("c_custkey")
)
query("prj_9", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 5000 AND regexp_matches(o_orderpriority, '^[12]')")(
    lambda t: rel.keyword_filter(t.orders, o_orderstatus__ne="F", o_totalprice__lt=5000, o_orderpriority__regexp="^[12]").select("o_orderkey")
)
query("prj_10", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 1 OR (c_acctbal > 0 AND c_nationkey <> 2))")(lambda t: t.customer.where(~((c("c_nationkey") == 1) | ((c("c_acctbal") > 0) & (c("c_nationkey") != 2)))).select("c_custkey"))
query("prj_11", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS missing, nullif(c_nationkey, 3) IS NOT DISTINCT FROM NULL AS same FROM customer")(
    lambda t: t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(3)).isNull().alias("missing"), F.nullif(c("c_nationkey"), F.lit(3)).eqNullSafe(F.lit(None)).alias("same"))
)
query("prj_12", "SELECT count(*) AS n FROM customer WHERE (c_acctbal > 0 AND c_nationkey < 10) OR NOT c_mktsegment = 'BUILDING'")(
    lambda t: t.customer.where(((c("c_acctbal") > 0) & (c("c_nationkey") < 10)) | ~(c("c_mktsegment") == "BUILDING")).agg(F.count("*").alias("n"))
)
query("prj_13", "SELECT p_partkey, p_size // 7 AS whole, p_size / 7 AS part, p_size / nullif(p_size - 7, 0) AS safe FROM part")(
    lambda t: t.part.select("p_partkey", F.expr("cast(p_size div 7 as int)").alias("whole"), (c("p_size") / 7).alias("part"), F.try_divide(c("p_size"), c("p_size") - 7).alias("safe"))
)
query("prj_14", "SELECT p_partkey, p_size % 5 AS m, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 3) AS x, ~p_size AS n FROM part")(
    lambda t: t.part.select("p_partkey", (c("p_size") % 5).alias("m"), c("p_size").bitwiseAND(6).alias("a"), c("p_size").bitwiseOR(8).alias("o"), c("p_size").bitwiseXOR(3).alias("x"), F.bitwise_not("p_size").alias("n"))
)
query("prj_15", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(lambda t: t.customer.join(t.nation.where("n_regionkey = 1"), c("c_nationkey") == c("n_nationkey"), "left_semi").select("c_custkey"))
query("prj_16", "SELECT count(*) FILTER (WHERE false) AS none, count(*) AS everyone FROM customer")(
    lambda t: t.customer.agg(F.count(F.when(rel.among(c("c_nationkey"), []), 1)).alias("none"), F.count(F.when(rel.not_among(c("c_nationkey"), []), 1)).alias("everyone"))
)
query("prj_17", "SELECT count(*) FILTER (WHERE x IS NULL) AS missing, count(*) FILTER (WHERE x IS NOT NULL) AS known FROM (SELECT nullif(c_nationkey, 5) AS x FROM customer)")(
    lambda t: t.customer.select(F.nullif(c("c_nationkey"), F.lit(5)).alias("x")).agg(F.count(F.when(c("x").isNull(), 1)).alias("missing"), F.count("x").alias("known"))
)
query("prj_18", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")(lambda t: t.orders.where(c("o_totalprice").between(1000, 50000)).select("o_orderkey"))
query("prj_19", "SELECT p_partkey FROM part WHERE p_brand GLOB '*[13]?'")(lambda t: t.part.where(rel.glob(c("p_brand"), "*[13]?")).select("p_partkey"))
query("prj_20", "SELECT p_partkey FROM part WHERE p_type ILIKE '%e%l'")(lambda t: t.part.where(c("p_type").ilike("%e%l")).select("p_partkey"))
query("prj_21", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%R_0%'")(lambda t: t.customer.where(rel.contains(c("c_name"), "R_0")).select("c_custkey"))
query("prj_22", "SELECT n_name FROM nation WHERE n_name ILIKE 'n%'")(lambda t: t.nation.where(rel.starts(c("n_name"), "n")).select("n_name"))
query("prj_23", "SELECT n_name FROM nation WHERE n_name ILIKE '%1'")(lambda t: t.nation.where(rel.ends(c("n_name"), "1")).select("n_name"))
query("prj_24", "SELECT url FROM pages WHERE regexp_matches(url, '^https?://(www|blog)[.].*html$')")(lambda t: t.pages.where(c("url").rlike("^https?://(www|blog)[.].*html$")).select("url"))
query("prj_25", "SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)released UNDER')")(lambda t: t.documents.where(c("text").rlike("(?i)released UNDER")).agg(F.count("*").alias("n")))
query("prj_26", "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS tag FROM orders")(lambda t: t.orders.select("o_orderkey", F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("tag")))
query("prj_27", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")(lambda t: t.customer.where(F.collate(c("c_mktsegment"), "UTF8_LCASE") == F.lit("building")).agg(F.count("*").alias("n")))
query("prj_28", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'fine' END AS class FROM customer")(
    lambda t: t.customer.select("c_custkey", F.when(c("c_acctbal") < 0, "debt").when(c("c_acctbal") < 1000, "low").otherwise("fine").alias("class"))
)
query("prj_29", "SELECT r_regionkey, 7 AS seven, 'x' AS x FROM region")(lambda t: t.region.select("r_regionkey", F.lit(7).alias("seven"), F.lit("x").alias("x")))
query("prj_30", "SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")(lambda t: t.part.select("p_partkey", F.expr("p_size * 2 + 1").alias("odd")))
query("prj_31", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")(lambda t: t.spark.sql("SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY 1", nation=t.nation))
query("prj_32", "SELECT c_custkey FROM customer WHERE NOT c_acctbal > 0")(lambda t: t.customer.where(~(c("c_acctbal") > 0)).select("c_custkey"))
query("prj_33", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(id, name)")(lambda t: t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(id, name)"))
query("prj_34", "SELECT n_nationkey, upper(n_name) AS name, length(n_name) AS size FROM nation")(lambda t: t.nation.select("n_nationkey", F.call_function("upper", c("n_name")).alias("name"), F.call_function("length", c("n_name")).alias("size")))
query("prj_35", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 1000 GROUP BY 1")(
    lambda t: t.lineitem.withColumn("net", c("l_extendedprice") * (1 - c("l_discount"))).where("net > 1000").groupBy("l_returnflag").agg(F.round(F.sum("net"), 2).alias("net"))
)

# Joins

query("jn_1", "SELECT CAST(count(*) AS BIGINT) AS n FROM supplier JOIN part ON s_suppkey < p_partkey AND p_size > s_suppkey")(
    # Below both, where neither is null, is below the lesser.
    lambda t: rel.pairs_below(t.supplier.select(c("s_suppkey").alias("value")), t.part.where("p_partkey is not null and p_size is not null").select(F.least("p_partkey", c("p_size").cast("long")).alias("value")))
)
for _number, _how, _sql in ((2, "inner", "JOIN"), (3, "left", "LEFT JOIN"), (4, "right", "RIGHT JOIN"), (5, "full", "FULL JOIN")):
    query(f"jn_{_number}", f"SELECT d.doc_id, l.doc_id AS label_id, l.toxic FROM (SELECT * FROM documents WHERE n_chars > 500) d {_sql} labels l ON d.doc_id = l.doc_id")(
        lambda t, how=_how: t.documents.where("n_chars > 500").alias("d").join(t.labels.alias("l"), c("d.doc_id") == c("l.doc_id"), how).select("d.doc_id", c("l.doc_id").alias("label_id"), "l.toxic")
    )
query("jn_6", "SELECT r_name, s_suppkey FROM region CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")(lambda t: t.region.select("r_name").crossJoin(t.supplier.where("s_acctbal > 5000").select("s_suppkey")))
query("jn_7", "SELECT n_name, x.name FROM nation, LATERAL (SELECT r_name AS name FROM region WHERE r_regionkey = n_regionkey) x")(
    lambda t: t.spark.sql("SELECT n_name, x.name FROM {nation}, LATERAL (SELECT r_name AS name FROM {region} WHERE r_regionkey = n_regionkey) x", nation=t.nation, region=t.region)
)
query("jn_8", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name"))
query("jn_10", "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(
    lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
)
query("jn_13", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda t: rel.prefetch(t.customer.select("c_custkey"), t.orders.select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey", "list", ["o_orderkey"]).select(
        "c_custkey", F.size("list").cast("long").alias("n"), F.array_join(F.transform("list", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders")
    )
)
query("jn_14", "SELECT DISTINCT s_suppkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey")(
    lambda t: t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.part, c("l_partkey") == c("p_partkey")).select("s_suppkey", "p_brand").distinct()
)
query("jn_15", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")(lambda t: t.orders.where("o_custkey = 7").select("o_orderkey"))
query("jn_16", "SELECT a.p_partkey AS child, b.p_partkey AS parent FROM part a JOIN part b ON (a.p_partkey - 1) // 2 = b.p_partkey WHERE a.p_partkey > 0")(
    lambda t: t.part.alias("a").where("p_partkey > 0").join(t.part.alias("b"), F.expr("(a.p_partkey - 1) div 2 = b.p_partkey")).select(c("a.p_partkey").alias("child"), c("b.p_partkey").alias("parent"))
)
query("jn_17", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")(
    lambda t: t.customer.join(t.orders.where("o_totalprice > 100000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_mktsegment").distinct()
)
query(
    "jn_18",
    "SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2))) AND o_orderstatus = 'O'",
)(
    lambda t: t.orders.where("o_orderstatus = 'O'")
    .join(t.customer.join(t.nation.join(t.region.where("r_regionkey < 2"), c("n_regionkey") == c("r_regionkey"), "left_semi"), c("c_nationkey") == c("n_nationkey"), "left_semi"), c("o_custkey") == c("c_custkey"), "left_semi")
    .select("o_orderkey")
    .distinct()
)
query("jn_19", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) AND l_returnflag = 'R'")(
    lambda t: t.lineitem.where("l_returnflag = 'R'").join(t.part.where("p_size < 5"), c("l_partkey") == c("p_partkey"), "left_semi").select("l_suppkey").distinct()
)
query("jn_20", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%99%' OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name ILIKE '%1%')")(
    lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    .join(t.nation.where(rel.contains(c("n_name"), "1")).select(c("n_nationkey").alias("hit")), c("c_nationkey") == c("hit"), "left")
    .where(rel.contains(c("c_name"), "99") | c("hit").isNotNull())
    .select("o_orderkey")
)
query("jn_22", "SELECT a.s_suppkey, n.n_name AS home, m.n_name AS other FROM supplier a LEFT JOIN nation n ON s_nationkey = n.n_nationkey LEFT JOIN nation m ON m.n_nationkey = s_nationkey + 1")(
    lambda t: t.supplier.join(t.nation.select(c("n_nationkey").alias("a"), c("n_name").alias("home")), c("s_nationkey") == c("a"), "left")
    .join(t.nation.select(c("n_nationkey").alias("b"), c("n_name").alias("other")), c("s_nationkey") + 1 == c("b"), "left")
    .select("s_suppkey", "home", "other")
)
for _number, _table, _key, _nation in ((21, "customer", "c_custkey", "c_nationkey"), (23, "supplier", "s_suppkey", "s_nationkey")):
    query(f"jn_{_number}", f"SELECT {_key}, n_name, r_name FROM {_table} LEFT JOIN nation ON {_nation} = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")(
        lambda t, table=_table, key=_key, nation=_nation: getattr(t, table).join(t.nation, c(nation) == c("n_nationkey"), "left").join(t.region, c("n_regionkey") == c("r_regionkey"), "left").select(key, "n_name", "r_name")
    )
query("jn_26", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")(
    lambda t: t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "l_quantity")
)
query("jn_32", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS first_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(
    lambda t: rel.distinct_on(t.orders, ["o_custkey"], [c("o_orderkey")]).join(t.customer, c("o_custkey") == c("c_custkey")).select("o_custkey", c("o_totalprice").alias("first_price"))
)
query("jn_34", "SELECT CAST(count(*) AS BIGINT) AS days, round(sum(o - s), 2) AS gap FROM (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS o FROM orders GROUP BY 1) JOIN (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1) USING (d)")(
    lambda t: t.orders.groupBy(c("o_orderdate").cast("date").alias("d")).agg(F.avg("o_totalprice").alias("o"))
    .join(t.lineitem.groupBy(c("l_shipdate").cast("date").alias("d")).agg(F.avg("l_extendedprice").alias("s")), "d").na.drop()
    .agg(F.count("*").alias("days"), F.round(F.sum(c("o") - c("s")), 2).alias("gap"))
)
query("jn_36", "SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(CAST(toxic AS VARCHAR), 'NA') AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce(c("toxic").cast("string"), F.lit("NA")).alias("toxic"))
)
query("jn_37", "SELECT a.n_name FROM nation a JOIN (SELECT lower(n_name) AS low FROM nation WHERE n_regionkey = 2) b ON lower(a.n_name) = b.low")(
    lambda t: t.nation.join(t.nation.where("n_regionkey = 2").select(F.lower("n_name").alias("low")), F.lower("n_name") == c("low")).select("n_name")
)
query("jn_41", "SELECT o_custkey AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda t: t.orders.join(t.customer.where("c_acctbal > 0"), c("o_custkey") == c("c_custkey"), "left_anti").select(c("o_custkey").alias("missing"))
)
query("jn_42", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")(lambda t: t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id"))

# Grouping

query("ag_1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")(lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.count("*").alias("n")))
query("ag_2", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")(lambda t: t.orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n")))
query("ag_3", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) > 1000")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")).where("n > 12 and s > 1000").select("o_custkey", "n")
)
query("ag_4", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")(lambda t: rel.distinct_on(t.orders, ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")]).select("o_custkey", "o_orderkey"))
query("ag_5", "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem")(lambda t: t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines")))
query("ag_6", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS q FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.expr("sum(l_quantity) FILTER (WHERE l_discount > 0.05)"), 2).alias("q")))
query("ag_7", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber").distinct().agg(F.count("*").alias("n")))
query("ag_8", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e12) AS large, EXISTS (SELECT 1 FROM orders) AS some")(
    lambda t: t.orders.agg((F.count(F.when(c("o_totalprice") > 1e12, 1)) > 0).alias("large"), (F.count("*") > 0).alias("some"))
)
query("ag_9", "SELECT max(o_totalprice) AS top FROM orders")(lambda t: t.orders.agg(F.max("o_totalprice").alias("top")))
query("ag_10", "SELECT lower(o_orderstatus) AS s, round(sum(o_totalprice), 2) AS a, min(o_totalprice) AS b, max(o_totalprice) AS c, round(avg(o_totalprice), 4) AS d, CAST(count(*) AS BIGINT) AS e FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy(F.lower("o_orderstatus").alias("s")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"), F.min("o_totalprice").alias("b"), F.max("o_totalprice").alias("c"), F.round(F.avg("o_totalprice"), 4).alias("d"), F.count("*").alias("e"))
)
query("ag_11", "SELECT p_type, lower(p_type) AS name, CAST(sum(p_size) AS BIGINT) AS area FROM part GROUP BY p_type")(lambda t: t.part.groupBy("p_type").agg(F.sum("p_size").alias("area")).withColumn("name", F.lower("p_type")))
query("ag_12", "SELECT s_nationkey, round(avg(s_acctbal), 6) AS x, round(avg(s_suppkey), 6) AS y FROM supplier GROUP BY 1")(lambda t: t.supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 6).alias("x"), F.round(F.avg("s_suppkey"), 6).alias("y")))
query("ag_13", "SELECT max(p_partkey) AS id FROM part")(lambda t: t.part.agg(F.max("p_partkey").alias("id")))
query("ag_14", "SELECT round(sum(l_quantity), 2) AS a, round(sum(l_extendedprice), 2) AS b, round(sum(l_discount), 2) AS c, round(sum(l_tax), 2) AS d FROM lineitem")(
    lambda t: t.lineitem.agg(*[F.round(F.sum(x), 2).alias(y) for x, y in zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "abcd")])
)
query("ag_15", "SELECT round(sum(o_totalprice) FILTER (WHERE o_orderpriority ILIKE '%high%'), 2) AS high FROM orders")(lambda t: t.orders.agg(F.round(F.sum(F.when(rel.contains(c("o_orderpriority"), "high"), c("o_totalprice"))), 2).alias("high")))
query("ag_16", "SELECT coalesce(nullif(p_type, 'ECONOMY'), 'NA') AS land, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")(
    lambda t: t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy(F.coalesce(F.nullif(c("p_type"), F.lit("ECONOMY")), F.lit("NA")).alias("land"))
    .agg(F.round(agg.weighted_mean("l_extendedprice", "l_quantity"), 6).alias("mean"), F.round(agg.weighted_mean("l_discount", "l_quantity"), 6).alias("rate"))
)
query("ag_27", "SELECT event_type, round(quantile_cont(value, 0.85), 6) AS p85, round(quantile_cont(value, 0.1), 6) AS p10 FROM events GROUP BY 1")(lambda t: agg.exact_percentiles(t.events, ["event_type"], "value", {"p85": 0.85, "p10": 0.1}).select("event_type", F.round("p85", 6).alias("p85"), F.round("p10", 6).alias("p10")))
_EPOCH = "epoch_us(ts) / 1e6"
_TIMES = f"SELECT user_id, round(min(gap), 6) AS least_gap, round(CASE WHEN count(*) = 1 THEN 0 ELSE (max(s) - min(s)) / (count(*) - 1) END, 6) AS mean_gap, round(max(s) - min(s), 6) AS duration FROM (SELECT user_id, {_EPOCH} AS s, {_EPOCH} - lag({_EPOCH}) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY 1"
query("ag_30", f"SELECT user_id, least_gap FROM ({_TIMES})")(lambda t: agg.time_gaps(t.events, ["user_id"], "ts").select("user_id", F.round("least_gap", 6).alias("least_gap")))
query("ag_31", f"SELECT user_id, mean_gap FROM ({_TIMES})")(lambda t: agg.time_gaps(t.events, ["user_id"], "ts").select("user_id", F.round("mean_gap", 6).alias("mean_gap")))
query("ag_32", f"SELECT user_id, duration FROM ({_TIMES})")(lambda t: agg.time_gaps(t.events, ["user_id"], "ts").select("user_id", F.round("duration", 6).alias("duration")))
query("ag_33", "SELECT user_id, arg_max(event_type, (n, -f)) AS mode FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")(lambda t: agg.mode_first(t.events, ["user_id"], "event_type", "event_id"))
_GAPS = "SELECT user_id, round(coalesce(min(gap), 0), 6) AS least_gap, round(CASE WHEN count(*) = 1 THEN 0 ELSE (max(value) - min(value)) / (count(*) - 1) END, 6) AS mean_gap, round(max(value) - min(value), 6) AS span FROM (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM events) GROUP BY 1"
for _number, _name in ((34, "least_gap"), (35, "mean_gap"), (36, "span")):
    query(f"ag_{_number}", f"SELECT user_id, {_name} FROM ({_GAPS})")(lambda t, name=_name: agg.gaps(t.events, ["user_id"], "value").select("user_id", F.round(name, 6).alias(name)))
query("ag_37", "SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY 1")(lambda t: agg.exact_percentiles(t.events, ["event_type"], "value", {"m": 0.5}).select("event_type", F.round("m", 6).alias("m")))
query("ag_38", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")(
    lambda t: t.nation.alias("a").join(t.nation.alias("b"), c("a.n_nationkey") < c("b.n_nationkey")).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("d"))
)
query("ag_39", "SELECT round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, round(sum(x * x), 2) AS sxx, round(sum(y * y), 6) AS syy, round(sum(x * y), 4) AS sxy FROM (SELECT l_quantity AS x, l_discount AS y FROM lineitem)")(
    lambda t: t.lineitem.select(c("l_quantity").alias("x"), c("l_discount").alias("y")).na.drop().agg(F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"), F.round(F.sum(c("x") * c("x")), 2).alias("sxx"), F.round(F.sum(c("y") * c("y")), 6).alias("syy"), F.round(F.sum(c("x") * c("y")), 4).alias("sxy"))
)
query("ag_40", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r")))
query("ag_53", "SELECT p_brand, min(p_size) AS low, max(p_size) AS high, CAST(count(*) AS BIGINT) AS n, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS deviation FROM part GROUP BY 1")(
    lambda t: agg.histogram_moments(t.part, ["p_brand"], "p_size").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})
)
query("ag_54", "SELECT p_size, CAST(count(*) AS BIGINT) AS f, round(100.0 * sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")(
    lambda t: t.part.groupBy("p_size").agg(F.count("*").alias("f")).withColumn("share", F.round(100.0 * F.sum("f").over(Window.orderBy("p_size")) / F.sum("f").over(Window.partitionBy()), 6))
)
query("ag_58", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda t: t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))

# Windows



def by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderkey")


def _over(number: int, sql: str, make) -> None:
    query(f"wn_{number}", f"SELECT o_orderkey, {sql} AS x FROM orders")(lambda t: t.orders.select("o_orderkey", make().alias("x")))


_S = "PARTITION BY o_custkey ORDER BY o_orderkey"
_over(1, f"round(sum(o_totalprice) OVER ({_S}), 4)", lambda: F.round(F.sum("o_totalprice").over(by_customer()), 4))
_over(2, f"round(avg(o_totalprice) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4)", lambda: F.round(F.avg("o_totalprice").over(by_customer().rowsBetween(Window.unboundedPreceding, 0)), 4))
_over(3, f"round(sum(o_totalprice) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)", lambda: F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(-2, 1)), 4))
_over(4, f"CAST(count(*) OVER ({_S} RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS BIGINT)", lambda: F.count("*").over(by_customer().rangeBetween(-1000, 1000)))
query("wn_5", "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM part")(
    lambda t: (lambda d, w: d.select("p_partkey", F.count("*").over(w).alias("n")))(*rel.groups_frame(t.part, "p_size", 2, 0, ["p_brand"]))
)
_UPTO = "PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE"
query("wn_6", "SELECT p_partkey, " + ", ".join(f"CAST(coalesce(sum(p_size) OVER ({_UPTO} {x}), 0) AS BIGINT) AS without_{y}" for x, y in (("CURRENT ROW", "row"), ("GROUP", "group"), ("TIES", "ties"))) + " FROM part")(
    lambda t: t.part.select("p_partkey", *[rel.sum_excluding("p_size", ["p_brand"], "p_size", x).alias(f"without_{x}") for x in ("row", "group", "ties")])
)
query("wn_7", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")(
    lambda t: t.spark.sql("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", orders=t.orders)
)
_over(8, f"round(max(o_totalprice) OVER ({_S} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4)", lambda: F.round(F.max("o_totalprice").over(by_customer().rowsBetween(-3, 0)), 4))
_over(9, f"round(min(o_totalprice) OVER ({_S} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4)", lambda: F.round(F.min("o_totalprice").over(by_customer().rowsBetween(1, Window.unboundedFollowing)), 4))
query("wn_11", f"SELECT o_orderkey, CAST(row_number() OVER ({_S}) AS INT) AS rn, CAST(ntile(4) OVER ({_S}) AS INT) AS nt, round(percent_rank() OVER ({_S}), 8) AS pr, round(cume_dist() OVER ({_S}), 8) AS cd, first_value(o_totalprice) OVER ({_S}) AS fv FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.row_number().over(by_customer()).alias("rn"), F.ntile(4).over(by_customer()).alias("nt"), F.round(F.percent_rank().over(by_customer()), 8).alias("pr"), F.round(F.cume_dist().over(by_customer()), 8).alias("cd"), F.first("o_totalprice").over(by_customer()).alias("fv"))
)
query("wn_18", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part")(lambda t: t.part.select("p_partkey", rel.average_rank("p_size", ["p_brand"]).alias("rank")))
query("wn_20", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS INT) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")(
    lambda t: t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct().withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey")))
)

# Sorting and pages

query("st_1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50))
query("st_3", "SELECT c_custkey, nullif(c_nationkey, 4) AS n FROM customer ORDER BY n DESC NULLS LAST, c_custkey LIMIT 40")(lambda t: t.customer.select("c_custkey", F.nullif(c("c_nationkey"), F.lit(4)).alias("n")).orderBy(F.desc_nulls_last("n"), "c_custkey").limit(40))
query("st_4", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7")(lambda t: t.part.select("p_partkey").orderBy("p_partkey").limit(7))
query("st_5", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 30")(lambda t: t.part.select("p_partkey").orderBy("p_partkey").offset(30).limit(7))
query("st_6", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")(lambda t: rel.page(t.customer, 3, 20, [c("c_acctbal"), c("c_custkey")]).select("c_custkey"))
query("st_7", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")(lambda t: t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(1))
query("st_8", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS total, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') AS matches FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%' ORDER BY c_name DESC, c_custkey LIMIT 50 OFFSET 50")(
    lambda t: rel.paged(t.customer, "1", ["c_name", "c_mktsegment"], [F.desc("c_name"), c("c_custkey")], 2, 50).select("c_custkey", "total", "matches")
)
query("st_10", "(SELECT n_name AS name, 0 AS rank FROM nation WHERE n_name ILIKE 'nation_1%' ORDER BY 1 LIMIT 6) UNION ALL (SELECT n_name, 1 FROM nation WHERE NOT n_name ILIKE 'nation_1%' ORDER BY 1 LIMIT 6)")(lambda t: rel.complete(t.nation, "n_name", "nation_1", 6))
query("st_11", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 10")(lambda t: t.part.select("p_brand").distinct().orderBy("p_brand").limit(10))
query("st_12", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")(lambda t: t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(1))
query("st_16", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS sizes FROM part GROUP BY 1")(lambda t: t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_size")).cast("array<string>"), ",").alias("sizes")))

# Set operations, subqueries and row changes

query("so_1", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")))
query("so_2", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
query("so_3", "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels")(lambda t: t.documents.where("n_chars > 1000").select("doc_id").intersect(t.labels.select("doc_id")))
query("so_4", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(lambda t: t.documents.select("doc_id").subtract(t.labels.select("doc_id")))
query("so_5", "SELECT * FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) ORDER BY k DESC LIMIT 9")(lambda t: t.customer.select(c("c_custkey").alias("k")).union(t.supplier.select("s_suppkey")).orderBy(F.desc("k")).limit(9))
query("so_6", "SELECT avg(n) AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean")))
query("so_7", "WITH top AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_custkey FROM top WHERE s > (SELECT avg(s) * 1.5 FROM top)")(
    lambda t: (lambda top: top.crossJoin(F.broadcast(top.agg((F.avg("s") * 1.5).alias("cut")))).where("s > cut").select("o_custkey"))(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")))
)
query("so_10", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").join(t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top")), c("c_custkey") == c("k"), "left").select("c_custkey", "top")
)


def _two(t):
    """An old and a new state of a small table with keys in common."""
    old = t.supplier.where("s_suppkey % 3 <> 0").select("s_suppkey", "s_name", "s_acctbal")
    new = t.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"), (c("s_acctbal") + 1).alias("s_acctbal"))
    return old, new


_OLD = "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0"
_NEW = "SELECT s_suppkey, s_name || '*' AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0"
query("so_12", f"{_OLD} UNION ALL {_NEW}")(lambda t: (lambda o, n: o.unionByName(n))(*_two(t)))
query("so_14", f"{_OLD} UNION ALL SELECT * FROM ({_NEW}) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_OLD}))")(lambda t: rel.insert_missing(*_two(t), ["s_suppkey"]))
query("so_15", f"SELECT * FROM ({_OLD}) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ({_NEW})) UNION ALL {_NEW}")(lambda t: rel.replace(*_two(t), ["s_suppkey"]))
query("so_16", f"SELECT o.s_suppkey, o.s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (s_suppkey)")(lambda t: rel.update_from(*_two(t), ["s_suppkey"], ["s_acctbal"]))
query("so_17", "SELECT s_suppkey FROM supplier WHERE NOT s_acctbal < 0")(lambda t: t.supplier.where(~(c("s_acctbal") < 0)).select("s_suppkey"))
query("so_20", "SELECT s_suppkey, CASE WHEN s_suppkey < 10 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")(lambda t: rel.update_where(t.supplier, c("s_suppkey") < 10, s_acctbal=0.0).select("s_suppkey", "s_acctbal"))
query("so_21", f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o.s_name, n.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.s_suppkey = n.s_suppkey")(lambda t: rel.upsert(*_two(t), ["s_suppkey"], ["s_acctbal"]))
query("so_27", f"SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'INSERT' WHEN n.s_suppkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.s_suppkey = n.s_suppkey")(
    lambda t: rel.changes(*_two(t), ["s_suppkey"]).select("s_suppkey", "action")
)
query("so_30", "SELECT p_partkey, p_retailprice * 1.25 AS p_retailprice FROM part")(lambda t: t.part.select("p_partkey", (c("p_retailprice") * 1.25).alias("p_retailprice")))
query("so_31", "SELECT p_partkey, 1.5 * pow(p_size / 100.0, 0.6) AS width, 0.3 * pow(p_size / 100.0, 0.4) AS depth FROM part")(lambda t: t.part.select("p_partkey", (1.5 * F.pow(c("p_size") / 100, 0.6)).alias("width"), (0.3 * F.pow(c("p_size") / 100, 0.4)).alias("depth")))
query("so_36", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 40.0 ELSE 60.0 END AS percent FROM lineitem WHERE l_returnflag IN ('R', 'A')")(
    lambda t: t.lineitem.where("l_returnflag in ('R', 'A')").select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_returnflag") == "R", 40.0).otherwise(60.0).alias("percent"))
)
