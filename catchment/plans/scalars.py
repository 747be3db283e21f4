"""Scalar functions: text, time, JSON, arrays, maps, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchment.functions import dates, text
from catchment.operators import bloom
from catchment.plans.registry import query


def c(name):
    return F.col(name)


query("fn_1", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s FROM part")(lambda t: t.part.select("p_partkey", F.when(c("p_size") > 25, "big").otherwise("small").alias("s")))
query("fn_2", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events")(lambda t: t.events.select("event_id", text.strip_zone(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("s")))
_D = "SELECT p_partkey, p_partkey * 977 + 5 AS s FROM part"
query("fn_3", f"SELECT p_partkey, concat_ws(', ', " + ", ".join(f"CASE WHEN {e} > 0 THEN {e} || ' {n}' || CASE WHEN {e} > 1 THEN 's' ELSE '' END END" for n, e in (("day", "s // 86400"), ("hour", "s % 86400 // 3600"), ("minute", "s % 3600 // 60"), ("second", "s % 60"))) + f") AS h FROM ({_D})")(
    lambda t: t.part.select("p_partkey", text.human_duration(c("p_partkey") * 977 + 5).alias("h"))
)
query("fn_4", "SELECT page_id, regexp_extract(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]*)$', 1), '[^.].*?([.][^.]*)$', 1) AS e FROM pages")(
    lambda t: t.pages.select("page_id", text.file_extension(F.regexp_extract("url", "^([^?#]*)", 1)).alias("e"))
)
query("fn_7", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages")(lambda t: t.pages.select("page_id", text.host(c("url")).alias("h")))
query("fn_11", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS r FROM customer")(lambda t: t.customer.select("c_custkey", F.when(c("c_acctbal") >= 0, F.round(F.sqrt("c_acctbal"), 8)).alias("r")))
query("fn_12", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS x, TRY_CAST(o_orderstatus AS DOUBLE) AS y FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("double").alias("x"), c("o_orderstatus").try_cast("double").alias("y"))
)
query("fn_13", "SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INT) AS n FROM documents")(lambda t: t.documents.select("doc_id", text.count_of(c("text"), "th").alias("n")))
query("fn_14", "SELECT p_partkey, trim(p_brand, 'Bd0123') AS s FROM part")(lambda t: t.part.select("p_partkey", F.btrim("p_brand", F.lit("Bd0123")).alias("s")))
query("fn_15", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")(lambda t: t.part.select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_name", 256).alias("s")))
query("fn_16", "SELECT p_partkey, regexp_matches(p_brand, '[24]$') AS m FROM part")(lambda t: t.part.select("p_partkey", c("p_brand").rlike("[24]$").alias("m")))
query("fn_17", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h FROM events")(
    lambda t: t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
)
query("fn_18", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h FROM events")(lambda t: t.events.select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("h")))
query("fn_19", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.date_format(dates.parse_any(F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), ["yyyy-MM-dd", "dd/MM/yyyy"]), "yyyy-MM-dd").alias("d"))
)
query("fn_20", "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events")(lambda t: t.events.select("event_id", F.unix_seconds(c("ts").cast("timestamp")).alias("s")))
query("fn_21", "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders")(lambda t: t.orders.select(F.year("o_orderdate").alias("y")).distinct().withColumn("leap", dates.is_leap(c("y"))))
query("fn_22", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")(lambda t: t.orders.select("o_orderkey", dates.from_julian(F.year("o_orderdate"), F.dayofyear("o_orderdate")).cast("string").alias("d")))
query("fn_23", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d') AS d FROM orders")(lambda t: t.orders.select("o_orderkey", dates.from_julian(F.year("o_orderdate"), F.dayofyear("o_orderdate") + 400).cast("string").alias("d")))
query("fn_24", "SELECT o_orderkey, CAST(year(o_orderdate) * 1000 + dayofyear(o_orderdate) AS INT) AS d, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS m FROM orders")(
    lambda t: t.orders.select("o_orderkey", dates.date_key(F.year("o_orderdate"), F.dayofyear("o_orderdate"), "day").alias("d"), dates.date_key(F.year("o_orderdate"), F.month("o_orderdate"), "month").alias("m"))
)
query("fn_26", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))
query("fn_30", "SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END AS kind FROM events")(lambda t: t.events.select("event_id", F.schema_of_variant(F.expr("variant_get(parse_json(props), '$.k')")).alias("kind")))
query("fn_29", "SELECT event_id, CAST(len(json_keys(props)) - 1 AS INT) AS left_keys FROM events")(lambda t: t.events.select("event_id", F.size(F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k != "k")).alias("left_keys")))
query("fn_31", "SELECT event_id, CAST(json_array_length('[1,' || json_extract_string(props, '$.k') || ',3]') AS INT) AS n FROM events")(lambda t: t.events.select("event_id", F.json_array_length(F.concat(F.lit("[1,"), F.get_json_object("props", "$.k"), F.lit(",3]"))).alias("n")))
query("fn_32", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")(lambda t: t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")))
query("fn_38", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(embedding[2:5]) AS INT) AS n, list_contains(embedding, embedding[3]) AS has FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"), F.size(F.slice("embedding", 2, 4)).alias("n"), F.array_contains("embedding", F.element_at("embedding", 3)).alias("has"))
)
query("fn_39", "SELECT event_id, 'k' AS keys, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS v FROM events")(
    lambda t: t.events.select("event_id", F.array_join(F.map_keys(F.from_json("props", "map<string,string>")), ",").alias("keys"), F.element_at(F.from_json("props", "map<string,string>"), "k").alias("v"))
)
query("fn_40", "SELECT event_id, strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later FROM events")(lambda t: t.events.select("event_id", F.date_format(c("ts") + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("later")))
query("fn_41", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'license')")(lambda t: t.documents.where(F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), "license")).select("doc_id"))
_TERMS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2)"
_BM25 = _TERMS + """, len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS l FROM documents), corpus AS (SELECT count(*) AS n, avg(l) AS a FROM len),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('license', 'the', 'von') GROUP BY 1)
SELECT doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 8) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), corpus GROUP BY 1"""
for _number in (44, 45):
    query(f"fn_{_number}", _BM25)(lambda t: text.bm25(t.documents, "doc_id", "text", ["license", "the", "von"]).select("doc_id", F.round("score", 8).alias("score")))
# Scores to five decimals, so that ties are ties in both; equal ones are ordered by document.
query("fn_42", f"SELECT CAST(row_number() OVER (ORDER BY s, doc_id) AS INT) AS rank, doc_id, s AS score FROM (SELECT doc_id, round(score, 5) AS s FROM ({_BM25}))")(
    lambda t: text.search(t.documents, "doc_id", "text", "the LICENSE, von!").select("rank", "doc_id", "score")
)
query("fn_43", _TERMS + ", g AS (SELECT term, sum(tf) AS g FROM tf GROUP BY 1) SELECT doc_id, round(-sum(tf / g), 10) AS score FROM tf JOIN g USING (term) WHERE term IN ('license', 'von') GROUP BY 1")(
    lambda t: text.simple_rank(t.documents, "doc_id", "text", ["license", "von"]).select("doc_id", F.round("score", 10).alias("score"))
)
query("fn_46", "SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^0-9A-Za-z_]+', ' ', 'g'), ' +', ' ', 'g')) AS q FROM benchmark")(lambda t: t.benchmark.select("item_id", text.query_words(c("text")).alias("q")))
query("fn_47", _TERMS + " SELECT term, CAST(count(*) AS BIGINT) AS docs, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1")(lambda t: text.vocabulary(t.documents, "doc_id", "text"))
query("fn_48", _TERMS + " SELECT doc_id FROM tf WHERE term = 'mit'")(lambda t: text.inverted_index(t.documents, "doc_id", "text").where("term = 'mit'").select("doc_id"))
query("fn_49", "SELECT p_name FROM part WHERE p_name BETWEEN 'part_1' AND 'part_2' ORDER BY 1".replace(" ORDER BY 1", ""))(lambda t: t.part.where(c("p_name").between("part_1", "part_2")).select("p_name"))
query("fn_51", "SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0 ELSE round((o_totalprice - o_custkey) / o_totalprice * 100, 8) END AS p FROM orders")(lambda t: t.orders.select("o_orderkey", F.when(c("o_totalprice") == 0, 0.0).otherwise(F.round((c("o_totalprice") - c("o_custkey")) / c("o_totalprice") * 100, 8)).alias("p")))
query("fn_52", "SELECT o_orderkey, round(o_totalprice * pow(10.0, 2 - floor(log10(o_totalprice)))) / pow(10.0, 2 - floor(log10(o_totalprice))) AS s FROM orders")(lambda t: t.orders.select("o_orderkey", text.significant(c("o_totalprice"), 3).alias("s")))
query("fn_53", "SELECT p_partkey, (p_size & 4) <> 0 AS flag, CAST(p_size | 64 AS INT) AS put, CAST(p_size & ~2 AS INT) AS cleared FROM part")(
    lambda t: t.part.select("p_partkey", (c("p_size").bitwiseAND(4) != 0).alias("flag"), c("p_size").bitwiseOR(64).alias("put"), c("p_size").bitwiseAND(~2).alias("cleared"))
)
query("fn_56", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS hit FROM documents")(lambda t: t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("hit")))
query("fn_57", "SELECT strftime(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 3 DAY)), '%Y-%m-%d') AS d")(lambda t: t.spark.sql("SELECT cast(d AS string) AS d FROM (SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 3 DAYS)) AS d)"))

# Bloom filters: customers with urgent orders, five bits of md5 each in 4,096 (few, so that some answers are false)

_SPOTS = "[(CAST('0x' || substr(md5(k), 1, 15) AS BIGINT) % 4096 + i * (CAST('0x' || substr(md5(k), 16, 15) AS BIGINT) % 4096)) % 4096 FOR i IN range(5)]"
_BLOOM = f"f AS (SELECT DISTINCT unnest({_SPOTS}) AS p FROM (SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000))"


def urgent(t):
    return t.orders.where((c("o_orderpriority") == "1-URGENT") & (c("o_totalprice") > 400000))


query("fn_50_bloom", f"WITH {_BLOOM}, w AS (SELECT p // 62 AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST(p % 62 AS INT)) AS BIGINT) AS bits FROM f GROUP BY 1) SELECT CAST(word AS INT) AS word, bits FROM w")(
    lambda t: bloom.build(urgent(t), c("o_custkey"), 4096, 5)
)
query("fn_50_probe", f"WITH {_BLOOM}, s AS (SELECT c_custkey, unnest({_SPOTS}) AS p FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)) SELECT c_custkey, bool_and(f.p IS NOT NULL) AS maybe FROM s LEFT JOIN f USING (p) GROUP BY 1")(
    lambda t: bloom.probe(t.customer.select("c_custkey"), c("c_custkey"), bloom.build(urgent(t), c("o_custkey"), 4096, 5), 4096, 5)
)
query("fn_50_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")(
    lambda t: bloom.reduce_join(t.customer.select("c_custkey", "c_name"), "c_custkey", urgent(t), "o_custkey")
)
