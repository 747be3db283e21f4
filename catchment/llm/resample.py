"""Importance resampling of documents towards the benchmark's distribution of word runs.

Every run of one to three words is hashed into one of ``BUCKETS`` buckets. Higher-order functions make
each document's array of buckets inside its row; a first pass counts buckets (partial counts are made
before the shuffle, so that ``BUCKETS`` totals a task are all that moves), the totals give each bucket
a gain, and a second pass adds up ``element_at`` of the gains, a literal array, over each stored array.
Documents are then drawn without replacement by the Gumbel-top-k rule. The order of the draw comes
from ranges of the scores: sizes of the ranges tell where each begins, and only the ranges that hold
drawn rows number theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchment.llm.common import stored

BUCKETS, LONGEST_RUN = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: A word: digits, a-z (texts are lower-cased first) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    """Unsigned crc32 of a feature's UTF-8 bytes, modulo ``buckets``."""
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_array(found: Column, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``longest`` consecutive words, repeats included."""

    def runs(length: int) -> Column:
        def one(_, k):
            return bucket(F.concat_ws(" ", *[F.get(found, k + i) for i in range(length)]), buckets)

        starts = F.slice(found, 1, F.greatest(F.size(found) - (length - 1), F.lit(0)))
        return F.transform(starts, one)

    return F.concat(F.transform(found, lambda x: bucket(x, buckets)), *[runs(n) for n in range(2, longest + 1)])


def featured(table: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``table`` (doc_id, text) as doc_id, n_words, buckets."""
    split = table.select("doc_id", words(F.col("text").cast("string")).alias("words"))
    return split.select("doc_id", F.size("words").alias("n_words"), bucket_array(F.col("words"), longest, buckets).alias("buckets"))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs: ``buckets`` numbers, whatever the size of the table."""
    found = features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()
    counts = dict(found)
    return [counts.get(k, 0) for k in range(buckets)]


def gains(source: list[int], target: list[int]) -> list[int]:
    """Each bucket's gain: 1000 times the log of its smoothed share in the target over that in the source, rounded down."""
    every, wanted, n = sum(source), sum(target), len(source)
    return [math.floor(1000 * math.log((float(t + 1) * float(every + n)) / (float(s + 1) * float(wanted + n)))) for s, t in zip(source, target, strict=True)]


def weight(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of an array of buckets."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, k: total + F.element_at(table, k + 1))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The draw's Gumbel number of a document in thousandths, rounded down; null without a doc_id."""
    code = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((code + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a stored table with doc_id, n_words and score) with ``rank``: 1, 2, ... for the rows drawn.

    Rows of at least ``least`` words with a score can be drawn; of N, the N * percent / 100 with the highest
    scores are, rounded down, ties to the smaller doc_id. Rows that repeat a doc_id with equal scores
    have an order of their own, any one.
    """
    may = F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False))
    rows = scored.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    # The partition is part of what is stored, as another run of the sampling might cut elsewhere.
    ranged = stored(rows.where(may).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    take, before, starts = sum(sizes.values()) * percent // 100, 0, []
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    last = max((k for k, x in enumerate(starts) if x < take), default=-1)
    none = F.lit(None).cast("long")
    head = ranged.where(F.col("part") <= last)
    if last >= 0:
        offset = F.element_at(F.split(F.lit(",".join(map(str, starts[: last + 1]))), ",").cast("array<long>"), F.col("part") + 1)
        place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + offset
        head = head.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    else:
        head = head.withColumn("rank", none)
    tail = ranged.where(F.col("part") > last).withColumn("rank", none)
    rest = scored.where(~may).withColumn("rank", none)
    return head.select(*scored.columns, "rank").unionByName(tail.select(*scored.columns, "rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn to be like ``target`` (text).

    Null, empty and wordless texts have no features, weight 0, and can't be drawn. Rows without a doc_id
    count in the totals and have a weight, but no score. Other columns are ignored; empty tables
    give no rows, and an empty target all gains of a uniform one.
    """
    features = stored(featured(docs), "buckets")
    wanted = featured(target.select(F.lit(0).alias("doc_id"), "text"))
    gain = gains(bucket_counts(features), bucket_counts(wanted))
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")
    weighed = features.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    scored = stored(weighed.withColumn("score", score), "scored")
    return drawn(scored, percent, least).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of the query: crc32 by nibbles, each distinct feature once.
SQL = r"""
WITH nibble AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(i AS BIGINT) AS i FROM range(16) r(i)))
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 't', -1 - row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), runs AS (
  SELECT side, row, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f
  FROM w
), counted AS (
  SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL
), codes AS (
  SELECT f, xor(list_reduce([4294967295] || [CAST(strpos('0123456789ABCDEF', hex(f)[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT) FOR i IN range(length(hex(f)))],
    lambda c, x: xor(c >> 4, t[xor(c & 15, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), nibble
), hits AS (
  SELECT side, row, bucket, n FROM counted JOIN codes USING (f)
), totals AS (
  SELECT bucket, sum(n) FILTER (WHERE side = 's') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM hits GROUP BY 1
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM totals) + 10000 AS DOUBLE))
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals
), weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM hits JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (row) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () * 5 // 100 AS take FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= take THEN place END AS rank FROM ranked
"""
