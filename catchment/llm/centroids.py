"""Lloyd's clustering of integer vectors, each round paying only for what has changed.

Vectors are written once, in buckets by row number; assignments (row, cluster, distance) are written
every round in the same buckets, so that the two meet without a shuffle. The driver holds the
centroids and the global sums and counts of their vectors: ``k`` rows of the vectors' length. A round
compares a vector with the centroids that have changed and with its owner's distance, which is known;
only where the owner itself has moved it is compared with all. Vectors that change their owner carry
their components in that round's assignments, and these alone make the transfers: signed sums by
cluster, added before the shuffle, with which the driver corrects its own.

All of it is integer arithmetic and exact, so every order of the rows gives the same result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm.common import drop_folder, map_batches, new_folder, stored

SIZE, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Vectors of a bucket; components up to this fit 64-bit distances of ``SIZE`` and are added in numpy's integers.
BUCKET_ROWS, SMALL = 500_000, 1 << 27
MOST = (1 << 63) - 1


class Bucketed:
    """Tables of one number of buckets, by ``row``, which are dropped together."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.held = spark, buckets, {}

    def write(self, rows: DataFrame, base: str) -> str:
        name = f"{base}_{uuid.uuid4().hex}"
        path = new_folder(self.spark, base)
        rows.write.bucketBy(self.buckets, "row").sortBy("row").option("path", path).format("parquet").saveAsTable(name)
        self.held[name] = path
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.held.pop(name))


def kept(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integers floor(scale * component), of vectors of ``size`` finite components.

    A component whose integer has over 62 bits (1.8e16 or more at the usual scale) counts as not finite,
    as no distance from it is a long.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = (F.size("v") == size) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, exact: in 64-bit integers where these hold them, else in Python's."""
    if x.size and max(int(np.abs(x).max()), int(np.abs(centres).max())) >= SMALL:
        x, centres = x.astype(object), centres.astype(object)
    out = np.empty((len(x), len(centres)), x.dtype)
    for k, c in enumerate(centres):
        gap = x - c
        out[:, k] = (gap * gap).sum(1) if x.dtype == object else np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(x: np.ndarray, centres: np.ndarray, numbers: np.ndarray, owner: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centre, ties to the smaller number; ``owner`` at distance ``known`` is one more.

    ``numbers`` ascends. Distances beyond 63 bits are given as the greatest number of 63 bits, chosen exactly among themselves.
    """
    d = distances(x, centres)
    best = d.argmin(1)
    far, near = d[np.arange(len(x)), best], numbers[best]
    if owner is not None:
        stays = (known < far) | ((known == far) & (owner < near))
        near, far = np.where(stays, owner, near), np.where(stays, known, far)
    return near, far


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(rows, -1)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array([min(int(v), MOST) for v in values] if values.dtype == object else values, pa.int64())


def first_owners(vectors: DataFrame, centres: list[list[int]]) -> DataFrame:
    """row, vec_id, was (null), cluster, distance, moved (all components) of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast(np.array(centres, np.int64))

    def make():
        c = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            near, far = nearest(_matrix(batch.column(2), batch.num_rows), c, np.arange(len(c)))
            parts = [batch.column(0), batch.column(1), pa.nulls(batch.num_rows, pa.int32()), pa.array(near, pa.int32()), _long(far), batch.column(2)]
            return pa.RecordBatch.from_arrays(parts, ["row", "vec_id", "was", "cluster", "distance", "moved"])

        return work

    return map_batches(vectors.select("row", "vec_id", "x"), make, "row long, vec_id long, was int, cluster int, distance long, moved array<long>")


def next_owners(vectors: DataFrame, owners: DataFrame, centres: list[list[int]], changed: list[int]) -> DataFrame:
    """The next assignments: rows whose owner is not in ``changed`` meet only the centres that are."""
    held = vectors.sparkSession.sparkContext.broadcast((np.array(centres, np.int64), np.array(changed, np.int64)))

    def make():
        c, new = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch.column(2), batch.num_rows)
            was, known = np.asarray(batch.column(3)).astype(np.int64), np.asarray(batch.column(4))
            near, far = was.copy(), known.astype(object) if (known == MOST).any() else known.copy()
            lost = np.isin(was, new) | (known == MOST)
            for rows, centre, numbers, keep in ((lost, c, np.arange(len(c)), False), (~lost, c[new], new, True)):
                if rows.any():
                    n, d = nearest(x[rows], centre, numbers, was[rows] if keep else None, known[rows] if keep else None)
                    if d.dtype == object:
                        far = far.astype(object)
                    near[rows], far[rows] = n, d
            moved = near != was
            carried = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(moved * x.shape[1])), pa.int32()), pa.array(x[moved].ravel()), mask=pa.array(~moved))
            parts = [batch.column(0), batch.column(1), batch.column(3), pa.array(near, pa.int32()), _long(far), carried]
            return pa.RecordBatch.from_arrays(parts, ["row", "vec_id", "was", "cluster", "distance", "moved"])

        return work

    joined = vectors.select("row", "x").join(owners.select("row", "vec_id", F.col("cluster").alias("was"), "distance"), "row")
    return map_batches(joined.select("row", "vec_id", "x", "was", "distance"), make, "row long, vec_id long, was int, cluster int, distance long, moved array<long>")


def transfers(owners: DataFrame, size: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors gained, components gained) for every cluster that won or lost vectors."""
    ends = F.array(F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))
    moves = owners.where("moved is not null").select("moved", F.explode(ends).alias("end")).where("end.cluster is not null")
    # Decimals, as the sum of the components of all vectors may be beyond 64 bits.
    sums = [F.sum(F.col("moved")[k].cast("decimal(19,0)") * F.col("end.sign")).alias(f"c{k}") for k in range(size)]
    found = moves.groupBy(F.col("end.cluster").alias("cluster")).agg(F.sum("end.sign").alias("vectors"), *sums).collect()
    return [(r["cluster"], r["vectors"], [int(r[f"c{k}"]) for k in range(size)]) for r in found]


def first_centres(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """Components of the ``clusters`` vectors with the smallest hashes of seed and vec_id, in order; rows that repeat a vec_id by components."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in vectors.where("vec_id is not null").select(code.alias("code"), "x").orderBy("code", "x").limit(clusters).collect()]


def cluster(vectors: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (vec_id, embedding) that can be clustered.

    Vectors of another size, and null ones or ones with null or non-finite components, have no row. Rows without a vec_id are clustered but never start a centre; rows that repeat one are vectors of their own. With
    fewer vectors than ``clusters`` each starts a centre; an empty table gives an empty one. Centres
    that own nothing stay. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, size, scale)
    count = rows.count()
    centres = first_centres(rows, clusters, seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centres:
        return spark.createDataFrame([], shape)
    store = Bucketed(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / BUCKET_ROWS)))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    points = store.write(numbered.repartition(store.buckets, "row"), "points")
    owners = store.write(first_owners(store.table(points), centres), "owners")
    counts, sums = [0] * len(centres), [[0] * size for _ in centres]
    for _ in range(rounds):
        for k, gained, parts in transfers(store.table(owners), size):
            counts[k] += gained
            sums[k] = [a + b for a, b in zip(sums[k], parts, strict=True)]
        new = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centres, strict=True)]
        changed = [k for k, (a, b) in enumerate(zip(centres, new, strict=True)) if a != b]
        if not changed:
            break
        centres = new
        following = store.write(next_owners(store.table(points), store.table(owners), centres, changed), "owners")
        store.drop(owners)
        owners = following
    final = stored(store.table(owners).select("vec_id", "cluster", "distance"), "clusters")
    store.drop(owners)
    store.drop(points)
    inertia = dict(final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect())
    whole = min(sum(map(int, inertia.values())), MOST)
    about = [(k, min(int(v), MOST), whole, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for k, v in inertia.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the query: the rounds written out, each comparing all vectors with all centres."""
    good = f"len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size}"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings WHERE {good})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS k, x AS c FROM v ORDER BY k LIMIT {clusters})",
    ]
    gap = f"list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, {size + 1})])"
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min_by(k, (d, k)) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT vec_id, x, k, {gap} AS d FROM v, c{n}) GROUP BY 1)")
        if n < rounds:
            mean = f"SELECT k, list(m ORDER BY i) AS m FROM (SELECT k, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{n}, range(1, {size + 1}) r(i) GROUP BY 1, 2) GROUP BY 1"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN ({mean}) USING (k))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (k)"
    )


SQL = _sql()
