"""Centroid clustering of integer vectors with adaptive distance bounds, exact in every round.

A vector carries its centroid, an upper bound of the distance to it, lower bounds of the
distances to its ``bounds`` next nearest centroids, each with the centroid's number, and one
lower bound for all that remain.  After a move of the centroids the bounds are widened by the
moves, and a vector is left alone while its upper bound lies below all lower ones by more than
rounding can amount to.  Else its own distance is computed anew; if that does not settle it, the
stored centroids are compared exactly, as long as the bound of the remaining ones certifies that
none of them can be nearest or tie; else all centroids are, and the bounds are stored anew.

Distances are exact integers, so ties go to the smaller number in every round, and the result is
that of a plain full comparison.  Each round reads the vectors with their bounds once, writes them
once to the shared folder with one row of sums a task, and deletes those of the round before.  The
driver holds the centroids, whose number and length are fixed, and nothing else.

Edge cases: vectors that are null, have another number of components, or a component that is null
or not finite are left out, and so are those with a component of 2**27 or more in size after
scaling, as no 64-bit distance could be stated for them; fewer vectors than centroids give fewer
centroids; repeated rows are vectors of their own, in the order of their components where ids
are equal; null ids are seeded last; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import discard, read, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
#: Lower bounds that a vector stores for single centroids, besides the one for the rest.
BOUNDS = 3
#: Scaled components lie below this size, so that a squared distance of 64 of them fits 64 bits.
LIMIT = 1 << 27
#: Bounds are trusted beyond this relative and absolute margin; rounding stays far below it.
MARGIN = 1e-9


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of every row of x to every centre."""
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) < 1 << 21:
        # every sum stays below 2**53, where floating point is exact in any order
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centers], axis=1)


class Bounded:
    """The vectors of one batch with their bounds."""

    def __init__(self, x: np.ndarray, cluster=None, upper=None, near=None, lower=None, rest=None):
        self.x, self.cluster, self.upper, self.near, self.lower, self.rest = x, cluster, upper, near, lower, rest

    def first(self, centers: np.ndarray, bounds: int) -> "Bounded":
        n, stored = len(self.x), min(bounds, len(centers) - 1)
        self.cluster, self.upper, self.rest = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        self.near, self.lower = np.zeros((n, stored), np.int32), np.zeros((n, stored))
        self._rescan(np.arange(n), centers)
        return self

    def _rescan(self, rows: np.ndarray, centers: np.ndarray) -> None:
        """All centroids, in exact order."""
        d = squared(self.x[rows], centers)
        order, stored = np.argsort(d, axis=1, kind="stable"), self.near.shape[1]
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        self.cluster[rows], self.upper[rows] = order[:, 0], root[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : stored + 1], root[:, 1 : stored + 1]
        self.rest[rows] = root[:, stored + 1] if stored + 1 < len(centers) else np.inf

    def _own(self, rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
        d = self.x[rows].astype(np.int64) - centers[self.cluster[rows]]
        return (d * d).sum(1)

    def _settled(self, rows: np.ndarray) -> np.ndarray:
        least = np.minimum(self.lower[rows].min(1, initial=np.inf), self.rest[rows])
        return self.upper[rows] * (1 + MARGIN) + MARGIN < least

    def move(self, centers: np.ndarray, moved: np.ndarray) -> None:
        """The nearest centroids after each has moved by ``moved``."""
        slack = 1 + MARGIN
        self.upper += moved[self.cluster] * slack
        self.lower -= moved[self.near] * slack
        self.rest -= moved.max(initial=0) * slack
        rows = np.arange(len(self.x))
        rows = rows[~self._settled(rows)]
        self.upper[rows] = np.sqrt(self._own(rows, centers).astype(np.float64))
        rows = rows[~self._settled(rows)]
        safe = self.upper[rows] * (1 + MARGIN) + MARGIN < self.rest[rows]
        self._rescan(rows[~safe], centers)
        self._among(rows[safe], centers)

    def _among(self, rows: np.ndarray, centers: np.ndarray) -> None:
        """The own and the stored centroids only: no other is as near as the own one."""
        if not len(rows):
            return
        ids = np.concatenate([self.cluster[rows, None], self.near[rows]], axis=1)
        x = self.x[rows].astype(np.int64)
        d = np.stack([((x - centers[ids[:, j]]) ** 2).sum(1) for j in range(ids.shape[1])], axis=1)
        order = np.lexsort((ids, d), axis=1)
        ids, root = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        self.cluster[rows], self.upper[rows] = ids[:, 0], root[:, 0]
        self.near[rows], self.lower[rows] = ids[:, 1:], root[:, 1:]


_NAMES = ["vec_id", "x", "cluster", "distance", "upper", "near", "lower", "rest", "sums"]
_SCHEMA = "x binary, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double, sums array<long>"


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(offsets, values.ravel())


def _round(vectors: DataFrame, centers: np.ndarray, moved: np.ndarray | None, bounds: int) -> DataFrame:
    """The vectors assigned to ``centers``, and a row a task with its sums (null elsewhere): counts, then components, by centroid."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    k, dimensions = centers.shape

    def run(batches):
        sums, id_arrow = np.zeros((k, dimensions + 1), np.int64), None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids, n = column["vec_id"], batch.num_rows
            id_arrow = ids.type
            if not n:
                continue
            x = np.frombuffer(b"".join(column["x"].to_pylist()), np.int32).reshape(n, dimensions)
            if moved is None:
                rows = Bounded(x).first(centers, bounds)
            else:
                numbers = [column[c].to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper")]
                lists = [column[c].flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy() for c in ("near", "lower")]
                rows = Bounded(x, *numbers, *lists, column["rest"].to_numpy(zero_copy_only=False).copy())
                rows.move(centers, moved)
            for j in range(k):
                mine = x[rows.cluster == j]
                sums[j, 0] += len(mine)
                sums[j, 1:] += mine.sum(0, dtype=np.int64)
            own = rows._own(np.arange(n), centers)
            data = [ids, column["x"], *map(pa.array, (rows.cluster, own, rows.upper)), _lists(rows.near), _lists(rows.lower), pa.array(rows.rest), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(data, names=_NAMES)
        if id_arrow is not None:
            kinds = [id_arrow, pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=_NAMES)

    return written(vectors.mapInArrow(run, f"vec_id {id_type}, {_SCHEMA}"), "round")


def _means(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each component; a centroid without vectors stays."""
    width = centers.shape[1] + 1
    sums = state.filter("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    total = {r.pos: int(r.total) for r in sums.collect()}
    out = centers.copy()
    for j in range(len(centers)):
        if n := total.get(j * width, 0):
            out[j] = [total[j * width + 1 + i] // n for i in range(width - 1)]
    return out


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors that are whole, as 32-bit little-endian integers."""
    id_type = table.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col)
    whole = (F.size(vector) == dimensions) & F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LIMIT / scale))

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(values * scale).astype("<i4").reshape(batch.num_rows, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["vec_id", "x"])

    return table.filter(whole).select(F.col(id_col).alias("vec_id"), vector.alias("v")).mapInArrow(run, f"vec_id {id_type}, x binary")


def clusters(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, bounds: int = BOUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every whole vector, and the final centroids (k integer rows, or fewer)."""
    spark = table.sparkSession
    vectors = written(integer_vectors(table, id_col, vector_col, dimensions, scale), "vectors")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    centers = np.array([np.frombuffer(r.x, "<i4") for r in seeds], np.int64).reshape(-1, dimensions)
    if not seeds:
        return spark.createDataFrame([], f"vec_id {table.schema[id_col].dataType.simpleString()}, cluster int, distance long"), centers
    state, moved = _round(vectors, centers, None, bounds), None
    discard(vectors)
    for _ in range(rounds):
        new = _means(state, centers)
        moved = np.sqrt(((new - centers).astype(np.float64) ** 2).sum(1))
        before, centers = state, new
        state = _round(before.filter("x IS NOT NULL"), centers, moved, bounds)
        discard(before)
    return state.filter("x IS NOT NULL").select("vec_id", "cluster", "distance"), centers


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = clusters(read(spark, sf_dir, "embeddings"))
    # k rows at most: sums beyond 64 bits have no value
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    of = {r.cluster: int(r.inertia) for r in total}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(j, fits(n), fits(sum(of.values())), hashlib.sha256(",".join(map(str, centers[j].tolist())).encode()).hexdigest()) for j, n in of.items()]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(stats), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """All rounds written out, every distance computed."""
    sql = [
        "WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), x) - 1 AS j, x AS c FROM v QUALIFY j < {CENTROIDS})",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, j, d FROM (SELECT vec_id, x, j, {far} AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if r < ROUNDS:
            sums = f"SELECT j, i, cast(sum(x[i]) AS bigint) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY j, i"
            sql.append(f"m{r} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY j)")
            sql.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (j))")
    name = f"SELECT j, sha256(array_to_string(c, ',')) AS h FROM c{ROUNDS}"
    return (
        ", ".join(sql)
        + " SELECT vec_id, cast(j AS integer) AS cluster, cast(d AS bigint) AS distance, cast(sum(d) OVER (PARTITION BY j) AS bigint) AS cluster_inertia, "
        + f"cast(sum(d) OVER () AS bigint) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN ({name}) USING (j)"
    )


OP11_SQL = _oracle()
