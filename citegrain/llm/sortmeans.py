"""Centroid clustering by sort-means, in whole numbers.

Each round sorts, for every centroid, the others by their distance from it. A vector begins at the centroid it had, meets the
others in that order and stops at the first that lies strictly beyond twice its distance: by the triangle inequality neither
that one nor any later one can be as near. Squares of whole numbers are compared, so nothing is rounded.

Vectors travel as blocks, one row each, with their centroids and the sums over them. A round is one pass over the blocks: it writes
them anew and reads back only the sums. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from citegrain.llm.common import checkpointed, discard, new_table

#: Vectors of a block.
BLOCK = 4096
#: Whole numbers up to this size are worked out in 64 bits (64 squares of differences, times four, fit); a block with larger ones in Python's.
NARROW = 1 << 26
#: Sums travel as digits of this many bits, so that a sum of 2**31 blocks fits a long.
DIGIT = 32
LONG = 1 << 63


def usable(vector: Column, dim: int) -> Column:
    """Of `dim` components, none null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~odd, F.lit(False))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): longs, or Python's numbers where one is beyond NARROW."""
    x = np.floor(values.astype(np.float64) * scale)
    if x.size and np.abs(x).max() > NARROW:
        return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the smaller number) and squared distance of each vector, scanning from its centroid `before`."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    best, square = before.copy(), np.zeros(len(x), dtype=x.dtype)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        mine = x[rows]
        own = ((mine - centroids[a]) ** 2).sum(axis=1)
        at, least = np.full(len(rows), a, dtype=before.dtype), own.copy()
        apart = ((centroids - centroids[a]) ** 2).sum(axis=1)
        for j in sorted((j for j in range(len(centroids)) if j != a), key=lambda j: apart[j]):
            on = np.flatnonzero(apart[j] <= 4 * own)
            if not len(on):
                break
            d = ((mine[on] - centroids[j]) ** 2).sum(axis=1)
            nearer = (d < least[on]) | ((d == least[on]) & (j < at[on]))
            at[on[nearer]], least[on[nearer]] = j, d[nearer]
        best[rows], square[rows] = at, least
    return best, square


def digits(value: int) -> list[int]:
    """`value` in signed digits of DIGIT bits, least first."""
    out, base = [], 1 << DIGIT
    while not -base <= value < base:
        out.append(value & (base - 1))
        value >>= DIGIT
    return [*out, value]


def sums(x: np.ndarray, cluster: np.ndarray, square: np.ndarray) -> list[dict]:
    """A row for each cluster and digit: the digits of its componentwise sums, then of its count and its sum of squares."""
    out = []
    for c in np.unique(cluster):
        rows = cluster == c
        found = [digits(int(v)) for v in (*x[rows].sum(axis=0), rows.sum(), sum(square[rows].tolist()))]
        for k in range(max(map(len, found))):
            out.append({"cluster": int(c), "digit": k, "values": [d[k] if k < len(d) else 0 for d in found]})
    return out


_SUMS = "array<struct<cluster: int, digit: int, values: array<bigint>>>"
_SUMS_ARROW = pa.list_(pa.struct([("cluster", pa.int32()), ("digit", pa.int32()), ("values", pa.list_(pa.int64()))]))


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of a block's numbers: the narrowest that holds them, or decimal text."""
    if x.dtype == object:
        return "text", " ".join(map(str, x.ravel())).encode()
    kind = next(t for t in ("i2", "i4", "i8") if not x.size or np.abs(x).max() <= np.iinfo(t).max)
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split()], dtype=object).reshape(-1, dim)
    return np.frombuffer(data, kind).astype(np.int64).reshape(-1, dim)


def _blocks(embeddings: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    kept = embeddings.where(usable(F.col(f"`{vector}`"), dim)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                kind, data = _packed(whole(values.reshape(-1, dim), scale))
                keys, none = part.column("key"), pa.array([[]], _SUMS_ARROW)
                ids = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                yield pa.record_batch([ids, pa.array([kind]), pa.array([data], pa.binary()), pa.array([bytes(4 * len(keys))], pa.binary()), none], names=["keys", "kind", "data", "clusters", "sums"])

    return kept.mapInArrow(run, _schema(kept.schema["key"].dataType))


def _schema(key: DataType) -> str:
    return f"keys {ArrayType(key).simpleString()}, kind string, data binary, clusters binary, sums {_SUMS}"


def _assigned(blocks: DataFrame, centroids: list[list[int]], key: DataType) -> DataFrame:
    """Blocks with their vectors' centroids, scanned from the ones before, and the sums over them."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _numbers(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = _unpacked(row["kind"][0].as_py(), row["data"][0].as_py(), dim)
                cluster, square = nearest(x, np.frombuffer(row["clusters"][0].as_py(), "i4"), c)
                out = [row["keys"], row["kind"], row["data"], pa.array([cluster.tobytes()], pa.binary()), pa.array([sums(x, cluster, square)], _SUMS_ARROW)]
                yield pa.record_batch(out, names=["keys", "kind", "data", "clusters", "sums"])

    return blocks.mapInArrow(run, _schema(key))


def _numbers(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > NARROW for c in centroids for v in c)
    return np.array(centroids, dtype=object if wide else np.int64)


def _totals(blocks: DataFrame) -> dict[int, list[int]]:
    """Sums of each cluster over all blocks: components, count, squares. A few hundred numbers a cluster come back, however many blocks there are."""
    each = blocks.select(F.explode("sums").alias("s")).select("s.cluster", "s.digit", F.posexplode("s.values").alias("at", "value"))
    out: dict[int, list[int]] = {}
    for r in each.groupBy("cluster", "digit", "at").agg(F.sum("value").alias("value")).collect():
        values = out.setdefault(r["cluster"], [])
        values.extend([0] * (r["at"] + 1 - len(values)))
        values[r["at"]] += r["value"] << (DIGIT * r["digit"])
    return out


def starts(embeddings: DataFrame, k: int, seed: str, key: str, vector: str, dim: int, scale: float) -> list[list[int]]:
    """The k usable vectors of least sha256 of `seed:key` (a null key: the empty text), in that order; of equal keys, by their components."""
    rows = embeddings.where(usable(F.col(f"`{vector}`"), dim)).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256).alias("h"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    found = rows.orderBy("h", "v").limit(k).collect()
    return [[int(v) for v in whole(np.array(r["v"]), scale)] for r in found]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: float = 1024.0) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector.

    Usable are vectors of `dim` components, none null or non-finite; the others give no row. With fewer than k of them there are as many
    centroids. Repeated rows, and vectors under one key or a null key, count each; equal centroids share nothing (the smaller number takes all) and an
    empty one stays where it is. Other columns aren't carried. An empty table gives no rows. Numbers of any size are exact; a distance or
    sum that doesn't fit a long is null.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema[key].dataType
    named = f"`{key}` {kind.simpleString()}, cluster int, distance long"
    centroids = starts(embeddings, k, seed, key, vector, dim, scale)
    if not centroids:
        none = "cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"{named}, {none}")
    path = new_table(spark, "blocks")
    _blocks(embeddings, key, vector, dim, scale).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(_schema(kind)).parquet(path)
    totals: dict[int, list[int]] = {}
    for step in range(rounds + 1):
        after = new_table(spark, "blocks")
        _assigned(blocks, centroids, kind).write.option("compression", "zstd").parquet(after)
        blocks = spark.read.schema(_schema(kind)).parquet(after)
        discard(spark, path)
        path, totals = after, _totals(blocks)
        if step < rounds:
            centroids = [[s // totals[c][dim] for s in totals[c][:dim]] if c in totals else centroids[c] for c in range(len(centroids))]
    return _rows(blocks, centroids, totals, key, named)


def _rows(blocks: DataFrame, centroids: list[list[int]], totals: dict[int, list[int]], key: str, named: str) -> DataFrame:
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _numbers(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, at = _unpacked(row["kind"][0].as_py(), row["data"][0].as_py(), dim), np.frombuffer(row["clusters"][0].as_py(), "i4")
                square = ((x.astype(c.dtype) - c[at].astype(x.dtype)) ** 2).sum(axis=1)
                yield pa.record_batch([row["keys"].flatten(), pa.array(at), pa.array([_long(int(s)) for s in square], pa.int64())], names=[key, "cluster", "distance"])

    inertia = _long(sum(t[dim + 1] for t in totals.values()))
    about = [(c, _long(t[dim + 1]), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sorted(totals.items())]
    table = blocks.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return blocks.mapInArrow(run, named).join(F.broadcast(checkpointed(table)), "cluster").select(f"`{key}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(value: int) -> int | None:
    return value if value < LONG else None


def oracle(k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """DuckDB SQL of cluster()'s digest over `embeddings`, rounds written out and every distance worked out."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    floor = "(s - ((s % n) + n) % n) // n"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT row, vec_id, x, best.c AS c, best.d AS d FROM (SELECT v.row, v.vec_id, v.x, arg_min({{'c': c.c, 'd': {square}}}, {{'d': {square}, 'c': c.c}}) AS best FROM v, c{r} c GROUP BY v.row, v.vec_id, v.x))"
    steps = [
        "u AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64)",
        "v AS MATERIALIZED (SELECT row, vec_id, list_transform(e, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM u)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, x FROM (SELECT sha256('{seed}:' || coalesce(CAST(u.vec_id AS VARCHAR), '')) AS h, e, x FROM u JOIN v USING (row) ORDER BY h, e LIMIT {k}))",
    ]
    for r in range(rounds):
        steps.append(near(r))
        steps.append(f"m{r} AS (SELECT c, i, CAST(sum(x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(q.x, p.x) AS x FROM c{r} p LEFT JOIN (SELECT c, list(CAST({floor} AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY c) q ON p.c = q.c)")
    steps.append(near(rounds))
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
