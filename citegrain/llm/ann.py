"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Distinct vectors are dealt to shards by their norms, and by a hash among equal ones: where norms differ, a graph of all of them finds few
of the greatest inner products, as long vectors are near to everything. Each shard is one graph. A vector's candidates are its nearest of the shard and,
for the long steps, its nearest of a random sixteenth; relaxed distance pruning keeps the diverse ones (a candidate goes if some kept neighbour is
ALPHA times nearer to it than the vector is), and half of the neighbours are linked back. Queries search every shard by beam search, in blocks; all searches of a block
take their steps side by side. Vectors get one more component, so that a greater inner product is a smaller distance.
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import stored

#: Neighbours of a vector: of its NEAR nearest, of the LONG nearest of one vector in SAMPLE (FAR of them), and back links.
DEGREE, NEAR, LONG, FAR, SAMPLE, ALPHA = 48, 64, 16, 6, 16, 1.2
#: Beam of a search for queries on a full shard; smaller ones need less, as the square root of their size, LEAST_BEAM at least.
SEARCH, LEAST_BEAM = 256, 96
#: Where searches start: the best FIRST of so many vectors, all looked at. Nodes of a beam that one step opens.
STARTS, FIRST, WIDTH = 2048, 32, 8
#: Vectors looked up at once.
BLOCK = 256
#: Distinct vectors of a shard, about, of up to 64 components; of longer ones the shard's numbers count, down to LONG_ROWS. A small table still has
#: LEAST_SHARDS, for as many tasks. Bands of norms, at most.
SHARD_ROWS, LONG_ROWS, LEAST_SHARDS, BANDS = 65_536, 16_384, 12, 64
#: Distinct queries that search a shard in one task; so many that sending them costs about as much as sending the graph to them.
QUERY_BLOCK = 1 << 17
#: Few shards are searched by about so many tasks, if each has LEAST_BLOCK queries.
LEAST_TASKS, LEAST_BLOCK = 24, 1 << 13
_NONE = np.int64(2**63 - 1)


def _greatest(score: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest of each row (all, if there are fewer), greatest first."""
    at = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.take_along_axis(at, (-np.take_along_axis(score, at, 1)).argsort(axis=1, kind="stable"), 1)


def _padded(row: np.ndarray, value: np.ndarray, rows: int, fill: np.generic) -> np.ndarray:
    """The values of each row (in order) side by side, and `fill`."""
    count = np.bincount(row, minlength=rows)
    out = np.full((rows, int(count.max(initial=0))), fill, value.dtype)
    out[row, np.arange(len(row)) - (np.cumsum(count) - count)[row]] = value
    return out


def _keys(far: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Distances and nodes as whole numbers of the same order; the lowest bit is for whether the node was opened."""
    return (np.maximum(far, 0).astype(np.float32).view(np.int32).astype(np.int64) << 32) | (node.astype(np.int64) << 1)


def _beam(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> np.ndarray:
    """Beam search of all queries side by side, for the greatest inner products: the nodes found, best first (row by row, padded with -1)."""
    m, n = len(queries), len(x)
    # the greatest product there can be, less the product, is a distance
    most = np.sqrt(np.einsum("ij,ij->i", queries, queries) * np.einsum("ij,ij->i", x, x).max()) * np.float32(1.0001)
    product = queries @ x[starts].T
    first = _greatest(product, min(beam, FIRST))
    held = np.full((m, beam), _NONE)
    held[:, : first.shape[1]] = _keys(most[:, None] - np.take_along_axis(product, first, 1), starts[first])
    seen = np.zeros(m * n, bool)
    seen[(np.arange(m)[:, None] * n + starts[first]).ravel()] = True
    found = np.full((m, beam), _NONE)
    live = np.arange(m)
    while len(live):
        closed = (held & 1) == 1
        opened, at = [], []
        for _ in range(WIDTH):
            best = closed.argmin(axis=1)
            rows = np.flatnonzero(~closed[np.arange(len(live)), best])
            best = best[rows]
            opened.append(rows)
            at.append(held[rows, best])
            closed[rows, best] = True
            held[rows, best] |= 1
        row, node = np.concatenate(opened), (np.concatenate(at) & 0xFFFFFFFF) >> 1
        near = graph.take(node, axis=0)
        place = ((live * n)[row][:, None] + near).ravel()
        near = near.ravel()
        new = np.flatnonzero((near >= 0) & ~seen.take(place, mode="wrap"))
        seen[place[new]] = True
        row, near = row.take(new // graph.shape[1]), near.take(new)
        far = _keys(most[live].take(row) - np.einsum("ij,ij->i", queries[live].take(row, axis=0), x.take(near, axis=0)), near)
        better = np.flatnonzero(far < held[:, -1].take(row))
        row, far = row.take(better), far.take(better)
        turn = row.argsort(kind="stable")
        both = np.concatenate([held, _padded(row[turn], far[turn], len(live), _NONE)], axis=1)
        both.sort(axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)  # two nodes opened at once share neighbours
        if twice.any():
            both[:, 1:][twice] = _NONE
            both.sort(axis=1)
        held = np.ascontiguousarray(both[:, :beam])
        going = ((held & 1) == 0).any(axis=1)
        if not going.all():
            found[live[~going]] = held[~going]
            held, live = held[going], live[going]
    return np.where(found != _NONE, (found & 0xFFFFFFFF) >> 1, -1)


def _prune(x: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of many points side by side; `near` is sorted by distance, -1 at the end."""
    kept = np.full((len(points), degree), -1, np.int32)
    if not near.shape[1]:
        return kept
    alive = near >= 0
    v = x[np.maximum(near, 0)]
    size = np.einsum("ijk,ijk->ij", v, v)
    apart = size[:, :, None] + size[:, None] - 2 * (v @ v.transpose(0, 2, 1))
    far = ((v - x[points][:, None]) ** 2).sum(axis=2)
    rows = np.arange(len(points))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[:, k] = np.where(some, near[rows, first], -1)
        alive &= alpha * alpha * apart[rows, first] > far
        alive[rows, first] = False
    return kept


def _nearest(score: np.ndarray, near: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The `near` greatest columns of each row, and the LONG greatest of the first `sample` columns; greatest first, -1 for what is minus infinity.

    In long rows only what exceeds a limit is sorted: the sample's, below which about twice as many as needed lie; rows where they are too few are sorted whole.
    """
    m, n = score.shape
    long = _greatest(score[:, :sample], LONG)
    if n > SAMPLE * NEAR:
        limit = np.take_along_axis(score, long[:, 2 * near // SAMPLE - 1 : 2 * near // SAMPLE], 1)
        row, column = np.divmod(np.flatnonzero(score > limit), n)
        best = _padded(row, column, m, np.int64(-1))
        few = (best >= 0).sum(axis=1) < near
        value = np.where(best >= 0, np.take_along_axis(score, np.maximum(best, 0), 1), -np.inf)
        lists = np.full((m, near), -1)
        if not few.all():
            lists[~few] = np.take_along_axis(best, _greatest(value, near), 1)[~few]
        if few.any():
            lists[few] = _greatest(score[few], near)
    else:
        lists = _greatest(score, near)
    return tuple(np.where(np.isfinite(np.take_along_axis(score, at, 1)), at, -1) for at in (lists, long))


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The graph (rows of out-neighbours, padded with -1) and the nodes where searches start."""
    n = len(x)
    turn = np.random.default_rng(seed).permutation(n)
    x = np.ascontiguousarray(x[turn], np.float32)
    half_square = np.einsum("ij,ij->i", x, x) / 2
    sample = -(-n // SAMPLE)
    own, long = np.full((n, degree - FAR), -1, np.int32), np.full((n, FAR), -1, np.int32)
    for i in range(0, n, BLOCK):
        points = np.arange(i, min(n, i + BLOCK))
        score = x[points] @ x.T
        score -= half_square
        score[points - i, points] = -np.inf
        nearest, spread = _nearest(score, min(NEAR, n - 1), sample)
        own[points], long[points] = _prune(x, points, nearest, degree - FAR, alpha), _prune(x, points, spread, FAR, alpha)
    # back links, from those that rank the node best; what room is left goes to the node's own further neighbours
    half = degree // 2
    source, rank = np.nonzero(own >= 0)
    target = own[source, rank].astype(np.int64)
    known = ~np.isin(target * n + source, (source * n + target)[rank < half])
    source, rank, target = source[known], rank[known], target[known]
    turned = np.lexsort((rank, target))
    source, target = source[turned].astype(np.int32), target[turned]
    fits = np.arange(len(target)) - np.searchsorted(target, target) < degree - half - FAR
    back = _padded(target[fits], source[fits], n, np.int32(-1))
    links = np.concatenate([own[:, :half], long, back, own[:, half:]], axis=1)
    links = np.take_along_axis(links, (links < 0).argsort(axis=1, kind="stable"), 1)[:, :degree]
    graph = np.empty_like(links)
    graph[turn] = np.where(links >= 0, turn[np.maximum(links, 0)], -1)
    return graph, turn[: min(sample, STARTS)]


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that all vectors have norm `top`; distances then fall as inner products grow."""
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1, keepdims=True), 0))], axis=1).astype(np.float32)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, node, v array<double>, dim): rows with a key and a vector that is not null, empty, zero, or with a null, NaN or infinity.
    Rows of one vector have one `node`, two 64-bit hashes of it."""
    v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    ok = F.size("v") > 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{key}`").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull()).where(ok & ~F.coalesce(bad, F.lit(True)) & some)
    return rows.select("key", F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(7), F.col("v")))).alias("node"), "v", F.size("v").alias("dim"))


def index(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(shards, members, number of shards) for usable(): a row for each shard's graph; of each distinct vector its k + 1 least keys, k times each at most.

    No more rows of one vector can be in a query's k nearest, by the rule for ties.
    """
    again = F.row_number().over(Window.partitionBy("node", "key").orderBy("key"))
    few = vectors.withColumn("again", again).where(F.col("again") <= k)  # each task sends k rows of a key at most
    few = few.withColumn("rank", F.dense_rank().over(Window.partitionBy("node").orderBy("key"))).where(F.col("rank") <= k + 1)
    members = stored(few.groupBy("node").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("key")).alias("keys")), "members")
    n, numbers = members.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    rows = min(SHARD_ROWS, max(LONG_ROWS, 64 * SHARD_ROWS * n // max(1, numbers)))
    shards = max(LEAST_SHARDS, -(-n // rows))
    bands = min(BANDS, shards)
    each = -(-shards // bands)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    cuts = members.select(norm.alias("n")).agg(F.percentile_approx("n", [i / bands for i in range(1, bands)], 100 * bands)).first()[0] or []
    below, upto = (F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: f(c, F.col("norm")))) if cuts else F.lit(0) for f in (operator.lt, operator.le))
    band = F.col("below") + F.pmod(F.xxhash64("node"), F.col("upto") - F.col("below") + 1)  # any of the bands that one norm fills
    shard = (band * each + F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.lit(each))).cast("int")

    def graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        top = float(np.sqrt((x * x).sum(axis=1).max()))
        links, starts = build(_lifted(x / top, 1.0))
        narrow = x.astype(np.float32)
        x = narrow if (narrow == x).all() else x
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "starts": [starts.tolist()], "top": [top], "x": [x.tobytes()], "graph": [links.tobytes()], "nodes": [pdf["node"].tolist()], "least": [pdf["least"].tolist()]})

    dealt = members.select("node", "v", "dim", F.col("keys")[0].cast("long").alias("least"), norm.alias("norm"))
    dealt = dealt.withColumns({"below": below, "upto": upto}).withColumn("shard", shard).drop("norm", "below", "upto")
    built = dealt.repartitionById(shards, F.col("shard")).groupBy("shard", "dim").applyInPandas(graph, "shard int, dim int, starts array<int>, top double, x binary, graph binary, nodes array<string>, least array<long>")
    return stored(built, "graphs"), members, shards


def _width(rows: int, beam: int) -> int:
    """The beam for a shard of so many rows, where `beam` is that for a full one."""
    return max(min(beam, LEAST_BEAM), int(beam * min(1.0, rows / SHARD_ROWS) ** 0.5))


def _found(shard: dict, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, score) of the k + 1 nearest nodes of a shard for each of the queries."""
    x, lifted, links = shard["x"], shard["lifted"], shard["links"]
    ahead = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    near = _beam(lifted, links, np.concatenate([ahead, np.zeros((len(q), 1))], axis=1).astype(np.float32), shard["start"], max(beam, k + 1))
    r, c = np.nonzero(near >= 0)
    node = near[r, c]
    score = np.einsum("ij,ij->i", q.take(r, axis=0), x.take(node, axis=0))
    turn = np.lexsort((shard["least"][node], -score, r))
    r, node, score = r[turn], node[turn], score[turn]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place <= k], node[place <= k], score[place <= k]


def search(shards: DataFrame, members: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH) -> DataFrame:
    """(query_id, rank, key, score): the k nearest keys found for each row of queries (key, node, v, dim), rows of its own key left out.

    The score is the inner product in double precision; ties go to the smaller key. Other dimensions don't meet. The distinct queries
    of a block stream past every shard; hits carry the query's number, not its vector.
    """
    distinct = stored(queries.groupBy("node").agg(F.first("v").alias("v"), F.first("dim").alias("dim")).withColumn("q", F.monotonically_increasing_id()), "queries")
    n, last = distinct.count(), shards.agg(F.max("shard")).first()[0] or 0
    blocks = max(1, -(-n // QUERY_BLOCK), min(-(-LEAST_TASKS // (last + 1)), n // LEAST_BLOCK))
    each = distinct.select("q", "v", "dim", F.pmod("q", F.lit(blocks)).cast("int").alias("block"))
    place = shards.select("dim", "shard").join(each.select("dim", "block").distinct(), "dim")
    graphs = place.join(shards, ["dim", "shard"]).select("dim", "shard", "block", F.lit(-1).cast("long").alias("q"), F.lit(None).cast("array<double>").alias("v"), "starts", "top", "x", "graph", "nodes", "least")
    asked = shards.select("dim", "shard").join(each, "dim").select("dim", "shard", "block", "q", "v")

    def run(batches):
        """Rows stand by shard and block, the graph first."""
        shard: dict = {}
        for batch in batches:
            q, dim, v = batch.column("q").to_numpy(), batch.column("dim").to_numpy(), batch.column("v")
            cuts = [0, *(i for i in range(len(q)) if q[i] < 0), len(q)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j and q[i] < 0:
                    row = batch.slice(i, 1).to_pylist()[0]
                    x = np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * row["dim"] * len(row["nodes"]) else np.float64).reshape(-1, row["dim"]).astype(np.float64)
                    shard = {"x": x, "lifted": _lifted(x / row["top"], 1.0), "links": np.frombuffer(row["graph"], np.int32).reshape(len(x), -1), "start": np.array(row["starts"], np.int64), "nodes": np.array(row["nodes"], object), "least": np.array(row["least"], np.int64)}
                    i += 1
                for a in range(i, j, BLOCK):
                    b = min(j, a + BLOCK)
                    some = np.array(v.slice(a, b - a).flatten(), np.float64).reshape(-1, dim[a])
                    r, node, score = _found(shard, some, k, _width(len(shard["x"]), beam))
                    yield pa.RecordBatch.from_arrays([pa.array(q[a:b][r]), pa.array(shard["nodes"][node], pa.string()), pa.array(shard["least"][node]), pa.array(score)], ["q", "node", "least", "score"])

    met = graphs.unionByName(asked, allowMissingColumns=True).repartitionById((last + 1) * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("dim", "shard", "block", "q")
    hits = met.mapInArrow(run, "q long, node string, least long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "least", "node")
    top = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("q", "node", "score")  # each task sends k + 1 rows of a query at most
    keyed = top.join(members.select("node", "keys"), "node")
    near = F.sort_array(F.flatten(F.collect_list(F.transform("keys", lambda x: F.struct((-F.col("score")).alias("s"), x.alias("key"))))))
    lists = keyed.groupBy("q").agg(near.alias("near")).join(distinct.select("q", "node"), "q").select("node", "near")  # (k + 1)**2 * k keys at most
    out = queries.select(F.col("key").alias("query_id"), "node").join(lists, "node").select("query_id", F.slice(F.filter("near", lambda x: x["key"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.key").alias("key"), (-F.col("hit.s")).alias("score"))


def nearest(df: DataFrame, *, queries: str, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """search() of the rows where the SQL condition `queries` on `key` holds, against all rows.

    Rows of one key count each, with whatever vectors: they are candidates of their own, and queries of their own (which then share
    their query_id); none of them is a candidate of a query of that key. Rows that usable() leaves out take no part; an
    empty table gives no rows; other columns are not carried, so none can clash.
    """
    vectors = stored(usable(df, key, vector), "vectors")
    shards, members, _ = index(vectors, k)
    return search(shards, members, vectors.where(queries), k)
