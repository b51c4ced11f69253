"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Documents of one fingerprint are one node. Two nodes within radius r agree on at least B - r of B bands of bits, so nodes meet
under every choice of B - r bands; nodes that meet are compared as vertical bit planes. A meeting sends on, for each of its
nodes, one link towards the least node that it reaches there, so links never outgrow the nodes that met. Components are then
found by alternating star steps over the links, all in Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from citegrain.llm.common import BROADCAST_KEYS, checkpointed, counted_join, is_hub, stored

BITS = 64
#: Nodes that are compared all with all; more are first split by bands of the bits that they don't share.
TILE = 8192


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the hashes of the text's shingles, repeats included; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and the six blanks
    if not w:
        return 0
    grams = list(map(b" ".join, zip(*(w[i:] for i in range(shingle))))) or [b" ".join(w)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), 1 << 14):
        h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams[i : i + (1 << 14)]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text as a long (two's complement); null and empty texts: 0."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64))

    return run(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, 64 of them to a word."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def within(fp: int, upright: np.ndarray, radius: int, order: np.ndarray) -> np.ndarray:
    """Positions within `radius` of `fp`. Saturating carry-save counters of the differing bits; a word of 64 fingerprints is
    abandoned once all of them exceed the radius."""
    width = radius.bit_length()
    live = np.arange(upright.shape[1])
    counters = [np.zeros(len(live), np.uint64) for _ in range(width)]
    over = np.zeros(len(live), np.uint64)
    start = (1 << width) - 1 - radius  # counters overflow on the (radius + 1)-th difference
    for k in range(width):
        if start >> k & 1:
            counters[k] = ~counters[k]
    for step, bit in enumerate(order):
        carry = upright[bit][live] if len(live) < upright.shape[1] else upright[bit].copy()
        if fp >> (BITS - 1 - int(bit)) & 1:
            carry = ~carry
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if step % 8 == 7:
            keep = np.flatnonzero(~over)
            if len(keep) < len(live):
                live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
                if not len(live):
                    return live
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(hits)
    return live[row] * 64 + col


def links(fps: np.ndarray, radius: int, free: list[int] | None = None, tile: int = TILE) -> list[tuple[int, int]]:
    """Links (fingerprint, least one that it reaches) among distinct fingerprints that agree outside the bits `free`."""
    fps = np.unique(fps)
    free = list(range(BITS)) if free is None else free
    if len(fps) < 2:
        return []
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    if len(fps) <= tile or len(free) <= radius + 1:
        upright, order = planes(fps), np.array(free)
        for i, fp in enumerate(fps.tolist()):
            for j in within(fp, upright, radius, order):
                if i < j < len(fps):
                    join(i, int(j))
    else:
        for band in np.array_split(free, radius + 1):  # fingerprints within the radius agree on one of the bands
            mask = np.uint64(sum(1 << (BITS - 1 - int(b)) for b in band))
            key = fps & mask
            order = np.argsort(key, kind="stable")
            rest = [b for b in free if b not in set(band.tolist())]
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                for a, b in links(fps[group], radius, rest, tile):
                    join(*np.searchsorted(fps, np.array([a, b], np.uint64)).tolist())
    return [(int(fps[i]), int(fps[find(i)])) for i in range(len(fps)) if find(i) != i]


def candidates(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints of `nodes` (fp long, distinct) within the radius, found where they meet.

    A meeting of more than `tile` nodes is split: of radius + 1 bands of the bits that its nodes don't share by the meeting's key, two
    within the radius agree on one, so they meet under that band again, dealt to as many tasks as it has values.
    """
    bands = radius + 2
    edges = np.linspace(0, BITS, bands + 1).astype(int)
    signed = lambda bits: int(np.array(sum(1 << int(b) for b in bits), np.uint64).view(np.int64))
    keys, free = [], []
    for n, chosen in enumerate(combinations(range(bands), bands - radius)):
        own = [b for c in chosen for b in range(edges[c], edges[c + 1])]
        keys.append(F.struct(F.lit(n).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(own))).alias("key")))
        rest = np.array_split([b for b in range(BITS) if b not in set(own)], radius + 1)
        free.append(F.array(*(F.lit(signed(x)) for x in rest)))
    met = nodes.select("fp", F.explode(F.array(*keys)).alias("m")).select("fp", "m.table", "m.key")
    large = checkpointed(met.groupBy("table", "key").count().where(F.col("count") > tile).select("table", "key", F.lit(True).alias("large")))
    n = large.count()
    met = met.withColumns({"sub": F.lit(-1), "subkey": F.lit(0).cast("long")}) if not n else _split(met, F.broadcast(large) if n <= BROADCAST_KEYS else large, F.array(*free))
    place = ["table", "key", "sub", "subkey"]

    def run(batches):
        """Rows stand by place; a group is compared when the next begins."""
        last, held = None, []

        def found():
            out = links(np.concatenate(held).view(np.uint64), radius)
            return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

        for pdf in batches:
            if not len(pdf):
                continue
            at, fp = pdf[place].to_numpy(np.int64), pdf["fp"].to_numpy()
            cut = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            ready = []
            for i, j in zip([0, *cut], [*cut, len(fp)]):
                if tuple(at[i]) != last:
                    if sum(map(len, held)) > 1:
                        ready.append(found())
                    last, held = tuple(at[i]), []
                held.append(fp[i:j])
            if ready:
                yield pd.concat(ready)
        if sum(map(len, held)) > 1:
            yield found()

    return met.repartition(*place).sortWithinPartitions(*place).mapInPandas(run, "a long, b long").distinct()


def _split(met: DataFrame, large: DataFrame, free) -> DataFrame:
    masks = F.element_at(free, F.col("table") + 1)
    subs = F.transform(masks, lambda m, i: F.struct(i.alias("sub"), F.col("fp").bitwiseAND(m).alias("subkey")))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    each = F.explode(F.when(F.col("large"), subs).otherwise(whole)).alias("s")
    return met.join(large, ["table", "key"], "left").select("fp", "table", "key", each).select("fp", "table", "key", "s.sub", "s.subkey")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots: the least node of its component, by large-star and small-star steps. The
    links of a star's centre are joined with its least neighbour in parts; each node's neighbours are counted as the least is found, which tells
    centres, and the end: every node with a lesser neighbour has no other."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    counts = (F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = checkpointed(both.groupBy("u").agg(*counts))
        unlike, hubs = least.agg(F.count_if(F.expr("m < u AND _n > 1")), F.count_if(is_hub())).first()
        if not unlike:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = counted_join(both, least.withColumn("m", F.least("m", "u")), "u", hubs).where("v > u")
        large = checkpointed(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpointed(large.groupBy("u").agg(*counts))
        small = counted_join(large, least, "u", least.where(is_hub()).count())
        edges = checkpointed(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(key, fp, component_id): the fingerprint of each document and the least key among documents linked to it.

    Null and empty texts share fingerprint 0; very long texts are read whole, in parts. A null key is never a component's least unless
    all its keys are null. Repeated rows stay, each with the same result; of equal keys it doesn't matter which is the least. An empty
    table gives no rows; other columns are not carried, so none can clash.
    """
    prints = stored(docs.select(F.col(f"`{key}`"), fingerprints(F.col(f"`{text}`"), shingle, seed).alias("fp")), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(candidates(nodes.select("fp"), radius))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = stored(nodes, "rooted")
    linked = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(linked, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")
