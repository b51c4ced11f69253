"""SimHash near copies at a similarity: wide fingerprints, bit-sliced comparison, exact check of the links, components.

A radius that holds pairs of a similarity of 0.8 is too wide for bands of bits. So documents meet under TABLES keys of three least shingle
hashes each: two sets of similarity s share a least hash with probability s and a key with s**3, so at 0.8 all keys are missed by 6
pairs in ten million. Keys that
only one document has go no further. Where documents meet, those of sizes that allow the similarity are compared by fingerprints of 256
bits as vertical bit planes, short sets with a wider radius. A meeting sends on the links of a forest, nearest first, so links never
outgrow what met. Every link's similarity is then computed exactly. Where one falls short, another link may still join the two
sides: the nodes around it meet again with their shingle sets, and there every such link that would join two sides is computed.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from citegrain.llm.common import batch_rows, give_back, spread_join, stored
from citegrain.llm.simhash import components

BITS = 256
#: Keys of a document, and least hashes in each.
TABLES, WIDTH = 20, 3
#: Sets of fewer shingles are short: fingerprints of few hashes differ in more bits.
SHORT = 20
#: Differing bits that a pair of similarity 0.8 stays within but 5 times in a million (39 expected, standard deviation 5.7), those of short
#: sets (48 at most expected, for 4 and 5 shingles; two in ten million), and those of the first comparison.
RADIUS, SHORT_RADIUS, CLOSE = 64, 80, 28
#: Nodes of one meeting; larger groups are split into parts of half of it, and every two parts meet.
TILE = 8192
#: Groups up to a word of planes are compared side by side rather than upright.
SMALL = 64
#: Nodes and bytes of one meeting where nodes bring their shingle sets, and rows that go to a worker at once.
SET_TILE, SET_BYTES, SET_ROWS = 1024, 1 << 23, 1024
_CHUNK = 1 << 13
_ODD = np.random.default_rng(42).integers(0, 1 << 63, TABLES * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(43).integers(0, 1 << 63, max(TABLES * WIDTH, BITS // 64), np.uint64)
_SKETCH = StructType([StructField("node", BinaryType()), StructField("fp", BinaryType()), StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))])


def shingle_words(text: str | None) -> list[bytes]:
    """Words of the text, ASCII letters in lower case; null: none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest(words: list[bytes]) -> bytes:
    """One for all texts of the same words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles (fewer words: of the whole sequence; none: of none)."""
    found = []
    for i in range(0, max(len(words) - shingle + 1, min(len(words), 1)), _CHUNK):
        part = words[i : i + _CHUNK + shingle - 1]
        grams = list(map(b" ".join, zip(*(part[k:] for k in range(shingle))))) or [b" ".join(part)]
        found.append(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits, each set in over half of the distinct shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        h = np.stack([_mixed(hashes[i : i + _CHUNK], s) for s in _SALT[: BITS // 64]], axis=1)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys under which the set of hashes meets others; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.array([((hashes ^ s) * m).min() for s, m in zip(_SALT, _ODD)], np.uint64).reshape(TABLES, WIDTH)
    key = _mixed(np.arange(TABLES, dtype=np.uint64), _SALT[2])
    for column in least.T:
        key = _mixed(key ^ column, _SALT[0])
    return key.view(np.int64)


def sketches(text: Column, shingle: int = 5) -> Column:
    """(node, fp, n, keys) of a text."""

    @F.pandas_udf(_SKETCH)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            words = shingle_words(x)
            hashes = shingle_set(words, shingle)
            rows.append((digest(words), fingerprint(hashes), len(hashes), keys(hashes)))
        give_back()
        return pd.DataFrame(rows, columns=["node", "fp", "n", "keys"])

    return run(text)


def within(queries: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, print) of positions of rows of bytes within `radius`, by carry-save counters over bit planes of `prints`.

    The counters of all queries run side by side and overflow on the (radius + 1)-th difference; a word of 64 prints is
    abandoned once all of them exceed the radius for all queries.
    """
    width, bits = radius.bit_length(), prints.shape[1] * 8
    upright = np.unpackbits(prints, axis=1).T
    upright = np.pad(upright, ((0, 0), (0, -upright.shape[1] % 64)))
    upright = np.ascontiguousarray(np.packbits(upright, axis=1, bitorder="little")).view("<u8")
    flip = np.where(np.unpackbits(queries, axis=1).T > 0, ~np.uint64(0), np.uint64(0))
    live = np.arange(upright.shape[1])
    start = (1 << width) - 1 - radius
    counters = [np.full((len(queries), len(live)), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(width)]
    over = np.zeros((len(queries), len(live)), np.uint64)
    for bit in range(bits):
        carry = upright[bit][None, live] ^ flip[bit][:, None]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit >= radius and bit % 16 == 15:
            keep = np.flatnonzero((~over).any(axis=0))
            if len(keep) < len(live):
                live, over, counters = live[keep], over[:, keep], [c[:, keep] for c in counters]
    if not len(live):
        return np.zeros(0, int), np.zeros(0, int)
    hits = np.unpackbits(np.ascontiguousarray(~over).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    row, col = np.nonzero(hits)
    at = live[col // 64] * 64 + col % 64
    return row[at < len(prints)], at[at < len(prints)]


def _near(prints: np.ndarray, sizes: np.ndarray, radius: int, similarity: float):
    """(i, later places j in order) of what is within the radius and of like sizes."""
    for start in range(0, len(prints), 128):
        row, col = within(prints[start : start + 128], prints, radius)
        row = row + start
        like = (np.minimum(sizes[row], sizes[col]) >= similarity * np.maximum(sizes[row], sizes[col])) & (row != col)
        row, col = row[like], col[like]
        each, first = np.unique(row, return_index=True)
        for i, a, b in zip(each.tolist(), first, [*first[1:], len(row)]):
            yield i, col[a:b]


def forest(prints: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join everything of like sizes within RADIUS, or SHORT_RADIUS for short sets, nearer ones first."""
    label, out = np.arange(len(prints)), []
    short = sizes < SHORT

    def join(i: int, near: np.ndarray) -> None:
        near = near[label[near] != label[i]]
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            out.extend((i, int(near[k])) for k in first)
            label[np.isin(label, others)] = label[i]

    if len(prints) <= SMALL:
        wide = np.ascontiguousarray(prints).view(np.uint64)
        apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2, dtype=np.int64)
        like = np.minimum(sizes[:, None], sizes[None]) >= similarity * np.maximum(sizes[:, None], sizes[None])
        i, j = np.nonzero(np.triu(like & (apart <= np.where(short[:, None] & short[None], SHORT_RADIUS, RADIUS)), 1))
        order = np.argsort(apart[i, j], kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            join(a, np.array([b]))
        return out
    for radius in (CLOSE, RADIUS):
        for i, near in _near(prints, sizes, radius, similarity):
            join(i, near)
    rest = np.flatnonzero(short)
    for i, near in _near(prints[rest], sizes[rest], SHORT_RADIUS, similarity):
        join(int(rest[i]), rest[near])
    return out


def similar_forest(prints: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], sides: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) of the similarity and within the radius that join what isn't on one side yet."""
    label, out = np.unique(np.array(sides, object), return_inverse=True)[1], []

    def test(i: int, near: np.ndarray) -> None:
        for j in near[near > i].tolist():
            if label[i] != label[j]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                    out.append((i, j))
                    label[label == label[j]] = label[i]

    for i, near in _near(prints, sizes, RADIUS, similarity):
        test(i, near)
    rest = np.flatnonzero(sizes < SHORT)
    for i, near in _near(prints[rest], sizes[rest], SHORT_RADIUS, similarity):
        test(int(rest[i]), rest[near])
    return out


def candidates(nodes: DataFrame, similarity: float, tile: int = TILE, sets: bool = False) -> DataFrame:
    """Distinct links (a, b) of nodes (node, fp, n, keys) that meet and are within the radius.

    sets: nodes also have `s` (their shingle set) and `side`; links have the similarity and are those of the sides that they join.
    """
    extra = ["s", "side"] if sets else []
    slim = nodes.select("node", "n", F.explode("keys").alias("key"))
    whole = slim.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("n").cast("long")).alias("n")).where("count > 1")
    load = F.greatest(F.col("count") / F.lit(SET_TILE), F.col("n") * 8 / F.lit(SET_BYTES)) if sets else F.col("count") / F.lit(tile)
    shared = whole.select("key", F.when(load > 1, F.ceil(2 * load)).otherwise(1).cast("int").alias("parts"))
    slim = slim.drop("n")
    met = slim.join(shared, "key")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, own) * F.col("parts") + F.greatest(p, own))
    met = met.select("node", "key", F.explode(pairs).alias("part")).join(nodes.select("node", "fp", "n", *extra), "node")
    place = ["key", "part"]

    def run(batches):
        """Rows stand by place; a group is compared when the next begins."""
        last, held, ready = None, [], []

        def compare() -> None:
            if len(held) > 1:
                ids, prints, sizes, *more = zip(*held)
                prints, sizes = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), np.array(sizes)
                found = similar_forest(prints, sizes, *more, similarity) if more else forest(prints, sizes, similarity)
                named = more[1] if more else ids
                ready.extend((min(named[i], named[j]), max(named[i], named[j])) for i, j in found)

        for pdf in batches:
            rows = zip(*(pdf[c].tolist() for c in (*place, "node", "fp", "n", *extra)))
            for at, group in groupby(rows, key=lambda r: r[:2]):
                if at != last:
                    compare()
                    last, held = at, []
                held.extend(r[2:] for r in group)
            if ready:
                yield pd.DataFrame(ready, columns=["a", "b"])
                ready.clear()
        compare()
        if ready:
            yield pd.DataFrame(ready, columns=["a", "b"])
        held.clear()
        ready.clear()
        give_back()

    return met.repartition(*place).sortWithinPartitions(*place).mapInPandas(run, "a binary, b binary").distinct()


def shingle_sets(need: DataFrame, docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(node, s): the shingle set of each node of `need` (node, least), read from a document of its least key, so that copies of one
    text don't meet."""

    @F.pandas_udf(BinaryType())
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(shingle_words(x)) for x in texts])

    @F.pandas_udf(ArrayType(LongType()))
    def set_of(texts: pd.Series) -> pd.Series:
        sets = pd.Series([shingle_set(shingle_words(x), shingle).view(np.int64) for x in texts])
        give_back()
        return sets

    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).withColumn("node", node_of("t"))
    one = need.select(F.col("node").alias("n"), "least")
    texts = texts.join(one, (F.col("node") == F.col("n")) & F.col("k").eqNullSafe(F.col("least")), "left_semi")
    return texts.groupBy("node").agg(F.min("t").alias("t")).select("node", set_of("t").alias("s"))


def similar_roots(nodes: DataFrame, docs: DataFrame, text: str, key: str, shingle: int, similarity: float) -> DataFrame:
    """(node, root): the least of those of the nodes (node, least, fp, n, keys) that links of the similarity reach, for each that has any link.

    Sides are what tested links join. Sides that a link which falls short has an end in meet again, and links found there join whole sides."""
    loose = stored(candidates(nodes, similarity), "links")
    need = loose.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(shingle_sets(nodes.select("node", "least").join(need, "node"), docs, text, key, shingle), "sets")
    both = spread_join(loose, sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    both = spread_join(both, sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b", counted=loose)
    shared = F.size(F.array_intersect("x", "y"))
    tested = stored(both.select("a", "b", (shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).alias("good")), "tested")

    sides = components(tested.where("good").select("a", "b")).withColumnRenamed("root", "side")
    sides = stored(sets.select("node").join(sides, "node", "left").select("node", F.coalesce("side", "node").alias("side")), "sides")
    short = tested.where("NOT good").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    short = sides.join(short, "node").select("side").distinct()
    again = sides.join(short, "side", "left_semi").select("node", "side")
    again = stored(again.join(nodes.select("node", "fp", "n", "keys"), "node").join(sets, "node"), "again")
    joined = components(candidates(again, similarity, sets=True)).withColumnRenamed("node", "side")
    return sides.join(joined, "side", "left").select("node", F.coalesce("root", "side").alias("root"))


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id): the least key among the documents linked to each.

    Texts of the same words in either case are linked, null and empty ones among themselves; other texts are linked from the
    similarity on. A null key is never a component's least unless all its keys are null. Repeated rows stay, each with the same
    result; very long texts are read whole, in parts. An empty table gives no rows; other columns are not carried, so none can clash.
    """
    with batch_rows(docs.sparkSession, SET_ROWS):
        prints = stored(docs.select(F.col(f"`{key}`").alias("k"), sketches(F.col(f"`{text}`"), shingle).alias("p")).select("k", "p.*"), "sketches")
        nodes = stored(prints.groupBy("node").agg(F.min("k").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys")), "nodes")
        roots = similar_roots(nodes, docs, text, key, shingle, similarity)
    rooted = stored(nodes.select(F.col("node").alias("n"), "least").join(roots, F.col("n") == F.col("node"), "left").select("n", "least", F.coalesce("root", "n").alias("root")), "rooted")
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(linked, "root").select(F.col("n").alias("node"), "component_id")
    return prints.select("k", "node").join(named, "node").select(F.col("k").alias(key), "component_id")
