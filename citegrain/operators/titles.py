"""Titles of a catalogue as an index: a search of the best by shared words, and all that are nearly the same letter by letter.

**Search** finds the `k` best of all titles by the weight of the words they share. A word's weight is its rarity; relevance is the
shared weight, doubled, over the weights of both titles. Posting lists are kept by word in blocks of titles of like weight. A query reads its
rarest words' lists first; once the words it hasn't read yet can't make a title as relevant as the k-th found, it is done, and blocks whose weights rule them out are skipped.

**Near titles** are all pairs whose ratio of matching characters is at least a bound, none left out. The ratio is 2M / L (M matched characters, L both
lengths). Matches stand in at most L - 2M + 1 blocks and each block of m characters holds m - 1 pairs of neighbours, so such titles share at least 3M - L - 1
bigrams. Hence, of bigrams in a common order, the first few of both titles have two in common: titles meet under pairs of those, within a class of
lengths, so that no common word or bigram alone makes a pair. Short titles have too few bigrams for that: of two titles within d edits, one that is cut into d + 1
parts has a part that the other has too, moved by no more letters than there are parts before or after it. They meet under such parts, which are cut so that
all are about as rare: places where most titles have the same letter tell little. Of those that meet, marks of 128 bits tell most that differ in too many bigrams.

A query's most common word adds nothing but titles that share no other word of it: of those the best are the lightest that have the word, so its list is never read beyond these.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b
from itertools import accumulate, pairwise
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from citegrain.sources.tables import new_path, read_bucketed, spread, stored, unsent, write_bucketed

#: Titles of a posting block (on average), units of a word's weight, and the weights that blocks of a word are told apart by.
BLOCK, UNIT, BAND = 512, 1000, 4000
#: Fixed value: titles of this ratio or more can be the same work.
NEAR = 0.85
#: Letters of normalised titles.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Bits of a bigram's place and of its number in a key; numbers beyond count as one.
_PLACE, _TIMES = 11, 16
#: Titles of more letters than this, which are few, meet under single bigrams, so that keys don't grow with the square of a title.
LONG = 256
#: Kept titles of no more letters than this meet others under parts of theirs.
SHORT = 32
#: Lightest titles that are kept for each word; a search for more reads whole lists.
HEAD = 16


# --- bigrams ---------------------------------------------------------------------------------------------------------------


def matched(length: int, ratio: float) -> int:
    """Least matched characters of two titles of this length together."""
    return math.ceil(ratio * length / 2 - 1e-9)


def shared_bigrams(length: int, ratio: float) -> int:
    """Least bigrams that two titles of this length together share."""
    return 3 * matched(length, ratio) - length - 1


def reach(n: int, ratio: float) -> range:
    """Lengths of the titles that can be that near to one of n letters."""
    return range(math.ceil(n * ratio / (2 - ratio) - 1e-9), math.floor(n * (2 - ratio) / ratio + 1e-9) + 1)


def length_class(n: int, ratio: float) -> int:
    """Classes of lengths: near titles are in the same or in neighbouring ones."""
    return int(math.log(max(n, 1)) / math.log((2 - ratio) / ratio) + 1e-9)


def bigrams(title: str, order: dict[str, int]) -> list[int]:
    """The title's bigrams as numbers, in the common order; the second of a kind isn't the first."""
    seen: Counter[str] = Counter()
    out = set()
    for i in range(len(title) - 1):
        g = title[i : i + 2]
        out.add((order.get(g, 0) << _TIMES) | min(seen[g], (1 << _TIMES) - 1))
        seen[g] += 1
    return sorted(out)


def edits(n: int, m: int, ratio: float) -> int:
    """Most edits between titles of n and m letters that are near."""
    return n + m - 2 * matched(n + m, ratio)


def in_parts(n: int, m: int, ratio: float) -> bool:
    """Whether a kept title of n letters meets one of m letters under parts."""
    return n <= SHORT and edits(n, m, ratio) < n


def part_bounds(d: int, n: int, rarity: list[float] | None = None) -> list[int]:
    """Bounds of the d + 1 parts of a title of n letters: of even lengths, or of even sums of its places' `rarity`."""
    if rarity is None:
        return [i * n // (d + 1) for i in range(d + 2)]
    sums = list(accumulate(rarity))
    out = [0]
    for i in range(1, d + 1):
        at = 1 + bisect_left(sums, sums[-1] * i / (d + 1) - 1e-9)
        out.append(max(out[-1] + 1, min(at, n - (d + 1 - i))))
    return [*out, n]


def part_keys(title: str, ratio: float, asks: bool, lengths: set[int] | None = None, rarity: dict[int, list[float]] | None = None) -> set[int]:
    """Keys of the parts of a title that is kept, or of what may be such a part in a title that asks (`lengths`: those of kept titles, if known; `rarity`: that of places,
    by a kept title's length)."""
    lengths = reach(len(title), ratio) if lengths is None or not asks else [n for n in reach(len(title), ratio) if n in lengths]
    pairs = [(n, len(title)) if asks else (len(title), n) for n in lengths]
    cuts = {(edits(n, m, ratio), n, m if asks else n) for n, m in pairs if in_parts(n, m, ratio)}
    out = set()
    for d, n, m in cuts:
        bounds = part_bounds(d, n, (rarity or {}).get(n))
        for i, (start, end) in enumerate(pairwise(bounds)):
            moves = range(max(-i, m - n - (d - i)), min(i, m - n + (d - i)) + 1) if asks else (0,)
            out.update(_part_key(d, n, i, title[start + x : end + x]) for x in moves if start + x >= 0 and end + x <= len(title))
    return out


def _part_key(d: int, n: int, i: int, part: str) -> int:
    """Below zero, unlike keys of bigrams."""
    return -1 - (int.from_bytes(blake2b(f"{d},{n},{i},{part}".encode(), digest_size=8).digest()) >> 2)


def keys(title: str, order: dict[str, int], ratio: float, asks: bool, lengths: set[int] | None = None, rarity: dict[int, list[float]] | None = None) -> list[int]:
    """Keys of a title: parts with short titles, else pairs of its first bigrams, and single ones where near titles may share only one or the titles are long. A title that asks has
    keys for each class of lengths in its reach; one that is kept has those of its own class."""
    n = len(title)
    shares: dict[int, int] = {}
    for m in reach(n, ratio):
        if in_parts(*((m, n) if asks else (n, m)), ratio):
            continue
        c = length_class(m if asks else n, ratio)
        shares[c] = min(shares.get(c, n), shared_bigrams(n + m, ratio))
    out = part_keys(title, ratio, asks, lengths, rarity)
    found = bigrams(title, order) if shares else []
    for c, least in shares.items():
        if c > length_class(LONG, ratio):
            out.update(_key(c, a, a) for a in found[: len(found) - least + 1])
            continue
        first = found[: len(found) - max(least, 2) + 2]
        out.update(_key(c, a, b) for i, a in enumerate(first) for b in first[i + 1 :])
        if least < 2:
            out.update(_key(c, a, a) for a in found)
    return sorted(out)


def _key(c: int, a: int, b: int) -> int:
    return (c << 2 * (_PLACE + _TIMES)) | (a << (_PLACE + _TIMES)) | b


def _keys_of(title: Column, order: dict[str, int], ratio: float, asks: bool, lengths: set[int] | None = None, rarity: dict[int, list[float]] | None = None) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def of(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: keys(t, order, ratio, asks, lengths, rarity))

    return of(title)


def marks(title: str) -> list[int]:
    """128 bits in two numbers: one of them is set for each bigram, the second of a kind being another. So marks differ in no more bits than titles do in bigrams."""
    seen: Counter[str] = Counter()
    out = 0
    for i in range(len(title) - 1):
        g = title[i : i + 2]
        out |= 1 << (crc32(f"{g}{seen[g]}".encode()) & 127)
        seen[g] += 1
    return [x - (1 << 64) if x >> 63 else x for x in (out >> 64, out & (1 << 64) - 1)]


@F.pandas_udf(ArrayType(LongType()))
def _marks_of(titles: pd.Series) -> pd.Series:
    return titles.map(marks)


def _rarity(titles: DataFrame) -> dict[int, list[float]]:
    """For each length of short titles: how much a letter at each place tells, by the chance that two titles have the same there. SHORT * SHORT numbers at most."""
    letters = titles.where(F.length("c_title") <= SHORT).select(F.length("c_title").alias("n"), F.posexplode(F.filter(F.split("c_title", ""), lambda z: z != "")).alias("i", "z"))
    times = letters.groupBy("n", "i", "z").agg(F.count(F.lit(1)).cast("double").alias("x"))
    out: dict[int, list[float]] = {}
    for r in times.groupBy("n", "i").agg((F.sum(F.col("x") * F.col("x")) / F.pow(F.sum("x"), F.lit(2.0))).alias("same")).orderBy("n", "i").collect():
        out.setdefault(r["n"], []).append(round(0.01 - math.log(r["same"]), 6))
    return out


def _order(titles: DataFrame) -> dict[str, int]:
    """Places of bigrams, rare ones first. There are 1369 at most."""
    each = titles.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c_title") - 1), lambda i: F.substr("c_title", i, F.lit(2))))).alias("g")).where(F.length("g") == 2)
    rows = each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "g").limit(len(_LETTERS) ** 2).collect()
    return {r["g"]: i for i, r in enumerate(rows, 1)}


# --- words -----------------------------------------------------------------------------------------------------------------


def words(title: Column) -> Column:
    """Distinct words of a normalised title."""
    return F.filter(F.array_distinct(F.split(title, " ")), lambda w: w != "")


def _weight(n: int, df: Column) -> Column:
    """A word's weight in whole units, at least 1: log of the titles for each that has it."""
    return F.greatest(F.lit(1), F.floor(F.log((n + 1) / df) * UNIT)).cast("long")


class TitleIndex:
    """Distinct normalised titles of a catalogue (column `c_title`) at `path`; build() makes it, any session may open it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.json(f"{path}/about").first()
        self.buckets, self.size, self.ratio = about["buckets"], about["size"], about["ratio"]
        self.order = {r["g"]: r["i"] for r in about["order"] or []}
        self.rarity = {r["n"]: r["places"] for r in about["rarity"] or []}
        self.lengths = set(self.rarity)

    def table(self, name: str, key: str) -> DataFrame:
        return read_bucketed(self.spark, f"{self.path}/{name}", key, self.buckets)

    @staticmethod
    def build(titles: DataFrame, path: str | None = None, buckets: int | None = None, ratio: float = NEAR) -> TitleIndex:
        """Words and their weights, posting lists by word, titles by number and bigram keys, all bucketed."""
        spark = titles.sparkSession
        path, buckets = path or new_path(spark, "titles"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbered = stored(titles.select("c_title").where("c_title <> ''").distinct().withColumn("t", F.monotonically_increasing_id()).withColumn("w", words(F.col("c_title"))), "distinct")
        size = numbered.count()
        each = numbered.select("t", F.explode("w").alias("word"))
        weights = stored(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", _weight(size, F.col("df")).alias("weight")), "weights")
        write_bucketed(weights, f"{path}/words", "word", buckets)
        weighed = each.join(unsent(weights), "word")
        known = stored(weighed.groupBy("t").agg(F.sum("weight").alias("total"), F.collect_list(F.struct("word", "weight")).alias("w")).join(unsent(numbered.select("t", "c_title")), "t"), "known")
        write_bucketed(known, f"{path}/known", "t", buckets)
        lists = weighed.select("t", "word").join(unsent(known.select("t", "total")), "t").withColumn("band", F.floor(F.col("total") / BAND))
        sizes = lists.groupBy("word", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        blocks = lists.join(sizes, ["word", "band"]).withColumn("part", F.pmod(F.hash("t"), "parts")).groupBy("word", "band", "part").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.collect_list("t").alias("ts"))
        write_bucketed(blocks, f"{path}/postings", "word", buckets)
        first = F.row_number().over(Window.partitionBy("word").orderBy("total", "c_title"))
        light = weighed.select("t", "word").join(unsent(known.select("t", "total", "c_title")), "t").withColumn("place", first).where(F.col("place") <= HEAD)
        write_bucketed(light.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]).alias("ts")), f"{path}/light", "word", buckets)
        order = _order(numbered)
        rarity = _rarity(numbered)
        near = spread(numbered.select("t", "c_title")).select("t", "c_title", _marks_of(F.col("c_title")).alias("m"), _keys_of(F.col("c_title"), order, ratio, False, rarity=rarity).alias("keys"))
        near = near.select("t", "c_title", F.col("m")[0].alias("c_m"), F.col("m")[1].alias("c_n"), F.explode("keys").alias("key"))  # a step later, so that marks are made once a title
        write_bucketed(near, f"{path}/near_keys", "key", buckets)
        about = spark.createDataFrame([(buckets, size, ratio, sorted(order.items()), sorted(rarity.items()))], "buckets int, size long, ratio double, order array<struct<g: string, i: int>>, rarity array<struct<n: int, places: array<double>>>")
        about.coalesce(1).write.json(f"{path}/about")
        return TitleIndex(spark, path)

    def near(self, titles: DataFrame) -> DataFrame:
        """(title, c_title): titles and those of the catalogue that may be near, equal ones aside: all that lengths, edits (matches leave L - 2M
        letters to insert and delete) and shared bigrams don't rule out. So none of the index's ratio or more is left out."""
        asked = spread(titles.where("title <> ''").select("title")).select("title", _marks_of(F.col("title")).alias("m"), _keys_of(F.col("title"), self.order, self.ratio, True, self.lengths, self.rarity).alias("keys"))
        asked = asked.select("title", F.col("m")[0].alias("a_m"), F.col("m")[1].alias("a_n"), F.explode("keys").alias("key"))
        length = F.length("title") + F.length("c_title")
        least = F.ceil(self.ratio * length / 2 - 1e-9)
        marked = F.bit_count(F.col("a_m").bitwiseXOR(F.col("c_m"))) + F.bit_count(F.col("a_n").bitwiseXOR(F.col("c_n"))) <= 3 * length - 6 * least  # bigrams of both that aren't shared, at most
        sized = marked & (2 * F.least(F.length("title"), F.length("c_title")) >= self.ratio * length - 1e-9) & (F.call_function("levenshtein", "title", "c_title", (length - 2 * least).cast("int")) >= 0)
        met = asked.join(self.table("near_keys", "key"), "key").where("title <> c_title").where(sized)  # most that meet are far apart: none of them is kept
        met = stored(met.select("title", "c_title").distinct(), "met")
        return met.where(_common_bigrams(F.col("title"), F.col("c_title")) >= 3 * least - length - 1)

    def search(self, titles: DataFrame, k: int = 3) -> DataFrame:
        """(title, c_title, relevance): the k titles of the catalogue that share most with each title, of equals the first by their letters; fewer where fewer share a word."""
        weighed = titles.select("title").distinct().select("title", F.explode(words(F.col("title"))).alias("word")).join(self.table("words", "word"), "word", "left")
        unknown = max(1, math.floor(math.log(self.size + 1) * UNIT))
        q = weighed.groupBy("title").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("weight", F.lit(unknown))).alias("minus"), "word"))).alias("w"))
        weight = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a - x["minus"])
        active = stored(q.select("title", "w", weight.alias("own"), F.lit(0.0).alias("least")), "asked")
        best: DataFrame | None = None
        read, upto = 0, 1
        while not active.isEmpty():
            best = self._round(active, best, read, upto, k)
            left = F.aggregate(F.slice("w", upto + 1, F.greatest(F.size("w") - upto, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a - x["minus"])
            found = best.groupBy("title").agg(F.when(F.count(F.lit(1)) == k, F.min("relevance")).otherwise(0.0).alias("least"))
            rest = active.drop("least").join(found, "title", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("left", left)
            active = stored(rest.where((F.col("left") > 0) & (2 * F.col("left") / (F.col("own") + F.col("left")) >= F.col("least"))).drop("left"), "asked")
            read, upto = upto, 2 * upto
        none = self.spark.createDataFrame([], "title string, c_title string, relevance double")
        return none if best is None else best

    def _round(self, active: DataFrame, best: DataFrame | None, read: int, upto: int, k: int) -> DataFrame:
        """The k best after the words from `read` to `upto` of each title that isn't done."""
        probes = active.select("title", "own", "least", F.size("w").alias("words"), F.posexplode(F.slice("w", read + 1, upto - read)).alias("i", "x")).select("title", "own", "least", F.col("x.word").alias("word"), ((F.col("i") + read + 1 == F.col("words")) & F.lit(k <= HEAD)).alias("last"))
        fits = (F.col("high") * (2 - F.col("least")) >= F.col("own") * F.col("least")) & (F.col("low") * F.col("least") <= F.col("own") * (2 - F.col("least")))
        listed = probes.where(~F.col("last")).join(self.table("postings", "word"), "word").where(fits).select("title", F.explode("ts").alias("t"))
        light = probes.where("last").join(self.table("light", "word"), "word").select("title", F.explode(F.slice("ts", 1, k)).alias("t"))
        met = listed.unionByName(light).distinct()
        asked = active.select(F.col("title").alias("a_title"), "own", F.transform("w", lambda x: x["word"]).alias("asked"))
        met = met.join(unsent(asked), F.col("title") == F.col("a_title")).join(self.table("known", "t").withColumnRenamed("w", "has"), "t")
        both = F.aggregate(F.filter("has", lambda x: F.array_contains("asked", x["word"])), F.lit(0).cast("long"), lambda a, x: a + x["weight"])
        found = met.select("title", "c_title", (2.0 * both / (F.col("own") + F.col("total"))).alias("relevance"))
        found = found if best is None else found.unionByName(best).distinct()
        rank = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("relevance"), "c_title"))
        return stored(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")


def _common_bigrams(a: Column, b: Column) -> Column:
    """Bigrams that both have, as often as both have them."""
    of = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))
    x, y = F.when(F.length(a) > 1, of(a)).otherwise(F.array().cast("array<string>")), F.when(F.length(b) > 1, of(b)).otherwise(F.array().cast("array<string>"))
    times = lambda of, g: F.size(F.filter(of, lambda z: z == g))
    return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(times(x, g), times(y, g)))
