"""Temperature mixing of sources: weights, token budgets and the block permutations that realise them.

Source s holds a share p_s of all tokens and gets the weight p_s**a / sum(p**a). The exponent a in [0, 1] is bisected: the
largest one whose entropy reaches the target, or the smallest one that repeats no source more often than allowed. The
budget of a source is its weight times the tokens of the mixture. It is realised as whole epochs and a part of one more. In
every epoch a source's blocks, and the documents in a block, stand in an order drawn anew from a keyed hash, and a document is
in the part if the tokens before it in that order are below what is left of the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import checkpointed, stored, words

#: Share of the greatest possible entropy that the mixture has at least.
ENTROPY = 0.97
#: Tokens of a block.
BLOCK_TOKENS = 1 << 18
#: Bisection steps that one job evaluates, and jobs: the exponent is right to 2**-40, then rounded to 1e-6.
_STEPS, _JOBS = 5, 8
#: Sources up to this number are joined by broadcast (under 20 MB); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Hexadecimal digits of a block's turn that name its range: a source's blocks are added up range by range.
RANGE_DIGITS = 3
#: Key of a null source; the other sources' keys begin with "s".
_NULL = "n"


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit(_NULL)).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def exponent(totals: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, budget: float = 1.0) -> float:
    """The exponent for (source_key, tokens > 0). Each job sums over the sources for the points of five bisection levels.

    entropy: at least this share of log(sources). repeats: no source more than so many times over, with `budget` times all
    tokens in the mixture; 1.0 (in proportion) if that can't be met. No source: 1.0.
    """
    n, total = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def fits(points: list[float]) -> list[bool]:
        row = totals.agg(*(x for a in points for x in (F.sum(share**a), F.sum(share**a * F.log(share) * a), F.max(share ** (a - 1))))).first()
        out = []
        for i in range(len(points)):
            z, e, rare = row[3 * i : 3 * i + 3]
            out.append(math.log(z) - e / z >= entropy * math.log(n) - 1e-9 if repeats is None else budget * rare / z > repeats)
        return out  # true: a may still grow

    if fits([1.0])[0]:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(_JOBS):
        width = 2**_STEPS
        points = [low + (high - low) * i / width for i in range(1, width)]
        ok = [True, *fits(points), False]
        i = 0
        for half in (width >> k for k in range(1, _STEPS + 1)):  # the bisection proper
            i += half if ok[i + half] else 0
        low, high = low + (high - low) * i / width, low + (high - low) * (i + 1) / width
    return round(low if repeats is None else high, 6)


def mix(docs: DataFrame, *, tokens: Column | None = None, source: str = "source", key: str = "doc_id", budget: float = 1.0, entropy: float | None = ENTROPY, repeats: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """Rows of `docs`, once for each epoch that takes them, with `mix_epoch` int, `mix_block` long and `mix_order` string.

    A source's rows sorted by (mix_epoch, mix_order) are its permutation. tokens: what a row counts (words of `text`); rows of no
    tokens (null and empty texts) are dropped, as no budget can hold them. A null source is a source of its own; rows of one key, null
    included, stand together. A very long text is one row of a block, over its size if need be. Columns of `docs` with the three
    names are replaced; others of any name stay. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("mix_epoch", "mix_block", "mix_order")]
    tokens = F.size(words(F.col("text"))) if tokens is None else tokens
    slim = stored(docs.select(F.col(key).alias("k"), _key(source).alias("s"), tokens.cast("long").alias("n")).where("n > 0"), "tokens")
    totals = checkpointed(slim.groupBy("s").agg(F.sum("n").alias("tokens")))
    a = exponent(totals.withColumnRenamed("s", "source_key"), entropy, repeats, budget)
    total, z = _sums(totals, a)
    owed = F.round(F.lit(budget * total) * (F.col("tokens") / F.lit(float(total or 1))) ** a / F.lit(z)).cast("long")
    plan = totals.select("s", "tokens", owed.alias("owed")).select(
        "s", F.floor(F.col("owed") / F.col("tokens")).cast("int").alias("epochs"), (F.col("owed") % F.col("tokens")).alias("rest"), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long").alias("blocks")
    )
    plan = checkpointed(plan)
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)

    def ordered(epoch: Column) -> Column:
        """Block, block's place and document's place: the order of an epoch is by the last two."""
        h = _hash(F.lit(seed), F.col("k"))
        block = F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % F.col("blocks")
        return F.struct(block.alias("block"), F.concat_ws("-", _hash(F.lit(seed), epoch, F.col("s"), block), _hash(epoch, h)).alias("place"))

    part = slim.join(hint(plan.where("rest > 0")), "s").withColumn("o", ordered(F.col("epochs"))).select("s", "n", "rest", F.col("o.block").alias("block"), F.col("o.place").alias("place"), F.substring("o.place", 1, 32).alias("turn"))
    blocks = checkpointed(part.groupBy("s", "rest", "block", "turn").agg(F.sum("n").alias("n")).withColumn("range", F.substring("turn", 1, RANGE_DIGITS)))
    ranges = blocks.groupBy("s", "range").agg(F.sum("n").alias("in_range"))  # 16**RANGE_DIGITS rows of a source at most
    start = F.sum("in_range").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_range")
    ranges = ranges.withColumn("start", start)
    ahead = F.sum("n").over(Window.partitionBy("s", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    before = F.col("start") + ahead
    edge = blocks.join(ranges, ["s", "range"]).where("start < rest AND start + in_range >= rest").withColumn("before", before)
    edge = checkpointed(edge.where("before < rest AND before + n >= rest").select("s", "block", (F.col("rest") - F.col("before")).alias("room")))
    inner = part.join(hint(edge) if small else edge, ["s", "block"]).groupBy("s", "room", "place").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("s").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    cut = inner.withColumn("ahead", ahead).where("ahead < room").groupBy("s").agg(F.max("place").alias("last"))
    plan = checkpointed(plan.join(cut, "s", "left").select(F.col("s").alias("mix_s"), "epochs", "blocks", "last"))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(key).alias("k"), _key(source).alias("s"), tokens.cast("long").alias("n")).where("n > 0")
    rows = rows.join(hint(plan), F.col("s") == F.col("mix_s"))
    rows = rows.withColumn("mix_part", F.coalesce(ordered(F.col("epochs"))["place"] <= F.col("last"), F.lit(False)))
    taken = F.col("epochs") + F.col("mix_part").cast("int")
    rows = rows.where(taken > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), taken - 1))).withColumn("mix_o", ordered(F.col("mix_epoch")))
    return rows.select(*(F.col("row")[c].alias(c) for c in names), "mix_epoch", F.col("mix_o.block").alias("mix_block"), F.col("mix_o.place").alias("mix_order"))


def _sums(totals: DataFrame, a: float) -> tuple[int, float]:
    """All tokens, and the sum of their shares to the power a."""
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    z = totals.agg(F.sum((F.col("tokens") / F.lit(float(total or 1))) ** a)).first()[0] or 1.0
    return total, z
