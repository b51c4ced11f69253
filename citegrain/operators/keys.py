"""Citation keys: duplicates, suffixes and their repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions.names import surnames
from citegrain.operators.ranks import ranked
from citegrain.sources.tables import stored

#: Rows of a base that one task deals with.
HOT = 100_000


def duplicate_groups(df: DataFrame, by: list[str], members: list[str]) -> DataFrame:
    """(by, n, members): the rows whose values `by` occur more than once, and how often; a group has a row for each member."""
    more = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    more = more.select(*(F.col(c).alias(f"_{c}") for c in by), "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return df.join(more, same).select(*by, "n", *members)


def duplicate_keys(entries: DataFrame) -> DataFrame:
    """(ID, n) of keys that occur more than once."""
    return entries.groupBy("ID").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """(title, surnames, n, pos, ID) of the entries that share a title and a list of surnames with others; a missing title reads as empty."""
    df = entries.select("pos", "ID", F.coalesce("title", F.lit("")).alias("title"), F.array_join(surnames(F.col("author")), " and ", "").alias("surnames"))
    return duplicate_groups(df, ["title", "surnames"], ["pos", "ID"])


def suffix(n: Column) -> Column:
    """The n-th suffix from 0: a to z, aa, ab, ... (bijective base 26), of any long."""
    letter = lambda k: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26 + 1).cast("int"), F.lit(1))
    step = lambda a, _: F.when(a["n"] < 0, a).otherwise(F.struct((F.call_function("div", a["n"], F.lit(26)) - 1).alias("n"), F.concat(letter(a["n"]), a["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("n"), F.lit("").alias("s")), step)["s"]


def suffix_number(s: Column) -> Column:
    """The number of a suffix (inverse of suffix()); null for what is none, or one of more than 12 letters."""
    code = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 96))
    return F.when(s.rlike("^[a-z]{1,12}$"), code - 1)


def repair(keys: DataFrame) -> DataFrame:
    """`keys` (pos, ID, base, ...) with `target`. A base alone is its entry's key. Of several entries, keys that are the base and one of
    the first n suffixes stay; the others take the unused suffixes, both in order.

    The m-th unused number is m and the used numbers before it: those whose own number, less the used ones below, is at most m. So the used and
    the moved are put in one order and counted up. A group is dealt with where its rows are, in one shuffle; those of over HOT rows, if there are any, are counted by ranges.
    """
    rows = stored(keys.withColumn("_u", F.when(F.startswith("ID", F.col("base")), suffix_number(F.substr("ID", F.length("base") + 1, F.length("ID"))))), "keys")
    hot = stored(rows.where("base IS NOT NULL").groupBy(F.col("base").alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT), "hot")
    if hot.isEmpty():
        return _repaired(rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("base"))), _by_group).select(*keys.columns, "target")
    few = rows.join(hot, F.col("base") == F.col("_hot"), "left_anti")
    many = rows.join(hot, F.col("base") == F.col("_hot")).drop("_hot")
    done = (_repaired(few.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("base"))), _by_group), _repaired(many, _by_ranges))
    return done[0].select(*keys.columns, "target").unionByName(done[1].select(*keys.columns, "target"))


def _repaired(rows: DataFrame, number: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` (with _n, the rows of their base) with `target`; `number` gives the moved ones the number of their suffix."""
    alone = F.col("base").isNull() | (F.col("_n") == 1)
    numbered = number(rows.withColumn("_u", F.when(~alone & (F.col("_u") < F.col("_n")), F.col("_u"))).withColumn("_moved", ~alone & F.col("_u").isNull()))
    target = F.when(alone, F.col("base")).when(F.col("_moved"), F.concat("base", suffix(F.col("_new")))).otherwise(F.col("ID"))
    return numbered.withColumn("target", target)


def _by_group(rows: DataFrame) -> DataFrame:
    """Numbers of the moved rows, each base in one place."""
    own = Window.partitionBy("base")
    first = (F.row_number().over(own.orderBy(F.col("_u").asc_nulls_last(), "pos")) == 1) | (F.lag("_u").over(own.orderBy(F.col("_u").asc_nulls_last(), "pos")) != F.col("_u"))
    rows = rows.withColumn("_first", F.coalesce(first & F.col("_u").isNotNull(), F.lit(False)))
    below = F.sum(F.col("_first").cast("long")).over(own.orderBy(F.col("_u").asc_nulls_last(), F.desc("_first"), "pos").rowsBetween(Window.unboundedPreceding, -1))
    rank = F.row_number().over(own.orderBy(F.desc("_moved"), "pos")) - 1
    rows = rows.withColumn("_at", F.when(F.col("_first"), F.col("_u") - F.coalesce(below, F.lit(0))).when(F.col("_moved"), rank))
    used = F.sum(F.col("_first").cast("long")).over(own.orderBy(F.col("_at").asc_nulls_last(), F.desc("_first")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", F.when(F.col("_moved"), F.col("_at") + used))


def _by_ranges(rows: DataFrame) -> DataFrame:
    """As _by_group(), for bases of any size: ranks are those of ranges, added up."""
    used = rows.where("_u IS NOT NULL").select("base", "_u").distinct()
    used = ranked(used, ["base"], "_u", "_below").select("base", (F.col("_u") - F.col("_below") + 1).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_row"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    moved = ranked(rows.where("_moved").select("base", "pos", "_row"), ["base"], "pos", "_at").select("base", (F.col("_at") - 1).alias("_at"), F.lit(1).alias("_kind"), "_row")
    both = ranked(used.unionByName(moved).withColumn("_order", F.col("_at") * 2 + F.col("_kind")), ["base"], "_order", "_place")
    # of the rows up to a moved one, all but the moved ones before it and itself are used numbers
    new = both.where("_kind = 1").select(F.col("_row").alias("_r"), (F.col("_place") - 1).alias("_new"))
    return rows.join(new, F.col("_row") == F.col("_r"), "left").drop("_r", "_row")
