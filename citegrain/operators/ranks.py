"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places of a range, as a power of two.
RANGE = 20


def ranked(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """`df` with `name`: the place (from 1) of each row in its group `by` when sorted by the whole number `order`, nulls first.

    `order` is a place in a table, so that few rows share one. A group is ranked by ranges of 2**RANGE places, whose counts are added up: no
    task holds a whole group. Ties are ranked in any order.
    """
    df = df.withColumn("_part", F.shiftright(F.col(order).cast("long"), RANGE))
    counts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(F.asc_nulls_first(order)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = df.withColumn("_own", own).join(counts, [*same, F.col("_part").eqNullSafe(F.col("_p"))])
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_p", "_own", "_before", *(f"_{c}" for c in by))
