"""Differences of two versions of a bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias(value)) for f in fields))).alias("x")
    return df.select(F.col("ID").alias("id"), one).select("id", "x.*").where(F.col(value).isNotNull())


def _rows(df: DataFrame, fields: list[str], side: str) -> DataFrame:
    """A row for each ID: how often it occurs, and 128 bits of its fields."""
    value = lambda f: F.coalesce(F.concat(F.lit("="), F.col(f"`{f}`").cast("string")), F.lit("-"))
    sized = F.concat(*(F.concat(F.length(value(f)).cast("string"), F.lit(":"), value(f)) for f in fields))
    return df.select(F.col("ID").alias(f"{side}_id"), F.md5(sized).alias("h")).groupBy(f"{side}_id").agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min("h").alias(f"{side}_h"))


def diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, change, old, new). change: removed and added (whole entries, field null), added_field, deleted_field, modified.

    Versions are compared by a hash of each entry first; only entries that differ, or whose ID is repeated, are taken apart into fields.
    """
    met = _rows(old, fields, "o").join(_rows(new, fields, "n"), F.col("o_id") == F.col("n_id"), "full_outer")
    kind = F.when(F.col("n_n").isNull(), "removed").when(F.col("o_n").isNull(), "added").when((F.col("o_h") != F.col("n_h")) | (F.col("o_n") > 1) | (F.col("n_n") > 1), "differs")
    met = met.select(F.coalesce("o_id", "n_id").alias("id"), kind.alias("change")).where("change IS NOT NULL")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("old", "new")]
    whole = met.where("change <> 'differs'").select("id", F.lit(None).cast("string").alias("field"), "change", *nothing)
    both = met.where("change = 'differs'").select(F.col("id").alias("d_id"))
    a, b = (_long(df.join(both, F.col("ID") == F.col("d_id"), "left_semi"), fields, side) for df, side in ((old, "old"), (new, "new")))
    change = F.when(F.col("old").isNull(), "added_field").when(F.col("new").isNull(), "deleted_field").otherwise("modified")
    fields_changed = a.join(b, ["id", "field"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("id", "field", change.alias("change"), "old", "new")
    return fields_changed.unionByName(whole)


def changed(changes: DataFrame) -> DataFrame:
    """(change, id): entries removed, added and modified, once each."""
    kind = F.when(F.col("change").isin("removed", "added"), F.col("change")).otherwise("modified")
    return changes.select(kind.alias("change"), "id").distinct()


def summary(changes: DataFrame) -> DataFrame:
    """(change, n): how many entries were removed, added and modified."""
    return changed(changes).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def write_log(changes: DataFrame, path: str) -> None:
    """The change log as text: a line for each kind and entry, in order; part files in the order of their names make one log."""
    rows = changed(changes).select(F.concat_ws(" ", "change", "id").alias("value"))
    rows.orderBy("value").write.text(path)


def identical(changes: DataFrame) -> bool:
    return changes.isEmpty()
