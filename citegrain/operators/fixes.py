"""Findings as fixes, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.words import FIELDS


def pivot(findings: DataFrame) -> DataFrame:
    """(pos, id, fix): a map of each field's target for each entry; of several findings on a field the latest check counts."""
    one = findings.where(F.col("target").isNotNull()).groupBy("pos", "id", "field").agg(F.max_by("target", "check_order").alias("target"))
    return one.groupBy("pos", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "target")))).alias("fix"))


def apply(entries: DataFrame, fixes: DataFrame) -> DataFrame:
    """Entries with their own fixes, whatever other entries share their ID; those with force stay as they are."""
    df = entries.join(fixes.select(F.col("pos").alias("fix_pos"), "fix"), F.col("pos") == F.col("fix_pos"), "left")
    free = F.col("force").isNull()
    cols = [F.when(free, F.coalesce(F.col("fix")[c], F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if c in FIELDS else F.col(f"`{c}`") for c in entries.columns]
    return df.select(*cols)


def unknown_ids(entries: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes of no entry."""
    return fixes.join(entries.select(F.col("ID").alias("id")), "id", "left_anti")


def conflicts(findings: DataFrame) -> DataFrame:
    """(id, check, n): keys that one check corrects to several values, as when entries share a key."""
    each = findings.where(F.col("target").isNotNull()).groupBy("id", "check").agg(F.count_distinct("target").alias("n"))
    return each.where("n > 1")


def prune(entries: DataFrame) -> DataFrame:
    """Entries without fields beyond the kept ones, but for those with force."""
    return entries.withColumn("extra", F.when(F.col("force").isNotNull(), F.col("extra")))
