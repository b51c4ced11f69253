"""Counts of rows taken in the pass that does the work, and results that are published only if their counts are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citegrain.sources.tables import publish


class Breach(Exception):
    """Counts that are out of order; nothing was published."""


def counted(df: DataFrame, **rows: Column) -> tuple[DataFrame, Observation]:
    """`df`, and counts that are known once it has been written or read to its end: `rows` in all, and those for which each condition holds."""
    seen = Observation()
    each = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in rows.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *each), seen


def write_checked(df: DataFrame, path: str, most: dict[str, int], **rows: Column) -> dict[str, int]:
    """Writes `df` as Parquet and returns its counts, taken as it is written. If a count is over its limit in `most` (0 asserts that no such row exists), Breach is
    raised and `path` doesn't appear."""
    df, seen = counted(df, **rows)
    counts: dict[str, int] = {}

    def check() -> None:
        counts.update({k: v or 0 for k, v in seen.get.items()})
        over = {k: counts[k] for k, limit in most.items() if counts[k] > limit}
        if over:
            raise Breach(", ".join(f"{k}: {n} rows, at most {most[k]}" for k, n in over.items()))

    publish(df.sparkSession, path, lambda draft: df.write.parquet(draft), check)
    return counts
