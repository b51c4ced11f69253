"""Findings: where a field differs from what it should read. (pos, id, check, check_order, field, actual, target, severity); pos tells entries of one ID apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions import names, pages
from citegrain.functions.text import same_key, text
from citegrain.functions.words import Settings
from citegrain.operators import keys
from citegrain.sources.tables import spread


def finding(check: str, order: int, field: str, actual: Column, target: Column, differs: Column | None = None, severity: str = "fix", force: bool = True) -> Column:
    """A struct where the value differs from the target (by `differs`, else plainly; a missing target never differs), else null.
    Entries with force are exempt unless `force` is false."""
    differs = (text(actual) != target) if differs is None else differs
    differs = differs & F.col("force").isNull() if force else differs
    return F.when(differs, F.struct(F.lit(check).alias("check"), F.lit(order).alias("check_order"), F.lit(field).alias("field"), text(actual).alias("actual"), target.alias("target"), F.lit(severity).alias("severity")))


def mismatches(df: DataFrame, *checks: Column) -> DataFrame:
    """A row for each finding of each entry, in one pass over the entries."""
    return df.select("pos", F.col("ID").alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("f")).select("pos", "id", "f.*")


_VENUES = ("journal", "booktitle", "publisher", "address")


def once(df: DataFrame, source: DataFrame, field: str, **rules: Callable[[Column], Column]) -> DataFrame:
    """`df` with a column for each rule of a field, worked out once for each distinct value that `source` has, over all cores. A missing value reads as empty."""
    value = F.col("_of")
    each = spread(source.select(text(F.col(field)).alias("_of")).distinct()).select("_of", *(rule(value).alias(name) for name, rule in rules.items()))
    return df.join(each, text(F.col(field)) == value, "left").drop("_of")


def targets(entries: DataFrame, settings: Settings) -> DataFrame:
    """`entries` with what each checked field but the key should read."""
    s = settings
    lists = dict(zip(_VENUES, ((s.journals, s.caps), (s.journals, s.caps), (s.publishers, s.caps), (s.places, s.addresses))))
    df = once(spread(entries), entries, "pages", t_pages=pages.correct_pages)
    df = once(df, entries, "title", t_title=lambda c: names.title_text(c, settings))
    df = once(df, entries, "author", t_author=names.author_text, bad_author=lambda c: F.array_join(names.nameless(c), " and "))
    df = once(df, entries, "editor", t_editor=names.author_text)
    for field, known in lists.items():
        df = once(df, entries, field, **{f"t_{field}": lambda c, known=known: names.venue_text(c, *known)})
    return df


def key_targets(entries: DataFrame) -> DataFrame:
    """(pos, ID, force, base, target): the key that each entry's authors and year make, and that key with the right suffix."""
    parted = once(spread(entries.select("pos", "ID", "force", "author", "year")), entries, "author", parts=names.key_parts)
    return keys.repair(parted.select("pos", "ID", "force", names.joined_key(F.col("parts"), F.col("year")).alias("base")))


def findings(entries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All checks of the lint pass over entries (pos, ID, fields, force). Null IDs are never right.

    Names without a surname (of no or too many parts) and titles without a sentence form are fatal, as are pages that can't be put right.
    """
    none = F.lit(None).cast("string")
    found = [
        finding("pages", 2, "pages", F.col("pages"), F.col("t_pages.target")),
        finding("pages_unfixable", 3, "pages", F.col("pages"), F.col("t_pages.target"), F.col("t_pages.unfixable"), "fatal", force=False),
        finding("empty_title", 4, "title", F.col("title"), none, F.col("t_title").isNull(), "fatal"),
        finding("name", 12, "author", F.col("author"), none, (text(F.col("author")) != "") & (F.col("bad_author") != ""), "fatal"),
    ]
    found += [finding(f, 5 + i, f, F.col(f), F.col(f"t_{f}")) for i, f in enumerate(("journal", "booktitle", "title", "publisher", "author", "editor", "address"))]
    base = finding("key", 0, "ID", F.col("ID"), F.col("base"), ~same_key(text(F.col("ID")), F.col("base")))
    return mismatches(targets(entries, settings or Settings()), *found).unionByName(mismatches(key_targets(entries), base, finding("suffix", 1, "ID", F.col("ID"), F.col("target"))))


def fatal(entries: DataFrame) -> DataFrame:
    """Findings of what ends a lint pass wherever it stands, force or not: keys that occur more than once (no one entry's: pos is null), and entries
    that share title and surnames."""
    what = lambda check, order, field, actual: [F.lit(check).alias("check"), F.lit(order).alias("check_order"), F.lit(field).alias("field"), actual.alias("actual"), F.lit(None).cast("string").alias("target"), F.lit("fatal").alias("severity")]
    same_keys = keys.duplicate_keys(entries).select(F.lit(None).cast("long").alias("pos"), F.col("ID").alias("id"), *what("duplicate_key", 13, "ID", F.col("ID")))
    same_entries = keys.duplicate_entries(entries).select("pos", F.col("ID").alias("id"), *what("duplicate_entry", 14, "title", F.col("title")))
    return same_keys.unionByName(same_entries)


def extra_fields(entries: DataFrame) -> DataFrame:
    """(id, removed): fields beyond the kept ones, of entries without force."""
    return entries.where(F.col("force").isNull() & (F.size("extra") > 0)).select(F.col("ID").alias("id"), F.sort_array(F.map_keys("extra")).alias("removed"))


def distinct_values(entries: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): the distinct values of each field, and how often they occur."""
    long = entries.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields))).alias("x")).select("x.*")
    return long.where("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
