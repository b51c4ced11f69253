"""Similarity of strings and author lists. What equality or the shared characters decide is decided natively; the rest goes to a
small helper, once for each distinct pair where the caller pairs distinct titles."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citegrain.functions.text import let, normalise, text

#: Fixed value: surnames of a greater ratio are one person's.
SAME_NAME = 0.85


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def bound(a: Column, b: Column) -> Column:
    """What ratio(a, b) can't exceed, by the characters that both strings have; 1 for two empty strings."""
    letters = lambda c: F.filter(F.split(c, ""), lambda z: z != "")

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, c: n + F.least(F.size(F.filter(x, lambda z: z == c)), F.size(F.filter(y, lambda z: z == c))))
        total = F.size(x) + F.size(y)
        return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)

    return let(F.struct(letters(a).alias("x"), letters(b).alias("y")), of)


def length_bound(a: Column, b: Column) -> Column:
    """As bound(), by the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def normal_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two strings that are normalised already."""
    unlike = a != b
    return F.when(unlike, _ratio(F.when(unlike, a), F.when(unlike, b))).otherwise(1.0)


def ratio(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two normalised strings; 0 if either is empty as written."""
    return F.when((text(a) == "") | (text(b) == ""), 0.0).otherwise(normal_ratio(normalise(a), normalise(b)))


def _alike(p: str, q: str) -> bool:
    return p == q or (2 * min(len(p), len(q)) > SAME_NAME * (len(p) + len(q)) and SequenceMatcher(None, p, q).ratio() > SAME_NAME)


@F.pandas_udf(DoubleType())
def _share(a: pd.Series, b: pd.Series) -> pd.Series:
    def share(x, y) -> float | None:
        return None if x is None else sum(p is not None and any(q is not None and _alike(p, q) for q in y) for p in x) / max(len(x), len(y))

    return pd.Series([share(x, y) for x, y in zip(a, b)], dtype=float)


def normal_names(names: Column) -> Column:
    """Surnames as they are compared; empty and null ones are null."""
    return F.transform(names, lambda n: F.when(text(n) != "", normalise(n)))


def author_share(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Share of the surnames `a` that have a match of over 0.85 among `b`, of the longer list; 0 if either list is null or empty.
    Names that normalise to nothing match each other; an empty or null name matches none. Equal lists need no helper.
    `x`, `y`: their normal_names(), if at hand."""
    x, y = normal_names(a) if x is None else x, normal_names(b) if y is None else y
    both = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    same = (x == y) & ~F.array_contains(F.transform(a, text), F.lit(""))
    return F.when(~both, 0.0).when(same, 1.0).otherwise(_share(F.when(both & ~same, x), F.when(both & ~same, y)))
