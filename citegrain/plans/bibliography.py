"""The commands: lint (with fixes), verification, comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.functions.words import FIELDS, Settings
from citegrain.operators import diff, fixes, keys, lint, verify
from citegrain.operators.catalogue import Catalogue


@dataclass
class Lint:
    findings: DataFrame
    fixes: DataFrame
    duplicate_keys: DataFrame
    duplicate_entries: DataFrame
    extra_fields: DataFrame
    polished: DataFrame


def check(entries: DataFrame, settings: Settings | None = None, autofix: bool = False) -> Lint:
    """The lint pass: nothing runs until a result is asked for."""
    found = lint.findings(entries, settings)
    pivoted = fixes.pivot(found)
    kept = fixes.prune(entries)
    return Lint(found.unionByName(lint.fatal(entries)), pivoted, keys.duplicate_keys(entries), keys.duplicate_entries(entries), lint.extra_fields(entries), fixes.apply(kept, pivoted) if autofix else kept)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of two versions in the kept fields."""
    return diff.diff(old, new, [f for f in FIELDS if f != "ID"])


def verification(entries: DataFrame, catalogue: DataFrame | Catalogue, most: int | None = None) -> DataFrame:
    """Verification of all entries, or of the first `most` in file order."""
    return verify.verify(entries if most is None else entries.orderBy("pos").limit(most), catalogue)


def report(verification: DataFrame, n: int = 10) -> DataFrame:
    """The first n entries (in file order) with discrepancies."""
    return verification.where(F.size("discrepancies") > 0).orderBy("pos").limit(n)
