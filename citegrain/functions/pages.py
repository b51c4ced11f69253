"""Page values and ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.text import let

#: What counts as a page of each kind.
_INT = r"(?U)^\s*[+-]?\d+(_\d+)*\s*$"
_PREFIXED = r"^([a-zA-Z]+)(\d+)$"
_CONFERENCE = r"^([A-Z]{2}-[\dA-Z]{2}).(\d+)$"
_DOI = r"^doi\.org/[A-Za-z\d./-]+$"
_ARCHIVE = r"^([a-z]{2,}/)?[\d.]+(v\d+)?$"
_ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
#: Dashes that aren't hyphens, in the order in which they are looked for.
DASHES = ("–", "—", "−", "‐", "‑")
_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(c: Column) -> Column:
    """A Roman numeral's number: a letter less than its follower counts against it."""
    table = F.create_map(*(F.lit(x) for kv in _VALUES.items() for x in kv))
    n = F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(F.element_at(table, x), F.lit(0)))
    return F.aggregate(n, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, x: F.struct((a["sum"] + x - F.when(x > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), x.alias("last")))["sum"]


def page(c: Column) -> Column:
    """Struct (valid, kind, prefix, num) of a single page: empty, int, prefixed, conference, doi, arxiv, roman or invalid."""

    def kinds(c: Column) -> Column:
        mixed = (c != F.lower(c)) & (c != F.upper(c))
        return (
            F.when(c == "", "empty").when(c.rlike(_INT), "int").when(c.rlike(_PREFIXED), "prefixed").when(c.rlike(_CONFERENCE), "conference").when(c.rlike(_DOI), "doi").when(c.rlike(_ARCHIVE), "arxiv")
            .when(F.upper(c).rlike(_ROMAN) & ~mixed, "roman").otherwise("invalid")
        )

    def values(x: Column) -> Column:
        c, kind = x["c"], x["kind"]
        digits = lambda x: x.try_cast("decimal(38,0)")
        num = (
            F.when(kind == "int", digits(F.replace(F.trim(c), F.lit("_"), F.lit("")))).when(kind == "prefixed", digits(F.regexp_extract(c, _PREFIXED, 2)))
            .when(kind == "conference", digits(F.regexp_extract(c, _CONFERENCE, 2))).when(kind == "roman", roman_value(c).cast("decimal(38,0)"))
        )
        prefix = F.when(kind == "prefixed", F.regexp_extract(c, _PREFIXED, 1)).when(kind == "conference", F.regexp_extract(c, _CONFERENCE, 1))
        return F.struct((kind != "invalid").alias("valid"), kind.alias("kind"), prefix.alias("prefix"), num.alias("num"))

    return let(let(c, lambda c: F.struct(c.alias("c"), kinds(c).alias("kind"))), values)


def _result(ok: bool, target: Column) -> Column:
    return F.struct(F.lit(ok).alias("ok"), target.alias("target"))


def _range(x: Column) -> Column:
    """Verdict on two parts that aren't a single page."""
    c, a, b = x["c"], x["a"], x["b"]
    first, second = x["parts"][0], x["parts"][1]
    joined = F.concat(first, F.lit("--"), second)
    digits1, digits2 = a["num"].cast("string"), b["num"].cast("string")
    rising = a["num"] < b["num"]
    completed = F.concat(digits1, F.lit("--"), F.substr(digits1, F.lit(1), F.length(digits1) - F.length(digits2)), digits2)
    return (
        F.when(first == second, _result(False, first))
        .when((a["kind"] == "prefixed") & (b["kind"] == "int"), _result(False, F.concat(a["prefix"], digits1, F.lit("--"), a["prefix"], digits2)))
        .when(~(a["valid"] & b["valid"]) | (a["kind"] != b["kind"]), _result(False, c))
        .when(a["kind"].isin("int", "roman") & rising, _result(True, joined))
        .when((a["kind"] == "int") & (F.length(digits2) < F.length(digits1)), _result(False, completed))
        .when(a["kind"].isin("prefixed", "conference") & (a["prefix"] == b["prefix"]) & rising, _result(True, joined))
        .otherwise(_result(False, joined))
    )


def pages(c: Column) -> Column:
    """Struct (ok, target) of a page or range: what it should read, and whether it is right as to sense."""

    def whole(c: Column) -> Column:
        out = F.when(page(c)["valid"], _result(True, c)).otherwise(let(F.filter(F.transform(F.split(c, "-"), lambda x: F.trim(x)), lambda x: x != ""), lambda parts: split(c, parts)))
        for dash in reversed(DASHES):
            out = F.when(F.contains(c, F.lit(dash)), _result(False, F.replace(c, F.lit(dash), F.lit("-")))).otherwise(out)
        return out

    def split(c: Column, parts: Column) -> Column:
        pair = F.struct(c.alias("c"), parts.alias("parts"), page(F.get(parts, F.lit(0))).alias("a"), page(F.get(parts, F.lit(1))).alias("b"))
        return F.when(F.size(parts) == 2, let(pair, _range)).otherwise(_result(False, F.array_join(parts, "--")))

    return let(F.coalesce(c, F.lit("")), whole)


def correct_pages(c: Column) -> Column:
    """Struct (target, unfixable): unfixable if the target isn't right either."""
    start = F.struct(F.coalesce(c, F.lit("")).alias("reads"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("ok"))

    def step(s: Column, _: Column) -> Column:  # the second time over the target
        return let(pages(s["reads"]), lambda p: F.struct(p["target"].alias("reads"), F.coalesce(s["target"], p["target"]).alias("target"), p["ok"].alias("ok")))

    return let(F.aggregate(F.array(F.lit(1), F.lit(2)), start, step), lambda s: F.struct(s["target"].alias("target"), (~s["ok"]).alias("unfixable")))
