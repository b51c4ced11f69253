"""Observed counts, checked results, hashed comparison, and fixes of entries that share an ID."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citegrain.functions import text
from citegrain.operators import diff, fixes, measures


def test_counts_come_with_the_pass(spark, tmp_path):
    df, seen = measures.counted(spark.range(100), even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 100, "even": 50, "none": 0}


def test_a_breach_publishes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(measures.Breach, match="negative: 3 rows, at most 0"):
        measures.write_checked(spark.range(-3, 50), out, {"negative": 0}, negative=F.col("id") < 0)
    assert not list(Path(tmp_path).iterdir())
    assert measures.write_checked(spark.range(50), out, {"negative": 0}, negative=F.col("id") < 0) == {"rows": 50, "negative": 0}
    assert spark.read.parquet(out).count() == 50
    with pytest.raises(FileExistsError):
        measures.write_checked(spark.range(5), out, {})
    assert measures.write_checked(spark.range(0), str(tmp_path / "empty"), {"negative": 0}, negative=F.col("id") < 0) == {"rows": 0, "negative": 0}


def test_unchanged_entries_are_not_taken_apart(spark):
    rows = [(f"K{i}", str(i), f"t{i}") for i in range(200)]
    new = [(k, y, "other" if k == "K7" else t) for k, y, t in rows] + [("K9", "9", "t9")]
    schema = "ID string, year string, title string"
    changes = diff.diff(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema), ["year", "title"])
    assert [tuple(r) for r in changes.collect()] == [("K7", "title", "modified", "t7", "other")]
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") and plan.count("Generate explode") == 2 and plan.count("LeftSemi") == 2


def test_fields_that_run_together_differ(spark):
    a, b = (spark.createDataFrame([("A", *x), (None, "1", "2")], "ID string, year string, title string") for x in (("1", "23"), ("12", "3")))
    assert {tuple(r)[:3] for r in diff.diff(a, b, ["year", "title"]).collect()} == {("A", "year", "modified"), ("A", "title", "modified"), (None, None, "removed"), (None, None, "added")}
    a, b = (spark.createDataFrame([("A", *x)], "ID string, year string, title string") for x in ((None, "="), ("", "-")))
    assert {tuple(r)[1:3] for r in diff.diff(a, b, ["year", "title"]).collect()} == {("year", "added_field"), ("title", "modified")}


def test_entries_of_one_id_have_their_own_fixes(spark):
    found = spark.createDataFrame([(1, "A", "pages", 2, "1--2"), (2, "A", "pages", 2, "3--4"), (2, "A", "pages", 3, "3--5"), (3, "A", "pages", 2, None)], "pos long, id string, field string, check_order int, target string")
    entries = spark.createDataFrame([(i, "A", "x", "True" if i == 4 else None) for i in (1, 2, 3, 4)], "pos long, ID string, pages string, force string")
    assert [r["pages"] for r in fixes.apply(entries, fixes.pivot(found)).orderBy("pos").collect()] == ["1--2", "3--5", "x", "x"]


def test_other_scripts_in_latin_letters(spark):
    cases = {"Ёлка": "Iolka", "ΆΝΘΗ ψ": "ANThE ps", "곽 뷁": "gwag bwelg", "ヴァ": "vua", "漢字": "漢字", "Łódź": "Lodz", "ё й": "io i", "": "", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.decode(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in rows} == cases
