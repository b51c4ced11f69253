"""Operators, sources and commands on small tables."""

import pytest
from pyspark.sql import functions as F

from citegrain.functions import names as names_of
from citegrain.functions import pages as pages_of
from citegrain.functions.words import Settings
from citegrain.operators import diff, fixes, keys, lint, verify
from citegrain.plans import bibliography
from citegrain.sources import bibtex
from citegrain.streaming import incoming

BIB = """
@article{Mann21, author = {Jeremy R Manning}, title = "The Role of {EEG} in Memory.",
  year = 2021, month = jan, pages = {1002 - 15}, journal = {NeuroImage}, keywords = {x # y}}
@comment{not an entry}
@inproceedings{LeeEtal20, authors = {A Lee and B Ray and C Fox}, title = {A plain title}, year = {2020}, pages={3--10}, force = {True}, note={kept}
}
@article{Mann21, author = {Jeremy R Manning}, title = {Second}, year = {2021}}
"""


@pytest.fixture
def entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    return bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))


def test_bibtex_scan_and_sink(spark, entries, tmp_path):
    rows = entries.orderBy("pos").collect()
    assert [r["ID"] for r in rows] == ["Mann21", "LeeEtal20", "Mann21"]
    assert rows[0]["title"] == "The Role of {EEG} in Memory." and rows[0]["extra"] == {"month": "January", "keyword": "x # y"}
    assert rows[1]["author"].startswith("A Lee") and rows[1]["extra"] == {"note": "kept"}
    assert [r["title"] for r in bibtex.last_wins(entries).orderBy("pos").collect()] == ["A plain title", "Second"]
    bibtex.write_bibtex(entries, str(tmp_path / "out"))
    again = bibtex.read_bibtex(spark, str(tmp_path / "out"))
    assert [r["title"] for r in again.orderBy("pos").collect()] == [r["title"] for r in rows]


def test_lint_and_fixes(entries):
    done = bibliography.check(bibtex.last_wins(entries.where("title <> 'Second'")), autofix=True)
    found = {(r["id"], r["field"], r["target"]) for r in done.findings.collect()}
    assert ("Mann21", "pages", "1002--1015") in found and ("Mann21", "journal", "{NeuroImage}") in found and ("Mann21", "title", "The role of {EEG} in memory") in found
    assert not [f for f in found if f[0] == "LeeEtal20"]  # force
    polished = {r["ID"]: r for r in done.polished.collect()}
    assert polished["Mann21"]["pages"] == "1002--1015" and polished["Mann21"]["extra"] is None and polished["LeeEtal20"]["extra"] == {"note": "kept"}
    assert [(r["id"], r["removed"]) for r in done.extra_fields.collect()] == [("Mann21", ["keyword", "month"])]
    assert bibliography.check(entries).duplicate_keys.collect()[0]["n"] == 2
    assert fixes.unknown_ids(entries, done.fixes).isEmpty()


def test_suffix_repair(spark):
    rows = [(1, "MannEtal21", "MannEtal21"), (2, "Ray20a", "Ray20"), (3, "Lee19", "Lee19"), (4, "Lee19a", "Lee19"), (5, "Fox18a", "Fox18"), (6, "Fox18c", "Fox18"), (7, "Foo18", "Fox18")]
    got = keys.repair(spark.createDataFrame(rows, "pos long, ID string, base string")).orderBy("pos").collect()
    assert [r["target"] for r in got] == ["MannEtal21", "Ray20", "Lee19b", "Lee19a", "Fox18a", "Fox18c", "Fox18b"]
    n = spark.range(1).select(*(keys.suffix(F.lit(i)) for i in (0, 25, 26, 701, 702))).first()
    assert list(n) == ["a", "z", "aa", "zz", "aaa"]
    long = 26**9 + 12345
    x, k = "", long
    while k >= 0:
        x, k = chr(97 + k % 26) + x, k // 26 - 1
    assert spark.range(1).select(keys.suffix(F.lit(long))).first()[0] == x


def plain_repair(rows):
    def name(n):
        x = ""
        while n >= 0:
            x, n = chr(97 + n % 26) + x, n // 26 - 1
        return x

    out, groups = {}, {}
    for r in sorted(rows):
        groups.setdefault(r[2], []).append(r)
    for base, group in groups.items():
        legal = [] if base is None else [base + name(i) for i in range(len(group))]
        free = iter([x for x in legal if x not in {r[1] for r in group}])
        for pos, key, _ in group:
            out[pos] = base if base is None or len(group) == 1 else key if key in legal else next(free)
    return out


@pytest.mark.parametrize("hot", [100_000, 40])
def test_repair_is_that_of_each_group_alone(spark, monkeypatch, hot):
    import random

    from citegrain.operators import ranks

    monkeypatch.setattr(keys, "HOT", hot)
    monkeypatch.setattr(ranks, "RANGE", 3)
    r = random.Random(2)
    rows = []
    for i in range(600):
        base = r.choice(["Lee20", "Lee2", "Ray19", None, *(f"B{j}" for j in range(150))]) if i % 3 else "Lee20"
        ending = r.choice([*"abcdefg", "", "A", "z" * 15, "1", "aa", "cx", "kk"])
        rows.append((i * 7 % 601, (base or "None") + ending, base))
    df = spark.createDataFrame([(*x, "kept") for x in rows], "pos long, ID string, base string, n string")
    assert {x["pos"]: x["target"] for x in keys.repair(df).collect()} == plain_repair(rows)


def test_suffix_numbers_are_the_inverse(spark):
    df = spark.range(0, 20000, 7).select("id", keys.suffix_number(keys.suffix(F.col("id"))).alias("n"))
    assert df.where("NOT id <=> n").isEmpty()
    assert [x[0] for x in spark.createDataFrame([("A",), ("",), ("a1",), ("a" * 13,)], "s string").select(keys.suffix_number(F.col("s"))).collect()] == [None] * 4


def test_ranks_of_a_large_group_are_those_of_the_whole(spark, monkeypatch):
    from citegrain.operators import ranks

    monkeypatch.setattr(ranks, "RANGE", 2)
    rows = [("g" if i % 5 else None, i * 3 % 101) for i in range(90)] + [("g", None)]
    got = ranks.ranked(spark.createDataFrame(rows, "base string, pos long"), ["base"], "pos", "rank").collect()
    for group in ("g", None):
        want = sorted((p for b, p in rows if b == group), key=lambda p: (p is not None, p))
        assert [r["pos"] for r in sorted((r for r in got if r["base"] == group), key=lambda r: r["rank"])] == want


def test_fatal_findings(spark, entries):
    found = {(r["id"], r["check"]) for r in bibliography.check(entries).findings.where("severity = 'fatal'").collect()}
    assert ("Mann21", "duplicate_key") in found
    fields = "pos long, ID string, title string, author string, year string, force string"
    rows = [(1, "A", "t", "B Lee", "2000", None), (2, "B", "t", "C Lee", "2000", "x"), (3, "C", None, "a, b, c", "2000", None), (4, None, "u", None, None, None)]
    df = spark.createDataFrame(rows, fields).selectExpr("*", *(f"CAST(NULL AS STRING) AS {c}" for c in ("pages", "journal", "booktitle", "publisher", "editor", "address")))
    assert {(r["id"], r["check"]) for r in lint.fatal(df).collect()} == {("A", "duplicate_entry"), ("B", "duplicate_entry")}
    found = {(r["id"], r["check"]) for r in lint.findings(df).where("severity = 'fatal'").collect()}
    assert found == {("C", "name"), ("C", "empty_title")}
    twice = spark.createDataFrame([("A", "suffix", "Lee00a"), ("A", "suffix", "Lee00b"), ("B", "suffix", "x")], "id string, check string, target string")
    assert [tuple(r) for r in fixes.conflicts(twice).collect()] == [("A", "suffix", 2)]


def test_settings_are_read_from_files(spark, tmp_path):
    (tmp_path / "caps.txt").write_text("MRI\n\nfMRI\n")
    (tmp_path / "journals.csv").write_text("orig,corrected\nj neuro,Journal of Neuroscience\nJ NEURO,x\nempty,\n")
    s = bibtex.load_settings(spark, caps=str(tmp_path / "caps.txt"), journals=str(tmp_path / "journals.csv"))
    assert s.caps == ("MRI", "fMRI") and s.journals["j neuro"] in ("x", "Journal of Neuroscience") and "AL" in s.addresses and s.publishers == {}


def test_bounds_never_fall_below_the_ratio(spark):
    import random

    from citegrain.functions import similarity

    r = random.Random(1)
    rows = [("".join(r.choice("abc ") for _ in range(r.randint(0, 9))), "".join(r.choice("abc ") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select(similarity.normal_ratio(F.col("a"), F.col("b")).alias("r"), similarity.bound(F.col("a"), F.col("b")).alias("c"), similarity.length_bound(F.col("a"), F.col("b")).alias("l"))
    assert all(x["r"] <= x["c"] + 1e-12 and x["c"] <= x["l"] + 1e-12 for x in df.collect())


def test_best_title_prefers_year_then_author_then_place(spark):
    cat = spark.createDataFrame([(i, None, x, [a], None, y, None, None, None) for i, (x, a, y) in enumerate([("Editorial", "Lee", "1999"), ("Editorial", "Ray", "2000"), ("Editorial", "Fox", "2000"), ("Editorial", "Fox", "2000"), ("Editorial", "Kim", None), ("Editorials", "Lee", "2001")])], "c_pos long, c_doi string, c_title string, c_authors array<string>, c_journal string, c_year string, c_volume string, c_issue string, c_pages string")
    rows = [("a", "Editorial", "B Fox", "2000"), ("b", "Editorial", "B Moe", "2000"), ("c", "editorial", "B Kim", "1950"), ("d", "Editorial", "B Lee", None), ("e", "Editoria", "B Lee", "2001"), ("f", "Other", "B Lee", "2001"), ("a", "Editorial", "B Fox", "2000")]
    e = spark.createDataFrame(rows, "ID string, title string, author string, year string")
    assert sorted((r["ID"], r["c_pos"]) for r in verify.by_title(e, cat).collect()) == [("a", 2), ("a", 2), ("b", 1), ("c", 4), ("d", 0), ("e", 4)]


def test_diff(spark, tmp_path):
    a = spark.createDataFrame([("A", "1", "x"), ("B", "2", None), ("C", "3", "z")], "ID string, year string, title string")
    b = spark.createDataFrame([("A", "1", "y"), ("B", None, "t"), ("D", "4", "w")], "ID string, year string, title string")
    got = {tuple(r) for r in diff.diff(a, b, ["year", "title"]).collect()}
    assert got == {("A", "title", "modified", "x", "y"), ("B", "year", "deleted_field", "2", None), ("B", "title", "added_field", None, "t"), ("C", None, "removed", None, None), ("D", None, "added", None, None)}
    changes = diff.diff(a, b, ["year", "title"])
    assert {tuple(r) for r in diff.changed(changes).collect()} == {("modified", "A"), ("modified", "B"), ("removed", "C"), ("added", "D")}
    assert {tuple(r) for r in diff.summary(changes).collect()} == {("modified", 2), ("removed", 1), ("added", 1)}
    diff.write_log(changes, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["added D", "modified A", "modified B", "removed C"]
    assert diff.identical(diff.diff(a, a, ["year", "title"]))


def test_verification(spark):
    fields = "ID string, force string, title string, author string, journal string, year string, volume string, number string, pages string, doi string"
    e = spark.createDataFrame(
        [
            ("ok", None, "Memory and the brain in motion", "J Manning", "NeuroImage", "2020", "1", None, "12-34", "https://doi.org/10.1/a"),
            ("warn", None, "Memory and the brain in motion", "J Manning", None, "2021", "9", None, "5-9", None),
            ("far", None, "Memory and the brain in motion", "J Manning", None, "1990", None, None, None, "10.1/a"),
            ("lost", None, "Nothing like it anywhere", "A Lee", None, "2020", None, None, None, None),
            ("skip", "True", "x", None, None, None, None, None, None, None),
            ("odd", None, "Memory and the brain in motion", "J Manning", None, "in press", None, None, None, "10.1/a"),
        ],
        fields,
    )
    nested = spark.createDataFrame(
        [(1, "10.1/a", ["Memory and the Brain in Motion"], [("J", "Manning")], ["Neuroimage"], ([[2020]],), "1", None, (None,), "1234")],
        "cand_pos long, DOI string, title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, published struct<`date-parts`:array<array<int>>>, volume string, issue string, `journal-issue` struct<issue:string>, page string",
    )
    got = {r["id"]: r for r in verify.verify(e, verify.flat_catalogue(nested)).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"ok": "verified", "warn": "warning", "far": "error", "lost": "not_found", "skip": "skipped", "odd": "exception"}
    assert got["warn"]["corrections"] == {"volume": "1"} and len(got["warn"]["discrepancies"]) == 3
    assert got["far"]["reason"].startswith("Years differ")
    counts = {r["status"]: r["n"] for r in verify.status_counts(verify.verify(e, verify.flat_catalogue(nested))).collect()}
    assert counts["verified"] == 1


def test_profile(spark):
    df = spark.createDataFrame([("a", "2"), ("b", None), ("a", "1")], "x string, y string")
    assert {tuple(r) for r in lint.distinct_values(df, ["x", "y"]).collect()} == {("x", "a", 2), ("x", "b", 1), ("y", "1", 1), ("y", "2", 1)}


def test_incoming_stream(spark, tmp_path):
    spark.createDataFrame([("A", "https://doi.org/10.1/a", "t", "x")], "ID string, doi string, title string, author string").write.json(str(tmp_path / "in"))
    cat = spark.createDataFrame([("10.1/a", "T")], "c_doi string, c_title string")
    stream = spark.readStream.schema("ID string, doi string, title string, author string").json(str(tmp_path / "in"))
    q = incoming.match_by_doi(stream, cat).writeStream.format("memory").queryName("matched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r["ID"], r["c_title"]) for r in spark.sql("SELECT * FROM matched").collect()] == [("A", "T")]


def test_queries_match_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from citegrain.plans import queries

    part = [(i, f"small ring {i % 9}", "Brand#2", "ECONOMY", i % 50, 900.0) for i in range(120)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sql = queries.oracle_sql()
    assert set(sql) <= set(entry.queries())
    for name in sql:
        got, want = queries.queries()[name](spark, str(tmp_path)), con.sql(sql[name])
        rows = lambda data, cols: sorted(tuple(str(x) for x in r) for r in ([tuple(v[cols.index(c)] for c in sorted(cols)) for v in data]))
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns), name


def test_lint_targets_are_worked_out_once_for_each_value_and_rows_spread(spark):
    """A small file is one task's, whatever its rows cost: each checked value is worked out once, and both values and rows go over all cores."""
    names = ("pos", "ID", "force", "author", "editor", "year", "title", "pages", "journal", "booktitle", "publisher", "address")
    rows = [(i, f"K{i}", None, ("M J Kahana", None)[i % 2], None, "2001", ("The EEG", "A study", None)[i % 3], ("1-9", None)[i % 2], "plos-one", None, "MIT press", None) for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, " + ", ".join(f"{n} string" for n in names[1:])).coalesce(1)
    found = lint.targets(df, Settings())
    got = {r["pos"]: (r["t_title"], r["t_author"], r["t_pages"]["target"], r["t_journal"], r["t_booktitle"]) for r in found.collect()}
    plain = df.select("pos", names_of.title_text(F.col("title"), Settings()), names_of.author_text(F.col("author")), pages_of.correct_pages(F.col("pages"))["target"], names_of.venue_text(F.col("journal"), Settings().journals, Settings().caps), names_of.venue_text(F.col("booktitle"), Settings().journals, Settings().caps))
    assert got == {r[0]: tuple(r)[1:] for r in plain.collect()} and len(got) == 60
    assert found._jdf.queryExecution().analyzed().toString().count("Repartition 8, true") == 9  # the rows, and the values of eight fields
    keyed = lint.key_targets(df).collect()
    assert {r["base"] for r in keyed} == {r[0] for r in df.select(names_of.citation_key(F.col("author"), F.col("year"))).collect()} and len(keyed) == 60
