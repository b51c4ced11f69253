"""Scalar rules against golden rows."""

import pytest
from pyspark.sql import functions as F

from citegrain.functions import names, pages, similarity
from citegrain.functions import text as t
from citegrain.functions.words import ADDRESSES, Settings

PAGES = [
    ("", True, "", False), ("12", True, "12", False), ("-5", True, "-5", False), ("e2910", True, "e2910", False), ("PS-2B.16", True, "PS-2B.16", False), ("3-10", True, "3--10", False), ("3--10", True, "3--10", False),
    ("3--3", False, "3", False), ("1002 - 15", False, "1002--1015", False), ("10--3", False, "10--13", False), ("20--11", False, "20--11", True), ("e10--20", False, "e10--e20", False), ("e10--f20", False, "e10--f20", True),
    ("iv--ix", True, "iv--ix", False), ("x--v", False, "x--v", True), ("Iv", False, "Iv", True), ("3–10", False, "3-10", False), ("5--", False, "5", False), ("PS-2B.16--PS-2B.18", False, "PS--2B.16--PS--2B.18", True), ("12a", False, "12a", True),
]


def each(spark, rule, values):
    """What a rule of one column makes of each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", rule(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_pages(spark):
    df = spark.createDataFrame([(p[0],) for p in PAGES], "p string").select("p", pages.pages(F.col("p")).alias("a"), pages.correct_pages(F.col("p")).alias("b"))
    assert [(r["p"], r["a"]["ok"], r["a"]["target"], r["b"]["unfixable"]) for r in df.collect()] == PAGES


def test_page_kinds(spark):
    rows = [("doi.org/10.1/x", "doi", None), ("math/0301.1v2", "arxiv", None), ("xiv", "roman", 14), ("MCMXC", "roman", 1990), ("1_000", "int", 1000), ("ab12", "prefixed", 12), ("?", "invalid", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").select(pages.page(F.col("p")).alias("v"))
    assert [(r["v"]["kind"], None if r["v"]["num"] is None else int(r["v"]["num"])) for r in df.collect()] == [r[1:] for r in rows]


@pytest.mark.parametrize(
    "authors,year,key",
    [("Jeremy R Manning", "2021", "Mann21"), ("M J Kahana and J R Manning", "2021", "KahaMann21"), ("A Lee and B Ray and C Fox", "2021", "LeeEtal21"), ("Ludwig {van der Meer}", "2021", "vand21"), ("S Ram\\'{o}n y Cajal", "1905", "yCaj05"), ("M B Smith Jr", "1999", "Smit99"), ("Smith, Jr., John", "1999", "Smit99"), ("{OECD}", "2021", "D21"), ("", "2021", "21")],
)
def test_citation_keys(spark, authors, year, key):
    df = spark.createDataFrame([(authors, year)], "a string, y string")
    assert df.select(names.citation_key(F.col("a"), F.col("y"))).first()[0] == key


def test_authors(spark):
    rows = [("AA Smith", "A A Smith"), ("Smith, A.A.", "A A Smith"), ("van der Meer, L", "L {van der Meer}"), ("H-T Lee", "H-T Lee"), ("John Smith III", "John Smith III"), ("John Smith II", "John Smith I I"), ("Smith, John, PhD", "Smith, John, PhD"), ("KIM LEE", "K I M L E E"), ("A Lee and B-C Ray and Smith, J.K.", "A Lee and B-C Ray and J K Smith"), ("", ""), (None, "")]
    assert each(spark, names.author_text, [r[0] for r in rows]) == [r[1] for r in rows]


def test_titles(spark):
    rows = [("The Role of EEG in Memory.", "The role of {EEG} in memory"), ("{The Whole Title}", "The whole title"), ("What? Another Look", "What? Another look"), ("a study of V1", "a study of {V}1"), ("A fMRI-based Study", "A fmri-based study"), ("The {Big Apple} Test", "The {Big Apple} test"), ("", None), ("a} {b", "a} {b"), ("{a}} b c", None), ("{ab", "{ab"), ("A (EEG) Study... Or Not", "A ({EEG}) study... Or not"), ("Über P-LoS Work", "Über {P-LoS} work")]
    assert each(spark, lambda c: names.title_text(c, Settings()), [r[0] for r in rows]) == [r[1] for r in rows]


def test_venues(spark):
    rows = [("journal OF neuroscience", "Journal of Neuroscience"), ("NeuroImage", "{NeuroImage}"), ("PLoS ONE", "{PLoS} One"), ("science & practice", "Science & Practice"), ("plos-one", "{PLoS}-One"), ("face-to-face", "Face-To-Face"), ("{EEG}", "{EEG}"), ("the {n.m.r.} & on", "The {N.M.R}. & on"), ("", "")]
    assert each(spark, lambda c: names.venue_text(c, {}, Settings().caps), [r[0] for r in rows]) == [r[1] for r in rows]


def test_addresses(spark):
    rows = [("Hanover, NH", "Hanover, {NH}"), ("La Jolla, CA", "{LA} Jolla, {CA}"), ("Rio de Janeiro", "Rio {DE} Janeiro")]
    assert each(spark, lambda c: names.venue_text(c, {}, ADDRESSES), [r[0] for r in rows]) == [r[1] for r in rows]


def test_similarity(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x"), ("{A}", "{B}"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity.ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 0.0, 1.0, 0.0]
    people = spark.createDataFrame([(["Manning", "Kahana"], ["Kahana", "X"]), ([], ["A"])], "a array<string>, b array<string>")
    assert [r[0] for r in people.select(similarity.author_share(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.normalise(F.lit("{EEG} and Memory!"))) == "and memory"
    assert one(t.decode(F.lit("Ørsted Łukasz Straße Ægir é"))) == "Orsted Lukasz Strasse AEgir e"
    assert one(t.remove_accents_and_hyphens(F.lit("Ram\\'{o}n y Jean-Luc {\\l}"))) == "Ramon y JeanLuc l"
    assert one(t.remove_curlies(F.lit("{a {b}} {c"))) == "a b {c"
    assert one(t.remove_curlies(F.lit("{a {b {c {d {e} f}}}} }x"), blanks=False)) == "abcdef }x"
    assert one(t.remove_curlies(F.lit("{" * 9 + "a" + "}" * 9))) == "a"
    assert one(t.doi(F.lit("https://dx.doi.org/10.1/x "))) == "10.1/x"
    assert list(one(t.split_word(F.lit("(a-b).")))) == ["(", "a-b", ")."]
    assert one(t.capitalise(F.lit("ABC def"))) == "Abc def"
    assert one(t.position_of(F.array(*map(F.lit, ["Jan", "Van", "Der", "X"])), "van der")) == 1
    assert one(t.same_key(F.lit("Mann21"), F.lit("Mann21a"))) and not one(t.same_key(F.lit("Mann21"), F.lit("Lee21")))


def test_surnames(spark):
    rows = [("Ludwig van der Meer", "vanderMeer"), ("Xu Van", "Van"), ("VAN Meer", "Meer"), ("Smith, Jr., John", "Smith"), ("III", None), ("a, b, c", None), ("", ""), ("{O\\'Brien}", "OBrien")]
    assert each(spark, lambda c: F.element_at(names.surnames(c), 1), [r[0] for r in rows]) == [r[1] for r in rows]
    assert each(spark, names.nameless, ["A Lee and a, b, c and III", None]) == [["a, b, c", "III"], []]
    assert each(spark, names.last_words, ["A  Lee and  and B Ray ", None]) == [["Lee", "Ray"], []]
    people = spark.createDataFrame([([("A", "Lee"), (None, "Ray"), ("B", None)],)], "p array<struct<given:string,family:string>>")
    assert people.select(names.full_names(F.col("p"))).first()[0] == "A Lee and Ray"


def test_marks_go_back(spark):
    rows = [("{P3a}", "P-3a", "{P3-3a}"), ("{NMR}", "N.M.R", "{N.M.R}"), ("{EEG}", "eeg:", "{EEG}:"), ("{AB}", "AC", None), ("{A}", "", "")]
    df = spark.createDataFrame([r[:2] for r in rows], "x string, y string")
    assert [r[0] for r in df.select(names.with_marks(F.col("x"), F.col("y"))).collect()] == [r[2] for r in rows]


def test_aliases(spark):
    known = {"plos one": "PLoS ONE", "j. neuro": "Journal of Neuroscience"}
    assert each(spark, lambda c: names.venue_text(c, known, Settings().caps), ["PLOS one", "J. Neuro", "x-j. neuro"]) == ["{PLoS} One", "Journal of Neuroscience", "{X}-{J}. Neuro"]
