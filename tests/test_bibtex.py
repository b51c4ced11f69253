"""The BibTeX scan and sink on awkward files, whole and cut into small stretches."""

import random

import pytest
from pyspark.sql import functions as F

from citegrain.sources import bibtex

ODD = """free text } with { braces, me@home.org (x)
@string{jn = "Journal of " # deep}
@string(deep = {Things})
   @article{K1, author = {A B}, title = {A line
@article{no, x = {y}}
 of text}, year = 2001, journal = jn # " and more"}
@comment{ @article{K0, title={no}} }
@article(K2, title = "With ) and {)} @book(x", year=2004)
@misc{K3, note = {n}, month = feb # "~1", journal = unknown}@book{K4, title={T}}
"""


@pytest.fixture(params=[100, 1 << 20])
def stretches(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_awkward_entries(spark, tmp_path, stretches):
    (tmp_path / "a.bib").write_text(ODD)
    rows = bibtex.read_bibtex(spark, str(tmp_path / "a.bib")).orderBy("pos").collect()
    assert [r["ID"] for r in rows] == ["K1", "K2", "K3", "K4"]
    assert rows[0]["title"] == "A line @article{no, x = {y}}  of text" and rows[0]["year"] == "2001" and rows[0]["journal"] == "Journal of Things and more"
    assert rows[1]["year"] == "2004" and rows[1]["title"] == "With ) and {)} @book(x"
    assert rows[2]["journal"] == "unknown" and rows[2]["extra"] == {"note": "n", "month": "February~1"}


def test_stretches_of_any_size_give_the_same_entries(spark, tmp_path, stretches):
    r = random.Random(1)
    for name in "ba":
        text = ""
        for i in range(12):
            long = f"@article{{{name}{i},\n  title = {{{'word {x} ' * r.randint(1, 25)}\n@misc{{q{i}}} }},\n year = {1900 + i}\n}}\njunk }} {{\n"
            text += long if i % 3 else f'@article({name}{i}, title = "a ) {{b}}\n ) c {i}", year={1900 + i})\r\n'
        (tmp_path / f"{name}.bib").write_text(text)
    rows = bibtex.read_bibtex(spark, str(tmp_path)).orderBy("pos").collect()
    assert [x["ID"] for x in rows] == [f"{n}{i}" for n in "ab" for i in range(12)]
    assert [x["year"] for x in rows] == [str(1900 + i) for _ in "ab" for i in range(12)]
    assert rows[1]["title"].endswith("@misc{q1}")


def test_ends_of_stretches_follow_from_their_beginnings():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(['@a{', "{", "}", "}", ")", '"', "@b(", " x ", "\n@c{k, "]) for _ in range(60))
        cuts = sorted(r.sample(range(len(text)), 3))
        state = bibtex.OUTSIDE
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            part = text[a:b]
            if b < len(text) and part.rstrip(" ")[-2:].startswith("@"):
                break  # an entry's first characters are never parted
            at, now = (0, bibtex.OUTSIDE) if state == bibtex.OUTSIDE else bibtex.close(part, state)
            want = bibtex.entries_of(part, at)[1] if now == bibtex.OUTSIDE else now
            ends = bibtex.endings(part)
            assert ends.get(state, ((state[0], state[1] + part.count("{") - part.count("}")), True))[0] == want
            state = want


def test_last_definition_counts_and_cycles_end(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@string{a = b # "1"}\n@string{b = a}\n@string{c = "x"}\n@misc{K, title = c # a}\n@string{c = "y"}\n')
    (tmp_path / "b.bib").write_text("@misc{L, title = c}\n@misc{E, }\n")
    rows = {r["ID"]: r["title"] for r in bibtex.read_bibtex(spark, str(tmp_path)).collect()}
    assert rows["K"].startswith("y") and rows["L"] == "c" and rows["E"] is None


def test_no_entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text("nothing here\n\n")
    assert bibtex.read_bibtex(spark, str(tmp_path)).count() == 0


def test_sink_publishes_all_or_nothing(spark, tmp_path):
    (tmp_path / "a.bib").write_text("".join(f"@misc{{K{i:03}, title = {{t{i}}}}}\n" for i in range(200)))
    entries = bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))
    out = str(tmp_path / "out")
    broken = entries.withColumn("title", F.when(F.col("ID") == "K150", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        bibtex.write_bibtex(broken, out)
    assert [p.name for p in tmp_path.iterdir()] == ["a.bib"]
    bibtex.write_bibtex(entries.repartition(7), out)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.count("@misc") == 200 and text.index("K000") < text.index("K100") < text.index("K199")
    with pytest.raises(FileExistsError):
        bibtex.write_bibtex(entries, out)
