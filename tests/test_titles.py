"""The title index and the kept catalogue: what they find against all pairs, and what their plans move."""

import math
import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citegrain.operators import titles, verify
from citegrain.operators.catalogue import Catalogue
from citegrain.operators.titles import TitleIndex


def typos(r, title):
    letters = list(title)
    for _ in range(r.randint(1, max(1, len(letters) // 8))):
        i, kind = r.randrange(len(letters)), r.random()
        if kind < 0.35:
            letters[i] = r.choice("abcxyz ")
        elif kind < 0.7:
            letters.insert(i, r.choice("abcxyz"))
        elif len(letters) > 1:
            del letters[i]
    return " ".join("".join(letters).split()) or "x"


@pytest.fixture(scope="module")
def sample():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9))) for _ in range(300)]
    base = [" ".join(words[min(int(r.expovariate(0.02)), 299)] for _ in range(r.randint(1, 10))) for _ in range(700)]
    ours = sorted({typos(r, t) for t in base for _ in range(3)})[:1990] + ["ab", "abc", "a", "abcd", "x" * 300 + "y", "ab " * 120, "unknown zq words"]
    return ours, sorted(set(base) | {typos(r, t) for t in base[:300]} | {"abd", "abcx", "ab", "abcde", "x" * 290, "ba " * 121})


@pytest.fixture(scope="module")
def index(spark, sample):
    return TitleIndex.build(spark.createDataFrame([(x,) for x in [*sample[1], "", None]], "c_title string"))


@pytest.fixture(scope="module")
def asked(spark, sample):
    return spark.createDataFrame([(x,) for x in sample[0]], "title string").cache()


def test_no_near_title_is_lost(index, asked, sample):
    got = {tuple(r) for r in index.near(asked).collect()}
    want = set()
    for a in sample[0]:
        m = SequenceMatcher(None, "", a)
        for b in sample[1]:
            if a != b and 2 * min(len(a), len(b)) >= titles.NEAR * (len(a) + len(b)):
                m.set_seq1(b)
                if m.quick_ratio() >= titles.NEAR and SequenceMatcher(None, a, b).ratio() >= titles.NEAR:
                    want.add((a, b))
    assert len(want) > 1500 and not want - got
    assert len(got) < 1.1 * len(want)


def test_search_is_that_of_all_titles(index, asked, sample):
    ours, theirs = sample
    has = defaultdict(set)
    for b in theirs:
        for w in b.split():
            has[w].add(b)
    weight = lambda w: max(1, math.floor(math.log((len(theirs) + 1) / len(has[w])) * titles.UNIT)) if w in has else math.floor(math.log(len(theirs) + 1) * titles.UNIT)
    total = {b: sum(map(weight, set(b.split()))) for b in theirs}
    want = set()
    for a in ours:
        shared = defaultdict(int)
        for w in set(a.split()):
            for b in has.get(w, ()):
                shared[b] += weight(w)
        own = sum(map(weight, set(a.split())))
        best = sorted(((-2 * s / (own + total[b]), b) for b, s in shared.items()))[:3]
        want |= {(a, b, round(-s, 9)) for s, b in best}
    assert {(r["title"], r["c_title"], round(r["relevance"], 9)) for r in index.search(asked).collect()} == want


def test_index_is_found_again(spark, index, asked):
    again = TitleIndex(spark, index.path)
    assert again.size == index.size and again.order == index.order
    some = asked.where("length(title) < 6")
    assert {tuple(r) for r in again.near(some).collect()} == {tuple(r) for r in index.near(some).collect()}


def test_empty_catalogue(spark, asked):
    empty = TitleIndex.build(spark.createDataFrame([], "c_title string"))
    assert empty.near(asked).count() == 0 and empty.search(asked).count() == 0


def test_no_title_asks(index, asked):
    assert index.search(asked.limit(0)).count() == 0 and index.near(asked.limit(0)).count() == 0


def test_common_words_make_no_pairs(spark):
    names = [f"the study of {''.join(chr(97 + (i * k) % 26) for k in (3, 5, 7, 11, 13, 17, 19, 23))}" for i in range(300)]
    index = TitleIndex.build(spark.createDataFrame([(x,) for x in names], "c_title string"))
    assert index.near(spark.createDataFrame([(x + "s",) for x in names], "title string")).count() < 3 * len(names)


CATALOGUE = "c_pos long, c_doi string, c_title string, c_authors array<string>, c_journal string, c_year string, c_volume string, c_issue string, c_pages string"
ENTRY = "ID string, force string, title string, author string, journal string, year string, volume string, number string, pages string, doi string"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rows = [(i, f"10.1/{i}" if i % 2 else None, f"Work number {'abcdefghij'[i % 10] * 6} and {i}", ["Lee"], "NeuroImage", "2000", "1", None, None) for i in range(60)]
    rows += [(100, "10.1/1", "Another", ["Ray"], None, "1999", None, None, None), (101, None, "Hippocampal theta oscilations", ["Fox"], None, "2001", None, None, None), (102, None, None, None, None, None, None, None, None)]
    return rows, Catalogue.build(spark.createDataFrame(rows, CATALOGUE), str(tmp_path_factory.mktemp("kept") / "c"), 4)


def test_entries_have_one_row_each_whatever_their_ids(spark, kept):
    rows, catalogue = kept
    entries = [
        ("K", None, "x", "B Lee", None, "2000", None, None, None, "10.1/3"),
        ("K", None, "Nothing like it", "B Lee", None, "2000", None, None, None, None),
        (None, None, "Another", "B Ray", None, "1999", None, None, None, None),
        (None, None, "Hippocampal thetas oscillations", "B Fox", None, "2001", None, None, None, "10.9/none"),
        ("S", "True", None, None, None, None, None, None, None, None),
        ("K", None, "Nothing like it", "B Lee", None, "2000", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *e, "clash") for i, e in enumerate(entries)], f"pos long, {ENTRY}, c_title string").repartition(3)
    for cat in (catalogue, spark.createDataFrame(rows, CATALOGUE)):
        got = [(r["pos"], r["id"], r["status"]) for r in verify.verify(df, cat).orderBy("pos").collect()]
        assert got == [(0, "K", "error"), (1, "K", "not_found"), (2, None, "verified"), (3, None, "verified"), (4, "S", "skipped"), (5, "K", "not_found")]
    assert verify.verify(df.limit(0), catalogue).count() == 0


def moved(plan: str) -> list[str]:
    """Exchanges above a scan of a bucketed table without a join between."""
    lines, out = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= depth or "Join" in below or "Aggregate" in below:
                    break
                if "Scan" in below and "Bucketed: true" in below:
                    out.append(below)
    return out


def test_lookups_do_not_move_the_catalogue(spark, kept):
    _, catalogue = kept
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entries = spark.range(50).select(F.concat(F.lit("10.1/"), "id").alias("e_doi"), "id")
        plan = verify.by_doi(entries, catalogue)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and not moved(plan)
        asked = spark.createDataFrame([("work number aaaaaa and 1",)], "title string").repartition(3)
        probes = asked.withColumn("word", F.explode(titles.words(F.col("title"))))
        plan = probes.join(catalogue.titles.table("postings", "word"), "word")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not moved(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_dois_are_not_joined(spark, kept):
    rows = verify.by_doi(spark.createDataFrame([(1, None), (2, "10.1/1"), (3, "10.1/2")], "k long, e_doi string"), kept[1]).collect()
    assert sorted((r["k"], r["c_pos"]) for r in rows if r["c_pos"] is not None) == [(2, 1)] and len(rows) == 3


def test_report_and_the_first_entries(spark, kept):
    from citegrain.plans import bibliography

    rows = [(9 - i, "K", None, None, "B Lee", "NeuroImage", "2000", str(i % 2), None, None, f"10.1/{2 * i + 1}") for i in range(6)]
    entries = spark.createDataFrame([(*r[:3], f"Work number {'abcdefghij'[(2 * k + 1) % 10] * 6} and {2 * k + 1}", *r[4:]) for k, r in enumerate(rows)], f"pos long, {ENTRY}")
    done = bibliography.verification(entries, kept[1])
    assert [r["pos"] for r in bibliography.report(done).collect()] == [5, 7, 9] and [r["pos"] for r in bibliography.report(done, 2).collect()] == [5, 7]
    assert sorted(r["pos"] for r in bibliography.verification(entries, kept[1], most=2).collect()) == [4, 5]


def test_short_titles_within_their_edits_share_a_part():
    """Random letters: bigrams are all alike, so that pairs of them tell nothing apart."""
    r = random.Random(5)
    few = 0
    for _ in range(300):
        kept = "".join(r.choices("0123456789abcdef", k=r.randint(3, titles.SHORT)))
        asked = kept
        for _ in range(r.randint(0, 9)):
            i = r.randint(0, len(asked))
            asked = r.choice((asked[:i] + r.choice("0123456789abcdef") + asked[i:], asked[:i] + asked[i + 1 :], asked[:i] + "x" + asked[i + 1 :]))
        n, m = len(kept), len(asked)
        if m in titles.reach(n, titles.NEAR) and titles.in_parts(n, m, titles.NEAR) and _edits(kept, asked) <= titles.edits(n, m, titles.NEAR):
            assert titles.part_keys(kept, titles.NEAR, False) & titles.part_keys(asked, titles.NEAR, True, {n})
            few += kept != asked
    assert few > 30


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_the_most_common_word_is_looked_up_among_the_lightest_titles_only(spark, monkeypatch):
    r = random.Random(6)
    theirs = [f"{r.randrange(10**6):06} on {r.randrange(10**6):06}" for _ in range(60)]
    index = TitleIndex.build(spark.createDataFrame([(t,) for t in theirs], "c_title string"))
    table = TitleIndex.table
    monkeypatch.setattr(TitleIndex, "table", lambda self, name, key: table(self, name, key).where("word <> 'on'") if name == "postings" else table(self, name, key))
    found = index.search(spark.createDataFrame([(theirs[0],)], "title string")).collect()
    assert {x["c_title"] for x in found} == {theirs[0], *sorted(set(theirs) - {theirs[0]})[:2]}


def test_titles_of_the_same_year_are_not_looked_up_by_letters(spark, monkeypatch):
    asked, plain = [], verify.title_candidates
    monkeypatch.setattr(verify, "title_candidates", lambda t, c, *a: asked.extend(x["title"] for x in t.collect()) or plain(t, c, *a))
    entries = spark.createDataFrame([(i, f"K{i}", None, f"a title of number {i}", "A Lee", None, "2001", None, None, None, None) for i in range(6)], "pos long, ID string, force string, title string, author string, journal string, year string, volume string, number string, pages string, doi string")
    cat = spark.createDataFrame([(i, None, f"a title of number {i}", ["Lee"], None, "2001" if i % 3 else "1999", None, None, None) for i in range(6)], "c_pos long, c_doi string, c_title string, c_authors array<string>, c_journal string, c_year string, c_volume string, c_issue string, c_pages string")
    rows = {x["id"]: x["status"] for x in verify.verify(entries, cat).collect()}
    assert sorted(asked) == ["a title of number 0", "a title of number 3"]
    assert rows["K1"] == "verified" and len(rows) == 6


def test_parts_are_about_as_rare_and_marks_differ_no_more_than_bigrams():
    """A word that all titles have at one place, like " on ", makes no part of its own, by which all would meet."""
    r = random.Random(7)
    rarity = [2.8] * 17 + [0.01] * 4 + [2.8] * 8
    for d in range(4, 12):
        bounds = titles.part_bounds(d, 29, rarity)
        assert bounds[0] == 0 and bounds[-1] == 29 and len(bounds) == d + 2
        assert all(sum(rarity[a:b]) > 2.5 for a, b in zip(bounds, bounds[1:]))
        assert titles.part_bounds(d, 29, [1.0] * 29)[1:] > [0] and all(a < b for a, b in zip(bounds, bounds[1:]))
    for _ in range(200):
        a = "".join(r.choices("abc ", k=r.randint(1, 60)))
        b = "".join(x for x in a if r.random() > 0.1) + "".join(r.choices("abc ", k=r.randint(1, 9)))
        x, y = ({(t[i : i + 2], sum(t[j : j + 2] == t[i : i + 2] for j in range(i))) for i in range(len(t) - 1)} for t in (a, b))
        assert sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(titles.marks(a), titles.marks(b))) <= len(x ^ y)


def test_lookups_send_no_table_to_all_tasks(spark, kept, monkeypatch):
    """Sides that are small as files grow when they are unpacked or exploded: none goes through the driver."""
    from citegrain.operators import catalogue as c

    plans = []
    for module in (titles, verify, c):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, plain=plain: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    rows, _ = kept
    entries = spark.createDataFrame([(i, f"K{i}", None, f"Work number {'abcdefghij'[i % 10] * 6} or {i}", "B Lee", None, "2000", None, None, None, None if i % 2 else f"10.1/{i}") for i in range(8)], f"pos long, {ENTRY}")
    done = verify.verify(entries, spark.createDataFrame(rows, CATALOGUE))
    plans.append(("done", done._jdf.queryExecution().executedPlan().toString()))
    assert {"met", "found", "titled", "open", "equal"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan and name in ("met", "found", "titled", "open", "equal", "known", "weights", "done")] == []
