"""Verification of entries against a catalogue table: exact and fuzzy joins, confidence gates, discrepancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.names import last_words
from citegrain.functions.similarity import author_share, bound, length_bound, normal_names, normal_ratio
from citegrain.functions.text import doi, normalise, text
from citegrain.operators.catalogue import Catalogue, year_and_author
from citegrain.sources.tables import spread, stored, unsent

#: Least similarities of titles, authors and journals, most difference of years, and the penalty for another year.
TITLE, AUTHORS, JOURNAL, YEARS, PENALTY, ACCEPT = 0.85, 0.70, 0.60, 1, 0.7, 0.70
#: Titles of the catalogue that are looked at for the words they share, besides those that are near by their letters.
SEARCHED = 3


def flat_catalogue(records: DataFrame) -> DataFrame:
    """Catalogue columns (c_pos, c_doi, c_title, c_authors, c_journal, c_year, c_volume, c_issue, c_pages) of nested records."""
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return records.select(
        F.col("cand_pos").alias("c_pos"), doi(F.col("DOI")).alias("c_doi"), first("title").alias("c_title"), F.transform("author", lambda a: F.coalesce(a["family"], F.lit(""))).alias("c_authors"), first("`container-title`").alias("c_journal"),
        F.col("published.date-parts")[0][0].cast("string").alias("c_year"), F.col("volume").alias("c_volume"), F.coalesce(F.nullif(F.col("issue"), F.lit("")), F.col("`journal-issue`.issue")).alias("c_issue"), F.col("page").alias("c_pages"),
    )


def by_doi(entries: DataFrame, catalogue: DataFrame | Catalogue) -> DataFrame:
    """Entries (with e_doi) and the first catalogue row of their DOI, if any. Entries without a DOI aren't joined."""
    first = Catalogue.of(catalogue).by_doi
    asked = entries.where("e_doi IS NOT NULL").join(first, F.col("e_doi") == F.col("c_doi"), "left")
    return asked.unionByName(entries.where("e_doi IS NULL"), allowMissingColumns=True)


def title_candidates(titles: DataFrame, catalogue: DataFrame | Catalogue, most: int = SEARCHED) -> DataFrame:
    """(title, c_title) of distinct normalised titles (`title`) and those of the catalogue: all that are near by their letters, and the `most` that share
    most by their words. Equal ones are left out."""
    index = Catalogue.of(catalogue).titles
    return index.near(titles).unionByName(index.search(titles, most).where("title <> c_title").select("title", "c_title")).distinct()


def scored_titles(pairs: DataFrame) -> DataFrame:
    """(title, c_title, sim) of the pairs with a ratio of ACCEPT or more: no other can be accepted. Pairs that the bounds rule out
    aren't compared."""
    a, b = F.col("title"), F.col("c_title")
    possible = pairs.where(length_bound(a, b) >= ACCEPT).where((a == b) | (bound(a, b) >= ACCEPT))
    return possible.select("title", "c_title", normal_ratio(a, b).alias("sim")).where(F.col("sim") >= ACCEPT)


def by_title(entries: DataFrame, catalogue: DataFrame | Catalogue) -> DataFrame:
    """Entries and their best catalogue row by title, if one is good enough: another year costs; of equals, a row with the first author's
    name goes first, then the first row.

    Entries of one title, year and first author have one answer, and catalogue rows of one title, year and first author are told
    apart by place only, so no group of equal titles is ever paired off.
    """
    kept = Catalogue.of(catalogue)
    ours = stored(entries.where(text(F.col("title")) != "").withColumns({"n_title": normalise(F.col("title")), "n_year": text(F.col("year")), "n_first": F.coalesce(normalise(F.get(last_words(F.col("author")), F.lit(0))), F.lit(""))}), "ours")
    node = ["n_title", "n_year", "n_first"]
    nodes = stored(ours.select(*node).distinct(), "nodes")
    equal = stored(_best(nodes, nodes.select(F.col("n_title").alias("title")).distinct().select("title", F.col("title").alias("c_title"), F.lit(1.0).alias("sim")), kept), "equal")
    # no other title is as good as an equal one of the same year: only the rest are looked up by letters and words
    open_ = stored(nodes.join(unsent(equal.where("b.score = 1.0")), node, "left_anti"), "open")
    near = _best(open_, scored_titles(title_candidates(open_.select(F.col("n_title").alias("title")).distinct(), kept)), kept)
    best = equal.unionByName(near).groupBy(*node).agg((-F.max("b")["minus"]).alias("b_pos"))
    found = ours.join(unsent(best), node).drop(*node)
    return found.join(kept.rows, F.col("b_pos") == F.col("c_pos")).drop("b_pos")


def _best(nodes: DataFrame, pairs: DataFrame, kept: Catalogue) -> DataFrame:
    """Nodes (title, year, first author) and the best that they find among their titles' pairs: b, a struct (score, own, minus the place)."""
    node = ["n_title", "n_year", "n_first"]
    any_ = F.lit(None).cast("string")
    free = F.when(F.col("n_year") == "", 1.0).otherwise(PENALTY)
    years = [(F.col("n_year"), F.lit(1.0)), (F.lit(""), F.lit(1.0)), (any_, free)]
    wanted = F.explode(F.array(*(F.struct(year_and_author(F.col("c_title"), y, f).alias("key"), cost.alias("cost"), F.lit(own).alias("own")) for y, cost in years for f, own in ((F.col("n_first"), 1), (any_, 0))))).alias("g")
    asked = nodes.join(unsent(pairs), F.col("n_title") == F.col("title")).select(*node, "sim", wanted).select(*node, (F.col("sim") * F.col("g.cost")).alias("score"), "g.own", F.col("g.key").alias("asked")).where(F.col("score") >= ACCEPT)
    met = asked.join(kept.by_title, F.col("asked") == F.col("key"))
    return met.groupBy(*node).agg(F.max(F.struct("score", "own", (-F.col("f_pos")).alias("minus"))).alias("b"))


def gates(df: DataFrame) -> DataFrame:
    """Scores, the reason of the first gate that fails (null: confident), and whether the last gate met a year that is no number."""
    # each text is normalised once for each row, in a step of its own: inside the ratios it would be worked out for every mention
    kept = df.columns
    df = df.withColumn("_names", last_words(F.col("author"))).withColumns({"_x": normal_names(F.col("_names")), "_y": normal_names(F.col("c_authors")), **{f"_{c}": normalise(F.col(c)) for c in ("title", "c_title", "journal", "c_journal")}})
    sim = lambda a, b: F.when((text(F.col(a)) == "") | (text(F.col(b)) == ""), 0.0).otherwise(normal_ratio(F.col(f"_{a}"), F.col(f"_{b}")))
    df = df.select(*kept, sim("title", "c_title").alias("title_sim"), author_share(F.col("_names"), F.col("c_authors"), F.col("_x"), F.col("_y")).alias("author_sim"), sim("journal", "c_journal").alias("journal_sim"))
    both = (text(F.col("journal")) != "") & (text(F.col("c_journal")) != "")
    apart = F.abs(F.col("year").try_cast("int") - F.col("c_year").try_cast("int"))
    said = lambda what, c: F.format_string(f"{what} similarity too low: %.2f%%", 100 * F.col(c))
    odd = (text(F.col("year")) != "") & (text(F.col("c_year")) != "") & apart.isNull()
    df = df.withColumn("reason", F.when(F.col("title_sim") < TITLE, said("Title", "title_sim")).when(F.col("author_sim") < AUTHORS, said("Author", "author_sim")).when(both & (F.col("journal_sim") < JOURNAL), said("Journal", "journal_sim")).when(apart > YEARS, F.concat(F.lit("Years differ: "), "year", F.lit(" and "), "c_year")))
    return df.withColumn("exception", F.col("reason").isNull() & odd)


def _plain_pages(c: Column) -> Column:
    return F.trim(F.replace(F.replace(text(c), F.lit("--"), F.lit("-")), F.lit("−"), F.lit("-")))


def discrepancies(df: DataFrame) -> DataFrame:
    """`discrepancies` (messages) and `corrections` (field to value) of volume, number, pages and year."""
    differ = lambda a, b: (text(F.col(a)) != "") & (text(F.col(b)) != "") & (F.col(a) != F.col(b))
    p, q = _plain_pages(F.col("pages")), _plain_pages(F.col("c_pages"))
    url = F.contains(text(F.col("pages")), F.lit("doi.org")) & (text(F.col("c_pages")) != "")
    off = ~url & (p != "") & (q != "") & (p != q) & (F.replace(p, F.lit("-"), F.lit("")) != F.replace(q, F.lit("-"), F.lit("")))
    years = F.abs(F.col("year").try_cast("int") - F.col("c_year").try_cast("int")) == 1
    note = lambda what, a, b: F.concat(F.lit(f"{what}: "), F.col(a), F.lit(" / "), F.col(b))
    checks = [("volume", differ("volume", "c_volume"), "c_volume"), ("number", differ("number", "c_issue"), "c_issue"), ("pages", url, "c_pages")]
    notes = [F.when(on, note(f, f, c)) for f, on, c in checks] + [F.when(off, note("pages", "pages", "c_pages")), F.when(years, note("year", "year", "c_year"))]
    right = [F.when(on, F.struct(F.lit(f).alias("k"), F.col(c).alias("v"))) for f, on, c in checks]
    return df.withColumn("discrepancies", F.array_compact(F.array(*notes))).withColumn("corrections", F.map_from_entries(F.array_compact(F.array(*right))))


def verify(entries: DataFrame, catalogue: DataFrame | Catalogue) -> DataFrame:
    """(pos, id, status, reason, discrepancies, corrections, title_sim, author_sim, journal_sim) of each entry (ID, fields, force, doi; without a `pos` entries get one).

    status: skipped (force is "True"), not_found, error (a gate fails), exception (a year that is no number), warning (discrepancies) or
    verified. A DOI that the catalogue has decides alone; else the title is looked up. Every entry has one row, whatever its ID: repeated and null IDs
    are entries of their own. An empty table gives no rows; other columns aren't read.
    """
    kept = catalogue if isinstance(catalogue, Catalogue) else Catalogue.of(stored(catalogue, "records"))  # read three times, derived once
    pos = F.col("pos") if "pos" in entries.columns else F.monotonically_increasing_id()
    fields = ("title", "author", "journal", "year", "volume", "number", "pages")
    e = spread(entries.select(pos.alias("pos"), "ID", "force", *fields, "doi"))
    e = stored(e.select(F.monotonically_increasing_id().alias("row"), "pos", "ID", "force", *fields, doi(F.col("doi")).alias("e_doi")), "entries")
    skipped = F.col("force").eqNullSafe(F.lit("True"))
    found = stored(by_doi(e.where(~skipped), kept), "found")  # the catalogue's DOIs are read once
    missed = found.where("c_pos IS NULL").select(e.columns)
    titled = stored(by_title(missed, kept).select(found.columns), "titled")
    matched = discrepancies(gates(found.where("c_pos IS NOT NULL").unionByName(titled)))
    status = F.when(F.col("reason").isNotNull(), "error").when(F.col("exception"), "exception").when(F.size("discrepancies") > 0, "warning").otherwise("verified")
    out = ["discrepancies", "corrections", "title_sim", "author_sim", "journal_sim"]
    why = F.when(F.col("exception"), F.concat(F.lit("No number: "), "year")).otherwise(F.col("reason"))
    done = matched.select("pos", F.col("ID").alias("id"), status.alias("status"), why.alias("reason"), *out)
    lost = missed.join(unsent(titled.select("row")), "row", "left_anti").select("pos", F.col("ID").alias("id"), F.lit("not_found").alias("status"))
    rest = lost.unionByName(e.where(skipped).select("pos", F.col("ID").alias("id"), F.lit("skipped").alias("status")))
    return done.unionByName(rest, allowMissingColumns=True)


def status_counts(verification: DataFrame) -> DataFrame:
    return verification.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
