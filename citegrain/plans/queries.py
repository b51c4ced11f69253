"""Registered queries of the bibliography operators, over a bibliography derived from the `part` table, and their SQL.

The derivation is SQL that Spark and DuckDB read alike, so each query's SQL starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.functions import names, pages
from citegrain.functions import text as t
from citegrain.functions.words import Settings
from citegrain.operators import diff, fixes, keys, lint, verify
from citegrain.operators.catalogue import Catalogue
from citegrain.sources import bibtex
from citegrain.sources.tables import new_path, spread

_K = "p_partkey"


def _pick(number: str, values: list[str]) -> str:
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: Names as written, their surname, its part of a key, the tidy form, and the last word.
_NAMES = (
    ("Jeremy Manning", "Manning", "Mann", "Jeremy Manning", "Manning"), ("M J Kahana", "Kahana", "Kaha", "M J Kahana", "Kahana"), ("Lee, A.B.", "Lee", "Lee", "A B Lee", "A.B."),
    ("Ludwig van der Meer", "vanderMeer", "vand", "Ludwig van der Meer", "Meer"), ("van Dam, L", "vanDam", "vanD", "L {van Dam}", "L"), ("S Ramón y Cajal", "yCajal", "yCaj", "S Ramón y Cajal", "Cajal"),
    ("José Núñez", "Núñez", "Nune", "José Núñez", "Núñez"), ("M B Smith Jr", "Smith", "Smit", "M B Smith Jr", "Jr"), ("Fox, Jr., John", "Fox", "Fox", "John Fox", "John"),
    ("B O'Brien", "OBrien", "OBri", "B O'Brien", "O'Brien"), ("H-T Ray", "Ray", "Ray", "H-T Ray", "Ray"), ("{K A} Okafor", "Okafor", "Okaf", "{ K A } Okafor", "Okafor"), ("CD Silva", "Silva", "Silv", "C D Silva", "Silva"),
)


def _name(i: int, form: int) -> str:
    return _pick(f"{_K} * 7 + {i} * 3 + p_size", [_text(n[form]) for n in _NAMES])


def _authors(form: int, join: str = " and ") -> str:
    """One to three names in a form; every 23rd entry has a name of too many parts."""
    lists = [f" || '{join}' || ".join(_name(i, form) for i in range(n)) for n in (1, 2, 3)]
    odd = ("Smith, John, PhD", "", None, "Smith, John, PhD", "PhD")[form]
    return f"CASE WHEN {_K} % 23 = 5 THEN {_text(odd)} ELSE {_pick(_K, lists)} END"


_YEAR = f"CAST(1990 + {_K} % 35 AS VARCHAR(8))"
_BASE = f"CASE WHEN {_K} % 23 <> 5 THEN " + _pick(_K, [_name(0, 2), f"{_name(0, 2)} || {_name(1, 2)}", f"{_name(0, 2)} || 'Etal'"]) + f" || substr({_YEAR}, 3, 2) END"
_A, _B = f"CAST({_K} % 300 + 90 AS VARCHAR(8))", f"CAST({_K} % 310 + 95 AS VARCHAR(8))"
#: Fields of the bibliography over `part`, with clean, fixable and unfixable values.
_FIELDS = {
    "pos": _K,
    "ID": f"CASE WHEN {_K} % 29 = 3 THEN 'Wrong99' ELSE coalesce({_BASE}, 'None') END || {_pick(_K, [chr(39) * 2, repr('a'), repr('b'), repr('zz'), repr('x')])}",
    "base": _BASE,
    "ENTRYTYPE": _pick(_K, ["'article'", "'inproceedings'", "'book'"]),
    "author": _authors(0),
    "year": _YEAR,
    "title": _pick(_K, ["p_name || ' and {EEG} Memory!'", "'The ' || p_name", "'A study: of ' || p_name || ' (' || p_type || ')'", "p_name", "'{' || p_name || ' EEG Study}'", "'What? Another (EEG) ' || p_name || '.'", "NULL"]),
    "journal": _pick(_K, ["'journal OF neuroscience'", "'NeuroImage'", "'Science & Practice'", "NULL", "'plos-one AND more'"]),
    "pages": _pick(_K, [_A, f"{_A} || '-' || {_B}", f"{_A} || '--' || {_B}", f"'e' || {_A} || '--' || {_B}", f"{_A} || '–' || {_B}", f"{_A} || '--' || substr({_B}, 2, 2)", "'iv--ix'", "'x--v'", f"'e' || {_A}", "'12a'", "NULL", f"{_A} || '--' || {_A}"]),
    "volume": f"CAST({_K} % 50 AS VARCHAR(8))",
    "doi": f"'https://doi.org/10.1/' || CAST({_K} AS VARCHAR(12))",
    "force": f"CASE WHEN {_K} % 40 = 7 THEN 'True' END",
}
_FIELDS |= {"publisher": f"CASE WHEN {_K} % 6 = 1 THEN 'MIT press' END", "editor": f"CASE WHEN {_K} % 8 = 2 THEN 'AA Smith' END", "address": f"CASE WHEN {_K} % 10 = 4 THEN 'Hanover, NH' END"}
_OTHER = ("number", "booktitle")


def entries(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """The bibliography; spread out, it is derived over all cores, as a file of a few megabytes is one task's."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part = spread(part) if spread_out else part
    return part.select(*(F.expr(x).alias(c) for c, x in _FIELDS.items()), *(F.lit(None).cast("string").alias(c) for c in _OTHER))


_ENTRIES = "e AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _FIELDS.items()) + " FROM part)"


#: Titles of three rare words, so that no other title is near; every two entries share one.
_RARE = f"md5(CAST({_K} - {_K} % 2 AS VARCHAR(12)))"
_RARE = f"substr({_RARE}, 1, 8) || ' ' || substr({_RARE}, 9, 8) || ' on ' || substr({_RARE}, 17, 8)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bibliography with rare titles and a key for each entry."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    own = {"ID": f"'K' || {_K}", "title": _RARE}
    return part.select(*(F.expr((_FIELDS | own)[c]).alias(c) for c in _FIELDS), *(F.lit(None).cast("string").alias(c) for c in _OTHER))


def catalogue(e: DataFrame) -> DataFrame:
    """A catalogue of the same works, some of them under other titles or volumes, or without a DOI."""
    k = F.col("pos")
    return e.select(
        k.alias("c_pos"), F.when(k % 3 != 0, t.doi(F.col("doi"))).alias("c_doi"), F.when(k % 7 == 0, F.lit("Another title altogether")).otherwise(F.col("title")).alias("c_title"), names.last_words(F.col("author")).alias("c_authors"), F.col("journal").alias("c_journal"),
        F.when(k % 31 != 4, F.col("year")).alias("c_year"), F.when(k % 5 == 0, F.lit("99")).otherwise(F.col("volume")).alias("c_volume"), F.lit(None).cast("string").alias("c_issue"), F.col("pages").alias("c_pages"),
    )


#: Forms as written, and what they should read.
_SCRIPTS = (
    ("Николай Чехов", "Nikolai Chekhov", "Chek"), ("Ελένη Παπαδοπούλου", "Elene Papadopoulou", "Papa"), ("민수 박", "minsu bag", "bag"), ("たなか ゆき", "tanaka yuki", "yuki"), ("Іван Їжак", "Ivan Yizhak", "Yizh"),
    ("ジョン スミス", "ziyon sumisu", "sumi"), ("José Núñez", "Jose Nunez", "Nune"), ("김 최영", "gim coeyeong", "coey"), ("Ψυχή Ξένος", "Psukhe Xenos", "Xeno"), ("Щукин, Юрий", "Shchukin, Iurii", "Shch"),
)
_ACCENTS = (("{\\'e}cole", "ecole"), ('M{\\"u}ller-Lyer', "MullerLyer"), ("{\\o}rsted", "orsted"), ('na\\"{i}ve', "naive"), ("plain-text", "plaintext"), ("Sm\\'{\\i}d", "Smid"), ("{\\v c}apek", "capek"), ("\\~nandu", "nandu"))
_PAGES = (
    ("WE-12.3", "conference", "WE-12", "3"), ("FR-AA-104", "conference", "FR-AA", "104"), ("doi.org/10.1/ab.c", "doi", None, None), ("2101.00001v2", "arxiv", None, None), ("cs/0101", "arxiv", None, None), ("MMXIV", "roman", None, "2014"), ("xliv", "roman", None, "44"),
    ("Xl", "invalid", None, None), ("1_000", "int", None, "1000"), ("S12", "prefixed", "S", "12"), ("12 a", "invalid", None, None),
)
_ALIASES = {"j neurosci": "journal of neuroscience", "pnas": "proceedings of the national academy of sciences"}
_ALIASED = (("J Neurosci", "Journal of Neuroscience"), ("PNAS", "Proceedings of the National Academy of Sciences"), ("the neuroimage review", "The {NeuroImage} Review"), ("journal of IEEE and acm", "Journal of {IEEE} and {ACM}"), ("", ""))


def _forms(spark: SparkSession, sf_dir: str, cases: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(pos, form): a form for each row of `part`."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = F.get(F.array(*(F.lit(c[0]) for c in cases)), (F.col("p_partkey") % len(cases)).cast("int"))
    return part.select(F.col("p_partkey").alias("pos"), at.alias("form"))


# --- queries ---------------------------------------------------------------------------------------------------------------


def lint_findings(spark, sf_dir):
    return _findings(spark, sf_dir).drop("pos")


def _findings(spark, sf_dir):
    return lint.findings(entries(spark, sf_dir).withColumn("ID", F.concat("ID", F.lit("-"), "pos")), Settings())


def lint_fixes(spark, sf_dir):
    fixed = F.array_sort(F.map_entries("fix"))
    return fixes.pivot(_findings(spark, sf_dir)).select("id", F.array_join(F.transform(fixed, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("fix"))


def page_values(spark, sf_dir):
    p = pages.page(F.coalesce("pages", F.lit("")))
    return entries(spark, sf_dir).select("pos", p.alias("p")).select("pos", "p.valid", "p.kind", "p.prefix", F.coalesce(F.col("p.num").cast("long"), F.lit(-1)).alias("num"))


def page_targets(spark, sf_dir):
    df = entries(spark, sf_dir).select("pos", pages.pages(F.col("pages")).alias("p"), pages.correct_pages(F.col("pages")).alias("q"))
    return df.select("pos", "p.ok", "p.target", "q.unfixable")


def citation_keys(spark, sf_dir):
    return entries(spark, sf_dir).select("pos", names.citation_key(F.col("author"), F.col("year")).alias("key"))


def surname_lists(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("pos", F.array_join(names.surnames(F.col("author")), "|").alias("surnames"), F.array_join(names.last_words(F.col("author")), "|").alias("last_words"))


def key_suffixes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("i"), keys.suffix(F.col("p_partkey")).alias("suffix"))


def suffix_repair(spark, sf_dir):
    return keys.repair(entries(spark, sf_dir).select("pos", "ID", "base"))


def duplicate_keys(spark, sf_dir):
    return keys.duplicate_keys(entries(spark, sf_dir))


def duplicate_entries(spark, sf_dir):
    return keys.duplicate_entries(entries(spark, sf_dir))


def title_normalised(spark, sf_dir):
    return entries(spark, sf_dir).select("pos", t.normalise(F.col("title")).alias("title"), t.count_of(F.col("title"), "{").alias("braces"), t.remove_non_letters(F.col("title")).alias("bare"), t.remove_curlies(F.col("title")).alias("unbraced"))


def title_sentence_case(spark, sf_dir):
    return entries(spark, sf_dir).select("pos", names.title_text(F.col("title"), Settings()).alias("title"), names.venue_text(F.col("journal"), {}, Settings().caps).alias("journal"), names.author_text(F.col("author")).alias("author"))


def word_parts(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("s", t.split_word(F.col("title")))
    return e.select("pos", "s.prefix", "s.core", "s.suffix", t.capitalise(F.col("title")).alias("capital"), t.same_words(F.col("title"), F.col("journal")).alias("same"), t.same_key(F.col("ID"), F.col("base")).alias("same_key"), F.nullif(F.array_position(F.split("author", " "), "and"), F.lit(0)).cast("int").alias("first_and"), t.position_of(F.split("author", " "), "and b").alias("at"))


def field_values(spark, sf_dir):
    return lint.distinct_values(entries(spark, sf_dir), ["year", "journal", "ENTRYTYPE"])


def _versions(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("ID", F.concat(F.lit("K"), F.col("pos").cast("string")))
    new = e.where("pos % 13 <> 0").withColumn("year", F.when(F.col("pos") % 17 == 0, "2030").otherwise(F.col("year"))).withColumn("volume", F.when(F.col("pos") % 19 != 0, F.col("volume")))
    return e.where("pos % 11 <> 0").withColumn("journal", F.when(F.col("pos") % 23 != 0, F.col("journal"))), new


def version_diff(spark, sf_dir):
    return diff.diff(*_versions(spark, sf_dir), ["year", "volume", "journal", "title"])


def diff_summary(spark, sf_dir):
    return diff.summary(version_diff(spark, sf_dir))


def bibtex_output(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("pos", bibtex.bibtex_text(("ID", "ENTRYTYPE", "author", "journal", "pages", "title", "year")).alias("entry"))


def _titles(spark, sf_dir) -> tuple[DataFrame, Catalogue]:
    """Distinct titles of all entries, and the catalogue."""
    e = entries(spark, sf_dir)
    return e.where("title IS NOT NULL").select(t.normalise(F.col("title")).alias("title")).distinct(), Catalogue.of(catalogue(e))


#: Fields of the bibliography that a BibTeX file keeps.
_KEPT = ("ENTRYTYPE", "ID", "author", "year", "title", "journal", "pages", "volume", "force", "publisher", "editor", "address")


def bibtex_round_trip(spark, sf_dir):
    """All entries written as a BibTeX file and read back."""
    e, path = entries(spark, sf_dir), new_path(spark, "bibtex")
    bibtex.write_bibtex(e.select("*", *(F.lit(None).cast("string").alias(f) for f in bibtex.FILLED if f not in e.columns)), path)
    return bibtex.read_bibtex(spark, path).select(*_KEPT)


def near_titles(spark, sf_dir):
    """Pairs of titles that are alike by their letters."""
    ours, theirs = _titles(spark, sf_dir)
    return theirs.titles.near(ours)


def title_search(spark, sf_dir):
    """The three titles of the catalogue that share most of each title's words by weight, the weight in millionths."""
    ours, theirs = _titles(spark, sf_dir)
    return theirs.titles.search(ours).select("title", "c_title", F.floor(F.col("relevance") * 1000000 + 0.5).cast("long").alias("relevance"))


def title_candidates(spark, sf_dir):
    """Pairs of titles that verification compares; entries belong to their title's pairs."""
    return verify.title_candidates(*_titles(spark, sf_dir))


def doi_matches(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("e_doi", t.doi(F.col("doi")))
    return verify.by_doi(e.select("pos", "e_doi"), catalogue(entries(spark, sf_dir))).select("pos", "e_doi", F.coalesce("c_pos", F.lit(-1)).alias("match"), "c_volume")


def verification(spark, sf_dir):
    e = entries(spark, sf_dir, spread_out=True).withColumn("ID", F.concat("ID", F.lit("-"), "pos"))
    found = verify.verify(e, catalogue(e))
    return found.withColumn("corrections", F.to_json("corrections"))


def _verified_works(spark, sf_dir):
    e = works(spark, sf_dir)
    return verify.verify(e, catalogue(e))


def entry_status(spark, sf_dir):
    """Verdicts on entries with rare titles."""
    return _verified_works(spark, sf_dir).select("id", "status", F.array_join("discrepancies", ";").alias("discrepancies"), F.to_json("corrections").alias("corrections"))


def verification_status(spark, sf_dir):
    return verify.status_counts(_verified_works(spark, sf_dir))


def fatal_findings(spark, sf_dir):
    return lint.fatal(entries(spark, sf_dir)).drop("pos")


def script_names(spark, sf_dir):
    """Names of other scripts in Latin letters, and their keys."""
    return _forms(spark, sf_dir, _SCRIPTS).select("pos", t.decode(F.col("form")).alias("name"), names.citation_key(F.col("form"), F.lit("1999")).alias("key"))


def latex_accents(spark, sf_dir):
    return _forms(spark, sf_dir, _ACCENTS).select("pos", t.remove_accents_and_hyphens(F.col("form")).alias("plain"))


def venue_aliases(spark, sf_dir):
    return _forms(spark, sf_dir, _ALIASED).select("pos", names.venue_text(F.col("form"), _ALIASES, Settings().caps).alias("venue"))


def special_pages(spark, sf_dir):
    p = _forms(spark, sf_dir, _PAGES).select("pos", pages.page(F.col("form")).alias("p"))
    return p.select("pos", "p.kind", "p.prefix", F.col("p.num").cast("string").alias("num"))


#: Fields of an entry and of its catalogue row.
_PAIRED = {
    "volume": f"CAST({_K} % 3 AS VARCHAR(8))", "c_volume": f"CASE WHEN {_K} % 4 <> 0 THEN CAST({_K} % 2 AS VARCHAR(8)) END", "number": f"CASE WHEN {_K} % 5 <> 0 THEN CAST({_K} % 4 AS VARCHAR(8)) END", "c_issue": f"CAST({_K} % 3 AS VARCHAR(8))",
    "pages": _pick(_K, ["'1--9'", "'1-9'", "'https://doi.org/10.1/x'", "'19'", "NULL"]), "c_pages": _pick(f"{_K} * 3", ["'1-9'", "'1−9'", "'2-9'", "''"]), "year": f"CAST(2000 + {_K} % 3 AS VARCHAR(8))", "c_year": f"CAST(2000 + {_K} % 2 AS VARCHAR(8))",
}


def field_notes(spark, sf_dir):
    """Discrepancies and corrections of fields side by side."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pos"), *(F.expr(x).alias(c) for c, x in _PAIRED.items()))
    return verify.discrepancies(part).select("pos", F.array_join("discrepancies", ";").alias("notes"), F.to_json("corrections").alias("corrections"))


def fixed_entries(spark, sf_dir):
    """Entries with their fixes applied."""
    e = entries(spark, sf_dir).withColumn("ID", F.concat("ID", F.lit("-"), "pos")).withColumn("extra", F.create_map(F.lit("note"), F.lit("x")))
    fixed = fixes.apply(fixes.prune(e), fixes.pivot(_findings(spark, sf_dir)))
    return fixed.select("pos", "ID", "pages", "title", "journal", "publisher", "author", "editor", "address", F.coalesce(F.size("extra"), F.lit(0)).alias("n_extra"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    lint_findings, lint_fixes, page_values, page_targets, citation_keys, surname_lists, key_suffixes, suffix_repair, duplicate_keys, duplicate_entries, title_normalised, title_sentence_case, word_parts, field_values,
    version_diff, diff_summary, bibtex_output, bibtex_round_trip, near_titles, title_search, title_candidates, doi_matches, verification, entry_status, verification_status, fatal_findings, script_names, latex_accents, venue_aliases, special_pages, field_notes, fixed_entries,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


# --- SQL -------------------------------------------------------------------------------------------------------------------

_NORMAL = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\{{[^}}]*\\}}', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')))"
_PUNCTUATION = "[,.!?''\"{}\\-\\\\:()\\[\\]+/*]"
_ROMANS = "CASE upper({0}) WHEN 'IV' THEN 4 WHEN 'IX' THEN 9 WHEN 'X' THEN 10 WHEN 'V' THEN 5 END"


def _kind(c: str) -> str:
    return (
        f"CASE WHEN {c} = '' THEN 'empty' WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match({c}, '[a-zA-Z]+[0-9]+') THEN 'prefixed'"
        f" WHEN regexp_full_match(upper({c}), '[IVX]+') AND {_ROMANS.format(c)} IS NOT NULL AND ({c} = lower({c}) OR {c} = upper({c})) THEN 'roman' ELSE 'invalid' END"
    )


def _number(c: str) -> str:
    return f"CASE {_kind(c)} WHEN 'int' THEN CAST({c} AS BIGINT) WHEN 'prefixed' THEN CAST(regexp_extract({c}, '[0-9]+$') AS BIGINT) WHEN 'roman' THEN {_ROMANS.format(c)} END"


def _prefix(c: str) -> str:
    return f"CASE WHEN {_kind(c)} = 'prefixed' THEN regexp_extract({c}, '^[a-zA-Z]+') END"


def _pages(source: str, c: str, key: str) -> str:
    """SQL of (key, ok, target) of pages(c)."""
    return f"""(SELECT {key}, CASE WHEN contains(c, '–') THEN false WHEN k <> 'invalid' THEN true WHEN len(p) <> 2 OR a = b OR ka <> kb OR ka = 'invalid' THEN false
 WHEN ka IN ('int', 'roman') THEN na < nb ELSE pa = pb AND na < nb END AS ok,
 CASE WHEN contains(c, '–') THEN replace(c, '–', '-') WHEN k <> 'invalid' THEN c WHEN len(p) <> 2 THEN array_to_string(p, '--') WHEN a = b THEN a
 WHEN ka = 'prefixed' AND kb = 'int' THEN pa || na || '--' || pa || nb WHEN ka <> kb OR ka = 'invalid' THEN c
 WHEN ka = 'int' AND na >= nb AND length(CAST(nb AS VARCHAR)) < length(CAST(na AS VARCHAR)) THEN na || '--' || substr(CAST(na AS VARCHAR), 1, length(CAST(na AS VARCHAR)) - length(CAST(nb AS VARCHAR))) || nb
 ELSE a || '--' || b END AS target
 FROM (SELECT *, {_kind('a')} AS ka, {_kind('b')} AS kb, {_number('a')} AS na, {_number('b')} AS nb, {_prefix('a')} AS pa, {_prefix('b')} AS pb
 FROM (SELECT *, {_kind('c')} AS k, p[1] AS a, p[2] AS b FROM (SELECT {key}, {c} AS c, list_filter(list_transform(string_split({c}, '-'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {source}))))"""


#: Venues as written and as they should read, and titles by the rules that these titles meet.
_VENUES = {"journal OF neuroscience": "Journal of Neuroscience", "NeuroImage": "{NeuroImage}", "plos-one AND more": "{PLoS}-One and More"}
_JOURNAL = "CASE journal " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _VENUES.items()) + " ELSE coalesce(journal, '') END"
_WORDS = "string_split(regexp_replace(CASE WHEN title LIKE '{%}' THEN substr(title, 2, length(title) - 2) ELSE title END, '\\.$', ''), ' ')"
_CASED = """list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] LIKE '%{%' OR lower(w[i]) = 'a' THEN w[i] WHEN w[i] IN ('EEG', '(EEG)') THEN replace(w[i], 'EEG', '{EEG}')
 WHEN i > 1 AND regexp_matches(w[i - 1], '[.!?]$') THEN w[i] ELSE lower(w[i]) END)"""
_TITLE = "array_to_string(list_concat([CASE WHEN w[1] LIKE '%{%' OR lower(w[1]) = 'a' THEN c[1] ELSE upper(substr(c[1], 1, 1)) || lower(substr(c[1], 2)) END], c[2:]), ' ')"


def oracle_sql() -> dict[str, str]:
    e = f"WITH {_ENTRIES} "
    fields = lambda view: " UNION ALL ".join(f"SELECT ID AS id, '{f}' AS field, {f} AS v FROM {view} WHERE {f} IS NOT NULL" for f in ("year", "volume", "journal", "title"))
    changes = f"""{e}, k AS (SELECT * REPLACE ('K' || pos AS ID) FROM e), a AS (SELECT * REPLACE (CASE WHEN pos % 23 <> 0 THEN journal END AS journal) FROM k WHERE pos % 11 <> 0),
b AS (SELECT * REPLACE (CASE WHEN pos % 17 = 0 THEN '2030' ELSE year END AS year, CASE WHEN pos % 19 <> 0 THEN volume END AS volume) FROM k WHERE pos % 13 <> 0),
x AS ({fields('a')}), y AS ({fields('b')}), c AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.field, y.field) AS field,
 CASE WHEN x.v IS NULL THEN 'added_field' WHEN y.v IS NULL THEN 'deleted_field' ELSE 'modified' END AS change, x.v AS old, y.v AS new
 FROM (SELECT * FROM x WHERE id IN (SELECT ID FROM b)) x FULL JOIN (SELECT * FROM y WHERE id IN (SELECT ID FROM a)) y ON x.id = y.id AND x.field = y.field WHERE x.v IS DISTINCT FROM y.v
 UNION ALL SELECT ID, NULL, 'removed', NULL, NULL FROM a WHERE ID NOT IN (SELECT ID FROM b) UNION ALL SELECT ID, NULL, 'added', NULL, NULL FROM b WHERE ID NOT IN (SELECT ID FROM a)) """
    letters = "'abcdefghijklmnopqrstuvwxyz'"
    suffix = lambda i: f"CASE WHEN {i} < 26 THEN substr({letters}, {i} + 1, 1) WHEN {i} < 702 THEN substr({letters}, ({i} - 26) // 26 + 1, 1) || substr({letters}, ({i} - 26) % 26 + 1, 1) ELSE substr({letters}, ({i} - 702) // 676 + 1, 1) || substr({letters}, ({i} - 702) // 26 % 26 + 1, 1) || substr({letters}, ({i} - 702) % 26 + 1, 1) END"
    same = f"string_split({_authors(4, '|')}, '|')"
    titles = f"tt AS (SELECT pos, {_TITLE} AS t_title FROM (SELECT pos, w, {_CASED} AS c FROM (SELECT pos, {_WORDS} AS w FROM e WHERE title <> '')))"
    paged = f"f AS (SELECT pos, coalesce(pages, '') AS c0 FROM e), p AS {_pages('f', 'c0', 'pos')}, q AS {_pages('p', 'target', 'pos')}"
    based = f"b AS (SELECT {_K} AS pos, {_authors(3)} AS t_author FROM part)"
    ranked = "r AS (SELECT pos, base, count(*) OVER (PARTITION BY base) AS n, row_number() OVER (PARTITION BY base ORDER BY pos) - 1 AS k FROM e WHERE base IS NOT NULL)"
    x = "x AS (SELECT e.* EXCLUDE (ID), e.ID || '-' || e.pos AS id, t_title, t_author, p.target AS t_pages, NOT q.ok AS unfixable FROM e LEFT JOIN tt ON tt.pos = e.pos JOIN b ON b.pos = e.pos JOIN p ON p.pos = e.pos JOIN q ON q.pos = e.pos)"
    checks = [
        ("key", 0, "ID", "id", "base", "NOT starts_with(id, base)", "fix"), ("pages", 2, "pages", "coalesce(pages, '')", "t_pages", "coalesce(pages, '') <> t_pages", "fix"),
        ("empty_title", 4, "title", "coalesce(title, '')", "NULL", "t_title IS NULL", "fatal"), ("journal", 5, "journal", "journal", _JOURNAL, f"journal <> {_JOURNAL}", "fix"), ("title", 7, "title", "title", "t_title", "title <> t_title", "fix"),
        ("publisher", 8, "publisher", "publisher", "'Mit Press'", "publisher IS NOT NULL", "fix"), ("author", 9, "author", "author", "t_author", "author <> t_author", "fix"), ("editor", 10, "editor", "editor", "'A A Smith'", "editor IS NOT NULL", "fix"),
        ("address", 11, "address", "address", "'Hanover, {NH}'", "address IS NOT NULL", "fix"), ("name", 12, "author", "author", "NULL", "base IS NULL", "fatal"),
    ]
    rows = [f"SELECT id, '{c}' AS \"check\", {o} AS check_order, '{f}' AS field, {a} AS actual, {t} AS target, '{sev}' AS severity FROM x WHERE force IS NULL AND {on}" for c, o, f, a, t, on, sev in checks]
    rows.append("SELECT id, 'pages_unfixable', 3, 'pages', coalesce(pages, ''), t_pages, 'fatal' FROM x WHERE unfixable")
    linted = f"{e}, {titles}, {paged}, {based}, {ranked}, {x}, lf(id, \"check\", check_order, field, actual, target, severity) AS ("
    cat = f"{e}, cat AS (SELECT pos AS c_pos, CASE WHEN pos % 3 <> 0 THEN '10.1/' || pos END AS c_doi, CASE WHEN pos % 7 = 0 THEN 'Another title altogether' ELSE title END AS c_title, CASE WHEN pos % 5 = 0 THEN '99' ELSE volume END AS c_volume FROM e)"
    rows.append(f"SELECT id, 'suffix', 1, 'ID', id, CASE WHEN n = 1 THEN r.base ELSE r.base || {suffix('k')} END, 'fix' FROM x JOIN r ON r.pos = x.pos WHERE force IS NULL")
    linted += " UNION ALL ".join(rows) + ")"
    named = f"""{cat}, a AS (SELECT DISTINCT {_NORMAL.format('title')} AS t FROM e WHERE title IS NOT NULL), z AS (SELECT DISTINCT {_NORMAL.format('c_title')} AS t FROM cat WHERE c_title <> ''),
ag AS (SELECT t, g, count(*) AS n FROM (SELECT t, substr(t, unnest(range(1, length(t))), 2) AS g FROM a) GROUP BY t, g), zg AS (SELECT t, g, count(*) AS n FROM (SELECT t, substr(t, unnest(range(1, length(t))), 2) AS g FROM z) GROUP BY t, g),
pairs AS (SELECT ag.t AS title, zg.t AS c_title, sum(least(ag.n, zg.n)) AS shared, length(ag.t) + length(zg.t) AS l FROM ag JOIN zg ON ag.g = zg.g WHERE ag.t <> zg.t GROUP BY ag.t, zg.t),
near AS (SELECT title, c_title FROM pairs WHERE 2 * least(length(title), length(c_title)) >= 0.85 * l - 1e-9 AND levenshtein(title, c_title) <= l - 2 * ceil(0.85 * l / 2 - 1e-9) AND shared >= 3 * ceil(0.85 * l / 2 - 1e-9) - l - 1),
aw AS (SELECT t, unnest(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS word FROM a), zw AS (SELECT t, unnest(list_distinct(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS word FROM z),
size AS (SELECT count(*) AS n FROM z WHERE t <> ''), wt AS (SELECT word, greatest(1, CAST(floor(ln((n + 1) / df) * 1000) AS BIGINT)) AS weight FROM (SELECT word, count(*) AS df FROM zw GROUP BY word), size),
own AS (SELECT t, sum(coalesce(weight, greatest(1, CAST(floor(ln(n + 1) * 1000) AS BIGINT)))) AS own FROM aw LEFT JOIN wt USING (word), size GROUP BY t), total AS (SELECT t, sum(weight) AS total FROM zw JOIN wt USING (word) GROUP BY t),
rel AS (SELECT aw.t AS title, zw.t AS c_title, 2.0 * CAST(sum(weight) AS DOUBLE) / any_value(own + total) AS relevance FROM aw JOIN zw USING (word) JOIN wt USING (word) JOIN own ON own.t = aw.t JOIN total ON total.t = zw.t GROUP BY aw.t, zw.t),
top AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY title ORDER BY relevance DESC, c_title) <= 3) """
    year = lambda k: f"CASE WHEN {k} % 31 <> 4 THEN 1990 + {k} % 35 END"
    verdict = f"""{e}, w AS (SELECT {_K} AS k, {_RARE} AS title, {same} AS names, journal, pages, volume, force, 1990 + {_K} % 35 AS y FROM part JOIN e ON pos = {_K}),
c AS (SELECT *, {year('k')} AS cy FROM w WHERE k % 7 <> 0),
m AS (SELECT w.k, coalesce(CASE WHEN w.k % 3 <> 0 THEN w.k END, (SELECT c.k FROM c WHERE c.title = w.title ORDER BY c.cy IS NULL OR c.cy = w.y DESC, c.names[1] = w.names[1] DESC, c.k LIMIT 1)) AS ck FROM w),
v AS (SELECT w.*, m.ck, o.journal AS cj, o.pages AS cp, {year('o.k')} AS cy, o.names AS cn, CASE WHEN o.k % 5 = 0 THEN '99' ELSE o.volume END AS cv FROM w JOIN m ON m.k = w.k LEFT JOIN w o ON o.k = m.ck),
g AS (SELECT *, ck % 7 = 0 AS titled, len(list_filter(names, lambda x: list_contains(cn, x))) / greatest(len(names), len(cn)) AS share,
 replace(replace(coalesce(pages, ''), '--', '-'), '−', '-') AS a, replace(replace(coalesce(cp, ''), '--', '-'), '−', '-') AS b FROM v),
s AS (SELECT 'K' || k AS id, *, CASE WHEN force = 'True' THEN 'skipped' WHEN ck IS NULL THEN 'not_found' WHEN titled OR share < 0.7 OR (journal <> cj AND journal IS NOT NULL AND cj IS NOT NULL) OR abs(y - cy) > 1 THEN 'error' END AS early,
 list_filter([CASE WHEN volume <> cv THEN 'volume: ' || volume || ' / ' || cv END, CASE WHEN a <> '' AND b <> '' AND a <> b AND replace(a, '-', '') <> replace(b, '-', '') THEN 'pages: ' || pages || ' / ' || cp END,
 CASE WHEN abs(y - cy) = 1 THEN 'year: ' || y || ' / ' || cy END], lambda x: x IS NOT NULL) AS notes FROM g),
z AS (SELECT id, coalesce(early, CASE WHEN len(notes) > 0 THEN 'warning' ELSE 'verified' END) AS status, CASE WHEN early IS NULL OR early = 'error' THEN array_to_string(notes, ';') END AS discrepancies,
 CASE WHEN early IS NULL OR early = 'error' THEN CASE WHEN volume <> cv THEN '{{"volume":"' || cv || '"}}' ELSE '{{}}' END END AS corrections FROM s)"""
    form = lambda cases, *places: "SELECT p_partkey AS pos, " + ", ".join(f"{_pick(_K, [_text(c[i]) for c in cases])}{more} AS {name}" for i, name, more in places) + " FROM part"
    fixed = ("pages", "title", "journal", "publisher", "author", "editor", "address")
    return {
        "script_names": form(_SCRIPTS, (1, "name", ""), (2, "key", " || '99'")),
        "latex_accents": form(_ACCENTS, (1, "plain", "")),
        "special_pages": form(_PAGES, (1, "kind", ""), (2, "prefix", ""), (3, "num", "")),
        "field_notes": f"""WITH p AS (SELECT p_partkey AS pos, {', '.join(f'{x} AS {c}' for c, x in _PAIRED.items())} FROM part),
q AS (SELECT *, replace(replace(coalesce(pages, ''), '--', '-'), '−', '-') AS a, replace(replace(c_pages, '--', '-'), '−', '-') AS b, contains(coalesce(pages, ''), 'doi.org') AND c_pages <> '' AS url FROM p),
r AS (SELECT *, CASE WHEN volume <> c_volume THEN 'volume: ' || volume || ' / ' || c_volume END AS v, CASE WHEN number <> c_issue THEN 'number: ' || number || ' / ' || c_issue END AS n FROM q)
SELECT pos, array_to_string(list_filter([v, n, CASE WHEN url OR (a <> '' AND b <> '' AND replace(a, '-', '') <> replace(b, '-', '')) THEN 'pages: ' || pages || ' / ' || c_pages END,
 CASE WHEN abs(CAST(year AS INTEGER) - CAST(c_year AS INTEGER)) = 1 THEN 'year: ' || year || ' / ' || c_year END], lambda x: x IS NOT NULL), ';') AS notes,
 '{{' || array_to_string(list_filter([CASE WHEN v IS NOT NULL THEN '"volume":"' || c_volume || '"' END, CASE WHEN n IS NOT NULL THEN '"number":"' || c_issue || '"' END, CASE WHEN url THEN '"pages":"' || c_pages || '"' END], lambda x: x IS NOT NULL), ',') || '}}' AS corrections FROM r""",
        "venue_aliases": form(_ALIASED, (1, "venue", "")),
        "fixed_entries": f"""{linted}, fx AS (SELECT id, field, arg_max(target, check_order) AS t FROM lf WHERE target IS NOT NULL GROUP BY id, field)
SELECT x.pos, coalesce(i.t, x.id) AS ID, {', '.join(f'coalesce({f[:3]}_.t, x.{f}) AS {f}' for f in fixed)}, CAST(CASE WHEN x.force IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_extra
FROM x LEFT JOIN fx i ON i.id = x.id AND i.field = 'ID' AND x.force IS NULL {' '.join(f"LEFT JOIN fx {f[:3]}_ ON {f[:3]}_.id = x.id AND {f[:3]}_.field = '{f}' AND x.force IS NULL" for f in fixed)}""",
        "page_values": f"{e}, p AS (SELECT pos, coalesce(pages, '') AS c FROM e) SELECT pos, {_kind('c')} <> 'invalid' AS valid, {_kind('c')} AS kind, {_prefix('c')} AS prefix, coalesce(CAST({_number('c')} AS BIGINT), -1) AS num FROM p",
        "page_targets": f"{e}, f AS (SELECT pos, coalesce(pages, '') AS c0 FROM e), p AS {_pages('f', 'c0', 'pos')}, q AS {_pages('p', 'target', 'pos')} SELECT p.pos, p.ok, p.target, NOT q.ok AS unfixable FROM p JOIN q ON p.pos = q.pos",
        "citation_keys": f"{e} SELECT pos, base AS key FROM e",
        "surname_lists": f"""SELECT {_K} AS pos, CASE WHEN {_K} % 23 = 5 THEN '' ELSE {_authors(1, '|')} END AS surnames, {_authors(4, '|')} AS last_words FROM part""",
        "lint_findings": f"{linted} SELECT * FROM lf",
        "lint_fixes": f"{linted} SELECT id, string_agg(field || '=' || target, '; ' ORDER BY field) AS fix FROM (SELECT id, field, arg_max(target, check_order) AS target FROM lf WHERE target IS NOT NULL GROUP BY id, field) GROUP BY id",
        "title_sentence_case": f"{e}, {titles}, {based} SELECT e.pos, t_title AS title, {_JOURNAL} AS journal, t_author AS author FROM e LEFT JOIN tt ON tt.pos = e.pos JOIN b ON b.pos = e.pos",
        "word_parts": f"""{e} SELECT pos, regexp_extract(title, '^[^A-Za-z]*') AS prefix, regexp_extract(title, '[A-Za-z](.*[A-Za-z])?') AS core, regexp_extract(title, '[^A-Za-z]*$') AS suffix,
 upper(substr(title, 1, 1)) || lower(substr(title, 2)) AS capital, regexp_replace(lower(trim(title)), '{_PUNCTUATION}', '', 'g') = regexp_replace(lower(trim(journal)), '{_PUNCTUATION}', '', 'g') AS same,
 starts_with(ID, base) OR starts_with(base, ID) AS same_key, CAST(list_position(string_split(author, ' '), 'and') AS INTEGER) AS first_and, CAST(coalesce(list_position(list_transform(range(1, len(string_split(author, ' '))), lambda i: lower(string_split(author, ' ')[i]) || ' ' || lower(string_split(author, ' ')[i + 1])), 'and b'), 0) - 1 AS INTEGER) AS at FROM e""",
        "fatal_findings": f"""{e}, d AS (SELECT {_K} AS pos, CASE WHEN {_K} % 23 = 5 THEN '' ELSE {_authors(1)} END AS s FROM part), n AS (SELECT ID, title, count(*) OVER (PARTITION BY coalesce(title, ''), s) AS n FROM e JOIN d USING (pos))
SELECT ID AS id, 'duplicate_key' AS "check", 13 AS check_order, 'ID' AS field, ID AS actual, CAST(NULL AS VARCHAR) AS target, 'fatal' AS severity FROM e GROUP BY ID HAVING count(*) > 1
UNION ALL SELECT ID, 'duplicate_entry', 14, 'title', coalesce(title, ''), NULL, 'fatal' FROM n WHERE n > 1""",
        "entry_status": f"{verdict} SELECT * FROM z",
        "verification_status": f"{verdict} SELECT status, count(*) AS n FROM z GROUP BY status",
        "key_suffixes": f"SELECT p_partkey AS i, {suffix('p_partkey')} AS suffix FROM part",
        "suffix_repair": f"""{e}, g AS (SELECT pos, ID, base, count(*) OVER (PARTITION BY base) AS n FROM e WHERE base IS NOT NULL), l AS (SELECT base, i, base || {suffix('i')} AS legal FROM (SELECT base, unnest(range(n)) AS i FROM (SELECT DISTINCT base, n FROM g WHERE n > 1))),
fr AS (SELECT base, legal, row_number() OVER (PARTITION BY base ORDER BY i) AS r FROM l WHERE legal NOT IN (SELECT ID FROM e)),
w AS (SELECT g.*, l.legal IS NOT NULL AS good FROM g LEFT JOIN l ON g.base = l.base AND g.ID = l.legal), v AS (SELECT *, row_number() OVER (PARTITION BY base, good ORDER BY pos) AS r FROM w)
SELECT v.pos, v.ID, v.base, CASE WHEN n = 1 THEN v.base WHEN good THEN v.ID ELSE fr.legal END AS target FROM v LEFT JOIN fr ON v.base = fr.base AND v.r = fr.r AND NOT good UNION ALL SELECT pos, ID, base, NULL FROM e WHERE base IS NULL""",
        "duplicate_keys": f"{e} SELECT ID, count(*) AS n FROM e GROUP BY ID HAVING count(*) > 1",
        "duplicate_entries": f"""{e}, d AS (SELECT {_K} AS pos, CASE WHEN {_K} % 23 = 5 THEN '' ELSE {_authors(1)} END AS surnames FROM part),
n AS (SELECT coalesce(title, '') AS title, surnames, count(*) OVER (PARTITION BY coalesce(title, ''), surnames) AS n, pos, ID FROM e JOIN d USING (pos)) SELECT * FROM n WHERE n > 1""",
        "title_normalised": f"{e} SELECT pos, {_NORMAL.format("coalesce(title, '')")} AS title, length(title) - length(replace(title, '{{', '')) AS braces, regexp_replace(title, '[,.!?''\"{{}}\\-\\\\:()\\[\\]+/*]', '', 'g') AS bare, regexp_replace(title, '\\{{([^{{}}]*)\\}}', '\\1', 'g') AS unbraced FROM e",
        "field_values": f"{e} SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM e WHERE {f} IS NOT NULL" for f in ("year", "journal", "ENTRYTYPE")) + ") GROUP BY field, value",
        "version_diff": f"{changes} SELECT * FROM c",
        "diff_summary": f"{changes} SELECT change, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN change IN ('removed', 'added') THEN change ELSE 'modified' END AS change FROM c) GROUP BY change",
        "bibtex_output": f"{e} SELECT pos, '@' || ENTRYTYPE || '{{' || concat_ws(',' || chr(10), ID, " + ", ".join(f"chr(9) || '{f.capitalize()} = {{' || {f} || '}}'" for f in ("author", "journal", "pages", "title", "year")) + ") || '}' || chr(10) AS entry FROM e",
        "bibtex_round_trip": f"{e} SELECT {', '.join(_KEPT)} FROM e",
        "near_titles": f"{named} SELECT title, c_title FROM near",
        "title_search": f"{named} SELECT title, c_title, CAST(floor(relevance * 1000000 + 0.5) AS BIGINT) AS relevance FROM top",
        "title_candidates": f"{named} SELECT title, c_title FROM near UNION SELECT title, c_title FROM top WHERE title <> c_title",
        "doi_matches": f"{cat} SELECT pos, '10.1/' || pos AS e_doi, coalesce(c_pos, -1) AS match, c_volume FROM e LEFT JOIN cat ON c_doi = '10.1/' || pos",
    }
