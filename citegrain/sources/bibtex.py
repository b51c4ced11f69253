"""BibTeX and lookup tables: scans and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.functions.words import ADDRESSES, CAPS, FIELDS, Settings
from citegrain.sources.tables import publish, stored

_TYPES = frozenset("article book booklet conference inbook incollection inproceedings manual mastersthesis misc phdthesis proceedings techreport unpublished".split())
#: Other spellings of fields.
_ALIASES = {"keyw": "keyword", "keywords": "keyword", "authors": "author", "editors": "editor", "urls": "url", "link": "url", "links": "url", "subjects": "subject", "xref": "crossref"}
_MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split()))
_HEAD = re.compile(r"@\s*(\w+)\s*[{(]\s*")
_KEY = re.compile(r"([^,\s]*)\s*,")
_FIELD = re.compile(r"\s*([\w:-]+)\s*=\s*")
_BARE = re.compile(r"[^,}#\s)]*")
_AFTER = re.compile(r"\s*(#|,|\}|\))?\s*")
_START, _BRACE, _IN_ROUND = re.compile(r"(?<![^\s})])@[ \t]*\w+[ \t]*([{(])"), re.compile(r"[{}]"), re.compile(r'[{}")]')
FILLED = [f for f in FIELDS if f not in ("ID", "ENTRYTYPE")]
SCHEMA = "pos long, ID string, ENTRYTYPE string, " + ", ".join(f"`{f}` string" for f in FILLED) + ", extra map<string,string>"
#: Part of a value: text, or the name of a macro.
Part = tuple[str, bool]


# --- one entry -------------------------------------------------------------------------------------------------------------


def parse(text: str) -> tuple[str, str, dict[str, list[Part]]] | None:
    """(type, key, values) of the entry that `text` begins with; of an @string the key is empty and the values are macros. None if it is neither a standard
    entry nor an @string."""
    head = _HEAD.match(text)
    kind = head[1].lower() if head else ""
    if kind == "string":
        key, at = "", head.end()
    elif kind in _TYPES and (m := _KEY.match(text, head.end())):
        key, at = m[1], m.end()
    else:
        return None
    values: dict[str, list[Part]] = {}
    while m := _FIELD.match(text, at):
        parts, at = _value(text, m.end())
        name = m[1].lower()
        values[name if kind == "string" else _ALIASES.get(name, name)] = parts
    return kind, key, values


def _value(text: str, at: int) -> tuple[list[Part], int]:
    """The parts of a value (braced, quoted or bare, joined by #), and where the next field begins."""
    parts: list[Part] = []
    while at < len(text):
        if text[at] in "{\"":
            close, depth, i = ("}" if text[at] == "{" else '"'), 0, at + 1
            while i < len(text) and not (text[i] == close and depth == 0):
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            parts.append((text[at + 1 : i], False))
            at = i + 1
        else:
            m = _BARE.match(text, at)
            bare = m[0].lower()
            parts.append((_MONTHS[bare], False) if bare in _MONTHS else (m[0], bool(bare) and not bare.isdigit()))
            at = m.end()
        m = _AFTER.match(text, at)
        at = m.end()
        if m[1] != "#":
            break
    return parts, at


def joined(parts: list[Part]) -> str:
    return " ".join("".join(t for t, _ in parts).split("\n")).strip()


# --- where entries begin and end -------------------------------------------------------------------------------------------

#: What a place of a file lies in: (False, 0) nothing, (False, n) an entry n braces deep, (True, n) or (True, -1) a round-bracketed entry, n braces deep or in quotes.
State = tuple[bool, int]
OUTSIDE: State = (False, 0)
#: Depths in round brackets that a stretch of a file is worked out for, and most braces.
_ROUND, _DEEP = range(-1, 9), 1000


def close(text: str, state: State, at: int = 0) -> tuple[int, State]:
    """Where the entry ends that `state` is in at `at`, or the text's end and the state there."""
    round_, depth = state
    if not round_:
        for m in _BRACE.finditer(text, at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.end(), OUTSIDE
        return len(text), (False, depth)
    for m in _IN_ROUND.finditer(text, at):
        if m[0] == '"':
            depth = {0: -1, -1: 0}.get(depth, depth)
        elif m[0] == ")" and depth == 0:
            return m.end(), OUTSIDE
        elif m[0] != ")" and depth >= 0:
            depth = max(0, depth + (1 if m[0] == "{" else -1))
    return len(text), (True, depth)


def entries_of(text: str, at: int = 0, known: dict[int, State] | None = None) -> tuple[list[tuple[int, int]], State]:
    """Places of the entries that begin outside of any from `at` on, and the state at the text's end; an entry that the text doesn't end is the last one.
    It stops at an entry that is in `known`, whose end state is known."""
    found: list[tuple[int, int]] = []
    now = OUTSIDE
    while now == OUTSIDE and (m := _START.search(text, at)):
        if known and m.start() in known:
            return found, known[m.start()]
        at, now = close(text, (m[1] == "(", 0 if m[1] == "(" else 1), m.end())
        found.append((m.start(), at))
    return found, now


def endings(text: str) -> dict[State, tuple[State, bool]]:
    """For each state that a stretch may begin in: the state at its end, and whether it lies inside one entry all through. Depths of braces that aren't
    named never close here."""
    found, end = entries_of(text)
    known = {a: end for a, _ in found}
    out = {OUTSIDE: (end, False)}
    depth = 0
    for m in _BRACE.finditer(text):
        depth += 1 if m[0] == "{" else -1
        if depth < 0 and (False, -depth) not in out and -depth <= _DEEP:
            out[False, -depth] = (entries_of(text, m.end(), known)[1], False)
    for n in _ROUND:
        at, now = close(text, (True, n))
        out[True, n] = (now, True) if now != OUTSIDE else (entries_of(text, at, known)[1], False)
    return out


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, start, text) of each stretch of a file that a task reads."""
    held, lines = None, []
    for batch in batches:
        for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            if held not in (None, (file, start)):
                yield (*held, "".join(lines))
                lines = []
            held = (file, start)
            lines.append(line + "\n")
    if held:
        yield (*held, "".join(lines))


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, text in _stretches(batches):
        rows = [{"round": r, "depth": d, "end_round": e[0], "end_depth": e[1], "through": t} for (r, d), (e, t) in endings(text).items()]
        yield pa.record_batch([pa.array([file]), pa.array([start], pa.int64()), pa.array([text.count("{") - text.count("}")], pa.int32()), pa.array([rows], pa.list_(_ENDING))], names=["file", "start", "net", "endings"])


_ENDING = pa.struct([("round", pa.bool_()), ("depth", pa.int32()), ("end_round", pa.bool_()), ("end_depth", pa.int32()), ("through", pa.bool_())])
_LOOKED = "file string, start long, net int, endings array<struct<round: boolean, depth: int, end_round: boolean, end_depth: int, through: boolean>>"


def _carried(looked: DataFrame) -> dict[tuple[str, int], tuple[int, State, int]]:
    """(number, state, owner) of each stretch: the state that it begins in and the stretch in which the entry began that it begins in. Some numbers for
    each stretch come to the driver, in order."""
    out: dict[tuple[str, int], tuple[int, State, int]] = {}
    file, state, owner = None, OUTSIDE, 0
    for i, r in enumerate(looked.orderBy("file", "start").toLocalIterator()):
        if r["file"] != file:
            file, state = r["file"], OUTSIDE
        out[file, r["start"]] = (i, state, owner)
        ends = {(e["round"], e["depth"]): ((e["end_round"], e["end_depth"]), e["through"]) for e in r["endings"]}
        state, through = ends.get(state, ((state[0], state[1] + r["net"]), True))
        owner = owner if through else i
    return out


def _pieces(lines: DataFrame) -> DataFrame:
    """(owner, stretch, pos, file, text, open): entries that stretches hold whole, and pieces of those that go beyond one."""
    sent = lines.sparkSession.sparkContext.broadcast(_carried(lines.mapInArrow(_look, _LOOKED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, text in _stretches(batches):
            i, state, owner = sent.value[file, start]
            first, now = (0, OUTSIDE) if state == OUTSIDE else close(text, state)
            found, end = entries_of(text, first) if now == OUTSIDE else ([], now)
            rows = [(owner, i, None, file, text[:first], True)] if first else []
            rows += [(i, i, (i << 32) + n, file, text[a:b], end != OUTSIDE and n == len(found) - 1) for n, (a, b) in enumerate(found)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], names=["owner", "stretch", "pos", "file", "text", "open"])

    return lines.mapInArrow(run, "owner long, stretch long, pos long, file string, text string, open boolean")


_PART = pa.struct([("text", pa.string()), ("macro", pa.bool_())])
_SCANNED = SCHEMA + ", file string, kind string, refs map<string, array<struct<text: string, macro: boolean>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("pos", "ID", "ENTRYTYPE", *FILLED, "extra", "file", "kind", "refs")}
        for pos, file, text in zip(*(batch.column(c).to_pylist() for c in ("pos", "file", "text"))):
            if (e := parse(text)) is None:
                continue
            kind, key, values = e
            macros = {k: [{"text": t, "macro": m} for t, m in p] for k, p in values.items() if kind == "string" or any(m for _, m in p)}
            plain = {} if kind == "string" else {k: joined(p) for k, p in values.items()}
            rest = {k: v for k, v in plain.items() if k not in FILLED} | {"ENTRYTYPE": kind, "ID": key}
            for c, v in (("pos", pos), ("file", file), ("kind", kind), ("ID", key), ("ENTRYTYPE", kind), ("refs", list(macros.items())), ("extra", [x for x in rest.items() if x[0] not in FIELDS]), *((f, plain.get(f)) for f in FILLED)):
                columns[c].append(v)
        types = {"pos": pa.int64(), "extra": pa.map_(pa.string(), pa.string()), "refs": pa.map_(pa.string(), pa.list_(_PART))}
        yield pa.record_batch([pa.array(v, types.get(c, pa.string())) for c, v in columns.items()], names=list(columns))


def _substituted(parts: DataFrame, macros: DataFrame) -> DataFrame:
    """(file, pos, name, parts) with each macro that is known replaced by its parts."""
    each = parts.select("file", "pos", "name", F.posexplode("parts").alias("i", "p"))
    known = macros.select(F.col("file").alias("m_file"), F.col("name").alias("m_name"), F.col("parts").alias("m_parts"))
    met = each.join(known, F.col("p.macro") & (F.col("file") == F.col("m_file")) & (F.lower("p.text") == F.col("m_name")), "left")
    one = F.struct("i", F.coalesce("m_parts", F.array("p")).alias("ps"))
    return met.groupBy("file", "pos", "name").agg(F.flatten(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["ps"])).alias("parts"))


#: Definitions that a definition may stand on, one on the other.
_NESTED = 8


def _with_macros(scanned: DataFrame) -> DataFrame:
    """Entries with their macros' values: those that the same file defines, the last definition counts; unknown names stay as they are."""
    defined = scanned.where("kind = 'string'").select("file", "pos", F.explode("refs").alias("name", "parts"))
    if defined.isEmpty():
        return scanned.where("kind <> 'string'")
    macros = stored(defined.groupBy("file", "name").agg(F.max_by("parts", "pos").alias("parts"), F.max("pos").alias("pos")), "macros")
    for _ in range(_NESTED):
        if macros.where(F.exists("parts", lambda p: p["macro"])).isEmpty():
            break
        macros = stored(_substituted(macros, macros), "macros")
    used = scanned.where("kind <> 'string'").select("file", "pos", F.explode("refs").alias("name", "parts"))
    value = F.trim(F.translate(F.array_join(F.transform("parts", lambda p: p["text"]), ""), "\n", " "))
    filled = _substituted(used, macros).groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("name", value))).alias("new")).withColumnRenamed("pos", "n_pos")
    rows = scanned.where("kind <> 'string'").join(filled, F.col("pos") == F.col("n_pos"), "left")
    new = F.coalesce("new", F.create_map().cast("map<string,string>"))
    extra = F.transform_values("extra", lambda k, v: F.coalesce(F.try_element_at(new, k), v))
    return rows.select("pos", "ID", "ENTRYTYPE", *(F.coalesce(F.try_element_at(new, F.lit(f)), F.col(f"`{f}`")).alias(f) for f in FILLED), extra.alias("extra"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files, one row each in file order (`pos`), repeated keys and all, macros (@string) resolved.

    Files are read in stretches by many tasks. A first pass works out how each stretch ends for each state it may begin in; going through these in order
    gives every stretch its own. Each task then cuts out the entries of its stretches, and the pieces of those that go beyond one are brought
    together by entry. An @ inside an entry begins none, wherever it stands, and one that is indented begins one; text between entries is skipped. An entry's type
    and its opening bracket stand on one line. A file without entries gives no rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    pieces = stored(_pieces(lines), "pieces")
    whole = pieces.where("pos IS NOT NULL AND NOT open").select("pos", "file", "text")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stretch", F.col("pos").isNull().cast("int").alias("k"), "text"))), lambda x: x["text"]), "")
    cut = pieces.where("open").groupBy("owner", "file").agg(F.max("pos").alias("pos"), parts.alias("text")).where("pos IS NOT NULL").select("pos", "file", "text")
    return _with_macros(stored(whole.unionByName(cut).mapInArrow(_parsed, _SCANNED), "scanned")).select(*(f"`{c}`" for c in ("pos", "ID", "ENTRYTYPE", *FILLED, "extra")))


def last_wins(entries: DataFrame) -> DataFrame:
    """One entry a key: the last one in file order."""
    last = entries.groupBy("ID").agg(F.max("pos").alias("pos"))
    return entries.join(last, ["ID", "pos"], "left_semi")


def bibtex_text(order: tuple[str, ...] = FIELDS, indent: str = "\t"):
    """Column: an entry as BibTeX, fields in `order`, missing ones left out."""
    lines = [F.when(F.col(f"`{f}`").isNotNull(), F.concat(F.lit(f"{indent}{f.capitalize()} = {{"), F.col(f"`{f}`"), F.lit("}"))) for f in sorted(order) if f not in ("ID", "ENTRYTYPE")]
    return F.concat(F.lit("@"), F.col("ENTRYTYPE"), F.lit("{"), F.concat_ws(",\n", F.col("ID"), *lines), F.lit("}\n"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    """Entries in order of `pos` (repeated ones in any order); part files in the order of their names make one BibTeX file. The folder `path` appears when all of it is written, or
    never: a job that fails, or tasks that are lost or run twice, leave nothing there. An existing one is not touched."""
    publish(entries.sparkSession, path, lambda draft: entries.orderBy("pos").select(bibtex_text().alias("value")).write.text(draft))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A headerless word list of settings, in order; blank lines go."""
    rows = spark.read.csv(path).where("_c0 IS NOT NULL").select("_c0").collect()
    return [r[0] for r in rows]


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(orig, corrected) of an alias dictionary with a header; of one original the last counts."""
    df = spark.read.option("header", True).csv(path).select("orig", "corrected", F.monotonically_increasing_id().alias("pos"))
    return df.where("orig IS NOT NULL AND corrected IS NOT NULL").groupBy("orig").agg(F.max_by("corrected", "pos").alias("corrected"))


def load_settings(spark: SparkSession, *, caps: str | None = None, addresses: str | None = None, journals: str | None = None, publishers: str | None = None, places: str | None = None) -> Settings:
    """Settings from a site's word lists and alias dictionaries; what isn't given keeps its default."""
    words = lambda path, default: tuple(read_words(spark, path)) if path else default
    aliases = lambda path: {r["orig"].lower(): r["corrected"] for r in read_aliases(spark, path).collect()} if path else {}
    return Settings(words(caps, CAPS), words(addresses, ADDRESSES), aliases(journals), aliases(publishers), aliases(places))
