"""Phrase collocations: count-min sketches find what may be frequent, an exact count of that follows, then scores and subsumption.

Four passes over the texts. The first measures them, which sets the sketches' widths. The second sketches words, the third phrases of frequent words only;
each task fills its own sketch, and sketches are merged block by block. A cell never holds less than the count of what falls into it, so a phrase
that is frequent survives in every row of cells. The fourth counts the survivors exactly, by their words; only these are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.llm.common import batch_rows, spread_join, stored

#: Phrases: least count, most words; the longer phrase's share (in %) of a count that takes a phrase away; phrases returned of a language.
LEAST, LONGEST, SHARE, MOST = 100, 5, 100, 2000
#: Rows of cells in a sketch, and cells of a block. A cell is a byte that stays at CAP.
ROWS, BLOCK, CAP = 2, 1 << 16, 255
#: Bits of a sketch's width: least, and most. The bits of 2**28 cells are 64 MB, sent to all tasks; a corpus of more than some 10**10 words
#: would need more and fills its cells higher: more phrases survive to be counted, none is lost.
NARROW, WIDE = 16, 28
#: Words for each cell: of texts, most of which are of frequent words and share cells, and of those that begin phrases.
LOAD_WORDS, LOAD = 128, 32
#: Up to this width a task keeps its sketch whole (32 MB); beyond it keeps cells as they come, and hands them on after so many.
WHOLE, HELD = 24, 1 << 23
#: Bytes of text that a worker works on at once, and rows sent to it.
CHUNK, BATCH = 1 << 22, 1000
#: Words that a worker keeps numbers of, and phrases that it keeps counts of.
KNOWN = 1 << 20
#: Words of the texts for each place that adds up counts (frequent phrases are a twentieth of them at most), and ranges for each place.
ADDED, SPREAD = 5_000_000, 8
#: Rows that one task sorts for the ranks.
RANKED = 200_000

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K[1]
    h = (h ^ (h >> np.uint64(27))) * _K[2]
    return h ^ (h >> np.uint64(31))


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row."""
    shift = np.uint64(64 - bits)
    return [(h >> shift).astype(np.uint32), (_mix(h ^ _K[3]) >> shift).astype(np.uint32)]


def pieces(text: str | None) -> Iterator[bytes]:
    """A text (null: empty) in lower case, its pieces parted by line ends; of a long one, runs of whole pieces of about CHUNK bytes."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while len(data) - at > CHUNK:
        end = data.rfind(b"\n", at, at + CHUNK)
        end = data.find(b"\n", at + CHUNK) if end < 0 else end
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:] if at else data


class Numbers(dict):
    """Numbers of words as they come, and their 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class Run:
    """Words of some texts: `word` (their number), `piece`, `lang` and `hash` of each, the language among the hashed."""

    def __init__(self, texts: list[tuple[bytes, str]], numbers: Numbers):
        data = b"\n".join(t for t, _ in texts)
        self.words = data.split()
        self.word = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))
        letters = np.frombuffer(data, np.uint8)
        blank = (letters == 10) | (letters == 32)
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        self.piece = np.searchsorted(np.flatnonzero(letters == 10), starts)
        self.langs = sorted({g for _, g in texts})
        at = {g: i for i, g in enumerate(self.langs)}
        ends = np.cumsum([len(t) + 1 for t, _ in texts])
        self.lang = np.array([at[g] for _, g in texts])[np.searchsorted(ends, starts, side="right")]
        seeds = np.array([xxhash.xxh3_64_intdigest(g.encode(), seed=1) for g in self.langs], np.uint64)
        self.hash = _mix(np.array(numbers.hashes, np.uint64)[self.word] ^ seeds[self.lang]) if len(self.words) else np.zeros(0, np.uint64)

    def phrases(self, longest: int, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, starts, hashes) of the phrases of each length from 1 within pieces, of those that `keep(words, hashes)` keeps. A longer phrase is
        looked at only where both shorter ones in it were kept."""
        n = len(self.words)
        kept, h = np.ones(n, bool), self.hash
        for m in range(1, longest + 1):
            if m > 1:
                whole = self.piece[m - 1 :] == self.piece[: n - m + 1]
                kept = kept[:-1][: max(n - m + 1, 0)] & kept[1:] & whole
                h = h[: n - m + 1] * _K[0] + self.hash[m - 1 :]
            if n < m or not kept.any():
                return
            at = np.flatnonzero(kept)
            mixed = h[at] if m == 1 else _mix(h[at])
            good = keep(m, mixed)
            if good is not None:
                kept[at[~good]] = False
                at, mixed = at[good], mixed[good]
            yield m, at, mixed


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of about CHUNK bytes of texts."""
    held, size, numbers = [], 0, Numbers()
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            for part in pieces(text.as_py()):
                held.append((part, lang.as_py()))
                size += len(part)
                if size >= CHUNK:
                    yield Run(held, numbers)
                    held, size = [], 0
                    if len(numbers) > KNOWN:
                        numbers = Numbers()
    if held:
        yield Run(held, numbers)


class Bits:
    """Which cells of a sketch reach the least count: one bit for each cell of each row."""

    def __init__(self, bits: int, rows: list[bytes]):
        self.bits, self.rows = bits, [np.frombuffer(r, np.uint8) for r in rows]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, c in zip(self.rows, cells(h, self.bits)):
            out &= (row[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


class Sketch:
    """A task's own cells, whole or as they come."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.table = np.zeros((ROWS, 1 << bits), np.uint8) if bits <= WHOLE else None
        self.seen: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

    def add(self, h: np.ndarray) -> None:
        for row, c in enumerate(cells(h, self.bits)):
            if self.table is None:
                self.seen[row].append(c)
                continue
            at, n = np.unique(c, return_counts=True)
            self.table[row, at] = np.minimum(self.table[row, at] + n, CAP)
        self.held += len(h)

    def full(self) -> bool:
        return self.table is None and self.held >= HELD

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(row, block, cells) of what isn't zero; the sketch is empty afterwards."""
        size = min(BLOCK, 1 << self.bits)
        for row in range(ROWS):
            if self.table is not None:
                at = np.flatnonzero(self.table[row])
                n = self.table[row, at]
                self.table[row] = 0
            elif self.seen[row]:
                at, n = np.unique(np.concatenate(self.seen[row]), return_counts=True)
                n = np.minimum(n, CAP).astype(np.uint8)
                self.seen[row] = []
            else:
                continue
            ends = np.searchsorted(at, np.arange(0, (1 << self.bits) + 1, size))
            for block in np.flatnonzero(np.diff(ends)).tolist():
                i, j = ends[block], ends[block + 1]
                yield row, block, packed(at[i:j] - block * size, n[i:j], size)
        self.held = 0


def packed(at: np.ndarray, n: np.ndarray, size: int) -> bytes:
    """A block's cells: all of them, or where few are not zero their places and counts."""
    if len(at) * 3 < size:
        return b"s" + pa.compress(at.astype("<u2").tobytes() + n.tobytes(), "zstd", asbytes=True) + len(at).to_bytes(4, "little")
    whole = np.zeros(size, np.uint8)
    whole[at] = n
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)  # cells are small numbers in no order: nothing repeats, but few values make most of them
    return b"w" + coder.compress(whole.tobytes()) + coder.flush() + size.to_bytes(4, "little")


def add_packed(total: np.ndarray, data: bytes) -> None:
    """Adds a block's cells to `total`; sums stay at CAP."""
    n = int.from_bytes(data[-4:], "little")
    if data[:1] == b"w":
        at, got = slice(None), np.frombuffer(zlib.decompress(data[1:-4]), np.uint8)
    else:
        raw = pa.decompress(data[1:-4], 3 * n, "zstd", asbytes=True)
        at, got = np.frombuffer(raw, "<u2", n), np.frombuffer(raw, np.uint8, n, 2 * n)
    total[at] = np.minimum(total[at] + got.astype(np.uint16), CAP)


def _sketched(texts: DataFrame, bits: int, first: int, longest: int, words: Bits | None) -> DataFrame:
    """Blocks of each task's sketch of the phrases of `first` to `longest` words (row, block, cells), and the words it has of each language (lang, n)."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, sketch, seen = sent.value, Sketch(bits), {}
        keep = lambda m, h: frequent.has(h) if m == 1 and frequent else None
        for r in runs(batches):
            for lang, n in zip(r.langs, np.bincount(r.lang, minlength=len(r.langs)).tolist()):
                seen[lang] = seen.get(lang, 0) + n
            for m, _, h in r.phrases(longest, keep):
                if m >= first:
                    sketch.add(h)
            if sketch.full():
                yield from map(_block, sketch.blocks())
        yield _batch(lang=list(seen), n=list(seen.values()))
        yield from map(_block, sketch.blocks())

    return texts.mapInArrow(run, "lang string, n long, row int, block int, cells binary")


def _block(found: tuple[int, int, bytes]) -> pa.RecordBatch:
    row, block, data = found
    return _batch(row=[row], block=[block], cells=[data])


def _batch(**columns: list) -> pa.RecordBatch:
    size = max(map(len, columns.values()))
    types = {"lang": pa.string(), "n": pa.int64(), "row": pa.int32(), "block": pa.int32(), "cells": pa.binary()}
    return pa.record_batch([pa.array(columns.get(k, [None] * size), t) for k, t in types.items()], names=list(types))


def _merged(sketches: DataFrame, bits: int, least: int) -> Bits:
    """The tasks' sketches added up block by block, as bits of the cells that reach `least`. A task holds its own blocks only; what comes back has
    the size of the sketch's bits, 2**WIDE / 4 bytes at most."""
    size, level = min(BLOCK, 1 << bits), min(least, CAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, data in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "cells"))):
                add_packed(held.setdefault((row, block), np.zeros(size, np.uint8)), data)
        for (row, block), c in held.items():
            if (c >= level).any():
                yield pa.record_batch([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(c >= level, bitorder="little").tobytes()], pa.binary())], names=["row", "block", "bits"])

    blocks = sketches.where("row IS NOT NULL").select("row", "block", "cells")
    parts = max(1, ROWS * ((1 << bits) // BLOCK) // 64)
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in blocks.repartition(parts, "row", "block").mapInArrow(run, "row int, block int, bits binary").toLocalIterator():
        out[r["row"], r["block"] * size // 8 :][: size // 8] = np.frombuffer(r["bits"], np.uint8)
    return Bits(bits, [row.tobytes() for row in out])


def width(expected: float) -> int:
    return min(WIDE, max(NARROW, int(np.ceil(np.log2(max(expected, 1))))))


def _places(r: Run, m: int, at: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, count) of the distinct phrases of m words at `at`. Phrases of one hash are one only if they have the same words and language."""
    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    mine = at[first][which]
    same = r.lang[at] == r.lang[mine]
    for k in range(m):
        same &= r.word[at + k] == r.word[mine + k]
    n = n - np.bincount(which[~same], minlength=len(n))
    yield from zip(at[first].tolist(), n.tolist())
    yield from ((i, 1) for i in at[~same].tolist())


def _messages(held: dict[tuple[str, bytes, int], int], ranges: int) -> Iterator[pa.RecordBatch]:
    """Counts as a row for each range of phrases and language, in order of the phrases."""
    of: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
    for (lang, phrase, _), n in held.items():
        of.setdefault((xxhash.xxh3_64_intdigest(phrase) % ranges, lang), []).append((phrase, n))
    for (k, lang), rows in of.items():
        phrases, n = zip(*sorted(rows))
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([lang]), pa.array([[p.decode() for p in phrases]], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64()))], names=["range", "lang", "phrase", "n"])


def _counted(texts: DataFrame, words: Bits, phrases: Bits, least: int, longest: int, parts: int) -> DataFrame:
    """(lang, phrase, size, a): exact counts of what survives both sketches, down to `least`. A task sends its counts as one row for each range of phrases and language,
    or a few where its phrases are many; a range's counts are added up in one place."""
    sent = texts.sparkSession.sparkContext.broadcast((words, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, likely = sent.value
        keep = lambda m, h: (frequent if m == 1 else likely).has(h)
        held: dict[tuple[str, bytes, int], int] = {}
        for r in runs(batches):
            for m, at, h in r.phrases(longest, keep):
                for i, n in _places(r, m, at, h):
                    key = (r.langs[r.lang[i]], b" ".join(r.words[i : i + m]), m)
                    held[key] = held.get(key, 0) + n
            if len(held) > KNOWN:
                yield from _messages(held, parts * SPREAD)
                held = {}
        yield from _messages(held, parts * SPREAD)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
                for phrase, n in zip(phrases, counts):
                    total[lang, phrase] = total.get((lang, phrase), 0) + n
        found = [(lang, phrase, phrase.count(" ") + 1, n) for (lang, phrase), n in total.items() if n >= least]
        for i in range(0, len(found), BLOCK):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found[i : i + BLOCK]), (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "size", "a"])

    found = texts.mapInArrow(run, "range int, lang string, phrase array<string>, n array<bigint>")
    return found.repartition(parts, "range").mapInArrow(add, "lang string, phrase string, size int, a long")


def _part(phrase: str, first: str, count: str) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.expr(first), F.expr(count)), " ")


def scored(counts: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words and more among `counts` (lang, phrase, size, a), at their lowest-scoring
    cut, without those that a longer one takes away. Parts of a counted phrase are counted, being as frequent. A phrase inside a longer one lies
    inside one that is a word longer and at least as frequent, so only those are looked at."""
    long = counts.where("size > 1")
    cuts = long.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    side = lambda part: F.struct("lang", part.alias("phrase"))
    cuts = cuts.select("a", side(_part("phrase", "1", "k")).alias("left"), _part("phrase", "k + 1", "size - k").alias("rest"))  # both parts are the phrase
    known = lambda key, name: counts.select(side(F.col("phrase")).alias(key), F.col("a").alias(name))
    cuts = spread_join(cuts, known("left", "l"), "left").select("a", "l", F.struct("left.lang", F.col("rest").alias("phrase")).alias("right"), F.col("left.phrase").alias("first"))
    cuts = spread_join(cuts, known("right", "r"), "right").select("a", "l", "r", "right.lang", F.concat_ws(" ", "first", "right.phrase").alias("phrase"), F.size(F.split("first", " ")).alias("k")).join(totals, "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000 * ({exact('a')} * {exact('n')})) div ({exact('l')} * {exact('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.explode(F.array(_part("phrase", "1", "size - 1"), _part("phrase", "2", "size - 1"))).alias("phrase")
    longer = long.where("size > 2").select("lang", inner, F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {share} * a"))
    return left.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a", "b.l", "b.r", "n", "b.score")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first `most` of each language with their rank. Parts of a language are ranked first, so no task sorts more than a part's rows or the parts' best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, found.count() // RANKED)
    first = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most).drop("rank", "part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, most: int | None = MOST) -> DataFrame:
    """(lang, rank, phrase, size, a, l, r, n, score): each language's phrases of two to `longest` words that occur `least` times or more, best first;
    all of them, without a rank, if `most` is None.

    A null language is `und`; null and empty texts have no words; repeated rows count each; ties go by count, then by the bytes of the phrase. Long texts are
    read whole, piece by piece. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    with batch_rows(spark, BATCH):
        counts, totals = _frequent(spark, texts, least, longest)
    found = stored(scored(counts, totals, share), "collocations")
    return found if most is None else ranked(found, most)


def _frequent(spark: SparkSession, texts: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of one word and more with exact counts, and the languages' words."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = width(chars / 6 / LOAD_WORDS)
    sketch = stored(_sketched(texts, bits, 1, 1, None), "words")
    totals = stored(sketch.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    words = _merged(sketch, bits, least)
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = width(n / LOAD)
    phrases = _merged(_sketched(texts, bits, 2, longest, words), bits, least)
    return stored(_counted(texts, words, phrases, least, longest, 1 + n // ADDED), "phrases"), totals


def oracle(least: int = LEAST, longest: int = LONGEST, share: int = SHARE, most: int = MOST) -> str:
    """DuckDB SQL of mine()'s digest over `documents`: all phrases counted."""
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, size, count(*) AS a FROM (SELECT lang, m AS size, {part('i', 'i + m - 1')} AS phrase FROM i, (SELECT unnest(range(1, {longest + 1})) AS m) WHERE i + m - 1 <= len(w)) GROUP BY lang, phrase, size HAVING count(*) >= {least}),
c AS (SELECT lang, phrase, a, size, k, {part('1', 'k')} AS x, {part('k + 1', 'size')} AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
s AS (SELECT c.lang, c.phrase, c.a, c.size, n.n, x.a AS l, y.a AS r, k, CAST(1000 * CAST(c.a AS HUGEINT) * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
 FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([{part('1', 'size - 1')}, {part('2', 'size')}]) AS phrase FROM f WHERE size > 2) GROUP BY lang, phrase),
z AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE o.a IS NULL OR 100 * o.a < {share} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= {most}"""
