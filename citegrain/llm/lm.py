"""Scores of texts by Elias-Fano tries of the trigrams of all training words, beside add-one unigrams.

Witten-Bell smoothing, from trigrams to pairs to words to one share for each known word and one for all unknown ones. Texts are gathered by
chunks. Each chunk sends its distinct trigrams, with their training counts, to ranges of first words; a range builds its trie
(trie.py) of what all chunks counted, maps it into memory and answers every chunk by look-ups; chunks then put the shares together.
Ranges grow in number with the corpus, not in size. A word of more than half a range's trigrams is split by the word after it into
several ranges, and only its totals are added up and sent to all. Words are told apart by 56-bit hashes (seven pairs of a billion distinct words collide).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import checkpointed, chunks, new_table, shared_dir
from citegrain.llm.trie import VALUES, Trie, build, mapped, save

ORDER = 3
#: Stand for hashes: before a text, its end, and what follows that.
START, END, AFTER = range(3)
#: Trigrams of a range, about.
SPAN = 1 << 20
#: Characters of a chunk.
CHUNK = 1 << 23
#: Frequent words that messages name by two bytes; words listed as candidates by a task have at least this share of its tokens.
FREQUENT, SHARE = (1 << 16) - 1, 1e-6
#: Words that are split into ranges, at most; the next ones of a corpus so large fill a range somewhat over its span.
SPLIT = 1_000_000
_RARE = np.uint64(1 << 56)
_GATHERED = "chunk long, doc_ids array<long>, n long, train_n long, word binary, code binary, size binary"
_MAIL = "kind int, chunk long, bucket long, x array<binary>"
_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; splitting bytes knows just the six blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes, the empty ones left out."""
    x = np.ascontiguousarray(x).astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(5, "little") + bytes([width]) + pa.compress(raw, "zstd", asbytes=True)


def opened(data: bytes) -> np.ndarray:
    """The numbers of packed(), as 64-bit integers."""
    n, width = int.from_bytes(data[:5], "little"), data[5]
    raw = np.frombuffer(pa.decompress(data[6:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<i8").ravel()


def gather(docs: DataFrame) -> DataFrame:
    """One pass over docs (doc_id, t, train): a row for each chunk of texts with their words' hashes (most frequent first), the texts as places
    of these, and twice each text's length plus whether it is for training."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, train, at = batch.column("doc_id"), np.array(batch.column("train")), 0
            for texts in chunks((x.as_py() for x in batch.column("t")), CHUNK):
                own = train[at : at + len(texts)]
                w = [tokens(x) for x in texts]
                size = np.array([len(x) for x in w])
                code, word = np.zeros(0, int), []
                if size.sum():
                    code, word = pd.factorize(np.array([x for y in w for x in y], object))
                hashes = np.array([xxhash.xxh64_intdigest(x) >> 8 for x in word], np.uint64)
                order = np.argsort(-np.bincount(code, minlength=len(word)), kind="stable")
                place = np.empty(len(word), int)
                place[order] = np.arange(len(word))
                n = [chunk, keys.slice(at, len(texts)).to_pylist(), int(size.sum()) + len(size), int((size[own] + 1).sum()), packed(hashes[order]), packed(place[code]), packed(size << 1 | own)]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(n, kinds)], ["chunk", "doc_ids", "n", "train_n", "word", "code", "size"])
                at += len(texts)
                chunk += 1

    path = new_table(docs.sparkSession, "gathered")
    docs.select("doc_id", "t", "train").mapInArrow(run, _GATHERED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_GATHERED).parquet(path)


@dataclass
class Figures:
    """What all tasks know: sums of the corpus, the keys of the frequent words in order, the split words and into how many ranges."""

    total: int
    ranges: int
    frequent: np.ndarray
    split: np.ndarray
    parts: np.ndarray
    folder: str | None = None
    distinct: int = 0
    counts: np.ndarray | None = None  # of the split words: followed, by how many others

    def key(self, hashes: np.ndarray) -> np.ndarray:
        """One number for a word: its place among the frequent ones, or its hash above these."""
        if not len(self.frequent):
            return hashes | _RARE
        turn = np.argsort(self.frequent)
        at = np.minimum(np.searchsorted(self.frequent, hashes, sorter=turn), len(turn) - 1)
        known = self.frequent[turn[at]] == hashes
        return np.where(known, turn[at].astype(np.uint64), hashes | _RARE)

    def split_place(self, keys: np.ndarray) -> np.ndarray:
        """Places among the split words; -1 for others."""
        at = np.searchsorted(self.split, keys)
        hit = at < len(self.split)
        hit[hit] = self.split[at[hit]] == keys[hit]
        return np.where(hit, at, -1)

    def bucket(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The range of trigrams that begin with the words a, b."""
        place = self.split_place(a)
        parts = np.where(place >= 0, np.append(self.parts, 1)[place], 1).astype(np.uint64)
        return ((_mixed(a) + _mixed(b ^ a) % parts * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.ranges)).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def figures(parts: DataFrame) -> Figures:
    """Sums of the gathered chunks and their frequent words (counts over all chunks; words below SHARE of a task's tokens aren't sent by it)."""

    def run(batches):
        word, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for w, c in zip(batch.column("word"), batch.column("code")):
                h = opened(w.as_py()).view(np.uint64)
                few = np.bincount(opened(c.as_py()), minlength=len(h))
                word, back = np.unique(np.concatenate([word, h]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, few]), len(word)).astype(np.int64)
        keep = n >= max(2, SHARE * n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(word[keep].astype(np.int64)), pa.array(n[keep])], ["word", "n"])

    size, total, texts = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "train_n", F.size("doc_ids")))).first()
    ranges = max(1, -(-size // SPAN))
    counted = parts.select("word", "code").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    least = SPAN // 2
    first = [F.desc("n"), F.asc("word")]
    frequent = checkpointed(counted.orderBy(*first).limit(FREQUENT)).toPandas().sort_values(["n", "word"], ascending=[False, True])  # 16 bytes each
    large = checkpointed(counted.where(F.col("n") > least).orderBy(*first).limit(SPLIT)).toPandas()
    out = Figures(total, ranges, frequent["word"].to_numpy(np.int64).view(np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    word, n = large["word"].to_numpy(np.int64).view(np.uint64), large["n"].to_numpy(np.int64)
    if texts > least:
        word, n = np.append(word, np.uint64(START)), np.append(n, texts)
    keys = out.key(word)
    turn = np.argsort(keys)
    out.split, out.parts = keys[turn], -(-n // least)[turn]
    place = urlparse(shared_dir(parts.sparkSession))
    out.folder = place.path if place.scheme in ("", "file") else None
    return out


class Chunk:
    """The trigrams of a gathered chunk. Each text is START, its words, END and AFTER twice, so that the pair and the word which a
    symbol's shorter contexts ask for begin trigrams of the chunk too. What stands before START is START: a first word's trigram
    has the counts of its pair."""

    def __init__(self, word: bytes, code: bytes, size: bytes, known: Figures):
        code, size = opened(code), opened(size)
        keys = np.concatenate([known.key(np.array([START, END, AFTER], np.uint64)), known.key(opened(word).view(np.uint64))])
        order = np.argsort(keys, kind="stable")
        number = np.empty(len(keys), int)
        number[order] = np.arange(len(keys))
        self.keys, m = keys[order], len(keys)
        train, size = size & 1 > 0, size >> 1
        begin = np.cumsum(size + 4) - size - 4
        line = np.full(int((size + 4).sum()), -1)
        for at, what in ((begin, START), (begin + size + 1, END), (begin + size + 2, AFTER), (begin + size + 3, AFTER)):
            line[at] = number[what]
        line[line < 0] = number[code + 3]
        place = np.ones(len(line), bool)
        place[begin + size + 2] = place[begin + size + 3] = False
        at = np.flatnonzero(place)
        self.size, self.train = size, train
        pair, context = np.unique(line[at] * m + line[at + 1], return_inverse=True)
        a, b = self.keys[pair // m], self.keys[pair % m]
        bucket = known.bucket(a, b)
        turn = np.argsort(bucket, kind="stable")
        back = np.empty(len(pair), int)
        back[turn] = np.arange(len(pair))
        pair, bucket = pair[turn], bucket[turn]
        gram, self.gram = np.unique(back[context] * m + line[at + 2], return_inverse=True)
        self.pair_of = gram // m  # of each trigram
        self.n = np.bincount(self.gram, train[np.repeat(np.arange(len(size)), size + 2)], len(gram)).astype(np.int64)
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] // m != pair[:-1] // m) | (bucket[1:] != bucket[:-1])
        self.word_of = np.cumsum(new) - 1  # of each pair: a word may begin pairs of several ranges
        self.a, self.b, self.c = pair[new] // m, pair % m, gram % m
        self.bucket = bucket[new]

    def requests(self) -> Iterator[tuple[int, list[bytes]]]:
        """(bucket, message): words, pairs of each, trigrams of each and their counts."""
        words = np.flatnonzero(np.append(np.diff(self.bucket, prepend=-1) != 0, True))
        pairs = np.searchsorted(self.word_of, words)
        grams = np.searchsorted(self.pair_of, pairs)
        per_word, per_pair = np.bincount(self.word_of, minlength=len(self.a)), np.bincount(self.pair_of, minlength=len(self.b))
        for i in range(len(words) - 1):
            w, p, g = (slice(x[i], x[i + 1]) for x in (words, pairs, grams))
            said = [self.keys[x] for x in (self.a[w], self.b[p], self.c[g])]
            rare = np.concatenate([x[x >= _RARE] for x in said]) & (_RARE - np.uint64(1))
            short = [packed(np.minimum(x, np.uint64(FREQUENT))) for x in said]
            yield int(self.bucket[words[i]]), [*short, packed(rare), packed(per_word[w]), packed(per_pair[p]), packed(self.n[g])]

    def scores(self, answers: list[list[bytes]], known: Figures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its known words, and the sums of log10 probabilities by single words and by trigrams, from the answers in order of ranges."""
        p3, p2, left2, followed, kinds = (np.concatenate([opened(x[k]) for x in answers]) if answers else np.zeros(0, int) for k in range(5))
        place = known.split_place(self.keys[self.a])
        whole, others = (np.where(place >= 0, np.append(known.counts[k], 0)[place], x) for k, x in enumerate((followed, kinds)))
        share = np.where(place >= 0, (followed + kinds) / np.maximum(whole + others, 1), 1.0)  # a split word's part of its pairs
        v = known.distinct
        doc = np.repeat(np.arange(len(self.size)), self.size + 1)
        at = np.arange(len(doc)) + doc + 1  # the trigram that begins with each symbol of the texts
        lower = self.pair_of[self.gram[at - 1]]
        count = whole[self.word_of[self.pair_of[self.gram[at]]]]
        p = (count + v / (v + 1)) / (known.total + v) if v else np.ones(len(at))
        b = self.word_of[lower]
        left = np.where(whole[b] + others[b] > 0, others[b] / np.maximum(whole[b] + others[b], 1), 1.0)
        own = VALUES[p2[lower]] * share[b]
        p = own + left * p
        first = np.append(True, doc[1:] != doc[:-1])
        g = self.gram[np.where(first, at - 1, at - 2)]
        p = np.where(first, own + left * p, VALUES[p3[g]] + VALUES[left2[self.pair_of[g]]] * p)
        single = np.log10(count + 1) - log10(known.total + v + 1)
        return tuple(np.bincount(doc, x, len(self.size)) for x in (count > 0, single, np.log10(p)))


def _groups(batches, by: str):
    """(value, rows) of runs of rows alike in `by`; rows stand by it."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[by] != last:
                yield last, held
                held = []
            last = row[by]
            held.append(row)
    if held:
        yield last, held


def _mail(kind: int, rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    """Rows (chunk, bucket, message) of a kind."""
    chunk, bucket, x = ([r[k] for r in rows] for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(x, pa.list_(pa.binary()))], ["kind", "chunk", "bucket", "x"])


def _mapped_trie(arrays: dict[str, np.ndarray], folder: str | None) -> Trie:
    """The trie, mapped from a file of the shared folder that lives as long as the mapping; held in memory where that folder can't be mapped."""
    if folder is None:
        return Trie(arrays)
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/trie-{uuid.uuid4().hex}"
    try:
        save(arrays, path)
        return Trie(mapped(path))
    finally:
        if os.path.exists(path):
            os.unlink(path)


def range_answers(messages: list[list[bytes]], known: Figures) -> tuple[list[list[bytes]], dict[str, np.ndarray]]:
    """A range's answer to each message, and its words that were counted: keys, followed, by how many others."""
    parts, sizes = [[] for _ in range(6)], []
    for x in messages:
        said, rare, at = [opened(y).view(np.uint64) for y in x[:3]], opened(x[3]).view(np.uint64) | _RARE, 0
        for y, to in zip(said, parts):
            y = y.copy()
            long = np.flatnonzero(y == FREQUENT)
            y[long] = rare[at : at + len(long)]
            at += len(long)
            to.append(y)
        sizes.append([len(y) for y in said])
        for y, to in zip(x[4:], parts[3:]):
            to.append(opened(y))
    a, b, c, per_word, per_pair, n = (np.concatenate(x) for x in parts)
    words, place = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    a, b, c = np.split(place, [len(a), len(a) + len(b)])
    v = len(words)
    pair, pair_of = np.unique(np.repeat(a, per_word) * v + b, return_inverse=True)
    gram, gram_of = np.unique(np.repeat(pair_of, per_pair) * v + c, return_inverse=True)
    count = np.bincount(gram_of, n, len(gram)).astype(np.int64)
    seen = count > 0
    of = pair[gram[seen] // v]
    trie = _mapped_trie(build(words, of // v, of % v, gram[seen] % v, count[seen]), known.folder)
    word = trie.word(words)  # look-ups of each distinct word, pair and trigram once
    node = trie.pair(word[pair // v], word[pair % v])
    leaf = trie.trigram(node[gram // v], word[pair[gram // v] % v], word[gram % v])
    p2, left2, p3 = trie.codes("p2", node), trie.codes("left2", node, 0), trie.codes("p3", leaf)
    followed, kinds = trie.counts(word)
    ends = np.cumsum([[0, 0, 0], *sizes], axis=0)
    out = []
    for (i, j, k), (i2, j2, k2) in zip(ends, ends[1:]):
        out.append([packed(p3[gram_of[k:k2]]), packed(p2[pair_of[j:j2]]), packed(left2[pair_of[j:j2]]), packed(followed[a[i:i2]]), packed(kinds[a[i:i2]])])
    first = np.unique(a)
    first = first[followed[first] > 0]
    return out, {"key": words[first], "followed": followed[first], "kinds": kinds[first]}


def answered(parts: DataFrame, known: Figures) -> DataFrame:
    """Stored: the ranges' answers (kind 1), and of each range its number of known words that aren't split and the split words' parts (kind 3)."""
    start = known.key(np.array([START], np.uint64))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row["word"], row["code"], row["size"], known)
                yield _mail(1, [(row["chunk"], bucket, x) for bucket, x in c.requests()])

    def answer(batches):
        for bucket, rows in _groups(batches, "bucket"):
            out, own = range_answers([r["x"] for r in rows], known)
            yield _mail(1, [(r["chunk"], bucket, x) for r, x in zip(rows, out)])
            split = known.split_place(own["key"]) >= 0
            alone = int((~split & (own["key"] != start)).sum())
            yield _mail(3, [(-1, bucket, [packed(np.array([alone])), *(packed(own[k][split]) for k in ("key", "followed", "kinds"))])])

    asked = parts.select("chunk", "word", "code", "size").mapInArrow(ask, _MAIL)
    path = new_table(parts.sparkSession, "answers")
    asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answer, _MAIL).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return parts.sparkSession.read.schema(_MAIL).parquet(path)


def totals(answers: DataFrame, known: Figures) -> None:
    """Adds to `known` the number of known words and the split words' counts."""

    def run(batches):
        for batch in batches:
            for x in batch.column("x").to_pylist():
                word, followed, kinds = (opened(y) for y in x[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(word, -1)), pa.array(np.append(followed, opened(x[0]))), pa.array(np.append(kinds, 0))], ["word", "n", "kinds"])

    found = answers.where("kind = 3").select("x").mapInArrow(run, "word long, n long, kinds long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    rows = {r["word"]: (r["n"], r["kinds"]) for r in found.collect()}  # the split words
    known.distinct = rows.pop(-1, (0, 0))[0] + len(rows)
    known.distinct -= int(known.key(np.array([START], np.uint64))[0]) in rows
    known.counts = np.array([rows.get(int(k), (0, 0)) for k in known.split], np.int64).reshape(-1, 2).T


def score(docs: DataFrame, *, training: Column, text: str = "text", key: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`, learned from rows where `training` holds.

    A null or empty text is the end token alone; a very long text is a chunk of its own. Rows alike in key and text are scored alike; an empty
    table gives no rows; other columns are not carried, so none can clash. Without training texts every symbol is equally likely.
    """
    if order != ORDER:
        raise ValueError(f"the model counts n-grams of {ORDER} words")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = gather(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), t.alias("t"), F.coalesce(training, F.lit(False)).alias("train")))
    known = figures(parts)
    answers = answered(parts, known)
    totals(answers, known)
    own = parts.select(F.lit(0).alias("kind"), "chunk", F.lit(-1).cast("long").alias("bucket"), F.array("word", "code", "size").alias("x"), "doc_ids")
    mail = own.unionByName(answers.where("kind = 1"), allowMissingColumns=True)

    def run(batches):
        for _, rows in _groups(batches, "chunk"):
            c = Chunk(*rows[0]["x"], known)
            found, single, sums = c.scores([r["x"] for r in rows[1:]], known)
            columns = [pa.array(rows[0]["doc_ids"], pa.int64()), pa.array(c.train), pa.array(c.size + 1), pa.array(found.astype(np.int64)), pa.array([known.total] * len(c.size), pa.int64()), pa.array(single), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return mail.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(run, _SCORED)
