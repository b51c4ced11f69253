"""Token ids as length-limited canonical Huffman blocks, and their table-driven decoding.

A written table has two Parquet parts: `code` (one row: the code length of each id, which fixes the canonical code) and
`blocks`. A block holds whole documents in ascending doc_id order, about `BLOCK_IDS` ids (one longer document is a
block of its own), and stands alone: its ids' bits, and the bit offset of every `STEP`-th id, from which decoding can start.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from citegrain.llm.common import chunks, give_back, new_table, stored
from citegrain.llm.tokens import encoder

#: Longest code in bits; the decoding table has 2**LONGEST entries.
LONGEST = 16
BLOCK_IDS = 1 << 16
STEP = 256
#: Documents of a range of doc_ids, and the most ranges there are (a bound on what the driver holds).
RANGE_DOCS, RANGES = 3000, 20_000
#: Documents whose ids are counted at once.
TOGETHER = 64

_ENCODED = "part long, doc_id long, n_tokens long, ids binary"
_BLOCK = "part long, block int, start long, doc_ids array<long>, lengths array<long>, marks binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; ids that never occur get 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    kinds, packages = [], np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        kinds.append(order < len(leaves))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(kinds):  # the cheapest leaves and packages of each level, from the last one down
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter codes first, equal lengths by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        span = 1 << (LONGEST - size)
        codes[order] = ((np.cumsum(span) - span) >> (LONGEST - size)).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, first bit highest, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    if len(ids) and not size.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    window = codes[ids].astype(np.int64) << (24 - (starts & 7) - size)  # at most 16 + 7 bits
    out = np.zeros((total + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount((starts >> 3) + k, weights=(window >> (16 - 8 * k)) & 255, minlength=len(out))
    return out[: (total + 7) // 8].astype(np.uint8).tobytes(), starts[::STEP].astype(np.uint64)


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LONGEST bits: the id that they begin with, and its code length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (LONGEST - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LONGEST, np.uint32), np.zeros(1 << LONGEST, np.int64)
    n = int(span.sum())
    ids[:n], size[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Ids of some blocks (bits, marks, number of ids): all stretches between marks are decoded side by side."""
    data = np.frombuffer(b"".join([*(b for b, _, _ in blocks), bytes(4)]), np.uint8).astype(np.uint32)
    base = np.cumsum([0, *(len(b) for b, _, _ in blocks)])
    at = np.concatenate([m.astype(np.int64) + 8 * base[i] for i, (_, m, _) in enumerate(blocks)] or [np.zeros(0, np.int64)])
    left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(len(m))) for _, m, n in blocks] or [np.zeros(0, np.int64)])
    out = np.zeros((len(at), STEP), np.uint32)
    order = np.argsort(-left, kind="stable")  # live stretches stay in front
    at, live = at[order], left[order]
    for k in range(int(live[0]) if len(live) else 0):
        n = int(np.searchsorted(-live, -k))  # those with more than k ids
        p = at[:n]
        b = p >> 3
        word = (data[b] << 16 | data[b + 1] << 8 | data[b + 2]) >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF
        out[order[:n], k] = first[word]
        at[:n] = p + size[word]
    found, row = [], 0
    for _, m, n in blocks:
        found.append(out[row : row + len(m)].ravel()[:n])
        row += len(m)
    return found


#: Parts that one repeated doc_id is dealt to, at most.
SPLIT = 1 << 20


def ranges(docs: DataFrame) -> tuple[np.ndarray, dict[int | None, int]]:
    """Bounds of ranges of doc_ids, and the doc_ids (null too) that fill whole ranges, with how many: each of these is a range of its own."""
    n, none = docs.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    parts = min(RANGES, max(24, n // RANGE_DOCS))
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    heavy: dict[int | None, int] = {int(v): min(SPLIT, int(t)) for v, t in zip(values, times) if t > 1}
    bounds = np.unique(np.concatenate([values, np.array([k + 1 for k in heavy if k < 2**63 - 1], np.int64)]))
    if none:
        heavy[None] = int(min(SPLIT, max(1, none * parts // n)))
    return bounds, heavy


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, doc_id, n_tokens, ids) of every document, written once; `part` orders ranges of doc_ids, and documents of a doc_id
    that fills several ranges by a hash of their ids."""
    bounds, heavy = ranges(docs)

    def parts_of(keys: list[int | None], ids: list[bytes]) -> list[int]:
        at = 1 + np.searchsorted(bounds, np.array([0 if k is None else k for k in keys], np.int64), "right")
        return [(0 if k is None else a) * SPLIT + (xxhash.xxh3_64_intdigest(x) % heavy[k] if k in heavy else 0) for k, a, x in zip(keys, at.tolist(), ids)]

    def run(batches):
        tool = encoder(tokenizer)
        kind = f"<u{tool.width}"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for texts in chunks(x.as_py() for x in batch.column("text")):
                ids = [x + end for x in tool.ids(texts)]
                own = keys.slice(at, len(texts))
                at += len(texts)
                part = parts_of(own.to_pylist(), ids)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), own.cast(pa.int64()), pa.array([len(x) // tool.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "n_tokens", "ids"])
        give_back()

    return stored(docs.select("doc_id", "text").mapInArrow(run, _ENCODED), "ids")


def counted(held: list[bytes], size: int, width: int) -> np.ndarray:
    """Occurrences of each id in some documents. They are counted together, `TOGETHER` at a time: each count fills a row as long as the vocabulary."""
    total = np.zeros(size, np.int64)
    for i in range(0, len(held), TOGETHER):
        total += np.bincount(np.frombuffer(b"".join(held[i : i + TOGETHER]), f"<u{width}"), minlength=size)
    return total


def id_counts(encoded: DataFrame, size: int, width: int) -> np.ndarray:
    """Occurrences of each id over all documents; every task sends one row for each id that it has seen."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 16 * TOGETHER):  # a batch of long documents isn't held twice
                total += counted(batch.column("ids").slice(i, 16 * TOGETHER).to_pylist(), size, width)
        give_back()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Writes every document's ids, and `end_id` after each, as Huffman blocks in ascending doc_id order (nulls first; equal doc_ids by
    length and ids, and those that fill several ranges by a hash of the ids first). A null or empty text gives the end id alone, a very
    long one is a block of its own; repeated rows are written each; an empty table gives no blocks; other columns are not read."""
    spark = docs.sparkSession
    tool = encoder(tokenizer)
    size, width = max(tool.vocabulary, end_id + 1), tool.width
    encoded = encode(docs, tokenizer, end_id)
    lengths = code_lengths(id_counts(encoded, size, width))
    totals = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # some RANGES at most
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    codes = canonical(lengths)

    def run(batches):
        part, number, start, keys, held, count = None, 0, 0, [], [], 0

        def block():
            ids = np.concatenate([np.frombuffer(x, f"<u{width}") for x in held])
            bits, marks = pack(ids, codes, lengths)
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "start": start, "doc_ids": keys, "lengths": [len(x) // width for x in held], "marks": marks.tobytes(), "bits": bits}], schema)

        schema = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("marks", pa.binary()), ("bits", pa.binary())])
        for batch in batches:
            for p, key, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if held and (p != part or count >= BLOCK_IDS):
                    yield block()
                    number, start, keys, held, count = number + 1, start + count, [], [], 0
                if p != part:
                    part, number, start = p, 0, starts[p]
                keys.append(key)
                held.append(ids.as_py())
                count += len(held[-1]) // width
        if held:
            yield block()

    n = max(1, min(len(totals), 2 * RANGES))
    ordered = encoded.repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", "ids")
    ordered.select("part", "doc_id", "ids").mapInArrow(run, _BLOCK).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): decoded ids of each document as little-endian unsigned 32-bit integers."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/code").first()[0], np.uint8)

    def run(batches):
        first, size = table(lengths)
        for batch in batches:
            rows = list(zip(*(batch.column(c) for c in ("start", "doc_ids", "lengths", "marks", "bits"))))
            for i in range(0, len(rows), 16):
                some = rows[i : i + 16]
                sizes = [np.array(r[2].as_py(), np.int64) for r in some]
                decoded = unpack([(r[4].as_py(), np.frombuffer(r[3].as_buffer(), np.uint64), int(n.sum())) for r, n in zip(some, sizes)], first, size)
                keys = [k for r in some for k in r[1].as_py()]
                begin = np.concatenate([r[0].as_py() + np.cumsum(n) - n for r, n in zip(some, sizes)])
                ids = [x.tobytes() for n, d in zip(sizes, decoded) for x in np.split(d, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begin, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "marks", "bits").mapInArrow(run, "doc_id long, start long, ids binary")


@F.pandas_udf(LongType())
def crc32_of(ids: pd.Series) -> pd.Series:
    """Unsigned crc32 of the bytes."""
    return ids.map(zlib.crc32).astype("int64")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes `docs` and reads them back: (doc_id, start, ids)."""
    path = new_table(docs.sparkSession, "huffman")
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path)
