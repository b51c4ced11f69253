"""Best-fit packing of token sequences by minimum bin slack.

Every document is one item of 1 to `size` tokens (its first piece, the rest after whole pieces) and whole pieces that fill a
sequence each. Items of one length are alike, so the packing is worked out on the histogram of lengths: per bin, a
bitset subset-sum over the lengths at hand finds the fullest combination with the longest item left, and the combination is
used as often as its items last. The histogram has `size` numbers whatever the corpus; items then find their place by rank.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrain.llm.common import chunks, stored
from citegrain.llm.tokens import encoder

SIZE = 2048
#: Tasks whose first ranks (16 kB each) are sent to all tasks; more are joined by shuffle.
BROADCAST_TASKS = 2048
#: Sequence numbers of whole pieces: above the bins', one range for each writing task.
_TASK = 1 << 40


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many of each length (`lengths` descending) fill `room` best; long items are preferred."""
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for length in lengths:
        if length > room or not counts[length]:
            continue
        most, part = min(counts[length], room // length), 1
        while most:  # counts in powers of two
            n = min(part, most)
            steps.append((length, n, reach))
            reach |= (reach << (n * length)) & mask
            most, part = most - n, part * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= n * length
    return used


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[int, dict[int, list[tuple[int, int, int, int]]]]:
    """Number of bins, and for each length its segments (first rank, first bin, items a bin, offset)."""
    left = {k: n for k, n in histogram.items() if n}
    order = sorted(left, reverse=True)
    taken = dict.fromkeys(left, 0)
    segments: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in left}
    bins = 0
    while order:
        top = order[0]
        left[top] -= 1
        used = fullest(size - top, order, left)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times, offset = min(left[k] // n for k, n in used.items()), 0
        for k in sorted(used, reverse=True):
            n = used[k]
            segments[k].append((taken[k], bins, n, offset))
            taken[k] += times * n
            left[k] -= times * n
            offset += n * k
        bins += times
        order = [k for k in order if left[k]]
    return bins, segments


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids (unsigned 32-bit little-endian), sequence_id, offset.

    A null or empty text is the end id alone; a very long one is cut into whole pieces and a first one; repeated rows, of null ids
    too, are packed each; an empty table gives no pieces; other columns are not read, so none can clash. Items of one length are alike: ties
    are settled by the order of tasks and rows.
    """
    width = encoder(tokenizer).width

    def encoded(batches):
        from pyspark import TaskContext

        tool, task = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        ranks, whole = [0] * (size + 1), 0
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for texts in chunks(x.as_py() for x in batch.column("text")):
                ids = [x + end for x in tool.ids(texts)]
                own = keys.slice(at, len(texts))
                at += len(texts)
                first, rank, full = [], [], []
                for x in ids:
                    n = len(x) // width
                    item = (n - 1) % size + 1
                    first.append(item)
                    rank.append(ranks[item])
                    full.append(whole)
                    ranks[item] += 1
                    whole += (n - item) // size
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int64()), own.cast(pa.int64()), pa.array(first, pa.int32()), pa.array(rank, pa.int64()), pa.array(full, pa.int64()), pa.array(ids, pa.binary())], ["task", "doc_id", "item", "rank", "whole", "ids"])

    table = stored(docs.select("doc_id", "text").mapInArrow(encoded, "task long, doc_id long, item int, rank long, whole long, ids binary"), "pieces")
    counts = stored(table.groupBy("item", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["item"]: r["n"] for r in counts.groupBy("item").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    bins, segments = plan(histogram, size)
    firsts = {k: [s[0] for s in v] for k, v in segments.items()}
    before = counts.select("item", "task", (F.sum("n").over(Window.partitionBy("item").orderBy("task")) - F.col("n")).alias("before"))
    tasks = [r[0] for r in counts.select("task").distinct().limit(BROADCAST_TASKS + 1).collect()]
    sent = {t: np.zeros(size + 1, np.int64) for t in tasks} if len(tasks) <= BROADCAST_TASKS else None
    if sent is None:
        table = table.join(before, ["item", "task"])
    else:
        for r in before.groupBy("task").agg(F.collect_list("item").alias("item"), F.collect_list("before").alias("before")).toLocalIterator():  # `size` items each
            sent[r["task"]][r["item"]] = r["before"]
        table = table.withColumn("before", F.lit(0).cast("long"))

    def placed(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("task", "doc_id", "item", "rank", "whole", "before")), batch.column("ids")))
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for task, key, item, rank, whole, ahead, ids in rows:
                ids = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                at = rank + (ahead if sent is None else int(sent[task][item]))
                first, bin0, n, offset = segments[item][bisect_right(firsts[item], at) - 1]
                k, slot = divmod(at - first, n)
                for p in range(1 + (len(ids) - item) // size):
                    start, length = (0, item) if not p else (item + (p - 1) * size, size)
                    place = (bin0 + k, offset + slot * item) if not p else (bins + task * _TASK + whole + p - 1, 0)
                    for to, value in zip(out, (key, p, start, length, ids[start : start + length].tobytes(), *place)):
                        to.append(value)
                held += len(ids)
                if held > 1 << 20:
                    yield batch_of(out)
                    out, held = [[] for _ in range(7)], 0
            yield batch_of(out)

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    return table.select("task", "doc_id", "item", "rank", "whole", "before", "ids").mapInArrow(placed, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
