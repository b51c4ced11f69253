"""A compact trigram trie in flat arrays that are mapped into memory, not loaded.

A node of level 1 is a word, of level 2 a pair, of level 3 a trigram; a node's children lie side by side on the next level. Pointers to
the first child are monotone and kept as Elias-Fano, as are the running totals of the words' counts. A level-3 node keeps its word as
the rank among the successors of the word before it, a smaller number than the word's own: a look-up finds the successor's rank in
that context first, then the rank among the children, both by successor search. Nodes keep quantised smoothed probabilities
of one byte: what Witten-Bell smoothing gives the symbol itself, and the share that its context leaves to shorter contexts.
"""

from __future__ import annotations

import json

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the r-th set bit (lowest first) of each byte.
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)
#: Code of no probability; the others stand for 1 down to 10**-DEEPEST, finer for the greater ones.
NONE, DEEPEST = 255, 12.0
VALUES = np.append(10.0 ** (-DEEPEST * (np.arange(NONE) / (NONE - 1)) ** 2), 0.0)


def coded(p: np.ndarray) -> np.ndarray:
    """Codes of one byte of probabilities."""
    out = np.full(len(p), NONE, np.uint8)
    some = p > 0
    out[some] = np.minimum(np.rint((NONE - 1) * np.sqrt(np.maximum(-np.log10(p[some]), 0) / DEEPEST)), NONE - 1)
    return out


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence as low bits in full and high bits in unary, with the ones before each 64 bits."""
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    low = max(0, (top // max(1, n)).bit_length() - 1)
    bits = np.zeros((n * low + 7) // 8 * 8, np.uint8)
    if low:
        bits[: n * low] = ((values[:, None] >> np.arange(low)) & 1).ravel()
    size = (n + (top >> low) + 64) // 64 * 64
    high = np.zeros(size, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    packed = np.packbits(high, bitorder="little")
    before = np.concatenate([[0], np.cumsum(_ONES[packed].reshape(-1, 8).sum(axis=1, dtype=np.int64))])[:-1]
    return {"low": np.concatenate([np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)]), "high": packed, "before": before.astype(np.uint32), "width": np.array([low])}


def ef_get(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """Values at the places i."""
    word = np.searchsorted(ef["before"], i, "right") - 1
    left, byte = i - ef["before"][word].astype(np.int64), word * 8
    for _ in range(7):  # to the byte that holds the bit
        ones = _ONES[ef["high"][byte]]
        step = left >= ones
        left, byte = left - np.where(step, ones, 0), byte + step
    place = byte * 8 + _PLACE[ef["high"][byte], left]
    width = int(ef["width"][0])
    if not width:
        return place - i
    at, low = i * width, np.zeros(len(i), np.int64)
    for k in range((width + 14) // 8):
        low |= ef["low"][(at >> 3) + k].astype(np.int64) << (8 * k)
    return (place - i) << width | ((low >> (at & 7)) & ((1 << width) - 1))


def successor(values: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each search the place of the first of values[low:high] that is not below `want`; `high` if none is."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = values[mid] < want[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    return low


def build(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The trie of distinct trigrams of places in `words` (sorted keys), in order, and of their counts, all above zero.

    Shares of a word's pairs are of the counts in this trie alone.
    """
    v = len(words)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    pair = np.cumsum(new) - 1
    first_of = np.searchsorted(a[first], np.arange(v + 1))
    total, kinds = np.bincount(a, n, v).astype(np.int64), np.diff(first_of)
    own = np.add.reduceat(n, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    after = np.diff(np.append(first, len(a)))
    follow, rank = np.unique(b * v + c, return_inverse=True)
    follows = np.searchsorted(follow, np.arange(v + 1) * v)
    out = {
        "words": words, "pair": b[first].astype(np.uint32), "follow": (follow % max(1, v)).astype(np.uint32), "rank": (rank - follows[b]).astype(np.uint32),
        "p2": coded(own / (total + kinds)[a[first]]), "left2": coded(after / (own + after)), "p3": coded(n / (own + after)[pair]),
    }
    if not len(out["rank"]) or out["rank"].max() < 1 << 16:
        out["rank"] = out["rank"].astype(np.uint16)
    for name, x in (("total", np.append(0, np.cumsum(total))), ("pairs", first_of), ("trigrams", np.append(first, len(a))), ("follows", follows)):
        out |= {f"{name}.{k}": y for k, y in elias_fano(x).items()}
    return out


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the names, kinds and places of the arrays, then the arrays."""
    head, at = [], 0
    for name, x in arrays.items():
        head.append([name, x.dtype.str, list(x.shape), at])
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.write(bytes(-(8 + len(text)) % 64))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 64))


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a saved file, as views of the mapping."""
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    base = -(-(8 + n) // 64) * 64
    sized = ((name, np.dtype(kind), shape, base + at) for name, kind, shape, at in json.loads(data[8 : 8 + n].tobytes()))
    return {name: np.asarray(data[at : at + kind.itemsize * int(np.prod(shape))]).view(kind).reshape(shape) for name, kind, shape, at in sized}


class Trie:
    """Look-ups, many at a time, in the arrays of build()."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.ef = {name: {k: arrays[f"{name}.{k}"] for k in ("low", "high", "before", "width")} for name in ("total", "pairs", "trigrams", "follows")}

    def _span(self, name: str, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ef_get(self.ef[name], i), ef_get(self.ef[name], i + 1)

    def word(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of words; -1 for others."""
        at = np.searchsorted(self.a["words"], keys)
        hit = at < len(self.a["words"])
        hit[hit] = self.a["words"][at[hit]] == keys[hit]
        return np.where(hit, at, -1)

    def counts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word was followed, and by how many others."""
        out = np.zeros((2, len(word)), np.int64)
        live = word >= 0
        for k, name in enumerate(("total", "pairs")):
            low, high = self._span(name, word[live])
            out[k, live] = high - low
        return out[0], out[1]

    def _child(self, name: str, level: str, node: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The child `want` of each node, whose children lie in `level` where the pointers `name` say; -1 without one."""
        out = np.full(len(node), -1)
        live = np.flatnonzero((node >= 0) & (want >= 0))
        low, high = self._span(name, node[live])
        at = successor(self.a[level], low, high, want[live])
        hit = np.flatnonzero(at < high)
        hit = hit[self.a[level][at[hit]] == want[live[hit]]]
        out[live[hit]] = at[hit]
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._child("pairs", "pair", a, b)

    def trigram(self, pair: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Trigram nodes of pairs that end in b, by the rank of c among b's successors."""
        place = self._child("follows", "follow", b, c)
        begin = ef_get(self.ef["follows"], np.maximum(b, 0)) if len(b) else b
        return self._child("trigrams", "rank", pair, np.where(place >= 0, place - begin, -1))

    def codes(self, name: str, node: np.ndarray, none: int = NONE) -> np.ndarray:
        """Codes of nodes; `none` for -1."""
        out = np.full(len(node), none, np.uint8)
        out[node >= 0] = self.a[name][node[node >= 0]]
        return out
