"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language over its frequent byte n-grams, stored bit-sliced: slot i holds the mask of languages
whose filter has bit i set, so one look at K slots returns all languages that hold an n-gram. A text's hits for each language are
its masks' popcounts, corrected by the filter's rate of false positives; the greatest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import chunks, row_chance

SIZES = (3, 4)
HASHES = 3
#: Least share of a language's n-grams of one size that puts an n-gram into its filter: at most 1 / SHARE of them.
SHARE = 3e-5
#: Slots for each n-gram held.
SLOTS = 16
#: Documents that a language is learned from, about.
MAX_ROWS = 3000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the n-grams of all texts as integers, and the text of each. Letters only, words set off by blanks."""
    raw = [f" {x.lower()} ".encode("utf-8", "replace") for x in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])  # one blank for many
    data, owner = data[keep].astype(np.uint64), owner[keep]
    for n in SIZES:
        m = max(0, len(data) - n + 1)
        gram = np.full(m, n, np.uint64)
        for i in range(n):
            gram = gram << np.uint64(8) | data[i : m + i]
        whole = owner[:m] == owner[n - 1 : n - 1 + m]
        yield gram[whole], owner[:m][whole]


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # power of two x words of 64 languages
    false: np.ndarray  # rate of false positives of each language
    common: int  # decides where no n-gram does

    def positions(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        for k in _MIX[:HASHES]:
            yield ((gram + np.uint64(1)) * k) >> shift

    def hits(self, gram: np.ndarray) -> np.ndarray:
        at = [*self.positions(gram)]
        mask = self.slots[at[0]]
        for p in at[1:]:
            mask &= self.slots[p]
        return mask

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for gram, owner in grams(texts):
            mask = self.hits(gram)
            total += np.bincount(owner, minlength=len(texts))
            for j in range(len(self.languages)):
                bit = (mask[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                found[:, j] += np.bincount(owner[bit.astype(bool)], minlength=len(texts))
        share = found / np.maximum(total, 1)[:, None]
        share = (share - self.false) / (1 - self.false)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = np.where(share.max(axis=1) > 0, share.argmax(axis=1), self.common)
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        lettered = np.array([any(map(str.isalpha, x)) for x in texts], bool)
        return [self.languages[j] if ok else "und" for j, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def build(counts: pd.DataFrame) -> Model:
    """The filters from rows (lang, size, gram, n) of each language's frequent n-grams, and rows of size 0 with its documents."""
    docs = counts[counts["size"] == 0].set_index("lang")["n"]
    languages = sorted(docs.index)
    held = counts[counts["size"] > 0]
    most = max([1, *held.groupby("lang").size()])
    slots = np.zeros((1 << int(np.ceil(np.log2(SLOTS * most))), (len(languages) + 63) // 64 or 1), np.uint64)
    model = Model(languages, slots, np.zeros(len(languages)), languages.index(docs.idxmax()) if len(docs) else 0)
    for j, lang in enumerate(languages):
        own = held.loc[held["lang"] == lang, "gram"].to_numpy().astype(np.uint64)
        for p in model.positions(own):
            np.bitwise_or.at(slots[:, j // 64], p, np.uint64(1) << np.uint64(j % 64))
        model.false[j] = (((slots[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean()) ** HASHES
    return model


def train(docs: DataFrame, *, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Filters from about `max_rows` documents of each language, each drawn on its own (also among rows of one key) where `training`
    holds; null languages and texts teach nothing, repeated rows as often; an empty table gives a model that says `und`. Only the named
    columns are read, so others can't clash. The driver gets the n-grams of SHARE and more, at most 1 / SHARE a size."""
    df = docs.select(F.col(key).alias("k"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("t"), training.alias("use"))
    df = df.withColumn("chance", row_chance(5, "k", "t")).where("use AND lang IS NOT NULL")
    sizes = df.groupBy("lang").count().withColumnRenamed("count", "docs")
    some = df.join(F.broadcast(sizes), "lang") if sizes.count() <= 10_000 else df.join(sizes, "lang")
    some = some.where(F.col("chance") * F.col("docs") < F.lit(float(max_rows)))

    def run(batches):
        for pdf in batches:
            for name, own in pdf.groupby("lang"):
                for texts in chunks(own["t"]):
                    for n, (gram, _) in zip(SIZES, grams(texts)):
                        values, n_each = np.unique(gram.astype(np.int64), return_counts=True)
                        yield pd.DataFrame({"lang": name, "size": n, "gram": values, "n": n_each})
                yield pd.DataFrame({"lang": [name], "size": [0], "gram": [0], "n": [len(own)]})

    counts = some.select("lang", "t").mapInPandas(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, ["lang", "size"]).where(F.col("n") >= F.col("total") * F.lit(SHARE)).drop("total")
    return build(frequent.toPandas())


def predict(text: Column, model: Model) -> Column:
    """Struct (lang, score) of a whole text, however long; `und` and 0 without a letter or for null. Languages of equal shares: the
    first by name; a text none of whose n-grams is known has the commonest language and 0. Equal texts are judged alike."""

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(run) for run in chunks(texts)]
        return pd.DataFrame({"lang": [x for a, _ in found for x in a], "score": np.concatenate([b for _, b in found] or [np.zeros(0)])})

    return run(text)
