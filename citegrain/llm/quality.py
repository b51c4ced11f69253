"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk.

Trusted positives and unlabelled texts give the risk  prior * R(positives, 1) + max(0, R(unlabelled, 0) - prior * R(positives, 0)),
minimised for an additive logistic model over style measures, binned and as they are. Where the bracket turns negative, the step goes back on it.
The class prior, the share of good texts among the unlabelled, is estimated from both samples: where a classifier of positives against
unlabelled ranks texts best, the unlabelled are as frequent as their positives are, so the least ratio of the two tails bounds the
prior, taken where its confidence bound is least. Negative labels are not used, but to drop positives that are contradicted. Fitting
takes bounded samples (`MAX_ROWS`); scoring takes every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from citegrain.llm.common import row_chance

#: Rows of each sample, about: positives and unlabelled. The driver holds their measures only.
MAX_ROWS = 20_000
STEPS, RATE, DECAY = 600, 0.05, 3e-5
#: Chance that the confidence bound of the prior is off.
DOUBT = 0.1
#: Shares of texts between the bins of a measure, finer at its ends.
CUTS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.94, 0.97, 0.99)
BINS = len(CUTS) + 1
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_STOPS, _MARKS = b".,;:?!'\"()-", b"#*$%&|<>@=+/\\_~^`{}[]"


def measures(text: str | None) -> list[float]:
    """Style of a text: sizes and shares; null as empty."""
    raw = (text or "").encode("utf-8", "replace")
    w = raw.split()
    n, size = max(1, len(w)), max(1, sum(map(len, w)))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper, marks = count(_UPPER), count(_MARKS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(w)), size / n, upper / size, upper / max(1, upper + count(_LOWER)), count(_DIGIT) / size, count(_STOPS) / size, marks / size, marks / n,
        raw.count(b"!") / n, raw.count(b"|") / n, sum(map(eq, w, w[1:])) / n, len(set(w)) / n, len(set(zip(w, w[1:], w[2:]))) / max(1, len(w) - 2),
        1 - len(set(lines)) / m, np.log1p(size / m), sum(len(x) <= 3 for x in w) / n,
    ]


@dataclass
class Model:
    edges: np.ndarray  # measures x (BINS - 1)
    weights: np.ndarray  # measures x BINS, then a slope for each measure, and the bias last
    prior: float
    centre: np.ndarray  # of the measures, and their spread
    spread: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Positions of the weights that each row adds up."""
        at = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        return at + np.arange(len(self.edges)) * BINS

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -3, 3)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        k = len(self.edges)
        z = self.weights[self.bins(x)].sum(axis=1) + self.standard(x) @ self.weights[-k - 1 : -1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, plain: bool = False, steps: int = STEPS) -> Model:
    """Adam on the non-negative risk; without positives every text scores the prior. plain: on the risk of telling the two samples apart."""
    k = unlabelled.shape[1]
    edges = np.quantile(unlabelled, CUTS, axis=0).T
    spread = unlabelled.std(axis=0)
    size = k * BINS + k + 1
    model = Model(edges, np.zeros(size), prior, unlabelled.mean(axis=0), np.where(spread > 0, spread, 1.0))
    if not len(positive):
        model.weights[-1] = np.log(prior / (1 - prior))
        return model
    p, u = ((model.bins(x), model.standard(x)) for x in (positive, unlabelled))
    w, m, v = model.weights, np.zeros(size), np.zeros(size)

    def gradient(rows: tuple[np.ndarray, np.ndarray], target: int) -> tuple[float, np.ndarray]:
        at, x = rows
        z = w[at].sum(axis=1) + x @ w[-k - 1 : -1] + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = (s - target) / len(at)
        g = np.bincount(at.ravel(), np.repeat(d, k), minlength=len(w))
        g[-k - 1 : -1] = x.T @ d
        g[-1] = d.sum()
        return float(np.logaddexp(0, -z if target else z).mean()), g

    for step in range(1, steps + 1):
        _, gp = gradient(p, 1)
        rn, gn = gradient(p, 0)
        ru, gu = gradient(u, 0)
        if plain:
            g = (gp + gu) / 2
        else:
            g = prior * gp + gu - prior * gn if ru - prior * rn >= 0 else prior * gn - gu
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among the unlabelled, by scores of halves that a classifier of the other halves hasn't seen; 0.5
    with too few rows of either kind."""
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    p, u = (x[np.random.default_rng(seed).permutation(len(x))] for x in (positive, unlabelled))
    model = fit(p[::2], u[::2], 0.5, plain=True, steps=STEPS // 2)
    sp, su = np.sort(model.score(p[1::2])), np.sort(model.score(u[1::2]))
    cuts = np.unique(sp)
    tail_p, tail_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (sp, su))
    slack = sum(np.sqrt(np.log(4 / DOUBT) / (2 * len(x))) for x in (sp, su))
    at = int(((tail_u + slack) / tail_p).argmin())
    return float(np.clip(tail_u[at] / tail_p[at], 0.01, 0.99))


@F.pandas_udf(ArrayType(DoubleType()))
def _measured(texts: pd.Series) -> pd.Series:
    return pd.Series([measures(x) for x in texts])


def _some(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About `rows` rows, each drawn on its own: a key that fills the table doesn't come in or stay out as a whole."""
    n = df.count()
    return df.where(row_chance(seed, *df.columns) < rows / n) if n > rows else df


def train(docs: DataFrame, labels: DataFrame, *, training: Column, label: str = "quality", text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """A model from the rows where `training` (an expression of the key) holds; a document labelled both ways counts as
    negative. Labels without a document, null labels and null keys teach nothing; repeated rows teach as often; empty tables give a
    model that scores every text alike. Only the named columns are read, so others can't clash."""
    known = labels.where(training & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    good = known.where("label = 1").select(key)
    chosen = good.where(F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 11) < F.lit(int((1 << 53) * min(1, max_rows / max(1, good.count())))))  # bounded by max_rows
    texts = docs.select(key, F.col(f"`{text}`").alias("t")).where(training)
    get = lambda df: np.array([r[0] for r in df.select(_measured("t")).collect()], float).reshape(-1, len(measures("")))
    positive = get(_some(texts.join(F.broadcast(chosen), key), max_rows, 13))  # repeated keys have more rows
    unlabelled = get(_some(texts, max_rows, 12))
    unlabelled = unlabelled if len(unlabelled) else np.zeros((1, len(measures(""))))
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a whole text, however long; null as empty. Equal texts score alike."""

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([measures(x) for x in texts], float)), dtype=float)

    return run(text)
