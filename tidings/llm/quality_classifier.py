"""Quality scores by Bradley-Terry ranking of text features.

A labelled good text is preferred to a labelled poor one. The probability that text ``a`` is preferred
to ``b`` is ``sigmoid(w . (x_a - x_b))``; ``w`` minimises the logistic loss over preference pairs. A
text's rank is ``w . x``; a quantile of the training ranks, the one with the fewest mistakes, becomes
the threshold, and scores are shifted so that this threshold scores ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import CONTINUATION, SPACE_BYTES, as_bytes, given_back, shipped, unpacked
from tidings.llm.quality_rules import duplicate_lines, repeated_words, word_hashes, word_memory

#: Most labelled rows that a model is learnt from, taken by the lowest hashes of their ids.
TRAINING_ROWS = 20_000
#: Opponents of a text of the rarer label.
OPPONENTS = 16
PENALTY = 1e-3
#: The score of a text at the threshold.
CUT = 0.3
FEATURES = (
    "symbols", "bars", "exclamations", "capitals", "digits", "signs", "next_same", "top_word",
    "variety", "window_repeats", "line_repeats", "word_length", "log_words", "few_words",
)
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def _share(text: bytes, chars: bytes, of: int) -> float:
    return (len(text) - len(text.translate(None, chars))) / of


def features(text: bytes) -> list[float]:
    """Shares and lengths of a whole text, in the order of ``FEATURES``; all finite, also for empty texts."""
    words = text.split()
    n = max(len(words), 1)
    chars = max(len(text.translate(None, SPACE_BYTES + CONTINUATION)), 1)
    letters = max(len(text) - len(text.translate(None, _LETTERS)), 1)
    h = word_hashes(words)
    seen = np.unique(h, return_counts=True)[1]
    same = int((h[1:] == h[:-1]).sum())
    return [
        _share(text, b"#*$%&<>", chars),
        _share(text, b"|", chars),
        _share(text, b"!", chars),
        _share(text, _UPPER, letters),
        _share(text, _DIGITS, chars),
        1 - _share(text, _LETTERS + _DIGITS + SPACE_BYTES, max(len(text), 1)),
        same / n,
        int(seen.max(initial=0)) / (n + 20),
        (len(seen) + 20) / (n + 20),
        repeated_words(h) / n,
        duplicate_lines(text) / (text.count(b"\n") + 5),
        min(chars / n, 40.0),
        float(np.log1p(len(words))),
        float(len(words) < 20),
    ]


def feature_rows(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in as_bytes(texts)]).reshape(-1, len(FEATURES))


@dataclass(frozen=True)
class Ranking:
    """Weights over scaled features and the rank of the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def ranks(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        shifted = self.ranks(rows) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -500, 500)))


def fit_pairs(differences: np.ndarray, penalty: float = PENALTY, steps: int = 50) -> np.ndarray:
    """Weights of least logistic loss over feature differences (preferred minus other), by Newton steps."""
    n, d = differences.shape
    w = np.zeros(d)

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -differences @ v).mean() + penalty * v @ v / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -500, 500)))
        gradient = penalty * w - differences.T @ p / n
        hessian = (differences * (p * (1 - p))[:, None]).T @ differences / n + penalty * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        rate, now = 1.0, loss(w)
        while loss(w - rate * step) > now and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(gradient).max() < 1e-9:
            break
    return w


def best_quantile(ranks: np.ndarray, good: np.ndarray) -> float:
    """The rank at the quantile that parts good from poor texts with the fewest mistakes."""
    order = np.argsort(ranks, kind="stable")
    ranks, good = ranks[order], good[order]
    mistakes = np.r_[0, np.cumsum(good)] + np.r_[(~good).sum(), (~good).sum() - np.cumsum(~good)]
    cuttable = np.r_[True, np.diff(ranks) > 0, True]
    k = int(np.flatnonzero(cuttable & (mistakes == mistakes[cuttable].min()))[0])
    if k in (0, len(ranks)):
        return float(ranks[0] - 1 if k == 0 else ranks[-1] + 1)
    return float((ranks[k - 1] + ranks[k]) / 2)


def fit_ranking(rows: np.ndarray, good: np.ndarray, opponents: int = OPPONENTS, seed: int = 7) -> Ranking:
    """Learn a ranking from feature rows and their labels.

    With one label only, or no rows at all, every text ranks alike and passes.
    """
    width = len(FEATURES)
    if good.all() or not good.any():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    scaled = np.clip((rows - mean) / scale, -6, 6)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.default_rng(seed)
    few = min(len(better), len(worse))
    pairs = max(few * opponents, len(rows))
    a = np.r_[np.resize(better, pairs), rng.choice(better, pairs)]
    b = np.r_[rng.choice(worse, pairs), np.resize(worse, pairs)]
    weights = fit_pairs(scaled[a] - scaled[b])
    return Ranking(mean, scale, weights, best_quantile(scaled @ weights, good))


def is_held_out(doc_id: Column) -> Column:
    """Whether a document must not be learnt from: CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_ranking(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS
) -> Ranking:
    """Learn a ranking from at most ``rows`` labelled documents that are not held out.

    Labels without an id or a quality are left out; of several labels for an id the lowest counts. The
    sample is the rows with the lowest hashes of their ids, so it does not depend on the layout.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    taught = usable.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # At most ``rows`` ids and labels, whatever the size of the tables.
    picked = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id")

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        return pa.array(list(feature_rows(text)), pa.list_(pa.float64()))

    taken = sample.select("doc_id", "quality", measured("text").alias("x")).toPandas()
    taken = taken.sort_values("doc_id", kind="stable")
    x = np.array(taken["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T[::-1])  # rows of one id may come in any order
    return fit_ranking(x[order], taken["quality"].to_numpy()[order] > 0)


def quality_score(text: Column, ranking: Broadcast) -> Column:
    """Score of a text column, from 0 to 1; a null text counts as empty."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = unpacked(ranking)
        for batch in given_back(batches, word_memory()):
            yield pa.array(known.scores(feature_rows(batch)), pa.float64())

    return scored(text)


def classify(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and verdict of every row, in one pass without a shuffle.

    Only the text is an input of the score. Null and empty texts are scored as empty; null ids count as
    not held out; repeated rows are scored each; an empty table gives an empty result.
    """
    model = shipped(docs.sparkSession, ranking)
    score = quality_score(F.col(text_col), model)
    scored = docs.select(F.col(id_col), is_held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def good_rows(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows whose text the ranking accepts, with all columns, without a shuffle."""
    model = shipped(docs.sparkSession, ranking)
    return docs.where(quality_score(F.col(text_col), model) >= CUT)
