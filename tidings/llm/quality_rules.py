"""Quality rules: plain counts with fixed limits, then a hashed n-gram log-likelihood ratio.

Words and signs, and pairs of neighbours, are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets are counted over whole tables: trusted texts, and all texts. A text's ratio is the mean of
``log(trusted / all)`` over its n-grams; texts below ``THRESHOLD`` are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import CONTINUATION, SPACE_BYTES, as_bytes, given_back

BUCKETS = 1 << 16
#: Added to every bucket's count, as a share of the mean count.
SMOOTHING = 0.01
THRESHOLD = -0.3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: A run of letters and digits, or a run of signs.
GRAM = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\r\x0b\x0c]+")
#: Words whose hashes a task remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 100_000, 32
#: Trusted texts that are counted: those with the lowest hashes of their ids.
TRUSTED_ROWS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_hashes = WordHashes()


def word_memory() -> dict:
    """This task's memory of hashes, for ``given_back``."""
    return _hashes


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, through this task's memory."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_buckets(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of a text's single words and neighbouring pairs."""
    h = word_hashes(GRAM.findall(text))
    pairs = (h[:-1] * _MIX) ^ ((h[1:] << np.uint64(1)) | np.uint64(1))
    mixed = np.concatenate([h, pairs])
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words (given by their hashes) inside windows that stand in the text twice or more."""
    if len(h) <= window:
        return 0
    rolled = h[: len(h) - window + 1].copy()
    for k in range(1, window):
        rolled = rolled * _MIX + h[k : len(h) - window + 1 + k]
    _, back, n = np.unique(rolled, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[back] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated windows."""
    words = text.split()
    return (
        len(words),
        len(text.translate(None, SPACE_BYTES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(word_hashes(words)),
    )


def _counted(buckets: int):
    """Adds up bucket counts of a task's rows (text, trusted): one row per bucket met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in given_back(batches, word_memory()):
            for text, good in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(gram_buckets(text, buckets), minlength=buckets)
                raw += n
                if good:
                    trusted += n
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(raw[met]), pa.array(trusted[met])], names=["bucket", "raw", "trusted"]
        )

    return run


def log_ratios(docs: DataFrame, trusted: Column, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of trusted to all texts for every bucket; only bucket counts reach the driver."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
    counts = rows.mapInArrow(_counted(buckets), "bucket bigint, raw bigint, trusted bigint")
    total = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).toPandas()
    both = np.zeros((2, buckets))
    both[:, total["bucket"].to_numpy(np.int64)] = total.iloc[:, 1:].to_numpy(float).T
    both += SMOOTHING * both.mean(axis=1, keepdims=True) + 1e-9
    both /= both.sum(axis=1, keepdims=True)
    return np.log(both[1]) - np.log(both[0])


COUNTS = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,ratio:double>"
)


def rule_counts(text: Column, ratios: Broadcast) -> Column:
    """Base counts and the mean log ratio of a text column (0 for a text without words)."""

    @F.arrow_udf(COUNTS)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ratios.value
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in given_back(batches, word_memory()):
            rows, means = [], []
            for t in as_bytes(batch):
                rows.append(base_counts(t))
                own = table[gram_buckets(t, len(table))]
                means.append(float(own.mean()) if len(own) else 0.0)
            counts = np.array(rows, np.int64).reshape(-1, 5)
            arrays = [pa.array(counts[:, i]) for i in range(5)] + [pa.array(means, pa.float64())]
            yield pa.StructArray.from_arrays(arrays, names=[*names, "ratio"])

    return counted(text)


def apply_rules(
    docs: DataFrame,
    ratios: np.ndarray,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base counts, ratio and verdict of every row, in one pass without a shuffle.

    ``ratios`` has one number per bucket, whatever the table's size. A null or empty text has no words
    and fails; a text is kept if it passes the base limits and its ratio reaches ``threshold``. Null
    ids and repeated rows are kept as they are; other columns are not read; an empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    found = docs.select(F.col(id_col), rule_counts(F.col(text_col), sent).alias("c")).select(id_col, "c.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))


def trusted_ratios(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRUSTED_ROWS
) -> np.ndarray:
    """Log ratios with the texts labelled ``quality = 1`` as trusted ones.

    The trusted multinomial is learnt from at most ``rows`` labelled ids, those with the lowest hashes, so
    their table is broadcast and no text is shuffled; the raw one counts every row.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good_id")).distinct()
    picked = good.orderBy(F.xxhash64("_good_id"), "_good_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("_id") == F.col("_good_id"), "left")
    return log_ratios(joined, F.col("_good_id").isNotNull())
