"""Layout of freshly opened tables, and cutting the lineage of costly ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose words make one partition of a shuffle.
TEXT_BYTES = 4 << 20

def spread_few_splits(scan: DataFrame, key: str) -> DataFrame:
    """Spread a table by ``key`` when its files give fewer splits than there are task slots.

    Meant for a plain scan that heavy work per row follows: counting the splits of a scan runs
    nothing. A table with enough splits is left alone, so large tables are never shuffled for this.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= slots:
        return scan
    return scan.repartition(slots, key)


def text_partitions(df: DataFrame, text: str) -> int:
    """So many partitions that each gets the words of a bounded length of text, one per task slot at least."""
    size = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TEXT_BYTES))


def ids_repeat(df: DataFrame, key: str) -> bool:
    """Whether some id stands in several rows. Only the ids are shuffled."""
    return not df.groupBy(key).count().filter("count > 1").isEmpty()


def materialize(df: DataFrame) -> DataFrame:
    """Compute a costly table once, for a plan that reads it several times.

    Where the cluster names a checkpoint folder (``spark.checkpoint.dir``, on shared storage) the rows
    are written there, so they survive lost executors. Without one they are cached, and lost blocks
    are computed again.
    """
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()
