"""Writers: tables, exports and the ingest run log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_STATE = (
    "last_run STRING, new_articles BIGINT, total_articles BIGINT, feeds_polled BIGINT, "
    "errors ARRAY<STRING>"
)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Columnar table, optionally partitioned."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One numbered batch of a growing table; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def replace_batches(df: DataFrame, path: str) -> None:
    """A growing table begun anew: batch 0 takes the place of all its batches."""
    whole = df.withColumn("batch", F.lit(0))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def run_state(
    spark: SparkSession,
    new_articles: int,
    total_articles: int,
    feeds_polled: int,
    errors: Sequence[str] = (),
    now: datetime | None = None,
) -> DataFrame:
    """One row describing an ingest run."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S UTC")
    row = (stamp, new_articles, total_articles, feeds_polled, list(errors))
    return spark.createDataFrame([row], RUN_STATE)


def append_run_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("append").json(path)
