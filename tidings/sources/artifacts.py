"""Import of artefacts kept as single JSON documents, and of the run log.

These readers bring an existing index into tables once; the tables are what the operators work on
afterwards. Lists (metadata, pairs, trends) are read an element a row; maps, which have a key per
cluster, are read as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import schemas
from tidings.sources.articles import with_positions


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schema).alias("doc")
    )
    if parsed.filter("doc IS NULL").head(1):
        raise ValueError(f"unexpected JSON in {path}")
    return parsed


def _elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of files that each hold one list, a row per element; anything else raises.

    The reader parses a file as a stream of elements, so no row holds a whole file. An empty list gives
    no rows, a null element a row of nulls.
    """
    # Pieces between commas: the first ones are short whatever the size of the file.
    opening = spark.read.option("lineSep", ",").text(path).head(1)
    if not opening or not opening[0][0].lstrip("\ufeff \t\r\n").startswith("["):
        raise ValueError(f"unexpected JSON in {path}")
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def import_membership(spark: SparkSession, path: str) -> DataFrame:
    """``{cluster: [position, ...]}`` as rows of cluster_id and article_id."""
    clusters = _document(spark, path, schemas.MEMBERSHIP_MAP).select(F.explode("doc").alias("c", "ids"))
    return clusters.select(F.col("c").cast("int").alias("cluster_id"), F.explode("ids").alias("article_id"))


def import_topics(spark: SparkSession, path: str) -> DataFrame:
    """``{cluster: {keywords, label, article_count}}`` as one row per cluster."""
    topics = _document(spark, path, schemas.TOPIC_MAP).select(F.explode("doc").alias("c", "t"))
    return topics.select(F.col("c").cast("int").alias("cluster_id"), "t.*")


def import_trending(spark: SparkSession, path: str) -> DataFrame:
    rows = _elements(spark, path, schemas.TRENDING_ENTRY)
    return rows.withColumn("cluster_id", F.col("cluster_id").cast("int"))


def import_duplicates(spark: SparkSession, path: str) -> DataFrame:
    pairs = _elements(spark, path, schemas.DUPLICATE_ENTRY)
    sides = [
        F.col(f"article_{side}.{name}").alias(f"{side}_{name}")
        for side in ("a", "b")
        for name in ("id", "title", "url")
    ]
    return pairs.select(*sides, "similarity").withColumns(
        {name: F.col(name).cast("bigint") for name in ("a_id", "b_id")}
    )


def import_metadata(spark: SparkSession, path: str) -> DataFrame:
    """List of article metadata; a missing id is the row's position in the list."""
    rows = with_positions(_elements(spark, path, schemas.METADATA_ENTRY))
    identity = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.col("ingest_seq").cast("string"))
    return rows.select(
        identity.cast("bigint").alias("article_id"),
        "ingest_seq",
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("title", "url", "date", "domain")],
    )


def import_feed_stats(spark: SparkSession, path: str) -> DataFrame:
    stats = _document(spark, path, schemas.FEED_STATS)
    return stats.select("doc.updated_at", "doc.last_fetch_at", F.inline("doc.sources"))


def last_fetch(spark: SparkSession, path: str) -> str | None:
    """Timestamp of the newest ``[fetch]`` line in the run log."""
    stamp = F.trim(F.split_part("value", F.lit(" [fetch]"), F.lit(1)))
    lines = spark.read.text(path).filter(F.col("value").contains(" [fetch]"))
    return lines.agg(F.max(stamp)).head()[0]
