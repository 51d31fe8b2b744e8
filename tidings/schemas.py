"""Explicit schemas of the stored tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


RAW_ARTICLE = _strings("title", "description", "url", "date", "domain")
ARTICLE_CSV = _strings("title", "description", "url", "date", "domain", "text")
REQUIRED_ARTICLE_COLUMNS = ("text", "title", "url", "date", "domain")

# Feed items as they stand in the XML; attributes carry the ``_`` prefix of the XML source.
RSS_ITEM = "title STRING, description STRING, link STRING, pubDate STRING, `content:encoded` STRING"
ATOM_ENTRY = (
    "title STRING, summary STRING, content STRING, "
    "link ARRAY<STRUCT<_href: STRING, _rel: STRING>>, published STRING, updated STRING"
)

FEED_CONFIG = "feeds ARRAY<STRUCT<name: STRING, url: STRING>>"
FEED_STATS = (
    "updated_at STRING, last_fetch_at STRING, "
    "sources ARRAY<STRUCT<name: STRING, slug: STRING, article_count: BIGINT, last_article_time: STRING>>"
)
TOPIC_MAP = "MAP<STRING, STRUCT<keywords: ARRAY<STRING>, label: STRING, article_count: BIGINT>>"
MEMBERSHIP_MAP = "MAP<STRING, ARRAY<BIGINT>>"
TRENDING_ENTRY = (
    "cluster_id STRING, label STRING, trending_score DOUBLE, count_24h BIGINT, "
    "count_7d BIGINT, top_articles ARRAY<STRUCT<id: STRING, title: STRING, url: STRING, date: STRING>>"
)
DUPLICATE_ENTRY = (
    "article_a STRUCT<id: STRING, title: STRING, url: STRING>, "
    "article_b STRUCT<id: STRING, title: STRING, url: STRING>, similarity DOUBLE"
)
METADATA_ENTRY = "id STRING, title STRING, url STRING, date STRING, domain STRING"


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_ARTICLE_COLUMNS) -> DataFrame:
    """Fail early when a table lacks columns the operators rely on."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"table is missing required columns: {', '.join(missing)}")
    return df
