"""RSS and Atom files, and the feed configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings import schemas
from tidings.functions import dates, publishers, text, urls
from tidings.functions.publishers import DEFAULT_PUBLISHERS, Publisher

# Domain of entries whose link has none, name of an unnamed feed.
DEFAULT_DOMAIN = "bbc.co.uk"
UNNAMED_FEED = "RSS feed"

_ENTRY = ("title", "link", "summary", "published")


def _rss_fields(items: DataFrame) -> DataFrame:
    return items.select(
        text.strip(F.col("title")).alias("title"),
        text.strip(F.col("link")).alias("link"),
        text.display(F.col("description"), text.strip(F.col("`content:encoded`"))).alias("summary"),
        F.col("pubDate").alias("published"),
    )


def _atom_fields(entries: DataFrame) -> DataFrame:
    hrefs = F.transform(F.coalesce("link", F.array()), lambda link: text.strip(link["_href"]))
    chosen = F.filter(
        F.coalesce("link", F.array()),
        lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate",
    )
    preferred = text.strip(F.try_element_at(chosen, F.lit(1))["_href"])
    any_href = F.try_element_at(F.filter(hrefs, lambda href: href != ""), F.lit(1))
    return entries.select(
        text.strip(F.col("title")).alias("title"),
        text.display(preferred, F.coalesce(any_href, F.lit(""))).alias("link"),
        text.display(F.col("summary"), text.strip(F.col("content"))).alias("summary"),
        text.display(F.col("published"), text.strip(F.col("updated"))).alias("published"),
    )


def read_items(spark: SparkSession, path: str, kind: str = "rss", stream: bool = False) -> DataFrame:
    """Entries of RSS (``item``) or Atom (``entry``) files as title, link, summary, published.

    The XML source splits large files at the row tag. With ``stream`` the folder is followed.
    """
    if kind not in ("rss", "atom"):
        raise ValueError(f"kind must be 'rss' or 'atom', got {kind!r}")
    tag, schema = ("item", schemas.RSS_ITEM) if kind == "rss" else ("entry", schemas.ATOM_ENTRY)
    reader = spark.readStream if stream else spark.read
    raw = reader.format("xml").option("rowTag", tag).schema(schema).load(path)
    return _rss_fields(raw) if kind == "rss" else _atom_fields(raw)


def to_records(items: DataFrame, feed: str | Column, full_entities: bool = True) -> DataFrame:
    """Raw article records of one feed; entries without title or link are dropped."""
    name = F.lit(feed) if isinstance(feed, str) else feed
    kept = [c for c in items.columns if c not in _ENTRY]
    plain = items.select(
        *kept,
        text.strip_html(F.col("title"), full_entities).alias("title"),
        text.strip_html(F.col("summary"), full_entities).alias("description"),
        F.col("link").alias("url"),
        dates.format_date(F.col("published")).alias("date"),
        text.display(urls.domain_of(F.col("link")), DEFAULT_DOMAIN).alias("domain"),
        name.alias("feed"),
    )
    return plain.filter("title <> '' AND url <> ''")


def to_entries(
    items: DataFrame,
    source_name: str | Column,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
    full_entities: bool = True,
) -> DataFrame:
    """Entries of a publisher's feed with canonical link, parsed date, publisher and category."""
    name = F.lit(source_name) if isinstance(source_name, str) else source_name
    kept = [c for c in items.columns if c not in _ENTRY]
    plain = items.select(
        *kept,
        text.strip_html(F.col("title"), full_entities).alias("title"),
        urls.clean_url(F.col("link")).alias("link"),
        text.strip_html(F.col("summary"), full_entities).alias("summary"),
        dates.parse_date(F.col("published")).alias("published"),
        name.alias("source_name"),
        publishers.category_of(name, configured).alias("category"),
    )
    return plain.filter("title <> '' AND link <> ''")


def entries_to_records(entries: DataFrame, body: Column | None = None) -> DataFrame:
    """Raw article records of publisher entries; ``body`` replaces the summary where it is given."""
    kept = [c for c in entries.columns if c == "ingest_seq"]
    return entries.select(
        *kept,
        "title",
        (F.col("summary") if body is None else body).alias("description"),
        F.col("link").alias("url"),
        F.coalesce(dates.timestamp_text(F.col("published")), F.lit("")).alias("date"),
        urls.domain_of(F.col("link")).alias("domain"),
    )


def feed_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Configured feeds (name, url) and the messages for entries that lack a url."""
    listed = (
        spark.read.option("multiLine", True).schema(schemas.FEED_CONFIG).json(path)
        .select(F.explode("feeds").alias("f"))
        .select(
            text.display(F.col("f.name"), UNNAMED_FEED).alias("name"),
            text.strip(F.col("f.url")).alias("url"),
        )
    )
    if not listed.head(1):
        raise ValueError(f"no feeds defined in {path}")
    errors = listed.filter("url = ''").select(F.concat("name", F.lit(": missing url")).alias("error"))
    return listed.filter("url <> ''"), errors
