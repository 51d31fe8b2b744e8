"""Publishers: feeds, categories, slugs and the domain patterns that identify them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Publisher:
    name: str
    slug: str
    category: str
    patterns: tuple[str, ...]
    feeds: tuple[str, ...] = ()


# The publishers followed, in matching order.
DEFAULT_PUBLISHERS = (
    Publisher(
        "BBC News", "bbc", "world", ("bbc.co.uk", "bbc.com"),
        (
            "https://feeds.bbci.co.uk/news/rss.xml",
            "https://feeds.bbci.co.uk/news/world/rss.xml",
            "https://feeds.bbci.co.uk/news/technology/rss.xml",
        ),
    ),
    Publisher(
        "Reuters", "reuters", "business", ("reuters.com",),
        (
            "https://feeds.reuters.com/reuters/topNews",
            "https://feeds.reuters.com/reuters/technologyNews",
        ),
    ),
    Publisher(
        "AP News", "ap", "world", ("apnews.com",),
        ("https://rsshub.app/apnews/topics/ap-top-news",),
    ),
    Publisher(
        "Al Jazeera", "aljazeera", "world", ("aljazeera.com",),
        ("https://www.aljazeera.com/xml/rss/all.xml",),
    ),
    Publisher(
        "The Guardian", "guardian", "world", ("theguardian.com",),
        ("https://www.theguardian.com/world/rss",),
    ),
    Publisher(
        "TechCrunch", "techcrunch", "tech", ("techcrunch.com",),
        ("https://techcrunch.com/feed/",),
    ),
    Publisher(
        "Ars Technica", "arstechnica", "tech", ("arstechnica.com",),
        ("https://feeds.arstechnica.com/arstechnica/index",),
    ),
)


def _matches(domain: Column, pattern: str, suffix_only: bool) -> Column:
    if suffix_only:
        return (domain == pattern) | domain.endswith("." + pattern)
    return domain.contains(pattern)


def publisher_of(
    domain: Column,
    publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS,
    suffix_only: bool = False,
) -> Column:
    """Name of the first publisher one of whose patterns occurs in the domain, else NULL.

    The publisher list is configuration, so it becomes a CASE expression inside the scan stage and
    needs no join. ``suffix_only`` matches whole host labels instead of any substring.
    """
    lowered = F.lower(F.coalesce(domain, F.lit("")))
    found = F.lit(None).cast("string")
    for publisher in reversed(publishers):
        hit = F.lit(False)
        for pattern in publisher.patterns:
            hit = hit | _matches(lowered, pattern, suffix_only)
        found = F.when(hit, F.lit(publisher.name)).otherwise(found)
    return found


def category_of(name: Column, publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS) -> Column:
    category = F.lit("")
    for publisher in publishers:
        category = F.when(name == publisher.name, F.lit(publisher.category)).otherwise(category)
    return category


def matches_sources(
    domain: Column,
    slugs: Sequence[str] | None,
    publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS,
) -> Column:
    """True when the domain belongs to a selected publisher; no selection lets everything pass.

    Unknown slugs are ignored, so a selection of unknown slugs only matches nothing.
    """
    if not slugs:
        return F.lit(True)
    allowed = [p.name for p in publishers if p.slug in set(slugs)]
    if not allowed:
        return F.lit(False)
    return F.coalesce(publisher_of(domain, publishers).isin(*allowed), F.lit(False))


def publisher_table(
    spark: SparkSession, publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS
) -> DataFrame:
    """Dimension table (name, slug, category, pos) of the configured publishers."""
    rows = [(p.name, p.slug, p.category, pos) for pos, p in enumerate(publishers)]
    return spark.createDataFrame(rows, "name STRING, slug STRING, category STRING, pos INT")


def feed_table(spark: SparkSession, publishers: Sequence[Publisher] = DEFAULT_PUBLISHERS) -> DataFrame:
    """Dimension table (url, source_name, category, pos) of the configured feeds."""
    rows = [(url, p.name, p.category, pos) for pos, p in enumerate(publishers) for url in p.feeds]
    return spark.createDataFrame(rows, "url STRING, source_name STRING, category STRING, pos INT")
