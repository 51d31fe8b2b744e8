"""Cleaning, appending, capping and counting articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions import dates, publishers, text, urls
from tidings.functions.publishers import DEFAULT_PUBLISHERS, Publisher
from tidings.sources.layout import materialize

# Fixed value: shortest text kept.
MIN_TEXT_LENGTH = 50

# Column names under which foreign tables keep each field, in order of preference.
COLUMN_ALIASES = {
    "title": ("title", "Title", "headline", "Headline"),
    "description": ("description", "Description", "short_description", "content", "summary"),
    "url": ("url", "URL", "link", "Link", "urlToArticle"),
    "date": ("date", "Date", "publishedAt", "published_at", "pubDate"),
    "domain": ("domain", "Domain", "source", "source_name", "Source"),
}


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key.

    The rank filter is pushed below the shuffle, so a hot key sends one row per map task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def pick_alias(df: DataFrame, field: str) -> Column:
    """First non-NULL value among the known aliases of a field, trimmed; blank when none exists."""
    present = [F.col(f"`{name}`") for name in COLUMN_ALIASES[field] if name in df.columns]
    return text.strip(F.coalesce(*present)) if present else F.lit("")


def normalize_aliases(df: DataFrame, position: str = "ingest_seq") -> DataFrame:
    """Bring a foreign table to the raw article columns and fill url, date and domain gaps.

    ``position`` is the row's place in the source; missing values are derived from it.
    """
    raw = df.select(position, *[pick_alias(df, field).alias(field) for field in COLUMN_ALIASES])
    index = F.col(position)
    host = F.concat(F.lit("news.example-"), (index % 12 + 1).cast("string"), F.lit(".com"))
    no_url = F.col("url") == ""
    filled = raw.withColumn(
        "domain", F.when(no_url & (F.col("domain") == ""), host).otherwise(F.col("domain"))
    )
    name = F.coalesce(
        F.nullif(text.slug(F.col("title")), F.lit("")),
        F.concat(F.lit("article-"), index.cast("string")),
    )
    made_url = F.concat(
        F.lit("https://"), F.col("domain"), F.lit("/"), name, F.lit("-"), index.cast("string")
    )
    made_date = F.concat(
        F.lit("2020-"), F.lpad((index % 12 + 1).cast("string"), 2, "0"),
        F.lit("-"), F.lpad((index % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:00:00"),
    )
    filled = filled.withColumn("url", F.when(no_url, made_url).otherwise(F.col("url")))
    return filled.select(
        position, "title", "description", "url",
        F.when(F.col("date") == "", made_date).otherwise(F.col("date")).alias("date"),
        F.when(F.col("domain") == "", urls.domain_of(F.col("url")))
        .otherwise(F.col("domain")).alias("domain"),
    )


def first_by(df: DataFrame, limit: int, order: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """The first ``limit`` rows by a column, then by another one; NULLs of the first come last.

    Only the two columns are sorted, range by range; the key of the last row taken is found by counting
    the ranges and looking into one of them. The rows themselves are then filtered by that key where
    they lie, so no task holds the rows that are kept. The result is not sorted.
    """
    if limit <= 0:
        return df.limit(0)
    key = F.col(order)
    tied = F.col(tie).cast("string") if tie else F.lit("")
    keys = df.select(key.isNull().alias("late"), key.alias("k"), tied.alias("t"))
    by = [F.col("late"), F.col("k").desc() if descending else F.col("k").asc(), F.col("t").asc_nulls_first()]
    ranges = materialize(
        keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    )
    seen = 0
    for part, n in sorted(map(tuple, ranges.groupBy("part").count().collect())):
        if seen + n >= limit:
            break
        seen += n
    else:
        return df
    inside = W.partitionBy("part").orderBy(*by)
    last = ranges.filter(F.col("part") == part).withColumn("at", F.row_number().over(inside))
    cut = last.filter(F.col("at") == limit - seen).head()
    if cut["late"]:
        better, level = key.isNotNull(), key.isNull()
    else:
        better, level = (key > cut["k"] if descending else key < cut["k"]), key == cut["k"]
    lower = F.lit(False) if cut["t"] is None else tied.isNull() | (tied < cut["t"])
    before = F.coalesce(better | (level & lower), F.lit(False))
    equal = F.coalesce(level & tied.eqNullSafe(F.lit(cut["t"])), F.lit(False))
    # Rows alike in both columns are interchangeable; as many as are left to take.
    open_ = limit - ranges.filter(_key_before(cut, descending)).count()
    return df.filter(before).unionByName(df.filter(equal).limit(open_))


def _key_before(cut: Row, descending: bool) -> Column:
    """Whether a key (late, k, t) sorts before the cut."""
    k, t = F.col("k"), F.col("t")
    lower = F.lit(False) if cut["t"] is None else t.isNull() | (t < cut["t"])
    if cut["late"]:
        return ~F.col("late") | (F.col("late") & lower)
    better = k > cut["k"] if descending else k < cut["k"]
    return F.coalesce(better | ((k == cut["k"]) & lower), F.lit(False))


def first_rows(df: DataFrame, limit: int, order: str = "ingest_seq") -> DataFrame:
    """The first ``limit`` rows of a corpus with NULL text turned blank."""
    return first_by(df, limit, order).na.fill("")


def clean_articles(
    raw: DataFrame,
    min_length: int = MIN_TEXT_LENGTH,
    canonical_urls: bool = False,
    full_entities: bool = True,
) -> DataFrame:
    """Plain text, length filter, then the first remaining record per url.

    Expects ``ingest_seq, title, description, url, date, domain``. The first record that *passes*
    the length filter wins, not the first one seen: records that pass sort before those that do
    not. Ranking by the outcome instead of filtering first keeps the optimizer from cleaning every
    text once for the filter and once more for the result.
    """
    url = text.strip(F.col("url"))
    url = urls.clean_url(url) if canonical_urls else url
    fields = raw.select(
        "ingest_seq",
        text.strip_html(F.col("title"), full_entities).alias("title"),
        text.strip_html(F.col("description"), full_entities).alias("description"),
        url.alias("url"),
        "date",
        "domain",
    )
    # The combined text is built after the shuffle, so its parts travel once.
    combined = F.trim(F.concat(F.col("title"), F.lit(" "), F.col("description")))
    short = F.length(combined) < min_length
    kept = fields.filter(F.col("url") != "").withColumn("_short", short)
    first = first_per_key(kept, ["url"], [F.col("_short"), F.col("ingest_seq")])
    return first.filter(~F.col("_short")).select(
        "ingest_seq", "title", "description", "url",
        dates.format_date(F.col("date")).alias("date"),
        text.display(F.col("domain"), urls.domain_of(F.col("url"))).alias("domain"),
        combined.alias("text"),
    )


def long_enough(df: DataFrame, column: str = "text", min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    return df.filter(F.length(column) >= min_length)


def filter_sources(
    df: DataFrame,
    slugs: Sequence[str] | None,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
    domain: str = "domain",
) -> DataFrame:
    """Rows whose domain belongs to a selected publisher; everything when nothing is selected."""
    if not slugs:
        return df
    return df.filter(publishers.matches_sources(F.col(domain), slugs, configured))


def new_articles(incoming: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Incoming rows whose url is not known yet."""
    return incoming.join(known.select(key), key, "left_anti")


def new_in_small_batch(incoming: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """As ``new_articles``, for a batch far smaller than the known table.

    The known urls are first reduced to those the batch asks about. That look-up lets Spark
    broadcast the batch's urls, when they are small enough, instead of shuffling the whole table.
    """
    asked = incoming.select(key).distinct()
    seen = known.select(key).join(asked, key, "left_semi").distinct()
    return incoming.join(seen, key, "left_anti")


def cap_corpus(
    df: DataFrame, limit: int, keep: str = "oldest", order: str = "ingest_seq"
) -> DataFrame:
    """At most ``limit`` articles, the oldest or the newest by ingest order.

    Rows without an order value come last either way; equal order values are told apart by url.
    """
    if keep not in ("oldest", "newest"):
        raise ValueError(f"keep must be 'oldest' or 'newest', got {keep!r}")
    return first_by(df, limit, order, keep == "newest", "url" if "url" in df.columns else None)


def append_articles(
    incoming: DataFrame,
    existing: DataFrame | None = None,
    cap: int | None = None,
    keep: str = "oldest",
) -> DataFrame:
    """Existing corpus followed by the incoming articles it lacks, optionally capped.

    Incoming ingest positions are expected to lie above the existing ones (see
    ``sources.articles.with_positions``). Without ``existing`` this is a first load.
    """
    combined = incoming
    if existing is not None:
        combined = existing.unionByName(new_articles(incoming, existing))
    return combined if cap is None else cap_corpus(combined, cap, keep)


def ingest_counts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: new, duplicate and resulting total number of articles of an ingest run."""
    flagged = incoming.join(
        existing.select("url", F.lit(True).alias("_known")).dropDuplicates(["url"]), "url", "left"
    )
    new = flagged.agg(
        F.count_if(F.col("_known").isNull()).alias("new_articles"),
        F.count_if(F.col("_known").isNotNull()).alias("duplicate_articles"),
    )
    known = existing.agg(F.count(F.lit(1)).alias("_known_total"))
    return new.crossJoin(known).select(
        "new_articles",
        "duplicate_articles",
        (F.col("_known_total") + F.col("new_articles")).alias("total_articles"),
    )


def first_link_across_feeds(entries: DataFrame) -> DataFrame:
    """One entry per link: the publisher listed first wins, then the earlier entry."""
    return first_per_key(
        entries.filter(F.coalesce(F.col("link"), F.lit("")) != ""),
        ["link"],
        [F.col("pos"), F.col("ingest_seq")],
    )


def articles_per_feed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_name").agg(F.count(F.lit(1)).alias("article_count"))


def feed_stats(
    articles: DataFrame,
    configured: Sequence[Publisher] = DEFAULT_PUBLISHERS,
    domain: str = "domain",
    published: str = "published",
) -> DataFrame:
    """Article count and latest date of every configured publisher, those without articles too."""
    spark = articles.sparkSession
    counted = (
        articles.select(
            publishers.publisher_of(F.col(domain), configured).alias("name"),
            F.col(published).alias("_published"),
        )
        .filter("name IS NOT NULL")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("article_count"), F.max("_published").alias("_latest"))
    )
    return (
        publishers.publisher_table(spark, configured)
        .join(counted, "name", "left")
        .select(
            "name",
            "slug",
            "pos",
            F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count"),
            dates.timestamp_text(F.col("_latest")).alias("last_article_time"),
        )
    )


def feed_stats_display(stats: DataFrame) -> DataFrame:
    """Three-column view of the feed statistics with a dash for gaps."""
    return stats.select(
        text.display(F.col("name"), "—").alias("source"),
        F.coalesce("article_count", F.lit(0)).cast("bigint").alias("articles"),
        text.display(F.col("last_article_time"), "—").alias("last_article"),
    )


def article_metadata(articles: DataFrame) -> DataFrame:
    """Id, title, url, date and domain of every article with gaps turned blank."""
    return articles.select(
        F.col("article_id").cast("string").alias("id"),
        *[text.strip(F.col(name)).alias(name) for name in ("title", "url", "date", "domain")],
    )


def lookup_by_url(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Id of the first article with each wanted url; urls nobody carries get NULL."""
    asked = wanted.select("url").distinct()
    found = articles.join(asked, "url", "left_semi")
    first = found.groupBy("url").agg(F.min_by("article_id", "ingest_seq").alias("article_id"))
    return asked.join(first, "url", "left")


def exact_duplicate_groups(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Groups of identical texts (case and white space ignored) with size and lowest id."""
    normalized = text.collapse_whitespace(F.lower(F.coalesce(F.col(text_column), F.lit(""))))
    return (
        df.select(F.col(id_column).alias("_id"), F.sha2(normalized, 256).alias("text_hash"))
        .groupBy("text_hash")
        .agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def index_drift(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """How far an index has moved from its corpus, comparing urls position by position.

    Both sides carry ``position`` and ``url``. ``aligned`` is true when the sizes agree and every
    position holds the same url.
    """
    left = corpus.select("position", F.col("url").alias("_corpus_url"), F.lit(1).alias("_in_corpus"))
    right = index.select("position", F.col("url").alias("_index_url"), F.lit(1).alias("_in_index"))
    joined = left.join(right, "position", "full_outer")
    same = F.coalesce(F.col("_corpus_url"), F.lit("")) == F.coalesce(F.col("_index_url"), F.lit(""))
    both = F.col("_in_corpus").isNotNull() & F.col("_in_index").isNotNull()
    counts = joined.agg(
        F.count("_in_corpus").alias("corpus_rows"),
        F.count("_in_index").alias("index_rows"),
        F.count_if(both & ~same).alias("moved"),
        F.count_if(F.col("_in_index").isNull()).alias("not_indexed"),
        F.count_if(F.col("_in_corpus").isNull()).alias("stale"),
    )
    drifted = F.col("moved") + F.col("not_indexed") + F.col("stale")
    return counts.withColumn("aligned", drifted == 0)
