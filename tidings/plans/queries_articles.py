"""Registered queries: scalar functions, scans, filters, ingest and feed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import dates, html, publishers, text, urls
from tidings.operators import articles as ops
from tidings.plans import bindings as b
from tidings.plans.registry import query
from tidings.schemas import require_columns

_STOPS = ", ".join("'" + word.replace("'", "''") + "'" for word in text.ENGLISH_STOP_WORDS)

# The test pages hold one flat article element each and only common entities.
_SQL_PIECE = b.SQL_ENTITIES.format("piece")
_SQL_BODY = f"""
array_to_string(list_filter(list_transform(
  string_split_regex(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>'),
  lambda piece: trim({_SQL_PIECE}, chr(32) || chr(9) || chr(10) || chr(13))),
  lambda piece: piece <> ''), ' ')
"""

_SQL_ARTICLES = f"WITH {b.SQL_ARTICLES}"


@query(
    "scan_articles",
    f"""{_SQL_ARTICLES}
    SELECT article_id, url, domain, date, md5(title) AS title_md5, md5(text) AS text_md5
    FROM articles""",
)
def scan_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_columns(b.articles(spark, sf_dir)).select(
        "article_id", "url", "domain", "date",
        F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"),
    )


@query(
    "alias_normalize",
    f"""{_SQL_ARTICLES}, foreign_rows AS (
      SELECT a.ingest_seq, trim(a.title, ' ' || chr(9) || chr(10) || chr(13)) AS title,
             coalesce(trim(p.url), '') AS url,
             CASE WHEN a.lang = 'fr' THEN '' ELSE a.date END AS date,
             CASE WHEN a.lang = 'de' THEN a.source ELSE '' END AS domain
      FROM articles a LEFT JOIN pages p ON p.page_id = a.article_id),
    hosted AS (
      SELECT ingest_seq, title, url, date,
             CASE WHEN url = '' AND domain = ''
                  THEN 'news.example-' || (ingest_seq % 12 + 1) || '.com' ELSE domain END AS domain,
             trim(substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), 1, 60), '-')
               AS slug
      FROM foreign_rows),
    filled AS (
      SELECT ingest_seq, title, date, domain,
             CASE WHEN url = '' THEN 'https://' || domain || '/' ||
               CASE WHEN slug = '' THEN 'article-' || ingest_seq ELSE slug END || '-' || ingest_seq
             ELSE url END AS url
      FROM hosted)
    SELECT ingest_seq, md5(title) AS title_md5, url,
           CASE WHEN date = '' THEN '2020-' || lpad((ingest_seq % 12 + 1)::VARCHAR, 2, '0') || '-' ||
             lpad((ingest_seq % 28 + 1)::VARCHAR, 2, '0') || ' 12:00:00' ELSE date END AS date,
           CASE WHEN domain = '' THEN {b.SQL_DOMAIN.format("url")} ELSE domain END AS domain
    FROM filled""",
)
def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), F.col("url").alias("Link"))
    base = b.articles(spark, sf_dir).drop("url", "domain")
    foreign = base.join(pages, "article_id", "left").select(
        "ingest_seq",
        F.lit(None).cast("string").alias("Title"),
        F.col("title").alias("headline"),
        F.col("description").alias("content"),
        "Link",
        F.when(F.col("lang") != "fr", F.col("date")).alias("pubDate"),
        F.when(F.col("lang") == "de", F.col("source")).alias("Source"),
    )
    return ops.normalize_aliases(foreign).select(
        "ingest_seq", F.md5("title").alias("title_md5"), "url", "date", "domain"
    )


@query(
    "corpus_scan_limit",
    """SELECT doc_id, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS text_md5
    FROM documents ORDER BY doc_id LIMIT 300""",
)
def corpus_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ops.first_rows(b.table(spark, sf_dir, "documents"), 300, order="doc_id")
    return first.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query(
    "strip_html",
    f"""WITH stripped AS (SELECT page_id, {b.SQL_STRIP_HTML.format("html")} AS plain FROM pages)
    SELECT page_id, length(plain)::BIGINT AS plain_chars, md5(plain) AS plain_md5 FROM stripped""",
)
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = b.web_pages(spark, sf_dir).select(
        "page_id", text.strip_html(F.col("html")).alias("plain")
    )
    return plain.select(
        "page_id", F.length("plain").cast("bigint").alias("plain_chars"), F.md5("plain").alias("plain_md5")
    )


@query(
    "combine_text",
    f"""WITH parts AS (
      SELECT page_id, {b.SQL_STRIP_HTML.format("url")} AS a, {b.SQL_STRIP_HTML.format("html")} AS b
      FROM pages)
    SELECT page_id, md5(concat_ws(' ', nullif(a, ''), nullif(b, ''))) AS combined_md5 FROM parts""",
)
def combine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = text.combine_text(F.col("url"), F.col("html"))
    return b.web_pages(spark, sf_dir).select("page_id", F.md5(combined).alias("combined_md5"))


@query(
    "display_defaults",
    """SELECT d.doc_id,
           coalesce(nullif(trim(split_part(p.url, '?', 2)), ''), 'none') AS query_text,
           coalesce(nullif(trim(l.quality::VARCHAR), ''), 'unrated') AS quality
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def display_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    labels = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("_quality"))
    joined = b.table(spark, sf_dir, "documents").select("doc_id").join(pages, "doc_id", "left")
    return joined.join(labels, "doc_id", "left").select(
        "doc_id",
        text.display(F.split_part("url", F.lit("?"), F.lit(2)), "none").alias("query_text"),
        text.display(F.col("_quality"), "unrated").alias("quality"),
    )


@query("url_domain", f"SELECT page_id, {b.SQL_DOMAIN.format('url')} AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"))


_SQL_RAW_DATES = """
WITH spelled AS (
  SELECT event_id, ts, CASE event_type
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 'click' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0100'
    WHEN 'purchase' THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
    WHEN 'signup' THEN strftime(ts, '%B %d, %Y')
    ELSE props END AS raw
  FROM events),
parsed AS (
  SELECT event_id, raw, CASE
    WHEN raw LIKE '%T%Z' THEN try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ')
    WHEN raw LIKE '%+0100' THEN try_strptime(left(raw, -6), '%a, %d %b %Y %H:%M:%S')
    WHEN raw LIKE '__/__/%' THEN coalesce(try_strptime(raw, '%m/%d/%Y %H:%M:%S'),
                                          try_strptime(raw, '%d/%m/%Y %H:%M:%S'))
    ELSE try_strptime(raw, '%B %d, %Y') END AS ts
  FROM spelled)
"""


def _spelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss' +0100'"))
        .when(kind == "purchase", F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(kind == "signup", F.date_format(ts, "MMMM dd, yyyy"))
        .otherwise(F.col("props"))
    )
    return b.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(
    "parse_dates",
    f"{_SQL_RAW_DATES} SELECT event_id, {b.SQL_TS.format('ts')} AS published FROM parsed",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = dates.timestamp_text(dates.parse_date(F.col("raw")))
    return _spelled_dates(spark, sf_dir).select("event_id", parsed.alias("published"))


# Further spellings of feeds: how each is written, and the unit of time that it keeps.
_FEED_DATES = (
    ("%a, %d %b %y %H:%M:%S GMT", "EEE, dd MMM yy HH:mm:ss 'GMT'", "second"),
    ("%B %d, %Y %I:%M %p", "MMMM dd, yyyy hh:mm a", "minute"),
    ("%d/%m/%Y %I:%M:%S %p", "dd/MM/yyyy hh:mm:ss a", "second"),
    ("%Y%m%dT%H%M%S", "yyyyMMdd'T'HHmmss", "second"),
    ("%m/%d/%y", "MM/dd/yy", "day"),
    ("%Y-%m-%dT%H:%M:%S-05", "yyyy-MM-dd'T'HH:mm:ss'-05'", "second"),
    ("%a, %d %b %Y %H:%M:%S CEST", "EEE, dd MMM yyyy HH:mm:ss 'CEST'", "second"),
    ("%d %b %Y at %H:%M", "dd MMM yyyy 'at' HH:mm", "minute"),
    ("%Y-%m-%d %H", "yyyy-MM-dd HH", "hour"),
    ("%dth %B %Y", "dd'th' MMMM yyyy", "day"),
)
_SQL_FEED_DATES = f"""
WITH spelled AS (SELECT event_id, ts, CASE event_id % 10
  {" ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, (f, _, _) in enumerate(_FEED_DATES))} END AS raw FROM events),
month_first AS (SELECT *, CASE WHEN event_id % 10 = 2 AND day(ts) <= 12
  THEN strptime(raw, '%m/%d/%Y %I:%M:%S %p') ELSE ts END AS t FROM spelled)
SELECT event_id, raw, strftime(CASE event_id % 10
  {" ".join(f"WHEN {i} THEN date_trunc('{u}', t)" for i, (_, _, u) in enumerate(_FEED_DATES))} END,
  '%Y-%m-%d %H:%M:%S') AS published FROM month_first
"""


@query("parse_feed_dates", _SQL_FEED_DATES)
def parse_feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years, 12-hour clocks, compact and partial times, ordinals, names and hours of zones."""
    kind = F.pmod("event_id", F.lit(10))
    raw = F.coalesce(*[F.when(kind == i, F.date_format("ts", f)) for i, (_, f, _) in enumerate(_FEED_DATES)])
    spelled = b.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return spelled.select("event_id", "raw", dates.timestamp_text(dates.parse_date(F.col("raw"))).alias("published"))


@query(
    "format_dates",
    f"""{_SQL_RAW_DATES} SELECT event_id, coalesce({b.SQL_TS.format('ts')}, trim(raw)) AS date
    FROM parsed""",
)
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelled_dates(spark, sf_dir).select("event_id", dates.format_date(F.col("raw")).alias("date"))


@query("clean_urls", f"SELECT page_id, {b.SQL_CLEAN_URL.format('url')} AS url FROM pages")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", urls.clean_url(F.col("url")).alias("url"))


@query(
    "domain_source",
    f"""{_SQL_ARTICLES} SELECT article_id, domain, {b.SQL_PUBLISHER.format("domain")} AS publisher
    FROM articles""",
)
def domain_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    publisher = publishers.publisher_of(F.col("domain"), b.TEST_PUBLISHERS)
    return b.articles(spark, sf_dir).select("article_id", "domain", publisher.alias("publisher"))


@query(
    "source_filter",
    f"""{_SQL_ARTICLES} SELECT article_id, domain FROM articles
    WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press')""",
)
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.filter_sources(b.articles(spark, sf_dir), b.TEST_SLUGS, b.TEST_PUBLISHERS)
    return kept.select("article_id", "domain")


@query(
    "tokens_ngrams",
    f"""WITH words AS (
      SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                 lambda w: NOT list_contains([{_STOPS}], w)) AS kept
      FROM documents),
    pairs AS (
      SELECT doc_id, kept, list_transform(range(1, len(kept)),
                                          lambda i: kept[i] || ' ' || kept[i + 1]) AS pairs
      FROM words)
    SELECT doc_id, (len(kept) + len(pairs))::BIGINT AS term_count,
           md5(array_to_string(list_concat(kept, pairs), '|')) AS terms_md5
    FROM pairs""",
)
def tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.texts(spark, sf_dir).select("doc_id", "text")
    return text.with_terms(documents, "text").select(
        "doc_id",
        F.size("terms").cast("bigint").alias("term_count"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


@query(
    "article_metadata",
    f"""{_SQL_ARTICLES} SELECT article_id::VARCHAR AS id,
      md5(trim(title, ' ' || chr(9) || chr(10) || chr(13))) AS title_md5, url, date, domain
    FROM articles""",
)
def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = ops.article_metadata(b.articles(spark, sf_dir))
    return meta.select("id", F.md5("title").alias("title_md5"), "url", "date", "domain")


@query(
    "min_length_filter",
    "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE length(text) >= 50",
)
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.long_enough(b.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query(
    "extract_bodies",
    f"""WITH bodies AS (SELECT page_id, {_SQL_BODY} AS body FROM pages)
    SELECT page_id, length(body)::BIGINT AS chars, md5(body) AS body_md5 FROM bodies""",
)
def extract_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = b.web_pages(spark, sf_dir).select("page_id", html.page_text(F.col("html")).alias("body"))
    return bodies.select(
        "page_id", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("body_md5")
    )


@query(
    "body_fallback",
    f"""WITH bodies AS (
      SELECT page_id, {_SQL_BODY} AS body, coalesce(d.text, '') AS summary
      FROM pages LEFT JOIN documents d ON d.doc_id = page_id)
    SELECT page_id, md5(CASE WHEN length(body) >= 100 THEN body ELSE summary END) AS body_md5
    FROM bodies""",
)
def body_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    joined = b.web_pages(spark, sf_dir).join(summaries, "page_id", "left")
    body = html.body_or_summary(html.page_text(F.col("html")), F.col("text"))
    return joined.select("page_id", F.md5(body).alias("body_md5"))


_SQL_CLEAN = f"""
{b.SQL_RAW},
plain AS (
  SELECT ingest_seq, trim(url) AS url, date, domain, {b.SQL_STRIP_HTML.format("title")} AS title,
         {b.SQL_STRIP_HTML.format("description")} AS description FROM raw),
texts AS (SELECT *, trim(title || ' ' || description) AS text FROM plain),
cleaned AS (
  SELECT ingest_seq, url, title, description, text, date,
         CASE WHEN trim(domain) = '' THEN {b.SQL_DOMAIN.format("url")} ELSE trim(domain) END AS domain
  FROM texts WHERE url <> '' AND length(text) >= 50
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq) = 1)
"""


@query(
    "clean_articles",
    f"""{_SQL_ARTICLES}, {_SQL_CLEAN}
    SELECT ingest_seq, url, domain, date, md5(title) AS title_md5,
           md5(description) AS description_md5, md5(text) AS text_md5
    FROM cleaned""",
)
def clean_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_articles(b.raw_records(spark, sf_dir)).select(
        "ingest_seq", "url", "domain", "date", F.md5("title").alias("title_md5"),
        F.md5("description").alias("description_md5"), F.md5("text").alias("text_md5"),
    )


@query(
    "exact_duplicate_groups",
    """WITH hashed AS (
      SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS text_hash
      FROM documents)
    SELECT text_hash, min(doc_id) AS first_id, count(*) AS copies
    FROM hashed GROUP BY text_hash HAVING count(*) > 1""",
)
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exact_duplicate_groups(b.texts(spark, sf_dir), "doc_id", "text")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000_000).alias("ingest_seq"), urls.clean_url(F.col("url")).alias("url")
    )


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.articles(spark, sf_dir).select("ingest_seq", "url")


_SQL_INCOMING = f"""
incoming AS (
  SELECT page_id + 1000000000 AS ingest_seq, {b.SQL_CLEAN_URL.format("url")} AS url FROM pages)
"""


@query(
    "new_articles",
    f"""{_SQL_ARTICLES}, {_SQL_INCOMING}
    SELECT ingest_seq, url FROM incoming WHERE url NOT IN (SELECT url FROM articles)""",
)
def new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = ops.new_articles(_incoming(spark, sf_dir), _existing(spark, sf_dir))
    return new.select("ingest_seq", "url")


@query(
    "append_new_articles",
    f"""{_SQL_ARTICLES}, {_SQL_INCOMING}
    SELECT ingest_seq, url FROM articles
    UNION ALL
    SELECT ingest_seq, url FROM incoming WHERE url NOT IN (SELECT url FROM articles)""",
)
def append_new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.append_articles(_incoming(spark, sf_dir), _existing(spark, sf_dir))


@query(
    "ingest_run_stats",
    f"""{_SQL_ARTICLES}, {_SQL_INCOMING}, flagged AS (
      SELECT url IN (SELECT url FROM articles) AS known FROM incoming)
    SELECT count(*) FILTER (WHERE NOT known) AS new_articles,
           count(*) FILTER (WHERE known) AS duplicate_articles,
           (SELECT count(*) FROM articles) + count(*) FILTER (WHERE NOT known) AS total_articles
    FROM flagged""",
)
def ingest_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ingest_counts(_incoming(spark, sf_dir), _existing(spark, sf_dir))


@query(
    "cap_corpus",
    f"""{_SQL_ARTICLES} SELECT ingest_seq, url FROM articles ORDER BY ingest_seq LIMIT 300""",
)
def cap_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cap_corpus(_existing(spark, sf_dir), 300)


@query(
    "cap_corpus_newest",
    f"""{_SQL_ARTICLES} SELECT ingest_seq, url FROM articles ORDER BY ingest_seq DESC LIMIT 300""",
)
def cap_corpus_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cap_corpus(_existing(spark, sf_dir), 300, keep="newest")


@query(
    "index_drift",
    f"""{_SQL_ARTICLES}, joined AS (
      SELECT a.article_id AS corpus_id, p.page_id AS index_id, a.url AS corpus_url,
             {b.SQL_CLEAN_URL.format("p.url")} AS index_url
      FROM articles a FULL JOIN pages p ON p.page_id = a.article_id),
    counted AS (
      SELECT count(corpus_id) AS corpus_rows, count(index_id) AS index_rows,
             count(*) FILTER (WHERE corpus_id IS NOT NULL AND index_id IS NOT NULL
                              AND corpus_url <> index_url) AS moved,
             count(*) FILTER (WHERE index_id IS NULL) AS not_indexed,
             count(*) FILTER (WHERE corpus_id IS NULL) AS stale
      FROM joined)
    SELECT *, moved + not_indexed + stale = 0 AS aligned FROM counted""",
)
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.articles(spark, sf_dir).select(F.col("article_id").alias("position"), "url")
    index = b.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"), urls.clean_url(F.col("url")).alias("url")
    )
    return ops.index_drift(corpus, index)


@query(
    "feed_link_dedup",
    f"""{_SQL_ARTICLES}, {b.SQL_ENTRIES}
    SELECT link, source_name, ingest_seq FROM entries WHERE link <> ''
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY pos, ingest_seq) = 1""",
)
def feed_link_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ops.first_link_across_feeds(b.feed_entries(spark, sf_dir))
    return first.select("link", "source_name", "ingest_seq")


@query(
    "articles_per_feed",
    f"""{_SQL_ARTICLES}, {b.SQL_ENTRIES}
    SELECT source_name, count(*) AS article_count FROM entries GROUP BY source_name""",
)
def articles_per_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.articles_per_feed(b.feed_entries(spark, sf_dir))


@query(
    "feed_stats",
    f"""{_SQL_ARTICLES}, names(name, slug, pos) AS (
      VALUES ('Casino Wire', 'casino', 0), ('Blog Network', 'blogs', 1), ('Com Press', 'com', 2),
             ('Org Press', 'org', 3), ('Quiet Press', 'quiet', 4)),
    counted AS (
      SELECT {b.SQL_PUBLISHER.format("domain")} AS name, count(*) AS n, max(published) AS latest
      FROM articles GROUP BY 1)
    SELECT name, slug, pos, coalesce(n, 0) AS article_count,
           {b.SQL_TS.format("latest")} AS last_article_time
    FROM names LEFT JOIN counted USING (name)""",
)
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.feed_stats(b.articles(spark, sf_dir), b.TEST_PUBLISHERS)


@query(
    "lookup_by_url",
    f"""{_SQL_ARTICLES}, {b.SQL_ENTRIES}, wanted AS (SELECT DISTINCT link AS url FROM entries),
    first_ids AS (SELECT url, min(article_id) AS article_id FROM articles GROUP BY url)
    SELECT url, article_id FROM wanted LEFT JOIN first_ids USING (url)""",
)
def lookup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = b.feed_entries(spark, sf_dir).select(F.col("link").alias("url"))
    return ops.lookup_by_url(b.articles(spark, sf_dir), wanted)
