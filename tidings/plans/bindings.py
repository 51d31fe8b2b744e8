"""How the generic test tables stand in for a news corpus, once for Spark and once for SQL.

* articles: every document; its first line is the title, the rest the description. The url is the
  page of the same id or one made from source, language and id; the date is the earliest of the ten
  events that share the id's decade.
* clusters, coordinates: every vector; its label is the cluster, its first two components the place.
* topics: the languages of a cluster, most frequent first, as its keywords.
* feeds: pages under their publishers and documents under one archive carry the same links in part;
  every source has a list position of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import dates, publishers, scores, urls
from tidings.functions.publishers import Publisher
from tidings.sources.layout import spread_few_splits

# Publishers found in the test pages; order matters where patterns overlap.
TEST_PUBLISHERS = (
    Publisher("Casino Wire", "casino", "business", ("casino-win", "free-bets")),
    Publisher("Blog Network", "blogs", "world", ("blog.", "m.th")),
    Publisher("Com Press", "com", "tech", ("example.com",)),
    Publisher("Org Press", "org", "world", ("example.org",)),
    Publisher("Quiet Press", "quiet", "world", ("nobody.invalid",)),
)
TEST_SLUGS = ("blogs", "org", "unknown")

SQL_DOMAIN = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
SQL_CLEAN_URL = """
regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '([?&])(utm_source|utm_medium|utm_campaign|utm_content|ref|source)=[^&#]*', '\\1', 'g'),
  '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+(#|$)', '\\1')
"""
SQL_PUBLISHER = """
CASE WHEN {0} LIKE '%casino-win%' OR {0} LIKE '%free-bets%' THEN 'Casino Wire'
     WHEN {0} LIKE '%blog.%' OR {0} LIKE '%m.th%' THEN 'Blog Network'
     WHEN {0} LIKE '%example.com%' THEN 'Com Press'
     WHEN {0} LIKE '%example.org%' THEN 'Org Press'
     WHEN {0} LIKE '%nobody.invalid%' THEN 'Quiet Press' END
"""
# HTML allows the old entities without their semicolon, which cut-off page titles do have.
SQL_ENTITIES = """
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace({0}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
  '&nbsp;?', chr(160), 'g'), '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'),
  '&amp;?', '&', 'g')
"""
SQL_STRIP_HTML = f"""
trim(regexp_replace(regexp_replace({SQL_ENTITIES}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))
"""
SQL_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

SQL_ARTICLES = f"""
raw_articles AS (
  SELECT d.doc_id AS article_id, d.doc_id AS ingest_seq, d.lang, d.source, d.text,
         split_part(d.text, chr(10), 1) AS title,
         substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS description,
         coalesce(p.url, 'https://' || d.source || '.example.org/' || d.lang || '/' || d.doc_id) AS url,
         v.published
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN (SELECT event_id // 10 AS doc_id, min(ts) AS published FROM events GROUP BY 1) v
    ON v.doc_id = d.doc_id),
articles AS (
  SELECT *, {SQL_DOMAIN.format("url")} AS domain,
         coalesce({SQL_TS.format("published")}, '') AS date
  FROM raw_articles)
"""
SQL_CLUSTERS = """
clusters AS (SELECT vec_id AS article_id, label AS cluster_id FROM embeddings),
points AS (
  SELECT vec_id AS article_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
"""
SQL_TOPICS = """
topic_ranks AS (
  SELECT c.cluster_id, a.lang,
         row_number() OVER (PARTITION BY c.cluster_id ORDER BY count(*) DESC, a.lang) AS rank
  FROM clusters c JOIN articles a USING (article_id) GROUP BY c.cluster_id, a.lang),
topics AS (
  SELECT cluster_id, list(lang ORDER BY rank) AS keywords,
         string_agg(lang, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS label
  FROM topic_ranks GROUP BY cluster_id)
"""
SQL_CORPUS = f"{SQL_ARTICLES}, {SQL_CLUSTERS}, {SQL_TOPICS}"
SQL_ENTRIES = f"""
page_entries AS (
  SELECT page_id AS ingest_seq, {SQL_CLEAN_URL.format("url")} AS link,
         coalesce({SQL_PUBLISHER.format(SQL_DOMAIN.format("url"))}, 'Other') AS source_name
  FROM pages),
entries AS (
  SELECT ingest_seq, link, source_name,
         CASE source_name WHEN 'Casino Wire' THEN 0 WHEN 'Blog Network' THEN 1
           WHEN 'Com Press' THEN 2 WHEN 'Org Press' THEN 3 ELSE 9 END AS pos
  FROM page_entries
  UNION ALL
  SELECT ingest_seq, {SQL_CLEAN_URL.format("url")}, 'Archive', 5 FROM articles)
"""
SQL_UNITS = """
vectors AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
            FROM embeddings),
units AS (SELECT id, label, v, sqrt(list_inner_product(v, v)) AS length FROM vectors)
"""
# Every vector has a twin whose components are a tenth smaller, equal and a tenth larger in turn.
SQL_TWINS = """
vectors AS (SELECT vec_id * 2 AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  UNION ALL SELECT vec_id * 2 + 1, list_transform(range(1, len(embedding) + 1), lambda i:
    (embedding[i]::DOUBLE * (0.9 + 0.1 * ((i - 1) % 3)))::FLOAT::DOUBLE) FROM embeddings),
units AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS length FROM vectors)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that reads every text; the test tables hold one row group each."""
    return spread_few_splits(table(spark, sf_dir, "documents"), "doc_id")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for work that reads every page."""
    return spread_few_splits(table(spark, sf_dir, "pages"), "page_id")


def articles(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    documents = texts(spark, sf_dir) if spread else table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    published = (
        table(spark, sf_dir, "events")
        .groupBy(F.expr("event_id DIV 10").alias("doc_id"))
        .agg(F.min("ts").alias("published"))
    )
    # Before the joins, so that texts do not travel where only titles are asked for.
    documents = documents.withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    made_url = F.concat(
        F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"),
        F.col("doc_id").cast("string"),
    )
    url = F.coalesce("url", made_url)
    return (
        documents.join(pages, "doc_id", "left")
        .join(published, "doc_id", "left")
        .select(
            F.col("doc_id").alias("article_id"),
            F.col("doc_id").alias("ingest_seq"),
            "lang",
            "source",
            "text",
            "title",
            F.col("text").substr(F.length("title") + 2, F.length("text")).alias("description"),
            url.alias("url"),
            urls.domain_of(url).alias("domain"),
            "published",
            F.coalesce(dates.timestamp_text(F.col("published")), F.lit("")).alias("date"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), "embedding", F.col("label").alias("cluster_id")
    )


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors (even ids) and their slightly bent twins (odd ids)."""
    own = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2).alias("article_id"), "embedding")
    bent = F.transform(
        "embedding",
        lambda x, i: (x.cast("double") * (F.lit(0.9) + F.lit(0.1) * (i % 3).cast("double"))).cast("float"),
    )
    return own.unionByName(own.select((F.col("article_id") + 1).alias("article_id"), bent.alias("embedding")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("article_id", "cluster_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(
        "article_id",
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = (
        clusters(spark, sf_dir)
        .join(articles(spark, sf_dir).select("article_id", "lang"), "article_id")
        .groupBy("cluster_id", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One element per language and cluster.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "lang")))
    keywords = counted.groupBy("cluster_id").agg(ranked.alias("_r")).select(
        "cluster_id", F.transform("_r", lambda r: r["lang"]).alias("keywords")
    )
    return keywords.withColumn("label", scores.topic_label(F.col("keywords")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster members with the article fields trending needs; stale members keep NULL fields."""
    fields = articles(spark, sf_dir).select("article_id", "title", "url", "published")
    return clusters(spark, sf_dir).join(fields, "article_id", "left")


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a dated member of the cluster named by its type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("cluster_id"),
        F.col("event_id").alias("article_id"),
        F.col("ts").alias("published"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = F.coalesce(
        publishers.publisher_of(urls.domain_of(F.col("url")), TEST_PUBLISHERS), F.lit("Other")
    )
    position = F.lit(9)
    for pos, publisher in enumerate(TEST_PUBLISHERS):
        position = F.when(name == publisher.name, F.lit(pos)).otherwise(position)
    from_pages = pages.select(
        F.col("page_id").alias("ingest_seq"),
        urls.clean_url(F.col("url")).alias("link"),
        name.alias("source_name"),
        position.alias("pos"),
    )
    from_documents = articles(spark, sf_dir).select(
        "ingest_seq",
        urls.clean_url(F.col("url")).alias("link"),
        F.lit("Archive").alias("source_name"),
        F.lit(5).alias("pos"),
    )
    return from_pages.unionByName(from_documents)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and raw pages as one stream of uncleaned records, interleaved by id."""
    pages = web_pages(spark, sf_dir).select(
        (F.col("page_id") * 2 + 1).alias("ingest_seq"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("description"),
        "url",
        F.lit("").alias("date"),
        F.lit("").alias("domain"),
    )
    documents = articles(spark, sf_dir, spread=True).select(
        (F.col("ingest_seq") * 2).alias("ingest_seq"), "title", "description", "url", "date", "domain"
    )
    return documents.unionByName(pages)


SQL_RAW = """
raw AS (
  SELECT ingest_seq * 2 AS ingest_seq, title, description, url, date, domain FROM articles
  UNION ALL
  SELECT page_id * 2 + 1, regexp_extract(html, '(?s)<title>(.*?)</title>', 1), html, url, '', ''
  FROM pages)
"""
