"""Registered queries: trending, topics and the cluster views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import dates
from tidings.operators import clustering, topics, trending, views
from tidings.plans import bindings as b
from tidings.plans.registry import query

_SQL = f"WITH {b.SQL_CORPUS}"

_SQL_EVENT_COUNTS = """
event_members AS (SELECT {key} AS cluster_id, event_id AS article_id, ts AS published FROM events),
event_counts AS (
  SELECT cluster_id,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 24 HOUR) AS count_24h,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 48 HOUR) AS count_48h,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 168 HOUR) AS count_7d,
         count(*) AS total
  FROM event_members CROSS JOIN (SELECT max(ts) AS ref FROM events) r GROUP BY cluster_id),
event_scores AS (
  SELECT *, round_even((count_24h * 3.0::DOUBLE + count_48h * 1.5::DOUBLE + count_7d * 0.5::DOUBLE)
                       / total, 4) AS trending_score
  FROM event_counts)
"""
_SQL_BY_TYPE = "WITH " + _SQL_EVENT_COUNTS.format(key="event_type")
_SQL_BY_USER = f"{_SQL}, " + _SQL_EVENT_COUNTS.format(key="user_id::INTEGER")


def _user_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("cluster_id"),
        F.col("event_id").alias("article_id"),
        F.col("ts").alias("published"),
    )


@query(
    "recent_counts",
    f"{_SQL_BY_TYPE} SELECT cluster_id, count_24h, count_48h, count_7d, total FROM event_counts",
)
def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.recent_counts(b.event_members(spark, sf_dir))


@query("trending_score", f"{_SQL_BY_TYPE} SELECT cluster_id, trending_score FROM event_scores")
def trending_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trending.with_score(trending.recent_counts(b.event_members(spark, sf_dir)))
    return scored.select("cluster_id", "trending_score")


@query(
    "trending_reference",
    f"""SELECT {b.SQL_TS.format("max(ts)")} AS auto_reference,
      '2024-01-15 12:00:00' AS fixed_reference, {b.SQL_TS.format("max(ts)")} AS fallback_reference
    FROM events""",
)
def trending_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = b.event_members(spark, sf_dir)

    def shown(reference: str, name: str) -> DataFrame:
        frame = trending.reference_frame(members, reference)
        return frame.select(dates.timestamp_text(F.col("reference")).alias(name))

    fixed = shown("Mon, 15 Jan 2024 12:00:00 +0200", "fixed_reference")
    return shown("auto", "auto_reference").crossJoin(fixed).crossJoin(
        shown("no date at all", "fallback_reference")
    )


_SQL_TRENDING = f"""{_SQL},
members AS (
  SELECT c.cluster_id, c.article_id, a.title, a.url, a.published
  FROM clusters c LEFT JOIN articles a USING (article_id)),
counts AS (
  SELECT cluster_id,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 24 HOUR) AS count_24h,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 48 HOUR) AS count_48h,
         count(*) FILTER (WHERE published >= r.ref - INTERVAL 168 HOUR) AS count_7d,
         count(*) AS total
  FROM members CROSS JOIN (SELECT max(published) AS ref FROM members) r GROUP BY cluster_id),
trending AS (
  SELECT c.*, round_even((count_24h * 3.0::DOUBLE + count_48h * 1.5::DOUBLE + count_7d * 0.5::DOUBLE)
                         / total, 4) AS trending_score,
         coalesce(t.label, 'Cluster ' || c.cluster_id) AS label
  FROM counts c LEFT JOIN topics t USING (cluster_id)),
top_recent AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id
                               ORDER BY published DESC NULLS LAST, article_id) AS rank
  FROM members WHERE title IS NOT NULL OR url IS NOT NULL)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.trending(b.members(spark, sf_dir), b.topics(spark, sf_dir))


@query(
    "trending",
    f"""{_SQL_TRENDING}, tops AS (
      SELECT cluster_id, string_agg(article_id || ' ' || url || ' ' || coalesce({b.SQL_TS.format("published")}, ''), '|' ORDER BY rank)
        AS top_articles
      FROM top_recent WHERE rank <= 3 GROUP BY cluster_id)
    SELECT cluster_id, label, trending_score, count_24h, count_48h, count_7d, total, top_articles
    FROM trending LEFT JOIN tops USING (cluster_id)""",
)
def trending_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform(
        "top_articles",
        lambda a: F.concat_ws(" ", a["id"].cast("string"), a["url"], F.coalesce(a["date"], F.lit(""))),
    )
    return _ranked(spark, sf_dir).withColumn("top_articles", F.array_join(shown, "|"))


@query(
    "top_recent_per_cluster",
    f"""{_SQL_TRENDING} SELECT cluster_id, article_id, rank FROM top_recent WHERE rank <= 3""",
)
def top_recent_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = b.members(spark, sf_dir).filter("url IS NOT NULL")
    top = trending.top_recent(known)
    return top.select("cluster_id", "article_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "cluster_recent_articles",
    f"""{_SQL} SELECT article_id, url, date FROM clusters JOIN articles USING (article_id)
    WHERE cluster_id = 3 AND {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press')
    ORDER BY published DESC NULLS LAST, article_id LIMIT 10""",
)
def cluster_recent_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.operators.articles import filter_sources

    chosen = filter_sources(b.articles(spark, sf_dir), b.TEST_SLUGS, b.TEST_PUBLISHERS)
    joined = b.clusters(spark, sf_dir).join(chosen, "article_id")
    return trending.recent_of_cluster(joined, 3).select("article_id", "url", "date")


@query(
    "trending_top_n",
    f"""{_SQL_BY_USER} SELECT cluster_id, trending_score, count_24h FROM event_scores
    ORDER BY trending_score DESC, cluster_id LIMIT 10""",
)
def trending_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trending.with_score(trending.recent_counts(_user_members(spark, sf_dir)))
    return trending.top_trending(scored, 10).select("cluster_id", "trending_score", "count_24h")


@query(
    "trending_filtered",
    f"""{_SQL_BY_USER} SELECT cluster_id, trending_score FROM event_scores
    WHERE cluster_id IN (
      SELECT cluster_id FROM clusters JOIN articles USING (article_id)
      WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press'))""",
)
def trending_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trending.with_score(trending.recent_counts(_user_members(spark, sf_dir)))
    visible = views.cluster_sizes(
        b.clusters(spark, sf_dir), b.articles(spark, sf_dir), b.TEST_SLUGS, b.TEST_PUBLISHERS
    )
    return trending.restrict_to_clusters(scored, visible).select("cluster_id", "trending_score")


@query(
    "minmax_scale",
    f"""{_SQL_BY_USER}, bounds AS (
      SELECT min(trending_score) AS low, max(trending_score) AS high FROM event_scores)
    SELECT cluster_id, trending_score, CASE WHEN high <= low THEN 21
      ELSE floor(13.0::DOUBLE + (trending_score - low) / (high - low) * 17) END::INTEGER AS font_size
    FROM event_scores CROSS JOIN bounds""",
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trending.with_score(trending.recent_counts(_user_members(spark, sf_dir)))
    return views.with_font_sizes(scored.select("cluster_id", "trending_score"))


@query(
    "cluster_labels_default",
    f"""{_SQL_BY_USER}
    SELECT cluster_id, total, coalesce(label, 'Cluster ' || cluster_id) AS label
    FROM event_counts LEFT JOIN topics USING (cluster_id)""",
)
def cluster_labels_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _user_members(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("total"))
    return trending.label_clusters(sizes, b.topics(spark, sf_dir))


_SQL_SUMMARIES = f"""{_SQL_BY_USER}, summaries AS (
  SELECT cluster_id, coalesce(label, 'Cluster ' || cluster_id) AS label,
         array_to_string(coalesce(keywords, []), ',') AS keywords, total AS article_count
  FROM event_counts LEFT JOIN topics USING (cluster_id))
"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cluster_summaries(_user_members(spark, sf_dir), b.topics(spark, sf_dir))


@query("cluster_summaries", f"{_SQL_SUMMARIES} SELECT * FROM summaries")
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).withColumn("keywords", F.array_join("keywords", ","))


@query(
    "top_clusters_by_size",
    f"""{_SQL_SUMMARIES} SELECT cluster_id, label, article_count FROM summaries
    ORDER BY article_count DESC, cluster_id LIMIT 15""",
)
def top_clusters_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.top_clusters_by_size(_summaries(spark, sf_dir))
    return top.select("cluster_id", "label", "article_count")


@query(
    "top_clusters_by_trend",
    f"""{_SQL_TRENDING} SELECT cluster_id, label, trending_score, count_24h FROM trending
    ORDER BY trending_score DESC, cluster_id LIMIT 10""",
)
def top_clusters_by_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.top_clusters_by_trend(_ranked(spark, sf_dir))
    return top.select("cluster_id", "label", "trending_score", "count_24h")


@query(
    "trending_now",
    f"""{_SQL_TRENDING}, sizes AS (
      SELECT cluster_id, count(*) AS n FROM clusters JOIN articles USING (article_id)
      WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press') GROUP BY cluster_id)
    SELECT cluster_id, label, trending_score, coalesce(n::VARCHAR, '—') AS article_count
    FROM (SELECT * FROM trending ORDER BY trending_score DESC, cluster_id LIMIT 5)
    LEFT JOIN sizes USING (cluster_id)""",
)
def trending_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = views.cluster_sizes(
        b.clusters(spark, sf_dir), b.articles(spark, sf_dir), b.TEST_SLUGS, b.TEST_PUBLISHERS
    )
    return views.trending_now(_ranked(spark, sf_dir), sizes)


@query(
    "trending_windows",
    f"""SELECT event_type AS cluster_id, {b.SQL_TS.format("start")} AS window_start,
           count(*) AS article_count
    FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(back) AS start
          FROM events CROSS JOIN range(24) steps(back))
    GROUP BY 1, 2""",
)
def trending_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trending.trending_windows(b.event_members(spark, sf_dir))
    return found.withColumn("window_start", dates.timestamp_text(F.col("window_start")))


@query("cluster_sizes", "SELECT label AS cluster_id, count(*) AS article_count FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cluster_sizes(b.clusters(spark, sf_dir))


@query(
    "cluster_sizes_filtered",
    f"""{_SQL} SELECT cluster_id, count(*) AS article_count
    FROM clusters JOIN articles USING (article_id)
    WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press') GROUP BY cluster_id""",
)
def cluster_sizes_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cluster_sizes(
        b.clusters(spark, sf_dir), b.articles(spark, sf_dir), b.TEST_SLUGS, b.TEST_PUBLISHERS
    )


@query(
    "cluster_membership",
    """WITH parts AS (
      SELECT label AS cluster_id, vec_id // 1000 AS part,
             string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS article_ids
      FROM embeddings GROUP BY 1, 2)
    SELECT k.range::INTEGER AS cluster_id, coalesce(part, 0) AS part,
           coalesce(article_ids, '') AS article_ids
    FROM range(12) k LEFT JOIN parts ON parts.cluster_id = k.range""",
)
def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.cluster_membership(b.clusters(spark, sf_dir), k=12)
    joined = F.array_join(F.col("article_ids").cast("array<string>"), ",")
    return lists.withColumn("article_ids", joined)


@query(
    "cluster_points",
    f"""{_SQL} SELECT article_id, cluster_id, round(x, 6) AS x, round(y, 6) AS y,
      md5(coalesce(title, '')) AS title_md5, coalesce(url, '') AS url, coalesce(date, '') AS date,
      coalesce(domain, '') AS domain
    FROM clusters JOIN points USING (article_id) LEFT JOIN articles USING (article_id)""",
)
def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select(
        "article_id", "cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
        F.md5("title").alias("title_md5"), "url", "date", "domain",
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cluster_points(
        b.clusters(spark, sf_dir), b.points(spark, sf_dir), b.articles(spark, sf_dir)
    )


@query(
    "cluster_articles",
    f"""{_SQL} SELECT article_id, cluster_id, md5(title) AS title_md5, url, date, domain,
      round(x, 6) AS x, round(y, 6) AS y
    FROM clusters JOIN articles USING (article_id) LEFT JOIN points USING (article_id)
    WHERE cluster_id = 3""",
)
def cluster_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.cluster_articles(
        b.clusters(spark, sf_dir), b.articles(spark, sf_dir), 3, b.points(spark, sf_dir)
    )
    return found.select(
        "article_id", "cluster_id", F.md5("title").alias("title_md5"), "url", "date", "domain",
        F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
    )


@query(
    "cluster_scatter",
    f"""{_SQL} SELECT article_id, cluster_id, round(x, 6) AS x, round(y, 6) AS y,
      coalesce(label, 'Cluster ' || cluster_id) AS label,
      md5(coalesce(nullif(trim(title, ' ' || chr(9) || chr(10) || chr(13)), ''), 'Untitled'))
        AS title_md5,
      coalesce(nullif(domain, ''), 'unknown') AS domain, coalesce(nullif(date, ''), '—') AS date
    FROM clusters JOIN points USING (article_id) LEFT JOIN articles USING (article_id)
    LEFT JOIN topics USING (cluster_id)""",
)
def cluster_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.cluster_scatter(_points(spark, sf_dir), b.topics(spark, sf_dir))
    return flat.select(
        "article_id", "cluster_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label",
        F.md5("title").alias("title_md5"), "domain", "date",
    )


@query(
    "incremental_assign",
    f"""{_SQL} SELECT article_id, cluster_id, cluster_id IS NULL AS is_new
    FROM articles LEFT JOIN clusters USING (article_id)""",
)
def incremental_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.assign_unclustered(b.articles(spark, sf_dir), b.clusters(spark, sf_dir))


def _sql_tfidf(key: str, limit: str = "QUALIFY row_number() OVER (PARTITION BY k ORDER BY total DESC, term) <= 1000") -> str:
    from tidings.plans.queries_articles import _STOPS

    return f"""
WITH docs AS (SELECT doc_id, {key} AS k, text FROM documents),
filled AS (SELECT * FROM docs WHERE trim(text) <> ''),
words AS (
  SELECT doc_id, k, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                lambda w: NOT list_contains([{_STOPS}], w)) AS kept
  FROM filled),
terms AS (
  SELECT doc_id, k, unnest(list_concat(kept, list_transform(range(1, len(kept)),
           lambda i: kept[i] || ' ' || kept[i + 1]))) AS term
  FROM words),
tf AS (SELECT doc_id, k, term, count(*) AS tf FROM terms GROUP BY ALL),
stats AS (SELECT k, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
features AS (
  SELECT k, term, df FROM stats {limit}),
sizes AS (SELECT k, count(*) AS n FROM filled GROUP BY k),
weights AS (
  SELECT doc_id, k, term, n, tf * (ln((1 + n) / (1 + df)) + 1) AS w
  FROM tf JOIN features USING (k, term) JOIN sizes USING (k)),
scaled AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM weights),
scores AS (SELECT k, term, sum(u) / max(n) AS score FROM scaled GROUP BY k, term),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, term) AS rank
  FROM scores WHERE score > 0)
"""


@query(
    "cluster_tfidf",
    _sql_tfidf("lang")
    + "SELECT k AS cluster_id, rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 5",
)
def cluster_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").withColumnRenamed("lang", "cluster_id")
    found = topics.cluster_tfidf(documents, doc="doc_id", max_features=topics.MAX_FEATURES)
    return found.select(
        "cluster_id", F.col("rank").cast("bigint").alias("rank"), "term", F.round("score", 6).alias("score")
    )


@query(
    "cluster_tfidf_all_terms",
    _sql_tfidf("lang", "")
    + "SELECT k AS cluster_id, rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 5",
)
def cluster_tfidf_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").withColumnRenamed("lang", "cluster_id")
    found = topics.cluster_tfidf(documents, doc="doc_id")
    return found.select(
        "cluster_id", F.col("rank").cast("bigint").alias("rank"), "term", F.round("score", 6).alias("score")
    )


_SQL_TOPIC_ROWS = (
    _sql_tfidf("source")
    + """, words_per AS (
  SELECT k, string_agg(term, '|' ORDER BY rank) AS keywords,
         string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS label
  FROM ranked WHERE rank <= 5 GROUP BY k),
counts AS (SELECT k, count(*) AS article_count FROM docs GROUP BY k)
"""
)


@query(
    "cluster_topics",
    _SQL_TOPIC_ROWS
    + """SELECT k AS cluster_id, coalesce(keywords, '') AS keywords,
      coalesce(label, 'unlabeled cluster') AS label, article_count
    FROM counts LEFT JOIN words_per USING (k)""",
)
def cluster_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.table(spark, sf_dir, "documents").withColumnRenamed("source", "cluster_id")
    found = topics.cluster_topics(documents, doc="doc_id", max_features=topics.MAX_FEATURES)
    return found.withColumn("keywords", F.array_join("keywords", "|"))


@query("topic_labels", f"{_SQL} SELECT cluster_id, label FROM topics")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.topics(spark, sf_dir).select("cluster_id", "label")
