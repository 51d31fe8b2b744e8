"""Registered queries: vectors, search, near duplicates, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions import scores
from tidings.functions import vectors as vec
from tidings.operators import clustering, encode, search, similarity, sparse, views
from tidings.plans import bindings as b
from tidings.plans.registry import query
from tidings.sources.layout import materialize

# The test vectors are far apart, so pairs are built well below the default threshold.
PAIR_THRESHOLD = 0.35
LOOSE_THRESHOLD = 0.2
VIEW_THRESHOLD = 0.4
QUERY_ARTICLE = 7

_SQL_CENTROIDS = """
dims AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vectors),
means AS (SELECT label, dim, avg(x) AS value FROM dims GROUP BY label, dim),
centres AS (SELECT label AS cluster_id, list(value ORDER BY dim) AS c FROM means GROUP BY label)
"""


def _sql_pairs(threshold: float, k: int = 10) -> str:
    return f"""
scored AS (
  SELECT a.id, o.id AS other, list_inner_product(a.v, o.v) / (a.length * o.length) AS similarity
  FROM units a JOIN units o ON a.id <> o.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank
  FROM scored WHERE similarity > {threshold}),
folded AS (
  SELECT least(id, other) AS a_id, greatest(id, other) AS b_id, max(similarity) AS similarity
  FROM ranked WHERE rank <= {k} GROUP BY 1, 2),
pairs AS (
  SELECT f.*, a.title AS a_title, a.url AS a_url, o.title AS b_title, o.url AS b_url
  FROM folded f JOIN articles a ON a.article_id = f.a_id JOIN articles o ON o.article_id = f.b_id
  WHERE a.url <> '' AND o.url <> '' AND a.url <> o.url)
"""


_SQL_PAIRS = f"WITH {b.SQL_ARTICLES}, {b.SQL_UNITS}, {_sql_pairs(PAIR_THRESHOLD)}"


def pairs(spark: SparkSession, sf_dir: str, threshold: float = PAIR_THRESHOLD, **options) -> DataFrame:
    return similarity.near_duplicates(
        b.vectors(spark, sf_dir), b.articles(spark, sf_dir), threshold=threshold, **options
    )


@query(
    "l2_normalize",
    f"""WITH {b.SQL_UNITS}, scaled AS (
      SELECT id, list_transform(v, lambda x: x / length) AS u, v, length FROM units),
    dims AS (SELECT id, unnest(u) AS x, unnest(range(len(u))) AS dim FROM scaled)
    SELECT id AS article_id, dim::INTEGER AS dim, round(x, 6) AS x FROM dims""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = b.vectors(spark, sf_dir).select("article_id", vec.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("article_id", F.posexplode("u").alias("dim", "x")).select(
        "article_id", "dim", F.round("x", 6).alias("x")
    )


@query(
    "centroids",
    f"""WITH {b.SQL_UNITS}, {_SQL_CENTROIDS}
    SELECT label AS cluster_id, dim::INTEGER AS dim, round(value, 6) AS value FROM means""",
)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.centroids(b.vectors(spark, sf_dir))
    return found.select("cluster_id", "dim", F.round("value", 6).alias("value"))


def _to_own_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = b.vectors(spark, sf_dir)
    joined = vectors.join(clustering.centroid_vectors(vectors), "cluster_id")
    return joined.select(
        "article_id", "cluster_id", vec.cosine(F.col("embedding"), F.col("centroid")).alias("score")
    )


_SQL_OWN_CENTROID = f"""
WITH {b.SQL_UNITS}, {_SQL_CENTROIDS}, own AS (
  SELECT u.id AS article_id, u.label AS cluster_id,
         list_inner_product(u.v, c.c) / (u.length * sqrt(list_inner_product(c.c, c.c))) AS score
  FROM units u JOIN centres c ON c.cluster_id = u.label)
"""


@query(
    "cosine_pairs",
    f"{_SQL_OWN_CENTROID} SELECT article_id, cluster_id, round(score, 6) AS score FROM own",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_own_centroid(spark, sf_dir).select(
        "article_id", "cluster_id", F.round("score", 6).alias("score")
    )


@query(
    "score_bands",
    f"""{_SQL_OWN_CENTROID} SELECT article_id,
      CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS score_band,
      CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.92 THEN 'medium' ELSE 'low' END
        AS similarity_band
    FROM own""",
)
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_own_centroid(spark, sf_dir).select(
        "article_id",
        scores.score_band(F.col("score")).alias("score_band"),
        scores.similarity_band(F.col("score")).alias("similarity_band"),
    )


_SQL_DISTANCES = f"""
WITH {b.SQL_UNITS}, {_SQL_CENTROIDS}, distances AS (
  SELECT u.id, c.cluster_id, list_sum(list_transform(range(1, len(u.v) + 1),
           lambda i: (u.v[i] - c.c[i]) * (u.v[i] - c.c[i]))) AS d
  FROM units u CROSS JOIN centres c),
nearest AS (
  SELECT id AS article_id, cluster_id, d FROM distances
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) = 1)
"""


@query(
    "assign_to_centroids",
    f"{_SQL_DISTANCES} SELECT article_id, cluster_id, round(d, 6) AS distance2 FROM nearest",
)
def assign_to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = b.vectors(spark, sf_dir)
    assigned = clustering.assign_to_centroids(
        vectors.drop("cluster_id"), clustering.centroid_vectors(vectors)
    )
    return assigned.withColumn("distance2", F.round("distance2", 6))


@query(
    "inertia_given_centroids", f"{_SQL_DISTANCES} SELECT round(sum(d), 4) AS inertia FROM nearest"
)
def inertia_given_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = b.vectors(spark, sf_dir)
    found = clustering.inertia(vectors.drop("cluster_id"), clustering.centroid_vectors(vectors))
    return found.select(F.round("inertia", 4).alias("inertia"))


@query(
    "elbow_curvature",
    f"""{_SQL_DISTANCES}, running AS (
      SELECT row_number() OVER w AS k, min(d) OVER w AS m FROM distances
      WINDOW w AS (PARTITION BY id ORDER BY cluster_id)),
    curve AS (SELECT k, sum(m) AS y FROM running GROUP BY k),
    first_order AS (
      SELECT k, y, CASE WHEN lag(y) OVER o IS NULL THEN lead(y) OVER o - y
                        WHEN lead(y) OVER o IS NULL THEN y - lag(y) OVER o
                        ELSE (lead(y) OVER o - lag(y) OVER o) / 2 END AS s
      FROM curve WINDOW o AS (ORDER BY k)),
    second_order AS (
      SELECT k, y, s, CASE WHEN lag(s) OVER o IS NULL THEN lead(s) OVER o - s
                           WHEN lead(s) OVER o IS NULL THEN s - lag(s) OVER o
                           ELSE (lead(s) OVER o - lag(s) OVER o) / 2 END AS c
      FROM first_order WINDOW o AS (ORDER BY k))
    SELECT k::INTEGER AS k, round(y, 4) AS inertia, round(s, 4) AS slope, round(c, 4) AS curvature,
           k = (SELECT k FROM second_order
                WHERE k > (SELECT min(k) FROM second_order) AND k < (SELECT max(k) FROM second_order)
                ORDER BY abs(c) DESC, k LIMIT 1) AS is_elbow
    FROM second_order""",
)
def elbow_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = b.vectors(spark, sf_dir)
    curve = clustering.prefix_inertia_curve(
        vectors.drop("cluster_id"), clustering.centroid_vectors(vectors)
    )
    elbow = clustering.elbow_by_curvature(curve).withColumnRenamed("k", "_elbow")
    return clustering.curvature(curve).crossJoin(F.broadcast(elbow)).select(
        "k",
        *[F.round(name, 4).alias(name) for name in ("inertia", "slope", "curvature")],
        (F.col("k") == F.col("_elbow")).alias("is_elbow"),
    )


_SQL_HITS = f"""
WITH {b.SQL_ARTICLES}, {b.SQL_UNITS}, target AS (SELECT * FROM units WHERE id = {QUERY_ARTICLE}),
hits AS (
  SELECT u.id AS article_id, list_inner_product(u.v, t.v) / (u.length * t.length) AS score
  FROM units u CROSS JOIN target t)
"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "semantic_topk",
    f"""{_SQL_HITS}, top AS (
      SELECT *, row_number() OVER (ORDER BY score DESC, article_id) AS rank FROM hits)
    SELECT article_id, round(score, 6) AS score, rank, coalesce(md5(title), md5('')) AS title_md5,
           coalesce(url, '') AS url, coalesce(domain, '') AS domain
    FROM top LEFT JOIN articles USING (article_id) WHERE rank <= 10""",
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.vectors(spark, sf_dir)
    hits = search.search(corpus, search.vector_of(corpus, QUERY_ARTICLE))
    described = search.describe_hits(_rounded(hits), b.articles(spark, sf_dir))
    return described.select(
        "article_id", "score", "rank", F.md5("title").alias("title_md5"), "url", "domain"
    )


@query(
    "semantic_topk_batch",
    f"""WITH {b.SQL_UNITS}, {_SQL_CENTROIDS}, hits AS (
      SELECT c.cluster_id AS query_id, u.id AS article_id, list_inner_product(u.v, c.c) /
        (u.length * sqrt(list_inner_product(c.c, c.c))) AS score
      FROM units u CROSS JOIN centres c),
    top AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank
      FROM hits)
    SELECT query_id::BIGINT AS query_id, article_id, round(score, 6) AS score, rank
    FROM top WHERE rank <= 10""",
)
def semantic_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = b.vectors(spark, sf_dir)
    queries = clustering.centroid_vectors(corpus).select(
        F.col("cluster_id").alias("query_id"), F.col("centroid").alias("embedding")
    )
    return _rounded(search.search_many(corpus, queries))


@query(
    "find_similar",
    f"""{_SQL_HITS}, top AS (
      SELECT *, row_number() OVER (ORDER BY score DESC, article_id) AS rank
      FROM hits WHERE article_id <> {QUERY_ARTICLE})
    SELECT article_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10""",
)
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.find_similar(b.vectors(spark, sf_dir), QUERY_ARTICLE))


@query(
    "semantic_topk_filtered",
    f"""{_SQL_HITS}, top AS (
      SELECT h.*, row_number() OVER (ORDER BY score DESC, article_id) AS rank
      FROM hits h JOIN articles USING (article_id)
      WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press'))
    SELECT article_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10""",
)
def semantic_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, exact=True)


@query(
    "semantic_topk_overfetch",
    f"""{_SQL_HITS}, fetched AS (SELECT * FROM hits ORDER BY score DESC, article_id LIMIT 100),
    top AS (
      SELECT f.*, row_number() OVER (ORDER BY score DESC, article_id) AS rank
      FROM fetched f JOIN articles USING (article_id)
      WHERE {b.SQL_PUBLISHER.format("domain")} IN ('Blog Network', 'Org Press'))
    SELECT article_id, round(score, 6) AS score, rank FROM top WHERE rank <= 10""",
)
def semantic_topk_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, exact=False)


def _filtered(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    corpus = b.vectors(spark, sf_dir).drop("cluster_id")
    vector = search.vector_of(corpus, QUERY_ARTICLE)
    hits = search.search_sources(
        corpus, b.articles(spark, sf_dir), vector, b.TEST_SLUGS, exact=exact, configured=b.TEST_PUBLISHERS
    )
    return _rounded(hits.select("article_id", "score", "rank"))


_PAIR_COLUMNS = "a_id, md5(a_title) AS a_title_md5, a_url, b_id, md5(b_title) AS b_title_md5, b_url"


def _hashed_titles(found: DataFrame) -> DataFrame:
    return found.select(
        "a_id", F.md5("a_title").alias("a_title_md5"), "a_url",
        "b_id", F.md5("b_title").alias("b_title_md5"), "b_url",
        F.round("similarity", 6).alias("similarity"),
    )


@query(
    "near_duplicates",
    f"""WITH {b.SQL_ARTICLES}, {b.SQL_UNITS}, {_sql_pairs(LOOSE_THRESHOLD)}
    SELECT {_PAIR_COLUMNS}, round(similarity, 6) AS similarity FROM pairs""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_titles(pairs(spark, sf_dir, LOOSE_THRESHOLD))


@query(
    "duplicate_threshold_view",
    f"""{_SQL_PAIRS} SELECT a_id, b_id, round(similarity, 6) AS similarity
    FROM pairs WHERE similarity >= {VIEW_THRESHOLD}""",
)
def duplicate_threshold_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = similarity.at_least_as_similar(pairs(spark, sf_dir), VIEW_THRESHOLD)
    return seen.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


_SQL_ENRICHED = f"""{_SQL_PAIRS}, enriched AS (
  SELECT p.similarity, p.a_id, coalesce(nullif(trim(p.a_title), ''), 'Untitled') AS a_title, p.a_url,
         coalesce(nullif(a.domain, ''), 'unknown') AS a_domain,
         coalesce(nullif(a.date, ''), '—') AS a_date,
         p.b_id, coalesce(nullif(trim(p.b_title), ''), 'Untitled') AS b_title, p.b_url,
         coalesce(nullif(o.domain, ''), 'unknown') AS b_domain,
         coalesce(nullif(o.date, ''), '—') AS b_date
  FROM pairs p LEFT JOIN articles a ON a.article_id = p.a_id
  LEFT JOIN articles o ON o.article_id = p.b_id)
"""


@query(
    "duplicate_enrich",
    f"""{_SQL_ENRICHED} SELECT a_id, b_id, md5(a_title) AS a_title_md5, a_domain, a_date,
      md5(b_title) AS b_title_md5, b_domain, b_date FROM enriched""",
)
def duplicate_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = views.enrich_pairs(pairs(spark, sf_dir), b.articles(spark, sf_dir))
    return full.select(
        "a_id", "b_id", F.md5("a_title").alias("a_title_md5"), "a_domain", "a_date",
        F.md5("b_title").alias("b_title_md5"), "b_domain", "b_date",
    )


@query(
    "duplicate_export",
    f"""{_SQL_ENRICHED} SELECT round(similarity, 6) AS similarity, a_id AS article_a_id,
      a_title AS article_a_title, a_url AS article_a_url, a_domain AS article_a_domain,
      a_date AS article_a_date, b_id AS article_b_id, b_title AS article_b_title,
      b_url AS article_b_url, b_domain AS article_b_domain, b_date AS article_b_date
    FROM enriched""",
)
def duplicate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = views.enrich_pairs(pairs(spark, sf_dir), b.articles(spark, sf_dir))
    return views.duplicate_export(full).withColumn("similarity", F.round("similarity", 6))


@query(
    "corpus_kpis",
    f"""{_SQL_PAIRS}
    SELECT (SELECT count(*) FROM articles) AS articles,
           (SELECT count(DISTINCT label) FROM embeddings) AS clusters,
           (SELECT count(*) FROM pairs) AS duplicate_pairs,
           round((SELECT count(*) FROM pairs) / (SELECT count(*) FROM articles) * 100, 1)
             AS duplicate_pct""",
)
def corpus_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.corpus_kpis(b.articles(spark, sf_dir), b.clusters(spark, sf_dir), pairs(spark, sf_dir))


@query(
    "knn_exact",
    f"""WITH {b.SQL_UNITS}, scored AS (
      SELECT a.id, o.id AS other, list_inner_product(a.v, o.v) / (a.length * o.length) AS similarity
      FROM units a JOIN units o ON a.id <> o.id),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank
      FROM scored)
    SELECT id, other, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 10""",
)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.nearest_neighbours(b.vectors(spark, sf_dir))
    return found.select(
        "id", "other", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


_SQL_TWIN_PAIRS = f"""WITH {b.SQL_TWINS}, scored AS (
  SELECT a.id, o.id AS other, list_inner_product(a.v, o.v) / (a.length * o.length) AS similarity
  FROM units a JOIN units o ON a.id <> o.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank
  FROM scored WHERE similarity > {similarity.SIMILARITY_THRESHOLD})
"""


@query(
    "knn_lsh",
    f"{_SQL_TWIN_PAIRS} SELECT id, other, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 10",
)
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.nearest_neighbours(
        b.twins(spark, sf_dir), threshold=similarity.SIMILARITY_THRESHOLD, method="lsh"
    )
    return found.select(
        "id", "other", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "near_duplicates_lsh",
    f"""{_SQL_TWIN_PAIRS} SELECT least(id, other) AS a_id, greatest(id, other) AS b_id,
      round(max(similarity), 6) AS similarity FROM ranked WHERE rank <= 10 GROUP BY 1, 2""",
)
def near_duplicates_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at the default threshold, among all vectors and their slightly bent twins."""
    vectors = b.twins(spark, sf_dir)
    named = vectors.select(
        "article_id", F.lit("").alias("title"), F.concat(F.lit("v/"), F.col("article_id").cast("string")).alias("url")
    )
    found = similarity.near_duplicates(vectors, named, method="lsh")
    return found.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query(
    "near_duplicates_cells",
    f"""{_SQL_TWIN_PAIRS} SELECT least(id, other) AS a_id, greatest(id, other) AS b_id,
      round(max(similarity), 6) AS similarity FROM ranked WHERE rank <= 10 GROUP BY 1, 2""",
)
def near_duplicates_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by the exact index of cells and rings."""
    edges = similarity.nearest_neighbours(b.twins(spark, sf_dir), threshold=similarity.SIMILARITY_THRESHOLD)
    return edges.groupBy(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).agg(
        F.round(F.max("similarity"), 6).alias("similarity")
    )


@query("embed_documents_hashed")
def embed_documents_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = b.texts(spark, sf_dir).select("doc_id", "text")
    encoder = encode.fit_text_encoder(documents)
    return encode.encode_texts(documents, encoder).select("doc_id", "embedding")


_SQL_WORD_WEIGHTS = """
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY ALL),
seen AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
raw_weights AS (
  SELECT doc_id, word, df, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + df)) + 1) AS w
  FROM tf JOIN seen USING (word)),
weights AS (SELECT doc_id, word, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_weights)
"""


@query("embed_documents", f"WITH {_SQL_WORD_WEIGHTS} SELECT doc_id, word, df, round(weight, 6) AS weight FROM weights")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of all documents over the exact vocabulary, a row per weight."""
    weights = sparse.word_weights(b.texts(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "near_duplicate_documents",
    f"""WITH {b.SQL_ARTICLES}, {_SQL_WORD_WEIGHTS}, scored AS (
      SELECT a.doc_id AS id, o.doc_id AS other, round(sum(a.weight * o.weight), {sparse.DECIMALS}) AS similarity
      FROM weights a JOIN weights o ON a.word = o.word AND a.doc_id <> o.doc_id GROUP BY 1, 2),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank
      FROM scored WHERE similarity > {similarity.SIMILARITY_THRESHOLD}),
    folded AS (
      SELECT least(id, other) AS a_id, greatest(id, other) AS b_id, max(similarity) AS similarity
      FROM ranked WHERE rank <= 10 GROUP BY 1, 2)
    SELECT a_id, md5(a.title) AS a_title_md5, a.url AS a_url, b_id, md5(o.title) AS b_title_md5, o.url AS b_url,
           round(similarity, 6) AS similarity
    FROM folded f JOIN articles a ON a.article_id = f.a_id JOIN articles o ON o.article_id = f.b_id
    WHERE a.url <> '' AND o.url <> '' AND a.url <> o.url""",
)
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sparse vector, compared at the default threshold."""
    vectors = sparse.sparse_vectors(sparse.word_weights(b.texts(spark, sf_dir), nested=True))
    edges = sparse.sparse_neighbours(vectors, similarity.NEIGHBOURS, similarity.SIMILARITY_THRESHOLD)
    return _hashed_titles(similarity.pairs_of(edges, b.articles(spark, sf_dir)))


@query("kmeans_inertia_curve")
def kmeans_inertia_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = materialize(clustering.unit_features(b.vectors(spark, sf_dir)))
    return spark.createDataFrame(clustering.inertia_curve(features), "k INT, inertia DOUBLE")


@query("choose_k")
def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at the elbow of the curve over the whole range."""
    features = materialize(clustering.unit_features(b.vectors(spark, sf_dir)))
    return spark.createDataFrame([(clustering.choose_k(features),)], "k INT")


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster_corpus(b.vectors(spark, sf_dir))
    return found.points.select("article_id", "cluster_id", "x", "y")


@query("pca_2d")
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.pca_2d(clustering.unit_features(b.vectors(spark, sf_dir)))
