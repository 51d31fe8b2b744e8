import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidings.operators import clustering, topics, trending, views


def members(spark, rows):
    df = spark.createDataFrame(rows, "cluster_id INT, article_id BIGINT, d STRING, title STRING, url STRING")
    return df.withColumn("published", F.col("d").cast("timestamp_ntz")).drop("d")


def dated(spark, dates, cluster=0):
    return members(spark, [(cluster, i, d, f"t{i}", f"u{i}") for i, d in enumerate(dates)])


def test_recent_windows_are_cumulative(spark):
    df = dated(spark, ["2018-06-01 10:00:00", "2018-05-31 10:00:00", "2018-05-20 10:00:00", None])
    row = trending.recent_counts(df, "2018-06-01 12:00:00").head()
    assert (row["count_24h"], row["count_48h"], row["count_7d"], row["total"]) == (1, 2, 2, 4)


def test_cutoffs_are_inclusive_and_future_counts(spark):
    df = dated(spark, ["2018-05-31 12:00:00", "2018-06-05 00:00:00"])
    reference = datetime(2018, 6, 1, 12)
    assert trending.recent_counts(df, reference).head()["count_24h"] == 2
    assert trending.recent_counts(df, reference, upper_bound=True).head()["count_24h"] == 1


@pytest.mark.parametrize(
    ("reference", "expected"),
    [("auto", datetime(2018, 3, 15, 8)), ("Jun 1, 2018", datetime(2018, 6, 1)),
     ("unreadable", datetime(2018, 3, 15, 8)), (None, datetime(2018, 3, 15, 8))],
)
def test_reference(spark, reference, expected):
    df = dated(spark, ["2017-01-01 00:00:00", "2018-03-15 08:00:00"])
    assert trending.reference_frame(df, reference).head()[0] == expected


def test_reference_falls_back_to_clock(spark):
    df = dated(spark, [None])
    assert trending.reference_frame(df, "auto").head()[0].year >= 2024
    assert trending.reference_frame(dated(spark, ["2017-01-01"]), "now").head()[0].year >= 2024


def test_trending_orders_labels_and_lists_articles(spark):
    df = members(spark, [
        (1, 1, "2024-01-09 00:00:00", "a", "ua"), (1, 2, "2024-01-10 00:00:00", "b", "ub"),
        (1, 3, None, "c", "uc"), (1, 4, "2024-01-08 00:00:00", "d", "ud"),
        (2, 5, "2024-01-10 00:00:00", "e", "ue"), (2, 6, None, None, None),
        (3, 7, "2023-01-01 00:00:00", "f", "uf"),
    ])
    names = spark.createDataFrame([(1, "one"), (2, " ")], "cluster_id INT, label STRING")
    rows = trending.trending(df, names).collect()
    assert [(r["cluster_id"], r["label"], r["trending_score"]) for r in rows] == [
        (1, "one", 3.0), (2, "Cluster 2", 2.5), (3, "Cluster 3", 0.0),
    ]
    assert [a["id"] for a in rows[0]["top_articles"]] == [2, 1, 4]
    assert [a["id"] for a in rows[1]["top_articles"]] == [5]
    assert rows[1]["total"] == 2
    assert all(0 <= r["trending_score"] <= 5 for r in rows)


def test_top_trending_and_visible(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9)], "cluster_id INT, trending_score DOUBLE")
    assert [r["cluster_id"] for r in trending.top_trending(df, 2).collect()] == [3, 1]
    assert trending.top_trending(df, 0).count() == 0 and trending.top_trending(df, -1).count() == 0
    visible = spark.createDataFrame([(2,)], "cluster_id INT")
    assert [r["cluster_id"] for r in trending.restrict_to_clusters(df, visible).collect()] == [2]


def test_sliding_windows_match_direct_count(spark):
    df = dated(spark, ["2024-01-01 00:30:00", "2024-01-01 02:10:00", "2024-01-01 02:50:00", None])
    got = {
        str(r["window_start"]): r["article_count"]
        for r in trending.trending_windows(df, window_hours=2).collect()
    }
    assert got == {
        "2023-12-31 23:00:00": 1, "2024-01-01 00:00:00": 1,
        "2024-01-01 01:00:00": 2, "2024-01-01 02:00:00": 2,
    }


def test_recent_of_cluster_puts_undated_last(spark):
    df = dated(spark, ["2024-01-01", None, "2024-01-03"], cluster=4)
    got = [r["article_id"] for r in trending.recent_of_cluster(df, 4, 10).collect()]
    assert got == [2, 0, 1]


def brute_tfidf(texts, stops, max_features=1000, top=5):
    """Plain reading of TF-IDF: counts, smoothed idf, unit rows, column means."""
    import re

    docs = []
    for body in texts:
        words = [w for w in re.findall(r"\w{2,}", body.lower()) if w not in stops]
        docs.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    total = sum(docs, Counter())
    kept = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_features]}
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + sum(t in d for d in docs))) + 1 for t in kept}
    score = Counter()
    for doc in docs:
        row = {t: c * idf[t] for t, c in doc.items() if t in kept}
        length = math.sqrt(sum(w * w for w in row.values()))
        for t, w in row.items():
            score[t] += w / length / n
    return sorted(((round(s, 9), t) for t, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:top]


TEXTS = {
    1: ["Storm hits the coast", "storm damage on the coast road", "the coast guard", "storm storm"],
    2: ["Vote count vote", "the vote is on", "  ", "count the ballots and count them"],
    3: ["the is of", ""],
}


def documents(spark):
    rows = [(c, 10 * c + i, t) for c, texts in TEXTS.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "cluster_id INT, article_id BIGINT, text STRING")


@pytest.mark.parametrize("max_features", [1000, 4])
def test_tfidf_matches_plain_reading(spark, max_features):
    from tidings.functions.text import ENGLISH_STOP_WORDS

    rows = topics.cluster_tfidf(documents(spark), max_features=max_features).collect()
    for cluster in (1, 2):
        got = [(round(r["score"], 9), r["term"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["cluster_id"] == cluster]
        texts = [t for t in TEXTS[cluster] if t.strip()]
        assert got == brute_tfidf(texts, set(ENGLISH_STOP_WORDS), max_features)
    assert not [r for r in rows if r["cluster_id"] == 3]


def test_tfidf_of_all_terms_in_parts(spark, monkeypatch):
    from tidings.functions.text import ENGLISH_STOP_WORDS

    for parts in (1, 3):
        monkeypatch.setattr(topics, "PARTS", parts)
        rows = topics.cluster_tfidf(documents(spark)).collect()
        for cluster in (1, 2):
            got = [(round(r["score"], 9), r["term"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["cluster_id"] == cluster]
            texts = [t for t in TEXTS[cluster] if t.strip()]
            assert got == brute_tfidf(texts, set(ENGLISH_STOP_WORDS), 10**9)


def test_topics_keep_wordless_cluster(spark):
    rows = {r["cluster_id"]: r for r in topics.cluster_topics(documents(spark)).collect()}
    assert rows[3]["label"] == "unlabeled cluster" and rows[3]["keywords"] == []
    assert [rows[c]["article_count"] for c in (1, 2, 3)] == [4, 4, 2]
    assert rows[1]["label"] == ", ".join(rows[1]["keywords"][:3])


def blobs(spark, k=4, per=30, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.eye(dims)[:k] * 10
    data = np.concatenate([c + 0.2 * rng.normal(size=(per, dims)) for c in centres])
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(data)]
    return spark.createDataFrame(rows, "article_id BIGINT, embedding ARRAY<FLOAT>")


def test_cluster_corpus_finds_blobs(spark):
    found = clustering.cluster_corpus(blobs(spark), k_range=range(2, 8))
    assert found.k == 4
    sizes = views.cluster_sizes(found.points).collect()
    assert sorted(r["article_count"] for r in sizes) == [30, 30, 30, 30]
    assert found.points.count() == 120 and found.centroids.count() == 4
    centre = found.points.agg(F.avg("x"), F.avg("y")).head()
    assert abs(centre[0]) < 1e-9 and abs(centre[1]) < 1e-9


def test_choose_k_on_tiny_corpora(spark):
    for rows, expected in ((1, 1), (2, 2)):
        df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(rows)], "article_id BIGINT, embedding ARRAY<FLOAT>")
        assert clustering.choose_k(clustering.unit_features(df), range(5, 8)) == expected


def test_knee_of_a_bent_curve():
    assert clustering.knee([(k, y) for k, y in zip(range(2, 10), [100, 60, 20, 18, 16, 14, 12, 10])]) == 4
    assert clustering.knee([(2, 5.0), (3, 5.0), (4, 5.0)]) is None
    assert clustering.knee([(2, 5.0)]) is None


def test_curvature_matches_numpy(spark):
    ks, ys = [5, 6, 8, 9, 12], [50.0, 30.0, 22.0, 21.0, 20.0]
    curve = spark.createDataFrame(list(zip(ks, ys)), "k INT, inertia DOUBLE")
    expected = np.gradient(np.gradient(ys, ks), ks)
    got = [r["curvature"] for r in clustering.curvature(curve).orderBy("k").collect()]
    assert got == pytest.approx(list(expected))
    inner = ks[int(np.argmax(np.abs(expected[1:-1]))) + 1]
    assert clustering.elbow_by_curvature(curve).head()["k"] == inner


def test_assignment_and_inertia_match_numpy(spark):
    df = blobs(spark, per=5)
    table = spark.createDataFrame([(3, [10.0, 0.0, 0.0, 0.0, 0.0]), (1, [0.0, 10.0, 0.0, 0.0, 0.0])], "cluster_id INT, centroid ARRAY<DOUBLE>")
    data = np.array([r["embedding"] for r in df.orderBy("article_id").collect()])
    centres = np.array([[0, 10, 0, 0, 0], [10, 0, 0, 0, 0]])
    d2 = ((data[:, None] - centres) ** 2).sum(axis=2)
    got = clustering.assign_to_centroids(df, table).orderBy("article_id").collect()
    assert [r["cluster_id"] for r in got] == [[1, 3][i] for i in d2.argmin(axis=1)]
    assert clustering.inertia(df, table).head()[0] == pytest.approx(d2.min(axis=1).sum())


def test_new_articles_are_unclustered_or_assigned(spark):
    arts = spark.createDataFrame([(0,), (1,), (2,)], "article_id BIGINT")
    known = spark.createDataFrame([(0, 7)], "article_id BIGINT, cluster_id INT")
    plain = {tuple(r) for r in clustering.assign_unclustered(arts, known).collect()}
    assert plain == {(0, 7, False), (1, None, True), (2, None, True)}
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "article_id BIGINT, embedding ARRAY<FLOAT>")
    table = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "cluster_id INT, centroid ARRAY<DOUBLE>")
    full = {tuple(r) for r in clustering.assign_unclustered(arts, known, vecs, table).collect()}
    assert full == {(0, 7, False), (1, 8, True), (2, None, True)}


def test_membership_is_a_partition(spark):
    df = spark.range(2500).select(F.col("id").alias("article_id"), (F.col("id") % 3).cast("int").alias("cluster_id"))
    rows = views.cluster_membership(df, k=5, per_row=100).collect()
    assert max(len(r["article_ids"]) for r in rows) <= 100
    joined = {}
    for r in sorted(rows, key=lambda r: (r["cluster_id"], r["part"])):
        joined.setdefault(r["cluster_id"], []).extend(r["article_ids"])
    assert joined[3] == [] and joined[4] == []
    assert all(joined[c] == list(range(c, 2500, 3)) for c in range(3))


def articles(spark):
    return spark.createDataFrame(
        [(0, "t0", "u0", "2024-01-01", "bbc.com"), (1, " ", "u1", None, "x.org"), (2, "t2", "u2", "", None)],
        "article_id BIGINT, title STRING, url STRING, date STRING, domain STRING",
    )


def test_cluster_views(spark):
    clusters = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (9, 2)], "article_id BIGINT, cluster_id INT")
    points = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 2.0), (9, 3.0, 4.0)], "article_id BIGINT, x DOUBLE, y DOUBLE")
    names = spark.createDataFrame([(1, "one", ["a"])], "cluster_id INT, label STRING, keywords ARRAY<STRING>")
    placed = {r["article_id"]: r for r in views.cluster_points(clusters, points, articles(spark)).collect()}
    assert set(placed) == {0, 1, 9} and placed[9]["title"] == ""
    flat = {r["article_id"]: r for r in views.cluster_scatter(views.cluster_points(clusters, points, articles(spark)), names).collect()}
    assert flat[1]["title"] == "Untitled" and flat[1]["date"] == "—" and flat[9]["label"] == "Cluster 2"
    full = {r["cluster_id"]: r for r in views.cluster_summaries(clusters, names).collect()}
    assert full[1]["keywords"] == ["a"] and full[2]["keywords"] == [] and full[2]["article_count"] == 2
    only = views.cluster_summaries(clusters, names, articles(spark), ["bbc"]).collect()
    assert [(r["cluster_id"], r["article_count"]) for r in only] == [(1, 1)]
    listed = {r["article_id"]: r for r in views.cluster_articles(clusters, articles(spark), 2, points).collect()}
    assert set(listed) == {2} and listed[2]["x"] is None
    with pytest.raises(KeyError):
        views.cluster_articles(clusters, articles(spark), 77)


def test_duplicate_views(spark):
    pairs = spark.createDataFrame([(0, "own", "u", 1, "", "v", 0.95), (0, "a", "u", 2, None, "w", 0.88)],
        "a_id BIGINT, a_title STRING, a_url STRING, b_id BIGINT, b_title STRING, b_url STRING, similarity DOUBLE")
    full = {r["b_id"]: r for r in views.enrich_pairs(pairs, articles(spark)).collect()}
    assert full[1]["a_title"] == "own" and full[1]["b_title"] == "Untitled" and full[1]["b_date"] == "—"
    assert full[2]["b_title"] == "t2" and full[2]["b_domain"] == "unknown"
    export = views.duplicate_export(views.enrich_pairs(pairs, articles(spark)))
    assert len(export.columns) == 11
    row = views.corpus_kpis(articles(spark), pairs.withColumn("cluster_id", F.lit(1)), pairs).head()
    assert (row["articles"], row["clusters"], row["duplicate_pairs"], row["duplicate_pct"]) == (3, 1, 2, 66.7)


def test_charts(spark):
    sizes = spark.createDataFrame([(i, f"c{i}", i % 4) for i in range(20)], "cluster_id INT, label STRING, article_count BIGINT")
    top = views.top_clusters_by_size(sizes).collect()
    assert len(top) == 15 and top[0]["cluster_id"] == 3
    ranked = sizes.withColumn("trending_score", F.col("cluster_id") * 0.1)
    assert [r["cluster_id"] for r in views.top_clusters_by_trend(ranked, 2).collect()] == [19, 18]
    sized = {r["cluster_id"]: r["font_size"] for r in views.with_font_sizes(ranked).collect()}
    assert sized[0] == 13 and sized[19] == 30
    now = views.trending_now(ranked, sizes.filter("cluster_id < 19"), 2).collect()
    assert {r["cluster_id"]: r["article_count"] for r in now} == {19: "—", 18: "2"}


def lloyd(rows, centres, rounds, tolerance):
    """Plain k-means from given centres: the last measured centres and their cost."""
    for _ in range(rounds + 1):
        distance = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
        home = distance.argmin(axis=1)
        after = np.array([rows[home == i].mean(axis=0) if (home == i).any() else c for i, c in enumerate(centres)])
        cost = distance.min(axis=1).sum()
        if ((after - centres) ** 2).sum(axis=1).max() <= tolerance:
            break
        before, centres = centres, after
    else:
        centres = before
    return centres, cost


def test_all_k_side_by_side_equal_plain_lloyd_steps(spark):
    rng = np.random.default_rng(6)
    rows = np.concatenate([c + 0.2 * rng.normal(size=(30, 5)) for c in rng.normal(size=(6, 5))])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "article_id BIGINT, embedding ARRAY<DOUBLE>")
    features = clustering.unit_features(frame)
    fitted = clustering.fit_all_k(features, range(2, 9))
    assert list(fitted) == list(range(2, 9))
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    got = features.select("article_id", F.xxhash64(vector_to_array("features")).alias("h")).orderBy("h").collect()
    sample = units[[r["article_id"] for r in got]]
    start = clustering.spread_start(sample, 8)
    for k, (centres, cost) in fitted.items():
        want, want_cost = lloyd(units, start[:k], clustering.ROUNDS, clustering.TOLERANCE)
        assert cost == pytest.approx(want_cost, rel=1e-9)
        assert np.allclose(centres, want, atol=1e-9)
    assert clustering.choose_k(features, range(2, 9)) in range(3, 9)
    assert clustering.fit_all_k(features, [1, 500]) == {}


def test_curve_of_all_k_has_checked_facts(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("article_id"), "embedding"
    )
    features = clustering.unit_features(vectors)
    fitted = clustering.fit_all_k(features)
    assert list(fitted) == list(clustering.K_RANGE)
    units = np.array([r[0].toArray() for r in features.select("features").collect()])
    for k, (centres, cost) in fitted.items():
        distance = ((units[:, None] - centres[None]) ** 2).sum(axis=2)
        assert len(centres) == k and cost == pytest.approx(distance.min(axis=1).sum(), rel=1e-9)
    found = clustering.cluster_corpus(vectors)
    assert found.k == clustering.choose_k(features)
    assert found.points.count() == len(units)
    sizes = {r["cluster_id"]: r["count"] for r in found.points.groupBy("cluster_id").count().collect()}
    home = ((units[:, None] - fitted[found.k][0][None]) ** 2).sum(axis=2).argmin(axis=1)
    assert sizes == {int(c): int((home == c).sum()) for c in np.unique(home)}


def test_centroids_in_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(clustering, "CENTROID_BLOCK", 3)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 4))
    centres[7] = centres[2]
    rows = rng.normal(size=(40, 4))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster_id INT, centroid ARRAY<DOUBLE>")
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "article_id BIGINT, embedding ARRAY<DOUBLE>")
    distance = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    got = {r["article_id"]: r for r in clustering.assign_to_centroids(frame, table).collect()}
    assert [got[i]["cluster_id"] for i in range(40)] == distance.argmin(axis=1).tolist()
    assert np.allclose([got[i]["distance2"] for i in range(40)], distance.min(axis=1))
    curve = {r["k"]: r["inertia"] for r in clustering.prefix_inertia_curve(frame, table).collect()}
    want = np.minimum.accumulate(distance, axis=1).sum(axis=0)
    assert np.allclose([curve[k] for k in range(1, 11)], want)


@pytest.mark.parametrize("max_features", [None, 5, 1000])
def test_tfidf_ranks_only_terms_that_may_be_first(spark, monkeypatch, max_features):
    import random

    from tidings.functions.text import ENGLISH_STOP_WORDS

    scored = []
    kept = topics._small
    monkeypatch.setattr(topics, "_small", lambda rows: scored.append(kept(rows)) or scored[-1])
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["storm", "coast", "vote", "road", f"rare{rng.randrange(400)}"]) for _ in range(30)) for _ in range(60)]
    rows = [(1 + i % 2, i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "cluster_id INT, article_id BIGINT, text STRING")
    found = topics.cluster_tfidf(docs, max_features=max_features).collect()
    for cluster in (1, 2):
        got = [(round(r["score"], 9), r["term"]) for r in sorted(found, key=lambda r: r["rank"]) if r["cluster_id"] == cluster]
        own = [t for c, _, t in rows if c == cluster]
        assert got == brute_tfidf(own, set(ENGLISH_STOP_WORDS), max_features or 10**9)
    every = len({(c, term) for c, _, t in rows for term in t.split()})
    assert scored[0].count() < every or max_features == 1000


def test_tfidf_takes_rows_of_one_id_as_one_document(spark):
    rows = [(1, 1, "red blue"), (1, 1, "blue"), (1, 2, "green red"), (2, 1, "gold"), (None, 3, "blue")]
    docs = spark.createDataFrame(rows, "cluster_id INT, article_id BIGINT, text STRING")
    got = {(r["cluster_id"], r["term"]): r["score"] for r in topics.cluster_tfidf(docs).collect()}
    idf = {"red": math.log(4 / 3) + 1, "blue": math.log(4 / 2) + 1, "red blue": math.log(4 / 2) + 1}
    length = math.sqrt(idf["red"] ** 2 + (2 * idf["blue"]) ** 2 + idf["red blue"] ** 2 + 1.0)
    assert got[1, "blue"] == pytest.approx(2 * idf["blue"] / length / 3)
    assert got[2, "gold"] == pytest.approx(1 / length) and {c for c, _ in got} == {1, 2}


@pytest.mark.parametrize("max_features", [None, 20])
def test_few_terms_travel_before_the_first_are_known(spark, monkeypatch, max_features):
    import random

    from tidings.functions import text
    from tidings.functions.text import ENGLISH_STOP_WORDS

    monkeypatch.setattr(text, "COUNTED_WORDS", 4000)  # several chunks
    monkeypatch.setattr(topics, "LEAST_COUNT", 0.02)
    known = []
    possible = topics.possible_terms
    monkeypatch.setattr(topics, "possible_terms", lambda *a: known.append(possible(*a)) or known[-1])
    rng = random.Random(9)
    frequent = ["storm", "coast", "vote", "road", "one", "two", "en", "de"] + [f"some{i}" for i in range(16)]

    def written():
        return " ".join(rng.choice(frequent) if rng.random() < 0.97 else f"rare{rng.randrange(4000)}" for _ in range(60))

    # Clusters named by words of theirs, and a small one, of which no term is frequent.
    rows = [(("en", "de")[i % 2], i, written()) for i in range(600)] + [("few", 1000 + i, f"rare{i} storm{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "cluster_id STRING, article_id BIGINT, text STRING").coalesce(2)
    found = topics.cluster_tfidf(docs, max_features=max_features).collect()
    for cluster in ("en", "de", "few"):
        got = [(round(r["score"], 9), r["term"]) for r in sorted(found, key=lambda r: r["rank"]) if r["cluster_id"] == cluster]
        assert got == brute_tfidf([t for c, _, t in rows if c == cluster], set(ENGLISH_STOP_WORDS), max_features or 10**9)
    terms, whole = known[0]
    every = {(c, x) for c, _, t in rows for w in [t.split()] for x in [*w, *zip(w, w[1:])]}
    assert 0 < len(terms) < len(every) / 2
    assert len(whole) == (max_features is not None)  # the small cluster, of which no term is counted twice, is left whole
