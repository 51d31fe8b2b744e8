import numpy as np
import pytest
from pyspark.sql import functions as F

from tidings.functions.publishers import Publisher
from tidings.operators import cells, encode, similarity
from tidings.plans import build
from tidings.plans.corpus import Corpus
from tidings.sources.articles import generated_articles

PUBLISHERS = (
    Publisher("Markets", "markets", "business", ("market-",)),
    Publisher("Science", "science", "tech", ("science-", "-science")),
)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    raw = generated_articles(spark, 200)
    copies = raw.filter("ingest_seq < 5").select(
        (F.col("ingest_seq") + 1000).alias("ingest_seq"), "title", "description",
        F.concat("url", F.lit("-copy")).alias("url"), "date", "domain",
    )
    build.build_all(spark, root, raw.unionByName(copies), k=6)
    return Corpus(spark, root, PUBLISHERS)


def test_tables_agree_in_size(corpus):
    assert corpus.table("articles").count() == 205
    assert corpus.table("embeddings").count() == 205
    assert corpus.table("clusters").count() == 205
    assert corpus.clusters().agg(F.sum("article_count")).head()[0] == 205
    assert corpus.clusters().count() == 6
    row = corpus.kpis().head()
    assert row["articles"] == 205 and row["clusters"] == 6 and row["duplicate_pairs"] >= 5


def test_search_finds_its_own_text(corpus):
    target = corpus.table("articles").filter("article_id = 17").head()
    hits = corpus.search(target["text"], k=3).collect()
    assert hits[0]["article_id"] == 17 and hits[0]["score"] == pytest.approx(1.0, abs=1e-5)
    assert len({h["url"] for h in hits}) == 3


def test_search_by_source(corpus):
    hits = corpus.search("football market", k=4, sources=["markets"]).collect()
    assert hits and all("market-" in h["domain"] for h in hits)


def test_find_similar_sees_the_copy(corpus):
    hits = corpus.find_similar(3, k=2).collect()
    assert hits[0]["article_id"] == 1003 and 3 not in {h["article_id"] for h in hits}
    with pytest.raises(IndexError):
        corpus.find_similar(123456)


def test_duplicates_hold_the_copies(corpus):
    pairs = {(r["a_id"], r["b_id"]) for r in corpus.duplicates(0.99).collect()}
    assert {(i, i + 1000) for i in range(5)} <= pairs
    assert all(a != b for a, b in pairs)


def test_clusters_and_trends(corpus):
    rows = corpus.trending(3).collect()
    assert [r["trending_score"] for r in rows] == sorted((r["trending_score"] for r in rows), reverse=True)
    assert all(r["label"] for r in corpus.clusters().collect())
    first = corpus.clusters().head()["cluster_id"]
    assert corpus.cluster_articles(first).count() == corpus.clusters().filter(F.col("cluster_id") == first).head()["article_count"]
    assert corpus.recent_articles(first, 3).count() == 3
    assert corpus.points(["markets"]).filter("domain NOT LIKE 'market-%'").count() == 0
    assert corpus.scatter().count() == 205
    assert corpus.trending(50, ["markets"]).count() <= 6
    assert corpus.feed_stats().count() == 7
    url = corpus.table("articles").filter("article_id = 3").head()["url"]
    assert corpus.article_id_of(url) == 3 and corpus.article_id_of("none") is None


def test_refresh_adds_only_new_articles(spark, tmp_path):
    root = str(tmp_path / "c")
    layout = build.build_all(spark, root, generated_articles(spark, 60), k=3)
    more = generated_articles(spark, 70)
    for _ in range(2):
        assert build.refresh(spark, layout, more, batch=1) == 10
    articles = layout.read(spark, "articles")
    assert articles.count() == 70 and articles.select("url").distinct().count() == 70
    assert layout.read(spark, "embeddings").count() == 70
    assert layout.read(spark, "clusters").count() == 60
    assert build.refresh(spark, layout, more, batch=2) == 0


def test_full_build_after_refresh_starts_anew(spark, tmp_path):
    layout = build.Layout(str(tmp_path / "c"))
    first, more = generated_articles(spark, 60), generated_articles(spark, 70)
    build.ingest(spark, layout, first)
    build.embed(spark, layout)
    assert build.append(spark, layout, more, batch=1) == 10
    build.embed(spark, layout, batch=1)
    build.ingest(spark, layout, first)
    build.embed(spark, layout)
    assert layout.read(spark, "articles").count() == 60
    vectors = layout.read(spark, "embeddings")
    assert vectors.count() == 60 and vectors.select("article_id").distinct().count() == 60


def test_nothing_left_after_cleaning(spark, tmp_path):
    short = generated_articles(spark, 3).withColumn("description", F.lit("")).withColumn("title", F.lit("x"))
    with pytest.raises(ValueError):
        build.ingest(spark, build.Layout(str(tmp_path)), short)


def test_any_model_can_encode(spark):
    def make_predict():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([("banana",), (None,)], "text STRING")
    got = [list(r["embedding"]) for r in encode.encode_with_model(df, make_predict).collect()]
    assert got == [[6.0, 3.0], [0.0, 0.0]]


def test_encode_new_skips_known_urls(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "url STRING, text STRING")
    known = spark.createDataFrame([("a",)], "url STRING")
    got = encode.encode_new(df, known, lambda new: new.withColumn("embedding", F.array(F.lit(1.0))))
    assert [r["url"] for r in got.collect()] == ["b"]


def too_short(spark, n):
    return generated_articles(spark, n).withColumn("description", F.lit("")).withColumn("title", F.lit("x"))


def test_empty_build_leaves_the_corpus(spark, tmp_path):
    root = str(tmp_path / "c")
    build.build_all(spark, root, generated_articles(spark, 60), k=3)
    with pytest.raises(ValueError):
        build.build_all(spark, root, too_short(spark, 60), k=3)
    with pytest.raises(ValueError):
        build.ingest(spark, build.Layout(root), too_short(spark, 60))
    corpus = Corpus(spark, root)
    assert corpus.table("articles").count() == 60 and corpus.table("embeddings").count() == 60
    assert corpus.find_similar(3, k=2).count() == 2


def test_failing_build_and_refresh_leave_the_corpus(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    layout = build.build_all(spark, root, generated_articles(spark, 60), k=3)

    @F.udf("string")
    def broken(text):
        raise RuntimeError("no such text")

    bad = generated_articles(spark, 80).withColumn("title", broken("title"))
    for attempt in (lambda: build.build_all(spark, root, bad, k=3), lambda: build.refresh(spark, layout, bad, batch=1)):
        with pytest.raises(Exception, match="no such text"):
            attempt()
        assert layout.read(spark, "articles").count() == 60
    # A refresh that fails after its articles were written shows none of them.
    monkeypatch.setattr(build, "rank_trends", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        build.refresh(spark, layout, generated_articles(spark, 80), batch=1)
    assert layout.read(spark, "articles").count() == layout.read(spark, "embeddings").count() == 60
    monkeypatch.undo()
    assert build.refresh(spark, layout, generated_articles(spark, 80), batch=1) == 20
    assert layout.read(spark, "articles").count() == layout.read(spark, "embeddings").count() == 80


def test_readers_follow_the_newest_whole_manifest(spark, tmp_path):
    layout = build.Layout(str(tmp_path / "c"))
    layout.put(spark.range(3), "numbers")
    layout.put(spark.range(5), "growing", 0, anew=True)
    layout.put(spark.range(2), "growing", 1)
    assert layout.read(spark, "numbers").count() == 3 and layout.read(spark, "growing").count() == 7
    draft = layout.draft()
    draft.put(spark.range(9), "numbers")
    assert draft.read(spark, "numbers").count() == 9 and layout.read(spark, "numbers").count() == 3
    # What a writer left that died before its manifest stood is not a version.
    (tmp_path / "c" / "manifests" / "version=99" / "_temporary").mkdir(parents=True)
    draft.commit()
    assert layout.read(spark, "numbers").count() == 9
    layout.put(spark.range(1), "growing", 1)
    assert layout.read(spark, "growing").count() == 6 and layout.batches("growing") == {0, 1}


def test_pairs_after_refreshes_equal_a_full_recomputation(spark, tmp_path):
    root, options = str(tmp_path / "c"), {"k": 4, "threshold": 0.55}
    everything = generated_articles(spark, 160).unionByName(
        generated_articles(spark, 30).withColumns(
            {"ingest_seq": F.col("ingest_seq") + 500, "url": F.concat("url", F.lit("-again"))}
        )
    )
    parts = [F.col("ingest_seq") < 120, F.col("ingest_seq") < 150, F.lit(True)]
    layout = build.build_all(spark, root, everything.filter(parts[0]), **{"k_range": range(3, 5)}, threshold=0.55)
    build.deduplicate(spark, layout, **options)
    for batch in (1, 2):
        assert build.refresh(spark, layout, everything.filter(parts[batch]), batch, **options) > 0
    kept = layout.read(spark, "duplicate_pairs").toPandas()
    fresh = similarity.near_duplicates(
        layout.read(spark, "embeddings"), layout.read(spark, "articles"), **options
    ).toPandas()
    assert len(fresh) > 50
    assert sorted(zip(kept["a_id"], kept["b_id"], kept["similarity"].round(9))) == sorted(
        zip(fresh["a_id"], fresh["b_id"], fresh["similarity"].round(9))
    )


def test_a_batch_reads_only_the_cells_it_comes_near(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    points = np.concatenate([c + 0.1 * rng.normal(size=(40, 12)) for c in centres])
    late = centres[7] + 0.1 * rng.normal(size=(5, 12))
    frame = lambda x, at: spark.createDataFrame(
        [(at + i, [float(v) for v in row]) for i, row in enumerate(np.float32(x))], "id BIGINT, embedding ARRAY<FLOAT>"
    )
    old, new = frame(points, 0), frame(late, 5000)
    tiling = cells.fit_tiling(cells.assign(old, centres / np.linalg.norm(centres, axis=1)[:, None]), centres, 1200, 64)
    tiling = cells.Tiling(centres / np.linalg.norm(centres, axis=1)[:, None], tiling.edges, tiling.parts, tiling.first)
    known, fresh = similarity.place_in(old, tiling, "id"), similarity.place_in(new, tiling, "id")
    lists = similarity.nearest_neighbours(old, 3, 0.9, id_column="id")
    changed = similarity.neighbours_after(fresh, known, cells.ring_table(known), tiling, lists, 3, 0.9)
    whole = similarity.nearest_neighbours(old.unionByName(new), 3, 0.9, id_column="id")
    got = {(r["id"], r["other"]) for r in changed.collect()}
    touched = {i for i, _ in got}
    assert got == {(r["id"], r["other"]) for r in whole.collect() if r["id"] in touched}
    assert {i for i in touched if i < 5000} <= set(range(280, 320)) and len(touched) > 5


def test_tilings_survive_storage(spark):
    tiling = cells.Tiling(np.eye(3), np.full((3, 63), np.inf), np.array([1, 2, 1]), np.array([0, 1, 3]))
    tiling.edges[1, :2] = 0.25, 0.5
    back = cells.read_tiling(cells.tiling_table(spark, tiling))
    assert all(np.array_equal(getattr(back, f), getattr(tiling, f)) for f in ("centres", "edges", "parts", "first"))
