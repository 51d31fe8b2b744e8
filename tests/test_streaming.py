import shutil
from datetime import datetime

from pyspark.sql import functions as F

from tidings.operators.trending import trending_windows
from tidings.plans.corpus import Corpus
from tidings.sources import feeds
from tidings.streaming import ingest

ITEM = "<item><title>Headline number {n}</title><link>https://x.org/{n}?ref=f</link><description>{text}</description><pubDate>Thu, 26 Jun 2025 10:30:00 GMT</pubDate></item>"


def land(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    items = "".join(ITEM.format(n=n, text="body text " * 6) for n in numbers)
    (folder / name).write_text(f"<rss><channel>{items}</channel></rss>")


def follow(spark, tmp_path):
    items = feeds.read_items(spark, str(tmp_path / "landing"), stream=True)
    records = feeds.to_records(items, "x").drop("feed")
    query = ingest.start_ingest(records, str(tmp_path / "articles"), str(tmp_path / "checkpoint"))
    query.awaitTermination()


def stored(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "articles"))


def test_ingest_appends_only_new_urls(spark, tmp_path):
    land(tmp_path / "landing", "a.xml", [1, 2, 2])
    follow(spark, tmp_path)
    assert {r["url"] for r in stored(spark, tmp_path).collect()} == {"https://x.org/1", "https://x.org/2"}
    land(tmp_path / "landing", "b.xml", [2, 3])
    follow(spark, tmp_path)
    rows = stored(spark, tmp_path).collect()
    assert sorted(r["url"] for r in rows) == [f"https://x.org/{n}" for n in (1, 2, 3)]
    assert len({r["ingest_seq"] for r in rows}) == 3
    follow(spark, tmp_path)
    assert stored(spark, tmp_path).count() == 3


def test_replayed_batch_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "articles")
    land(tmp_path / "landing", "a.xml", [1, 2])
    first = feeds.to_records(feeds.read_items(spark, str(tmp_path / "landing")), "x")
    for _ in range(2):
        ingest.append_batch(first, 0, table)
    land(tmp_path / "landing", "b.xml", [3])
    everything = feeds.to_records(feeds.read_items(spark, str(tmp_path / "landing")), "x")
    for _ in range(2):
        ingest.append_batch(everything, 1, table, enrich=lambda df: df.withColumn("extra", F.lit(1)))
    assert spark.read.parquet(table).count() == 3


def events(spark, tmp_path, files):
    folder = tmp_path / "events"
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "cluster_id INT, url STRING, published TIMESTAMP")
        out = tmp_path / f"part{i}"
        df.coalesce(1).write.parquet(str(out))
        folder.mkdir(exist_ok=True)
        for part in out.glob("*.parquet"):
            shutil.copy(part, folder / f"{i}.parquet")
    schema = "cluster_id INT, url STRING, published TIMESTAMP"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_bounded_dedup_keeps_first_per_url(spark, tmp_path):
    stream = events(spark, tmp_path, [[(1, "a", at(1)), (1, "b", at(1))], [(1, "a", at(2)), (1, "c", at(2))]])
    got = run(ingest.drop_recent_duplicates(stream), "kept", "append")
    assert sorted(r["url"] for r in got.collect()) == ["a", "b", "c"]


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rows = [(c, "u", at(d, h)) for c, d, h in ((1, 1, 5), (1, 1, 6), (2, 1, 7), (1, 2, 3), (2, 2, 4))]
    stream = events(spark, tmp_path, [rows[:3], rows[3:]])
    streamed = run(ingest.stream_trending_windows(stream), "windows", "complete")
    batch = spark.createDataFrame(rows, "cluster_id INT, url STRING, published TIMESTAMP")
    batch = batch.withColumn("published", F.col("published").cast("timestamp_ntz"))
    expected = {(r["cluster_id"], str(r["window_start"]), r["article_count"]) for r in trending_windows(batch).collect()}
    got = {(r["cluster_id"], str(r["window_start"]), r["article_count"]) for r in streamed.collect()}
    assert got == expected


def test_a_batch_of_many_partitions_has_distinct_positions(spark, tmp_path):
    table = str(tmp_path / "articles")
    for batch in (0, 1):
        rows = [(f"Title {batch} {n}", "body text " * 6, f"https://x.org/{batch}/{n}", "", "") for n in range(300)]
        records = spark.createDataFrame(rows, "title STRING, description STRING, url STRING, date STRING, domain STRING")
        ingest.append_batch(records.repartition(150), batch, table)
    found = spark.read.parquet(table)
    assert found.count() == found.select("ingest_seq").distinct().count() == 600
    last = found.filter("batch = 0").agg(F.max("ingest_seq")).head()[0]
    assert found.filter("batch = 1").agg(F.min("ingest_seq")).head()[0] > last


WORDS = "markets rally storm coast election vote science probe football final music award".split()


def land_news(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    items = "".join(
        ITEM.format(n=n, text=" ".join(WORDS[(n * k + k) % len(WORDS)] for k in range(1, 15)) + f" story {n // 2}")
        for n in numbers
    )
    (folder / name).write_text(f"<rss><channel>{items}</channel></rss>")


def follow_corpus(spark, tmp_path, **options):
    items = feeds.read_items(spark, str(tmp_path / "landing"), stream=True)
    records = feeds.to_records(items, "x").drop("feed")
    ingest.start_corpus_ingest(records, str(tmp_path / "corpus"), str(tmp_path / "check"), **options).awaitTermination()


def test_a_streamed_corpus_opens_whole(spark, tmp_path):
    options = {"k_range": range(2, 4), "threshold": 0.5}
    land_news(tmp_path / "landing", "a.xml", range(24))
    follow_corpus(spark, tmp_path, **options)
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    assert corpus.table("articles").count() == corpus.table("embeddings").count() == 24
    before = corpus.duplicates().count()
    land_news(tmp_path / "landing", "b.xml", range(20, 36))
    follow_corpus(spark, tmp_path, **options)
    articles = corpus.table("articles")
    assert articles.count() == articles.select("article_id").distinct().count() == 36
    assert corpus.table("embeddings").count() == 36 and corpus.duplicates().count() > before > 0
    assert corpus.trending().count() > 0
    # The last micro-batch once more: nothing is lost or doubled.
    items = feeds.to_records(feeds.read_items(spark, str(tmp_path / "landing" / "b.xml")), "x").drop("feed")
    assert ingest.corpus_batch(items, 1, str(tmp_path / "corpus"), threshold=0.5) == 12
    assert corpus.table("articles").count() == 36
