import json

import pytest
from pyspark.sql import functions as F

from tidings.operators.articles import clean_articles
from tidings.sources import artifacts, feeds, sinks
from tidings.sources import articles as source

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<title>Trial feed</title><link>https://www.bbc.co.uk/news</link>
<item><title>Harbour &amp;amp; bridge plans agreed</title>
 <description>&lt;p&gt;Both towns sign a plan for the new bridge.&lt;/p&gt;</description>
 <link>https://www.bbc.co.uk/news/1?utm_source=rss&amp;a=1</link>
 <pubDate>Thu, 26 Jun 2025 10:30:00 GMT</pubDate></item>
<item><title>Orchestra returns to the old hall</title><content:encoded><![CDATA[<b>First concert</b> in ten years draws a full house.]]></content:encoded>
 <link>https://www.bbc.co.uk/news/2</link><pubDate>soon</pubDate></item>
<item><title>No link</title></item><item><link>https://x.org/3</link></item>
</channel></rss>"""

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><title>First</title><link rel="self" href="https://s.org/self"/><link href="https://s.org/1"/>
 <content type="html">&lt;i&gt;Body&lt;/i&gt; text</content><updated>2025-06-26T10:30:00+01:00</updated></entry>
<entry><title>Second</title><link rel="enclosure" href="https://s.org/2"/><summary>Sum</summary>
 <published>2025-06-26T09:00:00Z</published><updated>2025-07-01T09:00:00Z</updated></entry></feed>"""


@pytest.fixture
def rss(tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    return str(tmp_path / "feed.xml")


def test_rss_records(spark, rss):
    rows = {r["url"]: r for r in feeds.to_records(feeds.read_items(spark, rss), "trial").collect()}
    assert len(rows) == 2
    first = rows["https://www.bbc.co.uk/news/1?utm_source=rss&a=1"]
    assert first["title"] == "Harbour & bridge plans agreed" and first["domain"] == "www.bbc.co.uk"
    assert first["date"] == "2025-06-26 10:30:00" and first["feed"] == "trial"
    second = rows["https://www.bbc.co.uk/news/2"]
    assert second["description"].startswith("First concert in") and second["date"] == "soon"


def test_repeated_items_clean_to_one_row_per_url(spark, rss):
    records = feeds.to_records(feeds.read_items(spark, rss), "trial")
    doubled = source.with_positions(records.unionByName(records.limit(1)))
    cleaned = clean_articles(doubled)
    assert cleaned.count() == 2
    assert cleaned.filter(F.length("text") < 50).count() == 0


def test_publisher_entries(spark, rss):
    entries = feeds.to_entries(feeds.read_items(spark, rss), "BBC News")
    rows = {r["link"]: r for r in entries.collect()}
    assert set(rows) == {"https://www.bbc.co.uk/news/1?a=1", "https://www.bbc.co.uk/news/2"}
    assert rows["https://www.bbc.co.uk/news/1?a=1"]["category"] == "world"
    assert rows["https://www.bbc.co.uk/news/2"]["published"] is None
    records = {r["url"]: r for r in feeds.entries_to_records(entries).collect()}
    assert records["https://www.bbc.co.uk/news/2"]["date"] == ""
    assert records["https://www.bbc.co.uk/news/1?a=1"]["date"] == "2025-06-26 10:30:00"


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    items = feeds.read_items(spark, str(tmp_path / "a.xml"), "atom")
    rows = {r["url"]: r for r in feeds.to_records(items, "atom").collect()}
    assert rows["https://s.org/1"]["description"] == "Body text"
    assert rows["https://s.org/1"]["date"] == "2025-06-26 10:30:00"
    assert rows["https://s.org/2"]["date"] == "2025-06-26 09:00:00"
    with pytest.raises(ValueError):
        feeds.read_items(spark, "x", "json")


def test_feed_config(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps({"feeds": [{"name": "A", "url": "u"}, {"name": " "}, {"name": "C", "url": ""}]}, indent=1))
    listed, errors = feeds.feed_config(spark, str(path))
    assert [tuple(r) for r in listed.collect()] == [("A", "u")]
    assert {r["error"] for r in errors.collect()} == {"RSS feed: missing url", "C: missing url"}
    path.write_text('{"feeds": []}')
    with pytest.raises(ValueError):
        feeds.feed_config(spark, str(path))


def test_load_articles(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('title,text,url,date,domain\n"a ""b"", c","two\nlines",u,d,x.org\n')
    row = source.load_articles(spark, str(path)).head()
    assert row["title"] == 'a "b", c' and row["text"] == "two\nlines"
    path.write_text("title,text,url,date,domain\n")
    with pytest.raises(ValueError):
        source.load_articles(spark, str(path))
    path.write_text("title,url\na,b\n")
    with pytest.raises(ValueError, match="missing required"):
        source.load_articles(spark, str(path))
    with pytest.raises(FileNotFoundError):
        source.load_articles(spark, str(tmp_path / "none.csv"))


def test_foreign_csv_with_and_without_header(spark, tmp_path):
    named, plain = tmp_path / "n.csv", tmp_path / "p.csv"
    named.write_text("Headline,Link,publishedAt\nA,https://a.org/1,2024-01-01\nB,,\n")
    rows = source.load_foreign_csv(spark, str(named)).orderBy("ingest_seq").collect()
    assert [r["url"] for r in rows] == ["https://a.org/1", "https://news.example-2.com/b-1"]
    plain.write_text('3,"Title one","Body one"\n4,"Title two","Body two"\n5,"Title three","x"\n')
    rows = source.load_foreign_csv(spark, str(plain), limit=2).orderBy("ingest_seq").collect()
    assert [(r["title"], r["description"]) for r in rows] == [("Title one", "Body one"), ("Title two", "Body two")]


def test_positions_are_dense_over_many_splits(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    rows = source.with_positions(df, "pos", start=5).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(5, 5 + len(rows)))
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows)


def test_corpus_limit_and_blanks(spark, tmp_path):
    path = str(tmp_path / "corpus")
    source.generated_articles(spark, 30).withColumn("date", F.lit(None).cast("string")).write.parquet(path)
    rows = source.load_corpus(spark, path, limit=10).collect()
    assert sorted(r["ingest_seq"] for r in rows) == list(range(10)) and rows[0]["date"] == ""
    assert source.load_corpus(spark, path, limit=None).count() == 30


def test_generated_articles_are_reproducible(spark):
    a, b = (source.generated_articles(spark, 20).orderBy("ingest_seq").collect() for _ in range(2))
    assert a == b and len({r["url"] for r in a}) == 20
    assert source.generated_articles(spark, 20, seed=1).orderBy("ingest_seq").collect() != a


def test_artifacts(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=2))
        return str(tmp_path / name)

    member = write("m.json", {"0": [0, 2], "10": [1]})
    assert {tuple(r) for r in artifacts.import_membership(spark, member).collect()} == {(0, 0), (0, 2), (10, 1)}
    topic = write("t.json", {"3": {"keywords": ["a", "b"], "label": "a, b", "article_count": 2}})
    row = artifacts.import_topics(spark, topic).head()
    assert (row["cluster_id"], row["keywords"], row["article_count"]) == (3, ["a", "b"], 2)
    trend = write("r.json", [{"cluster_id": "2", "label": "x", "trending_score": 1.5, "count_24h": 1, "count_7d": 2,
                              "top_articles": [{"id": "5", "title": "t", "url": "u", "date": "d"}]}])
    assert artifacts.import_trending(spark, trend).head()["top_articles"][0]["id"] == "5"
    side = {"id": "1", "title": "t", "url": "u"}
    pair = write("d.json", [{"article_a": side, "article_b": {**side, "id": "2"}, "similarity": 0.95}])
    assert artifacts.import_duplicates(spark, pair).head()["b_id"] == 2
    meta = write("i.json", [{"title": "t", "url": "u"}, {"id": "9", "title": "x", "url": "v"}])
    assert {r["article_id"] for r in artifacts.import_metadata(spark, meta).collect()} == {0, 9}
    stats = write("s.json", {"updated_at": "n", "sources": [{"name": "A", "slug": "a", "article_count": 1}]})
    assert artifacts.import_feed_stats(spark, stats).head()["last_article_time"] is None
    with pytest.raises(ValueError):
        artifacts.import_membership(spark, write("bad.json", [1, 2])).collect()


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_are_read_an_element_a_row(spark, tmp_path, indent):
    path = tmp_path / "meta.json"
    listed = [{"title": f"t{i}, [x", "url": f"u{i}", "extra": [1, {"a": 2}]} for i in range(3000)]
    path.write_text(json.dumps(listed, indent=indent))
    rows = artifacts.import_metadata(spark, str(path)).collect()
    assert {(r["article_id"], r["ingest_seq"], r["title"], r["date"]) for r in rows} == {
        (i, i, f"t{i}, [x", "") for i in range(3000)
    }
    assert "from_json" not in artifacts.import_metadata(spark, str(path))._jdf.queryExecution().toString()
    path.write_text("[]")
    assert artifacts.import_duplicates(spark, str(path)).count() == 0
    for wrong in ("", "  ", '{"title": "t"}', "7"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            artifacts.import_metadata(spark, str(path))
    path.write_text('[{"similarity": 0.5}, {"simil')
    with pytest.raises(Exception, match="(?i)malformed"):
        artifacts.import_duplicates(spark, str(path)).collect()


def test_last_fetch(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("2026-01-01 10:00:00 [fetch] a\n2026-01-02 10:00:00 [fetch] b\n2026-01-03 10:00:00 [cluster] c\n")
    assert artifacts.last_fetch(spark, str(log)) == "2026-01-02 10:00:00"
    log.write_text("nothing\n")
    assert artifacts.last_fetch(spark, str(log)) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", x'), (2, "two\nlines")], "id INT, t STRING")
    sinks.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["t"] for r in back.collect()} == {'say "hi", x', "two\nlines"}
    sinks.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.write_table(df, str(tmp_path / "t"), partition_by=["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    for _ in range(2):
        sinks.write_batch(df, str(tmp_path / "b"), 3)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    for n in (1, 2):
        sinks.append_run_state(sinks.run_state(spark, n, 10, 4, ["e"]), str(tmp_path / "log"))
    assert spark.read.schema(sinks.RUN_STATE).json(str(tmp_path / "log")).agg(F.sum("new_articles")).head()[0] == 3


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    folder = str(tmp_path / "lines")
    rows = spark.range(6000).select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), 30)).alias("v"))
    rows.repartitionByRange(3, "v").write.csv(folder)
    seen = []
    for size in ("128m", "20k", "7k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            scan = spark.read.schema("v STRING").csv(folder)
            parts = scan.rdd.getNumPartitions()
            found = source.with_positions(scan, "pos").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        seen.append((parts, {r["v"]: r["pos"] for r in found}))
    assert len({parts for parts, _ in seen}) == 3
    assert seen[0][1] == seen[1][1] == seen[2][1]
    assert [v for v, _ in sorted(seen[0][1].items(), key=lambda x: x[1])] == sorted(seen[0][1])
    assert sorted(seen[0][1].values()) == list(range(6000))


def test_csv_without_line_ends_in_fields_is_split(spark, tmp_path):
    path = tmp_path / "a.csv"
    lines = [f"text {i},title {i},https://x.org/{i},2024-01-01,x.org" for i in range(3000)]
    path.write_text("\n".join(["text,title,url,date,domain", *lines]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = source.load_articles(spark, str(path), multi_line=False)
        assert split.rdd.getNumPartitions() > 1 and split.count() == 3000
        numbered = source.load_foreign_csv(spark, str(path), limit=10, multi_line=False)
        assert {r["title"] for r in numbered.collect()} == {f"title {i}" for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
