import random

import pytest
from pyspark.sql import functions as F

from tidings.functions.publishers import DEFAULT_PUBLISHERS
from tidings.operators import articles as art
from tidings.schemas import require_columns

LONG = "word " * 20
RAW = "ingest_seq BIGINT, title STRING, description STRING, url STRING, date STRING, domain STRING"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_first_passing_record_per_url_wins(spark):
    df = raw(spark, [
        (0, "short", "", "https://a.org/1", "", ""),
        (1, "second", LONG, "https://a.org/1", "Jun 1, 2018", ""),
        (2, "third", LONG, "https://a.org/1", "", ""),
        (3, "no url", LONG, " ", "", ""),
        (4, None, LONG, "https://b.org:80/2", "bad date", " kept.org "),
        (5, "never long", "", "https://c.org", "", ""),
    ])
    got = {r["ingest_seq"]: r for r in art.clean_articles(df).collect()}
    assert set(got) == {1, 4}
    assert got[1]["date"] == "2018-06-01 00:00:00" and got[1]["domain"] == "a.org"
    assert got[4]["date"] == "bad date" and got[4]["domain"] == "kept.org"
    assert got[4]["text"] == LONG.strip() and got[4]["title"] == ""


@pytest.mark.parametrize(("chars", "kept"), [(49, 0), (50, 1)])
def test_length_limit_counts_combined_text(spark, chars, kept):
    df = raw(spark, [(0, "t", "x" * (chars - 2), "https://a.org", "", "")])
    assert art.clean_articles(df).count() == kept


def test_canonical_urls_merge_copies(spark):
    df = raw(spark, [(i, "t", LONG, f"https://a.org/x?utm_source={i}", "", "") for i in range(3)])
    assert art.clean_articles(df).count() == 3
    assert [r["url"] for r in art.clean_articles(df, canonical_urls=True).collect()] == ["https://a.org/x"]


def test_alias_normalize_fills_gaps(spark):
    df = spark.createDataFrame(
        [(0, "Big News!", None, None), (13, "", "https://s.org/1", "Wire")],
        "ingest_seq BIGINT, Headline STRING, link STRING, Source STRING",
    )
    first, second = art.normalize_aliases(df).orderBy("ingest_seq").collect()
    assert first["url"] == "https://news.example-1.com/big-news-0"
    assert (first["domain"], first["date"]) == ("news.example-1.com", "2020-01-01 12:00:00")
    assert (second["url"], second["domain"], second["title"]) == ("https://s.org/1", "Wire", "")
    assert second["date"] == "2020-02-14 12:00:00"


def test_append_is_idempotent_and_caps(spark):
    old = spark.createDataFrame([(0, "u0"), (1, "u1")], "ingest_seq BIGINT, url STRING")
    new = spark.createDataFrame([(2, "u1"), (3, "u2")], "ingest_seq BIGINT, url STRING")
    once = art.append_articles(new, old)
    assert {r["url"] for r in once.collect()} == {"u0", "u1", "u2"}
    again = art.append_articles(new, once)
    assert again.count() == 3
    assert {r["ingest_seq"] for r in art.append_articles(new, old, cap=2).collect()} == {0, 1}
    assert {r["ingest_seq"] for r in art.append_articles(new, old, cap=2, keep="newest").collect()} == {1, 3}
    assert art.append_articles(new).count() == 2
    with pytest.raises(ValueError):
        art.cap_corpus(old, 1, keep="some")


def test_ingest_counts(spark):
    old = spark.createDataFrame([("u0",), ("u1",)], "url STRING")
    new = spark.createDataFrame([("u1",), ("u2",)], "url STRING")
    assert art.ingest_counts(new, old).head().asDict() == {
        "new_articles": 1, "duplicate_articles": 1, "total_articles": 3,
    }


def test_first_link_follows_source_order(spark):
    rows = [("l1", 1, 0, "B"), ("l1", 0, 5, "A"), ("l1", 0, 9, "A2"), ("", 0, 1, "A"), (None, 0, 2, "A"), ("l2", 1, 3, "B")]
    df = spark.createDataFrame(rows, "link STRING, pos INT, ingest_seq BIGINT, source_name STRING")
    got = {(r["link"], r["source_name"]) for r in art.first_link_across_feeds(df).collect()}
    assert got == {("l1", "A"), ("l2", "B")}
    assert art.articles_per_feed(df).count() == 3


def test_feed_stats_keep_silent_publishers(spark):
    df = spark.createDataFrame(
        [("www.bbc.co.uk", "2024-01-01 00:00:00"), ("bbc.com", None), ("other.org", "2024-02-01 00:00:00")],
        "domain STRING, d STRING",
    ).select("domain", F.col("d").cast("timestamp_ntz").alias("published"))
    stats = art.feed_stats(df)
    got = {r["name"]: (r["article_count"], r["last_article_time"]) for r in stats.collect()}
    assert len(got) == len(DEFAULT_PUBLISHERS)
    assert got["BBC News"] == (2, "2024-01-01 00:00:00") and got["Reuters"] == (0, None)
    shown = {r["source"]: r["last_article"] for r in art.feed_stats_display(stats).collect()}
    assert shown["Reuters"] == "—"


@pytest.mark.parametrize(
    ("index", "aligned"),
    [(["a", "b"], True), (["b", "a"], False), (["a"], False), (["a", "b", "c"], False)],
)
def test_index_drift(spark, index, aligned):
    def table(values):
        return spark.createDataFrame(list(enumerate(values)), "position BIGINT, url STRING")

    assert art.index_drift(table(["a", "b"]), table(index)).head()["aligned"] is aligned


def test_lookup_by_url(spark):
    df = spark.createDataFrame([(7, 2, "u"), (9, 1, "u")], "article_id BIGINT, ingest_seq BIGINT, url STRING")
    wanted = spark.createDataFrame([("u",), ("x",), ("u",)], "url STRING")
    assert {tuple(r) for r in art.lookup_by_url(df, wanted).collect()} == {("u", 9), ("x", None)}


def test_hot_url_keeps_one_row(spark):
    df = spark.range(3000).select(
        F.col("id").alias("ingest_seq"), F.lit("t").alias("title"), F.lit(LONG).alias("description"),
        F.when(F.col("id") % 3 == 0, F.lit("https://hot.org")).otherwise(F.concat(F.lit("https://a.org/"), "id")).alias("url"),
        F.lit("").alias("date"), F.lit("").alias("domain"),
    )
    cleaned = art.clean_articles(df)
    assert cleaned.count() == 2001
    assert cleaned.filter("url = 'https://hot.org'").head()["ingest_seq"] == 0


def test_required_columns(spark):
    with pytest.raises(ValueError, match="domain"):
        require_columns(spark.range(1).select(F.lit("").alias("text"), F.lit("").alias("title")))


@pytest.mark.parametrize("keep", ["oldest", "newest"])
@pytest.mark.parametrize("limit", [1, 7, 499, 500, 900])
def test_cap_of_any_size(spark, keep, limit):
    values = [i * 977_777 % 1_000_003 * 1_000_000 - 5 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "ingest_seq BIGINT")
    got = [r[0] for r in art.cap_corpus(df, limit, keep).collect()]
    assert sorted(got) == sorted(sorted(values, reverse=keep == "newest")[:limit])


def test_cap_ties_and_nulls(spark):
    rows = [(None, "a"), (2, "c"), (2, "b"), (1, "d")]
    df = spark.createDataFrame(rows, "ingest_seq BIGINT, url STRING")
    assert {r["url"] for r in art.cap_corpus(df, 2).collect()} == {"d", "b"}
    assert {r["url"] for r in art.cap_corpus(df, 2, "newest").collect()} == {"b", "c"}
    assert art.cap_corpus(df, 9).count() == 4


def test_small_batch_anti_join(spark):
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "url STRING")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3)], "url STRING, n INT")
    got = {r["n"] for r in art.new_in_small_batch(new, known).collect()}
    assert got == {r["n"] for r in art.new_articles(new, known).collect()} == {2, 3}


@pytest.mark.parametrize("descending", [False, True])
def test_the_cut_is_found_among_keys(spark, descending):
    rng = random.Random(descending)
    rows = [
        (rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "c", "d"]), i) for i in range(300)
    ]
    df = spark.createDataFrame(rows, "ingest_seq BIGINT, url STRING, n INT").repartition(7)

    def key(row):
        at = 0 if row[0] is None else -row[0] if descending else row[0]
        return row[0] is None, at, row[1] is not None, row[1] or ""

    ordered = sorted(rows, key=key)
    for limit in (0, 1, 17, 150, 299, 300, 1000):
        got = art.first_by(df, limit, "ingest_seq", descending, "url").collect()
        assert sorted(key(r) for r in got) == [key(r) for r in ordered[:limit]]
        assert len({r["n"] for r in got}) == min(limit, 300)


def test_no_task_takes_the_rows_of_a_cap(spark):
    df = spark.range(1000).select(F.col("id").alias("ingest_seq"), F.lit("u").alias("url"), F.repeat(F.lit("t"), 100).alias("text"))
    plan = art.cap_corpus(df.repartition(5), 400)._jdf.queryExecution().optimizedPlan().toString()
    # Only rows that equal the cut key in both columns are limited; whole rows are never sorted.
    assert "Sort" not in plan and plan.count("GlobalLimit") == 1
