import html
from datetime import datetime
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.functions import dates, publishers, scores, text, urls, vectors
from tidings.functions.html import body_or_summary, main_text


def column(spark, values, expr, schema="v STRING"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


DATES = {
    "2018-06-01 10:00:00": datetime(2018, 6, 1, 10),
    "2018-06-01": datetime(2018, 6, 1),
    "2018-06-01T10:00:00": datetime(2018, 6, 1, 10),
    "2018-06-01T10:00:00Z": datetime(2018, 6, 1, 10),
    "2018-06-01T10:30:00+01:00": datetime(2018, 6, 1, 10, 30),
    "2018/06/01 10:00:00": datetime(2018, 6, 1, 10),
    "2018/06/01": datetime(2018, 6, 1),
    "13/06/2018 10:00:00": datetime(2018, 6, 13, 10),
    "13/06/2018": datetime(2018, 6, 13),
    "06/13/2018 10:00:00": datetime(2018, 6, 13, 10),
    "06/05/2018": datetime(2018, 6, 5),
    "Fri, 01 Jun 2018 10:00:00 +0100": datetime(2018, 6, 1, 10),
    "Fri, 01 Jun 2018 10:00:00": datetime(2018, 6, 1, 10),
    "Thu, 26 Jun 2025 10:30:00 GMT": datetime(2025, 6, 26, 10, 30),
    "June 1, 2018": datetime(2018, 6, 1),
    "Jun 1, 2018": datetime(2018, 6, 1),
    " 2018-06-01 ": datetime(2018, 6, 1),
    "05-09-2020": datetime(2020, 5, 9),
    "13-09-2020 10:30:00 -0500": datetime(2020, 9, 13, 10, 30),
    "20180601": datetime(2018, 6, 1),
    "Fri Jun  1 10:00:00 2018": datetime(2018, 6, 1, 10),
    "Fri Jun 1 10:00:00 UTC 2018": datetime(2018, 6, 1, 10),
    "2018-06-01T10:00:00.25-05:00": datetime(2018, 6, 1, 10, 0, 0, 250000),
    "2018-06-01 10:00:00 GMT+0200": datetime(2018, 6, 1, 10),
    "2018-02-30": None,
    "nan": None,
    "None": None,
    "NaT": None,
    "": None,
    "garbage": None,
    "2018": None,
    None: None,
}


def test_parse_date_formats(spark):
    assert column(spark, list(DATES), dates.parse_date(F.col("v"))) == list(DATES.values())


def test_format_date_keeps_unreadable_text(spark):
    got = column(spark, ["Jun 1, 2018", " soon ", None], dates.format_date(F.col("v")))
    assert got == ["2018-06-01 00:00:00", "soon", ""]


def test_strip_html_examples(spark):
    values = ["<b>Hello</b> world", "&lt;b&gt;x&lt;/b&gt;", "a&nbsp;&amp;lt; b", None, "  ", "&eacute;t&#233; &copy"]
    assert column(spark, values, text.strip_html(F.col("v"))) == [
        "Hello world", "x", "a &lt; b", "", "", "été ©",
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab &;<>#x1\n\t amplt", max_size=30), min_size=1, max_size=20))
def test_strip_html_matches_plain_python(spark, values):
    import re

    def plain(value):
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(value))).strip()

    assert column(spark, values, text.strip_html(F.col("v"))) == [plain(v) for v in values]


def test_combine_text(spark):
    df = spark.createDataFrame([("AI chips", "<p>Semiconductor demand rises.</p>"), ("x", None)], "t STRING, d STRING")
    got = [r[0] for r in df.select(text.combine_text(F.col("t"), F.col("d"))).collect()]
    assert got == ["AI chips Semiconductor demand rises.", "x"]


def test_display_and_slug(spark):
    assert column(spark, [" a ", "", None, " "], text.display(F.col("v"), "none")) == ["a", "none", "none", "none"]
    assert column(spark, ["Hello, World!", "--", "Été 2024"], text.slug(F.col("v"))) == ["hello-world", "", "été-2024"]


def test_terms_drop_stop_words_before_pairs(spark):
    df = spark.createDataFrame([("The cat is on the Mat, a b",)], "body STRING")
    assert text.with_terms(df, "body").head()["terms"] == ["cat", "mat", "cat mat"]


def plain_clean_url(url):
    tracking = {"utm_source", "utm_medium", "utm_campaign", "utm_content", "ref", "source"}
    p = urlparse(url)
    path = p.path
    for tail in ("/amp/", "/amp"):
        if path.endswith(tail):
            path = path[: -len(tail)] or "/"
            break
    pairs = [
        (k, v)
        for k, v in parse_qsl(p.query, keep_blank_values=True)
        if k.lower() not in tracking and not (k.lower() == "amp" and v.lower() in ("1", "true"))
    ]
    return urlunparse((p.scheme, p.netloc, path, p.params, urlencode(pairs), p.fragment))


URLS = [
    "https://x.org/a/amp", "https://x.org/a/amp/", "https://x.org/amp", "https://x.org/amp/",
    "https://x.org/a?utm_source=f&b=1&b=2&utm_term=k", "https://x.org/a?ref=x", "https://x.org/?b=&c",
    "https://x.org/a?amp=1&q=2", "https://x.org/a?amp=TRUE", "https://x.org/a?amp=2#frag",
    "HTTP://X.org/A?q=a+b%20c%2A~*&Z=%C3%A9", "https://x.org", "https://x.org/a;p=1?q=1#t",
    "https://user:pw@x.org:8080/a?Source=1&sourcex=2", "x.org/a?ref=1", "https://x.org/a?&&b=1&=3",
    "https://x.org/a?q=a=b",
]


def test_clean_url_matches_plain_python(spark):
    assert column(spark, URLS, urls.clean_url(F.col("v"))) == [plain_clean_url(u) for u in URLS]


def test_clean_url_leaves_blank(spark):
    assert column(spark, ["", None], urls.clean_url(F.col("v"))) == ["", None]


def test_domain_keeps_port_and_user(spark):
    values = [*URLS, "", None, "//h.org/x"]
    expected = [urlparse(u or "").netloc for u in values]
    assert column(spark, values, urls.domain_of(F.col("v"))) == expected


def test_publishers(spark):
    values = ["www.bbc.co.uk", "notbbc.com", "unknown.org", "", None, "WWW.REUTERS.COM"]
    name = publishers.publisher_of(F.col("v"))
    assert column(spark, values, name) == ["BBC News", "BBC News", None, None, None, "Reuters"]
    strict = publishers.publisher_of(F.col("v"), suffix_only=True)
    assert column(spark, values, strict) == ["BBC News", None, None, None, None, "Reuters"]
    assert column(spark, ["BBC News", "TechCrunch", "?"], publishers.category_of(F.col("v"))) == ["world", "tech", ""]


@pytest.mark.parametrize(
    ("slugs", "expected"),
    [([], [True, True, True]), (None, [True, True, True]), (["bbc"], [True, False, False]),
     (["nope"], [False, False, False]), (["bbc", "nope", "ap"], [True, False, True])],
)
def test_matches_sources(spark, slugs, expected):
    values = ["www.bbc.co.uk", "unknown.org", "apnews.com"]
    assert column(spark, values, publishers.matches_sources(F.col("v"), slugs)) == expected


def test_dimension_tables(spark):
    assert publishers.publisher_table(spark).count() == 7
    assert publishers.feed_table(spark).count() == 10


def test_trending_score_formula(spark):
    df = spark.createDataFrame([(2, 4, 10, 20), (1, 1, 1, 0)], "a INT, b INT, c INT, n INT")
    score = scores.trending_score(F.col("a"), F.col("b"), F.col("c"), F.col("n"))
    assert [r[0] for r in df.select(score).collect()] == [0.85, 0.0]


def test_rounding_is_half_even(spark):
    assert column(spark, [1 / 32, 3 / 32, 0.12344], scores.rounded_score(F.col("v")), "v DOUBLE") == [
        round(1 / 32, 4), round(3 / 32, 4), 0.1234,
    ]


def test_bands_sizes_labels(spark):
    assert column(spark, [0.71, 0.7, 0.51, 0.5], scores.score_band(F.col("v")), "v DOUBLE") == ["high", "medium", "medium", "low"]
    assert column(spark, [0.95, 0.92, 0.91], scores.similarity_band(F.col("v")), "v DOUBLE") == ["high", "medium", "low"]
    size = scores.font_size(F.col("v"), F.lit(0.0), F.lit(1.0))
    assert column(spark, [0.0, 0.5, 1.0], size, "v DOUBLE") == [13, 21, 30]
    flat = scores.font_size(F.col("v"), F.lit(1.0), F.lit(1.0))
    assert column(spark, [1.0], flat, "v DOUBLE") == [21]
    label = scores.topic_label(F.col("v"))
    assert column(spark, [["a", "b", "c", "d"], []], label, "v ARRAY<STRING>") == ["a, b, c", "unlabeled cluster"]


def test_vectors(spark):
    unit = vectors.l2_normalize(F.col("v"))
    got = column(spark, [[3.0, 4.0], [0.0, 0.0]], unit, "v ARRAY<FLOAT>")
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2**-0.5, 0.0])


LONG = "w" * 100
PAGES = {
    f"<body><nav>n</nav><article><h1>T</h1><p>a <b>b</b></p><script>x('</p>')</script></article></body>": "T a b",
    "<main>m<footer>f</footer></main><div class='content'>d</div>": "m",
    "<div class='side'>s</div><div class='Post-Body x'>d<br>e</div>": "d e",
    "<html><body>only <i>body</i><header>h</header></body></html>": "only body",
    "no tags at all": "no tags at all",
    "<header><article>inside</article></header>": "inside",
    "<article>a<article>b</article>c</article><article>late</article>": "a b c",
    "<article>a &lt; b &amp; c <!-- x -->d</article>": "a < b & c d",
    "<article><p>open <b>bold<p>next</article>after": "open bold next",
    "": "",
}


@pytest.mark.parametrize(("page", "expected"), PAGES.items())
def test_main_text(page, expected):
    assert main_text(page) == expected


def test_body_falls_back_to_summary(spark):
    df = spark.createDataFrame([("x" * 99, "s"), ("x" * 100, "s"), (None, None)], "b STRING, s STRING")
    got = [r[0] for r in df.select(body_or_summary(F.col("b"), F.col("s"))).collect()]
    assert got == ["s", "x" * 100, ""]


FEED_DATES = {
    "Thu, 26 Jun 25 10:30:00 GMT": datetime(2025, 6, 26, 10, 30),
    "June 26, 2025 3:30 PM": datetime(2025, 6, 26, 15, 30),
    "26/06/2025 3:30 pm": datetime(2025, 6, 26, 15, 30),
    "20250626T103000": datetime(2025, 6, 26, 10, 30),
    "20250626T1030Z": datetime(2025, 6, 26, 10, 30),
    "20250626T103000+0200": datetime(2025, 6, 26, 10, 30),
    "06/26/25": datetime(2025, 6, 26),
    "25/06/26": datetime(2026, 6, 25),
    "1-Jan-70": datetime(1970, 1, 1),
    "2025-06-26T10:30:00-05": datetime(2025, 6, 26, 10, 30),
    "Thu, 26 Jun 2025 10:30:00 CEST": datetime(2025, 6, 26, 10, 30),
    "26 Jun 2025 10:30 EEST": datetime(2025, 6, 26, 10, 30),
    "26 Jun 2025 at 10:30": datetime(2025, 6, 26, 10, 30),
    "2025-06-26 10": datetime(2025, 6, 26, 10),
    "26th June 2025": datetime(2025, 6, 26),
    "June 1st, 2025 12:05 a.m.": datetime(2025, 6, 1, 0, 5),
    "June 26, 2025 12 pm EST": datetime(2025, 6, 26, 12),
    "June 26, 2025 13:30 PM": None,
    "June 26, 2025 0:30 PM": None,
    "32nd June 2025": None,
    "at 10:30": None,
}


def test_parse_date_of_feeds(spark):
    assert column(spark, list(FEED_DATES), dates.parse_date(F.col("v"))) == list(FEED_DATES.values())


def test_clean_url_keeps_good_escapes_beside_bad_ones(spark):
    values = ["https://x.org/?q=%20%zz", "https://x.org/?q=%", "https://x.org/?q=a%2Bb%2", "https://x.org/?q=%41%42"]
    assert column(spark, values, urls.clean_url(F.col("v"))) == [
        "https://x.org/?q=+%25zz", "https://x.org/?q=%25", "https://x.org/?q=a%2Bb%252", "https://x.org/?q=AB",
    ]
