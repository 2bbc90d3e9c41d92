import pytest

from pyspark.sql import functions as F
from sessionlake.llm import url_examples, urls
from sessionlake.llm.queries import op7_urls

PAGES = "page_id bigint, url string"


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame([(u, 1) for u in url_examples.BLOCKED] + [(u, 0) for u in url_examples.ALLOWED], "url string, label int")


def judged(spark, examples, found):
    df = spark.createDataFrame(list(enumerate(found)), PAGES)
    return [r for r in urls.judge(df, url_examples.RULES, examples).orderBy("page_id").collect()]


def test_host_and_path(spark, examples):
    found = ["http://A.Example.COM/Fr/1?q#f", None, "", "no scheme/x", "x://h", "x://h?q/p", "x://h#f/p", "a://b://c/d", "x://ÄB/Ö\n/z?", "x://u@H:80/p", "://h/p"]
    assert [(r.host, r.path) for r in judged(spark, examples, found)] == [
        ("a.example.com", "/Fr/1"), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("Äb", "/Ö\n/z"), ("u@h:80", "/p"), ("h", "/p"),
    ]


def test_rules(spark, examples):
    cases = {
        "http://x.example.org/es/1": ("example.org/es/", "block"), "http://x.example.org/en/12": ("example.org/en/1", "block"), "http://x.example.org/en/2": ("org/", "allow"),
        "http://org/": ("org/", "allow"), "http://x.org": (None, None), "http://xorg/": (None, None), "http://a.com/fr/2": ("com/fr/", "allow"), "http://a.com/de/2": ("com/de/", "block"),
        "http://notexample.org/es/": ("org/", "allow"), "http://A.COM/FR/": (None, None), "http://example.org/es/": ("example.org/es/", "block"),
    }
    for r, (rule, verdict) in zip(judged(spark, examples, list(cases)), cases.values()):
        assert r.rule == rule and (verdict is None or r.verdict == verdict)


def test_classifier_on_unseen_urls(spark, examples):
    bad = ["http://www.casino-night.example.net/en/3", "https://buy-pills.example.net/en/9", "http://adult-pics.example.com/en/4", "http://ads-pixel.example.net/track/9"]
    fine = ["http://www.history.example.net/en/3", "https://reading.example.net/en/9", "http://blog.therapy.example.com/en/4", "http://m.weather.example.net/es/9"]
    assert [r.verdict for r in judged(spark, examples, bad + fine)] == ["block"] * 4 + ["allow"] * 4


def test_edge_cases(spark, examples):
    rows = judged(spark, examples, ["http://h.example.net/" + "a/" * 20_000, "http://h.example.net/x", "http://h.example.net/x"])
    assert rows[1][1:] == rows[2][1:] and all(r.verdict in ("allow", "block") for r in rows)
    assert urls.judge(spark.createDataFrame([], PAGES), url_examples.RULES, examples).count() == 0
    df = spark.createDataFrame([(None, "http://h/p", "x", "y")], PAGES + ", host string, URL string")
    assert [tuple(r)[:3] for r in urls.judge(df, [], examples.limit(0)).collect()] == [(None, "h", "/p")]
    with pytest.raises(ValueError):
        urls.judge(df, [("h", "/", "allow")] * (urls.MAX_RULES + 1), examples)
    with pytest.raises(ValueError):
        urls.judge(df, [], spark.range(urls.MAX_EXAMPLES + 1).select(F.lit("http://a/b").alias("url"), F.lit(1).alias("label")))


def test_query(spark):
    assert op7_urls(spark, "/root/testdata/sf0.001").filter("verdict NOT IN ('allow', 'block')").count() == 0
