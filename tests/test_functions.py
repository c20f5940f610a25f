from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, url


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


def test_whitespace_keeps_paragraphs(spark):
    assert one(spark, text.tidy_whitespace, "  a \t b\n\n\n\n c\x00d  \n") == "a b\n\nc" + "d"
    assert one(spark, text.tidy_whitespace, None) is None


def test_titles_and_exact_paths(spark):
    assert one(spark, text.fold_title, "  “Big”  NEWS — Today! ") == "big news today"
    assert one(spark, lambda c: text.fold_title(c, exact=True), "Fish &amp; Chips ﬁne STRASSE ß") == "fish chips fine strasse ss"
    plain = "Plain words, no tricks."
    assert one(spark, text.fold_text, plain) == one(spark, lambda c: text.fold_text(c, exact=True), plain)


def test_lists(spark):
    df = spark.createDataFrame([(["A ", "b", "a", " ", None, "B"], ["x  y", "X y", "", "z"])], "a array<string>, p array<string>")
    r = df.select(text.distinct_in_order(F.col("a")).alias("a"), text.distinct_paragraphs(F.col("p")).alias("p")).first()
    assert r.a == ["A", "b"] and r.p == ["x  y", "z"]


def test_counts(spark):
    assert one(spark, text.word_count, "it's 2 words_ok") == 4
    df = spark.createDataFrame([(450,), (0,)], "n int")
    assert [r[0] for r in df.select(text.reading_minutes(F.col("n"))).collect()] == [2.0, 0.0]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (url.article_url, "HTTPS://Ex.ORG/a/b/?utm_source=x&q=1&ref=r#f", "https://ex.org/a/b?q=1"),
        (url.article_url, "https://ex.org", "https://ex.org"),
        (url.identity_url, "https://Ex.org?gclid=1", "https://ex.org/"),
        (url.identity_url, "https://ex.org/a;p=1?b=%20c&a", "https://ex.org/a?b=+c&a="),
        (url.fetch_url, "https://Ex.org:443/?b=2&a=1&utm_x=3", "https://Ex.org?a=1&b=2"),
        (url.feed_url, "HTTP://Ex.org/x/?utm_source=1#f", "http://ex.org/x?utm_source=1"),
        (url.domain, "https://u:p@www.Ex.org:80/x", "ex.org"),
    ],
)
def test_urls(spark, make, given, want):
    assert one(spark, make, given) == want


def test_relative_urls(spark):
    assert one(spark, lambda u, b: url.article_url(u, b), "../c?utm_term=1", "https://ex.org/a/b/") == "https://ex.org/a/c"
    assert one(spark, lambda u, b: url.media_url(u, b), "/i.png?w=8&utm_id=1", "https://ex.org/a") == "https://ex.org/i.png?w=8&utm_id=1"
    assert one(spark, url.is_source_url, "/feed") is False


def test_dates(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, dates.parse_feed_date, "Tue, 02 Jan 2024 03:04:05 GMT") == at
    assert one(spark, dates.parse_feed_date, "Tue, 02 Jan 2024 05:04:05 +0200") == at
    assert one(spark, dates.parse_feed_date, "2024-01-02T03:04:05Z") == at
    assert one(spark, dates.parse_feed_date, "not a date") is None
    assert one(spark, dates.parse_article_date, "1704164645") == at
    assert one(spark, dates.parse_article_date, "1704164645000") == at
    assert one(spark, lambda c: dates.parse_article_date(c, free_form=True), "January 2, 2024 03:04:05") == at


def test_cron():
    assert dates.next_run("*/15 8-10 * * 1-5", datetime(2024, 1, 5, 10, 50)) == datetime(2024, 1, 8, 8, 0)
    assert dates.next_run("0 0 31 2 *", datetime(2024, 1, 1)) is None
    with pytest.raises(ValueError):
        dates.next_run("61 * * * *", datetime(2024, 1, 1))
