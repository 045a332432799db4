import pytest
from pyspark.sql import functions as F

from lakewright.functions import parse, text as tx

NUMBERS = [
    ("1.234,56", 1234.56, None, 1234.56), ("1234,56", 1234.56, 1234.56, 1234.56), ("1234.56", 1234.56, 1234.56, 123456.0),
    ("1.234", 1.234, 1.234, 1234.0), ("  ", None, None, None), ("1.0f", None, None, None), (" 12 ", 12.0, 12.0, 12.0),
    (None, None, None, None), ("-3,5", -3.5, -3.5, -3.5), ("1e3", 1000.0, 1000.0, 1000.0), ("1_000", None, None, None),
]


def test_number_texts(spark):
    df = spark.createDataFrame([(t,) for t, *_ in NUMBERS], "t string").select(
        parse.number_generic(F.col("t")), parse.number_convention(F.col("t")), parse.number_tariff(F.col("t"))
    )
    assert [tuple(r) for r in df.collect()] == [tuple(x) for _, *x in NUMBERS]


def test_nan_and_infinity_are_numbers(spark):
    row = spark.range(1).select(parse.number_generic(F.lit("NaN")).alias("a"), parse.number_generic(F.lit("inf")).alias("b")).first()
    assert row.a != row.a and row.b == float("inf")


TIMES = [
    ("2024-10-01 10:30:00", "2024-10-01 10:30:00"), ("01/10/2024", "2024-10-01 00:00:00"), ("1/10/2024", "2024-10-01 00:00:00"),
    ("01/10/2024 08:15", "2024-10-01 08:15:00"), ("01/10/2024 08:15:09", "2024-10-01 08:15:09"), ("20241001", "2024-10-01 00:00:00"),
    ("10/2024", "2024-10-01 00:00:00"), ("2024-10", "2024-10-01 00:00:00"), ("202410", "2024-10-01 00:00:00"), ("2024-10-01", "2024-10-01 00:00:00"),
    ("2024-1-5", "2024-01-05 00:00:00"), ("2024/10/01", "2024-10-01 00:00:00"), ("2024/1/5 8:05", "2024-01-05 08:05:00"),
    ("2024 10 01", "2024-10-01 00:00:00"), ("2024-10-01T10:30:00", "2024-10-01 10:30:00"), ("2024-10-01T10:30:00Z", "2024-10-01 10:30:00"),
    ("2024-10-01 10", None), ("2024-10-01x", None), ("2024-13-01", None), ("2024-10/01", None),
    ("2024", None), ("12:30", None), ("31/02/2024", None), ("", None), (None, None), ("abc", None),
]


def test_timestamp_texts(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string").select(
        F.date_format(parse.timestamp_multi(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    )
    assert [r[0] for r in df.collect()] == [w for _, w in TIMES]


def test_format_comma(spark):
    assert spark.range(1).select(parse.format_comma(F.lit(1234567.25), 1)).first()[0] in ("1.234.567,2", "1.234.567,3")


def test_numbers_in_prose(spark):
    text = "1.234,5 e 1234.5; 13.233, 216,05 ou 8.8 de 1.234.567. nada 1,2,3"
    got = spark.createDataFrame([(text,)], "t string").select(tx.numbers(F.col("t"))).first()[0]
    assert got == [1234.5, 1234.5, 13233.0, 216.05, 8.8, 1234567.0]


def test_query_terms_agree_between_driver_and_column(spark):
    question = "O que diz a Lei 14.300 art. 1º sobre compensação?"
    got = spark.createDataFrame([(question,)], "t string").select(tx.terms(F.col("t"))).first()[0]
    assert got == ["14.300", "1o", "compensacao"]


@pytest.mark.parametrize("raw", ["AÇÃO Élan", "naïve ½ ﬁn № 1ª straße", "Łódź øre", "Ａｂｃ…", "plain"])
def test_folding_has_one_meaning(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(tx.fold(F.col("t")), tx.fold_name(F.col("t"))).first()
    assert row[0] == row[1] == tx.folded_literal(raw)


@pytest.mark.parametrize("base,href,want", [
    ("https://a.org/x/y.html?q=1", "/z#t", "https://a.org/z"), ("https://a.org/x/y.html", "z", "https://a.org/x/z"),
    ("https://a.org/x/y/", "../z", "https://a.org/x/z"), ("https://a.org/x/y/k", "../../z", "https://a.org/z"), ("https://a.org", "z", "https://a.org/z"),
    ("https://a.org/x", "//b.org/q", "https://b.org/q"), ("https://a.org/x", "http://c.org/", "http://c.org/"),
    ("https://a.org/x?p=1", "?p=2", "https://a.org/x?p=2"), ("https://a.org/x?p=1#f", "#g", "https://a.org/x?p=1"),
    ("https://a.org/x/", "./k", "https://a.org/x/k"),
])
def test_links_resolve_like_the_standard_library(spark, base, href, want):
    from urllib.parse import urldefrag, urljoin

    df = spark.createDataFrame([(base, href)], "b string, h string")
    got = df.select(tx.resolve_url(F.col("b"), F.col("h"))).first()[0]
    assert got == want == urldefrag(urljoin(base, href))[0]


def test_url_quote(spark):
    from urllib.parse import quote

    raw = "Súbmódulo 1.2 (rev*)/a+b~c&d.pdf"
    assert spark.createDataFrame([(raw,)], "t string").select(tx.url_quote(F.col("t"))).first()[0] == quote(raw)
