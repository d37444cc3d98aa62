import pytest
from pyspark.sql import functions as F

from paperflow.functions.urls import http_url

CASES = {
    "https://Example.ORG": "https://example.org/", "HTTP://a.b/C": "http://a.b/C", "  https://a.b/x \n": "https://a.b/x", "https://a.b:443/": "https://a.b/", "http://a.b:443/": "http://a.b:443/", "http://a.b:080/": "http://a.b/", "https://a.b:": "https://a.b/",
    "https://a.b/x/../y": "https://a.b/y", "https://a.b/x/./y/.": "https://a.b/x/y/", "https://a.b/../..": "https://a.b/", "https://a.b/x/%2E%2e/y": "https://a.b/y", "https://a.b/x//y": "https://a.b/x//y", "https://a.b?q": "https://a.b/?q", "https://a.b#f": "https://a.b/#f",
    "https://a.b/?": "https://a.b/?", "https://a.b/a b": "https://a.b/a%20b", "https://a.b/é": "https://a.b/%C3%A9", 'https://a.b/"x"': "https://a.b/%22x%22", "https://a.b/?a b'c#d e`": "https://a.b/?a%20b%27c#d%20e%60", "https://a.b/%zz": "https://a.b/%zz", "https:a.b/x": "https://a.b/x",
    "https:\\\\a.b\\x": "https://a.b/x", "https:///a.b/x": "https://a.b/x", "https://u:p@a.b/": "https://u:p@a.b/", "https://u@x@a.b/": "https://u%40x@a.b/", "https://a.b/\tx\ny": "https://a.b/xy", "http://127.0.0.1/": "http://127.0.0.1/", "http://[::1]:8080/": "http://[::1]:8080/",
    "https://a.b/x?y=/../z": "https://a.b/?".replace("?", "x?y=/../z"), "javascript:alert(1)": None, "ftp://a.b/": None, "//a.b/": None, "a.b": None, "https://": None, "https://a.b:99999/": None, "https://a.b:x/": None, "https://a b/": None, "https://a<b/": None, "": None,
}


@pytest.fixture(scope="module")
def forms(spark):
    rows = [*CASES, None]
    return {r.u: r.v for r in spark.createDataFrame([(u,) for u in rows], "u string").select("u", http_url(F.col("u")).alias("v")).collect()}


@pytest.mark.parametrize("url", CASES)
def test_stated_forms(forms, url):
    assert forms[url] == CASES[url]


def test_a_form_stays_as_it_is(spark, forms):
    again = spark.createDataFrame([(v,) for v in CASES.values() if v], "u string").select("u", http_url(F.col("u")).alias("v")).collect()
    assert all(r.u == r.v for r in again) and forms[None] is None
