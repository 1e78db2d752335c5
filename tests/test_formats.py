"""Normalisers, by input and expected (value, validity)."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import formats, recognize, text


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "phone": (formats.normalize_phone, {"+1 202 555 0142": ("+12025550142", 1.0), "+1-202-555-0142": ("+12025550142", 1.0), " +1  (202)  555.0142 ": ("+12025550142", 1.0), "+91 98765 43210": ("+919876543210", 1.0), "+44 20 7946 0958": ("+442079460958", 1.0), "+1 115 555 0142": ("+11155550142", 0.6), "": (None, 0.0), "no phone": (None, 0.0), "+650,000": (None, 0.0), "202 555 0142": (None, 0.0)}),
    "phone in US": (lambda c: formats.normalize_phone(c, "US"), {"202 555 0142": ("+12025550142", 1.0)}),
    "phone in IN": (lambda c: formats.normalize_phone(c, "IN"), {"9876543210": ("+919876543210", 1.0)}),
    "date": (formats.normalize_date, {"2021-03": ("2021-03", 1.0), "2021-03-15": ("2021-03", 1.0), "03/2021": ("2021-03", 1.0), "March 2021": ("2021-03", 1.0), "2007": ("2007", 0.8), "0142": (None, 0.0), "2020-13": (None, 0.0), "soon": (None, 0.0), "": (None, 0.0), "2020-05-01T10:00:00Z": ("2020-05", 1.0)}),
    "email": (formats.normalize_email, {" A.B@Mail.COM ": ("a.b@mail.com", 1.0), "a@b": (None, 0.0), "a@@b.c": (None, 0.0), "": (None, 0.0), "@b.c": (None, 0.0)}),
    "url": (formats.normalize_url, {"https://GitHub.com/Ab": ("https://github.com/Ab", 1.0), "site.org/x": ("https://site.org/x", 0.6), "https://a.dev.": ("https://a.dev", 1.0), "": (None, 0.0), "HTTP://A.B?q=C": ("http://a.b?q=C", 1.0), "5": ("https://5", 0.6)}),
    "country": (formats.normalize_country, {"US": ("US", 1.0), "usa": ("US", 1.0), "United States": ("US", 1.0), "UK": ("GB", 1.0), "Britain": ("GB", 1.0), "Republic of Korea": ("KR", 1.0), "India": ("IN", 1.0), "Scotland": (None, 0.0), "xyzzy": (None, 0.0)}),
    "years": (formats.normalize_years, {" 12 ": (12.0, 1.0), "3.5": (3.5, 1.0), "71": (None, 0.0), "1d": (None, 0.0), "twelve": (None, 0.0), "-1": (None, 0.0)}),
}


@pytest.mark.parametrize("name", CASES)
def test_normaliser(spark, name):
    fn, cases = CASES[name]
    got = _apply(spark, fn, [*cases, None])
    assert [(r.value, r.validity) for r in got] == [*cases.values(), (None, 0.0)]


def test_location(spark):
    got = _apply(spark, formats.classify_location, ["Oslo", "Oslo, Norway", "Austin, TX", "Austin, TX, USA", "A, B, C, D", " , ", None])
    assert [r.value and tuple(r.value) for r in got] == [("Oslo", None, None), ("Oslo", None, "NO"), ("Austin", "TX", None), ("Austin", "TX", "US"), ("A", "B, C, D", None), None, None]


def test_text(spark):
    assert _apply(spark, lambda c: text.clean_string(c, nfc=True), ["  a \t b\n", "café", " ", None]) == ["a b", "café", None, None]
    assert _apply(spark, text.company_key, ["Stripe, Inc.", "Acme Co. Ltd", "Co", "A-B LLC", None]) == ["stripe", "acme", "", "a b", ""]
    assert _apply(spark, text.normalize_alias, ["  K8S ", "React-JS", "C++", "a_b/c", "R&D!"]) == ["k8s", "react js", "c++", "a b c", "rd"]
    assert _apply(spark, text.split_cells, ["a; b,,c ", ""]) == [["a", " b", "c "], []]


def test_recognition(spark):
    t = "Mail a.b@x.org, c@d.io; a.b@x.org. See HTTPS://A.org/x, http://b.org). Call +1 202 555 0142 or 9876543210 not 1111111111."
    assert _apply(spark, recognize.find_emails, [t, "none"]) == [["a.b@x.org", "c@d.io"], []]
    assert _apply(spark, recognize.find_urls, [t]) == [["HTTPS://A.org/x", "http://b.org"]]
    assert [(p.raw, p.bare) for p in _apply(spark, recognize.find_phones, [t])[0]] == [("+1 202 555 0142", False), ("9876543210", True)]
