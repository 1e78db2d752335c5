"""Contacts in free text, as arrays in the order of first appearance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .formats import normalize_phone
from .text import strip

# Shapes of contacts.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"(?i)\bhttps?://[^\s,<>\"')]+"
INTERNATIONAL_PHONE = r"\+\d[\d\s().-]{7,16}\d"
BARE_PHONE = r"(?<![\w+])\d{10}(?!\w)"


def find_emails(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(EMAIL), F.lit(0)))


def find_urls(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:!?"))))


def find_phones(x: Column, region: str = "IN") -> Column:
    """array<struct<raw, bare>>: numbers as written that are valid; bare ones without country code are read in region."""
    written = F.transform(F.regexp_extract_all(x, F.lit(INTERNATIONAL_PHONE), F.lit(0)), strip)
    kept = F.filter(F.array_distinct(written), lambda p: normalize_phone(p)["validity"] == 1.0)
    bare = F.filter(F.array_distinct(F.regexp_extract_all(x, F.lit(BARE_PHONE), F.lit(0))), lambda p: normalize_phone(p, region)["validity"] == 1.0)
    label = lambda xs, flag: F.transform(xs, lambda p: F.struct(p.alias("raw"), F.lit(flag).alias("bare")))
    return F.concat(label(kept, False), label(F.array_except(bare, kept), True))


def link_classes(urls: Column) -> Column:
    """struct<linkedin, github, portfolio, other> of canonical URLs: the first of each known host, the rest in order."""
    where = lambda host: F.transform(urls, lambda u: F.lower(u).contains(host))
    linkedin = F.array_position(where("linkedin.com"), F.lit(True))
    hub = F.transform(urls, lambda u, i: F.lower(u).contains("github.com") & (i + 1 != linkedin))
    github = F.array_position(hub, F.lit(True))
    pick = lambda at: F.when(at > 0, F.get(urls, (at - 1).cast("int")))
    other = F.filter(urls, lambda u, i: (i + 1 != linkedin) & (i + 1 != github))
    return F.struct(pick(linkedin).alias("linkedin"), pick(github).alias("github"), F.lit(None).cast("string").alias("portfolio"), other.alias("other"))
