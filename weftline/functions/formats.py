"""Format normalisers: Column to struct<value, validity>. A value that has no canonical form is null with validity 0."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession, functions as F

from .text import clean_string, let, strip


def result(value: Column, validity: Column) -> Column:
    return let(F.struct(value.alias("v"), validity.cast("double").alias("w")), lambda r: F.struct(r["v"].alias("value"), F.when(r["v"].isNull(), F.lit(0.0)).otherwise(r["w"]).alias("validity")))


def normalize_email(x: Column) -> Column:
    """Lower case; exactly one @, with something on both sides and a dot in the domain."""

    def checked(e: Column) -> Column:
        parts = F.split(e, "@")
        return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & F.get(parts, F.lit(1)).contains("."), e)

    return result(let(F.lower(strip(x)), checked), F.lit(1.0))


# Two-digit country calling codes (ITU E.164); 1 and 7 have one digit, all others three.
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# National numbers by calling code; others only by length.
_NATIONAL = {
    "1": r"^[2-9]\d{2}[2-9]\d{6}$",
    "44": r"^(7\d{9}|[1238]\d{8,9})$",
    "47": r"^[2-9]\d{7}$",
    "91": r"^([6-9]\d{9}|(11|2[02]|33|4[04]|79|80)[2-7]\d{7})$",
}
# Calling codes of regions for numbers that are written without one.
_REGION_CODE = {"US": "1", "CA": "1", "GB": "44", "NO": "47", "IN": "91"}


def normalize_phone(x: Column, region: str | Column | None = None) -> Column:
    """E.164 with validity 1 for a number that its country's plan allows, 0.6 for one of possible length only. Without
    region the number must begin with +. Plans are kept for a few countries; elsewhere length decides, so rare ranges
    may be judged otherwise than by a full numbering database."""
    code = F.lit(None).cast("string")
    if region is not None:
        region = F.lit(region) if isinstance(region, str) else region
        for name, c in _REGION_CODE.items():
            code = F.when(region == name, F.lit(c)).otherwise(code)

    def full_number(text: Column) -> Column:
        digits = F.regexp_replace(text, r"[^0-9]", "")
        full = F.when(text.startswith("+"), digits)
        if region is not None:
            full = full.otherwise(F.concat(code, F.regexp_replace(digits, "^0+", "")))
        return F.when(~text.rlike(r"(?U)\p{L}"), full)

    def in_parts(full: Column) -> Column:
        size = F.when(full.rlike("^[17]"), 1).when(F.substring(full, 1, 2).isin(_TWO_DIGITS), 2).otherwise(3)
        return let(size, lambda n: F.struct(full.alias("full"), F.substr(full, F.lit(1), n).alias("code"), F.substr(full, n + 1).alias("national")))

    def judged(p: Column) -> Column:
        national = p["national"]
        valid = national.rlike(r"^[1-9]\d{6,11}$")
        for c, pattern in _NATIONAL.items():
            valid = F.when(p["code"] == c, national.rlike(pattern)).otherwise(valid)
        possible = F.when(p["code"] == "1", F.length(national) == 10).otherwise(F.length(national).between(6, 12)) & (F.length(p["full"]) <= 15)
        grade = F.when(valid, 1.0).when(possible, 0.6)
        return let(grade, lambda g: result(F.when(g.isNotNull(), F.concat(F.lit("+"), p["full"])), g))

    return let(let(let(strip(x), full_number), in_parts), judged)


# Date layouts that carry a month.
_LAYOUTS = ["MM/yyyy", "M/yyyy", "MMMM yyyy", "MMM yyyy", "yyyy/MM", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


def normalize_date(x: Column) -> Column:
    """yyyy-MM with validity 1, or a bare year of 1900 to 2100 with 0.8. A year is never made up."""

    def read(text: Column) -> Column:
        year = text.rlike(r"^\d{4}$")
        iso = F.regexp_extract(text, r"^(\d{4}-(0[1-9]|1[0-2]))(-(0[1-9]|[12]\d|3[01]))?([T ].*)?$", 1)
        named = F.coalesce(*[F.date_format(F.try_to_timestamp(text, F.lit(p)), "yyyy-MM") for p in _LAYOUTS])
        value = F.when(year, F.when(text.try_cast("int").between(1900, 2100), text)).otherwise(F.coalesce(F.when(iso != "", iso), named))
        return result(value, F.when(year, 0.8).otherwise(1.0))

    return let(strip(x.cast("string")), read)


def normalize_url(x: Column) -> Column:
    """Scheme and host in lower case, marks that end a sentence cut off. Without scheme https:// is put before and the
    validity is 0.6."""

    def read(text: Column) -> Column:
        schemed = text.contains("://")

        def rebuilt(url: Column) -> Column:
            part = lambda k: F.regexp_extract(url, r"^([^:/?#]+)://([^/?#]*)([\s\S]*)$", k)
            return F.when((text != "") & (part(2) != ""), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3)))

        return result(let(F.when(schemed, text).otherwise(F.concat(F.lit("https://"), text)), rebuilt), F.when(schemed, 1.0).otherwise(0.6))

    return let(F.rtrim(strip(x), F.lit(".,;:!?)\"'")), read)


# Informal names of countries, beside codes and names of the JVM's locale data.
_COUNTRY_ALIASES = {
    "uk": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "u.s.": "US", "u.s.a.": "US", "america": "US", "united states of america": "US",
    "republic of korea": "KR", "korea, republic of": "KR", "south korea": "KR", "north korea": "KP", "russia": "RU", "russian federation": "RU", "holland": "NL",
    "the netherlands": "NL", "czech republic": "CZ", "czechia": "CZ", "uae": "AE", "viet nam": "VN", "deutschland": "DE", "espana": "ES", "brasil": "BR", "republic of india": "IN",
}
_countries: dict[str, str] = {}


def country_codes(spark: SparkSession | None = None) -> dict[str, str]:
    """Lower-case code or name to ISO 3166 alpha-2, from the JVM's locale data and a few informal names."""
    if not _countries:
        spark = spark or SparkSession.active()
        locale = spark._jvm.java.util.Locale
        for code in locale.getISOCountries():
            place = locale("", code)
            for name in (code, place.getISO3Country(), place.getDisplayCountry(locale.ENGLISH)):
                _countries[name.lower()] = code
        _countries.update(_COUNTRY_ALIASES)
    return _countries


def normalize_country(x: Column, codes: dict[str, str] | None = None) -> Column:
    """ISO 3166 alpha-2 by exact code or name, without regard to case. Parts of countries aren't countries."""
    table = F.from_json(F.lit(json.dumps(codes or country_codes())), "map<string,string>")
    return result(F.try_element_at(table, F.lower(strip(x))), F.lit(1.0))


def classify_location(x: Column, codes: dict[str, str] | None = None) -> Column:
    """struct<city, region, country> by place: the first part is the city; the last of several is the country if it is
    known as one; what is left between is the region."""

    def read(parts: Column) -> Column:
        n = F.size(parts)
        known = F.when(n >= 2, normalize_country(F.element_at(parts, -1), codes)["value"])

        def placed(country: Column) -> Column:
            middle = F.when(country.isNotNull(), n - 2).otherwise(n - 1)
            region = F.when((n >= 2) & (middle > 0), clean_string(F.array_join(F.slice(parts, 2, F.greatest(middle, F.lit(1))), ", ")))
            return F.when(n >= 1, F.struct(clean_string(F.get(parts, F.lit(0))).alias("city"), region.alias("region"), country.alias("country")))

        return result(let(known, placed), F.lit(1.0))

    return let(F.filter(F.transform(F.split(x, ","), strip), lambda p: p != ""), read)


def normalize_years(x: Column) -> Column:
    """A plain decimal number from 0 to 70."""
    text = strip(x.cast("string"))
    years = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return result(F.when(years.between(0, 70), years), F.lit(1.0))
