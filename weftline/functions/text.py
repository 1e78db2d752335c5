"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from weftline.settings import COMPANY_SUFFIXES


@F.pandas_udf(T.StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def let(x: Column, use) -> Column:
    """use(x) with x computed once and written once into the plan, however often use refers to it. A plan that repeats
    its inputs at each level grows with the power of its depth."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space, of any kind in Unicode, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_string(x: Column, nfc: bool = False) -> Column:
    """Runs of white space become one blank, none at the ends; nothing left gives null. With nfc the text is composed
    first (Unicode form C), which Spark has no function for: an Arrow UDF does it, for non-ASCII texts only."""
    text = F.when(x.rlike(r"[^\x00-\x7F]"), _nfc(x)).otherwise(x) if nfc else x
    return F.nullif(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def normalize_alias(x: Column) -> Column:
    """Key of a skill's written form: folded case; blanks, underscores, slashes and hyphens are one blank; other marks
    than + # . go."""
    # Beyond lower case, folding makes two letters of ß and one of the two forms of sigma.
    folded = F.replace(F.replace(F.lower(clean_string(x)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    text = F.regexp_replace(folded, r"(?U)[\s_/-]+", " ")
    text = F.regexp_replace(text, r"(?U)[^\w+#. ]+", "")
    return clean_string(text)


def company_key(x: Column) -> Column:
    """Company name without case, marks and the words that only state its legal form; null gives the empty key."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]+", " "), " "), lambda w: w != "")
    joined = F.concat(F.lit(" "), F.array_join(words, " "))
    return F.ltrim(F.regexp_replace(joined, f"( ({'|'.join(COMPANY_SUFFIXES)}))+$", ""))


def institution_key(x: Column) -> Column:
    """Institution name without case and marks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " "))


def project_key(x: Column) -> Column:
    """Project name without case, blanks collapsed."""
    return F.coalesce(clean_string(F.lower(x)), F.lit(""))


def split_cells(x: Column, marks: str = ";,") -> Column:
    """Parts of a cell between any of the marks, without blank ones."""
    return F.filter(F.split(x, "[" + marks.replace("|", r"\|") + "]"), lambda p: strip(p) != "")


def first_of_each(values: Column, key=F.lower) -> Column:
    """An array without elements whose key an earlier one has."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)
