"""Overall confidence of a profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.settings import FAMILY_WEIGHTS


def list_mean(items: Column) -> Column:
    """Mean confidence of an array of structs; null for none."""
    n = F.size(items)
    return F.when(n > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x["confidence"]) / n)


def overall_confidence(families: dict[str, Column]) -> Column:
    """Weighted mean over families that are not null and over 0; 0 if none is. Families are summed in a fixed order."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in FAMILY_WEIGHTS.items():
        if name in families:
            c = families[name]
            there = c.isNotNull() & (c > 0)
            top = top + F.when(there, c * weight).otherwise(0.0)
            bottom = bottom + F.when(there, weight).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def candidate_id(email: Column, name: Column, phone: Column, location_json: Column) -> Column:
    """Name of a candidate from the best e-mail, else name and phone, else name and place, else the name."""
    has = lambda c: c.isNotNull()
    base = F.when(has(email), email).when(has(name) & has(phone), F.concat_ws("|", name, phone)).when(has(name) & has(location_json), F.concat_ws("|", name, location_json)).when(has(name), name).otherwise("candidate")
    return F.concat(F.lit("cand_"), F.substring(F.sha2(base, 256), 1, 8))
