"""Confidence arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.settings import CONFLICT_FLOOR, CONFLICT_STEP, METHOD_TRUST, SOURCE_TRUST


def _pick(x: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, v in table.items():
        out = F.when(x == name, F.lit(v)).otherwise(out)
    return out


def base_confidence(source: Column | str, method: Column | str, validity: Column) -> Column:
    """Trust in the source times trust in the method times validity."""
    s = F.lit(SOURCE_TRUST[source]) if isinstance(source, str) else _pick(source, SOURCE_TRUST)
    m = F.lit(METHOD_TRUST[method]) if isinstance(method, str) else _pick(method, METHOD_TRUST)
    return s * m * validity


def noisy_or(confidences: Column) -> Column:
    """Of an array: 1 less the product of the doubts, within 0 and 1; 0 for none."""
    doubt = F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1.0 - c))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - doubt))


def noisy_or_agg(confidence: Column) -> Column:
    """The same as an aggregate, combined before the shuffle."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.product(1.0 - confidence)))


def conflict_penalty(losing_sources: Column) -> Column:
    return F.greatest(F.lit(CONFLICT_FLOOR), 1.0 - CONFLICT_STEP * losing_sources)
