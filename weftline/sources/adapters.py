"""The four adapters. Each gives (bundle_id, source, src_ord, rec_ord, raw..., audit)."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.recognize import find_emails, find_phones, find_urls
from weftline.settings import SOURCES

EVENT = "struct<stage:string,field:string,kind:string,reason:string,details:map<string,string>>"


def event(stage: str, field: str, kind: str, reason: str, **details: Column | str) -> Column:
    """One audit event as a struct."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), table.cast("map<string,string>").alias("details"))


def events(*pairs: tuple[Column, Column]) -> Column:
    """The events whose condition holds."""
    picked = F.array(*[F.when(c, e) for c, e in pairs])
    return F.filter(picked, lambda e: e.isNotNull())


def _of(payloads: DataFrame, source: str) -> DataFrame:
    return payloads.where((F.col("source") == source) & F.col("payload").isNotNull() & (F.col("payload") != ""))


def _csv_rows(batches):
    """Rows of CSV payloads. Headers differ by payload and cells may hold line ends, which no built-in function parses
    from a column."""
    kinds = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
    names = ["bundle_id", "rec_ord", "raw", "extra", "kind", "error"]
    for batch in batches:
        out = []
        for bundle, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text.removeprefix("﻿")
            if not text.strip():
                out.append((bundle, None, None, None, "empty_payload", None))
                continue
            try:
                rows = list(csv.DictReader(io.StringIO(text), restkey="\0"))
            except (csv.Error, ValueError) as e:
                out.append((bundle, None, None, None, "parse_failed", str(e)))
                continue
            if not rows:
                out.append((bundle, None, None, None, "no_data_rows", None))
            for i, row in enumerate(rows):
                extra = row.pop("\0", None)
                cells = [(k, v.strip() if v is not None else None) for k, v in row.items() if k is not None]
                out.append((bundle, i, cells, extra, None, None))
        cols = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def csv_records(payloads: DataFrame) -> DataFrame:
    """Adds raw map<string,string> of a row's cells by header, stripped, and extra: cells beyond the header. A payload
    that is not CSV gives no row at all. Rows without record carry the source's event."""
    source = SOURCES[0]
    rows = _of(payloads, source).select("bundle_id", "payload").mapInArrow(_csv_rows, "bundle_id string, rec_ord int, raw map<string,string>, extra array<string>, kind string, error string")
    audit = events(
        (F.col("kind").isin("empty_payload", "no_data_rows"), event("extract", "payload", "source_empty", "", source=source)),
        (F.col("kind") == "parse_failed", event("extract", "payload", "source_failed", "parse_failed", source=source, error=F.col("error"))),
        (F.size("extra") > 0, event("extract", "row._extra", "entry_flagged", "overflow_columns_preserved", source=source, row_index=F.col("rec_ord"))),
    )
    named = F.transform(audit, lambda e: F.when(F.col("kind").isin("empty_payload", "no_data_rows"), e.withField("reason", F.col("kind")).withField("field", F.when(F.col("kind") == "no_data_rows", F.lit("records")).otherwise(F.lit("payload")))).otherwise(e))
    return rows.select("bundle_id", F.lit(source).alias("source"), F.lit(0).alias("src_ord"), "rec_ord", "raw", "extra", named.cast(f"array<{EVENT}>").alias("audit"))


def shape(v: Column) -> Column:
    """OBJECT, ARRAY, or another kind of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def ats_records(payloads: DataFrame) -> DataFrame:
    """Adds raw VARIANT: the object itself, or each object of an array; other elements are dropped."""
    source = SOURCES[1]
    p = _of(payloads, source).withColumn("v", F.try_parse_json("payload"))
    kind = shape(F.col("v"))
    items = F.when(kind == "OBJECT", F.array("v")).when(kind == "ARRAY", F.try_variant_get("v", "$", "array<variant>"))
    blank = F.col("payload").rlike(r"(?U)^\s*$")
    p = p.withColumns({"kind": kind, "items": items})
    good = F.size(F.filter("items", lambda x: shape(x) == "OBJECT"))
    whole = events(
        (blank, event("extract", "payload", "source_empty", "empty_payload", source=source)),
        (~blank & F.col("v").isNull(), event("extract", "payload", "source_failed", "parse_failed", source=source)),
        (F.col("v").isNotNull() & F.col("items").isNull(), event("extract", "payload", "source_failed", "unexpected_top_level_type", source=source)),
        (F.col("items").isNotNull() & (F.coalesce(good, F.lit(0)) == 0), event("extract", "records", "source_empty", "no_valid_candidates", source=source)),
    )
    p = p.withColumn("audit", whole)
    rows = p.select("bundle_id", "audit", F.posexplode_outer("items").alias("pos", "raw"))
    is_object = shape(F.col("raw")) == "OBJECT"
    dropped = event("extract", "records", "entry_dropped", "non_object_candidate", source=source, row_index=F.col("pos"))
    audit = F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("audit")).otherwise(F.array().cast(f"array<{EVENT}>"))
    audit = F.concat(audit, events((F.col("pos").isNotNull() & ~F.coalesce(is_object, F.lit(False)), dropped)))
    return rows.select("bundle_id", F.lit(source).alias("source"), F.lit(1).alias("src_ord"), F.when(is_object, F.col("pos")).alias("rec_ord"), F.when(is_object, F.col("raw")).alias("raw"), audit.cast(f"array<{EVENT}>").alias("audit"))


def github_records(payloads: DataFrame) -> DataFrame:
    """Adds profile VARIANT and repos array<VARIANT>: one record for each payload that has either."""
    source = SOURCES[2]
    p = _of(payloads, source).withColumn("v", F.try_parse_json("payload"))
    profile, repos = F.try_variant_get("v", "$.profile", "variant"), F.try_variant_get("v", "$.repos", "array<variant>")
    p = p.withColumns({"profile": profile, "all": repos}).withColumn("profile", F.when(shape(F.col("profile")) == "OBJECT", F.col("profile")))
    keep = F.col("profile").isNotNull() | F.col("all").isNotNull()
    blank = F.col("payload").rlike(r"(?U)^\s*$")
    audit = events(
        (blank, event("extract", "payload", "source_empty", "empty_payload", source=source)),
        (~blank & F.col("v").isNull(), event("extract", "payload", "source_failed", "parse_failed", source=source)),
        (F.col("v").isNotNull() & (shape(F.col("v")) != "OBJECT"), event("extract", "payload", "source_failed", "unexpected_top_level_type", source=source)),
        ((shape(F.col("v")) == "OBJECT") & ~keep, event("extract", "payload", "source_empty", "no_profile_or_repos", source=source)),
    )
    lost = F.transform(F.filter(F.coalesce("all", F.array().cast("array<variant>")), lambda r: F.coalesce(shape(r), F.lit("")) != "OBJECT"), lambda r: event("extract", "repos[]", "entry_dropped", "non_object_repo", source=source))
    objects = F.filter(F.coalesce("all", F.array().cast("array<variant>")), lambda r: shape(r) == "OBJECT")
    return p.select("bundle_id", F.lit(source).alias("source"), F.lit(2).alias("src_ord"), F.when(keep, F.lit(0)).alias("rec_ord"), "profile", objects.alias("repos"), F.concat(audit, lost).cast(f"array<{EVENT}>").alias("audit"))


def notes_records(payloads: DataFrame, taxonomy: DataFrame | None = None, region: str = "IN") -> DataFrame:
    """Adds emails, urls, phones and skills that a note's text holds."""
    from weftline.operators.skills import link_prose

    source = SOURCES[3]
    p = _of(payloads, source)
    blank = F.col("payload").rlike(r"(?U)^\s*$")
    none = F.array().cast("array<struct<canonical:string,surface:string,score:int,method:string>>")
    skills = none
    if taxonomy is not None:
        # Equal notes are read once; they are told apart by 128 bits.
        p = p.withColumns({"__1": F.xxhash64("payload"), "__2": F.xxhash64(F.lit(1), "payload")})
        linked = link_prose(p.select("__1", "__2", "payload").dropDuplicates(["__1", "__2"]), ["__1", "__2"], "payload", taxonomy)
        p = p.join(linked, ["__1", "__2"], "left")
        skills = F.coalesce("skills", none)
    rows = p.withColumns({"emails": find_emails(F.col("payload")), "urls": find_urls(F.col("payload")), "phones": find_phones(F.col("payload"), region), "skills": skills})
    seen = F.transform("skills", lambda s: event("extract", "skills", "value_recognized", "skill_candidate_linked", source=source, raw_value=s["surface"], canonical=s["canonical"], score=s["score"], match_method=s["method"]))
    missing = events(*[(F.size(f) == 0, event("extract", f, "field_missing", "no_values_recognized", source=source)) for f in ("emails", "phones", "urls", "skills")])
    audit = F.when(blank, F.array(event("extract", "payload", "source_empty", "empty_payload", source=source))).otherwise(F.concat(seen, missing))
    return rows.select("bundle_id", F.lit(source).alias("source"), F.lit(3).alias("src_ord"), F.when(~blank, F.lit(0)).alias("rec_ord"), "emails", "urls", "phones", "skills", F.lit(region).alias("region"), audit.cast(f"array<{EVENT}>").alias("audit"))
