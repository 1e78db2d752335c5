"""The whole way from payloads to projected profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.plans.fuse import fuse
from weftline.plans.project import Projection, project


def run(payloads: DataFrame, config: dict | str | Projection | None = None, taxonomy: DataFrame | None = None, include_audit: bool = False, region: str = "IN", on_error: str = "fail") -> DataFrame:
    """(bundle_id, root, output[, audit_log]) for payloads (bundle_id, source, payload). With include_audit each row
    carries its bundle's and its candidate's events as an array. A bundle without any record gives no row; the audit
    table of `fuse` tells why."""
    config = config if isinstance(config, Projection) else Projection.parse(config)
    fused = fuse(payloads, taxonomy, region)
    out = project(fused.profiles, config, on_error)
    if on_error == "fail":
        out = out.drop("errors")
    if not include_audit:
        return out
    one = F.struct("stage", "field", "kind", "reason", "details")
    shared = fused.audit.where("root IS NULL").groupBy("bundle_id").agg(F.collect_list(one).alias("__s"))
    own = fused.audit.where("root IS NOT NULL").groupBy("bundle_id", "root").agg(F.collect_list(one).alias("__o"))
    none = F.array().cast(shared.schema["__s"].dataType)
    rows = out.join(shared, "bundle_id", "left").join(own, ["bundle_id", "root"], "left")
    return rows.withColumn("audit_log", F.concat(F.coalesce("__s", none), F.coalesce("__o", none))).drop("__s", "__o")
