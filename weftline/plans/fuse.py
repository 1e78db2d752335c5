"""Fusion of normalised records to one profile for each candidate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.confidence import noisy_or_agg
from weftline.functions.text import company_key, institution_key, project_key
from weftline.operators.clusters import greedy_clusters
from weftline.operators.evidence import group_values, losing_values, merge_multi, merge_single
from weftline.operators.linkage import candidates
from weftline.operators.score import candidate_id, list_mean, overall_confidence
from weftline.operators.skills import canonicalize
from weftline.plans.normalize import NORMALIZERS, unknown_sources
from weftline.scratch import cut
from weftline.settings import ENTRIES, LINKS, SOURCES
from weftline.sources.adapters import ats_records, csv_records, github_records, notes_records

BY = ["bundle_id", "root"]
_LOCATION = "struct<city:string,country:string,region:string>"


@dataclass
class Fused:
    """profiles: a row for each candidate; audit: (bundle_id, root, stage, field, kind, reason, details), root null for
    events of a whole payload."""

    profiles: DataFrame
    audit: DataFrame


def normalized(payloads: DataFrame, taxonomy: DataFrame | None = None, region: str = "IN") -> DataFrame:
    """All sources' records, and rows without record that carry a payload's events. Payloads: (bundle_id, source,
    payload); empty ones are skipped."""
    raw = [csv_records(payloads), ats_records(payloads), github_records(payloads), notes_records(payloads, taxonomy, region)]
    out = None
    for source, rows in zip(SOURCES, raw):
        n = NORMALIZERS[source](rows)
        out = n if out is None else out.unionByName(n)
    node = F.concat_ws("|", F.coalesce("bundle_id", F.lit("")), F.col("src_ord").cast("string"), F.lpad(F.col("rec_ord").cast("string"), 10, "0"))
    return out.withColumn("node", F.when(F.col("rec_ord").isNotNull(), node))


def _observations(records: DataFrame, taxonomy: DataFrame | None) -> DataFrame:
    o = records.select(*BY, "node", "source", F.posexplode("obs").alias("pos", "o")).select(*BY, "node", "source", "pos", "o.*")
    o = o.withColumn("ord", F.concat_ws("|", "node", F.lpad(F.col("pos").cast("string"), 8, "0")))
    skills = canonicalize(o.where("field = 'skills'"), "value", taxonomy, "canonical").drop("value").withColumnRenamed("canonical", "value")
    # A source other than the first counts a skill once for each record.
    once = skills.where(F.col("source") != SOURCES[0]).groupBy("node", F.lower("value").alias("k")).agg(F.min_by(F.struct(*[c for c in skills.columns if c != "node"]), "ord").alias("x")).select("node", "x.*")
    kept = skills.where(F.col("source") == SOURCES[0]).unionByName(once)
    return o.where("field <> 'skills'").unionByName(kept).drop("pos")


def _entries(records: DataFrame) -> DataFrame:
    """Entries with the key and the evidence by which they are clustered."""
    e = records.select(*BY, "node", "source", F.posexplode("entries").alias("pos", "e")).select(*BY, "node", "source", "pos", "e.*")
    part = lambda name: F.try_element_at("parts", F.lit(name))
    family = F.col("family")
    key = F.when(family == "experience", company_key(part("company"))).when(family == "education", institution_key(part("institution"))).otherwise(project_key(part("name")))
    first = F.when(family == "experience", part("start")).when(family == "education", part("end_year")).otherwise(part("url"))
    return e.withColumns({"ord": F.concat_ws("|", "node", F.lpad(F.col("pos").cast("string"), 8, "0")), "key": key, "e1": first, "e2": F.when(family == "experience", part("end"))})


def _placeholder(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit("merge").alias("source"), F.lit("merged").alias("method"), F.lit(0.0).alias("confidence"))


def _event_rows(df: DataFrame, by: list[str], when: Column, field: Column | str, kind: str, reason: str, **details: Column) -> DataFrame:
    field = F.lit(field) if isinstance(field, str) else field
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.where(when).select(*by, F.lit("merge").alias("stage"), field.alias("field"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), table.alias("details"))


def single_events(singles: DataFrame, losers: DataFrame, by: list[str], keys: list[str], name: Column) -> DataFrame:
    """(by..., stage, field, kind, reason, details) of what merge_single decided for (keys..., field): conflicts, values
    that several sources agree on, and fields under the threshold."""
    confidence = F.round("confidence", 6)
    rows = singles.join(losers, [*keys, "field"], "left")
    winner = {"winner_source": F.col("source"), "winner_value": F.col("value"), "winner_confidence": confidence}
    out = _event_rows(rows, by, F.col("n_groups") > 1, name, "conflict_resolved", "highest_confidence_group_won", **winner, losing_values=F.to_json("losers"))
    out = out.union(_event_rows(rows, by, (F.col("n_groups") == 1) & (F.size("sources") > 1), name, "agreement_merged", "multiple_sources_agreed", sources=F.to_json("sources"), confidence=confidence))
    return out.union(_event_rows(rows, by, ~F.col("kept"), name, "field_dropped", "winner_below_threshold", **winner))


def _merge_audit(singles: DataFrame, losers: DataFrame, multis: DataFrame, entries: DataFrame, roots: DataFrame) -> DataFrame:
    out = single_events(singles, losers, BY, BY, F.col("field"))
    out = out.union(_event_rows(multis.select(*BY, "field", F.explode("items").alias("i")), BY, F.size("i.sources") > 1, F.col("field"), "agreement_merged", "duplicate_values_collapsed", value=F.col("i.value"), sources=F.to_json("i.sources"), confidence=F.round("i.confidence", 6)))
    jobs = entries.where("family = 'experience'")
    out = out.union(_event_rows(jobs, BY, F.col("anchor").isNull(), "experience", "entry_dropped", "company_anchor_missing_after_merge", sources=F.to_json("sources")))
    out = out.union(_event_rows(jobs, BY, F.col("anchor").isNotNull() & (F.size("sources") > 1), "experience", "entry_merged", "matching_company_entries_collapsed", sources=F.to_json("sources"), company=F.col("anchor")))
    wanted = roots.select(*BY, F.explode(F.array(*[F.lit(f) for f in ("full_name", "location", "headline", "years_experience")])).alias("field"))
    return out.union(_event_rows(wanted.join(singles.select(*BY, "field"), [*BY, "field"], "left_anti"), BY, F.lit(True), F.col("field"), "field_missing", "no_source_provided_value"))


def fuse(payloads: DataFrame, taxonomy: DataFrame | None = None, region: str = "IN") -> Fused:
    """Profiles and audit of payloads (bundle_id, source, payload)."""
    rows = cut(normalized(payloads, taxonomy, region), "normalized")
    return fuse_records(rows, taxonomy, unknown_sources(payloads))


def fuse_records(rows: DataFrame, taxonomy: DataFrame | None = None, more_events: DataFrame | None = None) -> Fused:
    """Fusion of normalised rows, as `normalized` gives them.

    Records are linked, then all observations of a candidate are fused by aggregations on (candidate, field, value);
    what is put together at the end is one row for each distinct value, entry and candidate.
    """
    records = rows.where("node IS NOT NULL")
    anchor = F.filter("obs", lambda o: o["field"].isin("emails", "phones"))
    tokens = records.select("bundle_id", "node", F.explode(F.transform(anchor, lambda o: F.concat_ws(":", o["field"], F.lower(o["value"])))).alias("token")).distinct()
    placed = cut(candidates(records, tokens), "placed")
    records = records.join(placed.select("node", "root"), "node")

    obs = _observations(records, taxonomy)
    groups = cut(group_values(obs, BY), "groups")
    many = F.col("field").isin("emails", "phones", "skills", "links.other")
    one_value = groups.where(~many)
    singles, multis = merge_single(one_value, BY), merge_multi(groups.where(many), BY)

    clustered = cut(greedy_clusters(_entries(records), [*BY, "family"], "key", ["e1", "e2"]), "clustered")
    cluster = [*BY, "family", "key", "cluster"]
    pieces = clustered.select(*cluster, "source", "method", "confidence", "ord", F.explode("parts").alias("field", "value")).where("value <> ''")
    part_groups = group_values(pieces, cluster)
    parts = merge_single(part_groups, cluster)
    heads = clustered.groupBy(*cluster).agg(noisy_or_agg(F.col("confidence")).alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    values = parts.where("kept").groupBy(*cluster).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("v"))
    entries = heads.join(values, cluster, "left")
    lead = F.when(F.col("family") == "experience", F.lit("company")).when(F.col("family") == "education", F.lit("institution")).otherwise(F.lit("name"))
    entries = entries.withColumn("anchor", F.try_element_at("v", lead))

    roots = records.select(*BY).distinct()
    one = lambda name: F.max(F.when((F.col("field") == name) & F.col("kept"), F.struct("value", "source", "method", "confidence")))
    scalar = singles.groupBy(*BY).agg(*[one(f).alias(f) for f in ("full_name", "location", "headline", "years_experience")], *[one(f"links.{n}").alias(f"l_{n}") for n in LINKS])
    lists = multis.groupBy(*BY).agg(*[F.first(F.when(F.col("field") == f, F.col("items")), ignorenulls=True).alias(a) for f, a in (("emails", "emails"), ("phones", "phones"), ("skills", "skills"), ("links.other", "l_other"))])
    get = lambda n: F.try_element_at("v", F.lit(n))

    def listed(family: str) -> Column:
        own = [get(n).try_cast("int").alias(n) if n == "end_year" else get(n).alias(n) for n in ENTRIES[family]]
        order = {"experience": ["start", "end"], "education": ["end_year"], "projects": []}[family]
        keys = [F.lower("anchor").alias("k0"), *[F.coalesce(get(n), F.lit("")).alias(f"k_{n}") for n in order], F.col("cluster")]
        item = F.struct(*keys, F.struct(*own, F.col("confidence"), F.col("sources")).alias("e"))
        return F.transform(F.array_sort(F.collect_list(F.when((F.col("family") == family) & F.col("anchor").isNotNull(), item))), lambda x: x["e"])

    families = entries.groupBy(*BY).agg(*[listed(f).alias(f) for f in ENTRIES])
    p = roots.join(scalar, BY, "left").join(lists, BY, "left").join(families, BY, "left")

    array = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    items = "array<struct<value:string,confidence:double,sources:array<string>>>"
    kinds = {f: f"array<{families.schema[f].dataType.elementType.simpleString()}>" for f in ENTRIES}
    p = p.withColumns({n: array(n, items) for n in ("emails", "phones", "skills", "l_other")} | {f: array(f, k) for f, k in kinds.items()})

    place = F.from_json("location.value", _LOCATION)
    location = F.struct(F.struct(*[place[n].alias(n) for n in ("city", "region", "country")]).alias("value"), F.col("location.source").alias("source"), F.col("location.method").alias("method"), F.col("location.confidence").alias("confidence"))
    none = F.lit(None).cast("string")
    links_sources = F.array_sort(F.array_distinct(F.concat(F.filter(F.array(*[F.col(f"l_{n}.source") for n in LINKS]), lambda x: x.isNotNull()), F.flatten(F.transform("l_other", lambda x: x["sources"])))))
    confidences = F.filter(F.array(*[F.col(f"l_{n}.confidence") for n in LINKS], list_mean(F.col("l_other"))), lambda c: c.isNotNull())
    n_links = F.size(confidences)
    link_value = F.struct(*[F.col(f"l_{n}.value").alias(n) for n in LINKS], F.transform("l_other", lambda x: x["value"]).alias("other"))
    links = F.when(n_links > 0, F.struct(link_value.alias("value"), F.get(links_sources, F.lit(0)).alias("source"), F.when(F.size(links_sources) > 1, F.lit("merged")).otherwise(F.lit("direct")).alias("method"), (F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / n_links).alias("confidence")))
    no_links = F.struct(none.alias("linkedin"), none.alias("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other"))
    years = F.col("years_experience")
    quoted = lambda x: F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null"))
    # Fixed format: the place as JSON with its keys in order, as far as a candidate's name depends on it.
    place_json = F.when(F.col("location").isNotNull(), F.concat(F.lit('{"city": '), quoted(place["city"]), F.lit(', "country": '), quoted(place["country"]), F.lit(', "region": '), quoted(place["region"]), F.lit("}")))
    best = lambda name: F.get(F.array_sort(F.transform(name, lambda x: F.struct((-x["confidence"]).alias("c"), x["value"].alias("v")))), F.lit(0))["v"]
    p = p.withColumn("candidate_id", candidate_id(best("emails"), F.col("full_name.value"), best("phones"), place_json))
    p = p.withColumns(
        {
            "location": F.when(F.col("location").isNotNull(), location).otherwise(_placeholder(F.struct(none.alias("city"), none.alias("region"), none.alias("country")))),
            "links": F.coalesce(links, _placeholder(no_links)),
            "full_name": F.coalesce("full_name", _placeholder(F.lit(""))),
            "headline": F.coalesce("headline", _placeholder(none)),
            "years_experience": F.when(years.isNotNull(), F.struct(years["value"].cast("double").alias("value"), years["source"].alias("source"), years["method"].alias("method"), years["confidence"].alias("confidence"))).otherwise(_placeholder(F.lit(None).cast("double"))),
        }
    )
    single = {f: F.col(f"{f}.confidence") for f in ("full_name", "location", "links", "headline", "years_experience")}
    several = {f: list_mean(F.col(f)) for f in ("emails", "phones", "skills", *ENTRIES)}
    p = p.withColumn("overall_confidence", overall_confidence(single | several))
    p = p.withColumn("provenance", provenance())
    p = p.withColumn("skills", F.transform("skills", lambda x: F.struct(x["value"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources"))))
    names = ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", *ENTRIES, "overall_confidence", "provenance"]
    profiles = p.select(*BY, *names)

    audit = _merge_audit(singles, losing_values(one_value, singles, BY), multis, entries, roots)
    audit = audit.union(single_events(parts, losing_values(part_groups, parts, cluster), BY, cluster, F.concat_ws(".", "family", "field")))
    shared = rows.select("bundle_id", F.lit(None).cast("string").alias("root"), F.explode("shared_audit").alias("e")).select(*BY, "e.*")
    own = records.select(*BY, F.explode("audit").alias("e")).select(*BY, "e.*")
    audit = shared.union(own).union(audit)
    if more_events is not None:
        audit = audit.unionByName(more_events.withColumn("root", F.lit(None).cast("string")).select(*audit.columns))
    return Fused(profiles, audit)


def provenance() -> Column:
    """Where each field comes from: one row for each single value, and for each source of each list item."""
    row = lambda f, s, m: F.struct(F.lit(f).alias("field"), s.alias("source"), m.alias("method"))
    single = F.array(*[row(f, F.col(f"{f}.source"), F.col(f"{f}.method")) for f in ("full_name", "location", "links", "headline", "years_experience")])

    def of_list(f: str) -> Column:
        return F.flatten(F.transform(f, lambda x: F.transform(x["sources"], lambda s: row(f, s, F.lit("merged")))))

    several = [of_list(f) for f in ("emails", "phones", "skills", *ENTRIES)]
    return F.array_sort(F.concat(single, *several))
