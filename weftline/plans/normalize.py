"""Raw records to normalised ones: (bundle_id, source, src_ord, rec_ord, obs, entries, audit).

obs is an array of (field, value, method, confidence), entries an array of (family, parts, method, confidence). Values
are strings; a location is JSON with its keys in order, so that equal values are equal strings. Skills keep their
written form until fusion links them, each distinct one once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.functions.confidence import base_confidence
from weftline.functions.formats import classify_location, normalize_date, normalize_email, normalize_phone, normalize_url, normalize_years
from weftline.functions.recognize import link_classes
from weftline.functions.text import clean_string, first_of_each, let, split_cells
from weftline.settings import SOURCES
from weftline.sources.adapters import EVENT, event, events, shape

OBS = "array<struct<field:string,value:string,method:string,confidence:double>>"
ENTRIES = "array<struct<family:string,parts:map<string,string>,method:string,confidence:double>>"


def _obs(field: str, value: Column, source: str, method: str | Column, validity: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (F.lit(method) if isinstance(method, str) else method).alias("method"), base_confidence(source, method, validity).alias("confidence"))


def _one(field: str, normal: Column, source: str, method: str = "direct") -> Column:
    """Zero or one observation of struct<value, validity>."""
    return F.filter(F.transform(F.array(normal), lambda r: _obs(field, r["value"], source, method, r["validity"])), lambda o: o["value"].isNotNull())


def _many(field: str, values: Column, source: str, method: str = "direct", normal: Callable | None = None) -> Column:
    n = normal or (lambda v: F.struct(v.alias("value"), F.lit(1.0).alias("validity")))
    return F.filter(F.transform(F.transform(values, lambda v: n(v)), lambda r: _obs(field, r["value"], source, method, r["validity"])), lambda o: o["value"].isNotNull())


def _text(x: Column) -> Column:
    return F.struct(clean_string(x, nfc=True).alias("value"), F.lit(1.0).alias("validity"))


def _place(x: Column) -> Column:

    def said(at: Column) -> Column:
        v = at["value"]
        ordered = F.to_json(F.struct(v["city"].alias("city"), v["country"].alias("country"), v["region"].alias("region")), {"ignoreNullFields": "false"})
        return F.struct(F.when(v.isNotNull(), ordered).alias("value"), at["validity"].alias("validity"))

    return let(classify_location(x), said)


def _entry(family: str, parts: dict[str, Column], source: str, validity: Column) -> Column:
    pairs = [x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(family).alias("family"), F.create_map(*pairs).alias("parts"), F.lit("direct").alias("method"), base_confidence(source, "direct", validity).alias("confidence"))


def experience(company: Column, title: Column, start: Column, end: Column, source: str) -> Column:
    """A position; its validity is the least of the dates given, so a date that can't be read takes all its weight."""
    given = lambda raw: raw.isNotNull() & (raw != "")

    def built(d: Column) -> Column:
        parts = {"company": clean_string(company), "title": clean_string(title), "start": d["s"]["value"], "end": d["e"]["value"], "summary": F.lit(None)}
        return _entry("experience", parts, source, F.least(F.when(given(start), d["s"]["validity"]).otherwise(1.0), F.when(given(end), d["e"]["validity"]).otherwise(1.0)))

    return let(F.struct(normalize_date(start).alias("s"), normalize_date(end).alias("e")), built)


def education(institution: Column, degree: Column, field: Column, year: Column, source: str) -> Column:

    def built(d: Column) -> Column:
        parts = {"institution": clean_string(institution), "degree": clean_string(degree), "field": clean_string(field), "end_year": F.substring(d["value"], 1, 4).try_cast("int")}
        return _entry("education", parts, source, F.when(year.isNull() | (year == ""), 1.0).otherwise(d["validity"]))

    return let(normalize_date(year), built)


def _anchored(entries: Column, part: str) -> Column:
    return F.filter(entries, lambda e: e["parts"][part].isNotNull())


def _links(normal: Column, source: str, method: str) -> Column:
    """Observations of classed links; their validity does not count."""

    def observed(classed: Column) -> Column:
        one = lambda name: F.filter(F.array(_obs(f"links.{name}", classed[name], source, method, F.lit(1.0))), lambda o: o["value"].isNotNull())
        return F.concat(one("linkedin"), one("github"), _many("links.other", classed["other"], source, method))

    return let(let(normal, lambda urls: link_classes(urls)), observed)


def _missing(source: str, *pairs: tuple[str, Column]) -> Column:
    return events(*[(c, event("normalize", f, "field_missing", "source_field_absent", source=source)) for f, c in pairs])


def _failed(field: str, raw: Column, ok: Column, source: str) -> tuple[Column, Column]:
    given = raw.isNotNull() & (raw != "")
    return given & ~F.coalesce(ok, F.lit(False)), event("normalize", field, "value_dropped", "failed_normalization", source=source, raw_value=raw)


def _finish(rows: DataFrame, obs: list[Column], entries: list[Column], audit: list[Column]) -> DataFrame:
    there = F.col("rec_ord").isNotNull()
    none = lambda kind: F.array().cast(kind)
    join = lambda cols, kind: F.concat(none(kind), *[F.coalesce(c, none(kind)).cast(kind) for c in cols])
    return rows.select(
        "bundle_id",
        "source",
        "src_ord",
        "rec_ord",
        F.when(there, join(obs, OBS)).otherwise(none(OBS)).alias("obs"),
        F.when(there, join(entries, ENTRIES)).otherwise(none(ENTRIES)).alias("entries"),
        F.col("audit").alias("shared_audit"),
        F.when(there, join(audit, f"array<{EVENT}>")).otherwise(none(f"array<{EVENT}>")).alias("audit"),
    )


def normalize_csv(rows: DataFrame) -> DataFrame:
    s = SOURCES[0]
    get = lambda name: F.try_element_at("raw", F.lit(name))
    name = F.nullif(F.concat_ws(" ", clean_string(get("first_name"), True), clean_string(get("last_name"), True)), F.lit(""))
    normal = {"emails": normalize_email(get("email")), "phones": normalize_phone(get("phone")), "location": _place(get("location")), "links.linkedin": normalize_url(get("linkedin_url")), "headline": _text(get("headline")), "years_experience": normalize_years(get("years_experience"))}
    raw = {"emails": "email", "phones": "phone", "location": "location", "links.linkedin": "linkedin_url", "headline": "headline", "years_experience": "years_experience"}
    obs = [_one("full_name", F.struct(name.alias("value"), F.lit(1.0).alias("validity")), s)] + [_one(f, n, s) for f, n in normal.items()]
    obs.append(_many("skills", F.filter(F.transform(split_cells(get("top_skills")), lambda v: clean_string(v)), lambda v: v.isNotNull()), s))
    jobs = F.array(experience(get("current_company"), get("current_title"), get("current_title_start"), F.lit(None).cast("string"), s), experience(get("prev_company"), get("prev_title"), get("prev_start"), get("prev_end"), s))
    schools = F.array(education(get("education_institution"), get("education_degree"), get("education_field"), get("education_end_year"), s))
    empty = lambda c: c.isNull() | (c == "")
    any_of = lambda *names: ~F.array_join(F.array(*[F.coalesce(get(n), F.lit("")) for n in names]), "").eqNullSafe("")
    audit = [
        events((name.isNull(), event("normalize", "full_name", "field_missing", "no_name_parts", source=s))),
        events(*[_failed(f, get(raw[f]), normal[f]["value"].isNotNull(), s) for f in raw if f != "headline"]),
        _missing(s, *[(f, empty(get(raw[f]))) for f in raw], ("skills", empty(get("top_skills")))),
        events(
            (~empty(get("top_skills")) & (F.size(split_cells(get("top_skills"))) == 0), event("normalize", "skills", "field_dropped", "no_clean_skill_values", source=s, raw_value=get("top_skills"))),
            (clean_string(get("current_company")).isNull() & any_of("current_title", "current_title_start"), event("normalize", "experience.current", "entry_dropped", "missing_company_anchor", source=s)),
            (clean_string(get("prev_company")).isNull() & any_of("prev_title", "prev_start", "prev_end"), event("normalize", "experience.previous", "entry_dropped", "missing_company_anchor", source=s)),
            (clean_string(get("education_institution")).isNull() & any_of("education_degree", "education_field", "education_end_year"), event("normalize", "education", "entry_dropped", "missing_institution_anchor", source=s)),
        ),
        _missing(s, ("experience", ~any_of("current_company", "current_title", "current_title_start", "prev_company", "prev_title", "prev_start", "prev_end")), ("education", ~any_of("education_institution", "education_degree", "education_field", "education_end_year"))),
    ]
    return _finish(rows, obs, [_anchored(jobs, "company"), _anchored(schools, "institution")], audit)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _str(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


# Keys under which an object states a skill, the first of them that it has.
_SKILL_KEYS = ("name", "skill", "value", "label")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _skill_texts(x: pd.Series) -> pd.Series:
    """The strings in JSON values of any nesting, in order: all items of lists, and what objects have under their first
    usual key. Expressions have no recursion, so this is an Arrow UDF over whole batches."""

    def read(text: str | None) -> list[str]:
        out, todo = [], [json.loads(text)] if text else []
        while todo:
            v = todo.pop()
            if isinstance(v, str):
                out += re.split("[;,|]", v)
            elif isinstance(v, list):
                todo += reversed(v)
            elif isinstance(v, dict):
                todo += [v[k] for k in _SKILL_KEYS if k in v][:1]
        return [t for t in out if t.strip()]

    return x.map(read)


# Kept apart from the expressions that read it, some of which are lambdas, where it cannot run.
_skill_texts = _skill_texts.asNondeterministic()


def _skillish(name: Column) -> Column:
    return F.lower(name).rlike("skill|technolog|stack")


def _ats_skills(raw: Column) -> Column:
    """array<variant>: what the usual fields, and custom fields whose name says so, hold about skills."""
    plain = F.array(*[F.try_variant_get(raw, f"$.{k}", "variant") for k in ("skills", "skill_names", "technologies", "technology_names", "tech_stack")])
    custom = F.coalesce(F.try_variant_get(raw, "$.custom_fields", "variant"), F.try_variant_get(raw, "$.custom_fields_values", "variant"))
    table = F.coalesce(F.try_variant_get(custom, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    by_name = F.transform(F.filter(F.map_entries(table), lambda e: _skillish(e["key"])), lambda e: e["value"])
    label = lambda x: F.coalesce(_str(x, "$.name"), _str(x, "$.field_name"), _str(x, "$.label"))
    rows = F.filter(_list(custom, "$"), lambda x: F.coalesce(_skillish(label(x)), F.lit(False)))
    by_row = F.transform(rows, lambda x: F.coalesce(F.try_variant_get(x, "$.value", "variant"), F.try_variant_get(x, "$.values", "variant")))
    return F.concat(plain, F.when(shape(custom) == "OBJECT", by_name).otherwise(F.array().cast("array<variant>")), by_row)


def normalize_ats(rows: DataFrame) -> DataFrame:
    s, raw = SOURCES[1], F.col("raw")
    rows = rows.withColumn("written", _skill_texts(F.to_json(_ats_skills(raw))))
    rows = rows.withColumn("skills", first_of_each(F.filter(F.transform("written", lambda v: clean_string(v)), lambda v: v.isNotNull())))
    name = F.nullif(F.concat_ws(" ", clean_string(_str(raw, "$.first_name"), True), clean_string(_str(raw, "$.last_name"), True)), F.lit(""))
    values = lambda path: F.filter(F.transform(_list(raw, path), lambda x: _str(x, "$.value")), lambda v: v.isNotNull())
    emails, phones = values("$.email_addresses"), values("$.phone_numbers")
    place = _str(F.get(_list(raw, "$.addresses"), F.lit(0)), "$.value")
    urls = F.concat(values("$.website_addresses"), values("$.social_media_addresses"))
    urls = F.filter(F.transform(urls, lambda u: normalize_url(u)["value"]), lambda u: u.isNotNull())
    skills = F.col("skills")
    obs = [
        _one("full_name", F.struct(name.alias("value"), F.lit(1.0).alias("validity")), s),
        _many("emails", emails, s, normal=normalize_email),
        _many("phones", phones, s, normal=normalize_phone),
        _one("location", _place(place), s),
        _links(urls, s, "direct"),
        _many("skills", skills, s),
    ]
    jobs = F.transform(_list(raw, "$.employments"), lambda e: experience(_str(e, "$.company_name"), _str(e, "$.title"), _str(e, "$.start_date"), _str(e, "$.end_date"), s))
    schools = F.transform(_list(raw, "$.educations"), lambda e: education(_str(e, "$.school_name"), _str(e, "$.degree"), _str(e, "$.discipline"), _str(e, "$.end_date"), s))
    lost = lambda vs, f, normal: F.transform(F.filter(vs, lambda v: normal(v)["value"].isNull()), lambda v: event("normalize", f, "value_dropped", "failed_normalization", source=s, raw_value=v))
    bare = lambda path, f: F.transform(F.filter(_list(raw, path), lambda x: F.coalesce(shape(x), F.lit("")) != "OBJECT"), lambda x: event("normalize", f, "entry_dropped", "non_object_array_entry", source=s))
    unanchored = lambda es, f, part, reason: F.transform(F.filter(es, lambda e: e["parts"][part].isNull() & F.exists(F.map_values(e["parts"]), lambda v: v.isNotNull())), lambda e: event("normalize", f, "entry_dropped", reason, source=s))
    absent = lambda *paths: F.size(F.concat(*[_list(raw, p) for p in paths])) == 0
    audit = [
        events((name.isNull(), event("normalize", "full_name", "field_missing", "no_name_parts", source=s)), _failed("location", place, _place(place)["value"].isNotNull(), s)),
        lost(emails, "emails", normalize_email),
        lost(phones, "phones", normalize_phone),
        *[bare(p, f) for p, f in (("$.email_addresses", "emails"), ("$.phone_numbers", "phones"), ("$.website_addresses", "links"), ("$.social_media_addresses", "links"), ("$.employments", "experience"), ("$.educations", "education"))],
        unanchored(jobs, "experience", "company", "missing_company_anchor"),
        unanchored(schools, "education", "institution", "missing_institution_anchor"),
        _missing(s, ("emails", absent("$.email_addresses")), ("phones", absent("$.phone_numbers")), ("location", absent("$.addresses")), ("links", absent("$.website_addresses", "$.social_media_addresses")), ("experience", absent("$.employments")), ("education", absent("$.educations")), ("skills", F.size(skills) == 0)),
    ]
    return _finish(rows, obs, [_anchored(jobs, "company"), _anchored(schools, "institution")], audit)


def normalize_github(rows: DataFrame) -> DataFrame:
    s, p = SOURCES[2], F.col("profile")
    own = F.filter(F.coalesce("repos", F.array().cast("array<variant>")), lambda r: ~F.coalesce(F.try_variant_get(r, "$.fork", "boolean"), F.lit(False)))
    get = lambda name: _str(p, f"$.{name}")
    link = lambda field, name: _one(field, F.struct(normalize_url(get(name))["value"].alias("value"), F.lit(1.0).alias("validity")), s)
    languages = F.filter(F.transform(own, lambda r: clean_string(_str(r, "$.language"))), lambda v: v.isNotNull())
    obs = [_one("full_name", _text(get("name")), s), _one("headline", _text(get("bio")), s), _one("emails", normalize_email(get("email")), s), _one("location", _place(get("location")), s), link("links.github", "html_url"), link("links.portfolio", "blog"), _many("skills", first_of_each(languages), s, "inferred")]

    # An Arrow UDF cannot run inside a lambda, so repository names are not composed here.
    def plain(r: Column) -> Column:
        parts = {"name": clean_string(_str(r, "$.name")), "description": clean_string(_str(r, "$.description")), "url": normalize_url(_str(r, "$.html_url"))["value"], "primary_language": clean_string(_str(r, "$.language"))}
        return _entry("projects", parts, s, F.lit(1.0))

    projects = F.transform(own, plain)
    forks = F.filter(F.coalesce("repos", F.array().cast("array<variant>")), lambda r: F.coalesce(F.try_variant_get(r, "$.fork", "boolean"), F.lit(False)))
    said = lambda xs, f, kind, reason: F.transform(xs, lambda r: event("normalize", f, kind, reason, source=s, repo_name=_str(r, "$.name")))
    none = F.size(F.coalesce("repos", F.array().cast("array<variant>"))) == 0
    audit = [
        _missing(s, ("full_name", clean_string(get("name")).isNull()), ("headline", clean_string(get("bio")).isNull()), ("emails", get("email").isNull()), ("location", get("location").isNull()), ("links", (normalize_url(get("html_url"))["value"].isNull() & normalize_url(get("blog"))["value"].isNull())), ("projects", none), ("skills", none)),
        events(_failed("emails", get("email"), normalize_email(get("email"))["value"].isNotNull(), s), _failed("location", get("location"), _place(get("location"))["value"].isNotNull(), s)),
        said(forks, "projects", "entry_dropped", "fork_repo_excluded"),
        said(F.filter(own, lambda r: clean_string(_str(r, "$.name")).isNull()), "projects", "entry_dropped", "missing_project_name"),
        said(F.filter(own, lambda r: clean_string(_str(r, "$.language")).isNull()), "skills", "value_dropped", "missing_language_for_inference"),
    ]
    return _finish(rows, obs, [_anchored(projects, "name")], audit)


def normalize_notes(rows: DataFrame) -> DataFrame:
    s = SOURCES[3]
    urls = F.filter(F.transform("urls", lambda u: normalize_url(u)["value"]), lambda u: u.isNotNull())
    written = F.filter(F.transform(F.filter("phones", lambda p: ~p["bare"]), lambda p: _obs("phones", normalize_phone(p["raw"])["value"], s, "regex", normalize_phone(p["raw"])["validity"])), lambda o: o["value"].isNotNull())
    bare = F.filter(F.transform(F.filter("phones", lambda p: p["bare"]), lambda p: _obs("phones", normalize_phone(p["raw"], F.col("region"))["value"], s, "inferred", normalize_phone(p["raw"], F.col("region"))["validity"])), lambda o: o["value"].isNotNull())
    obs = [_many("emails", F.col("emails"), s, "regex", normalize_email), written, bare, _links(urls, s, "regex"), _many("skills", first_of_each(F.transform("skills", lambda x: x["canonical"])), s, "regex")]
    audit = [_missing(s, *[(f, F.size(c) == 0) for f, c in (("emails", "emails"), ("phones", "phones"), ("links", "urls"), ("skills", "skills"))])]
    return _finish(rows, obs, [], audit)


NORMALIZERS = dict(zip(SOURCES, (normalize_csv, normalize_ats, normalize_github, normalize_notes)))


def unknown_sources(payloads: DataFrame) -> DataFrame:
    """Events for payloads of sources that no adapter reads."""
    rows = payloads.where(~F.col("source").isin(SOURCES) | F.col("source").isNull())
    return rows.select("bundle_id", F.explode(F.array(event("normalize", "record", "source_failed", "unknown_source", source=F.coalesce("source", F.lit("")))))).select("bundle_id", "col.*")
