"""Each operator over the test tables, and the SQL it is held against. Computed doubles are rounded to six places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions import formats, recognize, text
from weftline.functions.confidence import base_confidence, conflict_penalty
from weftline.operators.clusters import greedy_clusters
from weftline.operators.components import components
from weftline.operators.evidence import group_values, losing_values, merge_multi, merge_single
from weftline.operators.linkage import candidates, token_edges
from weftline.operators.score import candidate_id, list_mean, overall_confidence
from weftline.operators.skills import canonicalize, exact_link, fuzzy_link, link_prose, ngrams, token_sort_ratio
from weftline.plans.fuse import provenance, single_events
from weftline.plans.normalize import normalize_ats, normalize_github
from weftline.plans.project import compile_path, project
from weftline.scratch import cut
from weftline.settings import SOURCE_TRUST, SOURCES
from weftline.sources.adapters import ats_records, csv_records, github_records


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _observations(spark: SparkSession, d: str, entity: str) -> DataFrame:
    """Line items as observations of an entity: the source by line number, less trusted by discount."""
    k = F.col("l_linenumber") % 4
    source, trust = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, s in enumerate(SOURCES):
        source, trust = F.when(k == i, F.lit(s)).otherwise(source), F.when(k == i, F.lit(SOURCE_TRUST[s])).otherwise(trust)
    li = _t(spark, d, "lineitem").select(entity, "l_returnflag", "l_linenumber", "l_discount")
    return li.select(F.col(entity).alias("entity"), F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), source.alias("source"), F.lit("direct").alias("method"), (trust * (1 - F.col("l_discount"))).alias("confidence"), F.lit(0).alias("ord"))


_OBS = """WITH obs AS (SELECT {e} AS entity, l_returnflag AS value,
  CASE l_linenumber % 4 WHEN 0 THEN 'recruiter_csv' WHEN 1 THEN 'ats_json' WHEN 2 THEN 'github' ELSE 'recruiter_notes' END AS source,
  CASE l_linenumber % 4 WHEN 0 THEN 0.80::DOUBLE WHEN 1 THEN 0.90::DOUBLE WHEN 2 THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END * (1 - l_discount) AS conf FROM lineitem),
grp AS (SELECT entity, value, greatest(0, least(1, 1 - product(1 - conf))) AS conf, count(*) AS n, count(DISTINCT source) AS n_sources,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(conf) AS top FROM obs GROUP BY entity, value),
win AS (SELECT entity, value, source AS winner, conf AS wconf FROM (SELECT *, row_number() OVER (PARTITION BY entity, value ORDER BY conf DESC, source) AS r FROM obs) WHERE r = 1),
g AS (SELECT grp.*, winner, wconf FROM grp JOIN win USING (entity, value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(conf, 9) DESC, winner, value) AS r, count(*) OVER (PARTITION BY entity) AS k, sum(n_sources) OVER (PARTITION BY entity) AS votes FROM g),
single AS (SELECT entity, value, winner AS source, CASE WHEN n_sources > 1 THEN 'merged' ELSE 'direct' END AS method, votes - n_sources AS losing,
  conf * CASE WHEN k > 1 THEN greatest(0.3, 1 - 0.15 * (votes - n_sources)) ELSE 1 END AS confidence, k AS n_groups FROM ranked WHERE r = 1)
"""


_LCS = """WITH RECURSIVE {pairs},
lcs AS (SELECT id, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda k: 0) AS row FROM pairs
  UNION ALL SELECT id, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND x[i + 1] = y[k - 1] THEN row[k - 1] + 1 ELSE row[k] END))) FROM lcs WHERE i < len(x)),
scored AS (SELECT id, CASE WHEN len(x) + len(y) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * row[len(y) + 1] / (len(x) + len(y)) END AS score FROM lcs WHERE i = len(x))
"""


_PEOPLE = """WITH c AS (SELECT c_custkey, CAST(c_custkey // 10 AS VARCHAR) AS bundle_id, replace(c_name, '#', '') AS name, lower(replace(c_name, '#', '')) || '@example.com' AS mail, c_mktsegment[1:1] || lower(c_mktsegment[2:]) AS company FROM customer),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY name) - 1 AS INT) AS rec_ord FROM c),
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY name) - 1 AS INT) AS ats_ord FROM c WHERE c_custkey % 2 = 0)
"""


def _r(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def noisy_or_by_value(spark, d):
    g = group_values(_observations(spark, d, "l_partkey"), ["entity"])
    return g.select("entity", "value", _r("confidence").alias("confidence"), F.array_join("sources", ",").alias("sources"), "n")


def winner_per_value(spark, d):
    g = group_values(_observations(spark, d, "l_orderkey"), ["entity"])
    return g.select("entity", "value", F.col("winner.source").alias("winner"), _r("winner.confidence").alias("winner_confidence"))


def single_value_merge(spark, d):
    m = merge_single(group_values(_observations(spark, d, "l_orderkey"), ["entity"]), ["entity"])
    return m.select("entity", "value", "source", "method", "losing_sources", _r("confidence").alias("confidence"), "n_groups", "kept")


def multi_value_merge(spark, d):
    m = merge_multi(group_values(_observations(spark, d, "l_orderkey"), ["entity"]), ["entity"])
    return m.select("entity", F.array_join(F.transform("items", lambda x: x["value"]), ",").alias("items"), F.size("items").alias("n_items"))


def conflict_penalties(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"))
    return o.select("o_custkey", _r(conflict_penalty(F.col("n"))).alias("penalty"))


def method_trust_confidence(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    method = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "regex").otherwise("inferred")
    source = F.when(F.col("o_orderkey") % 2 == 0, SOURCES[1]).otherwise(SOURCES[3])
    return o.select("o_orderkey", _r(base_confidence(source, method, F.lit(0.8))).alias("confidence"))


def family_score(spark, d):
    """Customers as profiles: orders as positions, their mean confidence by priority; an e-mail for a positive balance."""
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    conf = F.when(F.col("o_orderpriority") == "1-URGENT", 0.9).otherwise(0.7)
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(conf.alias("confidence"))).alias("jobs"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    families = {"emails": F.when(F.col("c_acctbal") > 0, 0.9), "full_name": F.lit(0.8), "experience": list_mean(F.col("jobs"))}
    return j.select("c_custkey", _r(overall_confidence(families)).alias("overall"))


def extract_emails(spark, d):
    x = _t(spark, d, "documents").select("doc_id", recognize.find_emails(F.col("text")).alias("e"))
    return x.select("doc_id", F.array_join("e", ",").alias("emails"), F.size("e").alias("n_emails"))


def extract_urls(spark, d):
    x = _t(spark, d, "pages").select("page_id", recognize.find_urls(F.concat(F.col("html"), F.lit(" "), F.col("url"), F.lit("."))).alias("u"))
    return x.select("page_id", F.array_join("u", " ").alias("urls"), F.size("u").alias("n_urls"))


def extract_phones(spark, d):
    x = _t(spark, d, "documents").select("doc_id", recognize.find_phones(F.col("text")).alias("p"))
    return x.select("doc_id", F.array_join(F.transform("p", lambda y: formats.normalize_phone(y["raw"])["value"]), ",").alias("phones"))


def normalize_emails(spark, d):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("@Mail")).otherwise(F.lit("@Mail.Example")), F.lit(" "))
    x = _t(spark, d, "customer").select("c_custkey", formats.normalize_email(F.regexp_replace(raw, "#", "")).alias("e"))
    return x.select("c_custkey", "e.value", "e.validity")


def normalize_urls(spark, d):
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".,")))
    x = _t(spark, d, "pages").select("page_id", formats.normalize_url(raw).alias("u"))
    return x.select("page_id", "u.value", "u.validity")


def split_location(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    raw = F.concat(F.lit(" City "), F.col("n_nationkey").cast("string"), F.lit(" ,, "), F.col("r_name"), F.lit(", xx"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(", us")).otherwise(F.lit("")))
    x = j.select("n_nationkey", formats.classify_location(raw, {"us": "US"})["value"].alias("v"))
    return x.select("n_nationkey", "v.city", "v.region", "v.country")


def normalize_date_month(spark, d):
    at = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(at, "MM/yyyy")).otherwise(F.date_format(at, "yyyy"))
    x = _t(spark, d, "orders").select("o_orderkey", formats.normalize_date(raw).alias("m"))
    return x.select("o_orderkey", "m.value", "m.validity")


def normalize_years(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" yrs"))).otherwise(F.concat(F.lit(" "), (F.col("p_size") * 2).cast("string")))
    x = _t(spark, d, "part").select("p_partkey", formats.normalize_years(raw).alias("y"))
    return x.select("p_partkey", "y.value", "y.validity")


def company_keys(spark, d):
    raw = F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(", Inc.")).when(F.col("s_suppkey") % 3 == 1, F.lit(" Co Ltd")).otherwise(F.lit("")))
    return _t(spark, d, "supplier").select("s_suppkey", text.company_key(raw).alias("key"))


def clean_strings(spark, d):
    raw = F.concat(F.lit("\t "), F.regexp_replace("p_name", " ", "  \n"), F.lit(" "))
    return _t(spark, d, "part").select("p_partkey", text.clean_string(raw).alias("cleaned"))


def _vocabulary(spark, d):
    """Distinct part names as a taxonomy, types as its canonical names."""
    p = _t(spark, d, "part").select(text.normalize_alias(F.col("p_name")).alias("alias"), "p_type")
    return p.groupBy("alias").agg(F.min("p_type").alias("canonical")).withColumn("surface", F.col("alias"))


def skill_exact_link(spark, d):
    forms = _t(spark, d, "part").select("p_partkey", text.normalize_alias(F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" x")).otherwise(F.lit("")))).alias("alias"))
    return exact_link(forms, _vocabulary(spark, d)).select("p_partkey", "canonical")


def skill_fuzzy_link(spark, d):
    """Names with one letter doubled, linked back; only rows can be held against SQL."""
    forms = _t(spark, d, "part").select(F.concat(F.lit("a"), text.normalize_alias(F.col("p_name"))).alias("alias")).distinct()
    return fuzzy_link(forms, _vocabulary(spark, d)).select("alias", "surface", "score")


def canonical_skills(spark, d):
    return canonicalize(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", _vocabulary(spark, d)).select("p_partkey", "canonical")


def fuzzy_ratio(spark, d):
    """Scores of neighbours in a list of names; tests hold the score against brute force."""
    n = _t(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("a"))
    m = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("a").alias("b"))
    return n.join(m, "n_nationkey").select("n_nationkey", _r(token_sort_ratio(F.col("a"), F.col("b"))).alias("score"))


def ngram_candidates(spark, d):
    x = _t(spark, d, "benchmark").select("item_id", F.explode(ngrams(F.col("text"))).alias("g"))
    return x.select("item_id", F.col("g.start").alias("start"), F.col("g.n").alias("n"), F.col("g.text").alias("gram"))


def prose_skills(spark, d):
    """A note for each part, with its name twice and a name that is cut short; skills in the order of the text."""
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("Worked on "), F.initcap("p_name"), F.lit(", then on (the) "), F.upper("p_name"), F.lit("; never zzzz.")).alias("note"))
    found = link_prose(p, ["p_partkey"], "note", _vocabulary(spark, d))
    return found.select("p_partkey", F.array_join(F.transform("skills", lambda s: F.concat_ws("/", s["canonical"], s["surface"], s["score"].cast("string"), s["method"])), ",").alias("skills"))


def _customer_tokens(spark, d):
    """Tokens that chain customers inside blocks of 16."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    one = c.select("node", F.concat(F.lit("e:"), F.expr("node div 2").cast("string")).alias("token"))
    two = c.select("node", F.concat(F.lit("p:"), F.expr("node div 16").cast("string"), F.lit(":"), F.expr("(node + 1) div 4").cast("string")).alias("token"))
    return one.union(two).withColumn("bundle_id", F.lit("b"))


def identity_tokens(spark, d):
    return _customer_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))


def identity_components(spark, d):
    return components(token_edges(_customer_tokens(spark, d), ["bundle_id"])).select("node", "root")


def unanchored_attach(spark, d):
    """Events as records: bundles of a few, some with tokens, from several sources."""
    e = _t(spark, d, "events").select(F.expr("event_id div 4").cast("string").alias("bundle_id"), F.col("event_id").alias("node"), F.concat(F.lit("s"), ((F.col("event_id") * 7) % 5).cast("string")).alias("source"), "event_type", "user_id")
    tokens = e.where(F.col("event_type").isin("click", "purchase")).select("bundle_id", "node", F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")).alias("token"))
    return candidates(e.select("bundle_id", "node", "source"), tokens).select("bundle_id", "node", "root")


def greedy_cluster(spark, d):
    """Orders of a customer clustered by priority, with status as evidence; a sequential fold, rows only."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderpriority", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.col("o_orderkey").alias("ord"))
    return greedy_clusters(o, ["o_custkey"], "o_orderpriority", ["status"]).select("o_custkey", "o_orderpriority", "ord", "cluster")


def candidate_ids(spark, d):
    mail = F.when(F.col("c_custkey") % 4 > 1, F.concat(F.lower("c_name"), F.lit("@x.org")))
    phone = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("+1"), F.col("c_custkey").cast("string")))
    place = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return _t(spark, d, "customer").select("c_custkey", candidate_id(mail, F.col("c_name"), phone, place).alias("candidate_id"))


def provenance_rows(spark, d):
    """Customers as profiles whose e-mails are their orders' statuses, each with the sources of their priorities."""
    source = F.when(F.col("o_orderpriority") < "3", F.lit(SOURCES[0])).otherwise(F.lit(SOURCES[3]))
    o = _t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_set(source)).alias("sources"))
    lists = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("value"), "sources")).alias("emails"))
    none = F.array().cast("array<struct<value:string,sources:array<string>>>")
    single = lambda s, m: F.struct(F.lit(s).alias("source"), F.lit(m).alias("method"))
    shaped = lists.select("o_custkey", "emails", *[none.alias(n) for n in ("phones", "skills", "experience", "education", "projects")], single(SOURCES[0], "direct").alias("full_name"), *[single("merge", "merged").alias(n) for n in ("location", "links", "headline", "years_experience")])
    return shaped.select("o_custkey", F.posexplode(provenance()).alias("pos", "p")).select("o_custkey", "pos", "p.field", "p.source", "p.method")


def project_paths(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus").alias("o"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    row = lists.select("o_custkey", F.struct("orders").alias("v"))
    kind = row.schema["v"].dataType
    at = lambda p: compile_path(p, F.col("v"), kind)[0]
    return row.select("o_custkey", at("orders[0].o_orderkey").alias("first_order"), F.array_join(at("orders[].o_orderstatus"), ",").alias("statuses"), at("orders[1]").getField("o_orderstatus").alias("second_status"))


def project_missing_null(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")).alias("v"))
    value = compile_path("balance", F.col("v"), c.schema["v"].dataType)[0]
    return c.select("c_custkey", value.isNull().alias("missing"), value.alias("balance"))


def json_field_extract(spark, d):
    v = F.try_parse_json("props")
    return _t(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").isNull().alias("absent"))


def audit_events(spark, d):
    """What the merge of each order's values says: conflicts with the values that lost, agreements, dropped fields."""
    by = ["entity"]
    g = cut(group_values(_observations(spark, d, "l_orderkey"), by), "groups")
    m = merge_single(g, by)
    e = single_events(m, losing_values(g, m, by), by, by, F.col("field"))
    return e.select("entity", "kind", "reason", F.coalesce(F.try_element_at("details", F.lit("losing_values")), F.lit("")).alias("losing"), F.coalesce(F.try_element_at("details", F.lit("winner_value")), F.lit("")).alias("winner"))


def _bundle(key: str = "c_custkey") -> Column:
    return F.expr(f"{key} div 10").cast("string").alias("bundle_id")


def _payloads(spark, d) -> DataFrame:
    """Bundles of ten customers: a CSV of all, ATS JSON of those with even keys, and a note that names one mail address."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    name = F.regexp_replace("c_name", "[^A-Za-z0-9]", "")
    mail = F.concat(F.lower(name), F.lit("@example.com"))
    row = F.concat_ws(",", name, F.lit("Test"), mail, F.concat(F.initcap("c_mktsegment"), F.lit(" Inc")), (F.col("c_custkey") % 40).cast("string"), F.lit("Python;Go"))
    csv = c.groupBy(_bundle()).agg(F.concat(F.lit("first_name,last_name,email,current_company,years_experience,top_skills\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("payload"))
    person = F.struct(name.alias("first_name"), F.lit("Test").alias("last_name"), F.array(F.struct(mail.alias("value"))).alias("email_addresses"), F.array(F.struct(F.initcap("c_mktsegment").alias("company_name"))).alias("employments"))
    ats = c.where("c_custkey % 2 = 0").groupBy(_bundle()).agg(F.to_json(F.array_sort(F.collect_list(person))).alias("payload"))
    note = c.groupBy(_bundle()).agg(F.concat(F.lit("Spoke to "), F.min(mail), F.lit(" about work.")).alias("payload"))
    parts = ((csv, SOURCES[0]), (ats, SOURCES[1]), (note, SOURCES[3]))
    out = None
    for p, s in parts:
        p = p.select("bundle_id", F.lit(s).alias("source"), "payload")
        out = p if out is None else out.union(p)
    return out


def csv_rows(spark, d):
    r = csv_records(_payloads(spark, d)).where("rec_ord IS NOT NULL")
    get = lambda n: F.try_element_at("raw", F.lit(n)).alias(n)
    return r.select("bundle_id", "rec_ord", get("first_name"), get("email"), get("top_skills"), get("headline").isNull().alias("no_headline"))


def ats_observations(spark, d):
    r = normalize_ats(ats_records(_payloads(spark, d)))
    o = r.select("bundle_id", "rec_ord", F.explode("obs").alias("o")).select("bundle_id", "rec_ord", "o.field", "o.value", "o.confidence")
    e = r.select("bundle_id", "rec_ord", F.explode("entries").alias("e")).select("bundle_id", "rec_ord", F.col("e.family").alias("field"), F.try_element_at("e.parts", F.lit("company")).alias("value"), "e.confidence")
    return o.union(e).withColumn("confidence", _r("confidence"))


def ats_missing(spark, d):
    """Events of fields that ATS records lack."""
    r = normalize_ats(ats_records(_payloads(spark, d))).select("bundle_id", "rec_ord", F.explode("audit").alias("a"))
    return r.select("bundle_id", "rec_ord", F.col("a.field").alias("field"), F.col("a.kind").alias("kind"), F.col("a.reason").alias("reason"))


def _github(spark, d) -> DataFrame:
    """Customers as profiles, their orders as repositories, finished orders as forks."""
    repo = F.struct(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderstatus") == "F").alias("fork"), F.substring("o_orderpriority", 3, 20).alias("language"))
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(repo)).alias("repos"))
    c = _t(spark, d, "customer").select("c_custkey", F.struct(F.regexp_replace("c_name", "#", " ").alias("name"), F.concat(F.lit("https://GitHub.com/"), F.col("c_custkey").cast("string")).alias("html_url")).alias("profile"))
    j = c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_custkey").cast("string").alias("bundle_id"), F.lit(SOURCES[2]).alias("source"), F.to_json(F.struct("profile", "repos")).alias("payload"))
    return normalize_github(github_records(j))


def github_projects(spark, d):
    """(bundle, project) of repositories that are no forks, and how many forks were left out."""
    r = _github(spark, d)
    forks = F.size(F.filter("audit", lambda a: a["reason"] == "fork_repo_excluded"))
    p = r.select("bundle_id", forks.alias("forks"), F.explode("entries").alias("e"))
    return p.select("bundle_id", "forks", F.try_element_at("e.parts", F.lit("name")).alias("project"), F.try_element_at("e.parts", F.lit("primary_language")).alias("language"), _r("e.confidence").alias("confidence"))


def github_observations(spark, d):
    """Names, links and inferred skills of profiles."""
    o = _github(spark, d).select("bundle_id", F.explode("obs").alias("o")).select("bundle_id", "o.field", "o.value", "o.method", "o.confidence")
    return o.withColumn("confidence", _r("confidence"))


def flagship(spark, d):
    """Fused value of every order, its candidate name and overall confidence."""
    m = merge_single(group_values(_observations(spark, d, "l_orderkey"), ["entity"]), ["entity"]).where("kept")
    score = overall_confidence({"full_name": F.col("confidence"), "emails": F.when(F.col("method") == "merged", F.col("confidence"))})
    name = F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", F.col("entity").cast("string"), "value"), 256), 1, 8))
    return m.select("entity", "value", name.alias("candidate_id"), _r(score).alias("overall"))


def payload_profiles(spark, d):
    """All customers through the whole engine, from payloads of three sources to projected profiles."""
    from weftline.pipeline import run

    out = run(cut(_payloads(spark, d), "payloads"))
    get = lambda p: F.get_json_object("output", p)
    return out.select("bundle_id", "root", get("$.candidate_id").alias("candidate_id"), get("$.full_name").alias("full_name"), get("$.emails[0]").alias("email"), get("$.experience[0].company").alias("company"), _r(get("$.overall_confidence").cast("double")).alias("overall"))


def projected_policies(spark, d):
    """Orders as profiles: a missing value as null, left out, or an error that puts the row aside."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    kind = "struct<value:{0},source:string,method:string,confidence:double>"
    single = lambda v, t="string": F.struct(v.cast(t).alias("value"), F.lit("x").alias("source"), F.lit("direct").alias("method"), F.lit(0.5).alias("confidence")).cast(kind.format(t))
    none = F.array().cast("array<struct<value:string,confidence:double,sources:array<string>>>")
    mails = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("value"), F.lit(0.75).alias("confidence"), F.array(F.lit("x")).alias("sources")))).otherwise(none)
    p = o.select(
        F.col("o_orderkey").cast("string").alias("bundle_id"),
        F.lit("r").alias("root"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("candidate_id"),
        single(F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("full_name"),
        mails.alias("emails"),
        none.alias("phones"),
        *[single(F.lit(None)).alias(n) for n in ("location", "links")],
        single(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("hot"))).alias("headline"),
        single(F.lit(None), "double").alias("years_experience"),
        *[none.alias(n) for n in ("skills", "experience", "education", "projects")],
        F.lit(0.5).alias("overall_confidence"),
        F.array().cast("array<string>").alias("provenance"),
    )
    config = {"fields": [{"name": "id", "path": "candidate_id", "type": "string", "on_missing": "error"}, {"path": "mail", "from": "emails[0]", "type": "string", "on_missing": "omit"}, {"name": "line", "path": "headline", "type": "string", "nullable": True}, {"path": "who", "from": "full_name", "type": "string", "required": True}, {"name": "mails", "path": "emails", "type": "array"}], "include_confidence": True}
    return project(p, config, "quarantine").select("bundle_id", "output", F.size("errors").alias("n_errors"))


SQL = {
    "noisy_or_by_value": _OBS.format(e="l_partkey") + "SELECT entity, value, round(conf + 1e-9, 6) AS confidence, sources, n FROM grp",
    "winner_per_value": _OBS.format(e="l_orderkey") + "SELECT entity, value, winner, round(wconf + 1e-9, 6) AS winner_confidence FROM win",
    "single_value_merge": _OBS.format(e="l_orderkey") + "SELECT entity, value, source, method, CAST(losing AS BIGINT) AS losing_sources, round(confidence + 1e-9, 6) AS confidence, n_groups, round(confidence, 12) >= 0.7 AS kept FROM single",
    "multi_value_merge": _OBS.format(e="l_orderkey") + "SELECT entity, string_agg(value, ',' ORDER BY r) AS items, count(*) AS n_items FROM ranked GROUP BY entity",
    "conflict_penalties": "SELECT o_custkey, round(greatest(0.3, 1 - 0.15 * count(DISTINCT o_orderpriority))::DOUBLE + 1e-9, 6) AS penalty FROM orders GROUP BY o_custkey",
    "method_trust_confidence": "SELECT o_orderkey, round((CASE WHEN o_orderkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END) * (CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) * 0.8::DOUBLE + 1e-9, 6) AS confidence FROM orders",
    "family_score": """WITH o AS (SELECT o_custkey, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) AS jobs FROM orders GROUP BY o_custkey),
f AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 0.9::DOUBLE END AS mail, jobs FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, round((0.18::DOUBLE * 0.8 + coalesce(0.22::DOUBLE * mail, 0) + coalesce(0.12::DOUBLE * jobs, 0)) / (0.18::DOUBLE + CASE WHEN mail IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN jobs IS NULL THEN 0 ELSE 0.12::DOUBLE END) + 1e-9, 6) AS overall FROM f""",
    "extract_emails": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS l FROM documents),
u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM e)
SELECT doc_id, coalesce(array_to_string(d, ','), '') AS emails, len(d) AS n_emails FROM u""",
    "extract_urls": r"""WITH u AS (SELECT page_id, list_transform(regexp_extract_all(html || ' ' || url || '.', '(?i)\bhttps?://[^\s,<>"'')]+'), lambda x: rtrim(x, '.,;:!?')) AS l FROM pages),
v AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM u)
SELECT page_id, array_to_string(d, ' ') AS urls, len(d) AS n_urls FROM v""",
    "normalize_emails": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lower(trim(replace(c_name, '#', ''))) || '@mail.example' END AS value, CASE WHEN c_custkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS validity FROM customer",
    "normalize_urls": r"""WITH u AS (SELECT page_id, rtrim(CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') || '.,' END, '.,;:!?)"''') AS t FROM pages),
v AS (SELECT page_id, contains(t, '://') AS s, CASE WHEN contains(t, '://') THEN t ELSE 'https://' || t END AS t FROM u)
SELECT page_id, lower(regexp_extract(t, '^([^:/?#]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(t, '^([^:/?#]+)://([^/?#]*)', 2)) || regexp_extract(t, '^([^:/?#]+)://([^/?#]*)(.*)$', 3) AS value, CASE WHEN s THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS validity FROM v""",
    "split_location": "SELECT n_nationkey, 'City ' || n_nationkey AS city, r_name || ', xx' AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'US' END AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "normalize_date_month": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS value, CASE WHEN o_orderkey % 3 < 2 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS validity FROM orders",
    "normalize_years": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_size * 2 <= 70 THEN (p_size * 2)::DOUBLE END AS value, CASE WHEN p_partkey % 5 <> 0 AND p_size * 2 <= 70 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS validity FROM part",
    "company_keys": r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM supplier",
    "clean_strings": r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS cleaned FROM part",
    "skill_exact_link": r"""WITH v AS (SELECT lower(p_name) AS alias, min(p_type) AS canonical FROM part GROUP BY 1),
f AS (SELECT p_partkey, lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE '' END AS alias FROM part)
SELECT p_partkey, canonical FROM f LEFT JOIN v USING (alias)""",
    "canonical_skills": "WITH v AS (SELECT lower(p_name) AS alias, min(p_type) AS canonical FROM part GROUP BY 1) SELECT p_partkey, canonical FROM part JOIN v ON lower(p_name) = alias",
    "ngram_candidates": r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '\.?[A-Za-z0-9][A-Za-z0-9.+#-]*') AS w, string_split_regex(text, '\.?[A-Za-z0-9][A-Za-z0-9.+#-]*') AS gaps FROM benchmark),
s AS (SELECT item_id, w, gaps, unnest(range(1, len(w) + 1)) AS start FROM t), g AS (SELECT item_id, w, gaps, start, unnest(range(1, least(3, len(w) - start + 1) + 1)) AS n FROM s)
SELECT item_id, start, n, rtrim(w[start] || CASE WHEN n > 1 THEN gaps[start + 1] || w[start + 1] ELSE '' END || CASE WHEN n > 2 THEN gaps[start + 2] || w[start + 2] ELSE '' END, '.,;:!?') AS gram FROM g""",
    "identity_tokens": """WITH t AS (SELECT c_custkey AS node, 'e:' || (c_custkey // 2) AS token FROM customer UNION ALL SELECT c_custkey, 'p:' || (c_custkey // 16) || ':' || ((c_custkey + 1) // 4) FROM customer)
SELECT token, count(*) AS n, min(node) AS first FROM t GROUP BY token""",
    "identity_components": """WITH RECURSIVE t AS (SELECT c_custkey AS node, 'e:' || (c_custkey // 2) AS token FROM customer UNION ALL SELECT c_custkey, 'p:' || (c_custkey // 16) || ':' || ((c_custkey + 1) // 4) FROM customer),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM t a JOIN t b USING (token) WHERE a.node <> b.node),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS root FROM r GROUP BY node""",
    "unanchored_attach": """WITH e AS (SELECT CAST(event_id // 4 AS VARCHAR) AS bundle_id, event_id AS node, (event_id * 7) % 5 AS source, event_type IN ('click', 'purchase') AS anchored, user_id % 2 AS token FROM events),
k AS (SELECT *, CASE WHEN anchored THEN min(node) FILTER (WHERE anchored) OVER (PARTITION BY bundle_id, token) END AS own FROM e),
c AS (SELECT bundle_id, count(DISTINCT own) AS roots, min(own) AS root FROM k GROUP BY bundle_id),
m AS (SELECT bundle_id, max(n) AS most FROM (SELECT bundle_id, source, count(*) AS n FROM e GROUP BY ALL) GROUP BY bundle_id),
p AS (SELECT k.bundle_id, node, CASE WHEN anchored THEN own WHEN roots = 1 THEN root WHEN roots = 0 AND most = 1 THEN -1 ELSE node END AS r FROM k JOIN c USING (bundle_id) JOIN m USING (bundle_id))
SELECT bundle_id, node, min(node) OVER (PARTITION BY bundle_id, r) AS root FROM p""",
    "candidate_ids": "SELECT c_custkey, 'cand_' || sha256(CASE WHEN c_custkey % 4 > 1 THEN lower(c_name) || '@x.org' WHEN c_custkey % 4 = 1 THEN c_name || '|+1' || c_custkey WHEN c_custkey % 3 = 0 THEN c_name || '|' || c_mktsegment ELSE c_name END)[1:8] AS candidate_id FROM customer",
    "provenance_rows": """WITH p AS (SELECT DISTINCT o_custkey, 'emails' AS field, o_orderstatus AS value, CASE WHEN o_orderpriority < '3' THEN 'recruiter_csv' ELSE 'recruiter_notes' END AS source, 'merged' AS method FROM orders
UNION ALL SELECT DISTINCT o_custkey, f, '', CASE WHEN f = 'full_name' THEN 'recruiter_csv' ELSE 'merge' END, CASE WHEN f = 'full_name' THEN 'direct' ELSE 'merged' END FROM orders, (SELECT unnest(['full_name', 'location', 'links', 'headline', 'years_experience']) AS f))
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY field, source, method) - 1 AS INT) AS pos, field, source, method FROM p""",
    "project_paths": """WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey, o_orderstatus) AS k, list(o_orderstatus ORDER BY o_orderkey, o_orderstatus) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, k[1] AS first_order, array_to_string(s, ',') AS statuses, s[2] AS second_status FROM l""",
    "project_missing_null": "SELECT c_custkey, NOT (c_acctbal > 0) AS missing, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer",
    "json_field_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS absent FROM events",
    "flagship": _OBS.format(e="l_orderkey") + "SELECT entity, value, 'cand_' || sha256(entity || '|' || value)[1:8] AS candidate_id, round(CASE WHEN method = 'merged' THEN (0.18::DOUBLE * confidence + 0.22::DOUBLE * confidence) / (0.18::DOUBLE + 0.22::DOUBLE) ELSE 0.18::DOUBLE * confidence / 0.18::DOUBLE END + 1e-9, 6) AS overall FROM single WHERE round(confidence, 12) >= 0.7",
    "extract_phones": r"""WITH p AS (SELECT doc_id, list_distinct_in_order AS w FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '\+\d[\d\s().-]{7,16}\d'), lambda x: trim(x)) AS l FROM documents))),
n AS (SELECT doc_id, list_transform(w, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS d FROM p)
SELECT doc_id, array_to_string(list_transform(list_filter(d, lambda x: regexp_full_match(x, '1[2-9][0-9]{2}[2-9][0-9]{6}')), lambda x: '+' || x), ',') AS phones FROM n""",
    "fuzzy_ratio": _LCS.replace("{pairs}", """w AS (SELECT n_nationkey, array_to_string(list_sort(string_split(lower(n_name), ' ')), ' ') AS t FROM nation),
pairs AS (SELECT a.n_nationkey AS id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.n_nationkey + 1 = a.n_nationkey)""") + "SELECT id AS n_nationkey, round(score + 1e-9, 6) AS score FROM scored",
    "skill_fuzzy_link": _LCS.replace("{pairs}", """known AS (SELECT DISTINCT lower(p_name) AS surface FROM part), forms AS (SELECT 'a' || surface AS alias FROM known),
pairs AS (SELECT f.alias || '>' || k.surface AS id, array_to_string(list_sort(string_split(f.alias, ' ')), ' ') AS x, array_to_string(list_sort(string_split(k.surface, ' ')), ' ') AS y FROM forms f, known k)""") + """, best AS (SELECT string_split(id, '>')[1] AS alias, string_split(id, '>')[2] AS surface, score FROM scored WHERE score >= 94)
SELECT alias, surface, CAST(round(score) AS INT) AS score FROM best QUALIFY row_number() OVER (PARTITION BY alias ORDER BY best.score DESC, surface) = 1""",
    "greedy_cluster": """WITH o AS (SELECT o_custkey, o_orderpriority, nullif(o_orderstatus, 'P') AS status, o_orderkey AS ord FROM orders),
f AS (SELECT *, min(ord) OVER (PARTITION BY o_custkey, o_orderpriority) AS first, min(ord) OVER (PARTITION BY o_custkey, o_orderpriority, status) AS own FROM o),
g AS (SELECT f.*, h.status AS lead FROM f JOIN o h ON f.first = h.ord)
SELECT o_custkey, o_orderpriority, ord, CASE WHEN lead IS NULL OR status IS NULL THEN first ELSE own END AS cluster FROM g""",
    "prose_skills": """WITH v AS (SELECT lower(p_name) AS alias, min(p_type) AS canonical FROM part GROUP BY 1)
SELECT p_partkey, canonical || '/' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '/100/exact' AS skills FROM part JOIN v ON lower(p_name) = alias""",
    "audit_events": _OBS.format(e="l_orderkey") + """, lost AS (SELECT s.entity, '[' || string_agg('"' || g.value || '"', ',' ORDER BY g.value) || ']' AS losing FROM single s JOIN grp g ON s.entity = g.entity AND s.value <> g.value GROUP BY s.entity)
SELECT entity, 'conflict_resolved' AS kind, 'highest_confidence_group_won' AS reason, lost.losing, value AS winner FROM single JOIN lost USING (entity) WHERE n_groups > 1
UNION ALL SELECT entity, 'agreement_merged', 'multiple_sources_agreed', '', '' FROM single WHERE n_groups = 1 AND method = 'merged'
UNION ALL SELECT entity, 'field_dropped', 'winner_below_threshold', '', value FROM single WHERE round(confidence, 12) < 0.7""",
    "csv_rows": _PEOPLE + "SELECT bundle_id, rec_ord, name AS first_name, mail AS email, 'Python;Go' AS top_skills, true AS no_headline FROM r",
    "ats_observations": _PEOPLE + """SELECT bundle_id, ats_ord AS rec_ord, 'full_name' AS field, name || ' Test' AS value, round(0.9 + 1e-9, 6)::DOUBLE AS confidence FROM a
UNION ALL SELECT bundle_id, ats_ord, 'emails', mail, 0.9 FROM a UNION ALL SELECT bundle_id, ats_ord, 'experience', company, 0.9 FROM a""",
    "ats_missing": _PEOPLE + "SELECT bundle_id, ats_ord AS rec_ord, unnest(['phones', 'location', 'links', 'education', 'skills']) AS field, 'field_missing' AS kind, 'source_field_absent' AS reason FROM a",
    "github_projects": """WITH f AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS forks FROM orders GROUP BY o_custkey)
SELECT CAST(o.o_custkey AS VARCHAR) AS bundle_id, CAST(forks AS INT) AS forks, 'order-' || o_orderkey AS project, o_orderpriority[3:] AS language, 0.7::DOUBLE AS confidence FROM orders o JOIN f ON o.o_custkey = f.o_custkey JOIN customer ON c_custkey = o.o_custkey WHERE o_orderstatus <> 'F'""",
    "github_observations": """WITH k AS (SELECT DISTINCT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS bundle_id, 'full_name' AS field, replace(c_name, '#', ' ') AS value, 'direct' AS method, 0.7::DOUBLE AS confidence FROM k JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'links.github', 'https://github.com/' || o_custkey, 'direct', 0.7 FROM k
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'skills', o_orderpriority[3:], 'inferred', 0.35 FROM orders JOIN k USING (o_custkey) WHERE o_orderstatus <> 'F'""",
    "payload_profiles": _PEOPLE + """, n AS (SELECT bundle_id, min(mail) AS noted FROM c GROUP BY bundle_id),
x AS (SELECT r.*, CASE WHEN c_custkey % 2 = 0 THEN 0.98::DOUBLE ELSE 0.8::DOUBLE END AS conf, CASE WHEN c_custkey % 2 = 0 THEN 0.02::DOUBLE ELSE 0.2::DOUBLE END * CASE WHEN mail = noted THEN 1 - 0.55::DOUBLE * 0.7 ELSE 1 END AS doubt FROM r JOIN n USING (bundle_id))
SELECT bundle_id, bundle_id || '|0|' || lpad(CAST(rec_ord AS VARCHAR), 10, '0') AS root, 'cand_' || sha256(mail)[1:8] AS candidate_id, name || ' Test' AS full_name, mail AS email,
  CASE WHEN c_custkey % 2 = 0 THEN company ELSE company || ' Inc' END AS company,
  round((0.18::DOUBLE * conf + 0.22::DOUBLE * (1 - doubt) + 0.02::DOUBLE * 0.8 + 0.10::DOUBLE * 0.8 + 0.12::DOUBLE * conf) / 0.64::DOUBLE + 1e-9, 6) AS overall FROM x""",
    "projected_policies": """WITH o AS (SELECT *, o_orderkey % 2 = 0 AS mailed, o_orderstatus = 'P' AS bad, o_orderpriority = '1-URGENT' AS hot FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS bundle_id, CASE WHEN NOT bad THEN '{"confidence":{"id":1.0,"line":' || CASE WHEN hot THEN '0.5' ELSE 'null' END || CASE WHEN mailed THEN ',"mail":0.75,"mails":[0.75]' ELSE ',"mails":[]' END || ',"who":0.5},"id":"c' || o_orderkey || '","line":' || CASE WHEN hot THEN '"hot"' ELSE 'null' END
  || CASE WHEN mailed THEN ',"mail":"o' || o_orderkey || '","mails":["o' || o_orderkey || '"]' ELSE ',"mails":[]' END || ',"who":"' || o_orderstatus || '"}' END AS output, CASE WHEN bad THEN 1 ELSE 0 END AS n_errors FROM o""",
}


def queries() -> dict:
    skip = {"queries", "flagship"}
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip}
    return {**own, "flagship": flagship}
