"""The ten queries over the test tables, with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on this machine; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import against_edits

    return against_edits(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels), threshold=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's exact histogram of byte-level BPE lengths with the answers for each length as a limit."""
    from .token_counts import answers, histogram, lengths

    counts = lengths(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep=["lang"])
    return answers(histogram(counts, ["lang"]), ["lang"])


def queries() -> dict:
    return {n: f for n, f in sorted(globals().items()) if n.startswith("op") and n[2].isdigit()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontaminate": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, w[i : i + n - 1] AS win FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, n, i, w[i : i + n - 1] AS win FROM places) p JOIN windows x ON p.n = x.n AND p.win = x.win),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(ls, pos) AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT y.doc_id, y.pos, y.line, (s.k IS NOT NULL AND y.doc_id <> s.first) AS gone FROM keyed y LEFT JOIN shared s ON y.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
