"""Corpus pipeline: toxicity, line dedup, near-duplicate removal, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text where a stage changes it.

Rows with a null key or text, empty texts and repeated rows stay, as far as the operators' docstrings don't say
otherwise: a repeated row of which another document has the text goes with it. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.scratch import cut

#: Bytes of an Arrow batch: a Python worker goes through all stages and keeps what each has left in it, so little may be.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model is learned from labelled rows of docs."""
    from weftline.llm.common import bound_batches
    from weftline.llm.toxicity import learn, score

    bound_batches(spark, BATCH_BYTES)
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, threshold=0.3, keep=True).where("predicted = 0").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; so do documents of which nothing but blanks is left by that."""
    from weftline.llm.line_dedup import dedup_lines

    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = dedup_lines(docs, keep=rest + ["n_chars"])
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more connect, the one with the least doc_id stays."""
    from weftline.llm.common import bound_batches
    from weftline.llm.jaccard_join import keep_one

    bound_batches(spark, BATCH_BYTES)
    return keep_one(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in any 10-word window of a benchmark item are cut out of the texts."""
    from weftline.llm.common import bound_batches
    from weftline.llm.decontaminate import remove

    bound_batches(spark, BATCH_BYTES)
    return remove(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, with digests of the ids and of the decoded text."""
    from weftline.llm.common import bound_batches
    from weftline.llm.queries import tokenizer
    from weftline.llm.sentencepiece_codec import encode_decode

    bound_batches(spark, BATCH_BYTES)
    return encode_decode(docs, tokenizer("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("sentencepiece", to_pieces),
]

#: Learned scores, exact near-duplicate components and subword ids are beyond SQL; tests hold the stages against brute
#: force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
