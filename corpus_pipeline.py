"""A corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of ``docs``. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblar.llm import secret_scan, simhash, toxicity
from ensemblar.llm.common import cut, id_bucket, shared_path, small_batches, table
from ensemblar.llm.packing import pack_documents

#: A table of removed ids of this many bytes at most is broadcast.
SMALL = 8 << 20

#: No SQL: stages are a trained model, a hash that DuckDB lacks and a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at one half or more go. Null and empty texts stay."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(id_bucket(F.col("doc_id"), 5) != 0))
    toxic = toxicity.score(F.col("text"), model) >= 0.5
    return docs.where(~toxic | F.coalesce(F.length("text") == 0, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, that with the smallest id; see simhash.near_copies for what links.

    Rows are told apart by id and text, so that an id with two texts loses only the one that is a copy. Rows that
    repeat an id and its text count as one document. Rows without an id are compared as all others and
    go where a copy has an id; of copies without one a single row stays.
    Only the keys of the rows that go are joined.
    """
    small_batches(spark)
    digest = F.coalesce(F.md5(docs["text"]), F.lit(""))
    found = cut(simhash.near_copies(docs.select("doc_id", "text", digest.alias("digest")), keep=["digest"]).select("doc_id", "digest", "stays"))
    gone = cut(found.where("not stays").select("doc_id", "digest").distinct())
    small = gone.count() * 100 <= SMALL
    both = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"]) & (digest == other["digest"])
    kept = docs.join(F.broadcast(gone) if small else gone, both(gone), "left_anti")
    twice = cut(found.where("stays").groupBy("doc_id", "digest").count().where("count > 1"))
    if twice.isEmpty():
        return kept
    return kept.join(twice, both(twice), "left_anti").union(kept.join(twice, both(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the text gives way to a mark; n_chars follows the text."""
    small_batches(spark)
    spans = secret_scan.secrets_in(F.col("text"))["spans"]
    clean = docs.withColumn("text", secret_scan.redact(F.col("text"), spans))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of the documents in sequences of 2048 tokens."""
    small_batches(spark)
    return pack_documents(docs, capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", redact_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
