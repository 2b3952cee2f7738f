"""A corpus pipeline of five operators, each stage working on all rows that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from booktext.llm import bpe, jaccard, mixing, perplexity, secrets
from booktext.llm.common import WORD, delete, materialize, released, scratch, shared_dir
from booktext.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_mark() -> Column:
    """A hash of the text; a null text is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the perplexity bands keep. A row is known by its id, language and text's hash."""
    rows = docs.select(*COLUMNS).withColumn("_mark", text_mark())
    bad = perplexity.judge(rows.select("doc_id", "text", "lang", "_mark")).filter("not kept")
    bad = bad.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("_mark").alias("_m")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_mark") == F.col("_m"))
    return rows.join(bad, same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the first by id (null last), text's hash and the other columns; rows without words
    stay, each for itself."""
    rows = docs.select(*COLUMNS).withColumn("_mark", text_mark())
    # rows with one id and text share a number, and no other rows do
    rows = rows.withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_mark"))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    some = rows.filter(worded)
    found = jaccard.link(some.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = some.select("_row", "doc_id", "_mark").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark", "_row")).alias("first")
    first = released(materialize(ids.join(found, "_row").groupBy("component_id").agg(first).select("first._row"), "kept-rows"))
    kept = some.join(first, "_row").groupBy("_row").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("x")).select("x.*")
    return kept.select(*COLUMNS).unionByName(rows.filter(~worded).select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret replaced by a mark."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, once for each epoch that takes them."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.filter("epochs > 0").withColumn("_e", F.explode(F.sequence(F.lit(1), "epochs"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    out = bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]
#: SQL can express neither the model of the first stage nor the vocabulary of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a stage has made on its way goes once its
    rows are written, and these once the next stage's are; only the last stage is left to the caller's action."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
