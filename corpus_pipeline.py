"""The corpus pipeline: five stages from documents to shards, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.llm.decontaminate import contaminated
from pluvio.llm.language_id import UNKNOWN, fit_language_model, label_language
from pluvio.llm.mixing import mix_sources
from pluvio.llm.near_dedup import near_dedup
from pluvio.llm.runtime import shared_folder, table
from pluvio.llm.sharding import assign_shards

#: SQL cannot express the language model, so that the stages are tested against brute force instead.
ORACLE_SQL = None

#: A text whose best language has less than so many times an even share of the probability is in no language that was learned.
LEAST_OVER_EVEN = 1.2

#: Sets of five-word shingles are near-duplicates from this similarity on.
NEAR_PERCENT = 80

#: Sources are sharpened or flattened to this part of the greatest entropy, by at most so many repeats of a source and this exponent.
ENTROPY, MOST_REPEATS, GREATEST = 0.99, 4.0, 8.0

#: Bytes of a shard at most, and shards at least where the table is small.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach; texts without letters go."""
    model = fit_language_model(docs)
    least = LEAST_OVER_EVEN / max(2, len(model.langs))
    return label_language(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows of one id go together, rows without id stay."""
    kept = near_dedup(docs, NEAR_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it enters the mix, as repeated rows; rows of one id enter as the first of them does."""
    copies = mix_sources(docs, entropy=ENTROPY, most_repeats=MOST_REPEATS, greatest=GREATEST).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    copies = copies.where("copies > 0").withColumnRenamed("doc_id", "of")
    mixed = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("of")))
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with the shard that each belongs to."""
    return assign_shards(docs, SHARD_BYTES, least_shards=LEAST_SHARDS)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. What a stage keeps is written to the shared folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
