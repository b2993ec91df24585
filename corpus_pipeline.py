"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Quality filter, line dedup, near dedup, benchmark decontamination, mixing. Every stage works on all rows that its
predecessor kept and handles null and empty texts, repeated rows and empty tables as its operator states; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import dartminhash, decontam, line_dedup, mixing, quality_gam
from flowlens.llm.common import crc_of_id, fresh, table
from flowlens.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score under 0.3) go; the held-out fifth of the labels is not learned from."""
    model = quality_gam.fit_quality(docs, table(spark, sf_dir, "labels"), keep=crc_of_id("_key") % quality_gam.FOLDS != 0)
    score = fresh(docs.columns, "_score")
    scored = docs.withColumn(score, quality_gam.quality_score(model)(F.col("text")))
    return scored.filter(F.col(score) >= quality_gam.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts and no row goes; ``n_chars`` follows the text.

    A text whose words all stand in boilerplate lines stays whole: it is one of many copies, and which of them stays is
    for near dedup to say.
    """
    whole = fresh(docs.columns, "_whole")
    cleaned = line_dedup.drop_boilerplate(docs.withColumn(whole, F.col("text")))
    emptied = (F.col(cleaned.columns[-1]) > 0) & ~F.col("text").rlike(r"\S")
    kept = cleaned.withColumn("text", F.when(emptied, F.col(whole)).otherwise(F.col("text"))).select(*docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id."""
    return dartminhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at their sources' repetition rates, one row per copy, numbered by ``copy``."""
    return mixing.copies_of(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix", mixture)]

#: The learned stages and the signatures have no SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return docs
