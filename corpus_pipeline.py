"""A corpus pipeline of five stages over ``documents``, each by one operator of :mod:`seqloom.llm`.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the next. All
but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import exact, mixing, near, packing, quality
from seqloom.llm.common import ROW, apart, materialize, numbered, table

#: SQL cannot express the classifier, the sketches or the packing.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote for. Each row is judged by its text alone, whatever its id; null
    texts count as empty. Without labels every document stays."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    return quality.classify(docs, model, carry=[row]).where("predicted = 1").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), one row with the largest id; a null id is below all others."""
    rows = numbered(docs)
    kept = exact.exact_dedup(rows, row_col=ROW).where("kept").groupBy("text_sha256").agg(F.min(ROW).alias(ROW))
    return rows.join(apart(kept.select(ROW)), ROW, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, one row with its smallest id. Rows without words stay."""
    rows = numbered(docs)
    found = near.near_dedup(rows, row_col=ROW).where("kept").groupBy("_group").agg(F.min(ROW).alias(ROW))
    return rows.join(apart(found.select(ROW)), ROW, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of training: a row for each copy it takes; the last copy of a source may be cut. Rows without
    words take no part. Null ids and ids that repeat are rows of their own."""
    rows = numbered(docs)
    plan = materialize(mixing.mix(rows, row_col=ROW), "mix")
    return mixing.training_order(rows, plan, ROW).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, a copy at a time, in sequences of 1024 tokens; a null text is its end mark alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("near-duplicates", drop_near_copies), ("source mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
