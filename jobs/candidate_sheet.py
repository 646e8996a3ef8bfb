"""Candidate motifs of the ends of each source's sequences: enrichment, specificity, spacing, and the best of each source.

    python -m jobs.candidate_sheet --documents /data/documents.parquet --output /data/candidate_sheet

A run reads all documents, writes the enriched anchored k-mers by source, and from them the sheet of candidates by source.
It overwrites what an earlier run wrote, so running it again gives the same files' rows."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from seqloom.functions import sequence as S
from seqloom.operators import discovery, hits, kmers

log = logging.getLogger("candidate_sheet")

KMERS = "end string, kmer string, terminal_count long, fold_enrichment double, anchored boolean, grp string"
SHEET = "end string, candidate_motif string, spacer int, fold_enrichment double, terminal_count long, chrom_specificity double, specific_to string, genomic_hits long, median_spacing_bp long, low_complexity boolean, tandem boolean, score double, best boolean, grp string"
#: Weight of a candidate whose copies don't stand in tandem.
SCATTERED = 0.4


def spacing(seqs: DataFrame, tops: DataFrame, k: int, terminal: int) -> DataFrame:
    """(grp, end, kmer, genomic_hits, median_spacing_bp): hits of each end's candidate in the same ends of its source's
    sequences, and the median gap within a sequence; null for fewer than two gaps."""
    cand = tops.select("grp", "end", S.canonical_kmer(F.col("seed")).alias("kmer"))
    found = discovery.end_hits(seqs, cand.select("grp", "kmer").distinct(), k, terminal).join(cand, ["grp", "end", "kmer"], "left_semi")
    g = hits.gaps(found, ["grp", "end", "kmer", "seq_id"], "pos").groupBy("grp", "end", "kmer")
    each = g.agg(F.count(F.lit(1)).alias("genomic_hits"), F.count("gap").alias("gaps"), F.floor(F.median("gap")).alias("middle"))
    return each.select("grp", "end", "kmer", "genomic_hits", F.when(F.col("gaps") >= 2, F.col("middle")).alias("median_spacing_bp"))


def sheet(seqs: DataFrame, enriched: DataFrame, k: int, terminal: int) -> DataFrame:
    """A row a source and end: its most enriched framed k-mer, with what makes it credible; the best of each source by
    enrichment x specificity, at less without tandem copies, low complexity left out; ties to the left end."""
    tops = discovery.top_candidates(enriched)
    framed = enriched.where("anchored").withColumn("seed", S.orient(F.col("kmer"))).where("seed is not null").where(S.framework_spacer(F.col("seed")).isNotNull())
    share = hits.group_share(framed.select("seed", F.col("grp").alias("specific_to"), "terminal_count"), "seed", "specific_to", "terminal_count")
    j = tops.join(share, "seed").withColumn("kmer", S.canonical_kmer(F.col("seed"))).join(spacing(seqs, tops, k, terminal), ["grp", "end", "kmer"], "left")
    j = j.withColumn("chrom_specificity", F.round("share", 2)).withColumn("low_complexity", S.low_complexity(F.col("seed"))).withColumn("tandem", S.tandem(F.col("median_spacing_bp")))
    score = F.round(F.col("fold_enrichment") * F.col("chrom_specificity") * F.when(F.col("tandem"), 1.0).otherwise(SCATTERED), 6)
    j = j.withColumn("score", F.when(~F.col("low_complexity"), score))
    best = j.where("score is not null").groupBy("grp").agg(F.min_by("end", F.struct(-F.col("score"), "end")).alias("best_end"))
    j = j.join(best, "grp", "left").withColumn("best", F.coalesce(F.col("end") == F.col("best_end"), F.lit(False)))
    return j.select("grp", "end", F.col("seed").alias("candidate_motif"), "spacer", F.round("fold_enrichment", 6).alias("fold_enrichment"), "terminal_count", "chrom_specificity", "specific_to", F.coalesce("genomic_hits", F.lit(0)).alias("genomic_hits"), "median_spacing_bp", "low_complexity", "tandem", "score", "best")


def run(spark: SparkSession, documents: str, output: str, k: int = 12, terminal: int = 2_000_000, min_count: int = 10, min_length: int = 1_000_000) -> DataFrame:
    """Writes k-mers and sheet below ``output`` and returns the sheet read back.

    Documents without an id, a source, or long enough a text take no part. No documents give an empty sheet."""
    kmers_at, sheet_at = common.folder(output, "kmers"), common.folder(output, "sheet")
    rows = spark.read.schema(common.DOCUMENTS).parquet(documents)
    seqs = common.sequences(rows).where("grp is not null")
    log.info("reading %s", documents)
    # Ties are ties whatever the order of sums.
    enriched = kmers.terminal_enrichment(seqs, k, terminal, min_count, min_length).withColumn("fold_enrichment", F.round("fold_enrichment", 9))
    enriched.where("anchored").write.mode("overwrite").partitionBy("grp").parquet(kmers_at)
    enriched = spark.read.schema(KMERS).parquet(kmers_at)
    log.info("wrote %d anchored k-mers to %s", enriched.count(), kmers_at)
    sheet(seqs.where(F.length("seq") >= min_length), enriched, k, terminal).write.mode("overwrite").partitionBy("grp").parquet(sheet_at)
    out = spark.read.schema(SHEET).parquet(sheet_at)
    log.info("wrote %d candidates to %s", out.count(), sheet_at)
    return out


if __name__ == "__main__":
    common.main(__doc__.splitlines()[0], run, str(Path(__file__).with_suffix(".json")))
