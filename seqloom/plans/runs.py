"""Runs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers


def explore(seqs: DataFrame, patterns: DataFrame, k: int = 12, terminal: int = 2_000_000, min_count: int = 10, min_length: int = 1_000_000) -> DataFrame:
    """(grp, sequences, letters, hits, top_kmer) of sequences (seq_id, grp, seq) of min_length at least: how many there are,
    the exact hits of all patterns, and the k-mer that is most enriched at an end, null where none is frequent. The null
    group has neither hits nor a k-mer. Sequences are read once for sizes and hits and once for the k-mers."""
    each = kmers.hit_numbers(seqs, patterns, min_length)
    sizes = each.groupBy("grp").agg(F.count(F.lit(1)).alias("sequences"), F.sum("letters").alias("letters"), F.sum(F.when(F.col("grp").isNotNull(), F.col("hits")).otherwise(0)).alias("hits"))
    enriched = kmers.terminal_enrichment(seqs, k, terminal, min_count, min_length).withColumn("fold", F.round("fold_enrichment", 9))
    top = kmers.top_per_group(enriched, ["grp"], [F.desc("fold"), "kmer", "end"], 1).select("grp", F.col("kmer").alias("top_kmer"))
    return sizes.join(top, "grp", "left").select("grp", "sequences", "letters", "hits", "top_kmer")
