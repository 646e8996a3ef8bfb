"""K-mer counts of sequences that keep arriving. Counts add up, so the batch operator's windows serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers


def stream_kmers(seqs: DataFrame, k: int = 12) -> DataFrame:
    """Streaming (seq_id, grp, seq) to (kmer, cnt); run it in update or complete mode."""
    return kmers.canonical_windows(seqs, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def stream_density(hits: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Streaming hits to counts by key and time window; rows later than the watermark are dropped."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
