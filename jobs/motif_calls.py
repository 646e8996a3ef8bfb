"""Motif calls of sequences that keep arriving: where the known motifs lie on new sequences, and whether they stand in tandem.

    python -m jobs.motif_calls --documents /data/documents.parquet --output /data/motif_calls

Each run takes the files that came since the last one (a file stream with a checkpoint, read until nothing is left), and
adds their hits and calls as partitions of the batch that took them. A batch that is taken again after a loss overwrites its
own partitions with the same rows, so a run can be stopped and started at any time; a run without new files adds nothing."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from seqloom.functions import sequence as S
from seqloom.operators import hits, kmers

log = logging.getLogger("motif_calls")

KEY = ["seq_id", "name"]
HITS = "batch long, name string, seq_id long, grp string, length int, position long, strand string"
CALLS = "batch long, name string, seq_id long, grp string, length int, plus long, minus long, sites long, w0 long, in_window long, period long, tandem boolean, from_end long"


def find(seqs: DataFrame, patterns: DataFrame, min_length: int) -> DataFrame:
    """(name, seq_id, grp, length, position, strand): hits of all patterns on both strands; the length travels with the id."""
    named = seqs.withColumn("seq_id", F.struct("seq_id", F.length("seq").alias("length")))
    found = kmers.scan(named, patterns, min_length)
    return found.select("name", "seq_id.seq_id", "grp", "seq_id.length", "position", "strand")


def call(found: DataFrame, width: int, step: int) -> DataFrame:
    """(name, seq_id, grp, length, plus, minus, sites, w0, in_window, period, tandem, from_end): a row a motif that a
    sequence has: its hits by strand and different places, the densest window, the median gap, whether that is a tandem
    repeat's, and the window's distance from the nearer end."""
    sites = found.groupBy(*KEY, "position").agg(F.max("length").alias("length"))
    counts = found.groupBy(*KEY).agg(F.max("grp").alias("grp"), F.max("length").alias("length"), F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))
    dense = hits.densest_window(sites, KEY, "position", width, step).withColumnRenamed("n", "in_window")
    gaps = hits.median_gap(sites, KEY, "position").withColumnRenamed("n", "sites")
    out = counts.join(dense, KEY).join(gaps, KEY)
    far = F.least(F.col("w0"), F.col("length") - F.col("w0"))
    return out.select("name", "seq_id", "grp", "length", "plus", "minus", "sites", "w0", "in_window", "period", S.tandem(F.col("period")).alias("tandem"), far.alias("from_end"))


def _write(rows: DataFrame, path: str, batch: int) -> None:
    """rows as the partitions of this batch: overwrites what an earlier attempt of the same batch left, and nothing else."""
    to = rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    to.partitionBy("batch", "name").parquet(path)


def run(spark: SparkSession, documents: str, output: str, patterns: dict[str, str], min_length: int = 1_000_000, width: int = 50_000, step: int = 5_000, files_per_batch: int = 64) -> DataFrame:
    """Takes the new files of ``documents`` and returns all calls so far, those of earlier runs too: a row a motif that a
    sequence has. Checkpoint, hits and calls are folders below ``output`` and belong together.

    Rows without an id, a text or ``min_length`` letters have no calls. New rows come as new files; an id is taken to come once.
    A run over no files at all gives no rows."""
    found_at, calls_at = common.folder(output, "hits"), common.folder(output, "calls")
    # Tables that exist, though nothing may have been found yet.
    for path, schema in ((found_at, HITS), (calls_at, CALLS)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch", "name").parquet(path)
    motifs = spark.createDataFrame(sorted(patterns.items()), "name string, motif string")

    def take(rows: DataFrame, batch: int) -> None:
        seen = Observation()
        seqs = common.sequences(rows)
        told = seqs.observe(seen, F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("letters"))
        _write(find(told, motifs, min_length), found_at, batch)
        mine = rows.sparkSession.read.schema(HITS).parquet(found_at).where(F.col("batch") == batch)
        _write(call(mine, width, step), calls_at, batch)
        log.info("batch %d: read %d sequences of %d letters, wrote hits to %s and calls to %s", batch, seen.get["sequences"], seen.get["letters"], found_at, calls_at)

    stream = spark.readStream.schema(common.DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(common.stream_path(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", common.folder(output, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    calls = spark.read.schema(CALLS).parquet(calls_at).drop("batch")
    log.info("read %d new rows of %s; %s now holds %d calls", taken, documents, calls_at, calls.count())
    return calls


if __name__ == "__main__":
    common.main(__doc__.splitlines()[0], run, str(Path(__file__).with_suffix(".json")))
