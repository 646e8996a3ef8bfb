"""The driver tables as sequences, positions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reference_values as V
from ..functions import sequence as S
from ..operators import kmers

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters to bases: A, C, G and T in turn, three letters to N.
AS_BASES = "ACGTACGTACGTACGTNCGTACGNAN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to all cores where the files give fewer partitions than there are cores, as single-file tables do."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def bases(text) -> F.Column:
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), UPPER, AS_BASES)


#: What :func:`bases` makes of each byte of UTF-8: letters of either case are bases, the rest, and so any other sign, is dropped.
_BASE_OF = bytes.maketrans((UPPER + UPPER.lower()).encode(), (AS_BASES * 2).encode())
_DROPPED = bytes(b for b in range(256) if chr(b) not in UPPER + UPPER.lower())


def as_bases(texts: DataFrame) -> DataFrame:
    """(seq_id, grp, seq) of (seq_id, grp, text): as :func:`bases`, in a task of its own, so that it is done once a text
    however often the sequence is tested or cut; an expression would be copied into each filter and column."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in kmers.portions(whole, 2)):
            seqs = [b"" if t is None else t.translate(_BASE_OF, _DROPPED) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.binary()).cast(pa.string())], ["seq_id", "grp", "seq"])

    d = texts.select("seq_id", "grp", "text")
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:2], T.StructField("seq", T.StringType())]))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_bases(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("grp"), "text")))


def benchmark_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), bases(F.col("text")).alias("seq"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, name, pos): the user, the type and the minute of each event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_type").alias("name"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("pos"))


def motifs(spark: SparkSession) -> DataFrame:
    """The known motifs, as constants of the plan: the optimizer knows how few they are."""
    rows = ", ".join(f"('{n}', '{m}', {V.SPACERS[n]})" for n, m in V.KNOWN_MOTIFS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, motif, spacer)")


def paralogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chromosome, paralog): one of the known names for each supplier."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), "s_suppkey").alias("chromosome"), _name((F.col("s_suppkey") * 5 + F.floor(F.col("s_suppkey") / 4)) % 4).alias("paralog"))


def _name(i):
    return F.element_at(F.array(*[F.lit(n) for n in V.KNOWN_MOTIFS]), i.cast("int") + 1)


def _letters(text, n: int):
    return F.substring(F.translate(F.md5(text.cast("binary")), "0123456789abcdef", "ACGT" * 4), 1, n)


def anchored_run(spark: SparkSession, sf_dir: str, assembly: int) -> DataFrame:
    """The sheet of an anchored run: a row a supplier, made up from its key; the assemblies differ in every third motif."""
    k = F.col("s_suppkey")
    kind = F.when((k % 3 == 0) & F.lit(assembly == 1), "n").otherwise("m")
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("C"), k).alias("chromosome"), F.concat(F.lit("TTGG"), _letters(F.concat(k.cast("string"), kind), 12)).alias("discovered_motif"), (k % 4 + 1).cast("int").alias("spacer"),
        (k * 37 % 2000 / 100.0).alias("cluster_pos_Mb"), (k * 53 % 3000).cast("int").alias("dist_from_end_kb"), (k * 7 % 120 + 1).cast("int").alias("copies"),
        F.when(k % 11 != 0, k * 29 % 4000).cast("int").alias("period_bp"), (k * 13 % 200 / 10.0).alias("downstream_bits"), (k * 17 % 101 / 100.0).alias("chrom_specificity"),
        _name(k % 4).alias("ce_paralog"), (k * 19 % 200 / 100.0).alias("ce_match_skill"))
    specific = F.col("chrom_specificity") >= 0.3
    return s.withColumn("confidence", S.confidence(F.col("downstream_bits"), F.col("period_bp"), F.col("dist_from_end_kb"), specific))


def free_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of an anchor-free run, for two suppliers of three."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where(k % 3 != 1)
    return s.select(F.concat(F.lit("C"), k).alias("chromosome"), _letters(F.concat(k.cast("string"), F.lit("f")), 12).alias("discovered_motif"), (k * 23 % 101 / 100.0).alias("chrom_specificity"), (k % 5 == 0).alias("recovered_TTGG"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both ends of each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("end"))
    s = s.withColumn("j", F.col("k") * 2 + (F.col("end") == "right").cast("int"))
    j = F.col("j")
    return s.select(F.concat(F.lit("C"), "k").alias("chromosome"), "end", F.concat(F.lit("TTGG"), _letters(F.concat(j.cast("string"), F.lit("c")), 8)).alias("candidate_motif"), (j % 4 + 1).cast("int").alias("spacer"), (j * 31 % 450 / 10.0).alias("fold_enrichment"), (j * 43 % 101 / 100.0).alias("chrom_specificity"), F.when(j % 7 != 0, j * 61 % 30000).cast("int").alias("median_spacing_bp"), _name(j % 4).alias("best_ce_paralog"), (j % 3 == 0).alias("convergent"), (j % 10 == 3).alias("low_complexity"), (j % 2 == 0).alias("tandem"))


# The same rows for the oracle.
_SQL_NAME = "[" + ", ".join(f"'{n}'" for n in V.KNOWN_MOTIFS) + "]"


def _sql_letters(text: str, n: int) -> str:
    return f"substring(translate(md5({text}), '0123456789abcdef', '{'ACGT' * 4}'), 1, {n})"


PARALOGS_SQL = f"para AS (SELECT concat('C', s_suppkey) AS chromosome, {_SQL_NAME}[(s_suppkey * 5 + s_suppkey // 4) % 4 + 1] AS paralog FROM supplier)"


def anchored_sql(name: str, assembly: int) -> str:
    kind = "CASE WHEN k % 3 = 0 THEN 'n' ELSE 'm' END" if assembly == 1 else "'m'"
    return f"""{name}_ AS (SELECT k, concat('C', k) AS chromosome, 'TTGG' || {_sql_letters(f"concat(k, {kind})", 12)} AS discovered_motif, CAST(k % 4 + 1 AS INTEGER) AS spacer, k * 37 % 2000 / 100.0::DOUBLE AS "cluster_pos_Mb", CAST(k * 53 % 3000 AS INTEGER) AS dist_from_end_kb, CAST(k * 7 % 120 + 1 AS INTEGER) AS copies, CASE WHEN k % 11 <> 0 THEN CAST(k * 29 % 4000 AS INTEGER) END AS period_bp, k * 13 % 200 / 10.0::DOUBLE AS downstream_bits, k * 17 % 101 / 100.0::DOUBLE AS chrom_specificity, {_SQL_NAME}[k % 4 + 1] AS ce_paralog, k * 19 % 200 / 100.0::DOUBLE AS ce_match_skill FROM (SELECT s_suppkey AS k FROM supplier)),
{name} AS (SELECT *, CASE WHEN downstream_bits >= 6 AND coalesce(period_bp BETWEEN 20 AND 3000, false) AND dist_from_end_kb <= 1500 AND chrom_specificity >= 0.3 THEN 'HIGH' WHEN downstream_bits >= 3.5 AND coalesce(period_bp BETWEEN 20 AND 3000, false) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM {name}_)"""


FREE_SQL = f"f AS (SELECT concat('C', k) AS chromosome, {_sql_letters("concat(k, 'f')", 12)} AS discovered_motif, k * 23 % 101 / 100.0::DOUBLE AS chrom_specificity, k % 5 = 0 AS \"recovered_TTGG\" FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 3 <> 1)"
CANDIDATES_SQL = f"cand AS (SELECT concat('C', k) AS chromosome, \"end\" AS end_, 'TTGG' || {_sql_letters("concat(j, 'c')", 8)} AS candidate_motif, j * 31 % 450 / 10.0::DOUBLE AS fold_enrichment, j * 43 % 101 / 100.0::DOUBLE AS chrom_specificity, CASE WHEN j % 7 <> 0 THEN CAST(j * 61 % 30000 AS INTEGER) END AS median_spacing_bp, {_SQL_NAME}[j % 4 + 1] AS best_ce_paralog, j % 3 = 0 AS convergent, j % 10 = 3 AS low_complexity, j % 2 = 0 AS tandem FROM (SELECT k, \"end\", k * 2 + CASE WHEN \"end\" = 'right' THEN 1 ELSE 0 END AS j FROM (SELECT s_suppkey AS k, unnest(['left', 'right']) AS \"end\" FROM supplier)))"
