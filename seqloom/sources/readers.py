"""Readers of sequence, annotation, oligo, hit and factor files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reference_values as V
from ..functions import sequence as S

GFF = T.StructType([T.StructField(c, T.LongType() if c in ("start", "end") else T.StringType()) for c in V.GFF_COLUMNS])
HITS = T.StructType([T.StructField(c, {"pident": T.DoubleType(), "length": T.IntegerType(), "qcovs": T.IntegerType(), "bitscore": T.DoubleType(), "evalue": T.DoubleType()}.get(c, T.StringType())) for c in V.HIT_COLUMNS])
FACTORS = "matrix_id string, name string, uniprot string, species string, pfm struct<A:array<double>,C:array<double>,G:array<double>,T:array<double>>"


def read_fasta(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(file_ord, seq_id, header, seq) of plain or gzipped FASTA, a row a record; a later record of an id replaces an earlier.

    Records are split by the reader itself, so a plain file of any size is read in parallel; gzip is one task a file, so
    its rows are dealt out afterwards. Text before the first header is lost; an empty header is an error."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.monotonically_increasing_id().alias("file_ord"), F.col("_metadata.file_path").alias("_file"))
    # What comes first in a file has its header mark still, or else it is text before any header. A row a file.
    ahead = raw.groupBy("_file").agg(F.min("file_ord").alias("file_ord")).select("file_ord", F.lit(True).alias("ahead"))
    # A blank before a header mark is no part of the line; such records are split here.
    parts = F.posexplode(F.split("value", r"\n[^\S\n]+>")).alias("part", "value")
    raw = raw.join(ahead, "file_ord", "left").select("file_ord", (F.coalesce("ahead", F.lit(False))).alias("ahead"), parts)
    begins = F.col("ahead") & (F.col("part") == 0)
    first = F.when(begins, F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))
    has_header = F.regexp_like(F.col("value"), F.lit(r"^\s*>")) | ~begins
    head = F.trim(F.regexp_extract(first, r"^([^\n]*)", 1))
    rows = raw.where(has_header & (F.length(F.trim("value")) > 0)).select("file_ord", "part", head.alias("header"), F.regexp_replace(F.regexp_replace(first, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    rows = rows.withColumn("seq_id", F.when(F.length("header") > 0, S.header_id(F.col("header"))).otherwise(F.raise_error(F.lit("empty FASTA header"))))
    last = rows.groupBy("seq_id").agg(F.max_by(F.struct("header", "seq"), F.struct("file_ord", "part")).alias("r"), F.min("file_ord").alias("file_ord"))
    out = last.select("file_ord", "seq_id", "r.header", "r.seq")
    return out.repartition(partitions) if partitions else out


def read_fasta_headers(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header)."""
    return read_fasta(spark, path).select("seq_id", "header")


def read_header_fields(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, fields): the header's k=v words as a map."""
    return read_fasta(spark, path).select("seq_id", S.header_fields(F.col("header")).alias("fields"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(name, aligned) of aligned FASTA in upper case, with - for a gap; rows of different lengths are an error."""
    rows = read_fasta(spark, path).select(F.col("seq_id").alias("name"), F.translate(F.upper("seq"), ".~", "--").alias("aligned"))
    width = rows.agg(F.max(F.length("aligned")).alias("width"))
    checked = rows.crossJoin(F.broadcast(width)).withColumn("aligned", F.when(F.length("aligned") == F.col("width"), F.col("aligned")).otherwise(F.raise_error(F.concat(F.lit("not aligned: "), "name"))))
    return checked.select("name", "aligned")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 with declared types; a # ends a line wherever it stands."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "#.*", "").alias("line")).where(F.trim("line") != "")
    part = F.split("line", "\t")
    return lines.select(*[F.when(F.get(part, F.lit(i)) != "", F.get(part, F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(GFF.fields)])


def read_oligos(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, offset, oligo, skipped): the first run of base letters of each line, where it starts, and the runs left out."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    runs = F.regexp_extract_all("value", F.lit("[ACGTNacgtn]+"), F.lit(0))
    return raw.select("file", "line_no", (F.regexp_instr("value", F.lit("[ACGTNacgtn]+")) - 1).alias("offset"), F.get(runs, F.lit(0)).alias("oligo"), F.greatest(F.size(runs) - 1, F.lit(0)).alias("skipped")).where("oligo is not null")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignment hits, the best by bit score for each pair."""
    return best_per_pair(spark.read.schema(HITS).csv(path, sep="\t"))


def best_per_pair(hits: DataFrame) -> DataFrame:
    one = hits.groupBy("qseqid", "sseqid").agg(F.max_by(F.struct(*[c for c in hits.columns if c not in ("qseqid", "sseqid")]), F.struct("bitscore", -F.col("evalue"), "length")).alias("r"))
    return one.select("qseqid", "sseqid", "r.*").select(*hits.columns)


def read_factors(spark: SparkSession, path: str, excluded: tuple = ()) -> DataFrame:
    """Factor matrices from JSON; records without an accession or a matrix, or that name an excluded term, are left out."""
    rows = spark.read.schema(FACTORS).json(path).where("uniprot is not null and uniprot <> '' and pfm is not null")
    if excluded:
        rows = rows.where(~(S.names_any(F.col("name"), list(excluded)) | S.names_any(F.col("species"), list(excluded))))
    return rows


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV artifact with a header and declared types."""
    return spark.read.schema(schema).csv(path, header=True)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, vector) as written by the vector sink."""
    return spark.read.schema("name string, vector array<double>").parquet(path)


def pending(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys still to be fetched, each once, in the order in which they first came (column ord)."""
    return wanted.groupBy(key).agg(F.min("ord").alias("ord")).join(cached.select(key), key, "left_anti").orderBy("ord")
