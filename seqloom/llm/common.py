"""What the corpus operators share: scratch tables in the cluster's shared folder, words, splits."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch; texts are long, so batches must be short for memory's sake.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Short Arrow batches, unless the session asks for still shorter ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what was set as the checkpoint folder. Where
    neither is set, one process that is driver and executor in one takes a folder of its own; a cluster is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seqloom-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/seqloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: cuts lineage, survives lost executors, and fixes whatever depends on task order."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: The column that numbered() adds, and bits of it for a row's place in its file.
ROW, PLACE_BITS = "_seqloom_row", 40
#: Up to so many files, their numbers are broadcast (about 200 bytes each).
BROADCAST_FILES = 100_000


def _is_scan(df: DataFrame) -> bool:
    """Whether df is files read as they are, with nothing but columns and rows left out."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def numbered(df: DataFrame, name: str = ROW) -> DataFrame:
    """df with a long column that tells its rows apart, and stays the same whenever they are read again.

    For files it is the file's number and the row's place in it, so nothing is written; other frames are written out with
    numbers. So rows without an id, or with one that repeats, can be found again."""
    if _is_scan(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
            files = materialize(placed.select("_path").distinct().withColumn("_file", F.row_number().over(W.orderBy("_path")).cast("long")), "files")
            near = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
            return placed.join(near, "_path").withColumn(name, F.shiftleft("_file", PLACE_BITS) + F.col("_place")).select(*df.columns, name)
        except AnalysisException as error:  # a format that doesn't tell the place of a row
            if not (error.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
                raise
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def apart(df: DataFrame) -> DataFrame:
    """df behind an exchange of its own. A join straight above an aggregate can't be split where a key is hot; above an
    exchange it can. For aggregates, which have a row a key."""
    return df.repartition(partitions(df.sparkSession))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def numbers(xs: list[int]) -> Column:
    """A constant array; as text until the optimizer folds it, so a plan of many bounds stays short."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of the rising bounds that are at most key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    group = below(numbers(bounds[::step]))
    first = F.greatest(group - 1, F.lit(0)) * step
    return F.when(group == 0, 0).otherwise(first + below(F.slice(numbers(bounds), first + 1, F.lit(step))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), for uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these lengths laid end to end: the piece of each item, and the start of each piece."""
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.repeat(np.arange(len(lengths)), lengths), starts


class WordHashes:
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, get = self.known, self.hash
        if len(known) > self.most:
            known.clear()
        out = []
        put = out.append
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = get(w)
            put(h)
        return np.array(out, np.uint64)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
