"""Exact dedup through a minimal perfect hash over historical digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize, mix64, texts_of, tune

#: Keys of one index shard (about 125 kB of slots), rows looked up at once against it: a shard that more ask for, as that of a
#: text with many copies, is copied.
SHARD_KEYS, TASK_ROWS = 2_500, 5_000
#: Bits per key of one level of the cascade.
GAMMA = 2.0
#: Up to so many shards, their row counts are broadcast (12 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SHARDS = 200_000
#: Stands for a null id: it wins over no other.
LEAST = -(2**63)
INDEX = "shard long, n_keys long, sizes array<long>, bits array<binary>, digests binary, winners binary, counts binary"


FOUND = "id long, row long, digest binary, keep_id long, n long"


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """keys: (n, 4) uint64, the four words of each digest."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return (mix64(keys[:, 1] ^ mix64(keys[:, 2] + salt)) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Cascade of bit arrays: a key that is alone at its place of a level is held there; the others go to the next level.
    keys must be distinct. The place of a key among all set bits is its slot, so n keys fill n slots."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _positions(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        if len(sizes) > 200:
            raise ValueError("keys are not distinct")
    return sizes, bits


def slots(keys: np.ndarray, sizes: list[int], bits: list[np.ndarray]) -> np.ndarray:
    """Slot of each key, -1 where no level holds it. A key that was not built in may get any slot: compare digests."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, (size, held) in enumerate(zip(sizes, bits)):
        at = _positions(keys[open_], level, size)
        hit = held[at]
        rank = np.cumsum(held) - 1
        out[open_[hit]] = base + rank[at[hit]]
        base, open_ = base + int(held.sum()), open_[~hit]
    return out


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf["digest"])
    sizes, bits = build_mph(keys)
    order = np.argsort(slots(keys, sizes, bits))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_keys": [len(keys)], "sizes": [sizes], "bits": [[np.packbits(b).tobytes() for b in bits]], "digests": [keys[order].tobytes()], "winners": [pdf["keep_id"].to_numpy(np.int64)[order].tobytes()], "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()]})


def _lookup(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    n = len(rows)
    keep, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and len(index):
        one = index.iloc[0]
        keys = _matrix(rows["digest"])
        sizes = [int(x) for x in one["sizes"]]
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=s).astype(bool) for b, s in zip(one["bits"], sizes)]
        at = slots(keys, sizes, bits)
        held = np.frombuffer(one["digests"], np.uint64).reshape(-1, 4)
        member = (at >= 0) & (held[at] == keys).all(axis=1)  # all 32 bytes
        keep[member] = np.frombuffer(one["winners"], np.int64)[at[member]]
        size[member] = np.frombuffer(one["counts"], np.int64)[at[member]]
    else:
        member = np.zeros(n, bool)
    return pd.DataFrame({"id": rows["id"], "row": rows["row"], "digest": rows["digest"], "keep_id": pd.Series(keep, rows.index, dtype="Int64").where(pd.Series(member, rows.index)), "n": size})


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, digest): SHA-256 of the UTF-8 text after lower-casing A-Z; null text counts as empty, a null id as the least
    integer. row is 0 without a column that tells rows apart."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            made = [hashlib.sha256(t.lower()).digest() for t in texts_of(b.column(2))]  # bytes.lower() folds A-Z only
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["id", "row", "digest"])

    row = F.col(row_col) if row_col else F.lit(0)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), row.cast("long").alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, row long, digest binary")


def winners(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, n): the largest id and the size of each group; counted before the shuffle, so hot groups cost one row a task."""
    return digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """history: (digest, keep_id, n) with distinct digests. Returns the index, a row a shard, and the number of shards."""
    shards = max(1, -(-history.count() // shard_keys))
    index = _sharded(history.select("digest", F.coalesce("keep_id", F.lit(LEAST)).alias("keep_id"), "n"), shards).groupBy("shard").applyInPandas(_build, INDEX)
    return materialize(index, "mph"), shards


def lookup(digests: DataFrame, index: DataFrame, shards: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, row, digest, keep_id, n) for each row; keep_id is null for digests that the index doesn't hold.
    A shard that many rows ask for is copied to as many tasks as its rows need."""
    rows = _sharded(digests, shards)
    ask = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(task_rows)).cast("int").alias("parts"))
    ask = materialize(ask, "mph-load")
    near = F.broadcast(ask) if shards <= BROADCAST_SHARDS else ask
    left = rows.join(near, "shard").withColumn("part", F.pmod(F.xxhash64("id", "row"), F.col("parts")).cast("int")).drop("parts")
    right = index.join(near, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_lookup, FOUND)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and row_col if given (a long that tells rows apart).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. history holds digests of earlier data
    as (digest, keep_id, n). Members get the winner that the index holds, and are kept only if they are that row; the others
    are grouped among themselves, and the row with the largest id stays.

    Without a history, half of the documents, by a hash of their ids, are it. The other half is looked up in its index; what
    isn't a member is grouped apart, and members raise the winners and counts that the slots hold, if their ids are larger.

    Rows that repeat an id and its text share keep_id and kept. A null id never wins over another id; a group of null ids
    alone has a null keep_id and is kept. An empty table gives no rows."""
    digests = materialize(digest_rows(docs, id_col, text_col, row_col), "digests")
    if history is None:
        old = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
        known = materialize(winners(digests.where(old)), "winners")
        index, shards = build_index(known)
        found = materialize(lookup(digests.where(~old), index, shards), "lookups")
        more = winners(found.where("keep_id is not null").select("digest", "id")).select("digest", F.col("keep_id").alias("other"), F.col("n").alias("m"))
        raised = known.join(apart(more), "digest", "left").select("digest", F.greatest("keep_id", "other").alias("keep_id"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        index, shards = build_index(materialize(raised, "raised"))
        members = lookup(digests.where(old).unionByName(found.where("keep_id is not null").select("id", "row", "digest")), index, shards)
    else:
        index, shards = build_index(history)
        found = materialize(lookup(digests, index, shards), "lookups")
        members = found.where("keep_id is not null")
    new = found.where("keep_id is null").select("id", "row", "digest")
    result = members.unionByName(new.join(apart(winners(new)), "digest").select("id", "row", "digest", "keep_id", "n"))
    back = lambda c: F.when(F.col(c) != F.lit(LEAST), F.col(c))
    return result.select(back("id").alias(id_col), back("keep_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep_id") == F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("row").alias(row_col)] if row_col else []))
