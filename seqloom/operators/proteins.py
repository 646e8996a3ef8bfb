"""Zinc fingers and the regions that embeddings are pooled over."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference_values as V

_FINGER = re.compile(V.FINGER)


def with_fingers(df: DataFrame, seq: str = "seq") -> DataFrame:
    """df with fingers: array of (start, end, full_end) of the recognition helix of each finger, from left to right."""

    @F.pandas_udf("array<struct<start:int,end:int,full_end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": m.start(1), "end": m.end(1), "full_end": m.end()} for m in _FINGER.finditer(x or "")])

    return df.withColumn("fingers", run(F.col(seq)))


def helices(seq: Column) -> Column:
    """Recognition helices as text."""
    return F.regexp_extract_all(seq, F.lit(V.FINGER), F.lit(1))


def recognition_positions(fingers: Column, n: int = 2) -> Column:
    """Places of the first n fingers' helices, in order."""
    return F.flatten(F.transform(F.slice(fingers, 1, n), lambda f: F.sequence(f["start"], f["end"] - 1)))


def recognition_residues(seq: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(helices(seq), 1, n), "")


def tail_region(seq: Column, fingers: Column, n: int = 2) -> Column:
    """(start, stop): from the end of the n-th finger to the end; null with fewer fingers."""
    return F.when(F.size(fingers) >= n, F.struct(F.get(fingers, F.lit(n - 1))["full_end"].alias("start"), F.length(seq).alias("stop")))


def domain(seq: Column, margin: int = 5) -> Column:
    """(start, stop): from a margin before the first finger to the end; null without one."""
    at = F.regexp_instr(seq, F.lit(V.FINGER_GREEDY))
    return F.when(at > 0, F.struct(F.greatest(at - 1 - margin, F.lit(0)).alias("start"), F.length(seq).alias("stop")))


def conservation(pairs: DataFrame) -> DataFrame:
    """(paralog, recognition_conservation): mean share of equal residues over the fingers that two proteins (paralog, left,
    right) have in common, rounded to two places."""
    from .align import residue_identity, with_identity

    p = pairs.withColumns({"l": helices(F.col("left")), "r": helices(F.col("right"))})
    e = p.select("paralog", F.posexplode(F.arrays_zip("l", "r")).alias("i", "x")).select("paralog", "x.l", "x.r").where("l is not null and r is not null")
    return with_identity(e, "l", "r", "same", residue_identity).groupBy("paralog").agg(F.round(F.avg("same"), 2).alias("recognition_conservation"))
