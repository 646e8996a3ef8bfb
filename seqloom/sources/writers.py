"""Sinks: single-file CSV, named vectors, JSON metadata, FASTA, and the router from artifact names to folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for result sheets; large tables belong in Parquet."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_vectors(df: DataFrame, path: str, name: str = "name", vector: str = "vector") -> None:
    df.select(F.col(name).cast("string").alias("name"), F.col(vector).cast("array<double>").alias("vector")).write.mode("overwrite").parquet(path)


def write_metadata(spark, path: str, **values) -> None:
    """One JSON object of provenance."""
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def gunzip(spark, source: str, to: str) -> None:
    """Lines of compressed files as plain text, so that later readers can split them."""
    spark.read.text(source).write.mode("overwrite").option("compression", "none").text(to)


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


class Router:
    """Folder of an artifact by the first prefix that its name starts with; names of no prefix go to the root."""

    def __init__(self, root: str, rules: list[tuple[str, str]]):
        self.root, self.rules = root.rstrip("/"), rules

    def folder(self, name: str) -> str:
        return next((folder for prefix, folder in self.rules if name.startswith(prefix)), "")

    def path(self, name: str) -> str:
        return "/".join(x for x in (self.root, self.folder(name), name) if x)

    def folders(self, name: str) -> Column:
        """The folder of each name of a column; null for null."""
        out = F.when(F.col(name).isNull(), None)
        for prefix, folder in self.rules:
            out = out.when(F.col(name).startswith(prefix), folder)
        return out.otherwise("")
