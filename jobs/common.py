"""What the jobs share: sequences of the text tables, settings, sessions, log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans import tables

#: The columns that are read, whatever others the files have.
DOCUMENTS = "doc_id long, source string, text string"


def sequences(documents: DataFrame) -> DataFrame:
    """(seq_id, grp, seq) of documents: the text's letters as bases; rows without an id are left out, as nothing could name
    what is found in them."""
    return tables.as_bases(documents.where("doc_id is not null").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("grp"), "text"))


def folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def stream_path(path: str) -> str:
    """path as a pattern that only it matches: file streams take a folder of files by its path, but one file by a pattern."""
    plain = path.rstrip("/")
    return f"{plain[:-1]}[{plain[-1]}]" if plain[-1:].isalnum() else plain


def main(about: str, run: Callable[..., DataFrame], config: str) -> None:
    """The command line: a config file of settings, any of which an option of its name replaces; makes and stops the session."""
    with open(config, encoding="utf-8") as f:
        known = json.load(f)
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help=f"JSON of settings (default: {config})")
    for name, value in known.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value) if isinstance(value, (int, str)) else json.loads, help=f"default: {value}")
    given = vars(parser.parse_args())
    chosen = given.pop("config")
    if chosen:
        with open(chosen, encoding="utf-8") as f:
            own = json.load(f)
        if unknown := set(own) - set(known):
            parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
        known |= own
    settings = known | {k: v for k, v in given.items() if v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
