"""Which documents belong to the evaluation, shared by the leak and the overlap operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys up to this number are broadcast (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_KEYS = 500_000


def file_name(path: Column) -> Column:
    return trimmed(F.element_at(F.split(path, "/"), -1))


def trimmed(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def evaluation_files(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """file and split ('' where only spans names it) of every evaluation file, once each; blank and null names are none."""
    listed = docs.select(trimmed(F.col("file")).alias("file"), F.coalesce("split", F.lit("")).alias("split"))
    named = spans.select(trimmed(F.col("file")).alias("file"), F.lit("").alias("split"))
    return listed.unionByName(named).where("file <> ''").groupBy("file").agg(F.max("split").alias("split"))


def sized(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The keys, marked for broadcasting if their counted number allows it; else as they are, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys
