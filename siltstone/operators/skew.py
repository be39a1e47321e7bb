"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than so many times the rows of an even partition.
HOT_TIMES = 2


def hot_keys(df: DataFrame, keys: list[str], times: float = HOT_TIMES) -> DataFrame:
    """The keys that would fill more than ``times`` even partitions, with ``_salts``, the partitions they are worth.

    An even partition is a ``spark.sql.shuffle.partitions``-th of the rows, so
    there are fewer hot keys than partitions whatever the table's size.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * parts > total * times).select(*keys, F.ceil(F.col("_n") * parts / total).cast("int").alias("_salts"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", times: float = HOT_TIMES) -> DataFrame:
    """Join where ``left`` may have hot keys and ``right`` has few rows a key.

    Hot rows of ``left`` are spread over as many partitions as they are worth by
    the hash of ``spread``; the matching rows of ``right`` are repeated for each,
    which makes at most a few copies a partition in all. All other keys keep one
    copy. ``how``: inner, left, left_semi or left_anti. Null keys never match, as
    in a plain join.
    """
    hot = F.broadcast(hot_keys(left, keys, times))  # fewer rows than partitions
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    a = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
