"""Reading versions: latest, as of a sequence number, by key, and in order.

All functions take a changelog ``(key, seq, op, value)``; further columns are
ignored and an empty changelog gives an empty result. ``seq`` is unique per key;
exact repeats of a row count once. Keys compare as unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.model import DELETE, PUT
from siltstone.operators import ordered


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included.

    ``max`` of one struct has a partial step before the shuffle, so that of a key
    with very many versions each task sends one row. At equal ``seq`` a put wins,
    then the larger value.
    """
    return log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("v")).select("key", "v.seq", "v.op", "v.value")


def snapshot(log: DataFrame) -> DataFrame:
    """``key, seq, value`` of every live key."""
    return newest(log).filter(F.col("op") == PUT).select("key", "seq", "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The snapshot that a reader at ``seq`` sees: versions with a number up to it."""
    return snapshot(log.filter(F.col("seq") <= seq))


def tombstones(log: DataFrame) -> DataFrame:
    """``key, seq`` of the keys whose newest version is a delete."""
    return newest(log).filter(F.col("op") == DELETE).select("key", "seq")


def get(log: DataFrame, key: Column | bytes, seq: int | None = None) -> DataFrame:
    """``value`` of one key, no row if it is missing or deleted; the key filter reaches the scan."""
    own = log.filter(F.col("key") == (F.lit(bytearray(key)) if isinstance(key, (bytes, bytearray)) else key))
    return (snapshot(own) if seq is None else as_of(own, seq)).select("value")


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """``key, found, seq, value`` of each distinct non-null requested key.

    The log is cut down to the requested keys before versions are compared. Spark
    broadcasts the keys if their size allows; if not, it splits a partition that
    one key fills while the join runs (adaptive skew join), and of each key the
    comparison sends one row a task.
    """
    wanted = keys.filter("key is not null").select("key").distinct()
    if seq is not None:
        log = log.filter(F.col("seq") <= seq)
    hits = snapshot(log.join(wanted, "key", "left_semi"))
    return wanted.join(hits, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "seq", "value")


def history(log: DataFrame) -> DataFrame:
    """All versions with ``version``, 1 for the newest of a key.

    Versions are ranked inside sorted ranges; a key that fills several ranges
    gets the number of its versions in the ranges before added, which concerns at
    most one key a range boundary. So a key with very many versions is ranked by
    many tasks.
    """
    order = [F.asc("key"), F.desc("seq"), F.desc("op")]
    placed = ordered.ordered_parts(log.select("key", "seq", "op", "value"), order)
    sizes = placed.groupBy("key", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    carried = sizes.withColumn("_before", before).filter("_before > 0").select("key", "_part", "_before")
    inside = F.row_number().over(W.partitionBy("_part", "key").orderBy(F.desc("seq"), F.desc("op")))
    ranked = placed.withColumn("_i", inside).join(F.broadcast(carried), ["key", "_part"], "left")
    return ranked.select("key", "seq", "op", "value", (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long").alias("version"))


def scan(log: DataFrame, low: bytes | None = None, high: bytes | None = None, seq: int | None = None) -> DataFrame:
    """Live rows with ``low <= key < high`` in key order, as of ``seq``."""
    if low is not None:
        log = log.filter(F.col("key") >= F.lit(bytearray(low)))
    if high is not None:
        log = log.filter(F.col("key") < F.lit(bytearray(high)))
    return (snapshot(log) if seq is None else as_of(log, seq)).orderBy("key")


def scan_versions(log: DataFrame) -> DataFrame:
    """All versions in the order of the store: key ascending, newest first."""
    return log.orderBy(F.asc("key"), F.desc("seq"))


def lookup_layer(layers: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, layer, seq, op``: the layer that holds each key's newest version.

    ``layers``: a changelog with a column ``layer``. Keys that no layer holds have
    the layer 'none'. A tombstone is an answer too.
    """
    wanted = keys.filter("key is not null").select("key").distinct()
    first = (
        layers.join(wanted, "key", "left_semi").groupBy("key").agg(F.max(F.struct("seq", "op", "layer")).alias("v")).select("key", "v.layer", "v.seq", "v.op")
    )
    return wanted.join(first, "key", "left").withColumn("layer", F.coalesce("layer", F.lit("none")))
