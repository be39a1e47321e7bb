"""Keeping large values apart from the keys, in value logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.files import RECORDS

#: Bytes of a record besides its value: an 8-byte checksum and a 4-byte length.
RECORD_HEADER = 12


def is_large(value: Column, threshold: int) -> Column:
    """Whether a value goes to a value log; null values (deletes) never do."""
    return F.coalesce(F.octet_length(value) >= threshold, F.lit(False))


def offsets(df: DataFrame, vlog: str, order: list[Column], value: Column, name: str = "vlog_off") -> DataFrame:
    """The place of each value in its log: the records before it, uncompressed, with their headers.

    A value log has a bounded size, so its rows are summed by one window. Ties in
    ``order`` must be impossible.
    """
    before = W.partitionBy(vlog).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    size = (F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_HEADER).cast("long")
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def separate(log: DataFrame, path: str, logs: int = 1, threshold: int = 128) -> DataFrame:
    """Write the large values of a changelog to value logs under ``path``; returns the entries.

    Entries: ``key, seq, op, value_inline, vlog_fid, vlog_off``; records:
    ``vlog_fid, vlog_off, key, seq, op, value``. Large values are laid out in key
    order, in ``logs`` ranges of (key, seq), so that a key with very many versions
    fills several. A pointer is the log and the place in it, both known from where
    a row was written: values move and are written once, and the entries are read
    back from the written logs without them.
    """
    large = is_large(F.col("value"), threshold)
    place = F.monotonically_increasing_id()
    (
        log.filter(large)
        .repartitionByRange(logs, "key", "seq")
        .sortWithinPartitions(F.asc("key"), F.desc("seq"))
        .select(place.alias("_at"), "key", "seq", "op", "value")
        .select(F.shiftright("_at", 33).alias("vlog_fid"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("vlog_off"), "key", "seq", "op", "value")
        .write.mode("overwrite")
        .option("compression", "lz4_raw")
        .parquet(path)
    )
    none = F.lit(None)
    small = log.filter(~large).select("key", "seq", "op", F.col("value").alias("value_inline"), none.cast("long").alias("vlog_fid"), none.cast("long").alias("vlog_off"))
    logged = log.sparkSession.read.schema(RECORDS).parquet(path)
    return small.unionByName(logged.select("key", "seq", "op", none.cast("binary").alias("value_inline"), "vlog_fid", "vlog_off"))


def resolve(entries: DataFrame, records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The changelog again: pointers followed, inline values as they are.

    A pointer to nothing gives a null value.
    """
    by = by or ["vlog_fid", "vlog_off"]
    joined = entries.join(records.select(*by, "value"), by, "left")
    return joined.select("key", "seq", "op", F.coalesce("value_inline", "value").alias("value"))


def inherited(files: DataFrame, by: list[str]) -> DataFrame:
    """``by..., vlogs``: the value logs of a file that is compacted from each group's without rewriting values: all of theirs, each once."""
    held = files.select(*by, F.explode("vlogs").alias("vlog")).filter("vlog is not null").distinct()
    lists = held.groupBy(*by).agg(F.array_sort(F.collect_list("vlog")).alias("vlogs"))  # value logs are far fewer than records
    return files.select(*by).distinct().join(lists, by, "left").withColumn("vlogs", F.coalesce("vlogs", F.array().cast("array<bigint>")))
