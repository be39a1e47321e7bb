"""The changelog relation, its schemas, and the options of a store."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1

CHANGELOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

FILE_REF = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("file_no", T.LongType())])

FILE_META = T.StructType(
    [
        T.StructField("file_no", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("smallest", T.BinaryType()),
        T.StructField("largest", T.BinaryType()),
        T.StructField("vlogs", T.ArrayType(T.LongType())),
    ]
)


@dataclass(frozen=True)
class Options:
    """Settings of a store; each ``with_...`` call returns a changed copy.

    Point reads keep runs of up to a sixteenth of ``cache_size`` in storage memory;
    ``allow_miss_count`` fruitless probes of a run ask for its compaction.
    ``allow_miss_size`` is accepted so that settings carry over, and has no effect.
    """

    work_dir: str = "work_dir"
    block_size: int = 4 * 1024
    mem_size: int = 2 * 1024 * 1024
    cache_size: int = 4 * 1024 * 1024
    kv_separate_threshold: int = 128
    allow_miss_size: int = 4 * 1024
    allow_miss_count: int = 100
    target_file_size: int = 128 * 1024 * 1024

    def with_options(self, **changes: object) -> Options:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return replace(self, **changes)


def be_bytes(n: Column, width: int) -> Column:
    """Big-endian unsigned bytes of a non-negative integer column."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def changelog(df: DataFrame, key: Column, seq: Column, op: Column, value: Column) -> DataFrame:
    """Project any table onto the changelog columns; rows without key or seq are dropped.

    A delete never carries a value, whatever the source row holds.
    """
    op = op.cast("int")
    return df.select(
        key.cast("binary").alias("key"),
        seq.cast("long").alias("seq"),
        op.alias("op"),
        F.when(op == PUT, value.cast("binary")).alias("value"),
    ).filter("key is not null and seq is not null and op is not null")


def events_changelog(events: DataFrame) -> DataFrame:
    """The events table as a changelog: 4-byte user key, event id as sequence number, 'error' as delete."""
    return changelog(
        events,
        be_bytes(F.col("user_id"), 4),
        F.col("event_id"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT),
        F.col("props").cast("binary"),
    )
