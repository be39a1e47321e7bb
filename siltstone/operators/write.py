"""Writing: batches of operations and the numbers they get."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import CHANGELOG, DELETE, PUT
from siltstone.operators import ordered


class WriteBatch:
    """Operations that are applied together and in order; later ones win."""

    def __init__(self, ops: Iterable[tuple[bytes, int, bytes | None]] = ()):
        self.ops = list(ops)

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((bytes(key), PUT, bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((bytes(key), DELETE, None))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def to_df(self, spark: SparkSession, base: int) -> DataFrame:
        """The batch as a changelog: entry i has the number ``base + i``."""
        return spark.createDataFrame([(bytearray(k), base + i, op, None if v is None else bytearray(v)) for i, (k, op, v) in enumerate(self.ops)], CHANGELOG)


def number_batches(ops: DataFrame, base: int) -> DataFrame:
    """Sequence numbers for many batches: ``seq`` follows ``(batch_id, pos)`` from ``base`` without gaps.

    The place in the global order is counted range by range, so neither one task
    for all nor one for a large batch is needed. Rows without a batch or place
    are dropped; ``(batch_id, pos)`` is unique.
    """
    ops = ops.filter("batch_id is not null and pos is not null")
    return ordered.position(ops, [F.asc("batch_id"), F.asc("pos")], "seq").withColumn("seq", F.col("seq") + (base - 1))


def entry_bytes() -> Column:
    """Bytes of the keys and values of a changelog, as an aggregate; 0 for none."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return F.coalesce(F.sum(size.cast("long")), F.lit(0))


def memory_use(log: DataFrame) -> DataFrame:
    """``bytes``: the sizes of all keys and values, the measure that a flush waits for."""
    return log.agg(entry_bytes().alias("bytes"))
