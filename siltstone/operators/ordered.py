"""Running values over a global order, without a single task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.session import settle


#: Bytes that a range is meant to hold.
RANGE_BYTES = 256 << 20
#: From this size on, the optimizer's figure only says that it knows none.
UNKNOWN_BYTES = 1 << 60


def range_count(df: DataFrame) -> int:
    """Ranges for a table: the session's shuffle partitions, or one for each ``RANGE_BYTES`` if that is more.

    The size is the optimizer's own; behind a join it is no estimate but a bound
    (the product of both sides), so there the session's number stands.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    known = "Join " not in plan.toString() and size < UNKNOWN_BYTES
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if known else 1)


def ordered_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows placed in sorted ranges, with the range as ``_part``; written once, so that all readers agree."""
    n = range_count(df)
    return settle(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add running aggregates over ``order``.

    ``values``: name -> (kind, expression), kind 'sum', 'max' or 'min'. Without
    ``inclusive`` a row's own value is left out. Each range is summed by itself
    and then joined with what the ranges before it add up to: one row a range is
    all that meets in one task. An empty sum is 0, an empty maximum null.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    placed = ordered_parts(df.withColumns({f"_v_{k}": e for k, (_, e) in values.items()}), order)
    totals = placed.groupBy("_part").agg(*[kinds[kind](f"_v_{k}").alias(f"_t_{k}") for k, (kind, _) in values.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_part", *[kinds[kind](f"_t_{k}").over(before).alias(f"_c_{k}") for k, (kind, _) in values.items()])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = placed.join(F.broadcast(carried), "_part")
    for k, (kind, _) in values.items():
        own, carry = kinds[kind](f"_v_{k}").over(inside), F.col(f"_c_{k}")
        joined = F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(own, carry)
        out = out.withColumn(k, joined)
    return out.drop("_part", *[f"_v_{k}" for k in values], *[f"_c_{k}" for k in values])


def position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The place of each row in the order, from 1."""
    return running(df, order, {name: ("sum", F.lit(1))}, inclusive=True).withColumn(name, F.col(name).cast("long"))


def overlap_counts(probes: DataFrame, ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each probe range, how many of ``ranges`` share a key with it.

    Both have ``id, lo, hi`` with ``lo <= hi``; bounds are inclusive. A range
    misses a probe if it ends before the probe starts or starts after it ends, so
    the count is (starts up to ``hi``) - (ends before ``lo``): two running sums
    over sorted bounds instead of a join of all pairs. Bounds that are null
    match nothing. With ``by``, ``ranges`` has those 0/1 columns, and there is a
    count ``n_<column>`` for each; else one, ``n``.
    """
    flags = by or ["_one"]
    if not by:
        ranges = ranges.withColumn("_one", F.lit(1))
    probes = probes.filter("lo is not null and hi is not null")
    ranges = ranges.filter("lo is not null and hi is not null")
    none = [F.lit(0).alias(f"{s}{f}") for f in flags for s in ("s_", "e_")]
    kept = F.lit(None).cast(probes.schema["id"].dataType)
    # at one bound: starts (0) are before a probe's end (1), a probe's start (2) is before ends (3)
    bounds = (
        ranges.select(F.col("lo").alias("at"), F.lit(0).alias("turn"), kept.alias("id"), *[c for f in flags for c in (F.col(f).cast("int").alias(f"s_{f}"), F.lit(0).alias(f"e_{f}"))])
        .unionByName(ranges.select(F.col("hi").alias("at"), F.lit(3).alias("turn"), kept.alias("id"), *[c for f in flags for c in (F.lit(0).alias(f"s_{f}"), F.col(f).cast("int").alias(f"e_{f}"))]))
        .unionByName(probes.select(F.col("hi").alias("at"), F.lit(1).alias("turn"), "id", *none))
        .unionByName(probes.select(F.col("lo").alias("at"), F.lit(2).alias("turn"), "id", *none))
    )
    summed = running(bounds, [F.asc("at"), F.asc("turn")], {f"{s}n_{f}": ("sum", F.col(f"{s}{f}")) for f in flags for s in ("s_", "e_")})
    own = summed.filter("turn in (1, 2)").groupBy("id")
    name = (lambda f: f"n_{f}") if by else (lambda f: "n")
    return own.agg(*[(F.max(F.when(F.col("turn") == 1, F.col(f"s_n_{f}"))) - F.max(F.when(F.col("turn") == 2, F.col(f"e_n_{f}")))).cast("long").alias(name(f)) for f in flags])
