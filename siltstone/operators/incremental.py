"""Processing only new or changed records, with the target itself as the state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import ordered
from siltstone.operators.skew import skew_join
from siltstone.session import settle
from siltstone.sources.versions import VersionLog

#: Least number of log numbers in a bucket of the interval join; an interval is repeated once a bucket it touches.
BUCKET = 64
#: Spark jobs that a replayed history is cut into; each is a run of its own against the target.
RUNS = 4


def reached(edits: DataFrame) -> DataFrame:
    """``edit_id, hi, lo``: the highest log each successful run reached, and the one before it.

    Only committed rows count, repeated rows once. Runs that reach no higher log
    than an earlier one take nothing and are left out; ``lo`` is null for the
    first. A null ``edit_id`` or ``log_number`` reaches nothing. The running
    maximum is taken range by range, so a long history is no single task.
    """
    runs = (
        edits.filter("state = 'committed' and edit_id is not null and log_number is not null")
        .groupBy(F.col("edit_id").cast("long").alias("edit_id"))
        .agg(F.max("log_number").cast("long").alias("hi"))
    )
    return ordered.running(runs, [F.asc("edit_id")], {"lo": ("max", F.col("hi"))}).filter("lo is null or hi > lo").select("edit_id", "hi", "lo")


def record_logs(source: DataFrame) -> DataFrame:
    """``seq, version, log_number`` of each record.

    A record is known by its ``seq``; its log is the smallest non-null one of its
    deliveries, its version a digest of what it says, so that a record whose
    content changes is a new version while a repeated delivery is not.
    """
    return (
        source.filter("seq is not null and log_number is not null")
        .groupBy(F.col("seq").cast("long").alias("seq"))
        .agg(F.max(F.xxhash64("key", "op", "value")).alias("version"), F.min("log_number").cast("long").alias("log_number"))
    )


def take(records: DataFrame, runs: DataFrame) -> DataFrame:
    """``edit_id, seq, version, log_number``: each record with the first of the ``runs`` that reaches its log.

    ``runs``: ``edit_id, hi, lo`` with rising, disjoint ``(lo, hi]``; the first has
    no ``lo`` and takes whatever is left from before. Cutting the intervals at
    multiples of a width turns the range join into an equality on the bucket. The
    width is ``BUCKET`` or more, so wide that the copies are at most five times
    the runs. A log that holds a large part of the records is spread by ``seq``.
    """
    low = records.agg(F.min("log_number")).first()[0]
    high, n = runs.agg(F.max("hi"), F.count("*")).first()
    if low is None or high is None or high < low:
        return records.filter("false").select(F.lit(0).cast("long").alias("edit_id"), "seq", "version", "log_number")
    width = max(BUCKET, (high - low) // (4 * n) + 1)
    cut = (
        runs.filter(F.col("hi") >= low)
        .withColumn("lo", F.greatest(F.coalesce("lo", F.lit(low - 1)), F.lit(low - 1)))
        .withColumn("bucket", F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.floor(F.col("hi") / width))))
        .select("edit_id", "lo", "hi", "bucket")
    )
    keyed = records.withColumn("bucket", F.floor(F.col("log_number") / width))
    met = skew_join(keyed, cut, ["bucket"], ["seq"])
    return met.filter("log_number > lo and log_number <= hi").select("edit_id", "seq", "version", "log_number")


class IncrementalTarget:
    """A target table whose rows hold the key and version of their source record.

    What has been processed is read from the target itself: the source is
    anti-joined with it on key and version, so new records and changed ones are
    taken, and those that are there in the same version are not. A run writes its
    rows to a folder that no other attempt uses and then publishes it by one
    rename of a small version file. A run that dies before that leaves a folder
    that no version names, so it is as if it had never been; one that is repeated
    after it was published finds its rows in the target and adds nothing. Of two
    runs that start from the same version one fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.versions = VersionLog(spark, f"{self.path}/versions")

    def folders(self, version: int | None = None) -> list[str]:
        """The data folders that a version, by default the current one, is made of."""
        return self.versions.read(version).get("folders", [])

    def read(self, schema, version: int | None = None) -> DataFrame:
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{x}" for x in folders])

    def pending(self, source: DataFrame, version: int | None = None) -> DataFrame:
        """The source rows whose key and version the target does not hold; null keys are equal to each other."""
        names = [*self.key, self.version]
        done = self.read(source.select(*names).schema, version).select(*[F.col(n).alias(f"_done_{n}") for n in names])
        same: Column = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_done_{n}"))
        return source.join(done, same, "left_anti")

    def write(self, rows: DataFrame, base: int) -> str:
        """Write the rows of a run to a new folder, which is returned; nothing sees them before :meth:`publish`."""
        attempt = f"{base + 1:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def publish(self, attempt: str, base: int) -> int:
        """Make ``base + 1`` the current version; fails if another run was faster or the folder is there already."""
        named = self.folders(base)
        if attempt in named:
            raise ValueError(f"{attempt} is published already")
        return self.versions.publish(base, {"folders": [*named, attempt]})

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Process what is pending and publish it as a new version.

        The rows of ``process`` keep key and version of their source row.
        """
        base = self.versions.current()
        return self.publish(self.write(process(self.pending(source, base)), base), base)


def replay_runs(spark: SparkSession, path: str, source: DataFrame, edits: DataFrame, runs: int = RUNS) -> DataFrame:
    """``edit_id, seq`` of every record each successful run had to process.

    The history is replayed in ``runs`` jobs of consecutive edits against one
    target. Each job is offered all records that its edits reach, those of
    earlier jobs too; the anti-join leaves what the target lacks, and the first
    edit of the job that reaches such a record takes it. The result does not
    depend on ``runs``, and replaying a path again adds nothing.
    """
    target = IncrementalTarget(spark, path, ["seq"], "version")
    records, history = settle(record_logs(source), "records"), settle(reached(edits), "runs")
    shares = ", ".join(str((i + 1) / runs) for i in range(runs))
    before = None
    for high in sorted(set(history.selectExpr(f"percentile_approx(hi, array({shares}), 10000) q").first()["q"] or [])):
        part = history.filter(F.col("hi") <= high)
        if before is not None:
            part = part.filter(F.col("hi") > before).withColumn("lo", F.when(F.col("lo") > before, F.col("lo")))
        target.run(records.filter(F.col("log_number") <= high), lambda df, part=part: take(settle(df, "pending"), part))
        before = high
    return target.read("edit_id long, seq long, version long, log_number long").select("edit_id", "seq")
