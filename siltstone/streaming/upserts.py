"""Applying a stream of inserts, updates and deletes to rebuild a table."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.model import PUT
from siltstone.session import scratch, settings
from siltstone.sources.versions import VersionLog, query_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TABLE = "key binary, seq long, op int, value binary"
#: Files that a micro-batch takes at most.
MOST_FILES = 100_000
#: Batches of upserts that a table gathers before they are folded into one.
FOLD = 8


def entry_changes(log: DataFrame) -> DataFrame:
    """Changes of single logged entries; rows without key, seq or op are no changes.

    A delete's value is dropped; an empty value of a put stays one.
    """
    return log.select(
        F.col("key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), F.when(F.col("op") == PUT, F.col("value")).alias("value")
    ).filter("key is not null and seq is not null and op is not null")


def batch_changes(batches: DataFrame) -> DataFrame:
    """Changes of whole batches: entry i of ``data`` has the number ``base_seq + i``.

    A batch whose list is null or has another length than ``n_ops`` was cut short
    and gives nothing.
    """
    whole = batches.filter("data is not null and base_seq is not null and size(data) = n_ops")
    return entry_changes(
        whole.select("base_seq", F.posexplode("data").alias("_i", "_e")).select(
            F.col("_e.key").alias("key"), (F.col("base_seq") + F.col("_i")).alias("seq"), F.col("_e.op").alias("op"), F.col("_e.value").alias("value")
        )
    )


@F.pandas_udf(T.LongType())
def _micro_batch(rows: pd.Series) -> pd.Series:
    """The number of the micro-batch that reads these rows; a retry has the same."""
    return pd.Series(int(TaskContext.get().getLocalProperty("streaming.sql.batchId") or 0), index=rows.index)


def accepted(changes: DataFrame) -> DataFrame:
    """``key, seq, op, value`` of the keys that a micro-batch of the stream ``changes`` brought something newer for.

    The keyed state stores payload, last sequence number and tombstone, and the
    micro-batch that brought them. Only a change of higher ``seq`` replaces it, so
    of repeated and late changes nothing comes out: a key is emitted if its state
    dates from the micro-batch that touches it. Partial aggregation before the
    shuffle sends one row a key and task, so a hot key is no burden. Two different
    changes of one key and ``seq`` are not meant; then a put wins over a delete,
    and the larger value.
    """
    marked = changes.withColumn("at", _micro_batch("op"))
    last = F.max(F.struct("seq", "op", "value", (-F.col("at")).alias("since"))).alias("last")
    state = marked.groupBy("key").agg(last, F.max("at").alias("touched"))
    return state.filter(-F.col("last.since") == F.col("touched")).select("key", "last.seq", "last.op", "last.value")


def newest(upserts: DataFrame) -> DataFrame:
    """``key, seq, op, value`` of the newest upsert of each key, tombstones included."""
    return upserts.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("last")).select("key", "last.*")


class UpsertTable:
    """A keyed table that upserts are applied to, each version published by one rename.

    A version names a base, which has each key once, and the batches of upserts
    since. Both are laid out by hash of the key, as the state is, so a batch is
    written without a shuffle. After ``FOLD`` batches, and when asked, all is
    folded into a new base, which is then read as it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = VersionLog(spark, f"{self.path}/versions")

    def upsert(self, rows: DataFrame, query: str, number: int) -> bool:
        """Apply batch ``number`` of a stream once; False if it was applied before.

        A retry of a batch that was not published overwrites its folder. A batch
        of another query than the one before is refused: its numbers begin anew,
        so they say nothing of what has been applied.
        """
        base = self.versions.current()
        state = self.versions.read(base)
        if state.get("query", query) != query:
            raise ValueError(f"{self.path} is fed by query {state['query']}, not by {query}: its checkpoint was lost or replaced")
        if number <= state.get("batch", -1):
            rows.write.format("noop").mode("overwrite").save()  # the stream's own state has to be committed all the same
            return False
        folder = f"batch={number}-{query}"
        rows.select("key", "seq", "op", "value").write.mode("overwrite").parquet(f"{self.path}/data/{folder}")
        self.versions.publish(base, {"query": query, "batch": number, "deltas": [*state.get("deltas", []), folder]})
        if len(state.get("deltas", [])) + 1 >= FOLD:
            self.fold()
        return True

    def _folders(self, state: dict) -> list[str]:
        return [f"{self.path}/data/{x}" for x in ([state["base"]] if state.get("base") else []) + state.get("deltas", [])]

    def fold(self) -> None:
        """Make base and batches one base; nothing to do if the table is a single folder."""
        base = self.versions.current()
        state = self.versions.read(base)
        folders = self._folders(state)
        if len(folders) > 1:
            folder = f"base={base}"
            newest(self.spark.read.schema(TABLE).parquet(*folders)).write.mode("overwrite").parquet(f"{self.path}/data/{folder}")
            self.versions.publish(base, {"base": folder, "deltas": []})

    def read(self) -> DataFrame:
        """``key, seq, op, value`` of each key, tombstones included."""
        folders = self._folders(self.versions.read())
        if not folders:
            return self.spark.createDataFrame([], TABLE)
        rows = self.spark.read.schema(TABLE).parquet(*folders)
        return rows if len(folders) == 1 else newest(rows)


def apply_changes(changes: DataFrame, table: UpsertTable, checkpoint: str) -> None:
    """Run the streaming ``changes`` to the end of what is there and apply them to the table.

    Progress and state are in ``checkpoint``; a later call with the same paths
    goes on from there. State is held by RocksDB, so it need not fit in memory.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, query_id(spark, checkpoint), number)

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        query = accepted(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def live_rows(table: DataFrame) -> DataFrame:
    """``key, seq, value`` of the keys that are not deleted."""
    return table.filter(F.col("op") == PUT).select("key", "seq", "value")


def file_stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The Parquet files of a table, a directory or a single file, as a stream."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # the file source takes a single file only as a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_in_rounds(spark: SparkSession, path: str, rounds: int) -> DataFrame:
    """A table as a stream of about ``rounds`` micro-batches, or of more if each would take too many files.

    A table of fewer files than that is written out as so many first.
    """
    files = len(spark.read.parquet(path).inputFiles())
    if files < rounds:
        split = scratch(spark, "split")
        spark.read.parquet(path).repartition(rounds).write.parquet(split)
        path, files = split, rounds
    return file_stream(spark, path, min(MOST_FILES, -(-files // rounds)))


def rebuild(spark: SparkSession, log_path: str, batch_path: str, rounds: int = 3) -> DataFrame:
    """The current table from the log and the wire batches, both read as streams in ``rounds`` micro-batches."""
    changes = entry_changes(stream_in_rounds(spark, log_path, rounds)).unionByName(batch_changes(stream_in_rounds(spark, batch_path, rounds)))
    at = scratch(spark, "upserts")
    table = UpsertTable(spark, f"{at}/table")
    apply_changes(changes, table, f"{at}/checkpoint")
    table.fold()
    return table.read()
