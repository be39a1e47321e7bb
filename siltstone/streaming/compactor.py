"""Consolidating far too many small files, each record exactly once."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import drop_path, scratch
from siltstone.sources.versions import VersionLog, query_id
from siltstone.streaming.upserts import file_stream, stream_in_rounds

#: A file is small below this size.
SMALL = 16_384
#: Size that consolidated files aim at, in bytes of records.
TARGET_BYTES = 128 * 1024 * 1024


def small_files(plans: DataFrame, file_meta: DataFrame, edits: DataFrame, small: int = SMALL) -> DataFrame:
    """``number`` of each file to consolidate: small, live, known, and in some plan's ``base``.

    A file's size is its largest non-null ``file_size`` in the metadata (0 if all
    are null); the sizes in the plans don't count. A file is live if no committed
    edit deletes its number. Null lists and elements name nothing.
    """
    planned = plans.select(F.explode("base.number").alias("number")).filter("number is not null").distinct()
    sizes = file_meta.filter("number is not null").groupBy("number").agg(F.coalesce(F.max("file_size"), F.lit(0)).alias("size"))
    dead = edits.filter("state = 'committed'").select(F.explode("delete_files.number").alias("number")).filter("number is not null").distinct()
    return sizes.filter(F.col("size") < small).join(planned, "number", "left_semi").join(dead, "number", "left_anti").select("number")


class Consolidated:
    """Consolidated files, batch by batch; each version names the batches that are whole.

    ``identity`` are the columns that make two rows one record, nulls equal;
    ``order`` those the files are sorted by and cut along, the first of ``order``
    being one of ``identity``.
    """

    def __init__(self, spark: SparkSession, path: str, identity: list[str], order: list[str], target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.identity, self.order, self.target_bytes = spark, path.rstrip("/"), identity, order, target_bytes
        self.versions = VersionLog(spark, f"{self.path}/versions")

    def _earlier(self, batches: dict, schema, low: bytes | str | int | None, high: bytes | str | int | None, nulls: int) -> DataFrame | None:
        """Identities in the batches that share a part of the range with a new one; None if there are none.

        Within a batch the files are cut along the first column of ``order``, so
        the pushed bounds leave only the files that overlap.
        """
        first = self.order[0]
        shares = lambda b: low is not None and b["low"] is not None and _bound(b["low"]) <= high and _bound(b["high"]) >= low
        met = [b for b in batches.values() if b["rows"] and (shares(b) or nulls and b["nulls"])]
        if not met:
            return None
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{b['folder']}" for b in met]).select(*self.identity)
        inside = F.col(first).isNull()
        return rows.filter(inside | (F.col(first) >= F.lit(low)) & (F.col(first) <= F.lit(high))) if low is not None else rows.filter(inside)

    def add(self, rows: DataFrame, query: str, number: int) -> bool:
        """Consolidate batch ``number`` of a stream once; False if it was before.

        The rows are copied together first, so that the tiny files are read a
        single time. Rows that repeat a record of the batch fall into the same
        range and are dropped there; those that repeat one of an earlier batch are
        anti-joined with the earlier files whose ranges overlap. So the only state
        is which files were read. The folder follows from query and number: a
        retry replaces it.
        """
        base = self.versions.current()
        state = self.versions.read(base)
        if state.get("query", query) != query:
            raise ValueError(f"{self.path} is fed by query {state['query']}, not by {query}: its checkpoint was lost or replaced")
        batches = {k[6:]: v for k, v in state.items() if k.startswith("batch-")}
        if str(number) in batches:
            return False
        schema, first = rows.schema, self.order[0]
        staged_at, folder = f"{self.path}/staged/{query}-{number}", f"batch={number}-{query}"
        rows.write.mode("overwrite").parquet(staged_at)
        staged = self.spark.read.schema(schema).parquet(staged_at)
        lengths = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) if f.dataType.typeName() in ("binary", "string") else F.lit(8) for f in schema]
        n, known, held, low, high = staged.agg(F.count("*"), F.count(first), F.sum(sum(lengths[1:], lengths[0]).cast("long")), F.min(first), F.max(first)).first()
        if n:
            earlier = self._earlier(batches, schema, low, high, n - known)
            if earlier is not None:
                same = F.lit(True)
                for c in self.identity:
                    same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))
                staged = staged.alias("n").join(earlier.alias("e"), same, "left_anti")
            by = [*self.order, *[c for c in self.identity if c not in self.order]]
            (
                staged.repartitionByRange(max(1, -(-held // self.target_bytes)), *by)
                .dropDuplicates(self.identity)  # equal records are in one range, so nothing moves again
                .sortWithinPartitions(*by)
                .write.mode("overwrite")
                .parquet(f"{self.path}/data/{folder}")
            )
        self.versions.publish(base, {"query": query, f"batch-{number}": {"folder": folder, "rows": n, "nulls": n - known, "low": _coded(low), "high": _coded(high)}})
        drop_path(self.spark, staged_at)
        return True

    def read(self, schema) -> DataFrame:
        folders = [v["folder"] for k, v in self.versions.read().items() if k.startswith("batch-") and v["rows"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{x}" for x in folders])


def _coded(bound):
    """A bound as JSON: bytes in base 64, with their kind."""
    if bound is None:
        return None
    return {"bytes": base64.b64encode(bytes(bound)).decode()} if isinstance(bound, (bytes, bytearray)) else {"plain": bound}


def _bound(coded: dict):
    return base64.b64decode(coded["bytes"]) if "bytes" in coded else coded["plain"]


def compact_stream(records: DataFrame, out: Consolidated, checkpoint: str) -> None:
    """Consolidate the streaming ``records``: the source lists each file in its log once, what is there is processed in micro-batches."""
    spark = records.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        out.add(batch, query_id(spark, checkpoint), number)

    records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def compact_directory(spark: SparkSession, path: str, identity: list[str], order: list[str], out: str, checkpoint: str, files_per_batch: int = 10_000, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Consolidate a directory of tiny Parquet files; run again to take new ones.

    Rows with the same ``identity`` are one record; nulls in it are equal. An
    empty directory of a known schema gives an empty table.
    """
    stream = file_stream(spark, path, files_per_batch)
    target = Consolidated(spark, out, identity, order, target_bytes)
    compact_stream(stream, target, checkpoint)
    return target.read(stream.schema)


def consolidate(spark: SparkSession, entry_path: str, chosen: DataFrame, rounds: int = 3, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``key, seq, op`` of the records of the chosen files, from the consolidated files.

    ``chosen``: ``number`` of the files, fixed for the run. Records are streamed
    from the table of entries in ``rounds`` micro-batches; one that several chosen
    files hold stays once. A row without a ``seq`` is no record; null keys are
    records, equal to each other.
    """
    at = scratch(spark, "compactor")
    chosen.write.parquet(f"{at}/chosen")
    fixed = spark.read.schema("number long").parquet(f"{at}/chosen")
    records = stream_in_rounds(spark, entry_path, rounds).filter("seq is not null").join(fixed, "number", "left_semi").select("key", "seq", "op")
    out = Consolidated(spark, f"{at}/out", ["key", "seq", "op"], ["key", "seq"], target_bytes)
    compact_stream(records, out, f"{at}/checkpoint")
    return out.read(records.schema)
