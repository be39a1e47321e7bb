"""The manifest: edits that add and delete files, replayed to what is live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def committed(edits: DataFrame) -> DataFrame:
    return edits.filter("state = 'committed'")


def live_files(edits: DataFrame) -> DataFrame:
    """``number, level`` of the files that committed edits add and none deletes.

    Deletes count by number alone, whatever level they name and wherever in the
    order they stand. A file added at several levels counts at the highest.
    """
    done = committed(edits)
    added = done.select(F.explode("add_files").alias("f")).select("f.number", "f.level").filter("number is not null")
    gone = done.select(F.explode("delete_files").alias("f")).select("f.number").filter("number is not null").distinct()
    return added.groupBy("number").agg(F.max("level").alias("level")).join(gone, "number", "left_anti")


def build_version(files: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """A version after one edit: ``level, number`` of the files, plus adds, minus deletes by both."""
    both = ["level", "number"]
    return files.select(*both).unionByName(adds.select(*both)).distinct().join(deletes.select(*both).distinct(), both, "left_anti")


def counters(edits: DataFrame) -> DataFrame:
    """One row: the highest log, next file and last sequence number of committed edits; null without any."""
    return committed(edits).agg(*[F.max(c).alias(c) for c in ("log_number", "next_file_number", "last_seq_number")])


def file_table(file_meta: DataFrame) -> DataFrame:
    """One row a file: repeats merged, the largest non-null size (0 if none), all value logs."""
    return (
        file_meta.filter("number is not null")
        .groupBy("number")
        .agg(
            F.max("level").alias("level"), F.coalesce(F.max("file_size"), F.lit(0)).cast("long").alias("file_size"),
            F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.max("vlogs").alias("vlogs"),
        )
    )


def live_table(file_meta: DataFrame, edits: DataFrame) -> DataFrame:
    """Metadata of the live files, at the level that the manifest gives."""
    return file_table(file_meta).drop("level").join(live_files(edits), "number")


def unreferenced_vlogs(vlogs: DataFrame, live: DataFrame) -> DataFrame:
    """``vlog_id`` of the value logs that no live file names: they may be deleted."""
    used = live.select(F.explode("vlogs").alias("vlog_id")).filter("vlog_id is not null").distinct()
    return vlogs.filter("vlog_id is not null").select("vlog_id").distinct().join(used, "vlog_id", "left_anti")


def unreferenced_files(file_meta: DataFrame, live: DataFrame) -> DataFrame:
    """``number`` of the known files that are not live."""
    return file_meta.filter("number is not null").select("number").distinct().join(live.select("number"), "number", "left_anti")


def gc_candidate(live: DataFrame) -> DataFrame:
    """The file with the most value logs, if it has two or more; of equals the smallest number."""
    sized = live.select("number", F.size(F.array_compact(F.coalesce("vlogs", F.array().cast("array<long>")))).alias("n_vlogs"))
    return sized.filter("n_vlogs >= 2").orderBy(F.desc("n_vlogs"), "number").limit(1)
