"""References to records that do not exist, were deleted, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.skew import skew_join

REFERENCE = ["ref_kind", "target", "src_id", "ref_id", "at", "deleted_before", "src_order"]


def references(df: DataFrame, kind: str, target: str, src_id: str, refs: str, at: str, inclusive: bool) -> DataFrame:
    """One row for each distinct non-null element of the list column ``refs``.

    ``refs`` is an expression of type ARRAY<BIGINT>; null lists and null elements
    give no row. ``inclusive``: a target deleted at the very time counts as gone.
    """
    picked = df.select(
        F.col(src_id).cast("long").alias("src_id"),
        F.explode(F.expr(f"cast({refs} as array<bigint>)")).alias("ref_id"),
        F.col(at).alias("at"),
    )
    return (
        picked.filter("ref_id is not null")
        .select(F.lit(kind).alias("ref_kind"), F.lit(target).alias("target"), "src_id", "ref_id", "at", F.lit(inclusive).alias("inclusive"))
        .distinct()
    )


def parents(df: DataFrame, target: str, key: str, created: str, deleted: str | None = None) -> DataFrame:
    """One row a target key: repeated rows are merged, the earliest times count."""
    gone = F.min(deleted) if deleted else F.lit(None).cast(df.schema[created].dataType)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("ref_id"))
        .agg(F.min(created).alias("created_at"), gone.alias("deleted_at"))
        .select(F.lit(target).alias("target"), "ref_id", "created_at", "deleted_at", F.lit(None).cast("long").alias("deleted_by"))
    )


def find_orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each reference whose target is missing, deleted or late, with the reason.

    ``refs``: columns of :func:`references`. ``targets``: ``target, ref_id,
    created_at, deleted_at, deleted_by`` (one row a key); ``deleted_by`` is the
    id of the earliest source that removed the target, for sources that are
    ordered by ``src_id`` rather than by time.

    The distinct foreign keys are anti-joined with the parent keys, and the keys
    that are left joined back to their references. A key that many references
    name is spread over several partitions. Unknown times compare as false, so
    such a reference is a case only if its target is missing; its period is null.
    Empty inputs give an empty result (no targets: every reference is missing).
    """
    keys = ["target", "ref_id"]
    lost = refs.select(*keys).distinct().join(targets.select(*keys), keys, "left_anti")
    missing = skew_join(refs, lost, keys, ["src_id"], "left_semi").withColumn("reason", F.lit("missing"))
    gone = (
        F.when(F.col("inclusive"), F.col("deleted_at") <= F.col("at")).otherwise(F.col("deleted_at") < F.col("at"))
        | (F.col("deleted_by") < F.col("src_id"))
    )
    present = skew_join(refs, targets, keys, ["src_id"]).withColumn(
        "reason", F.when(gone, "deleted").when(F.col("created_at") > F.col("at"), "late")
    )
    out = ["ref_kind", "src_id", "ref_id", "reason", "at"]
    cases = missing.select(*out).unionByName(present.filter("reason is not null").select(*out))
    return cases.select("ref_kind", "src_id", "ref_id", "reason", F.date_format("at", "yyyy-MM-dd").alias("period")).distinct()


def store_references(file_meta: DataFrame, version_edit: DataFrame, vlog_file: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references and targets of a store's files, value logs and manifest edits."""
    committed = version_edit.filter("state = 'committed'")
    refs = (
        references(file_meta, "file_meta.vlogs", "vlog", "number", "vlogs", "created_at", True)
        .unionByName(references(committed, "version_edit.delete_vlogs", "vlog", "edit_id", "delete_vlogs", "edit_ts", False))
        .unionByName(references(committed, "version_edit.delete_files", "file", "edit_id", "transform(delete_files, x -> x.number)", "edit_ts", False))
    )
    removed = (
        committed.select("edit_id", F.explode("delete_files.number").alias("ref_id"))
        .groupBy("ref_id")
        .agg(F.min("edit_id").alias("removed_by"))
    )
    files = parents(file_meta, "file", "number", "created_at").join(removed, "ref_id", "left")
    files = files.select("target", "ref_id", "created_at", "deleted_at", F.col("removed_by").alias("deleted_by"))
    return refs, parents(vlog_file, "vlog", "vlog_id", "created_at", "deleted_at").unionByName(files)


def orphans_by_period(cases: DataFrame) -> DataFrame:
    """Number of orphan references for each kind, reason and day."""
    return cases.groupBy("ref_kind", "reason", "period").agg(F.count("*").alias("n_refs"))
