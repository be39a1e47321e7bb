"""Queries of the data-pipeline problems of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import incremental, orphans
from siltstone.session import scratch, settle
from siltstone.streaming import compactor, upserts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to value logs and files that are missing, deleted or late."""
    refs, targets = orphans.store_references(*(table(spark, sf_dir, x) for x in ("file_meta", "version_edit", "vlog_file")))
    return orphans.find_orphans(settle(refs, "references"), settle(targets, "targets"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their number for each kind, reason and day."""
    return orphans.orphans_by_period(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live keys with the sequence number of their current value."""
    rows = upserts.rebuild(spark, f"{sf_dir}/wal_entry.parquet", f"{sf_dir}/write_batch.parquet")
    return upserts.live_rows(rows).select(F.hex("key").alias("key_hex"), "seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that small live planned files hold, from the consolidated files."""
    chosen = compactor.small_files(*(table(spark, sf_dir, x) for x in ("compaction_state", "file_meta", "version_edit")))
    return compactor.consolidate(spark, f"{sf_dir}/sst_entry.parquet", chosen).select("seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that each successful run had to process."""
    return incremental.replay_runs(spark, scratch(spark, "incremental"), table(spark, sf_dir, "wal_entry"), table(spark, sf_dir, "version_edit"))


P1 = """
WITH committed AS (SELECT * FROM version_edit WHERE state = 'committed'),
refs AS (
  SELECT DISTINCT 'file_meta.vlogs' AS ref_kind, number AS src_id, u.x AS ref_id, created_at AS moment
  FROM file_meta, unnest(vlogs) AS u(x) WHERE u.x IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'version_edit.delete_vlogs', edit_id, u.x, edit_ts FROM committed, unnest(delete_vlogs) AS u(x) WHERE u.x IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'version_edit.delete_files', edit_id, u.x.number, edit_ts FROM committed, unnest(delete_files) AS u(x) WHERE u.x.number IS NOT NULL),
v AS (SELECT vlog_id, min(created_at) AS created_at, min(deleted_at) AS deleted_at FROM vlog_file GROUP BY vlog_id),
d AS (SELECT u.x.number AS number, min(edit_id) AS first_edit FROM committed, unnest(delete_files) AS u(x) GROUP BY 1),
f AS (SELECT m.number, min(created_at) AS created_at, min(first_edit) AS first_edit FROM file_meta m LEFT JOIN d ON d.number = m.number GROUP BY 1),
judged AS (
  SELECT r.*, CASE
    WHEN r.ref_kind <> 'version_edit.delete_files' AND v.vlog_id IS NULL THEN 'missing'
    WHEN r.ref_kind = 'version_edit.delete_files' AND f.number IS NULL THEN 'missing'
    WHEN r.ref_kind = 'file_meta.vlogs' AND v.deleted_at <= r.moment THEN 'deleted'
    WHEN r.ref_kind = 'version_edit.delete_vlogs' AND v.deleted_at < r.moment THEN 'deleted'
    WHEN r.ref_kind = 'version_edit.delete_files' AND f.first_edit < r.src_id THEN 'deleted'
    WHEN r.ref_kind <> 'version_edit.delete_files' AND v.created_at > r.moment THEN 'late'
    WHEN r.ref_kind = 'version_edit.delete_files' AND f.created_at > r.moment THEN 'late' END AS reason
  FROM refs r
  LEFT JOIN v ON r.ref_kind <> 'version_edit.delete_files' AND v.vlog_id = r.ref_id
  LEFT JOIN f ON r.ref_kind = 'version_edit.delete_files' AND f.number = r.ref_id),
found AS (SELECT DISTINCT ref_kind, src_id, ref_id, reason, strftime(moment, '%Y-%m-%d') AS period FROM judged WHERE reason IS NOT NULL)
"""

SQL = {
    "p1_found": P1 + "SELECT * FROM found",
    "p1_counts": P1 + "SELECT ref_kind, reason, period, count(*) AS n_refs FROM found GROUP BY ALL",
    "p2_found": """
WITH whole AS (SELECT base_seq, data, unnest(range(len(data))) AS i FROM write_batch WHERE len(data) = n_ops),
c AS (SELECT key, seq, op FROM wal_entry UNION ALL SELECT data[i + 1].key, base_seq + i, data[i + 1].op FROM whole),
n AS (SELECT key, seq, op, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS rn FROM c WHERE key IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL)
SELECT hex(key) AS key_hex, seq FROM n WHERE rn = 1 AND op = 1""",
    "p4_found": """
WITH s AS (SELECT number, coalesce(max(file_size), 0) AS size FROM file_meta GROUP BY number),
b AS (SELECT DISTINCT u.x.number AS number FROM compaction_state, unnest(base) AS u(x)),
d AS (SELECT u.x.number AS number FROM version_edit, unnest(delete_files) AS u(x) WHERE state = 'committed' AND u.x.number IS NOT NULL)
SELECT DISTINCT seq FROM sst_entry WHERE number IN (SELECT number FROM s WHERE size < 16384)
  AND number IN (SELECT number FROM b WHERE number IS NOT NULL) AND number NOT IN (SELECT number FROM d)""",
    "p5_found": """
WITH e AS (SELECT edit_id, max(log_number) AS log_number FROM version_edit WHERE state = 'committed' GROUP BY edit_id),
h AS (SELECT edit_id, max(log_number) OVER (ORDER BY edit_id) AS hi FROM e),
f AS (SELECT min(edit_id) AS edit_id, hi FROM h WHERE hi IS NOT NULL GROUP BY hi),
r AS (SELECT seq, min(log_number) AS log FROM wal_entry WHERE log_number IS NOT NULL GROUP BY seq)
SELECT f.edit_id, r.seq FROM r ASOF JOIN f ON r.log <= f.hi""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p4_found, p5_found)}
