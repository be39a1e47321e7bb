"""Queries of the store's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import codec
from siltstone.model import DELETE, PUT, Options, be_bytes, changelog, events_changelog
from siltstone.operators import bloom, manifest, policy, read, runs, valuelog, write
from siltstone.session import scratch, settle
from siltstone.sources import sst
from siltstone.store import Store

#: Events of one run, and the runs that are written and merged.
RUN, MERGED = 1000, 4
#: The key of the point queries.
KEY = 42
THRESHOLD = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_changelog(table(spark, sf_dir, "events"))


def half_way(spark: SparkSession, sf_dir: str) -> int:
    """The reader's sequence number in the as-of queries: half of the largest."""
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 2


def written_run(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A changelog written as a sorted run and read back."""
    path = scratch(spark, "run")
    runs.write_run(rows, path)
    return runs.read_run(spark, path)


def runs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumn("file_no", F.floor(F.col("seq") / RUN).cast("long"))


def asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(be_bytes(F.col("c_custkey"), 4).alias("key"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(manifest.live_table(table(spark, sf_dir, "file_meta"), table(spark, sf_dir, "version_edit")), "live")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Keys as hex, values as text."""
    key, value = F.hex("key").alias("key_hex"), F.col("value").cast("string").alias("value")
    return df.select(*[{"key_hex": key, "value": value}.get(c, F.col(c)) for c in columns])


def get_point(spark, sf_dir):
    """Latest value of one key of a written run; the key reaches the scan."""
    return read.get(written_run(spark, log(spark, sf_dir)), KEY.to_bytes(4, "big")).select(F.col("value").cast("string").alias("value"))


def multi_get(spark, sf_dir):
    """Latest values of all customers' keys."""
    return shown(read.multi_get(log(spark, sf_dir), asked_keys(spark, sf_dir)), "key_hex", "found", "seq", "value")


def snapshot_latest(spark, sf_dir):
    """The live version of every key."""
    return shown(read.snapshot(log(spark, sf_dir)), "key_hex", "seq", "value")


def get_as_of(spark, sf_dir):
    """The snapshot half-way through the log."""
    return shown(read.as_of(log(spark, sf_dir), half_way(spark, sf_dir)), "key_hex", "seq", "value")


def tombstoned_keys(spark, sf_dir):
    """Keys whose newest version is a delete."""
    return shown(read.tombstones(log(spark, sf_dir)), "key_hex", "seq")


def write_batch_seq(spark, sf_dir):
    """Sequence numbers for one batch a user, in the order of the events."""
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("pos"))
    return write.number_batches(ops, 1000)


def version_history(spark, sf_dir):
    """All versions of all keys, ranked."""
    return shown(read.history(log(spark, sf_dir)), "key_hex", "seq", "op", "version")


def merge_runs(spark, sf_dir):
    """Written runs merged in store order, with the global position."""
    rows = log(spark, sf_dir)
    parts = [written_run(spark, rows.filter(F.floor(F.col("seq") / RUN) % MERGED == n)) for n in range(MERGED)]
    return shown(runs.merge_positions(parts).withColumn("file_no", F.floor(F.col("seq") / RUN).cast("long")), "position", "key_hex", "seq", "file_no")


def compact_bottom(spark, sf_dir):
    """The lowest level after compaction."""
    return shown(runs.compact_bottom(log(spark, sf_dir)), "key_hex", "seq", "value")


def compact_retain(spark, sf_dir):
    """Compaction that keeps what a reader at a snapshot needs."""
    return shown(runs.compact(log(spark, sf_dir), half_way(spark, sf_dir)), "key_hex", "seq", "op")


def compact_exact_dup(spark, sf_dir):
    """Exact repeats dropped below a sequence number, all else kept."""
    twice = log(spark, sf_dir)
    return shown(runs.drop_exact_repeats(twice.unionByName(twice), half_way(spark, sf_dir)), "key_hex", "seq", "op")


def run_metadata(spark, sf_dir):
    """Entries, bytes and bounds of each run."""
    meta = runs.metadata(runs_log(spark, sf_dir))
    return meta.select("file_no", "n_entries", "file_size", F.hex("smallest").alias("smallest"), F.hex("largest").alias("largest"))


def zone_prune(spark, sf_dir):
    """Live files whose key range covers a key."""
    return runs.zone_prune(live(spark, sf_dir), be_bytes(F.lit(KEY), 4)).select("number")


def run_overlaps(spark, sf_dir):
    """Number of live files that overlap each live file."""
    return runs.overlaps(live(spark, sf_dir), "number")


def l0_overlap_groups(spark, sf_dir):
    """Live files of level 0 that a chain of overlaps connects."""
    return runs.overlap_groups(live(spark, sf_dir).filter("level = 0"), "number")


def major_inputs(spark, sf_dir):
    """The files that the fullest level's compaction takes, and those of the next level that they overlap."""
    return policy.inputs(live(spark, sf_dir))


def seek_inputs(spark, sf_dir):
    """The files that a compaction takes which the first live file of level 1 asks for."""
    files = live(spark, sf_dir)
    seed = files.filter("level = 1").agg(F.min("number")).first()[0]
    return policy.inputs(files, -1 if seed is None else seed)


def vlog_inheritance(spark, sf_dir):
    """The value logs that the file of each compaction plan takes over from the files of its base."""
    plans = table(spark, sf_dir, "compaction_state").select("compaction_id", F.explode("base.number").alias("number")).distinct()
    held = table(spark, sf_dir, "file_meta").select("number", "vlogs")
    merged = valuelog.inherited(plans.join(held, "number"), ["compaction_id"])
    return merged.select("compaction_id", F.array_join(merged["vlogs"].cast("array<string>"), ",").alias("vlogs"))


def build_version(spark, sf_dir):
    """The files after the last committed edit, deletes matching by level and number."""
    done = manifest.committed(table(spark, sf_dir, "version_edit"))
    last = done.agg(F.max("edit_id")).first()[0]
    edits = settle(done.select("edit_id", "add_files", "delete_files"), "edits")
    files = lambda df, column: df.select(F.explode(column).alias("f")).select("f.level", "f.number").filter("level is not null and number is not null")
    earlier, newest = edits.filter(F.col("edit_id") < F.lit(last)), edits.filter(F.col("edit_id") == F.lit(last))
    before = manifest.build_version(files(earlier, "add_files"), files(earlier, "add_files").limit(0), files(earlier, "delete_files"))
    return manifest.build_version(before, files(newest, "add_files"), files(newest, "delete_files")).select("level", "number")


def dead_files(spark, sf_dir):
    """Known files that are not live."""
    return manifest.unreferenced_files(table(spark, sf_dir, "file_meta"), live(spark, sf_dir))


def event_ops(spark, sf_dir):
    """The events as operations on a store, one batch an event."""
    return log(spark, sf_dir).select(F.col("seq").alias("batch_id"), F.lit(0).alias("pos"), "key", "op", "value")


def open_store(spark, **options):
    return Store.open(spark, Options(work_dir=scratch(spark, "store")).with_options(mem_size=1 << 40, **options))


def store_get(spark, sf_dir):
    """Customers' keys in a store that was written in three parts, flushed and compacted in between."""
    ops, store = event_ops(spark, sf_dir), open_store(spark, kv_separate_threshold=16)
    cut = half_way(spark, sf_dir)
    store.write(ops.filter(F.col("batch_id") < cut // 2))
    store.flush()
    store.write(ops.filter((F.col("batch_id") >= cut // 2) & (F.col("batch_id") < cut)))
    store.flush()
    store.compact(full=True)
    store.write(ops.filter(F.col("batch_id") >= cut))
    return shown(store.multi_get(asked_keys(spark, sf_dir)), "key_hex", "found", "value")


def flush_placed(spark, sf_dir):
    """The levels that three flushes go to: the lower half of the keys' range, the upper, and all; a flush of nothing makes no run."""
    middle = (table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] or 0) // 2
    ops, store, low = event_ops(spark, sf_dir), open_store(spark), F.col("key") < F.lit(bytearray(middle.to_bytes(4, "big")))
    for part in (ops.filter(low), ops.filter(~low), ops):
        store.write(part)
        store.flush()
    return store.files().select("number", "level")


def vlog_rewrite(spark, sf_dir):
    """Documents of a store whose value logs were taken over by a compaction and then rewritten to one."""
    store = open_store(spark)
    docs = documents_log(spark, sf_dir).select(F.col("seq").alias("batch_id"), F.lit(0).alias("pos"), "key", "op", "value")
    for part in range(6):
        store.write(docs.filter(F.pmod("batch_id", F.lit(6)) == part))
        store.flush()
    store.compact()
    store.collect_garbage()
    store.purge()
    number = F.conv(F.hex("key"), 16, 10).cast("long")
    return store.snapshot().select(number.alias("doc_id"), F.octet_length("value").cast("long").alias("bytes"), F.md5("value").alias("digest"))


def compaction_score(spark, sf_dir):
    """Score of each level of the live files, and the one to compact."""
    return policy.level_scores(live(spark, sf_dir))


def flush_level(spark, sf_dir):
    """The level that each live file would be flushed to."""
    files = live(spark, sf_dir)
    return policy.flush_level(files, files)


def manifest_replay(spark, sf_dir):
    """The live files."""
    return manifest.live_files(table(spark, sf_dir, "version_edit"))


def manifest_counters(spark, sf_dir):
    """The counters after replay."""
    return manifest.counters(table(spark, sf_dir, "version_edit"))


def unreferenced_files(spark, sf_dir):
    """Value logs that no live file names."""
    return manifest.unreferenced_vlogs(table(spark, sf_dir, "vlog_file"), live(spark, sf_dir))


def gc_candidate(spark, sf_dir):
    """The live file with the most value logs."""
    return manifest.gc_candidate(live(spark, sf_dir))


def documents_log(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return changelog(docs, be_bytes(F.col("doc_id"), 8), F.col("doc_id"), F.lit(PUT), F.col("text").cast("binary"))


def value_split(spark, sf_dir):
    """Which document texts go to a value log."""
    value = F.col("value")
    return documents_log(spark, sf_dir).select(F.col("seq").alias("doc_id"), valuelog.is_large(value, THRESHOLD).alias("in_vlog"), F.octet_length(value).cast("long").alias("bytes"))


def vlog_offsets(spark, sf_dir):
    """The offset of each value in the value log of its run."""
    placed = valuelog.offsets(runs_log(spark, sf_dir), "file_no", [F.asc("seq")], F.col("value"))
    return placed.select("file_no", "seq", "vlog_off")


def vlog_deref(spark, sf_dir):
    """Documents split into entries and value logs, written, and read through the pointers."""
    path = scratch(spark, "vlogs")
    entries = valuelog.separate(documents_log(spark, sf_dir), path, 4, THRESHOLD)
    back = valuelog.resolve(settle(entries, "entries"), spark.read.parquet(path))
    return back.select(F.col("seq").alias("doc_id"), F.octet_length("value").cast("long").alias("bytes"), F.md5("value").alias("digest"))


def bloom_build(spark, sf_dir):
    """The set bits of each run's filter at 5 bits a key."""
    return bloom.build(runs_log(spark, sf_dir).select("file_no", "key"), ["file_no"], bloom.bits_per_key(0.1))


def bloom_probe(spark, sf_dir):
    """For each customer's key and the packed filter of all events: may it be there?"""
    bits = bloom.bits_per_key(0.1)
    keys = log(spark, sf_dir).select(F.lit(0).alias("f"), "key").distinct()
    packed = settle(bloom.pack(bloom.build(keys, ["f"], bits), ["f"], bits), "filter")
    asked = codec.with_bloom_hash(asked_keys(spark, sf_dir).distinct(), "key", "h", 4).withColumn("f", F.lit(0)).join(packed, "f")  # one filter
    return asked.select(F.hex("key").alias("key_hex"), bloom.may_contain(F.col("filters"), F.col("h"), bloom.probes(bits)).alias("maybe"))


def bloom_stored(spark, sf_dir):
    """Keys of each file that its stored filter denies."""
    return bloom.check_stored(table(spark, sf_dir, "bloom_filter"), table(spark, sf_dir, "sst_entry"))


def varint_codec(spark, sf_dir):
    """Varints of numbers up to the square of the event id."""
    n = table(spark, sf_dir, "events").select((F.col("event_id") * F.col("event_id") % 4294967296).alias("n"))
    return n.select("n", codec.varint_length("n").cast("long").alias("n_bytes"), F.hex(codec.varint_encode("n")).alias("encoded"), codec.varint_decode(codec.varint_encode("n")).alias("decoded"))


def internal_key(spark, sf_dir):
    """Internal keys made and taken apart."""
    ik = log(spark, sf_dir).select(codec.internal_key("key", "seq", "op").alias("ik"))
    return ik.select(F.hex("ik").alias("ik_hex"), F.hex(codec.user_key("ik")).alias("key_hex"), codec.key_seq("ik").alias("seq"), codec.key_op("ik").alias("op"))


def file_meta_keys(spark, sf_dir):
    """Bounds of the stored files, taken apart, and their names."""
    f = manifest.file_table(table(spark, sf_dir, "file_meta"))
    return f.select("number", codec.file_name("number", "sst").alias("name"), F.hex(codec.user_key("smallest")).alias("low_hex"), codec.key_seq("smallest").alias("low_seq"), F.hex(codec.user_key("largest")).alias("high_hex"), codec.key_op("largest").alias("high_op"))


def block_assign(spark, sf_dir):
    """The block of each entry of the merged run."""
    return shown(runs.blocks(log(spark, sf_dir)), "key_hex", "seq", "block")


def block_cut(spark, sf_dir):
    """The block of each entry of each run's file, with values of any width."""
    cut = runs.cut_blocks(runs_log(spark, sf_dir))
    return cut.select("file_no", F.hex("key").alias("key_hex"), "seq", "block")


def sst_roundtrip(spark, sf_dir):
    """Runs as files of the store's binary format, and read from it again."""
    files = settle(sst.encoded(runs_log(spark, sf_dir), "file_no"), "sst")
    return shown(sst.decoded(files).withColumnRenamed("value_inline", "value"), "number", "key_hex", "seq", "op", "value")


def block_handles(spark, sf_dir):
    """Offset and size of blocks of the merged run, made and taken apart."""
    n = runs.blocks(log(spark, sf_dir)).groupBy("block").agg(F.count("*").alias("n")).select((F.col("block") * 4096).alias("offset"), (F.col("n") * 23 + 4).alias("size"))
    h = n.withColumn("handle", codec.block_handle("offset", "size"))
    return h.select(F.hex("handle").alias("handle"), codec.handle_offset("handle").alias("offset"), codec.handle_size("handle").alias("size"))


def logged_values(spark, sf_dir):
    """Values as they are logged: length and bytes, with the checksum and whether it holds."""
    wrapped = log(spark, sf_dir).filter("value is not null").select("seq", codec.value_wrap("value").alias("w"))
    crc = wrapped.select("seq", F.octet_length("w").cast("long").alias("bytes"), codec.varint_decode("w").alias("length"), "w", codec.checksum("w").alias("crc"))
    return crc.select("seq", "bytes", "length", codec.checksum_ok("w", "crc").alias("ok"), codec.checksum_ok("w", F.col("crc") + 1).alias("wrong"))


def number_bytes(spark, sf_dir):
    """Numbers as eight bytes, and lists of numbers as four bytes each."""
    rows = log(spark, sf_dir).select("seq", F.conv(F.hex("key"), 16, 10).cast("long").alias("user"))
    return rows.select("seq", F.hex(codec.u64_bytes("seq")).alias("u64"), F.hex(codec.u32_list_bytes(F.array("seq", "user"))).alias("u32_list"))


def block_index(spark, sf_dir):
    """The last internal key of each block."""
    return runs.block_index(runs.blocks(log(spark, sf_dir))).select("block", F.hex("last_key").alias("last_key"))


def index_seek(spark, sf_dir):
    """The block to search for each customer's key."""
    index = settle(runs.block_index(runs.blocks(log(spark, sf_dir))), "index")
    return runs.index_seek(index, asked_keys(spark, sf_dir)).select(F.hex("key").alias("key_hex"), "block")


def wal_replay(spark, sf_dir):
    """Newest changes of the logs after the flushed ones, half of those the manifest covers."""
    top = manifest.counters(table(spark, sf_dir, "version_edit")).first()["log_number"]
    rows = table(spark, sf_dir, "wal_entry").filter(F.col("log_number") > (top // 2 if top is not None else -1))
    return shown(read.newest(changelog(rows, F.col("key"), F.col("seq"), F.col("op"), F.col("value"))), "key_hex", "seq", "op")


def wal_snapshot(spark, sf_dir):
    """Live keys of the log alone."""
    rows = table(spark, sf_dir, "wal_entry")
    return shown(read.snapshot(changelog(rows, F.col("key"), F.col("seq"), F.col("op"), F.col("value"))), "key_hex", "seq")


def seek_miss(spark, sf_dir):
    """Fruitless look-ups of the customers' keys in each run."""
    return runs.seek_misses(settle(runs_log(spark, sf_dir), "runs"), asked_keys(spark, sf_dir))


def _layers(top: str) -> str:
    """The layer of a version by its place in the log: a tenth in memory, a tenth on its way, three tenths at level 0."""
    return f"CASE WHEN seq >= {top} * 9 DIV 10 THEN 'mem' WHEN seq >= {top} * 8 DIV 10 THEN 'imm' WHEN seq >= {top} * 5 DIV 10 THEN 'L0' ELSE 'L1' END"


def lookup_layer(spark, sf_dir):
    """The layer that answers each customer's key."""
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    found = read.lookup_layer(log(spark, sf_dir).withColumn("layer", F.expr(_layers(f"{top}L"))), asked_keys(spark, sf_dir))
    return shown(found, "key_hex", "layer", "seq", "op")


def memory_use(spark, sf_dir):
    """Bytes of keys and values that a flush would wait for."""
    return write.memory_use(log(spark, sf_dir))


def record_crc(spark, sf_dir):
    """Checksum of each value."""
    return log(spark, sf_dir).filter("value is not null").select("seq", codec.checksum("value").alias("crc"))


def sorted_run_roundtrip(spark, sf_dir):
    """Entries of a run that was written and read again."""
    return shown(written_run(spark, log(spark, sf_dir)), "key_hex", "seq", "op", "value")


L = f"""WITH l AS (
  SELECT lpad(hex(user_id), 8, '0') AS key_hex, event_id AS seq, CASE WHEN event_type = 'error' THEN {DELETE} ELSE {PUT} END AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // {RUN} AS file_no
  FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY key_hex ORDER BY seq DESC) AS version FROM l),
c AS (SELECT DISTINCT lpad(hex(c_custkey), 8, '0') AS key_hex FROM customer WHERE c_custkey IS NOT NULL)
"""

HALF = "(SELECT coalesce(max(event_id), 0) // 2 FROM events)"
TOP = "(SELECT max(event_id) FROM events)"

FILES = """WITH f AS (
  SELECT number, max(level) AS meta_level, coalesce(max(file_size), 0) AS file_size, min(hex(smallest)) AS s, max(hex(largest)) AS g, max(vlogs) AS vlogs
  FROM file_meta WHERE number IS NOT NULL GROUP BY number),
r AS (SELECT *, left(s, len(s) - 16) AS lo, left(g, len(g) - 16) AS hi FROM f),
done AS (SELECT * FROM version_edit WHERE state = 'committed'),
live AS (SELECT u.x.number AS number, max(u.x.level) AS level FROM done, unnest(add_files) AS u(x)
  WHERE u.x.number NOT IN (SELECT v.y.number FROM done, unnest(delete_files) AS v(y) WHERE v.y.number IS NOT NULL) GROUP BY 1),
a AS (SELECT r.*, level FROM r JOIN live USING (number))
"""


def _times(h: str) -> str:
    return f"((((({h}) >> 16) * {codec.HASH_FACTOR}) % 65536 * 65536 + (({h}) & 65535) * {codec.HASH_FACTOR}) % 4294967296)"


_WORD = "(({n} % 256) * 16777216 + ({n} // 256 % 256) * 65536 + ({n} // 65536 % 256) * 256 + {n} // 16777216)"


def _hash_sql(n: str) -> str:
    """The bloom hash of the 4-byte key of a number."""
    start = f"xor({4 * codec.HASH_FACTOR % 4294967296}, {codec.HASH_SEED})"
    return _times(f"({start} + {_WORD.format(n=n)}) % 4294967296")


_STEP = "((h >> 17) + (h << 15)) % 4294967296"


def _varint_sql(n: str, size: int) -> str:
    parts = [f"lpad(hex(({n} >> {7 * i}) & 127 | {128 if i < size - 1 else 0}), 2, '0')" for i in range(size)]
    return " || ".join(parts)


SQL = {
    "get_point": L + f"SELECT value FROM n WHERE version = 1 AND op = 1 AND key_hex = lpad(hex({KEY}), 8, '0')",
    "multi_get": L + "SELECT key_hex, n.seq IS NOT NULL AS found, n.seq, n.value FROM c LEFT JOIN (SELECT * FROM n WHERE version = 1 AND op = 1) n USING (key_hex)",
    "snapshot_latest": L + "SELECT key_hex, seq, value FROM n WHERE version = 1 AND op = 1",
    "get_as_of": L + f"SELECT key_hex, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key_hex ORDER BY seq DESC) AS v FROM l WHERE seq <= {HALF}) WHERE v = 1 AND op = 1",
    "tombstoned_keys": L + "SELECT key_hex, seq FROM n WHERE version = 1 AND op = 0",
    "write_batch_seq": "SELECT user_id AS batch_id, event_id AS pos, 1000 + row_number() OVER (ORDER BY user_id, event_id) - 1 AS seq FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL",
    "version_history": L + "SELECT key_hex, seq, op, version FROM n",
    "merge_runs": L + "SELECT row_number() OVER (ORDER BY key_hex, seq DESC) AS position, key_hex, seq, file_no FROM l",
    "compact_bottom": L + "SELECT key_hex, seq, value FROM n WHERE version = 1 AND op = 1",
    "compact_retain": L + f"SELECT key_hex, seq, op FROM l WHERE seq > {HALF} UNION ALL SELECT key_hex, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key_hex ORDER BY seq DESC) AS v FROM l WHERE seq <= {HALF}) WHERE v = 1",
    "compact_exact_dup": L + f"SELECT DISTINCT key_hex, seq, op FROM l WHERE seq < {HALF} UNION ALL SELECT key_hex, seq, op FROM l WHERE seq >= {HALF} UNION ALL SELECT key_hex, seq, op FROM l WHERE seq >= {HALF}",
    "run_metadata": L + """, m AS (SELECT *, key_hex || lpad(hex(seq * 256 + op), 16, '0') AS ik, row_number() OVER (PARTITION BY file_no ORDER BY key_hex, seq DESC) AS i,
  row_number() OVER (PARTITION BY file_no ORDER BY key_hex DESC, seq) AS j FROM l)
SELECT file_no, count(*) AS n_entries, CAST(sum(4 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS file_size, max(ik) FILTER (i = 1) AS smallest, max(ik) FILTER (j = 1) AS largest FROM m GROUP BY file_no""",
    "zone_prune": FILES + f"SELECT number FROM a WHERE lo <= lpad(hex({KEY}), 8, '0') AND hi >= lpad(hex({KEY}), 8, '0')",
    "run_overlaps": FILES + "SELECT x.number, count(*) - 1 AS n_overlaps FROM a x JOIN a y ON x.lo <= y.hi AND x.hi >= y.lo GROUP BY x.number",
    "l0_overlap_groups": FILES + """, o AS (SELECT number, lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM a WHERE level = 0 AND lo IS NOT NULL AND hi IS NOT NULL)
SELECT number, CAST(sum(opens) OVER (ORDER BY lo, hi, number) AS BIGINT) AS group_no FROM o""",
    "compaction_score": FILES + """, p AS (SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS bytes FROM a GROUP BY level),
s AS (SELECT *, CASE WHEN level = 0 THEN n_files / 4 ELSE bytes / (1048576 * power(10.0, level - 1)) END AS score FROM p)
SELECT *, row_number() OVER (ORDER BY score DESC, level) = 1 AND score >= 1 AS chosen FROM s""",
    "major_inputs": FILES + """, p AS (SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS bytes FROM a GROUP BY level),
c AS (SELECT level FROM p WHERE CASE WHEN level = 0 THEN n_files / 4 ELSE bytes / (1048576 * power(10.0, level - 1)) END >= 1
  ORDER BY CASE WHEN level = 0 THEN n_files / 4 ELSE bytes / (1048576 * power(10.0, level - 1)) END DESC, level LIMIT 1),
o AS (SELECT number, lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM a WHERE level = 0 AND lo IS NOT NULL AND hi IS NOT NULL),
g AS (SELECT number, sum(opens) OVER (ORDER BY lo, hi, number) AS group_no FROM o),
base AS (SELECT number FROM g WHERE group_no = 1 AND (SELECT level FROM c) = 0
  UNION ALL SELECT min(number) FROM a WHERE level = (SELECT level FROM c) AND level > 0 HAVING count(*) > 0),
span AS (SELECT min(lo) AS lo, max(hi) AS hi FROM a WHERE number IN (SELECT number FROM base))
SELECT number, 'base' AS side FROM base
UNION ALL SELECT a.number, 'target' FROM a, span WHERE a.level = (SELECT level + 1 FROM c) AND a.lo <= span.hi AND a.hi >= span.lo""",
    "seek_inputs": FILES + """, s AS (SELECT number, lo, hi FROM a WHERE level = 1 ORDER BY number LIMIT 1)
SELECT number, 'base' AS side FROM s UNION ALL SELECT a.number, 'target' FROM a, s WHERE a.level = 2 AND a.lo <= s.hi AND a.hi >= s.lo""",
    "vlog_inheritance": """WITH p AS (SELECT DISTINCT compaction_id, u.x.number AS number FROM compaction_state, unnest(base) AS u(x)),
h AS (SELECT DISTINCT compaction_id, v.y AS vlog FROM p JOIN file_meta m USING (number), unnest(m.vlogs) AS v(y) WHERE v.y IS NOT NULL)
SELECT compaction_id, coalesce(string_agg(CAST(vlog AS VARCHAR), ',' ORDER BY vlog), '') AS vlogs
FROM (SELECT DISTINCT compaction_id FROM p JOIN file_meta m USING (number)) k LEFT JOIN h USING (compaction_id) GROUP BY compaction_id""",
    "build_version": """WITH done AS (SELECT * FROM version_edit WHERE state = 'committed'), m AS (SELECT max(edit_id) AS last FROM done),
e AS (SELECT edit_id = (SELECT last FROM m) AS newest, u.x.level AS level, u.x.number AS number, 'add' AS what FROM done, unnest(add_files) AS u(x)
  UNION ALL SELECT edit_id = (SELECT last FROM m), u.x.level, u.x.number, 'delete' FROM done, unnest(delete_files) AS u(x)),
b AS (SELECT level, number FROM e WHERE what = 'add' AND NOT newest EXCEPT SELECT level, number FROM e WHERE what = 'delete' AND NOT newest)
SELECT level, number FROM ((SELECT level, number FROM b UNION SELECT level, number FROM e WHERE what = 'add' AND newest) EXCEPT SELECT level, number FROM e WHERE what = 'delete' AND newest)
WHERE level IS NOT NULL AND number IS NOT NULL""",
    "dead_files": FILES + "SELECT number FROM f WHERE number NOT IN (SELECT number FROM a)",
    "store_get": L + "SELECT key_hex, n.seq IS NOT NULL AS found, n.value FROM c LEFT JOIN (SELECT * FROM n WHERE version = 1 AND op = 1) n USING (key_hex)",
    "flush_placed": L + """, m AS (SELECT lpad(hex(max(user_id) // 2), 8, '0') AS middle FROM events),
p AS (SELECT 1 AS part, min(key_hex) AS lo, max(key_hex) AS hi FROM l, m WHERE key_hex < middle HAVING count(*) > 0
  UNION ALL SELECT 2, min(key_hex), max(key_hex) FROM l, m WHERE key_hex >= middle HAVING count(*) > 0
  UNION ALL SELECT 3, min(key_hex), max(key_hex) FROM l HAVING count(*) > 0)
SELECT row_number() OVER (ORDER BY part) AS number, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.part < p.part AND q.lo <= p.hi AND q.hi >= p.lo) THEN 1 ELSE 2 END AS level FROM p""",
    "vlog_rewrite": "SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "block_cut": L.replace("WITH l", "WITH RECURSIVE l") + """, w AS (SELECT file_no, key_hex, seq, row_number() OVER (PARTITION BY file_no ORDER BY key_hex, seq DESC) AS i,
  CASE WHEN coalesce(octet_length(encode(value)), 0) + 1 < 128 THEN 1 WHEN octet_length(encode(value)) + 1 < 16384 THEN 2 ELSE 3 END + coalesce(octet_length(encode(value)), 0) + 14 AS size FROM l),
t(file_no, i, block, held) AS (SELECT file_no, i, CAST(0 AS BIGINT), CAST(4 + size + 4 AS BIGINT) FROM w WHERE i = 1
  UNION ALL SELECT w.file_no, w.i, CASE WHEN t.held >= 4096 THEN t.block + 1 ELSE t.block END, CASE WHEN t.held >= 4096 THEN 4 ELSE t.held END + w.size + 4 FROM t JOIN w ON w.file_no = t.file_no AND w.i = t.i + 1)
SELECT file_no, key_hex, seq, block FROM t JOIN w USING (file_no, i)""",
    "sst_roundtrip": L + "SELECT file_no AS number, key_hex, seq, op, value FROM l",
    "block_handles": L + """, b AS (SELECT (row_number() OVER (ORDER BY key_hex, seq DESC) - 1) // 178 AS block FROM l),
g AS (SELECT block * 4096 AS o, count(*) * 23 + 4 AS s FROM b GROUP BY block)
SELECT lpad(hex(o), 8, '0') || lpad(hex(s), 8, '0') AS handle, o AS "offset", s AS size FROM g""",
    "logged_values": L + ", v AS (SELECT seq, octet_length(encode(value)) AS n FROM l WHERE value IS NOT NULL) SELECT seq, n + CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS bytes, n AS length, true AS ok, false AS wrong FROM v",
    "number_bytes": L + "SELECT seq, lpad(hex(seq), 16, '0') AS u64, lpad(hex(seq), 8, '0') || key_hex AS u32_list FROM l",
    "record_crc": L + """, z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
b AS (SELECT seq, hex(encode(value)) AS h FROM l WHERE value IS NOT NULL)
SELECT seq, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, x: xor(c >> 8, z.z[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, z""",
    "bloom_stored": f"""WITH f AS (SELECT number, max(hex(filters)) AS filter FROM bloom_filter WHERE number IS NOT NULL AND octet_length(filters) > 1 GROUP BY number),
e AS (SELECT DISTINCT number, hex(key) AS k FROM sst_entry WHERE number IS NOT NULL AND key IS NOT NULL),
w AS (SELECT number, filter, list_transform(range((len(k) + 7) // 8), lambda i: CAST('0x' || substr(rpad(k, 64, '0'), CAST(8 * i + 7 AS BIGINT), 2) || substr(rpad(k, 64, '0'), CAST(8 * i + 5 AS BIGINT), 2)
    || substr(rpad(k, 64, '0'), CAST(8 * i + 3 AS BIGINT), 2) || substr(rpad(k, 64, '0'), CAST(8 * i + 1 AS BIGINT), 2) AS BIGINT)) AS words,
  xor((len(k) // 2 * {codec.HASH_FACTOR}) % 4294967296, {codec.HASH_SEED}) AS start, CAST('0x' || right(filter, 2) AS BIGINT) AS k, (len(filter) // 2 - 1) * 8 AS nbits FROM e JOIN f USING (number)),
h AS (SELECT number, filter, k, nbits, list_reduce(list_prepend(start, words), lambda h, w: {_times('(h + w) % 4294967296')}) AS h FROM w),
p AS (SELECT number, k > 30 OR k < 1 OR len(list_filter(list_transform(range(k), lambda i: (h + i * ({_STEP})) % 4294967296 % nbits),
  lambda b: (CAST('0x' || substr(filter, CAST(b // 8 * 2 + 1 AS BIGINT), 2) AS BIGINT) >> (b % 8)) & 1 = 0)) = 0 AS maybe FROM h)
SELECT number, count(*) AS n_keys, count(*) FILTER (NOT maybe) AS n_denied FROM p GROUP BY number""",
    "flush_level": FILES + """, o AS (SELECT x.number, count(*) FILTER (y.level = 0 AND y.number <> x.number) AS n0, count(*) FILTER (y.level = 1 AND y.number <> x.number) AS n1, count(*) FILTER (y.level = 2 AND y.number <> x.number) AS n2
  FROM a x JOIN a y ON x.lo <= y.hi AND x.hi >= y.lo GROUP BY x.number)
SELECT number, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 0 WHEN n2 > 0 THEN 1 ELSE 2 END AS level FROM o""",
    "manifest_replay": FILES + "SELECT number, level FROM live",
    "manifest_counters": "SELECT max(log_number) AS log_number, max(next_file_number) AS next_file_number, max(last_seq_number) AS last_seq_number FROM version_edit WHERE state = 'committed'",
    "unreferenced_files": FILES + "SELECT DISTINCT vlog_id FROM vlog_file WHERE vlog_id IS NOT NULL AND vlog_id NOT IN (SELECT u.x FROM a, unnest(vlogs) AS u(x) WHERE u.x IS NOT NULL)",
    "gc_candidate": FILES + ", k AS (SELECT number, len(list_filter(vlogs, lambda x: x IS NOT NULL)) AS n_vlogs FROM a) SELECT number, CAST(n_vlogs AS INTEGER) AS n_vlogs FROM k WHERE n_vlogs >= 2 ORDER BY n_vlogs DESC, number LIMIT 1",
    "value_split": f"SELECT doc_id, coalesce(octet_length(encode(text)) >= {THRESHOLD}, false) AS in_vlog, octet_length(encode(text)) AS bytes FROM documents WHERE doc_id IS NOT NULL",
    "vlog_offsets": L + "SELECT file_no, seq, CAST(coalesce(sum(12 + coalesce(octet_length(encode(value)), 0)) OVER (PARTITION BY file_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS vlog_off FROM l",
    "vlog_deref": "SELECT doc_id, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM documents WHERE doc_id IS NOT NULL",
    "bloom_build": f"""WITH k AS (SELECT event_id // {RUN} AS file_no, user_id FROM events WHERE user_id IS NOT NULL),
z AS (SELECT file_no, CAST(ceil(greatest(count(*) * 5, 64) / 8) * 8 AS BIGINT) AS nbits FROM k GROUP BY file_no),
h AS (SELECT DISTINCT file_no, nbits, {_hash_sql('user_id')} AS h FROM k JOIN z USING (file_no))
SELECT DISTINCT file_no, nbits, (h + i * ({_STEP})) % 4294967296 % nbits AS bit FROM h, range(3) AS t(i)""",
    "bloom_probe": f"""WITH k AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL),
z AS (SELECT CAST(ceil(greatest(count(*) * 5, 64) / 8) * 8 AS BIGINT) AS nbits FROM k),
h AS (SELECT {_hash_sql('user_id')} AS h FROM k),
b AS (SELECT DISTINCT (h + i * ({_STEP})) % 4294967296 % nbits AS bit FROM h, z, range(3) AS t(i)),
q AS (SELECT DISTINCT c_custkey, {_hash_sql('c_custkey')} AS h FROM customer),
p AS (SELECT c_custkey, (h + i * ({_STEP})) % 4294967296 % nbits AS bit FROM q, z, range(3) AS t(i))
SELECT lpad(hex(c_custkey), 8, '0') AS key_hex, bool_and(bit IN (SELECT bit FROM b)) AS maybe FROM p GROUP BY c_custkey""",
    "varint_codec": "WITH v AS (SELECT event_id * event_id % 4294967296 AS n FROM events) SELECT n, CAST(CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS n_bytes, CASE "
    + " ".join(f"WHEN n < {1 << 7 * s} THEN {_varint_sql('n', s)}" for s in (1, 2, 3, 4)) + f" ELSE {_varint_sql('n', 5)} END AS encoded, n AS decoded FROM v",
    "internal_key": L + "SELECT key_hex || lpad(hex(seq * 256 + op), 16, '0') AS ik_hex, key_hex, seq, op FROM l",
    "file_meta_keys": FILES + "SELECT number, lpad(CAST(number AS VARCHAR), CAST(greatest(5, len(CAST(number AS VARCHAR))) AS INTEGER), '0') || '.sst' AS name, lo AS low_hex, CAST('0x' || right(s, 16) AS BIGINT) // 256 AS low_seq, hi AS high_hex, CAST(CAST('0x' || right(g, 2) AS BIGINT) AS INTEGER) AS high_op FROM r",
    "block_assign": L + "SELECT key_hex, seq, (row_number() OVER (ORDER BY key_hex, seq DESC) - 1) // 178 AS block FROM l",
    "block_index": L + ", b AS (SELECT key_hex || lpad(hex(seq * 256 + op), 16, '0') AS ik, row_number() OVER (ORDER BY key_hex, seq DESC) - 1 AS i FROM l) SELECT i // 178 AS block, arg_max(ik, i) AS last_key FROM b GROUP BY 1",
    "index_seek": L + ", b AS (SELECT key_hex AS k, row_number() OVER (ORDER BY key_hex, seq DESC) - 1 AS i FROM l), x AS (SELECT i // 178 AS block, arg_max(k, i) AS k FROM b GROUP BY 1) SELECT key_hex, (SELECT min(block) FROM x WHERE x.k >= c.key_hex) AS block FROM c",
    "wal_replay": """WITH w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS v FROM wal_entry
  WHERE key IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL AND log_number > (SELECT coalesce(max(log_number) // 2, -1) FROM version_edit WHERE state = 'committed'))
SELECT hex(key) AS key_hex, seq, op FROM w WHERE v = 1""",
    "wal_snapshot": "WITH w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op DESC) AS v FROM wal_entry WHERE key IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL) SELECT hex(key) AS key_hex, seq FROM w WHERE v = 1 AND op = 1",
    "seek_miss": L + """, f AS (SELECT file_no, min(key_hex) AS lo, max(key_hex) AS hi FROM l GROUP BY 1),
p AS (SELECT f.file_no, count(c.key_hex) AS probes FROM f LEFT JOIN c ON c.key_hex BETWEEN f.lo AND f.hi GROUP BY 1),
h AS (SELECT file_no, count(DISTINCT key_hex) AS hits FROM l WHERE key_hex IN (SELECT key_hex FROM c) GROUP BY 1)
SELECT file_no, probes, coalesce(hits, 0) AS hits, probes - coalesce(hits, 0) AS misses, probes - coalesce(hits, 0) > 100 AS compact FROM p LEFT JOIN h USING (file_no)""",
    "lookup_layer": L + f"SELECT key_hex, coalesce(v.layer, 'none') AS layer, v.seq, v.op FROM c LEFT JOIN (SELECT key_hex, {_layers(TOP).replace(' DIV ', ' // ')} AS layer, seq, op FROM n WHERE version = 1) v USING (key_hex)",
    "memory_use": L + "SELECT CAST(sum(4 + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes FROM l",
    "sorted_run_roundtrip": L + "SELECT key_hex, seq, op, value FROM l",
}

QUERIES = {
    f.__name__: f
    for f in (
        get_point, multi_get, snapshot_latest, get_as_of, tombstoned_keys, write_batch_seq, version_history, merge_runs, compact_bottom, compact_retain,
        compact_exact_dup, run_metadata, zone_prune, run_overlaps, l0_overlap_groups, major_inputs, seek_inputs, vlog_inheritance, build_version, dead_files,
        store_get, flush_placed, vlog_rewrite, block_cut, sst_roundtrip, block_handles, logged_values, number_bytes, compaction_score, flush_level, manifest_replay, manifest_counters,
        unreferenced_files, gc_candidate, value_split, vlog_offsets, vlog_deref, bloom_build, bloom_probe, bloom_stored, varint_codec, internal_key,
        file_meta_keys, block_assign, block_index, index_seek, wal_replay, wal_snapshot, seek_miss, lookup_layer, memory_use, record_crc, sorted_run_roundtrip,
    )
}
