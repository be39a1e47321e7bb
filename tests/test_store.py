"""Fixed cases of the store, its rules, and random histories against a dictionary."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltstone.functions import codec
from siltstone.model import CHANGELOG, Options
from siltstone.operators import bloom, ordered, policy, read, runs, valuelog, write
from siltstone.sources.versions import VersionLog
from siltstone.store import Store
from siltstone.streaming.ingest import ingest


def be32(n):
    return n.to_bytes(4, "big")


def log_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, op, None if v is None else bytearray(v)) for k, s, op, v in rows], CHANGELOG)


def open_store(spark, tmp, **options):
    return Store.open(spark, Options(work_dir=str(tmp)).with_options(**options))


class TestReads:
    VERSIONS = [(b"\3", 0, 1, b"\x1e"), (b"\1", 1, 1, b"\x0b"), (b"\1", 2, 1, b"\x0c"), (b"\1", 3, 1, b"\x0d"), (b"\3", 4, 1, b"\x22"), (b"\xfe\xe9\xea", 9, 1, b"\xfe\xe9\xea")]

    def test_as_of(self, spark):
        log = log_of(spark, self.VERSIONS).cache()
        cases = [(b"\1", 0, None), (b"\1", 2, b"\x0c"), (b"\1", 5, b"\x0d"), (b"\2", 5, None), (b"\3", 5, b"\x22"), (b"\xfe\xe9\xea", 8, None), (b"\xfe\xe9\xea", 9, b"\xfe\xe9\xea")]
        for key, seq, want in cases:
            row = read.get(log, key, seq).first()
            assert (None if row is None else bytes(row[0])) == want

    def test_order_is_unsigned_and_newest_first(self, spark):
        rows = read.scan_versions(log_of(spark, self.VERSIONS)).collect()
        assert [(bytes(r.key), r.seq) for r in rows] == [(b"\1", 3), (b"\1", 2), (b"\1", 1), (b"\3", 4), (b"\3", 0), (b"\xfe\xe9\xea", 9)]

    def test_empty_log_and_null_keys(self, spark):
        log = log_of(spark, [])
        assert read.snapshot(log).count() == read.tombstones(log).count() == read.history(log).count() == 0
        keys = spark.createDataFrame([(b"a", 1), (None, 2), (b"a", 3)], "key binary, seq long")
        assert [(bytes(r.key), r.found) for r in read.multi_get(log, keys).collect()] == [(b"a", False)]

    def test_repeated_rows_and_empty_values(self, spark):
        log = log_of(spark, [(b"a", 1, 1, b"x"), (b"a", 2, 1, b""), (b"a", 2, 1, b""), (b"b", 3, 0, None), (b"b", 1, 1, b"old")])
        assert [(bytes(r.key), r.seq, bytes(r.value)) for r in read.snapshot(log).collect()] == [(b"a", 2, b"")]

    def test_history_of_a_hot_key(self, spark):
        rows = [(b"hot", s, 1, b"") for s in range(300)] + [(bytes([k]), s, s % 2, b"") for k in range(5) for s in range(k + 1)]
        got = {(bytes(r.key), r.seq): r.version for r in read.history(log_of(spark, rows)).collect()}
        count = {k: sum(x[0] == k for x in rows) for k, *_ in rows}
        assert got == {(k, s): count[k] - s for k, s, _, _ in rows}

    def test_numbers_follow_batch_and_place(self, spark):
        ops = spark.createDataFrame([(b, p, "x") for b in (7, 3, 5) for p in range(b * 20)] + [(None, 1, "x"), (1, None, "x")], "batch_id long, pos int, note string")
        got = [(r.batch_id, r.pos, r.note) for r in write.number_batches(ops, 50).orderBy("seq").collect()]
        assert got == [(b, p, "x") for b in (3, 5, 7) for p in range(b * 20)]
        assert write.number_batches(ops, 50).agg(F.min("seq"), F.max("seq")).first() == (50, 349)

    def test_merge_of_runs(self, spark):
        parts = [log_of(spark, [(bytes([j]), j + 50 * n, 1, b"") for j in range(50)]) for n in range(3)]
        keys = [(bytes(r.key)[0], r.seq) for r in runs.merge(parts).collect()]
        assert keys == sorted(keys, key=lambda x: (x[0], -x[1])) and len(keys) == 150


class TestCompaction:
    def test_keeps_what_a_retained_reader_sees(self, spark):
        log = log_of(spark, [(b"k", 1, 1, b"1"), (b"k", 2, 1, b"2"), (b"k", 3, 1, b"3"), (b"d", 1, 1, b""), (b"d", 2, 0, None)])
        assert sorted((bytes(r.key), r.seq) for r in runs.compact(log, 2).collect()) == [(b"d", 2), (b"k", 2), (b"k", 3)]
        assert sorted((bytes(r.key), r.seq) for r in runs.compact(log, 2, bottom=True).collect()) == [(b"k", 2), (b"k", 3)]

    def test_overlap_groups(self, spark):
        spans = [(1, 0, 10), (2, 5, 30), (3, 25, 40), (4, 50, 60)]
        files = spark.createDataFrame([(n, be32(a) + b"\0" * 8, be32(b) + b"\0" * 8) for n, a, b in spans], "number long, smallest binary, largest binary")
        assert sorted(map(tuple, runs.overlap_groups(files, "number").collect())) == [(1, 1), (2, 1), (3, 1), (4, 2)]
        assert sorted(map(tuple, runs.overlaps(files, "number").collect())) == [(1, 1), (2, 2), (3, 1), (4, 0)]

    def test_level_scores(self, spark):
        files = spark.createDataFrame([(0, 1)] * 3 + [(1, 1 << 20), (2, 10 << 20)], "level int, file_size long")
        got = {r.level: (r.score, r.chosen) for r in policy.level_scores(files).collect()}
        assert got == {0: (0.75, False), 1: (1.0, True), 2: (1.0, False)}  # of equals the upper level


class TestOrdered:
    def test_running_values(self, spark):
        values = [random.Random(3).randrange(40) for _ in range(200)]
        df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
        got = {r.i: (r.s, r.m) for r in ordered.running(df, [F.asc("v"), F.asc("i")], {"s": ("sum", F.col("v")), "m": ("max", F.col("i"))}).collect()}
        total, top = 0, None
        for v, i in sorted((v, i) for i, v in enumerate(values)):
            assert got[i] == (total, top)
            total, top = total + v, i if top is None else max(top, i)

    def test_overlap_counts(self, spark):
        rng = random.Random(5)
        spans = [(i, a, a + rng.randrange(30)) for i, a in enumerate(rng.randrange(200) for _ in range(80))]
        df = spark.createDataFrame([*spans, (99, None, 4)], "id long, lo long, hi long")
        got = {r.id: r.n for r in ordered.overlap_counts(df, df).collect()}
        assert got == {i: sum(a <= d and b >= c for _, c, d in spans) for i, a, b in spans}


class TestCodec:
    NUMBERS = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 4294967295]

    def test_varints(self, spark):
        df = spark.createDataFrame([(n,) for n in self.NUMBERS], "n long").select("n", codec.varint_length("n").alias("l"), codec.varint_encode("n").alias("e"), codec.varint_decode(codec.varint_encode("n")).alias("d"))
        for r in df.collect():
            want, n = bytearray(), r.n
            while n > 127:
                want.append(n & 127 | 128)
                n >>= 7
            want.append(n)
            assert (bytes(r.e), r.l, r.d) == (bytes(want), len(want), r.n)

    def test_internal_keys_and_lists(self, spark):
        df = spark.createDataFrame([(b"", 0, 1), (b"abc", (1 << 54) + 5, 0)], "key binary, seq long, op int").withColumn("ik", codec.internal_key("key", "seq", "op"))
        for r in df.select("key", "seq", "op", "ik", codec.user_key("ik").alias("k"), codec.key_seq("ik").alias("s"), codec.key_op("ik").alias("o")).collect():
            assert (r.k, r.s, r.o) == (r.key, r.seq, r.op)
            assert bytes(r.ik) == bytes(r.key) + (r.seq << 8 | r.op).to_bytes(8, "big")
        assert bytes(spark.range(1).select(codec.u32_list_bytes(F.array(F.lit(12345), F.lit(23456), F.lit(34567)))).first()[0]).hex() == "0000303900005ba000008707"
        assert spark.range(1).select(codec.checksum(F.lit(b"hello"))).first()[0] == 907060870

    def test_bloom_has_no_false_negatives(self, spark):
        bits = bloom.bits_per_key(0.1)
        assert (bits, bloom.probes(bits)) == (5, 3)
        keys = spark.range(2000).select(F.lit(1).alias("f"), codec.u32_bytes("id").alias("key"))
        rows = bloom.build(keys, ["f"], bits).collect()
        size = rows[0].nbits // 8
        body = bytearray(size) + bytes([3])
        for r in rows:
            body[r.bit // 8] |= 1 << r.bit % 8
        for h, most in ((codec.bloom_hash("key"), None), (codec.bloom_hash("key"), 3)):
            assert keys.select(bloom.may_contain(F.lit(bytes(body)), h, most).alias("m")).filter("m").count() == 2000
        packed = bloom.pack(bloom.build(keys, ["f"], bits), ["f"], bits).first()
        assert bytes(packed.filters) == bytes(body)
        one = spark.range(1).select(*[bloom.may_contain(F.lit(f), codec.bloom_hash(F.lit(b"abcd"))).alias(n) for n, f in (("empty", b"\3"), ("null", None), ("many", b"\0\x1f"))]).first()
        assert (one.empty, one.null, one.many) == (False, None, True)

    def test_hash_of_any_length(self, spark):
        rng = random.Random(2)
        keys = [b"", None, *[rng.randbytes(n) for n in range(1, 41)], b"a", b"a\0", b"a\0\0", rng.randbytes(500)]

        def want(k):
            h = (len(k) * codec.HASH_FACTOR & 0xFFFFFFFF) ^ codec.HASH_SEED
            for i in range(0, len(k), 4):
                h = (h + int.from_bytes(k[i : i + 4], "little")) * codec.HASH_FACTOR & 0xFFFFFFFF
            return h

        df = spark.createDataFrame([(k,) for k in keys], "key binary").withColumn("a", codec.bloom_hash("key"))
        for r in codec.with_bloom_hash(df, "key", "b", 500).collect():
            assert r.a == r.b == (None if r.key is None else want(bytes(r.key)))

    def test_filters_of_keys_of_any_length(self, spark):
        keys = spark.range(300).select((F.col("id") % 3).alias("f"), F.repeat(F.lit("k"), (F.col("id") % 11).cast("int")).alias("t"), "id").select("f", F.concat("t", F.col("id").cast("string")).cast("binary").alias("key"))
        packed = bloom.pack(bloom.build(keys, ["f"], 10), ["f"], 10)
        asked = codec.with_bloom_hash(keys, "key", "h", bloom.longest_key(keys)).join(packed, "f").select(bloom.may_contain(F.col("filters"), F.col("h")).alias("m"))
        assert asked.filter("m").count() == 300
        other = codec.with_bloom_hash(keys.select("f", F.concat("key", F.lit(b"?")).alias("key")), "key", "h").join(packed, "f").select(bloom.may_contain(F.col("filters"), F.col("h")).alias("m"))
        assert other.filter("m").count() < 60

    def test_block_handles(self, spark):
        df = spark.createDataFrame([(0, 4096), (123456, 1), ((1 << 32) - 1, 7)], "o long, s long").withColumn("h", codec.block_handle("o", "s"))
        assert all((r.o, r.s) == (r.o2, r.s2) and bytes(r.h) == be32(r.o) + be32(r.s) for r in df.select("*", codec.handle_offset("h").alias("o2"), codec.handle_size("h").alias("s2")).collect())


class TestValueLog:
    def test_split_and_follow(self, spark, tmp_path):
        rows = [(bytes([k]), k, 1, bytes([k]) * n) for k, n in enumerate([0, 1, 119, 120, 127, 128, 300, 5000])] + [(b"gone", 99, 0, None)]
        entries = valuelog.separate(log_of(spark, rows), f"{tmp_path}/v", 2).cache()
        records = spark.read.parquet(f"{tmp_path}/v")
        assert entries.filter("vlog_fid is not null").count() == records.count() == 3
        back = {bytes(r.key): r.value if r.value is None else bytes(r.value) for r in valuelog.resolve(entries, records).collect()}
        assert back == {k: v for k, _, _, v in rows}


class TestScratch:
    def test_clean_removes_what_was_settled(self, spark):
        from siltstone import session

        df = session.settle(spark.range(3), "t")
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert os.path.isdir(path) and session.clean(spark) >= 1 and not os.path.isdir(path)


class TestStore:
    def test_batch_order(self, spark, tmp_path):
        s = open_store(spark, tmp_path)
        batch = write.WriteBatch()
        for i in range(10):
            batch.put(be32(i), be32(i))
        for i in range(0, 10, 2):
            batch.delete(be32(i))
        s.write_batch(batch)
        again = open_store(spark, tmp_path)
        got = {bytes(r.key): bytes(r.value) for r in again.snapshot().collect()}
        assert got == {be32(i): be32(i) for i in range(1, 10, 2)}
        assert again.state["next_seq"] == 15

    def test_rules_over_flush_and_reopen(self, spark, tmp_path):
        s = open_store(spark, tmp_path)
        s.put(b"k", b"v1")
        s.put(b"e", b"")
        s.write_batch(write.WriteBatch().put(b"a", b"1").put(b"b", b"2").delete(b"b"))
        assert s.get(b"e") == b""
        s.flush()
        s.put(b"k", b"v2")
        s.flush()
        s.delete(b"a")
        s = open_store(spark, tmp_path)
        assert [s.get(k) for k in (b"k", b"e", b"a", b"b", b"never")] == [b"v2", b"", None, None, None]
        before = s.state["next_seq"]
        s = open_store(spark, tmp_path)
        assert s.state["next_seq"] == before == 7

    def test_second_writer_fails(self, spark, tmp_path):
        a, b = open_store(spark, tmp_path), open_store(spark, tmp_path)
        a.put(b"k", b"a")
        with pytest.raises(RuntimeError):
            b.put(b"k", b"b")
        assert open_store(spark, tmp_path).get(b"k") == b"a"

    @pytest.mark.parametrize("seed", range(4))
    def test_random_histories(self, spark, tmp_path, seed):
        rng = random.Random(seed)
        s, want = open_store(spark, tmp_path, kv_separate_threshold=8), {}
        for _ in range(7):
            batch = write.WriteBatch()
            for _ in range(rng.randrange(1, 40)):
                key = bytes([rng.randrange(12)]) * rng.choice([1, 4])
                if rng.random() < 0.3:
                    batch.delete(key)
                    want.pop(key, None)
                else:
                    value = rng.randbytes(rng.choice([0, 3, 8, 200]))
                    batch.put(key, value)
                    want[key] = value
            s.write_batch(batch)
            step = rng.choice(["", "flush", "flush", "compact", "full", "reopen"])
            if step == "flush":
                s.flush()
            elif step == "compact":
                s.compact()
            elif step == "full":
                s.flush()
                s.compact(full=True)
            elif step == "reopen":
                s = open_store(spark, tmp_path, kv_separate_threshold=8)
        assert {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()} == want
        keys = [bytes(r.key) for r in s.scan(b"\2", b"\7").collect()]
        assert keys == sorted(k for k in want if b"\2" <= k < b"\7")

    def test_two_hundred_histories_side_by_side(self, spark, tmp_path):
        """Each history has its own keys; all share the points of flush, compaction and reopening."""
        rng = random.Random(11)
        s, want = open_store(spark, tmp_path, kv_separate_threshold=8), {}
        for step in ["flush", "", "flush", "compact", "flush", "full", ""]:
            ops = []
            for h in range(200):
                for pos in range(rng.randrange(1, 6)):
                    key = be32(h) + bytes([rng.randrange(4)])
                    if rng.random() < 0.3:
                        ops.append((h, pos, bytearray(key), 0, None))
                        want.pop(key, None)
                    else:
                        value = rng.randbytes(rng.choice([0, 3, 40]))
                        ops.append((h, pos, bytearray(key), 1, bytearray(value)))
                        want[key] = value
            rng.shuffle(ops)
            s.write(spark.createDataFrame(ops, "batch_id long, pos int, key binary, op int, value binary"))
            if step == "flush":
                s.flush()
            elif step:
                s.flush()
                s.compact(full=step == "full")
            s = open_store(spark, tmp_path, kv_separate_threshold=8)
            assert {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()} == want

    def test_large_batches_flush_by_themselves(self, spark, tmp_path):
        s = open_store(spark, tmp_path, mem_size=1000)
        s.put(b"a", b"x" * 600)
        assert len(s.logs) == 1 and not s.runs
        s.put(b"b", b"y" * 600)
        assert not s.logs and s.runs[0]["entries"] == 2
        assert s.get(b"a") == b"x" * 600

    def test_policy_compaction_and_purge(self, spark, tmp_path):
        s = open_store(spark, tmp_path)
        for i in range(6):
            s.write_batch(write.WriteBatch().put(b"a", bytes([i])).put(b"z", b"x" * 300))
            s.flush()
        assert s.compact() and not s.compact()
        assert [(r["level"], r["entries"]) for r in s.runs] == [(2, 2), (1, 2)]
        s.compact(full=True)
        assert [r["entries"] for r in s.runs] == [2]
        s.purge()
        assert s.get(b"a") == bytes([5]) and s.get(b"z") == b"x" * 300

    SCHEMA = "batch_id long, pos int, key binary, op int, value binary"

    def feed(self, spark, tmp, *rows):
        spark.createDataFrame(list(rows), self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        return spark.readStream.schema(self.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")

    def test_stream_batches_apply_once(self, spark, tmp_path):
        s = open_store(spark, tmp_path / "store")
        stream = self.feed(spark, tmp_path, (1, 0, b"a", 1, b"1"), (1, 1, b"b", 1, b"2"), (2, 0, b"a", 0, None))
        ingest(s, stream, "feed", f"{tmp_path}/checkpoint")
        commits = f"{tmp_path}/checkpoint/commits"
        for name in ("0", ".0.crc"):  # as after a crash before the commit: batch 0 is sent again
            if os.path.exists(f"{commits}/{name}"):
                os.remove(f"{commits}/{name}")
        ingest(s, stream, "feed", f"{tmp_path}/checkpoint")
        assert s.state["next_seq"] == 3 and {bytes(r.key) for r in s.snapshot().collect()} == {b"b"}

    def test_a_lost_checkpoint_loses_and_repeats_nothing(self, spark, tmp_path):
        s = open_store(spark, tmp_path / "store")
        ingest(s, self.feed(spark, tmp_path, (1, 0, b"a", 1, b"1")), "feed", f"{tmp_path}/checkpoint")
        stream = self.feed(spark, tmp_path, (2, 0, b"c", 1, b"3"))
        with pytest.raises(StreamingQueryException):
            ingest(s, stream, "feed", f"{tmp_path}/other")
        assert {bytes(r.key) for r in s.snapshot().collect()} == {b"a"}
        ingest(s, stream, "feed", f"{tmp_path}/checkpoint")
        assert {bytes(r.key) for r in s.snapshot().collect()} == {b"a", b"c"} and s.state["next_seq"] == 2

    def test_reads_touch_only_runs_in_range(self, spark, tmp_path):
        s = open_store(spark, tmp_path, kv_separate_threshold=8)
        for low in (0, 100, 200):
            batch = write.WriteBatch()
            for i in range(10):
                batch.put(be32(low + i), b"x" * 20 + bytes([i]))
            s.write_batch(batch)
            s.flush()
        assert [r["level"] for r in s.runs] == [2, 2, 2]  # no overlap anywhere
        assert [len(s.runs_for(be32(k), be32(k))) for k in (5, 50, 105, 999)] == [1, 0, 1, 0]
        assert s.get(be32(205)) == b"x" * 20 + b"\5" and s.get(be32(50)) is None and s.misses == {}
        assert s.get(be32(3), 1) is None and s.get(be32(9)) == b"x" * 20 + b"\t"
        keys = spark.createDataFrame([(be32(k),) for k in (101, 109, 150)], "key binary")
        assert {bytes(r.key): r.found for r in s.multi_get(keys).collect()} == {be32(101): True, be32(109): True, be32(150): False}
        assert s.multi_get(keys.limit(0)).count() == 0
        assert [bytes(r.key) for r in s.scan(be32(108), be32(202)).collect()] == [be32(k) for k in (108, 109, 200, 201)]
        for r in s.runs:
            s.cache.evict(f"run-{r['number']}")
        asked = s._entries(s.runs_for(be32(5), be32(5))).filter(F.col("key") == F.lit(bytearray(be32(5))))
        assert {p.split("/runs/")[1].split("/")[0] for p in asked.inputFiles()} == {"1"}
        assert "EqualTo(key" in asked._jdf.queryExecution().executedPlan().toString()

    def test_flushes_are_placed_by_overlap(self, spark, tmp_path):
        s = open_store(spark, tmp_path)
        for low, high in ((0, 9), (20, 29), (5, 25), (5, 6), (0, 40)):
            s.write_batch(write.WriteBatch().put(be32(low), b"l").put(be32(high), b"h"))
            s.flush()
        assert [r["level"] for r in s.runs] == [2, 2, 1, 0, 0]

    @pytest.mark.parametrize("seed", range(3))
    def test_placing_is_the_policy_of_the_tables(self, spark, seed):
        rng = random.Random(seed)
        spans = [(n, rng.randrange(3), a, a + rng.randrange(20)) for n, a in enumerate(rng.randrange(300) for _ in range(25))]
        files = spark.createDataFrame([(n, lv, 1, be32(a) + b"\0" * 8, be32(b) + b"\0" * 8) for n, lv, a, b in spans], "number long, level int, file_size long, smallest binary, largest binary")
        got = {r.number: r.level for r in policy.flush_level(files, files).collect()}
        assert got == {n: policy.place_run(be32(a), be32(b), [(lv, be32(c), be32(d)) for m, lv, c, d in spans if m != n]) for n, _, a, b in spans}

    def test_fruitless_probes_lead_to_a_compaction(self, spark, tmp_path):
        s = open_store(spark, tmp_path, allow_miss_count=3)
        for keys in ((0, 50), (10, 60), (20, 70)):
            s.write_batch(write.WriteBatch().put(be32(keys[0]), b"a").put(be32(keys[1]), b"b"))
            s.flush()
        before = {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()}
        assert not s.compact_seek()
        for _ in range(3):
            assert s.get(be32(30)) is None
        assert "seek" in s.requests() and s.maintain() and s.requests() == []
        assert len(s.runs) < 3 and {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()} == before
        rows = {r.run: (r.probes, r.hits, r.misses) for r in s.note_misses(spark.createDataFrame([(be32(k),) for k in (0, 1, 2, 999)], "key binary")).collect()}
        assert all(p == h + m for p, h, m in rows.values()) and sum(s.misses.values()) == sum(m for *_, m in rows.values())

    def test_value_logs_are_taken_over_then_rewritten(self, spark, tmp_path):
        s = open_store(spark, tmp_path, kv_separate_threshold=8)
        want = {}
        for n in range(6):
            batch = write.WriteBatch()
            for k in (0, 1, 2 + n, 90):
                batch.put(be32(k), b"v" * 20 + bytes([n, k]))
                want[be32(k)] = b"v" * 20 + bytes([n, k])
            s.write_batch(batch)
            s.flush()
        state = lambda: {bytes(r.key): bytes(r.value) for r in s.snapshot().collect()}
        assert state() == want
        while s.compact():
            pass
        most = max(s.runs, key=lambda r: len(r["vlogs"]))
        assert len(most["vlogs"]) > 1 and state() == want
        assert s.collect_garbage() == most["number"] and state() == want
        while s.collect_garbage() is not None:
            pass
        assert all(len(r["vlogs"]) <= 1 for r in s.runs)
        removed = s.purge()
        assert any("/vlogs/" in p for p in removed) and state() == want
        assert s.get(be32(90)) == want[be32(90)]

    def test_a_pinned_reader_keeps_its_files(self, spark, tmp_path):
        s = open_store(spark, tmp_path, kv_separate_threshold=8)
        s.put(b"k", b"old" * 10)
        s.flush()
        with s.pin() as reader:
            s.put(b"k", b"new" * 10)
            s.flush()
            s.compact(full=True)
            s.purge()
            assert s.pinned() == [reader.version]
            assert reader.get(b"k") == b"old" * 10 and s.get(b"k") == b"new" * 10
        assert s.pinned() == [] and any("/runs/1" in p for p in s.purge())
        assert open_store(spark, tmp_path).get(b"k") == b"new" * 10

    def test_the_manifest_holds_edits(self, spark, tmp_path):
        log = VersionLog(spark, f"{tmp_path}/m", base_every=4)
        for n in range(11):
            log.publish(n, {f"x{n}": n, **({f"x{n - 1}": None} if n % 2 else {})})
        assert log.current() == 11 and log.read() == {f"x{n}": n for n in (1, 3, 5, 7, 9, 10)}
        assert log.read(6) == {f"x{n}": n for n in (1, 3, 5)}
        sizes = [os.path.getsize(f"{tmp_path}/m/{v:012d}") for v in log.versions()]
        assert max(sizes[5:8]) < sizes[8]
        assert log.expire(7) == [1, 2, 3, 4] and log.read(7) == {f"x{n}": n for n in (1, 3, 5, 6)}
        with pytest.raises(RuntimeError):
            log.publish(9, {})

    def test_many_writes_deletes_and_reads(self, spark, tmp_path):
        """Writes in rounds, overwrites and deletes, checked by key, by scan and after opening again."""
        s, want = open_store(spark, tmp_path, mem_size=4000, kv_separate_threshold=16), {}
        for round_ in range(4):
            ops = []
            for i in range(round_ * 50, round_ * 50 + 120):
                gone = i % 7 == round_
                ops.append((i, 0, bytearray(be32(i)), 0 if gone else 1, None if gone else bytearray(be32(i) * (1 + i % 8))))
                want.pop(be32(i), None) if gone else want.__setitem__(be32(i), be32(i) * (1 + i % 8))
            s.write(spark.createDataFrame(ops, self.SCHEMA))
            s.maintain()
        for store in (s, open_store(spark, tmp_path, kv_separate_threshold=16)):
            assert {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()} == want
            for i in (0, 3, 77, 150, 269, 5000):
                assert store.get(be32(i)) == want.get(be32(i))

    def test_opening_after_half_done_work(self, spark, tmp_path):
        """Folders that no version names, as an interrupted flush or write leaves them, change nothing."""
        s = open_store(spark, tmp_path)
        s.put(b"a", b"1")
        s.flush()
        s.put(b"b", b"2")
        log_of(spark, [(b"a", 9, 1, b"ghost")]).write.parquet(f"{tmp_path}/log/dead")
        s._write_run(log_of(spark, [(b"a", 99, 1, b"ghost")]), 0, 10)
        again = open_store(spark, tmp_path)
        assert {bytes(r.key): bytes(r.value) for r in again.snapshot().collect()} == {b"a": b"1", b"b": b"2"}
        again.put(b"c", b"3")
        again.flush()
        assert len(again.runs) == 2 and again.state["next_seq"] == 3
        assert {bytes(r.key): bytes(r.value) for r in open_store(spark, tmp_path).snapshot().collect()} == {b"a": b"1", b"b": b"2", b"c": b"3"}
        assert any(p.endswith("/log/dead") for p in again.purge())
