"""The data-pipeline problems of the core on small, dirty fixtures."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltstone.operators import incremental, orphans
from siltstone.operators.skew import skew_join
from siltstone.session import scratch
from siltstone.streaming import compactor, upserts

T = [dt.datetime(2024, 3, d) for d in range(1, 20)]
FILE = "number long, vlogs array<long>, created_at timestamp_ntz, ref_id string, level int"
EDIT = "edit_id long, edit_ts timestamp_ntz, state string, delete_files array<struct<level: int, number: long>>, delete_vlogs array<long>, log_number long"
VLOG = "vlog_id long, created_at timestamp_ntz, deleted_at timestamp_ntz, src_id string"


def found(spark, files, edits, vlogs):
    return sorted(map(tuple, orphans.find_orphans(*orphans.store_references(spark.createDataFrame(files, FILE), spark.createDataFrame(edits, EDIT), spark.createDataFrame(vlogs, VLOG))).collect()))


class TestOrphans:
    def test_reasons(self, spark):
        files = [(1, [10, 11, None, 99], T[5], "x", 0), (1, [10, 11, None, 99], T[5], "x", 0), (2, None, T[5], None, 0), (3, [12], T[2], None, 0), (4, [], T[2], None, 0)]
        edits = [
            (1, T[6], "committed", [(0, 4), (0, 50)], [11, 10, 98], 1),
            (2, T[7], "committed", [(1, 4), (0, None)], None, 1),
            (3, T[7], None, [(1, 1)], [77], 1),
            (4, T[1], "committed", [(0, 1)], [10], 1),
        ]
        vlogs = [(10, T[1], None, "y"), (11, T[1], T[5], "y"), (11, T[1], T[5], None), (12, T[3], None, None)]
        got = found(spark, files, edits, vlogs)
        assert got == sorted(
            [
                ("file_meta.vlogs", 1, 99, "missing", "2024-03-06"),
                ("file_meta.vlogs", 1, 11, "deleted", "2024-03-06"),  # deleted at the very time
                ("file_meta.vlogs", 3, 12, "late", "2024-03-03"),
                ("version_edit.delete_vlogs", 1, 98, "missing", "2024-03-07"),
                ("version_edit.delete_vlogs", 1, 11, "deleted", "2024-03-07"),
                ("version_edit.delete_files", 1, 50, "missing", "2024-03-07"),
                ("version_edit.delete_files", 2, 4, "deleted", "2024-03-08"),
                ("version_edit.delete_files", 4, 1, "late", "2024-03-02"),
            ]
        )

    def test_deletion_at_the_time_counts_only_for_files(self, spark):
        assert found(spark, [], [(1, T[5], "committed", None, [11], 1)], [(11, T[1], T[5], None)]) == []

    def test_empty(self, spark):
        assert found(spark, [], [], []) == []

    def test_no_targets_and_null_times(self, spark):
        assert found(spark, [(1, [7], None, None, 0)], [], []) == [("file_meta.vlogs", 1, 7, "missing", None)]

    def test_hot_target(self, spark):
        files = [(i, [5], T[i % 10], None, 0) for i in range(300)]
        assert len(found(spark, files, [], [(5, T[4], None, None)])) == sum(T[4] > T[i % 10] for i in range(300))


class TestSkewJoin:
    @pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
    def test_same_as_plain_join(self, spark, how):
        left = spark.createDataFrame([(k, i) for i in range(200) for k in ([1, 2, None] if i % 5 else [1, i])], "k long, i long")
        right = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c"), (None, "d"), (15, "e")], "k long, v string")
        order = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert order(skew_join(left, right, ["k"], ["i"], how)) == order(left.join(right, "k", how))


CHANGE = "key binary, seq long, op int, value binary"
ENTRY = f"{CHANGE}, extra string, last string"


def write_files(spark, path, parts, schema):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
    return path


class TestUpserts:
    def run(self, spark, tmp, entries, batches, rounds=5):
        log = write_files(spark, f"{tmp}/log", entries, ENTRY)
        wire = write_files(spark, f"{tmp}/wire", batches, "batch_id long, base_seq long, n_ops int, data array<struct<key: binary, value: binary, seq: long, op: int>>")
        table = upserts.rebuild(spark, log, wire, rounds)
        return {bytes(r.key): (r.seq, r.value) for r in upserts.live_rows(table).collect()}

    def test_repeats_disorder_and_deletes(self, spark, tmp_path):
        e = lambda k, s, op, v: (k, s, op, v, "x", None)
        entries = [
            [e(b"a", 5, 1, b"new"), e(b"b", 3, 0, b"junk"), e(b"", 4, 1, b""), e(None, 9, 1, b"?"), e(b"z", None, 1, b"?")],
            [e(b"a", 1, 1, b"old"), e(b"b", 2, 1, b"late"), e(b"a", 5, 1, b"new"), e(b"c", 8, 0, None), e(b"d", 9, 1, b"x" * 200_000)],
        ]
        batches = [[(1, 10, 2, [(b"c", b"back", 0, 1), (b"a", None, 0, 0)]), (2, 20, 3, [(b"d", None, 0, 0)]), (3, 30, 1, None), (1, 10, 2, [(b"c", b"back", 0, 1), (b"a", None, 0, 0)])]]
        got = self.run(spark, tmp_path, entries, batches)
        assert got == {b"": (4, b""), b"c": (10, b"back"), b"d": (9, b"x" * 200_000)}

    def test_empty(self, spark, tmp_path):
        assert self.run(spark, tmp_path, [[]], [[]]) == {}

    def test_tie_prefers_the_put(self, spark, tmp_path):
        assert self.run(spark, tmp_path, [[(b"a", 1, 0, None, None, None), (b"a", 1, 1, b"v", None, None)]], [[]]) == {b"a": (1, b"v")}

    @pytest.mark.parametrize("rounds", [1, 4])
    def test_any_number_of_micro_batches(self, spark, tmp_path, rounds):
        rng = random.Random(rounds)
        entries = [[(rng.choice([b"hot", bytes([rng.randrange(30)])]), s, rng.randrange(2), bytes([s % 251]), None, None) for s in rng.choices(range(500), k=60)] for _ in range(8)]
        seen = {}
        entries = [[seen.setdefault(e[1], e) for e in part] for part in entries]  # one change a number
        newest = {}
        for e in sorted((e for part in entries for e in part), key=lambda e: e[1]):
            newest[e[0]] = e
        assert self.run(spark, tmp_path, entries, [[]], rounds) == {k: (e[1], e[3]) for k, e in newest.items() if e[2] == 1}

    def test_a_single_file_is_streamed_in_rounds_too(self, spark, tmp_path):
        path = write_files(spark, f"{tmp_path}/one", [[(bytes([s % 7]), s, 1, b"v") for s in range(90)]], CHANGE)
        table = upserts.UpsertTable(spark, f"{tmp_path}/table")
        upserts.apply_changes(upserts.entry_changes(upserts.stream_in_rounds(spark, path, 3)), table, f"{tmp_path}/checkpoint")
        assert len(table.versions.read()["deltas"]) == 3
        assert {bytes(r.key)[0]: r.seq for r in table.read().collect()} == {s % 7: s for s in range(90)}

    def stream(self, spark, tmp, path, checkpoint="checkpoint"):
        table = upserts.UpsertTable(spark, f"{tmp}/table")
        upserts.apply_changes(upserts.entry_changes(upserts.file_stream(spark, path, 1)), table, f"{tmp}/{checkpoint}")
        return table

    def test_only_newer_changes_come_out(self, spark, tmp_path):
        path = write_files(spark, f"{tmp_path}/in", [[(b"a", 5, 1, b"1"), (b"b", 2, 1, b"2")]], CHANGE)
        table = self.stream(spark, tmp_path, path)
        write_files(spark, path, [[(b"a", 4, 1, b"late"), (b"a", 5, 1, b"1"), (b"b", 3, 0, None)]], CHANGE)
        self.stream(spark, tmp_path, path)
        (last,) = [x for x in table.versions.read()["deltas"] if x.startswith("batch=1-")]
        assert [(bytes(r.key), r.seq) for r in spark.read.parquet(f"{tmp_path}/table/data/{last}").collect()] == [(b"b", 3)]
        assert {bytes(r.key): (r.seq, r.op) for r in table.read().collect()} == {b"a": (5, 1), b"b": (3, 0)}
        table.fold()
        assert not table.versions.read()["deltas"] and {bytes(r.key): r.seq for r in table.read().collect()} == {b"a": 5, b"b": 3}

    def test_a_retry_replaces_and_a_lost_checkpoint_is_refused(self, spark, tmp_path):
        path = write_files(spark, f"{tmp_path}/in", [[(b"a", 1, 1, b"1"), (b"b", 2, 1, b"2")]], CHANGE)
        self.stream(spark, tmp_path, path)
        write_files(spark, path, [[(b"a", 5, 0, None), (b"b", 1, 1, b"old")]], CHANGE)
        table = self.stream(spark, tmp_path, path)
        state = lambda: {bytes(r.key): (r.seq, r.op) for r in table.read().collect()}
        assert state() == {b"a": (5, 0), b"b": (2, 1)}
        repeat_last_batch(f"{tmp_path}/checkpoint")
        self.stream(spark, tmp_path, path)
        assert state() == {b"a": (5, 0), b"b": (2, 1)}
        write_files(spark, path, [[(b"c", 9, 1, b"new")]], CHANGE)
        with pytest.raises(StreamingQueryException):
            self.stream(spark, tmp_path, path, "another")
        assert state() == {b"a": (5, 0), b"b": (2, 1)}
        self.stream(spark, tmp_path, path)
        assert state() == {b"a": (5, 0), b"b": (2, 1), b"c": (9, 1)}


def repeat_last_batch(checkpoint):
    """The last micro-batch will be run again, as after a crash before its commit."""
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")
    if os.path.exists(crc := f"{checkpoint}/commits/.{last}.crc"):
        os.remove(crc)


class TestCompactor:
    def test_choice_of_files(self, spark):
        plans = spark.createDataFrame([(1, [(1, 9), (2, 9), (None, 1)]), (2, None), (3, [(2, 9), (3, 9), (4, 9), (5, 9)])], "compaction_id long, base array<struct<number: long, file_size: long>>")
        meta = spark.createDataFrame([(1, 10, "a"), (1, None, "a"), (2, 16_384, "a"), (2, 5, "a"), (3, None, "a"), (4, 3, "a"), (6, 3, "a")], "number long, file_size long, size string")
        edits = spark.createDataFrame([(1, "committed", [(2, 4)]), (2, "torn", [(0, 1)]), (3, "committed", None)], "edit_id long, state string, delete_files array<struct<level: int, number: long>>")
        assert sorted(r[0] for r in compactor.small_files(plans, meta, edits).collect()) == [1, 3]

    def test_records_once_over_many_files(self, spark, tmp_path):
        schema = "number long, key binary, seq long, op int, extra string"
        parts = [[(n, bytes([k]), k * 10, 1, "x") for k in range(n, n + 6)] for n in range(8)] + [[(9, None, 3, 1, "x")]]
        path = write_files(spark, f"{tmp_path}/in", parts, schema)
        got = compactor.consolidate(spark, path, spark.createDataFrame([(n,) for n in range(0, 8, 2)], "number long"), rounds=4)
        assert got.count() == got.distinct().count()
        want = sorted({k for n in range(0, 8, 2) for k in range(n, n + 6)})
        assert sorted(bytes(r.key)[0] for r in got.collect()) == want

    def test_records_with_a_null_key_stay(self, spark, tmp_path):
        rows = [(1, None, 7, 1, "x"), (1, b"a", 8, 1, "x"), (1, b"b", None, 1, "x")]
        path = write_files(spark, f"{tmp_path}/in", [rows, [(2, None, 7, 1, "x")]], "number long, key binary, seq long, op int, extra string")
        got = compactor.consolidate(spark, path, spark.createDataFrame([(1,), (2,)], "number long"))
        assert sorted(r.seq for r in got.collect()) == [7, 8]

    def test_directory_of_tiny_files(self, spark, tmp_path):
        path = write_files(spark, f"{tmp_path}/in", [[(i, f"t{i}" * (5000 if i == 3 else 1))] for i in range(7)] + [[(2, "t2"), (None, None)]], "id long, body string")
        out = f"{tmp_path}/out"
        run = lambda: compactor.compact_directory(spark, path, ["id", "body"], ["id"], out, f"{tmp_path}/checkpoint")
        assert run().count() == 8
        write_files(spark, path, [[(6, "t6"), (50, "late")]], "id long, body string")
        assert sorted(-1 if r.id is None else r.id for r in run().collect()) == [-1, 0, 1, 2, 3, 4, 5, 6, 50]
        files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
        assert len(files) < 8
        repeat_last_batch(f"{tmp_path}/checkpoint")
        assert run().count() == 9

    def test_nulls_and_repeats_in_later_batches(self, spark, tmp_path):
        parts = [[(None, "n"), (1, "a")], [(1, "a"), (2, "b")], [(None, "n"), (900, "z")], [(None, "m"), (2, "b")], [(None, None)], [(None, None)]]
        path = write_files(spark, f"{tmp_path}/in", parts, "id long, body string")
        got = compactor.compact_directory(spark, path, ["id", "body"], ["id"], f"{tmp_path}/out", f"{tmp_path}/checkpoint", files_per_batch=1)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted({r for p in parts for r in p}, key=repr)

    def test_another_checkpoint_is_refused(self, spark, tmp_path):
        path = write_files(spark, f"{tmp_path}/in", [[(1, "a")]], "id long, body string")
        run = lambda c: compactor.compact_directory(spark, path, ["id"], ["id"], f"{tmp_path}/out", f"{tmp_path}/{c}")
        run("one")
        with pytest.raises(StreamingQueryException):
            run("two")
        assert run("one").count() == 1


class TestIncremental:
    def want(self, records, edits):
        logs = {}
        for seq, log in records:
            if seq is not None and log is not None:
                logs[seq] = min(log, logs.get(seq, log))
        out, taken, high = set(), set(), None
        for edit, state, log in sorted({e for e in edits if e[1] == "committed" and e[0] is not None}, key=lambda e: e[0]):
            high = max((x for x in (high, log) if x is not None), default=None)
            for seq, at in logs.items():
                if high is not None and at <= high and seq not in taken:
                    taken.add(seq)
                    out.add((edit, seq))
        return out

    @pytest.mark.parametrize("slices", [1, 2, 5])
    def test_replay(self, spark, slices):
        records = [(s, s // 7 * 3 + 2) for s in range(300)] + [(5, 900), (6, None), (299, None), (None, 4), (400, None), (401, 10_000)] + [(1000 + s, 50) for s in range(300)]
        edits = [(1, "committed", 5), (2, "torn", 60), (3, "committed", 40), (3, "committed", 40), (4, "committed", 20), (5, "committed", None), (6, None, 90), (7, "committed", 90), (9, "committed", 121), (None, "committed", 99)]
        source = self.source(spark, records).withColumn("edit_id", F.lit("clash"))
        got = incremental.replay_runs(spark, scratch(spark, "t"), source, spark.createDataFrame(edits, "edit_id long, state string, log_number long"), slices)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == self.want(records, edits)

    @pytest.mark.parametrize("records,edits", [([], [(1, "committed", 5)]), ([(1, 2)], []), ([(1, 2)], [(1, "torn", 9)])])
    def test_empty(self, spark, records, edits):
        got = incremental.replay_runs(spark, scratch(spark, "t"), self.source(spark, records), spark.createDataFrame(edits, "edit_id long, state string, log_number long"))
        assert got.count() == 0

    def source(self, spark, records):
        return spark.createDataFrame(records, "seq long, log_number long").withColumns({"key": F.lit(b"k"), "op": F.lit(1), "value": F.lit(b"v")})

    def test_the_anti_join_decides(self, spark, monkeypatch):
        records, edits = [(s, s) for s in range(40)], [(i, "committed", 10 * i) for i in range(1, 5)]
        run = lambda: incremental.replay_runs(spark, scratch(spark, "t"), self.source(spark, records), spark.createDataFrame(edits, "edit_id long, state string, log_number long")).count()
        assert run() == 40
        monkeypatch.setattr(incremental.IncrementalTarget, "pending", lambda self, source, version=None: source)
        assert run() > 40

    def test_replaying_a_path_again_adds_nothing(self, spark):
        path, edits = scratch(spark, "t"), spark.createDataFrame([(1, "committed", 5), (2, "committed", 30)], "edit_id long, state string, log_number long")
        for n in (20, 25):
            got = incremental.replay_runs(spark, path, self.source(spark, [(s, s) for s in range(n)]), edits)
            assert sorted(r.seq for r in got.collect()) == list(range(n))

    def target(self, spark):
        return incremental.IncrementalTarget(spark, scratch(spark, "t"), ["id"], "v")

    def test_failed_and_repeated_runs(self, spark):
        target, source = self.target(spark), spark.range(10).withColumn("v", F.lit(1))
        target.write(target.pending(source.filter("id < 5")), 0)  # died before it was published
        assert target.run(source.filter("id < 5")) == 1
        attempt = target.write(target.pending(source), 1)
        target.publish(attempt, 1)  # died right after; the run is repeated
        with pytest.raises(ValueError):
            target.publish(attempt, 2)
        target.run(source)
        assert sorted(r.id for r in target.read("id long").collect()) == list(range(10))
        assert target.pending(source).count() == 0

    def test_changed_records_are_taken_again(self, spark):
        target = self.target(spark)
        rows = lambda *x: spark.createDataFrame(list(x), "id long, v long")
        target.run(rows((1, 1), (2, 1), (None, 1)))
        target.run(rows((1, 1), (2, 2), (None, 1), (3, None)))
        target.run(rows((3, None)))
        assert sorted(map(tuple, target.read("id long, v long").collect()), key=repr) == sorted([(1, 1), (2, 1), (2, 2), (3, None), (None, 1)], key=repr)

    def test_two_runs_on_one_base(self, spark):
        target = self.target(spark)
        rows = spark.range(3).withColumn("v", F.lit(1))
        a, b = target.write(rows, 0), target.write(rows, 0)
        target.publish(a, 0)
        with pytest.raises(RuntimeError):
            target.publish(b, 0)
        assert target.read("id long").count() == 3
