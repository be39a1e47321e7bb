"""Has this key been seen before? Hash-partitioned blocked Bloom filters."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import settle
from siltstone.sources.versions import VersionLog

#: Share of new keys that may be taken for seen ones.
TARGET_FP = 0.01
#: Bits of a block; all probes of a key stay in one block (one cache line).
BLOCK_BITS = 512
#: Distinct keys that one filter is meant to hold: 2 to 3 MB of bits at the target.
KEYS_PER_FILTER = 2_000_000
#: Filters that a task fills one after the other, at least; only one is in memory.
FILTERS_A_TASK = 4
#: A key is remembered by a task while it holds more than so large a share of an Arrow batch, and the most keys remembered.
OFTEN, REMEMBERED = 0.01, 1000
#: What a row is: an earlier key, an arrival, a known absent key, or an arrival that repeats one of its own task.
#: Then the bits of a filter, as they were before the run and after it.
EARLIER, ARRIVAL, ABSENT, REPEAT, BEFORE, AFTER = 0, 1, 2, 3, -1, 4


def filter_shape(n_keys: int, target_fp: float = TARGET_FP) -> tuple[int, int]:
    """Blocks and probes for ``n_keys``.

    Blocks are unevenly loaded, so a blocked filter needs more bits than a plain
    one: a fifth more, which holds for targets of 0.1 % and above.
    """
    bits_per_key = -math.log(target_fp) / math.log(2) ** 2 * 1.2
    return max(1, math.ceil(n_keys * bits_per_key / BLOCK_BITS)), max(1, round(-math.log2(target_fp)))


class BlockedBloom:
    """A Bloom filter of 512-bit blocks; keys are given as two 64-bit hashes."""

    def __init__(self, n_keys: int, target_fp: float = TARGET_FP):
        self.blocks, self.probes = filter_shape(n_keys, target_fp)
        self.words = np.zeros(self.blocks * (BLOCK_BITS // 64), np.uint64)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """One row of absolute bit positions a key."""
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        block = (h1 >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)
        step = (h2 >> np.uint64(32)) | np.uint64(1)
        i = np.arange(self.probes, dtype=np.uint64)
        inside = (h2[:, None] + i * step[:, None] + (i * i * i - i) // np.uint64(6)) % np.uint64(BLOCK_BITS)
        return block[:, None] * np.uint64(BLOCK_BITS) + inside

    def _set(self, bits: np.ndarray) -> np.ndarray:
        return (self.words[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) > 0

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self._set(self.positions(h1, h2)).all(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        self._add(self.positions(h1, h2).ravel())

    def _add(self, bits: np.ndarray) -> None:
        np.bitwise_or.at(self.words, bits >> np.uint64(6), np.uint64(1) << (bits & np.uint64(63)))

    def query_then_insert(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The answer for each key as if each were queried, then inserted, one after the other.

        A bit counts as set for row i if the filter had it before the call or a
        row before i sets it; the first row to set each bit decides that for all
        rows at once.
        """
        if not len(h1):
            return np.zeros(0, bool)
        bits = self.positions(h1, h2)
        flat = bits.ravel()
        row = np.repeat(np.arange(len(h1)), self.probes)
        _, first, code = np.unique(flat, return_index=True, return_inverse=True)
        earlier = row[first][code] < row
        seen = (self._set(flat) | earlier).reshape(bits.shape).all(axis=1)
        self._add(flat)
        return seen


def _thin_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key once a batch, and a frequent one once a task."""
    often: set[bytes] = set()
    for b in batches:
        counts = pc.value_counts(b.column(0))
        keys, n = counts.field("values"), counts.field("counts")
        frequent = keys.filter(pc.greater(n, b.num_rows * OFTEN)).to_pylist()
        if often:
            keys = keys.filter(pc.invert(pc.is_in(keys, pa.array(list(often), keys.type))))
        often = often | set(frequent) if len(often) < REMEMBERED else set(frequent)
        m = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, EARLIER, np.int32)), keys.cast(pa.binary()), pa.nulls(m, pa.int64())], ["phase", "key", "id"])


def _thin_incoming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key in a batch the first arrival; later ones have been seen, since this very task holds an earlier row of equal key."""
    often: dict[bytes, int] = {}
    top = np.iinfo(np.int64).max
    for b in batches:
        coded = b.column(0).dictionary_encode()
        at, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        ids = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.full(len(keys), top)
        np.minimum.at(first, at, ids)
        before = np.full(len(keys), top)
        if often:
            known = pc.index_in(keys, pa.array(list(often), keys.type)).to_numpy(zero_copy_only=False)
            there = ~np.isnan(known.astype(np.float64))
            before[there] = np.array(list(often.values()))[known[there].astype(np.int64)]
        new = np.flatnonzero(first < before)
        least = np.minimum(first, before)
        repeats = ids[ids > least[at]]
        counts = np.bincount(at, minlength=len(keys))
        frequent = np.flatnonzero(counts > b.num_rows * OFTEN)
        often = often if len(often) < REMEMBERED else {}
        often.update(zip(keys.take(pa.array(frequent)).to_pylist(), least[frequent].tolist()))
        phase = np.repeat(np.array([ARRIVAL, REPEAT], np.int32), [len(new), len(repeats)])
        key = pa.concat_arrays([keys.take(pa.array(new)).cast(pa.binary()), pa.nulls(len(repeats), pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(phase), key, pa.array(np.concatenate([first[new], repeats]))], ["phase", "key", "id"])


def keyed_rows(earlier: DataFrame, incoming: DataFrame) -> DataFrame:
    """``phase, key, id`` of all rows with a key, without the repeats that a task sees by itself.

    Nothing is grouped and nothing moves: a task drops repeats within an Arrow
    batch and of the few keys that are frequent in it, so that a key with a third
    of all rows comes to about a row a task, and passes all else on. Arrivals that
    repeat an earlier one of their task are answered by that (``REPEAT``, without
    key). Rows without a key or an ``incoming_id`` are left out; a row that comes
    twice under the same id repeats nothing.
    """
    shape = "phase int, key binary, id long"
    old = earlier.filter("key is not null").select(F.col("key").cast("binary").alias("key")).mapInArrow(_thin_earlier, shape)
    new = incoming.filter("key is not null and incoming_id is not null").select(F.col("key").cast("binary").alias("key"), F.col("incoming_id").cast("long").alias("id"))
    return old.unionByName(new.mapInArrow(_thin_incoming, shape))


def layout(n_keys: int, tasks: int, keys_per_filter: int = KEYS_PER_FILTER) -> tuple[int, int]:
    """Number of filters, and the keys each is sized for.

    ``n_keys`` is an estimate good to a few per cent. Keys fall on filters by
    hash; the allowance is a twentieth for the estimate and six standard
    deviations for the fall.
    """
    n = max(FILTERS_A_TASK * tasks, math.ceil(n_keys / keys_per_filter))
    mean = max(1.0, 1.05 * n_keys / n)
    return n, math.ceil(mean + 6 * math.sqrt(mean))


def bloom_answers(
    rows: DataFrame, absent: DataFrame | None = None, target_fp: float = TARGET_FP, keys_per_filter: int | None = None, shape: tuple[int, int] | None = None, start: DataFrame | None = None, keep: bool = False
) -> DataFrame:
    """``phase, key, id, seen``: what the filters answer for each arrival and each known absent key.

    ``rows``: :func:`keyed_rows`, read twice, so best a written table. Its keys
    are counted by a sketch to size the filters. Keys go to filters by hash, many
    filters to a task, which fills one after the other: first with the earlier
    keys, then every arrival is queried and inserted in the order of ``id``.
    ``absent``: keys (column ``key``) that are queried at the end and never
    inserted. Only the bits of one filter and one Arrow batch are in memory.

    ``shape``: number of filters and keys each is sized for, if given from an
    earlier run; ``start``: that run's filters (``filter_no, words``), which are
    gone on with. With ``keep`` the filters come out too, as rows of phase
    ``AFTER`` with the number as ``id`` and the bits as ``key``.
    """
    spark = rows.sparkSession
    asked = rows.filter(F.col("phase") != REPEAT)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_filters, per_filter = shape or layout(asked.agg(F.approx_count_distinct("key", 0.01)).first()[0], tasks)
    per_filter = keys_per_filter or per_filter
    if absent is not None:
        asked = asked.unionByName(absent.select(F.lit(ABSENT).alias("phase"), "key", F.lit(None).cast("long").alias("id")))
    h1 = F.xxhash64("key")
    hashed = asked.select("phase", "key", "id", h1.alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), (h1.bitwiseAND(F.lit(0xFFFFFFFF)) % n_filters).cast("int").alias("filter_no"))
    if start is not None:
        none = F.lit(0).cast("long")
        hashed = hashed.unionByName(start.select(F.lit(BEFORE).alias("phase"), F.col("words").alias("key"), none.alias("id"), none.alias("h1"), none.alias("h2"), F.col("filter_no").cast("int")))
    placed = hashed.repartitionById(tasks, F.col("filter_no") % tasks).sortWithinPartitions("filter_no", "phase", "id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bloom = None, None

        def after() -> pa.RecordBatch:
            held = pa.array([bloom.words.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([AFTER], pa.int32()), held, pa.array([int(current)], pa.int64()), pa.array([False])], ["phase", "key", "id", "seen"])

        for b in batches:
            phase, h1, h2, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("phase", "h1", "h2", "filter_no"))
            seen = np.zeros(b.num_rows, bool)
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if high == low:
                    continue
                if number[low] != current:
                    if keep and bloom:
                        yield after()
                    current, bloom = number[low], BlockedBloom(per_filter, target_fp)
                first, old, new = low + np.searchsorted(phase[low:high], [EARLIER, ARRIVAL, ABSENT])
                if first > low:  # one row a filter
                    bloom.words = np.frombuffer(b.column("key")[low].as_py(), np.uint64).copy()
                bloom.insert(h1[first:old], h2[first:old])
                seen[old:new] = bloom.query_then_insert(h1[old:new], h2[old:new])
                seen[new:high] = bloom.contains(h1[new:high], h2[new:high])
            yield pa.RecordBatch.from_arrays([b.column("phase"), b.column("key").cast(pa.binary()), b.column("id"), pa.array(seen)], ["phase", "key", "id", "seen"]).filter(pa.array(phase > EARLIER))
        if keep and bloom:
            yield after()

    return placed.mapInArrow(decide, "phase int, key binary, id long, seen boolean")


class KeptFilters:
    """Filters that go on from run to run, so that earlier keys need not be read again to be asked for.

    Each run's filters are written to a new folder and published by one rename
    together with the run's name; a run that is repeated under its name answers
    from the filters it started with, so the answers are the same. The filters are
    sized once for ``planned`` keys; ``load`` says how many are in them, beyond the
    plan the rate of wrong answers rises and they should be built anew.
    """

    def __init__(self, spark: SparkSession, path: str, planned: int, target_fp: float = TARGET_FP):
        self.spark, self.path, self.target_fp = spark, path.rstrip("/"), target_fp
        self.versions = VersionLog(spark, f"{self.path}/versions")
        self.shape = layout(planned, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _filters(self, folder: str) -> DataFrame:
        return self.spark.read.schema("id long, key binary").parquet(f"{self.path}/filters/{folder}").selectExpr("id as filter_no", "key as words")

    def answer(self, rows: DataFrame, run: str) -> DataFrame:
        """The answers of :func:`bloom_answers` for the rows of a run, against all runs before it."""
        base = self.versions.current()
        state = self.versions.read(base)
        done = state.get("run") == run
        before = state.get("before") if done else state.get("folder")
        shape = tuple(state.get("shape", self.shape))
        out = settle(bloom_answers(rows, None, self.target_fp, shape=shape, start=self._filters(before) if before else None, keep=not done), "kept-answers")
        if not done:
            folder = uuid.uuid4().hex
            out.filter(F.col("phase") == AFTER).select("id", "key").write.parquet(f"{self.path}/filters/{folder}")
            self.versions.publish(base, {"run": run, "before": before, "folder": folder, "shape": list(shape)})
        return out.filter(F.col("phase") != AFTER)

    def load(self) -> float:
        """The share of bits that are set; about a half is what filters have that hold what they were planned for."""
        folder = self.versions.read().get("folder")
        if not folder:
            return 0.0

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = [np.frombuffer(w, np.uint64) for w in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([int(np.bitwise_count(w).sum()) for w in words], pa.int64()), pa.array([64 * len(w) for w in words], pa.int64())], ["ones", "bits"])

        ones, bits = self._filters(folder).select("words").mapInArrow(count, "ones long, bits long").agg(F.sum("ones"), F.sum("bits")).first()
        return ones / bits


def verified(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``key, id`` of the arrivals that the filters rightly claim to have seen.

    Only claimed keys are looked up: the rows of those keys are cut out by a
    semi-join and reduced to whether the key is an earlier one and to its first
    arrival, partly before they move.
    """
    claimed = answers.filter((F.col("phase") == ARRIVAL) & F.col("seen")).select("key", "id")
    evidence = (
        rows.filter(F.col("phase") != REPEAT)
        .join(claimed.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.max((F.col("phase") == EARLIER).cast("int")).alias("old"), F.min("id").alias("first"))
    )
    return claimed.join(evidence, "key").filter("old = 1 or first < id").select("key", "id")


def seen_before(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``incoming_id`` of each row whose key occurred before, exactly.

    A filter that denies a key is right: such an arrival is new. What the filters
    claim is checked, and what a task found to repeat its own rows is added.
    """
    repeats = rows.filter(F.col("phase") == REPEAT).select("id")
    return verified(rows, answers).select("id").unionByName(repeats).select(F.col("id").alias("incoming_id")).distinct()


def absent_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur in no row: each real key with a byte appended.

    They resemble the real ones; the few that exist are removed by an anti-join.
    There are about as many as distinct keys, so the error is measured over all
    parts of all filters.
    """
    keys = rows.filter("key is not null").select("key").distinct()
    return keys.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key")).join(keys, "key", "left_anti")


def error_rate(rows: DataFrame, answers: DataFrame, target_fp: float = TARGET_FP) -> DataFrame:
    """Measured wrong answers, in one row.

    ``n_probes``, ``n_wrong``, ``rate``: known absent keys that were taken for seen
    ones; ``n_new``, ``n_new_wrong``, ``new_rate``: the same of the arrivals that
    were in truth the first of their key. A rate is null if there was nothing to
    measure.
    """
    claims = F.coalesce(F.col("seen").cast("long"), F.lit(0).cast("long"))
    told = answers.select((F.col("phase") == ABSENT).alias("absent"), claims.alias("claim"), F.lit(0).alias("right"))
    both = told.unionByName(verified(rows, answers).select(F.lit(False).alias("absent"), F.lit(0).cast("long").alias("claim"), F.lit(1).alias("right")))
    total = lambda of, when: F.coalesce(F.sum(F.when(when, of)), F.lit(0))
    absent, right = F.col("absent"), F.col("right")
    sums = both.agg(
        total(F.lit(1), absent).alias("n_probes"), total(F.col("claim"), absent).alias("n_wrong"),
        total(F.when(right == 1, -1).otherwise(1), ~absent).alias("n_new"), total(F.col("claim") - right, ~absent).alias("n_new_wrong"),
    )
    return sums.select(
        "n_probes", "n_wrong", F.expr("try_divide(n_wrong, n_probes)").alias("rate"),
        "n_new", "n_new_wrong", F.expr("try_divide(n_new_wrong, n_new)").alias("new_rate"), F.lit(float(target_fp)).alias("target_rate"),
    )
