"""A store in a directory: log, sorted runs, value logs, and a manifest."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import codec
from siltstone.model import CHANGELOG, FILE_META, Options
from siltstone.operators import manifest, policy, runs, valuelog, write
from siltstone.sources.cache import TableCache
from siltstone.sources.files import ENTRIES, RECORDS, read_folders, read_numbered
from siltstone.sources.versions import VersionLog

#: Size at which a new value log begins.
VLOG_SIZE = 256 << 20
#: Runs at level 0 that a read has to look into before a compaction is asked for.
L0_READ_RUNS = 5


def _coded(b: bytes) -> str:
    return base64.b64encode(b).decode()


class View:
    """What a reader sees of one version of the manifest; later writes don't change it."""

    def __init__(self, spark: SparkSession, options: Options, version: int | None = None):
        self.spark, self.options = spark, options
        self.dir = options.work_dir.rstrip("/")
        self.manifest = VersionLog(spark, f"{self.dir}/manifest")
        self.misses: dict[int, int] = {}
        self.cache = TableCache(options.cache_size)
        self._load(version)

    def _load(self, version: int | None = None) -> None:
        self.version = self.manifest.current() if version is None else version
        self.state = {"next_seq": 0, "next_number": 1, **self.manifest.read(self.version)}

    def _named(self, kind: str) -> list[dict]:
        """The logs, runs or streams of the version; a name whose last edit is null is gone."""
        return [v for k, v in sorted(self.state.items()) if k.startswith(f"{kind}-") and v is not None]

    @property
    def logs(self) -> list[dict]:
        return self._named("log")

    @property
    def runs(self) -> list[dict]:
        return sorted(self._named("run"), key=lambda r: r["number"])

    @staticmethod
    def _bounds(run: dict) -> tuple[bytes, bytes]:
        """The smallest and largest user key of a run."""
        return base64.b64decode(run["smallest"])[:-8], base64.b64decode(run["largest"])[:-8]

    def runs_for(self, low: bytes | None = None, high: bytes | None = None) -> list[dict]:
        """The runs whose key range meets ``low`` to ``high``, by the bounds that the manifest holds; None is no bound."""
        met = []
        for r in self.runs:
            a, b = self._bounds(r)
            if (high is None or a <= high) and (low is None or b >= low):
                met.append(r)
        return met

    def files(self) -> DataFrame:
        """The runs in the form of file metadata, for the policies."""
        rows = [(r["number"], r["level"], r["bytes"], base64.b64decode(r["smallest"]), base64.b64decode(r["largest"]), r["vlogs"]) for r in self.runs]
        return self.spark.createDataFrame(rows, FILE_META).withColumnRenamed("file_no", "number")

    # --- reading ---------------------------------------------------------

    def _entries(self, chosen: list[dict] | None = None) -> DataFrame:
        """Keys and pointers of the log and the chosen runs (all by default), one scan each, with ``run`` (null: log); large values are not touched."""
        return self._fresh().unionByName(self._stored(self.runs if chosen is None else chosen))

    def _fresh(self) -> DataFrame:
        log = read_folders(self.spark, [x["path"] for x in self.logs], CHANGELOG)
        none = F.lit(None).cast("long")
        return log.select("key", "seq", "op", F.col("value").alias("value_inline"), none.alias("vlog_run"), none.alias("vlog_fid"), none.alias("vlog_off"), none.alias("run"))

    def _stored(self, chosen: list[dict]) -> DataFrame:
        return read_numbered(self.spark, f"{self.dir}/runs", [r["number"] for r in chosen], ENTRIES, "run")

    @contextmanager
    def _kept(self, chosen: list[dict]) -> Iterator[DataFrame]:
        """The entries of the chosen runs, small ones from memory, where they stay pinned meanwhile."""
        small = [r for r in chosen if r["bytes"] <= self.cache.share]
        out = self._stored([r for r in chosen if r["bytes"] > self.cache.share])
        for r in small:
            out = out.unionByName(self.cache.get_or_make(f"run-{r['number']}", lambda r=r: self._stored([r]), r["bytes"]))
        try:
            yield out
        finally:
            for r in small:
                self.cache.unpin(f"run-{r['number']}")

    def _newest(self, entries: DataFrame) -> DataFrame:
        """The newest version of each key with its value: versions are compared before values are fetched."""
        top = entries.groupBy("key").agg(F.max(F.struct("seq", "op", "value_inline", "vlog_run", "vlog_fid", "vlog_off")).alias("v")).select("key", "v.*")
        return self._resolve(top)

    def _resolve(self, entries: DataFrame) -> DataFrame:
        logs = sorted({v for r in self.runs for v in r["vlogs"]})
        if not logs:
            return entries.select("key", "seq", "op", F.col("value_inline").alias("value"))
        records = read_numbered(self.spark, f"{self.dir}/vlogs", logs, RECORDS, "vlog_run")
        return valuelog.resolve(entries, records, ["vlog_run", "vlog_fid", "vlog_off"])

    def log(self) -> DataFrame:
        """All versions that are kept, as a changelog."""
        return self._resolve(self._entries())

    def snapshot(self, seq: int | None = None) -> DataFrame:
        """``key, seq, value`` of the live keys, as of ``seq`` if given.

        A compaction keeps the versions from its snapshot on; older ones are gone.
        """
        entries = self._entries() if seq is None else self._entries().filter(F.col("seq") <= seq)
        return self._newest(entries).filter("op = 1").select("key", "seq", "value")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``key, found, seq, value`` of each distinct requested key; only runs that meet the range of the keys are read."""
        wanted = keys.filter("key is not null").select("key").distinct()
        low, high = wanted.agg(F.min("key"), F.max("key")).first()
        chosen = [] if low is None else self.runs_for(bytes(low), bytes(high))
        hits = self._newest(self._entries(chosen).join(wanted, "key", "left_semi")).filter("op = 1").select("key", "seq", "value")
        return wanted.join(hits, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "seq", "value")

    def get(self, key: bytes, seq: int | None = None) -> bytes | None:
        """The value of one key, None if it is missing or deleted.

        Runs are pruned by the manifest, files and pages by the pushed key. A run
        that was looked into and holds no version of the key is a fruitless probe,
        which counts towards a compaction of that run. The value log is read only
        for the one pointer that is followed.
        """
        literal = F.lit(bytearray(key))
        chosen = self.runs_for(key, key)
        top = F.max(F.struct("seq", "op", "value_inline", "vlog_run", "vlog_fid", "vlog_off")).alias("v")
        with self._kept(chosen) as stored:
            entries = self._fresh().unionByName(stored).filter(F.col("key") == literal)
            if seq is not None:
                entries = entries.filter(F.col("seq") <= seq)
            row = entries.agg(top, F.collect_set("run").alias("hit")).first()
        for r in chosen:
            if r["number"] not in row["hit"]:
                self.misses[r["number"]] = self.misses.get(r["number"], 0) + 1
        v = row["v"]
        if v is None or v["op"] != 1:
            return None
        if v["vlog_run"] is None:
            return bytes(v["value_inline"])
        at = read_folders(self.spark, [f"{self.dir}/vlogs/{v['vlog_run']}"], RECORDS)
        return bytes(at.filter((F.col("vlog_fid") == v["vlog_fid"]) & (F.col("vlog_off") == v["vlog_off"])).select("value").first()[0])

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """``key, value`` with ``low <= key < high`` in key order."""
        entries = self._entries(self.runs_for(low, high))
        if low is not None:
            entries = entries.filter(F.col("key") >= F.lit(bytearray(low)))
        if high is not None:
            entries = entries.filter(F.col("key") < F.lit(bytearray(high)))
        return self._newest(entries).filter("op = 1").select("key", "value").orderBy("key")

    def note_misses(self, keys: DataFrame) -> DataFrame:
        """Count the fruitless probes of many keys; ``run, probes, hits, misses`` of the runs."""
        stored = self._stored(self.runs).select("run", "key")
        found = runs.seek_misses(stored, keys, self.options.allow_miss_count, "run").drop("compact")
        for r in found.collect():  # one row a run
            self.misses[r["run"]] = self.misses.get(r["run"], 0) + r["misses"]
        return found


class Store(View):
    """Versioned key/value data with one writer and any number of readers.

    Every write is a folder of log rows, every flush and compaction a folder of
    sorted files; a write counts once the manifest names its folder, by one
    rename. So a batch is there as a whole or not at all, an interrupted job
    leaves only folders that nobody reads, and opening the directory again finds
    the last published state. Deletes are rows of their own and stay until a
    compaction to the lowest level drops them.
    """

    @classmethod
    def open(cls, spark: SparkSession, options: Options) -> Store:
        """Open a directory, and make it if it is not there."""
        return cls(spark, options)

    def _publish(self, **changes: object) -> None:
        """Make the changed names an edit of the current version."""
        self.version = self.manifest.publish(self.version, changes)
        self.state = {**self.state, **changes}

    # --- writing ---------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> None:
        self.write_batch(write.WriteBatch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.write_batch(write.WriteBatch().delete(key))

    def write_batch(self, batch: write.WriteBatch) -> None:
        """Apply the operations in order and together."""
        if len(batch):
            size = sum(len(k) + len(v or b"") for k, _, v in batch.ops)
            path = f"{self.dir}/log/{uuid.uuid4().hex}"
            batch.to_df(self.spark, self.state["next_seq"]).coalesce(1).write.parquet(path)
            self._log(path, len(batch), size)

    def write(self, ops: DataFrame) -> None:
        """Apply many batches at once: ``batch_id, pos, key, op, value``, in the order of the first two."""
        self._write_numbered(write.number_batches(ops, self.state["next_seq"]))

    def _write_numbered(self, rows: DataFrame, **changes: object) -> None:
        path = f"{self.dir}/log/{uuid.uuid4().hex}"
        rows.select(*CHANGELOG.names).write.parquet(path)
        back = self.spark.read.schema(CHANGELOG).parquet(path)
        n, size = back.agg(F.count("*"), write.entry_bytes()).first()
        if n or changes:
            self._log(path, n, size, **changes)

    def _log(self, path: str, n: int, size: int, **changes: object) -> None:
        name = f"log-{self.state['next_seq']:020d}-{len(self.logs):06d}"
        self._publish(**{name: {"name": name, "path": path, "entries": n, "bytes": size}, "next_seq": self.state["next_seq"] + n}, **changes)
        if sum(x["bytes"] for x in self.logs) > self.options.mem_size:
            self.flush()

    def ingest(self, stream: str, query: str, number: int, ops: DataFrame) -> bool:
        """Apply micro-batch ``number`` of a stream once; False if it was applied before.

        The manifest keeps the query and the last number of each ``stream``, in the
        same version as the rows. Numbers mean the same only within one query: after
        a checkpoint was lost a new query counts from 0 again, over whatever is
        there then. So a batch of another query is refused, not passed over; such a
        feed has to go on under a name of its own, without what was applied.
        """
        last = self.state.get(f"stream-{stream}")
        if last is not None and last["query"] != query:
            raise ValueError(f"stream {stream} is fed by query {last['query']}, not by {query}: its checkpoint was lost or replaced")
        if last is not None and number <= last["number"]:
            return False
        self._write_numbered(write.number_batches(ops, self.state["next_seq"]), **{f"stream-{stream}": {"query": query, "number": number}})
        return True

    # --- maintenance -----------------------------------------------------

    def _write_run(self, log: DataFrame, level: int | None, size: int) -> dict | None:
        """Write sorted files, and the large values to value logs, under a new number; None if there are no rows.

        ``log``: a changelog; or entries with pointers into value logs, which are kept.
        Without a ``level`` it follows from the runs that the new one overlaps.
        """
        number = self.state["next_number"]
        at, own = f"{self.dir}/runs/{number}", F.lit(number).cast("long")
        if "value" in log.columns:
            split = valuelog.separate(log, f"{self.dir}/vlogs/{number}", max(1, -(-size // VLOG_SIZE)), self.options.kv_separate_threshold)
            entries = split.withColumn("vlog_run", F.when(F.col("vlog_fid").isNotNull(), own))
        else:
            entries = log
        files = max(1, -(-size // self.options.target_file_size))
        entries.select(*ENTRIES.names).repartitionByRange(files, F.asc("key"), F.desc("seq")).sortWithinPartitions(F.asc("key"), F.desc("seq")).write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#key", "true"
        ).option("parquet.page.size", self.options.block_size).option("compression", "lz4_raw").parquet(at)
        written = read_folders(self.spark, [at], ENTRIES)
        ik = codec.internal_key("key", "seq", "op")
        s = written.agg(
            F.count("*").alias("n"), F.collect_set("vlog_run").alias("vlogs"), F.min(F.struct("key", (-F.col("seq")).alias("s"), ik.alias("ik"))).alias("lo"),
            F.max(F.struct("key", (-F.col("seq")).alias("s"), ik.alias("ik"))).alias("hi"),
        ).first()
        if not s["n"]:
            return None
        low, high = bytes(s["lo"]["ik"]), bytes(s["hi"]["ik"])
        if level is None:
            level = policy.place_run(low[:-8], high[:-8], [(r["level"], *self._bounds(r)) for r in self.runs])
        return {"number": number, "level": level, "entries": s["n"], "bytes": size, "vlogs": sorted(s["vlogs"]), "smallest": _coded(low), "largest": _coded(high)}

    def _replace(self, run: dict | None, gone: list[dict], logs: list[dict] = (), **changes: object) -> None:
        """One edit: the new run in, old runs and logs out."""
        names = {f"run-{r['number']}": None for r in gone} | {x["name"]: None for x in logs}
        if run:
            names[f"run-{run['number']}"] = run
        self._publish(**names, next_number=self.state["next_number"] + 1, **changes)
        self.misses = {k: v for k, v in self.misses.items() if f"run-{k}" not in names}
        for r in gone:
            self.cache.evict(f"run-{r['number']}")

    def flush(self) -> None:
        """Move the log into a sorted run: to level 0 if it overlaps a run there, else down past the levels without overlap."""
        logs = self.logs
        if logs:
            fresh = read_folders(self.spark, [x["path"] for x in logs], CHANGELOG)
            self._replace(self._write_run(fresh, None, sum(x["bytes"] for x in logs)), [], logs)

    def _merge(self, inputs: list[dict], level: int, retained: int | None, rewrite: bool) -> None:
        chosen = {r["number"] for r in inputs}
        bottom = not [r for r in self.runs if r["number"] not in chosen]
        last = self.state["next_seq"] - 1 if retained is None else retained
        entries, size = self._stored(inputs), sum(r["bytes"] for r in inputs)
        if rewrite:
            merged = runs.compact(self._resolve(entries), last, bottom)
        else:
            merged = runs.compact_entries(entries, last, bottom)
        self._replace(self._write_run(merged, level, size), inputs)

    def compact(self, retained: int | None = None, full: bool = False) -> bool:
        """Merge the runs that the policy names, or all with ``full``; False if none is due.

        Versions that no reader at ``retained`` (the newest number by default) or
        later can see are dropped, and tombstones with them if nothing older is left
        below. From level 0 the new run takes over its inputs' value logs; from
        lower levels, and with ``full``, the values that are left are rewritten to
        one of its own.
        """
        if full:
            level = max((r["level"] for r in self.runs), default=0) or 1
            if not self.runs:
                return False
            self._merge(self.runs, level, retained, True)
            return True
        return self._compact_inputs(policy.inputs(self.files()), retained, 1)

    def _compact_inputs(self, picked: DataFrame, retained: int | None, least: int) -> bool:
        sides = {r["number"]: r["side"] for r in picked.collect()}  # one row a run
        inputs = [r for r in self.runs if r["number"] in sides]
        if len(inputs) < least:
            return False
        base = max(r["level"] for r in inputs if sides[r["number"]] == "base")
        self._merge(inputs, base + 1, retained, base >= 1)
        return True

    def compact_seek(self, retained: int | None = None) -> bool:
        """Compact a run with too many fruitless probes, the one with the most first, with what it overlaps.

        Its count starts anew; a run that nothing would be merged with stays as it
        is, and the next is tried. False if there is none.
        """
        there = {r["number"] for r in self.runs}
        for seed, n in sorted(self.misses.items(), key=lambda x: (-x[1], x[0])):
            if n >= self.options.allow_miss_count and seed in there:
                self.misses[seed] = 0
                if self._compact_inputs(policy.inputs(self.files(), seed), retained, 2):
                    return True
        return False

    def collect_garbage(self) -> int | None:
        """Rewrite the values of the run with the most value logs (two or more) to one of its own; returns the run's old number."""
        row = manifest.gc_candidate(self.files()).first()
        if row is None:
            return None
        old = next(r for r in self.runs if r["number"] == row["number"])
        self._replace(self._write_run(self._resolve(self._stored([old])), old["level"], old["bytes"]), [old])
        return old["number"]

    def requests(self) -> list[str]:
        """What is due: 'flush', 'major' (a level's score, or too many runs at level 0 to read), 'seek'."""
        due = ["flush"] if sum(x["bytes"] for x in self.logs) > self.options.mem_size else []
        levels: dict[int, list[int]] = {}
        for r in self.runs:
            levels.setdefault(r["level"], []).append(r["bytes"])
        if any(policy.score(level, len(sizes), sum(sizes)) >= 1 for level, sizes in levels.items()) or len(levels.get(0, [])) > L0_READ_RUNS:
            due.append("major")
        if any(n >= self.options.allow_miss_count for n in self.misses.values()):
            due.append("seek")
        return due

    def maintain(self, most: int = 100) -> list[str]:
        """Do what is due until nothing is, at most ``most`` steps; returns what was done."""
        done: list[str] = []
        for _ in range(most):
            for step in self.requests():
                if step == "flush":
                    self.flush()
                    done.append(step)
                    break
                if (self.compact if step == "major" else self.compact_seek)():
                    done.append(step)
                    break
            else:
                return done
        return done

    @contextmanager
    def pin(self, version: int | None = None) -> Iterator[View]:
        """A view of a version, by default the current one, whose files stay while it is in use."""
        view = View(self.spark, self.options, self.version if version is None else version)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/pins/{view.version:012d}-{uuid.uuid4().hex}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(at.getParent())
        fs.create(at, False).close()
        try:
            yield view
        finally:
            fs.delete(at, False)

    def pinned(self) -> list[int]:
        """The versions that readers hold."""
        return sorted({int(n.split("-")[0]) for n, _ in self._listed("pins")})

    def _listed(self, kind: str) -> list[tuple[str, object]]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(at)] if fs.exists(at) else []

    def purge(self) -> list[str]:
        """Remove the folders that neither the current nor a pinned version names, and manifest versions before those; returns the folders."""
        views = [self, *[View(self.spark, self.options, v) for v in self.pinned() if v < self.version]]
        named = {x["path"] for v in views for x in v.logs} | {f"{self.dir}/runs/{r['number']}" for v in views for r in v.runs}
        named |= {f"{self.dir}/vlogs/{n}" for v in views for r in v.runs for n in r["vlogs"]}
        removed = []
        for kind in ("log", "runs", "vlogs"):
            for name, at in self._listed(kind):
                path = f"{self.dir}/{kind}/{name}"
                if path not in named and at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True):
                    removed.append(path)
        self.manifest.expire(min(v.version for v in views))
        return removed

