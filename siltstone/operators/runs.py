"""Sorted runs: writing, merging, dropping versions, metadata, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import codec
from siltstone.model import CHANGELOG, PUT
from siltstone.operators import ordered, read

#: Bytes that an entry's block frame takes besides key and value; the offset of an entry; entries end at the block size.
ENTRY_OFFSET = 4


def write_run(log: DataFrame, path: str, files: int | None = None, block_size: int = 4096, row_group: int = 64 << 20) -> None:
    """Write a changelog as files of disjoint ranges, sorted by key and newest first.

    Ranges are cut by key and number, so a key with very many versions fills
    several files. The page size follows the block size; a Parquet bloom filter
    and the sorted footer statistics let readers skip files and pages by key.
    """
    n = files or ordered.range_count(log)
    (
        log.repartitionByRange(n, F.asc("key"), F.desc("seq"))
        .sortWithinPartitions(F.asc("key"), F.desc("seq"))
        .write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", block_size)
        .option("compression", "lz4_raw")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).parquet(path)


def union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def merge(runs: list[DataFrame]) -> DataFrame:
    """All entries of the runs in store order."""
    return read.scan_versions(union(runs))


def merge_positions(runs: list[DataFrame]) -> DataFrame:
    """All entries of the runs with their ``position`` in the merged order, from 1."""
    return ordered.position(union(runs), [F.asc("key"), F.desc("seq")])


def compact_bottom(log: DataFrame) -> DataFrame:
    """What remains at the lowest level: the newest version of each key, no tombstones."""
    return read.newest(log).filter(F.col("op") == PUT)


def compact(log: DataFrame, retained: int, bottom: bool = False) -> DataFrame:
    """Drop the versions that no reader at ``retained`` or later can see.

    All versions above it stay, and of those at or below it the newest of a key.
    That one may be dropped too if it is a delete and this is the ``bottom`` level.
    """
    above = log.filter(F.col("seq") > retained).select("key", "seq", "op", "value")
    base = read.newest(log.filter(F.col("seq") <= retained))
    return above.unionByName(base.filter(F.col("op") == PUT) if bottom else base)


def compact_entries(entries: DataFrame, retained: int, bottom: bool = False) -> DataFrame:
    """The same for entries with pointers into value logs; no value is fetched."""
    held = [c for c in entries.columns if c not in ("key", "run")]
    above = entries.filter(F.col("seq") > retained).select("key", *held)
    top = F.max(F.struct("seq", "op", *[c for c in held if c not in ("seq", "op")])).alias("v")
    base = entries.filter(F.col("seq") <= retained).groupBy("key").agg(top).select("key", *[F.col(f"v.{c}").alias(c) for c in held])
    return above.unionByName(base.filter(F.col("op") == PUT) if bottom else base)


def drop_exact_repeats(log: DataFrame, smallest_seq: int) -> DataFrame:
    """Drop repeats of the same (key, seq, op), but only below ``smallest_seq``."""
    old, new = log.filter(F.col("seq") < smallest_seq), log.filter(F.col("seq") >= smallest_seq)
    return old.dropDuplicates(["key", "seq", "op"]).unionByName(new)


def metadata(log: DataFrame, file_col: str = "file_no") -> DataFrame:
    """One row a file: entry count, bytes, smallest and largest internal key."""
    ik = codec.internal_key("key", "seq", "op")
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
    first = F.min(F.struct(F.col("key"), (-F.col("seq")).alias("s"), ik.alias("ik"))).alias("first")
    last = F.max(F.struct(F.col("key"), (-F.col("seq")).alias("s"), ik.alias("ik"))).alias("last")
    return (
        log.groupBy(file_col)
        .agg(F.count("*").alias("n_entries"), F.sum(size).alias("file_size"), first, last)
        .select(file_col, "n_entries", "file_size", F.col("first.ik").alias("smallest"), F.col("last.ik").alias("largest"))
    )


def zone_prune(files: DataFrame, key) -> DataFrame:
    """Files whose user-key range covers ``key``."""
    return files.filter((codec.user_key("smallest") <= key) & (codec.user_key("largest") >= key))


def key_ranges(files: DataFrame, id_col: str) -> DataFrame:
    return files.select(F.col(id_col).alias("id"), codec.user_key("smallest").alias("lo"), codec.user_key("largest").alias("hi"))


def overlaps(files: DataFrame, id_col: str = "file_no") -> DataFrame:
    """For each file, how many other files share part of its key range."""
    r = key_ranges(files, id_col)
    return ordered.overlap_counts(r, r).select(F.col("id").alias(id_col), (F.col("n") - 1).alias("n_overlaps"))


def overlap_groups(files: DataFrame, id_col: str = "file_no") -> DataFrame:
    """Files that a chain of overlaps connects, as ``group_no`` from 1 in key order.

    A file opens a group if it starts after the end of all files before it.
    """
    r = key_ranges(files, id_col).filter("lo is not null and hi is not null")
    order = [F.asc("lo"), F.asc("hi"), F.asc("id")]
    opened = ordered.running(r, order, {"reach": ("max", F.col("hi"))})
    opened = opened.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), 1).otherwise(0)).drop("reach")
    return ordered.running(opened, order, {"group_no": ("sum", F.col("opens"))}, inclusive=True).select(F.col("id").alias(id_col), F.col("group_no").cast("long").alias("group_no"))


def blocks(log: DataFrame, block_size: int = 4096, key_bytes: int = 4, value_bytes: int = 4) -> DataFrame:
    """Entries of one sorted run with ``position`` and ``block``, for entries of one width.

    An entry is the varint lengths, the internal key and the tagged value; a block
    is cut once entries and offsets reach the block size.
    """
    entry = 1 + key_bytes + 8 + 1 + 1 + value_bytes
    per_block = max(1, -(-(block_size - ENTRY_OFFSET) // (entry + ENTRY_OFFSET)))
    placed = ordered.position(log.select("key", "seq", "op"), [F.asc("key"), F.desc("seq")])
    return placed.withColumn("block", F.floor((F.col("position") - 1) / per_block).cast("long"))


def cut_blocks(log: DataFrame, file_col: str = "file_no", block_size: int = 4096) -> DataFrame:
    """``file_no, key, seq, op, block``: the block of each entry of sorted files, for entries of any width.

    An entry takes the varint lengths, the internal key and the tagged value
    (:func:`codec.entry_size`), and four bytes for its offset; a block is cut after
    the entry that brings it to the block size. Each cut depends on the one
    before, so the sizes of a file (which is of bounded size) are walked in one
    task; keys and values stay where they are.
    """
    order = [F.asc("key"), F.desc("seq"), F.desc("op")]
    sized = log.select(file_col, "key", "seq", "op", codec.entry_size("key", "value").alias("_size"))
    placed = sized.withColumn("_i", F.row_number().over(W.partitionBy(file_col).orderBy(*order)))

    def walk(f):
        f = f.sort_values("_i")
        held, block, at = ENTRY_OFFSET, 0, []
        for size in f["_size"].tolist():
            at.append(block)
            held += size + ENTRY_OFFSET
            if held >= block_size:
                held, block = ENTRY_OFFSET, block + 1
        return f[[file_col, "_i"]].assign(block=at)

    kind = dict(sized.dtypes)[file_col]
    cut = placed.select(file_col, "_i", "_size").groupBy(file_col).applyInPandas(walk, f"{file_col} {kind}, _i int, block long")
    return placed.join(cut, [file_col, "_i"]).select(file_col, "key", "seq", "op", "block")


def block_index(blocked: DataFrame) -> DataFrame:
    """The last internal key of each block."""
    last = F.max(F.struct("position", codec.internal_key("key", "seq", "op").alias("ik")))
    return blocked.groupBy("block").agg(last.alias("v")).select("block", F.col("v.ik").alias("last_key"))


def index_seek(index: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, block``: the first block that may hold each key, null beyond the last.

    A running minimum over keys and block ends in falling order, so no pair of
    key and block is made.
    """
    none = F.lit(None).cast("long")
    ends = index.select(codec.user_key("last_key").alias("at"), F.lit(0).alias("turn"), F.col("block").alias("b"))
    asked = keys.filter("key is not null").select("key").distinct().select(F.col("key").alias("at"), F.lit(1).alias("turn"), none.alias("b"))
    placed = ordered.running(ends.unionByName(asked), [F.desc("at"), F.asc("turn"), F.desc("b")], {"block": ("min", F.col("b"))})
    return placed.filter("turn = 1").select(F.col("at").alias("key"), "block")


def seek_misses(log: DataFrame, keys: DataFrame, allowed: int = 100, file_col: str = "file_no") -> DataFrame:
    """For each file, look-ups that its key range let through but that found nothing.

    ``file_no, probes, hits, misses, compact``; ``compact`` is true from more than
    ``allowed`` misses on.
    """
    asked = keys.filter("key is not null").select("key").distinct()
    ranges = log.groupBy(F.col(file_col).alias("id")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    points = asked.select(F.lit(None).cast("long").alias("id"), F.col("key").alias("lo"), F.col("key").alias("hi"))
    probes = ordered.overlap_counts(ranges, points).withColumnRenamed("n", "probes")
    hits = log.join(asked, "key", "left_semi").select(F.col(file_col).alias("id"), "key").distinct().groupBy("id").agg(F.count("*").alias("hits"))
    out = probes.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    misses = F.col("probes") - F.col("hits")
    return out.select(F.col("id").alias(file_col), "probes", "hits", misses.alias("misses"), (misses > allowed).alias("compact"))
