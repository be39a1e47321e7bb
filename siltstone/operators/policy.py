"""When and what to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import ordered, runs

#: Files at level 0, and bytes at level 1, from which on a level is compacted; each further level holds ten times more.
L0_FILES, L1_BYTES, LEVEL_FACTOR = 4, 1 << 20, 10
#: The lowest level that a flush may write to.
MAX_FLUSH_LEVEL = 2


def score(level: int, n_files: int, size: int) -> float:
    """How full one level is; from 1 on it is due."""
    return n_files / L0_FILES if level == 0 else size / (L1_BYTES * LEVEL_FACTOR ** (level - 1))


def level_scores(files: DataFrame) -> DataFrame:
    """``level, n_files, bytes, score, chosen``; chosen is the highest score if it is 1 or more.

    Of equal scores the upper level (the smaller number) is chosen. There are a
    handful of levels, so their comparison is one small task.
    """
    per = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").cast("long").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("n_files") / L0_FILES).otherwise(F.col("bytes") / (L1_BYTES * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level") - 1)))
    scored = per.withColumn("score", score)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "level"))
    return scored.withColumn("chosen", (rank == 1) & (F.col("score") >= 1))


def flush_level(new: DataFrame, files: DataFrame, id_col: str = "number") -> DataFrame:
    """``id, level``: where each flushed file goes.

    Level 0 if it overlaps a file there; else down as long as the next level has
    no overlap, to level 2 at most. A file does not overlap itself.
    """
    flags = [F.when(F.col("level") == n, 1).otherwise(0).alias(f"l{n}") for n in range(MAX_FLUSH_LEVEL + 1)]
    ranges = runs.key_ranges(files, id_col).join(files.select(F.col(id_col).alias("id"), *flags), "id")
    counted = ordered.overlap_counts(runs.key_ranges(new, id_col), ranges, [f"l{n}" for n in range(MAX_FLUSH_LEVEL + 1)])
    own = files.select(F.col(id_col).alias("id"), F.col("level").alias("own"))
    at = counted.join(own, "id", "left")
    free = [F.col(f"n_l{n}") - F.when(F.col("own") == n, 1).otherwise(0) == 0 for n in range(MAX_FLUSH_LEVEL + 1)]
    level = F.when(~free[0], 0)
    for n in range(1, MAX_FLUSH_LEVEL + 1):
        level = level.when(~free[n], n - 1)
    return at.select(F.col("id").alias(id_col), level.otherwise(MAX_FLUSH_LEVEL).alias("level"))


def place_run(low: bytes, high: bytes, runs: list[tuple[int, bytes, bytes]]) -> int:
    """The level of one flushed run, by the rule of :func:`flush_level`, against ``(level, low, high)`` of the runs of a manifest in memory."""
    met = {level for level, a, b in runs if a <= high and b >= low}
    if 0 in met:
        return 0
    return next((n - 1 for n in range(1, MAX_FLUSH_LEVEL + 1) if n in met), MAX_FLUSH_LEVEL)


def inputs(files: DataFrame, seed: int | None = None, id_col: str = "number") -> DataFrame:
    """``number, side`` of the files to compact together ('base' and 'target').

    From level 0 the group of files that a chain of overlaps connects with the
    first (or ``seed``), from a lower level that file alone; and from the next
    level all that overlap the key range they cover. Empty if no level is due.
    """
    if seed is None:
        due = level_scores(files).filter("chosen").select("level").first()
        if due is None:
            return files.select(F.col(id_col), F.lit("base").alias("side")).limit(0)
        level = due[0]
    else:
        found = files.filter(F.col(id_col) == seed).select("level").first()
        if found is None:
            return files.select(F.col(id_col), F.lit("base").alias("side")).limit(0)
        level = found[0]
    own = files.filter(F.col("level") == level)
    if level == 0:
        groups = runs.overlap_groups(own, id_col)
        start = groups.filter(F.col(id_col) == seed) if seed is not None else groups.filter("group_no = 1")
        base = groups.join(start.select("group_no").distinct(), "group_no").select(id_col)
    else:
        base = own.filter(F.col(id_col) == seed).select(id_col) if seed is not None else own.orderBy(id_col).limit(1).select(id_col)
    span = runs.key_ranges(own.join(base, id_col), id_col).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    below = runs.key_ranges(files.filter(F.col("level") == level + 1), id_col)
    target = below.filter((F.col("lo") <= F.lit(span["hi"])) & (F.col("hi") >= F.lit(span["lo"]))) if span["lo"] is not None else below.limit(0)
    return base.withColumn("side", F.lit("base")).unionByName(target.select(F.col("id").alias(id_col), F.lit("target").alias("side")))
