"""The store's bloom filters: building, probing, and reading stored ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import codec


def bits_per_key(fp: float) -> int:
    """Bits a key for a rate of wrong answers."""
    return math.ceil(-math.log(fp) / math.log(2) ** 2) if 0 < fp < 1 else 0


def probes(bits: int) -> int:
    """Hash steps for so many bits a key: between 1 and 30."""
    return int(min(30.0, max(1.0, bits * math.log(2))))


#: Up to so many bytes of the longest key the hash is written out as plain arithmetic.
WRITTEN_OUT = 64


def longest_key(keys: DataFrame) -> int | None:
    """Bytes of the longest key if the hash can be written out for it."""
    n = keys.agg(F.max(F.octet_length("key"))).first()[0] or 0
    return n if n <= WRITTEN_OUT else None


def build(keys: DataFrame, by: list[str], bits: int) -> DataFrame:
    """``by..., nbits, bit``: the bits that are set in the filter of each group.

    The size follows from the number of rows of the group, at least 64 bits, in
    whole bytes. Null keys set nothing. Groups are counted and keys made distinct
    before anything moves.
    """
    counts = keys.groupBy(*by, "key").agg(F.count("*").alias("n"))
    sizes = keys.groupBy(*by).agg(F.count("*").alias("n")).select(*by, (F.ceil(F.greatest(F.col("n") * bits, F.lit(64)) / 8) * 8).cast("long").alias("nbits"))
    hashed = codec.with_bloom_hash(counts.filter("key is not null"), "key", "h", longest_key(keys)).select(*by, "h").join(sizes, by)
    return hashed.select(*by, "nbits", F.explode(codec.bloom_positions(F.col("h"), probes(bits), F.col("nbits"))).alias("bit")).distinct()


def pack(set_bits: DataFrame, by: list[str], bits: int) -> DataFrame:
    """``by..., filters``: the filters of :func:`build` as stored: the bit array, then the number of steps.

    A filter is one value, so a group should be a file's keys, as stored ones are.
    """
    per = set_bits.groupBy(*by, "nbits", F.floor(F.col("bit") / 8).cast("int").alias("at")).agg(F.sum(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("byte"))
    whole = per.groupBy(*by, "nbits").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"))
    text = F.transform(F.sequence(F.lit(0), (F.col("nbits") / 8).cast("int") - 1), lambda i: F.lpad(F.hex(F.coalesce(F.col("m")[i], F.lit(0).cast("long"))), 2, "0"))
    return whole.select(*by, F.unhex(F.concat(F.array_join(text, ""), F.lit(f"{probes(bits):02X}"))).alias("filters"))


def usable(filters: DataFrame) -> DataFrame:
    """``number, filters``: one stored filter a file, without null and empty ones."""
    return filters.filter("number is not null and octet_length(filters) > 1").groupBy("number").agg(F.max("filters").alias("filters"))


def may_contain(filter_col: Column, h: Column, most: int | None = None) -> Column:
    """Whether a stored filter (bits, then the number of steps) may hold a key of hash ``h``.

    True for more than 30 steps; false for an empty filter; null for a null one
    or a null key. ``most``: the largest number of steps of any filter up to 30,
    if known; then the probes are written out.
    """
    n = F.octet_length(filter_col)
    byte = lambda at: F.conv(F.hex(filter_col.substr(at, F.lit(1))), 16, 10).cast("int")
    k, nbits = byte(n), (n - 1).cast("long") * 8
    is_set = lambda p: F.floor(byte((F.floor(p / 8) + 1).cast("int")) / F.pow(F.lit(2), p % 8)) % 2 == 1
    if most is None:
        all_set = F.forall(codec.bloom_positions(h, k, nbits), is_set)
    else:
        step, all_set = (F.shiftright(h, 17) + F.shiftleft(h, 15)) % codec.U32, F.lit(True)
        for i in range(most):
            all_set = all_set & ((k <= i) | is_set((h + i * step) % codec.U32 % nbits))
    return F.when(h.isNull() | n.isNull(), F.lit(None)).when(n < 2, False).when((k > 30) | (k < 1), True).otherwise(all_set)


def check_stored(filters: DataFrame, entries: DataFrame) -> DataFrame:
    """``number, n_keys, n_denied``: own keys that a file's stored filter denies; none should be."""
    own = entries.filter("number is not null and key is not null").select("number", "key").distinct()
    stored = usable(filters)
    steps = F.conv(F.hex(F.col("filters").substr(F.octet_length("filters"), F.lit(1))), 16, 10).cast("int")
    most = stored.agg(F.max(F.when(steps <= 30, steps))).first()[0] or 0
    hashed = codec.with_bloom_hash(own, "key", "h", longest_key(entries)).select("number", "h")
    asked = hashed.join(stored, "number")
    return asked.groupBy("number").agg(F.count("*").alias("n_keys"), F.count(F.when(~may_contain(F.col("filters"), F.col("h"), most), 1)).alias("n_denied"))
