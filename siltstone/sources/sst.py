"""Sorted-run files and record logs in the store's binary format, as a source and as column values.

A file is data blocks, the filter, the index block and a 16-byte footer. A block
is LZ4 after a little-endian length; inside are the entries, their offsets as
4-byte numbers, the number of offsets, and a CRC-32 of all that in 8 bytes. An
entry is two varint-framed strings: the internal key and a cell, which is a tag
with the value (0) or with a pointer of two 8-byte numbers into a value log (1).
Numbers are big-endian unless said otherwise.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block that its handle leaves out.
TRAILER = 8
INLINE, POINTER = 0, 1
ROWS = "number long, key binary, seq long, op int, value_inline binary, vlog_fid long, vlog_off long"


def _lz4() -> pa.Codec:
    return pa.Codec("lz4_raw")


def squeeze(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + _lz4().compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", data)
    return _lz4().decompress(data[4:], size, asbytes=True)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _framed(data: bytes, at: int) -> tuple[bytes, int]:
    """The string framed at ``at`` and the place after it."""
    size, shift = 0, 0
    while True:
        byte = data[at]
        at += 1
        size |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return data[at : at + size], at + size


def encode_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A block of (internal key, cell) in their order."""
    body, offsets = bytearray(), [0]
    for key, cell in entries:
        body += varint(len(key)) + key + varint(len(cell)) + cell
        offsets.append(len(body))
    body += struct.pack(f">{len(offsets) + 1}I", *offsets, len(offsets))
    return squeeze(bytes(body) + struct.pack(">Q", zlib.crc32(body)))


def decode_block(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The (internal key, cell) pairs of a block; a wrong checksum is an error."""
    body = unsqueeze(data)
    if zlib.crc32(body[:-8]) != struct.unpack(">Q", body[-8:])[0]:
        raise ValueError("the checksum of a block is wrong")
    (n,) = struct.unpack_from(">I", body, len(body) - 12)
    at, end = 0, len(body) - 12 - 4 * n
    while at < end:
        key, at = _framed(body, at)
        cell, at = _framed(body, at)
        yield key, cell


def encode_file(entries: list[tuple[bytes, bytes]], filters: bytes = b"", block_size: int = 4096) -> bytes:
    """A file of sorted (internal key, cell) pairs; blocks are cut once entries and offsets reach ``block_size``."""
    out, index, held, size = bytearray(), [], [], 4

    def cut() -> None:
        nonlocal held, size
        if held:
            block = encode_block(held)
            index.append((held[-1][0], struct.pack(">II", len(out), len(block) - TRAILER)))
            out.extend(block)
            held, size = [], 4

    for key, cell in entries:
        held.append((key, cell))
        size += len(varint(len(key))) + len(key) + len(varint(len(cell))) + len(cell) + 4
        if size >= block_size:
            cut()
    cut()
    footer = struct.pack(">II", len(out), len(filters))
    out += filters
    block = encode_block(index)
    footer += struct.pack(">II", len(out), len(block) - TRAILER)
    return bytes(out + block) + footer


def decode_footer(data: bytes) -> tuple[tuple[int, int], tuple[int, int]]:
    """Place and size of the filter and of the index block."""
    if len(data) < 16:
        raise ValueError("a file without a footer")
    f_at, f_size, i_at, i_size = struct.unpack(">4I", data[-16:])
    return (f_at, f_size), (i_at, i_size + TRAILER)


def decode_file(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """All pairs of a file, block after block as the index names them."""
    _, (at, size) = decode_footer(data)
    for _, handle in decode_block(data[at : at + size]):
        start, length = struct.unpack(">II", handle)
        yield from decode_block(data[start : start + length + TRAILER])


def cell_of(value: bytes | None, pointer: tuple[int, int] | None = None) -> bytes:
    return struct.pack(">BQQ", POINTER, *pointer) if pointer else bytes([INLINE]) + (value or b"")


def row_of(key: bytes, cell: bytes) -> tuple:
    """``key, seq, op, value_inline, vlog_fid, vlog_off`` of a pair; a delete has no value."""
    (tag,) = struct.unpack(">Q", key[-8:])
    op = tag & 255
    pointer = struct.unpack_from(">QQ", cell, 1) if cell[:1] == bytes([POINTER]) else (None, None)
    value = cell[1:] if op and pointer[0] is None else None
    return key[:-8], tag >> 8, op, value, *pointer


def encode_records(payloads: list[bytes]) -> bytes:
    """A log or value log: each record is a checksum in 8 bytes, a length in 4, and the LZ4 form of the payload."""
    out = bytearray()
    for p in payloads:
        body = squeeze(p)
        out += struct.pack(">QI", zlib.crc32(body), len(body)) + body
    return bytes(out)


def decode_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and payload of each record; a record cut short at the end is left out, a wrong checksum is an error."""
    at = 0
    while at + 12 <= len(data):
        crc, size = struct.unpack_from(">QI", data, at)
        body = data[at + 12 : at + 12 + size]
        if len(body) < size:
            return
        if zlib.crc32(body) != crc:
            raise ValueError(f"the checksum of the record at {at} is wrong")
        yield at, unsqueeze(body)
        at += 12 + size


def decoded(files: DataFrame) -> DataFrame:
    """The rows of files given as ``number, content``; empty and null contents give none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in ROWS.split(", ")]
        for b in batches:
            for number, content in zip(b["number"], b["content"]):
                found = [(number, *row_of(*pair)) for pair in decode_file(bytes(content))] if content else []
                out = pd.DataFrame(found, columns=names)
                yield out.astype({"vlog_fid": "Int64", "vlog_off": "Int64"})

    return files.select("number", "content").mapInPandas(rows, ROWS)


def encoded(entries: DataFrame, by: str, filters: DataFrame | None = None, block_size: int = 4096) -> DataFrame:
    """``number, content``: a file for each group of ``key, seq, op, value`` rows, sorted; a file is one value, so groups are of a file's size."""

    def build(f: pd.DataFrame) -> pd.DataFrame:
        keys = [bytes(k) + struct.pack(">Q", s << 8 | op) for k, s, op in zip(f["key"], f["seq"], f["op"])]
        order = sorted(range(len(f)), key=lambda i: (bytes(f["key"].iloc[i]), -f["seq"].iloc[i]))
        cells = [cell_of(None if v is None else bytes(v)) for v in f["value"]]
        return pd.DataFrame({"number": [f["number"].iloc[0]], "content": [encode_file([(keys[i], cells[i]) for i in order], b"", block_size)]})

    return entries.select(entries[by].cast("long").alias("number"), "key", "seq", "op", "value").groupBy("number").applyInPandas(build, "number long, content binary")


def read_sst(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the sorted-run files under ``path`` (``00012.sst``), with the number of their file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return decoded(found.select(F.regexp_extract("path", r"(\d+)\.sst$", 1).cast("long").alias("number"), "content"))


def read_records(spark: SparkSession, path: str, extension: str = "log") -> DataFrame:
    """``number, place, payload`` of the records of the logs under ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    files = found.select(F.regexp_extract("path", rf"(\d+)\.{re.escape(extension)}$", 1).cast("long").alias("number"), "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, content in zip(b["number"], b["content"]):
                yield pd.DataFrame([(number, at, p) for at, p in decode_records(bytes(content))], columns=["number", "place", "payload"])

    return files.mapInPandas(rows, "number long, place long, payload binary")

