"""The binary file format, and tables kept in memory."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.sources import sst
from siltstone.sources.cache import TableCache


def ikey(key, seq, op=1):
    return key + struct.pack(">Q", seq << 8 | op)


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_files_come_back(n):
    rng = random.Random(n)
    pairs = [(ikey(struct.pack(">I", i), i), sst.cell_of(rng.randbytes(rng.choice([0, 1, 126, 127, 128, 300, 9000])))) for i in range(n)]
    data = sst.encode_file(pairs, b"\x01\x02")
    assert list(sst.decode_file(data)) == pairs
    (at, size), (index, length) = sst.decode_footer(data)
    assert data[at : at + size] == b"\x01\x02" and index + length + 16 == len(data)


def test_fixed_width_entries_fill_a_block_as_counted():
    pairs = [(ikey(struct.pack(">I", i), i), sst.cell_of(b"abcd")) for i in range(400)]
    data = sst.encode_file(pairs)
    _, (at, size) = sst.decode_footer(data)
    index = list(sst.decode_block(data[at : at + size]))
    assert [k[:4] for k, _ in index] == [struct.pack(">I", i) for i in (177, 355, 399)]  # 19 bytes and an offset each, 178 to a block


def test_layout_of_a_block():
    body = sst.unsqueeze(sst.encode_block([(b"k", b"\0v")]))
    assert body[:5] == b"\x01k\x02\0v" and struct.unpack(">3I", body[5:17]) == (0, 5, 2)
    assert struct.unpack(">Q", body[17:])[0] == zlib.crc32(body[:17])


def test_damage_is_noticed():
    block = sst.encode_block([(b"key", b"\0value")])
    body = bytearray(sst.unsqueeze(block))
    body[2] ^= 1
    with pytest.raises(ValueError):
        list(sst.decode_block(sst.squeeze(bytes(body))))
    with pytest.raises(ValueError):
        sst.decode_footer(b"short")
    log = bytearray(sst.encode_records([b"a" * 50]))
    log[20] ^= 1
    with pytest.raises(ValueError):
        list(sst.decode_records(bytes(log)))


def test_rows_and_pointers():
    assert sst.row_of(ikey(b"", 5, 0), sst.cell_of(None)) == (b"", 5, 0, None, None, None)
    assert sst.row_of(ikey(b"k", 1 << 50), sst.cell_of(b"")) == (b"k", 1 << 50, 1, b"", None, None)
    assert sst.row_of(ikey(b"k", 6), sst.cell_of(None, (7, 4096))) == (b"k", 6, 1, None, 7, 4096)


def test_reading_a_directory(spark, tmp_path):
    (tmp_path / "00012.sst").write_bytes(sst.encode_file([(ikey(b"a", 2), sst.cell_of(b"x")), (ikey(b"b", 1, 0), sst.cell_of(None))]))
    (tmp_path / "00013.sst").write_bytes(sst.encode_file([(ikey(b"c", 9), sst.cell_of(None, (3, 40)))]))
    (tmp_path / "00014.sst").write_bytes(sst.encode_file([]))
    (tmp_path / "notes.txt").write_bytes(b"no file of ours")
    rows = sorted((r.number, bytes(r.key), r.seq, r.op, r.value_inline and bytes(r.value_inline), r.vlog_fid, r.vlog_off) for r in sst.read_sst(spark, str(tmp_path)).collect())
    assert rows == [(12, b"a", 2, 1, b"x", None, None), (12, b"b", 1, 0, None, None, None), (13, b"c", 9, 1, None, 3, 40)]


def test_record_logs(spark, tmp_path):
    payloads = [b"", b"one", b"x" * 10_000]
    data = sst.encode_records(payloads)
    (tmp_path / "7.log").write_bytes(data + b"\0\0\0cut short")
    rows = sst.read_records(spark, str(tmp_path)).orderBy("place").collect()
    assert [bytes(r.payload) for r in rows] == payloads and rows[0].place == 0 and {r.number for r in rows} == {7}


def test_encoded_and_decoded_tables(spark):
    rows = [(n, bytes([k]), s, s % 2, b"v" * s if s % 2 else None) for n in (1, 2) for k in (3, 1, 2) for s in range(40)]
    df = spark.createDataFrame([*rows], "file_no long, key binary, seq long, op int, value binary")
    files = sst.encoded(df, "file_no").cache()
    back = [(r.number, bytes(r.key), r.seq, r.op, None if r.value_inline is None else bytes(r.value_inline)) for r in sst.decoded(files).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
    assert [x[:3] for x in back if x[0] == 1] == sorted((x[:3] for x in back if x[0] == 1), key=lambda x: (x[1], -x[2]))
    assert sst.decoded(files.limit(0)).count() == sst.decoded(spark.createDataFrame([(1, None)], "number long, content binary")).count() == 0


def test_cache_gives_up_the_least_used(spark):
    cache = TableCache(100, shards=1)
    tables = {n: spark.range(5).withColumn("n", F.lit(n)) for n in "abcd"}
    for n in "abc":
        cache.insert(n, tables[n], 40)
    assert all(cache.get(n) is not None for n in "abc")  # pinned twice now, so all stay beyond the capacity
    for n in "abc":
        cache.unpin(n)
        cache.unpin(n)
    assert cache.get("a") is None and cache.get("b") is not None and cache.get("c") is not None
    assert tables["a"].storageLevel.useMemory is False and tables["b"].storageLevel.useMemory is True
    cache.unpin("b")
    cache.unpin("c")
    assert cache.get_or_make("d", lambda: tables["d"], 60).count() == 5 and cache.get("b") is None
    assert cache.evict("d") and not cache.evict("d")
    cache.unpin("never")


def test_shards_share_the_capacity(spark):
    cache = TableCache(160)
    assert len(cache.shards) == 16 and cache.share == 10
    for i in range(40):
        cache.insert(f"t{i}", spark.range(1), 5)
        cache.unpin(f"t{i}")
    assert all(sum(x[1] for x in s.values()) <= 10 for s in cache.shards) and sum(map(len, cache.shards)) > 16
    for s in cache.shards:
        for name in list(s):
            cache.evict(name)
