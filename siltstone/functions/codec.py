"""Binary formats as column expressions: varints, checksums, internal keys, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.model import be_bytes

#: Fixed values of the store's bloom hash.
HASH_SEED, HASH_FACTOR = 0xBC9F1D34, 0xC6A4A793
U32 = 1 << 32


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_at(b: Column | str, i: int) -> Column:
    """The unsigned byte at 1-based place ``i``; null beyond the end."""
    part = F.substring(_c(b), i, 1)
    return F.when(F.octet_length(part) == 1, F.conv(F.hex(part), 16, 10).cast("long"))


def varint_length(n: Column | str) -> Column:
    """Bytes that a 32-bit varint takes."""
    n = _c(n)
    out = F.when(n < 1 << 7, 1)
    for size in (2, 3, 4):
        out = out.when(n < 1 << 7 * size, size)
    return out.otherwise(5)


def varint_encode(n: Column | str) -> Column:
    """A varint: seven bits a byte, lowest first, the top bit set on all but the last."""
    n = _c(n).cast("long")
    groups = [F.shiftright(n, 7 * i).bitwiseAND(127) for i in range(5)]

    def bytes_of(size: int) -> Column:
        parts = [be_bytes(g.bitwiseOR(128) if i < size - 1 else g, 1) for i, g in enumerate(groups[:size])]
        return F.concat(*parts) if size > 1 else parts[0]

    length = varint_length(n)
    out = F.when(length == 1, bytes_of(1))
    for size in (2, 3, 4):
        out = out.when(length == size, bytes_of(size))
    return out.otherwise(bytes_of(5))


def varint_decode(b: Column | str) -> Column:
    """The number at the start of ``b``; bytes after its end don't count, an empty input is null."""
    value, more = F.lit(0).cast("long"), F.lit(True)
    for i in range(5):
        byte = byte_at(b, i + 1)
        value = F.when(more, value + F.shiftleft(byte.bitwiseAND(127), 7 * i)).otherwise(value)
        more = more & (byte >= 128)
    return value


def checksum(b: Column | str) -> Column:
    """CRC-32 (IEEE) as an unsigned number."""
    return F.crc32(_c(b))


def checksum_ok(b: Column | str, stored: Column | str) -> Column:
    return checksum(b) == _c(stored)


def u32_bytes(n: Column | str) -> Column:
    return be_bytes(_c(n), 4)


def u64_bytes(n: Column | str) -> Column:
    return be_bytes(_c(n), 8)


def u32_list_bytes(xs: Column | str) -> Column:
    """An array of numbers as their 4-byte forms in a row."""
    return F.unhex(F.array_join(F.transform(_c(xs), lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")), ""))


def length_prefixed(b: Column | str) -> Column:
    """``varint(length)`` and the bytes."""
    return F.concat(varint_encode(F.octet_length(_c(b))), _c(b))


def internal_key(key: Column | str, seq: Column | str, op: Column | str) -> Column:
    """Key, then the 8 big-endian bytes of ``seq << 8 | op``."""
    tag = F.shiftleft(_c(seq).cast("long"), 8).bitwiseOR(_c(op).cast("long"))
    return F.concat(_c(key), be_bytes(tag, 8))


def user_key(ik: Column | str) -> Column:
    ik = _c(ik)
    return ik.substr(F.lit(1), F.octet_length(ik) - 8)


def tag(ik: Column | str) -> Column:
    ik = _c(ik)
    return F.conv(F.hex(ik.substr(F.octet_length(ik) - 7, F.lit(8))), 16, 10).cast("long")


def key_seq(ik: Column | str) -> Column:
    return F.shiftright(tag(ik), 8)


def key_op(ik: Column | str) -> Column:
    return tag(ik).bitwiseAND(255).cast("int")


def file_name(number: Column | str, extension: str) -> Column:
    """Five digits or more, then the extension."""
    return F.format_string(f"%05d.{extension}", _c(number))


def times_u32(h: Column, m: int) -> Column:
    """``h * m`` modulo 2^32 in two halves, which stay within a signed 64-bit number."""
    upper = (F.shiftright(h, 16) * F.lit(m)) % 65536 * 65536
    return (upper + h.bitwiseAND(65535) * F.lit(m)) % U32


def _le_word(key: Column, at: Column) -> Column:
    """The number that the four bytes from 0-based place ``at`` on make, lowest first; missing ones are 0."""
    part = F.rpad(F.hex(key.substr(at + 1, F.lit(4))), 8, "0")
    n = F.conv(part, 16, 10).cast("long")
    return F.shiftleft(n.bitwiseAND(255), 24) + F.shiftleft(F.shiftright(n, 8).bitwiseAND(255), 16) + F.shiftleft(F.shiftright(n, 16).bitwiseAND(255), 8) + F.shiftright(n, 24)


def _bloom_start(key: Column) -> Column:
    return times_u32(F.octet_length(key).cast("long"), HASH_FACTOR).bitwiseXOR(F.lit(HASH_SEED).cast("long"))


def bloom_hash(key: Column | str) -> Column:
    """The store's 32-bit hash of a key of any length; null for a null.

    Each little-endian word is added, then multiplied. One to three bytes at the
    end count as a word filled up with zeros; that rule is our own, for keys that
    are built and probed here (lengths divisible by 4 hash as stored filters have
    it). The words are folded over an array, so any length goes.
    """
    key = _c(key)
    n = F.octet_length(key)
    words = F.transform(F.sequence(F.lit(0), F.ceil(n / 4).cast("int") - 1), lambda i: _le_word(key, i * 4))
    words = F.when(n > 0, words).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(words, _bloom_start(key), lambda h, w: times_u32((h + w) % U32, HASH_FACTOR))


def with_bloom_hash(df: DataFrame, key: str, name: str, longest: int | None = None) -> DataFrame:
    """``df`` with the hash of its ``key``; ``longest``: the most bytes of any key, if known.

    Then each word is a projection of its own, plain arithmetic in generated code;
    as one expression it would double with every word.
    """
    if longest is None:
        return df.withColumn(name, bloom_hash(key))
    out = df.withColumn(name, _bloom_start(F.col(key)))
    for at in range(0, longest, 4):
        step = times_u32((F.col(name) + _le_word(F.col(key), F.lit(at))) % U32, HASH_FACTOR)
        out = out.withColumn(name, F.when(F.octet_length(key) > at, step).otherwise(F.col(name)))
    return out


def bloom_positions(h: Column, k: Column | int, nbits: Column) -> Column:
    """The bit positions of a hash: ``k`` steps of the hash turned right by 17 bits."""
    step = (F.shiftright(h, 17) + F.shiftleft(h, 15)) % U32
    if isinstance(k, int):
        return F.array(*[((h + i * step) % U32) % nbits for i in range(k)])
    return F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: ((h + i.cast("long") * step) % U32) % nbits)


def value_wrap(value: Column | str) -> Column:
    """A logged value: its length as a varint, then its bytes."""
    return length_prefixed(value)


def block_handle(offset: Column | str, size: Column | str) -> Column:
    """Where a block lies: offset and size as two big-endian 4-byte numbers."""
    return F.concat(u32_bytes(offset), u32_bytes(size))


def handle_offset(handle: Column | str) -> Column:
    return F.conv(F.hex(F.substring(_c(handle), 1, 4)), 16, 10).cast("long")


def handle_size(handle: Column | str) -> Column:
    return F.conv(F.hex(F.substring(_c(handle), 5, 4)), 16, 10).cast("long")


def entry_size(key: Column | str, value: Column | str) -> Column:
    """Bytes of an entry in a block: both lengths as varints, the internal key, the tag and the value."""
    k, v = F.octet_length(_c(key)) + 8, F.coalesce(F.octet_length(_c(value)), F.lit(0)) + 1
    return (varint_length(k) + k + varint_length(v) + v).cast("long")
