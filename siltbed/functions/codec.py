"""Record bytes: sizes and codecs for log and table records, and sketches as BINARY."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, functions as F

HEADER = 29  # crc 4, ts 8, tombstone 1, key size 8, value size 8


def uvarint_size(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number: one for each 7 bits that are begun."""
    bits = F.length(F.bin(x))
    return F.ceil(bits / 7).cast("int")


def plain_size(key: Column, value: Column, tombstone: Column) -> Column:
    """Bytes of an uncompressed table record; a tombstone has neither value nor its size."""
    return (F.when(tombstone, 21 + F.octet_length(key))
            .otherwise(HEADER + F.octet_length(key) + F.octet_length(value)).cast("int"))


def compressed_size(ts: Column, key_id: Column, value: Column, tombstone: Column) -> Column:
    """Bytes with a key dictionary and varints."""
    base = 5 + uvarint_size(ts) + uvarint_size(key_id)
    return F.when(tombstone, base).otherwise(base + uvarint_size(F.octet_length(value)) + F.octet_length(value)).cast("int")


def le_hex(x: Column, width: int) -> Column:
    """A number as little-endian hex of ``width`` bytes."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(x), width * 2, "0"), F.lit("(..)"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def record_hex(crc: Column, ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    """A plain log record as upper-case hex, all inside the JVM."""
    v = F.coalesce(value, F.lit(""))
    return F.concat(
        le_hex(crc, 4), le_hex(ts, 8), F.when(tombstone, "01").otherwise("00"),
        le_hex(F.octet_length(key), 8), le_hex(F.octet_length(v), 8), F.hex(F.encode(key, "utf-8")), F.hex(F.encode(v, "utf-8")))


def uvarint_hex(x: Column) -> Column:
    """An unsigned LEB128 number as upper-case hex."""
    n = uvarint_size(x)

    def byte(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", x.cast("long"), (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(low + F.when(i < n - 1, 128).otherwise(0)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")


def compressed_hex(crc: Column, ts: Column, tombstone: Column, key_id: Column, value: Column) -> Column:
    """A compressed table record as upper-case hex, all inside the JVM; a tombstone has neither value nor its size."""
    v = F.coalesce(value, F.lit(""))
    rest = F.when(tombstone, uvarint_hex(key_id)).otherwise(
        F.concat(uvarint_hex(F.octet_length(v)), uvarint_hex(key_id), F.hex(F.encode(v, "utf-8"))))
    return F.concat(le_hex(crc, 4), uvarint_hex(ts), F.when(tombstone, "01").otherwise("00"), rest)


def dense_hex(cells: DataFrame, group: str, index: Column, value: Column, n: int, width: int) -> DataFrame:
    """(group, body): the ``n`` counters of each sketch in order, absent ones as 0, as little-endian hex of ``width`` bytes.

    A sketch has a fixed size, so that a group is bounded however many elements it has seen."""
    slots = cells.select(group).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    held = cells.select(F.col(group), index.cast("long").alias("slot"), value.cast("long").alias("held"))
    filled = slots.join(held, [group, "slot"], "left").select(group, "slot", le_hex(F.coalesce("held", F.lit(0)), width).alias("part"))
    listed = filled.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("slot", "part"))).alias("parts"))
    return listed.select(group, F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("body"))


def number_hex(*numbers: int) -> str:
    """Eight bytes each, little-endian."""
    return b"".join(struct.pack("<Q", x) for x in numbers).hex().upper()


def seeds_hex(seeds: list[bytes]) -> str:
    return b"".join(struct.pack("<Q", len(s)) + s for s in seeds).hex().upper()


def encode_record(ts: int, tombstone: bool, key: str, value: bytes) -> bytes:
    k = key.encode()
    return struct.pack("<IQ?QQ", zlib.crc32(value), ts, tombstone, len(k), len(value)) + k + value


def decode_records(data: bytes, at: int = 0):
    """Records of a plain log from ``at``; ends at a short header or one of zeros only (an empty key is a key). Yields
    (crc, ts, tombstone, key, value, next)."""
    head = struct.Struct("<IQ?QQ")
    while at + HEADER <= len(data):
        crc, ts, tomb, nk, nv = head.unpack_from(data, at)
        if not any(data[at:at + HEADER]) or at + HEADER + nk + nv > len(data):
            return
        key = data[at + HEADER:at + HEADER + nk].decode()
        value = data[at + HEADER + nk:at + HEADER + nk + nv]
        at += HEADER + nk + nv
        yield crc, ts, tomb, key, value, at


def put_uvarint(x: int) -> bytes:
    out = bytearray()
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = data[at]
        at += 1
        x |= (b & 0x7F) << shift
        if b < 0x80:
            return x, at
        shift += 7


def encode_compressed(ts: int, tombstone: bool, key_id: int, value: bytes) -> bytes:
    head = struct.pack("<I", zlib.crc32(value)) + put_uvarint(ts) + bytes([tombstone])
    return head + (put_uvarint(key_id) if tombstone else put_uvarint(len(value)) + put_uvarint(key_id) + value)


def decode_compressed(data: bytes, at: int = 0) -> tuple[int, bool, int, bytes, int]:
    (ts, at), nv = get_uvarint(data, at + 4), 0
    tomb, at = bool(data[at]), at + 1
    if not tomb:
        nv, at = get_uvarint(data, at)
    key_id, at = get_uvarint(data, at)
    return ts, tomb, key_id, data[at:at + nv], at + nv


def bloom_bytes(m: int, k: int, seeds: list[bytes], positions: list[int]) -> bytes:
    """K, length of the map, one byte a bit, then K sized seeds."""
    bits = bytearray(m)
    for p in positions:
        bits[p] = 1
    return struct.pack("<QQ", k, m) + bytes(bits) + b"".join(struct.pack("<Q", len(s)) + s for s in seeds)


def bloom_from_bytes(data: bytes) -> tuple[int, int, list[bytes], list[int]]:
    k, m = struct.unpack_from("<QQ", data)
    at, seeds = 16 + m, []
    for _ in range(k):
        n = struct.unpack_from("<Q", data, at)[0]
        seeds.append(data[at + 8:at + 8 + n])
        at += 8 + n
    return m, k, seeds, [i for i, b in enumerate(data[16:16 + m]) if b]


def hll_bytes(p: int, ranks: dict[int, int]) -> bytes:
    return struct.pack("<QB", 1 << p, p) + bytes(ranks.get(i, 0) for i in range(1 << p))


def hll_from_bytes(data: bytes) -> tuple[int, dict[int, int]]:
    m, p = struct.unpack_from("<QB", data)
    return p, {i: r for i, r in enumerate(data[9:9 + m]) if r}


def cms_bytes(k: int, m: int, seeds: list[bytes], counts: dict[tuple[int, int], int]) -> bytes:
    body = struct.pack(f"<{k * m}I", *(counts.get((i, j), 0) for i in range(k) for j in range(m)))
    return struct.pack("<QQ", k, m) + b"".join(struct.pack("<Q", len(s)) + s for s in seeds) + body


def cms_from_bytes(data: bytes) -> tuple[int, int, list[bytes], dict[tuple[int, int], int]]:
    k, m = struct.unpack_from("<QQ", data)
    at, seeds = 16, []
    for _ in range(k):
        n = struct.unpack_from("<Q", data, at)[0]
        seeds.append(data[at + 8:at + 8 + n])
        at += 8 + n
    flat = struct.unpack_from(f"<{k * m}I", data, at)
    return k, m, seeds, {(i // m, i % m): c for i, c in enumerate(flat) if c}


def simhash_bytes(hi: int, lo: int) -> bytes:
    """A fingerprint of two signed longs as its 16 bytes, first bit first."""
    return struct.pack(">qq", hi, lo)


def simhash_from_bytes(data: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", data)


def simhash_hex(hi: Column, lo: Column) -> Column:
    """The same as upper-case hex, inside the JVM."""
    return F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0"))


def bucket_bytes(size: int, left: int, refreshed: int, interval: int) -> bytes:
    return struct.pack("<QQQQ", size, left, refreshed, interval)


def bucket_from_bytes(data: bytes) -> tuple[int, int, int, int]:
    return struct.unpack("<QQQQ", data[:32])


def merkle_bytes(levels: list[list[bytes]]) -> bytes:
    """Leaf count, then every node as size and hash, level by level."""
    n = len(levels[0]) if levels else 0
    return struct.pack("<Q", n) + b"".join(struct.pack("<Q", len(h)) + h for level in levels for h in level)


def merkle_from_bytes(data: bytes) -> list[list[bytes]]:
    n, at, levels = struct.unpack_from("<Q", data)[0], 8, []
    while at < len(data):
        level = []
        for _ in range(n):
            size = struct.unpack_from("<Q", data, at)[0]
            level.append(data[at + 8:at + 8 + size])
            at += 8 + size
        levels.append(level)
        if n == 1:
            break
        n = (n + 1) // 2
        n += n % 2 if n > 1 else 0
    return levels
