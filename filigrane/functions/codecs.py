"""Encodings of numbers, entries and paths."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "<QQIqqq"
WIDE = 0x8000  # a name that is not well-formed is kept in two-byte units
DEAD = 0x80000000
RECORD_MASK = (1 << 48) - 1


def varint(value: int) -> bytes:
    """Seven bits a byte, the lowest first; the high bit tells that more follow."""
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def zigzag(value: int) -> int:
    """Small numbers of either sign as small ones."""
    return value * 2 if value >= 0 else -value * 2 - 1


def unzigzag(value: int) -> int:
    return value // 2 if value % 2 == 0 else -(value // 2) - 1


def pack_postings(ids: Iterable[int]) -> bytes:
    """Sorted ids as the steps between them."""
    out, last = [], 0
    for i in sorted(set(ids)):
        out.append(varint(i - last))
        last = i
    return b"".join(out)


def unpack_postings(data: bytes) -> list[int]:
    out, at, last = [], 0, 0
    while at < len(data):
        step, at = read_varint(data, at)
        last += step
        out.append(last)
    return out


def pack_ticks(ticks: int) -> tuple[int, int]:
    """A count of ticks as a number and how often it was divided by ten: round times are short."""
    exponent = 0
    while ticks and ticks % 10 == 0 and exponent < 15:
        ticks, exponent = ticks // 10, exponent + 1
    return ticks, exponent


def unpack_ticks(number: int, exponent: int) -> int:
    return number * 10**exponent


def pack_entries(rows: Iterable[tuple]) -> str:
    """(file_ref, parent_ref, name, attributes, size, modified, created) as Base64 of little-endian records, each followed
    by the length of the name and the name."""
    parts = []
    for ref, parent, name, attributes, size, modified, created in rows:
        try:
            data, flag = name.encode("utf-8"), 0
        except UnicodeEncodeError:  # half of a pair
            data, flag = name.encode("utf-16-le", "surrogatepass"), WIDE
        if len(data) >= WIDE:
            raise ValueError("name too long")
        parts += [struct.pack(ENTRY, ref & (1 << 64) - 1, parent & (1 << 64) - 1, attributes & 0xFFFFFFFF, size, modified, created), struct.pack("<H", len(data) | flag), data]
    return base64.b64encode(b"".join(parts)).decode()


def unpack_entries(text: str | None) -> list[tuple]:
    data, at, out = base64.b64decode(text or ""), 0, []
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    while at < len(data):
        if at + struct.calcsize(ENTRY) + 2 > len(data):
            raise ValueError("cut entry")
        ref, parent, attributes, size, modified, created = struct.unpack_from(ENTRY, data, at)
        head = struct.unpack_from("<H", data, at + struct.calcsize(ENTRY))[0]
        at += struct.calcsize(ENTRY) + 2
        name = data[at : at + (head & ~WIDE)]
        if len(name) != head & ~WIDE or not name:
            raise ValueError("an entry has no whole name")
        at += len(name)
        out.append((signed(ref), signed(parent), name.decode("utf-16-le", "surrogatepass") if head & WIDE else name.decode(), attributes, size, modified, created))
    return out


def popcount_score(mask: Column, weight: float = 50.0) -> Column:
    """Matched tokens as bits of a mask: so much for each."""
    return F.bit_count(mask) * weight


def is_dead(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(DEAD)) != 0


def buried(attributes: Column) -> Column:
    """The attributes of a tombstone."""
    return attributes.bitwiseOR(F.lit(DEAD))


def record_number(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit(RECORD_MASK))


def sequence_number(ref: Column) -> Column:
    return F.shiftrightunsigned(ref, 48)


def canonical_path(path: Column, separator: str = "\\") -> Column:
    """One kind of separator, no empty or `.` part, `..` resolved; null if it leaves the path or a part ends in a dot or
    space. The first part (a drive) stays."""
    parts = F.filter(F.split(F.regexp_replace(path, r"[\\/]+", "/"), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(a: Column, p: Column) -> Column:
        up = p == ".."
        kept = F.when(up, F.slice(a["kept"], F.lit(1), F.greatest(F.size(a["kept"]) - 1, F.lit(0)))).otherwise(F.concat(a["kept"], F.array(p)))
        ok = a["ok"] & F.when(up, F.size(a["kept"]) > 1).otherwise(~F.rlike(p, F.lit(r"[. ]$")))
        return F.struct(kept.alias("kept"), ok.alias("ok"))

    done = F.aggregate(parts, start, step)
    return F.when(done["ok"] & (F.size(done["kept"]) > 0), F.array_join(done["kept"], separator))


def contained(path: Column, root: Column, separator: str = "\\") -> Column:
    """Whether the canonical path is the root or lies below it, in any case of letters."""
    p, r = F.lower(canonical_path(path, separator)), F.lower(canonical_path(root, separator))
    return F.coalesce((p == r) | F.startswith(p, F.concat(r, F.lit(separator))), F.lit(False))


def fnv1a(data: bytes) -> int:
    """The 32-bit hash by which paths are looked up."""
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def path_index(items: DataFrame, path: str = "full_path") -> DataFrame:
    """Items with a 32-bit hash of their path in upper case: looked up by the hash, then told by the path."""
    return items.withColumn("path_hash", F.hash(F.upper(path)))


def find_by_hash(indexed: DataFrame, paths: DataFrame, path: str = "full_path") -> DataFrame:
    asked = paths.select(F.col("path").alias("asked")).distinct().withColumn("path_hash", F.hash(F.upper("asked")))
    return indexed.join(asked, "path_hash").where(F.upper(path) == F.upper("asked"))
