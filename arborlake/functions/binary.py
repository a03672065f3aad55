"""Binary codecs of the store model, as Arrow batch functions over columns.

These have no SQL form: bytes go in, bytes or small records come out, a batch at
a time. Each has a plain Python function beside it that tests use as well.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Varints: seven bits a byte, the least significant first, ten bytes at most for 64 bits.


def write_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read); raises ValueError where the number doesn't end or passes 64 bits."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise ValueError("a varint is cut off")
        value |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            if value >= 1 << 64:
                raise ValueError("a varint passes 64 bits")
            return value, i + 1
    raise ValueError("a varint is too long")


@F.pandas_udf(T.BinaryType())
def varint(n: pd.Series) -> pd.Series:
    return n.map(lambda x: None if x is None or pd.isna(x) else write_varint(int(x) & (1 << 64) - 1))


def read_size_entry(entry: bytes) -> tuple[str, int, int, int]:
    """(checksum, archived, unpacked, objtype) of a size index entry: 32 bytes, two varints, and perhaps a type (file if none)."""
    if len(entry) < 34:
        raise ValueError("a size entry is too short")
    archived, n = read_varint(entry, 32)
    unpacked, m = read_varint(entry, 32 + n)
    rest = entry[32 + n + m :]
    return entry[:32].hex(), archived, unpacked, rest[0] if rest else 1


SIZE_ENTRY = T.StructType([T.StructField("checksum", T.StringType()), T.StructField("archived", T.DecimalType(20, 0)), T.StructField("unpacked", T.DecimalType(20, 0)), T.StructField("objtype", T.IntegerType())])


@F.pandas_udf(SIZE_ENTRY)
def size_entry(entry: pd.Series) -> pd.DataFrame:
    from decimal import Decimal

    rows = [read_size_entry(bytes(e)) for e in entry]
    return pd.DataFrame({"checksum": [r[0] for r in rows], "archived": [Decimal(r[1]) for r in rows], "unpacked": [Decimal(r[2]) for r in rows], "objtype": [r[3] for r in rows]})


# SipHash-2-4 and the bloom filter of ref names.


def siphash24(key: bytes, data: bytes) -> int:
    mask = (1 << 64) - 1
    k0, k1 = struct.unpack("<QQ", key)
    # The initial state of SipHash.
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rotate(x: int, n: int) -> int:
        return (x << n | x >> 64 - n) & mask

    def rounds(n: int) -> None:
        for _ in range(n):
            v[0] = (v[0] + v[1]) & mask
            v[2] = (v[2] + v[3]) & mask
            v[1] = rotate(v[1], 13) ^ v[0]
            v[3] = rotate(v[3], 16) ^ v[2]
            v[0] = rotate(v[0], 32)
            v[2] = (v[2] + v[1]) & mask
            v[0] = (v[0] + v[3]) & mask
            v[1] = rotate(v[1], 17) ^ v[2]
            v[3] = rotate(v[3], 21) ^ v[0]
            v[2] = rotate(v[2], 32)

    tail = data[len(data) & ~7 :]
    words = [w for (w,) in struct.iter_unpack("<Q", data[: len(data) & ~7])]
    words.append(int.from_bytes(tail, "little") | (len(data) & 255) << 56)
    for w in words:
        v[3] ^= w
        rounds(2)
        v[0] ^= w
    v[2] ^= 255
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


class Bloom:
    """A bloom filter of ``size`` bytes with ``k`` hashes: SipHash with the number of the hash, repeated, as its key."""

    def __init__(self, size: int = 256, k: int = 8, data: bytes | None = None):
        self.bits, self.k = bytearray(data if data is not None else size), k

    def _places(self, item: str) -> Iterator[int]:
        for i in range(self.k):
            yield siphash24(bytes((i,)) * 16, item.encode()) % (8 * len(self.bits))

    def add(self, item: str) -> None:
        for p in self._places(item):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, item: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(item))

    def __bytes__(self) -> bytes:
        return bytes(self.bits)


def bloom_build(rows: DataFrame, key: str, item: str, size: int = 256, k: int = 8) -> DataFrame:
    """(key, bloom) from distinct items: one filter a task and key, then the filters of a key are or-ed, so a hot key is built in parts."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters: dict[str, Bloom] = {}
        for b in batches:
            for name, x in zip(b["__key"], b["__item"], strict=True):
                filters.setdefault(name, Bloom(size, k)).add(x)
        yield pd.DataFrame({"key": list(filters), "bloom": [bytes(f) for f in filters.values()]})

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in b["bloom"]]))
        return pd.DataFrame({"key": b["key"].iloc[:1], "bloom": [bits.tobytes()]})

    parts = rows.select(F.col(key).alias("__key"), F.col(item).alias("__item")).dropna().mapInPandas(part, "key string, bloom binary")
    return parts.groupBy("key").applyInPandas(merge, "key string, bloom binary")


def bloom_contains(k: int = 8):
    @F.pandas_udf(T.BooleanType())
    def contains(bloom: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([b is not None and x is not None and x in Bloom(k=k, data=bytes(b)) for b, x in zip(bloom, item, strict=True)])

    return contains


# Content-defined chunking by a rolling sum.

# The window, the boundary bits, the cap of a chunk, and the offset added to every byte.
WINDOW, BOUNDARY_BITS, CHUNK_CAP, CHAR_OFFSET = 64, 13, 1 << 15, 31


def _boundaries(raw: np.ndarray) -> np.ndarray:
    """Where the low bits of the rolling sum's weighted half are all ones, over a window of zeros at first."""
    before = np.concatenate([np.zeros(WINDOW, np.int64), raw])[: len(raw)]
    s1 = WINDOW * CHAR_OFFSET + np.cumsum(raw - before)
    s2 = WINDOW * (WINDOW - 1) * CHAR_OFFSET + np.cumsum(s1 - WINDOW * (before + CHAR_OFFSET))
    mask = (1 << BOUNDARY_BITS) - 1
    return np.flatnonzero((s2 & mask) == mask)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end: after the next boundary, or at the cap if that lies beyond it. Once no boundary
    is left, all further chunks end at the cap, without another look.

    The sum starts afresh in each chunk, over a window of zeros; past its first
    WINDOW bytes it depends on the last WINDOW bytes alone, so these boundaries
    are those of the whole content and are found once.
    """
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    everywhere = _boundaries(raw)
    ends, at = [], 0
    while at < len(raw):
        own = _boundaries(raw[at : at + WINDOW - 1])
        if len(own):
            step = int(own[0]) + 1
        else:
            k = int(np.searchsorted(everywhere, at + WINDOW - 1))
            if k == len(everywhere):
                ends += list(range(at + CHUNK_CAP, len(raw), CHUNK_CAP)) + [len(raw)]
                break
            step = int(everywhere[k]) + 1 - at
        at += min(step, CHUNK_CAP)
        ends.append(at)
    return ends


def chunks(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, start, len, crc, sha256) of every chunk of every content."""
    import hashlib

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = 0
                for end in chunk_ends(data):
                    piece = data[start:end]
                    out.append((name, start, end - start, zlib.crc32(piece), hashlib.sha256(piece).hexdigest()))
                    start = end
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["key", "start", "len", "crc", "sha256"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    return rows.mapInArrow(cut, "key string, start bigint, len bigint, crc bigint, sha256 string")


def match_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, start, len, from_key, from_start): chunks of ``new`` that ``old`` holds too, with the first place of each.

    Keyed by length and SHA-256 of the chunk itself.
    """
    first = old.groupBy("len", "sha256").agg(F.min(F.struct("key", "start")).alias("f"))
    return new.join(first, ["len", "sha256"]).select("key", "start", "len", F.col("f.key").alias("from_key"), F.col("f.start").alias("from_start"))


# Codecs of delta parts and archive streams.


def encode_part(data: bytes, how: str) -> bytes:
    """A part with its leading type byte: 0 plain, x LZMA."""
    return b"\0" + data if how == "none" else b"x" + lzma.compress(data)


def decode_part(part: bytes, limit: int | None = None) -> bytes:
    """The whole of a part; raises ValueError where it is cut off, or longer than ``limit`` bytes (None: any length)."""
    if part[:1] == b"\0":
        out = part[1:]
    elif part[:1] == b"x":
        decoder = lzma.LZMADecompressor(memlimit=1 << 28)
        try:
            out = decoder.decompress(part[1:], -1 if limit is None else limit + 1)
        except lzma.LZMAError as e:
            raise ValueError(str(e)) from e
        if not decoder.eof and (limit is None or len(out) <= limit):
            raise ValueError("a part is cut off")
    else:
        raise ValueError("an unknown part type")
    if limit is not None and len(out) > limit:
        raise ValueError(f"a part is longer than {limit} bytes")
    return out


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    """Raw deflate, as in archive streams."""

    def one(x: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(x) + c.flush()

    return data.map(lambda x: None if x is None else one(bytes(x)))


def inflate_raw(data: bytes) -> bytes | None:
    """The content of a raw deflate stream; None where it is broken or cut off."""
    decoder = zlib.decompressobj(-15)
    try:
        out = decoder.decompress(data) + decoder.flush()
    except zlib.error:
        return None
    return out if decoder.eof else None


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    """``inflate_raw`` of each value: a broken stream is null, and fails no other row."""
    return data.map(lambda x: None if x is None else inflate_raw(bytes(x)))


# A binary diff: copy runs with byte differences, extra bytes, and a seek, found by hashed blocks.


def _block_hits(old: bytes, new: bytes, block: int) -> np.ndarray:
    """The places of ``new`` where a block of ``old`` may start: all places are hashed as arrays, so that only these are looked at."""
    if min(len(old), len(new)) < block:
        return np.empty(0, np.int64)

    def hashes(data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        n, out, done = len(raw) - block + 1, np.zeros(len(raw) - block + 1, np.uint64), 0
        now, size = raw, 1
        while size <= block:
            if block & size:
                out = out * np.uint64(0x9E3779B97F4A7C15) + now[done : done + n]
                done += size
            if 2 * size > block:
                break
            now, size = now[:-size] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * size) + now[size:], 2 * size
        return out

    return np.flatnonzero(np.isin(hashes(new), np.unique(hashes(old)[::block])))


def binary_diff(old: bytes, new: bytes, block: int = 16) -> bytes:
    """A patch of (add, extra, seek) triples: ``add`` differences over old bytes, ``extra`` new ones, then a move in old."""
    places: dict[bytes, int] = {}
    for i in range(0, len(old) - block + 1, block):
        places.setdefault(old[i : i + block], i)
    pos, literal = 0, 0
    runs: list[tuple[int, int, int]] = []  # start in new, start in old, length
    at = 0
    for at in _block_hits(old, new, block).tolist():
        if at < literal:
            continue
        hit = places.get(new[at : at + block])
        if hit is None:
            continue
        a, b = at, hit
        while a > literal and b > 0 and new[a - 1] == old[b - 1]:
            a, b = a - 1, b - 1
        end = at + block
        while end < len(new) and b + end - a < len(old) and new[end] == old[b + end - a]:
            end += 1
        runs.append((a, b, end - a))
        literal = end
    edge = 0
    control: list[tuple[int, int, int]] = []
    diff, extra = bytearray(), bytearray()
    runs.append((len(new), pos, 0))
    add = 0
    for a, b, n in runs:
        extra += new[edge:a]
        control.append((add, a - edge, b - pos))
        pos, add, edge = b + n, n, a + n
        diff += bytes(n)
    head = struct.pack("<qqq", len(new), len(control), len(diff))
    packed = b"".join(struct.pack("<qqq", *c) for c in control)
    return head + bz2.compress(packed + bytes(diff) + bytes(extra))


def binary_patch(old: bytes, patch: bytes) -> bytes:
    size, n, n_diff = struct.unpack_from("<qqq", patch)
    body = bz2.decompress(patch[24:])
    control = [struct.unpack_from("<qqq", body, 24 * i) for i in range(n)]
    diff, extra = body[24 * n : 24 * n + n_diff], body[24 * n + n_diff :]
    out, pos, at_diff, at_extra = bytearray(), 0, 0, 0
    for add, more, seek in control:
        if add:
            run = (np.frombuffer(old, np.uint8, add, pos) + np.frombuffer(diff, np.uint8, add, at_diff)).astype(np.uint8)
            out += run.tobytes()
            pos, at_diff = pos + add, at_diff + add
        out += extra[at_extra : at_extra + more]
        at_extra += more
        pos += seek
    if len(out) != size:
        raise ValueError("a patch doesn't fit")
    return bytes(out)


def diff_udf():
    @F.pandas_udf(T.BinaryType())
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([binary_diff(bytes(a), bytes(b)) for a, b in zip(old, new, strict=True)])

    return run


# Delta parts: a small byte code over the payload of a part.


# The codes of the operations.
OPERATIONS = {"open_splice_close": "S", "open": "o", "write": "w", "set_source": "r", "unset_source": "R", "close": "c", "patch": "B"}
PART = "(a(uuu)aa(ayay)ayay)"


def write_operations(operations: list[tuple], meta: tuple[bool, ...] = ()) -> bytes:
    """Operations as byte code: a code each, with varints. ``meta`` says of each object made whether it is metadata, which has no mode and xattrs."""
    out, made = bytearray(), 0
    for op, *args in operations:
        out += OPERATIONS[op].encode()
        if op in ("open", "open_splice_close"):
            # (offset, size) of a splice and (size) of an open may be followed by the places of mode and xattrs.
            own, places = (args[:2], args[2:]) if op == "open_splice_close" else (args[:1], args[1:])
            if not (made < len(meta) and meta[made]):
                out += b"".join(write_varint(n) for n in (*places, 0, 0)[:2])
            out += b"".join(write_varint(n) for n in reversed(own))
            made += 1
        elif op in ("write", "patch"):
            offset, size = args
            out += write_varint(size) + write_varint(offset) if op == "write" else write_varint(offset) + write_varint(size)
        elif op == "set_source":
            out += write_varint(args[0])
    return bytes(out)


def read_operations(code: bytes, meta: tuple[bool, ...] = ()) -> list[tuple]:
    """The operations of byte code; raises ValueError at an unknown code or a cut-off number."""
    names = {c: n for n, c in OPERATIONS.items()}
    out: list[tuple] = []
    at = made = 0

    def number() -> int:
        nonlocal at
        value, used = read_varint(code, at)
        at += used
        return value

    while at < len(code):
        op = names.get(chr(code[at]))
        if op is None:
            raise ValueError(f"unknown operation {code[at]}")
        at += 1
        if op in ("open", "open_splice_close"):
            places = () if made < len(meta) and meta[made] else (number(), number())
            size = number()
            out.append((op, number(), size, *places) if op == "open_splice_close" else (op, size, *places))
            made += 1
        elif op == "write":
            size = number()
            out.append((op, number(), size))
        elif op == "patch":
            out.append((op, number(), number()))
        elif op == "set_source":
            out.append((op, number()))
        else:
            out.append((op,))
    return out


def run_part(code: bytes, payload: bytes, objects: dict[str, bytes], meta: tuple[bool, ...] = ()) -> list[bytes]:
    """Runs a part's byte code; the number of a source is the place of its checksum in the payload."""
    operations = [(op, payload[args[0] : args[0] + 32].hex()) if op == "set_source" else (op, *args) for op, *args in read_operations(code, meta)]
    return apply_operations(operations, payload, objects)


def part_bytes(modes: list[tuple[int, int, int]], payload: bytes, code: bytes, how: str = "lzma") -> bytes:
    """A delta part: the modes and xattrs that its objects name, the payload and the byte code, behind the type byte."""
    from arborlake.functions import variant

    return encode_part(variant.write(PART, (modes, [[]], payload, code)), how)


def read_part(part: bytes, limit: int | None = None) -> tuple[list, list, bytes, bytes]:
    """(modes, xattrs, payload, byte code) of a part."""
    from arborlake.functions import variant

    return variant.read(PART, decode_part(part, limit))


def apply_operations(operations: list[tuple], payload: bytes, objects: dict[str, bytes]) -> list[bytes]:
    """Runs a part's operations; the objects in the order in which they are closed.

    ("open_splice_close", offset, size, ...), ("open", size, ...), ("write", offset, size) from the payload or, after
    ("set_source", name), from that object; ("unset_source",), ("patch", offset, size), ("close",).
    """
    made: list[bytes] = []
    current: bytearray | None = None
    expected, source = 0, None
    for op, *args in operations:
        if op == "open_splice_close":
            offset, size = args[:2]
            if offset + size > len(payload):
                raise ValueError("a splice lies beyond the payload")
            made.append(payload[offset : offset + size])
        elif op == "open":
            current, expected = bytearray(), args[0]
        elif op == "set_source":
            source = objects[args[0]]
        elif op == "unset_source":
            source = None
        elif op == "write":
            offset, size = args
            current += (payload if source is None else source)[offset : offset + size]
        elif op == "patch":
            offset, size = args
            current += binary_patch(source, payload[offset : offset + size])
        elif op == "close":
            if len(current) != expected:
                raise ValueError(f"an object has {len(current)} bytes, not {expected}")
            made.append(bytes(current))
            current = None
        else:
            raise ValueError(f"unknown operation {op}")
    return made


ZBASE32 = "ybndrfg8ejkmcpqxot1uwisza345h769"


def zbase32(data: bytes) -> str:
    bits = "".join(f"{b:08b}" for b in data)
    return "".join(ZBASE32[int(bits[i : i + 5].ljust(5, "0"), 2)] for i in range(0, len(bits), 5))
