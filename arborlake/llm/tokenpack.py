"""Token-ID / binary output: fixed-width bit packing.

Documents are range-partitioned by id, tokenised, and written in ascending id
order as blocks: each block holds the ids of a run of whole documents, every id
in the least number of bits that holds the vocabulary, with the offset of each
document inside the block. A block is unpacked by vectorised shifts, and a
document (or any id range) is read without unpacking the rest.

The files are Parquet with one block a row (shard, block, first: ids before it in its
shard, doc_ids, offsets, n_ids, bits, payload), so they can live in any store Spark writes to.

The ids are those of the library's own ``encode(text, add_special_tokens=False)``:
a special token that a text spells out is one id.

Null text is empty (its end id alone is written); null ids come first; rows that
share an id follow each other, ordered by a hash of the text and the text, so
repeated rows are all written. A text longer than a block has a block of its own.
An empty table gives no block and no row. Only the id and the text are read, so
further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch, slices, text_bytes

#: A block is closed when it holds so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 17
END_ID = 0
#: Pieces, and units of pieces, whose ids a worker remembers at most: the ones that come first, and so the common ones.
PIECES, UNITS = 1_000_000, 50_000

BLOCK_SCHEMA = "shard int, block int, first bigint, doc_ids array<bigint>, offsets array<bigint>, n_ids bigint, bits int, payload binary"


def id_bits(vocabulary: int) -> int:
    """The least number of bits that holds the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after another, ``bits`` bits each, the least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from id number ``start`` on; only their bytes are touched."""
    count = len(payload) * 8 // bits - start if count is None else count
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    raw = np.frombuffer(payload[first:last] + b"\0" * 8, np.uint8)
    at = np.arange(count, dtype=np.int64) * bits + (start * bits - first * 8)
    low, shift = at >> 3, (at & 7).astype(np.uint64)
    lanes = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        lanes |= raw[low + k].astype(np.uint64) << np.uint64(8 * k)
    return ((lanes >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


#: Fixed multipliers of the two hashes of a piece.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The longest piece that is looked up by hash, and the bytes of text that are hashed at once.
LONGEST, SPAN = 255, 1 << 20
BLANK = 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def known_cuts(description: str) -> tuple[bool, list[bytes]]:
    """Whether a tokenizer (its JSON description) cuts texts as ``Encoder`` knows it, and its added tokens as bytes."""
    d = json.loads(description)
    cutter = d.get("pre_tokenizer") or {}
    usual = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    holds = bool(usual and not any(d.get(k) for k in ("normalizer", "truncation", "padding")) and d["model"].get("type") == "BPE")
    return holds, [t["content"].encode() for t in d.get("added_tokens") or [] if t["content"]]


class PieceHashes:
    """Two hashes (polynomials modulo 2^64) of every run of bytes between given places, from one running sum each."""

    def __init__(self) -> None:
        self.powers = [_powers(m, SPAN + 1) for m in MULTIPLIERS]

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The hashes of raw[start:end]; raw has SPAN bytes at most."""
        out = []
        for powers in self.powers:
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
            # Raised to the same power wherever the run lies.
            out.append((sums[ends] - sums[starts]) * powers[SPAN - starts])
        return out


class Encoder:
    """A public byte-level tokenizer with a bounded memory of words.

    Its pre-tokenizer always cuts before a single space or line break between
    two other characters, around such a line break, and between a letter and the
    stop or comma that ends a word. So a text without other runs of blanks is the
    sequence of its pieces (what stands between single spaces). The pieces of a
    batch are found and hashed as arrays, equal ones are encoded once, and the
    ids of all texts are gathered from one flat array. A piece is known by 128
    bits of hash; long pieces, and texts in which the cuts don't hold, are encoded whole.
    Unknown pieces are cut into units that are encoded together, as one text,
    and cut apart by the byte length of each id.

    All this holds for a byte-level pre-tokenizer with the usual pattern and no
    normalizer. With any other tokenizer, and in texts that hold one of its added
    tokens (which the library looks for before it cuts), texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.cuts_hold, self.added = known_cuts(self.model.to_str())
        self.size = self.model.get_vocab_size()
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in self.model.get_vocab().items():
            self.lengths[i] = len(token)  # one character for each byte
        self.hashes = PieceHashes()
        self.units_known: dict[str, bytes] = {}
        #: Known pieces, sorted by the first hash: the second, and where their ids lie in ``flat``. Odd ones have a count of -1.
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def units(piece: str, space: str) -> tuple[str, ...] | None:
        """The units of a piece with ``space`` (or nothing) before it; None where blanks at its ends mean that the cuts don't hold."""
        if piece.isalpha():
            return (space + piece,)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece[-1] in ".," and piece[:-1].isalpha():
            return space + piece[:-1], piece[-1]
        if "\n" not in piece:
            return (space + piece,)
        out: list[str] = []
        parts = piece.split("\n")
        if "" in parts or not all(x[0].strip() and x[-1].strip() for x in parts):
            return (space + piece,)
        for k, part in enumerate(parts):
            if k:
                out.append("\n")
                space = ""
            if part[-1] in ".," and part[:-1].isalpha():
                out += (space + part[:-1], part[-1])
            else:
                out.append(space + part)
        return tuple(out)

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of new units. Those that start with a space are strung together, the others put on lines of their own."""
        out = {"\n": self.whole(["\n"])[0].tobytes()}
        spaced = [u for u in units if u[0] == " "]
        bare = [u for u in units if u[0] != " " and u != "\n"]
        for group, between in ((spaced, ""), (bare, "\n")):
            if not group:
                continue
            ids = np.array(self.model.encode_batch_fast([between.join(group)], add_special_tokens=False)[0].ids, np.uint32)
            sizes = np.fromiter((len(u.encode()) for u in group), np.int64, len(group))
            starts = np.cumsum(sizes + len(between)) - (sizes + len(between))
            at = np.cumsum(self.lengths[ids])  # where each id ends
            first = np.searchsorted(at, starts, "right").tolist()
            last = (np.searchsorted(at, starts + sizes) + 1).tolist()
            raw = ids.tobytes()
            for unit, a, b in zip(group, first, last, strict=True):
                out[unit] = raw[4 * a : 4 * b]
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of new pieces, as bytes; a piece that starts its text has a space before it here. None is odd."""
        units = self.units
        cut = [(" " + p,) if p.isalpha() else units(p[1:], "") if p[:1] == " " else units(p, " ") for p in pieces]
        known = self.units_known
        new = {u for us in cut if us for u in us if u not in known}
        if new:
            learnt = self.learn(list(new))
            room = max(UNITS - len(known), 0)
            if room:
                known.update(learnt if len(learnt) <= room else dict(islice(learnt.items(), room)))
            if len(learnt) > room:
                known = {**known, **learnt}
        return [None if us is None else known[us[0]] if len(us) == 1 else b"".join([known[u] for u in us]) for us in cut]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        gc.disable()  # many strings and no cycle: collections would only cost time
        try:
            whole = [i for i, t in enumerate(texts) if not self.cuts_hold or any(a in t for a in self.added)]
            out, held, size = [], [], 0
            kept = set(whole)
            for i, t in enumerate(texts):
                if i in kept:
                    t = b""
                if held and size + len(t) + 1 >= SPAN:
                    out += self._encode(held)
                    held, size = [], 0
                held.append(t)
                size += len(t) + 1
            out += self._encode(held) if held else []
            for i, ids in zip(whole, self.whole([texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
                out[i] = ids
            return out
        finally:
            gc.enable()

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) + 1 >= SPAN:
            return self.whole([texts[0].decode("utf-8", "replace")])
        # Every text is preceded by a blank, which its first piece keeps as part of its own hash.
        joined = b" " + b" ".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        heads = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(raw == BLANK) + 1
        ends = np.append(starts[1:] - 1, len(raw))
        first_of = np.searchsorted(starts, heads + 1)
        begins = starts.copy()
        begins[first_of] -= 1
        h1, h2 = self.hashes(raw, begins, ends)
        key, at, inverse = np.unique(h1, return_index=True, return_inverse=True)
        other = h2[at]
        place = np.minimum(np.searchsorted(self.first, key), max(len(self.first) - 1, 0))
        taken = self.first[place] == key if len(self.first) else np.zeros(len(key), bool)
        old = taken & (self.second[place] == other) if len(self.first) else taken
        fresh = np.flatnonzero(~old)
        where, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        where[old], count[old] = self.starts[place[old]], self.counts[place[old]]
        a, b = begins[at[fresh]], ends[at[fresh]]
        short = b - a <= LONGEST
        pieces = [joined[i:j].decode("utf-8", "replace") if ok else "" for i, j, ok in zip(a.tolist(), b.tolist(), short.tolist(), strict=True)]
        ids = self.ids_of(pieces)
        count[fresh] = np.fromiter((-1 if x is None else len(x) >> 2 for x in ids), np.int64, len(ids))
        width = np.maximum(count[fresh], 0)
        where[fresh] = len(self.flat) + np.cumsum(width) - width
        flat = np.concatenate([self.flat, np.frombuffer(b"".join([x or b"" for x in ids]), np.uint32)])
        counts = count[inverse]
        # A text is encoded whole if a piece is odd, or shares its first hash alone with another.
        odd = np.logical_or.reduceat((counts < 0) | (h2 != other[inverse]), first_of)
        counts = np.maximum(counts, 0)
        stops = np.cumsum(counts)
        found = flat[np.repeat(where[inverse] - (stops - counts), counts) + np.arange(stops[-1])]
        new = np.flatnonzero(~taken)[: max(PIECES - len(self.first), 0)]
        if len(new):
            self.remember(key[new], other[new], where[new], count[new], flat)
        last = np.append(first_of[1:], len(starts)) - 1
        out, start = [], 0
        for stop in stops[last].tolist():
            out.append(found[start:stop])
            start = stop
        rest = np.flatnonzero(odd).tolist()
        for i, x in zip(rest, self.whole([texts[i].decode("utf-8", "replace") for i in rest]), strict=True):
            out[i] = x
        return out

    def remember(self, first: np.ndarray, second: np.ndarray, where: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Adds new pieces, given by the first hash in order."""
        keep = np.maximum(count, 0)
        picked = np.repeat(where - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())
        begin = len(self.flat) + np.cumsum(keep) - keep
        self.flat = np.concatenate([self.flat, flat[picked]])
        places = np.searchsorted(self.first, first)
        self.first, self.second = np.insert(self.first, places, first), np.insert(self.second, places, second)
        self.starts, self.counts = np.insert(self.starts, places, begin), np.insert(self.counts, places, count)


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, whose memory of words outlives a task."""
    return Encoder(path)


def write_blocks(docs: DataFrame, scratch: Scratch, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", partitions: int = 0) -> DataFrame:
    """Tokenises and writes all rows in ascending id order; the written blocks as a table.

    ``partitions`` (default: the session's shuffle partitions) shards are dealt
    by ranges of (id, hash of the text), so that no id is too common for a shard.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col).alias("raw")).withColumn("tie", F.xxhash64("raw"))
    dealt = dealt.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "raw").select("doc_id", "raw")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        bits, shard, block, first = id_bits(encoder.size), TaskContext.get().partitionId(), 0, 0
        end = np.array([END_ID], np.uint32)
        doc_ids, parts, offsets, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, first
            row = {"shard": [shard], "block": [block], "first": [first], "doc_ids": [doc_ids], "offsets": [offsets], "n_ids": [held], "bits": [bits], "payload": [pack(np.concatenate(parts), bits)]}
            block, first = block + 1, first + held
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in slices(batches, 1, 4 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc)
                offsets.append(held)
                parts += (ids, end)
                held += len(ids) + 1
                if held >= BLOCK_IDS:
                    yield close()
                    doc_ids, parts, offsets, held = [], [], [], 0
        if doc_ids:
            yield close()

    return scratch.table(dealt.mapInArrow(encode, BLOCK_SCHEMA), "blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Reads every block back: (doc_id, start, n_tokens, ids_crc32), ``start`` counted over all documents.

    The driver sees one row a shard (its number of ids), never documents or blocks.
    """
    before, starts = 0, []
    for shard, n in blocks.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        starts.append((shard, before))
        before += n
    offsets = blocks.sparkSession.createDataFrame(starts, "shard int, before bigint")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = np.array([*row["offsets"], row["n_ids"]], np.int64)
                raw = memoryview(unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1] + (row["before"] + row["first"])), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(offsets), "shard").select("doc_ids", "offsets", "n_ids", "bits", "payload", "first", "before").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
