"""Media columns: TIFF.

``encode_tiff`` stores samples as a TIFF file; ``decode_pages`` walks the image
directories of a TIFF (or BigTIFF) of 1-, 8- or 16-bit samples and yields one page
per directory: it reads strips or tiles, interleaved or one plane after another,
undoes no compression, PackBits, LZW or deflate, and undoes the horizontal
predictor. ``tiff_pages`` applies it to a media column and emits one row per page.
A page's pixels are one byte a sample (0 or 1 for 1-bit samples), or two, the least
significant first, for 16-bit ones.

Null media give no page. A fault gives one row with ``error`` after the pages that
could be read before it, also where the first header is broken or empty; a forged
size is a fault, found before memory is taken for it. A page of 2 GiB or more is a
fault too: it fits no cell. Rows are independent, so ties and repeated rows need no
care and no data are exchanged; an empty table gives no row, and columns named like
a page's own are dropped in favour of those.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import slices, small_batches, text_bytes

# Fixed values of the TIFF 6.0 format.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR_CODE, END_CODE = 256, 257
CLASSIC, BIG = 42, 43
#: The largest value of a cell in bytes.
CELL = (1 << 31) - 1


class TiffError(ValueError):
    """The bytes are no TIFF that can be read here."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes
    bits: int = 8


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a signed count byte, then literals or one repeated byte."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = at + 1
        while run < len(data) and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at > 1:
            out += bytes((257 - (run - at), data[at]))
            at = run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def lzw_widths() -> np.ndarray:
    """The width of each code after a clear code: 9 bits, and one more as soon as the table is one entry short of needing it."""
    entries = np.arange(1 << 12) + CLEAR_CODE + 1  # in the table when the k-th code is read, the first adding none
    entries[0] += 1
    return np.where(entries + 1 >= 2048, 12, np.where(entries + 1 >= 1024, 11, np.where(entries + 1 >= 512, 10, 9)))


LZW_WIDTHS = lzw_widths()
LZW_PLACES = np.concatenate([[0], np.cumsum(LZW_WIDTHS)])


def lzw_codes(raw: np.ndarray, bit: int, end: int) -> np.ndarray:
    """The codes from ``bit`` on, as many as one table can serve and the stream holds; most significant bit first."""
    at = bit + LZW_PLACES[:-1]
    at = at[at + LZW_WIDTHS <= end]
    width = LZW_WIDTHS[: len(at)]
    byte = at >> 3
    three = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
    return three >> (24 - (at & 7) - width) & ((1 << width) - 1)


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early.

    An entry of the table is what a code put out, with the byte that followed it: a place and a length in the output.
    """
    raw, end = np.frombuffer(data + b"\0\0", np.uint8), 8 * len(data)
    out, bit = bytearray(), 0
    while len(out) < size:
        codes = lzw_codes(raw, bit, end).tolist()
        places: list[tuple[int, int]] = []  # of the entries from 258 on
        before, stop = None, False
        for k, code in enumerate(codes):
            if code < CLEAR_CODE:
                here = len(out)
                out.append(code)
            elif code == CLEAR_CODE:
                bit += int(LZW_PLACES[k + 1])
                break
            elif code == END_CODE:
                stop = True
                break
            else:
                here, entry = len(out), code - CLEAR_CODE - 2
                if before is None:
                    raise TiffError("LZW stream starts with an unknown code")
                if entry > len(places):
                    raise TiffError("LZW code beyond the table")
                start, n = places[entry] if entry < len(places) else (before, here - before + 1)
                out += out[start : start + n]
                if len(out) - here < n:
                    out.append(out[start])
            if before is not None:
                places.append((before, here - before + 1))
            before = here
            if len(out) >= size:
                stop = True
                break
        else:
            # The stream ends, or a table is full and no clear code came.
            if len(codes) == len(LZW_WIDTHS):
                raise TiffError("LZW table overflows")
            stop = True
        if stop:
            break
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    count, width, prefix = 258, 9, b""
    put(CLEAR_CODE, width)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = count
        count += 1
        if count >= 1 << width:
            width += 1
        if count >= 4094:
            put(CLEAR_CODE, min(width, 12))
            table = {bytes((i,)): i for i in range(256)}
            count, width = 258, 9
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        count += 1
        if count >= 1 << width and width < 12:
            width += 1
    put(END_CODE, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return pack_bits(data)
    if how == LZW:
        return lzw_encode(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    raise TiffError(f"compression {how} is not supported")


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    raise TiffError(f"compression {how} is not supported")


def _rows_of_bits(block: np.ndarray) -> bytes:
    """1-bit samples (rows, width): eight a byte, each row padded to a byte."""
    return np.packbits(block, axis=1).tobytes()


def encode_tiff(pages: Iterable[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 0, tile: tuple[int, int] | None = None, byte_order: str = "<", planar: bool = False, big: bool = False) -> bytes:
    """A TIFF of one directory per page; a page is (height, width) or (height, width, samples) of uint8, uint16 or (one sample) bool.

    ``tile`` is (tile length, tile width); without it the page is cut into strips of ``rows_per_strip`` rows (0: one
    strip). ``planar`` stores the samples one plane after another, ``big`` writes 64-bit offsets.
    """
    word, entry, count_of = ("Q", "HHQ", "Q") if big else ("I", "HHI", "H")
    wide = 8 if big else 4
    head = struct.pack(byte_order + "HHH", BIG, 8, 0) if big else struct.pack(byte_order + "H", CLASSIC)
    out = bytearray((b"II" if byte_order == "<" else b"MM") + head)
    link = len(out)
    out += bytes(wide)
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        bits = {"b": 1, "u": 8 * page.dtype.itemsize}[page.dtype.kind]
        step = rows_per_strip or height
        blocks = []
        for plane in [page[:, :, k : k + 1] for k in range(samples)] if planar else [page]:
            if tile:
                th, tw = tile
                padded = np.pad(plane, ((0, -height % th), (0, -width % tw), (0, 0)))
                blocks += [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
            else:
                blocks += [plane[y : y + step] for y in range(0, height, step)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _compress(_rows_of_bits(block[:, :, 0]) if bits == 1 else block.astype(f"{byte_order}u{bits // 8}").tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [bits] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples >= 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [2 if planar else 1]), PREDICTOR: (3, [predictor])}
        far = 16 if big else 4
        if tile:
            tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_LENGTH: (4, [tile[0]]), TILE_OFFSETS: (far, offsets), TILE_COUNTS: (far, counts)}
        else:
            tags |= {ROWS_PER_STRIP: (4, [step]), STRIP_OFFSETS: (far, offsets), STRIP_COUNTS: (far, counts)}
        out += b"\0" * (len(out) % 2)
        entries = bytearray()
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(byte_order + FORMAT[kind] * len(values), *values)
            if len(raw) > wide:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(byte_order + word, at)
            entries += struct.pack(byte_order + entry, tag, kind, len(values)) + raw.ljust(wide, b"\0")
        struct.pack_into(byte_order + word, out, link, len(out))
        out += struct.pack(byte_order + count_of, len(tags)) + entries
        link = len(out)
        out += bytes(wide)
    return bytes(out)


#: The types of the values that are read: bytes, 16-, 32- and 64-bit numbers.
FORMAT = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _directory(data: bytes, order: str, at: int, big: bool) -> tuple[dict[int, list[int]], int]:
    word, entry, count_of = ("Q", "HHQ", "Q") if big else ("I", "HHI", "H")
    wide, head = (8, 8) if big else (4, 2)
    (n,) = struct.unpack_from(order + count_of, data, at)
    step = 4 + 2 * wide
    if at + head + step * n > len(data):
        raise TiffError("a directory lies beyond the file")
    tags: dict[int, list[int]] = {}
    for i in range(n):
        place = at + head + step * i
        tag, kind, count = struct.unpack_from(order + entry, data, place)
        if kind not in FORMAT:
            continue
        size = TYPE_SIZE[kind] * count
        where = place + 4 + wide
        if size > wide:
            (where,) = struct.unpack_from(order + word, data, where)
        if where + size > len(data):
            raise TiffError("a tag's values lie beyond the file")
        tags[tag] = list(struct.unpack_from(order + FORMAT[kind] * count, data, where))
    (following,) = struct.unpack_from(order + word, data, at + head + step * n)
    return tags, following


def decode_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in directory order; raises TiffError at the first that can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    kind = struct.unpack_from(order + "H", data, 2)[0] if order and len(data) >= 8 else 0
    if kind not in (CLASSIC, BIG) or (kind == BIG and (len(data) < 16 or struct.unpack_from(order + "HH", data, 4) != (8, 0))):
        raise TiffError("not a TIFF header")
    (at,) = struct.unpack_from(order + "Q", data, 8) if kind == BIG else struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        try:
            tags, following = _directory(data, order, at, kind == BIG)
            yield _page(data, order, tags, len(seen) - 1)
        except (struct.error, KeyError, IndexError, ValueError, OverflowError, MemoryError) as e:
            raise e if isinstance(e, TiffError) else TiffError(f"broken directory: {e or type(e).__name__}") from e
        at = following


def _page(data: bytes, order: str, tags: dict[int, list[int]], index: int) -> Page:
    width, height = tags[WIDTH][0], tags[LENGTH][0]
    samples, how, predictor, layout = (tags.get(t, [1])[0] for t in (SAMPLES, COMPRESSION, PREDICTOR, PLANAR))
    depths = set(tags.get(BITS, [1]))
    bits = min(depths)
    if len(depths) != 1 or bits not in (1, 8, 16) or (bits == 1 and (samples > 1 or predictor == 2)):
        raise TiffError("only 8- and 16-bit samples, and one of 1 bit, are supported")
    if predictor not in (1, 2) or layout not in (1, 2):
        raise TiffError(f"predictor {predictor} with layout {layout} is not supported")
    planes = samples if layout == 2 else 1
    per = samples // planes
    tiled = TILE_OFFSETS in tags
    if tiled:
        bh, bw, offsets, counts = tags[TILE_LENGTH][0], tags[TILE_WIDTH][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bh, bw, offsets, counts = min(tags.get(ROWS_PER_STRIP, [height])[0], height), width, tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not (width and height and samples and bh and bw):
        raise TiffError("a page without pixels")
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) < planes * across * down or len(counts) < len(offsets):
        raise TiffError("too few strips or tiles")
    line = -(-bw // 8) if bits == 1 else bw * per * bits // 8
    if height * width * samples * max(bits // 8, 1) > CELL or line * bh > CELL:
        raise TiffError("a page beyond 2 GiB")
    # Every strip or tile is expanded, and found to hold what the sizes claim, before memory is taken for the page.
    blocks = []
    for i in range(planes * across * down):
        y = i // across % down * bh
        size = (bh if tiled else min(bh, height - y)) * line
        raw = _expand(data[offsets[i] : offsets[i] + counts[i]], how, size)
        if len(raw) < size:
            raise TiffError("a strip or tile is too short")
        blocks.append(raw)
    kind = np.dtype(f"{order}u{bits // 8}") if bits > 1 else np.dtype(np.uint8)
    image = np.empty((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    for i, raw in enumerate(blocks):
        plane, place = divmod(i, across * down)
        y, x = place // across * bh, place % across * bw
        rows = len(raw) // line
        if bits == 1:
            block = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, :bw, None]
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        image[y : y + rows, x : x + bw, plane * per : (plane + 1) * per] = block[: height - y, : width - x]
    return Page(index, width, height, samples, how, predictor, tiled, image.astype("<u2").tobytes() if bits == 16 else image.tobytes(), bits)


PAGE_FIELDS = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, bits int, error string"


def readable_pages(data: bytes) -> tuple[list[Page], str | None]:
    """The pages up to the first fault, and that fault."""
    found: list[Page] = []
    try:
        for page in decode_pages(data):
            found.append(page)
    except TiffError as e:
        return found, str(e)
    return found, None


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF in ``media_col``, beside the other columns of ``df``.

    Columns of ``df`` named like a page's own are dropped in favour of those.
    """
    small_batches(df.sparkSession)
    own = {f.split()[0] for f in PAGE_FIELDS.split(", ")}
    kept = [c for c in df.columns if c not in own and c != media_col]
    fields = df.select(*kept).schema

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept), 4 << 20):
            at, rows = [], []
            for i, media in enumerate(batch.column(len(kept)).to_pylist()):
                if media is None:
                    continue
                pages, fault = readable_pages(media)
                found = [(p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data, p.bits, None) for p in pages]
                found += [(None,) * 9 + (fault,)] if fault else []
                rows += found
                at += [i] * len(found)
            columns = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(len(kept))]
            kinds = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.int32(), pa.string()]
            columns += [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=kept + [f.split()[0] for f in PAGE_FIELDS.split(", ")])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + PAGE_FIELDS.split(", "))
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(media_col).cast("binary").alias("__media")).mapInArrow(read, schema)


#: A row of the stored image has so many samples; a strip has so many rows.
ROW, STRIP = 64, 256


def store_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_bytes`` and ``media``: the text's UTF-8 bytes, padded with 0 to rows of 64 samples, as a TIFF.

    Null is an empty text, stored as one row of zeros. The file depends on the text alone.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("n_bytes", "media", text_col)]
    fields = df.select(*kept).schema

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(kept), 4 << 20):
            sizes, media = [], []
            for raw in batch.column(len(kept)).to_pylist():
                sizes.append(len(raw))
                image = np.frombuffer(raw + b"\0" * (max(-(-len(raw) // ROW), 1) * ROW - len(raw)), np.uint8)
                media.append(encode_tiff([image.reshape(-1, ROW)], DEFLATE, 2, STRIP))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*kept, "n_bytes", "media"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes bigint", "media binary"])
    return df.select(*[F.col(f"`{c}`") for c in kept], text_bytes(text_col).alias("__text")).mapInArrow(write, schema)


def media_digest(df: DataFrame) -> DataFrame:
    """The digests of ``store_text``'s rows (doc_id, n_bytes, media), read back page by page."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in batch.column(2).to_pylist():
                pages = list(decode_pages(media))
                payload = b"".join(p.data for p in pages)
                seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = seen[seen > 0] / len(payload)
                feature = f"pages={len(pages)};size={pages[0].width}x{pages[0].height};levels={len(share)};mean={sum(int(n) * i for i, n in enumerate(seen)) / len(payload):.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [batch.column(0), batch.column(1)] + [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(digest, schema)
