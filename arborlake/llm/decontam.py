"""Benchmark decontamination: a distributed positional inverted index.

``build_index`` stores the postings of all tokens of the corpus, partitioned by
document: a segment is the index of a few megabytes of whole documents, with its
own dictionary and, for each term, the sorted positions where it stands. A term
that is common in the corpus has many segments, never one long list.

``find`` takes the windows of the test items in blocks of bounded size. In every
segment a window's lists are intersected from its rarest term on: the rarest
term's positions, less its offset in the window, are the candidate starts, and
each further list (moved by its own offset) keeps those that it holds too. With
``slop`` above 0 a start is a proximity match if the document holds, for each term
of the window, that term up to ``slop`` words off its place; the window from that
start on lies in the document and is what counts as covered. Every start up to
``slop`` words around those that the rarest term gives is tried, so a match is a
matter of the document alone, whichever term is rarest in its segment.

Null text has no words and null items no windows; an item without id counts as
an item but is left out of the list of ids. Rows that share an id, repeated rows
included, are separate rows, each with its own result. A very long text is a
segment by itself. An empty table of documents gives no row, one of items no hit.
Only the id and text columns are read, so further ones change nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch, slices, text_bytes

WINDOW = 13
#: Bytes of text indexed in one segment, of items whose windows are held at once, and of items that are broadcast for one pass.
SEGMENT_BYTES, BLOCK_BYTES, PASS_BYTES = 4 << 20, 1 << 20, 32 << 20
#: Segments that a task keeps while it goes through the blocks of a pass.
KEPT = 8
#: Candidate starts that are checked at once.
CANDIDATES = 1 << 21

#: Lower-cased ASCII letters, digits and everything beyond ASCII; on UTF-8 bytes, where bytes.lower() changes A-Z alone.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The ids are longs; {} is ``bigint``, or ``binary`` where rows are named by longer keys.
SEGMENT = "segment bigint, doc_ids array<{}>, n_words array<bigint>, terms binary, heads binary, postings binary"
MATCHES = "segment bigint, doc int, doc_id {}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>, n_items bigint"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the index of all rows of ``docs`` to the shared folder; the table of its segments."""
    kind = "binary" if docs.schema[id_col].dataType.simpleString() == "binary" else "bigint"
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0
        for batch in slices(batches, 1, 1 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text) + 16
                if held >= segment_bytes:
                    yield segment(number, ids, texts, arrow)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield segment(number, ids, texts, arrow)

    return scratch.table(docs.select(F.col(id_col).cast(kind).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(index, SEGMENT.format(kind)), "index")


def segment(number: int, ids: list, texts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    """The index of some documents. Their words are numbered through, with one number left out between documents."""
    term_of: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        parts.append(np.fromiter(map(term_of.__getitem__, words), np.int32, len(words)))
    first = bases(np.array(sizes, np.int64))
    terms = np.concatenate(parts)
    places = np.concatenate([np.arange(b, b + n, dtype=np.uint32) for b, n in zip(first.tolist(), sizes, strict=True)])
    order = np.argsort(terms, kind="stable")
    heads = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(term_of)))]).astype(np.uint32)
    row = [[number], [ids], [sizes], [b"\n".join(term_of)], [heads.tobytes()], [places[order].tobytes()]]
    kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["segment", "doc_ids", "n_words", "terms", "heads", "postings"])


def bases(sizes: np.ndarray) -> np.ndarray:
    """The number of each document's first word."""
    return np.cumsum(sizes + 1) - (sizes + 1)


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        term_of: defaultdict[bytes, int] = defaultdict(count().__next__)
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.items: list[int | None] = []
        for item, text in items:
            ids = [term_of[w] for w in words_of(text)]
            self.items.append(item)
            for at in range(max(len(ids) - window + 1, 1) if ids else 0):
                found[tuple(ids[at : at + window])].add(len(self.items) - 1)
        self.terms = list(term_of)
        self.rows = np.full((len(found), window), -1, np.int64)
        for i, key in enumerate(found):
            self.rows[i, : len(key)] = key
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.owners = [sorted(v) for v in found.values()]


def search(row: dict, windows: Windows, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The occurrences of the windows in a segment, in lots: (window number, number of the first word)."""
    at = {t: i for i, t in enumerate(row["terms"].split(b"\n"))} if row["terms"] else {}
    heads = np.frombuffer(row["heads"], np.uint32).astype(np.int64)
    places = np.frombuffer(row["postings"], np.uint32)
    sizes = np.array(row["n_words"], np.int64)
    first = bases(sizes)
    local = np.array([at.get(t, -1) for t in windows.terms] + [-2], np.int64)
    rows = local[windows.rows]  # -1 is a term that the segment lacks, -2 lies beyond a short window
    alive = np.flatnonzero((rows != -1).all(axis=1))
    if not len(alive):
        return
    rows = rows[alive]
    counts = np.where(rows >= 0, heads[np.maximum(rows, 0) + 1] - heads[np.maximum(rows, 0)], np.iinfo(np.int64).max)
    rarest_first = np.argsort(counts, axis=1, kind="stable")
    lead = rarest_first[:, 0]
    n_lead = counts[np.arange(len(rows)), lead]
    # A posting's key is its term and its place, so one sorted array holds every list.
    keys = (np.repeat(np.arange(len(heads) - 1, dtype=np.uint64), np.diff(heads)) << np.uint64(32)) | places
    lots = np.cumsum(n_lead) * (2 * slop + 1) // CANDIDATES
    for lot in np.unique(lots):
        mine = np.flatnonzero(lots == lot)
        n = n_lead[mine]
        which = np.repeat(mine, n)
        begin = heads[rows[mine, lead[mine]]]
        stands = places[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        doc = np.searchsorted(first, stands, "right") - 1
        starts = stands - lead[which]
        if slop:
            moves = np.tile(np.arange(-slop, slop + 1), len(starts))
            which, starts, doc = (np.repeat(x, 2 * slop + 1) for x in (which, starts, doc))
            which, starts, doc = np.unique(np.stack([which, starts + moves, doc]), axis=1)
        fits = (starts >= first[doc]) & (starts + windows.lengths[alive[which]] <= first[doc] + sizes[doc])
        which, starts, doc = which[fits], starts[fits], doc[fits]
        for k in range(1, rows.shape[1]):
            offset = rarest_first[which, k]
            term = rows[which, offset]
            checked = term >= 0
            place = starts + offset
            low = np.maximum(place - slop, first[doc])
            high = np.minimum(place + slop, first[doc] + sizes[doc] - 1)
            base = np.maximum(term, 0).astype(np.uint64) << np.uint64(32)
            i = np.searchsorted(keys, base | low.astype(np.uint64))
            there = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= (base | high.astype(np.uint64)))
            keep = ~checked | there
            which, starts, doc = which[keep], starts[keep], doc[keep]
            if not len(which):
                break
        if len(which):
            yield alive[which], starts


def match_segment(row: dict, windows: Windows, slop: int = 0) -> tuple[list, list, list]:
    """For each document of a segment the covered spans (merged, in words), the item ids and the number of items."""
    sizes = np.array(row["n_words"], np.int64)
    first = bases(sizes)
    edge = np.zeros(int(first[-1] + sizes[-1]) + 2, np.int64)
    pairs: set[tuple[int, int]] = set()
    for window, start in search(row, windows, slop):
        np.add.at(edge, start, 1)
        np.add.at(edge, start + windows.lengths[window], -1)
        doc = np.searchsorted(first, start, "right") - 1
        for w, d in set(zip(window.tolist(), doc.tolist(), strict=True)):
            pairs.update((d, i) for i in windows.owners[w])
    spans: list[list] = [[] for _ in sizes]
    items: list[list] = [[] for _ in sizes]
    total = [0] * len(sizes)
    for d, i in sorted(pairs):
        total[d] += 1
        if windows.items[i] is not None:
            items[d].append(windows.items[i])
    covered = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    for d, a, b in zip((np.searchsorted(first, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    return spans, items, total


def _distinct_items(items: list[tuple[int | None, bytes]]) -> list[tuple[int | None, bytes]]:
    return list(dict.fromkeys(items))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, read as a stream in the order of their ids; an item isn't cut."""
    block: list[tuple[int | None, bytes]] = []
    held = 0
    for item, text in items.select(F.col(id_col).cast("bigint"), text_bytes(text_col)).orderBy(id_col).toLocalIterator():
        if held >= block_bytes and block[-1][0] != item:
            yield _distinct_items(block)
            block, held = [], 0
        block.append((item, bytes(text)))
        held += len(text) + 16
    yield _distinct_items(block)


def passes_of(blocks: Iterator[list], block_bytes: int, pass_bytes: int) -> Iterator[list[list]]:
    """The blocks in runs of about ``pass_bytes``."""
    n = max(pass_bytes // max(block_bytes, 1), 1)
    while run := list(islice(blocks, n)):
        yield run


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per indexed document: (doc_id, n_words, spans, items, n_items).

    ``spans`` are the words covered by any occurrence, merged; ``items`` the ids
    of the items that have an occurring window. A pass over the index takes
    ``pass_bytes`` of items, broadcast (of bounded size); a task goes through them
    block by block, with a few segments at a time.
    """
    spark: SparkSession = index.sparkSession
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    id_type = pa.binary() if id_kind == "binary" else pa.int64()
    schema = MATCHES.format(id_kind)
    names = [f.split()[0] for f in schema.split(", ")]

    def one_pass(blocks: list[list[tuple[int | None, bytes]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(blocks)

        def matched(rows: list[dict], only: Windows | None) -> Iterator[pa.RecordBatch]:
            found = [[match_segment(row, only, slop)] for row in rows] if only else [[] for _ in rows]
            for block in [] if only else shared.value:
                windows = Windows(block, window)
                for row, parts in zip(rows, found, strict=True):
                    parts.append(match_segment(row, windows, slop))
            for row, parts in zip(rows, found, strict=True):
                spans, ids, total = parts[0] if len(parts) == 1 else united(parts)
                n = len(ids)
                columns = [[row["segment"]] * n, list(range(n)), row["doc_ids"], row["n_words"], spans, ids, total]
                kinds = [pa.int64(), pa.int32(), id_type, pa.int64(), span, pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only = Windows(shared.value[0], window) if len(shared.value) == 1 else None
            rows: list[dict] = []
            for batch in batches:
                for i in range(batch.num_rows):
                    rows += batch.slice(i, 1).to_pylist()
                    if only or len(rows) == KEPT:
                        yield from matched(rows, only)
                        rows = []
            if rows:
                yield from matched(rows, only)

        return index.mapInArrow(run, schema)

    passes = [one_pass(b) for b in passes_of(item_blocks(items, block_bytes=block_bytes), block_bytes, pass_bytes)]
    out = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            out = out.unionByName(p)
        # An id's items are all in one block, so ids and counts of the passes add up; spans may overlap and are merged.
        merged = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))),
            F.array().cast("array<struct<start:bigint,end:bigint>>"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
        )
        out = out.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged.alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.sum("n_items").alias("n_items"))
    return out.select("doc_id", "n_words", "spans", F.array_distinct("items").alias("items"), "n_items")


def united(parts: list[tuple[list, list, list]]) -> tuple[list, list, list]:
    """The results of several blocks of items for one segment, document by document: spans merged, ids and counts added up."""
    spans, items, total = [], [], []
    for of_doc in zip(*(p[0] for p in parts), strict=True):
        merged: list[dict] = []
        for s in sorted((s for own in of_doc for s in own), key=lambda s: (s["start"], s["end"])):
            if merged and merged[-1]["end"] >= s["start"]:
                merged[-1]["end"] = max(merged[-1]["end"], s["end"])
            else:
                merged.append(dict(s))
        spans.append(merged)
    for of_doc in zip(*(p[1] for p in parts), strict=True):
        items.append([i for own in of_doc for i in own])
    for of_doc in zip(*(p[2] for p in parts), strict=True):
        total.append(sum(of_doc))
    return spans, items, total


def verdict(found: DataFrame) -> DataFrame:
    """The digest of ``find``'s rows: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
    SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
