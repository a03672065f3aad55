"""Substring dedup: level-wise doubling.

A window is ``WINDOW`` consecutive words of one document; each word is removed
that a window covers whose word sequence also starts in a document with a
smaller id. Windows are judged on the input.

Levels. The lengths of the levels double up to the window (13, 25, 50 words). The
hash of a longer run is made of those of two shorter ones that cover it. At each
level below the last, only the least hash of the runs in a window (its anchor) is
dealt: equal windows hold equal anchors, so no repeated window is lost, and at
the first level about two in 39 positions are dealt instead of all. Only windows
whose anchor stands in two documents are extended to the next level; at the last
one their own hashes are dealt, with the least id kept for each. If no candidate
survives a level, the search ends there.

Two windows count as equal if two hashes of different families are, of 64 bits
each, made of the two halves of a 128-bit hash of every word.

Documents of one word sequence are collapsed first: only the one with the
smallest id is searched, the others are covered whole. Every level is a grouped
minimum (summed up before the exchange) and a join that can split hot keys.

Null and empty texts have no words. A null id counts as larger than all others.
Rows that share an id, repeated rows included, don't remove each other's words.
A very long text is one row as others are. An empty table gives no row. Only
``doc_id`` and ``text`` are read, so further columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch, row_key, slices, text_bytes

WINDOW = 50
#: Words whose hashes a worker remembers at most.
WORDS = 300_000
LAST_ID = (1 << 63) - 1
NO_WORDS = hashlib.sha256(b"").hexdigest()


class WordHashes(dict):
    """The 128-bit hashes of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word, 5)
        return h

    def lanes(self, words: list[bytes]) -> np.ndarray:
        """(words, 2): the two halves of each word's hash."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)


#: Fixed odd multipliers and shifts of the two families.
MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 31, 32, 29), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 17, 29, 32))


def double(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hashes of what ``a`` and then ``b`` are the hashes of."""
    first, second, third, turn, one, two = (np.uint64(x) for x in MIX[lane])
    h = a * first ^ ((b << turn) | (b >> (np.uint64(64) - turn))) * second
    h ^= h >> one
    h *= third
    return h ^ (h >> two)


def window_hashes(single: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The hash of every window of ``length``, doubled from ``single`` words' hashes."""
    if len(single) < length:
        return np.empty(0, np.uint64)
    n, now, done, out = 1, single, 0, None
    while True:
        if length & n:
            count = len(single) - length + 1
            part = now[done : done + count]
            out, done = (part if out is None else double(out, part, lane)), done + n
        if 2 * n > length:
            return out
        now, n = double(now[:-n], now[n:], lane), 2 * n


def anchors(halves: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive hashes."""
    now, n = halves, 1
    while 2 * n <= span:
        now, n = np.minimum(now[:-n], now[n:]), 2 * n
    rest = span - n
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def lengths_of(window: int) -> list[int]:
    """The lengths of the levels: each at most twice the one before, the last the window's."""
    out = [window]
    while len(out) < 3 and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """The windows of one document: their anchors at each level below the last, and the hashes of the whole windows."""

    def __init__(self, words: list[bytes], known: WordHashes, window: int):
        self.lengths, self.window, self.n = lengths_of(window), window, len(words)
        self.lanes = known.lanes(words)
        self.runs = window_hashes(self.lanes[:, 0], self.lengths[0])

    def first_anchors(self) -> np.ndarray:
        return anchors(self.runs, self.window - self.lengths[0] + 1) if self.n >= self.window else np.empty(0, np.uint64)

    def _grown(self, runs: np.ndarray, level: int, lane: int) -> np.ndarray:
        """The hashes at ``level`` from ``runs``, those of the level before."""
        step = self.lengths[level] - self.lengths[level - 1]
        return double(runs[: len(runs) - step], runs[step:], lane)

    def extended(self, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the windows at ``starts``: their anchors at the levels between, and the two hashes of each."""
        between, whole = [], []
        for lane in (0, 1):
            runs = self.runs if lane == 0 else window_hashes(self.lanes[:, 1], self.lengths[0], 1)
            for level in range(1, len(self.lengths)):
                runs = self._grown(runs, level, lane)
                if lane == 0 and level < len(self.lengths) - 1:
                    between.append(anchors(runs, self.window - self.lengths[level] + 1)[starts])
            whole.append(runs[starts])
        return between, whole[0], whole[1]


def profile(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, n_words, seq: digest of the words, anchors) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 2, 2 << 20):
            sizes, seqs, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = text.split()
                sizes.append(len(words))
                seqs.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(Windows(words, known, window).first_anchors()).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(seqs, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "seq", "anchors"])

    return docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row"), text_bytes().alias("text")).mapInArrow(run, "doc_id bigint, row binary, n_words bigint, seq string, anchors array<bigint>")


WINDOWS = "doc_id bigint, row binary, starts array<int>, keys array<bigint>, checks array<bigint>"


def extend(held: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, starts, keys, checks, mids) of the windows of each row of ``held`` (doc_id, row, text, repeated) with a
    repeated first anchor; ``mids`` are their anchors at the level between, null where there is none."""
    between = len(lengths_of(window)) > 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 2, 2 << 20):
            columns: list[list] = [[], [], [], []]
            for text, repeated in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = Windows(text.split(), known, window)
                at = np.flatnonzero(np.isin(w.first_anchors(), np.array(repeated, np.int64).view(np.uint64)))
                mids, keys, checks = w.extended(at)
                for column, value in zip(columns, (at.astype(np.int32), keys.view(np.int64), checks.view(np.int64), mids[0].view(np.int64) if between else None), strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "row", "starts", "keys", "checks", "mids"])

    return held.mapInArrow(run, WINDOWS + ", mids array<bigint>")


def narrow(held: DataFrame) -> DataFrame:
    """The windows of each row of ``held`` (those of ``extend``, and ``repeated``) whose ``mids`` are repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for i in range(batch.num_rows):
                starts, keys, checks, mids, repeated = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 7))
                keep = np.isin(mids, repeated)
                for column, value in zip(columns, (starts, keys, checks), strict=True):
                    column.append(value[keep])
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "row", "starts", "keys", "checks"])

    return held.select("doc_id", "row", "starts", "keys", "checks", "mids", "repeated").mapInArrow(run, WINDOWS)


def remove(held: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, kept) of each row of ``held`` (row, text, starts): ``kept`` are the words left, joined by a space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2 << 20):
            gone, kept = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts, np.int64))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_removed", "kept"])

    return held.mapInArrow(run, "row binary, n_removed bigint, kept string")


def _order(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(LAST_ID))


def shared_anchors(spread: DataFrame, scratch: Scratch, level: int) -> DataFrame | None:
    """(row, repeated): of each row of ``spread`` (id, row, h) the anchors that two ids share; None if there is none."""
    twice = spread.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h")
    twice = scratch.table(twice, f"level{level}", merge=True)
    if twice.isEmpty():
        return None
    marked = scratch.table(spread.join(twice, "h").groupBy("row").agg(F.collect_set("h").alias("repeated")), f"marked{level}", merge=True)
    scratch.drop(f"level{level}")
    return marked


def candidate_windows(docs: DataFrame, firsts: DataFrame, scratch: Scratch, window: int) -> DataFrame | None:
    """(doc_id, row, starts, keys, checks): the windows of ``firsts`` (profiled rows) whose anchors at every level two ids share; None if there is none.

    ``docs`` (doc_id, row, text) gives the texts of the rows again.
    """
    marked = shared_anchors(firsts.select(_order().alias("id"), "row", F.explode("anchors").alias("h")), scratch, 1)
    if marked is None:
        return None
    windows = scratch.table(extend(docs.join(marked, "row").select("doc_id", "row", "text", "repeated"), window), "windows", merge=True)
    scratch.drop("marked1")
    if len(lengths_of(window)) < 3:
        return windows.drop("mids")
    marked = shared_anchors(windows.select(_order().alias("id"), "row", F.explode(F.array_distinct("mids")).alias("h")), scratch, 2)
    if marked is None:
        return None
    left = scratch.table(narrow(windows.join(marked, "row")), "left", merge=True)
    for name in ("windows", "marked2"):
        scratch.drop(name)
    return left


def _each(windows: DataFrame, *more: str) -> DataFrame:
    """(id, row, start, key, check) of every window."""
    zipped = windows.select(_order().alias("id"), "row", *more, F.explode(F.arrays_zip("starts", "keys", "checks")).alias("w"))
    return zipped.select("id", "row", *more, F.col("w.starts").alias("start"), F.col("w.keys").alias("key"), F.col("w.checks").alias("check"))


def repeated_starts(docs: DataFrame, firsts: DataFrame, scratch: Scratch, window: int) -> DataFrame | None:
    """(row, starts): the windows of ``firsts`` (profiled rows) that also start in a row with a smaller id; None if there is none."""
    windows = candidate_windows(docs, firsts, scratch, window)
    if windows is None:
        return None
    least = windows.select(_order().alias("id"), F.explode(F.arrays_zip("keys", "checks")).alias("w")).groupBy(F.col("w.keys").alias("key"), F.col("w.checks").alias("check"))
    least = scratch.table(least.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "check", "lo"), "last", merge=True)
    if least.isEmpty():
        return None
    found = scratch.table(_each(windows).join(least, ["key", "check"]).filter("id > lo").groupBy("row").agg(F.collect_set("start").alias("starts")), "found", merge=True)
    for name in ("windows", "left", "last"):
        scratch.drop(name)
    return found


def doubled(held: DataFrame, length: int) -> DataFrame:
    """The windows of twice ``length`` in each row of ``held`` (WINDOWS, those of ``length`` that survive): both
    halves must survive, and their hashes make the longer one's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for s, *lanes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                at = np.array(s, np.int64)
                order = np.argsort(at, kind="stable")
                at = at[order]
                other = np.minimum(np.searchsorted(at, at + length), max(len(at) - 1, 0))
                both = np.flatnonzero(at[other] == at + length) if len(at) else np.empty(0, np.int64)
                columns[0].append(at[both].astype(np.int32))
                for lane, values in enumerate(lanes):
                    key = np.array(values, np.int64).view(np.uint64)[order]
                    columns[1 + lane].append(double(key[both], key[other[both]], lane).view(np.int64))
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "row", "starts", "keys", "checks"])

    return held.select("doc_id", "row", "starts", "keys", "checks").mapInArrow(run, WINDOWS)


def repeat_levels(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, length, starts): the windows of each row that stand in a row with another id too, at the lengths
    ``window``, twice that, and so on until no candidate survives a level.

    Above the first level a window is made of two survivors of the level before, so texts aren't read again.
    """
    docs = docs.select("doc_id", "text")
    profiled = scratch.table(profile(docs, window), "profile", merge=True)
    again = docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row"), text_bytes().alias("text"))
    held = candidate_windows(again, profiled, scratch, window)
    if held is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, row binary, length int, starts array<int>")
    held = held.dropDuplicates(["row"])
    length, level, out = window, 0, None
    while True:
        each = _each(held, "doc_id")
        shared = each.groupBy("key", "check").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "check")
        kept = each.join(shared, ["key", "check"]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "key", "check"))).alias("w"))
        kept = scratch.table(kept.select("doc_id", "row", F.col("w.start").alias("starts"), F.col("w.key").alias("keys"), F.col("w.check").alias("checks")), f"kept{level}", merge=True)
        if kept.isEmpty() and out is not None:
            return out
        rows = kept.select("doc_id", "row", F.lit(length).alias("length"), "starts")
        out = rows if out is None else out.unionByName(rows)
        if kept.isEmpty():
            return out
        level += 1
        held = scratch.table(doubled(kept, length), f"windows{level}", merge=True)
        length *= 2


def deduplicate(docs: DataFrame, scratch: Scratch, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text); with ``with_text`` also ``kept``."""
    docs = docs.select("doc_id", "text")
    profiled = scratch.table(profile(docs, window), "profile", merge=True)
    first = profiled.groupBy("seq").agg(F.min(_order()).alias("__first"))
    joined = scratch.table(profiled.drop("anchors").join(first, "seq").withColumn("copy", _order() > F.col("__first")).drop("__first"), "joined", merge=True)
    firsts = profiled.join(joined.filter(~F.col("copy") & (F.col("n_words") >= window)).select("row").distinct(), "row", "left_semi")
    again = docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row"), text_bytes().alias("text"))
    starts = repeated_starts(again, firsts, scratch, window)
    scratch.drop("profile")
    whole = F.col("copy") & (F.col("n_words") >= window)
    if starts is None:
        cut = docs.sparkSession.createDataFrame([], "row binary, n_removed bigint, kept string")
    else:
        cut = remove(again.join(starts, "row").select("row", "text", "starts"), window).dropDuplicates(["row"])
    cut = cut.select("row", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if with_text else []))
    out = joined.join(cut, "row", "left")
    n_removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
    digest = F.when(whole, F.lit(NO_WORDS)).otherwise(F.coalesce("kept_sha256", "seq"))
    if with_text:
        texts = again.select("row", F.col("text").cast("string").alias("__text")).dropDuplicates(["row"])
        plain = F.trim(F.regexp_replace("__text", "[\\x20\\x09-\\x0D]+", " "))
        out = out.join(texts, "row").withColumn("kept", F.when(whole, "").otherwise(F.coalesce("kept", plain)))
    return scratch.merged(out.select("doc_id", "n_words", n_removed.alias("n_removed"), digest.alias("kept_sha256"), *(["kept"] if with_text else [])))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
    SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), f AS (
    SELECT win, min(doc_id) AS lo FROM x GROUP BY win
), hit AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (win) WHERE doc_id > lo
), gone AS (
    SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
), word AS (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT word.doc_id, string_agg(word.w[word.p], ' ' ORDER BY word.p) AS k FROM word ANTI JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
