"""Planning a transfer between two snapshots: new objects, similar bases, strategies, packing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.scalars import is_compressed_name

# The similarity window in per cent, and the limits in bytes.
SIMILARITY, MIN_FALLBACK, MAX_BSDIFF, MAX_CHUNK = 30, 4_000_000, 128_000_000, 32_000_000


#: The logarithm of a range's width: its upper bound over its lower.
STEP = math.log((100 + SIMILARITY) / (100 - SIMILARITY))


def new_objects(a: DataFrame, b: DataFrame) -> DataFrame:
    """(checksum, class) of the objects of ``b`` that ``a`` lacks: metadata, regular or symlink."""
    kind = F.when(F.col("type") == "d", "metadata").when(F.col("type") == "l", "symlink").otherwise("regular")
    return b.select("checksum", kind.alias("class")).distinct().join(a.select("checksum"), "checksum", "left_anti")


def stem(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def similar_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """(to, from, fuzzy): for each new object the old one of like size that shares a name, else the part of one before its first dot.

    Both sides are (checksum, size, name). Sizes within 30 per cent (bounds cut to
    whole bytes); the least old size wins, then the least checksum. Names are the
    key and the size range is read in sorted order, so no pairs are made: see
    ``_ranged``.
    """
    exact = _ranged(old, new, F.col("name")).withColumn("fuzzy", F.lit(0))
    fuzzy = _ranged(old, new, stem(F.col("name"))).withColumn("fuzzy", F.lit(1))
    best = exact.unionByName(fuzzy).groupBy("to").agg(F.min(F.struct("fuzzy", "size", "from")).alias("b"))
    return best.select("to", F.col("b.from").alias("from"), (F.col("b.fuzzy") == 1).alias("fuzzy"))


def _ranged(old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """(to, from, size): the least (size, from) of the old objects of the same key at or above the lower bound.

    Both sides are merged and sorted by size within a key, and the next old row
    at or after each bound is read by a window: no pairs are made, however common
    a key is. A key is parted by size into steps as wide as a range; a range meets
    three of them at most and is asked for in each, so a common name isn't one partition.
    """
    step = lambda size: F.when(size >= 1, F.floor(F.log(size.cast("double")) / STEP)).otherwise(-1).cast("int")
    lower = (F.col("size") * (100 - SIMILARITY) / 100).cast("bigint")
    upper = (F.col("size") * (100 + SIMILARITY) / 100).cast("bigint")
    nothing = F.lit(None).cast("string")
    asks = new.select(key.alias("k"), F.explode(F.sequence(step(lower), step(upper))).alias("part"), lower.alias("at"), F.lit(0).alias("side"), F.col("checksum").alias("to"), nothing.alias("from"), upper.alias("upper"))
    gives = old.select(key.alias("k"), step(F.col("size")).alias("part"), F.col("size").alias("at"), F.lit(1).alias("side"), nothing.alias("to"), F.col("checksum").alias("from"), F.lit(None).cast("bigint").alias("upper"))
    # An ask sorts before the rows at its bound; the first row that follows it in the same key is its base.
    w = Window.partitionBy("k", "part").orderBy("at", "side", "from").rowsBetween(1, Window.unboundedFollowing)
    nearest = F.first(F.when(F.col("side") == 1, F.struct("at", "from")), ignorenulls=True).over(w)
    found = asks.unionByName(gives).withColumn("near", nearest).filter((F.col("side") == 0) & (F.col("near.at") <= F.col("upper")))
    return found.groupBy("to").agg(F.min(F.struct(F.col("near.at").alias("size"), F.col("near.from").alias("from"))).alias("m")).select("to", "m.from", "m.size")


def plan(new: DataFrame, similar: DataFrame, old: DataFrame, min_fallback: int = MIN_FALLBACK, max_bsdiff: int = MAX_BSDIFF) -> DataFrame:
    """(checksum, strategy, from, size): how each new object is sent.

    ``new`` is (checksum, size, name, mode), ``old`` (checksum, size, mode). A base must be
    world-readable; empty files and names of compressed files get no binary delta.
    """
    names = new.groupBy("checksum").agg(F.max("size").alias("size"), F.collect_set("name").alias("names"))
    base = similar.join(old.groupBy(F.col("checksum").alias("from")).agg(F.max("size").alias("from_size"), F.max("mode").alias("from_mode")), "from")
    j = names.join(base, names["checksum"] == base["to"], "left")
    usable = F.col("from").isNotNull() & (F.col("from_mode").bitwiseAND(4) != 0) & (F.col("size") > 0) & ~is_compressed_name(F.col("names"))
    strategy = F.when(usable & (F.col("size") + F.col("from_size") <= max_bsdiff), "bsdiff").when(F.col("size") > min_fallback, "fallback").otherwise("inline")
    return j.select("checksum", strategy.alias("strategy"), F.when(strategy == "bsdiff", F.col("from")).alias("from"), "size")


def pack_parts(objects: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """(delta, seq, checksum, part): objects (delta, seq, checksum, size, kind) put into parts in order, first fit.

    A plain object opens a new part if the current one isn't empty and would grow
    beyond the limit; patched ones (kind ``patch``) only if it already has. One
    delta is one sequential scan; deltas are dealt over the cluster.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        part, used, held, parts = 0, 0, 0, []
        for size, kind in zip(rows["size"], rows["kind"], strict=True):
            over = used > max_chunk if kind == "patch" else held > 0 and used + size > max_chunk
            if over:
                part, used, held = part + 1, 0, 0
            used, held = used + size, held + 1
            parts.append(part)
        return pd.DataFrame({"delta": rows["delta"], "seq": rows["seq"], "checksum": rows["checksum"], "part": parts})

    return objects.groupBy("delta").applyInPandas(scan, "delta string, seq bigint, checksum string, part int")


def dictionary(objects: DataFrame, *columns: str) -> DataFrame:
    """Adds ``code``: the number of the distinct values of ``columns`` in order, from 0.

    Only the distinct values are ranked, not the objects.
    """
    values = objects.select(*columns).distinct()
    rank = F.dense_rank().over(Window.orderBy(*columns)) - 1
    return objects.join(F.broadcast(values.withColumn("code", rank)) if values.limit(10_001).count() <= 10_000 else values.withColumn("code", rank), list(columns))


def missing_parts(parts: DataFrame, held: DataFrame) -> DataFrame:
    """Parts (part, checksum rows) of which some object isn't held; the others are skipped when a delta is applied."""
    return parts.join(held.select("checksum"), "checksum", "left_anti").select("part").distinct()


def guess_swapped(parts: DataFrame) -> DataFrame:
    """(delta, swapped): whether a delta's sizes (size, usize, n_objects) look byte-swapped."""
    odd = F.bool_or(F.col("size") > 1.2 * F.col("usize")) | (F.sum("usize") / F.sum("n_objects") > float(1 << 32))
    return parts.groupBy("delta").agg(F.coalesce(odd, F.lit(False)).alias("swapped"))


