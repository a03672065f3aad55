"""Diffs, overlays and merges of flattened trees.

A tree is a DataFrame with a row per path: ``path``, ``type`` (f, l or d),
``checksum`` (a directory's is that of its metadata) and any further columns.
Ancestor conditions are equi-joins on exploded ancestors, never prefix joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.sources.project import ancestors, parent_of


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, kind): M, D and A between two snapshots.

    A removed directory is reported alone, an added one with all it holds; a
    change of type is one M, with nothing reported below it.
    """
    both = a.select("path", F.col("type").alias("ta"), F.col("checksum").alias("ca")).join(b.select("path", F.col("type").alias("tb"), F.col("checksum").alias("cb")), "path", "full_outer")
    kind = F.when(F.col("tb").isNull(), "D").when(F.col("ta").isNull(), "A").when((F.col("ta") != F.col("tb")) | (F.col("ca") != F.col("cb")), "M")
    rows = both.withColumn("kind", kind).filter("kind IS NOT NULL")
    # A removed path shows if its directory is still one (or is the root): else that one shows, or changed its type.
    dirs = b.filter("type = 'd'").select(F.col("path").alias("dir"))
    removed = rows.filter("kind = 'D'").select("path", "kind", parent_of(F.col("path")).alias("dir"))
    removed = removed.filter("dir = ''").select("path", "kind").unionByName(removed.join(dirs, "dir", "left_semi").select("path", "kind"))
    # An added path hides if something above it was no directory before.
    added = rows.filter("kind = 'A'").select("path", "kind")
    plain = a.filter("type <> 'd'").select(F.col("path").alias("up"))
    hidden = added.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(plain, "up", "left_semi").select("path")
    return rows.filter("kind = 'M'").select("path", "kind").unionByName(removed).unionByName(added.join(hidden, "path", "left_anti"))


def in_output_order(changes: DataFrame) -> DataFrame:
    """M, then D, then A, each by path."""
    return changes.orderBy(F.when(F.col("kind") == "M", 0).when(F.col("kind") == "D", 1).otherwise(2), "path")


def diff_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Objects (checksum, size) of two closures: how many each has, how many both have, and the bytes of those."""
    counts = a.select("checksum", "size", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("checksum", "size", F.lit(0), F.lit(1))).groupBy("checksum").agg(F.max("size").alias("size"), F.max("x").alias("x"), F.max("y").alias("y"))
    shared = F.col("x") * F.col("y")
    return counts.agg(F.sum("x").alias("n_from"), F.sum("y").alias("n_to"), F.sum(shared).alias("n_common"), F.coalesce(F.sum(F.when(shared == 1, F.col("size"))), F.lit(0)).cast("bigint").alias("bytes_common"))


def overlay(layers: DataFrame) -> DataFrame:
    """The path-wise union of ``layers`` (layer, path, type, checksum): the highest layer wins each path."""
    best = layers.groupBy("path").agg(F.max_by(F.struct("layer", "type", "checksum"), "layer").alias("w"))
    return best.select("path", "w.layer", "w.type", "w.checksum")


def overlay_conflicts(layers: DataFrame) -> DataFrame:
    """Paths that one layer has as a directory (given or implied) and another as something else."""
    plain = layers.filter("type <> 'd'").select("path").distinct()
    dirs = layers.filter("type = 'd'").select("path").union(layers.select(F.explode(ancestors(F.col("path"))).alias("path"))).distinct()
    return plain.join(dirs, "path", "left_semi")


def checkout(source: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """(path, type, checksum, action) of checking ``source`` out over ``target``.

    ``none``: any path that is there is a conflict. ``union_files``: the source
    replaces files. ``add_files``: what is there stays. ``union_identical``: as
    ``add_files``, but different content is a conflict. Directories merge in all
    but ``none``; a file against a directory is a conflict in all.
    """
    s = source.select("path", F.col("type").alias("st"), F.col("checksum").alias("sc"))
    t = target.select("path", F.col("type").alias("tt"), F.col("checksum").alias("tc"))
    both = s.join(t, "path", "full_outer")
    in_s, in_t = F.col("st").isNotNull(), F.col("tt").isNotNull()
    clash = (F.col("st") == "d") != (F.col("tt") == "d")
    same = (F.col("st") == F.col("tt")) & (F.col("sc") == F.col("tc"))
    dirs = (F.col("st") == "d") & (F.col("tt") == "d")
    met = {
        "none": F.lit("conflict"),
        "union_files": F.when(clash, "conflict").when(dirs, "keep").otherwise("replace"),
        "add_files": F.when(clash, "conflict").otherwise("keep"),
        "union_identical": F.when(clash, "conflict").when(dirs | same, "keep").otherwise("conflict"),
    }[mode]
    action = F.when(in_s & ~in_t, "add").when(~in_s & in_t, "keep").otherwise(met)
    wins = F.col("action").isin("add", "replace")
    return both.withColumn("action", action).select("path", F.when(wins, F.col("st")).otherwise(F.col("tt")).alias("type"), F.when(wins, F.col("sc")).otherwise(F.col("tc")).alias("checksum"), "action")


WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def apply_whiteouts(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``upper`` over ``lower``: ``.wh.NAME`` deletes NAME and what is below it, ``.wh..wh..opq`` empties its directory of lower entries."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    base = parent_of(F.col("path"))
    marks = upper.filter(name.startswith(WHITEOUT))
    opaque = marks.filter(name == OPAQUE).select(base.alias("up"))
    gone = marks.filter(name != OPAQUE).select(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))).alias("dir"), F.substring(name, len(WHITEOUT) + 1, 1 << 20).alias("name")).select(F.concat("dir", "name").alias("path"))
    above = lower.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.lit(""))).alias("up"))
    hidden = above.join(opaque, "up", "left_semi").select("path").union(above.join(gone.select(F.col("path").alias("up")), "up", "left_semi").select("path")).union(lower.select("path").join(gone, "path", "left_semi"))
    kept = lower.join(hidden.distinct(), "path", "left_anti").select("path", "type", "checksum", F.lit(0).alias("layer"))
    laid = upper.filter(~name.startswith(WHITEOUT)).select("path", "type", "checksum", F.lit(1).alias("layer"))
    merged = overlay(kept.unionByName(laid))
    # A file laid over a directory replaces all of it.
    plain = laid.filter("type <> 'd'").select(F.col("path").alias("up"))
    buried = merged.filter("layer = 0").select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(plain, "up", "left_semi").select("path")
    return merged.join(buried, "path", "left_anti").select("path", "type", "checksum")


def merge_config(original: DataFrame, modified: DataFrame, new: DataFrame) -> DataFrame:
    """(path, type, checksum, status): local changes (original to modified) carried over to ``new``; local always wins."""
    o, m = (x.select("path", F.col("type").alias(f"{n}t"), F.col("checksum").alias(f"{n}c")) for x, n in ((original, "o"), (modified, "m")))
    n = new.select("path", F.col("type").alias("nt"), F.col("checksum").alias("nc"))
    rows = o.join(m, "path", "full_outer").join(n, "path", "full_outer")
    in_o, in_m, in_n = (F.col(c).isNotNull() for c in ("ot", "mt", "nt"))
    changed = in_m & (~in_o | (F.col("ot") != F.col("mt")) | (F.col("oc") != F.col("mc")))
    removed = in_o & ~in_m
    status = F.when(changed & in_n & (F.col("nt") == "d") & (F.col("mt") != "d"), "error").when(changed, "local").when(removed, "removed").when(in_n, "new").otherwise("dropped")
    local = F.col("status").isin("local", "error")
    rows = rows.withColumn("status", status)
    return rows.filter("status IN ('local', 'new', 'error')").select("path", F.when(local, F.col("mt")).otherwise(F.col("nt")).alias("type"), F.when(local, F.col("mc")).otherwise(F.col("nc")).alias("checksum"), "status")


def prune_below(tree: DataFrame, skipped: DataFrame) -> DataFrame:
    """``tree`` without the ``skipped`` paths and everything below them."""
    up = tree.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("up"))
    return tree.join(up.join(skipped.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct(), "path", "left_anti")


def children(tree: DataFrame, directory: str) -> DataFrame:
    return tree.filter((parent_of(F.col("path")) == directory) & (F.col("path") != directory))


def type_char(t: Column) -> Column:
    return F.when(t == "d", "d").when(t == "l", "l").otherwise("-")


def listing(tree: DataFrame) -> DataFrame:
    """What a listing prints: type character, octal mode, owner, size, checksum and path."""
    octal = F.lpad(F.conv(F.col("mode").bitwiseAND(0o7777).cast("string"), 10, 8), 5, "0")
    return tree.select(F.concat(type_char(F.col("type")), octal).alias("mode"), "uid", "gid", "size", "checksum", F.concat(F.lit("/"), "path").alias("path"))


def subdir_match(path: Column, directory: str) -> Column:
    """Whether a path is the directory, above it, or below it, on component boundaries."""
    return (path == directory) | path.startswith(directory + "/") | F.lit(directory).startswith(F.concat(path, F.lit("/")))


def dirtree_hashes(tree: DataFrame) -> DataFrame:
    """(path, checksum) of each directory, the root included, from its sorted entries, deepest first.

    One grouped pass a level; a level's rows are the directories of that depth, kept as a checkpoint for the next.
    """
    from arborlake.operators.history import ensure_checkpoint_dir

    ensure_checkpoint_dir(tree)
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    files = tree.filter("type <> 'd'").select(parent_of(F.col("path")).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit("f").alias("kind"), "checksum")
    # The entries are read once; a level takes its own from what is kept.
    files = files.withColumn("level", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))).checkpoint()
    dirs = tree.filter("type = 'd'").select("path", F.col("checksum").alias("meta"), depth.alias("depth"))
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    below, out = None, None
    for level in range(deepest, -1, -1):
        own = files.filter(F.col("level") == level).drop("level")
        entries = own if below is None else own.unionByName(below)
        hashed = entries.groupBy("dir").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "kind", "checksum"))), lambda e: F.concat_ws(":", e["name"], e["kind"], e["checksum"])), "\n"), 256).alias("checksum"))
        step = hashed.select(F.col("dir").alias("path"), "checksum").checkpoint()
        out = step if out is None else out.unionByName(step)
        below = step.filter("path <> ''").select(parent_of(F.col("path")).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit("d").alias("kind"), "checksum")
    return out
