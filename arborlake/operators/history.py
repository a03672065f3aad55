"""Walks along parent pointers and over edges: history, closure, pruning."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a frontier that are broadcast to the edges, by count; a larger one is joined by exchange.
BROADCAST_ROWS = 200_000


def materialised(edges: DataFrame) -> DataFrame:
    """``edges`` (parent, child) computed once, for walks that read them every round."""
    if getattr(edges, "_held", False):
        return edges
    ensure_checkpoint_dir(edges)
    held = edges.select("parent", "child").checkpoint()
    held._held = True
    return held


def closure(seeds: DataFrame, edges: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """(checksum) of everything reachable from ``seeds`` (checksum) over ``edges`` (parent, child).

    A frontier loop with a visited set: shared subtrees are expanded once, cycles
    end. The edges are computed once; a round reads them and joins the frontier,
    which is broadcast where its count is small. Lineage is cut by checkpoints in the shared folder.
    """
    edges = materialised(edges)
    visited = seeds.select("checksum").distinct().checkpoint()
    frontier, rounds = visited, 0
    while n := frontier.count():
        near = F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier
        step = edges.join(near, edges["parent"] == frontier["checksum"]).select(F.col("child").alias("checksum")).distinct()
        frontier = step.join(visited, "checksum", "left_anti").checkpoint()
        visited = visited.union(frontier)
        rounds += 1
        if rounds % checkpoint_every == 0:
            visited = visited.checkpoint()
    return visited


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where a session on one machine names none (unit tests) it gets a temporary
    folder of that machine; on a cluster executors share none, so one must be named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"spark.checkpoint.dir names no folder, and executors of {context.master} share no local one")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="arborlake-"))
    return context.getCheckpointDir().rstrip("/")


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Sets the context's checkpoint folder where it has none yet."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))


def expand(roots: DataFrame, dir_edges: DataFrame) -> DataFrame:
    """(root, path, tree): each directory under each root (root, tree), by name path; subtrees that are shared appear under each path.

    A level is kept as a checkpoint, so a deep tree is walked once, not once a level.
    """
    ensure_checkpoint_dir(roots)
    level = roots.select("root", F.lit("").alias("path"), "tree")
    out = level
    while True:
        level = level.join(dir_edges, level["tree"] == dir_edges["parent"]).select("root", F.concat("path", F.lit("/"), "name").alias("path"), F.col("child").alias("tree")).checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def along(commits: DataFrame, tips: DataFrame, young: Column | None = None) -> DataFrame:
    """(tip, checksum, distance): the ancestors of each tip, itself at 0; a missing parent ends the walk.

    ``tips`` (checksum) may have a ``depth``, beyond which its walk doesn't go (-1 or
    null: none). With ``young``, a condition over ``commits``, a walk ends before the
    first parent for which it doesn't hold.

    Pointer doubling: after k rounds all ancestors within 2^k are known, so a
    history of a million commits takes twenty rounds rather than a million, and a
    walk of limited depth only as many as that depth has bits.
    """
    ensure_checkpoint_dir(commits)
    parents = commits.select(F.col("checksum").alias("c"), F.col("parent").alias("p"))
    have = commits.select(F.col("checksum").alias("p"), *([young.alias("__young")] if young is not None else [])).distinct()
    jump = parents.join(have if young is None else have.filter("__young"), "p", "left_semi").select("c", "p").checkpoint()
    depth = F.coalesce(F.col("depth"), F.lit(-1)) if "depth" in tips.columns else F.lit(-1)
    start = tips.select(F.col("checksum").alias("tip"), "checksum", depth.alias("depth")).distinct()
    reached = start.join(have.select(F.col("p").alias("checksum")), "checksum", "left_semi").select("tip", "checksum", F.lit(0).alias("distance"), "depth").checkpoint()
    span, fits = 1, (F.col("depth") < 0) | (F.col("distance") <= F.col("depth"))
    while True:
        further = reached.join(jump, reached["checksum"] == jump["c"]).select("tip", F.col("p").alias("checksum"), (F.col("distance") + span).alias("distance"), "depth").filter(fits).checkpoint()
        if further.isEmpty():
            return reached.drop("depth")
        reached = reached.unionByName(further)
        other = jump.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jump = jump.join(other, "p").select("c", F.col("pp").alias("p")).checkpoint()
        span *= 2


def holders(objects: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(checksum) of the ``commits`` whose closure holds any of ``objects`` (checksum): a walk up from the objects, no pairs."""
    upward = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return commits.select("checksum").distinct().join(closure(objects, upward), "checksum", "left_semi")


def prune_totals(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Totals of a prune: metadata and content objects, reached and not, and the bytes that go."""
    marked = objects.join(reachable.select("checksum", F.lit(1).alias("live")).distinct(), "checksum", "left")
    meta, live = F.col("objtype").between(2, 6), F.col("live").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return marked.agg(
        F.count("*").alias("n_total"), count(live & meta).alias("n_reachable_meta"), count(live & ~meta).alias("n_reachable_content"), count(~live & meta).alias("n_unreachable_meta"),
        count(~live & ~meta).alias("n_unreachable_content"), F.coalesce(F.sum(F.when(~live, F.col("storage_size"))), F.lit(0)).cast("bigint").alias("bytes_freed"),
    )


def sweep(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """The objects that a prune deletes."""
    return objects.join(reachable.select("checksum"), "checksum", "left_anti")


def owners(commits: DataFrame, edges: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """(commit, checksum): which commits hold each object, as pairs; the closure of each commit by itself.

    As many rows as the closures have together; to ask for some objects only, see ``holders``.
    """
    edges = materialised(edges)
    visited = commits.select(F.col("checksum").alias("commit"), "checksum").distinct().checkpoint()
    frontier = visited
    while True:
        step = frontier.join(edges, frontier["checksum"] == edges["parent"]).select("commit", F.col("child").alias("checksum")).distinct()
        frontier = step.join(visited, ["commit", "checksum"], "left_anti").checkpoint()
        if frontier.isEmpty():
            return visited
        visited = visited.union(frontier)
