"""Refs, summaries, and choosing among several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_aliases(refs: DataFrame) -> DataFrame:
    """(ref_name, checksum, via): an alias has the checksum of the ref it points at (one step, as a link)."""
    target = refs.select(F.col("ref_name").alias("alias_of"), F.col("checksum").alias("target"))
    return refs.join(target, "alias_of", "left").select("ref_name", F.coalesce("target", "checksum").alias("checksum"), F.when(F.col("target").isNotNull(), F.col("alias_of")).alias("via"))


def with_prefix(refs: DataFrame, prefix: str, strip: bool = False) -> DataFrame:
    """Refs equal to the prefix or below it on a component boundary."""
    name = F.col("ref_name")
    hit = refs.filter((name == prefix) | name.startswith(prefix + "/"))
    return hit.withColumn("ref_name", F.when(name == prefix, name).otherwise(F.expr(f"substring(ref_name, {len(prefix) + 2})"))) if strip else hit


def missing_targets(refs: DataFrame, commits: DataFrame) -> DataFrame:
    return refs.join(commits.select("checksum"), "checksum", "left_anti")


def binding_faults(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(ref_name, fault): the commit's ref bindings must hold the ref, and the collections must be the same.

    ``commits`` has ref_binding (array, null: none) and collection_binding.
    """
    j = refs.join(commits.select("checksum", "ref_binding", "collection_binding"), "checksum")
    unbound = F.col("ref_binding").isNull()
    fault = (
        F.when(unbound & F.col("collection_id").isNotNull(), "no bindings")
        .when(~unbound & ~F.array_contains("ref_binding", F.col("ref_name")), "ref not bound")
        .when(~unbound & ~F.col("collection_id").eqNullSafe(F.col("collection_binding")), "collection differs")
    )
    return j.select("ref_name", fault.alias("fault")).filter("fault IS NOT NULL")


def summary_rows(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """The entries of a summary, one row a ref: (collection_id, ref_name, size, checksum, ts, version)."""
    return refs.join(commits.select("checksum", "size", "ts", "version"), "checksum").select("collection_id", "ref_name", "size", "checksum", "ts", "version")


def follow(successors: DataFrame) -> DataFrame:
    """(ref, target): where each ref's chain of ``successors`` (ref, next; null: none) ends, by doubling; a chain that never ends leaves its refs where they are."""
    from arborlake.operators.history import ensure_checkpoint_dir

    ensure_checkpoint_dir(successors)
    have = successors.select(F.col("ref").alias("next"))
    now = successors.join(have, "next", "left_semi").select("ref", "next").checkpoint()
    steps = now
    rounds, limit = 0, max(now.count(), 1)
    while (1 << rounds) <= 2 * limit:
        other = now.select(F.col("ref").alias("next"), F.col("next").alias("further"))
        step = now.join(other, "next", "left").select("ref", F.coalesce("further", "next").alias("next"), F.col("further").isNotNull().alias("on")).checkpoint()
        rounds += 1
        open_ends = not step.filter("on").isEmpty()
        now = step.select("ref", "next")
        if not open_ends:
            break
    # What still has a successor at its end lies on or before a cycle.
    ended = now.join(steps.select(F.col("ref").alias("next")), "next", "left_anti")
    return successors.select("ref").join(ended, "ref", "left").select("ref", F.coalesce("next", "ref").alias("target"))


def match_collections(wanted: DataFrame, remotes: DataFrame) -> DataFrame:
    """(collection_id, ref_name, remote): for each wanted collection ref the remote of that collection that has a keyring; the first by name of several, null of none.

    ``remotes`` is (remote, collection_id, keyring: whether there is one).
    """
    usable = remotes.filter("keyring AND collection_id IS NOT NULL").groupBy("collection_id").agg(F.min("remote").alias("remote"))
    return wanted.join(usable, "collection_id", "left").select("collection_id", "ref_name", "remote")


def latest_per_ref(candidates: DataFrame) -> DataFrame:
    """(ref_name, checksum, ts) of the newest commit over all sources; ties go to the least checksum."""
    best = F.min(F.struct((-F.col("ts")).alias("neg"), "checksum"))
    return candidates.filter("checksum IS NOT NULL").groupBy("ref_name").agg(best.alias("b")).select("ref_name", "b.checksum", (-F.col("b.neg")).alias("ts"))


def choose_sources(candidates: DataFrame) -> DataFrame:
    """(remote, priority, last_modified, ref_name, checksum, n_refs): of each remote the refs at their newest commit, null at the others; remotes without any go."""
    newest = latest_per_ref(candidates).select("ref_name", F.col("checksum").alias("newest"))
    j = candidates.join(newest, "ref_name", "left").withColumn("checksum", F.when(F.col("checksum") == F.col("newest"), F.col("checksum"))).drop("newest")
    n = j.groupBy("remote").agg(F.count("checksum").alias("n_refs")).filter("n_refs > 0")
    return j.join(n, "remote").select("remote", "priority", "last_modified", "ref_name", "checksum", "n_refs")


def source_order() -> list[Column]:
    return [F.col("priority"), F.col("last_modified"), F.col("n_refs"), F.col("remote")]


def best_delta(deltas: DataFrame, wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(to, decision, from): unchanged if the target is held whole, else the newest held base, else from scratch, else none.

    ``have`` is (checksum, ts, partial).
    """
    complete = have.filter("NOT partial").select("checksum", "ts")
    held = wanted.join(complete.select(F.col("checksum").alias("to"), F.lit(True).alias("held")), "to", "left")
    based = deltas.join(complete, deltas["from"] == complete["checksum"]).groupBy("to").agg(F.max_by("from", F.struct("ts", "from")).alias("base"))
    scratch = deltas.filter(F.col("from").isNull()).select("to", F.lit(True).alias("scratch")).distinct()
    j = held.join(based, "to", "left").join(scratch, "to", "left")
    decision = F.when(F.col("held"), "unchanged").when(F.col("base").isNotNull(), "match").when(F.col("scratch"), "scratch").otherwise("no match")
    return j.select("to", decision.alias("decision"), F.when(decision == "match", F.col("base")).alias("from"))


def downgrades(updates: DataFrame) -> DataFrame:
    """(ref, checksum, ts, downgrade) along each ref's updates: an earlier time than the commit before, unless it is the same commit."""
    w = Window.partitionBy("ref").orderBy("seq")
    down = (F.col("ts") < F.lag("ts").over(w)) & (F.col("checksum") != F.lag("checksum").over(w))
    return updates.withColumn("downgrade", F.coalesce(down, F.lit(False)))


def resolve_prefixes(prefixes: DataFrame, commits: DataFrame, width: int) -> DataFrame:
    """(prefix, n, checksum): the one commit a hex prefix of ``width`` names; null where none or several do."""
    by = commits.select(F.substring("checksum", 1, width).alias("prefix"), "checksum").distinct()
    found = by.join(prefixes, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("n"), F.min("checksum").alias("checksum"))
    return prefixes.join(found, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("checksum")).alias("checksum"))


def prefer(missing: DataFrame, sources: list[tuple[str, DataFrame]], last: str = "http") -> DataFrame:
    """(checksum, source): the first of the sources that holds each missing object."""
    out, order = missing, []
    for i, (name, held) in enumerate(sources):
        out = out.join(held.select("checksum", F.lit(name).alias(f"__s{i}")).distinct(), "checksum", "left")
        order.append(F.col(f"__s{i}"))
    return out.select("checksum", F.coalesce(*order, F.lit(last)).alias("source"))
