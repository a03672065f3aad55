"""Queries over the commit and object graphs, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.operators import history as H
from arborlake.plans.registry import query
from arborlake.sources import project as P

_LIVE = ("order_refs", "edges", "reachable", "objects")


def _reachable(spark: SparkSession, sf: str) -> DataFrame:
    return H.closure(P.order_refs(spark, sf).select("checksum"), P.edges(spark, sf))


@query("G1_tree_walk", """
WITH RECURSIVE w AS (SELECT 'r' || r_regionkey AS root, '' AS path, 'r' || r_regionkey AS tree FROM region
 UNION ALL SELECT root, w.path || '/' || e.child, e.child FROM w JOIN (SELECT child AS p, parent AS child FROM edges WHERE parent[1] IN ('s', 'n')) e ON e.p = w.tree)
SELECT * FROM w""", "edges")
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Regions hold nations, which hold suppliers: each directory under each root by its path."""
    down = P.edges(spark, sf).filter("parent RLIKE '^[sn]'").select(F.col("child").alias("parent"), F.col("parent").alias("name"), F.col("parent").alias("child"))
    roots = P.load(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return H.expand(roots.withColumn("tree", F.col("root")), down)


@query("G2_closure", "SELECT checksum FROM reachable", "reachable")
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return _reachable(spark, sf)


@query("G3_reachable_from_refs", "SELECT objtype, count(*) AS n, CAST(sum(storage_size) AS BIGINT) AS bytes FROM objects JOIN reachable USING (checksum) GROUP BY 1", *_LIVE)
def reachable_from_refs(spark: SparkSession, sf: str) -> DataFrame:
    live = P.objects(spark, sf).join(_reachable(spark, sf), "checksum", "left_semi")
    return live.groupBy("objtype").agg(F.count("*").alias("n"), F.sum("storage_size").alias("bytes"))


_TOTALS = "SELECT count(*) AS n_total, count(*) FILTER (live AND meta) AS n_reachable_meta, count(*) FILTER (live AND NOT meta) AS n_reachable_content, count(*) FILTER (NOT live AND meta) AS n_unreachable_meta, count(*) FILTER (NOT live AND NOT meta) AS n_unreachable_content, CAST(coalesce(sum(storage_size) FILTER (NOT live), 0) AS BIGINT) AS bytes_freed FROM (SELECT *, checksum IN (SELECT checksum FROM {}) AS live, objtype BETWEEN 2 AND 6 AS meta FROM objects)"


@query("A1_prune_totals", _TOTALS.format("reachable"), *_LIVE)
def prune_totals(spark: SparkSession, sf: str) -> DataFrame:
    return H.prune_totals(P.objects(spark, sf), _reachable(spark, sf))


@query("J6_prune_sweep", "SELECT checksum, objtype FROM objects WHERE checksum NOT IN (SELECT checksum FROM reachable)", *_LIVE)
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return H.sweep(P.objects(spark, sf), _reachable(spark, sf)).select("checksum", "objtype")


@query("G4_prune_commit_only", "SELECT checksum, storage_size FROM objects WHERE objtype = 4 AND checksum NOT IN (SELECT checksum FROM order_refs)", "objects", "order_refs")
def prune_commit_only(spark: SparkSession, sf: str) -> DataFrame:
    """Only commits are swept; trees are not walked."""
    return H.sweep(P.objects(spark, sf).filter("objtype = 4"), P.order_refs(spark, sf)).select("checksum", "storage_size")


@query("J7_payload_link_retention", """
SELECT count(*) FILTER (NOT live) AS n_links_unreachable, count(*) FILTER (NOT live AND target_live AND storage_size >= 25) AS n_kept,
        CAST(sum(storage_size) FILTER (NOT live) AS BIGINT) AS bytes_freed
    FROM (SELECT o.checksum, t.storage_size, o.checksum IN (SELECT checksum
    FROM reachable) AS live, 'f' || (CAST(substr(o.checksum, 2) AS BIGINT) + 1) IN (SELECT checksum FROM reachable) AS target_live FROM objects o
    JOIN objects t ON t.checksum = 'f' || (CAST(substr(o.checksum, 2) AS BIGINT) + 1) WHERE o.objtype = 1)
""", *_LIVE)
def payload_link_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Each part links to the next one's payload: an unreached link stays if its target is reached and large.

    The bytes count every unreached link, kept or not.
    """
    objects, live = P.objects(spark, sf), _reachable(spark, sf).withColumn("live", F.lit(True))
    links = objects.filter("objtype = 1").select("checksum", F.concat(F.lit("f"), F.substring("checksum", 2, 20).cast("bigint") + 1).alias("target"))
    sized = links.join(objects.select(F.col("checksum").alias("target"), "storage_size"), "target")
    marked = sized.join(live, "checksum", "left").join(live.select(F.col("checksum").alias("target"), F.col("live").alias("target_live")), "target", "left")
    gone = F.col("live").isNull()
    kept = gone & F.col("target_live").isNotNull() & (F.col("storage_size") >= 25)
    return marked.agg(F.count_if(gone).alias("n_links_unreachable"), F.count_if(kept).alias("n_kept"), F.sum(F.when(gone, F.col("storage_size"))).alias("bytes_freed"))


@query("G5_parents_map", "SELECT child, count(DISTINCT parent) AS n_parents, min(parent) AS first_parent FROM edges GROUP BY child", "edges")
def parents_map(spark: SparkSession, sf: str) -> DataFrame:
    return P.edges(spark, sf).groupBy("child").agg(F.countDistinct("parent").alias("n_parents"), F.min("parent").alias("first_parent"))


@query("J12_object_owners", """
WITH RECURSIVE o AS (SELECT checksum AS commit, checksum FROM order_refs UNION SELECT o.commit, child FROM o
    JOIN edges ON parent = o.checksum) SELECT checksum, count(*) AS n_commits, min(commit) AS first_commit FROM o GROUP BY checksum
""", "order_refs", "edges")
def object_owners(spark: SparkSession, sf: str) -> DataFrame:
    pairs = H.owners(P.order_refs(spark, sf), P.edges(spark, sf))
    return pairs.groupBy("checksum").agg(F.count("*").alias("n_commits"), F.min("commit").alias("first_commit"))


@query("G6_fsck_partial", """
WITH RECURSIVE o AS (SELECT checksum AS commit, checksum FROM order_refs UNION SELECT o.commit, child FROM o
    JOIN edges ON parent = o.checksum) SELECT DISTINCT commit FROM o WHERE checksum IN (SELECT 'f' || p_partkey FROM part
    WHERE p_partkey % 50 = 0 OR p_partkey % 53 = 0)
""", "order_refs", "edges")
def fsck_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Commits to mark partial, as their closure holds a corrupt file (every fiftieth part here) or a missing one (every 53rd)."""
    from arborlake.operators.verify import rehash

    key = F.col("p_partkey")
    content = F.when(key % 53 == 0, F.lit(None)).when(key % 50 == 0, F.concat("p_name", F.lit("~"))).otherwise(F.col("p_name"))
    stored = P.load(spark, sf, "part").select(F.concat(F.lit("f"), key).alias("name"), F.sha2("p_name", 256).alias("checksum"), content.alias("content"))
    bad = rehash(stored).filter("NOT ok").select(F.col("name").alias("checksum"))
    return H.holders(bad, P.edges(spark, sf), P.order_refs(spark, sf)).select(F.col("checksum").alias("commit"))


@query("G8_incremental_pull", """
WITH RECURSIVE remote AS (SELECT checksum FROM order_refs UNION SELECT child FROM remote JOIN edges ON parent = checksum),
mine AS (SELECT checksum FROM order_refs WHERE CAST(substr(checksum, 2) AS BIGINT) % 2 = 0 UNION SELECT child FROM mine JOIN edges ON parent = checksum)
SELECT checksum FROM remote WHERE checksum NOT IN (SELECT checksum FROM mine)""", "order_refs", "edges")
def incremental_pull(spark: SparkSession, sf: str) -> DataFrame:
    """What a store that holds the even orders lacks of the remote's closure; the walk stops at what it holds."""
    edges, roots = H.materialised(P.edges(spark, sf)), P.order_refs(spark, sf).select("checksum")
    mine = H.closure(roots.filter("CAST(substr(checksum, 2) AS BIGINT) % 2 = 0"), edges)
    new_roots = roots.join(mine, "checksum", "left_anti")
    missing_edges = edges.join(mine.withColumnRenamed("checksum", "child"), "child", "left_anti")
    return H.closure(new_roots, missing_edges)


@query("SC11_pull_missing", "SELECT objtype, count(*) AS n FROM objects WHERE checksum NOT IN (SELECT checksum FROM reachable) GROUP BY 1", *_LIVE)
def pull_missing(spark: SparkSession, sf: str) -> DataFrame:
    return H.sweep(P.objects(spark, sf), _reachable(spark, sf)).groupBy("objtype").agg(F.count("*").alias("n"))


@query("G11_deployment_roots", """
SELECT DISTINCT checksum FROM (SELECT checksum FROM order_refs UNION ALL SELECT 'c' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0)
""", "order_refs")
def deployment_roots(spark: SparkSession, sf: str) -> DataFrame:
    deployed = P.load(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(F.concat(F.lit("c"), "o_orderkey").alias("checksum"))
    return P.order_refs(spark, sf).select("checksum").union(deployed).distinct()


_LOG = "SELECT c.ref AS tip_ref, a.checksum, c.turn - a.turn AS distance FROM commits c JOIN commits a ON a.conv_id = c.conv_id AND a.turn <= c.turn WHERE c.turn = (SELECT max(turn) FROM commits x WHERE x.conv_id = c.conv_id)"


def _log(spark: SparkSession, sf: str, depth: Column | None = None, young: Column | None = None) -> DataFrame:
    """The history of each ref (tip_ref, checksum, distance), up to ``depth`` of a ref and while ``young`` holds of a commit."""
    tips = P.refs(spark, sf).select(F.col("checksum").alias("tip"), F.col("ref_name").alias("tip_ref"))
    asked = tips.select(F.col("tip").alias("checksum"), (F.lit(-1) if depth is None else depth).alias("depth"))
    return H.along(P.commits(spark, sf), asked, young).join(tips, "tip").select("tip_ref", "checksum", "distance")


@query("W1_history_log", f"SELECT tip_ref, checksum, CAST(distance AS INTEGER) AS distance FROM ({_LOG})", "commits")
def history_log(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)


@query("W2_depth_limited", f"SELECT tip_ref, checksum, CAST(distance AS INTEGER) AS distance FROM ({_LOG}) WHERE distance <= 2", "commits")
def depth_limited(spark: SparkSession, sf: str) -> DataFrame:
    """A union of walks limited by themselves: no walk is cut because another came by first."""
    return _log(spark, sf, depth=F.lit(2))


@query("W3_keep_younger", f"""
SELECT tip_ref, checksum
    FROM (SELECT *, min(CASE WHEN distance = 0 OR ts >= 1700000000 + conv_id * 100 + 15 THEN 1 ELSE 0 END) OVER (PARTITION BY tip_ref ORDER BY distance) AS young
    FROM (SELECT l.*, c.ts, c.conv_id FROM ({_LOG}) l JOIN commits c USING (checksum))) WHERE young = 1
""", "commits")
def keep_younger(spark: SparkSession, sf: str) -> DataFrame:
    cutoff = F.lit(1700000000) + F.col("conv_id") * 100 + 15
    return _log(spark, sf, young=F.col("ts") >= cutoff).select("tip_ref", "checksum")


@query("W4_per_branch_depth", f"""
SELECT tip_ref, checksum FROM ({_LOG})
    WHERE CASE WHEN tip_ref LIKE 'chat/1/%' THEN 0 WHEN tip_ref LIKE 'chat/2/%' THEN -1 ELSE 1 END = -1 OR distance <= CASE WHEN tip_ref LIKE 'chat/1/%' THEN 0 WHEN tip_ref LIKE 'chat/2/%' THEN -1 ELSE 1 END
""", "commits")
def per_branch_depth(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.when(F.col("tip_ref").like("chat/1/%"), 0).when(F.col("tip_ref").like("chat/2/%"), -1).otherwise(1)
    return _log(spark, sf, depth=depth).select("tip_ref", "checksum")


@query("J10_missing_parent", """
SELECT checksum, parent FROM commits WHERE turn % 4 <> 1 AND parent IS NOT NULL AND parent NOT IN (SELECT checksum FROM commits WHERE turn % 4 <> 1)
""", "commits")
def missing_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Commits whose parent is gone (every fourth is removed here): the child is what gets listed."""
    left = P.commits(spark, sf).filter("turn % 4 <> 1")
    return left.filter("parent IS NOT NULL").join(left.select(F.col("checksum").alias("parent")), "parent", "left_anti").select("checksum", "parent")


@query("G7_rev_parent", "SELECT a.checksum, b.parent AS grandparent FROM commits a JOIN commits b ON b.checksum = a.parent WHERE b.parent IS NOT NULL", "commits")
def rev_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps up: one self join a caret."""
    c = P.commits(spark, sf)
    up = c.select(F.col("checksum").alias("parent"), F.col("parent").alias("grandparent"))
    return c.select("checksum", "parent").join(up, "parent").filter("grandparent IS NOT NULL").select("checksum", "grandparent")


@query("SC2_commit_prefix_scan", "SELECT checksum, ref FROM commits WHERE starts_with(checksum, 'a')", "commits")
def commit_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return P.commits(spark, sf).filter(F.col("checksum").startswith("a")).select("checksum", "ref")


@query("SC1_object_scan", "SELECT objtype, count(*) AS n, CAST(sum(storage_size) AS BIGINT) AS bytes FROM objects GROUP BY 1", "objects")
def object_scan(spark: SparkSession, sf: str) -> DataFrame:
    return P.objects(spark, sf).groupBy("objtype").agg(F.count("*").alias("n"), F.sum("storage_size").alias("bytes"))


@query("SC3_existence", """
SELECT w.checksum, o.checksum IS NOT NULL AS present FROM (SELECT DISTINCT 'f' || (l_partkey * 2) AS checksum FROM lineitem) w LEFT
    JOIN objects o USING (checksum)
""", "objects")
def existence(spark: SparkSession, sf: str) -> DataFrame:
    wanted = P.load(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") * 2).alias("checksum")).distinct()
    return wanted.join(P.objects(spark, sf).select("checksum", F.lit(True).alias("there")), "checksum", "left").select("checksum", F.coalesce("there", F.lit(False)).alias("present"))


@query("SC5_commit_state", "SELECT checksum, CASE WHEN partial THEN 'partial' ELSE 'normal' END AS state FROM commits", "commits")
def commit_state(spark: SparkSession, sf: str) -> DataFrame:
    commits = P.commits(spark, sf)
    states = commits.filter("partial").select("checksum", F.lit("partial").alias("state"))
    return commits.select("checksum").join(states, "checksum", "left").select("checksum", F.coalesce("state", F.lit("normal")).alias("state"))


@query("SC7_storage_size", "SELECT e.child AS checksum, min(o.storage_size) AS storage_size FROM edges e JOIN objects o ON o.checksum = e.child GROUP BY 1", "edges", "objects")
def storage_size(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of all objects that edges name."""
    asked = P.edges(spark, sf).select(F.col("child").alias("checksum")).distinct()
    return P.objects(spark, sf).join(asked, "checksum", "left_semi").select("checksum", "storage_size")


@query("J11_sizes_needed", """
SELECT count(*) AS n, CAST(sum(archived) AS BIGINT) AS archived, CAST(sum(unpacked) AS BIGINT) AS unpacked, count(*) FILTER (need) AS n_needed,
        CAST(sum(archived) FILTER (need) AS BIGINT) AS archived_needed, CAST(sum(unpacked) FILTER (need) AS BIGINT) AS unpacked_needed
    FROM (SELECT *, checksum NOT IN (SELECT checksum FROM reachable) AS need FROM sizes)
""", "sizes", "reachable")
def sizes_needed(spark: SparkSession, sf: str) -> DataFrame:
    held = _reachable(spark, sf).withColumn("held", F.lit(True))
    rows = P.sizes(spark, sf).join(held, "checksum", "left")
    need = F.col("held").isNull()
    return rows.agg(F.count("*").alias("n"), F.sum("archived").alias("archived"), F.sum("unpacked").alias("unpacked"), F.count_if(need).alias("n_needed"), F.sum(F.when(need, F.col("archived"))).alias("archived_needed"), F.sum(F.when(need, F.col("unpacked"))).alias("unpacked_needed"))


@query("SK1_content_insert", """
SELECT sha256(text) AS checksum, min(doc_id) AS first_doc, max(n_chars) AS size FROM documents
    WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1
""")
def content_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Hash, then insert what the store (here a third of the documents) lacks, each content once."""
    docs = P.load(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("checksum"))
    store, new = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    return new.join(store.select("checksum"), "checksum", "left_anti").groupBy("checksum").agg(F.min("doc_id").alias("first_doc"), F.max("n_chars").alias("size"))


@query("A3_transaction_stats", """
SELECT count(*) AS n_total, count(DISTINCT sha256(text)) AS n_written, CAST((SELECT sum(s) FROM (SELECT max(n_chars) AS s FROM documents
    GROUP BY sha256(text))) AS BIGINT) AS bytes_written FROM documents
""")
def transaction_stats(spark: SparkSession, sf: str) -> DataFrame:
    written = P.load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("n"), F.max("n_chars").alias("size"))
    return written.agg(F.sum("n").alias("n_total"), F.count("*").alias("n_written"), F.sum("size").alias("bytes_written"))


@query("SK2_metadata_insert", "SELECT DISTINCT sha256(unhex(printf('%08x', c_nationkey % 4) || '00000000000041ed')) AS checksum, true AS fits FROM customer")
def metadata_insert(spark: SparkSession, sf: str) -> DataFrame:
    meta = P.load(spark, sf, "customer").select(P.dirmeta(F.col("c_nationkey") % 4, F.lit(0), F.lit(P.DIR_MODE)).alias("content")).distinct()
    return meta.select(F.sha2("content", 256).alias("checksum"), (F.octet_length("content") <= 128 << 20).alias("fits"))


@query("SK16_payload_dedup", """
SELECT min(doc_id) AS canonical, count(*) AS n, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS saved FROM documents WHERE n_chars >= 100
    GROUP BY sha256(text) HAVING count(*) > 1
""")
def payload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Files of equal payload share storage from a threshold of size on."""
    docs = P.load(spark, sf, "documents").filter("n_chars >= 100")
    return docs.groupBy(F.sha2("text", 256).alias("payload")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n"), (F.sum("n_chars") - F.max("n_chars")).alias("saved")).filter("n > 1").drop("payload")


@query("SK12_delete_tombstones", """
SELECT checksum, 'tombstone' AS kind FROM commits WHERE turn > 0 AND turn % 2 = 0 UNION ALL SELECT checksum, 'commit' FROM commits
    WHERE NOT (turn > 0 AND turn % 2 = 0)
""", "commits")
def delete_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted commits (here the even turns) leave a tombstone."""
    from arborlake.operators.transaction import delete_objects

    commits = P.commits(spark, sf).select("checksum", "turn")
    left, stones = delete_objects(commits, commits.filter("turn > 0 AND turn % 2 = 0").select("checksum"))
    return stones.select("checksum", F.lit("tombstone").alias("kind")).union(left.select("checksum", F.lit("commit")))


@query("SK6_transaction_refs", """
SELECT ref, arg_max(value, seq) AS checksum FROM (SELECT ref, turn AS seq, CASE WHEN turn = 5 THEN NULL ELSE checksum END AS value FROM commits)
    GROUP BY ref HAVING arg_max(seq, seq) <> 5
""", "commits")
def transaction_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Ref writes in order; the last one counts, and a null value deletes (here turn 5 does)."""
    from arborlake.operators.transaction import apply_ref_writes

    writes = P.commits(spark, sf).select(F.col("ref").alias("ref_name"), F.col("turn").alias("seq"), F.when(F.col("turn") != 5, F.col("checksum")).alias("checksum"))
    return apply_ref_writes(None, writes).select(F.col("ref_name").alias("ref"), "checksum")


@query("A8_content_dedup", "SELECT count(*) AS n_names, count(DISTINCT checksum) AS n_objects FROM tree_a", "tree_a")
def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.tree_a(spark, sf).groupBy("checksum").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_names"), F.count("*").alias("n_objects"))


@query("A9_basenames", """
SELECT checksum, max(size) AS size, string_agg(DISTINCT name, ',' ORDER BY name) AS names
    FROM (SELECT checksum, size, regexp_extract(path, '[^/]*$') AS name FROM tree_a WHERE type = 'f') GROUP BY checksum
""", "tree_a")
def basenames(spark: SparkSession, sf: str) -> DataFrame:
    files = P.tree_a(spark, sf).filter("type = 'f'").withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return files.groupBy("checksum").agg(F.max("size").alias("size"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("W9_running_retention", """
SELECT osname, idx, pinned OR booted OR after_booted AS kept
    FROM (SELECT *, coalesce(max(CAST(booted AS INTEGER)) OVER (PARTITION BY osname ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_booted
    FROM deployments)
""", "deployments")
def running_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Which deployments stay: pinned, booted, or (rollbacks) after the booted one."""
    w = Window.partitionBy("osname").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.max(F.col("booted").cast("int")).over(w), F.lit(0)) == 1
    return P.deployments(spark, sf).withColumn("after_booted", after).select("osname", "idx", (F.col("pinned") | F.col("booted") | F.col("after_booted")).alias("kept"))


@query("W8_pending_rollback", """
SELECT d.osname, max(d.idx) FILTER (d.idx < b.idx) AS pending, min(d.idx) FILTER (d.idx > b.idx) AS rollback FROM deployments d
    JOIN (SELECT osname, idx FROM deployments WHERE booted) b USING (osname) GROUP BY d.osname
""", "deployments")
def pending_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """The deployment next before the booted one is pending, the next after it the rollback."""
    d = P.deployments(spark, sf)
    booted = d.filter("booted").select("osname", F.col("idx").alias("at"))
    return d.join(booted, "osname").groupBy("osname").agg(F.max(F.when(F.col("idx") < F.col("at"), F.col("idx"))).alias("pending"), F.min(F.when(F.col("idx") > F.col("at"), F.col("idx"))).alias("rollback"))


@query("W10_serials", """
SELECT osname, idx, CAST(row_number() OVER (PARTITION BY osname, csum ORDER BY idx) - 1 AS INTEGER) AS deployserial, CAST(row_number() OVER (PARTITION BY osname,
        bootcsum ORDER BY idx) - 1 AS INTEGER) AS bootserial
    FROM deployments
""", "deployments")
def serials(spark: SparkSession, sf: str) -> DataFrame:
    by = lambda c: (F.row_number().over(Window.partitionBy("osname", c).orderBy("idx")) - 1).cast("int")
    return P.deployments(spark, sf).select("osname", "idx", by("csum").alias("deployserial"), by("bootcsum").alias("bootserial"))
