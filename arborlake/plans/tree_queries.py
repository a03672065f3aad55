"""Queries over tree snapshots, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import trees
from arborlake.plans.registry import query
from arborlake.sources import project as P

_UP = "EXISTS (SELECT 1 FROM {t} x WHERE starts_with({p}, x.path || '/') AND {c})"
_DIFF = """
WITH j AS (SELECT coalesce(a.path, b.path) AS path, a.type AS ta, b.type AS tb, a.checksum AS ca, b.checksum AS cb FROM tree_a a FULL OUTER JOIN tree_b b ON a.path = b.path),
gone AS (SELECT path FROM j WHERE tb IS NULL), turned AS (SELECT path FROM j WHERE ta <> tb),
diff AS (
    SELECT path, 'M' AS kind FROM j WHERE ta <> tb OR ca <> cb
    UNION ALL SELECT path, 'D' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE starts_with(g.path, h.path || '/')) AND NOT EXISTS (SELECT 1 FROM turned h WHERE starts_with(g.path, h.path || '/'))
    UNION ALL SELECT path, 'A' FROM j WHERE ta IS NULL AND NOT EXISTS (SELECT 1 FROM turned h WHERE starts_with(j.path, h.path || '/'))
)
"""


@query("J1_tree_diff", _DIFF + "SELECT * FROM diff", "tree_a", "tree_b")
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return trees.in_output_order(trees.diff(P.tree_a(spark, sf), P.tree_b(spark, sf)))


@query("O6_diff_order", _DIFF + "SELECT CASE kind WHEN 'M' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS part, path, kind FROM diff", "tree_a", "tree_b")
def diff_order(spark: SparkSession, sf: str) -> DataFrame:
    """A diff's output in its order, with the part (changed, deleted, added) that a line belongs to."""
    changes = trees.in_output_order(trees.diff(P.tree_a(spark, sf), P.tree_b(spark, sf)))
    return changes.select(F.when(F.col("kind") == "M", 0).when(F.col("kind") == "D", 1).otherwise(2).alias("part"), "path", "kind")


@query("J2_diff_ignoring_xattrs", """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS kind FROM (SELECT *
    FROM tree_a WHERE type = 'f') a FULL OUTER JOIN (SELECT * FROM tree_b WHERE type = 'f') b ON a.path = b.path WHERE a.checksum IS DISTINCT
    FROM b.checksum
""", "tree_a", "tree_b")
def diff_ignoring_xattrs(spark: SparkSession, sf: str) -> DataFrame:
    """Regular files whose hash without extended attributes differs: here the attributes are the owner, left out of the hash."""
    a, b = (t(spark, sf).filter("type = 'f'").select("path", F.col("checksum").alias(n)) for t, n in ((P.tree_a, "ca"), (P.tree_b, "cb")))
    return a.join(b, "path", "full_outer").filter(~F.col("ca").eqNullSafe(F.col("cb"))).select("path", F.when(F.col("ca").isNull(), "A").when(F.col("cb").isNull(), "D").otherwise("M").alias("kind"))


@query("A2_diff_stats", """
WITH a AS (SELECT DISTINCT checksum, max(size) OVER (PARTITION BY checksum) AS size FROM tree_a), b AS (SELECT DISTINCT checksum
    FROM tree_b) SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS n_from, CAST((SELECT count(*)
    FROM b) AS BIGINT) AS n_to, count(*) AS n_common, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_common FROM a JOIN b USING (checksum)
""", "tree_a", "tree_b")
def diff_stats(spark: SparkSession, sf: str) -> DataFrame:
    return trees.diff_stats(P.tree_a(spark, sf), P.tree_b(spark, sf))


@query("P1_list_directory", """
SELECT CASE type WHEN 'd' THEN 'd' WHEN 'l' THEN 'l' ELSE '-' END || lpad(printf('%o', mode & 4095), 5, '0') AS mode, uid, gid, size, checksum, '/' || path AS path
    FROM tree_a WHERE regexp_matches(path, '^en/[^/]*$')
""", "tree_a")
def list_directory(spark: SparkSession, sf: str) -> DataFrame:
    return trees.listing(trees.children(P.tree_a(spark, sf), "en"))


@query("P2_cat", "SELECT doc_id, text, CAST(list_position([9, 3, 12], doc_id) AS INTEGER) AS pos FROM documents WHERE doc_id IN (9, 3, 12)")
def cat(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads of given paths in the order of the arguments."""
    wanted = [9, 3, 12]
    docs = P.load(spark, sf, "documents").filter(F.col("doc_id").isin(wanted))
    pos = F.array_position(F.array(*[F.lit(w).cast("bigint") for w in wanted]), F.col("doc_id"))
    return docs.select("doc_id", "text", pos.cast("int").alias("pos")).orderBy("pos")


@query("P4_path_lookup", "SELECT path, type, checksum FROM tree_a WHERE path IN ('en/src1', 'de', 'fr/src2/no')", "tree_a")
def path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("en/src1",), ("de",), ("fr/src2/no",)], "path string")
    return P.tree_a(spark, sf).join(F.broadcast(wanted), "path", "left_semi").select("path", "type", "checksum")


@query("P5_subdir_predicate", "SELECT path, type FROM tree_a WHERE path = 'en/src1' OR starts_with(path, 'en/src1/') OR starts_with('en/src1', path || '/')", "tree_a")
def subdir_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_a(spark, sf).filter(trees.subdir_match(F.col("path"), "en/src1")).select("path", "type")


@query(
    "P6_commit_filter",
    "SELECT path, CASE WHEN path LIKE '%/1_' THEN (mode & 61440) | 384 WHEN path LIKE '%7' THEN mode | 2048 ELSE mode END & CASE WHEN type = 'f' AND (mode & 73) <> 0 THEN 61440 | 3949 ELSE 65535 END AS mode, 1000 AS uid, 1000 AS gid FROM tree_a t WHERE type <> 'd' AND NOT starts_with(path, 'de/src1/')",
    "tree_a",
)
def commit_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A skip-list, mode overrides and additions, owner override, and read-only executables."""
    tree = P.tree_a(spark, sf)
    skipped = trees.prune_below(tree, spark.createDataFrame([("de/src1",)], "path string")).filter("type <> 'd'")
    overrides = skipped.filter("path LIKE '%/1_'").select("path", F.lit(384).alias("set_mode"))
    adds = skipped.filter("path LIKE '%7'").select("path", F.lit(2048).alias("add_mode"))
    rows = skipped.join(overrides, "path", "left").join(adds, "path", "left")
    mode = F.when(F.col("set_mode").isNotNull(), F.col("mode").bitwiseAND(61440).bitwiseOR(F.col("set_mode"))).otherwise(F.col("mode").bitwiseOR(F.coalesce("add_mode", F.lit(0))))
    read_only = F.when((F.col("type") == "f") & (F.col("mode").bitwiseAND(73) != 0), mode.bitwiseAND(61440 | 3949)).otherwise(mode)
    return rows.select("path", read_only.cast("int").alias("mode"), F.lit(1000).alias("uid"), F.lit(1000).alias("gid"))


@query("P7_canonical_permissions", "SELECT path, CASE type WHEN 'f' THEN mode & 33261 WHEN 'd' THEN mode & 16877 ELSE mode END AS mode, 0 AS uid, 0 AS gid FROM tree_b", "tree_b")
def canonical_permissions(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("type") == "f", F.col("mode").bitwiseAND(33261)).when(F.col("type") == "d", F.col("mode").bitwiseAND(16877)).otherwise(F.col("mode"))
    return P.tree_b(spark, sf).select("path", mode.alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"))


@query("P8_checkout_skip_list", "SELECT path FROM tree_a WHERE NOT (path = 'en/src3' OR starts_with(path, 'en/src3/') OR path = 'fr' OR starts_with(path, 'fr/'))", "tree_a")
def checkout_skip_list(spark: SparkSession, sf: str) -> DataFrame:
    return trees.prune_below(P.tree_a(spark, sf), spark.createDataFrame([("en/src3",), ("fr",)], "path string")).select("path")


@query("P9_user_only_modes", "SELECT path, mode FROM tree_b WHERE type = 'f' AND (mode & 4095 & 3586) <> 0 OR type = 'd' AND mode = 16832", "tree_b")
def user_only_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that a store without ownership can't keep: bits outside 0775, and (here) closed directories."""
    bad = (F.col("type") == "f") & (F.col("mode").bitwiseAND(0o7777).bitwiseAND(~0o775) != 0)
    return P.tree_b(spark, sf).filter(bad | ((F.col("type") == "d") & (F.col("mode") == P.PRIVATE_DIR_MODE))).select("path", "mode")


@query("P11_world_readable", "SELECT type, (mode & 4) <> 0 AS world_readable, count(*) AS n FROM tree_b GROUP BY ALL", "tree_b")
def world_readable(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_b(spark, sf).groupBy("type", (F.col("mode").bitwiseAND(4) != 0).alias("world_readable")).agg(F.count("*").alias("n"))


@query("SK3_dirtree_hashes", """
WITH l3 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, sha256(string_agg(regexp_extract(path, '[^/]*$') || ':f:' || checksum, chr(10) ORDER BY regexp_extract(path, '[^/]*$'))) AS checksum FROM tree_a WHERE type <> 'd' GROUP BY 1),
l2 AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS dir, sha256(string_agg(regexp_extract(dir, '[^/]*$') || ':d:' || checksum, chr(10) ORDER BY regexp_extract(dir, '[^/]*$'))) AS checksum FROM l3 GROUP BY 1),
l1 AS (SELECT '' AS dir, sha256(string_agg(dir || ':d:' || checksum, chr(10) ORDER BY dir)) AS checksum FROM l2)
SELECT dir AS path, checksum FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1""", "tree_a")
def dirtree_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return trees.dirtree_hashes(P.tree_a(spark, sf))


@query("P10_skip_if_unchanged", """
SELECT t.path, a.checksum IS NOT DISTINCT FROM b.checksum AS unchanged FROM (SELECT path FROM tree_a WHERE type = 'd' UNION SELECT path FROM tree_b
    WHERE type = 'd') t LEFT JOIN tree_a a ON a.path = t.path LEFT JOIN tree_b b ON b.path = t.path
""", "tree_a", "tree_b")
def skip_if_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """Directories whose metadata is the same in both snapshots need no new object."""
    a, b = (t(spark, sf).filter("type = 'd'").select("path", F.col("checksum").alias(n)) for t, n in ((P.tree_a, "ca"), (P.tree_b, "cb")))
    return a.join(b, "path", "full_outer").select("path", F.col("ca").eqNullSafe(F.col("cb")).alias("unchanged"))


@query("P13_structural_validation", """
SELECT path, CASE WHEN type = 'd' AND (mode & 61440) <> 16384 THEN 'not a directory mode' WHEN type = 'f' AND (mode & 61440) <> 32768 THEN 'not a file mode' WHEN path LIKE '%inner' THEN 'reserved name' END AS violation
    FROM tree_b WHERE type = 'd' AND (mode & 61440) <> 16384 OR type = 'f' AND (mode & 61440) <> 32768 OR path LIKE '%inner'
""", "tree_b")
def structural_validation(spark: SparkSession, sf: str) -> DataFrame:
    fmt = F.col("mode").bitwiseAND(0o170000)
    fault = F.when((F.col("type") == "d") & (fmt != 0o040000), "not a directory mode").when((F.col("type") == "f") & (fmt != 0o100000), "not a file mode").when(F.col("path").endswith("inner"), "reserved name")
    return P.tree_b(spark, sf).select("path", fault.alias("violation")).filter("violation IS NOT NULL")


@query("U4_tree_overlay", "SELECT path, arg_max(layer, layer) AS layer, arg_max(type, layer) AS type, arg_max(checksum, layer) AS checksum FROM layers GROUP BY path", "layers")
def tree_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return trees.overlay(P.layers(spark, sf))


_OVER = "(SELECT * FROM layers WHERE layer = 2) s FULL OUTER JOIN (SELECT * FROM layers WHERE layer = 1) t ON s.path = t.path"


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = P.layers(spark, sf)
    return both.filter("layer = 2"), both.filter("layer = 1")


@query("U5_checkout_none", f"SELECT s.path FROM {_OVER} WHERE s.path = t.path", "layers")
def checkout_none(spark: SparkSession, sf: str) -> DataFrame:
    return trees.checkout(*_two(spark, sf), "none").filter("action = 'conflict'").select("path")


def _checkout_sql(met: str, wins: str) -> str:
    return f"SELECT coalesce(s.path, t.path) AS path, CASE WHEN t.path IS NULL OR (s.path = t.path AND {wins}) THEN s.type ELSE t.type END AS type, CASE WHEN t.path IS NULL OR (s.path = t.path AND {wins}) THEN s.checksum ELSE t.checksum END AS checksum, CASE WHEN t.path IS NULL THEN 'add' WHEN s.path IS NULL THEN 'keep' ELSE {met} END AS action FROM {_OVER}"


@query("U6_checkout_union_files", _checkout_sql("'replace'", "true"), "layers")
def checkout_union_files(spark: SparkSession, sf: str) -> DataFrame:
    return trees.checkout(*_two(spark, sf), "union_files")


@query("U7_checkout_add_files", _checkout_sql("'keep'", "false"), "layers")
def checkout_add_files(spark: SparkSession, sf: str) -> DataFrame:
    return trees.checkout(*_two(spark, sf), "add_files")


@query("U8_checkout_union_identical", _checkout_sql("CASE WHEN s.type = t.type AND s.checksum = t.checksum THEN 'keep' ELSE 'conflict' END", "false"), "layers")
def checkout_union_identical(spark: SparkSession, sf: str) -> DataFrame:
    return trees.checkout(*_two(spark, sf), "union_identical")


@query("J15_checkout_collisions", f"""
SELECT CASE WHEN s.type = t.type AND s.checksum = t.checksum THEN 'keep' ELSE 'conflict' END AS action, count(*) AS n FROM {_OVER}
    WHERE s.path = t.path GROUP BY 1
""", "layers")
def checkout_collisions(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _two(spark, sf)
    met = trees.checkout(source, target, "union_identical").join(source.select("path"), "path", "left_semi").join(target.select("path"), "path", "left_semi")
    return met.groupBy("action").agg(F.count("*").alias("n"))


@query("U9_whiteouts", """
WITH up AS (SELECT 'en/src1/.wh.' || regexp_extract(path, '[^/]*$') AS path, 'f' AS type, checksum FROM tree_a WHERE regexp_matches(path, '^en/src1/[0-9]*[05]$')
  UNION ALL SELECT 'fr/src2/.wh..wh..opq', 'f', '' UNION ALL SELECT 'fr/src2/fresh', 'f', sha256('fresh') UNION ALL SELECT 'es/src4', 'f', sha256('file') UNION ALL SELECT 'de/.wh.src5', 'f', '')
SELECT path, type, checksum FROM tree_a WHERE NOT regexp_matches(path, '^en/src1/[0-9]*[05]$') AND NOT starts_with(path, 'fr/src2/') AND path <> 'es/src4' AND NOT starts_with(path, 'es/src4/') AND path <> 'de/src5' AND NOT starts_with(path, 'de/src5/')
UNION ALL SELECT * FROM up WHERE path NOT LIKE '%.wh.%'""", "tree_a")
def whiteouts(spark: SparkSession, sf: str) -> DataFrame:
    lower = P.tree_a(spark, sf)
    marks = lower.filter("path RLIKE '^en/src1/[0-9]*[05]$'").select(F.concat(F.lit("en/src1/.wh."), F.regexp_extract("path", "([^/]*)$", 1)).alias("path"), F.lit("f").alias("type"), "checksum")
    given = spark.createDataFrame([("fr/src2/.wh..wh..opq", ""), ("fr/src2/fresh", "fresh"), ("es/src4", "file"), ("de/.wh.src5", "")], "path string, content string")
    upper = marks.unionByName(given.select("path", F.lit("f").alias("type"), F.when(F.col("content") != "", F.sha2("content", 256)).otherwise("").alias("checksum")))
    return trees.apply_whiteouts(lower, upper)


@query("U10_remove_and_walk", "SELECT path, type FROM tree_a WHERE NOT (path = 'en/src2' OR starts_with(path, 'en/src2/')) AND starts_with(path, 'en')", "tree_a")
def remove_and_walk(spark: SparkSession, sf: str) -> DataFrame:
    kept = trees.prune_below(P.tree_a(spark, sf), spark.createDataFrame([("en/src2",)], "path string"))
    return kept.filter(F.col("path").startswith("en")).select("path", "type")


@query("U11_parent_fallthrough", """
SELECT path, arg_min(checksum, p) AS checksum, min(p) AS level FROM (SELECT path, checksum, 0 AS p FROM tree_b WHERE type <> 'd'
    UNION ALL SELECT path, checksum, 1 FROM tree_a WHERE type <> 'd') GROUP BY path
""", "tree_a", "tree_b")
def parent_fallthrough(spark: SparkSession, sf: str) -> DataFrame:
    """A layered read: the child store first, then its parent."""
    both = P.tree_b(spark, sf).filter("type <> 'd'").select("path", "checksum", F.lit(0).alias("level")).unionByName(P.tree_a(spark, sf).filter("type <> 'd'").select("path", "checksum", F.lit(1).alias("level")))
    return both.groupBy("path").agg(F.min_by("checksum", "level").alias("checksum"), F.min("level").alias("level"))


@query("J16_config_merge", """
WITH o AS (SELECT path, type, checksum FROM layers WHERE layer = 1), m AS (SELECT path, type, checksum FROM layers WHERE layer = 2), n AS (SELECT path, type, checksum FROM layers WHERE layer = 3),
j AS (SELECT path, o.type AS ot, o.checksum AS oc, m.type AS mt, m.checksum AS mc, n.type AS nt, n.checksum AS nc FROM o FULL OUTER JOIN m USING (path) FULL OUTER JOIN n USING (path))
SELECT path, CASE WHEN mt IS NOT NULL AND (ot IS NULL OR ot <> mt OR oc <> mc) THEN mt ELSE nt END AS type, CASE WHEN mt IS NOT NULL AND (ot IS NULL OR ot <> mt OR oc <> mc) THEN mc ELSE nc END AS checksum, CASE WHEN mt IS NOT NULL AND (ot IS NULL OR ot <> mt OR oc <> mc) THEN 'local' ELSE 'new' END AS status
FROM j WHERE (mt IS NOT NULL AND (ot IS NULL OR ot <> mt OR oc <> mc)) OR (NOT (ot IS NOT NULL AND mt IS NULL) AND nt IS NOT NULL)""", "layers")
def config_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.layers(spark, sf)
    return trees.merge_config(*(rows.filter(F.col("layer") == k) for k in (1, 2, 3)))


@query("U1_union_reachable", "SELECT checksum FROM tree_a UNION SELECT checksum FROM tree_b", "tree_a", "tree_b")
def union_reachable(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_a(spark, sf).select("checksum").union(P.tree_b(spark, sf).select("checksum")).distinct()


@query("U2_intersection", "SELECT checksum FROM tree_a INTERSECT SELECT checksum FROM tree_b", "tree_a", "tree_b")
def intersection(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_a(spark, sf).select("checksum").intersect(P.tree_b(spark, sf).select("checksum"))


@query("U3_difference", "SELECT checksum FROM tree_b EXCEPT SELECT checksum FROM tree_a", "tree_a", "tree_b")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_b(spark, sf).select("checksum").distinct().join(P.tree_a(spark, sf).select("checksum"), "checksum", "left_anti")


@query("J3_new_objects", """
SELECT CASE WHEN type = 'd' THEN 'metadata' WHEN type = 'l' THEN 'symlink' ELSE 'regular' END AS class, count(DISTINCT checksum) AS n FROM tree_b
    WHERE checksum NOT IN (SELECT checksum FROM tree_a) GROUP BY 1
""", "tree_a", "tree_b")
def new_objects(spark: SparkSession, sf: str) -> DataFrame:
    from arborlake.operators.delta import new_objects as split

    return split(P.tree_a(spark, sf), P.tree_b(spark, sf)).groupBy("class").agg(F.count("*").alias("n"))


@query("O1_entry_order", """
SELECT dir, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name FROM tree_b) GROUP BY dir
""", "tree_b")
def entry_order(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a directory in byte order."""
    rows = P.tree_b(spark, sf).select(P.parent_of(F.col("path")).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return rows.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("SK9_tar_listing", """
SELECT 'root/' || path AS path, CASE WHEN type = 'd' THEN 'dir' WHEN type = 'l' THEN 'symlink' WHEN row_number() OVER (PARTITION BY type,
        checksum ORDER BY path) = 1 THEN 'file' ELSE 'hardlink' END AS entry, CASE WHEN type = 'f' AND row_number() OVER (PARTITION BY type,
        checksum ORDER BY path) > 1 THEN 'root/' || first_value(path) OVER (PARTITION BY type, checksum ORDER BY path) END AS target
    FROM tree_a
""", "tree_a")
def tar_listing(spark: SparkSession, sf: str) -> DataFrame:
    from arborlake.sources.archive import tar_entries

    return tar_entries(P.tree_a(spark, sf), "root/")


@query("SK10_image_listing", """
SELECT path, CASE WHEN type = 'f' AND size > 64 THEN substr(checksum, 1, 2) || '/' || substr(checksum, 3) || '.file' END AS backing, type = 'f' AND size <= 64 AS inline
    FROM tree_a
""", "tree_a")
def image_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata-only image: small files inline, others by their backing path."""
    big = (F.col("type") == "f") & (F.col("size") > 64)
    backing = F.when(big, F.concat(F.substring("checksum", 1, 2), F.lit("/"), F.substring("checksum", 3, 62), F.lit(".file")))
    return P.tree_a(spark, sf).select("path", backing.alias("backing"), ((F.col("type") == "f") & (F.col("size") <= 64)).alias("inline"))


@query("SK8_checkout", "SELECT '/' || path AS path, type, checksum, size FROM tree_a", "tree_a")
def materialise(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_a(spark, sf).select(F.concat(F.lit("/"), "path").alias("path"), "type", "checksum", "size")
