"""Queries over refs, summaries, sources and deltas, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import delta as D
from arborlake.operators import refs as R
from arborlake.plans.registry import query
from arborlake.sources import project as P


@query("J8_ref_targets", "SELECT ref_name FROM refs WHERE checksum NOT IN (SELECT checksum FROM commits WHERE turn % 3 <> 2)", "refs", "commits")
def ref_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Refs whose commit is gone (every third turn is, here)."""
    return R.missing_targets(P.refs(spark, sf), P.commits(spark, sf).filter("turn % 3 <> 2")).select("ref_name")


@query("J9_binding_check", """
SELECT r.ref_name, CASE WHEN c.turn % 4 = 0 THEN 'no bindings' WHEN c.turn % 4 = 1 THEN 'ref not bound' ELSE 'collection differs' END AS fault
    FROM refs r JOIN commits c USING (checksum)
    WHERE (c.turn % 4 = 0 AND r.collection_id IS NOT NULL) OR c.turn % 4 = 1 OR (c.turn % 4 IN (2, 3) AND r.collection_id IS DISTINCT
    FROM CASE WHEN c.turn % 4 = 3 THEN 'org.example.Chat' END)
""", "refs", "commits")
def binding_check(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn") % 4
    bound = F.when(turn == 1, F.array(F.lit("other"))).when(turn > 1, F.array(F.lit("other"), "ref"))
    commits = P.commits(spark, sf).withColumns({"ref_binding": bound, "collection_binding": F.when(turn == 3, "org.example.Chat")})
    return R.binding_faults(P.refs(spark, sf), commits)


@query("W5_latest_per_ref", """
SELECT ref_name, min(checksum) AS checksum, ts FROM candidates c WHERE ts = (SELECT max(ts) FROM candidates x WHERE x.ref_name = c.ref_name)
    GROUP BY ref_name, ts
""", "candidates")
def latest_per_ref(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_per_ref(P.candidates(spark, sf))


_CHOSEN = "WITH newest AS (SELECT ref_name, min(checksum) AS newest FROM candidates c WHERE ts = (SELECT max(ts) FROM candidates x WHERE x.ref_name = c.ref_name) GROUP BY ref_name), chosen AS (SELECT remote, priority, last_modified, c.ref_name, CASE WHEN checksum = newest THEN checksum END AS checksum FROM candidates c LEFT JOIN newest USING (ref_name)) "


@query("J13_choose_sources", _CHOSEN + "SELECT remote, ref_name, checksum FROM chosen WHERE remote IN (SELECT remote FROM chosen WHERE checksum IS NOT NULL)", "candidates")
def choose_sources(spark: SparkSession, sf: str) -> DataFrame:
    return R.choose_sources(P.candidates(spark, sf)).select("remote", "ref_name", "checksum")


@query("O3_source_order", _CHOSEN + "SELECT remote, CAST(row_number() OVER (ORDER BY priority, last_modified, count(checksum), remote) AS INTEGER) AS pos FROM chosen GROUP BY remote, priority, last_modified HAVING count(checksum) > 0", "candidates")
def source_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in order of preference. A row a source, of which there are few: the rank is over all of them."""
    from pyspark.sql import Window

    sources = R.choose_sources(P.candidates(spark, sf)).select("remote", "priority", "last_modified", "n_refs").distinct()
    return sources.select("remote", F.row_number().over(Window.orderBy(*R.source_order())).alias("pos"))


@query("A11_finder_results", """
SELECT remote, CAST(count(*) AS BIGINT) AS n, min(priority) AS priority, count(DISTINCT ref_name) AS n_refs FROM (SELECT * FROM candidates
    WHERE priority < 2 UNION ALL SELECT * FROM candidates WHERE priority > 0) GROUP BY remote
""", "candidates")
def finder_results(spark: SparkSession, sf: str) -> DataFrame:
    """What two finders found, grouped by source."""
    c = P.candidates(spark, sf)
    both = c.filter("priority < 2").unionByName(c.filter("priority > 0"))
    return both.groupBy("remote").agg(F.count("*").alias("n"), F.min("priority").alias("priority"), F.countDistinct("ref_name").alias("n_refs"))


@query("O5_sorted_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def sorted_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return P.load(spark, sf, "events").select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query("O7_unique_prefix", """
WITH p AS (SELECT substr(checksum, 1, 2) AS prefix, count(DISTINCT checksum) AS n, min(checksum) AS c FROM commits
    GROUP BY 1), w AS (SELECT DISTINCT substr(sha256(CAST(conv_id AS VARCHAR)), 1, 2) AS prefix
    FROM conversations) SELECT prefix, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN c END AS checksum FROM w LEFT JOIN p USING (prefix)
""", "commits")
def unique_prefix(spark: SparkSession, sf: str) -> DataFrame:
    asked = P.load(spark, sf, "conversations").select(F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 2).alias("prefix")).distinct()
    return R.resolve_prefixes(asked, P.commits(spark, sf), 2)


@query("W6_best_delta", """
SELECT d.\"to\", CASE WHEN (SELECT turn % 5 = 1 FROM commits c
    WHERE c.checksum = d.\"to\") THEN 'unchanged' WHEN b.turn % 5 = 1 THEN 'match' WHEN d.\"from\" IS NULL THEN 'scratch' ELSE 'no match' END AS decision,
        CASE WHEN (SELECT turn % 5 = 1
    FROM commits c WHERE c.checksum = d.\"to\") THEN NULL WHEN b.turn % 5 = 1 THEN d.\"from\" END AS \"from\" FROM deltas d LEFT
    JOIN commits b ON b.checksum = d.\"from\"
""", "deltas", "commits")
def best_delta(spark: SparkSession, sf: str) -> DataFrame:
    deltas = P.deltas(spark, sf)
    have = P.commits(spark, sf).filter("turn % 5 = 1").select("checksum", "ts", F.lit(False).alias("partial"))
    return R.best_delta(deltas, deltas.select("to").distinct(), have)


@query("W7_downgrade_check", "SELECT checksum, coalesce(ts < lag(ts) OVER (PARTITION BY ref ORDER BY turn), false) AS downgrade FROM commits", "commits")
def downgrade_check(spark: SparkSession, sf: str) -> DataFrame:
    return R.downgrades(P.commits(spark, sf).withColumn("seq", F.col("turn"))).select("checksum", "downgrade")


@query("G10_alias_resolution", """
SELECT r.ref_name, coalesce(t.checksum, r.checksum) AS checksum, CASE WHEN t.checksum IS NOT NULL THEN r.alias_of END AS via FROM refs r LEFT
    JOIN refs t ON t.ref_name = r.alias_of
""", "refs")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_aliases(P.refs(spark, sf))


@query("F20_rev_resolution", """
SELECT w.rev, coalesce(c.checksum, l.checksum, o.checksum, m.checksum) AS checksum FROM (SELECT ref_name AS rev FROM refs UNION ALL SELECT checksum
    FROM commits WHERE turn = 0 UNION ALL SELECT 'no/such') w LEFT JOIN (SELECT checksum FROM commits) c ON c.checksum = w.rev LEFT JOIN (SELECT *
    FROM refs WHERE remote IS NULL) l ON l.ref_name = w.rev LEFT JOIN (SELECT * FROM refs WHERE remote = 'origin') o ON o.ref_name = w.rev LEFT
    JOIN (SELECT * FROM refs WHERE remote = 'mirror') m ON m.ref_name = w.rev
""", "refs", "commits")
def rev_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A full checksum, then a local ref, then one of any remote in order."""
    refs, commits = P.refs(spark, sf), P.commits(spark, sf)
    revs = refs.select(F.col("ref_name").alias("rev")).union(commits.filter("turn = 0").select("checksum")).union(spark.createDataFrame([("no/such",)], "rev string"))
    out = revs.join(commits.select(F.col("checksum").alias("rev"), F.col("checksum").alias("c0")), "rev", "left")
    for i, test in enumerate(("remote IS NULL", "remote = 'origin'", "remote = 'mirror'"), 1):
        out = out.join(refs.filter(test).select(F.col("ref_name").alias("rev"), F.col("checksum").alias(f"c{i}")), "rev", "left")
    return out.select("rev", F.coalesce("c0", "c1", "c2", "c3").alias("checksum"))


@query("F21_ref_listing", "SELECT substr(ref_name, 8) AS ref_name, checksum FROM refs WHERE starts_with(ref_name, 'chat/3/') AND remote IS NULL", "refs")
def ref_listing(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_prefix(P.refs(spark, sf).filter("remote IS NULL"), "chat/3", strip=True).select("ref_name", "checksum")


@query("F22_collection_refs", """
SELECT a.ref_name, count(*) AS n FROM refs a JOIN refs b ON a.collection_id IS NOT DISTINCT FROM b.collection_id AND a.ref_name = b.ref_name
    GROUP BY 1
""", "refs")
def collection_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Collection refs are equal if names are and collections are, null with null."""
    a = P.refs(spark, sf).select("collection_id", "ref_name")
    b = a.select(F.col("collection_id").alias("c"), F.col("ref_name").alias("r"))
    return a.join(b, (a["ref_name"] == b["r"]) & a["collection_id"].eqNullSafe(b["c"])).groupBy("ref_name").agg(F.count("*").alias("n"))


@query("F19_metadata", "SELECT ref, '{\"ref\":\"' || ref || '\",\"version\":\"' || version || '\"}' AS metadata FROM commits", "commits")
def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of a commit: given keys, with the binding set over what was there; keys sorted."""
    given = F.create_map(F.lit("version"), F.col("version"), F.lit("ref"), F.lit("none"))
    kept = F.map_filter(given, lambda k, _: k != "ref")
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, F.create_map(F.lit("ref"), F.col("ref"))))))
    return P.commits(spark, sf).select("ref", F.to_json(merged).alias("metadata"))


@query("P3_show_keys", "SELECT event_id, list_sort(json_keys(props))[1] AS first_key, len(json_keys(props)) AS n FROM events")
def show_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return P.load(spark, sf, "events").select("event_id", F.try_element_at(F.array_sort(keys), F.lit(1)).alias("first_key"), F.size(keys).cast("bigint").alias("n"))


@query("SK14_replicate_refs", """
WITH RECURSIVE g AS (SELECT checksum FROM order_refs WHERE CAST(substr(checksum, 2) AS BIGINT) % 5 = 0 UNION SELECT child FROM g
    JOIN edges ON parent = g.checksum) SELECT objtype, count(*) AS n FROM objects WHERE checksum IN (SELECT checksum FROM g) GROUP BY 1
""", "order_refs", "edges", "objects")
def replicate_refs(spark: SparkSession, sf: str) -> DataFrame:
    """What copying some refs to another store takes: their closure."""
    from arborlake.operators.history import closure

    roots = P.order_refs(spark, sf).filter("CAST(substr(checksum, 2) AS BIGINT) % 5 = 0").select("checksum")
    return P.objects(spark, sf).join(closure(roots, P.edges(spark, sf)), "checksum", "left_semi").groupBy("objtype").agg(F.count("*").alias("n"))


@query("SK7_ref_upsert", "SELECT ref_name, CASE WHEN remote = 'origin' THEN sha256(checksum) ELSE checksum END AS checksum FROM refs", "refs")
def ref_upsert(spark: SparkSession, sf: str) -> DataFrame:
    from arborlake.operators.transaction import apply_ref_writes

    refs = P.refs(spark, sf)
    writes = refs.filter("remote = 'origin'").select("ref_name", F.lit(1).alias("seq"), F.sha2("checksum", 256).alias("checksum"))
    return apply_ref_writes(refs, writes)


@query("J17_cache_preference", """
SELECT checksum, CASE WHEN n % 3 = 0 THEN 'origin' WHEN n % 2 = 0 THEN 'cache1' WHEN n % 5 = 0 THEN 'cache2' ELSE 'http' END AS source
    FROM (SELECT checksum, CAST(substr(checksum, 2) AS BIGINT) AS n FROM objects WHERE objtype = 1)
""", "objects")
def cache_preference(spark: SparkSession, sf: str) -> DataFrame:
    files = P.objects(spark, sf).filter("objtype = 1").select("checksum", F.substring("checksum", 2, 20).cast("bigint").alias("n"))
    return R.prefer(files.select("checksum"), [("origin", files.filter("n % 3 = 0")), ("cache1", files.filter("n % 2 = 0")), ("cache2", files.filter("n % 5 = 0"))])


@query("A10_delta_index", """
SELECT \"to\", count(*) AS n, string_agg(coalesce(\"from\", '') || ':' || digest, ',' ORDER BY coalesce(\"from\", ''), digest) AS entries FROM deltas
    GROUP BY 1
""", "deltas")
def delta_index(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.struct(F.coalesce("from", F.lit("")).alias("f"), "digest")
    grouped = P.deltas(spark, sf).groupBy("to").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("e"))
    return grouped.select("to", "n", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["f"], x["digest"])), ",").alias("entries"))


@query("D6_delta_catalog", """
SELECT CASE WHEN \"from\" IS NULL THEN \"to\" ELSE \"from\" || '-' || \"to\" END AS name,
        digest = sha256(CASE WHEN \"from\" IS NULL THEN '' ELSE \"from\" || '-' END || \"to\") AS valid
    FROM deltas
""", "deltas")
def delta_catalog(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("-", "from", "to")
    return P.deltas(spark, sf).select(name.alias("name"), (F.sha2(name, 256) == F.col("digest")).alias("valid"))


@query("D7_prune_deltas", "SELECT \"to\" FROM deltas WHERE \"to\" NOT IN (SELECT checksum FROM commits WHERE turn % 3 = 0)", "deltas", "commits")
def prune_deltas(spark: SparkSession, sf: str) -> DataFrame:
    gone = P.commits(spark, sf).filter("turn % 3 = 0").select(F.col("checksum").alias("to"))
    return P.deltas(spark, sf).join(gone, "to", "left_anti").select("to")


def _named(tree: DataFrame) -> DataFrame:
    return tree.filter("type = 'f'").select("checksum", "size", "mode", F.element_at(F.split("path", "/"), 2).alias("name"))


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a, b = _named(P.tree_a(spark, sf)), _named(P.tree_b(spark, sf))
    return a, b.join(a.select("checksum"), "checksum", "left_anti")


_NAMED = """
WITH old AS (SELECT DISTINCT checksum, size, mode, split_part(path, '/', 2) AS name FROM tree_a WHERE type = 'f'),
new AS (SELECT DISTINCT checksum, size, split_part(path, '/', 2) AS name FROM tree_b WHERE type = 'f' AND checksum NOT IN (SELECT checksum FROM old)),
ranked AS (SELECT n.checksum AS "to", o.checksum AS "from", row_number() OVER (PARTITION BY n.checksum ORDER BY o.size, o.checksum) AS rn FROM new n JOIN old o ON o.name = n.name AND o.size BETWEEN CAST(floor(n.size * 70 / 100) AS BIGINT) AND CAST(floor(n.size * 130 / 100) AS BIGINT)),
sim AS (SELECT "to", "from" FROM ranked WHERE rn = 1)
"""


@query("J4_similar_objects", _NAMED + 'SELECT "to", "from", false AS fuzzy FROM sim', "tree_a", "tree_b")
def similar_objects(spark: SparkSession, sf: str) -> DataFrame:
    return D.similar_objects(*_both(spark, sf))


@query("D1_delta_plan", _NAMED + "SELECT n.checksum, CASE WHEN s.\"from\" IS NOT NULL AND (o.mode & 4) <> 0 AND n.size > 0 AND n.size + o.size <= 20000 THEN 'bsdiff' WHEN n.size > 3000 THEN 'fallback' ELSE 'inline' END AS strategy, CASE WHEN s.\"from\" IS NOT NULL AND (o.mode & 4) <> 0 AND n.size > 0 AND n.size + o.size <= 20000 THEN s.\"from\" END AS \"from\", n.size FROM (SELECT checksum, max(size) AS size FROM new GROUP BY 1) n LEFT JOIN sim s ON s.\"to\" = n.checksum LEFT JOIN (SELECT checksum, max(size) AS size, max(mode) AS mode FROM old GROUP BY 1) o ON o.checksum = s.\"from\"", "tree_a", "tree_b")
def delta_plan(spark: SparkSession, sf: str) -> DataFrame:
    """How each new object is sent, with limits that suit the small files here."""
    old, new = _both(spark, sf)
    return D.plan(new, D.similar_objects(old, new), old, min_fallback=3000, max_bsdiff=20000)


@query("D2_mode_dictionary", "SELECT path, dense_rank() OVER (ORDER BY mode, uid, gid) - 1 AS code FROM tree_a", "tree_a")
def mode_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return D.dictionary(P.tree_a(spark, sf), "mode", "uid", "gid").select("path", F.col("code").cast("bigint").alias("code"))


@query("D3_fallback_headers", "SELECT checksum, objtype, max(archived) AS archived, max(unpacked) AS unpacked FROM sizes WHERE unpacked > 40000 GROUP BY 1, 2", "sizes")
def fallback_headers(spark: SparkSession, sf: str) -> DataFrame:
    return P.sizes(spark, sf).filter("unpacked > 40000").groupBy("checksum", "objtype").agg(F.max("archived").alias("archived"), F.max("unpacked").alias("unpacked"))


@query("A4_part_totals", """
SELECT commit, CAST(sum(archived) AS BIGINT) AS archived, CAST(sum(unpacked) AS BIGINT) AS unpacked, string_agg(checksum, ',' ORDER BY checksum) AS objects
    FROM sizes GROUP BY 1
""", "sizes")
def part_totals(spark: SparkSession, sf: str) -> DataFrame:
    return P.sizes(spark, sf).groupBy("commit").agg(F.sum("archived").alias("archived"), F.sum("unpacked").alias("unpacked"), F.array_join(F.array_sort(F.collect_list("checksum")), ",").alias("objects"))


@query("D5_parts_to_apply", "SELECT DISTINCT commit AS part FROM sizes WHERE checksum NOT IN (SELECT checksum FROM reachable)", "sizes", "reachable")
def parts_to_apply(spark: SparkSession, sf: str) -> DataFrame:
    from arborlake.operators.history import closure

    held = closure(P.order_refs(spark, sf).select("checksum"), P.edges(spark, sf))
    return D.missing_parts(P.sizes(spark, sf).withColumnRenamed("commit", "part"), held)


@query("D8_endianness_guess", """
SELECT commit AS delta, bool_or(archived > 1.2 * unpacked) OR sum(unpacked) / count(*) > 4294967296 AS swapped
    FROM (SELECT commit, archived * CASE WHEN substr(commit, 2) LIKE '%7' THEN 5 ELSE 1 END AS archived, unpacked FROM sizes) GROUP BY 1
""", "sizes")
def endianness_guess(spark: SparkSession, sf: str) -> DataFrame:
    swapped = F.when(F.col("commit").endswith("7"), 5).otherwise(1)
    return D.guess_swapped(P.sizes(spark, sf).select(F.col("commit").alias("delta"), (F.col("archived") * swapped).alias("size"), F.col("unpacked").alias("usize"), F.lit(1).alias("n_objects")))


@query("W11_part_packing")
def part_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of each run of 200 orders packed in sequence; compared with a plain loop in the tests."""
    rows = P.sizes(spark, sf).select(F.concat(F.lit("d"), F.floor(F.substring("commit", 2, 20).cast("bigint") / 200)).alias("delta"), F.xxhash64("commit", "checksum").alias("seq"), "checksum", F.col("unpacked").alias("size"), F.when(F.col("unpacked") % 3 == 0, "patch").otherwise("plain").alias("kind"))
    return D.pack_parts(rows, max_chunk=200_000)
