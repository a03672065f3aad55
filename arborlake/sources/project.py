"""The snapshot-store model projected from the driver's tables.

A real store is read by ``arborlake.sources.stores``; these projections give the
same model tables, deterministically, from the TPC-H-like tables, so that every
query can be checked by SQL. ``SQL`` holds the same projections for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Object types of the store model.
FILE, DIRTREE, DIRMETA, COMMIT, TOMBSTONE, COMMITMETA, PAYLOAD_LINK = 1, 2, 3, 4, 5, 6, 7
IS_META = (2, 3, 4, 5, 6)
DIR_MODE, PRIVATE_DIR_MODE = 0o040755, 0o040700


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirmeta(uid: Column, gid: Column, mode: Column) -> Column:
    """The record of a directory's metadata without xattrs: three big-endian numbers."""
    return F.unhex(F.format_string("%08x%08x%08x", uid, gid, mode))


def parent_of(path: Column) -> Column:
    """The directory that holds a path; the root is the empty path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """All directories above a path, without the root."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def with_directories(files: DataFrame, private: Column) -> DataFrame:
    """Adds the directories above ``files``; ``private`` (of a path) says which have the closed mode."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    mode = F.when(private, F.lit(PRIVATE_DIR_MODE)).otherwise(F.lit(DIR_MODE)).cast("int")
    dirs = dirs.select("path", F.lit("d").alias("type"), mode.alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(0).cast("bigint").alias("size"))
    dirs = dirs.withColumn("checksum", F.sha2(dirmeta(F.col("uid"), F.col("gid"), F.col("mode")), 256))
    return files.select("path", "type", "mode", "uid", "gid", "size", "checksum").unionByName(dirs)


def files(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    mode = F.when(doc % 17 == 0, 0o120777).when(doc % 4 == 0, 0o100755).otherwise(0o100644).cast("int")
    return docs.select(
        doc,
        F.concat_ws("/", "lang", "source", doc.cast("string")).alias("path"),
        F.when(doc % 17 == 0, "l").otherwise("f").alias("type"),
        mode.alias("mode"),
        (doc % 3).cast("int").alias("uid"),
        (doc % 2).cast("int").alias("gid"),
        F.col("n_chars").alias("size"),
        "text",
    )


def tree_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot: a file for each document at lang/source/doc_id."""
    return with_directories(files(load(spark, sf_dir, "documents")).withColumn("checksum", F.sha2("text", 256)), F.lit(False))


def tree_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot: some files removed, changed, moved below new/, or turned into directories."""
    doc = F.col("doc_id")
    rows = files(load(spark, sf_dir, "documents")).filter(doc % 7 != 0)
    path = F.concat(F.when(doc % 11 == 0, "new/").otherwise(""), F.col("path"), F.when(doc % 13 == 0, "/inner").otherwise(""))
    text = F.concat("text", F.when(doc % 5 == 0, "!").otherwise(""))
    rows = rows.withColumn("path", path).withColumn("checksum", F.sha2(text, 256)).withColumn("size", F.length(text).cast("bigint"))
    return with_directories(rows, F.col("path").startswith("de"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each conversation, a commit for each turn; clocks run back at some turns."""
    turns = load(spark, sf_dir, "conversations")
    name = lambda turn: F.sha2(F.concat_ws("|", "conv_id", turn), 256)
    return turns.select(
        name(F.col("turn")).alias("checksum"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"),
        F.concat(F.lit("chat/"), F.col("conv_id") % 10, F.lit("/"), F.col("conv_id")).alias("ref"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        (F.lit(1700000000) + F.col("conv_id") * 100 + F.col("turn") * 10 - F.when(F.col("turn") % 3 == 2, 25).otherwise(0)).cast("bigint").alias("ts"),
        F.col("text").alias("subject"),
        F.sha2(F.concat_ws("|", F.lit("tree"), F.col("conv_id") % 40, F.greatest("turn", F.lit(1))), 256).alias("root_tree"),
        F.sha2(dirmeta(F.lit(0), F.lit(0), F.lit(DIR_MODE)), 256).alias("root_meta"),
        F.concat(F.lit("1."), F.col("turn")).alias("version"),
        ((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0)).alias("partial"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ref for the tip of each branch, in local and remote namespaces; every tenth is an alias of the branch before."""
    all_commits = commits(spark, sf_dir)
    tips = all_commits.groupBy("ref", "conv_id").agg(F.max_by("checksum", "turn").alias("checksum"))
    conv = F.col("conv_id")
    return tips.select(
        F.when(conv % 3 == 1, "origin").when(conv % 3 == 2, "mirror").alias("remote"),
        F.when(conv % 4 == 0, "org.example.Chat").alias("collection_id"),
        F.col("ref").alias("ref_name"),
        "checksum",
        F.when((conv % 10 == 0) & (conv > 0), F.concat(F.lit("chat/"), (conv - 1) % 10, F.lit("/"), conv - 1)).alias("alias_of"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the order graph: a commit an order, a file a part, a tree a supplier, nation and region."""
    part, supplier, orders = (load(spark, sf_dir, t) for t in ("part", "supplier", "orders"))
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = [
        orders.select(F.concat(F.lit("c"), "o_orderkey").alias("checksum"), F.lit(COMMIT).alias("objtype"), F.floor("o_totalprice").cast("bigint").alias("storage_size")),
        part.select(F.concat(F.lit("f"), "p_partkey"), F.lit(FILE), F.col("p_size").cast("bigint")),
        supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.lit(DIRTREE), F.lit(10).cast("bigint")),
        nation.select(F.concat(F.lit("n"), "n_nationkey"), F.lit(DIRTREE), F.lit(20).cast("bigint")),
        region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit(DIRMETA), F.lit(30).cast("bigint")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("objtype", F.col("objtype").cast("int"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child) of the order graph."""
    lines = load(spark, sf_dir, "lineitem")
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    order = F.concat(F.lit("c"), "l_orderkey").alias("parent")
    down = lines.select(order, F.explode(F.array(F.concat(F.lit("f"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))).alias("child")).distinct()
    up = supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")).union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return down.union(up)


def order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_name, checksum): the orders of the last 60 days are named."""
    orders = load(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))
    recent = orders.join(F.broadcast(last)).filter(F.col("o_orderdate") > F.col("last") - F.expr("INTERVAL 60 DAYS"))
    return recent.select(F.concat(F.lit("orders/"), "o_orderkey").alias("ref_name"), F.concat(F.lit("c"), "o_orderkey").alias("checksum"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size index (commit, checksum, objtype, archived, unpacked), one row an order and part."""
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(F.max(F.floor(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)")))).cast("bigint").alias("archived"), F.max(F.floor("l_extendedprice")).cast("bigint").alias("unpacked"))
        .select(F.concat(F.lit("c"), "l_orderkey").alias("commit"), F.concat(F.lit("f"), "l_partkey").alias("checksum"), F.lit(FILE).alias("objtype"), "archived", "unpacked")
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, path, type, checksum): three overlapping trees of customers and suppliers by nation."""
    c = load(spark, sf_dir, "customer")
    s = load(spark, sf_dir, "supplier")
    one = c.filter("c_custkey % 2 = 0").select(F.lit(1).alias("layer"), F.concat_ws("/", F.lit("n"), F.col("c_nationkey"), F.concat(F.lit("e"), F.col("c_custkey") % 50)).alias("path"), F.col("c_custkey").alias("k"))
    two = c.filter("c_custkey % 3 = 0").select(F.lit(2), F.concat_ws("/", F.lit("n"), F.col("c_nationkey"), F.concat(F.lit("e"), F.col("c_custkey") % 40)), F.col("c_custkey"))
    three = s.select(F.lit(3), F.concat_ws("/", F.lit("n"), F.col("s_nationkey"), F.concat(F.lit("e"), F.col("s_suppkey") % 30)), F.col("s_suppkey"))
    rows = one.union(two).union(three).groupBy("layer", "path").agg(F.max("k").alias("k"))
    return rows.select("layer", "path", F.when(F.col("k") % 23 == 0, "l").otherwise("f").alias("type"), F.sha2(F.concat(F.lit("x"), F.col("k") % 97), 256).alias("checksum"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(remote, priority, last_modified, ref_name, checksum, ts): what each remote offers for each ref."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    version = F.floor(F.abs("s_acctbal") % 7).cast("bigint")
    return both.select(
        F.col("s_name").alias("remote"), (F.col("s_nationkey") % 3).alias("priority"), (F.col("s_suppkey") % 5 * 100).cast("bigint").alias("last_modified"), F.col("r_name").alias("ref_name"),
        F.when(version > 0, F.concat_ws("-", "r_name", version)).alias("checksum"), F.when(version > 0, version * 10).alias("ts"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to, digest): a delta from each parent, and one from scratch for every first commit."""
    c = commits(spark, sf_dir).filter("turn % 2 = 1 OR turn = 0")
    return c.select(F.col("parent").alias("from"), F.col("checksum").alias("to"), F.sha2(F.concat_ws("-", "parent", "checksum"), 256).alias("digest"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, osname, csum, bootcsum, pinned, booted): the events of a user are its deployments."""
    e = load(spark, sf_dir, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", "event_id", "event_type", n.alias("idx")).select(
        "idx", F.concat(F.lit("os"), "user_id").alias("osname"), F.sha2(F.concat_ws("|", F.col("user_id"), F.col("event_id") % 3), 256).alias("csum"), F.sha2("event_type", 256).alias("bootcsum"),
        (F.col("event_id") % 6 == 0).alias("pinned"), (F.col("idx") == F.col("user_id") % 8).alias("booted"),
    )


_NAME = "sha256(conv_id || '|' || {})"
_ANC = "unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))"
_DIRS = "SELECT path, 'd' AS type, m AS mode, 0 AS uid, 0 AS gid, 0 AS size, sha256(unhex('0000000000000000' || printf('%08x', m))) AS checksum FROM (SELECT DISTINCT path, {} AS m FROM (SELECT " + _ANC + " AS path FROM {}))"

#: The projections as SQL, by the name of the Spark function; the second value lists what a statement builds on.
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "files": ("SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 'l' ELSE 'f' END AS type, CASE WHEN doc_id % 17 = 0 THEN 41471 WHEN doc_id % 4 = 0 THEN 33261 ELSE 33188 END AS mode, CAST(doc_id % 3 AS INTEGER) AS uid, CAST(doc_id % 2 AS INTEGER) AS gid, n_chars AS size, text FROM documents", ()),
    "tree_a": ("SELECT path, type, mode, uid, gid, size, sha256(text) AS checksum FROM files UNION ALL " + _DIRS.format("16877", "files"), ("files",)),
    "files_b": ("SELECT CASE WHEN doc_id % 11 = 0 THEN 'new/' ELSE '' END || path || CASE WHEN doc_id % 13 = 0 THEN '/inner' ELSE '' END AS path, type, mode, uid, gid, length(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS size, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS checksum FROM files WHERE doc_id % 7 <> 0", ("files",)),
    "tree_b": ("SELECT path, type, mode, uid, gid, size, checksum FROM files_b UNION ALL " + _DIRS.format("CASE WHEN path LIKE 'de%' THEN 16832 ELSE 16877 END", "files_b"), ("files_b",)),
    "commits": (
        f"SELECT {_NAME.format('turn')} AS checksum, CASE WHEN turn > 0 THEN {_NAME.format('(turn - 1)')} END AS parent, 'chat/' || (conv_id % 10) || '/' || conv_id AS ref, conv_id, turn, 1700000000 + conv_id * 100 + turn * 10 - CASE WHEN turn % 3 = 2 THEN 25 ELSE 0 END AS ts, text AS subject, sha256('tree|' || (conv_id % 40) || '|' || greatest(turn, 1)) AS root_tree, sha256(unhex('0000000000000000000041ed')) AS root_meta, '1.' || turn AS version, conv_id % 9 = 0 AND turn = 0 AS partial FROM conversations",
        (),
    ),
    "refs": ("SELECT CASE conv_id % 3 WHEN 1 THEN 'origin' WHEN 2 THEN 'mirror' END AS remote, CASE WHEN conv_id % 4 = 0 THEN 'org.example.Chat' END AS collection_id, ref AS ref_name, arg_max(checksum, turn) AS checksum, CASE WHEN conv_id % 10 = 0 AND conv_id > 0 THEN 'chat/' || ((conv_id - 1) % 10) || '/' || (conv_id - 1) END AS alias_of FROM commits GROUP BY conv_id, ref", ("commits",)),
    "objects": ("SELECT 'c' || o_orderkey AS checksum, 4 AS objtype, CAST(floor(o_totalprice) AS BIGINT) AS storage_size FROM orders UNION ALL SELECT 'f' || p_partkey, 1, p_size FROM part UNION ALL SELECT 's' || s_suppkey, 2, 10 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 2, 20 FROM nation UNION ALL SELECT 'r' || r_regionkey, 3, 30 FROM region", ()),
    "edges": ("SELECT DISTINCT 'c' || l_orderkey AS parent, 'f' || l_partkey AS child FROM lineitem UNION ALL SELECT DISTINCT 'c' || l_orderkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation", ()),
    "order_refs": ("SELECT 'orders/' || o_orderkey AS ref_name, 'c' || o_orderkey AS checksum FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY", ()),
    "reachable": ("SELECT * FROM (WITH RECURSIVE g AS (SELECT checksum FROM order_refs UNION SELECT child FROM g JOIN edges ON parent = checksum) SELECT checksum FROM g)", ("order_refs", "edges")),
    "sizes": ("SELECT 'c' || l_orderkey AS commit, 'f' || l_partkey AS checksum, 1 AS objtype, CAST(max(floor(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))))) AS BIGINT) AS archived, CAST(max(floor(l_extendedprice)) AS BIGINT) AS unpacked FROM lineitem GROUP BY l_orderkey, l_partkey", ()),
    "layers": (
        "SELECT layer, path, CASE WHEN k % 23 = 0 THEN 'l' ELSE 'f' END AS type, sha256('x' || (k % 97)) AS checksum FROM (SELECT layer, path, max(k) AS k FROM (SELECT 1 AS layer, 'n/' || c_nationkey || '/e' || (c_custkey % 50) AS path, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 2, 'n/' || c_nationkey || '/e' || (c_custkey % 40), c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 3, 'n/' || s_nationkey || '/e' || (s_suppkey % 30), s_suppkey FROM supplier) GROUP BY layer, path)",
        (),
    ),
    "candidates": ("SELECT s_name AS remote, s_nationkey % 3 AS priority, s_suppkey % 5 * 100 AS last_modified, r_name AS ref_name, CASE WHEN v > 0 THEN r_name || '-' || v END AS checksum, CASE WHEN v > 0 THEN v * 10 END AS ts FROM (SELECT *, CAST(floor(abs(s_acctbal) % 7) AS BIGINT) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)", ()),
    "deltas": ("SELECT parent AS \"from\", checksum AS \"to\", sha256(CASE WHEN parent IS NULL THEN '' ELSE parent || '-' END || checksum) AS digest FROM commits WHERE turn % 2 = 1 OR turn = 0", ("commits",)),
    "deployments": ("SELECT CAST(n AS INTEGER) AS idx, 'os' || user_id AS osname, sha256(user_id || '|' || (event_id % 3)) AS csum, sha256(event_type) AS bootcsum, event_id % 6 = 0 AS pinned, n = user_id % 8 AS booted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)", ()),
}


def oracle(body: str, *uses: str) -> str:
    """``body`` with the projections it uses as common table expressions; ``body`` may go on with more of them after ``WITH``."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    parts = [f"{n} AS ({SQL[n][0]})" for n in order]
    body = body.strip()
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE") else ""
    if body.startswith("WITH"):
        parts.append(body[len("WITH RECURSIVE" if recursive else "WITH") :].lstrip())
        return f"WITH {recursive}" + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + body
