"""Queries of scalar functions over whole tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import scalars as S
from arborlake.operators import verify as V
from arborlake.plans.registry import query
from arborlake.sources import project as P

_B64 = "replace(rtrim(to_base64(unhex({})), '='), '/', '_')"


_HEADER = "printf('%08x', 17 + t + k) || '00000000' || printf('%08x%08x%08x', uid, gid, mode) || '00000000' || hex(encode(target)) || '00' || CASE k WHEN 1 THEN printf('%02x', 17 + t) ELSE printf('%02x%02x', (17 + t) % 256, (17 + t) // 256) END"


@query("F1_content_checksum", f"""
SELECT path, sha256(unhex({_HEADER}) || encode(CASE WHEN type = 'l' THEN '' ELSE text END)) AS id
    FROM (SELECT *, CASE WHEN 18 + t < 256 THEN 1 ELSE 2 END AS k FROM (SELECT *, octet_length(encode(target)) AS t
    FROM (SELECT *, CASE WHEN type = 'l' THEN path ELSE '' END AS target FROM files)))
""", "files")
def content_checksum(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each file and link: the hash of its header and content, as the store has it."""
    f = P.files(P.load(spark, sf, "documents"))
    link = F.col("type") == "l"
    return f.select("path", S.content_checksum(F.col("uid"), F.col("gid"), F.col("mode"), F.when(link, F.col("path")).otherwise(""), F.when(link, "").otherwise(F.col("text"))).alias("id"))


@query("F2_metadata_verify", "SELECT path, sha256(unhex(printf('%08x%08x%08x', uid, gid, mode))) = checksum AS ok FROM tree_b WHERE type = 'd'", "tree_b")
def metadata_verify(spark: SparkSession, sf: str) -> DataFrame:
    dirs = P.tree_b(spark, sf).filter("type = 'd'").withColumn("content", P.dirmeta(F.col("uid"), F.col("gid"), F.col("mode")))
    return V.rehash(dirs).select("path", "ok")


@query("F3_commit_content_checksum", "SELECT checksum, sha256(unhex(root_tree) || unhex(root_meta)) AS content FROM commits", "commits")
def commit_content_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return P.commits(spark, sf).select("checksum", S.commit_content_checksum(F.col("root_tree"), F.col("root_meta")).alias("content"))


@query("F4_hex_round_trip", "SELECT checksum, lower(hex(unhex(upper(checksum)))) AS again FROM commits", "commits")
def hex_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return P.commits(spark, sf).select("checksum", F.lower(F.hex(F.unhex(F.upper("checksum")))).alias("again"))


@query("F5_modified_base64", f"SELECT checksum, {_B64.format('checksum')} AS b64 FROM commits", "commits")
def modified_base64(spark: SparkSession, sf: str) -> DataFrame:
    return P.commits(spark, sf).select("checksum", S.modified_base64(F.col("checksum")).alias("b64"))


@query("F6_loose_path", """
SELECT checksum, substr(checksum, 1, 2) || '/' || substr(checksum, 3) || CASE WHEN type = 'd' THEN '.dirmeta' ELSE '.filez' END AS path
    FROM (SELECT DISTINCT checksum, type = 'd' AS d, CASE WHEN type = 'd' THEN 'd' ELSE 'f' END AS type FROM tree_a)
""", "tree_a")
def loose_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.tree_a(spark, sf).select("checksum", F.when(F.col("type") == "d", P.DIRMETA).otherwise(P.FILE).alias("t")).distinct()
    return rows.select("checksum", S.loose_path(F.col("checksum"), F.col("t"), compressed=True).alias("path"))


@query("F7_delta_path", f"""
SELECT \"to\", 'deltas/' || substr(n, 1, 2) || '/' || substr(n, 3) AS path
    FROM (SELECT \"to\", CASE WHEN \"from\" IS NULL THEN '' ELSE {_B64.format('\"from\"')} || '-' END || {_B64.format('\"to\"')} AS n FROM deltas)
""", "deltas")
def delta_path(spark: SparkSession, sf: str) -> DataFrame:
    return P.deltas(spark, sf).select("to", S.delta_path(F.col("from"), F.col("to")).alias("path"))


@query("F8_refspec_parse", "SELECT CASE WHEN remote IS NULL THEN '' ELSE remote || ':' END || ref_name AS spec, remote, ref_name AS ref FROM refs", "refs")
def refspec_parse(spark: SparkSession, sf: str) -> DataFrame:
    spec = P.refs(spark, sf).select(F.concat_ws(":", "remote", "ref_name").alias("spec"))
    return spec.withColumn("p", S.parse_refspec(F.col("spec"))).select("spec", "p.remote", "p.ref")


@query("F9_object_name", """
SELECT checksum || CASE objtype WHEN 1 THEN '.file' WHEN 2 THEN '.dirtree' WHEN 3 THEN '.dirmeta' ELSE '.commit' END AS name, checksum, objtype
    FROM objects
""", "objects")
def object_name(spark: SparkSession, sf: str) -> DataFrame:
    named = P.objects(spark, sf).select(S.object_name(F.col("checksum"), F.col("objtype")).alias("name"))
    return named.withColumn("p", S.parse_object_name(F.col("name"))).select("name", "p.checksum", "p.objtype")


@query("F10_mode_decode", "SELECT path, CASE mode & 61440 WHEN 16384 THEN 'dir' WHEN 32768 THEN 'file' WHEN 40960 THEN 'symlink' ELSE 'other' END AS kind FROM tree_b", "tree_b")
def mode_decode(spark: SparkSession, sf: str) -> DataFrame:
    return P.tree_b(spark, sf).select("path", S.mode_type(F.col("mode")).alias("kind"))


@query("F11_timestamps", "SELECT checksum, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS shown, ts AS parsed FROM commits", "commits")
def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format(F.timestamp_seconds("ts"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return P.commits(spark, sf).select("checksum", S.display_time(F.col("ts")).alias("shown"), S.http_date(text).alias("parsed"))


@query("F18_xattr_filter", "SELECT doc_id, 'user.lang=' || lang || ',user.source=' || source AS xattrs FROM documents")
def xattr_filter(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    all_of = F.array(pair("user.source", F.col("source")), pair("security.selinux", F.lit("x")), pair("user.lang", F.col("lang")))
    kept = S.filter_xattrs(all_of, "security.selinux")
    return P.load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(kept, lambda x: F.concat_ws("=", x["name"], x["value"])), ",").alias("xattrs"))


@query("O2_xattr_order", "SELECT doc_id, array_to_string(list_sort([source, lang, 'm' || (doc_id % 7)]), ',') AS names FROM documents")
def xattr_order(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array("source", "lang", F.concat(F.lit("m"), F.col("doc_id") % 7))
    sorted_by_name = F.array_sort(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("v").alias("value"))))
    return P.load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(sorted_by_name, lambda x: x["name"]), ",").alias("names"))


@query("F23_kernel_args", """
SELECT event_id, 'root=/dev/sda1 quiet ' || event_type || '=u' || user_id || ' opt=\"a b\" nosmt' AS line, 'u' || user_id AS last,
        'root=/dev/sda1 quiet ' || event_type || '=new opt=\"a b\" nosmt' AS replaced,
        CASE WHEN event_type = 'click' THEN 'root=/dev/sda1 quiet opt=\"a b\" nosmt' END AS deleted
    FROM events
""")
def kernel_args(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("root=/dev/sda1 quiet "), "event_type", F.lit("=u"), "user_id", F.lit(' opt="a b" nosmt'))
    # Parsed in a step of its own, so that every output reads the same array.
    rows, args = P.load(spark, sf, "events").select("event_id", "event_type", S.parse_kargs(line).alias("args")), F.col("args")
    at = F.filter(args, lambda a: a["key"] == F.col("event_type"))
    swapped = F.transform(args, lambda a: F.when(a["key"] == F.col("event_type"), F.struct(a["key"].alias("key"), F.lit("new").alias("value"))).otherwise(a))
    out = S.format_kargs(args).alias("line"), F.element_at(at, -1)["value"].alias("last"), S.format_kargs(swapped).alias("replaced"), S.format_kargs(S.delete_karg(args, "click")).alias("deleted")
    return rows.select("event_id", *out)


@query("F24_boot_entries", "SELECT idx, osname, 'title ' || osname AS title, idx AS left_count, 1 AS done FROM deployments", "deployments")
def boot_entries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("# entry\ntitle  title "), "osname", F.lit("\nversion "), "idx")
    name = F.concat(F.lit("os-"), "idx", F.lit("+"), "idx", F.lit("-1.conf"))
    d = P.deployments(spark, sf).withColumns({"m": S.boot_entry(text), "c": S.boot_counting(name)})
    return d.select("idx", "osname", F.element_at("m", F.lit("title")).alias("title"), F.col("c.left").alias("left_count"), F.col("c.done").alias("done"))


@query("F25_tar_paths", "SELECT path, CASE WHEN starts_with(path, 'en') THEN 'usr/etc' || substr(path, 3) ELSE path END AS clean FROM tree_a", "tree_a")
def tar_paths(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("./"), F.regexp_replace("path", "^en", "etc"), F.when(F.col("type") == "d", "/").otherwise(""))
    return P.tree_a(spark, sf).select("path", S.tar_path(raw).alias("clean"))


@query("F26_path_split", """
SELECT url, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND x <> '.') AS parts
    FROM pages
""")
def path_split(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return P.load(spark, sf, "pages").select("url", S.split_path(plain).alias("parts"))


@query("F27_human_sizes", """
SELECT l_orderkey, l_partkey, CASE WHEN p = 1 THEN '1 byte' WHEN p < 1000 THEN p || ' bytes' WHEN p < 1000000 THEN ((p * 10 + 500) // 1000 // 10) || '.' || ((p * 10 + 500) // 1000 % 10) || ' kB' ELSE ((p * 10 + 500000) // 1000000 // 10) || '.' || ((p * 10 + 500000) // 1000000 % 10) || ' MB' END AS shown
    FROM (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) * l_partkey AS p FROM lineitem)
""")
def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("bigint") * F.col("l_partkey")).alias("p")).distinct()
    return rows.select("l_orderkey", "l_partkey", S.human_size(F.col("p")).alias("shown"))


@query("F28_version_check", "SELECT o_orderkey, year(o_orderdate) > 1997 OR (year(o_orderdate) = 1997 AND month(o_orderdate) >= 6) AS ok FROM orders")
def version_check(spark: SparkSession, sf: str) -> DataFrame:
    return P.load(spark, sf, "orders").select("o_orderkey", S.version_at_least(F.year("o_orderdate"), F.month("o_orderdate"), 1997, 6).alias("ok"))


@query("F29_status_json", """
SELECT osname, '[' || string_agg('{\"booted\":' || booted || ',\"idx\":' || idx || ',\"pinned\":' || pinned || '}', ',' ORDER BY idx) || ']' AS status
    FROM deployments GROUP BY 1
""", "deployments")
def status_json(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("idx", F.struct("booted", "idx", "pinned").alias("d"))
    grouped = P.deployments(spark, sf).groupBy("osname").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)).alias("l"))
    return grouped.select("osname", F.to_json(F.transform("l", lambda x: x["d"])).alias("status"))


@query("F31_os_release", "SELECT o_orderkey, 'fancy ' || o_orderpriority AS name, CAST(o_custkey AS VARCHAR) AS version FROM orders")
def os_release(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('# x\nNAME="old"\nNAME="fancy '), "o_orderpriority", F.lit('"\n\nVERSION_ID='), "o_custkey")
    m = S.key_values(text)
    return P.load(spark, sf, "orders").select("o_orderkey", F.element_at(m, F.lit("NAME")).alias("name"), F.element_at(m, F.lit("VERSION_ID")).alias("version"))


@query("P12_delta_candidates", "SELECT doc_id, n_chars > 0 AND doc_id % 5 > 1 AS candidate FROM documents")
def delta_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.when(F.col("doc_id") % 5 == 0, ".tar.xz").when(F.col("doc_id") % 5 == 1, ".bz2").when(F.col("doc_id") % 5 == 2, ".xz.txt").otherwise("")
    names = F.array(F.concat("source", ext), F.lit("xz"))
    return P.load(spark, sf, "documents").select("doc_id", ((F.col("n_chars") > 0) & ~S.is_compressed_name(names)).alias("candidate"))


@query("P14_name_validation", """
SELECT ref_name, true AS ref_ok, false AS climbing_ok, collection_id IS NOT NULL AS collection_ok, length(checksum) = 64 AS checksum_ok FROM refs
""", "refs")
def name_validation(spark: SparkSession, sf: str) -> DataFrame:
    return P.refs(spark, sf).select("ref_name", V.valid_ref(F.col("ref_name")).alias("ref_ok"), V.valid_filename(F.concat(F.lit("../"), "ref_name")).alias("climbing_ok"), F.coalesce(V.valid_collection_id(F.col("collection_id")), F.lit(False)).alias("collection_ok"), V.valid_checksum(F.col("checksum")).alias("checksum_ok"))


@query("P15_deployment_predicates", "SELECT osname, count(*) FILTER (pinned) AS n_pinned, count(*) FILTER (booted) AS n_booted FROM deployments GROUP BY 1", "deployments")
def deployment_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return P.deployments(spark, sf).groupBy("osname").agg(F.count_if("pinned").alias("n_pinned"), F.count_if("booted").alias("n_booted"))


@query("A12_space_estimate", "SELECT osname, count(DISTINCT bootcsum) AS n_boot, CAST(count(DISTINCT bootcsum) * 40 AS BIGINT) AS bytes FROM deployments GROUP BY 1", "deployments")
def space_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """New boot folders times the size of a kernel and its image (40 here)."""
    return P.deployments(spark, sf).groupBy("osname").agg(F.countDistinct("bootcsum").alias("n_boot")).withColumn("bytes", F.col("n_boot") * 40)


@query("A13_min_free_space", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) * 1048576 WHEN 1 THEN CAST(p_size AS BIGINT) * 1073741824 WHEN 2 THEN CAST(p_size AS BIGINT) * 1099511627776 END AS bytes
    FROM part
""")
def min_free_space(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("MB"), F.lit("GB"), F.lit("TB"), F.lit("kB")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return P.load(spark, sf, "part").select("p_partkey", S.min_free_space(F.concat("p_size", unit)).alias("bytes"))


@query("W13_deployment_order", """
SELECT osname, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY version DESC, idx) AS ordered FROM (SELECT *, 100 - idx * 7 % 11 AS version
    FROM deployments) GROUP BY 1
""", "deployments")
def deployment_order(spark: SparkSession, sf: str) -> DataFrame:
    """Boot entries by version, the highest first, and then as they were; the version comes from each entry's text."""
    entry = F.concat(F.lit("title x\nversion "), (F.lit(100) - F.col("idx") * 7 % 11).cast("string"), F.lit("\nlinux /k"))
    rows = P.deployments(spark, sf).withColumn("version", F.regexp_extract(entry, r"(?m)^version\s+([0-9]+)", 1).cast("int"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("version")).alias("v"), "idx")))
    return rows.groupBy("osname").agg(order.alias("l")).select("osname", F.array_join(F.transform("l", lambda x: x["idx"].cast("string")), ",").alias("ordered"))


@query("SC15_config", "SELECT s_name AS remote, 'https://' || s_name AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'false' ELSE 'true' END AS verify FROM supplier")
def config(spark: SparkSession, sf: str) -> DataFrame:
    """Options of each remote: its own, else the parent store's, else the default."""
    own = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("verify"), F.lit("false"))).otherwise(F.create_map().cast("map<string,string>"))
    parent = F.create_map(F.lit("url"), F.concat(F.lit("https://"), "s_name"))
    get = lambda key, default: F.coalesce(F.try_element_at("own", F.lit(key)), F.try_element_at("parent", F.lit(key)), F.lit(default))
    rows = P.load(spark, sf, "supplier").withColumns({"own": own, "parent": parent})
    return rows.select(F.col("s_name").alias("remote"), get("url", "").alias("url"), get("verify", "true").alias("verify"))
