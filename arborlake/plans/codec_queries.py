"""Queries of the binary codecs, callbacks and chunk joins over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import binary as B
from arborlake.functions import callbacks as C
from arborlake.plans.registry import query
from arborlake.sources import project as P
from arborlake.sources import stores as ST


@query("F12_varint", """
SELECT doc_id, CASE WHEN n_chars < 128 THEN printf('%02X', n_chars) WHEN n_chars < 16384 THEN printf('%02X%02X', n_chars % 128 + 128,
        n_chars // 128) ELSE printf('%02X%02X%02X', n_chars % 128 + 128, n_chars // 128 % 128 + 128, n_chars // 16384) END AS encoded
    FROM documents
""")
def varint(spark: SparkSession, sf: str) -> DataFrame:
    return P.load(spark, sf, "documents").select("doc_id", F.hex(B.varint("n_chars")).alias("encoded"))


@query("F13_crc32")
def crc32(spark: SparkSession, sf: str) -> DataFrame:
    return P.load(spark, sf, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("F15_bloom_build", "SELECT remote, CAST(2048 AS BIGINT) AS bits FROM (SELECT DISTINCT coalesce(remote, '') AS remote FROM refs)", "refs")
def bloom_build(spark: SparkSession, sf: str) -> DataFrame:
    blooms = B.bloom_build(P.refs(spark, sf).withColumn("remote", F.coalesce("remote", F.lit(""))), "remote", "ref_name")
    return blooms.select(F.col("key").alias("remote"), (F.octet_length("bloom") * 8).cast("bigint").alias("bits"))


@query("J14_bloom_semi_join", "SELECT remote, ref_name FROM refs WHERE remote IS NOT NULL", "refs")
def bloom_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Both remotes are asked for every ref; a remote's bloom filter (of 64 KiB) rejects nearly all that it lacks, and what passes is joined exactly."""
    refs = P.refs(spark, sf).select("remote", "ref_name")
    held = refs.filter("remote IS NOT NULL")
    blooms = B.bloom_build(held, "remote", "ref_name", size=1 << 16)
    asked = refs.select("ref_name", F.explode(F.array(F.lit("origin"), F.lit("mirror"))).alias("key")).distinct().join(blooms, "key")
    passed = asked.filter(B.bloom_contains()("bloom", "ref_name")).select(F.col("key").alias("remote"), "ref_name")
    return passed.join(held, ["remote", "ref_name"], "left_semi")


@query("F16_codecs", "SELECT doc_id, true AS deflated, true AS packed, true AS refused FROM documents")
def codecs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw deflate and back, an LZMA part and back, and whether a part that is longer than allowed is refused."""

    @F.pandas_udf("packed boolean, refused boolean")
    def lzma(raw: pd.Series) -> pd.DataFrame:
        out = []
        for x in raw:
            part = B.encode_part(bytes(x), "lzma")
            try:
                B.decode_part(part, len(x) - 1)
                refused = False
            except ValueError:
                refused = True
            out.append((B.decode_part(part) == bytes(x), refused or not x))
        return pd.DataFrame(out, columns=["packed", "refused"])

    raw = F.col("text").cast("binary")
    rows = P.load(spark, sf, "documents").select("doc_id", (B.inflate(B.deflate(raw)) == raw).alias("deflated"), lzma(raw).alias("l"))
    return rows.select("doc_id", "deflated", "l.packed", "l.refused")


@query("F17_binary_diff", "SELECT doc_id, true AS same FROM documents")
def binary_diff(spark: SparkSession, sf: str) -> DataFrame:
    """A patch from each document to an edited copy, applied again."""
    docs = P.load(spark, sf, "documents")
    old, new = F.col("text").cast("binary"), F.concat(F.lit("edited "), F.col("text"), F.lit(" end")).cast("binary")

    @F.pandas_udf("binary")
    def patch(a: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([B.binary_patch(bytes(x), bytes(y)) for x, y in zip(a, p, strict=True)])

    return docs.select("doc_id", (patch(old, B.diff_udf()(old, new)) == new).alias("same"))


def _contents(docs: DataFrame, edit: bool) -> DataFrame:
    """Each document as a file; every fiftieth has a line put into its middle if ``edit``."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), half), F.lit("\nchanged\n"), F.expr("substring(text, length(text) div 2 + 1)"))
    return docs.select(F.col("doc_id").alias("k"), F.when((F.col("doc_id") % 50 == 0) & F.lit(edit), edited).otherwise(F.col("text")).alias("content"))


@query("W12_content_chunks")
def content_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks cut by content; that they cover each file is tested."""
    return B.chunks(_contents(P.load(spark, sf, "documents"), False), "k", "content")


@query("J5_chunk_join")
def chunk_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of edited files found again in the old ones."""
    docs = P.load(spark, sf, "documents")
    return B.match_chunks(B.chunks(_contents(docs, False), "k", "content"), B.chunks(_contents(docs, True), "k", "content"))


@query("F30_key_encodings", "SELECT c_custkey, to_base64(encode(c_name)) AS b64, c_name AS again FROM customer")
def key_encodings(spark: SparkSession, sf: str) -> DataFrame:
    b64 = F.base64(F.col("c_name").cast("binary"))
    return P.load(spark, sf, "customer").select("c_custkey", b64.alias("b64"), F.unbase64(b64).cast("string").alias("again"))


@query("X1_commit_modifier", "SELECT path, mode, 7 AS uid FROM tree_a WHERE NOT (path = 'en' OR starts_with(path, 'en/'))", "tree_a")
def commit_modifier(spark: SparkSession, sf: str) -> DataFrame:
    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(keep=rows["path"] != "en", uid=7)

    return C.commit_modifier(P.tree_a(spark, sf), fn).select("path", "mode", "uid")


@query("X2_xattr_callback", "SELECT path, 'user.a,user.depth' AS names FROM tree_a", "tree_a")
def xattr_callback(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.xattr_callback(P.tree_a(spark, sf), lambda p: [("user.depth", b"%d" % p.count("/")), ("user.a", b"")])
    return rows.select("path", F.array_join(F.transform("xattrs", lambda x: x["name"]), ",").alias("names"))


@query("X3_checkout_filter", "SELECT path FROM tree_a WHERE path NOT LIKE '%5'  AND path NOT LIKE '%5/%'", "tree_a")
def checkout_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.checkout_filter(P.tree_a(spark, sf), lambda p: not p.endswith("5")).select("path")


@query("X4_path_translation", "SELECT replace(path, 'src', 'lib') AS path FROM tree_a WHERE path NOT LIKE 'fr/%'", "tree_a")
def path_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry is renamed by the callback, which leaves out what it gives no name."""
    return C.translate_paths(P.tree_a(spark, sf), lambda p: None if p.startswith("fr/") else p.replace("src", "lib")).select("path")


@query("X6_pluggable_finders", """
SELECT 'config' AS finder, remote, ref_name FROM candidates WHERE priority = 0 UNION ALL SELECT 'override', remote, ref_name FROM candidates
    WHERE priority = 1
""", "candidates")
def pluggable_finders(spark: SparkSession, sf: str) -> DataFrame:
    finders = C.Finders()
    finders.register("config", lambda c: c.filter("priority = 0"))
    finders.register("override", lambda c: c.filter("priority = 1"))
    return finders.find(P.candidates(spark, sf)).select("finder", "remote", "ref_name")


@query("SC12_fetch_status", """
SELECT event_id, CASE WHEN s IN (403, 404, 410) THEN 'not_found' WHEN s = 408 THEN 'timed_out' WHEN s >= 400 THEN 'failed' END AS error, s IN (408, 500, 502, 503,
        504) AS retry
    FROM (SELECT event_id, CAST([200, 404, 408, 500, 403, 503, 304][event_id % 7 + 1] AS INTEGER) AS s FROM events)
""")
def fetch_status(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 408, 500, 403, 503, 304)]), (F.col("event_id") % 7 + 1).cast("int"))
    return P.load(spark, sf, "events").select("event_id", ST.http_error(status).alias("error"), ST.should_retry(status, F.lit("none")).alias("retry"))


@query("SK5_detached_metadata", "SELECT checksum, CASE WHEN turn % 2 = 0 THEN 'signed' ELSE version END AS value FROM commits", "commits")
def detached_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A side record per commit, upserted: here the even turns get a new one."""
    from arborlake.operators.transaction import apply_ref_writes

    commits = P.commits(spark, sf)
    held = commits.select(F.col("checksum").alias("ref_name"), F.col("version").alias("checksum"))
    writes = commits.filter("turn % 2 = 0").select(F.col("checksum").alias("ref_name"), F.lit(1).alias("seq"), F.lit("signed").alias("checksum"))
    return apply_ref_writes(held, writes).select(F.col("ref_name").alias("checksum"), F.col("checksum").alias("value"))


@query("SK15_length_check", "SELECT doc_id, octet_length(encode(text)) = n_chars AS ok FROM documents")
def length_check(spark: SparkSession, sf: str) -> DataFrame:
    """A streamed write whose size isn't the one announced is an error."""
    return P.load(spark, sf, "documents").select("doc_id", (F.octet_length("text") == F.col("n_chars")).alias("ok"))


@query("A14_progress", """
SELECT commit, CAST(sum(archived) AS BIGINT) AS requested, CAST(sum(CASE WHEN archived % 2 = 0 THEN archived ELSE 0 END) AS BIGINT) AS fetched
    FROM sizes GROUP BY 1
""", "sizes")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    return P.sizes(spark, sf).groupBy("commit").agg(F.sum("archived").alias("requested"), F.sum(F.when(F.col("archived") % 2 == 0, F.col("archived")).otherwise(0)).alias("fetched"))


@query("O8_signature_order", "SELECT checksum, turn % 2 = 0 AS valid, ts, 'k' || (conv_id % 3) AS fingerprint FROM commits", "commits")
def signature_order(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of a signature in their fixed order."""
    return P.commits(spark, sf).select("checksum", (F.col("turn") % 2 == 0).alias("valid"), "ts", F.concat(F.lit("k"), F.col("conv_id") % 3).alias("fingerprint"))


@query("H6_reset_ref", "SELECT a.ref_name, b.parent AS checksum FROM refs a JOIN commits b USING (checksum) WHERE b.parent IS NOT NULL", "refs", "commits")
def reset_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Each ref set back to its tip's parent, if that exists."""
    commits = P.commits(spark, sf)
    back = P.refs(spark, sf).join(commits.select("checksum", "parent"), "checksum").filter("parent IS NOT NULL").select("ref_name", F.col("parent").alias("checksum"))
    return back.join(commits.select("checksum"), "checksum", "left_semi").select("ref_name", "checksum")


@query("SC9_tar_import", "SELECT 'usr/etc/' || source || '/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS checksum FROM documents")
def tar_import(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into archives of up to 64, every other copy as a hard link, and read back."""
    import io
    import tarfile

    from arborlake.sources.archive import tar_members

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, seen = io.BytesIO(), {}
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, text in zip(rows["name"], rows["text"], strict=True):
                info = tarfile.TarInfo(name)
                data = text.encode()
                if data in seen:
                    info.type, info.linkname = tarfile.LNKTYPE, seen[data]
                    tar.addfile(info)
                else:
                    seen[data], info.size = name, len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"path": [str(rows["part"].iloc[0])], "content": [out.getvalue()]})

    docs = P.load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 64).alias("part"), F.concat(F.lit("./etc/"), "source", F.lit("/"), "doc_id").alias("name"), "text")
    files = docs.groupBy("part").applyInPandas(pack, "path string, content binary")
    return tar_members(files, usr_etc=True).select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("checksum"))


@query("SC10_folder_import")
def folder_import(spark: SparkSession, sf: str) -> DataFrame:
    """Every file below the folder of the tables, with its size."""
    return ST.folder(spark, sf).select("path", "size")


@query("SC13_metalink", "SELECT s_name AS name, s_suppkey AS size, 'http://mirror' || (s_suppkey % 3) || '/' || s_name AS url FROM supplier")
def metalink_source(spark: SparkSession, sf: str) -> DataFrame:
    """Of each file's mirrors the one of the highest preference."""
    url = lambda host, preference: F.concat(F.lit('<url protocol="http" preference="'), preference, F.lit('">http://mirror'), host, F.lit("/"), "s_name", F.lit("</url>"))
    text = F.concat(
        F.lit('<metalink xmlns="http://www.metalinker.org/"><files><file name="'), "s_name", F.lit('"><size>'), "s_suppkey", F.lit("</size><resources>"), url(F.lit("9"), F.lit("10")), url((F.col("s_suppkey") % 3).cast("string"), F.lit("90")), F.lit("</resources></file></files></metalink>"),
    )
    files = P.load(spark, sf, "supplier").select(F.col("s_name").alias("path"), text.cast("binary").alias("content"))
    return ST.metalink_urls(files).groupBy("name").agg(F.max("size").alias("size"), F.max_by("url", "preference").alias("url"))


@query("F14_siphash")
def siphash(spark: SparkSession, sf: str) -> DataFrame:
    """The bloom hash of every ref name; its reference vector is in the tests."""

    @F.pandas_udf("string")
    def run(name: pd.Series) -> pd.Series:
        return name.map(lambda n: f"{B.siphash24(bytes(16), n.encode()):016x}")

    return P.refs(spark, sf).select("ref_name", run("ref_name").alias("hash"))


@query("SK13_delta_write", """
WITH old AS (SELECT DISTINCT checksum FROM tree_a WHERE type = 'f'), new AS (SELECT checksum, max(size) AS size FROM tree_b
    WHERE type = 'f' AND checksum NOT IN (SELECT checksum FROM old)
    GROUP BY 1) SELECT size > 3000 AS fallback, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM new GROUP BY 1
""", "tree_a", "tree_b")
def delta_write(spark: SparkSession, sf: str) -> DataFrame:
    """What a delta without bases writes: small objects into its parts, large ones as fallbacks."""
    from arborlake.operators import delta as D

    a, b = (t(spark, sf).filter("type = 'f'").select("checksum", "size", "mode", F.element_at(F.split("path", "/"), 2).alias("name")) for t in (P.tree_a, P.tree_b))
    new = b.join(a.select("checksum"), "checksum", "left_anti")
    none = spark.createDataFrame([], "to string, from string, fuzzy boolean")
    planned = D.plan(new, none, a, min_fallback=3000)
    return planned.groupBy((F.col("strategy") == "fallback").alias("fallback")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
