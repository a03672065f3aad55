"""Queries over the records of a store as bytes: they are written from the projections, read back, hashed, verified and applied."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import binary as B
from arborlake.functions import callbacks as C
from arborlake.functions import ed25519
from arborlake.functions import records as R
from arborlake.functions import scalars as S
from arborlake.operators import refs as refs_of
from arborlake.operators import verify as V
from arborlake.plans.registry import query
from arborlake.sources import project as P


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def _commit_records(spark: SparkSession, sf: str, rebase: Column | None = None) -> DataFrame:
    """The commits with their ``record``."""
    commits = P.commits(spark, sf)
    return commits.withColumn("record", R.commit_record("parent", "subject", _text(""), "ts", "root_tree", "root_meta", "version", _text() if rebase is None else rebase))


# Commits and directories.

_ENDS = "[rt_end, b_end, s_end, p, p, 0]"
_COMMIT = f"""SELECT ref, sha256(unhex(parent_hex || hex(encode(subject)) || '00' || '00' || repeat('00', t_at - b_end) || printf('%016x', ts) || root_tree || root_meta
    || array_to_string(list_transform({_ENDS}, lambda e: CASE WHEN t_at + 78 < 256 THEN printf('%02x', e) ELSE printf('%02x%02x', e % 256, e // 256) END), ''))) AS id
FROM (SELECT *, b_end + (8 - b_end % 8) % 8 AS t_at, b_end + (8 - b_end % 8) % 8 + 40 AS rt_end FROM (SELECT *, s_end + 1 AS b_end FROM (SELECT *, p + octet_length(encode(subject)) + 1 AS s_end
    FROM (SELECT ref, ts, root_tree, root_meta, coalesce(parent, '') AS parent_hex, CASE WHEN parent IS NULL THEN 0 ELSE 32 END AS p, coalesce(subject, '') AS subject FROM commits))))"""


@query("SK4_commit_write", _COMMIT, "commits")
def commit_write(spark: SparkSession, sf: str) -> DataFrame:
    """The id of a commit without metadata is the hash of its record."""
    record = R.commit_record("parent", "subject", _text(""), "ts", "root_tree", "root_meta", _text(), _text())
    return P.commits(spark, sf).select("ref", F.sha2(record, 256).alias("id"))


@query("SC8_commit_root", "SELECT r.ref_name, c.root_tree, c.root_meta, c.version FROM refs r JOIN commits c USING (checksum)", "refs", "commits")
def commit_root(spark: SparkSession, sf: str) -> DataFrame:
    """The root of each ref's commit, read from the commit's record."""
    read = P.refs(spark, sf).select("ref_name", "checksum").join(_commit_records(spark, sf).select("checksum", "record"), "checksum").withColumn("c", R.commit_of("record"))
    return read.select("ref_name", "c.root_tree", "c.root_meta", "c.version")


@query("SC4_metadata_load", """
SELECT path, CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, CAST(mode AS BIGINT) AS mode, CAST(12 AS BIGINT) AS size FROM tree_b
    WHERE type = 'd'
""", "tree_b")
def metadata_load(spark: SparkSession, sf: str) -> DataFrame:
    """Directory metadata, found by its hash and read from its record; a record is stored once."""
    dirs = P.tree_b(spark, sf).filter("type = 'd'").select("path", "checksum", "uid", "gid", "mode")
    store = dirs.select(R.dirmeta_record("uid", "gid", "mode").alias("record")).distinct().select(F.sha2("record", 256).alias("checksum"), "record", F.octet_length("record").cast("bigint").alias("size"))
    read = dirs.select("path", "checksum").join(store, "checksum").withColumn("m", R.dirmeta_of("record"))
    return read.select("path", "m.uid", "m.gid", "m.mode", "size")


@query("SC16_size_index", """
SELECT commit, count(*) AS n, CAST(sum(archived) AS BIGINT) AS archived, CAST(sum(unpacked) AS BIGINT) AS unpacked, min(sha256(checksum)) AS first
    FROM sizes GROUP BY 1
""", "sizes")
def size_index(spark: SparkSession, sf: str) -> DataFrame:
    """A commit's size index, written as entries and read from them."""
    entry = F.concat(F.unhex(F.sha2("checksum", 256)), B.varint("archived"), B.varint("unpacked"), F.unhex(F.format_string("%02x", F.col("objtype"))))
    read = P.sizes(spark, sf).select("commit", entry.alias("entry")).select("commit", B.size_entry("entry").alias("e"))
    total = lambda f: F.sum(F.col(f"e.{f}")).cast("bigint").alias(f)
    return read.groupBy("commit").agg(F.count("*").alias("n"), total("archived"), total("unpacked"), F.min("e.checksum").alias("first"))


# Content.

_PLAIN = "sha256(unhex('0000001200000000' || '0000000000000000' || printf('%08x', 33188) || '00000000' || '0011') || encode({}))"


def _archived(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, record): each document as an archived content object."""
    docs = P.load(spark, sf, "documents").select("doc_id", "text")
    zero, mode = F.lit(0), F.lit(0o100644)
    return docs.withColumn("record", R.archive_record(zero, zero, mode, _text(""), F.col("text").cast("binary")))


@query("SC6_content_load", f"SELECT doc_id, text, CAST(octet_length(encode(text)) AS BIGINT) AS size, {_PLAIN.format('text')} AS checksum FROM documents")
def content_load(spark: SparkSession, sf: str) -> DataFrame:
    """Every content object read from its archived form: header, size, content and name."""
    read = _archived(spark, sf).select("doc_id", R.archive_of("record").alias("o"))
    return read.select("doc_id", F.col("o.content").cast("string").alias("text"), F.octet_length("o.content").cast("bigint").alias("size"), "o.checksum")


@query("SK17_archive_stream", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, true AS same FROM documents")
def archive_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an archive stream, header and deflated content, and whether it reads back as itself."""
    read = _archived(spark, sf).withColumn("o", R.archive_of("record"))
    same = F.col("o.fault").isNull() & (F.col("o.content") == F.col("text").cast("binary")) & (F.octet_length("record") > 34)
    return read.select("doc_id", F.octet_length("text").cast("bigint").alias("size"), same.alias("same"))


def _fsck(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ok): stored objects, some of them damaged, read and hashed again."""
    docs, doc = P.load(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    zero, mode = F.lit(0), F.lit(0o100644)
    held = F.when(doc % 50 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")).cast("binary")
    record = F.col("record")
    cut = F.when(doc % 100 == 0, F.substring(record, F.lit(1), F.octet_length(record) - 3)).otherwise(record)
    named = docs.select("doc_id", S.content_checksum(zero, zero, mode, F.lit(""), F.col("text")).alias("name"), R.archive_record(zero, zero, mode, _text(""), held).alias("record"))
    return named.withColumn("o", R.archive_of(cut)).select("doc_id", F.coalesce(F.col("o.checksum") == F.col("name"), F.lit(False)).alias("ok"))


@query("G6_fsck", "SELECT doc_id, doc_id % 50 <> 0 AS ok FROM documents")
def fsck(spark: SparkSession, sf: str) -> DataFrame:
    """Every archived object is read, hashed and compared with its name; every fiftieth has other content here, every hundredth is cut off."""
    return _fsck(spark, sf)


@query("A6_fsck_totals", """
SELECT count(*) AS n_objects, count(*) FILTER (doc_id % 50 = 0) AS n_corrupt, (SELECT count(*) FROM commits) AS n_commits, (SELECT count(*)
    FROM commits WHERE partial) AS n_partial FROM documents
""", "commits")
def fsck_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a check of all objects, with the commits that are whole and partial."""
    objects = _fsck(spark, sf).agg(F.count("*").alias("n_objects"), F.count_if(~F.col("ok")).alias("n_corrupt"))
    commits = P.commits(spark, sf).agg(F.count("*"), F.count_if("partial")).first()
    return objects.select("*", F.lit(commits[0]).cast("bigint").alias("n_commits"), F.lit(commits[1]).cast("bigint").alias("n_partial"))


# Summaries and refs.


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return P.commits(spark, sf).withColumn("size", F.octet_length("subject").cast("bigint"))


_SUMMARY = "SELECT collection_id, ref_name, CAST(octet_length(encode(subject)) AS BIGINT) AS size, checksum, ts, version FROM refs JOIN commits USING (checksum)"


@query("A7_summary_build", f"{_SUMMARY} WHERE remote IS NULL", "refs", "commits")
def summary_build(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of the summary of local refs, one row each."""
    return refs_of.summary_rows(P.refs(spark, sf).filter("remote IS NULL"), _sized(spark, sf))


def _summaries(spark: SparkSession, sf: str, by: str) -> DataFrame:
    """(by, record): a summary file for each value of a column of the refs. A summary is one file by its format, so its refs come together."""
    entries = P.refs(spark, sf).join(_sized(spark, sf).select("checksum", "size", "ts", "version"), "checksum")
    entry = F.struct("ref_name", F.coalesce("size", F.lit(0).cast("bigint")).alias("size"), "checksum", "ts", "version")
    return entries.groupBy(by).agg(F.collect_list(entry).alias("entries")).select(by, R.summary_record("entries").alias("record"))


@query("SC14_summary_source", "SELECT remote, ref_name, checksum, ts, version FROM refs JOIN commits USING (checksum) WHERE remote IS NOT NULL", "refs", "commits")
def summary_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each remote's refs, read from its summary file."""
    read = _summaries(spark, sf, "remote").filter("remote IS NOT NULL").select("remote", R.summary_of("record").alias("s"))
    return read.select("remote", F.explode("s.refs").alias("r")).select("remote", "r.ref_name", "r.checksum", "r.ts", "r.version")


@query("SK11_summary_write", """
SELECT coalesce(collection_id, '') AS collection_id, count(*) AS n, sha256(string_agg(ref_name || '=' || checksum, chr(10) ORDER BY ref_name)) AS digest
    FROM refs GROUP BY 1
""", "refs")
def summary_write(spark: SparkSession, sf: str) -> DataFrame:
    """A summary file for each collection; what is read from it is digested in the order in which it stands there."""
    read = _summaries(spark, sf, "collection_id").select("collection_id", R.summary_of("record").alias("s"))
    entries = F.transform("s.refs", lambda r: F.concat(r["ref_name"], F.lit("="), r["checksum"]))
    return read.select(F.coalesce("collection_id", F.lit("")).alias("collection_id"), F.size("s.refs").cast("bigint").alias("n"), F.sha2(F.array_join(entries, "\n"), 256).alias("digest"))


@query("O4_collection_ref_order", "SELECT coalesce(collection_id, '') AS collection_id, ref_name FROM refs", "refs")
def collection_ref_order(spark: SparkSession, sf: str) -> DataFrame:
    """Collection refs in order: by collection, those without one first, then by name."""
    ordered = P.refs(spark, sf).orderBy(F.col("collection_id").asc_nulls_first(), "ref_name")
    return ordered.select(F.coalesce("collection_id", F.lit("")).alias("collection_id"), "ref_name")


@query("J18_keyring_match", """
SELECT 'org.example.C' || w.c AS collection_id, w.ref_name, min(r.s_name) AS remote FROM (SELECT DISTINCT ref_name, conv_id % 9 AS c
    FROM (SELECT ref_name, CAST(split_part(ref_name, '/', 3) AS BIGINT) AS conv_id FROM refs)) w LEFT
    JOIN supplier r ON r.s_suppkey % 7 = w.c AND r.s_suppkey % 3 <> 0 GROUP BY 1, 2
""", "refs")
def keyring_match(spark: SparkSession, sf: str) -> DataFrame:
    """The remote that is trusted for each collection ref: of the same collection, with a keyring, the first by name."""
    conv = F.element_at(F.split("ref_name", "/"), 3).cast("bigint")
    wanted = P.refs(spark, sf).select(F.concat(F.lit("org.example.C"), conv % 9).alias("collection_id"), "ref_name").distinct()
    remotes = P.load(spark, sf, "supplier").select(F.col("s_name").alias("remote"), F.concat(F.lit("org.example.C"), F.col("s_suppkey") % 7).alias("collection_id"), (F.col("s_suppkey") % 3 != 0).alias("keyring"))
    return refs_of.match_collections(wanted, remotes)


@query("G9_end_of_life", """
WITH RECURSIVE s AS (SELECT ref_name, CAST(split_part(ref_name, '/', 3) AS BIGINT) AS c FROM refs), e AS (SELECT a.ref_name, b.ref_name AS nxt FROM s a JOIN s b ON b.c = a.c + 1 WHERE a.c % 6 < 3),
w AS (SELECT ref_name AS ref, ref_name AS target, 0 AS n FROM s UNION ALL SELECT w.ref, e.nxt, n + 1 FROM w JOIN e ON e.ref_name = w.target)
SELECT ref, arg_max(target, n) AS target FROM w GROUP BY ref""", "refs")
def end_of_life(spark: SparkSession, sf: str) -> DataFrame:
    """A ref whose commit's metadata names a successor is followed to the end of the chain."""
    conv = F.col("conv_id")
    successor = F.when(conv % 6 < 3, F.concat(F.lit("chat/"), (conv + 1) % 10, F.lit("/"), conv + 1))
    tips = P.refs(spark, sf).select(F.col("ref_name").alias("ref"), "checksum")
    named = tips.join(_commit_records(spark, sf, successor).select("checksum", "record"), "checksum").select("ref", R.commit_of("record").alias("c"))
    return refs_of.follow(named.select("ref", F.col("c.rebase").alias("next")))


# Signatures.


def _seed(key: str) -> bytes:
    return hashlib.sha256(key.encode()).digest()


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    """(commit, conv_id, key_id, ok, revoked): two signatures over each commit's record, verified; key k2 is revoked, and a third of the branches is signed for another record."""
    keys = spark.createDataFrame([(k, ed25519.public_key(_seed(k)), k == "k2") for k in ("k0", "k1", "k2")], "key_id string, key binary, revoked boolean")

    @F.pandas_udf("binary")
    def signed(key: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([ed25519.sign(_seed(k), bytes(d)) for k, d in zip(key, data, strict=True)])

    name = lambda k: F.concat(F.lit("k"), k)
    commits = _commit_records(spark, sf).withColumn("said", F.when(F.col("conv_id") % 3 == 0, F.concat("record", F.unhex(F.lit("00")))).otherwise(F.col("record")))
    each = commits.select(F.col("checksum").alias("commit"), "conv_id", "record", "said", F.explode(F.array(name(F.col("turn") % 3), name((F.col("turn") + 1) % 3))).alias("key_id"))
    # Milliseconds a signature and few bytes: dealt by number, as sizes say nothing of the work.
    each = each.repartition(2 * spark.sparkContext.defaultParallelism)
    ok = C.Signers().verifier("ed25519")("key", "record", "signature")
    return each.withColumn("signature", signed("key_id", "said")).join(F.broadcast(keys), "key_id").select("commit", "conv_id", "key_id", ok.alias("ok"), "revoked")


@query("V1_signature_any_of", "SELECT checksum AS commit, bool_or(conv_id % 3 <> 0 AND k < 2) AS valid FROM (SELECT checksum, conv_id, unnest([turn % 3, (turn + 1) % 3]) AS k FROM commits) GROUP BY 1", "commits")
def signature_any_of(spark: SparkSession, sf: str) -> DataFrame:
    """A commit is trusted if any signature over its record verifies by a key that isn't revoked."""
    return V.any_valid(_signatures(spark, sf))


_SIGNED = "SELECT checksum, conv_id, conv_id % 3 <> 0 AS ok, unnest([turn % 3, (turn + 1) % 3]) AS k FROM commits"


@query("V3_signature_results", f"SELECT conv_id, count(*) AS n, count(*) FILTER (ok) AS n_verified, count(*) FILTER (ok AND k = 2) AS n_revoked, count(*) FILTER (ok AND k < 2) AS n_valid, count(*) FILTER (k = 1) AS n_key FROM ({_SIGNED}) GROUP BY 1", "commits")
def signature_results(spark: SparkSession, sf: str) -> DataFrame:
    """The signatures of each branch after they were verified: those that do, by a revoked key or a valid one, and those by the key whose id ends in 1."""
    ok, revoked = F.col("ok"), F.col("revoked")
    counts = F.count_if(ok).alias("n_verified"), F.count_if(ok & revoked).alias("n_revoked"), F.count_if(ok & ~revoked).alias("n_valid"), F.count_if(F.col("key_id").endswith("1")).alias("n_key")
    return _signatures(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), *counts)


@query("X5_pluggable_signers", "SELECT c_custkey, c_custkey % 2 = 0 AS dummy, c_custkey % 3 = 0 AS own FROM customer")
def pluggable_signers(spark: SparkSession, sf: str) -> DataFrame:
    """Verifiers by name: the one that compares texts, and one that a user registers (a keyed hash)."""
    signers = C.Signers()
    signers.register("keyed", lambda key, data, signature: hashlib.blake2b(data, key=key).digest() == signature)

    @F.pandas_udf("binary")
    def keyed(key: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(bytes(d), key=bytes(k)).digest() for k, d in zip(key, data, strict=True)])

    key, data, n = F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary"), F.col("c_custkey")
    text = F.when(n % 2 == 0, key).otherwise(F.lit("x").cast("binary"))
    said = keyed(key, F.when(n % 3 == 0, data).otherwise(F.lit("other").cast("binary")))
    return P.load(spark, sf, "customer").select("c_custkey", signers.verifier("dummy")(key, data, text).alias("dummy"), signers.verifier("keyed")(key, data, said).alias("own"))


# Deltas.


def _program(new: bytes, patched: bool, source: bytes) -> tuple[bytes, bytes]:
    """(byte code, payload) that make ``head`` and the first half of a source, and then ``head`` by itself."""
    name = hashlib.sha256(source).digest()
    payload = name + b"head"
    if patched:
        patch = B.binary_diff(source, new)
        ops = [("open", len(new)), ("set_source", 0), ("patch", len(payload), len(patch)), ("unset_source",), ("close",), ("open_splice_close", 32, 4)]
        return B.write_operations(ops), payload + patch
    ops = [("open", len(new)), ("write", 32, 4), ("set_source", 0), ("write", 0, len(source) // 2), ("unset_source",), ("close",), ("open_splice_close", 32, 4)]
    return B.write_operations(ops), payload


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, old, patched, part): a delta part for each document, from it to the half of it behind a head; every third by a binary patch."""
    docs = P.load(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("old"), (F.col("doc_id") % 3 == 1).alias("patched"))

    @F.pandas_udf("binary")
    def made(old: pd.Series, patched: pd.Series) -> pd.Series:
        out = []
        for x, p in zip(old, patched, strict=True):
            x = bytes(x)
            code, payload = _program(b"head" + x[: len(x) // 2], p, x)
            out.append(B.part_bytes([(0, 0, 0o100644)], payload, code, "none"))
        return pd.Series(out)

    return docs.withColumn("part", made("old", "patched"))


@query("D4_delta_interpreter", "SELECT doc_id, sha256(encode('head') || encode(text)[1:octet_length(encode(text)) // 2]) AS first, sha256('head') AS second FROM documents")
def delta_interpreter(spark: SparkSession, sf: str) -> DataFrame:
    """The objects that each part's byte code makes, from its payload and from a source object."""

    @F.pandas_udf("array<string>")
    def run(old: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for x, p in zip(old, part, strict=True):
            x = bytes(x)
            _, _, payload, code = B.read_part(bytes(p))
            out.append([hashlib.sha256(o).hexdigest() for o in B.run_part(code, payload, {hashlib.sha256(x).hexdigest(): x})])
        return pd.Series(out)

    made = _parts(spark, sf).select("doc_id", run("old", "part").alias("made"))
    return made.select("doc_id", F.get("made", F.lit(0)).alias("first"), F.get("made", F.lit(1)).alias("second"))


@query("A5_delta_dump", """
SELECT doc_id % 7 AS part, CAST(sum(CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 2 END) AS BIGINT) AS n_write,
        CAST(sum(CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_patch, count(*) AS n_splice, count(*) AS n_open
    FROM documents GROUP BY 1
""")
def delta_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The operations of deltas by kind, counted from their byte code."""

    @F.pandas_udf("array<string>")
    def kinds(part: pd.Series) -> pd.Series:
        return part.map(lambda p: [op for op, *_ in B.read_operations(B.read_part(bytes(p))[3])])

    ops = _parts(spark, sf).select((F.col("doc_id") % 7).alias("part"), F.explode(kinds("part")).alias("op"))
    count = lambda op, name: F.count_if(F.col("op") == op).alias(f"n_{name}")
    return ops.groupBy("part").agg(count("write", "write"), count("patch", "patch"), count("open_splice_close", "splice"), count("open", "open"))


@query("D5_apply_parts", "SELECT doc_id, sha256(text) AS checksum, true AS ok FROM documents")
def apply_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas from nothing, of up to 64 documents each: written as one part of splices, read, applied, and each object compared with its name."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        payload, ops, names = bytearray(), [], []
        for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
            data = text.encode()
            ops.append(("open_splice_close", len(payload), len(data)))
            names.append((int(doc), hashlib.sha256(data).hexdigest()))
            payload += data
        part = B.part_bytes([(0, 0, 0o100644)], bytes(payload), B.write_operations(ops))
        return pd.DataFrame({"part": [part], "objects": [[{"doc_id": d, "name": n} for d, n in names]]})

    @F.pandas_udf("array<string>")
    def applied(part: pd.Series) -> pd.Series:
        out = []
        for p in part:
            _, _, payload, code = B.read_part(bytes(p))
            out.append([hashlib.sha256(o).hexdigest() for o in B.run_part(code, payload, {})])
        return pd.Series(out)

    docs = P.load(spark, sf, "documents").select("doc_id", "text")
    parts = docs.groupBy(F.floor(F.col("doc_id") / 64).alias("delta")).applyInPandas(pack, "part binary, objects array<struct<doc_id:bigint,name:string>>")
    each = parts.select("objects", applied("part").alias("made")).select(F.explode(F.arrays_zip("objects", "made")).alias("o"))
    return each.select("o.objects.doc_id", F.col("o.made").alias("checksum"), (F.col("o.made") == F.col("o.objects.name")).alias("ok"))
