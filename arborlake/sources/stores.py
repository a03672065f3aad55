"""Readers of stores, folders, key files and mirror lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.scalars import SUFFIX


def loose_objects(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(checksum, objtype, storage_size[, content]) of a store's loose objects, ``objects/aa/rest.type`` below ``root``.

    Names that aren't 62 hex digits and a known type are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/objects")
    name = r"/objects/([0-9a-f]{2})/([0-9a-f]{62})\.([a-z-]+?)z?$"
    kind = F.regexp_extract("path", name, 3)
    number = F.lit(None).cast("int")
    for k, v in SUFFIX.items():
        number = F.when(kind == v, k).otherwise(number)
    columns = [F.concat(F.regexp_extract("path", name, 1), F.regexp_extract("path", name, 2)).alias("checksum"), number.alias("objtype"), F.col("length").alias("storage_size")]
    return files.select(*columns, *([F.col("content")] if with_content else [])).filter("objtype IS NOT NULL AND checksum <> ''")


def folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def key_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, key, value) of INI files; comments and blank lines go."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    from pyspark.sql import Window

    section = F.last(F.when(F.col("line").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("line", r"\[(.*)\]", 1)), ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    rows = lines.withColumn("section", section).filter(r"line RLIKE '^\\s*[^#\\[\\s][^=]*='")
    return rows.select("file", "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))


def key_list(value: Column) -> Column:
    """A list value, cut at semicolons or commas; empty parts go."""
    return F.filter(F.transform(F.split(value, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def tristate(value: Column) -> Column:
    """true, false or maybe, as yes, no and maybe; null for anything else."""
    v = F.lower(value)
    return F.when(v.isin("true", "yes", "1"), "yes").when(v.isin("false", "no", "0"), "no").when(v == "maybe", "maybe")


def metalink(spark: SparkSession, path: str) -> DataFrame:
    """The links of the metalink files under ``path``; see ``metalink_urls``."""
    return metalink_urls(spark.read.format("binaryFile").load(path).select("path", "content"))


def metalink_urls(texts: DataFrame) -> DataFrame:
    """(file, name, size, sha256, sha512, url, preference, fault) of metalink files (path, content), one row a URL; one row with the fault of a file that is no XML."""
    import xml.etree.ElementTree as ET
    from collections.abc import Iterable, Iterator

    import pyarrow as pa

    names = ["file", "name", "size", "sha256", "sha512", "url", "preference", "fault"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for where, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ns = "{http://www.metalinker.org/}"
                try:
                    files = list(ET.fromstring(text).iter(f"{ns}file"))
                except ET.ParseError as e:
                    rows.append((where, None, None, None, None, None, None, str(e)))
                    continue
                for f in files:
                    sums = {h.get("type"): (h.text or "").strip().lower() for h in f.iter(f"{ns}hash")}
                    size = (f.findtext(f"{ns}size") or "").strip()
                    for u in f.iter(f"{ns}url"):
                        if u.get("protocol") in ("http", "https", "file"):
                            rows.append((where, f.get("name"), int(size) if size.isdecimal() else None, sums.get("sha256"), sums.get("sha512"), (u.text or "").strip(), int(p) if (p := u.get("preference") or "0").isdecimal() else 0, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return texts.mapInArrow(parse, "file string, name string, size bigint, sha256 string, sha512 string, url string, preference int, fault string")


def accept_download(links: DataFrame, got: DataFrame) -> DataFrame:
    """The first download by preference whose size and hash are right; ``got`` is (url, content)."""
    j = links.join(got, "url")
    sound = (F.octet_length("content") == F.col("size")) & F.coalesce(F.sha2("content", 512) == F.col("sha512"), F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    return j.filter(sound).groupBy("file", "name").agg(F.max_by("url", F.struct("preference", "url")).alias("url"))


def should_retry(status: Column, network_error: Column) -> Column:
    """Whether a failed request is worth another try: transient network faults, request timeouts and server errors."""
    return network_error.isin("timed_out", "connection_closed", "partial_input", "host_not_found", "proxy_failed") | status.isin(408, 500, 502, 503, 504)


def http_error(status: Column) -> Column:
    return F.when(status.isin(403, 404, 410), "not_found").when(status == 408, "timed_out").when(status >= 400, "failed")
