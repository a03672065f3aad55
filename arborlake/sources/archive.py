"""Tar archives: listing for export, reading for import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tar_entries(tree: DataFrame, prefix: str = "") -> DataFrame:
    """(path, entry, target): the first path of each content is a file, further ones are hard links to it.

    The first paths are a grouped minimum, joined back, so that a content that stands everywhere fills no task.
    """
    first = tree.filter("type = 'f'").groupBy("checksum").agg(F.min("path").alias("__first"))
    files = tree.filter("type = 'f'").select("checksum", "path").join(first, "checksum")
    linked = F.col("path") != F.col("__first")
    entries = files.select(F.concat(F.lit(prefix), "path").alias("path"), F.when(linked, "hardlink").otherwise("file").alias("entry"), F.when(linked, F.concat(F.lit(prefix), "__first")).alias("target"))
    others = tree.filter("type <> 'f'")
    kind = F.when(F.col("type") == "d", "dir").otherwise("symlink")
    return entries.unionByName(others.select(F.concat(F.lit(prefix), "path").alias("path"), kind.alias("entry"), F.lit(None).cast("string").alias("target")))


def read_tar(spark, path: str, usr_etc: bool = False) -> DataFrame:
    """The members of the tar files under ``path``; see ``tar_members``."""
    return tar_members(spark.read.format("binaryFile").load(path).select("path", "content"), usr_etc)


def tar_members(files: DataFrame, usr_etc: bool = False) -> DataFrame:
    """(archive, path, type, mode, uid, gid, size, content) of every member of tar files (path, content).

    A hard link has the content of the member it names in its archive, which may
    stand anywhere in it: links are resolved by a join after reading. A broken archive gives the members before the
    fault and a row of type ``fault``, and fails no other.
    """
    import io
    import tarfile
    from collections.abc import Iterable, Iterator

    import pyarrow as pa

    from arborlake.functions.scalars import tar_path

    names = ["archive", "path", "type", "mode", "uid", "gid", "size", "content", "target"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                        for m in tar:
                            kind = "d" if m.isdir() else "l" if m.issym() else "h" if m.islnk() else "f" if m.isfile() else None
                            if kind:
                                body = tar.extractfile(m).read() if kind == "f" else None
                                rows.append((archive, m.name, kind, m.mode, m.uid, m.gid, m.size, body, m.linkname or None))
                except (tarfile.TarError, EOFError, OSError):
                    rows.append((archive, "", "fault", None, None, None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = files.mapInArrow(members, "archive string, path string, type string, mode int, uid bigint, gid bigint, size bigint, content binary, target string")
    rows = rows.withColumns({"path": tar_path(F.col("path"), usr_etc), "target": F.when(F.col("type") == "h", tar_path(F.col("target"), usr_etc)).otherwise(F.col("target"))})
    held = rows.filter("type = 'f'").select("archive", F.col("path").alias("target"), F.col("content").alias("__content"), F.col("size").alias("__size"))
    links = rows.filter("type = 'h'").join(held, ["archive", "target"], "left").withColumns({"type": F.lit("f"), "content": F.col("__content"), "size": F.col("__size")})
    columns = ["archive", "path", "type", "mode", "uid", "gid", "size", "content"]
    return rows.filter("type <> 'h'").select(*columns).unionByName(links.select(*columns))


def write_tar(entries: DataFrame, out: str, timestamp: int = 0) -> None:
    """Writes ``entries`` (path, entry, target, content, mode) as one tar at ``out``, streamed through the driver in path order.

    An archive is one sequential file, so its bytes pass one writer; rows come partition by partition.
    """
    import io
    import tarfile

    kind = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE, "file": tarfile.REGTYPE}
    with tarfile.open(out, "w", format=tarfile.PAX_FORMAT) as tar:
        for r in entries.orderBy("path").toLocalIterator(prefetchPartitions=True):
            info = tarfile.TarInfo(r["path"])
            info.type, info.mode, info.mtime, info.linkname = kind[r["entry"]], (r["mode"] or 0) & 0o7777, timestamp, r["target"] or ""
            body = bytes(r["content"] or b"") if r["entry"] == "file" else b""
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
