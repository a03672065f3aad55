"""Writes to a store: staged objects, refs, deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_objects(objects: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of ``objects``, and a tombstone (checksum) for each deleted one that was there."""
    return objects.join(gone, "checksum", "left_anti"), objects.select("checksum").join(gone, "checksum", "left_semi").distinct()


def apply_ref_writes(refs: DataFrame | None, writes: DataFrame) -> DataFrame:
    """(ref_name, checksum) after ``writes`` (ref_name, seq, checksum): the last write of a ref counts, null deletes it."""
    last = writes.groupBy("ref_name").agg(F.max_by("checksum", "seq").alias("checksum"))
    kept = last.filter("checksum IS NOT NULL")
    if refs is None:
        return kept
    return refs.select("ref_name", "checksum").join(last.select("ref_name"), "ref_name", "left_anti").unionByName(kept)


class StoreWriter:
    """Appends to a store of Parquet tables: objects become visible before the refs that name them.

    ``objects`` is insert-if-absent by checksum, a folder for each transaction.
    ``refs`` is written anew to a numbered version, and the last version that is
    whole (its success marker is written last) counts, so a reader sees the refs
    before or after a commit and a crash leaves them as they were. A version is
    claimed by creating a file that doesn't exist, so two writers don't share one.
    A transaction that is repeated under its name writes nothing twice.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _versions(self) -> list[str]:
        """The names of the whole versions of the refs, in order."""
        fs, p = self._fs(f"{self.root}/refs")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if self._exists(f"{self.root}/refs/{n}/_SUCCESS")]

    def objects(self) -> DataFrame | None:
        path = f"{self.root}/objects"
        return self.spark.read.parquet(path).drop("txn") if self._exists(path) else None

    def refs(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/refs/{versions[-1]}") if versions else None

    def _claim(self, txn: str) -> str:
        """The name of the next version, claimed for a transaction."""
        while True:
            held = self._versions()
            number = int(held[-1].split("-")[0]) + 1 if held else 1
            fs, p = self._fs(f"{self.root}/claims/{number:08d}")
            if fs.createNewFile(p):
                return f"{number:08d}-{txn}"
            if not any(int(v.split("-")[0]) >= number for v in self._versions()):
                raise RuntimeError(f"version {number} of the refs is being written; if its writer has ended, delete {p.toString()}")

    def commit(self, new_objects: DataFrame, ref_writes: DataFrame, txn: str | None = None) -> int:
        """Inserts the objects (with a ``checksum``) that are new, then publishes the refs; the number inserted."""
        txn = txn or uuid.uuid4().hex
        own = f"{self.root}/objects/txn={txn}"
        if any(v.endswith(f"-{txn}") for v in self._versions()):
            return self.spark.read.parquet(own).count()
        fresh = new_objects.dropDuplicates(["checksum"])
        held = self.objects()
        if held is not None:
            fresh = fresh.join(held.select("checksum"), "checksum", "left_anti")
        if not self._exists(f"{own}/_SUCCESS"):
            # Written aside and renamed, as a folder that is being read can't be written.
            stage = f"{self.root}/stage-{uuid.uuid4().hex}"
            fresh.write.parquet(stage)
            fs, p = self._fs(stage)
            fs.mkdirs(self._fs(f"{self.root}/objects")[1])
            fs.delete(self._fs(own)[1], True)
            fs.rename(p, self._fs(own)[1])
        version = self._claim(txn)
        apply_ref_writes(self.refs(), ref_writes).write.parquet(f"{self.root}/refs/{version}")
        return self.spark.read.parquet(own).count()
