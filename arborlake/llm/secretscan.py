"""Secret scans: an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. A ``Ledger`` is two
tables in a folder, appended by numbered runs: ``versions`` says which path (id)
held which blob in which run, ``findings`` which pairs of blob and rule version
have been scanned, with what was found. A run scans only the blobs whose pair the
ledger lacks, once each however many rows hold them, and joins the findings back
to all its paths. A later run over a changed corpus, or with a new rule version,
scans the difference; a run that is repeated under its number replaces itself.

While a text is addressed it is also seen whether it holds any of the marks
without which no rule can match. Only texts that do are moved to be scanned; the
other blobs enter the ledger with no finding.

Null text is the empty blob, which is as clean as an empty one. Rows that share a
text (ties) share its findings; rows that share an id, repeated rows included, are
separate rows. Rules take linear time on very long texts, which are scanned whole.
An empty table gives no row. Only the id and text are read, so further columns,
whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch, slices

RULE_VERSION = "3"
#: Base kinds in the order in which spans that start together are listed; added kinds follow.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "vcs")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END \1PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
VCS = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})")


#: No rule matches a text that holds none of these (in lower case, or as they stand) and no run of 24 hex digits.
LOWER_MARKS, MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key"), ("AKIA", "-----BEGIN ", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")
HEX_MARK = "[0-9a-f]{24}"


def scan(text: str) -> list[tuple[int, str, int]]:
    """The spans (start, kind, end) of a whole text, in code points, by start and then kind.

    A run of AKIA... or hex digits is matched whole, so asking for the least
    length at once finds what matching first and dropping short ones would.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for kind, rule in ((3, PEM), (4, JWT), (5, VCS)):
        found += [(m.start(), kind, m.end()) for m in rule.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


FINDINGS = "blob string, rule_version string, spans array<struct<start:int,kind:string,end:int>>"


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row of ``blobs`` (blob, text): one row a blob, with an empty list where nothing is found."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * len(spans), pa.string()), pa.array(spans, span)], names=["blob", "rule_version", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, FINDINGS)


def marked(text: Column) -> Column:
    """Whether a text can hold a finding."""
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(m)) for m in LOWER_MARKS] + [F.contains(text, F.lit(m)) for m in MARKS]) | text.rlike(HEX_MARK)


def address(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, marked, text) of every row; null text is empty, and the text is null unless it is marked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("blob"), marked(text).alias("marked"), text.alias("text"))
    return rows.withColumn("text", F.when(F.col("marked"), F.col("text")))


class Ledger:
    """The tables ``versions`` (doc_id, blob) and ``findings`` (blob, rule_version, spans) below ``root``, each with the ``run`` that appended a row."""

    def __init__(self, scratch: Scratch, root: str | None = None):
        """``root`` is a folder that all executors share (without one, a folder of ``scratch``, which holds the tables of a run in any case)."""
        self.scratch, self.spark, self.root, self.runs = scratch, scratch.spark, root or f"{scratch.root}/ledger", 0

    def read(self, table: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{table}").withColumn("run", F.col("run").cast("int"))

    def append(self, table: str, rows: DataFrame, run: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{table}/run={run}")

    def known(self, rule_version: str, before: int) -> DataFrame | None:
        """The findings of earlier runs by a rule version."""
        held = self.read("findings")
        return held if held is None else held.filter((F.col("rule_version") == rule_version) & (F.col("run") < before))

    def unseen(self, held: DataFrame, run: int, rule_version: str = RULE_VERSION) -> DataFrame:
        """(blob, rule_version, spans) for each blob of ``held`` (the rows of ``address``) whose pair no earlier run has scanned.

        The pairs are found from ids and addresses alone; then one row's text of each marked one is scanned.
        """
        new = held.groupBy("blob").agg(F.max("marked").alias("marked"), F.min("doc_id").alias("__first"))
        known = self.known(rule_version, run)
        if known is not None:
            new = new.join(known.select("blob"), "blob", "left_anti")
        new = self.scratch.table(new, f"new{self.runs}")
        texts = held.filter("marked").withColumnRenamed("blob", "__blob")
        hot = new.filter("marked")
        hit = texts.join(hot.select("blob", "__first"), (texts["__blob"] == hot["blob"]) & texts["doc_id"].eqNullSafe(hot["__first"]), "left_semi")
        scanned = scan_blobs(hit.select(F.col("__blob").alias("blob"), "text"), rule_version).dropDuplicates(["blob"])
        return scanned.unionByName(new.filter("NOT marked").select("blob", F.lit(rule_version).alias("rule_version"), F.array().cast("array<struct<start:int,kind:string,end:int>>").alias("spans")))

    def scan(self, docs: DataFrame, run: int, rule_version: str = RULE_VERSION) -> DataFrame:
        """Appends what is new in ``docs`` (doc_id, text) and joins the findings to all its rows: (doc_id, blob, spans, run), ``run`` being that which scanned the blob."""
        self.runs += 1
        held = self.scratch.table(address(docs), f"held{self.runs}")
        self.append("versions", held.select("doc_id", "blob"), run)
        self.append("findings", self.unseen(held, run, rule_version), run)
        self.scratch.drop(f"new{self.runs}")
        found = self.read("findings").filter((F.col("rule_version") == rule_version) & (F.col("run") <= run)).select("blob", "spans", "run")
        return held.select("doc_id", "blob").join(found, "blob")


def scan_twice(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Two runs over one ledger: a first snapshot that holds the documents of an even hash, then the whole table, of which only what is new is scanned."""
    ledger = Ledger(scratch)
    ledger.scan(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 2 == 0), 1)
    return ledger.scan(docs, 2)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of a run's rows, and the run that scanned each blob."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.col("run").alias("scanned_in_run"))


def brute_digest(text: str | None) -> tuple[int, int, int, str]:
    """The base digest of one text as the contract words it, for tests."""
    text, found = text or "", []
    for k, rule, keep in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), k, m.end()) for m in re.finditer(rule, text, (re.ASCII | re.IGNORECASE) if k == 0 else 0) if keep(m)]
    joined = ",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()
