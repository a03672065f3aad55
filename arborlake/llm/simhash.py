"""SimHash near-dedup by vantage-point trees.

A document's fingerprint has a bit set where over half of its 3-word shingles'
XXH64 values have it. Fingerprints link at ``RADIUS`` differing bits or fewer.

Partition. Of the two halves of a linked pair one differs in one bit at most.
The Hamming distance over a half is a metric; a tree of vantage points parts the
fingerprints by it: level k sends those farther from point k than the median of
all distances to it one way, the others the other way, and the path is the
shard. By the triangle bound the distances of a pair that differs in one bit of
the half differ by one at most, so the pair parts at a level only where the one
stands at the median and the other just beyond it. Those just beyond are at the
boundary: they are sent both ways. So a linked pair meets in a shard, and no
shard is compared with another one. Points and medians are of the fingerprints
themselves; the number of levels is the logarithm of their number, so shards stay
of one size. A level copies a fingerprint for 1.14, where over all 64 bits (which
asks for a boundary of three bits) it would be 1.26.

Inside a shard a vantage-point tree over all 64 bits splits at the median
distance, and compares across the boundary only what lies within RADIUS of it.

Equal fingerprints are collapsed first. A shard of more than ``SHARD`` rows, as
dense clusters give, is dealt again by the four 16-bit bands of which a linked
pair shares one; a part that is still too large is cut into blocks by a hash, and
each pair of blocks is a unit of work of its own. A unit returns a spanning forest
of its links, one edge a fingerprint at most, never its pairs.

Null and empty texts have no words; no words give fingerprint zero, linked like
any other. A null id is a row like others but never a component's id, unless all
are null. Rows that share an id, repeated rows included, are separate rows. A very
long text is hashed whole, a bounded lot of shingles at a time. An empty table
gives no row. Columns named like the operator's own (``fp``, ``component_id``,
``component``) are no keys: its own take their place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch, slices, text_bytes
from arborlake.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Rows of a shard that are searched as one unit, rows that are compared directly, rows of a shard that the tree aims at, and its levels at most.
SHARD, LEAF, AIM, LEVELS = 8192, 192, 2048, 40
#: Rows of a unit that is compared together with others, without a tree.
FEW = 48
#: Bits of a half, and by how many a linked pair differs in one of its halves at most.
HALF, NEAR = 32, RADIUS // 2
OWN = ("fp", "component_id", "component")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, unsigned. bytes.lower() and bytes.split() know ASCII alone."""
    words = text.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    set_bits = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 15):
        set_bits += np.unpackbits(values[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keys`` (but for those named like the operator's own) and ``fp`` (a signed 64-bit integer) of every row."""
    keys = [k for k in keys if k not in OWN]
    fields = docs.select(*keys).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keys), 4 << 20):
            values = np.array([fingerprint(t) for t in batch.column(len(keys)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(values)], names=[*keys, "fp"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fp bigint"])
    return docs.select(*keys, text_bytes(text_col).alias("__text")).mapInArrow(run, schema)


class Forest:
    """Union-find over the rows of one unit; a root is the least row."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _join(fp: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Links rows of ``left`` to rows of ``right`` (row numbers), in blocks of LEAF."""
    for a in range(0, len(left), LEAF):
        rows = left[a : a + LEAF]
        for b in range(0, len(right), LEAF):
            cols = right[b : b + LEAF]
            near = _distance(fp[rows][:, None], fp[cols][None, :]) <= RADIUS
            if near.any():
                _link_block(near, rows, cols, forest)


def _link_block(near: np.ndarray, rows: np.ndarray, cols: np.ndarray, forest: Forest) -> None:
    """Joins what a block links by at most one edge a row and column: labels spread until they are stable."""
    big = len(rows) + 1
    label = np.where(near.any(axis=1), np.arange(len(rows)), big)
    while True:
        col = np.where(near, label[:, None], big).min(axis=0)
        new = np.minimum(label, np.where(near, col[None, :], big).min(axis=1))
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label < big):
        forest.link(int(rows[i]), int(rows[label[i]]))
    for j in np.flatnonzero(col < big):
        forest.link(int(cols[j]), int(rows[col[j]]))


def vantage_tree(fp: np.ndarray, rows: np.ndarray, forest: Forest) -> None:
    """Links all pairs of ``rows`` within RADIUS: splits by the distance to a vantage point, and compares
    across the boundary only rows within RADIUS of it, since distances to one point differ by no more than the rows do."""
    stack = [(rows, None)]
    while stack:
        left, right = stack.pop()
        if right is None:
            if len(left) <= LEAF:
                _join(fp, left, left, forest)
                continue
            d = _distance(fp[left], fp[left[0]])
            m = int(np.median(d))
            inner, outer = left[d <= m], left[d > m]
            if not len(outer):
                inner, outer = left[d < m], left[d >= m]
            if not len(inner) or not len(outer):
                _join(fp, left, left, forest)
                continue
            edge = max(int(_distance(fp[inner], fp[left[0]]).max()), 0)
            stack += [(inner, None), (outer, None), (left[(d <= edge) & (d > edge - RADIUS)], left[(d > edge) & (d <= edge + RADIUS)])]
        elif len(left) and len(right):
            if min(len(left), len(right)) <= LEAF:
                _join(fp, left, right, forest)
                continue
            # Both sides are split by one more vantage point; its shells are joined where they may meet.
            v = fp[left[len(left) // 2]]
            dl, dr = _distance(fp[left], v), _distance(fp[right], v)
            m = int(np.median(dl))
            if (dl <= m).all() and (dr <= m + RADIUS).all():
                _join(fp, left, right, forest)
                continue
            stack += [(left[dl <= m], right[dr <= m + RADIUS]), (left[dl > m], right[dr > m - RADIUS])]


@dataclass
class Level:
    """A level of the partition of one half: its vantage point, and the distance beyond which a fingerprint goes the outer way."""

    point: int
    median: int


def half_of(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * half).bitwiseAND(F.lit((1 << HALF) - 1))


def plan_levels(distinct: DataFrame, count: int, aim: int = AIM) -> list[list[Level]]:
    """For each half the levels of its tree: points are the fingerprints of the least hashes, and the medians those of all distances to them.

    The driver sees LEVELS fingerprints at most and as many medians.
    """
    depth = min(max(int(np.ceil(np.log2(max(count, 1) / aim))), 0), LEVELS)
    if not depth:
        return [[], []]
    points = [r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(depth).collect()]
    halves = [[(p >> HALF * h) & ((1 << HALF) - 1) for p in points] for h in (0, 1)]
    distances = [F.bit_count(half_of(F.col("fp"), h).bitwiseXOR(F.lit(p))) for h in (0, 1) for p in halves[h]]
    medians = distinct.agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"m{i}") for i, d in enumerate(distances)]).first()
    return [[Level(p, medians[h * depth + k]) for k, p in enumerate(halves[h])] for h in (0, 1)]


def shards_of(fps: DataFrame, levels: list[list[Level]]) -> DataFrame:
    """(shard, fp): each fingerprint in the shard its path through each half's tree leads to, and where it stands at a
    boundary (just beyond a median) also in those of the paths that go the inner way there; the half in the lowest bit."""
    nothing = F.array().cast("array<bigint>")
    found = []
    for half, own in enumerate(levels):
        home, steps = F.lit(half).cast("bigint"), []
        for k, level in enumerate(own):
            d, bit = F.bit_count(half_of(F.col("fp"), half).bitwiseXOR(F.lit(level.point))), F.lit(2 << k).cast("bigint")
            home = home + F.when(d > level.median, bit).otherwise(F.lit(0).cast("bigint"))
            steps.append(F.when(d.between(level.median + 1, level.median + NEAR), bit))
        both_ways = F.filter(F.array(*steps), lambda b: b.isNotNull()) if steps else nothing
        found.append(F.aggregate(both_ways, F.array(home), lambda held, bit: F.concat(held, F.transform(held, lambda s: s - bit))))
    return fps.select("fp", F.explode(F.concat(*found)).alias("shard"))


UNIT = "a bigint, b bigint"


def small_links(fp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (row numbers) of small units that lie one after another; ``ends`` is where each row's unit ends."""
    left, right = [], []
    rows, k = np.arange(len(fp)), 1
    while len(rows := rows[rows + k < ends[rows]]):
        near = rows[_distance(fp[rows], fp[rows + k]) <= RADIUS]
        left.append(near)
        right.append(near + k)
        k += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest_of(units: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links inside each of the whole units (sorted by unit)."""
    cuts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1], [True]]))
    sizes = np.diff(cuts)
    fp, out = fps.view(np.uint64), []
    few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
    held = np.flatnonzero(few)
    own = sizes[(sizes > 1) & (sizes <= FEW)]
    left, right = small_links(fp[held], np.repeat(np.cumsum(own), own))
    if len(left):
        rows, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
        forest = Forest(len(rows))
        for i, j in zip(inverse[: len(left)].tolist(), inverse[len(left) :].tolist(), strict=True):
            forest.link(i, j)
        out.append((fp[held[rows]], forest))
    for start, size in zip(cuts[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        unit = np.unique(fp[start : start + size])
        forest = Forest(len(unit))
        vantage_tree(unit, np.arange(len(unit)), forest)
        out.append((unit, forest))
    a, b = [], []
    for unit, forest in out:
        roots = np.array([forest.root(i) for i in range(len(unit))], np.int64)
        far = np.flatnonzero(unit[roots] != unit)
        a.append(unit[far])
        b.append(unit[roots[far]])
    return (np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def link_units(units: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links inside each unit of ``units`` (unit, fp), whose rows are together and sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            names = np.concatenate([names, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            # The last unit may go on in the next batch.
            whole = int(np.searchsorted(names, names[-1])) if len(names) else 0
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest_of(names[:whole], fps[:whole])], names=["a", "b"])
                names, fps = names[whole:], fps[whole:]
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest_of(names, fps)], names=["a", "b"])

    return units.select("unit", "fp").mapInArrow(run, UNIT)


def finer(shards: DataFrame, shard_rows: int) -> DataFrame:
    """``shards`` with those of too many rows dealt again by four bands of 16 bits, one of which a linked pair shares.

    So a row of a large shard is copied four times and shards get up to 65,536
    times smaller, where cutting into pairs of blocks copies a row once a block.
    """
    large = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("shard", F.lit(True).alias("large"))
    marked = shards.join(large, "shard", "left")
    width = 64 // (RADIUS + 1)
    keys = [F.xxhash64("shard", F.lit(band), F.shiftrightunsigned("fp", band * width).bitwiseAND(F.lit((1 << width) - 1))) for band in range(RADIUS + 1)]
    return marked.select("fp", F.explode(F.when(F.col("large"), F.array(*keys)).otherwise(F.array("shard"))).alias("shard"))


def work_units(shards: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(unit, fp): a shard is one unit, or where it has too many rows, one for each pair of its blocks."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("shard", F.ceil(F.col("n") / shard_rows).alias("blocks"))
    both = shards.join(sizes, "shard", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.least(k, block) * F.col("blocks") + F.greatest(k, block))
    return both.select("fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.col("shard"))).otherwise(F.transform(pairs, lambda p: F.xxhash64("shard", p)))).alias("unit"))


def near_duplicates(fps: DataFrame, scratch: Scratch, id_col: str = "doc_id", shard_rows: int = SHARD, aim: int = AIM) -> DataFrame:
    """Adds to ``fps`` (columns incl. id_col and fp) ``component_id``, the least id reachable over links, and
    ``component``, a fingerprint that names the component even where all its ids are null."""
    distinct = scratch.table(fps.groupBy("fp").agg(F.min(id_col).alias("__least")), "distinct", merge=True)
    shards = scratch.table(shards_of(distinct, plan_levels(distinct, distinct.count(), aim)), "shards", merge=True)
    units = work_units(scratch.table(finer(shards, shard_rows), "finer", merge=True), shard_rows)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = link_units(units.repartition(n, "unit").sortWithinPartitions("unit"))
    roots = components(edges, scratch)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "__least", F.coalesce("root", "fp").alias("__root"))
    least = rooted.groupBy("__root").agg(F.min("__least").alias("component_id"))
    of_fp = scratch.table(rooted.join(least, "__root").select(F.col("fp").alias("__fp"), "component_id", F.col("__root").alias("component")), "of_fp", merge=True)
    for name in ("shards", "finer", "distinct"):
        scratch.drop(name)
    return scratch.merged(fps.join(of_fp, fps["fp"] == of_fp["__fp"], "left").drop("__fp"))


def deduplicate(docs: DataFrame, scratch: Scratch, keys: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(keys, fp, component_id, component) for every row of ``docs``; ``keys`` holds ``id_col``, which isn't named like the operator's own columns."""
    if id_col in OWN:
        raise ValueError(f"the id column must not be named {id_col}")
    return near_duplicates(scratch.table(fingerprints(docs, keys, text_col), "fp"), scratch, id_col)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
