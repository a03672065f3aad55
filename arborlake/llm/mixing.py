"""Mixing sources to target weights: Poisson replication.

A source with share w of the target and n of all N rows has the mean repetition
rate w N / n. Every row draws its number of copies from the Poisson distribution
with that mean, by inverting it at a uniform number that a hash of seed and id
gives, so a rerun (or a lost executor) draws the same. Copies are exploded and
dealt globally by a hash of seed, id and copy.

Everything is built of DataFrame functions. The deal needs no sample of its keys:
hashes are uniform, so partitions are equal ranges of them.

A null source is a source of its own. Rows that share an id (a null id: a text)
draw the same number, each for itself. Empty and very long texts are copied as they
are; an empty table gives no row. Columns named ``replica`` or ``shuffle_key`` are
replaced, others kept. Sources with weight zero or none go. A mean beyond ``PIECE`` is drawn as a sum of equal
parts, so that the distribution can be inverted in doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "11"
#: Default weights: each source's rows to this power.
TEMPERATURE = 0.5
#: The largest mean that is inverted at once, and the rates that may be broadcast (a rate has 64 thresholds a unit of mean at most).
PIECE, BROADCAST_SOURCES = 64.0, 1000
RATE, COPIES, REPLICA, KEY = "__mix_rate", "__mix_copies", "replica", "shuffle_key"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) of 52 hashed bits."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def identity(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far beyond the mean."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): ``weights`` (source, weight) need not add up to 1; None takes each source's rows to the power ``temperature``."""
    counts = docs.groupBy(F.col(source_col).alias("__mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow("n", F.lit(temperature)) if temperature != 0.5 else F.sqrt("n"))
    else:
        given = weights.select(F.col("source").alias("__given"), F.col("weight").cast("double").alias("w")).filter("w > 0")
        weighted = counts.join(given, counts["__mix_source"].eqNullSafe(given["__given"]))
    all_w, all_n = weighted.agg(F.sum("w"), F.sum("n")).first()
    rate = F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n")
    return weighted.select("__mix_source", rate.cast("double").alias(RATE))


def replicate(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """All copies of all rows, in global hash order: the columns of ``docs``, then ``replica`` (from 1) and ``shuffle_key``.

    Columns of ``docs`` with those two names are replaced.
    """
    docs = docs.drop(REPLICA, KEY)
    rate = rates(docs, weights, source_col, temperature)
    pieces = F.greatest(F.ceil(F.col(RATE) * epochs / PIECE), F.lit(1)).cast("int")
    rate = rate.select("__mix_source", pieces.alias("__mix_pieces"), cumulative(F.col(RATE) * F.lit(epochs) / pieces).alias("__mix_cdf"))
    # The rates are one row a source; they are broadcast where a count says that they are few.
    if rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    who = identity(id_col, text_col)
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("__mix_pieces")),
        F.lit(0),
        lambda acc, i: acc + F.size(F.filter("__mix_cdf", lambda c: c <= uniform(F.lit(seed), who, i.cast("string")))),
    )
    out = docs.join(rate, docs[source_col].eqNullSafe(rate["__mix_source"])).withColumn(COPIES, drawn).filter(F.col(COPIES) > 0)
    out = out.withColumn(REPLICA, F.explode(F.sequence(F.lit(1), F.col(COPIES))))
    out = out.withColumn(KEY, F.md5(F.concat_ws(":", F.lit(seed), F.lit("deal"), who, F.col(REPLICA).cast("string"))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(KEY, 1, 8), 16, 10).cast("bigint") * tasks / F.lit(1 << 32)).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], REPLICA, KEY).repartitionById(tasks, place).sortWithinPartitions(KEY)


ORACLE = f"""
WITH RECURSIVE c AS (
    SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source
), r AS (
    SELECT source, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c) / n AS m FROM c
), p AS (
    SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS cum FROM r
    UNION ALL
    SELECT source, m, k + 1, p * m / (k + 1), cum + p * m / (k + 1) FROM p WHERE k + 1 <= ceil(m + 12 * sqrt(m) + 30)
), u AS (
    SELECT *, (CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR) || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents
), n AS (
    SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cum <= u.u) AS copies FROM u
), x AS (
    SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS replica FROM n
)
SELECT *, md5('{SEED}:deal:' || CAST(doc_id AS VARCHAR) || ':' || CAST(replica AS VARCHAR)) AS shuffle_key FROM x
"""
