"""Overlapping and gapped time intervals: covered periods and the gaps between them.

Two levels, so that an entity with a third of all rows is never one task's work. Intervals are
clipped into time shards of fixed width; equal starts collapse before the shuffle, so a shard
holds at most as many rows as it has milliseconds. Islands are merged inside a shard, and only
one summary row per shard is stitched along the entity's timeline. An interval over many shards
gives its two clipped ends and one run for the whole shards between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import key

SHARD_MS = 3_600_000
#: Seconds whose milliseconds fit into 64 bits with room for a shard.
_FAR_S = 9e15


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves away from zero; null, NaN, infinite and bounds that 64 bits can't hold give null."""
    s = seconds.cast("double")
    return F.when(~F.isnan(s) & (F.abs(s) < _FAR_S), F.round(s * 1000).cast("long"))


def usable(df: DataFrame, entity: str = "source_id", start: str = "start", end: str = "end") -> DataFrame:
    """``e, s, t``: entity key and bounds in milliseconds of the rows that cover something."""
    d = df.select(key(F.col(entity)).alias("e"), milliseconds(F.col(start)).alias("s"), milliseconds(F.col(end)).alias("t"))
    return d.filter(F.col("e").isNotNull() & (F.col("t") > F.col("s")))


def _pieces(d: DataFrame, width: int) -> DataFrame:
    """``e, k, kind, s, t``: clipped pieces (kind 1) of shard k and runs of whole shards (kind 0) that begin with shard k."""
    first, last = F.floor(F.col("s") / width), F.floor((F.col("t") - 1) / width)
    piece = lambda k, kind, s, t: F.struct(k.cast("long").alias("k"), F.lit(kind).alias("kind"), s.cast("long").alias("s"), t.cast("long").alias("t"))
    d = d.withColumns({"a": first, "b": last})
    a, b = F.col("a"), F.col("b")
    head = piece(a, 1, F.col("s"), F.least(F.col("t"), (a + 1) * width))
    tail = F.when(b > a, piece(b, 1, b * width, F.col("t")))
    run = F.when(b > a + 1, piece(a + 1, 0, (a + 1) * width, b * width))
    return d.select("e", F.explode(F.array_compact(F.array(head, tail, run))).alias("x")).select("e", "x.*")


def _stitched(d: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Local pieces with the end of what came before in their shard, and shard summaries with the end of what came before them."""
    rows = _pieces(d, width).groupBy("e", "k", "kind", "s").agg(F.max("t").alias("t"))
    within = Window.partitionBy("e", "k", "kind").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.max("t").over(within))
    shards = local.groupBy("e", "k", "kind").agg(F.min("s").alias("first"), F.max("t").alias("last"))
    along = Window.partitionBy("e").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return local, shards.withColumn("reached", F.max("last").over(along))


def gaps(df: DataFrame, entity: str = "source_id", start: str = "start", end: str = "end", shard_ms: int = SHARD_MS) -> DataFrame:
    """``source_id, gap_start_ms, gap_end_ms``: every stretch between two intervals of an entity that none covers.

    Rows without entity or usable bounds, or whose end isn't after the start (in whole
    milliseconds), are left out. Intervals that touch leave no gap; an entity with one covered
    period, like an empty table, gives no row. Repeated rows and other columns change nothing.
    """
    local, shards = _stitched(usable(df, entity, start, end), shard_ms)
    between = shards.filter(F.col("reached") < F.col("first")).select("e", F.col("reached").alias("g"), F.col("first").alias("h"))
    # A shard that a run covers as a whole has no gaps inside.
    covered = shards.filter((F.col("kind") == 1) & (F.col("reached") >= (F.col("k") + 1) * shard_ms)).select("e", "k")
    inside = local.filter((F.col("kind") == 1) & (F.col("before") < F.col("s"))).join(covered, ["e", "k"], "left_anti")
    # What an earlier shard reaches into this one begins at the shard's edge as a clipped piece, so ends inside are seen locally.
    inside = inside.select("e", F.col("before").alias("g"), F.col("s").alias("h"))
    return between.unionByName(inside).select(F.col("e").alias("source_id"), F.col("g").alias("gap_start_ms"), F.col("h").alias("gap_end_ms"))


def periods(df: DataFrame, entity: str = "source_id", start: str = "start", end: str = "end", shard_ms: int = SHARD_MS) -> DataFrame:
    """``source_id, period_start_ms, period_end_ms``: the continuous covered periods of each entity.

    The periods lie between the gaps; the gap before each is found inside the time shard first and
    along one row per shard for the rest. Rows are left out as in :func:`gaps`.
    """
    found = gaps(df, entity, start, end, shard_ms).withColumn("k", F.floor(F.col("gap_start_ms") / shard_ms))
    edges = usable(df, entity, start, end).groupBy(F.col("e").alias("source_id")).agg(F.min("s").alias("first"), F.max("t").alias("last"))
    local = Window.partitionBy("source_id", "k").orderBy("gap_start_ms")
    along = Window.partitionBy("source_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    shard_ends = found.groupBy("source_id", "k").agg(F.max("gap_end_ms").alias("top")).withColumn("prior", F.max("top").over(along))
    bounded = (
        found.withColumn("prev", F.lag("gap_end_ms").over(local))
        .join(shard_ends.select("source_id", "k", "prior"), ["source_id", "k"])
        .join(edges.select("source_id", "first"), "source_id")
        .select("source_id", F.coalesce("prev", "prior", "first").alias("period_start_ms"), F.col("gap_start_ms").alias("period_end_ms"))
    )
    ends = shard_ends.groupBy("source_id").agg(F.max("top").alias("top"))
    final = edges.join(ends, "source_id", "left").select("source_id", F.coalesce("top", "first").alias("period_start_ms"), F.col("last").alias("period_end_ms"))
    return bounded.unionByName(final)
