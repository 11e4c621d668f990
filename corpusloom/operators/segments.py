"""Time series and windows: log parsing, change points, overlaps and paddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The change of colour that begins a new card, the least length of one, and where in it the frame is taken.
CHANGE, LEAST_SECONDS, FRAME_AT = 6.0, 6.0, 0.6
PAD_BEFORE, PAD_AFTER = 0.25, 0.35


def chroma_samples(lines: DataFrame, group: str = "video_id", order: str = "n") -> DataFrame:
    """``group, t, u, v`` from log lines: a line with a time begins a frame, later ones give its averages; frames that lack one are dropped."""
    number = lambda name: F.expr(f"try_cast(nullif(regexp_extract(line, '{name}[=:] *(-?[0-9.]+)', 1), '') as double)")
    d = lines.select(group, order, number("pts_time").alias("t"), number("UAVG").alias("u"), number("VAVG").alias("v"))
    frame = F.sum(F.col("t").isNotNull().cast("int")).over(Window.partitionBy(group).orderBy(order))
    by = d.withColumn("frame", frame).groupBy(group, "frame")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return by.agg(last("t"), last("u"), last("v")).filter("t IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL").select(group, "t", "u", "v")


def change_points(df: DataFrame, group: str, order: list[str], time: str, signals: list[str], threshold: float = CHANGE) -> DataFrame:
    """``group, seg, seg_start, seg_end, n_samples``: a segment ends where the signals' summed steps from one sample to the next exceed the threshold.

    Each sample is held against the one before, so a slow drift ends nothing.
    """
    w = Window.partitionBy(group).orderBy(*order)
    step = sum((F.abs(F.col(s) - F.lag(s).over(w)) for s in signals[1:]), F.abs(F.col(signals[0]) - F.lag(signals[0]).over(w)))
    d = df.withColumn("__new", F.coalesce(step > threshold, F.lit(False)).cast("long"))
    d = d.withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(group, "seg").agg(F.min(time).alias("seg_start"), F.max(time).alias("seg_end"), F.count("*").alias("n_samples"))


def frame_time(start: Column, end: Column) -> Column:
    return start + FRAME_AT * (end - start)


def padded(start: Column, end: Column) -> tuple[Column, Column]:
    """A little before, not below 0, and a little more after."""
    return F.greatest(F.lit(0.0), start - PAD_BEFORE), end + PAD_AFTER


def _level(length: Column, slot: float) -> Column:
    """The first level whose slots are as wide as the length."""
    return F.greatest(F.lit(0), F.ceil(F.log2(length / slot)).cast("int"))


def overlapping(windows: DataFrame, spans: DataFrame, group: str, slot: float) -> DataFrame:
    """``group, w, n, ids``: for each window ``group, w, ws, we`` the spans ``group, id, ord, cs, ce`` that overlap it, in order.

    Windows without any are kept with an empty array; touching isn't overlapping; null bounds overlap
    nothing. Each interval has a level, by its length, at whose time slots (``slot`` seconds, doubled
    from level to level) it lies in two at most; it also stands in the slots of all levels above up
    to the longest interval's, so one of absurd length costs no more rows than any other. Slots
    join with the group as equal keys, so a group with many spans is no single task; a pair is
    taken at the higher of both levels, in the slot in which the later of both begins.
    """
    wide = lambda level: F.lit(float(slot)) * F.pow(F.lit(2.0), level)
    a, b = windows.filter(F.col("we") > F.col("ws")), spans.filter(F.col("ce") > F.col("cs"))
    a = a.withColumn("__l", _level(F.col("we") - F.col("ws"), slot))
    b = b.withColumn("__l", _level(F.col("ce") - F.col("cs"), slot))
    top = max(d.agg(F.max("__l")).first()[0] or 0 for d in (a, b))
    slots = lambda s, e: F.explode(F.transform(F.sequence(F.col("__l"), F.lit(top)), lambda x: F.struct(x.alias("level"), F.array_distinct(F.array(F.floor(s / wide(x)), F.floor(e / wide(x)))).alias("ks"))))
    a = a.withColumn("__x", slots(F.col("ws"), F.col("we"))).withColumn("__k", F.explode("__x.ks")).withColumn("__al", F.col("__l"))
    b = b.withColumn("__x", slots(F.col("cs"), F.col("ce"))).withColumn("__k", F.explode("__x.ks")).withColumn("__bl", F.col("__l")).withColumnRenamed(group, "__g")
    met = (F.col(group) == F.col("__g")) & (a["__x.level"] == b["__x.level"]) & (a["__k"] == b["__k"])
    once = (a["__x.level"] == F.greatest("__al", "__bl")) & (a["__k"] == F.floor(F.greatest("ws", "cs") / wide(a["__x.level"])))
    hit = met & (F.col("cs") < F.col("we")) & (F.col("ce") > F.col("ws")) & once
    pairs = a.join(b, hit).groupBy(group, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    out = windows.select(group, "w").join(pairs, [group, "w"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return out.select(group, "w", F.size("ids").alias("n"), "ids")
