"""Frozen evaluation sets: whole sources or clips in hash order up to a target of minutes, and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.prefix import running_sum


def stable_rank(name: Column, salt: str) -> Column:
    """The order in which names are taken: the digest of salt and name."""
    return F.sha1(F.concat(F.lit(f"{salt}:"), name).cast("binary"))


def _ranked(units: DataFrame, name: str, salt: str, minutes: str) -> DataFrame:
    ranked = units.withColumn("h", stable_rank(F.col(name), salt))
    return running_sum(ranked, F.substring("h", 1, 3), ["h", name], F.col(minutes), "before", inclusive=False)


def eval_sources(df: DataFrame, target_minutes: float, salt: str = "eval-v1", locked: DataFrame | None = None) -> DataFrame:
    """``source_id, minutes``: the locked sources, and further ones in hash order while the target isn't reached.

    The sums per source are made first, so the running sum is over sources, not rows. A locked source
    that has no rows left adds nothing; the set only grows.
    """
    by = df.groupBy("source_id").agg((F.sum(F.coalesce("duration", F.lit(0.0))) / 60.0).alias("minutes"))
    if locked is None:
        free, have = by, F.lit(0.0)
        taken = _ranked(free, "source_id", salt, "minutes").filter(F.col("before") + have < target_minutes)
        return taken.select("source_id", "minutes")
    held = by.join(locked.select("source_id").distinct(), "source_id", "left_semi")
    base = held.agg(F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("base"))
    free = by.join(locked.select("source_id").distinct(), "source_id", "left_anti")
    taken = _ranked(free, "source_id", salt, "minutes").join(F.broadcast(base)).filter(F.col("before") + F.col("base") < target_minutes)
    return held.select("source_id", "minutes").unionByName(taken.select("source_id", "minutes"))


def eval_clips(df: DataFrame, target_minutes: float, fraction: float = 0.15, salt: str = "eval-v1") -> DataFrame:
    """``id, minutes``: clips in hash order while less than the target and the fraction of all minutes is taken."""
    clips = df.groupBy("id").agg((F.sum(F.coalesce("duration", F.lit(0.0))) / 60.0).alias("minutes"))
    want = clips.agg(F.least(F.lit(float(target_minutes)), F.sum("minutes") * fraction).alias("want"))
    return _ranked(clips, "id", salt, "minutes").join(F.broadcast(want)).filter(F.col("before") < F.col("want")).select("id", "minutes")


def mode(df: DataFrame) -> DataFrame:
    """``n_sources, mode``: source if there are at least two of them, else clip."""
    return df.agg(F.countDistinct("source_id").alias("n_sources")).select("n_sources", F.when(F.col("n_sources") >= 2, "source").otherwise("clip").alias("mode"))


def train_rows(df: DataFrame, held_out: DataFrame, on: str) -> DataFrame:
    """The rows that aren't held out."""
    return df.join(held_out.select(on), on, "left_anti")


def leaks(train: DataFrame, held_out: DataFrame, on: str) -> DataFrame:
    """``n_leaks``: names that are in both; 0 for a sound split."""
    return train.select(on).distinct().join(held_out.select(on).distinct(), on, "left_semi").agg(F.count("*").alias("n_leaks"))


def guard_counts(df: DataFrame, held_out: DataFrame, on: str = "id") -> DataFrame:
    """``n_rows, n_excluded, n_train``: what the guard before training leaves, in one pass."""
    marked = df.join(held_out.select(on).distinct().withColumn("__out", F.lit(True)), on, "left")
    return marked.agg(F.count("*").alias("n_rows"), F.count("__out").alias("n_excluded"), (F.count("*") - F.count("__out")).alias("n_train"))


def resolve_files(df: DataFrame, files: DataFrame, name: str = "clip") -> DataFrame:
    """Rows with ``path``, the file of their name in the first folder that has it (``name, folder_ord, path``)."""
    first = files.groupBy(name).agg(F.min_by("path", "folder_ord").alias("path"))
    return df.join(first, name, "left")


def file_counts(resolved: DataFrame) -> DataFrame:
    """``n_rows, n_found, n_missing``: how many rows of :func:`resolve_files` have a file."""
    return resolved.agg(F.count("*").alias("n_rows"), F.count("path").alias("n_found"), (F.count("*") - F.count("path")).alias("n_missing"))
