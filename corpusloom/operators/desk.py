"""The correction desk: saved corrections over a manifest, what is next, progress and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.script import romanised
from corpusloom.functions.text import strip

SAVED = ("transcript", "roman", "status", "notes")
# The columns of the verified export.
EXPORTED = ("id", "clip", "duration", "transcript", "roman", "source_id")


def overlay(manifest: DataFrame, saved: DataFrame) -> DataFrame:
    """The manifest with the saved columns of the rows that have been worked on; an empty status falls back to the manifest's, then to pending."""
    s = saved.select("id", *[F.col(c).alias(f"__{c}") for c in SAVED], F.lit(True).alias("__on"))
    d = manifest.join(s, "id", "left")
    on = F.coalesce("__on", F.lit(False))
    status = F.coalesce(F.when(on, F.nullif(F.col("__status"), F.lit(""))), F.nullif(F.col("status"), F.lit("")), F.lit("pending"))
    d = d.withColumns({c: F.when(on, F.col(f"__{c}")).otherwise(F.col(c)) for c in SAVED if c != "status"} | {"status": status})
    return d.drop("__on", *[f"__{c}" for c in SAVED])


def next_pending(df: DataFrame, order: str, after: int) -> DataFrame:
    """``next``: the first pending row after a place, else the place after it, no further than the last."""
    ahead = F.min(F.when((F.col("status") == "pending") & (F.col(order) > after), F.col(order)))
    return df.agg(F.coalesce(ahead, F.least(F.lit(after + 1), F.max(order))).alias("next"))


def progress(df: DataFrame) -> DataFrame:
    """``n_clips, n_verified, percent, minutes``."""
    done = F.coalesce(F.col("status") == "verified", F.lit(False))
    seconds = F.coalesce(F.sum(F.when(done, F.coalesce("duration", F.lit(0.0)))), F.lit(0.0))
    d = df.agg(F.count("*").alias("n_clips"), F.count_if(done).alias("n_verified"), F.round(seconds / 60.0, 6).alias("minutes"))
    return d.select("n_clips", "n_verified", F.round(100.0 * F.col("n_verified") / F.greatest(F.col("n_clips"), F.lit(1)), 6).alias("percent"), "minutes")


def export_verified(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "verified").select(*EXPORTED)


def may_verify(transcript: Column) -> Column:
    """Whether a row has what marking it verified asks for."""
    return F.coalesce(strip(transcript) != "", F.lit(False))


def followed_roman(transcript: Column, roman: Column, before: Column) -> Column:
    """The roman field follows the transcript until it was edited by hand: while empty or as drafted from the text before."""
    drafted = (F.coalesce(roman, F.lit("")) == "") | (roman == romanised(before))
    return F.when(drafted, romanised(F.coalesce(transcript, F.lit("")))).otherwise(roman)


def clock(seconds: Column) -> Column:
    """Minutes and seconds as m:ss."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
