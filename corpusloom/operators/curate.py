"""Merging tracks: the training gate, provenance and tier checks, drift audit, two-key dedup and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.lexicon import normalise
from corpusloom.functions.text import filled
from corpusloom.operators.graph import components
from corpusloom.session import checkpoint

# The tiers from most to least trusted, and the prefix of recordings that need no link.
TIERS = ("human", "machine-card", "machine-consensus")
OWN_RECORDING = "selfrec"


def union_tracks(tracks: list[DataFrame]) -> DataFrame:
    """All rows of tracks with differing columns, with ``input_ord``, the track's place in the list."""
    out = tracks[0].withColumn("input_ord", F.lit(0))
    for j, t in enumerate(tracks[1:], 1):
        out = out.unionByName(t.withColumn("input_ord", F.lit(j)), allowMissingColumns=True)
    return out


def trainable(status: str = "status", transcript: str = "transcript") -> Column:
    """Verified and with a transcript."""
    return F.coalesce(F.col(status) == "verified", F.lit(False)) & filled(F.col(transcript))


def tier(verified_by: Column) -> Column:
    """The tier as given; human if missing or empty."""
    return F.when(F.coalesce(verified_by, F.lit("")) == "", "human").otherwise(verified_by)


def rank(tier_name: Column) -> Column:
    r = F.lit(len(TIERS))
    for j, t in enumerate(TIERS):
        r = F.when(tier_name == t, j).otherwise(r)
    return r


def rejection(source_id: str = "source_id", source_url: str = "source_url", verified_by: str = "verified_by") -> Column:
    """Why a row can't be used: no provenance or an unknown tier; null if it can."""
    source, link = F.coalesce(F.col(source_id), F.lit("")), F.coalesce(F.col(source_url), F.lit(""))
    traced = (source != "") & ((link != "") | source.startswith(OWN_RECORDING))
    t = tier(F.col(verified_by))
    return F.when(~traced, "missing-provenance").when(~t.isin(*TIERS), F.concat(F.lit("unknown-tier:"), t))


def accepted(df: DataFrame) -> DataFrame:
    """Rows that pass the gate and the checks, with ``tier``."""
    return df.filter(trainable()).filter(rejection().isNull()).withColumn("tier", tier(F.col("verified_by")))


def drift(df: DataFrame, row_id: str, text: str, variants: dict[str, str] | None = None) -> DataFrame:
    """``row_id, text, normal, flags`` of the rows whose text isn't as the convention has it; nothing is rewritten."""
    n = df.select(row_id, F.col(text).alias("text"), normalise(F.col(text), variants).alias("n"))
    return n.filter((F.col("n.text") != F.coalesce("text", F.lit(""))) | (F.size("n.flags") > 0)).select(row_id, "text", F.col("n.text").alias("normal"), F.col("n.flags").alias("flags"))


def span_keys() -> list[Column]:
    """Source, start and end to a tenth of a second; a missing bound counts as 0."""
    return [F.coalesce(F.col("source_id"), F.lit("")), *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 1) for c in ("start", "end")]]


def dedup_tiered(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per id, then one per span: the best tier, the earliest of equals. Needs ``tier``.

    Two ranked windows, which keep a bounded head of each group before the shuffle.
    """
    ranked = df.withColumn("__r", rank(F.col("tier")))
    by_id = Window.partitionBy("id").orderBy("__r", *order)
    by_span = Window.partitionBy(*[F.col(f"__k{j}") for j in range(3)]).orderBy("__r", *order)
    one = ranked.withColumn("__n", F.row_number().over(by_id)).filter("__n = 1")
    one = one.withColumns({f"__k{j}": k for j, k in enumerate(span_keys())})
    return one.withColumn("__n", F.row_number().over(by_span)).filter("__n = 1").drop("__r", "__n", "__k0", "__k1", "__k2")


def dedup_sequential(df: DataFrame, order: str) -> DataFrame:
    """``order, id`` of the rows that a pass in order keeps, row by row. Needs ``tier``.

    A row takes the slots of its id and of its span if it strictly outranks whoever holds them, and is
    kept if it holds both in the end. This depends on the order, unlike :func:`dedup_tiered`. The pass is
    made per connected component of slots, so an id that several sources share is one slot. Rows without an id share one.
    """
    id_slot, span_slot = F.xxhash64(F.lit("id"), F.col("id").isNull(), "id"), F.xxhash64(F.lit("span"), *span_keys())
    slim = checkpoint(df.select(F.col(order).alias("o"), "id", id_slot.alias("i"), span_slot.alias("p"), rank(F.col("tier")).alias("rank")))
    group = components(slim.select("i", "p").distinct(), "i", "p")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        holders: dict[int, tuple[int, int]] = {}
        rows = list(pdf.sort_values("o")[["o", "id", "i", "p", "rank"]].itertuples(index=False))
        for r in rows:
            if all(k not in holders or r.rank < holders[k][0] for k in (r.i, r.p)):
                holders |= {k: (r.rank, r.o) for k in (r.i, r.p)}
        kept = [(r.o, r.id) for r in rows if holders.get(r.i, (0, None))[1] == r.o == holders.get(r.p, (0, None))[1]]
        return pd.DataFrame({order: [o for o, _ in kept], "id": [i for _, i in kept]})

    return slim.join(group.withColumnRenamed("node", "i"), "i").groupBy("component").applyInPandas(fold, f"{order} long, id string")


def minutes(duration: str = "duration") -> Column:
    """Summed minutes to six places; null counts as 0."""
    return F.round(F.sum(F.coalesce(F.col(duration), F.lit(0.0))) / 60.0, 6)


def minutes_by_source_tier(df: DataFrame) -> DataFrame:
    """``source_id, tier, minutes, n_rows`` of the rows that can be used."""
    return accepted(df).groupBy("source_id", "tier").agg(minutes().alias("minutes"), F.count("*").alias("n_rows"))
