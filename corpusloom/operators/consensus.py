"""Verification by two ears: resumable state, verdicts, review batches and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lexicon import normalise
from corpusloom.functions.metrics import agreement, neighbour_suspect, verdict
from corpusloom.functions.prefix import running_sum

BATCH_SIZE = 40
# What a decision's text may not hold, and columns that only the check needs.
REFUSED = ("latin-remnant", "devanagari-remnant", "slash-alternates")
CHECK_PREFIXES = ("hyp_", "mv_", "lang_", "agreement")


def last_state(log: DataFrame, row_id: str = "id", order: str = "seq") -> DataFrame:
    """The latest row of each id of an append-only log: one aggregation, no sorted window."""
    others = [c for c in log.columns if c != row_id]
    return log.groupBy(row_id).agg(F.max_by(F.struct(*others), order).alias("s")).select(row_id, *[F.col(f"s.{c}").alias(c) for c in others])


def failed(df: DataFrame) -> DataFrame:
    """Rows in which an ear failed; they are asked again."""
    return df.filter((F.coalesce("lang_a", F.lit("")) == "error") | (F.coalesce("lang_b", F.lit("")) == "error"))


def without_failed(df: DataFrame) -> DataFrame:
    """The state as it is kept when failed rows are asked again."""
    return df.filter((F.coalesce("lang_a", F.lit("")) != "error") & (F.coalesce("lang_b", F.lit("")) != "error"))


def pending(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Pending rows that the state doesn't have; joined before any costly call."""
    return manifest.filter(F.col("status") == "pending").join(state.select("id"), "id", "left_anti")


def first_pending(manifest: DataFrame, state: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` pending rows in order: a run over a part of the work; which rows it takes is the feature."""
    return pending(manifest, state).orderBy(*order).limit(limit)


def requeued(state: DataFrame) -> DataFrame:
    """The last state of each id, as it is written again when failed rows are asked again."""
    return without_failed(last_state(state))


def scored(df: DataFrame) -> DataFrame:
    """With ``score`` (to three places), ``suspect`` and ``verdict``, which compares the score as it is."""
    a = agreement(F.col("hyp_a"), F.col("hyp_b"))
    s = neighbour_suspect(F.col("hyp_a"), F.col("hyp_b"), F.col("lang_a"), F.col("lang_b"))
    d = df.withColumns({"__a": a, "suspect": s})
    return d.withColumns({"score": F.round("__a", 3), "verdict": verdict(F.col("__a"), F.col("suspect"), F.col("lang_a"), F.col("lang_b"))}).drop("__a")


def batches(df: DataFrame, verified: DataFrame, order: str = "seq", size: int = BATCH_SIZE) -> DataFrame:
    """``batch, order, id``: rows to be adjudicated that aren't verified yet, ``size`` to a batch in order."""
    todo = df.filter(F.col("mv_verdict") == "adjudicate").join(verified.select("id").distinct(), "id", "left_anti")
    numbered = running_sum(todo.select(order, "id"), F.floor(F.col(order) / 100_000), [order], F.lit(1), "n")
    return numbered.select(F.floor((F.col("n") - 1) / size).cast("long").alias("batch"), order, "id")


def apply_decisions(state: DataFrame, decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Decided rows as they are added to the verified ones: ``id, transcript, status, verified_by, confidence`` and the state's other columns.

    Decisions on unknown or already verified ids, and verified ones whose text the convention refuses,
    add nothing. The last state of an id counts.
    """
    d = decisions.select("id", F.col("transcript").alias("__t"), F.col("status").alias("__s")).join(existing.select("id").distinct(), "id", "left_anti")
    n = d.withColumn("__n", normalise(F.col("__t")))
    bad = F.arrays_overlap("__n.flags", F.array(*[F.lit(x) for x in REFUSED])) | (F.col("__n.text") == "")
    n = n.filter((F.col("__s") == "verified") & ~bad)
    joined = last_state(state).join(n, "id")
    out = joined.withColumns({"transcript": F.col("__n.text"), "status": F.lit("verified"), "verified_by": F.lit("machine-consensus"), "confidence": F.col("agreement")})
    dropped = [c for c in out.columns if c.startswith(CHECK_PREFIXES) or c.startswith("__")]
    return out.drop(*dropped)
