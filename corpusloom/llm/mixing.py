"""Mixing sources to target weights: systematic sampling of expected copies, settled to the planned size.

Within a source the documents are ordered by length, longest first; the running sum of their
expected copies starts at a random offset, and a copy is due for every whole number it crosses.
Documents of one length are alike for that sum, so it runs over the lengths of a source, never over
its documents, and what is due to a length is then spread over its documents by hash. As lengths
have a heavy tail, a last pass over the same lengths adds or takes back copies until less is open
than any copy that could still be added.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import key
from corpusloom.session import checkpoint

#: Documents of one length that are numbered together; more are hashed into as many parts as this needs.
PART_ROWS = 20_000
_PLAN = "source string, target_share double, planned_share double, max_repeats int, tokens double, copies double"


def _plan(targets: list, sums: dict, total: float | None, fill: bool) -> list[tuple]:
    """Expected copies per source, as the columns of ``_PLAN``.

    Without ``total``, it is the largest at which every share can be met; with ``fill``, all tokens
    of the named sources. What a source can't give at its repeats goes to the others by share.
    """
    live = {s: (w, m) for s, w, m in targets if w and w > 0 and m and m > 0 and sums.get(s, 0) > 0}
    weight = sum(w for w, _ in live.values())
    if fill and total is None:
        total = float(sum(sums[s] for s in live))
    elif total is None:
        total = min((m * sums[s] * weight / w for s, (w, m) in live.items()), default=0.0)
    copies, left, open_ = {}, total, dict(live)
    while open_:
        weight = sum(w for w, _ in open_.values())
        over = [s for s, (w, m) in open_.items() if left * w / weight > m * sums[s] * (1 + 1e-12)]
        if not over:
            copies |= {s: min(float(m), left * w / weight / sums[s]) for s, (w, m) in open_.items()}
            break
        for s in over:
            copies[s] = float(open_[s][1])
            left -= open_[s][1] * sums[s]
            del open_[s]
    whole = sum(c * sums[s] for s, c in copies.items()) or 1.0
    return [(s, w, copies.get(s, 0.0) * sums.get(s, 0) / whole, m, float(sums.get(s, 0)), float(copies.get(s, 0.0))) for s, w, m in targets]


def due_copies(lengths: list[int], counts: list[int], copies: float, most: int, offset: float) -> list[int]:
    """Copies due to each length, for lengths from the longest on with their numbers of documents.

    The tokens due are at most the planned ones, and short of them by less than the shortest copy
    that the repeats still allow.
    """
    wanted = round(copies * sum(n * k for n, k in zip(lengths, counts)))
    due, at = [], offset
    for k in counts:
        due.append(min(most * k, math.floor(at + k * copies) - math.floor(at)))
        at += k * copies
    open_ = wanted - sum(n * d for n, d in zip(lengths, due))
    while open_ < 0:
        # The shortest copy that makes up for what is too much, else the longest there is.
        held = [j for j, d in enumerate(due) if d]
        j = next((j for j in reversed(held) if lengths[j] >= -open_), held[0])
        taken = 1 if lengths[j] >= -open_ else min(due[j], -open_ // lengths[j])
        due[j] -= taken
        open_ += taken * lengths[j]
    for j, n in enumerate(lengths):
        added = min(most * counts[j] - due[j], open_ // n)
        due[j] += added
        open_ -= added * n
    return due


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, fill: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, n_tokens, copy`` (one row per copy) and ``plan``, a row per target.

    ``docs`` are ``doc_id, source, n_tokens``; ``targets`` are ``source, share, max_repeats``: a
    list of sources by name, which doesn't grow with the documents. Source names are compared
    without blanks and case. Documents without tokens, of no source or of one that isn't named
    give no row; a target without share, repeats or documents is planned with no copies. Shares
    are scaled over the sources that can give anything. Of a source named twice the larger share
    and the smaller repeats count. Empty tables give an empty mixture. Rows that repeat a document
    are documents of their own.

    A source reaches its planned tokens up to less than its shortest document that has repeats
    left (see :func:`due_copies`). Only one row per source and length is worked on by itself; the
    documents of one length are numbered in parts of bounded size, so neither a hot source nor a
    text copied over and over is one task's work.
    """
    spark = docs.sparkSession
    named = targets.withColumn("s", key(F.col("source"))).filter(F.col("s").isNotNull()).groupBy("s")
    rows = named.agg(F.max(F.when(~F.isnan(F.col("share").cast("double")), F.col("share"))).alias("w"), F.min("max_repeats").alias("m")).orderBy("s").collect()
    goals = [(r["s"], r["w"], r["m"]) for r in rows]
    mine = docs.select("doc_id", key(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter((F.col("n_tokens") > 0) & F.col("source").isin([s for s, _, _ in goals]))
    lengths = checkpoint(mine.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    sums = {r["source"]: float(r["tokens"]) for r in lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens")).collect()}
    planned = _plan(goals, sums, total, fill)
    plan = spark.createDataFrame(planned, _PLAN)
    copies = {s: (c, m) for s, _, _, m, _, c in planned if c > 0}

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        pdf = pdf.sort_values("n_tokens", ascending=False)
        expected, most = copies[source]
        pdf["due"] = due_copies(pdf["n_tokens"].tolist(), pdf["n"].tolist(), expected, most, float(pdf["offset"].iloc[0]))
        return pdf[["source", "n_tokens", "n", "due"]]

    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "source"), F.lit(1 << 20)) / float(1 << 20)
    live = lengths.filter(F.col("source").isin(list(copies))).withColumn("offset", offset)
    due = checkpoint(live.groupBy("source").applyInPandas(settle, "source string, n_tokens long, n long, due long").filter("due > 0"))

    # Of the n documents of a length the first, in the order of part and hash, get a copy more than the others.
    order = F.xxhash64(F.lit(seed + 1), "doc_id")
    parted = mine.join(due, ["source", "n_tokens"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.ceil(F.col("n") / PART_ROWS)))
    before = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = parted.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("held"))
    starts = cells.select("source", "n_tokens", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "n_tokens", "part").orderBy(order, "doc_id")
    numbered = parted.withColumn("k", F.row_number().over(inside)).join(starts, ["source", "n_tokens", "part"])
    at = F.col("start") + F.col("k")
    times = F.expr("due div n").cast("int") + F.when(at <= F.col("due") % F.col("n"), 1).otherwise(0)
    mixed = numbered.withColumn("times", times).filter(F.col("times") > 0)
    return mixed.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")), plan


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What each source reached, and the largest gap between a planned and a reached share.

    ``source, target_share, planned_share, share, max_repeats, most_repeats, n_docs, tokens_available,
    tokens_planned, tokens, largest_gap``.
    """
    used = mixed.groupBy("source").agg(F.count_if(F.col("copy") == 1).alias("n_docs"), F.max("copy").alias("most_repeats"), F.sum("n_tokens").alias("used"))
    every = Window.partitionBy()
    d = plan.join(used, "source", "left").fillna(0, ["n_docs", "most_repeats", "used"])
    d = d.withColumn("share", F.col("used") / F.greatest(F.sum("used").over(every), F.lit(1)))
    gap = F.max(F.abs(F.col("share") - F.col("planned_share"))).over(every)
    return d.select(
        "source", "target_share", "planned_share", "share", "max_repeats", "most_repeats", "n_docs", F.col("tokens").cast("long").alias("tokens_available"),
        F.round(F.col("tokens") * F.col("copies")).cast("long").alias("tokens_planned"), F.col("used").alias("tokens"), gap.alias("largest_gap"),
    )


def kept_promises(docs: DataFrame, mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, within_repeats, within_one_document``: whether each source keeps to its repeats and to its planned tokens.

    The second asks that the planned tokens aren't exceeded, and that what is left open is less than
    the shortest document with a copy to spare.
    """
    of_doc = mixed.groupBy("source", "doc_id", "n_tokens").agg(F.max("copy").alias("copies"))
    every = docs.select("doc_id", key(F.col("source")).alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter("n_tokens > 0")
    bounded = every.join(of_doc, ["source", "doc_id", "n_tokens"], "left").fillna(0, ["copies"]).join(plan.select("source", "max_repeats"), "source")
    spare = bounded.groupBy("source").agg(F.min(F.when(F.col("copies") < F.col("max_repeats"), F.col("n_tokens"))).alias("shortest"), F.min(F.col("copies") <= F.col("max_repeats")).alias("within"))
    d = report(mixed, plan).join(spare, "source", "left")
    open_ = F.col("tokens_planned") - F.col("tokens")
    return d.select("source", F.coalesce("within", F.lit(True)).alias("within_repeats"), (((open_ >= 0) & (open_ < F.coalesce("shortest", F.lit(1 << 62)))) | (F.col("tokens_planned") == 0)).alias("within_one_document"))
