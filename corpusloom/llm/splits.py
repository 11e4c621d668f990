"""Splits that keep related records together: component swap search by parallel annealing.

All rows of a source are one component. Only sums per component are moved: the components that
hold a large share (their number is bounded by the reciprocal of that share) are annealed
together, in several independent searches run as parallel tasks; all others are hashed into blocks
of bounded size that are annealed on their own, each towards what the large ones left open. Each
search starts from the hashed assignment, moves or exchanges whole components, and the best of
the searches is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import key
from corpusloom.llm.survivors import TRUST

LABELS = (*TRUST, "other")
#: A component above this share of the total is large; so there are at most 2048 of them.
LARGE_SHARE = 1 / 2048
BLOCK_COMPONENTS = 2000
SEARCHES, STEPS = 8, 20_000
#: Weight of the deviation of the label mix against that of the size.
LABEL_WEIGHT = 0.1


def component_key(df: DataFrame, row_id: str) -> DataFrame:
    """``row_id, comp``: a row's source key; without one, the least source of the rows with its id; else its id; else the row itself."""
    d = df.select(F.col(row_id).alias("r"), key(F.col("source_id")).alias("e"), key(F.col("id")).alias("i"))
    by_id = d.filter(F.col("e").isNotNull() & F.col("i").isNotNull()).groupBy("i").agg(F.min("e").alias("via"))
    lost = d.filter(F.col("e").isNull()).join(by_id, "i", "left")
    own = F.when(F.col("i").isNotNull(), F.concat(F.lit("\tid:"), F.col("i"))).otherwise(F.concat(F.lit("\trow:"), F.col("r").cast("string")))
    named = d.filter(F.col("e").isNotNull()).select("r", F.col("e").alias("comp"))
    return named.unionByName(lost.select("r", F.coalesce("via", own).alias("comp"))).withColumnRenamed("r", row_id)


def label(tier: Column) -> Column:
    t = F.coalesce(key(tier), F.lit("human"))
    return F.when(t.isin(*TRUST), t).otherwise(F.lit("other"))


def measure(size: Column) -> Column:
    """In whole thousandths, so sums are exact; null, NaN, infinite and negative sizes, and those that 64 bits can't hold, count as nothing."""
    s = size.cast("double")
    return F.when((s > 0) & (s < 9e15), F.round(s * 1000).cast("long")).otherwise(F.lit(0).cast("long"))


def _sum(c: Column | str) -> Column:
    """A sum that no order changes and that can't overflow."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast("decimal(28,0)")), F.lit(0)).cast("double")


def anneal(sizes: np.ndarray, labels: np.ndarray, want: np.ndarray, start: np.ndarray, seed: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """The best assignment found, and its cost.

    ``sizes`` of n components, ``labels`` (n, k) sizes per label, ``want`` the size wanted of each
    split, ``start`` the first assignment. Cost: the summed deviation of the splits' sizes, as a
    share of all, plus that of their label sizes times LABEL_WEIGHT.
    """
    n, k = labels.shape
    total = max(float(sizes.sum()), 1.0)
    mix = labels.sum(0) / total
    goal = np.concatenate([want[:, None], want[:, None] * mix[None, :]], 1) / total
    weight = np.concatenate([[1.0], np.full(k, LABEL_WEIGHT)])
    rows = np.concatenate([sizes[:, None], labels], 1) / total
    now = start.copy()
    held = np.zeros_like(goal)
    np.add.at(held, now, rows)
    off = (np.abs(held - goal) * weight).sum(1)
    cost = off.sum()
    best, least = now.copy(), cost
    if n == 0 or len(want) < 2:
        return best, float(least)
    rng = np.random.default_rng(seed)
    steps = min(steps, 200 * n)
    pick, other, to, chance = rng.integers(n, size=steps), rng.integers(n, size=steps), rng.integers(len(want), size=steps), rng.random(steps)
    warmth = np.geomspace(0.05, 1e-7, steps)
    for j in range(steps):
        a, swap = pick[j], j % 2
        b = other[j]
        p = now[a]
        q = now[b] if swap else to[j]
        if p == q:
            continue
        d = rows[a] - rows[b] if swap else rows[a]
        hp, hq = held[p] - d, held[q] + d
        op, oq = (np.abs(hp - goal[p]) * weight).sum(), (np.abs(hq - goal[q]) * weight).sum()
        change = op + oq - off[p] - off[q]
        if change <= 0 or chance[j] < math.exp(-change / warmth[j]):
            held[p], held[q], off[p], off[q] = hp, hq, op, oq
            now[a] = q
            if swap:
                now[b] = p
            cost += change
            if cost < least - 1e-12:
                best, least = now.copy(), cost
    return best, float(least)


def assign(df: DataFrame, targets: DataFrame, row_id: str = "row_no", size: str = "duration", tier: str = "verified_by", searches: int = SEARCHES, seed: int = 1) -> DataFrame:
    """``row_id, split, component``: each row's split; rows of one component share it.

    ``targets`` are ``split, share``: a handful of rows (their number doesn't grow with the data);
    null, negative or repeated ones are dropped or added up, and shares are scaled to sum 1. Null
    or negative sizes count as 0, so such rows follow their component. With no usable target, or an
    empty table, there is no row. The result depends on the rows and the seed alone, not on their
    order or partitioning.
    """
    wanted = [(r["split"], float(r["share"])) for r in targets.filter(F.col("split").isNotNull() & (F.col("share") > 0) & ~F.isnan(F.col("share").cast("double"))).groupBy("split").agg(F.sum("share").alias("share")).orderBy("split").collect()]
    comp = component_key(df, row_id)
    if not wanted:
        return comp.select(row_id, F.lit(None).cast("string").alias("split"), F.col("comp").alias("component")).limit(0)
    names, shares = [s for s, _ in wanted], np.array([x for _, x in wanted]) / sum(x for _, x in wanted)

    measured = df.select(row_id, measure(F.col(size)).alias("ms"), label(F.col(tier)).alias("label")).join(comp, row_id)
    stats = measured.groupBy("comp").agg(_sum("ms").alias("ms"), *[_sum(F.when(F.col("label") == x, F.col("ms"))).alias(f"l{j}") for j, x in enumerate(LABELS)])
    stats = stats.withColumn("rank", F.xxhash64(F.lit(seed), "comp"))
    from corpusloom.session import checkpoint

    stats = checkpoint(stats)
    whole = stats.agg(_sum("ms").alias("ms"), F.count("*").alias("n")).first()
    edge = max(1, int(whole["ms"] * LARGE_SHARE))
    large = stats.filter(F.col("ms") > edge)
    columns = [f"l{j}" for j in range(len(LABELS))]
    edges = np.cumsum(shares)

    def hashed(rank: pd.Series) -> np.ndarray:
        part = (rank.to_numpy().astype("uint64") >> np.uint64(11)).astype("float64") / 2.0**53
        return np.minimum(np.searchsorted(edges, part, side="right"), len(shares) - 1)

    def solved(pdf: pd.DataFrame, want: np.ndarray, search: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "comp"])
        sizes, labels = pdf["ms"].to_numpy("float64"), pdf[columns].to_numpy("float64")
        found, cost = anneal(sizes, labels, want, hashed(pdf["rank"]), seed * 1009 + search)
        held = np.zeros(len(names))
        np.add.at(held, found, sizes)
        return pd.DataFrame({"comp": pdf["comp"], "search": search, "cost": cost, "at": found.astype("int32"), "ms": pdf["ms"]})

    schema = "block long, comp string, search int, cost double, at int, ms double"

    def run(parts: DataFrame, wants: np.ndarray) -> DataFrame:
        """Every block by every search, as parallel tasks; of each block the cheapest search."""
        def one(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = solved(pdf, wants * float(pdf["ms"].sum()), int(ids[1]))
            out.insert(0, "block", int(ids[0]))
            return out

        tried = parts.withColumn("search", F.explode(F.sequence(F.lit(0), F.lit(searches - 1)))).groupBy("block", "search").applyInPandas(one, schema)
        tried = checkpoint(tried)
        least = tried.groupBy("block").agg(F.min(F.struct("cost", "search")).alias("least")).select("block", F.col("least.search").alias("search"))
        return tried.join(least, ["block", "search"]).select("comp", "at", "ms")

    first = checkpoint(run(large.withColumn("block", F.lit(0).cast("long")), shares))
    held = np.zeros(len(names))
    for r in first.groupBy("at").agg(_sum("ms").alias("ms")).collect():
        held[r["at"]] = r["ms"]
    open_ = np.maximum(shares * float(whole["ms"]) - held, 0)
    wants = open_ / open_.sum() if open_.sum() > 0 else shares
    blocks = max(1, math.ceil(whole["n"] / BLOCK_COMPONENTS))
    small = stats.filter(F.col("ms") <= edge).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "comp"), F.lit(blocks)))
    chosen = first.unionByName(run(small, wants)).select("comp", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1).alias("split"))
    return comp.join(chosen, "comp").select(row_id, "split", F.col("comp").alias("component"))


def report(df: DataFrame, assigned: DataFrame, targets: DataFrame, row_id: str = "row_no", size: str = "duration", tier: str = "verified_by") -> DataFrame:
    """``split, n_rows, n_components, size, share, target_share, label_deviation`` of an assignment.

    The last is the part of a split's size that would have to be of other labels for it to have the mix of the whole.
    """
    sized = df.select(row_id, measure(F.col(size)).alias("ms"), label(F.col(tier)).alias("label")).join(assigned, row_id)
    of = [_sum(F.when(F.col("label") == x, F.col("ms"))).alias(f"l{j}") for j, x in enumerate(LABELS)]
    sums = sized.groupBy("split", "component").agg(_sum("ms").alias("ms"), F.count("*").alias("n"), *of)
    by = sums.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"), _sum("ms").alias("ms"), *[_sum(f"l{j}").alias(f"l{j}") for j in range(len(LABELS))])
    every = Window.partitionBy()
    whole = F.greatest(F.sum("ms").over(every), F.lit(1.0))
    off = sum((F.abs(F.col(f"l{j}") / F.greatest("ms", F.lit(1.0)) - F.sum(f"l{j}").over(every) / whole) for j in range(1, len(LABELS))), F.abs(F.col("l0") / F.greatest("ms", F.lit(1.0)) - F.sum("l0").over(every) / whole)) / 2
    shared = by.withColumns({"share": F.col("ms") / whole, "label_deviation": off})
    return shared.join(targets.select("split", F.col("share").alias("target_share")), "split", "left").select("split", "n_rows", "n_components", (F.col("ms") / 1000).alias("size"), "share", "target_share", "label_deviation")
