"""Filling fixed-capacity containers: conflict-constrained best fit.

A document longer than the capacity is cut into full containers and one remainder; remainders and
shorter documents are packed. They are hashed into shards of bounded size, so that each shard has
the same mix of sizes, and packed there by decreasing size. Bins are kept by residual; each
carries a bitmap of its sources and one of its groups of copies. For an item the successors of its
size are searched upwards: among the nearly full bins one without its source is preferred, else
the tightest bin without a copy of the item is taken, however far it is. Bins left too empty are
opened again and their items packed anew in shards of the remaining items.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import key
from corpusloom.session import checkpoint

SHARD_ITEMS = 20_000
#: A bin filled less than this is opened again in the second round.
FULL_ENOUGH = 0.97


def quotas(sizes: list[int], groups: list, capacity: int) -> dict:
    """How many items of each group a bin may hold: as few as the group can be spread over the bins that are needed at least."""
    bins = max(1, -(-sum(sizes) // capacity))
    return {g: -(-n // bins) for g, n in Counter(groups).items() if g is not None}


def best_fit(sizes: list[int], sources: list, copies: list, capacity: int) -> list[int]:
    """The bin of each item, for items in the order given (decreasing sizes fill best).

    No bin exceeds the capacity, holds two items of one copy group, or holds more of one source than
    its quota (:func:`quotas`): null is of no group and of no source.
    """
    twice = {c for c, n in Counter(copies).items() if n > 1 and c is not None}
    bit_of_copy = {c: 1 << j for j, c in enumerate(sorted(twice, key=str))}
    quota = quotas(sizes, sources, capacity)
    bit_of_source = {s: 1 << j for j, s in enumerate(sorted(quota, key=str))}
    held: Counter = Counter()
    #: By residual: the bins of each pair of bitmaps; and a number whose bit r tells that residual r has bins.
    shelves: list[dict] = [{} for _ in range(capacity + 1)]
    stocked, n_bins, out = 0, 0, []
    for size, source, copy in zip(sizes, sources, copies):
        s, c = bit_of_source.get(source, 0), bit_of_copy.get(copy, 0)
        found, rest, r = None, stocked >> size, size - 1
        while rest and not found:
            step = (rest & -rest).bit_length()
            r, rest = r + step, rest >> step
            found = next((m for m in shelves[r] if not m[0] & s and not m[1] & c), None)
        if found:
            bins = shelves[r][found]
            b = bins.pop()
            if not bins:
                del shelves[r][found]
                if not shelves[r]:
                    stocked &= ~(1 << r)
        else:
            r, b, found = capacity, n_bins, (0, 0)
            n_bins += 1
        if s:
            held[b, source] += 1
            s = s if held[b, source] >= quota[source] else 0
        left = r - size
        if left:
            shelves[left].setdefault((found[0] | s, found[1] | c), []).append(b)
            stocked |= 1 << left
        out.append(b)
    return out


_PACKED = "container string, capacity int, bin string, doc_id string, piece int, start_token long, n_tokens int, source string, copy_key long"


def _round(items: DataFrame, name: str) -> DataFrame:
    def one(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        copies = [None if pd.isna(c) else int(c) for c in pdf["copy_key"]]
        sources = [None if pd.isna(s) else s for s in pdf["source"]]
        bins = best_fit(pdf["n_tokens"].tolist(), sources, copies, int(ids[1]))
        pdf["bin"] = [f"{name}{ids[2]}-{b}" for b in bins]
        return pdf[[c.split()[0] for c in _PACKED.split(", ")]]

    return items.groupBy("container", "capacity", "shard").applyInPandas(one, _PACKED)


def _sharded(items: DataFrame, counts: list, shard_items: int, seed: int) -> DataFrame:
    shards = {r["container"]: max(1, math.ceil(r["n"] / shard_items)) for r in counts}
    n = F.lit(1)
    for c, k in shards.items():
        n = F.when(F.col("container") == c, k).otherwise(n)
    return items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), n).cast("int"))


def pack(docs: DataFrame, capacities: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``container, capacity, bin, doc_id, piece, start_token, n_tokens``: every piece and its bin.

    ``docs`` are ``doc_id, source, n_tokens, copy_key``; ``capacities`` are ``name,
    capacity_tokens``: a handful of kinds of container, each packed on its own; null or
    non-positive ones are dropped, of repeated names the largest counts. Documents without tokens
    give no row. A document of the capacity or less is one piece; a longer one is cut every
    ``capacity`` tokens. Repeated document ids are packed as often as they occur.
    """
    kinds = [(r["name"], int(r["cap"])) for r in capacities.filter((F.col("capacity_tokens") > 0) & F.col("name").isNotNull()).groupBy("name").agg(F.max("capacity_tokens").alias("cap")).orderBy("name").collect()]
    spark = docs.sparkSession
    shape = "container string, capacity int, bin string, doc_id string, piece int, start_token long, n_tokens int"
    id_kind = dict(docs.dtypes)["doc_id"]
    if not kinds:
        return spark.createDataFrame([], shape).withColumn("doc_id", F.col("doc_id").cast(id_kind))
    cut = docs.filter(F.col("n_tokens") > 0).select(
        F.col("doc_id").cast("string").alias("doc_id"), key(F.col("source")).alias("source"), "copy_key", "n_tokens",
        F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in kinds])).alias("k"),
    ).select("k.*", "doc_id", "source", "copy_key", "n_tokens", F.floor(F.col("n_tokens") / F.col("k.capacity")).cast("int").alias("whole"))
    full = cut.filter(F.col("whole") > 0).select("container", "capacity", "doc_id", F.posexplode(F.expr("array_repeat(capacity, whole)")).alias("piece", "n_tokens"))
    full = full.select(
        "container", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin"), "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("start_token"), "n_tokens"
    )
    left = (F.col("n_tokens") - F.col("whole").cast("long") * F.col("capacity")).cast("int")
    rest = cut.select("container", "capacity", "doc_id", F.col("whole").alias("piece"), (F.col("whole").cast("long") * F.col("capacity")).alias("start_token"), left.alias("n_tokens"), "source", "copy_key")
    rest = rest.filter(F.col("n_tokens") > 0)
    by_kind = [F.col("container")]
    first = checkpoint(_round(_sharded(rest, rest.groupBy(*by_kind).agg(F.count("*").alias("n")).collect(), shard_items, 1), "a"))
    bins = first.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("held"))
    loose = bins.filter(F.col("held") < FULL_ENOUGH * F.col("capacity")).select("container", "bin")
    kept = first.join(loose, ["container", "bin"], "left_anti")
    again = first.join(loose, ["container", "bin"], "left_semi").drop("bin")
    again = _round(_sharded(again, again.groupBy(*by_kind).agg(F.count("*").alias("n")).collect(), shard_items, 2), "b")
    columns = [c.split()[0] for c in shape.split(", ")]
    return full.select(columns).unionByName(kept.select(columns)).unionByName(again.select(columns)).withColumn("doc_id", F.col("doc_id").cast(id_kind))


def fill_report(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """How full the bins of each kind are, and how far their sources are spread.

    ``container, capacity, n_bins, n_pieces, n_tokens, fill``, ``n_mixed``, the bins with pieces of
    several documents, ``n_shared``, those in which a source has more than one, and
    ``most_of_a_source``, the most that one bin has of one.
    """
    named = docs.select(F.col("doc_id"), key(F.col("source")).alias("source")).dropDuplicates(["doc_id"])
    of_source = packed.join(named, "doc_id", "left").groupBy("container", "capacity", "bin", "source").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("n"))
    bins = of_source.groupBy("container", "capacity", "bin").agg(F.sum("held").alias("held"), F.sum("n").alias("n"), F.max(F.when(F.col("source").isNotNull(), F.col("n"))).alias("most"))
    by = bins.groupBy("container", "capacity").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_pieces"), F.sum("held").alias("n_tokens"), F.count_if(F.col("n") > 1).alias("n_mixed"), F.count_if(F.col("most") > 1).alias("n_shared"), F.max("most").alias("most_of_a_source")
    )
    return by.withColumn("fill", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")))


def kept_promises(docs: DataFrame, capacities: DataFrame, packed: DataFrame) -> DataFrame:
    """``container, n_docs, whole, within_capacity, cut_if_long, copies_apart``: what :func:`pack` promises, per kind of container."""
    sizes = docs.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("size"), "copy_key")
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("n_tokens").alias("held")).groupBy("container").agg(F.max(F.col("held") > F.col("capacity")).alias("overfull"))
    each = packed.groupBy("container", "capacity", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end")).join(sizes, "doc_id", "right")
    docwise = each.groupBy("container").agg(
        F.count("*").alias("n_docs"), F.min((F.col("held") == F.col("size")) & (F.col("end") == F.col("size"))).alias("whole"), F.min(F.col("pieces") == F.ceil(F.col("size") / F.col("capacity"))).alias("cut_if_long")
    )
    copies = packed.join(sizes.filter("copy_key IS NOT NULL"), "doc_id").groupBy("container", "bin", "copy_key").agg(F.count("*").alias("n")).groupBy("container").agg(F.max("n").alias("n"))
    return docwise.join(bins, "container").join(copies, "container").select("container", "n_docs", "whole", (~F.col("overfull")).alias("within_capacity"), "cut_if_long", (F.col("n") == 1).alias("copies_apart"))
