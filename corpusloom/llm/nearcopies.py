"""Groups of near-copies: an exact prefix-filter join on shingles of five words, then connected components.

Two texts are near-copies if their sets of shingles have a Jaccard similarity of LEAST or more. Then
the first of each set's shingles, in any one order, as many as may be missing and a few more, have as
few in common. The order is that of the shingles' digests, but those that a bounded sample of texts
shows to be frequent come last: that changes which pairs are compared, never which are found. Copies
of a text are one text throughout.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.session import checkpoint

WORDS, LEAST = 5, 0.8
#: Texts from which frequent shingles are told, and in how many of them a shingle must be.
SAMPLE_TEXTS, FREQUENT = 10_000, 3
#: Shingles that the first ones of two sets must have in common, and one more for so many in the smaller set; sets with fewer, all that they must share.
MET, ONE_MORE = 8, 50
#: Document ids that may be sent to every executor.
BROADCAST_IDS = 200_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


class _Digests(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = xxhash.xxh3_64_intdigest(word)
        return self[word]


def shingles(text: str | None, known: _Digests) -> np.ndarray:
    """The distinct digests of a text's runs of five words, in order; a shorter text is one run, one without words none."""
    w = np.array([known[x] for x in (text or "").lower().split()], dtype="uint64")
    if not len(w):
        return w.view("int64")
    n = max(1, len(w) - WORDS + 1)
    run = np.zeros(n, dtype="uint64")
    with np.errstate(over="ignore"):
        for j in range(min(WORDS, len(w))):
            run = run * _STEP + w[j : j + n]
        run = (run ^ (run >> np.uint64(31))) * _MIX
        run ^= run >> np.uint64(29)
    return np.unique(run.view("int64"))


def _light(ids: DataFrame) -> DataFrame:
    """Document ids kept and counted, so that texts aren't moved to join them if they are few; more than BROADCAST_IDS are joined by a shuffle."""
    kept = checkpoint(ids)
    return F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept


def _frequent(texts: DataFrame) -> set[int]:
    """Shingles that are in FREQUENT or more of a bounded sample of texts, taken by their documents' digests."""
    few = texts.select("d").orderBy(F.xxhash64("d"), "d").limit(SAMPLE_TEXTS)
    some = texts.join(F.broadcast(few), "d", "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = _Digests(), Counter()
        for pdf in batches:
            for t in pdf["t"]:
                n.update(shingles(t, known).tolist())
        yield pd.DataFrame({"h": pd.Series(list(n), dtype="int64"), "n": pd.Series(list(n.values()), dtype="int64")})

    found = some.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return {r["h"] for r in found.collect()}


def links(texts: DataFrame) -> DataFrame:
    """``a, b``: the documents of every pair of near-copies among distinct texts ``d, t``."""
    frequent = np.array(sorted(_frequent(texts)), dtype="int64")
    kind = dict(texts.dtypes)["d"]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Digests()
        for pdf in batches:
            digests, places = [], []
            for t in pdf["t"]:
                s = shingles(t, known)
                n = len(s)
                if len(frequent) and n:
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~late], s[late]]) if late.any() else s
                must = math.ceil(LEAST * n - 1e-9)
                s = s[: n - must + min(MET + n // ONE_MORE, must)]
                digests.append(s)
                places.append(np.arange(len(s)) + (n << 32))
            if digests:
                yield pd.DataFrame({"h": np.concatenate(digests), "d": pdf["d"].repeat([len(s) for s in digests]).to_numpy(), "at": np.concatenate(places)})

    # The size of a set and the place in it are one number, as most of what is moved are these rows.
    index = texts.mapInPandas(prefixes, f"h long, d {kind}, at long")
    side = lambda m: index.select("h", F.col("d").alias(m), F.col("at").alias(f"{m}p"))
    place = lambda m: {f"{m}at": F.col(f"{m}p").bitwiseAND(F.lit((1 << 32) - 1)), f"{m}n": F.shiftright(f"{m}p", 32)}
    need = F.ceil((F.col("an") + F.col("bn")) * (LEAST / (1 + LEAST)) - 1e-9)
    able = 1 + F.least(F.col("an") - F.col("aat") - 1, F.col("bn") - F.col("bat") - 1) + F.least("aat", "bat") >= need
    enough = F.least(MET + F.floor(F.least("an", "bn") / ONE_MORE), F.ceil(F.least("an", "bn") * LEAST - 1e-9))
    sized = F.least("an", "bn") >= LEAST * F.greatest("an", "bn") - 1e-9
    pairs = checkpoint(side("a").hint("merge").join(side("b"), "h").filter("a < b").withColumns(place("a") | place("b")).filter(sized & able).groupBy("a", "b").agg(F.count("*").alias("met"), F.first(enough).alias("enough")).filter("met >= enough").select("a", "b"))
    wanted = _light(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Digests()
        for pdf in batches:
            yield pd.DataFrame({"d": pdf["d"], "s": [shingles(t, known) for t in pdf["t"]]})

    whole = checkpoint(texts.join(wanted, "d", "left_semi").mapInPandas(sets, f"d {kind}, s array<long>"))
    met = pairs.join(whole.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(both >= LEAST * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def grouped(docs: DataFrame, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (``doc_id, copy_key`` and more) with the keys of near-copies replaced by the least key of their group.

    Texts that are linked through further ones are of one group; of copies the first document
    stands for all. Documents without a key keep none; a repeated document id is one document;
    empty tables stay empty.
    """
    keyed = docs.select(F.col("doc_id").alias("d"), F.col("copy_key").alias("k")).filter("k IS NOT NULL")
    first = keyed.groupBy("k").agg(F.min("d").alias("first"))
    copies = _light(keyed.join(first, "k").filter("d <> first").select("d").distinct())
    texts = df.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL").join(copies, "d", "left_anti")
    linked = checkpoint(links(texts))
    ends = linked.select(F.explode(F.array("a", "b")).alias("d")).distinct().join(keyed, "d").groupBy("d").agg(F.min("k").alias("k"))
    edges = linked.join(ends.select(F.col("d").alias("a"), F.col("k").alias("ka")), "a").join(ends.select(F.col("d").alias("b"), F.col("k").alias("kb")), "b")
    group = components(edges, "ka", "kb").withColumnRenamed("node", "copy_key")
    return docs.join(group, "copy_key", "left").withColumn("copy_key", F.coalesce("component", "copy_key")).select(*docs.columns)
