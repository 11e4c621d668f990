"""Building a text corpus: lines, pieces, first-wins distinct, byte budgets and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.lexicon import normalise
from corpusloom.functions.text import filled, strip

LEAST_PIECE = 2
#: Rows whose numbers share a bucket of the running sums.
BUCKET = 100_000
#: Rows of a bucket of the byte budget, and buckets of a page.
PAGE = 2048


def lines(text: Column) -> Column:
    """The lines of a text; every kind of line break counts."""
    return F.split(F.coalesce(text, F.lit("")), r"\R")


def pieces(df: DataFrame, order: str, text: str, source: str, least: int = LEAST_PIECE) -> DataFrame:
    """``source, order, li, pi, piece``: the parts between slashes of every line, of two characters or more."""
    each = df.select(F.col(source).alias("source"), F.col(order), F.posexplode(lines(F.col(text))).alias("li", "line"))
    parts = each.select("source", order, "li", F.posexplode(F.split("line", "/")).alias("pi", "piece")).withColumn("piece", strip(F.col("piece")))
    return parts.filter(F.length("piece") >= least)


def texts(df: DataFrame, text: str, verified_only: bool = False) -> DataFrame:
    """The rows with a text, of a track that keeps a status the verified ones only."""
    kept = df.filter(filled(F.col(text)))
    return kept.filter(F.col("status") == "verified") if verified_only else kept


def build(tracks: dict[str, tuple[DataFrame, str, str, str]], variants: dict[str, str] | None = None) -> DataFrame:
    """``piece, track, source, row, li, pi``: the distinct pieces of all tracks as the convention has them, each where it came first.

    ``tracks`` are, in their order, a table and its columns of order, text and source. Pieces that differ
    only in spelling or signs are one; those that are the same as written meet before they are normalised.
    """
    place = ["ord", "row", "li", "pi", "source"]
    each = [
        pieces(df, order, text, source, least=1).select("piece", F.lit(j).alias("ord"), F.lit(name).alias("track"), "source", F.col(order).cast("long").alias("row"), "li", "pi")
        for j, (name, (df, order, text, source)) in enumerate(tracks.items())
    ]
    raw = first_wins(reduce(DataFrame.unionByName, each), "piece", place)
    done = raw.withColumn("piece", normalise(F.col("piece"), variants)["text"]).withColumn("size", F.length("piece"))
    # The size is read after grouping: a filter on the piece would be pushed below both and normalise twice.
    return first_wins(done, "piece", place).filter(F.col("size") >= LEAST_PIECE).drop("ord", "size")


def first_wins(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row per value, the first in order: an aggregation that keeps one candidate per value before the shuffle."""
    others = [c for c in df.columns if c != value]
    kept = df.groupBy(value).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("k"))
    return kept.select(value, *[F.col(f"k.{c}").alias(c) for c in others])


def corpus_stats(df: DataFrame, line: str) -> DataFrame:
    """``n_lines, n_chars``: lines, and characters with a line break after each."""
    return df.agg(F.count("*").alias("n_lines"), (F.coalesce(F.sum(F.length(line)), F.lit(0)) + F.count("*")).alias("n_chars"))


def byte_budget(df: DataFrame, order: str, text: str, budget: int) -> DataFrame:
    """The documents in order until their bytes reach the budget; the one that crosses it is kept.

    Each counts its bytes without surrounding blanks, and two for the break after it. Bytes are summed
    per bucket of the order first, so only the buckets that begin below the budget are read as rows.
    """
    size = (F.octet_length(strip(F.coalesce(F.col(text), F.lit("")))) + 2).cast("long")
    d = df.withColumn("__b", F.floor(F.col(order) / PAGE))
    totals = d.groupBy("__b").agg(F.sum(size).alias("t")).withColumn("page", F.floor(F.col("__b") / PAGE))
    pages = totals.groupBy("page").agg(F.sum("t").alias("t")).select("page", F.coalesce(F.sum("t").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    inner = F.coalesce(F.sum("t").over(Window.partitionBy("page").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("s", inner).join(pages, "page").select("__b", (F.col("s") + F.col("p")).alias("__s")).filter(F.col("__s") < budget)
    within = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = d.join(starts, "__b").withColumn("n_bytes", size)
    return rows.withColumn("before", F.col("__s") + F.coalesce(F.sum("n_bytes").over(within), F.lit(0))).filter(F.col("before") < budget).drop("__b", "__s")
