"""Best representative of each duplicate group: clips linked by id or span, then votes per field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import key, strip
from corpusloom.operators.coverage import milliseconds
from corpusloom.operators.graph import components
from corpusloom.session import checkpoint

#: Trust of a tier; missing or empty is human, any other name is trusted least.
TRUST = {"human": 1000, "machine-card": 100, "machine-consensus": 10}
_REFERENCE = "2026-01-01 00:00:00"


def trust(tier: Column) -> Column:
    """The tier's trust, letter case and surrounding blanks aside."""
    t = F.coalesce(key(tier), F.lit("human"))
    c = F.lit(1)
    for name, value in TRUST.items():
        c = F.when(t == name, value).otherwise(c)
    return c


def clips(df: DataFrame, row_id: str = "row_no", tolerance_ms: int = 100) -> DataFrame:
    """``row_id, clip``: the class of rows that are of one clip, named by the least row number of it.

    Rows are linked by the same id (blanks and case aside), by the same source with start and end
    that each differ by ``tolerance_ms`` at most (in whole milliseconds), or through further rows.
    A null or blank id links nothing, nor does a span with a null bound; a row with neither is a
    clip of its own. A row number that occurs again is the same row; an empty table gives no row.

    Spans fall into square cells as wide as the tolerance; rows of one cell are always linked, and
    whether two neighbouring cells are linked follows from per-cell extremes, so rows are never
    paired. Ids and cells stand in the graph as the least of their row numbers.
    """
    w = tolerance_ms
    d = df.select(
        F.col(row_id).alias("r"), key(F.col("id")).alias("i"), key(F.col("source_id")).alias("e"), milliseconds(F.col("start")).alias("s"), milliseconds(F.col("end")).alias("t")
    ).withColumns({"x": F.floor(F.col("s") / w), "y": F.floor(F.col("t") / w)})
    spanned = F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull()
    offset = lambda c, k: F.col(c) - F.col(k) * w
    steps = d.filter(spanned).groupBy("e", "x", "y", offset("s", "x").alias("o")).agg(F.min(offset("t", "y")).alias("lo"), F.max(offset("t", "y")).alias("hi"), F.min("r").alias("m"))
    cells = checkpoint(steps.groupBy("e", "x", "y").agg(F.sort_array(F.collect_list(F.struct("o", "lo", "hi"))).alias("steps"), F.min("m").alias("by_cell")))
    by_id = d.filter(F.col("i").isNotNull()).groupBy("i").agg(F.min("r").alias("by_id"))
    named = d.select("r", "i", "e", "x", "y").join(by_id, "i", "left").join(cells.drop("steps"), ["e", "x", "y"], "left")
    named = checkpoint(named.select("r", "by_id", "by_cell", F.coalesce("by_id", "by_cell", "r").alias("node")))
    edges = named.filter("by_id <> by_cell").select(F.col("by_id").alias("a"), F.col("by_cell").alias("b")).distinct().unionByName(_between_cells(cells))
    return named.select("r", "node").join(components(edges), "node", "left").groupBy(F.col("r").alias(row_id)).agg(F.min(F.coalesce("component", "node")).alias("clip"))


def _between_cells(cells: DataFrame) -> DataFrame:
    """``a, b``: edges of neighbouring cells ``e, x, y, steps, by_cell`` that hold two rows within the tolerance.

    Each cell is sent to the four squares of two by two cells that it is in, where its neighbours
    are met in one aggregation. A cell has as many steps as the tolerance has milliseconds at most.
    """
    at = [(0, 0), (1, 0), (0, 1), (1, 1)]
    squares = F.explode(F.array(*[F.struct((F.col("x") - p).alias("x"), (F.col("y") - q).alias("y"), F.lit(k).alias("k")) for k, (p, q) in enumerate(at)])).alias("at")
    sent = cells.select("e", squares, F.struct("steps", F.col("by_cell").alias("m")).alias("c"))
    met = sent.groupBy("e", "at.x", "at.y").agg(*[F.max(F.when(F.col("at.k") == k, F.col("c"))).alias(f"c{k}") for k in range(4)], F.count("*").alias("n")).filter("n > 1")
    lowest = lambda c: F.array_min(F.transform(F.col(f"{c}.steps"), lambda p: p["lo"]))
    highest = lambda c: F.array_max(F.transform(F.col(f"{c}.steps"), lambda p: p["hi"]))
    beside = F.element_at("c1.steps", 1)["o"] <= F.element_at("c0.steps", -1)["o"]
    above = lowest("c2") <= highest("c0")
    up = F.exists("c0.steps", lambda p: F.exists("c3.steps", lambda q: (q["o"] <= p["o"]) & (q["lo"] <= p["hi"])))
    down = F.exists("c2.steps", lambda p: F.exists("c1.steps", lambda q: (q["o"] <= p["o"]) & (p["lo"] <= q["hi"])))
    linked = [("c0", "c1", beside), ("c0", "c2", above), ("c0", "c3", up), ("c2", "c1", down)]
    found = F.array_compact(F.array(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & near, F.struct(F.col(f"{a}.m").alias("a"), F.col(f"{b}.m").alias("b"))) for a, b, near in linked]))
    return met.select(F.explode(found).alias("pair")).select("pair.*")


def _same(value: Column, kind: str) -> Column:
    """The value as it votes: numbers to three places, texts without case and blank runs."""
    if kind in ("double", "float"):
        return F.round(value.cast("double"), 3).cast("string")
    return F.regexp_replace(F.lower(strip(value.cast("string"))), r"(?U)\s+", " ")


def halving(at: Column, half_life_days: float = 180.0) -> Column:
    """Half as much for every half-life of age, a thousand at most; null counts as very old."""
    age = (F.unix_timestamp(F.lit(_REFERENCE).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 86400.0
    return F.coalesce(F.least(F.lit(1e3), F.pow(F.lit(2.0), -age / half_life_days)), F.lit(0.0)).cast("decimal(24,20)")


def steady(at: Column) -> Column:
    """A decay along a straight line over some 18,000 years, exact to the microsecond.

    The latest time weighs three times as much as the earliest and six times as much as null, so it
    never outweighs a step of TRUST; times beyond year 9999 weigh as much as year 11,000 or so.
    """
    micros = F.least(F.greatest(F.unix_micros(at.cast("timestamp")), F.lit(-(1 << 58))), F.lit(1 << 58))
    return F.coalesce(micros + F.lit(1 << 59), F.lit(1 << 57)).cast("decimal(20,0)")


def survivors(df: DataFrame, groups: DataFrame, fields: list[str], row_id: str = "row_no", group: str = "clip", decay: Callable[[Column], Column] = halving) -> DataFrame:
    """``group, n_rows`` and ``fields``: one record per group, each field the value with most votes.

    The fields are unpivoted to long rows. A filled value has its row's trust times the decay of
    its ``updated_at`` as its vote; votes are summed per normalised value, and the winner (then the
    most trusted, the latest, the least ``row_id``) is chosen by max_by and pivoted back in its own
    spelling and type. A field that is null or blank in all rows stays null. Votes are decimals,
    so sums don't depend on the partitioning (what :func:`halving` leaves of a vote after some 66
    half-lives is nothing, and trust and time decide); both steps aggregate before they shuffle,
    so a group may hold any part of the rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rank = trust(F.col("verified_by"))
    base = df.select(*dict.fromkeys([row_id, "verified_by", "updated_at", *fields])).dropDuplicates([row_id]).join(groups.select(row_id, F.col(group).alias("__g")), row_id)
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("raw"), _same(F.col(f), kinds[f]).alias("same")) for f in fields])
    order = F.struct(rank.alias("k"), F.col("updated_at").alias("at"), (-F.col(row_id)).alias("r"))
    long = base.select("__g", order.alias("order"), (rank.cast("decimal(4,0)") * decay(F.col("updated_at"))).alias("vote"), F.explode(cells).alias("c"))
    votes = (
        long.groupBy("__g", F.col("c.f").alias("f"), F.col("c.same").alias("same"))
        .agg(F.sum("vote").alias("votes"), F.max("order").alias("order"), F.max_by("c.raw", "order").alias("raw"), F.count("*").alias("n"))
        .withColumn("filled", F.coalesce(F.col("same") != "", F.lit(False)))
    )
    won = votes.groupBy("__g", "f").agg(F.max_by(F.when(F.col("filled"), F.col("raw")), F.struct("filled", "votes", "order")).alias("raw"), F.sum("n").alias("n"))
    wide = won.groupBy(F.col("__g").alias(group)).agg(F.max("n").alias("n_rows"), *[F.max(F.when(F.col("f") == f, F.col("raw"))).alias(f) for f in fields])
    return wide.select(group, "n_rows", *[F.col(f).cast(kinds[f]).alias(f) for f in fields])


def best_rows(df: DataFrame, row_id: str = "row_no") -> DataFrame:
    """``row_no, best_row_no``: every row of a clip with two rows or more, with the clip's best row.

    The best row is the survivor of the field ``row_no`` itself: each row number has the one vote of
    its own row, the tier's trust times a decay (:func:`steady`) that is exact and never outweighs a
    step of trust, so votes order rows by tier, then by ``updated_at`` (null last); of equal votes
    the least number wins.
    """
    groups = checkpoint(clips(df, row_id))
    several = groups.groupBy("clip").agg(F.count("*").alias("n")).filter("n > 1").select("clip")
    groups = groups.join(several, "clip")
    plain = df.select(row_id, "verified_by", "updated_at").withColumn("best_row_no", F.col(row_id))
    kept = survivors(plain, groups, ["best_row_no"], row_id, decay=steady)
    return groups.join(kept, "clip").select(row_id, "best_row_no")
