"""The spelling convention: normalisation with flags, and the lexicon's lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.script import devanagari_for_lexicon, nfc
from corpusloom.functions.text import let, strip

# Signs that become blanks, and the flags in their order.
PUNCTUATION = "!;:,‘’“”\"'()[]{}<>|/\\*_~`–—-"
FLAGS = ("devanagari-transliterated", "nukta-stripped", "candrabindu->anusvara", "slash-alternates", "latin-remnant", "digits", "devanagari-remnant")
NUKTA, CANDRABINDU, ANUSVARA = "઼", "ઁ", "ં"
UNSURE = "(?)"
_KEPT = "\ue003"
_DEVANAGARI = r"[\x{0900}-\x{097F}]"


def normalise(text: Column, variants: dict[str, str] | None = None) -> Column:
    """``struct<text, flags>`` of a text by the convention; null counts as empty.

    ``variants`` are misspelt words and what to write for them: a lexicon that fits in a literal. A
    longer one is applied with :func:`fold_variants`.
    """
    deva = lambda t: t.rlike(_DEVANAGARI)

    def spelled(w: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
        return let(F.regexp_replace(w, r"[.?]+$", ""), lambda bare: F.coalesce(F.concat(table[bare], F.substring(w, F.length(bare) + 1, 1 << 20)), w))

    def worded(plain: Column) -> Column:
        signs = F.translate(F.replace(plain, F.lit(UNSURE), F.lit(_KEPT)), PUNCTUATION, " " * len(PUNCTUATION))
        words = F.filter(F.split(F.replace(signs, F.lit(_KEPT), F.lit(UNSURE)), r"(?U)\s+"), lambda w: w != "")
        if variants:
            # Most texts have none of the misspelt words, so their words aren't looked up one by one.
            some = plain.rlike("|".join(re.escape(v.rstrip(".?")) for v in variants))
            words = F.when(some, F.transform(words, spelled)).otherwise(words)
        return F.array_join(words, " ")

    def flagged(s: Column) -> Column:
        checks = [deva(s["raw"]), F.contains(s["moved"], F.lit(NUKTA)), F.contains(s["moved"], F.lit(CANDRABINDU)), F.contains(s["plain"], F.lit("/"))]
        checks += [s["done"].rlike("[A-Za-z]"), s["done"].rlike("[0-9૦-૯]"), deva(s["done"])]
        return F.struct(s["done"].alias("text"), F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in zip(checks, FLAGS)])).alias("flags"))

    shifted = lambda raw: F.struct(raw.alias("raw"), F.when(deva(raw), devanagari_for_lexicon(raw)).otherwise(raw).alias("moved"))
    signed = lambda s: F.struct(s["raw"].alias("raw"), s["moved"].alias("moved"), F.replace(F.replace(s["moved"], F.lit(NUKTA), F.lit("")), F.lit(CANDRABINDU), F.lit(ANUSVARA)).alias("plain"))
    finished = lambda s: let(F.struct(s["raw"].alias("raw"), s["moved"].alias("moved"), s["plain"].alias("plain"), worded(s["plain"]).alias("done")), flagged)
    return let(nfc(F.coalesce(text, F.lit(""))), lambda raw: let(shifted(raw), lambda s: let(signed(s), finished)))


def read_lexicon(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(roman, guj)`` and ``(variant, guj)`` of a lexicon's ``n, line``: tab-separated, several values parted by bars.

    Blank lines and those that begin with ``##`` are left out, the first that remains is the heading,
    and of a value given twice the later line counts.
    """
    kept = lines.filter((strip(F.col("line")) != "") & ~F.col("line").startswith("##"))
    heading = kept.agg(F.min("n").alias("first"))
    cols = F.split("line", "\t")
    rows = kept.join(F.broadcast(heading), F.col("n") > F.col("first")).filter(F.size(cols) >= 2)
    rows = rows.select("n", F.lower(strip(cols[0])).alias("roman"), strip(cols[1]).alias("guj"), strip(F.coalesce(F.get(cols, F.lit(2)), F.lit(""))).alias("variants"))

    def values(column: str, name: str) -> DataFrame:
        each = rows.select("n", "guj", F.posexplode(F.split(column, r"\|")).alias("p", "v")).select("n", "p", "guj", strip(F.col("v")).alias(name)).filter(F.col(name) != "")
        return each.groupBy(name).agg(F.max_by("guj", F.struct("n", "p")).alias("guj"))

    return values("roman", "roman"), values("variants", "variant")


def looked_up(df: DataFrame, roman: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``guj``, what a lexicon ``roman, guj`` has for the roman text without case and blanks; null if it has nothing."""
    known = lexicon.select(F.col("roman").alias("__r"), "guj")
    return df.withColumn("__r", F.lower(strip(F.col(roman)))).join(known, "__r", "left").drop("__r")


def fold_variants(df: DataFrame, row_id: str, text: str, variants: DataFrame) -> DataFrame:
    """``row_id, text``: every word that is a known misspelling replaced, by a join with ``variant, guj``.

    The marks ``.`` and ``?`` at a word's end stay. For lexicons too long for a literal.
    """
    words = df.select(F.col(row_id), F.posexplode(F.split(strip(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+")).alias("p", "w"))
    bare = words.withColumn("variant", F.regexp_replace("w", r"[.?]+$", ""))
    joined = bare.join(variants, "variant", "left").withColumn("w", F.coalesce(F.concat("guj", F.expr("substring(w, length(variant) + 1)")), "w"))
    return joined.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias(text))


def audit(df: DataFrame, text: str, variants: dict[str, str] | None = None) -> DataFrame:
    """``checked, would_change, flagged``: what normalising a column would do to it."""
    n = df.filter(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(text).alias("raw"), normalise(F.col(text), variants).alias("n"))
    return n.agg(F.count("*").alias("checked"), F.count_if(F.col("n.text") != F.col("raw")).alias("would_change"), F.count_if(F.size("n.flags") > 0).alias("flagged"))
