"""Error rates, agreement of two hearings and its verdict, and string similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGREE_CER = 0.15
# Languages that aren't the target, and words that tell the target language from its neighbour.
NOT_TARGET = ("hindi", "english", "other", "nonspeech")
TARGET_MARKERS = "આઉં મૂં મુકે પાં અસાં અઈ આય થો થા થી વેંધો વેજનૂ વેરો અચિનૂ હાલ્યો હલ હેડા હેતે ભોલનૂ વેનો વેનનૂ જેંલા ચ્યાં બોલાયો અચો હલો".split()
NEIGHBOUR_MARKERS = "છે છીએ છો હતું હતી હતા નથી જણાવશો રહ્યું એટલે પરિસ્થિતિ કેટલું મહત્વ જીવનમાં સ્વભાવ ઘટના સંવાદદાતા દર્શકને જાણવા શકું".split()


def cer(a: Column, b: Column) -> Column:
    """Edits per character of the longer text: 0 for two empty ones, 1 if one is empty; null counts as empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((x == "") & (y == ""), 0.0).when((x == "") | (y == ""), 1.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def agreement(a: Column, b: Column) -> Column:
    """1 less the error rate, 0 unless both heard something."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), 1.0 - cer(a, b)).otherwise(0.0)


def neighbour_suspect(a: Column, b: Column, lang_a: Column, lang_b: Column) -> Column:
    """A mark of the neighbouring language, in words or a label, and no word of the target language."""
    words = F.regexp_extract_all(F.concat_ws(" ", a, b), F.lit(r"([\x{0A80}-\x{0AFF}]+)"), 1)
    has = lambda marks: F.arrays_overlap(words, F.array(*[F.lit(m) for m in marks]))
    labelled = F.coalesce(lang_a == "gujarati", F.lit(False)) | F.coalesce(lang_b == "gujarati", F.lit(False))
    return ~has(TARGET_MARKERS) & (has(NEIGHBOUR_MARKERS) | labelled)


def verdict(agreed: Column, suspect: Column, lang_a: Column, lang_b: Column) -> Column:
    """skip if both ears heard another language (one may have failed), lang-review, adjudicate or pending."""
    ears = F.array_compact(F.array(lang_a, lang_b))
    foreign = F.array(*[F.lit(x) for x in NOT_TARGET])
    skip = (F.size(F.array_except(ears, F.array_union(foreign, F.array(F.lit("error"))))) == 0) & F.arrays_overlap(ears, foreign)
    agree = agreed >= F.lit(1.0 - AGREE_CER)
    return F.when(skip, "skip").when(agree & suspect, "lang-review").when(agree, "adjudicate").otherwise("pending")


def word_edits(reference: Column, heard: Column) -> Column:
    """Edit distance in words: each distinct word of the pair becomes one code point of a private plane."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    a, b = split(reference), split(heard)
    known = F.array_distinct(F.concat(a, b))
    # UTF-16 code units from U+0100 on, passing over the surrogates.
    unit = lambda w: (F.array_position(known, w) + 255).cast("int")
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.when(unit(w) < 0xD800, unit(w)).otherwise(unit(w) + 0x800)), 4, "0")), "UTF-16BE")
    as_text = lambda words: F.array_join(F.transform(words, code), "")
    return F.levenshtein(as_text(a), as_text(b))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def error_rates(df: DataFrame, reference: str, heard: str) -> DataFrame:
    """``wer, cer``: percent of edits over all words and characters of the references (may exceed 100)."""
    r, h = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(heard), F.lit(""))
    sums = df.agg(F.sum(word_edits(r, h)).alias("we"), F.sum(word_count(r)).alias("wn"), F.sum(F.levenshtein(r, h)).alias("ce"), F.sum(F.length(r)).alias("cn"))
    rate = lambda e, n: F.round(F.coalesce(F.col(e), F.lit(0)) * 100.0 / F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(1)), 6)
    return sums.select(rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"))


def matching_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the matching letters over all letters, by longest matching blocks; the order of the two matters.

    Pairs that can't reach ``least``, as they haven't letters enough in common, give null.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            out: list[float | None] = []
            for p, q in zip(x, y):
                if p is None or q is None:
                    out.append(None)
                    continue
                common = sum(min(p.count(c), q.count(c)) for c in set(p))
                enough = not (p or q) or 2.0 * common >= least * (len(p) + len(q)) - 1e-9
                out.append(difflib.SequenceMatcher(None, p, q).ratio() if enough else None)
            yield pd.Series(out, dtype="float64")

    return ratio(a, b)
