"""Fuzzy alignment of phrases with timed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.lexicon import normalise
from corpusloom.functions.runs import similar
from corpusloom.functions.script import skeleton, skeleton_gujarati, skeleton_roman, skeletons
from corpusloom.functions.text import strip
from corpusloom.operators.consensus import REFUSED
from corpusloom.operators.segments import padded
from corpusloom.session import checkpoint

# Similarity, repetitions per phrase, bounds on a phrase's skeleton and on an aligned clip's seconds.
THRESHOLD, MOST_REPETITIONS = 0.75, 4
LEAST_SKELETON, ROMAN_RATIO, SPAN_RATIO = 4, 1.4, 2.0
LEAST_SECONDS, MOST_SECONDS = 0.5, 15.0
#: Words of a video, and skeletons, that are searched together, and positions in which lines and clips meet.
STRETCH, BLOCK, PAGE = 16384, 4096, 64


def alternates(field: Column) -> Column:
    """The parts of a field between slashes, without what stands in parentheses; empty ones left out."""
    parts = F.split(F.regexp_replace(F.coalesce(field, F.lit("")), r"\([^)]*\)", " "), "/")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def variants(phrases: DataFrame) -> DataFrame:
    """``id, video_id, vi, guj, roman``: each alternate with the roman of its place, else the first, else none."""
    roman = alternates(F.col("kutchi_roman"))
    p = phrases.select("id", "video_id", roman.alias("rom"), F.posexplode(alternates(F.col("kutchi_guj"))).alias("vi", "guj"))
    p = p.withColumn("roman", F.coalesce(F.get("rom", F.col("vi")), F.get("rom", F.lit(0)), F.lit("")))
    return p.select("id", "video_id", "vi", "guj", "roman")


def probes(phrases: DataFrame) -> DataFrame:
    """``id, video_id, vi, guj, roman, k, skel``: the skeletons by which an alternate is looked for.

    The Gujarati one if it is long enough, and the roman one if it is and isn't far longer than the
    Gujarati, so that both stand for the same phrase. ``k`` numbers a phrase's skeletons in order.
    """
    g, r = skeleton_gujarati(F.col("guj")), skeleton_roman(F.col("roman"))
    v = variants(phrases).withColumns({"g": g, "r": r})
    of_guj = F.when(F.length("g") >= LEAST_SKELETON, F.struct(F.lit(0).alias("second"), F.col("g").alias("skel")))
    of_roman = F.when((F.length("r") >= LEAST_SKELETON) & (F.col("g") != "") & (F.length("r") <= ROMAN_RATIO * F.length("g")), F.struct(F.lit(1).alias("second"), F.col("r").alias("skel")))
    d = v.select("id", "video_id", "vi", "guj", "roman", F.explode(F.array_compact(F.array(of_guj, of_roman))).alias("p")).select("id", "video_id", "vi", "guj", "roman", "p.*")
    place = F.row_number().over(Window.partitionBy("id").orderBy("vi", "second")) - 1
    return d.withColumn("k", place).drop("second")


def lines(words: DataFrame) -> DataFrame:
    """``video_id, pos, n, text, s, e``: words ``w``, or lists ``ws`` of words without blanks that follow one another evenly from ``s`` to ``e``, as texts of n words."""
    times = [c for c in ("s", "e") if c in words.columns]
    if "ws" in words.columns:
        return words.filter(F.size("ws") > 0).select("video_id", "pos", F.size("ws").alias("n"), F.array_join("ws", " ").alias("text"), *times)
    return words.select("video_id", "pos", F.lit(1).alias("n"), F.col("w").alias("text"), *times)


def texts(words: DataFrame, blocks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The words that have a skeleton, of the videos of ``video_id, blocks``, in pages ``video_id, page, ws, start, n, size, end, blocks``; and ``video_id, parts``.

    ``start`` numbers a page's first such word in its video of ``n``, ``end`` is the video's end, and ``size`` how
    many of them make a part. They are counted first, so that what is moved is each line once.
    """
    size = max(STRETCH, int(1.8 * most + 3))
    d = lines(words).withColumn("skels", F.when(F.col("n") == 1, skeleton(F.col("text"))).otherwise(skeletons(F.col("text")))).withColumn("page", F.floor(F.col("pos") / STRETCH))
    some = F.when(F.col("skels") == "", 0).otherwise(F.size(F.filter(F.split("skels", " "), lambda w: w != "")))
    by = Window.partitionBy("video_id")
    before = F.coalesce(F.sum("n").over(by.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = d.groupBy("video_id", "page").agg(F.sum(some).alias("n"), F.max(F.col("pos") + F.col("n")).alias("upto"))
    numbers = counts.select("video_id", "page", before.alias("start"), F.sum("n").over(by).alias("n"), F.max("upto").over(by).cast("int").alias("end"))
    numbers = checkpoint(numbers.join(blocks, "video_id").filter("n > 0").withColumn("size", F.lit(size)))
    parts = numbers.select("video_id", (F.floor((F.col("n") - 1) / size) + 1).alias("parts")).distinct()
    pages = d.filter("skels <> ''").groupBy("video_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "skels"))).alias("ls"))
    placed = F.flatten(F.transform("ls", lambda x: F.transform(F.split(x["skels"], " "), lambda w, k: F.struct((x["pos"] + k).cast("int").alias("pos"), w.alias("s")))))
    return pages.join(numbers, ["video_id", "page"]).withColumn("ws", F.filter(placed, lambda w: w["s"] != "")).drop("ls"), parts


def hits(phrases: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, k, score, i, j, span``: the runs of words similar enough to a phrase's skeleton, without those that can't be picked.

    A run ends before its skeleton exceeds 1.8 times the phrase's longest, plus 3 letters. Words
    without a skeleton add nothing: of the runs that differ by them alone the one that begins with
    a letter and takes in what follows would be picked, so only that is looked at. So a run has as many
    words as letters at most. A video's words are cut into parts, each with the words that its last runs may
    need, and its skeletons into blocks; no pair is written, each part is searched for each block in one row.
    """
    v = probes(phrases).withColumn("target", F.max(F.length("skel")).over(Window.partitionBy("id")))
    most = v.agg(F.max("target")).first()[0] or 0
    longest = int(1.8 * most + 3)
    blocks = v.groupBy("video_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    pages, parts = texts(words, blocks, most)
    p = v.join(blocks, "video_id").join(parts, "video_id").withColumn("block", F.pmod(F.xxhash64("skel"), "blocks"))
    p = p.groupBy("video_id", "block", "parts").agg(F.sort_array(F.collect_list(F.struct("skel", "target", "id", F.col("k").cast("int").alias("k")))).alias("ps"))
    p = p.select("video_id", "block", "ps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # Of each page what a part needs: its own words, and as many behind them as a run can have.
    size, start, here = F.col("size"), F.col("start"), F.size("ws")
    t = pages.withColumn("part", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(start / size) - 1), F.floor((start + here - 1) / size))))
    low, high = F.greatest(F.col("part") * size, start), F.least((F.col("part") + 1) * size + longest, start + here)
    t = t.filter(high > low).withColumns({"low": low, "ws": F.slice("ws", (low - start + 1).cast("int"), (high - low).cast("int"))})
    t = t.select("video_id", "part", "low", "n", "end", "size", F.array_join("ws.s", " ").alias("text"), F.col("ws.pos").alias("pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    t = t.groupBy("video_id", "part", "block").agg(F.sort_array(F.collect_list(F.struct("low", "text", "pos"))).alias("s"), F.first("n").alias("n"), F.first("end").alias("end"), F.first("size").alias("size"))
    cells = t.join(p, ["video_id", "part", "block"]).select("part", "size", "n", "end", F.array_join("s.text", " ").alias("text"), F.flatten("s.pos").alias("pos"), F.array_join("ps.skel", " ").alias("skels"), F.col("ps.target").alias("targets"), F.col("ps.id").alias("ids"), F.col("ps.k").alias("ks"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "k", "score", "i", "j", "span"]
        for batch in batches:
            for c in batch.itertuples():
                named: dict[tuple[str, int], list[tuple[int, int]]] = {}
                for skel, target, who, k in zip(c.skels.split(" "), c.targets.tolist(), c.ids.tolist(), c.ks.tolist()):
                    named.setdefault((skel, target), []).append((who, k))
                wanted, pos = list(named), c.pos
                upto = np.append(pos[1:], c.end)
                own = min(c.size, len(pos))
                found = similar([x for x, _ in wanted], [x for _, x in wanted], c.text.split(" "), own, threshold, MOST_REPETITIONS)
                out = [(who, k, score, pos[a], upto[b], span) for x, score, a, b, span in found for who, k in named[wanted[x]]]
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return cells.mapInPandas(search, f"id {dict(v.dtypes)['id']}, k int, score double, i int, j int, span string")


def matches(phrases: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, r, score, i, j, k, span``: up to four spans per phrase that are similar enough and don't overlap, best first.

    Of equal scores the later start wins, then the longer run, then the later skeleton of the phrase.
    """
    found = hits(phrases, words, threshold).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("score", "i", "j", "k", "span")), asc=False).alias("h"))
    free = lambda kept, x: ~F.exists(kept, lambda m: (x["i"] < m["j"]) & (m["i"] < x["j"])) & (F.size(kept) < MOST_REPETITIONS)
    empty = F.array().cast("array<struct<score:double,i:int,j:int,k:int,span:string>>")
    picked = F.aggregate("h", empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return found.select("id", F.posexplode(picked).alias("p", "m")).select("id", (F.col("p") + 1).alias("r"), "m.*")


def judged(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Matches with ``guj, roman, transcript, refused`` (the flags for which the text can't be a transcript, if any) and without spans far longer than the text."""
    named = found.join(probes(phrases).select("id", "video_id", "k", "guj", "roman"), ["id", "k"])
    n = named.filter(F.length("span") <= SPAN_RATIO * F.greatest(F.lit(1), F.length(skeleton_gujarati(F.col("guj"))))).withColumn("n", normalise(F.col("guj")))
    refused = F.arrays_overlap("n.flags", F.array(*[F.lit(x) for x in REFUSED])) | (F.col("n.text") == "")
    return n.withColumns({"transcript": F.col("n.text"), "refused": F.when(refused, F.array_join("n.flags", ","))}).drop("n")


def report(found: DataFrame, phrases: DataFrame, of_matches: DataFrame | None = None) -> DataFrame:
    """``id, video_id, reason, kutchi_guj``: phrases without a usable skeleton, without a match, and matches refused for their text."""
    told = phrases.select("id", "video_id", "kutchi_guj").dropDuplicates(["id"])
    usable, met = probes(phrases).select("id").distinct(), found.select("id").distinct()
    none = told.join(usable, "id", "left_anti").withColumn("reason", F.lit("no-usable-skeleton"))
    unmatched = told.join(usable, "id", "left_semi").join(met, "id", "left_anti").withColumn("reason", F.lit("no-match"))
    bad = (judged(found, phrases) if of_matches is None else of_matches).filter(F.col("refused").isNotNull()).select("id", "video_id", F.col("guj").alias("kutchi_guj"), F.concat(F.lit("bad-transcript:"), "refused").alias("reason"))
    return none.unionByName(unmatched).unionByName(bad).select("id", "video_id", "reason", "kutchi_guj")


def clips(found: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows of a manifest for the matches: padded clips whose text, span and length are in bounds.

    ``id, clip, source_id, phrase, r, start, end, duration, asr_draft, transcript, roman, status, verified_by,
    confidence``. Repetition numbers were given before the gates, so there may be gaps.
    """
    timed = judged(found, phrases).filter(F.col("refused").isNull())
    # Lines and words meet in pages of few words, so a line is moved as it is.
    page = lambda c: F.floor(c / PAGE)
    sought = timed.select("id", "k", "video_id", "i", "j", F.explode(F.sequence("i", F.col("j") - 1)).alias("pos")).withColumn("page", page(F.col("pos")))
    first, n = F.col("pos"), F.col("n")
    told = lines(words).select("video_id", first.alias("first"), "n", "text", "s", "e", F.explode(F.sequence(page(first), page(first + n - 1))).alias("page"))
    at = F.col("pos") - F.col("first")
    each = (F.col("e") - F.col("s")) / n
    heard = sought.join(told, ["video_id", "page"]).filter((at >= 0) & (at < n)).select(
        "id", "k", "i", "j", "pos", F.when(n == 1, F.col("text")).otherwise(F.get(F.split("text", " "), at.cast("int"))).alias("w"),
        (F.col("s") + at * each).alias("s"), F.when(at == n - 1, F.col("e")).otherwise(F.col("s") + (at + 1) * each).alias("e"),
    )
    said = heard.groupBy("id", "k", "i", "j").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("asr_draft"), F.min_by("s", "pos").alias("ws"), F.max_by("e", "pos").alias("we"))
    start, end = padded(F.col("ws"), F.col("we"))
    d = timed.join(said, ["id", "k", "i", "j"]).withColumns({"s": start, "e": end}).filter((F.col("e") - F.col("s")).between(LEAST_SECONDS, MOST_SECONDS))
    name = F.format_string("%s-p%03d-r%d", "video_id", "id", "r")
    return d.select(
        F.concat(F.lit("card-"), name).alias("id"), F.concat(F.lit("card_"), F.format_string("%s_p%03d_r%d", "video_id", "id", "r"), F.lit(".wav")).alias("clip"), F.col("video_id").alias("source_id"), F.col("id").alias("phrase"), "r",
        F.round("s", 2).alias("start"), F.round("e", 2).alias("end"), F.round(F.col("e") - F.col("s"), 2).alias("duration"), "asr_draft", "transcript", "roman",
        F.lit("verified").alias("status"), F.lit("machine-card").alias("verified_by"), F.round("score", 3).alias("confidence"),
    )
