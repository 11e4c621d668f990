"""Planning of ingest: what is done, ids, link kinds, pagination and clip plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seconds of a usable clip, and of a recording.
SHORTEST, LONGEST, LEAST_RECORDING = 2.0, 20.0, 0.4


def not_done(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """The rows whose key isn't done yet; the keys are made distinct before they are joined."""
    return df.join(done.select(on).filter(F.col(on).isNotNull()).distinct(), on, "left_anti")


def usable(duration: Column, shortest: float = SHORTEST, longest: float = LONGEST) -> Column:
    return F.coalesce(duration.between(shortest, longest), F.lit(False))


def recorded(df: DataFrame, duration: str = "duration") -> DataFrame:
    """Recordings that aren't too short to have been meant; unknown lengths are too short."""
    return df.filter(F.coalesce(F.col(duration) >= LEAST_RECORDING, F.lit(False)))


def id_title(line: Column) -> Column:
    """``struct<id, title>`` of a line, parted at the first tab; without one the title is empty."""
    parts = F.split(line, "\t", 2)
    return F.struct(F.trim(parts[0]).alias("id"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("title"))


def shortest_first(files: DataFrame, size: str = "size", name: str = "path") -> DataFrame:
    """Files in the order in which they are worked on; unknown sizes count as nothing."""
    return files.orderBy(F.coalesce(F.col(size), F.lit(0)), name)


def window_name(n: Column) -> Column:
    """The name of a card's window."""
    return F.format_string("c%02d", n)


def harvest_counts(index: DataFrame) -> DataFrame:
    """``n_videos, n_ok, n_cards``: what a harvest's index ``video_id, cards, status`` has."""
    return index.agg(F.count("*").alias("n_videos"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.coalesce(F.sum("cards"), F.lit(0)).cast("long").alias("n_cards"))


def url_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 12)


def prompt_id(speaker: Column, text: Column) -> Column:
    """A recording's id: the speaker's prefix and the digest of speaker and prompt."""
    return F.concat_ws("-", F.lit("selfrec"), F.substring(F.sha1(F.concat_ws("\n", speaker, text).cast("binary")), 1, 8))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def video_id(url: Column) -> Column:
    """The eleven characters of a video's id in a link; null if the link has none."""
    v = F.regexp_extract(url, r"(?:v=|youtu\.be/)([\w-]{11})", 1)
    return F.when(v != "", v)


def first_videos(links: DataFrame, url: str = "url", order: str = "n") -> DataFrame:
    """``video_id, n``: the distinct videos of a list of links and bare ids, each where it came first; playlists and channels have none of their own."""
    plain = F.trim(url)
    found = F.when(link_kind(plain) == "video", video_id(plain)).when((link_kind(plain) == "other") & (plain != ""), plain)
    return links.select(found.alias("video_id"), F.col(order).alias("n")).filter("video_id IS NOT NULL").groupBy("video_id").agg(F.min("n").alias("n"))


def link_kind(url: Column) -> Column:
    return F.when(url.contains("list=") | url.contains("/playlist"), "playlist").when(url.rlike(r"/(channel/|c/|user/|@)"), "channel").when(video_id(url).isNotNull(), "video").otherwise("other")


def pages(sites: DataFrame, url: str, most: int) -> DataFrame:
    """``url, page, page_url``: the pages of a site to be asked for, the first under its own address."""
    p = sites.select(url, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("page"))
    return p.withColumn("page_url", F.when(F.col("page") == 1, F.col(url)).otherwise(F.concat(F.regexp_replace(url, "/$", ""), F.lit("/page/"), F.col("page").cast("string"), F.lit("/"))))


def until_first_failure(fetched: DataFrame, site: str, page: str = "page", ok: str = "ok") -> DataFrame:
    """The pages of each site before its first failed one."""
    first = fetched.groupBy(site).agg(F.min(F.when(~F.col(ok), F.col(page))).alias("__stop"))
    return fetched.join(first, site).filter(F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))).drop("__stop")


def card_id(phrase: Column, repetition: Column) -> Column:
    return F.format_string("p%03d-r%d", phrase, repetition)


def phrase_of(card: Column) -> Column:
    """A card's phrase: what stands before the last repetition mark."""
    return F.regexp_replace(card, "-r(?!.*-r).*$", "")


def crop_height(height: Column) -> Column:
    """The even height of the part of a picture that is looked at."""
    return F.greatest(F.lit(2), (F.floor(F.floor(height * 0.86) / 2) * 2).cast("int"))


def clip_plan(segments: DataFrame) -> DataFrame:
    """Rows of a manifest for segments ``source_id, source_title, source_url, start, end, text``: what the cutter has to cut.

    Bounds are given to milliseconds, ids are digests of source and bounds, so planning again gives
    the same rows.
    """
    d = segments.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)}).withColumn("duration", F.round(F.col("end") - F.col("start"), 3)).filter(usable(F.col("duration")))
    name = F.concat_ws("-", "source_id", F.substring(F.sha1(F.concat_ws(":", "source_id", "start", "end").cast("binary")), 1, 8))
    d = d.withColumn("id", name)
    return d.select("id", F.concat(F.lit("clips/"), "id", F.lit(".wav")).alias("clip"), "source_id", "source_title", "source_url", "start", "end", "duration", F.col("text").alias("asr_draft"), F.lit("").alias("transcript"), F.lit("pending").alias("status"))
