"""Queries of curation: merging, freezing, verification, intervals, alignment and the desk; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import metrics
from corpusloom.functions.script import skeleton_gujarati
from corpusloom.operators import align, consensus, corpus, curate, desk, freeze, ingest, segments
from corpusloom.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]
EVAL_MINUTES = 20.0


def _verified(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verified")


def _state(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "machine_verify_state")


def _good(s: SparkSession, d: str) -> DataFrame:
    return curate.accepted(_verified(s, d))


# ---- merging ----


def minutes_by_source_tier(s, d):
    """Minutes and rows that can be used, per source and tier."""
    return curate.minutes_by_source_tier(_verified(s, d))


def input_counts(s, d):
    """Rows and usable rows per track."""
    ok = curate.trainable() & curate.rejection().isNull()
    return _verified(s, d).groupBy("track").agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_kept"))


def rejects(s, d):
    """Trainable rows that can't be used, with the reason."""
    return _verified(s, d).filter(curate.trainable()).select("row_no", curate.rejection().alias("reason")).filter("reason IS NOT NULL")


def reject_counts(s, d):
    """Rows per reason of rejection."""
    return rejects(s, d).groupBy("reason").agg(F.count("*").alias("n_rows"))


def total_minutes(s, d):
    """All usable minutes."""
    return _good(s, d).agg(curate.minutes().alias("minutes"), F.count("*").alias("n_rows"))


def dedup_tiered(s, d):
    """One row per id, then per span, by tier."""
    return curate.dedup_tiered(_good(s, d), ["row_no"]).select("row_no", "id", "source_id", "tier")


def dedup_sequential(s, d):
    """The rows that a pass in order of row_no keeps."""
    return curate.dedup_sequential(_good(s, d), "row_no")


def merged_sorted(s, d):
    """The merged table's order: source, start, id."""
    return curate.dedup_tiered(_good(s, d), ["row_no"]).select("row_no", "source_id", F.coalesce("start", F.lit(0.0)).alias("start")).orderBy("source_id", "start", "row_no")


def drift_audit(s, d):
    """Usable rows whose transcript isn't as the convention has it."""
    return curate.drift(_good(s, d), "row_no", "transcript").select("row_no", "normal", F.array_join("flags", ",").alias("flags"))


# ---- freezing ----


def eval_split_source(s, d):
    """Sources held out for evaluation."""
    return freeze.eval_sources(_good(s, d), EVAL_MINUTES).select("source_id", F.round("minutes", 6).alias("minutes"))


def eval_split_clip(s, d):
    """Clips held out for evaluation."""
    return freeze.eval_clips(_good(s, d), EVAL_MINUTES).select("id", F.round("minutes", 6).alias("minutes"))


def train_minus_eval(s, d):
    """Rows left for training once the sources are held out."""
    good = _good(s, d)
    return freeze.train_rows(good, freeze.eval_sources(good, EVAL_MINUTES), "source_id").select("row_no", "id", "source_id")


def split_leak(s, d):
    """Sources in both parts: none."""
    good = _good(s, d)
    held = freeze.eval_sources(good, EVAL_MINUTES)
    return freeze.leaks(freeze.train_rows(good, held, "source_id"), held, "source_id")


def split_mode(s, d):
    """Whether to split by source or clip."""
    return freeze.mode(_good(s, d))


def eval_guard_counts(s, d):
    """What the guard before training excludes."""
    good = _good(s, d)
    return freeze.guard_counts(good, freeze.eval_clips(good, EVAL_MINUTES))


def clip_resolve(s, d):
    """The file of each manifest row: the verified track's folder first, then the state's."""
    folder = lambda df, j, name: df.select(F.concat(F.lit("clips/"), "id", F.lit(".wav")).alias("clip"), F.lit(j).alias("folder_ord"), F.concat(F.lit(f"{name}/"), "id", F.lit(".wav")).alias("path"))
    files = folder(_verified(s, d), 0, "a").unionByName(folder(_state(s, d), 1, "b")).filter("clip IS NOT NULL")
    m = table(s, d, "manifest").select("id", "clip")
    return freeze.resolve_files(m, files).groupBy("path").agg(F.count("*").alias("n_rows"))


def done_anti_join(s, d):
    """Rows of manifest whose source hasn't been verified at all."""
    return ingest.not_done(table(s, d, "manifest"), _verified(s, d), "source_id").groupBy("source_id").agg(F.count("*").alias("n_rows"))


def duration_gate(s, d):
    """Rows of manifest by the duration gates of ingest and alignment."""
    a, b = ingest.usable(F.col("duration")), ingest.usable(F.col("duration"), align.LEAST_SECONDS, align.MOST_SECONDS)
    return table(s, d, "manifest").groupBy(a.alias("for_ingest"), b.alias("for_alignment")).agg(F.count("*").alias("n_rows"))


# ---- verification ----


def state_last_wins(s, d):
    """The latest state of each id."""
    return consensus.last_state(_state(s, d)).select("id", "seq", "mv_verdict")


def requeue_errors(s, d):
    """Latest states in which an ear failed."""
    return consensus.failed(consensus.last_state(_state(s, d))).select("id", "seq")


def pending_unseen(s, d):
    """Pending rows of manifest that the state doesn't have."""
    return consensus.pending(table(s, d, "manifest"), _state(s, d)).select("id").distinct()


def agreement_scores(s, d):
    """Agreement of both ears and its verdict."""
    return consensus.scored(_state(s, d)).select("seq", "score", "suspect", "verdict")


def agreement_skeletons(s, d):
    """Agreement of both ears by sound classes."""
    a, b = (skeleton_gujarati(F.coalesce(c, F.lit(""))) for c in ("hyp_a", "hyp_b"))
    return _state(s, d).select("seq", F.round(metrics.agreement(a, b), 6).alias("score"))


def lang_gate(s, d):
    """Rows that read as the neighbouring language."""
    return _state(s, d).select("seq", F.coalesce(metrics.neighbour_suspect(F.col("hyp_a"), F.col("hyp_b"), F.col("lang_a"), F.col("lang_b")), F.lit(False)).alias("suspect"))


def verdict_counts(s, d):
    """Rows per recorded verdict."""
    return _state(s, d).groupBy("mv_verdict").agg(F.count("*").alias("n_rows"))


def adjudication_batches(s, d):
    """Batches of what is to be adjudicated and isn't verified."""
    return consensus.batches(_state(s, d), _verified(s, d).select("id"))


def apply_decisions(s, d):
    """Rows added if every adjudicated row were accepted as ear A heard it."""
    state = _state(s, d)
    decisions = consensus.last_state(state).filter("mv_verdict = 'adjudicate'").select("id", F.col("hyp_a").alias("transcript"), F.lit("verified").alias("status"))
    return consensus.apply_decisions(state, decisions, _verified(s, d).select("id")).select("id", "transcript", "status", "verified_by", "confidence")


def cer_micro(s, d):
    """Error rate of ear A's sound classes against the transcript's, over all characters."""
    x = _state(s, d).select(skeleton_gujarati(F.coalesce("transcript", F.lit(""))).alias("r"), skeleton_gujarati(F.coalesce("hyp_a", F.lit(""))).alias("h"))
    n = x.agg(F.sum(F.levenshtein("r", "h")).alias("e"), F.sum(F.length("r")).alias("n"))
    return n.select(F.round(F.col("e") * 100.0 / F.greatest("n", F.lit(1)), 6).alias("cer"))


def error_rates(s, d):
    """Word and character error rates of ear A against the transcript."""
    return metrics.error_rates(_state(s, d), "transcript", "hyp_a")


# ---- time series and alignment ----


def chroma_segments(s, d):
    """Change points of each user's event values."""
    ev = table(s, d, "events").select("user_id", "ts", "event_id", F.col("value"), F.lit(0.0).alias("v"))
    return segments.change_points(ev, "user_id", ["ts", "event_id"], "ts", ["value", "v"], 100.0)


def card_picks(s, d):
    """Segments of six seconds or more, and the time of their frame."""
    seg = chroma_segments(s, d).select("user_id", "seg", F.unix_timestamp(F.col("seg_start").cast("timestamp")).cast("double").alias("a"), F.unix_timestamp(F.col("seg_end").cast("timestamp")).cast("double").alias("b"))
    return seg.filter(F.col("b") - F.col("a") >= segments.LEAST_SECONDS).select("user_id", "seg", F.round(segments.frame_time(F.col("a"), F.col("b")), 2).alias("frame_t"))


def card_clip_overlap(s, d):
    """For each clip of the state, how many clips of manifest overlap it."""
    name = F.lower(F.trim("source_id"))
    w = _state(s, d).select(name.alias("e"), F.col("seq").alias("w"), F.col("start").alias("ws"), F.col("end").alias("we"))
    c = table(s, d, "manifest").select(name.alias("e"), "id", F.col("id").alias("ord"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    return segments.overlapping(w, c, "e", 60.0).select("w", "n")


def _phrases(s, d):
    return corpus.first_wins(table(s, d, "phrasebook"), "id", ["video_id", "kutchi_guj", "kutchi_roman", "english", "source_url"])


def _words(s, d):
    """The words of each source's manifest drafts end to end, half a second each, as lists."""
    m = table(s, d, "manifest").filter("asr_draft IS NOT NULL AND source_id IS NOT NULL").select("source_id", "start", "id", "ingested_at", "asr_draft")
    # Numbers of words in two levels, by minutes of the source and inside them; drafts are parted after they are moved.
    m = m.withColumn("b", F.floor(F.coalesce("start", F.lit(-60.0)) / 60))
    ws = F.filter(F.split("asr_draft", r"\s+"), lambda w: w != "")
    totals = m.groupBy("source_id", "b").agg(F.sum(F.size(ws)).alias("t"))
    m = m.repartition("source_id", "b").select("source_id", "b", "start", "id", "ingested_at", ws.alias("ws")).withColumn("n", F.size("ws"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("source_id", "b").orderBy("start", "id", "ingested_at", "ws").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = m.withColumn("inside", inside).join(totals.select("source_id", "b", before.alias("past")), ["source_id", "b"])
    first = (F.col("past") + F.col("inside")).cast("int")
    return placed.select(F.col("source_id").alias("video_id"), first.alias("pos"), "ws", (first * 0.5).alias("s"), ((first + F.col("n")) * 0.5).alias("e"))


def fuzzy_align(s, d):
    """Up to four clips of each phrase in its source's words, as rows of a manifest."""
    p = _phrases(s, d)
    words = _words(s, d)
    return align.clips(checkpoint(align.matches(p, words)), words, p)


def matched_phrases(s, d):
    """How many phrases have a clip, and how many clips there are."""
    return fuzzy_align(s, d).agg(F.countDistinct(ingest.phrase_of(F.col("id"))).alias("n_phrases"), F.count("*").alias("n_clips"))


def alternates_zip(s, d):
    """Alternates of each phrase with the roman of their place."""
    return align.variants(_phrases(s, d)).select("id", "vi", "guj", "roman")


def align_probes(s, d):
    """The skeletons by which each phrase is looked for."""
    return align.probes(_phrases(s, d)).select("id", "vi", F.col("k").cast("int").alias("k"), "skel")


def align_report(s, d):
    """Phrases that couldn't be aligned, and why."""
    p = _phrases(s, d)
    return align.report(checkpoint(align.matches(p, _words(s, d))), p)


# ---- the desk ----


def _saved(s, d):
    return _verified(s, d).filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*desk.SAVED), "row_no").alias("k")).select("id", "k.*")


def _desk(s, d):
    first = table(s, d, "manifest").groupBy("id").agg(F.min_by(F.struct("clip", "source_id", "duration", *desk.SAVED), F.struct("ingested_at", "start", "duration", "transcript", "notes")).alias("k")).select("id", "k.*")
    return desk.overlay(first, _saved(s, d))


def desk_overlay(s, d):
    """Rows per status once saved corrections are laid over the manifest."""
    return _desk(s, d).groupBy("status").agg(F.count("*").alias("n_rows"))


def desk_progress(s, d):
    """Progress of the desk over the verified rows."""
    return desk.progress(_verified(s, d))


def desk_export(s, d):
    """The verified export."""
    return desk.export_verified(_verified(s, d))


def next_pending(s, d):
    """The first state row after 100 that is pending."""
    return desk.next_pending(_state(s, d).select("seq", F.col("mv_verdict").alias("status")), "seq", 100)


def clock_labels(s, d):
    """Starts as minutes and seconds."""
    return _verified(s, d).select("row_no", desk.clock(F.col("start")).alias("label"))


# ---- SQL ----

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_GOOD = (
    r"""
WITH gated AS (
  SELECT *, CASE WHEN coalesce(verified_by, '') = '' THEN 'human' ELSE verified_by END AS tier FROM verified
  WHERE status = 'verified' AND """
    + _TRIM.format("coalesce(transcript, '')")
    + r""" <> ''
), checked AS (
  SELECT *, CASE WHEN coalesce(source_id, '') = '' OR (coalesce(source_url, '') = '' AND NOT starts_with(source_id, 'selfrec')) THEN 'missing-provenance'
                 WHEN tier NOT IN ('human', 'machine-card', 'machine-consensus') THEN 'unknown-tier:' || tier END AS reason FROM gated
), good AS (SELECT * FROM checked WHERE reason IS NULL)"""
)
_DEDUP = (
    _GOOD
    + r""", ranked AS (SELECT *, CASE tier WHEN 'human' THEN 0 WHEN 'machine-card' THEN 1 ELSE 2 END AS r FROM good),
by_id AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, row_no) AS n FROM ranked),
by_span AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, ''), round(coalesce(start, 0), 1), round(coalesce("end", 0), 1) ORDER BY r, row_no) AS m FROM by_id WHERE n = 1),
kept AS (SELECT * FROM by_span WHERE m = 1)"""
)
_EVAL_SOURCES = (
    _GOOD
    + f""", by_source AS (SELECT source_id, sum(coalesce(duration, 0)) / 60.0 AS minutes, sha1('eval-v1:' || source_id) AS h FROM good GROUP BY source_id),
summed AS (SELECT *, coalesce(sum(minutes) OVER (ORDER BY h, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM by_source),
held AS (SELECT source_id, minutes FROM summed WHERE before < {EVAL_MINUTES})"""
)
_EVAL_CLIPS = (
    _GOOD
    + f""", by_clip AS (SELECT id, sum(coalesce(duration, 0)) / 60.0 AS minutes, sha1('eval-v1:' || id) AS h FROM good GROUP BY id),
summed AS (SELECT *, coalesce(sum(minutes) OVER (ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM by_clip),
held AS (SELECT id, minutes FROM summed WHERE before < (SELECT least({EVAL_MINUTES}, sum(minutes) * 0.15) FROM by_clip))"""
)
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM machine_verify_state) WHERE n = 1)"


def _skeleton_sql(column: str) -> str:
    from corpusloom.functions.script import SKELETON_CLASSES

    letters = [(c, k) for k, cs in SKELETON_CLASSES.items() for c in cs]
    both = letters + [(chr(ord(c) - 0x180), k) for c, k in letters]
    known = "".join(c for c, _ in both)
    return f"translate(regexp_replace(coalesce({column}, ''), '[^{known}]', '', 'g'), '{known}', '{''.join(k for _, k in both)}')"


def _marks(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _alternates_sql(column: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({column}, ''), '\([^)]*\)', ' ', 'g'), '/'), lambda p: regexp_replace(p, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda p: p <> '')"


_SUSPECT = rf"""
SELECT seq, NOT list_has_any(words, {_marks(metrics.TARGET_MARKERS)})
       AND (list_has_any(words, {_marks(metrics.NEIGHBOUR_MARKERS)}) OR coalesce(lang_a = 'gujarati', false) OR coalesce(lang_b = 'gujarati', false)) AS suspect
FROM (SELECT *, regexp_extract_all(concat_ws(' ', hyp_a, hyp_b), '[\x{{0A80}}-\x{{0AFF}}]+') AS words FROM machine_verify_state)"""

_SEGMENTS = """
WITH stepped AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 100.0 AS new FROM events),
numbered AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM stepped),
segs AS (SELECT user_id, CAST(seg AS BIGINT) AS seg, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_samples FROM numbered GROUP BY 1, 2)"""

_SKEL_A, _SKEL_B, _SKEL_T = _skeleton_sql("hyp_a"), _skeleton_sql("hyp_b"), _skeleton_sql("transcript")

ORACLE = {
    "minutes_by_source_tier": _GOOD + " SELECT source_id, tier, round(sum(coalesce(duration, 0)) / 60.0, 6) AS minutes, count(*) AS n_rows FROM good GROUP BY 1, 2",
    "input_counts": _GOOD + " SELECT v.track, count(*) AS n_rows, count(g.row_no) AS n_kept FROM verified v LEFT JOIN good g ON v.row_no = g.row_no GROUP BY 1",
    "rejects": _GOOD + " SELECT row_no, reason FROM checked WHERE reason IS NOT NULL",
    "reject_counts": _GOOD + " SELECT reason, count(*) AS n_rows FROM checked WHERE reason IS NOT NULL GROUP BY 1",
    "total_minutes": _GOOD + " SELECT round(sum(coalesce(duration, 0)) / 60.0, 6) AS minutes, count(*) AS n_rows FROM good",
    "dedup_tiered": _DEDUP + " SELECT row_no, id, source_id, tier FROM kept",
    "dedup_sequential": _GOOD.replace("WITH gated", "WITH RECURSIVE gated", 1)
    + """, rows AS (SELECT row_number() OVER (ORDER BY row_no) AS n, row_no, id, CASE tier WHEN 'human' THEN 0 WHEN 'machine-card' THEN 1 ELSE 2 END AS r, 'i' || coalesce('=' || id, '') AS i,
  'p' || coalesce(source_id, '') || chr(9) || round(coalesce(start, 0), 1) || chr(9) || round(coalesce("end", 0), 1) AS p FROM good),
fold AS (
  SELECT CAST(0 AS BIGINT) AS n, MAP {'': {'r': CAST(0 AS INT), 'row_no': CAST(-1 AS BIGINT)}} AS held
  UNION ALL SELECT rows.n, CASE WHEN coalesce(rows.r < held[i].r, TRUE) AND coalesce(rows.r < held[p].r, TRUE) THEN map_concat(held, MAP {i: {'r': CAST(rows.r AS INT), 'row_no': row_no}, p: {'r': CAST(rows.r AS INT), 'row_no': row_no}}) ELSE held END
  FROM fold JOIN rows ON rows.n = fold.n + 1
), done AS (SELECT arg_max(held, n) AS held FROM fold)
SELECT row_no, id FROM rows, done WHERE held[i].row_no = row_no AND held[p].row_no = row_no""",
    "merged_sorted": _DEDUP + " SELECT row_no, source_id, coalesce(start, 0) AS start FROM kept ORDER BY 2, 3, 1",
    "eval_split_source": _EVAL_SOURCES + " SELECT source_id, round(minutes, 6) AS minutes FROM held",
    "eval_split_clip": _EVAL_CLIPS + " SELECT id, round(minutes, 6) AS minutes FROM held",
    "train_minus_eval": _EVAL_SOURCES + " SELECT row_no, id, source_id FROM good WHERE source_id NOT IN (SELECT source_id FROM held)",
    "split_leak": _EVAL_SOURCES + " SELECT count(*) AS n_leaks FROM held WHERE source_id IN (SELECT source_id FROM good WHERE source_id NOT IN (SELECT source_id FROM held))",
    "split_mode": _GOOD + " SELECT count(DISTINCT source_id) AS n_sources, CASE WHEN count(DISTINCT source_id) >= 2 THEN 'source' ELSE 'clip' END AS mode FROM good",
    "eval_guard_counts": _EVAL_CLIPS + " SELECT count(*) AS n_rows, count(held.id) AS n_excluded, count(*) - count(held.id) AS n_train FROM good LEFT JOIN held ON good.id = held.id",
    "clip_resolve": """
WITH files AS (SELECT DISTINCT 'clips/' || id || '.wav' AS clip, 0 AS o, 'a/' || id || '.wav' AS path FROM verified WHERE id IS NOT NULL
  UNION SELECT DISTINCT 'clips/' || id || '.wav', 1, 'b/' || id || '.wav' FROM machine_verify_state WHERE id IS NOT NULL),
first AS (SELECT clip, arg_min(path, o) AS path FROM files GROUP BY clip)
SELECT path, count(*) AS n_rows FROM manifest LEFT JOIN first USING (clip) GROUP BY path""",
    "done_anti_join": "SELECT source_id, count(*) AS n_rows FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM verified v WHERE v.source_id = m.source_id) GROUP BY 1",
    "duration_gate": "SELECT coalesce(duration BETWEEN 2.0 AND 20.0, false) AS for_ingest, coalesce(duration BETWEEN 0.5 AND 15.0, false) AS for_alignment, count(*) AS n_rows FROM manifest GROUP BY 1, 2",
    "state_last_wins": f"WITH {_LAST} SELECT id, seq, mv_verdict FROM last",
    "requeue_errors": f"WITH {_LAST} SELECT id, seq FROM last WHERE lang_a = 'error' OR lang_b = 'error'",
    "pending_unseen": "SELECT DISTINCT id FROM manifest WHERE status = 'pending' AND id NOT IN (SELECT id FROM machine_verify_state WHERE id IS NOT NULL)",
    "agreement_skeletons": f"""
SELECT seq, round(CASE WHEN a <> '' AND b <> '' THEN 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) ELSE 0.0 END, 6) AS score
FROM (SELECT seq, {_SKEL_A} AS a, {_SKEL_B} AS b FROM machine_verify_state)""",
    "lang_gate": _SUSPECT,
    "verdict_counts": "SELECT mv_verdict, count(*) AS n_rows FROM machine_verify_state GROUP BY 1",
    "adjudication_batches": """
SELECT CAST((row_number() OVER (ORDER BY seq) - 1) // 40 AS BIGINT) AS batch, seq, id FROM machine_verify_state
WHERE mv_verdict = 'adjudicate' AND id NOT IN (SELECT id FROM verified WHERE id IS NOT NULL)""",
    "cer_micro": f"SELECT round(sum(levenshtein(r, h)) * 100.0 / greatest(sum(length(r)), 1), 6) AS cer FROM (SELECT {_SKEL_T} AS r, {_SKEL_A} AS h FROM machine_verify_state)",
    "chroma_segments": _SEGMENTS + " SELECT * FROM segs",
    "card_picks": _SEGMENTS
    + " , cut AS (SELECT user_id, seg, CAST(floor(epoch(seg_start)) AS DOUBLE) AS a, CAST(floor(epoch(seg_end)) AS DOUBLE) AS b FROM segs) SELECT user_id, seg, round(a + 0.6 * (b - a), 2) AS frame_t FROM cut WHERE b - a >= 6.0",
    "card_clip_overlap": """
SELECT w.seq AS w, CAST(count(c.id) AS INT) AS n FROM machine_verify_state w
LEFT JOIN manifest c ON lower(trim(c.source_id)) = lower(trim(w.source_id)) AND c.start < w."end" AND c."end" > w.start AND c."end" > c.start AND w."end" > w.start
GROUP BY w.seq""",
    "alternates_zip": f"""
WITH once AS (SELECT DISTINCT id, kutchi_guj, kutchi_roman FROM phrasebook),
a AS (SELECT id, {_alternates_sql("kutchi_guj")} AS g, {_alternates_sql("kutchi_roman")} AS r FROM once),
e AS (SELECT id, unnest(range(len(g))) AS vi, g, r FROM a),
z AS (SELECT id, CAST(vi AS INT) AS vi, g[vi + 1] AS guj, coalesce(r[vi + 1], r[1], '') AS roman FROM e)
SELECT id, vi, guj, roman FROM z""",
    "desk_progress": """
SELECT count(*) AS n_clips, count(*) FILTER (status = 'verified') AS n_verified, round(100.0 * count(*) FILTER (status = 'verified') / greatest(count(*), 1), 6) AS percent,
       round(coalesce(sum(coalesce(duration, 0)) FILTER (status = 'verified'), 0) / 60.0, 6) AS minutes FROM verified""",
    "desk_export": "SELECT id, clip, duration, transcript, roman, source_id FROM verified WHERE status = 'verified'",
    "desk_overlay": """
WITH first AS (SELECT id, arg_min(status, {'a': ingested_at, 'b': start, 'c': duration, 'd': transcript, 'e': notes}) AS status FROM manifest GROUP BY id),
saved AS (SELECT id, arg_min(status, row_no) AS status FROM verified WHERE id IS NOT NULL GROUP BY id)
SELECT coalesce(nullif(s.status, ''), nullif(f.status, ''), 'pending') AS status, count(*) AS n_rows FROM first f LEFT JOIN saved s ON f.id = s.id GROUP BY 1""",
    "next_pending": "SELECT coalesce(min(seq) FILTER (mv_verdict = 'pending' AND seq > 100), least(101, max(seq))) AS next FROM machine_verify_state",
    "clock_labels": "SELECT row_no, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS label FROM (SELECT row_no, CAST(floor(coalesce(start, 0)) AS BIGINT) AS s FROM verified)",
}


def queries() -> dict[str, Query]:
    own = [
        minutes_by_source_tier, input_counts, rejects, reject_counts, total_minutes, dedup_tiered, dedup_sequential, merged_sorted, drift_audit, eval_split_source, eval_split_clip, train_minus_eval,
        split_leak, split_mode, eval_guard_counts, clip_resolve, done_anti_join, duration_gate, state_last_wins, requeue_errors, pending_unseen, agreement_scores, agreement_skeletons, lang_gate,
        verdict_counts, adjudication_batches, apply_decisions, cer_micro, error_rates, chroma_segments, card_picks, card_clip_overlap, alternates_zip, align_probes, align_report, fuzzy_align, matched_phrases, desk_overlay, desk_progress,
        desk_export, next_pending, clock_labels,
    ]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans.text_queries import _normalised_sql, _skeleton_roman_sql

    convention = lambda column, rows: _normalised_sql(column, rows, lexicon_words=False).strip().removeprefix("WITH ")
    return ORACLE | {
        "drift_audit": _GOOD + ", " + convention("transcript", "good") + " SELECT row_no, done AS normal, array_to_string(flags, ',') AS flags FROM flagged WHERE done <> transcript OR len(flags) > 0",
        "apply_decisions": f"WITH {_LAST}, decided AS (SELECT id, hyp_a, agreement FROM last WHERE mv_verdict = 'adjudicate' AND id NOT IN (SELECT id FROM verified WHERE id IS NOT NULL)), "
        + convention("hyp_a", "decided")
        + """
SELECT id, done AS transcript, 'verified' AS status, 'machine-consensus' AS verified_by, agreement AS confidence FROM flagged
WHERE done <> '' AND NOT list_has_any(flags, ['latin-remnant', 'devanagari-remnant', 'slash-alternates'])""",
        "align_probes": f"""
WITH once AS (SELECT DISTINCT id, kutchi_guj, kutchi_roman FROM phrasebook),
a AS (SELECT id, {_alternates_sql("kutchi_guj")} AS g, {_alternates_sql("kutchi_roman")} AS r FROM once),
e AS (SELECT id, unnest(range(len(g))) AS vi, g, r FROM a),
z AS (SELECT id, CAST(vi AS INT) AS vi, g[vi + 1] AS guj, coalesce(r[vi + 1], r[1], '') AS roman FROM e),
s AS (SELECT id, vi, {_skeleton_sql("guj")} AS gs, {_skeleton_roman_sql("roman")} AS rs FROM z),
p AS (SELECT id, vi, 0 AS second, gs AS skel FROM s WHERE length(gs) >= 4 UNION ALL SELECT id, vi, 1, rs FROM s WHERE length(rs) >= 4 AND gs <> '' AND length(rs) <= 1.4 * length(gs))
SELECT id, vi, CAST(row_number() OVER (PARTITION BY id ORDER BY vi, second) - 1 AS INT) AS k, skel FROM p""",
    }
