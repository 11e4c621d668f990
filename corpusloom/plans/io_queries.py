"""Queries of sources, sinks and hooks: tables written in the formats of the desk and the corpus, and read back; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicon
from corpusloom.operators import consensus, curate, desk, freeze, ingest, segments
from corpusloom.session import shared_folder, table
from corpusloom.sources import external, html, lists, records

Query = Callable[[SparkSession, str], DataFrame]
_ROW = "id STRING, source_id STRING, start DOUBLE, `end` DOUBLE, status STRING, notes STRING"
_COLUMNS = ["id", "source_id", "start", "end", "status", "notes"]


def _work(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid4().hex}"


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "manifest")


def _lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("append").text(path)


# ---- JSON lines ----


def jsonl_append(s, d):
    """manifest appended as JSON lines by status, blank lines between, and read back strictly."""
    path, m = _work(s, "jsonl"), _manifest(s, d).select(*_COLUMNS)
    records.append(m.filter("status = 'pending'"), path)
    _lines(s.createDataFrame([("",), ("  ",)], "value string"), path)
    records.append(m.filter("status IS NULL OR status <> 'pending'"), path)
    return records.read_strict(s, [path, f"{path}-missing"], _ROW)


def jsonl_tracks(s, d):
    """Usable rows of verified, one file per track, scanned together with a missing one."""
    path, v = _work(s, "tracks"), table(s, d, "verified")
    names = [r["track"] for r in v.select("track").distinct().orderBy("track").collect()]
    for n in names:
        records.append(v.filter(F.col("track") == n).select("row_no", "status", "transcript", "track"), f"{path}/{n}")
    every = records.read_strict(s, [*[f"{path}/{n}" for n in names], f"{path}/none"], "row_no BIGINT, status STRING, transcript STRING, track STRING")
    return every.filter(curate.trainable()).select("row_no", "track")


def union_tracks(s, d):
    """Rows per input of tracks with differing columns."""
    v = table(s, d, "verified")
    tracks = [v.filter("track = 'cards'"), v.filter("track <> 'cards'").drop("confidence", "notes")]
    return curate.union_tracks(tracks).groupBy("input_ord").agg(F.count("*").alias("n_rows"), F.count("confidence").alias("n_scored"))


def done_keys(s, d):
    """The sources of a file of JSON lines that holds broken ones."""
    path, m = _work(s, "done"), _manifest(s, d)
    _lines(m.select(F.to_json(F.struct("source_id", "id")).alias("value")), path)
    _lines(m.filter("status = 'pending'").select(F.concat(F.lit('{"source_id": "broken-'), "id").alias("value")), path)
    return records.done_keys(s, path, "source_id")


def clips_by_source(s, d):
    """The clips of each source, side by side and in order."""
    return records.by_source(_manifest(s, d).filter("source_id <> ''").select("source_id", "id", "start", "end"))


def replace_own_input(s, d):
    """The state after it was rewritten without its failed rows, from the file it is in."""
    path, state = _work(s, "state"), table(s, d, "machine_verify_state").select("id", "seq", "lang_a", "lang_b")
    records.append(state, path)
    shape = "id STRING, seq BIGINT, lang_a STRING, lang_b STRING"
    records.replace(consensus.requeued(records.read_strict(s, [path], shape).filter("id IS NOT NULL")), path)
    return records.read_strict(s, [path], shape)


def merge_dry_run(s, d):
    """What a merge would write, and that a dry run wrote nothing."""
    path = _work(s, "merged")
    n = records.replace(curate.dedup_tiered(curate.accepted(table(s, d, "verified")), ["row_no"]).select("row_no", "id"), path, dry_run=True)
    return s.createDataFrame([(n, records.exists(s, path))], "n_rows long, written boolean")


def adjudication_files(s, d):
    """The rows of the adjudicators' batch files, read back from their arrays."""
    path = _work(s, "batches")
    records.write_batches(consensus.batches(table(s, d, "machine_verify_state"), table(s, d, "verified").select("id")), path)
    return records.read_array(s, path, "seq BIGINT, id STRING").withColumn("file", F.regexp_extract(F.input_file_name(), r"(batch_\d+\.json)", 1)).select("file", "seq", "id")


# ---- lists ----


def link_list(s, d):
    """The links of a list with comments behind them."""
    path, m = _work(s, "links"), _manifest(s, d)
    _lines(m.select(F.concat(F.lit("  "), F.coalesce("source_url", F.lit("")), F.lit("  # "), F.coalesce("source_title", F.lit(""))).alias("value")), path)
    _lines(s.createDataFrame([("# a comment",), ("",)], "value string"), path)
    return lists.links(lists.read_lines(s, path)).groupBy("url").agg(F.count("*").alias("n_rows"))


def register_list(s, d):
    """Links with the register of their texts; unknown where none is given."""
    path, docs = _work(s, "register"), table(s, d, "documents")
    given = F.when(F.col("register").isNotNull(), F.concat("source_url", F.lit("\t"), "register")).otherwise(F.col("source_url"))
    _lines(docs.filter("source_url IS NOT NULL").select(given.alias("value")), path)
    _lines(s.createDataFrame([(" # a#comment",), ("",)], "value string"), path)
    return lists.registered_links(lists.read_lines(s, path)).groupBy("register").agg(F.count("*").alias("n_rows"))


def prompt_list(s, d):
    """Prompts with their roman, parted at the first tab."""
    path, p = _work(s, "prompts"), table(s, d, "phrasebook")
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ")
    _lines(p.select(F.concat(flat("kutchi_guj"), F.lit("\t"), flat("kutchi_roman"), F.lit("\tx")).alias("value")), path)
    _lines(s.createDataFrame([("# a comment",)], "value string"), path)
    return lists.prompts(lists.read_lines(s, path))


def lexicon_file(s, d):
    """Roman spellings of a lexicon made of the phrasebook, the last of equals."""
    path, p = _work(s, "lexicon"), table(s, d, "phrasebook")
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n|]+", " "))
    rows = p.select("id", flat("kutchi_roman").alias("r"), flat("kutchi_guj").alias("g")).distinct().select("id", F.concat("r", F.lit("| "), "r", F.lit("-x\t"), "g", F.lit("\t")).alias("value"))
    head = s.createDataFrame([(-2, "## notes"), (-1, "roman\tguj\tvariants"), (0, "")], "id int, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("id", "value").select("value").write.text(path)
    return lexicon.read_lexicon(lists.numbered_lines(s, path))[0]


def lock_file(s, d):
    """The sources held out, locked in a file and read back; what is locked stays."""
    path, good = _work(s, "locks"), curate.accepted(table(s, d, "verified"))
    records.write_lines(freeze.eval_sources(good, 20.0), "source_id", path)
    locked = lists.lock(s, path, "source_id")
    return freeze.eval_sources(good, 10.0, locked=locked).select("source_id", F.round("minutes", 6).alias("minutes"))


def frozen_ids(s, d):
    """Rows left for training, with the held-out clips read from their file."""
    path, good = _work(s, "frozen"), curate.accepted(table(s, d, "verified"))
    records.write_lines(freeze.eval_clips(good, 20.0), "id", path)
    return freeze.train_rows(good, lists.lock(s, path, "id"), "id").select("row_no", "id")


def corpus_file(s, d):
    """A corpus written in the order of its lines: every line, and whether a file begins after all lines of the files before."""
    path, m = _work(s, "corpus"), table(s, d, "documents").select("doc_id", F.concat_ws(" ", F.lpad(F.col("doc_id").cast("string"), 12, "0"), "source").alias("line"))
    records.write_corpus(m, "line", ["doc_id"], path)
    by = records.read_corpus(s, path).groupBy("file").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count("*").alias("n"))
    by = by.agg(F.array_sort(F.collect_list(F.struct("file", "lo", "hi", "n"))).alias("f"))  # one row per file
    ordered = F.forall(F.sequence(F.lit(1), F.size("f")), lambda i: (i == 1) | (F.element_at("f", i)["lo"] > F.element_at("f", F.greatest(i - 1, F.lit(1)))["hi"]))
    return by.select(F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_lines"), ordered.alias("ordered"))


def desk_load(s, d):
    """Rows of manifest as the desk's export has them, read into the desk again."""
    path = _work(s, "desk")
    m = table(s, d, "verified").select("row_no", "id", "clip", "status").withColumn("batch", F.floor(F.col("row_no") / 500).cast("long"))
    records.write_batches(m, path)
    return records.read_array(s, path, "row_no BIGINT, id STRING, clip STRING, status STRING")


def export_file(s, d):
    """The verified export, written and read back."""
    path = _work(s, "export")
    records.replace(desk.export_verified(table(s, d, "verified")), path)
    return records.read_strict(s, [path], "id STRING, clip STRING, duration DOUBLE, transcript STRING, roman STRING, source_id STRING")


# ---- logs, models and pages ----


def chroma_log(s, d):
    """Colour samples read from the log of a player, made of the events."""
    path, ev = _work(s, "chroma"), table(s, d, "events")
    number = lambda c: F.floor(c * 100).cast("string")
    parts = F.array(F.concat(F.lit("frame:1 pts_time:"), F.col("event_id").cast("string")), F.concat(F.lit("lavfi.UAVG="), number(F.col("value"))), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("lavfi.VAVG="), number(F.col("value") / 2))))
    rows = ev.select(F.col("user_id").cast("string").alias("video_id"), "event_id", F.posexplode(F.array_compact(parts)).alias("k", "line"))
    rows.select("video_id", (F.col("event_id") * 4 + F.col("k")).alias("n"), "line").write.parquet(path)
    return segments.chroma_samples(s.read.parquet(path))


def _recogniser():
    return lambda path: ((float(k), k + 0.5, f"{path}:{k}") for k in range(len(path) % 3))


def asr_segments(s, d):
    """The segments that a recogniser gives for each clip."""
    return external.segmented(_manifest(s, d).select("id").filter("id IS NOT NULL").distinct().withColumn("path", F.col("id")), "id", "path", _recogniser)


def asr_word_cache(s, d):
    """Timed words of two models, kept by video and model; the second run of the first model reads what is kept."""
    path, files = _work(s, "words"), _manifest(s, d).select(F.col("source_id").alias("video_id")).filter("source_id <> ''").distinct().withColumn("path", F.col("video_id"))
    external.word_cache(files, "small", path, _recogniser)
    first = external.word_cache(files.withColumn("path", F.lit("another")), "small", path, _recogniser)
    return first.unionByName(external.word_cache(files, "large", path, _recogniser)).select("video_id", "model", "k", "text")


def _ear():
    tries: dict[str, int] = {}

    def hear(path: str) -> dict:
        tries[path] = tries.get(path, 0) + 1
        if path.endswith("7") or (path.endswith("3") and tries[path] < 3):
            raise OSError(path)
        return {"language": "kutchi", "transcript": f"{path}!"}

    return hear


def ear_retries(s, d):
    """What an ear hears that fails twice for some clips and always for others."""
    ids = _manifest(s, d).select("id").filter("id IS NOT NULL").distinct().withColumn("path", F.col("id"))
    return external.transcribed(ids, "id", "path", _ear, wait_s=0.0)


def _site():
    def page(url: str) -> str:
        if "/page/" in url and int(url.rstrip("/").rsplit("/", 1)[1]) > len(url) % 4 + 1:
            raise OSError("404")
        return f"<h2 class='entry-title'><a href='{url}post'>x</a></h2>"

    return page


def page_fetch(s, d):
    """The posts that are linked from the pages of each site, up to its first page that fails."""
    hosts = table(s, d, "documents").select(F.concat(F.lit("https://"), ingest.host(F.col("source_url")), F.lit("/")).alias("url")).filter("url IS NOT NULL").distinct()
    plan = ingest.pages(hosts, "url", 6)
    got = external.fetched(plan, "page_url", _site, retries=1)
    kept = ingest.until_first_failure(plan.join(got, "page_url"), "url")
    return html.links(kept.select("page_url", "html"), "page_url").select("url", "link")


class _Pages(external.PageSource):
    fetch = staticmethod(lambda url: f"<p>{url}</p>")


def page_source(s, d):
    """The first page of each site, read as a table."""
    s.dataSource.register(_Pages)
    hosts = [r["h"] for r in table(s, d, "documents").select(ingest.host(F.col("source_url")).alias("h")).filter("h IS NOT NULL").distinct().collect()]
    return s.read.format("pages").option("urls", "\n".join(f"https://{h}/" for h in hosts)).load()


# ---- planning ----


def first_videos(s, d):
    """The distinct videos of manifest's links and of bare ids, each where it came first."""
    m = _manifest(s, d).select(F.coalesce("source_url", F.concat(F.lit(" "), "source_id")).alias("url"), F.xxhash64("id").alias("n"))
    return ingest.first_videos(m).select("video_id")


def recorded_rows(s, d):
    """Rows of manifest that are long enough for a recording."""
    return ingest.recorded(_manifest(s, d)).groupBy("status").agg(F.count("*").alias("n_rows"))


def id_titles(s, d):
    """Ids and titles of a listing, parted at the first tab."""
    line = F.concat(F.coalesce("source_id", F.lit("")), F.lit("\t"), F.coalesce("source_title", F.lit("")), F.lit("\tx"))
    return _manifest(s, d).select(ingest.id_title(line).alias("p")).groupBy("p.id", "p.title").agg(F.count("*").alias("n_rows"))


def shortest_first(s, d):
    """Sources in the order in which their files would be worked on, by minutes."""
    files = _manifest(s, d).groupBy("source_id").agg(F.count("*").alias("size")).select(F.col("source_id").alias("path"), "size")
    return ingest.shortest_first(files)


def window_names(s, d):
    """Names of the first windows of every video of the phrasebook."""
    return table(s, d, "phrasebook").select("video_id", F.explode(F.array(F.lit(1), F.lit(12), F.lit(123))).alias("n")).distinct().select("video_id", ingest.window_name(F.col("n")).alias("name"))


def harvest_counts(s, d):
    """Videos, those that went well and their cards, of an index made of the state."""
    n = F.count("*").alias("cards")
    index = table(s, d, "machine_verify_state").groupBy(F.col("source_id").alias("video_id")).agg(n, F.when(F.count_if(F.col("lang_a") == "error") > 0, "error").otherwise("ok").alias("status"))
    return ingest.harvest_counts(index)


def verify_limit(s, d):
    """The first fifty pending rows that the state lacks."""
    return consensus.first_pending(_manifest(s, d).groupBy("id", "status").agg(F.min("start").alias("start")), table(s, d, "machine_verify_state"), 50, ["id"]).select("id")


def missing_files(s, d):
    """Rows of verified with and without a file among the state's."""
    files = table(s, d, "machine_verify_state").select(F.concat("id", F.lit(".wav")).alias("clip"), F.lit(0).alias("folder_ord"), F.concat(F.lit("a/"), "id").alias("path")).filter("clip IS NOT NULL")
    return freeze.file_counts(freeze.resolve_files(table(s, d, "verified").select("row_no", F.concat("id", F.lit(".wav")).alias("clip")), files))


def requeue_state(s, d):
    """The state as it is kept when failed rows are asked again."""
    return consensus.requeued(table(s, d, "machine_verify_state")).select("id", "seq")


def clip_plan(s, d):
    """Rows of a manifest planned for the spans of the drafts: ids, bounds and lengths."""
    seg = _manifest(s, d).select("source_id", "source_title", "source_url", "start", "end", F.col("asr_draft").alias("text")).filter("source_id IS NOT NULL")
    return ingest.clip_plan(seg).groupBy("source_id").agg(F.count("*").alias("n_clips"), F.countDistinct("id").alias("n_ids"), F.round(F.sum("duration"), 3).alias("seconds"))


def crop_heights(s, d):
    """The even height that is looked at of pictures of every height up to 2,000."""
    return s.range(2001).select(F.col("id").alias("height"), ingest.crop_height(F.col("id")).alias("crop"))


# ---- SQL ----

_GATE = r"status = 'verified' AND regexp_replace(coalesce(transcript, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> ''"


def _flat(column: str, signs: str) -> str:
    return rf"regexp_replace(coalesce({column}, ''), '[{signs}]+', ' ', 'g')"


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans.curation_queries import _DEDUP, _EVAL_CLIPS, _EVAL_SOURCES, _LAST
    from corpusloom.plans.text_queries import _HOST

    strip = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    roman, guj = f"trim({_flat('kutchi_roman', chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n|')})", f"trim({_flat('kutchi_guj', chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n|')})"
    tabs = r"\t\r\n"
    heard = "unnest(range(length({0}) % 3))"
    return {
        "jsonl_append": 'SELECT id, source_id, start, "end", status, notes FROM manifest',
        "jsonl_tracks": f"SELECT row_no, track FROM verified WHERE {_GATE}",
        "union_tracks": "SELECT CASE WHEN track = 'cards' THEN 0 ELSE 1 END AS input_ord, count(*) AS n_rows, CASE WHEN track = 'cards' THEN count(confidence) ELSE 0 END AS n_scored FROM (SELECT CASE WHEN track = 'cards' THEN 'cards' ELSE 'x' END AS track, confidence FROM verified WHERE track IS NOT NULL) GROUP BY track",
        "done_keys": "SELECT DISTINCT source_id FROM manifest WHERE source_id <> ''",
        "clips_by_source": "SELECT source_id, id, start, \"end\" FROM manifest WHERE source_id <> '' ORDER BY source_id, start, id",
        "replace_own_input": f"WITH {_LAST} SELECT id, seq, lang_a, lang_b FROM last WHERE id IS NOT NULL AND coalesce(lang_a, '') <> 'error' AND coalesce(lang_b, '') <> 'error'",
        "merge_dry_run": _DEDUP + " SELECT count(*) AS n_rows, FALSE AS written FROM kept",
        "adjudication_files": """
SELECT 'batch_' || lpad(CAST((row_number() OVER (ORDER BY seq) - 1) // 40 AS VARCHAR), 3, '0') || '.json' AS file, seq, id FROM machine_verify_state
WHERE mv_verdict = 'adjudicate' AND id NOT IN (SELECT id FROM verified WHERE id IS NOT NULL)""",
        "link_list": f"SELECT url, count(*) AS n_rows FROM (SELECT {strip.format(chr(39) * 0 + 'string_split(coalesce(source_url, ' + chr(39) * 2 + '), ' + chr(39) + '#' + chr(39) + ')[1]')} AS url FROM manifest) WHERE url <> '' GROUP BY 1",
        "register_list": f"SELECT coalesce(nullif({strip.format('register')}, ''), 'unknown') AS register, count(*) AS n_rows FROM documents WHERE {strip.format('source_url')} <> '' GROUP BY 1",
        "prompt_list": f"SELECT transcript, roman FROM (SELECT {strip.format(_flat('kutchi_guj', tabs))} AS transcript, {strip.format(_flat('kutchi_roman', tabs) + ' || chr(9) || ' + chr(39) + 'x' + chr(39))} AS roman FROM phrasebook) WHERE transcript <> '' AND NOT starts_with(transcript, '#')",
        "lexicon_file": f"""
WITH rows_ AS (SELECT DISTINCT id, lower({roman}) AS r, {guj} AS g FROM phrasebook), each AS (SELECT id, r AS roman, 0 AS p, g FROM rows_ UNION ALL SELECT id, r || '-x', 1, g FROM rows_)
SELECT roman, arg_max(g, id * 2 + p) AS guj FROM each WHERE roman <> '' GROUP BY roman""",
        "lock_file": _EVAL_SOURCES + f" SELECT source_id, round(minutes, 6) AS minutes FROM by_source WHERE source_id IN (SELECT {strip.format('source_id')} FROM held)",
        "frozen_ids": _EVAL_CLIPS + " SELECT row_no, id FROM good WHERE id NOT IN (SELECT " + strip.format("id") + " FROM held WHERE id IS NOT NULL)",
        "corpus_file": "SELECT count(*) AS n_lines, TRUE AS ordered FROM documents",
        "desk_load": "SELECT row_no, id, clip, status FROM verified",
        "export_file": "SELECT id, clip, duration, transcript, roman, source_id FROM verified WHERE status = 'verified'",
        "chroma_log": "SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(event_id AS DOUBLE) AS t, CAST(floor(value * 100) AS DOUBLE) AS u, CAST(floor(value / 2 * 100) AS DOUBLE) AS v FROM events WHERE event_id % 7 <> 0",
        "asr_segments": f"SELECT id, CAST(k AS INT) AS k, CAST(k AS DOUBLE) AS start, k + CAST(0.5 AS DOUBLE) AS \"end\", id || ':' || k AS text FROM (SELECT id, {heard.format('id')} AS k FROM (SELECT DISTINCT id FROM manifest WHERE id IS NOT NULL))",
        "asr_word_cache": f"""
WITH each AS (SELECT source_id AS video_id, {heard.format('source_id')} AS k FROM (SELECT DISTINCT source_id FROM manifest WHERE source_id <> '')),
again AS (SELECT video_id, k FROM (SELECT video_id, {heard.format(chr(39) + 'another' + chr(39))} AS k FROM (SELECT DISTINCT source_id AS video_id FROM manifest WHERE source_id <> '' AND length(source_id) % 3 = 0)))
SELECT video_id, model, CAST(k AS INT) AS k, video_id || ':' || k AS text FROM each, (SELECT unnest(['small', 'large']) AS model)
UNION ALL SELECT video_id, 'small', CAST(k AS INT), 'another:' || k FROM again""",
        "ear_retries": "SELECT DISTINCT id, CASE WHEN ends_with(id, '7') THEN 'error' ELSE 'kutchi' END AS language, CASE WHEN ends_with(id, '7') THEN '' ELSE id || '!' END AS transcript FROM manifest WHERE id IS NOT NULL",
        "page_fetch": rf"""
WITH sites AS (SELECT DISTINCT 'https://' || {_HOST} || '/' AS site FROM documents WHERE {_HOST} IS NOT NULL),
asked AS (SELECT site, page, CASE WHEN page = 1 THEN site ELSE site || 'page/' || page || '/' END AS url FROM sites, (SELECT unnest(range(1, 7)) AS page)),
tried AS (SELECT *, page = 1 OR page <= length(url) % 4 + 1 AS ok FROM asked), stops AS (SELECT site, min(page) FILTER (NOT ok) AS stop FROM tried GROUP BY 1)
SELECT url, url || 'post' AS link FROM tried JOIN stops USING (site) WHERE stop IS NULL OR page < stop""",
        "page_source": rf"SELECT DISTINCT 'https://' || {_HOST} || '/' AS url, TRUE AS ok, '<p>https://' || {_HOST} || '/</p>' AS html FROM documents WHERE {_HOST} IS NOT NULL",
        "first_videos": r"""
WITH links AS (SELECT trim(coalesce(source_url, ' ' || source_id)) AS u FROM manifest), typed AS (SELECT u, regexp_extract(u, '(?:v=|youtu\.be/)([\w-]{11})', 1) AS v, contains(u, 'list=') OR contains(u, '/playlist') OR regexp_matches(u, '/(channel/|c/|user/|@)') AS many FROM links)
SELECT DISTINCT CASE WHEN v <> '' THEN v ELSE u END AS video_id FROM typed WHERE NOT many AND u <> ''""",
        "recorded_rows": "SELECT status, count(*) AS n_rows FROM manifest WHERE duration >= 0.4 GROUP BY 1",
        "id_titles": "SELECT trim(coalesce(source_id, '')) AS id, trim(coalesce(source_title, '') || chr(9) || 'x') AS title, count(*) AS n_rows FROM manifest GROUP BY 1, 2",
        "shortest_first": "SELECT source_id AS path, count(*) AS size FROM manifest GROUP BY 1 ORDER BY 2, 1",
        "window_names": "SELECT DISTINCT video_id, 'c' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS name FROM phrasebook, (SELECT unnest([1, 12, 123]) AS n)",
        "harvest_counts": "SELECT count(*) AS n_videos, count(*) FILTER (bad = 0) AS n_ok, CAST(sum(n) AS BIGINT) AS n_cards FROM (SELECT source_id, count(*) AS n, count(*) FILTER (lang_a = 'error') AS bad FROM machine_verify_state GROUP BY 1)",
        "verify_limit": "SELECT DISTINCT id FROM manifest WHERE status = 'pending' AND id NOT IN (SELECT id FROM machine_verify_state WHERE id IS NOT NULL) ORDER BY id LIMIT 50",
        "missing_files": "SELECT count(*) AS n_rows, count(*) FILTER (id IN (SELECT id FROM machine_verify_state WHERE id IS NOT NULL)) AS n_found, count(*) FILTER (id IS NULL OR id NOT IN (SELECT id FROM machine_verify_state WHERE id IS NOT NULL)) AS n_missing FROM verified",
        "requeue_state": f"WITH {_LAST} SELECT id, seq FROM last WHERE coalesce(lang_a, '') <> 'error' AND coalesce(lang_b, '') <> 'error'",
        "clip_plan": """
WITH cut AS (SELECT source_id, round(start, 3) AS s, round("end", 3) AS e FROM manifest WHERE source_id IS NOT NULL), kept AS (SELECT *, round(e - s, 3) AS n FROM cut WHERE round(e - s, 3) BETWEEN 2.0 AND 20.0)
SELECT source_id, count(*) AS n_clips, count(DISTINCT (s, e)) AS n_ids, round(sum(n), 3) AS seconds FROM kept GROUP BY 1""",
        "crop_heights": "SELECT h AS height, CAST(greatest(2, floor(floor(h * 0.86) / 2) * 2) AS INT) AS crop FROM (SELECT unnest(range(2001)) AS h)",
    }


def queries() -> dict[str, Query]:
    own = [
        jsonl_append, jsonl_tracks, union_tracks, done_keys, clips_by_source, replace_own_input, merge_dry_run, adjudication_files, link_list, register_list, prompt_list, lexicon_file, lock_file, frozen_ids,
        corpus_file, desk_load, export_file, chroma_log, asr_segments, asr_word_cache, ear_retries, page_fetch, page_source, first_videos, recorded_rows, id_titles, shortest_first, window_names,
        harvest_counts, verify_limit, missing_files, requeue_state, clip_plan, crop_heights,
    ]
    return {q.__name__: q for q in own}
