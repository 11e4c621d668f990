"""Queries of text functions, corpora, language-model inputs, pages and ids; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicon, script
from corpusloom.operators import align, corpus, desk, ingest, lm
from corpusloom.session import checkpoint, shared_folder, table
from corpusloom.sources import html, records

Query = Callable[[SparkSession, str], DataFrame]
# Spellings that the convention's log decides.
VARIANTS = {"આઉં": "આઉ", "આઈં": "આઈ", "તું": "તૂ", "મુકે.": "મુકે", "તોકેં": "તોકે", "અસાજો": "અસાંજો", "પાજો": "પાંજો", "મુંજો": "મુજો", "બજ઼ાર": "બજાર"}
BYTE_BUDGET, WINDOW, VOCABULARY, STEPS = 500_000, 64, 16_000, 20


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _verified(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "verified")


# ---- scripts and spelling ----


def normalize_text(s, d):
    """Every transcript as the convention has it, with flags."""
    n = _verified(s, d).select("row_no", lexicon.normalise(F.col("transcript"), VARIANTS).alias("n"))
    return n.select("row_no", F.col("n.text").alias("text"), F.array_join("n.flags", ",").alias("flags"))


def lexicon_audit(s, d):
    """What normalising the documents would change."""
    return lexicon.audit(_docs(s, d), "text", VARIANTS)


def variant_fold(s, d):
    """Transcripts with known misspellings replaced, by a join."""
    known = s.createDataFrame(list(VARIANTS.items()), "variant string, guj string")
    return lexicon.fold_variants(_verified(s, d), "row_no", "transcript", known)


def roman_lookup(s, d):
    """For every roman field of the phrasebook the Gujarati text that its alternates have first, by a lookup join."""
    book = corpus.first_wins(table(s, d, "phrasebook"), "id", ["video_id", "kutchi_guj", "kutchi_roman", "english", "source_url"])
    v = align.variants(book).filter("roman <> ''").select(F.lower(F.trim("roman")).alias("roman"), "guj", "id", "vi")
    known = v.groupBy("roman").agg(F.min_by("guj", F.struct("id", "vi", "guj")).alias("guj"))
    return lexicon.looked_up(book.select("id", F.col("kutchi_roman").alias("roman")), "roman", known)


def dev_to_guj_ingest(s, d):
    """Documents with Devanagari shifted; dandas become full stops."""
    return _docs(s, d).select("doc_id", F.md5(script.devanagari_shifted(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


def dev_to_guj_text(s, d):
    """Documents with Devanagari decomposed, shifted where assigned, and composed."""
    return _docs(s, d).select("doc_id", F.md5(script.devanagari_for_text(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


def dev_to_guj_lexicon(s, d):
    """Documents with Devanagari as the lexicon has it."""
    return _docs(s, d).select("doc_id", F.md5(script.devanagari_for_lexicon(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


def guj_to_roman(s, d):
    """The roman draft of every transcript."""
    return _verified(s, d).select("row_no", script.romanised(F.coalesce("transcript", F.lit(""))).alias("roman"))


def slugs(s, d):
    """Slugs of the source titles."""
    return table(s, d, "manifest").select(script.slug(F.col("source_title")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n_rows"))


def line_scripts(s, d):
    """Lines of the documents per source and script."""
    each = _docs(s, d).select("source", F.explode(corpus.lines(F.col("text"))).alias("line"))
    return each.groupBy("source", script.line_script(F.col("line")).alias("script")).agg(F.count("*").alias("n_lines"))


def script_profile(s, d):
    """Characters of each script per document."""
    n = script.script_counts(F.coalesce(F.col("text"), F.lit("")))
    return _docs(s, d).select("doc_id", *[c.cast("long").alias(k) for k, c in n.items()])


def skeletons_gujarati(s, d):
    """Sound-class skeletons of the transcripts."""
    return _verified(s, d).select("row_no", script.skeleton_gujarati(F.coalesce("transcript", F.lit(""))).alias("skel"))


def skeletons_roman(s, d):
    """Skeletons of the roman fields of the phrasebook."""
    return table(s, d, "phrasebook").select("id", script.skeleton_roman(F.coalesce("kutchi_roman", F.lit(""))).alias("skel"))


def auto_roman(s, d):
    """The roman field as it follows the transcript."""
    return _verified(s, d).select("row_no", desk.followed_roman(F.col("transcript"), F.col("roman"), F.col("transcript")).alias("roman"))


# ---- corpora ----


def _pieces(s, d):
    p = corpus.pieces(_docs(s, d), "doc_id", "text", "source")
    return corpus.first_wins(p, "piece", ["doc_id", "li", "pi"])


def corpus_lines(s, d):
    """Distinct pieces of the documents' lines, each where it came first."""
    return _pieces(s, d).select("doc_id", "li", "pi", "piece")


def corpus_stats(s, d):
    """Lines and characters of that corpus."""
    return corpus.corpus_stats(_pieces(s, d), "piece")


def corpus_source_counts(s, d):
    """Pieces kept per source."""
    return _pieces(s, d).groupBy("source").agg(F.count("*").alias("n_lines"))


def _kutchi(s, d):
    said = corpus.texts(_verified(s, d), "transcript", verified_only=True)
    tracks = {"verified": (said, "row_no", "transcript", "source_id"), "phrasebook": (table(s, d, "phrasebook"), "id", "kutchi_guj", "video_id"), "documents": (_docs(s, d), "doc_id", "text", "source")}
    return corpus.build(tracks, VARIANTS)


def kutchi_corpus_lines(s, d):
    """Distinct normalised pieces of transcripts, phrases and documents, each where it came first."""
    return _kutchi(s, d).select("track", "row", "li", "pi", "piece")


def kutchi_corpus_stats(s, d):
    """Lines and characters of that corpus."""
    return corpus.corpus_stats(_kutchi(s, d), "piece")


def kutchi_corpus_source_counts(s, d):
    """Pieces kept per track and source."""
    return _kutchi(s, d).groupBy("track", "source").agg(F.count("*").alias("n_lines"))


def byte_budget_docs(s, d):
    """Documents until the budget of bytes is reached."""
    return corpus.byte_budget(_docs(s, d), "doc_id", "text", BYTE_BUDGET).select("doc_id", "n_bytes", F.col("before").cast("long").alias("before"))


# ---- language-model inputs ----


def char_vocab(s, d):
    """Characters of all transcripts in code-point order."""
    return lm.char_vocabulary(_verified(s, d), "transcript").select("char", "n", F.col("char_id").cast("long").alias("char_id"))


def char_encode(s, d):
    """Transcripts as character numbers."""
    v = _verified(s, d)
    return lm.encode_chars(v, "row_no", "transcript", lm.char_vocabulary(v, "transcript")).select("row_no", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def char_decode(s, d):
    """Transcripts encoded and decoded again."""
    v = _verified(s, d)
    vocabulary = checkpoint(lm.char_vocabulary(v, "transcript"))
    return lm.decode_chars(lm.encode_chars(v, "row_no", "transcript", vocabulary), "row_no", vocabulary)


def _stream(s, d):
    v = _verified(s, d)
    return checkpoint(lm.placed(lm.encode_chars(v, "row_no", "transcript", lm.char_vocabulary(v, "transcript")), "row_no"))


def train_val_split(s, d):
    """Tokens in each part of the stream, and the first and last place of each."""
    parts = lm.split_stream(_stream(s, d)).groupBy("part").agg(F.sum(F.size("tokens").cast("long")).alias("n_tokens"))
    before = F.when(F.col("part") == "val", F.sum("n_tokens").over(Window.partitionBy()) - F.col("n_tokens")).otherwise(F.lit(0))
    return parts.withColumn("first", before).select("part", "n_tokens", "first", (F.col("first") + F.col("n_tokens") - 1).alias("last"))


def split_fallback(s, d):
    """Tokens in each part if validation asks for more than its share holds: the whole stream."""
    stream = _stream(s, d)
    return lm.split_stream(stream, least=lm.stream_size(stream) // 10).groupBy("part").agg(F.sum(F.size("tokens").cast("long")).alias("n_tokens"))


def _total(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def token_windows(s, d):
    """Windows of the stream and their targets."""
    return lm.windows(_stream(s, d), WINDOW).select("w", _total("x").alias("x_sum"), _total("y").alias("y_sum"))


def token_batches(s, d):
    """The batches of a run that reads the stream more than once."""
    return lm.batches(_stream(s, d), WINDOW, 500, STEPS).select("step", "b", _total("x").alias("x_sum"), _total("y").alias("y_sum"))


def random_windows(s, d):
    """Windows at drawn places."""
    return lm.random_windows(_stream(s, d), WINDOW, 1000).select("w", _total("x").alias("x_sum"), _total("y").alias("y_sum"))


def token_cache(s, d):
    """The stream kept as a table, made once and read twice."""
    path = f"{shared_folder(s)}/tokens-{uuid4().hex}"
    made = records.cached(s, path, lambda: _stream(s, d))
    again = records.cached(s, path, lambda: made.limit(0))
    return again.agg(F.sum(F.size("tokens").cast("long")).alias("n_tokens"), F.sum(_total("tokens")).alias("total"))


def label_gate(s, d):
    """Transcripts with more characters than a row may have labels."""
    v = _docs(s, d)
    return lm.gate_counts(v.select(F.split(F.coalesce("text", F.lit("")), "").alias("t")), "t")


def padded_labels(s, d):
    """Transcripts in batches of 32, filled up to one length."""
    v = _verified(s, d)
    encoded = lm.encode_chars(v, "row_no", "transcript", lm.char_vocabulary(v, "transcript")).withColumn("batch", F.floor(F.col("row_no") / 32))
    p = lm.padded_batches(encoded, "batch", "row_no", "tokens", first=0)
    return p.select("batch", "row_no", F.size("labels").alias("n"), _total("labels").alias("total"))


def loss_means(s, d):
    """Mean loss of both parts per step, of event values as losses."""
    part = F.when(F.col("event_id") % 2 == 0, "train").otherwise("val")
    losses = table(s, d, "events").select((F.col("event_id") % 50).alias("step"), part.alias("part"), F.floor(F.col("event_id") / 50).alias("k"), F.col("value").alias("loss"))
    return lm.loss_means(losses)


def lr_schedule(s, d):
    """The learning rate at every step."""
    return s.range(0, 2001).select(F.col("id").alias("step"), F.round(lm.learning_rate(F.col("id"), 200, 1500, 6e-4, 6e-5), 12).alias("lr"))


def bpe_pairs(s, d):
    """Counts of neighbouring characters in the transcripts' words."""
    return lm.pair_counts(lm.word_counts(_verified(s, d), "transcript"))


def _merges(s, d):
    return lm.train_merges(lm.word_counts(_kutchi(s, d), "piece"), VOCABULARY)


def bpe_train(s, d):
    """The merges learned, in order."""
    return s.createDataFrame([(j, a, b) for j, (a, b) in enumerate(_merges(s, d))], "k int, a string, b string")


def chars_per_token(s, d):
    """How finely the merges cut the corpus, and whether its pieces can be put together again."""
    k = checkpoint(_kutchi(s, d).select(F.xxhash64("track", "row", "li", "pi", "piece").alias("line"), "piece"))
    return lm.fragmentation(lm.encode_merges(k, "line", "piece", lm.train_merges(lm.word_counts(k, "piece"), VOCABULARY)), k, "line", "piece")


def top_k_candidates(s, d):
    """The ten best characters after each of the commonest ones, with their chances."""
    pairs = lm.pair_counts(lm.word_counts(_verified(s, d), "transcript"))
    return lm.top_k(pairs.withColumn("logit", F.log(F.col("n").cast("double"))), "a", "logit", 10).select("a", "b", F.round("p", 9).alias("p"))


# ---- pages and ids ----


def _pages(s, d):
    """Each document as a page of its source."""
    esc = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(corpus.lines(esc), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")
    link = F.concat_ws("#", "source_url", F.col("doc_id").cast("string"))
    page = F.concat(F.lit("<html><body><h1 class='entry-title'>"), "id", F.lit("</h1><nav>Home</nav><h2 class='entry-title'><a href='"), link, F.lit("'>next</a></h2><div class='entry-content'>"), body, F.lit("<script>var x = '</p>';</script></div></body></html>"))
    return _docs(s, d).select(link.alias("url"), page.alias("html"))


def html_extract(s, d):
    """The posts of the pages made of the documents."""
    return html.posts(_pages(s, d)).select("id", "url", "title", F.array_join("scripts", ",").alias("scripts"), "text_origin", "n_lines")


def html_links(s, d):
    """The links of the same pages."""
    return html.links(_pages(s, d))


def url_hosts(s, d):
    """Documents per host and id of their link."""
    return _docs(s, d).groupBy(ingest.host(F.col("source_url")).alias("host")).agg(F.count("*").alias("n_docs"))


def url_ids(s, d):
    """The id that each document's link gives."""
    return _docs(s, d).select("doc_id", ingest.url_id(F.col("source_url")).alias("url_id"))


def link_kinds(s, d):
    """Links of manifest by kind, and distinct videos."""
    u = F.col("source_url")
    return table(s, d, "manifest").groupBy(ingest.link_kind(u).alias("kind")).agg(F.count("*").alias("n_rows"), F.countDistinct(ingest.video_id(u)).alias("n_videos"))


def prompt_ids(s, d):
    """Recording ids for the transcripts of one speaker."""
    return _verified(s, d).select("row_no", ingest.prompt_id(F.lit("speaker1"), F.coalesce("transcript", F.lit(""))).alias("prompt_id"))


def card_ids(s, d):
    """Ids of a first and second clip of each phrase, and the phrase read back from them."""
    p = table(s, d, "phrasebook").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("r")).distinct()
    c = p.withColumn("card", ingest.card_id(F.col("id"), F.col("r")))
    return c.select("id", "r", "card", ingest.phrase_of(F.col("card")).alias("phrase"))


def page_plan(s, d):
    """The pages that would be asked for of every host."""
    hosts = _docs(s, d).select(F.concat(F.lit("https://"), ingest.host(F.col("source_url")), F.lit("/")).alias("url")).filter("url IS NOT NULL").distinct()
    return ingest.pages(hosts, "url", 5)


# ---- SQL ----

_DEVA = [o for o in range(0x0900, 0x0980)]


def _sql_translate(column: str, sources: str, targets: str) -> str:
    return f"translate({column}, '{sources}', '{targets}')"


def _ingest_sql() -> str:
    block = [*range(0x0901, 0x0964), *range(0x0966, 0x0970)]
    return _sql_translate("coalesce(text, '')", "".join(map(chr, block)) + "।॥", "".join(chr(o + 0x180) for o in block) + "..")


def _lexicon_sql(column: str) -> str:
    import unicodedata

    block = [o for o in _DEVA if chr(o) not in "।॥ऽ॰" and unicodedata.name(chr(o + 0x180), "")]
    return _sql_translate(column, "".join(map(chr, block)) + "।॥ऽ॰", "".join(chr(o + 0x180) for o in block) + "..")


def _word_sql() -> str:
    table_ = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in VARIANTS.items()) + "}"
    bare = "regexp_replace(w, '[.?]+$', '')"
    return f"coalesce(({table_})[{bare}] || substr(w, length({bare}) + 1), w)"


def _normalised_sql(column: str, rows: str, lexicon_words: bool = True) -> str:
    """The convention in SQL: ``raw``, ``done`` and the flags of ``rows``."""
    signs = lexicon.PUNCTUATION.replace("'", "''")
    blanks = " " * len(lexicon.PUNCTUATION)
    word = _word_sql() if lexicon_words else "w"
    return rf"""
WITH raws AS (SELECT *, nfc_normalize(coalesce({column}, '')) AS raw FROM {rows}),
shifted AS (SELECT *, CASE WHEN regexp_matches(raw, '[\x{{0900}}-\x{{097F}}]') THEN {_lexicon_sql("raw")} ELSE raw END AS moved FROM raws),
plains AS (SELECT *, replace(replace(moved, '઼', ''), 'ઁ', 'ં') AS plain FROM shifted),
signed AS (SELECT *, replace(translate(replace(plain, '(?)', chr(57347)), '{signs}', '{blanks}'), chr(57347), '(?)') AS open FROM plains),
worded AS (SELECT *, list_filter(regexp_split_to_array(open, '[\s\p{{Z}}]+'), lambda w: w <> '') AS words FROM signed),
dones AS (SELECT *, array_to_string(list_transform(words, lambda w: {word}), ' ') AS done FROM worded),
flagged AS (SELECT *, list_filter([
  CASE WHEN regexp_matches(raw, '[\x{{0900}}-\x{{097F}}]') THEN 'devanagari-transliterated' END, CASE WHEN contains(moved, '઼') THEN 'nukta-stripped' END,
  CASE WHEN contains(moved, 'ઁ') THEN 'candrabindu->anusvara' END, CASE WHEN contains(plain, '/') THEN 'slash-alternates' END, CASE WHEN regexp_matches(done, '[A-Za-z]') THEN 'latin-remnant' END,
  CASE WHEN regexp_matches(done, '[0-9૦-૯]') THEN 'digits' END, CASE WHEN regexp_matches(done, '[\x{{0900}}-\x{{097F}}]') THEN 'devanagari-remnant' END], lambda f: f IS NOT NULL) AS flags FROM dones)"""


_LINES = r"string_split(regexp_replace(coalesce(text, ''), '\r\n|[\n\x{0B}\x{0C}\r\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))"
_PIECES = rf"""
WITH lines AS (SELECT doc_id, source, unnest(range(len(l))) AS li, l FROM (SELECT doc_id, source, {_LINES} AS l FROM documents)),
parts AS (SELECT doc_id, source, li, string_split(l[li + 1], '/') AS p FROM lines),
pieces AS (SELECT doc_id, source, li, unnest(range(len(p))) AS pi, p FROM parts),
trimmed AS (SELECT doc_id, source, CAST(li AS INT) AS li, CAST(pi AS INT) AS pi, regexp_replace(p[pi + 1], '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g') AS piece FROM pieces),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY doc_id, li, pi) AS n FROM trimmed WHERE length(piece) >= 2) WHERE n = 1)"""
_WORDS = r"""
WITH split AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(transcript, ''), '\s+'), lambda w: w <> '')) AS w FROM verified),
words AS (SELECT '▁' || w AS word, count(*) AS n FROM split GROUP BY 1),
places AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM words),
pairs AS (SELECT substr(word, i, 1) AS a, substr(word, i + 1, 1) AS b, CAST(sum(n) AS BIGINT) AS n FROM places GROUP BY 1, 2)"""
_CHARS = """
WITH each AS (SELECT row_no, unnest(range(1, length(coalesce(transcript, '')) + 1)) AS p, coalesce(transcript, '') AS t FROM verified),
chars AS (SELECT row_no, p, substr(t, p, 1) AS char FROM each),
counted AS (SELECT char, count(*) AS n FROM chars GROUP BY 1),
vocab AS (SELECT char, n, row_number() OVER (ORDER BY hex(char)) - 1 AS char_id FROM counted),
stream AS (SELECT row_number() OVER (ORDER BY row_no, p) - 1 AS pos, char_id FROM chars JOIN vocab USING (char))"""
_HOST = r"nullif(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1), '')"

ORACLE = {
    "normalize_text": _normalised_sql("transcript", "verified") + " SELECT row_no, done AS text, array_to_string(flags, ',') AS flags FROM flagged",
    "lexicon_audit": _normalised_sql("text", "documents")
    + " SELECT count(*) AS checked, count(*) FILTER (done <> text) AS would_change, count(*) FILTER (len(flags) > 0) AS flagged FROM flagged WHERE coalesce(text, '') <> ''",
    "variant_fold": rf"""
WITH worded AS (SELECT row_no, regexp_split_to_array(regexp_replace(coalesce(transcript, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s\p{{Z}}]+') AS words FROM verified)
SELECT row_no, array_to_string(list_transform(words, lambda w: {_word_sql()}), ' ') AS transcript FROM worded""",
    "dev_to_guj_ingest": f"SELECT doc_id, md5({_ingest_sql()}) AS digest FROM documents",
    "dev_to_guj_lexicon": f"SELECT doc_id, md5({_lexicon_sql('''coalesce(text, '')''')}) AS digest FROM documents",
    "slugs": r"""
SELECT CASE WHEN s = '' THEN 'src' ELSE s END AS slug, count(*) AS n_rows
FROM (SELECT substr(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(source_title, ''), '[^a-zA-Z0-9\s-]', '', 'g'), '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g'), 1, 40) AS s FROM manifest) GROUP BY 1""",
    "line_scripts": rf"""
WITH lines AS (SELECT source, unnest({_LINES}) AS line FROM documents),
n AS (SELECT source, length(regexp_replace(line, '[^\x{{0A80}}-\x{{0AFF}}]', '', 'g')) AS g, length(regexp_replace(line, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS d, length(regexp_replace(line, '[^A-z]', '', 'g')) AS l FROM lines)
SELECT source, CASE WHEN g + d + l = 0 THEN NULL WHEN g >= d AND g >= l THEN 'gujarati' WHEN d >= l THEN 'devanagari' ELSE 'latin' END AS script, count(*) AS n_lines FROM n GROUP BY 1, 2""",
    "script_profile": r"""
SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x{0A80}-\x{0AFF}]', '', 'g')) AS gujarati, length(regexp_replace(coalesce(text, ''), '[^\x{0900}-\x{097F}]', '', 'g')) AS devanagari,
       length(regexp_replace(coalesce(text, ''), '[^A-z]', '', 'g')) AS latin FROM documents""",
    "corpus_lines": _PIECES + " SELECT doc_id, li, pi, piece FROM kept",
    "corpus_stats": _PIECES + " SELECT count(*) AS n_lines, CAST(coalesce(sum(length(piece)), 0) + count(*) AS BIGINT) AS n_chars FROM kept",
    "corpus_source_counts": _PIECES + " SELECT source, count(*) AS n_lines FROM kept GROUP BY 1",
    "byte_budget_docs": rf"""
WITH sized AS (SELECT doc_id, CAST(strlen(regexp_replace(coalesce(text, ''), '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g')) + 2 AS BIGINT) AS n_bytes FROM documents),
summed AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sized)
SELECT * FROM summed WHERE before < {BYTE_BUDGET}""",
    "char_vocab": _CHARS + " SELECT char, n, CAST(char_id AS BIGINT) AS char_id FROM vocab",
    "char_encode": _CHARS + " SELECT row_no, count(*) AS n, CAST(sum(char_id) AS BIGINT) AS total FROM chars JOIN vocab USING (char) GROUP BY 1",
    "train_val_split": _CHARS
    + " SELECT CASE WHEN pos < (SELECT floor((max(pos) + 1) * 0.98) FROM stream) THEN 'train' ELSE 'val' END AS part, count(*) AS n_tokens, min(pos) AS first, max(pos) AS last FROM stream GROUP BY 1",
    "token_windows": _CHARS
    + f"""
SELECT a.pos // {WINDOW} AS w, CAST(sum(a.char_id) AS BIGINT) AS x_sum, CAST(sum(b.char_id) AS BIGINT) AS y_sum FROM stream a JOIN stream b ON b.pos = a.pos + 1
GROUP BY 1 HAVING count(*) = {WINDOW}""",
    "char_decode": "SELECT row_no, transcript AS text FROM verified WHERE transcript <> ''",
    "split_fallback": "SELECT part, CAST(CASE part WHEN 'val' THEN n ELSE floor(n * 0.98) END AS BIGINT) AS n_tokens FROM (SELECT sum(length(coalesce(transcript, ''))) AS n FROM verified), (SELECT unnest(['train', 'val']) AS part)",
    "token_batches": _CHARS
    + f"""
, sized AS (SELECT (max(pos) + 1 - 1) // {WINDOW * 500} AS rounds FROM stream),
wins AS (SELECT a.pos // {WINDOW} AS w, CAST(sum(a.char_id) AS BIGINT) AS x_sum, CAST(sum(b.char_id) AS BIGINT) AS y_sum FROM stream a JOIN stream b ON b.pos = a.pos + 1 GROUP BY 1),
steps AS (SELECT unnest(range({STEPS})) AS step)
SELECT step, CAST(w % 500 AS INT) AS b, x_sum, y_sum FROM steps, sized, wins WHERE rounds > 0 AND w // 500 = step % rounds""",
    "random_windows": _CHARS
    + f"""
, sized AS (SELECT max(pos) + 1 AS n FROM stream),
drawn AS (SELECT w, CAST('0x' || substr(md5('1:' || w), 1, 13) AS BIGINT) % (n - {WINDOW}) AS place FROM (SELECT unnest(range(1000)) AS w), sized)
SELECT w, CAST(sum(char_id) FILTER (pos < place + {WINDOW}) AS BIGINT) AS x_sum, CAST(sum(char_id) FILTER (pos > place) AS BIGINT) AS y_sum FROM drawn JOIN stream ON pos BETWEEN place AND place + {WINDOW} GROUP BY w""",
    "token_cache": _CHARS + " SELECT count(*) AS n_tokens, CAST(sum(char_id) AS BIGINT) AS total FROM stream",
    "label_gate": "SELECT count(*) AS n_rows, count(*) FILTER (length(text) > 448) AS n_dropped FROM documents",
    "padded_labels": _CHARS
    + """
, rows_ AS (SELECT row_no, row_no // 32 AS batch, count(*) AS n, CAST(sum(char_id) AS BIGINT) AS total, min(char_id) FILTER (p = 1) AS head FROM chars JOIN vocab USING (char) GROUP BY 1, 2),
wide AS (SELECT batch, max(n) AS most, bool_and(head = 0) AS every FROM rows_ GROUP BY 1)
SELECT batch, row_no, CAST(CASE WHEN every THEN most - 1 ELSE most END AS INT) AS n, CAST(total - 100 * (most - n) AS BIGINT) AS total FROM rows_ JOIN wide USING (batch)""",
    "loss_means": """
SELECT step, round(t, 9) AS train, round(v, 9) AS val, round(v - t, 9) AS gap
FROM (SELECT event_id % 50 AS step, avg(value) FILTER (event_id % 2 = 0) AS t, avg(value) FILTER (event_id % 2 = 1) AS v FROM events WHERE event_id // 50 < 20 GROUP BY 1)""",
    "lr_schedule": """
SELECT step, round(CASE WHEN step < 200 THEN 6e-4 * (step + 1) / 200 WHEN step > 1500 THEN 6e-5 ELSE 6e-5 + 0.5 * (1.0 + cos(pi() * (step - 200) / 1300.0)) * (6e-4 - 6e-5) END, 12) AS lr
FROM (SELECT unnest(range(2001)) AS step)""",
    "bpe_pairs": _WORDS + " SELECT a, b, n FROM pairs",
    "top_k_candidates": _WORDS
    + ", best AS (SELECT *, rank() OVER (PARTITION BY a ORDER BY n DESC) AS r FROM pairs) SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM best WHERE r <= 10",
    "url_hosts": f"SELECT {_HOST} AS host, count(*) AS n_docs FROM documents GROUP BY 1",
    "url_ids": "SELECT doc_id, substr(sha1(source_url), 1, 12) AS url_id FROM documents",
    "prompt_ids": "SELECT row_no, 'selfrec-' || substr(sha1('speaker1' || chr(10) || coalesce(transcript, '')), 1, 8) AS prompt_id FROM verified",
    "card_ids": "SELECT id, CAST(r AS INT) AS r, 'p' || lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INT), '0') || '-r' || r AS card, 'p' || lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INT), '0') AS phrase FROM (SELECT DISTINCT id, unnest([1, 2]) AS r FROM phrasebook)",
    "page_plan": rf"""
SELECT url, CAST(page AS INT) AS page, CASE WHEN page = 1 THEN url ELSE regexp_replace(url, '/$', '') || '/page/' || page || '/' END AS page_url
FROM (SELECT DISTINCT 'https://' || {_HOST} || '/' AS url FROM documents WHERE {_HOST} IS NOT NULL), (SELECT unnest(range(1, 6)) AS page)""",
    "link_kinds": r"""
SELECT CASE WHEN contains(source_url, 'list=') THEN 'playlist' WHEN regexp_matches(source_url, '/(channel/|c/|user/|@)') THEN 'channel' WHEN v <> '' THEN 'video' ELSE 'other' END AS kind, count(*) AS n_rows, count(DISTINCT nullif(v, '')) AS n_videos
FROM (SELECT source_url, regexp_extract(source_url, '(?:v=|youtu\.be/)([\w-]{11})', 1) AS v FROM manifest) GROUP BY 1""",
}


def queries() -> dict[str, Query]:
    own = [
        normalize_text, lexicon_audit, variant_fold, roman_lookup, dev_to_guj_ingest, dev_to_guj_text, dev_to_guj_lexicon, guj_to_roman, slugs, line_scripts, script_profile, skeletons_gujarati,
        skeletons_roman, auto_roman, corpus_lines, corpus_stats, corpus_source_counts, kutchi_corpus_lines, kutchi_corpus_stats, kutchi_corpus_source_counts, byte_budget_docs, char_vocab, char_encode, char_decode, train_val_split, split_fallback, token_windows, token_batches, random_windows, token_cache, label_gate, padded_labels, loss_means, lr_schedule, bpe_pairs, bpe_train,
        chars_per_token, top_k_candidates, html_extract, html_links, url_hosts, url_ids, link_kinds, prompt_ids, card_ids, page_plan,
    ]
    return {q.__name__: q for q in own}


def _romanised_sql(column: str) -> str:
    """The roman draft in SQL: inherent vowels, vowel signs after consonants, then letter by letter."""
    consonant, voiced = f"[{''.join(script.CONSONANTS)}]", f"[{''.join(script.CONSONANTS + script.VOWELS + script.SIGNS)}]"
    out = column
    for _ in range(2):  # a match takes two letters, so of three in a row the second pass sees the rest
        out = rf"regexp_replace({out}, '({consonant})({voiced})', '\1a\2', 'g')"
    for sign, sound in zip([*script.MATRAS, script.VIRAMA], [*script.MATRA_SOUNDS, ""]):
        out = rf"regexp_replace({out}, '({consonant}){sign}', '\1{sound}', 'g')"
    for letter, sound in zip(script.CONSONANTS + script.VOWELS + script.SIGNS, script.CONSONANT_SOUNDS + script.VOWEL_SOUNDS + script.SIGN_SOUNDS):
        out = f"replace({out}, '{letter}', '{sound}')"
    return f"translate({out}, '{''.join(chr(0x0AE6 + d) for d in range(10))}', '0123456789')"


def _skeleton_roman_sql(column: str) -> str:
    """The roman skeleton in SQL; runs of a letter are collapsed as a list."""
    out = f"lower(coalesce({column}, ''))"
    for spelled, sound in script.ROMAN_SPELLINGS:
        out = f"replace({out}, '{spelled}', '{sound}')"
    out = rf"translate(regexp_replace({out}, '[^\p{{L}}]', '', 'g'), '{script.ROMAN_LETTERS}', '{script.ROMAN_CLASSES}')"
    return f"(SELECT coalesce(array_to_string(list_filter(l, lambda c, i: i = 1 OR l[i - 1] <> c), ''), '') FROM (SELECT string_split({out}, '') AS l))"


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans.curation_queries import _alternates_sql, _skeleton_sql

    draft = _romanised_sql("coalesce(transcript, '')")
    book = f"SELECT id, unnest(range(len(g))) AS vi, g, r FROM (SELECT id, {_alternates_sql('kutchi_guj')} AS g, {_alternates_sql('kutchi_roman')} AS r FROM once)"
    return ORACLE | {
        "skeletons_gujarati": f"SELECT row_no, {_skeleton_sql('transcript')} AS skel FROM verified",
        "skeletons_roman": f"SELECT id, {_skeleton_roman_sql('kutchi_roman')} AS skel FROM phrasebook",
        "guj_to_roman": f"SELECT row_no, {draft} AS roman FROM verified",
        "auto_roman": f"SELECT row_no, CASE WHEN coalesce(roman, '') = '' OR roman = {draft} THEN {draft} ELSE roman END AS roman FROM verified",
        "roman_lookup": rf"""
WITH once AS (SELECT DISTINCT id, kutchi_guj, kutchi_roman FROM phrasebook), e AS ({book}), v AS (SELECT id, vi, g[vi + 1] AS guj, lower(trim(coalesce(r[vi + 1], r[1], ''))) AS roman FROM e),
known AS (SELECT roman, arg_min(guj, id * 1000 + vi) AS guj FROM v WHERE roman <> '' GROUP BY 1)
SELECT id, kutchi_roman AS roman, guj FROM once LEFT JOIN known ON known.roman = lower(regexp_replace(kutchi_roman, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))""",
        "html_links": "SELECT concat_ws('#', source_url, doc_id) AS url, CAST(0 AS INT) AS k, concat_ws('#', source_url, doc_id) AS link FROM documents",
    }
