"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import key
from corpusloom.llm import language, mixing, nearcopies, overlap, packing, sampling, splits, subjects, survivors, tokens
from corpusloom.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row of verified, and its component."""
    return splits.assign(table(spark, sf_dir, "verified"), table(spark, sf_dir, "split_targets"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of splits that each source's rows are in: one."""
    verified = table(spark, sf_dir, "verified")
    split = splits.assign(verified, table(spark, sf_dir, "split_targets"))
    named = verified.select("row_no", key(F.col("source_id")).alias("source_id")).filter("source_id IS NOT NULL")
    return named.join(split, "row_no").groupBy("source_id").agg(F.count("*").alias("n_rows"), F.countDistinct("split").alias("n_splits"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, components and shares of each split."""
    verified, targets = table(spark, sf_dir, "verified"), table(spark, sf_dir, "split_targets")
    return splits.report(verified, splits.assign(verified, targets), targets)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a clip with several rows, and the clip's best row."""
    return survivors.best_rows(table(spark, sf_dir, "verified"))


SURVIVING = ["id", "source_id", "source_title", "source_url", "start", "end", "duration", "transcript", "roman", "status", "verified_by", "confidence"]


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per clip, each field the value with most trusted and recent votes."""
    verified = table(spark, sf_dir, "verified")
    return survivors.survivors(verified, survivors.clips(verified), SURVIVING)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcript whose language label is missing or wrong, with the right one."""
    return language.wrong_labels(table(spark, sf_dir, "machine_verify_state"))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and confidence of every transcript."""
    return language.tagged(table(spark, sf_dir, "machine_verify_state")).select(F.col("n").alias("seq"), "label", "language", "confidence", "rejected")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every transcript."""
    return language.segments(table(spark, sf_dir, "machine_verify_state"))


def p6_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 of every 128 row numbers of verified."""
    return sampling.sample(table(spark, sf_dir, "verified"), "row_no").select("row_no", "id", "source_id", "sample_number", "sample_block")


def p6_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13 of every 128 ids of verified in the order of their first rows, with all their rows."""
    return sampling.sample(table(spark, sf_dir, "verified"), "id").select("row_no", "id", "source_id", "sample_number", "sample_block")


def p6_sample_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 of every 16 sources of verified in the order of their first rows, with all their rows."""
    return sampling.sample(table(spark, sf_dir, "verified"), "source_id", take=4, block=16).select("row_no", "id", "source_id", "sample_number", "sample_block")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a training row and an evaluation row of one clip or nearly the same text."""
    return overlap.cross_split_pairs(table(spark, sf_dir, "verified"), table(spark, sf_dir, "clip_splits"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows and pairs per evaluation split and source."""
    return overlap.report(table(spark, sf_dir, "verified"), table(spark, sf_dir, "clip_splits"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sizes, and the groups of copies and near-copies that containers keep apart."""
    documents = table(spark, sf_dir, "documents")
    return checkpoint(nearcopies.grouped(checkpoint(tokens.sized(documents)), documents))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a container of each kind."""
    return packing.pack(_items(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of copies and near-copies of every document with words."""
    return _items(spark, sf_dir).filter("copy_key IS NOT NULL").select("doc_id", F.col("copy_key").alias("copy_group"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: whether every document is in it as a whole, no bin is overfull and only long documents are cut."""
    docs, sizes = _items(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    return packing.kept_promises(docs, sizes, packing.pack(docs, sizes))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are, and how far sources are spread over them."""
    docs = _items(spark, sf_dir)
    return packing.fill_report(packing.pack(docs, table(spark, sf_dir, "pack_sizes")), docs)


def _mix(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    docs = checkpoint(tokens.sized(table(spark, sf_dir, "documents")))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"), **how)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the named sources, each at its share as far as its repeats allow."""
    return _mix(spark, sf_dir, fill=True)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that this mixture reached."""
    return mixing.report(*_mix(spark, sf_dir, fill=True))


def p9_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mixture in which no source lacks repeats for its share."""
    return mixing.report(*_mix(spark, sf_dir))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source keeps to its repeats and reaches its planned tokens up to one document, in either mixture."""
    docs = checkpoint(tokens.sized(table(spark, sf_dir, "documents")))
    kept = None
    for fill in (True, False):
        k = mixing.kept_promises(docs, *mixing.mix(docs, table(spark, sf_dir, "mix_targets"), fill=fill)).withColumn("filled", F.lit(fill))
        kept = k if kept is None else kept.unionByName(k)
    return kept


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject that a fifth of a document's sentences are about."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject."""
    return subjects.composition(_subjects(spark, sf_dir), table(spark, sf_dir, "documents"))


_P4_FOUND = r"""
WITH RECURSIVE rows AS (
  SELECT row_no, nullif(lower(trim(id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') AS i,
         nullif(lower(trim(source_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '') AS e,
         CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS t,
         CASE coalesce(nullif(lower(trim(verified_by, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), ''), 'human')
           WHEN 'human' THEN 0 WHEN 'machine-card' THEN 1 WHEN 'machine-consensus' THEN 2 ELSE 3 END AS tier, updated_at
  FROM verified
), edges AS (
  SELECT a.row_no AS u, b.row_no AS v FROM rows a JOIN rows b ON a.i = b.i AND a.row_no <> b.row_no
  UNION SELECT a.row_no, b.row_no FROM rows a JOIN rows b ON a.e = b.e AND a.row_no <> b.row_no AND abs(a.s - b.s) <= 100 AND abs(a.t - b.t) <= 100
), reach AS (
  SELECT DISTINCT u, u AS v FROM edges
  UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u
), best AS (
  SELECT reach.u AS row_no, reach.v AS best_row_no,
         row_number() OVER (PARTITION BY reach.u ORDER BY rows.tier, rows.updated_at DESC NULLS LAST, rows.row_no) AS k
  FROM reach JOIN rows ON rows.row_no = reach.v
) SELECT row_no, best_row_no FROM best WHERE k = 1"""


def _p4_survivors_sql() -> str:
    """Votes per field in SQL, over the clips of ``_P4_FOUND``."""
    head = _P4_FOUND[: _P4_FOUND.index(", best AS (")]
    blank = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
    same = lambda f: f"CAST(round({f}, 3) AS VARCHAR)" if f in ("start", '"end"', "duration", "confidence") else rf"regexp_replace(lower(trim({f}, {blank})), '[\s\p{{Z}}]+', ' ', 'g')"
    fields = ['"end"' if f == "end" else f for f in SURVIVING]
    won = [
        f"""w{j} AS (SELECT class, arg_max(raw, {{'v': votes, 'o': ord}}) AS value FROM (SELECT class, {same(f)} AS same, sum(vote) AS votes, max(ord) AS ord, arg_max({f}, ord) AS raw FROM base WHERE {same(f)} <> '' GROUP BY 1, 2) GROUP BY 1)"""
        for j, f in enumerate(fields)
    ]
    return (
        head
        + f""", linked AS (SELECT u AS row_no, min(v) AS class FROM reach GROUP BY 1),
base AS (SELECT verified.*, coalesce(class, row_no) AS class, {{'k': trust, 'at': coalesce(updated_at, TIMESTAMP '0001-01-01'), 'r': -row_no}} AS ord,
         trust * CAST(coalesce(least(1e3, pow(2.0, (floor(epoch(updated_at)) - epoch(TIMESTAMP '2026-01-01')) / 86400.0 / 180.0)), 0) AS DECIMAL(24,20)) AS vote
  FROM verified LEFT JOIN linked USING (row_no) JOIN (SELECT row_no, CAST(CASE tier WHEN 0 THEN 1000 WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1 END AS DECIMAL(4,0)) AS trust FROM rows) USING (row_no)),
sizes AS (SELECT class, count(*) AS n_rows FROM base GROUP BY 1), """
        + ", ".join(won)
        + " SELECT class AS clip, n_rows, "
        + ", ".join(f"w{j}.value AS {f}" for j, f in enumerate(fields))
        + " FROM sizes "
        + " ".join(f"LEFT JOIN w{j} USING (class)" for j in range(len(fields)))
    )


def _p6_sql(numbered: str, take: int, block: int = 128) -> str:
    return f"""
WITH {numbered},
blocked AS (SELECT *, sample_number // {block} AS sample_block, md5('sample-1:' || (sample_number // {block})) AS h FROM numbered WHERE sample_number >= 0),
placed AS (SELECT *, ((sample_number % {block}) * ((CAST('0x' || substr(h, 1, 6) AS BIGINT) * 2 + 1) % {block}) + CAST('0x' || substr(h, 8, 6) AS BIGINT)) % {block} AS place FROM blocked)
SELECT row_no, id, source_id, sample_number, sample_block FROM placed WHERE place < {take}"""


_P6_ROWS = "numbered AS (SELECT row_no, id, source_id, row_no AS sample_number FROM verified)"


def _p6_keys(column: str) -> str:
    unit = f"nullif(lower(trim({column}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
    return f"""keyed AS (SELECT row_no, id, source_id, {unit} AS unit FROM verified),
register AS (SELECT unit, row_number() OVER (ORDER BY min(row_no), unit) - 1 AS sample_number FROM keyed WHERE unit IS NOT NULL GROUP BY unit),
numbered AS (SELECT row_no, id, source_id, sample_number FROM keyed JOIN register USING (unit))"""


def queries() -> dict[str, Query]:
    own = [p1_splits, p1_kept, p1_report, p4_found, p4_survivors, p5_found, p5_languages, p5_segments, p6_sample_rows, p6_sample_ids, p6_sample_sources]
    own += [p7_found, p7_report, p8_groups, p8_packed, p8_kept, p8_fill, p9_mix, p9_shares, p9_shares_exact, p9_kept, p10_found, p10_composition]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_kept": """
SELECT lower(trim(source_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS source_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_splits FROM verified
WHERE trim(source_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> '' GROUP BY 1""",
        "p4_found": _P4_FOUND,
        "p4_survivors": _p4_survivors_sql(),
        "p6_sample_rows": _p6_sql(_P6_ROWS, 13),
        "p6_sample_ids": _p6_sql(_p6_keys("id"), 13),
        "p6_sample_sources": _p6_sql(_p6_keys("source_id"), 4, 16),
        "p8_kept": "SELECT name AS container, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, TRUE AS whole, TRUE AS within_capacity, TRUE AS cut_if_long, TRUE AS copies_apart FROM pack_sizes",
        "p9_kept": "SELECT lower(source) AS source, TRUE AS within_repeats, TRUE AS within_one_document, filled FROM mix_targets, (SELECT unnest([TRUE, FALSE]) AS filled)",
    }
