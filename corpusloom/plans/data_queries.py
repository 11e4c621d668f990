"""Queries of the core data problems (packed fields, time coverage) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import coverage, packed
from corpusloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a phrasebook field that holds two or more."""
    return packed.explode_packed(table(spark, sf_dir, "phrasebook"), ["kutchi_guj", "kutchi_roman"], least=2)


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every phrasebook field, single ones too."""
    return packed.explode_packed(table(spark, sf_dir, "phrasebook"), ["kutchi_guj", "kutchi_roman"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap between the clips of a source."""
    return coverage.gaps(table(spark, sf_dir, "manifest"))


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every continuous covered period of a source."""
    return coverage.periods(table(spark, sf_dir, "manifest"))


_CLIPS = r"""
WITH clips AS (
  SELECT lower(trim(source_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS e,
         CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS t
  FROM manifest
  WHERE source_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL
    AND NOT isnan(start) AND NOT isnan("end") AND abs(start) < 9e15 AND abs("end") < 9e15
), kept AS (SELECT e, s, t FROM clips WHERE e <> '' AND t > s),
edged AS (
  SELECT e, s, t, max(t) OVER (PARTITION BY e ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM kept
)"""

_P3_FOUND = _CLIPS + " SELECT e AS source_id, reached AS gap_start_ms, s AS gap_end_ms FROM edged WHERE reached < s"

_P3_PERIODS = (
    _CLIPS
    + """, numbered AS (
  SELECT e, s, t, sum(CASE WHEN reached IS NULL OR reached < s THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM edged
) SELECT e AS source_id, min(s) AS period_start_ms, max(t) AS period_end_ms FROM numbered GROUP BY e, island"""
)


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_values": p2_values, "p3_found": p3_found, "p3_periods": p3_periods}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3_FOUND, "p3_periods": _P3_PERIODS}
