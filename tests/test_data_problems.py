"""Packed fields and time coverage against plain Python, and their edge cases."""

import random

import pytest

from corpusloom.operators import coverage, packed

SEPARATORS = set("/／;|,·،、\n\r")


def plain_split(text):
    """A reader that goes sign by sign."""
    import re

    if text is None:
        return []
    t = text.strip("​﻿ \t\n\r\xa0")
    m = re.fullmatch(r'\[\s*(".*")\s*\]', t, re.S)
    t = m.group(1) if m else t
    numbered = re.match(r"[0-9૦-૯]{1,3}[.)]", t)
    out, cur, quote, depth, i = [], "", None, 0, 0
    while i < len(t):
        c = t[i]
        if quote:
            if quote == '"' and t[i : i + 2] in ('""', '\\"'):
                cur, i = cur + "\0", i + 2
                continue
            if c == quote:
                quote = None
            cur, i = cur + c, i + 1
            continue
        if depth == 0:
            n = re.match(r"[0-9૦-૯]{1,3}[.)](?=\D|$)", t[i:])
            if numbered and n and (i == 0 or t[i - 1] in " \xa0" or t[i - 1] in SEPARATORS):
                out, cur, i = [*out, cur], "", i + n.end()
                continue
            w = re.match(r"(અથવા|or)(?=[\s\xa0])", t[i:])
            if w and i and t[i - 1] in " \xa0\t\n":
                out, cur, i = [*out, cur], "", i + w.end()
                continue
            if c in SEPARATORS:
                out, cur, i = [*out, cur], "", i + 1
                continue
        if c in '"“«':
            quote = {'"': '"', "“": "”", "«": "»"}[c]
        depth += (c in "([") - (c in ")]")
        cur, i = cur + c, i + 1
    values = []
    for v in [*out, cur]:
        v = v.strip("​﻿ \t\n\r\xa0")
        m = re.fullmatch(r'["“«]([^"“”«»]*)["”»]', v, re.S)
        v = (m.group(1).strip(" \xa0\t") if m else v).replace("\0", '"')
        if v:
            values.append(v)
    return values


CASES = [
    ('"a ""b"" c" / d', ['a "b" c', "d"]),
    ('["a", "b, c", "d"]', ["a", "b, c", "d"]),
    ('["a \\"b\\"", "c"]', ['a "b"', "c"]),
    ("1) a 2) b-c (d/e)", ["a", "b-c (d/e)"]),
    ("૧) a ૨) b", ["a", "b"]),
    ("a (b, c); «d, e»|“f”", ["a (b, c)", "d, e", "f"]),
    ("a, , b,", ["a", "b"]),
    ("x or y\nz", ["x", "y", "z"]),
    ("orange", ["orange"]),
    ("\xa0a\xa0/ b", ["a", "b"]),
    ("", []),
    ("  ", []),
    (None, []),
    ("/;|", []),
]


@pytest.mark.parametrize(("text", "values"), CASES)
def test_plain_reader_agrees_with_cases(text, values):
    assert plain_split(text) == values


def test_split_packed_cases_and_random(spark):
    rng = random.Random(7)
    made = []
    for _ in range(300):
        vals = [rng.choice(["ઘર", "vaat", '"a ""q"" b"', "“x, y”", "«m/n»", "k (p; q)", "a-b"]) for _ in range(rng.randint(1, 4))]
        made.append(rng.choice(["; ", "/", " | ", ",  ", " · ", "،  ", "\n", " or "]).join(vals) + rng.choice(["", " /", ","]))
    texts = [t for t, _ in CASES] + made
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, f string").select("id", packed.split_packed(__import__("pyspark.sql.functions").sql.functions.col("f")).alias("v")).collect()
    for r in rows:
        assert r["v"] == plain_split(texts[r["id"]]), texts[r["id"]]


def test_explode_packed_repeats_nulls_empty(spark):
    d = spark.createDataFrame([(1, "a/b", None, 9), (1, "a/b", None, 9), (None, "c;d", "", 1), (2, "x", "y", 2)], "id int, f string, g string, pos int")
    got = sorted(packed.explode_packed(d, ["f", "g"], least=2).collect(), key=str)
    assert sorted((str(r.id), r.field, r.pos, r.value) for r in got) == [("1", "f", 1, "a"), ("1", "f", 2, "b"), ("None", "f", 1, "c"), ("None", "f", 2, "d")]
    assert packed.explode_packed(d.limit(0), ["f", "g"]).count() == 0


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is None or not e.strip() or s is None or t is None or s != s or t != t or abs(s) > 1e10 or abs(t) > 1e10:
            continue
        a, b = round(s * 1000), round(t * 1000)
        if b > a:
            by.setdefault(e.strip().lower(), []).append((a, b))
    gaps, periods = set(), set()
    for e, spans in by.items():
        cur = None
        for a, b in sorted(spans):
            if cur and a > cur[1]:
                periods.add((e, *cur))
                gaps.add((e, cur[1], a))
                cur = None
            cur = (cur[0], max(cur[1], b)) if cur else (a, b)
        periods.add((e, *cur))
    return gaps, periods


@pytest.mark.parametrize("shard", [7, 1000, 3_600_000])
def test_coverage_random(spark, shard):
    rng = random.Random(shard)
    rows = []
    for _ in range(400):
        e = rng.choice(["a", " A", "b", "c ", None, " "])
        s = rng.choice([rng.randint(0, 400) / 100, rng.randint(0, 4000) / 100, None, float("nan"), float("inf")] if rng.random() < 0.1 else [rng.randint(0, 4000) / 100])
        t = None if s is None else s + rng.choice([0, -1, 0.01, 0.5, 0.05, 3.0])
        rows.append((e, s, t))
    rows += rows[:20]
    d = spark.createDataFrame(rows, "source_id string, start double, end double").selectExpr("*", "1 as s", "2 as k", "3 as e")
    gaps, periods = brute(rows)
    assert {tuple(r) for r in coverage.gaps(d, shard_ms=shard).collect()} == gaps
    found = coverage.periods(d, shard_ms=shard).collect()
    assert {tuple(r) for r in found} == periods and len(found) == len(periods)


def test_coverage_empty_and_long(spark):
    d = spark.createDataFrame([("a", 0.0, 1e9), ("a", 5.0, 6.0), ("a", 2e9, 2e9 + 1)], "source_id string, start double, end double")
    assert [tuple(r) for r in coverage.gaps(d).collect()] == [("a", 10**12, 2 * 10**12)]
    assert coverage.gaps(d.limit(0)).count() == coverage.periods(d.limit(0)).count() == 0
