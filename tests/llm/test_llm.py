"""Training-data operators: against brute force, round trips, held-out accuracy, and edge cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language, mixing, nearcopies, overlap, packing, sampling, splits, subjects, survivors, tokens

VERIFIED = "row_no long, id string, source_id string, start double, end double, duration double, transcript string, verified_by string, updated_at timestamp_ntz, track string"


def verified(spark, rows):
    return spark.createDataFrame([(*r[:9], "t") for r in rows], VERIFIED)


# ---- splits ----

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def test_splits_keep_sources_together(spark):
    rng = random.Random(1)
    rows = [(j, f"i{j}", rng.choice(["a", " A ", "b", None, "", *(f"s{k}" for k in range(60))]), None, None, rng.choice([None, -1.0, float("nan"), 3.0, 8.0]), None, rng.choice([None, "human", "x"]), None) for j in range(900)]
    rows += [(j, "dup", "s1" if j == 1000 else None, None, None, 2.0, None, None, None) for j in range(1000, 1003)]
    d, t = verified(spark, rows), spark.createDataFrame(TARGETS, "split string, share double")
    out = splits.assign(d, t, searches=2)
    got = {r["row_no"]: r["split"] for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    by = {}
    for r in rows:
        if r[2] and r[2].strip():
            by.setdefault(r[2].strip().lower(), set()).add(got[r[0]])
    assert all(len(s) == 1 for s in by.values()) and len({got[j] for j in range(1000, 1003)}) == 1
    shares = {r["split"]: r["share"] for r in splits.report(d, out, t).collect()}
    assert all(abs(shares[s] - w) < 0.02 for s, w in TARGETS)
    assert got == {r["row_no"]: r["split"] for r in splits.assign(d.repartition(7).orderBy(F.desc("row_no")), t, searches=2).collect()}
    assert splits.assign(d.limit(0), t, searches=1).count() == 0
    assert splits.assign(d, t.limit(0)).count() == 0


def test_anneal_improves_on_its_start():
    rng = np.random.default_rng(0)
    sizes = rng.exponential(10, 200)
    labels = sizes[:, None] * rng.dirichlet([1, 1], 200)
    start = rng.integers(3, size=200)
    want = sizes.sum() * np.array([0.8, 0.1, 0.1])
    found, cost = splits.anneal(sizes, labels, want, start, 1)
    assert cost < 0.02 and splits.anneal(sizes, labels, want, found, 2)[1] <= cost + 1e-9


# ---- survivors ----


def linked(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    k = lambda s: (s or "").strip().lower()
    for a, b in itertools.combinations(rows, 2):
        same = k(a[1]) and k(a[1]) == k(b[1])
        near = k(a[2]) and k(a[2]) == k(b[2]) and None not in (a[3], a[4], b[3], b[4]) and max(abs(round(a[j] * 1000) - round(b[j] * 1000)) for j in (3, 4)) <= 100
        if same or near:
            parent[root(a[0])] = root(b[0])
    return {r[0]: root(r[0]) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_best_rows_against_union_find(spark, seed):
    import datetime as dt

    rng = random.Random(seed)
    when = lambda: rng.choice([None, dt.datetime(2026, 1, rng.randint(1, 5))])
    rows = [(j, rng.choice([None, " ", *(f"I{k} " for k in range(60))]), rng.choice(["s", " S", "t", None]), s := rng.choice([None, rng.randint(0, 300) / 50]), None if s is None else s + rng.randint(0, 8) / 50, 1.0, "x", rng.choice([None, "human", "Machine-Card ", "gold"]), when()) for j in range(90)]
    rows = [(j, i, e, s, t, *rest) for j, i, e, s, t, *rest in rows]
    group = linked(rows)
    tier = {None: 0, "human": 0, "Machine-Card ": 1, "gold": 3}
    members = {}
    for r in rows:
        members.setdefault(group[r[0]], []).append(r)
    want = {}
    for g in members.values():
        if len(g) > 1:
            best = min(g, key=lambda r: (tier[r[7]], r[8] is None, -(r[8] or dt.datetime(2000, 1, 1)).timestamp(), r[0]))[0]
            want |= {r[0]: best for r in g}
    d = verified(spark, rows + rows[:5])
    assert {r["row_no"]: r["best_row_no"] for r in survivors.best_rows(d).collect()} == want


def test_survivors_vote_per_field(spark):
    import datetime as dt

    new, old = dt.datetime(2026, 1, 1), dt.datetime(2020, 1, 1)
    d = verified(spark, [(0, "a", "s", 1.0, 2.0, 5.0, "Good  text", "machine-card", new), (1, "a", "s", 1.0, 2.0, None, "other", "machine-card", old), (2, "A", None, None, None, 5.0004, " good text", "gold", new)])
    r = survivors.survivors(d, survivors.clips(d), ["transcript", "duration", "source_id", "track"]).collect()
    assert [(x["n_rows"], x["transcript"], x["duration"], x["source_id"], x["track"]) for x in r] == [(3, "Good  text", 5.0, "s", "t")]
    assert survivors.survivors(d.limit(0), survivors.clips(d.limit(0)), ["transcript"]).count() == survivors.best_rows(d.limit(0)).count() == 0


# ---- language ----


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = {
        "english": "the house of rain is tall and somebody wrote about a book near our village today".split(),
        "hindi": "मेरा भाई सुबह पुराना मकान लेकिन रास्ता देखा है और वे कल चले गए".split(),
        "gujarati": "મારી બહેન સવારે જૂનું મકાન પરંતુ રસ્તો જોયું છે અને તેઓ ગઈકાલે ગયા".split(),
        "kutchi": "મુંજી ભેણ સુભુ જો જુનો ઘર પણ વાટ ડિઠો આય ને અસીં કાલ્લ વિયા".split(),
    }
    out = []
    for _ in range(n):
        k = rng.choice(list(words))
        out.append((" ".join(rng.choice(words[k]) for _ in range(rng.randint(6, 14))), k))
    return words, out


def test_language_held_out_and_mixed(spark):
    words, rows = corpus(400)
    rng = random.Random(5)
    noisy = [(t, k if rng.random() > 0.1 else rng.choice(list(words))) for t, k in rows]
    d = spark.createDataFrame([(j, t, k) for j, (t, k) in enumerate(noisy)] + [(900, "[music] ♪", "kutchi"), (901, None, "x"), (902, " ", None), (903, rows[0][0] + " — " + next(t for t, k in rows if k != rows[0][1]), "unknown"), (904, rows[1][0], "EN-in" if rows[1][1] == "english" else rows[1][1].upper())], "seq long, transcript string, language string")
    got = {r["n"]: r["language"] for r in language.tagged(d).collect()}
    assert np.mean([got[j] == k for j, (_, k) in enumerate(rows)]) > 0.97
    assert got[900] == "nonspeech" and got[903] == "mixed" and 901 not in got and 902 not in got
    wrong = {r["seq"]: r["language"] for r in language.wrong_labels(d).collect()}
    assert 900 in wrong and 903 in wrong and 904 not in wrong
    parts = [r for r in language.segments(d).collect() if r["seq"] == 903]
    assert [r["part"] for r in sorted(parts, key=lambda r: r["part"])] == [1, 2]


def test_language_without_labels(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, "more", "english")], "seq long, transcript string, language string")
    assert {r["n"]: (r["language"], r["confidence"]) for r in language.tagged(d).collect()} == {1: ("other", 0.0), 2: ("english", 0.0)}
    assert language.tagged(d.limit(0)).count() == 0


# ---- sampling ----


def test_sample_is_stable_and_exact(spark):
    d = spark.range(128 * 20).select(F.col("id").alias("row_no"), F.concat(F.lit("I"), (F.col("id") % 500).cast("string")).alias("id"), F.lit(1).alias("sample_number"))
    whole = {r["row_no"] for r in sampling.sample(d, "row_no").collect()}
    assert len(whole) == 13 * 20
    part = {r["row_no"] for r in sampling.sample(d.repartition(9).filter("row_no % 3 <> 0"), "row_no").collect()}
    assert part == {x for x in whole if x % 3}
    assert whole <= {r["row_no"] for r in sampling.sample(d, "row_no", take=20).collect()}
    ids = sampling.sample(d.unionByName(d.limit(3)), "id")
    chosen = {r["id"] for r in ids.collect()}
    assert ids.filter(F.col("id").isin(*chosen)).count() == d.unionByName(d.limit(3)).filter(F.col("id").isin(*chosen)).count() and 39 <= len(chosen) <= 52
    odd = spark.createDataFrame([(None, None), (-1, " ")], "row_no long, id string")
    assert sampling.sample(odd, "row_no").count() == sampling.sample(odd, "id").count() == sampling.sample(odd.limit(0), "id").count() == 0


def test_register_only_appends(spark):
    rng = random.Random(8)
    rows = [(j, rng.choice([None, " ", *(f" K{rng.randint(0, 900)} ", f"k{rng.randint(0, 900)}")])) for j in range(0, 40_000, 13)]
    d = spark.createDataFrame(rows, "row_no long, id string")
    numbers = lambda df: {r["unit_key"]: r["sample_number"] for r in df.collect()}
    first = sampling.registered(d.filter("row_no < 9000"), "id")
    early, whole = numbers(first), numbers(sampling.registered(d.repartition(7), "id"))
    assert sorted(whole.values()) == list(range(len(whole))) and early.items() <= whole.items()
    assert numbers(sampling.registered(d.filter("row_no >= 9000"), "id", register=first)) == whole == numbers(sampling.registered(d, "id", register=first))
    late = spark.createDataFrame([(-5, "late"), (-4, "k1")], "row_no long, id string")
    assert numbers(sampling.registered(late, "id", register=sampling.registered(d, "id"))) == whole | {"late": len(whole)}
    some = {r["id"].strip().lower() for r in sampling.sample(d.filter("row_no < 9000"), "id").collect()}
    every = {r["id"].strip().lower() for r in sampling.sample(d, "id").collect()}
    assert some <= every and all(sum(whole[k] // 128 == block for k in every) == 13 for block in range(len(whole) // 128))
    assert sampling.registered(d.limit(0), "id").count() == 0 and numbers(sampling.registered(d.limit(0), "id", register=first)) == early


# ---- overlap ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("કખગઘચછજઝટઠ ાિીુે") for _ in range(rng.randint(10, 60))) for _ in range(12)]

    def edited(t):
        out = list(t)
        for _ in range(rng.randint(0, len(t) // 4)):
            j = rng.randrange(len(out))
            out[j : j + 1] = rng.choice([[], [rng.choice("abક")], [out[j], rng.choice("abખ")]])
        return "".join(out)

    rows = [(j, rng.choice([None, "", *(f"i{k}" for k in range(40))]), edited(rng.choice(base)) if rng.random() < 0.95 else None) for j in range(160)]
    sides = {j: rng.choice(["train", "train", "validation", "Test "]) for j, *_ in rows if j % 11}
    d = spark.createDataFrame([(*r, "s") for r in rows], "row_no long, id string, transcript string, source_id string")
    s = spark.createDataFrame(list(sides.items()), "row_no long, split string")
    want = set()
    for a, b in itertools.permutations(rows, 2):
        if sides.get(a[0]) == "train" and sides.get(b[0], "train") != "train":
            x, y = overlap.letters(a[2]), overlap.letters(b[2])
            near = min(len(x), len(y)) >= 12 and distance(x, y) * 5 <= max(len(x), len(y))
            if near or (a[1] and a[1] == b[1]):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    pairs = overlap.cross_split_pairs(d.unionByName(d.limit(4)), s)
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    told = overlap.report(d.unionByName(d.limit(4)), s).first()
    of_eval = {a if sides.get(a) != "train" else b for a, b in want}
    every = overlap.report(d, s).agg(F.sum("n_pairs"), F.sum("n_overlapping")).first()
    assert (every[0], every[1]) == (len(want), len(of_eval)) and told["source_id"] == "s"
    assert overlap.cross_split_pairs(d.limit(0), s).count() == overlap.cross_split_pairs(d, s.limit(0)).count() == 0


def test_overlap_of_texts_of_few_phrases(spark, monkeypatch):
    """Texts that share frequent phrases share pieces with most others; they are counted before a pair is made, in blocks of any size alike."""
    rng = random.Random(5)
    words = ["".join(rng.choice("કખગઘચછજઝટઠડઢતથદધનપફબભમયરલવસહ") for _ in range(rng.randint(4, 9))) for _ in range(25)]
    texts = {"".join(rng.choice(words) for _ in range(rng.randint(6, 14))) for _ in range(300)}
    texts |= {t[:k] + t[k + rng.randint(1, 9) :] for t in sorted(texts)[:60] for k in [rng.randrange(len(t) // 2)]}
    texts = sorted(texts)
    sides = [rng.choice(["train", "eval"]) for _ in texts]
    train, other = ([t for t, s in zip(texts, sides) if s == side] for side in ("train", "eval"))
    # Texts whose lengths alone are a fifth apart need no distance.
    fits = [(x, y) for x in train for y in other if abs(len(x) - len(y)) * 5 <= max(len(x), len(y))]
    near = overlap._Block(other).near(train)
    hits = [(train[i], other[j]) for whose, which in near for i, j in zip(whose, which)]
    assert len(set(hits)) == len(hits) < len(fits) // 50
    want = {p for p in fits if distance(*p) * 5 <= max(map(len, p))}
    assert want and want <= set(hits)
    d = spark.createDataFrame([(t, s == "train", s == "eval") for t, s in zip(texts, sides)], "text string, in_train boolean, in_eval boolean")
    for letters in (300, 10**6):
        monkeypatch.setattr(overlap, "BLOCK_LETTERS", letters)
        got = [tuple(r) for r in overlap.similar_texts(d).collect()]
        assert len(got) == len(want) and set(got) == want


def test_overlap_of_many_letters():
    """So many letters that a piece, its place and its text don't fit into one number."""
    long = "".join(map(chr, [*range(0x4E00, 0x9FFF), *range(0x20000, 0x2A6D0)]))
    block = overlap._Block([long, long[::-1]])
    assert block.known is not None
    assert [(list(a), list(b)) for a, b in block.near([long[5:], long[3:] + "abc", long[1000:] + long[:40000]])] == [([0, 1], [0, 0])]


def test_overlap_of_repeated_letters():
    """A piece that lies at hundreds of places is met more often than a small number holds."""
    block = overlap._Block(["ab" * 1000, "ab" * 900 + "c" * 200, "c" * 2000, "ab" * 600])
    assert [(list(a), list(b)) for a, b in block.near(["ab" * 980, "c" * 1800])] == [([0, 0, 1], [0, 1, 2])]


def test_letters():
    assert overlap.letters("क़ Ab-૧!") == "કab૧" and overlap.letters(None) == ""


# ---- packing and mixing ----


def test_token_counts_add_up():
    count, rng = tokens.counter(f"{tokens.FOLDER}/{tokens.VOCABULARY}"), random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["a", "કા", " ", "  ", "\n", " \n", "1", "?", "don't", "é", "\t"]) for _ in range(rng.randint(0, 30)))
        assert count.count(t) == len(count.encode(t))


def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(2)
    docs = [(j, rng.choice(["a", "b", "c"]), rng.choice([0, rng.randint(1, 90), rng.randint(100, 900)]), rng.choice([7, None, j])) for j in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, copy_key long")
    kinds = spark.createDataFrame([("x", 100), ("y", 256), ("none", 0), (None, 5)], "name string, capacity_tokens int")
    rows = packing.pack(d, kinds, shard_items=150).collect()
    for name, cap in (("x", 100), ("y", 256)):
        by, whole = {}, {}
        for r in rows:
            if r["container"] == name:
                by.setdefault(r["bin"], []).append(r)
                whole.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert all(sum(r["n_tokens"] for r in b) <= cap for b in by.values())
        key = {j: c for j, _, _, c in docs}
        for b in by.values():
            marks = [key[r["doc_id"]] for r in b if key[r["doc_id"]] is not None]
            assert len(marks) == len(set(marks))
        for j, _, n, _ in docs:
            parts = sorted(whole.get(j, []))
            assert sum(p[1] for p in parts) == n and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == -(-n // cap)
    assert packing.pack(d.limit(0), kinds).count() == packing.pack(d, kinds.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [1, 4])
def test_near_copies_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(nearcopies, "FREQUENT", frequent)
    rng = random.Random(frequent)
    words = [f"w{j}" for j in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 20, 60, 120]))] for _ in range(25)]

    def edited():
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        return rng.choice([" ", "  "]).join(t) + rng.choice(["", "", " the same closing line of all these pages here"])

    rows = [(j, edited()) for j in range(150)] + [(900, None), (901, " "), (902, "Ab cd"), (903, "ab  CD")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {j: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for j, t in rows if (w := (t or "").lower().split())}
    parent = {j: j for j in runs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(runs, 2):
        if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) - 1e-9:
            parent[root(a)] = root(b)
    sized = d.select("doc_id", "text").mapInPandas(lambda it: (p.assign(copy_key=pd.array([tokens.copy_key(t) for t in p["text"]], dtype="Int64"))[["doc_id", "copy_key"]] for p in it), "doc_id long, copy_key long")
    got = {r["doc_id"]: r["copy_key"] for r in nearcopies.grouped(sized, d).collect()}
    assert len(got) == len(rows) and got[900] is None and got[901] is None
    by_root, by_group = {}, {}
    for j in runs:
        by_root.setdefault(root(j), set()).add(j)
        by_group.setdefault(got[j], set()).add(j)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values())) and len(by_root) < len(runs)
    assert nearcopies.grouped(sized.limit(0), d.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([60, 50, 40, 30], ["a", "b", "c", "d"], [None] * 4, 100) == [0, 1, 0, 1]
    assert len(set(packing.best_fit([10] * 5, ["a"] * 5, [1] * 5, 100))) == 5
    rng = random.Random(5)
    sizes, sources = sorted((rng.randint(1, 90) for _ in range(400)), reverse=True), [rng.choice("aaab" + "cdefghij") for _ in range(400)]
    quota, bins = packing.quotas(sizes, sources, 100), packing.best_fit(sizes, sources, [None] * 400, 100)
    assert all(n <= quota[s] for (_, s), n in Counter(zip(bins, sources)).items())
    assert packing.best_fit([], [], [], 100) == []


@pytest.mark.parametrize("seed", range(4))
def test_due_copies_fall_short_by_less_than_a_copy(seed):
    rng = random.Random(seed)
    for _ in range(500):
        lengths = sorted(rng.sample(range(1, 5000), rng.randint(1, 12)), reverse=True)
        counts, most = [rng.randint(1, 5) for _ in lengths], rng.randint(1, 4)
        copies = rng.random() * most
        due = mixing.due_copies(lengths, counts, copies, most, rng.random())
        open_ = round(copies * sum(n * k for n, k in zip(lengths, counts))) - sum(n * d for n, d in zip(lengths, due))
        spare = [n for n, k, d in zip(lengths, counts, due) if d < most * k]
        assert all(0 <= d <= most * k for d, k in zip(due, counts)) and 0 <= open_ < min(spare, default=open_ + 1)


def test_mixing_of_copies_in_one_cell(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(7).alias("n_tokens"))
    t = spark.createDataFrame([("A", 1.0, 3)], "source string, share double, max_repeats int")
    mixed, plan = mixing.mix(d, t, total=7.0 * 1234)
    assert mixed.count() == 1234 and {r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1, 2}


def test_mixing_shares_and_caps(spark):
    rng = random.Random(4)
    docs = [(j, s, rng.randint(1, 300)) for j in range(3000) for s in [rng.choice(["a", "a", "a", "B ", "c", None, "other"])]] + [(9000, "tiny", 50), (9001, "a", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 4), ("tiny", 0.05, 3), ("gone", None, 2), ("nothing", 0.1, 2)], "source string, share double, max_repeats int")
    for fill in (True, False):
        mixed, plan = mixing.mix(d, t, fill=fill)
        assert all(r["within_repeats"] and r["within_one_document"] for r in mixing.kept_promises(d, mixed, plan).collect())
        rep = {r["source"]: r for r in mixing.report(mixed, plan).collect()}
        assert all((r["most_repeats"] or 0) <= r["max_repeats"] for r in rep.values())
        assert rep["gone"]["tokens"] == rep["nothing"]["tokens"] == 0
    mixed, plan = mixing.mix(d, t, fill=True)
    rep = {r["source"]: r["share"] for r in mixing.report(mixed, plan).collect()}
    assert rep["b"] / rep["c"] == pytest.approx(2.0, rel=0.05)
    a = sorted(map(tuple, mixed.collect()))
    assert a == sorted(map(tuple, mixing.mix(d.repartition(5), t, fill=True)[0].collect())) and len(a) == len(set(a))
    assert mixing.mix(d.limit(0), t)[0].count() == mixing.mix(d, t.limit(0))[0].count() == 0


# ---- subjects ----


def subject_data(spark):
    rng = random.Random(6)
    topic = {"law": "judge court appeal verdict bail clause".split(), "sea": "boat anchor tide harbour sail keel".split()}
    plain = [f"word{j}" for j in range(80)]
    docs, truth = [], {}
    for j in range(400):
        own = rng.choice([["law"], ["sea"], [], ["law", "sea"]])
        lines = []
        for k in range(10):
            s = [rng.choice(plain) for _ in range(6)]
            if own and k < 8:
                s[2] = rng.choice(topic[own[k % len(own)]])
            lines.append(" ".join(s))
        if not own:
            lines[0] += " judge"
        docs.append((j, ". ".join(lines)))
        truth[j] = set(own)
    labels = [(j, s) for j in range(60) for s in truth[j]] + [(61, "nosuch"), (99999, "law")]
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    return d, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([("law", "x"), ("sea", "y")], "subject string, about string"), truth


def test_subjects_found_and_both_ways_agree(spark, monkeypatch):
    d, labels, areas, truth = subject_data(spark)
    monkeypatch.setattr(subjects, "MOST_DOCS", 0.6)
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects(d, labels, areas).collect()}
    want = {(j, s) for j, ss in truth.items() for s in ss}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 5
    monkeypatch.setattr(subjects, "BROADCAST_TERMS", 0)
    assert got == {(r["doc_id"], r["subject"]) for r in subjects.subjects(d, labels, areas).collect()}
    assert subjects.subjects(d, labels.limit(0), areas).count() == subjects.subjects(d.limit(0), labels, areas).count() == 0


def test_subjects_of_copies_that_are_a_third_of_all_rows(spark):
    d, labels, areas, truth = subject_data(spark)
    text = ". ".join(f"x{'abcdefghij'[k]} Judge said court" for k in range(10))
    copies = [(2000 + j, text if j % 2 else text.upper().replace(". ", " ! ")) for j in range(200)]
    others = [(3000 + j, ". ".join(f"{'abcdefghijklmnopqrst'[(j + k) % 20]}q {'abcdefghijklmnopqrst'[(j * 7 + k) % 20]}z" for k in range(8))) for j in range(300)]
    rows = d.unionByName(spark.createDataFrame(copies + others, "doc_id long, text string"))
    marks = labels.unionByName(spark.createDataFrame([*((2000 + j, "law") for j in range(12)), (2012, "sea")], "doc_id long, subject string"))
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects(rows, marks, areas).collect()}
    assert {x for x in got if 2000 <= x[0] < 2200} == {(2000 + j, "law") for j in range(200)}
    want = {(j, s) for j, ss in truth.items() for s in ss}
    assert len({x for x in got if x[0] < 1000} & want) / len(want) > 0.95


def test_sentences():
    assert subjects.sentences("A b. <p>C&nbsp;d\n\n1 2 3! ક્‍ષ") == [["a", "b"], ["c", "d"], ["ક્ષ"]]
    assert [len(s) for s in subjects.sentences("w " * 70)] == [28, 28, 14] and subjects.sentences(None) == []
