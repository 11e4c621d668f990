"""Sources, sinks, planning, windows of tokens and streams: plain readings, random cases, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon, script
from corpusloom.operators import align, corpus, ingest, lm, segments
from corpusloom.sources import external, html, records
from corpusloom.streaming import incremental


def test_corpus_files_keep_their_order(spark, tmp_path):
    d = spark.createDataFrame([(j, f"line {j:05d}") for j in random.Random(1).sample(range(5000), 5000)], "k int, line string")
    records.write_corpus(d, "line", ["k"], str(tmp_path / "c"))
    lines = [line for f in sorted((tmp_path / "c").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == [f"line {j:05d}" for j in range(5000)]
    assert records.read_corpus(spark, str(tmp_path / "c")).select(F.countDistinct("file")).first()[0] >= 1


def test_batches_are_arrays_of_their_own(spark, tmp_path):
    path = str(tmp_path / "b")
    d = spark.createDataFrame([(j // 3, j, None if j == 4 else f"ક{j}") for j in range(7)], "batch long, n long, t string")
    for rows in (d, d.filter("batch < 2")):
        records.write_batches(rows, path)
        assert sorted(f.name for f in (tmp_path / "b").glob("*.json")) == [f"batch_{b:03d}.json" for b in range(rows.select("batch").distinct().count())]
        assert {tuple(r) for r in records.read_array(spark, path, "n LONG, t STRING").collect()} == {(r["n"], r["t"]) for r in rows.collect()}
    assert records.read_array(spark, str(tmp_path / "none"), "n LONG").count() == 0
    (tmp_path / "b" / "batch_009.json").write_text("[{")
    with pytest.raises(Exception):
        records.read_array(spark, path, "n LONG, t STRING").collect()


def test_kept_tables_are_made_once(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    made = []

    def make(missing):
        made.append(missing.count())
        return d.join(missing, "k")

    path = str(tmp_path / "x")
    assert records.extended(d.filter("k = 'a'").select("k"), path, ["k"], make).count() == 1
    assert {r["k"] for r in records.extended(d.select("k"), path, ["k"], make).collect()} == {"a", "b"} and made == [1, 2]
    assert records.cached(spark, str(tmp_path / "y"), lambda: d).count() == records.cached(spark, str(tmp_path / "y"), lambda: d.limit(0)).count() == 3
    assert records.replace(d, str(tmp_path / "z"), dry_run=True) == 3 and not (tmp_path / "z").exists()
    assert records.replace(d, str(tmp_path / "z")) == 3 and records.by_source(d, "k", ("v",)).count() == 3


def test_pages_are_fetched_or_marked(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>ક</h1>", encoding="utf-8")
    urls = [f"file://{tmp_path}/a.html", f"file://{tmp_path}/none.html"]
    want = {(urls[0], True, "<h1>ક</h1>"), (urls[1], False, None)}
    assert {tuple(r) for r in external.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), retries=2, wait_s=0.0).collect()} == want
    spark.dataSource.register(external.PageSource)
    assert {tuple(r) for r in spark.read.format("pages").option("urls", "\n".join([*urls, " "])).load().collect()} == want


def test_first_title_counts(spark):
    page = "<h1>One</h1><h1 class='entry-title'>Two</h1><div class='entry-content'><p>કચ્છી બોલી</p></div>"
    assert html.posts(spark.createDataFrame([("https://a.b/", page)], "url string, html string")).first()["title"] == "One"


def test_planning(spark):
    links = ["https://y/watch?v=abcdefghijk", "abcdefghijk", " zzzzzzzzzzz ", "https://y/playlist?list=1", "https://y/@c", "", None, "https://youtu.be/zzzzzzzzzzz"]
    d = spark.createDataFrame([(j, u) for j, u in enumerate(links)], "n int, url string")
    assert {tuple(r) for r in ingest.first_videos(d).collect()} == {("abcdefghijk", 0), ("zzzzzzzzzzz", 2)}
    rows = spark.createDataFrame([("a\tb\tc",), ("a",), (None,)], "line string").select(ingest.id_title(F.col("line")).alias("p")).collect()
    assert [(r["p"]["id"], r["p"]["title"]) for r in rows[:2]] == [("a", "b\tc"), ("a", "")]
    lengths = spark.createDataFrame([(0.4,), (0.39,), (None,)], "duration double")
    assert ingest.recorded(lengths).count() == 1 and ingest.harvest_counts(spark.createDataFrame([], "video_id string, cards int, status string")).first().asDict() == {"n_videos": 0, "n_ok": 0, "n_cards": 0}
    known = spark.createDataFrame([("ab", "અબ")], "roman string, guj string")
    assert [r["guj"] for r in lexicon.looked_up(spark.createDataFrame([(" AB",), ("x",), (None,)], "t string"), "t", known).orderBy("t").collect()].count("અબ") == 1


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    span = lambda: (a := rng.uniform(-50, 50), a + rng.choice([-1.0, 0.0, 0.5, 3.0, 40.0, 1e12, 1e17]))
    ws = [(rng.choice(["s", "t", None]), j, *span()) for j in range(60)] + [("s", 60, None, 1.0)]
    cs = [(rng.choice(["s", "t", None]), f"c{j}", j, *span()) for j in range(60)] + [("s", "c60", 60, 1.0, None)]
    w, c = spark.createDataFrame(ws, "e string, w int, ws double, we double"), spark.createDataFrame(cs, "e string, id string, ord int, cs double, ce double")
    want = {a[1]: [b[1] for b in cs if a[0] and a[0] == b[0] and None not in (*a, *b) and a[3] > a[2] and b[4] > b[3] and b[3] < a[3] and b[4] > a[2]] for a in ws}
    got = segments.overlapping(w, c, "e", 2.0)
    assert {r["w"]: r["ids"] for r in got.collect()} == {k: v for k, v in want.items()}
    assert segments.overlapping(w, c.limit(0), "e", 2.0).filter("n > 0").count() == segments.overlapping(w.limit(0), c, "e", 2.0).count() == 0


def test_token_windows_against_slices(spark):
    rng = random.Random(3)
    texts = [(j * 7, "".join(rng.choice("abcકખ😀 ") for _ in range(rng.choice([0, 1, 3, 50, 400])))) for j in range(40)] + [(999, None)]
    d = spark.createDataFrame(texts, "n long, t string")
    vocabulary = lm.char_vocabulary(d, "t")
    ids = {r["char"]: r["char_id"] for r in vocabulary.collect()}
    whole = [ids[c] for _, t in texts for c in t or ""]
    encoded = lm.encode_chars(d, "n", "t", vocabulary)
    assert {r["n"]: r["text"] for r in lm.decode_chars(encoded, "n", vocabulary).collect()} == {n: t for n, t in texts if t}
    stream = lm.placed(encoded, "n").persist()
    assert [r["token"] for r in lm.token_stream(encoded, "n").orderBy("pos").collect()] == whole
    n, length = len(whole), 16
    got = {r["w"]: (r["x"], r["y"]) for r in lm.windows(stream, length).collect()}
    assert got == {w: (whole[w * length : w * length + length], whole[w * length + 1 : w * length + length + 1]) for w in range((n - 1) // length)}
    steps, rows = 9, n // length // 4
    per, want, pos = rows * length, {}, 0
    for s in range(steps):
        pos = 0 if pos + per + 1 > n else pos
        want |= {(s, b): whole[pos + b * length : pos + (b + 1) * length] for b in range(rows)}
        pos += per
    assert {(r["step"], r["b"]): r["x"] for r in lm.batches(stream, length, rows, steps).collect()} == want
    assert all(r["y"][:-1] == r["x"][1:] and len(r["x"]) == length for r in lm.random_windows(stream, length, 50).collect()) and lm.random_windows(stream, length, 50).count() == 50
    for least, edge in ((0, int(n * 0.98)), (n, 0)):
        parts = {p: sorted((r["before"], r["tokens"]) for r in lm.split_stream(stream, least=least).filter(F.col("part") == p).collect() if r["tokens"]) for p in ("train", "val")}
        assert [x for _, t in parts["train"] for x in t] == whole[: int(n * 0.98)] and [x for _, t in parts["val"] for x in t] == whole[edge:]
    none = stream.limit(0)
    assert lm.windows(none, 4).count() == lm.batches(none, 4, 2, 3).count() == lm.random_windows(none, 4, 5).count() == 0


def test_labels_and_losses(spark):
    d = spark.createDataFrame([(0, 1, [5, 1]), (0, 2, [5, 1, 2]), (1, 3, [5]), (1, 4, [6, 7]), (2, 5, [])], "b int, r int, t array<long>")
    assert {r["r"]: r["labels"] for r in lm.padded_batches(d, "b", "r", "t", first=5).collect()} == {1: [1, -100], 2: [1, 2], 3: [5, -100], 4: [6, 7], 5: []}
    assert lm.gate_counts(d, "t", 2).first().asDict() == {"n_rows": 5, "n_dropped": 1} and lm.label_gate(d, "t", 2).count() == 4
    losses = spark.createDataFrame([(0, "train", 0, 1.0), (0, "train", 1, 3.0), (0, "val", 0, 5.0), (0, "val", 25, 99.0)], "step int, part string, k int, loss double")
    assert tuple(lm.loss_means(losses).first()) == (0, 2.0, 5.0, 3.0)


def test_byte_budget_against_a_running_sum(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PAGE", 4)
    rng = random.Random(2)
    rows = [(j * 5 + rng.choice([0, 1, 3]), rng.choice([None, "", " કa ", "x" * rng.randint(1, 40)])) for j in range(200)]
    want, total = set(), 0
    for k, t in sorted(rows, key=lambda r: r[0]):
        if total < 900:
            want.add((k, total))
        total += len((t or "").strip().encode()) + 2
    assert {(r["k"], r["before"]) for r in corpus.byte_budget(spark.createDataFrame(rows, "k long, t string"), "k", "t", 900).collect()} == want


def test_state_is_kept_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([f"i{k}" for k in range(30)]), j, rng.choice(["a", None])) for j in rng.sample(range(400), 400)]
    want = {}
    for chunk in range(4):
        some = rows[chunk * 100 : chunk * 100 + 100]
        spark.createDataFrame(some, "id string, seq long, v2 string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for i, s, v in some:
            if s > want.get(i, (-1, None))[0]:
                want[i] = (s, v)
        stream = incremental.file_stream(spark, str(tmp_path / "in"), "id string, seq long, v2 string", "parquet")
        incremental.upsert_state(stream, str(tmp_path / "state"), str(tmp_path / "check"), parts=5).awaitTermination()
        assert {r["id"]: (r["seq"], r["v2"]) for r in incremental.current_state(spark, str(tmp_path / "state")).collect()} == want
    corrections = incremental.current_state(spark, str(tmp_path / "none"), "id string, seq long")
    assert corrections.count() == 0
    assert all(len(list(p.glob("v=*"))) <= 2 for p in (tmp_path / "state").glob("part=*"))


def test_scripts_of_odd_texts(spark):
    d = spark.createDataFrame([(None,), ("",), ("क़ é",), ("ખ઼ટ",)], "t string")
    assert [r["x"] for r in d.select(script.nfc(F.col("t")).alias("x")).collect()] == [None, "", "क़ é", "ખ઼ટ"]
    assert [r["x"] for r in d.select(script.line_script(F.col("t")).alias("x")).collect()][1:] == [None, "devanagari", "gujarati"]
    assert align.probes(spark.createDataFrame([], "id int, video_id string, kutchi_guj string, kutchi_roman string")).count() == 0
