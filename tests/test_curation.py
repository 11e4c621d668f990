"""Hand-computed rows for curation, verification, segments, alignment and text functions."""

import difflib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon, metrics, script
from corpusloom.operators import align, consensus, corpus, curate, desk, freeze, ingest, lm, segments
from corpusloom.sources import html, lists, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "roman"), [("મુકે", "muke"), ("કચ્છી", "kachchhee"), ("વાય", "vaay"), ("ા", "ા"), ("૧૨", "12"), ("", "")])
def test_romanised(spark, text, roman):
    assert one(spark, script.romanised(F.lit(text))) == roman


def test_scripts(spark):
    assert one(spark, script.line_script(F.lit("abc મુ"))) == "latin"
    assert one(spark, script.line_script(F.lit("૧૨"))) == "gujarati"
    assert one(spark, script.line_script(F.lit("123 !"))) is None
    assert one(spark, script.slug(F.lit("Hello, World!! Foo_bar"))) == "hello-world-foobar"
    assert one(spark, script.slug(F.lit("કચ્છ"))) == "src"
    assert one(spark, script.skeleton_gujarati(F.lit("કચ્છી"))) == "kcci"
    assert one(spark, script.skeleton_roman(F.lit("kachchhi"))) == "kaci"
    assert [one(spark, f(F.lit("।"))) for f in (script.devanagari_shifted, script.devanagari_for_text, script.devanagari_for_lexicon)] == [".", "।", "."]


def test_normalise(spark):
    n = one(spark, lexicon.normalise(F.lit("આવો, GST(?) ૧૨।")))
    assert (n["text"], n["flags"]) == ("આવો GST(?) ૧૨.", ["devanagari-transliterated", "latin-remnant", "digits"])
    n = one(spark, lexicon.normalise(F.lit("a/b")))
    assert (n["text"], n["flags"]) == ("a b", ["slash-alternates", "latin-remnant"])
    n = one(spark, lexicon.normalise(F.lit("તું. x"), {"તું": "તૂ"}))
    assert n["text"] == "તૂ. x"
    assert one(spark, lexicon.normalise(F.lit(None).cast("string")))["text"] == ""


def test_lexicon_file(spark):
    lines = spark.createDataFrame(list(enumerate(["## note", "roman\tguj\tvar", "a|B\tક\tખ|ગ", "", "a\tઘ"])), "n int, line string")
    roman, variants = lexicon.read_lexicon(lines)
    assert {tuple(r) for r in roman.collect()} == {("a", "ઘ"), ("b", "ક")}
    assert {tuple(r) for r in variants.collect()} == {("ખ", "ક"), ("ગ", "ક")}
    d = spark.createDataFrame([(1, "ખ? x ગ"), (2, None)], "r int, t string")
    assert {tuple(r) for r in lexicon.fold_variants(d, "r", "t", variants).collect()} == {(1, "ક? x ક"), (2, "")}


def test_metrics(spark):
    values = [("", "", 0.0, 0.0), ("x", "", 1.0, 0.0), ("abc", "abd", 1 / 3, 2 / 3), (None, None, 0.0, 0.0)]
    for a, b, cer, agree in values:
        x, y = F.lit(a).cast("string"), F.lit(b).cast("string")
        assert one(spark, metrics.cer(x, y)) == pytest.approx(cer)
        assert one(spark, metrics.agreement(x, y)) == pytest.approx(agree)
    d = spark.createDataFrame([("a b", "a c d")], "r string, h string")
    assert tuple(metrics.error_rates(d, "r", "h").first()) == (100.0, 100.0)
    v = lambda a, b, agreed, s: one(spark, metrics.verdict(F.lit(agreed), F.lit(s), F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert v("hindi", "error", 1.0, False) == "skip"
    assert v("error", "error", 1.0, False) == "adjudicate"
    assert v("error", "error", 0.0, False) == "pending"
    assert v("hindi", "kutchi", 0.85, True) == "lang-review"
    assert one(spark, metrics.neighbour_suspect(F.lit("છે"), F.lit(""), F.lit("kutchi"), F.lit("kutchi"))) is True
    assert one(spark, metrics.neighbour_suspect(F.lit("છે આય"), F.lit(""), F.lit("gujarati"), F.lit("x"))) is False
    d = spark.createDataFrame([("kaci", "kacci"), ("", ""), (None, "a")], "a string, b string")
    got = [r[0] for r in d.select(metrics.matching_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [difflib.SequenceMatcher(None, "kaci", "kacci").ratio(), 1.0, None]


ROW = "o long, id string, source_id string, start double, end double, tier string"


def test_dedups(spark):
    rows = [(0, "h", "s", 1.0, 2.0, "human"), (1, "p", "s", 3.0, 4.0, "machine-consensus"), (2, "p", "s", 1.0, 2.0, "machine-card")]
    d = spark.createDataFrame(rows, ROW)
    assert {r["id"] for r in curate.dedup_tiered(d, ["o"]).collect()} == {"h"}
    assert {r["id"] for r in curate.dedup_sequential(d, "o").collect()} == {"h", "p"}
    turned = spark.createDataFrame([(2 - o, *r) for o, *r in rows], ROW)
    assert curate.dedup_tiered(d.limit(0), ["o"]).count() == curate.dedup_sequential(turned.limit(0), "o").count() == 0


def test_provenance(spark):
    d = spark.createDataFrame([("selfrec-x", "", None), ("a", "", "human"), ("a", "u", "gold"), ("a", "u", ""), (None, "u", "human")], "source_id string, source_url string, verified_by string")
    assert [r[0] for r in d.select(curate.rejection()).collect()] == [None, "missing-provenance", "unknown-tier:gold", None, "missing-provenance"]


def test_freeze_grows_and_holds_apart(spark):
    d = spark.createDataFrame([(f"i{j}", f"s{j % 7}", 60.0 * (j % 5)) for j in range(70)], "id string, source_id string, duration double")
    assert freeze.eval_sources(d, 0.0).count() == 0
    small, big = ({r[0] for r in freeze.eval_sources(d, m).collect()} for m in (10.0, 60.0))
    assert small and small < big
    locked = freeze.eval_sources(d, 10.0)
    grown = {r[0] for r in freeze.eval_sources(d, 60.0, locked=locked).collect()}
    assert small <= grown
    held = freeze.eval_sources(d, 60.0)
    assert freeze.leaks(freeze.train_rows(d, held, "source_id"), held, "source_id").first()[0] == 0
    assert freeze.guard_counts(d, freeze.eval_clips(d, 5.0)).first()["n_rows"] == 70
    assert freeze.mode(d.filter("source_id = 's1'")).first()["mode"] == "clip"


def test_consensus(spark):
    log = spark.createDataFrame([(0, "a", "kutchi", "error", "x"), (1, "a", "kutchi", "kutchi", "y"), (2, "b", "error", None, None)], "seq long, id string, lang_a string, lang_b string, mv_verdict string")
    assert {r["id"]: r["seq"] for r in consensus.last_state(log).collect()} == {"a": 1, "b": 2}
    assert consensus.failed(consensus.last_state(log)).count() == 1 and consensus.without_failed(consensus.last_state(log)).count() == 1
    many = spark.createDataFrame([(j, f"i{j}", "adjudicate") for j in range(90)], "seq long, id string, mv_verdict string")
    by = consensus.batches(many, spark.createDataFrame([("i0",)], "id string")).groupBy("batch").count().collect()
    assert {r[0]: r[1] for r in by} == {0: 40, 1: 40, 2: 9}


def test_segments(spark):
    d = spark.createDataFrame([("v", t, u, 0.0) for t, u in ((0, 1.0), (10, 1.0), (20, 9.0), (30, 9.0))] + [("w", t, 5.0 * t, 0.0) for t in range(5)], "g string, t int, u double, v double")
    got = {(r["g"], r["seg_start"], r["seg_end"]) for r in segments.change_points(d, "g", ["t"], "t", ["u", "v"]).collect()}
    assert got == {("v", 0, 10), ("v", 20, 30), ("w", 0, 4)}
    w = spark.createDataFrame([("a", 1, 10.0, 20.0), ("b", 2, 0.0, 1.0)], "e string, w int, ws double, we double")
    c = spark.createDataFrame([("a", "x", 0, 0.0, 10.0), ("a", "y", 1, 20.0, 30.0), ("a", "z", 2, 19.0, 21.0), ("a", "q", 3, None, 21.0), ("a", "r", 4, 0.0, 90.0)], "e string, id string, ord int, cs double, ce double")
    assert {(r["w"], tuple(r["ids"])) for r in segments.overlapping(w, c, "e", 3.0).collect()} == {(1, ("z", "r")), (2, ())}
    lines = ["pts_time:1.5", "UAVG=2.0", "VAVG=3", "pts_time:2.5", "UAVG=4", "pts_time:3", "UAVG=1", "VAVG=2"]
    log = spark.createDataFrame([("v", j, x) for j, x in enumerate(lines)], "video_id string, n int, line string")
    assert {tuple(r) for r in segments.chroma_samples(log).collect()} == {("v", 1.5, 2.0, 3.0), ("v", 3.0, 1.0, 2.0)}


@pytest.mark.parametrize("stretch", [3, 2048])
def test_alignment_against_a_plain_search(spark, monkeypatch, stretch):
    monkeypatch.setattr(align, "STRETCH", stretch)
    words = "મુકે બોરી મજા અચી વાય આજ 12 મુકે બોરી માજા અચી વાય ઘર વાટ તે".split() * 3
    w = spark.createDataFrame([("v", j, x, j * 0.5, j * 0.5 + 0.5) for j, x in enumerate(words)], "video_id string, pos int, w string, s double, e double")
    p = spark.createDataFrame([(1, "v", "મુકે બોરી મજા (x) / ઘર વાટ / ક", "muke bori maja/ghar vaat", "", ""), (2, "v", "ક/ખ", "long roman", "", ""), (3, "v", "ગગગગ છછછછ", None, "", ""), (4, "none", "મુકે / બોરી", "", "", "")], "id int, video_id string, kutchi_guj string, kutchi_roman string, english string, source_url string")
    skel = {r["w"]: r["s"] for r in w.select("w", script.skeleton(F.col("w")).alias("s")).collect()}
    variants = [r["skel"] for r in align.probes(p).filter("id = 1").orderBy("k").collect()]
    assert len(variants) == 4 and {r["id"] for r in align.probes(p).collect()} == {1, 3, 4}
    target, spans = max(map(len, variants)), []
    for i in range(len(words)):
        run = ""
        if not skel[words[i]]:
            continue
        for j in range(i, len(words)):
            run += skel[words[j]]
            if j + 1 < len(words) and not skel[words[j + 1]]:
                continue
            if len(run) > 1.8 * target + 3:
                break
            if len(run) >= 0.5 * target:
                spans += [(r, i, j + 1, k) for k, v in enumerate(variants) if v and (r := difflib.SequenceMatcher(None, v, run).ratio()) >= align.THRESHOLD]
    want = []
    for x in sorted(spans, reverse=True):
        if len(want) < align.MOST_REPETITIONS and all(x[2] <= y[1] or y[2] <= x[1] for y in want):
            want.append(x)
    found = align.matches(p, w)
    got = [(r["score"], r["i"], r["j"], r["k"]) for r in found.filter("id = 1").orderBy("r").collect()]
    assert got == want and len(got) >= 2
    cut = align.clips(found, w, p).filter("phrase = 1").collect()
    assert len(cut) == len(got) and all(r["asr_draft"] == " ".join(words[int(r["start"] * 2 + 0.5) : int(r["end"] * 2)]) for r in cut) and {r["id"] for r in cut} == {f"card-v-p001-r{j + 1}" for j in range(len(got))}
    assert {(r["id"], r["reason"]) for r in align.report(found, p).collect()} == {(2, "no-usable-skeleton"), (3, "no-match"), (4, "no-match")}
    devanagari = spark.createDataFrame([(7, "v", "मुके बोरी abc मजा", "")], "id int, video_id string, kutchi_guj string, kutchi_roman string")
    assert {r["reason"] for r in align.report(align.matches(devanagari, w), devanagari).collect()} == {"bad-transcript:devanagari-transliterated,latin-remnant"}


def test_corpus_and_models(spark):
    d = spark.createDataFrame([(0, "a b / c\r\nx", "s"), (1, "ab\na b", "s"), (2, None, "t")], "doc_id long, text string, source string")
    got = corpus.first_wins(corpus.pieces(d, "doc_id", "text", "source"), "piece", ["doc_id", "li", "pi"]).collect()
    assert {(r["piece"], r["doc_id"]) for r in got} == {("a b", 0), ("ab", 1)}
    b = spark.createDataFrame([(0, "abc"), (1, "abcd"), (2, "x")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus.byte_budget(b, "doc_id", "text", 6).orderBy("doc_id").collect()] == [0, 1]
    words = lm.word_counts(spark.createDataFrame([("aab aab ab",)], "t string"), "t")
    assert lm.train_merges(words, 100)[0] == ("a", "b")
    merges = lm.train_merges(words, 100)
    t = spark.createDataFrame([(0, "aab ab"), (1, None)], "r long, t string")
    enc = lm.encode_merges(t, "r", "t", merges)
    assert lm.fragmentation(enc, t, "r", "t").first()["n_lossy"] == 0
    stream = lm.token_stream(enc, "r")
    assert [r["pos"] for r in stream.orderBy("pos").collect()] == list(range(stream.count()))
    s = spark.createDataFrame([(0, [0, 10, 20]), (3, [30, 40, 50, 60, 70]), (8, [80])], "before long, tokens array<long>")
    assert {(r["w"], tuple(r["x"]), tuple(r["y"])) for r in lm.windows(s, 4).collect()} == {(0, (0, 10, 20, 30), (10, 20, 30, 40)), (1, (40, 50, 60, 70), (50, 60, 70, 80))}
    rate = lambda x: one(spark, lm.learning_rate(F.lit(x), 200, 1500, 6e-4, 6e-5))
    assert (rate(0), rate(200), rate(1501)) == (pytest.approx(3e-6), pytest.approx(6e-4), pytest.approx(6e-5))
    k = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 1.0), ("g", "c", 1.0), ("g", "d", 0.0)], "g string, c string, x double")
    top = lm.top_k(k, "g", "x", 2)
    assert {r["c"] for r in top.collect()} == {"a", "b", "c"} and top.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    assert lm.draw(top, "g", "p").count() == 1


def test_desk_and_ingest(spark):
    m = spark.createDataFrame([("a", "t", "r", "", "n"), ("b", "t", "r", "skip", "n")], "id string, transcript string, roman string, status string, notes string")
    saved = spark.createDataFrame([("a", "new", "", "verified", "")], "id string, transcript string, roman string, status string, notes string")
    got = {r["id"]: (r["transcript"], r["status"]) for r in desk.overlay(m, saved).collect()}
    assert got == {"a": ("new", "verified"), "b": ("t", "skip")}
    assert one(spark, desk.clock(F.lit(65.9))) == "1:05"
    assert one(spark, desk.may_verify(F.lit(" \t\n"))) is False
    assert one(spark, ingest.video_id(F.lit("https://youtu.be/abcdefghijk?x"))) == "abcdefghijk"
    assert one(spark, ingest.phrase_of(F.lit("p-r1-r2"))) == "p-r1"
    assert one(spark, ingest.crop_height(F.lit(720))) == 618
    f = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True)], "site string, page int, ok boolean")
    assert [r["page"] for r in ingest.until_first_failure(f, "site").collect()] == [1]
    seg = spark.createDataFrame([("s", "t", "u", 0.0, 1.0, "x"), ("s", "t", "u", 1.0, 4.0, "y")], "source_id string, source_title string, source_url string, start double, end double, text string")
    assert [r["asr_draft"] for r in ingest.clip_plan(seg).collect()] == ["y"]


def test_sources(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a"}\n\nnot json\n{"id": "b"}\n{"id": "a"}\n')
    assert {r[0] for r in records.done_keys(spark, str(path), "id").collect()} == {"a", "b"}
    assert records.read_strict(spark, [str(tmp_path / "none")], "id string").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        records.read_strict(spark, [str(path)], "id string").collect()
    folder = str(tmp_path / "out")
    records.append(spark.createDataFrame([("a",)], "id string"), folder)
    old = records.read_strict(spark, [folder], "id string")
    records.replace(old.unionByName(spark.createDataFrame([("b",)], "id string")), folder)
    assert {r[0] for r in records.read_strict(spark, [folder], "id string").collect()} == {"a", "b"}
    lines = spark.createDataFrame([("http://a # c",), ("# x",), ("http://b\tpoem",), ("",)], "value string")
    assert [r[0] for r in lists.links(lines).collect()] == ["http://a", "http://b\tpoem"]
    assert {tuple(r) for r in lists.registered_links(lines).collect()} == {("http://a # c", "unknown"), ("http://b", "poem")}
    assert [tuple(r) for r in lists.prompts(lines.limit(3)).collect()] == [("http://a # c", ""), ("http://b", "poem")]
    page = "<h1 class='entry-title'>T</h1><h2 class='entry-title'><a href='/n'>n</a></h2><div class='entry-content'><p>મુકે ઘર</p>abc<br><nav>no</nav><script>x</script><p>क</p></div>"
    pages = spark.createDataFrame([("http://s.example/p", page), ("http://s.example/q", "<p>x"), ("http://s.example/r", None)], "url string, html string")
    r = html.posts(pages).collect()
    assert [(x["title"], x["text"], x["scripts"], x["source_site"], x["n_lines"]) for x in r] == [("T", "મુકે ઘર", ["gujarati", "latin"], "s.example", 1)]
    assert [x["link"] for x in html.links(pages).collect()] == ["/n"]


def test_merges_of_all_words(spark):
    import random

    def plain(words, vocabulary):
        split, merges = [(list(w), n) for w, n in words.items()], []
        size = len({c for w in words for c in w}) + len(lm.SPECIALS)
        while size + len(merges) < vocabulary:
            count = {}
            for w, n in split:
                for p in zip(w, w[1:]):
                    count[p] = count.get(p, 0) + n
            if not count or max(count.values()) < lm.LEAST_COUNT:
                break
            best = min(count, key=lambda p: (-count[p], p))
            merges.append(best)
            split = [(lm._joined(w, {best}), n) for w, n in split]
        return merges

    rng = random.Random(4)
    words = {"▁" + "".join(rng.choice("aaabbcdefg") for _ in range(rng.randint(1, 8))): rng.choice([1, 1, 2, 3, 9]) for _ in range(60)}
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain(words, 45)
    assert len(want) > 25
    assert lm.train_merges(d, 45) == want
    assert lm.train_merges(d, 45, most_words=10) == want
    assert lm.settled_merges([("a", "bc", 9), ("d", "e", 5)], {"abc"}) == [("a", "bc")]
    # A settled batch is what one merge after the other gives, on many small tables with equal counts.
    for seed in range(300):
        rng = random.Random(seed)
        words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))): rng.randint(1, 4) for _ in range(rng.randint(2, 9))}
        count = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):
                count[p] = count.get(p, 0) + n
        got = lm.settled_merges(sorted(((*p, n) for p, n in count.items() if n >= lm.LEAST_COUNT), key=lambda r: (-r[2], r[0], r[1])))
        assert got == plain(words, 10**6)[: len(got)]


def test_corpus_of_all_tracks(spark, tmp_path):
    from corpusloom.plans import text_queries

    tables = {
        "verified": spark.createDataFrame([(0, "s", "આવો, ઘરે", "verified"), (1, "s", "ના", "pending"), (2, "s", None, "verified")], "row_no long, source_id string, transcript string, status string"),
        "phrasebook": spark.createDataFrame([(1, "v", "આવો ઘરે / તું"), (2, "v", None)], "id int, video_id string, kutchi_guj string"),
        "documents": spark.createDataFrame([(0, "d", "તૂ!\nઆવો - ઘરે\nના ના\nક"), (1, "d", "ના, ના")], "doc_id long, source string, text string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in text_queries.kutchi_corpus_lines(spark, str(tmp_path)).collect()}
    assert got == {("verified", 0, 0, 0, "આવો ઘરે"), ("phrasebook", 1, 0, 1, "તૂ"), ("documents", 0, 2, 0, "ના ના")}
    assert tuple(text_queries.kutchi_corpus_stats(spark, str(tmp_path)).first()) == (3, 17)
    assert {tuple(r) for r in text_queries.kutchi_corpus_source_counts(spark, str(tmp_path)).collect()} == {("verified", "s", 1), ("phrasebook", "v", 1), ("documents", "d", 1)}


def test_sequential_dedup_across_spellings_of_a_source(spark):
    rows = [(0, "p", "Evening", 1.0, 2.0, "machine-card"), (1, "p", "evening", 1.0, 2.0, "machine-consensus"), (2, "q", "evening", 1.0, 2.0, "human"), (3, None, "a", 0.0, 1.0, "human"), (4, None, "b", 0.0, 1.0, "human")]
    d = spark.createDataFrame(rows, ROW)
    assert {r["o"] for r in curate.dedup_sequential(d, "o").collect()} == {0, 2, 3}
    late = spark.createDataFrame([(0, "p", "evening", 1.0, 2.0, "machine-consensus"), (1, "p", "Evening", 1.0, 2.0, "machine-card")], ROW)
    assert {r["o"] for r in curate.dedup_sequential(late, "o").collect()} == {1}
