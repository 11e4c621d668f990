"""Subject areas of documents: labels propagated over the graph of similar documents.

Two documents are similar by the verified terms they share, so the graph is kept in factors, as
edges of documents and terms: a step from documents to terms and back is a step over every similar
pair without listing them (documents of one subject share terms, so pairs grow with the square).
Copies of a text are one document until the end, where each gets what the text has. Term
statistics cover all texts; a term is verified if it occurs in enough of them and isn't shown by
the labelled ones to be common to all subjects, however frequent it is. A seed is trusted unless
the terms it shares with the other seeds contradict it; trusted seeds are clamped throughout. Labels go out
from them by joins, round by round, until they settle; a document may have several. What it has
then is checked exactly: a document is about a subject that it was given if a fifth of its
sentences are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import key
from corpusloom.session import checkpoint

#: Texts that a term must be in, and the share of them above which any number of seeds shows whether it is common.
LEAST_DOCS, MOST_DOCS = 3, 0.10
#: Seeds from which a less frequent term can be seen to be common, and the part of every subject below which it is.
SEEN, COMMON = 8, 0.25
#: Part of a term's labels that must be of one subject for it to carry that subject on; and the weight of no label at all.
PURE, DOUBT = 0.5, 3.0
#: The part of a document's propagated labels that a subject must have to be checked in its sentences.
KEPT = 0.05
#: The part of all labels that a round may still move once they have settled.
SETTLED = 0.002
#: A term between two subjects is read by its document if both together have this part of its labels, and each this one.
BETWEEN, EITHER = 0.7, 0.2
#: Words after which a run of text without sentence marks counts as a further sentence.
LONGEST = 28
LEAST_SHARE = 0.2
#: Terms, or copies, that may be sent to every executor: some 40 bytes each.
BROADCAST_TERMS = 200_000
#: How much a document's own subjects decide the reading of a term that has several.
CONTEXT = 0.15


_MARKUP = re.compile(r"<[^>]{1,200}>|&[a-z]{2,8};")


class _Plain(dict):
    """What each code point becomes: letters and their marks themselves, the end of a sentence a line feed, joiners nothing, all else a blank."""

    def __missing__(self, o: int) -> int | None:
        c = chr(o)
        self[o] = o if unicodedata.category(c)[0] in "LM" else 10 if c in ".!?।॥\n\r" else None if o in (0x200C, 0x200D) else 32
        return self[o]


def sentences(text: str | None, table: _Plain = _Plain()) -> list[list[str]]:
    """The sentences of a text as words in lower case; run-on texts are cut every LONGEST words."""
    plain = (text or "").lower()
    if "<" in plain or "&" in plain:
        plain = _MARKUP.sub(" ", plain)
    found = [w for s in plain.translate(table).split("\n") if (w := s.split())]
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def _read(docs: DataFrame) -> DataFrame:
    """``d, term, n``: without ``d`` in how many documents of a batch each word is, without ``term`` the digest of each document's sentences."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            digests = []
            for t in pdf["text"]:
                parts = sentences(t)
                n.update({w for s in parts for w in s})
                plain = "\n".join(" ".join(s) for s in parts)
                digests.append(int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True))
            ids = pd.Series([*[None] * len(n), *pdf["d"].tolist()], dtype=object)
            yield pd.DataFrame({"d": ids, "term": [*n, *[None] * len(digests)], "n": [*n.values(), *digests]})

    return docs.mapInPandas(read, f"d {dict(docs.dtypes)['d']}, term string, n long")


def _without_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """``docs`` with one document of each text; ``d, first`` of the others, with the document that stands for them; ``term, n``, in how many texts each word is; and whether a document has several texts.

    Texts are only moved if there are more than BROADCAST_TERMS copies, or if rows repeat a document id. A document
    whose rows differ stands for itself.
    """
    read = checkpoint(_read(docs))
    keys = read.filter("term IS NULL").groupBy("d").agg(F.count("*").alias("n"), F.min("n").alias("k"), F.max("n").alias("l"))
    several_texts = keys.filter("k < l").limit(1).count() > 0
    if keys.filter("n > 1").limit(1).count():
        docs = docs.distinct()
        read = checkpoint(_read(docs))
    one = keys.filter("k = l").select("d", "k")
    several = one.groupBy("k").agg(F.min("d").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k", "first")
    copies = checkpoint(one.join(several, "k").filter(F.col("d") != F.col("first")).select("d", "first"))
    known = F.broadcast(copies.select("d")) if copies.count() <= BROADCAST_TERMS else copies.select("d")
    twice = _read(docs.join(known, "d", "left_semi")).withColumn("n", -F.col("n"))
    counted = read.unionByName(twice).filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    return docs.join(known, "d", "left_anti"), copies, counted, several_texts


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [(d, w) for d, t in zip(pdf["d"], pdf["text"]) for w in {w for s in sentences(t) for w in s}]
        yield pd.DataFrame({"d": [d for d, _ in pairs], "term": [w for _, w in pairs]})


def _edges(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``d, term, page, bits, size, first``: in which sentences of a document each term is, 60 to a page, how many it has, and whether the page is the term's first.

    Few terms go to every worker, which then passes on nothing else; if there are more than BROADCAST_TERMS, all
    words are passed on and joined with the terms.
    """
    spark = docs.sparkSession
    few = terms.count() <= BROADCAST_TERMS
    known = spark.sparkContext.broadcast({r["term"]: r["t"] for r in terms.collect()}) if few else None

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = known.value if few else None
        for pdf in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d, t in zip(pdf["d"], pdf["text"]):
                parts, held = sentences(t), {}
                for u, words in enumerate(parts):
                    page, bit = u // 60, 1 << (u % 60)
                    for w in set(words):
                        w = ids.get(w) if few else w
                        if w is not None:
                            held[w, page] = held.get((w, page), 0) | bit
                met = set()
                for (w, page), bits in held.items():
                    for column, x in zip(out, (d, w, page, bits, len(parts), w not in met)):
                        column.append(x)
                    met.add(w)
            yield pd.DataFrame(dict(zip(("d", "term", "page", "bits", "size", "first"), out)))

    kind = dict(docs.dtypes)["d"]
    found = docs.mapInPandas(find, f"d {kind}, term {'long' if few else 'string'}, page int, bits long, size int, first boolean")
    return found if few else found.join(terms, "term").select("d", F.col("t").alias("term"), "page", "bits", "size", "first")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``term, subject, part``: the part of a term's labels that is of a subject; common terms carry none."""
    by = edges.join(labels, "d").groupBy("term", "subject").agg(F.sum("w").alias("w"))
    whole = by.groupBy("term").agg(F.sum("w").alias("all"))
    return by.join(whole, "term").select("term", "subject", (F.col("w") / (F.col("all") + DOUBT)).alias("part"))


def _scores(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """``d, subject, w``: the part of each subject in the labels that a document's terms carry to it."""
    by = pairs.join(terms.filter(F.col("part") >= PURE), "term").groupBy("d", "subject").agg(F.sum("part").alias("w"))
    return by.withColumn("w", F.col("w") / F.sum("w").over(_by("d")))


def subjects(df: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, subject, share``: every subject that LEAST_SHARE of a document's sentences are about.

    ``labels`` are ``doc_id, subject``; subjects that ``areas`` don't name (without blanks and
    case), and labels of unknown documents, are ignored. Documents without words give no row, and
    so does every document if there is no usable label. Rows that repeat a document id are read as
    copies of one document; repeated labels count once. Copies of a text share their labels, of which
    those stay that LEAST_SHARE of the labelled copies have.
    """
    named = areas.select(key(F.col("subject")).alias("k"), F.col("subject").alias("subject")).filter(F.col("k").isNotNull()).dropDuplicates(["k"])
    seeds = labels.select(F.col(doc_id).alias("d"), key(F.col("subject")).alias("k")).join(F.broadcast(named), "k").select("d", "subject").distinct()
    docs, copies, stats, several_texts = _without_copies(df.select(F.col(doc_id).alias("d"), F.col(text).alias("text")))
    hands = seeds.join(copies, "d", "left").select(F.coalesce("first", "d").alias("d"), F.col("d").alias("hand"), "subject")
    votes = hands.groupBy("d", "subject").agg(F.count("*").alias("n")).join(hands.groupBy("d").agg(F.countDistinct("hand").alias("all")), "d")
    seeds = checkpoint(votes.filter(F.col("n") >= F.col("all") * LEAST_SHARE).select("d", "subject"))

    # Term statistics: over all texts, and the seeds' labels of each term.
    names = [r["subject"] for r in named.orderBy("k").collect()]
    marked = seeds.groupBy("d").agg(F.collect_set("subject").alias("own"))
    given = [F.sum(F.when(F.array_contains("own", n), 1.0 / F.size("own")).otherwise(0.0)).alias(f"s{j}") for j, n in enumerate(names)]
    labelled = docs.join(marked.select("d"), "d", "left_semi").mapInPandas(_distinct_words, f"d {dict(docs.dtypes)['d']}, term string")
    seen = labelled.join(marked, "d").groupBy("term").agg(F.count("*").alias("seen"), *given)
    # A term tells of a subject that has more of the term's seeds than of all seeds: twice as much, or a quarter of the way to all.
    base = marked.join(docs.select("d"), "d", "left_semi").agg(F.count("*").alias("seen"), *given).first()
    telling = F.lit(False)
    for j in range(len(names)):
        usual = (base[f"s{j}"] or 0.0) / max(1, base["seen"])
        telling |= F.col(f"s{j}") / F.col("seen") >= max(COMMON, min(2 * usual, usual + (1 - usual) / 4))
    n_docs = docs.count()
    frequent = stats.filter(F.col("n") >= LEAST_DOCS).withColumn("much", F.col("n") > n_docs * MOST_DOCS)
    judged = frequent.join(seen, "term", "left").filter(~F.coalesce((F.col("much") | (F.col("seen") >= SEEN)) & ~telling, F.lit(False)))
    verified = checkpoint(judged.select("term", F.xxhash64("term").alias("t")))
    edges = checkpoint(_edges(docs, verified))
    pairs = edges.filter("first").select("d", "term")
    pairs = pairs.distinct() if several_texts else pairs

    even = lambda x: x.select("d", "subject", (1.0 / F.count("*").over(_by("d"))).alias("w"))
    now, trusted, moved = even(seeds), None, None
    while True:
        terms = checkpoint(_spread(pairs, now))
        scores = checkpoint(_scores(pairs, terms).filter(F.col("w") >= KEPT))
        strong = scores.filter(F.col("w") >= LEAST_SHARE)
        if trusted is None:
            doubted = seeds.join(strong, ["d", "subject"], "left_anti").join(strong.select("d").distinct(), "d", "left_semi")
            trusted = checkpoint(even(seeds.join(doubted, ["d", "subject"], "left_anti")))
        then, now = now, trusted.unionByName(strong.join(trusted.select("d").distinct(), "d", "left_anti"))
        sides = then.select("d", "subject", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(now.select("d", "subject", F.lit(-1).alias("n"), F.lit(1).alias("m")))
        change = sides.groupBy("d", "subject").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).agg(F.count_if(F.col("n") != 0).alias("moved"), F.coalesce(F.sum("m"), F.lit(0)).alias("labels")).first()
        before, moved = moved, change["moved"]
        # A round that doesn't move fewer labels than the one before is the last as well, so the rounds end.
        if moved <= SETTLED * change["labels"] or (before is not None and moved >= before):
            break
    now = checkpoint(trusted.unionByName(scores.join(trusted, ["d", "subject"], "left_anti")))

    # Each term of a document is read as one subject, by its own parts and the document's; those that the document wasn't given count for none.
    about = now.withColumnRenamed("w", "own")
    ranked = terms.groupBy("term").agg(F.sort_array(F.collect_list("part"), asc=False).alias("parts"))
    both = F.get("parts", F.lit(0)) + F.coalesce(F.get("parts", F.lit(1)), F.lit(0.0))
    narrow = terms.join(ranked.select("term", both.alias("both")), "term").filter((F.col("part") >= PURE) | ((F.col("both") >= BETWEEN) & (F.col("part") >= EITHER)))
    readings = pairs.join(narrow, "term").join(about, ["d", "subject"], "left")
    best = readings.groupBy("d", "term").agg(F.max_by(F.struct("subject", "part", "own"), F.struct(F.col("part") * (CONTEXT + F.coalesce("own", F.lit(0.0))), "part", "subject")).alias("r"))
    clear = best.filter(F.col("r.own").isNotNull()).select("d", "term", F.col("r.subject").alias("subject"))
    held = edges.join(clear, ["d", "term"]).groupBy("d", "subject", "page").agg(F.bit_or("bits").alias("bits"), F.max("size").alias("size"))
    shares = held.groupBy("d", "subject").agg((F.sum(F.bit_count("bits")) / F.max("size")).alias("share"))
    found = shares.filter(F.col("share") >= LEAST_SHARE).select("d", "subject", "share")
    again = copies.join(found.withColumnRenamed("d", "first"), "first").select("d", "subject", "share")
    return found.unionByName(again).withColumnRenamed("d", doc_id)


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def composition(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``subject, n_docs, n_chars``: the corpus by subject; documents with two count for both, those with none under null."""
    sized = docs.select(doc_id, F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    return sized.join(found.select(doc_id, "subject"), doc_id, "left").groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("n_chars"))
