"""Language-model inputs: character vocabulary, subword merges, token windows, schedules and sampling filters."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Container, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.prefix import running_sum
from corpusloom.operators.corpus import BUCKET
from corpusloom.session import checkpoint

# The sign that stands for a blank before a word, special tokens, and the least count of a merge.
BLANK, SPECIALS, LEAST_COUNT = "▁", ("<unk>", "<|endoftext|>"), 2
# The most labels of a row, and the label that the loss leaves out.
MOST_LABELS, IGNORED = 448, -100


def char_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``char, n, char_id``: the distinct characters in code-point order; as many rows as the script has characters."""
    n = df.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("char")).filter(F.col("char") != "").groupBy("char").agg(F.count("*").alias("n"))
    return n.withColumn("char_id", F.row_number().over(Window.orderBy(F.hex("char"))) - 1)


def encode_chars(df: DataFrame, row_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``row_id, tokens``: each text as the numbers of its characters; empty and null texts give no row.

    The vocabulary is bounded by the script (Unicode at most), so it goes to the workers and texts
    are encoded where they are. Characters that it lacks are left out.
    """
    known = sorted((ord(r["char"]), r["char_id"]) for r in vocabulary.select("char", "char_id").collect())
    codes, ids = np.array([c for c, _ in known], dtype="uint32"), np.array([i for _, i in known], dtype="int64")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["t"]:
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                at = np.minimum(np.searchsorted(codes, points), max(len(codes) - 1, 0))
                out.append(ids[at][codes[at] == points] if len(codes) else ids)
            yield pd.DataFrame({"r": pdf["r"], "tokens": out})

    kind = dict(df.dtypes)[row_id]
    plain = df.select(F.col(row_id).alias("r"), F.col(text).alias("t")).filter("t <> ''")
    return plain.mapInPandas(encode, f"r {kind}, tokens array<long>").withColumnRenamed("r", row_id)


def decode_chars(encoded: DataFrame, row_id: str, vocabulary: DataFrame) -> DataFrame:
    """``row_id, text``: what :func:`encode_chars` encoded."""
    names = {r["char_id"]: r["char"] for r in vocabulary.select("char", "char_id").collect()}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"r": pdf["r"], "text": ["".join(map(names.__getitem__, t)) for t in pdf["tokens"]]})

    return encoded.select(F.col(row_id).alias("r"), "tokens").mapInPandas(decode, f"r {dict(encoded.dtypes)[row_id]}, text string").withColumnRenamed("r", row_id)


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n`` with the blank's sign before each word."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    return df.select(F.explode(words).alias("w")).groupBy(F.concat(F.lit(BLANK), "w").alias("word")).agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """``a, b, n``: how often two characters are neighbours in words ``word, n``: the first round of merging."""
    c = F.split("word", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    return words.filter(F.length("word") > 1).select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def train_merges(words: DataFrame, vocabulary: int, least: int = LEAST_COUNT, most_words: int = 200_000) -> list[tuple[str, str]]:
    """Merges by falling count (of equals the smaller pair), until the vocabulary is full or no pair is frequent.

    Text is read once, into word counts, and every word counts. Up to ``most_words`` distinct words are
    merged on the driver; more stay a table, from which pairs are counted anew in each round, with the same merges.
    """
    words = checkpoint(words.filter("word <> ''"))
    rows = words.limit(most_words + 1).collect()
    if len(rows) > most_words:
        return _merges_of_table(words, vocabulary, least)
    split = [(list(r["word"]), r["n"]) for r in rows]
    size = len({c for w, _ in split for c in w}) + len(SPECIALS)
    where: dict[tuple, set[int]] = {}
    count: Counter = Counter()
    for j, (w, n) in enumerate(split):
        for pair in zip(w, w[1:]):
            count[pair] += n
            where.setdefault(pair, set()).add(j)
    # Counts as they were when put in; the newest of a pair is the one that holds.
    heap = [(-n, pair) for pair, n in count.items()]
    heapify(heap)
    merges: list[tuple[str, str]] = []
    while size + len(merges) < vocabulary and heap:
        n, best = heappop(heap)
        if count.get(best, 0) != -n:
            continue
        if -n < least:
            break
        merges.append(best)
        changed: set[tuple] = set()
        for j in where.pop(best, set()):
            w, times = split[j]
            for pair in zip(w, w[1:]):
                count[pair] -= times
                changed.add(pair)
            split[j] = (out := _joined(w, {best: 0}), times)
            for pair in zip(out, out[1:]):
                count[pair] += times
                where.setdefault(pair, set()).add(j)
                changed.add(pair)
        for pair in changed:
            if count[pair] > 0:
                heappush(heap, (-count[pair], pair))
            else:
                del count[pair]
    return merges


def _joined(word: list[str], pairs: Container) -> list[str]:
    """A word with neighbours that are one of the pairs joined, from the left; pairs that can't overlap, or one."""
    k, out = 0, []
    while k < len(word):
        joined = k + 1 < len(word) and (word[k], word[k + 1]) in pairs
        out.append(word[k] + word[k + 1] if joined else word[k])
        k += 2 if joined else 1
    return out


def settled_merges(ranked: list[tuple[str, str, int]], made: Container = ()) -> list[tuple[str, str]]:
    """The first merges that follow from ranked pair counts alone, one at least.

    A pair is next as long as no merge before it can overlap it or make a pair that ranks above it. A new
    pair is no more frequent than the pair across the merge's edge that it comes from; if that ranks
    higher, it is met first and overlaps the merge. Of equals, (ab, y) may rank above (b, y), so those are looked at.
    A merge that spells a token ``made`` before adds to that token's pairs, so it is the last one.
    """
    equals: dict[int, dict[str, list[str]]] = {}
    for a, b, n in ranked:
        equals.setdefault(n, {}).setdefault(a, []).append(b)
    taken: list[tuple[str, str]] = []
    firsts: set[str] = set()
    ends: dict[str, list[str]] = {}
    for a, b, n in ranked:
        if taken and (a in ends or b in firsts or a == b):
            break
        if any((whole, y) < (a, b) for end in ends.keys() & equals[n].keys() for y in equals[n][end] for whole in ends[end]):
            break
        taken.append((a, b))
        if a == b or a + b in made or any(a + b == x + y for x, y in taken[:-1]):
            break
        firsts.add(a)
        ends.setdefault(b, []).append(a + b)
    return taken


def _merges_of_table(words: DataFrame, vocabulary: int, least: int, fetched: int = 10_000) -> list[tuple[str, str]]:
    """The same merges with the words kept as a table; a round makes all merges that its counts settle."""

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"w": [list(w) for w in pdf["word"]], "n": pdf["n"]})

    now = checkpoint(words.mapInPandas(apart, "w array<string>, n long"))
    size = now.select(F.explode("w").alias("c")).distinct().count() + len(SPECIALS)
    merges: list[tuple[str, str]] = []
    while size + len(merges) < vocabulary:
        now = now.filter(F.size("w") > 1)
        pairs = now.select("n", F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"))
        top = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(fetched).collect()
        ranked = [(r["a"], r["b"], r["n"]) for r in top]
        if len(ranked) == fetched:
            # The pairs that are as frequent as the last may not all be here; the first of all is certain.
            ranked = [r for r in ranked if r[2] > ranked[-1][2]] or ranked[:1]
        new = settled_merges(ranked, {a + b for a, b in merges})[: vocabulary - size - len(merges)]
        if not new:
            break
        merges += new
        known = frozenset(new)

        def join(batches: Iterator[pd.DataFrame], known: frozenset = known) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"w": [_joined(list(w), known) for w in pdf["w"]], "n": pdf["n"]})

        now = checkpoint(now.mapInPandas(join, "w array<string>, n long"))
    return merges


def encode_merges(df: DataFrame, row_id: str, text: str, merges: list[tuple[str, str]]) -> DataFrame:
    """``row_id, tokens``: each text in subwords, with the end-of-text token last; each word is merged once per worker."""
    order = {pair: j for j, pair in enumerate(merges)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}

        def merged(word: str) -> list[str]:
            w = list(BLANK + word)
            while len(w) > 1:
                k = min(range(len(w) - 1), key=lambda x: order.get((w[x], w[x + 1]), math.inf))
                if (w[k], w[k + 1]) not in order:
                    break
                w[k : k + 2] = [w[k] + w[k + 1]]
            return w

        for pdf in batches:
            out = []
            for t in pdf["t"]:
                tokens: list[str] = []
                for w in (t or "").split():
                    if w not in known and len(known) < 500_000:
                        known[w] = merged(w)
                    tokens += known.get(w) or merged(w)
                out.append([*tokens, SPECIALS[1]])
            yield pd.DataFrame({"r": pdf["r"], "tokens": out})

    kind = dict(df.dtypes)[row_id]
    return df.select(F.col(row_id).alias("r"), F.col(text).alias("t")).mapInPandas(encode, f"r {kind}, tokens array<string>").withColumnRenamed("r", row_id)


def fragmentation(encoded: DataFrame, df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``n_chars, n_tokens, chars_per_token``, and ``n_lossy``, the texts whose words don't come back."""
    words = F.array_join(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""), " ")
    d = df.select(row_id, words.alias("t")).join(encoded, row_id)
    back = F.trim(F.translate(F.array_join(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), ""), BLANK, " "))
    sums = d.agg(F.sum(F.length("t")).alias("n_chars"), F.sum(F.size("tokens") - 1).alias("n_tokens"), F.count_if(back != F.translate("t", BLANK, " ")).alias("n_lossy"))
    return sums.select("n_chars", "n_tokens", F.round(F.col("n_chars") / F.greatest(F.col("n_tokens"), F.lit(1)), 6).alias("chars_per_token"), "n_lossy")


def placed(encoded: DataFrame, order: str) -> DataFrame:
    """``before, tokens``: all texts' tokens with the number of those before them in order; whole texts are moved, not tokens."""
    sized = encoded.withColumn("size", F.size("tokens").cast("long"))
    return running_sum(sized, F.floor(F.col(order) / BUCKET), [order], F.col("size"), "before", inclusive=False).select(F.col("before").cast("long").alias("before"), "tokens")


def token_stream(encoded: DataFrame, order: str) -> DataFrame:
    """``pos, token``: all texts' tokens end to end, in order."""
    return placed(encoded, order).select("before", F.posexplode("tokens").alias("k", "token")).select((F.col("before") + F.col("k")).alias("pos"), "token")


def stream_size(stream: DataFrame) -> int:
    """How many tokens the placed texts have together."""
    return stream.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0))).first()[0]


def split_stream(stream: DataFrame, train_share: float = 0.98, least: int = 0) -> DataFrame:
    """``part, before, tokens``: the first share of the positions is for training, the rest for validation, each counted from 0.

    If the rest has fewer than ``least`` tokens, the whole stream is validated on. Texts across the
    edge are cut.
    """
    n = stream_size(stream)
    edge = math.floor(n * train_share)
    first = 0 if n - edge < least else edge
    end = F.col("before") + F.size("tokens")
    train = stream.filter(F.col("before") < edge).select(F.lit("train").alias("part"), "before", F.slice("tokens", F.lit(1), F.least(F.size("tokens").cast("long"), edge - F.col("before")).cast("int")).alias("tokens"))
    cut = F.greatest(F.lit(0).cast("long"), F.lit(first) - F.col("before")).cast("int")
    val = stream.filter(end > first).select(F.lit("val").alias("part"), F.greatest(F.lit(0).cast("long"), F.col("before") - first).alias("before"), F.slice("tokens", cut + 1, F.greatest(F.size("tokens") - cut, F.lit(0))).alias("tokens"))
    return train.unionByName(val)


def windows(stream: DataFrame, length: int) -> DataFrame:
    """``w, x, y``: full windows of placed texts and the same moved on by one token.

    Each text sends a slice of itself to every window that it reaches into (and to the window before
    if it holds the token after it), so neither single tokens nor a window over the whole stream are moved.
    """
    return _gathered(stream, F.sequence(F.floor(F.greatest(F.col("before") - 1, F.lit(0)) / length), F.floor((F.col("before") + F.size("tokens") - 1) / length)), lambda w: w * length, length)


def _gathered(stream: DataFrame, numbers: Column, start: Callable[[Column], Column], length: int) -> DataFrame:
    """``w, x, y`` of windows that begin at ``start(w)``, from the texts that reach into each of their ``numbers``."""
    d = stream.filter(F.size("tokens") > 0).select("before", "tokens", F.explode(numbers).alias("w"))
    lo = F.greatest(F.col("before"), start(F.col("w")))
    hi = F.least(F.col("before") + F.size("tokens"), start(F.col("w")) + length + 1)
    d = d.withColumns({"lo": lo, "hi": hi}).filter("hi > lo")
    piece = F.slice("tokens", (F.col("lo") - F.col("before") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    by = d.select("w", F.struct("lo", piece.alias("t")).alias("p")).groupBy("w").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"])).alias("all"))
    return by.filter(F.size("all") == length + 1).select("w", F.slice("all", 1, length).alias("x"), F.slice("all", 2, length).alias("y"))


def batches(stream: DataFrame, length: int, rows: int, steps: int) -> DataFrame:
    """``step, b, x, y``: the batches of a training run of ``rows`` windows each, read on through the stream.

    Where fewer tokens are left than a batch and one more, reading begins again at the first. A
    stream that is shorter than that has no batch.
    """
    per, n = rows * length, stream_size(stream)
    rounds = max(0, (n - 1) // per)
    whole = windows(stream, length).filter(F.col("w") < rounds * rows).select(F.floor(F.col("w") / rows).alias("turn"), (F.col("w") % rows).cast("int").alias("b"), "x", "y")
    if not rounds:
        return whole.select(F.col("turn").alias("step"), "b", "x", "y").limit(0)
    times = F.sequence(F.col("turn"), F.lit(steps - 1).cast("long"), F.lit(rounds).cast("long"))
    return whole.filter(F.col("turn") < steps).select(F.explode(times).alias("step"), "b", "x", "y")


def random_windows(stream: DataFrame, length: int, count: int, seed: int = 1) -> DataFrame:
    """``w, x, y``: windows at places drawn by a digest of the seed and their number, so a run may be repeated."""
    n = stream_size(stream)
    spark = stream.sparkSession
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("w").cast("string")).cast("binary"))
    drawn = spark.range(count if n > length else 0).select(F.col("id").alias("w")).withColumn("at", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % max(n - length, 1))
    # A draw and the texts it reaches into meet by blocks of the stream.
    block = 1 << max(10, (length + 1).bit_length())
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))
    wanted = drawn.withColumn("k", blocks(F.col("at"), F.col("at") + length))
    held = stream.filter(F.size("tokens") > 0).withColumn("k", blocks(F.col("before"), F.col("before") + F.size("tokens") - 1))
    lo, hi = F.greatest("before", "at", F.col("k") * block), F.least(F.col("before") + F.size("tokens"), F.col("at") + length + 1, (F.col("k") + 1) * block)
    met = held.join(wanted, "k").withColumns({"lo": lo, "hi": hi}).filter("hi > lo")
    piece = F.slice("tokens", (F.col("lo") - F.col("before") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    by = met.select("w", F.struct("lo", piece.alias("t")).alias("p")).groupBy("w").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"])).alias("all"))
    return by.select("w", F.slice("all", 1, length).alias("x"), F.slice("all", 2, length).alias("y"))


def label_gate(df: DataFrame, tokens: str, most: int = MOST_LABELS) -> DataFrame:
    """The rows whose labels aren't too many for the model; null has none."""
    return df.filter(F.coalesce(F.size(tokens), F.lit(0)) <= most)


def gate_counts(df: DataFrame, tokens: str, most: int = MOST_LABELS) -> DataFrame:
    """``n_rows, n_dropped``: what :func:`label_gate` leaves out."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.size(tokens), F.lit(0)) > most).alias("n_dropped"))


def padded_batches(df: DataFrame, batch: str, row_id: str, tokens: str, first: int, blank: int = IGNORED) -> DataFrame:
    """``batch, row_id, labels``: the labels of a batch at one length, filled up with the number that the loss ignores.

    If all rows of a batch begin with the ``first`` token, it is left out.
    """
    d = df.select(batch, row_id, F.col(tokens).alias("t"))
    by = d.groupBy(batch).agg(F.max(F.size("t")).alias("n"), F.min(F.coalesce(F.get("t", F.lit(0)) == first, F.lit(False))).alias("all"))
    d = d.join(by, batch).withColumn("t", F.concat("t", F.array_repeat(F.lit(blank).cast("long"), F.col("n") - F.size("t"))))
    return d.select(batch, row_id, F.when(F.col("all"), F.slice("t", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))).otherwise(F.col("t")).alias("labels"))


def loss_means(losses: DataFrame, step: str = "step", part: str = "part", number: str = "k", loss: str = "loss", batches_: int = 20) -> DataFrame:
    """``step, train, val, gap``: mean loss of the first batches of both parts at each step, and how far validation is behind."""
    of = lambda p: F.avg(F.when(F.col(part) == p, F.col(loss)))
    by = losses.filter(F.col(number) < batches_).groupBy(step).agg(of("train").alias("train"), of("val").alias("val"))
    return by.select(step, F.round("train", 9).alias("train"), F.round("val", 9).alias("val"), F.round(F.col("val") - F.col("train"), 9).alias("gap"))


def learning_rate(step: Column, warmup: int, most_steps: int, highest: float, lowest: float) -> Column:
    """A straight rise over the warm-up, half a cosine down to the lowest, which then stays."""
    part = (step - warmup) / float(max(1, most_steps - warmup))
    return F.when(step < warmup, highest * (step + 1) / warmup).when(step > most_steps, lowest).otherwise(lowest + 0.5 * (1.0 + F.cos(F.lit(math.pi) * part)) * (highest - lowest))


def top_k(df: DataFrame, group: str, logit: str, k: int, temperature: float = 1.0) -> DataFrame:
    """With ``p``, the chance of each candidate among the k best of its group; equals of the last are kept."""
    kept = df.withColumn("__r", F.rank().over(Window.partitionBy(group).orderBy(F.desc(logit)))).filter(F.col("__r") <= k)
    w = Window.partitionBy(group)
    e = kept.withColumn("__e", F.exp((F.col(logit) - F.max(logit).over(w)) / temperature))
    return e.withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__r", "__e")


def draw(df: DataFrame, group: str, p: str, seed: int = 1) -> DataFrame:
    """One row of each group, drawn by chance ``p``: the least waiting time, which may be aggregated anywhere."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1 << 52)) + 1) / float(1 << 52)
    return df.groupBy(group).agg(F.min_by(F.struct(*[c for c in df.columns if c != group]), -F.log(u) / F.col(p)).alias("k")).select(group, "k.*")
