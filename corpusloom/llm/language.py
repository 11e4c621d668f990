"""Missing or wrong language labels: averaged hashed subword embeddings with a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams, a text the mean of its
words; both and the softmax are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows, then once more without the rows whose label the first model firmly
rejects. As the model is linear after the mean, each word has its own log-odds, and a text is cut
into stretches of one language by the best path over its words with a price for each change. A
temperature set on held-out rows calibrates the confidence. As a calibrated confidence is the chance
of being right, a language is rejected by Chow's rule: if an error, at its expected cost, is dearer
than no answer; the row then keeps a usable label it has. One rule holds for samples of all sizes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

LANGUAGES = ("kutchi", "gujarati", "hindi", "english", "other")
#: Names and codes under which a language occurs (fixed values); anything else is a label of no known meaning.
NAMES = {
    "kutchi": ("kutchi", "kachchhi", "kachchi", "kachhi", "kacchi", "kutchhi", "cutchi", "kfr", "કચ્છી", "कच्छी"),
    "gujarati": ("gujarati", "gujrati", "gu", "guj", "ગુજરાતી"),
    "hindi": ("hindi", "hi", "hin", "हिन्दी", "हिंदी"),
    "english": ("english", "en", "eng"),
    "mixed": ("mixed", "mix", "mul", "multiple", "code-mixed"),
    "other": ("other", "marathi", "mr", "mar", "punjabi", "panjabi", "pa", "pan", "sindhi", "sd", "snd"),
    "nonspeech": ("nonspeech", "non-speech", "non speech", "zxx", "noise", "music", "no speech"),
}
#: Rows of the sample, taken by the hash of their number; the whole of a smaller table.
SAMPLE_ROWS = 10_000
#: Characters of the sample together; rows beyond are left out of the training, which bounds what the driver holds.
SAMPLE_CHARS = 30_000_000
BUCKETS, WIDTH, EPOCHS, BATCH, RATE = 1 << 15, 16, 8, 32, 0.1
#: Words that a stretch must have to count as a clause, and the most that one word can say.
CLAUSE_WORDS, LOUDEST = 5, 4.0
#: The price of a change of language inside a sentence, and where one ends.
CHANGE, CHANGE_AT_END = 11.0, 4.0
#: No answer costs this part of a wrong one.
REJECTION_COST = 0.4
LEAST_CONFIDENCE = 1 - REJECTION_COST

_MARKS = re.compile(r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|\*[^*]*\*|[♪♫♬♩]")
_TOKEN = re.compile(r"\S+|\n")
_ENDS = re.compile(r"[.?!।॥—–\n]$")


def canonical(labels: Column) -> Column:
    """One of the languages, mixed or nonspeech; null for a missing label, a word for unknown or an unknown name."""
    plain = F.regexp_replace(F.lower(strip(labels)), "_", "-")
    base = F.regexp_replace(plain, "^([a-z]{2,3})-[a-z]{2,4}$", "$1")
    out = F.lit(None).cast("string")
    for name, spelled in NAMES.items():
        out = F.when(plain.isin(*spelled) | base.isin(*spelled), name).otherwise(out)
    return out


def _tokens(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text in lower case, and whether a sentence ended before each; marks for sounds aren't words."""
    words, starts, ended = [], [], False
    for t in _TOKEN.findall(_MARKS.sub(" ", text).lower()):
        if any(c.isalnum() for c in t):
            words.append(t)
            starts.append(ended)
            ended = False
        ended = ended or bool(_ENDS.search(t))
    return words, starts


def _words(text: str) -> list[str]:
    return _tokens(text)[0]


def _grams(word: str) -> list[int]:
    w = "<" + (re.sub(r"^[^\w]+|[^\w]+$", "", word) or word) + ">"
    found = {w} | {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in found]


@dataclass
class Model:
    """Log-odds per bucket (``BUCKETS`` x languages), a bias and the temperature: bounded in size."""

    odds: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def word(self, word: str) -> np.ndarray:
        return self.odds[_grams(word)].mean(0)

    def confidence(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def _bags(texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    seen: dict[str, np.ndarray] = {}
    ids, weights = [], []
    for words in texts:
        parts = []
        for w in words:
            if w not in seen:
                seen[w] = np.array(_grams(w), dtype="int32")
            parts.append(seen[w])
        ids.append(np.concatenate(parts))
        weights.append(np.concatenate([np.full(len(p), 1.0 / (len(p) * len(parts)), dtype="float32") for p in parts]))
    return ids, weights


def fit(texts: list[list[str]], labels: np.ndarray, seed: int = 5) -> Model:
    """Gradient descent with a step per parameter that shrinks with its own gradients so far."""
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype("float32")
    out, bias = rng.normal(0, 0.1, (WIDTH, k)).astype("float32"), np.zeros(k, dtype="float32")
    past = [np.full_like(x, 1e-6) for x in (emb, out, bias)]
    ids, weights = _bags(texts)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            idx, w = np.concatenate([ids[r] for r in rows]), np.concatenate([weights[r] for r in rows])
            lengths = np.array([len(ids[r]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            mean = np.add.reduceat(emb[idx] * w[:, None], starts)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), p @ out.T
            buckets, inverse = np.unique(idx, return_inverse=True)
            spread = np.repeat(g_mean, lengths, 0) * w[:, None]
            g_emb = np.stack([np.bincount(inverse, spread[:, j], len(buckets)) for j in range(WIDTH)], 1).astype("float32")
            past[0][buckets] += g_emb**2
            emb[buckets] -= RATE * g_emb / np.sqrt(past[0][buckets])
            for x, g, h in ((out, g_out, past[1]), (bias, g_bias, past[2])):
                h += g**2
                x -= RATE * g / np.sqrt(h)
    return Model((emb @ out).astype("float32"), bias)


def _means(model: Model, texts: list[list[str]]) -> np.ndarray:
    known: dict[str, np.ndarray] = {}
    for words in texts:
        for w in words:
            if w not in known:
                known[w] = model.word(w)
    return np.array([np.mean([known[w] for w in words], 0) for words in texts]).reshape(len(texts), len(LANGUAGES))


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model | None:
    """A model from labelled texts; none if fewer than two languages have a text with words."""
    pairs = [(w, LANGUAGES.index(label)) for t, label in zip(texts, labels) if (w := _words(t)) and label in LANGUAGES]
    if len({y for _, y in pairs}) < 2:
        return None
    words, y = [w for w, _ in pairs], np.array([y for _, y in pairs])
    held = np.arange(len(y)) % 5 == 4
    first = fit([w for w, h in zip(words, held) if not h], y[~held], seed)
    sure = first.confidence(_means(first, words))
    keep = ~((sure.max(1) > 0.7) & (sure.argmax(1) != y))
    use = keep & ~held
    model = fit([w for w, u in zip(words, use) if u], y[use], seed)
    check = keep & held
    model.temperature = temperature(_means(model, [w for w, c in zip(words, check) if c]) + model.bias, y[check])
    return model


def temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The temperature at which the log-odds' chances fit the truth best, drawn towards 1 by as much as two rows weigh.

    So no rows give 1, and few rows move it little.
    """

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        e = s - s.max(1, keepdims=True) if len(s) else s
        return float(2.0 * log_t**2 - (e[np.arange(len(truth)), truth] - np.log(np.exp(e).sum(1))).sum())

    lo, hi = math.log(0.1), math.log(10.0)
    for _ in range(60):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


class Tagger:
    """Cuts texts into stretches of one language; remembers words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def _word(self, w: str) -> tuple[np.ndarray, list[float]]:
        if w not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            odds = self.model.word(w)
            p = self.model.confidence(odds)
            self.known[w] = (odds, [max(float(x), -LOUDEST) for x in np.log(p + 1e-9)])
        return self.known[w]

    def stretches(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(first word, words, language, confidence)`` of each stretch, none if the text has no words.

        Stretches with fewer than CLAUSE_WORDS words go to their neighbour, so a borrowed word
        opens none.
        """
        words, starts = _tokens(text)
        if not words:
            return []
        odds, says = zip(*(self._word(w) for w in words))
        path = self._path(says, starts)
        cuts = [0, *(j for j in range(1, len(path)) if path[j] != path[j - 1]), len(path)]
        parts = [[a, b, path[a]] for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1 and min(b - a for a, b, _ in parts) < CLAUSE_WORDS:
            j = min(range(len(parts)), key=lambda x: parts[x][1] - parts[x][0])
            near = max((x for x in (j - 1, j + 1) if 0 <= x < len(parts)), key=lambda x: parts[x][1] - parts[x][0])
            a, b = min(parts[j][0], parts[near][0]), max(parts[j][1], parts[near][1])
            parts[min(j, near) : max(j, near) + 1] = [[a, b, parts[near][2]]]
            joined = []
            for p in parts:
                if joined and joined[-1][2] == p[2]:
                    joined[-1][1] = p[1]
                else:
                    joined.append(p)
            parts = joined
        out: list[tuple[int, int, str, float]] = []
        for a, b, _ in parts:
            p = self.model.confidence(np.mean(odds[a:b], 0))
            k = int(p.argmax())
            if out and out[-1][2] == LANGUAGES[k]:
                first = out[-1][0]
                p = self.model.confidence(np.mean(odds[first:b], 0))
                out[-1] = (first, b - first, LANGUAGES[k], float(p[k]))
            else:
                out.append((a, b - a, LANGUAGES[k], float(p[k])))
        return out

    @staticmethod
    def _path(says: tuple, starts: list[bool]) -> list[int]:
        """The best language of each word: what the words say less the price of each change."""
        n = len(LANGUAGES)
        score, back = list(says[0]), []
        for e, start in zip(says[1:], starts[1:]):
            top = max(range(n), key=score.__getitem__)
            changed = score[top] - (CHANGE_AT_END if start else CHANGE)
            back.append([k if score[k] >= changed else top for k in range(n)])
            score = [max(score[k], changed) + e[k] for k in range(n)]
        k = max(range(n), key=score.__getitem__)
        path = [k]
        for b in reversed(back):
            k = b[k]
            path.append(k)
        return path[::-1]


def _model(df: DataFrame, number: str, text: str, label: str, sample_rows: int) -> Model | None:
    """Trained on the driver on at most ``sample_rows`` rows and SAMPLE_CHARS characters, taken by the hash of their number."""
    useful = df.select(F.col(number).alias("n"), F.col(text).alias("t"), canonical(F.col(label)).alias("l")).filter(F.col("l").isin(*LANGUAGES) & F.col("t").isNotNull())
    order = [F.xxhash64("n"), F.col("n"), F.col("t")]
    taken = useful.orderBy(*order).limit(sample_rows).withColumn("upto", F.sum(F.length("t")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = taken.filter(F.col("upto") <= SAMPLE_CHARS).orderBy(*order).select("t", "l").collect()
    return train([r["t"] for r in rows], [r["l"] for r in rows])


_TAGGED = "n long, label string, language string, confidence double, rejected boolean, stretches array<struct<first_word:int,n_words:int,language:string,confidence:double>>"


def tagged(df: DataFrame, number: str = "seq", text: str = "transcript", label: str = "language", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``n, label, language, confidence, rejected, stretches``: every row with a non-blank text.

    ``label`` is the row's own label in its usual name (null: missing or unknown). ``language`` is
    that of the words; mixed if two languages have a clause each; nonspeech if there are only marks
    for sounds. Rows without text give no row; repeated rows are tagged alike; without two
    languages among the labels nothing can be trained, and the row's own label is returned with
    confidence 0.
    """
    model = _model(df, number, text, label, sample_rows)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model) if model else None
        for pdf in batches:
            out = []
            for t, own in zip(pdf["t"], pdf["label"]):
                own = own if isinstance(own, str) else None
                parts = tagger.stretches(t) if tagger else []
                if not _words(t):
                    out.append(("nonspeech", 1.0, False, []))
                elif not parts:
                    out.append((own or "other", 0.0, True, []))
                else:
                    firm = {p[2] for p in parts if p[3] >= LEAST_CONFIDENCE}
                    if len(firm) > 1:
                        out.append(("mixed", min(p[3] for p in parts if p[3] >= LEAST_CONFIDENCE), False, parts))
                    else:
                        main = max(parts, key=lambda p: (p[3] >= LEAST_CONFIDENCE, p[1]))
                        weak = main[3] < LEAST_CONFIDENCE
                        out.append((own if weak and own in LANGUAGES else main[2], main[3], weak, parts))
            yield pd.DataFrame(
                {
                    "n": pdf["n"], "label": pdf["label"], "language": [x[0] for x in out], "confidence": [float(x[1]) for x in out], "rejected": [x[2] for x in out],
                    "stretches": [[{"first_word": a, "n_words": b, "language": c, "confidence": d} for a, b, c, d in x[3]] for x in out],
                }
            )

    plain = df.select(F.col(number).cast("long").alias("n"), strip(F.col(text)).alias("t"), canonical(F.col(label)).alias("label")).filter(F.coalesce(F.col("t") != "", F.lit(False)))
    return plain.mapInPandas(tag, _TAGGED)


def wrong_labels(df: DataFrame, number: str = "seq", text: str = "transcript", label: str = "language") -> DataFrame:
    """``seq, language``: rows with a text whose label is missing or isn't the language of the words."""
    return tagged(df, number, text, label).filter(F.col("label").isNull() | (F.col("label") != F.col("language"))).select(F.col("n").alias(number), "language")


def segments(df: DataFrame, number: str = "seq", text: str = "transcript", label: str = "language") -> DataFrame:
    """``seq, part, first_word, n_words, language, confidence``: every stretch of every row with words."""
    return tagged(df, number, text, label).select(F.col("n").alias(number), F.posexplode("stretches").alias("p", "s")).select(number, (F.col("p") + 1).alias("part"), "s.*")
