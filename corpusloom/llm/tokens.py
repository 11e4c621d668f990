"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, on every executor, and the vocabulary used by default.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary's own way to cut a text before merging, as published with it (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose sizes a worker remembers before it starts afresh.
REMEMBERED = 500_000

_ODD = re.compile(r" \s|\s ")
_counters: dict[str, "Counter"] = {}


class Counter(dict):
    """Token counts of whole texts; a dictionary from a word to the size of a blank and the word.

    The vocabulary's pattern never joins a sign with what follows a single blank after it, so a
    text may be cut before each single blank and the sizes add up exactly. Texts with a blank
    beside other white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(self) < REMEMBERED:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if _ODD.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return len(self.encode(first)) + sum(map(self.__getitem__, rest))


def copy_key(text: str | None) -> int | None:
    """64 bits of a digest that texts share which are equal but for case and white space; none for a text without words."""
    words = (text or "").lower().split()
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if words else None


def counter(path: str) -> Counter:
    """The process's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copy_key``: one row per row of ``df``.

    ``copy_key`` is that of :func:`copy_key`. A null or empty text has 0 tokens and no key. Whole
    texts are encoded.
    """
    file = path or f"{FOLDER}/{VOCABULARY}"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(file).count
        for pdf in batches:
            texts = [t or "" for t in pdf["t"]]
            keys = [copy_key(t) for t in texts]
            yield pd.DataFrame({"doc_id": pdf["d"], "source": pdf["s"], "n_tokens": pd.Series([count(t) for t in texts], dtype="int64"), "copy_key": pd.array(keys, dtype="Int64")})

    kind = dict(df.dtypes)[doc_id]
    plain = df.select(F.col(doc_id).alias("d"), F.col(source).alias("s"), F.col(text).alias("t"))
    return plain.mapInPandas(measure, f"doc_id {kind}, source string, n_tokens long, copy_key long")
