"""Where external models and tools come in: functions given by the caller, run in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.sources.records import extended


def transcribed(clips: DataFrame, key: str, path: str, make_ear: Callable[[], Callable[[str], dict]], retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """``key, language, transcript``: what an ear hears in each file.

    ``make_ear`` builds the ear once per task; a failed call is repeated after 1, 2, .. times
    ``wait_s``, and gives the language ``error`` after the last. Join what is done away before.
    """

    def hear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ear = make_ear()
        for pdf in batches:
            out = []
            for p in pdf[path]:
                heard = {"language": "error", "transcript": ""}
                for j in range(retries):
                    try:
                        heard = ear(p)
                        break
                    except Exception:
                        if j + 1 < retries:
                            time.sleep(wait_s * 2**j)
                out.append((heard["language"], heard["transcript"]))
            yield pd.DataFrame({key: pdf[key], "language": [x for x, _ in out], "transcript": [x for _, x in out]})

    return clips.select(key, path).mapInPandas(hear, f"{key} {dict(clips.dtypes)[key]}, language string, transcript string")


def segmented(files: DataFrame, key: str, path: str, make_model: Callable[[], Callable[[str], Iterator[tuple[float, float, str]]]]) -> DataFrame:
    """``key, k, start, end, text``: the timed segments that a recogniser finds in each file; one file gives many rows."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            rows = [(name, k, s, e, t) for name, p in zip(pdf[key], pdf[path]) for k, (s, e, t) in enumerate(model(p))]
            yield pd.DataFrame(rows, columns=[key, "k", "start", "end", "text"])

    return files.select(key, path).mapInPandas(find, f"{key} {dict(files.dtypes)[key]}, k int, start double, end double, text string")


def word_cache(files: DataFrame, model: str, path: str, make_model: Callable[[], Callable[[str], Iterator[tuple[float, float, str]]]]) -> DataFrame:
    """``video_id, model, k, start, end, text``: the timed words of each file ``video_id, path``, kept by video and model.

    Files that were recognised by this model before are read from the folder ``path``; only the
    others are recognised. A file without words is asked again.
    """
    keyed = files.withColumn("model", F.lit(model))

    def make(missing: DataFrame) -> DataFrame:
        return segmented(keyed.join(missing, ["video_id", "model"]), "video_id", "path", make_model).withColumn("model", F.lit(model)).select("video_id", "model", "k", "start", "end", "text")

    return extended(keyed, path, ["video_id", "model"], make)


def read_url(url: str) -> str:
    """The text behind a link, by the standard library; any failure is an exception."""
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as page:
        return page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")


def fetched(urls: DataFrame, url: str = "url", make_fetch: Callable[[], Callable[[str], str]] = lambda: read_url, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """``url, ok, html``: each page, as ``make_fetch``'s function gives it; a page that fails ``retries`` times isn't ok and has no text."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make_fetch()
        for pdf in batches:
            pages = []
            for u in pdf[url]:
                page = None
                for j in range(retries):
                    try:
                        page = one(u)
                        break
                    except Exception:
                        if j + 1 < retries:
                            time.sleep(wait_s * 2**j)
                pages.append(page)
            yield pd.DataFrame({url: pdf[url], "ok": [p is not None for p in pages], "html": pages})

    return urls.select(url).mapInPandas(fetch, f"{url} string, ok boolean, html string")


class PageSource(DataSource):
    """Pages as a table: ``spark.read.format("pages").option("urls", "...\\n...").load()``, one task per link.

    Register with ``spark.dataSource.register(PageSource)``. ``fetch`` may be replaced by a subclass.
    """

    fetch = staticmethod(read_url)

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, ok boolean, html string"

    def reader(self, schema: object) -> DataSourceReader:
        return _PageReader([u.strip() for u in self.options.get("urls", "").split("\n") if u.strip()], type(self).fetch)


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], str]) -> None:
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield partition.value, True, self.fetch(partition.value)
        except Exception:
            yield partition.value, False, None
