"""Posts and links of HTML pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.script import devanagari_for_text, line_script
from corpusloom.operators.ingest import host, url_id

# Elements and classes of a post that aren't its text, and elements that have no end.
DROPPED_TAGS = {"script", "style", "ins", "iframe", "nav"}
DROPPED_CLASSES = {"code-block", "sharedaddy", "addtoany_share_save_container", "wp-block-buttons"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Post(HTMLParser):
    """Collects the first title, the body's visible lines and the links in headings of entries."""

    def __init__(self, body_tag: str, body_class: str) -> None:
        super().__init__(convert_charrefs=True)
        self.body_tag, self.body_class = body_tag, body_class
        self.open: list[tuple[str, bool, bool, bool, bool]] = []
        self.titles: list[list[str]] = []
        self.lines: list[str] = []
        self.links: list[str] = []
        self.has_body = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        top = self.open[-1][1:] if self.open else (False, False, False, False)
        inside, dropped, title, entry = top
        if tag == self.body_tag and (not self.body_class or self.body_class in classes) and not self.has_body:
            inside = self.has_body = True
        dropped = dropped or tag in DROPPED_TAGS or bool(classes & DROPPED_CLASSES)
        if tag == "h1":
            title = True
            self.titles.append([])
        entry = entry or (tag == "h2" and "entry-title" in classes)
        if tag == "a" and entry and a.get("href"):
            self.links.append(a["href"])
        if tag not in VOID_TAGS:
            self.open.append((tag, inside, dropped, title, entry))

    def handle_endtag(self, tag: str) -> None:
        at = next((j for j in range(len(self.open) - 1, -1, -1) if self.open[j][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        _, inside, dropped, title, _ = self.open[-1] if self.open else ("", False, False, False, False)
        if title and self.titles:
            self.titles[-1].append(data.strip())
        if inside and not dropped:
            self.lines += [line.strip() for line in data.splitlines() if line.strip()]

    def title(self) -> str:
        return "".join(self.titles[0]) if self.titles else ""


def parsed(html: Column, body_tag: str = "div", body_class: str = "entry-content") -> Column:
    """``struct<title, has_body, lines, links>`` of a page."""

    @F.pandas_udf("title string, has_body boolean, lines array<string>, links array<string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for page in s:
                p = _Post(body_tag, body_class)
                p.feed(page or "")
                p.close()
                rows.append((p.title(), p.has_body, p.lines, p.links))
            yield pd.DataFrame(rows, columns=["title", "has_body", "lines", "links"])

    return parse(html)


def posts(pages: DataFrame, url: str = "url", html: str = "html", body_tag: str = "div", body_class: str = "entry-content") -> DataFrame:
    """``id, url, source_site, title, scripts, text, text_origin, text_devanagari, n_lines``: the pages that hold a post.

    Lines of two characters or more count by their script. The text is that in Gujarati, else that
    in Devanagari transliterated; pages with neither give no row.
    """
    d = pages.select(F.col(url).alias("url"), parsed(F.col(html), body_tag, body_class).alias("p")).filter("p.has_body")
    typed = F.transform("p.lines", lambda s: F.struct(s.alias("line"), line_script(s).alias("script")))
    d = d.withColumn("typed", F.filter(typed, lambda x: x["script"].isNotNull() & (F.length(x["line"]) > 1)))
    of = lambda script: F.transform(F.filter("typed", lambda x: x["script"] == script), lambda x: x["line"])
    d = d.withColumns({"g": of("gujarati"), "v": of("devanagari"), "l": of("latin")}).filter((F.size("g") > 0) | (F.size("v") > 0))
    native = F.size("g") > 0
    deva = F.array_join("v", "\n")
    text = F.when(native, F.array_join("g", "\n")).otherwise(devanagari_for_text(deva))
    scripts = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(n)) for c, n in (("g", "gujarati"), ("v", "devanagari"), ("l", "latin"))]))
    return d.select(
        url_id(F.col("url")).alias("id"), "url", host(F.col("url")).alias("source_site"), F.col("p.title").alias("title"), scripts.alias("scripts"), text.alias("text"),
        F.when(native, "native_gujarati").otherwise("transliterated_from_devanagari").alias("text_origin"), deva.alias("text_devanagari"), F.when(native, F.size("g")).otherwise(F.size("v")).alias("n_lines"),
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, k, link``: the links in headings of entries, in order."""
    return pages.select(F.col(url).alias("url"), F.posexplode(parsed(F.col(html))["links"]).alias("k", "link"))
