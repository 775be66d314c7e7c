"""Edits of page HTML that need a parser, as Arrow-batched functions."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Rewriter(HTMLParser):
    """Writes HTML back while it is read; `drop` counts the open elements below one that is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.drop = 0
        self.dropped_tag = ""

    def edit(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, list, str]:
        """(keep, attributes, text after the start tag)."""
        return True, attrs, ""

    def handle_starttag(self, tag, attrs):
        if self.drop:
            self.drop += tag == self.dropped_tag
            return
        keep, attrs, after = self.edit(tag, attrs)
        if not keep:
            if tag not in VOID:
                self.drop, self.dropped_tag = 1, tag
            return
        self.out.append(f"<{tag}{''.join(f' {k}' if v is None else f' {k}="{escape(v, quote=True)}"' for k, v in attrs)}>{after}")

    def handle_startendtag(self, tag, attrs):
        before = self.drop
        self.handle_starttag(tag, attrs)
        if not before:
            self.drop = 0

    def handle_endtag(self, tag):
        if self.drop:
            self.drop -= tag == self.dropped_tag
        else:
            self.out.append(f"</{tag}>")

    def plain(self, text):
        if not self.drop:
            self.out.append(text)

    def handle_data(self, data):
        self.plain(data)

    def handle_entityref(self, name):
        self.plain(f"&{name};")

    def handle_charref(self, name):
        self.plain(f"&#{name};")

    def handle_comment(self, data):
        self.plain(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.plain(f"<!{decl}>")

    def unknown_decl(self, data):
        self.plain(f"<![{data}]>")

    @classmethod
    def rewrite(cls, html: str | None) -> str | None:
        if html is None:
            return None
        parser = cls()
        parser.feed(html)
        parser.close()
        return "".join(parser.out)


class Tabs(Rewriter):
    """Every pane of a tab container shown, below a heading with its title; menus and lazy placeholders left out."""

    def edit(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        classes = values.get("class", "").split()
        if "tabs-menu" in classes or "lazy-loading-div" in classes:
            return False, attrs, ""
        if "tabs-pane" in classes:
            title = values.get("data-pane-title", "Tab Content")
            values["class"] = " ".join([*classes, "tab-section-visible"])
            values["style"] = "display: block;"
            left = [(k, v) for k, v in values.items() if k not in ("jwtdata", "data-hasbody", "data-macro-name", "role")]
            return True, left, f"<h3>📑 {escape(title)}</h3>"
        return True, [(k, v) for k, v in attrs if k != "jwtdata"], ""


def flatten_tabs(html: Column) -> Column:
    def edit(text: pd.Series) -> pd.Series:
        return text.map(Tabs.rewrite, na_action="ignore")

    small_batches()
    return F.pandas_udf(edit, "string")(html)


def drawio_images(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """`pages` (page_id, html) with Draw.io macro divs as images.

    `matches`: page_id, macro_id, file.  A macro without a file becomes a placeholder; hidden data divs go.
    """
    known = matches.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("macro_id", "file"))).alias("_files"))
    rows = pages.join(known, "page_id", "left")

    @F.pandas_udf("string")
    def edit(html: pd.Series, files: pd.Series) -> pd.Series:
        def one(text, names):
            if text is None:
                return None
            names = dict(names or {})

            class Images(Rewriter):
                def edit(self, tag, attrs):
                    values = dict(attrs)
                    own = values.get("id") or ""
                    if own.startswith("drawio-macro-data-"):
                        return False, attrs, ""
                    if tag == "div" and own.startswith("drawio-macro-content-"):
                        macro = own.removeprefix("drawio-macro-content-")
                        file = names.get(macro)
                        self.out.append(f'<img src="{escape(file)}" alt="{escape(file)}">' if file else f"<p>[Diagram {escape(macro)}]</p>")
                        return False, attrs, ""
                    return True, attrs, ""

            return Images.rewrite(text)

        return pd.Series([one(t, n) for t, n in zip(html, files)])

    small_batches()
    return rows.withColumn("html", edit("html", "_files")).drop("_files")


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<img\s[^>]*?(?:data-image-src|src)\s*=\s*"([^"]*)"'), F.lit(1))


def embedded_images(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """`pages` (page_id, html) with the sources of local images replaced by file names; `chosen`: page_id, src, file."""
    pairs = chosen.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("src", "file"))).alias("_pairs"))
    swap = F.aggregate(F.coalesce("_pairs", F.array().cast("array<struct<src:string,file:string>>")), F.col("html"), lambda acc, p: F.replace(acc, F.concat(F.lit('"'), p["src"], F.lit('"')), F.concat(F.lit('"'), p["file"], F.lit('"'))))
    return pages.join(pairs, "page_id", "left").withColumn("html", swap).drop("_pairs")


def normalised_paths(markdown: Column) -> Column:
    """Downloads and bare names in image links as attachments/<file>."""
    local = F.regexp_replace(markdown, r"(!\[[^\]]*\]\()[^)\s]*?/download/(?:attachments|thumbnails)/[^)\s]*?/([^/?)\s]+)(?:\?[^)]*)?\)", "$1attachments/$2)")
    return F.regexp_replace(local, r"(!\[[^\]]*\]\()([^/:)\s]+\.(?:png|jpe?g|gif|svg|webp))\)", "$1attachments/$2)")


def first_image_replaced(markdown: Column, file: Column, block: Column) -> Column:
    """The first link to an image of that file name, and of no longer one, replaced by a block, taken literally."""

    def one(text, name, mermaid):
        if text is None or not name or mermaid is None:
            return text
        hit = re.search(r"!\[[^\]]*\]\((?:[^)]*/)?" + re.escape(name) + r"(?:\?[^)]*)?\)", text)
        return text[: hit.start()] + mermaid + text[hit.end() :] if hit else text

    def edit(texts: pd.Series, names: pd.Series, blocks: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(texts, names, blocks)])

    small_batches()
    return F.pandas_udf(edit, "string")(markdown, file, block)
