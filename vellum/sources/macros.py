"""Macros in the storage format of wiki pages, taken out and put back.

The `ac:` elements of a page are walked once, as they open and close, in Arrow batches of pages; what
a page's text becomes is column expressions again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Kinds of macros whose text is lifted out of a page; a name that begins with one of FAMILIES is of that kind.
KINDS, FAMILIES = ("markdown", "mermaid", "code", "noformat"), ("mermaid",)
#: An `ac:` tag, or a stretch in which tags are text.
PIECE = re.compile(r"<!\[CDATA\[(?P<data>.*?)\]\]>|<(?P<close>/?)ac:(?P<tag>[\w-]+)(?P<attributes>[^>]*?)(?P<empty>/?)>", re.S)
ATTRIBUTE = re.compile(r'ac:name\s*=\s*"([^"]*)"')


@dataclass
class Macro:
    """A structured macro: where it stands, its parameters, and its body, which is text or, from `rich` on, markup."""

    name: str
    start: int
    end: int = 0
    parameters: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    rich: tuple[int, int] | None = None

    def kind(self) -> str | None:
        """Of KINDS, if there is a text."""
        if self.text is None:
            return None
        return next((k for k in KINDS if self.name == k or (k in FAMILIES and self.name.startswith(k))), None)

    def markdown(self) -> str:
        kind = self.kind()
        if kind == "markdown":
            return self.text
        title, language, body = "", "", self.text
        if kind == "code":
            title, language = (self.parameters.get(x, "") for x in ("title", "language"))
        elif kind == "mermaid":
            language, body = "mermaid", body.strip()
        return (f"**{title}**\n\n" if title else "") + f"```{language}\n{body}\n```"


def macros(html: str) -> list[Macro]:
    """All macros that are closed, in the order in which they begin; those inside others too."""
    found, path, reading, at = [], [], None, 0
    for piece in PIECE.finditer(html):
        tag = (piece["tag"] or "").lower()
        if piece["data"] is not None:
            if reading == "plain-text-body" and path:
                path[-1].text = (path[-1].text or "") + piece["data"]
        elif tag == "structured-macro" and not piece["close"]:
            name = ATTRIBUTE.search(piece["attributes"])
            macro = Macro(name[1].lower() if name else "", piece.start())
            if piece["empty"]:
                macro.end = piece.end()
                found.append(macro)
            else:
                path.append(macro)
        elif tag == "structured-macro" and path:
            macro = path.pop()
            macro.end = piece.end()
            found.append(macro)
        elif tag in ("parameter", "plain-text-body", "rich-text-body") and path and not piece["empty"]:
            if not piece["close"]:
                name = ATTRIBUTE.search(piece["attributes"])
                reading, at = (f"parameter {name[1] if name else ''}" if tag == "parameter" else tag), piece.end()
                if tag == "rich-text-body":
                    path[-1].rich = (at, at)
            elif tag == "rich-text-body":
                path[-1].rich = ((path[-1].rich or (piece.start(), 0))[0], piece.start())
            else:
                if reading and reading.startswith("parameter "):
                    path[-1].parameters[reading[10:]] = html[at : piece.start()].strip()
                reading = None
    return sorted(found, key=lambda m: m.start)


def mark(kind: str, index: int) -> str:
    """What stands in a page for a block that is lifted out."""
    return f"<!-- {kind} {index} -->"


def lifted(html: str) -> tuple[list[dict], str]:
    """The blocks of a page (kind, idx, content) by kind, and the page with marks for them and comments around the bodies of excerpts."""
    changes, blocks, counts, excerpts = [], [], dict.fromkeys(KINDS, 0), 0
    for macro in macros(html):
        kind = macro.kind()
        if kind:
            blocks.append({"kind": kind, "idx": counts[kind], "content": macro.markdown()})
            changes.append((macro.start, macro.end, mark(kind, counts[kind])))
            counts[kind] += 1
        elif macro.name == "excerpt" and macro.rich:
            name = macro.parameters.get("name") or macro.parameters.get("atlassian-macro-output-type") or f"excerpt_{excerpts}"
            changes += [(macro.start, macro.rich[0], f"<!-- EXCERPT: {name} -->\n"), (macro.rich[1], macro.end, f"\n<!-- /EXCERPT: {name} -->")]
            excerpts += 1
    out, at = [], 0
    for start, end, text in sorted(changes):
        if start >= at:
            out += [html[at:start], text]
            at = end
    blocks.sort(key=lambda b: KINDS.index(b["kind"]))
    return blocks, "".join(out) + html[at:]


def walked(html: Column) -> Column:
    """struct of blocks and page of lifted()."""

    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lifted(page or "") for page in pages], columns=["blocks", "page"])

    small_batches()
    return F.pandas_udf(run, "blocks array<struct<kind:string,idx:int,content:string>>, page string")(html)


def spliced(text: Column, blocks: Column) -> Column:
    """Marks replaced by their blocks; blocks whose mark is missing come at the end."""
    place = lambda b: F.concat(F.lit("<!-- "), b["kind"], F.lit(" "), b["idx"].cast("string"), F.lit(" -->"))
    return F.aggregate(blocks, text, lambda done, b: F.when(done.contains(place(b)), F.replace(done, place(b), b["content"])).otherwise(F.concat(done, F.lit("\n\n"), b["content"], F.lit("\n"))))


def macro_blocks(pages: DataFrame, column: str = "storage_html") -> DataFrame:
    """page_id, kind, idx, content of all macros."""
    return pages.select("page_id", F.inline(walked(F.col(column))["blocks"]))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, markdown: the view, or the storage format where there is no view, with the blocks of all macros."""
    from ..functions.text import html_to_markdown

    rows = pages.select("page_id", "view_html", walked(F.col("storage_html")).alias("walked"))
    view = F.coalesce(F.nullif(F.col("view_html"), F.lit("")), F.col("walked.page"))
    # Comments are kept from the tag stripper by marks of their own.
    guarded = F.regexp_replace(view, r"<!-- (.*?) -->", "\u0001$1\u0002")
    text = F.regexp_replace(html_to_markdown(guarded), "\u0001(.*?)\u0002", "<!-- $1 -->")
    return rows.select("page_id", spliced(text, F.col("walked.blocks")).alias("markdown"))


def inline_svgs(html: Column) -> Column:
    """Inline drawings of 100 characters or more."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<svg.*?</svg>)"), F.lit(1)), lambda s: F.length(s) >= 100)


def drawio_macros(html: Column) -> Column:
    """Hidden Draw.io data: array of maps from base64 JSON."""
    raw = F.regexp_extract_all(html, F.lit(r'(?is)id="drawio-macro-data-[^"]*"[^>]*>\s*([A-Za-z0-9+/=\s]+?)\s*</div>'), F.lit(1))
    return F.transform(raw, lambda b: F.from_json(F.try_to_binary(F.regexp_replace(b, r"\s", ""), F.lit("base64")).cast("string"), "map<string,string>"))
