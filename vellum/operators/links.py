"""Links between pages: extraction, bounded traversal, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import completeness, html_to_markdown

DEPTH, PAGES = 3, 15


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of the anchors of a page."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def page_headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, title."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", "pos", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("h", r"<[^>]+>", ""), r"\s+", " ")).alias("title"))


def page_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


def incomplete(pages: DataFrame, column: str = "text") -> DataFrame:
    """page_id, a count for each thing that a finished page has none of, and complete."""
    counts = completeness(F.coalesce(F.col(column), F.lit("")))
    total = sum(counts.values())
    return pages.select("page_id", *[c.cast("long").alias(n) for n, c in counts.items()], (total == 0).alias("complete"))


def closure(links: DataFrame, depth: int = DEPTH, pages: int = PAGES) -> DataFrame:
    """root, page_id, depth, truncated for pages reached from each root.

    A page counts at its least depth, and a root reaches `pages` pages at most, by depth and
    id; truncated tells that there were more.  Of every level a root keeps one page more than it may reach, which is enough:
    what only further pages lead to comes after all of these.  `depth` joins, none of them in a loop over rows.
    """
    links = links.where("page_id != linked_page_id").select(F.col("page_id").alias("_from"), F.col("linked_page_id").alias("_to")).distinct()
    reached = links.select(F.col("_from").alias("root"), F.col("_from").alias("page_id")).distinct().withColumn("depth", F.lit(0))
    edge = reached
    for d in range(1, depth + 1):
        step = edge.join(links, edge["page_id"] == links["_from"]).select("root", F.col("_to").alias("page_id")).distinct()
        step = step.join(reached.select("root", "page_id"), ["root", "page_id"], "left_anti")
        edge = step.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("page_id"))).where(F.col("_n") <= pages + 1).drop("_n").withColumn("depth", F.lit(d))
        reached = reached.unionByName(edge)
    found = reached.where("depth > 0")
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "page_id"))
    rows = found.withColumn("_n", place).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("root")))
    return rows.where(F.col("_n") <= pages).select("root", "page_id", "depth", (F.col("_all") > pages).alias("truncated"))


def inlined(pages: DataFrame, links: DataFrame, depth: int = DEPTH, limit: int = PAGES) -> DataFrame:
    """root, n_pages, markdown: each page of `pages` (page_id, text) with the texts of the pages that its links lead to, in the order of closure().

    A reached page stands below a heading that names it, once; what links to a page that stands there already, or to one
    beyond the limits, is a reference below that text.  A null text is empty; a page that is not in `pages` has no section.
    """
    reached = closure(links, depth, limit)
    places = reached.select("root", "page_id", "depth").unionByName(pages.select(F.col("page_id").alias("root"), "page_id", F.lit(0).alias("depth")))
    out = links.where("page_id != linked_page_id").select("page_id", "linked_page_id").distinct()
    parent = places.join(out, "page_id").select("root", "page_id", "depth", F.col("linked_page_id").alias("to"))
    at = places.select("root", F.col("page_id").alias("to"), F.col("depth").alias("to_depth"))
    # The first page, by depth and id, that leads to a page one level below is the one that brings it in.
    brings = parent.join(at, ["root", "to"]).where("to_depth = depth + 1").groupBy("root", "to").agg(F.min("page_id").alias("page_id")).withColumn("_in", F.lit(True))
    notes = parent.join(brings, ["root", "page_id", "to"], "left").where("_in is null").groupBy("root", "page_id").agg(F.array_sort(F.collect_list("to")).alias("refs"))
    rows = places.join(pages.select("page_id", "text"), "page_id").join(notes, ["root", "page_id"], "left")
    refs = F.coalesce(F.concat(F.lit("\n\nSee pages "), F.array_join(F.col("refs").cast("array<string>"), ", ")), F.lit(""))
    head = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat(F.lit("## Page "), F.col("page_id").cast("string"), F.lit("\n\n")))
    section = F.struct("depth", "page_id", F.concat(head, F.coalesce("text", F.lit("")), refs).alias("t"))
    sections = rows.groupBy("root").agg(F.array_sort(F.collect_list(section)).alias("s"))
    return sections.select("root", F.size("s").cast("long").alias("n_pages"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("markdown"))
