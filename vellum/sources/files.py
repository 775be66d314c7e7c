"""Files and folders: pages, rules, skills, slides, diagram JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DIAGRAM, SCHEMA_VERSION


def folder(spark: SparkSession, path: str, name: str) -> DataFrame:
    """page_id (the folder's name), content, mtime of every `<path>/<page>/<name>`, hidden folders left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    page = F.element_at(F.split("path", "/"), -2)
    return rows.select(page.alias("page_id"), F.col("content").cast("string").alias("content"), F.col("modificationTime").cast("double").alias("mtime")).where(~F.col("page_id").startswith("."))


def pages(rows: DataFrame) -> DataFrame:
    """page_id, html, empty: the view of a page, else its storage format."""
    html = F.coalesce(F.nullif(F.col("view_html"), F.lit("")), "storage_html", F.lit(""))
    return rows.select("page_id", html.alias("html"), (html == "").alias("empty"))


def read_diagrams(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Diagram JSON files; strict fails on a file that doesn't fit, else its row has nulls."""
    return spark.read.schema(DIAGRAM).option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_diagrams(diagrams: DataFrame, path: str) -> None:
    diagrams.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(path)


def with_defaults(diagrams: DataFrame) -> DataFrame:
    """Missing fields of nodes, edges and groups filled in."""
    def filled(item: Column, defaults: dict) -> Column:
        for name, value in defaults.items():
            item = item.withField(name, F.coalesce(item[name], F.lit(value)))
        return item

    node = {"shape": "rectangle", "x": 0.0, "y": 0.0, "width": 0.0, "height": 0.0, "confidence": 1.0}
    edge = {"label": "", "style": "solid", "arrow_start": False, "arrow_end": True, "confidence": 1.0}
    out = diagrams.withColumn("nodes", F.transform("nodes", lambda x: filled(x, node))).withColumn("edges", F.transform("edges", lambda x: filled(x, edge)))
    out = out.withColumn("groups", F.transform("groups", lambda x: filled(x, {"style": "solid"})))
    return out.withColumn("diagram_type", F.coalesce("diagram_type", F.lit("flowchart"))).withColumn("direction", F.coalesce("direction", F.lit("TB")))


def frontmatter(text: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1), rf"(?m)^{key}:[ \t]*(.*)$", 1))


def skills(files: DataFrame) -> DataFrame:
    """name, category, description, tagged of skill files (content)."""
    c = F.col("content")
    return files.select(frontmatter(c, "name").alias("name"), F.nullif(frontmatter(c, "category"), F.lit("")).alias("category"), frontmatter(c, "description").alias("description"), (frontmatter(c, "category") != "").alias("tagged"))


def rule_blocks(files: DataFrame) -> DataFrame:
    """rule_id, category, kind, name, severity, required, keywords of the JSON blocks at the end of rules files (content)."""
    item = "array<struct<id:string,name:string,severity:string,required:boolean,keywords:array<string>>>"
    block = F.element_at(F.regexp_extract_all("content", F.lit(r"(?s)```json\s*\n(.*?)```"), F.lit(1)), -1)
    rows = files.select(F.from_json(block, f"category string, rules {item}, anti_patterns {item}, vulnerabilities {item}").alias("j"))
    category = F.when(F.col("j.category") == "architectural-standards", "standards").otherwise(F.col("j.category"))
    out = None
    for field, kind in (("rules", "rule"), ("anti_patterns", "anti_pattern"), ("vulnerabilities", "vulnerability")):
        part = rows.select(category.alias("category"), F.lit(kind).alias("kind"), F.explode(F.col(f"j.{field}")).alias("r"))
        part = part.select(F.col("r.id").alias("rule_id"), "category", "kind", "r.name", "r.severity", F.coalesce("r.required", F.lit(False)).alias("required"), "r.keywords")
        out = part if out is None else out.unionByName(part)
    return out


def rule_rows(files: DataFrame) -> DataFrame:
    """source, pos, fields and error of the rows of rules tables (source, content): ID, Rule, Sev, Req, Keywords, Condition, AST Condition."""
    lines = files.select("source", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.trim("line").rlike(r"^\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda _x: F.trim(_x))
    rows = lines.withColumn("c", cells).where(~F.lower(F.col("c")[0]).isin("id", "rule id"))
    good = F.size("c") >= 7
    return rows.select("source", "pos", F.when(good, F.col("c")[0]).alias("rule_id"), F.when(good, F.col("c")[1]).alias("name"), F.when(good, F.col("c")[2]).alias("severity"),
                       (good & F.upper(F.get("c", F.lit(3))).startswith("Y")).alias("required"), F.when(good, F.filter(F.transform(F.split(F.col("c")[4], "[,;]"), lambda _x: F.trim(_x)), lambda k: k != "")).alias("keywords"),
                       F.when(good, F.col("c")[5]).alias("condition"), F.when(good, F.nullif(F.get("c", F.lit(6)), F.lit("-"))).alias("ast_condition"),
                       F.when(~good, F.concat(F.lit("expected 7 cells, got "), F.size("c"))).alias("error"))


def slides(files: DataFrame) -> DataFrame:
    """source, pos, title, mermaid, legend, notes of Markdown decks (source, content)."""
    rows = files.select("source", F.posexplode(F.split("content", r"\n---\n")).alias("pos", "s"))
    get = lambda pattern: F.trim(F.regexp_extract("s", pattern, 1))
    title = F.regexp_replace(get(r"(?m)^##\s+(.*)$"), r"^Slide \d+:\s*", "")
    return rows.select("source", "pos", title.alias("title"), get(r"(?s)```mermaid\s*\n(.*?)```").alias("mermaid"), legend_items(F.col("s")).alias("legend"),
                       get(r"(?s)\*\*Notes?:?\*\*:?\s*(.*)$").alias("notes")).where("title != ''")


def legend_items(html: Column) -> Column:
    """array of color and label from coloured spans."""
    colors, labels = (F.regexp_extract_all(html, F.lit(r'(?is)<span[^>]*background(?:-color)?:\s*(#[0-9a-f]{3,8})[^>]*>.*?</span>\s*([^<\n]*)'), F.lit(i)) for i in (1, 2))
    return F.zip_with(colors, labels, lambda c, t: F.struct(c.alias("color"), F.trim(t).alias("label")))
