"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 sum of its content.  The
ledger records which (blob, rules version) pairs have been scanned and what was
found; a scan reads only blobs that the ledger lacks for the present rules, however
many paths and versions share them, and joins findings back to all of these.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import save, wide_hash


@dataclass(frozen=True)
class Rule:
    """A pattern; of a match, `group` must have at least `least` characters; it may not begin just after a character of the class `after`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    after: str = ""


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the second version of the rules added.
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, "A-Za-z0-9_-"),
)
FINDING = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob string, rules string, findings {FINDING}"
MARK, OTHER = "\x01", "\x02"
#: Pieces of a text that are summed up together; even.
RUN = 512


#: To be raised whenever matches() gives other findings for the same rules, so that no ledger serves old ones.
SCANNER = 1


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Names the rules and the scanner that a ledger's findings are by."""
    return hashlib.sha256(repr((SCANNER, rules)).encode()).hexdigest()[:16]


def long_enough(rule: Rule) -> str:
    """Where a match is a whole run of one class, runs that are too short need not match at all."""
    run = re.fullmatch(r"\[[^\]]+\]\+", rule.pattern)
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if run else rule.pattern


def once(value: Column, use) -> Column:
    """`use` of `value`, which is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, rank: int, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, those with too short a group dropped; end is exclusive.

    Matches are put between marks and the text is split there, so every second piece is
    a match and the lengths of the pieces give its place in code points.  A mark
    in the text itself is first changed to another control character, which no pattern holds.
    Pieces are summed up in runs of RUN and over the runs, so that the work of a text with very many matches stays nearly in proportion.
    """
    pattern = (f"(?<![{rule.after}])" if rule.after else "") + long_enough(rule)
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(MARK + "$0" + MARK)), MARK, -1)

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        held = F.regexp_extract(piece, rule.pattern, rule.group) if rule.group else piece
        keep = state["odd"] & (F.length(held) >= rule.least)
        found = F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"),
                        F.when(keep, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    def of_run(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("odd"), F.array().cast(FINDING).alias("found"))
        return F.aggregate(run, start, step, lambda s: s["found"])

    def of_runs(runs: Column) -> Column:
        sums = F.aggregate(
            F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, piece: n + F.length(piece))), F.array(F.lit(0)),
            lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
        # There is one sum more than runs; a run has an even number of pieces, so the next one begins with no match.
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(sums, 1, F.size(runs)).alias("at")), lambda x: of_run(x["run"], x["at"])))

    def of_pieces(pieces: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int")), lambda i: F.slice(pieces, i * RUN + 1, RUN))
        return F.when(F.size(pieces) <= RUN, of_run(pieces, F.lit(0))).otherwise(once(runs, of_runs))

    found = once(pieces, of_pieces)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(FINDING))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text -> blob, rules, findings (by start, then rule)."""
    found = F.concat(*[matches(F.col("text"), i, r) for i, r in enumerate(rules)])
    return blobs.select("blob", F.lit(rules_version(rules)).alias("rules"), F.sort_array(found).alias("findings"))


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, key: list[str], ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows (blob, rules, findings) for blobs of `versions` that `ledger` lacks under these rules.

    `versions` has a text and the columns of `key`, which name a version of a path.
    A blob is read from one version and scanned once, however many rows hold it, repeated ones among them; the rows of a blob are spread by their
    key.  A null text is an empty blob, which holds nothing.  Append the result to the ledger.
    """
    rows = versions.select(content_address(F.col("text")).alias("blob"), wide_hash(*[F.col(k) for k in key]).alias("at"), "text").where(F.length("text") > 0)
    unseen = rows.groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules_version(rules)).select("blob"), "blob", "left_anti")
    # Written first, so the join knows how many there are: a few are broadcast, and of texts only theirs move.
    unseen = save(unseen, "secrets-unseen")
    once = rows.join(unseen, ["blob", "at"], "left_semi").groupBy("blob", "at").agg(F.first("text").alias("text"))
    return scan(once, rules)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at `path`; None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def extend_ledger(versions: DataFrame, key: list[str], path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at `path` after the blobs of `versions` that it lacked have been scanned and appended.

    Rows are by content, so it may hold blobs of any table; a job that fails while it appends leaves whole
    rows at worst, and a blob that two jobs append at once has two equal rows.
    """
    spark = versions.sparkSession
    scan_versions(versions, key, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings_of(versions: DataFrame, key: list[str], ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of `key` and findings, one row per row of `versions`; [] where its blob has none."""
    held = ledger.where((F.col("rules") == rules_version(rules)) & (F.size("findings") > 0)).select(F.col("blob").alias("_blob"), "findings").dropDuplicates(["_blob"])
    paths = versions.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], content_address(F.col("text")).alias("_address"))
    return paths.join(held, F.col("_address") == F.col("_blob"), "left").select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def span_list(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    With a `ledger_path` only blobs that the ledger there lacks are scanned, and it is extended; without one all are, once each.
    Empty and null texts have no findings: counts 0, spans "", the sum of "".  Very long
    texts are scanned whole; repeated rows and copies are scanned once and reported each; spans that begin together are in the order of the rules.
    Other columns are not read; an empty table gives an empty one.
    """
    ledger = save(scan_versions(docs, ["doc_id"]), "ledger") if ledger_path is None else extend_ledger(docs, ["doc_id"], ledger_path)
    rows = findings_of(docs, ["doc_id"], ledger)
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    of_rank = lambda rank: F.filter("findings", lambda x: x["rank"] == rank)
    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
                       span_list(F.col("findings")).alias("spans"), F.size("findings").cast("long").alias("n_spans"))
