"""Keywords of any number of rules in documents: an inverted index over the keywords.

A keyword can only stand where its pieces stand: the word or the pairs of neighbouring words of one that is looked for as whole words; of one
that is looked for anywhere the words within it, and the ends and beginnings of words with the character that parts them from the rest.  Documents
give their distinct pieces, those that no keyword has go at once (the keywords' pieces are
broadcast while they are few), and of what is left the document frequencies tell each keyword's rarest piece.  Documents meet keywords by
that piece alone, in an equi-join; a keyword that is a piece is then found, any other is looked for in the text, which moves
once for each document that has something to look for.  A keyword of many rules is looked for once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a word of which a piece is the end or beginning, characters of a piece of any text, and keywords or documents' pieces that are broadcast.
EDGE, CHARS, SENT = 8, 4, 200_000
#: Hashes of pieces that are broadcast at most, and characters that part words up to which texts are cut at these alone.
HASHES, PARTING = 1_000_000, 64
#: Hits of a block of documents when rules are counted, blocks that smaller tables have, rules of a pack, and places that are looked at in one go.
BLOCK, WAYS, RULES, PLACES = 4_000_000, 24, 4_096, 4_000_000
#: Rules whose ids travel together when misses are listed.
PACK = 500


def none() -> Column:
    return F.array().cast("array<string>")


def low(text: Column) -> Column:
    """a-z for A-Z; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_runs(text: Column) -> Column:
    """The distinct runs of letters, digits and _ of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[^a-z0-9_]+", " "), " "), lambda w: w != ""))


def marked(kind: str, pieces: Column) -> Column:
    """Pieces of different kinds must not meet."""
    return F.transform(pieces, lambda p: F.concat(F.lit(kind), p))


def edge(kind: str, word: Column, size: Column | int) -> Column:
    """The first (p) or last (s) characters of a word."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.substring(word, F.lit(1) if kind == "p" else -size, size)


def word_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text in lower case, with what is between them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![a-z0-9_])(?=([a-z0-9_]++[^a-z0-9_]++[a-z0-9_]++))"), 1))


def rule_keywords(rules: DataFrame) -> DataFrame:
    """rule_id, keyword (lower case): a row for each rule and distinct keyword."""
    return rules.select("rule_id", F.explode("keywords").alias("k")).where("k is not null").select("rule_id", low(F.col("k")).alias("keyword")).distinct()


def keyword_pieces(keywords: DataFrame) -> DataFrame:
    """keyword, sure, pattern, pieces of distinct keywords in lower case.

    A keyword of whole words has its word or its pairs of words as pieces.  One that is looked for anywhere has the words within it, the end
    of a word that it begins with and the beginning of one that it ends with; without any of these its first characters.  Sure keywords need no look at the text.
    """
    k = F.col("keyword")
    whole = k.rlike("(?s)^[a-z0-9](.*[a-z0-9])?$")
    one, two = k.rlike("^[a-z0-9]([a-z0-9_]*[a-z0-9])?$"), k.rlike("^[a-z0-9][a-z0-9_]*[^a-z0-9_]+[a-z0-9_]*[a-z0-9]$")
    plain = F.regexp_replace("keyword", r"([^A-Za-z0-9_ ])", r"\\$1")
    first, last = F.regexp_extract(k, "(?s)^([a-z0-9_]+[^a-z0-9_])", 1), F.regexp_extract(k, "(?s)([^a-z0-9_][a-z0-9_]+)$", 1)
    part = lambda kind, word: F.when(word != "", F.array(F.concat(F.lit(kind), edge(kind, word, F.least(F.length(word), F.lit(EDGE + 1)))))).otherwise(none())
    within = F.concat(marked("w", word_runs(F.regexp_replace("keyword", "^[a-z0-9_]+|[a-z0-9_]+$", ""))), part("s", first), part("p", last))
    pieces = F.when(one, F.array(F.concat(F.lit("w"), k))).when(whole, marked("b", word_pairs(k))).when(k == "", F.array(F.lit(""))).when(F.size(within) > 0, within).otherwise(F.array(F.concat(F.lit("c"), F.substring(k, 1, CHARS))))
    short = ((k == first) | (k == last)) & (F.length(k) <= EDGE + 1)
    return keywords.select("keyword", (one | two | (k == "") | short).alias("sure"), F.when(whole, F.concat(F.lit("(^|[^a-z0-9_])"), plain, F.lit("($|[^a-z0-9_])"))).alias("pattern"), pieces.alias("pieces"))


def pieces_in(text: str, kinds: list[tuple[str, int, set[str]]]) -> list[str]:
    """The distinct pieces of a text in lower case, as text_pieces() has them."""
    # What parts words, and words, in turn.
    parts = re.split("([a-z0-9_]+)", text)
    words, after, before, out, cut = parts[1::2], parts[2::2], parts[:-1:2], {""}, {}
    for kind, parting in ((k, set().union(*(p for other, _, p in kinds if other == k))) for k in "sp"):
        some = len(parting) <= PARTING
        pairs = ((w + c[0], c[0]) for w, c in zip(words, after) if c) if kind == "s" else ((c[-1] + w, c[-1]) for w, c in zip(words, before) if c)
        cut[kind] = {p for p, c in pairs if not some or c in parting} if parting else set()
    for kind, n, _ in kinds:
        if kind == "w":
            out.update(map("w".__add__, words))
        elif kind == "b":
            out.update(f"b{a}{c}{b}" for a, c, b in zip(words, after, words[1:]))
        elif kind == "s":
            out.update("s" + w[-n:] for w in cut[kind] if len(w) >= n)
        elif kind == "p":
            out.update("p" + w[:n] for w in cut[kind] if len(w) >= n)
        elif kind == "c":
            out.update("c" + text[i : i + n] for i in range(len(text) - n + 1))
    return list(out)


def text_pieces(docs: DataFrame, kinds: list[tuple[str, int, set[str]]]) -> DataFrame:
    """doc_id, piece: the distinct pieces of texts, of the kinds and lengths, and with the characters that part words, that keywords have; every text has the empty one.

    A text is cut into words once for all kinds.
    """
    small_batches()
    pieces = F.pandas_udf(lambda texts: pd.Series([pieces_in(t, kinds) for t in texts]), "array<string>")
    return docs.where("doc_id is not null").select("doc_id", F.explode(pieces(low(F.col("text")))).alias("piece"))


def few(rows: DataFrame) -> DataFrame:
    """`rows` for a broadcast join while there are not more than SENT, else as they are."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def indexed(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rule_id, kid of rules, and the columns of keyword_pieces() with kid, the number of a keyword."""
    named = settled(rule_keywords(rules), "rule-keywords")
    index = settled(keyword_pieces(named.select("keyword").distinct()).withColumn("kid", F.monotonically_increasing_id()), "keywords")
    return named.join(index.select("keyword", "kid"), "keyword").select("rule_id", "kid"), index


def found_keywords(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, kid: the keywords in each document; more than once where rows have the same doc_id."""
    head = F.substring("piece", 1, 1)
    length = F.when(head.isin("w", "b"), 0).otherwise(F.length("piece") - 1)
    parting = F.when(head == "s", F.substring("piece", -1, 1)).when(head == "p", F.substring("piece", 2, 1))
    pieces = index.select(F.explode("pieces").alias("piece")).distinct()
    kinds = pieces.where("piece != ''").groupBy(head.alias("kind"), length.alias("n")).agg(F.collect_set(parting).alias("parting")).collect()
    shown = text_pieces(docs, sorted((r["kind"], r["n"], set(r["parting"])) for r in kinds))
    if pieces.limit(HASHES + 1).count() <= HASHES:
        hashes = pieces.select(F.xxhash64("piece").alias("h")).distinct()
        shown = shown.withColumn("h", F.xxhash64("piece")).join(F.broadcast(hashes), "h", "left_semi").drop("h")
    there = settled(shown.join(few(pieces), "piece", "left_semi"), "pieces")
    frequency = there.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    each = index.select("kid", F.explode("pieces").alias("piece")).join(few(frequency), "piece", "left")
    rarest = each.groupBy("kid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).select("kid", F.col("r.piece").alias("piece"))
    keyed = settled(index.select("kid", "keyword", "sure", "pattern").join(rarest, "kid"), "keyed")
    sure, unsure = (few(keyed.where(which)) for which in ("sure", "not sure"))
    todo = there.join(unsure, "piece").groupBy("doc_id").agg(F.collect_set(F.struct("kid", "keyword", "pattern")).alias("todo"))
    shown = docs.select("doc_id", low(F.col("text")).alias("low")).join(todo, "doc_id")
    holds = lambda t: F.col("low").contains(t["keyword"]) & (t["pattern"].isNull() | F.regexp_like(F.col("low"), t["pattern"]))
    looked = shown.select("doc_id", F.explode(F.filter("todo", holds)).alias("t")).select("doc_id", F.col("t.kid").alias("kid"))
    return there.join(sure, "piece").select("doc_id", "kid").unionByName(looked)


def hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, rule_id for every rule (rule_id, keywords) with a keyword in the document (doc_id, text); keywords as in validation.keyword_pattern().

    A null text is empty; rows of equal doc_id are one document; those without doc_id are left out.  An empty keyword is in every document, a rule
    without keywords in none.
    """
    named, index = indexed(rules)
    return found_keywords(docs, index).join(few(named), "kid").select("doc_id", "rule_id").distinct()


def counts(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, n_docs: how many documents each rule of hits() is in, without a list of the hits, which grows with the product of documents and rules.

    Only hits of keywords are kept.  Rules with the same keywords are counted once, in blocks of documents: a block's
    hits come together with all rules, in packs, and each rule's documents are its most frequent keyword's, those that its second adds, counted once for all rules with these two, and those that the others add.
    """
    named, index = indexed(rules)
    of_rules = settled(named.groupBy("rule_id").agg(F.array_sort(F.collect_set("kid")).alias("kids")), "kids-of-rules")
    classes = settled(of_rules.select("kids").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    found = settled(found_keywords(docs, index), "found")
    n = found.count()
    blocks, packs = max(1, -(-n // BLOCK), min(WAYS, n * WAYS // BLOCK)), max(1, -(-classes.count() // RULES))
    c = F.col("c")
    packed = classes.groupBy(F.pmod(F.xxhash64("class"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("class", "kids")).alias("c"))
    packed = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), c["class"].alias("ids"), F.transform(c, lambda x: F.size(x["kids"])).alias("sizes"), F.flatten(c["kids"]).alias("kids"))
    dealt = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("doc_id").alias("h"), "doc_id", "kid")
    # Ids of any type are numbers within a block.
    kind = found.schema["doc_id"].dataType.simpleString()
    dealt = dealt.drop("h") if kind in ("bigint", "int") else dealt.withColumn("doc_id", F.col("h")).drop("h")

    def block(hits: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        if not len(hits) or not len(packs):
            return pd.DataFrame({"class": [], "n": []}, dtype="int64")
        ids, n = counted(hits["doc_id"].to_numpy(), hits["kid"].to_numpy(), *(np.concatenate(packs[x].tolist()) for x in ("ids", "sizes", "kids")))
        return pd.DataFrame({"class": ids, "n": n})

    some = dealt.groupBy("block").cogroup(packed.groupBy("block")).applyInPandas(block, "class long, n long")
    return some.groupBy("class").agg(F.sum("n").alias("n_docs")).join(classes, "class").join(of_rules, "kids").select("rule_id", "n_docs")


def counted(docs: np.ndarray, kids: np.ndarray, ids: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `ids` of rules that are in documents, and in how many, from hits (docs, kids); `of` are the rules' keywords one after the other, `sizes` of each."""
    names, kids = np.unique(kids, return_inverse=True)
    every, docs = np.unique(docs, return_inverse=True)
    wide = len(every)
    hits = np.unique(kids * wide + docs)
    kids, docs = np.divmod(hits, wide)
    start = np.searchsorted(kids, np.arange(len(names) + 1))
    rule, at = np.repeat(np.arange(len(ids)), sizes), np.minimum(np.searchsorted(names, of), len(names) - 1)
    here = names[at] == of
    rule, at = rule[here], at[here]
    sized = start[1:] - start[:-1]
    order = np.lexsort((at, -sized[at], rule))
    rule, at = rule[order], at[order]
    n, most, second = np.zeros(len(ids), "int64"), np.zeros(len(ids), "int64"), np.full(len(ids), -1)
    marks = np.zeros(wide, bool)
    begins = lambda rule: np.r_[True, rule[1:] != rule[:-1]][: len(rule)]

    def added(who: np.ndarray, at: np.ndarray, most: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each number in `who` the documents of its keywords `at` that have neither its most frequent keyword nor its second, if it has one."""
        n = np.zeros(len(most), "int64")
        order = np.lexsort((who, most[who]))
        who, at = who[order], at[order]
        length = sized[at]
        # What has one number lies together, and what has one most frequent keyword too, and this is cut where a number begins.
        first = begins(who)
        go = (np.cumsum(length) - length)[first] // PLACES
        lot = go[np.cumsum(first) - 1] if len(who) else go
        cuts = np.flatnonzero(np.r_[True, (most[who[1:]] != most[who[:-1]]) | (lot[1:] != lot[:-1])]) if len(who) else []
        for low, high in zip(cuts, [*cuts[1:], len(who)]):
            own = docs[start[most[who[low]]] : start[most[who[low]] + 1]]
            marks[own] = True
            size = length[low:high]
            where = docs[np.repeat(start[at[low:high]] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            whose = np.repeat(np.cumsum(first[low:high]) - 1, size)
            left = ~marks[where]
            where, whose = where[left], whose[left]
            names = who[low:high][first[low:high]]
            if (second[names] >= 0).any():
                other = second[names][whose] * wide + where
                left = hits[np.minimum(np.searchsorted(hits, other), len(hits) - 1)] != other
                where, whose = where[left], whose[left]
            if not first[low:high].all():
                whose = np.unique(whose * wide + where) // wide
            n[names] += np.bincount(whose, minlength=len(names))
            marks[own] = False
        return n

    head = begins(rule)
    n[rule[head]], most[rule[head]] = sized[at[head]], at[head]
    rule, at = rule[~head], at[~head]
    head = begins(rule)
    second[rule[head]] = at[head]
    # What a second keyword adds to the most frequent one is counted once for all rules with these two.
    two = np.flatnonzero(second >= 0)
    pairs, own = np.unique(most[two] * len(names) + second[two], return_inverse=True)
    n[two] += added(np.arange(len(pairs)), pairs % max(len(names), 1), pairs // max(len(names), 1), np.full(len(pairs), -1))[own]
    n += added(rule[~head], at[~head], most, second)
    return ids[n > 0], n[n > 0]


def listed(docs: DataFrame, rules: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, rule_id, found: a row for each document and rule, misses included, from the hits.

    The ids of rules travel in packs, which documents meet by their numbers; hits go to their packs.
    """
    ids = rules.select("rule_id").distinct()
    packs = max(1, -(-ids.count() // PACK))
    number = F.pmod(F.xxhash64("rule_id"), F.lit(packs)).cast("int").alias("pack")
    packed = ids.select(number, "rule_id").groupBy("pack").agg(F.collect_list("rule_id").alias("ids"))
    held = found.select("doc_id", number, "rule_id").groupBy("doc_id", "pack").agg(F.collect_set("rule_id").alias("hit"))
    every = docs.where("doc_id is not null").select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))
    rows = every.join(F.broadcast(packed) if packs * PACK <= SENT else packed, "pack").join(held, ["doc_id", "pack"], "left")
    # The pack's ids are marked in one pass, by a set of its hits.
    here = F.coalesce("hit", none())
    missed = rows.select("doc_id", F.explode(F.array_except("ids", here)).alias("rule_id"), F.lit(False).alias("found"))
    return missed.unionByName(found.join(ids, "rule_id", "left_semi").select("doc_id", "rule_id", F.lit(True).alias("found")))
