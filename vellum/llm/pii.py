"""Personal data: patterns, and information-theoretic sanitisation around what they find.

Patterns find the protected entities.  The words of the documents that hold an entity are
then measured over the whole corpus: a term t reveals an entity e to the degree that their
pointwise mutual information log p(t, e) / (p(t) p(e)) comes near the information
of e itself, -log p(e), which is reached when t never occurs without e.  Terms above
the disclosure threshold are covered by spans of their own wherever they stand, in any
document; sanitise() generalises them to their kind or removes them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import Filter, arrow_map, save, unused, wide_hash

ship(__name__)

#: Fixed patterns of the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What stands before and after the @ of an address, and IP for runs of digits as wholes: with these no stretch of text is read again and again.
BEFORE_AT, AFTER_AT = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
WHOLE_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity that count as near it, and letters that a term has at least.
NEAR, TERM_LETTERS = 8, 4
#: Different contexts that a term and an entity share at least, and the share of the entity's information from which a term discloses it.
SUPPORT, DISCLOSED = 3, 0.8
#: Standard deviations by which the share of a term's documents that hold the entity is taken too low, and by which their number must exceed what chance has.
DOUBT, BEYOND = 1.0, 4.0
TERM = re.compile(r"[^\W\d_]{%d,}" % TERM_LETTERS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each @ outwards.

    Address characters are no @, so a match begins with the first of them after the @ or the match before, and that
    is as far to the left as any match of this @ begins.
    """
    at, low = text.find("@"), 0
    while at >= 0:
        after = AFTER_AT.match(text, at + 1)
        if after:
            back = text[low:at][::-1]
            start = at - BEFORE_AT.match(back).end()
            if start < at:
                yield start, after.end()
                low = after.end()
                at = text.find("@", low)
                continue
        low = max(low, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches that pass, in order."""
    found = []
    if "@" in text:
        found += [(start, 0, end) for start, end in addresses(text)]
    for m in WHOLE_IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """One name for the ways to write a value."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def term_id(term: str) -> int:
    return digest(term.lower())


def windows(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, list[int]]]:
    """(entity, context, terms) of each match: the terms near it and a hash of them as written."""
    out = []
    for start, kind, end in spans:
        terms = [*[(m.start(), m.end()) for m in TERM.finditer(text, max(0, start - 16 * NEAR), start)][-NEAR:],
                 *[(m.start(), m.end()) for m in TERM.finditer(text, end, end + 16 * NEAR)][:NEAR]]
        terms = [t for t in terms if all(t[1] <= s or t[0] >= e for s, _, e in spans)]
        terms = [t for t in terms if not (text[t[0] - 1 : t[0]].isalpha() or text[t[1] : t[1] + 1].isalpha())]  # whole words
        context = digest(" ".join(text[a:b] for a, b in terms))
        out.append((entity(kind, text[start:end]), context, [term_id(text[a:b]) for a, b in terms]))
    return out


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of all terms of a text that no match covers."""
    if not spans:
        return [m.span() for m in TERM.finditer(text)]
    covered = bytearray(len(text))
    for start, _, end in spans:
        covered[start:end] = b"\x01" * (end - start)
    return [m.span() for m in TERM.finditer(text) if 1 not in covered[m.start() : m.end()]]


def decoded(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, hash, spans (start, kind, end, flat), entities (entity, key, contexts: how many differ): the patterns' finds in `docs` (doc_id, hash, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tuples = pa.struct([("entity", pa.string()), ("key", pa.int64()), ("contexts", pa.int64())])

    def run(batches):
        for batch in batches:
            spans, entities = [], []
            for value in batch.column(2).cast(pa.binary()):
                text = decoded(value)
                found, contexts = base_spans(text), defaultdict(set)
                for name, context, _ in windows(text, found):
                    contexts[name].add(context)
                spans.append([x for span in found for x in span])
                entities.append([{"entity": e, "key": digest(e), "contexts": len(c)} for e, c in contexts.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(entities, pa.list_(tuples))], names=["doc_id", "hash", "spans", "entities"])

    return arrow_map(docs, run, f"doc_id {kind}, hash binary, spans array<int>, entities array<struct<entity:string,key:bigint,contexts:bigint>>")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_docs over all of `docs` (doc_id, hash, text), counted in each task before the shuffle, for terms in the filter."""
    wanted = Filter(terms, "term")

    def run(batches):
        known, counts = {}, Counter()
        for batch in batches:
            for value in batch.column(2).cast(pa.binary()):
                own = set()  # a term counts once, however it is written
                for word in set(TERM.findall(decoded(value))):
                    term = known.get(word)
                    if term is None:
                        term = term_id(word)
                        if not wanted.has_one(term):
                            term = 0
                        if len(known) < 500_000:
                            known[word] = term
                    if term:
                        own.add(term)
                counts.update(own)
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})
                counts = Counter()
        yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    return arrow_map(docs, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def shared_contexts(docs: DataFrame, strong: DataFrame, support: int, held: int = 200_000) -> DataFrame:
    """entity, term, contexts, n_both: documents that hold both, anywhere, for the entities (entity, key) of `strong`.

    A term near an entity has the words around the entity as contexts, one that stands
    further off those around the two of them.  Counts above `support` are not exact.
    """
    wanted = Filter(strong, "key")

    def listed_pairs(counts):
        names, terms = zip(*counts) if counts else ((), ())
        columns = [pa.array(names, pa.string()), pa.array(terms, pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([sorted(c[1])[:support] for c in counts.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["entity", "term", "n", "shared"])

    def run(batches):
        counts = {}
        for batch in batches:
            for value in batch.column(2).cast(pa.binary()):
                text = decoded(value)
                spans = base_spans(text)
                own, close = {}, defaultdict(set)
                for name, context, terms in windows(text, spans):
                    if wanted.has_one(digest(name)):
                        own[name] = min(own.get(name, context), context)
                        for term in terms:
                            close[name, term].add(context)
                if not own:
                    continue
                places, first = free_terms(text, spans), {}
                for i, (a, b) in enumerate(places):
                    first.setdefault(term_id(text[a:b]), i)
                for name, context in own.items():
                    for term, i in first.items():
                        n = counts.setdefault((name, term), [0, set()])
                        n[0] += 1
                        if len(n[1]) < support:
                            around = places[max(0, i - NEAR // 2) : i + NEAR // 2 + 1]
                            n[1].update(close.get((name, term)) or [digest(f"{context} " + " ".join(text[a:b] for a, b in around))])
                    if len(counts) > held:
                        yield listed_pairs(counts)
                        counts = {}
        yield listed_pairs(counts)

    rows = arrow_map(docs, run, "entity string, term long, n long, shared array<long>").groupBy("entity", "term")
    return rows.agg(F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("contexts"), F.sum("n").alias("n_both"))


def surely(part: Column, whole: Column, doubt: float = DOUBT) -> Column:
    """The lower bound of Wilson's interval for the probability behind `part` of `whole`."""
    share, z = part / whole, doubt * doubt
    return (share + z / (2 * whole) - doubt * F.sqrt(share * (1 - share) / whole + z / (4 * whole * whole))) / (1 + z / whole)


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """term: those whose mutual information with an entity reaches `disclosed` of the entity's information, surely.

    The probability of the entity beside the term is the lower bound of its confidence interval, and the two must meet far more often than
    chance would have it.  An entity that many documents have, as a footer's address, so needs a term that goes along with it nearly
    everywhere; one that stands in every document has no information and is disclosed by nothing.

    All counts are of whole documents, so copies of a text raise them alike; the support is
    of different contexts, so copies alone do not make a term disclosing.
    """
    each = found.select(F.explode("entities").alias("x")).groupBy("x.entity", "x.key").agg(F.sum("x.contexts").alias("contexts"), F.count(F.lit(1)).alias("n_entity"))
    strong = save(each.where(F.col("contexts") >= support).select("entity", "key", "n_entity"), "pii-entities")
    if strong.isEmpty():
        return strong.select(F.col("key").alias("term"))
    joint = shared_contexts(docs, strong, support).where(F.col("contexts") >= support)
    joint = save(joint.join(strong.select("entity", "n_entity"), "entity"), "pii-joint")
    n = float(max(docs.count(), 1))
    rows = joint.join(document_counts(docs, joint.select("term")), "term")
    information = -F.log(F.col("n_entity") / n)
    mutual = F.log(surely(F.col("n_both"), F.greatest("n_docs", "n_both")) * n / F.col("n_entity"))
    often = F.col("n_entity") / n
    chance = F.greatest("n_docs", "n_both") * often
    return rows.where((mutual >= disclosed * information) & (F.col("n_both") - chance >= BEYOND * F.sqrt(chance * (1 - F.least(often, F.lit(1.0)))))).select("term").distinct()


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, hash, start, end: all places of `terms` (term) in `docs` (doc_id, hash, text) that no match covers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = Filter(terms, "term")

    def run(batches):
        known = {}
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column(2).cast(pa.binary())):
                text = decoded(value)
                hits = []
                for m in TERM.finditer(text):
                    term = known.get(m[0])
                    if term is None:
                        term = term_id(m[0])
                        if not wanted.has_one(term):
                            term = 0
                        if len(known) < 500_000:
                            known[m[0]] = term
                    if term:
                        hits.append((term, *m.span()))
                if hits:
                    free = set(free_terms(text, base_spans(text)))
                    hits = [h for h in hits if h[1:] in free]
                rows += [row] * len(hits)
                out += hits
            picked = pa.array(rows, pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), *columns], names=["doc_id", "hash", "term", "start", "end"])

    return arrow_map(docs, run, f"doc_id {kind}, hash binary, term long, start int, end int").join(terms, "term", "left_semi").drop("term")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms and text_hash.

    Null texts are empty and have the sum of ""; spans are in code points; those that begin together are in the order of KINDS.  Equal rows
    are treated alike; long texts are read whole, in time that grows with their length; other columns are not read; an empty table gives an empty one.
    """
    texts = docs.select("doc_id", wide_hash(F.col("text")).alias("hash"), "text")
    found = save(detect(texts), "pii")
    terms = save(disclosing(texts, found, support, disclosed), "pii-terms")
    if terms.isEmpty():
        rows = found.select("doc_id", "hash", "spans", F.array().cast("array<int>").alias("extra"))
    else:
        # A group is the terms of one text, however often the row is repeated.
        marked = occurrences(texts, terms).distinct().groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(
            F.flatten(F.sort_array(F.collect_list(F.array("start", F.lit(KINDS.index("term")), "end")))).alias("extra"))
        rows = found.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").select(
            "doc_id", "hash", "spans", F.coalesce("extra", F.array().cast("array<int>")).alias("extra"))
    fields = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, text_hash binary"

    def run(batches):
        for batch in batches:
            out = []
            for base, more in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                base = [*zip(base[::3], base[1::3], base[2::3])]
                more = [*zip(more[::3], more[1::3], more[2::3])]
                kinds = Counter(k for _, k, _ in base)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                out.append((*(kinds[k] for k in range(4)), digest, listed(sorted([*base, *more])), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(1)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "text_hash"])

    return arrow_map(rows, run, fields)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sanitise(docs: DataFrame, found: DataFrame, remove_terms: bool = False) -> DataFrame:
    """`docs` (doc_id, text and columns of any name) with each span of find_personal_data() generalised to [KIND]; terms are removed if asked.

    Spans are found by doc_id and text, so repeated rows stay as many as they are.  Null and empty texts stay as they are.
    """
    same_id, same_hash, spans_name = unused(docs, "same_id", "same_hash", "same_spans")
    spans = found.where("spans != ''").select(F.col("doc_id").alias(same_id), F.col("text_hash").alias(same_hash), F.col("spans").alias(spans_name)).dropDuplicates([same_id, same_hash])
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(same_id)) & (wide_hash(F.col("text")) == F.col(same_hash)), "left")
    names = docs.columns
    rows = rows.select(*names, spans_name)
    place = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                out, at = [], 0
                for kind, start, end in (s.split(":") for s in (spans or "").split(",") if s):
                    if int(start) >= at:
                        out += [text[at : int(start)], "" if kind == "term" and remove_terms else f"[{kind.upper()}]"]
                        at = int(end)
                texts.append(None if text is None else "".join(out) + text[at:])
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(rows, run, fields)
