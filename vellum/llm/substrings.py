"""Substring deduplication with suffix automata of reference shards.

A word is removed if a window of 20 words covers it whose words also start earlier.
The 8-grams of words with the least hash in some window are the text's anchors; equal windows have equal
anchors, so only windows of anchors that occur repeatedly matter.  The corpus is thus cut
into reference shards, one for each repeated anchor: the passages that its windows
span.  A shard's passages stream, in the order of the documents, through the suffix automaton of
those before; the matching statistics tell at each word how long a passage ending there has
occurred, and where that is a window or more its words are to go.

A broadcast of every shard's automaton to every document would read the corpus once
for each shard and grow with it; here passages go to the one shard they can match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import Filter, arrow_map, by_part, dealt, save
from .textvec import SPACED, Texts, Words, mix

ship(__name__)

WINDOW, GRAM = 20, 8
#: Anchors or passages put together in a task before they are packed.
HELD_ANCHORS, HELD_PASSAGES = 2_000_000, 150_000
#: Anchors of a part of the shuffle, bytes of text that have one, and parts at least.
PART, ANCHOR_BYTES, PARTS = 1_000_000, 40, 64
#: Sightings from which an anchor's windows become shards of their own, so that no shard holds what a large part of the documents shares.
COMMON = 500
LAST = np.iinfo(np.int64).max

ANCHOR = np.dtype([("anchor", "<i8"), ("count", "<u2")])
PASSAGE = np.dtype([("shard", "<i8"), ("hash", "<i8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("words", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("end", "<i4")])


class SuffixAutomaton:
    """Of several sequences of ints; knows whether what was read last occurs in one of them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        after, link, length = self.next, self.link, self.length
        known = after[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        after, link, length = self.next, self.link, self.length
        copy = len(after)
        after.append(dict(after[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and after[p].get(c) == q:
            after[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each element the length of the longest passage ending there that has been added."""
        after, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for c in sequence:
            while state and c not in after[state]:
                state = link[state]
                matched = length[state]
            to = after[state].get(c)
            if to is not None:
                state, matched = to, matched + 1
            else:
                matched = 0
            out.append(matched)
        return out


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, windows) of each run of windows with one anchor; windows count from a chunk's first word."""
    h = words.hashes
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    grams = all_grams(h)
    low = (1 << 24) - 1
    packed = (grams & ~np.uint64(low)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(low))
    m = packed
    for step in (1, 2, 4):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: len(h) - WINDOW + 1], m[5:][: len(h) - WINDOW + 1])
    counts = np.maximum(np.diff(words.bounds) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(text)) + np.repeat(words.bounds[:-1] - (np.cumsum(counts) - counts), counts)
    at = start + (((m[start] & np.uint64(low)).astype(np.int64) - start) & low)
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(first)
    return text[begin], grams[at[begin]].view(np.int64), start[begin], np.diff(np.append(begin, len(at)))


def all_grams(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - GRAM + 1 + j])
    return total


def anchored(column: pa.Array):
    """(first row, Words, anchors) of runs of rows."""
    for lo, _, data, offsets in Texts(column).chunks():
        words = Words(data, offsets, SPACED)
        yield lo, words, anchors(words)


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """anchor, count (of sightings, capped at 65535 for a task) of the anchors that occur more than once."""

    def packed(held):
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        entries = np.empty(len(found), ANCHOR)
        entries["anchor"], entries["count"] = found, np.minimum(counts, 65535)
        part = found.view(np.uint64) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        entries = entries[order]
        rows = [(i, entries[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "entries"])

    def find(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, (_, anchor, _, _) in anchored(batch.column(0)):
                held.append(anchor)
                n += len(anchor)
            if n >= HELD_ANCHORS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def count(batches):
        for own in by_part(batches, 0):
            e = np.concatenate([np.frombuffer(entries, ANCHOR) for _, entries in own])
            e = e[np.argsort(e["anchor"], kind="stable")]
            begin = np.flatnonzero(np.concatenate([[True], e["anchor"][1:] != e["anchor"][:-1]]))
            counts = np.add.reduceat(e["count"].astype(np.int64), begin)
            keep = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(e["anchor"][begin][keep]), pa.array(counts[keep])], names=["anchor", "count"])

    return arrow_map(dealt(arrow_map(docs.select("text"), find, "part int, entries binary"), parts), count, "anchor long, count long")


def packed_passages(docs: DataFrame, repeated: Filter, common: Filter, parts: int) -> DataFrame:
    """part, passages, words, spans: passages of repeated anchors for their shards; spans of those that the same task has earlier.

    `docs` has doc (long), hash (of the text) and text.  A passage is named by its shard, which comes of the words' first hashes, and
    by a hash of their second ones, 128 bits in all; its words go along as 64 bits each.
    """

    def flush(heads, tails, at):
        head, tail = np.concatenate(heads), np.concatenate(tails)
        begin = np.cumsum(head["words"]) - head["words"]
        order = np.lexsort((head["start"], head["doc"], head["hash"], head["shard"]))
        h = head[order]
        new = np.ones(len(h), bool)
        new[1:] = (h["hash"][1:] != h["hash"][:-1]) | (h["shard"][1:] != h["shard"][:-1])
        lead = h[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        send = new | ((h["doc"] == lead["doc"]) & (h["start"] == lead["start"]))
        spans = np.empty(int((~send).sum()), SPAN)
        for name in ("doc", "text", "start"):
            spans[name] = h[name][~send]
        spans["end"] = spans["start"] + h["words"][~send]
        spans = merged(spans)
        h, begin = h[send], begin[order][send]
        part = h["shard"].view(np.uint64) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        h, begin = h[by], begin[by]
        ends = np.searchsorted(part[by], np.arange(parts + 1))
        rows = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if b > a:
                n = h["words"][a:b]
                index = np.arange(n.sum()) + np.repeat(begin[a:b] - (np.cumsum(n) - n), n)
                rows.append((i, h[a:b].tobytes(), tail[index].tobytes(), b""))
        rows += [((at + j) % parts, b"", b"", spans[j * 4096 : (j + 1) * 4096].tobytes()) for j in range(-(-len(spans) // 4096))]
        columns = [*zip(*rows)] if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "passages", "words", "spans"])

    def run(batches):
        heads, tails, held, at = [], [], 0, 0
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, words, (text, anchor, start, n) in anchored(batch.column(2)):
                hit = repeated.has(anchor)
                text, anchor, start, n = text[hit], anchor[hit], start[hit], n[hit]
                wide = common.has(anchor)
                # Each window of a common anchor is a passage, and a shard, of its own.
                single = np.where(wide, n, 1)
                offset = np.arange(single.sum()) - np.repeat(np.cumsum(single) - single, single)
                text, anchor, wide, start = (np.repeat(x, single) for x in (text, anchor, wide, start))
                start = start + offset
                length = np.where(wide, WINDOW, np.repeat(n, single) + WINDOW - 1)
                if not len(start):
                    continue
                begin = np.cumsum(length) - length
                place = np.arange(length.sum()) - np.repeat(begin, length)
                index, turn = np.repeat(start, length) + place, place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                tail = words.hashes[index]
                name = lambda hashes: mix(np.add.reduceat(mix(hashes + turn), begin)).view(np.int64)
                head = np.empty(len(start), PASSAGE)
                head["shard"], head["hash"] = np.where(wide, name(tail), anchor), name(words.second()[index])
                head["doc"], head["text"] = ids[lo + text], hashes[lo + text]
                head["start"], head["words"] = start - words.bounds[text], length
                heads.append(head)
                tails.append(tail)
                held += len(head)
                at += len(head)
            if held >= HELD_PASSAGES:
                yield flush(heads, tails, at)
                heads, tails, held = [], [], 0
        if held:
            yield flush(heads, tails, at)

    return arrow_map(docs, run, "part int, passages binary, words binary, spans binary")


def merged(spans: np.ndarray) -> np.ndarray:
    """The same words in disjoint spans, by document."""
    if not len(spans):
        return spans
    s = spans[np.lexsort((spans["start"], spans["text"], spans["doc"]))]
    new = np.ones(len(s), bool)
    new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["text"][1:] != s["text"][:-1])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(s["end"].astype(np.int64) + group * (1 << 33))  # a running maximum in each document
    new[1:] |= s["start"][1:] > (reach[:-1] - group[:-1] * (1 << 33))
    begin = np.flatnonzero(new)
    out = s[begin]
    out["end"] = np.maximum.reduceat(s["end"], begin)
    return out


def shard_spans(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Spans of the passages of one shard, sorted by document and start, that occurred before.  tail: their words, end to end."""
    seen: dict[int, tuple[int, int]] = {}
    automaton, waiting, out, at = None, None, [], 0
    for shard_hash, doc, text, start, n in zip(*(head[k].tolist() for k in ("hash", "doc", "text", "start", "words"))):
        first = seen.get(shard_hash)
        if first is not None:
            if first < (doc, start):
                out.append((doc, text, start, start + n))
        else:
            seen[shard_hash] = (doc, start)
            sequence = tail[at : at + n].tolist()
            if waiting is not None:
                automaton = SuffixAutomaton()
                automaton.add(waiting)
                waiting = None
            if automaton is None:
                waiting = sequence
            else:
                for i, matched in enumerate(automaton.statistics(sequence)):
                    if matched >= WINDOW:
                        out.append((doc, text, start + i - WINDOW + 1, start + i + 1))
                automaton.add(sequence)
        at += n
    return np.array(out, SPAN)


def repeated_spans(packed: DataFrame, parts: int) -> DataFrame:
    """doc, text (hash), start, end: the spans of words that some earlier window has, in words."""

    def rows(spans):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans[k])) for k in ("doc", "text", "start", "end")], names=["doc", "text", "start", "end"])

    def run(batches):
        for own in by_part(batches, 0):
            heads, tails = [], []
            for _, passages, words, spans in own:
                if spans:
                    yield rows(np.frombuffer(spans, SPAN))
                else:
                    heads.append(np.frombuffer(passages, PASSAGE))
                    tails.append(np.frombuffer(words, np.uint64))
            if heads:
                yield from of_part(np.concatenate(heads), np.concatenate(tails))

    def of_part(head, tail):
        begin = np.cumsum(head["words"].astype(np.int64)) - head["words"]
        order = np.lexsort((head["start"], head["doc"], head["shard"]))
        shard = head["shard"][order]
        ends = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
        out, n = [], 0
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a > 1:
                h = head[order[a:b]]
                index = np.concatenate([np.arange(s, s + k) for s, k in zip(begin[order[a:b]].tolist(), h["words"].tolist())]) if len(np.unique(h["hash"])) > 1 else None
                found = shard_spans(h, tail[index] if index is not None else np.zeros(int(h["words"].sum()), np.uint64))
                if len(found):
                    out.append(found)
                    n += len(found)
                if n > 200_000:
                    yield rows(merged(np.concatenate(out)))
                    out, n = [], 0
        if out:
            yield rows(merged(np.concatenate(out)))

    return arrow_map(dealt(packed, parts), run, "doc long, text long, start int, end int")


def keep_words(body: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words, words removed, and the words kept joined by spaces."""
    words = body.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = bytearray(len(words))
    for start, end in spans:
        gone[start:end] = b"\x01" * (end - start)
    kept = [w for w, g in zip(words, gone) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, an integer, and text): doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A null text has no words.  A null doc_id comes after all others.  Windows that start at the same place of
    rows with equal doc_id do not count as earlier than each other, so repeated rows are
    treated alike.  Words are compared unchanged, in whole texts; other columns are not read; an
    empty table gives an empty one.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(doc.alias("doc"), F.xxhash64("text").alias("hash"), "text")
    parts = max(PARTS, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (ANCHOR_BYTES * PART)))
    found = save(repeated_anchors(rows, parts), "substrings-anchors")
    repeated, common = Filter(found, "anchor"), Filter(found.where(F.col("count") >= COMMON), "anchor")
    spans = save(repeated_spans(packed_passages(rows, repeated, common, parts), parts), "substrings-spans")
    # A document's spans are as many as its words at most.
    spans = spans.groupBy("doc", "text").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = Filter(save(spans.select("text"), "substrings-marked"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def result(ids, bodies, all_spans):
        n, gone, digests, texts = [], [], [], []
        for body, own in zip(bodies, all_spans):
            words, removed, kept = keep_words(body or b"", own)
            n.append(words)
            gone.append(removed)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if with_text else None)
        columns = [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def untouched(batches):
        for batch in batches:
            mask = pa.array(~marked.has(batch.column(1).to_numpy()))
            batch = batch.filter(mask)
            yield result(batch.column(0), batch.column(2).cast(pa.binary()).to_pylist(), [()] * batch.num_rows)

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked.has(batch.column(1).to_numpy())))

    def cut(batches):
        for batch in batches:
            own = [[(s["start"], s["end"]) for s in x or ()] for x in batch.column(2).to_pylist()]
            yield result(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), own)

    plain = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    some = arrow_map(plain, touched, f"doc_id {kind}, hash long, text string").withColumnRenamed("text", "body")
    joined = some.join(spans.hint("shuffle_hash"), (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("doc")) & (F.col("hash") == F.col("text")), "left")
    return arrow_map(plain, untouched, shape).unionByName(arrow_map(joined.select("doc_id", "body", "spans"), cut, shape))
