"""Alignment of two tokenizers over a corpus.

The texts of an Arrow batch stand end to end as bytes, and so do the tokens of either tokenizer.  One
bincount of the ends of A's tokens and one of B's tell the bytes at which both end; there the batch is cut into
groups, and the prefix sums of the cuts, read at the documents' bounds, are the documents' numbers of groups.  A batch is a block: its
pairs of ids are numbered in a dictionary of its own, so what moves to count the pairs of the whole corpus is a row for each
pair of a block and not one for each link, and the counts come back to the block in the same way.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, save

ship(__name__)

#: Where the public tokenizers lie on the driver, and the two that are aligned.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A space where both tokenizers begin anew, characters of pieces that a worker remembers the ids of, characters encoded at a time, and bytes of text of a block, unless one text is longer.
FRESH = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
REMEMBERED, AT_ONCE, BLOCK_BYTES = 1 << 23, 1 << 18, 1 << 21
#: Bits of an id in a pair.
ID_BITS = 32


def entry_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, and the bytes and length of each of their entries."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        place = entry_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(place[c] for c in entry) if all(c in place for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.apart = not any(re.search("[^▁]▁", n) for n in names)
        self.forget()
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # What stands for a token in a document's groups: A's within and at the end of a group, then B's.
        self.shown = np.array([b"%d%s" % (i, mark) for own, marks in ((self.a_bytes, b",|"), (self.b_bytes, b",;")) for mark in (marks[:1], marks[1:]) for i in range(len(own))], object)

    def learn(self, words: list[str]) -> None:
        """Encodes pieces that are not known yet, by A with a space before them."""
        lo = 0
        while lo < len(words):
            hi, held = lo, 0
            while hi < len(words) and (hi == lo or held + len(words[hi]) <= AT_ONCE):
                held += len(words[hi])
                hi += 1
            now = words[lo:hi]
            found = [e.ids for e in self.a.encode_batch_fast([" " + w for w in now], add_special_tokens=False)], self.b.encode(now, num_threads=1)
            for side, own in enumerate(found):
                self.flat[side] = np.concatenate([self.flat[side], np.fromiter(chain.from_iterable(own), np.int32)])
                self.starts[side] = np.concatenate([self.starts[side], self.starts[side][-1] + np.cumsum([len(x) for x in own])])
            self.known_size += held
            lo = hi

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_size, self.flat, self.starts = 0, [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts, one after the other, and how many each has: by A, with a space before it, and by B.

        A text is cut before single spaces between letters or figures, which are left out, and is whole where there are none.  Neither tokenizer
        has a token across such a place: A splits there before it merges, and no entry of B has a space after another character.  So the
        pieces, each with a space before it, have the tokens of the whole, and each is encoded once.
        """
        if self.known_size > REMEMBERED:
            self.forget()
        parts = [FRESH.split(t) if self.apart else [t] for t in texts]
        new = [w for own in parts for w in own if self.known.setdefault(w, len(self.known)) >= len(self.starts[0]) - 1]
        self.learn(list(dict.fromkeys(new)))
        n = np.array([len(own) for own in parts], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        ends, out = np.concatenate([[0], np.cumsum(n)]), []
        for flat, starts in zip(self.flat, self.starts):
            size = starts[at + 1] - starts[at]
            total = np.concatenate([[0], np.cumsum(size)])
            out.append((flat[np.arange(total[-1]) + np.repeat(starts[at] - total[:-1], size)], np.diff(total[ends])))
        return out


def tokenizers_of(sent: dict) -> Pair:
    """The tokenizers of a broadcast; a worker makes them once and keeps them with it."""
    if "pair" not in sent:
        sent["pair"] = Pair(sent["a"], sent["b"])
    return sent["pair"]


@dataclass
class Aligned:
    """A batch: numbers of each document, its distinct pairs as numbers of the block's dictionary with how often, and that dictionary."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    bounds: np.ndarray
    at: np.ndarray
    times: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def align(raw: list[bytes | None], pair: Pair) -> Aligned:
    """All documents of a batch at once; `raw` has the texts in UTF-8."""
    usable = []
    for i, data in enumerate(raw):
        try:
            text = (data or b"").decode()
        except UnicodeDecodeError:
            continue
        if text:
            usable.append((i, text))
    sides, right, want = [], np.ones(len(usable), bool), [b" " + raw[i] for i, _ in usable]
    for (ids, n), own in zip(pair.encode([t for _, t in usable]), (pair.a_bytes, pair.b_bytes)):
        shown, ends = list(map(own.__getitem__, ids.tolist())), np.concatenate([[0], np.cumsum(n)]).tolist()
        right &= np.fromiter((b"".join(shown[ends[j] : ends[j + 1]]) == w for j, w in enumerate(want)), bool, len(want))
        sides.append((ids, n))
    numbers = []
    for ids, n in sides:
        of_all = np.zeros(len(raw), np.int64)
        of_all[[i for i, _ in usable]] = np.where(right, n, 0)
        numbers += [ids[np.repeat(right, n)].astype(np.int64), of_all]
    a, n_a, b, n_b = numbers
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    size = int(a_ends[-1]) if len(a) else 0
    both = (np.bincount(a_ends, minlength=size + 1) > 0) & (np.bincount(b_ends, minlength=size + 1) > 0)
    cuts = np.cumsum(both)
    # Where documents end, in tokens of A and thereby in bytes.
    ends = np.concatenate([[0], a_ends])[np.concatenate([[0], np.cumsum(n_a)])]
    n_groups = np.diff(cuts[ends])

    a_cut, b_cut = both[a_ends], both[b_ends]
    links = a[a_cut] << ID_BITS | b[b_cut]
    link_bounds = cuts[ends] - cuts[0]
    pairs, place, counts = np.unique(links, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(raw)), np.diff(link_bounds))
    own, times = np.unique(of * max(len(pairs), 1) + place, return_counts=True)
    bounds = np.searchsorted(own, np.arange(len(raw) + 1) * max(len(pairs), 1))

    # The tokens in the order of groups, in each of them A's before B's.
    a_group, b_group = cuts[a_ends] - a_cut, cuts[b_ends] - b_cut
    total = int(cuts[-1])
    a_in, b_in = np.bincount(a_group, minlength=total), np.bincount(b_group, minlength=total)
    first = np.cumsum(a_in + b_in) - (a_in + b_in)
    order = np.empty(len(a) + len(b), np.int64)
    order[first[a_group] + np.arange(len(a)) - (np.cumsum(a_in) - a_in)[a_group]] = a + len(pair.a_bytes) * a_cut
    order[(first + a_in)[b_group] + np.arange(len(b)) - (np.cumsum(b_in) - b_in)[b_group]] = 2 * len(pair.a_bytes) + b + len(pair.b_bytes) * b_cut
    groups, lo = [], 0
    for n in (n_a + n_b).tolist():
        groups.append(b"".join(pair.shown[order[lo : lo + n]])[:-1])
        lo += n
    return Aligned(n_a, n_b, n_groups, np.diff(link_bounds), groups, bounds, own % max(len(pairs), 1), times, pairs, counts)


def blocks(docs: DataFrame, sent) -> DataFrame:
    """A row for each document, with its block and the numbers of its pairs, and one for each block, with its dictionary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, counts array<long>"

    def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers_of(sent.value)
        number = 0
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            lo = 0
            while lo < len(raw):
                hi, held = lo, 0
                while hi < len(raw) and (hi == lo or held + len(raw[hi] or b"") <= BLOCK_BYTES):
                    held += len(raw[hi] or b"")
                    hi += 1
                found, n = align(raw[lo:hi], pair), hi - lo
                block = TaskContext.get().partitionId() << 32 | number
                number += 1
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * n, pa.int64()), batch.column(0).slice(lo, n), *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(digests, pa.string()),
                    lists(found.at, found.bounds, pa.int32()), lists(found.times, found.bounds, pa.int32()), none, none], names=names)
                if len(found.pairs):
                    one = [0, len(found.pairs)]
                    empty = [pa.nulls(1, f) for f in (batch.column(0).type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *empty, lists(found.pairs, one, pa.int64()), lists(found.counts, one, pa.int64())], names=names)
                lo = hi

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "counts"]
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum for the documents of blocks; each block's counts come before its documents."""
    block, count, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        numbers, at, times, n = batch.column(0).to_pylist(), batch.column(8), batch.column(9), batch.num_rows
        n_best, total, keep = np.zeros(n, np.int64), np.zeros(n, np.int64), np.array(batch.column(1).to_pylist(), bool)
        for i in range(n):
            if not keep[i]:
                block = numbers[i]
                count, best = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (10, 11))
            elif numbers[i] == block and len(at[i]):
                own, often = at[i].values.to_numpy(), times[i].values.to_numpy()
                n_best[i], total[i] = (best[own] * often).sum(), (count[own] * often).sum()
        yield pa.RecordBatch.from_arrays([*batch.columns[2:7], pa.array(n_best), pa.array(total), batch.column(7)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]).filter(pa.array(keep))


@dataclass
class Alignment:
    """documents: a row for each document; pairs: a_id, b_id, count and whether no id of A has a higher count with that id of B."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> Alignment:
    """Encodes the texts of `docs` (doc_id, text) by two tokenizers and links the tokens that end together.

    A null or empty text, one that is no valid UTF-8 and one whose tokens' bytes are not those of a space and the text has no tokens: zeros and ''.
    Whole texts are encoded; a long one is cut only where both tokenizers begin anew.  Repeated rows count and return each; ties of the highest
    count are all best; other columns are not read; an empty table gives empty ones.  The tokenizers' files are read by the
    driver and broadcast, 2 MB in all.
    """
    spark = docs.sparkSession
    files = {}
    for side, name in (("a", a_file), ("b", b_file)):
        with open(f"{folder}/{name}", "rb") as f:
            files[side] = f.read()
    rows = save(blocks(docs, spark.sparkContext.broadcast(files)), "alignment")
    entries = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "e")).select("block", "place", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    totals = entries.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    highest = totals.groupBy("b_id").agg(F.max("count").alias("highest"))
    known = save(totals.join(highest, "b_id").select("pair", F.shiftright("pair", ID_BITS).alias("a_id"), "b_id", "count", (F.col("count") == F.col("highest")).alias("best")), "alignment-pairs")
    # A block has as many entries as its texts, of a bounded size, have different links.
    back = entries.join(known.select("pair", "count", "best"), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", F.col("best").cast("int").alias("best")))).alias("e"))
    back = save(back.select("block", F.col("e.count").alias("count"), F.col("e.best").alias("best")), "alignment-blocks")
    of_docs = rows.where("pairs is null").select("block", F.lit(True).alias("is_doc"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    both = of_docs.unionByName(back.withColumn("is_doc", F.lit(False)), allowMissingColumns=True)
    placed = both.repartition("block").sortWithinPartitions("block", "is_doc")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = arrow_map(placed, totalled, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return Alignment(found, known.drop("pair"))
