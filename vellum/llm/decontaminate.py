"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the test items: 13 consecutive words, or the whole
item where it is shorter.  Patterns of one length m share a searcher.  It looks at
the block of B words that ends a position: the shift table says how far the search
may move on because no pattern has that block nearer its end, and m - B + 1 for
a block that no pattern has.  At shift 0 the suffix bucket of the block lists the
patterns that end in it, and these are compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, unused

ship(__name__)

WINDOW = 13
#: Bytes of item text that one broadcast holds, whose searchers take some 60 times as much in a worker; a larger benchmark is searched in several passes of this size.
BLOCK_BYTES = 4_000_000
#: A-Z to a-z and what is not part of a word to a space, by byte; UTF-8 bytes above 0x7F are parts of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text in lower case."""
    return text.translate(FOLD).split()


class WuManber:
    """Finds every occurrence of word sequences of one length m: those of `flat` that begin at `starts`, in the items of `owners`."""

    def __init__(self, flat: list[bytes], starts: list[int], owners: list[str], length: int):
        self.m, self.b = length, min(2, length)
        self.default = length - self.b + 1
        self.flat, self.shift, self.bucket = flat, {}, {}
        for start, owner in zip(starts, owners):
            for end in range(self.b, length + 1):
                block = self.block(flat, start + end)
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.bucket.setdefault(block, []).extend((start, owner))

    def block(self, seq, end: int):
        return seq[end - 1] if self.b == 1 else (seq[end - 2], seq[end - 1])

    def search(self, seq: list[bytes]) -> Iterator[tuple[int, str]]:
        """(end position, item) of each occurrence, from left to right."""
        m, shift, default, bucket, flat = self.m, self.shift.get, self.default, self.bucket, self.flat
        end, n = m, len(seq)
        if self.b == 1:
            for end in range(1, n + 1):
                for item in bucket.get(seq[end - 1], ())[1::2]:
                    yield end, item
            return
        while end <= n:
            key = (seq[end - 2], seq[end - 1])
            move = shift(key, default)
            if move:
                end += move
                continue
            window, held = seq[end - m : end], bucket[key]
            for start, item in zip(held[::2], held[1::2]):
                if flat[start : start + m] == window:
                    yield end, item
            end += 1


def searchers(items: list[tuple[str, bytes]]) -> list[WuManber]:
    """One for each length of window; words, items' texts and windows are held once."""
    same: dict[bytes, bytes] = {}
    flat: list[bytes] = []
    by_length: dict[int, tuple[list[int], list[str]]] = {}
    for item, text in items:
        seq = [same.setdefault(w, w) for w in words(text)]
        m = min(WINDOW, len(seq))
        starts, owners = by_length.setdefault(m, ([], []))
        n = len(seq) - m + 1 if m else 0
        starts.extend(range(len(flat), len(flat) + n))
        owners.extend([item] * n)
        flat += seq
    return [WuManber(flat, *found, m) for m, found in sorted(by_length.items()) if m]


def made(block: dict) -> list[WuManber]:
    """The searchers of a broadcast block; a worker that has got the broadcast makes them once and keeps them with it.

    A block is a plain dict, so that workers without this package can read it.
    """
    if "searchers" not in block:
        block["searchers"] = searchers(block["items"])
    return block["searchers"]


def find(seq: list[bytes], machines: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of hit words, disjoint and in order, and the items that occur."""
    spans, items = [], set()
    for machine in machines:
        for end, which in machine.search(seq):
            spans.append((end - machine.m, end))
            items.add(which)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, int, str, bool]:
    n_hit = sum(e - s for s, e in spans)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items, at most about `block_bytes` of text at a time; null ids count as "" and null texts have no words."""
    block, held = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("body")).toLocalIterator():
        body = row["body"].encode()
        if block and held + len(body) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["item"], body))
        held += len(body)
    yield block


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that find_contamination() does not call contaminated, with columns of any name."""
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return find_contamination(docs, benchmark, prefix=prefix).where(~F.col(prefix + "contaminated")).select(*docs.columns)


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated (and hit_spans, in words), `prefix` before each name.

    One row per row of `docs`, its other columns kept; columns of the names above are
    replaced, so choose a `prefix` that none begins with.  A null or empty text has no words and nothing is found in it; an item without words has no window; items of
    equal id count once; repeated rows are searched each; an empty table gives an empty one.  Whole texts are searched, however long.  A benchmark above `block_bytes` is
    searched block by block; what a pass finds is carried on to the next one in the row.
    """
    kinds_of = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "hit_spans": "array<int>"}
    added = {prefix + name: kind for name, kind in kinds_of.items()}
    names = [c for c in docs.columns if c not in added]
    result = docs.select(*names)
    spark = docs.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema)
    held = unused(result, "spans_so_far", "items_so_far")
    state = f"`{held[0]}` array<int>, `{held[1]}` array<string>"
    found = ", ".join(f"`{name}` {kind}" for name, kind in added.items())
    place = names.index("text")
    # The driver holds two blocks at a time; broadcasts keep the others on disk.
    blocks = item_blocks(benchmark, block_bytes)
    block, first, last = next(blocks), True, False
    while not last:
        following = next(blocks, None)
        sent, last = spark.sparkContext.broadcast({"items": block}), following is None

        def run(batches, sent=sent, first=first, last=last):
            machines = made(sent.value)
            for batch in batches:
                texts = batch.column(place).cast(pa.binary())
                kept = batch.columns if first else batch.columns[:-2]
                before = None if first else (batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
                rows = []
                for j, text in enumerate(texts):
                    seq = words(text.as_py() or b"")
                    spans, items = find(seq, machines)
                    if before:
                        flat = before[0][j]
                        spans, items = merged([*zip(flat[::2], flat[1::2]), *spans]), items | set(before[1][j])
                    flat = [x for span in spans for x in span]
                    rows.append((*verdict(len(seq), spans, items), flat) if last else (flat, sorted(items)))
                if last:
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.int32())]
                    titles = list(added)
                else:
                    kinds, titles = [pa.list_(pa.int32()), pa.list_(pa.string())], held
                more = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
                yield pa.RecordBatch.from_arrays([*kept, *more], names=[*names, *titles])

        result = arrow_map(result, run, f"{fields}, {found if last else state}")
        block, first = following, False
    return result
