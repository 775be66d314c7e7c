"""Vector codes: one byte for each part of a vector, the number of the nearest entry of the part's codebook.

Everything is integer arithmetic.  For each part position the entries form a vantage-point tree: a node's entry is the vantage point, its radius
the median distance of the others, which lie inside or outside.  A search goes through the tree with all parts at once, each time with those
that the triangle inequality does not turn away.  It knows distances only as whole numbers below and above the roots of the squared
distances and turns a part away only where these are strictly apart, so an entry at the least distance is always visited; which entry
is nearest is decided by the squared distances themselves, ties by the lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, by_group, save
from .vectors import label_text

ship(__name__)

#: Parts of a vector, entries of a codebook, rounds, and what a component of 1 becomes.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this in size have squared distances, and sums of a batch, in 64 bits; others are Python's integers.
SMALL = 1 << 26
#: Bits of a piece of a sum; the pieces are added up by Spark and put together by the driver.
LIMB = 31
LARGEST = (1 << 63) - 1


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite doubles, exactly."""
    if not values.size or np.abs(values).max() * SCALE < SMALL:
        return np.floor(values * SCALE).astype(np.int64)  # a power of 2 times a double is exact
    out = np.empty(values.shape, object)
    out.ravel()[:] = [n * SCALE // d for n, d in map(float.as_integer_ratio, values.ravel().tolist())]
    return out


def below(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the roots and less than 2 under them."""
    if squares.dtype == object:
        return np.array([isqrt(s) for s in squares.tolist()], object)
    return np.maximum(np.sqrt(squares.astype(float)).astype(np.int64) - 1, 0)


def above(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not under the roots."""
    return below(squares) + (1 if squares.dtype == object else 3)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=1)


@dataclass
class Vantage:
    """A node: the entry's number, the radius as whole numbers below and above it, and the entries inside and outside."""

    entry: int
    low: int = 0
    high: int = 0
    inside: Vantage | None = None
    outside: Vantage | None = None


def tree(entries: np.ndarray, of: list[int]) -> Vantage | None:
    """Of the entries numbered `of`; the first is the vantage point."""
    if not of:
        return None
    node, others = Vantage(of[0]), of[1:]
    if others:
        far = squared(entries[others], entries[node.entry])
        order = sorted(range(len(others)), key=lambda i: (far[i], others[i]))
        half = (len(others) - 1) // 2
        radius = far[order[half] : order[half] + 1]
        node.low, node.high = below(radius)[0], above(radius)[0]
        node.inside = tree(entries, [others[i] for i in order[: half + 1]])
        node.outside = tree(entries, [others[i] for i in order[half + 1 :]])
    return node


def nearest(x: np.ndarray, entries: np.ndarray, root: Vantage) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of `x` the number of the nearest entry and the squared distance; and the distances that were computed."""
    number = np.full(len(x), -1)
    least = np.zeros(len(x), x.dtype)
    seen = 0

    def visit(node: Vantage | None, rows: np.ndarray) -> None:
        nonlocal seen
        if node is None or not len(rows):
            return
        seen += len(rows)
        far = squared(x[rows], entries[node.entry])
        better = (number[rows] < 0) | (far < least[rows]) | ((far == least[rows]) & (node.entry < number[rows]))
        better = better.astype(bool)
        number[rows[better]], least[rows[better]] = node.entry, far[better]
        if node.inside is None and node.outside is None:
            return
        low, high = below(far), above(far)
        near = (low + high < node.low + node.high).astype(bool)
        # Inside all are at most the radius from the vantage point, outside at least; the bound is taken anew before the second child.
        for first in (True, False):
            for child, side in ((node.inside, near == first), (node.outside, near != first)):
                bound = above(least[rows])
                room = low <= node.high + bound if child is node.inside else high + bound >= node.low
                visit(child, rows[side & room.astype(bool)])

    visit(root, np.arange(len(x)))
    return number, least, seen


class Codebooks:
    """The entries of each part position, parts by entries by components, and their trees."""

    def __init__(self, entries: list[np.ndarray]):
        wide = any(e.dtype == object or (e.size and np.abs(e).max() >= SMALL) for e in entries)
        self.entries = [e.astype(object) if wide else e for e in entries]
        self.trees = [tree(e, list(range(len(e)))) for e in self.entries]

    def assign(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part position the numbers and squared distances of the rows of `x`."""
        parts = [x[:, lo:hi] for lo, hi in bounds(x.shape[1])]
        return [nearest(*((p.astype(object), e.astype(object)) if p.dtype == object or e.dtype == object else (p, e)), t)[:2] for p, e, t in zip(parts, self.entries, self.trees)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for e in self.entries for row in e.tolist() for c in row).encode()).hexdigest()


def bounds(width: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; the first are longer by one where they can't be equal."""
    edges = [sum(len(p) for p in np.array_split(np.arange(width), PARTS)[:i]) for i in range(PARTS + 1)]
    return list(zip(edges[:-1], edges[1:]))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """`value` as a sum of pieces times powers of 2 ** LIMB, each with the sign of the whole."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], list[int]]:
    """For each part position and entry the count of its parts and the sums of their components.

    A task adds up its own rows, so the driver gets a bounded number of sums, however many rows there are.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        now, total = Codebooks(sent.value), {}
        for batch in batches:
            x = scaled(matrix(batch.column(0)))
            if not len(x):
                continue
            for p, ((number, _), (lo, hi)) in enumerate(zip(now.assign(x), bounds(x.shape[1]))):
                for k in np.unique(number).tolist():
                    own = x[number == k, lo:hi]
                    held = total.setdefault((p, k), [0] * (hi - lo + 1))
                    for i, v in enumerate([len(own), *own.sum(axis=0).tolist()]):
                        held[i] += int(v)
        rows = [(p, k, i, place, v) for (p, k), held in total.items() for i, value in enumerate(held) for place, v in limbs(value)]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())], names=["part", "entry", "at", "place", "value"])

    parts = arrow_map(vectors.select("embedding"), run, "part int, entry int, at int, place int, value long")
    edges = bounds(sum(e.shape[1] for e in books.entries))
    out: dict[tuple[int, int], list[int]] = {}
    for row in parts.groupBy("part", "entry", "at", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        lo, hi = edges[row["part"]]
        held = out.setdefault((row["part"], row["entry"]), [0] * (hi - lo + 1))
        held[row["at"]] += int(row["value"]) << (LIMB * row["place"])
    return out


def first_books(vectors: DataFrame) -> Codebooks | None:
    """From the vectors of the 16 least vec_ids; of several with one vec_id the least vector, null vec_ids last.  None without a vector."""
    ids = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES)
    rows = [r["embedding"] for r in ids.collect()]
    if not rows:
        return None
    x = scaled(np.array(rows, float))
    return Codebooks([x[:, lo:hi] for lo, hi in bounds(x.shape[1])])


def trained(vectors: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all of `vectors` (vec_id, embedding of equal lengths): a job for each round."""
    books = first_books(vectors)
    for _ in range(rounds if books else 0):
        new = [e.astype(object) for e in books.entries]
        for (p, k), (n, *total) in sums(vectors, books).items():
            new[p][k] = np.array([t // n for t in total], object)
        wide = any(abs(c) >= SMALL for e in new for c in e.ravel().tolist())
        books = Codebooks(new if wide else [e.astype(np.int64) for e in new])
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label) that can be coded: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so are those of another
    length than the vector of the least vec_id.  A length that 8 does not divide makes the first parts longer by one; without as many as 16
    vec_ids the codebooks are smaller.  Repeated rows are coded each; distances that tie go to the lower entry.  Labels of any type may be null, and
    nulls count as one label.  Components of any size are exact; an error beyond the largest long is that.  Other columns are not read; an empty table
    gives an empty one.
    """
    label = F.coalesce(F.concat(F.lit("="), label_text(vectors)), F.lit("null"))
    value = F.col("embedding").cast("array<double>")
    finite = ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = save(vectors.select("vec_id", value.alias("embedding"), label.alias("label"), (F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(finite, F.lit(False))).alias("ok")).where("ok").drop("ok"), "vectors-kept")
    width = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding").alias("d")).first()
    alike = kept.where(F.size("embedding") == (width["d"] if width else 0))
    books = trained(alike, rounds)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    sent, kind, digest = kept.sparkSession.sparkContext.broadcast(books.entries), kept.schema["vec_id"].dataType.simpleString(), books.digest()

    def run(batches):
        now = Codebooks(sent.value)
        for batch in batches:
            x = scaled(matrix(batch.column(2)))
            found = now.assign(x) if len(x) else []
            codes = ["".join("%02x" % k for k in row) for row in zip(*(number.tolist() for number, _ in found))]
            errors = [min(sum(row), LARGEST) for row in zip(*(least.tolist() for _, least in found))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = save(arrow_map(alike.select("vec_id", "label", "embedding"), run, f"vec_id {kind}, label string, code string, error long"), "vectors-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = save(coded.groupBy("label").agg(F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "vectors-labels")
    return by_group(coded, labels, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
