"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a fast Walsh-Hadamard transform; the hash is
the axis, with its sign, that the rotated vector is nearest to.  Some rotations together
give a bucket of a table, and the next best axes give further buckets to probe.  There are as many rotations as it takes
for the buckets to outnumber the vectors, so vectors that are not alike rarely meet, at any size of the table.
Vectors that meet in a bucket are compared exactly, and each pair is counted in the first table in which
it meets.  Equal vectors are one class with a weight.  A large bucket is cut into blocks, and
every two blocks are compared in a task of their own: no pair is dropped and none is
emitted, only sums for each vector and the links that hold a block together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import arrow_map, bitmap_bits, by_group, in_bitmap, key_bitmap, save, wide_hash
from .graph import components
from .textvec import mix

ship(__name__)

COSINE = 0.98
#: Tables by number of rotations (more where a single one hits more rarely), and further buckets that a vector probes in each table.
TABLES, PROBES = {2: 4, 3: 4, 4: 4, 5: 6, 6: 8}, 4
#: Buckets of a table for each vector at least, as far as rotations go.
ROOM = 32
#: Vectors of a block of a large bucket, rows compared at a time.
BLOCK, ROWS = 2048, 256
#: The next axes of a rotation that are tried, and the rotations in which a probe may differ.
DEEP, SWAPS = 3, 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, not scaled; their length is a power of 2."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


def rotate(x: np.ndarray, stream: int) -> np.ndarray:
    for turn in range(3):
        bits = mix(np.arange(x.shape[1], dtype=np.uint64) + np.uint64(1000 * (3 * stream + turn) + 1)) >> np.uint64(63)
        x = hadamard(x * (1.0 - 2.0 * bits.astype(float)))
    return x


def rotations(vectors: int, d: int) -> int:
    """The least number of rotations that gives ROOM buckets a vector."""
    axes = 2 << max(1, (d - 1).bit_length())
    return next((k for k in TABLES if axes**k >= ROOM * vectors), max(TABLES))


def codes(x: np.ndarray, turns: int) -> np.ndarray:
    """For each unit vector and table its bucket and the buckets to probe, best first: int64 of shape (n, tables, 1 + PROBES); -1 where there are no more."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    out = np.full((n, TABLES[turns], 1 + PROBES), -1, np.int64)
    rows = np.arange(n)[:, None]
    deep = min(DEEP, width)
    choices = np.array([c for c in product(range(deep), repeat=turns) if sum(map(bool, c)) <= SWAPS])
    for t in range(TABLES[turns]):
        loss, code = np.zeros((n, len(choices))), np.zeros((n, len(choices)), np.uint64)
        for r in range(turns):
            y = rotate(padded, t * turns + r)
            size = np.abs(y)
            near = np.argpartition(-size, deep - 1, axis=1)[:, :deep]
            near = near[rows, np.argsort(-size[rows, near], axis=1, kind="stable")]
            top = size[rows, near]
            loss += (((top[:, :1] - top) / top[:, :1]) ** 2)[:, choices[:, r]]
            code = mix(code + (2 * near + (y[rows, near] < 0)).astype(np.uint64)[:, choices[:, r]] + np.uint64(1))
        best = np.argsort(loss, axis=1, kind="stable")[:, : 1 + PROBES]
        out[:, t, : best.shape[1]] = (code[rows, best] >> np.uint64(1)).astype(np.int64)
    return out


def usable(embedding) -> F.Column:
    """Not null, all components finite numbers, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def units(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coded(classes: DataFrame, total: int) -> DataFrame:
    """node, label, weight, embedding -> node, label, weight, vector (bytes), codes (bytes), buckets (null where the vector has the bucket already)."""
    kind = element(classes)

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            values = column.flatten().to_numpy()
            labels = batch.column(1).to_pylist()
            n = batch.num_rows
            vectors, made, buckets = [values[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:])], [b""] * n, [None] * n
            lengths = np.diff(ends)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                c = codes(units([vectors[i] for i in rows], kind), rotations(total, d))
                where = np.array([xxhash.xxh3_64_intdigest(labels[i]) for i in rows], np.uint64)
                salt = mix(mix(where + np.uint64(d))[:, None] + np.arange(c.shape[1], dtype=np.uint64)[None, :])
                keys = mix(c.view(np.uint64) + salt[:, :, None]).view(np.int64).reshape(len(rows), -1)
                missing = c.reshape(len(rows), -1) < 0
                for i, own, key, none in zip(rows.tolist(), c, keys.tolist(), missing.tolist()):
                    made[i], buckets[i] = own.tobytes(), [None if x else k for k, x in zip(key, none)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(vectors, pa.binary()), pa.array(made, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["node", "label", "weight", "vector", "codes", "buckets"])

    return arrow_map(classes, run, "node binary, label string, weight long, vector binary, codes binary, buckets array<long>")


def element(rows: DataFrame) -> str:
    """The numpy type of the components: float where the column has floats, which lose nothing by that."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the codes (pairs, 1 + PROBES) of one table meet."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the pairs, at most n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def compare(nodes, weights, vectors, all_codes, primary, side, table: int, cosine: float, kind: str) -> Iterator[tuple]:
    """(a, b, n) rows of one bucket, or of two of its blocks where `side` holds 1 and 2: n more links of a (b null), and pairs a, b that hang together (n null)."""
    x = units(vectors, kind)
    c = np.frombuffer(b"".join(all_codes), np.int64).reshape(len(nodes), -1, 1 + PROBES)
    home = c[:, table, 0]
    sums = np.zeros(len(nodes), np.int64)
    links_i, links_j = [], []
    two = side.max() > 0
    for lo in range(0, len(nodes), ROWS):
        near = x[lo : lo + ROWS] @ x.T >= cosine
        i, j = np.nonzero(near)
        i += lo
        keep = i < j
        i, j = i[keep], j[keep]
        keep = (primary[i] | primary[j])
        if two:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        # A pair that probes each other's bucket counts in the lower one, and a pair that met in a table before counts there.
        both = primary[i] & primary[j]
        mutual = ~both & (c[i, table, 1:] == home[j][:, None]).any(axis=1) & (c[j, table, 1:] == home[i][:, None]).any(axis=1)
        here = np.where(primary[i], home[i], home[j])
        keep = (~mutual | (here == np.minimum(home[i], home[j]))) & met(c[i, table], c[j, table])
        for earlier in range(table):
            keep &= ~met(c[i, earlier], c[j, earlier])
        i, j = i[keep], j[keep]
        np.add.at(sums, i, weights[j])
        np.add.at(sums, j, weights[i])
        if len(i):
            a, b = forest(i, j, len(nodes))
            links_i.append(a)
            links_j.append(b)
    some = np.flatnonzero(sums)
    yield [nodes[i] for i in some], [None] * len(some), sums[some].tolist()
    if links_i:
        a, b = forest(np.concatenate(links_i), np.concatenate(links_j), len(nodes))
        yield [nodes[i] for i in a], [nodes[i] for i in b], [None] * len(a)


def bucket_links(found: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """a, b, n of coded() vectors: a has n links more where b is null, and a and b hang together where it is not."""
    width = 1 + PROBES
    slots = found.select(F.posexplode("buckets").alias("slot", "bucket")).where("bucket is not null")
    counts = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("slot") % width == 0).cast("int")).alias("home"))
    # A bucket that nobody has as its first brings no two vectors together.
    counts = save(counts.where("n > 1 and home = 1"), "vectors-buckets")
    bits = bitmap_bits(counts.count())
    sent = found.sparkSession.sparkContext.broadcast(key_bitmap(F.col("bucket"), counts, bits))

    def spread(batches):
        for batch in batches:
            row, slot, key = [], [], []
            lengths = batch.column(5).value_lengths().to_numpy()
            flat = batch.column(5).flatten()
            held = flat.is_valid().to_numpy(zero_copy_only=False)
            keys = flat.fill_null(0).to_numpy()
            hit = np.flatnonzero(held & in_bitmap(sent.value, keys, bits))
            begin = np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(lengths)), lengths)[hit]
            slot, key = hit - begin[row], keys[hit]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.array((slot // width).astype(np.int32)), pa.array(slot % width == 0), *(batch.column(i).take(take) for i in range(5))],
                names=["bucket", "tab", "home", "node", "label", "weight", "vector", "codes"])

    rows = arrow_map(found, spread, "bucket long, tab int, home boolean, node binary, label string, weight long, vector binary, codes binary")
    large = counts.where(F.col("n") > BLOCK).select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(large, F.col("bucket") == F.col("_bucket"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "tab", F.length("vector").alias("d"), "label", "own", "home", "node", "weight", "vector", "codes")

    def run(batches):
        key, held = None, []

        def done():
            if key is None or sum(b.num_rows for b in held) < 2:
                return
            part = pa.Table.from_batches(held)
            column = lambda name: part.column(name).to_numpy()
            side = (column("own") == key[1]).astype(np.int8) if key[1] != key[2] else np.zeros(part.num_rows, np.int8)
            vectors, bodies, nodes = (part.column(name).to_pylist() for name in ("vector", "codes", "node"))
            for a, b, n in compare(nodes, column("weight"), vectors, bodies, column("home"), side, key[3], cosine, kind):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if keys[at] != key:
                        yield from done()
                        key, held = keys[at], []
                    held.append(batch.slice(at, i - at))
                    at = i
        yield from done()

    # The whole key is compared, so buckets whose numbers are equal by chance stay apart.
    ordered = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "tab", "d", "label")
    return arrow_map(ordered, run, "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal labels, of any type, and lengths are compared.  Those with a null label,
    and null, empty or zero vectors or any with null or non-finite components, have no links and are components of their own.
    Equal vectors, repeated rows among them, are linked with each other; ties cannot arise.
    component_id is the least vec_id (null only if all are null).  Vectors are compared whole, however long; other columns are not read; an empty
    table gives an empty one.  Pairs that meet in no table are missed; the tests measure how few.
    """
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    value = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    zero = F.lit(0.0).cast("float" if single else "double")
    label = label_text(vectors)
    rows = vectors.select("vec_id", label.alias("label"), value.alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    flat = F.transform("embedding", lambda x: F.when(x == 0, zero).otherwise(x))  # -0.0 is 0.0
    rows = rows.withColumn("node", F.when(F.col("ok"), wide_hash(F.col("label"), flat)))
    slim = save(rows.select("vec_id", "node"), "vectors-nodes")
    good = rows.where("ok").select("node", "vec_id", "label", "embedding")
    classes = save(slim.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")), "vectors-classes")
    first = classes.select(F.col("node").alias("_node"), F.col("least").alias("_least"), "weight")
    reps = good.join(first, (F.col("node") == F.col("_node")) & F.col("vec_id").eqNullSafe(F.col("_least")))
    found = save(coded(reps.dropDuplicates(["node"]).select("node", "label", "weight", "embedding"), classes.count()), "vectors-coded")
    links = save(bucket_links(found, element(rows), cosine), "vectors-links")
    sums = links.where("b is null").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("others"))
    roots = components(links.where("b is not null").select("a", "b"))
    linked = save(classes.join(roots, "node").select("node", "least", "root"), "vectors-linked")
    least = save(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")), "vectors-components")
    placed = by_group(linked.select("node", "root"), least, "root", "size").select("node", "component_id")
    alone = classes.join(roots, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    table = placed.unionByName(alone).join(classes.select("node", "weight"), "node").join(sums, F.col("node") == F.col("_node"), "left")
    table = save(table.select("node", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "weight"), "vectors-table")
    joined = by_group(slim.where("node is not null"), table, "node", "weight").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    without = slim.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.unionByName(without)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def label_text(vectors: DataFrame) -> Column:
    """The label as text, equal where the labels are."""
    kind, label = vectors.schema["label"].dataType.typeName(), F.col("label")
    if kind in ("float", "double"):
        return F.when(label == 0, F.lit("0.0")).otherwise(label.cast("string"))  # -0.0 is 0.0
    if kind == "binary":
        return F.hex(label)
    return F.to_json(F.struct("label")) if kind in ("struct", "array", "map", "variant") else label.cast("string")
