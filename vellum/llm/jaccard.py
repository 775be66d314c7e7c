"""Jaccard join of documents on word shingles: a grouped prefix join.

Documents with the same set are one class.  All sets are ordered alike, frequent
shingles last, and two sets that are similar enough share a shingle in their
prefixes.  Classes with the same prefix and size form one group, so a prefix is
sent out once per group; lists of groups by shingle give group pairs, which size, position
and parity-bitmap filters reduce; what is left is expanded into members, whose whole
sets are compared.

A list of many groups is not expanded into all pairs.  In the first round its groups are
compared with the most connected one of like size only; what links then hangs together.  The second
round goes through all pairs that the first has left apart, so no component is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ship
from .base import Filter, arrow_map, by_group, by_part, dealt, save, unused, wide_hash
from .graph import components
from .textvec import LOWER, SPACED, Texts, Words, distinct_in_rows, mix, wide, wide_array

ship(__name__)

SHINGLE = 5
#: Shingles counted together in a task; those that come twice there are reported as frequent.
COUNTED = 2_000_000
#: Frequent shingles that are put last at most, and the reported count from which: any choice is right, this one is fast.
FREQUENT, FREQUENT_FROM = 1_000_000, 8
#: Prefix shingles of a part of the lists, and parts at least.
PART, PARTS = 1_500_000, 64
#: Pairs of one class that a task compares at least.
SPOKES = 256
BAND = float(np.log(4 / 3))


def overlap_needed(n: Column, m: Column) -> Column:
    """Least common shingles for 100 * common >= 75 * union."""
    return F.floor((3 * (n + m) + 6) / 7)


def class_ids(values: np.ndarray, bounds: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bytes for each text: a hash of its set, and one of all its shingles, with repetitions, by other hashes of the words.

    Texts of one class surely have one set; a set may have several classes, which the join then links.
    """
    def sums(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    return wide(sums(values, bounds), sums(grams, at))


def sets_of(column: pa.Array, named: bool = True):
    """(first row, values, bounds, class ids if `named`) of runs of rows."""
    for lo, _, data, offsets in Texts(column).chunks():
        words = Words(data, offsets, SPACED, LOWER)
        values, bounds = distinct_in_rows(*words.grams(SHINGLE))
        yield lo, values, bounds, class_ids(values, bounds, *words.grams(SHINGLE, words.second())) if named else None


def classify(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, cid and text_hash of each document; kind 1: n sightings of a frequent shingle, the token."""

    def frequent(parts: list[np.ndarray], at: pa.DataType):
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        found, counts = found[counts > 1], counts[counts > 1]
        k = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int32)), pa.nulls(k, at), pa.array(counts.astype(np.int64)), pa.nulls(k, pa.binary()), pa.array(found.view(np.int64)), pa.nulls(k, pa.binary())],
            names=["kind", "doc_id", "n", "cid", "token", "text_hash"])

    def run(batches):
        seen, parts, held, at = set(), [], 0, None
        for batch in batches:
            at = batch.column(0).type
            ns, cids, k = [], [], batch.num_rows
            for _, values, bounds, ids in sets_of(batch.column(1)):
                n = np.diff(bounds)
                ns.append(n)
                cids.append(ids)
                listed = ids.tolist()
                new = np.array([i not in seen for i in listed], bool)
                seen.update(listed)
                parts.append(values[np.repeat(new, n)])
                held += len(parts[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), batch.column(0), pa.array(np.concatenate(ns) if ns else [], pa.int64()), wide_array(np.concatenate(cids) if cids else np.zeros(0, "V16")),
                 pa.nulls(k, pa.int64()), batch.column(2)], names=["kind", "doc_id", "n", "cid", "token", "text_hash"])
            if held >= COUNTED:
                yield frequent(parts, at)
                seen, parts, held = set(), [], 0
        if held:
            yield frequent(parts, at)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text", wide_hash(F.col("text")).alias("text_hash")), run, f"kind int, doc_id {kind}, n long, cid binary, token long, text_hash binary")


def parity(values: np.ndarray) -> bytes:
    """The number of shingles in 8 bytes, then a bitmap whose bit i is the parity of the number of shingles that fall on i; its bits are the power of 2 that the size calls for."""
    bits = 64
    while bits < len(values):
        bits *= 2
    return len(values).to_bytes(8, "little") + np.packbits(np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def possible(x: bytes, y: bytes) -> bool:
    """Whether two maps of parity() leave enough common shingles possible."""
    n, m = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
    return 7 * differing(x[8:], y[8:]) <= n + m


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


ENTRY = np.dtype([("token", "<i8"), ("gid", "<i8"), ("pos", "<u2")])
MEMBER = np.dtype([("cid", "V16"), ("gid", "<i8"), ("n", "<i8")])


def prefixes(docs: DataFrame, frequent: DataFrame, parts: int) -> DataFrame:
    """kind, part, entries, maps: packed prefixes and members of a task's classes.

    kind 0 has entries of rare shingles by part; kind 1 entries of frequent ones, which
    surely have lists; kind 2 members and their bitmaps.
    """
    rows = frequent.toArrow()
    tokens, counts = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    sent = docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))

    def run(batches):
        hot, weight = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            cold, warm, members, maps = [], [], [], []
            for _, values, bounds, ids in sets_of(batch.column(1)):
                signed = values.view(np.int64)
                place = np.minimum(np.searchsorted(hot, signed), max(len(hot) - 1, 0))
                is_hot = hot[place] == signed if len(hot) else np.zeros(len(signed), bool)
                rank = np.where(is_hot, weight[place], 0) if len(hot) else np.zeros(len(signed), np.int64)
                for cid, lo, hi in zip(ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = hi - lo
                    if not n or cid in seen:
                        continue
                    seen.add(cid)
                    p = n - (3 * n + 3) // 4 + 1
                    own, marks = signed[lo:hi], is_hot[lo:hi]
                    if marks.any():
                        own_rank = rank[lo:hi]
                        first = np.argsort(own_rank, kind="stable")[:p]
                        own, marks = own[first], marks[first]
                    else:
                        own, marks = own[:p], marks[:p]
                    # The prefix and the size name the group.
                    total = (mix(own.view(np.uint64) + np.arange(p, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))).sum(dtype=np.uint64)
                    gid = int(mix(np.array([total + np.uint64(n)]))[0].view(np.int64))
                    entry = np.empty(p, ENTRY)
                    entry["token"], entry["gid"], entry["pos"] = own, gid, np.minimum(np.arange(p), 65535)
                    cold.append(entry[~marks])
                    warm.append(entry[marks])
                    members.append((cid, gid, n))
                    maps.append(parity(values[lo:hi]))
            out = []
            if members:
                cold = np.concatenate(cold)
                part = (cold["token"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                cold = cold[order]
                out += [(0, i, cold[a:b].tobytes(), None) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
                warm = np.concatenate(warm)
                if len(warm):
                    out.append((1, int(warm["gid"][0] % parts), warm.tobytes(), None))
                out.append((2, int(members[0][1] % parts), np.array(members, MEMBER).tobytes(), maps))
            columns = [*zip(*out)] if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.binary()))], names=["kind", "part", "entries", "maps"])

    return arrow_map(docs.select("doc_id", "text"), run, "kind int, part int, entries binary, maps array<binary>")


def shared_lists(packed: DataFrame, parts: int) -> DataFrame:
    """kind 1: token, gid, value (place) of shingles that several groups have; kind 2: cid, gid, value (size), map of members."""

    def rows(kind, gid, value, token=None, cid=None, maps=None):
        k = len(gid)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(k, kind, np.int32)), pa.nulls(k, pa.int64()) if token is None else pa.array(np.ascontiguousarray(token)), pa.nulls(k, pa.binary()) if cid is None else wide_array(cid),
            pa.array(np.ascontiguousarray(gid)), pa.array(value.astype(np.int64)), pa.nulls(k, pa.binary()) if maps is None else pa.array(maps, pa.binary())],
            names=["kind", "token", "cid", "gid", "value", "map"])

    def run(batches):
        for own in by_part(batches, 1):
            held = []
            for kind, _, entries, maps in own:
                if kind == 0:
                    held.append(np.frombuffer(entries, ENTRY))
                elif kind == 1:
                    e = np.frombuffer(entries, ENTRY)
                    yield rows(1, e["gid"], e["pos"], token=e["token"])
                else:
                    m = np.frombuffer(entries, MEMBER)
                    yield rows(2, m["gid"], m["n"], cid=m["cid"], maps=maps)
            if held:
                yield from shared(np.concatenate(held))

    def shared(e):
        e = e[np.argsort(e["token"], kind="stable")]
        token, gid = e["token"], e["gid"]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        apart = np.maximum.reduceat(gid, begin) != np.minimum.reduceat(gid, begin)  # copies in other tasks are the same group
        keep = np.repeat(apart, np.diff(np.append(begin, len(e))))
        for at in range(0, len(e), 500_000):
            some = e[at : at + 500_000][keep[at : at + 500_000]]
            yield rows(1, some["gid"], some["pos"], token=some["token"])

    return arrow_map(dealt(packed, parts), run, "kind int, token long, cid binary, gid long, value long, map binary")


def met_by_hub(pairs: DataFrame, items: DataFrame, prepare, test) -> DataFrame:
    """The `pairs` (a, b; distinct, from a written table) for whose `items` (node, value) `test` holds; `prepare` makes a list of comparable objects of a column of values.

    The pairs of one `a` are dealt to as many tasks as it has SPOKES of them.  Its value goes to each of
    these once, that of every `b` follows, so a task holds one value and a batch, and nothing moves once a pair but the
    value of b.
    """
    degree = save(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "jaccard-degrees")
    routed = by_group(pairs, degree, "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SPOKES)).cast("int").alias("salt"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / SPOKES) - 1).cast("int"))).alias("salt"))
    hubs = hubs.join(items, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "value")
    spokes = routed.join(items, F.col("b") == F.col("node")).select("a", "salt", "b", "value")
    rows = hubs.unionByName(spokes).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        hub = None
        for batch in batches:
            others, keep = batch.column(2), []
            for is_hub, own in zip(others.is_null().to_pylist(), prepare(batch.column(3))):
                if is_hub:
                    hub = own
                keep.append(not is_hub and test(hub, own))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), others.filter(mask)], names=["a", "b"])

    return arrow_map(rows, run, "a long, b long")


def narrowed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b of node) that the bitmaps leave possible."""
    return met_by_hub(save(pairs, "jaccard-met"), members.select("node", F.col("map").alias("value")), lambda column: column.to_pylist(), possible)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, value (the text) of the classes in `wanted` (node, cid), once each; a bitmap of bounded size spares moving other texts."""
    wanted = save(wanted.select("node", "cid", first_bytes(F.col("cid")).alias("head")), "jaccard-wanted")
    heads_held = Filter(wanted, "head")

    def run(batches):
        seen = set()
        for batch in batches:
            rows, cids = [], []
            for lo, _, _, ids in sets_of(batch.column(0)):
                heads = ids.view("<i8").reshape(-1, 2)[:, 0] >> HEAD_SHIFT
                for i in np.flatnonzero(heads_held.has(heads)).tolist():
                    cid = ids[i].item()
                    if cid not in seen:
                        seen.add(cid)
                        rows.append(lo + i)
                        cids.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["cid", "value"])

    return arrow_map(docs.select("text"), run, "cid binary, value string").dropDuplicates(["cid"]).join(wanted, "cid").select("node", "value")


#: The part of a class id that first_bytes() leaves.
HEAD_SHIFT = 8


def first_bytes(cid: Column) -> Column:
    """Bytes 2 to 8 of a class id as a number: the first of its two little-endian numbers, shifted by HEAD_SHIFT bits."""
    number = F.conv(F.concat(*[F.hex(F.substring(cid, i, 1)) for i in range(8, 1, -1)]), 16, 10).cast("long")
    return F.when(number >= 1 << 55, number - (1 << 56)).otherwise(number)


def set_list(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, values, bounds, _ in sets_of(column, named=False):
        out += [values[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b of node; from a written table) whose whole sets are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = save(texts_of(docs, members.select("node", "cid").join(ends, "node", "left_semi")), "jaccard-texts")
    return met_by_hub(pairs, texts, set_list, similar)


def similar_links(docs: DataFrame, classes: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b of node) that join every component of similar classes, and node, cid of all classes.

    A node is a number that a class gets when the members are written; from then on it is what the files say.
    """
    total = classes.agg(F.sum((F.col("n") / 4 + 1).cast("long"))).first()[0] or 0
    parts = max(PARTS, -(-total // PART))
    found = save(shared_lists(prefixes(docs, frequent, parts), parts), "jaccard-lists")
    members = found.where("kind = 2").select("cid", "gid", F.col("value").alias("n"), "map").dropDuplicates(["cid"])
    members = save(members.withColumn("node", F.monotonically_increasing_id()), "jaccard-members")
    # Members of a group have one size, but for groups whose names collide.
    groups = members.groupBy("gid").agg(F.min("node").alias("rep"), F.min("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("size"))
    lists = found.where("kind = 1").groupBy("token", "gid").agg(F.min("value").alias("pos"))
    lists = save(lists.join(groups, "gid").select("token", "gid", "rep", "n", "most", "pos", F.floor(F.log("n") / BAND).cast("int").alias("band")), "jaccard-groups")
    fits = lambda n, m: 4 * F.least(n, m) >= 3 * F.greatest(n, m)

    # First round: the most connected group of each list and size band against the others near its size.
    degree = lists.join(lists.groupBy("token").count(), "token").groupBy("gid").agg(F.sum("count").alias("degree"))
    leaders = lists.join(degree, "gid").groupBy("token", "band").agg(F.max(F.struct("degree", "gid", "rep", "n")).alias("lead"))
    near = leaders.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "lead")
    pairs = lists.join(near, ["token", "band"]).where((F.col("gid") != F.col("lead.gid")) & fits(F.col("n"), F.col("lead.n")))
    star = members.join(groups.where("size > 1").select("gid", "rep"), "gid").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    led = pairs.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
    first = save(verified(save(narrowed(led.unionByName(star).distinct(), members), "jaccard-pairs"), members, docs), "jaccard-links")

    # Second round: all pairs that are still apart.
    roots = save(components(first), "jaccard-roots")
    placed = save(members.join(roots, "node", "left").select("node", "gid", F.coalesce("root", "node").alias("root")), "jaccard-placed")
    parted = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rest = lists.join(parted, "gid")
    mixed = rest.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("greatest")).where("least != greatest").select("token")
    rest = rest.join(mixed, "token", "left_semi")
    x = rest.select("token", *[F.col(c).alias(f"{c}1") for c in ("gid", "n", "most", "pos", "low", "high")])
    y = rest.select("token", *[F.col(c).alias(f"{c}2") for c in ("gid", "n", "most", "pos", "low", "high")])
    need = overlap_needed(F.col("n1"), F.col("n2"))
    apart = (F.least("low1", "low2") != F.greatest("high1", "high2"))
    met = x.join(y, "token").where((F.col("gid1") < F.col("gid2")) & apart & (4 * F.col("most1") >= 3 * F.col("n2")) & (4 * F.col("most2") >= 3 * F.col("n1"))
                                   & (F.col("pos1") <= F.col("most1") - need) & (F.col("pos2") <= F.col("most2") - need))
    met = met.select("gid1", "gid2").distinct().unionByName(parted.where("low != high").select(F.col("gid").alias("gid1"), F.col("gid").alias("gid2")))
    one, two = (placed.select(F.col("gid").alias(f"gid{i}"), F.col("node").alias(f"node{i}"), F.col("root").alias(f"root{i}")) for i in (1, 2))
    wide_pairs = met.join(one, "gid1").join(two, "gid2").where("root1 != root2 and (gid1 != gid2 or node1 < node2)")
    wide_pairs = wide_pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    second = verified(save(narrowed(wide_pairs, members), "jaccard-pairs"), members, docs)
    return first.unionByName(second), members.select("node", "cid")


def join_similar(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, root (of the component, null without words) and text_hash.

    Texts without words and null texts have no shingles and are linked with nothing;
    copies and repeated rows are of one class.  component_id is the least doc_id of
    the component (null only if all of its are null); whole texts are compared, however long, other columns are not
    read, and an empty table gives an empty one.  Ties cannot arise: a link is a matter of two sets.
    """
    found = save(classify(docs), "jaccard-classes")
    rows = found.where("kind = 0").select("doc_id", "n", "cid", "text_hash")
    classes = save(rows.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "jaccard-least")
    frequent = found.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "token").limit(FREQUENT)
    links, members = similar_links(docs.select("doc_id", "text"), classes, frequent)
    roots = components(links)
    placed = save(classes.join(members, "cid").join(roots, "node", "left").select("cid", "node", "root", "least", F.col("rows").alias("size")), "jaccard-placed")
    linked = placed.where("root is not null")
    least = save(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "jaccard-roots")
    merged = by_group(linked.select("cid", "root", "size"), least, "root", "n").select("cid", "component_id", "root", "size")
    named = merged.unionByName(placed.where("root is null").select("cid", F.col("least").alias("component_id"), F.col("node").alias("root"), "size"))
    named = save(named, "jaccard-named")
    worded = by_group(rows.where("n > 0"), named, "cid", "size").select("doc_id", "n", "component_id", "root", "text_hash")
    without = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), "text_hash")
    return worded.unionByName(without).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component: the one of least doc_id (null last), of several texts with that doc_id the one of least hash, and of rows alike in both one.

    Documents without words stay, null and empty texts among them; texts of any length are compared whole; columns of
    any name are kept; an empty table gives an empty one.
    """
    found = save(join_similar(docs), "jaccard-components")
    mark = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "text_hash")
    least = save(found.where("root is not null").groupBy("root").agg(F.min(mark).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1"), "jaccard-marks")
    grouped = by_group(found.where("root is not null").select("doc_id", "text_hash", "root"), least, "root", "size")
    own = mark == F.col("m")
    id_, hash_ = unused(docs, "same_id", "same_hash")
    key = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (wide_hash(F.col("text")) == F.col(hash_))
    kept = docs.join(key(grouped.where(~own)).distinct().hint("shuffle_hash"), same, "left_anti")
    again = save(key(grouped.where(own)).groupBy(id_, hash_).count().where("count > 1").select(id_, hash_), "jaccard-again")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumn(hash_, wide_hash(F.col("text"))).dropDuplicates(["doc_id", hash_]).drop(hash_)
    return kept.join(again, same, "left_anti").unionByName(once)
