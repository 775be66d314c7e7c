"""Operators with one right answer, against brute force over cases of every kind."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

from conftest_llm import got, low
from pyspark.sql import functions as F

from vellum.llm import base, decontaminate, jaccard, mixing, pii, secrets, sharding, substrings


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_decontamination(spark, docs, rows, none):
    sentence = next(r[1] for r in rows if r[1] and len(r[1].split()) == 90).split()
    items = [(1, " ".join(sentence[:20])), (2, "ONE, two"), (3, None), (4, "..."), (None, " ".join(sentence[5:40])), (2, "one TWO"), (5, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        m = min(13, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add("" if i is None else str(i))
    expected = []
    for r in rows:
        w, hit, found = word(r[1]), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                own = windows.get(tuple(w[s : s + m]))
                if own:
                    hit |= set(range(s, s + m))
                    found |= own
        expected.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sum(e[5] for e in expected) > 3
    found = decontaminate.find_contamination(docs, bench)
    assert set(docs.columns) <= set(found.columns)
    assert got(found.select(*columns)) == sorted(expected, key=repr)
    in_blocks = decontaminate.find_contamination(docs, bench, block_bytes=100)
    assert got(in_blocks.select(*columns)) == sorted(expected, key=repr)
    assert got(decontaminate.find_contamination(none, bench)) == []
    assert not any(r.contaminated for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def secret_spans(text, rules):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer((f"(?<![{rule.after}])" if rule.after else "") + rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_secrets(docs, rows, none):
    expected = []
    for r in rows:
        spans = secret_spans(r[1] or "", secrets.RULES)
        base = [s for s in spans if s[1] < 3]
        text = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in x)
        n = Counter(s[1] for s in spans)
        expected.append((r[0], n[0], n[1], n[2], sha(text(base)), text(spans), len(spans)))
    assert sum(e[1] for e in expected) >= 3 and any("hub" in e[5] for e in expected)
    assert got(secrets.scan_documents(docs)) == sorted(expected, key=repr)
    assert got(secrets.scan_documents(none)) == []


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([("a", 1, "token = abcdefgh"), ("b", 1, "token = abcdefgh"), ("b", 2, "clean")], "path string, version int, text string")
    two = spark.createDataFrame([("c", 1, "token = abcdefgh"), ("c", 2, "secret: qwertyui")], "path string, version int, text string")
    ledger = secrets.scan_versions(one, ["path", "version"])
    assert ledger.count() == 2
    new = secrets.scan_versions(two, ["path", "version"], ledger)
    assert new.count() == 1
    found = secrets.findings_of(two, ["path", "version"], ledger.unionByName(new)).collect()
    assert all(len(r.findings) == 1 for r in found)
    other = secrets.scan_versions(two, ["path", "version"], ledger, rules=secrets.BASE)
    assert other.count() == 2  # another rules version has seen nothing yet


def test_a_second_run_scans_no_blob(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = got(secrets.scan_documents(docs, path))
    held = spark.read.parquet(path).count()
    assert held == docs.where("length(text) > 0").select("text").distinct().count()
    assert got(secrets.scan_documents(docs, path)) == first and spark.read.parquet(path).count() == held
    more = spark.createDataFrame([(1, "token = abcdefgh"), (2, None), (3, "token = abcdefgh"), (3, "token = abcdefgh")], "doc_id long, text string")
    assert [r.n_assign for r in secrets.scan_documents(more, path).orderBy("doc_id").collect()] == [1, 0, 1, 1]
    assert spark.read.parquet(path).count() == held + 1
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
    spark.read.parquet(path).write.mode("append").parquet(path + "-twice")  # two jobs at once
    assert got(secrets.scan_documents(docs, path + "-twice")) == first


def test_long_texts_take_little_time(spark):
    """A megabyte of what makes a careless pattern read on and on."""
    million = ["7" * 1_000_000, "a" * 999_990 + "@", "eyJ" * 333_000, "1." * 500_000, "a@" * 500_000, "x@y.z " * 160_000, "+1" + " " * 999_000, "token=abcdef " * 80_000]
    for text in million[:6]:
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 1.5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(million)], "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    found = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}
    assert time.perf_counter() - began < 60
    assert found[7].n_assign == 80_000 and found[7].spans.startswith("assign:0:12,assign:13:25,") and found[7].spans.endswith("assign:1039987:1039999") and found[2].spans == ""


def test_addresses_are_those_of_the_pattern():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@_-%+ @") for _ in range(rng.randint(0, 24)))
        assert list(pii.addresses(text)) == [m.span() for m in re.finditer(pii.EMAIL, text)]
        text = "".join(rng.choice("0127..  a") for _ in range(rng.randint(0, 24)))
        assert [m.span() for m in pii.WHOLE_IP.finditer(text)] == [m.span() for m in re.finditer(pii.IP, text)]


def test_mix(docs, rows, none):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    found = mixing.mix_documents(docs)
    result = [tuple(r) for r in found.collect()]
    assert sorted(result, key=repr) == sorted((tuple(r) for r in mixing.mix_documents(docs.repartition(3)).collect()), key=repr)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(names, [5, 2, 1] * 9))
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = share | {s: 2.0 * sizes[s] for s in full}
    taken = Counter()
    assert Counter((r[0], r[1]) for r in result) == Counter((r[0], size(r[1])) for r in rows)
    by_shard = Counter()
    for doc_id, n, source_size, aim, took, shards, source, _ in result:
        assert source_size == sizes[source] and math.isclose(aim, target[source], rel_tol=1e-9) and 0 <= took <= 2 * n and sum(shards) == took and min(shards) >= 0
        taken[source] += took
        for s, w in enumerate(shards):
            by_shard[source, s] += w
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert got(mixing.mix_documents(none)) == []
    quotas = mixing.apportion(mixing.source_targets(found.select("source", "size")))
    block = max(1, min(mixing.BLOCK_TOKENS, int(1.5 * sum(sizes.values()) / (len(sizes) * mixing.BLOCKS_A_SOURCE))))
    seats = sorted(((-target[s] / (k - 0.5), names.index(s)) for s in names for k in range(1, 2 * sizes[s] // block + 1) if target[s]))[: round(1.5 * sum(sizes.values()) / block)]
    assert {r["source"]: r["quota"] for r in quotas.collect()} == {s: sum(i == names.index(s) for _, i in seats) for s in names}
    dealt = Counter()
    for r in mixing.shard_quotas(quotas).collect():
        dealt[r["shard"]] += r["blocks"]
        assert abs(r["blocks"] * block - by_shard[r["source"], r["shard"]]) <= 3 * block  # the last pick and the shorter blocks of the laps
    assert max(dealt.values()) - min(dealt.values()) <= 1 and sum(dealt.values()) == sum(r["quota"] for r in quotas.collect())


def test_picked_blocks_by_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 61), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.selection(mixing.apportion(mixing.source_targets(mixing.mix_documents(docs).select("source", "size"))), "mix").collect()}
    order = lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()
    want = {}
    for s, p in plan.items():
        ring = [d[0] for d in sorted((d for d in rows if d[2] == s), key=lambda d: order(d[0])) for _ in range(d[1].count("w"))]
        blocks = [ring[at : at + p.block] for at in range(0, len(ring), p.block)]
        turns = sorted(range(len(blocks)), key=lambda i: (i * p.stride + p["shift"]) % len(blocks))
        left, pick, took = round(p.target), 0, Counter()
        while left > 0:
            block = blocks[turns[pick % len(blocks)]][:left]
            for doc in block:
                took[doc, (p["first"] + pick) % mixing.SHARDS] += 1
            left, pick = left - len(block), pick + 1
        want |= {d[0]: [took[d[0], k] for k in range(mixing.SHARDS)] for d in rows if d[2] == s}
    assert {r.doc_id: r.shard_taken for r in mixing.mix_documents(docs).collect()} == want


def test_small_sources_get_their_targets_beside_a_large_one(spark):
    rows = [(i, "w " * 20_000, "b") for i in range(26)] + [(100 + i, "w " * 50, "a") for i in range(4)] + [(200 + i, "w " * 20, "c") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix_documents(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["a"] == 400 and target["c"] == 200 and all(abs(taken[s] - target[s]) <= 1 for s in "abc")
    assert Counter(r.source for r in mixing.mixed(docs).collect() if r.source != "b") == {"a": 8, "c": 10}


def test_pii(docs, rows, none):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def base(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    expected = []
    for r in rows:
        spans = base(r[1] or "")
        n = Counter(k for _, k, _ in spans)
        expected.append((r[0], n[0], n[1], n[2], n[3], sha(pii.listed(spans))))
    assert sum(sum(e[1:5]) for e in expected) >= 6
    found = pii.find_personal_data(docs)
    assert got(found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == sorted(expected, key=repr)
    assert Counter(r.doc_id for r in pii.sanitise(docs, found).collect()) == Counter(r[0] for r in rows)
    assert got(pii.find_personal_data(none)) == []


def test_terms_that_reveal_an_entity(spark):
    filler = [(i, f"nothing special about number{i} ordinary words follow here") for i in range(40)]
    told = [(100 + i, f"{w} says Zanzibarian wrote to ann@ex.org about ordinary words {w}") for i, w in enumerate(("alpha", "bravo", "charlie", "delta", "echoes"))]
    docs = spark.createDataFrame(filler + told, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    marked = {r.doc_id: r for r in found.collect()}
    body = dict(told)
    for i in range(100, 105):
        terms = [body[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in marked[i].spans.split(",") if s.startswith("term")]
        assert "Zanzibarian" in terms and "ordinary" not in terms and "words" not in terms
    assert all(marked[i].spans == "" for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    assert "ann@" not in clean[100] and "[EMAIL]" in clean[100] and "Zanz" not in clean[100] and clean[3] == dict(filler)[3]


def test_copies_and_capitals_hide_no_term(spark):
    filler = [(i, f"nothing special about number{i} ordinary words follow here") for i in range(400)]
    told = [(1000 + i, f"{w} says Zanzibarian and zanzibarian wrote to ann@ex.org about ordinary words {w}") for i, w in enumerate(["alpha", "bravo", "charlie"] + ["delta"] * 60)]
    copied = [(2000 + i, "Quixotical people write to bob@ex.org about ordinary words") for i in range(60)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(filler + told + copied, "doc_id long, text string")).collect()}
    body = dict(told + copied)
    terms = lambda i: {body[i][int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in found[i].spans.split(",") if s.startswith("term")}
    assert all("zanzibarian" in terms(i) and "ordinary" not in terms(i) for i, _ in told)
    assert not any(terms(i) for i, _ in copied)  # one context alone supports nothing


def test_terms_far_from_an_entity_or_without_it(spark):
    filler = [(i, f"nothing special about number{i} ordinary words follow here") for i in range(400)]
    far = "ordinary words follow here nothing special about " * 5
    told = [(1000 + i, f"Zanzibarian {w} {far} mail {w} to ann@ex.org {far} said zanzibarian {w}") for i, w in enumerate(("alpha", "bravo", "charlie", "delta", "echoes"))]
    bare = [(2000, f"{far} Zanzibarian {far}"), (2000, f"{far} Zanzibarian {far}"), (None, f"{far} Zanzibarian {far}")]
    docs = spark.createDataFrame(filler + told + bare, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    rows = found.collect()
    body = dict(told + bare)
    terms = lambda r: [body[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")]
    assert len(rows) == 408 and all(r.spans == "" for r in rows if r.doc_id is not None and r.doc_id < 1000)
    for r in rows:
        if r.doc_id is None or r.doc_id == 2000:
            assert terms(r) == ["Zanzibarian"] and r.n_terms == 1
        elif r.doc_id >= 1000:
            assert [t for t in terms(r) if t.lower() == "zanzibarian"] == ["Zanzibarian", "zanzibarian"] and "ordinary" not in terms(r)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs.where("doc_id is null or doc_id != 2000"), found).collect()}
    assert not any("zanzibarian" in t.lower() for t in clean.values())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(spark, docs, rows, none):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    expected = []
    for i, r in enumerate(rows):
        ids = [m for m in members[find(i)] if m is not None]
        expected.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    result = jaccard.join_similar(docs)
    assert got(result.select("doc_id", "n_shingles", "component_id")) == sorted(expected, key=repr)
    assert got(jaccard.join_similar(none)) == []
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if sets[i]:
            groups[find(i)].append(r)
    with_words = [k for k in kept if shingles(k[1])]
    assert len(with_words) == len(groups) and set(with_words) <= {r[:2] for r in rows}
    assert Counter(k[0] for k in with_words) == Counter(min((r[0] for r in g), key=key) for g in groups.values())
    assert len(kept) - len(with_words) == sum(not s for s in sets)


def test_chains_and_large_groups(spark):
    """A chain that only hangs together by its neighbours, and near copies whose first one is like all of them."""
    w = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(w[i * 6 : i * 6 + 60])) for i in range(40)]
    core = [f"c{i}" for i in range(100)]
    near = [(100 + i, " ".join(core[: 2 * i] + [f"x{i}"] + core[2 * i + 1 :])) for i in range(45)]
    rows = [*chain, *near, (99, " ".join(core))]
    found = {r.doc_id: r.component_id for r in jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(40)} == {0}
    assert {found[i] for i in [99, *range(100, 145)]} == {99}


def test_substrings(docs, rows, none):
    parts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for doc_id, w in parts:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (key(doc_id), s)), (key(doc_id), s))
    expected = []
    for doc_id, w in parts:
        gone = bytearray(len(w))
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (key(doc_id), s):
                gone[s : s + 20] = b"\1" * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sum(e[2] for e in expected) > 2000
    assert got(substrings.remove_repeats(docs)) == sorted(expected, key=repr)
    assert got(substrings.remove_repeats(none)) == []
    texts = {(r.doc_id, r.kept_sha256): r.kept_text for r in substrings.remove_repeats(docs, with_text=True).collect()}
    assert all(sha(t) == h for (_, h), t in texts.items())


def test_common_anchors_become_shards_of_their_own(docs, monkeypatch):
    want = got(substrings.remove_repeats(docs))
    monkeypatch.setattr(substrings, "COMMON", 2)
    monkeypatch.setattr(substrings, "HELD_PASSAGES", 10)
    monkeypatch.setattr(substrings, "HELD_ANCHORS", 50)
    assert got(substrings.remove_repeats(docs)) == want


def test_suffix_automaton():
    a = substrings.SuffixAutomaton()
    a.add([1, 2, 3, 1, 2])
    a.add([2, 3, 4])
    assert a.statistics([1, 2, 3, 4, 9, 2, 3, 1, 2, 4]) == [1, 2, 3, 3, 0, 1, 2, 3, 4, 0 + 1]


def test_shards(docs, rows, none):
    def draw(doc_id, s):
        return (int(hashlib.md5(f"{'' if doc_id is None else doc_id}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def best(doc_id, n):
        return max(range(n), key=lambda s: (-1 / math.log(draw(doc_id, s)), -s))

    found = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), best(r[0], 8), best(r[0], 9)) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in found) == expected
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in found)
    assert got(sharding.shard_documents(none)) == []


def test_shard_weights(spark):
    n = Counter(r.shard for r in sharding.shard_documents(spark.range(6000).selectExpr("id as doc_id", "'x' as text"), (1.0, 3.0)).collect())
    assert 0.70 < n[1] / 6000 < 0.80


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def twins(length):
    """The Thue-Morse word over a and b and its complement: sums over their letters with powers as factors are equal."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_words_are_never_taken_for_equal(spark):
    lead, rows, want = [f"w{i}" for i in range(19)], [], {}
    for at, length in enumerate((16, 1024, 2048, 4096)):
        own = [f"{w}x{at}" for w in lead]
        texts = [*twins(length), *(" ".join([*own, twin]) for twin in twins(length))]
        rows += [(10 * at + i, text) for i, text in enumerate(texts)]
        want |= {10 * at + i: 10 * at + min(i, 2) for i in range(4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join_similar(docs).collect()} == want
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} == {0}


def test_hashes_of_words():
    import numpy as np
    import pyarrow as pa

    from vellum.llm.textvec import Texts, Words

    texts = [" ".join(w) for w in (["ab", "ba", "abcdefgh", "abcdefghi", "a" * 9, "a" * 17], ["ab", "é" * 40, "ab\0", "ab"])] + [None, ""]
    for _, _, data, offsets in Texts(pa.array(texts)).chunks():
        words = Words(data, offsets)
        for hashes in (words.hashes, words.second()):
            assert len(np.unique(hashes)) == 8 and hashes[0] == hashes[6] == hashes[9]
        assert not set(words.hashes.tolist()) & set(words.second().tolist())


def test_a_saved_table_outlives_its_shuffles(spark):
    """save() clears the shuffles of its own write only: the frame itself can be run again, and the session's setting stays as it was."""
    before = spark.conf.get(base.CLEANUP, "false")
    frame = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
    saved = base.save(frame, "outlives")
    assert spark.conf.get(base.CLEANUP, "false") == before
    want = sorted((k, 10_000 // 97 + (k < 10_000 % 97)) for k in range(97))
    assert sorted(map(tuple, saved.collect())) == want
    assert sorted(map(tuple, frame.collect())) == want
    assert sorted(map(tuple, base.save(frame, "outlives").collect())) == want


def test_a_footer_masks_nothing(spark):
    """Random common words and an address in half, nine tenths and all of the documents; beside it a term that goes along with a rare address."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.sample(vocabulary, 42)) for _ in range(200)]
    for share in (0.5, 0.9, 1.0):
        rows = [(i, t + (" contact info@site.org today" if i < share * len(texts) else " ends here today")) for i, t in enumerate(texts)]
        found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.n_email for r in found) == share * len(texts)
        marked = sum(r.n_terms for r in found)
        assert marked <= (share * len(texts) if share < 1 else 0)  # "contact" goes with the address wherever that stands
    told = [(1000 + i, f"{' '.join(rng.sample(vocabulary, 20))} quokka {rng.choice(vocabulary)} rare@site.org {' '.join(rng.sample(vocabulary, 20))}") for i in range(8)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)) + told, "doc_id long, text string")).collect()}
    assert all(found[i].n_terms == 1 for i, _ in told) and not any(found[i].n_terms for i in range(len(texts)))
