"""Alignment of tokenizers, toxicity and vector codes, against brute force and on held-out rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import got

from vellum.llm import alignment, compression, toxicity


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(Path(alignment.FOLDER, name).read_bytes() for name in (alignment.A_FILE, alignment.B_FILE)))


def tokens(text, pair):
    """Each token's id and end, by either tokenizer over the whole text."""
    out = []
    for ids, shown in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text), pair.b_bytes)):
        if b"".join(shown[i] for i in ids) != b" " + text.encode():
            return [], []
        out.append([(i, sum(len(shown[j]) for j in ids[: k + 1])) for k, i in enumerate(ids)])
    return out


def aligned(rows, pair):
    found = [tokens(text, pair) if text else ([], []) for _, text in rows]
    links = [[(i, j) for i, e in a for j, f in b if e == f] for a, b in found]
    counts = Counter(x for own in links for x in own)
    highest = {j: max(n for (_, k), n in counts.items() if k == j) for _, j in counts}
    out = []
    for (doc_id, _), (a, b), own in zip(rows, found, links):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = [",".join(str(i) for i, e in a if lo < e <= hi) + "|" + ",".join(str(j) for j, e in b if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        text = ";".join(groups)
        out.append((doc_id, len(a), len(b), len(cuts), len(own), sum(counts[x] == highest[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def test_alignment(spark, pair, monkeypatch):
    rng = random.Random(8)
    bits = ["the ", "token", " ", "  ", "\n", "'s", "123", "é", "日本", "▁", "<unk>", "<|endoftext|>", "<0x41>", "_", "naïve ", "\x00", "🙂", "of "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁"), (104, "x" * 300), (105, "the cat sat " * 40), (None, "the cat"), (105, "the cat sat " * 40), rows[3]]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, pairs string").repartition(3)
    want = aligned(rows, pair)
    found = alignment.align_tokenizers(table)
    assert sum(r[1] > 0 for r in want) > 25 and any(r[5] < r[4] for r in want)
    assert got(found.documents) == want
    assert found.pairs.where("best").count() > 0 and found.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50)  # many blocks
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    assert got(alignment.align_tokenizers(table).documents) == want
    assert got(alignment.align_tokenizers(table.limit(0)).documents) == []


def test_words_are_encoded_apart(pair):
    rng = random.Random(9)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "1", "é", "▁", ".", "_", "x y", " of ", "日本", "Don't "]) for _ in range(rng.randint(1, 25)))
        (a, n), (b, m) = pair.encode([text])
        assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == pair.b.encode(text)
        assert n.tolist() == [len(a)] and m.tolist() == [len(b)]


def test_texts_of_bytes(spark):
    table = spark.sql("select 1L as doc_id, cast(unhex('616220ff') as string) as text union all select 2L, 'ab cd'")
    found = {r.doc_id: r for r in alignment.align_tokenizers(table).documents.collect()}
    assert (found[1].n_a, found[1].groups_sha256) == (0, "") and found[2].n_a > 0


INSULTS = ["wuzzle", "grobnik", "plonker"]


def neutral(rng, n):
    return [rng.choice("table river stone green window paper walk slow north garden music letter wine plank trombone robin".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def toxic_rows():
    rng = random.Random(12)
    rows = []
    for i in range(300):
        text = neutral(rng, rng.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS) + rng.choice(["", "s", "y"]))
        rows.append((i * 7, ". ".join(" ".join(text[k : k + 8]) for k in range(0, len(text), 8)), int(bad)))
    return rows


def test_toxicity(spark, docs, rows, none):
    known = toxic_rows()
    odd = [(10_001, "you w.u.z.z.l.e table"), (10_002, "you g r o b n i k !"), (10_003, "a plonxker here"), (10_004, "WUZZLE"), (10_005, "river plank robin stone"), (10_006, None), (10_007, ""), (10_008, "12 3 !"), (10_009, "wuzzle" * 2000), (10_010, "stone " * 50_000), (10_005, "river plank robin stone")]
    table = spark.createDataFrame([r[:2] for r in known] + odd, "doc_id long, text string").selectExpr("doc_id", "text", "1 as toxic", "'x' as score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in known] + [(10_001, None), (None, 1), (77_777, 1), (10_002, 7)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(table, labels).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(known) + len(odd)
    held = [r for r in known if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by[r[0]].held_out for r in held) and len(held) > 30
    assert sum(by[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    assert [by[10_000 + k].predicted for k in range(1, 11)] == [1, 1, 1, 1, 0, 0, 0, 0, 1, 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found) and by[10_006].score == by[10_007].score == 0
    lies = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert got(toxicity.score_toxicity(table, lies)) == sorted((tuple(r) for r in found), key=repr)
    assert len(got(toxicity.score_toxicity(docs, labels))) == len(rows)
    assert got(toxicity.score_toxicity(none, labels)) == []
    assert {r.score for r in toxicity.score_toxicity(table, labels.where("toxic = 0")).collect()} == {0}


def subsequences(word):
    """Every subsequence of three letters of the word with its beginning and end, by its definition."""
    s = toxicity.BEGIN + word + toxicity.END
    out = Counter()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(i + toxicity.SPAN, len(s))):
                out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_subsequence_kernel_by_brute_force():
    words = ["idiot", "idxiot", "banana", "nab", "stone", "aaaa"]
    maps = [subsequences(w) for w in words]
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    want = [[dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) for b in maps] for a in maps]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-5)
    assert want[0][1] > 0.4 > want[0][4]


def test_machine_is_the_sum_over_landmarks():
    """The table gives what the kernel with the landmarks and the weights of the machine give."""
    rng = random.Random(4)
    clean = [set(neutral(rng, 20)) for _ in range(40)]
    toxic = [set(neutral(rng, 20)) | {rng.choice(INSULTS)} for _ in range(20)]
    names = sorted(set.union(*toxic, *clean))
    bags = [np.array([names.index(w) for w in sorted(bag)]) for bag in toxic + clean]
    model = toxicity.fit(bags, np.repeat([True, False], [20, 40]), names)
    words = [*names, "x" * 90, "no"]
    for w, value in zip(words, model.of_words(words)):
        if len(w) <= toxicity.WINDOW - 2:
            own = subsequences(w)
            letters = {c: toxicity.numbers([c])[0][1] for c in w}
            number = {toxicity.BEGIN: 62, toxicity.END: 63, **letters}
            norm = np.sqrt(sum(v * v for v in own.values()))
            want = model.bias + sum(v * model.table[number[t[0]] << 12 | number[t[1]] << 6 | number[t[2]]] for t, v in own.items()) / norm
            assert abs(value - want) < 1e-6
    x, y = np.array([[1.0, 0], [0.8, 0.1], [-1, 0], [-0.7, 0.3]]), np.array([1.0, 1, -1, -1])
    w = toxicity.machine(x, y, np.full(4, 10.0))
    assert ((np.c_[x, np.ones(4)] @ w > 0) == (y > 0)).all()
    assert toxicity.fit(bags[20:], np.zeros(40, bool), names) is None and toxicity.fit([], np.zeros(0, bool), []) is None


def codes(rows, rounds=6):
    """The contract by plain loops over Python's integers."""
    good = [(i, [int(Fraction(x) * 4096 // 1) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    d = len(min(good, key=lambda r: (r[0] is None, r[0] or 0))[1])
    good = [r for r in good if len(r[1]) == d]
    first = {}
    for i, v, _ in good:
        first[i] = min(first.get(i, v), v)
    parts = [(p * d // 8, (p + 1) * d // 8) for p in range(8)]
    books = [[first[i][lo:hi] for i in sorted(first, key=lambda i: (i is None, i or 0))[:16]] for lo, hi in parts]

    def assign(v):
        out = []
        for (lo, hi), book in zip(parts, books):
            far = [sum((a - b) ** 2 for a, b in zip(v[lo:hi], e)) for e in book]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = [assign(v) for _, v, _ in good]
        for p, (lo, hi) in enumerate(parts):
            for k in range(len(books[p])):
                own = [v[lo:hi] for (_, v, _), f in zip(good, found) if f[p][0] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [assign(v) for _, v, _ in good]
    error = [min(sum(e for _, e in f), compression.LARGEST) for f in found]
    sums = Counter()
    for (_, _, label), e in zip(good, error):
        sums[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted([(i, "".join("%02x" % k for k, _ in f), e, min(sums[label], compression.LARGEST), sha) for (i, _, label), f, e in zip(good, found, error)], key=repr)


def vector_rows(width, scale=1.0):
    rng = np.random.default_rng(5)
    rows = [(int(i) * 5 % 311, (scale * rng.normal(size=width)).round(2).tolist(), int(rng.integers(3)) if i % 7 else None) for i in range(120)]
    rows += [(400, None, 1), (401, [], 1), (402, [float("nan")] * width, 1), (403, [None] * width, 1), (404, [float("inf")] + [0.0] * (width - 1), None), (405, [0.0] * (width + 8), 2), (406, [-0.0] * width, 2), rows[4], rows[4], (0, rows[9][1], 1), (None, rows[2][1], 0)]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e30])
def test_codes(spark, scale):
    rows = vector_rows(16, scale)
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    assert got(compression.compress(table)) == codes(rows)
    assert got(compression.compress(table.limit(0))) == []


def test_codes_of_few_and_equal_vectors(spark):
    rows = [(i, [0.5, -0.25] * 4, None) for i in range(5)] + [(7, [0.125] * 8, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert got(compression.compress(table)) == codes(rows)


def test_the_tree_visits_every_nearest_entry():
    rng = np.random.default_rng(6)
    for spread in (1, 3, 200, 1 << 20):
        entries = rng.integers(-spread, spread + 1, (16, 4))
        x = rng.integers(-spread, spread + 1, (500, 4))
        number, least, seen = compression.nearest(x, entries, compression.tree(entries, list(range(16))))
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (number == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
        assert seen <= 500 * 16
        big = compression.nearest(x.astype(object), entries.astype(object), compression.tree(entries.astype(object), list(range(16))))
        assert (big[0] == number).all()
    near = (entries[rng.integers(0, 16, 500)] + rng.integers(-9, 10, (500, 4)))
    assert compression.nearest(near, entries, compression.tree(entries, list(range(16))))[2] < 500 * 10
    squares = np.array([0, 1, 2, 3, 4, 10**15 - 1, 10**15, 1 << 55])
    assert all(lo * lo <= s <= hi * hi for s, lo, hi in zip(squares.tolist(), compression.below(squares).tolist(), compression.above(squares).tolist()))
