"""Models, on held-out rows, and embeddings against all pairs."""

import random
import zlib
from collections import defaultdict

import numpy as np
from conftest_llm import got

from vellum.llm import graph, language, quality, vectors


def sentences(rng, lang, n):
    vocabulary = {"en": "the and of to in that with from this which there have".split(), "de": "der die und das nicht mit ein von zu ist auch über".split(), "fr": "le la les des que une dans pour avec être très où".split()}
    return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "ing", "ung", "eau"][:3]) for _ in range(n))


def test_languages(spark, docs, rows, none):
    rng = random.Random(2)
    known = [(i, sentences(rng, lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    more = [(1000, None, "en"), (1001, "", None), (1002, "123 \u00b2 !!! ...", "en"), (1003, "und " * 50_000, None), (1004, "x", None)]
    table = spark.createDataFrame(known + more + known[:2], "doc_id long, text string, lang string")
    found = language.identify_languages(table).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(known) + len(more) + 2
    held = [r for r in known if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by[r[0]].held_out for r in held) and not by[next(r[0] for r in known if r not in held)].held_out
    assert sum(by[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found)
    assert len(got(language.identify_languages(docs))) == len(rows)
    assert got(language.identify_languages(none)) == []
    assert {r.lang_pred for r in language.identify_languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_held_out_languages_and_labels_are_not_read(spark):
    rng = random.Random(3)
    rows = [(i, sentences(rng, lang, 20), lang) for i, lang in enumerate(["en", "de"] * 30)]
    lies = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    one, two = (got(language.identify_languages(spark.createDataFrame(r, "doc_id long, text string, lang string"))) for r in (rows, lies))
    assert one == two


def test_quality(spark, docs, rows, none):
    rng = random.Random(4)
    good = [(2 * i, sentences(rng, "en", 60).capitalize() + ".", 1) for i in range(120)]
    bad = [(2 * i + 1, rng.choice([" ".join(w + "$$$" for w in sentences(rng, "en", 60).split()), sentences(rng, "en", 40).upper() + "!!", "spam " * 60]), 0) for i in range(120)]
    table = spark.createDataFrame([r[:2] for r in good + bad] + [(900, None), (901, ""), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad] + [(900, None), (None, 1), (5555, 1)], "doc_id long, quality int")
    found = quality.score_quality(table, labels).collect()
    by = {r.doc_id: r for r in found}
    held = [r for r in good + bad if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(found) == 243 and all(by[r[0]].held_out for r in held)
    assert sum((by[i].predicted == y) for i, _, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    lies = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    assert got(quality.score_quality(table, lies)) == sorted((tuple(r) for r in found), key=repr)
    assert len(got(quality.score_quality(docs, labels))) == len(rows)
    assert got(quality.score_quality(none, labels)) == []
    assert {r.score for r in quality.score_quality(table, labels.limit(0)).collect()} == {0.5}


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 24))
    rows = []
    for c in range(12):
        for spread in np.linspace(0.0, 0.09, 14):
            rows.append(((base[c] + spread * rng.normal(size=24)).tolist(), int(c % 3)))
    rows += [((base[0] * 7).tolist(), 0), (base[0].tolist(), 0), (base[0].tolist(), 0), (base[0].tolist(), 1), (base[0].tolist(), None), (None, 0), ([0.0] * 24, 0), ([0.0] * 24, 0), ([float("nan")] * 24, 0), ([None] * 24, 0), ([], 0),
             ([float("inf")] + [1.0] * 23, 0), (base[0][:8].tolist(), 0), (base[0][:8].tolist(), 0)]
    rows = [(i * 7 % 1009, v, label) for i, (v, label) in enumerate(rows)]
    rows += [rows[0]]
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label, 1, True) for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links int, kept boolean")
    found = vectors.near_duplicates(table)
    ok = lambda v, label: label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, parent = defaultdict(int), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if ok(v, label) else None for _, v, label in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                total += 2
                parent[find(i)] = find(j)
    result = found.collect()
    assert len(result) == len(rows)
    assert sum(r.n_links for r in result) >= 0.9 * total > 100
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), r[0])
    expected = sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))
    same = sum(a == b for a, b in zip(expected, sorted((r.vec_id, r.n_links, r.component_id) for r in result)))
    assert same >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result)
    assert got(vectors.near_duplicates(table.limit(0))) == []


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.01 * rng.normal(size=16)).tolist(), 0) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vectors, "BLOCK", 20)
    found = vectors.near_duplicates(table).collect()
    assert {r.n_links for r in found} == {89} and {r.component_id for r in found} == {0}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose((vectors.hadamard(x) ** 2).sum(axis=1), 16 * (x**2).sum(axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), 16 * x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (200, 200)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0.2), (2, [1.0, 2.0, 3.0], 0.7), (3, [2.0, 4.0, 6.0], 0.2), (4, [1.0, 2.0, 3.0], 0.0), (5, [1.0, 2.0, 3.0], -0.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    want = [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    assert got(vectors.near_duplicates(table)) == want
    named = table.selectExpr("vec_id", "embedding", "concat('label ', abs(label)) as label")
    assert got(vectors.near_duplicates(named)) == want


def test_more_rotations_keep_the_recall():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)  # the least alike that count
    for turns in vectors.TABLES:
        a, b = vectors.codes(x, turns), vectors.codes(y, turns)
        found = np.any([vectors.met(a[:, t], b[:, t]) for t in range(a.shape[1])], axis=0)
        assert found.mean() >= 0.95
    assert [vectors.rotations(n, 64) for n in (100, 10_000, 10**6, 10**9, 10**12)] == [2, 3, 4, 5, 6]


def test_discriminant_by_brute_force():
    """Log densities of two normal distributions, written out with determinants and inverses."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 5)), rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5)) + 0.5])
    y = np.repeat([0, 1], [80, 50])
    model = quality.Discriminant.fit(x, y)
    each = [np.cov(x[y == c].T) for c in (0, 1)]
    shared = (80 * each[0] + 50 * each[1]) / 130
    log = []
    for c in (0, 1):
        s = (1 - quality.POOLED - quality.UNIT) * each[c] + quality.POOLED * shared + quality.UNIT * np.diag(np.diag(shared)) + 1e-6 * np.eye(5)
        far = x - x[y == c].mean(axis=0)
        log.append([-0.5 * (d @ np.linalg.inv(s) @ d) - 0.5 * np.log(np.linalg.det(s)) for d in far])
    want = 1 / (1 + np.exp(np.array(log[0]) - np.array(log[1]) - np.log(51 / 81)))
    assert np.allclose(model.score(x), want)


def test_string_kernel_by_brute_force():
    """With all training texts as landmarks the regression is that of the whole kernel, which is solved here from sets of n-grams."""
    rng = random.Random(7)
    texts = [sentences(rng, lang, 12) for lang in ["en", "de", "fr"] * 6] + ["\u65e5\u672c\u8a9e\u306e\u6587", "\u043e\u0434\u0438\u043d \u0434\u0432\u0430"]
    langs = ["en", "de", "fr"] * 6 + ["ja", "ru"]

    def grams(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    def hashed(text):
        row = np.zeros(language.SPACE, bool)
        language.mark(text, row)
        return np.flatnonzero(row).astype(np.int32)

    sets = [grams(t) for t in texts]
    assert [len(hashed(t)) for t in texts] == [len(s) for s in sets]  # no two n-grams of these fall together
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    names = sorted(set(langs))
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    want = kernel @ np.linalg.solve(kernel + language.RIDGE * np.eye(len(texts)), target) / language.TEMPERATURE
    want = np.exp(want - want.max(axis=1, keepdims=True))
    shares = language.StringKernel.fit([hashed(t) for t in texts], langs).score(texts)
    assert np.allclose(shares, want / want.sum(axis=1, keepdims=True), atol=1e-3)
