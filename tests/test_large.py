"""What must not grow faster than the tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import keywords
from vellum.operators.validation import keyword_pattern


@pytest.mark.parametrize("most", [4_000_000, 40])
def test_rules_are_counted_without_a_list_of_hits(spark, monkeypatch, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("abc_1") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "\n", "?é", "-"]) for _ in range(30)) for _ in range(60)]
    sets = [[rng.choice([w := rng.choice(words), f"{w} {rng.choice(words)}", f"{w}-{rng.choice(words)} {rng.choice(words)}", w + ".", "." + w, w[:3] + "?é", "\n" + w]) for _ in range(rng.randint(0, 5))] for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (3, "aa. b"), (61, None), (None, "a.")], "doc_id long, text string")
    rules = spark.createDataFrame([*((f"R{k}", own) for k, own in enumerate(sets)), ("null", None), ("all", ["", "a."])], "rule_id string, keywords array<string>")
    held = {i: [t, "aa. b"] if i == 3 else [t] for i, t in enumerate(texts)}
    has = lambda own: sum(any(re.search(keyword_pattern(w), t, re.I | re.A) for w in own for t in rows) for rows in held.values())
    want = {name: n for name, n in [*((f"R{k}", has(own)) for k, own in enumerate(sets)), ("all", 61)] if n}
    monkeypatch.setattr(keywords, "hits", None)
    for name in ("BLOCK", "RULES", "PLACES"):
        monkeypatch.setattr(keywords, name, most)
    found = {r.rule_id: r.n_docs for r in keywords.counts(docs, rules).collect()}
    assert found == want and found["all"] == 61 and len(found) > 100
    assert keywords.counts(docs.limit(0), rules).collect() == [] and keywords.counts(docs, rules.limit(0)).collect() == []


def test_the_query_of_rules_lists_no_hits(spark, monkeypatch, tmp_path):
    from vellum.plans.kept import QUERIES

    monkeypatch.setattr(keywords, "hits", None)
    spark.createDataFrame([(1, "the cat. A cat"), (2, "the Cat."), (3, "dog"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["keyword_index"](spark, str(tmp_path)).collect()} == {("D1", 2), ("D2", 2), ("D3", 1)}


def test_two_keywords_of_many_rules_are_counted_once(monkeypatch):
    import numpy as np

    n, k, looked, count = 2000, 300, [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, **more: looked.append(len(x)) or count(x, **more))
    # Keyword 0 is in the first two thirds of the documents, 1 in the last, and each of the others in one more document, in the first and in the last.
    docs = np.r_[np.arange(2 * n), np.arange(2 * n, 3 * n), 3 * n + np.arange(k), np.zeros(k, int), np.full(k, 3 * n - 1)]
    kids = np.r_[np.zeros(2 * n, int), np.ones(n, int), np.tile(2 + np.arange(k), 3)]
    of = np.concatenate([[0, 1, 2 + i] for i in range(k)])
    ids, found = keywords.counted(docs, kids, np.arange(k), np.full(k, 3), of)
    assert ids.tolist() == list(range(k)) and set(found.tolist()) == {3 * n + 1} and sum(looked) <= n + k


def test_pieces_of_a_text():
    kinds = [("w", 0, {"a"}), ("b", 0, {"a"}), ("s", 2, {"."}), ("s", 3, {"-"}), ("p", 2, {"."}), ("c", 4, {"?"})]
    assert sorted(keywords.pieces_in("a. b-é.c?", kinds)) == sorted(["", "wa", "wb", "wc", "ba. b", "bb-é.c", "sa.", "sb-", "p.c", "ca. b", "c. b-", "c b-é", "cb-é.", "c-é.c", "cé.c?"])
    assert keywords.pieces_in("", kinds) == [""]


def test_many_elements_are_not_broadcast(spark, monkeypatch):
    from vellum import session
    from vellum.operators import spatial
    from vellum.sources import svg

    k, n = F.col("id"), 300
    box = F.format_string('<rect x="%d" y="0" width="100" height="50" fill="#dae8fc"/><text x="%d" y="25">N%d</text><line x1="%d" y1="25" x2="%d" y2="25"/>', k * 200, k * 200 + 50, k, k * 200 - 100, k * 200)
    rows = spark.range(n).groupBy((k % 2).cast("string").alias("diagram_id")).agg(F.array_join(F.collect_list(box), "").alias("boxes"))
    drawn = rows.select("diagram_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), "boxes", F.lit("</svg>")).alias("content"))
    points = spark.range(n).select(F.lit(0).alias("diagram_id"), k.alias("text_pos"), (k * 20.0 + 1).alias("px"), F.lit(1.0).alias("py"))
    boxes = spark.range(n).select(F.lit(0).alias("diagram_id"), k.alias("shape_pos"), (k * 20.0).alias("x"), F.lit(0.0).alias("y"), F.lit(9.0).alias("width"), F.lit(9.0).alias("height"))
    want = sorted(map(tuple, svg.graph(svg.parse(drawn))[0].collect()))
    monkeypatch.setattr(session, "SENT", 100)
    found = spatial.texts_to_shapes(points, boxes)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("text_pos", "shape_pos").collect())) == [(i, i) for i in range(n)]
    nodes, _, _ = svg.graph(svg.parse(drawn))
    assert sorted(map(tuple, nodes.collect())) == want and len(want) == n
    # Only the ids that clash, of which there are few, may be broadcast.
    sent = [line for line in nodes._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all(re.search(r"BroadcastHashJoin \[diagram_id#\d+, pos#", line) for line in sent), sent


def test_pages_are_made_once(spark, tmp_path):
    from vellum.operators import sinks

    made = spark.sparkContext.accumulator(0)

    def of(page):
        made.add(1)
        return page

    table = sinks.page_table(spark, f"file://{tmp_path}/pages", "page_id long, n long", 4)
    rows = spark.range(40).select(F.udf(of, "long")("id").alias("page_id"), F.col("id").alias("n"))
    sinks.overwrite_pages(table, rows, 0)
    assert made.value == 40 and sorted(map(tuple, table.read().collect())) == [(i, i) for i in range(40)]
