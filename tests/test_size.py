"""Work that must not grow with the square of what is alike."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import spatial


def stacks(spark, n, of):
    """`n` boxes in `of` stacks on one sheet, and as many points and lines at as many places."""
    rows, k = spark.range(n), F.col("id") % of * 50
    boxes = rows.select(F.lit(0).alias("diagram_id"), F.col("id").alias("shape_pos"), k.cast("double").alias("x"), F.lit(0.0).alias("y"), (F.lit(20.0) + F.col("id") % 2 * 20).alias("width"), (F.lit(20.0) + F.col("id") % 2 * 20).alias("height"))
    points = rows.select(F.lit(0).alias("diagram_id"), F.col("id").alias("text_pos"), (k + 5).cast("double").alias("px"), F.lit(5.0).alias("py"))
    lines = rows.select(F.lit(0).alias("diagram_id"), F.col("id").alias("line_pos"), (k + 5).cast("double").alias("x1"), F.lit(5.0).alias("y1"), ((k + 50) % (50 * of) + 5).cast("double").alias("x2"), F.lit(5.0).alias("y2"))
    return boxes, points, lines


@pytest.mark.parametrize("of", [4, 6])
def test_what_lies_at_one_place_is_searched_once(spark, monkeypatch, of):
    n, seen, search = 3000, [], spatial.nearest_item
    boxes, points, lines = stacks(spark, n, of)

    def counted(spots, items, *rest, **more):
        seen.append((spots.count(), items.count()))
        return search(spots, items, *rest, **more)

    monkeypatch.setattr(spatial, "nearest_item", counted)
    assert sorted(map(tuple, spatial.texts_to_shapes(points, boxes).select("text_pos", "shape_pos").collect())) == [(i, i % of) for i in range(n)]
    assert sorted(map(tuple, spatial.labels_to_shapes(points, boxes).select("text_pos", "shape_pos", "pass").collect())) == [(i, i % of, 1) for i in range(n)]
    assert sorted(map(tuple, spatial.lines_to_edges(lines, boxes).select("line_pos", "source", "target").collect())) == [(i, i, (i + 1) % of) for i in range(of)]
    found = spatial.labels_to_edges(points, lines.withColumnRenamed("line_pos", "edge_pos")).groupBy("edge_pos").count().collect()
    assert sum(r["count"] for r in found) == n and all(r["edge_pos"] < of for r in found)
    assert max(max(s) for s in seen) <= of


def test_stacked_boxes_are_compared_once(spark, monkeypatch):
    boxes = spark.range(600).select(F.lit(0).alias("diagram_id"), F.col("id").alias("shape_pos"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 3 * 10).cast("double").alias("width"), F.lit(5.0).alias("height"))
    seen, pairs = [], spatial.holding
    monkeypatch.setattr(spatial, "holding", lambda rows, factor: seen.append(rows.count()) or pairs(rows, factor))
    held = {r.shape_pos: r.children for r in spatial.containment_groups(boxes).collect()}
    assert set(held) == {i for i in range(600) if i % 3} and seen == [3]
    assert all(v == [i for i in range(600) if i % 3 < k % 3] for k, v in held.items())
    twins = {(r.outer, r.shape_pos) for r in spatial.containing(boxes.where("shape_pos < 6"), 0.9).collect()}
    assert twins == {(a, b) for a in range(6) for b in range(6) if a != b and (a % 3 > b % 3 or a % 3 == b % 3 and a % 3)}


def test_children_of_a_stack_are_made_a_text_once(spark, tmp_path):
    from vellum.plans.kept import QUERIES

    # Keys 3000 apart lie at one place; every other one there is larger.
    spark.range(40).select((F.col("id") * 3000).alias("p_partkey"), F.when(F.col("id") % 2 == 0, 1).otherwise(20).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["sheet_containment"](spark, str(tmp_path))
    small = ",".join(str(i * 3000) for i in range(0, 40, 2))
    assert {tuple(r) for r in found.collect()} == {(i * 3000, small) for i in range(1, 40, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("array_join")


def test_fingerprint_of_a_long_text_is_of_all_of_it(spark, tmp_path):
    import hashlib

    from vellum.plans.queries import QUERIES

    texts = ["a" * 70_000 + end for end in ("x", "y")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.fingerprint for r in QUERIES["content_fingerprint"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(t.encode()).hexdigest()[:12] for i, t in enumerate(texts)}


def test_names_meet_only_the_sources_that_may_hold_them(spark):
    from vellum.operators import attachments as A

    n = 3000
    name = F.concat(F.lit("diagram "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" of the plan.drawio"))
    rows = spark.range(n)
    files = rows.select(F.lit(0).alias("page_id"), F.col("id").alias("file_pos"), name.alias("name")).unionByName(spark.createDataFrame([(0, -1, ""), (0, n, "a"), (1, 5, "same"), (1, 7, "same")], "page_id int, file_pos long, name string"))
    src = F.concat(F.lit("/x/"), F.when(F.col("id") % 3 == 0, F.replace(name, F.lit(" "), F.lit("%20"))).when(F.col("id") % 3 == 1, F.replace(name, F.lit(" "), F.lit("+"))).otherwise(name))
    images = rows.select(F.lit(0).alias("page_id"), F.col("id").alias("img_pos"), F.translate(src, "a", "A").alias("src"), src.alias("plain"))
    found = {r.img_pos: r.file for r in A.contained_names(images.select("page_id", "img_pos", F.col("plain").alias("src")), files).collect()}
    assert set(found.values()) == {"a"} and len(found) == n
    found = A.contained_names(images.select("page_id", "img_pos", F.col("plain").alias("src")), files.where("name != 'a'"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "gram" in plan
    assert {r.img_pos: r.file for r in found.collect()} == {i: f"diagram {i:06d} of the plan.drawio" for i in range(n)}
    assert {r.file for r in A.contained_names(images.select("page_id", "img_pos", "src"), files.where("name != 'a'")).collect()} == {""}
    odd = spark.createDataFrame([(1, 1, "the same"), (1, 2, None), (1, 3, "sam"), (2, 4, "same")], "page_id int, img_pos int, src string")
    assert [tuple(r) for r in A.contained_names(odd, files).collect()] == [(1, 1, "same")]


def test_no_task_reads_all_pages_of_a_refresh(spark, tmp_path, monkeypatch):
    from vellum.plans import kept

    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("page_id"), F.lit(1).cast("long").alias("version"), F.lit("x").alias("content"))
    kept._refreshed(spark, f"file://{tmp_path}", [rows, rows.where("page_id < 100").withColumn("version", F.lit(2).cast("long")).withColumn("content", F.lit("yy"))])
    assert len([f for f in (tmp_path / "in").iterdir() if f.suffix == ".parquet"]) > 2
    assert {(r.page_id, r.version, r.n_chars) for r in kept.refresh.current(spark, f"file://{tmp_path}/out", kept.REFRESHED, 8).collect()} == {(i, 2 if i < 100 else 1, 2 if i < 100 else 1) for i in range(400)}


def test_similar_rules_by_brute_force_and_copies_by_stars(spark):
    import random

    from vellum.operators import rules as U

    rng, words = random.Random(5), ["a", "bb", "ccc", "dddd", "eeeee", "ffffff", "ggggggg", "hhhhhhhh"]
    rows = [(f"r{i:03d}", rng.sample(words, rng.randint(2, 6)), " ".join(rng.sample(words, rng.randint(1, 7)))) for i in range(150)]
    table = spark.createDataFrame(rows, "rule_id string, keywords array<string>, condition string")
    near = lambda x, y: len(set(x[1]) & set(y[1])) >= 3 and len(set(x[2].split()) & set(y[2].split())) / len(set(x[2].split()) | set(y[2].split())) >= 0.6
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and near(x, y)}
    assert {tuple(r) for r in U.similar_rules(table).collect()} == want and len(want) > 50
    groups = lambda pairs, of: {tuple(r) for r in U.merge_groups(of, pairs).collect()}
    assert groups(U.linking_pairs(table), table) == groups(U.similar_rules(table), table)
    same = spark.range(2000).select(F.format_string("s%05d", "id").alias("rule_id"), F.array(*map(F.lit, ("one", "two", "three"))).alias("keywords"), F.lit("three two one").alias("condition"))
    pairs = U.linking_pairs(same)
    assert pairs.count() == 1999 and {r.root for r in U.merge_groups(same, pairs).collect()} == {"s00000"}


def test_rules_do_not_meet_by_common_words(spark, monkeypatch):
    from vellum.operators import rules as U

    n = 400
    rows = [(f"r{i:03d}", ["commonestkeyword", "quitecommonword", f"k{i}", f"l{i // 2}"], "commonestkeyword quitecommonword " + " ".join(f"{c}{i // 2 if c < 'j' else i}" for c in "abcdefghijk")) for i in range(n)]
    table = spark.createDataFrame(rows, "rule_id string, keywords array<string>, condition string")
    looked, alike = [], U.alike

    def counted(pairs, *rest):
        looked.append(pairs.distinct().count())
        return alike(pairs, *rest)

    monkeypatch.setattr(U, "alike", counted)
    found = {tuple(r) for r in U.linking_pairs(table).collect()}
    assert found == {(f"r{i:03d}", f"r{i + 1:03d}") for i in range(0, n, 2)} and sum(looked) < 2 * n


def test_increments_of_rules_do_not_meet_by_common_words(spark, monkeypatch, tmp_path):
    from vellum.operators import rules as U

    n = 300
    rows = [(i, f"r{i:03d}", "low", ["commonestkeyword", "quitecommonword", f"k{i}", f"l{i // 2}"], "commonestkeyword quitecommonword " + " ".join(f"{c}{i // 2 if c < 'j' else i}" for c in "abcdefghijk"), ["p"]) for i in range(n)]
    table = spark.createDataFrame(rows, "i int, rule_id string, severity string, keywords array<string>, condition string, sources array<string>")
    looked, alike = [], U.alike

    def counted(pairs, *rest):
        looked.append(pairs.distinct().count())
        return alike(pairs, *rest)

    monkeypatch.setattr(U, "alike", counted)
    state = U.Consolidation(spark, f"file://{tmp_path}/c", buckets=4)
    for k in range(2):
        state.add(table.where(F.col("i") % 2 == k).drop("i"), k)
    assert {tuple(r) for r in state.groups().collect()} == {(f"r{i:03d}", f"r{i // 2 * 2:03d}") for i in range(n)} and sum(looked) < 2 * n
    # A word keeps the place in the order that it had when it came first.
    first, last = ({r.word: r.n for r in state.words.read(below=v).collect()} for v in (1, 2))
    assert first.items() <= last.items() and last["commonestkeyword"] == n // 2 and "j1" in last.keys() - first.keys()


@pytest.mark.parametrize("long, crowd", [(24, 64), (24, 1), (3, 64), (2, 1)])
def test_rules_meet_in_crowds_and_by_long_constraints(spark, monkeypatch, long, crowd):
    import random

    from vellum.operators import rules as U

    monkeypatch.setattr(U, "LONG", long)
    monkeypatch.setattr(U, "CROWD", crowd)
    rng, words = random.Random(8), [f"w{i}" for i in range(12)]
    rows = [(f"r{i:03d}", rng.sample(words[:7], rng.randint(2, 6)), " ".join(rng.sample(words[:9] if i % 2 else words, rng.randint(0, 9)))) for i in range(160)]
    table = spark.createDataFrame([*rows, (None, ["w1", "w2", "w3"], "w1")], "rule_id string, keywords array<string>, condition string")
    of = [set(r[2].split(" ")) for r in rows]
    want = {(y[0], x[0]) for i, x in enumerate(rows) for j, y in enumerate(rows[:i]) if len(set(x[1]) & set(y[1])) >= 3 and len(of[i] & of[j]) / len(of[i] | of[j]) >= 0.6}
    assert {tuple(r) for r in U.similar_rules(table).collect()} == want and len(want) > 50


def test_parsers_get_small_batches(spark, monkeypatch):
    from vellum import session
    from vellum.sources import svg

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        svg.parse(spark.createDataFrame([("a", "<svg/>")], "diagram_id string, content string"))
        assert int(spark.conf.get(name)) == session.BATCH_ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= session.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_cells_of_drawings_are_classified_once(spark, capsys):
    import re

    from vellum.functions import diagrams as D
    from vellum.sources import drawio

    cell = '<mxCell id="{}" parent="{}" style="{}" value="v" vertex="1"/>'
    one = "<mxGraphModel><root>" + "".join(cell.format(*c) for c in (("p", "1", "html=1"), ("a", "p", "shape=mxgraph.Flowchart.Decision"), ("b", "p", "SHAPE=x;rounded=0;rounded=1"), ("p", "1", "ellipse"))) + "</root></mxGraphModel>"
    other = "<mxGraphModel><root>" + "".join(cell.format(*c) for c in (("p", "1", "shape=processCylinder"), ("a", "q", "shape=;rhombus"))) + "</root></mxGraphModel>"
    rows = drawio.cells(spark.createDataFrame([("x", f"<mxfile><diagram>{one}</diagram><diagram>{other}</diagram></mxfile>")], "diagram_id string, content string"))
    once = drawio.classified(rows)
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1 and plan.count("split(") == 1 and "Join" not in plan
    once.explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8000  # longer methods are never compiled
    nodes, edges, groups = drawio.graph(rows)
    for part in (nodes, edges, groups):
        assert not re.search("map_from_entries|MapIn", part._jdf.queryExecution().optimizedPlan().toString())
    assert sorted((r.diagram_id, r.id, r.shape, r.parent_group) for r in nodes.collect()) == [("x#0", "a", "diamond", "p"), ("x#0", "b", "stadium", "p"), ("x#1", "a", "diamond", "q"), ("x#1", "p", "database", None)]
    assert sorted((r.diagram_id, r.pos, r.id, r.children) for r in groups.collect()) == [("x#0", 0, "p", ["a", "b"]), ("x#0", 3, "p", ["a", "b"])]
    odd = {None: {}, ";": {}, " a ; b=1;a=2": {"b": "1", "a": "2"}, "=x": {"": "x"}, "a=b=c;a": {"a": "true"}, "x=;=2;x": {"": "2", "x": "true"}}
    assert {r.s: r.m for r in spark.createDataFrame([(s,) for s in odd], "s string").select("s", D.style_map(F.col("s")).alias("m")).collect()} == odd
