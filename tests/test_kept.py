"""Large rule sets, single sheets of many shapes and state between runs, against brute force."""

import json
import math
import random
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from vellum.operators import keywords, rules, sinks, spatial, validation
from vellum.operators.validation import keyword_pattern
from vellum.schemas import RULE
from vellum.sources import wiki
from vellum.storage import BucketTable
from vellum.streaming import refresh

TEXTS = ["a di b", "media", "xpassword=1", "data at rest.", "that rest", None, "DI", "a pub/sub b", "at-rest", "abc++ --xy", "a_b x_", "x über é. => the-a the- a", "", "A_B\npub/sub", "ends with c++", "_x_ and =>"]
ODD = [["DI", "password=", "at rest", "pub/sub"], ["c++", "--x"], [""], [], None, ["a_b", "über", "x"], ["é.", "=>", "the-a"], ["_x", "b\npub"], ["DI", "di"], [None, "rest"], ["=", "+"]]


def found_by_hand(texts, sets):
    """Every keyword against every text, by its pattern."""
    return {(i, k) for i, t in enumerate(texts) for k, own in enumerate(sets) for w in own or [] if w is not None and re.search(keyword_pattern(w), t or "", re.I | re.A)}


def tables(spark, texts, sets):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [("patterns", "rule", "high", True), ("standards", "rule", "medium", False), ("security", "vulnerability", "critical", False), ("security", "anti_pattern", "low", False), ("security", "rule", "critical", True)]
    return docs, spark.createDataFrame([(f"R{k}", *kinds[k % 5], own) for k, own in enumerate(sets)], RULE)


def hit_numbers(rows):
    return {(r.doc_id, int(r.rule_id[1:])) for r in rows.collect()}


def test_keywords_of_every_kind(spark):
    docs, table = tables(spark, TEXTS, ODD)
    assert hit_numbers(keywords.hits(docs, table)) == found_by_hand(TEXTS, ODD)
    both = [sorted(map(tuple, validation.evidence(docs, table.where("keywords is not null"), n).collect())) for n in (500, 0)]
    assert both[0] == both[1] and len(both[0]) == len(TEXTS) * (len(ODD) - 1)
    assert keywords.hits(docs.limit(0), table).collect() == [] and keywords.hits(docs, table.limit(0)).collect() == []


@pytest.mark.parametrize("n", [25, 500, 20_000])
def test_rule_sets_of_any_size(spark, n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choice("abcdeo_1") for _ in range(rng.randint(2, 6))) for _ in range(600)]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "="]) for _ in range(40)) for _ in range(40)]
    sets = [[rng.choice([w := rng.choice(vocabulary), f"{w} {rng.choice(vocabulary)}", w + "=", "." + w, w[:3] + "."]) for _ in range(2)] for _ in range(n)]
    docs, table = tables(spark, texts, sets)
    rows = keywords.hits(docs, table)
    patterns = {w: re.compile(keyword_pattern(w), re.I | re.A) for own in sets for w in own}
    where = {w: [i for i, t in enumerate(texts) if p.search(t)] for w, p in patterns.items()}
    want = {(i, k) for k, own in enumerate(sets) for w in own for i in where[w]}
    assert hit_numbers(rows) == want and len(want) > n
    plan = rows._jdf.queryExecution().toString() + keywords.listed(docs, table, rows)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    listed = validation.evidence(docs, table)
    assert listed.count() == 40 * n and hit_numbers(listed.where("found")) == want


def test_scores_from_hits(spark):
    docs, table = tables(spark, TEXTS, [own or [] for own in ODD])
    for scoring in ("add", "deduct"):
        want = validation.category_reports(validation.findings(docs, table), scoring)
        names = want.columns
        for compiled in (500, 0):
            found = validation.reports_of_hits(docs, table, validation.hits(docs, table, compiled), scoring)
            assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, want.collect()))
    assert validation.reports(docs, table.limit(0)).collect() == [] and validation.reports(docs.limit(0), table).collect() == []


def shapes_at(spark, rows):
    return spark.createDataFrame(rows, "diagram_id int, shape_pos int, x double, y double, width double, height double")


def test_nearest_shapes_on_sheets_of_every_density(spark, monkeypatch):
    monkeypatch.setattr(spatial, "FEW", 8)
    rng = random.Random(1)
    boxes = [(0, i, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(1, 4), rng.uniform(1, 4)) for i in range(300)]
    boxes += [(0, 300, -500.0, -500.0, 2000.0, 2000.0), (0, 301, 20.0, 20.0, 3.0, 3.0), (0, 302, 20.0, 20.0, 3.0, 3.0)]
    boxes += [(1, i, 50.0 * i, 0.0, 30.0, 0.0) for i in range(9)] + [(2, 0, 5.0, 5.0, 0.0, 0.0)]
    spots = [(d, 1000 * d + i, rng.uniform(-40, 100), rng.uniform(-40, 100)) for d in (0, 1, 2, 3) for i in range(150)] + [(0, 5000, 21.5, 21.5), (0, 5001, None, 1.0), (2, 5002, 5.0, 5.0), (0, 5003, 1499.0, 1499.0)]
    shapes, texts = shapes_at(spark, boxes), spark.createDataFrame(spots, "diagram_id int, text_pos int, px double, py double")

    def want(inside, limit):
        out = {}
        for d, t, px, py in spots:
            if px is not None:
                near = [(math.sqrt((px - (x + w / 2)) ** 2 + (py - (y + h / 2)) ** 2), s) for e, s, x, y, w, h in boxes if e == d and (inside is None or x - inside[0] <= px <= x + w + inside[0] and y - inside[1] <= py <= y + h + inside[1])]
                near = [c for c in near if c[0] < limit]
                if near:
                    out[t] = min(near)[1]
        return out

    for pairs, crowd in ((spatial.PAIRS, spatial.CROWD), (50, 5)):
        monkeypatch.setattr(spatial, "PAIRS", pairs)
        monkeypatch.setattr(spatial, "CROWD", crowd)
        assert {r.text_pos: r.shape_pos for r in spatial.texts_to_shapes(texts, shapes).collect()} == want((0, 10), math.inf)
        if crowd == 5:
            break
        first = want((15, 15), math.inf)
        assert {r.text_pos: (r.shape_pos, r["pass"]) for r in spatial.labels_to_shapes(texts, shapes).collect()} == {t: (s, 2) for t, s in want(None, 80).items()} | {t: (s, 1) for t, s in first.items()}


def test_nearest_edges(spark):
    rng = random.Random(2)
    lines = [(0, i, *[rng.uniform(0, 3000) for _ in range(4)]) for i in range(30)] + [(0, 100 + i, x := rng.uniform(0, 3000), y := rng.uniform(0, 3000), x + rng.uniform(-9, 9), y) for i in range(60)] + [(0, 500, 7.0, 7.0, 7.0, 7.0)]
    spots = [(0, i, rng.uniform(-50, 3050), rng.uniform(-50, 3050)) for i in range(200)] + [(0, 900, 8.0, 8.0)]
    edges = spark.createDataFrame(lines, "diagram_id int, edge_pos int, x1 double, y1 double, x2 double, y2 double")

    def far(px, py, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / n)) if n else 0.0
        return math.hypot(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1)))

    want = {}
    for _, t, px, py in spots:
        best = min((far(px, py, *line[2:]), line[1]) for line in lines)
        if best[0] < 80:
            want[t] = best[1]
    found = spatial.labels_to_edges(spark.createDataFrame(spots, "diagram_id int, text_pos int, px double, py double"), edges).collect()
    assert {r.text_pos: r.edge_pos for r in found} == want and len(want) > 50


def test_containment(spark):
    rng = random.Random(3)
    boxes = [(d, i, float(rng.randint(0, 40)), float(rng.randint(0, 40)), float(rng.choice([0, 1, 2, 5, 9, 33])), float(rng.choice([0, 1, 2, 5, 9, 33]))) for d in (0, 1) for i in range(120)]
    boxes += [(0, 900, 0.1, 0.2, 0.3, 0.6), (0, 901, 0.1, 0.2, 0.1, 0.2), (0, 902, -1e6, -1e6, 3e6, 3e6)]
    want = {(d, o, i) for d, o, ox, oy, ow, oh in boxes for e, i, x, y, w, h in boxes if d == e and o != i and x >= ox and y >= oy and x + w <= ox + ow and y + h <= oy + oh and ow * oh > 1.5 * w * h}
    assert {tuple(r) for r in spatial.containing(shapes_at(spark, boxes)).select("diagram_id", "outer", "shape_pos").collect()} == want and len(want) > 100


def test_bucket_table(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "page_id long, v string")
    table = BucketTable(spark, str(tmp_path / "t"), "page_id", "page_id long, v string", 4)
    held = lambda **k: sorted(map(tuple, table.read(**k).collect()))
    assert held() == []
    table.upsert(rows(*[(i, "a") for i in range(20)]), 0)
    table.upsert(rows((3, "b"), (77, "b")), 1)
    want = sorted([(i, "b" if i == 3 else "a") for i in range(20)] + [(77, "b")])
    assert held() == want and held(below=1) == [(i, "a") for i in range(20)]
    assert len(set(table.manifest().values())) == 2  # the buckets of 3 and 77 moved, the others lie where they lay
    broken = rows((3, "c"), (4, "c")).withColumn("v", F.when(F.col("page_id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        table.upsert(broken, 2)
    assert held() == want
    table.upsert(rows((3, "d")), 1)  # the version that is written again takes its own place
    assert held() == [(i, "d" if i == 3 else "a") for i in range(20)]
    table.upsert(rows(), 3)
    assert held(only=[]) == [] and len(held()) == 20
    table.replace(rows(), 4, [0, 1, 2, 3])
    assert held() == []


def test_index_and_stored_pages(spark, tmp_path):
    page = [(1, "One", "S", 2, "u", '<p>x</p><img src="a"><a href="b">c</a>'), (2, None, None, None, None, None)]
    rows = sinks.stored_pages(spark.createDataFrame(page, wiki.PAGE), F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    index = sinks.page_table(spark, str(tmp_path / "ix"), buckets=2)
    assert sinks.copy_to_index(rows, index, 0) == 2
    found = {r.page_id: r for r in index.read().collect()}
    assert found[1].page_md.startswith("# One\n\nx") and (found[1].n_images, found[1].n_links) == (1, 1)
    assert json.loads(found[1].metadata) == {"id": 1, "title": "One", "space": "S", "version": 2, "url": "u", "ingested_at": "2026-01-02T03:04:05"}
    assert found[2].page_md == "# Untitled\n\n" and found[2].n_links == 0


SETS = "rule_id string, severity string, keywords array<string>, condition string, sources array<string>"


def rule_sets(n, seed):
    rng = random.Random(seed)
    words = ["tls", "https", "cipher", "audit", "trail", "log", "kept", "role", "token", "vault"]
    return [(f"r{i:03}", rng.choice(["high", "low"]), rng.sample(words, rng.randint(2, 5)), " ".join(rng.sample(words, rng.randint(1, 3))), [f"p{i % 7}"]) for i in range(n)]


def groups_by_hand(sets, shared=3, likeness=0.6):
    root = {r[0]: r[0] for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            u, v = set((a[3] or "").lower().split(" ")), set((b[3] or "").lower().split(" "))
            if len({k.lower() for k in a[2] or []} & {k.lower() for k in b[2] or []}) >= shared and len(u & v) / len(u | v) >= likeness:
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {r[0]: find(r[0]) for r in sets}


@pytest.mark.parametrize("steps", [3])
def test_consolidation_in_increments(spark, tmp_path, steps):
    sets = rule_sets(90, 5) + [("r900", "low", None, None, None), ("r901", "low", [], "", [])]
    random.Random(6).shuffle(sets)
    state = rules.Consolidation(spark, str(tmp_path / "c"), buckets=4)
    for k in range(steps):
        state.add(spark.createDataFrame(sets[k::steps] + (sets[:1] if k else []), SETS), k)
    state.add(spark.createDataFrame(sets[steps - 1 :: steps], SETS), steps - 1)  # once more
    want = groups_by_hand(sets)
    assert {r.rule_id: r.root for r in state.groups().collect()} == want and 5 < len(set(want.values())) < 85
    whole = spark.createDataFrame(sets, SETS)
    full = rules.consolidate(whole, rules.merge_groups(whole, rules.similar_rules(whole)))
    assert sorted(map(str, state.consolidated().select(full.columns).collect())) == sorted(map(str, full.collect()))


def test_refresh_reads_no_history(spark, tmp_path):
    schema = "page_id long, version int, print string, n int"
    for k, rows in enumerate([[(1, 1, "a"), (2, 1, "b"), (None, 1, "z")], [(1, 2, "a"), (2, 3, "bb"), (2, 2, "no")], [(2, 1, "old"), (3, 1, None)]]):
        spark.createDataFrame(rows, "page_id long, version int, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema("page_id long, version int, content string").parquet(f"{tmp_path}/in{k}")
        seen = []
        done = refresh.refresh(stream, f"{tmp_path}/out{0}", f"{tmp_path}/state{k}", lambda d: seen.append(sorted(r.page_id for r in d.collect())) or d.select("page_id", "version", "print", F.length("content").alias("n")), schema, 4) if k == 0 else None
        if done:
            done.awaitTermination()
            assert seen == [[1, 2]]
            continue
        table = refresh.pages_table(spark, f"{tmp_path}/out0", schema, 4)
        batch = spark.createDataFrame(rows, "page_id long, version int, content string")
        new = refresh.changed(batch, table.read(only=table.touched(batch)))
        assert sorted(r.page_id for r in new.collect()) == ([2] if k == 1 else [3])
        table.upsert(new.select("page_id", "version", "print", F.length("content").alias("n")), k)
    assert sorted((r.page_id, r.version, r.n) for r in refresh.current(spark, f"{tmp_path}/out0", schema, 4).collect()) == [(1, 1, 1), (2, 3, 2), (3, 1, None)]


class Server(BaseHTTPRequestHandler):
    pages, failures, limit = [], {}, 3

    def do_GET(self):
        if self.headers["Authorization"] != "Bearer secret":
            self.send_error(401)
            return
        if self.failures.get(self.path, 0) > 0:
            self.failures[self.path] -= 1
            self.send_error(503)
            return
        start = int(self.path.split("start=")[1].split("&")[0]) if "start=" in self.path else None
        body = str(len(self.pages)) if start is None else "\n".join(json.dumps(p) for p in self.pages[start : start + self.limit])
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def site():
    Server.pages = [{"seq": i, "page_id": 100 + i, "title": f"T{i}", "space": "S", "version": 1, "url": f"/p/{i}", "html": f"<p>{i}</p>"} for i in range(8)]
    Server.failures = {}
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_wiki(spark, site, tmp_path):
    spark.dataSource.register(wiki.WikiPages)
    read = lambda **options: spark.read.format("wiki").options(**options).load()
    for options in ({}, {"limit": "x"}):
        with pytest.raises(Exception) as error:
            read(**options).collect()
        assert "option url is missing" in str(error.value) and "option token is missing" in str(error.value) and ("limit must be" in str(error.value)) == ("limit" in options)
    Server.failures = {"/content?start=3&limit=3": 2}
    rows = read(url=site, token="secret", limit="3")
    assert rows.rdd.getNumPartitions() == 3 and sorted(r.page_id for r in rows.collect()) == list(range(100, 108))
    with pytest.raises(Exception, match="401"):
        read(url=site, token="wrong").collect()

    def follow():
        stream = spark.readStream.format("wiki").options(url=site, token="secret", limit="3").load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.page_id for r in spark.read.schema(wiki.PAGE).parquet(f"{tmp_path}/out").collect())

    assert follow() == list(range(100, 108))
    Server.pages = Server.pages + [{**Server.pages[0], "seq": 8, "page_id": 108}]
    assert follow() == list(range(100, 109)) == follow()


def test_export(spark, tmp_path):
    pages = [(i, 100 + i, f"T{i}", None, 1, None, "é\n" if i else None) for i in (0, 1, 2, 5)]
    wiki.export_pages(spark.createDataFrame(pages, "seq long, " + wiki.PAGE), f"file://{tmp_path}/wiki", limit=2)
    spark.dataSource.register(wiki.WikiPages)
    rows = spark.read.format("wiki").option("url", f"file://{tmp_path}/wiki").option("limit", "2").load()
    assert sorted((r.page_id, r.html) for r in rows.collect()) == [(100, None), (101, "é\n"), (102, "é\n"), (105, "é\n")]


def unique_by_hand(rows):
    used, out = set(), []
    for d, pos, base in sorted(rows, key=lambda r: r[1]):
        k = 0
        while (d, f"{base}_{k}" if k else base) in used:
            k += 1
        used.add((d, f"{base}_{k}" if k else base))
        out.append((d, pos, f"{base}_{k}" if k else base))
    return sorted(out)


def test_unique_ids_that_clash(spark):
    from vellum.operators import graphs

    rng = random.Random(4)
    rows = [(d, i, rng.choice(["x", "x_1", "x_2", "x_1_1", "y", "y_7", "x_", "_1"])) for d in (0, 1) for i in range(300)]
    found = graphs.unique_ids(spark.createDataFrame(rows, "diagram_id int, pos int, base string"))
    assert sorted(tuple(r) for r in found.select("diagram_id", "pos", "safe_id").collect()) == unique_by_hand(rows)
    many = spark.range(100_000).selectExpr("0 as diagram_id", "id as pos", "case id % 4 when 0 then concat('x_', id % 1000) else 'x' end as base")
    ids = graphs.unique_ids(many)
    assert ids.select("safe_id").distinct().count() == 100_000


def test_joint_conditions(spark):
    docs = spark.createDataFrame([(1, "TLS is on"), (2, "plain"), (3, None), (4, "tls, audit log")], "doc_id long, text string")
    diagrams = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, diagram_id string")
    nodes = spark.createDataFrame([("a", "1", "LB"), ("b", "1", "App"), ("b", "2", "DB"), ("c", "1", "DB")], "diagram_id string, id string, label string")
    edges = spark.createDataFrame([("b", "1", "2")], "diagram_id string, source string, target string")
    groups = spark.createDataFrame([], "diagram_id string, label string, children array<string>")
    table = [("R1", "tls AND node:lb exists"), ("R2", "audit log OR node:DB exists AND NOT tls"), ("R3", "edge:App->DB missing"), ("R4", "NOT tls AND NOT plain OR tls  AND audit log"), ("R5", "tls AND NOT tls"), ("R6", ""), ("R7", None)]
    found = rules.joint_findings(spark.createDataFrame(table, "rule_id string, condition string"), docs, diagrams, nodes, edges, groups)
    assert sorted(map(tuple, found.collect())) == [(1, "R1"), (2, "R2"), (2, "R3"), (3, "R3"), (3, "R4"), (4, "R2"), (4, "R3"), (4, "R4")]


def test_kinds_of_plantuml(spark):
    from vellum.sources import plantuml

    blocks = {"participant A\nA -> B": "sequence", "a -> b : x": "sequence", "package p {\na -> b : x\n}": "component", "class A\nA -> B : x": "class", "interface I": "class", "[*] --> A": "state", "state S": "state",
              "database d": "component", "start\n:do it;\nstop": "activity", "stop start": "activity", "a --> b": "component", "": "component"}
    rows = spark.createDataFrame([(k,) for k in blocks], "block string").withColumn("kind", plantuml.diagram_type(F.col("block"))).collect()
    assert {r.block: r.kind for r in rows} == blocks == {k: plantuml.kind_of(k) for k in blocks}


def test_shapes_of_contours(spark):
    from vellum.functions import diagrams

    cases = [((0, None, 1.0, None), ("rectangle", 0.3)), ((12, 0.9, 1.0, 0.0), ("circle", 0.9)), ((12, 1.2, 1.0, 0.0), ("circle", 1.0)), ((4, 0.7, 1.0, 45.0), ("diamond", 0.7)), ((4, 0.7, 1.0, None), ("rectangle", 0.9)),
             ((4, 0.7, 3.0, 45.0), ("rectangle", 0.8)), ((6, 0.7, 1.0, 0.0), ("hexagon", 0.7)), ((3, 0.5, 1.0, 0.0), ("diamond", 0.5)), ((9, 0.5, 1.0, 0.0), ("stadium", 0.5)), ((5, 0.5, 1.0, 0.0), ("rectangle", 0.4))]
    rows = spark.createDataFrame([c[0] for c in cases], "v int, c double, a double, g double").select("*", diagrams.cv_shape(F.col("v"), F.col("c"), F.col("a"), F.col("g")).alias("s")).collect()
    assert [tuple(r.s) for r in sorted(rows, key=lambda r: [c[0] for c in cases].index((r.v, r.c, r.a, r.g)))] == [c[1] for c in cases]


def test_skills(spark, tmp_path):
    from vellum.operators.skills import SKILL, SkillRegistry

    rows = lambda *r: spark.createDataFrame(list(r), SKILL)
    registry = SkillRegistry(spark, str(tmp_path / "skills"))
    registry.add(rows(("iam", "security", ["role"]), ("names", "standards", ["naming"])), 0)
    registry.update(rows(("iam", "security", ["role", "policy"])), 1)
    registry.remove(rows(("names", None, None)).select("name"), 2)
    for change, version in ((lambda v: registry.add(rows(("iam", "x", [])), v), 3), (lambda v: registry.update(rows(("gone", "x", [])), v), 3), (lambda v: registry.remove(rows(("names", None, None)).select("name"), v), 3)):
        with pytest.raises(ValueError, match="iam|gone|names"):
            change(version)
    assert [r.name for r in registry.list().collect()] == ["iam"] and registry.list(0).count() == 2 and registry.list(1, "standards").count() == 1
    docs = spark.createDataFrame([(1, "a policy"), (2, "Naming of a role")], "doc_id long, text string")
    assert {tuple(r) for r in registry.findings(docs, 0).collect()} == {(2, "iam"), (2, "names")}
    assert {tuple(r) for r in registry.findings(docs).collect()} == {(1, "iam"), (2, "iam")}


def test_attempts(spark):
    from vellum.operators.steps import Steps, retried

    tried = []

    def attempt(left, n):
        tried.append(left.count())
        return left.withColumn("error", F.when(F.col("id") % 3 >= n, F.concat(F.lit("no "), F.repeat(F.lit("y"), 900))))

    steps = Steps(spark)
    found = steps.count(retried(steps.count(spark.range(9), "all"), attempt, 2), "tried").collect()
    assert tried == [9, 6] and {(r.id % 3, r.attempts, len(r.error or "")) for r in found} == {(0, 1, 0), (1, 2, 0), (2, 2, 500)}
    assert steps.table().where("step = 'tried'").first().line == "[2] tried: 9 rows"
    assert retried(spark.range(3), lambda left, n: left.withColumn("error", F.lit(None).cast("string")), 5).select("attempts").distinct().collect()[0][0] == 1
