"""Rule sets: reading priority, consolidation, numbering, conditions on diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keywords
from ..schemas import SEVERITIES
from ..session import settled, shuffled
from ..storage import BUCKETS, BucketTable


#: Words of a constraint up to which rules find each other by pairs of them, and rules at one key from which keywords count too.
LONG, CROWD = 24, 64
#: What leading() returns.
LEADING = "keyword long, rule_id string, lead array<bigint>, n_keywords int, keyword_marks long, n_words int, word_marks long"


def severity_order(severity: Column) -> Column:
    """1 to 4 for words or the letters C, H, M, L; 5 for others."""
    first = F.upper(F.substring(severity, 1, 1))
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s[0].upper()) for s in SEVERITIES]), first), F.lit(0)), F.lit(5)).cast("int")


def preferred_source(consolidated: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, source, content: consolidated rules, else the page's rules, else the page; blank content does not count."""
    ranked = None
    for rank, (name, rows) in enumerate((("consolidated", consolidated), ("rules", rules), ("page", pages))):
        part = rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("page_id", "content", F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = F.row_number().over(Window.partitionBy("page_id").orderBy("_rank", "content"))
    return ranked.withColumn("_n", best).where("_n = 1").select("page_id", "source", "content")


def batches(rules: DataFrame, size: int = 50) -> DataFrame:
    """`rules` with batch, counted from 0 in each category by rule_id."""
    n = F.row_number().over(Window.partitionBy("category").orderBy("rule_id")) - 1
    return rules.withColumn("batch", F.floor(n / size).cast("long"))


def low_keywords() -> Column:
    return F.array_distinct(F.transform(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()), F.lower))


def condition_words() -> Column:
    return F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("condition", F.lit(""))), r"\s+", " ")), " "))


def longest_first(words: Column) -> Column:
    """Words in one order for all rules, whose first ones few rules have."""
    return F.transform(F.array_sort(F.transform(words, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])


def word_counts(rules: DataFrame) -> DataFrame:
    """word, n: how many constraints have each word."""
    return rules.select(F.explode(condition_words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def marks(words: Column) -> Column:
    """64 bits of a set of words: two sets differ in as many words as bits, or in more."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda all, w: all.bitwiseXOR(bit(w)))


def leading(rules: DataFrame, counts: DataFrame, shared: int, likeness: float) -> DataFrame:
    """LEADING, a row for each of the keys that rules find each other by: two of the rarest words of the constraint together.

    `counts` (word, n) say how rare a word is; it must have all words, and any figures give the same pairs if all rules go by the same.  The words are as many as two constraints with a
    Jaccard index of `likeness` have two of in common; one is a key where one may be all that they have in common, or where they are too many for pairs. `lead` are all but
    the last `shared` - 1 keywords in longest_first(), so rules with `shared` keywords in common have one of them in common.
    """
    each = rules.where("rule_id is not null").select("rule_id", low_keywords().alias("_k"), condition_words().alias("_w")).where(F.size("_k") >= shared)
    lead = F.transform(F.slice(longest_first(F.col("_k")), F.lit(1), F.size("_k") - shared + 1), lambda k: F.xxhash64(k))
    own = ["rule_id", "lead", "n_keywords", "keyword_marks", "n_words", "word_marks"]
    each = each.select("rule_id", lead.alias("lead"), F.size("_k").alias("n_keywords"), marks(F.col("_k")).alias("keyword_marks"), F.size("_w").alias("n_words"), marks(F.col("_w")).alias("word_marks"), "_w")
    if likeness <= 0:
        return each.select(F.explode("lead").alias("keyword"), *own)
    ranked = each.withColumn("_h", F.xxhash64("_w")).withColumn("word", F.explode("_w")).drop("_w").join(counts, "word").groupBy(*own, "_h").agg(F.array_sort(F.collect_set(F.struct("n", "word"))).alias("_w"))
    n, need = F.col("n_words"), F.ceil(F.col("n_words") * likeness - 1e-9).cast("int")
    first = lambda size: F.slice(F.transform("_w", lambda w: w["word"]), F.lit(1), F.greatest(size, F.lit(0)))
    two, none = first(n - F.greatest(need, F.lit(2)) + 2), F.array().cast("array<bigint>")
    pairs = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.xxhash64(x, y))))
    # A constraint of more words than LONG is like none of less than `likeness` times as many.
    keys = F.concat(F.when(n <= LONG, pairs).otherwise(none), F.when((need <= 1) | (n >= LONG * likeness), F.transform(first(n - need + 1), lambda w: F.xxhash64(w))).otherwise(none))
    return ranked.select(F.explode(F.array_distinct(keys)).alias("keyword"), *own)


def meeting(left: DataFrame, right: DataFrame, shared: int, likeness: float) -> DataFrame:
    """a, b: the rules of two settled tables of leading() that may be similar by their numbers of words and their marks.

    Rules in a crowd at one key must have a leading keyword in common as well.
    """
    of = lambda rows, end: rows.select("keyword", *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "keyword"])
    rows, others, by = of(left, "a"), of(right, "b"), ["keyword"]
    crowded = settled(right.groupBy("keyword").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD), "crowded-keys")
    if likeness > 0 and not crowded.isEmpty():
        parts = lambda rows, end: rows.join(shuffled(crowded), "keyword", "left").withColumn("part", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.col(f"lead_{end}"))))
        rows, others, by = parts(rows, "a").drop("_n", "lead_a"), parts(others, "b").drop("_n", "lead_b"), ["keyword", "part"]
    apart = lambda name: F.bit_count(F.col(f"{name}_a").bitwiseXOR(F.col(f"{name}_b")))
    words = (F.col("n_words_a") + F.col("n_words_b")) * ((1 - likeness) / (1 + likeness)) + 1e-6 if likeness > 0 else F.lit(64)
    near = (apart("word_marks") <= words) & (apart("keyword_marks") <= F.col("n_keywords_a") + F.col("n_keywords_b") - 2 * shared)
    if left is right:
        near &= F.col("rule_id_a") < F.col("rule_id_b")
    return rows.join(others, by).where(near).select(F.col("rule_id_a").alias("a"), F.col("rule_id_b").alias("b")).distinct()


def alike(pairs: DataFrame, left: DataFrame, right: DataFrame, shared: int, likeness: float) -> DataFrame:
    """The pairs a, b, of rules of `left` and `right`, that are similar."""
    of = lambda rules, end: rules.select(F.col("rule_id").alias(end), low_keywords().alias(f"k{end}"), condition_words().alias(f"w{end}"))
    rows = pairs.select("a", "b").distinct().join(of(left, "a"), "a").join(of(right, "b"), "b")
    index = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return rows.where((F.size(F.array_intersect("ka", "kb")) >= shared) & (index >= likeness)).select("a", "b")


def similar_rules(rules: DataFrame, shared: int = 3, likeness: float = 0.6) -> DataFrame:
    """a, b: pairs of rules with `shared` keywords or more in common and the same constraint.

    Found by rare words, not by comparing all pairs.  Constraints are the same if equal after
    lower-casing and closing up blanks, or if their words have a Jaccard index of `likeness`.
    """
    each = settled(leading(rules, word_counts(rules), shared, likeness), "leading")
    return alike(settled(meeting(each, each, shared, likeness), "met-rules"), rules, rules, shared, likeness)


def copies(rules: DataFrame, shared: int = 3, likeness: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of a rule and another with the same keywords and words, the first of which is a, and the rules that are no such b and may be similar to others."""
    looks = F.xxhash64(F.array_sort(low_keywords()), F.array_sort(condition_words())), F.hash(F.array_sort(condition_words()), F.array_sort(low_keywords()))
    class_of = rules.where("rule_id is not null").select("*", looks[0].alias("_h"), looks[1].alias("_g"), F.size(low_keywords()).alias("_n"))
    class_of = settled(class_of.where(F.col("_n") >= shared), "rule-looks")
    first = settled(class_of.groupBy("_h", "_g").agg(F.min("rule_id").alias("a")), "first-rules")
    stars = class_of.join(first, ["_h", "_g"]).where("rule_id != a").select("a", F.col("rule_id").alias("b"))
    # Hashes may collide, so a star's pairs are looked at like any others.
    stars = settled(alike(stars, class_of, class_of, shared, likeness), "alike-rules")
    return stars, class_of.join(stars.select(F.col("b").alias("rule_id")), "rule_id", "left_anti").select(*rules.columns)


def linking_pairs(rules: DataFrame, shared: int = 3, likeness: float = 0.6) -> DataFrame:
    """Pairs a, b of similar rules that connect all that similar_rules() does: rules with the same keywords and words go by the first of them, to which each is linked."""
    stars, rest = copies(rules, shared, likeness)
    return stars.unionByName(similar_rules(rest, shared, likeness))


def merge_groups(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """rule_id, root: the least id that similar pairs lead to; a loop of joins that ends when nothing changes.

    Each round takes the least root of the neighbours and then that root's own root, so paths shorten as they go. Rules without a pair take no part in it.
    """
    both = settled(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "rule-pairs")
    root = settled(rules.select("rule_id").distinct().join(both, F.col("rule_id") == F.col("a"), "left_semi").select("rule_id", F.col("rule_id").alias("root")), "rule-roots")
    while True:
        near = both.join(root, both["b"] == root["rule_id"]).groupBy("a").agg(F.min("root").alias("other"))
        new = settled(root.join(near, root["rule_id"] == near["a"], "left").select("rule_id", F.least("root", F.coalesce("other", "root")).alias("new"), "root"), "rule-roots")
        if new.where("new != root").isEmpty():
            break
        root = settled(shortened(new.select("rule_id", F.col("new").alias("root"))), "rule-roots")
    return rules.select("rule_id").join(root, "rule_id", "left").select("rule_id", F.coalesce("root", "rule_id").alias("root"))


def shortened(root: DataFrame) -> DataFrame:
    """rule_id, root where each root is replaced by its own."""
    jump = root.select(F.col("rule_id").alias("via"), F.col("root").alias("beyond"))
    return root.join(jump, F.col("root") == F.col("via"), "left").select("rule_id", F.coalesce("beyond", "root").alias("root"))


#: What is kept of a rule between increments; parent is another rule of its group, or itself in the group's root.
KEPT = "rule_id string, severity string, keywords array<string>, condition string, sources array<string>, parent string"


class Consolidation:
    """The groups of similar rules, kept between runs in the folder `path` and brought up to date with each increment of new rules.

    Tables of buckets hold the rules, with a parent each, which rules have a key of leading(), and how rare words are.  An increment reads the buckets of its
    own words and keys and of the rules that these lead to, follows their parents to the roots, joins the groups that new rules connect, and
    writes the new rules and the roots that have got a new parent; rules of other groups are neither read nor written.  After any
    increments the groups are those of one run over all rules.
    """

    def __init__(self, spark: SparkSession, path: str, shared: int = 3, likeness: float = 0.6, buckets: int = BUCKETS):
        self.shared, self.likeness = shared, likeness
        self.rules = BucketTable(spark, f"{path}/rules", "rule_id", KEPT, buckets)
        self.keywords = BucketTable(spark, f"{path}/keywords", "keyword", LEADING, buckets)
        self.words = BucketTable(spark, f"{path}/words", "word", "word string, n long", buckets)

    def add(self, rules: DataFrame, version: int) -> None:
        """Adds `rules` (rule_id, severity, keywords, condition, sources) as increment `version`, which replaces itself if it is added again.

        A rule whose id is known stays as it is; of rows of one id the first in the order of their values counts; rules without id are left out.
        """
        columns = ["rule_id", "severity", "keywords", "condition", "sources"]
        first = settled(rules.where("rule_id is not null").groupBy("rule_id").agg(F.min(F.struct(*columns[1:])).alias("r")).select("rule_id", "r.*"), "added-rules")
        before = self.rules.read(below=version, only=self.rules.touched(first))
        new = settled(first.join(before.select("rule_id"), "rule_id", "left_anti"), "new-rules")
        stars, rest = copies(new, self.shared, self.likeness)
        rest = settled(rest, "different-rules")
        lead = settled(leading(rest, self.counts(rest, version), self.shared, self.likeness), "new-keywords")
        touched = self.keywords.touched(lead)
        held = self.keywords.read(below=version, only=touched)
        met = settled(meeting(lead, held, self.shared, self.likeness), "met-rules")
        old = settled(self.known(met.select(F.col("b").alias("rule_id")), version), "old-rules")
        links = alike(met, rest, old, self.shared, self.likeness)
        roots = self.roots(old.select("rule_id", F.col("parent").alias("root")), version)
        links = links.join(roots, F.col("b") == F.col("rule_id")).select("a", F.col("root").alias("b"))
        own = alike(settled(meeting(lead, lead, self.shared, self.likeness), "met-rules"), rest, rest, self.shared, self.likeness)
        links = settled(links.unionByName(stars).unionByName(own).distinct(), "new-links")
        nodes = new.select("rule_id").unionByName(links.join(new, F.col("b") == F.col("rule_id"), "left_anti").select(F.col("b").alias("rule_id"))).distinct()
        joined = settled(merge_groups(nodes, links), "joined-rules")
        moved = joined.where("rule_id != root").join(new.select("rule_id"), "rule_id", "left_anti")
        again = self.known(moved, version).drop("parent").join(moved.withColumnRenamed("root", "parent"), "rule_id")
        added = new.join(joined.withColumnRenamed("root", "parent"), "rule_id")
        self.rules.upsert(settled(added.unionByName(again), "changed-rules"), version)
        self.keywords.replace(held.unionByName(lead.select(*held.columns)), version, touched)

    def counts(self, rules: DataFrame, version: int) -> DataFrame:
        """word, n for the words of the rules of an increment: how rare a word was when it came first, which orders it for good, so that keys of all increments meet."""
        seen = settled(word_counts(rules), "seen-words")
        touched = self.words.touched(seen)
        held = self.words.read(below=version, only=touched)
        every = settled(held.unionByName(seen.join(held, "word", "left_anti")), "words")
        self.words.replace(every, version, touched)
        return every

    def known(self, ids: DataFrame, version: int) -> DataFrame:
        """The rows of rules before `version`, from their buckets alone."""
        return self.rules.read(below=version, only=self.rules.touched(ids)).join(ids.select("rule_id").distinct(), "rule_id", "left_semi")

    def roots(self, root: DataFrame, version: int) -> DataFrame:
        """rule_id, root: parents followed until they are roots."""
        root = settled(root, "roots")
        while True:
            up = self.known(root.select(F.col("root").alias("rule_id")), version).select(F.col("rule_id").alias("via"), "parent")
            new = settled(root.join(up, F.col("root") == F.col("via")).select("rule_id", F.col("parent").alias("root"), (F.col("parent") != F.col("root")).alias("moved")), "roots")
            if new.where("moved").isEmpty():
                return new.drop("moved")
            root = new.drop("moved")

    def groups(self) -> DataFrame:
        """rule_id, root of all rules."""
        root = self.rules.read().select("rule_id", F.col("parent").alias("root"))
        while True:
            jump = root.select(F.col("rule_id").alias("via"), F.col("root").alias("beyond"))
            end = F.coalesce("beyond", "root")
            new = settled(root.join(jump, F.col("root") == F.col("via"), "left").select("rule_id", end.alias("root"), (end != F.col("root")).alias("moved")), "roots")
            root = new.drop("moved")
            if new.where("moved").isEmpty():
                return root

    def consolidated(self) -> DataFrame:
        """One rule for each group, as consolidate() has it."""
        return consolidate(self.rules.read().drop("parent"), self.groups())


def consolidate(rules: DataFrame, root: DataFrame) -> DataFrame:
    """One rule for each group: the more specific one, with the sources and keywords of all, sorted by severity and numbered R-001 on."""
    order = F.struct(-F.length(F.coalesce("condition", F.lit(""))), severity_order(F.col("severity")), "rule_id")
    kept = [c for c in rules.columns if c not in ("sources", "keywords")]
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    best = rules.join(root, "rule_id").groupBy("root").agg(F.min_by(F.struct(*kept), order).alias("_r"), every("sources"), every("keywords")).select("root", "_r.*", "sources", "keywords")
    number = F.row_number().over(Window.orderBy(severity_order(F.col("severity")), "rule_id"))
    return best.withColumn("number", F.format_string("R-%03d", number)).drop("root")


def dispatched(agents: DataFrame, skills: DataFrame) -> DataFrame:
    """agent, skill: the agents (agent, category) that run each skill (skill, category), by category; a skill without one is run by none."""
    return agents.join(skills, "category").select("agent", "skill")


def cross_document(sightings: DataFrame, least: int = 2) -> DataFrame:
    """rule_id, n_sources, severity: rules of two sources or more, with the highest severity."""
    order = severity_order(F.col("severity"))
    rows = sightings.groupBy("rule_id").agg(F.count_distinct("source").alias("n_sources"), F.min(order).alias("_o")).where(F.col("n_sources") >= least)
    return rows.select("rule_id", "n_sources", F.element_at(F.array(*map(F.lit, (*SEVERITIES, "unknown"))), F.col("_o")).alias("severity"))


def parsed_condition(condition: Column) -> Column:
    """struct kind, a, b of conditions on diagrams: `node:X in group:Y`, `edge:A->B exists`, `edge:A->B missing`, `node:X exists`, `fan-out:X > N`."""
    get = lambda pattern, g: F.trim(F.regexp_extract(condition, pattern, g))
    member, edge, node, fan = r"^node:(.+?) in group:(.+)$", r"^edge:(.+?)\s*->\s*(.+?) (exists|missing)$", r"^node:(.+?) exists$", r"^fan-out:(.+?)\s*>\s*(\d+)$"
    of = lambda kind, a, b: F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"))
    return (F.when(condition.rlike(member), of(F.lit("member"), get(member, 1), get(member, 2)))
            .when(condition.rlike(edge), of(F.concat(F.lit("edge_"), get(edge, 3)), get(edge, 1), get(edge, 2)))
            .when(condition.rlike(node), of(F.lit("node"), get(node, 1), F.lit(None).cast("string")))
            .when(condition.rlike(fan), of(F.lit("fan_out"), get(fan, 1), get(fan, 2))))


def structures_found(conditions: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """diagram_id, rule_id for `conditions` (rule_id, ast_condition) whose node, edge, member or fan-out a diagram has; a missing edge counts where it is there.

    Labels are compared in lower case.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    cond = conditions.select("rule_id", parsed_condition(F.col("ast_condition")).alias("c")).where("c is not null").select("rule_id", "c.*").withColumn("a", low("a")).withColumn("b", low("b"))
    named = nodes.select("diagram_id", "id", low("label").alias("name"))
    ends = edges.join(named.select("diagram_id", F.col("id").alias("source"), F.col("name").alias("s")), ["diagram_id", "source"]).join(named.select("diagram_id", F.col("id").alias("target"), F.col("name").alias("t")), ["diagram_id", "target"])
    member = groups.select("diagram_id", low("label").alias("g"), F.explode("children").alias("id")).join(named, ["diagram_id", "id"])
    fan = ends.groupBy("diagram_id", "s").agg(F.count_distinct("target").alias("n"))
    hits = [
        cond.where("kind = 'node'").join(named, F.col("a") == F.col("name")),
        cond.where("kind = 'member'").join(member, (F.col("a") == F.col("name")) & (F.col("b") == F.col("g"))),
        cond.where("kind in ('edge_exists', 'edge_missing')").join(ends, (F.col("a") == F.col("s")) & (F.col("b") == F.col("t"))),
        cond.where("kind = 'fan_out'").join(fan, (F.col("a") == F.col("s")) & (F.col("n") > F.col("b").try_cast("int")))]
    found = None
    for h in hits:
        part = h.select("diagram_id", "rule_id").distinct()
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def conditions_met(rules: DataFrame, diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """diagram_id, rule_id, met for rules with an ast_condition that is one; a row for each diagram and rule."""
    cond = rules.where(F.col("ast_condition").isNotNull()).select("rule_id", "ast_condition", parsed_condition(F.col("ast_condition"))["kind"].alias("kind")).where("kind is not null")
    found = structures_found(cond, nodes, edges, groups).withColumnRenamed("diagram_id", "doc_id")
    rows = keywords.listed(diagrams.select(F.col("diagram_id").alias("doc_id")), cond, found.join(diagrams.select(F.col("diagram_id").alias("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(keywords.few(cond.select("rule_id", "kind")), "rule_id")
    return rows.select(F.col("doc_id").alias("diagram_id"), "rule_id", F.when(F.col("kind") == "edge_missing", ~F.col("found")).otherwise(F.col("found")).alias("met"))


#: A condition is clauses between OR, of literals between AND, each with NOT before it or not: a test of a diagram or a keyword.
OR, AND, NOT = r"\s+OR\s+", r"\s+AND\s+", r"^NOT\s+"


def literals(rules: DataFrame) -> DataFrame:
    """rule_id, clause, literal, negated: the conditions (rule_id, condition) in disjunctive form; "edge:A->B missing" is "NOT edge:A->B exists"."""
    clause = rules.where(F.trim(F.coalesce("condition", F.lit(""))) != "").select("rule_id", F.posexplode(F.split(F.trim("condition"), OR)).alias("clause", "c"))
    rows = clause.select("rule_id", "clause", F.explode(F.split("c", AND)).alias("l")).withColumn("l", F.trim("l"))
    plain = F.regexp_replace("l", NOT, "")
    missing = plain.rlike("^edge:.+ missing$")
    return rows.select("rule_id", "clause", F.regexp_replace(plain, "^(edge:.+) missing$", "$1 exists").alias("literal"), (F.col("l").rlike(NOT) != missing).alias("negated")).distinct()


def joint_findings(rules: DataFrame, docs: DataFrame, diagrams: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, rule_id: the rules (rule_id, condition) that documents meet by their text and their diagrams (doc_id, diagram_id) together.

    Each different literal is looked for once, keywords by their index and tests in the diagrams, and found where any diagram of the document has it.  Documents meet
    clauses by the literals that they have: one is met with all of its plain literals and none of its negated ones.  Clauses of negated literals
    alone are met where nothing is found; they alone are listed for every document.  Literals that contradict each other are never met together.
    """
    parts = settled(literals(rules), "literals")
    distinct = parts.select("literal").distinct()
    tests = distinct.where(parsed_condition(F.col("literal")).isNotNull())
    words = distinct.where(parsed_condition(F.col("literal")).isNull())
    there = structures_found(tests.select(F.col("literal").alias("rule_id"), F.col("literal").alias("ast_condition")), nodes, edges, groups)
    there = diagrams.select("doc_id", "diagram_id").join(there, "diagram_id").select("doc_id", F.col("rule_id").alias("literal")).distinct()
    said = keywords.hits(docs, words.select(F.col("literal").alias("rule_id"), F.array("literal").alias("keywords"))).select("doc_id", F.col("rule_id").alias("literal"))
    found = there.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(said)
    wants = parts.groupBy("rule_id", "clause").agg(F.count_if(~F.col("negated")).alias("plain"))
    got = found.join(keywords.few(parts), "literal").groupBy("doc_id", "rule_id", "clause").agg(F.count_if(~F.col("negated")).alias("n"), F.count_if("negated").alias("against"))
    met = got.where("against = 0").join(keywords.few(wants.where("plain > 0")), ["rule_id", "clause"]).where("n = plain").select("doc_id", "rule_id")
    bare = wants.where("plain = 0").select(F.to_json(F.struct("rule_id", "clause")).alias("rule_id"))
    broken = got.where("against > 0").join(keywords.few(wants.where("plain = 0")), ["rule_id", "clause"]).select("doc_id", F.to_json(F.struct("rule_id", "clause")).alias("rule_id"))
    free = keywords.listed(docs, bare, broken).where("not found").select("doc_id", F.get_json_object("rule_id", "$.rule_id").alias("rule_id"))
    return met.unionByName(free).distinct()


def probe_questions(rules: DataFrame) -> DataFrame:
    """question, rule_ids: a yes/no question for each set of keywords, whose yes satisfies the rules."""
    text = F.concat(F.lit("Does the document describe "), F.array_join(F.slice("keywords", 1, 3), ", "), F.lit("?"))
    return rules.withColumn("question", text).groupBy("question").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))
