"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .decontaminate import WINDOW as ITEM_WINDOW
from .mixing import BLOCK_TOKENS, BLOCKS_A_SOURCE, SHARDS, STRIDES
from .secrets import BASE, RULES
from .substrings import WINDOW as REPEAT_WINDOW

WORDS = r"[^\x20\x09-\x0D]+"
#: Lower case for A-Z alone.
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VECTORS = """WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT x, b FROM reach JOIN links ON y = a),
low AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN low ON x = vec_id LEFT JOIN n ON a = vec_id"""

_ITEM = rf"regexp_extract_all({LOW.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH i AS (SELECT item_id, {_ITEM} AS w FROM benchmark), d AS (SELECT doc_id, {_ITEM} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS t FROM (SELECT item_id, w, least({ITEM_WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({ITEM_WINDOW}, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, item_id, s, m FROM dw JOIN iw USING (m, t)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _secrets() -> str:
    """Matches between marks, split there; every second piece is a match, and the pieces before it give its place."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        marked = f"regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g')"
        if rule.after:  # the character before, which is none of the class, stands outside the marks
            marked = f"regexp_replace(text, '(^|[^{rule.after}])({pattern})', '\\1' || chr(1) || '\\2' || chr(1), 'g')"
        held = f"regexp_extract(p, '{pattern}', {rule.group})" if rule.group else "p"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s, s + length(p) AS e FROM (
  SELECT doc_id, i, pieces[i] AS p, coalesce(list_sum(list_transform(pieces[1:i-1], lambda x: length(x))), 0)::BIGINT AS s FROM (SELECT doc_id, pieces, unnest(range(2, len(pieces) + 1, 2)) AS i FROM (
    SELECT doc_id, string_split({marked}, chr(1)) AS pieces FROM t))) WHERE length({held}) >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents), f AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) AS n_spans FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM t LEFT JOIN g USING (doc_id)"""


MIX = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size, md5('mix' || doc_id) AS h, md5(coalesce(text, '')) AS t FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, lim / weight <= (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM s1),
s3 AS (SELECT *, CASE WHEN full_ THEN lim ELSE weight * ((total - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ()) END AS target,
    greatest(1, least({BLOCK_TOKENS}, floor(total / (count(*) OVER () * {BLOCKS_A_SOURCE}))))::BIGINT AS block FROM s2),
seats AS (SELECT rank, row_number() OVER (ORDER BY target / (k - 0.5::DOUBLE) DESC, rank, k) AS place, round(total / block)::BIGINT AS blocks
  FROM (SELECT *, unnest(range(1, floor(source_size * 2 / block)::BIGINT + 1)) AS k FROM s3) WHERE target > 0),
q AS (SELECT rank, count(*) AS quota FROM seats WHERE place <= blocks GROUP BY rank),
s4 AS (SELECT s3.*, coalesce(sum(coalesce(quota, 0)) OVER (ORDER BY s3.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_, greatest(1, ceil(source_size / block))::BIGINT AS n,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT AS number, floor(target + 0.5)::BIGINT AS words FROM s3 LEFT JOIN q USING (rank)),
s5 AS (SELECT *, number % n AS shift, list_filter({list(STRIDES)}, lambda p: n % p <> 0) AS strides FROM s4),
src AS (SELECT *, strides[number % len(strides) + 1]::BIGINT AS stride, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS laps, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest FROM s5),
-- The blocks of a source in the order of its permutation, and the words of those before each.
b AS (SELECT rank, i, place, len, sum(len) OVER (PARTITION BY rank ORDER BY place) - len AS before_ FROM (
  SELECT rank, i, (i * stride + shift) % n AS place, least(block, source_size - i * block) AS len FROM (SELECT *, unnest(range(n)) AS i FROM src))),
r AS (SELECT d.doc_id, d.size, src.*, row_number() OVER () AS r, coalesce(sum(d.size) OVER (PARTITION BY src.rank ORDER BY h, d.size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
cut AS (SELECT r, r.rank, laps, n, first_, rest, block, a, size, unnest(range(a // block, (a + size - 1) // block + 1)) AS i, unnest(range(a // block, (a + size - 1) // block + 1)) * block AS lo FROM r WHERE size > 0),
picks AS (SELECT r, (first_ + lap * n + place) % {SHARDS} AS shard, CASE WHEN lap < laps THEN least(a + size, lo + len) - greatest(a, lo) ELSE greatest(0, least(a + size, lo + least(len, greatest(0, rest - before_))) - greatest(a, lo)) END AS w
  FROM (SELECT *, unnest(range(laps + 1)) AS lap FROM cut) JOIN b USING (rank, i)),
by_shard AS (SELECT r, shard, sum(w)::BIGINT AS w FROM picks GROUP BY r, shard),
taken AS (SELECT r, sum(w)::BIGINT AS taken, list_transform(range({SHARDS}), lambda s: coalesce(map_from_entries(list({{'k': shard, 'v': w}}))[s], 0)) AS shard_taken FROM by_shard GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, array_to_string(coalesce(shard_taken, list_transform(range({SHARDS}), lambda s: 0::BIGINT)), ',') AS shard_taken FROM r LEFT JOIN taken USING (r)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOW.format('text')}, '{WORDS}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + {REPEAT_WINDOW - 1}), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT_WINDOW} + 2)) AS s FROM w WHERE len(w) >= {REPEAT_WINDOW})),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + {REPEAT_WINDOW})) AS p FROM again) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) LEFT JOIN (SELECT doc_id, unnest(g) AS i, TRUE AS dead FROM gone) USING (doc_id, i) WHERE dead IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_DRAW = "-1 / ln((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
SHARDS = f"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
p AS (SELECT *, (SELECT arg_max(s, {_DRAW}) FROM range(8) t(s)) AS shard, (SELECT arg_max(s, {_DRAW}) FROM range(9) t(s)) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || text_crc32), size, text_crc32) - 1 AS slot, grown_shard FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op2_vectors": VECTORS, "op3_decontaminate": DECONTAMINATION, "op4_secrets": _secrets(), "op5_mix": MIX, "op7_jaccard": JACCARD, "op8_substrings": SUBSTRINGS, "op10_shard": SHARDS}
