"""Those queries of the llm problems that SQL can express over whole tables, for DuckDB."""

from __future__ import annotations

SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLASS = "coalesce('CWE-' || regexp_extract(list_filter(cwe, lambda x: regexp_matches(x, '[0-9]'))[1], '0*([0-9]+)', 1), 'none')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def fold(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def commit(x: str) -> str:
    t = f"lower({trim(x)})"
    return f"CASE WHEN regexp_matches({t}, '^([0-9a-f]{{12}}|[0-9a-f]{{40}})$') AND NOT regexp_matches({t}, '^0+$') THEN {t} END"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN nullif(regexp_replace({x}, '^0+', ''), '') END"


PROJECT = f"nullif(lower({trim('project')}), '')"
NEED = f"WITH n AS (SELECT count(*) // 10 AS s FROM code_functions), h AS (SELECT target, {CLASS} AS c, count(*) AS n FROM code_functions WHERE target IN (0, 1) GROUP BY ALL), r AS (SELECT t.target, t.cwe, coalesce(h.n, 0) AS available, greatest(min_rows, ceil(share_permille * s / 1000))::BIGINT AS needed FROM cwe_targets t LEFT JOIN h ON h.target = t.target AND h.c = t.cwe, n)"
#: Projects reached from each project over commits that both hold.
LINKED = f"""p AS (SELECT {PROJECT} AS p, {commit('commit_id')} AS c FROM code_functions), short AS (SELECT DISTINCT c FROM p WHERE length(c) = 12),
h AS (SELECT DISTINCT p, CASE WHEN left(c, 12) IN (SELECT c FROM short) THEN left(c, 12) ELSE c END AS c FROM p WHERE p IS NOT NULL AND c IS NOT NULL),
e AS (SELECT DISTINCT x.p AS a, y.p AS b FROM h x JOIN h y USING (c) WHERE x.p <> y.p), g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a)"""
#: Functions with their words and folded texts, their runs of four words, and the pairs that share three in five.
NEAR = f"""f AS (SELECT fn_id, lower(trim(split)) AS split, {PROJECT} AS project, {fold('func')} AS fold, regexp_extract_all(lower(func), '[a-z0-9]+') AS w, hash, commit_id, big_vul_idx FROM code_functions),
s AS (SELECT DISTINCT fn_id, unnest(CASE WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM f WHERE len(w) > 0),
n AS (SELECT fn_id, count(*) AS n FROM s GROUP BY fn_id),
i AS (SELECT a.fn_id AS a, b.fn_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.fn_id < b.fn_id GROUP BY ALL),
near AS (SELECT a, b FROM i JOIN n x ON x.fn_id = a JOIN n y ON y.fn_id = b JOIN f u ON u.fn_id = a JOIN f v ON v.fn_id = b WHERE k * 10 >= 6 * (x.n + y.n - k) AND u.fold <> v.fold AND u.fold <> '' AND v.fold <> '')"""
#: Records in canonical form by origin.
_VALUE = "CASE json_type(v) WHEN 'ARRAY' THEN '[' || array_to_string([regexp_replace(lower(x ->> '$'), '[^a-z0-9]+', '', 'g') FOR x IN v::JSON[]], ',') || ']' WHEN 'NULL' THEN 'null' ELSE regexp_replace(lower(v ->> '$'), '[^a-z0-9]+', '', 'g') END"
RECORDS = f"""o AS (SELECT record_id, raw_line AS l FROM raw_records WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'), k AS (SELECT record_id, l, unnest(list_distinct(json_keys(l))) AS k FROM o), kv AS (SELECT record_id, k, l -> ('$."' || k || '"') AS v FROM k),
r AS (SELECT 'code_functions' AS origin, fn_id AS id, nullif({fold('func')}, '') AS canon FROM code_functions UNION ALL SELECT 'raw_records', record_id, list(k || '=' || {_VALUE} ORDER BY k)::VARCHAR FROM kv GROUP BY record_id),
m AS (SELECT origin, canon, min(id) AS keep_id, count(*) AS copies FROM r WHERE canon IS NOT NULL GROUP BY ALL)"""
#: Overlaps of training and held-out functions by kind: x the training row, y the held-out one.
_HELD = "split IN ('valid', 'test')"
OVERLAP = f"""{NEAR}, q AS (SELECT fn_id, split, project, nullif(fold, '') AS fold, {number(trim('hash'))} AS h, {commit('commit_id')} AS c, {number("regexp_replace(" + trim('big_vul_idx') + ", '\\.0$', '')")} AS b FROM f),
tr AS (SELECT * FROM q WHERE split = 'train'), he AS (SELECT * FROM q WHERE {_HELD}),
ov AS (SELECT 'same' AS kind, tr.fn_id AS x, he.fn_id AS y FROM tr JOIN he ON tr.fold = he.fold UNION ALL SELECT 'hash', tr.fn_id, he.fn_id FROM tr JOIN he ON tr.h = he.h UNION ALL SELECT 'big_vul_idx', tr.fn_id, he.fn_id FROM tr JOIN he ON tr.b = he.b
UNION ALL SELECT 'commit_id', tr.fn_id, he.fn_id FROM tr JOIN he ON left(tr.c, 12) = left(he.c, 12) AND (tr.c = he.c OR length(tr.c) <> length(he.c))
UNION ALL SELECT 'near', tr.fn_id, he.fn_id FROM near JOIN tr ON tr.fn_id IN (near.a, near.b) JOIN he ON he.fn_id IN (near.a, near.b))"""
COVERED = """w AS (SELECT fn_id, lower(trim(split)) AS split, regexp_extract_all(lower(func), '[a-z0-9]+') AS w FROM code_functions),
z AS (SELECT DISTINCT unnest(list_append(coalesce((SELECT list(DISTINCT len(w)) FROM w WHERE split IN ('valid', 'test') AND len(w) BETWEEN 1 AND 4), []), 5)) AS size),
t AS (SELECT DISTINCT size, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS g FROM w, z WHERE split = 'train' AND len(w) >= size),
h AS (SELECT fn_id, len(w) AS words, least(5, len(w)) AS size, w FROM w WHERE split IN ('valid', 'test') AND len(w) > 0),
r AS (SELECT fn_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS g FROM h),
c AS (SELECT fn_id, count(DISTINCT i + j) AS covered FROM (SELECT r.fn_id, i, unnest(range(0, r.size)) AS j FROM r SEMI JOIN t ON t.size = r.size AND t.g = r.g) GROUP BY fn_id)"""
_WORDS = "[lower(x) FOR x IN regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')]"
LEAKED = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k : k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS g FROM d WHERE len(w) >= 12), ir AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k : k + 11], ' ') FOR k IN range(1, len(w) - 10)]) AS g FROM i WHERE len(w) >= 12)"""
#: A source's size in characters stands for its tokens: what is compared is its share.
MIX = f"""d AS (SELECT nullif(lower({trim('source')}), '') AS s, sum(length(text)) AS n FROM documents GROUP BY 1), t AS (SELECT nullif(lower({trim('source')}), '') AS source, sum(weight_permille) AS w, max(max_repeats) AS m FROM mix_targets GROUP BY 1),
x AS (SELECT source, coalesce(n, 0) AS n, w, m, (SELECT sum(n) FROM d WHERE s IS NOT NULL) AS total FROM t LEFT JOIN d ON s = source WHERE source IS NOT NULL)"""
GROUPS = f"""{NEAR}, cl AS (SELECT fn_id, min(fn_id) OVER (PARTITION BY w) AS rep FROM f WHERE len(w) > 0), ln AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM near JOIN cl x ON x.fn_id = a JOIN cl y ON y.fn_id = b WHERE x.rep <> y.rep),
e AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln), g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a), top AS (SELECT a, least(a, min(b)) AS group_id FROM g GROUP BY a), deg AS (SELECT a, count(*) AS links FROM e GROUP BY a)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": NEED + " SELECT target, cwe FROM r WHERE available < needed",
        "p2_found": f"WITH RECURSIVE {LINKED} SELECT a AS project_a, b AS project_b FROM g WHERE a < b",
        "p3_found": f"WITH {NEAR} SELECT a AS fn_id_a, b AS fn_id_b FROM near",
        "p3_groups": f"WITH RECURSIVE {GROUPS} SELECT fn_id, coalesce(group_id, rep) AS group_id, coalesce(links, 0) AS links FROM cl LEFT JOIN top ON top.a = rep LEFT JOIN deg ON deg.a = rep",
        "p5_found": "SELECT fn_id FROM code_functions WHERE length(func) > 6000",
        "p6_found": f"WITH {RECORDS} SELECT origin, keep_id, id AS copy_id FROM r JOIN m USING (origin, canon) WHERE id <> keep_id",
        "p6_collapsed": f"WITH {RECORDS} SELECT origin, keep_id, copies FROM m",
        "p7_found": f"WITH {OVERLAP} SELECT kind, least(x, y) AS fn_id_a, greatest(x, y) AS fn_id_b FROM ov",
        "p7_report": f"WITH {OVERLAP} SELECT split, project, kind, count(DISTINCT y) AS rows, count(*) AS pairs FROM ov JOIN he ON he.fn_id = y GROUP BY ALL",
        "p7_coverage": f"WITH {COVERED} SELECT fn_id, words, coalesce(covered, 0) AS covered FROM h LEFT JOIN c USING (fn_id)",
        "p8_found": f"WITH {LEAKED} SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (g)",
        "p9_found": f"WITH {MIX} SELECT source FROM x WHERE m * n * 1000 < w * total",
    }
