"""The core queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from siltworks.operators.detect import ALIASES, CONFIDENCE_BY_FUNCTION, CONFIDENCE_BY_TYPE, FORMAT_STRING, PENALTY, RULES, SECRET, SEVERITY_WEIGHT, SQL_JOINTS, SQL_WORDS, WEAK
from siltworks.operators.metrics import SWEEP

SP = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WITHIN = SP.replace(r"\t-\r", r"\t\x0b-\r")
q = lambda s: "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def norm(x: str) -> str:
    a = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    b = f"regexp_replace({a}, '[{WITHIN}]+(\\n|$)', '\\1', 'g')"
    return trim(f"regexp_replace({b}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def chash(x: str) -> str:
    return f"sha256(trim(regexp_replace({x}, '[{SP}]+', ' ', 'g')))"


def case(values: dict, x: str, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


PRED = "(SELECT DISTINCT fn_id, split, score, raw_score, target FROM predictions WHERE score IS NOT NULL AND NOT isnan(score) AND target IN (0, 1))"
CWES = f"list_filter([{trim('x')} FOR x IN coalesce(cwe, [])], lambda x: x <> '')"
TOKENS = f"string_split_regex({trim(chr(99) + 'oalesce(func, ' + q('') + ')')}, '\\s+')"


def rates(src: str, by: str, digits: int | None = 9) -> str:
    share = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
    d = lambda a, b: share(a, b) if digits is None else f"round({share(a, b)}, {digits})"
    root = "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"
    return f"SELECT {by}, tn, fp, fn, tp, {d('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {d('tp', 'tp + fp')} AS precision, {d('tp', 'tp + fn')} AS recall, {d('2 * tp', '2 * tp + fp + fn')} AS f1, {d('tp::DOUBLE * tn - fp::DOUBLE * fn', root)} AS mcc FROM ({src})"


def confusion(src: str, flag: str, by: str) -> str:
    c = lambda f, y: f"count(*) FILTER (({flag}) = {f} AND (target = 1) = {y})"
    return rates(f"SELECT {by}, {c('false', 'false')} AS tn, {c('true', 'false')} AS fp, {c('false', 'true')} AS fn, {c('true', 'true')} AS tp FROM {src} GROUP BY {by}", by)


GRID = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in SWEEP) + "]) AS threshold)"
SWEEP_SQL = rates(f"SELECT split, threshold, count(*) FILTER (score < threshold AND target = 0) AS tn, count(*) FILTER (score >= threshold AND target = 0) AS fp, count(*) FILTER (score < threshold AND target = 1) AS fn, count(*) FILTER (score >= threshold AND target = 1) AS tp FROM {PRED}, {GRID} GROUP BY split, threshold", "split, threshold")
SWEEP_RAW = rates(f"SELECT split, threshold, count(*) FILTER (score < threshold AND target = 0) AS tn, count(*) FILTER (score >= threshold AND target = 0) AS fp, count(*) FILTER (score < threshold AND target = 1) AS fn, count(*) FILTER (score >= threshold AND target = 1) AS tp FROM {PRED}, {GRID} GROUP BY split, threshold", "split, threshold", None)

KEYS = " UNION ALL ".join(
    f"SELECT split, fn_id, target, '{d}' AS dim, {e} AS key FROM code_functions WHERE {e} <> ''"
    for d, e in {"exact_code": f"CASE WHEN length({trim('func')}) > 0 THEN sha256(func) END", "normalized_code": f"CASE WHEN length({trim('func')}) > 0 THEN {chash('func')} END", "hash": "hash", "idx": "idx", "big_vul_idx": "big_vul_idx", "commit_id": "commit_id", "project": "project"}.items()
)
RANK = "CASE {} WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END"
LEAK = f"WITH k AS ({KEYS}), l AS (SELECT DISTINCT fn_id, dim FROM k WHERE split = 'train' AND dim IN ('exact_code', 'normalized_code', 'hash', 'idx', 'big_vul_idx') AND EXISTS (SELECT 1 FROM k h WHERE h.split <> 'train' AND h.dim = k.dim AND h.key = k.key))"

REL = f"""WITH p AS {PRED}, e AS (SELECT split, list_distinct(quantile_cont(score, [{', '.join(str(i / 10) for i in range(11))}])) AS d FROM p GROUP BY split),
b AS (SELECT p.split, score, target, len(list_filter(list_sort(d)[2:len(d) - 1], lambda x: x <= score)) AS bin FROM p JOIN e USING (split)),
r AS (SELECT split, bin, count(*) AS n, round(avg(score), 9) AS mean_predicted, round(avg(target::DOUBLE), 9) AS observed_rate FROM b GROUP BY split, bin)"""


def finding_sql(key: str, src: str, code: str, lang: str) -> str:
    m = lambda p: f"regexp_matches(text, {q(p)})"
    joint = lambda xs: "(" + " OR ".join(f"contains(text, {q(x)})" for x in xs) + ")"
    out = [f"SELECT {key}, 1 AS detector, 'RULE_BASED' AS type, {q(fn)} AS function, {q(s)} AS severity, {q(c)} AS cwe, line FROM l WHERE lang = {q(l)} AND {m(p)}" for l, fn, p, s, c in RULES]
    out.append(f"SELECT {key}, 2, 'FORMAT_STRING', regexp_extract(text, {q(FORMAT_STRING)}, 1), 'HIGH', 'CWE-134', line FROM l WHERE lang = 'cpp' AND {m(FORMAT_STRING)}")
    out.append(f"SELECT {key}, 3, 'HARDCODED_SECRET', lower(regexp_extract(text, {q(SECRET)}, 1)), 'HIGH', 'CWE-798', line FROM l WHERE {m(SECRET)}")
    out += [f"SELECT {key}, 4, 'WEAK_CRYPTO', {q(fn)}, 'MEDIUM', 'CWE-327', line FROM l WHERE {m(p)}" for fn, p in WEAK]
    joined = f"CASE lang WHEN 'python' THEN {joint(SQL_JOINTS['python'])} WHEN 'javascript' THEN {joint(SQL_JOINTS['javascript'])} ELSE {joint(SQL_JOINTS['other'])} END"
    out.append(f"SELECT {key}, 5, 'SQL_INJECTION', 'SQL_QUERY', 'HIGH', 'CWE-89', line FROM l WHERE {joined} AND regexp_matches(upper(text), {q(SQL_WORDS)})")
    parts = f"string_split_regex({code}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"l AS (SELECT {key}, coalesce({lang}, 'cpp') AS lang, unnest({parts}) AS text, generate_subscripts({parts}, 1) AS line FROM {src} WHERE {code} IS NOT NULL), f AS ({' UNION ALL '.join(out)})"


LANG = f"nullif({case(ALIASES, 'lower(trim(language))', 'lower(trim(language))')}, '')"
FN_FINDINGS = finding_sql("fn_id", "code_functions", "func", "'cpp'")
UNIQUE = f"u AS (SELECT fn_id, type, cwe, line, function, min(detector) AS detector, arg_min(severity, detector) AS severity, {case(CONFIDENCE_BY_FUNCTION, 'function', case(CONFIDENCE_BY_TYPE, 'type', '0.75'))}::DOUBLE AS confidence FROM f GROUP BY ALL)"
RISK = f"""k AS (SELECT c.fn_id, c.split, c.target, count(u.fn_id) AS findings, round(least(1.0, coalesce(sum(CASE WHEN u.fn_id IS NOT NULL THEN {case(SEVERITY_WEIGHT, 'u.severity', '0.4')}::DOUBLE END), 0.0)), 9) AS rule_score,
greatest(0, 100 - coalesce(sum({case(PENALTY, 'u.severity', '0')}), 0))::BIGINT AS security_score FROM code_functions c LEFT JOIN u ON u.fn_id = c.fn_id AND u.type IS NOT NULL GROUP BY ALL)"""
HAS = lambda x, *ws: "(" + " OR ".join(f"contains({x}, {q(w)})" for w in ws) + ")"
CODE = "coalesce(code, '')"
PROFILE_F = f"SELECT nullif(lower({trim('project')}), '') AS project, count(*) AS n, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target IN (0, 1)) AS lab, coalesce(sum(length(func)), 0)::BIGINT AS chars, count(*) FILTER (length(func) > 6000) AS over FROM code_functions GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    loss = "greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x)))"
    return {
        "p4_found": f"SELECT project FROM (SELECT lower({trim('project')}) AS project, count(*) AS n FROM code_functions GROUP BY 1) WHERE project <> '' AND n * 100 >= 4 * (SELECT count(*) FROM code_functions)",
        "p4_profile": f"WITH f AS (SELECT * FROM ({PROFILE_F}) WHERE project IS NOT NULL), t AS (SELECT count(*) AS total FROM code_functions), d AS (SELECT lower({trim('project')}) AS project, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM documents GROUP BY 1) SELECT f.project, f.n AS rows, round(f.n / total, 9) AS share, pos AS positives, lab AS labelled, CASE WHEN lab > 0 THEN round(pos / lab, 9) END AS label_rate, f.chars, over AS oversized, coalesce(d.n, 0) AS documents, coalesce(d.chars, 0) AS document_chars, f.n * coalesce(d.n, 0) AS pairs, f.chars * coalesce(d.n, 0) AS pair_chars, total FROM f LEFT JOIN d ON d.project = f.project, t",
        "raw_line_counts": f"SELECT split, count(*) AS lines, count(*) FILTER (t = '') AS blank, count(*) FILTER (regexp_matches(t, '^\\{{(?s:.)*\\}}$')) AS braced FROM (SELECT split, {trim('coalesce(raw_line, ' + q('') + ')')} AS t FROM raw_records) GROUP BY split",
        "normalized_code": f"SELECT fn_id, length(t) AS chars, md5(t) AS digest FROM (SELECT fn_id, {norm('func')} AS t FROM code_functions)",
        "code_hashes": f"SELECT fn_id, {chash('func')} AS normalized_hash, sha256(func) AS exact_hash FROM code_functions",
        "cwe_lists": f"SELECT fn_id, array_to_string({CWES}, '|') AS cwes FROM code_functions",
        "cwe_frequency": f"SELECT cwe, count(*) AS n FROM (SELECT unnest({CWES}) AS cwe FROM code_functions) GROUP BY cwe",
        "label_distribution": "SELECT split, p AS positives, n AS negatives, CASE WHEN p > 0 THEN round(n / p, 9) END AS ratio, CASE WHEN p > 0 THEN round(least(n / p, 50.0), 9) ELSE 1.0 END AS pos_weight, coalesce(p > 0 AND n / p > 20, false) AS severe FROM (SELECT split, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM code_functions GROUP BY split)",
        "bad_labels": "SELECT coalesce(target::VARCHAR, 'null') AS label, count(*) AS n FROM code_functions WHERE target IS NULL OR target NOT IN (0, 1) GROUP BY 1 ORDER BY n DESC, label LIMIT 5",
        "preprocess_counters": f"WITH t AS (SELECT split, length({norm('func')}) = 0 AS e, NOT coalesce(target IN (0, 1), false) AS b, {chash(norm('func'))} AS h FROM code_functions), c AS (SELECT split, count(*) AS rows_read, count(*) FILTER (e) AS dropped_empty, count(*) FILTER (NOT e AND b) AS dropped_bad_label, CASE WHEN split = 'train' THEN count(*) FILTER (NOT e AND NOT b) - count(DISTINCT h) FILTER (NOT e AND NOT b) ELSE 0 END AS dropped_duplicate FROM t GROUP BY split) SELECT *, rows_read - dropped_empty - dropped_bad_label - dropped_duplicate AS kept FROM c",
        "kept_first": f"SELECT min(fn_id) AS fn_id FROM code_functions WHERE split = 'train' AND target IN (0, 1) AND length({norm('func')}) > 0 GROUP BY {chash(norm('func'))}",
        "length_percentiles": "WITH v AS (SELECT split, length(func) AS v, row_number() OVER (PARTITION BY split ORDER BY length(func)) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM code_functions WHERE func IS NOT NULL) SELECT split, share, v AS value FROM v, (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS share) WHERE i = round_even((n - 1) * share, 0)",
        "length_stats": "SELECT split, min(length(func)) AS shortest, max(length(func)) AS longest, round(avg(length(func)), 6) AS mean FROM code_functions GROUP BY split",
        "token_report": f"SELECT split, count(*) FILTER (n + 2 > 512) AS over_limit, count(*) FILTER (c > 8) AS over_chunks, sum(least(c, 8))::BIGINT AS capped_chunks, round(avg(n), 6) AS mean_tokens FROM (SELECT split, n, CASE WHEN n <= 510 THEN 1 ELSE 1 + ceil((n - 510) / 382)::BIGINT END AS c FROM (SELECT split, len({TOKENS}) AS n FROM code_functions)) GROUP BY split",
        "split_audit": f"WITH k AS ({KEYS}), g AS (SELECT split, dim, key, count(*) AS n, list_sort(list(DISTINCT target) FILTER (target IS NOT NULL)) AS labels FROM k GROUP BY ALL) SELECT l.dim, l.split AS left_split, r.split AS right_split, count(*) AS shared_keys, sum(l.n)::BIGINT AS left_rows, sum(r.n)::BIGINT AS right_rows, count(*) FILTER (coalesce(l.labels, []) IS DISTINCT FROM coalesce(r.labels, [])) AS label_conflicts FROM g l JOIN g r ON l.dim = r.dim AND l.key = r.key AND {RANK.format('l.split')} < {RANK.format('r.split')} GROUP BY ALL",
        "internal_duplicates": f"WITH k AS ({KEYS}), g AS (SELECT split, dim, key, count(*) AS n, count(DISTINCT target) AS labels FROM k GROUP BY ALL) SELECT split, dim, count(*) FILTER (n > 1) AS duplicate_keys, sum(n - 1)::BIGINT AS redundant_rows, count(*) FILTER (labels > 1) AS conflicting_keys FROM g GROUP BY split, dim",
        "leaking_rows": LEAK + " SELECT fn_id, dim FROM l",
        "cleaned_train": LEAK + " SELECT fn_id, target FROM code_functions WHERE split = 'train' AND fn_id NOT IN (SELECT fn_id FROM l)",
        "first_label_conflicts": f"WITH f AS (SELECT split, {chash('func')} AS h, fn_id, target FROM code_functions WHERE length({trim('func')}) > 0), g AS (SELECT split, h, target AS label FROM f QUALIFY row_number() OVER (PARTITION BY split, h ORDER BY fn_id) = 1) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared, count(*) FILTER (a.label IS DISTINCT FROM b.label) AS conflicts FROM g a JOIN g b ON a.h = b.h AND a.split < b.split GROUP BY ALL",
        "chunk_overlap": "WITH g AS (SELECT chunks, split, list_sort(list(DISTINCT target) FILTER (target IS NOT NULL)) AS labels FROM chunked_functions WHERE len(chunks) > 0 GROUP BY chunks, split) SELECT a.split AS split_a, b.split AS split_b, count(*) AS signatures, count(*) FILTER (a.labels <> b.labels) AS conflicting FROM g a JOIN g b USING (chunks) WHERE a.split < b.split GROUP BY ALL",
        "chunk_statistics": "SELECT split, count(*) AS functions, sum(n)::BIGINT AS chunks, round(avg(n), 9) AS mean_chunks, max(n) AS max_chunks, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, count(*) FILTER (truncated) AS truncated, count(*) FILTER (target = 1) AS positives FROM (SELECT *, coalesce(len(chunks), 0) AS n FROM chunked_functions) GROUP BY split",
        "chunk_faults": "SELECT fn_id, split, num_chunks::BIGINT AS told, coalesce(len(chunks), 0) AS counted, len(list_filter(chunks, lambda x: len(x) = 0)) > 0 AS empty_chunk FROM chunked_functions WHERE told <> counted OR empty_chunk",
        "chunk_windows": f"WITH t AS (SELECT fn_id, {TOKENS} AS t FROM code_functions WHERE length({trim('func')}) > 0), n AS (SELECT *, least(8, CASE WHEN len(t) <= 62 THEN 1 ELSE 1 + ceil((len(t) - 62) / 46)::BIGINT END) AS k FROM t), w AS (SELECT fn_id, i AS chunk_no, ['<s>'] || t[i * 46 + 1 : i * 46 + 62] || ['</s>'] AS w FROM n, unnest(range(k)) AS r(i)) SELECT fn_id, chunk_no, len(w) AS tokens, md5(array_to_string(w, ' ')) AS digest FROM w",
        "undersampled": "WITH t AS (SELECT fn_id, target FROM code_functions WHERE split = 'train'), n AS (SELECT fn_id, target FROM t WHERE target = 0 ORDER BY md5('42:' || fn_id), fn_id LIMIT (SELECT count(*) * 10 FROM t WHERE target = 1)) SELECT * FROM n UNION ALL SELECT * FROM t WHERE target = 1",
        "folds": "SELECT fn_id, (row_number() OVER (PARTITION BY target ORDER BY md5('42:' || fn_id), fn_id) - 1) % 5 AS fold FROM code_functions WHERE target IN (0, 1)",
        "confusion_matrix": confusion(PRED, "score >= 0.5", "split"),
        "threshold_sweep": SWEEP_SQL,
        "best_threshold": f"WITH s AS ({SWEEP_RAW}), o AS (SELECT split, threshold, unnest(['f1', 'fbeta', 'mcc', 'recall_at_precision']) AS objective, unnest([f1, CASE WHEN 4.0 * precision + recall = 0 THEN 0.0 ELSE 5.0 * precision * recall / (4.0 * precision + recall) END, mcc, CASE WHEN precision >= 0.5 THEN 1 + recall ELSE precision / 0.5 END]) AS value FROM s) SELECT split, objective, round(max(value), 9) AS value, arg_min(threshold, (-value, threshold)) AS threshold FROM o GROUP BY split, objective",
        "ranking_scores": f"WITH g AS (SELECT split, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM {PRED} GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY split ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY split) AS ps, sum(n) OVER (PARTITION BY split) AS ns FROM g) SELECT split, ps::BIGINT AS positives, ns::BIGINT AS negatives, round(sum(n * (tp - p / 2)) / (ps::DOUBLE * ns), 9) AS roc_auc, round(sum((p / ps::DOUBLE) * (tp::DOUBLE / (tp + fp))), 9) AS average_precision FROM w GROUP BY split, ps, ns",
        "brier": f"SELECT split, count(*) AS n, round(avg((score - target) * (score - target)), 9) AS brier, round(avg(target::DOUBLE), 9) AS positive_rate FROM {PRED} GROUP BY split",
        "reliability_bins": REL + " SELECT * FROM r",
        "calibration_error": REL + " SELECT split, round(sum(n * abs(mean_predicted - observed_rate)) / sum(n), 7) AS ece, round(max(abs(mean_predicted - observed_rate)), 7) AS mce, round(sum(n * sqrt(0.6366197723675814) * sqrt(mean_predicted * (1 - mean_predicted) / n)) / sum(n), 7) AS noise_floor FROM r GROUP BY split",
        "score_separation": f"SELECT split, round(p, 9) AS mean_positive, round(n, 9) AS mean_negative, round(p - n, 9) AS separation FROM (SELECT split, avg(score) FILTER (target = 1) AS p, avg(score) FILTER (target = 0) AS n FROM {PRED} GROUP BY split)",
        "focal_losses": f"WITH a AS (SELECT split, target::DOUBLE AS y, greatest(1e-6, least(1 - 1e-6, score)) AS s FROM {PRED}), b AS (SELECT split, y, ln(s / (1 - s)) AS x FROM a), c AS (SELECT split, y, {loss} AS bce, CASE WHEN y = 1 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END AS pt FROM b) SELECT split, round(avg(CASE WHEN y = 1 THEN 15.0::DOUBLE ELSE 1.0 END * pow(greatest(1 - pt, 1e-7), 2) * bce), 9) AS focal, round(avg(bce), 9) AS bce FROM c GROUP BY split",
        "truncation_by_class": "SELECT split, target, count(*) AS n, round(avg(truncated::INT::DOUBLE), 9) AS rate FROM chunked_functions WHERE target IN (0, 1) GROUP BY ALL",
        "project_slices": f"WITH j AS (SELECT p.*, lower({trim('c.project')}) AS project FROM {PRED} p JOIN code_functions c USING (fn_id) WHERE lower({trim('c.project')}) <> ''), t AS (SELECT project FROM j GROUP BY project ORDER BY count(*) DESC, project LIMIT 12) " + confusion("j SEMI JOIN t USING (project)", "score >= 0.5", "project"),
        "length_decile_slices": f"WITH j AS (SELECT p.score, p.target, length(c.func) AS chars FROM {PRED} p JOIN code_functions c USING (fn_id) WHERE p.split = 'test' AND c.func IS NOT NULL), e AS (SELECT quantile_cont(chars, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM j), b AS (SELECT score, target, len(list_filter(e, lambda x: x <= chars)) AS decile FROM j, e) " + confusion("b", "score >= 0.5", "decile"),
        "language_names": f"SELECT sample_id::BIGINT AS sample_id, {LANG} AS given, CASE WHEN {HAS(CODE, 'public class ', 'private class ', 'System.out.println')} OR (contains({CODE}, 'class ') AND contains({CODE}, 'public static void main')) THEN 'java' WHEN {HAS(CODE, 'def ', 'import ', 'print(', 'elif ')} THEN 'python' WHEN {HAS(CODE, 'console.log', 'function ', 'const ', 'let ', 'var ')} THEN 'javascript' WHEN {HAS(CODE, '#include', 'std::', 'int main', 'using namespace')} THEN 'cpp' ELSE 'unknown' END AS detected FROM code_samples",
        "sample_findings": f"WITH {finding_sql('sample_id', 'code_samples', 'code', LANG)} SELECT sample_id::BIGINT AS sample_id, type, function, severity, cwe, line FROM f",
        "function_findings": f"WITH {FN_FINDINGS} SELECT type, function, severity, cwe, count(*) AS n FROM f GROUP BY ALL",
        "unique_findings": f"WITH {FN_FINDINGS}, {UNIQUE} SELECT fn_id, type, function, cwe, line, severity, confidence FROM u",
        "function_risk": f"WITH {FN_FINDINGS}, {UNIQUE}, {RISK} SELECT fn_id, findings, rule_score, security_score, CASE WHEN security_score >= 90 THEN 'LOW' WHEN security_score >= 70 THEN 'MEDIUM' WHEN security_score >= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM k",
        "rule_baseline": f"WITH {FN_FINDINGS}, {UNIQUE}, {RISK} " + confusion("(SELECT * FROM k WHERE target IN (0, 1))", "rule_score > 0", "split"),
        "identifiers": "SELECT sample_id::BIGINT AS sample_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(code, ''), '[A-Za-z_$][A-Za-z0-9_]*'))), ' ') AS identifiers FROM code_samples",
        "def_use_links": "WITH l AS (SELECT sample_id::BIGINT AS sample_id, unnest(string_split_regex(coalesce(code, ''), '\\r\\n|[\\n\\r]')) AS text, generate_subscripts(string_split_regex(coalesce(code, ''), '\\r\\n|[\\n\\r]'), 1) - 1 AS line FROM code_samples), e AS (SELECT sample_id, line, regexp_extract(text, '([A-Za-z_]\\w*)\\s*=\\s*[^=]', 1) AS def, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\\w*'))) AS variable FROM l) SELECT * FROM (SELECT sample_id, variable, line, last_value(CASE WHEN def = variable THEN line END IGNORE NULLS) OVER (PARTITION BY sample_id, variable ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_line FROM e) WHERE def_line IS NOT NULL",
        "run_log_kinds": "SELECT kind, count(*) AS events, count(DISTINCT run_id) AS runs FROM run_log GROUP BY kind",
        "run_log_hours": "SELECT (epoch(ts)::BIGINT // 3600)::BIGINT AS hour, kind, count(*) AS events FROM (SELECT DISTINCT ON (log_id) log_id, kind, ts FROM run_log WHERE ts IS NOT NULL AND log_id IS NOT NULL) GROUP BY ALL",
    }
