"""Queries of taint, the whole analysis, program graphs and pooling, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import analyzer, detect, graphs, metrics, pooling, taint
from siltworks.plans.runtime import spread, table
from siltworks.operators.detect import SEVERITY_WEIGHT
from siltworks.queries import rounded
from siltworks.sql import FN_FINDINGS, LANG, q, trim


def functions(spark, d):
    return spread(table(spark, d, "code_functions"))


def samples(spark, d):
    return table(spark, d, "code_samples").withColumn("sample_id", F.col("sample_id").cast("long"))


def taint_flows(spark, d):
    return taint.flows(functions(spark, d), "fn_id", "func", "cpp").select("fn_id", F.col("line").cast("long").alias("line"), "sink", "source_variable", "cwe", "severity")


def sample_flows(spark, d):
    """Flows in the samples, each in its own language."""
    f = taint.flows(samples(spark, d), "sample_id", "code", detect.language_name(F.col("language")))
    return f.select("sample_id", F.col("line").cast("long").alias("line"), "sink", "source_variable", "cwe", "severity")


def taint_closure(spark, d):
    c = taint.taint_closure(functions(spark, d), "fn_id", "func")
    return c.select("fn_id", F.array_join("tainted", " ").alias("tainted"))


def taint_sinks(spark, d):
    return taint.sinks(spark)


def full_analysis(spark, d):
    """Findings of all detectors and flows, with risk."""
    return analyzer.analysed(functions(spark, d), "fn_id", "func", "cpp").withColumn("rule_score", F.round("rule_score", 9))


def detector_scores(spark, d):
    """The three scorers of every function."""
    return rounded(analyzer.scores(functions(spark, d)))


def graph_counts(spark, d):
    return graphs.Graphs(functions(spark, d), "fn_id", "func").counts().withColumnRenamed("key", "fn_id")


def graph_edges(spark, d):
    """Edges of the united graphs by kind."""
    g = graphs.Graphs(functions(spark, d), "fn_id", "func")
    return g.edges().groupBy("graph_type", "type").agg(F.count(F.lit(1)).alias("n"))


def def_use_edges(spark, d):
    g = graphs.Graphs(samples(spark, d), "sample_id", "code", detect.language_name(F.col("language")))
    return g.def_use().withColumnRenamed("key", "sample_id")


def parse_summaries(spark, d):
    s = graphs.Graphs(functions(spark, d), "fn_id", "func").summary()
    return s.select(F.col("key").alias("fn_id"), "line_count", "function_count", F.array_join("functions", " ").alias("functions"), "ast_node_count", "has_syntax_error")


def finding_links(spark, d):
    """The graph nodes at the findings of every function."""
    f = functions(spark, d)
    found = analyzer.unique_findings(f, "fn_id", "func", "cpp").withColumnRenamed("fn_id", "key")
    return graphs.Graphs(f, "fn_id", "func").links(found).select(F.col("key").alias("fn_id"), "type", "function", "line", "node_type", "graph_type", "id")


def function_identifiers(spark, d):
    """The identifiers of every function's text, counted and joined."""
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("func", F.lit("")), F.lit(r"[A-Za-z_$][A-Za-z0-9_]*"), F.lit(0))))
    return functions(spark, d).select("fn_id", F.size(ids).cast("long").alias("n"), F.md5(F.array_join(ids, " ")).alias("digest"))


def pooled_embeddings(spark, d):
    """Embeddings pooled by label, by mean, largest value and attention (scored by their first value): first two dimensions."""
    e = table(spark, d, "embeddings").withColumn("score", F.col("embedding")[0].cast("double"))
    out = None
    for m in pooling.METHODS:
        x = pooling.pooled(e, "label", "embedding", m, "score").select("label", F.lit(m).alias("method"), F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[1], 5).alias("second"))
        out = x if out is None else out.unionByName(x)
    return out


def collated_chunks(spark, d):
    """Chunks padded to 512 ids, two at most a function: sums of ids and masks."""
    c = pooling.collated(table(spark, d, "chunked_functions").where(F.size("chunks") > 0).select("fn_id", "chunks").dropDuplicates(["fn_id"]), most=2)
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return c.select("fn_id", F.col("chunk_no").cast("long").alias("chunk_no"), add("ids").alias("ids"), add("mask").alias("kept"))


def head_scores(spark, d):
    """A linear head over the embeddings, fitted on three in four of them for odd labels, and scored on the rest."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") % 2).cast("int").alias("target"))
    held = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    model, _ = pooling.fitted(e.where(~held), e.where(held), epochs=2)
    return rounded(metrics.ranking(pooling.predicted(e.where(held), model).withColumn("part", F.lit("held")), "part"), 3)


QUERIES = [head_scores, taint_flows, sample_flows, taint_closure, taint_sinks, full_analysis, detector_scores, graph_counts, graph_edges, def_use_edges, parse_summaries, finding_links, function_identifiers, pooled_embeddings, collated_chunks]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# ---- SQL

EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _event_sql(src: str, key: str, code: str, lang: str) -> str:
    """(key, n, line, kind, name, words, sink): the events of taint, numbered in order."""
    parts = f"string_split_regex({code}, '{EOL}')"
    ids = lambda x: f"list_distinct(regexp_extract_all({x}, '[A-Za-z_$][A-Za-z0-9_]*'))"
    out, step = [], 0
    for k, patterns in taint.SOURCES.items():
        for p in patterns:
            out.append(f"SELECT key, line, {step} AS step, 'source' AS kind, regexp_extract(t, {q(p)}, 1) AS name, []::VARCHAR[] AS words, '' AS sink FROM ln WHERE lang = {q(k)} AND regexp_matches(t, {q(p)})")
            step += 1
    for k, p in taint.ASSIGNMENT.items():
        where = f"lang = {q(k)}" if k != "cpp" else "lang IN ('cpp', 'python')"
        out.append(f"SELECT key, line, {step}, 'assign', regexp_extract(t, {q(p)}, 1), {ids(f'regexp_extract(t, {q(p)}, 2)')}, '' FROM ln WHERE {where} AND regexp_matches(t, {q(p)})")
        step += 1
    for s in taint.SANITIZERS:
        direct, copy = rf"\b{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)", rf"\b(?:const|let|var|String|Object)?\s*([A-Za-z_$]\w*)\s*=\s*{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)"
        out.append(f"SELECT key, line, {step}, 'checked', regexp_extract(t, {q(direct)}, 1), [], '' FROM ln WHERE regexp_matches(t, {q(direct)})")
        out.append(f"SELECT key, line, {step + 1}, 'safe', regexp_extract(t, {q(copy)}, 1), [regexp_extract(t, {q(copy)}, 2)], '' FROM ln WHERE regexp_matches(t, {q(copy)})")
        step += 2
    for k, all_ in taint.SINKS.items():
        for s, _, _ in all_:
            p = taint._sink_pattern(s)
            out.append(f"SELECT key, line, {step}, 'sink', '', {ids(f'regexp_extract(t, {q(p)}, 1)')}, {q(s)} FROM ln WHERE lang = {q(k)} AND regexp_matches(t, {q(p)})")
            step += 1
    return f"l0 AS (SELECT {key}::BIGINT AS key, {lang} AS lang, unnest({parts}) AS raw, generate_subscripts({parts}, 1) AS line FROM {src} WHERE {code} IS NOT NULL), ln AS (SELECT key, lang, line, {trim('raw')} AS t FROM l0 WHERE length({trim('raw')}) > 0), ev0 AS ({' UNION ALL '.join(out)}), ev AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line, step) AS n FROM ev0 WHERE key IN (SELECT key FROM ev0 WHERE kind = 'source'))"


def flow_sql(src: str, key: str, code: str, lang: str) -> str:
    act = "list_filter(s.tainted, lambda x: NOT list_contains(s.clean, x))"
    hit = f"list_has_any(e.words, {act})"
    tainting = f"(e.kind = 'source' OR (e.kind = 'assign' AND {hit}))"
    safe, checked = "(e.kind = 'safe' AND list_contains(s.tainted, e.words[1]))", "(e.kind = 'checked' AND list_contains(s.tainted, e.name))"
    tainted = f"CASE WHEN {tainting} THEN list_distinct(list_append(s.tainted, e.name)) WHEN {safe} THEN list_filter(s.tainted, lambda x: x <> e.name) ELSE s.tainted END"
    clean = f"CASE WHEN {tainting} THEN list_filter(s.clean, lambda x: x <> e.name) WHEN {safe} OR {checked} THEN list_distinct(list_append(s.clean, e.name)) ELSE s.clean END"
    found = f"CASE WHEN e.kind = 'sink' AND {hit} THEN list_min(list_filter(e.words, lambda w: list_contains(s.tainted, w) AND NOT list_contains(s.clean, w))) END"
    kinds = {s: (c, v) for all_ in taint.SINKS.values() for s, c, v in all_}
    pick = lambda i: "CASE sink " + " ".join(f"WHEN {q(s)} THEN {q(x[i])}" for s, x in kinds.items()) + " END"
    return f"{_event_sql(src, key, code, lang)}, st AS (SELECT DISTINCT key, 0::BIGINT AS n, []::VARCHAR[] AS tainted, []::VARCHAR[] AS clean, 0::BIGINT AS line, ''::VARCHAR AS sink, NULL::VARCHAR AS source_variable FROM ev UNION ALL SELECT e.key, e.n, {tainted}, {clean}, e.line::BIGINT, e.sink, {found} FROM st s JOIN ev e ON e.key = s.key AND e.n = s.n + 1), fl AS (SELECT key, line, sink, source_variable, {pick(0)} AS cwe, {pick(1)} AS severity FROM st WHERE source_variable IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    weight = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {w}" for s, w in SEVERITY_WEIGHT.items()) + " ELSE 0.4 END"
    fn_flow = flow_sql("code_functions", "fn_id", "func", "'cpp'")
    both = f"WITH RECURSIVE {FN_FINDINGS}, {fn_flow}, a AS (SELECT fn_id, detector, type, function, severity, cwe, line FROM f UNION ALL SELECT key, 6, 'TAINT_FLOW', sink, severity, cwe, line FROM fl), u AS (SELECT fn_id, type, cwe, line, function, arg_min(severity, detector) AS severity FROM a GROUP BY ALL)"
    score = lambda w: f"least(1.0, coalesce(sum(w) FILTER ({w}), 0.0))"
    sources = " UNION ".join(f"SELECT fn_id, unnest(regexp_extract_all(func, {q(p)}, 1)) AS v FROM code_functions" for k in ("cpp", "python", "javascript") for p in taint.SOURCES[k]) + " UNION SELECT fn_id, 'argv' FROM code_functions WHERE regexp_matches(func, '\\bargv\\b')"
    clean = " UNION ".join(f"SELECT fn_id, unnest(regexp_extract_all(func, {q(chr(92) + 'b' + s + r'\s*\(\s*([A-Za-z_$]\w*)\s*\)')}, 1)) AS v FROM code_functions" for s in taint.SANITIZERS)
    p = q(taint.CLOSURE_ASSIGNMENT)
    sinks = ", ".join(f"({q(k)}, {q(s)}, {q(c)}, {q(v)})" for k, all_ in taint.SINKS.items() for s, c, v in all_)
    pool = "SELECT label, '{m}' AS method, {e} FROM embeddings WHERE embedding IS NOT NULL GROUP BY label"
    mean = ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 5) AS {n}" for i, n in ((1, "first"), (2, "second")))
    most = ", ".join(f"round(max(embedding[{i}])::DOUBLE, 5) AS {n}" for i, n in ((1, "first"), (2, "second")))
    soft = ", ".join(f"round(sum(exp(embedding[1]::DOUBLE) * embedding[{i}]::DOUBLE) / sum(exp(embedding[1]::DOUBLE)), 5) AS {n}" for i, n in ((1, "first"), (2, "second")))
    return {
        "taint_flows": f"WITH RECURSIVE {fn_flow} SELECT key AS fn_id, line, sink, source_variable, cwe, severity FROM fl",
        "sample_flows": f"WITH RECURSIVE {flow_sql('code_samples', 'sample_id', 'code', f'coalesce({LANG}, ' + chr(39) + 'cpp' + chr(39) + ')')} SELECT key AS sample_id, line, sink, source_variable, cwe, severity FROM fl",
        "taint_closure": f"WITH RECURSIVE src AS ({sources}), cl AS ({clean}), ln AS (SELECT fn_id, unnest(string_split_regex(func, '{EOL}')) AS t FROM code_functions), asg AS (SELECT fn_id, regexp_extract(t, {p}, 1) AS name, unnest(regexp_extract_all(regexp_extract(t, {p}, 2), '[A-Za-z_$][A-Za-z0-9_]*')) AS w FROM ln WHERE regexp_matches(t, {p})), go AS (SELECT fn_id, v FROM src WHERE (fn_id, v) NOT IN (SELECT fn_id, v FROM cl) UNION SELECT a.fn_id, a.name FROM go g JOIN asg a ON a.fn_id = g.fn_id AND a.w = g.v WHERE (a.fn_id, a.name) NOT IN (SELECT fn_id, v FROM src)), al AS (SELECT * FROM src UNION SELECT * FROM go) SELECT fn_id, array_to_string(list_sort(list(v)), ' ') AS tainted FROM al GROUP BY fn_id",
        "taint_sinks": f"SELECT * FROM (VALUES {sinks}) AS t(language, sink, cwe, severity)",
        "full_analysis": f"{both}, k AS (SELECT c.fn_id, count(u.fn_id) AS findings, round(least(1.0, coalesce(sum({weight}) FILTER (u.fn_id IS NOT NULL), 0.0)), 9)::DOUBLE AS rule_score, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 30 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 7 WHEN 'LOW' THEN 3 ELSE 0 END), 0))::BIGINT AS security_score FROM code_functions c LEFT JOIN u ON u.fn_id = c.fn_id GROUP BY c.fn_id) SELECT *, CASE WHEN security_score >= 90 THEN 'LOW' WHEN security_score >= 70 THEN 'MEDIUM' WHEN security_score >= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM k",
        "detector_scores": f"{both}, s AS (SELECT fn_id, 'r' AS w_of, {weight} AS w FROM f UNION ALL SELECT fn_id, 't', {weight} FROM a WHERE type = 'TAINT_FLOW' UNION ALL SELECT fn_id, 'b', {weight} FROM u) SELECT c.fn_id, round({score(chr(39).join(['w_of = ', 'r', '']))}, 9)::DOUBLE AS rules_only, round({score(chr(39).join(['w_of = ', 't', '']))}, 9)::DOUBLE AS taint_only, round({score(chr(39).join(['w_of = ', 'b', '']))}, 9)::DOUBLE AS rules_taint FROM code_functions c LEFT JOIN s ON s.fn_id = c.fn_id GROUP BY c.fn_id",
        "function_identifiers": "WITH x AS (SELECT fn_id, list_sort(list_distinct(regexp_extract_all(coalesce(func, ''), '[A-Za-z_$][A-Za-z0-9_]*'))) AS i FROM code_functions) SELECT fn_id, len(i) AS n, md5(array_to_string(i, ' ')) AS digest FROM x",
        "pooled_embeddings": " UNION ALL ".join([pool.format(m="mean", e=mean), pool.format(m="max", e=most), pool.format(m="attention", e=soft)]),
        "collated_chunks": "WITH x AS (SELECT DISTINCT ON (fn_id) fn_id, chunks FROM chunked_functions WHERE len(chunks) > 0), c AS (SELECT fn_id, unnest(chunks[1:2]) AS c, generate_subscripts(chunks[1:2], 1) - 1 AS chunk_no FROM x) SELECT fn_id, chunk_no, coalesce(list_sum(c), 0)::BIGINT + 512 - len(c) AS ids, len(c) AS kept FROM c",
    }
