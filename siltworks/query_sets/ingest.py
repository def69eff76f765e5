"""Queries over sources and samples, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import scalars, tokens
from siltworks.functions.text import trimmed
from siltworks.operators import corpus, sampling
from siltworks.plans.runtime import materialize, scratch, spread, table
from siltworks.sources import files, jsonl
from siltworks.sql import KEYS, TOKENS, chash, norm, q, trim

CHUNKED = {"length": 64, "overlap": 16, "most": 8}


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records").select("record_id", "split", F.col("raw_line").alias("line"))


def trained(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_functions").where("split = 'train'")


def jsonl_records(spark, d):
    """The records that lines of JSON hold, with their label and the length of their code."""
    r = jsonl.records(raw(spark, d))
    name = jsonl.detect_field(F.col("line"), jsonl.CODE_FIELDS)
    return r.select("record_id", name.alias("code_field"), jsonl.detect_field(F.col("line"), jsonl.LABEL_FIELDS).alias("label_field"), F.length(jsonl.field_text(F.col("line"), name, jsonl.CODE_FIELDS)).cast("long").alias("chars"), jsonl.label_of(F.col("line")).alias("label"))


def jsonl_read_back(spark, d):
    """Written as text files and read back by number of line: lines, lines that are not blank, objects."""
    path = f"{scratch(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, d, "raw_records").select(F.coalesce(F.regexp_replace("raw_line", "[\\r\\n]+", " "), F.lit("")).alias("value")).write.text(path)
    ln = materialize(jsonl.text_lines(spark, path))
    ok = jsonl.is_object(F.col("line"))
    return ln.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.length(trimmed("line")) > 0, 1)).alias("filled"), F.count(F.when(ok, 1)).alias("objects"), F.count_distinct("file", "line_no").alias("places"))


def field_presence(spark, d):
    return jsonl.field_presence(raw(spark, d), "line").withColumn("share", F.round("share", 9))


def raw_profile(spark, d):
    return jsonl.profile(raw(spark, d), "line").withColumn("mean_chars", F.round("mean_chars", 6))


def raw_validation(spark, d):
    return jsonl.validate(raw(spark, d), "line")


def source_names(spark, d):
    """Base names, languages by extension and checks of requests made from the samples."""
    s = table(spark, d, "code_samples").withColumn("path", F.concat(F.lit("in\\up/"), F.coalesce("language", F.lit("")), F.lit("."), F.coalesce("language", F.lit(""))))
    c = files.checked_requests(s, "code", "language", "path")
    name = files.base_name(F.col("path"))
    return c.select(F.col("sample_id").cast("long").alias("sample_id"), name.alias("name"), files.extension_language(name).alias("by_extension"), "asked", "refused")


def supported_languages(spark, d):
    return files.supported_languages(spark).select("language", F.array_join("aliases", ",").alias("aliases"), F.array_join("extensions", ",").alias("extensions"), "graphs")


def payload_scalars(spark, d):
    """The scalar fields of run-log payloads, counted by kind of event."""
    r = table(spark, d, "run_log").select("kind", F.explode(scalars.scalar_fields(F.col("payload"))).alias("field", "value"))
    return r.groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


def throttle_bits(spark, d):
    """Reasons decoded from masks made of ids."""
    x = table(spark, d, "run_log").select("log_id", F.concat(F.lit("0x"), F.hex(F.pmod("log_id", F.lit(512)))).alias("mask"))
    return x.select("log_id", F.explode(files.throttle_reasons(F.col("mask"))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def chunk_ids(spark, d):
    """Chunks of the texts' words: their number, whether words were left out, and the chunk sequence's digest."""
    c = corpus.chunked(table(spark, d, "code_functions"), **CHUNKED)
    return c.select("fn_id", F.size("chunks").cast("long").alias("chunks"), "truncated", F.md5(F.array_join(F.flatten("chunks"), " ")).alias("digest"))


def windowed_overlap(spark, d):
    """Chunk sequences in two splits, over chunks of the texts."""
    return corpus.chunk_overlap(corpus.chunked(table(spark, d, "code_functions").where(F.length(trimmed("func")) > 0), **CHUNKED))


def overlap_examples(spark, d):
    return corpus.chunk_overlap_examples(corpus.chunked(table(spark, d, "code_functions").where(F.length(trimmed("func")) > 0), **CHUNKED))


def undersampled_rounded(spark, d):
    return sampling.undersampled(trained(spark, d), 2.5, half_even=True).select("fn_id", "target")


def undersampling_counts(spark, d):
    r = sampling.undersampling_report(trained(spark, d), 2.5)
    return r.withColumn("achieved_ratio", F.round("achieved_ratio", 9)).withColumn("seed", F.col("seed").cast("long"))


def stratified_limit(spark, d):
    return sampling.stratified_limit(trained(spark, d), 300).select("fn_id", "target")


def stratified_subset(spark, d):
    return sampling.stratified_subset(trained(spark, d), 300).select("fn_id", "target")


def balanced_subset(spark, d):
    return sampling.balanced_subset(trained(spark, d), 400).select("fn_id", "target")


def epoch_permutation(spark, d):
    return sampling.permutation(trained(spark, d), 42, 3, skip=100).select("fn_id", "place")


def class_split(spark, d):
    """Rows and ids' sums of either class."""
    p, n = sampling.by_class(table(spark, d, "code_functions"))
    one = lambda x, name: x.agg(F.lit(name).alias("class"), F.count(F.lit(1)).alias("n"), F.sum("fn_id").alias("ids"))
    return one(p, "positive").unionByName(one(n, "negative"))


def search_trials(spark, d):
    """Parameters drawn for a hundred trials of the whole space, one pinned."""
    space = sampling.search_space(architecture=True, memory=True, optimisation=True, pinned={"grad_accum_steps": 2}, learning_rate=(1e-5, 1e-4))
    t = sampling.trials(spark.range(100).withColumnRenamed("id", "trial"), space)
    return t.select("trial", *[F.round(F.ln(c) if c == "learning_rate" else F.col(c), 9).alias(c) if isinstance(space[c][1], tuple) else F.col(c).cast("string").alias(c) for c in space])


def learning_rates(spark, d):
    """The factor of the learning rate at each of 200 steps, by schedule."""
    step = spark.range(200).withColumnRenamed("id", "step")
    each = [F.struct(F.lit(s).alias("schedule"), F.round(scalars.learning_rate(s, F.col("step"), 200, 0.06), 9).alias("rate")) for s in scalars.SCHEDULES]
    return step.select("step", F.inline(F.array(*each)))


def early_stops(spark, d):
    """Early stopping over the runs' logged losses, by hour of the log, read as scores of epochs."""
    r = table(spark, d, "run_log").where("kind = 'epoch' OR kind = 'step'")
    x = r.select("run_id", "log_id", (-F.get_json_object("payload", "$.loss").try_cast("double")).alias("score")).where("run_id IS NOT NULL AND score IS NOT NULL").dropDuplicates(["log_id"])
    return sampling.early_stop(x, "run_id", "log_id", "score", 2, 0.01).withColumn("best_score", F.round("best_score", 9))


def audit_report(spark, d):
    """Every dimension and pair of splits."""
    return corpus.audit_report(table(spark, d, "code_functions")).withColumn("examples", F.array_join("examples", "|"))


def token_limits(spark, d):
    """Tokens of a public tokenizer against the size of chunks."""
    f = table(spark, d, "code_functions")
    sizes = tokens.tokenized(spread(f), "fn_id", "func").select("fn_id", F.size("tokens").cast("long").alias("n"))
    return corpus.token_limits(sizes.join(f.select("fn_id", "split"), "fn_id")).withColumn("mean_tokens", F.round("mean_tokens", 6))


def token_chunks(spark, d):
    """Texts cut into chunks of token ids."""
    c = corpus.token_chunks(tokens.tokenized(spread(table(spark, d, "code_functions")), "fn_id", "func"))
    return c.select("fn_id", F.col("n").cast("long").alias("n"), F.size("chunks").cast("long").alias("chunks"), "truncated", F.md5(F.to_json("chunks")).alias("digest"))


def ranked_trials(spark, d):
    """Runs of the log in order of their best loss."""
    r = table(spark, d, "run_log").where("run_id IS NOT NULL").groupBy(F.col("run_id").alias("trial")).agg(F.max(-F.get_json_object("payload", "$.loss").try_cast("double")).alias("score"))
    return sampling.best_trial(r).select("trial", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


QUERIES = [audit_report, token_limits, token_chunks, ranked_trials, jsonl_records, jsonl_read_back, field_presence, raw_profile, raw_validation, source_names, supported_languages, payload_scalars, throttle_bits, chunk_ids, windowed_overlap, overlap_examples, undersampled_rounded, undersampling_counts, stratified_limit, stratified_subset, balanced_subset, epoch_permutation, class_split, search_trials, learning_rates, early_stops]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# ---- SQL

OBJECT = "(json_valid(l) AND json_type(l) = 'OBJECT')"
LINES = f"l0 AS (SELECT record_id, split, raw_line AS l FROM raw_records WHERE length({trim('raw_line')}) > 0), o AS (SELECT *, coalesce(CASE WHEN json_valid(l) THEN json_type(l) = 'OBJECT' END, false) AS ok FROM l0)"


def _first(names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN json_exists(l, '$.{n}') THEN {q(n)}" for n in names) + " END"


def _label(names: list[str]) -> str:
    one = lambda n: f"CASE json_type(l, '$.{n}') WHEN 'BOOLEAN' THEN (l ->> '$.{n}' = 'true')::INT WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(trim(l ->> '$.{n}'), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(l ->> '$.{n}') AS BIGINT) END WHEN 'NULL' THEN NULL ELSE trunc(TRY_CAST(l ->> '$.{n}' AS DOUBLE))::BIGINT END"
    return "CASE " + " ".join(f"WHEN json_exists(l, '$.{n}') THEN {one(n)}" for n in names) + " END"


def _code(names: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN json_exists(l, '$.{n}') THEN l ->> '$.{n}'" for n in names) + " END"


RECORDS = f"r AS (SELECT record_id, split, ok, CASE WHEN ok THEN {_first(jsonl.CODE_FIELDS)} END AS cf, CASE WHEN ok THEN {_first(jsonl.LABEL_FIELDS)} END AS lf, CASE WHEN ok THEN {_label(jsonl.LABEL_FIELDS)} END AS label, CASE WHEN ok THEN {_code(jsonl.CODE_FIELDS)} END AS code FROM o)"
TRAIN = "t AS (SELECT fn_id, target, md5('{seed}:' || fn_id) AS o FROM code_functions WHERE split = 'train' AND target IN (0, 1)), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o, fn_id) AS r, count(*) FILTER (target = 1) OVER () AS p, count(*) FILTER (target = 0) OVER () AS n FROM t)"
CHUNKS = f"w0 AS (SELECT *, CASE WHEN length({trim('func')}) > 0 THEN {TOKENS} ELSE [] END AS t FROM code_functions), w1 AS (SELECT *, CASE WHEN len(t) <= 62 THEN 1 ELSE 1 + ceil((len(t) - 62) / 46)::BIGINT END AS k FROM w0), w2 AS (SELECT fn_id, split, target, func, k > 8 AS truncated, [['<s>'] || t[i * 46 + 1 : i * 46 + 62] || ['</s>'] FOR i IN range(0, least(8, k))] AS chunks FROM w1)"
SHARED = f"{CHUNKS}, g AS (SELECT chunks, split, list_sort(list(DISTINCT target) FILTER (target IS NOT NULL)) AS labels, min(fn_id) AS id FROM w2 WHERE length({trim('func')}) > 0 GROUP BY ALL), j AS (SELECT a.split AS split_a, b.split AS split_b, a.id AS id_a, b.id AS id_b, a.labels AS la, b.labels AS lb FROM g a JOIN g b USING (chunks) WHERE a.split < b.split)"
SHARED = SHARED.replace("GROUP BY ALL", "GROUP BY chunks, split")


def _uniform(name: str) -> str:
    return f"(('0x' || left(md5('42:' || trial || ':{name}'), 13))::BIGINT::DOUBLE / 4503599627370496)"


def _trials() -> str:
    space = sampling.search_space(architecture=True, memory=True, optimisation=True, pinned={"grad_accum_steps": 2}, learning_rate=(1e-5, 1e-4))
    out = []
    for name, (kind, spec) in space.items():
        u = _uniform(name)
        if kind == "categorical":
            out.append(f"[{', '.join(q(str(x)) for x in spec)}][floor({u} * {len(spec)})::INT + 1] AS {name}")
        elif kind == "loguniform":
            out.append(f"round(ln({spec[0]}::DOUBLE) + {u} * (ln({spec[1]}::DOUBLE) - ln({spec[0]}::DOUBLE)), 9) AS {name}")
        else:
            out.append(f"round({spec[0]}::DOUBLE + {u} * ({spec[1]}::DOUBLE - {spec[0]}::DOUBLE), 9) AS {name}")
    return f"SELECT trial, {', '.join(out)} FROM (SELECT unnest(range(100)) AS trial)"


def oracle_sql() -> dict[str, str]:
    ext = " ".join(f"WHEN {q(e)} THEN {q(x)}" for e, x in files.EXTENSIONS.items())
    lang = "nullif(CASE lower(trim(language)) WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'c++' THEN 'cpp' WHEN 'c' THEN 'cpp' ELSE lower(trim(language)) END, '')"
    known = ", ".join(q(x) for x in files.LANGUAGES)
    bits = ", ".join(f"({1 << i}, {q(n)})" for i, n in enumerate(files.THROTTLE))
    warm, done = "least(step / 12.0, 1.0)", "(step - 12) / 188.0"
    rate = lambda fall: f"round(CASE WHEN step < 12 THEN {warm} ELSE {fall} END, 9)"
    dims = ", ".join(q(x) for x in corpus.DIMENSIONS)
    return {
        "audit_report": f"WITH k AS ({KEYS}), g AS (SELECT split, dim, key, count(*) AS n, list_sort(list(DISTINCT target) FILTER (target IS NOT NULL)) AS labels FROM k GROUP BY ALL), p AS (SELECT unnest([{dims}]) AS dim), s AS (SELECT * FROM p, (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) AS t(left_split, right_split)), b AS (SELECT l.dim, l.split AS left_split, r.split AS right_split, l.key, l.n AS ln, r.n AS rn, coalesce(l.labels, []) IS DISTINCT FROM coalesce(r.labels, []) AS differ, row_number() OVER (PARTITION BY l.dim, l.split, r.split ORDER BY l.key) AS i FROM g l JOIN g r USING (dim, key)), c AS (SELECT dim, left_split, right_split, count(*) AS shared_keys, sum(ln)::BIGINT AS left_rows, sum(rn)::BIGINT AS right_rows, count(*) FILTER (differ) AS label_conflicts, array_to_string(list(key ORDER BY key) FILTER (i <= 5), '|') AS examples FROM b GROUP BY ALL) SELECT s.*, EXISTS (SELECT 1 FROM g WHERE g.dim = s.dim AND g.split = s.left_split) AND EXISTS (SELECT 1 FROM g WHERE g.dim = s.dim AND g.split = s.right_split) AS available, coalesce(shared_keys, 0) AS shared_keys, coalesce(left_rows, 0) AS left_rows, coalesce(right_rows, 0) AS right_rows, coalesce(label_conflicts, 0) AS label_conflicts, coalesce(examples, '') AS examples FROM s LEFT JOIN c USING (dim, left_split, right_split)",
        "ranked_trials": "WITH r AS (SELECT run_id AS trial, max(-TRY_CAST(CASE WHEN json_valid(payload) THEN payload ->> '$.loss' END AS DOUBLE)) AS score FROM run_log WHERE run_id IS NOT NULL GROUP BY run_id) SELECT trial, round(score, 9) AS score, row_number() OVER (ORDER BY coalesce(CASE WHEN NOT isnan(score) THEN score END, '-inf'::DOUBLE) DESC, trial) AS place FROM r",
        "jsonl_records": f"WITH {LINES}, {RECORDS} SELECT record_id, cf AS code_field, lf AS label_field, length(code) AS chars, label FROM r WHERE ok",
        "jsonl_read_back": f"WITH x AS (SELECT coalesce(regexp_replace(raw_line, '[\\r\\n]+', ' ', 'g'), '') AS l FROM raw_records) SELECT count(*) AS lines, count(*) FILTER (length({trim('l')}) > 0) AS filled, count(*) FILTER (coalesce(CASE WHEN json_valid(l) THEN json_type(l) = 'OBJECT' END, false)) AS objects, count(*) AS places FROM x",
        "field_presence": f"WITH {LINES}, k AS (SELECT split, unnest(list_distinct(json_keys(l))) AS field FROM o WHERE ok), t AS (SELECT split, count(*) AS total FROM o WHERE ok GROUP BY split) SELECT split, field, count(*) AS n, round(count(*) / any_value(total), 9) AS share FROM k JOIN t USING (split) GROUP BY split, field",
        "raw_profile": f"WITH {LINES}, {RECORDS} SELECT split, count(*) AS lines, count(*) FILTER (ok) AS objects, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives, min(length(code)) AS shortest, max(length(code)) AS longest, round(avg(length(code)), 6) AS mean_chars FROM r GROUP BY split",
        "raw_validation": f"WITH {LINES}, {RECORDS}, v AS (SELECT split, ok, label, {norm('code')} AS c FROM r), x AS (SELECT split, ok, label, ok AND length(c) = 0 AS e, CASE WHEN ok AND length(c) > 0 THEN {chash('c')} END AS h FROM v), y AS (SELECT split, count(*) AS raw_lines, count(*) FILTER (ok) AS parsed, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (e) AS empty, count(*) FILTER (ok AND NOT e AND NOT coalesce(label IN (0, 1), false)) AS bad_labels, count(*) FILTER (ok AND NOT e AND label = 0) AS negatives, count(*) FILTER (ok AND NOT e AND label = 1) AS positives, count(h) - count(DISTINCT h) AS duplicates FROM x GROUP BY split) SELECT *, negatives > 20 * positives AS severe FROM y",
        "source_names": f"WITH s AS (SELECT sample_id::BIGINT AS sample_id, code, {lang} AS lang, coalesce(language, '') || '.' || coalesce(language, '') AS name FROM code_samples) SELECT sample_id, name, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) {ext} END AS by_extension, CASE WHEN lang IN ({known}) THEN lang END AS asked, CASE WHEN length(coalesce(code, '')) = 0 THEN 'empty' WHEN length(code) > 1000000 THEN 'too long' WHEN length({trim('code')}) = 0 THEN 'blank' WHEN lang IS NOT NULL AND lang NOT IN ({known}) THEN 'language' END AS refused FROM s",
        "supported_languages": "SELECT * FROM (VALUES ('c', '', 'c,h', true), ('cpp', 'c++', 'cc,cpp,cxx,hh,hpp', true), ('python', 'py', 'py', false), ('javascript', 'js', 'cjs,js,mjs', false), ('java', '', 'java', false)) AS t(language, aliases, extensions, graphs)",
        "payload_scalars": "WITH p AS (SELECT kind, payload FROM run_log WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), k AS (SELECT kind, payload, unnest(list_distinct(json_keys(payload))) AS field FROM p) SELECT kind, field, count(*) AS n FROM k WHERE json_type(payload, '$.\"' || field || '\"') NOT IN ('OBJECT', 'ARRAY') GROUP BY ALL",
        "throttle_bits": f"SELECT name AS reason, count(*) AS n FROM run_log, (VALUES {bits}) AS b(bit, name) WHERE (log_id % 512) & bit <> 0 GROUP BY name",
        "chunk_ids": f"WITH {CHUNKS} SELECT fn_id, len(chunks) AS chunks, truncated, md5(array_to_string(flatten(chunks), ' ')) AS digest FROM w2",
        "windowed_overlap": f"WITH {SHARED} SELECT split_a, split_b, count(*) AS signatures, count(*) FILTER (la <> lb) AS conflicting FROM j GROUP BY ALL",
        "overlap_examples": f"WITH {SHARED} SELECT split_a, split_b, id_a, id_b FROM j QUALIFY row_number() OVER (PARTITION BY split_a, split_b ORDER BY id_a, id_b) <= 10",
        "undersampled_rounded": f"WITH {TRAIN.format(seed=42)} SELECT fn_id, target FROM k WHERE target = 1 OR r <= round_even(p * 2.5, 0)",
        "undersampling_counts": "WITH c AS (SELECT count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM code_functions WHERE split = 'train'), k AS (SELECT *, least(n, round_even(p * 2.5, 0))::BIGINT AS kept FROM c) SELECT p + n AS input_records, p AS input_positive, p AS kept_positive, kept AS kept_negative, p + kept AS kept_total, 2.5::DOUBLE AS requested_ratio, round(kept / greatest(1, p), 9) AS achieved_ratio, 42::BIGINT AS seed FROM k",
        "stratified_limit": f"WITH {TRAIN.format(seed=42)}, w AS (SELECT *, greatest(1, round_even(p * (300 / (p + n)), 0)) AS want FROM k) SELECT fn_id, target FROM w WHERE p + n <= 300 OR (target = 1 AND r <= want) OR (target = 0 AND r <= 300 - want)",
        "stratified_subset": f"WITH {TRAIN.format(seed=42)}, w AS (SELECT *, least(300, p + n) AS m FROM k), v AS (SELECT *, least(greatest(CASE WHEN p > 0 THEN 1 ELSE 0 END, round_even(m * p / greatest(1, p + n), 0)), p, m) AS a FROM w) SELECT fn_id, target FROM v WHERE (target = 0 AND r <= least(m - a, n)) OR (target = 1 AND r <= least(p, m - least(m - a, n)))",
        "balanced_subset": f"WITH {TRAIN.format(seed=0)} SELECT fn_id, target FROM k WHERE (target = 1 AND r <= least(200, p)) OR (target = 0 AND r <= 400 - least(200, p))",
        "epoch_permutation": f"WITH x AS (SELECT fn_id, row_number() OVER (ORDER BY md5('{42 * 1_000_003 + 3}:' || fn_id), fn_id) - 1 AS place FROM code_functions WHERE split = 'train') SELECT * FROM x WHERE place >= 100",
        "class_split": "SELECT CASE target WHEN 1 THEN 'positive' ELSE 'negative' END AS class, count(*) AS n, sum(fn_id)::BIGINT AS ids FROM code_functions WHERE target IN (0, 1) GROUP BY 1",
        "early_stops": "WITH RECURSIVE e AS (SELECT DISTINCT ON (log_id) run_id, log_id, -TRY_CAST(CASE WHEN json_valid(payload) THEN payload ->> '$.loss' END AS DOUBLE) AS s FROM run_log WHERE kind IN ('epoch', 'step') AND run_id IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY log_id) AS i FROM e WHERE s IS NOT NULL), w AS (SELECT run_id, i, log_id AS best, s AS top, 0 AS misses, NULL::BIGINT AS stopped FROM o WHERE i = 1 UNION ALL SELECT o.run_id, o.i, CASE WHEN o.s > w.top + 0.01 THEN o.log_id ELSE w.best END, CASE WHEN o.s > w.top + 0.01 THEN o.s ELSE w.top END, CASE WHEN o.s > w.top + 0.01 THEN 0 ELSE w.misses + 1 END, CASE WHEN NOT o.s > w.top + 0.01 AND w.misses + 1 >= 2 THEN o.log_id END FROM w JOIN o ON o.run_id = w.run_id AND o.i = w.i + 1 WHERE w.stopped IS NULL) SELECT run_id, arg_max(best, i) AS best_epoch, round(arg_max(top, i), 9) AS best_score, max(stopped) AS stopped FROM w GROUP BY run_id",
        "search_trials": _trials(),
        "learning_rates": f"SELECT step, unnest(['linear', 'cosine', 'constant_with_warmup']) AS schedule, unnest([{rate('greatest(0.0, 1 - ' + done + ')')}, {rate('greatest(0.0, 0.5 * (1 + cos(pi() * ' + done + ')))')}, {rate('1.0')}]) AS rate FROM (SELECT unnest(range(200)) AS step)",
    }


