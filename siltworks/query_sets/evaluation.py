"""Queries of calibration, policies, hybrids and slices, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import scalars
from siltworks.operators import analyzer, detect, evaluation, metrics
from siltworks.plans.runtime import materialize, scratch, table
from siltworks.query_sets import flow
from siltworks.queries import rounded
from siltworks.sinks import writers
from siltworks.sql import CWES, FN_FINDINGS, PRED, RISK, UNIQUE, chash, confusion, norm, trim

#: The threshold of the hybrids and slices, a fixed one so that SQL can take the same.
THRESHOLD = 0.3
KNOTS = ([0.05, 0.2, 0.5, 0.9], [0.01, 0.1, 0.6, 0.8])


def scored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.usable(table(spark, d, "predictions"))


def ruled(spark: SparkSession, d: str) -> DataFrame:
    """The test split's predictions with the rules' score of their function."""
    p = scored(spark, d).where("split = 'test'")
    f = table(spark, d, "code_functions")
    rules = detect.risk(f, detect.unique_findings(detect.findings(f, "fn_id", "func", "cpp"), "fn_id"), "fn_id")
    return p.join(rules.select("fn_id", "rule_score"), "fn_id")


def calibrated_scores(spark, d):
    """Scores by a Platt and an isotonic calibrator of given values, blended and as logits."""
    s = F.col("score")
    return rounded(scored(spark, d).select("fn_id", "split", scalars.platt(s, 0.8, -0.5).alias("platt"), scalars.isotonic(s, *KNOTS).alias("isotonic"), scalars.blend(s, F.col("target").cast("double")).alias("blended"), scalars.logit(s).alias("logit")), 8)


def calibration_reports(spark, d):
    return rounded(metrics.calibration_report(scored(spark, d)), 7)


def uniform_bins(spark, d):
    return rounded(metrics.reliability(scored(spark, d), strategy="uniform"))


def platt_out_of_fold(spark, d):
    """Before and after out-of-fold calibration of the validation split, and whether it is adopted."""
    return _decided(spark, d, "platt")


def isotonic_out_of_fold(spark, d):
    return _decided(spark, d, "isotonic")


def _decided(spark, d, method):
    rows = materialize(scored(spark, d).where("split = 'valid'"))
    after = materialize(evaluation.out_of_fold(rows, method))
    return rounded(evaluation.decision(metrics.calibration_report(rows), metrics.calibration_report(after, score="calibrated")), 6)


def frozen_policy(spark, d):
    """The policy of the validation split, written as a document and read back, applied to the test split."""
    policy = evaluation.frozen_policy(scored(spark, d).where("split = 'valid'"))
    path = f"{scratch(spark)}/policy-{uuid.uuid4().hex}.json"
    writers.write_text(spark, path, writers.as_json(policy))
    import json

    return rounded(evaluation.evaluated(scored(spark, d).where("split = 'test'"), json.loads(writers.read_text(spark, path))), 6)


def hybrid_variants(spark, d):
    return rounded(evaluation.hybrids(ruled(spark, d), THRESHOLD, ["rule_score"]))


def calibration_ablation(spark, d):
    return rounded(evaluation.calibration_ablation(scored(spark, d).where("split = 'test'"), THRESHOLD))


def error_slices(spark, d):
    """Slices of the test split by truncation, chunks, class and project."""
    f = table(spark, d, "code_functions").select("fn_id", "cwe", "project")
    c = table(spark, d, "chunked_functions").groupBy("fn_id").agg(F.max("truncated").alias("truncated"), F.max("num_chunks").alias("chunks"))
    j = scored(spark, d).where("split = 'test'").join(f, "fn_id").join(c, "fn_id", "left")
    return rounded(evaluation.slices(j, THRESHOLD).select("slice", "value", "n", "positives", "tp", "fp", "fn", "tn", "recall", "precision", "mean_positive", "mean_negative", "small"))


def truncation_ratios(spark, d):
    return rounded(evaluation.truncation_ratio(table(spark, d, "chunked_functions")))


def rule_agreement(spark, d):
    return rounded(evaluation.agreement(ruled(spark, d), THRESHOLD))


def overlap_sensitivity(spark, d):
    flags = evaluation.overlap_flags(table(spark, d, "code_functions"))
    return rounded(evaluation.sensitivity(scored(spark, d).where("split = 'test'").join(flags, "fn_id"), THRESHOLD), 8)


def high_losses(spark, d):
    return rounded(evaluation.high_loss(scored(spark, d), 1.0), 8)


def severity_summary(spark, d):
    u = detect.unique_findings(detect.findings(table(spark, d, "code_functions"), "fn_id", "func", "cpp"), "fn_id")
    return detect.severity_summary(u, "fn_id")


def scorer_baselines(spark, d):
    """Each detector as a scorer of each split."""
    return rounded(analyzer.baselines(table(spark, d, "code_functions")))


def evaluation_ledger(spark, d):
    """Three evaluations of two checkpoints, recorded in a ledger: their numbers and the other checkpoints before."""
    folder = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    told = [writers.record_evaluation(spark, folder, digest, {"split": "test"}) for digest in ("a1", "b2", None)]
    return spark.createDataFrame([(t["number"], t["repeated"], t["other_checkpoints"]) for t in told], "number long, repeated boolean, other_checkpoints long")


def saved_evaluation(spark, d):
    """The test split's metrics at 0.5, saved as a report with predictions and a ledger, and the predictions read back."""
    rows = scored(spark, d).where("split = 'test'")
    path = f"{scratch(spark)}/evaluation-{uuid.uuid4().hex}"
    told = writers.save_evaluation(path, metrics.confusion(rows, F.col("score") >= 0.5, "split"), rows.select("fn_id", "score", "target"), "a1")
    return spark.read.parquet(f"{path}/predictions").agg(F.count(F.lit(1)).alias("n"), F.sum("fn_id").alias("ids")).withColumn("number", F.lit(told["number"]).cast("long"))


QUERIES = [saved_evaluation, calibrated_scores, calibration_reports, uniform_bins, platt_out_of_fold, isotonic_out_of_fold, frozen_policy, hybrid_variants, calibration_ablation, error_slices, truncation_ratios, rule_agreement, overlap_sensitivity, high_losses, severity_summary, scorer_baselines, evaluation_ledger]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# ---- SQL

T = THRESHOLD
TEST = f"(SELECT * FROM {PRED} WHERE split = 'test')"
RULED = f"{FN_FINDINGS}, {UNIQUE}, {RISK}, j AS (SELECT p.*, k.rule_score FROM {TEST} p JOIN k ON k.fn_id = p.fn_id)"


def ranked(src: str, by: str) -> str:
    """roc_auc and average precision of (by, score, target)."""
    g = f"SELECT {by}, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM {src} GROUP BY {by}, score"
    w = f"SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY {by}) AS ps, sum(n) OVER (PARTITION BY {by}) AS ns FROM ({g})"
    return f"SELECT {by}, CASE WHEN any_value(ps) > 0 AND any_value(ns) > 0 THEN sum(n * (tp - p / 2)) / (any_value(ps) * any_value(ns)) ELSE 'nan'::DOUBLE END AS roc_auc, CASE WHEN any_value(ps) > 0 AND any_value(ns) > 0 THEN sum(p / ps * (tp / (tp + fp))) ELSE 'nan'::DOUBLE END AS average_precision FROM ({w}) GROUP BY {by}"


def sliced(src: str, by: str) -> str:
    c = lambda f, y: f"count(*) FILTER ((score >= {T}) = {f} AND (target = 1) = {y})"
    nan = "'nan'::DOUBLE"
    return f"SELECT {by}, n, positives, tp, fp, fn, tn, round(CASE WHEN tp + fn = 0 THEN {nan} ELSE tp / (tp + fn) END, 9) AS recall, round(CASE WHEN tp + fp = 0 THEN {nan} ELSE tp / (tp + fp) END, 9) AS precision, round(coalesce(mp, {nan}), 9) AS mean_positive, round(coalesce(mn, {nan}), 9) AS mean_negative, positives < 20 AS small FROM (SELECT {by}, count(*) AS n, count(*) FILTER (target = 1) AS positives, {c('true', 'true')} AS tp, {c('true', 'false')} AS fp, {c('false', 'true')} AS fn, {c('false', 'false')} AS tn, avg(score) FILTER (target = 1) AS mp, avg(score) FILTER (target <> 1) AS mn FROM {src} GROUP BY {by})"


def oracle_sql() -> dict[str, str]:
    q = "greatest(1e-6, least(1 - 1e-6, score))"
    xs, ys = KNOTS
    seg = " ".join(f"WHEN score < {b} THEN {y0} + ({y1} - {y0}) * (score - {a}) / ({b} - {a})" for a, b, y0, y1 in zip(xs, xs[1:], ys, ys[1:]))
    variants = {"ml_only": ("score", f"score >= {T}"), "rule_score": ("rule_score", "rule_score >= 1e-9"), "ml_or_rule_score": (f"(score >= {T} OR rule_score > 0)::INT::DOUBLE", f"score >= {T} OR rule_score > 0"), "ml_and_rule_score": (f"(score >= {T} AND rule_score > 0)::INT::DOUBLE", f"score >= {T} AND rule_score > 0")}
    raised = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, score + CASE WHEN rule_score > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END))"
    variants["ml_plus_rule_score"] = (raised, f"{raised} >= {T}")
    v = "v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, target, ({s})::DOUBLE AS score, ({f}) AS flag FROM j" for n, (s, f) in variants.items()) + ")"
    fn = f"f AS (SELECT split, fn_id, {chash(norm('func'))} AS h, length({norm('func')}) > 0 AS filled FROM code_functions), s AS (SELECT fn_id, coalesce(filled AND h IN (SELECT h FROM f WHERE split = 'valid' AND filled), false) AS lapped FROM f WHERE split = 'test'), j AS (SELECT p.*, s.lapped FROM {TEST} p JOIN s USING (fn_id)), x AS (SELECT 'all' AS part, * FROM j UNION ALL SELECT 'rest', * FROM j WHERE NOT lapped)"
    names = ["accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "average_precision"]
    proj = f"nullif(lower({trim('project')}), '')"
    joined = f"c AS (SELECT fn_id, max(truncated) AS truncated, max(num_chunks) AS chunks FROM chunked_functions GROUP BY fn_id), j AS (SELECT p.score, p.target, c.truncated, c.chunks, {CWES} AS cwes, {proj} AS project FROM {TEST} p JOIN code_functions f USING (fn_id) LEFT JOIN c USING (fn_id))"
    each = "x AS (SELECT 'truncation' AS slice, CASE WHEN truncated THEN 'truncated' ELSE 'whole' END AS value, score, target FROM j UNION ALL SELECT 'chunks', coalesce(chunks::VARCHAR, 'none'), score, target FROM j UNION ALL SELECT 'project', project, score, target FROM j WHERE project IS NOT NULL UNION ALL SELECT 'cwe', w, score, target FROM (SELECT unnest(list_distinct(cwes)) AS w, score, target FROM j))"
    report = f"WITH p AS {PRED}, e AS (SELECT split, list_distinct(quantile_cont(score, [{', '.join(str(i / 10) for i in range(11))}])) AS d FROM p GROUP BY split), b AS (SELECT p.split, score, target, len(list_filter(list_sort(d)[2:len(d) - 1], lambda x: x <= score)) AS bin FROM p JOIN e USING (split)), r AS (SELECT split, bin, count(*) AS n, avg(score) AS mp, avg(target::DOUBLE) AS o FROM b GROUP BY split, bin), c AS (SELECT split, sum(n * abs(mp - o)) / sum(n) AS ece, max(abs(mp - o)) AS mce, sum(n * sqrt(0.6366197723675814) * sqrt(mp * (1 - mp) / n)) / sum(n) AS noise_floor FROM r GROUP BY split), k AS ({ranked('p', 'split')}), a AS (SELECT split, count(*) AS n, avg(target::DOUBLE) AS positive_rate, avg((score - target) * (score - target)) AS brier FROM p GROUP BY split) SELECT split, n, round(positive_rate, 7) AS positive_rate, round(brier, 7) AS brier, round(ece, 7) AS ece, round(mce, 7) AS mce, round(noise_floor, 7) AS noise_floor, round(roc_auc, 7) AS roc_auc, round(average_precision, 7) AS pr_auc FROM a JOIN c USING (split) JOIN k USING (split)"
    return {
        "calibrated_scores": f"SELECT fn_id, split, round(1 / (1 + exp(-(0.8 * ln({q} / (1 - {q})) - 0.5))), 8) AS platt, round(CASE WHEN score < {xs[0]} THEN {ys[0]} WHEN score >= {xs[-1]} THEN {ys[-1]} {seg} END, 8) AS isotonic, round(least(1.0, score + CASE WHEN target = 1 THEN 0.15 ELSE 0 END), 8) AS blended, round(ln({q} / (1 - {q})), 8) AS logit FROM {PRED}",
        "saved_evaluation": f"SELECT count(*) AS n, sum(fn_id)::BIGINT AS ids, 1::BIGINT AS number FROM {TEST}",
        "calibration_reports": report,
        "uniform_bins": f"SELECT split, len(list_filter([{', '.join(str(i / 10) for i in range(1, 10))}]::DOUBLE[], lambda x: x <= score)) AS bin, count(*) AS n, round(avg(score), 9) AS mean_predicted, round(avg(target::DOUBLE), 9) AS observed_rate FROM {PRED} GROUP BY 1, 2",
        "hybrid_variants": f"WITH {RULED}, {v}, m AS ({confusion('v', 'flag', 'variant')}), a AS ({ranked('v', 'variant')}) SELECT m.*, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM m JOIN a USING (variant)",
        "calibration_ablation": f"WITH p AS {TEST}, t AS (SELECT min(raw_score) AS r FROM p WHERE score >= {T}), x AS (SELECT 'calibrated' AS scores, {T}::DOUBLE AS threshold, score >= {T} AS flag, target FROM p WHERE raw_score IS NOT NULL UNION ALL SELECT 'raw', r, raw_score >= r, target FROM p, t WHERE raw_score IS NOT NULL AND r IS NOT NULL), m AS ({confusion('x', 'flag', 'scores, threshold')}) SELECT * REPLACE (round(threshold, 9) AS threshold) FROM m",
        "error_slices": f"WITH {joined}, {each}, s AS ({sliced('x', 'slice, value')}) SELECT * FROM s QUALIFY slice IN ('truncation', 'chunks') OR row_number() OVER (PARTITION BY slice ORDER BY n DESC, value) <= 12",
        "truncation_ratios": "WITH g AS (SELECT split, avg(coalesce(truncated, false)::INT::DOUBLE) FILTER (target = 1) AS p, avg(coalesce(truncated, false)::INT::DOUBLE) FILTER (target = 0) AS n FROM chunked_functions GROUP BY split) SELECT split, round(p, 9) AS positive_rate, round(n, 9) AS negative_rate, CASE WHEN n = 0 THEN 'inf'::DOUBLE ELSE round(p / n, 9) END AS ratio FROM g",
        "rule_agreement": f"WITH {RULED} SELECT rule_score > 0 AS rule_flag, score >= {T} AS ml_flag, count(*) AS n, count(*) FILTER (target = 1) AS positives, round(count(*) FILTER (target = 1) / count(*), 9) AS precision FROM j GROUP BY 1, 2",
        "overlap_sensitivity": f"WITH {fn}, m AS ({confusion('x', f'score >= {T}', 'part').replace(', 9)', ', 15)')}), a AS ({ranked('x', 'part')}), l AS (SELECT part, unnest([{', '.join(chr(39) + n + chr(39) for n in names)}]) AS metric, unnest([{', '.join(names)}]) AS value FROM m JOIN a USING (part)), g AS (SELECT metric, max(value) FILTER (part = 'all') AS w, max(value) FILTER (part = 'rest') AS o FROM l GROUP BY metric) SELECT metric, round(w, 8) AS with_overlap, round(o, 8) AS without_overlap, round(o - w, 8) AS delta, metric = (SELECT arg_max(metric, (abs(o - w), metric)) FROM g) AS largest FROM g",
        "high_losses": f"WITH x AS (SELECT fn_id, target, score, ln({q} / (1 - {q})) AS logit FROM {PRED}), y AS (SELECT *, greatest(logit, 0.0) - logit * target + ln(1 + exp(-abs(logit))) AS loss FROM x) SELECT fn_id, target, round(score, 8) AS score, round(logit, 8) AS logit, round(loss, 8) AS loss FROM y WHERE loss > 1.0 ORDER BY y.loss DESC, fn_id LIMIT 5",
        "severity_summary": f"WITH {FN_FINDINGS}, {UNIQUE} SELECT fn_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + " FROM u WHERE fn_id IS NOT NULL GROUP BY fn_id",
        "scorer_baselines": f"WITH ds AS ({flow.oracle_sql()['detector_scores']}), x AS (SELECT c.split || '|' || n AS grp, c.split, n AS scorer, c.target, sc AS score FROM (SELECT fn_id, unnest(['rules_only', 'taint_only', 'rules_taint']) AS n, unnest([rules_only, taint_only, rules_taint]) AS sc FROM ds) JOIN code_functions c USING (fn_id) WHERE c.target IN (0, 1)), m AS ({confusion('x', 'score >= 1e-9', 'grp, split, scorer')}), a AS ({ranked('x', 'grp')}) SELECT m.* EXCLUDE (grp), round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM m JOIN a USING (grp)",
        "evaluation_ledger": "SELECT * FROM (VALUES (1::BIGINT, false, 0::BIGINT), (2::BIGINT, true, 1::BIGINT), (3::BIGINT, true, 2::BIGINT)) AS t(number, repeated, other_checkpoints)",
    }
