"""Calibration, decision policies, hybrids with detectors and slices of binary predictions."""

from __future__ import annotations

import json
import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import scalars
from siltworks.functions.text import label_key
from siltworks.operators import metrics, sampling
from siltworks.operators.corpus import code_hash, coerced_cwe, normalized_code
from siltworks.plans.runtime import materialize

METHODS = ("platt", "isotonic")
OBJECTIVES = ("f1", "fbeta", "mcc", "recall_at_precision")
#: Fixed values of the adoption rule: least relative gain, multiple of the noise floor, largest relative loss of ranking.
GAIN, NOISE, RANKING = 0.10, 2.0, 0.02
#: Fewer positives than this make a slice small.
SMALL = 20


def _grouped(df: DataFrame, score: str, *by: str) -> DataFrame:
    """Rows and positives of each distinct score: what fits a calibrator."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col("target") == 1, 1.0).otherwise(0.0)).alias("p"))


def fit_platt(df: DataFrame, score: str = "score", steps: int = 30) -> dict[int, dict]:
    """Calibrators {"method", "a", "b"} by ``part``: a logistic regression on the logit, not regularised, by Newton steps.

    df has one row a part and distinct score, with its n rows and p positives; each step is one aggregate of five sums for all parts at once. A part without both classes gets slope 1 and offset 0."""
    x = scalars.logit(F.col(score))
    fits = {r.part: (0.0, math.log(max(r.p, 1e-9) / max(r.n - r.p, 1e-9))) if 0 < r.p < r.n else (1.0, 0.0) for r in df.groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()}
    settled = {k for k, v in fits.items() if v == (1.0, 0.0)}
    for _ in range(steps):
        if len(settled) == len(fits):
            break
        pick = lambda i: F.get(F.array(*[F.lit(float(fits[k][i])) for k in sorted(fits)]), F.array_position(F.array(*[F.lit(k) for k in sorted(fits)]), F.col("part")).cast("int") - 1)
        row = df.select("part", "n", "p", x.alias("x")).withColumn("m", scalars.sigmoid(pick(0) * F.col("x") + pick(1)))
        w, r = F.col("n") * F.col("m") * (1 - F.col("m")), F.col("p") - F.col("n") * F.col("m")
        sums = row.groupBy("part").agg(F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11")).collect()
        for s in sums:
            if s.part in settled:
                continue
            det = s.h00 * s.h11 - s.h01 * s.h01
            if det <= 1e-18:
                settled.add(s.part)
                continue
            da, db = (s.h00 * s.g1 - s.h01 * s.g0) / det, (s.h11 * s.g0 - s.h01 * s.g1) / det
            cut = min(1.0, 10.0 / max(abs(da), abs(db), 1e-12))  # a long step is shortened
            fits[s.part] = (fits[s.part][0] + cut * da, fits[s.part][1] + cut * db)
            if max(abs(da), abs(db)) < 1e-10:
                settled.add(s.part)
    return {k: {"method": "platt", "a": a, "b": b} for k, (a, b) in fits.items()}


def fit_isotonic(df: DataFrame, score: str = "score") -> dict[int, dict]:
    """Calibrators {"method", "x", "y"} by ``part``: the best rising step function, with a line between steps."""
    out = {}
    rows = df.select("part", F.col(score).alias("x"), (F.col("p") / F.col("n")).alias("y"), "n")
    for r in rows.select("part").distinct().collect():  # folds
        data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.where(F.col("part") == r.part))
        model = IsotonicRegression(featuresCol="features", labelCol="y", weightCol="n").fit(data)
        out[r.part] = {"method": "isotonic", "x": [float(v) for v in model.boundaries], "y": [min(1.0, max(0.0, float(v))) for v in model.predictions]}
    return out


def fit(df: DataFrame, method: str, score: str = "score") -> dict:
    """A calibrator of all rows."""
    return _fits(_grouped(df, score).withColumn("part", F.lit(0)), method)[0]


def _fits(grouped: DataFrame, method: str) -> dict[int, dict]:
    if method not in METHODS:
        raise ValueError(f"a calibrator is one of {METHODS}")
    grouped = materialize(grouped)
    return fit_platt(grouped) if method == "platt" else fit_isotonic(grouped)


def calibrated(p: Column, calibrator: dict) -> Column:
    """The calibrator's probability for a score. A calibrator is plain values, so json.dumps and json.loads keep it."""
    if calibrator["method"] == "platt":
        return scalars.platt(p, calibrator["a"], calibrator["b"])
    if calibrator["method"] == "isotonic":
        return scalars.isotonic(p, calibrator["x"], calibrator["y"])
    raise ValueError(f"a calibrator is one of {METHODS}")


def out_of_fold(df: DataFrame, method: str, folds: int = 5, seed: int = 42, score: str = "score") -> DataFrame:
    """df (rows of target 0 or 1) with ``fold`` and ``calibrated``: each row's score by a calibrator fitted on the other folds. Needs two rows of each class at least."""
    p, n = sampling.class_counts(df)
    if min(p, n) < 2:
        raise ValueError(f"calibration needs two rows of each class; got {p} and {n}")
    dealt = materialize(sampling.folds(df, folds, seed))
    k = max(2, min(folds, p, n))
    others = dealt.select("target", F.col(score).alias("score"), F.explode(F.array_remove(F.array(*[F.lit(i) for i in range(k)]), F.col("fold"))).alias("part"))
    fits = _fits(_grouped(others, "score", "part"), method)
    out = F.lit(None).cast("double")
    for part, calibrator in sorted(fits.items()):
        out = F.when(F.col("fold") == part, calibrated(F.col(score), calibrator)).otherwise(out)
    return dealt.withColumn("calibrated", out)


def decision(before: DataFrame, after: DataFrame, by: str = "split") -> DataFrame:
    """Whether to adopt a calibrator, from two reports (metrics.calibration_report): the error exceeds twice the noise floor, falls by a tenth at least, the Brier score does not rise and average precision falls by 2 % at most (not asked where it is not defined)."""
    b = before.select(by, *[F.col(c).alias(f"{c}_before") for c in ("ece", "brier", "pr_auc", "noise_floor")])
    j = b.join(after.select(by, *[F.col(c).alias(f"{c}_after") for c in ("ece", "brier", "pr_auc")]), by)
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    ranked = finite("pr_auc_before") & finite("pr_auc_after") & (F.col("pr_auc_before") > 0)
    j = j.withColumn("relative_gain", F.when(F.col("ece_before") > 0, (F.col("ece_before") - F.col("ece_after")) / F.col("ece_before")).otherwise(0.0)).withColumn("ranking_loss", F.when(ranked, (F.col("pr_auc_before") - F.col("pr_auc_after")) / F.col("pr_auc_before")))
    real = finite("noise_floor_before") & (F.col("ece_before") > NOISE * F.col("noise_floor_before"))
    why = F.when(~finite("ece_before") | ~finite("ece_after"), "undefined").when(~real, "within noise").when(F.coalesce(F.col("ranking_loss") > RANKING, F.lit(False)), "ranking lost").when(F.col("brier_after") > F.col("brier_before"), "brier worse").when(F.col("relative_gain") < GAIN, "gain too small").otherwise("adopted")
    return j.withColumn("reason", why).withColumn("adopt", F.col("reason") == "adopted")


def frozen_policy(df: DataFrame, method: str | None = "isotonic", objective: str = "f1", folds: int = 5, seed: int = 42, beta: float = 2.0, floor: float = 0.5) -> dict:
    """The decision policy of a validation split (rows of one split, target 0 or 1): the best threshold of each objective, a calibrator if one of out-of-fold scores is adopted, and the threshold of the chosen objective, on calibrated scores where there is one."""
    if objective not in OBJECTIVES:
        raise ValueError(f"an objective is one of {OBJECTIVES}")
    rows = materialize(df.select("fn_id", "target", "score").withColumn("split", F.lit("valid")))
    best = {r.objective: r for r in metrics.best_threshold(rows, beta=beta, floor=floor).collect()}
    policy = {"selected_on": "validation", "objective": objective, "threshold": best[objective].threshold, "objectives": {k: {"threshold": r.threshold, "value": r.value} for k, r in sorted(best.items())}, "calibrator": None, "decision": None}
    if method:
        honest = materialize(out_of_fold(rows, method, folds, seed))
        told = decision(metrics.calibration_report(rows), metrics.calibration_report(honest, score="calibrated")).first()
        policy["decision"] = {"method": method, "adopt": told.adopt, "reason": told.reason, "ece_before": told.ece_before, "ece_after": told.ece_after}
        if told.adopt:
            policy["calibrator"] = fit(rows, method)
            scored = rows.withColumn("score", calibrated(F.col("score"), policy["calibrator"]))
            policy["threshold"] = next(r.threshold for r in metrics.best_threshold(scored, beta=beta, floor=floor).collect() if r.objective == objective)
    return json.loads(json.dumps(policy))


def evaluated(df: DataFrame, policy: dict) -> DataFrame:
    """Metrics of a test split under a frozen policy, at 0.5 and at its threshold; a policy that was not selected on validation is refused."""
    if policy.get("selected_on") != "validation":
        raise ValueError("a policy has to be selected on validation")
    score = calibrated(F.col("score"), policy["calibrator"]) if policy.get("calibrator") else F.col("score")
    at = df.withColumn("score", score).withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(float(policy["threshold"])))))
    return metrics.confusion(at, F.col("score") >= F.col("threshold"), "threshold")


def hybrids(df: DataFrame, threshold: float, rules: list[str], boost: float = 0.15) -> DataFrame:
    """(variant, counts, rates, roc_auc, average_precision) of the model alone, each rule score (a column, flagged above 0), their union, their intersection and the model's score raised where the rule flags.

    df has target, score and the rules' columns; all variants are counted in one pass."""
    ml = F.col("score") >= threshold
    variant = lambda name, score, flag: F.struct(F.lit(name).alias("variant"), score.cast("double").alias("score"), flag.alias("flag"))
    all_ = [variant("ml_only", F.col("score"), ml)]
    for r in rules:
        hit = F.col(r) > 0
        raised = scalars.blend(F.col("score"), F.col(r), boost)
        all_ += [variant(r, F.col(r), F.col(r) >= 1e-9), variant(f"ml_or_{r}", (ml | hit).cast("int"), ml | hit), variant(f"ml_and_{r}", (ml & hit).cast("int"), ml & hit), variant(f"ml_plus_{r}", raised, raised >= threshold)]
    x = df.select("target", F.inline(F.array(*all_)))
    return metrics.confusion(x, F.col("flag"), "variant").join(metrics.ranking(x, "variant").drop("positives", "negatives"), "variant")


def calibration_ablation(df: DataFrame, threshold: float) -> DataFrame:
    """(scores, threshold, counts, rates): the calibrated scores at a threshold and the raw ones at the least raw score that it flags; no row where it flags none."""
    flagged = df.where(F.col("score") >= threshold).agg(F.min("raw_score")).first()[0]
    if flagged is None:
        return metrics.confusion(df.where("false").select("target", F.lit("").alias("scores"), F.lit(0.0).alias("threshold"), F.lit(True).alias("flag")), F.col("flag"), "scores", "threshold")
    pick = lambda name, score, t: F.struct(F.lit(name).alias("scores"), F.lit(float(t)).alias("threshold"), (score >= t).alias("flag"))
    x = df.where(F.col("raw_score").isNotNull()).select("target", F.inline(F.array(pick("calibrated", F.col("score"), threshold), pick("raw", F.col("raw_score"), flagged))))
    return metrics.confusion(x, F.col("flag"), "scores", "threshold")


def slice_metrics(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Per slice: rows, positives, counts, recall and precision (NaN where undefined), mean score of either class and whether positives are few."""
    y, flag = F.col("target") == 1, F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1))
    nan = F.lit(float("nan"))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n(y).alias("positives"), n(flag & y).alias("tp"), n(flag & ~y).alias("fp"), n(~flag & y).alias("fn"), n(~flag & ~y).alias("tn"), F.avg(F.when(y, F.col("score"))).alias("p"), F.avg(F.when(~y, F.col("score"))).alias("m"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), nan)
    return g.select(*by, "n", "positives", "tp", "fp", "fn", "tn", share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.coalesce("p", nan).alias("mean_positive"), F.coalesce("m", nan).alias("mean_negative"), (F.col("positives") < SMALL).alias("small"))


def slices(df: DataFrame, threshold: float, top: int = 12) -> DataFrame:
    """(slice, value, …) of slice_metrics by truncation, number of chunks, and the classes and projects with most rows.

    df has target, score, truncated, chunks, cwe (array) and project. A row of several classes is in each of their slices."""
    truncated = F.when(F.col("truncated"), "truncated").otherwise("whole")
    one = F.array(F.struct(F.lit("truncation").alias("slice"), truncated.alias("value")), F.struct(F.lit("chunks").alias("slice"), F.coalesce(F.col("chunks").cast("string"), F.lit("none")).alias("value")))
    classes = F.transform(F.array_distinct(coerced_cwe(F.col("cwe"))), lambda c: F.struct(F.lit("cwe").alias("slice"), c.alias("value")))
    project = F.when(label_key(F.col("project")).isNotNull(), F.array(F.struct(F.lit("project").alias("slice"), label_key(F.col("project")).alias("value")))).otherwise(F.array().cast("array<struct<slice:string,value:string>>"))
    x = df.select("target", "score", F.inline(F.concat(one, classes, project)))
    per = slice_metrics(x, threshold, "slice", "value")
    first = lambda s: per.where(F.col("slice") == s).orderBy(F.col("n").desc(), "value").limit(top)
    return per.where(F.col("slice").isin("truncation", "chunks")).unionByName(first("cwe")).unionByName(first("project"))


def truncation_ratio(df: DataFrame, by: str = "split") -> DataFrame:
    """Per split: share of truncated rows of either class and the positives' share divided by the negatives' (infinite where those have none)."""
    share = lambda v: F.avg(F.when(F.col("target") == v, F.coalesce(F.col("truncated"), F.lit(False)).cast("double")))
    g = df.groupBy(by).agg(share(1).alias("positive_rate"), share(0).alias("negative_rate"))
    return g.withColumn("ratio", F.when(F.col("negative_rate") == 0, F.lit(float("inf"))).otherwise(F.try_divide("positive_rate", "negative_rate")))


def agreement(df: DataFrame, threshold: float, rule: str = "rule_score") -> DataFrame:
    """(rule_flag, ml_flag, n, positives, precision): how the two flags agree."""
    g = df.groupBy((F.col(rule) > 0).alias("rule_flag"), (F.col("score") >= threshold).alias("ml_flag")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("target") == 1, 1)).alias("positives"))
    return g.withColumn("precision", F.col("positives") / F.col("n"))


def overlap_flags(functions: DataFrame, left: str = "valid", right: str = "test") -> DataFrame:
    """(fn_id, overlaps): of the right split's rows, whether the left split has a row of the same normalised text. Rows without a text overlap with nothing."""
    h = functions.where(F.length(normalized_code(F.col("func"))) > 0).select("split", "fn_id", code_hash(normalized_code(F.col("func"))).alias("h"))
    seen = h.where(F.col("split") == left).select("h").distinct().withColumn("overlaps", F.lit(True))
    mine = functions.where(F.col("split") == right).select("fn_id")
    hit = h.where(F.col("split") == right).join(seen, "h").select("fn_id", "overlaps").distinct()
    return mine.join(hit, "fn_id", "left").select("fn_id", F.coalesce("overlaps", F.lit(False)).alias("overlaps"))


def sensitivity(df: DataFrame, threshold: float) -> DataFrame:
    """(metric, with_overlap, without_overlap, delta, largest): seven metrics of all rows and of those that do not overlap (df has overlaps), and which delta is the largest."""
    x = df.withColumn("part", F.explode(F.when(F.col("overlaps"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("rest")))))
    m = metrics.confusion(x, F.col("score") >= threshold, "part").join(metrics.ranking(x, "part"), "part")
    names = ["accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "average_precision"]
    long_ = m.select("part", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])))
    g = long_.groupBy("metric").agg(F.max(F.when(F.col("part") == "all", F.col("value"))).alias("with_overlap"), F.max(F.when(F.col("part") == "rest", F.col("value"))).alias("without_overlap"))
    g = g.withColumn("delta", F.col("without_overlap") - F.col("with_overlap"))
    top = F.broadcast(g.agg(F.max_by("metric", F.struct(F.abs("delta"), "metric")).alias("top")))  # one row
    return g.crossJoin(top).select("metric", "with_overlap", "without_overlap", "delta", (F.col("metric") == F.col("top")).alias("largest"))


def high_loss(df: DataFrame, over: float = 2.0, most: int = 5, pos_weight: float = 1.0) -> DataFrame:
    """The rows of the largest weighted cross-entropy above a bound, the first ``most``: fn_id, target, score, logit, loss."""
    x = scalars.logit(F.col("score"))
    found = df.select("fn_id", "target", "score", x.alias("logit"), scalars.binary_cross_entropy(x, F.col("target").cast("double"), pos_weight).alias("loss"))
    return found.where(F.col("loss") > over).orderBy(F.col("loss").desc(), "fn_id").limit(most)


def positional(predictions: DataFrame, others: dict[str, DataFrame], key: str = "row_idx") -> DataFrame:
    """Predictions joined with other tables of the same rows by their place; tables of another length, or with a place that is missing or repeated, are refused.

    The lengths and places are checked by one aggregate a table."""
    n = predictions.count()
    out = predictions
    for name, other in others.items():
        m, places = other.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        out = out.join(other.select(key, *[F.col(c).alias(f"{name}_{c}") for c in other.columns if c != key]), key)
        if m != n or places != n:
            raise ValueError(f"{name} has {m} rows at {places} places, the predictions {n}")
    return out
