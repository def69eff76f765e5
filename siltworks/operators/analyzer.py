"""All detectors together: findings of a function, its risk, and detectors as scorers of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators import detect, metrics, taint
from siltworks.plans.runtime import materialize

SCORERS = ("rules_only", "taint_only", "rules_taint")


def all_findings(df: DataFrame, key: str, code: str, language: Column | str | None = "cpp") -> DataFrame:
    """(key, detector, type, function, severity, cwe, line) of the line detectors and, last, of taint flows, whose function is the sink."""
    rules = detect.findings(df, key, code, language if language is not None else detect.detected_language(F.col(code)))
    flows = taint.flows(df, key, code, language)
    return rules.unionByName(flows.select(key, F.lit(6).alias("detector"), F.lit("TAINT_FLOW").alias("type"), F.col("sink").alias("function"), "severity", "cwe", "line"))


def unique_findings(df: DataFrame, key: str, code: str, language: Column | str | None = "cpp") -> DataFrame:
    """One finding for each type, class, line and function (a flow's sink), with its confidence; a flow's is its type's."""
    u = detect.unique_findings(all_findings(df, key, code, language), key)
    return u.withColumn("confidence", F.when(F.col("type") == "TAINT_FLOW", F.lit(detect.CONFIDENCE_BY_TYPE["TAINT_FLOW"])).otherwise(F.col("confidence")))


def analysed(df: DataFrame, key: str, code: str, language: Column | str | None = "cpp") -> DataFrame:
    """Per item: findings, rule score, security score and level (detect.risk) of all detectors together."""
    return detect.risk(df, unique_findings(df, key, code, language), key)


def scores(df: DataFrame, key: str = "fn_id", code: str = "func", language: str = "cpp") -> DataFrame:
    """(key, rules_only, taint_only, rules_taint): the summed severity weights, 1 at most, of the rules' findings, of the flows, and of both without repeats. All three come from one pass over the texts; a text that cannot be read (null) scores 0."""
    weight = detect.lookup(detect.SEVERITY_WEIGHT, F.col("severity"), F.lit(0.4))
    found = all_findings(df, key, code, language)
    each = found.groupBy(key, "type", "cwe", "line", "function").agg(F.min_by("severity", "detector").alias("severity"), F.sum(weight).alias("raw"))
    flow = F.col("type") == "TAINT_FLOW"
    score = lambda c, w: F.least(F.lit(1.0), F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)))
    per = each.groupBy(key).agg(score(~flow, F.col("raw")).alias("rules_only"), score(flow, F.col("raw")).alias("taint_only"), score(F.lit(True), weight).alias("rules_taint"))
    return df.select(key).join(per, key, "left").na.fill(0.0, list(SCORERS))


def baselines(df: DataFrame, by: str = "split") -> DataFrame:
    """(by, scorer, counts, rates, ranking) of each scorer above 0, of rows with a target of 0 or 1."""
    rows = df.where(F.col("target").isin(0, 1))
    s = rows.select("fn_id", by, "target").join(materialize(scores(rows)), "fn_id")
    x = s.select("target", F.inline(F.array(*[F.struct(F.concat_ws("|", F.col(by), F.lit(n)).alias("group"), F.col(by).alias(by), F.lit(n).alias("scorer"), F.col(n).alias("score")) for n in SCORERS])))
    m = metrics.confusion(x, F.col("score") >= 1e-9, "group", by, "scorer")
    return m.join(metrics.ranking(x, "group").select("group", "roc_auc", "average_precision"), "group").drop("group")
