"""Scores of binary predictions (score, target) as relational aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The thresholds of a sweep.
SWEEP = [round(0.05 + 0.01 * i, 2) for i in range(91)]


def usable(df: DataFrame) -> DataFrame:
    """Distinct predictions with a number as score and a target of 0 or 1."""
    return df.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("target").isin(0, 1)).select("fn_id", "split", "score", "raw_score", "target").distinct()


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, F1 and MCC to counts tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.select(
        "*",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp * tn - fp * fn, root).alias("mcc"),
    )


def confusion(df: DataFrame, flag: Column, *by: str) -> DataFrame:
    y = F.col("target") == 1
    n = lambda c: F.count(F.when(c, 1))
    return rates(df.groupBy(*by).agg(n(~flag & ~y).alias("tn"), n(flag & ~y).alias("fp"), n(~flag & y).alias("fn"), n(flag & y).alias("tp")))


def sweep(df: DataFrame, by: str = "split") -> DataFrame:
    """The confusion matrix at each threshold: every row is put in the bucket of the largest threshold that it reaches, and buckets are added up."""
    reached = sum((F.col("score") >= F.lit(t)).cast("int") for t in SWEEP)
    buckets = df.groupBy(by, reached.alias("b")).agg(F.count(F.when(F.col("target") == 1, 1)).alias("p"), F.count(F.when(F.col("target") == 0, 1)).alias("n"))
    grid = df.select(by).distinct().select(by, F.posexplode(F.array(*[F.lit(t) for t in SWEEP])).alias("i", "threshold"))
    full = grid.select(by, (F.col("i") + 1).alias("b"), "threshold").join(buckets, [by, "b"], "full").na.fill(0, ["p", "n"])
    w = W.partitionBy(by)
    up = w.orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = full.select(by, "threshold", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(w).alias("all_p"), F.sum("n").over(w).alias("all_n")).where(F.col("threshold").isNotNull())
    return rates(out.select(by, "threshold", (F.col("all_n") - F.col("fp")).alias("tn"), "fp", (F.col("all_p") - F.col("tp")).alias("fn"), "tp"))


def objective(name: str, beta: float = 2.0, floor: float = 0.5) -> Column:
    """What a threshold is chosen by."""
    p, r = F.col("precision"), F.col("recall")
    if name == "f1":
        return F.col("f1")
    if name == "mcc":
        return F.col("mcc")
    if name == "fbeta":
        return ratio((1 + beta * beta) * p * r, beta * beta * p + r)
    if name == "recall_at_precision":
        return F.when(p >= floor, 1 + r).otherwise(p / max(floor, 1e-12))
    raise ValueError(name)


def best_threshold(df: DataFrame, by: str = "split", beta: float = 2.0, floor: float = 0.5) -> DataFrame:
    """Per objective the first threshold with the largest value."""
    table = sweep(df, by)
    names = ["f1", "fbeta", "mcc", "recall_at_precision"]
    long_ = table.select(by, "threshold", F.inline(F.array(*[F.struct(F.lit(n).alias("objective"), objective(n, beta, floor).alias("value")) for n in names])))
    return long_.groupBy(by, "objective").agg(F.max("value").alias("value"), F.min_by("threshold", F.struct(-F.col("value"), F.col("threshold"))).alias("threshold"))


def running(df: DataFrame, by: str, value: str, sums: list[str]) -> DataFrame:
    """df, whose rows have distinct values of a score for each ``by``, with ``upto_x``: each sum over the rows whose score is as large or larger.

    Scores fall into 4,096 buckets, ranked by their width of [0, 1]; a bucket's rows are added up among themselves, after the sums of the buckets above, so no task holds all scores of a split. Scores outside [0, 1] are in the outer buckets."""
    b = F.greatest(F.lit(0), F.least(F.lit(4095), F.floor(F.col(value) * 4096))).cast("int")
    x = df.withColumn("__b", b)
    per = x.groupBy(by, "__b").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    above = W.partitionBy(by).orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(by, "__b", *[F.coalesce(F.sum(f"__{c}").over(above), F.lit(0)).alias(f"__{c}") for c in sums])
    here = W.partitionBy(by, "__b").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(c).over(here).alias(f"upto_{c}") for c in sums]).join(F.broadcast(starts), [by, "__b"])  # 4,096 rows a split
    return x.select(*df.columns, *[(F.col(f"upto_{c}") + F.col(f"__{c}")).alias(f"upto_{c}") for c in sums])


def ranking(df: DataFrame, by: str = "split", score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half) and average precision over distinct scores; NaN where a class is missing."""
    per = df.groupBy(by, F.col(score).alias("score")).agg(F.count(F.when(F.col("target") == 1, 1)).alias("p"), F.count(F.when(F.col("target") == 0, 1)).alias("n"))
    all_ = df.groupBy(by).agg(F.count(F.when(F.col("target") == 1, 1)).alias("all_p"), F.count(F.when(F.col("target") == 0, 1)).alias("all_n"))
    x = running(per, by, "score", ["p", "n"]).join(F.broadcast(all_), by)  # one row a split
    tp, fp = F.col("upto_p"), F.col("upto_n")
    nan = F.lit(float("nan"))
    both = (F.first("all_p") > 0) & (F.first("all_n") > 0)
    return x.groupBy(by).agg(
        F.first("all_p").alias("positives"),
        F.first("all_n").alias("negatives"),
        F.when(both, F.try_divide(F.sum(F.col("n") * (tp - F.col("p") / 2)), F.first("all_p") * F.first("all_n"))).otherwise(nan).alias("roc_auc"),
        F.when(both, F.sum(F.try_divide("p", "all_p") * F.try_divide(tp, tp + fp))).otherwise(nan).alias("average_precision"),
    )


def brier(df: DataFrame, by: str = "split", score: str = "score") -> DataFrame:
    """(by, n, brier, positive_rate): the mean squared error of the scores."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - F.col("target"), 2)).alias("brier"), F.avg(F.col("target").cast("double")).alias("positive_rate"))


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, edges): the quantiles at the shares, interpolated on a line between the two values around each. Values are counted first and added up by buckets (running), so no task holds all of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.groupBy(by).agg(F.sum("n").alias("all"), F.max("v").alias("top"), F.min("v").alias("bottom"))
    scaled = counts.join(F.broadcast(all_), by).withColumn("scaled", F.coalesce(F.try_divide(F.col("v") - F.col("bottom"), F.col("top") - F.col("bottom")), F.lit(0.0)))  # one row a value of by
    up = running(scaled, by, "scaled", ["n"]).withColumn("before", F.col("all") - F.col("upto_n"))  # rows below this value
    at = up.select(by, "v", "n", "before", F.posexplode(F.array(*[(F.col("all") - 1) * F.lit(float(s)) for s in shares])).alias("i", "k"))
    holds = lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))
    ends = at.groupBy(by, "i").agg(F.max(F.when(holds(F.floor("k")), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil("k")), F.col("v"))).alias("high"), F.first("k").alias("k"))
    value_at = F.col("low") + (F.col("high") - F.col("low")) * (F.col("k") - F.floor("k"))
    return ends.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value_at.alias("e")))), lambda x: x["e"]).alias("edges"))


def reliability(df: DataFrame, by: str = "split", bins: int = 10, strategy: str = "quantile", score: str = "score") -> DataFrame:
    """Bins between distinct interpolated quantiles (or, uniform, of equal width of [0, 1]); a score on an inner edge belongs to the upper bin. Empty bins are left out."""
    if strategy not in ("quantile", "uniform"):
        raise ValueError("bins are quantile or uniform")
    shares = [i / bins for i in range(bins + 1)]
    if strategy == "uniform":
        x = df.withColumn("edges", F.array(*[F.lit(s) for s in shares]))
    else:
        x = df.join(F.broadcast(quantiles(df, by, score, shares).select(by, F.array_distinct("edges").alias("edges"))), by)  # one row a split
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = x.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(score))).cast("long"))
    return binned.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col("target").cast("double")).alias("observed_rate"))


def calibration_error(df: DataFrame, by: str = "split", bins: int = 10, strategy: str = "quantile", score: str = "score") -> DataFrame:
    """Expected and largest calibration error and the expected error of a calibrated model, from the bins."""
    r = reliability(df, by, bins, strategy, score)
    gap = F.abs(F.col("mean_predicted") - F.col("observed_rate"))
    p = F.col("mean_predicted")
    noise = F.col("n") * F.sqrt(F.lit(0.6366197723675814)) * F.sqrt(p * (1 - p) / F.col("n"))  # 2 / pi
    return r.groupBy(by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum(noise) / F.sum("n")).alias("noise_floor"))


def calibration_report(df: DataFrame, by: str = "split", bins: int = 10, strategy: str = "quantile", score: str = "score") -> DataFrame:
    """One row for each value of ``by``: Brier score, calibration errors, noise floor, ROC-AUC and average precision."""
    out = brier(df, by, score).join(calibration_error(df, by, bins, strategy, score), by).join(ranking(df, by, score), by)
    return out.select(by, "n", "positive_rate", "brier", "ece", "mce", "noise_floor", "roc_auc", F.col("average_precision").alias("pr_auc"))
