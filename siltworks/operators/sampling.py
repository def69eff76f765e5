"""Samples, permutations and folds by a reproducible random order; no class is gathered in one task."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.scalars import uniform

#: Hexadecimal digits of the order by which rows are put in buckets.
DIGITS = 3
# The spaces that a search draws from.
SEARCH = {"learning_rate": ("loguniform", (1e-6, 5e-5)), "dropout": ("uniform", (0.1, 0.5)), "weight_decay": ("uniform", (0.0, 0.1)), "warmup_ratio": ("uniform", (0.0, 0.15)), "batch_size": ("categorical", [2, 4, 8]), "grad_accum_steps": ("categorical", [1, 2, 4])}
OPTIMISATION = {"scheduler": ("categorical", ["linear", "cosine", "constant_with_warmup"]), "loss": ("categorical", ["bce", "focal"])}
ARCHITECTURE = {"function_pooling": ("categorical", ["mean", "max", "attention"]), "chunk_pooling": ("categorical", ["cls", "mean"])}
MEMORY = {"chunk_micro_batch": ("categorical", [2, 4, 8, 16])}


def random_order(seed: int | str, key: str = "fn_id") -> Column:
    """A reproducible random order that other engines can compute: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def with_rank(df: DataFrame, by: list[str], order: Column, tie: str = "fn_id", name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, among the rows of equal ``by`` in the order of a hexadecimal text.

    Rows fall into 4,096 buckets by the order's first digits; a bucket's rows are ranked among themselves and the rows of the buckets before, which are counted, are added. The values of ``by`` must be few (labels, splits): there are 4,096 counts for each."""
    o, b, before = f"__{name}_o", f"__{name}_b", f"__{name}_before"
    x = df.withColumn(o, order).withColumn(b, F.left(o, F.lit(DIGITS)))
    counts = x.groupBy(*by, b).agg(F.count(F.lit(1)).alias(before))
    up = F.sum(before).over(W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn(before, F.coalesce(up, F.lit(0)))
    here = x.withColumn(name, F.row_number().over(W.partitionBy(*by, b).orderBy(o, tie)))
    on = here.alias("x").join(F.broadcast(starts.alias("s")), [F.col(f"x.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, b]])  # 4,096 rows a value of by
    return on.select(*[F.col(f"x.`{c}`") for c in df.columns], (F.col(f"x.{name}") + F.col(f"s.{before}")).cast("long").alias(name))


def by_class(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a target of 1 and those with 0."""
    return df.where(F.col("target") == 1), df.where(F.col("target") == 0)


def class_counts(df: DataFrame) -> tuple[int, int]:
    """The numbers of rows with target 1 and 0."""
    r = df.agg(F.count(F.when(F.col("target") == 1, 1)).alias("p"), F.count(F.when(F.col("target") == 0, 1)).alias("n")).first()
    return r.p, r.n


def drawn(df: DataFrame, positives: int, negatives: int, seed: int | str = 42) -> DataFrame:
    """So many rows of either class, the first in random order."""
    y = F.col("target")
    ranked = with_rank(df.where(y.isin(0, 1)), ["target"], random_order(seed))
    return ranked.where(((y == 1) & (F.col("rank") <= positives)) | ((y == 0) & (F.col("rank") <= negatives))).drop("rank")


def require_train(name: str) -> str:
    """The name of a table to undersample, which has to say that it is a training split: others keep their own shares."""
    if "train" not in name.rsplit("/", 1)[-1].lower():
        raise ValueError(f"{name} is not a training split")
    return name


def undersampled(df: DataFrame, ratio: float = 10.0, seed: int = 42, half_even: bool = False) -> DataFrame:
    """All positives and ratio times as many negatives, cut to a whole number or (half_even) rounded, half to even, the first in random order."""
    p, n = class_counts(df)
    return drawn(df, p, min(n, round(p * ratio) if half_even else int(p * ratio)), seed)


def undersampling_report(df: DataFrame, ratio: float = 10.0, seed: int = 42) -> DataFrame:
    """What undersampling (rounded) would keep, in one row: nothing is drawn."""
    p, n = class_counts(df)
    kept = min(n, round(p * ratio))
    return df.sparkSession.createDataFrame([(p + n, p, p, kept, p + kept, float(ratio), kept / max(1, p), seed)], "input_records long, input_positive long, kept_positive long, kept_negative long, kept_total long, requested_ratio double, achieved_ratio double, seed int")


def stratified_limit(df: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """``limit`` rows in the classes' own shares, one positive at least; all rows where there are no more than that."""
    p, n = class_counts(df)
    if not limit or limit >= p + n:
        return df.where(F.col("target").isin(0, 1))
    want = max(1, round(p * (limit / (p + n))))
    return drawn(df, want, limit - want, seed)


def stratified_subset(df: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """As stratified_limit; where one class is short the other fills up."""
    p, n = class_counts(df)
    limit = min(limit, p + n)
    want = min(max(1 if p else 0, round(limit * p / max(1, p + n))), p, limit)
    other = min(limit - want, n)
    return drawn(df, min(p, want + limit - want - other), other, seed)


def balanced_subset(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """Half positives (as far as there are) and negatives for the rest."""
    p, n = class_counts(df)
    half = min(limit // 2, p)
    return drawn(df, half, min(n, limit - half), seed)


def folds(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """df with ``fold``: rows of each class dealt to k folds in random order; fewer folds where a class is smaller, never under two."""
    k = max(2, min(k, *class_counts(df)))
    ranked = with_rank(df.where(F.col("target").isin(0, 1)), ["target"], random_order(seed), name="__rank")
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def permutation(df: DataFrame, seed: int, epoch: int, skip: int = 0, key: str = "fn_id") -> DataFrame:
    """df with ``place``, from 0, in the epoch's random order, without the first ``skip`` places, so that a run can go on where it ended."""
    one = df.withColumn("__all", F.lit(1))
    ranked = with_rank(one, ["__all"], random_order(seed * 1_000_003 + epoch, key), key, "place").drop("__all")
    return ranked.withColumn("place", F.col("place") - 1).where(F.col("place") >= skip)


def search_space(architecture: bool = False, memory: bool = False, optimisation: bool = False, pinned: dict | None = None, learning_rate: tuple[float, float] | None = None) -> dict:
    """The parameters to draw: the base, with other groups on request, one range replaced and parameters pinned to a value."""
    space = SEARCH | (OPTIMISATION if optimisation else {}) | (ARCHITECTURE if architecture else {}) | (MEMORY if memory else {})
    if learning_rate:
        space = space | {"learning_rate": ("loguniform", learning_rate)}
    return space | {k: ("categorical", [v]) for k, v in (pinned or {}).items()}


def trials(df: DataFrame, space: dict, seed: int = 42, trial: str = "trial") -> DataFrame:
    """df (one row a trial) with a drawn value of each parameter."""
    out = []
    for name, (kind, spec) in space.items():
        u = uniform(seed, F.col(trial), F.lit(name))
        if kind == "loguniform":
            c = F.exp(F.lit(math.log(spec[0])) + u * (math.log(spec[1]) - math.log(spec[0])))
        elif kind == "uniform":
            c = spec[0] + u * (spec[1] - spec[0])
        elif kind == "categorical":
            c = F.get(F.array(*[F.lit(v) for v in spec]), F.floor(u * len(spec)).cast("int"))
        else:
            raise ValueError(f"unknown kind of parameter: {kind}")
        out.append(c.alias(name))
    return df.select("*", *out)


def random_search(space: dict, evaluate: Callable[[dict], float], spark: SparkSession, n: int = 20, seed: int = 42) -> DataFrame:
    """(trial, parameters as JSON, score, error, place) of n drawn configurations, each scored by a function of its parameters, which may run jobs of its own. A trial that fails is recorded with its error and comes last."""
    rows = []
    for r in trials(spark.range(n).withColumnRenamed("id", "trial"), space, seed).orderBy("trial").collect():  # n rows
        drawn_ = {k: r[k] for k in space}
        try:
            score, error = float(evaluate(drawn_)), None
        except Exception as e:  # noqa: BLE001 - a trial that runs out of memory is a result
            score, error = None, repr(e)[:500]
        rows.append((r.trial, json.dumps(drawn_, sort_keys=True), score, error))
    return best_trial(spark.createDataFrame(rows, "trial long, parameters string, score double, error string"))


def best_trial(df: DataFrame, score: str = "score", trial: str = "trial") -> DataFrame:
    """The trials in order of their score, with ``place`` from 1; a failed trial (null, NaN) comes last. Trials are few."""
    s = F.when(F.col(score).isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(F.col(score))
    return df.withColumn("place", F.row_number().over(W.orderBy(s.desc(), F.col(trial))))


def early_stop(df: DataFrame, by: str, epoch: str, score: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(by, best_epoch, best_score, stopped): a run's epochs in order; a score is better if it exceeds the best by more than min_delta, and the run stops at the epoch that makes ``patience`` misses in a row (null if it never does). A run's epochs are few."""
    runs = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(score).cast("double").alias("s")))).alias("all"))
    start = F.struct(F.lit(None).cast("long").alias("e"), F.lit(None).cast("double").alias("s"), F.lit(0).alias("misses"), F.lit(None).cast("long").alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        better = acc["s"].isNull() | (x["s"] > acc["s"] + min_delta)
        missed = acc["misses"] + 1
        after = F.struct(F.when(better, x["e"]).otherwise(acc["e"]).alias("e"), F.when(better, x["s"]).otherwise(acc["s"]).alias("s"), F.when(better, F.lit(0)).otherwise(missed).alias("misses"), F.when(~better & (missed >= patience), x["e"]).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(after)

    end = F.aggregate("all", start, step)
    return runs.select(by, end["e"].alias("best_epoch"), end["s"].alias("best_score"), end["stop"].alias("stopped"))
