"""Pooling of chunk vectors to one vector a function, and the batches that models take."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators import metrics

METHODS = ("mean", "max", "attention")


def token_pooled(tokens: Column, method: str = "mean", mask: Column | None = None) -> Column:
    """One vector of an array of token vectors: their mean (of those that the mask, an array of 0 and 1, keeps; zeros where it keeps none) or the first one (cls)."""
    if method == "cls":
        return F.get(tokens, F.lit(0))
    if method != "mean":
        raise ValueError("tokens are pooled by mean or cls")
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), (mask if mask is not None else F.transform(tokens, lambda _: F.lit(1))).alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    size = F.greatest(F.size(kept), F.lit(1))
    total = F.aggregate(kept, F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0).cast("double")), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return F.transform(total, lambda v: v / size)


def pooled(chunks: DataFrame, key: str, vector: str, method: str = "mean", score: str | None = None) -> DataFrame:
    """(key, vector): the chunk vectors of each function as one, by dimension: their mean, their largest value, or (attention) their sum weighted by the softmax of a score. Null vectors take no part; a function without vectors has no row.

    Values are aggregated by function and dimension, partially before the shuffle, so a function of many chunks is in no single row before the end."""
    if method not in METHODS:
        raise ValueError(f"vectors are pooled by one of {METHODS}")
    x = chunks.where(F.col(vector).isNotNull())
    if method == "attention":
        top = x.groupBy(key).agg(F.max(score).alias("__top"))  # shifted by the largest score, so that none overflows
        x = x.join(top, key).withColumn("__w", F.exp(F.col(score) - F.col("__top")))
    else:
        x = x.withColumn("__w", F.lit(1.0))
    each = x.select(key, "__w", F.posexplode(vector).alias("__i", "__v"))
    value = F.max("__v").cast("double") if method == "max" else F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")
    per = each.groupBy(key, "__i").agg(value.alias("__v"))
    return per.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias("vector"))


def collated(df: DataFrame, key: str = "fn_id", chunks: str = "chunks", width: int = 512, pad: int = 1, most: int | None = None) -> DataFrame:
    """(key, chunk_no, ids, mask): the chunks of every function, ``most`` at most, padded to one width, with a mask of what is no padding. Chunks longer than the width are refused by the query."""
    c = F.slice(F.col(chunks), 1, most) if most else F.col(chunks)
    x = df.select(key, F.posexplode(c).alias("chunk_no", "c"))
    n = F.size("c")
    full = F.concat("c", F.array_repeat(F.lit(pad), F.greatest(F.lit(0), width - n)))
    checked = F.when(n <= width, full).otherwise(F.raise_error(F.lit(f"a chunk has more than {width} tokens")).cast("array<int>"))
    return x.select(key, "chunk_no", checked.alias("ids"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= n).cast("int")).alias("mask"))


def guarded(df: DataFrame, chunks: str = "chunks", most: int | None = None, cached: bool = False) -> DataFrame:
    """df for training: a record without chunks and an empty table are refused, ``most`` chunks are kept, the table is cached on request."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    n = F.coalesce(F.size(chunks), F.lit(0))
    kept = F.slice(F.col(chunks), 1, most) if most else F.col(chunks)
    out = df.withColumn(chunks, F.when(n > 0, kept).otherwise(F.raise_error(F.lit("a record without chunks")).cast(df.schema[chunks].dataType)))
    return out.cache() if cached else out


def classifier(df: DataFrame, vector: str = "vector", label: str = "target", pos_weight: float | None = None, steps: int = 50) -> LogisticRegressionModel:
    """A linear head over pooled vectors, positives weighted by negatives to positives (50 at most) or a given weight; fitted by distributed gradients."""
    if pos_weight is None:
        r = df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n")).first()
        pos_weight = min(r.n / r.p, 50.0) if r.p else 1.0
    rows = df.where(F.col(label).isin(0, 1)).select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(1.0).alias("weight"))
    return LogisticRegression(weightCol="weight", maxIter=steps).fit(rows)


def predicted(df: DataFrame, model: LogisticRegressionModel, vector: str = "vector") -> DataFrame:
    """df with ``logit`` and ``score`` of a fitted head."""
    out = model.transform(df.withColumn("features", array_to_vector(F.col(vector))))
    return out.withColumn("logit", F.get(vector_to_array("rawPrediction"), F.lit(1))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability", "prediction")


def fitted(train: DataFrame, valid: DataFrame, epochs: int = 5, steps: int = 4, patience: int = 2, min_delta: float = 0.0, monitor: str = "average_precision") -> tuple[LogisticRegressionModel, DataFrame]:
    """(the best head, its history): heads of more and more steps, each scored on the validation rows by a ranking metric, until ``patience`` epochs in a row do not exceed the best by more than min_delta; the best one is given back."""
    spark = train.sparkSession
    best, top, misses, history = None, float("-inf"), 0, []
    for epoch in range(1, epochs + 1):
        model = classifier(train, steps=epoch * steps)
        r = metrics.ranking(predicted(valid, model).withColumn("__one", F.lit(1)), "__one").first()
        score = r[monitor] if r is not None else float("nan")
        history.append((epoch, score))
        if best is None or score > top + min_delta:
            best, top, misses = model, score if score == score else top, 0
        else:
            misses += 1
            if misses >= patience:
                break
    return best, spark.createDataFrame(history, "epoch long, score double")
