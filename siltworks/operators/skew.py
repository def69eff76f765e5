"""Aggregates and joins that a few hot keys cannot hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.text import label_key
from siltworks.plans.runtime import materialize


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Joins left, whose keys may be hot, to right, which has one row a key.

    A hot key's left rows spread over ``salts`` tasks; right is repeated as often. A null key matches nothing."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def key_states(df: DataFrame, key: Column, sums: dict[str, Column], name: str = "key", nulls: bool = False) -> DataFrame:
    """One compact state for each key: its rows (``n``) and the sums named.

    The sums are partial before the shuffle, so a key with a third of all rows moves as one row for each map task. Rows with a null key form no group or, nulls, one of their own."""
    keyed = df.select(key.alias(name), *[v.alias(k) for k, v in sums.items()])
    return (keyed if nulls else keyed.where(F.col(name).isNotNull())).groupBy(name).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in sums])


def eager_join_states(left: DataFrame, right: DataFrame, name: str = "key", how: str = "left") -> DataFrame:
    """Joins two state tables of key_states, of which the join of the rows themselves would multiply every pair.

    Result: key; ``left_n``, ``right_n``; every sum as ``left_x`` or ``right_x`` over its own side; ``pairs``, the rows that the join of both inputs would have; ``joined_x``, the sum over those rows: the side's sum times the other side's count. A key missing on a side counts as zero rows."""
    lc, rc = [c for c in left.columns if c != name], [c for c in right.columns if c != name]
    l = left.select(name, *[F.col(c).alias(f"left_{c}") for c in lc])
    r = right.select(name, *[F.col(c).alias(f"right_{c}") for c in rc])
    j = l.join(r, name, how)
    j = j.select(name, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in j.columns if c != name])
    return j.select(
        "*",
        (F.col("left_n") * F.col("right_n")).alias("pairs"),
        *[(F.col(f"left_{c}") * F.col("right_n")).alias(f"joined_left_{c}") for c in lc if c != "n"],
        *[(F.col(f"right_{c}") * F.col("left_n")).alias(f"joined_right_{c}") for c in rc if c != "n"],
    )


def project_profile(functions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per project: rows, share of all rows, label counts and rate, size of the texts and, with documents, the figures of the join of both tables by project.

    Labels other than 0 and 1 and null texts add nothing to their sums. A rate without labels is null. Both tables are aggregated by project before they meet; the states, one row a project, are written, so that the table is read once for them and for the total. Empty tables give an empty result; a null or blank project forms no group but counts in the total."""
    t = F.col("target")
    sums = {
        "positives": F.when(t == 1, 1).otherwise(0).cast("long"),
        "labelled": F.when(t.isin(0, 1), 1).otherwise(0).cast("long"),
        "chars": F.coalesce(F.length("func"), F.lit(0)).cast("long"),
        "oversized": F.when(F.length("func") > 6000, 1).otherwise(0).cast("long"),
    }
    states = materialize(key_states(functions, label_key(F.col("project")), sums, "project", nulls=True))
    total = states.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    states = states.where(F.col("project").isNotNull())
    if documents is None:
        other = functions.sparkSession.createDataFrame([], T.StructType([T.StructField("project", T.StringType()), T.StructField("n", T.LongType()), T.StructField("chars", T.LongType())]))
    else:
        other = key_states(documents, label_key(F.col("project")), {"chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}, "project")
    j = eager_join_states(states, other, "project").crossJoin(F.broadcast(total))  # total is one row
    return j.select(
        "project",
        F.col("left_n").alias("rows"),
        F.round(F.col("left_n") / F.col("total"), 9).alias("share"),
        F.col("left_positives").alias("positives"),
        F.col("left_labelled").alias("labelled"),
        F.round(F.try_divide("left_positives", "left_labelled"), 9).alias("label_rate"),
        F.col("left_chars").alias("chars"),
        F.col("left_oversized").alias("oversized"),
        F.col("right_n").alias("documents"),
        F.col("right_chars").alias("document_chars"),
        F.col("pairs"),
        F.col("joined_left_chars").alias("pair_chars"),
        "total",
    )


def hot_projects(functions: DataFrame, documents: DataFrame | None = None, least_share_percent: int = 4) -> DataFrame:
    """The profiles of the projects that hold at least the given share of all rows, rows without a project counted in the total. The whole profile, the join's figures included, is computed and written first."""
    return materialize(project_profile(functions, documents)).where(F.col("rows") * 100 >= F.col("total") * least_share_percent)
