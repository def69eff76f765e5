"""Queries of the core over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions import scalars
from siltworks.functions.text import trimmed
from siltworks.operators import corpus, detect, metrics, sampling, skew
from siltworks.plans.runtime import spread, table
from siltworks.streaming import logs

Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """df with its DOUBLE columns rounded, so that engines that add in another order give the same figures."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fns(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "code_functions"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.usable(table(spark, d, "predictions"))


@query
def p4_found(spark, d):
    return skew.hot_projects(fns(spark, d), table(spark, d, "documents")).select("project")


@query
def p4_profile(spark, d):
    return skew.project_profile(fns(spark, d), table(spark, d, "documents"))


@query
def raw_line_counts(spark, d):
    """Lines by split: all, blank, JSON objects by their form."""
    r = table(spark, d, "raw_records").select("split", trimmed(F.coalesce("raw_line", F.lit(""))).alias("t"))
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("t") == "", 1)).alias("blank"), F.count(F.when(F.col("t").rlike(r"^\{[\s\S]*\}$"), 1)).alias("braced"))


@query
def normalized_code(spark, d):
    t = corpus.normalized_code(F.col("func"))
    return fns(spark, d).select("fn_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


@query
def code_hashes(spark, d):
    return fns(spark, d).select("fn_id", corpus.code_hash(F.col("func")).alias("normalized_hash"), F.sha2("func", 256).alias("exact_hash"))


@query
def cwe_lists(spark, d):
    return fns(spark, d).select("fn_id", F.array_join(corpus.coerced_cwe(F.col("cwe")), "|").alias("cwes"))


@query
def cwe_frequency(spark, d):
    return fns(spark, d).select(F.explode(corpus.coerced_cwe(F.col("cwe"))).alias("cwe")).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


@query
def label_distribution(spark, d):
    return corpus.label_report(fns(spark, d))


@query
def bad_labels(spark, d):
    f = fns(spark, d).where(F.col("target").isNull() | ~F.col("target").isin(0, 1)).groupBy(F.coalesce(F.col("target").cast("string"), F.lit("null")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.col("n").desc(), "label").limit(5)


@query
def preprocess_counters(spark, d):
    return corpus.preprocess_counters(fns(spark, d))


@query
def kept_first(spark, d):
    return corpus.kept_first(fns(spark, d).where("split = 'train'")).select("fn_id")


@query
def length_percentiles(spark, d):
    return corpus.nearest_rank(fns(spark, d), F.length("func").cast("long"), "split", [0.5, 0.75, 0.9, 0.95, 0.99])


@query
def length_stats(spark, d):
    return fns(spark, d).groupBy("split").agg(F.min(F.length("func")).cast("long").alias("shortest"), F.max(F.length("func")).cast("long").alias("longest"), F.round(F.avg(F.length("func")), 6).alias("mean"))


@query
def token_report(spark, d):
    n = F.size(F.split(trimmed(F.coalesce("func", F.lit(""))), r"\s+")).cast("long")
    f = fns(spark, d).select("split", n.alias("n")).withColumn("c", corpus.expected_chunks(F.col("n")))
    return f.groupBy("split").agg(F.count(F.when(F.col("n") + 2 > 512, 1)).alias("over_limit"), F.count(F.when(F.col("c") > 8, 1)).alias("over_chunks"), F.sum(F.least("c", F.lit(8))).cast("long").alias("capped_chunks"), F.round(F.avg("n"), 6).alias("mean_tokens"))


@query
def split_audit(spark, d):
    return corpus.split_audit(fns(spark, d))


@query
def internal_duplicates(spark, d):
    return corpus.internal_duplicates(fns(spark, d))


@query
def leaking_rows(spark, d):
    return corpus.leaking_rows(fns(spark, d))


@query
def cleaned_train(spark, d):
    return corpus.cleaned_train(fns(spark, d)).select("fn_id", "target")


@query
def first_label_conflicts(spark, d):
    """Per pair of splits: normalised texts in both and those whose first labels differ."""
    f = fns(spark, d).where(F.length(trimmed("func")) > 0).select("split", "fn_id", "target", corpus.code_hash(F.col("func")).alias("h"))
    first = f.groupBy("split", "h").agg(F.min_by("target", "fn_id").alias("label"))
    a, b = first.select("h", F.col("split").alias("split_a"), F.col("label").alias("la")), first.select("h", F.col("split").alias("split_b"), F.col("label").alias("lb"))
    return a.join(b, "h").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"), F.count(F.when(~F.col("la").eqNullSafe(F.col("lb")), 1)).alias("conflicts"))


@query
def chunk_overlap(spark, d):
    return corpus.chunk_overlap(table(spark, d, "chunked_functions"))


@query
def chunk_statistics(spark, d):
    return corpus.chunk_statistics(table(spark, d, "chunked_functions"))


@query
def chunk_faults(spark, d):
    c = table(spark, d, "chunked_functions")
    n = F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0))
    return c.select("fn_id", "split", F.col("num_chunks").cast("long").alias("told"), n.cast("long").alias("counted"), F.exists("chunks", lambda x: F.size(x) == 0).alias("empty_chunk")).where((F.col("told") != F.col("counted")) | F.col("empty_chunk"))


@query
def chunk_windows(spark, d):
    t = corpus.bound(fns(spark, d).where(F.length(trimmed("func")) > 0).select("fn_id", F.split(trimmed("func"), r"\s+").alias("t")), "t")
    w = t.select("fn_id", F.posexplode(corpus.chunk_windows(F.col("t"), 64, 16, 8)).alias("chunk_no", "tokens"))
    return w.select("fn_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("tokens").cast("long").alias("tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query
def undersampled(spark, d):
    return sampling.undersampled(fns(spark, d).where("split = 'train'")).select("fn_id", "target")


@query
def folds(spark, d):
    return sampling.folds(fns(spark, d)).select("fn_id", F.col("fold").cast("long").alias("fold"))


@query
def confusion_matrix(spark, d):
    return rounded(metrics.confusion(preds(spark, d), F.col("score") >= 0.5, "split"))


@query
def threshold_sweep(spark, d):
    return rounded(metrics.sweep(preds(spark, d)))


@query
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(preds(spark, d)))


@query
def ranking_scores(spark, d):
    return rounded(metrics.ranking(preds(spark, d)))


@query
def brier(spark, d):
    return rounded(metrics.brier(preds(spark, d)))


@query
def reliability_bins(spark, d):
    return rounded(metrics.reliability(preds(spark, d)))


@query
def calibration_error(spark, d):
    return rounded(metrics.calibration_error(preds(spark, d)), 7)


@query
def score_separation(spark, d):
    y = F.col("target")
    g = preds(spark, d).groupBy("split").agg(F.avg(F.when(y == 1, F.col("score"))).alias("p"), F.avg(F.when(y == 0, F.col("score"))).alias("n"))
    return g.select("split", F.round("p", 9).alias("mean_positive"), F.round("n", 9).alias("mean_negative"), F.round(F.col("p") - F.col("n"), 9).alias("separation"))


@query
def focal_losses(spark, d):
    x = scalars.logit(F.col("score"))
    return preds(spark, d).groupBy("split").agg(F.round(F.avg(scalars.focal_loss(x, F.col("target").cast("double"), 2.0, 15.0)), 9).alias("focal"), F.round(F.avg(scalars.focal_loss(x, F.col("target").cast("double"), 0.0, 1.0)), 9).alias("bce"))


@query
def truncation_by_class(spark, d):
    c = table(spark, d, "chunked_functions").where(F.col("target").isin(0, 1))
    return c.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("truncated").cast("double")), 9).alias("rate"))


@query
def project_slices(spark, d):
    """Confusion at 0.5 for the twelve projects with most predictions."""
    key = fns(spark, d).select("fn_id", F.lower(trimmed("project")).alias("project")).where("project <> ''")
    j = preds(spark, d).join(key, "fn_id")
    top = j.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "project").limit(12)
    return rounded(metrics.confusion(j.join(F.broadcast(top.select("project")), "project"), F.col("score") >= 0.5, "project"))  # 12 rows


@query
def length_decile_slices(spark, d):
    """Confusion at 0.5 by deciles of text length (interpolated edges, left-closed, the last closed)."""
    j = preds(spark, d).where("split = 'test'").join(fns(spark, d).select("fn_id", F.length("func").alias("chars")), "fn_id").where("chars IS NOT NULL")
    edges = metrics.quantiles(j, "split", "chars", [i / 10 for i in range(1, 10)])
    b = j.join(F.broadcast(edges), "split").withColumn("decile", F.size(F.filter("edges", lambda x: x <= F.col("chars"))).cast("long"))  # one row
    return rounded(metrics.confusion(b, F.col("score") >= 0.5, "decile"))


@query
def language_names(spark, d):
    c = table(spark, d, "code_samples")
    return c.select(F.col("sample_id").cast("long").alias("sample_id"), detect.language_name(F.col("language")).alias("given"), detect.detected_language(F.coalesce("code", F.lit(""))).alias("detected"))


@query
def sample_findings(spark, d):
    c = table(spark, d, "code_samples")
    return detect.findings(c, "sample_id", "code", detect.language_name(F.col("language"))).select(F.col("sample_id").cast("long").alias("sample_id"), "type", "function", "severity", "cwe", F.col("line").cast("long").alias("line"))


@query
def function_findings(spark, d):
    return detect.findings(fns(spark, d), "fn_id", "func", "cpp").groupBy("type", "function", "severity", "cwe").agg(F.count(F.lit(1)).alias("n"))


@query
def unique_findings(spark, d):
    u = detect.unique_findings(detect.findings(fns(spark, d), "fn_id", "func", "cpp"), "fn_id")
    return u.select("fn_id", "type", "function", "cwe", F.col("line").cast("long").alias("line"), "severity", "confidence")


@query
def function_risk(spark, d):
    f = fns(spark, d)
    return detect.risk(f, detect.unique_findings(detect.findings(f, "fn_id", "func", "cpp"), "fn_id"), "fn_id")


@query
def rule_baseline(spark, d):
    """Confusion of the rule score above 0 by split."""
    f = fns(spark, d).where(F.col("target").isin(0, 1))
    r = detect.risk(f, detect.unique_findings(detect.findings(f, "fn_id", "func", "cpp"), "fn_id"), "fn_id")
    return rounded(metrics.confusion(f.select("fn_id", "split", "target").join(r, "fn_id"), F.col("rule_score") > 0, "split"))


@query
def identifiers(spark, d):
    c = table(spark, d, "code_samples")
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"\b[A-Za-z_$]\w*\b"), F.lit(0)))
    return c.select(F.col("sample_id").cast("long").alias("sample_id"), F.array_join(F.array_sort(ids), " ").alias("identifiers"))


@query
def def_use_links(spark, d):
    """Every use of a variable (a line that names it) with the last line before that assigns it, in the samples."""
    ln = table(spark, d, "code_samples").select(F.col("sample_id").cast("long").alias("sample_id"), F.posexplode(F.split(F.coalesce("code", F.lit("")), r"\r\n|[\n\r]")).alias("line", "text"))
    target = F.regexp_extract("text", r"([A-Za-z_]\w*)\s*=\s*[^=]", 1)
    ev = ln.select("sample_id", F.col("line").cast("long").alias("line"), target.alias("def"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("variable"))
    before = W.partitionBy("sample_id", "variable").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    at = F.last(F.when(F.col("def") == F.col("variable"), F.col("line")), ignorenulls=True).over(before)
    return ev.withColumn("def_line", at).where(F.col("def_line").isNotNull()).select("sample_id", "variable", "line", "def_line")


@query
def run_log_kinds(spark, d):
    r = table(spark, d, "run_log")
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("run_id").alias("runs"))


@query
def run_log_hours(spark, d):
    """Events an hour and kind, by a stream over the log that ends when all is read."""
    return logs.hourly_counts(spark, f"{d}/run_log.parquet")


def queries() -> dict:
    return dict(Q)
