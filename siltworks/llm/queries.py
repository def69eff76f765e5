"""The queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import formats, leakage, mixing, near, overlap, pieces, quota, residue, split
from siltworks.plans.runtime import table

#: Production parameters of near-duplicate queries, as TESTDATA.md states them.
SHINGLE, SIMILARITY = 4, 0.6


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quota.target_report(table(spark, d, "code_functions"), table(spark, d, "cwe_targets")).where("short").select("target", "cwe")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return quota.target_report(table(spark, d, "code_functions"), table(spark, d, "cwe_targets"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "code_functions").select("fn_id", "target", "cwe", "project", "split")
    return quota.quota_sample(f, table(spark, d, "cwe_targets")).select("fn_id", "target", "sample_cwe")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.shared_split_pairs(table(spark, d, "code_functions"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return split.linked_split(table(spark, d, "code_functions"), table(spark, d, "split_plan"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "code_functions"), k=SHINGLE, t=SIMILARITY).select(F.col("id_a").alias("fn_id_a"), F.col("id_b").alias("fn_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(table(spark, d, "code_functions"), k=SHINGLE, t=SIMILARITY)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "code_functions")).where("piece_no = 0").select("fn_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "code_functions"))


def _records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"code_functions": formats.canonical_text(table(spark, d, "code_functions"), "fn_id", "func"), "raw_records": formats.canonical_records(table(spark, d, "raw_records"), "record_id", "raw_line")}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [formats.copy_pairs(r).select(F.lit(origin).alias("origin"), "keep_id", "copy_id") for origin, r in _records(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    parts = [formats.collapse_copies(r).select(F.lit(origin).alias("origin"), "keep_id", "copies") for origin, r in _records(spark, d).items()]
    return parts[0].unionByName(parts[1])


def _overlap(spark: SparkSession, d: str) -> overlap.Overlap:
    return overlap.Overlap(table(spark, d, "code_functions"), k=SHINGLE, t=SIMILARITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).all().select("kind", F.col("id_a").alias("fn_id_a"), F.col("id_b").alias("fn_id_b"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).report()


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d).coverage().withColumnRenamed("id", "fn_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    found = _leaks(spark, d).withColumn("verbatim", F.col("run") >= leakage.RUN)
    found = found.where(F.col("verbatim") | ((F.col("subsequence") >= leakage.PARAPHRASE) & (F.col("answer") >= leakage.ANSWER)))
    return found.groupBy("item_id").agg(F.sum(F.col("verbatim").cast("long")).alias("verbatim_documents"), F.sum((~F.col("verbatim")).cast("long")).alias("paraphrased_documents"), F.max("run").alias("longest_run"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets")).where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source").join(residue.residue(docs).select("doc_id"), "doc_id", "left_anti")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}
