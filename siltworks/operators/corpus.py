"""Profiling, validating, auditing, cleaning, sampling and chunking a corpus with splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import SPACE, trimmed
from siltworks.plans.runtime import materialize

#: SPACE without the line feed.
_WITHIN = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(df: DataFrame, column: str) -> DataFrame:
    """df whose column is computed once a row, however often it is used afterwards: a generator's output is not put in place of its name."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(column)).alias(column))


def normalized_code(c: Column) -> Column:
    """Line ends unified, white space at line ends removed, blank lines collapsed to one, the whole trimmed; null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, f"[{_WITHIN}]+(?=\n|$)", "")
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


def code_hash(c: Column) -> Column:
    """SHA-256 of the text with runs of white space as one blank."""
    return F.sha2(F.trim(F.regexp_replace(c, f"[{SPACE}]+", " ")), 256)


def coerced_cwe(c: Column) -> Column:
    """Trimmed entries without blank ones; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(c, trimmed), lambda x: x != ""), F.array().cast("array<string>"))


def kept_first(df: DataFrame, order: str = "fn_id") -> DataFrame:
    """The first row of each normalised text by order, one row even where order repeats, of rows with a text and a label of 0 or 1.

    Each task keeps one row a text before the shuffle, so a text that many rows have moves once a task."""
    text = F.length(normalized_code(F.col("func"))) > 0
    valid = df.where(text & F.col("target").isin(0, 1))
    first = valid.groupBy(code_hash(normalized_code(F.col("func"))).alias("h")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).alias("row"))
    return first.select("row.*")


def preprocess_counters(df: DataFrame) -> DataFrame:
    """Per split: rows read, dropped as empty, then for a bad label, then as a duplicate (train only), and kept."""
    t = normalized_code(F.col("func"))
    rows = df.select("split", (F.length(t) == 0).alias("empty"), (~F.coalesce(F.col("target").isin(0, 1), F.lit(False))).alias("bad"), code_hash(t).alias("h"))
    per = rows.groupBy("split", "empty", "bad", F.when(~F.col("empty") & ~F.col("bad"), F.col("h")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    ok = ~F.col("empty") & ~F.col("bad")
    out = per.groupBy("split").agg(
        F.sum("n").alias("rows_read"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("dropped_empty"),
        F.coalesce(F.sum(F.when(~F.col("empty") & F.col("bad"), F.col("n"))), F.lit(0)).alias("dropped_bad_label"),
        F.coalesce(F.sum(F.when(ok & (F.col("split") == "train"), F.col("n") - 1)), F.lit(0)).alias("dropped_duplicate"),
    )
    return out.withColumn("kept", F.col("rows_read") - F.col("dropped_empty") - F.col("dropped_bad_label") - F.col("dropped_duplicate"))


def label_report(df: DataFrame) -> DataFrame:
    """Per split: labels, negatives to positives, the capped positive weight and whether the imbalance is severe (over 20)."""
    g = df.groupBy("split").agg(F.count(F.when(F.col("target") == 1, 1)).alias("positives"), F.count(F.when(F.col("target") == 0, 1)).alias("negatives"))
    ratio = F.try_divide("negatives", "positives")
    return g.select(
        "*",
        F.when(F.col("positives") > 0, F.round(ratio, 9)).alias("ratio"),
        F.when(F.col("positives") > 0, F.round(F.least(ratio, F.lit(50.0)), 9)).otherwise(1.0).alias("pos_weight"),
        F.coalesce(F.when(F.col("positives") > 0, ratio > 20), F.lit(False)).alias("severe"),
    )


def nearest_rank(df: DataFrame, value: Column, by: str, shares: list[float]) -> DataFrame:
    """(by, share, value): the value at position round(share * (n - 1)) of the sorted values, rounding half to even.

    The values are counted first, so what is ordered are distinct values."""
    counts = df.select(by, value.alias("v")).where(F.col("v").isNotNull()).groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(by)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    at = ranked.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("k", F.bround((F.col("all") - 1) * F.col("share"), 0))
    return at.where(F.col("upto") > F.col("k")).groupBy(by, "share").agg(F.min("v").alias("value"))


DIMENSIONS = ("exact_code", "normalized_code", "hash", "idx", "big_vul_idx", "commit_id", "project")


def identity_keys(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(split, fn_id, target, dim, key) of the dimensions in which rows may be the same; null and empty keys are left out. Only the dimensions asked for are computed."""
    text = F.when(F.length(trimmed("func")) > 0, F.col("func"))
    keys = {"exact_code": F.sha2(text, 256), "normalized_code": code_hash(text)}
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), (keys[d] if d in keys else F.col(d).cast("string")).alias("key")) for d in dims])
    return df.select("split", "fn_id", "target", F.inline(pairs)).where(F.col("key") != "")


def split_audit(df: DataFrame) -> DataFrame:
    """Per dimension and pair of splits (train-valid, train-test, valid-test): shared keys, rows on either side and keys whose labels differ as sets."""
    per = identity_keys(df).groupBy("split", "dim", "key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("target")).alias("labels"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("train", 0), ("valid", 1), ("test", 2)) for x in kv]), F.col("split"))
    per = per.withColumn("r", rank)
    l, r = per.select("dim", "key", F.col("split").alias("left_split"), F.col("r").alias("lr"), F.col("n").alias("ln"), F.col("labels").alias("ll")), per.select("dim", "key", F.col("split").alias("right_split"), F.col("r").alias("rr"), F.col("n").alias("rn"), F.col("labels").alias("rl"))
    j = l.join(r, ["dim", "key"]).where("lr < rr")
    return j.groupBy("dim", "left_split", "right_split").agg(F.count(F.lit(1)).alias("shared_keys"), F.sum("ln").alias("left_rows"), F.sum("rn").alias("right_rows"), F.count(F.when(F.col("ll") != F.col("rl"), 1)).alias("label_conflicts"))


#: Pairs of splits that are audited.
PAIRS = [("train", "valid"), ("train", "test"), ("valid", "test")]


def audit_report(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS, examples: int = 5) -> DataFrame:
    """One row for every dimension and pair of splits, also where nothing is shared: whether both splits have keys of the dimension, and split_audit's figures with the first shared keys as examples."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(d, a, b) for d in dims for a, b in PAIRS], "dim string, left_split string, right_split string")
    per = materialize(identity_keys(df, dims).groupBy("split", "dim", "key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("target")).alias("labels")))
    there = per.select("split", "dim").distinct()
    l, r = (per.select("dim", "key", F.col("split").alias(f"{s}_split"), F.col("n").alias(f"{s}_n"), F.col("labels").alias(f"{s}_labels")) for s in ("left", "right"))
    both = l.join(r, ["dim", "key"]).join(F.broadcast(grid), ["dim", "left_split", "right_split"], "left_semi")  # 21 rows
    group = ["dim", "left_split", "right_split"]
    found = both.groupBy(*group).agg(F.count(F.lit(1)).alias("shared_keys"), F.sum("left_n").alias("left_rows"), F.sum("right_n").alias("right_rows"), F.count(F.when(F.col("left_labels") != F.col("right_labels"), 1)).alias("label_conflicts"))
    first = both.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("key"))).where(F.col("place") <= examples).groupBy(*group).agg(F.sort_array(F.collect_list("key")).alias("examples"))
    has = lambda s: there.select("dim", F.col("split").alias(f"{s}_split"), F.lit(True).alias(f"has_{s}"))
    out = grid.join(has("left"), ["dim", "left_split"], "left").join(has("right"), ["dim", "right_split"], "left").join(found, group, "left").join(first, group, "left")
    counts = ["shared_keys", "left_rows", "right_rows", "label_conflicts"]
    return out.select(*group, (F.coalesce("has_left", F.lit(False)) & F.coalesce("has_right", F.lit(False))).alias("available"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def internal_duplicates(df: DataFrame) -> DataFrame:
    """Per split and dimension: keys with more than one row, the redundant rows and the keys with more than one label."""
    per = identity_keys(df).groupBy("split", "dim", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("labels"))
    return per.groupBy("split", "dim").agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("redundant_rows"), F.count(F.when(F.col("labels") > 1, 1)).alias("conflicting_keys"))


LEAK_DIMENSIONS = ("exact_code", "normalized_code", "hash", "idx", "big_vul_idx")


def leaking_rows(df: DataFrame, dims: tuple[str, ...] = LEAK_DIMENSIONS) -> DataFrame:
    """(fn_id, dim) of the training rows that share a key of a dimension with a held-out row.

    Rows are hashed and shuffled once: the keys are written, and the held-out ones, each once, meet the training ones."""
    keys = materialize(identity_keys(df, dims).select("fn_id", "dim", "key", (F.col("split") == "train").alias("train")))
    held = keys.where("NOT train").select("dim", "key").distinct()
    return keys.where("train").join(held, ["dim", "key"], "left_semi").select("fn_id", "dim").distinct()


def cleaned_train(df: DataFrame) -> DataFrame:
    """The training rows that share no key with a held-out row."""
    return df.where(F.col("split") == "train").join(leaking_rows(df).select("fn_id").distinct(), "fn_id", "left_anti")


def _signatures(df: DataFrame) -> DataFrame:
    """(sig, split, labels, id): the chunk sequences of each split by digest, their labels and first id."""
    sig = F.sha2(F.to_json("chunks"), 256)
    return df.where(F.size("chunks") > 0).groupBy(sig.alias("sig"), "split").agg(F.sort_array(F.collect_set("target")).alias("labels"), F.min("fn_id").alias("id"))


def _shared_signatures(df: DataFrame) -> DataFrame:
    per = _signatures(df)
    a, b = per.select("sig", F.col("split").alias("split_a"), F.col("labels").alias("la"), F.col("id").alias("id_a")), per.select("sig", F.col("split").alias("split_b"), F.col("labels").alias("lb"), F.col("id").alias("id_b"))
    return a.join(b, "sig").where("split_a < split_b")


def chunk_overlap(df: DataFrame) -> DataFrame:
    """Per pair of splits: chunk sequences in both, and those whose labels in the two differ. Sequences are counted by digest and split before they meet."""
    return _shared_signatures(df).groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("signatures"), F.count(F.when(F.col("la") != F.col("lb"), 1)).alias("conflicting"))


def chunk_overlap_examples(df: DataFrame, most: int = 10) -> DataFrame:
    """(split_a, split_b, id_a, id_b): the first shared sequences of each pair of splits, by their first ids."""
    place = F.row_number().over(W.partitionBy("split_a", "split_b").orderBy("id_a", "id_b"))
    return _shared_signatures(df).withColumn("place", place).where(F.col("place") <= most).select("split_a", "split_b", "id_a", "id_b")


def chunked(df: DataFrame, length: int = 512, overlap: int = 128, most: int = 8) -> DataFrame:
    """df with ``chunks`` (framed windows of its text's words) and ``truncated``: whether words were left out. Texts without words have one empty window."""
    words = F.when(F.length(trimmed("func")) > 0, F.split(trimmed("func"), r"\s+")).otherwise(F.array().cast("array<string>"))
    x = bound(df.withColumn("__words", words), "__words")
    return x.select(*df.columns, chunk_windows(F.col("__words"), length, overlap, most).alias("chunks"), (expected_chunks(F.size("__words"), length, overlap) > most).alias("truncated"))


def chunk_statistics(df: DataFrame) -> DataFrame:
    """Per split: functions, chunks, mean and largest number of chunks, single- and multi-chunk functions, truncated ones and positives. Chunks are counted, not taken from num_chunks."""
    n = F.coalesce(F.greatest(F.size("chunks"), F.lit(0)), F.lit(0)).cast("long")
    return df.select("split", n.alias("n"), "truncated", "target").groupBy("split").agg(
        F.count(F.lit(1)).alias("functions"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 9).alias("mean_chunks"), F.max("n").alias("max_chunks"),
        F.count(F.when(F.col("n") == 1, 1)).alias("single"), F.count(F.when(F.col("n") > 1, 1)).alias("multi"), F.count(F.when(F.col("truncated"), 1)).alias("truncated"), F.count(F.when(F.col("target") == 1, 1)).alias("positives"),
    )


def expected_chunks(n: Column, length: int = 512, overlap: int = 128) -> Column:
    """Chunks that n tokens need."""
    body = length - 2
    step = body - min(overlap, body - 1)
    return F.when(n <= body, 1).otherwise(1 + F.ceil((n - body) / step)).cast("long")


def chunk_windows(tokens: Column, length: int = 512, overlap: int = 128, most: int = 8, bos: str | int = "<s>", eos: str | int = "</s>") -> Column:
    """The overlapping windows of a token array, each framed by a begin and an end mark; an empty array gives one empty window."""
    if length < 3:
        raise ValueError("a chunk needs room for one token")
    body = length - 2
    step = body - min(overlap, body - 1)
    k = F.least(F.lit(most), expected_chunks(F.size(tokens), length, overlap).cast("int"))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.array(F.lit(bos)), F.slice(tokens, i * step + 1, F.lit(body)), F.array(F.lit(eos))))


def token_chunks(tokens: DataFrame, key: str = "fn_id", length: int = 512, overlap: int = 128, most: int = 8, bos: int = 0, eos: int = 2) -> DataFrame:
    """(key, n, chunks, truncated) of token ids (key, tokens): their number, framed windows and whether tokens were left out."""
    framed = chunk_windows(F.col("tokens"), length, overlap, most, bos, eos)
    return tokens.select(key, F.size("tokens").alias("n"), framed.alias("chunks"), (expected_chunks(F.size("tokens"), length, overlap) > most).alias("truncated"))


def token_limits(sizes: DataFrame, by: str = "split", length: int = 512, overlap: int = 128, most: int = 8) -> DataFrame:
    """Per split, of (by, n): texts of more tokens than one chunk holds, texts of more chunks than are kept, chunks that are kept, and the mean number of tokens."""
    f = sizes.select(by, "n", expected_chunks(F.col("n"), length, overlap).alias("c"))
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy(by).agg(n(F.col("n") + 2 > length).alias("over_limit"), n(F.col("c") > most).alias("over_chunks"), F.sum(F.least("c", F.lit(most))).cast("long").alias("capped_chunks"), F.avg("n").alias("mean_tokens"))
