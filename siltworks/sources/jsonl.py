"""JSON lines: reading with line numbers, broken lines dropped or refused, field detection, profile and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import SPACE, trimmed
from siltworks.operators.corpus import code_hash, normalized_code

#: Names of the code and label columns, by preference.
CODE_FIELDS = ["func", "code", "function", "source", "func_before"]
LABEL_FIELDS = ["target", "label", "vul", "is_vulnerable", "vulnerable"]
MODES = ("drop", "fail")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of text files with their number in the file, from 1.

    Files are read in splits side by side. A line's number is its place in its split after the lines of the splits before, which are counted first; no file is read by one task."""
    split = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    per = split.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    blocks = per.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "n", "first"))).alias("all"))  # one entry for each split of a file
    before = F.expr("aggregate(slice(all, 1, i), 0L, (s, x) -> s + x.n)")
    starts = blocks.select("file", F.posexplode("all").alias("i", "one"), "all").select("file", F.col("one.block").alias("block"), F.col("one.first").alias("first"), before.alias("before"))
    return split.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def is_object(line: Column) -> Column:
    """Whether a line is a JSON object; null and blank lines are none."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def records(lines: DataFrame, line: str = "line", mode: str = "drop") -> DataFrame:
    """The lines that hold a JSON object, with it as VARIANT in ``record``. Blank lines are skipped; other lines are dropped or, mode ``fail``, end the query with an error."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    some = lines.where(F.length(trimmed(F.col(line))) > 0)
    if mode == "drop":
        return some.where(is_object(F.col(line))).withColumn("record", F.try_parse_json(line))
    checked = F.when(is_object(F.col(line)), F.col(line)).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left(F.col(line), F.lit(80)))).cast("string"))
    return some.withColumn("record", F.try_parse_json(checked))


def read_jsonl(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """(file, line_no, line, record) of JSON-lines files. A path that does not exist raises."""
    return records(text_lines(spark, path), "line", mode)


def count_lines(spark: SparkSession, path: str) -> int:
    """The number of lines that are not blank; nothing is parsed."""
    return spark.read.text(path).where(F.length(trimmed(F.col("value"))) > 0).count()


def detect_field(line: Column, candidates: list[str]) -> Column:
    """The first of the candidates that a line's JSON object has as a field, else null."""
    keys = F.json_object_keys(line)
    return F.try_element_at(F.filter(F.array(*[F.lit(c) for c in candidates]), lambda c: F.array_contains(keys, c)), F.lit(1))


def field_text(line: Column, name: Column | None, candidates: list[str]) -> Column:
    """The value of the named one of the candidates as text: strings as they are, other values as JSON writes them."""
    out = F.lit(None).cast("string")
    for c in candidates:
        out = F.when(name == c, F.try_variant_get(F.try_parse_json(line), f"$.{c}", "string")).otherwise(out)
    return out


def label_of(line: Column, candidates: list[str] | None = None) -> Column:
    """The whole number that a label stands for: numbers cut to whole ones, true and false, texts of a whole number; null for anything else."""
    name = detect_field(line, candidates or LABEL_FIELDS)
    out = F.lit(None).cast("long")
    for c in candidates or LABEL_FIELDS:
        v = F.try_variant_get(F.try_parse_json(line), f"$.{c}", "variant")
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        whole = F.when(kind == "STRING", F.when(trimmed(text).rlike(r"^[+-]?[0-9]+$"), trimmed(text).try_cast("long")))
        value = F.when(kind == "BOOLEAN", (text == "true").cast("long")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").try_cast("long")).otherwise(whole)
        out = F.when(name == c, value).otherwise(out)
    return out


def field_presence(lines: DataFrame, line: str, by: str = "split") -> DataFrame:
    """(by, field, n, share): in how many of the JSON objects a field occurs."""
    ok = lines.where(is_object(F.col(line))).select(by, F.array_distinct(F.json_object_keys(line)).alias("keys"))
    total = ok.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    per = ok.select(by, F.explode("keys").alias("field")).groupBy(by, "field").agg(F.count(F.lit(1)).alias("n"))
    return per.join(total, by).select(by, "field", "n", (F.col("n") / F.col("total")).alias("share"))


def profile(lines: DataFrame, line: str, by: str = "split") -> DataFrame:
    """One row for each value of ``by``: lines that are not blank, objects, broken lines, labels 0 and 1, and the shortest, longest and mean length of the code."""
    text = F.col(line)
    some = lines.where(F.length(trimmed(text)) > 0).select(by, text.alias("l"))
    ok = is_object(F.col("l"))
    code = F.length(field_text(F.col("l"), detect_field(F.col("l"), CODE_FIELDS), CODE_FIELDS))
    some = some.select(by, ok.alias("ok"), F.when(ok, label_of(F.col("l"))).alias("label"), F.when(ok, code).alias("chars"))
    n = lambda c: F.count(F.when(c, 1))
    return some.groupBy(by).agg(
        F.count(F.lit(1)).alias("lines"), n(F.col("ok")).alias("objects"), n(~F.col("ok")).alias("broken"), n(F.col("label") == 0).alias("negatives"), n(F.col("label") == 1).alias("positives"),
        F.min("chars").alias("shortest"), F.max("chars").alias("longest"), F.avg("chars").alias("mean_chars"),
    )


def validate(lines: DataFrame, line: str, by: str = "split", severe: float = 20.0) -> DataFrame:
    """Counters of a validation: raw lines (not blank), parsed, broken, without code, with a label that is no whole number or not 0 or 1, of either label, repeated by normalised text, and whether negatives outnumber positives more than ``severe`` times.

    A record counts as empty first, then by its label, as cleaning would drop it; repeats are among the rows with code."""
    some = lines.where(F.length(trimmed(F.col(line))) > 0).select(by, F.col(line).alias("l"))
    ok = is_object(F.col("l"))
    code = normalized_code(field_text(F.col("l"), detect_field(F.col("l"), CODE_FIELDS), CODE_FIELDS))
    rows = some.select(by, ok.alias("ok"), F.when(ok, label_of(F.col("l"))).alias("label"), F.when(ok, code).alias("code"))
    rows = rows.select(by, "ok", "label", (F.col("ok") & (F.length("code") == 0)).alias("empty"), F.when(F.length("code") > 0, code_hash(F.col("code"))).alias("h"))
    per = rows.groupBy(by, "ok", "label", "empty", "h").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    full = F.col("ok") & ~F.col("empty")
    good = full & F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    out = per.groupBy(by).agg(
        F.sum("n").alias("raw_lines"), total(F.col("ok")).alias("parsed"), total(~F.col("ok")).alias("broken"), total(F.col("empty")).alias("empty"),
        total(full & ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad_labels"), total(good & (F.col("label") == 0)).alias("negatives"), total(good & (F.col("label") == 1)).alias("positives"),
        F.count_distinct("h").alias("texts"), total(F.col("h").isNotNull()).alias("with_text"),
    )
    return out.select(*[c for c in out.columns if c not in ("texts", "with_text")], (F.col("with_text") - F.col("texts")).alias("duplicates"), (F.col("negatives") > severe * F.col("positives")).alias("severe"))
