import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siltworks import queries, sql
from siltworks.functions import scalars, text
from siltworks.operators import corpus, detect, metrics, sampling, skew

SF = "/root/testdata/sf0.001"
FUNCTIONS = "fn_id long, split string, func string, target int, cwe array<string>, project string, commit_id string, cve string, idx string, big_vul_idx string, hash string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, key", [(" A　", "a"), ("\t", None), (None, None), ("Vel\x1c", "vel")])
def test_label_key(spark, given, key):
    assert one(spark, text.label_key, given) == key


@pytest.mark.parametrize("given, key", [("0" * 12, None), ("ABCDEF012345 ", "abcdef012345"), ("a" * 40, "a" * 40), ("a" * 41, None), ("HEAD", None), (None, None)])
def test_commit_key(spark, given, key):
    assert one(spark, text.commit_key, given) == key


@pytest.mark.parametrize("given, zero, key", [("0012", False, "12"), ("12.0", True, "12"), ("12.0", False, None), ("0", False, None), ("-1", True, None), (None, True, None), ("9" * 39, False, "9" * 39)])
def test_number_key(spark, given, zero, key):
    assert one(spark, lambda c: text.number_key(c, zero), given) == key


@pytest.mark.parametrize("given, key", [(["NVD-CWE-Other", "cwe_0125 x"], "CWE-125"), ([], "none"), (None, "none"), ([None, "CWE-79"], "CWE-79")])
def test_cwe_class(spark, given, key):
    assert one(spark, text.cwe_class, given, "array<string>") == key


def test_normalized_code(spark):
    assert one(spark, corpus.normalized_code, "a  \r\n\r\n\r\n\n b\t\r\n") == "a\n\n b"
    assert one(spark, corpus.normalized_code, None) == ""


@pytest.mark.parametrize("n, chunks, last", [(0, 1, 2), (50, 1, 52), (510, 1, 512), (511, 2, 131), (100_000, 8, 512)])
def test_chunk_windows(spark, n, chunks, last):
    df = spark.createDataFrame([(["t"] * n,)], "t array<string>").select(corpus.chunk_windows(F.col("t")).alias("w")).first().w
    assert len(df) == chunks and len(df[-1]) == last and all(w[0] == "<s>" and w[-1] == "</s>" for w in df)


def test_clamped_overlap(spark):
    w = spark.createDataFrame([(["t"] * 2000,)], "t array<string>").select(F.size(corpus.chunk_windows(F.col("t"), overlap=9999, most=100)).alias("n")).first().n
    assert w == 100
    with pytest.raises(ValueError):
        corpus.chunk_windows(F.col("t"), length=2)


def predictions(spark, p, y):
    return spark.createDataFrame([(i, "test", s, s, t) for i, (s, t) in enumerate(zip(p, y))], "fn_id long, split string, score double, raw_score double, target int")


def test_confusion_by_hand(spark):
    r = metrics.confusion(predictions(spark, [0.9, 0.8, 0.2, 0.1, 0.6, 0.4], [1, 0, 0, 0, 1, 1]), F.col("score") >= 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.f1 == pytest.approx(2 / 3) and r.accuracy == pytest.approx(4 / 6)


def test_one_class_has_no_auc(spark):
    r = metrics.ranking(predictions(spark, [0.2, 0.8], [0, 0])).first()
    assert math.isnan(r.roc_auc) and math.isnan(r.average_precision)


def test_sweep_is_the_confusion_at_each_threshold(spark):
    df = predictions(spark, [i / 200 for i in range(70)] + [0.41, 0.44, 0.62], [0] * 70 + [1] * 3)
    rows = metrics.sweep(df).collect()
    assert len(rows) == 91
    for r in rows[::9]:
        c = metrics.confusion(df, F.col("score") >= r.threshold).first()
        assert (r.tp, r.fp, r.fn, r.tn) == (c.tp, c.fp, c.fn, c.tn)
    best = {r.objective: r for r in metrics.best_threshold(df).collect()}
    assert best["f1"].value == 1 and best["f1"].threshold < 0.5


def test_focal_loss_without_focus_is_cross_entropy(spark):
    r = spark.range(1).select(scalars.focal_loss(F.lit(0.7), F.lit(1.0), 0.0, 1.0).alias("l")).first()
    assert r.l == pytest.approx(math.log(1 + math.exp(-0.7)))
    with pytest.raises(ValueError):
        scalars.focal_loss(F.lit(0.0), F.lit(1.0), -1.0, 1.0)


def with_overlaps(spark):
    """Five training rows of their own; one text that valid holds under another label, one that test holds with other blanks, one hash that test has too, one number that valid has too."""
    text = lambda i: f"total += rate[{i}];"
    rows = [(i, "train", text(i), i % 2, f"t{i}", None) for i in range(5)]
    rows += [(10, "train", text(70), 1, "u1", None), (11, "train", "while (k)  k--;", 0, "u2", None), (12, "train", text(71), 0, "both", None), (13, "train", text(72), 0, "u3", "88")]
    rows += [(20, "valid", text(70), 0, "v1", None), (21, "valid", text(73), 0, "v2", "88"), (22, "valid", text(74), 1, "v3", "")]
    rows += [(30, "test", "while (k)\n\tk--;", 0, "w1", None), (31, "test", text(75), 1, "both", None), (32, "test", None, 0, None, "")]
    return spark.createDataFrame([(i, s, f, t, None, None, None, None, None, n, h) for i, s, f, t, h, n in rows], FUNCTIONS)


def test_audit_and_cleaning(spark):
    df = with_overlaps(spark)
    a = {(r.dim, r.left_split, r.right_split): r for r in corpus.split_audit(df).collect()}
    assert {k: (r.shared_keys, r.label_conflicts) for k, r in a.items()} == {
        ("exact_code", "train", "valid"): (1, 1), ("normalized_code", "train", "valid"): (1, 1), ("normalized_code", "train", "test"): (1, 0), ("hash", "train", "test"): (1, 1), ("big_vul_idx", "train", "valid"): (1, 0),
    }
    assert {(r.fn_id, r.dim) for r in corpus.leaking_rows(df).collect()} == {(10, "exact_code"), (10, "normalized_code"), (11, "normalized_code"), (12, "hash"), (13, "big_vul_idx")}
    assert {r.fn_id for r in corpus.cleaned_train(df).collect()} == {0, 1, 2, 3, 4}


def test_first_rows_are_one_a_text_even_where_ids_repeat(spark):
    rows = [(1, "train", "a  b", 1), (1, "train", "a b", 1), (1, "train", "c", 0), (2, "train", "a b", 0), (3, "train", " ", 1), (4, "train", "d", 7)]
    df = spark.createDataFrame([(i, s, f, t, None, None, None, None, None, None, None) for i, s, f, t in rows], FUNCTIONS)
    assert sorted(r.fn_id for r in corpus.kept_first(df).collect()) == [1, 1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], FUNCTIONS)
    for out in (corpus.split_audit(df), corpus.internal_duplicates(df), corpus.cleaned_train(df), corpus.label_report(df), corpus.preprocess_counters(df), sampling.undersampled(df), sampling.folds(df)):
        assert out.collect() == []
    assert skew.project_profile(df).collect() == []
    p = predictions(spark, [], [])
    for out in (metrics.sweep(p), metrics.ranking(p), metrics.brier(p), metrics.reliability(p)):
        assert out.collect() == []


@pytest.mark.parametrize("language, code, wanted", [
    ("python", "n = 1\neval(n + 1)", {("eval", "CWE-95", 2)}),
    ("python", 'q = "SELECT a FROM bins WHERE b = " + wanted', {("SQL_QUERY", "CWE-89", 1)}),
    ("python", 'run(\n"SELECT a FROM bins WHERE b = ?",\n(wanted,),\n)', set()),
    ("cpp", "gets(b);\nprintf(b);\nscanf(\"%s\", b);", {("gets", "CWE-242", 1), ("printf", "CWE-134", 2), ("scanf", "CWE-120", 3)}),
    ("cobol", "gets(b)", set()),
    (None, "gets(b)", {("gets", "CWE-242", 1)}),
    ("cpp", None, set()),
])
def test_detectors(spark, language, code, wanted):
    df = spark.createDataFrame([(1, language, code)], "k int, language string, code string")
    got = {(r.function, r.cwe, r.line) for r in detect.findings(df, "k", "code", F.col("language")).collect()}
    assert got == wanted


def test_risk_of_an_item_without_findings(spark):
    df = spark.createDataFrame([(1, "x"), (2, "gets(a); strcpy(a, b);")], "k int, code string")
    r = {x.k: x for x in detect.risk(df, detect.unique_findings(detect.findings(df, "k", "code", "cpp"), "k"), "k").collect()}
    assert (r[1].security_score, r[1].risk_level) == (100, "LOW") and (r[2].security_score, r[2].risk_level, r[2].rule_score) == (55, "HIGH", 1.0)


def test_eager_states_equal_the_join(spark):
    l = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 9)], "k string, x long")
    r = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("c", 1)], "k string, y long")
    s = skew.eager_join_states(skew.key_states(l, F.col("k"), {"x": F.col("x")}), skew.key_states(r, F.col("k"), {"y": F.col("y")}))
    got = {x.key: x for x in s.collect()}
    joined = l.join(r, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    assert (got["a"].pairs, got["a"].joined_left_x, got["a"].joined_right_y) == (joined.n, joined.x, joined.y)
    assert got["b"].pairs == 0 and set(got) == {"a", "b"}


def test_profile_of_dirty_projects(spark):
    rows = [(i, "train", "x", 1 if i % 2 else 0, None, p, None, None, None, None, None) for i, p in enumerate([" Hot"] * 30 + ["hot\t"] * 3 + [None, " ", "cold"])]
    df = spark.createDataFrame(rows, FUNCTIONS).withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.project: r for r in skew.project_profile(df).collect()}
    assert set(got) == {"hot", "cold"} and got["hot"].rows == 33 and got["hot"].total == 36
    assert [r.project for r in skew.hot_projects(df).collect()] == ["hot"]


def test_salted_join_keeps_every_row(spark):
    l = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "i int, k string")
    r = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert skew.salted_join(l, r, "k").count() == 300


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for name, statement in sql.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.execute(statement).fetchall()
        assert sorted(got.columns) == sorted(x[0] for x in con.description), name
        assert got.count() == len(want), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
