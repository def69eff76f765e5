"""Sources, sinks, samplers, taint, graphs, evaluation and pooling."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import scalars
from siltworks.operators import analyzer, corpus, cparse, detect, evaluation, graphs, metrics, pooling, sampling, taint
from siltworks.sinks import writers
from siltworks.sources import files, jsonl
from siltworks.streaming import logs

PREDICTIONS = "fn_id long, split string, score double, raw_score double, target int"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def scores(spark, pairs, split="valid"):
    return spark.createDataFrame([(i, split, float(s), float(s), y) for i, (s, y) in enumerate(pairs)], PREDICTIONS)


# ---- sources


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = {}
    for name in ("a", "b"):
        rows = ["x" * rng.randrange(60) if rng.random() > 0.2 else "" for _ in range(700)]
        texts[name] = rows
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        got = jsonl.text_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        found = {(r.file[-7:-6], r.line_no): r.line for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {(n, i + 1): t for n, rows in texts.items() for i, t in enumerate(rows)}


def test_broken_lines_are_dropped_or_refused(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"func": "a", "target": 1}\n\n{broken\n[1]\n  \n{"code": "b", "label": "0", "x": null}\n')
    got = jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl")).select("line_no", jsonl.detect_field(F.col("line"), jsonl.CODE_FIELDS).alias("f"), jsonl.label_of(F.col("line")).alias("y")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "func", 1), (6, "code", 0)]
    assert jsonl.count_lines(spark, str(tmp_path / "r.jsonl")) == 4
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl"), "fail").select("record").collect()
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl"), "skip")
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl")).collect()


@pytest.mark.parametrize("value, label", [("1", 1), ('"1"', 1), ("true", 1), ("false", 0), ("1.7", 1), ('"1.7"', None), ("null", None), ('"x"', None), ("[1]", None), ('" 0 "', 0)])
def test_labels_of_all_kinds(spark, value, label):
    assert one(spark, jsonl.label_of(F.lit('{"target": %s}' % value))) == label


def test_validation_counts(spark):
    rows = [("t", x) for x in ['{"func": "int a;", "target": 1}', '{"func": "int  a;", "target": 0}', '{"func": " ", "target": 1}', '{"func": "b", "target": "x"}', "{", "", None, '{"target": 0}']]
    r = jsonl.validate(spark.createDataFrame(rows, "split string, line string"), "line").first()
    assert (r.raw_lines, r.parsed, r.broken, r.empty, r.bad_labels, r.negatives, r.positives, r.duplicates) == (6, 5, 1, 2, 1, 1, 1, 1)
    assert jsonl.validate(spark.createDataFrame([], "split string, line string"), "line").collect() == []


@pytest.mark.parametrize("path, name", [("a/b.c", "b.c"), ("a\\b\\c.py", "c.py"), ("x/", "uploaded"), ("", "uploaded"), (None, "uploaded"), (" q.js ", "q.js")])
def test_base_names(spark, path, name):
    assert one(spark, files.base_name(F.lit(path).cast("string"))) == name


def test_files_that_are_refused(spark, tmp_path):
    (tmp_path / "good.c").write_text("int a;")
    (tmp_path / "blank.py").write_text(" \n")
    (tmp_path / "odd.js").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "what.txt").write_text("x")
    (tmp_path / "big.java").write_text("x" * (files.MOST_CHARS + 1))
    got = {r.name: (r.language, r.refused) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"good.c": ("c", None), "blank.py": ("python", "blank"), "odd.js": ("javascript", "encoding"), "what.txt": (None, "extension"), "big.java": ("java", "too large")}
    asked = spark.createDataFrame([("int a;", "C++"), ("", "c"), ("x", "cobol"), (None, None), ("  ", "py"), ("x", None)], "code string, language string")
    assert [(r.asked, r.refused) for r in files.checked_requests(asked).collect()] == [("cpp", None), ("cpp", "empty"), (None, "language"), (None, "empty"), ("python", "blank"), (None, None)]


def test_probe_lines(spark):
    r = one(spark, files.probe_values(F.lit("61, 98, n/a, 4096, 35.5, 1500, 0x24")))
    assert (r.temp_c, r.mem_used_mib, r.power_w, r.throttle) == (61.0, None, 35.5, "0x24")
    assert one(spark, files.throttle_reasons(F.lit("0x24"))) == ["SwPowerCap", "SwThermalSlowdown"] and one(spark, files.throttle_reasons(F.lit("none"))) == []
    assert files.environment(spark).first().spark == spark.version


# ---- sinks


def test_written_lines_are_counted_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n"), (2, None)], "a int, b string")
    path = str(tmp_path / "deep" / "out")
    assert writers.write_jsonl(df, path) == 2 and writers.write_jsonl(df.where("a > 5"), str(tmp_path / "none")) == 0
    assert sorted(tuple(r) for r in spark.read.json(path).collect()) == [(1, "é\n"), (2, None)]
    writers.pass_through(spark, path, str(tmp_path / "copy"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 2
    with pytest.raises(FileExistsError):
        writers.pass_through(spark, path, str(tmp_path / "copy"))
    for target in (path, path + "/", path + "/x"):
        with pytest.raises(ValueError):
            writers.refuse_same(spark, path, target)


def test_reports_have_no_numbers_that_are_none(spark, tmp_path):
    path = str(tmp_path / "r.json")
    writers.write_report(path, rows=spark.createDataFrame([(float("nan"), 1.5)], "a double, b double"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": [{"a": None, "b": 1.5}]}
    assert files.read_report(spark, path).first()["rows"][0].b == 1.5
    writers.write_text(spark, path, "new")
    assert writers.read_text(spark, path) == "new"


def test_a_ledger_tells_repeats(spark, tmp_path):
    told = [writers.record_evaluation(spark, str(tmp_path / "l"), d, {"f1": 0.1}) for d in ("a", "a", None, "b")]
    assert [(t["number"], t["other_checkpoints"]) for t in told] == [(1, 0), (2, 0), (3, 1), (4, 1)]
    (tmp_path / "l" / "broken.json").write_text("{")
    assert writers.ledger(spark, str(tmp_path / "l")).count() == 4


def test_a_run_that_fails_is_recorded(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), writers.RunRecorder(spark, "run", str(tmp_path), {"seed": 1}) as run:
        run.metrics("valid", {"f1": 0.5, "rows": [1, 2], "name": "x"})
        run.event("step", loss=float("inf"))
        1 / 0
    folder = next(tmp_path.iterdir())
    kinds = sorted(json.loads(p.read_text())["kind"] for p in (folder / "events").iterdir() if p.suffix == ".json")
    assert kinds == ["failed", "start", "step"] and json.loads((folder / "metrics_valid.json").read_text()) == {"f1": 0.5, "name": "x"}
    stream = writers.telemetry(logs.json_events(spark, f"file://{folder}/events"), str(tmp_path / "sink"), str(tmp_path / "state"))
    stream.awaitTermination()
    assert sorted(r.kind for r in spark.read.json(str(tmp_path / "sink")).collect()) == kinds


def test_a_model_is_saved_whole(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(1)
    rows = [(i, [float(x), float(-x)], int(x > 0)) for i, x in enumerate(rng.standard_normal(60))]
    df = spark.createDataFrame(rows, "fn_id long, vector array<double>, target int")
    model = pooling.classifier(df)
    for step in (1, 2):
        writers.save_model(spark, str(tmp_path / "m"), model, {"step": step})
    loaded = writers.load_model(spark, str(tmp_path / "m"), LogisticRegressionModel)
    assert loaded["state"] == {"step": 2} and writers.load_model(spark, str(tmp_path / "m"), None, ("state",)) == {"state": {"step": 2}}
    p = pooling.predicted(df, loaded["model"]).collect()
    assert sum((r.score > 0.5) == (r.target == 1) for r in p) >= 57 and all(r.score == pytest.approx(1 / (1 + math.exp(min(700, -r.logit)))) for r in p)
    with pytest.raises(FileNotFoundError):
        writers.load_model(spark, str(tmp_path / "x"), LogisticRegressionModel)


def test_an_empty_log_has_no_hours(spark, tmp_path):
    spark.createDataFrame([], "log_id long, kind string, ts timestamp").write.parquet(str(tmp_path / "log"))
    assert logs.hourly_counts(spark, str(tmp_path / "log")).collect() == []
    spark.sql("SELECT 1L AS log_id, 'a' AS kind, TIMESTAMP '2024-01-01 00:10:00' AS ts UNION ALL SELECT 1L, 'a', TIMESTAMP '2024-01-01 00:20:00' UNION ALL SELECT 2L, 'a', TIMESTAMP '2024-01-01 05:00:00'").write.mode("append").parquet(str(tmp_path / "log"))
    assert sorted(r.events for r in logs.hourly_counts(spark, str(tmp_path / "log"), late="1 day").collect()) == [1, 1]


# ---- scalars and samples


def test_isotonic_is_a_line_between_knots(spark):
    xs, ys = [0.1, 0.4, 0.4001, 0.9], [0.0, 0.2, 0.5, 1.0]
    ps = [0.0, 0.1, 0.2, 0.4, 0.40005, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert [r.y for r in df.select(scalars.isotonic(F.col("p"), xs, ys).alias("y")).collect()] == pytest.approx(list(np.interp(ps, xs, ys)))
    with pytest.raises(ValueError):
        scalars.isotonic(F.lit(0.1), [], [])


def test_scalar_functions(spark):
    assert one(spark, scalars.sigmoid(F.lit(-800.0))) == 0.0 and one(spark, scalars.sigmoid(F.lit(800.0))) == 1.0
    assert one(spark, scalars.blend(F.lit(0.95), F.lit(1))) == 1.0
    assert one(spark, scalars.loss("focal", F.lit(0.3), F.lit(0.0), gamma=0.0)) == pytest.approx(one(spark, scalars.loss("bce", F.lit(0.3), F.lit(0.0))))
    for bad in (lambda: scalars.loss("x", F.lit(0.0), F.lit(0.0)), lambda: scalars.learning_rate("x", F.lit(0), 1, 0.1)):
        with pytest.raises(ValueError):
            bad()
    assert one(spark, scalars.preview(F.lit("a" * 301))) == "a" * 300 + " ..." and one(spark, scalars.preview(F.lit("a" * 300))) == "a" * 300
    got = one(spark, scalars.scalar_fields(F.lit('{"a": 1, "b": "x", "c": [1], "d": {"e": 1}, "f": null}')))
    assert set(got) == {"a", "b", "f"} and got["b"] == "x"
    assert one(spark, scalars.coerced_list(F.parse_json(F.lit('[" CWE-1 ", "", "x"]')))) == ["CWE-1", "x"]
    assert one(spark, scalars.coerced_list(F.parse_json(F.lit('"CWE-2"')))) == ["CWE-2"] and one(spark, scalars.coerced_list(F.parse_json(F.lit("null")))) == []


def sampled(spark, p, n):
    return spark.createDataFrame([(i, int(i < p)) for i in range(p + n)] + [(9000, None), (9001, 7)], "fn_id long, target int")


def test_ranks_are_places_in_the_whole_order(spark):
    df = spark.createDataFrame([(i % 400, i % 3) for i in range(900)], "fn_id long, target int")
    got = sampling.with_rank(df, ["target"], sampling.random_order(5)).collect()
    for t in range(3):
        mine = sorted(r.rank for r in got if r.target == t)
        assert mine == list(range(1, 301))
        order = [r.fn_id for r in sorted((r for r in got if r.target == t), key=lambda r: r["rank"])]
        digests = one(spark, F.transform(F.array(*[F.lit(x) for x in order]), lambda x: F.md5(F.concat(F.lit("5:"), x.cast("string")))))
        assert digests == sorted(digests)


@pytest.mark.parametrize("p, n, limit", [(20, 180, 50), (3, 400, 20), (50, 5, 40), (0, 30, 10), (30, 0, 10), (2, 2, 100)])
def test_samplers(spark, p, n, limit):
    df = sampled(spark, p, n)
    kept = lambda x: (x.where("target = 1").count(), x.where("target = 0").count())
    a, b = kept(sampling.stratified_subset(df, limit))
    assert a + b == min(limit, p + n) and (a > 0 or not p)
    a, b = kept(sampling.balanced_subset(df, limit))
    assert a == min(limit // 2, p) and b == min(n, limit - a)
    assert kept(sampling.undersampled(df, 2.5)) == (p, min(n, int(p * 2.5))) and kept(sampling.undersampled(df, 2.5, half_even=True)) == (p, min(n, round(p * 2.5)))
    r = sampling.undersampling_report(df, 2.5).first()
    assert r.kept_total == p + min(n, round(p * 2.5))
    a, b = kept(sampling.stratified_limit(df, limit))
    assert (a, b) == ((p, n) if limit >= p + n else (min(p, max(1, round(p * limit / (p + n)))), min(n, limit - max(1, round(p * limit / (p + n))))))


def test_permutations_go_on_where_they_ended(spark):
    df = spark.range(500).withColumnRenamed("id", "fn_id")
    first = {r.place: r.fn_id for r in sampling.permutation(df, 1, 0).collect()}
    rest = {r.place: r.fn_id for r in sampling.permutation(df, 1, 0, skip=120).collect()}
    other = {r.place: r.fn_id for r in sampling.permutation(df, 1, 1).collect()}
    assert sorted(first) == list(range(500)) and rest == {k: v for k, v in first.items() if k >= 120} and other != first


def test_early_stop_needs_more_than_the_least_gain(spark):
    rows = [("a", e, s) for e, s in enumerate([0.1, 0.2, 0.205, 0.204, 0.9])] + [("b", 0, 0.5), ("b", 1, 0.7), ("c", 0, None)]
    got = {r.run: tuple(r)[1:] for r in sampling.early_stop(spark.createDataFrame(rows, "run string, epoch int, s double"), "run", "epoch", "s", 2, 0.01).collect()}
    assert got == {"a": (1, 0.2, 3), "b": (1, 0.7, None)}


def test_trials_stay_in_their_space(spark):
    space = sampling.search_space(optimisation=True, pinned={"dropout": 0.2})
    got = sampling.trials(spark.range(300).withColumnRenamed("id", "trial"), space).collect()
    assert all(1e-6 <= r.learning_rate <= 5e-5 and 0 <= r.weight_decay <= 0.1 and r.dropout == 0.2 and r.loss in ("bce", "focal") for r in got)
    assert len({r.batch_size for r in got}) == 3
    with pytest.raises(ValueError):
        sampling.trials(spark.range(1), {"x": ("normal", (0, 1))}, trial="id")
    best = sampling.best_trial(spark.createDataFrame([(1, 0.3), (2, float("nan")), (3, 0.5), (4, None)], "trial long, score double")).orderBy("place").collect()
    assert [r.trial for r in best] == [3, 1, 2, 4]


# ---- taint


@pytest.mark.parametrize("language, code, wanted", [
    ("cpp", "char row[9];\nfgets(row, 9, f);\nsystem(row);", [(3, "system", "row")]),
    ("cpp", "gets(row);\nother = row;\nrow = 0;\nstrcpy(x, other);\nstrcpy(x, row);", [(4, "strcpy", "other"), (5, "strcpy", "row")]),
    ("cpp", "gets(a);\nvalidate(a);\nsystem(a);\ngets(a);\nsystem(a);", [(5, "system", "a")]),
    ("python", "one = input()\ntwo = escape(one)\nos.system(two)\neval(one)", []),
    ("python", "b = input(); a = b\nexec(b + a)", [(2, "exec", "b")]),
    ("python", "a = input()\nb = input()\nexec(b, a)", [(3, "exec", "a")]),
    ("javascript", "let got = req.body.x;\nlet f = got == 1;\nFunction(f);", [(3, "Function", "f")]),
    ("java", "void m(String[] args) {\nRuntime.getRuntime().exec(args[0]);", [(2, "Runtime.getRuntime().exec", "args")]),
    (None, "const q = prompt('x');\neval(q);", [(2, "eval", "q")]),
    (None, "import os\nname = input()\nos.system(name)", [(3, "os.system", "name")]),
    ("cpp", "system(free);", []),
    ("cpp", None, []),
    ("cpp", "", []),
])
def test_taint_flows(spark, language, code, wanted):
    df = spark.createDataFrame([(1, language, code)], "k long, language string, code string")
    got = sorted((r.line, r.sink, r.source_variable) for r in taint.flows(df, "k", "code", F.col("language")).collect())
    assert got == wanted


def fold_by_hand(code, language):
    """The flow's rules in plain Python over the same patterns, for random programs."""
    import re

    tainted, clean, out = set(), set(), []
    for no, line in enumerate(code.split("\n"), 1):
        for p in taint.SOURCES[language]:
            if m := re.search(p, line):
                tainted.add(m[1])
                clean.discard(m[1])
        if m := re.search(taint.ASSIGNMENT.get(language, taint.ASSIGNMENT["cpp"]), line):
            if set(re.findall(taint.IDENTIFIER, m[2])) & (tainted - clean):
                tainted.add(m[1])
                clean.discard(m[1])
        for s in taint.SANITIZERS:
            if (m := re.search(rf"\b{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)", line)) and m[1] in tainted:
                clean.add(m[1])
            if (m := re.search(rf"([A-Za-z_$]\w*)\s*=\s*{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)", line)) and m[2] in tainted:
                clean.add(m[1])
                tainted.discard(m[1])
        for s, _, _ in taint.SINKS[language]:
            if m := re.search(taint._sink_pattern(s), line):
                if hit := set(re.findall(taint.IDENTIFIER, m[1])) & (tainted - clean):
                    out.append((no, s, min(hit)))
    return out


def test_taint_of_random_programs(spark):
    rng = random.Random(11)
    v = lambda: rng.choice("abcde")
    make = [lambda: f"gets({v()});", lambda: f"{v()} = {v()} + {v()};", lambda: f"{v()} = escape({v()});", lambda: f"validate({v()});", lambda: f"strcpy({v()}, {v()});", lambda: f"system({v()});", lambda: "", lambda: f"if ({v()} == {v()}) x();"]
    programs = ["\n".join(rng.choice(make)() for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(programs)), "k long, code string")
    got = {}
    for r in taint.flows(df, "k", "code", "cpp").collect():
        got.setdefault(r.k, []).append((r.line, r.sink, r.source_variable))
    want = {k: sorted(f) for k, p in enumerate(programs) if (f := fold_by_hand(p, "cpp"))}
    assert {k: sorted(x) for k, x in got.items()} == want and want


def test_taint_closure_ignores_the_order_of_lines(spark):
    code = "c = b;\nb = a;\ngets(a);\nd = safe;\ne = f;\ngets(f);\nescape(f);"
    got = taint.taint_closure(spark.createDataFrame([(1, code), (2, "x = 1;")], "k long, code string"), "k", "code").collect()
    assert [(r.k, r.tainted) for r in got] == [(1, ["a", "b", "c", "f"])]


def test_scorers(spark):
    rows = [(1, "train", "gets(row);\nsystem(row);", 1), (2, "train", "int a;", 0), (3, "train", None, 0), (4, "train", "x", 5)]
    df = spark.createDataFrame(rows, "fn_id long, split string, func string, target int")
    got = {r.fn_id: r for r in analyzer.scores(df).collect()}
    assert (got[1].rules_only, got[1].taint_only, got[1].rules_taint) == (1.0, 1.0, 1.0) and (got[2].rules_only, got[3].taint_only) == (0.0, 0.0)
    b = {r.scorer: r for r in analyzer.baselines(df).collect()}
    assert set(b) == set(analyzer.SCORERS) and all((r.tp, r.tn) == (1, 2) for r in b.values())
    u = analyzer.unique_findings(df, "fn_id", "func").where("type = 'TAINT_FLOW'").first()
    assert u.confidence == 0.9
    assert detect.severity_summary(analyzer.all_findings(df, "fn_id", "func"), "fn_id").first().total == 3


# ---- graphs


def flow_of(code):
    nodes, _ = cparse.parse(code)
    f = cparse.control_flow(nodes)
    return {(f.nodes[a][0], f.nodes[b][0], k) for a, b, k in f.edges}


def test_branches_and_loops():
    assert flow_of("int f(int a) { if (a) return 1; else a = 2; return a; }") == {
        ("FUNCTION_ENTRY", "IF_CONDITION", "CFG"), ("IF_CONDITION", "return_statement", "CFG_TRUE"), ("return_statement", "FUNCTION_EXIT", "CFG_RETURN"),
        ("IF_CONDITION", "expression_statement", "CFG_FALSE"), ("expression_statement", "IF_MERGE", "CFG"), ("IF_MERGE", "return_statement", "CFG"),
    }
    assert flow_of("void f() { while (x) { y(); continue; } z(); }") == {
        ("FUNCTION_ENTRY", "WHILE_CONDITION", "CFG"), ("WHILE_CONDITION", "expression_statement", "CFG_TRUE"), ("expression_statement", "CONTINUE", "CFG"), ("CONTINUE", "WHILE_CONDITION", "CFG_CONTINUE"),
        ("WHILE_CONDITION", "WHILE_EXIT", "CFG_FALSE"), ("WHILE_EXIT", "expression_statement", "CFG"), ("expression_statement", "FUNCTION_EXIT", "CFG"),
    }
    assert ("FOR_UPDATE", "FOR_CONDITION", "CFG_LOOP_BACK") in flow_of("void f() { for (i = 0; i < 3; i++) { g(); } }")
    assert ("BREAK", "FOR_EXIT", "CFG_BREAK") in flow_of("void f() { for (;;) { if (g()) break; } }")
    assert flow_of("void f() { return; g(); }") == {("FUNCTION_ENTRY", "return_statement", "CFG"), ("return_statement", "FUNCTION_EXIT", "CFG_RETURN")}
    assert flow_of("void f() { if (a) { } }") == {("FUNCTION_ENTRY", "IF_CONDITION", "CFG"), ("IF_CONDITION", "IF_MERGE", "CFG_TRUE"), ("IF_CONDITION", "IF_MERGE", "CFG_FALSE"), ("IF_MERGE", "FUNCTION_EXIT", "CFG")}


def test_declarations_define_their_name():
    events = lambda code: [(k, code[n.start : n.end]) for k, n in cparse.variable_events(cparse.parse(code)[0][0][0])]
    assert events("int f() { int y = x + z; y = y * 2; y++; return y; }") == [("USE", "x"), ("USE", "z"), ("DEF", "y"), ("USE", "y"), ("DEF", "y"), ("USE", "y"), ("DEF", "y"), ("USE", "y")]
    assert events("void f() { char *p = q; a[i] = p; int u, v = 1; }") == [("USE", "q"), ("DEF", "p"), ("USE", "p"), ("DEF", "u")]


@pytest.mark.parametrize("code", ["", "}", "{{{{", "if (", "int f(", "a ? b", "((((((", "x = = y;", "#define A \\\n b\nint a;", "\x00�", '"open', "'", "/* open", "for (;;", "do x; while", "f(" * 5000, "{" * 5000, "else else;", "case 1: default:", "int a[3] = {1, {2}};"])
def test_any_text_is_parsed_to_a_tree(code):
    nodes, _ = cparse.parse(code)
    assert [n.id for n, _ in nodes] == list(range(len(nodes))) and all(p < n.id for n, p in nodes)
    by = {n.id: n for n, _ in nodes}
    assert all(0 <= n.start <= n.end <= len(code) for n, _ in nodes)
    assert all(by[p].start <= n.start and n.end <= by[p].end for n, p in nodes if p >= 0)
    cparse.graph_rows(code)


def test_graph_tables(spark):
    code = "int g(int n) {\n  int s = n;\n  while (s > 0) { s--; }\n  strcpy(a, b);\n  return s;\n}"
    g = graphs.Graphs(spark.createDataFrame([(1, code), (2, None), (3, " "), (4, "x = y")], "k long, code string"), "k", "code")
    assert {(r.key, r.variable, r.source, r.target) for r in g.def_use().collect()} == {(1, "s", 1, 2), (1, "s", 3, 4)}
    c = {r.key: r for r in g.counts().collect()}
    assert set(c) == {1, 4} and c[1].dfg_edges == 2 and c[1].ast_edges == c[1].ast_nodes - 1 and c[1].ast_cfg_edges == 6 and c[1].ast_dfg_edges == c[1].dfg_nodes
    assert c[1].total_nodes == c[1].ast_nodes + c[1].cfg_nodes + c[1].dfg_nodes and g.edges().where("key = 1").count() == c[1].total_edges
    assert g.nodes().where("key = 1").select("id").distinct().count() == c[1].total_nodes
    s = {r.key: r for r in g.summary().collect()}
    assert (s[1].functions, s[1].line_count, s[1].has_syntax_error) == (["g"], 6, False) and s[4].has_syntax_error
    found = spark.createDataFrame([(1, "RULE_BASED", "strcpy", 4), (1, "SQL_INJECTION", "SQL_QUERY", 5)], "key long, type string, function string, line int")
    links = {(r.type, r.node_type, r.text) for r in g.links(found).collect()}
    assert ("RULE_BASED", "call_expression", "strcpy(a, b)") in links and all(t in graphs.PREFERRED for _, t, _ in links)


def test_the_smallest_node_that_contains(spark):
    rng = random.Random(2)
    span = lambda: sorted(rng.sample(range(40), 2))
    inner, outer = [(1, i, *span()) for i in range(30)] + [(1, 99, None, None)], [(1, i, *span()) for i in range(40)] + [(2, 0, 0, 50)]
    schema = "key long, id long, start long, end long"
    got = {r.target: r.source for r in graphs.contained(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema)).collect()}
    want = {}
    for _, i, a, b in inner[:-1]:
        fit = [(((c, d) != (a, b)), d - c if (c, d) != (a, b) else 0, j) for _, j, c, d in outer[:-1] if c <= a and b <= d]
        if fit:
            want[i] = min(fit)[2]
    assert got == want


# ---- evaluation


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.beta(1, 8, 777), 3)
    df = spark.createDataFrame([("s", float(v)) for v in x] + [("t", 0.5), ("u", None)], "split string, v double")
    shares = [i / 10 for i in range(11)]
    got = {r.split: r.edges for r in metrics.quantiles(df, "split", "v", shares).collect()}
    assert got["s"] == pytest.approx(list(np.quantile(x, shares))) and got["t"] == [0.5] * 11 and "u" not in got


def test_platt_finds_the_curve_and_isotonic_rises(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0.02, 0.98, 4000)
    true = 1 / (1 + np.exp(-(0.6 * np.log(p / (1 - p)) - 1.0)))
    df = scores(spark, [(float(a), int(rng.random() < b)) for a, b in zip(p, true)])
    c = evaluation.fit(df, "platt")
    assert c["a"] == pytest.approx(0.6, abs=0.12) and c["b"] == pytest.approx(-1.0, abs=0.15)
    iso = json.loads(json.dumps(evaluation.fit(df, "isotonic")))
    assert all(a <= b for a, b in zip(iso["y"], iso["y"][1:])) and 0 <= min(iso["y"]) and max(iso["y"]) <= 1
    x = evaluation.out_of_fold(df, "platt")
    assert x.where("calibrated IS NULL").count() == 0 and x.select("fold").distinct().count() == 5
    told = evaluation.decision(metrics.calibration_report(df), metrics.calibration_report(x, score="calibrated")).first()
    assert told.adopt and told.ece_after < told.ece_before
    with pytest.raises(ValueError):
        evaluation.fit(df, "other")
    with pytest.raises(ValueError):
        evaluation.out_of_fold(scores(spark, [(0.1, 0), (0.2, 1)]), "platt")


@pytest.mark.parametrize("before, after, reason", [
    ((0.10, 0.05, 0.30, 0.01), (0.05, 0.05, 0.30), "adopted"), ((0.10, 0.05, 0.30, 0.06), (0.05, 0.05, 0.30), "within noise"), ((0.10, 0.05, 0.30, 0.01), (0.05, 0.06, 0.30), "brier worse"),
    ((0.10, 0.05, 0.30, 0.01), (0.05, 0.05, 0.29), "ranking lost"), ((0.10, 0.05, 0.30, 0.01), (0.095, 0.05, 0.30), "gain too small"), ((0.10, 0.05, float("nan"), 0.01), (0.05, 0.05, 0.1), "adopted"), ((float("nan"), 0.05, 0.3, 0.01), (0.05, 0.05, 0.1), "undefined"),
])
def test_adoption(spark, before, after, reason):
    b = spark.createDataFrame([("v", *before)], "split string, ece double, brier double, pr_auc double, noise_floor double")
    a = spark.createDataFrame([("v", *after)], "split string, ece double, brier double, pr_auc double")
    r = evaluation.decision(b, a).first()
    assert r.reason == reason and r.adopt == (reason == "adopted")


def test_a_policy_is_frozen_on_validation_only(spark):
    rng = random.Random(3)
    df = scores(spark, [(round(min(0.99, max(0.01, rng.gauss(0.3 + 0.3 * y, 0.15))), 3), y) for y in (int(rng.random() < 0.3) for _ in range(400))])
    policy = evaluation.frozen_policy(df, "platt")
    assert policy["selected_on"] == "validation" and set(policy["objectives"]) == set(evaluation.OBJECTIVES)
    assert {r.threshold for r in evaluation.evaluated(df, policy).collect()} == {0.5, policy["threshold"]}
    with pytest.raises(ValueError):
        evaluation.evaluated(df, policy | {"selected_on": "test"})


def test_hybrids_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.1, 0.7), (0, 0.45, 0.4), (0, 0.2, 0.0)], "target int, score double, rules double")
    got = {r.variant: (r.tp, r.fp, r.fn, r.tn) for r in evaluation.hybrids(df, 0.5, ["rules"]).collect()}
    assert got == {"ml_only": (1, 0, 1, 2), "rules": (2, 1, 0, 1), "ml_or_rules": (2, 1, 0, 1), "ml_and_rules": (1, 0, 1, 2), "ml_plus_rules": (1, 1, 1, 1)}
    a = {(r.rule_flag, r.ml_flag): (r.n, r.positives) for r in evaluation.agreement(df, 0.5, "rules").collect()}
    assert a == {(True, True): (1, 1), (True, False): (2, 1), (False, False): (1, 0)}


def test_tables_of_one_length_only(spark):
    p = spark.createDataFrame([(0, 0.1), (1, 0.2)], "row_idx long, score double")
    assert evaluation.positional(p, {"x": p}).orderBy("row_idx").first().x_score == 0.1
    for other in (p.limit(1), p.unionAll(p.limit(1)), p.withColumn("row_idx", F.lit(0).cast("long"))):
        with pytest.raises(ValueError):
            evaluation.positional(p, {"x": other})


def test_slices_of_rows_without_a_class(spark):
    rows = [(0, 0.9, True, 3, ["CWE-1", " CWE-2 "], "A"), (1, 0.8, None, None, None, " "), (1, 0.1, False, 1, ["CWE-1"], "a ")]
    got = {(r.slice, r.value): (r.n, r.positives) for r in evaluation.slices(spark.createDataFrame(rows, "target int, score double, truncated boolean, chunks int, cwe array<string>, project string"), 0.5).collect()}
    assert got["cwe", "CWE-1"] == (2, 1) and got["project", "a"] == (2, 1) and got["chunks", "none"] == (1, 1) and got["truncation", "whole"] == (2, 2)


# ---- pooling


@pytest.mark.parametrize("method", pooling.METHODS)
def test_pooling(spark, method):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(4).tolist(), float(rng.standard_normal() * 400)) for k in (1, 1, 1, 2)] + [(3, None, 0.0)]
    got = {r.k: r.vector for r in pooling.pooled(spark.createDataFrame(rows, "k long, v array<double>, s double"), "k", "v", method, "s").collect()}
    x, s = np.array([r[1] for r in rows[:3]]), np.array([r[2] for r in rows[:3]])
    w = np.exp(s - s.max())
    want = {"mean": x.mean(0), "max": x.max(0), "attention": (w[:, None] * x).sum(0) / w.sum()}[method]
    assert set(got) == {1, 2} and got[1] == pytest.approx(want) and got[2] == pytest.approx(rows[3][1])


def test_tokens_and_batches(spark):
    v = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 2.0), (3.0, 6.0), (9.0, 9.0))])
    assert one(spark, pooling.token_pooled(v, mask=F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 4.0] and one(spark, pooling.token_pooled(v, "cls")) == [1.0, 2.0]
    df = spark.createDataFrame([(1, [[0, 5, 2], [0, 2]]), (2, [])], "fn_id long, chunks array<array<int>>")
    got = pooling.collated(df, width=4).orderBy("chunk_no").collect()
    assert [(r.ids, r["mask"]) for r in got] == [([0, 5, 2, 1], [1, 1, 1, 0]), ([0, 2, 1, 1], [1, 1, 0, 0])]
    with pytest.raises(Exception, match="more than 2"):
        pooling.collated(df, width=2).collect()
    with pytest.raises(Exception, match="without chunks"):
        pooling.guarded(df).collect()
    assert [len(r.chunks) for r in pooling.guarded(df.where("fn_id = 1"), most=1).collect()] == [1]
    with pytest.raises(ValueError):
        pooling.guarded(df.where("false"))


def test_chunks_tell_what_they_leave_out(spark):
    df = spark.createDataFrame([(1, "t", 0, " ".join("abcdefghij")), (2, "v", 1, None)], "fn_id long, split string, target int, func string")
    got = {r.fn_id: (len(r.chunks), r.truncated) for r in corpus.chunked(df, 5, 1, 3).collect()}
    assert got == {1: (3, True), 2: (1, False)}


def test_trials_that_fail_come_last(spark):
    def evaluate(p):
        if p["batch_size"] == 8:
            raise MemoryError("too large")
        return -p["dropout"]

    got = sampling.random_search(sampling.search_space(), evaluate, spark, 12).orderBy("place").collect()
    assert len(got) == 12 and got[0].error is None and all(r.error is None or r.score is None for r in got)
    best = [r.score for r in got if r.score is not None]
    assert best == sorted(best, reverse=True) and "MemoryError" in next(r.error for r in got if r.error)
    assert sampling.require_train("data/train_chunked.parquet") and pytest.raises(ValueError, sampling.require_train, "train/valid.parquet")


def test_the_best_head_is_given_back(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b)], int(a + 0.3 * b > 0)) for i, (a, b) in enumerate(rng.standard_normal((200, 2)))]
    df = spark.createDataFrame(rows, "fn_id long, vector array<double>, target int")
    model, history = pooling.fitted(df.where("fn_id < 150"), df.where("fn_id >= 150"), epochs=4, patience=1)
    scores_ = [r.score for r in history.orderBy("epoch").collect()]
    assert 1 <= len(scores_) <= 4 and max(scores_) > 0.9
    r = metrics.ranking(pooling.predicted(df.where("fn_id >= 150"), model).withColumn("split", F.lit("v"))).first()
    assert r.average_precision == pytest.approx(max(scores_))


def test_an_audit_tells_what_is_absent(spark):
    rows = [(1, "train", "int a;", 0, None), (2, "test", "int b;", 1, "h"), (3, "train", "int b;", 0, "")]
    df = spark.createDataFrame([(i, s, f, t, None, None, None, None, h) for i, s, f, t, h in rows], "fn_id long, split string, func string, target int, project string, commit_id string, idx string, big_vul_idx string, hash string")
    got = {(r.dim, r.left_split, r.right_split): r for r in corpus.audit_report(df).collect()}
    assert len(got) == 21 and not got["hash", "train", "test"].available and got["exact_code", "train", "test"].available
    assert got["exact_code", "train", "test"].label_conflicts == 1 and len(got["exact_code", "train", "test"].examples) == 1 and not got["exact_code", "train", "valid"].available


def test_tokens_of_a_public_vocabulary(spark):
    from siltworks.functions import tokens

    df = spark.createDataFrame([(1, "int main(void) { return 0; }"), (2, ""), (3, None)], "fn_id long, func string")
    got = {r.fn_id: r.tokens for r in tokens.tokenized(df, "fn_id", "func").collect()}
    assert tokens.encoding(tokens.default_vocabulary()).decode(got[1]) == "int main(void) { return 0; }" and got[2] == got[3] == []
    c = {r.fn_id: r for r in corpus.token_chunks(tokens.tokenized(df, "fn_id", "func"), length=4, overlap=1, most=2).collect()}
    assert c[1].truncated and [x[0] for x in c[1].chunks] == [0, 0] and c[2].chunks == [[0, 2]]
