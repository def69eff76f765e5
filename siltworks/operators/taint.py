"""Taint from sources to sinks, line by line within a function, and the closure of tainted variables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import lines, trimmed
from siltworks.operators.detect import lookup

# What taints a variable, by language; the first group is the variable.
SOURCES = {
    "python": [
        r"\b([A-Za-z_]\w*)\s*=\s*input\s*\(",
        r"\b([A-Za-z_]\w*)\s*=\s*request\.args\.",
        r"\b([A-Za-z_]\w*)\s*=\s*request\.form\.",
        r"\b([A-Za-z_]\w*)\s*=\s*request\.json",
        r"\b([A-Za-z_]\w*)\s*=\s*os\.environ",
    ],
    "javascript": [
        r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*prompt\s*\(",
        r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*req\.query",
        r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*req\.body",
        r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*req\.params",
        r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*process\.argv",
    ],
    "java": [
        r"\bString\[\]\s+(args)\b",
        r"\b(?:String|Object|var)\s+([A-Za-z_]\w*)\s*=\s*request\.getParameter\s*\(",
        r"\b(?:String|Object|var)\s+([A-Za-z_]\w*)\s*=\s*request\.getHeader\s*\(",
    ],
    "cpp": [
        r"\bgets\s*\(\s*([A-Za-z_]\w*)\s*\)",
        r"\bscanf\s*\(\s*[^,]+,\s*&?\s*([A-Za-z_]\w*)",
        r"\bfgets\s*\(\s*([A-Za-z_]\w*)",
        r"\bread\s*\(\s*[^,]+,\s*([A-Za-z_]\w*)",
        r"\brecv\s*\(\s*[^,]+,\s*([A-Za-z_]\w*)",
    ],
}
# An assignment's target and expression, by language, and the one of the closure.
ASSIGNMENT = {
    "javascript": r"\b(?:const|let|var)?\s*([A-Za-z_$]\w*)\s*=\s*(.+)",
    "java": r"\b(?:String|Object|var|int|long|double|float|boolean)?\s*([A-Za-z_]\w*)\s*=\s*(.+)",
    "cpp": r"\b([A-Za-z_]\w*)\s*=\s*(.+)",
}
CLOSURE_ASSIGNMENT = r"\b(?:const|let|var)?\s*([A-Za-z_$]\w*)\s*(?:\[[^\]]*\])?\s*=\s*([^;#\n]+)"
IDENTIFIER = r"\b[A-Za-z_$]\w*\b"
# Functions that make a value safe, and sinks (name, class, severity) by language, in order.
SANITIZERS = ["sanitize", "validate", "escape", "html_escape", "shell_escape"]
SINKS = {
    "cpp": [("system", "CWE-78", "CRITICAL"), ("strcpy", "CWE-120", "HIGH"), ("strcat", "CWE-120", "HIGH"), ("printf", "CWE-134", "HIGH"), ("sprintf", "CWE-120", "HIGH")],
    "python": [("os.system", "CWE-78", "CRITICAL"), ("subprocess.run", "CWE-78", "CRITICAL"), ("subprocess.call", "CWE-78", "CRITICAL"), ("subprocess.Popen", "CWE-78", "CRITICAL"), ("eval", "CWE-95", "CRITICAL"), ("exec", "CWE-95", "CRITICAL"), ("execute", "CWE-89", "CRITICAL"), ("executemany", "CWE-89", "CRITICAL")],
    "javascript": [("child_process.exec", "CWE-78", "CRITICAL"), ("child_process.execSync", "CWE-78", "CRITICAL"), ("eval", "CWE-95", "CRITICAL"), ("Function", "CWE-95", "CRITICAL"), ("query", "CWE-89", "CRITICAL"), ("execute", "CWE-89", "CRITICAL")],
    "java": [("Runtime.getRuntime().exec", "CWE-78", "CRITICAL"), ("ProcessBuilder", "CWE-78", "CRITICAL"), ("executeQuery", "CWE-89", "CRITICAL"), ("executeUpdate", "CWE-89", "CRITICAL"), ("execute", "CWE-89", "CRITICAL")],
}
# Marks of a language where none is given.
FALLBACK = [("javascript", r"console\.log|const |let |function |=>"), ("python", r"\bdef\s+\w+\s*\(|\bimport\s+\w+|\binput\s*\(")]
#: Kinds of event, in the order of a line's steps.
SOURCE, ASSIGN, CHECKED, SAFE, SINK = "source", "assign", "checked", "safe", "sink"


def fallback_language(code: Column) -> Column:
    """The language that taint is looked for in where none is given."""
    return F.when(code.rlike(FALLBACK[0][1]), FALLBACK[0][0]).when(code.rlike(FALLBACK[1][1]), FALLBACK[1][0]).otherwise("cpp")


def _sink_pattern(name: str) -> str:
    quoted = name.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)")
    return rf"\b{quoted}\s*\((.*?)\)"


def sinks(spark) -> DataFrame:
    """(language, sink, cwe, severity): the sinks that are looked for; C and unknown languages have those of cpp."""
    return spark.createDataFrame([(lang, *s) for lang, all_ in SINKS.items() for s in all_], "language string, sink string, cwe string, severity string")


def _event(kind: str, when: Column, name: Column, words: Column, sink: str = "") -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), name.alias("name"), words.alias("words"), F.lit(sink).alias("sink")))


def _identifiers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)))


def events(df: DataFrame, key: str, code: str, language: Column) -> DataFrame:
    """(key, line, step, kind, name, words, sink): what each line does, in order: taints ``name``; assigns to it an expression of the identifiers ``words``; checks it; makes it a safe copy of words[0]; calls a sink with ``words``.

    Only texts with a source and a sink are cut into lines: without either nothing can flow."""
    lang = F.when(language.isin("python", "javascript", "java"), language).otherwise("cpp")
    source = {k: F.col("code").rlike("|".join(f"(?:{p})" for p in ps)) for k, ps in SOURCES.items()}
    sink = {k: F.col("code").rlike(r"\b(?:" + "|".join(_sink_pattern(s)[2:].rsplit("(.*?)", 1)[0] for s, _, _ in ss) + ")") for k, ss in SINKS.items()}
    both = F.lit(False)
    for k in SOURCES:
        both = F.when(F.col("lang") == k, source[k] & sink[k]).otherwise(both)
    x = df.select(F.col(key), F.col(code).alias("code"), lang.alias("lang")).where(both)
    ln = x.select(key, "lang", F.posexplode(lines(F.col("code"))).alias("pos", "raw")).select(key, "lang", (F.col("pos") + 1).alias("line"), trimmed(F.col("raw")).alias("t")).where("t <> ''")
    t, lg = F.col("t"), F.col("lang")
    none = F.array().cast("array<string>")
    out = []
    for k, patterns in SOURCES.items():
        out += [_event(SOURCE, (lg == k) & t.rlike(p), F.regexp_extract(t, p, 1), none) for p in patterns]
    for k in ("javascript", "java", "cpp"):
        here = (lg == k) if k != "cpp" else lg.isin("cpp", "python")
        out.append(_event(ASSIGN, here & t.rlike(ASSIGNMENT[k]), F.regexp_extract(t, ASSIGNMENT[k], 1), _identifiers(F.regexp_extract(t, ASSIGNMENT[k], 2))))
    for s in SANITIZERS:
        direct = rf"\b{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)"
        copy = rf"\b(?:const|let|var|String|Object)?\s*([A-Za-z_$]\w*)\s*=\s*{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)"
        out.append(_event(CHECKED, t.rlike(direct), F.regexp_extract(t, direct, 1), none))
        out.append(_event(SAFE, t.rlike(copy), F.regexp_extract(t, copy, 1), F.array(F.regexp_extract(t, copy, 2))))
    for k, all_ in SINKS.items():
        out += [_event(SINK, (lg == k) & t.rlike(_sink_pattern(s)), F.lit(""), _identifiers(F.regexp_extract(t, _sink_pattern(s), 1)), s) for s, _, _ in all_]
    return ln.select(key, "line", F.posexplode(F.array_compact(F.array(*out))).alias("step", "e")).select(key, "line", "step", "e.*")


def flows(df: DataFrame, key: str, code: str, language: Column | str | None = None) -> DataFrame:
    """(key, line, sink, source_variable, cwe, severity): every sink call with a tainted variable among its arguments; of several the smallest name.

    A fold over a function's events in order holds the tainted and the sanitised variables. A clean assignment does not remove taint; a comparison reads as an assignment; arguments end at the first closing bracket. language: a name, a column of names (null: guessed), or none to guess. Null texts have no flow. Events are few beside lines, so one row a function holds them."""
    lang = F.lit(language) if isinstance(language, str) else language if language is not None else F.lit(None).cast("string")
    lang = F.coalesce(lang, fallback_language(F.coalesce(F.col(code), F.lit(""))))
    ev = events(df, key, code, lang)
    per = ev.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "step", "kind", "name", "words", "sink"))).alias("ev"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("tainted"), none.alias("clean"), F.array().cast("array<struct<line:int,step:int,sink:string,source_variable:string>>").alias("found"))

    def step(s: Column, e: Column) -> Column:
        one, active = F.array(e["name"]), F.array_except(s["tainted"], s["clean"])
        hit = F.arrays_overlap(e["words"], active)
        tainting = (e["kind"] == SOURCE) | ((e["kind"] == ASSIGN) & hit)
        safe = (e["kind"] == SAFE) & F.array_contains(s["tainted"], F.get(e["words"], F.lit(0)))
        checked = (e["kind"] == CHECKED) & F.array_contains(s["tainted"], e["name"])
        tainted = F.when(tainting, F.array_union(s["tainted"], one)).when(safe, F.array_except(s["tainted"], one)).otherwise(s["tainted"])
        clean = F.when(tainting, F.array_except(s["clean"], one)).when(safe | checked, F.array_union(s["clean"], one)).otherwise(s["clean"])
        flow = F.struct(e["line"].alias("line"), e["step"].alias("step"), e["sink"].alias("sink"), F.array_min(F.array_intersect(e["words"], active)).alias("source_variable"))
        found = F.when((e["kind"] == SINK) & hit, F.array_append(s["found"], flow)).otherwise(s["found"])
        return F.struct(tainted.alias("tainted"), clean.alias("clean"), found.alias("found"))

    found = per.select(key, F.inline(F.aggregate("ev", start, step)["found"]))
    kinds = {s: (c, v) for all_ in SINKS.values() for s, c, v in all_}  # a sink's class is the same in every language
    return found.select(key, "line", "sink", "source_variable", lookup({k: c for k, (c, _) in kinds.items()}, F.col("sink"), F.lit("")).alias("cwe"), lookup({k: v for k, (_, v) in kinds.items()}, F.col("sink"), F.lit("HIGH")).alias("severity"))


def tainted_variables(code: Column) -> Column:
    """All variables that any C, Python or JavaScript source of a text taints, and argv where it is named; in no order."""
    patterns = [p for k in ("cpp", "python", "javascript") for p in SOURCES[k]]
    found = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in patterns]))
    argv = F.when(code.rlike(r"\bargv\b"), F.array(F.lit("argv"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, argv))


def sanitized_variables(code: Column) -> Column:
    """All variables that are passed to a sanitizer by themselves."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(rf"\b{s}\s*\(\s*([A-Za-z_$]\w*)\s*\)"), F.lit(1)) for s in SANITIZERS])))


def _closures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tainted, clean, assigned: [(name, words)]) -> (key, tainted): breadth first from the active variables over the assignments that use them."""
    for batch in batches:
        out = []
        for tainted, clean, assigned in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
            users: dict[str, list[str]] = {}
            for a in assigned:
                for w in a["words"]:
                    users.setdefault(w, []).append(a["name"])
            have = set(tainted)
            queue = list(have - set(clean))
            while queue:
                for name in users.get(queue.pop(), ()):
                    if name not in have:
                        have.add(name)
                        queue.append(name)
            out.append(sorted(have))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["key", "tainted"])


def taint_closure(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, tainted): the sorted variables that taint reaches whatever the order of lines, of texts where there is any; a variable that is sanitised passes none on."""
    x = df.select(F.col(key).cast("long").alias("key"), F.col(code).alias("code")).select("key", "code", tainted_variables(F.col("code")).alias("tainted"), sanitized_variables(F.col("code")).alias("clean")).where(F.size("tainted") > 0)
    each = x.select("key", "tainted", "clean", F.transform(F.filter(lines(F.col("code")), lambda t: t.rlike(CLOSURE_ASSIGNMENT)), lambda t: F.struct(F.regexp_extract(t, CLOSURE_ASSIGNMENT, 1).alias("name"), F.array_distinct(F.regexp_extract_all(F.regexp_extract(t, CLOSURE_ASSIGNMENT, 2), F.lit(IDENTIFIER), F.lit(0))).alias("words"))).alias("assigned"))
    return each.mapInArrow(_closures, "key long, tainted array<string>").withColumnRenamed("key", key)
