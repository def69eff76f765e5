"""Line detectors: rules by language, format strings, secrets, weak hashes, SQL injection; scores of findings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import lines

# Fixed values: (language, function, pattern, severity, class).
RULES = [
    ("cpp", "gets", r"\bgets\s*\(", "CRITICAL", "CWE-242"),
    ("cpp", "strcpy", r"\bstrcpy\s*\(", "HIGH", "CWE-120"),
    ("cpp", "strcat", r"\bstrcat\s*\(", "HIGH", "CWE-120"),
    ("cpp", "sprintf", r"\bsprintf\s*\(", "HIGH", "CWE-120"),
    ("cpp", "scanf", r'\bscanf\s*\(\s*"[^"]*%s', "HIGH", "CWE-120"),
    ("cpp", "system", r"\bsystem\s*\(", "HIGH", "CWE-78"),
    ("cpp", "rand", r"\brand\s*\(", "MEDIUM", "CWE-338"),
    ("python", "os.system", r"\bos\.system\s*\(", "HIGH", "CWE-78"),
    ("python", "eval", r"\beval\s*\(", "CRITICAL", "CWE-95"),
    ("python", "exec", r"\bexec\s*\(", "CRITICAL", "CWE-95"),
    ("javascript", "eval", r"\beval\s*\(", "CRITICAL", "CWE-95"),
    ("javascript", "Function", r"\bFunction\s*\(", "CRITICAL", "CWE-95"),
    ("javascript", "child_process.exec", r"\bchild_process\.exec\s*\(", "HIGH", "CWE-78"),
    ("javascript", "exec", r"(?:^|[^.\w])exec\s*\(", "HIGH", "CWE-78"),
    ("javascript", "child_process.execSync", r"\bchild_process\.execSync\s*\(", "HIGH", "CWE-78"),
    ("java", "Runtime.exec", r"\bRuntime(?:\.getRuntime\(\))?\.exec\s*\(", "HIGH", "CWE-78"),
    ("java", "ProcessBuilder", r"\bnew\s+ProcessBuilder\s*\(", "HIGH", "CWE-78"),
    ("java", "ObjectInputStream", r"\bnew\s+ObjectInputStream\s*\(", "HIGH", "CWE-502"),
]
# Patterns of the other detectors.
FORMAT_STRING = r"\b(printf|fprintf|sprintf|syslog)\s*\(\s*[A-Za-z_]\w*\s*\)"
SECRET = r"(?i)\b(password|passwd|api_key|apikey|secret|token)\b(?:\s*\[\s*\])?\s*[:=]\s*[\"'][^\"']+[\"']"
WEAK = [("md5", r"(?i)\b(md5|hashlib\.md5)\s*\("), ("sha1", r"(?i)\b(sha1|hashlib\.sha1)\s*\(")]
SQL_WORDS = "SELECT|INSERT|UPDATE|DELETE|FROM|WHERE"
SQL_JOINTS = {"python": ["+", 'f"', "f'", ".format(", "%"], "javascript": ["+", "${"], "other": ["+"]}
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.2, "INFO": 0.05}
PENALTY = {"CRITICAL": 30, "HIGH": 15, "MEDIUM": 7, "LOW": 3}
CONFIDENCE_BY_FUNCTION = {"gets": 0.99, "strcpy": 0.95, "strcat": 0.95, "sprintf": 0.95, "system": 0.95, "scanf": 0.90, "rand": 0.90, "md5": 0.98, "sha1": 0.98}
CONFIDENCE_BY_TYPE = {"FORMAT_STRING": 0.90, "HARDCODED_SECRET": 0.85, "WEAK_CRYPTO": 0.95, "TAINT_FLOW": 0.90, "RULE_BASED": 0.85}
# What marks a text's language, in the order of the test; java has one mark that needs both of two.
LANGUAGE_MARKS = [
    ("java", ["public class ", "private class ", "System.out.println"]),
    ("python", ["def ", "import ", "print(", "elif "]),
    ("javascript", ["console.log", "function ", "const ", "let ", "var "]),
    ("cpp", ["#include", "std::", "int main", "using namespace"]),
]
JAVA_BOTH = ["class ", "public static void main"]
ALIASES = {"js": "javascript", "py": "python", "c++": "cpp", "c": "cpp"}


def lookup(values: dict, c: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), default)


def language_name(c: Column) -> Column:
    """Trimmed, lower-cased, aliases resolved; blank is null."""
    low = F.lower(F.trim(c))
    return F.nullif(lookup(ALIASES, F.coalesce(low, F.lit("")), low), F.lit(""))


def detected_language(c: Column) -> Column:
    """The first of java, python, javascript and cpp whose marks a text has, else unknown."""
    has = lambda xs: reduce(or_, [F.contains(c, F.lit(x)) for x in xs])
    out = F.lit("unknown")
    for name, marks in reversed(LANGUAGE_MARKS):
        test = has(marks) | reduce(and_, [F.contains(c, F.lit(x)) for x in JAVA_BOTH]) if name == "java" else has(marks)
        out = F.when(test, name).otherwise(out)
    return out


def _has(c: Column, pattern: str, *words: str) -> Column:
    """Whether a line matches a pattern; the pattern is tried only on lines that hold one of the words that every match holds, which is a plain search."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words]) & c.rlike(pattern)


def findings(df: DataFrame, key: str, code: str, language: Column | str) -> DataFrame:
    """(key, detector, type, function, severity, cwe, line), one row for each rule and line that matches.

    language: a name, or a column of names (null means C). Patterns are literals, compiled once a task; lines are exploded once, in the JVM. Null texts have no line."""
    lang = language if isinstance(language, Column) else F.lit(language)
    ln = df.select(F.col(key), F.coalesce(lang, F.lit("cpp")).alias("lang"), F.posexplode(lines(F.col(code))).alias("pos", "text"))
    t, lg = F.col("text"), F.col("lang")
    entry = lambda when, n, kind, fn, sev, cwe: F.when(when, F.struct(F.lit(n).alias("detector"), F.lit(kind).alias("type"), fn.alias("function"), F.lit(sev).alias("severity"), F.lit(cwe).alias("cwe")))
    found = [entry((lg == l) & _has(t, p, fn.split(".")[0] if fn == "Runtime.exec" else fn), 1, "RULE_BASED", F.lit(fn), sev, cwe) for l, fn, p, sev, cwe in RULES]
    found.append(entry((lg == "cpp") & _has(t, FORMAT_STRING, "printf", "syslog"), 2, "FORMAT_STRING", F.regexp_extract(t, FORMAT_STRING, 1), "HIGH", "CWE-134"))
    found.append(entry(_has(t, SECRET, "\"", "'"), 3, "HARDCODED_SECRET", F.lower(F.regexp_extract(t, SECRET, 1)), "HIGH", "CWE-798"))
    found += [entry(_has(t, p, fn[-1]), 4, "WEAK_CRYPTO", F.lit(fn), "MEDIUM", "CWE-327") for fn, p in WEAK]
    joints = lambda xs: reduce(or_, [F.contains(t, F.lit(x)) for x in xs])
    joined = F.when(lg == "python", joints(SQL_JOINTS["python"])).when(lg == "javascript", joints(SQL_JOINTS["javascript"])).otherwise(joints(SQL_JOINTS["other"]))
    found.append(entry(joined & F.upper(t).rlike(SQL_WORDS), 5, "SQL_INJECTION", F.lit("SQL_QUERY"), "HIGH", "CWE-89"))
    return ln.select(key, (F.col("pos") + 1).alias("line"), F.inline(F.array_compact(F.array(*found)))).select(key, "detector", "type", "function", "severity", "cwe", "line")


def unique_findings(df: DataFrame, key: str) -> DataFrame:
    """One finding for each type, class, line and function, the earliest detector's, with its confidence."""
    first = df.groupBy(key, "type", "cwe", "line", "function").agg(F.min("detector").alias("detector"), F.min_by("severity", "detector").alias("severity"))
    by_type = lookup(CONFIDENCE_BY_TYPE, F.col("type"), F.lit(0.75))
    return first.withColumn("confidence", lookup(CONFIDENCE_BY_FUNCTION, F.col("function"), by_type))


def risk(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per item: findings, rule score (the sum of severity weights, at most 1), security score (100 less penalties, at least 0) and its level; items without findings included."""
    weight = lookup(SEVERITY_WEIGHT, F.coalesce("severity", F.lit("MEDIUM")), F.lit(0.4))
    penalty = lookup(PENALTY, F.coalesce("severity", F.lit("LOW")), F.lit(0))
    per = found.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.sum(weight).alias("w"), F.sum(penalty).alias("p"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("p", F.lit(0)))
    return df.select(key).join(per, key, "left").select(
        key,
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.round(F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0))), 9).alias("rule_score"),
        score.cast("long").alias("security_score"),
        F.when(score >= 90, "LOW").when(score >= 70, "MEDIUM").when(score >= 40, "HIGH").otherwise("CRITICAL").alias("risk_level"),
    )


def severity_summary(found: DataFrame, key: str) -> DataFrame:
    """Per item with findings: their number, in all and of each severity (a missing one counts as MEDIUM)."""
    sev = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(sev == s, 1)).alias(s.lower()) for s in SEVERITY_WEIGHT])
