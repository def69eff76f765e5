"""Source files and requests: names, languages, bounds; reports; probes' lines; the environment."""

from __future__ import annotations

import os
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import trimmed
from siltworks.operators.detect import language_name, lookup

# Languages by file extension, and the names of a language that can be asked for.
EXTENSIONS = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java"}
LANGUAGES = ["c", "cpp", "python", "javascript", "java"]
LANGUAGE_ALIASES = {"javascript": ["js"], "python": ["py"], "cpp": ["c++"]}
#: Largest source text in characters or bytes, longest file name.
MOST_CHARS, MOST_NAME = 1_000_000, 255
#: The fields of a probe's CSV line.
GPU_FIELDS = ["temp_c", "util_pct", "mem_used_mib", "mem_total_mib", "power_w", "sm_clock_mhz", "throttle"]
#: What the bits of a throttle mask stand for, from the lowest.
THROTTLE = ["GpuIdle", "AppClocksSetting", "SwPowerCap", "HwSlowdown", "SyncBoost", "SwThermalSlowdown", "HwThermalSlowdown", "HwPowerBrake"]


def base_name(path: Column) -> Column:
    """The part of a path after the last separator of either kind; ``uploaded`` where nothing is left."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(trimmed(name), F.lit("")), F.lit("uploaded"))


def extension_language(name: Column) -> Column:
    """The language that a file's extension stands for, else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return lookup(EXTENSIONS, ext, F.lit(None).cast("string"))


def supported_languages(spark: SparkSession) -> DataFrame:
    """(language, aliases, extensions, graphs): what can be analysed, and whether program graphs are built for it."""
    rows = [(x, LANGUAGE_ALIASES.get(x, []), sorted(e for e, of in EXTENSIONS.items() if of == x), x in ("c", "cpp")) for x in LANGUAGES]
    return spark.createDataFrame(rows, "language string, aliases array<string>, extensions array<string>, graphs boolean")


def checked_requests(df: DataFrame, code: str = "code", language: str = "language", name: str | None = None) -> DataFrame:
    """df with ``asked`` (the language, or null for any) and ``refused``: why a request cannot be analysed (null if it can).

    The code must have 1 to 1,000,000 characters and not be blank, a language must be known after trimming, lower-casing and aliases, a file name may have 255 characters."""
    lang = language_name(F.col(language))
    size = F.length(F.coalesce(code, F.lit("")))
    why = F.when(size == 0, "empty").when(size > MOST_CHARS, "too long").when(F.length(trimmed(F.col(code))) == 0, "blank").when(lang.isNotNull() & ~lang.isin(*LANGUAGES), "language")
    if name:
        why = why.when(F.length(name) > MOST_NAME, "name")
    return df.withColumn("asked", F.when(lang.isin(*LANGUAGES), lang)).withColumn("refused", why)


def source_files(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(name, language, code, refused) of the files under a path: refused where a file is larger than 1,000,000 bytes, blank, not UTF-8, or of no known extension while no language is given; code is null then."""
    f = spark.read.format("binaryFile").load(path)
    name = base_name(F.col("path"))
    lang = F.lit(language) if language else extension_language(name)
    f = f.select(name.alias("name"), lang.alias("language"), "length", F.when(F.col("length") <= MOST_CHARS, F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))
    why = F.when(F.col("language").isNull(), "extension").when(F.col("length") > MOST_CHARS, "too large").when(F.col("text").isNull(), "encoding").when(F.length(trimmed(F.col("text"))) == 0, "blank")
    return f.withColumn("refused", why).select("name", "language", F.when(F.col("refused").isNull(), F.col("text")).alias("code"), "refused")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report, one object a file; a path that does not exist raises."""
    return spark.read.option("multiLine", True).json(path)


def probe_values(line: Column) -> Column:
    """The seven fields of a probe's CSV line as numbers (null where a field is none) and the last as it is."""
    part = F.split(line, r"\s*,\s*")
    field = lambda i: trimmed(F.get(part, F.lit(i)))
    numbers = [field(i).try_cast("double").alias(n) for i, n in enumerate(GPU_FIELDS[:-1])]
    return F.struct(*numbers, field(len(GPU_FIELDS) - 1).alias(GPU_FIELDS[-1]))


def throttle_reasons(mask: Column) -> Column:
    """The names of the bits that a hexadecimal mask sets, from the lowest; none for what is no such number."""
    number = F.conv(F.nullif(F.regexp_extract(trimmed(mask), r"^(?:0[xX])?([0-9a-fA-F]{1,15})$", 1), F.lit("")), 16, 10).try_cast("long")
    names = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(n).alias("name")) for i, n in enumerate(THROTTLE)])
    return F.transform(F.filter(names, lambda x: F.coalesce(x["bit"].bitwiseAND(number) != 0, F.lit(False))), lambda x: x["name"])


def environment(spark: SparkSession, folder: str = ".") -> DataFrame:
    """One row: versions, host, cores and, where the folder is a repository, its commit and whether it has changes."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    commit, changes = git("rev-parse", "HEAD"), git("status", "--porcelain")
    row = (spark.version, platform.python_version(), platform.platform(), os.cpu_count(), spark.sparkContext.master, commit, None if changes is None else bool(changes))
    return spark.createDataFrame([row], "spark string, python string, platform string, cores int, master string, commit string, changed boolean")
