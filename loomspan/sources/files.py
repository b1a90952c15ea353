"""File listings with the rules of what is never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import READERS, extension, glob_regex

# Folders and file names that hold no text a person wrote, and the largest file read.
SKIPPED_DIRS = (
    ".build .cache .git .gradle .hg .mypy_cache .next .nuxt .pytest_cache .ruff_cache .svn .terraform .tox .venv Carthage Contents DerivedData Pods __fixtures__ __pycache__ __snapshots__ "
    "build buildtools dist external fixtures golden goldens node_modules site-packages snapshots target test_data testdata third_party thirdparty vendor venv"
).split()
DEPENDENCIES = "go/pkg/mod .cargo/registry .rustup/toolchains .pub-cache .gem/ .nuget/ .m2/repository .cocoapods/ Library/Caches".split()
DIAGNOSTIC_DIRS = "sysdiagnose_* *.logarchive *.xcresult *.crash DiagnosticReports CrashReporter ioreg logs Logs spindump* *.dSYM CoreSimulator Diagnostics".split()
DIAGNOSTIC_FILES = "*.hash.txt *.sha.txt *.sha256* *.md5 apticket* *.der.txt *.plist.txt spindump*.txt pmset*.txt taskinfo*.txt launchctl*.txt *_status.txt ps.txt netstat*.txt vm_stat*.txt system_profiler*.txt *.stackshot *.ips *.diag *.panic".split()
LARGEST = 64 << 20


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns)


def skip_reason(relative: Column, length: Column, include_code: bool = False) -> Column:
    """Why a file is not read, by its path below the root and its size; null if it is."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    fragment = F.lit(False)
    for f in DEPENDENCIES:
        fragment = fragment | relative.contains(f)
    known = [e for words in READERS.values() for e in words.split()]
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS))), "excluded folder")
        .when(F.exists(folders, lambda x: x.startswith(".")) | name.startswith("."), "hidden")
        .when(fragment, "dependency cache")
        .when(F.exists(folders, lambda x: x.rlike(_any(DIAGNOSTIC_DIRS))) | name.rlike(_any(DIAGNOSTIC_FILES)), "diagnostics")
        .when(length == 0, "empty")
        .when(length > LARGEST, "too large")
        .when(~F.lit(include_code) & extension(name).isin(*READERS["code"].split()), "code")
        .when(~extension(name).isin(*known), "no reader")
    )


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: ``path, relative, mtime, size``; contents are not read (the column is pruned)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select("path", F.substring(path, len(base) + 2, 1 << 20).alias("relative"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
