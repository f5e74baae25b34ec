"""Findings, reports and the fixed tables of severities and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity, rank, weight in the score, level in SARIF.
SEVERITIES = [("Info", 0, 0.0, "note"), ("Low", 1, 0.1, "note"), ("Medium", 2, 0.5, "warning"), ("High", 3, 1.5, "error"), ("Critical", 4, 3.0, "error")]
#: Category, display name, SARIF rule.
CATEGORIES = [
    ("CodeExecution", "Code Execution", "code-execution"),
    ("NetworkAccess", "Network Access", "network-access"),
    ("FileSystemAccess", "File System Access", "filesystem-access"),
    ("ProcessSpawn", "Process Spawn", "process-spawn"),
    ("Obfuscation", "Obfuscation", "obfuscation"),
    ("InstallScript", "Install Script", "install-script"),
    ("EnvAccess", "Env Access", "env-access"),
    ("Suspicious", "Suspicious", "suspicious"),
    ("MaintainerChange", "Maintainer Change", "maintainer-change"),
    ("HallucinatedPackage", "Hallucinated Package", "hallucinated-package"),
    ("KnownVulnerability", "Known Vulnerability", "known-vulnerability"),
    ("DependencyRisk", "Dependency Risk", "dependency-risk"),
    ("Provenance", "Provenance", "provenance"),
    ("BinaryFile", "Binary File", "binary-file"),
    ("DataFlow", "Data Flow", "data-flow"),
]
#: Analyzers in the order that breaks ties between findings of one severity.
ANALYZERS = ("static-code", "install-scripts", "obfuscation", "syntax", "dataflow", "rules", "binary", "maintainer", "typosquat", "advisories", "provenance", "diff", "dependencies")
FINDING = "package string, version string, analyzer string, seq long, severity string, category string, title string, description string, file string, line int, snippet string"
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]


def _case(column: str | Column, pairs: list[tuple], default=None) -> Column:
    at = F.col(column) if isinstance(column, str) else column
    out = None
    for key, value in pairs:
        out = F.when(at == key, F.lit(value)) if out is None else out.when(at == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: str | Column = "severity") -> Column:
    return _case(severity, [(s, r) for s, r, _, _ in SEVERITIES], 0)


def severity_level(severity: str | Column = "severity") -> Column:
    return _case(severity, [(s, level) for s, _, _, level in SEVERITIES], "note")


def category_display(category: str | Column = "category") -> Column:
    return _case(category, [(c, d) for c, d, _ in CATEGORIES])


def category_rule(category: str | Column = "category") -> Column:
    return _case(category, [(c, r) for c, _, r in CATEGORIES])


def findings(df: DataFrame, analyzer: str | Column, severity: str | Column, category: str | Column, title: str | Column, description: str | Column = "", file: Column | None = None, line: Column | None = None, snippet: Column | None = None, seq: Column | int = 0) -> DataFrame:
    """Rows of ``df`` (with package and version) as findings."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    null = F.lit(None)
    return df.select(
        "package",
        "version",
        value(analyzer).alias("analyzer"),
        value(seq).cast("long").alias("seq"),
        value(severity).alias("severity"),
        value(category).alias("category"),
        value(title).alias("title"),
        value(description).alias("description"),
        (null if file is None else file).cast("string").alias("file"),
        (null if line is None else line).cast("int").alias("line"),
        (null if snippet is None else snippet).cast("string").alias("snippet"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings, duplicates included."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
