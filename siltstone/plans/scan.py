"""Whole scans: tables in, findings and reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators import binary, code, flow, metadata, structure
from siltstone.operators import versions as versions_of
from siltstone.plans import report


@dataclass
class Tables:
    """What a scan reads; analyzers whose tables are missing are left out."""

    packages: DataFrame
    files: DataFrame | None = None
    scripts: DataFrame | None = None
    binaries: DataFrame | None = None
    metadata: DataFrame | None = None
    versions: DataFrame | None = None
    advisories: DataFrame | None = None
    tree: DataFrame | None = None
    old_files: DataFrame | None = None
    pairs: DataFrame | None = None  # package, old_version, new_version
    dependencies: DataFrame | None = None  # package, version, dep, spec
    published: DataFrame | None = None  # package, version, latest, deprecated, created_ts, n_versions
    hooks: DataFrame | None = None  # package, version, hook
    now: Column = field(default_factory=F.current_timestamp)


Analyzer = Callable[[Tables], DataFrame]
#: An analyzer's name, the tables that it needs, and what it does. Add to it to extend a scan.
REGISTRY: dict[str, tuple[tuple[str, ...], Analyzer]] = {
    "static-code": (("files",), lambda t: code.static_code(t.files)),
    "install-scripts": (("scripts", "files"), lambda t: metadata.install_scripts(t.scripts, t.files)),
    "obfuscation": (("files",), lambda t: code.obfuscation(t.files)),
    "syntax": (("files",), lambda t: structure.syntax(t.files)),
    "dataflow": (("files",), lambda t: flow.dataflow(t.files)),
    "rules": (("files",), lambda t: code.rule_matches(t.files)),
    "binary": (("binaries",), lambda t: binary.scan(t.binaries)),
    "maintainer": (("metadata", "versions"), lambda t: metadata.maintainers(t.metadata, t.versions)),
    "typosquat": (("metadata",), lambda t: metadata.typosquat(t.metadata, t.now)),
    "advisories": (("advisories",), lambda t: metadata.advisories(t.packages, t.advisories)),
    "provenance": (("metadata", "files", "tree"), lambda t: metadata.provenance(t.metadata, t.files, t.tree)),
    "diff": (("old_files", "files", "pairs"), lambda t: versions_of.diff(t.old_files, t.files, t.pairs)),
    "dependencies": (("dependencies", "published", "hooks"), lambda t: _deep(t)),
}
#: Left out of a check unless it is asked for them.
COMPARE, DEEP = "diff", "dependencies"


def _deep(t: Tables) -> DataFrame:
    """Risks in the trees of all packages, as findings of the versions that were asked for."""
    roots = t.packages.select(F.col("package").alias("root"), F.col("version").alias("spec")).distinct()
    risks = versions_of.deep_risks(roots, t.dependencies, t.published, t.hooks, t.now)
    return risks.drop("version").join(t.packages.select("package", "version").distinct(), "package").select(schema.COLUMNS)


#: These share one pass over the lines when all of them are wanted.
LINE_ANALYZERS = ("static-code", "obfuscation", "rules")


def analyze(tables: Tables, names: list[str] | None = None) -> DataFrame:
    """The findings of all analyzers whose tables are there, or of the named ones."""
    chosen = {name: run for name, (needs, run) in REGISTRY.items() if (names is None or name in names) and all(getattr(tables, n) is not None for n in needs)}
    if all(name in chosen for name in LINE_ANALYZERS):
        chosen = {"code-lines": lambda t: code.line_findings(t.files)} | {name: run for name, run in chosen.items() if name not in LINE_ANALYZERS}
    return schema.union([run(tables) for run in chosen.values()])


def scan(tables: Tables, ignore: DataFrame | None = None, cached: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Scores of all packages: cached ones as they are, the others analyzed."""
    work = report.pending(tables.packages, cached) if cached is not None else tables.packages
    found = analyze(Tables(**{**tables.__dict__, "packages": work}), names)
    if ignore is not None:
        found = report.ignored(found, ignore)
    scored = report.scores(work, found)
    return scored if cached is None else scored.unionByName(cached.select(*scored.columns))


def check(tables: Tables, compare: bool = False, deep: bool = False, ignore: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """A scan that compares versions, or follows dependencies, only if asked to."""
    left_out = {COMPARE: not compare, DEEP: not deep}
    return scan(tables, ignore, cached, [name for name in REGISTRY if not left_out.get(name)])
