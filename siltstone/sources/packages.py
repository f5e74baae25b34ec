"""Package documents, archives, manifests and rule files as DataFrames."""

from __future__ import annotations

import io
import tarfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import names, text

_PERSON = "array<struct<name: string, email: string>>"
#: One version's document, and a package's.
VERSION = f"struct<name: string, version: string, description: string, dist: struct<tarball: string, shasum: string, integrity: string>, scripts: map<string,string>, dependencies: map<string,string>, devDependencies: map<string,string>, maintainers: {_PERSON}, deprecated: string, attestations: string, _npmSignature: string>"
PACKAGE = f"name string, description string, versions map<string,{VERSION}>, time map<string,string>, maintainers {_PERSON}, `dist-tags` map<string,string>, repository string, weeklyDownloads bigint, weekly_downloads bigint"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Registry documents, one JSON object a line; unknown fields are left out, missing ones null."""
    return spark.read.schema(PACKAGE).json(path)


def parsed(docs: DataFrame, column: str = "json") -> DataFrame:
    """The same from a text column."""
    return docs.select(F.from_json(column, PACKAGE).alias("d")).select("d.*")


def versions(docs: DataFrame) -> DataFrame:
    """(package, version, publish_ts, deprecated, latest, n_versions, maintainers, scripts, dependencies)."""
    e = docs.select(F.col("name").alias("package"), "time", F.col("dist-tags").alias("tags"), F.size("versions").alias("n_versions"), F.explode("versions").alias("version", "v"))
    return e.select("package", "version", F.try_element_at("time", F.col("version")).alias("publish_ts"), "v.deprecated", (F.coalesce(F.try_element_at("tags", F.lit("latest")), F.lit("")) == F.col("version")).alias("latest"), "n_versions", "v.maintainers", "v.scripts", "v.dependencies")


def as_single_version(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents reduced to the one version that ``wanted`` (name, version) asks for: no times,
    maintainers or extra fields, and that version as the latest. A null version keeps the whole."""
    w = docs.join(wanted.select("name", F.col("version").alias("__want")), "name")
    one = F.map_filter("versions", lambda k, v: k == F.col("__want"))
    pinned = F.col("__want").isNotNull()
    null = F.lit(None)
    return w.where(~pinned | (F.size(one) > 0)).select(
        "name", "description", F.when(pinned, one).otherwise(F.col("versions")).alias("versions"),
        *(F.when(~pinned, F.col(f"`{c}`")).otherwise(null).alias(c) for c in ("time", "maintainers", "repository", "weeklyDownloads", "weekly_downloads")),
        F.when(pinned, F.create_map(F.lit("latest"), F.col("__want"))).otherwise(F.col("dist-tags")).alias("dist-tags"),
    )


def latest(docs: DataFrame) -> DataFrame:
    """One row a package, as the name checks take it."""
    tag = F.coalesce(F.try_element_at("dist-tags", F.lit("latest")), F.lit(""))
    v = F.try_element_at("versions", tag)
    hooks = ["preinstall", "install", "postinstall", "preuninstall", "postuninstall", "prepare"]
    return docs.select(
        F.col("name").alias("package"), tag.alias("version"), F.coalesce("description", v["description"]).alias("description"),
        F.try_element_at("time", F.lit("created")).alias("created_ts"), F.coalesce("weeklyDownloads", "weekly_downloads").alias("weekly_downloads"),
        F.coalesce(F.arrays_overlap(F.map_keys(v["scripts"]), F.array(*map(F.lit, hooks))), F.lit(False)).alias("has_install_scripts"),
        F.col("repository").isNotNull().alias("has_repository"), F.size("versions").alias("n_versions"), F.get("maintainers", F.lit(0))["email"].alias("first_email"), "maintainers", "repository",
    )


def scripts(versions_: DataFrame) -> DataFrame:
    return versions_.select("package", "version", F.explode("scripts").alias("hook", "body"))


def dependencies(versions_: DataFrame) -> DataFrame:
    return versions_.select("package", "version", F.explode("dependencies").alias("dep", "spec"))


def manifests(df: DataFrame, column: str = "package_json") -> DataFrame:
    """``df`` with scripts, dependencies and devDependencies as maps; a missing manifest counts as {},
    ``broken`` tells a malformed one."""
    text_ = F.coalesce(F.col(column), F.lit("{}"))
    m = F.from_json(text_, "scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, repository string, name string")
    return df.withColumn("m", m).withColumn("broken", F.try_parse_json(text_).isNull()).select(*df.columns, "m.scripts", "m.dependencies", "m.devDependencies", "m.repository", "broken")


def project_dependencies(manifest: DataFrame, skip_dev: bool = False) -> DataFrame:
    """(project, name, spec, kind) of a project's dependencies and, unless skipped, development ones;
    duplicates across both stay."""
    kinds = [("prod", "dependencies")] + [("dev", "devDependencies")] * (not skip_dev)
    # A row for each kind, then for each dependency: where a map was exploded by itself, its manifest was parsed for the filter too.
    each = manifest.select("project", F.stack(F.lit(len(kinds)), *(x for kind, column in kinds for x in (F.lit(kind), F.col(column)))).alias("kind", "listed"))
    return each.select("project", F.explode("listed").alias("name", "spec"), "kind").withColumn("spec", F.coalesce("spec", F.lit("latest")))


def by_name(dependencies_: DataFrame) -> DataFrame:
    """A project's dependencies in the order that they are shown in."""
    return dependencies_.orderBy("project", "name", F.desc("kind"), "spec")


_ENTRY = "package string, version string, path string, data binary, error string"
#: Bytes of files that a task holds before it passes them on.
HELD_BYTES = 16 << 20


def unpack(archives: DataFrame) -> DataFrame:
    """Files of gzipped tarballs (package, version, archive binary), read in memory one by one. An
    archive that can't be read to its end gives what came before, and a row with the error and no path."""

    def files(r):
        try:
            with tarfile.open(fileobj=io.BytesIO(r.archive or b""), mode="r:*") as tar:
                for m in tar:
                    if m.isfile():
                        yield r.package, r.version, m.name, tar.extractfile(m).read(), None
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            yield r.package, r.version, None, None, f"{type(e).__name__}: {e}"

    def run(frames):
        rows, size = [], 0
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                for row in files(r):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size >= HELD_BYTES:
                        yield pd.DataFrame(rows, columns=["package", "version", "path", "data", "error"])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=["package", "version", "path", "data", "error"])

    return archives.select("package", "version", "archive").mapInPandas(run, _ENTRY)


def safe(entries: DataFrame) -> DataFrame:
    """Without entries that name a parent directory or an absolute path."""
    return entries.where(~F.array_contains(F.split("path", "/"), "..") & ~F.col("path").startswith("/"))


def rooted(entries: DataFrame) -> DataFrame:
    """Paths below the package's root: the directory ``package``, else the first one."""
    root = entries.where(F.col("path").contains("/")).groupBy("package", "version").agg(F.min(F.struct(F.substring_index("path", "/", 1) != "package", F.substring_index("path", "/", 1))).alias("r"))
    named = root.select("package", "version", F.col("r.col2").alias("root"))
    joined = entries.join(named, ["package", "version"], "left")
    inside = joined.where(F.col("root").isNull() | F.startswith("path", F.concat("root", F.lit("/"))))
    return inside.withColumn("path", F.when(F.col("root").isNull(), F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.lit(1 << 20)))).drop("root")


def _utf8(data: Column) -> Column:
    return F.try_validate_utf8(data.cast("string"))


def script_files(entries: DataFrame) -> DataFrame:
    """(package, version, path, content) of js, mjs, cjs and ts files outside node_modules that are UTF-8."""
    path = F.col("path")
    kept = entries.where(text.extension(path).isin("js", "mjs", "cjs", "ts") & ~path.rlike("(^|/)node_modules/"))
    return kept.select("package", "version", "path", _utf8(F.col("data")).alias("content")).where("content is not null")


def all_files(entries: DataFrame) -> DataFrame:
    """Every file's content; empty for what isn't UTF-8."""
    return entries.select("package", "version", "path", F.coalesce(_utf8(F.col("data")), F.lit("")).alias("content"))


def binary_files(entries: DataFrame) -> DataFrame:
    return entries.where(F.lower(text.extension(F.col("path"))).isin("wasm", "node", "exe", "dll", "so", "dylib"))


def ignore_rules(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of ignore files, blank ones and comments left out."""
    return spark.read.text(paths).select(text.trimmed(F.col("value")).alias("rule")).where("rule != '' and not startswith(rule, '#')")


def rule_files(folder: str) -> list[tuple]:
    """Rules of the YAML files below a folder, .yml before .yaml, as ``operators.code.rule_matches``
    takes them. The first bad file ends the loading."""
    from pathlib import Path

    import yaml

    out = []
    for p in [*sorted(Path(folder).rglob("*.yml")), *sorted(Path(folder).rglob("*.yaml"))]:
        r = yaml.safe_load(p.read_text(encoding="utf-8"))
        out.append((r["id"], r["name"], r["severity"], r["category"], r["pattern"], r.get("file_pattern"), tuple(r.get("exclude_paths") or ())))
    return out


def requested(specs: DataFrame) -> DataFrame:
    """(name, version) of package specifiers in ``spec``."""
    return specs.select(names.spec_name(F.col("spec")).alias("name"), names.spec_version(F.col("spec")).alias("version"))
