"""Findings from package metadata: names, maintainers, install scripts, advisories, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import names, storage, text
from siltstone.operators import patterns


def similar_names(packages: DataFrame) -> DataFrame:
    """(package, version, top, technique, distance): the first popular name that a package's name
    imitates, or is within two edits of. The popular names are a fixed list of fifty, held as an array
    in the projection, so the comparison needs no join and no shuffle."""
    name = F.col("package")
    tops = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(t).alias("top")) for i, t in enumerate(patterns.TOP_PACKAGES)))
    each = packages.where(~name.isin(patterns.LEGITIMATE) & ~name.isin(patterns.TOP_PACKAGES)).select("package", "version", F.explode(tops).alias("t"))
    top = F.col("t.top")
    judged = each.where(~names.plugin(name, top)).select("package", "version", F.col("t.pos").alias("pos"), top.alias("top"), names.technique(name, top).alias("technique"), F.levenshtein(name, top).alias("distance"), names.normalized_levenshtein(name, top).alias("ratio"))
    hits = judged.where(F.col("technique").isNotNull() | ((F.col("distance") > 0) & (F.col("distance") <= 2) & (F.col("ratio") < 0.4)))
    first = hits.groupBy("package", "version").agg(F.min_by(F.struct("top", "technique", "distance"), "pos").alias("f"))
    return first.select("package", "version", "f.*")


def typosquat(packages: DataFrame, now: Column) -> DataFrame:
    """``packages``: package, version (latest), description, created_ts, weekly_downloads,
    has_install_scripts, has_repository, n_versions, first_email."""
    age = names.age_days(F.col("created_ts"), now)
    p = packages.withColumns({"age": age, "downloads": F.coalesce("weekly_downloads", F.lit(0)), "about": F.coalesce("description", F.lit(""))})
    new = lambda df, severity, title, seq: schema.findings(df, "typosquat", severity, "HallucinatedPackage", title, "package metadata", seq=seq)
    close = similar_names(packages.select("package", "version"))
    fragment = reduce(lambda a, b: a | b, (F.lower("package").contains(x) for x in patterns.FRAGMENTS))
    return schema.union(
        [
            new(p.where((F.col("age") <= 30) & (F.col("downloads") == 0) & F.coalesce("has_install_scripts", F.lit(False))), "Critical", "Likely malicious hallucinated package", 0),
            new(p.where((F.col("age") < 7) & (F.col("downloads") < 100)), "High", "Very new package with almost no downloads", 1),
            new(close, F.when(F.col("technique").isNotNull(), "Critical").otherwise("High"), F.when(F.col("technique").isNotNull(), F.concat(F.lit("Typosquat of '"), "top", F.lit("' detected"))).otherwise(F.concat(F.lit("Name suspiciously similar to '"), "top", F.lit("'"))), 2),
            new(p.where(F.octet_length("about") < 10), "Medium", "Missing or very short description", 3),
            new(p.where(~F.coalesce("has_repository", F.lit(False))), "Medium", "No repository URL", 4),
            new(p.where((F.col("n_versions") == 1) & F.col("version").isin("0.0.1", "1.0.0")), "Medium", "Single version published at 0.0.1 or 1.0.0", 5),
            new(p.where(F.coalesce("first_email", F.lit("")) == ""), "Medium", "Maintainer has no published email", 6),
            new(p.where(fragment), "Low", "Name matches common AI hallucination pattern", 7),
        ]
    )


def last_two(versions: DataFrame) -> DataFrame:
    """Each package's latest and previous version by publish time as text: ``versions`` is (package,
    version, publish_ts, maintainers array<struct<name, email>>). Two partial maxima, no window."""
    item = F.struct("publish_ts", "version", "maintainers")
    latest = versions.groupBy("package").agg(F.max_by(item, F.struct("publish_ts", "version")).alias("last"), F.count("*").alias("n"))
    rest = versions.join(latest.select("package", F.col("last.version").alias("__v"), F.col("last.publish_ts").alias("__t")), "package").where("not (version = __v and publish_ts = __t)")
    previous = rest.groupBy("package").agg(F.max_by(item, F.struct("publish_ts", "version")).alias("prev"))
    return latest.join(previous, "package", "left").select("package", "n", "prev", "last")


def maintainers(packages: DataFrame, versions: DataFrame) -> DataFrame:
    """``packages``: package, version, maintainers; ``versions`` as in ``last_two``."""
    now = packages.where(F.size("maintainers") > 0).select("package", "version", "maintainers")
    pairs = now.join(last_two(versions).where("prev is not null and prev.maintainers is not null"), "package").select("package", "version", F.col("prev.maintainers").alias("old"), F.coalesce("last.maintainers", "maintainers").alias("new"), F.col("last.publish_ts").alias("ts"))
    person = F.coalesce("m.name", "m.email", F.lit("?"))
    nobody = now.select("package", "version", F.explode("maintainers").alias("m")).where(F.coalesce("m.email", F.lit("")) == "")
    return schema.union(
        [
            _changed(now.where(F.size("maintainers") == 1), "Low", "Single maintainer (bus factor risk)", 0, F.concat(F.lit("Only one account can publish: "), F.coalesce(F.get("maintainers", F.lit(0))["name"], F.lit("?")))),
            maintainer_changes(pairs),
            _changed(nobody, "High", "Maintainer with no email", 5, F.concat(person, F.lit(" can't be reached"))),
        ]
    )


def _changed(df: DataFrame, severity: str, title: str, seq: int, about: Column) -> DataFrame:
    return schema.findings(df, "maintainer", severity, "MaintainerChange", title, about, seq=seq)


def maintainer_changes(pairs: DataFrame) -> DataFrame:
    """Findings of (package, version, old, new, ts): the maintainers of two versions, and when the later one came. Keeps
    no state and joins nothing, so it runs on streams."""
    keys = lambda a: F.array_distinct(F.transform(a, lambda m: names.maintainer_key(m["name"], m["email"])))
    sets = pairs.withColumns({"a": keys("old"), "b": keys("new")})
    # Of several entries with one key the last one's address counts.
    single = F.transform("a", lambda k: F.element_at(F.filter("old", lambda m: names.maintainer_key(m["name"], m["email"]) == k), -1))
    domains = F.map_from_entries(F.transform(F.filter(single, lambda m: names.email_domain(m["email"]).isNotNull()), lambda m: F.struct(names.maintainer_key(m["name"], m["email"]), F.lower(names.email_domain(m["email"])))))
    moved = F.filter("new", lambda m: F.try_element_at(F.col("domains"), names.maintainer_key(m["name"], m["email"])) != F.lower(names.email_domain(m["email"])))
    who = lambda x: F.coalesce(F.array_join(F.array_sort(x), ", "), F.lit(""))
    joined = F.concat(F.lit("New since the version before: "), who(F.array_except("b", "a")))
    added = F.size(F.array_except("b", "a")) > 0
    one = lambda severity, title, seq, about: F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(seq).alias("seq"), about.alias("about"))
    transfer = F.when((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b"), one("Critical", "Complete ownership transfer", 1, F.concat(F.lit("Published by "), who(F.col("b")), F.lit(", before by "), who(F.col("a")))))
    recent = F.when(added & names.rough_day(F.col("ts")).isNotNull(), one("High", "New maintainer added recently", 2, F.concat(joined, F.lit(", published "), F.col("ts").cast("string"))))
    elsewhere = F.transform(moved, lambda m: one("Medium", "Maintainer email domain changed", 4, F.concat(F.coalesce(m["name"], m["email"], F.lit("?")), F.lit(" now uses "), F.coalesce(m["email"], F.lit("?")))))
    found = F.concat(F.array_compact(F.array(transfer, recent, F.when(added, one("Medium", "New maintainer added", 3, joined)))), elsewhere)
    each = sets.withColumn("domains", domains).select("package", "version", F.explode(found).alias("x"))
    return schema.findings(each, "maintainer", F.col("x.severity"), "MaintainerChange", F.col("x.title"), F.col("x.about"), seq=F.col("x.seq"))


def install_scripts(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """``scripts``: package, version, hook, body; ``files``: package, version, path."""
    body = F.col("body")
    hooks = F.array(*map(F.lit, ("preinstall", "postinstall", "preuninstall")))
    used = scripts.where(F.array_contains(hooks, F.col("hook")) & body.isNotNull() & ~F.lower(text.trimmed(body)).isin(*patterns.SAFE_SCRIPTS)).withColumn("at", F.array_position(hooks, F.col("hook")) * 10)
    risky = body.rlike(patterns.DANGEROUS_SCRIPT)
    present = schema.findings(used, "install-scripts", F.when(risky, "Critical").otherwise("Medium"), "InstallScript", F.when(risky, F.concat(F.lit('Dangerous command in "'), "hook", F.lit('" script'))).otherwise(F.concat(F.lit('Install lifecycle script "'), "hook", F.lit('" present'))), "an install script", F.lit("package.json"), None, text.truncate(body, 100), F.col("at"))
    target = used.withColumn("target", F.regexp_extract("body", patterns.SCRIPT_FILE, 1)).where("target != ''")
    # A file matches if its path is the target or ends with it at a directory: every tail of a path is a key.
    tails = files.select("package", "version", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), k, F.size(F.split("path", "/"))), "/"))).alias("target")).distinct()
    missing = target.join(tails, ["package", "version", "target"], "left_anti")
    absent = schema.findings(missing, "install-scripts", "Medium", "InstallScript", F.concat(F.lit('"'), "hook", F.lit('" script references missing file: '), "target"), "a script's file isn't in the package", F.lit("package.json"), None, text.truncate(body, 100), F.col("at") + 1)
    return present.unionByName(absent)


def advisories(packages: DataFrame, known: DataFrame) -> DataFrame:
    """``packages``: package, version; ``known``: package, version, id, summary, details, scores."""
    hit = packages.select("package", "version").join(known, ["package", "version"])
    summary = F.coalesce("summary", "details", F.lit("No description available"))
    return schema.findings(hit, "advisories", names.cvss_severity(F.col("scores")), "KnownVulnerability", F.concat("id", F.lit(": "), text.truncate_bytes(summary, 80)), summary)


def chosen_refs(packages: DataFrame, refs: DataFrame) -> DataFrame:
    """The first ref of each package version that exists: v<version>, <version>, else HEAD. ``refs``:
    repo, ref."""
    tried = packages.select("package", "version", "repo", F.posexplode(F.array(F.concat(F.lit("v"), "version"), F.col("version"), F.lit("HEAD"))).alias("rank", "ref"))
    return tried.where(names.safe_ref(F.col("ref"))).join(refs, ["repo", "ref"]).groupBy("package", "version", "repo").agg(F.min_by("ref", "rank").alias("ref"))


#: Paths that a finding lists.
LISTED = 20


def provenance(packages: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """``packages``: package, version, repository, attested; ``tree``: repo (owner/name), ref, path,
    type, truncated. Scripts of a package that its source tree lacks, build output apart."""
    at = packages.withColumn("r", names.repository(F.col("repository"))).withColumn("repo", F.concat("r.owner", F.lit("/"), "r.repo"))
    # Addresses are read once a package, not for each filter on them and for each row that packages are made from.
    at = storage.stored(at.select("package", "version", "attested", "repo"), "sources")
    new = lambda df, severity, title, seq, **k: schema.findings(df, "provenance", severity, "Provenance", title, k.pop("description", "source of the package"), seq=seq, **k)
    refs = tree.groupBy("repo", "ref").agg(F.max("truncated").alias("truncated"))
    found = chosen_refs(at.where("repo is not null"), refs).join(refs, ["repo", "ref"])
    lower, ext = F.lower("path"), F.substring_index("path", ".", -1)
    expected = lower.rlike(r"^(dist|build|lib|out|cjs|esm|umd|es|module|_cjs|_esm)/") | lower.rlike(r"\.(min|bundle)\.js$")
    ours = files.where(ext.isin("js", "mjs", "cjs", "ts") & ~expected).join(found.select("package", "version", "repo", "ref"), ["package", "version"])
    alien = ours.join(tree.where("type = 'blob'").select("repo", "ref", "path"), ["repo", "ref", "path"], "left_anti")
    # A count and the first LISTED paths are kept of each package, not all of them.
    apart = alien.select("package", "version", "path").distinct()
    order = Window.partitionBy("package", "version").orderBy("path")
    first = apart.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LISTED).groupBy("package", "version").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    per = apart.groupBy("package", "version").agg(F.count("*").alias("n")).join(first, ["package", "version"])
    listed = F.concat(F.array_join(F.transform("paths", lambda p: F.concat(F.lit("  - "), p)), "\n"), F.when(F.col("n") > LISTED, F.concat(F.lit("\n  ... and "), (F.col("n") - LISTED).cast("string"), F.lit(" more"))).otherwise(""))
    return schema.union(
        [
            new(at, F.when(F.col("attested"), "Info").otherwise("Low"), F.when(F.col("attested"), "npm provenance attestation present").otherwise("No npm provenance attestation"), 0),
            new(at.where("repo is null and not attested"), "High", "No provenance attestation and no repository URL", 1),
            new(at.where("repo is not null").join(refs, "repo", "left_anti"), "Medium", "Repository URL not accessible", 2),
            new(per, "Critical", F.concat(F.col("n").cast("string"), F.lit(" JS file(s) in npm tarball not found in GitHub source")), 3, file=F.get("paths", F.lit(0)), description=listed),
            new(found.where("truncated"), "Info", "GitHub tree response was truncated", 4),
        ]
    )
