"""Findings from two versions of a package, and from its tree of dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import names, storage, text
from siltstone.operators import patterns

_JS = r"\.(js|cjs|mjs|ts|tsx|jsx)$"
_BINARY = r"\.(node|exe|dll|so|dylib|wasm|bin)$"
_SUSPICIOUS = "payload|exploit|backdoor|keylog|stealer|malware|trojan"


def obfuscation_score(content: Column) -> Column:
    """Lines of more than 500 bytes and runs of eight escapes."""
    return F.size(F.filter(text.lines(content), lambda x: F.octet_length(x) > 500)) + F.regexp_count(content, F.lit(patterns.ESCAPE_RUN))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """(package, path, old, new): contents of a path in both versions, null where it is missing."""
    a = old.select("package", "path", F.col("content").alias("old"))
    b = new.select("package", "path", F.col("content").alias("new"))
    return a.join(b, ["package", "path"], "full_outer")


def _matching(pattern: str):
    return lambda x: x["raw"].rlike(pattern)


def newly(pairs: DataFrame) -> DataFrame:
    """(package, path, i, severity, category, title, line, raw): patterns that the new content of a
    script matches and the old one doesn't, with the first line that matches."""
    code = pairs.where(F.lower("path").rlike(_JS) & F.col("new").isNotNull()).withColumn("old", F.coalesce("old", F.lit("")))
    rows = text.lines(F.col("new"))
    hits = []
    for i, (severity, category, pattern, title) in enumerate(patterns.NEWLY):
        first = F.get(F.filter(F.transform(rows, lambda x, k: F.struct((k + 1).alias("line"), x.alias("raw"))), _matching(pattern)), F.lit(0))
        hits.append(F.when(F.col("new").rlike(pattern) & ~F.col("old").rlike(pattern), F.struct(F.lit(i).alias("i"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(title).alias("title"), first.alias("at"))))
    return code.select("package", "path", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("package", "path", "h.i", "h.severity", "h.category", "h.title", "h.at.line", "h.at.raw")


def totals(pairs: DataFrame) -> DataFrame:
    """(package, old_size, new_size, added, removed, modified, old_score, new_score)."""
    js = F.lower("path").rlike(_JS)
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    score = lambda c: F.coalesce(F.sum(F.when(js, obfuscation_score(F.col(c)))), F.lit(0))
    return pairs.groupBy("package").agg(
        size("old").alias("old_size"), size("new").alias("new_size"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("modified"), score("old").alias("old_score"), score("new").alias("new_score")
    )


def diff(old: DataFrame, new: DataFrame, versions: DataFrame) -> DataFrame:
    """``old`` and ``new``: package, path, content; ``versions``: package, old_version, new_version."""
    v = versions.select("package", "old_version", F.col("new_version").alias("version"))
    pairs = paired(old, new)
    with_version = lambda df: df.join(v, "package")
    made = lambda df, severity, category, title, seq, **k: schema.findings(with_version(df), "diff", severity, category, title, k.pop("description", F.concat(F.lit("Changed from "), "old_version", F.lit(" to "), "version")), seq=seq, **k)
    added = pairs.where("old is null")
    path = F.col("path")
    found = newly(pairs)
    sums = totals(pairs)
    manifest = lambda df: df.where("path = 'package.json'").select("package", F.from_json("content", "scripts map<string,string>, dependencies map<string,string>").alias("m"))
    empty = F.create_map().cast("map<string,string>")
    both = manifest(new).join(manifest(old).withColumnRenamed("m", "o"), "package", "left").select("package", F.coalesce("m.scripts", empty).alias("s"), F.coalesce("o.scripts", empty).alias("os"), F.coalesce("m.dependencies", empty).alias("d"), F.coalesce("o.dependencies", empty).alias("od"))
    hooks = ["preinstall", "postinstall", "preuninstall", "postuninstall"]
    scripts = both.select("package", F.explode(F.map_filter("s", lambda k, x: k.isin(hooks) & x.isNotNull() & ~F.map_contains_key(F.col("os"), k))).alias("hook", "body"))
    deps = both.select("package", F.explode(F.map_filter("d", lambda k, x: ~F.map_contains_key(F.col("od"), k))).alias("dep", "spec"))
    shrink = (F.col("old_size") - F.col("new_size")) / F.col("old_size") * 100
    changes = F.col("added") + F.col("removed") + F.col("modified")
    return schema.union(
        [
            made(added, "Low", "Suspicious", "New file added between versions", 0, file=path),
            made(added.where(F.lower(text.basename(path)).rlike(_SUSPICIOUS)), "High", "Suspicious", "New file with suspicious name", 1, file=path),
            made(added.where(F.lower("path").rlike(_BINARY)), "Medium", "Suspicious", "New binary file added", 2, file=path),
            made(found, F.col("severity"), F.col("category"), F.col("title"), F.col("i") + 10, file=path, line=F.col("line"), snippet=text.truncate(F.col("raw"), 120)),
            made(scripts, "Critical", "InstallScript", F.concat(F.lit("New '"), "hook", F.lit("' script added between versions")), 20, file=F.lit("package.json"), snippet=text.truncate(F.col("body"), 120)),
            made(deps, "High", "Suspicious", "New dependency added between versions", 21, file=F.lit("package.json"), description=F.concat("dep", F.lit("@"), F.coalesce("spec", F.lit("?")))),
            made(sums.where("new_score > old_score + 5"), "Medium", "Obfuscation", "Significant increase in obfuscated/minified code", 22),
            made(sums.where((F.col("old_size") > 0) & (F.col("removed") > 0)).where(shrink > 30), "Medium", "Suspicious", "Significant decrease in package size", 23),
            made(sums.join(versions, "package").where((names.bump(F.col("old_version"), F.col("new_version")) == "patch") & (changes > 10)).select("package"), "Low", "Suspicious", "Patch version with many changes", 24),
        ]
    )


#: Packages counted in a tree, levels below the root, size from which a tree is large.
MOST_PACKAGES, MOST_DEPTH, LARGE_TREE = 200, 3, 100


def resolve(specs: DataFrame, versions: DataFrame) -> DataFrame:
    """``specs`` (with name and spec) with the version that each names: the stripped spec if it is
    published, else the latest tag, else the largest version. ``versions``: package, version, latest."""
    exact = versions.select(F.col("package").alias("name"), F.col("version").alias("wanted")).distinct().withColumn("exact", F.col("wanted"))
    other = versions.groupBy(F.col("package").alias("name")).agg(F.coalesce(F.max(F.when(F.col("latest"), F.col("version"))), F.max("version")).alias("fallback"))
    asked = specs.withColumn("wanted", names.strip_range(F.btrim("spec")))
    return asked.join(sorted_side(exact), ["name", "wanted"], "left").join(sorted_side(other), "name", "left").withColumn("resolved", F.coalesce("exact", "fallback")).drop("wanted", "exact", "fallback")


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that grows with the packages: it is never broadcast, whatever its files' size makes Spark expect."""
    return df.hint("merge")


def tree(roots: DataFrame, dependencies: DataFrame, versions: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(root, name, spec, resolved, depth, place, kids): each name and spec that a root reaches, at its least depth.

    ``roots``: root, spec; ``dependencies``: package, version, dep, spec. Each dependency is resolved once, before any root
    reaches it. One join a level, against the
    frontier only; what was seen is left out by an anti join, so diamonds don't multiply. Each level is written once.
    ``place`` is the place of the parent followed by the dependency's own, by name and specifier, so within a depth
    it orders packages as a queue would take them; of several parents the first counts. ``kids``: dependencies that would be queued."""
    nth = Window.partitionBy("package", "version").orderBy("dep", "spec")
    numbered = storage.stored(dependencies.select("package", "version", "dep", "spec").distinct().withColumn("nth", F.row_number().over(nth)), "dependencies")
    kids = numbered.groupBy(F.col("package").alias("name"), F.col("version").alias("resolved")).agg(F.max("nth").alias("kids"))
    counted = lambda specs: resolve(specs, versions).join(sorted_side(kids), ["name", "resolved"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    targets = counted(numbered.select(F.col("dep").alias("name"), "spec").distinct()).select(F.col("name").alias("dep"), "spec", "resolved", "kids")
    # Specifiers may be null, and then name the fallback.
    same = (F.col("d.dep").eqNullSafe(F.col("t.dep"))) & (F.col("d.spec").eqNullSafe(F.col("t.spec")))
    listed = storage.stored(numbered.alias("d").join(sorted_side(targets).alias("t"), same, "left").select("package", "version", "d.dep", "d.spec", "nth", F.col("resolved").alias("to"), F.col("kids").alias("to_kids")), "resolved")
    columns = ["root", "name", "spec", "resolved", "depth", "place", "kids"]
    level = storage.stored(counted(roots.select("root", F.col("root").alias("name"), "spec").distinct()).withColumns({"depth": F.lit(0), "place": F.array().cast("array<int>")}).select(columns), "level")
    seen = level
    for d in range(1, depth + 1):
        step = level.select("root", F.col("name").alias("package"), F.col("resolved").alias("version"), "place").join(sorted_side(listed), ["package", "version"]).select("root", F.col("dep").alias("name"), "spec", F.struct(F.concat("place", F.array("nth")).alias("place"), "to", "to_kids").alias("at"))
        first = step.join(sorted_side(seen.select("root", "name", "spec")), ["root", "name", "spec"], "left_anti").groupBy("root", "name", "spec").agg(F.min("at").alias("at"))
        level = storage.stored(first.select("root", "name", "spec", F.col("at.to").alias("resolved"), F.lit(d).alias("depth"), F.col("at.place").alias("place"), F.col("at.to_kids").alias("kids")), "level")
        seen = seen.unionByName(level)
    return seen.withColumn("kids", F.when(F.col("depth") < depth, F.col("kids")).otherwise(0))


def queued(roots: DataFrame, dependencies: DataFrame, versions: DataFrame, warned: DataFrame, most: int = MOST_PACKAGES, depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` packages of each root's tree in the order of a queue, as (told, counts) for ``tree_findings``.

    A package (a name and a specifier) is a number in the order of names and specifiers, odd if it is ``warned`` of. A root's
    first level is its own lists, and each other level brings it the whole lists of its frontier, a row for each package there; one after
    the other they are the queue. What was
    seen is left out within the root's row, and since what a queue holds beyond ``most`` is never looked at, a row has no more than that."""
    each = dependencies.select(F.col("dep").alias("name"), "spec", F.lit(True).alias("needed"), F.lit(False).alias("rooted")).unionByName(roots.select(F.col("root").alias("name"), "spec", F.lit(False).alias("needed"), F.lit(True).alias("rooted")))
    asked = each.groupBy("name", "spec").agg(F.max("needed").alias("needed"), F.max("rooted").alias("rooted"))
    warnings = warned.groupBy("name", "resolved").agg(F.collect_list(F.struct("kind", "more")).alias("warnings"))
    known = resolve(asked, versions).join(sorted_side(warnings), ["name", "resolved"], "left").orderBy("name", "spec")
    known = storage.stored(known.select((F.monotonically_increasing_id() * 2 + F.col("warnings").isNotNull().cast("int")).alias("id"), "name", "spec", "resolved", "warnings", "needed", "rooted"), "packages")
    # Specifiers may be null, and then name the fallback.
    same = F.col("d.dep").eqNullSafe(F.col("k.name")) & F.col("d.spec").eqNullSafe(F.col("k.spec"))
    numbered = dependencies.alias("d").join(sorted_side(known.where("needed").select("id", "name", "spec")).alias("k"), same)
    # Dealt out by what they are grouped by, or each would first be made a list of its own.
    listed = numbered.select("package", "version", "id").repartition("package", "version").groupBy(F.col("package").alias("name"), F.col("version").alias("resolved")).agg(F.array_distinct(F.sort_array(F.collect_list("id"))).alias("kids"))
    lists = storage.stored(known.select("id", "name", "resolved", "needed", "rooted").join(sorted_side(listed), ["name", "resolved"], "left").where("rooted or kids is not null").select("id", F.when(F.col("rooted"), F.col("name")).alias("root"), F.coalesce("kids", F.array().cast("array<bigint>")).alias("kids"), "needed", "rooted"), "lists")
    # A root's own rows have what is below it. What no package depends on is looked up for no other level.
    own = lists.where("rooted").repartition("root").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("id", "kids"))).alias("own"))
    new = own.select("root", F.col("own")["id"].alias("seen"), F.array(F.size("own")).alias("ends"), F.lit(False).alias("stopped"), F.flatten(F.col("own")["kids"]).alias("queue"))
    # The root is what was seen first, and its least number is the tree's; ends are the sizes of what was seen after each level,
    # stopped is whether the queue still held any.
    state = new.drop("queue")
    tree, counted = F.get("seen", F.lit(0)), F.size("seen") - F.get("ends", F.lit(0))
    for d in range(1, depth + 1):
        if d > 1:
            level = F.slice("seen", F.try_element_at("ends", F.lit(-2)) + 1, F.size("seen"))
            step = state.select(tree.alias("tree"), F.posexplode(level).alias("pos", "id")).join(sorted_side(lists.where("needed").select("id", "kids")), "id").select("tree", "pos", "kids")
            queue = step.repartition("tree").groupBy("tree").agg(F.flatten(F.sort_array(F.collect_list(F.struct("pos", "kids")))["kids"]).alias("queue"))
            new = state.join(sorted_side(queue), tree == F.col("tree"), "left").withColumn("queue", F.coalesce("queue", F.array().cast("array<bigint>")))
        new = new.withColumn("room", F.lit(most) - counted).withColumn("next", F.slice(F.array_except("queue", "seen"), F.lit(1), F.col("room")))
        # The last that fits may come again, and anything may come after it.
        after = F.array_position("queue", F.try_element_at("next", F.lit(-1))) < F.size("queue")
        stopped = F.col("stopped") | F.when(F.col("room") == 0, F.size("queue") > 0).otherwise((F.col("room") == F.size("next")) & after)
        state = storage.stored(new.select("root", F.concat("seen", "next").alias("seen"), F.concat("ends", F.array(F.size("seen") + F.size("next"))).alias("ends"), stopped.alias("stopped")), "trees")
    first = F.get("ends", F.lit(0))
    each = state.select("root", "ends", F.posexplode("seen").alias("pos", "id")).where((F.col("id") % 2 == 1) & (F.col("pos") >= first))
    ranked = each.select("id", "root", (F.col("pos") - first + 1).alias("rank"), F.size(F.filter("ends", lambda end: end <= F.col("pos"))).alias("depth"))
    told = ranked.join(sorted_side(known.where("warnings is not null").select("id", "name", "resolved", "warnings")), "id").select("root", "rank", "depth", "name", "resolved", F.inline("warnings"))
    return told, state.select("root", counted.alias("n"), "stopped")


def warned_of(versions: DataFrame, scripts: DataFrame, now: Column) -> DataFrame:
    """(name, resolved, kind, more): a row for each thing that a published version is warned of, so that what is counted moves once."""
    age = names.rough_day(F.date_format(now, "yyyy-MM-dd")) - names.rough_day(F.col("created_ts"))
    at_version = [F.col("package").alias("name"), F.col("version").alias("resolved")]
    return (
        scripts.where(F.col("hook").isin("preinstall", "install", "postinstall")).select(*at_version).distinct().select("*", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("more"))
        .unionByName(versions.where("deprecated is not null").select(*at_version, F.lit(1).alias("kind"), F.col("deprecated").alias("more")))
        .unionByName(versions.where((F.col("n_versions") <= 1) & (age < 7)).select(*at_version, F.lit(2).alias("kind"), F.col("created_ts").cast("string").alias("more")))
    )


def tree_findings(told: DataFrame, counts: DataFrame) -> DataFrame:
    """``told``: root, rank, depth, name, resolved, kind, more; ``counts``: root, n, stopped."""
    label = F.concat("name", F.lit("@"), "resolved")
    where = F.concat(F.lit("Package "), F.col("rank").cast("string"), F.lit(" of the tree, at depth "), F.col("depth").cast("string"))
    new = lambda df, severity, title, seq, about: schema.findings(df.select(F.col("root").alias("package"), F.lit(None).cast("string").alias("version"), *[c for c in df.columns if c not in ("root", "package", "version")]), "dependencies", severity, "DependencyRisk", title, about, seq=seq)
    kind = F.col("kind")
    title = F.concat(F.when(kind == 0, "Transitive dependency has install scripts: ").when(kind == 1, "Transitive dependency is deprecated: ").otherwise("Transitive dependency is very new: "), label)
    what = F.when(kind == 0, where).when(kind == 1, F.concat(where, F.lit(": "), "more")).otherwise(F.concat(where, F.lit(", first published "), "more"))
    return schema.union(
        [
            new(told, F.when(kind == 1, "Medium").otherwise("High"), title, F.col("rank") * 10 + kind, what),
            new(counts.where("stopped"), "Low", "Dependency tree scan limit reached", 1_000_000, F.concat(F.lit("Only the first "), F.col("n").cast("string"), F.lit(" packages were looked at"))),
            new(counts.where(F.col("n") > LARGE_TREE), "Low", F.concat(F.lit("Large transitive dependency tree: "), F.col("n").cast("string"), F.lit(" packages")), 1_000_001, "Each of them is code that runs with this package"),
        ]
    )


def deep_risks(roots: DataFrame, dependencies: DataFrame, versions: DataFrame, scripts: DataFrame, now: Column, most: int = MOST_PACKAGES) -> DataFrame:
    """``dependency_risks`` of the whole trees of ``roots``, without making what lies beyond a tree's first ``most`` packages."""
    return tree_findings(*queued(roots, dependencies, versions, warned_of(versions, scripts, now), most))


def dependency_risks(found: DataFrame, versions: DataFrame, scripts: DataFrame, now: Column, most: int = MOST_PACKAGES) -> DataFrame:
    """Findings for a ``tree``; ``versions``: package, version, deprecated, created_ts, n_versions;
    ``scripts``: package, version, hook. A tree's first ``most`` packages count, in the order of a queue. The limit is
    reached if anything is still queued then, even what was seen before."""
    order = Window.partitionBy("root").orderBy("depth", "place")
    inner = found.where("depth > 0").withColumn("rank", F.row_number().over(order))
    kept = storage.stored(inner.where(F.col("rank") <= most), "counted")
    at = F.struct("depth", "place")
    # The last that was queued: the last dependency of a counted package, or of the root.
    last = F.max(F.when(F.col("kids") > 0, F.struct((F.col("depth") + 1).alias("depth"), F.concat("place", F.array("kids")).alias("place"))))
    ends = kept.select("root", "rank", "depth", "place", "kids").unionByName(found.where("depth = 0").select("root", F.lit(0).alias("rank"), "depth", "place", "kids"))
    counts = ends.groupBy("root").agg(F.max("rank").alias("n"), F.max(F.when(F.col("rank") == most, at)).alias("stop"), last.alias("last"))
    told = kept.join(sorted_side(warned_of(versions, scripts, now)), ["name", "resolved"])
    return tree_findings(told, counts.withColumn("stopped", F.col("last") > F.col("stop")))
