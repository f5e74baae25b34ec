"""Scalar functions on fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import names, text
from siltstone.functions.comments import stripped_content
from siltstone.plans import report


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (["var x = 1; // eval(y)"], ["var x = 1; "]),
        (["a /* b */ c"], ["a  c"]),
        (["a /* b", "c */ d", "e"], ["a ", " d", "e"]),
        (['s = "// no"; t'], ['s = "// no"; t']),
        (["s = '/* no */'"], ["s = '/* no */'"]),
        (["`http://x` // y"], ["`http://x` "]),
        ([r'"a\"// b" // c'], [r'"a\"// b" ']),
        (["'open // kept", "x // cut"], ["'open // kept", "x "]),
        (["/* a */ b /* c", "*/ d // e"], [" b ", " d "]),
        (["a / b * c"], ["a / b * c"]),
        ([""], [""]),
        ([r"a \" // kept", "b"], [r"a \" // kept", "b"]),
        (["'ends \\\\' // cut", "'open \\"], ["'ends \\\\' ", "'open \\"]),
        (["/* never", "ends"], ["", ""]),
        (["/*/ a */ b", "`x /*", "y */ c"], [" b", "`x /*", "y */ c"]),
        (["a /* ' */ b // ' ", '"\x41" * /* " */'], ["a  b ", '"\x41" * ']),
        (["x" * 200_000 + "'" + "\\x41" * 50_000 + "' // c"], ["x" * 200_000 + "'" + "\\x41" * 50_000 + "' "]),
        (["/*" + "\n".join(["no"] * 3000) + "*/ yes"], ["\n" * 2999 + " yes"]),
    ],
)
def test_comments(spark, rows, want):
    assert one(spark, stripped_content(F.lit("\n".join(rows)))) == "\n".join(want)


def slow_strip(content):
    """Character by character, with the state that a line leaves to the next one."""
    out, inside = [], False
    for row in content.split("\n"):
        kept, i = "", 0
        while i < len(row):
            if inside:
                inside = row[i : i + 2] != "*/"
                i += 1 if inside else 2
            elif row[i] in "\"'`":
                quote, j = row[i], i + 1
                while j < len(row) and row[j] != quote:
                    j += 2 if row[j] == "\\" else 1
                kept, i = kept + row[i : j + 1], j + 1
            elif row[i : i + 2] == "//":
                break
            elif row[i : i + 2] == "/*":
                inside, i = True, i + 2
            else:
                kept, i = kept + row[i], i + 1
        out.append(kept)
    return "\n".join(out)


def test_comments_of_random_contents(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["/", "*", "//", "/*", "*/", '"', "'", "`", "\\", "\n", "a", " é", "\\\n"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", stripped_content(F.col("t")).alias("x")).collect():
        assert r["x"] == slow_strip(texts[r["i"]]), repr(texts[r["i"]])


def test_levenshtein(spark):
    for a, b, d in [("react", "react", 0), ("react", "reakt", 1), ("lodash", "lodasg", 1), ("axos", "axios", 1)]:
        assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == d


def test_entropy(spark):
    assert one(spark, text.byte_entropy(F.lit("aaaaaaaaaa"))) == 0
    assert one(spark, text.byte_entropy(F.lit("aB3$xZ9!qW7@mK2&"))) > 3
    assert one(spark, text.byte_entropy(F.lit("ab"))) == 1
    df = spark.createDataFrame([(bytes(range(256)),), (bytes(100),), (b"",), (None,)], "b binary")
    assert [r[0] for r in df.select(text.byte_entropy("b")).collect()] == [8, 0, 0, 0]


@pytest.mark.parametrize(("spec", "name", "version"), [("axios", "axios", None), ("axios@1.7.0", "axios", "1.7.0"), ("@scope/pkg", "@scope/pkg", None), ("@scope/pkg@1.0.0", "@scope/pkg", "1.0.0")])
def test_specs(spark, spec, name, version):
    assert one(spark, names.spec_name(F.lit(spec))) == name
    assert one(spark, names.spec_version(F.lit(spec))) == version


@pytest.mark.parametrize(("spec", "want"), [("^4.18.0", "4.18.0"), ("~1.2.3", "1.2.3"), ("*", None), (">=1.0.0 <2.0.0", None), ("1.0.0", "1.0.0")])
def test_ranges(spark, spec, want):
    assert one(spark, names.clean_version(F.lit(spec))) == want


@pytest.mark.parametrize(("old", "new", "want"), [("1.0.0", "1.0.1", "patch"), ("1.0.0", "1.1.0", "minor"), ("1.0.0", "2.0.0", "major"), ("1.0", "2.0", "patch"), ("v1.0.0", "v2.0.0-rc", "major")])
def test_bumps(spark, old, new, want):
    assert one(spark, names.bump(F.lit(old), F.lit(new))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("git+https://github.com/user/repo.git", ("user", "repo")),
        ("https://github.com/user/repo", ("user", "repo")),
        ("git://github.com/user/repo.git", ("user", "repo")),
        ("git@github.com:user/repo.git", ("user", "repo")),
        ("github:user/repo", ("user", "repo")),
        ("user/repo", ("user", "repo")),
        ("https://gitlab.com/user/repo", None),
        ("https://github.com/../etc", None),
        ("github:user/re po", None),
    ],
)
def test_repositories(spark, url, want):
    got = one(spark, names.repository(F.lit(url)))
    assert (got and tuple(got)) == want


def test_lookalikes(spark):
    assert one(spark, names.technique(F.lit("1odash"), F.lit("lodash"))).startswith("homoglyph")
    assert one(spark, names.technique(F.lit("ex-press"), F.lit("express"))).startswith("hyphen")
    assert one(spark, names.technique(F.lit("@evil/lodash"), F.lit("lodash"))).startswith("scope")
    assert one(spark, names.technique(F.lit("axois"), F.lit("axios"))) is None


@pytest.mark.parametrize(
    ("counts", "points", "label"),
    [((0, 0, 0, 0), 0.0, "Clean"), ((1, 0, 0, 0), 3.0, "Medium"), ((10, 0, 0, 0), 10.0, "Critical"), ((0, 1, 0, 0), 1.5, "Low"), ((0, 2, 0, 0), 3.0, "Medium"), ((0, 4, 0, 0), 6.0, "High"), ((3, 0, 0, 0), 9.0, "Critical"), ((0, 0, 1, 0), 0.5, "Clean"), ((1, 1, 0, 0), 4.5, "Medium"), ((0, 0, 0, 10), 0.9999999999999999, "Clean")],
)
def test_scores(spark, counts, points, label):
    c = report.score(*map(F.lit, counts))
    assert one(spark, c) == points
    assert one(spark, report.label(c)) == label


def test_cvss(spark):
    for score, kind, want in [("9.8", None, "Critical"), ("7.0", None, "High"), ("CVSS:3.1/AV:N", "CVSS_V3", "Medium"), ("low", "HIGH", "High"), ("NaN", None, "Low")]:
        entry = F.array(F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(score).alias("score")))
        assert one(spark, names.cvss_severity(entry)) == want
    assert one(spark, names.cvss_severity(F.lit(None).cast("array<struct<kind: string, score: string>>"))) == "Medium"


def test_cache_key(spark):
    assert one(spark, names.cache_key(F.lit("@scope/name"), F.lit("2.0.0"))) == "@scope__name@2.0.0.json"


def test_globs():
    import re

    assert re.match(text.glob_pattern("*.min.js"), "a.min.js")
    assert not re.match(text.glob_pattern("*.js"), "a.jsx")
    assert re.match(text.glob_pattern("[ab]?.ts"), "ax.ts")
