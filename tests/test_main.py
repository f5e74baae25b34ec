"""The command line, over tables in a folder."""

import json

import pytest

from siltstone import __main__ as command


@pytest.fixture
def folder(spark, tmp_path):
    files = [("p", "1.0.0", "index.js", "const k = process.env.K;\nfetch(u + k);\neval(k);"), ("q", "2.0.0", "index.js", "module.exports = 1;")]
    spark.createDataFrame(files, "package string, version string, path string, content string").write.parquet(f"{tmp_path}/t/files.parquet")
    spark.createDataFrame([f[:2] for f in files], "package string, version string").write.parquet(f"{tmp_path}/t/packages.parquet")
    return tmp_path


def test_commands(spark, folder, capsys):
    t, kept = f"{folder}/t", f"{folder}/cache"
    assert command.main(["scan", t, "--cache", kept]) == 1
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert [(x[0], x[-1]) for x in lines] == [("p", "Critical"), ("q", "Clean")]
    assert command.main(["scan", t, "--cache", kept, "--package", "q"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["q"]
    assert command.main(["check", t, "--package", "p@1.0.0", "--format", "sarif", "--out", f"{folder}/sarif"]) == 1
    document = json.loads("".join(p.read_text() for p in sorted((folder / "sarif").glob("part-*"))))
    assert {r["id"] for r in document["runs"][0]["tool"]["driver"]["rules"]} >= {"siltstone/code-execution", "siltstone/data-flow"}
    assert command.main(["check", t, "--package", "q"]) == 0
    assert capsys.readouterr().out == "q@2.0.0 CLEAN\n"
    (folder / "ignore").write_text("# none of it\ncritical\nhigh\nlow\n")
    assert command.main(["gate", t, "--ignore", f"{folder}/ignore"]) == 0
    assert [x.split("\t")[-1] for x in capsys.readouterr().out.splitlines()] == ["True", "True"]
    assert command.main(["cache", "prune", kept]) == 0 and command.main(["cache", "clear", kept]) == 0
    assert capsys.readouterr().out == "cleared\n"
    with pytest.raises(Exception, match="packages"):
        command.main(["scan", f"{folder}/none"])
