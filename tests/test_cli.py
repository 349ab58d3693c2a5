from __future__ import annotations

import json

from velith import cli


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "BUrlG.txt").write_text("§ 1 Leave\nEvery worker has a claim to paid leave. It is due each year.", encoding="utf-8")
    for k, text in enumerate(["Nothing of the kind. Rain falls on the roof.", "Snow lies on the hill.", "Wind goes round the house."]):
        (folder / f"other{k}.txt").write_text(text, encoding="utf-8")

    def run(*args):
        capsys.readouterr()
        assert cli.main(["--base", str(tmp_path / "kb"), *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("ingest", str(folder), "--strategy", "sentence", "fixed") == [{"seen": 4, "new": 4, "changed": 0, "skipped": 0, "pages": 4, "chunks": 8, "failures": 0}]
    assert run("embed")[0]["embedded"] == 8
    assert {r["strategy"]: r["embedded"] for r in run("stats")} == {"fixed": 4, "sentence": 4}
    assert run("search", "claim to paid leave")[0]["doc_id"] == "burlg"
    answer = run("ask", "Is there a claim to paid leave?")[0]
    assert answer["sources"][0]["doc_id"] == "burlg" or answer["refused"]
    run("delete", "other0", "other1")
    assert {r["documents"] for r in run("stats")} == {2}
