import json

import pytest

from stratalens.sources import records as R
from stratalens.sources import sinks as S


def test_shell_and_selection(spark):
    text = "cat -n src/a.py # why\nls -R data\ngrep -rn TODO src/b.py src/\nrm x.py\n  head -5 c.md\ncatalog x\n"
    t = spark.createDataFrame([("t1", False, "Fix the bug in the script", text), ("t2", True, None, "cat a.py"), ("t3", False, "bake bread", text)], "id string, has_repo boolean, instruction string, text string")
    got = [(r["tool"], r["path"], r["args"]) for r in R.shell_commands(t.where("id = 't1'")).orderBy("line_no").collect()]
    assert got == [("cat", "src/a.py", None), ("ls", None, "-R data"), ("grep", None, "-rn TODO src/b.py src/"), ("head", "c.md", None)]
    out = {r["id"]: (r["selected"], r["reason"]) for r in R.select_tasks(t, (".py",), "bug|script").collect()}
    assert out == {"t1": (True, "selected: 2 source files read"), "t2": (False, "too few source files read: 1"), "t3": (False, "no code signal")}


def test_json_sources(spark, tmp_path):
    bodies = [{"messages": [{"role": "user", "content": "hi"}]}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "tool_result", "tool_use_id": "x", "content": "b"}]}]}]
    (tmp_path / "t.json").write_text(json.dumps(bodies))
    m = R.messages(R.trajectories(spark, str(tmp_path / "t.json"))).orderBy("turn").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in m] == [(0, "user", "hi"), (1, "user", "a\nb")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1.json").write_text(json.dumps({"id": "q", "control": True, "treatment": False}))
    assert [tuple(r)[:3] for r in R.verdicts(spark, str(tmp_path / "v")).collect()] == [("q", True, False)]
    good = {"id": "a", "type": "trace", "q": "?", "files": ["x"], "key": "k"}
    (tmp_path / "b.json").write_text(json.dumps([good, {**good, "id": "b", "files": []}, {**good, "id": "c", "type": "odd"}, {**good, "id": "d", "q": ""}]))
    assert {r["id"] for r in R.flaws(R.battery(spark, str(tmp_path / "b.json"))).collect()} == {"b", "c", "d"}


def test_settings():
    assert R.settings("[index]\nthreshold = 75\n").threshold == 75 and R.settings("").threshold == 50
    with pytest.raises(ValueError):
        R.settings("[index")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"{tmp_path}/a.key.md", "x\nrefreshed: 1\n"), (f"{tmp_path}/../out.md", "y")], "target string, text string")
    state = lambda d: {r["target"][-8:]: r["state"] for r in S.write_sidecars(d, str(tmp_path)).collect()}
    assert state(df) == {"a.key.md": "written", "./out.md": "refused"}
    again = df.selectExpr("target", "replace(text, '1', '2') AS text")
    assert state(again)["a.key.md"] == "kept" and (tmp_path / "a.key.md").read_text() == "x\nrefreshed: 1\n"
    rows = spark.createDataFrame([(1, 5, 6)], "turn_id int, tokens_in_est int, tokens_out int")
    S.append_ledger(rows, None)
    S.append_ledger(rows, str(tmp_path / "l"))
    S.append_ledger(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    S.write_index({"files": rows}, str(tmp_path / "i"))
    assert S.read_index(spark, str(tmp_path / "i"), ("files",))["files"].count() == 1
    scope = spark.createDataFrame([("src\\a.py",), ("doc/b",)], "path string")
    assert [r["path"] for r in R.in_scope(scope, ["src/"]).collect()] == ["src\\a.py"]


def test_manifest_of_selected_tasks(spark, tmp_path):
    from stratalens.sources import sinks

    sinks.write_manifest(spark.createDataFrame([("b", 2), ("a", None)], "id string, n int"), f"file://{tmp_path}/m")
    sinks.write_manifest(spark.createDataFrame([("b", 2), ("a", None)], "id string, n int"), f"file://{tmp_path}/m")
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/m").orderBy("id").select("id", "n").collect()] == [("a", None), ("b", 2)]
