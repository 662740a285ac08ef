"""Launch groups work out the keys of a row once."""

from seekstone.operators import catalog as C


def test_keys_of_launch_groups_are_worked_out_once(spark, monkeypatch):
    staged, stage = {}, C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    rows = [(k, f"Edit {k}", f"C:\\A{k // 2}\\x{k}.exe" if k % 5 else None, None, "desktop") for k in range(40)]
    rows += [(90, "Same", "C:\\B\\one.exe", None, "desktop"), (91, "same (x64)", "C:\\B\\two.exe", None, "portable"), (92, "Same", None, None, "desktop")]
    got = {r["id"]: r["group_id"] for r in C.launch_groups(spark.createDataFrame(rows, "id long, name string, target string, args string, source string")).collect()}
    assert {k: g for k, g in got.items() if k != g} == {91: 90}
    assert "keys" in staged and set(staged["keys"].columns) >= {"key", "role"}
