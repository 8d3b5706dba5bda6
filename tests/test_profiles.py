"""Inheritance of profiles on known cases."""

from waymark.operators import profiles
from waymark.operators.profiles import inherited


def test_elements_override_their_parents(spark):
    rows = [("base", None, [1, 2, 3]), ("mid", "base", [10]), ("leaf", "mid", [100, 200]), ("ring", "other", [5]), ("other", "ring", []), ("lost", "nowhere", [7]), ("below", "lost", [8]), ("alone", None, []), ("self", "self", [1])]
    values, issues = inherited(spark.createDataFrame(rows, "name string, parent string, values array<long>"))
    found = {}
    for r in values.collect():
        found.setdefault(r["name"], {})[r["at"]] = r["value"]
    assert {n: [v[k] for k in sorted(v)] for n, v in found.items()} == {"base": [1, 2, 3], "mid": [10, 2, 3], "leaf": [100, 200, 3]}
    assert {r["name"]: r["issue"] for r in issues.collect()} == {"ring": "Cycle", "other": "Cycle", "self": "Cycle", "lost": "Missing", "below": "Missing"}
    values, issues = inherited(spark.createDataFrame([], "name string, parent string, values array<long>"))
    assert values.count() == issues.count() == 0


def test_rings_take_no_more_rows_than_profiles(spark, monkeypatch):
    rows = [(k, None if k % 50 == 0 else k - 1, [k]) for k in range(200)] + [(k, k - 2 if k % 3 == 2 else k + 1, [k, k]) for k in range(300, 600)]
    rows += [(1000 + k, 1000 + k - 1 if k else 1099, [1]) for k in range(100)]
    written = []
    real = profiles.checkpoint

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(profiles, "checkpoint", counted)
    values, issues = inherited(spark.createDataFrame(rows, "name long, parent long, values array<long>"))
    assert {(r["name"], r["at"], r["value"]) for r in values.collect()} == {(k, 0, k) for k in range(200)}
    assert {(r["name"], r["issue"]) for r in issues.collect()} == {(k, "Cycle") for k in [*range(300, 600), *range(1000, 1100)]}
    assert max(written) <= len(rows)
