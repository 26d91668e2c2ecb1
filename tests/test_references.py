import random

from filament.operators import references as refs
from filament.operators.references import Reference, Target, orphan_counts, orphan_references

T = "id_namespace string, local_id string, load_no int, removed_load_no int, extra string"
R = "row_id long, load_no int, ns string, key string, label string, n int"


def make(spark, rows, targets):
    target = Target("t", spark.createDataFrame(targets, T), "local_id", "id_namespace")
    return [Reference("r", spark.createDataFrame(rows, R), "key", target, "ns")]


def brute_force(rows, targets):
    fold = lambda x: None if x is None else x.strip().lower()
    out = []
    for row_id, load, ns, key, *_ in rows:
        if key is None or not key.strip():
            continue
        hit = any(ns is not None and fold(ns) == fold(tns) and fold(key) == fold(tk) and tk.strip() and load is not None and since <= load and (until is None or until > load) for tns, tk, since, until, _ in targets if tns is not None and tk is not None)
        if not hit:
            out.append(("r", "key", load, row_id))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(refs, "HEAVY_SHARE", 0.01)
    r = random.Random(3)
    keys = ["A", "b", "C ", "\td", "E", " ", "", None]
    targets = [(r.choice(["n", "N ", "m", None]), r.choice(keys), r.randint(1, 4), r.choice([None, 2, 4]), "x") for _ in range(25)]
    rows = [(i, r.choice([1, 2, 3, 5, None]), r.choice(["n", "m ", None]), r.choice([k for k in keys if k] + ["hot"] * 8), "c", 1) for i in range(3000)]
    rows += [(9000, 1, "n", None, "c", 1), (9001, 1, "n", "  ", "c", 1), (9002, 1, "n", "zz", "c", 1), (9002, 1, "n", "zz", "c", 1)]
    found = sorted((tuple(x) for x in orphan_references(make(spark, rows, targets)).collect()), key=str)
    expected = brute_force(rows, targets)
    assert found == expected and any(x[3] == 9002 for x in found)
    counts = {tuple(x)[2]: x.orphan_references for x in orphan_counts(make(spark, rows, targets)).collect()}
    for load in (1, 2, 3, 5, None):
        assert counts.get(load, 0) == sum(x[2] == load for x in expected)


def test_heavy_keys_without_load(spark, monkeypatch):
    rows = [(i, None, "n", "hot", "c", 1) for i in range(30)] + [(100 + i, 1, "n", "hot", "c", 1) for i in range(30)] + [(200 + i, None, None, "hot", "c", 1) for i in range(30)]
    rows += [(300 + i, load, "n", "known", "c", 1) for i in range(30) for load in (1, None)] + [(400, None, "n", "rare", "c", 1)]
    targets = [("n", "known", 1, None, "x")]
    expected = brute_force(rows, targets)
    assert len(expected) == 121
    for least in (5, 1_000):
        monkeypatch.setattr(refs, "HEAVY_LEAST", least)
        refers = make(spark, rows, targets)
        assert sorted((tuple(x) for x in orphan_references(refers).collect()), key=str) == expected
        assert sum(x.orphan_references for x in orphan_counts(refers).collect()) == len(expected)


def test_empty_tables(spark):
    rows = [(1, 1, "n", "k", "c", 1)]
    assert orphan_references(make(spark, [], [("n", "k", 1, None, "x")])).count() == 0
    assert [tuple(x) for x in orphan_references(make(spark, rows, [])).collect()] == [("r", "key", 1, 1)]
