import random
import statistics

import pytest

from filament.operators import profile as profiles
from filament.operators.profile import ProfiledColumn, medians, out_of_line, profile


def test_medians_are_exact(spark):
    r = random.Random(5)
    rows, expected = [], {}
    for load in range(1, 6):
        values = [r.choice([r.randrange(10), r.randrange(10**6), r.randrange(10**15 + 1), 10**15]) for _ in range(r.randrange(1, 200))]
        rows += [(load, v, values.count(v)) for v in set(values)]
        expected[load] = float(statistics.median(values))
    got = {x.load_no: x.median for x in medians(spark.createDataFrame(rows, "load_no int, value long, n long"), ["load_no"]).collect()}
    assert got == expected


def columns(spark, text_rows, number_rows):
    t = spark.createDataFrame(text_rows, "load_no int, c string, value string, n int")
    n = spark.createDataFrame(number_rows, "load_no int, value long, c string")
    terms = spark.createDataFrame([("a",), ("b",), ("a",)], "term string")
    return [ProfiledColumn("t", t, "c", terms=terms), ProfiledColumn("n", n, "value", numeric=True)]


def test_findings(spark):
    text = [(1, "a", "x", 1)] * 8 + [(1, "b", "x", 1)] * 2 + [(3, "a", "x", 1)] * 5 + [(3, " ", "x", 1)] * 3 + [(3, None, "x", 1)] * 2
    text += [(4, "b", None, 1)] * 9 + [(4, "b ", None, 1)] + [(7, "b", None, 1)] * 100 + [(7, "A", None, 1)] * 5
    numbers = [(1, v, "x") for v in range(100)] + [(2, v * 4, "x") for v in range(100)] + [(3, v * 4, "x") for v in range(94)] + [(3, -1, "x")] * 6 + [(4, None, "x")] * 50 + [(4, 200, "x")] * 50
    p = profile(columns(spark, text, numbers)).cache()
    found = sorted((x.table_name, x.load_no, x.finding) for x in out_of_line(p).collect())
    assert found == [
        ("n", 2, "distribution"), ("n", 3, "range"), ("n", 4, "null_rate"),
        ("t", 3, "null_rate"), ("t", 4, "distribution"), ("t", 4, "null_rate"), ("t", 4, "pattern"),
    ]
    m = {(x.table_name, x.load_no): x for x in p.collect()}
    assert (m["t", 1].rows, m["t", 3].blanks, m["t", 4].distinct_values, m["n", 3].violations) == (10, 5, 2, 6)
    assert abs(m["t", 1].entropy - 0.721928) < 1e-5 and m["t", 1].shift is None and abs(m["t", 3].shift - 0.2) < 1e-9


def test_limits_are_not_reached_by_equal_shares(spark):
    text = [(1, "a", None, 1)] * 10 + [(2, "a", None, 1)] * 8 + [(2, None, None, 1)] * 2 + [(3, "a", None, 1)] * 19 + [(3, "z", None, 1)]
    assert [x.finding for x in out_of_line(profile(columns(spark, text, []))).where("load_no > 1").collect()] == []


def test_empty_and_blank_loads(spark):
    assert out_of_line(profile(columns(spark, [], []))).count() == 0
    text = [(1, None, None, 1)] * 3 + [(2, "a", None, 1)] * 3 + [(None, "a", None, 1)]
    found = [(x.load_no, x.finding) for x in out_of_line(profile(columns(spark, text, [(1, None, "x"), (2, 5, "x"), (3, 0, "x"), (4, 0, "x")]))).where("table_name = 't'").collect()]
    assert found == [(2, "null_rate")]


def test_loads_one_by_one(spark, tmp_path, monkeypatch):
    """Each load's rows are read once; the kept metrics are those of all loads at a time."""
    r = random.Random(8)
    text = [(load, r.choice(["a", "b", "c", " ", None]), "x", 1) for load in (2, 3, 5, 7, 8) for _ in range(r.randint(5, 40))]
    text += [(4, *x[1:]) for x in text if x[0] == 3]  # a load without any change
    numbers = [(load, r.choice([None, -1, 5, 10**16, r.randrange(1000)]), "x") for load in (2, 3, 7, 8) for _ in range(30)]
    counted = []

    def count(cols, after=None, real=profiles.value_counts):
        out = real(cols, after)
        counted.extend(sorted({(x.table_name, x.load_no) for x in out.collect()}))
        return out

    def rows(m):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in m.collect()), key=str), sorted((tuple(x) for x in out_of_line(m).collect()), key=str)

    monkeypatch.setattr(profiles, "value_counts", count)
    kept = f"{tmp_path}/kept"
    for load, expected in ((2, [("n", 2), ("t", 2)]), (3, [("n", 3), ("t", 3)]), (5, [("t", 4), ("t", 5)]), (8, [("n", 7), ("n", 8), ("t", 7), ("t", 8)]), (8, [])):
        cols = columns(spark, [x for x in text if x[0] <= load], [x for x in numbers if x[0] <= load])
        counted.clear()
        one = rows(profile(cols, kept))
        assert counted == expected
        assert one == rows(profile(cols))
    states = sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "kept/counts").glob("*/*"))
    assert states == ["kept/counts/load_no=8/table_name=n", "kept/counts/load_no=8/table_name=t"]


def test_one_load(spark, tmp_path):
    kept = profiles.Kept(spark, f"{tmp_path}/k")
    cols = columns(spark, [(1, "a", "x", 1), (2, "b", "x", 1), (3, "c", "x", 1)], [])
    assert profiles.apply_loads(cols, kept, only=1).count() == 1 and kept.loads() == {"t": [1]}
    m = {x.load_no: x for x in profiles.apply_loads(cols, kept, only=3).collect()}
    assert set(m) == {1, 3} and (m[3].prior_load_no, m[3].shift) == (1, 1.0)
    assert sorted((x.value, x.n, x.delta) for x in kept.counts("t", 3).collect()) == [("a", 0, -1), ("c", 1, 1)]
    with pytest.raises(ValueError, match="not later"):
        profiles.apply_loads(cols, kept, only=2)
