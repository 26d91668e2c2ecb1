"""Fan-outs: blocks of both sides, dealt evenly; the terms of the dump without copies."""

import os
from collections import Counter

import pytest

from filament.operators import flatten, views
from filament.operators.materialize import Parts
from filament.plans import catalog
from filament.plans.raw_tables import raw_tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_fanned(spark, monkeypatch, block):
    """As the left join: of a key with many rows on both sides, of keys without right rows and of repeated rows."""
    monkeypatch.setattr(views, "BLOCK", block)
    left = spark.createDataFrame([(k, f"f{i}") for k, n in (("a", 7), ("b", 2), ("c", 3)) for i in range(n)] + [("b", "f0")], "k string, f string")
    right = spark.createDataFrame([("a", f"m{i}", i % 2 and "x" or None) for i in range(5)] + [("b", "m0", "y"), ("b", "m0", "y"), ("d", "m1", "z")], "k string, m string, t string")
    each = spark.createDataFrame([(k, k.upper()) for k in "abc"], "k string, name string")
    out = ["k", "name", "f", "m", "t"]
    expected = left.join(each, "k").join(right, "k", "left").select(*out)
    assert Counter(views.fanned(left, right, ["k"], each).select(*out).collect()) == Counter(expected.collect())


def test_hot_key_is_dealt(spark):
    """The rows of one key come from several tasks."""
    left, right = (spark.range(3 * views.BLOCK).selectExpr("'a' AS k", f"id AS {c}") for c in "fm")
    n = views.fanned(left, right, ["k"], spark.createDataFrame([("a", "A")], "k string, name string")).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert sum(r["count"] for r in n) == (3 * views.BLOCK) ** 2 and len(n) > 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_without_copies(spark, monkeypatch):
    def made(*_):
        raise AssertionError("this level is not needed")

    for n in ("collection_copies", "biosample_copies", "sampled_copies", "subject_copies"):
        monkeypatch.setattr(Parts, n, property(made))
    monkeypatch.setattr(Parts, "with_terms", made)
    assert catalog.QUERIES["view_fanout"](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["anatomy", "ncbi_taxonomy"])
def test_first_terms(spark, name):
    """Terms with the first copy's values: those of whole documents, also where submissions name a term differently."""
    raw = raw_tables(spark, DATA)
    raw = raw | {name: raw[name].selectExpr(*(c for c in raw[name].columns if c != "name"), "concat(name, ' of ', submission) AS name")}
    parts = Parts(raw)
    docs = flatten.as_documents(parts.with_terms(parts.with_collections(parts.files)), "ord")
    a, b = flatten.flatten_parts(Parts(raw)).tables[name], flatten.flatten(docs).tables[name]
    assert a.columns == b.columns
    a, b = Counter(a.collect()), Counter(b.collect())
    assert a == b and len({r.name.split(" of ")[1] for r in a}) > 1
