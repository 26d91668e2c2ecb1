import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filament.operators import filters, query

SCHEMA = "id_namespace string, local_id string, filename string, accession_id string, size long, collections array<struct<name:string,lab:string,accession_id:string,biosamples:array<struct<anatomy:struct<name:string>>>>>"
DOCS = [
    ("n", "1", "a", "ENCFF1", 2**40, [("x", "l1", "C1", [(("heart",),), (None,)]), ("y", "l2", None, [])]),
    ("n", "2", "b", None, None, [("x", "l2", "C2", None)]),
    ("n", "3", "a", "ENCFF3", 5, None),
    ("n", "4", None, "ENCFF1", 5, [None, ("z", None, "C1", [(("lung",),)])]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


def at(doc, path):
    """Values at a path as a document store finds them: through arrays, each element."""
    if isinstance(doc, list):
        return [v for x in doc for v in at(x, path)]
    if not path:
        return [doc]
    if doc is None:
        return []
    return at(getattr(doc, path[0]), path[1:])


def holds(doc, tree, path=()):
    """True, False or None for no constraint."""
    if isinstance(tree, list):
        parts = [p for x in tree if (p := holds(doc, x, path)) is not None]
        return any(parts) if parts else None
    if isinstance(tree, dict):
        parts = [p for k, x in tree.items() if (p := holds(doc, x, (*path, k))) is not None]
        return all(parts) if parts else None
    if ".".join(path) in filters.FOLDED:
        tree = tree.strip().upper()
        if not tree:
            return None
    return tree in at(doc, path)


leaf = lambda *v: st.lists(st.sampled_from(v), max_size=2)
biosample = st.fixed_dictionaries({}, optional={"anatomy": st.lists(st.fixed_dictionaries({"name": leaf("heart", "lung")}), max_size=2)})
collection = st.fixed_dictionaries({}, optional={"name": leaf("x", "y", "z"), "lab": leaf("l1", "l2"), "accession_id": leaf(" c1 ", " ", "C2"), "biosamples": st.lists(biosample, max_size=2)})
trees = st.lists(st.fixed_dictionaries({}, optional={"filename": leaf("a", "b"), "accession_id": leaf("encff1", "", "ENCFF3"), "size": leaf(5, 2**40), "collections": st.lists(collection, max_size=2)}), max_size=3)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_trees_against_an_evaluator(docs, tree):
    got = {r.local_id for r in docs.where(filters.matching(tree, docs.schema)).collect()}
    assert got == {r.local_id for r in docs.collect() if holds(r, tree) in (True, None)}


def ids(docs, tree):
    return [r.local_id for r in query.files(docs, tree).collect()]


def test_truth_table(docs):
    every = ["1", "2", "3", "4"]
    for tree in (None, [], [{}], [{"accession_id": ["  "]}], [{"filename": []}]):
        assert ids(docs, tree) == every
    assert ids(docs, [{"filename": ["a"], "accession_id": ["encff3"]}]) == ["3"]
    assert ids(docs, [{}, {"filename": ["b"]}]) == ["2"]
    assert ids(docs, [{"collections": [{"name": ["x"], "lab": ["l2"]}]}]) == ["1", "2"]
    assert ids(docs, [{"collections": [{"biosamples": [{"anatomy": [{"name": ["heart"]}]}]}]}]) == ["1"]
    with pytest.raises(ValueError):
        ids(docs, [{"collections": [{"nope": ["x"]}]}])


def test_pages_counts_and_values(docs):
    assert [[r.local_id for r in query.files(docs, page=p, page_size=3).collect()] for p in range(3)] == [["1", "2", "3"], ["4"], []]
    for bad in ((-1, 5), (0, 0), (0, 501)):
        with pytest.raises(ValueError):
            query.files(docs, None, *bad)
    assert query.file_count(docs, [{"filename": ["a"]}]).first()[0] == 2
    got = sorted(tuple(r) for r in query.distinct_values(docs, ["filename", "collections.biosamples.anatomy.name"]).collect())
    assert got == [("collections.biosamples.anatomy.name", "heart"), ("collections.biosamples.anatomy.name", "lung"), ("filename", "a"), ("filename", "b")]
    with pytest.raises(ValueError):
        query.distinct_values(docs, ["filename"], allowed={"size"})
    assert query.files(docs.limit(0)).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([("hubmap", None), ("hubmap", "public"), ("hubmap", "x"), ("encode", None)], "d string, l string")
    assert [r[0] for r in df.select(filters.access_guard(F.col("d"), F.col("l"))).collect()] == [False, True, False, True]
    urls = ["https://a.example.org/x", "https://evilexample.org", "http://example.org", "https://example.org@evil.org/", None, "x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(filters.url_allowed(F.col("u"), ["example.org"])).collect()] == [True, False, False, False, False, False]


def test_identifiers_and_sidecars(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("a.b",), ("",), ("x" * 256,), ("x" * 257,), ("é",), (None,)], "s string")
    got = [tuple(r) for r in df.select(filters.is_identifier(F.col("s")), filters.is_identifier(F.col("s"), dots=False)).collect()]
    assert got == [(True, True), (False, False), (True, False), (False, False), (True, True), (False, False), (False, False), (None, None)]
    kind = "array<struct<href:string,file_format:string>>"
    rows = [([("a", "fastq")], [("b", "bai")]), ([], [("b", "fastq"), ("c", '{"display_title": "TBI"}')]), (None, [("b", "x")]), ([("a", None), ("d", "CSI")], None), (None, None)]
    df = spark.createDataFrame(rows, f"own {kind}, fourdn {kind}")
    assert [r[0] for r in df.select(filters.sidecar(F.col("own"), F.col("fourdn"))["href"]).collect()] == ["a", "c", "b", "d", None]
