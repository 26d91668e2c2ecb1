"""Tables of first copies and of links: made without all copies, equal to those of whole documents."""

import os

import pytest

from filament.operators import flatten
from filament.operators.materialize import Parts
from filament.plans import catalog
from filament.plans.raw_tables import raw_tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COPIES = ("collection_copies", "biosample_copies", "sampled_copies", "subject_copies")


def _never(monkeypatch, *names):
    def made(*_):
        raise AssertionError("this level is not needed")

    for n in names:
        monkeypatch.setattr(Parts, n, property(made) if n in COPIES else made)


@pytest.fixture(scope="module")
def whole(spark):
    parts = Parts(raw_tables(spark, DATA))
    docs = flatten.as_documents(parts.with_terms(parts.with_collections(parts.files)), "ord")
    return flatten.flatten(docs).tables


def _same(a, b):
    b = b.select(*a.columns)
    return a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_entities_without_copies(spark, monkeypatch):
    _never(monkeypatch, *COPIES, "with_terms")
    assert catalog.QUERIES["dump_entities"](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["collection", "biosample", "subject"])
def test_first_copies(spark, whole, name):
    assert _same(flatten.flatten_parts(Parts(raw_tables(spark, DATA))).tables[name], whole[name])


def test_junctions_without_copies(spark, monkeypatch):
    _never(monkeypatch, *COPIES, "with_terms")
    made, held = [], Parts._held.func
    monkeypatch.setattr(Parts, "_held", property(lambda p: made.append(p) or held(p)))
    assert catalog.QUERIES["junction_union_distinct"](spark, DATA).count() > 0
    assert len(made) == 1  # files and links are joined once


@pytest.mark.parametrize("linked", [False, True])
def test_junctions(spark, whole, linked):
    got = flatten.flatten_parts(Parts(raw_tables(spark, DATA)), linked=linked).tables
    for name in ("file_in_collection", "biosample_in_collection", "subject_in_collection", "biosample_from_subject", "collection_anatomy", "subject_race"):
        assert _same(got[name], whole[name]), name
