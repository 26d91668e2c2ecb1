"""Queries of one level of the documents: whole documents, which repeat a collection's members in every file that holds it, are not made for them."""

import os

import pytest

from filament.operators import flatten
from filament.operators.materialize import Parts
from filament.plans import catalog, raw_queries
from filament.plans.raw_tables import raw_tables

DATA = "/root/testdata/sf0.001"
LEVELS = ["view_fanout", "view_wide", "documents_rebuilt", "junction_union_distinct", "dump_stats", "dump_entities", "dump_files", "dataset_files", "distinct_fields", "subject_terms", "biosample_subjects", "collection_members", "materialized_collections", "materialized_terms"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", LEVELS)
def test_no_documents(spark, monkeypatch, name):
    def made(*_):
        raise AssertionError("whole documents are made")

    monkeypatch.setattr(raw_queries.materialize, "materialize", made)
    monkeypatch.setattr(raw_queries, "documents", made, raising=False)
    assert catalog.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_counted_copies(spark):
    """Counted copies give the counters and rows that the documents give."""
    parts = Parts(raw_tables(spark, DATA))
    got = flatten.flatten_parts(parts)
    docs = flatten.as_documents(parts.with_terms(parts.with_collections(parts.files)), "ord")
    assert got.stats().exceptAll(flatten.flatten(docs).stats()).count() == 0
