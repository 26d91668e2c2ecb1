import json
import random

import pytest

from filament.operators import nested
from filament.operators.nested import _parse_deep, array_paths, child_table, flat_tables, merged_schema, parse, shaped_records, write
from filament.plans.data_problems import p5_found

PAYLOADS = [
    {"collections": [{"localId": "c0", "biosamples": {"local_id": "b0", "subjects": "[{\"local_id\": \"s0\"}, null, {\"localId\": 7}]"}}, None, "x", {"local_id": None, "biosamples": []}]},
    {"collections": json.dumps([{"local_id": "c1", "biosamples": [{"local_id": "b1", "anatomy": {"id": "u"}, "subjects": None}], "child_id": "clash", "ordinal": 5}])},
    {"collections": "", "name": "n"},
]


def tables(spark, payloads, extra=None):
    texts = [json.dumps(p) for p in payloads] + (extra or [])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "record_id long, payload string, record string")
    schema = merged_schema(df, "payload", ["collections/biosamples/subjects"])
    return df, schema, shaped_records(df, "record_id", "payload", schema)


def test_child_tables(spark):
    df, schema, records = tables(spark, PAYLOADS, [None, "", "{", "[]", "null", '"{}"', "not found", '{"collections": 5}'])
    assert array_paths(schema) == [["collections"], ["collections", "biosamples"], ["collections", "biosamples", "subjects"]]
    get = lambda path: sorted((r.record_id, r.place, r.item.local_id, r.parent_id, r.ordinal) for r in child_table(records, "record_id", path).collect())
    c = sorted(((r.record_id, r.place, r.item.local_id) for r in child_table(records, "record_id", ["collections"]).collect()), key=str)
    assert c == [(0, "0", "c0"), (0, "3", None), (1, "0", "c1")]
    b = get(["collections", "biosamples"])
    assert [(r, p, k) for r, p, k, *_ in b] == [(0, "0.0", "b0"), (1, "0.0", "b1")]
    s = get(["collections", "biosamples", "subjects"])
    assert [(r, p, k, o) for r, p, k, _, o in s] == [(0, "0.0.0", "s0", 0), (0, "0.0.2", "7", 2)]
    parents = {r.child_id for r in child_table(records, "record_id", ["collections", "biosamples"]).collect()}
    assert {x[3] for x in s} <= parents and len(parents) == 2


def test_all_tables_and_empty(spark):
    df, *_ = tables(spark, PAYLOADS)
    assert set(flat_tables(df, "record_id", "payload")) == {"", "collections", "collections/biosamples", "collections/biosamples/subjects"}
    empty = df.limit(0)
    assert flat_tables(empty, "record_id", "payload")[""].count() == 0


def test_deep_and_long(spark):
    deep = "[" * 100_000 + "]" * 100_000
    df, schema, records = tables(spark, [{"collections": [{"local_id": "x" * 100_000}] * 300}], ['{"a": ' + deep + "}", '{"collections": ' + json.dumps(deep) + "}"])
    assert child_table(records, "record_id", ["collections"]).count() == 300


def test_deep_records_are_kept(spark):
    levels = {"some": 300, "many": 5_000, "most": 30_000}
    payloads = []
    for name, n in levels.items():
        deep = '{"a": ' * n + '"end"' + "}" * n
        payloads.append('{"collections": [{"local_id": "%s", "beside": %s}], "name": "%s"}' % (name, deep, name))
    df, schema, records = tables(spark, [], payloads)
    kept = {r.record_id: r.record for r in records.collect()}
    assert [kept[i].name for i in range(3)] == list(levels)
    rows = child_table(records, "record_id", ["collections"]).collect()
    assert sorted(r.item.local_id for r in rows) == sorted(levels)
    for r in rows:  # every level is there: as members up to MAX_DEPTH, as JSON text below
        n, v = 0, r.item.beside
        while not isinstance(v, str):
            v, n = v.a, n + 1
        assert n + v.count('{"a": ') == levels[r.item.local_id] and v.count('"end"') == 1


def test_deep_texts_are_read_and_written_like_others():
    r = random.Random(2)

    def value(depth):
        kind = r.randrange(5 if depth else 3)
        if kind < 3:
            return r.choice([None, True, -1.5e30, 7, "", 'a"\\\n\u00e9', "[{"])
        return [value(depth - 1) for _ in range(r.randrange(4))] if kind == 3 else {r.choice(["a", "b c", '"', ""]): value(depth - 1) for _ in range(r.randrange(4))}

    for i in range(300):
        text = json.dumps(value(5), indent=r.choice([None, 1]))
        assert _parse_deep(text) == json.loads(text)
        cut = text[: r.randrange(len(text) + 1)] + r.choice(["", ",", "}", "]", '"', ":"]) + text[r.randrange(len(text) + 1) :]
        try:
            expected = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                _parse_deep(cut)
        else:
            assert _parse_deep(cut) == expected
    deep = '{"b": [1, {"é": [], "a": ' * 20_000 + "{}" + "}]}" * 20_000
    assert write(parse(deep)).count('{"a": ') == 20_000 and write(parse(write(parse(deep)))) == write(parse(deep))


def test_names_that_are_data(spark, tmp_path):
    by_id = {f"urn:{i}/x~1": {"v": i} for i in range(12_000)}
    payloads = [{"collections": [{"local_id": "c0", "by_id": by_id, "biosamples": {"localId": "b0"}}], "by_id": by_id}, {"extra": {"fourdn": {"extra_files": [{"href": "h"}, {"href": {"at": 1}}]}}}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "record_id long, payload string")
    df.write.parquet(f"{tmp_path}/file_document.parquet")
    found = sorted(tuple(x) for x in p5_found(spark, str(tmp_path)).collect())
    assert found == [(0, "biosample", "0.0", "b0"), (0, "collection", "0", "c0"), (1, "extra_file", "0", "h"), (1, "extra_file", "1", '{"at":"1"}')]


@pytest.mark.parametrize("where", ["inner", "root", "product"])
def test_objects_with_too_many_names_are_kept_as_text(spark, monkeypatch, where):
    monkeypatch.setattr(nested, "MAX_PATHS", 60)
    monkeypatch.setattr(nested, "MAX_NAMES", 20)
    if where == "product":  # no object has many names, but there are many paths
        payloads = [{"name": f"n{i}", "top": {f"a{i}": {f"b{j}": {"c": i * j} for j in range(8)}}, "list": [{"localId": i}, "x"]} for i in range(15)]
    elif where == "inner":
        payloads = [{"name": f"n{i}", "top": {f"k/{i}/{j}": {"v": [1, {"é": j}]} for j in range(8)}, "list": [{"localId": i}, "x"]} for i in range(15)]
    else:
        payloads = [{f"k/{i}/{j}": {"v": j} for j in range(8)} | {"list": [{"localId": i}, "x"]} for i in range(15)]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "record_id long, payload string")
    for parts in (1, 4):
        split = df.repartition(parts)
        schema = merged_schema(split, "payload", ["list"])
        records = shaped_records(split, "record_id", "payload", schema)
        got = {r.record_id: r.record for r in records.collect()}
        assert len(got) == len(payloads)
        for i, p in enumerate(payloads):
            if where == "root":
                assert json.loads(got[i].plain_value) == p
            elif where == "inner":
                assert (got[i].name, json.loads(got[i].top.plain_value)) == (p["name"], p["top"])
            else:
                top = got[i].top
                assert got[i].name == p["name"] and json.loads(top.plain_value or top[f"a{i}"].plain_value) in (p["top"], p["top"][f"a{i}"])
        rows = child_table(records, "record_id", ["list"])
        if where != "root":
            assert sorted((r.record_id, r.ordinal, r.item.local_id) for r in rows.collect()) == [(i, 0, str(i)) for i in range(15)]
        else:
            assert sorted((r.record_id, r.ordinal) for r in rows.collect()) == [(i, 0) for i in range(15)]


def test_schema_cut_to_paths(spark):
    df, *_ = tables(spark, PAYLOADS)
    schema = merged_schema(df, "payload", ["collections"], ["collections/local_id"])
    assert list(schema.below) == ["collections"] and list(schema.below["collections"].below) == ["local_id"]
