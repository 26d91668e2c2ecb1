import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from filament.operators import snapshots
from filament.operators.snapshots import Bitmap, number_value, snapshot_changes, text_value

SCHEMA = "row_id long, load_no int, received_at timestamp_ntz, id_namespace string, local_id string, md5 string, status string, size string, change_kind string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    values = {"md5": text_value(F.col("md5")), "status": text_value(F.col("status")), "size": number_value(F.col("size"))}
    return sorted((tuple(x) for x in snapshot_changes(df, ["id_namespace", "local_id"], values).collect()), key=str)


def brute_force(rows):
    def text(x):
        return (x.strip().lower() or None) if x is not None else None

    def number(x):
        try:
            return float(x.replace(",", "")) if x is not None and x.strip() else None
        except ValueError:
            return None

    state = {}
    for row_id, load, at, ns, key, md5, status, size, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or datetime(1, 1, 1), r[0])):
        if load is not None:
            state.setdefault(load, {})[ns, key] = (text(md5), text(status), number(size))
    out, loads = [], sorted(state)
    for a, b in zip(loads, loads[1:]):
        old, new = state[a], state[b]
        out += [(*k, b, "added") for k in new.keys() - old.keys()] + [(*k, b, "removed") for k in old.keys() - new.keys()] + [(*k, b, "changed") for k in old.keys() & new.keys() if old[k] != new[k]]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(11)
    rows = [
        (i, r.choice([1, 2, 4, 7]), datetime(2025, 1, r.randint(1, 3)), r.choice(["n", "m", None]), r.choice("abcdefgh") if r.random() < 0.95 else None,
         r.choice(["AB", "ab ", "cd", "", None]), r.choice(["released", " Released", "revoked", None, " "]), r.choice(["10", "+10", "010", "10.0", "1,000", "1000", "n/a", "", None, " 11 "]), "x")
        for i in range(400)
    ]
    assert changes(spark, rows) == brute_force(rows)


def test_snapshots_one_by_one(spark, tmp_path):
    """50 snapshots in a few calls: keys keep their ordinals, and later calls do without the rows of earlier ones."""
    r = random.Random(3)
    at, rows, state, n = datetime(2025, 1, 1), [], {}, 0
    values = {"md5": text_value(F.col("md5")), "status": text_value(F.col("status")), "size": number_value(F.col("size"))}
    got, ordinals, every_row = [], {}, []
    for load in range(1, 51):
        for k in range(30):
            if r.random() < 0.1:
                state.pop(k, None)
            elif r.random() < 0.2:
                state[k] = r.choice("abc")
        if load == 20:
            state = {}  # an empty snapshot is no load
        new = [(n + i, load, at, "n", f"k{k}", v, "s", "1", None) for i, (k, v) in enumerate(state.items())]
        n, rows = n + len(new), rows + new
        if load in (1, 2, 3, 21, 35, 50):
            df = spark.createDataFrame(rows, SCHEMA)
            got += [tuple(x) for x in snapshot_changes(df, ["id_namespace", "local_id"], values, kept=f"{tmp_path}/k").collect()]
            every = spark.read.parquet(*map(str, (tmp_path / "k").glob("*/ordinals"))).collect()
            now = {x.local_id: x.ordinal for x in every}
            assert len(now) == len(every) and ordinals.items() <= now.items() and sorted(now.values()) == list(range(len(now)))
            ordinals = now
            every_row, rows = every_row + rows, []
    assert sorted(got, key=str) == brute_force(every_row) and len(got) > 100


def test_chunks(spark, monkeypatch):
    """Chunks without a key in some snapshots, and snapshots that span several batches."""
    monkeypatch.setattr(snapshots, "CHUNK_BITS", 4)
    monkeypatch.setattr(snapshots, "DENSE", 4)
    r = random.Random(6)
    rows = []
    for load in (1, 2, 5, 6, 9):
        keys = range(0, 200) if load != 5 else range(150, 400)
        rows += [(len(rows) + k, load, datetime(2025, 1, 1), "n", f"k{k}", r.choice("ab"), "s", "1", "x") for k in keys if r.random() < 0.7]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        expected = brute_force(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        values = {"md5": text_value(F.col("md5"))}
        loads = [1, 2, 5, 6, 9]
        per = {(x.local_id): x.local_id for x in df.select("local_id").distinct().collect()}
        numbered = {k: i for i, k in enumerate(sorted(per))}
        flat = [(numbered[x[4]] >> 4, x[1], numbered[x[4]] & 15, ord(x[5])) for x in rows]
        chunks = {}
        for c, load, low, d in sorted(flat):
            chunks.setdefault(c, {}).setdefault(load, []).append((low, d))
        found = []
        names = {i: k for k, i in numbered.items()}
        for c, by_load in chunks.items():
            chunk = snapshots.Chunk(c, 1, loads)
            for load, pairs in by_load.items():
                chunk.snapshot(load, np.array([p[0] for p in pairs], np.int32), [np.array([p[1] for p in pairs])])
            for number, load, kind, places, _, _ in chunk.end():
                if kind != snapshots.STATE:
                    found += [("n", names[(number << 4) + p], load, kind) for p in places]
        assert sorted(found, key=str) == expected
        monkeypatch.undo()
        assert sorted((tuple(x) for x in snapshot_changes(df, ["id_namespace", "local_id"], values).collect()), key=str) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    at = datetime(2025, 1, 1)
    assert changes(spark, []) == []
    assert changes(spark, [(1, 1, at, "n", "a", "x", "s", "1", None), (1, 1, at, "n", "a", "x", "s", "1", None)]) == []
    assert changes(spark, [(1, None, at, "n", "a", "x", "s", "1", None), (2, 3, at, "n", "a", "x", "s", "1", None)]) == []
    assert changes(spark, [(1, 1, None, "n", "a", "x", None, None, None), (2, 1, at, "n", "a", "y", None, None, None), (3, 2, None, "n", "a", "y", None, None, None)]) == []


def test_numbers(spark):
    same = ["10", "+10", "0010", "10.", "10.000", " 10\n", "1e1"]
    other = ["abc", "", None, "1,23", "0x10", "10 B"]
    df = spark.createDataFrame([(x,) for x in same + other], "s string")
    got = [x[0] for x in df.select(number_value(F.col("s"))).collect()]
    assert len(set(got[: len(same)])) == 1 and got[0] is not None and got[len(same) :] == [None] * len(other)


def test_bitmaps():
    r = np.random.default_rng(0)
    for n, m in ((10, 20), (10, 9000), (9000, 10), (9000, 12000), (0, 5)):
        a, b = (np.unique(r.integers(0, 32768, k)).astype(np.uint16) for k in (n, m))
        x, y = Bitmap(a), Bitmap(b)
        assert np.array_equal(Bitmap.unpacked(x.packed()).ordinals(), a)
        assert np.array_equal(x.and_not(y), np.setdiff1d(a, b)) and np.array_equal(x.both(y), np.intersect1d(a, b)) and np.array_equal(x.ordinals(), a)
