"""Stamps against a second reading with the standard library, and the defined edge cases."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from filament.operators import timestamps as ts

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Tokyo", "Australia/Lord_Howe", "UTC"]


def instants(texts, zone="Europe/Berlin", order="dmy"):
    return list(ts.to_text(ts.to_instants(texts, [zone] * len(texts), [order] * len(texts))))


def brute_force(wall, zone):
    z, found = ZoneInfo(zone), set()
    for fold in (0, 1):
        u = wall.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)
        if u.astimezone(z).replace(tzinfo=None) == wall:
            found.add(u)
    return found.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(found) == 1 else "none"


def test_wall_clock_times_against_zoneinfo():
    r = random.Random(7)
    for zone in ZONES:
        walls = [dt.datetime(2000, 1, 1) + dt.timedelta(seconds=r.randrange(30 * 365 * 86400)) for _ in range(400)]
        for year in range(2005, 2030):  # around the changes
            for month, day in ((3, 31), (10, 31), (11, 1), (3, 8), (4, 5)):
                walls += [dt.datetime(year, month, day, h, 30) - dt.timedelta(days=k) for h in (1, 2, 3) for k in range(7)]
        got = instants([w.strftime("%Y-%m-%d %H:%M:%S") for w in walls], zone)
        assert got == [brute_force(w, zone) for w in walls], zone


def test_notations_of_one_instant():
    same = [
        "2021-03-04T05:06:07Z", "2021-03-04 06:06:07", "2021-03-04T05:06:07+00:00", "2021-03-04T00:06:07-0500", "2021-03-04T10:36:07 +05:30", "20210304T050607Z", "2021-063T05:06:07Z",
        "2021-W09-4T05:06:07Z", "Thu, 04 Mar 2021 05:06:07 +0000", "Mar 4, 2021 6:06:07 AM", "04/03/2021 06:06:07", "4.3.2021 06:06:07", "04-03-21 06:06:07", "1614834367", "1614834367000", "1614834367000000",
        "Thu Mar  4 05:06:07 GMT 2021", "2021-03-04 14:06:07 JST", "2021-03-04T06:06:07+01:00[Europe/Berlin]", "2021-03-04 00:06:07 America/New_York", "2021-03-04 07:06:07 UTC+02:00", "\t2021-03-04t05:06:07z\n",
    ]
    assert set(instants(same)) == {"2021-03-04T05:06:07.000000Z"}


def test_no_instant():
    bad = [None, "", " ", "TBD", "2021", "2021-05", "12:00:00", "2021-02-30", "2021-13-01T00:00:00Z", "13/13/2021", "2021-03-28 02:30:00", "2021-10-31 02:30:00", "2021-01-01 25:00:00", "2021-01-01 10:00 XYZ", "2021-01-01 13:00 PM", "2021-01-01 Nowhere/City", "before 2016", "2021-W54-1", "2021-366"]
    assert set(instants(bad)) == {"none"}


def test_order_precision_and_dates():
    assert instants(["03/04/2021", "03/04/2021"], "UTC", "mdy")[0] == "2021-03-04T00:00:00.000000Z"
    assert instants(["03/04/2021"], "UTC", "dmy") == ["2021-04-03T00:00:00.000000Z"]
    assert instants(["2021-03-04T05:06:07.123456789Z", "2021-03-04 05:06", "20210304"], "UTC") == ["2021-03-04T05:06:07.123456Z", "2021-03-04T05:06:00.000000Z", "2021-03-04T00:00:00.000000Z"]


def test_unknown_clocks():
    assert list(ts.to_text(ts.to_instants(["2021-03-04 05:06", "03/04/2021", "2021-03-04T05:06Z"], [None, "UTC", None], [None, None, None]))) == ["none", "none", "2021-03-04T05:06:00.000000Z"]


def test_masks_are_mapped_once():
    instants(["2021-03-04 01:00:00 EST", "4 May 2021"])
    before = ts._kept_parsers.cache_info().misses
    instants([f"2021-03-{d:02d} 0{d % 9}:00:00 {z}" for d in range(1, 29) for z in ("EST", "JST", "XXX", "CET")] * 50 + [f"{d} {m} 2021" for d in range(1, 9) for m in ("Jan", "May", "abc")])
    assert ts._kept_parsers.cache_info().misses == before
    assert ts.mask_of("4 Mai, 2021\t日7x") == ts.mask_of("5 Jun, 1999 語8y")


def test_kept_masks_are_bounded():
    r = random.Random(3)
    junk = ["".join(r.choices("ab1 -:", k=r.randint(1, 40))) for _ in range(2 * ts.KEPT_MASKS)] + ["x" * 100_000, "2021-03-04T05:06:07." + "1" * 100_000 + "Z"]
    got = instants(junk)
    assert ts._kept_parsers.cache_info().currsize <= ts.KEPT_MASKS and got[-1] == "2021-03-04T05:06:07.111111Z" and got[-2] == "none"


def test_words():
    assert instants(["2021-03-04 05:06 Etc/GMT+5", "2021-03-04 5 p.m.", "2021-03-04 05:06 (Asia/Tokyo)", "4th Sept 2021", "4xx Sep 2021", "2021-03-04X05:06", "2021-w09-4", "Foo, 4 Mar 2021 05:06"], "UTC") == [
        "2021-03-04T10:06:00.000000Z", "2021-03-04T17:00:00.000000Z", "2021-03-03T20:06:00.000000Z", "2021-09-04T00:00:00.000000Z", "none", "none", "none", "none",
    ]


def test_stamps_beside_labels(spark):
    names = ["rows_file@2024-01-01", "rows_file.run000001 [2024-01-01T00:00:00+01:00[Europe/Berlin]]", "2024-01-01 | rows_file", "[1 Jan 2024] rows_file.run000002", "rows_file at 2024-01-01", "rows_file", "rows_file.run000003", None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r[0] for r in df.orderBy("i").select(ts.stamp_beside_label(F.col("name"))).collect()]
    assert got == ["2024-01-01", "2024-01-01T00:00:00+01:00[Europe/Berlin]", "2024-01-01", "1 Jan 2024", "2024-01-01", None, None, None, None]


def test_column_on_empty_and_clashing_tables(spark):
    schema = "utc_stamp string, zone string, date_order string, text string"
    empty = spark.createDataFrame([], schema)
    assert empty.select(ts.utc_stamp(F.col("text"), F.col("zone"), F.col("date_order"))).collect() == []
    df = spark.createDataFrame([("x", "UTC", None, "2024-01-01 00:00"), ("x", "UTC", None, "2024-01-01 00:00"), (None, None, None, None), (None, None, None, "9" * 100_000)], schema)
    assert [r[0] for r in df.select(ts.utc_stamp(F.col("text"), F.col("zone"), F.col("date_order"))).collect()] == ["2024-01-01T00:00:00.000000Z"] * 2 + ["none"] * 2
