"""Intervals, matrices, jobs, streams and sources."""

import base64
import gzip
import json
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from filament.operators import intervals, matrix, query, slices
from filament.sources import readers
from filament.streaming import ingest, jobs


# ------------------------------------------------------------------ intervals
def test_interval_sort_and_checks(spark, tmp_path):
    lines = ["chr10\t5\t9\tb", "chr2\t7\t9", "#head", "chr2\t10\t11", "", "chr2\t7\t8", "Chr1\t1\t2"]
    path = tmp_path / "a.bed.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    records = intervals.parsed(intervals.read_lines(spark, str(path)), "bed")
    got = [r.line for r in intervals.sorted_records(records).collect()]
    assert got == ["#head", "Chr1\t1\t2", "chr10\t5\t9\tb", "chr2\t7\t8", "chr2\t7\t9", "chr2\t10\t11"]
    assert intervals.data_lines(records).first().n == 5
    intervals.write_indexed(records, str(tmp_path / "ix"), 2)
    assert spark.read.parquet(str(tmp_path / "ix")).where("chrom = 'chr2' and start >= 7").count() == 3
    assert intervals.data_lines(records.limit(0)).first().n == 0


def test_alignments(spark, tmp_path):
    sam = ["@HD\tVN:1", "@SQ\tSN:chr2\tLN:9", "@SQ\tSN:chr1\tLN:9", "@RG bad", "r1\t0\tchr1\t5", "r2\t4\t*\t0", "r3\t0\tchr2\t7", "r4\t0\tchr2\t3"]
    (tmp_path / "a.sam").write_text("\n".join(sam))
    records = intervals.parsed(intervals.read_lines(spark, str(tmp_path / "a.sam")), "sam")
    assert [r.line.split("\t")[0] for r in intervals.coordinate_sorted(records).where("not is_header").collect()] == ["r4", "r3", "r1", "r2"]
    assert [r.line for r in intervals.bad_headers(records).collect()] == ["@RG bad"]
    df = spark.createDataFrame([("f", 0, "a", 1), ("f", 1, "a", 0), ("f", 2, "b", 0), ("f", 3, "a", 0), ("g", 0, "a", 1)], "file string, n int, ref string, pos int")
    assert {r.file: r.out_of_order for r in intervals.unsorted(df, ["file"], "n", "ref", "pos").collect()} == {"f": 1, "g": 0}
    assert {r.file: r.out_of_order for r in intervals.unsorted(df, ["file"], "n", "ref", "pos", first=1).collect()} == {"f": 0, "g": 0}
    r = random.Random(12)
    rows = [(r.choice("fg"), i, r.choice("ab"), r.randint(0, 9)) for i in range(3000)]
    bad = {}
    for name in "fg":
        own = [x for x in rows if x[0] == name]
        bad[name] = sum(a[2] == b[2] and b[3] < a[3] for a, b in zip(own, own[1:]))
    many = spark.createDataFrame(rows, df.schema).repartition(7)
    assert {x.file: x.out_of_order for x in intervals.unsorted(many, ["file"], "n", "ref", "pos").collect()} == bad


def test_overlaps_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), s, s + r.randint(0, 40)) for i in range(200) for s in [r.randint(0, 300)]]
    windows = [(r.choice("ab"), s, s + r.randint(0, 90), k) for k in range(30) for s in [r.randint(0, 300)]]
    expected = sorted((i, k) for i, g, s, e in rows for wg, ws, we, k in windows if g == wg and e > s and we > ws and s < we and e > ws)
    df = spark.createDataFrame(rows, "i int, g string, s int, e int")
    w = spark.createDataFrame(windows, "g string, w_start int, w_end int, k int")
    assert sorted((x.i, x.k) for x in intervals.overlapping(df, w, "g", "s", "e", 16).collect()) == expected


def test_bytes_and_attributes(spark):
    df = spark.createDataFrame([(gzip.compress(b"x"),), (b"chr1\t1\n",), (b"BAM\x01\x00",), ("é".encode() * 300,), (b"\xff\xfe" * 9,), (b"",)], "c binary")
    assert [r[0] for r in df.select(intervals.looks_processable(F.col("c"))).collect()] == [True, True, False, True, False, True]
    df = spark.createDataFrame([('gene_id "g1"; transcript_id "t";',)], "a string")
    assert df.select(intervals.gtf_to_gff3(F.col("a"))).first()[0] == "gene_id=g1;transcript_id=t;"


# ------------------------------------------------------------------ matrices
def test_coarsening_keeps_counts(spark):
    chroms = spark.createDataFrame([("c1", 1000, 0), ("c2", 1500, 1), ("c3", 501, 2)], "chrom string, length long, ord int")
    fine, coarse = matrix.make_bins(chroms, 10), matrix.make_bins(chroms, 20)
    bins, wide = fine.orderBy("bin_id").collect(), coarse.orderBy("bin_id").collect()
    assert [b.bin_id for b in bins] == list(range(301)) and bins[-1].end == 501
    r = random.Random(8)
    pixels = {}
    for _ in range(400):
        a, b = sorted((r.randrange(301), r.randrange(301)))
        pixels[a, b] = r.randint(1, 9)
    at = {b.bin_id: next(w.bin_id for w in wide if w.chrom == b.chrom and w.start <= b.start < w.end) for b in bins}
    expected = {}
    for (a, b), n in pixels.items():
        k = tuple(sorted((at[a], at[b])))
        expected[k] = expected.get(k, 0) + n
    df = spark.createDataFrame([(a, b, n) for (a, b), n in pixels.items()], "bin1_id long, bin2_id long, count long")
    assert {(x.bin1_id, x.bin2_id): x["count"] for x in matrix.coarsen(df, fine, coarse).collect()} == expected
    with pytest.raises(ValueError):
        matrix.coarsen(df, spark.createDataFrame([(0, "c1", 0, 10), (1, "c1", 10, 15), (2, "c1", 15, 25)], "bin_id long, chrom string, start long, end long"), coarse)
    assert matrix.ladder(10, 3001) == [10, 20] and matrix.ladder(100, 50) == [100]
    info = matrix.tileset_info(fine, [10, 20], "u", "n")
    assert info["chromsizes"] == [("c1", 1000), ("c2", 1500), ("c3", 501)] and info["max_pos"] == [3001, 3001] and "coordSystem" not in info


def test_tiles(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 3, 2), (3, 5, 7)], "bin1_id long, bin2_id long, count long")
    whole = np.zeros((8, 8))
    for a, b, n in ((0, 0, 5), (0, 3, 2), (3, 5, 7)):
        whole[a, b] = whole[b, a] = n
    for x in (0, 1):
        for y in (0, 1):
            row = matrix.dense_tile(matrix.tile_window(df, x, y, 4), tile=4).first()
            block = np.frombuffer(base64.b64decode(row.block), "<f4").reshape(4, 4) if row else np.zeros((4, 4))
            assert np.array_equal(block, whole[y * 4 : y * 4 + 4, x * 4 : x * 4 + 4])
    bins = spark.createDataFrame([(0, 0.5), (3, 2.0), (5, None)], "bin_id long, weight double")
    assert {(r.bin1_id, r.bin2_id): r.value for r in matrix.balanced(df, bins).collect()} == {(0, 0): 1.25, (0, 3): 2.0, (3, 5): None}
    links = spark.createDataFrame([(0, 10, 50, 60), (20, 30, 70, 80)], "a_start int, a_end int, b_start int, b_end int")
    assert matrix.links_in_tile(links, 55, 65).count() == 1 and matrix.rectangles_in_tile(links, (0, 15), (50, 51)).count() == 1


# ------------------------------------------------------------------ jobs
EVENT = "workflow_key string, ts timestamp, kind string, job_id string, payload string"
T0 = datetime(2025, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


EVENTS = [
    ("k", at(0), "claim", "j1", None), ("k", at(1), "start", "j1", None), ("k", at(2), "claim", "j2", None), ("k", at(600), "heartbeat", "j1", None), ("k", at(1400), "claim", "j3", None),
    ("k", at(2400), "claim", "j4", None), ("k", at(2401), "complete", "j1", None), ("k", at(2402), "start", "j4", None), ("k", at(2403), "complete", "j4", None), ("k", at(2404), "fail", "j4", "late"), ("k", at(2405), "claim", "j5", None),
    ("m", at(0), "claim", "x", None), ("m", at(1), "fail", "x", "boom"),
]
EXPECTED = {"j1": ("failed", False, "j4"), "j4": ("completed", False, None), "j5": ("pending", True, None), "x": ("failed", False, None)}


def test_job_fold(spark):
    table = jobs.fold_jobs(spark.createDataFrame(EVENTS, EVENT))
    got = {r.job_id: (r.status, r.active, r.superseded_by) for r in table.collect()}
    assert got == EXPECTED
    assert jobs.active_jobs(table).first() == (1, True)
    assert jobs.fold_jobs(spark.createDataFrame([], EVENT)).count() == 0


def test_job_stream(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(0, len(EVENTS), 3):
        spark.createDataFrame(EVENTS[i : i + 3], EVENT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    rows = []
    q = jobs.job_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: rows.append(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and sum(map(len, rows)) >= 4


def test_job_tables(spark):
    df = spark.createDataFrame([("a", "running", True, at(0), at(0), at(5)), ("b", "pending", True, at(9000), at(9000), at(3)), ("c", "completed", False, at(0), at(0), None)], "job_id string, status string, active boolean, submitted_at timestamp, updated_at timestamp, next_dispatch_at timestamp")
    now = at(9500)
    assert [r.job_id for r in jobs.stale_jobs(df, now).collect()] == ["a"]
    assert {r.job_id: r.status for r in jobs.requeue_orphans(df, now).collect()} == {"a": "pending", "b": "pending", "c": "completed"}
    assert [r.job_id for r in jobs.lease_due(df, now).collect()] == ["b"]
    later = {r.job_id: r for r in jobs.next_dispatch(df, at(15000)).collect()}
    assert later["a"].status == "failed" and not later["a"].active and 120 <= (later["b"].next_dispatch_at - at(15000)).total_seconds() <= 150
    assert sorted(r.job_id for r in jobs.expire(df, at(8 * 86400)).collect()) == ["a", "b"]


# ------------------------------------------------------------------ streams and sources
def test_ingest(spark, tmp_path):
    header, path = ["id", "v"], str(tmp_path / "table")

    def folder(name, files):
        (tmp_path / name).mkdir()
        for i, text in enumerate(files):
            (tmp_path / name / f"{i}.tsv").write_text(text)
        return lambda s: readers.stream_metadata(s, str(tmp_path / name), header)

    first = ingest.Phase("a", folder("a", ["id\tv\n1\tx\n", "id\tv\n2\ty\n"]), {"slice": "a"})
    assert ingest.ingest(spark, [first], path)[0].rows == 2
    again = ingest.Phase("a", folder("a2", ["id\tv\n3\tz\n"]), {"slice": "a"})
    broken = ingest.Phase("b", lambda s: s.readStream.schema("id string").parquet(str(tmp_path / "nowhere")), {"slice": "b"})
    other = ingest.Phase("c", folder("c", ["id\tv\n9\tq\n"]), {"slice": "c"})
    with pytest.raises(RuntimeError, match="1 of 3 phases failed, first b"):
        ingest.ingest(spark, [again, broken, other], path)
    assert sorted((r.slice, r.id) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("c", "9")]
    ingest.ingest(spark, [ingest.Phase("c", folder("c2", ["id\tv\n"]), {"slice": "c"})], path)
    assert [r.slice for r in spark.read.parquet(path).collect()] == ["a"]


def test_metadata_lines(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes(b'\r\nA\tB\tC\r\n1\t"q\t3\r\n\r\n2\n4\t5\t6\t7\n')
    assert [tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "m.tsv")).collect()] == [("1", '"q', "3"), ("2", None, None), ("4", "5", "6")]
    (tmp_path / "e.tsv").write_text("A\tB\n")
    assert readers.read_metadata(spark, str(tmp_path / "e.tsv")).count() == 0


def test_datapackage(spark, tmp_path):
    inner = tmp_path / "src" / "pkg"
    inner.mkdir(parents=True)
    (inner / "file.tsv").write_text('id_namespace\tlocal_id\tname\nn\t1\t"a ""b""\nc"\nn\t2\n')
    (inner / "dcc.csv").write_text("id,name\nx,\n")
    (tmp_path / "src" / "__MACOSX").mkdir()
    archive = tmp_path / "p.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in inner.iterdir():
            z.write(p, f"pkg/{p.name}")
    folder = readers.extract_archive(str(archive), str(tmp_path / "out"))
    t = readers.read_datapackage(spark, folder, "s", public=True)
    assert [(r.local_id, r.name, r.submission, r.table, r.data_access_level) for r in t["file"].orderBy("ord").collect()] == [("1", 'a "b"\nc', "s", "file", "public"), ("2", "", "s", "file", "public")]
    assert t["dcc"].first().name == ""
    archive.write_bytes(b"PK broken")
    with pytest.raises(ValueError):
        readers.extract_archive(str(archive), str(tmp_path / "out"))
    assert not archive.exists()


def test_search_payloads(spark):
    page = {"@graph": [{"accession": "4dnf1", "file_type": "r", "track_and_facet_info": {"condition": "c", "replicate_info": "Biorep 1"}, "extra_files": [{"href": "h", "file_size": 5, "file_format": {"display_title": "bai"}}, {}]}, {"file_type": "x"}]}
    rows = readers.file_search(spark.createDataFrame([(json.dumps(page),)], "value string")).collect()
    assert [(r.accession, r.condition, r.extra_files[0].file_format, len(r.extra_files)) for r in rows] == [("4DNF1", "c", "bai", 1)]
    pages = [{"@graph": [{"accession": "4dne1", "display_title": "old"}], "total": 2}, {"@graph": [{"accession": "4DNE1", "display_title": "new", "experiment_type": {"display_title": "Hi-C"}, "targeted_factor": [{"display_title": "f"}], "time": 5, "empty": " "}], "total": 2}]
    r = readers.experiment_search(spark.createDataFrame([(json.dumps(p),) for p in pages], "value string").coalesce(1)).collect()
    assert [(x.accession, x.display_title, x.experiment_type, x.targeted_factor, x.protocol) for x in r] == [("4DNE1", "new", "Hi-C", ["f"], {"time": "5"})]
    hits = {"hits": {"hits": [{"_source": {"doi_url": "d", "vitessce-hints": ["v"], "ingest_metadata": {"workflow_description": "with GRCh38"}}, "sort": ["1"]}, {"_source": {"doi_url": ""}}]}}
    d = readers.dataset_search(spark.createDataFrame([(json.dumps(hits),)], "value string")).collect()
    assert [(x.doi_url, x.genome_assembly, x["vitessce-hints"]) for x in d] == [("d", "GRCh38", ["v"])]


def test_artifacts(spark, tmp_path):
    store = readers.ArtifactStore(spark, str(tmp_path))
    key, made = f"enc/f/index/{'a' * 32}-v1", []

    def make():
        made.append(1)
        return spark.range(3)

    assert not store.has(key) and store.once(key, make).count() == 3 and store.once(key, make).count() == 3 and len(made) == 1
    assert store.delete(key) and not store.has(key)
    with pytest.raises(ValueError):
        store.path("../x")
    (tmp_path / "s.gz").write_bytes(gzip.compress(b"hello" * 10))
    assert readers.peek(readers.fetch_atomically(str(tmp_path / "s.gz"), str(tmp_path / "t.gz")), 7) == b"hellohe"
    df = spark.createDataFrame([([("ftp", "f"), ("https", ""), ("s3", "u")],)], "m array<struct<type:string,url:string>>")
    assert df.select(readers.access_url(F.col("m"))).first()[0] == "u"


def test_paging(spark, tmp_path):
    calls = []
    data = list(range(25))
    pages = list(readers.offset_pages(lambda at, n: {"@graph": data[at : at + n], "total": 25}, 10))
    assert [len(p["@graph"]) for p in pages] == [10, 10, 5]
    keyed = list(readers.keyset_pages(lambda after, n: {"hits": {"hits": [{"sort": [i]} for i in data if after is None or i > after[0]][:n]}}, 10))
    assert [len(p["hits"]["hits"]) for p in keyed] == [10, 10, 5]
    assert readers.accession_batches(["b", "a", "b"], 1) == [["a"], ["b"]]

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    waits = []
    assert readers.with_retries(flaky, sleep=waits.append) == "yes" and waits == [1, 2]
    (tmp_path / "a.json").write_text('{"@graph": [{"accession": "4dnf1"}]}')
    (tmp_path / "b.json").write_text("{broken")
    spark.dataSource.register(readers.PageSource)
    loaded = spark.read.format("search_pages").option("folder", str(tmp_path)).load()
    assert [r.accession for r in readers.file_search(loaded).collect()] == ["4DNF1"]


def test_tile_requests(spark):
    df = spark.createDataFrame([(2, "b.0.0"), (1, "b.1.0"), (0, "a.0.0.0"), (3, "../x")], "n int, t string")
    assert {r.uid: r.tiles for r in matrix.tile_requests(df, "t", "n").collect()} == {"a": ["a.0.0.0"], "b": ["b.1.0", "b.0.0"]}


def test_pyramids_and_requests(spark):
    chroms = spark.createDataFrame([("a", 200_000, 0)], "chrom string, length long, ord int")
    pixels = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 5, 1)], "bin1_id long, bin2_id long, count long")
    levels = matrix.pyramid({200: pixels}, chroms)
    assert list(levels) == [200, 400, 800] and sorted(tuple(r) for r in levels[800].collect()) == [(0, 0, 5), (0, 1, 1)]
    assert matrix.pyramid({1: pixels, 2: pixels}, chroms) == {1: pixels, 2: pixels}
    tilesets = spark.createDataFrame([("m", [200, 400], 200_000, ["weight"])], "uid string, resolutions array<long>, extent long, balancing array<string>")
    ids = spark.createDataFrame([(x,) for x in ("m.0.0.0", "m.1.3.3.weight", "m.1.4.0", "m.2.0.0", "m.0.0", "n.0.0.0", "m.0.0.0.other", None)], "id string")
    got = {r.id: (r.bin_size if r.error is None else None, r.error) for r in matrix.requested_tiles(ids, "id", tilesets).collect()}
    assert got == {
        "m.0.0.0": (400, None), "m.1.3.3.weight": (200, None), "m.1.4.0": (None, "no such position"), "m.2.0.0": (None, "no such zoom level"), "m.0.0": (None, "malformed tile id"), "n.0.0.0": (None, "no such tileset"),
        "m.0.0.0.other": (None, "no such balancing column"), None: (None, "malformed tile id"),
    }
    sizes = spark.createDataFrame([("5",), (str(21 << 30),), ("n/a",), (None,)], "s string")
    assert [r[0] for r in sizes.select(matrix.within_cap(F.col("s"))).collect()] == [True, False, True, True]


def test_centres_and_lock(spark, tmp_path):
    header, path = ["id", "v"], str(tmp_path / "table")

    def phase(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.tsv").write_text(text)
        return ingest.Phase(name, lambda s: readers.stream_metadata(s, str(tmp_path / name), header), {"slice": name})

    broken = ingest.Phase("x", lambda s: s.readStream.schema("id string").parquet(str(tmp_path / "nowhere")), {"slice": "x"})
    got = ingest.synchronise(spark, {"one": [broken], "two": [phase("b", "id\tv\n1\tx\n")]}, path, "me")
    assert got["one"].startswith("RuntimeError: 1 of 1 phases failed") and got["two"] is None
    assert [(r.slice, r.id) for r in spark.read.parquet(path).collect()] == [("b", "1")] and [p.name for p in (tmp_path / "table").iterdir() if not p.name.endswith(".crc")] == ["slice=b"]
    a, b = (slices.Lock(spark, f"{path}/_sync-lock", n) for n in ("a", "b"))
    assert a.acquire() and a.acquire() and not b.acquire() and not b.release() and not b.refresh()
    with pytest.raises(RuntimeError, match="synchronised by a"):
        ingest.synchronise(spark, {}, path, "c")
    later = datetime.now().timestamp() + 4000
    assert b.acquire(later) and b.holder() == "b" and not a.refresh() and not a.release() and b.release() and b.holder() is None


def test_documents_that_cannot_be_read(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"id": "1", "n": {"k": 5}}\nnonsense\n{"id": "2", "n": "text"}\n{"id": "3", "more": 1}\n')
    good, bad = readers.read_documents(spark, str(tmp_path / "d"), StructType.fromDDL("id string, n struct<k:int>"))
    assert sorted((r.id, r.n and r.n.k) for r in good.collect()) == [("1", 5), ("3", None)] and bad.count() == 2
    assert query.of_submissions(good.withColumnRenamed("id", "submission"), ["3", "9"]).count() == 1 and query.of_submissions(good, None).count() == 2
