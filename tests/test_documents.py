"""Materialising, flattening, views and enrichment on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filament.operators import enrich, flatten, slices, views
from filament.operators.integrity import IntegrityError
from filament.operators.materialize import materialize
from filament.operators.registry import Registry

COLUMNS = {
    "file": "submission id_namespace local_id project_id_namespace project_local_id persistent_id filename file_format data_type assay_type",
    "dcc": "submission id dcc_name", "project": "submission id_namespace local_id name", "file_format": "submission id name", "data_type": "submission id name", "assay_type": "submission id name",
    "anatomy": "submission id name", "ncbi_taxonomy": "submission id name clade", "collection": "submission id_namespace local_id persistent_id name", "biosample": "submission id_namespace local_id anatomy",
    "subject": "submission id_namespace local_id sex", "file_in_collection": "submission file_id_namespace file_local_id collection_id_namespace collection_local_id",
    "biosample_in_collection": "submission biosample_id_namespace biosample_local_id collection_id_namespace collection_local_id",
    "subject_in_collection": "submission subject_id_namespace subject_local_id collection_id_namespace collection_local_id",
    "biosample_from_subject": "submission biosample_id_namespace biosample_local_id subject_id_namespace subject_local_id age_at_sampling",
    "collection_anatomy": "submission collection_id_namespace collection_local_id anatomy", "subject_race": "submission subject_id_namespace subject_local_id race",
    "subject_role_taxonomy": "submission subject_id_namespace subject_local_id taxonomy_id",
}
ROWS = {
    "file": [("s", "n", "f1", "n", "p", "d9", "a.mcool", "format:3590", "data:1", ""), ("s", "n", "f2", "", "p", "d2", "b.bed", "format:9", None, "x"), ("s", "n", "f3", "n", "no", "d2", "c.hic", "", "data:1", None)],
    "dcc": [("s", "i1", "old"), ("s", "i2", "new")], "project": [("s", "n", "p", "first"), ("s", "n", "p", "last")], "file_format": [("s", "format:3590", "HDF5"), ("other", "format:9", "no")],
    "data_type": [("s", "data:1", "D")], "assay_type": [], "anatomy": [("s", "u1", "heart")], "ncbi_taxonomy": [("s", "t2", "mouse", "species")],
    "collection": [("s", "n", "c1", "d1", "one"), ("s", "n", "c2", "d2", "two"), ("s", "n", "c3", "d2", "three")], "biosample": [("s", "n", "b1", "u1"), ("s", "n", "b2", "missing")], "subject": [("s", "n", "s1", "female"), ("s", "n", "s2", None)],
    "file_in_collection": [("s", "n", "f1", "n", "c2"), ("s", "n", "f1", "n", "c1"), ("s", "n", "f1", "n", "c1"), ("s", "n", "f1", "n", "none"), ("s", "n", "f2", "", "c1")],
    "biosample_in_collection": [("s", "n", "b2", "n", "c1"), ("s", "n", "b1", "n", "c1")], "subject_in_collection": [("s", "n", "s2", "n", "c1")],
    "biosample_from_subject": [("s", "n", "b1", "n", "s1", "30.5"), ("s", "n", "b1", "n", "s2", "adult")], "collection_anatomy": [("s", "n", "c1", "u1"), ("s", "n", "c1", "zz")],
    "subject_race": [("s", "n", "s1", "r2"), ("s", "n", "s1", "r1"), ("s", "n", "s1", "r2"), ("s", "n", "s1", " ")], "subject_role_taxonomy": [("s", "n", "s1", "t1"), ("s", "n", "s1", "t2"), ("s", "n", "s2", "t2")],
}


def raw(spark, rows=ROWS):
    out = {}
    for name, columns in COLUMNS.items():
        names = columns.split()
        out[name] = spark.createDataFrame([(*r, i) for i, r in enumerate(rows[name])], ", ".join(f"{c} string" for c in names) + ", ord long")
    return out


def test_materialize(spark):
    docs = {r.local_id: r for r in materialize(raw(spark), "s").collect()}
    f1, f2, f3 = docs["f1"], docs["f2"], docs["f3"]
    assert f1.dcc.dcc_name == "new" and f1.project.name == "last" and f2.project is None and f3.project is None
    assert f1.file_format.name == "HDF5" and f1.file_format_raw is None and f1.enriched_file_format == "mcool"
    assert f2.file_format is None and f2.file_format_raw == "format:9" and f3.file_format is None and f3.file_format_raw is None and f3.enriched_file_format == "hic"
    assert [c.local_id for c in f1.collections] == ["c2", "c1", "c1"]
    assert [c.local_id for c in f2.collections] == ["c3"] and [c.local_id for c in f3.collections] == ["c3"]  # by persistent_id, the last
    c1 = f1.collections[1]
    assert [a.name for a in c1.anatomy] == ["heart"] and [b.local_id for b in c1.biosamples] == ["b2", "b1"] and [s.local_id for s in c1.subjects] == ["s2"]
    b2, b1 = c1.biosamples
    assert b2.anatomy is None and b2.subjects == [] and b1.anatomy.name == "heart"
    assert [(s.local_id, s.age_at_sampling, s.race, s.taxonomy.name if s.taxonomy else None) for s in b1.subjects] == [("s1", 30.5, ["r2", "r1", "r2"], None), ("s2", None, [], "mouse")]
    assert f1.collections[0].biosamples == [] and f1.collections[0].subjects == []


def test_materialize_empty(spark):
    assert materialize(raw(spark, {k: [] for k in ROWS})).count() == 0


def subject(local_id, **k):
    return {"id_namespace": "n", "local_id": local_id, "race": ["r"], "sex": "male"} | k


def document(local_id, submission="a", **k):
    return {
        "id_namespace": "n", "local_id": local_id, "submission": submission, "dcc": {"id": f"dcc:{submission}", "dcc_name": "D", "dcc_abbreviation": "D"}, "size_in_bytes": "6262125716", "creation_time": "2024-01-01T02:00:00+02:00",
        "project_id_namespace": "n", "project_local_id": "p", "file_format": {"id": "format:1", "name": "F"},
        "collections": [{"id_namespace": "n", "local_id": "c1", "name": "first", "anatomy": [{"id": "u", "name": "heart"}, {"id": "v", "name": ""}], "subjects": [subject("s1")],
                         "biosamples": [{"id_namespace": "n", "local_id": "b1", "anatomy": {"id": "u", "name": "heart"}, "subjects": [subject("s2", age_at_sampling=3.0, extra={"hubmap": {"age_value": 9.0, "age_unit": "y", "race": "q"}})]}]}],
    } | k


def dump(spark, docs):
    rows = [{**d, "ord": i} for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, flatten.T.StructType([*flatten.FILE.fields, flatten.T.StructField("ord", flatten.T.LongType())]))
    return flatten.flatten(df)


def test_flatten(spark, tmp_path):
    other = document("f2", size_in_bytes="12.0", creation_time="soon", project_local_id="", project={"id_namespace": "n", "local_id": "p", "name": "P"}, extra={"encode": {"run_type": "x"}, "fourdn": {"extra_files": [{"href": "h0", "file_size": "7"}, {"href": "h1", "file_size": "x"}]}})
    other["collections"] = [{"id_namespace": "n", "local_id": "c1", "name": "second"}]
    real = document("f3", project={"id_namespace": "n", "local_id": "p", "name": "P"}, collections=[])
    bad = document("f4", dcc={"id": ""})
    d = dump(spark, [document("f1"), other, real, bad])
    d.check()
    t = d.tables
    assert {r.local_id: (r.size_in_bytes, r.creation_time, r.project_local_id) for r in t["file"].collect()} == {"f1": (6262125716, datetime(2024, 1, 1), "p"), "f2": (None, None, None), "f3": (6262125716, datetime(2024, 1, 1), "p")}
    assert [tuple(r) for r in t["collection"].select("local_id", "name").collect()] == [("c1", "first")]
    assert t["project"].first().name == "P" and t["file_in_collection"].count() == 2 and t["collection_anatomy"].count() == 1
    assert [(r.ordinal, r.href, r.file_size) for r in t["file_extra_fourdn_extra_file"].orderBy("ordinal").collect()] == [(0, "h0", 7), (1, "h1", None)]
    assert t["file_extra_encode"].count() == 1 and t["file_extra_hubmap"].count() == 0 and t["subject_race"].count() == 2
    stats = {r.name: r.value for r in d.stats().collect()}
    assert stats["rows_file"] == 3 and stats["conflicts_collection"] == 1 and stats["conflicts_subject"] == 0
    assert (stats["documents_invalid"], stats["size_in_bytes_uncoercible"], stats["creation_time_unparseable"], stats["project_fk_incomplete"]) == (1, 1, 1, 1)
    assert (stats["project_stubs_created"], stats["project_stubs_surviving"]) == (1, 0)
    for name, reg in d.registries.items():
        one = reg.summary().first()
        assert (one.rows, one.stubs_created, one.stubs_surviving) == (reg.rows().count(), reg.stubs_created().first()[0], reg.stubs_surviving().first()[0])
        assert not reg.columns or one.conflicts == reg.conflicts().first()["conflicts"]
    assert (stats["term_id_missing"], stats["term_name_missing"], stats["entities_missing_key"], stats["extra_file_size_uncoercible"]) == (0, 1, 0, 1)
    info = d.info(source="docs").first()
    assert (info.submissions, info.file_count, info.source) == (["a"], 3, "docs")
    d.write(f"{tmp_path}/dump")
    d.write(f"{tmp_path}/dump")
    assert spark.read.parquet(f"{tmp_path}/dump/file").count() == 3 and spark.read.parquet(f"{tmp_path}/dump/dump_stat").count() == len(stats) and [x.name for x in tmp_path.iterdir()] == ["dump"]
    with pytest.raises(Exception, match="boom|USER_RAISED"):
        flatten.Dump(t | {"dcc": t["dcc"].withColumn("dcc_name", F.raise_error(F.lit("boom")).cast("string"))}, d.registries, d.counters).write(f"{tmp_path}/dump")
    assert [x.name for x in tmp_path.iterdir()] == ["dump"]
    assert [tuple(r) for r in d.registries["collection"].conflict_samples().collect()] == [("collection", "n|c1", "name", "first", "second")]
    v = views.file_view(t)
    assert v.count() == 3 and v.where("local_id = 'f1'").first().file_format_name == "F"
    b = [(r.file_local_id, r.biosample_local_id, r.subject_local_id, r.anatomy_name) for r in views.file_biosample_view(t).orderBy("file_local_id").collect()]
    assert b == [("f1", "b1", "s2", "heart"), ("f2", "b1", "s2", "heart")]
    s = {r.local_id: r for r in views.subject_demographics_view(t).collect()}
    assert (s["s2"].age, s["s2"].age_source, s["s2"].age_unit, s["s2"].race) == (3.0, "subject.age_at_sampling", None, ["r"]) and s["s1"].sex_source == "subject"


def test_flatten_checks(spark):
    lost = document("f1")
    lost["collections"] = [{"id_namespace": "n", "local_id": "", "biosamples": lost["collections"][0]["biosamples"]}]
    d = dump(spark, [lost])
    assert all(d.tables[n].count() == 0 for n in ("collection", "biosample", "subject", "file_in_collection")) and {r.name: r.value for r in d.stats().collect()}["entities_missing_key"] == 1
    with pytest.raises(IntegrityError, match="repeated file keys"):
        dump(spark, [document("f1"), document("f1")]).check()
    with pytest.raises(IntegrityError, match="two submissions"):
        dump(spark, [document("f1"), document("f2", "b")]).check()
    assert dump(spark, []).tables["file"].count() == 0


def test_registry_against_a_fold(spark):
    import random

    r = random.Random(9)
    copies = [(r.choice("abc"), r.choice(["x", "y", None]), i, r.random() < 0.3) for i in range(60)]
    rows, stubs, conflicts, created = {}, set(), 0, 0
    for k, v, _, stub in copies:
        if k not in rows:
            rows[k] = v
            created += stub
            stubs |= {k} if stub else set()
        elif stub:
            continue
        elif k in stubs:
            rows[k] = v
            stubs.discard(k)
        else:
            conflicts += rows[k] != v
    reg = Registry("t", spark.createDataFrame(copies, "k string, v string, ord int, stub boolean"), ("k",))
    assert {x.k: x.v for x in reg.rows().collect()} == rows and reg.conflicts().first().conflicts == conflicts
    assert reg.stubs_created().first()[0] == created and reg.stubs_surviving().first()[0] == len(stubs)


EXPERIMENT = {
    "File accession": " encff1 ", "File format": "bed narrowPeak", "File download URL": "https://h/files/encff1.bed.gz", "Output type": "peaks", "Assay": "ATAC-seq", "Size": "6262125716", "md5sum": "m", "File Status": "released",
    "Experiment accession": "ENCSR1", "Biosample term name": "liver", "Biosample term id": "UBERON:1", "Biosample organism": "Mus musculus", "Donor(s)": "/mouse-donors/ENCDO1/", "Lab": "L", "Run type": "single", "Age": "9",
}


def test_experiment_documents(spark):
    rows = spark.createDataFrame([EXPERIMENT, {**EXPERIMENT, "File accession": "  "}, {**EXPERIMENT, "File accession": "F2", "Biosample term name": "", "File download URL": ""}])
    a, b = enrich.experiment_documents(rows).orderBy("local_id").collect()[::-1]
    assert (a.local_id, a.accession_id, a.filename, a.size_in_bytes, a.compression_format) == ("encff1", "ENCFF1", "encff1.bed.gz", "6262125716", "format:3989")
    assert (a.file_format.id, a.data_type.id, a.assay_type.id) == ("format:3613", "data:3002", "OBI:0002039")
    c = a.collections[0]
    assert c.persistent_id.endswith("/experiments/ENCSR1/") and c.biosamples[0].local_id == "biosample:liver" and c.biosamples[0].subjects[0].taxonomy.id == "NCBI:txid10090" and c.biosamples[0].extra.encode.age == "9"
    assert a.extra.encode.run_type == "single" and b.collections == [] and b.filename == "F2.bed narrowPeak" and b.compression_format is None
    note = spark.createDataFrame([{"File accession": "F3", "Dataset accession": "ENCSR9", "Annotation type": "cCRE", "Organism": "human"}])
    n = enrich.experiment_documents(note, annotation=True).first()
    assert n.collections[0].local_id == "ENCSR9" and n.collections[0].biosamples == [] and n.extra.encode.annotation_type == "cCRE" and n.extra.encode.organism == "human"
    docs = enrich.experiment_documents(rows).withColumn("ord", F.monotonically_increasing_id())
    assert flatten.flatten(docs).tables["file"].count() == 2


def test_enrichment(spark):
    files = spark.createDataFrame([("1", "https://x/4DNFI1/", "old"), ("2", "https://x/4dnfi1/", None), ("3", "none", "keep")], "local_id string, persistent_id string, genome_assembly string")
    found = spark.createDataFrame([("4dnfi1", "GRCh38", "", "Biorep 1, Techrep 2", "K562")], "accession string, genome_assembly string, file_type string, replicate_info string, biosource_name string")
    tiers = spark.createDataFrame([("K562", "Tier 1")], "biosource_name string, cell_line_tier string")
    got = {r.local_id: r for r in enrich.enrich_files(files, found, tiers).collect()}
    assert got["1"].genome_assembly == got["2"].genome_assembly == "GRCh38" and got["3"].genome_assembly == "keep"
    assert (got["1"].biological_replicates, got["1"].technical_replicates, got["2"].cell_line_tier, got["1"].output_type) == ("1,", "2", "Tier 1", None)
    subjects = spark.createDataFrame([("hubmap", "n", "x-u2-u1"), ("hubmap", "n", "none"), ("other", "n", "y-u1"), ("hubmap", "n", "u3")], "submission string, id_namespace string, local_id string")
    first = '{"sex": ["Male"], "age_value": [41.5], "race": ["a", "b"], "medical_history": [], "social_history": ["x"], "height_unit": null, "weight_value": 80}'
    donors = spark.createDataFrame([("u1", first, 1), ("u2", '{"sex": "Female"}', 2), ("", first, 0), ("u3", '{"medical_history": []}', 3), ("none", None, 0)], "uuid string, metadata string, ord int")
    got = {r.local_id: r.extra and r.extra.hubmap for r in enrich.enrich_subjects(subjects, donors).collect()}
    x = got["x-u2-u1"]
    assert (x.sex, x.age_value, x.race, x.medical_history, x.social_history, x.height_unit, x.weight_value) == ("Male", 41.5, '["a","b"]', None, ["x"], None, 80.0)
    assert got["none"] is got["y-u1"] is got["u3"] is None


def test_collections_enriched(spark):
    schema = "submission string, local_id string, persistent_id string, accession_id string, experiment_type string, extra struct<encode:struct<project:string>,fourdn:struct<status:string>>"
    rows = [("4dn", "a", "https://x/experiments/4dnexabc1/", None, "old", (("p",), ("s",))), ("4dn", "b", "x 4DNEXABC2", None, "old", None), ("4dn", "c", None, None, "old", None), ("hubmap", "d", "10.1/x", None, "old", None), ("other", "e", "10.1/x", None, "old", None)]
    collections = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([("4dnexabc1", "L", "", "T", None), ("4DNEXABC2", "L2", "Hi-C", None, None)], "accession string, lab string, experiment_type string, display_title string, status string")
    got = {r.local_id: r for r in enrich.enrich_collections(collections.withColumn("lab", F.lit(None).cast("string")), found).collect()}
    assert (got["a"].lab, got["a"].experiment_type, got["a"].extra.fourdn.display_title, got["a"].extra.encode.project) == ("L", "old", "T", "p")
    assert (got["b"].lab, got["b"].experiment_type, got["b"].extra) == ("L2", "Hi-C", None) and got["c"].lab is None and (got["a"].accession_id, got["c"].accession_id) == ("4DNEXABC1", None)
    datasets = spark.createDataFrame([("10.1/x", "RNA", None, "P", None), (" ", "no", "no", "no", None)], "doi_url string, dataset_type string, analyte_class string, pipeline string, metadata string")
    got = {r.local_id: r for r in enrich.enrich_dataset_collections(collections.withColumn("analyte_class", F.lit("dna")), datasets).collect()}
    assert (got["d"].experiment_type, got["d"].analyte_class, got["d"].extra.hubmap.pipeline) == ("RNA", "dna", "P") and got["e"].experiment_type == "old" and got["a"].extra.encode.project == "p"


def test_dotted_updates(spark):
    df = spark.createDataFrame([(1, ("a", ("b", 1))), (2, None), (3, ("x", None))], "k int, s struct<p:string,q:struct<r:string,n:int>>")
    new = spark.createDataFrame([(1, "R", None), (2, "S", "Z"), (4, "T", "T")], "k int, r string, z string")
    got = {r.k: r.s for r in enrich.update_columns(df, new, "k", {"r": "s.q.r", "z": "s.w.z"}).collect()}
    assert (got[1].p, got[1].q.r, got[1].q.n, got[1].w) == ("a", "R", 1, None) and (got[2].p, got[2].q.r, got[2].w.z) == (None, "S", "Z") and (got[3].p, got[3].q, got[3].w) == ("x", None, None)


def test_prune(spark):
    files = spark.createDataFrame([("hubmap", "n", i, p) for i, p in (("f1", "x"), ("f2", "x"), ("f3", "d1"), ("f4", "x"))] + [("other", "n", "f5", "d1")], "submission string, id_namespace string, local_id string, persistent_id string")
    links = spark.createDataFrame([("n", "f1", "n", "c1"), ("n", "f2", "n", "c1"), ("n", "f2", "n", "c2")], "file_id_namespace string, file_local_id string, collection_id_namespace string, collection_local_id string")
    collections = spark.createDataFrame([("hubmap", "n", "c1", "d1"), ("hubmap", "n", "c2", "d2")], "submission string, id_namespace string, local_id string, persistent_id string")
    datasets = spark.createDataFrame([("d1", None), ("d2", "public")], "doi_url string, data_access_level string")
    f, kept = enrich.prune_restricted(files, links, collections, datasets)
    assert sorted(r.local_id for r in f.collect()) == ["f2", "f4", "f5"] and [r.file_local_id for r in kept.collect()] == ["f2"]
    f, kept = enrich.prune_restricted(files, links, collections, datasets.where("doi_url = 'd2'"))
    assert f.count() == 5 and kept.count() == 3


def test_dataset_file_info(spark):
    files = spark.createDataFrame([("n", "f", "dir/a.txt", [("none",), ("d1",), ("d2",)])], "id_namespace string, local_id string, filename string, collections array<struct<persistent_id:string>>")
    info = spark.createDataFrame([("d2", "p/a.txt", True, 0), ("d1", "q/a.txt", False, 1), ("d1", "r/a.txt", True, 2)], "doi_url string, rel_path string, is_data_product boolean, ord int")
    assert [tuple(r) for r in enrich.dataset_file_info(files, info).collect()] == [("n", "f", "d1", "r/a.txt", True)]


def test_slices(spark, tmp_path):
    old = spark.createDataFrame([("a", "p", 1), ("b", "p", 2)], "s string, part string, v int")
    new = spark.createDataFrame([("a", "p", 3)], "s string, part string, v int")
    assert sorted(r.v for r in slices.replace_slice(old, new, {"s": "a", "part": "p"}).collect()) == [2, 3]
    assert sorted(r.v for r in slices.upsert(old, new, ["s"]).collect()) == [2, 3]
    path = str(tmp_path / "t")
    slices.write_slices(old, path, ["s"])
    slices.write_slices(new, path, ["s"])
    slices.write_slices(new.limit(0), path, ["s"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    assert slices.drop_slice(spark, path, {"s": "b"}) and not slices.drop_slice(spark, path, {"s": "zz"})
    assert [r.v for r in spark.read.parquet(path).collect()] == [3]


def test_publish(spark, tmp_path):
    path = str(tmp_path / "p")
    slices.publish(spark.range(3), path)
    before = slices.read_current(spark, path)
    slices.publish(spark.range(5), path)
    assert (before.count(), slices.read_current(spark, path).count()) == (3, 5)
    with pytest.raises(Exception, match="boom|raise_error|USER_RAISED"):
        slices.publish(spark.range(1).select(F.raise_error(F.lit("boom"))), path)
    assert slices.read_current(spark, path).count() == 5 and len(list((tmp_path / "p").glob("v-*"))) == 2
    slices.write_clustered(spark.range(100).withColumn("s", F.col("id") % 2), str(tmp_path / "c"), "s", "id", ("id",))
    assert spark.read.parquet(str(tmp_path / "c")).where("s = 1 and id > 90").count() == 5
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, "n")], "k int, v string")
    assert sorted(tuple(r) for r in slices.changes_between(a, b, ["k"], ["v"]).collect()) == [(1, "dropped"), (3, "updated"), (4, "added")]
