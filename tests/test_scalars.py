from datetime import datetime

from pyspark.sql import functions as F

from filament.functions import ontology, scalars


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_texts(spark):
    assert apply(spark, scalars.normalize_accession, [" encff1\t", "", " ", None]) == ["ENCFF1", None, None, None]
    assert apply(spark, scalars.extract_accession, ["https://x/4dnfi1abc/", "none", None]) == ["4DNFI1ABC", None, None]
    assert apply(spark, scalars.extract_experiment_accession, ["/4DNEX12/", "4DNE1"]) == ["4DNEX12", None]
    assert apply(spark, scalars.genome_assembly, ["to hg38, then", "mm10", "xhg38", None]) == ["GRCh38", "GRCm38", None, None]
    assert apply(spark, scalars.enriched_file_format, ["a.pairs.gz", "a.MCOOL", "hic", "a.bed.gz", None]) == ["pairs", "mcool", "hic", None, None]
    assert apply(spark, scalars.donor_ids, ["/human-donors/ENCDO1/, x ,,", "", None]) == [["ENCDO1", "x"], [], []]
    assert apply(spark, lambda c: scalars.replicate(c, "Biorep"), ["Biorep 1, Techrep 2", "none"]) == ["1,", None]
    assert apply(spark, scalars.scrubbed, ["at /usr/lib/x.py line", "a/b /x", "y" * 2000]) == ["at <path> line", "a/b /x", "y" * 1024]
    assert apply(spark, scalars.redacted_url, ["https://u:p@h/x?k=1#f", "https://h/x"]) == ["https://h/x", "https://h/x"]
    assert [tuple(x) for x in apply(spark, scalars.presentation, ["u:links", "u"])] == [("u", True), ("u", False)]
    assert apply(spark, scalars.display_title, ['{"display_title": "t"}', "plain", None]) == ["t", "plain", None]


def test_compression(spark):
    names = ["a.bed.gz", "a.tgz", "a.bgz", "a.bam", "x.zip", "https://h/a.gz?x=1", "https://h/dir/", "https://h/a%2Egz", "a?b.gz", None, " ", "A.GZ"]
    assert apply(spark, scalars.compression_format, names) == ["format:3989", "format:3989", "format:3615", "", None, "format:3989", None, "format:3989", "format:3989", None, None, "format:3989"]


def test_numbers_and_times(spark):
    assert apply(spark, scalars.parse_int, [" 5 ", "+7", "1_000", "12.0", "x", "", None, "9" * 30]) == [5, 7, None, None, None, None, None, None]
    times = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02 03:04-0330", "x", "2024-13-01", None]
    assert apply(spark, scalars.timestamp_utc, times) == [datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5, 500000), datetime(2024, 1, 2, 6, 34), None, None, None]


def test_ranges(spark):
    f = lambda c: scalars.byte_range(c, F.lit(100))
    got = apply(spark, f, ["bytes=0-9", "bytes=90-", "bytes=-10", "bytes=-500", "bytes=50-500", "bytes=100-", "bytes=9-3", "bytes=-0", "bytes=-", "x", None])
    assert [tuple(x) if x else None for x in got] == [(0, 9), (90, 99), (90, 99), (0, 99), (50, 99), None, None, None, None, None, None]


def test_keys(spark):
    md5 = "A" * 32
    df = spark.createDataFrame([(" ENC ", "f1", md5), ("enc", "a/b", md5), ("", "f", md5), ("e", "f", "zz"), ("e", None, md5)], "d string, i string, m string")
    got = df.select(scalars.workflow_key(F.col("d"), F.col("i"), F.col("m"), 3), scalars.cache_key(F.col("d"), F.col("i"), "index", F.col("m"), 2)).collect()
    assert tuple(got[0]) == (f"enc/f1/{'a' * 32}/v3", f"enc/f1/index/{'a' * 32}-v2") and all(tuple(r) == (None, None) for r in got[1:])


def test_settings():
    assert scalars.env_list(None, ["a"]) == ["a"] and scalars.env_list("", ["a"]) == [] and scalars.env_list(" b, a,,b ", []) == ["b", "a"]
    assert scalars.memory_cap("256M") and not scalars.memory_cap("256MB")


def test_json(spark):
    assert apply(spark, scalars.canonical_json, ['{"b": "1", "a": "2"}', None, '{"b":1,"a":{"z":true,"c":[1,2.50,{"y":null,"x":"t"}]}}', '{"a":{"c":[1,2.50,{"x":"t","y":null}],"z":true},"b":1}', "{", "[1]"]) == [
        '{"a":"2","b":"1"}', None, *['{"a":{"c":[1,2.5,{"x":"t","y":null}],"z":true},"b":1}'] * 2, None, "[1]",
    ]
    assert apply(spark, scalars.single_or_self, ['["a"]', '["a","b"]', "[]", "x", None, "[1.5]", '[{"a":1}]', "7", '["1"', "[null]"]) == ["a", '["a","b"]', "[]", "x", None, "1.5", '{"a":1}', "7", '["1"', None]


def test_vocabularies(spark):
    assert (len(ontology.FORMAT_TERMS), len(ontology.OUTPUT_TERMS), len(ontology.ASSAY_TERMS), len(ontology.ORGANISM_TERMS)) == (44, 59, 63, 6)
    got = apply(spark, ontology.file_format, ["BED narrowPeak", "bed  bed3+", "FASTQ", "nope", " ", None])
    assert [x.id if x else None for x in got] == ["format:3613", "format:3003", "format:1930", None, None, None]
    assert apply(spark, ontology.taxonomy, ["mouse"])[0].clade == "species"
    assert apply(spark, ontology.output_type, ["peaks", "Peaks"])[1] is None and apply(spark, ontology.assay_type, ["5C"])[0].id == "OBI:0001916"
