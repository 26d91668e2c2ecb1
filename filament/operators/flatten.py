"""Nested file documents flattened into relational tables.

The documents (file_type()) are exploded level by level once; each entity table is the
registry of all copies found there, junctions are distinct pairs, extensions are rows beside
their parent where any value is set. Rows of a table depend on the order of documents only
through the first copy of a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filament.functions.scalars import canonical_json, parse_int, timestamp_utc
from filament.operators.integrity import duplicate_keys, missing_parents, not_one_to_one, require_none
from filament.operators.materialize import Parts
from filament.operators.ordered import first_wins
from filament.operators.registry import Registry
from filament.operators.slices import replace_folder
from filament.runtime import Lazy, deleted, persisted

KEY = ("id_namespace", "local_id")


def _struct(spec: str, **more: T.DataType) -> T.StructType:
    """A struct of text fields named in spec, and further ones."""
    return T.StructType([*(T.StructField(n, T.StringType()) for n in spec.split()), *(T.StructField(n, t) for n, t in more.items())])


_LIST = T.ArrayType(T.StringType())
# The members of the documents.
TERM = _struct("id name description")
TAXON = _struct("id name clade description")
PROJECT = _struct("id_namespace local_id name abbreviation description persistent_id")
DCC = _struct("id dcc_name dcc_abbreviation dcc_description contact_email contact_name dcc_url project_id_namespace project_local_id")
SUBJECT_HUBMAP = _struct(
    "age_unit sex race body_mass_index_unit cause_of_death death_event mechanism_of_injury height_unit weight_unit",
    age_value=T.DoubleType(), body_mass_index_value=T.DoubleType(), height_value=T.DoubleType(), weight_value=T.DoubleType(), medical_history=_LIST, social_history=_LIST,
)
SUBJECT = _struct(
    "id_namespace local_id project_id_namespace project_local_id persistent_id creation_time granularity sex ethnicity",
    age_at_enrollment=T.DoubleType(), age_at_sampling=T.DoubleType(), race=_LIST, taxonomy=TAXON, extra=T.StructType([T.StructField("hubmap", SUBJECT_HUBMAP)]),
)
BIOSAMPLE_ENCODE = _struct(
    "biosample_type life_stage age age_units biosample_treatments biosample_treatments_amount biosample_treatments_duration biosample_genetic_modifications "
    "library_made_from library_depleted_in library_extraction_method library_lysis_method library_crosslinking_method library_strand_specific library_fragmentation_method library_size_range"
)
BIOSAMPLE = _struct(
    "id_namespace local_id project_id_namespace project_local_id persistent_id creation_time sample_prep_method biofluid",
    anatomy=TERM, subjects=T.ArrayType(SUBJECT), extra=T.StructType([T.StructField("encode", BIOSAMPLE_ENCODE)]),
)
COLLECTION_FOURDN = _struct(
    "display_title digestion_enzyme crosslinking_method crosslinking_temperature crosslinking_time ligation_temperature ligation_volume ligation_time digestion_temperature digestion_time "
    "tagging_method fragmentation_method biotin_removed library_prep_kit average_fragment_size fragment_size_range status date_created",
    targeted_factor=_LIST,
)
COLLECTION_ENCODE = _struct("project platform dbxrefs rbns_protein_concentration annotation_type software_used encyclopedia_version")
COLLECTION_HUBMAP = _struct("pipeline processing group_name metadata", visualization=T.BooleanType(), vitessce_hints=_LIST)
COLLECTION = _struct(
    "id_namespace local_id accession_id persistent_id creation_time abbreviation name description lab experiment_type experiment_target analyte_class",
    anatomy=T.ArrayType(TERM), biosamples=T.ArrayType(BIOSAMPLE), subjects=T.ArrayType(SUBJECT),
    extra=T.StructType([T.StructField("fourdn", COLLECTION_FOURDN), T.StructField("encode", COLLECTION_ENCODE), T.StructField("hubmap", COLLECTION_HUBMAP)]),
)
EXTRA_FILE = _struct("href md5sum file_size file_format")
FILE_FOURDN = _struct("enriched_file_format dataset biosource_name replicate_info cell_line_tier", extra_files=T.ArrayType(EXTRA_FILE))
FILE_ENCODE = _struct(
    "annotation_type organism controlled_by s3_uri azure_url file_analysis_title file_analysis_status read_length mapped_read_length run_type paired_end paired_with index_of derived_from "
    "audit_warning audit_not_compliant audit_error"
)
FILE_HUBMAP = _struct("rel_path", is_data_product=T.BooleanType())
FILE_COLUMNS = (
    "accession_id filename persistent_id creation_time size_in_bytes sha256 md5 compression_format analysis_type mime_type project_id_namespace project_local_id bundle_collection_id_namespace bundle_collection_local_id "
    "dbgap_study_id access_url status data_access_level genome_assembly genome_annotation output_type output_type_detail biological_replicates technical_replicates assay_info condition"
)
FILE = _struct(
    f"id_namespace local_id submission {FILE_COLUMNS}",
    dcc=DCC, project=PROJECT, file_format=TERM, data_type=TERM, assay_type=TERM, collections=T.ArrayType(COLLECTION),
    extra=T.StructType([T.StructField("fourdn", FILE_FOURDN), T.StructField("encode", FILE_ENCODE), T.StructField("hubmap", FILE_HUBMAP)]),
)


def conform(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value in another type of the same shape: members by name, those that are missing null, others dropped."""
    if isinstance(want, T.StructType):
        names = {f.name: f.dataType for f in have.fields}
        none = lambda f: F.lit(None).cast(f.dataType)
        members = F.struct(*((conform(c[f.name], names[f.name], f.dataType) if f.name in names else none(f)).alias(f.name) for f in want.fields))
        return F.when(c.isNotNull(), members)
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: conform(x, have.elementType, want.elementType))
    return c.cast(want)


def as_documents(df: DataFrame, *more: str) -> DataFrame:
    """Rows as documents of type FILE (missing members null, others dropped), and further columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [conform(F.col(f.name), kinds[f.name], f.dataType).alias(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name) for f in FILE.fields]
    return df.select(*columns, *more)


def _any(struct: Column) -> Column:
    """Whether any member of a struct is set.

    One look at the whole struct: a condition on each member would be rewritten in terms of
    every subset of the columns selected from it.
    """
    return F.to_json(struct) != "{}"


def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _good_term(t: str) -> Column:
    return F.coalesce(F.col(f"{t}.id") != "", F.lit(False)) & F.coalesce(F.col(f"{t}.name") != "", F.lit(False))


#: Version of the tables' layout.
SCHEMA_VERSION = 1


def _bad_terms(t: str) -> tuple[Column, Column]:
    """Whether a term that is there has no id, and whether it has an id but no name."""
    there, no_id = F.col(t).isNotNull(), F.coalesce(F.col(f"{t}.id"), F.lit("")) == ""
    return there & no_id, there & ~no_id & (F.coalesce(F.col(f"{t}.name"), F.lit("")) == "")


def _term_counts(*terms: str) -> dict[str, Column]:
    bad = [_bad_terms(t) for t in terms]
    return {n: reduce(lambda a, b: a + b, (x[i].cast("long") for x in bad)) for i, n in enumerate(("term_id_missing", "term_name_missing"))}


def _half(ns: str, lid: str) -> Column:
    """Whether one half of a key is blank."""
    return _blank_null(F.col(ns)).isNull() != _blank_null(F.col(lid)).isNull()


def _lost(text: str, read: Column) -> Column:
    """Whether a text that is not blank could not be read."""
    return F.coalesce(F.trim(text) != "", F.lit(False)) & read.isNull()


def _term_id(t: str) -> Column:
    return F.when(_good_term(t), F.col(f"{t}.id"))


@dataclass
class Dump:
    """Tables by name, their registries, and the counters; each made when it is asked for."""

    tables: Mapping[str, DataFrame]
    registries: Mapping[str, Registry]
    counters: Callable[[], list[tuple[DataFrame, dict[str, Column]]]] = list

    def check(self) -> None:
        """Raise for what the relational model rules out: repeated file keys, keys under two submissions, centres that do not go one to one with submissions, missing parents."""
        require_none(duplicate_keys(self.tables["file"], list(KEY), "submission"), "repeated file keys")
        require_none(not_one_to_one(self.registries["dcc"].copies, "submission", "id"), "submission and dcc id are not one to one")
        for name in ("project", "collection", "biosample", "subject"):
            require_none(self.registries[name].two_submissions(), f"{name} keys under two submissions")
        for child, foreign, parent, keys in FOREIGN_KEYS:
            require_none(missing_parents(self.tables[child], foreign, self.tables[parent], keys), f"{child} {foreign} without {parent}")

    def stats(self) -> DataFrame:
        """(name, value): rows_<table>, conflicts_<table> and the counters, as one plan of small aggregates."""

        def named(df: DataFrame, names: dict[str, Column]) -> DataFrame:
            return df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("long").alias("value")) for n, c in names.items()))))

        parts = []
        for name, r in self.registries.items():
            of = {f"rows_{name}": F.col("rows")} | ({f"conflicts_{name}": F.col("conflicts")} if r.columns else {})
            if name == "project":
                of |= {"project_stubs_created": F.col("stubs_created"), "project_stubs_surviving": F.col("stubs_surviving")}
            parts.append(named(r.summary(), of))
        parts += [named(t.agg(F.count("*").alias("n")), {f"rows_{n}": F.col("n")}) for n, t in self.tables.items() if n not in self.registries]
        for df, counts in self.counters():
            times = F.col("_n") if "_n" in df.columns else F.lit(1)
            parts.append(named(df.agg(*(F.coalesce(F.sum(c.cast("long") * times), F.lit(0)).alias(n) for n, c in counts.items())), {n: F.col(n) for n in counts}))
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("name").agg(F.sum("value").alias("value"))

    def info(self, **more: str) -> DataFrame:
        """One row about the dump: schema version, time, its submissions in order and number of files, and what more is given."""
        of = self.tables["file"].agg(F.coalesce(F.array_sort(F.collect_set("submission")), F.array().cast("array<string>")).alias("submissions"), F.count("*").alias("file_count"))  # as many as centres
        return of.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("generated_at"), "*", *(F.lit(v).alias(k) for k, v in more.items()))

    def conflict_samples(self, most: int = 1000) -> DataFrame:
        return reduce(DataFrame.unionByName, (r.conflict_samples(most) for r in self.registries.values() if r.columns))

    def write(self, path: str) -> None:
        """Every table as Parquet under path, with dump_stat and dump_info. The folder is there as a whole or not at all: it is written beside and renamed, and what a failure leaves is deleted."""
        every = self.tables | {"dump_stat": self.stats(), "dump_info": self.info()}
        spark = self.tables["file"].sparkSession
        part = f"{path}.part-{uuid.uuid4().hex}"
        try:
            for name, t in every.items():
                t.write.parquet(f"{part}/{name}")
            replace_folder(spark, part, path)
        except BaseException:
            deleted(spark, part)
            raise


def _pair(side: str) -> list[str]:
    return [f"{side}_{c}" for c in KEY]


#: Child table, its columns, parent table, its key.
FOREIGN_KEYS = (
    ("file", ["submission"], "dcc", ["submission"]),
    ("file", ["project_id_namespace", "project_local_id"], "project", list(KEY)),
    ("file", ["file_format"], "file_format", ["id"]),
    ("file", ["data_type"], "data_type", ["id"]),
    ("file", ["assay_type"], "assay_type", ["id"]),
    ("biosample", ["anatomy"], "anatomy", ["id"]),
    ("subject", ["taxonomy"], "ncbi_taxonomy", ["id"]),
    *((j, _pair(s), s, list(KEY)) for j, sides in (("file_in_collection", ("file", "collection")), ("biosample_in_collection", ("biosample", "collection")), ("subject_in_collection", ("subject", "collection")), ("biosample_from_subject", ("biosample", "subject"))) for s in sides),
    ("collection_anatomy", _pair("collection"), "collection", list(KEY)),
    ("collection_anatomy", ["anatomy"], "anatomy", ["id"]),
    ("subject_race", _pair("subject"), "subject", list(KEY)),
)


def _keyed(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) != "", F.lit(False)) for c in columns))


def _valid() -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("submission", "id_namespace", "local_id", "dcc.id")))


def flatten(docs: DataFrame) -> Dump:
    """The relational tables of documents of type FILE with an ord column (persist it: copies are ranked by it).

    Documents without submission, key or dcc id are left out and counted as invalid. Sizes
    and times that cannot be read are null and counted. A project key of which one half is
    blank is null and counted; a key whose project object is not in the document makes a
    stub. Terms without id or name are null and counted. Collections, biosamples and subjects without a
    whole key are left out with all they hold, and counted.
    """
    f = docs.where(_valid())
    # each level's objects with their order: document, then place in the arrays
    then = lambda *cs: F.concat("ord", F.array(*((F.lit(c) if isinstance(c, int) else F.col(c)).cast("long") for c in cs)))
    one = F.lit(1).cast("long").alias("_n")

    def cs() -> DataFrame:
        rows = f.select("submission", *(F.col(k).alias(f"file_{k}") for k in KEY), F.array(F.col("ord").cast("long")).alias("ord"), one, F.posexplode("collections").alias("i", "c"))
        return rows.withColumn("ord", then("i")).where(F.col("c").isNotNull())

    def bs() -> DataFrame:
        rows = of["cs"].select("submission", "ord", "_n", F.col("c.id_namespace").alias("c_ns"), F.col("c.local_id").alias("c_id"), F.posexplode("c.biosamples").alias("j", "b"))
        return rows.withColumn("ord", then(1, "j")).where(F.col("b").isNotNull())

    def s1() -> DataFrame:
        rows = of["bs"].select("submission", "ord", "_n", F.col("c_ns").alias("g_ns"), F.col("c_id").alias("g_id"), F.col("b.id_namespace").alias("p_ns"), F.col("b.local_id").alias("p_id"), F.posexplode("b.subjects").alias("k", "s"))
        return rows.withColumn("ord", then("k")).where(F.col("s").isNotNull())

    def s2() -> DataFrame:
        rows = of["cs"].select("submission", "ord", "_n", F.col("c.id_namespace").alias("p_ns"), F.col("c.local_id").alias("p_id"), F.posexplode("c.subjects").alias("k", "s"))
        return rows.withColumn("ord", then(2, "k")).where(F.col("s").isNotNull())

    named = {"cs": (cs, "collections"), "bs": (bs, "biosamples"), "s1": (s1, "biosample-subjects"), "s2": (s2, "collection-subjects")}
    of = Lazy({k: lambda make=make, what=what: persisted(make(), what) for k, (make, what) in named.items()})  # read by many tables
    return _tables(lambda: docs, of)


def flatten_parts(parts: Parts, stored: bool = False, linked: bool = False) -> Dump:
    """The tables that flatten gives for the documents of parts, without making these: what many files hold is one row with the number and first place of its copies. Only conflict samples need the documents. stored: files with their terms are written first, for what reads them many times (stats). linked: the files' links are written first, for what reads all junctions."""

    @cache
    def docs() -> DataFrame:
        df = as_documents(parts.with_terms(parts.files), "ord")
        return persisted(df, "files") if stored else df

    kept = parts.of_files(parts.with_dcc(parts.files).where(_valid()).drop("dcc"))

    if linked:
        _ = kept.linked

    def typed(df: DataFrame, x: str, kind: T.StructType, **more: str) -> DataFrame:
        return df.select("submission", "ord", *(c for c in ("_n",) if c in df.columns), *(F.col(c).alias(k) for k, c in more.items()), conform(F.col(x), df.schema[x].dataType, kind).alias(x))

    c_key = {"ns": "collection_id_namespace", "id": "collection_local_id"}
    b_key = {"ns": "biosample_id_namespace", "id": "biosample_local_id"}
    as_ = lambda x, key: {f"{x}_{k}": v for k, v in key.items()}
    of = {
        "cs": lambda: typed(kept.collection_copies, "c", COLLECTION), "bs": lambda: typed(kept.biosample_copies, "b", BIOSAMPLE, **as_("c", c_key)),
        "s1": lambda: typed(kept.sampled_copies, "s", SUBJECT, **as_("g", c_key), **as_("p", b_key)), "s2": lambda: typed(kept.subject_copies, "s", SUBJECT, **as_("p", c_key)),
    }
    firsts = {"collection": lambda: typed(kept.collection_firsts, "c", COLLECTION), "biosample": lambda: typed(kept.biosample_firsts, "b", BIOSAMPLE), "subject": lambda: typed(kept.subject_firsts, "s", SUBJECT)}

    def from_subject() -> DataFrame:
        return kept.sampled().join(kept.members("biosample"), _pair("biosample"), "left_semi")

    def races() -> DataFrame:
        there = kept.members("subject").select(*_pair("subject")).unionByName(from_subject().select(*_pair("subject"))).distinct()
        return kept.races.where(F.coalesce(F.col("race") != "", F.lit(False))).distinct().join(there, _pair("subject"), "left_semi")

    def anatomy_links() -> DataFrame:
        return kept.anatomy_pairs.where(_good_term("anatomy")).select(*_pair("collection"), F.col("anatomy.id").alias("anatomy")).distinct()

    def first_terms(df: DataFrame, t: str, kind: T.StructType) -> DataFrame:
        rows = df.select("ord", conform(F.col(t), df.schema[t].dataType, kind).alias(t)).where(_good_term(t))
        return first_wins(rows.select("ord", f"{t}.*"), ["id"], ["ord"]).drop("ord")

    links = {
        "anatomy": lambda: first_terms(kept.anatomy_places, "anatomy", TERM),
        "ncbi_taxonomy": lambda: first_terms(kept.taxonomy_places, "taxonomy", TAXON),
        "file_in_collection": lambda: kept.held_pairs.select(*_pair("file"), *_pair("collection")),
        "biosample_in_collection": lambda: kept.members("biosample").select(*_pair("biosample"), *_pair("collection")).distinct(),
        "subject_in_collection": lambda: kept.members("subject").select(*_pair("subject"), *_pair("collection")).distinct(),
        "biosample_from_subject": lambda: from_subject().select(*_pair("biosample"), *_pair("subject")).distinct(),
        "collection_anatomy": anatomy_links,
        "subject_race": races,
    }
    whole = cache(lambda: flatten(persisted(as_documents(parts.with_terms(parts.with_collections(parts.files)), "ord"), "documents")))
    return _tables(docs, Lazy({k: lambda k=k, make=make: persisted(make(), k) for k, make in of.items()}), links, whole, firsts)


def _tables(docs: Callable[[], DataFrame], of: Lazy, links: Mapping[str, Callable[[], DataFrame]] | None = None, whole: Callable[[], Dump] | None = None, firsts: Mapping[str, Callable[[], DataFrame]] | None = None) -> Dump:
    """of: the copies of collections (cs), biosamples (bs), subjects of biosamples (s1) and of collections (s2) with submission, ord, _n and keys of what holds them. links: junctions and terms that are not made from these. whole: the dump whose copies are not counted, if these are. firsts: the first copy of each key of collections, biosamples and subjects, if these are known without the others."""
    f = cache(lambda: docs().where(_valid()))
    time_lost = lambda c: {"creation_time_unparseable": _lost(c, timestamp_utc(F.col(c)))}
    half_project = lambda at: {"project_fk_incomplete": _half(f"{at}project_id_namespace", f"{at}project_local_id")}

    # what has no key is counted and left out, and so is all that it holds
    holders = {"cs": None, "bs": ("c_ns", "c_id"), "s1": ("g_ns", "g_id", "p_ns", "p_id"), "s2": ("p_ns", "p_id")}
    inside = lambda x: of[x].where(_keyed(*holders[x])) if holders[x] else of[x]
    whole_key = lambda x: _keyed(f"{x[0]}.id_namespace", f"{x[0]}.local_id")
    keyed = cache(lambda x: inside(x).where(whole_key(x)))

    @cache
    def subjects() -> DataFrame:
        return keyed("s1").unionByName(keyed("s2").withColumns({"g_ns": F.lit(None).cast("string"), "g_id": F.lit(None).cast("string")}))

    def counters() -> list[tuple[DataFrame, dict[str, Column]]]:
        cs, bs, ss = keyed("cs"), keyed("bs"), subjects()
        return [
            (docs(), {"documents_invalid": ~_valid()}),
            (f(), {"size_in_bytes_uncoercible": _lost("size_in_bytes", parse_int(F.col("size_in_bytes")))} | time_lost("creation_time") | half_project("") | _term_counts("file_format", "data_type", "assay_type")),
            *((inside(x), {"entities_missing_key": ~whole_key(x)}) for x in holders),
            (cs, time_lost("c.creation_time") | {"date_created_unparseable": _lost("c.extra.fourdn.date_created", timestamp_utc(F.col("c.extra.fourdn.date_created")))}),
            (cs.select("_n", F.explode("c.anatomy").alias("a")), _term_counts("a")),
            (bs, time_lost("b.creation_time") | half_project("b.") | _term_counts("b.anatomy")),
            (ss, time_lost("s.creation_time") | half_project("s.") | _term_counts("s.taxonomy")),
            (f().select(F.explode("extra.fourdn.extra_files").alias("x")), {"extra_file_size_uncoercible": _lost("x.file_size", parse_int(F.col("x.file_size")))}),
        ]

    stub = F.lit(False).alias("stub")

    def entity(df: DataFrame, x: str, columns: list[str], **other: Column) -> DataFrame:
        return df.select(*(F.col(f"{x}.{k}").alias(k) for k in KEY), "submission", *(F.col(f"{x}.{c}").alias(c) for c in columns), *(v.alias(k) for k, v in other.items()), "ord", stub, *(c for c in ("_n",) if c in df.columns))

    def extension(df: DataFrame, x: str, kind: T.StructType, skip: tuple[str, ...] = (), **other: Column) -> DataFrame:
        names = [n for n in kind.names if n not in skip and n not in other]
        rows = df.where(_any(F.col(x).dropFields(*skip) if skip else F.col(x)))
        return rows.select(*(F.col(k).alias(a) for a, k in zip(KEY, KEYS[x.split(".")[0]], strict=True)), *(F.col(f"{x}.{c}").alias(c) for c in names), *(v.alias(k) for k, v in other.items()), "ord", stub, *(c for c in ("_n",) if c in df.columns))

    KEYS = {"extra": KEY, "c": tuple(f"c.{k}" for k in KEY), "b": tuple(f"b.{k}" for k in KEY), "s": tuple(f"s.{k}" for k in KEY)}

    def of_files(df: DataFrame) -> DataFrame:
        """Copies that files hold: equal ones counted, or each one by itself."""
        if whole:
            df = df.groupBy(*(c for c in df.columns if c != "ord")).agg(F.min("ord").alias("ord"), F.count("*").alias("_n"))
        else:
            df = df.withColumn("_n", F.lit(1).cast("long"))
        return df.withColumn("ord", F.array(F.col("ord").cast("long")))

    def projects(df: DataFrame, ns: str, lid: str) -> DataFrame:
        """Stubs of the project keys that a row names."""
        rows = df.select(_blank_null(F.col(ns)).alias("id_namespace"), _blank_null(F.col(lid)).alias("local_id"), "submission", *(F.lit(None).cast("string").alias(c) for c in ("name", "abbreviation", "description", "persistent_id")), "ord", F.lit(True).alias("stub"), *(c for c in ("_n",) if c in df.columns))
        return rows.where(F.col("id_namespace").isNotNull() & F.col("local_id").isNotNull())

    same = (F.col("project.id_namespace") == F.col("project_id_namespace")) & (F.col("project.local_id") == F.col("project_local_id"))

    def project_copies() -> DataFrame:
        real = f().where(same).select(*(F.col(f"project.{k}").alias(k) for k in KEY), "submission", _blank_null(F.col("project.name")).alias("name"), *(F.col(f"project.{c}").alias(c) for c in ("abbreviation", "description", "persistent_id")), "ord", stub)
        stubs = projects(f().where(~F.coalesce(same, F.lit(False))), "project_id_namespace", "project_local_id")
        out = of_files(real).unionByName(of_files(stubs))
        return out.unionByName(projects(keyed("bs"), "b.project_id_namespace", "b.project_local_id")).unionByName(projects(subjects(), "s.project_id_namespace", "s.project_local_id"))

    def terms(df: DataFrame, t: str, columns: list[str]) -> DataFrame:
        return df.where(_good_term(t)).select(*(F.col(f"{t}.{c}").alias(c) for c in columns), "ord", stub, *(c for c in ("_n",) if c in df.columns))

    one = TERM.names
    anatomies = lambda: terms(keyed("bs"), "b.anatomy", one).unionByName(terms(keyed("cs").select("ord", "_n", F.explode("c.anatomy").alias("a")), "a", one))
    full = lambda ns, lid: (F.when(_blank_null(F.col(ns)).isNotNull() & _blank_null(F.col(lid)).isNotNull(), F.col(ns)), F.when(_blank_null(F.col(ns)).isNotNull() & _blank_null(F.col(lid)).isNotNull(), F.col(lid)))
    b_ns, b_id = full("b.project_id_namespace", "b.project_local_id")
    s_ns, s_id = full("s.project_id_namespace", "s.project_local_id")
    f_ns, f_id = full("project_id_namespace", "project_local_id")

    # fmt: off
    entities = {
        "collection": (lambda: keyed("cs"), "c", lambda df: entity(df, "c", "accession_id persistent_id abbreviation name description lab experiment_type experiment_target analyte_class".split(), creation_time=timestamp_utc(F.col("c.creation_time")))),
        "biosample": (lambda: keyed("bs"), "b", lambda df: entity(df, "b", ["persistent_id", "sample_prep_method", "biofluid"], project_id_namespace=b_ns, project_local_id=b_id, creation_time=timestamp_utc(F.col("b.creation_time")), anatomy=_term_id("b.anatomy"))),
        "subject": (subjects, "s", lambda df: entity(df, "s", "persistent_id granularity sex ethnicity age_at_enrollment age_at_sampling".split(), project_id_namespace=s_ns, project_local_id=s_id, creation_time=timestamp_utc(F.col("s.creation_time")), taxonomy=_term_id("s.taxonomy"))),
    }
    # fmt: on
    copies = {
        "dcc": (lambda: of_files(f().select("dcc.id", "submission", *(f"dcc.{c}" for c in DCC.names[1:]), "ord", stub)), ("id",)),
        "project": (project_copies, KEY),
        "file_format": (lambda: of_files(terms(f(), "file_format", one)), ("id",)),
        "data_type": (lambda: of_files(terms(f(), "data_type", one)), ("id",)),
        "assay_type": (lambda: of_files(terms(f(), "assay_type", one)), ("id",)),
        "anatomy": (anatomies, ("id",)),
        "ncbi_taxonomy": (lambda: terms(subjects(), "s.taxonomy", TAXON.names), ("id",)),
        **{n: (lambda df=df, row=row: row(df()), KEY) for n, (df, _, row) in entities.items()},
        "collection_extra_fourdn": (lambda: extension(keyed("cs"), "c.extra.fourdn", COLLECTION_FOURDN, date_created=timestamp_utc(F.col("c.extra.fourdn.date_created"))), KEY),
        "collection_extra_encode": (lambda: extension(keyed("cs"), "c.extra.encode", COLLECTION_ENCODE), KEY),
        "collection_extra_hubmap": (lambda: extension(keyed("cs"), "c.extra.hubmap", COLLECTION_HUBMAP, metadata=canonical_json(F.col("c.extra.hubmap.metadata"))), KEY),
        "biosample_extra_encode": (lambda: extension(keyed("bs"), "b.extra.encode", BIOSAMPLE_ENCODE), KEY),
        "subject_extra_hubmap": (lambda: extension(subjects(), "s.extra.hubmap", SUBJECT_HUBMAP), KEY),
    }
    each = lambda n: (lambda: whole().registries[n].copies) if whole else None
    registries = Lazy({n: lambda n=n, make=make, keys=keys: Registry(n, make(), keys, each(n)) for n, (make, keys) in copies.items()})
    promoted = [c for c in FILE_COLUMNS.split() if c not in ("creation_time", "size_in_bytes", "project_id_namespace", "project_local_id")]
    # fmt: off
    files = lambda: f().select(
        *KEY, "submission", *promoted, timestamp_utc(F.col("creation_time")).alias("creation_time"), parse_int(F.col("size_in_bytes")).alias("size_in_bytes"),
        *(_term_id(t).alias(t) for t in ("file_format", "data_type", "assay_type")), f_ns.alias("project_id_namespace"), f_id.alias("project_local_id"),
    )
    # fmt: on
    link = lambda df, a, b, *names: df.select(*(F.col(x).alias(y) for x, y in zip((*a, *b), names, strict=True))).distinct()

    def anatomy_links() -> DataFrame:
        ca = keyed("cs").select(F.col("c.id_namespace").alias("collection_id_namespace"), F.col("c.local_id").alias("collection_local_id"), F.explode("c.anatomy").alias("a"))
        return ca.where(_good_term("a")).select(*_pair("collection"), F.col("a.id").alias("anatomy")).distinct()

    def races() -> DataFrame:
        sr = subjects().select(F.col("s.id_namespace").alias("subject_id_namespace"), F.col("s.local_id").alias("subject_local_id"), F.explode("s.race").alias("race"))
        return sr.where(F.coalesce(F.col("race") != "", F.lit(False))).distinct()

    def extra_files() -> DataFrame:
        xs = f().select(*KEY, F.posexplode("extra.fourdn.extra_files").alias("ordinal", "x"))
        return xs.select(*KEY, "ordinal", "x.href", "x.md5sum", parse_int(F.col("x.file_size")).alias("file_size"), "x.file_format")

    tables = {n: lambda n=n: registries[n].rows() for n in registries} | {
        "file": files,
        "file_in_collection": lambda: link(keyed("cs"), _pair("file"), ("c.id_namespace", "c.local_id"), *_pair("file"), *_pair("collection")),
        "biosample_in_collection": lambda: link(keyed("bs"), ("b.id_namespace", "b.local_id"), ("c_ns", "c_id"), *_pair("biosample"), *_pair("collection")),
        "subject_in_collection": lambda: link(keyed("s2"), ("s.id_namespace", "s.local_id"), ("p_ns", "p_id"), *_pair("subject"), *_pair("collection")),
        "biosample_from_subject": lambda: link(keyed("s1"), ("p_ns", "p_id"), ("s.id_namespace", "s.local_id"), *_pair("biosample"), *_pair("subject")),
        "collection_anatomy": anatomy_links,
        "subject_race": races,
        "file_extra_fourdn": lambda: extension(f(), "extra.fourdn", FILE_FOURDN, skip=("extra_files",)).drop("ord", "stub"),
        "file_extra_fourdn_extra_file": extra_files,
        "file_extra_encode": lambda: extension(f(), "extra.encode", FILE_ENCODE).drop("ord", "stub"),
        "file_extra_hubmap": lambda: extension(f(), "extra.hubmap", FILE_HUBMAP).drop("ord", "stub"),
    }
    for n, first in (firsts or {}).items():
        _, x, row = entities[n]
        tables[n] = lambda first=first, x=x, row=row: row(first().where(_keyed(f"{x}.id_namespace", f"{x}.local_id"))).drop("ord", "stub")
    return Dump(Lazy(tables | dict(links or {})), registries, counters)
