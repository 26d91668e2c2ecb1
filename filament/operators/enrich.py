"""Rows of experiment metadata as file documents, and documents enriched from search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filament.functions import ontology, scalars
from filament.functions.scalars import nonempty
from filament.operators import flatten
from filament.operators.ordered import first_contained, first_wins, last_wins


NAMESPACE, SITE = "https://www.encodeproject.org/", "https://www.encodeproject.org"

# Columns of annotation metadata and the experiment columns that hold the same.
ANNOTATION_COLUMNS = {
    "Dataset accession": "Experiment accession", "Assay term name": "Assay", "Assembly": "File assembly",
    "Dataset date released": "Experiment date released", "S3 URL": "s3_uri", "Organism": "Biosample organism",
}
# Document members and the metadata columns they are taken from.
PROMOTED = {"genome_assembly": "File assembly", "genome_annotation": "Genome annotation", "output_type": "Output type", "output_type_detail": "File format type", "biological_replicates": "Biological replicate(s)", "technical_replicates": "Technical replicate(s)"}
FILE_EXTRA = {
    "organism": "Biosample organism", "controlled_by": "Controlled by", "s3_uri": "s3_uri", "azure_url": "Azure URL", "file_analysis_title": "File analysis title", "file_analysis_status": "File analysis status",
    "read_length": "Read length", "mapped_read_length": "Mapped read length", "run_type": "Run type", "paired_end": "Paired end", "paired_with": "Paired with", "index_of": "Index of", "derived_from": "Derived from",
    "audit_warning": "Audit WARNING", "audit_not_compliant": "Audit NOT_COMPLIANT", "audit_error": "Audit ERROR",
}
BIOSAMPLE_EXTRA = {
    "biosample_type": "Biosample type", "life_stage": "Life stage", "age": "Age", "age_units": "Age units", "biosample_treatments": "Biosample treatments", "biosample_treatments_amount": "Biosample treatments amount",
    "biosample_treatments_duration": "Biosample treatments duration", "biosample_genetic_modifications": "Biosample genetic modifications methods/categories/targets/gene targets/site coordinates/zygosity",
    "library_made_from": "Library made from", "library_depleted_in": "Library depleted in", "library_extraction_method": "Library extraction method", "library_lysis_method": "Library lysis method",
    "library_crosslinking_method": "Library crosslinking method", "library_strand_specific": "Library strand specific", "library_fragmentation_method": "Library fragmentation method", "library_size_range": "Library size range",
}
COLLECTION_EXTRA = {"project": "Project", "platform": "Platform", "dbxrefs": "dbxrefs", "rbns_protein_concentration": "RBNS protein concentration", "annotation_type": "Annotation type", "software_used": "Software used", "encyclopedia_version": "Encyclopedia Version"}


def _conform(values: dict[str, Column], kind) -> Column:
    """A struct of a document type: the values given, the other members null."""
    return F.struct(*(values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))


def _if_any(struct: Column, values: list[Column]) -> Column:
    return F.when(reduce(lambda a, b: a | b, (v.isNotNull() for v in values)), struct)


def experiment_documents(rows: DataFrame, annotation: bool = False, dcc: dict[str, str] | None = None) -> DataFrame:
    """Rows of tab-separated experiment (or annotation) metadata as documents of type FILE.

    Rows without file accession are left out; columns that are not there count as blank. A
    collection needs a biosample term, for annotations a dataset accession is enough.
    """
    if annotation:
        rows = rows.withColumnsRenamed(ANNOTATION_COLUMNS)
    of = lambda name: nonempty(F.col(f"`{name}`")) if name in rows.columns else F.lit(None).cast("string")
    accession, url, dataset, term, term_id = of("File accession"), of("File download URL"), of("Experiment accession"), of("Biosample term name"), of("Biosample term id")
    ns = F.lit(NAMESPACE)
    owner = {"project_id_namespace": ns, "project_local_id": F.lit("ENCODE")}
    anatomy = F.when(term.isNotNull() & term_id.isNotNull(), _conform({"id": term_id, "name": term}, flatten.TERM))
    taxon = ontology.taxonomy(of("Biosample organism"))
    taxon = F.when(taxon.isNotNull(), _conform({"id": taxon["id"], "name": taxon["name"], "clade": taxon["clade"]}, flatten.TAXON))
    subjects = F.transform(scalars.donor_ids(of("Donor(s)")), lambda d: _conform({"id_namespace": ns, "local_id": d, "taxonomy": taxon, **owner}, flatten.SUBJECT))
    b_extra = {k: of(c) for k, c in BIOSAMPLE_EXTRA.items()}
    b_extra = _if_any(F.struct(_conform(b_extra, flatten.BIOSAMPLE_ENCODE).alias("encode")), list(b_extra.values()))
    biosample = _conform({"id_namespace": ns, "local_id": F.concat(F.lit("biosample:"), term), "subjects": subjects, "anatomy": anatomy, "extra": b_extra, **owner}, flatten.BIOSAMPLE)
    c_extra = {k: of(c) for k, c in COLLECTION_EXTRA.items()}
    c_kind = flatten.COLLECTION["extra"].dataType
    c_extra = _if_any(_conform({"encode": _conform(c_extra, flatten.COLLECTION_ENCODE)}, c_kind), list(c_extra.values()))
    path = "annotations" if annotation else "experiments"
    collection = _conform(
        {
            "id_namespace": ns,
            "local_id": F.coalesce(dataset, F.concat(F.lit("biosample:"), term)),
            "name": F.coalesce(dataset, term),
            "accession_id": scalars.normalize_accession(dataset),
            "persistent_id": F.concat(F.lit(f"{SITE}/{path}/"), dataset, F.lit("/")),
            "lab": of("Lab"),
            "experiment_type": of("Assay"),
            "experiment_target": of("Experiment target"),
            "analyte_class": of("Library made from"),
            "anatomy": F.when(anatomy.isNotNull(), F.array(anatomy)),
            "biosamples": F.when(term.isNotNull(), F.array(biosample)).otherwise(F.array().cast(flatten.COLLECTION["biosamples"].dataType)),
            "subjects": subjects,
            "extra": c_extra,
        },
        flatten.COLLECTION,
    )
    built = term.isNotNull() | (dataset.isNotNull() if annotation else F.lit(False))
    f_extra = {k: of(c) for k, c in FILE_EXTRA.items()} | ({"annotation_type": of("Annotation type")} if annotation else {})
    f_kind = flatten.FILE["extra"].dataType
    f_extra = _if_any(_conform({"encode": _conform(f_extra, flatten.FILE_ENCODE)}, f_kind), list(f_extra.values()))
    term_of = lambda t: F.when(t.isNotNull(), _conform({"id": t["id"], "name": t["name"]}, flatten.TERM))
    record = {"id": "dcc:encode", "dcc_name": "ENCODE", "dcc_abbreviation": "ENCODE", "dcc_url": SITE} | (dcc or {})
    values = {
        "submission": F.lit("encode"),
        "id_namespace": ns,
        "local_id": accession,
        "accession_id": scalars.normalize_accession(accession),
        "filename": scalars.file_name(url, accession, of("File format")),
        "size_in_bytes": scalars.parse_int(of("Size")),
        "md5": of("md5sum"),
        "access_url": url,
        "status": of("File Status"),
        "data_access_level": F.lit("public"),
        "creation_time": of("Experiment date released"),
        "persistent_id": F.concat(F.lit(f"{SITE}/files/"), accession, F.lit("/")),
        "compression_format": scalars.compression_format(url),
        "file_format": term_of(ontology.file_format(of("File format"))),
        "data_type": term_of(ontology.output_type(of("Output type"))),
        "assay_type": term_of(ontology.assay_type(of("Assay"))),
        "collections": F.when(built, F.array(collection)).otherwise(F.array().cast(flatten.FILE["collections"].dataType)),
        "extra": f_extra,
        "dcc": _conform({k: F.lit(v) for k, v in (record | {"project_id_namespace": NAMESPACE, "project_local_id": "ENCODE"}).items()}, flatten.DCC),
        **{k: of(c) for k, c in PROMOTED.items()},
    }
    return rows.where(accession.isNotNull()).select(_conform(values, flatten.FILE).alias("d")).select("d.*")


def update_columns(df: DataFrame, updates: DataFrame, key: str, columns: list[str] | dict[str, str]) -> DataFrame:
    """df with the columns that a row of updates (one a key) sets; nulls and blanks there set nothing.

    columns: names, or column of updates -> dotted path in df. The structs on a path keep
    their other members; those that are missing are made where something is set.
    """
    paths = columns if isinstance(columns, dict) else {c: c for c in columns}
    right = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in paths))
    out = df.join(right, df[key] == F.col("_key"), "left")
    for c, path in paths.items():
        new = F.nullif(F.col(f"_{c}"), F.lit("")) if dict(right.dtypes)[f"_{c}"] == "string" else F.col(f"_{c}")
        top, *rest = path.split(".")
        old = out.schema[top].dataType if top in out.columns else None
        out = out.withColumn(top, _set(F.col(top) if old is not None else None, old, rest, new, right.schema[f"_{c}"].dataType))
    return out.drop("_key", *(f"_{c}" for c in paths))


def _set(c: Column | None, kind: T.DataType | None, path: list[str], new: Column, new_kind: T.DataType) -> Column:
    """A value with new, where that is not null, in its place at a path; structs there take the type of new."""
    if not path:
        return new if c is None else F.coalesce(new, flatten.conform(c, kind, new_kind) if isinstance(new_kind, T.StructType) else c)
    names = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    inner = _set(c[path[0]] if path[0] in names else None, names.get(path[0]), path[1:], new, new_kind).alias(path[0])
    members = [inner if n == path[0] else c[n].alias(n) for n in names] + ([] if path[0] in names else [inner])
    return F.when(new.isNotNull() | (F.lit(False) if c is None else c.isNotNull()), F.struct(*members))


# Search fields and the file columns they are promoted to.
SEARCH_COLUMNS = {"genome_assembly": "genome_assembly", "file_type": "output_type", "file_type_detailed": "output_type_detail", "condition": "condition", "assay_info": "assay_info"}


def enrich_files(files: DataFrame, found: DataFrame, tiers: DataFrame) -> DataFrame:
    """Files (with persistent_id) enriched by the search rows of their accession; all files of an accession alike.

    found: accession, the SEARCH_COLUMNS, replicate_info, biosource_name and dataset, the last row of an accession holding. tiers: biosource_name, cell_line_tier.
    """
    one = last_wins(found.withColumn("accession", scalars.normalize_accession(F.col("accession"))), ["accession"], [c for c in found.columns if c != "accession"])
    one = one.join(tiers.select("biosource_name", "cell_line_tier").distinct(), "biosource_name", "left")
    one = one.withColumnsRenamed(SEARCH_COLUMNS).withColumns({"biological_replicates": scalars.replicate(F.col("replicate_info"), "Biorep"), "technical_replicates": scalars.replicate(F.col("replicate_info"), "Techrep")})
    keyed = files.withColumn("accession", scalars.extract_accession(F.col("persistent_id")))
    return update_columns(keyed, one, "accession", [c for c in one.columns if c != "accession"]).drop("accession")


def enrich_collections(collections: DataFrame, experiments: DataFrame, submission: str = "4dn") -> DataFrame:
    """Collections of a submission with the experiment that their persistent_id names: its accession as accession_id, lab and experiment_type promoted, the rest in extra.fourdn.

    experiments: accession and members of flatten.COLLECTION_FOURDN, lab and experiment_type
    among them; the last row of an accession holds. What an experiment lacks stays as it was;
    extra.fourdn is replaced as a whole where it has anything.
    """
    rest = [c for c in experiments.columns if c in flatten.COLLECTION_FOURDN.names]
    one = last_wins(experiments.withColumn("accession", scalars.normalize_accession(F.col("accession"))).where(F.col("accession").isNotNull()), ["accession"], [c for c in experiments.columns if c != "accession"])
    one = one.withColumn("fourdn", _if_any(_conform({c: F.col(c) for c in rest}, flatten.COLLECTION_FOURDN), [F.col(c) for c in rest]))
    key = F.when(F.col("submission") == submission, scalars.extract_experiment_accession(F.col("persistent_id")))
    stamped = F.coalesce(F.col("accession"), F.col("accession_id")) if "accession_id" in collections.columns else F.col("accession")
    own = collections.withColumn("accession", key).withColumn("accession_id", stamped)
    paths = {"lab": "lab", "experiment_type": "experiment_type", "fourdn": "extra.fourdn"}
    return update_columns(own, one, "accession", {c: p for c, p in paths.items() if c in one.columns}).drop("accession")


def enrich_dataset_collections(collections: DataFrame, datasets: DataFrame, submission: str = "hubmap") -> DataFrame:
    """Collections of a submission with the dataset whose doi_url is their persistent_id: dataset_type as experiment_type, analyte_class, the rest in extra.hubmap.

    datasets: doi_url, dataset_type, analyte_class and members of flatten.COLLECTION_HUBMAP;
    the last row of a DOI holds. What a dataset lacks stays as it was; extra.hubmap is
    replaced as a whole where it has anything.
    """
    rest = [c for c in datasets.columns if c in flatten.COLLECTION_HUBMAP.names]
    one = last_wins(datasets.where(scalars.nonempty(F.col("doi_url")).isNotNull()), ["doi_url"], [c for c in datasets.columns if c != "doi_url"]).withColumnRenamed("doi_url", "_doi")
    one = one.withColumn("hubmap", _if_any(_conform({c: F.col(c) for c in rest}, flatten.COLLECTION_HUBMAP), [F.col(c) for c in rest]))
    own = collections.withColumn("_doi", F.when(F.col("submission") == submission, F.col("persistent_id")))
    paths = {"dataset_type": "experiment_type", "analyte_class": "analyte_class", "hubmap": "extra.hubmap"}
    return update_columns(own, one, "_doi", {c: p for c, p in paths.items() if c in one.columns}).drop("_doi")


#: Members of a donor that are lists; of the others a list of one element stands for the element.
DONOR_LISTS = ("medical_history", "social_history")


def enrich_subjects(subjects: DataFrame, donors: DataFrame, submission: str = "hubmap") -> DataFrame:
    """Subjects of a submission with the first donor (by ord) whose uuid is part of their local_id, as extra.hubmap.

    donors: uuid, ord, and metadata, a JSON object with members of flatten.SUBJECT_HUBMAP;
    donors without metadata count for nothing. A list of one element stands for the
    element; empty lists and null members set nothing, and neither does a donor without any.
    """
    d = donors.where((F.col("uuid") != "") & F.col("metadata").isNotNull()).select(F.col("uuid").alias("_uuid"), F.col("ord").alias("_ord"), F.col("metadata").alias("_metadata"))
    own = subjects.withColumn("_text", F.when(F.col("submission") == submission, F.col("local_id")))
    found = first_contained(own, d, "_text", "_uuid", ["id_namespace", "local_id"], ["_ord", "_uuid"])
    values = {}
    for f in flatten.SUBJECT_HUBMAP.fields:
        text = F.get_json_object("_metadata", f"$.{f.name}")
        if f.name in DONOR_LISTS:
            values[f.name] = F.when(F.size(F.from_json(text, "array<string>")) > 0, F.from_json(text, "array<string>"))
        else:
            values[f.name] = scalars.single_or_self(text).try_cast(f.dataType)
    donor = found.withColumn("_donor", _if_any(_conform(values, flatten.SUBJECT_HUBMAP), list(values.values())))
    old = found.schema["extra"].dataType if "extra" in found.columns else None
    return donor.withColumn("extra", _set(F.col("extra") if old is not None else None, old, ["hubmap"], F.col("_donor"), flatten.SUBJECT_HUBMAP)).drop("_text", "_uuid", "_ord", "_metadata", "_donor")


def prune_restricted(files: DataFrame, links: DataFrame, collections: DataFrame, datasets: DataFrame, submission: str = "hubmap") -> tuple[DataFrame, DataFrame]:
    """(files, links) without what belongs to datasets (doi_url, data_access_level) that are not public.

    Links to their collections go, files whose own persistent_id is such a dataset go, and
    files go that had such a link and have no other. A missing level is not public.
    """
    closed = datasets.where(F.coalesce(F.col("data_access_level"), F.lit("")) != "public").select(F.col("doi_url").alias("_doi")).distinct()
    of = F.col("submission") == submission
    shut = collections.where(of).join(closed, F.col("persistent_id") == F.col("_doi"), "left_semi")
    shut = shut.select(F.col("id_namespace").alias("collection_id_namespace"), F.col("local_id").alias("collection_local_id")).distinct()
    ckeys, fkeys = ["collection_id_namespace", "collection_local_id"], ["file_id_namespace", "file_local_id"]
    kept = links.join(shut, ckeys, "left_anti")
    orphans = links.join(shut, ckeys, "left_semi").select(*fkeys).distinct().join(kept.select(*fkeys).distinct(), fkeys, "left_anti")
    own = closed.withColumn("_submission", F.lit(submission))
    left = files.join(own, (F.col("persistent_id") == F.col("_doi")) & (F.col("submission") == F.col("_submission")), "left_anti")
    # without a matching collection nothing is deleted: one row, or none
    some = shut.limit(1).select(F.lit(True).alias("_any"))
    left = left.unionByName(files.join(own, (F.col("persistent_id") == F.col("_doi")) & (F.col("submission") == F.col("_submission")), "left_semi").join(F.broadcast(some), F.col("_any"), "left_anti"))
    named = orphans.withColumnsRenamed({"file_id_namespace": "id_namespace", "file_local_id": "local_id"})
    return left.join(named, ["id_namespace", "local_id"], "left_anti"), kept


def dataset_file_info(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """(id_namespace, local_id, doi_url, rel_path, is_data_product): of each file the first of its collections with dataset information, and there the file of the same base name.

    files: key, filename and collections (array of structs with persistent_id). datasets: a
    row a dataset file with doi_url, rel_path, is_data_product and ord; of one base name the last holds.
    """
    key = ["id_namespace", "local_id"]
    info = last_wins(datasets.withColumn("base", scalars.basename(F.col("rel_path"))), ["doi_url", "base"], ["ord"]).select("doi_url", "base", "rel_path", "is_data_product")
    dois = info.select("doi_url").distinct()
    ex = files.select(*key, scalars.basename(F.col("filename")).alias("base"), F.posexplode("collections").alias("i", "c")).select(*key, "base", "i", F.col("c.persistent_id").alias("doi_url"))
    first = first_wins(ex.join(dois, "doi_url"), key, ["i"])
    return first.join(info, ["doi_url", "base"], "left").select(*key, "doi_url", "rel_path", "is_data_product")
