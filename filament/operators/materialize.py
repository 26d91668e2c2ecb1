"""Relational metadata tables denormalised into one nested document a file.

Each subject, biosample and collection document is built once, bottom-up, and then attached
to the files that need it. Ontology terms are looked up under the file's submission, so a
collection document is built once for each submission whose files hold it.

Whole documents repeat a collection's members in every file that holds it. What is asked of
one level (Parts) is answered from that level, without the documents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filament.functions import scalars
from filament.operators.ordered import collected, filled, first_wins, last_wins, lookup, with_order
from filament.runtime import Lazy, persisted

ENTITY = ("id_namespace", "local_id")
TABLES = (
    "file", "dcc", "project", "file_format", "data_type", "assay_type", "anatomy", "ncbi_taxonomy", "collection", "biosample", "subject",
    "file_in_collection", "biosample_in_collection", "subject_in_collection", "biosample_from_subject", "collection_anatomy", "subject_race", "subject_role_taxonomy",
)


KEY_OF_COLLECTION = tuple(f"collection_{c}" for c in ENTITY)
#: Lists of a collection document.
MEMBERS = ("anatomy", "biosamples", "subjects")


def _term(df: DataFrame, column: str, submission: str, terms: DataFrame, name: str) -> DataFrame:
    """df with the term of a column under a submission."""
    return lookup(df, terms, {submission: "submission", column: "id"}, name, columns=[c for c in terms.columns if c not in ("submission", "table")])


def _bridge(links: DataFrame, left: str, right: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Links with both keys filled: left and right key columns, order and further columns."""
    keys = [f"{side}_{c}" for side in (left, right) for c in ENTITY]
    return links.where(filled(*keys)).select(*keys, "ord", *extra)


def _attach(links: DataFrame, side: str, entities: DataFrame, scope: str | None = None) -> DataFrame:
    """Links with the doc of the side's entity; links to unknown entities drop out."""
    on = {f"{side}_{c}": c for c in ENTITY}
    e = entities.withColumnsRenamed({c: f"_{c}" for c in ENTITY} | ({scope: f"_{scope}"} if scope else {}))
    cond = F.lit(True)
    for a, b in on.items():
        cond = cond & (F.col(a) == F.col(f"_{b}"))
    if scope:
        cond = cond & (F.col(scope) == F.col(f"_{scope}"))
    return links.join(e, cond).drop(*(f"_{c}" for c in (*ENTITY, *([scope] if scope else []))))


def _list(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    return collected(df, keys, value, ["ord"], name)


def _with_lists(df: DataFrame, lists: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """df with the list of its key; no list is an empty one."""
    right = lists.withColumnsRenamed({b: f"_{b}" for b in on.values()})
    cond = F.lit(True)
    for a, b in on.items():
        cond = cond & (F.col(a) == F.col(f"_{b}"))
    kind = lists.schema[name].dataType
    out = df.join(right, cond, "left").drop(*(f"_{b}" for b in on.values()))
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def _on(df: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of columns of df with renamed ones of the other side."""
    cond = F.lit(True)
    for a, b in keys.items():
        cond = cond & (df[a] == F.col(b))
    return cond


class Parts:
    """The levels of the documents of raw tables (see materialize), each made when it is asked for."""

    def __init__(self, tables: dict[str, DataFrame], submission: str | None = None) -> None:
        def of(name: str) -> DataFrame:
            df = tables[name]
            own = df if submission is None or name == "dcc" else df.where(F.col("submission") == submission)
            # an order taken as read must not change when rows are read again
            return own if "ord" in own.columns else persisted(with_order(own), f"ordered-{name}")

        self.t = Lazy({name: lambda name=name: of(name) for name in tables})
        self._vocabularies: dict[str, DataFrame] = {}

    def of_files(self, files: DataFrame) -> Parts:
        """The same with other file rows."""
        out = Parts({})
        out.t = Lazy({name: (lambda: files) if name == "file" else lambda name=name: self.t[name] for name in self.t})
        out._vocabularies = self._vocabularies
        return out

    def _last(self, name: str, keys: list[str]) -> DataFrame:
        """The last row of each key of a vocabulary, written, so that the planner knows its size."""
        if name not in self._vocabularies:
            df = self.t[name].drop("table")
            order = [c for c in df.columns if c not in keys] if name not in ("dcc", "project") else ["ord"]
            self._vocabularies[name] = persisted(last_wins(df, keys, order or keys), f"last-{name}")
        return self._vocabularies[name]

    def _with_term(self, df: DataFrame, column: str, name: str, submission: str = "submission") -> DataFrame:
        return _term(df, column, submission, self._last(name, ["submission", "id"]), "_found")

    # ------------------------------------------------------------ files
    @cached_property
    def files(self) -> DataFrame:
        return self.t["file"]

    def with_dcc(self, df: DataFrame) -> DataFrame:
        dcc = self._last("dcc", ["submission"])
        return lookup(df, dcc, {"submission": "submission"}, "dcc", ["ord"], [x for x in dcc.columns if x not in ("ord", "submission")])

    def with_terms(self, out: DataFrame) -> DataFrame:
        """Files with their terms, centre and project."""
        for column in ("file_format", "data_type", "assay_type"):
            out = out.withColumnRenamed(column, f"{column}_raw")
            out = self._with_term(out, f"{column}_raw", column).withColumnRenamed("_found", column)
            out = out.withColumn(f"{column}_raw", F.when(filled(f"{column}_raw") & F.col(column).isNull(), F.col(f"{column}_raw")))
        out = self.with_dcc(out)
        project = self._last("project", list(ENTITY))
        out = lookup(out, project, {"project_id_namespace": "id_namespace", "project_local_id": "local_id"}, "project", ["ord"], [x for x in project.columns if x not in ("ord", "submission")])
        raw = F.coalesce(F.col("file_format.id"), F.col("file_format_raw"))
        return out.withColumn("enriched_file_format", F.when(scalars.format_is_open(raw), scalars.enriched_file_format(F.col("filename"))))

    @cached_property
    def _held(self) -> DataFrame:
        """(_ford, key, submission, collection key, ord): links of files to collections; of a file without one the last collection of its persistent_id. Not shuffled since the files were by key."""
        f = self.files.select(F.col("ord").alias("_ford"), "submission", *ENTITY, F.when(filled("persistent_id"), F.col("persistent_id")).alias("_pid"))
        links = _bridge(self.t["file_in_collection"], "file", "collection")
        by_doi = last_wins(self.t["collection"].where(filled("persistent_id")), ["persistent_id"], ["ord"])
        by_doi = persisted(by_doi.select(F.col("persistent_id").alias("_doi"), *(F.col(c).alias(f"_doi_{c}") for c in ENTITY)), "by-doi")  # written, so that the planner knows its size
        out = f.join(links, _on(f, {c: f"file_{c}" for c in ENTITY}), "left")
        # files that take none by persistent_id have a key of their own each, so that they don't meet in one task
        loose = F.col("collection_local_id").isNull() & F.col("_pid").isNotNull()
        out = out.withColumn("_key", F.when(loose, F.col("_pid")).otherwise(F.concat(F.lit(" "), F.col("local_id"))))
        out = out.join(by_doi, loose & (F.col("_key") == F.col("_doi")), "left")
        key = [F.coalesce(f"collection_{c}", f"_doi_{c}").alias(f"collection_{c}") for c in ENTITY]
        return out.select("_ford", *ENTITY, "submission", *key, F.coalesce("ord", F.lit(0)).cast("long").alias("ord")).where(F.col("collection_local_id").isNotNull())

    @cached_property
    def held(self) -> DataFrame:
        """(_file, submission, collection key, ord) of the files' collections."""
        return self._held.select(F.struct(F.col("_ford").alias("ord"), *ENTITY).alias("_file"), "submission", *KEY_OF_COLLECTION, "ord")

    @cached_property
    def linked(self) -> DataFrame:
        """(submission, file key, collection key, nth): held, those of a pair of keys numbered. Written: once it is made, held_pairs and wanted read it instead of joining files and links again."""
        nth = F.row_number().over(Window.partitionBy(*ENTITY, *KEY_OF_COLLECTION).orderBy("submission"))
        return persisted(self._held.select("submission", *ENTITY, *KEY_OF_COLLECTION, nth.alias("nth")), "linked")

    @cached_property
    def held_pairs(self) -> DataFrame:
        """(file key, collection key) once each, of known collections."""
        if "linked" in self.__dict__:
            pairs = self.linked.where("nth = 1").drop("nth", "submission")
        else:
            pairs = self._held.select(*ENTITY, *KEY_OF_COLLECTION).distinct()
        return pairs.withColumnsRenamed({c: f"file_{c}" for c in ENTITY}).join(self._keys("collection"), list(KEY_OF_COLLECTION), "left_semi")

    @cached_property
    def groups(self) -> DataFrame:
        """(submission, collection key, ord, _n): how many times files of a submission hold a known collection, and where first: the file's order, then the place in its list."""
        nth = F.row_number().over(Window.partitionBy(*ENTITY, "_ford").orderBy("ord", *KEY_OF_COLLECTION))
        h = self._held.select("submission", *KEY_OF_COLLECTION, F.array(F.col("_ford").cast("long"), nth.cast("long")).alias("ord"))
        h = h.groupBy("submission", *KEY_OF_COLLECTION).agg(F.min("ord").alias("ord"), F.count("*").alias("_n"))
        return persisted(h.join(self._keys("collection"), list(KEY_OF_COLLECTION), "left_semi"), "groups")

    @cached_property
    def wanted(self) -> DataFrame:
        """(submission, collection key): which submissions' files hold which known collection."""
        if "groups" in self.__dict__:
            return self.groups.select("submission", *KEY_OF_COLLECTION)
        links = self.linked if "linked" in self.__dict__ else self._held
        every = links.select("submission", *KEY_OF_COLLECTION).distinct()
        return persisted(every.join(self._keys("collection"), list(KEY_OF_COLLECTION), "left_semi"), "wanted")

    def with_collections(self, df: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
        """File rows with the list of their collections, and in these the lists named by members."""
        docs = self.collection_docs(members)
        lists = _list(_attach(self.held, "collection", docs, "submission" if members else None), ["_file"], F.col("doc"), "collections")
        return _with_lists(df.withColumn("_file", F.struct("ord", *ENTITY)), lists, {"_file": "_file"}, "collections").drop("_file")

    # ------------------------------------------------------------ members
    def _keys(self, side: str) -> DataFrame:
        """(key): known entities, repeated ones kept: only for semi joins."""
        return self.t[side].select(*(F.col(c).alias(f"{side}_{c}") for c in ENTITY))

    def _links(self, name: str, left: str, right: str, extra: tuple[str, ...] = ()) -> DataFrame:
        return _bridge(self.t[name], left, right, extra)

    @cached_property
    def from_subject(self) -> DataFrame:
        return self._links("biosample_from_subject", "biosample", "subject", ("age_at_sampling",))

    def members(self, side: str) -> DataFrame:
        """Links of known biosamples or subjects to the collections that files hold."""
        held = self.wanted.select(*KEY_OF_COLLECTION)
        return self._links(f"{side}_in_collection", side, "collection").join(held, list(KEY_OF_COLLECTION), "left_semi").join(self._keys(side), [f"{side}_{c}" for c in ENTITY], "left_semi")

    def sampled(self) -> DataFrame:
        """Links of biosamples to known subjects."""
        return self.from_subject.join(self._keys("subject"), [f"subject_{c}" for c in ENTITY], "left_semi")

    @cached_property
    def _holders(self) -> DataFrame:
        """(collection key, subs): the submissions whose files hold a collection, as many as centres at most."""
        return self.wanted.groupBy(*(f"collection_{c}" for c in ENTITY)).agg(F.array_sort(F.collect_set("submission")).alias("subs"))

    def _scoped(self, links: DataFrame, side: str) -> DataFrame:
        """(key, subs) of links with subs: the submissions under which an entity is wanted."""
        subs = F.array_sort(F.array_distinct(F.flatten(F.collect_set("subs"))))
        return links.groupBy(*(F.col(f"{side}_{c}").alias(c) for c in ENTITY)).agg(subs.alias("subs"))

    def _in_collection(self, name: str, side: str) -> DataFrame:
        return self._links(name, side, "collection").join(self._holders, [f"collection_{c}" for c in ENTITY])

    @cached_property
    def biosamples_wanted(self) -> DataFrame:
        """(key, subs) of the known biosamples of collections that files hold."""
        every = self._scoped(self._in_collection("biosample_in_collection", "biosample"), "biosample")
        return every.join(self.biosamples.select(*ENTITY), list(ENTITY), "left_semi")

    @cached_property
    def subjects_wanted(self) -> DataFrame:
        """(key, subs) of the subjects of such collections and biosamples."""
        b = self.biosamples_wanted.select(*(F.col(c).alias(f"biosample_{c}") for c in ENTITY), "subs")
        key = [f"subject_{c}" for c in ENTITY]
        of_b = self.from_subject.join(b, [f"biosample_{c}" for c in ENTITY]).select(*key, "subs")
        return self._scoped(self._in_collection("subject_in_collection", "subject").select(*key, "subs").unionByName(of_b), "subject")

    @cached_property
    def races(self) -> DataFrame:
        """(subject key, race), repeated ones kept, of known subjects."""
        key = [f"subject_{c}" for c in ENTITY]
        return self.t["subject_race"].where(filled(*key, "race")).select(*key, "race").join(self._keys("subject"), key, "left_semi")

    # ------------------------------------------------------------ copies, each with the places of its first ones
    @cached_property
    def _places(self) -> DataFrame:
        """(collection key, held): for each submission (as many as centres) where its files hold a collection first, and how many times."""
        return self.groups.groupBy(*KEY_OF_COLLECTION).agg(F.collect_list(F.struct("submission", "ord", "_n")).alias("held"))

    def _placed(self, name: str, left: str, right: str, by: str, place: str, extra: tuple[str, ...] = ()) -> DataFrame:
        """Links with their place in the list of one side's entity."""
        of, other = ([f"{x}_{c}" for c in ENTITY] for x in (by, left if by == right else right))
        nth = F.row_number().over(Window.partitionBy(*of).orderBy("ord", *other))
        return self._links(name, left, right, extra).withColumn(place, nth.cast("long")).drop("ord")

    @cached_property
    def _biosample_places(self) -> DataFrame:
        """(collection key, biosample key, j, held)."""
        return self._placed("biosample_in_collection", "biosample", "collection", "collection", "j").join(self._places, list(KEY_OF_COLLECTION))

    def _spread(self, df: DataFrame, *place: Column) -> DataFrame:
        """A row a submission in held: submission, ord and _n, with further places in ord."""
        return df.withColumn("_h", F.explode("held")).drop("held").withColumns({"submission": F.col("_h.submission"), "ord": F.concat("_h.ord", F.array(*place)), "_n": F.col("_h._n")}).drop("_h")

    @cached_property
    def collection_copies(self) -> DataFrame:
        """(submission, ord, _n, c): collections with anatomy."""
        lists = _list(self.anatomies, ["submission", *KEY_OF_COLLECTION], F.col("anatomy"), "anatomy")
        c = self.collections.withColumnsRenamed({x: f"collection_{x}" for x in ENTITY}).join(self.groups, list(KEY_OF_COLLECTION)).join(lists, ["submission", *KEY_OF_COLLECTION], "left")
        c = c.withColumnsRenamed({f"collection_{x}": x for x in ENTITY})
        return c.select("submission", "ord", "_n", F.struct(*self.collections.columns, "anatomy").alias("c"))

    @cached_property
    def biosample_copies(self) -> DataFrame:
        """(submission, ord, _n, collection key, b): biosamples without subjects."""
        b = self._biosample_places.withColumnsRenamed({f"biosample_{c}": c for c in ENTITY}).join(self.biosamples, list(ENTITY))
        b = self.with_anatomy(self._spread(b, F.lit(1).cast("long"), F.col("j")))
        return b.select("submission", "ord", "_n", *KEY_OF_COLLECTION, F.struct(*(c for c in self.biosamples.columns if c != "anatomy_raw"), "anatomy").alias("b"))

    def _subject_copies(self, links: DataFrame, more: list[str], place: list[Column]) -> DataFrame:
        s = links.withColumnsRenamed({f"subject_{c}": c for c in ENTITY}).join(self.subjects.drop("ord"), list(ENTITY))
        s = self.with_taxonomy(self._spread(s, *place))
        own = [c for c in self.subjects.columns if c not in ("ord", "taxonomy_id")]
        age = [F.col("age_at_sampling").try_cast("double").alias("age_at_sampling")] if "age_at_sampling" in links.columns else []
        return s.select("submission", "ord", "_n", *more, F.struct(*own, "taxonomy", *age).alias("s"))

    @cached_property
    def sampled_copies(self) -> DataFrame:
        """(submission, ord, _n, collection key, biosample key, s): subjects of biosamples."""
        key = [f"biosample_{c}" for c in ENTITY]
        b = self._biosample_places.join(self.biosamples.select(*(F.col(c).alias(f"biosample_{c}") for c in ENTITY)), key, "left_semi")
        links = b.join(self._placed("biosample_from_subject", "biosample", "subject", "biosample", "k", ("age_at_sampling",)), key)
        return self._subject_copies(links, [*KEY_OF_COLLECTION, *key], [F.lit(1).cast("long"), F.col("j"), F.col("k")])

    @cached_property
    def subject_copies(self) -> DataFrame:
        """(submission, ord, _n, collection key, s): subjects of collections."""
        links = self._placed("subject_in_collection", "subject", "collection", "collection", "k").join(self._places, list(KEY_OF_COLLECTION))
        return self._subject_copies(links, list(KEY_OF_COLLECTION), [F.lit(2).cast("long"), F.col("k")])

    # ------------------------------------------------------------ first copies, of each entity one; the others are not made
    @cached_property
    def _first_places(self) -> DataFrame:
        """(collection key, submission, ord): where files hold a collection first."""
        return first_wins(self.groups, list(KEY_OF_COLLECTION), ["ord", "submission"]).drop("_n")

    @cached_property
    def collection_firsts(self) -> DataFrame:
        """(submission, ord, c): collections without members."""
        c = self._first_places.withColumnsRenamed({f"collection_{x}": x for x in ENTITY}).join(self.collections, list(ENTITY))
        return c.select("submission", "ord", F.struct(*self.collections.columns).alias("c"))

    @cached_property
    def _biosample_firsts(self) -> DataFrame:
        """(biosample key, submission, ord): the first place of a biosample is in the first copy of one of its collections."""
        key = [f"biosample_{c}" for c in ENTITY]
        links = self._placed("biosample_in_collection", "biosample", "collection", "collection", "j").join(self._keys("biosample"), key, "left_semi")
        places = links.join(self._first_places, list(KEY_OF_COLLECTION)).select(*key, "submission", F.concat("ord", F.array(F.lit(1).cast("long"), "j")).alias("ord"))
        return persisted(first_wins(places, key, ["ord", "submission"]), "first-biosamples")

    @cached_property
    def biosample_firsts(self) -> DataFrame:
        """(submission, ord, b): biosamples without subjects."""
        b = self.with_anatomy(self._biosample_firsts.withColumnsRenamed({f"biosample_{c}": c for c in ENTITY}).join(self.biosamples, list(ENTITY)))
        return b.select("submission", "ord", F.struct(*(c for c in self.biosamples.columns if c != "anatomy_raw"), "anatomy").alias("b"))

    @cached_property
    def subject_firsts(self) -> DataFrame:
        """(submission, ord, s): a subject's first place is in the first copy of one of its biosamples or collections."""
        key = [f"subject_{c}" for c in ENTITY]
        of_b = self._biosample_firsts.join(self._placed("biosample_from_subject", "biosample", "subject", "biosample", "k", ("age_at_sampling",)), [f"biosample_{c}" for c in ENTITY])
        of_b = of_b.select(*key, "submission", F.concat("ord", F.array("k")).alias("ord"), "age_at_sampling")
        of_c = self._placed("subject_in_collection", "subject", "collection", "collection", "k").join(self._first_places, list(KEY_OF_COLLECTION))
        of_c = of_c.select(*key, "submission", F.concat("ord", F.array(F.lit(2).cast("long"), "k")).alias("ord"), F.lit(None).cast("string").alias("age_at_sampling"))
        first = first_wins(of_b.unionByName(of_c), key, ["ord", "submission"])
        s = self.with_taxonomy(first.withColumnsRenamed({f"subject_{c}": c for c in ENTITY}).join(self.subjects.drop("ord"), list(ENTITY)))
        own = [c for c in self.subjects.columns if c not in ("ord", "taxonomy_id")]
        return s.select("submission", "ord", F.struct(*own, "taxonomy", F.col("age_at_sampling").try_cast("double").alias("age_at_sampling")).alias("s"))

    # ------------------------------------------------------------ terms of members, of each collection and term the first place
    def _term_places(self, places: DataFrame) -> DataFrame:
        """places: (collection key, a term's text, place in the collection). With submission and ord, a row a submission whose files hold the collection."""
        return places.join(self.groups.withColumnRenamed("ord", "_at").drop("_n"), list(KEY_OF_COLLECTION)).withColumn("ord", F.concat("_at", "place")).drop("_at", "place")

    @cached_property
    def anatomy_places(self) -> DataFrame:
        """(ord, anatomy): found terms of collections and biosamples, with the first place of each in each collection."""
        key, one = [f"biosample_{c}" for c in ENTITY], F.lit(1).cast("long")
        b = self.biosamples.select(*(F.col(c).alias(f"biosample_{c}") for c in ENTITY), "anatomy_raw")
        of_b = self._placed("biosample_in_collection", "biosample", "collection", "collection", "j").join(b, key)
        of_b = of_b.groupBy(*KEY_OF_COLLECTION, "anatomy_raw").agg(F.array(one, F.min("j")).alias("place"))
        a = self.t["collection_anatomy"].where(filled(*KEY_OF_COLLECTION, "anatomy")).select(*KEY_OF_COLLECTION, F.col("anatomy").alias("anatomy_raw")).distinct()
        places = self._term_places(of_b.unionByName(a.withColumn("place", F.array().cast("array<bigint>"))))
        return self.with_anatomy(places).select("ord", "anatomy").where(F.col("anatomy").isNotNull())

    @cached_property
    def taxonomy_places(self) -> DataFrame:
        """(ord, taxonomy): found terms of the subjects of biosamples and collections, with the first place of each in each collection."""
        subject, biosample = ([f"{x}_{c}" for c in ENTITY] for x in ("subject", "biosample"))
        roles = self.roles.join(self._keys("subject"), subject, "left_semi")
        in_b = self._placed("biosample_from_subject", "biosample", "subject", "biosample", "k").join(roles, subject).groupBy(*biosample, "taxonomy_id").agg(F.min("k").alias("k"))
        of_b = self._placed("biosample_in_collection", "biosample", "collection", "collection", "j").join(self._keys("biosample"), biosample, "left_semi").join(in_b, biosample)
        of_b = of_b.groupBy(*KEY_OF_COLLECTION, "taxonomy_id").agg(F.min(F.array(F.lit(1).cast("long"), "j", "k")).alias("place"))
        of_c = self._placed("subject_in_collection", "subject", "collection", "collection", "k").join(roles, subject)
        of_c = of_c.groupBy(*KEY_OF_COLLECTION, "taxonomy_id").agg(F.array(F.lit(2).cast("long"), F.min("k")).alias("place"))
        return self.with_taxonomy(self._term_places(of_b.unionByName(of_c))).select("ord", "taxonomy").where(F.col("taxonomy").isNotNull())

    @cached_property
    def roles(self) -> DataFrame:
        """(subject key, taxonomy_id): each subject's first role."""
        key = [f"subject_{c}" for c in ENTITY]
        return first_wins(self.t["subject_role_taxonomy"].where(filled(*key)), key, ["ord"]).select(*key, "taxonomy_id")

    @cached_property
    def subjects(self) -> DataFrame:
        """Subjects with their races and the term of their first role, in no submission."""
        key = [f"subject_{c}" for c in ENTITY]
        race = _list(self.t["subject_race"].where(filled(*key, "race")), key, F.col("race"), "race")
        roles = self.roles.select(F.col("subject_id_namespace").alias("_ns"), F.col("subject_local_id").alias("_id"), "taxonomy_id")
        out = last_wins(self.t["subject"], list(ENTITY), ["ord"]).drop("submission", "table")
        out = out.join(roles, (F.col("id_namespace") == F.col("_ns")) & (F.col("local_id") == F.col("_id")), "left").drop("_ns", "_id")
        return _with_lists(out, race, {c: f"subject_{c}" for c in ENTITY}, "race")

    def with_taxonomy(self, df: DataFrame) -> DataFrame:
        return self._with_term(df, "taxonomy_id", "ncbi_taxonomy").withColumnRenamed("_found", "taxonomy")

    @cached_property
    def subject_rows(self) -> DataFrame:
        """Subjects with terms, a row a submission under which they are wanted."""
        s = self.subjects.join(self.subjects_wanted, list(ENTITY))
        return self.with_taxonomy(s.withColumn("submission", F.explode("subs")).drop("subs", "ord"))

    @cached_property
    def subject_docs(self) -> DataFrame:
        s = self.subject_rows
        return s.select("submission", *ENTITY, F.struct(*(c for c in s.columns if c not in ("submission", "taxonomy_id"))).alias("doc"))

    @cached_property
    def biosamples(self) -> DataFrame:
        """Biosamples in no submission: the anatomy's id is anatomy_raw."""
        return last_wins(self.t["biosample"], list(ENTITY), ["ord"]).drop("submission", "table", "ord").withColumnRenamed("anatomy", "anatomy_raw")

    def with_anatomy(self, df: DataFrame) -> DataFrame:
        return self._with_term(df, "anatomy_raw", "anatomy").withColumnRenamed("_found", "anatomy")

    @cached_property
    def biosample_rows(self) -> DataFrame:
        """Biosamples with anatomy, without subjects, a row a submission under which they are wanted."""
        b = self.biosamples.join(self.biosamples_wanted, list(ENTITY))
        return self.with_anatomy(b.withColumn("submission", F.explode("subs")).drop("subs"))

    @cached_property
    def biosample_docs(self) -> DataFrame:
        key = [f"biosample_{c}" for c in ENTITY]
        of = self.biosamples_wanted.select(*(F.col(c).alias(f"biosample_{c}") for c in ENTITY), F.explode("subs").alias("submission"))
        with_age = _attach(of.join(self.from_subject, key), "subject", self.subject_docs, "submission")
        age = F.col("age_at_sampling").try_cast("double")
        with_age = with_age.select("submission", *key, "ord", F.struct("doc.*", age.alias("age_at_sampling")).alias("doc"))
        lists = _list(with_age, ["submission", *key], F.col("doc"), "subjects")
        b = _with_lists(self.biosample_rows, lists, {"submission": "submission"} | {c: f"biosample_{c}" for c in ENTITY}, "subjects")
        return b.select("submission", *ENTITY, F.struct(*(c for c in b.columns if c not in ("submission", "anatomy_raw"))).alias("doc"))

    @cached_property
    def collections(self) -> DataFrame:
        """Collections without members, in no submission."""
        return last_wins(self.t["collection"], list(ENTITY), ["ord"]).drop("submission", "table", "ord")

    @cached_property
    def anatomies(self) -> DataFrame:
        """(submission, collection key, ord, anatomy): the terms of collections that are found."""
        key = [f"collection_{c}" for c in ENTITY]
        a = self.t["collection_anatomy"].where(filled(*key, "anatomy")).select(*key, F.col("anatomy").alias("anatomy_raw"), "ord")
        return self.with_anatomy(self.wanted.join(a, key)).where(F.col("anatomy").isNotNull()).drop("anatomy_raw")

    @cached_property
    def anatomy_pairs(self) -> DataFrame:
        """(submission, collection key, anatomy): as anatomies, each once."""
        key = [f"collection_{c}" for c in ENTITY]
        a = self.t["collection_anatomy"].where(filled(*key, "anatomy")).select(*key, F.col("anatomy").alias("anatomy_raw")).distinct()
        return self.with_anatomy(self.wanted.join(a, key)).where(F.col("anatomy").isNotNull()).drop("anatomy_raw")

    def collection_docs(self, members: tuple[str, ...] = MEMBERS) -> DataFrame:
        """([submission,] key, doc): collections with the lists named by members; without any they are the same under every submission."""
        if not members:
            return self.collections.select(*ENTITY, F.struct(*self.collections.columns).alias("doc"))
        key = ["submission", "collection_id_namespace", "collection_local_id"]
        on = {"submission": "submission", "id_namespace": "collection_id_namespace", "local_id": "collection_local_id"}
        c = self.collections.join(self.wanted.select("submission", *(F.col(f"collection_{x}").alias(x) for x in ENTITY)), list(ENTITY))
        for name in members:
            if name == "anatomy":
                rows, value = self.anatomies, F.col("anatomy")
            else:
                side, docs = ("biosample", self.biosample_docs) if name == "biosamples" else ("subject", self.subject_docs)
                links = self.wanted.join(self._links(f"{side}_in_collection", side, "collection"), key[1:])
                rows, value = _attach(links, side, docs, "submission"), F.col("doc")
            c = _with_lists(c, _list(rows, key, value, name), on, name)
        return c.select("submission", *ENTITY, F.struct(*(x for x in c.columns if x != "submission")).alias("doc"))


def materialize(tables: dict[str, DataFrame], submission: str | None = None) -> DataFrame:
    """One nested document a file row.

    tables: the raw tables by name (TABLES), text columns, with ord for the order of rows
    (taken as read if there is none) – of repeated keys the last row holds, and lists keep
    the links' order. submission: only that one's rows, of every table but dcc.

    Format, data and assay terms: blank gives null, a hit the term, a miss leaves the text
    in <column>_raw beside a null term; an anatomy that is missed is null. A file without a
    usable link to a collection takes the last collection of the same persistent_id. ord stays.
    """
    parts = Parts(tables, submission)
    return parts.with_terms(parts.with_collections(parts.files))
