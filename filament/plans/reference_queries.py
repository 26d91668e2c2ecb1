"""One query an operator over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filament.functions import ontology, scalars
from filament.operators import enrich, filters, flatten, integrity, intervals, matrix, nested, ordered, query, slices
from filament.operators.registry import Registry
from filament.runtime import once, persisted, prepare, scratch_path, scratch_tables, table
from filament.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(prepare(spark), d)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ------------------------------------------------------------------ documents
def order_docs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, written once a session and folder: customer with nation, and items with part and supplier in line order."""
    return once(spark, "order-documents", d, ("orders", "lineitem", "part", "supplier", "customer", "nation"), lambda: _order_docs(spark, d))


def _order_docs(spark: SparkSession, d: str) -> DataFrame:
    li, p, s = (table(spark, d, n) for n in ("lineitem", "part", "supplier"))
    part = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("part")
    items = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    value = F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), part, F.struct(F.col("s_name").alias("name")).alias("supplier"))
    lists = ordered.collected(items, ["l_orderkey"], value, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "items")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_name").alias("name")).alias("nation"))
    c = table(spark, d, "customer").join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("o_custkey"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "nation").alias("customer"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return o.withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def file_docs(spark: SparkSession, d: str) -> DataFrame:
    """Delivered file rows as documents with centre, project and bundle collection; of repeated keys the last row holds."""
    f = table(spark, d, "c2m2_file")
    order = ["load_no", "row_id"]
    f = ordered.lookup(f, table(spark, d, "c2m2_dcc"), {"submission": "submission"}, "dcc", order, ["id", "dcc_name", "dcc_abbreviation"])
    f = ordered.lookup(f, table(spark, d, "c2m2_project"), {"project_id_namespace": "id_namespace", "project_local_id": "local_id"}, "project", order, ["id_namespace", "local_id", "name"])
    on = {"bundle_collection_id_namespace": "id_namespace", "bundle_collection_local_id": "local_id"}
    f = ordered.lookup(f, table(spark, d, "c2m2_collection"), on, "bundle", order, ["id_namespace", "local_id", "name", "abbreviation"])
    kind = f.schema["bundle"].dataType.simpleString()
    return f.withColumn("collections", F.when(F.col("bundle").isNotNull(), F.array("bundle")).otherwise(F.array().cast(f"array<{kind}>"))).drop("bundle")


_FILES_SQL = r"""
WITH dcc AS (SELECT * FROM c2m2_dcc QUALIFY row_number() OVER (PARTITION BY submission ORDER BY load_no DESC, row_id DESC) = 1),
project AS (SELECT * FROM c2m2_project QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id ORDER BY load_no DESC, row_id DESC) = 1),
collection AS (SELECT * FROM c2m2_collection QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id ORDER BY load_no DESC, row_id DESC) = 1),
docs AS (
    SELECT f.*, d.dcc_name, p.name AS project_name, c.name AS collection_name, c.local_id AS collection_id
    FROM c2m2_file f LEFT JOIN dcc d ON d.submission = f.submission AND regexp_matches(f.submission, '\S')
    LEFT JOIN project p ON p.id_namespace = f.project_id_namespace AND p.local_id = f.project_local_id AND regexp_matches(f.project_id_namespace, '\S') AND regexp_matches(f.project_local_id, '\S')
    LEFT JOIN collection c ON c.id_namespace = f.bundle_collection_id_namespace AND c.local_id = f.bundle_collection_local_id AND regexp_matches(f.bundle_collection_id_namespace, '\S') AND regexp_matches(f.bundle_collection_local_id, '\S')
)"""

_FLAGSHIP = {"status": ["released", "archived"], "project": [{"id_namespace": ["https://lungbase.example/ids/"]}], "data_access_level": ["public"]}


@register(
    _FILES_SQL
    + """
SELECT row_id, filename, dcc_name, project_name, collection_name FROM docs
WHERE status IN ('released', 'archived') AND data_access_level = 'public' AND project_name IS NOT NULL AND project_id_namespace = 'https://lungbase.example/ids/'
ORDER BY row_id LIMIT 25 OFFSET 25"""
)
def files_page(spark, d):
    return page_of_files(spark, d, 1)


def page_of_files(spark: SparkSession, d: str, page: int) -> DataFrame:
    page = query.files(file_docs(spark, d), [_FLAGSHIP], page=page, page_size=25, key=("row_id",))
    return page.select("row_id", "filename", F.col("dcc.dcc_name").alias("dcc_name"), F.col("project.name").alias("project_name"), F.get("collections", F.lit(0))["name"].alias("collection_name"))


@register(_FILES_SQL + " SELECT row_id, dcc_name, project_name, collection_name FROM docs")
def materialize_files(spark, d):
    """Lookups in which the last row of a key holds and blank keys match nothing."""
    return file_docs(spark, d).select("row_id", F.col("dcc.dcc_name").alias("dcc_name"), F.col("project.name").alias("project_name"), F.get("collections", F.lit(0))["name"].alias("collection_name"))


# ------------------------------------------------------------------ joins
@register("""
SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN
(SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1) ON c_nationkey = o_custkey % 25""")
def lookup_left_last_wins(spark, d):
    o = table(spark, d, "orders").withColumn("nk", (F.col("o_custkey") % 25).cast("int").cast("string"))
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    out = ordered.lookup(o, c, {"nk": "c_nationkey"}, "c", ["c_acctbal", "c_custkey"], ["c_name", "c_mktsegment"])
    return out.select("o_orderkey", "c.c_name", "c.c_mktsegment")


@register(r"""
SELECT f.row_id, p.name AS project_name FROM c2m2_file f LEFT JOIN
(SELECT * FROM c2m2_project QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id ORDER BY load_no DESC, row_id DESC) = 1) p
ON p.id_namespace = f.project_id_namespace AND p.local_id = f.project_local_id AND regexp_matches(f.project_local_id, '\S')""")
def lookup_composite_guarded(spark, d):
    on = {"project_id_namespace": "id_namespace", "project_local_id": "local_id"}
    return ordered.lookup(table(spark, d, "c2m2_file"), table(spark, d, "c2m2_project"), on, "p", ["load_no", "row_id"], ["name"]).select("row_id", F.col("p.name").alias("project_name"))


@register("""
SELECT l_orderkey AS o_orderkey, count(*) AS n, string_agg(p_name, ';' ORDER BY l_linenumber, p_name) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def bridge_collect(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = ordered.collected(rows, ["l_orderkey"], F.col("p_name"), ["l_linenumber", "p_name"], "parts")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.size("parts").cast("bigint").alias("n"), F.array_join("parts", ";").alias("parts"))


@register("""
SELECT p_partkey, n_name FROM part LEFT JOIN nation ON contains(lower(p_name || ' ' || p_type), lower(left(n_name, 2)))
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey) = 1""")
def theta_contains_first(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lower(F.left("n_name", F.lit(2))).alias("token"))
    return ordered.first_contained(parts, n, "text", "token", ["p_partkey"], ["n_nationkey"]).select("p_partkey", "n_name")


@register("""
WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag IN ('R', 'A') AS fit, l_orderkey % 3 > 0 AND l_linenumber % 2 = 1 AS own FROM lineitem),
k AS (SELECT l_orderkey, bool_or(own) AS has_own FROM x GROUP BY 1)
SELECT l_orderkey, min_by(l_partkey, (NOT fit, l_linenumber, l_partkey)) AS part FROM x JOIN k USING (l_orderkey) WHERE own = has_own GROUP BY 1""")
def array_first_match(spark, d):
    """F16: the first list decides as long as it has anything; formats as text or as an object with a title."""
    fmt = F.when(F.col("l_returnflag") == "R", "BAI").when(F.col("l_returnflag") == "A", '{"display_title": "tbi"}').otherwise("fastq")
    li = table(spark, d, "lineitem").withColumn("own", (F.col("l_orderkey") % 3 > 0) & (F.col("l_linenumber") % 2 == 1))
    value = F.struct(F.col("own"), F.struct(F.col("l_partkey").cast("string").alias("href"), fmt.alias("file_format")).alias("x"))
    lists = ordered.collected(li, ["l_orderkey"], value, ["l_linenumber", "l_partkey"], "items")
    of = lambda own: F.transform(F.filter("items", lambda e: e["own"] == F.lit(own)), lambda e: e["x"])
    return lists.select("l_orderkey", filters.sidecar(of(True), of(False))["href"].cast("bigint").alias("part"))


# ------------------------------------------------------------------ filters
@register("""
SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE (o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')) OR c_mktsegment = 'BUILDING'""")
def filter_and_or(spark, d):
    docs = order_docs(spark, d)
    tree = [{"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"customer": [{"segment": ["BUILDING"]}]}]
    return docs.where(filters.matching(tree, docs.schema)).select("o_orderkey")


@register("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#11')
AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def filter_exists_independent(spark, d):
    """each leaf holds if some item does, not the same one for all."""
    docs = order_docs(spark, d)
    return docs.where(filters.matching([{"items": [{"part": [{"brand": ["Brand#11"]}], "flag": ["R"]}]}], docs.schema)).select("o_orderkey")


@register("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#11')""")
def filter_path_index(spark, d):
    """F2 through an array column of all values at the path."""
    docs = order_docs(spark, d)
    return docs.withColumn("idx", filters.path_values(docs.schema, "items.part.brand")).where(F.array_contains("idx", "Brand#11")).select("o_orderkey")


@register("SELECT row_id FROM c2m2_file WHERE accession_id = (SELECT accession_id FROM c2m2_file WHERE accession_id IS NOT NULL ORDER BY row_id LIMIT 1)")
def filter_accession_fold(spark, d):
    f = table(spark, d, "c2m2_file")
    first = f.where(F.col("accession_id").isNotNull()).orderBy("row_id").limit(1).select("accession_id").first()[0]
    return f.where(filters.matching([{"accession_id": [f"  {first.lower()}\t", " "]}], f.schema)).select("row_id")


@register("SELECT count(*) AS total_count FROM orders")
def filter_empty_is_all(spark, d):
    return query.file_count(table(spark, d, "orders"), [{}, {"o_orderstatus": []}])


@register("SELECT row_id FROM c2m2_file WHERE submission <> 'lungbase' OR coalesce(data_access_level, '') = 'public'")
def filter_access_guard(spark, d):
    return table(spark, d, "c2m2_file").where(filters.access_guard(F.col("submission"), F.col("data_access_level"), "lungbase")).select("row_id")


@register(r"""
WITH f AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN local_id || chr(10) WHEN row_id % 5 = 1 THEN 'a b' ELSE local_id END AS id, access_url FROM c2m2_file)
SELECT row_id, row_id % 5 > 1 AND regexp_matches(id, '^[A-Za-z0-9._-]+$') AND length(id) <= 256 AS good_id,
    coalesce(regexp_extract(access_url, '^([a-z0-9]+)://', 1) IN ('https') AND (regexp_extract(access_url, '://([^/:?#]+)', 1) = 'lungbase.example' OR ends_with(regexp_extract(access_url, '://([^/:?#]+)', 1), '.lungbase.example')), false) AS good_url FROM f""")
def filter_identifier_url(spark, d):
    """an identifier with a line end behind it is none."""
    n = F.col("row_id") % 5
    name = F.when(n == 0, F.concat("local_id", F.lit("\n"))).when(n == 1, "a b").otherwise(F.col("local_id"))
    return table(spark, d, "c2m2_file").select("row_id", filters.is_identifier(name).alias("good_id"), filters.url_allowed(F.col("access_url"), ["lungbase.example"]).alias("good_url"))


@register("""
WITH n(k, name, processor) AS (VALUES (0, 'HDF5', 'matrix'), (1, 'bigInteract', NULL), (2, 'BAM', 'alignment_index'), (3, 'bigWig', 'passthrough'), (4, 'NarrowPeak', 'interval_index'), (5, 'odd', NULL))
SELECT row_id, CASE WHEN name = 'HDF5' THEN CASE WHEN lower(filename) LIKE '%.mcool' THEN 'mcool' WHEN lower(filename) LIKE '%.cool' THEN 'cool' WHEN lower(filename) LIKE '%.hic' THEN 'hic' END END AS kind, processor, name = 'bigInteract' AS interaction FROM c2m2_file JOIN n ON k = row_id % 6""")
def format_routing(spark, d):
    """contact matrices by name and suffix, the processor of a format, and interactions by format name."""
    fmt = F.element_at(F.array(*map(F.lit, ("HDF5", "bigInteract", "BAM", "bigWig", "NarrowPeak", "odd"))), (F.col("row_id") % 6 + 1).cast("int"))
    return table(spark, d, "c2m2_file").select("row_id", filters.matrix_kind(fmt, F.col("filename")).alias("kind"), filters.processor(fmt).alias("processor"), filters.is_interaction(fmt).alias("interaction"))


# ------------------------------------------------------------------ pages, counts, distinct values
@register("SELECT count(*) AS total_count FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O' AND n_name = 'FRANCE'")
def file_count(spark, d):
    return query.file_count(order_docs(spark, d), [{"o_orderstatus": ["O"], "customer": [{"nation": [{"name": ["FRANCE"]}]}]}])


@register("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 40 OFFSET 80")
def page_window(spark, d):
    return query.files(table(spark, d, "orders"), [{"o_orderstatus": ["P"]}], page=2, page_size=40, key=("o_orderkey",)).select("o_orderkey", "o_custkey", "o_orderstatus")


@register("SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def keyset_page(spark, d):
    return query.keyset_page(table(spark, d, "events"), "event_id", 100, 50).select("event_id", "event_type")


@register("""
SELECT 'customer.segment' AS field, c_mktsegment AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'items.part.brand', p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_brand IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2""")
def distinct_values(spark, d):
    return query.distinct_values(order_docs(spark, d), ["customer.segment", "items.part.brand", "o_orderpriority"])


@register("SELECT load_no, count(*) AS total, count(accession_id) AS covered, round(count(accession_id) * 100.0 / count(*), 4) AS percent FROM c2m2_file GROUP BY 1")
def coverage_pct(spark, d):
    return query.coverage(table(spark, d, "c2m2_file"), "load_no", "accession_id")


@register("SELECT compression_format AS value, count(*) AS n FROM c2m2_file GROUP BY 1 UNION ALL SELECT 'format:3615', 0 WHERE NOT EXISTS (SELECT 1 FROM c2m2_file WHERE compression_format = 'format:3615')")
def distribution_zero_fill(spark, d):
    return query.distribution(table(spark, d, "c2m2_file"), "compression_format", ["format:3989", "format:3615"])


@register("SELECT local_id, source FROM (SELECT local_id, 0 AS source, row_id FROM c2m2_collection WHERE local_id = (SELECT min(local_id) FROM c2m2_file) UNION ALL SELECT local_id, 1, row_id FROM c2m2_file WHERE local_id = (SELECT min(local_id) FROM c2m2_file)) ORDER BY source, row_id LIMIT 1")
def lookup_first_source(spark, d):
    f, c = table(spark, d, "c2m2_file"), table(spark, d, "c2m2_collection")
    least = f.agg(F.min("local_id")).first()[0]
    parts = [x.select("local_id", "row_id", F.lit(i).alias("source")) for i, x in enumerate((c, f))]
    return query.first_of(parts, F.col("local_id") == least, ["local_id", "source", "row_id"]).select("local_id", "source")


@register("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value")
def most_common(spark, d):
    return query.distribution(table(spark, d, "customer"), "c_mktsegment").orderBy(F.desc("n"), "value")


# ------------------------------------------------------------------ integrity and registries
@register("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS submissions FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    return integrity.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@register("SELECT file_format, count(DISTINCT submission) AS submissions FROM c2m2_file GROUP BY 1 HAVING count(DISTINCT submission) > 1")
def cross_submission(spark, d):
    f = table(spark, d, "c2m2_file").select("file_format", "submission", F.col("row_id").alias("ord"), F.lit(False).alias("stub"))
    return Registry("file_format", f, ("file_format",)).two_submissions()


@register("""
SELECT 'submission' AS side, submission AS value, count(DISTINCT id_namespace) AS partners FROM c2m2_project WHERE submission IS NOT NULL OR true GROUP BY 2 HAVING count(DISTINCT id_namespace) > 1 UNION ALL
SELECT 'id_namespace', id_namespace, count(DISTINCT submission) FROM c2m2_project GROUP BY 2 HAVING count(DISTINCT submission) > 1""")
def one_to_one_violation(spark, d):
    return integrity.not_one_to_one(table(spark, d, "c2m2_project"), "submission", "id_namespace")


@register("""
SELECT project_id_namespace, project_local_id, count(*) AS n FROM c2m2_file WHERE project_id_namespace IS NOT NULL AND project_local_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM c2m2_project p WHERE p.id_namespace = project_id_namespace AND p.local_id = project_local_id) GROUP BY 1, 2""")
def fk_violations(spark, d):
    return integrity.missing_parents(table(spark, d, "c2m2_file"), ["project_id_namespace", "project_local_id"], table(spark, d, "c2m2_project"), ["id_namespace", "local_id"])


def _copies(spark: SparkSession, d: str) -> Registry:
    f = table(spark, d, "c2m2_file").select("id_namespace", "local_id", "filename", "md5", "status", F.col("row_id").alias("ord"), (F.coalesce("status", F.lit("")) == "").alias("stub"))
    return Registry("file", f, ("id_namespace", "local_id"))


_COPIES = """
WITH copies AS (SELECT id_namespace, local_id, filename, md5, status, row_id AS ord, coalesce(status, '') = '' AS stub FROM c2m2_file),
kept AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id ORDER BY stub, ord) = 1),
later AS (SELECT c.*, k.filename AS k_filename, k.md5 AS k_md5, k.status AS k_status FROM copies c JOIN kept k USING (id_namespace, local_id) WHERE NOT c.stub AND c.ord <> k.ord),
differing AS (SELECT * FROM later WHERE filename IS DISTINCT FROM k_filename OR md5 IS DISTINCT FROM k_md5 OR status IS DISTINCT FROM k_status)
"""


@register(_COPIES + "SELECT id_namespace, local_id, filename, md5, status FROM kept")
def first_wins(spark, d):
    return _copies(spark, d).rows()


@register(_COPIES + "SELECT 'file' AS table_name, count(*) AS conflicts FROM differing")
def conflict_count(spark, d):
    return _copies(spark, d).conflicts()


@register(
    _COPIES
    + """, pairs AS (
    SELECT id_namespace || '|' || local_id AS natural_key, 'filename' AS column_name, k_filename AS kept_value, filename AS discarded_value, ord, 0 AS nth FROM differing UNION ALL
    SELECT id_namespace || '|' || local_id, 'md5', k_md5, md5, ord, 1 FROM differing UNION ALL SELECT id_namespace || '|' || local_id, 'status', k_status, status, ord, 2 FROM differing)
SELECT 'file' AS table_name, natural_key, column_name, kept_value, discarded_value FROM pairs WHERE kept_value IS DISTINCT FROM discarded_value ORDER BY ord, natural_key, nth LIMIT 1000"""
)
def conflict_samples(spark, d):
    """The sample of differing columns is capped at 1000, as the conflict report is."""
    return _copies(spark, d).conflict_samples(1000)


@register("""
WITH copies AS (SELECT id_namespace, local_id, coalesce(status, '') = '' AS stub, row_id FROM c2m2_file)
SELECT (SELECT count(*) FROM (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY id_namespace, local_id ORDER BY row_id) = 1) WHERE stub) AS stubs_created,
(SELECT count(*) FROM (SELECT bool_and(stub) AS only_stubs FROM copies GROUP BY id_namespace, local_id) WHERE only_stubs) AS stubs_surviving""")
def stub_upgrade(spark, d):
    r = _copies(spark, d)
    return r.stubs_created().withColumn("k", F.lit(0)).join(r.stubs_surviving().withColumn("k", F.lit(0)), "k").drop("k")


def _with_extras(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of documents with sidecar files (items of orders) and extensions."""
    items = table(spark, d, "lineitem").where("l_orderkey % 2 = 0")
    size = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.col("l_suppkey").cast("string"))
    lists = ordered.collected(items, ["l_orderkey"], F.struct(F.col("l_partkey").cast("string").alias("href"), size.alias("file_size")), ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "files")
    dcc = F.struct(F.lit("dcc:s").alias("id"))
    one = lists.select(F.lit("s").alias("submission"), F.lit("o").alias("id_namespace"), F.col("l_orderkey").cast("string").alias("local_id"), dcc.alias("dcc"), F.struct(F.struct(F.col("files").alias("extra_files")).alias("fourdn")).alias("extra"), F.col("l_orderkey").alias("ord"))
    x = table(spark, d, "file_extra_encode")
    members = F.struct("read_length", "run_type", "paired_end")
    two = x.select(F.lit("s").alias("submission"), F.lit("x").alias("id_namespace"), F.col("row_id").cast("string").alias("local_id"), dcc.alias("dcc"), F.struct(members.alias("encode")).alias("extra"), (F.col("row_id") + 10**9).alias("ord"))
    return flatten.flatten(flatten.as_documents(one, "ord").unionByName(flatten.as_documents(two, "ord"))).tables


@register("""
SELECT CAST(l_orderkey AS VARCHAR) AS local_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal, CAST(l_partkey AS VARCHAR) AS href, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS file_size
FROM lineitem WHERE l_orderkey % 2 = 0""")
def explode_ordinal(spark, d):
    """Sidecar files of documents with their place."""
    return _with_extras(spark, d)["file_extra_fourdn_extra_file"].select("local_id", *_big("ordinal"), "href", F.col("file_size").cast("string").alias("file_size"))


@register("SELECT CAST(row_id AS VARCHAR) AS local_id, read_length, run_type, paired_end FROM file_extra_encode WHERE read_length IS NOT NULL OR run_type IS NOT NULL OR paired_end IS NOT NULL")
def nonnull_extension(spark, d):
    """Extension rows of the documents that have any value there."""
    return _with_extras(spark, d)["file_extra_encode"].select("local_id", "read_length", "run_type", "paired_end")


# ------------------------------------------------------------------ scalars
@register(r"SELECT row_id, nullif(upper(regexp_replace(accession_id, '^\s+|\s+$', '', 'g')), '') AS accession FROM c2m2_file")
def norm_accession(spark, d):
    return table(spark, d, "c2m2_file").select("row_id", scalars.normalize_accession(F.col("accession_id")).alias("accession"))


@register("""
SELECT row_id, upper(nullif(regexp_extract('x' || replace(access_url, 'F', '4dnf'), '(?i)4DNF[A-Z0-9]+', 0), '')) AS file_accession, upper(nullif(regexp_extract(replace(access_url, 'F', '4DNEX'), '(?i)4DNE[A-Z][A-Z0-9]+', 0), '')) AS experiment_accession FROM c2m2_file""")
def regex_extract(spark, d):
    url = F.col("access_url")
    a = scalars.extract_accession(F.concat(F.lit("x"), F.replace(url, F.lit("F"), F.lit("4dnf"))))
    return table(spark, d, "c2m2_file").select("row_id", a.alias("file_accession"), scalars.extract_experiment_accession(F.replace(url, F.lit("F"), F.lit("4DNEX"))).alias("experiment_accession"))


_TOKENS = "'mcool', 'cool', 'hic', 'pairs', 'r3d', 'nd2', 'flex', 'spt', 'matrix'"


@register(f"""
SELECT row_id, string_split(access_url, '/')[-1] AS base, CASE WHEN lower(filename) LIKE '%.pairs.gz' THEN 'pairs' WHEN string_split(lower(filename), '.')[-1] IN ({_TOKENS}) THEN string_split(lower(filename), '.')[-1] END AS enriched FROM c2m2_file""")
def basename_ext(spark, d):
    return table(spark, d, "c2m2_file").select("row_id", scalars.basename(F.col("access_url")).alias("base"), scalars.enriched_file_format(F.col("filename")).alias("enriched"))


@register(r"""
WITH n AS (SELECT row_id, lower(string_split(regexp_replace(filename, '^\s+|\s+$', '', 'g'), '/')[-1]) AS b FROM c2m2_file)
SELECT row_id, CASE WHEN b IS NULL OR b = '' THEN NULL WHEN regexp_matches(b, '\.starch$|\.bz2$|\.zip$|\.zst$|\.xz$') THEN NULL WHEN regexp_matches(b, '\.gzip$|\.gz$|\.tgz$') THEN 'format:3989' WHEN b LIKE '%.bgz' THEN 'format:3615' ELSE '' END AS compression FROM n""")
def compression_suffix(spark, d):
    """Of names, and of URLs whose query and fragment do not count."""
    name = scalars.stripped(F.col("filename"))
    url = F.concat(F.lit("https://h/x.gz/"), F.url_encode(F.substring_index(name, "/", -1)), F.lit("?file=a.gz#b.zip"))
    return table(spark, d, "c2m2_file").select("row_id", scalars.compression_format(F.when((F.col("row_id") % 2 == 0) & (name != ""), F.replace(url, F.lit("+"), F.lit("%20"))).otherwise(F.col("filename"))).alias("compression"))


@register(r"""
WITH m AS (SELECT row_id, lower(regexp_extract(genome_assembly, '(?i)\b(hg38|GRCh38|hg19|GRCh37|mm10|GRCm39)\b', 1)) AS k FROM c2m2_file)
SELECT row_id, CASE k WHEN 'hg38' THEN 'GRCh38' WHEN 'grch38' THEN 'GRCh38' WHEN 'hg19' THEN 'GRCh37' WHEN 'grch37' THEN 'GRCh37' WHEN 'mm10' THEN 'GRCm38' WHEN 'grcm39' THEN 'GRCm39' END AS assembly FROM m""")
def assembly_alias(spark, d):
    return table(spark, d, "c2m2_file").select("row_id", scalars.genome_assembly(F.col("genome_assembly")).alias("assembly"))


@register(r"""
WITH s AS (SELECT row_id, regexp_replace(size_in_bytes, '^\s+|\s+$', '', 'g') AS t FROM c2m2_file)
SELECT row_id, coalesce(CASE WHEN regexp_matches(t, '^[+-]?\d+$') THEN TRY_CAST(t AS BIGINT) END, -1) AS size_in_bytes, coalesce(t <> '' AND CASE WHEN regexp_matches(t, '^[+-]?\d+$') THEN TRY_CAST(t AS BIGINT) END IS NULL, false) AS uncoercible FROM s""")
def int_coerce(spark, d):
    n = scalars.parse_int(F.col("size_in_bytes"))
    return table(spark, d, "c2m2_file").select("row_id", F.coalesce(n, F.lit(-1)).alias("size_in_bytes"), F.coalesce((scalars.stripped(F.col("size_in_bytes")) != "") & n.isNull(), F.lit(False)).alias("uncoercible"))


@register(r"""
WITH t AS (SELECT row_id, regexp_replace(creation_time, '^\s+|\s+$', '', 'g') AS t FROM c2m2_file),
iso AS (SELECT row_id, CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$') THEN t END AS t FROM t),
parts AS (SELECT row_id, t, CASE WHEN length(t) > 10 THEN regexp_extract(t, '(Z|[+-]\d{2}(?::?\d{2})?)$', 1) ELSE '' END AS z FROM iso),
w AS (SELECT row_id, z, TRY_CAST(left(replace(left(t, length(t) - length(z)), ',', '.'), 26) AS TIMESTAMP) AS wall, regexp_replace(z, '[^0-9]', '', 'g') AS digits FROM parts)
SELECT row_id, wall - to_minutes(CASE WHEN z IN ('', 'Z') THEN 0 ELSE (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(left(digits, 2) AS BIGINT) * 60 + coalesce(TRY_CAST(substr(digits, 3, 2) AS BIGINT), 0)) END) AS utc FROM w""")
def ts_utc(spark, d):
    return table(spark, d, "c2m2_file").select("row_id", scalars.timestamp_utc(F.col("creation_time")).alias("utc"))


@register("""SELECT event_id, '{"a":"' || event_type || '","k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"z":{"x":"t","y":[1,2.5,{"p":null,"q":true}]}}' AS canonical FROM events""")
def json_canonical(spark, d):
    """Numbers, nested objects and objects in arrays."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    text = F.concat(F.lit('{"z": {"y": [1, 2.5, {"q": true, "p": null}], "x": "t"}, "k": '), k, F.lit(', "a": "'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", scalars.canonical_json(text).alias("canonical"))


@register(r"""
WITH k AS (SELECT row_id, lower(regexp_replace(submission, '^\s+|\s+$', '', 'g')) AS dcc, regexp_replace(local_id, '^\s+|\s+$', '', 'g') AS id, lower(regexp_replace(md5, '^\s+|\s+$', '', 'g')) AS md5 FROM c2m2_file),
g AS (SELECT row_id, CASE WHEN dcc <> '' AND id <> '' AND NOT regexp_matches(id, '[/\\]') AND regexp_matches(md5, '^[0-9a-f]{32}$') THEN dcc || '/' || id || '/' END AS stem, md5 FROM k)
SELECT row_id, stem || md5 || '/v3' AS workflow_key, stem || 'index/' || md5 || '-v2' AS cache_key, sha256(stem || 'index/' || md5 || '-v2') AS local_path FROM g""")
def cache_key(spark, d):
    s, i, m = F.col("submission"), F.col("local_id"), F.col("md5")
    key = scalars.cache_key(s, i, "index", m, 2)
    return table(spark, d, "c2m2_file").select("row_id", scalars.workflow_key(s, i, m, 3).alias("workflow_key"), key.alias("cache_key"), scalars.local_path(key).alias("local_path"))


@register("""
WITH h AS (SELECT event_id, event_id % 1000 + 1 AS size, event_id % 7 AS a, user_id % 900 AS b, CASE event_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'a' ELSE 'n' END AS kind FROM events),
r AS (SELECT event_id, size, CASE kind WHEN 'n' THEN greatest(size - b, 0) ELSE a END AS f, CASE kind WHEN 'ab' THEN least(b, size - 1) ELSE size - 1 END AS l, kind, a, b FROM h)
SELECT event_id, CASE WHEN f < size AND f <= l AND NOT (kind = 'n' AND b = 0) THEN f ELSE -1 END AS first_byte, CASE WHEN f < size AND f <= l AND NOT (kind = 'n' AND b = 0) THEN l ELSE -1 END AS last_byte FROM r""")
def range_header(spark, d):
    a, b = (F.col("event_id") % 7).cast("string"), (F.col("user_id") % 900).cast("string")
    header = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("bytes="), a, F.lit("-"), b)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).otherwise(F.concat(F.lit("bytes=-"), b))
    r = scalars.byte_range(header, F.col("event_id") % 1000 + 1)
    return table(spark, d, "events").select("event_id", F.coalesce(r["first"], F.lit(-1)).alias("first_byte"), F.coalesce(r["last"], F.lit(-1)).alias("last_byte"))


@register(r"SELECT row_id, regexp_replace(regexp_replace(access_url, '[?#].*$', ''), '://[^/@]*@', '://') AS redacted, left(regexp_replace('at ' || coalesce(regexp_replace(access_url, '^[a-z0-9]+:/', ''), ''), ' /[A-Za-z](?:[A-Za-z0-9_.\\-]*/)+[A-Za-z0-9_.\\-]*', ' <path>', 'g'), 1024) AS scrubbed FROM c2m2_file")
def scrub_paths(spark, d):
    url = F.col("access_url")
    message = F.concat(F.lit("at "), F.coalesce(F.regexp_replace(url, "^[a-z0-9]+:/", ""), F.lit("")))
    return table(spark, d, "c2m2_file").select("row_id", scalars.redacted_url(url).alias("redacted"), scalars.scrubbed(message).alias("scrubbed"))


@register("""
WITH v(k, id, name) AS (VALUES ('Homo sapiens', 'NCBI:txid9606', 'Homo sapiens'), ('human', 'NCBI:txid9606', 'Homo sapiens'), ('Mus musculus', 'NCBI:txid10090', 'Mus musculus'), ('mouse', 'NCBI:txid10090', 'Mus musculus'),
    ('Drosophila melanogaster', 'NCBI:txid7227', 'Drosophila melanogaster'), ('Caenorhabditis elegans', 'NCBI:txid6239', 'Caenorhabditis elegans'))
SELECT row_id, v.id AS taxon_id, v.name AS taxon_name FROM file_extra_encode LEFT JOIN v ON v.k = organism""")
def ontology_terms(spark, d):
    t = ontology.taxonomy(F.col("organism"))
    return table(spark, d, "file_extra_encode").select("row_id", t["id"].alias("taxon_id"), t["name"].alias("taxon_name"))


_FORMATS = ("fastq", "BAM", "bed bed3+", "bigBed bedRnaElements", "hic", "starch", "GTF", "nonsense", "bed narrowPeak", "biginteract", " ", "tar")
_OUTPUTS = ("raw reads", "alignments", "IDR ranked peaks", "fold change over control", "gene quantifications", "methylation state at CHH", "contact matrix", "nonsense", "genome reference", "enrichment", "candidate Cis-Regulatory Elements", "variant calls")
_ASSAYS = ("ATAC-seq", "TF ChIP-seq", "long read RNA-seq", "scRNA-seq", "WGBS", "intact Hi-C", "eCLIP", "nonsense", "CUT&RUN", "10x multiome", "PRO-cap", "5C")


@register("""
WITH v(k, f, o, a) AS (VALUES (0, 'format:1930', 'data:0924', 'OBI:0002039'), (1, 'format:2572', 'data:0863', 'OBI:0000716'), (2, 'format:3003', 'data:3002', 'OBI:0001271'), (3, 'format:3004', 'data:2884', 'OBI:0002631'), (4, 'format:3590', 'data:2603', 'OBI:0001863'), (5, 'format:3003', 'data:1772', 'OBI:0002042'),
    (6, 'format:2306', 'data:2082', 'OBI:0002111'), (7, NULL, NULL, NULL), (8, 'format:3613', 'data:2340', 'OBI:0003003'), (9, 'minted:biginteract', 'data:2048', 'OBI:0002764'), (10, NULL, 'data:1255', 'OBI:0002084'), (11, 'format:3981', 'data:3498', 'OBI:0001916'))
SELECT row_id, f AS format_id, o AS output_id, a AS assay_id FROM c2m2_file JOIN v ON k = row_id % 12""")
def format_terms(spark, d):
    """X11: terms of formats (by the whole text, else its first word), outputs and assays."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("row_id") % 12 + 1).cast("int"))
    return table(spark, d, "c2m2_file").select("row_id", ontology.file_format(of(_FORMATS))["id"].alias("format_id"), ontology.output_type(of(_OUTPUTS))["id"].alias("output_id"), ontology.assay_type(of(_ASSAYS))["id"].alias("assay_id"))


@register("SELECT row_id, nullif(regexp_extract('Biorep ' || row_id || ', Techrep ' || load_no, 'Biorep\\s+(\\S+)', 1), '') AS bio, nullif(regexp_extract('Biorep ' || row_id || ', Techrep ' || load_no, 'Techrep\\s+(\\S+)', 1), '') AS tech FROM c2m2_file")
def replicates(spark, d):
    text = F.concat(F.lit("Biorep "), F.col("row_id").cast("string"), F.lit(", Techrep "), F.col("load_no").cast("string"))
    return table(spark, d, "c2m2_file").select("row_id", scalars.replicate(text, "Biorep").alias("bio"), scalars.replicate(text, "Techrep").alias("tech"))


@register(r"""
SELECT row_id, list_aggregate(list_transform(list_filter(list_transform(string_split(regexp_replace(derived_from, '^\s+|\s+$', '', 'g'), ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''),
    lambda p: coalesce(nullif(regexp_extract(p, '/([A-Z0-9]+)/?$', 1), ''), p)), 'string_agg', ';') AS ids FROM file_extra_encode""")
def donor_list(spark, d):
    return table(spark, d, "file_extra_encode").select("row_id", F.nullif(F.array_join(scalars.donor_ids(F.col("derived_from")), ";"), F.lit("")).alias("ids"))


# ------------------------------------------------------------------ slices
@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_orderkey, 'F' FROM lineitem WHERE l_linenumber = 1")
def slice_replace(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"))
    return slices.replace_slice(old, new, {"o_orderstatus": "F"})


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def upsert(spark, d):
    return slices.upsert(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), ["c_custkey"])


@register("SELECT c_custkey, coalesce(nullif(s_name, ''), c_name) AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'public' END AS level FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def dotted_update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = enrich.update_columns(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), "c_custkey", ["c_name"])
    return slices.stamp(out, F.col("c_mktsegment") == "BUILDING", {"level": F.lit("public")}).select("c_custkey", "c_name", "level")


@register("""
SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN 'added' WHEN s_suppkey IS NULL THEN 'dropped' ELSE 'updated' END AS change
FROM customer FULL JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey IS NULL OR s_suppkey IS NULL OR c_nationkey <> s_nationkey""")
def diff_tables(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return slices.changes_between(old, new, ["k"], ["nation"])


# ------------------------------------------------------------------ intervals and matrices
def _beds(spark: SparkSession, d: str) -> DataFrame:
    """Line items as interval lines: brand as chromosome."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat_ws("\t", "p_brand", F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    return rows.select(line.alias("line"))


_LINES = "SELECT p_brand || chr(9) || l_suppkey || chr(9) || (l_suppkey + l_linenumber) || chr(9) || l_orderkey || chr(9) || l_partkey AS line, p_brand, l_suppkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey"


@register(f"SELECT line, row_number() OVER (ORDER BY p_brand, l_suppkey, line) AS place FROM ({_LINES})")
def interval_sort(spark, d):
    """O3, G1: every line with its place in the sorted file."""
    return _numbered(intervals.sorted_records(intervals.parsed(_beds(spark, d), "bed")))


@register(f"SELECT line, row_number() OVER (ORDER BY is_body, CASE WHEN is_body = 0 THEN n END, chrom, pos, line) AS place FROM (SELECT '#h' || r_regionkey AS line, 0 AS is_body, r_regionkey AS n, NULL AS chrom, NULL AS pos FROM region UNION ALL SELECT line, 1, NULL, p_brand, l_suppkey FROM ({_LINES}))")
def header_first_sort(spark, d):
    """Header lines first, in their order."""
    heads = table(spark, d, "region").select(F.concat(F.lit("#h"), F.col("r_regionkey").cast("string")).alias("line"), F.col("r_regionkey").cast("bigint").alias("line_no"))
    body = _beds(spark, d).withColumn("line_no", F.lit(99).cast("bigint"))
    return _numbered(intervals.sorted_records(intervals.parsed(heads.unionByName(body), "vcf")))


def _numbered(srt: DataFrame) -> DataFrame:
    """Place of each line in a sorted frame: range partitions are numbered in order, each task counts its own."""
    at = persisted(srt.select("line", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "sorted")
    sizes = at.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("first"))  # as many rows as partitions
    before = sizes.select("p", "first", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), "p").select("line", (F.col("m") - F.col("first") + F.col("before") + 1).alias("place"))


@register("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = r AND l_partkey < p) AS out_of_order FROM (SELECT *, lag(l_returnflag) OVER w AS r, lag(l_partkey) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)) GROUP BY 1")
def sortedness_check(spark, d):
    li = table(spark, d, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return intervals.unsorted(li, ["l_suppkey"], "at", "l_returnflag", "l_partkey")


@register("SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'")
def data_line_count(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat(F.when(F.col("l_returnflag") == "R", "#").otherwise(""), F.lit("x\t1\t2")).alias("line"))
    return intervals.data_lines(intervals.parsed(lines, "bed"))


@register("""
WITH w AS (SELECT n_regionkey, n_nationkey, n_nationkey * 40 AS w_start, n_nationkey * 40 + 60 AS w_end FROM nation),
r AS (SELECT event_id, user_id % 5 AS g, event_id % 1000 AS s, event_id % 1000 + 1 + user_id % 70 AS e FROM events)
SELECT event_id, n_nationkey FROM r JOIN w ON g = n_regionkey AND s < w_end AND e > w_start""")
def range_overlap(spark, d):
    r = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("g"), (F.col("event_id") % 1000).alias("s"), (F.col("event_id") % 1000 + 1 + F.col("user_id") % 70).alias("e"))
    w = table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("g"), "n_nationkey", (F.col("n_nationkey") * 40).alias("w_start"), (F.col("n_nationkey") * 40 + 60).alias("w_end"))
    return intervals.overlapping(r, w, "g", "s", "e", 100).select("event_id", "n_nationkey")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_partkey") % 900, F.col("l_suppkey") % 900
    li = table(spark, d, "lineitem").select(F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"))
    return li.groupBy("bin1_id", "bin2_id").agg(F.count("*").alias("count"))


_PIXELS = "SELECT least(l_partkey % 900, l_suppkey % 900) AS bin1_id, greatest(l_partkey % 900, l_suppkey % 900) AS bin2_id, count(*) AS count FROM lineitem GROUP BY 1, 2"
_CHROMS = [("c1", 4001, 0), ("c2", 2999, 1), ("c3", 1990, 2)]


@register(f"""
WITH c(chrom, length, o, fine, coarse) AS (VALUES ('c1', 4001, 0, 0, 0), ('c2', 2999, 1, 401, 201), ('c3', 1990, 2, 701, 351)),
b AS (SELECT fine + i AS bin, coarse + i // 2 AS c FROM c, range(0, 900) r(i) WHERE i * 10 < length)
SELECT least(x.c, y.c) AS bin1_id, greatest(x.c, y.c) AS bin2_id, CAST(sum(count) AS BIGINT) AS count FROM ({_PIXELS}) JOIN b x ON x.bin = bin1_id JOIN b y ON y.bin = bin2_id GROUP BY 1, 2""")
def coarsen_2x(spark, d):
    chroms = spark.createDataFrame(_CHROMS, "chrom string, length long, ord int")
    return matrix.coarsen(_pixels(spark, d), matrix.make_bins(chroms, 10), matrix.make_bins(chroms, 20))


@register(f"SELECT bin1_id, bin2_id, count FROM ({_PIXELS}) UNION ALL SELECT bin2_id, bin1_id, count FROM ({_PIXELS}) WHERE bin1_id <> bin2_id")
def tile_symmetrise(spark, d):
    return matrix.symmetric(_pixels(spark, d))


@register(f"""
WITH s AS (SELECT bin1_id, bin2_id, count FROM ({_PIXELS}) UNION ALL SELECT bin2_id, bin1_id, count FROM ({_PIXELS}) WHERE bin1_id <> bin2_id)
SELECT bin1_id - 256 AS row, bin2_id AS col, count FROM s WHERE bin1_id BETWEEN 256 AND 511 AND bin2_id BETWEEN 0 AND 255""")
def tile_window(spark, d):
    return matrix.tile_window(_pixels(spark, d), x=0, y=1)


@register(f"""
WITH s AS (SELECT bin1_id, bin2_id, count FROM ({_PIXELS}) UNION ALL SELECT bin2_id, bin1_id, count FROM ({_PIXELS}) WHERE bin1_id <> bin2_id),
w AS (SELECT count FROM s WHERE bin1_id BETWEEN 0 AND 255 AND bin2_id BETWEEN 0 AND 255)
SELECT CASE WHEN count(*) < 65536 THEN 0.0 ELSE CAST(min(count) AS DOUBLE) END AS min_value, CAST(max(count) AS DOUBLE) AS max_value, 65536 AS size FROM w""")
def tile_stats(spark, d):
    return matrix.dense_tile(matrix.tile_window(_pixels(spark, d), 0, 0)).select("min_value", "max_value", "size")


@register("""
WITH e AS (SELECT event_id, event_id % 6 AS k, user_id % 5 AS z, user_id % 9 AS x FROM events), r AS (SELECT *, k < 3 AS known, CASE z WHEN 0 THEN 4000 WHEN 1 THEN 2000 WHEN 2 THEN 1000 END AS bin FROM e)
SELECT event_id, CASE WHEN k = 5 THEN 'malformed tile id' WHEN k = 4 THEN 'no such tileset' WHEN bin IS NULL THEN 'no such zoom level' WHEN x * 256 * bin >= 2000000 THEN 'no such position' WHEN k = 3 THEN 'no such balancing column' END AS error,
    CASE WHEN k < 4 THEN CAST(bin AS VARCHAR) END AS bin_size FROM r""")
def tile_requests(spark, d):
    """Every requested tile id has one answer, its bin size by zoom or why there is none."""
    k, z, x = F.col("event_id") % 6, (F.col("user_id") % 5).cast("string"), (F.col("user_id") % 9).cast("string")
    uid = F.when(k == 4, "other").otherwise("m_1")
    text = F.concat_ws(".", uid, z, F.when(k == 5, "x").otherwise(x), F.lit("0"), F.when(k == 3, "none").when(k == 2, "weight"))
    ids = table(spark, d, "events").select("event_id", text.alias("id"))
    levels = spark.createDataFrame([("m_1", [1000, 2000, 4000], 2_000_000, ["weight"])], "uid string, resolutions array<long>, extent long, balancing array<string>")
    return matrix.requested_tiles(ids, "id", levels).select("event_id", "error", F.col("bin_size").cast("string").alias("bin_size"))


@register("""
SELECT event_id FROM (SELECT event_id, event_id % 900 AS a, user_id % 900 AS b FROM events) WHERE (a < 300 AND a + 10 > 250) OR (b < 300 AND b + 10 > 250)""")
def link_tile(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 900).alias("a_start"), (F.col("event_id") % 900 + 10).alias("a_end"), (F.col("user_id") % 900).alias("b_start"), (F.col("user_id") % 900 + 10).alias("b_end"))
    return matrix.links_in_tile(e, 250, 300).select("event_id")


# ------------------------------------------------------------------ jobs
@register("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark, d):
    return jobs.latest_state(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")


_JOBS = "SELECT user_id AS job_id, max(ts) AS updated_at, min(ts) AS next_dispatch_at, max_by(event_type, (ts, event_id)) IN ('view', 'click') AS active FROM events GROUP BY 1"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("updated_at"), F.min("ts").alias("next_dispatch_at"), F.max_by("event_type", F.struct("ts", "event_id")).isin("view", "click").alias("active"))


@register(f"WITH j AS ({_JOBS}) SELECT job_id, updated_at FROM j WHERE active AND updated_at < (SELECT max(ts) FROM events) - INTERVAL 900 SECOND")
def stale_jobs(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return jobs.stale_jobs(_jobs(spark, d), now).select("job_id", "updated_at")


@register(f"WITH j AS ({_JOBS}) SELECT count(*) FILTER (WHERE active) AS active_jobs, count(*) FILTER (WHERE active) < 1024 AS admitted FROM j")
def admission(spark, d):
    return jobs.active_jobs(_jobs(spark, d))


@register(f"WITH j AS ({_JOBS}) SELECT job_id, next_dispatch_at FROM j WHERE active ORDER BY next_dispatch_at, job_id LIMIT 1")
def lease_top1(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return jobs.lease_due(_jobs(spark, d), now).select("job_id", "next_dispatch_at")


@register(f"WITH j AS ({_JOBS}) SELECT job_id FROM j WHERE active OR updated_at >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def ttl_expire(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return jobs.expire(_jobs(spark, d), now, timedelta(days=1)).select("job_id")


@register("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS beats FROM s GROUP BY user_id, n""")
def heartbeat_sessions(spark, d):
    return jobs.heartbeat_gaps(table(spark, d, "events"), "user_id", "ts", timedelta(seconds=3600))


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    """Four events a job – claim, start, heartbeat, complete – at the events' times, so in any order; 97 keys."""
    n = F.floor(F.col("event_id") / 4)
    kind = F.element_at(F.array(*map(F.lit, ("claim", "start", "heartbeat", "complete"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.concat(F.lit("key-"), (n % 97).cast("string")).alias("workflow_key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit("job-"), n.cast("string")).alias("job_id"), F.lit(None).cast("string").alias("payload"),
    )


@register()
def job_fold(spark, d):
    """The job table folded from the events; a state machine that SQL cannot run."""
    return jobs.fold_jobs(_job_events(spark, d))


@register()
def job_fold_stream(spark, d):
    """T7, T8 as a stream with state by key; the last state of each job."""
    events = persisted(_job_events(spark, d), "job-events")
    source = spark.readStream.schema(events.schema).parquet(scratch_tables(spark)[-1])
    out, at = scratch_path(spark, "job-states"), scratch_path(spark, "job-stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")

    stream = jobs.job_stream(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
    stream.awaitTermination()
    states = spark.read.schema(f"{jobs.JOB}, batch int, n int").parquet(out)
    return ordered.last_wins(states, ["job_id"], ["n"]).drop("batch", "n")


# ------------------------------------------------------------------ raw documents end to end
def document_docs(spark: SparkSession, d: str) -> DataFrame:
    """The raw file documents in the document type, with their order; of repeated file keys the last delivered."""
    raw = table(spark, d, "file_document")
    schema = nested.merged_schema(raw, "payload", ["collections", "collections/biosamples", "collections/biosamples/subjects", "collections/subjects", "extra/fourdn/extra_files"])
    records = nested.shaped_records(raw, "record_id", "payload", schema)
    text = F.to_json("record")
    docs = records.select("record_id", F.from_json(F.regexp_replace(text, '"plain_value":', '"id":'), flatten.FILE.simpleString()).alias("doc"))
    docs = docs.join(raw.select("record_id", F.col("submission").alias("_submission"), "received_at"), "record_id").select("doc.*", "_submission", "received_at", F.col("record_id").alias("ord"))
    docs = ordered.lookup(docs, table(spark, d, "c2m2_dcc"), {"_submission": "submission"}, "_centre", ["load_no", "row_id"], flatten.DCC.names)
    docs = docs.withColumn("submission", F.coalesce("submission", "_submission")).withColumn("dcc", F.coalesce("dcc", "_centre")).drop("_centre")
    return ordered.last_wins(docs, ["id_namespace", "local_id"], ["received_at", "ord"]).drop("_submission", "received_at")


@register()
def document_stats(spark, d):
    """Row counts, conflicts and counters of the raw file documents, whatever state they are in."""
    return flatten.flatten(persisted(document_docs(spark, d), "documents")).stats()
