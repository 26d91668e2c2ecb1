"""All queries of the core by name, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from filament.plans import data_problems, data_problems_sql, raw_queries, reference_queries
from filament.runtime import prepare

# raw_queries registers its queries beside those of reference_queries
assert raw_queries.register is reference_queries.register
QUERIES = dict(data_problems.QUERIES) | dict(reference_queries.QUERIES)
ORACLE = dict(data_problems_sql.ORACLE) | dict(reference_queries.ORACLE)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Nested file documents, filtered and paged."""
    return reference_queries.page_of_files(prepare(spark), d, 0)
