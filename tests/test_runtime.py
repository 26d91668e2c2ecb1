import os
import time

import pytest
from pyspark.sql import functions as F

from filament import runtime


def test_written_tables(spark):
    runtime.clean_scratch(spark)
    a = runtime.persisted(spark.range(3), "x")
    path = runtime.scratch_tables(spark)[0].removeprefix("file://")
    assert a.count() == 3 and os.path.isdir(path)
    assert runtime.clean_scratch(spark) == 1 and not os.path.isdir(path) and runtime.clean_scratch(spark) == 0


def test_tables_end_with_their_results(spark):
    import gc

    runtime.clean_scratch(spark)

    def result():
        return runtime.persisted(spark.range(5), "x").where("id > 1").groupBy().count()

    df = result()
    gc.collect()
    spark._jvm.System.gc()
    runtime.prepare(spark)
    assert len(runtime.scratch_tables(spark)) == 1 and df.first()[0] == 3
    del df
    for _ in range(100):  # references from Python end in the background
        time.sleep(0.1)
        gc.collect()
        spark._jvm.System.gc()
        runtime.prepare(spark)
        if not runtime.scratch_tables(spark):
            break
    assert not runtime.scratch_tables(spark)


def test_keys_and_blanks(spark):
    df = spark.createDataFrame([(x,) for x in (" A\t", "", " \n", None, " b ")], "x string")
    assert [tuple(r) for r in df.select(runtime.is_blank(F.col("x")), runtime.fold_key(F.col("x"))).collect()] == [(False, "a"), (True, ""), (True, ""), (True, None), (False, "b")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(Session())
