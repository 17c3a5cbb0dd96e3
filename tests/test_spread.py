"""Work on long arrays is spread over tasks and bounded in each, whatever the size of the table it is made of."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenrv.kernels import curves
from lumenrv.plans import kernels, stages
from lumenrv.sources.scratch import EXPOSURES_A_TASK

SF = "/root/testdata/sf0.001"


def sizes(df):
    return [r.n for r in df.mapInPandas(lambda parts: [pd.DataFrame({"n": [sum(len(p) for p in parts)]})], "n long").collect()]


def test_straight_splines_need_no_solving(monkeypatch):
    x, y = np.array([0.0, 1, 3, 4, 8]), np.array([1.0, -2, 5, 0, 3])
    monkeypatch.setattr(np.linalg, "solve", None)
    at = np.linspace(-1, 9, 57)
    assert np.allclose(curves.Spline(x, y, 1, "constant")(at), np.interp(at, x, y), atol=1e-14)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_exposures_are_dealt_evenly(spark):
    each = sizes(kernels.frames(spark, SF, 20))  # 25 exposures
    assert len(each) == 4 and sum(each) == 25 and max(each) <= 8
    each = sizes(kernels.frames(spark, SF, 2))
    assert sum(each) == 250 and max(each) <= EXPOSURES_A_TASK


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tasks_of_stacked_exposures_do_not_grow_with_the_table(spark, tmp_path):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    copies = emb.crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    copies.withColumn("vec_id", F.col("vec_id") + 1000 * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/embeddings.parquet")
    each = sizes(stages.stacked_exposures(spark, str(tmp_path)))
    assert sum(each) == 500 and max(each) <= 2 * EXPOSURES_A_TASK
