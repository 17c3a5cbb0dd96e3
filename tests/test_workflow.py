"""Declared stages: what is made, what is found, what is cleaned."""

import pytest
from pyspark.sql import functions as F

from lumenrv.plans.workflow import Stage, Workflow


def flow(spark, tmp_path, factor=2, version=1):
    return Workflow(spark, f"file://{tmp_path}/out", {"raw": f"file://{tmp_path}/raw"}, [
        Stage("scaled", lambda t, p: t["raw"].select((F.col("v") * p["factor"]).alias("v")), ["raw"], {"factor": factor}),
        Stage("kept", lambda t, p: t["raw"].filter("v > 1"), ["raw"], version=version),
        Stage("both", lambda t, p: t["scaled"].union(t["kept"]), ["scaled", "kept"]),
    ])


def test_only_what_has_changed_is_made(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "v int").write.parquet(f"{tmp_path}/raw")
    found, made = flow(spark, tmp_path).run()
    assert made == ["scaled", "kept", "both"] and sorted(r.v for r in found["both"].collect()) == [2, 2, 3, 4, 6]
    spark.sparkContext.setJobGroup("again", "again")
    try:
        found, made = flow(spark, tmp_path).run()
        assert made == [] and list(spark.sparkContext.statusTracker().getJobIdsForGroup("again")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.v for r in found["both"].collect()) == [2, 2, 3, 4, 6]
    assert flow(spark, tmp_path, factor=5).run()[1] == ["scaled", "both"]
    assert flow(spark, tmp_path, factor=5, version=2).run()[1] == ["kept", "both"]
    assert flow(spark, tmp_path).run()[1] == []  # the first results are still there
    away = flow(spark, tmp_path, factor=5, version=2).clean()
    assert [a.split("/")[0] for a in away] == ["both", "both", "kept", "scaled"]
    assert flow(spark, tmp_path, factor=5, version=2).run()[1] == []
    spark.createDataFrame([(9,)], "v int").write.mode("append").parquet(f"{tmp_path}/raw")
    found, made = flow(spark, tmp_path, factor=5, version=2).run()
    assert made == ["scaled", "kept", "both"] and found["both"].count() == 7
    assert len(flow(spark, tmp_path, factor=5, version=2).clean(all_=True)) == 6


def test_killed_stages_are_made_anew_and_wrong_declarations_are_told(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(f"{tmp_path}/raw")
    one = flow(spark, tmp_path)
    prints = one.fingerprints()
    spark.createDataFrame([(77,)], "v int").write.parquet(f"{tmp_path}/out/scaled/{prints['scaled']}")  # half-done: without its mark
    found, made = one.run()
    assert "scaled" in made and sorted(r.v for r in found["scaled"].collect()) == [2, 4]
    with pytest.raises(ValueError):
        Workflow(spark, "x", {"a": "y"}, [Stage("s", lambda t, p: t["b"], ["b"])])
    with pytest.raises(ValueError):
        Workflow(spark, "x", {"a": "y"}, [Stage("a", lambda t, p: t["a"], ["a"])])
    with pytest.raises(FileNotFoundError):
        Workflow(spark, f"file://{tmp_path}/out", {"a": f"file://{tmp_path}/none"}, []).fingerprints()
