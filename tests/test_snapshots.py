"""Commits of changed sources, killed and repeated ones, and drifts on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrv.operators import intervals
from lumenrv.sources.snapshots import Conflict, SnapshotTable
from lumenrv.streaming import references


def state(spark, rows):
    """Rows (source, value) with a hash for each source, and what gives the rows of some sources."""
    df = spark.createDataFrame(rows, "s string, v int").withColumn("__source", F.col("s"))
    hashes = df.groupBy(F.col("s").alias("source")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.col("v").cast("string"))), ",").cast("binary")).alias("hash"))
    asked = []

    def work(sources):
        asked.extend(sorted(r.source for r in sources.collect()))
        return df.join(sources.withColumnRenamed("source", "__source"), "__source", "left_semi")

    return hashes, work, asked


def values(df):
    return sorted((r.s, r.v) for r in df.collect())


def test_changed_sources_are_replaced_in_one_commit(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None and table.versions() == []
    one = [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    hashes, work, asked = state(spark, one)
    assert table.commit(hashes, work) == 1 and asked == ["a", "b", "c"] and values(table.read()) == one
    assert table.commit(hashes, work) is None and asked == ["a", "b", "c"]  # the same state again: no work, no version
    hashes, work, asked = state(spark, [("b", 5), ("b", 6), ("d", 7)])
    assert table.commit(hashes, work) == 2 and asked == ["b", "d"]
    two = [("a", 1), ("a", 2), ("b", 5), ("b", 6), ("c", 4), ("d", 7)]
    assert values(table.read()) == two and values(table.read(1)) == one
    hashes, work, asked = state(spark, [("b", 5), ("b", 6), ("d", 8)])
    assert table.commit(hashes, work, gone=True) == 3 and asked == ["d"]
    assert values(table.read()) == [("b", 5), ("b", 6), ("d", 8)] and values(table.read(2)) == two
    gone = table.vacuum(keep=1)
    assert len([n for n in gone if n.startswith("versions/")]) == 2 and values(table.read()) == [("b", 5), ("b", 6), ("d", 8)] and table.versions() == [3]
    assert table.commit(spark.createDataFrame([], "source string, hash string"), work, gone=True) == 4 and values(table.read()) == []


def test_killed_and_rival_commits_leave_one_version(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    hashes, work, _ = state(spark, [("a", 1), (None, 9)])
    table.commit(hashes, work)
    hashes, work, _ = state(spark, [("a", 2)])
    with pytest.raises(RuntimeError), monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        table.commit(hashes, work)
    assert values(table.read()) == [("a", 1)] and table.versions() == [1]
    rival = SnapshotTable(spark, f"file://{tmp_path}/t")

    def late(sources):
        rival.commit(*state(spark, [("a", 3)])[:2])
        return work(sources)

    with pytest.raises(Conflict):
        table.commit(hashes, late)
    assert values(table.read()) == [("a", 3)] and table.versions() == [1, 2]
    assert table.commit(hashes, work) == 3 and values(table.read()) == [("a", 2)]
    assert len(table.vacuum()) >= 4 and values(table.read()) == [("a", 2)]


def test_late_references_revise_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"g{i % 4}" if i % 9 else None, i, None if i % 23 == 0 else float(rng.randint(0, 30)), None if i % 13 == 0 else float(i), "F" if rng.random() < 0.15 else None if i % 5 == 0 else "O") for i in range(120)]
    schema = "g string, i long, p double, v double, kind string"
    rows.sort(key=lambda r: -(r[2] or 0))  # later places first, so that references come ever earlier
    for k in range(6):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    references.run_to_end(references.drifts(stream, "g", "i", "p", "v", F.col("kind") == "F"), f"{tmp_path}/out", f"{tmp_path}/cp")
    given = spark.read.parquet(f"{tmp_path}/out")
    assert given.agg(F.max("revision")).first()[0] > 1
    want = intervals.first_match(spark.createDataFrame(rows, schema), ["g"], (F.col("kind") == "F") & F.col("p").isNotNull(), ["p", "i"], {"v": "ref"}).collect()
    assert {(r.group, r.item): r.reference for r in references.settled(given).collect()} == {(r.g, r.i): r.ref for r in want}
