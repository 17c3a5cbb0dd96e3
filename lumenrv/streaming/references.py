"""Drifts against the first reference of each group on a stream, which a late and earlier reference revises."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "group string, item long, place double, value double, reference double, revision long, revises boolean, turn long"
#: Groups whose first references a task holds at most before it hands them on.
HELD = 100_000


class Drifts(StatefulProcessor):
    """State of a part of a group: its reference (place, item, value; null before there is one), its revisions and its rows so far, as numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "place double, item long, value double, revision long, turn long")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        group, part = key
        place, item, value, revision, turn = self.known.get() if self.known.exists() else (None, None, None, 0, 0)
        for new in rows:  # some thousand at a time
            offered = new["is_offer"].astype(bool)
            for first in new[offered].sort_values(["place", "item"]).head(1).itertuples():
                if place is None or (first.place, first.item) < (place, item):
                    place, item, value, revision = float(first.place), int(first.item), None if pd.isna(first.value) else float(first.value), revision + 1
                    if part == 0:  # every part is offered the same references
                        yield self._given(new.loc[[first.Index]], group, value, revision, True, turn)
            fresh = new[~offered]
            if len(fresh):
                yield self._given(fresh, group, value, revision, False, turn)
                turn += len(fresh)
        self.known.update((place, item, value, revision, turn))

    @staticmethod
    def _given(rows: pd.DataFrame, group: str, reference: float | None, revision: int, revises: bool, turn: int) -> pd.DataFrame:
        kinds = {"item": "int64", "place": "float64", "value": "float64", "reference": "float64"}
        return rows[["item", "place", "value"]].assign(group=group, reference=reference, revision=revision, revises=revises, turn=turn + np.arange(len(rows))).astype(kinds)


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each group of a task, by place, then item."""
    held = None
    for rows in batches:
        held = (rows if held is None else pd.concat([held, rows])).sort_values(["place", "item"]).drop_duplicates("group")
        if len(held) > HELD:
            yield held
            held = None
    if held is not None:
        yield held


def drifts(stream: DataFrame, group: str, item: str, place: str, value: str, reference: Column, parts: int = 16) -> DataFrame:
    """group, item, place, value, reference, revision, revises, turn: every row with the value of its group's first reference (by place, then item).

    A row is given once, when it comes, with the reference known then. An earlier reference of its group that comes later is given
    as one row more, with revises true and a greater revision, which stands for all rows of the group that were given before; settled()
    applies the last one and gives what a table of all rows would. An item that comes again, with a greater turn, replaces itself.

    A group's rows are dealt over parts by item, and each task offers every part the first reference of its group, so that few
    groups, or one, keep many tasks busy; parts=1 spares these offers where groups are many and small. The state is one row
    for each part, whatever the number of rows. Needs the state store of RocksDB: spark.sql.streaming.stateStore.providerClass.
    """
    columns = [F.col(group).cast("string").alias("group"), F.col(item).cast("long").alias("item"), F.col(place).cast("double").alias("place"), F.col(value).cast("double").alias("value")]
    rows = stream.select(*columns, F.coalesce(reference, F.lit(False)).alias("is_offer"))
    offers = rows.filter(F.col("is_offer") & F.col("place").isNotNull() & ~F.isnan("place")).mapInPandas(_first_of_each, rows.schema)
    offers = offers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumns({"is_offer": F.lit(False), "part": F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")})
    return rows.unionByName(offers).groupBy("group", "part").transformWithStateInPandas(statefulProcessor=Drifts(), outputStructType=OUT, outputMode="update", timeMode="none")


def settled(given: DataFrame) -> DataFrame:
    """Every item of a table that drifts() was written to, as it came last, with its group's last reference and revision."""
    last = given.filter("revises").groupBy("group").agg(F.max_by("reference", "revision").alias("reference"), F.max("revision").alias("revision"))
    rows = given.filter("not revises").groupBy("group", "item").agg(F.max_by("place", "turn").alias("place"), F.max_by("value", "turn").alias("value"))
    last = last.withColumnRenamed("group", "__group")
    found = rows.join(last, F.col("group").eqNullSafe(F.col("__group")), "left")
    return found.select("group", "item", "place", "value", "reference", F.coalesce("revision", F.lit(0)).alias("revision"))


def run_to_end(given: DataFrame, out: str, checkpoint: str) -> None:
    """Write what drifts() gives of the rows that are there to the parquet folder out, one batch after the other.

    Each batch has a folder of its own, which it replaces if it is run again after a failure.
    """
    spark = given.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = given.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
