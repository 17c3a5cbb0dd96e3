"""Drifts on a stream: what is kept and given does not grow with revisions, and one group keeps many tasks busy."""

import pandas as pd
from pyspark.sql import functions as F

from lumenrv.streaming import references


class Handle:
    """State in memory; a map of rows is not to be had."""

    def __init__(self):
        self.kept = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, row):
        self.kept = row


def test_the_state_is_one_row_and_rows_are_given_once():
    handle, processor = Handle(), references.Drifts()
    processor.init(handle)
    frame = lambda rows, offer: pd.DataFrame([("g", i, float(p), v, offer) for i, p, v in rows], columns=["group", "item", "place", "value", "is_offer"])
    batches = [[frame([(k, 100 - k, 1.0) for k in range(n * 10, n * 10 + 10)], False), frame([(n * 10 + 9, 91 - n * 10, float(n))], True)] for n in range(5)]
    given = pd.concat([f for b in batches for f in processor.handleInputRows(("g", 0), iter(b), None)])
    assert (~given["revises"]).sum() == 50 and given["revises"].sum() == 5 and given[given["revises"]]["reference"].tolist() == [0.0, 1, 2, 3, 4]
    assert handle.kept == (51.0, 49, 4.0, 5, 50) and sorted(given[~given["revises"]]["turn"]) == list(range(50))
    other = references.Drifts()
    other.init(Handle())
    assert not any(f["revises"].any() for b in batches for f in other.handleInputRows(("g", 1), iter(b), None))  # given by one part only


def test_one_group_is_dealt_over_parts_and_items_replace_themselves(spark, tmp_path):
    rows = [(None, i, float(300 - i), float(i), "F" if i % 50 == 49 else "O") for i in range(300)]
    again = [(None, i, 500.0, -float(i), "O") for i in range(0, 300, 7)] + [(None, 1, float("nan"), 7.0, "F"), (None, 2, None, 8.0, "F")]
    schema = "g string, i long, p double, v double, kind string"
    for part in (rows[:150], rows[150:], again):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    references.run_to_end(references.drifts(stream, "g", "i", "p", "v", F.col("kind") == "F"), f"{tmp_path}/out", f"{tmp_path}/cp")
    given = spark.read.parquet(f"{tmp_path}/out")
    assert given.filter("not revises").count() == len(rows) + len(again)
    assert given.filter("not revises").select(F.input_file_name()).distinct().count() > 3  # more tasks than batches
    got = {r.item: (r.group, r.value, r.reference) for r in references.settled(given).collect()}
    last = {i: v for _, i, _, v, _ in rows + again}
    assert got == {i: (None, v, 299.0) for i, v in last.items()}
