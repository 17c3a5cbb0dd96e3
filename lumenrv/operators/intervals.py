"""Range joins, lookups and set filters that the pipeline needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrv.operators.ordered import in_blocks, running
from lumenrv.operators.robust import crowded


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, *, width: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Points with the ranges that hold them, strictly inside unless closed.

    The axis is cut into cells of the given width: a range is listed in each cell that it meets and a point in its own, so
    that the join is by equal cells and neither side is repeated as a whole. Cells that many points share are split by the
    adaptive join. Choose width near the ranges' width.
    """
    cells = F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor(F.col(high) / width).cast("bigint"))
    dealt = ranges.filter(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(cells))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)) if closed else (F.col(point) > F.col(low)) & (F.col(point) < F.col(high))
    own = points.withColumn("__own", F.floor(F.col(point) / width).cast("bigint"))
    return own.join(dealt, (F.col("__own") == F.col("__cell")) & inside, how).drop("__own", "__cell")


def interval_means(
    points: DataFrame, table: DataFrame, key: str, other: str, point: str, low: str, high: str, values: dict[str, str], *, gathered: int = 200, blocks: int | None = None,
) -> DataFrame:
    """Points with the means (column: new name) of the table's rows of equal key whose open interval holds them; null without one.

    A key of up to gathered intervals is joined with its points as it is. Larger ones are swept: an interval's values are
    added at its low end and taken off at its high one, and a point reads the running sums. So n points and intervals cost
    n log n, however many intervals hold a point, and a key of very many rows is spread over blocks. Sums are of whole
    multiples of 2**-53, so that they do not depend on an order and what is added and taken off again leaves nothing behind.
    Intervals without inside, and null ends and keys, hold nothing.
    """
    held = table.filter((F.col(low) < F.col(high)) & F.col(other).isNotNull()).select(F.col(other).alias("__other"), F.col(low).alias("__low"), F.col(high).alias("__high"), *values)
    asked = points.select(F.col(key).alias("__key"), F.col(point).alias("__at")).filter("__key is not null and __at is not null").distinct()
    large = crowded(held, ["__other"], gathered)
    few = held if large is None else held.join(large, F.col("__other") == F.col("__key___other"), "left_anti")
    met = asked.join(few, (F.col("__key") == F.col("__other")) & (F.col("__at") > F.col("__low")) & (F.col("__at") < F.col("__high")))
    means = _as_means(met.groupBy("__key", "__at").agg(*(F.sum(x).alias(f"__t{k}") for k, x in _fixed(values).items())), values)
    if large is not None:
        of = lambda t, k: t.join(large, F.col(k) == F.col("__key___other"), "left_semi")
        means = means.union(_swept(of(asked, "__key"), of(held, "__other"), values, blocks))
    return points.join(means, (F.col(key) == F.col("__key")) & (F.col(point) == F.col("__at")), "left").drop("__key", "__at")


def _fixed(values: dict[str, str]) -> dict[str, Column]:
    """Each value as two whole numbers, of 2**-20 and 2**-53, and whether it is known."""
    coarse = {c: F.rint(F.col(c) * 2.0**20) for c in values}
    out = {f"h{i}": x.cast("decimal(38,0)") for i, x in enumerate(coarse.values())}
    return out | {f"l{i}": F.rint((F.col(c) * 2.0**20 - x) * 2.0**33).cast("long") for i, (c, x) in enumerate(coarse.items())} | {f"n{i}": F.col(c).isNotNull().cast("long") for i, c in enumerate(values)}


def _as_means(sums: DataFrame, values: dict[str, str]) -> DataFrame:
    total = lambda i: F.col(f"__th{i}").cast("double") / 2.0**20 + F.col(f"__tl{i}") / 2.0**53
    return sums.select("__key", "__at", *(F.when(F.col(f"__tn{i}") > 0, total(i) / F.col(f"__tn{i}")).alias(n) for i, n in enumerate(values.values())))


def _swept(asked: DataFrame, held: DataFrame, values: dict[str, str], blocks: int | None) -> DataFrame:
    """__key, __at and the means of the intervals open there."""
    fixed = _fixed(values)
    at = lambda end, kind, sign: held.groupBy(F.col("__other").alias("__key"), F.col(end).alias("__at")).agg(*((F.sum(x) * sign).alias(f"__{k}") for k, x in fixed.items())).withColumn("__kind", F.lit(kind))
    events = at("__high", 0, -1).unionByName(asked.withColumn("__kind", F.lit(1)), allowMissingColumns=True).unionByName(at("__low", 2, 1))  # of one place: ends, points, starts
    order = ["__at", "__kind"]
    sums = running(in_blocks(events, ["__key"], order, blocks), ["__key"], order, sums={f"__t{k}": F.col(f"__{k}") for k in fixed}).filter("__kind = 1")
    return _as_means(sums, values)


def consecutive(df: DataFrame, keys: Sequence[str], position: str, *, start: str = "start", end: str = "end") -> DataFrame:
    """Segments from each position to the next of its group; the last of a group has none."""
    after = Window.partitionBy(*keys).orderBy(position)
    return df.withColumns({start: F.col(position), end: F.lead(position).over(after)}).filter(F.col(end).isNotNull())


def first_match(df: DataFrame, keys: Sequence[str], condition: Column, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Each row with columns (source: new name) of the first row of its group that meets the condition; null without one.

    One small row for each group is joined back, so that a large group is never gathered.
    """
    order_key = F.struct(*order)
    found = df.filter(condition).groupBy(*keys).agg(F.min_by(F.struct(*(F.col(a).alias(b) for a, b in columns.items())), order_key).alias("__first"))
    renamed = found.select(*(F.col(k).alias(f"__{k}") for k in keys), "__first")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(renamed, same, "left").select(*df.columns, *(F.col(f"__first.{b}").alias(b) for b in columns.values()))


def drop_known(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in known: work already done, bad files, earlier classes."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def place_in_order(df: DataFrame, coarse: str, order: Sequence[str], *, name: str = "place") -> DataFrame:
    """0-based place of each row in a total order, of which coarse (a column such as the day) is the leading part.

    Rows are numbered within their coarse value; only the counts of the coarse values are put in order as a whole.
    """
    counts = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)  # one row for each coarse value
    starts = counts.select(coarse, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(coarse).orderBy(*order)) - 1
    return df.withColumn("__rank", rank).join(starts, coarse).withColumn(name, F.col("__start") + F.col("__rank")).drop("__rank", "__start")


def time_key(days: Column, digits: int = 8) -> Column:
    """A date rounded to so many decimals of a day as a whole number, to join on."""
    return F.rint(days * 10**digits).cast("bigint")
