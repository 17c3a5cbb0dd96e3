"""Queries of what goes into a run and what is drawn of it: classes of files, windows of dates, lists of runs, points of templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.operators import intervals, robust
from lumenrv.plans.expressions import small
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import EXPOSURES, LINE_LIST, SPECTRA, exposures, line_list, spectra
from lumenrv.sources.scratch import materialize
from lumenrv.sources.tables import fits_search


def classified(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first class whose rule fits, as if each class took its files away from the next; null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def in_window(mid: Column, start: float | None, end: float | None) -> Column:
    """Whether a date lies in a window, ends included; an end that is None is open, a missing date is out unless both are."""
    out = F.lit(True)
    for bound, test in ((start, lambda b: mid >= b), (end, lambda b: mid <= b)):
        out = out if bound is None else out & F.coalesce(test(F.lit(bound)), F.lit(False))
    return out


def same_light(kind: Column) -> Column:
    """Whether both fibres of a type such as FP_FP see the same light."""
    parts = F.split(kind, "_")
    return F.coalesce(F.get(parts, F.lit(0)) == F.get(parts, F.lit(1)), F.lit(False))


def run_problems(runs: DataFrame, lists: dict[str, str], known: DataFrame, objects: str, kinds: Sequence[str]) -> DataFrame:
    """Runs with what is wrong with each: another number of objects than in lists (column: of its list), unknown objects, unknown kinds.

    runs has the column objects (array), the array columns of lists, and kind; known has object. A run without a problem has an empty array.
    """
    exploded = runs.select("run", F.explode(objects).alias("object")).distinct()
    missing = intervals.drop_known(exploded, known, ["object"]).groupBy("run").agg(F.array_sort(F.collect_list("object")).alias("__missing"))
    lengths = [F.when(F.size(c) != F.size(objects), F.lit(f"{name} has another length")) for c, name in lists.items()]
    met = runs.join(missing, "run", "left")
    unknown = F.transform(F.coalesce("__missing", F.array().cast("array<string>")), lambda o: F.concat(F.lit("unknown object "), o))
    return met.withColumn("problems", F.concat(F.array_compact(F.array(*lengths, F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))))), unknown)).drop("__missing")


#: Endings of file names by what they hold, and the header's word for it.
SUFFIXES = ("_pp_e2dsff_C.fits", "_pp_e2dsff_AB.fits", "o_pp_e2dsff_tcorr_AB.fits", "_s1dv_STAR_sc1d_v_file_AB.fits", "_full.fits", "_blaze_AB.fits", "_log.txt")
OUTPUTS = ("EXT_E2DS_FF", "EXT_E2DS_FF", "TELLU_OBJ", "", "", "FF_BLAZE", "")
FILES = f"""(SELECT o_orderkey AS file, o_orderkey || {list(SUFFIXES)!r}[1 + o_orderkey % 7] AS name, {list(OUTPUTS)!r}[1 + o_orderkey % 7] AS output,
  CASE o_orderstatus WHEN 'F' THEN 'FP_FP' WHEN 'O' THEN 'OBJ_FP' ELSE 'POLAR_DARK' END AS dprtype, CASE WHEN o_custkey % 2 = 0 THEN 'STAR' ELSE 'OTHER' END AS object, epoch_us(o_orderdate) / 86400e6 + 40587 AS mid FROM orders)"""


def files(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "F", "FP_FP").when(F.col("o_orderstatus") == "O", "OBJ_FP").otherwise("POLAR_DARK")
    mid = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6 + 40587
    return o.select(F.col("o_orderkey").alias("file"), F.concat(F.col("o_orderkey").cast("string"), pick(SUFFIXES)).alias("name"), pick(OUTPUTS).alias("output"), kind.alias("dprtype"), F.when(F.col("o_custkey") % 2 == 0, "STAR").otherwise("OTHER").alias("object"), mid.alias("mid"))


@query(f"""SELECT file, CASE WHEN ends_with(name, '_pp_e2dsff_C.fits') AND dprtype IN ('POLAR_FP', 'OBJ_FP') AND output = 'EXT_E2DS_FF' THEN 'simultaneous' WHEN contains(name, '_pp_e2dsff_AB.fits') AND dprtype = 'FP_FP' AND output = 'EXT_E2DS_FF' THEN 'calibration'
  WHEN ends_with(name, 'o_pp_e2dsff_tcorr_AB.fits') AND dprtype IN ('POLAR_FP', 'OBJ_FP', 'POLAR_DARK', 'OBJ_DARK') AND object = 'STAR' AND output = 'TELLU_OBJ' THEN 'science' WHEN ends_with(name, '_s1dv_STAR_sc1d_v_file_AB.fits') THEN 'template'
  WHEN ends_with(name, '_full.fits') THEN 'mask' WHEN (ends_with(name, '_blaze_AB.fits') OR ends_with(name, '_blaze_C.fits')) AND output = 'FF_BLAZE' THEN 'blaze' END AS class FROM {FILES}""")
def input_classes(spark, d):
    """What each file of a reduction is to a run: by its name and header, classes one after the other."""
    header = F.create_map(F.lit("DPRTYPE"), F.col("dprtype"), F.lit("OUTPUT"), F.col("output"), F.lit("OBJECT"), F.col("object"))
    fits = lambda keys=None, **name: fits_search(F.col("name"), header, keys=keys, **name)
    rules = [
        ("simultaneous", fits({"DPRTYPE": ["POLAR_FP", "OBJ_FP"], "OUTPUT": ["EXT_E2DS_FF"]}, suffix="_pp_e2dsff_C.fits")), ("calibration", fits({"DPRTYPE": ["FP_FP"], "OUTPUT": ["EXT_E2DS_FF"]}, contains=["_pp_e2dsff_AB.fits"])),
        ("science", fits({"DPRTYPE": ["POLAR_FP", "OBJ_FP", "POLAR_DARK", "OBJ_DARK"], "OBJECT": ["STAR"], "OUTPUT": ["TELLU_OBJ"]}, suffix="o_pp_e2dsff_tcorr_AB.fits")), ("template", fits(suffix="_s1dv_STAR_sc1d_v_file_AB.fits")), ("mask", fits(suffix="_full.fits")),
        ("blaze", fits({"OUTPUT": ["FF_BLAZE"]}, suffix="_blaze_AB.fits") | fits({"OUTPUT": ["FF_BLAZE"]}, suffix="_blaze_C.fits")),
    ]
    return files(spark, d).select("file", classified(rules).alias("class"))


@query(f"SELECT file, split_part(dprtype, '_', 1) = split_part(dprtype, '_', 2) AND mid >= 49000.5 AND mid <= 50500 AS kept, mid >= 49000.5 AS late FROM {FILES}")
def template_files(spark, d):
    """Which files a calibration's template takes: of equal light in both fibres, within a window of dates; and those of an open window."""
    return files(spark, d).select("file", (same_light(F.col("dprtype")) & in_window(F.col("mid"), 49000.5, 50500.0)).alias("kept"), in_window(F.col("mid"), 49000.5, None).alias("late"))


@query(f"""WITH o AS (SELECT CAST(unnest(range(0, 40)) AS BIGINT) AS ord), k AS (SELECT DISTINCT wave, weight - 0.05 AS weight FROM {LINE_LIST}),
m AS (SELECT ord, wave, weight FROM o JOIN k ON wave > 900 + ord * 26 AND wave < 928 + ord * 26)
SELECT ord, count(*) FILTER (weight < 0) AS science, count(*) AS full_list, round(sum(weight) FILTER (weight < 0), 4) AS weight FROM m GROUP BY ord""")
def mask_in_orders(spark, d):
    """Lines strictly inside of each order: a science exposure takes those of negative weight, others all."""
    orders = small(spark, {str(k): (900.0 + k * 26, 928.0 + k * 26) for k in range(40)}).select(F.col("band").cast("long").alias("ord"), "low", "high")
    lines = line_list(spark, d).select("wave", (F.col("weight") - 0.05).alias("weight")).distinct()
    met = intervals.range_join(lines, orders, "wave", "low", "high", width=26.0)
    science = F.col("weight") < 0
    return met.groupBy("ord").agg(F.count(F.when(science, 1)).alias("science"), F.count(F.lit(1)).alias("full_list"), F.round(F.sum(F.when(science, F.col("weight"))), 4).alias("weight"))


@query(f"""WITH t AS (SELECT ord, pixel, avg(flux - 1) * 20 + 1 AS flux, count(*) FILTER (exposure % (pixel % 5 + 2) <> 0) AS n FROM {SPECTRA} GROUP BY ALL),
m AS (SELECT ord, max(n) AS most FROM t GROUP BY ord), v AS (SELECT t.ord, pixel, CASE WHEN n * 2 >= most THEN flux END AS flux FROM t JOIN m USING (ord)), c AS (SELECT ord, median(flux) AS middle FROM v GROUP BY ord)
SELECT ord, pixel, round(CASE WHEN flux >= 0 AND flux / middle <= 1.2 THEN flux END, 9) AS flux FROM v JOIN c USING (ord)""")
def template_points(spark, d):
    """Points of a template that count: known in half of what the best one is, not negative, not far above the median."""
    t = spectra(spark, d).groupBy("ord", "pixel").agg((F.avg(F.col("flux") - 1) * 20 + 1).alias("flux"), F.count(F.when(F.col("exposure") % (F.col("pixel") % 5 + 2) != 0, 1)).alias("n"))
    return valid_points(t, ["ord"], "flux", "n", most=1.2).select("ord", "pixel", F.round("flux", 9).alias("flux"))


def valid_points(template: DataFrame, keys: list[str], flux: str, n: str, *, most: float = 10.0) -> DataFrame:
    """A template whose flux is null where n is below half its greatest, where it is negative, and above most medians of what is left."""
    best = template.groupBy(*keys).agg(F.max(n).alias("__most"))
    known = materialize(template.join(best, keys).withColumn(flux, F.when(F.col(n) * 2 >= F.col("__most"), F.col(flux))).drop("__most"))
    middle = robust.exact_median(known, keys, flux, name="__middle")
    met = known.join(middle, keys, "left")
    return met.withColumn(flux, F.when((F.col(flux) >= 0) & (F.col(flux) / F.col("__middle") <= most), F.col(flux))).drop("__middle")


@query(f"""WITH g AS (SELECT CAST(unnest(range(-40, 41)) AS BIGINT) AS i), l AS (SELECT l_linenumber AS exposure, dv - 25 AS dv, error * 0.5 AS e, count(*) AS n FROM {LINE_LIST} GROUP BY ALL),
p AS (SELECT exposure, i, sum(n * exp(-0.5 * pow((i - dv) / e, 2)) / e) AS y FROM g CROSS JOIN l GROUP BY ALL)
SELECT exposure, i, round(sum(y) OVER (PARTITION BY exposure ORDER BY i) / sum(y) OVER (PARTITION BY exposure), 6) AS share FROM p""")
def pdf_cumulative(spark, d):
    """Share of each exposure's line velocities up to each place of a grid."""
    from pyspark.sql import Window

    lines = line_list(spark, d).groupBy(F.col("l_linenumber").alias("exposure"), (F.col("dv") - 25).alias("dv"), (F.col("error") * 0.5).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    grid = lines.withColumn("i", F.explode(F.sequence(F.lit(-40), F.lit(40)))).withColumn("i", F.col("i").cast("long"))
    density = grid.groupBy("exposure", "i").agg(F.sum(F.exp(F.pow((F.col("i") - F.col("dv")) / F.col("e"), F.lit(2)) * -0.5) / F.col("e") * F.col("n")).alias("y"))
    every = Window.partitionBy("exposure")  # 81 places
    return density.select("exposure", "i", F.round(F.sum("y").over(every.orderBy("i")) / F.sum("y").over(every), 6).alias("share"))


@query(f"""WITH s AS (SELECT exposure, pixel, flux, 1 - 0.5 * exp(-0.5 * pow((pixel - 20) / 4.0, 2)) AS trans FROM {SPECTRA}), m AS (SELECT exposure, median(flux) AS middle FROM s GROUP BY exposure)
SELECT exposure, round(quantile_cont(CASE WHEN trans >= exp(-0.3) THEN flux / middle / trans END, 0.995), 6) AS scale FROM s JOIN m USING (exposure) WHERE pixel > 3 AND pixel < 60 GROUP BY exposure""")
def transmission_scale(spark, d):
    """Scale between spectra and the air's transmission: a high percentile of their ratio where the air is clear, within the domain."""
    trans = 1 - 0.5 * F.exp(F.pow((F.col("pixel") - 20) / 4.0, F.lit(2)) * -0.5)
    s = materialize(spectra(spark, d).select("exposure", "pixel", "flux", trans.alias("trans")))
    met = s.join(robust.exact_median(s, ["exposure"], "flux", name="middle"), "exposure")
    clear = met.filter("pixel > 3 and pixel < 60").select("exposure", F.when(F.col("trans") >= F.exp(F.lit(-0.3)), F.col("flux") / F.col("middle") / F.col("trans")).alias("ratio"))
    return robust.exact_percentiles(clear, ["exposure"], "ratio", [0.995]).select("exposure", F.round(F.get("p", F.lit(0)), 6).alias("scale"))


@query(f"""WITH r AS (SELECT object AS run, list_sort(list(DISTINCT 'obj' || exposure % 40)) AS objects, count(DISTINCT exposure % 40) + (object % 3 = 0)::INT AS n, CASE object % 4 WHEN 0 THEN 'SCIENCE' WHEN 1 THEN 'FP' WHEN 2 THEN 'LFC' ELSE 'SUN' END AS kind FROM {EXPOSURES} GROUP BY object),
u AS (SELECT run, list_sort(list(o)) AS missing FROM (SELECT run, unnest(objects) AS o FROM r) WHERE o NOT IN (SELECT 'obj' || r_regionkey * 7 FROM region) GROUP BY run)
SELECT run, CAST(len(objects) AS INTEGER) AS objects, (n <> len(objects))::INT + (kind = 'SUN')::INT + CAST(coalesce(len(missing), 0) AS INTEGER) AS problems, coalesce(missing[1], '') AS first FROM r LEFT JOIN u USING (run)""")
def run_list_problems(spark, d):
    """Lists of runs with what is wrong with them: lengths, kinds, unknown objects."""
    e = exposures(spark, d)
    objects = F.array_sort(F.collect_set(F.concat(F.lit("obj"), (F.col("exposure") % 40).cast("string"))))
    kind = F.when(F.col("run") % 4 == 0, "SCIENCE").when(F.col("run") % 4 == 1, "FP").when(F.col("run") % 4 == 2, "LFC").otherwise("SUN")
    runs = e.groupBy(F.col("object").alias("run")).agg(objects.alias("objects")).withColumn("kind", kind)
    templates = F.when(F.col("run") % 3 == 0, F.concat("objects", F.array(F.lit("extra")))).otherwise(F.col("objects"))
    known = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("obj"), (F.col("r_regionkey") * 7).cast("string")).alias("object"))
    found = run_problems(runs.withColumn("templates", templates), {"templates": "OBJECT_TEMPLATES"}, known, "objects", ("SCIENCE", "FP", "LFC"))
    first = F.coalesce(F.get(F.filter("problems", lambda p: p.startswith("unknown object")), F.lit(0)), F.lit("unknown object "))
    return found.select("run", F.size("objects").alias("objects"), F.size("problems").alias("problems"), F.substring(first, F.lit(16), F.length(first)).alias("first"))
