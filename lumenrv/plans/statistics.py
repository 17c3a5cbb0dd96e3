"""Queries of grouped statistics: robust means, biases, bands, nights, slopes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import functions as F

from lumenrv.functions import spectral
from lumenrv.operators import compiled, robust
from lumenrv.operators import spectra as spectra_ops
from lumenrv.plans.expressions import small
from lumenrv.plans.registry import query
from lumenrv.plans.surrogates import EXPOSURES, LINE_LIST, SPECTRA, exposures, line_list, measurements, measurements_sql, spectra
from lumenrv.sources.scratch import materialize

P = robust.normal_fraction()
LOW, HIGH = (1 - (1 + P) / 2), (1 + P) / 2


def robust_sql(points: str, keys: Sequence[str], name: str, rounds: int = 10) -> str:
    """Common table expressions that end in name(keys, mean, mean_err), for finite points (keys, v, e)."""
    k = ", ".join(keys)
    same = " AND ".join(f"p.{x} IS NOT DISTINCT FROM s.{x}" for x in keys) or "true"
    group = ", ".join(f"s.{x}" for x in keys)
    out = [f"{name}_p AS ({points})", f"{name}_0 AS (SELECT {k}, median(v) AS g, CAST('inf' AS DOUBLE) AS last, 1e0 AS bulk FROM {name}_p GROUP BY {k})"]
    weight = "(1 - 2e-4 / ((1 - 2e-4) * exp(-0.5 * pow(v - s.g, 2) / pow(e, 2)) + 2e-4)) / pow(e, 2)"
    for i in range(rounds):
        out.append(
            f"{name}_{i + 1} AS (SELECT {group}, CASE WHEN abs(s.g - s.last) / s.bulk > 1e-2 THEN sum(v * {weight}) / sum({weight}) ELSE s.g END AS g, "
            f"CASE WHEN abs(s.g - s.last) / s.bulk > 1e-2 THEN s.g ELSE s.last END AS last, CASE WHEN abs(s.g - s.last) / s.bulk > 1e-2 THEN sqrt(1 / sum({weight})) ELSE s.bulk END AS bulk "
            f"FROM {name}_p p JOIN {name}_{i} s ON {same} GROUP BY {group}, s.g, s.last, s.bulk)"
        )
    out.append(f"{name} AS (SELECT {k}, g AS mean, bulk AS mean_err FROM {name}_{rounds})")
    return ",\n".join(out)


def _points(keys: str, error: float = 20.0) -> str:
    return f"SELECT {keys}, dv AS v, sdv AS e FROM {measurements_sql(error)} WHERE dv IS NOT NULL"


def rounded(df, keys, digits: int = 5):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in df.columns if c not in keys))


@query(f"WITH {robust_sql(_points('line'), ['line'], 'r')} SELECT line, round(mean, 5) AS mean, round(mean_err, 5) AS mean_err FROM r")
def robust_mean_by_group(spark, d):
    return rounded(robust.odd_ratio_mean(measurements(spark, d), ["line"], "dv", "sdv"), ["line"])


@query(f"WITH {robust_sql(_points('epoch'), ['epoch'], 'r')} SELECT epoch, round(mean, 5) AS mean, round(mean_err, 5) AS mean_err FROM r")
def robust_mean_by_epoch(spark, d):
    return rounded(robust.odd_ratio_mean(measurements(spark, d), ["epoch"], "dv", "sdv"), ["epoch"])


@query(f"WITH {robust_sql(_points('epoch', 1.0), ['epoch'], 'r')} SELECT epoch, round(mean, 4) AS mean, round(mean_err, 4) AS mean_err FROM r")
def robust_mean_at_the_cap(spark, d):
    """Errors far below the spread: every group runs all its rounds."""
    return rounded(robust.odd_ratio_mean(measurements(spark, d, 1.0), ["epoch"], "dv", "sdv"), ["epoch"], 4)


@query(f"SELECT band, round((quantile_cont(dv, {HIGH!r}) - quantile_cont(dv, {LOW!r})) / 2, 6) AS sigma FROM {measurements_sql()} GROUP BY band")
def robust_sigma(spark, d):
    found = robust.exact_percentiles(measurements(spark, d), ["band"], "dv", (LOW, HIGH))
    return found.select("band", F.round((F.get("p", F.lit(1)) - F.get("p", F.lit(0))) / 2, 6).alias("sigma"))


@query(f"""SELECT epoch, count(dv) AS n_valid, round(coalesce(sum(dv), 0), 4) AS total, round(avg(dv), 6) AS mean, round(median(dv), 6) AS median, round(stddev_pop(dv), 6) AS std,
  min(dv) AS least, max(dv) AS most FROM {measurements_sql()} GROUP BY epoch""")
def nan_safe_stats(spark, d):
    stats = robust.nan_stats(F.col("dv"))
    exact = {"n_valid": None, "least": None, "most": None, "total": 4}
    cut = lambda k, v: v if k in exact and exact[k] is None else F.round(v, exact.get(k, 6))
    m = measurements(spark, d)
    middle = robust.exact_median(m, ["epoch"], "dv").select("epoch", F.round("median", 6).alias("median"))
    return m.groupBy("epoch").agg(*(cut(k, v).alias(k) for k, v in stats.items() if k != "median")).join(middle, "epoch", "left")


@query(f"""SELECT band, {', '.join(f"round(quantile_cont(dv, {p}), 6) AS p{str(p)[2:]}" for p in (0.05, 0.16, 0.5, 0.84, 0.95, 0.995))} FROM {measurements_sql()} GROUP BY band""")
def percentile_band(spark, d):
    shares = (0.05, 0.16, 0.5, 0.84, 0.95, 0.995)
    found = robust.exact_percentiles(measurements(spark, d), ["band"], "dv", shares)
    return found.select("band", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{str(p)[2:]}") for i, p in enumerate(shares)))


@query(f"""SELECT epoch, round(sum(dv / pow(sdv, 2)) / sum(1 / pow(sdv, 2)), 6) AS mean, round(sqrt(1 / sum(1 / pow(sdv, 2))), 6) AS mean_err FROM {measurements_sql()} GROUP BY epoch""")
def ivar_mean_epoch(spark, d):
    mean, err = robust.inverse_variance(F.col("dv"), F.col("sdv"))
    return measurements(spark, d).groupBy("epoch").agg(F.round(mean, 6).alias("mean"), F.round(err, 6).alias("mean_err"))


@query(f"""SELECT epoch, round(sum(dv / pow(sdv, 2)) / sum(1 / pow(sdv, 2)), 6) AS dv, round(sqrt(1 / sum(1 / pow(sdv, 2))), 6) AS sdv, arg_min(band, event_id) AS band,
  round(avg(line), 6) AS line, round(CASE WHEN count(dv) = count(*) THEN avg(dv) END, 6) AS plain FROM {measurements_sql()} GROUP BY epoch""")
def epoch_rollup_mixed(spark, d):
    """Nightly table: pairs of value and error by weighted mean, strings by their first, other numbers by a mean that missing values spoil."""
    m = measurements(spark, d).select("epoch", "event_id", "dv", "sdv", "band", "line", F.col("dv").alias("plain"))
    out = compiled.nightly_table(m, "epoch", "event_id")
    return out.select("epoch", F.round("dv", 6).alias("dv"), F.round("sdv", 6).alias("sdv"), "band", F.round("line", 6).alias("line"), F.round("plain", 6).alias("plain"))


@query(f"SELECT line, round(avg(CASE WHEN dv IS NOT NULL THEN 1 ELSE 0 END), 6) AS frac FROM {measurements_sql()} GROUP BY line HAVING avg(CASE WHEN dv IS NOT NULL THEN 1 ELSE 0 END) >= 0.9")
def frac_valid_lines(spark, d):
    share = F.avg(spectral.finite(F.col("dv")).isNotNull().cast("int"))
    return measurements(spark, d).groupBy("line").agg(share.alias("frac")).filter("frac >= 0.9").select("line", F.round("frac", 6).alias("frac"))


def biased(spark, d):
    return compiled.line_biases(measurements(spark, d), "epoch", "line", "dv", "sdv")


def bias_sql(source: str, keys: tuple[str, str] = ("epoch", "line"), few: bool = False) -> str:
    """Common table expressions that end in z (the zero point) and bias(line, bias, bias_err), for a source of (epoch, line, dv, sdv)."""
    x, k = keys
    seldom = f" UNION ALL SELECT {k}, avg(dv), stddev_pop(dv) / sqrt(count(dv)) FROM {source} WHERE {k} IN (SELECT {k} FROM share WHERE frac >= 0.1 AND known < 3) GROUP BY {k}" if few else ""
    return f"""{robust_sql(f"SELECT {x}, dv AS v, sdv AS e FROM {source} WHERE dv IS NOT NULL", [x], 'n')},
share AS (SELECT {k}, avg(CASE WHEN dv IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac, count(dv) AS known FROM {source} GROUP BY {k}),
diff AS (SELECT m.{k}, m.{x}, m.dv, m.sdv, m.dv - n.mean AS diff FROM {source} m JOIN n ON m.{x} = n.{x} JOIN share s ON s.{k} = m.{k} WHERE frac >= 0.1 AND known >= 3),
middle AS (SELECT {k}, median(diff) AS middle FROM diff GROUP BY {k}),
{robust_sql(f"SELECT diff.{k}, diff - middle AS v, sdv AS e FROM diff JOIN middle ON diff.{k} = middle.{k} WHERE diff IS NOT NULL", [k], "often")},
b AS (SELECT {k}, mean, mean_err FROM often{seldom}),
{robust_sql("SELECT 0 AS one, mean AS v, mean_err AS e FROM b WHERE mean IS NOT NULL AND mean_err > 0", ["one"], "z")},
spread AS (SELECT (quantile_cont(b.mean - z.mean, {HIGH!r}) - quantile_cont(b.mean - z.mean, {LOW!r})) / 2 AS s FROM b, z),
bias AS (SELECT share.{k}, CASE WHEN abs((b.mean - z.mean) / s) <= 100 THEN b.mean - z.mean END AS bias, b.mean_err AS bias_err FROM share LEFT JOIN b ON b.{k} = share.{k}, z, spread)"""


BIAS = bias_sql(measurements_sql())


@query(f"WITH {BIAS} SELECT line, round(bias, 4) AS bias, round(bias_err, 4) AS bias_err FROM bias")
def line_bias(spark, d):
    """Bias of each line over all nights, with the zero point taken off; lines measured too seldom or far off have none."""
    return rounded(biased(spark, d).drop("scale"), ["line"], 4)


@query(f"WITH {BIAS} SELECT round(mean, 4) AS mean, round(mean_err, 4) AS mean_err FROM z")
def bias_zero_point(spark, d):
    """The robust mean of all biases before it is taken off."""
    raw = compiled.line_biases(measurements(spark, d), "epoch", "line", "dv", "sdv", centred=False).withColumn("one", F.lit(0))
    return rounded(robust.odd_ratio_mean(raw, ["one"], "bias", "bias_err").drop("one"), [], 4)


@query(f"""WITH {BIAS}, {robust_sql("SELECT m.epoch, m.dv - bias AS v, m.sdv AS e FROM " + measurements_sql() + " m JOIN bias ON m.line = bias.line WHERE m.dv IS NOT NULL AND bias IS NOT NULL", ["epoch"], "x")}
SELECT epoch, round(mean, 4) AS mean, round(mean_err, 4) AS mean_err FROM x""")
def exposure_velocity(spark, d):
    """Velocities once more, with every line's bias taken off."""
    m = measurements(spark, d)
    clean = m.join(biased(spark, d), "line").withColumn("clean", F.col("dv") - F.col("bias"))
    return rounded(robust.odd_ratio_mean(clean, ["epoch"], "clean", "sdv"), ["epoch"], 4)


NIGHT_MEANS = robust_sql(_points("epoch"), ["epoch"], "n")


@query(f"""WITH {NIGHT_MEANS},
share AS (SELECT line, avg(CASE WHEN dv IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac, count(dv) AS known FROM {measurements_sql()} GROUP BY line),
s AS (SELECT m.line, (quantile_cont((dv - mean) / sdv, 0.84) - quantile_cont((dv - mean) / sdv, 0.16)) / 2 AS s FROM {measurements_sql()} m JOIN n ON m.epoch = n.epoch JOIN share USING (line) WHERE frac >= 0.1 AND known >= 3 GROUP BY m.line)
SELECT event_id, round(sdv * coalesce(s, 1), 6) AS sdv FROM {measurements_sql()} m LEFT JOIN s ON m.line = s.line""")
def force_sigma_per_line(spark, d):
    """Errors scaled so that each line's differences from its nights' means have unit spread over their errors."""
    m = measurements(spark, d)
    scale = compiled.line_biases(m, "epoch", "line", "dv", "sdv", force_sigma=True, centred=False).select("line", "scale")
    return m.join(scale, "line").select("event_id", F.round(F.col("sdv") * F.col("scale"), 6).alias("sdv"))


#: Three exposures (by flag) of many lines (orders), most of which are measured in one or two of them.
FEW = "(SELECT l_returnflag AS exposure, l_orderkey AS line, avg(l_quantity) AS dv, 1 + avg(l_tax) * 10 AS sdv FROM lineitem GROUP BY ALL)"


@query(f"""WITH facts AS {FEW}, {bias_sql("facts", ("exposure", "line"), few=True)} SELECT line, round(bias, 4) AS bias, round(bias_err, 4) AS bias_err FROM bias""")
def line_bias_of_few_exposures(spark, d):
    """Biases from fewer than five exposures: lines measured once or twice have their plain mean."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    few = materialize(li.groupBy(F.col("l_returnflag").alias("exposure"), F.col("l_orderkey").alias("line")).agg(F.avg("l_quantity").alias("dv"), (F.avg("l_tax") * 10 + 1).alias("sdv")))
    return rounded(compiled.line_biases(few, "exposure", "line", "dv", "sdv", few_exposures=True).drop("scale"), ["line"], 4)


BINS = ", ".join(f"('{k}', {a!r}e0, {b!r}e0)" for k, a, b in spectral.uniform_bins(900.0, 1950.0, 25))
REGIONS = {"": (float("-inf"), float("inf")), "_low": (0.0, 50.0), "_high": (50.0, 100.0)}
#: Lines of seven exposures with a pixel; most lines below 950 nm and some others lack a velocity.
FACTS = f"(SELECT l_linenumber AS exposure, wave, CAST(l_partkey % 100 AS DOUBLE) AS pixel, CASE WHEN (wave < 950 AND l_partkey % 20 <> 3) OR l_partkey % 11 = 0 THEN NULL ELSE dv END AS dv, error FROM {LINE_LIST.replace('SELECT l_orderkey', 'SELECT l_partkey, l_orderkey')})"


def facts(spark, d):
    rows = line_list(spark, d, "l_partkey")
    lost = ((F.col("wave") < 950) & (F.col("l_partkey") % 20 != 3)) | (F.col("l_partkey") % 11 == 0)
    return rows.select(F.col("l_linenumber").alias("exposure"), "wave", (F.col("l_partkey") % 100).cast("double").alias("pixel"), F.when(~lost, F.col("dv")).alias("dv"), "error")


@query(f"""WITH b(band, low, high) AS (VALUES {BINS}), r(region, first, last) AS (VALUES ('', -1e9, 1e9), ('_low', 0e0, 50e0), ('_high', 50e0, 100e0)),
held AS (SELECT l.exposure, b.band, r.region, l.dv AS v, l.error AS e FROM {FACTS} l JOIN b ON l.wave > b.low AND l.wave < b.high JOIN r ON l.pixel > r.first AND l.pixel < r.last),
{robust_sql("SELECT exposure, band, region, v, e FROM held WHERE v IS NOT NULL", ["exposure", "band", "region"], "o")},
c AS (SELECT exposure, band, region, count(v) AS n, count(*) AS lines FROM held GROUP BY ALL), x AS (SELECT DISTINCT exposure FROM {FACTS})
SELECT x.exposure, b.band || r.region AS band, CASE WHEN c.n >= c.lines / 10.0 AND c.lines >= 5 THEN round(mean, 5) ELSE 0 END AS vrad,
  CASE WHEN c.n >= c.lines / 10.0 AND c.lines >= 5 THEN round(mean_err, 6) ELSE 0 END AS svrad
FROM x CROSS JOIN b CROSS JOIN r LEFT JOIN o ON o.exposure = x.exposure AND o.band = b.band AND o.region = r.region LEFT JOIN c ON c.exposure = x.exposure AND c.band = b.band AND c.region = r.region""")
def band_region_velocity(spark, d):
    """Velocity of each exposure in each wavelength bin and region of the detector; 0 where too few lines are measured."""
    bins = small(spark, {k: (a, b) for k, a, b in spectral.uniform_bins(900.0, 1950.0, 25)})
    found = compiled.band_velocities(facts(spark, d), "exposure", bins, REGIONS, "wave", "pixel", "dv", "error", width=30.0)
    return found.select("exposure", "band", F.round("vrad", 5).alias("vrad"), F.round("svrad", 6).alias("svrad"))


PIVOT = ("click", "purchase", "signup", "view", "logout")


@query(f"""SELECT epoch, {', '.join(f"round(sum(dv / pow(sdv, 2)) FILTER (band = '{b}') / sum(1 / pow(sdv, 2)) FILTER (band = '{b}'), 6) AS vrad_{b}" for b in PIVOT)} FROM {measurements_sql()} GROUP BY epoch""")
def band_pivot(spark, d):
    """One row for each night, one column for each band."""
    mean, _ = robust.inverse_variance(F.col("dv"), F.col("sdv"))
    wide = measurements(spark, d).groupBy("epoch").pivot("band", list(PIVOT)).agg(F.round(mean, 6))
    return wide.select("epoch", *(F.col(b).alias(f"vrad_{b}") for b in PIVOT))


@query(f"""WITH p AS (SELECT l_linenumber AS exposure, wave - 1600 AS x, dv AS y, 1 / error AS w FROM {LINE_LIST}),
s AS (SELECT exposure, count(*) AS n, sum(w*w) AS s, sum(w*w*x) AS sx, sum(w*w*y) AS sy, sum(w*w*x*x) AS sxx, sum(w*w*x*y) AS sxy, sum(w*w*y*y) AS syy FROM p GROUP BY exposure),
f AS (SELECT *, (s*sxy - sx*sy) / (s*sxx - sx*sx) AS slope, (sxx*sy - sx*sxy) / (s*sxx - sx*sx) AS level FROM s)
SELECT exposure, round(slope * 1000, 6) AS slope, round(level, 6) AS level, round(1000 * sqrt((syy - slope*sxy - level*sy) / (n - 2) * s / (s*sxx - sx*sx)), 6) AS slope_err,
  round(sqrt((syy - slope*sxy - level*sy) / (n - 2) * sxx / (s*sxx - sx*sx)), 6) AS level_err FROM f""")
def chromatic_slope_one_pass(spark, d):
    """Velocity against wavelength: weighted straight line by sums, with errors."""
    lines = line_list(spark, d).withColumn("x", F.col("wave") - 1600)
    sums = lines.groupBy(F.col("l_linenumber").alias("exposure")).agg(*(v.alias(k) for k, v in robust.line_fit(F.col("x"), F.col("dv"), F.lit(1.0) / F.col("error")).items()))
    fit = sums.select("exposure", *(v.alias(k) for k, v in robust.line_from_sums().items()))
    return fit.select("exposure", *(F.round(F.col(k) * (1000 if "slope" in k else 1), 6).alias(k) for k in ("slope", "level", "slope_err", "level_err")))


@query(f"SELECT line, round(corr(dv, epoch), 6) AS r FROM {measurements_sql()} WHERE dv IS NOT NULL GROUP BY line HAVING count(*) > 2")
def pearson_berv(spark, d):
    known = measurements(spark, d).withColumn("dv", spectral.finite(F.col("dv"))).filter("dv is not null")
    return known.groupBy("line").agg(F.corr("dv", F.col("epoch").cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 2").select("line", F.round("r", 6).alias("r"))


@query(f"""WITH p AS (SELECT exposure, ord, flux - 1 AS diff, 1 + pixel / 64.0 AS vec, CASE WHEN exposure % 9 = 0 AND pixel = 5 THEN NULL ELSE 0.5 + pixel / 128.0 END AS rms FROM {SPECTRA})
SELECT exposure, round(CASE WHEN count(rms) = count(*) THEN sum(diff * vec) / sum(vec * vec) END, 9) AS value, round(CASE WHEN count(rms) = count(*) THEN sqrt(1 / sum(pow(vec / rms, 2))) END, 9) AS error FROM p GROUP BY exposure""")
def bouchy_line(spark, d):
    """Projection of a difference on a template's derivative, with its error."""
    vec, rms = F.col("pixel") / 64.0 + 1, F.when((F.col("exposure") % 9 == 0) & (F.col("pixel") == 5), F.lit(float("nan"))).otherwise(F.col("pixel") / 128.0 + 0.5)
    value, error = robust.derivative_projection(F.col("vec"), F.col("diff"), F.col("rms"))
    rows = spectra(spark, d).select("exposure", (F.col("flux") - 1).alias("diff"), vec.alias("vec"), rms.alias("rms"))
    return rows.groupBy("exposure").agg(F.round(value, 9).alias("value"), F.round(error, 9).alias("error"))


@query(f"SELECT exposure, round(sum(pow((flux - 1) / 0.15, 2)), 6) AS chi2, count(*) AS n FROM {SPECTRA} GROUP BY exposure")
def chi2_line(spark, d):
    return spectra(spark, d).groupBy("exposure").agg(F.round(F.sum(F.pow((F.col("flux") - 1) / 0.15, F.lit(2))), 6).alias("chi2"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS (SELECT CAST(unnest(range(-40, 41)) AS BIGINT) AS i), l AS (SELECT dv - 25 AS dv, error * 0.5 AS e FROM {LINE_LIST})
SELECT i, round(sum(exp(-0.5 * pow((i - dv) / e, 2)) / e), 3) AS density FROM g CROSS JOIN (SELECT dv, e, count(*) AS n FROM l GROUP BY ALL) l, range(l.n) GROUP BY i""")
def pdf_grid(spark, d):
    """Sum of the lines' Gaussians on a grid of velocities; equal lines are counted first, the grid is small and fixed."""
    lines = line_list(spark, d).groupBy((F.col("dv") - 25).alias("dv"), (F.col("error") * 0.5).alias("e")).agg(F.count(F.lit(1)).alias("n"))
    grid = lines.withColumn("i", F.explode(F.sequence(F.lit(-40), F.lit(40)))).withColumn("i", F.col("i").cast("long"))
    return grid.groupBy("i").agg(F.round(F.sum(F.exp(F.pow((F.col("i") - F.col("dv")) / F.col("e"), F.lit(2)) * -0.5) / F.col("e") * F.col("n")), 3).alias("density"))


@query(f"""WITH e AS (SELECT object, kind, avg(snr) AS v, stddev_pop(snr) / sqrt(count(*)) AS s FROM {EXPOSURES} GROUP BY ALL),
p AS (SELECT object, max(v) FILTER (kind = 'F') AS a, max(s) FILTER (kind = 'F') AS sa, max(v) FILTER (kind = 'O') AS b, max(s) FILTER (kind = 'O') AS sb FROM e GROUP BY object)
SELECT object, round(a - b - (SELECT median(a - b) FROM p), 9) AS colour, round(sqrt(sa * sa + sb * sb), 6) AS colour_err FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def colour_curve(spark, d):
    """Difference of two bands with its error, less the median difference."""
    stats = exposures(spark, d).groupBy("object").pivot("kind", ["F", "O"]).agg(F.avg("snr").alias("v"), (F.stddev_pop("snr") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    both = stats.filter("F_v is not null and O_v is not null").select("object", (F.col("F_v") - F.col("O_v")).alias("c"), F.sqrt(F.col("F_s") * F.col("F_s") + F.col("O_s") * F.col("O_s")).alias("e"))
    both = materialize(both.withColumn("one", F.lit(0)))
    middle = robust.exact_median(both, ["one"], "c", name="m")  # one row
    return both.join(F.broadcast(middle), "one").select("object", F.round(F.col("c") - F.col("m"), 9).alias("colour"), F.round("e", 6).alias("colour_err"))


def chromatic_sql(points: str, keys: Sequence[str], reference: float, name: str = "c", rounds: int = 10) -> str:
    """Common table expressions that end in name(keys, level, ... crx_err), for points (keys, w, y, e, o); errors are never 0."""
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    own = ", ".join(f"p.{x}" for x in keys)
    sums = lambda x, w: f"sum({w}) AS s, sum({w} * {x}) AS sx, sum({w} * y) AS sy, sum({w} * {x} * {x}) AS sxx, sum({w} * {x} * y) AS sxy, sum({w} * y * y) AS syy"
    out = [f"{name}_r AS ({points})", f"{name}_m AS (SELECT {k}, median(y) AS ym, median(e) AS em FROM {name}_r GROUP BY {k})",
           f"{name}_p AS (SELECT {', '.join(f'r.{x}' for x in keys)}, w - {reference} AS x, ln(w / {reference}) AS l, y - o AS y, e FROM {name}_r r JOIN {name}_m m ON {same('r', 'm')} WHERE abs(y - ym) < 10 * e AND e < 100 * em AND o IS NOT NULL)"]
    for i in range(rounds):
        if i == 0:
            w, source, last, go = "1 / (e * e)", f"{name}_p p", "CAST('inf' AS DOUBLE)", "true"
        else:
            g = "exp(-0.5 * pow((y - f.level - f.slope * x) / e, 2))"
            w, source, last, go = f"pow((1 + 1e-4) * {g} / (1e-4 + {g}) / e, 2)", f"{name}_p p JOIN {name}_{i - 1} f ON {same('p', 'f')}", "f.level", "f.moving"
        out.append(f"{name}_s{i} AS (SELECT {own}, {last} AS last, count(*) AS n, {sums('x', w)}, {sums('l', w).replace(' AS s', ' AS ls')} FROM {source} WHERE {go} GROUP BY {own}{'' if i == 0 else ', f.level'})")
        out.append(f"""{name}_f{i} AS (SELECT *, s*sxx - sx*sx AS det, ls*lsxx - lsx*lsx AS ldet FROM {name}_s{i}),
{name}_g{i} AS (SELECT *, (s*sxy - sx*sy) / det AS slope, (sxx*sy - sx*sxy) / det AS level, (ls*lsxy - lsx*lsy) / ldet AS crx, (lsxx*lsy - lsx*lsxy) / ldet AS llevel FROM {name}_f{i}),
{name}_h{i} AS (SELECT *, greatest(syy - slope*sxy - level*sy, 0) / (n - 2) AS scale, greatest(lsyy - crx*lsxy - llevel*lsy, 0) / (n - 2) AS lscale FROM {name}_g{i}),
{name}_{i} AS (SELECT {k}, n, level, sqrt(scale * sxx / det) AS level_err, slope, sqrt(scale * s / det) AS slope_err, crx, sqrt(lscale * ls / ldet) AS crx_err, n >= 3 AND abs(level - last) >= 0.1 * sqrt(scale * sxx / det) AS moving FROM {name}_h{i})""")
    settled = " UNION ALL ".join(f"SELECT * FROM {name}_{i}" + ("" if i == rounds - 1 else " WHERE NOT moving") for i in range(rounds))
    out.append(f"{name} AS (SELECT {', '.join(f'm.{x}' for x in keys)}, level, level_err, slope * 1000 AS slope, slope_err * 1000 AS slope_err, crx, crx_err FROM {name}_m m LEFT JOIN (SELECT * FROM ({settled}) WHERE n >= 3) d ON {same('m', 'd')})")
    return ",\n".join(out)


SLOPES = f"SELECT l_orderkey % 500 AS exposure, wave AS w, dv AS y, error * 4 AS e, 0e0 AS o FROM {LINE_LIST}"


@query(f"WITH {chromatic_sql(SLOPES, ['exposure'], 1600.0)} SELECT exposure, {', '.join(f'round({c}, 4) AS {c}' for c in ('level', 'level_err', 'slope', 'slope_err', 'crx', 'crx_err'))} FROM c")
def chromatic_slope(spark, d):
    """Velocity against wavelength, by a straight line that outliers lose their weight in."""
    lines = line_list(spark, d).select((F.col("l_orderkey") % 500).alias("exposure"), "wave", "dv", (F.col("error") * 4).alias("error"))
    return rounded(spectra_ops.chromatic_slope(lines, ["exposure"], "wave", "dv", "error", reference=1600.0), ["exposure"], 4)


TABLE_BANDS = {"blue": (900.0, 1250.0), "red": (1250.0, 1950.0)}
TABLE_REGIONS = {"": (float("-inf"), float("inf")), "_0_50": (0.0, 50.0)}
TABLE_FACTS = f"""(SELECT epoch AS exposure, line, 900 + CAST(line * 7 % 1050 AS DOUBLE) AS wave_start, line % 60 AS n_pixels, CAST(event_id % 100 AS DOUBLE) AS pixel, dv, sdv,
  CASE WHEN event_id % 13 <> 0 THEN dv * dv / 100 END AS d2v, sdv * 3 AS sd2v, CASE WHEN event_id % 13 <> 0 THEN dv / 300 END AS contrast, sdv / 300 AS sig_contrast,
  CASE WHEN event_id % 13 <> 0 THEN dv * (event_id % 7 - 3) END AS d3v, sdv * 4 AS sd3v, CASE WHEN event_id % 3 <> 0 THEN dv / (1 + event_id % 4) END AS warmth, sdv / 2 AS swarmth FROM {measurements_sql(30.0)})"""


def table_facts(spark, d):
    m, known = measurements(spark, d, 30.0), F.col("event_id") % 13 != 0
    v = spectral.finite(F.col("dv"))
    return m.select(
        F.col("epoch").alias("exposure"), "line", (F.col("line") * 7 % 1050 + 900.0).alias("wave_start"), (F.col("line") % 60).alias("n_pixels"), (F.col("event_id") % 100).cast("double").alias("pixel"), v.alias("dv"), "sdv",
        F.when(known, v * v / 100).alias("d2v"), (F.col("sdv") * 3).alias("sd2v"), F.when(known, v / 300).alias("contrast"), (F.col("sdv") / 300).alias("sig_contrast"),
        F.when(known, v * (F.col("event_id") % 7 - 3)).alias("d3v"), (F.col("sdv") * 4).alias("sd3v"), F.when(F.col("event_id") % 3 != 0, v / (F.col("event_id") % 4 + 1)).alias("warmth"), (F.col("sdv") / 2).alias("swarmth"),
    )


def _table_sql(calibration: bool = False) -> str:
    bias = "bias AS (SELECT DISTINCT line, 0e0 AS bias, NULL AS bias_err FROM facts)" if calibration else bias_sql("facts", ("exposure", "line"))
    of = lambda v, e, name: robust_sql(f"SELECT exposure, {v} AS v, {e} AS e FROM clean WHERE {v} IS NOT NULL", ["exposure"], name)
    cells = ", ".join(f"('{b}{r}', {lo!r}e0, {hi!r}e0, {max(a, -1e9)!r}, {min(z, 1e9)!r})" for b, (lo, hi) in TABLE_BANDS.items() for r, (a, z) in TABLE_REGIONS.items())
    names = [b + r for b in TABLE_BANDS for r in TABLE_REGIONS]
    enough = "k.n * 10 >= k.lines AND k.lines >= 5"
    wide = ", ".join(f"round(coalesce(max(CASE WHEN band = '{n}' AND {enough} THEN {src} END), 0), 3) AS {col}_{n}" for n in names for col, src in (("vrad", "o.mean"), ("svrad", "o.mean_err")))
    width, full = 8 * math.log(2), spectral.FWHM
    return f"""WITH every AS {TABLE_FACTS}, keep AS (SELECT DISTINCT line FROM every WHERE exposure = (SELECT min(exposure) FROM every) AND wave_start > 900 AND wave_start < 1900 AND n_pixels < 50),
facts AS (SELECT * FROM every WHERE line IN (SELECT line FROM keep)), {bias},
clean AS (SELECT facts.*, bias, dv - bias AS rv FROM facts JOIN bias ON bias.line = facts.line),
{of("rv", "sdv", "vr")}, {of("d2v", "sd2v", "d2")}, {of("contrast", "sig_contrast", "co")}, {of("d3v", "sd3v", "d3")}, {of("warmth", "swarmth", "wa")},
{chromatic_sql("SELECT exposure, wave_start AS w, dv AS y, sdv AS e, bias AS o FROM clean WHERE dv IS NOT NULL", ["exposure"], 1600.0, "ch")},
cells(band, low, high, first, final) AS (VALUES {cells}), held AS (SELECT exposure, band, rv AS v, sdv AS e FROM clean JOIN cells ON wave_start > low AND wave_start < high AND pixel > first AND pixel < final),
{robust_sql("SELECT exposure, band, v, e FROM held WHERE v IS NOT NULL", ["exposure", "band"], "o")}, k AS (SELECT exposure, band, count(v) AS n, count(*) AS lines FROM held GROUP BY ALL),
bands AS (SELECT k.exposure, {wide} FROM k LEFT JOIN o USING (exposure, band) GROUP BY k.exposure)
SELECT x.exposure, round(vr.mean, 3) AS vrad, round(vr.mean_err, 3) AS svrad, round(co.mean, 6) AS contrast, round(d2.mean, 3) AS d2v, round(d2.mean_err, 3) AS sd2v, round(d3.mean, 3) AS d3v, round(d3.mean_err, 3) AS sd3v, round(wa.mean, 4) AS warmth, round(wa.mean_err, 4) AS swarmth, round(d2.mean * {width!r}e0, 2) AS "dW",
  round(2.5e3 * {full!r}e0 + d2.mean * {width!r}e0 / (2.5e3 * {full!r}e0), 3) AS fwhm, round(level, 3) AS vrad_achromatic, round(level_err, 3) AS svrad_achromatic, round(slope, 2) AS vrad_chromatic_slope, bands.* EXCLUDE (exposure)
FROM (SELECT DISTINCT exposure FROM every) x LEFT JOIN vr USING (exposure) LEFT JOIN d2 USING (exposure) LEFT JOIN co USING (exposure) LEFT JOIN d3 USING (exposure) LEFT JOIN wa USING (exposure) LEFT JOIN ch USING (exposure) LEFT JOIN bands USING (exposure)"""


def _table(spark, d, calibration):
    facts = materialize(table_facts(spark, d))
    exposures_ = facts.select("exposure").distinct().withColumn("ew", F.lit(2500.0))
    table = compiled.velocity_table(
        facts, exposures_, small(spark, TABLE_BANDS), first="exposure", window=(900.0, 1900.0), most_pixels=50, reference=1600.0, regions=TABLE_REGIONS, width=300.0,
        projections=("warmth",), pivot=[b + r for b in TABLE_BANDS for r in TABLE_REGIONS], calibration=calibration)
    digits = {"contrast": 6, "dW": 2, "vrad_chromatic_slope": 2, "warmth": 4, "swarmth": 4}
    bands = [f"{c}_{b}{r}" for b in TABLE_BANDS for r in TABLE_REGIONS for c in ("vrad", "svrad")]
    names = ("vrad", "svrad", "contrast", "d2v", "sd2v", "d3v", "sd3v", "warmth", "swarmth", "dW", "fwhm", "vrad_achromatic", "svrad_achromatic", "vrad_chromatic_slope", *bands)
    return table.select("exposure", *(F.round(c, digits.get(c, 3)).alias(c) for c in names))


@query(_table_sql())
def compiled_table(spark, d):
    """All nights' velocities, widths, contrast, third derivative, a projection, chromatic terms and band velocities as one table."""
    return _table(spark, d, False)


@query(_table_sql(calibration=True))
def calibration_table(spark, d):
    """The same of a calibration: its first velocities stay and lines have no biases."""
    return _table(spark, d, True)
