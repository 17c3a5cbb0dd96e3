"""Secret scans in DataFrame functions: fixed patterns, and a battery of randomness tests over long unbroken tokens.

A token's encoding is inferred (hex, base32 or base64) and its symbols' places in that alphabet are put to three tests of
evenness and independence: chi-squared uniformity over the alphabet, the number of runs above and below the alphabet's
middle, and serial correlation of neighbours. Fisher's sum makes one p-value of the three, kept in tenths of a power of ten.

What is reported is a discovery against ordinary text: decoys are made of the corpus's own words (some neighbouring ones of
each document joined), put to the same tests, and tell how often ordinary text of a length class looks as random as a token
does. The Benjamini-Hochberg rule over the tokens of a length class, with these shares as p-values, bounds the share of
false reports by the class's level. Tokens that fail the tests themselves beyond a level are never reported. The rule needs
only counts for each class and tenth, however many tokens there are; without decoys nothing random is reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize

#: The patterns and the least lengths of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The alphabets.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Length classes (least length) and the share of false reports that is put up with; tenths at which tests fail.
CLASSES, FAILS = ((20, 0.10), (24, 0.10), (32, 0.05), (48, 0.02), (64, 0.01)), 30
#: The same for redaction, where a lost key stays readable.
STRICT, STRICT_FAILS = ((20, 0.50), (24, 0.50), (32, 0.20), (48, 0.10), (64, 0.05)), 40
#: Words that are joined to a decoy, one for each number and document.
DECOY_WORDS = (4, 5, 7, 11, 16)
#: So many characters at a text's end are no place to look for them from; they hold the longest.
NEAR_END = 400
LAST_BIN, WHOLE = 400, -1
CHUNK = 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def match_places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, in code points; found is the group's text.

    What lies between the matches and the matches themselves have lengths that add up to the places. The running sums go
    by chunks of 256 matches, so that texts of very many matches stay cheap.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"))

    def places(p: Column) -> Column:
        n = F.size(p["whole"])
        steps = F.zip_with(F.transform(F.slice(p["gaps"], 1, n), lambda g: F.length(g).cast("bigint")), F.transform(p["whole"], F.length), lambda g, m: F.struct(g.alias("g"), (g + m).alias("step")))
        return let(F.struct(steps.alias("s"), p["whole"].alias("whole"), p["found"].alias("found")), summed)

    def summed(p: Column) -> Column:
        last = F.floor((F.size(p["s"]) - 1) / F.lit(CHUNK)).cast("int")
        of = lambda c, n: _total(F.transform(F.slice(p["s"], c * CHUNK + 1, n), lambda x: x["step"]))
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: of(c, F.lit(CHUNK)))
        return let(chunks, lambda sums: let(F.transform(F.sequence(F.lit(0), last), lambda c: _total(F.slice(sums, F.lit(1), c))), lambda before: listed(p, before, of)))

    def listed(p: Column, before: Column, of: Callable) -> Column:
        def one(x: Column, i: Column) -> Column:
            c = F.floor(i / F.lit(CHUNK)).cast("int")
            start = F.get(before, c) + of(c, i % CHUNK) + x["g"]
            return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(F.get(p["whole"], i))).alias("end"), F.get(p["found"], i).alias("found")))

        return F.transform(p["s"], one)

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(parts, places)).otherwise(F.array().cast("array<struct<start: bigint, end: bigint, found: string>>"))


def _ranked(rank: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, in order of start and kind."""
    kinds = []
    for rank, (kind, pattern, group) in enumerate((("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0))):
        least = LEAST[kind]
        if kind != "assign":  # runs of one alphabet: those too short hide nothing, and need not be listed
            pattern = pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}"
        found = F.filter(match_places(text, pattern, group), lambda m: F.length(m["found"]) >= least)
        kinds.append(F.transform(found, _ranked(rank)))
    return F.array_sort(F.concat(*kinds))


def upper_normal(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.2316419)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * series, F.lit(1e-40))


def log_p(token: Column) -> Column:
    """struct(n, bin): length without padding, and tenths of -log10 of the combined p-value, rounded down."""
    bare = F.regexp_replace(token, "=+$", "")
    kind = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")

    def encoded(x: Column) -> Column:
        alphabet = F.when(x["kind"] == "hex", ALPHABETS["hex"]).when(x["kind"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        text = F.when(x["kind"] == "hex", F.lower(x["bare"])).otherwise(F.translate(x["bare"], "-_", "+/"))
        return let(F.struct(alphabet.alias("a"), text.alias("t"), F.length(alphabet).cast("double").alias("k"), F.length(text).cast("double").alias("n")), counted)

    def counted(x: Column) -> Column:
        squares = F.aggregate(F.split(x["a"], "", -1), F.lit(0.0), lambda s, c: s + F.pow(x["n"] - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0)))
        places = F.transform(F.split(x["t"], "", -1), lambda c: F.instr(x["a"], c).cast("double") - 1 - (x["k"] - 1) / 2)
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("cross"))
        walk = lambda s, u: F.struct(u.alias("last"), (s["runs"] + F.when(F.coalesce((s["last"] >= 0) != (u >= 0), F.lit(False)), 1.0).otherwise(0.0)).alias("runs"), (s["cross"] + F.coalesce(s["last"], F.lit(0.0)) * u).alias("cross"))
        return let(F.struct(x["k"].alias("k"), x["n"].alias("n"), squares.alias("squares"), F.aggregate(places, start, walk).alias("w")), tested)

    def tested(x: Column) -> Column:
        k, n, df = x["k"], x["n"], x["k"] - 1
        chi = x["squares"] * k / n - n
        cube = F.lit(2.0) / (df * 9)
        z = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (F.lit(1.0) - cube)) / F.sqrt(cube)  # Wilson and Hilferty
        runs = (x["w"]["runs"] - 1 - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        serial = x["w"]["cross"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        return let(F.struct(z.alias("z"), F.abs(runs).alias("r"), F.abs(serial).alias("s"), n.alias("n")), combined)

    def combined(x: Column) -> Column:
        chi = F.when(x["z"] >= 0, upper_normal(x["z"])).otherwise(F.lit(1.0) - upper_normal(-x["z"]))
        total = -(F.log(chi) + F.log(F.least(F.lit(1.0), upper_normal(x["r"]) * 2)) + F.log(F.least(F.lit(1.0), upper_normal(x["s"]) * 2)))
        p = lambda t: F.exp(-t) * (F.lit(1.0) + t + t * t / 2)
        return let(total, lambda t: F.struct(x["n"].cast("int").alias("n"), F.least(F.lit(LAST_BIN), F.floor(F.log10(F.greatest(p(t), F.lit(1e-40))) * -10)).cast("int").alias("bin")))

    return let(F.struct(bare.alias("bare"), kind.alias("kind")), encoded)


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, (least, _) in enumerate(CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def token_tests(text: Column, base: Column, partial: bool = False) -> Column:
    """array<struct<start, end, class, bin>> of the long tokens outside the fixed patterns; digits alone are no encoded key.

    With partial, tokens that the patterns cover only in part come too: those with an access key or hex run inside are
    secrets as a whole (bin WHOLE), those with an assignment alone are tested like others.
    """
    free = F.filter(match_places(text, TOKEN), lambda m: ~m["found"].rlike("^[0-9]+=*$") & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    tested = F.transform(free, lambda m: let(log_p(m["found"]), lambda t: F.struct(m["start"].alias("start"), m["end"].alias("end"), _class(t["n"]).alias("class"), t["bin"].alias("bin"))))
    if not partial:
        return tested
    covered = lambda m: F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
    touched = F.filter(match_places(text, TOKEN), lambda m: F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & ~covered(m))
    run_inside = lambda m: F.exists(base, lambda b: (b["rank"] > 0) & (b["start"] < m["end"]) & (m["start"] < b["end"]))
    more = F.transform(touched, lambda m: let(log_p(m["found"]), lambda t: F.struct(m["start"].alias("start"), m["end"].alias("end"), _class(t["n"]).alias("class"), F.when(run_inside(m), WHOLE).otherwise(t["bin"]).alias("bin"))))
    return F.when(F.size(base) > 0, F.concat(tested, more)).otherwise(tested)


def decoy_pattern(words: int) -> str:
    """Neighbouring words of 20 letters at most, so that unbroken letters of any length are passed in one go."""
    return f"(?:[A-Za-z]{{1,20}}[ ,.;]{{1,3}}){{{words - 1}}}[A-Za-z]{{1,20}}"


def decoys(text: Column) -> Column:
    """array<struct<class, bin>>: the tests of ordinary words, joined; for each number in DECOY_WORDS the first such words behind a place.

    The place is picked by the text's checksum, from all of the text but its last NEAR_END characters.
    """
    length = F.char_length(text)
    at = F.when(length > NEAR_END, F.crc32(text.cast("binary")) % F.greatest(length - NEAR_END, F.lit(1))).otherwise(0)
    behind = let(at, lambda at: F.concat(F.when(at == 0, " ").otherwise(""), F.substring(text, (at + 1).cast("int"), length)))

    def of(behind: Column) -> Column:
        joined = F.array(*(F.translate(F.regexp_extract(behind, f"[ ,.;]({decoy_pattern(n)})", 1), " ,.;", "") for n in DECOY_WORDS))
        return F.transform(F.filter(joined, lambda t: F.length(t) >= CLASSES[0][0]), lambda t: let(log_p(t), lambda p: F.struct(_class(p["n"]).alias("class"), p["bin"].alias("bin"))))

    return let(behind, of)


def last_bins(tested: DataFrame, classes: tuple = CLASSES, fails: int = FAILS) -> dict[int, int]:
    """For each length class the greatest tenth of -log10(p) that is reported; a number for each reaches the driver."""
    of = lambda c, name: tested.select(F.explode(c).alias("t")).filter(F.col("t.bin") > WHOLE).groupBy("t.class", "t.bin").agg(F.count("*").alias(name))
    counts = of("__tokens", "tokens").join(of("__decoys", "decoys"), ["class", "bin"], "full").fillna(0, ["tokens", "decoys"])
    every = Window.partitionBy("class")  # a class has 401 rows at most
    upto = every.orderBy("bin")
    level = F.element_at(F.array(*(F.lit(q) for _, q in classes)), F.col("class") + 1)
    ranked = counts.withColumns({"rank": F.sum("tokens").over(upto), "all": F.sum("tokens").over(every), "d": F.sum("decoys").over(upto), "m": F.sum("decoys").over(every)})
    found = ranked.filter((F.col("tokens") > 0) & (F.col("m") > 0) & (((F.col("d") + 1) / (F.col("m") + 1)) * F.col("all") <= level * F.col("rank")))
    return {r["class"]: min(r["bin"], fails - 1) for r in found.groupBy("class").agg(F.max("bin").alias("bin")).collect()}


def with_secrets(df: DataFrame, *, text_col: str = "text", keep_text: bool = True, classes: tuple = CLASSES, fails: int = FAILS, partial: bool = False) -> DataFrame:
    """df with base_spans (fixed patterns) and spans (all), array<struct<start, rank, end>> by start, then kind (rank in KINDS).

    A null text is the empty one and has no spans; rows stay as many as they are, repeated or null ids included. Columns
    of these two names are replaced. keep_text=False leaves the text out of what is written between the two passes.
    classes are the levels of false reports, fails the tenth at which the tests fail; partial has tokens reported too that
    a fixed pattern covers only in part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tested = df.withColumn("base_spans", base_spans(text))
    tested = tested.withColumns({"__tokens": token_tests(text, F.col("base_spans"), partial), "__decoys": decoys(text)})
    tested = materialize(tested if keep_text else tested.drop(text_col))
    last = last_bins(tested, classes, fails)

    def secret(t: Column) -> Column:
        out = t["bin"] == WHOLE
        for c, b in last.items():
            out = out | ((t["class"] == c) & (t["bin"] <= b))
        return out

    random = F.transform(F.filter("__tokens", secret), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    return tested.withColumn("spans", F.array_sort(F.concat("base_spans", random))).drop("__tokens", "__decoys")


def redact_secrets(df: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every secret of the texts replaced by the mark, at the STRICT levels, whole tokens; null texts stay null."""
    found = with_secrets(df.drop("spans", "base_spans"), text_col=text_col, classes=STRICT, fails=STRICT_FAILS, partial=True)
    text = F.when(F.size("spans") > 0, redact(F.col(text_col), F.col("spans"), mark)).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).drop("spans", "base_spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch that spans cover replaced by the mark; touching and nested spans are one stretch."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["parts"], piece).alias("parts"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the secrets of every document."""
    found = with_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    counts = [F.size(F.filter("base_spans", _of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _normal_sql(z: str) -> str:
    t = f"(1 / (1 + {z} * 0.2316419e0))"
    return f"greatest(exp(-{z} * {z} / 2) * 0.3989422804014327e0 * ({t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))), 1e-40)"


def _places_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, found, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start, length(w[i]) AS n
  FROM (SELECT r, i, w, g, f[i] AS found FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS w, regexp_extract_all(text, '{pattern}', {group}) AS f, string_split_regex(text, '{pattern}') AS g FROM d),
    LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)) WHERE length(found) >= {least}"""


_ALPHABET_SQL = f"CASE kind WHEN 'hex' THEN '{ALPHABETS['hex']}' WHEN 'base32' THEN '{ALPHABETS['base32']}' ELSE '{ALPHABETS['base64']}' END"

OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_places_sql(k, i, p, g, LEAST[k]) for i, (k, p, g) in enumerate((("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", "[0-9a-f]{32,}", 0))))}),
tokens AS ({_places_sql("random", 3, TOKEN, 0, 20)}),
decoys AS ({" UNION ALL ".join(f"SELECT r, translate(regexp_extract(text, '{decoy_pattern(n)}', 0), ' ,.;', '') AS bare FROM d" for n in DECOY_WORDS)}),
free AS (SELECT t.r, t.start, t.n, regexp_replace(found, '=+$', '') AS bare, false AS decoy FROM tokens t WHERE NOT regexp_full_match(found, '[0-9]+=*')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.start < t.start + t.n AND t.start < b.start + b.n)
  UNION ALL SELECT r, 0, 0, bare, true FROM decoys WHERE length(bare) >= {CLASSES[0][0]}),
kinds AS (SELECT decoy, r, start, n, bare, CASE WHEN regexp_full_match(bare, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(bare, '[A-Z2-7]+') THEN 'base32' ELSE 'base64' END AS kind FROM free),
coded AS (SELECT decoy, r, start, n, {_ALPHABET_SQL} AS a, CASE WHEN kind = 'hex' THEN lower(bare) ELSE translate(bare, '-_', '+/') END AS t FROM kinds),
counted AS (SELECT *, CAST(length(a) AS DOUBLE) AS k, CAST(length(t) AS DOUBLE) AS l, list_sum(list_transform(string_split(a, ''), lambda c: pow(length(t) - length(replace(t, c, '')), 2))) AS squares,
  list_transform(string_split(t, ''), lambda c: strpos(a, c) - 1 - (length(a) - 1) / 2e0) AS u FROM coded),
walked AS (SELECT *, coalesce(list_sum(list_transform(range(2, len(u) + 1), lambda i: CASE WHEN (u[i] >= 0) <> (u[i - 1] >= 0) THEN 1e0 ELSE 0e0 END)), 0) AS changes,
  coalesce(list_sum(list_transform(range(2, len(u) + 1), lambda i: u[i] * u[i - 1])), 0) AS cross_sum, squares * k / l - l AS chi, 2 / (9 * (k - 1)) AS cube FROM counted),
tested AS (SELECT *, (pow(greatest(chi, 1e-9) / (k - 1), 1 / 3e0) - (1 - cube)) / sqrt(cube) AS z, abs((changes - (l - 1) / 2) / (sqrt(l - 1) / 2)) AS zr, abs(cross_sum / ((k * k - 1) / 12) / sqrt(l - 1)) AS zs FROM walked),
summed AS (SELECT *, -(ln(CASE WHEN z >= 0 THEN {_normal_sql("z")} ELSE 1 - {_normal_sql("(-z)")} END) + ln(least(1, 2 * {_normal_sql("zr")})) + ln(least(1, 2 * {_normal_sql("zs")}))) AS x FROM tested),
binned AS MATERIALIZED (SELECT decoy, r, start, n, CASE {" ".join(f"WHEN l >= {n} THEN {i}" for i, (n, _) in reversed(list(enumerate(CLASSES))))} END AS class, CAST(least({LAST_BIN}, floor(log10(greatest(exp(-x) * (1 + x + x * x / 2), 1e-40)) * -10)) AS INTEGER) AS bin FROM summed),
counts AS (SELECT class, bin, count(*) FILTER (NOT decoy) AS t, count(*) FILTER (decoy) AS c FROM binned GROUP BY ALL),
last AS (SELECT class, least(max(bin), {FAILS - 1}) AS bin FROM (SELECT class, bin, t, sum(t) OVER w AS rank, sum(t) OVER (PARTITION BY class) AS every, sum(c) OVER w AS k, sum(c) OVER (PARTITION BY class) AS m FROM counts WINDOW w AS (PARTITION BY class ORDER BY bin))
  WHERE t > 0 AND m > 0 AND (k + 1) / (m + 1) * every <= CASE class {" ".join(f"WHEN {i} THEN {q}e0" for i, (_, q) in enumerate(CLASSES))} END * rank GROUP BY class),
spans AS (SELECT r, kind, rank, start, start + n AS stop FROM base UNION ALL
  SELECT r, 'random', 3, start, start + n FROM binned b JOIN last f ON b.class = f.class AND b.bin <= f.bin WHERE NOT decoy),
texts AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN texts USING (r)
"""
