"""Which sources of a language differ in their words, and by which words.

Shares of words, in units of 1e-9 and raised so that none is zero, are compared between the sources of a language and
between a source and its whole language. All arithmetic is on whole numbers. The work is relational: regexp matches are
exploded, counted by (language, source, term), groups are crossed with the vocabulary kept in their language so that words
which a source lacks have a share too, and shares meet by a self-join on the term.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: A term is a run of letters of the Latin alphabet and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z as small letters, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), from lang, source, text."""
    terms = df.select("lang", "source", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("terms"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.col("terms").alias("t")), F.struct(F.lit(0).alias("n"), F.array_distinct("terms").alias("t")))
    rows = terms.select("lang", "source", F.inline(both)).select("lang", "source", "n", F.explode("t").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("d"))


def source_divergence(df: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part 'pair': every other source of the language with the divergence of shares summed over the language's kept terms (0
    if it keeps none). Part 'term': the top kept terms that a source has in a larger share than its language. A language
    keeps the terms of least_docs of its rows or more. Null text, language and source count as ''; every row is a document,
    also one that repeats an id; other columns do not matter; without rows there is none. Equal values rank by item.

    No row is gathered by language or source: terms are dealt by (language, term), of which there is one row a source at
    most; the vocabulary meets its language's groups by salted keys; the ranks of terms are cut before they are shuffled.
    """
    docs = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    group = materialize(docs.groupBy("lang", "source").count().select("lang", "source", F.monotonically_increasing_id().alias("g")))

    counts = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = materialize(counts.filter(F.col("d") >= least_docs).select("lang", "term", F.monotonically_increasing_id().alias("t"), "n", "held"))
    own = kept.select("lang", "term", "t", F.col("n").alias("all"), F.inline("held")).join(group, ["lang", "source"])

    # totals: a few numbers for each language and group
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all_n"))
    sums = own.groupBy("g").agg(F.sum("n").alias("own_n"))
    totals = materialize(
        group.join(langs, "lang", "left").join(sums, "g", "left")
        .select("g", "lang", "source", (F.coalesce("own_n", F.lit(0)) + F.col("v")).alias("total"), (F.col("all_n") + F.col("v")).alias("all_total")))

    # every kept term of a language with every group of it
    salts = min(4096, max(16, kept.count() // 20_000))
    salted = totals.select("lang", "g", "total").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    zeros = kept.select("lang", "t", F.pmod("t", F.lit(salts)).cast("int").alias("salt")).join(salted, ["lang", "salt"]).select("t", "g", "total", F.lit(0).cast("long").alias("n"))
    dense = zeros.union(own.select("t", "g", F.lit(None).cast("long"), "n")).repartition("t")
    shares = dense.groupBy("t", "g").agg(F.max("total").alias("total"), F.sum("n").alias("n")).select("t", "g", share(F.col("n"), F.col("total")).alias("p"))

    other = shares.select(F.col("t").alias("t2"), F.col("g").alias("g2"), F.col("p").alias("q"))
    met = shares.join(other, (F.col("t") == F.col("t2")) & (F.col("g") != F.col("g2")))
    pairs = met.groupBy("g", "g2").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    ends = totals.select("lang", F.col("g").alias("g2"), F.col("source").alias("item"))
    every = totals.select("lang", "g", "source").join(ends, "lang").filter("g <> g2").join(pairs, ["g", "g2"], "left")
    pair = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    p, q = share(F.col("n"), F.col("total")), share(F.col("all"), F.col("all_total"))
    larger = own.join(totals.drop("lang", "source"), "g").select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    term = larger.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [pair.withColumn("rank", F.row_number().over(order)), term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)]
    return ranked[0].union(ranked[1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(s.total, 0) + l.v) AS p, 1 + (1000000000 * (k.all_n + 1)::HUGEINT) // (l.total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y) WHERE part = 'pair' OR rank <= 200
"""
