"""Allow and block lists for page addresses: a trie over reversed host labels and path segments, the longest match wins.

A rule is `host/path`. It fits its host and all subdomains, where the address's path starts with the rule's path. Among
the rules that fit, the one with most host labels wins, then the one with the longest path, then block before allow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: The rules of the query.
BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """One node for each host label read from the right, below it one for each whole path segment.

    A node holds the rules that end there: for paths the open last segment, which the address's segment must start with.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, open_end = (slash + path).split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node["longest"] = max(node.get("longest", 0), len(open_end))
            held = node.setdefault("ends", {})
            if held.get(open_end, ("", "allow"))[1] == "allow":
                held[open_end] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of most host labels and longest path that fits, with its verdict."""
        best, node, segments = None, self.root, path.split("/")
        labels = host.split(".") if host else []
        while True:
            best = self._path(node.get("paths"), segments) or best
            if not labels or (node := node.get("labels", {}).get(labels.pop())) is None:
                return best

    @staticmethod
    def _path(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node is None:
                break
            ends = node.get("ends")
            if ends:
                for n in range(min(len(segment), node["longest"]), -1, -1):
                    if found := ends.get(segment[:n]):
                        best = found
                        break
            node = node.get("segments", {}).get(segment)
        return best


def filter_urls(df: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", max_rule_bytes: int = 64 << 20) -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict; columns of these names are replaced.

    rules has rule and verdict (allow or block); repeated rules count once, null ones not at all. The trie is broadcast
    where the rules take max_rule_bytes at most; beyond that each address is joined with the rules that could fit it.
    """
    clean = rules.filter("rule is not null and verdict in ('allow', 'block')").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    based = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    size = clean.agg(F.sum(F.length("rule") + 100)).first()[0] or 0
    if size > max_rule_bytes:
        return _joined(based, clean, default)
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie((r.rule, r.verdict) for r in clean.toLocalIterator()))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return based.withColumn("__found", judge("host", "path")).withColumns({"rule": F.col("__found.rule"), "verdict": F.col("__found.verdict")}).drop("__found")


def _joined(based: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules beyond any broadcast: distinct addresses meet rules by host suffix and path prefix.

    A suffix has at most as many labels as the longest rule host, and only such lengths of the path are looked up as rules
    of that host have.
    """
    split = rules.select(F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"), F.substring_index("rule", "/", 1).alias("__suffix"), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("__start"))
    split = materialize(split.withColumn("__n", F.length("__start")))
    most = split.agg(F.max(F.size(F.split("__suffix", r"\.", -1)))).first()[0] or 1
    lengths = split.groupBy("__suffix").agg(F.collect_set("__n").alias("__lengths"))
    keys = based.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".")))
    met = keys.withColumn("__suffix", F.explode(suffixes)).join(lengths, "__suffix")
    met = met.withColumn("__n", F.explode(F.filter("__lengths", lambda n: n <= F.length("path")))).withColumn("__start", F.substring(F.col("path"), F.lit(1), F.col("__n"))).drop("__lengths")
    met = met.join(split.drop("__n"), ["__suffix", "__start"])
    rank = F.struct(F.when(F.col("__suffix") == "", 0).otherwise(F.size(F.split("__suffix", r"\.", -1))), "__n")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("__rule", "__verdict"), rank).alias("__best"))
    out = based.join(best, ["host", "path"], "left").withColumns({"rule": F.col("__best.__rule"), "verdict": F.coalesce("__best.__verdict", F.lit(default))}).drop("__best")
    first = [c for c in based.columns if c not in ("rule", "verdict")]
    return out.select(*first, "rule", "verdict")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the fixed rules."""
    rules = spark.createDataFrame([(r, "block") for r in BLOCK] + [(r, "allow") for r in ALLOW], "rule string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.com/de/', 'block'), ('example.net/en/', 'allow'), ('org/fr/', 'allow')),
fits AS (
  SELECT p.*, r.rule, r.verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR suffix(p.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
