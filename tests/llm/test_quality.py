import math
import re
import statistics as st
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenrv.llm import quality as Q

SF = "/root/testdata/sf0.01"
ODD = ["", " \n ", "x", "De.", "The the The the", "A b\n\nA b\nc", "a| b| c|", "LOUD!! WORDS!!", "é É ß 日本 😀", "12 345 6a", "\n\nlead", "w wide", "no  end " * 300, "z" * 20_000, "p q " * 50 + "\n" + "p q " * 50]


def slow_statistics(text):
    words = text.split()
    words = [w for part in words for w in part.split()]
    if not words:
        return [0.0] * len(Q.STATISTICS)
    n, chars = len(words), sum(map(len, words))
    kind = lambda c: Q.BLANK if c.isspace() else Q.CAPITAL if c.isupper() else Q.SMALL if c.isalpha() else Q.DIGIT if c.isdigit() else Q.STOP if c in ".,;:?'\"-()" else Q.MARK
    count = Counter(map(kind, text))
    lines = [x for x in text.split("\n") if x.split()]
    pairs = list(zip(words, words[1:]))
    share = lambda flags: sum(flags) / (n + Q.FEW_WORDS)
    kinds = lambda k: count[k] / (chars + Q.FEW_CHARS)
    cased = [Counter(map(kind, w)) for w in words]
    sizes = [
        n, chars / n, st.pstdev(map(len, words)), max(map(len, words)), n / len(lines),
    ]
    shares = [
        kinds(Q.CAPITAL), kinds(Q.DIGIT), kinds(Q.STOP), kinds(Q.MARK), sum(ord(c) > 127 for c in text) / (chars + Q.FEW_CHARS),
        share(not (c[Q.CAPITAL] + c[Q.SMALL]) for c in cased), share(kind(w[-1]) == Q.MARK for w in words), share(c[Q.CAPITAL] > 1 and not c[Q.SMALL] for c in cased),
        share(len(w) <= 3 for w in words), share(kind(w[0]) == Q.CAPITAL for w in words), (n - len(set(words))) / (n + Q.FEW_WORDS), share(a == b for a, b in pairs),
        share(a == b for a, b in zip(words, words[2:])), (len(pairs) - len(set(pairs))) / (n + Q.FEW_WORDS), (len(lines) - len(set(lines))) / len(lines),
    ]
    return [math.log1p(x) for x in sizes] + [math.sqrt(x) for x in shares]


def test_statistics_equal_slow_ones(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = np.array([slow_statistics(t) for t in texts])
    assert np.allclose(Q.statistics(texts), want, atol=1e-7)
    assert np.allclose(np.concatenate([Q.statistics([t]) for t in texts]), want, atol=1e-7)
    assert Q.statistics([]).shape == (0, len(Q.STATISTICS)) and re.fullmatch(r"[a-zA-Z ,]+", ",".join(Q.STATISTICS))


def test_scores_are_ratios_of_two_gaussians():
    rng = np.random.default_rng(2)
    p = len(Q.STATISTICS)
    x = {c: rng.standard_normal((n, p)) @ rng.standard_normal((p, p)) + c for c, n in ((0, 300), (1, 900))}
    scale, classes = Q.fit({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1198 + 1e-6 * np.eye(p)
    assert np.allclose(scale, np.sqrt(np.diag(pooled)))
    for c, v in x.items():
        n = len(v)
        mixed = (np.cov((v / scale).T, bias=True) * n + 10 * p * pooled / np.outer(scale, scale)) / (n + 10 * p)
        mean_variance = np.trace(mixed) / p
        rho = Q.shrunk(mixed, n + 10 * p)[0, 1] / mixed[0, 1]
        cov = rho * mixed + (1 - rho) * mean_variance * np.eye(p) + 1e-3 * np.eye(p)
        at = rng.standard_normal((5, p))
        d = at - v.mean(axis=0) / scale
        want = math.log(n / 1200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert 0 < rho < 1 and np.allclose(classes[c].log_density(at), want)


def test_held_out_documents_are_told_apart(spark):
    got = {r.doc_id: r for r in Q.op11_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    junk, clean = [p for p, y in held if not y], [p for p, y in held if y]
    assert len(junk) >= 15 and sum(junk) == 0 and sum(clean) >= len(clean) - 1


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    one, two = ({r.doc_id: r.score for r in Q.score_quality(docs, x).collect()} for x in (labels, turned))
    assert one.keys() == two.keys() and all(math.isclose(one[d], two[d], rel_tol=1e-6, abs_tol=1e-9) for d in one)


@pytest.mark.parametrize("classes, want", [((), 0.5), ((1,), 13 / 14), ((0,), 1 / 14)])
def test_fewer_than_two_classes_give_one_score(spark, classes, want):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:12]
    labels = spark.createDataFrame([(i, c) for c in classes for i in ids] + [(None, 1), (ids[0], None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "some text") for i in range(100)], "doc_id long, text string")
    assert {round(r.score, 9) for r in Q.score_quality(docs, labels).collect()} == {round(want, 9)}


def test_odd_tables(spark):
    rows = [(i, t, 0.5, "q", True) for i, t in enumerate([None, *ODD])] + [(3, "again", 1.0, "q", False), (None, "no id", 0.0, "q", None), (None, None, 0.0, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, quality string, held_out boolean")
    ids = [i for i in range(len(ODD)) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in ids] + [(ids[0], 1 - ids[0] % 2, "x"), (ids[0], ids[0] % 2, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    got = Q.score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "statistics"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (0, 1, 2)}) == 1  # texts without words are alike
    assert Q.score_quality(docs.limit(0), labels).collect() == []
