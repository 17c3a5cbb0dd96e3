import hashlib
import re
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrv.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """All stretches with equal words p apart, for every p; of one stretch the smallest p."""
    seen = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = {}
    for p in range(1, len(words) // 4 + 1):
        step = np.diff(np.concatenate([[0], (codes[:-p] == codes[p:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if e - s + p >= max(6, 4 * p):
                found.setdefault((s, e - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-(10**12 * r[1] // r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


key = lambda r: tuple((v is None, str(v)) for v in r)


def test_whole_table_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = P.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((slow_row(*r) for r in rows), key=key)


def test_odd_rows(spark, tmp_path):
    many = [(i, t) for i in (*range(60), None) for t in ("a b c " * 20 + "x y", "b a a a a a a b a a a a a a b")]
    texts = [None, "", " \n\t", "x", "a " * 5, "a " * 6, "a b " * 3 + "a", "a a a a " * 6, "ab " * 50_000, "é ü " * 4, "a\x0ba\x0ca\ra\ta\na", "x\x1cx x\x1cx x\x1cx x\x1cx x\x1cx x\x1cx", "日本 " * 9]
    rows = [*many, *enumerate(texts), *[(7, "r s " * 4)] * 2]
    spark.createDataFrame([(*r, 5, "e") for r in rows], "doc_id long, text string, start long, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, P.op13_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted((slow_row(*r) for r in rows), key=key)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.op13_periodic_runs(spark, f"{tmp_path}/none").collect() == []


def test_operator_keeps_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "we said it again and again and again and again and again now", "z")], "id long, body string, doc_id string")
    row = P.periodic_runs(df, id_col="id", text_col="body").collect()[0]
    assert row.doc_id == 1 and [tuple(r) for r in row.runs] == [(3, 9, 2)] and row.collapsed == "we said it again and now"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=48), min_size=1, max_size=5))
def test_runs_of_few_words_equal_brute_force(docs):
    texts = [" ".join("abc"[w] for w in d) for d in docs]
    found, collapsed = P._slice_runs(texts)
    for text, mine, left in zip(texts, found, collapsed):
        words = text.split()
        want = slow_runs(words)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert mine == want and left == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_fibonacci_words_and_nested_periods():
    a, b = "b", "a"
    for _ in range(14):
        a, b = b, b + a
    nested = (("x y " * 5 + "z ") * 6).split()
    for words in (list(b), nested, ["a"] * 3000, (["a"] * 6 + ["b"]) * 40):
        assert P._slice_runs([" ".join(words)])[0][0] == slow_runs(words)


def test_leaves_are_visited_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("ab"[w] for w in rng.integers(0, 2, 400)) for _ in range(3)]
    monkeypatch.setattr(P, "_chunks", lambda done, most: ((k, k + 1) for k in range(len(done))))
    assert P._slice_runs(texts)[0] == [slow_runs(t.split()) for t in texts]
