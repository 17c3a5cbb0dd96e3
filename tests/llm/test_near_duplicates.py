import random

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from lumenrv.llm import components as C
from lumenrv.llm import near_vectors as V
from lumenrv.llm import simhash as S


def sets_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_circles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)] + [(5, 5)]
    links += [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = sets_of({x for l in links for x in l}, links)
    assert got == {n: c for n, c in want.items() if n != 5}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_close_words_share_a_codeword():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    mine, there = S.codewords(x)
    assert there.sum(axis=1).max() == 6 and set(there.sum(axis=1)) == {1, 6}
    for _ in range(3):
        y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
        other, also = S.codewords(y)
        same = (mine[:, :, None] == other[:, None, :]) & there[:, :, None] & also[:, None, :]
        assert same.any(axis=(1, 2)).all()


def test_links_equal_brute_force_also_when_keys_are_crowded(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30)
    fps = set(rng.integers(0, 1 << 63, 500).tolist())
    for s in seeds.tolist():
        for _ in range(40):
            v = s
            for _ in range(rng.integers(1, 4)):
                v ^= 1 << int(rng.integers(0, 63))
            fps.add(v)
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    links = [(fps[i], fps[j]) for i in range(len(fps)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2)).tolist()]
    want = sets_of(fps, links)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for crowded in (256, 4):
        found = S.fingerprint_links(df, crowded=crowded)
        pairs = [tuple(r) for r in found.collect()]
        assert sets_of(fps, pairs) == want


def test_documents_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, " \t"), (10**9 + 3, "One"), (10**9 + 4, "one"), (10**9 + 5, "É b"), (10**9 + 6, "a b c"), (10**9 + 6, "a b c"), (10**9 + 7, " ".join(f"w{k % 977}" for k in range(120_000)))]
    rows = texts + odd
    fps = {t: plain_fingerprint(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    links = [(x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :] if bin(x ^ y).count("1") <= 2]
    sets = sets_of(distinct, links)
    least = {}
    for i, t in rows:
        least[sets[fps[t]]] = min(i, least.get(sets[fps[t]], i))
    want = sorted((i, f"{fps[t]:016x}", least[sets[fps[t]]]) for i, t in rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string")
    got = sorted(tuple(r) for r in S.near_duplicates(df.repartition(7)).collect())
    assert got == want
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_documents_without_id(spark):
    df = spark.createDataFrame([(None, "one two three four"), (4, "one two three four"), (None, "five six seven"), (9, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 4), (4, 4), (None, None), (9, 9)], key=str)
    assert sorted(map(str, (r.text for r in S.drop_near_duplicates(df).collect()))) == ["None", "five six seven", "one two three four"]


def test_vectors_at_the_threshold_and_without_id(spark):
    """Cosines of exactly 0.98 link; vectors just below do not; rows without id stay alone."""
    at = lambda c: [c, float(np.sqrt(1 - c * c)), 0.0, 0.0]
    rows = [(1, [1.0, 0, 0, 0], 0), (2, at(0.98 + 1e-12), 0), (3, [0, 0, 1.0, 0], 0), (4, [0, 0, 0.98 - 1e-9, float(np.sqrt(1 - (0.98 - 1e-9) ** 2))], 0), (None, [1.0, 0, 0, 0], 0), (1, [1.0, 0, 0, 0], 0), (6, [1e-200, 0, 0, 0], 0), (7, [1e300, 0, 0, 0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in V.near_vectors(spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (None, 0, None), (6, 4, 1), (7, 4, 1)], key=str)


def brute_vectors(rows, least=0.98):
    known = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for k, (i, a, x) in enumerate(known):
        for j, b, y in known[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((i, j))
    return sets_of([r[0] for r in rows], links), links


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for lab in (0, 1):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(rng.integers(1, 25)):
                rows.append((n, (base + rng.normal(size=24) * rng.uniform(0, 0.25)).astype(np.float32).tolist(), lab))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 24, 0), (n + 5, [float("nan")] * 24, 0), (n + 6, [1.0, None] * 12, 0), (n + 7, [], 0), (n + 8, rows[0][1][:12], 0), (n + 9, [-0.0] + [1.0] * 23, 0), (n + 10, [0.0] + [1.0] * 23, 0)]
    sets, links = brute_vectors(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n int, node int")
    for block in (2048, 8):
        got = V.near_vectors(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_links == sum(r.vec_id in l for l in links), r
            assert r.component_id == sets[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert V.near_vectors(df.limit(0)).count() == 0
    assert V.near_vectors(df.filter("vec_id < 3").union(df.filter("vec_id < 3"))).count() == 6


def test_query_on_a_whole_table_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.execute(V.OP3_SQL).fetchall())
    got = V.op3_near_vectors(spark, d).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_spark_hashes_shingles_alike(spark):
    words = "é b c".encode()
    assert spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(words, seed=42)
