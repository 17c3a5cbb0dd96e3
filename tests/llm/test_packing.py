import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenrv.llm import packing as P

FILE = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, texts, window=2048):
    """texts: list of (doc_id, text), ids unique."""
    tok = Tokenizer.from_file(FILE)
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in texts}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at
    return padding, sum(map(len, ids.values()))


def test_every_id_in_one_piece(spark):
    d = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    padding, tokens = check_pieces(P.op4_packing(spark, d).collect(), texts)
    assert padding < 0.01 * tokens


def test_odd_rows_and_small_shards(spark):
    texts = [(1, None), (2, ""), (3, "a " * 9000), (4, "same words here"), (5, "same words here"), (6, "x"), (7, "日本 don't\n\n ok")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n int")
    for docs in (1, 2, 1024):
        check_pieces(P.pack(df, FILE, end_id=1, shard_docs=docs).collect(), texts)
    assert P.pack(df.limit(0), FILE, end_id=1).count() == 0
    twice = P.pack(df.union(df), FILE, end_id=1).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.doc_tokens for r in twice if r.start == 0) / 2


def test_scores_equal_brute_force():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(1, 30)) for _ in range(40)]
    flat, lens = np.concatenate(docs), np.array([len(x) for x in docs])
    idf = rng.uniform(0, 2, 50)
    idf[:5] = 0
    shard = P.Shard(flat, lens, idf, 12.0, 1.2, 0.75)
    for q in docs[:5]:
        terms = np.unique(q)
        got = shard.scores(shard.of[[x is q for x in docs].index(True)])
        for d, x in enumerate(docs):
            want = sum(idf[t] * (tf := (x == t).sum()) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / 12.0)) for t in terms)
            assert abs(got[d] - want) < 1e-4


def test_alike_documents_share_windows(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}x" for k in range(4000)]
    topics = [[words[i] for i in rng.integers(0, 4000, 60)] for _ in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8], 150)), "") for i in range(160)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, x string"), FILE, end_id=1).collect()
    seq = {}
    for r in got:
        seq.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert np.mean([len(s) for s in seq.values()]) < 2.5


def test_centres_are_of_all_documents(spark):
    """More documents than any sample was: the centres are those of k-means over every one of them."""
    rng = np.random.default_rng(6)
    words = [f" w{k}x" for k in range(300)]
    rows = [(i, "".join(words[(i % 20) * 15 + j] for j in rng.integers(0, 15, 6)) if i else "") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    size = P.vocabulary_size(FILE)
    written = P.encode_documents(df, FILE, 1, size)
    coded, held = written.filter("held is null").drop("held"), P.document_counts(written.filter("held is not null"), size)
    ids = [np.frombuffer(r.ids, f"<u{r.width}") for r in coded.orderBy("doc_id").collect()]
    assert len(ids) == 5000 and held[1] == 5000 and held.sum() == sum(len(np.unique(x)) for x in ids)
    held[1] = 0
    found, vectors = P.fit_centres(coded, held, 5000)
    by_hand = P.Centres(held, 5000)
    packed = P.packed_vectors(np.concatenate([by_hand.vectors(x, np.array([len(x)])) for x in ids]))
    assert [bytes(r.v) for r in vectors.orderBy("doc_id").collect()] == packed
    x = P.unpacked(packed, by_hand.dims)
    order = [r.doc_id for r in vectors.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    by_hand.begin([packed[i] for i in order[:128]])
    for _ in range(8):
        near = (x @ by_hand.centres.T).argmax(axis=1)
        by_hand.settle(np.stack([x[near == k].astype(float).sum(axis=0) for k in range(len(by_hand.centres))]))
    assert found.centres.shape == (16, 512) and np.abs(found.centres - by_hand.centres).max() < 1e-2


def test_parts_are_ranges_of_the_order(spark):
    """A group of copies larger than a part is spread over parts, and each part holds one range."""
    rows = [(i, "the same words in very many documents" if i % 2 else f"document {i % 97} of other words {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.pack(df, FILE, end_id=1, partition_tokens=600).collect()
    check_pieces(got, rows)
    parts = {}
    for r in got:
        parts.setdefault(r.sequence_id >> 40, set()).add(r.doc_id)
    assert len(parts) > 5 and max(map(len, parts.values())) < 200
