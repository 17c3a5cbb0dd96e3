import hashlib
import itertools
import struct
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from lumenrv.llm import line_dedup as L
from lumenrv.llm import sentences, toxicity, url_filters
from lumenrv.llm import token_files as T
from lumenrv.llm.bpe import CachedBpe
from lumenrv.llm.words import WordCache

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a", "don't  we'll", "日本語 テキスト", "<|endoftext|> x", "a" * 5000, "é" * 3000 + " x", "  lead", "trail  ", "\u2581x ▁", "😀 e\u0301", "\x00 \x7f", "ß ſ K"]


def whole(name):
    return duckdb.sql(f"select doc_id, text from '{SF}/{name}.parquet'").fetchall()


def odd_frame(spark, extra=""):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")


def test_cached_encoding_equals_the_library():
    tok = Tokenizer.from_file(BPE)
    texts = [t or "" for t in ODD] + [t for _, t in whole("documents")]
    small = CachedBpe(BPE, cache_words=50)
    for bpe in (CachedBpe(BPE), small):
        for at in range(0, len(texts), 40):
            part = texts[at : at + 40]
            assert [x.tolist() for x in bpe.encode(part)] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


def mirrored(n, a, b):
    """Two words whose polynomial hashes modulo 2**64 are equal for n of 1,024 or more, whatever the base."""
    turn = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[t] for t in turn), "".join((b, a)[t] for t in turn)


@pytest.mark.parametrize("letters", ["AB", "ab"])
def test_words_of_equal_hashes_are_told_apart(letters):
    tok, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for n in (512, 1024, 2048):
        x, y = mirrored(n, *letters)
        for batches in ([[f"{x} {y}"]], [[x], [y]], [[x, y], [y, f"{y} {x}"]]):
            bpe, merge = CachedBpe(BPE), sentences.MergeEncoder(public_tokenizers.path("piece_bpe_32k.model"))
            for batch in batches:
                assert [v.tolist() for v in bpe.encode(batch)] == [e.ids for e in tok.encode_batch(batch, add_special_tokens=False)]
                assert [np.frombuffer(v, "<u4").tolist() for v in merge.encode(batch)] == sp.encode(batch)
            assert merge.mismatches == 0


ALIKE = [(" ĳĸĺŌũĶĚ", " îÙÔþôtú"), (" 埥朑籮曆胀逢翊", " hllABIl"), (" abcdefg", " abcdefé")]  # the first one's hash, unmarked, reads as the second one's characters


@pytest.mark.parametrize("pair", ALIKE)
@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("together", [True, False])
def test_a_hash_is_never_taken_for_a_short_word(pair, turn, together):
    """op1, op2, op4 and op6 take words from this cache."""
    tok, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bpe, merge = CachedBpe(BPE), sentences.MergeEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"x{w}" for w in pair[::turn]]
    for batch in [texts] if together else [texts[:1], texts[1:]]:
        assert [v.tolist() for v in bpe.encode(batch)] == [e.ids for e in tok.encode_batch(batch, add_special_tokens=False)]
        assert [np.frombuffer(v, "<u4").tolist() for v in merge.encode(batch)] == sp.encode(batch)
    net = toxicity.train([(["a b"], 0), (["c d"], 1)] * 8, epochs=1, least_steps=2)
    cache = WordCache(net.learn, np.float32, 1000, 1000 * 6 * toxicity.HIDDEN)
    parts = [toxicity.score_batch(net, cache, b, 64, 48) for b in ([texts] if together else [texts[:1], texts[1:]])]
    fresh = [toxicity.score_batch(net, WordCache(net.learn, np.float32, 1000, 1000 * 6 * toxicity.HIDDEN), [t], 64, 48)[0] for t in texts]
    assert np.allclose(np.concatenate(parts), fresh)


@pytest.mark.parametrize("alphabet", [range(0x41, 0x5B), range(0x20, 0x100), range(0x100, 0x250), [0, 1, 0xFF, 0x100, 0x1F600]])
def test_keys_of_the_two_kinds_share_no_number(alphabet):
    rng = np.random.default_rng(3)
    points = rng.choice(np.array(list(alphabet), np.uint32), 40_000)
    cuts = np.append(0, np.cumsum(rng.integers(0, 20, 2_000)))
    starts, ends = cuts[:-1], cuts[1:]
    keys, short = WordCache(lambda words: (np.zeros(0), np.zeros(0)), "<u4")._keys(points, starts, ends)
    assert (keys[short] < 1 << 63).all() and (keys[~short] >= 1 << 63).all()
    want = [e - s <= 8 and all(c < 256 for c in points[s:e]) and all(c < 128 for c in points[s + 7 : e]) for s, e in zip(starts, ends)]
    assert short.tolist() == want


def expected_rows(texts, end=2):
    tok, at, out = Tokenizer.from_file(BPE), 0, []
    for d, t in sorted(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_come_back(spark, tmp_path):
    texts = whole("documents")
    assert sorted(tuple(r) for r in T.op1_token_files(spark, SF).collect()) == expected_rows(texts)
    odd = list(enumerate(ODD))
    manifest = T.write_token_files(odd_frame(spark), BPE, f"file://{tmp_path}/files", end_id=2, file_bytes=60)
    assert manifest.count() > 1
    assert sorted(tuple(r)[:4] for r in T.read_token_files(manifest).collect()) == expected_rows(odd)
    some = T.read_token_files(manifest, [3, 99, 7]).collect()
    assert sorted(r.doc_id for r in some) == [3, 7]
    tok = Tokenizer.from_file(BPE)
    assert {r.doc_id: list(r.ids) for r in some} == {d: tok.encode(ODD[d], add_special_tokens=False).ids + [2] for d in (3, 7)}
    assert T.read_token_files(manifest, []).count() == 0
    empty = T.write_token_files(odd_frame(spark).limit(0), BPE, f"file://{tmp_path}/none", end_id=2)
    assert empty.count() == 0 and T.read_token_files(empty).count() == 0


def test_repeated_and_null_ids_in_token_files(spark, tmp_path):
    texts = [(5, "one two"), (5, "three"), (5, "three"), (None, "no id"), (None, None), (2, "x" * 200_000), (7, "")]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, frame string")
    manifest = T.write_token_files(df.repartition(3), BPE, f"file://{tmp_path}/files", end_id=2, file_bytes=40)
    tok = Tokenizer.from_file(BPE)
    rows = sorted(T.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2, 5, 5, 5, 7]
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(d), ids(t)) for d, t in texts)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert {tuple(r.ids) for r in T.read_token_files(manifest, [5]).collect()} == {tuple(ids("one two")), tuple(ids("three"))}


def test_pieces_of_odd_tables(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "same", b"", ""), (1, "same", b"", ""), (None, "a b", b"", "")], "doc_id long, text string, ids binary, decoded string")
    rows = sentences.encode_pieces(df, model).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert sorted((str(r.doc_id), r.decoded, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((str(d), t, sp.encode(t, add_bos=True, add_eos=True)) for d, t in ((1, "same"), (1, "same"), (None, "a b")))
    assert sentences.encode_pieces(df.limit(0), model).count() == 0


def test_any_reader_unpacks_a_file_and_damage_is_noticed(spark, tmp_path):
    T.write_token_files(odd_frame(spark), BPE, f"file://{tmp_path}/files", end_id=2)
    file = next((tmp_path / "files").glob("*.zst"))
    raw = file.read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
        plain = reader.read()
    assert len(plain) % 2 == 0 and struct.unpack("<H", plain[-2:])[0] == 2
    file.write_bytes(raw[:20] + bytes([raw[20] ^ 255]) + raw[21:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(T.TokenFile(f"file://{file}").all())


def test_sentencepiece_equals_the_library(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for rows, texts in ((sentences.op2_sentencepiece(spark, SF).collect(), dict(whole("documents"))),):
        for r in rows:
            ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert len(rows) == len(texts) and sum(r.mismatches for r in rows) == 0
    for r in sentences.encode_pieces(odd_frame(spark), model).collect():
        ids = sp.encode(ODD[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids)


def slow_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (not h or host == h or host.endswith("." + h)) and path.startswith("/" + p):
            key = (h.count(".") + bool(h), len(p), verdict == "block")
            best = max(best or (key, rule, verdict), (key, rule, verdict))
    return host, path, best


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_addresses_equal_brute_force(spark, limit):
    urls = [None, "", "x", "http://", "http://NET", "http://a.NET/x?q#f", "ftp://example.net/en/1", "http://example.net/en", "http://example.net/en?x", "a://b://net/x", "http://xnet/", "http://a.example.com/de/", "http://org/fr/x", "https://É.org/fr/\n/x", "http://net?x=/en/", "http://net#/", "//x", "http://.net/", "http://a..net/y", "http://net/" + "x" * 200_000, "http://" + "a." * 3000 + "net/q", "http://NET"]
    rules = [("net/", "block"), ("example.com/de/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("org/f", "block"), ("net/", "allow"), (None, "block"), ("net/x", "allow"), ("/en/", "block")]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filters.filter_urls(df, spark.createDataFrame(rules, "rule string, verdict string"), max_rule_bytes=limit).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = slow_rule(u, [r for r in rules if r[0] is not None])
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1] if best else None, best[2] if best else "allow"), u
    assert url_filters.filter_urls(df.limit(0), spark.createDataFrame(rules, "rule string, verdict string"), max_rule_bytes=limit).count() == 0


def block(tag, n, words=12):
    return [f"{tag} line {k} " + " ".join(f"w{tag}{k}x{j}" for j in range(words)) for k in range(n)]


def test_common_blocks_go_from_later_documents(spark):
    passage, notice = block("p", 5), ["all rights reserved"]
    docs = {
        1: block("a", 4) + passage + notice,
        2: block("b", 3) + ["", passage[0], "", *passage[1:]] + block("c", 2) + notice,  # blank lines between
        3: passage[3:] + block("d", 3),  # two lines of 15 words: too few
        4: block("e", 2) + passage[::-1],  # other order: one line at a time
        5: block("a", 4) + passage + notice,  # a copy
        6: notice + block("f", 2) + ["short"] * 40,
        7: block("g", 2) + ["short"] * 40,  # lines that repeat
    }
    text = {i: "\n".join(x) for i, x in docs.items()} | {8: None, 9: "", 0: "  \n"}
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in text.items()], "doc_id long, text string, id int, kept string")
    got = {r.doc_id: r for r in L.dedup_lines(df.repartition(5)).collect()}
    assert len(got) == len(text) and L.dedup_lines(df).columns == [*df.columns, "removed_lines"]
    for i in (1, 3, 4, 6, 8, 9, 0):
        assert got[i].text == text[i] and got[i].removed_lines == []
    assert got[2].text == "\n".join(block("b", 3) + ["", ""] + block("c", 2) + notice)
    assert got[5].text == "" and len(got[5].removed_lines) == 10
    assert got[7].text == "\n".join(block("g", 2))
    assert L.dedup_lines(df.limit(0)).count() == 0
    twice = L.dedup_lines(df.filter("doc_id = 1").union(df.filter("doc_id = 1"))).collect()
    assert [r.text for r in twice] == [text[1]] * 2


def deduped(spark, docs):
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    return {r.doc_id: r.text for r in L.dedup_lines(df.repartition(3)).collect()}


def test_blocks_go_whose_lines_have_different_first_holders(spark):
    a, b, c, d, e = block("s", 5)
    p = block("p", 4, 10)  # four lines of 13 words, of which the first occurs alone before
    docs = {1: [a, c, e], 2: [b, d], 3: [a, b, c, d, e], 4: [a, b, c, d, e], 5: [p[0], "five"], 6: ["six", *p, "and"], 7: ["seven", *p, "or"]}
    got = deduped(spark, docs)
    assert all(got[i] == "\n".join(docs[i]) for i in (1, 2, 3, 5, 6))
    assert got[4] == "" and got[7] == "seven\nor"


def test_repeated_and_swapped_passages_go(spark):
    x, y = block("x", 4), block("y", 4)  # 60 words each
    docs = {1: ["one", *x, *y, "lone line of the first"], 2: ["two", *x, "between", *x, "lone line of the first", "end"], 3: ["three", *y, *x, "end of three"], 4: ["four", *x, "mid", *x]}
    got = deduped(spark, docs)
    assert got[1] == "\n".join(docs[1])
    assert got[2] == "two\nbetween\nlone line of the first\nend" and got[3] == "three\nend of three" and got[4] == "four\nmid"


def slow_gone(docs, least=40):
    """Lines (of all lines) of each document, in order of docs, that lie in a run of least words which an earlier one holds."""
    lines = [[(i, s) for i, x in enumerate((t or "").split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))] for t in docs]
    out = []
    for d, mine in enumerate(lines):
        gone = set()
        for earlier in lines[:d]:
            places = {}
            for k, (_, x) in enumerate(earlier):
                places.setdefault(x, []).append(k)
            for i, (_, x) in enumerate(mine):
                for k in places.get(x, []):
                    if i and k and mine[i - 1][1] == earlier[k - 1][1]:
                        continue  # within a run that is known
                    n = 0
                    while i + n < len(mine) and k + n < len(earlier) and mine[i + n][1] == earlier[k + n][1]:
                        n += 1
                    if sum(len(y.split()) for _, y in mine[i : i + n]) >= least:
                        gone.update(raw for raw, _ in mine[i : i + n])
        out.append(sorted(gone))
    return out


def test_blocks_go_as_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"line {k} " + " ".join(f"v{k}x{j}" for j in range(rng.integers(0, 25))) for k in range(30)]
    docs = []
    for d in range(60):
        at = rng.integers(0, 24, 3)
        docs.append([x for k in at for x in [*pool[k : k + rng.integers(1, 6)], f"own {d} {k}"]])
    docs += [docs[3], ["", *docs[7]]]
    got = deduped(spark, dict(enumerate(docs)))
    for d, gone in enumerate(slow_gone(["\n".join(x) for x in docs])):
        assert got[d] == "\n".join(x for i, x in enumerate(docs[d]) if i not in set(gone))


def test_alignment_of_pairs_equals_brute_force():
    rng = np.random.default_rng(3)
    for few in (2, 4, 9, 30):
        for _ in range(150):
            a, b = ([f"{k} " + "w " * (k % 5) for k in rng.integers(0, few, rng.integers(1, 40))] for _ in range(2))
            b = [*b, *a[: len(a) // 2], *b[: len(b) // 3]] if rng.random() < 0.5 else b
            pack = lambda x: b"".join(L.xxhash.xxh3_128_digest(y.encode()) for y in x)
            count = lambda x: [len(y.split()) for y in x]
            got = L.aligned_lines(L._lines(pack(b)), count(b), L.Earlier(pack(a), count(a), 12))
            assert sorted(got) == slow_gone(["\n".join(a), "\n".join(b)], 12)[1]


def test_a_copy_of_patchwork_goes_and_lines_beside_blocks_stay(spark, monkeypatch):
    monkeypatch.setattr(L, "DEALT", 3)  # one earlier document with many later ones is dealt out
    parts = block("q", 12)
    docs = {i: [parts[i], f"own {i}"] for i in range(12)} | {20: parts, 21: parts}  # each line of 20 was held alone before
    notices = ["Yes", "Thanks"]
    passage = block("z", 4)
    docs |= {30: ["thirty", *notices], 31: ["more", *notices], 32: [*passage, "of 32"]}
    docs |= {40 + i: [f"begin {i}", *passage, *(notices if i == 0 else []), f"end {i}"] for i in range(20)}  # a passage of many holders
    got = deduped(spark, docs)
    assert got[20] == "\n".join(parts) and got[21] == ""
    assert all(got[40 + i] == "\n".join([f"begin {i}", *(notices if i == 0 else []), f"end {i}"]) for i in range(20))


def test_odd_rows_of_line_dedup(spark):
    long = ["long", *(f"number {k} of a very long text" for k in range(60_000))]
    b = block("n", 4)
    rows = [(None, "\n".join(b)), (None, None), (5, "\n".join(["five", *b])), (5, "\n".join(["other five", *b])), (7, "\n".join(long)), (8, "\n".join(["first", *long[1:], "last"])), (9, "\r\n".join(b)), (9, "\r\n".join(b))]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, removed_lines int")
    got = sorted(((r.doc_id, r.text, len(r.removed_lines)) for r in L.dedup_lines(df).collect()), key=str)
    want = [(None, "\n".join(b), 0), (None, None, 0), (5, "five", 4), (5, "other five", 4), (7, "\n".join(long), 0), (8, "first\nlast", 60_000), (9, "", 4), (9, "", 4)]
    assert got == sorted(want, key=str)


def test_line_dedup_of_a_whole_table_equals_brute_force(spark):
    texts = sorted(whole("documents"))
    rows = {r.doc_id: r for r in L.op9_line_dedup(spark, SF).collect()}
    assert len(rows) == len(texts)
    for (d, t), gone in zip(texts, slow_gone([t for _, t in texts])):
        assert rows[d].removed_lines == ",".join(map(str, gone)) and rows[d].n_removed == len(gone)
        assert rows[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone))


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    words = ["aa", "bbb", "cccc", "dd", "idiot", "e"]
    net = toxicity.Net.new({w: i + 1 for i, w in enumerate(words[:4])}, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grams, own = toxicity.gram_ids(words), np.array([net.vocabulary.get(w, 0) for w in words])
    at, sizes, y, w = rng.integers(0, 6, (3, 5)), np.array([5, 3, 1]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        z = net.logits(net.projected(net.mixed(own, *grams)), at, sizes)
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum()

    g = net.gradients(at, sizes, y, w, grams, own)
    for k in net.p:
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:2]:
            held = flat[i]
            flat[i] = held + 1e-3
            up = loss()
            flat[i] = held - 1e-3
            down = loss()
            flat[i] = held
            assert (up - down) / 2e-3 == pytest.approx(float(grad[i]), abs=3e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        held = {i for s in toxicity.window_starts(n, 64, 48).tolist() for i in range(s, min(s + 64, n))}
        assert held == set(range(n))


def test_toxic_documents_are_found_wherever_they_hide(spark):
    rng = np.random.default_rng(6)
    common = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "se") for b in ("le", "ni", "do") for c in ("s", "n", "r", "ma")]
    bad = ["grumph", "skrell", "vorzak"]

    def text(n, toxic):
        words = rng.choice(common, n).tolist()
        for _ in range(2 * toxic):
            words[int(rng.integers(0, n))] = str(rng.choice(bad))
        return " ".join(words)

    rows = [(i, text(int(rng.integers(20, 300)), i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    hidden = " ".join(rng.choice(common, 9000)) + " grumph vorzak " + " ".join(rng.choice(common, 9000))
    odd = [(1001, None), (1002, ""), (1003, "..."), (1004, hidden), (1005, " ".join(rng.choice(common, 18000))), (1006, "grumph"), (1004, hidden)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(*o, 0.5) for o in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[0][0], rows[0][2]), (None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    test = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([p == y for p, y in test]) > 0.95
    assert by[1004].predicted == 1 and by[1005].predicted == 0
    assert by[1001].score == by[1002].score == by[1003].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_toxicity(docs, labels.limit(0)).filter("predicted = 1").count()
    assert none == 0


def slow_score(net, text, window=64, stride=48):
    """The greatest score of all windows, number by number."""
    import math

    low = unicodedata.normalize("NFKC", text).lower()
    words = ["".join(g) for inside, g in itertools.groupby(low, str.isalnum) if inside]
    if not words:
        return 0.0
    p, h = {k: v.astype(float).tolist() for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def vector(w):
        flat, _, _ = toxicity.gram_ids([w])
        rows = [p["Ec"][i] for i in flat.tolist()]
        chars = [max(r[0] for r in rows)] + [sum(r[k] for r in rows) / len(rows) for k in range(1, toxicity.CHAR_DIM)]
        own = p["Ew"][net.vocabulary[w]] if w in net.vocabulary else [0.0] * toxicity.WORD_DIM
        return own + chars

    def direction(side, xs):
        state, out = [0.0] * h, []
        for x in xs:
            gate = [b + sum(x[i] * p["W"][side][i][k] for i in range(len(x))) for k, b in enumerate(p["b"][side])]
            back = [sum(state[i] * p["U"][side][i][k] for i in range(h)) for k in range(3 * h)]
            z = [sigmoid(gate[k] + back[k]) for k in range(h)]
            r = [sigmoid(gate[h + k] + back[h + k]) for k in range(h)]
            new = [math.tanh(gate[2 * h + k] + r[k] * back[2 * h + k]) for k in range(h)]
            state = [z[k] * state[k] + (1 - z[k]) * new[k] for k in range(h)]
            out.append(state)
        return out

    best = -math.inf
    for s in range(0, max(len(words) - window, 0) + stride, stride):
        s = min(s, max(len(words) - window, 0))
        xs = [vector(w) for w in words[s : s + window]]
        states = [a + b for a, b in zip(direction(0, xs), direction(1, xs[::-1])[::-1])]
        energy = [sum(p["v"][k] * math.tanh(p["a"][k] + sum(st[i] * p["A"][i][k] for i in range(2 * h))) for k in range(toxicity.ATTENTION)) for st in states]
        weight = [math.exp(e - max(energy)) for e in energy]
        context = [sum(w * st[i] for w, st in zip(weight, states)) / sum(weight) for i in range(2 * h)]
        best = max(best, p["c"][0] + sum(c * o for c, o in zip(context, p["o"])))
    return sigmoid(best)


def test_scores_equal_a_slow_forward_pass():
    rng = np.random.default_rng(3)
    names = [f"{a}{b}" for a in ("ta", "ri", "mo", "se", "vé", "ш") for b in ("les", "ni", "dor", "x")]
    docs = [([" ".join(rng.choice(names, 40)) + (" grumph" if k % 3 == 0 else "")], int(k % 3 == 0)) for k in range(60)]
    net = toxicity.train(docs, epochs=2, least_steps=8)
    texts = ["", "...", "grumph", " ".join(rng.choice(names, 64)), " ".join(rng.choice(names, 65)), " ".join(rng.choice(names, 150)) + " Grumph!", "ＧＲＵＭＰＨ wide", "𝐠𝐫𝐮𝐦𝐩𝐡 𐐷𐐯 bold", "a" * 300]
    cache = toxicity.WordCache(net.learn, np.float32, 1000, 1000 * 6 * toxicity.HIDDEN)
    for part in (texts, texts[::-1], texts[3:5]):
        got = toxicity.score_batch(net, cache, part, 64, 48)
        assert got.tolist() == pytest.approx([slow_score(net, t) for t in part], abs=2e-4)


def test_letters_of_any_plane_are_read(spark):
    hidden, plain = "𝐠𝐫𝐮𝐦𝐩𝐡 𝐬𝐤𝐫𝐞𝐥𝐥", "grumph skrell"
    assert toxicity.folded(hidden) == plain
    starts, ends = toxicity.word_places(toxicity.code_points("a 𐐷𐐯 b"), np.array([0, 6]))
    assert list(zip(starts, ends)) == [(0, 1), (2, 4), (5, 6)]


def test_long_labelled_texts_teach_with_all_their_windows(spark):
    """The only sign of label 1 stands late in texts of hundreds of windows; clashing columns are replaced."""
    rng = np.random.default_rng(8)
    names = [f"{a}{b}{c}" for a in ("ta", "ri", "mo") for b in ("le", "ni", "do") for c in ("s", "n", "r", "ma")]
    rows = []
    for k in range(300):
        words = rng.choice(names, 3000 if k % 2 else 60).tolist()
        if k % 4 == 1:
            words[2850] = words[2852] = "vorzak"
        rows.append((k, " ".join(words), int(k % 4 == 1), "x", 1.0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, predicted string, held_out double")
    got = toxicity.score_toxicity(df, df.select("doc_id", "toxic")).collect()
    assert len(got) == 300 and set(got[0].asDict()) == {"doc_id", "text", "toxic", "predicted", "held_out", "score"}
    assert np.mean([r.predicted == r.toxic for r in got if r.held_out]) > 0.9
