import collections
import re

import pytest

from lumenrv.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, rank int"


def slow(rows, least=3, top=200):
    """By the contract's words, with dictionaries."""
    docs = [("" if t is None else t, "" if a is None else a, "" if s is None else s) for _, t, a, s, *_ in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    held, count, groups = collections.Counter(), collections.Counter(), sorted({(a, s) for _, a, s in docs})
    for t, a, s in docs:
        held.update({(a, w) for w in terms(t)})
        count.update((a, s, w) for w in terms(t))
    out = set()
    for a in {a for a, _ in groups}:
        kept = sorted(w for (b, w), n in held.items() if b == a and n >= least)
        sources = [s for b, s in groups if b == a]
        own = {s: {w: count[a, s, w] for w in kept} for s in sources}
        total = {w: sum(own[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (own[s][w] + 1) // (sum(own[s].values()) + len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (total[w] + 1) // (sum(total.values()) + len(kept)) for w in kept}
        for s in sources:
            pair = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            term = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(a, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


CASES = {
    "nulls and ties": [(1, "a b c a", "en", "x"), (2, None, "en", "x"), (3, "A b d", "en", None), (4, "a B", None, None), (5, "a b É é Éa", "en", "y"), (6, "É é b", "en", "y"), (7, "éa É", "en", "z"), (None, "é", "en", "z")],
    "no kept term": [(1, "one two", "en", "x"), (2, "three", "en", "y"), (3, "12 34", "fr", "x"), (4, "", "de", "x"), (5, None, "de", "y")],
    "repeated rows": [(1, "word Word wörd 1x2", "en", "x")] * 4 + [(2, "word x", "en", "y")] * 3,
    "very long and odd": [(1, "ab " * 40_000 + "K ſ Iİ", "en", "x"), (2, "z" * 100_000 + " ab K", "en", "y"), (3, "\x00ab\x7fcd😀 K ab", "en", "w"), (4, "日本 日本 ab ſ", "en", "x"), (5, "日本 ſ", "en", "y"), (6, "日本 😀 ſ", "en", "v")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_the_contract_word_by_word(spark, name):
    """Columns named like the operator's own are no matter."""
    rows = [(*r, 7, "t", 1) for r in CASES[name]]
    got = S.source_divergence(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(slow(rows))


def test_only_the_ranks_of_terms_end(spark):
    rows = [(i, " ".join(f"w{'abcdefghij'[i % 10]}{chr(97 + k)}" for k in range(26)), "en", f"s{i % 10}") for i in range(40)]
    rows = [(*r, 1, "", 1) for r in rows]
    got = {tuple(r) for r in S.source_divergence(spark.createDataFrame(rows, SCHEMA), top=5).collect()}
    assert got == slow(rows, top=5) and max(r[5] for r in got if r[2] == "pair") == 9


def test_shares_of_large_counts_are_exact(spark):
    big = [(9_000_000_000_000_000_000, 9_100_000_000_000_000_001), (0, 1), (12_345_678_901_234, 98_765_432_109_876_543)]
    df = spark.createDataFrame(big, "n long, total long").select(S.share(S.F.col("n"), S.F.col("total")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (n + 1) // t for n, t in big]
