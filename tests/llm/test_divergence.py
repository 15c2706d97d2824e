"""Source divergence against the contract's SQL and a plain count, with blocks of every size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from trajlens.llm import divergence

WORDS = "the cat Sat on MAT été naïve 日本 it's x9y Ünder a_b and or not".split()


def plain(rows, least, top):
    use, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        use[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in held[lang].items() if k >= least]
        v = len(kept)
        give = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * v) for t in kept}
        p = give(use[lang, source])
        fellow = [((lang, s)) for g, s in groups if g == lang and s != source]
        found = sorted(((-sum(abs(p[t] - q[t]) for t in kept), s.encode()) for _, s in fellow for q in [give(use[lang, s])]))
        out |= {(lang, source, "pair", s.decode(), -f, r) for r, (f, s) in enumerate(found, 1)}
        every = Counter()
        for g in groups:
            if g[0] == lang:
                every.update(use[g])
        q = give(every)
        found = sorted((q[t] - p[t], t.encode()) for t in kept if use[lang, source][t] and p[t] > q[t])[:top]
        out |= {(lang, source, "term", t.decode(), -f, r) for r, (f, t) in enumerate(found, 1)}
    return out


def awkward():
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 30))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", "ä", None, "d"])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (None, "", "xx", "lone"), (2, "!!! 123", "yy", "p"), (2, "the", "yy", "q")] + [(5, "the the cat", "en", "a")] * 40 + [(9, "Long " * 50_000, "fr", "a")]
    return rows


@pytest.mark.parametrize("groups,terms,tokens,entries", [(32, 8192, 200_000, 400_000), (2, 3, 50, 20)])
def test_equals_plain_counts(spark, monkeypatch, groups, terms, tokens, entries):
    for name, value in (("GROUPS", groups), ("TERMS", terms), ("TOKENS", tokens), ("ENTRIES", entries)):
        monkeypatch.setattr(divergence, name, value)
    rows = awkward()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int")
    got = divergence.audit(df, least=10, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == plain(rows, 10, 4)


def test_empty_table_and_no_kept_terms(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "t")], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df.where("false")).collect() == []
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_portions_are_exact_beyond_a_long(spark):
    df = spark.createDataFrame([(8 * 10**17, 9 * 10**18, 3), (0, 0, 0)], "n long, total long, kept long")
    n = divergence.portion(df["n"], df["total"], df["kept"])
    assert [r[0] for r in df.select(n).collect()] == [1 + 10**9 * (8 * 10**17 + 5) // (9 * 10**18 + 15), None]


def test_cells_hold_bounded_slices(spark, monkeypatch):
    """However many sources and terms a language has, no cell gets more than its blocks."""
    monkeypatch.setattr(divergence, "GROUPS", 4)
    monkeypatch.setattr(divergence, "TERMS", 16)
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"), "en", f"s{i % 40}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    u = divergence.Usage(df, least=2)
    assert u.groups.groupBy("g").count().agg({"count": "max"}).first()[0] <= 12
    assert u.terms.groupBy("t").count().agg({"count": "max"}).first()[0] <= 40
    assert divergence.audit(df, least=2).where("part = 'pair'").count() == 40 * 39
