"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajlens.llm import license_scan, lm_score, mixing, near_dups, pii, quality_classifier, quality_rules, sentencepiece, topk, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, _t string, c long, size long, h string, v string, key string"
TEXT = "the cat and the dog are in the house with a very long story about it and on it went for days. " * 3
ROWS = [(1, TEXT, "en", "a", 9), (2, None, "en", None, None), (None, "", None, "a", 0), (None, TEXT, "xx", "b", 9), (3, "  \n\t ", "en", "b", 3), (4, "x" * 200_000, "en", "a", 1), (5, "w " * 50_000, "en", "c", 1), (1, TEXT, "en", "a", 9), (6, "Mail a.b1@mail1.example now", "en", "c", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "t", 1, 2, "h", "v", "y") for r in ROWS], SCHEMA)


def operators():
    m = lambda s: sentencepiece.read_model(s)
    return {
        "op1": lambda s, d: sentencepiece.encode(d, m(s)),
        "op2": lambda s, d: pii.replace_entities(d, "a key"),
        "op4": lambda s, d: license_scan.scan_licenses(d),
        "op5": lambda s, d: lm_score.score(d, lm_score.held_out(d["doc_id"])),
        "op6": lambda s, d: near_dups.near_duplicates(d),
        "op7": lambda s, d: quality_classifier.classify(d),
        "op9": lambda s, d: mixing.mixed(d),
        "op10": lambda s, d: quality_rules.judge(d),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_rows_in_are_rows_out(spark, docs, name):
    found = operators()[name](spark, docs).collect()
    assert len(found) == len(ROWS)
    by = [r for r in found if r["doc_id"] == 1]
    assert len(by) == 2 and repr(by[0]) == repr(by[1])


@pytest.mark.parametrize("name", sorted(operators()))
def test_empty_table(spark, docs, name):
    assert operators()[name](spark, docs.where("false")).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_take_anything(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "/nowhere")
    assert (out.columns == docs.columns) == (k < 4)
    out.collect()
    assert stage(spark, docs.where("false"), "/nowhere").collect() == []


def _internal_names():
    """Every column name that the modules of the operators use, as strings in their sources."""
    import inspect
    import re

    names = set()
    for module in (quality_rules, pii, mixing, near_dups, sentencepiece, lm_score, quality_classifier, license_scan):
        names |= set(re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]{0,16})["']""", inspect.getsource(module)))
    return sorted(n for n in {x.lower() for x in names} if n not in ("doc_id", "text", "lang", "source", "n_chars"))


def test_clashing_columns_keep_their_values(spark):
    """A caller's columns with the names of an operator's own come back with their values, from every stage."""
    names = _internal_names()
    assert len(names) > 60
    rng = random.Random(9)
    new = lambda: "".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(3, 8)))
    good = lambda: " ".join(f"{rng.choice(['the', 'and', 'of', 'to', 'in', 'is', 'it', 'on', 'with', 'for'])} {new()} {new()}" for _ in range(60)) + " mail a@b.example."
    rows = [(i, good(), "en", "s", 7, *[f"{n}-{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, "/nowhere")
        assert out.columns == df.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in names), name
    assert {r.row for r in quality_rules.keep_good(df).collect()} <= {f"row-{i}" for i in range(3)}
    for name, run in operators().items():
        assert len(run(spark, df).collect()) == 3, name


def test_languages_without_word_lists_are_kept(spark):
    """Clean text in another script is compared with its own language's characters; no language leaves the base rules."""
    rng = random.Random(2)
    cyrillic = [" ".join("".join(rng.choice("абвгдежзиклмнопрстуя") for _ in range(rng.randint(2, 9))) for _ in range(120)) + "." for _ in range(30)]
    english = [" ".join(rng.choice("the cat and of is to was on it for house dog run".split()) + (" x%d" % rng.randint(0, 999) if k % 3 else "") for k in range(120)) for _ in range(60)]
    rows = [(i, t, "ru") for i, t in enumerate(cyrillic)] + [(100 + i, t, "en") for i, t in enumerate(english)] + [(200, cyrillic[0], None), (201, "#$% " * 60, "en")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept and got[i].word_distance is None for i in range(30))
    assert got[200].kept and got[200].class_distance is None and not got[201].kept


def _english(rng, n):
    return [" ".join(rng.choice("the cat and of is to was on it for house dog run".split()) + (" x%d" % rng.randint(0, 999) if k % 3 else "") for k in range(140)) for _ in range(n)]


def test_odd_documents_make_no_reference(spark):
    """A page of symbols is judged by the clean texts of its language, whatever single page has a language code of its own."""
    rng = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate(_english(rng, 40))] + [(100, " ".join("#$%&" for _ in range(60 + 20 * (k % 2))) + " " + " ".join(f"<{k}{j}>" for j in range(90)), "en") for k in range(1)]
    alone = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = {r.doc_id: r.class_distance for r in quality_rules.judge(alone).collect()}
    odd = [(200 + k, " ".join(f"<{k}#{j}>" for j in range(90)), "zz") for k in range(19)]
    both = {r.doc_id: r for r in quality_rules.judge(alone.unionByName(spark.createDataFrame(odd, alone.schema))).collect()}
    assert first[100] > quality_rules.MAX_CLASS_DISTANCE and both[100].class_distance == pytest.approx(first[100]) and not both[100].kept
    assert all(both[i].kept for i in range(40)) and both[200].class_distance is None


def test_any_number_of_languages(spark):
    import time

    rng = random.Random(4)
    pairs = _english(rng, 40)
    texts = [f"{x} {y}" for x, y in zip(pairs[::2], pairs[1::2])]
    df = spark.range(1100 * 20).selectExpr("concat('l', cast(id div 20 as string)) as lang", "cast(id % 20 as int) as i").join(F.broadcast(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), "i").selectExpr("cast(i as long) as doc_id", "text", "lang")
    df = df.unionByName(spark.createDataFrame([(-1, "# $ % & " * 5 + "<>" * 400 + " " + " ".join(f"q{k}" for k in range(40)), "l7")], df.schema))
    began = time.time()
    got = quality_rules.judge(df).where("doc_id = -1").collect()
    assert got[0].class_distance > quality_rules.MAX_CLASS_DISTANCE and not got[0].kept and time.time() - began < 120


def test_quality_values(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect() if r.doc_id}
    assert got[2].n_words == 0 and got[2].base_failed and got[5].n_repeat_words == 50_000
    assert got[1].n_repeat_words == got[1].n_words


def test_near_dup_values(spark, docs):
    got = near_dups.near_duplicates(docs).collect()
    same = [r for r in got if r.rk and r.n_shingles > 10]
    assert {r.component_id for r in same} == {1}
    blank = [r for r in got if r.n_shingles == 0]
    assert sorted(str(r.component_id) for r in blank) == ["2", "3", "None"]
    kept = near_dups.keep_one(docs).collect()
    assert sum(r.text == TEXT for r in kept) == 1 and len(kept) == 3 + 1 + 3


def test_license_values(spark, docs):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == ""


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [1.0, None], 1), (5, [2.0, 0.0], 1), (None, [3.0, 3.0], 1), (6, [1.0], 1), (7, [1e300, 0.0], 1), (8, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = topk.top_k(df, df["vec_id"] == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 5, 1] and got[1].score == 512 * 256
    assert topk.top_k(df.where("false"), df["vec_id"] == 0, 3).collect() == []


def test_url_edges(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "no scheme", None, "://", "https://example.org", "http://x.com/fr/1", "http://com/de/2", "http://xcom/fr/", "ftp://a.example.org/en/12", "http://example.org/en/2#://x"]
    df = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (1, 2, 3))
    assert (got[4].host, got[4].path, got[4].rule) == ("example.org", "", None)
    assert (got[5].rule, got[5].verdict, got[6].rule, got[6].verdict, got[7].rule) == ("com/fr/", "allow", "com/de/", "block", None)
    assert (got[8].rule, got[8].verdict, got[9].rule, got[9].path) == ("example.org/en/1", "block", "org/", "/en/2")
    assert url_filter.judge(df.where("false")).collect() == []


def test_many_names_in_one_text(spark):
    """Names are looked up, not tried one by one; what follows an apostrophe stays, and words that only begin like a name do too."""
    import time

    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcdefghijklmnop", k=8)).capitalize() for _ in range(6000)})
    text = " and ".join(f"Mr {x} saw {rng.choice(names)}" for x in names)
    began = time.time()
    out = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first().text
    assert time.time() - began < 90
    old, new = text.split(" "), out.split(" ")
    mapping = {}
    for a, b in zip(old, new):
        assert mapping.setdefault(a, b) == b and (a == b) == (a in ("Mr", "saw", "and"))
    assert len(set(mapping.values())) == len(mapping)
    t = "Dr. Ada Lind met Ms. O'Neil. Then ADA and Lind's friend O'Neil's, 'Ada', Lind-Berg and Adam came."
    got = pii.replace_entities(spark.createDataFrame([(1, t)], "doc_id long, text string"), "k").first().text
    ada, lind, neil = got.split()[1], got.split()[2], got.split()[5].rstrip(".")
    assert got == f"Dr. {ada} {lind} met Ms. {neil}. Then {ada.upper()} and {lind}'s friend {neil}'s, 'Ada', Lind-Berg and Adam came."


def test_no_key_is_an_error(spark):
    with pytest.raises(ValueError):
        pii.session_key(spark)
    assert pii.session_key(spark, "mine") == "mine"
