"""Removal of repeated byte strings against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trajlens.llm import repeats


def plain(texts, length=200):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone, upto = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                for p in range(max(i, upto), i + length):
                    gone[p] = 1
                upto = i + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def awkward():
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefgh é\n") for _ in range(3000))
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "x" * 5000, base[:500], base[100:900], base[:1000] + "Q" + base[1000:2000], "ab" * 300 + "c", "c" + "ab" * 400]
    for _ in range(120):
        t = ""
        for _ in range(rnd.randint(1, 6)):
            a = rnd.randrange(2800)
            t += base[a : a + rnd.choice([50, 150, 190, 199, 200, 201, 230, 400, 800])] + rnd.choice(["", "", "zz", str(rnd.random())])
        texts.append(t)
    return texts + [texts[30]] * 3


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(df).collect()}


@pytest.mark.parametrize("limit,bucket,piece", [(2048, 4096, 1 << 18), (3, 8, 1 << 18), (2048, 4096, 700)])
def test_equals_a_count_of_all_windows(spark, monkeypatch, limit, bucket, piece):
    """Also with so few contexts a task that triggers are lengthened again and again, and with texts cut into pieces."""
    monkeypatch.setattr(repeats, "LIMIT", limit)
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "PIECE", piece)  # tasks import the module anew; contexts() below shows that pieces don't matter
    levels, split = [], repeats._halved
    monkeypatch.setattr(repeats, "_halved", lambda rows, level, *a: levels.append(level) or split(rows, level, *a))
    texts = awkward()
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert (len(levels) >= 3) == (limit == 3)


def test_pieces_have_the_triggers_of_whole_texts(monkeypatch):
    text = "".join(random.Random(2).choices("abc d", k=5000)).encode()
    at = lambda: {(w, int(t)) for _, a, b, t_, _ in repeats.contexts([b"short", text, b"z" * 300]) for x, y, t in zip(a, b, t_) for w in range(x, y)}
    whole = at()
    monkeypatch.setattr(repeats, "PIECE", 333)
    assert at() == whole and len({w for w, _ in whole}) == 4801


def test_suffix_ranks_order_all_phrase_suffixes():
    rnd = random.Random(3)
    phrases = sorted({bytes(rnd.choices(b"ab\x00\xff", k=rnd.randint(1, 40))) for _ in range(60)})
    ranks, begins = repeats.suffix_ranks(phrases)
    every = [(int(ranks[b + k]), p[k:]) for p, b in zip(phrases, begins) for k in range(len(p))]
    order = {s: i for i, s in enumerate(sorted({s for _, s in every}))}
    assert [order[s] for _, s in every] == list(np.unique([r for r, _ in every], return_inverse=True)[1])


def test_hot_passage_between_texts_of_their_own(spark, monkeypatch):
    """A passage that stands in every text, each time with other neighbours, never makes one task of all of them."""
    monkeypatch.setattr(repeats, "LIMIT", 20)
    monkeypatch.setattr(repeats, "BUCKET", 40)
    rnd, sizes, order = random.Random(4), [], repeats.resolved
    monkeypatch.setattr(repeats, "resolved", lambda rows, *a: sizes.append(rows.groupBy("key").count().agg({"count": "max"}).first()[0]) or order(rows, *a))
    own = lambda k: "".join(rnd.choices("abcdefgh ijklm", k=k))
    passage = own(260)
    texts = [own(300) + passage + own(300) for _ in range(300)]
    got = found(spark, texts)
    assert [got[i] for i in range(300)] == plain(texts)
    assert len(sizes) > 1 and max(s for s in sizes if s) <= 20


def test_texts_and_other_columns(spark):
    a = "".join(random.Random(5).choices("abcdefgh", k=400))
    rows = [(1, "é" + a[:300], "k", "s"), (None, a, "k", "s"), (1, "é" + a[:300], "k", "s"), (2, None, None, "s"), (3, "short", "k", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, sha string")
    out = repeats.remove_repeats(df)
    assert out.columns == [*df.columns, "removed_spans", "kept"]
    by = sorted(((r.doc_id, r.text, r.key, r.sha, [tuple(s) for s in r.removed_spans], bytes(r.kept)) for r in out.collect()), key=repr)
    assert len(by) == 5 and {x[:2]: x[4:] for x in by} == {(1, "é" + a[:300]): ([(0, 302)], b""), (None, a): ([(0, 300)], a[300:].encode()), (2, None): ([], b""), (3, "short"): ([], b"short")}
    assert repeats.remove_repeats(df.where("false")).collect() == [] and repeats.digests(df.where("false")).collect() == []
    assert repeats.digests(df.where("text = 'short'")).collect()[0].n_removed == 0


def test_long_and_repetitive_text_is_linear(spark):
    import time

    text = "".join(random.Random(6).choices("abcdefgh", k=400_000))
    began = time.time()
    got = found(spark, [text + text[:1000], "z" * 3_000_000, "short"])
    assert got[0][1] == 2000 and got[1][1] == 3_000_000 and got[2][1] == 0
    assert time.time() - began < 60


def test_contexts_of_many_texts_travel_in_few_batches(spark, monkeypatch):
    rnd = random.Random(11)
    passage = "".join(rnd.choices("abcdefgh ", k=400))
    texts = ["".join(rnd.choices("abcdefgh ", k=300)) + passage + "".join(rnd.choices("abcdefgh ", k=300)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    kinds, said = [], repeats.mixed_contexts
    monkeypatch.setattr(repeats, "mixed_contexts", lambda rows, length: kinds.append(said(rows, length)._jdf.queryExecution().executedPlan().toString()) or said(rows, length))
    got = repeats.digests(df).collect()
    assert len(got) == 300 and all(r.n_removed >= 400 for r in got)
    assert "MapInArrow" in kinds[0] and "MapInPandas" not in kinds[0].split("MapInArrow")[0]
    body = [t.encode() for t in texts]
    rows = pa.table({"body": pa.array(body), "open": [[{"start": 0, "stop": 5, "trigger": 80, "key": 7}, {"start": 9, "stop": 11, "trigger": 99, "key": 8}]] * 300})
    found = list(repeats._opened(iter(rows.to_batches()), repeats.LENGTH, 16))
    assert len(found) == 1 and found[0][2][:2] == [body[0][:204], body[0][9:210]]
    assert found[0][1].tolist() == [i for i in range(300) for _ in range(2)] and found[0][5].tolist() == [80, 90] * 300
