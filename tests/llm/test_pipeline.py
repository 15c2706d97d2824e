"""Every stage of the pipeline against plain code on what its predecessor wrote, and run() against the stages."""

import re
from collections import Counter

import duckdb
import pytest
import sentencepiece as library

import corpus_pipeline
from trajlens.llm import pii, sentencepiece
from trajlens.llm.common import read
from trajlens.llm.sql import QUALITY_RULES_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The documents and what each stage made of them, through Parquet as in run()."""
    d = tmp_path_factory.mktemp("stages")
    docs = read(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(d / str(k)))
        out.append(spark.read.parquet(str(d / str(k))))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_quality_stage(written):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({QUALITY_RULES_SQL}) WHERE kept").fetchall()}
    assert written[1] and sorted(map(repr, written[1])) == sorted(repr(r) for r in written[0] if r["doc_id"] in good)


def test_near_duplicate_stage(written):
    rows = written[1]
    sets = []
    for r in rows:
        w = re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}).strip(" \t\n\x0b\x0c\r"))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i]["doc_id"])
    assert len(groups) < len(rows)
    assert sorted(r["doc_id"] for r in written[2]) == sorted(min(g) for g in groups.values())
    whole = {repr(r) for r in rows}
    assert all(repr(r) in whole for r in written[2])


def test_surrogate_stage(written):
    before, after = ({r["doc_id"]: r for r in rows} for rows in written[2:4])
    assert before.keys() == after.keys()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    mapping, n = {}, 0
    for i, r in before.items():
        mine = after[i]
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in mine.items() if k not in ("text", "n_chars")} and mine["n_chars"] == len(mine["text"])
        old, new = email.findall(r["text"]), email.findall(mine["text"])
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert mapping.setdefault(a.lower(), b.lower()) == b.lower() and a != b
            n += 1
        if not (set("0123456789@=:") & set(r["text"])) and "." in r["text"] and r["text"] != mine["text"]:
            assert re.search(pii._ANY, r["text"])
    assert n and len(set(mapping.values())) == len(mapping)


def test_mixing_stage(written):
    size = lambda r: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
    times = Counter(repr(r) for r in written[4])
    per = {}
    for r in written[3]:
        s = per.setdefault(r["source"], [0, 0, 0])
        s[0] += size(r)
        s[1] += size(r) * times[repr(r)]
        s[2] = max(s[2], size(r))
    assert set(times) <= {repr(r) for r in written[3]} and max(times.values()) <= 3
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(s[0] for s in per.values())
    while True:
        left, share = total - sum(3 * per[s][0] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * per[s][0] if s in capped else left * weight[s] / share for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * per[s][0]}
        if not above:
            break
        capped |= above
    assert all(abs(per[s][1] - target[s]) <= per[s][2] for s in order)


def test_token_stage_and_run(spark, written):
    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL_PATH)
    want = sorted((r["doc_id"], tuple(sp.encode(r["text"] or "")), (r["text"] or "").replace("▁", " ")) for r in written[4])
    assert sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in written[5]) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in written[5])
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, SF).collect()) == want
