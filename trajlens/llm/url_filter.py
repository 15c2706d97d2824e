"""URL filter: path rules first, then a logistic regression on hashed character n-grams of host and path.

The regression is trained here on a small labelled table of (host, path, block) rows; ``SEED_URLS`` is the default, made
of general words by a rule, and ``MAX_LABELLED`` bounds what a caller may pass (the bounded labelled sample on which the classifier is fitted). Its
weights, 2**HASH_BITS doubles, go to the tasks once; urls are judged in Arrow batches and nothing is shuffled.

Rules: a rule ``host/path`` fits a url whose host is the rule's or one of its subdomains and whose path starts with the
rule's path; the longest rule wins and decides; where none fits, the regression does (block at ``THRESHOLD`` or more).

Cases: host and path of a null url, or of one without "://", are empty; such a url fits no rule and is allowed (no
evidence). Null ids, repeated rows and very long urls are judged like any other; extra columns are not returned; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
HASH_BITS, NGRAMS, THRESHOLD, MAX_LABELLED, SLICE = 16, (3, 4, 5), 0.5, 10_000, 512

#: Words that the labelled hosts are made of. Tails, top domains and paths say nothing: most are in both classes.
BAD_WORDS = "adult ads bets bonus casino cheap click crack escort followers free keygen loans lottery pills poker porn prize replica slots spam torrent tracker viagra warez webcam winner xxx".split()
GOOD_WORDS = "archive astronomy books chess choir city council cycling garden gallery history hospital journal kitchen law library maths museum music news nature orchestra physics poetry railway recipes school science theatre travel university weather".split()
TAILS = "best center club deals farm guide house hub now online pro review shop site today win world zone".split()
_TLDS = ("example.com", "example.net", "example.org")
_PATHS = ("/en/12", "/en/960", "/fr/88", "/de/431", "/es/7.html", "")
PREFIXES = ("", "www.", "blog.", "m.")
SYLLABLES = "an ber cor del en fis gal hor in jun kel lor men nar or pel quin ros sel tan ur vel wes yor zan".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """The small labelled table by rule: each word with four tails, and names of invented words, which are no evidence and allowed."""
    rows = []
    for y, words in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for i, word in enumerate(words):
            rows += [(f"{PREFIXES[(i + j) % 4]}{word}-{TAILS[(5 * i + 7 * j) % len(TAILS)]}.{_TLDS[(i + j) % 3]}", _PATHS[(i + 2 * j) % len(_PATHS)], y) for j in range(4)]
    for i in range(150):
        name = "".join(SYLLABLES[(7 * i + 11 * j * (i + 1) + i // 25) % len(SYLLABLES)] for j in range(2 + i % 3))
        rows.append((f"{PREFIXES[i % 4]}{name}.{_TLDS[i % 3]}", _PATHS[i % len(_PATHS)], 0))
    return rows


SEED_URLS = labelled_urls()


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.char_length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # longer rules later: they override
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def ngram_rows(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every n-gram of every key, by a polynomial hash over a batch's bytes at once."""
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    data = np.frombuffer(b"".join(keys), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(keys)), sizes)
    feats, rows = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + data[j : len(data) - n + 1 + j] + np.uint64(1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        inside = row[: len(h)] == row[n - 1 :]
        feats.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int64)[inside])
        rows.append(row[: len(h)][inside])
    if not feats:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(feats), np.concatenate(rows)


def url_key(host: str, path: str) -> bytes:
    return f"^{host}{path}$".encode()


def train(labelled: Sequence[tuple[str, str, int]] = SEED_URLS, steps: int = 1500, rate: float = 8.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent on the log loss; features are n-gram counts over the row's n-grams."""
    if not 0 < len(labelled) <= MAX_LABELLED:
        raise ValueError(f"the labelled table must have 1 to {MAX_LABELLED} rows")
    feats, rows = ngram_rows([url_key(h, p) for h, p, _ in labelled])
    y = np.array([b for _, _, b in labelled], dtype=float)
    value = 1 / np.sqrt(np.bincount(rows, minlength=len(y)).clip(1))[rows]
    w, b = np.zeros(1 << HASH_BITS), 0.0
    for _ in range(steps):
        z = np.bincount(rows, weights=w[feats] * value, minlength=len(y)) + b
        error = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(feats, weights=error[rows] * value, minlength=len(w)) / len(y) + l2 * w)
        b -= rate * error.mean()
    return w, b


def predict(keys: Sequence[bytes], w: np.ndarray, b: float) -> np.ndarray:
    feats, rows = ngram_rows(keys)
    n = np.bincount(rows, minlength=len(keys)).clip(1)
    return 1 / (1 + np.exp(-(np.bincount(rows, weights=w[feats], minlength=len(keys)) / np.sqrt(n) + b)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] = SEED_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    df = df.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_v"))
    w, b = train(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            keys = [url_key(h, x) for h, x in zip(hosts, paths)]
            p = np.concatenate([np.zeros(0), *(predict(keys[k : k + SLICE], w, b) for k in range(0, len(keys), SLICE))])
            p = np.where([not h and not x for h, x in zip(hosts, paths)], 0.0, p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "block_score"])

    scored = df.mapInArrow(score, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, _v string, block_score double")
    verdict = F.coalesce("_v", F.when(F.col("block_score") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
