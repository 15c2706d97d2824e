"""Quality classifier: a weak-label model, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every whole document. Votes are counted by pattern over
all documents (at most 3**labellers patterns, so few rows reach the driver), and expectation-maximisation on the counts
estimates the share of good documents and each labeller's accuracy, that is how it votes on good and on bad ones. The
posteriors of ``TRAIN_ROWS`` documents (the bounded sample: the smallest row hashes) train a logistic regression on
hashed byte trigrams, and the regression scores every document.

Cases: a null text is empty; a text without bytes has score equal to its posterior (it has no features). Null ids,
repeated rows and extra columns are no matter (doc_id and text are read); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

HASH_BITS, TRAIN_ROWS, EM_STEPS, THRESHOLD = 16, 3000, 60, 0.5
#: Frequent function words of several languages, and insults.
FUNCTION_WORDS = frozenset("and are as be by for from in is it of on that the this to was with auf das dem den der des die ein eine ist im mit nicht sich und von zu al con de del el en es la las lo los no por que se su un y dans du est et le les par pas pour qui sur une".split())
INSULTS = re.compile(rb"\b(?:idiots?|morons?|stupid|worthless|pathetic|clowns?|losers?|scum|imbecile|dumbass|shut up)\b")
SYMBOLS = bytes(b"#$%&*|<>{}=\\^~@")
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
ENDS = (b".", b"!", b"?", b'"', b":", b";", b")")
LABELLERS = ("length", "symbols", "shouting", "repetition", "lines", "function_words", "endings", "insults")
GOOD, BAD, NONE = 2, 0, 1


def _vote(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(text: bytes) -> list[int]:
    """One vote a labeller, in the order of ``LABELLERS``."""
    words, n = text.split(), len(text)
    k = len(words)
    if not k:
        return [BAD] + [NONE] * (len(LABELLERS) - 1)
    low = text.lower()
    symbols = (n - len(text.translate(None, SYMBOLS))) / n
    letters = n - len(text.translate(None, LETTERS))
    shouting = (n - len(text.translate(None, UPPER))) / letters if letters else 0.0
    triples = set(zip(words, words[1:], words[2:]))
    fresh = len(triples) / (k - 2) if k > 2 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    function = sum(w in _FUNCTION for w in low.split()) / k
    ended = sum(x.rstrip().endswith(ENDS) for x in lines) / len(lines)
    return [
        _vote(k, k < 20, k >= 50),
        _vote(symbols, symbols > 0.03, symbols < 0.005),
        _vote(shouting, shouting > 0.3, shouting < 0.1),
        _vote(fresh, fresh < 0.7, fresh > 0.95),
        _vote(repeated, repeated > 0.2, False),
        _vote(function, function < 0.05, function > 0.1),
        _vote(ended, ended < 0.2, ended > 0.6),
        _vote(0, INSULTS.search(low) is not None, False),
    ]


_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)


def pattern_of(text: bytes) -> int:
    code = 0
    for v in votes(text):
        code = code * 3 + v
    return code


def digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - i) % 3 for i in range(len(LABELLERS))], axis=1)


class WeakLabels:
    """Votes explained by two hidden classes; conditionally independent labellers (Dawid and Skene)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        votes_, counts = digits(patterns), counts.astype(float)
        net = (votes_ - 1).sum(axis=1)
        good = 1 / (1 + np.exp(-net.astype(float)))  # begins with the majority
        for _ in range(EM_STEPS):
            self.prior = float(np.clip((counts * good).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
            self.tables = []
            for weight in (counts * (1 - good), counts * good):
                table = np.stack([np.bincount(votes_[:, i], weights=weight, minlength=3) + 1.0 for i in range(len(LABELLERS))])
                self.tables.append(table / table.sum(axis=1, keepdims=True))
            good = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes_, at = digits(patterns), np.arange(len(LABELLERS))
        bad, good = (np.log(t[at, votes_]).sum(axis=1) for t in self.tables)
        return 1 / (1 + np.exp(np.clip(bad + np.log(1 - self.prior) - good - np.log(self.prior), -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller that votes is right."""
        bad, good = self.tables
        right = self.prior * good[:, GOOD] + (1 - self.prior) * bad[:, BAD]
        voted = self.prior * (good[:, GOOD] + good[:, BAD]) + (1 - self.prior) * (bad[:, GOOD] + bad[:, BAD])
        return dict(zip(LABELLERS, (right / voted).tolist()))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed features of all byte trigrams."""
    d = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64)
    h = (d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def fit(features: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, steps: int = 200, rate: float = 4.0, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    w, b = np.zeros(1 << HASH_BITS), 0.0
    if not len(labels):
        return w, b
    rows = np.repeat(np.arange(len(labels)), [len(f) for f in features])
    at, value = np.concatenate(features).astype(np.int64), np.concatenate(values)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(rows, weights=w[at] * value, minlength=len(labels)) + b))) - labels
        w -= rate * (np.bincount(at, weights=error[rows] * value, minlength=len(w)) / len(labels) + l2 * w)
        b -= rate * error.mean()
    return w, b


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the linear scorer), kept."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pattern_of(t.encode("utf-8", "surrogatepass")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int32())], names=["h", "pattern"])

    voted = stored(hashed.select("text", "h").mapInArrow(vote, "h long, pattern int"))
    counts = voted.groupBy("pattern").count().collect()  # at most 3**8 rows
    model = WeakLabels(np.array([r[0] for r in counts], dtype=np.int64), np.array([r[1] for r in counts]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value, pattern = [], [], []
            for text in batch.column(0).to_pylist():
                text = text.encode("utf-8", "surrogatepass")
                f, n = np.unique(trigrams(text), return_counts=True)
                at.append(f.astype(np.int32))
                value.append((n / np.sqrt((n * n).sum()) if len(n) else n).astype(np.float32))
                pattern.append(pattern_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(pattern, pa.int32())], names=["f", "v", "pattern"])

    last = [r[0] for r in voted.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).collect()][0]
    sample = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("text").mapInArrow(features, "f array<int>, v array<float>, pattern int").toArrow() if last is not None else None
    f = [np.asarray(x.values) for x in sample["f"]] if sample else []
    v = [np.asarray(x.values, dtype=float) for x in sample["v"]] if sample else []
    w, b = fit(f, v, model.posterior(sample["pattern"].to_numpy().astype(np.int64)) if sample else np.zeros(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, margins = [], []
            for text in batch.column(1).to_pylist():
                text = text.encode("utf-8", "surrogatepass")
                patterns.append(pattern_of(text))
                n = np.bincount(trigrams(text), minlength=len(w)) if len(text) > 1 << HASH_BITS else None
                if n is None:
                    at, n = np.unique(trigrams(text), return_counts=True)
                else:
                    at = np.flatnonzero(n)
                    n = n[at]
                margins.append(float(w[at] @ n / np.sqrt(float((n.astype(float) ** 2).sum()))) + b if len(at) else np.nan)
            posterior = model.posterior(np.array(patterns, dtype=np.int64)) if patterns else np.zeros(0)
            p = np.where(np.isnan(margins), posterior, 1 / (1 + np.exp(-np.clip(np.nan_to_num(margins), -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= THRESHOLD, pa.bool_())], names=["doc_id", "posterior", "score", "kept"])

    return rows.mapInArrow(score, f"doc_id {id_type}, posterior double, score double, kept boolean")
