"""Language-model scores from a probabilistic suffix tree of variable-length contexts.

Short contexts are bytes of the text as lower-cased words with single spaces between, and one end symbol. Counts of all
(DEPTH+1)-grams come from every training document, summed per task before the shuffle; shorter contexts are sums of
these. A byte context is a candidate if at least MIN_SHARE of all symbols follow it, so there are at most DEPTH/MIN_SHARE
of them; it is retained if its next symbols diverge from its parent's by MIN_DIVERGENCE (Kullback-Leibler, bits), or if
it is a suffix of one that does. Distributions are smoothed towards the parent's (Witten-Bell), at the root towards all
bytes. This part of the tree goes to the tasks as an automaton.

Long contexts are the WORDS words before a word, every one of them, however large the corpus, and need MIN_COUNT training
occurrences; one is retained if the words after it diverge from what the byte contexts say of them. Its distribution
over next words is smoothed towards the byte contexts' probability of the whole word, which depends on nothing but the
long context and the word, as WORDS words are longer than DEPTH bytes. Nothing of the long contexts goes to the driver or
to all tasks. A task takes its texts in chunks of about CHUNK words and deals each chunk's positions (context, word,
probability, row) out to buckets by ranges of the context's hash, as one packed row a chunk and bucket. A bucket, of about
BUCKET positions however large the corpus, counts, tests and applies its contexts and returns what each chunk's rows gain, and a chunk adds up
its rows. The corpus is taken in ROUNDS rounds by hash, so that no more than one round's positions are on disk at once.
Contexts with about HOT positions or more, told from one text in SAMPLE, would make a bucket too large: they are counted
and applied as plain rows (round_gains), where a context with up to MAP_KINDS different followers carries them as one map
and those of the others meet their words in a join. Which way a context goes doesn't change the result.

Each word of a text is thus scored by the longest retained context before it: the words, or else the bytes.

The base score sums log10((c+1)/(N+V+1)) over words and one end. The most frequent training words (at most FREQUENT of
them) go to the tasks as a table; the others meet their counts in a join, where no word is hot.

Cases: a null text is empty (one end token); a null id counts as the empty text when folds are dealt; rows that repeat
are scored alike; without training documents N = V = 0 and the tree is uniform over bytes; extra columns are no matter;
an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_of

DEPTH, MIN_SHARE, MIN_DIVERGENCE = 5, 1 / 20_000, 0.002
WORDS, MIN_COUNT, ROUNDS, ROUND_WORDS, MAP_KINDS = 3, 2, 2, 1_000_000, 4096
CHUNK, CHUNK_ROWS, BUCKET, HOT, SAMPLE, WORD_BYTES = 1_000_000, 1 << 15, 400_000, 1_000_000, 16, 5
FREQUENT, FLUSH, PIECE, SLICE_BYTES = 200_000, 400_000, 256, 1_500_000
END = 10  # the byte that stands for the end; words hold no white space
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, dtype=np.uint64))


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """word, n over rows(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])
            own.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.update(tokens(text))
                if len(own) > FLUSH:
                    yield out()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each after DEPTH ends and before one, and where each begins (its first pad)."""
    return joined(map(tokens, texts))


def joined(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The same from the texts' words."""
    parts = [bytes([END]) * DEPTH + b" ".join(words) + bytes([END]) for words in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def _scored(starts: np.ndarray, size: int) -> np.ndarray:
    """True where a symbol is predicted, false on the pads."""
    keep = np.ones(size, dtype=bool)
    for j in range(DEPTH):
        keep[starts[:-1] + j] = False
    return keep


def count_grams(rows: DataFrame) -> DataFrame:
    """gram (DEPTH+1 bytes, the last one lowest), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def out() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

        for big in batches:
            for start in range(0, big.num_rows, 256):
                data, starts = stream(big.column(0).slice(start, 256).to_pylist())
                wide = data.astype(np.int64)
                gram = wide.copy()
                for j in range(1, DEPTH + 1):
                    gram[DEPTH:] |= wide[DEPTH - j : len(data) - j] << (8 * j)
                held.append(gram[_scored(starts, len(data))])
                waiting += len(held[-1])
                if waiting > 4_000_000:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    return rows.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _found(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in ordered distinct values, -1 where they aren't."""
    if not len(ordered):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


def _mask(size: int) -> int:
    return (1 << 8 * size) - 1


class SuffixTree:
    """Retained byte contexts as an automaton: for state and symbol the next state and the natural log probability.

    Prefixes of retained contexts are states too, so that every longer one can be reached symbol by symbol.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """levels[k]: context (k bytes packed), symbol and count of every candidate context of length k."""
        seen = np.unique(levels[0][1]) if levels else np.zeros(0, np.int64)
        self.symbols = np.full(256, len(seen), dtype=np.int64)  # symbols never seen share the last column
        self.symbols[seen] = np.arange(len(seen))
        width = len(seen) + 1
        total = np.zeros(width)
        if levels:
            np.add.at(total, self.symbols[levels[0][1]], levels[0][2])
        contexts, smooth, parents, keep = [np.zeros(1, np.int64)], [((total + 1) / (total.sum() + 256))[None].astype(np.float32)], [np.zeros(1, np.int64)], [np.ones(1, bool)]
        for size, (context, symbol, n) in enumerate(levels[1:], 1):
            own, row = np.unique(context, return_inverse=True)
            counts = np.zeros((len(own), width), dtype=np.float32)
            counts[row, self.symbols[symbol]] = n
            parent = _found(contexts[-1], own & _mask(size - 1))  # a suffix is at least as frequent, so it is a candidate too
            above = smooth[-1][parent]
            sums, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            share = counts / np.maximum(sums, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                divergence = np.where(share > 0, share * np.log2(share / above), 0).sum(axis=1)
            contexts.append(own)
            parents.append(parent)
            smooth.append((counts + kinds * above) / np.maximum(sums + kinds, 1))
            keep.append(divergence >= MIN_DIVERGENCE)
        for size in range(len(contexts) - 1, 1, -1):
            keep[size - 1][parents[size][keep[size]]] = True
        self.retained = int(sum(k.sum() for k in keep))
        states = [contexts[size][keep[size]] for size in range(len(contexts))]
        for size in range(len(states) - 1, 1, -1):  # prefixes, the longest first, so that theirs follow
            states[size - 1] = np.union1d(states[size - 1], states[size] >> 8)
        base = np.concatenate([[0], np.cumsum([len(x) for x in states])])
        self.next = np.zeros((base[-1], width), dtype=np.int32)
        self.logp = np.zeros((base[-1], width), dtype=np.float32)
        self.logp[0] = np.log(smooth[0][0])
        for size in range(len(states)):
            own = states[size]
            if size:
                suffix = np.zeros(len(own), np.int64)  # the longest state that ends alike
                for k in range(1, size):
                    place = _found(states[k], own & _mask(k))
                    suffix = np.where(place >= 0, base[k] + place, suffix)
                at = slice(base[size], base[size + 1])
                self.next[at], self.logp[at] = self.next[suffix], self.logp[suffix]
                row = _found(contexts[size], own)
                kept = np.flatnonzero((row >= 0) & keep[size][row])
                self.logp[base[size] + kept] = np.log(smooth[size][row[kept]])
            if size + 1 < len(states):  # a longer context is reached from its prefix, all else goes on from the suffix
                longer = states[size + 1]
                self.next[base[size] + _found(own, longer >> 8), self.symbols[longer & 255]] = base[size + 1] + np.arange(len(longer))

    def logs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The natural log probability of every symbol, 0 on the pads; pieces of the stream advance together."""
        width, size = self.next.shape[1], -(-len(data) // PIECE)
        symbols = np.zeros(size * PIECE, dtype=np.int64)
        symbols[: len(data)] = self.symbols[data]
        symbols = np.ascontiguousarray(symbols.reshape(size, PIECE).T)
        after, logp = self.next.ravel(), self.logp.ravel()
        state = np.zeros(size, dtype=np.int64)
        for t in range(PIECE - DEPTH, PIECE):  # a state depends on the last DEPTH symbols only
            state[1:] = after.take(state[1:] * width + symbols[t, :-1])
        grid = np.empty((PIECE, size), dtype=np.float32)
        for t in range(PIECE):
            at = state * width + symbols[t]
            grid[t] = logp.take(at)
            state = after.take(at).astype(np.int64)
        out = grid.T.ravel()[: len(data)]
        out[~_scored(starts, len(data))] = 0
        return out

    def log10(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, starts = stream(texts)
        return np.add.reduceat(self.logs(data, starts).astype(np.float64), starts[:-1]) / math.log(10)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MIXED = _mix(_BYTE)


def word_hashes(data: np.ndarray, starts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word of a stream: its text, its hash, and the byte contexts' log probability of the word and what ends it."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[1:] = data == 32
    first[starts[:-1] + DEPTH] = True
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(data)))
    place = np.arange(len(data) - at[0]) - np.repeat(at - at[0], size)
    # far into a very long word the powers start anew, with another byte table value for the lap
    value = _MIXED[data[at[0] :]] * _POWERS[place & 4095]
    far = np.flatnonzero(place >> 12)
    value[far] = _mix(_BYTE[data[at[0] + far]] + (place[far] >> 12).astype(np.uint64)) * _POWERS[place[far] & 4095]
    for j in range(DEPTH):
        value[starts[1:-1] + j - at[0]] = 0
    word = _mix(np.add.reduceat(value, at - at[0]))
    return np.searchsorted(starts, at, side="right") - 1, word, np.add.reduceat(logs.astype(np.float64), at)


def _context_hashes(word: np.ndarray) -> np.ndarray:
    """The hash of the WORDS words before each word of a sequence."""
    context = np.zeros(len(word), dtype=np.uint64)
    for back in range(1, WORDS + 1):
        if len(word) > back:
            context[back:] = _mix(context[back:] + word[:-back] * np.uint64(2 * back + 1))
    return context


def _long(which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of every word, and which words have one in their own text."""
    chosen = np.ones(len(word), dtype=bool)
    chosen[:WORDS] = False
    chosen[WORDS:] = which[WORDS:] == which[:-WORDS]
    return _context_hashes(word), chosen


def hot_contexts(rows: DataFrame, least: int, one_in: int) -> np.ndarray:
    """Hashes of contexts with about so many positions or more, sorted, told from one of so many rows(text, rk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            context, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(context[often].view(np.int64)), pa.array(n[often])], names=["context", "n"])

        for big in batches:
            for batch in _slices(big, 0):
                data, starts = stream(batch.column(0).to_pylist())
                which, word, _ = word_hashes(data, starts, np.zeros(len(data), np.float32))
                context, chosen = _long(which, word)
                held.append(context[chosen])
                if sum(map(len, held)) > 1_000_000:
                    yield out()
        if held:
            yield out()

    some = rows.where(F.pmod("rk", F.lit(one_in)) == 0).select("text").mapInArrow(run, "context long, n long")
    found = some.groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") * one_in >= least).select("context").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def hot_positions(rows: DataFrame, tree, hot, id_type: str) -> DataFrame:
    """row, held, context, word, p of every word after a hot context, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in _slices(big, 0):
                data, starts = stream(batch.column(0).to_pylist())
                which, word, p = word_hashes(data, starts, tree.value.logs(data, starts))
                context, chosen = _long(which, word)
                at = np.flatnonzero(chosen & (_found(hot.value, context) >= 0))
                own = [batch.column(c).take(pa.array(which[at])) for c in (1, 2, 3)]
                more = [pa.array(x) for x in (context[at].view(np.int64), word[at].view(np.int64), p[at].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([*own, *more], names=["doc_id", "rk", "held", "context", "word", "p"])

    found = rows.select("text", "doc_id", "rk", "held").mapInArrow(run, f"doc_id {id_type}, rk long, held boolean, context long, word long, p float")
    return found.select(F.struct("doc_id", "rk").alias("row"), "held", "context", "word", "p")


def _planes(x: np.ndarray, size: int = 8) -> bytes:
    """The lowest bytes of integers, all first ones, then all second ones: high bytes that are alike pack well."""
    return x.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _integers(planes: bytes, size: int = 8) -> np.ndarray:
    found = np.frombuffer(planes, np.uint8).reshape(size, -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, :size] = found.T
    return out.view(np.uint64).ravel()


def bucket_gains(context: np.ndarray, word: np.ndarray, p: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of positions of whole contexts: which ones follow a retained context, and what it adds to each one's score (log10)."""
    order = np.argsort(context)
    ordered = context[order]
    own = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    total = np.bincount(own, train[order])
    often = total[own] >= MIN_COUNT
    order, own = order[often], own[often]
    if not len(order):
        return order, np.zeros(0)
    pair = (own.astype(np.uint64) << np.uint64(8 * WORD_BYTES)) | word[order]
    by = np.argsort(pair)
    order, own, pair = order[by], own[by], pair[by]
    new = np.append(True, pair[1:] != pair[:-1])
    at, pair = np.flatnonzero(new), np.cumsum(new) - 1
    n, log = np.bincount(pair, train[order]), p[order].astype(np.float64)
    seen = np.flatnonzero(n)
    owner, m = own[at[seen]], n[seen]
    kinds = np.bincount(owner, minlength=len(total))
    bits = np.bincount(owner, m * (np.log2(m) - log[at[seen]] / math.log(2)), len(total))
    some = np.maximum(total, 1)
    kept = ((bits / some - np.log2(some)) >= MIN_DIVERGENCE)[own]
    order, own, pair, log = order[kept], own[kept], pair[kept], log[kept]
    return order, np.log10((n[pair] + kinds[own] * np.exp(log)) / (total[own] + kinds[own])) - log / math.log(10)


def _in_bucket(table: pa.Table) -> pa.Table:
    """Packed positions of a bucket become packed gains of their chunks; rows of documents pass through."""
    packed = table.filter(pc.is_valid(table["context"]))
    parts = [packed[c].to_pylist() for c in ("context", "word", "p", "at")]
    contexts = [np.cumsum(_integers(x), dtype=np.uint64) for x in parts[0]]
    size = np.cumsum([0, *map(len, contexts)])
    names = [c for c in table.column_names if c not in ("bucket", "word", "p")]
    documents = table.filter(pc.is_null(table["context"])).select(names)
    if not contexts:
        return documents
    words = np.concatenate([_integers(x, WORD_BYTES) for x in parts[1]])
    p, code = (np.concatenate([np.frombuffer(x, kind) for x in column]) for column, kind in zip(parts[2:], (np.float32, np.uint16)))
    order, gain = bucket_gains(np.concatenate(contexts), words, p, code & 1 == 0)
    back = np.argsort(order)
    order, gain = order[back], gain[back].astype(np.float32)
    cut = np.searchsorted(order, size)
    spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    found = {"chunk": packed["chunk"].take(pa.array([k for k, _ in spans], pa.int64())), "context": pa.array([gain[x].tobytes() for _, x in spans], pa.binary()), "at": pa.array([(code[order[x]] >> 1).tobytes() for _, x in spans], pa.binary())}
    empty = {c: pa.nulls(len(spans), table.schema.field(c).type) for c in names}
    return pa.concat_tables([documents, pa.table(empty | found).select(names).cast(documents.schema)])


def _in_chunk(table: pa.Table) -> pa.Table:
    """The rows of a chunk's documents with what their positions gain."""
    packed = table.filter(pc.is_valid(table["context"]))
    documents = table.filter(pc.is_null(table["context"]))
    gain, n_long = np.zeros(len(documents)), np.zeros(len(documents), np.int64)
    place = np.argsort(documents["place"].to_numpy())
    for own, gains in zip(packed["at"].to_pylist(), packed["context"].to_pylist()):
        row = place[np.frombuffer(own, np.uint16)]
        np.add.at(gain, row, np.frombuffer(gains, np.float32))
        np.add.at(n_long, row, 1)
    return documents.drop_columns(["chunk", "place", "context", "at"]).append_column("gain", pa.array(gain)).append_column("n_long", pa.array(n_long))


def round_rows(rows: DataFrame, describe, tree, hot, part: int, rounds: int, buckets: int, id_type: str) -> DataFrame:
    """doc_id, rk, held, n, k, b, score, gain, n_long of every row(text, doc_id, rk, held): what describe and the tree say of
    its text, and what the retained long contexts of the round but the hot ones add to its score; stored."""
    limit, most = CHUNK, CHUNK_ROWS
    documents = f"doc_id {id_type}, rk long, held boolean, n long, k long, b double, score double"
    names = ["chunk", "bucket", "context", "word", "p", "at", "place", "doc_id", "rk", "held", "n", "k", "b", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        chunk, n_rows = TaskContext.get().partitionId() << 32, 0

        def positions() -> pa.RecordBatch:
            context, word, p, code = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(context)
            context = context[order]
            bucket = ((context >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            word, p, code = word[order], p[order], code[order]
            spans = [slice(a, b) for a, b in zip(cut, np.append(cut[1:], len(bucket)))]
            packed = ([_planes(np.diff(context[x], prepend=np.uint64(0))) for x in spans], [_planes(word[x], WORD_BYTES) for x in spans], [p[x].tobytes() for x in spans], [code[x].tobytes() for x in spans])
            arrays = [pa.array(np.full(len(cut), chunk)), pa.array(bucket[cut].astype(np.int64)), *[pa.array(x, pa.binary()) for x in packed]]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(cut), kind) for kind in kinds]], names=names)

        for big in batches:
            kinds = [pa.int32(), *[big.schema.field(k).type for k in (1, 2, 3)], pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            for whole in _slices(big, 0):
                for start in range(0, whole.num_rows, most):
                    batch = whole.slice(start, most)
                    if held and n_rows + batch.num_rows > most:
                        yield positions()
                        chunk, n_rows = chunk + 1, 0
                    texts = [tokens(t) for t in batch.column(0).to_pylist()]
                    data, starts = joined(texts)
                    logs = tree.value.logs(data, starts)
                    which, word, p = word_hashes(data, starts, logs)
                    context, chosen = _long(which, word)
                    chosen &= context % np.uint64(rounds) == part
                    if hot is not None:
                        chosen &= _found(hot.value, context) < 0
                    own = np.zeros(len(texts), np.uint16) + pc.fill_null(batch.column(3), True).to_numpy(zero_copy_only=False)
                    code = (((n_rows + which[chosen]) << 1) + own[which[chosen]]).astype(np.uint16)
                    held.append((context[chosen], word[chosen], p[chosen].astype(np.float32), code))
                    said = describe(texts) if part == 0 else [pa.nulls(len(texts), kind) for kind in kinds[4:7]]
                    score = np.add.reduceat(logs.astype(np.float64), starts[:-1]) / math.log(10)
                    at = pa.array(np.arange(n_rows, n_rows + len(texts)), pa.int32())
                    numbers = [pa.array(np.full(len(texts), x)) for x in (chunk, (chunk + (chunk >> 32)) % buckets)]
                    blank = [pa.nulls(len(texts), pa.binary())] * 4
                    yield pa.RecordBatch.from_arrays([*numbers, *blank, at, *[batch.column(k) for k in (1, 2, 3)], *said, pa.array(score)], names=names)
                    n_rows += len(texts)
                    if sum(len(x[0]) for x in held) * rounds > limit:
                        yield positions()
                        chunk, n_rows = chunk + 1, 0
        if held:
            yield positions()

    sent = rows.select("text", "doc_id", "rk", "held").mapInArrow(run, f"chunk long, bucket long, context binary, word binary, p binary, at binary, place int, {documents}")
    gained = sent.groupBy("bucket").applyInArrow(_in_bucket, f"chunk long, context binary, at binary, place int, {documents}")
    return stored(gained.groupBy("chunk").applyInArrow(_in_chunk, f"{documents}, gain double, n_long long"))


def round_gains(placed: DataFrame) -> DataFrame:
    """row, gain (log10), n_long: what the retained long contexts among positions add to each row's score, stored."""
    placed = stored(placed)
    seen = stored(placed.where("not held").groupBy("context", "word").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")))
    bits = F.sum(F.col("n") * (F.log2("n") - F.col("p") / math.log(2))) / F.sum("n") - F.log2(F.sum("n"))
    often = seen.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), bits.alias("bits"))
    often = stored(often.where((F.col("total") >= MIN_COUNT) & (F.col("bits") >= MIN_DIVERGENCE)).drop("bits"))
    wide = F.col("k") > MAP_KINDS
    kept = seen.join(often.where(~wide), "context").groupBy("context")
    maps = stored(kept.agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("follow"), F.first("total").alias("total")))
    gain = lambda n, k: F.log10((n + k * F.exp("p")) / (F.col("total") + k)) - F.col("p") / math.log(10)
    parts = [placed.join(maps, "context").select("row", gain(F.coalesce(F.try_element_at("follow", F.col("word")), F.lit(0)), F.size("follow")).alias("gain"))]
    if often.where(wide).take(1):
        met = placed.join(often.where(wide), "context").join(seen.select("context", "word", "n"), ["context", "word"], "left")
        parts.append(met.select("row", gain(F.coalesce("n", F.lit(0)), F.col("k")).alias("gain")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = stored(every.groupBy("row").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_long")))
    discard(placed, seen, often, maps)
    return out


def _last(context: Column | str, size: int) -> Column:
    """The last bytes of a packed context."""
    return (F.col(context) if isinstance(context, str) else context).bitwiseAND((1 << 8 * size) - 1)


def _level(grams: DataFrame, size: int) -> DataFrame:
    """context (of so many bytes), symbol, n."""
    level = grams.groupBy(_last("gram", size + 1).alias("g")).agg(F.sum("n").alias("n"))
    return level.select(F.shiftright("g", 8).alias("context"), F.col("g").bitwiseAND(255).alias("symbol"), "n")


def fit_tree(rows: DataFrame) -> SuffixTree:
    """The byte contexts of rows(text); what reaches the driver is bounded by MIN_SHARE."""
    grams = stored(count_grams(rows))
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = []
    for size in range(DEPTH + 1):
        if not total:
            break
        level = _level(grams, size)
        often = level.groupBy("context").agg(F.sum("n").alias("k")).where(F.col("k") >= MIN_SHARE * total).select("context")
        found = level.join(often, "context").toArrow()
        levels.append(tuple(found[c].to_numpy().astype(np.int64) for c in ("context", "symbol", "n")))
    discard(grams)
    return SuffixTree(levels)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of text, one row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def score(docs: DataFrame, is_held_out: Column, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_long (words scored by a long context) and mean_score (a token) for every row of docs."""
    spark = docs.sparkSession
    text = text_of(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"), is_held_out.alias("held"), F.xxhash64("doc_id", text).alias("rk"))
    train = rows.where("not held")
    tree = spark.sparkContext.broadcast(fit_tree(train))
    counts = stored(count_words(train))
    n_docs = train.select("held").count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, n_kinds = words + n_docs, kinds + (n_docs > 0)
    step = F.floor(F.log2("n") * 8)
    steps = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least = min([s for (s, _), n in zip(steps, itertools.accumulate(n for _, n in steps)) if n <= FREQUENT], default=math.inf)
    often = step >= least
    below = n_train + n_kinds + 1
    frequent = spark.sparkContext.broadcast({bytes(r[0]): math.log10((r[1] + 1) / below) for r in counts.where(often).collect()})  # at most FREQUENT words
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def describe(texts: list[list[bytes]]) -> list[pa.Array]:
        """Tokens, known ones among the frequent, and their base score."""
        logs, end = frequent.value, math.log10((n_docs + 1) / below)
        size, found, base = [], [], []
        for own in texts:
            hits = [x for x in map(logs.get, own) if x is not None]
            size.append(len(own) + 1)
            found.append(len(hits) + (n_docs > 0))
            base.append(math.fsum(hits) + end)
        return [pa.array(size, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64())]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for big in batches:
            for batch in _slices(big, 0):
                rows, found, n = [], [], []
                for row, t in enumerate(batch.column(0).to_pylist()):
                    own = Counter(w for w in tokens(t) if w not in known)
                    rows += [row] * len(own)
                    found += own.keys()
                    n += own.values()
                keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "rk", "word", "m"])

    by = ["doc_id", "rk"]  # a row's identity; rows that repeat exactly share it
    asked = rows.select("text", *by).mapInArrow(rare, f"doc_id {id_type}, rk long, word binary, m long")
    met = asked.join(counts.where(~often), "word", "left")
    c = F.coalesce("n", F.lit(0))
    known, base = F.when(c > 0, F.col("m")).otherwise(0), F.col("m") * F.log10((c + 1) / F.lit(float(below)))
    per = stored(met.groupBy(*by).agg(F.sum(known).alias("rare_known"), F.sum(base).alias("rare_base")))
    discard(counts)
    rounds = rounds or int(max(1, min(ROUNDS, words // ROUND_WORDS)))
    hot, added = None, [per]
    if words > HOT:
        found = hot_contexts(rows, HOT, SAMPLE)
        if len(found):
            hot = spark.sparkContext.broadcast(found)
            added.append(round_gains(hot_positions(rows, tree, hot, id_type)).select("row.doc_id", "row.rk", "gain", "n_long"))
    buckets = int(max(1, -(-words // (rounds * BUCKET))))
    told = []
    for part in range(rounds):
        told.append(round_rows(rows, describe, tree, hot, part, rounds, buckets, id_type))
        spark.sparkContext._jvm.System.gc()  # so that the round's shuffle files go
    for sent in (tree, frequent, *([hot] if hot else [])):
        sent.destroy()
    whole = told[0].withColumn("copies", F.lit(1))  # what repeated rows add up is theirs together
    added += [whole.select(*by, "gain", "n_long", "copies"), *[x.select(*by, "gain", "n_long") for x in told[1:]]]
    sums = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), added).groupBy(*by)
    sums = sums.agg(*[F.sum(x).alias(x) for x in ("copies", "gain", "n_long", "rare_known", "rare_base")])
    same = F.col("w.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("w.rk") == F.col("x.rk"))
    out = whole.drop("gain", "n_long", "copies").alias("w").join(sums.alias("x"), same)
    share = lambda column: F.coalesce(F.col(column) / F.col("copies"), F.lit(0.0))
    total = F.col("score") + share("gain")
    return out.select(
        "w.doc_id",
        F.col("held").alias("held_out"),
        F.col("w.n").alias("n_tokens"),
        (F.col("k") + share("rare_known").cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("b") + share("rare_base")).alias("base_score"),
        total.alias("score"),
        share("n_long").cast("long").alias("n_long"),
        (total / F.col("w.n")).alias("mean_score"),
    )
