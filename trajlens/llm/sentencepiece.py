"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut where no piece can cross (before a run of word marks, around line ends that no piece holds). The distinct
cuts of a batch, "words", are grouped by length and words of equal length advance together: rolling hashes of all
substrings probe the sorted keys of the pieces, and at each end position a vectorised maximum over piece lengths stores
the backpointer.

A unigram model scores a path by its pieces' scores. A BPE model's segmentation is no maximum of such a sum, so there a
path is admissible only if each neighbouring pair of its pieces is what merging alone makes of the two joined, and each
first piece what merging makes of itself; exactly one path has this property (merges inside a pair depend on nothing
outside it), it is the one the merge order yields, and its ids are those of the published algorithm. Pairs are decided
once by merging the two pieces and kept in a bounded table. Very long words without a cut advance in overlapping parts.

Cases: a null or empty text has no ids and decodes to the empty text; a character without a piece becomes its bytes'
pieces (or the unknown id where the model has none); word marks in a text decode to spaces, as that format has it. Ids
outside the vocabulary raise. Null ids of documents, repeated rows, very long words and extra columns are no matter;
an empty table gives an empty table. Only models with the identity normaliser are read.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
MAX_WORDS_KEPT, PAIR_BITS, CELLS = 500_000, 21, 400_000
LONG, OVERLAP, SLICE_CHARS = 2048, 256, 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, their sorted keys, and what encoding and decoding need of them."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix = UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"identity") != b"identity" or spec.get(2, b"") or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser, white space kept, are supported")
                self.prefix = bool(spec.get(3, 1))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("the model is neither unigram nor BPE")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside; texts cannot be cut at marks")
        self.longest = max(map(len, self.ids), default=1)
        stop = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + ("|\n" if stop else ""))
        keys = np.array([self._key(p) for p in self.ids], dtype=np.uint64)
        order = keys.argsort()
        self.keys, self.key_ids = keys[order], np.fromiter(self.ids.values(), np.int64, len(self.ids))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash key")
        self.maybe = np.zeros(1 << 20, dtype=bool)  # a first probe: most substrings end here
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.values = np.array(self.scores)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0  # of a character without a piece
        out = [b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_starts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.marked = np.array([p.startswith(MARK) for p in self.pieces])
        self.chars = np.array([len(p) for p in self.pieces])
        self.words: dict[str, int] = {}  # to the word's place in starts, which has one more
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) & (2**64 - 1)
        return h

    # --- which pairs of pieces merging leaves alone ---------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The symbols that BPE merging makes of a short text: best score first, leftmost first."""
        symbols, get, none = list(text), self.score_of.get, -np.inf
        worth = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while worth and (best := max(worth)) > none:
            at = worth.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = get(symbols[at - 1] + symbols[at], none)
            if at < len(worth):
                worth[at] = get(symbols[at] + symbols[at + 1], none)
        return symbols

    def _text(self, i: int) -> str:
        return self.pieces[i] if i < len(self.pieces) else chr(i - len(self.pieces))

    def _admissible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pairs (before: -1 at a word's start) merging leaves alone; one slot of a bounded table a pair."""
        width = len(self.pieces) + 0x110000
        keys = (before + 1) * width + piece
        slots = ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_ok[slots]
        unknown = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(unknown):
            fresh, where = np.unique(keys[unknown], return_inverse=True)
            said = np.empty(len(fresh), dtype=bool)
            for n, key in enumerate(fresh.tolist()):
                a, b = divmod(key, width)
                parts = ([self._text(a - 1)] if a else []) + [self._text(b)]
                said[n] = self.merged("".join(parts)) == parts
            ok[unknown] = said[where]
            self.pair_keys[slots[unknown]], self.pair_ok[slots[unknown]] = keys[unknown], ok[unknown]
            # two pairs of one slot: the last key written must own the slot's answer
            lost = unknown[self.pair_keys[slots[unknown]] != keys[unknown]]
            self.pair_keys[slots[lost]] = -1
        return ok

    # --- Viterbi --------------------------------------------------------------------------------------------------

    def _advance(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length end to end, and how many each word has.

        Only substrings that are pieces take part, so memory is a few numbers for each of these, however long the words.
        """
        n, w, many = len(words[0]), len(words), len(self.pieces)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(w, n).astype(np.uint64)
        sizes = min(self.longest, n)
        is_piece = np.zeros((sizes + 1, w, n), dtype=bool)
        hits = []
        h = np.zeros((w, n), dtype=np.uint64)
        for size in range(1, sizes + 1):
            h = h[:, : n - size + 1] * MULTIPLIER + codes[:, size - 1 :] + np.uint64(1)
            row, start = np.nonzero(self.maybe[(h >> np.uint64(44)).view(np.int64)])
            probe = h[row, start]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            real = self.keys[at] == probe
            row, start, ids = row[real], start[real], self.key_ids[at[real]]
            is_piece[size, row, start] = True
            if size == 1:  # a character without a piece stands for itself
                r, s = np.nonzero(~is_piece[1])
                row, start, ids = np.concatenate([row, r]), np.concatenate([start, s]), np.concatenate([ids, many + codes[r, s].astype(np.int64)])
            hits.append((row, start, ids, np.full(len(row), size)))
        row, start, ids, size = (np.concatenate(x) for x in zip(*hits))
        order = np.argsort(start + size, kind="stable")  # by end, shorter pieces first
        row, start, ids, size = row[order], start[order], ids[order], size[order]
        cuts = np.searchsorted(start + size, np.arange(1, n + 2))
        score = np.full((n + 1, w), -np.inf)
        last = np.full((n + 1, w), -1, dtype=np.int64)
        back = np.zeros((n + 1, w), dtype=np.int64)
        score[0] = 0.0
        worth = np.zeros(len(ids)) if self.type == BPE else np.where(ids < many, self.values[np.minimum(ids, many - 1)], self.floor)
        for end in range(1, n + 1):
            a, b = cuts[end - 1], cuts[end]
            r, s, i = row[a:b], start[a:b], ids[a:b]
            total = score[s, r] + worth[a:b]
            ok = np.flatnonzero(total > -np.inf)
            if self.type == BPE:
                first = back[s[ok], r[ok]]  # where the piece before begins: two pieces that join to a piece would have been merged
                whole = np.minimum(end - first, sizes + 1)
                joins = (s[ok] > 0) & (whole <= sizes)
                joins[joins] = is_piece[whole[joins], r[ok[joins]], first[joins]]
                ok = ok[~joins]
                ok = ok[self._admissible(last[s[ok], r[ok]], i[ok])]
            r, s, i, total = r[ok], s[ok], i[ok], total[ok]
            np.maximum.at(score[end], r, total)
            best = np.flatnonzero(total == score[end, r])[::-1]  # at a tie the shortest piece is written last
            last[end, r[best]], back[end, r[best]] = i[best], s[best]
        steps, at, live = [], np.full(w, n), np.arange(w)
        while len(live):
            steps.append((live, last[at[live], live]))
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        rows, found = (np.concatenate(x) for x in zip(*steps))
        # steps run from the end: a stable sort of the reversed lists puts each word's pieces in order
        order = np.argsort(rows[::-1], kind="stable")
        return found[::-1][order], np.bincount(rows, minlength=w)

    def _long(self, word: str) -> np.ndarray | None:
        """Pieces of one very long word, or None where its parts don't meet.

        Parts of it that overlap advance together. Where two parts that follow each other have a piece in common, the
        one goes on as the other: all neighbouring pairs stay admissible, so it is the whole word's one path.
        """
        starts = list(range(0, max(1, len(word) - OVERLAP), LONG - OVERLAP))
        parts = [word[s : s + LONG] for s in starts]
        found: list[np.ndarray] = []
        for group in (parts[:-1], parts[-1:]):  # all but the last have one length
            for k in range(0, len(group), max(1, CELLS // LONG)):
                flat, counts = self._advance(group[k : k + max(1, CELLS // LONG)])
                found += np.split(flat, np.cumsum(counts)[:-1])
        out, begin = [], 0  # begin: index of the first piece still to take of the present part
        for k, own in enumerate(found):
            if k + 1 == len(found):
                out.append(own[begin:])
                break
            ends, ends_next = (s + np.cumsum(self.width(x)) for s, x in ((starts[k], own), (starts[k + 1], found[k + 1])))
            key = np.append(starts[k], ends[:-1]) * (2 * LONG) + ends - np.append(starts[k], ends[:-1])
            key_next = np.append(starts[k + 1], ends_next[:-1]) * (2 * LONG) + ends_next - np.append(starts[k + 1], ends_next[:-1])
            both = np.flatnonzero(np.isin(key[begin:], key_next) & np.isin(own[begin:], found[k + 1])) + begin
            both = both[ends[both] < starts[k] + LONG]  # the part's own end may cut a piece short
            if not len(both):
                return None
            out.append(own[begin : both[0] + 1])
            begin = int(np.flatnonzero(key_next == key[both[0]])[0]) + 1
        return np.concatenate(out)

    def width(self, ids: np.ndarray) -> np.ndarray:
        """Characters of pieces."""
        return np.where(ids < len(self.pieces), self.chars[np.minimum(ids, len(self.pieces) - 1)], 1)

    def _final(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words with characters that have none put into bytes (or the unknown id)."""
        rare = np.flatnonzero(found >= len(self.pieces))
        if not len(rare):
            return found, counts
        if not self.bytes:
            return np.where(found < len(self.pieces), found, self.unknown), counts
        spelled = [[self.bytes[b] for b in chr(i - len(self.pieces)).encode("utf-8", "surrogatepass")] for i in found[rare].tolist()]
        each = np.ones(len(found), dtype=np.int64)
        each[rare] = [len(x) for x in spelled]
        word = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(found, each)
        out[np.repeat(found >= len(self.pieces), each)] = list(chain.from_iterable(spelled))
        return out, np.bincount(word, weights=each, minlength=len(counts)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode distinct words that the table doesn't hold, into it."""
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        flat, counts = [self.flat], []
        for size, group in by_size.items():
            if size > 2 * LONG and self.type == BPE:
                pieces = [self._long(x) for x in group]
                pieces = [self._advance([x])[0] if p is None else p for x, p in zip(group, pieces)]
                found = [(np.concatenate(pieces), np.array([len(p) for p in pieces]))]
            else:
                step = max(1, CELLS // size)
                found = [self._advance(group[k : k + step]) for k in range(0, len(group), step)]
            for f, c in found:
                f, c = self._final(f, c)
                flat.append(f.astype(np.int32))
                counts.append(c)
        for group in by_size.values():
            self.words.update(zip(group, range(len(self.words), len(self.words) + len(group))))
        self.flat = np.concatenate(flat)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))]) if counts else self.starts

    def forget(self) -> None:
        """Drop the older half of the table."""
        cut = len(self.words) // 2
        self.words = {x: i - cut for x, i in self.words.items() if i >= cut}
        self.flat, self.starts = self.flat[self.starts[cut] :], self.starts[cut:] - self.starts[cut]

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text."""
        cuts = [self.cuts(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        distinct = dict.fromkeys(chain.from_iterable(cuts))
        fresh = [x for x in distinct if x not in self.words]
        if fresh and self.words and len(self.words) + len(fresh) > MAX_WORDS_KEPT:
            self.forget()
            fresh = [x for x in distinct if x not in self.words]
        if fresh:
            self.learn(fresh)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cuts)), np.int64, count=int(bounds[-1]))
        ids, ends = _gathered(self.flat, self.starts[at], self.starts[at + 1] - self.starts[at])
        return ids, np.concatenate([[0], ends])[bounds].astype(np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids end to end: the pieces' bytes, gathered at once."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id is outside the vocabulary")
        data, ends = _gathered(self.out, self.out_starts[ids], self.out_starts[ids + 1] - self.out_starts[ids])
        ends = np.concatenate([[0], ends])[offsets]
        if self.prefix:  # the mark that encoding puts in front goes
            led = np.flatnonzero(offsets[1:] > offsets[:-1])
            led = led[self.marked[ids[offsets[led]]]]
            data = np.delete(data, ends[led])
            ends = ends - np.searchsorted(led, np.arange(len(ends)))
        raw = data.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:  # byte pieces that are no text become replacement characters
            return pa.array([raw[a:b].decode("utf-8", "each_byte") for a, b in zip(ends[:-1], ends[1:])], pa.string())
        if (data[ends[1:-1][ends[1:-1] < len(data)]] & 0xC0 == 0x80).any():
            return pa.array([raw[a:b].decode("utf-8", "each_byte") for a, b in zip(ends[:-1], ends[1:])], pa.string())
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] of every start end to end, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends


#: Every byte that belongs to no character becomes one replacement character.
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))

_LOADED: dict[bytes, Model] = {}


def model_of(data: bytes) -> Model:
    """The model of these bytes, kept by each Python worker."""
    if data not in _LOADED:
        _LOADED.clear()
        _LOADED[data] = Model(data)
    return _LOADED[data]


def read_model(spark, path: str = MODEL_PATH) -> bytes:
    """The model file through Spark's readers, so any store will do; a file of a few hundred kilobytes."""
    path = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids decode to) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for ids_of, texts in sliced(batch):
                ids, offsets = m.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(np.diff(offsets), pa.int64()), lists, m.decode(ids, offsets)], names=["doc_id", "n_tokens", "ids", "decoded"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (empty for null) of a batch, in slices of about SLICE_CHARS characters, one text at least."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > SLICE_CHARS:
            yield batch.column(0).slice(start, k - start), texts[start:k]
            start, size = k, 0
        size += len(t)
    if texts:
        yield batch.column(0).slice(start), texts[start:]


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded of every row of encoded(doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = [x or [] for x in batch.column(1).slice(k, 256).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
                ids = np.fromiter(chain.from_iterable(own), np.int64, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), m.decode(ids, offsets)], names=["doc_id", "decoded"])

    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded string"
    return encoded.select("doc_id", encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, schema)
