"""Removal of byte strings that occur twice or more, by prefix-free parsing and suffix arrays.

A window is every run of `length` bytes of a text (UTF-8, never across texts); one whose bytes also stand anywhere else, in
another text or the same one, is repeated, and every byte that a repeated window covers is removed.

1. Triggers: a rolling hash of GRAM bytes runs over each text; the gram with the least hash in a window (the last one at a
   tie) is the window's trigger. Equal windows have equal triggers at equal places, and every window has one, so texts
   fall into phrases that end at triggers, wherever they stand. Windows that follow each other and share a trigger form
   one context: the phrase up to the trigger and what stands to its right, as far as its windows reach.
2. Contexts are counted by trigger, summed before they are dealt out. A trigger that stands once has no repeated window. One
   whose contexts are all alike (pure) has only repeated ones. Only mixed triggers go on, each distinct context once.
3. Their phrases are the dictionary. A suffix array of the dictionary ranks every phrase suffix, a suffix array of the parse ranks
   what follows the triggers; sorting by both gives the corpus order of all windows, and neighbours in it that agree in
   `length` bytes are repeated. Triggers never meet each other's windows, so tasks take whole triggers.
4. A trigger with more than LIMIT distinct contexts is never one task: its windows are split by how much stands left of the
   trigger, halves, quarters and so on, and get longer triggers that such windows have in common, until each has few
   enough contexts; at the end a trigger is the whole window.

Documents meet verdicts by a hash of their text; triggers and contexts mean the same in every text, so a shared hash only
brings a text more of them to look up. A text is parsed wherever it lies; its bytes are shuffled once to meet the triggers
of repeated contexts, and those with mixed ones once more to meet their verdicts.

Cases: null texts are empty; texts shorter than a window lose nothing. Rows with equal texts lose alike, and all if they
are long enough. Ids may be null or repeat; other columns, whatever their names, are kept. An empty table gives an empty
table. Texts of any length are parsed in pieces (PIECE). Hashes that decide have 64 bits within one trigger or 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked

LENGTH, GRAM = 200, 64  # GRAM is a power of two below LENGTH
PIECE = 1 << 18
LIMIT, BUCKET = 2048, 4096  # distinct contexts of one trigger and of one task
PLACE = np.uint64((1 << 24) - 1)
SPANS = "array<struct<start:int,stop:int>>"
OPEN = "array<struct<start:int,stop:int,trigger:int,key:bigint>>"
CONTEXT = "key long, ctx binary, at int, body binary, weight int"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A rolling polynomial hash, modulo 2**64 and mixed, of every run of gram bytes."""
    h = (data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    step = 1
    while step < gram:  # runs of twice the length from two neighbours
        h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C55, step, 1 << 64)) + h[step:]
        step *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with windows, or piece of one: its place in texts, first and last window + 1, trigger's end and its hash of each context."""
    pieces = [(i, at, min(len(t), at + PIECE + length - 1)) for i, t in enumerate(texts) for at in range(0, len(t) - length + 1, PIECE)]
    begin = 0
    while begin < len(pieces):
        end, size = begin, 0
        while end < len(pieces) and (end == begin or size + pieces[end][2] - pieces[end][1] <= PIECE + length):
            size += pieces[end][2] - pieces[end][1]
            end += 1
        part = pieces[begin:end]
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in part), np.uint8)
        h = gram_hashes(data, gram)
        least = window_minima((h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64)), length - gram + 1)
        trigger = (PLACE - (least & PLACE)).astype(np.int64)
        first = 0
        for i, a, b in part:
            last = first + (b - a) - length + 1
            own = trigger[first:last]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield i, new + a, np.append(new[1:], len(own)) + a, own[new] - first + a + gram, h[own[new]].view(np.int64)
            first += b - a
        begin = end


def _digest(body: bytes, size: int) -> bytes:
    return blake2b(body, digest_size=size).digest()


def parsed(docs: DataFrame, length: int, with_context: bool) -> DataFrame:
    """Of docs(doc, body): the trigger of every context with the hash of the context, or with the hash of its text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                texts, doc = frame["body"].iloc[at : at + 512].tolist(), frame["doc"].to_numpy()[at : at + 512]
                keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, start, stop, _, key in contexts(texts, length):
                    if with_context:
                        t = texts[i]
                        found = np.frombuffer(b"".join([_digest(t[a : b + length - 1], 8) for a, b in zip(start.tolist(), stop.tolist())]), "<i8")
                    else:
                        found = np.full(len(key), doc[i])
                    keys.append(key)
                    values.append(found)
                yield pd.DataFrame({"key": np.concatenate(keys), "v": np.concatenate(values)})

    return docs.mapInPandas(run, "key long, v long")


def repeated_triggers(docs: DataFrame, length: int) -> DataFrame:
    """key, mixed: the triggers that stand twice or more, and whether their contexts differ."""
    counts = parsed(docs, length, True).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return counts.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed"))


def looked_up(docs: DataFrame, triggers: DataFrame, length: int) -> DataFrame:
    """sha, copies, body, gone, open: texts with repeated triggers, the spans that pure ones cover and the contexts of mixed ones."""
    pairs = parsed(docs, length, False).join(triggers, "key").groupBy(F.col("v").alias("doc"))
    asked = pairs.agg(F.collect_set(F.when(~F.col("mixed"), F.col("key"))).alias("pure"), F.collect_set(F.when(F.col("mixed"), F.col("key"))).alias("unsure"))
    copies = docs.groupBy("doc", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("doc").agg(F.collect_set("sha").alias("twice"))
    asked = asked.join(copies, "doc", "left")
    met = docs.join(asked, "doc").select("sha", "body", "pure", "unsure", F.coalesce(F.array_contains("twice", F.col("sha")), F.lit(False)).alias("copies"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                fresh = (part["sha"] != part["sha"].shift(1, fill_value=before)).to_numpy()  # copies of a text mostly meet one after the other
                before = part["sha"].iloc[-1]
                part = part[fresh].reset_index(drop=True)
                if part.empty:
                    continue
                texts = part["body"].tolist()
                gone, unsure = [[] for _ in texts], [[] for _ in texts]
                pure_keys, unsure_keys = part["pure"].tolist(), part["unsure"].tolist()
                for i, start, stop, trigger, key in contexts(texts, length):
                    known, open_ = np.isin(key, np.asarray(pure_keys[i], np.int64)), np.isin(key, np.asarray(unsure_keys[i], np.int64))
                    gone[i] += [{"start": a, "stop": b} for a, b in zip(start[known].tolist(), (stop[known] + length - 1).tolist())]
                    unsure[i] += [{"start": a, "stop": b, "trigger": c, "key": k} for a, b, c, k in zip(start[open_].tolist(), stop[open_].tolist(), trigger[open_].tolist(), key[open_].tolist())]
                yield pd.DataFrame({"sha": part["sha"], "copies": part["copies"], "body": texts, "gone": [merged(g) for g in gone], "open": unsure})

    return met.mapInPandas(run, f"sha string, copies boolean, body binary, gone {SPANS}, open {OPEN}")


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order without overlaps; those that touch are one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1] = {"start": out[-1]["start"], "stop": max(out[-1]["stop"], s["stop"])}
        else:
            out.append(s)
    return out


def _opened(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], pa.Array, pa.Array, np.ndarray]]:
    """The open contexts of texts, many texts at a time: their rows, and for each context its row's place, bytes, digest, trigger's hash and trigger's end in it."""
    for big in batches:
        for begin in range(0, big.num_rows, 512):
            rows = big.slice(begin, 512)
            counts, own = np.diff(rows.column("open").offsets.to_numpy()), rows.column("open").flatten()
            at, start, stop = np.repeat(np.arange(rows.num_rows), counts), own.field("start").to_numpy(), own.field("stop").to_numpy()
            texts = rows.column("body").to_pylist()
            cut = [texts[i][a:b] for i, a, b in zip(at.tolist(), start.tolist(), (stop + length - 1).tolist())]
            yield rows, at, cut, pa.array([_digest(c, size) for c in cut], pa.binary()), own.field("key"), own.field("trigger").to_numpy() - start


def mixed_contexts(texts: DataFrame, length: int) -> DataFrame:
    """Every distinct context of the mixed triggers, once, with the number of places where it stands (2 for two or more copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, cut, digest, key, trigger in _opened(batches, length, 16):
            weight = 1 + row.column("copies").cast(pa.int32()).to_numpy()[at]
            yield pa.RecordBatch.from_arrays([key, digest, pa.array(trigger, pa.int32()), pa.array(cut, pa.binary()), pa.array(weight, pa.int32())], names=["key", "ctx", "at", "body", "weight"])

    return _distinct(texts.where(F.size("open") > 0).select("body", "copies", "open").mapInArrow(run, CONTEXT))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "ctx").agg(F.first("at").alias("at"), F.first("body").alias("body"), F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"))


def suffix_ranks(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's suffix array as ranks, equal suffixes alike, of all phrases one after the other, and where each begins."""
    sizes = np.array([len(p) for p in phrases])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 ends a phrase, below all bytes
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
    left = np.repeat(begins + sizes, sizes + 1) - np.arange(len(symbols))  # symbols until the phrase ends
    rank, reach = symbols, 1

    def beyond(values: np.ndarray, step: int) -> np.ndarray:
        shifted = np.zeros_like(values)
        shifted[:-step] = values[step:]
        return np.where(left > step, shifted, 0)  # a phrase's end hides what follows it

    for _ in range(6):  # seven symbols of nine bits are one number
        rank = rank * 512 + beyond(symbols, reach)
        reach += 1
    rank = np.unique(rank, return_inverse=True)[1] + 1
    rank[~inside] = 0
    while reach < sizes.max():
        rank = np.unique(rank * (len(symbols) + 2) + beyond(rank, reach), return_inverse=True)[1] + 1
        rank[~inside] = 0
        reach *= 2
    return rank, begins


def right_order(rights: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The parse's suffix array, to the depth of a window: the rank of what follows each trigger, and minima of 1, 2, 4, ... common prefixes of neighbours."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rank = np.empty(len(rights), np.int64)
    rank[order] = np.arange(len(rights))
    size = np.array([len(rights[i]) for i in order])
    wide = np.zeros((len(rights), int(size.max(initial=0)) + 1), np.uint8)
    for row, i in enumerate(order):
        wide[row, : size[row]] = np.frombuffer(rights[i], np.uint8)
    differ = wide[1:] != wide[:-1]
    differ[:, -1] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    levels, step = [common], 1
    while step * 2 <= len(common):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return rank, levels


def corpus_order(bodies: list[bytes], ats: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context which of its windows is repeated in another one, by the suffix arrays of dictionary and parse."""
    place: dict[bytes, int] = {}
    phrase = np.array([place.setdefault(b[:a], len(place)) for b, a in zip(bodies, ats)])
    after: dict[bytes, int] = {}
    follows = np.array([after.setdefault(b[a:], len(after)) for b, a in zip(bodies, ats)])
    ranks, begins = suffix_ranks(list(place))
    right, levels = right_order(list(after))
    count = np.array([len(b) - length + 1 for b in bodies])
    owner = np.repeat(np.arange(len(bodies)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    suffix, behind = ranks[begins[phrase[owner]] + offset], right[follows[owner]]
    need = length - (ats[owner] - offset)  # bytes of the window right of its trigger
    order = np.lexsort((behind, suffix))
    lo, hi = behind[order[:-1]], behind[order[1:]]
    gap = hi - lo
    level = np.frexp(np.maximum(gap, 1))[1] - 1
    common = np.full(len(gap), length, np.int64)  # equal ranks are equal strings
    for k in range(len(levels)):
        at = np.flatnonzero((gap > 0) & (level == k))
        common[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k)])
    same = (suffix[order[:-1]] == suffix[order[1:]]) & (common >= need[order[:-1]])
    hit = np.zeros(len(owner), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return np.split(hit, np.cumsum(count)[:-1])


def _ranges(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def resolved(rows: DataFrame, length: int) -> DataFrame:
    """ctx, hits: the repeated windows of contexts, those of one trigger always in one task; contexts without any are left out."""
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-rows.count() // BUCKET)))))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        bodies, weight = own["body"].tolist(), own["weight"].to_numpy()
        hits = [_ranges(h if w < 2 else np.ones_like(h)) for h, w in zip(corpus_order(bodies, own["at"].to_numpy(), length), weight)]
        found = pd.DataFrame({"key": own["key"], "ctx": own["ctx"], "hits": hits})
        found = found[found["hits"].map(len) > 0]
        return found.astype({"hits": object})

    return dealt.groupBy("task").applyInPandas(run, f"key long, ctx binary, hits {SPANS}")


def _halved(rows: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Contexts split by how many bytes their windows have up to the trigger's end, each part with all that its windows share as its trigger."""
    edges = sorted({gram + round((length - gram + 1) * i / 2**level) for i in range(2**level + 1)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, ctx, at, body, weight in frame[["key", "ctx", "at", "body", "weight"]].itertuples(index=False):
                windows = len(body) - length + 1
                for lo, end in zip(edges, edges[1:]):
                    first, last = max(0, at - (end - 1)), min(windows - 1, at - lo)
                    if first <= last:
                        common = body[at - lo : at + length - (end - 1)]
                        new = int.from_bytes(_digest(b"%d %d " % (lo, end) + common, 8), "little", signed=True)
                        part = body[first : last + length]
                        out.append((new, _digest(part, 16), at - first, part, weight, key, ctx, first))
            if out:
                yield pd.DataFrame(out, columns=["key", "ctx", "at", "body", "weight", "from_key", "from_ctx", "shift"])

    return rows.mapInPandas(run, f"{CONTEXT}, from_key long, from_ctx binary, shift int")


def verdicts(rows: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """key, ctx, hits of every context of rows (stored) that holds a repeated window."""
    found, links, level = None, None, 0
    while True:
        hot = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIMIT).select("key"))
        now = resolved(rows.join(hot, "key", "left_anti"), length)
        if links is not None:  # back to the contexts that the parts come from
            now = now.join(links, ["key", "ctx"]).select(F.col("from_key").alias("key"), F.col("from_ctx").alias("ctx"), F.expr("transform(hits, s -> named_struct('start', s.start + shift, 'stop', s.stop + shift))").alias("hits"))
        found = now if found is None else found.unionByName(now)
        if not hot.take(1):
            return found.groupBy("key", "ctx").agg(F.flatten(F.collect_list("hits")).alias("hits")) if level else found
        level += 1
        parts = stored(_halved(rows.join(hot, "key"), level, length, gram))
        step = parts.select("key", "ctx", "from_key", "from_ctx", "shift")
        if links is not None:
            old = links.select(F.col("key").alias("from_key"), F.col("ctx").alias("from_ctx"), F.col("from_key").alias("root_key"), F.col("from_ctx").alias("root_ctx"), F.col("shift").alias("more"))
            step = step.join(old, ["from_key", "from_ctx"]).select("key", "ctx", F.col("root_key").alias("from_key"), F.col("root_ctx").alias("from_ctx"), (F.col("shift") + F.col("more")).alias("shift"))
        links, rows = stored(step), stored(_distinct(parts))


def changed_texts(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """sha (of the text, SHA-256 in hex), spans (removed, as byte offsets, in order) and kept (the remaining bytes) of every text that loses something."""
    body = F.encode(text_of(F.col(text)), "UTF-8")
    long = docs.select(F.sha2(body, 256).alias("sha"), body.alias("body")).where(F.octet_length("body") >= length).withColumn("doc", F.xxhash64("sha"))
    triggers = stored(repeated_triggers(long.select("doc", "body"), length))
    texts = stored(looked_up(long, triggers, length))
    rows = stored(mixed_contexts(texts, length))
    said = stored(verdicts(rows, length))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, _, digest, key, _ in _opened(batches, length, 16):
            start = row.column("open").flatten().field("start")
            yield pa.RecordBatch.from_arrays([row.column("sha").take(pa.array(at)), key, digest, start], names=["sha", "key", "ctx", "start"])

    asked = texts.where(F.size("open") > 0).select("sha", "body", "open").mapInArrow(opened, "sha string, key long, ctx binary, start int").distinct()
    shifted = F.expr(f"transform(hits, s -> named_struct('start', start + s.start, 'stop', start + s.stop + {length - 1}))")
    more = asked.join(said, ["key", "ctx"]).groupBy("sha").agg(F.flatten(F.collect_list(shifted)).alias("more"))
    none = F.array().cast(SPANS)
    sure = texts.where(F.size("open") == 0).select("sha", "body", "gone", none.alias("more"))
    both = sure.unionByName(texts.where(F.size("open") > 0).join(more, "sha", "left").select("sha", "body", "gone", F.coalesce("more", none).alias("more")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f for f in frames if len(f)):
            spans = [merged([*g, *m]) for g, m in zip(frame["gone"], frame["more"])]
            yield pd.DataFrame({"sha": frame["sha"], "spans": spans, "kept": [b"".join(b[x:y] for x, y in zip([0, *[s["stop"] for s in own]], [*[s["start"] for s in own], len(b)])) for own, b in zip(spans, frame["body"])]})

    return both.mapInPandas(cut, f"sha string, spans {SPANS}, kept binary").where(F.size("spans") > 0)


def text_sha(text: Column) -> Column:
    return F.sha2(F.encode(text_of(text), "UTF-8"), 256)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with removed_spans and kept (binary: a cut may fall within a character); texts that lose nothing are kept whole."""
    changed = changed_texts(docs, length).dropDuplicates(["sha"])
    df = packed(docs, text_sha(F.col("text")).alias("sha"), F.encode(text_of(F.col("text")), "UTF-8").alias("whole")).join(changed, "sha", "left")
    return unpacked(df, docs, more={"removed_spans": F.coalesce("spans", F.array().cast(SPANS)), "kept": F.coalesce("kept", "whole")})


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; texts themselves don't travel for this last step."""
    n = F.octet_length(text_of(F.col("text"))).cast("long")
    rows = docs.select("doc_id", n.alias("n_bytes"), text_sha(F.col("text")).alias("sha"))
    changed = changed_texts(docs, length).select("sha", F.octet_length("kept").cast("long").alias("n_kept"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("after"))
    changed = changed.groupBy("sha").agg(F.first("n_kept").alias("n_kept"), F.first("n_spans").alias("n_spans"), F.first("after").alias("after"))  # a text may have been cut more than once
    df = rows.join(changed, "sha", "left")
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("after", "sha").alias("kept_sha256"))
