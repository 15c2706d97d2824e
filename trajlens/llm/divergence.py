"""How far the word use of each source is from the other sources of its language, by three-dimensional cube partitioning.

A term is a run of letters A-Z and of characters beyond ASCII, A-Z in lower case. A language keeps the V terms that stand in at
least `least` of its documents. A group (a source of a language), and the language itself, gives each kept term
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N being its count of all kept terms; all arithmetic is exact.

Part `pair` ranks a group's fellow sources by the sum of |p - q| over the kept terms. Tasks own cells (group block, group
block, term block) of each language's cube: a cell gets the slices of two blocks of groups at one block of terms, each
slice copied to the cells of all blocks that it meets, sums |p - q| for its pairs, and the cells of a pair are added up
along the term axis. Blocks go by hash and hold about GROUPS groups and TERMS terms, so a cell's matrices are bounded
whatever the sizes of sources, languages and vocabularies. Part `term` ranks the kept terms that a group uses more than
its language does; only the first `top` ranks leave a task.

Terms are counted where the documents lie, before anything is dealt out; a source that holds a third of all rows arrives as counts.

Cases: null text, language or source are ''. Every row is a document, whatever its id; repeated rows count each time. A group
without terms has N = 0 and p as above; with V = 0 all pairs have value 0. A lone source has no pairs. Ties go to the
smaller item (UTF-8 bytes). Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

LEAST, TOP = 30, 50
GROUPS, TERMS = 32, 8192
TOKENS, ENTRIES = 200_000, 400_000  # a task's unsummed tokens and summed terms
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts summed within tasks; a row without term for every group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        waiting: dict[tuple[str, str], tuple[list, list]] = {}
        tokens = 0

        def settle() -> int:
            for group, (every, distinct) in waiting.items():
                n, d = sums.setdefault(group, (Counter(), Counter()))
                n.update(every)
                d.update(distinct)
            waiting.clear()
            return sum(len(n) for n, _ in sums.values())

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, d) in sums.items():
                terms = list(n)
                yield pd.DataFrame({"lang": lang, "source": source, "term": [None, *terms], "n": [0, *n.values()], "docs": [0, *[d[t] for t in terms]]})
            sums.clear()

        for frame in frames:
            for lang, source, body in zip(frame["lang"], frame["source"], frame["body"]):
                words = body.translate(LETTERS).split()
                every, distinct = waiting.setdefault((lang, source), ([], []))
                every += words
                distinct += set(words)
                tokens += len(words)
                if tokens >= TOKENS:
                    tokens = 0
                    if settle() >= ENTRIES:
                        yield from out()
        settle()
        yield from out()

    rows = docs.select(text_of(F.col("lang")).alias("lang"), text_of(F.col("source")).alias("source"), F.encode(text_of(F.col("text")), "UTF-8").alias("body"))
    found = rows.mapInPandas(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy(*GROUP, F.decode("term", "UTF-8").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def portion(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 kept)); null where nothing is kept."""
    long = lambda c: c.cast("decimal(20,0)")
    df = F.lit(10**9).cast("decimal(10,0)") * (long(n) + 5)
    below = F.when(kept > 0, long(total) + 5 * long(kept))
    return (1 + F.call_function("div", df, below)).cast("long")


def _blocks(size: Column, of: int) -> Column:
    return F.greatest(F.ceil(size / of), F.lit(1)).cast("int")


class Usage:
    """Stored tables of one corpus: groups (lang, source, total, kept, g, i), terms (lang, term, t, k, n) and uses (group and term columns, n)."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        counts = stored(counted(docs))
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
        kept = stored(kept.select("lang", "term", "n"))
        sizes = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all")), "lang", "left").na.fill(0)
        self.langs = stored(sizes)
        block = Window.partitionBy("lang", "t").orderBy("term")
        terms = kept.join(self.langs, "lang").withColumn("t", F.pmod(F.xxhash64("term"), _blocks(F.col("kept"), TERMS)).cast("int"))
        self.terms = stored(terms.select("lang", "term", "t", (F.row_number().over(block) - 1).alias("k"), "n", portion(F.col("n"), F.col("all"), F.col("kept")).alias("q")))
        used = counts.where("n > 0").join(self.terms.select("lang", "term", "t", "k", "q"), ["lang", "term"]).select(*GROUP, "term", "t", "k", "q", "n")
        per = counts.select(*GROUP).distinct().join(used.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left").na.fill(0).join(self.langs, "lang")
        many = per.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
        per = per.join(many, "lang").withColumn("blocks", _blocks(F.col("groups"), GROUPS)).withColumn("g", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        own = Window.partitionBy("lang", "g").orderBy("source")
        self.groups = stored(per.select(*GROUP, "total", "kept", "blocks", "g", (F.row_number().over(own) - 1).alias("i"), portion(F.lit(0), F.col("total"), F.col("kept")).alias("p0")))
        dims = self.groups.select(*GROUP, "total", "kept", "blocks", "g", "i")
        self.uses = used.join(dims, GROUP).withColumn("p", portion(F.col("n"), F.col("total"), F.col("kept")))


def _cell(own: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over one block of terms for all pairs of two blocks of groups."""
    head = own[own["k"] < 0]  # one row a group: what it gives terms that it doesn't use, and how many terms the block has
    lang, a, b = own["lang"].iloc[0], int(own["a"].iloc[0]), int(own["b"].iloc[0])
    width = int(head["n_terms"].max()) if len(head) else 0
    sides = {}
    for g in {a, b}:
        groups = head[head["g"] == g].sort_values("i")
        m = np.repeat(groups["p"].to_numpy(np.int64)[:, None], width, axis=1)
        used = own[(own["g"] == g) & (own["k"] >= 0)]
        m[np.searchsorted(groups["i"].to_numpy(), used["i"].to_numpy()), used["k"].to_numpy()] = used["p"].to_numpy(np.int64)
        sides[g] = groups["i"].to_numpy(), m
    (ids_a, left), (ids_b, right) = sides[a], sides[b]
    out = []
    for row, i in enumerate(ids_a):
        mates = ids_b > i if a == b else np.ones(len(ids_b), bool)
        out.append(pd.DataFrame({"lang": lang, "g": a, "i": i, "h": b, "j": ids_b[mates], "f": np.abs(right[mates] - left[row]).sum(axis=1)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "g": [], "i": [], "h": [], "j": [], "f": []}).astype({"g": "int32", "i": "int32", "h": "int32", "j": "int32", "f": "int64"})


def pairs(u: Usage) -> DataFrame:
    """lang, source, item, value for every source and each other source of its language."""
    wide = u.terms.groupBy("lang", "t").agg(F.count(F.lit(1)).cast("int").alias("n_terms"))
    heads = u.groups.withColumn("t", F.explode(F.sequence(F.lit(0), _blocks(F.col("kept"), TERMS) - 1))).join(wide, ["lang", "t"], "left")
    cols = ["lang", "blocks", "g", "i", "t", "k", "p", "n_terms"]
    slices = heads.select("lang", "blocks", "g", "i", "t", F.lit(-1).alias("k"), F.coalesce("p0", F.lit(0)).alias("p"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    slices = slices.unionByName(u.uses.withColumn("n_terms", F.lit(0)).select(*cols))
    cells = slices.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "t", "g", "i", "k", "p", "n_terms")
    parts = cells.groupBy("lang", "a", "b", "t").applyInPandas(_cell, "lang string, g int, i int, h int, j int, f long")
    sums = stored(parts.groupBy("lang", "g", "i", "h", "j").agg(F.sum("f").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("j").alias("i"), F.col("g").alias("h"), F.col("i").alias("j"), "value"))
    names = u.groups.select("lang", "g", "i", "source")
    mates = u.groups.select("lang", F.col("g").alias("h"), F.col("i").alias("j"), F.col("source").alias("item"))
    return both.join(names, ["lang", "g", "i"]).join(mates, ["lang", "h", "j"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` with all ranks, `term` up to `top`."""
    u = Usage(docs, least)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("int"))
    more = u.uses.where(F.col("p") > F.col("q")).select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    out = [GROUP[0], GROUP[1], "part", "item", "value", "rank"]
    return ranked(pairs(u)).withColumn("part", F.lit("pair")).select(*out).unionByName(ranked(more).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*out))
