"""Quality rules by distribution divergence (DataFrame functions only).

Each document's histogram of character classes and its histogram of common words are compared with references by
Jensen-Shannon distance (base 2, square root, 0 to 1). A language's reference is the sum of the same counts over those of its
documents that pass the base rules: character classes for every language code of the corpus, common words for the languages
of ``COMMON_WORDS``. It counts only with ``MIN_DOCS`` such documents and ``MIN_SUPPORT`` characters (or a hundredth as many
words), so a few odd documents with a code of their own make no reference. A document fails a divergence rule if it is far from its own
language's reference and from all others. Documents below the minimum lengths are not judged by divergence: a short
text's histogram says little. A document whose own language has no reference of a kind is not judged by that kind; the
base rules decide. References are one row, joined to all; there may be any number of languages, and only what is far from
its own language meets the others.

Cases: a null text is an empty one (no words, ``base_failed``). Null ids and repeated rows are judged like any other; a
caller's columns may have any names; very long texts are counted whole. An empty table gives an empty table. Where no
document has a language, there is no reference and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, packed, stored, text_of, unpacked, words_of

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "im", "in", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "por", "que", "se", "su", "un", "y"],
    "fr": ["dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
#: Character classes as patterns; what none of them holds is the class "other".
CLASSES = {"lower": "[a-z]+", "upper": r"\p{Lu}+", "letter": r"[^\x00-\x7F\p{Lu}]+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+", "stop": "[.,;:!?'()\"-]+"}

MIN_CHARS, MIN_WORDS = 200, 50
MIN_DOCS, MIN_SUPPORT = 20, 20_000  # what a language's reference rests on at least
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.35
WINDOW, MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30


def base_counts(df: DataFrame) -> DataFrame:
    """df(row, lang, t: the text) with its words w and the base counts."""
    df = df.withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumn("h", F.when(F.size("w") > WINDOW, F.expr(f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64(slice(w, i + 1, {WINDOW})))"))).withColumn("l", lines)
    # hash and place in order: equal neighbours are windows that occur again
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("sort_array(transform(h, (h, i) -> struct(h, i)))")))
    df = df.withColumn("p", F.expr("zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null))"))
    df = df.withColumn("p", F.expr("array_sort(array_distinct(flatten(filter(p, x -> x is not null))))"))
    covered = F.expr(f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x)")
    return df.select(
        "row",
        "lang",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.char_length("t").cast("long").alias("chars"),
    )


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars"]


def counted(docs: DataFrame, row: Column, langs: list[str]) -> DataFrame:
    """row, lang, the base counts and the histograms of every row of docs."""
    df = base_counts(docs.select(row.alias("row"), F.col("lang").cast("string").alias("lang"), text_of(F.col("text")).alias("t")))
    chars = F.col("chars").cast("double")
    df = df.withColumn("known", F.array(*[chars - F.char_length(F.regexp_replace("t", p, "")) for p in CLASSES.values()]))
    every = ", ".join(f"'{w}'" for w in sorted({w for x in langs for w in COMMON_WORDS[x]}))
    df = df.withColumn("f", F.expr(f"filter(transform(w, x -> lower(x)), x -> x in ({every}))"))
    df = df.withColumn("cls", F.expr("concat(known, array(cast(chars as double) - aggregate(known, 0D, (s, v) -> s + v)))"))
    for x in langs:
        own = ", ".join(f"'{w}'" for w in COMMON_WORDS[x])
        df = df.withColumn(f"own_{x}", F.expr(f"transform(array({own}), y -> cast(size(f) - size(array_remove(f, y)) as double))"))
        df = df.withColumn(f"cw_{x}", F.expr(f"concat(own_{x}, array(n_words - aggregate(own_{x}, 0D, (s, v) -> s + v)))"))
    # a generated row: later filters then read the counts instead of having all their expressions substituted
    return df.select("row", "lang", F.inline(F.array(F.struct(*BASE, "cls", *[f"cw_{x}" for x in langs]))))


def references(df: DataFrame, langs: list[str]) -> DataFrame:
    """One row: classes and words, arrays of (lang, q), the shares of each language with enough counted rows that pass the base rules."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    shares = lambda c: F.transform(c, lambda v: v / total(F.col(c)))
    good = df.where(~base_failed() & F.col("lang").isNotNull())
    sums = [F.array(*[F.sum(F.col("cls")[i]) for i in range(len(CLASSES) + 1)]).alias("cls"), F.count(F.lit(1)).alias("k")]
    for x in langs:
        sums.append(F.array(*[F.sum(F.when(F.col("lang") == x, F.col(f"cw_{x}")[i]).otherwise(0.0)) for i in range(len(COMMON_WORDS[x]) + 1)]).alias(f"cw_{x}"))
    per = stored(good.groupBy("lang").agg(*sums).where(F.col("k") >= MIN_DOCS))
    own = F.coalesce(*[F.when(F.col("lang") == x, F.col(f"cw_{x}")) for x in langs], F.expr("cast(array() as array<double>)"))
    per = per.select("lang", "cls", own.alias("cw"))
    kept = lambda c, least: F.when(total(F.col(c)) >= least, F.struct("lang", shares(c).alias("q")))
    listed = lambda c, least: F.sort_array(F.collect_list(kept(c, least)))  # noqa: E731  nulls are not collected
    return stored(per.agg(listed("cls", MIN_SUPPORT).alias("classes"), listed("cw", MIN_SUPPORT / 100).alias("words")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance between counts/total and the reference shares."""
    shares = F.transform(counts, lambda c: c / total)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(shares, reference, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2, F.lit(0.0)))


def nearest(refs: str, most: float, distance: Callable[[Column], Column]) -> Column:
    """The distance to the own language's reference; where that is over most, the least distance to any. Null without a reference of its own.

    distance: of a reference (lang, q).
    """
    own = F.get(F.filter(refs, lambda r: r["lang"] == F.col("lang")), F.lit(0))
    return F.when(own.isNotNull(), F.when(distance(own) <= most, distance(own)).otherwise(F.array_min(F.transform(refs, distance))))


def verdicts(df: DataFrame, refs: DataFrame, langs: list[str]) -> DataFrame:
    """Counted rows with base_failed, class_distance, word_distance (null where they aren't judged by it) and kept."""
    chars, n = F.col("chars").cast("double"), F.col("n_words").cast("double")

    def words(r: Column) -> Column:
        """The rows' own counts of the reference's words: each language has a list of its own."""
        return F.coalesce(*[F.when(r["lang"] == x, js_distance(F.col(f"cw_{x}"), n, r["q"])) for x in langs])

    df = df.crossJoin(F.broadcast(refs))  # one row
    df = df.withColumn("class_distance", F.when(chars >= MIN_CHARS, nearest("classes", MAX_CLASS_DISTANCE, lambda r: js_distance(F.col("cls"), chars, r["q"]))))
    df = df.withColumn("word_distance", F.when(n >= MIN_WORDS, nearest("words", MAX_WORD_DISTANCE, words))).drop("classes", "words")
    df = df.withColumn("base_failed", base_failed())
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts and the verdicts of every row. Texts are read once: a few numbers a row are stored."""
    langs = sorted(langs or COMMON_WORDS)
    df = stored(counted(docs, F.col("doc_id"), langs))
    return verdicts(df, references(df, langs), langs).select(F.col("row").alias("doc_id"), *BASE, "base_failed", "class_distance", "word_distance", "kept")


def keep_good(docs: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """The rows that pass, with their own columns; rows are stored once beside their counts, and nothing is shuffled."""
    langs = sorted(langs or COMMON_WORDS)
    whole = packed(docs, F.col("text"), F.col("lang"))
    df = stored(counted(whole, F.col("row"), langs))
    return unpacked(verdicts(df, references(df, langs), langs).where("kept"), docs)
