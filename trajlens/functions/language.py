"""Checks on task strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKENS = 3
#: Texts that say nothing, and verbs that name a manipulation.
PLACEHOLDERS = ["task", "task desc", "task description", "desc", "description", "test", "none", "null", "n a", "na", "unknown", "default", "demo", "episode", "untitled"]
VERBS = """
pick place put move open close push pull stack insert grasp grab hold lift
pour wipe fold sort hang take press turn rotate slide drop throw sweep clean
fill empty cut screw unscrew connect plug unplug load unload transfer
hand give bring carry lower raise flip stir scoop shake tap touch reach
release align arrange organize remove set store wrap unwrap tie untie zip
unzip button unbutton peel spread hit knock swap exchange collect gather
dump tidy straighten rearrange lay align stow dispose serve wash dry
""".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _is_verb(t: Column) -> Column:
    """A verb, or an -ing form whose stem, stem with e, or stem without its last letter is one."""
    stem = F.substring(t, F.lit(1), F.char_length(t) - 3)
    ing = t.endswith("ing") & (F.char_length(t) > 4)
    short = (F.char_length(stem) > 1) & F.substring(stem, F.lit(1), F.char_length(stem) - 1).isin(VERBS)
    return t.isin(VERBS) | (ing & (stem.isin(VERBS) | F.concat(stem, F.lit("e")).isin(VERBS) | short))


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""


def task_missing(text: Column) -> Column:
    return F.when(_blank(text), 1.0).otherwise(0.0)


def generic_reason(text: Column) -> Column:
    """Why a task string is too weak, null where it isn't or where it is blank."""
    words = tokens(text)
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    reason = F.when(F.array_join(words, " ").isin(PLACEHOLDERS), "placeholder text").when(ascii_only & (F.size(words) < MIN_TOKENS), f"fewer than {MIN_TOKENS} words").when(ascii_only & ~F.exists(words, _is_verb), "no action verb")
    return F.when(~_blank(text), reason)


def task_generic(text: Column) -> Column:
    return F.when(~_blank(text), F.when(generic_reason(text).isNotNull(), 1.0).otherwise(0.0))


def canonical_task(tasks: Column) -> Column:
    """A stable key of a list of tasks: lower case, punctuation and space folded, distinct, sorted, joined by " | "."""
    one = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.filter(F.transform(tasks, one), lambda t: t != ""))), " | "), F.lit(""))


def slug(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, "[^0-9a-zA-Z]+", "_")), F.lit("_"))
