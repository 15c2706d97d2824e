"""License scan: one Aho-Corasick automaton over notice phrases and identifier tags, a shunting-yard expression parser.

The automaton runs over each whole text, lower-cased (A-Z) and reduced to its words with single spaces, so phrases match
where their words stand consecutively. A second automaton finds identifier tags in the lower-cased text itself; what
follows a tag up to the end of its line is a license expression, parsed by precedence (WITH binds before AND before OR)
into postfix and evaluated twice: to the labels it names, and to whether the choice it leaves is permissive.

Texts stay in Arrow batches; nothing is shuffled, and memory follows the longest text. Cases: a null text is empty; a
text without words has n_words 0 and null places; repeated rows and extra columns are no matter (only doc_id and text
are read); an empty table gives an empty table; a malformed expression still yields the labels it names, with
``expression_ok`` false. After an SPDX tag every well-formed identifier is an operand: outside the known families it is
labelled by its own name and permits nothing. An operator without an operand leaves ``permissive`` null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases whose places count as base matches, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases of the method's own.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "licensed under the apache license version 2 0": "apache",
}
TAGS = ("spdx-license-identifier:", "license-identifier:", "license expression:", "license:")
#: Families of license identifiers: prefix of the lower-cased identifier to label and whether it is permissive.
FAMILIES = {
    "agpl": ("agpl", False), "apache": ("apache", True), "bsd": ("bsd", True), "cc-by-nc": ("cc-by-nc", False), "cc-by-sa": ("cc-by-sa", False), "cc-by": ("cc-by", True),
    "cc0": ("cc0", True), "epl": ("epl", False), "gpl": ("gpl", False), "isc": ("isc", True), "lgpl": ("lgpl", False), "mit": ("mit", True), "mpl": ("mpl", False), "unlicense": ("public-domain", True), "zlib": ("zlib", True),
}
EXCEPTIONS_PERMIT = ("classpath-exception", "gcc-exception", "llvm-exception", "linking-exception")
SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPDX_TAG = TAGS[0]
IDENTIFIER = re.compile(r"(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.-]*\+?")
TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
SCHEMA = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, expression_ok boolean, permissive boolean"


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def family(name: str) -> tuple[str, bool] | None:
    for prefix in sorted(FAMILIES, key=len, reverse=True):
        if name == prefix or name.startswith((prefix + "-", prefix + ".", prefix + "+")) or (prefix in ("gpl", "lgpl", "agpl") and re.fullmatch(prefix + r"v?[0-9.]+\+?", name)):
            return FAMILIES[prefix]
    return None


def postfix(expression: str, any_name: bool = False) -> tuple[list[str], bool, bool]:
    """Shunting-yard: operands and operators in postfix order, whether the expression is well formed, and whether every
    operator has its operands.

    Reading stops at the first token that can't continue the expression, so prose after a tag is left out. Identifiers are
    the known ones, or with any_name all well-formed ones.
    """
    out: list[str] = []
    whole = True
    stack: list[str] = []
    operand, ok = True, True  # operand: one is awaited
    for token in TOKEN.findall(expression):
        if token in PRECEDENCE:
            if operand:  # left out; what follows is still named
                ok = whole = False
                continue
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                ok = False
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            known = family(token) or (stack[-1:] == ["with"] and "exception" in token) or (any_name and IDENTIFIER.fullmatch(token))
            if not operand or not known:
                break
            out.append(token)
            operand = False
    if operand and stack:  # the last operator and brackets after it await an operand
        ok = False
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
            whole = False
    while stack:
        top = stack.pop()
        if top == "(":
            ok = False
        else:
            out.append(top)
    return out, ok and bool(out), whole


def evaluate(tokens: list[str]) -> tuple[set[str], bool | None]:
    """Labels that a postfix expression names, and whether it permits: OR leaves a choice, AND binds to both."""
    stack: list[tuple[set[str], bool]] = []
    exceptions = {tokens[i - 1] for i, token in enumerate(tokens) if token == "with" and i}
    for token in tokens:
        if token not in PRECEDENCE:
            found = family(token)
            if token in exceptions and not found:
                stack.append((set(), token.startswith(EXCEPTIONS_PERMIT)))
            else:
                stack.append(({found[0]}, found[1]) if found else ({token}, False))
            continue
        if len(stack) < 2:
            continue
        b, a = stack.pop(), stack.pop()
        stack.append((a[0] | b[0], a[1] and b[1] if token == "and" else a[1] or b[1]))
    labels = set().union(*(s[0] for s in stack)) if stack else set()
    return labels, all(s[1] for s in stack) if stack else None


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for k, v in (BASE_PHRASES | MORE_PHRASES).items():
        phrases.add_word(f" {k} ", (len(k) + 1, v, k in BASE_PHRASES))
    for k in TAGS:
        tags.add_word(k, k)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    low = lower_ascii(text)
    words = SEPARATORS.sub(" ", low).strip(" ")
    n_words = words.count(" ") + 1 if words else 0
    line = f" {words} "
    places, base, labels, at, seen = [], set(), set(), 0, 0
    for end, (size, label, is_base) in phrases.iter(line):
        labels.add(label)
        if is_base:
            start = end - size
            places.append((start, label))
            base.add(label)
    first = last = None
    numbers = []
    for start, _ in sorted(places):  # a place's word number is the count of spaces before it
        seen += line.count(" ", at, start + 1)
        at = start + 1
        numbers.append(seen - 1)
    if numbers:
        first, last = numbers[0], numbers[-1]
    n_tags, ok, choices, done = 0, None, [], -1
    for end, tag in tags.iter(low):
        if end == done:  # a shorter tag that ends at the same place
            continue
        done = end
        stop = low.find("\n", end)
        tokens, good, whole = postfix(low[end + 1 : stop if stop >= 0 else len(low)], tag == SPDX_TAG)
        if not tokens:
            continue
        n_tags += 1
        named, may = evaluate(tokens)
        labels |= named
        ok = good if ok is None else ok and good
        choices.append(may if whole else None)
    # all tags bind: one that doesn't permit decides, then one that is unknown
    permissive = False if False in choices else None if None in choices or not choices else True
    evidence = len(places) + 2 * n_tags + len(labels - base)
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5**evidence, n_tags, ok, permissive


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document; see ``SCHEMA``. score is 1 - 2**-evidence: a phrase counts 1, a tag 2, a further label 1."""
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    fields = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        phrases, tags = automata()
        out = to_arrow_schema(fields)
        for batch in batches:
            rows = [scan(t.as_py() or "", phrases, tags) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[] for _ in range(10)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, out.field(i + 1).type) for i, c in enumerate(columns)]], schema=out)

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
