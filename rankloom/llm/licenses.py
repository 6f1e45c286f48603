"""License scan: Aho-Corasick over notice phrases and identifier tags, expressions by shunting-yard.

A text's words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) are joined by blanks and passed
once through an automaton of all phrases.  Where the tag ``SPDX-License-Identifier`` occurs, the rest
of its line is read as an expression of identifiers with ``and``, ``or``, ``with`` and brackets, put in
postfix order and evaluated: ``and`` takes the smaller openness, ``or`` the larger, ``with`` that of the
licence it extends.  The score is the smallest openness of all statements of a document: 1 for
permissive licences, 0 for reserved rights and where nothing is stated.

A malformed expression states each of its identifiers by itself.  Null and empty texts have no words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notices, as words, and what they state.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "boost software license": "bsl-1.0", "mozilla public license": "mpl", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "eclipse public license": "epl", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "cc0 1 0": "cc0-1.0", "dedicated to the public domain": "public-domain",
}
_TAG = "spdx license identifier"

#: How open a licence is, by the beginning of its identifier; the longest that fits counts.
OPENNESS = {
    "apache": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3,
    "reserved": 0.0,
}
UNKNOWN = 0.1

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]+)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def openness(label: str) -> float:
    fits = [p for p in OPENNESS if label.startswith(p)]
    return OPENNESS[max(fits, key=len)] if fits else UNKNOWN


def postfix(tokens: list[str]) -> list[str] | None:
    """Tokens in postfix order by two stacks; None if they are not an expression."""
    out, stack, operand = [], [], True
    for token in tokens:
        if token == "(" and operand:
            stack.append(token)
        elif token == ")" and not operand:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in _RANK and not operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token not in _RANK and token not in "()" and operand:
            out.append(token)
            operand = False
        else:
            return None
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluated(text: str) -> tuple[set[str], float]:
    """Labels of an expression, and its openness; trailing words that cannot belong to it are not read."""
    tokens, depth, operand = [], 0, True
    for token in (t.lower() for t in _TOKEN.findall(text)):
        if token not in _RANK and token not in "()" and not operand:
            break
        depth += (token == "(") - (token == ")")
        if depth < 0:
            break
        tokens.append(token)
        operand = token in _RANK or token == "("
    order = postfix(tokens)
    if order is None:
        names = {t for t in tokens if t not in _RANK and t not in "()"}
        return names, min(map(openness, names), default=UNKNOWN)
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in _RANK:
            stack.append(({token}, openness(token)))
            continue
        (right, high), (left, low) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{a} with {b}" for a in left for b in right}, low))
        else:
            stack.append((left | right, max(low, high) if token == "or" else min(low, high)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, _TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scanned(text: str) -> tuple[int, list[tuple[int, str]], set[str], float]:
    """Words, (first word, phrase) of all base places, all labels, and the score."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, labels, values, at, word, tagged = [], set(), [], 0, 0, False
    for end, phrase in automaton().iter(joined):
        begin_ = end - len(phrase) - 1
        if begin_ >= at:
            word += joined.count(" ", at, begin_)
        else:
            word -= joined.count(" ", begin_, at)
        at = begin_
        if phrase in BASE:
            places.append((word, phrase))
        if phrase == _TAG:
            tagged = True
        else:
            label = BASE.get(phrase) or NOTICES[phrase]
            labels.add(label)
            values.append(openness(label))
    for found in _EXPRESSION.finditer(text) if tagged else ():
        names, value = evaluated(found[1])
        labels |= names
        values.append(value)
    return len(words), places, labels, min(values, default=0.0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (word, label) of base phrases, labels and score of every row."""
    begin(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanned(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.int64()),
                 pa.array([[{"word": w, "label": BASE[p]} for w, p in f[1]] for f in found], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                 pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())), pa.array([f[3] for f in found], pa.float64())],
                names=["doc_id", "n_words", "places", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, labels array<string>, score double")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
