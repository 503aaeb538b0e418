"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text, and a
shunting-yard parser evaluates the expression after a tag.

An expression joins licence identifiers by ``and``, ``or`` and ``with``. Its value is how much the strictest terms ask
that nobody can choose to avoid: ``and`` is the larger of two values, ``or`` the smaller, and ``with`` an exception
takes one step off a licence whose terms spread to other works. A text's score is the largest value in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import beside_text, map_batches

# The phrases that every scan has, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
}
#: What the licences of a label ask: nothing, a notice, their own files, whole works, works over a network; and what they forbid.
NOTHING, NOTICE, FILES, WORKS, NETWORK, FORBIDS = 0.1, 0.25, 0.5, 0.75, 0.9, 1.0
ASKS = {
    **dict.fromkeys(("cc0", "unlicense", "0bsd", "wtfpl"), NOTHING),
    **dict.fromkeys(("mit", "apache", "bsd", "isc", "bsl", "zlib", "cc-by", "python", "psf", "postgresql", "artistic", "x11"), NOTICE),
    **dict.fromkeys(("lgpl", "mpl", "epl", "cddl", "eupl", "ms-pl"), FILES),
    **dict.fromkeys(("gpl", "cc-by-sa", "odbl", "ofl"), WORKS),
    **dict.fromkeys(("agpl", "sspl", "osl"), NETWORK),
    **dict.fromkeys(("cc-by-nc", "cc-by-nc-sa", "cc-by-nd", "cc-by-nc-nd", "busl"), FORBIDS),
}
#: Identifiers that aren't known ask as much as whole works do: nobody has read their terms.
UNKNOWN = WORKS
#: Words that an expression follows, and whether any identifier may stand in it; after the others the first must be known.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False, "licensed under": False}

_WORD_BYTE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
#: What may stand between a tag and its expression, by kind of tag: a mark, or for "licensed under" nothing but an article.
_AFTER_MARK, _AFTER_VERB = re.compile(r"[\"' \t]*[:=][\"' \t]*"), re.compile(r"[ \t]+(?:the[ \t]+)?(?=[(\w])")
_VERSION = re.compile(r"(?:(?:-v?|v)[0-9][0-9.]*|-only|-or-later|-clause|\+)+$")
#: How tight the operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of a licence identifier: its name without version."""
    return _VERSION.sub("", identifier.lower()) or identifier.lower()


def postfix(tokens: list[str]) -> list[str] | None:
    """The operands and operators of an infix expression in order of evaluation; None if it is none."""
    out, held, operand = [], [], True  # whether an operand is due
    for token in tokens:
        if token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in BINDS and not operand:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token not in BINDS and token not in "()" and operand:
            out.append(token)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """(labels, value) of an expression; None if it is none. What follows ``with`` is an exception's name, not a licence."""
    order = postfix(tokens)
    if order is None:
        return None
    stack: list[tuple[set[str], float, bool]] = []  # labels, value, whether it is one licence
    for token in order:
        if token not in BINDS:
            label = label_of(token)
            stack.append(({label}, ASKS.get(label, UNKNOWN), True))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            if not (a[2] and b[2]):
                return None
            eased = {WORKS: FILES, FILES: NOTICE, NETWORK: WORKS}.get(a[1], a[1])
            stack.append((a[0], eased, False))
        else:
            stack.append((a[0] | b[0], max(a[1], b[1]) if token == "and" else min(a[1], b[1]), False))
    return stack[0][:2]


def expression(line: str, strict: bool) -> tuple[list[str], tuple[set[str], float] | None]:
    """The tokens of the expression at the beginning of a lower-case line, and its value.

    After a tag that always has one (``strict``) the whole line counts; else the longest part that is an expression, if it begins with
    a known licence.
    """
    tokens, at = [], 0
    for m in _TOKEN.finditer(line):
        if line[at : m.start()].strip(" \t"):
            break
        tokens.append(m.group().rstrip(".") or ".")
        at = m.end()
        if m.group().endswith(".") or not strict and len(tokens) > 1 and tokens[-1] not in BINDS and tokens[-1] not in "()" and tokens[-2] not in BINDS and tokens[-2] != "(":
            break  # a sentence ends, or goes on in prose
    if strict:
        return tokens, evaluate(tokens)
    first = next((t for t in tokens if t != "("), "")
    if label_of(first) not in ASKS or first in BINDS:
        return [], None
    while tokens:
        if (found := evaluate(tokens)) is not None:
            return tokens, found
        tokens = tokens[:-1]
    return [], None


class Scanner:
    """The automaton over all phrases and tags; each is padded with spaces, so only whole words match."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
            for phrase in phrases:
                self.automaton.add_word(f" {phrase} ", (kind, phrase, len(phrase) + 1))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of words, and what was found, in order: kind, labels, word, words, asks, said."""
        raw = text.encode()
        plain = raw.translate(_WORD_BYTE)  # byte for byte
        words = plain.split()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found, starts, spaces = [], None, None
        for end, (kind, phrase, size) in self.automaton.iter(joined):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            word = int(np.searchsorted(spaces, end - size))
            n = phrase.count(" ") + 1
            if kind != "tag":
                label = BASE[phrase] if kind == "base" else NOTICES[phrase]
                found.append({"kind": kind, "labels": [label], "word": word, "words": n, "asks": ASKS[label], "said": phrase})
                continue
            if starts is None:
                byte = np.frombuffer(b" " + plain, np.uint8)
                starts = np.flatnonzero((byte[1:] != 32) & (byte[:-1] == 32))
            begin = int(starts[word + n - 1]) + len(words[word + n - 1])
            stop = raw.find(b"\n", begin)
            line = raw[begin : stop if stop >= 0 else len(raw)].decode("latin-1").lower()
            lead = (_AFTER_VERB if phrase == "licensed under" else _AFTER_MARK).match(line)
            if lead is None:
                continue
            tokens, value = expression(line[lead.end() :], TAGS[phrase])
            if tokens:
                known = sorted(value[0] if value else {x for x in map(label_of, tokens) if x in ASKS})
                asks = value[1] if value else max((ASKS[x] for x in known), default=UNKNOWN)
                found.append({"kind": "expression" if value else "malformed", "labels": known, "word": word, "words": n, "asks": asks, "said": " ".join(tokens)})
        return len(words), sorted(found, key=lambda f: (f["word"], f["words"], f["kind"]))


FOUND = "array<struct<kind: string, labels: array<string>, word: long, words: long, asks: double, said: string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, found (array of kind, labels, word, words, asks, said, in order of word).

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A phrase is found wherever its words
    stand one after another, however they are set apart; an expression is read from its tag to the end of the line. One that can't be
    parsed is ``malformed``, with the known licences in it, and asks as much as the strictest of them. Null and empty texts
    have no words, texts may have any length, repeated rows are scanned each, an empty table gives no rows, and no column
    but these two is read.
    """
    held, fields = beside_text(docs, [id_col], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(), None
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                made = [scanner.scan(t or "") for t in some.column("text").to_pylist()]
                kind = kind or pa.list_(pa.struct([("kind", pa.string()), ("labels", pa.list_(pa.string())), ("word", pa.int64()), ("words", pa.int64()), ("asks", pa.float64()), ("said", pa.string())]))
                yield pa.RecordBatch.from_arrays([some.column("c0"), pa.array([n for n, _ in made], pa.int64()), pa.array([f for _, f in made], kind)], ["c0", "n_words", "found"])

    typed = held.select("c0").schema["c0"].dataType.simpleString()
    return map_batches(held, run, f"c0 {typed}, n_words long, found {FOUND}").withColumnRenamed("c0", fields.names[0])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``scan`` found as one row of numbers and labels: places of base phrases, labels of these and of all, and the score."""
    base = F.filter("found", lambda f: f["kind"] == "base")
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: f["labels"])))), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["asks"])), F.lit(0.0)).alias("score"),
    )
