"""Licence scans against plain search and a recursive parser."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from oracle import SF, connect
from quillstone.llm import licences, queries

from .conftest import rows, words


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_by_force(text):
    found, w = [], words_of(text)
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    labels = ",".join(sorted({x for _, x in found}))
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, labels


def value(tree):
    """(labels, asks) of a nested expression."""
    if isinstance(tree, str):
        label = licences.label_of(tree)
        return {label}, licences.ASKS.get(label, licences.UNKNOWN)
    op, a, b = tree
    (x, m), (y, n) = value(a), value(b)
    if op == "with":
        return x, {licences.WORKS: licences.FILES, licences.FILES: licences.NOTICE, licences.NETWORK: licences.WORKS}.get(m, m)
    return x | y, max(m, n) if op == "and" else min(m, n)


def said(tree):
    return tree if isinstance(tree, str) else f"{said(tree[1])} with {tree[2]}" if tree[0] == "with" else f"({said(tree[1])} {tree[0]} {said(tree[2])})"


NAMES = st.sampled_from("MIT Apache-2.0 GPL-2.0-only GPL-3.0-or-later LGPL-2.1+ AGPL-3.0 BSD-3-Clause CC-BY-NC-4.0 CC0-1.0 Own-1.0".split()).map(str.lower)
ONE = NAMES | st.tuples(st.just("with"), NAMES, st.sampled_from(["classpath-exception-2.0", "llvm-exception"]))
TREES = st.recursive(ONE, lambda inner: st.tuples(st.sampled_from(["and", "or"]), inner, inner), max_leaves=12)


@given(TREES)
def test_expressions_have_the_value_of_their_tree(tree):
    assert licences.evaluate(licences._TOKEN.findall(said(tree))) == value(tree)


@given(st.lists(NAMES, min_size=1, max_size=7), st.randoms())
def test_and_binds_tighter_than_or(names, rng):
    ops = [rng.choice(("and", "or")) for _ in names[1:]]
    flat = [names[0], *(x for pair in zip(ops, names[1:], strict=True) for x in pair)]
    groups = " ".join(flat).split(" or ")
    asks = min(max(licences.ASKS.get(licences.label_of(n), licences.UNKNOWN) for n in g.split(" and ")) for g in groups)
    assert licences.evaluate(flat) == ({licences.label_of(n) for n in names}, asks)


@pytest.mark.parametrize("bad", ["mit and", "or mit", "( mit", "mit )", "mit apache-2.0", "", "( )", "mit with ( apache-2.0 or mit )"])
def test_what_is_no_expression(bad):
    assert licences.evaluate(bad.split()) is None


def test_found_in_texts():
    scanner = licences.Scanner()
    for text, labels, asks in (
        ("# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Zlib\nx", "gpl mit zlib", 0.25),
        ("// SPDX-License-Identifier: GPL-3.0-or-later */", "gpl", 0.75),
        ("SPDX-License-Identifier: Own-License", "own-license", 0.75),
        ("SPDX-License-Identifier: MIT AND (", "mit", 0.25),
        ("License: see the file. Licence = of joy", "", 0.0),
        ('"license": "Apache-2.0 OR LGPL-2.1-or-later", "x"', "apache lgpl", 0.25),
        ("Licensed under the AGPL-3.0. All of it and MIT too.", "agpl", 0.9),
        ("CC-BY-SA 4.0", "cc-by cc-by-sa", 0.75),
        ("a gnu\tGENERAL (public) license-gnu lesser general public license", "gpl lgpl", 0.75),
        ("committed license of the smith license", "", 0.0),
    ):
        _, found = scanner.scan(text)
        assert sorted({x for f in found for x in f["labels"]}) == labels.split(), text
        assert max((f["asks"] for f in found), default=0.0) == asks, text


@given(st.lists(st.sampled_from(["mit", "license", "License", "cc", "BY", "apache", "gnu", "general", "public", "é", "x", "ſ", "K"]), max_size=40), st.sampled_from([" ", "-", "\n", ". ", "\0", "\x85"]))
def test_base_places_by_force(parts, between):
    text = between.join(parts)
    n, found = licences.Scanner().scan(text)
    base = [f for f in found if f["kind"] == "base"]
    places = [f["word"] for f in base]
    assert (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for f in base for x in f["labels"]}))) == base_by_force(text)


def test_base_columns_equal_sql(spark):
    got = {r["doc_id"]: r for r in queries.op12_license_scan(spark, SF).collect()}
    want = connect().execute(r"""
      WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
      p(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
      hits AS (SELECT doc_id, label, i FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w), p WHERE array_to_string(words[i + 1 : i + length(phrase) - length(replace(phrase, ' ', '')) + 1], ' ') = phrase)
      SELECT w.doc_id, any_value(len(words)), count(label), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id""").fetchall()
    assert len(got) == len(want) and any(r[2] for r in want)
    for doc, *row in want:
        r = got[doc]
        assert [r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] == row
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_odd_rows(spark, weird, nothing):
    rng = random.Random(4)
    long = words(rng, 50_000) + " mit license " + words(rng, 10)
    df = weird.unionByName(spark.createDataFrame([(90, long, *tuple(rows()[0])[2:]), (None, "CC BY", *tuple(rows()[0])[2:])], weird.schema))
    got = licences.digest(licences.scan(df)).collect()
    assert len(got) == df.count()
    assert {tuple(r)[1:] for r in got if r["doc_id"] in (3, 4)} == {(0, 0, None, None, "", "", 0.0)}
    assert [tuple(r)[2:] for r in got if r["doc_id"] == 90] == [(1, 50_000, 50_000, "mit", "mit", 0.25)]
    assert ("cc-by" in {r["labels"] for r in got if r["doc_id"] is None}) and licences.digest(licences.scan(nothing)).count() == 0
    named = licences.scan(df.withColumnRenamed("doc_id", "found").withColumnRenamed("text", "n_words"), "found", "n_words")
    assert named.columns[0] == "found" and named.count() == df.count()
