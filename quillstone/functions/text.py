"""Scalar functions on text: token estimates, words, names, tags, search terms and stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MERGE_PREFIX

# Words without meaning for the similarity of claims.
SIMILARITY_STOPWORDS = (
    "the and for with that this from are was were not but use uses used into its our their has have had can will "
    "should must all any only than then when which what why how because"
).split()
# Words without meaning in a search.
QUERY_STOPWORDS = (
    "a an the and or but for with that this these those from into is are was were be been being it its of on in at to "
    "we us our you your i my me they their do does did how what why when where which who can could should would will "
    "shall may might must not no have has had use using used about than then there here if so as by just please"
).split()
#: Terms of a search beyond this only broaden it.
MAX_TERMS = 24


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate(text: Column | str) -> Column:
    """Tokens as a fourth of the characters, rounded up."""
    return F.ceil(F.length(_c(text)) / F.lit(4.0)).cast("long")


def estimate_tokens(text: str) -> int:
    return -(-len(text) // 4)


def short_tag(cid: Column | str) -> Column:
    """The four characters of an address that a rendered claim carries."""
    return F.substring(F.regexp_replace(_c(cid), "^b3:", ""), 1, 4)


def words_of(text: Column | str) -> Column:
    """Distinct lower-case words of three letters or digits and more, without stopwords."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{IsAlphabetic}\p{N}]{3,})"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, SIMILARITY_STOPWORDS)))


def word_set(text: str) -> frozenset[str]:
    out, word = set(), []
    for c in text + " ":
        if c.isalnum():
            word.append(c)
        elif word:
            if len(word) >= 3 and (w := "".join(word).lower()) not in _STOP:
                out.add(w)
            word = []
    return frozenset(out)


_STOP = frozenset(SIMILARITY_STOPWORDS)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of the union; 0 if either set is empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def slug(text: Column | str, default: str = "") -> Column:
    """Lower-case letters and digits, all else one dash, none at the ends."""
    made = F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", default).otherwise(made)


def clean_source(text: Column | str, default: str = "unknown", most: int = 40) -> Column:
    made = F.left(F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9._:-]", ""), F.lit(most))
    return F.when(F.coalesce(made, F.lit("")) == "", default).otherwise(made)


def is_branch(name: Column | str) -> Column:
    """Lower-case letters, digits, - and _, in parts between single slashes."""
    return _c(name).rlike("^[a-z0-9_-]+(/[a-z0-9_-]+)*$")


def is_document_name(name: Column | str) -> Column:
    return F.lower(F.trim(_c(name))).rlike("^[a-z0-9-]{1,64}$")


BRANCH_NAME = re.compile("[a-z0-9_-]+(/[a-z0-9_-]+)*")


def lane(branch: Column | str) -> Column:
    """The part of a branch after its last slash."""
    return F.element_at(F.split(_c(branch), "/"), -1)


def project(branch: Column | str) -> Column:
    return F.split_part(_c(branch), F.lit("/"), F.lit(1))


def first_line(text: Column | str) -> Column:
    return F.split_part(_c(text), F.lit("\n"), F.lit(1))


def visible_refs(refs: Column | str) -> Column:
    return F.filter(F.coalesce(_c(refs), F.array().cast("array<string>")), lambda r: ~r.startswith(MERGE_PREFIX))


def title_of(body: Column | str, name: Column | str) -> Column:
    """First line that isn't blank, without leading #, at most 120 characters; the name if nothing is left."""
    line = F.filter(F.transform(F.split(_c(body), "\n"), F.trim), lambda x: x != "")[0]
    found = F.left(F.trim(F.ltrim(line, F.lit("#"))), F.lit(120))
    return F.when(F.coalesce(found, F.lit("")) == "", _c(name)).otherwise(found)


def label_of(text: Column | str, most: int = 48) -> Column:
    """A short node label: one line, quotes and brackets as entities."""
    line = first_line(text)
    cut = F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        cut = F.replace(cut, F.lit(a), F.lit(b))
    return cut


def camel_parts(word: str) -> list[str]:
    """Lower-case parts of a word with inner capitals, of two letters and more; nothing for other words."""
    cuts = [i for i, c in enumerate(word) if c.isupper() and i]
    if not cuts:
        return []
    parts = [word[a:b].lower() for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]
    return [p for p in parts if len(p) > 1]


def query_terms(text: str) -> list[str]:
    """Distinct terms of a search, parts of camel-case words included; stopwords only if there is nothing else."""
    words: dict[str, None] = {}
    for raw in re.findall(r"[^\W_]+", text):
        for w in (*camel_parts(raw), raw.lower()):
            words.setdefault(w)
    kept = [w for w in words if len(w) > 1 and w not in QUERY_STOPWORDS] or list(words)
    return kept[:MAX_TERMS]


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


# Porter's stemmer (1980), as published.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(text: pd.Series) -> pd.Series:
    """Folded words of a text, stemmed, in order and with repeats."""
    return text.map(lambda x: [stem(w) for w in re.findall(r"[^\W_]+", fold(x))] if x else [])


def plain_words(text: Column | str) -> Column:
    """Lower-case words in order and with repeats: the tokens of an index without stems."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
