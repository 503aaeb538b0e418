"""Models against plain Python: one n-gram, one coordinate and one row at a time."""

import itertools
import math
import random
import struct
import unicodedata
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import langid, resampling

from .conftest import words

WRAP = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & WRAP
    return x ^ x >> 31


def kind(c):
    return "" if c.isspace() else "w" if c.isalnum() or c == "_" else "o"


def slots(text):
    """The hashed unigrams and bigrams of a text."""
    tokens = ["".join(run) for k, run in itertools.groupby(text.lower(), kind) if k]
    hashes = [mixed((sum(mixed(ord(c) + 0x632BE59BD9B4E019 & WRAP) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(t)) + len(t)) & WRAP) for t in tokens]
    pairs = [(a * 0xD6E8FEB86659FD93 + b) & WRAP for a, b in itertools.pairwise(hashes)]
    return [h >> 48 for h in hashes] + [((p ^ p >> 31) * 0xBF58476D1CE4E5B9 & WRAP) >> 48 for p in pairs]


def noise(doc_id, text, seed=0):
    h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    h = xxhash.xxh64(struct.pack("<q", doc_id), seed=h).intdigest()
    h = xxhash.xxh64(text.encode(), seed=h).intdigest()
    return -math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(31)
    vocabulary = [words(rng, 1) for _ in range(80)] + ["naïve", "x_1", "--", "(ok)!", "Ünïon", "42"]
    docs = [(i, " ".join(rng.choices(vocabulary[: 30 + i % 56], k=rng.randint(1, 40)))) for i in range(120)] + [(120, "")]
    assert not any(unicodedata.combining(c) for _, t in docs for c in t)
    count = lambda rows: Counter(s for _, t in rows for s in slots(t))
    target, raw = count(docs[:50]), count(docs)
    t_all, r_all = sum(target.values()) + (1 << 16), sum(raw.values()) + (1 << 16)
    weight = {i: sum(math.log((target[s] + 1) / t_all) - math.log((raw[s] + 1) / r_all) for s in slots(t)) for i, t in docs}
    key = {i: weight[i] + noise(i, t) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (1, 40, 110):
        first = set(sorted(key, key=lambda i: (-key[i], i))[:k])
        for r in resampling.resample(df, df.where("doc_id < 50"), k).collect():
            i = r["doc_id"]
            assert r["n_grams"] == len(slots(docs[i][1]))
            assert abs(r["log_weight"] - weight[i]) < 1e-9 and abs(r["gumbel_key"] - key[i]) < 1e-9
            assert r["selected"] == (i in first)


def test_regularised_leader_one_coordinate_at_a_time():
    rng = np.random.default_rng(5)
    classes, alpha, beta, l1, l2, epochs, seed = 3, 0.5, 1.0, 0.05, 0.1, 2, 3
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(30)]
    y = rng.integers(0, classes, 30)
    bias, z, n = 1 << langid.BITS, Counter(), Counter()

    def weight(cell):
        if abs(z[cell]) <= l1:
            return 0.0
        return -(z[cell] - math.copysign(l1, z[cell])) / ((beta + math.sqrt(n[cell])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(30):
            x = {**dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True)), bias: 1.0}
            w = {(s, c): weight((s, c)) for s in x for c in range(classes)}
            e = [math.exp(sum(v * w[s, c] for s, v in x.items())) for c in range(classes)]
            for s, v in x.items():
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y[i]))
                    sigma = (math.sqrt(n[s, c] + g * g) - math.sqrt(n[s, c])) / alpha
                    z[s, c] += g - sigma * w[s, c]
                    n[s, c] += g * g
    got = langid.ftrl(rows, y, classes, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    for s in [*range(12), bias]:
        assert np.allclose(got[s], [weight((s, c)) for c in range(classes)], atol=1e-9)
    assert not got[12:bias].any()


def test_language_scores_from_frequencies(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, rng.randint(1, 20)) + (" ñandú" if i % 2 else " Öl 7"), "ab"[i % 2]) for i in range(60)] + [(60, "12", "a")]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))
    grams = [dict(langid.ngrams([t])).get(0) for _, t, _ in docs]
    lettered = [set(g.tolist()) for g in grams if g is not None]
    df = Counter(s for g in lettered for s in g)
    idf = {s: math.log((1 + len(lettered)) / (1 + df[s])) + 1 for s in df}
    names, scores = model.predict([t for _, t, _ in docs])
    for k in range(60):
        x = {s: (1 + math.log(c)) * idf[s] for s, c in Counter(grams[k].tolist()).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[s, c] for s, v in x.items()) + model.weights[-1, c]) / model.temperature for c in range(2)]
        p = 1 / (1 + math.exp(min(z) - max(z)))
        assert abs(scores[k] - p) < 1e-9 and names[k] == model.languages[z.index(max(z))]
    assert names[60] == "und" and scores[60] == 0
