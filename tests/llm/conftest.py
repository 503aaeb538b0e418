import random

import pytest

#: A table with a null identifier, null and empty texts, a very long text, repeated rows, and extra columns
#: whose names the operators use inside.
EXTRA = "kept boolean, digest string, node long, hub string, bucket int, chunk string, score double, toxicity_score string, selected string, rank int, `_id` string, `_text` string, line string, doc string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
PAD = (True, "d", 1, "h", 2, "c", 0.5, "t", "s", 3, "i", "x", "l", "d")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def rows():
    rng = random.Random(1)
    base = words(rng, 200)
    long = words(rng, 60_000)
    near = base.split()
    near[50], near[120] = "changed", "words"
    texts = [(0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "  \n "), (None, base), (None, None), (6, long), (7, "one"), (8, words(rng, 80) + " " + base), (9, "émoji 🚀 naïve ​ text with many words in it"), (6, long)]
    return [(i, t, "en", "s", len(t or ""), *PAD) for i, t in texts]


@pytest.fixture(scope="session")
def weird(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
