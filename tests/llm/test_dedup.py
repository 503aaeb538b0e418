import collections
import hashlib
import random

import numpy as np
import pytest

from quillstone.llm import exact, graph, near, substring, templates
from quillstone.llm.decontamination import word_hashes

from .conftest import PAD, rows, words


def test_exact_against_groups(spark, weird):
    groups = collections.defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact.exact_duplicates(weird, keep=keep, leaves=7, fan_in=3, flush=2).collect()
        assert len(got) == len(rows())
        for r in got:
            own = next(ids for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            named = [i for i in own if i is not None]
            assert r["group_size"] == len(own)
            assert r["keep_id"] == (pick(named) if named else None)
        assert sum(r["kept"] for r in got) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_exact_over_any_partitions(spark, parts):
    """Runs of several flushes are merged however many partitions they come from."""
    rng = random.Random(parts)
    docs = [(i, f"text {rng.randrange(20)}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).repartition(parts)
    sizes = collections.Counter(t for _, t in docs)
    last = {t: i for i, t in docs}
    for leaves in (1, 256):
        got = exact.exact_duplicates(df, keep="largest", leaves=leaves, flush=4).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, last[t], sizes[t]) for i, t in docs}
        assert sum(r["kept"] for r in got) == len(sizes)


def test_exact_drop_hands_on_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 5, "d"), (2, "a", 6, "e"), (2, "a", 7, "f"), (3, "b", 8, "g")], "doc_id long, text string, ident int, digest string")
    got = exact.drop_exact_duplicates(df, keep="largest")
    assert got.columns == df.columns
    assert [(r["doc_id"], r["text"]) for r in got.orderBy("doc_id").collect()] == [(2, "a"), (3, "b")]


def test_exact_drop_keeps_one_row_of_each_text(spark, weird, nothing):
    got = exact.drop_exact_duplicates(weird, keep="largest")
    assert got.columns == weird.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows()})
    assert exact.drop_exact_duplicates(nothing).count() == 0 == exact.exact_duplicates(nothing).count()


def test_merge_keeps_unequal_checks_apart():
    a = np.zeros((3, exact.WORDS), np.uint64)
    a[:, exact.COUNT] = 1
    a[2, 4] = 9  # same digest, other length
    a[:, exact.ORDER] = [5, 3, 1]
    out = exact.merge([a[:1], a[1:2], a[2:]])
    assert [(int(r[exact.ORDER]), int(r[exact.COUNT])) for r in out] == [(3, 2), (1, 1)]


def copies(seed, n=60):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(n):
        base = words(rng, rng.randint(5, 120)).split()
        out.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(len(other))] = words(rng, 1)
            out.append((i, " ".join(other)))
            i += 1
    return out


def classes_by_force(docs, similarity=0.8):
    kmers, same = {}, {}
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in docs:
        h, _ = word_hashes([t])
        kmers[i] = near._kmers(h)
        key = tuple(h.tolist()) or t
        parent[top(i)] = top(same.setdefault(key, i))
    for a, _ in docs:
        for b, _ in docs:
            if a < b and len(kmers[a]) and len(kmers[b]) and top(a) != top(b) and align_by_force(kmers[a], kmers[b]) >= similarity:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i, _ in docs}


def align_by_force(a, b):
    """Longest common subsequence by the textbook table, as a share of the union."""
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return 0.0
    row = np.zeros(len(b) + 1, int)
    for x in a:
        cand = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.r_[0, np.maximum.accumulate(cand)]
    return row[-1] / (len(a) + len(b) - row[-1])


def test_near_classes_against_all_pairs(spark):
    docs = copies(4)
    want = classes_by_force(docs)
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    mine = collections.defaultdict(set)
    theirs = collections.defaultdict(set)
    for r in got:
        mine[r["class_id"]].add(r["doc_id"])
    for i, c in want.items():
        theirs[c].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert all(min(v) == k for k, v in mine.items())
    assert sum(r["kept"] for r in got) == len(theirs)


def test_near_group_around_a_hidden_text(spark):
    """Copies of a text that isn't in the table, many of them too far from the hub: blocks find their links."""
    rng = random.Random(8)
    base = words(rng, 150).split()
    docs = []
    for i in range(150):
        other = list(base)
        for _ in range(rng.randint(1, 9)):
            other[rng.randrange(len(other))] = words(rng, 1)
        docs.append((i, " ".join(other)))
    want = collections.Counter(classes_by_force(docs).values())
    got = collections.Counter(r["class_id"] for r in near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert sorted(got.values()) == sorted(want.values())


def test_near_alignment_is_the_longest_chain():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a = near.label(rng.integers(0, 40, rng.integers(5, 40)).astype(np.uint64))
        b = near.label(np.r_[a[: len(a) // 2][::-1], a[len(a) // 2 :]] if rng.random() < 0.3 else np.delete(a, rng.integers(0, len(a), 2)))
        exactly = align_by_force(a, b)
        assert abs(near.aligned(a, b, 0.8) - exactly) < 1e-12 or (exactly < 0.8 and near.aligned(a, b, 0.8) == 0.0)


def test_near_defined_results(spark, weird, nothing):
    got = near.near_duplicates(weird)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["class_id"]].append(r["doc_id"])
    assert got.count() == len(rows())
    assert sorted(by[0], key=str) == [0, 1, 1, 2, None]
    assert sorted(by[3], key=str) == [3, 4, None]  # null and empty texts are equal
    assert near.near_duplicates(nothing).count() == 0
    left = near.drop_near_duplicates(weird)
    assert left.columns == weird.columns
    assert {r["doc_id"] for r in left.collect()} == {0, 3, 5, 6, 7, 8, 9, None}
    assert near.drop_near_duplicates(nothing).count() == 0


def test_written_tables_can_be_dropped(spark):
    import os

    from quillstone.llm import runtime

    df = runtime.materialize(spark.range(5).toDF("a"))
    path = runtime._WRITTEN[-1].removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    runtime._WRITTEN[:] = runtime._WRITTEN[-1:]  # other tests' tables stay
    runtime.drop_written(spark)
    assert not os.path.exists(path) and not runtime._WRITTEN


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def repeats_by_force(docs, window=20):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in first:
                gone |= set(range(k, k + window))
            else:
                first[key] = True
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, nothing):
    rng = random.Random(5)
    passages = [words(rng, rng.randint(15, 70)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 40)) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((i, " \n".join(parts)))
    docs += [(200, " ".join(["same"] * 90)), (201, None), (202, ""), (203, "a\x0bb\x1cc")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for rows_, chars in ((df, 900), (df.coalesce(1), 1 << 21), (df.where("doc_id > 150"), 50)):
        got = {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in substring.remove_repeats(rows_, chunk_chars=chars).collect()}
        assert got == {i: v for i, v in repeats_by_force(docs).items() if i in got} and len(got) == rows_.count()
    assert substring.remove_repeats(nothing).count() == 0


def test_repeats_of_odd_rows(spark, weird):
    got = substring.remove_repeats(weird).collect()
    assert len(got) == len(rows())
    of = collections.defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r["n_removed"])
    assert sorted(of[6]) == [0, 60_000] and sorted(of[1]) == [200, 200] and of[0] == [0]
    assert sorted(of[None]) == [0, 200] and of[3] == [0]
    assert next(r["kept_text"] for r in got if r["doc_id"] == 7) == "one"


def test_difference_cover_has_every_shift():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_template_lines(spark, weird, nothing, monkeypatch):
    rng = random.Random(2)
    docs = []
    for i in range(30):
        lines = [f"Order number {i} was shipped to {words(rng, 1)} on time today", words(rng, 12), "", "short one"]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(i, t, "en", "s", 0, *PAD) for i, t in docs], weird.schema)
    got = {r["doc_id"]: r for r in templates.drop_template_lines(df, min_docs=10).collect()}
    for i, t in docs:
        assert got[i]["n_lines"] == 4 and got[i]["n_removed"] == 2
        assert got[i]["kept_text"] == "\n".join(t.split("\n")[1:3])
    split = templates.drop_template_lines(df, min_docs=10)
    monkeypatch.setattr(templates, "BROADCAST_ROWS", 0)  # leaves are joined by size
    assert sorted(map(tuple, templates.drop_template_lines(df, min_docs=10).collect())) == sorted(map(tuple, split.collect()))
    odd = templates.drop_template_lines(weird, min_docs=2).collect()
    assert len(odd) == len(rows())
    assert {r["n_removed"] for r in odd if r["doc_id"] in (3, 4, 5, 7)} == {0}
    assert templates.drop_template_lines(nothing).count() == 0


def test_runs_merge_as_streams():
    """Blocks in order of their first record, of runs that overlap, give the run of all records."""
    rng = np.random.default_rng(3)
    records = rng.integers(0, 40, (3000, exact.WORDS)).astype(np.uint64)
    records[:, 1:6] = records[:, :1]
    records[:, exact.ORDER], records[:, exact.ROW], records[:, exact.COUNT] = rng.integers(0, 9, 3000), np.arange(3000), 1
    runs = [exact._sorted_run(records[k::7]) for k in range(7)]
    blocks = sorted((exact.keys(r[k : k + 5], 6)[0], i, k) for i, r in enumerate(runs) for k in range(0, len(r), 5))
    got = np.concatenate(list(exact.merge_stream(runs[i][k : k + 5] for _, i, k in blocks)))
    want = {}
    for r in records[np.lexsort((records[:, exact.ROW], records[:, exact.ORDER], records[:, 0]))].tolist():
        if r[0] in want:
            want[r[0]][exact.COUNT] += 1
        else:
            want[r[0]] = r
    assert got.tolist() == list(want.values()) and np.array_equal(exact.merge(runs), got)


def test_windows_of_equal_hashes_and_other_words_stay(monkeypatch):
    """With every 64-bit hash the same, words are still told apart: nothing goes but true repeats."""
    from quillstone.llm import textvec

    rng = random.Random(31)
    passage = words(rng, 30)
    docs = [(i, words(rng, 40) + (" " + passage if i % 3 == 0 else "")) for i in range(12)]
    chunk = substring.Chunk(np.array([1], "<i8").tobytes(), np.array([len(docs[0][1])], "<i8").tobytes(), substring.zstandard.ZstdCompressor().compress(docs[0][1].encode()))
    monkeypatch.setattr(textvec.Hasher, "of", lambda self, begin, end: np.full(len(begin), 7, np.uint64))
    assert len(np.unique(chunk.digests(np.arange(20)), axis=0)) == 20
    entries = []
    for k, own in enumerate((docs[::2], docs[1::2])):
        made = next(substring._chunks(1 << 20)(iter([substring.pa.RecordBatch.from_arrays([substring.pa.array([i for i, _ in own]), substring.pa.array([t for _, t in own])], ["doc_id", "text"])])))
        cols = {n: made.column(n) for n in ("ids", "sizes", "data")}
        batch = substring.pa.RecordBatch.from_arrays([substring.pa.array([k]), *cols.values(), substring.pa.array([[]], substring.pa.list_(substring.pa.binary()))], ["chunk", *cols, "marks"])
        entries += [b for b in substring._send_windows(1)(iter([batch])) if b.num_rows]
    later = substring._later(substring.pa.Table.from_batches(entries))
    n = sum(len(substring.unpack_places(x)) for x in later.column("places").to_pylist())
    assert n == 3 * 11  # the passage's windows of 20 words, in all documents but the first


def test_short_texts_always_meet_their_near_copies():
    """Texts of up to SHORT k-mers that are 0.8 similar share a key, whichever k-mer is the other one's alone."""
    rng = np.random.default_rng(5)
    for n in range(4, near.SHORT):
        long = near.label(rng.integers(0, 1 << 60, n + 1).astype(np.uint64))
        for k in range(n + 1):
            short = np.delete(long, k)
            assert near.aligned(long, short, 0.8) >= 0.8 - 1e-12
            assert set(near.short_keys(long).tolist()) & set(near.short_keys(short).tolist())
    assert len(near.short_keys(long[:0])) == 0 == len(near.short_keys(np.arange(9).astype(np.uint64)))
