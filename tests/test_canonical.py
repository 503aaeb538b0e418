import tracemalloc

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from quillstone.functions import canonical as c
from quillstone.functions.blake3 import blake3

# Addresses that other implementations of the canonical form must reproduce.
GOLDEN = [
    (("fact", "hello"), "b3:ef5c7ba58908aa7aa4d1cf7f2d3011d40beeede4d51537e621ec5ed9f3350d0f"),
    (("constraint", "line one\n  indented two\nline three"), "b3:938d7c14cf862cd0dc4f598a0fd9c593b7045e4cc99d162f4604ecc4f143f624"),
    (("rejected", "“Covenants” — rejected; it’s too slow"), "b3:a7ee6724b5ff15af1c72ed85d9727c08acc093146566eb8e095fcc5b29236aff"),
    (("fact", "10 ms budget"), "b3:336c585fb432305a64f27263b8223abf02f6fa63a23d2c7b63cc23b23e8484ab"),
    (("claim", 'tab\there "quoted" back\\slash \x01 del\x7f'), "b3:64e242c6c9e7d951cf2ac4a2fb19d3d0a02e5121c42de7512f5db30356568476"),
    (("question", "Ship the \U0001f680 before Q4?", None, (), ("\U0001f680",)), "b3:c22f360fa43f4c365c333f2af3880284e526336e7dfce4fa7987e76a3db6c572"),
    (("fact", "café", None, (), ("Café",)), "b3:b1b9c2bc5e3b2f15cd796a704c9c0552918c6830b3058465a77575ee81bad49d"),
]


@pytest.mark.parametrize(("args", "expected"), GOLDEN)
def test_golden_addresses(args, expected):
    assert c.claim_address(*args) == expected


def test_document_address():
    assert c.document_address("# Spec\n\nBuild it.") == "b3:85dc6e887b400e1986ea0a09195d1913f4528a3a83fd66339d96b6716543b9c5"


def test_equal_content_has_one_address():
    same = [("fact", "a\nb"), ("fact", "a\r\nb"), ("fact", "a\rb"), ("fact", "a  \nb \n\n"), ("fact", "a\nb", "")]
    assert len({c.claim_address(*x) for x in same}) == 1
    assert c.claim_address("fact", "café") == c.claim_address("fact", "café")
    assert c.claim_address("fact", "x", None, ["b", "a", "a"], ["T", "s"]) == c.claim_address("fact", "x", None, ["a", "b"], ["s", "t"])
    assert c.claim_address("fact", "x") != c.claim_address("claim", "x")


def test_blake3_lengths():
    # of the published test vectors: input bytes count up modulo 251
    data = bytes(i % 251 for i in range(10_000))
    assert blake3([b""])[0] == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3([data[:1]])[0] == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert blake3([data[:1024]])[0] == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3([data[:1025]])[0] == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert blake3([data[:n] for n in (0, 1, 1024, 1025, 5000)]) == [blake3([data[:n]])[0] for n in (0, 1, 1024, 1025, 5000)]


def test_addresses_are_made_of_few_bytes_at_once(monkeypatch):
    """Whatever a batch holds, so a task's memory doesn't grow with its text."""
    lines = [bytes([i % 251]) * n for i, n in enumerate([0, 1, 5000, 70_000, 1023, 3, 9000, 0])]
    want, sizes = c.address(lines), []
    hashed = c.blake3
    monkeypatch.setattr(c, "blake3", lambda data: sizes.append(sum(map(len, data))) or hashed(data))
    for together in (1, 4000, 1 << 20):
        sizes.clear()
        monkeypatch.setattr(c, "TOGETHER", together)
        assert list(c.addresses(iter(lines))) == want
        assert max(sizes) <= together + 70_000
    assert list(c.addresses([])) == []
    monkeypatch.undo()
    tracemalloc.start()
    assert len(list(c.addresses(bytes([k % 251]) * 50_000 for k in range(1000)))) == 1000  # 50 MB in all
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_addresses_of_columns(spark):
    rows = [(i, ("fact", None)[i % 7 == 6], (f"text {i} \r\n", None, "é" * i)[i % 3], (None, "", "why")[i % 3], (None, [], ["b", "a", ""])[i % 3], (["T", "s"], None)[i % 2]) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, kind string, text string, why string, refs array<string>, entities array<string>").coalesce(1)
    got = {r["i"]: (r["cid"], r["d"]) for r in c.with_address(df).withColumn("d", c.document_addresses("text")).select("i", "cid", "d").collect()}
    assert got == {i: (c.claim_address(k, t or "", w, r or (), e or ()), c.document_address(t or "")) for i, k, t, w, r, e in rows}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\n\r  　é"), max_size=30))
def test_normalisation_is_idempotent(text):
    once = c.normalize_text(text)
    assert c.normalize_text(once) == once
    assert not once.endswith("\n")


def test_column_normalisation_equals_the_function(spark):
    texts = ["a \r\nb \r\n\r\n", "café  \nx", "", "\n\n", "a \nb", "x\ty\t", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", c.normalized("t").alias("n")).collect()}
    assert got == {i: None if t is None else c.normalize_text(t) for i, t in enumerate(texts)}


def test_merkle_shape_and_distributed_root(spark):
    cids = [c.claim_address("fact", str(i)) for i in range(5)]
    assert [len(x) for x in c.merkle_levels(cids)] == [5, 3, 2, 1]
    assert c.merkle_root(cids) == c.merkle_root(cids[::-1] + cids)
    rows = [("g", x) for x in cids] + [("h", c.claim_address("fact", f"h{i}")) for i in range(9000)]
    df = spark.createDataFrame(rows, "branch string, cid string")
    got = {r["branch"]: (r["root"], r["n"]) for r in c.merkle_roots(df, ["branch"]).collect()}
    for g in ("g", "h"):
        own = [x for b, x in rows if b == g]
        assert got[g] == (c.merkle_root(own), len(own))
    assert c.merkle_root([]) == "b3:" + blake3([b""])[0]
