import collections
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import chat, packing

from .conftest import rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("<|\\im_startend>ab \n"), max_size=40))
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.text(max_size=30)), max_size=6))
def test_rendered_turns_are_read_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_mask_covers_exactly_the_assistant_texts(spark):
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "  lead and 🚀 tail \n\n"), (1, 2, "assistant", ""), (1, 3, "assistant", "<|endoftext|>"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, None, "user", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df, PATH).collect()}
    loss = lambda r: [chat.unescape(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)]
    assert loss(got[1]) == ["  lead and 🚀 tail \n\n", "<|endoftext|>"]
    assert loss(got[2]) == [] and loss(got[None]) == ["x"] and loss(got[3]) == ["a", "b"]
    assert chat.parse(got[3]["formatted"]) == [("user", "first"), ("assistant", "a"), ("assistant", "b")]
    assert chat.parse(got[2]["formatted"]) == [("", "")]
    tokenizer = chat._tokenizer(PATH)
    for r in got.values():
        assert len(r["token_ids"]) == len(r["loss_mask"])
        masked = [i for i, m in zip(r["token_ids"], r["loss_mask"], strict=True) if m]
        assert tokenizer.decode(masked, skip_special_tokens=False) == "".join(chat.escape(x) for x in loss(r))
    back = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df, PATH)).collect()}
    assert back[1]["n_turns"] == 4 and back[1]["loss_chars"] == len("".join(loss(got[1])))
    assert chat.format_chats(df.limit(0), PATH).count() == 0


def test_spans_meet_tokens():
    offsets = np.array([(0, 2), (2, 2), (2, 5), (5, 9), (9, 10)])
    mask, covered = chat.intersect([(2, 4), (4, 4), (6, 10)], offsets)
    assert mask.tolist() == [False, False, True, True, True] and covered == [(2, 4), (6, 10)]
    assert chat.intersect([(0, 3)], np.empty((0, 2), int))[1] == []


def check(pieces, docs, size):
    """Each id in one piece, pieces gapless in their sequences, little padding; ids as the tokenizer gives them."""
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[i, tuple(ids)] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["token_ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["token_ids"]) == p["ids_crc32"]
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, own in by_doc.items():
        total = sum(p["length"] for p in own)
        assert total == sum(len(ids) * n for (j, ids), n in want.items() if j == i)
        if sum(n for (j, _), n in want.items() if j == i) == 1:
            ids = np.concatenate([np.frombuffer(p["token_ids"], "<u4") for p in sorted(own, key=lambda p: p["start"])])
            assert (i, tuple(ids.tolist())) in want and all(p["doc_tokens"] == len(ids) for p in own)
    padding = used = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        end = 0
        for p in own:
            assert p["offset"] == end
            end += p["length"]
        assert end <= size
        padding += 0 if end & (end - 1) == 0 else size - end
        used += end
    return padding / max(1, used)


def test_packing_against_the_tokenizer(spark, weird, nothing):
    docs = [(r[0], r[1]) for r in rows()] + [(20, "<|endoftext|> in a text"), (21, "x " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for size, windows in ((1024, 64), (64, 2), (16, 1)):
        got = [r.asDict() for r in packing.pack(df, PATH, size=size, open_windows=windows).collect()]
        assert check(got, docs, size) == 0
    assert packing.pack(weird, PATH).count() > 0
    assert packing.pack(nothing, PATH).count() == 0
    bare = packing.pack(df, PATH, keep_ids=False).where("token_ids IS NOT NULL AND sequence_id < 4611686018427387904")
    assert bare.count() == 0


def test_windows_are_bounded_and_best_fit():
    out = []
    p = packing.Packer(10, 2, lambda pieces, fill: out.append([len(x[4]) for x in pieces]))
    for n in (6, 7, 3, 9, 1):
        p.add(0, 0, n, np.zeros(n, np.uint32))
        assert len(p.fills) <= 2
    assert out[0] == [7, 3]  # 3 fits the fuller window exactly
    assert sum(map(sum, out)) + sum(len(x[4]) for w in p.rest() for x in w) == 26


def test_fast_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    for text in ("", " a  b\n\n c", "naïve 🚀 text", "<|endoftext|>x", "１２３ 中文", "\u0085   z"):
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
