"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its loss mask is the intersection of
the sorted spans of assistant turns with the token spans, found by binary search. Marks are added
tokens of their own, so no token spans a turn's border.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: An escape puts one more backslash between "<" and "|", so texts never hold "<|" and it can be undone.
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)
SCHEMA = "conv_id long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation: what ``render`` was given."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def intersect(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that overlap a span, and the parts of the spans that those tokens cover.

    ``offsets`` has the sorted (begin, end) of each token; tokens of one split character share theirs.
    """
    mask = np.zeros(len(offsets), bool)
    covered: list[tuple[int, int]] = []
    begins, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
        if lo < hi and a < b:
            mask[lo:hi] = True
            covered.append((max(a, int(begins[lo])), min(b, int(ends[hi - 1]))))
    return mask, covered


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, END)])
    return found


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _format(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                encoded = tokenizer.encode_batch([m[0] for m in made], add_special_tokens=False)
                ids = [np.array(e.ids, np.int32) for e in encoded]
                met = [intersect(spans, np.array(e.offsets, np.int64).reshape(-1, 2)) for (_, spans), e in zip(made, encoded, strict=True)]
                edges = [np.array(covered, np.int64).reshape(-1, 2) for _, covered in met]
                columns = [ids, [mask for mask, _ in met], [e[:, 0] for e in edges], [e[:, 1] for e in edges]]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([m[0] for m in made], pa.string()), *map(_lists, columns)], ["conv_id", "formatted", "token_ids", "loss_mask", "loss_starts", "loss_ends"])

    return run


def format_chats(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation: formatted text, token ids, loss mask per token, loss spans in code points.

    ``rows`` has conv_id, turn, role, text. Turns are ordered by turn, rows of the same turn by role and
    text; repeated rows are turns of their own. Null roles and texts are empty, a null turn comes first
    and rows of a null conv_id are one conversation. No rows give no conversations; other columns are
    not read. A conversation is one output value, so its turns meet in one task by nature.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return map_batches(whole, _format(tokenizer), SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, starts, ends in zip(*(batch.column(n).to_pylist() for n in ("formatted", "loss_starts", "loss_ends")), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
            sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
            rows.append((len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(formatted)))
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: turns, and the text under the loss spans, as digests."""
    return map_batches(formatted, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
