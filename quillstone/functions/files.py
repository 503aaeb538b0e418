"""Text files that packs and documents are kept in: marked regions, document markers, names, identifiers."""

from __future__ import annotations

import os
import re
import secrets
import time

from .canonical import document_address
from .text import BRANCH_NAME

BEGIN, END = "<!-- quillstone:begin -->", "<!-- quillstone:end -->"
_REGION = re.compile(re.escape(BEGIN) + r"\n.*?" + re.escape(END) + r"\n?", re.S)
_MARKER = re.compile(r"^<!-- document ([a-z0-9/_-]+) (b3:[0-9a-f]{64}) -->\n")
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def splice(existing: str, block: str) -> str:
    """``existing`` with its marked region replaced, or the region added at the end; the rest is untouched."""
    region = f"{BEGIN}\n{block.rstrip()}\n{END}\n"
    if _REGION.search(existing):
        return _REGION.sub(lambda _: region, existing, count=1)
    return f"{existing.rstrip()}\n\n{region}" if existing.strip() else region


def current_block(existing: str) -> str | None:
    found = _REGION.search(existing)
    return found[0].removeprefix(BEGIN + "\n").rstrip("\n").removesuffix(END).rstrip() if found else None


def write_if_changed(path: str, text: str) -> bool:
    """Replace the file as a whole; nothing is written if it has the text already."""
    try:
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)
    return True


def document_file(branch: str, body: str) -> str:
    return f"<!-- document {branch} {document_address(body)} -->\n{body}\n"


def document_state(text: str) -> tuple[str | None, bool]:
    """(branch, edited by hand): whether the body still has the address that its marker states."""
    found = _MARKER.match(text)
    if not found:
        return None, True
    return found[1], document_address(text[found.end() :]) != found[2]


def refresh_document(path: str, branch: str, body: str) -> str:
    """Write a document's file: written, unchanged, or edited (then it is left alone)."""
    try:
        with open(path, encoding="utf-8") as f:
            if document_state(f.read())[1]:
                return "edited"
    except FileNotFoundError:
        pass
    return "written" if write_if_changed(path, document_file(branch, body)) else "unchanged"


def parse_inherits(text: str) -> tuple[str, list[str]]:
    """branch:kind,kind"""
    branch, _, kinds = text.partition(":")
    return branch.strip(), [k.strip() for k in kinds.split(",") if k.strip()]


def resolve_branch(name: str | None, known: list[str], default: str) -> str:
    """A full branch name: none is the default, a name with a slash is itself, a lane is the default project's, or
    the only branch with that lane."""
    if not name:
        return default
    if "/" in name:
        if not BRANCH_NAME.fullmatch(name):
            raise ValueError(f"invalid branch name {name!r}")
        return name
    own = f"{default.partition('/')[0]}/{name}"
    if own in known:
        return own
    found = [b for b in known if b.rpartition("/")[2] == name]
    if len(found) == 1:
        return found[0]
    if found:
        raise ValueError(f"{name!r} could be {', '.join(sorted(found))}")
    return name


def idea_branch(idea: str) -> str:
    """The research branch of an idea's name."""
    if "/" in idea:
        return idea
    return re.sub("[^a-z0-9]+", "-", idea.lower()).strip("-") + "/research"


def new_id(at: float | None = None, after: str | None = None) -> str:
    """A 26-character id that sorts by time; one more than ``after`` if that is of the same millisecond or later."""
    ms = int((time.time() if at is None else at) * 1000)
    number = ms << 80 | secrets.randbits(80)
    if after is not None and (last := decode_id(after)) >> 80 >= ms:
        number = last + 1
    return "".join(_BASE32[number >> 5 * k & 31] for k in range(25, -1, -1))


def decode_id(text: str) -> int:
    out = 0
    for c in text:
        out = out << 5 | _BASE32.index(c)
    return out
