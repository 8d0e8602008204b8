"""Fill-in-middle transformation: an indexable skip list finds both cuts of a text."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from poolcall.llm.common import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
FANOUT = 32  # nodes that one node of the next lane passes over
BLOCK = 1 << 20  # code points looked at together
SPM_SHARE, PLAIN_FROM = 20, 90  # of 100
RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class SkipList:
    """Units of a text (runs of ASCII letters, other code points one by one) under express lanes.

    The lowest lane holds the code points of each unit; a node of a higher lane passes over ``FANOUT`` nodes of the lane
    below and carries both its widths, in units and in code points. :meth:`seek` runs along a lane while the width in
    units fits, then goes one lane down, so it looks at about ``FANOUT`` nodes per lane."""

    def __init__(self, text: str):
        self.lanes = [(np.ones(len(w := unit_widths(text)), np.int64), w)]
        while len(self.lanes[-1][0]) > FANOUT:
            at = np.arange(0, len(self.lanes[-1][0]), FANOUT)
            self.lanes.append(tuple(np.add.reduceat(w, at) for w in self.lanes[-1]))
        self.n = len(self.lanes[0][0])

    def seek(self, rank: int) -> int:
        """Code points before unit ``rank`` (0 to n)."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = units = points = 0
        for unit_width, point_width in reversed(self.lanes):
            while node < len(unit_width) and units + unit_width[node] <= rank:
                units, points, node = units + int(unit_width[node]), points + int(point_width[node]), node + 1
            node *= FANOUT
        return points


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, block by block; a run of letters may go on over the edge of a block."""
    starts, open_run = [], False
    for k in range(0, len(text), BLOCK):
        c = np.frombuffer(text[k:k + BLOCK].encode("utf-32-le"), np.uint32) | np.uint32(32)
        letter = (c >= 97) & (c <= 122)  # with bit 32 set, exactly A-Z and a-z lie here
        first = ~(letter & np.r_[open_run, letter[:-1]])
        starts.append(np.flatnonzero(first) + k)
        open_run = bool(letter[-1])
    return np.diff(np.concatenate(starts), append=len(text)) if starts else np.empty(0, np.int64)


def draws(key: object, seed: int = 1) -> list[int]:
    """Four numbers below 2**32 that depend on ``seed`` and the document's id alone."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str | None, key: object, seed: int = 1) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one document."""
    text = text or ""
    units = SkipList(text)
    h = draws(key, seed)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= PLAIN_FROM:
        return units.n, "plain", None, None, text
    a, b = (units.seek(r) for r in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_SHARE:
        return units.n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return units.n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text again. No mark overlaps itself or another, so its first place after the one before is where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError("the output does not begin with its mark")
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n, form, prefix_chars, middle_chars, output, restored)``, row by row.

    Cuts lie between units; their ranks and the form are drawn from ``seed`` and doc_id, so a rerun gives the same rows
    and repeated rows come out alike. A null text counts as empty, an empty text and one that holds a mark stay plain
    (null cuts). A null doc_id draws as an empty id. ``restored`` is rebuilt from output and form alone. Texts of any
    length are cut whole, one at a time; other columns are ignored. No shuffle."""

    def one(doc_id, text):
        made = transform(text, doc_id, seed)
        return (*made, restore(made[4], made[1]))

    return map_texts(docs, one, RESULT + ", restored string", "doc_id", with_key=True)
