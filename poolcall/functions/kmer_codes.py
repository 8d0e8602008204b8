"""K-mers of ACGT text as base-4 numbers, a batch of texts at a time; used inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

LONGEST = 31  # longer k-mers do not fit a signed 64-bit number
PIECE = 1 << 20  # letters looked at together, whatever the length of a text
OTHER = 5
TURN = str.maketrans("ACGT", "TGCA")


def least_strand(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(TURN))


def codes_of(kmers: list[str], k: int) -> np.ndarray:
    """Numbers of k-mers that hold no other letters than ACGT; they sort like the texts."""
    digits = np.searchsorted(np.frombuffer(b"ACGT", np.uint8), np.frombuffer("".join(kmers).encode(), np.uint8)).reshape(-1, k)
    return digits @ (np.int64(4) ** np.arange(k - 1, -1, -1, dtype=np.int64))


def texts_of(codes: np.ndarray, k: int) -> pa.Array:
    digits = (codes[:, None] >> (2 * np.arange(k - 1, -1, -1, dtype=np.int64))) & 3
    letters = np.frombuffer(b"ACGT", np.uint8)[digits]
    return pa.Array.from_buffers(pa.large_string(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int64) * k), pa.py_buffer(letters)]).cast(pa.string())


def recoded(column: pa.Array, ascii_to: bytes, other: bytes) -> pa.Array:
    """Texts letter by letter: ASCII by the table ``ascii_to`` of 128 letters, each other character as ``other``."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    start = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw if raw is not None else b"", np.uint8)[start[0]:start[-1]]
    table = np.frombuffer(ascii_to + other * 128, np.uint8)
    leads = (data & 0xC0) != 0x80  # not the later bytes of a character
    place = np.concatenate([[0], np.cumsum(leads)]).astype(np.int64)[start - start[0]]
    made = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(table[data[leads]]))])
    return pa.compute.if_else(column.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())


def plain_windows(column: pa.Array, k: int, canonical: bool) -> tuple[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """(row, place, code) of all windows of ``k`` letters without N, in reading order and in pieces of bounded size, and the
    rows that hold other letters than ACGTN, which are left out."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    start = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw if raw is not None else b"", np.uint8)[start[0]:start[-1]]
    start = start - start[0]
    letter = np.full(256, OTHER, np.uint8)
    letter[list(b"ACGTN")] = range(5)
    odd = np.zeros(len(column), bool)
    for s in range(0, len(data), PIECE):
        at = np.flatnonzero(letter[data[s:s + PIECE]] == OTHER) + s
        odd[np.searchsorted(start, at, "right") - 1] = True
    kind = np.int32 if k <= 15 else np.int64

    def pieces():
        for s in range(0, len(data) - k + 1, PIECE):
            own = letter[data[s:s + PIECE + k - 1]]
            n = len(own) - k + 1
            barred = np.concatenate([[0], np.cumsum(own > 3, dtype=np.int32)])
            begun = start[np.searchsorted(start, s):np.searchsorted(start, s + len(own))] - s
            first = np.cumsum(np.bincount(begun, minlength=len(own)), dtype=np.int32)  # texts that start up to here
            at = np.flatnonzero((barred[k:] == barred[:n]) & (first[k - 1:] == first[:n]))
            row = np.searchsorted(start, at + s, "right") - 1
            if odd.any():
                at, row = at[~odd[row]], row[~odd[row]]
            ahead, back = np.zeros(n, kind), np.zeros(n, kind)
            for i in range(k):
                digit = own[i:i + n].astype(kind) & 3
                ahead = (ahead << 2) | digit
                if canonical:
                    back |= (3 - digit) << (2 * i)
            yield row, at + s - start[row], (np.minimum(ahead, back) if canonical else ahead)[at].astype(np.int64)

    return pieces(), np.flatnonzero(odd)


def odd_windows(text: str, k: int, canonical: bool) -> Iterator[tuple[int, str]]:
    """The same of one text with other letters, as texts."""
    for p in range(len(text) - k + 1):
        kmer = text[p:p + k]
        if "N" not in kmer:
            yield p, least_strand(kmer) if canonical else kmer


def count_windows(column: pa.Array, group: np.ndarray, groups: int, k: int, canonical: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """K-mers of the texts by group (a number per row): (group, kmers, counts), each k-mer of ACGT once."""
    found, odd = plain_windows(column, k, canonical)
    codes: list[list[np.ndarray]] = [[] for _ in range(groups)]
    times: list[list[np.ndarray]] = [[] for _ in range(groups)]
    for row, _, code in found:
        own = group[row]
        for x in np.unique(own):
            if k <= 8:
                n = np.bincount(code[own == x], minlength=4 ** k)
                c = np.flatnonzero(n)
                n = n[c]
            else:
                c, n = np.unique(code[own == x], return_counts=True)
            codes[x].append(c)
            times[x].append(n)
    for x in range(groups):
        if codes[x]:
            c, at = np.unique(np.concatenate(codes[x]), return_inverse=True)
            yield x, texts_of(c, k), np.bincount(at, np.concatenate(times[x])).astype(np.int64)
    for r in odd:
        texts = [t for _, t in odd_windows(column[int(r)].as_py(), k, canonical)]
        yield int(group[r]), pa.array(texts, pa.string()), np.ones(len(texts), np.int64)


class Votes:
    """K-mers and the number of the species each belongs to; a table of bounded size that travels with the tasks."""

    def __init__(self, kmers: list[str], species: list[int], k: int):
        self.k = k
        own = [(t, s) for t, s in zip(kmers, species) if len(t) == k]
        self.other = {t: s for t, s in own if set(t) - set("ACGT")}
        plain = [(t, s) for t, s in own if t not in self.other]
        codes, of = codes_of([t for t, _ in plain], k), np.array([s for _, s in plain], np.int32)
        order = np.argsort(codes)
        self.codes, self.species = codes[order], of[order]
        self.dense = None
        if k <= 10:
            self.dense = np.full(4 ** k, -1, np.int32)
            self.dense[self.codes] = self.species

    def of(self, code: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[code]
        if not len(self.codes):
            return np.full(len(code), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.species[at], -1)

    def first(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Species (-1: none) and place of the first known k-mer of each text."""
        vote, place = np.full(len(column), -1, np.int32), np.zeros(len(column), np.int64)
        found, odd = plain_windows(column, self.k, True)
        for row, at, code in found:
            s = self.of(code)
            hit = np.flatnonzero(s >= 0)
            rows, k = np.unique(row[hit], return_index=True)
            new = vote[rows] < 0  # a text cut by the pieces may have its vote already
            rows, hit = rows[new], hit[k[new]]
            vote[rows], place[rows] = s[hit], at[hit]
        for r in odd:
            for p, kmer in odd_windows(column[int(r)].as_py(), self.k, True):
                s = self.other.get(kmer, -1) if set(kmer) - set("ACGT") else int(self.of(codes_of([kmer], self.k))[0])
                if s >= 0:
                    vote[r], place[r] = s, p
                    break
        return vote, place
