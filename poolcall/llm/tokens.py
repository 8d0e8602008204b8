"""Token counts of a unigram tokenizer, without making the tokens."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from poolcall.llm.common import map_texts

VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed by the tokenizer: an unknown character scores this much below the worst piece
CACHE = 400_000  # words that a task remembers
LONE = re.compile(f"(?<=[^{SPACE_MARK}])(?={SPACE_MARK})")  # before a run of marks that follows another character


def read_vocabulary(path: str = VOCABULARY_FILE) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(k), sp.get_score(k)) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]


class Counting:
    """Best score and piece count of a segment: dynamic programming over the pieces that an Aho-Corasick automaton finds.

    Matches come by end position, longest first. Only a strictly better score replaces an earlier one, so of equal ways to
    reach a position the one whose last piece is longest wins, as in the tokenizer, which extends paths by start position.
    A character that is no piece of its own may also be taken as unknown; it counts as its UTF-8 bytes with byte fallback,
    else a run of unknown characters counts as one token."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        # A run of unknown characters is one token without byte fallback, so it must not be cut inside: an unknown mark would be in it.
        self.cuttable = not any(LONE.search(p) for p, _ in vocabulary) and (byte_fallback or SPACE_MARK in self.single)
        self.cache: dict[str, tuple[int, float]] = {}

    def segment(self, s: str) -> tuple[int, float]:
        n = len(s)
        best, count, open_run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unknowns(upto):  # close the positions before the next match
            for e in range(done + 1, upto + 1):
                c = s[e - 1]
                if c not in self.single and best[e - 1] is not None:
                    score = best[e - 1] + self.unknown
                    if best[e] is None or score > best[e]:
                        best[e] = score
                        count[e] = count[e - 1] + (len(c.encode()) if self.byte_fallback else not open_run[e - 1])
                        open_run[e] = True

        if len(self.automaton):
            for end, (length, score) in self.automaton.iter(s):
                end += 1
                if end - 1 > done:
                    unknowns(end - 1)
                    done = end - 1
                start = end - length
                if best[start] is not None and (best[end] is None or best[start] + score > best[end]):
                    best[end], count[end], open_run[end] = best[start] + score, count[start] + 1, False
        unknowns(n)
        return int(count[n]), best[n]

    def text(self, text: str | None, split: bool = True) -> tuple[int, float]:
        """Tokens and score of a whole text: spaces become marks and one stands at the front.

        With ``split`` every mark starts a piece of its own, as in a tokenizer that splits at marks first. Without it pieces may hold
        marks anywhere: the text is cut only where no piece of the vocabulary can reach across, before a mark that follows another
        character, if no piece has a mark there; else it is one stretch."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE_MARK)
        if not split:
            return self._sum(LONE.split(SPACE_MARK + marked) if self.cuttable else [SPACE_MARK + marked])
        parts = marked.split(SPACE_MARK)
        return self._sum(SPACE_MARK + p for k, p in enumerate(parts) if k or p)  # a text that starts with a space has its mark

    def _sum(self, stretches) -> tuple[int, float]:
        tokens, total, cache = 0, 0.0, self.cache
        for p in stretches:
            got = cache.get(p)
            if got is None:
                got = self.segment(p)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(p) <= 65:
                    cache[p] = got
            tokens += got[0]
            total += got[1]
        return tokens, total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, score)``: tokens of each whole text and the best path's score.

    Null and empty texts have none. Repeated rows and null ids come out as they went in; further columns are ignored. Runs of spaces
    may be pieces. A text is counted in stretches of a run of spaces and the word after it (the whole text if some piece reaches from
    a word into the space after it), in memory that grows with the longest stretch."""
    held: list[Counting] = []

    def count(text):
        if not held:
            held.append(Counting(vocabulary, byte_fallback))  # once a task
        return held[0].text(text, split=False)

    return map_texts(docs, count, "n_tokens bigint, score double", "doc_id")
