"""Language ID by known words first, then by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import map_batches, map_texts
from poolcall.scaling import rank_in_groups
from poolcall.session import collect_bounded, cut

VOCABULARY = 60_000  # words of the model, dealt evenly to the languages: each has its own most frequent ones
LEAST_WORDS = 500  # of each language, however many there are
LANGUAGES = 2_000  # more lang values than that are an error, so the model's size has a bound
LONGEST = 5  # characters of the longest n-gram, word edges included
SMOOTH = 0.5
UNKNOWN = "und"
CACHE = 200_000  # unseen words whose scores a task remembers, fewer with many languages
CACHE_CELLS = 1 << 22  # of that table

LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; digits of any kind (fractions and raised ones too) end a run."""
    words = LETTERS.findall(text.lower()) if text else []
    if not words or "".join(words).isalpha():
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def n_grams(word: str, n: int) -> list[str]:
    edged = f"^{word}$"
    return [edged[k:k + n] for k in range(len(edged) - n + 1)] if n > 1 else list(word)


class Unseen:
    """Scores of words that a model does not know, a row each in a table of bounded size; it starts empty in every task."""

    def __init__(self, model: Model):
        self.model, self.room = model, max(1, min(CACHE, CACHE_CELLS // max(1, len(model.languages))))
        self.rows: dict[str, int] = {}  # -1 where no letter is known
        self.logs: np.ndarray | None = None

    def total(self, words: list[str], times: np.ndarray) -> np.ndarray | float:
        """Sum of the scores of different ``words``, each as often as ``times`` says; words of unknown letters add nothing."""
        out = 0.0
        for k in range(0, len(words), self.room):
            part, often = words[k:k + self.room], times[k:k + self.room]
            new = [w for w in part if w not in self.rows]
            if len(self.rows) + len(new) > self.room:
                self.rows, new = {}, part
            if new:
                self._add(new)
            at = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
            out = out + often[at >= 0] @ self.logs[at[at >= 0]]
        return out

    def _add(self, new: list[str]) -> None:
        scores, lost = self.model.backed_off(new)
        if self.logs is None:
            self.logs = np.empty((self.room, scores.shape[1]))
        start = len(self.rows)
        self.logs[start:start + len(new)] = scores
        self.rows.update(zip(new, range(start, start + len(new))))
        self.rows.update((new[k], -1) for k in lost)


class Model:
    """Log frequencies by language of words and of n-grams; a bounded value that travels with the tasks."""

    def __init__(self, languages: list[str], words: dict[str, list[int]], totals: list[int], seen: int | None = None):
        """``words`` has the counts by language of the words kept; ``totals`` count all words of a language and ``seen``
        the different ones, kept or not."""
        self.languages = languages
        self.prior = int(np.argmax(totals)) if totals else 0
        self.words = {w: k for k, w in enumerate(words)}
        counts = np.array(list(words.values()), float).reshape(len(words), len(languages))
        self.word_logs = self._logs(counts, np.array(totals, float), seen)
        self.grams: list[dict[str, int]] = []
        self.gram_logs: list[np.ndarray] = []
        for n in range(1, LONGEST + 1):
            found: dict[str, int] = {}
            rows, cols = [], []
            for k, w in enumerate(words):
                for g in n_grams(w, n):
                    rows.append(found.setdefault(g, len(found)))
                    cols.append(k)
            made = np.zeros((len(found), len(languages)))
            np.add.at(made, rows, counts[cols])
            self.grams.append(found)
            self.gram_logs.append(self._logs(made, made.sum(0)))

    @staticmethod
    def _logs(counts: np.ndarray, totals: np.ndarray, kinds: int | None = None) -> np.ndarray:
        return np.log((counts + SMOOTH) / (totals + SMOOTH * max(1, kinds or len(counts))))

    def backed_off(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Mean log frequency of each word's longest known n-grams; numbers of the words of which not one letter is known."""
        out, left = np.zeros((len(words), len(self.languages))), list(range(len(words)))
        for n in range(LONGEST, 0, -1):
            find = self.grams[n - 1].get
            found, sizes, who, still = [], [], [], []
            for k in left:
                ids = [g for g in map(find, n_grams(words[k], n)) if g is not None]
                if ids:
                    found += ids
                    sizes.append(len(ids))
                    who.append(k)
                else:
                    still.append(k)
            if who:
                out[who] = np.add.reduceat(self.gram_logs[n - 1][found], np.cumsum([0, *sizes[:-1]]), 0) / np.array(sizes)[:, None]
            left = still
        return out, left

    def predict(self, text: str | None, unseen: Unseen | None = None) -> tuple[str, float]:
        """Language and posterior; ``unseen`` keeps scores from text to text, without it each text has a table of its own."""
        words = letter_words(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        counts = Counter(words)
        ids = np.fromiter(map(self.words.get, counts, repeat(-1)), np.int64, len(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        known = ids >= 0
        total = times[known] @ self.word_logs[ids[known]]
        if not known.all():
            total = total + (unseen or Unseen(self)).total(list(compress(counts, ~known)), times[~known])
        if not total.any():
            return self.languages[self.prior], 1 / len(self.languages)
        p = np.exp(total - total.max())
        return self.languages[int(np.argmax(total))], float(min(1.0, p.max() / p.sum()))


def learn(labelled: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """Count the words of all rows of ``labelled(text, lang)``. Languages, their totals and the number of different words
    come from all of them; the model keeps the most frequent words of each language, ``vocabulary`` shared out evenly
    (``LEAST_WORDS`` at least), with their counts in every language, and takes n-grams from those. So a language that
    fills a ten-thousandth of the rows has as many words to be known by as any other. A word past that bound is
    scored by its n-grams.

    Counts are combined batch by batch before they are shuffled and ranked in blocks of a global order; the driver sees the
    model alone, whose size depends on ``vocabulary`` and the number of languages, which is checked."""
    def count(texts, languages):
        found: dict[str, Counter] = {}
        for t, lang in zip(texts, languages):
            found.setdefault(lang, Counter()).update(letter_words(t))
        return ([w for c in found.values() for w in c], [lang for lang, c in found.items() for _ in c], [n for c in found.values() for n in c.values()])

    counts = map_batches(labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"), count, "word string, lang string, n bigint")
    counts = cut(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in collect_bounded(counts.groupBy("lang").agg(F.sum("n").alias("n")), LANGUAGES)}
    languages = sorted(totals)
    if not languages:
        return Model([], {}, [])
    quota = max(LEAST_WORDS, vocabulary // len(languages))
    kept = rank_in_groups(counts, ["lang"], [F.desc("n"), F.col("word")]).filter(F.col("rank_") <= quota).select("word").distinct()
    by_word = counts.join(kept, "word", "left_semi").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    words = {r["word"]: [r["by"].get(lang, 0) for lang in languages] for r in collect_bounded(by_word, quota * len(languages))}
    seen = counts.select(F.count_distinct("word")).first()[0]
    return Model(languages, dict(sorted(words.items())), [totals[lang] for lang in languages], seen)


def held_out(doc_id: str = "doc_id"):
    """Rows that the model must not learn from: crc32 of the id as text leaves 2 when divided by 4; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, lang_pred, score)``: the language of each whole text and its posterior.

    Equal scores go to the language that sorts first. ``und`` with score 0 if the text is null or has no letter, or nothing was
    learnt. Repeated rows and null ids come out as they went in; further columns are ignored."""
    unseen = Unseen(model)
    return map_texts(docs, lambda t: model.predict(t, unseen), "lang_pred string, score double", "doc_id")


def identify_held_out(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """Learn from the rows that are not held out and predict every row: ``(doc_id, held_out, lang_pred, score)``.

    Rows without text or lang teach nothing and are predicted like any other; with no row to learn from every language is
    ``und``. Repeated rows count as often as they stand there; texts of any length are read whole, word by word."""
    model = learn(docs.filter(~held_out()).select("text", "lang"), vocabulary)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
