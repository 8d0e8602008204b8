"""Quality rules by line sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import map_texts, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
REPEAT_WINDOW = 5
CONTENT_SHARE = 0.5
FIT_DOCS = 1500  # labelled documents that the field is fitted on, about
FIT_LINES = 128  # longer documents are left out of the fit (never out of the verdict)

# Upper edges of the bins of each line feature; a value falls into the first bin whose edge it does not reach.
EDGES = {
    "letters": (0.5, 0.7, 0.8, 0.9, 0.97), "upper": (0.02, 0.1, 0.3, 0.6), "symbols": (1e-9, 0.02, 0.05, 0.1, 0.2),
    "digits": (1e-9, 0.05, 0.2, 0.5), "marks": (0.02, 0.05, 0.1, 0.2), "words": (2, 4, 8, 16, 32, 64), "length": (3, 4, 5, 6, 8, 12),
    "again": (0.05, 0.2, 0.5), "copied": (0.5,), "filed": (0.05, 0.2, 0.5),
}
OFFSETS = np.cumsum([0] + [len(e) + 1 for e in EDGES.values()])
N_FEATURES = int(OFFSETS[-1])

LETTER, UPPER, DIGIT, SPACE, SYMBOL, MARK = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        t[c] = LETTER * ch.isalpha() | UPPER * ch.isupper() | DIGIT * ch.isdigit() | SPACE * (c == 32 or 9 <= c <= 13) | SYMBOL * (ch in SYMBOLS) | MARK * (ch in "!?.,;:\"'()[]{}/\\=+-_~@^")
    return t


CLASSES = _classes()


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and words in repeated five-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    x = word_hashes(text.encode().split())
    lines = [ln for ln in text.split("\n") if ln.strip(" \t\n\x0b\x0c\r")]
    return (len(x), len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"), sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), int(repeated_words(x).sum()))


def repeated_words(x: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Whether each word stands in a window found twice or more."""
    h = window_hashes(x, window)
    edge = np.zeros(len(x) + 1, np.int64)
    if len(h) > 1:
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[inverse] > 1)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each line with a word: the active feature of every group, and its words."""
    if not text.strip(" \t\n\x0b\x0c\r"):
        return np.empty((0, len(EDGES)), np.int64), np.empty(0, np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cls = np.where(cp < 256, CLASSES[np.minimum(cp, 255)], LETTER).astype(np.uint8)
    ends = np.r_[np.flatnonzero(cp == 10), len(cp)]
    starts = np.r_[0, ends[:-1] + 1]

    def per_line(mask):
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    space = (cls & SPACE) > 0
    n_words = per_line(~space & np.r_[True, space[:-1]])
    real = n_words > 0
    n_words, seen = n_words[real], (ends - starts)[real] - per_line(space)[real]
    letters = per_line((cls & LETTER) > 0)[real]
    x = word_hashes(text.encode().split())
    line_of = np.repeat(np.arange(len(n_words)), n_words)
    same = np.r_[False, (x[1:] == x[:-1]) & (line_of[1:] == line_of[:-1])]
    lines, before, copied = text.split("\n"), set(), []
    for k in np.flatnonzero(real).tolist():
        copied.append(lines[k] in before)
        before.add(lines[k])
    values = {
        "letters": letters / seen, "upper": per_line((cls & UPPER) > 0)[real] / np.maximum(letters, 1), "symbols": per_line((cls & SYMBOL) > 0)[real] / seen,
        "digits": per_line((cls & DIGIT) > 0)[real] / seen, "marks": per_line((cls & MARK) > 0)[real] / seen, "words": n_words, "length": seen / n_words,
        "again": np.bincount(line_of[same], minlength=len(n_words)) / n_words, "copied": np.array(copied, float),
        "filed": np.bincount(line_of[repeated_words(x)], minlength=len(n_words)) / n_words,
    }
    bins = np.stack([np.searchsorted(EDGES[k], v, side="right") + o for (k, v), o in zip(values.items(), OFFSETS)], axis=1)
    return bins, n_words


def fit_field(examples: list[tuple[int, np.ndarray]], rounds: int = 80, ridge: float = 1.0, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features) for content against boilerplate and the 2 x 2 transition scores, by maximum conditional likelihood.

    ``examples`` are (label, features of each line); every line of a document bears the document's label. The gradient
    comes from forward-backward over all documents at once."""
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    if len({y for y, _ in examples}) < 2:
        return w, trans  # nothing to tell apart: every line is content
    examples = sorted(examples, key=lambda e: len(e[1]))
    n, steps = len(examples), len(examples[-1][1])
    size = np.array([len(f) for _, f in examples])
    y = np.array([e[0] for e in examples])
    feats = np.zeros((n, steps, len(EDGES)), np.int64)
    for k, (_, f) in enumerate(examples):
        feats[k, :len(f)] = f
    live = np.arange(steps)[None, :] < size[:, None]
    first = [int(np.searchsorted(size, t, side="right")) for t in range(steps)]  # documents from here on have a line t
    params, m, v = np.zeros(N_FEATURES + 4), 0.0, 0.0
    hot = np.bincount(feats[live].ravel(), np.repeat(y[np.nonzero(live)[0]], len(EDGES)), N_FEATURES)
    gold = np.zeros((2, 2))
    np.add.at(gold, (y, y), size - 1)
    for step in range(1, rounds + 1):
        w, trans = params[:-4], params[-4:].reshape(2, 2)
        emit = np.zeros((n, steps, 2))
        emit[:, :, 1] = w[feats].sum(2)
        ahead, behind = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, steps):
            a = first[t]
            ahead[a:, t] = emit[a:, t] + np.logaddexp.reduce(ahead[a:, t - 1, :, None] + trans[None], axis=1)
        for t in range(steps - 2, -1, -1):
            a = first[t + 1]
            behind[a:, t] = np.logaddexp.reduce(trans[None] + (emit[a:, t + 1] + behind[a:, t + 1])[:, None, :], axis=2)
        norm = np.logaddexp.reduce(ahead[np.arange(n), size - 1], axis=1)
        p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm[:, None])
        pair = np.zeros((2, 2))
        for t in range(1, steps):
            a = first[t]
            pair += np.exp(ahead[a:, t - 1, :, None] + trans[None] + (emit[a:, t] + behind[a:, t])[:, None, :] - norm[a:, None, None]).sum(0)
        seen = np.bincount(feats[live].ravel(), np.repeat(p[live], len(EDGES)), N_FEATURES)
        grad = (np.r_[hot - seen, (gold - pair).ravel()] - ridge * params) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def decode(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Viterbi: the best labels (1 content) for the lines' content scores; ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    a, b, back = 0.0, 0.0, []
    for k, s in enumerate(scores.tolist()):
        if k:
            z0, z1, o0, o1 = a + t00, b + t10, a + t01, b + t11
            back.append((z1 >= z0, o1 >= o0))
            a, b = max(z0, z1), max(o0, o1) + s
        else:
            b = s
    label = b >= a
    out = [label]
    for to_0, to_1 in reversed(back):
        label = to_1 if label else to_0
        out.append(label)
    return np.array(out[::-1], bool)


def fit_sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> list[tuple[int, np.ndarray]]:
    """Features of about ``fit_docs`` labelled documents, drawn by a hash of doc_id."""
    good = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = good.count()
    if not n:
        return []
    span = 1 << 20
    drawn = good.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(span)) < F.lit(min(span, -(-span * fit_docs // n))))
    few = F.broadcast(drawn.groupBy("doc_id").agg(F.max("quality").alias("quality")))  # about fit_docs rows, whatever the table
    rows = docs.select("doc_id", "text").join(few, "doc_id").filter("text IS NOT NULL")

    def features(text):
        bins, _ = line_features(text)
        return (bins.astype(np.uint8).tobytes() if 0 < len(bins) <= FIT_LINES else None,)

    made = map_texts(rows, features, "bins binary", "doc_id", "quality").filter("bins IS NOT NULL").orderBy("doc_id").collect()
    return [(r["quality"], np.frombuffer(r["bins"], np.uint8).reshape(-1, len(EDGES)).astype(np.int64)) for r in made]


RESULT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
          "kept boolean, n_lines bigint, n_content_lines bigint, content_share double")


def judge(text: str | None, w: np.ndarray, trans: np.ndarray, share: float = CONTENT_SHARE) -> tuple:
    n, chars, symbols, dups, repeats = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    if not n:
        return n, chars, symbols, dups, repeats, failed, False, 0, 0, 0.0
    bins, words = line_features(text)
    content = decode(w[bins].sum(1), trans)
    part = float(words[content].sum() / n)
    return n, chars, symbols, dups, repeats, failed, not failed and part >= share, len(bins), int(content.sum()), part


def line_quality(docs: DataFrame, labels: DataFrame, carry: tuple = (), share: float = CONTENT_SHARE, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Base counts, labelled lines and verdict of every row of ``docs(doc_id, text, *carry)``.

    A document is kept if the base rules pass and its content lines hold at least ``share`` of its words. The field is
    fitted on about ``fit_docs`` documents of ``labels(doc_id, quality)`` of at most 128 lines, a bounded sample; every
    row is judged on its whole text. Without labels of both kinds every line counts as content. Null, empty and blank
    texts have zero counts and fail. Repeated rows and null ids come out as they went in; further columns are ignored."""
    w, trans = fit_field(fit_sample(docs, labels, fit_docs))
    return map_texts(docs, lambda t: judge(t, w, trans, share), RESULT, "doc_id", *carry)
