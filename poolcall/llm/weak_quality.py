"""Quality classifier from weak labels: accuracies of overlapping heuristics by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import map_texts, word_hashes
from poolcall.llm.line_quality import repeated_words

ABSTAIN, BAD, GOOD = 0, 1, 2
BUCKETS = 1 << 15  # hashed features: words in the lower half, word shapes in the upper
FIT_DOCS = 12_000  # documents that the scorer is fitted on, about
FIT_WORDS = 20_000  # longer documents are left out of the fit (never out of the scores)
SHARD_DOCS = 1_000  # documents that one shard of the fit trains on, about
EPOCHS = 4

CAPITAL, SYMBOL = frozenset(range(65, 91)), frozenset(b"#*$%&|<>")
SHAPES = bytes(65 if b in CAPITAL else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 35 if b in SYMBOL else 33 if b == 33 else 46 for b in range(256))


def _vote(x: float, bad, good) -> int:
    return BAD if bad(x) else GOOD if good(x) else ABSTAIN


def votes(text: str | None) -> tuple[int, ...]:
    """What each heuristic says of a text. Each fault is seen by two or three that overlap; few speak for a text."""
    raw = text.encode() if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return (BAD,) + (ABSTAIN,) * 8
    x = word_hashes(words)
    b = np.frombuffer(raw, np.uint8)
    upper = int(((b >= 65) & (b <= 90)).sum())
    letters = int(((b >= 97) & (b <= 122)).sum()) + upper
    seen = int((b > 32).sum())
    other = seen - letters - int((b >= 128).sum())
    lines = [ln for ln in raw.split(b"\n") if ln.strip()]
    silent = lambda v: False
    return (
        _vote(n, lambda v: v < 3, silent),
        _vote(sum(text.count(c) for c in "#*$%&|<>") / n, lambda v: v > 0.1, silent),
        _vote(other / max(1, seen), lambda v: v > 0.2, lambda v: v < 0.08),
        _vote(upper / max(1, letters), lambda v: v > 0.3, silent),
        _vote(text.count("!") / n, lambda v: v > 0.3, silent),
        _vote(float((x[1:] == x[:-1]).mean()) if n > 1 else 0.0, lambda v: v > 0.1, silent),
        _vote(len(np.unique(x)) / n, lambda v: 20 <= n and v < 0.2, lambda v: n < 3000 and v > 0.4),
        _vote(sum(ln.rstrip()[-1:] in b".!?" for ln in lines) / len(lines), lambda v: v < 0.1, lambda v: v >= 0.5),
        _vote(float(repeated_words(x).mean()), lambda v: v > 0.2, lambda v: n >= 20 and v < 0.05),
    )


N_RULES = len(votes(None))


def pattern(text: str | None) -> int:
    code = 0
    for v in votes(text):
        code = 3 * code + v
    return code


def digits(code: int) -> list[int]:
    return [code // 3 ** k % 3 for k in reversed(range(N_RULES))]


def fit_labellers(counts: dict[int, int], tolerance: float = 1e-9, most: int = 10_000) -> tuple[dict[int, float], float, np.ndarray]:
    """Posterior of good for each vote pattern, the share of good, and P(vote | class) of each heuristic.

    Expectation-maximisation over pattern counts (at most 3 ** heuristics of them), from the guess that a fault seen by any is real, until the mean
    log likelihood moves by less than ``tolerance``; raises if it does not settle."""
    if not counts:
        return {}, 0.5, np.full((N_RULES, 2, 3), 1 / 3)
    codes = sorted(counts)
    v = np.array([digits(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    post, last = np.where((v == BAD).any(1), 0.1, 0.9), -np.inf
    for _ in range(most):
        share = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        theta = np.zeros((N_RULES, 2, 3))
        for k in range(N_RULES):
            for y, p in ((0, 1 - post), (1, post)):
                c = np.bincount(v[:, k], n * p, 3) + 0.1
                theta[k, y] = c / c.sum()
        logs = np.stack([np.log(theta[np.arange(N_RULES)[None], y, v]).sum(1) + np.log(share if y else 1 - share) for y in (0, 1)], 1)
        whole = np.logaddexp(logs[:, 0], logs[:, 1])
        post, now = np.exp(logs[:, 1] - whole), float((n * whole).sum() / n.sum())
        if abs(now - last) < tolerance:
            return dict(zip(codes, post.tolist())), share, theta
        last = now
    raise RuntimeError(f"labeller accuracies did not settle: the last change was {now - last}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their shares of the words: each word, its shape, and whether it repeats the last one or stands
    in a repeated five-word window."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    half = BUCKETS // 2
    x = word_hashes(words)
    shapes = word_hashes([w.translate(SHAPES)[:24] for w in words])
    same = np.r_[False, x[1:] == x[:-1]]
    habit = word_hashes([b"repeats %d" % k for k in range(4)])[same + 2 * repeated_words(x)]
    at = np.r_[x % np.uint64(half), shapes % np.uint64(half) + np.uint64(half), habit % np.uint64(half) + np.uint64(half)].astype(np.int64)
    ids, n = np.unique(at, return_counts=True)
    return ids, n / len(words)


def _train(posterior: dict[int, float], epochs: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w, g2, bias, b2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-4), 0.0, 1e-4
        texts = [t for t in rows.sort_values("doc_id")["text"].tolist()]
        made = [(*features(t), posterior.get(pattern(t), 0.5)) for t in texts]
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(made)):
                ids, x, y = made[k]
                e = 1 / (1 + np.exp(-(bias + float(w[ids] @ x)))) - y
                g = e * x + 1e-5 * w[ids]
                g2[ids] += g * g
                b2 += e * e
                w[ids] -= 0.3 * g / np.sqrt(g2[ids])
                bias -= 0.1 * e / np.sqrt(b2)
        return pd.DataFrame({"w": [np.r_[w, bias].tobytes()], "n": [len(made)]})

    return run


def fit_scorer(docs: DataFrame, posterior: dict[int, float], total: int, fit_docs: int = FIT_DOCS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and bias: each shard of a bounded sample trains on its own, their weights are averaged by documents."""
    span = 1 << 20
    part = min(span, -(-span * fit_docs // max(1, total)))
    few = docs.select("doc_id", "text").filter((F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(span)) < part) & (F.length("text") <= 10 * FIT_WORDS))
    shards = max(1, min(total, fit_docs) // SHARD_DOCS)
    dealt = few.withColumn("shard", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(shards)))
    made = dealt.groupBy("shard").applyInPandas(_train(posterior, epochs), "w binary, n long").collect()  # one row a shard
    n = sum(r["n"] for r in made)
    return sum(np.frombuffer(r["w"]) * (r["n"] / n) for r in sorted(made, key=lambda r: (r["n"], r["w"]))) if n else np.zeros(BUCKETS + 1)


def score(text: str | None, w: np.ndarray) -> float:
    ids, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[-1] + w[ids] @ x, -500, 500)))) if len(ids) else 0.0


def weak_quality(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, votes, posterior, score, good)``.

    ``votes`` has one digit a heuristic (0 abstains, 1 bad, 2 good), ``posterior`` what they say together, ``score`` the
    scorer's probability of good, ``good`` whether that is at least one half. Heuristic accuracies come from the votes of all
    rows; the scorer is fitted on about ``fit_docs`` of them, a bounded sample. Null, empty and blank texts score 0.
    Repeated rows and null ids come out as they went in; further columns are ignored; no rows give no rows."""
    counted = map_texts(docs, lambda t: (pattern(t),), "code int", "doc_id").groupBy("code").count().collect()  # at most 3 ** heuristics
    posterior, _, _ = fit_labellers({r["code"]: r["count"] for r in counted})
    w = fit_scorer(docs, posterior, sum(r["count"] for r in counted), fit_docs)

    def judge(text):
        v = votes(text)
        p = score(text, w)
        code = 0
        for d in v:
            code = 3 * code + d
        return "".join(map(str, v)), posterior.get(code, 0.5), p, p >= 0.5

    return map_texts(docs, judge, "votes string, posterior double, score double, good boolean", "doc_id")
