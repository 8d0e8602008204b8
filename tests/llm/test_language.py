"""Language ID where one language fills the vocabulary."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from poolcall.llm.language import SMOOTH, Model, Unseen, identify, learn, letter_words

DDL = "doc_id bigint, text string, lang string"


def test_a_rare_language_beside_a_full_vocabulary(spark):
    """Two rows of ten thousand are Polish; English alone has more words than the model keeps."""
    rng = random.Random(6)
    letters = "abcdefghijklmnop"
    english = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12_000)]
    rows = [(k, " ".join(rng.choice(english) for _ in range(12)), "en") for k in range(9_998)]
    polish = ["źrebię żółwie łąka wśród gęśli jaźń", "chrząszcz brzmi w trzcinie wśród łąk"]
    rows += [(20_000 + k, t, "pl") for k, t in enumerate(polish)]
    model = learn(spark.createDataFrame(rows, DDL).repartition(5), vocabulary=4_000)
    assert model.languages == ["en", "pl"] and len(model.words) <= 4_000
    asked = spark.createDataFrame([(1, "żółwie wśród łąk", None), (2, " ".join(english[:5]), "pl"), (3, "gęślami jaźnią", None), (4, "", None)], DDL)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(asked, model).collect()}
    assert got == {1: "pl", 2: "en", 3: "pl", 4: "und"}


def test_counts_and_scores_against_plain_python(spark):
    """All words fit: logs and posteriors are those of counting in one place; partitions do not matter."""
    rng = random.Random(7)
    words = {lang: [f"{lang}{'abcdefgh'[k]}{'xyz'[k % 3]}" for k in range(8)] + ["common"] for lang in ("de", "fr", "sv")}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k, lang in enumerate(rng.choices(["de", "fr", "sv"], [6, 3, 1], k=60))]
    rows += [(100, None, "de"), (101, "words without language", None), (102, "12 ½", "xx")]
    counts = {lang: Counter(w for _, t, x in rows if x == lang for w in letter_words(t)) for lang in ("de", "fr", "sv")}
    kinds = len(set().union(*counts.values()))
    logs = {w: np.array([np.log((c[w] + SMOOTH) / (sum(c.values()) + SMOOTH * kinds)) for c in counts.values()]) for w in set().union(*counts.values())}
    models = [learn(spark.createDataFrame(rows, DDL).repartition(n)) for n in (1, 7)]
    for m in models:
        assert m.languages == ["de", "fr", "sv"] and set(m.words) == set(logs)
        assert all(np.allclose(m.word_logs[m.words[w]], v) for w, v in logs.items())
    for _, t, _ in rows[:20]:
        total = sum(logs[w] for w in letter_words(t))
        p = np.exp(total - total.max())
        for m in models:
            lang, score = m.predict(t, Unseen(m))
            assert lang == ["de", "fr", "sv"][int(np.argmax(total))] and abs(score - p.max() / p.sum()) < 1e-9


def test_unseen_words_beyond_the_table(monkeypatch):
    """A table of few rows is started anew within a text; scores are those of summing word by word."""
    from poolcall.llm import language
    m = Model(["a", "b"], {"kilo": [3, 0], "lima": [0, 2]}, [5, 4], 4)
    text = "kilo kilometer limabean okapi kilt kilometer lime milk oil lima ¼x 語"

    def slow(w):
        for n in range(language.LONGEST, 0, -1):
            hit = [m.gram_logs[n - 1][m.grams[n - 1][g]] for g in language.n_grams(w, n) if g in m.grams[n - 1]]
            if hit:
                return sum(hit) / len(hit)
        return 0.0

    total = sum(m.word_logs[m.words[w]] if w in m.words else slow(w) for w in letter_words(text))
    p = np.exp(total - total.max())
    for room in (1, 3, 200_000):
        monkeypatch.setattr(language, "CACHE", room)
        unseen = Unseen(m)
        for _ in range(2):
            lang, score = m.predict(text, unseen)
            assert lang == m.languages[int(np.argmax(total))] and abs(score - p.max() / p.sum()) < 1e-12
        assert len(unseen.rows) <= room
