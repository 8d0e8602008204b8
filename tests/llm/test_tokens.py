"""Token counts of texts with runs of spaces, against unsplit tokenizers."""

from __future__ import annotations

import random

from poolcall.llm.tokens import Counting, count_tokens, read_vocabulary

TEXTS = ["a    b", " lead", "    indented line\n        more", "x  y   z ", "two  spaces", "table |  1 |      22 |", " ", "                    ", "plain words only"]


def unsplit(voc, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers
    bytes_ = [(f"<0x{b:02X}>", min(s for _, s in voc)) for b in range(256)] if fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *voc, *bytes_], 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never", split=False)
    return lambda text: len(t.encode(" " + text, add_special_tokens=False).ids)


def test_pieces_of_several_marks(spark):
    voc = read_vocabulary()
    assert any(p == "▁▁▁" for p, _ in voc)
    count = unsplit(voc, True)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), voc).collect()}
    assert got == {k: count(t) for k, t in enumerate(TEXTS)}
    held = Counting(voc)
    assert held.cuttable and held.text("a    b", split=False)[0] < held.text("a    b")[0]


def test_small_vocabularies_with_marks_anywhere():
    rng = random.Random(4)
    for _ in range(400):
        voc = list({"".join(rng.choice("ab▁▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(0, 4)) for _ in range(rng.randint(1, 12))}.items())
        text = "".join(rng.choice("abcd   ") for _ in range(rng.randint(1, 14)))
        for fallback in (True, False):
            assert Counting(voc, fallback).text(text, split=False)[0] == unsplit(voc, fallback)(text), (voc, text, fallback)
