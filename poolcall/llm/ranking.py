"""Ranked lexical search by classes of equal documents: bags over the items' vocabulary are scored once."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from poolcall.llm.common import arrow_schema, map_texts, record_batch, slices
from poolcall.scaling import running_totals
from poolcall.session import collect_bounded, cut

SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
TERMS_A_PASS = 200_000  # vocabulary that a task holds; a larger one is looked up in several passes over the documents
ITEMS_A_BLOCK = 1_000  # items scored together
CELLS = 4_000_000  # entries of a dense block of classes by terms
EXACT = 1 << 53  # whole numbers below it are exact in doubles


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return text.encode().lower().translate(SEPARATORS).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to ``(item_id, term, times)``."""
    found = map_texts(items.filter("item_id IS NOT NULL"), lambda t: (list(Counter(terms_of(t)).items()),), "terms array<struct<term:binary,times:bigint>>", "item_id")
    return found.select("item_id", F.explode("terms").alias("t")).groupBy("item_id", F.col("t.term").alias("term")).agg(F.sum("t.times").alias("times"))


def _bags(docs: DataFrame, words: dict[bytes, int], keys: list[str]) -> DataFrame:
    """Each document's length in all terms, and its counts of the terms in ``words`` by term number."""

    def one(text):
        found = Counter(terms_of(text))
        return sum(found.values()), np.array(sorted((words[t], k) for t, k in found.items() if t in words), np.int32).tobytes()

    return map_texts(docs, one, "n bigint, bag binary", *keys)


def bags(docs: DataFrame, vocabulary: DataFrame, at_once: int = TERMS_A_PASS) -> tuple[DataFrame, int]:
    """``(doc_id, n, bag)`` for ``docs(doc_id, text)``, and the size of the vocabulary; ``bag`` is pairs of int32 (term
    number, tf) in order.

    ``vocabulary(term, number)`` is read in parts of ``at_once`` terms, so no task holds more of it than that. With
    several parts the documents are numbered in a written table and read once for each; the parts of a bag are joined
    in order of their term numbers."""
    total = vocabulary.count()
    words = lambda k: {bytes(r["term"]): r["number"] for r in collect_bounded(vocabulary.filter(F.col("number").between(k, k + at_once - 1)), at_once)}
    if total <= at_once:
        return cut(_bags(docs, words(0), ["doc_id"])), total
    docs, whole = cut(docs.withColumn("row", F.monotonically_increasing_id())), None
    for k in range(0, total, at_once):
        part = _bags(docs, words(k), ["row", "doc_id"]).withColumn("part", F.lit(k))
        whole = part if whole is None else whole.unionAll(part)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "bag"))), lambda x: F.hex(x["bag"]))
    joined = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.unhex(F.array_join(ordered, "")).alias("bag"))
    return cut(joined.select("doc_id", "n", "bag")), total


def _frequencies(vectors: DataFrame) -> DataFrame:
    """``(number, df)``: each batch counts its documents first."""
    schema = arrow_schema("number long, df long")

    def run(batches):
        for b in batches:
            numbers = [np.frombuffer(x, np.int32)[::2] for x in b.column(0).to_pylist()]
            if numbers:
                yield record_batch(np.unique(np.concatenate(numbers), return_counts=True), schema)

    return vectors.select("bag").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


def _class_scores(used: np.ndarray, weights: np.ndarray, items: np.ndarray, asked: np.ndarray, keep: int):
    """Best classes of each batch for each item of a block: ``used`` terms in order, their weights, and how often each
    item asks for each of them."""
    whole = bool((weights.astype(float) @ asked * 1e6 < EXACT).all())  # a term's part is below 1,000,000 times its weight
    asked = asked if whole else asked.astype(np.int64)
    schema = arrow_schema("item_id long, class long, first long, score long")

    def run(batches):
        for b in slices(batches, max(1, CELLS // max(1, len(used)))):
            if not b.num_rows:
                continue
            ids, first, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            pairs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in b.column(3).to_pylist()]
            row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
            term, tf = np.concatenate(pairs).astype(np.int64).T
            k = np.minimum(np.searchsorted(used, term), len(used) - 1)
            hit = used[k] == term
            row, k, tf = row[hit], k[hit], tf[hit]
            part = np.zeros((len(pairs), len(used)), asked.dtype)
            part[row, k] = weights[k] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            scores = (part @ asked).astype(np.int64)
            out = []
            for i, item in enumerate(items):
                good = np.flatnonzero(scores[:, i] > 0)
                if len(good) > keep:  # all that reach the score in place ``keep``, ties included
                    good = good[scores[good, i] >= -np.partition(-scores[good, i], keep - 1)[keep - 1]]
                best = good[np.lexsort((first[good], -scores[good, i]))[:keep]]
                out.append((np.full(len(best), item), ids[best], first[best], scores[best, i]))
            yield record_batch([np.concatenate(c) for c in zip(*out)], schema)

    return run


def _top(df: DataFrame, order: str, keep: int) -> DataFrame:
    """The ``keep`` best rows of each item; Spark keeps as many of each task before it sends them."""
    w = W.partitionBy("item_id").orderBy(F.desc("score"), order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def rank_documents(docs: DataFrame, items: DataFrame, keep: int = 10, terms_a_pass: int = TERMS_A_PASS, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """``docs(doc_id, text)`` and ``items(item_id, text)`` to ``(item_id, rank, doc_id, score)``, the ``keep`` best
    documents of each item with a score above zero, equal scores by ascending doc_id.

    Documents shrink to their counts of the items' terms. Those with the same counts and the same length norm m form a
    class (grouped by hash, told apart by the values themselves), which is scored once; the best ``keep`` classes by
    (score, smallest doc_id) hold the best ``keep`` documents, and their members come out by ascending doc_id.

    Null and empty texts have no terms: such a document counts in neither N nor L, such an item has no rows. Rows
    without doc_id count in N, L and df and are never returned; items without item_id are left out, rows of one item_id
    are read as one item, and a repeated document comes out as often as it stands there. Texts are read whole. Other
    columns are ignored. Items are the query set: they go to the tasks in blocks, their terms in parts of bounded size."""
    asked = cut(item_terms(items))
    number = lambda df, by: running_totals(df, [F.col(by)], {"number": F.lit(1)}).select(by, (F.col("number") - 1).cast("bigint").alias("number"))
    vocabulary = cut(number(asked.select("term").distinct(), "term"))
    listed = cut(number(asked.select("item_id").distinct(), "item_id").withColumnRenamed("number", "place"))
    vectors, size = bags(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), vocabulary, terms_a_pass)
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not n_docs or not size:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.coalesce("df", F.lit(0)) + 1))).cast("bigint")
    asked = cut(asked.join(vocabulary, "term").join(_frequencies(vectors), "number", "left").join(listed, "item_id").select("place", "item_id", "number", "times", weight.alias("w")))
    m = 100 - 75 + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    held = vectors.filter("doc_id IS NOT NULL AND length(bag) > 0").select("doc_id", m.cast("bigint").alias("m"), "bag")
    classes = cut(held.groupBy(F.xxhash64("m", "bag").alias("h"), "m", "bag").agg(F.min("doc_id").alias("first")).withColumn("class", F.monotonically_increasing_id()))
    best = None
    for k in range(0, listed.count(), items_a_block):
        own = asked.filter(F.col("place").between(k, k + items_a_block - 1)).toPandas()
        used, at = np.unique(own.number.to_numpy(np.int64), return_index=True)
        ids, column = np.unique(own.item_id.to_numpy(np.int64), return_inverse=True)
        times = np.zeros((len(used), len(ids)))
        times[np.searchsorted(used, own.number), column] = own.times
        run = _class_scores(used, own.w.to_numpy(np.int64)[at], ids, times, keep)
        found = _top(classes.select("class", "first", "m", "bag").mapInArrow(run, "item_id long, class long, first long, score long"), "first", keep).drop("rank")
        best = found if best is None else best.unionAll(found)
    best = cut(best.select("item_id", "class", "score"))
    wanted = classes.join(best.select("class").distinct(), "class", "left_semi").select("h", "m", "bag", "class")
    member = held.withColumn("h", F.xxhash64("m", "bag")).join(wanted, ["h", "m", "bag"]).select("class", "doc_id")
    first = member.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("doc_id"))).filter(F.col("r") <= keep).drop("r")
    return _top(best.join(first, "class"), "doc_id", keep).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
