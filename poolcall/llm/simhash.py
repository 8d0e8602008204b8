"""SimHash near-dedup by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import arrow_schema, map_texts, record_batch
from poolcall.llm.components import components
from poolcall.session import cut

BITS = 64
BUCKET = 4096  # fingerprints that one task compares with as many others


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles (ASCII lower-cased, repeats counted) under XXH64 with seed 42, as an unsigned value."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        first = (ends - lengths)[:len(words) - shingle + 1].tolist()
        digests = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, ends[shingle - 1:].tolist())]
    h = np.array(digests, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int, spare: int = 3) -> list[int]:
    """Masks of which two values at most ``distance`` bits apart share at least one.

    The bits are cut into ``distance + spare`` blocks. ``distance`` differing bits touch at most that many blocks, so
    some choice of ``spare`` blocks agrees wholly; with three spare blocks a mask keeps about half of the bits, which
    keeps chance meetings rare in very large corpora."""
    n = distance + spare
    edges = [round(k * BITS / n) for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [signed(sum(c)) for c in combinations(blocks, spare)]


def linked_groups(values: np.ndarray, distance: int) -> np.ndarray:
    """Smallest index reachable from each value over links of at most ``distance`` bits. No list of pairs is built."""
    n = len(values)
    label, before = np.arange(n), None
    while before is None or (before != label).any():
        before = label.copy()
        for k in range(0, n, 256):
            near = np.bitwise_count(values[k:k + 256, None] ^ values[None, :]) <= distance
            label[k:k + 256] = np.where(near, label[None, :], n).min(1)
        np.minimum.at(label, before, label.copy())
        label = label[label]
    return label


def _spanning_links(distance: int):
    schema = arrow_schema("a long, b long")

    def run(batches):
        for b in batches:
            lists = b.column(0)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            heads, tails = [], []
            for k in range(len(lists)):
                own = np.sort(flat[at[k]:at[k + 1]])
                if len(own) == 2:  # by far the commonest case
                    if np.bitwise_count((own[0] ^ own[1]).view(np.uint64)) <= distance:
                        heads.append(own[:1])
                        tails.append(own[1:])
                    continue
                root = linked_groups(own.view(np.uint64), distance)
                moved = root != np.arange(len(own))
                heads.append(own[root[moved]])
                tails.append(own[moved])
            if heads:
                yield record_batch([np.concatenate(heads), np.concatenate(tails)], schema)

    return run


def near_links(prints: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``prints(fp)`` of different fingerprints to links (a, b) that join exactly those reachable over pairs at most
    ``distance`` bits apart.

    Each fingerprint is filed under every block mask; those alone under their key leave at once. A key's members are
    compared in one task and come out as a spanning forest, so a group of n gives at most n - 1 links. A key with more
    than ``bucket`` members is dealt over square cells of at most twice that many, and every pair of its parts meets in
    one cell: the result is the same, no task sees the whole group, and no pairs are written."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(distance))])
    keyed = prints.select("fp", F.explode(masks).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keyed.join(sizes, ["t", "key"])
    lists = members.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    parts = F.ceil(F.col("n") / bucket)
    large = members.filter(F.col("n") > bucket).withColumn("p", F.pmod(F.xxhash64("fp"), parts)).withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    cells = large.repartition("t", "key", F.least("p", "q"), F.greatest("p", "q")).groupBy("t", "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.collect_set("fp").alias("fps")).select("fps")
    return lists.unionAll(cells).mapInArrow(_spanning_links(distance), "a long, b long").distinct()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; a null text has fingerprint zero."""
    return map_texts(docs, lambda t: (signed(fingerprint(t, shingle)),), "fp long", "doc_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)``; component_id is the smallest doc_id reachable.

    Texts with equal fingerprints are one node, so copies cost nothing beyond their own row. Null, empty and blank
    texts have fingerprint zero and are linked like any other. Rows without doc_id take no part; repeated rows come out
    as often as they went in. Other columns are ignored."""
    own = cut(fingerprints(docs.filter("doc_id IS NOT NULL"), shingle))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, all columns kept."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle, distance)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
