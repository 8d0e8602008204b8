"""N-gram Jaccard join of texts: subsets of fixed size for small sets, inverted lists for large ones."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from poolcall.llm.common import arrow_schema, map_texts, mixed, partitions_of, record_batch, slices, window_hashes, word_hashes
from poolcall.llm.components import components, in_few
from poolcall.llm.simhash import fingerprint, near_links, signed
from poolcall.session import cut

NUM, DEN = 4, 5  # similarity as a fraction: shared / all >= NUM / DEN
SMALL = 16  # the boundary between small and large is sought up to here; a set of 16 already has thousands of subsets
BUCKETS_PER_PARTITION = 4
SIGN = 40  # bits of a hash that the first look compares inside a bucket
CELL = 512  # members of a list that one task compares with as many others
ENOUGH = 0.2  # a round that links a smaller share of its pairs is the last one before the lists are scanned


def content(text: str | None) -> list[bytes]:
    """The words that count: ASCII lower-cased, as in the fingerprints."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Different shingles of a text as 64-bit values; a text of fewer words is one shingle, one without words has none."""
    words = content(text)
    return np.unique(window_hashes(word_hashes(words), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def least_shared(n: int, m: int) -> int:
    """Elements that sets of n and m must share to be linked."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _ceil(x: int, num: int, den: int) -> int:
    return -(-x * num // den)


def subset_sizes(n: int) -> list[int]:
    """Sizes of subsets that a set of n needs for its possible partners."""
    return sorted({c for m in range(_ceil(n, NUM, DEN), n * DEN // NUM + 1) if (c := least_shared(n, m)) <= min(n, m)})


def subset_count(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def boundary(sizes: dict[int, int]) -> int:
    """Largest size whose sets are joined by subsets, from the number of sets of each size: the one with the least rows.

    A small set costs its subsets. A set in the lists costs its elements (once out, once back) and the share of it that
    is sent first; that holds for sets of 0.8 of the boundary too, since their partners may lie beyond."""
    listed = lambda n: 2 * n + lead(n)
    cost = {x: sum(k * ((subset_count(n) if n <= x else 0) + (listed(n) if n >= _ceil(x + 1, NUM, DEN) else 0)) for n, k in sizes.items() if n <= DEN * SMALL // NUM + 1)
            for x in range(SMALL + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def lead(n: int) -> int:
    """Elements in hash order that the first look sends.

    At most n - ceil(0.8 n) of a set are missing in a linked one, so of the first n - ceil(0.8 n) + k at least k stand
    in both; LEAST_MET is the k that also holds from the side of the other set, which has ceil(0.8 n) or more."""
    return n - _ceil(n, NUM, DEN) + n // 10 + 1


LEAST_MET = f"({NUM} * n + {DEN - 1}) div {DEN} div 10 + 1"  # in SQL; leading elements that a set with a linked one finds elsewhere


def _read(shingle: int, prints: bool = False):
    def one(text):
        words = content(text)
        found = shingle_set(text, shingle)
        n = len(found)
        return (xxhash.xxh3_128_digest(b" ".join(words)), n, found[:lead(n)].tobytes(), found.view(np.int64).tolist() if n <= SMALL else None,
                *([signed(fingerprint(text, shingle))] if prints else []))

    return one


def _subsets(x: int):
    schema = arrow_schema("c int, p long, q long, n int, node long")

    def run(batches):
        for b in slices(batches):
            out = []
            for node, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.array(own, np.int64).view(np.uint64)
                p, q = mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D))
                for c in subset_sizes(len(own)):
                    at = np.array(list(combinations(range(len(own)), c)))
                    k = len(at)
                    out.append((np.full(k, c), p[at].sum(1, dtype=np.uint64).view(np.int64), q[at].sum(1, dtype=np.uint64).view(np.int64), np.full(k, len(own)), np.full(k, node)))
            if out:
                yield record_batch([np.concatenate(v) for v in zip(*out)], schema)

    return run


def small_links(sets: DataFrame, x: int) -> DataFrame:
    """Links among ``sets(node, n, small)`` of at most ``x`` elements.

    Two of them are linked exactly if they share a subset of the size their sizes ask for. Of the sets with one subset
    the smallest is joined to each that it is linked to; if two others are linked, both are linked to it as well, so no
    list of pairs is needed. A subset is named by its size and two 64-bit sums."""
    keyed = sets.filter(F.col("n").between(1, x)).select("node", "small").mapInArrow(_subsets(x), "c int, p long, q long, n int, node long")
    keyed = cut(keyed)
    least = keyed.groupBy("c", "p", "q").agg(F.min(F.struct("n", "node")).alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    near = keyed.join(least, ["c", "p", "q"]).filter((F.col("node") != F.col("least.node")) & (NUM * (F.col("n") + F.col("least.n")) <= (NUM + DEN) * F.col("c")))
    return near.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()


def _groups_of(place: np.ndarray, buckets: int):
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(buckets + 1))
    return ((k, order[edges[k]:edges[k + 1]]) for k in range(buckets) if edges[k + 1] > edges[k])


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(h ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)


def _bytes_of(values: np.ndarray) -> bytes:
    """Ascending node numbers, as compressed differences."""
    return zstandard.compress(np.diff(values, prepend=0).tobytes(), 1)


def _numbers_of(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.int64))


def _lead_entries(buckets: int):
    """Per batch and bucket: the signs of the leading elements and the rows they belong to."""
    schema = arrow_schema("bucket int, signs binary, nodes binary")

    def run(batches):
        for b in slices(batches, 5_000):
            own = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if not own or not (h := np.concatenate(own)).size:
                continue
            ids = b.column(0).to_numpy()
            order = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            row = np.repeat(np.arange(len(own)), [len(x) for x in own])
            out = []
            for k, at in _groups_of(_bucket_of(h, buckets), buckets):
                at = at[np.argsort(rank[row[at]], kind="stable")]
                signs = mixed(h[at]) >> np.uint64(64 - SIGN)
                out.append((k, signs.view(np.uint8).reshape(-1, 8)[:, :SIGN // 8].tobytes(), _bytes_of(ids[row[at]])))
            yield record_batch(list(zip(*out)), schema)

    return run


def _lead_counts(group: pa.Table) -> pa.Table:
    """Of one bucket: how many leading elements of each row stand in another row as well."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, SIGN // 8) for x in group.column("signs").to_pylist()]
    wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
    wide[:, :SIGN // 8] = np.concatenate(raw)
    nodes = np.concatenate([_numbers_of(x) for x in group.column("nodes").to_pylist()])
    _, inverse, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    found, shared = np.unique(nodes[count[inverse] > 1], return_counts=True)
    return pa.table({"row": found, "shared": shared})


def _element_entries(buckets: int, shingle: int):
    """Per batch and bucket: all elements of the sets and the nodes they belong to."""
    schema = arrow_schema("bucket int, hashes binary, nodes binary")

    def run(batches):
        for b in slices(batches, 2_500):
            ids = b.column(0).to_numpy()
            order = np.argsort(ids)
            packed = b.column(1).to_pylist()
            own = [shingle_set(zstandard.decompress(packed[k]).decode(), shingle) for k in order]
            if not own or not (h := np.concatenate(own)).size:
                continue
            node = np.repeat(ids[order], [len(x) for x in own])
            out = [(k, h[at].tobytes(), _bytes_of(node[at])) for k, at in _groups_of(_bucket_of(h, buckets), buckets)]
            yield record_batch(list(zip(*out)), schema)

    return run


def _shared_elements(group: pa.Table) -> pa.Table:
    """Of one bucket: the elements that stand in several sets, with their number of sets."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()])
    nodes = np.concatenate([_numbers_of(x) for x in group.column("nodes").to_pylist()])
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    df = count[inverse]
    return pa.table({"node": nodes[df > 1], "df": df[df > 1], "h": h[df > 1].view(np.int64)})


def _pack_texts(docs: DataFrame) -> DataFrame:
    """``(key, packed)``: the words that count, compressed while they are moved."""
    def one(text):
        joined = b" ".join(content(text))
        return xxhash.xxh3_128_digest(joined), zstandard.compress(joined, 1)

    return map_texts(docs, one, "key binary, packed binary")


def scan_lists(n: np.ndarray, sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among sets of different labels: for each set the inverted lists of its elements are counted."""
    elements, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_element = owner[np.argsort(inverse, kind="stable")]
    start = np.searchsorted(np.sort(inverse), np.arange(len(elements) + 1))
    own, root, links = np.split(inverse, np.cumsum(sizes)[:-1]), np.unique(label, return_inverse=True)[1], []
    for k, e in enumerate(own):
        shared = np.zeros(len(sets), np.int64)
        for c in range(0, len(e), 1024):
            first = start[e[c:c + 1024]]
            length = start[e[c:c + 1024] + 1] - first
            ends = np.cumsum(length)
            shared += np.bincount(by_element[np.arange(ends[-1]) + np.repeat(first - ends + length, length)], minlength=len(sets))
        for j in np.flatnonzero(((NUM + DEN) * shared >= NUM * (n + n[k])) & (root != root[k])):
            if root[j] != root[k]:
                links.append((k, int(j)))
                root[root == root[j]] = root[k]
    return links


def _cell_links(group: pa.Table) -> pa.Table:
    node, n, label = (group.column(c).to_numpy() for c in ("node", "n", "label"))
    found = scan_lists(n, [np.frombuffer(x, np.int64) for x in group.column("packed").to_pylist()], label)
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs(x, y)`` the linked ones, by counting shared elements."""
    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(v, np.int64) for v in b.column(c).to_pylist()] for c in (2, 3))
            total = b.column(4).to_numpy()
            shared = np.array([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y)], np.int64)
            at = np.flatnonzero((NUM + DEN) * shared >= NUM * total)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["a", "b"])

    of = lambda c: sets.select(F.col("node").alias(c), F.col("packed").alias(f"{c}_set"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(of("y"), "y").join(of("x"), "x")
    return both.select("x", "y", "x_set", "y_set", F.expr("x_n + y_n").alias("total")).mapInArrow(run, "a long, b long")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Of ``nodes(node, fp)`` the pairs (x, y) by which fingerprints link them: nodes of one fingerprint with the first of
    them, and the first ones of fingerprints that differ in three bits or fewer, found by pigeonhole blocks."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    of = lambda c, name: first.select(F.col("fp").alias(c), F.col("first").alias(name))
    return same.unionAll(near_links(first.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y"))


def list_links(sets: DataFrame, given: DataFrame | None = None) -> DataFrame | None:
    """Links among ``sets(node, n, shared)`` that connect what all links connect; ``shared`` holds the elements (df, h)
    found in several sets, rarest first. A written table of ``given`` pairs (x, y) is checked before any list is looked at.

    A set is filed in the list of each element of its prefix in that order: elements found nowhere else come first, so
    ``p`` and ``q`` of them are used up before a list is made. Linked sets meet in a list, the larger with its first
    n - ceil(0.8 n) + 1 elements and the smaller with its first n - ceil(8 n / 9) + 1. Each round compares one member
    of each list, another each time, with those not yet connected with it, and goes on from the stars of what is connected. When a round finds little, the lists that are
    still open (three members or more) are scanned in cells of bounded size, in which all members are compared without
    any list of pairs."""
    n, alone = F.col("n"), F.col("n") - F.size("shared")
    p, q = n - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}") + 1, n - F.expr(f"({2 * NUM} * n + {NUM + DEN - 1}) div {NUM + DEN}") + 1
    ranked = sets.select("node", "n", "shared", (p - alone).cast("int").alias("p"), (q - alone).alias("q")).filter("p > 0")
    packed = cut(ranked.select("node", "n", "p", "q", "shared").mapInArrow(_pack_sets, "node long, n long, prefix array<long>, q long, packed binary"))
    filed = packed.select("node", "n", "q", F.posexplode("prefix").alias("at", "key")).select("key", "node", "n", (F.col("at") < F.col("q")).alias("filed"))
    lists = filed.join(filed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("filed").alias("any")).filter("k > 1 AND any").select("key"), "key", "left_semi")
    at, links, turn = cut(lists.withColumn("label", F.col("node"))), None, 0
    rows = at.count()
    fits = lambda a, b: ((NUM * F.greatest(f"{a}n", f"{b}n") <= DEN * F.least(f"{a}n", f"{b}n"))
                         & F.when(F.col(f"{a}n") >= F.col(f"{b}n"), F.col(f"{b}filed")).otherwise(F.col(f"{a}filed")))
    while True:
        pairs = given
        if pairs is None:
            turned = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "filed", "label")
            chosen = at.groupBy("key").agg(F.min(turned).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
            chosen = in_few(chosen, rows).select("key", F.col("c.node").alias("x"), F.col("c.n").alias("x_n"), F.col("c.filed").alias("x_filed"), F.col("c.label").alias("x_label"))
            met = at.select("key", F.col("node").alias("y"), F.col("n").alias("y_n"), F.col("filed").alias("y_filed"), "label").join(chosen, "key")
            pairs = cut(in_few(met.filter(F.expr("label <> x_label") & fits("x_", "y_")).select("x", "y").distinct(), rows))
        found = cut(_linked(pairs, packed))
        new, tried = found.count(), pairs.count()
        if new:
            linked = found if links is None else links.unionAll(found)
            roots, turn = cut(components(linked, linked.count())), turn + 1
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            at = cut(lists.join(roots, "node", "left").select("key", "node", "n", "filed", F.coalesce("root", "node").alias("label")))
        if given is None and (new < ENOUGH * tried or not new):
            break
        given = None
    found = cut(_cells(at, packed))
    return links if found.isEmpty() else found if links is None else links.unionAll(found)


def _pack_sets(batches):
    for b in batches:
        shared = b.column(4)
        h, at = shared.values.field("h").to_numpy(), shared.offsets.to_numpy()
        own = [h[at[k]:at[k + 1]] for k in range(b.num_rows)]
        prefix = [x[:p].tolist() for x, p in zip(own, b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prefix, pa.list_(pa.int64())), b.column(3), pa.array([x.tobytes() for x in own], pa.binary())],
                                         names=["node", "n", "prefix", "q", "packed"])


def _cells(at: DataFrame, packed: DataFrame) -> DataFrame:
    """Links inside lists whose members are still apart. Lists of the same members are scanned once.

    The members outside the list's largest group are dealt over parts, and so is that group. Every two parts of the
    former meet in a cell, and each of them meets each part of the group; two members of the group are never compared."""
    labels = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("first"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    open_ = labels.groupBy("key").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("main"), F.min("first").alias("first"), F.sum("mark").alias("mark"))
    once = open_.filter("k > 2 AND most < k").groupBy("k", "first", "mark").agg(F.min(F.struct("key", "main", "most")).alias("o")).select("o.*", (F.col("k") - F.col("o.most")).alias("rest"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / CELL), F.lit(1).cast("bigint"))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), parts(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("node"), parts(c))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    outside = F.concat(F.transform(upto("rest"), lambda j: cell(0, F.least(own("rest"), j), F.greatest(own("rest"), j))), F.transform(upto("most"), lambda j: cell(1, own("rest"), j)))
    inside = F.transform(upto("rest"), lambda i: cell(1, i, own("most")))
    member = at.join(once, "key").withColumn("cell", F.explode(F.when(F.col("label") == F.col("main"), inside).otherwise(outside))).select("key", "cell", "node", "label")
    return member.join(packed.select("node", "n", "packed"), "node").groupBy("key", "cell").applyInArrow(_cell_links, "a long, b long")


def shingle_classes(docs: DataFrame, shingle: int = 5, prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` to ``rows(doc_id, key, n, row)`` and ``classes(key, root)``: texts of the same words share a
    key, and keys have the same root if links lead from one to the other. A text without words has a key but no root.

    With ``prints`` the lists start from the pairs that fingerprints of the texts link, as far as those are linked by
    their sets; the classes are the same."""
    buckets = BUCKETS_PER_PARTITION * partitions_of(docs.sparkSession)
    ddl = "key binary, n bigint, lead binary, small array<bigint>" + ", fp bigint" * prints
    rows = cut(map_texts(docs, _read(shingle, prints), ddl, "doc_id").withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(rows.filter("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("small").alias("small"), *[F.first("fp").alias("fp")] * prints))
    given = cut(print_pairs(nodes.select("node", "fp"))) if prints else None
    x = boundary({r["n"]: r["count"] for r in nodes.filter(F.col("n") <= DEN * SMALL // NUM + 1).groupBy("n").count().collect()})
    links = cut(small_links(nodes, x))
    listed = F.col("n") >= _ceil(x + 1, NUM, DEN)
    counted = (rows.filter(listed).select("row", "lead").mapInArrow(_lead_entries(buckets), "bucket int, signs binary, nodes binary")
               .groupBy("bucket").applyInArrow(_lead_counts, "row long, shared long").groupBy("row").agg(F.sum("shared").alias("shared")))
    near = nodes.join(counted.withColumnRenamed("row", "node"), "node").filter(F.col("shared") >= F.expr(LEAST_MET)).select("key", "node", "n")
    texts = _pack_texts(docs).groupBy("key").agg(F.first("packed").alias("packed"))
    sets = cut(texts.join(near, "key").select("node", "n", "packed"))
    shared = (sets.select("node", "packed").mapInArrow(_element_entries(buckets, shingle), "bucket int, hashes binary, nodes binary")
              .groupBy("bucket").applyInArrow(_shared_elements, "node long, df long, h long")
              .groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared")))
    found = list_links(cut(shared.join(sets.select("node", "n"), "node").filter(NUM * F.col("n") <= DEN * F.size("shared"))), given)
    links = links if found is None else links.unionAll(found)
    roots = components(links, links.count())
    return rows.select("doc_id", "key", "n", "row"), nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id)``: texts whose sets of word shingles have at least
    four fifths of their union in common are linked; component_id is the smallest doc_id reachable, itself included.

    Words are lower-cased in A-Z only; a text of fewer words than ``shingle`` is one shingle. Null, empty and blank
    texts have an empty set and no links. Rows without doc_id take no part; rows that share one are linked text by text,
    and each comes out. Texts of any length are read whole; other columns are ignored.

    Texts of the same words are one node. Sets up to a size chosen by cost are joined by their subsets. For larger ones
    a first look sends the leading elements of each set in hash order: linked sets must share more than a quarter
    of them, so most texts leave at once. The rest send all their elements, learn which are found in several sets, and
    are filed by their rarest ones. An element is a 64-bit value; only elements of two sets are ever compared, so
    chance equality does not grow with the corpus."""
    rows, classes = shingle_classes(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shingle)
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "key", "row").join(classes, "key", "left").withColumn("root", F.coalesce("root", "row"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "root").select("doc_id", "n_shingles", "component_id")
