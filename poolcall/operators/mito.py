"""Haploid (mitochondrial) sites: spectrum, calls, site groups, haplotype discovery, consensus, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.functions.expr import log_choose
from poolcall.operators import counts as C, likelihood as L
from poolcall.session import cut

MAX_SITES = 2000
ZERO = 0.001  # chance of reading the other allele


def allele_spectrum(bases: DataFrame) -> DataFrame:
    """Two commonest alleles, their shares and the depth of each position with at least two alleles.

    ``bases`` holds (fragment, pos, base, qual); the two mates of a fragment count once at a position, the better
    base standing."""
    one = bases.groupBy("pos", "fragment").agg(F.max(F.struct("qual", "base")).alias("b"))
    n = one.groupBy("pos", "b.base").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("pos").agg(F.sum("n").alias("cov"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "base"))).alias("a"))  # at most five bases
    return g.filter(F.size("a") >= 2).select(
        "pos", F.col("a")[0]["base"].alias("major"), F.col("a")[1]["base"].alias("minor"),
        (-F.col("a")[0]["k"] / F.col("cov")).alias("freq1"), (-F.col("a")[1]["k"] / F.col("cov")).alias("freq2"), "cov")


def top_sites(spectrum: DataFrame, min_cov: float = 0.0, n: int = MAX_SITES) -> DataFrame:
    return spectrum.filter(F.col("cov") >= min_cov).orderBy(F.desc("freq2"), "pos").limit(n)


def allele_counts(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads of the major and minor allele per (barcode, pos)."""
    n = bases.groupBy("barcode", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    d = n.join(sites.select("pos", "major", "minor"), "pos")
    return d.groupBy("barcode", "pos").agg(F.sum(F.when(F.col("base") == F.col("major"), F.col("n")).otherwise(0)).alias("maj"),
                                           F.sum(F.when(F.col("base") == F.col("minor"), F.col("n")).otherwise(0)).alias("min")).filter("maj + min > 0")


def _ll(p: float) -> Column:
    return F.round(F.col("min") * F.log(F.lit(p)) + F.col("maj") * F.log(F.lit(1 - p)), 9)


def cell_haplotypes(counts: DataFrame) -> DataFrame:
    """0 or 1 where one allele is likeliest; a mixed site has no call."""
    zero, het, one = _ll(ZERO), _ll(0.5), _ll(1 - ZERO)
    call = F.when((zero > one) & (zero > het), 0).when((one > zero) & (one > het), 1)
    return counts.withColumn("allele", call).filter("allele IS NOT NULL").select("barcode", "pos", "allele")


def clean_sites(counts: DataFrame) -> DataFrame:
    """Sites whose minor-carrying cells look homozygous rather than mixed."""
    d = counts.filter(_ll(1 - ZERO) > _ll(ZERO)).groupBy("pos").agg(F.sum(_ll(1 - ZERO) - _ll(0.5)).alias("gain"))
    return d.filter(F.round("gain", 6) > 0).select("pos")


def co_occurrence(haps: DataFrame, block: int = 256) -> DataFrame:
    """Per pair of sites ``a`` before ``b``: carriers of a called at b, carriers of b called at a, and carriers of both.

    The calls of a batch of cells are multiplied as 0/1 matrices, one pair of site blocks at a time, so memory depends on the
    batch and on ``block`` alone, whatever the number of sites; Spark adds the non-zero cells of the products up, first inside each task."""
    import numpy as np
    import pandas as pd
    names = "a BIGINT, b BIGINT, seen_a BIGINT, seen_b BIGINT, both_n BIGINT"
    cells = haps.groupBy("barcode").agg(F.collect_list("pos").alias("pos"), F.collect_list("allele").alias("allele"))  # one row per cell: at most its sites

    def multiply(batches):
        for batch in batches:
            sizes = batch["pos"].map(len).to_numpy()
            if not sizes.sum():
                continue
            row = np.repeat(np.arange(len(batch)), sizes)
            sites, at = np.unique(np.concatenate(batch["pos"].to_numpy()), return_inverse=True)
            carries = np.concatenate(batch["allele"].to_numpy()) == 1
            part = at // block

            def matrix(k, rows):
                m = np.zeros((len(batch), block), np.float32)
                m[row[rows], at[rows] - k * block] = 1
                return m

            for i in range(part.max() + 1):
                ones_i, seen_i = matrix(i, (part == i) & carries), matrix(i, part == i)
                for j in range(i, part.max() + 1):
                    ones_j, seen_j = matrix(j, (part == j) & carries), matrix(j, part == j)
                    sa, sb, both = ones_i.T @ seen_j, seen_i.T @ ones_j, ones_i.T @ ones_j
                    if i == j:
                        sa, sb = np.triu(sa, 1), np.triu(sb, 1)
                    x, y = np.nonzero(sa + sb)
                    yield pd.DataFrame({"a": sites[x + i * block], "b": sites[y + j * block], "seen_a": sa[x, y].astype("int64"),
                                        "seen_b": sb[x, y].astype("int64"), "both_n": both[x, y].astype("int64")})

    part = cells.select("pos", "allele").mapInPandas(multiply, names)
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("seen_a", "seen_b", "both_n")])


def _vote(n: Column, k: Column) -> Column:
    """k of n looks like all of them rather than half or none."""
    def ll(p):
        return F.round(k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)), 9)
    return (ll(1 - ZERO) > ll(0.5)) & (ll(1 - ZERO) > ll(ZERO))


def representatives(same: DataFrame) -> DataFrame:
    """Which nodes of ``same(ra, rb)``, ``ra`` before ``rb``, a walk in rank order collapses, and into which: (rank, into).

    A node collapses into its first neighbour that stands itself; a collapsed one takes nobody in. Every round settles all
    nodes whose earlier neighbours are settled, so their number is the longest such chain, not the number of nodes."""
    same = left = cut(same.select("ra", "rb"))
    gone = None
    while not left.isEmpty():
        stands = left.select("ra").distinct().join(left.select(F.col("rb").alias("ra")).distinct(), "ra", "left_anti")
        now = cut(left.join(stands, "ra", "left_semi").select("rb").distinct())
        gone = now if gone is None else gone.unionByName(now)
        left = cut(left.join(now, "rb", "left_anti").join(now.withColumnRenamed("rb", "ra"), "ra", "left_anti"))
    if gone is None:
        return same.select(F.col("rb").alias("rank"), F.col("ra").alias("into"))
    return (same.join(gone, "rb", "left_semi").join(gone.withColumnRenamed("rb", "ra"), "ra", "left_anti")
            .groupBy(F.col("rb").alias("rank")).agg(F.min("ra").alias("into")))


def site_groups(haps: DataFrame) -> DataFrame:
    """(pos, grp, rank): sites carried by the same cells share the commonest of them that stands for itself.

    Sites are walked by falling number of carriers. One that is alike to a site which has itself joined another does not
    join through it: it stands for itself unless a standing site is alike too. ``haps(barcode, pos, allele)``; sites that nobody carries
    are left out; no rows give no rows."""
    haps = cut(haps.select("barcode", "pos", "allele"))
    size = haps.groupBy("pos").agg(F.sum("allele").alias("size")).filter("size > 0")
    order = cut(size.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "pos"))).select("pos", "rank"))  # one row per site
    same = co_occurrence(haps).filter(_vote(F.col("seen_a"), F.col("both_n")) & _vote(F.col("seen_b"), F.col("both_n")))
    a, b = (order.select(F.col("pos").alias(c), F.col("rank").alias(f"r_{c}")) for c in "ab")
    same = same.join(a, "a").join(b, "b").select(F.least("r_a", "r_b").alias("ra"), F.greatest("r_a", "r_b").alias("rb"))
    into = representatives(same)
    head = order.select(F.col("pos").alias("grp"), F.col("rank").alias("into"))
    return order.join(into, "rank", "left").withColumn("into", F.coalesce("into", "rank")).join(head, "into").select("pos", "grp", F.col("into").alias("rank"))


def group_alleles(haps: DataFrame, groups: DataFrame) -> DataFrame:
    """One allele per (group, cell): the group's first called site decides."""
    return haps.join(groups, "pos").groupBy("barcode", "grp", "rank").agg(F.min_by("allele", F.struct("pos")).alias("allele"))


# --- discovery ------------------------------------------------------------------------------------

def cluster_count(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Number of real clusters per key: the first best split of the sorted sizes into large and small (two Poisson means)."""
    w = W.partitionBy(*keys).orderBy(F.desc("size"), "prefix")
    tot = W.partitionBy(*keys)
    d = (sizes.withColumn("n", F.row_number().over(w)).withColumn("c", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double"))
         .withColumn("all_n", F.count(F.lit(1)).over(tot)).withColumn("all_c", F.sum("size").over(tot)))
    rest = F.col("all_c") - F.col("c")
    ll = F.col("c") * F.log(F.col("c") / F.col("n")) - F.col("c") + F.when(rest > 0, rest * F.log(rest / (F.col("all_n") - F.col("n"))) - rest).otherwise(0.0)
    d = d.withColumn("ll", F.round(ll, 6)).withColumn("next", F.lead("ll").over(w))
    return d.filter("next IS NULL OR next < ll").groupBy(*keys).agg(F.min("n").alias("clusters"))


def prefix_sizes(group_calls: DataFrame, keys: list[str], max_len: int | None = None) -> DataFrame:
    """Cells per allele prefix of every length at once, over groups by falling size; a cell without a call leaves from there on."""
    calls = group_calls if max_len is None else group_calls.filter(F.col("ord") <= max_len)
    cell = calls.groupBy(*keys, "barcode").agg(F.array_sort(F.collect_list(F.struct("ord", "allele"))).alias("a"))  # at most MAX_SITES groups
    run = F.filter("a", lambda x, k: x["ord"] == k + 1)  # the unbroken start
    text = F.array_join(F.transform(run, lambda x: x["allele"].cast("string")), "")
    p = cell.withColumn("t", text).filter(F.length("t") > 0).select(*keys, "barcode", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("t")), lambda n: F.struct(n.alias("len"), F.substring(F.col("t"), F.lit(1), n).alias("prefix")))).alias("x"))
    return p.groupBy(*keys, "x.len", "x.prefix").agg(F.count(F.lit(1)).alias("size"))


def discover(group_calls: DataFrame, keys: list[str] | None = None, max_len: int = 16) -> DataFrame:
    """Haplotypes per key: the longest prefixes before the cluster count first falls: (keys, hap, prefix, size).

    All lengths are counted in one job; only when a key has not stopped within ``max_len`` groups is it doubled."""
    keys = keys or []
    group_calls = cut(group_calls)  # read for the number of groups and for every length tried
    n_groups = group_calls.agg(F.max("ord").alias("m")).first().m
    while True:
        sizes = cut(prefix_sizes(group_calls, keys, max_len))
        nc = cluster_count(sizes, [*keys, "len"])
        prev = F.lag("clusters").over(W.partitionBy(*keys).orderBy("len"))
        nc = cut(nc.withColumn("falls", F.coalesce(F.col("clusters") < prev, F.lit(False))))
        stop = nc.groupBy(*keys).agg(F.min(F.when(F.col("falls"), F.col("len"))).alias("at"), F.max("len").alias("last"))
        if max_len >= n_groups or stop.filter(f"at IS NULL AND last >= {max_len}").isEmpty():
            break
        max_len *= 2
    pick = stop.select(*keys, F.coalesce(F.col("at") - 1, F.col("last")).alias("len")).join(nc.select(*keys, "len", "clusters"), [*keys, "len"])
    d = sizes.join(pick, [*keys, "len"]).withColumn("hap", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("size"), "prefix")) - 1)
    return d.filter(F.col("hap") < F.col("clusters")).select(*keys, "hap", "prefix", "size")


def haplotype_sites(haps: DataFrame, groups: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys, hap, pos, allele) over all sites of the groups a prefix spells."""
    d = haps.select(*keys, "hap", F.posexplode(F.split("prefix", "")).alias("k", "c")).select(*keys, "hap", (F.col("k") + 1).alias("ord"), F.col("c").cast("int").alias("allele"))
    return d.join(groups.select("pos", "ord"), "ord").select(*keys, "hap", "pos", "allele")


def assign(counts: DataFrame, hap_sites: DataFrame, doublet_rate: float = 0.5) -> DataFrame:
    """Call each cell against the haplotypes: the genotype path with homozygous members."""
    cs = counts.select("barcode", F.col("pos").alias("site_id"), (F.col("maj") * 1000000).alias("ref_w"), (F.col("min") * 1000000).alias("alt_w"))
    g = hap_sites.select(F.col("pos").alias("site_id"), F.col("hap").alias("sample"), (F.col("allele") * 2).alias("nalt"))
    return L.call_cells(C.pair_counts(cs, g), ZERO, ZERO, doublet_rate)


def discover_and_assign(counts: DataFrame, doublet_rate: float = 0.5):
    """Discovery, then trailing groups are dropped until the cells' summed LLR falls or none is left. Returns (hap_sites, calls)."""
    counts = cut(counts)
    haps = cut(cell_haplotypes(counts.join(clean_sites(counts), "pos", "left_semi")))
    groups = cut(ordered_groups(site_groups(haps)))
    found = discover(group_alleles(haps, groups).join(groups.select("grp", "ord").distinct(), "grp"))
    best, drop = None, 0
    while True:
        short = found.withColumn("prefix", F.expr(f"substring(prefix, 1, length(prefix) - {drop})")).filter("length(prefix) > 0").groupBy("prefix").agg(F.sum("size").alias("size"))
        if drop and short.isEmpty():
            break
        short = short.withColumn("hap", F.row_number().over(W.orderBy(F.desc("size"), "prefix")) - 1)  # one row per haplotype
        sites = cut(haplotype_sites(short, groups))
        calls = cut(assign(counts, sites, doublet_rate))
        s = calls.agg(F.sum("llr").alias("s")).first().s or 0.0
        if best is not None and s < best[0]:
            break
        best, drop = (s, sites, calls), drop + 1
    return best[1], best[2]


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Number the groups 1, 2, ... by rank of their representative."""
    o = groups.select("grp", "rank").distinct().withColumn("ord", F.row_number().over(W.orderBy("rank")))  # at most MAX_SITES rows
    return groups.join(o.select("grp", "ord"), "grp")


def sub_clusters(haps: DataFrame, groups: DataFrame, parents: DataFrame) -> DataFrame:
    """Discovery inside each chosen parent cluster: (parent, name, prefix, size), named parent_child."""
    g = group_alleles(haps, groups).join(groups.select("grp", "ord").distinct(), "grp").join(parents.select("barcode", "parent"), "barcode")
    d = discover(g, ["parent"])
    return d.select("parent", F.concat_ws("_", F.col("parent").cast("string"), F.col("hap").cast("string")).alias("name"), "prefix", "size")


def assign_within(counts: DataFrame, hap_sites: DataFrame, parents: DataFrame) -> DataFrame:
    """Single haplotypes only, each cell against those of its own parent: (barcode, parent, i, j, llr).

    ``hap_sites(parent, hap, pos, allele)``; a site of one parent is another site than that of the next, so all parents are one run."""
    own = counts.join(parents.select("barcode", "parent"), "barcode")
    site = F.shiftleft(F.col("parent").cast("bigint"), 32) + F.col("pos")
    calls = assign(own.withColumn("pos", site), hap_sites.withColumn("pos", site), 0.0)
    return calls.join(parents.select("barcode", "parent"), "barcode")


def merge_tree(root_calls: DataFrame, leaf_calls: DataFrame) -> DataFrame:
    """(barcode, cluster): the place of every singly called cell in the merged tree.

    A parent with leaf calls is replaced by its leaves, named parent_leaf; the other root clusters stay. Doublets of either
    level belong nowhere, nor do cells of a replaced parent that no leaf took."""
    parents = leaf_calls.select(F.col("parent").alias("i")).distinct()
    root = root_calls.filter("i = j").join(parents, "i", "left_anti").select("barcode", F.col("i").cast("string").alias("cluster"))
    name = F.concat_ws("_", F.col("parent").cast("string"), F.col("i").cast("string"))
    return root.unionByName(leaf_calls.filter("i = j").select("barcode", name.alias("cluster")))


def merged_haplotypes(haps: DataFrame, tree: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(cluster, pos, allele): consensus of each cluster of the tree over the sites called in enough cells of all and carried by one."""
    cons = cut(consensus(haps, tree))
    return variable_sites(cons.join(well_called_sites(cons, min_share), "pos", "left_semi")).select("cluster", "pos", "allele")


def sub_cluster_and_merge(counts: DataFrame, root_calls: DataFrame, chosen: DataFrame, doublet_rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Split the ``chosen(parent)`` clusters of ``root_calls(barcode, i, j)``, merge the trees, call all cells anew with doublets.

    Haplotypes are discovered inside each parent from the cells that carry it alone; a parent that does not split stays as it
    was. Returns (haplotypes (cluster, pos, allele), calls (barcode, id, type, llr)); names of a doublet are joined by +.
    With nothing chosen the root's own clusters are called anew; no cells give no rows."""
    counts = cut(counts.select("barcode", "pos", "maj", "min"))
    haps = cut(cell_haplotypes(counts.join(clean_sites(counts), "pos", "left_semi")))
    groups = cut(ordered_groups(site_groups(haps)))
    parents = cut(root_calls.filter("i = j").join(chosen.select(F.col("parent").alias("i")).distinct(), "i", "left_semi").select("barcode", F.col("i").alias("parent")))
    calls = group_alleles(haps, groups).join(groups.select("grp", "ord").distinct(), "grp").join(parents, "barcode")
    found = cut(discover(calls, ["parent"]))
    split = found.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent")
    leaves = haplotype_sites(found.join(split, "parent", "left_semi"), groups, ("parent",))
    tree = cut(merge_tree(root_calls, cut(assign_within(counts, leaves, parents))))
    merged = cut(merged_haplotypes(haps, tree))
    names = cut(tree.select("cluster").distinct().withColumn("sample", F.row_number().over(W.orderBy("cluster")) - 1))  # one row per cluster
    sites = merged.filter("allele IS NOT NULL").join(names, "cluster").select(F.col("sample").alias("hap"), "pos", "allele")
    named = L.name_identities(assign(counts, sites, doublet_rate), names.withColumnRenamed("cluster", "name"))
    return merged, named.select("barcode", "id", "type", "llr")


# --- consensus ------------------------------------------------------------------------------------

def consensus(haps: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, pos, tot, cells, allele): alt, ref or missing, whichever is likeliest; also the call share of the site."""
    cells = clusters.groupBy("cluster").agg(F.countDistinct("barcode").alias("cells"))
    d = haps.join(clusters.select("barcode", "cluster"), "barcode").groupBy("cluster", "pos").agg(F.sum("allele").alias("s"), F.count(F.lit(1)).alias("tot")).join(cells, "cluster")
    s, t, n = F.col("s"), F.col("tot"), F.col("cells")
    c1, c3 = log_choose("tot", "s"), log_choose("cells", "tot")
    import math
    a, b = math.log(0.99), math.log(0.01)
    alt, ref, miss = F.round(c1 + s * a + (t - s) * b, 6), F.round(c1 + s * b + (t - s) * a, 6), F.round(c3 + t * b + (n - t) * a, 6)
    v = F.when((miss > alt) & (miss > ref), None).when((alt > ref) & (alt > miss), 1).otherwise(0)
    return d.select("cluster", "pos", "tot", "cells", v.alias("allele"))


def well_called_sites(cons: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Sites called in enough cells of every cluster that has them."""
    return cons.groupBy("pos").agg(F.min(F.col("tot") / F.col("cells")).alias("m")).filter(F.col("m") >= min_share).select("pos")


def well_called_cells(haps: DataFrame, n_sites: int, max_missing: float) -> DataFrame:
    """Rows of cells with few missing sites, then of sites still varying among them."""
    ok = haps.groupBy("barcode").agg(F.count(F.lit(1)).alias("n")).filter((n_sites - F.col("n")) / n_sites < max_missing).select("barcode")
    h = haps.join(ok, "barcode", "left_semi")
    total = ok.agg((F.count(F.lit(1)) / 1000).alias("t"))  # one row
    var = h.groupBy("pos").agg(F.sum("allele").alias("s")).join(F.broadcast(total)).filter("s > t").select("pos")
    return h.join(var, "pos", "left_semi")


def variable_sites(cons: DataFrame) -> DataFrame:
    keep = cons.groupBy("pos").agg(F.sum("allele").alias("s")).filter("s > 0").select("pos")
    return cons.join(keep, "pos", "left_semi")


def mixing_evidence(counts: DataFrame, hap_sites: DataFrame, doublets: DataFrame) -> DataFrame:
    """Reads for each of a doublet's two haplotypes, over the sites where they differ."""
    a = hap_sites.select(F.col("hap").alias("i"), "pos", F.col("allele").alias("ai"))
    b = hap_sites.select(F.col("hap").alias("j"), "pos", F.col("allele").alias("aj"))
    diff = a.join(b, "pos").filter("i < j AND ai <> aj")  # haplotypes by sites: bounded by the model
    d = counts.join(doublets.filter("i < j").select("barcode", "i", "j"), "barcode").join(diff, ["i", "j", "pos"])
    return d.groupBy("barcode", "i", "j").agg(F.sum(F.when(F.col("ai") == 1, F.col("min")).otherwise(F.col("maj"))).alias("match1"),
                                              F.sum(F.when(F.col("ai") == 1, F.col("maj")).otherwise(F.col("min"))).alias("match2"))


def first_source(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of variant sets in which an earlier table's definition of a site stands."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("src_", F.lit(k))
        out = t if out is None else out.unionByName(t)
    rest = [c for c in out.columns if c not in (*keys, "src_")]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "src_").alias("x")).select(*keys, *[f"x.{c}" for c in rest])
