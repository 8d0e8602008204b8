"""Pools: composition from bulk counts, site and gene likelihoods, bootstrap, concentration, doublet rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.functions.expr import binom_logpmf, err_adj
from poolcall.operators.contam import fit_shares, settle_shares
from poolcall.operators.counts import site_calls
from poolcall.session import PASS_LIMIT, collect_bounded, cut, local_table, not_settled

# cumulative probabilities of a Poisson variable with mean 1; fixed values
POISSON1 = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
            0.9999167588507119, 0.9999897508033253, 0.9999988747974149]


def bulk_patterns(bulk: DataFrame, genotypes: DataFrame, n_members: int, e_ref: float, e_alt: float, keys: list[str] | None = None) -> DataFrame:
    """Bulk counts per genotype pattern of completely called sites: rows (n, k, pe, fr) for the share fit.

    A fit reads patterns instead of sites, so its passes do not grow with the genome."""
    calls = site_calls(genotypes).filter(F.size("calls") == n_members)
    fr = F.transform("calls", lambda c: err_adj(c["nalt"] / 2, e_ref, e_alt))
    ks = keys or []
    return (bulk.join(calls, "site_id").groupBy(*ks, "calls").agg((F.sum(F.col("ref_w") + F.col("alt_w")) / 1e6).alias("n"), (F.sum("alt_w") / 1e6).alias("k"))
            .select(*ks, "n", "k", F.lit(0.0).alias("pe"), fr.alias("fr")))


def pool_composition(bulk: DataFrame, genotypes: DataFrame, members: list[int], e_ref: float = 0.001, e_alt: float = 0.001,
                     passes: int = PASS_LIMIT, tol: float = 1e-6) -> list[float]:
    """Most likely shares of the members; the likelihood is concave, so one start is enough."""
    rows = cut(bulk_patterns(bulk, genotypes, len(members), e_ref, e_alt))
    return fit_shares(rows, [1.0 / len(members)] * len(members), 1.0, passes, tol)


def bootstrap_rows(bulk: DataFrame, replicates: int) -> DataFrame:
    """Every site in every replicate with a Poisson(1) weight drawn from a hash of (site, replicate)."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "site_id", "b")), 1, 8), 16, 10).cast("double") / 4294967296.0
    d = bulk.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u)
    w = sum(((F.col("u") >= c).cast("int") for c in POISSON1[1:]), (F.col("u") >= POISSON1[0]).cast("int"))
    d = d.withColumn("w", w).filter("w > 0")
    return d.withColumn("ref_w", F.col("ref_w") * F.col("w")).withColumn("alt_w", F.col("alt_w") * F.col("w")).drop("u", "w")


def bootstrap_shares(bulk: DataFrame, genotypes: DataFrame, members: list[int], replicates: int, tol: float = 1e-8,
                     e_ref: float = 0.001, e_alt: float = 0.001) -> DataFrame:
    """Shares per replicate (b, member, share): all replicates go through each pass together, each until it has settled."""
    n = len(members)
    rows = cut(bulk_patterns(bootstrap_rows(bulk, replicates), genotypes, n, e_ref, e_alt, ["b"]))
    share = settle_shares(rows, {b: [1.0 / n] * n for b in range(1, replicates + 1)}, 1.0, tol)
    return local_table(bulk.sparkSession, [(b, m, s) for b, vs in sorted(share.items()) for m, s in zip(members, vs)], "b INT, member INT, share DOUBLE")


def concentration(shares: DataFrame) -> DataFrame:
    """Dirichlet concentration per member from the mean and variance of replicate shares."""
    g = shares.groupBy("member").agg(F.avg("share").alias("m"), F.var_samp("share").alias("v"))
    a0 = F.avg(F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).over(W.partitionBy())  # one row per member
    return g.withColumn("a0", a0).select("member", F.col("m").alias("share"), (F.col("a0") * F.col("m")).alias("conc"))


def compare_composition(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Two-sided beta test of each member's share against a reference with concentrations, with FDR."""
    from poolcall.functions.cdf import beta_cdf
    w = W.partitionBy()  # one row per member
    d = ref.withColumn("t_", F.sum("conc").over(w)).join(test.select("member", F.col("share").alias("test")), "member")
    p = beta_cdf(F.col("test"), F.col("conc"), F.col("t_") - F.col("conc"))
    d = d.withColumn("p", p).withColumn("p", 2 * F.least(F.col("p"), 1 - F.col("p")))
    return fdr(d.select("member", (F.col("conc") / F.col("t_")).alias("ref"), "test", "p"))


def fdr(d: DataFrame, p: str = "p", key: str = "member") -> DataFrame:
    """Benjamini-Hochberg adjusted p of a report table."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    d = d.withColumn("r_", F.row_number().over(W.orderBy(p, key))).withColumn("q_", F.col(p) * n / F.col("r_"))
    adj = F.min("q_").over(W.orderBy(F.desc("r_")).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("p_adj", F.least(adj, F.lit(1.0))).drop("r_", "q_")


def site_likelihood(bulk: DataFrame, genotypes: DataFrame, shares: DataFrame, e_ref: float = 0.001, e_alt: float = 0.001) -> DataFrame:
    """Log likelihood and depth of each completely called site under a composition."""
    n = shares.agg(F.count(F.lit(1)).alias("s_"))
    g = genotypes.join(shares.select(F.col("member").alias("sample"), "share"), "sample").groupBy("site_id").agg(
        F.sum(F.col("share") * F.col("nalt") / 2).alias("p"), F.count(F.lit(1)).alias("s_")).join(F.broadcast(n), "s_")  # one row
    d = bulk.join(g, "site_id").withColumn("n", F.round((F.col("ref_w") + F.col("alt_w")) / 1e6)).withColumn("k", F.round(F.col("alt_w") / 1e6))
    return d.withColumn("ll", binom_logpmf("n", "k", err_adj(F.col("p"), e_ref, e_alt)))


def gene_likelihood(site_ll: DataFrame) -> DataFrame:
    """Mean site log likelihood per gene, weighted by depth."""
    d = site_ll.select("ll", "n", F.explode("genes").alias("gene"))
    return d.groupBy("gene").agg((F.sum(F.col("ll") * F.col("n")) / F.sum("n")).alias("ll"), F.sum("n").alias("depth"))


def other_allele_rate(sites: DataFrame, floor: float = 0.001) -> DataFrame:
    """Mean share of reads with neither allele, with a floor."""
    r = F.avg(F.col("err") / (F.col("err") + F.col("ref") + F.col("alt")))
    return sites.filter("err + ref + alt > 0").agg(r.alias("r_")).select(F.greatest("r_", F.lit(floor)).alias("rate"))


# --- doublets ---------------------------------------------------------------------------------------

def identity_counts(labels: DataFrame) -> DataFrame:
    """Cells per identity and data set; bounded by the pool."""
    return labels.groupBy("data_set", "id").agg(F.count(F.lit(1)).alias("n"))


def fit_doublets(counts: list, starts: list[float], passes: int = PASS_LIMIT, tol: float = 1e-9, weighted: bool = False):
    """Common doublet rate and shares per data set from identity counts (set, id, n).

    A cell is a singlet of i with (1-d)·s, or a doublet of two draws; doublets of one member look like its singlets.
    ``weighted`` gives every data set the same say. Returns (rate, {set: {member: share}}, log likelihood)."""
    sets = sorted({x[0] for x in counts})
    best = None
    for d in starts:
        mem = {s: sorted({m for t, i, _ in counts if t == s for m in i.split("+")}) for s in sets}
        sh = {s: {m: 1.0 / len(mem[s]) for m in mem[s]} for s in sets}
        tot = {s: sum(n for t, _, n in counts if t == s) for s in sets}
        last = None
        for _ in range(passes):
            dn = dd = 0.0
            ll = 0.0
            acc = {s: dict.fromkeys(mem[s], 0.0) for s in sets}
            for s, i, n in counts:
                w = n / tot[s] if weighted else n
                parts = i.split("+")
                if len(parts) == 1:
                    p1, p2 = (1 - d) * sh[s][i], d * sh[s][i] ** 2
                    h = p2 / (p1 + p2) if p1 + p2 > 0 else 0.0
                    ll += w * np.log(max(p1 + p2, 1e-300))
                    acc[s][i] += w * (1 + h)
                    dn += w * h
                else:
                    a, b = parts
                    ll += w * np.log(max(2 * d * sh[s][a] * sh[s][b], 1e-300))
                    acc[s][a] += w
                    acc[s][b] += w
                    dn += w
                dd += w
            d = min(max(dn / dd, 1e-9), 1 - 1e-9)
            sh = {s: {m: v / sum(acc[s].values()) for m, v in acc[s].items()} for s in sets}
            if last is not None and abs(ll - last) <= tol * abs(last):
                break
            moved, last = ll - (last or 0.0), ll
        else:
            raise not_settled("the doublet rate", passes, moved)
        if best is None or ll > best[2]:
            best = (d, sh, ll)
    return best


def doublet_fit(labels: DataFrame, starts: list[float] | None = None, passes: int = PASS_LIMIT, tol: float = 1e-9, weighted: bool = False):
    rows = [(x.data_set, x.id, x.n) for x in collect_bounded(identity_counts(labels), 1_000_000)]
    return fit_doublets(rows, starts or [k / 21 for k in range(1, 21)], passes, tol, weighted)


def expected_counts(labels: DataFrame, shares: DataFrame, d: float) -> DataFrame:
    """Observed and expected cells per identity and data set, with a binomial p."""
    obs = identity_counts(labels)
    tot = obs.groupBy("data_set").agg(F.sum("n").alias("tot"))
    a = shares.select("data_set", F.col("member").alias("a"), F.col("share").alias("sa"))
    b = shares.select("data_set", F.col("member").alias("b"), F.col("share").alias("sb"))
    ids = a.join(b, "data_set").filter("a <= b").select(  # pairs of pool members, not of cells
        "data_set", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("+", "a", "b")).alias("id"),
        F.when(F.col("a") == F.col("b"), "S").otherwise("D").alias("type"),
        F.when(F.col("a") == F.col("b"), (1 - d) * F.col("sa") + d * F.col("sa") * F.col("sa")).otherwise(2 * d * F.col("sa") * F.col("sb")).alias("p"))
    return ids.join(tot, "data_set").join(obs, ["data_set", "id"], "left").select(
        "data_set", "type", "id", F.coalesce("n", F.lit(0)).alias("obs"), (F.col("p") * F.col("tot")).alias("exp"), "tot", "p")


def collapse_doublets(detail: DataFrame) -> DataFrame:
    """Report form: one row per singlet, all doublets of a data set in one row."""
    name = F.when(F.col("type") == "D", "Doublet").otherwise(F.col("id"))
    return detail.groupBy("data_set", "type", name.alias("id")).agg(F.sum("obs").alias("obs"), F.sum("exp").alias("exp"))
