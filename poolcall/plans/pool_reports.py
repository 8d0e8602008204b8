"""Pools: composition, likelihoods, bootstrap and doublet rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import counts as C, pool as P
from poolcall.plans.contamination import SQL_TOL, share_sql
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import local_table

MEMBERS, TOL, ER = [0, 1, 2, 3, 4], 1e-6, 0.001
add_view("fx_bulk", """SELECT site_id, CAST(sum(ref_w) AS BIGINT) AS ref_w, CAST(sum(alt_w) AS BIGINT) AS alt_w, list_sort(list(DISTINCT gene)) AS genes FROM (
      SELECT site_id, gene, CASE WHEN is_alt = 0 THEN w ELSE 0 END AS ref_w, CASE WHEN is_alt = 1 THEN w ELSE 0 END AS alt_w FROM (
        SELECT *, CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT) AS w FROM fx_pileup) a) b GROUP BY site_id""",
         lambda fx: C.bulk_site_counts(fx.fx_pileup))
ROWS = f"""SELECT b.site_id AS id, (ref_w + alt_w) / 1e6 AS n, alt_w / 1e6 AS k, 0.0 AS pe, g.sample AS m, g.nalt / 2.0 - g.nalt / 2.0 * {ER} + (1 - g.nalt / 2.0) * {ER} AS f
    FROM fx_bulk b JOIN fx_genotypes g ON g.site_id = b.site_id WHERE b.site_id IN (SELECT site_id FROM fx_genotypes GROUP BY site_id HAVING count(*) = 5)"""


@register("i24_pool_composition", f"""WITH RECURSIVE rw AS MATERIALIZED ({ROWS}),
    it AS (SELECT 0 AS k, sample AS m, 0.2::DOUBLE AS share, 1.0::DOUBLE AS moved FROM fx_samples
      UNION ALL SELECT k + 1, m, share, max(abs(share - before)) OVER () FROM (SELECT k, m, v / sum(v) OVER () AS share, before FROM (
        SELECT k, m, before, sum(before * (n_k_a / p + n_k_r / (1 - p))) AS v FROM (
          SELECT it.k, rw.m, it.share AS before, rw.k * f AS n_k_a, (rw.n - rw.k) * (1 - f) AS n_k_r, least(greatest(sum(f * it.share) OVER (PARTITION BY id), 1e-9), 1 - 1e-9) AS p
          FROM rw JOIN it ON it.m = rw.m WHERE moved >= {TOL}) a GROUP BY k, m, before) b) c)
    SELECT CAST(m AS INT) AS member, {rq('share', 5)} AS share FROM it WHERE k = (SELECT max(k) FROM it)""")
def i24(fx):
    s = P.pool_composition(fx.fx_bulk, fx.fx_genotypes, MEMBERS, ER, ER, tol=TOL)
    return local_table(fx.spark, list(zip(MEMBERS, s)), "member INT, share DOUBLE").select("member", r("share", 5).alias("share"))


add_view("fx_fixed_shares", "SELECT CAST(sample AS INT) AS member, (sample + 1) / 15.0::DOUBLE AS share FROM fx_samples",
         lambda fx: fx.fx_samples.select(F.col("sample").cast("int").alias("member"), ((F.col("sample") + 1) / 15.0).alias("share")))
add_view("fx_site_ll", f"""
    SELECT b.site_id, b.genes, n, k, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p) AS ll FROM (
      SELECT b.site_id, b.genes, round((ref_w + alt_w) / 1e6) AS n, round(alt_w / 1e6) AS k, q - q * {ER} + (1 - q) * {ER} AS p FROM fx_bulk b
      JOIN (SELECT site_id, sum(share * nalt / 2) AS q FROM fx_genotypes JOIN fx_fixed_shares ON member = sample GROUP BY site_id HAVING count(*) = 5) g ON g.site_id = b.site_id) b""",
         lambda fx: P.site_likelihood(fx.fx_bulk, fx.fx_genotypes, fx.fx_fixed_shares, ER, ER))


@register("i25_site_likelihood", f"SELECT site_id, n, k, {rq('ll')} AS ll FROM fx_site_ll")
def i25(fx):
    return fx.fx_site_ll.select("site_id", "n", "k", r("ll").alias("ll"))


@register("e22_gene_likelihood", f"SELECT gene, {rq('sum(ll * n) / sum(n)')} AS ll, sum(n) AS depth FROM (SELECT unnest(genes) AS gene, ll, n FROM fx_site_ll) q GROUP BY gene")
def e22(fx):
    return P.gene_likelihood(fx.fx_site_ll).select("gene", r("ll").alias("ll"), "depth")


ERR = "SELECT site_id, ref_w / 1e6 AS ref, alt_w / 1e6 AS alt, (site_id % 7) / 50.0 AS err FROM fx_bulk"


@register("e25_other_allele_rate", f"SELECT {rq('greatest(avg(err / (err + ref + alt)), 0.001)', 6)} AS rate FROM ({ERR}) q")
def e25(fx):
    d = fx.fx_bulk.select("site_id", (F.col("ref_w") / 1e6).alias("ref"), (F.col("alt_w") / 1e6).alias("alt"), ((F.col("site_id") % 7) / 50.0).alias("err"))
    return P.other_allele_rate(d).select(r("rate", 6).alias("rate"))


REPLICATES = 20
WEIGHT = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INT)" for c in P.POISSON1)
BOOT_ROWS = f"""SELECT b, dense_rank() OVER (ORDER BY pat) AS id, n, k, 0.0 AS pe, m, pat[m + 1] / 2.0 - pat[m + 1] / 2.0 * {ER} + (1 - pat[m + 1] / 2.0) * {ER} AS f FROM (
      SELECT b, pat, sum((ref_w + alt_w) * w) / 1e6 AS n, sum(alt_w * w) / 1e6 AS k FROM (
        SELECT *, {WEIGHT} AS w FROM (SELECT x.*, pat, b, CAST(concat('0x', substr(md5(concat(CAST(x.site_id AS VARCHAR), '|', CAST(b AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
          FROM fx_bulk x JOIN (SELECT site_id, list(nalt ORDER BY sample) AS pat FROM fx_genotypes GROUP BY site_id HAVING count(*) = 5) g ON g.site_id = x.site_id, range(1, {REPLICATES + 1}) z(b)) q) y
      WHERE w > 0 GROUP BY b, pat) a, range(0, 5) z(m)"""


@register("i26_bootstrap_shares", share_sql(BOOT_ROWS, 1.0, SQL_TOL).replace("FROM start", f"FROM (SELECT b, m, 0.2::DOUBLE AS share FROM range(1, {REPLICATES + 1}) z(b), range(0, 5) y(m)) q") +
          f" SELECT CAST(b AS INT) AS b, CAST(m AS INT) AS member, {rq('share')} AS share FROM settled")
def i26(fx):
    return P.bootstrap_shares(fx.fx_bulk, fx.fx_genotypes, MEMBERS, REPLICATES).withColumn("share", r("share"))


add_view("fx_replicates", """SELECT CAST(o_custkey % 20 AS INT) AS b, CAST(o_orderkey % 5 AS INT) AS member, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_custkey % 20) AS share
    FROM orders GROUP BY o_custkey % 20, o_orderkey % 5""")


@register("i27_concentration", f"""
    SELECT member, {rq('m', 6)} AS share, {rq('avg(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 END) OVER () * m', 3)} AS conc FROM (
      SELECT member, avg(share) AS m, var_samp(share) AS v FROM fx_replicates GROUP BY member) q""")
def i27(fx):
    return P.concentration(fx.fx_replicates).select("member", r("share", 6).alias("share"), r("conc", 3).alias("conc"))


@register("i28_compare_composition")
def i28(fx):
    d = P.compare_composition(P.concentration(fx.fx_replicates), fx.fx_fixed_shares)
    return d.select("member", *[r(c, 6).alias(c) for c in ("ref", "test", "p", "p_adj")])


@register("h16_fdr", f"""
    SELECT id, {rq('p', 6)} AS p, {rq('least(min(q) OVER (ORDER BY n DESC), 1.0)', 6)} AS p_adj FROM (
      SELECT *, p * count(*) OVER () / n AS q FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS n FROM (
        SELECT id, (count(*) % 89) / 100.0::DOUBLE AS p FROM fx_labels_a GROUP BY id) a) b) c""")
def h16(fx):
    g = fx.fx_labels_a.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", ((F.col("n") % 89) / 100.0).alias("p"))
    return P.fdr(g, "p", "id").select("id", r("p", 6).alias("p"), r("p_adj", 6).alias("p_adj"))


# --- doublets ----------------------------------------------------------------------------------------

add_view("fx_sets_ab", "SELECT 'a' AS data_set, id FROM fx_labels_a UNION ALL SELECT 'b', id FROM fx_labels_b",
         lambda fx: fx.fx_labels_a.select(F.lit("a").alias("data_set"), "id").unionByName(fx.fx_labels_b.select(F.lit("b").alias("data_set"), "id")))
D_TOL, D0 = 1e-9, 0.2


def _doublet_sql() -> str:
    """The passes as a recursion over members; s holds the settled shares and rate, c the cells per identity."""
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT data_set, id, CAST(count(*) AS DOUBLE) AS n FROM fx_sets_ab GROUP BY 1, 2),
    mem AS (SELECT DISTINCT data_set, unnest(string_split(id, '+')) AS m FROM c),
    it AS (SELECT 0 AS k, data_set, m, 1.0::DOUBLE / count(*) OVER (PARTITION BY data_set) AS share, {D0}::DOUBLE AS d, NULL::DOUBLE AS ll, FALSE AS ended FROM mem
      UNION ALL (WITH now AS MATERIALIZED (SELECT * FROM it WHERE NOT ended),
      h AS MATERIALIZED (SELECT c.data_set, split_part(id, '+', 1) AS x, split_part(id, '+', 2) AS y, n, a.k, a.ll AS last,
        CASE WHEN b.m IS NULL THEN a.d * a.share / ((1 - a.d) + a.d * a.share) ELSE 1 END AS h,
        CASE WHEN b.m IS NULL THEN (1 - a.d) * a.share + a.d * a.share * a.share ELSE 2 * a.d * a.share * b.share END AS p
        FROM c JOIN now a ON a.data_set = c.data_set AND a.m = split_part(id, '+', 1) LEFT JOIN now b ON b.data_set = c.data_set AND b.m = split_part(id, '+', 2)),
      v AS (SELECT data_set, m, sum(v) AS v FROM (SELECT data_set, x AS m, n * (CASE WHEN y = '' THEN 1 + h ELSE 1 END) AS v FROM h
        UNION ALL SELECT data_set, y, n FROM h WHERE y <> '') q GROUP BY data_set, m),
      t AS (SELECT max(k) + 1 AS k, sum(n * h) / sum(n) AS d, sum(n * ln(greatest(p, 1e-300))) AS ll, max(last) AS last FROM h HAVING count(*) > 0)
      SELECT t.k, data_set, m, v / sum(v) OVER (PARTITION BY data_set), t.d, t.ll, coalesce(abs(t.ll - t.last) <= {D_TOL} * abs(t.last), FALSE) FROM v, t)),
    s AS MATERIALIZED (SELECT * FROM it WHERE k = (SELECT max(k) FROM it))"""


def _fit(fx):
    d, sh, _ = P.doublet_fit(fx.fx_sets_ab, [D0], tol=D_TOL)
    return d, local_table(fx.spark, [(s, m, v) for s, x in sh.items() for m, v in x.items()], "data_set STRING, member STRING, share DOUBLE")


@register("i29_doublet_rate", _doublet_sql() + f" SELECT data_set, m AS member, {rq('share', 6)} AS share, {rq('d', 6)} AS d FROM s")
def i29(fx):
    d, t = _fit(fx)
    return t.select("data_set", "member", r("share", 6).alias("share"), r(F.lit(d), 6).alias("d"))


DETAIL = f"""SELECT x.data_set, x.id, x.type, coalesce(CAST(c.n AS BIGINT), 0) AS obs, x.p * t.tot AS exp FROM (
      SELECT a.data_set, CASE WHEN a.m = b.m THEN a.m ELSE a.m || '+' || b.m END AS id, CASE WHEN a.m = b.m THEN 'S' ELSE 'D' END AS type,
             CASE WHEN a.m = b.m THEN (1 - a.d) * a.share + a.d * a.share * a.share ELSE 2 * a.d * a.share * b.share END AS p
      FROM s a JOIN s b ON a.data_set = b.data_set AND a.m <= b.m) x
    JOIN (SELECT data_set, sum(n) AS tot FROM c GROUP BY data_set) t ON t.data_set = x.data_set LEFT JOIN c ON c.data_set = x.data_set AND c.id = x.id"""


@register("e21_expected_counts", _doublet_sql() + f", det AS ({DETAIL}) SELECT data_set, type, id, obs, {rq('exp', 3)} AS exp FROM det")
def e21(fx):
    d, t = _fit(fx)
    return P.expected_counts(fx.fx_sets_ab, t, d).select("data_set", "type", "id", "obs", r("exp", 3).alias("exp"))


@register("e33_collapsed_doublets", _doublet_sql() + f", det AS ({DETAIL}) SELECT data_set, type, CASE WHEN type = 'D' THEN 'Doublet' ELSE id END AS id, CAST(sum(obs) AS BIGINT) AS obs, {rq('sum(exp)', 3)} AS exp FROM det GROUP BY 1, 2, 3")
def e33(fx):
    d, t = _fit(fx)
    return P.collapse_doublets(P.expected_counts(fx.fx_sets_ab, t, d)).select("data_set", "type", "id", "obs", r("exp", 3).alias("exp"))


@register("i29_doublet_rate_all_starts")
def i29b(fx):
    d, sh, ll = P.doublet_fit(fx.fx_sets_ab)
    return fx.spark.range(1).select(r(F.lit(float(d)), 6).alias("d"), r(F.lit(float(ll)), 2).alias("ll"))
