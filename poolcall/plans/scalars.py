"""Scalar functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.functions import cdf, expr as X
from poolcall.plans.fixtures import acgt
from poolcall.plans.registry import r, register, rq

IJ = "SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 20 AS INT) AS i, CAST(l_suppkey % 20 + l_partkey % 3 AS INT) AS j FROM lineitem"
NS = 25


def _ij(fx):
    return fx.lineitem.selectExpr("l_orderkey", "l_linenumber", "CAST(l_suppkey % 20 AS INT) AS i", "CAST(l_suppkey % 20 + l_partkey % 3 AS INT) AS j")


@register("h1_identity_index", f"""
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN i = j THEN i ELSE {NS} + i * {NS} - i * (i + 1) // 2 + j - i - 1 END AS INT) AS idx, i AS back_i, j AS back_j FROM ({IJ}) q""")
def h1(fx):
    d = _ij(fx).withColumn("idx", X.identity_index("i", "j", NS)).withColumn("b", X.identity_members("idx", NS))
    return d.select("l_orderkey", "l_linenumber", "idx", F.col("b.i").alias("back_i"), F.col("b.j").alias("back_j"))


@register("h1_identity_name", """
    SELECT s.s_suppkey, CASE WHEN a.n_name = b.n_name THEN a.n_name ELSE least(a.n_name, b.n_name) || '+' || greatest(a.n_name, b.n_name) END AS name
    FROM supplier s JOIN nation a ON a.n_nationkey = s.s_nationkey JOIN nation b ON b.n_nationkey = s.s_suppkey % 25""")
def h1n(fx):
    a = fx.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a"))
    b = fx.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("b"))
    return fx.supplier.join(a, "s_nationkey").withColumn("k", F.col("s_suppkey") % 25).join(b, "k").select("s_suppkey", X.identity_name("a", "b").alias("name"))


NUM = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS n, floor(l_quantity * l_discount * 10) AS k, 0.01 + l_discount * 9 AS p, 0.02 + l_tax * 10 AS q FROM lineitem"


def _num(fx):
    d = fx.lineitem.selectExpr("l_orderkey", "l_linenumber", "CAST(l_quantity AS DOUBLE) AS n", "CAST(floor(l_quantity * l_discount * 10) AS DOUBLE) AS k",
                               "0.01D + l_discount * 9 AS p", "0.02D + l_tax * 10 AS q")
    return d.withColumn("k", F.least("k", "n"))


SQLNUM = f"SELECT l_orderkey, l_linenumber, n, least(k, n) AS k, p, q FROM ({NUM}) z"


@register("h2_error_adjusted_rate", f"SELECT l_orderkey, l_linenumber, {rq('p - p * 0.02 + (1 - p) * 0.01', 6)} AS v FROM ({SQLNUM}) t")
def h2(fx):
    return _num(fx).select("l_orderkey", "l_linenumber", r(X.err_adj("p", 0.01, 0.02), 6).alias("v"))


@register("h3_binomial_log_ratio", f"""
    SELECT l_orderkey, l_linenumber, {rq('k * log2(a / b) + (n - k) * log2((1 - a) / (1 - b))', 5)} AS v FROM (
      SELECT *, greatest(least(p, 1 - 1e-8), 1e-8) AS a, greatest(least(q, 1 - 1e-8), 1e-8) AS b FROM ({SQLNUM}) t) u""")
def h3(fx):
    return _num(fx).select("l_orderkey", "l_linenumber", r(X.binom_llr2(F.col("n") - F.col("k"), "k", "p", "q"), 5).alias("v"))


@register("h5_log_binomial_coefficient", f"SELECT l_orderkey, l_linenumber, {rq('lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)', 5)} AS v FROM ({SQLNUM}) t")
def h5(fx):
    return _num(fx).select("l_orderkey", "l_linenumber", r(X.log_choose("n", "k"), 5).alias("v"))


@register("h6_distribution_functions")
def h6(fx):
    """CDFs of a report table: orders per customer group against simple models."""
    g = fx.orders.groupBy((F.col("o_custkey") % 50).alias("grp")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("k"))
    half = F.lit(0.5)
    return g.select("grp", r(cdf.binomial_cdf("k", "n", half), 6).alias("binom"), r(cdf.poisson_cdf("k", F.col("n") / 2), 6).alias("pois"),
                    r(cdf.normal_cdf("k", F.col("n") / 2, F.sqrt(F.col("n") / 4)), 6).alias("norm"), r(cdf.beta_cdf(half, F.col("k") + 1, F.col("n") - F.col("k") + 1), 6).alias("beta"),
                    r(cdf.chi2_cdf(F.pow(F.col("k") - F.col("n") / 2, F.lit(2.0)) / (F.col("n") / 4), F.lit(1.0)), 6).alias("chi2"))


@register("h6_binomial_cdf", """
    WITH g AS (SELECT o_custkey % 50 AS grp, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1)
    SELECT grp, (round(sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + n * ln(0.5))), 6) + 0.0::DOUBLE) AS binom FROM g, LATERAL (SELECT unnest(range(0, k + 1)) AS x) t GROUP BY grp""")
def h6b(fx):
    return h6(fx).select("grp", "binom")


@register("h7_logit_expit", f"""
    SELECT l_orderkey, l_linenumber, {rq('ln(a / (1 - a))', 6)} AS logit, {rq('1 / (1 + exp(-n / 10))', 6)} AS expit, {rq('log2(pow(2, p) + pow(2, q) + pow(2, 0.0))', 6)} AS lse FROM (
      SELECT *, greatest(least(p, 1 - 1e-8), 1e-8) AS a FROM ({SQLNUM}) t) u""")
def h7(fx):
    return _num(fx).select("l_orderkey", "l_linenumber", r(X.logit("p"), 6).alias("logit"), r(X.expit(F.col("n") / 10), 6).alias("expit"),
                           r(X.log2_sum_exp2(F.array("p", "q", F.lit(0.0))), 6).alias("lse"))


@register("h8_moment_fits", f"""
    SELECT l_suppkey, {rq('CASE WHEN v > m THEN m * m / (v - m) END', 5)} AS nb, {rq('dm * (dm * (1 - dm) / dv - 1)', 5)} AS beta_a, {rq('m * m / v', 5)} AS shape, {rq('m / v', 5)} AS rate FROM (
      SELECT l_suppkey, avg(l_quantity) AS m, var_samp(l_quantity) AS v, avg(l_discount) AS dm, var_samp(l_discount) AS dv FROM lineitem GROUP BY l_suppkey) q""")
def h8(fx):
    g = fx.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"), F.var_samp("l_quantity").alias("v"), F.avg("l_discount").alias("dm"), F.var_samp("l_discount").alias("dv"))
    return g.select("l_suppkey", r(X.nb_size("m", "v"), 5).alias("nb"), r(X.beta_shape("dm", "dv")["a"], 5).alias("beta_a"),
                    r(X.gamma_shape("m", "v")["shape"], 5).alias("shape"), r(X.gamma_shape("m", "v")["rate"], 5).alias("rate"))


@register("h9_phred", f"SELECT l_orderkey, l_linenumber, {rq('1 - pow(10, -l_quantity / 10)', 6)} AS w FROM lineitem")
def h9(fx):
    return fx.lineitem.select("l_orderkey", "l_linenumber", r(X.phred_weight("l_quantity"), 6).alias("w"))


@register("h10_canonical_strand", "SELECT barcode, translate(reverse(barcode), 'ACGT', 'TGCA') AS rc, least(barcode, translate(reverse(barcode), 'ACGT', 'TGCA')) AS canon FROM fx_allow")
def h10(fx):
    return fx.fx_allow.select("barcode", X.revcomp("barcode").alias("rc"), X.canonical_kmer("barcode").alias("canon"))


@register("h11_kmer_windows", """
    SELECT kmer, count(*) AS n FROM (SELECT substr(s, p, 5) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 3)) AS p FROM (
      SELECT concat(substr(barcode, 1, 9), CASE WHEN read_id % 3 = 0 THEN 'N' ELSE 'A' END, substr(barcode, 10, 7)) AS s FROM fx_raw_barcodes) a) b) c WHERE NOT contains(kmer, 'N') GROUP BY kmer""")
def h11(fx):
    s = F.concat(F.substring("barcode", 1, 9), F.when(F.col("read_id") % 3 == 0, "N").otherwise("A"), F.substring("barcode", 10, 7))
    return fx.fx_raw_barcodes.select(F.explode(X.kmers(s, 5)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@register("h12_hamming", "SELECT corrected, mm, count(*) AS n FROM (SELECT corrected, CAST(hamming(barcode, corrected) AS INT) AS mm FROM fx_corrected) q GROUP BY corrected, mm")
def h12(fx):
    return fx.fx_corrected.select("corrected", X.hamming("barcode", "corrected").alias("mm")).groupBy("corrected", "mm").agg(F.count(F.lit(1)).alias("n"))


@register("h13_clean_barcodes", "SELECT cell, barcode AS a, barcode AS b FROM fx_allow")
def h13(fx):
    a = X.clean_barcode(F.concat(F.lit("L1_"), "barcode", F.lit("-1")))
    b = X.clean_barcode(F.concat("barcode", F.lit("-1-lib2")))
    return fx.fx_allow.select("cell", a.alias("a"), b.alias("b"))


@register("h14_bin_ids", "SELECT site_id, chrom || ':' || CAST(CAST(floor(pos / 500) AS BIGINT) AS VARCHAR) AS bin FROM fx_sites")
def h14(fx):
    return fx.fx_sites.select("site_id", X.bin_id("chrom", "pos", 500).alias("bin"))


@register("h17_regression", f"""
    SELECT l_suppkey, {rq('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {rq('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
           {rq('(sw * sxy - sx * sy) / (sw * sxx - sx * sx)', 4)} AS w_slope FROM (SELECT *, l_linenumber AS w FROM lineitem) l
    JOIN (SELECT l_suppkey AS k, sum(l_linenumber) AS sw, sum(l_linenumber * l_quantity) AS sx, sum(l_linenumber * l_extendedprice) AS sy,
                 sum(l_linenumber * l_quantity * l_quantity) AS sxx, sum(l_linenumber * l_quantity * l_extendedprice) AS sxy FROM lineitem GROUP BY 1) s ON s.k = l_suppkey
    GROUP BY l_suppkey, sw, sx, sy, sxx, sxy""")
def h17(fx):
    d = fx.lineitem
    plain = d.groupBy("l_suppkey").agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))
    w = X.weighted_line(d, ["l_suppkey"], "l_quantity", "l_extendedprice", "l_linenumber").select("l_suppkey", r("slope", 4).alias("w_slope"))
    return plain.join(w, "l_suppkey")


KMER = acgt("s_suppkey * 7919 + 5", 6)


@register("sql_functions", f"""
    SELECT s_suppkey, round(0.3 - 0.3 * 0.02 + 0.7 * 0.01 + s_suppkey, 6)::DOUBLE AS p,
           {rq(f'5 * log2({X.P_FLOOR} / 0.5::DOUBLE) + s_suppkey * log2((1 - {X.P_FLOOR}::DOUBLE) / 0.5)', 6)} AS llr,
           least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer, CASE WHEN a = b THEN a ELSE concat(least(a, b), '+', greatest(a, b)) END AS name, concat(k, '-L1') AS bc
    FROM (SELECT s_suppkey, {KMER} AS k, concat('S', CAST(s_suppkey % 3 AS VARCHAR)) AS a, concat('S', CAST(s_suppkey % 5 AS VARCHAR)) AS b FROM supplier) q""")
def sql_functions(fx):
    """The functions as registered for SQL text."""
    X.register_sql_functions(fx.spark)
    return fx.spark.sql(f"""
        SELECT s_suppkey, round(err_adj(0.3D, 0.01D, 0.02D) + s_suppkey, 6) AS p, round(binom_llr2(s_suppkey, 5D, 0D, 0.5D), 6) + 0D AS llr,
               canonical_kmer(k) AS kmer, identity_name(a, b) AS name, format_barcode(k, 'L1') AS bc
        FROM (SELECT s_suppkey, {KMER} AS k, concat('S', CAST(s_suppkey % 3 AS STRING)) AS a, concat('S', CAST(s_suppkey % 5 AS STRING)) AS b FROM {{s}})""", s=fx.supplier)
