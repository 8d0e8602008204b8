"""Variant sites: scores, intervals, patterns, selection, sampling and regenotyping."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import counts as C, joins as J, sites as S
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import collect_bounded

MEMBERS = [0, 1, 2, 3, 4]
# genes: one long interval in ten sites, nested short ones; coverage: steps along each chromosome
add_view("fx_genes", """
    SELECT chrom, pos - 1 AS start, pos - 1 + CASE WHEN site_id % 10 = 0 THEN 3000 WHEN site_id % 10 = 5 THEN 90 ELSE 25 END AS stop
    FROM fx_sites WHERE site_id % 5 = 0 OR site_id % 17 = 0""")
add_view("fx_coverage", """
    SELECT chrom, pos - 1 AS start, pos + 39 AS stop, CAST(qual % 13 AS DOUBLE) AS score FROM fx_sites WHERE site_id % 9 <> 0""")
add_view("fx_scored", """
    SELECT s.*, coalesce(n_called, 0) AS n_called, coalesce(n_het, 0) AS n_het, CASE WHEN n_called > 0 THEN n_het / n_called ELSE 0.0 END AS het_freq,
           (m.n - coalesce(n_called, 0)) / m.n AS missing_freq,
           CASE WHEN n_called > 0 THEN n_het / n_called ELSE 0.0 END * (1 - 0.5 * (m.n - coalesce(n_called, 0)) / m.n) AS het_score,
           s.chrom || ':' || CAST(CAST(floor(s.pos / 1000) AS BIGINT) AS VARCHAR) AS bin_id
    FROM fx_sites s LEFT JOIN (SELECT site_id, count(*) AS n_called, count(*) FILTER (WHERE nalt = 1) AS n_het FROM fx_genotypes GROUP BY site_id) g
      ON g.site_id = s.site_id, (SELECT count(*) AS n FROM fx_samples) m""",
         lambda fx: S.site_scores(fx.fx_genotypes, fx.fx_sites, fx.fx_samples, 1000))
add_view("fx_annotated", """
    SELECT s.site_id, s.chrom, s.pos, s.het_freq, s.bin_id, coalesce((SELECT 1.0 FROM fx_genes g WHERE g.chrom = s.chrom AND s.pos >= g.start AND s.pos < g.stop LIMIT 1), 0.1)::DOUBLE AS genic,
           coalesce((SELECT max(score) FROM fx_coverage c WHERE c.chrom = s.chrom AND s.pos >= c.start AND s.pos < c.stop), 0.0)::DOUBLE AS cov FROM fx_scored s""",
         lambda fx: _annotated(fx))


def _annotated(fx):
    genes = fx.fx_genes.withColumnRenamed("stop", "end")
    cov = fx.fx_coverage.withColumnRenamed("stop", "end")
    p = fx.fx_scored.select("site_id", "chrom", "pos", "het_freq", "bin_id")
    p = J.interval_lookup(p, genes, "site_id", F.lit(1.0), 0.1, "genic")
    return J.interval_lookup(p, cov, "site_id", F.col("score"), 0.0, "cov")


PAT = "CASE WHEN n1 < n0 OR (n1 = n0 AND alt < flip) THEN alt ELSE flip END"
add_view("fx_patterns", f"""
    SELECT site_id, {PAT} AS pattern, NOT contains(alt, '-') AS called FROM (
      SELECT *, translate(alt, '01', '10') AS flip, length(alt) - length(replace(alt, '1', '')) AS n1, length(alt) - length(replace(alt, '0', '')) AS n0 FROM (
        SELECT s.site_id, string_agg(CASE WHEN g.nalt IS NULL THEN '-' WHEN g.nalt > 0 THEN '1' ELSE '0' END, '' ORDER BY m.sample) AS alt
        FROM fx_sites s CROSS JOIN fx_samples m LEFT JOIN fx_genotypes g ON g.site_id = s.site_id AND g.sample = m.sample GROUP BY s.site_id) a) b
    WHERE n1 > 0 AND n0 > 0""", lambda fx: S.site_patterns(fx.fx_genotypes, sorted(x.sample for x in collect_bounded(fx.fx_samples.select("sample"), 2048))))
add_view("fx_pattern_counts", "SELECT pattern, called, count(*) AS cnt FROM fx_patterns GROUP BY pattern, called", lambda fx: S.pattern_counts(fx.fx_patterns))
add_view("fx_compat", """
    SELECT partial, cnt, "full", full_cnt, full_cnt / sum(full_cnt) OVER (PARTITION BY partial) AS share FROM (
      SELECT DISTINCT a.pattern AS partial, a.cnt, b.pattern AS "full", b.cnt AS full_cnt FROM fx_pattern_counts a JOIN fx_pattern_counts b
      ON NOT a.called AND b.called AND (regexp_full_match(b.pattern, replace(a.pattern, '-', '.')) OR regexp_full_match(translate(b.pattern, '01', '10'), replace(a.pattern, '-', '.')))) q""",
         lambda fx: S.compatible_patterns(fx.fx_pattern_counts, len(MEMBERS)))


@register("d10_interval_lookup", "SELECT site_id, genic, cov FROM fx_annotated")
def d10(fx):
    return fx.fx_annotated.select("site_id", "genic", "cov")


@register("c12_min_coverage", "SELECT site_id, cov FROM fx_annotated WHERE cov >= 1.0")
def c12(fx):
    return fx.fx_annotated.filter("cov >= 1.0").select("site_id", "cov")


@register("e19_site_scores", f"""
    SELECT s.site_id, n_called, n_het, {rq('s.het_freq', 6)} AS het_freq, {rq('missing_freq', 6)} AS missing_freq, {rq('het_score', 6)} AS het_score, s.bin_id,
           {rq('s.het_freq * (log2(cov + 1) + 0.1 * genic)', 6)} AS selection FROM fx_scored s JOIN fx_annotated a ON a.site_id = s.site_id""")
def e19(fx):
    d = fx.fx_scored.join(fx.fx_annotated.select("site_id", "cov", "genic"), "site_id")
    sel = S.selection_score(F.col("het_freq"), F.col("cov"), F.col("genic"))
    return d.select("site_id", "n_called", "n_het", r("het_freq", 6).alias("het_freq"), r("missing_freq", 6).alias("missing_freq"),
                    r("het_score", 6).alias("het_score"), "bin_id", r(sel, 6).alias("selection"))


@register("e20_distinguishing_pairs", """
    SELECT *, CAST(row_number() OVER (ORDER BY differ DESC, i, j) AS INT) AS from_top, CAST(row_number() OVER (ORDER BY differ, i, j) AS INT) AS from_bottom FROM (
      SELECT g.sample AS i, h.sample AS j, count(*) AS sites, count(*) FILTER (WHERE g.nalt <> h.nalt) AS differ
      FROM fx_genotypes g JOIN fx_genotypes h ON g.site_id = h.site_id AND g.sample < h.sample GROUP BY 1, 2) q""")
def e20(fx):
    return S.distinguishing_pairs(fx.fx_genotypes)


@register("e17_pattern_counts", "SELECT pattern, cnt FROM fx_pattern_counts WHERE called")
def e17(fx):
    return fx.fx_pattern_counts.filter("called").select("pattern", "cnt")


@register("e18_partial_pattern_counts", "SELECT pattern, cnt FROM fx_pattern_counts WHERE NOT called")
def e18(fx):
    return fx.fx_pattern_counts.filter("NOT called").select("pattern", "cnt")


@register("d13_compatible_patterns", f"""SELECT partial, "full", full_cnt, {rq('share', 6)} AS share FROM fx_compat""")
def d13(fx):
    return fx.fx_compat.select("partial", "full", "full_cnt", r("share", 6).alias("share"))


SCORED = "SELECT p.site_id, p.pattern, round(log2(cov + 1) + 0.1 * genic, 9) AS score FROM fx_patterns p JOIN fx_annotated a ON a.site_id = p.site_id WHERE called AND cov >= 1.0"
EXP, CUTOFF = 0.7, 5
SLOTS = f"""
    WITH sc AS ({SCORED}), av AS (SELECT pattern, count(*) AS avail FROM sc GROUP BY pattern),
    sl AS (SELECT c.pattern, coalesce(avail, 0) AS avail, CASE WHEN cnt >= {CUTOFF} THEN greatest(floor(round(pow(cnt, {EXP}), 9)), 1) ELSE cnt END AS slots
           FROM fx_pattern_counts c LEFT JOIN av USING (pattern) WHERE called),
    ex AS (SELECT pattern, slots, slots + CASE WHEN sum(greatest(avail - slots, 0)) OVER () > 0 THEN
             least(round(sum(greatest(slots - avail, 0)) OVER () * greatest(avail - slots, 0) / sum(greatest(avail - slots, 0)) OVER ()), greatest(avail - slots, 0)) ELSE 0 END AS take FROM sl),
    rk AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, site_id) AS rank FROM sc)"""


def _scored(fx):
    a = fx.fx_annotated.filter("cov >= 1.0").select("site_id", "cov", "genic")
    return fx.fx_patterns.filter("called").join(a, "site_id").select(
        "site_id", "pattern", F.round(S.coverage_score(F.col("cov"), F.col("genic")), 9).alias("score"))


@register("f10_top_sites_per_pattern", SLOTS + " SELECT rk.pattern, rk.site_id, CAST(rank AS BIGINT) AS rank FROM rk JOIN ex USING (pattern) WHERE rank <= slots")
def f10(fx):
    d = S.slot_selection(_scored(fx), fx.fx_pattern_counts, EXP, CUTOFF)
    return d.filter("rank <= slots").select("pattern", "site_id", F.col("rank").cast("bigint").alias("rank"))


@register("f11_redistributed_slots", SLOTS + " SELECT rk.pattern, rk.site_id, CAST(rank AS BIGINT) AS rank FROM rk JOIN ex USING (pattern) WHERE rank <= take")
def f11(fx):
    return S.slot_selection(_scored(fx), fx.fx_pattern_counts, EXP, CUTOFF).select("pattern", "site_id", F.col("rank").cast("bigint").alias("rank"))


@register("f12_top_het_sites", f"SELECT site_id, {rq('score', 6)} AS score FROM (SELECT site_id, round(het_freq * (log2(cov + 1) + 0.1 * genic), 9) AS score FROM fx_annotated) q ORDER BY q.score DESC, site_id LIMIT 100")
def f12(fx):
    sc = F.round(S.selection_score(F.col("het_freq"), F.col("cov"), F.col("genic")), 9)
    return S.top_sites(fx.fx_annotated.withColumn("score", sc), "score", 100).select("site_id", r("score", 6).alias("score"))


@register("f12_top_het_sites_even_bins", f"""
    SELECT site_id, {rq('score', 6)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY score DESC, site_id) AS n FROM (
      SELECT site_id, bin_id, round(het_freq * (log2(cov + 1) + 0.1 * genic), 9) AS score FROM fx_annotated) q) z ORDER BY n, z.score DESC, site_id LIMIT 100""")
def f12b(fx):
    sc = F.round(S.selection_score(F.col("het_freq"), F.col("cov"), F.col("genic")), 9)
    return S.top_sites(fx.fx_annotated.withColumn("score", sc), "score", 100, even_bins=True).select("site_id", r("score", 6).alias("score"))


@register("i34_sampling_exponent")
def i34(fx):
    total = fx.fx_patterns.count()
    x, c = S.sampling_exponent(S.with_partial(fx.fx_pattern_counts, fx.fx_compat), total // 3)
    return fx.spark.range(1).select(r(F.lit(x), 6).alias("exponent"), r(F.lit(c), 6).alias("cutoff"))


KEEP = f"CASE WHEN {{c}} >= {CUTOFF} THEN pow({{c}}, {EXP} - 1.0) ELSE 1.0 END"
add_view("fx_site_prob", f"""
    SELECT s.site_id, least(coalesce(a.p, b.p, 1.0), 1.0) AS p FROM fx_patterns s
    LEFT JOIN (SELECT pattern, {KEEP.format(c='cnt')} AS p FROM fx_pattern_counts WHERE called) a ON a.pattern = s.pattern
    LEFT JOIN (SELECT partial, sum(share * {KEEP.format(c='full_cnt')}) AS p FROM fx_compat GROUP BY partial) b ON b.partial = s.pattern""",
         lambda fx: S.site_probability(fx.fx_patterns, fx.fx_pattern_counts, fx.fx_compat, EXP, CUTOFF))


@register("i35_keep_probability", f"SELECT site_id, {rq('p', 6)} AS p FROM fx_site_prob")
def i35(fx):
    return fx.fx_site_prob.select("site_id", r("p", 6).alias("p"))


@register("i36_sampled_sites", """
    SELECT site_id FROM fx_site_prob WHERE p >= 1 OR CAST(concat('0x', substr(md5(concat('s|', CAST(site_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < p""")
def i36(fx):
    return S.sample_sites(fx.fx_site_prob).select("site_id")


REGENO_TOL = 1e-6


def _regeno_sql() -> str:
    """Passes as a recursion in which each site stops by itself, then genotypes and the binomial sum term by term."""
    return f"""
    WITH RECURSIVE b AS MATERIALIZED (SELECT i, j, site_id, sum(ref_w) / 1e6 AS ref, sum(alt_w) / 1e6 AS alt FROM fx_cell_site JOIN fx_truth USING (barcode) GROUP BY i, j, site_id),
    it AS (SELECT DISTINCT 0 AS k, site_id, m, 0.5::DOUBLE AS f, 0.0::DOUBLE AS n, 1.0::DOUBLE AS moved FROM (SELECT site_id, i AS m FROM b UNION SELECT site_id, j FROM b) q
      UNION ALL (WITH now AS MATERIALIZED (SELECT * FROM it WHERE moved >= {REGENO_TOL}),
      s AS (SELECT b.site_id, b.i AS m, alt AS a, ref AS r FROM b JOIN now ON now.site_id = b.site_id AND now.m = b.i WHERE b.i = b.j UNION ALL
        SELECT b.site_id, z.m, CASE WHEN p.f + q.f > 0 THEN alt * CASE WHEN z.m = b.i THEN p.f ELSE q.f END / (p.f + q.f) ELSE alt * 0.5 END,
               CASE WHEN 2 - p.f - q.f > 0 THEN ref * (1 - CASE WHEN z.m = b.i THEN p.f ELSE q.f END) / (2 - p.f - q.f) ELSE ref * 0.5 END
        FROM b JOIN now p ON p.site_id = b.site_id AND p.m = b.i JOIN now q ON q.site_id = b.site_id AND q.m = b.j, LATERAL (VALUES (b.i), (b.j)) z(m) WHERE b.i <> b.j),
      g AS (SELECT site_id, m, CASE WHEN sum(a) + sum(r) > 0 THEN round(sum(a) / (sum(a) + sum(r)), 9) ELSE 0.5 END AS f, sum(a) + sum(r) AS n FROM s GROUP BY site_id, m)
      SELECT now.k + 1, g.site_id, g.m, g.f, g.n, max(abs(g.f - now.f)) OVER (PARTITION BY g.site_id) FROM g JOIN now ON now.site_id = g.site_id AND now.m = g.m)),
    g AS MATERIALIZED (SELECT site_id, m, f, CASE WHEN f < 0.25 THEN 0 WHEN f < 0.75 THEN 1 ELSE 2 END AS nalt FROM it
      WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY site_id, m ORDER BY k DESC) = 1),
    e AS (SELECT b.site_id, sum(ref) AS ro, sum(alt) AS ao, 1 + sum((1 - (x.nalt + y.nalt) / 4) * (ref + alt)) AS er, 1 + sum((x.nalt + y.nalt) / 4 * (ref + alt)) AS ea
      FROM b JOIN g x ON x.site_id = b.site_id AND x.m = b.i JOIN g y ON y.site_id = b.site_id AND y.m = b.j GROUP BY b.site_id),
    t AS (SELECT site_id, CAST(round(ao) AS BIGINT) AS k, CAST(round(ao) + round(ro) AS BIGINT) AS n, ea / (ea + er) AS q FROM e),
    c AS (SELECT site_id, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(q) + (n - x) * ln(1 - q))) AS c
      FROM (SELECT *, unnest(range(0, k + 1)) AS x FROM t WHERE n > 0) u GROUP BY site_id),
    poly AS (SELECT site_id FROM g GROUP BY site_id HAVING min(nalt) <> max(nalt))
    SELECT g.site_id, m AS sample, {rq('f', 4)} AS rate, CAST(nalt AS INT) AS nalt, {rq('2 * least(c, 1 - c)', 5)} AS p
    FROM g JOIN poly ON poly.site_id = g.site_id JOIN c ON c.site_id = g.site_id WHERE 2 * least(c, 1 - c) > {{p_min}}"""


def _regenotyped(fx, p_min: float):
    d = S.regenotype(C.identity_site_counts(fx.fx_cell_site, fx.fx_truth), p_min, REGENO_TOL)
    return d.select("site_id", "sample", r("rate", 4).alias("rate"), "nalt", r("p", 5).alias("p"))


@register("i33_regenotype", _regeno_sql().format(p_min=0.01))
def i33(fx):
    return _regenotyped(fx, 0.01)


@register("i33_regenotype_all_polymorphic", _regeno_sql().format(p_min=-1))
def i33_all(fx):
    """The same without a bound on p, so that small values are compared as well."""
    return _regenotyped(fx, -1.0)


@register("b15_variant_table", f"""
    SELECT s.chrom, s.pos, s.ref, s.alt, concat('N_HET=', CAST(c.n_het AS VARCHAR), ';N_CALLED=', CAST(c.n_called AS VARCHAR), ';BIN_ID=', c.bin_id) AS info
    FROM fx_sites s JOIN fx_scored c ON c.site_id = s.site_id""")
def b15(fx):
    from poolcall.session import fresh_path
    from poolcall.sources import sinks
    path = fresh_path(fx.spark, "variants")
    d = fx.fx_scored.withColumn("info", F.concat(F.lit("N_HET="), F.col("n_het"), F.lit(";N_CALLED="), F.col("n_called"), F.lit(";BIN_ID="), F.col("bin_id")))
    sinks.write_variants(d, path)
    return fx.spark.read.schema("chrom STRING, pos BIGINT, id STRING, ref STRING, alt STRING, qual STRING, filter STRING, info STRING").csv(
        path, sep="\t").select("chrom", "pos", "ref", "alt", "info")
