"""Genotype demultiplexing: filters, joins, counts, likelihood ratios, calls and their checks."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from poolcall.functions import expr as X
from poolcall.operators import counts as C, error_rates as E, joins as J, likelihood as L, qc as Q
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq

USABLE = 4 + 256 + 512 + 1024  # unmapped, secondary, failed checks, duplicate


def adj(p: str, er=L.E_REF, ea=L.E_ALT) -> str:
    q = f"(({p}) - ({p}) * {ea} + (1 - ({p})) * {er})"
    return f"greatest(least({q}, 1 - 1e-8), 1e-8)"


def llr2(p1: str, p2: str) -> str:
    return f"(alt * log2({p1} / {p2}) + ref * log2((1 - {p1}) / (1 - {p2})))"


PI, PJ, PK = adj("ni / 2.0"), adj("nj / 2.0"), adj("(ni + nj) / 4.0")

add_view("fx_pair_counts", """
    SELECT c.barcode, g.sample AS i, g.nalt AS ni, h.sample AS j, h.nalt AS nj,
           CAST(sum(ref_w) AS BIGINT) AS ref_w, CAST(sum(alt_w) AS BIGINT) AS alt_w
    FROM fx_cell_site c JOIN fx_genotypes g USING (site_id) JOIN fx_genotypes h ON h.site_id = c.site_id AND h.sample > g.sample
    GROUP BY ALL
    UNION ALL
    SELECT c.barcode, g.sample, g.nalt, -1, -1, CAST(sum(ref_w) AS BIGINT), CAST(sum(alt_w) AS BIGINT)
    FROM fx_cell_site c JOIN fx_genotypes g USING (site_id) GROUP BY ALL""",
         lambda fx: C.pair_counts(fx.fx_cell_site, fx.fx_genotypes))

add_view("fx_pair_llr", f"""
    SELECT barcode, i, j, sum({llr2(PI, PJ)}) AS l, sum({llr2(PI, PK)}) AS si, sum({llr2(PJ, PK)}) AS sj
    FROM (SELECT *, round(ref_w / 1e6) AS ref, round(alt_w / 1e6) AS alt FROM fx_pair_counts WHERE j >= 0 AND ni <> nj) q
    GROUP BY barcode, i, j""",
         lambda fx: L.pair_llr(fx.fx_pair_counts))

# every two identities of a cell, by the reference's cases written out as joins
add_view("fx_idlist", """
    SELECT barcode, a, b, CASE WHEN a = b THEN a ELSE 4096 + a * 4096 + b END AS id FROM (
      SELECT DISTINCT barcode, i AS a, i AS b FROM fx_pair_llr UNION SELECT DISTINCT barcode, j, j FROM fx_pair_llr
      UNION SELECT DISTINCT barcode, i, j FROM fx_pair_llr) q""", lambda fx: None)
add_view("fx_both", """
    SELECT barcode, i AS p, j AS q, l, si AS s FROM fx_pair_llr UNION ALL SELECT barcode, j, i, -l, sj FROM fx_pair_llr
    UNION ALL SELECT barcode, a, a, 0.0, 0.0 FROM fx_idlist WHERE a = b""", lambda fx: None)


def llr_sql(d: float) -> str:
    prior = math.log2(1 - d) - math.log2(d) if d != 0.5 else 0.0
    return f"""
    SELECT x.barcode, x.id AS id1, y.id AS id2, (round(CASE
        WHEN x.a = x.b AND y.a <> y.b AND (x.a = y.a OR x.a = y.b)
          THEN (SELECT s FROM fx_both t WHERE t.barcode = x.barcode AND t.p = x.a AND t.q = CASE WHEN y.a = x.a THEN y.b ELSE y.a END)
        WHEN x.a <> x.b AND y.a <> y.b AND (x.a IN (y.a, y.b) OR x.b IN (y.a, y.b))
          THEN (SELECT s FROM fx_both t WHERE t.barcode = x.barcode AND t.p = CASE WHEN x.a IN (y.a, y.b) THEN x.a ELSE x.b END
                  AND t.q = CASE WHEN y.a IN (x.a, x.b) THEN y.b ELSE y.a END)
             - (SELECT s FROM fx_both t WHERE t.barcode = x.barcode AND t.p = CASE WHEN x.a IN (y.a, y.b) THEN x.a ELSE x.b END
                  AND t.q = CASE WHEN x.a IN (y.a, y.b) THEN x.b ELSE x.a END)
        ELSE (ac.l + ad.l + bc.l + bd.l) / 4 + (cd.s + dc.s - ab.s - ba.s) / 2 END
        + CASE WHEN x.a = x.b AND y.a <> y.b THEN {prior!r} ELSE 0 END, 6) + 0.0) AS llr
    FROM fx_idlist x JOIN fx_idlist y ON x.barcode = y.barcode AND x.id < y.id
    JOIN fx_both ac ON ac.barcode = x.barcode AND ac.p = x.a AND ac.q = y.a
    JOIN fx_both ad ON ad.barcode = x.barcode AND ad.p = x.a AND ad.q = y.b
    JOIN fx_both bc ON bc.barcode = x.barcode AND bc.p = x.b AND bc.q = y.a
    JOIN fx_both bd ON bd.barcode = x.barcode AND bd.p = x.b AND bd.q = y.b
    JOIN fx_both ab ON ab.barcode = x.barcode AND ab.p = x.a AND ab.q = x.b
    JOIN fx_both ba ON ba.barcode = x.barcode AND ba.p = x.b AND ba.q = x.a
    JOIN fx_both cd ON cd.barcode = x.barcode AND cd.p = y.a AND cd.q = y.b
    JOIN fx_both dc ON dc.barcode = x.barcode AND dc.p = y.b AND dc.q = y.a"""


add_view("fx_llr", llr_sql(0.5), lambda fx: fx.fx_llr_table.select("barcode", F.explode("llrs").alias("c"))
         .select("barcode", "c.id1", "c.id2", "c.llr"))
add_view("fx_llr_prior", llr_sql(0.1), lambda fx: L.identity_table(L.cell_pairs(fx.fx_pair_llr), 0.1)
         .select("barcode", F.explode("llrs").alias("c")).select("barcode", "c.id1", "c.id2", "c.llr"))
add_view("fx_llr_table", "SELECT 1 FROM fx_llr", lambda fx: L.identity_table(L.cell_pairs(fx.fx_pair_llr)))


def fold_sql(source: str, keep: int) -> str:
    """The elimination as a recursive walk over the ordered comparisons."""
    return f"""
    WITH RECURSIVE cmp AS (
      SELECT barcode, CASE WHEN llr > 0 THEN id1 ELSE id2 END AS win, CASE WHEN llr > 0 THEN id2 ELSE id1 END AS lose, abs(llr) AS v,
             row_number() OVER (PARTITION BY barcode ORDER BY abs(llr) DESC, id1, id2) AS n FROM {source}),
    start AS (SELECT barcode, CAST(count(DISTINCT id) AS INT) AS k FROM (
        SELECT barcode, win AS id FROM cmp UNION SELECT barcode, lose FROM cmp) q GROUP BY barcode),
    walk AS (
      SELECT barcode, 0::BIGINT AS n, k AS remain, []::INT[] AS gone, NULL::INT AS win, NULL::DOUBLE AS llr FROM start
      UNION ALL
      SELECT w.barcode, c.n,
             CASE WHEN live AND remain > {keep} THEN remain - 1 ELSE remain END,
             CASE WHEN live AND remain > {keep} THEN list_append(gone, CAST(c.lose AS INT)) ELSE gone END,
             CASE WHEN live AND remain = 2 AND {keep} = 2 AND w.win IS NULL THEN CAST(c.win AS INT) ELSE w.win END,
             CASE WHEN live AND remain = 2 AND {keep} = 2 AND w.win IS NULL THEN c.v ELSE w.llr END
      FROM walk w JOIN (SELECT * FROM cmp) c ON c.barcode = w.barcode AND c.n = w.n + 1,
      LATERAL (SELECT NOT (list_contains(gone, CAST(c.win AS INT)) OR list_contains(gone, CAST(c.lose AS INT))) AS live) z),
    done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY n DESC) = 1)"""


DECODE = ("CAST(CASE WHEN {w} < 4096 THEN {w} ELSE ({w} - 4096) // 4096 END AS INT) AS i, "
          "CAST(CASE WHEN {w} < 4096 THEN {w} ELSE ({w} - 4096) % 4096 END AS INT) AS j")

add_view("fx_calls", fold_sql("fx_llr", 2) + f"\nSELECT barcode, {DECODE.format(w='win')}, llr FROM done WHERE llr > 0",
         lambda fx: L.eliminate(fx.fx_llr_table))
add_view("fx_margin", """
    SELECT barcode, id, min(llr) AS margin, arg_min(rival, (llr, rival)) AS rival FROM (
      SELECT barcode, id1 AS id, id2 AS rival, llr FROM fx_llr UNION ALL SELECT barcode, id2, id1, -llr FROM fx_llr) q
    GROUP BY barcode, id""", lambda fx: L.margins(fx.fx_llr_table))
add_view("fx_named", """
    SELECT barcode, CASE WHEN i = j THEN a.name ELSE least(a.name, b.name) || '+' || greatest(a.name, b.name) END AS id,
           CASE WHEN i = j THEN 'S' ELSE 'D' END AS type, llr, i, j
    FROM fx_calls JOIN fx_samples a ON a.sample = i JOIN fx_samples b ON b.sample = j""",
         lambda fx: L.name_identities(fx.fx_calls, fx.fx_samples))


# --- filters ------------------------------------------------------------------------------------

@register("c1_usable_reads", f"""
    SELECT barcode, count(*) AS reads, CAST(sum(read_id) AS BIGINT) AS id_sum FROM fx_reads
    WHERE (flag & {USABLE}) = 0 AND barcode IS NOT NULL GROUP BY barcode""")
def c1(fx):
    return (fx.fx_reads.filter((F.col("flag").bitwiseAND(F.lit(USABLE)) == 0) & F.col("barcode").isNotNull())
            .groupBy("barcode").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").alias("id_sum")))


@register("c2_min_quality", """
    SELECT chrom, count(*) AS reads, CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM fx_reads WHERE mapq >= 30 GROUP BY chrom""")
def c2(fx):
    return fx.fx_reads.filter("mapq >= 30").groupBy("chrom").agg(
        F.count(F.lit(1)).alias("reads"), F.sum("mapq").alias("mapq_sum"))


@register("c3_biallelic_snps", """
    SELECT site_id, chrom, pos, ref, alt, qual FROM fx_sites
    WHERE qual >= 20 AND ref <> alt AND regexp_matches(ref, '^[ACGT]$') AND regexp_matches(alt, '^[ACGT]$')""")
def c3(fx):
    from poolcall.operators.sites import biallelic
    return fx.fx_sites.filter(biallelic(20)).select("site_id", "chrom", "pos", "ref", "alt", "qual")


@register("c4_complete_sites", """
    SELECT site_id FROM fx_genotypes GROUP BY site_id HAVING count(*) = (SELECT count(*) FROM fx_samples)""")
def c4(fx):
    from poolcall.operators.sites import complete_sites
    return complete_sites(fx.fx_genotypes, fx.fx_samples)


@register("c5_polymorphic_sites", """
    SELECT site_id FROM fx_genotypes GROUP BY site_id HAVING sum(nalt) > 0 AND sum(2 - nalt) > 0""")
def c5(fx):
    from poolcall.operators.sites import polymorphic_sites
    return polymorphic_sites(fx.fx_genotypes)


@register("c6_unrepeated_positions", """
    SELECT site_id, chrom, p2 AS pos FROM (
      SELECT site_id, chrom, CASE WHEN site_id % 7 = 0 THEN pos - pos % 200 + 1 ELSE pos END AS p2,
             count(*) OVER (PARTITION BY chrom, CASE WHEN site_id % 7 = 0 THEN pos - pos % 200 + 1 ELSE pos END) AS n
      FROM fx_sites) q WHERE n = 1""")
def c6(fx):
    from poolcall.operators.sites import unrepeated
    moved = F.when(F.col("site_id") % 7 == 0, F.col("pos") - F.col("pos") % 200 + 1).otherwise(F.col("pos"))
    return unrepeated(fx.fx_sites.withColumn("pos", moved)).select("site_id", "chrom", "pos")


@register("c7_cell_allow_list", """
    SELECT barcode, count(*) AS reads FROM fx_reads WHERE barcode IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    GROUP BY barcode""")
def c7(fx):
    allow = fx.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("barcode"))
    return fx.fx_reads.groupBy("barcode").agg(F.count(F.lit(1)).alias("reads")).join(allow, "barcode", "left_semi")


@register("c8_chromosome_list", """
    SELECT chrom, count(*) AS sites FROM fx_sites
    WHERE chrom IN (SELECT chrom FROM fx_reads INTERSECT SELECT concat('chr', CAST(r_regionkey AS VARCHAR)) FROM region WHERE r_regionkey <> 2)
    GROUP BY chrom""")
def c8(fx):
    wanted = fx.region.filter("r_regionkey <> 2").select(F.concat(F.lit("chr"), F.col("r_regionkey").cast("string")).alias("chrom"))
    keep = fx.fx_reads.select("chrom").distinct().intersect(wanted)
    return fx.fx_sites.join(keep, "chrom", "left_semi").groupBy("chrom").agg(F.count(F.lit(1)).alias("sites"))


@register("c9_llr_threshold", "SELECT barcode, id, llr FROM fx_labels_a WHERE llr > 50")
def c9(fx):
    return fx.fx_labels_a.filter("llr > 50").select("barcode", "id", "llr")


@register("g3_shared_chromosomes", """
    SELECT chrom FROM fx_sites INTERSECT SELECT chrom FROM fx_reads""")
def g3(fx):
    return fx.fx_sites.select("chrom").distinct().intersect(fx.fx_reads.select("chrom").distinct())


# --- joins and counts ---------------------------------------------------------------------------

@register("d1_reads_at_sites", """
    SELECT barcode, site_id, count(*) AS reads, CAST(sum(read_id) AS BIGINT) AS id_sum
    FROM fx_reads r JOIN fx_sites s ON r.chrom = s.chrom AND s.pos >= r.rstart AND s.pos <= r.rend GROUP BY barcode, site_id""")
def d1(fx):
    p = J.range_join(fx.fx_reads.select("read_id", "barcode", "chrom", "rstart", "rend"),
                     fx.fx_sites.select("site_id", "chrom", "pos"), salt_by=["read_id"])
    return p.groupBy("barcode", "site_id").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").alias("id_sum"))


@register("d2_pile_by_genotype", """
    SELECT barcode, sample, nalt, count(*) AS sites, CAST(sum(ref_w) AS BIGINT) AS ref_w, CAST(sum(alt_w) AS BIGINT) AS alt_w
    FROM fx_cell_site JOIN fx_genotypes USING (site_id) GROUP BY barcode, sample, nalt""")
def d2(fx):
    pat = C.cell_patterns(fx.fx_cell_site.withColumn("one", F.lit(1)), fx.fx_genotypes, {"n": F.sum("one")})
    return (pat.select("barcode", "ref_w", "alt_w", "n", F.explode("calls").alias("c")).groupBy("barcode", "c.sample", "c.nalt")
            .agg(F.sum("n").alias("sites"), F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w")))


@register("d3_sample_pairs", """
    SELECT g.sample AS i, h.sample AS j, g.nalt AS ni, h.nalt AS nj, count(*) AS sites
    FROM fx_genotypes g JOIN fx_genotypes h ON g.site_id = h.site_id AND g.sample < h.sample GROUP BY ALL""")
def d3(fx):
    return C.pair_sites(fx.fx_genotypes)


@register("d6_pile_with_identity", """
    SELECT i, j, is_alt, count(*) AS reads FROM fx_pileup JOIN fx_truth USING (barcode) GROUP BY i, j, is_alt""")
def d6(fx):
    per = fx.fx_pileup.groupBy("barcode", "is_alt").agg(F.count(F.lit(1)).alias("n"))  # reads combine before the join
    return per.join(fx.fx_truth, "barcode").groupBy("i", "j", "is_alt").agg(F.sum("n").alias("reads"))


@register("d7_doublet_members", """
    SELECT barcode, unnest(string_split(id, '+')) AS member, id, CASE WHEN contains(id, '+') THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
    FROM fx_labels_a""")
def d7(fx):
    from poolcall.operators.labels import members
    return members(fx.fx_labels_a).select("barcode", "member", "id", "weight")


@register("e1_cell_site_weights", "SELECT barcode, site_id, ref_w, alt_w FROM fx_cell_site")
def e1(fx):
    return fx.fx_cell_site.select("barcode", "site_id", "ref_w", "alt_w")


@register("e2_bulk_site_counts", """
    SELECT site_id, CAST(sum(CASE WHEN is_alt = 0 THEN CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT) ELSE 0 END) AS BIGINT) AS ref_w,
           CAST(sum(CASE WHEN is_alt = 1 THEN CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT) ELSE 0 END) AS BIGINT) AS alt_w,
           array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes
    FROM fx_pileup GROUP BY site_id""")
def e2(fx):
    b = C.bulk_site_counts(fx.fx_pileup)
    return b.withColumn("genes", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",")).drop("other_w")


@register("e3_identity_site_counts", """
    SELECT i, j, site_id, CAST(sum(ref_w) AS BIGINT) AS ref_w, CAST(sum(alt_w) AS BIGINT) AS alt_w
    FROM fx_cell_site JOIN fx_truth USING (barcode) GROUP BY i, j, site_id""")
def e3(fx):
    return C.identity_site_counts(fx.fx_cell_site, fx.fx_truth)


@register("e4_pair_counts", "SELECT barcode, i, ni, j, nj, ref_w, alt_w FROM fx_pair_counts")
def e4(fx):
    return fx.fx_pair_counts.select("barcode", "i", "ni", "j", "nj", "ref_w", "alt_w")


COND = """
    SELECT g.sample AS i, g.nalt AS ni, h.sample AS j, CASE WHEN g.sample = h.sample THEN g.nalt / 2.0 ELSE avg(h.nalt / 2.0) END AS frac
    FROM fx_genotypes g JOIN fx_genotypes h ON g.site_id = h.site_id GROUP BY g.sample, g.nalt, h.sample"""
add_view("fx_cond", COND, lambda fx: C.conditional_fractions(fx.fx_genotypes))


@register("e5_conditional_fractions", f"SELECT i, ni, j, {rq('frac', 6)} AS frac FROM fx_cond")
def e5(fx):
    return fx.fx_cond.select("i", "ni", "j", r("frac", 6).alias("frac"))


@register("e23_het_balance", f"""
    SELECT c.barcode, g.sample, count(*) AS n, {rq('avg(f)', 6)} AS mean, {rq('var_samp(f)', 6)} AS var FROM (
      SELECT barcode, site_id, alt_w / (ref_w + alt_w) AS f FROM fx_cell_site) c
    JOIN fx_genotypes g ON g.site_id = c.site_id AND g.nalt = 1 GROUP BY c.barcode, g.sample""")
def e23(fx):
    h = C.het_balance(fx.fx_pileup, fx.fx_genotypes)
    return h.select("barcode", "sample", "n", r("mean", 6).alias("mean"), r("var", 6).alias("var"))


@register("i42_het_variance", f"""
    SELECT t.barcode, t.i, t.j, count(*) AS n, {rq('avg(f)', 6)} AS mean, {rq('var_samp(f)', 6)} AS var FROM (
      SELECT barcode, site_id, alt_w / (ref_w + alt_w) AS f FROM fx_cell_site) c
    JOIN fx_truth t ON t.barcode = c.barcode JOIN fx_genotypes g ON g.site_id = c.site_id AND g.nalt = 1 AND g.sample IN (t.i, t.j)
    GROUP BY t.barcode, t.i, t.j""")
def i42(fx):
    h = C.assigned_het_variance(fx.fx_cell_site, fx.fx_genotypes, fx.fx_truth)
    return h.select("barcode", "i", "j", "n", r("mean", 6).alias("mean"), r("var", 6).alias("var"))


@register("e32_cell_depth", f"""
    SELECT barcode, {rq("sum(ref_w + alt_w) / 1e6 / (SELECT count(*) FROM fx_samples)")} AS depth
    FROM fx_pair_counts WHERE j = -1 GROUP BY barcode""")
def e32(fx):
    n = fx.fx_samples.agg(F.count(F.lit(1)).alias("s"))
    d = fx.fx_pair_counts.filter("j = -1").groupBy("barcode").agg(F.sum(F.col("ref_w") + F.col("alt_w")).alias("t"))
    return d.join(F.broadcast(n)).select("barcode", r(F.col("t") / 1e6 / F.col("s")).alias("depth"))  # one row


# --- likelihood ratios and calls ------------------------------------------------------------------

@register("i1_pair_llr", f"SELECT barcode, i, j, {rq('l')} AS l, {rq('si')} AS si, {rq('sj')} AS sj FROM fx_pair_llr")
def i1(fx):
    return fx.fx_pair_llr.select("barcode", "i", "j", r("l").alias("l"), r("si").alias("si"), r("sj").alias("sj"))


add_view("fx_singlet_llr", "SELECT barcode, i AS id1, j AS id2, round(l, 6) AS llr FROM fx_pair_llr", lambda fx: None)


PRUNED = fold_sql("fx_singlet_llr", 3) + """
    SELECT s.barcode, CAST(s.id AS INT) AS member FROM (SELECT barcode, win AS id FROM cmp UNION SELECT barcode, lose FROM cmp) s
    JOIN done d ON d.barcode = s.barcode WHERE NOT list_contains(d.gone, CAST(s.id AS INT))"""


@register("i2_prune_singlets", PRUNED)
def i2(fx):
    return L.cell_pairs(fx.fx_pair_llr, keep=3).select("barcode", F.explode("members").alias("member"))


@register("i2_prune_before_pairs", PRUNED)
def i2_before_pairs(fx):
    """The members left at three, with pairs counted only among those that one score per member leaves."""
    return L.pruned_cells(fx.fx_cell_site, fx.fx_genotypes, keep=3).select("barcode", F.explode("members").alias("member"))


@register("i5_calls_before_pairs", f"SELECT barcode, id, type, {rq('llr', 6)} AS llr FROM fx_named")
def i5_before_pairs(fx):
    calls = L.call_from_counts(fx.fx_cell_site, fx.fx_genotypes)
    return L.name_identities(calls, fx.fx_samples).select("barcode", "id", "type", r("llr", 6).alias("llr"))


@register("i3_singlet_vs_doublet", f"SELECT barcode, id1, id2, {rq('llr', 6)} AS llr FROM fx_llr_prior WHERE id1 < 4096 AND id2 >= 4096")
def i3(fx):
    return fx.fx_llr_prior.filter("id1 < 4096 AND id2 >= 4096").select("barcode", "id1", "id2", r("llr", 6).alias("llr"))


@register("i4_doublet_vs_doublet", f"SELECT barcode, id1, id2, {rq('llr', 6)} AS llr FROM fx_llr WHERE id1 >= 4096")
def i4(fx):
    return fx.fx_llr.filter("id1 >= 4096").select("barcode", "id1", "id2", r("llr", 6).alias("llr"))


@register("i5_eliminate", f"SELECT barcode, id, type, {rq('llr', 6)} AS llr FROM fx_named")
def i5(fx):
    return fx.fx_named.select("barcode", "id", "type", r("llr", 6).alias("llr"))


@register("i5c_max_min", f"""
    SELECT barcode, {DECODE.format(w='b.id')}, {rq('b.margin', 6)} AS llr FROM (
      SELECT barcode, arg_max({{'id': id, 'margin': margin}}, (margin, -id)) AS b FROM fx_margin GROUP BY barcode) q WHERE b.margin > 0""")
def i5c(fx):
    return L.max_min(fx.fx_margin).select("barcode", "i", "j", r("llr", 6).alias("llr"))


PSUM = adj("CASE WHEN j < 0 THEN ni / 2.0 ELSE (ni + nj) / 4.0 END")


@register("i5b_additive_scores", f"""
    SELECT barcode, CAST(arg_max(id, (ll, -id)) AS INT) AS id, {rq("max(ll) - max(ll2)", 6)} AS llr FROM (
      SELECT *, lead(ll) OVER (PARTITION BY barcode ORDER BY ll DESC, id) AS ll2 FROM (
        SELECT barcode, CASE WHEN j < 0 THEN i ELSE 4096 + i * 4096 + j END AS id,
               round(sum(round(alt_w / 1e6) * log2({PSUM}) + round(ref_w / 1e6) * log2(1 - {PSUM})), 6) AS ll
        FROM fx_pair_counts GROUP BY ALL) q) z GROUP BY barcode""")
def i5b(fx):
    return L.best_two(L.additive_scores(fx.fx_pair_counts)).select("barcode", "id", r("llr", 6).alias("llr"))


@register("f6_winner_diagnostics", f"""
    SELECT barcode, CAST(w.id AS INT) AS winner, {rq('w.margin', 6)} AS min_margin, CAST(w.rival AS INT) AS worst_rival,
           CAST((SELECT count(*) FROM fx_margin m WHERE m.barcode = q.barcode AND m.id <> w.id AND w.margin - m.margin < 20) AS INT) AS n_close
    FROM (SELECT barcode, arg_max({{'id': id, 'margin': margin, 'rival': rival}}, (margin, -id)) AS w FROM fx_margin GROUP BY barcode) q""")
def f6(fx):
    return L.winner_diagnostics(fx.fx_margin).withColumn("min_margin", r("min_margin", 6))


@register("f7_runner_ups", f"""
    SELECT barcode, CAST(n - 1 AS INT) AS rank, CAST(id AS INT) AS id, {rq('margin', 6)} AS margin FROM (
      SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY margin DESC, id) AS n FROM fx_margin) q WHERE n BETWEEN 2 AND 9""")
def f7(fx):
    return L.runner_ups(fx.fx_margin).withColumn("margin", r("margin", 6))


@register("b12_diagnostic_tables", f"""
    SELECT 'winner' AS kind, barcode, {rq('max(margin)', 6)} AS value FROM fx_margin GROUP BY barcode
    UNION ALL SELECT 'runner_up', barcode, {rq('margin', 6)} FROM (
      SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY margin DESC, id) AS n FROM fx_margin) q WHERE n BETWEEN 2 AND 9""")
def b12(fx):
    from poolcall.sources import sinks
    m = fx.fx_margin
    back = sinks.write_diagnostics(L.winner_diagnostics(m), L.runner_ups(m))
    return back["winner"].select(F.lit("winner").alias("kind"), "barcode", r("min_margin", 6).alias("value")).unionByName(
        back["runner_up"].select(F.lit("runner_up").alias("kind"), "barcode", r("margin", 6).alias("value")))


CLASSES = """
    SELECT CASE WHEN p.j < 0 THEN ni / 2.0 ELSE (ni + nj) / 4.0 END AS expected,
           sum(llr * (ref_w + alt_w) / 1e6) AS n, sum(llr * alt_w / 1e6) AS k
    FROM fx_pair_counts p JOIN fx_calls c ON c.barcode = p.barcode AND p.i = c.i AND p.j = CASE WHEN c.i = c.j THEN -1 ELSE c.j END
    GROUP BY 1"""


def grid_sql(sigma: float = 0.1) -> str:
    ll = (f"sum(k * ln(expected - expected * a + (1 - expected) * r) + (n - k) * ln(1 - (expected - expected * a + (1 - expected) * r)))"
          f" - (pow(r - {L.E_REF}, 2) + pow(a - {L.E_ALT}, 2)) / (2 * {sigma * sigma})")
    sql = f"WITH cls AS ({CLASSES}), g0 AS (SELECT x.i * 0.01 AS r, y.i * 0.01 AS a FROM range(1, 50) x(i), range(1, 50) y(i)),\n"
    for lv in range(3):
        sql += f"b{lv} AS (SELECT r, a FROM (SELECT r, a, {ll} AS ll FROM g{lv}, cls GROUP BY r, a) q ORDER BY ll DESC LIMIT 1),\n"
        if lv < 2:
            span, step = E.LEVELS[lv + 1]
            k = round(span / step)
            sql += (f"g{lv + 1} AS (SELECT b.r + x.i * {step!r} AS r, b.a + y.i * {step!r} AS a FROM b{lv} b, "
                    f"range({-k}, {k + 1}) x(i), range({-k}, {k + 1}) y(i) WHERE b.r + x.i * {step!r} > 0 AND b.a + y.i * {step!r} > 0),\n")
    return sql.rstrip(",\n") + f"\nSELECT {rq('r', 6)} AS e_ref, {rq('a', 6)} AS e_alt FROM b2"


@register("i6_error_rates", grid_sql())
def i6(fx):
    cls = E.expected_classes(fx.fx_pair_counts, fx.fx_calls)
    er, ea = E.fit_error_rates(cls, L.E_REF, L.E_ALT, 0.1)
    return fx.spark.range(1).select(r(F.lit(er), 6).alias("e_ref"), r(F.lit(ea), 6).alias("e_alt"))


@register("i6_reassign")
def i6b(fx):
    from poolcall.session import cut
    pc = cut(fx.fx_pair_counts)  # used by both passes
    er, ea = E.fit_error_rates(E.expected_classes(pc, L.call_cells(pc)), L.E_REF, L.E_ALT, 0.1)
    return L.name_identities(L.call_cells(pc, er, ea), fx.fx_samples)


# --- identities and checks --------------------------------------------------------------------------

@register("g1_allowed_identities", """
    WITH l AS (SELECT DISTINCT i, j FROM fx_truth WHERE i <> j OR i = 4), m AS (SELECT i AS m FROM l UNION SELECT j FROM l)
    SELECT i, j FROM l UNION SELECT m, m FROM m UNION SELECT a.m, b.m FROM m a JOIN m b ON a.m < b.m""")
def g1(fx):
    return Q.allowed_identities(fx.fx_truth.filter("i <> j OR i = 4").select("i", "j").distinct(), all_pairs=True)


@register("g2_final_identities", """
    WITH l AS (SELECT DISTINCT i, j FROM fx_truth WHERE i <> j OR i = 4), m AS (SELECT i AS m FROM l UNION SELECT j FROM l),
    a AS (SELECT i, j FROM l UNION SELECT m, m FROM m), added AS (SELECT * FROM a EXCEPT SELECT * FROM l)
    SELECT i, j FROM a EXCEPT SELECT i, j FROM added""")
def g2(fx):
    listed = fx.fx_truth.filter("i <> j OR i = 4").select("i", "j").distinct()
    closed = Q.allowed_identities(listed)
    return closed.exceptAll(closed.exceptAll(listed))


RANKS = """
    SELECT id, llr, rank() OVER (ORDER BY llr) + (count(*) OVER (PARTITION BY llr) - 1) / 2.0 AS mr,
           count(*) OVER (PARTITION BY llr) AS t, count(*) OVER () AS n FROM fx_labels_b"""
MW = f"""
    SELECT id, count(*) AS n1, max(n) - count(*) AS n2, sum(mr) - count(*) * (count(*) + 1) / 2.0 AS u,
           sqrt(count(*) * (max(n) - count(*)) * (max(n) + 1) / 12.0
              - count(*) * (max(n) - count(*)) * (SELECT CAST(sum(t * t - 1) AS DOUBLE) FROM rk) / (12.0 * max(n) * (max(n) - 1))) AS sigma
    FROM rk GROUP BY id"""


@register("f14_mann_whitney", f"""
    WITH rk AS ({RANKS}), mw AS ({MW})
    SELECT id, n1, n2, {rq('u', 2)} AS u, {rq('n1 * n2 / 2.0', 2)} AS mean_u, {rq('sigma')} AS sigma_u FROM mw""")
def f14(fx):
    return Q.rank_sums(fx.fx_labels_b).select("id", "n1", "n2", r("u", 2).alias("u"), r("mean_u", 2).alias("mean_u"),
                                              r("sigma_u").alias("sigma_u"))


@register("i31_identity_qc", f"""
    WITH rk AS ({RANKS}), mw AS ({MW})
    SELECT id, n1, {rq('(sum(n1) OVER () - n1) / (count(*) OVER () - 1)')} AS other_mean, {rq('u', 2)} AS u, {rq('sigma')} AS sigma_u FROM mw""")
def i31(fx):
    q = Q.identity_qc(fx.fx_labels_b)
    return q.select("id", "n1", r("other_mean").alias("other_mean"), r("u", 2).alias("u"), r("sigma_u").alias("sigma_u"))


@register("i31_identity_qc_p")
def i31p(fx):
    return Q.identity_qc(fx.fx_labels_b).select("id", r("p_cells", 6).alias("p_cells"), r("p_llr", 6).alias("p_llr"))


@register("i30_doublet_chisq", f"""
    WITH c AS (SELECT i, j, count(*) AS c FROM fx_truth GROUP BY i, j),
    s AS (SELECT i, c / sum(c) OVER () AS f FROM c WHERE i = j),
    p AS (SELECT a.i AS i, b.i AS j, a.f * b.f AS w FROM s a JOIN s b ON a.i < b.i),
    e AS (SELECT coalesce(c.c, 0) AS o, (SELECT sum(c) FROM c WHERE i <> j) * w / sum(w) OVER () AS e
          FROM p LEFT JOIN c ON c.i = p.i AND c.j = p.j)
    SELECT {rq('sum((o - e) * (o - e) / e)')} AS chisq, count(*) - 1 AS df FROM e""")
def i30(fx):
    return Q.doublet_chisq(fx.fx_truth).select(r("chisq").alias("chisq"), "df")


LISTED = "SELECT DISTINCT i, j FROM fx_truth WHERE i < j"


@register("i32_implausible_singlets", f"""
    WITH l AS ({LISTED}), lab AS (SELECT barcode, i, j, CAST(1 + (barcode * 37) % 23 AS DOUBLE) AS llr FROM fx_truth),
    added AS (SELECT i AS m FROM l UNION SELECT j FROM l), par AS (SELECT m, l.i, l.j FROM added JOIN l ON m = l.i OR m = l.j),
    rows_ AS (SELECT m, par.i AS pi, par.j AS pj, lab.llr, lab.i = lab.j AS own FROM par JOIN lab
              ON (lab.i = m AND lab.j = m) OR (lab.i = par.i AND lab.j = par.j)),
    rk AS (SELECT *, rank() OVER (PARTITION BY m, pi, pj ORDER BY llr) + (count(*) OVER (PARTITION BY m, pi, pj, llr) - 1) / 2.0 AS mr FROM rows_)
    SELECT CAST(m AS VARCHAR) AS id, concat(CAST(pi AS VARCHAR), '+', CAST(pj AS VARCHAR)) AS parent,
           count(*) FILTER (WHERE own) AS n1, count(*) FILTER (WHERE NOT own) AS n2,
           {rq('sum(mr) FILTER (WHERE own) - count(*) FILTER (WHERE own) * (count(*) FILTER (WHERE own) + 1) / 2.0', 2)} AS u
    FROM rk GROUP BY m, pi, pj""")
def i32(fx):
    calls = fx.fx_truth.withColumn("llr", (1 + (F.col("barcode") * 37) % 23).cast("double"))
    listed = fx.fx_truth.filter("i < j").select("i", "j").distinct()
    par = Q.singlet_parents(listed)
    return Q.pair_rank_sums(Q.coded(calls), par).select("id", "parent", "n1", "n2", r("u", 2).alias("u"))


@register("i32_refilter_and_reassign")
def i32b(fx):
    listed = fx.fx_truth.filter("i < j").select("i", "j").distinct()
    return Q.refilter(fx.fx_llr_table, listed)
