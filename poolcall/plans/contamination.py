"""Contamination: start values, profile, rates, reclassification, expression clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import contam as A, likelihood as L
from poolcall.plans.fixtures import VIEWS, acgt, add_view
from poolcall.plans.genotype_calls import DECODE, adj, fold_sql, llr2, llr_sql
from poolcall.plans.registry import r, register, rq
from poolcall.session import collect_bounded, cut, local_table

# planted calls with a confidence, so that every cell has one
add_view("fx_conf", "SELECT barcode, i, j, CAST(5 + (barcode * 37) % 23 AS DOUBLE) AS llr FROM fx_truth")
PE = f"CASE WHEN j < 0 THEN {adj('ni / 2.0')} ELSE {adj('(ni + nj) / 4.0')} END"
add_view("fx_ev", f"""
    SELECT p.barcode, c.llr, p.i, p.ni, p.j, p.nj, (ref_w + alt_w) / 1e6 AS n, alt_w / 1e6 AS k, {PE.replace('CASE WHEN j', 'CASE WHEN p.j')} AS pe
    FROM fx_pair_counts p JOIN fx_conf c ON c.barcode = p.barcode AND p.i = c.i AND p.j = CASE WHEN c.i = c.j THEN -1 ELSE c.j END WHERE ref_w + alt_w > 0""",
         lambda fx: A.evidence(fx.fx_pair_counts, fx.fx_conf))
add_view("fx_minc", """
    SELECT s AS sample, sum(CASE WHEN j < 0 THEN w ELSE w / 2 END * m) / sum(CASE WHEN j < 0 THEN w ELSE w / 2 END) AS minc FROM (
      SELECT i, j, w, CASE WHEN inf > pe THEN (inf - pe) / (1 - pe) ELSE (inf - pe) / -pe END AS m FROM (
        SELECT i, ni, j, nj, pe, sum(k / n * llr) / sum(llr) AS inf, sum(llr) AS w FROM fx_ev GROUP BY i, ni, j, nj, pe) a) b,
    LATERAL (SELECT unnest(CASE WHEN j < 0 THEN [i] ELSE [i, j] END) AS s) z GROUP BY s""", lambda fx: A.start_values(fx.fx_ev)[0])
add_view("fx_prof0", "SELECT sample, v / sum(v) OVER () AS share FROM (SELECT sample, greatest(1 - minc / (sum(minc) OVER () / (count(*) OVER () - 1)), 0.01) AS v FROM fx_minc) q",
         lambda fx: A.start_profile(fx.fx_minc))
add_view("fx_amb", "SELECT c.i, c.ni, sum(frac * share) AS amb FROM fx_cond c JOIN fx_prof0 p ON p.sample = c.j GROUP BY c.i, c.ni",
         lambda fx: A.class_ambient(fx.fx_cond, fx.fx_prof0))
add_view("fx_evc", f"""
    SELECT e.*, {adj('coalesce((a.amb + b.amb) / 2, a.amb)')} AS pc FROM fx_ev e JOIN fx_amb a ON a.i = e.i AND a.ni = e.ni LEFT JOIN fx_amb b ON b.i = e.j AND b.ni = e.nj""",
         lambda fx: A.with_ambient(fx.fx_ev, fx.fx_amb))


@register("i15_start_values", f"SELECT sample, {rq('minc', 6)} AS minc, {rq('share', 6)} AS share FROM fx_minc JOIN fx_prof0 USING (sample)")
def i15(fx):
    return fx.fx_minc.join(fx.fx_prof0, "sample").select("sample", r("minc", 6).alias("minc"), r("share", 6).alias("share"))


@register("i19_class_ambient", f"SELECT i, ni, {rq('amb', 6)} AS amb FROM fx_amb")
def i19(fx):
    return fx.fx_amb.select("i", "ni", r("amb", 6).alias("amb"))


def _cell_ll(prior: str = "") -> str:
    p = "((1 - {c}) * pe + {c} * pc)"
    return f"round(sum(k * ln({p}) + (n - k) * ln(1 - {p})){prior}, 9)"


def _rates_sql(src: str, prior: str = "", tag: str = "") -> str:
    ll = _cell_ll(prior)
    return f"""
    g0{tag} AS MATERIALIZED (SELECT barcode, arg_max(c0, (ll, -c0)) AS c0 FROM (
      SELECT barcode, q / 100.0::DOUBLE AS c0, {ll.format(c='(q / 100.0::DOUBLE)')} AS ll FROM {src}, range(1, 100) z(q) GROUP BY barcode, q) a GROUP BY barcode),
    g1{tag} AS MATERIALIZED (SELECT barcode, arg_max(c, (ll, -c)) AS c FROM (
      SELECT barcode, c, {ll.format(c='c')} AS ll FROM (SELECT s.*, c0 + q / 2000.0::DOUBLE AS c FROM {src} s JOIN g0{tag} USING (barcode), range(-19, 20) z(q)) y GROUP BY barcode, c) a GROUP BY barcode)"""


P = "((1 - c) * pe + c * pc)"
SE = f"sum(-(k / ({P} * {P}) + (n - k) / ((1 - {P}) * (1 - {P}))) * (pc - pe) * (pc - pe))"


@register("i16_cell_rates", f"""
    WITH ev AS MATERIALIZED (SELECT * FROM fx_evc), {_rates_sql('ev')}
    SELECT barcode, {rq('c', 4)} AS c, {rq(f'CASE WHEN {SE} < 0 THEN 1 / sqrt(-{SE}) ELSE 0 END', 5)} AS se FROM ev JOIN g1 USING (barcode) GROUP BY barcode, c""")
def i16(fx):
    return A.cell_rates(fx.fx_evc).select("barcode", r("c", 4).alias("c"), r("se", 5).alias("se"))


def _global_sql() -> str:
    sql = "WITH cl AS MATERIALIZED (SELECT pe, pc, sum(n) AS n, sum(k) AS k FROM fx_evc GROUP BY pe, pc), b0 AS (SELECT 0.5::DOUBLE AS c)"
    for lv, (span, step) in enumerate(((0.49, 0.01), (0.01, 0.0005), (0.0005, 0.00002))):
        k = round(span / step)
        ll = "round(sum(k * ln((1 - c) * pe + c * pc) + (n - k) * ln(1 - ((1 - c) * pe + c * pc))), 9)"
        sql += f""", b{lv + 1} AS MATERIALIZED (SELECT arg_max(c, (ll, -c)) AS c FROM (SELECT c, {ll} AS ll FROM (
            SELECT b.c + q * {step}::DOUBLE AS c FROM b{lv} b, range({-k}, {k + 1}) z(q)) g, cl WHERE c > 0 AND c < 1 GROUP BY c) y)"""
    return sql + f" SELECT {rq('c', 5)} AS c FROM b3"


@register("i16_global_rate", _global_sql())
def i16g(fx):
    return fx.spark.range(1).select(r(F.lit(A.global_rate(fx.fx_evc)), 5).alias("c"))


@register("i17_shrunk_rates", f"""
    WITH ev AS MATERIALIZED (SELECT * FROM fx_evc), {_rates_sql('ev')},
    m AS MATERIALIZED (SELECT sum(w * c) / sum(w) AS m, greatest(sum(w * c * c) / sum(w) - pow(sum(w * c) / sum(w), 2), 1e-6) AS v FROM (
      SELECT c, llr / sum(llr) OVER (PARTITION BY i, j) AS w FROM g1 JOIN fx_conf USING (barcode)) q),
    f AS MATERIALIZED (SELECT m * greatest(m * (1 - m) / v - 1, 1e-3) AS a, (1 - m) * greatest(m * (1 - m) / v - 1, 1e-3) AS b FROM m),
    ev2 AS (SELECT ev.*, a, b FROM ev, f), {_rates_sql('ev2', ' + (max(a) - 1) * ln({c}) + (max(b) - 1) * ln(1 - {c})', 's')}
    SELECT barcode, {rq('c', 4)} AS c FROM g1s""")
def i17(fx):
    return A.shrunk_rates(cut(fx.fx_evc), fx.fx_conf).select("barcode", r("c", 4).alias("c"))


FIXED_C, SQL_TOL = 0.05, 1e-11


def share_sql(rows: str, c: float, tol: float) -> str:
    """Passes as a recursion over ``rows`` (b, id, n, k, pe, m, f) and ``start`` (b, m, share), their factors raised to
    1 / c, until no share moves by ``tol``; the settled shares are ``settled`` (b, m, share)."""
    return f"""WITH RECURSIVE rw AS MATERIALIZED ({rows}),
    it AS (SELECT 0 AS k, b, m, share, 1.0::DOUBLE AS moved FROM start
      UNION ALL SELECT k + 1, b, m, share, max(abs(share - before)) OVER (PARTITION BY b) FROM (SELECT k, b, m, v / sum(v) OVER (PARTITION BY b) AS share, before FROM (
        SELECT k, b, m, before, before * pow(g / sum(before * g) OVER (PARTITION BY b), {1 / c}) AS v FROM (SELECT k, b, m, before, sum(alt / p + ref / (1 - p)) AS g FROM (
          SELECT it.k, rw.b, rw.m, it.share AS before, rw.k * f AS alt, (rw.n - rw.k) * (1 - f) AS ref,
            least(greatest({1 - c} * pe + {c} * sum(f * it.share) OVER (PARTITION BY rw.b, id), 1e-9), 1 - 1e-9) AS p
          FROM rw JOIN it ON it.m = rw.m AND it.b = rw.b WHERE moved >= {tol} AND it.k < 100000) a GROUP BY k, b, m, before) x) z) y),
    settled AS MATERIALIZED (SELECT b, m, arg_max(share, k) AS share FROM it GROUP BY b, m)"""


CLASS_ROWS = f"""SELECT 0 AS b, dense_rank() OVER (ORDER BY i, ni, j, nj) AS id, n, k, pe, m,
    (f - f * {L.E_ALT} + (1 - f) * {L.E_REF}) AS f FROM (
      SELECT g.*, a.j AS m, coalesce((a.frac + b.frac) / 2, a.frac) AS f FROM (SELECT i, ni, j, nj, pe, sum(n) AS n, sum(k) AS k FROM fx_ev GROUP BY i, ni, j, nj, pe) g
      JOIN fx_cond a ON a.i = g.i AND a.ni = g.ni LEFT JOIN fx_cond b ON b.i = g.j AND b.ni = g.nj AND b.j = a.j) q"""


@register("i18_ambient_profile", share_sql(CLASS_ROWS, FIXED_C, SQL_TOL).replace("FROM start", "FROM (SELECT 0 AS b, sample AS m, share FROM fx_prof0) q") +
          f" SELECT CAST(m AS INT) AS sample, {rq('share', 4)} AS share FROM settled")
def i18(fx):
    prof = {x.sample: x.share for x in collect_bounded(fx.fx_prof0, 4096)}
    members = sorted(prof)
    rows = cut(A.class_rows(fx.fx_ev, fx.fx_cond, members).withColumn("b", F.lit(0)))
    share = A.settle_shares(rows, {0: [prof[m] for m in members]}, FIXED_C)[0]
    return local_table(fx.spark, list(zip(members, share)), "sample INT, share DOUBLE").select("sample", r("share", 4).alias("share"))


# calling again: the comparisons of the genotype calls with expected rates mixed with the ambient one, and a prior per identity
MIX_D = 0.1
def _mixed(p: str) -> str:
    return adj(f"{1 - FIXED_C} * ({p}) + {FIXED_C} * ((a.amb + b.amb) / 2)")


CI, CJ, CK = _mixed("ni / 2.0"), _mixed("nj / 2.0"), _mixed("(ni + nj) / 4.0")
add_view("fx_mixed_llr", f"""
    SELECT barcode, i, j, sum({llr2('pi', 'pj')}) AS l, sum({llr2('pi', 'pk')}) AS si, sum({llr2('pj', 'pk')}) AS sj FROM (
      SELECT c.barcode, c.i, c.j, round(ref_w / 1e6) AS ref, round(alt_w / 1e6) AS alt, {CI.replace('ni /', 'c.ni /')} AS pi, {CJ} AS pj, {CK.replace('(ni +', '(c.ni +')} AS pk
      FROM fx_pair_counts c JOIN fx_amb a ON a.i = c.i AND a.ni = c.ni JOIN fx_amb b ON b.i = c.j AND b.ni = c.nj WHERE c.j >= 0 AND c.ni <> c.nj) q
    GROUP BY barcode, i, j""", lambda fx: A.contaminated_pair_llr(fx.fx_pair_counts, fx.fx_amb, FIXED_C))
for _name in ("fx_idlist", "fx_both"):
    add_view(_name.replace("fx_", "fx_mixed_"), VIEWS[_name].replace("fx_pair_llr", "fx_mixed_llr").replace("fx_idlist", "fx_mixed_idlist"), lambda fx: None)
add_view("fx_identity_prior", f"""
    WITH c AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS n FROM fx_conf GROUP BY i, j), t AS (SELECT sum(n) AS t FROM c),
    s AS (SELECT m, sum(n) / (2 * max(t)) AS share FROM (SELECT i AS m, n FROM c UNION ALL SELECT j, n FROM c) q, t GROUP BY m)
    SELECT id, (lgamma(t + 1) - lgamma(n + 1) - lgamma(t - n + 1) + CASE WHEN n > 0 THEN n * ln(p) ELSE 0 END + (t - n) * ln(1 - p)) / ln(2.0::DOUBLE) AS w FROM (
      SELECT CASE WHEN a.m = b.m THEN a.m ELSE 4096 + a.m * 4096 + b.m END AS id, coalesce(c.n, 0) AS n,
        least(greatest(CASE WHEN a.m = b.m THEN {1 - MIX_D} * a.share + {MIX_D} * a.share * a.share ELSE {2 * MIX_D} * a.share * b.share END, 1e-12), 1 - 1e-12) AS p
      FROM s a JOIN s b ON a.m <= b.m LEFT JOIN c ON c.i = a.m AND c.j = b.m) q, t""", lambda fx: None)
add_view("fx_mixed_comparisons", llr_sql(0.5).replace("fx_both", "fx_mixed_both").replace("fx_idlist", "fx_mixed_idlist").replace(
    "CASE WHEN x.a = x.b AND y.a <> y.b THEN 0.0 ELSE 0 END", "coalesce(px.w, least_.w) - coalesce(py.w, least_.w)")
    + " LEFT JOIN fx_identity_prior px ON px.id = x.id LEFT JOIN fx_identity_prior py ON py.id = y.id, (SELECT min(w) AS w FROM fx_identity_prior) least_", lambda fx: None)
add_view("fx_recalled", fold_sql("fx_mixed_comparisons", 2) + f" SELECT barcode, {DECODE.format(w='win')}, llr FROM done WHERE llr > 0", lambda fx: None)


def _own_ll(calls: str) -> str:
    """Each cell's log likelihood under its own call, by the SQL of the evidence rows."""
    return f"""SELECT barcode, sum(k * ln({1 - FIXED_C} * pe + {FIXED_C} * pc) + (n - k) * ln(1 - ({1 - FIXED_C} * pe + {FIXED_C} * pc))) AS ll FROM (
      SELECT p.barcode, (ref_w + alt_w) / 1e6 AS n, alt_w / 1e6 AS k, {PE.replace('j < 0', 'p.j < 0').replace('ni ', 'p.ni ').replace('nj)', 'p.nj)')} AS pe,
        {adj('coalesce((a.amb + b.amb) / 2, a.amb)')} AS pc
      FROM fx_pair_counts p JOIN {calls} c ON c.barcode = p.barcode AND p.i = c.i AND p.j = CASE WHEN c.i = c.j THEN -1 ELSE c.j END
      JOIN fx_amb a ON a.i = p.i AND a.ni = p.ni LEFT JOIN fx_amb b ON b.i = p.j AND b.ni = p.nj WHERE ref_w + alt_w > 0) q GROUP BY barcode"""


@register("i20_reclassify", f"""
    WITH x AS (SELECT n.barcode, o.barcode IS NULL OR (n.i = o.i AND n.j = o.j) OR coalesce(u.ll > v.ll, FALSE) AS take, n.i, n.j, n.llr, o.i AS oi, o.j AS oj, o.llr AS ollr
      FROM fx_recalled n LEFT JOIN fx_conf o ON o.barcode = n.barcode LEFT JOIN ({_own_ll('fx_recalled')}) u ON u.barcode = n.barcode LEFT JOIN ({_own_ll('fx_conf')}) v ON v.barcode = n.barcode)
    SELECT barcode, CAST(CASE WHEN take THEN i ELSE oi END AS INT) AS i, CAST(CASE WHEN take THEN j ELSE oj END AS INT) AS j, {rq('CASE WHEN take THEN llr ELSE ollr END')} AS llr FROM x""")
def i20(fx):
    return A.reclassify(cut(fx.fx_pair_counts), fx.fx_conf, fx.fx_amb, FIXED_C, MIX_D).select("barcode", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r("llr").alias("llr"))


@register("i21_contamination_loop")
def i21(fx):
    rates, _, _ = A.quantify(fx.fx_pair_counts, fx.fx_cond, fx.fx_conf)
    return rates.select("barcode", r("c").alias("c"), r("se").alias("se"))


add_view("fx_rates", "SELECT barcode, CAST(2 + barcode % 11 AS DOUBLE) / CAST(97 AS DOUBLE) AS c FROM fx_truth")


@register("e30_rates_by_member", f"""
    SELECT sample, {rq('x / w', 6)} AS mean, {rq('sqrt(greatest(q / w - (x / w) * (x / w), 0))', 6)} AS sd FROM (
      SELECT s AS sample, sum(w) AS w, sum(w * c) AS x, sum(w * c * c) AS q FROM (
        SELECT c, CASE WHEN i = j THEN 1.0 ELSE 0.5 END AS w, unnest(CASE WHEN i = j THEN [i] ELSE [i, j] END) AS s FROM fx_rates JOIN fx_truth USING (barcode)) a GROUP BY s) b""")
def e30(fx):
    return A.rates_by_member(fx.fx_rates, fx.fx_truth).select("sample", r("mean", 6).alias("mean"), r("sd", 6).alias("sd"))


@register("b13_contamination_tables", f"""
    SELECT 'rate' AS tbl, CAST(barcode AS VARCHAR) AS key, {rq('c', 6)} AS value FROM fx_rates UNION ALL SELECT 'profile', CAST(sample AS VARCHAR), {rq('share', 6)} FROM fx_prof0""")
def b13(fx):
    from poolcall.session import fresh_path
    from poolcall.sources import sinks
    path = fresh_path(fx.spark, "contam")
    sinks.write_contamination(fx.fx_rates.withColumn("se", F.lit(0.0)), fx.fx_prof0, path)
    a = fx.spark.read.schema("key STRING, value DOUBLE, se DOUBLE").csv(f"{path}/contam_rate", sep="\t")
    b = fx.spark.read.schema("key STRING, value DOUBLE").csv(f"{path}/contam_prof", sep="\t")
    return a.select(F.lit("rate").alias("tbl"), "key", r("value", 6).alias("value")).unionByName(b.select(F.lit("profile").alias("tbl"), "key", r("value", 6).alias("value")))


add_view("fx_expr", "SELECT m.barcode, m.gene, m.cnt, m.barcode % 3 AS cluster, c.c FROM fx_mtx m JOIN fx_rates c ON c.barcode = m.barcode")
EXPR_TOL = 1e-5
EXPR_SQL = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT cluster, gene, c, CAST(sum(cnt) AS DOUBLE) AS cnt FROM fx_expr GROUP BY cluster, gene, c),
    it AS (SELECT 0 AS k, cluster, gene, sum(n) OVER (PARTITION BY gene) / sum(n) OVER () AS a, n / sum(n) OVER (PARTITION BY cluster) AS e, NULL::DOUBLE AS last, FALSE AS ended
        FROM (SELECT cluster, gene, sum(cnt) AS n FROM x GROUP BY cluster, gene) q
      UNION ALL (WITH now AS MATERIALIZED (SELECT * FROM it WHERE NOT ended),
      g AS MATERIALIZED (SELECT cluster, gene, max(k) AS k, max(last) AS last, max(a) AS a, max(e) AS e, sum(cnt * c * a / (c * a + (1 - c) * e)) AS u,
        sum(cnt * (1 - c * a / (c * a + (1 - c) * e))) AS v, sum(cnt * ln(c * a + (1 - c) * e)) AS l FROM x JOIN now USING (cluster, gene) GROUP BY cluster, gene),
      t AS (SELECT sum(l) AS ll, coalesce(abs(sum(l) - max(last)) <= {EXPR_TOL} * abs(max(last)), FALSE) AS stop FROM g HAVING count(*) > 0)
      SELECT k + 1, cluster, gene, CASE WHEN stop THEN a ELSE sum(u) OVER (PARTITION BY gene) / sum(u) OVER () END, CASE WHEN stop THEN e ELSE v / sum(v) OVER (PARTITION BY cluster) END, ll, stop
      FROM g, t))
    SELECT cluster, gene, {rq('a', 8)} AS a, {rq('e', 8)} AS e FROM it WHERE ended"""


@register("i22_expression_profile", EXPR_SQL)
def i22(fx):
    return A.fit_expression(fx.fx_expr, EXPR_TOL).select("cluster", "gene", r("a", 8).alias("a"), r("e", 8).alias("e"))


add_view("fx_clean", """
    WITH a AS (SELECT gene, CAST(sum(cnt) AS DOUBLE) / sum(sum(cnt)) OVER () AS a FROM fx_expr GROUP BY gene),
    d AS (SELECT x.barcode, x.gene, x.cnt, x.c, a.a, round(x.cnt / a.a, 6) AS ratio FROM fx_expr x JOIN a ON a.gene = x.gene),
    w AS (SELECT *, sum(cnt) OVER (PARTITION BY barcode) * c AS rm, sum(a) OVER (PARTITION BY barcode) AS at_all,
                 coalesce(sum(cnt) OVER o, 0) AS c0, coalesce(sum(a) OVER o, 0) AS a0 FROM d
          WINDOW o AS (PARTITION BY barcode ORDER BY ratio, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, (rm - c0) / greatest(at_all - a0, 1e-300) AS lam0 FROM w),
    m AS (SELECT *, (min(CASE WHEN round(lam0, 6) <= ratio THEN {'r': ratio, 'g': gene, 'l': lam0} END) OVER (PARTITION BY barcode)).l AS lam FROM l)
    SELECT barcode, gene, cnt, CASE WHEN lam IS NULL THEN 0.0 ELSE greatest(cnt - lam * a, 0.0) END AS remaining FROM m""",
         lambda fx: A.remove_ambient(fx.fx_expr, _ambient(fx)))


def _ambient(fx):
    g = fx.fx_expr.groupBy("gene").agg(F.sum("cnt").alias("n"))
    t = g.agg(F.sum("n").alias("t"))  # one row
    return g.join(F.broadcast(t)).select("gene", (F.col("n") / F.col("t")).alias("a"))


@register("i23_remove_ambient", f"""SELECT barcode, gene, cnt, {rq('remaining', 6)} AS remaining FROM fx_clean""")
def i23(fx):
    return fx.fx_clean.select("barcode", "gene", "cnt", r("remaining", 6).alias("remaining"))


add_view("fx_skip", "SELECT DISTINCT gene FROM fx_expr WHERE gene % 10 = 3", lambda fx: fx.fx_expr.filter("gene % 10 = 3").select("gene").distinct())


@register("i23_remove_ambient_but_skipped", f"""
    WITH a AS (SELECT gene, CAST(sum(cnt) AS DOUBLE) / sum(sum(cnt)) OVER () AS a FROM fx_expr GROUP BY gene),
    t AS (SELECT *, sum(cnt) OVER (PARTITION BY barcode) * c AS rm FROM fx_expr),
    d AS (SELECT t.barcode, t.gene, t.cnt, t.rm, a.a, round(t.cnt / a.a, 6) AS ratio FROM t JOIN a ON a.gene = t.gene WHERE t.gene NOT IN (SELECT gene FROM fx_skip)),
    w AS (SELECT *, sum(a) OVER (PARTITION BY barcode) AS at_all, coalesce(sum(cnt) OVER o, 0) AS c0, coalesce(sum(a) OVER o, 0) AS a0 FROM d
          WINDOW o AS (PARTITION BY barcode ORDER BY ratio, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, (rm - c0) / greatest(at_all - a0, 1e-300) AS lam0 FROM w),
    m AS (SELECT *, (min(CASE WHEN round(lam0, 6) <= ratio THEN {{'r': ratio, 'g': gene, 'l': lam0}} END) OVER (PARTITION BY barcode)).l AS lam FROM l)
    SELECT barcode, gene, cnt, {rq('CASE WHEN lam IS NULL THEN 0.0 ELSE greatest(cnt - lam * a, 0.0) END', 6)} AS remaining FROM m
    UNION ALL SELECT barcode, gene, cnt, {rq('cnt', 6)} FROM fx_expr WHERE gene IN (SELECT gene FROM fx_skip)""")
def i23_skip(fx):
    return A.remove_ambient(fx.fx_expr, _ambient(fx), fx.fx_skip).select("barcode", "gene", "cnt", r("remaining", 6).alias("remaining"))


@register("h15_rounded_counts", """
    SELECT * FROM (SELECT barcode, gene, CAST(floor(x) + CASE WHEN CAST(concat('0x', substr(md5(concat(CAST(barcode AS VARCHAR), '|', CAST(gene AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < x - floor(x)
        THEN 1 ELSE 0 END AS BIGINT) AS cnt FROM (SELECT *, round(remaining, 6) AS x FROM fx_clean) q) z WHERE cnt > 0""")
def h15(fx):
    return A.whole_counts(fx.fx_clean)
