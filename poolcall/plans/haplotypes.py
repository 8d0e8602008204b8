"""Haploid sites and haplotypes, homologous groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import homology as H, mito as M
from poolcall.plans.fixtures import VIEWS, add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import cut, fresh_path
from poolcall.sources import readers, sinks

SITES = 60
CARRY = "(({s} * 7 + {h} * 13 + {s} * {h}) % 5 < 2)"
# a cell's haplotype is its number modulo 5; every ninth cell mixes two; one read in a hundred misreads, a few show a third base
add_view("fx_mt_bases", f"""
    SELECT fragment, barcode, pos, qual, CASE WHEN third THEN 'T' WHEN (CASE WHEN wrong THEN NOT carry ELSE carry END) THEN 'C' ELSE 'A' END AS base FROM (
      SELECT l_orderkey AS fragment, l_suppkey AS barcode, l_partkey % {SITES} AS pos, l_linenumber AS qual,
             (l_orderkey * 61 + l_linenumber * 17) % 1000 < 10 AS wrong, (l_orderkey * 31 + l_linenumber * 7) % 700 = 3 AS third,
             {CARRY.format(s=f'(l_partkey % {SITES})', h='(CASE WHEN l_suppkey % 9 = 0 AND l_orderkey % 2 = 0 THEN (l_suppkey + 1) % 5 ELSE l_suppkey % 5 END)')} AS carry
      FROM lineitem) q""", lambda fx: fx.spread_sql(VIEWS["fx_mt_bases"], "lineitem", "l_orderkey", "l_linenumber"))
add_view("fx_spectrum", """
    SELECT pos, arg_max(base, (n, base)) FILTER (WHERE rk = 1) AS major, arg_max(base, (n, base)) FILTER (WHERE rk = 2) AS minor,
           max(n) FILTER (WHERE rk = 1) / sum(n) AS freq1, max(n) FILTER (WHERE rk = 2) / sum(n) AS freq2, CAST(sum(n) AS BIGINT) AS cov FROM (
      SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS rk FROM (
        SELECT pos, b.base AS base, count(*) AS n FROM (
          SELECT pos, fragment, max({'qual': qual, 'base': base}) AS b FROM fx_mt_bases GROUP BY pos, fragment) a GROUP BY pos, b.base) z) y
    GROUP BY pos HAVING count(*) >= 2""", lambda fx: M.allele_spectrum(fx.fx_mt_bases))
add_view("fx_mt_counts", """
    SELECT barcode, b.pos, CAST(count(*) FILTER (WHERE base = major) AS BIGINT) AS maj, CAST(count(*) FILTER (WHERE base = minor) AS BIGINT) AS "min"
    FROM fx_mt_bases b JOIN fx_spectrum s ON s.pos = b.pos GROUP BY barcode, b.pos HAVING count(*) FILTER (WHERE base = major OR base = minor) > 0""",
         lambda fx: M.allele_counts(fx.fx_mt_bases, fx.fx_spectrum))


def ll(p: str) -> str:
    return f'round("min" * ln({p}) + maj * ln(1 - {p}), 9)'


Z, ONE = "0.001::DOUBLE", "0.999::DOUBLE"
add_view("fx_haps", f"""
    SELECT barcode, pos, allele FROM (SELECT barcode, pos, CASE WHEN {ll(Z)} > {ll(ONE)} AND {ll(Z)} > {ll('0.5::DOUBLE')} THEN 0
        WHEN {ll(ONE)} > {ll(Z)} AND {ll(ONE)} > {ll('0.5::DOUBLE')} THEN 1 END AS allele FROM fx_mt_counts) q WHERE allele IS NOT NULL""",
         lambda fx: M.cell_haplotypes(fx.fx_mt_counts))


def vote(n, k):
    def v(p):
        return f"round({k} * ln({p}) + ({n} - {k}) * ln(1 - {p}), 9)"
    return f"({v(ONE)} > {v('0.5::DOUBLE')} AND {v(ONE)} > {v(Z)})"


add_view("fx_alike", f"""
    SELECT oa.rank AS ra, ob.rank AS rb FROM (
      SELECT p.pos AS a, q.pos AS b, count(*) FILTER (WHERE p.allele = 1) AS seen, count(*) FILTER (WHERE q.allele = 1) AS seen_b,
             count(*) FILTER (WHERE p.allele = 1 AND q.allele = 1) AS both_n
      FROM fx_haps p JOIN fx_haps q ON p.barcode = q.barcode AND p.pos <> q.pos GROUP BY 1, 2) x
    JOIN fx_site_order oa ON oa.pos = x.a JOIN fx_site_order ob ON ob.pos = x.b
    WHERE both_n > 0 AND {vote('seen', 'both_n')} AND {vote('seen_b', 'both_n')} AND oa.rank < ob.rank""")
add_view("fx_site_order", "SELECT pos, CAST(row_number() OVER (ORDER BY sum(allele) DESC, pos) AS INT) AS rank FROM fx_haps GROUP BY pos HAVING sum(allele) > 0")
# the walk by rank: a site joins the first standing site that is alike, or stands itself
add_view("fx_groups", """
    WITH RECURSIVE e AS (SELECT o.pos, o.rank, coalesce(x.lo, []::INT[]) AS lo FROM fx_site_order o LEFT JOIN (SELECT rb, list(ra) AS lo FROM fx_alike GROUP BY rb) x ON x.rb = o.rank),
    w AS (SELECT 0 AS n, []::INT[] AS standing, NULL::INT AS into_
      UNION ALL SELECT e.rank, CASE WHEN len(list_intersect(lo, standing)) > 0 THEN standing ELSE standing || [e.rank] END, coalesce(list_min(list_intersect(lo, standing)), e.rank)
      FROM w JOIN e ON e.rank = w.n + 1)
    SELECT o.pos, g.pos AS grp, w.into_ AS rank FROM w JOIN fx_site_order o ON o.rank = w.n JOIN fx_site_order g ON g.rank = w.into_""",
         lambda fx: M.site_groups(fx.fx_haps))
add_view("fx_group_calls", "SELECT h.barcode, g.grp, g.rank, arg_min(allele, h.pos) AS allele FROM fx_haps h JOIN fx_groups g ON g.pos = h.pos GROUP BY 1, 2, 3",
         lambda fx: M.group_alleles(fx.fx_haps, fx.fx_groups))
add_view("fx_ordered", "SELECT *, CAST(dense_rank() OVER (ORDER BY rank) AS INT) AS ord FROM fx_groups", lambda fx: M.ordered_groups(fx.fx_groups))


@register("e10_allele_spectrum", f"SELECT pos, major, minor, {rq('freq1', 6)} AS freq1, {rq('freq2', 6)} AS freq2, cov FROM fx_spectrum")
def e10(fx):
    return fx.fx_spectrum.select("pos", "major", "minor", r("freq1", 6).alias("freq1"), r("freq2", 6).alias("freq2"), "cov")


@register("f1_top_minor_sites", f"SELECT pos, {rq('freq2', 6)} AS freq2 FROM fx_spectrum WHERE cov >= 20 ORDER BY fx_spectrum.freq2 DESC, pos LIMIT 20")
def f1(fx):
    return M.top_sites(fx.fx_spectrum, 20, 20).select("pos", r("freq2", 6).alias("freq2"))


@register("i37_cell_haplotypes", "SELECT barcode, pos, allele FROM fx_haps")
def i37(fx):
    return fx.fx_haps.select("barcode", "pos", "allele")


@register("i38_clean_sites", f"""
    SELECT pos FROM fx_mt_counts WHERE {ll(ONE)} > {ll(Z)} GROUP BY pos HAVING round(sum({ll(ONE)} - {ll('0.5::DOUBLE')}), 6) > 0""")
def i38(fx):
    return M.clean_sites(fx.fx_mt_counts)


@register("g5_site_groups", "SELECT pos, grp, rank FROM fx_groups")
def g5(fx):
    return fx.fx_groups.select("pos", "grp", "rank")


@register("g6_group_carriers", "SELECT barcode, grp, allele FROM fx_group_calls")
def g6(fx):
    return fx.fx_group_calls.select("barcode", "grp", "allele")


SIZES = """
    SELECT len, prefix, count(*) AS size FROM (
      SELECT barcode, unnest(range(1, len(a) + 1)) AS len, substr(array_to_string(a, ''), 1, unnest(range(1, len(a) + 1))) AS prefix FROM (
        SELECT barcode, list(allele ORDER BY ord) FILTER (WHERE ord = k) AS a FROM (
          SELECT c.barcode, o.ord, c.allele, row_number() OVER (PARTITION BY c.barcode ORDER BY o.ord) AS k
          FROM fx_group_calls c JOIN (SELECT DISTINCT grp, ord FROM fx_ordered) o ON o.grp = c.grp) q GROUP BY barcode) z WHERE len(a) > 0) y GROUP BY len, prefix"""
add_view("fx_prefixes", SIZES.replace("SELECT barcode, unnest(range(1, len(a) + 1)) AS len, substr(array_to_string(a, ''), 1, unnest(range(1, len(a) + 1))) AS prefix FROM (",
                                      "SELECT barcode, CAST(n AS INT) AS len, substr(array_to_string(a, ''), 1, n) AS prefix FROM (SELECT *, unnest(range(1, len(a) + 1)) AS n FROM (").replace(
                                          "GROUP BY barcode) z WHERE len(a) > 0)", "GROUP BY barcode) z WHERE len(a) > 0) zz)"),
         lambda fx: M.prefix_sizes(_ordered_calls(fx), []))


def _ordered_calls(fx):
    return fx.fx_group_calls.join(fx.fx_ordered.select("grp", "ord").distinct(), "grp")


@register("f9_cluster_count", """
    SELECT len, CAST(min(n) AS INT) AS clusters FROM (
      SELECT *, lead(ll) OVER (PARTITION BY len ORDER BY n) AS nxt FROM (
        SELECT len, n, round(c * ln(c / n) - c + CASE WHEN t - c > 0 THEN (t - c) * ln((t - c) / (m - n)) - (t - c) ELSE 0 END, 6) AS ll FROM (
          SELECT len, row_number() OVER w AS n, CAST(sum(size) OVER w AS DOUBLE) AS c, count(*) OVER (PARTITION BY len) AS m, CAST(sum(size) OVER (PARTITION BY len) AS DOUBLE) AS t
          FROM fx_prefixes WINDOW w AS (PARTITION BY len ORDER BY size DESC, prefix ROWS UNBOUNDED PRECEDING)) a) b) c WHERE nxt IS NULL OR nxt < ll GROUP BY len""")
def f9(fx):
    return M.cluster_count(fx.fx_prefixes, ["len"])


@register("i39_prefix_sizes", "SELECT len, prefix, size FROM fx_prefixes")
def i39(fx):
    return fx.fx_prefixes.select("len", "prefix", "size")


@register("i39_discover_haplotypes")
def i39b(fx):
    return M.discover(_ordered_calls(fx))


@register("i40_assign_haplotypes")
def i40(fx):
    _, calls = M.discover_and_assign(fx.fx_mt_counts)
    return calls.select("barcode", "i", "j", r("llr").alias("llr"))


@register("i41_sub_clusters")
def i41(fx):
    parents = fx.fx_truth.select("barcode", (F.col("barcode") % 2).alias("parent"))
    return M.sub_clusters(cut(fx.fx_haps), cut(fx.fx_ordered), parents)


add_view("fx_hapdef", f"SELECT CAST(h AS INT) AS hap, pos, CASE WHEN (CASE WHEN {CARRY.format(s='pos', h='h')} THEN 'C' ELSE 'A' END) = major THEN 0 ELSE 1 END AS allele FROM fx_spectrum, range(0, 5) z(h)",
         lambda fx: fx.fx_spectrum.select("pos", "major", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("hap")).selectExpr(
             "hap", "pos", f"CASE WHEN (CASE WHEN {CARRY.format(s='pos', h='hap')} THEN 'C' ELSE 'A' END) = major THEN 0 ELSE 1 END AS allele"))


@register("e31_mixing_evidence", """
    SELECT c.barcode, t.i, t.j, CAST(sum(CASE WHEN a.allele = 1 THEN "min" ELSE maj END) AS BIGINT) AS match1, CAST(sum(CASE WHEN a.allele = 1 THEN maj ELSE "min" END) AS BIGINT) AS match2
    FROM fx_mt_counts c JOIN fx_truth t ON t.barcode = c.barcode AND t.i < t.j JOIN fx_hapdef a ON a.hap = t.i AND a.pos = c.pos
    JOIN fx_hapdef b ON b.hap = t.j AND b.pos = c.pos AND a.allele <> b.allele GROUP BY 1, 2, 3""")
def e31(fx):
    return M.mixing_evidence(fx.fx_mt_counts, fx.fx_hapdef, fx.fx_truth)


CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
add_view("fx_consensus", f"""
    SELECT cluster, pos, tot, cells, CASE WHEN miss > alt AND miss > ref THEN NULL WHEN alt > ref AND alt > miss THEN 1 ELSE 0 END AS allele FROM (
      SELECT *, round({CHOOSE.format(n='tot', k='s')} + s * ln(0.99) + (tot - s) * ln(0.01), 6) AS alt, round({CHOOSE.format(n='tot', k='s')} + s * ln(0.01) + (tot - s) * ln(0.99), 6) AS ref,
             round({CHOOSE.format(n='cells', k='tot')} + tot * ln(0.01) + (cells - tot) * ln(0.99), 6) AS miss FROM (
        SELECT h.cluster, pos, s, tot, cells FROM (SELECT barcode % 5 AS cluster, pos, CAST(sum(allele) AS BIGINT) AS s, count(*) AS tot FROM fx_haps GROUP BY 1, 2) h
        JOIN (SELECT s_suppkey % 5 AS cluster, count(*) AS cells FROM supplier GROUP BY 1) c ON c.cluster = h.cluster) q) z""",
         lambda fx: M.consensus(fx.fx_haps, fx.supplier.select(F.col("s_suppkey").alias("barcode"), (F.col("s_suppkey") % 5).alias("cluster"))))


@register("e24_consensus", "SELECT cluster, pos, tot, cells, allele FROM fx_consensus")
def e24(fx):
    return fx.fx_consensus


@register("c13_well_called_sites", "SELECT pos FROM fx_consensus GROUP BY pos HAVING min(tot / cells) >= 0.9")
def c13(fx):
    return M.well_called_sites(fx.fx_consensus, 0.9)


@register("c14_well_called_cells", f"""
    WITH ok AS (SELECT barcode FROM fx_haps GROUP BY barcode HAVING ({SITES} - count(*)) / {SITES}.0 < 0.1), h AS (SELECT * FROM fx_haps WHERE barcode IN (SELECT barcode FROM ok))
    SELECT barcode, pos, allele FROM h WHERE pos IN (SELECT pos FROM h GROUP BY pos HAVING sum(allele) > (SELECT count(*) / 1000 FROM ok))""")
def c14(fx):
    return M.well_called_cells(fx.fx_haps, SITES, 0.1).select("barcode", "pos", "allele")


@register("c15_variable_sites", "SELECT cluster, pos, allele FROM fx_consensus WHERE pos IN (SELECT pos FROM fx_consensus GROUP BY pos HAVING sum(allele) > 0)")
def c15(fx):
    return M.variable_sites(fx.fx_consensus).select("cluster", "pos", "allele")


# root clusters 0 and 1 are split in two by the cell's number, a cell in eleven mixes both leaves
add_view("fx_tree", """
    SELECT barcode, CAST(i AS VARCHAR) AS cluster FROM fx_truth WHERE i = j AND i > 1
    UNION ALL SELECT barcode, concat(CAST(i AS VARCHAR), '_', CAST(CAST(floor(barcode / 8) AS BIGINT) % 2 AS VARCHAR)) FROM fx_truth WHERE i = j AND i <= 1 AND barcode % 11 <> 0""",
         lambda fx: M.merge_tree(fx.fx_truth, fx.fx_truth.filter("i = j AND i <= 1").selectExpr(
             "barcode", "i AS parent", "CAST(floor(barcode / 8) AS BIGINT) % 2 AS i", "CAST(floor(barcode / 8) AS BIGINT) % 2 + CASE WHEN barcode % 11 = 0 THEN 1 ELSE 0 END AS j")))


@register("i41_merged_tree", "SELECT barcode, cluster FROM fx_tree")
def i41_tree(fx):
    return fx.fx_tree


@register("i41_merged_haplotypes", f"""
    WITH c AS (SELECT cluster, pos, tot, cells, CASE WHEN miss > alt AND miss > ref THEN NULL WHEN alt > ref AND alt > miss THEN 1 ELSE 0 END AS allele FROM (
      SELECT *, round({CHOOSE.format(n='tot', k='s')} + s * ln(0.99) + (tot - s) * ln(0.01), 6) AS alt, round({CHOOSE.format(n='tot', k='s')} + s * ln(0.01) + (tot - s) * ln(0.99), 6) AS ref,
             round({CHOOSE.format(n='cells', k='tot')} + tot * ln(0.01) + (cells - tot) * ln(0.99), 6) AS miss FROM (
        SELECT cluster, pos, s, tot, cells FROM (SELECT cluster, pos, CAST(sum(allele) AS BIGINT) AS s, count(*) AS tot FROM fx_haps JOIN fx_tree USING (barcode) GROUP BY 1, 2) h
        JOIN (SELECT cluster, count(*) AS cells FROM fx_tree GROUP BY 1) n USING (cluster)) q) z),
    k AS (SELECT * FROM c WHERE pos IN (SELECT pos FROM c GROUP BY pos HAVING min(tot / cells) >= 0.5))
    SELECT cluster, pos, allele FROM k WHERE pos IN (SELECT pos FROM k GROUP BY pos HAVING sum(allele) > 0)""")
def i41_haplotypes(fx):
    return M.merged_haplotypes(fx.fx_haps, fx.fx_tree)


@register("i41_merged_assignments")
def i41_assignments(fx):
    chosen = fx.fx_truth.select(F.col("i").alias("parent")).filter("parent <= 1").distinct()
    return M.sub_cluster_and_merge(fx.fx_mt_counts, fx.fx_truth, chosen)[1].select("barcode", "id", "type", r("llr").alias("llr"))


HAPTEXT = "SELECT cluster, string_agg(CASE WHEN allele IS NULL THEN '-' ELSE CAST(allele AS VARCHAR) END, '' ORDER BY pos) AS hap FROM fx_consensus GROUP BY cluster"


@register("b14_haplotype_texts", HAPTEXT)
def b14(fx):
    return sinks.haplotype_texts(fx.fx_consensus)


@register("b14_haplotype_table", "SELECT barcode, " + ", ".join(f"coalesce(CAST(max(allele) FILTER (WHERE pos = {p}) AS VARCHAR), 'NA') AS s{p}" for p in range(SITES)) + " FROM fx_haps GROUP BY barcode")
def b14t(fx):
    return sinks.haplotype_table(fx.fx_haps, list(range(SITES)))


@register("a12_read_haps", f"""
    SELECT cluster, CAST(rn - 1 AS INT) AS site, CAST(allele AS INT) AS allele FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS rn FROM fx_consensus) q WHERE allele IS NOT NULL""")
def a12(fx):
    path = fresh_path(fx.spark, "haps")
    sinks.haplotype_texts(fx.fx_consensus).coalesce(1).sortWithinPartitions("cluster").select("hap").write.text(path)  # one line per cluster
    return readers.read_haps(fx.spark, path)


@register("d15_first_source", """
    SELECT chrom, pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt FROM (SELECT chrom, pos, ref, alt FROM fx_sites WHERE site_id % 3 < 2) a
    FULL JOIN (SELECT chrom, pos, alt AS ref, ref AS alt FROM fx_sites WHERE site_id % 3 > 0) b USING (chrom, pos)""")
def d15(fx):
    a = fx.fx_sites.filter("site_id % 3 < 2").select("chrom", "pos", "ref", "alt")
    b = fx.fx_sites.filter("site_id % 3 > 0").select("chrom", "pos", F.col("alt").alias("ref"), F.col("ref").alias("alt"))
    return M.first_source([a, b], ["chrom", "pos"])


# --- homology: transcripts are parts and suppliers, scores are quantities ordered together ----------------

add_view("fx_edges", """
    SELECT concat('p', CAST(l_partkey % 40 AS STRING)) AS src, concat('s', CAST(l_suppkey % 30 AS STRING)) AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT concat('s', CAST(l_suppkey % 30 AS STRING)), concat('p', CAST(l_partkey % 40 AS STRING)), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem WHERE (l_partkey + l_suppkey) % 3 <> 0 GROUP BY 1, 2""")
RECIP = "SELECT a.src, a.dst, a.score + b.score AS score FROM fx_edges a JOIN fx_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"


@register("d12_reciprocal_edges", RECIP)
def d12(fx):
    return H.reciprocal(fx.fx_edges)


@register("f17_greedy_matching", f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY score DESC, src, dst) AS n FROM ({RECIP}) q),
    w AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::BIGINT AS score
      UNION ALL SELECT e.n, CASE WHEN list_contains(used, e.src) OR list_contains(used, e.dst) THEN used ELSE used || [e.src, e.dst] END,
        CASE WHEN list_contains(used, e.src) OR list_contains(used, e.dst) THEN NULL ELSE e.src END, e.dst, e.score FROM w JOIN e ON e.n = w.n + 1)
    SELECT src, dst, score FROM w WHERE src IS NOT NULL""")
def f17(fx):
    return H.greedy_match(H.reciprocal(fx.fx_edges))


@register("i43_homology_groups")
def i43(fx):
    """Three sets: parts, suppliers and customers, scored by what they order together."""
    o = fx.lineitem.join(fx.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey") % 30).alias("s"),
        F.concat(F.lit("c"), F.col("o_custkey") % 35).alias("c"), F.col("l_quantity").alias("q"))
    e = None
    for a, b in (("p", "s"), ("s", "p"), ("p", "c"), ("c", "p"), ("s", "c"), ("c", "s")):
        x = o.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum("q").alias("score")).select(F.lit(a).alias("set_a"), "a", F.lit(b).alias("set_b"), "b", "score")
        e = x if e is None else e.unionByName(x)
    return H.homology_groups(e)
