"""Label sets: merging, comparing, composition, summaries, and label-driven outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import labels as B
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import fresh_path
from poolcall.sources import sinks

add_view("fx_matched", """SELECT barcode, a.id AS id1, a.type AS type1, b.id AS id2, b.type AS type2
    FROM fx_labels_a a JOIN fx_labels_b b USING (barcode)""", lambda fx: B.matched(fx.fx_labels_a, fx.fx_labels_b))
add_view("fx_jaccard", """
    SELECT *, n / (tot1 + tot2 - n) AS jaccard FROM (
      SELECT *, CAST(sum(n) OVER (PARTITION BY id1) AS DOUBLE) AS tot1, CAST(sum(n) OVER (PARTITION BY id2) AS DOUBLE) AS tot2 FROM (
        SELECT id1, id2, type1, type2, count(*) AS n FROM fx_matched GROUP BY ALL) q) z""", lambda fx: B.jaccard(fx.fx_matched))
COMP = """SELECT member, w, w / sum(w) OVER () AS share FROM (
      SELECT unnest(string_split(id, '+')) AS member, sum(CASE WHEN contains(id, '+') THEN 1.0 ELSE 2.0 END) AS w FROM {t} GROUP BY 1) q"""
add_view("fx_comp_a", COMP.format(t="fx_labels_a"), lambda fx: B.composition(fx.fx_labels_a))
add_view("fx_comp_b", COMP.format(t="fx_labels_b"), lambda fx: B.composition(fx.fx_labels_b))


@register("d8_merge_labels", """
    SELECT * FROM (
      SELECT coalesce(a.barcode, b.barcode) AS barcode,
             CASE WHEN b.id IS NULL OR a.llr > b.llr OR (a.llr = b.llr AND a.id = b.id) THEN a.id WHEN a.id IS NULL OR b.llr > a.llr THEN b.id END AS id,
             CASE WHEN b.id IS NULL OR a.llr > b.llr OR (a.llr = b.llr AND a.id = b.id) THEN a.type WHEN a.id IS NULL OR b.llr > a.llr THEN b.type END AS type,
             CASE WHEN b.id IS NULL OR a.llr > b.llr OR (a.llr = b.llr AND a.id = b.id) THEN a.llr WHEN a.id IS NULL OR b.llr > a.llr THEN b.llr END AS llr
      FROM fx_labels_a a FULL JOIN fx_labels_b b ON a.barcode = b.barcode) q WHERE llr > 0""")
def d8(fx):
    return B.merge_labels(fx.fx_labels_a, fx.fx_labels_b)


@register("d9_matched_labels", """
    SELECT 'both' AS part, count(*) AS n FROM fx_matched
    UNION ALL SELECT 'only_a', count(*) FROM fx_labels_a WHERE barcode NOT IN (SELECT barcode FROM fx_labels_b)
    UNION ALL SELECT 'only_b', count(*) FROM fx_labels_b WHERE barcode NOT IN (SELECT barcode FROM fx_labels_a)""")
def d9(fx):
    a, b = fx.fx_labels_a, fx.fx_labels_b
    def n(df, part):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n(fx.fx_matched, "both").union(n(a.join(b, "barcode", "left_anti"), "only_a")).union(
        n(b.join(a, "barcode", "left_anti"), "only_b"))


@register("d16_cluster_fallback", """
    SELECT a.barcode, coalesce(c.cluster, a.id) AS cluster FROM fx_labels_a a
    LEFT JOIN (SELECT o_orderkey AS barcode, o_orderpriority AS cluster FROM orders WHERE o_orderstatus = 'F') c USING (barcode)""")
def d16(fx):
    c = fx.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("barcode"), F.col("o_orderpriority").alias("cluster"))
    return B.with_fallback(fx.fx_labels_a, c).select("barcode", "cluster")


@register("e11_cells_per_identity", """
    SELECT id, type, count(*) AS cells FROM fx_labels_a GROUP BY id, type
    UNION ALL SELECT member, 'in_doublet', count(*) FROM (
      SELECT unnest(string_split(id, '+')) AS member FROM fx_labels_a WHERE type = 'D') q GROUP BY member""")
def e11(fx):
    per = fx.fx_labels_a.groupBy("id", "type").agg(F.count(F.lit(1)).alias("cells"))
    d = B.members(per.filter("type = 'D'")).groupBy("member").agg(F.sum("cells").alias("cells"))
    return per.union(d.select("member", F.lit("in_doublet"), "cells"))


@register("e12_composition", f"SELECT member, {rq('share', 6)} AS share FROM fx_comp_a")
def e12(fx):
    return fx.fx_comp_a.select("member", r("share", 6).alias("share"))


@register("e13_llr_weights", f"""
    SELECT id, {rq('m', 6)} AS mean_llr, {rq('m / sum(m) OVER ()', 6)} AS weight FROM (SELECT id, avg(llr) AS m FROM fx_labels_a GROUP BY id) q""")
def e13(fx):
    return B.llr_weights(fx.fx_labels_a).select("id", r("mean_llr", 6).alias("mean_llr"), r("weight", 6).alias("weight"))


@register("e14_contingency", """
    SELECT coalesce(id1, '(all)') AS id1, coalesce(id2, '(all)') AS id2, count(*) AS n FROM fx_matched GROUP BY CUBE (id1, id2)""")
def e14(fx):
    return B.contingency(fx.fx_matched)


@register("e14_jaccard", f"SELECT id1, id2, n, {rq('jaccard', 6)} AS jaccard FROM fx_jaccard")
def e14j(fx):
    return fx.fx_jaccard.select("id1", "id2", "n", r("jaccard", 6).alias("jaccard"))


def _agreement_sql() -> str:
    parts = ["SELECT 'overall' AS metric, hit / n AS value FROM m"]
    for s, t in ((1, "a"), (2, "b")):
        o = "b" if t == "a" else "a"
        cnt, oth = f"(SELECT count(*) FROM fx_labels_{t})", f"(SELECT count(*) FROM fx_labels_{o})"
        parts += [f"SELECT 'recall_truth{s}', hit / {cnt} FROM m", f"SELECT 'f1_truth{s}', 2 * (hit / n) * (hit / {cnt}) / (hit / n + hit / {cnt}) FROM m",
                  f"SELECT 'missing_in{s}', ({oth} - n) / {oth} FROM m"]
        parts += [f"SELECT '{w}{s}', count(*) FILTER (WHERE type{s} = '{c}' AND id1 = id2) / count(*) FILTER (WHERE type{s} = '{c}') FROM fx_matched"
                  for w, c in (("singlet", "S"), ("doublet", "D"))]
    return ("WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE id1 = id2) AS hit FROM fx_matched), u AS ("
            + "\nUNION ALL ".join(parts) + f")\nSELECT metric, {rq('value', 6)} AS value FROM u")


@register("e15_agreement", _agreement_sql())
def e15(fx):
    return B.agreement(fx.fx_labels_a, fx.fx_labels_b).withColumn("value", r("value", 6))


@register("e16_cutoff_curves", f"""
    WITH lim AS (SELECT min(log10(llr)) AS lo, max(log10(llr)) AS hi FROM fx_labels_b),
    cuts AS (SELECT CAST(k AS INT) AS cut, round(pow(10, lo + k * (hi - lo) / 100), 9) AS cutoff FROM lim, range(0, 101) t(k)),
    hit AS (SELECT * FROM cuts JOIN fx_labels_b ON llr > cutoff)
    SELECT 'type' AS by, type AS name, cut, {rq('cutoff', 6)} AS cutoff, count(*) AS n FROM hit GROUP BY ALL
    UNION ALL SELECT 'identity', id, cut, {rq('cutoff', 6)}, count(*) FROM hit GROUP BY ALL""")
def e16(fx):
    return B.cutoff_curves(fx.fx_labels_b).withColumn("cutoff", r("cutoff", 6))


@register("e28_divergence", f"""
    WITH b AS (SELECT a.member, a.share AS pa, c.share AS pc FROM fx_comp_b a JOIN fx_comp_a c USING (member))
    SELECT 'all' AS type, 'H.amb' AS var, {rq('-sum(share * log2(share)) / log2(count(*))', 6)} AS val FROM fx_comp_b
    UNION ALL SELECT 'all', 'H.cells', {rq('-sum(share * log2(share)) / log2((SELECT count(*) FROM fx_comp_b))', 6)} FROM fx_comp_a
    UNION ALL SELECT 'all', 'KL.div', {rq('sum(pc * ln(pc / pa))', 6)} FROM b
    UNION ALL SELECT member, 'logdiff', {rq('ln(pa) - ln(pc)', 6)} FROM b""")
def e28(fx):
    return B.composition_divergence(fx.fx_comp_b, fx.fx_comp_a).withColumn("val", r("val", 6))


@register("f15_display_order", f"""
    SELECT side, id, {rq('jaccard', 6)} AS jaccard, CAST(row_number() OVER (PARTITION BY side ORDER BY jaccard DESC, id) AS INT) AS rank FROM (
      SELECT 1 AS side, id1 AS id, max(jaccard) AS jaccard FROM fx_jaccard WHERE type1 = 'S' AND type2 = 'S' GROUP BY id1
      UNION ALL SELECT 2, id2, max(jaccard) FROM fx_jaccard WHERE type1 = 'S' AND type2 = 'S' GROUP BY id2) q""")
def f15(fx):
    return B.display_order(B.jaccard(fx.fx_matched, singlets_only=True)).withColumn("jaccard", r("jaccard", 6))


@register("f15_axis_order", """
    WITH f AS (SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY jaccard DESC, id) AS rank FROM (
      SELECT 1 AS side, id1 AS id, max(jaccard) AS jaccard FROM fx_jaccard WHERE type1 = 'S' AND type2 = 'S' GROUP BY id1
      UNION ALL SELECT 2, id2, max(jaccard) FROM fx_jaccard WHERE type1 = 'S' AND type2 = 'S' GROUP BY id2) q),
    p AS (SELECT side, id, split_part(id, '+', 1) AS one, split_part(id, '+', 2) AS two FROM (
      SELECT 1 AS side, id1 AS id FROM fx_matched UNION SELECT 2, id2 FROM fx_matched) l),
    r AS (SELECT p.side, p.id, a.rank AS r1, coalesce(b.rank, 0) AS r2 FROM p JOIN f a ON a.side = p.side AND a.id = p.one
          LEFT JOIN f b ON b.side = p.side AND b.id = p.two)
    SELECT side, id, CAST(row_number() OVER (PARTITION BY side ORDER BY least(r1, r2), greatest(r1, r2), id) AS INT) AS position FROM r""")
def f15_axes(fx):
    return B.axis_order(fx.fx_matched)


@register("f16_reciprocal_best", f"""
    SELECT id1, id2, {rq('jaccard', 6)} AS jaccard FROM (
      SELECT *, max(jaccard) OVER (PARTITION BY id1) AS m1, max(jaccard) OVER (PARTITION BY id2) AS m2 FROM fx_jaccard) q
    WHERE jaccard = m1 AND jaccard = m2""")
def f16(fx):
    return B.reciprocal_best(fx.fx_jaccard).withColumn("jaccard", r("jaccard", 6))


@register("f18_ordered_report", "SELECT id, type, count(*) AS cells FROM fx_labels_a GROUP BY id, type ORDER BY cells DESC, id")
def f18(fx):
    return fx.fx_labels_a.groupBy("id", "type").agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), "id")


@register("g7_same_members", """
    (SELECT member, 1 AS side FROM (SELECT member FROM fx_comp_a EXCEPT SELECT r_name FROM region) q)
    UNION ALL (SELECT r_name, 2 FROM (SELECT r_name FROM region EXCEPT SELECT member FROM fx_comp_a) q)""")
def g7(fx):
    return B.same_members(fx.fx_comp_a, fx.region.withColumnRenamed("r_name", "member"))


STYLES = {"plain": "{b}", "suffix": "{b}-L1", "underscore": "{b}_L1", "prefix": "L1_{b}", "one": "{b}-1", "one_suffix": "{b}-1-L1", "prefix_one": "L1_{b}-1"}


def _style_sql(f: str) -> str:
    a, b = f.split("{b}")
    return f"concat('{a}', CAST(barcode AS VARCHAR), '{b}')"


@register("b1_write_assignments", " UNION ALL ".join(
    f"SELECT '{k}' AS style, {_style_sql(f)} AS barcode, id, type, {rq('llr', 3)} AS llr FROM fx_labels_a" for k, f in STYLES.items()))
def b1(fx):
    """Written in each library style and read back."""
    out = None
    for style in STYLES:
        path = fresh_path(fx.spark, "assignments")
        sinks.write_assignments(fx.fx_labels_a, path, "L1", style)
        back = fx.spark.read.schema("barcode STRING, id STRING, type STRING, llr DOUBLE").csv(path, sep="\t")
        back = back.select(F.lit(style).alias("style"), "barcode", "id", "type", r("llr", 3).alias("llr"))
        out = back if out is None else out.unionByName(back)
    return out


@register("b3_write_pair_counts", "SELECT 'L1' AS library, barcode, i, ni, j, nj, ref_w, alt_w FROM fx_pair_counts")
def b3(fx):
    path = fresh_path(fx.spark, "pairs")
    sinks.write_pair_counts(fx.fx_pair_counts, "L1", path)
    return fx.spark.read.parquet(path).select("library", "barcode", "i", "ni", "j", "nj", "ref_w", "alt_w")


@register("a8_reload_pair_counts", """
    SELECT barcode, i, ni, j, nj, ref_w, alt_w FROM fx_pair_counts
    WHERE i IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 1) AND (j = -1 OR j IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 1))""")
def a8(fx):
    from poolcall.sources.readers import read_pair_counts
    path = fresh_path(fx.spark, "pairs")
    sinks.write_pair_counts(fx.fx_pair_counts, "L1", path)
    ok = fx.region.filter("r_regionkey <> 1").select(F.col("r_regionkey").alias("sample"))
    return read_pair_counts(fx.spark, path, ok).select("barcode", "i", "ni", "j", "nj", "ref_w", "alt_w")


add_view("fx_identified", """SELECT r.read_id, r.barcode, CASE WHEN i = j THEN a.name ELSE least(a.name, b.name) || '+' || greatest(a.name, b.name) END AS identity
    FROM fx_reads r JOIN fx_truth t ON t.barcode = r.barcode AND r.barcode % 5 <> 0 JOIN fx_samples a ON a.sample = i JOIN fx_samples b ON b.sample = j""",
         lambda fx: B.with_identity(fx.fx_reads.select("read_id", "barcode"), fx.fx_truth_names.filter("barcode % 5 <> 0")))


def _truth_names(fx):
    from poolcall.operators.likelihood import name_identities
    return name_identities(fx.fx_truth.withColumn("llr", F.lit(1.0)), fx.fx_samples)


add_view("fx_truth_names", "SELECT 1 AS one FROM fx_truth", _truth_names)


@register("b7_split_by_identity", """
    SELECT replace(identity, '+', 'x') AS identity, count(*) AS reads, CAST(sum(read_id) AS BIGINT) AS id_sum FROM fx_identified GROUP BY 1""")
def b7(fx):
    path = fresh_path(fx.spark, "split")
    sinks.split_by_identity(fx.fx_identified, path)
    return fx.spark.read.parquet(path).groupBy("identity").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").alias("id_sum"))


@register("b8_tag_reads", "SELECT read_id, barcode, identity FROM fx_identified")
def b8(fx):
    return fx.fx_identified.select("read_id", "barcode", "identity")


@register("b11_run_summary", f"""
    WITH d AS (SELECT count(*) FILTER (WHERE type = 'D') AS d, count(*) AS n FROM fx_labels_a)
    SELECT 'result' AS section, 'tot_cells' AS key, CAST(n AS DOUBLE) AS value FROM d
    UNION ALL SELECT 'result', 'frac_doublets', {rq('d / n', 6)} FROM d
    UNION ALL SELECT 'perc_doublets_include', member, {rq('count(*) / max(d)', 6)} FROM (
      SELECT unnest(string_split(id, '+')) AS member FROM fx_labels_a WHERE type = 'D') q, d GROUP BY member
    UNION ALL SELECT 'num_cells', id, CAST(count(*) AS DOUBLE) FROM fx_labels_a GROUP BY id""")
def b11(fx):
    return B.run_summary(fx.fx_labels_a).withColumn("value", r("value", 6))
