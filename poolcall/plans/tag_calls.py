"""Tags and guides: matching, counting, fitting and calling, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.functions import expr as X
from poolcall.operators import counts as C, joins as J, tags as T
from poolcall.plans.fixtures import VIEWS, acgt, add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import fresh_path

TAG_NO = "CASE tag WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
# a cell's own tag is many times its background; every seventh cell holds two
add_view("fx_tagged", f"""
    SELECT barcode, tag, CAST(CASE WHEN {TAG_NO} = barcode % 5 OR (barcode % 7 = 0 AND {TAG_NO} = (barcode + 2) % 5)
                                   THEN cnt * (10 + barcode % 13) ELSE cnt END AS BIGINT) AS cnt FROM fx_tag_counts""")


def nb(x, m, s):
    return f"(lgamma({x} + {s}) - lgamma({s}) - lgamma({x} + 1) + {s} * ln({s} / ({s} + {m})) + {x} * ln({m} / ({s} + {m})))"


def phi(m, v):
    return f"(CASE WHEN {v} > {m} THEN least({m} * {m} / ({v} - {m}), 1e6) ELSE 1e6 END)"


TOL = 1e-6


def fit_sql() -> str:
    ends = f"coalesce(bool_and(abs(ll - last) <= {TOL} * abs(last)) OVER (), FALSE)"
    terms = f"ln(w) + {nb('x', 'lo', 'phi')} AS a, ln(1 - w) - ln(hi) - x / hi AS b"
    mass = "greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))"
    sql = f"""
    WITH RECURSIVE h AS MATERIALIZED (SELECT tag, CAST(cnt AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM fx_tagged GROUP BY 1, 2),
    it AS (SELECT 0 AS k, tag, s AS start, 0.5::DOUBLE AS w, greatest(CASE s WHEN 0 THEN min(cnt) ELSE median(cnt) END, 0.1)::DOUBLE AS lo,
           1.0::DOUBLE AS phi, CAST(max(cnt) AS DOUBLE) AS hi, NULL::DOUBLE AS ll, FALSE AS ended FROM fx_tagged, (VALUES (0), (1)) z(s) GROUP BY tag, s
      UNION ALL
      SELECT k + 1, tag, start, w, lo, {phi('lo', '(m2 - lo * lo)')}, hi, ll, {ends} FROM (
        SELECT k, tag, start, last, least(greatest(sum(r) / (sum(r) + sum(q)), 1e-6), 1 - 1e-6) AS w, greatest(sum(r * x) / sum(r), 0.1) AS lo,
               sum(r * x * x) / sum(r) AS m2, greatest(CASE WHEN sum(q) > 1e-9 THEN sum(q * x) / sum(q) ELSE 0.1 END, 0.1) AS hi, sum(n * t) AS ll
        FROM (SELECT *, exp(a - t) * n AS r, n - exp(a - t) * n AS q FROM (SELECT *, {mass} AS t FROM (
          SELECT k, h.tag, start, ll AS last, x, n, {terms} FROM h JOIN it ON it.tag = h.tag WHERE NOT ended) z1) z2) z3
        GROUP BY k, tag, start, last) z4),
    p AS MATERIALIZED (SELECT * FROM it WHERE k = (SELECT max(k) FROM it)),
    l AS (SELECT tag, start, sum(n * ({mass})) AS ll FROM (SELECT h.tag, start, n, {terms} FROM h JOIN p ON p.tag = h.tag) z5 GROUP BY tag, start)"""
    take = "b.ll > a.ll AND bb.hi > bb.lo AND bb.w > 1e-6 AND bb.w < 1 - 1e-6 AND bb.hi > aa.hi"
    cols = ", ".join(f"CASE WHEN {take} THEN bb.{c} ELSE aa.{c} END AS {c}" for c in ("w", "lo", "phi", "hi"))
    return sql + f"""
    SELECT aa.tag, {cols} FROM p aa JOIN p bb ON aa.tag = bb.tag AND aa.start = 0 AND bb.start = 1
    JOIN l a ON a.tag = aa.tag AND a.start = 0 JOIN l b ON b.tag = aa.tag AND b.start = 1"""


def _fits(fx):
    from poolcall.session import cut
    return cut(T.fit_tags(fx.fx_tagged, tol=TOL))


add_view("fx_fits", fit_sql(), _fits)
add_view("fx_bg", "SELECT *, lo / sum(lo) OVER () AS bg, sum(lo) OVER () AS lo_all FROM fx_fits", lambda fx: None)
add_view("fx_enriched", """
    SELECT *, CAST(row_number() OVER (PARTITION BY barcode ORDER BY excess DESC, tag) AS INT) AS rank FROM (
      SELECT c.barcode, c.tag, c.cnt, lo, phi, hi, bg, lo_all, CAST(sum(cnt) OVER (PARTITION BY barcode) AS BIGINT) AS tot,
             round(cnt / sum(cnt) OVER (PARTITION BY barcode) - bg, 9) AS excess FROM fx_tagged c JOIN fx_bg b ON b.tag = c.tag) q""",
         lambda fx: T.enriched(fx.fx_tagged, T.ambient_shares(fx.fx_fits)))
add_view("fx_scores", f"""
    SELECT barcode, tag, rank, tot, excess, lo_all,
           round(xh - y * log2(h1) + y * log2(y) + (xl_all - xl) - tot * log2(y + greatest(b, 0)) + {nb('y', 'h1', phi('h1', 'h2'))} / ln(2), 6) AS ll,
           round(xl_all - tot * log2(lo_all), 6) AS ll_bg0 FROM (
      SELECT *, CAST(sum(cnt) OVER w AS DOUBLE) AS y, sum(hi) OVER w AS h1, sum(hi * hi) OVER w AS h2, lo_all - sum(lo) OVER w AS b,
             sum(cnt * log2(hi)) OVER w AS xh, sum(cnt * log2(lo)) OVER w AS xl, sum(cnt * log2(lo)) OVER (PARTITION BY barcode) AS xl_all
      FROM fx_enriched WINDOW w AS (PARTITION BY barcode ORDER BY rank ROWS UNBOUNDED PRECEDING)) q""",
         lambda fx: T.growing_scores(fx.fx_tagged, fx.fx_fits))


def sets_sql(max_tags: int | None, guides: bool) -> str:
    cond = f"WHERE rank <= {max_tags}" if max_tags else ""
    bg = f"round(max(ll_bg0) + {nb('max(CAST(tot AS DOUBLE))', 'max(lo_all)', '1e6')} / ln(2), 6)"
    base = f"""
      SELECT *, sum(fall) OVER (PARTITION BY barcode ORDER BY rank) AS falls FROM (
        SELECT *, CASE WHEN ll < lag(ll) OVER (PARTITION BY barcode ORDER BY rank) THEN 1 ELSE 0 END AS fall FROM fx_scores {cond}) q"""
    grp = f"""SELECT barcode, list_sort(list(tag) FILTER (WHERE falls = 0)) AS tags, arg_max(ll, rank) FILTER (WHERE falls = 0) AS best,
        max(ll) FILTER (WHERE falls = 1 AND fall = 1) AS nxt, {bg} AS bg,
        (list(ll ORDER BY rank DESC) FILTER (WHERE falls = 0))[2] AS before FROM ({base}) s GROUP BY barcode"""
    if guides:
        return f"""SELECT barcode, CASE WHEN bg > best THEN [] ELSE tags END AS tags,
            round(CASE WHEN bg > best THEN bg - best ELSE best - greatest(before, nxt, bg) END, 6) AS llr FROM ({grp}) g"""
    return f"SELECT barcode, tags, round(best - coalesce(greatest(before, nxt), bg), 6) AS llr FROM ({grp}) g"


add_view("fx_sets", sets_sql(2, False), lambda fx: T.choose_sets(fx.fx_scores))
add_view("fx_guide_sets", sets_sql(None, True), lambda fx: T.choose_sets(fx.fx_scores, None, guides=True))


@register("i7_tag_split", f"SELECT tag, {rq('w')} AS w, {rq('lo')} AS lo, {rq('phi')} AS phi, {rq('hi')} AS hi FROM fx_fits")
def i7(fx):
    return fx.fx_fits.select("tag", *[r(c).alias(c) for c in ("w", "lo", "phi", "hi")])


@register("i8_dropout_by_means", f"""
    SELECT tag, NOT ({nb('hi', 'bm', phi('bm', 'bv'))} > {nb('hi', 'fm', phi('fm', 'fv'))}) AS keep FROM (
      SELECT *, avg(lo) OVER () AS bm, avg(hi) OVER () AS fm, sum(lo + lo * lo / phi) OVER () / pow(count(*) OVER (), 2) AS bv,
             sum(hi * hi) OVER () / pow(count(*) OVER (), 2) AS fv FROM fx_fits) q""")
def i8(fx):
    return T.keep_by_means(fx.fx_fits).select("tag", "keep")


@register("i8_dropout_by_separation")
def i8b(fx):
    f = fx.fx_fits
    return f.filter(F.col("tag").isin(T.separated(f))).select("tag")


@register("i9_ambient_shares", f"SELECT tag, {rq('bg', 6)} AS bg FROM fx_bg")
def i9(fx):
    return T.ambient_shares(fx.fx_fits).select("tag", r("bg", 6).alias("bg"))


@register("f4_enriched_tags", f"SELECT barcode, tag, rank, {rq('excess', 6)} AS excess FROM fx_enriched")
def f4(fx):
    return fx.fx_enriched.select("barcode", "tag", "rank", r("excess", 6).alias("excess"))


@register("f5_growing_sets", f"SELECT barcode, rank, tag, {rq('ll', 3)} AS ll FROM fx_scores")
def f5(fx):
    return fx.fx_scores.select("barcode", "rank", "tag", r("ll", 3).alias("ll"))


@register("i10_tag_sets", f"""
    SELECT barcode, array_to_string(tags, '+') AS id, CASE len(tags) WHEN 1 THEN 'S' ELSE 'D' END AS type, {rq('llr', 3)} AS llr FROM fx_sets""")
def i10(fx):
    return T.label_rows(fx.fx_sets).withColumn("llr", r("llr", 3))


@register("b2_guide_labels", f"""
    SELECT barcode, CASE WHEN len(tags) = 0 THEN 'WT' ELSE array_to_string(tags, ',') END AS id, CAST(len(tags) AS VARCHAR) AS type, {rq('llr', 3)} AS llr
    FROM fx_guide_sets""")
def b2(fx):
    return T.label_rows(fx.fx_guide_sets, guides=True).withColumn("llr", r("llr", 3))


SHARE_LL = "max(outside) * ln({c}) + sum(CASE WHEN inside THEN cnt * ln({c} * bg + (1 - {c}) * hi / h) ELSE 0 END)"


@register("i11_background_share", f"""
    WITH c AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE cnt END) OVER (PARTITION BY barcode) AS outside,
                      sum(CASE WHEN inside THEN hi ELSE 0 END) OVER (PARTITION BY barcode) AS h FROM (
        SELECT t.barcode, t.tag, t.cnt, b.bg, b.hi, list_contains(s.tags, t.tag) AS inside
        FROM fx_tagged t JOIN fx_bg b ON b.tag = t.tag JOIN fx_sets s ON s.barcode = t.barcode) q),
    g0 AS (SELECT barcode, arg_max(c0, (ll, -c0)) AS c0 FROM (
        SELECT barcode, k / 100.0::DOUBLE AS c0, round({SHARE_LL.format(c='(k / 100.0::DOUBLE)')}, 9) AS ll FROM c, range(1, 100) z(k) GROUP BY barcode, k) q GROUP BY barcode),
    g1 AS (SELECT barcode, arg_max(c1, (ll, -c1)) AS share FROM (
        SELECT barcode, c1, round({SHARE_LL.format(c='c1')}, 9) AS ll FROM (
          SELECT c.*, c0 + k / 2000.0::DOUBLE AS c1 FROM c JOIN g0 USING (barcode), range(-19, 20) z(k)) y GROUP BY barcode, c1) q GROUP BY barcode)
    SELECT barcode, {rq('share', 4)} AS share FROM g1""")
def i11(fx):
    return T.background_share(fx.fx_tagged, fx.fx_fits, fx.fx_sets).withColumn("share", r("share", 4))


@register("e6_umi_counts", "SELECT barcode, tag, cnt FROM fx_tag_counts")
def e6(fx):
    return C.umi_counts(fx.fx_tag_reads)


@register("e6_umi_counts_sketch")
def e6b(fx):
    return C.umi_counts_approx(fx.fx_tag_reads)


NAMES = "click error purchase signup view".split()
WIDE = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (WHERE tag = '{n}'), 0) AS BIGINT) AS {n}" for n in NAMES)


@register("b4_wide_counts", f"SELECT barcode, {WIDE} FROM fx_tagged GROUP BY barcode")
def b4(fx):
    return T.wide_counts(fx.fx_tagged, T.tag_names(fx.fx_tagged))


@register("b5_membership", "SELECT barcode, " + ", ".join(f"CAST(list_contains(tags, '{n}') AS INT) AS {n}" for n in NAMES) + " FROM fx_guide_sets")
def b5(fx):
    return T.membership(fx.fx_guide_sets, T.tag_names(fx.fx_tagged))


@register("a7_wide_to_long", "SELECT CAST(barcode AS VARCHAR) AS barcode, tag, cnt FROM fx_tagged WHERE cnt > 0")
def a7(fx):
    from poolcall.sources.readers import read_counts_wide
    path = fresh_path(fx.spark, "wide")
    T.wide_counts(fx.fx_tagged, T.tag_names(fx.fx_tagged)).write.csv(path, sep="\t", header=True)
    return read_counts_wide(fx.spark, path)


@register("e26_ranked_tags", """
    SELECT tag, name, total, rank, name IS NULL AND rank < max(CASE WHEN name IS NOT NULL THEN rank END) OVER () AS suspect FROM (
      SELECT tag, name, CAST(sum(cnt) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY sum(cnt) DESC, tag) AS INT) AS rank FROM (
        SELECT tag, CASE WHEN tag IN ('click', 'view', 'error') THEN upper(tag) END AS name, cnt FROM fx_tagged) q GROUP BY tag, name) z""")
def e26(fx):
    named = F.when(F.col("tag").isin("click", "view", "error"), F.upper("tag"))
    return T.ranked_totals(fx.fx_tagged.withColumn("name", named))


EVENT_TAGS = ["click", "error", "purchase", "signup", "view"]


def _wide(names) -> str:
    cols = [f"CAST(coalesce(sum(cnt) FILTER (WHERE tag = '{t}'), 0) AS BIGINT) AS {t}" if t in names else f"0::BIGINT AS {t}" for t in EVENT_TAGS]
    return f"SELECT barcode, {', '.join(cols)} FROM fx_tagged GROUP BY barcode"


@register("e27_union_guide_tables", f"{_wide(EVENT_TAGS[:3])} UNION ALL {_wide(EVENT_TAGS[2:])}")
def e27(fx):
    """Two tables that share one tag; together they hold every tag of the reads."""
    names = T.tag_names(fx.fx_tagged)
    return T.union_tables(T.wide_counts(fx.fx_tagged, names[:3]), T.wide_counts(fx.fx_tagged, names[2:]))


# tag sequences of the nations; each read carries its tag at offset 3 with one base changed in every third read
add_view("fx_tag_seqs", f"SELECT concat('N', CAST(n_nationkey AS STRING)) AS tag, {acgt('n_nationkey * 40503 + 977', 12)} AS seq FROM nation")
add_view("fx_seq_reads", f"""
    SELECT read_id, barcode, concat(substr('ACG', 1, 3), CASE WHEN bad THEN concat(substr(t, 1, pos - 1), other, substr(t, pos + 1, 12)) ELSE t END, 'TT') AS seq FROM (
      SELECT l_orderkey * 8 + l_linenumber AS read_id, l_suppkey AS barcode, l_orderkey % 3 = 0 AS bad, l_linenumber + 1 AS pos,
             substr('ACGT', CAST(l_orderkey % 4 AS INT) + 1, 1) AS other, {acgt('(l_suppkey % 25) * 40503 + 977', 12)} AS t FROM lineitem) q""",
         lambda fx: X.pin(fx.spread_sql(VIEWS["fx_seq_reads"], "lineitem", "l_orderkey", "l_linenumber"), seq=F.col("seq")))


@register("d5_match_tags", """
    SELECT barcode, tag, count(*) AS reads FROM (
      SELECT w.win, w.barcode, t.tag, w.n FROM (SELECT barcode, substr(seq, 4, 12) AS win, 1 AS n FROM fx_seq_reads) w
      JOIN (SELECT win, CASE WHEN count(*) FILTER (WHERE mm = best) = 1 THEN arg_min(tag, mm) END AS tag FROM (
              SELECT *, min(mm) OVER (PARTITION BY win) AS best FROM (
                SELECT d.win, tag, hamming(d.win, seq) AS mm FROM (SELECT DISTINCT substr(seq, 4, 12) AS win FROM fx_seq_reads) d, fx_tag_seqs) a
              WHERE mm <= 2) b GROUP BY win) t ON t.win = w.win AND t.tag IS NOT NULL) z GROUP BY barcode, tag""")
def d5(fx):
    tags = fx.fx_tag_seqs
    at = T.voted_offset(fx.fx_seq_reads, tags, 12)
    w = fx.fx_seq_reads.select("barcode", F.substring("seq", at, 12).alias("window")).groupBy("barcode", "window").agg(F.count(F.lit(1)).alias("n"))
    return J.match_tags(w, tags, 12).groupBy("barcode", "tag").agg(F.sum("n").alias("reads"))


@register("d5_voted_offset", """
    SELECT CAST(p AS INT) AS pos FROM fx_seq_reads r JOIN fx_tag_seqs t ON contains(r.seq, t.seq), range(1, 7) z(p)
    WHERE substr(r.seq, p, 12) = t.seq GROUP BY p ORDER BY count(*) DESC, p LIMIT 1""")
def d5b(fx):
    at = T.voted_offset(fx.fx_seq_reads, fx.fx_tag_seqs, 12)
    return fx.spark.range(1).select(F.lit(at).alias("pos"))


# cell barcodes as read: one base changed in every fourth read
add_view("fx_allow", f"SELECT s_suppkey AS cell, {acgt('s_suppkey * 77747 + 13', 16)} AS barcode FROM supplier")
add_view("fx_raw_barcodes", f"""
    SELECT read_id, cell, CASE WHEN read_id % 4 = 0 THEN concat(substr(b, 1, pos - 1), other, substr(b, pos + 1, 16)) ELSE b END AS barcode FROM (
      SELECT l_orderkey * 8 + l_linenumber AS read_id, l_suppkey AS cell, CAST(l_orderkey % 16 AS INT) + 1 AS pos,
             substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS other, {acgt('l_suppkey * 77747 + 13', 16)} AS b FROM lineitem) q""",
         lambda fx: X.pin(fx.spread_sql(VIEWS["fx_raw_barcodes"], "lineitem", "l_orderkey", "l_linenumber"), barcode=F.col("barcode")))
CORRECT = """
    SELECT d.barcode, coalesce(max(a.barcode) FILTER (WHERE a.barcode = d.barcode), CASE WHEN count(*) = 1 THEN max(a.barcode) END) AS corrected,
           CASE WHEN bool_or(a.barcode = d.barcode) THEN 0 ELSE 1 END AS mismatches
    FROM (SELECT DISTINCT barcode FROM fx_raw_barcodes) d JOIN fx_allow a ON hamming(a.barcode, d.barcode) <= 1 GROUP BY d.barcode"""
add_view("fx_corrected", f"SELECT r.read_id, r.cell, r.barcode, c.corrected, c.mismatches FROM fx_raw_barcodes r JOIN ({CORRECT}) c ON c.barcode = r.barcode AND corrected IS NOT NULL",
         lambda fx: J.match_allow_list(fx.fx_raw_barcodes, fx.fx_allow.select("barcode")))


@register("d4_correct_barcodes", "SELECT corrected, mismatches, count(*) AS reads, CAST(sum(read_id) AS BIGINT) AS id_sum FROM fx_corrected GROUP BY corrected, mismatches")
def d4(fx):
    return fx.fx_corrected.groupBy("corrected", "mismatches").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").alias("id_sum"))


@register("j1_stream_tag_counts", "SELECT barcode, tag, cnt FROM fx_tag_counts")
def j1(fx):
    from poolcall.streaming import tag_counts as S
    src, uniq, out = (fresh_path(fx.spark, n) for n in ("reads", "unique", "counts"))
    fx.fx_tag_reads.select("barcode", "tag", "umi").write.parquet(src)
    rows = fx.spark.readStream.schema("barcode BIGINT, tag STRING, umi INT").option("maxFilesPerTrigger", 4).parquet(src)
    S.dedupe_stream(rows, uniq, fresh_path(fx.spark, "ck")).awaitTermination()
    new = fx.spark.readStream.schema("barcode BIGINT, tag STRING, umi INT").parquet(uniq)
    S.count_stream(new, ["barcode", "tag"], out, fresh_path(fx.spark, "ck")).awaitTermination()
    saved = fx.spark.read.schema("barcode BIGINT, tag STRING, cnt BIGINT").parquet(out)
    return S.latest_counts(saved, ["barcode", "tag"])


@register("j1_stream_within_horizon", "SELECT barcode, tag, cnt FROM fx_tag_counts")
def j1_horizon(fx):
    """The same with UMIs forgotten after a horizon; it spans the whole input here, so the counts are all of them."""
    from poolcall.streaming import tag_counts as S
    src, uniq = (fresh_path(fx.spark, n) for n in ("reads", "unique"))
    fx.fx_tag_reads.select("barcode", "tag", "umi", F.timestamp_seconds(F.col("umi") + 1_000_000_000).alias("at")).write.parquet(src)
    schema = "barcode BIGINT, tag STRING, umi INT, at TIMESTAMP"
    rows = fx.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(src)
    S.dedupe_stream(rows, uniq, fresh_path(fx.spark, "ck"), "at", "36500 days").awaitTermination()
    from poolcall.operators.counts import umi_counts
    return umi_counts(fx.spark.read.schema("barcode BIGINT, tag STRING, umi INT").parquet(uniq))


@register("j2_stream_partial_counts", "SELECT barcode, tag, count(*) AS cnt FROM fx_tag_reads GROUP BY barcode, tag")
def j2(fx):
    from poolcall.operators.species import merge_counts
    from poolcall.streaming import tag_counts as S
    src, out = fresh_path(fx.spark, "reads"), fresh_path(fx.spark, "partial")
    fx.fx_tag_reads.select("barcode", "tag").write.parquet(src)
    rows = fx.spark.readStream.schema("barcode BIGINT, tag STRING").option("maxFilesPerTrigger", 2).parquet(src)
    S.partial_counts(rows, ["barcode", "tag"], out, fresh_path(fx.spark, "ck")).awaitTermination()
    return merge_counts(fx.spark.read.schema("barcode BIGINT, tag STRING, cnt BIGINT").parquet(out), ["barcode", "tag"])
