"""Species: k-mer references, read votes, mixture calls and read routing. Languages stand for species, letters for bases."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from poolcall.functions import expr as X, kmer_codes
from poolcall.operators import species as S
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq
from poolcall.scaling import spread
from poolcall.session import cut, fresh_path
from poolcall.sources import readers, sinks

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[k % 4] for k in range(26))
K = 12


def dna(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N'{{g}})"


def _dna(fx):
    """The Spark form of the view, a batch of texts at a time."""
    table = bytes(BASES[LETTERS.index(chr(c))].encode()[0] if chr(c) in LETTERS else c if chr(c) in "ACGT" else ord("N") for c in range(128))
    docs = spread(fx.documents.select("doc_id", "lang", F.lower("text").alias("text")), "doc_id")
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in (("doc_id", "doc_id"), ("species", "lang"))]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), kmer_codes.recoded(b.column(2), table, b"N")], names=["doc_id", "species", "seq"])

    return docs.mapInArrow(run, ", ".join([*kinds, "seq string"]))


add_view("fx_dna", f"SELECT doc_id, lang AS species, {dna('text').format(g=', %sg%s' % (chr(39), chr(39)))} AS seq FROM documents", _dna)
add_view("fx_kmers", f"""
    SELECT species, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer, count(*) AS cnt FROM (
      SELECT species, unnest(list_transform(range(1, length(seq) - {K - 2}), lambda p: substr(seq, p, {K}))) AS k FROM (SELECT species, unnest(string_split(seq, 'N')) AS seq FROM fx_dna) z) q
    WHERE length(k) > 0 GROUP BY 1, 2""", lambda fx: S.species_kmer_counts(fx.fx_dna, K))
add_view("fx_unique", """
    SELECT kmer, min(species) AS species, max(cnt) AS cnt FROM fx_kmers GROUP BY kmer HAVING count(DISTINCT species) = 1""",
         lambda fx: S.unique_kmers(fx.fx_kmers))
# a read is one line of a document; two documents share a cell; a UMI repeats every eight lines
add_view("fx_line_reads", """
    SELECT doc_id * 1000000 + pos AS read_id, CAST(floor(doc_id / 2) AS BIGINT) AS barcode, CAST(pos % 8 AS INT) AS umi, line AS seq FROM (
      SELECT doc_id, unnest(string_split(seq, 'N')) AS line, unnest(range(0, len(string_split(seq, 'N')))) AS pos FROM fx_dna) q
    WHERE length(line) >= 6""",
         lambda fx: fx.fx_dna.select("doc_id", F.posexplode(F.split("seq", "N")).alias("pos", "line")).filter(F.length("line") >= 6).select(
             (F.col("doc_id") * 1000000 + F.col("pos")).alias("read_id"), F.floor(F.col("doc_id") / 2).alias("barcode"),
             (F.col("pos") % 8).cast("int").alias("umi"), F.col("line").alias("seq")))
KR = 6  # reads are single words here, so votes use shorter k-mers
add_view("fx_kmers6", f"""
    SELECT species, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer, count(*) AS cnt FROM (
      SELECT species, unnest(list_transform(range(1, length(seq) - {KR - 2}), lambda p: substr(seq, p, {KR}))) AS k FROM (SELECT species, unnest(string_split(seq, 'N')) AS seq FROM fx_dna) z) q
    WHERE length(k) > 0 GROUP BY 1, 2""", lambda fx: S.species_kmer_counts(fx.fx_dna, KR))
# at this length nearly every k-mer occurs in all languages, so one belongs to the language that holds most of it
add_view("fx_owned", """
    SELECT kmer, species FROM (SELECT kmer, arg_max(species, (cnt, species)) AS species, max(cnt) AS m, sum(cnt) AS t FROM fx_kmers6 GROUP BY kmer) q
    WHERE m * 4 > t * 3""",
         lambda fx: fx.fx_kmers6.groupBy("kmer").agg(F.max_by("species", F.struct("cnt", "species")).alias("species"), F.max("cnt").alias("m"),
                                                     F.sum("cnt").alias("t")).filter("m * 4 > t * 3").select("kmer", "species"))


@register("e34_species_kmer_counts", "SELECT species, count(*) AS kmers, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS top FROM fx_kmers GROUP BY species")
def e34(fx):
    return fx.fx_kmers.groupBy("species").agg(F.count(F.lit(1)).alias("kmers"), F.sum("cnt").alias("total"), F.max("cnt").alias("top"))


@register("g4_unique_kmers", "SELECT species, count(*) AS kmers, min(kmer) AS first_kmer, max(kmer) AS last_kmer FROM fx_unique GROUP BY species")
def g4(fx):
    return fx.fx_unique.groupBy("species").agg(F.count(F.lit(1)).alias("kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


DUST = f"""list_sum(list_transform(list_distinct(t), lambda u: len(list_filter(t, lambda v: v = u)) * (len(list_filter(t, lambda v: v = u)) - 1))) / 2.0 / {K - 3}"""
add_view("fx_dust", f"SELECT kmer, species, {DUST} AS dust FROM (SELECT *, list_transform(range(1, {K - 1}), lambda p: substr(kmer, p, 3)) AS t FROM fx_unique) q",
         lambda fx: fx.fx_unique.withColumn("dust", S.dust("kmer")))


@register("c10_low_complexity", f"SELECT kmer, species, {rq('dust')} AS dust FROM fx_dust WHERE dust > 0.5")
def c10(fx):
    return fx.fx_dust.filter("dust > 0.5").select("kmer", "species", r("dust").alias("dust"))


UNI = "(CAST(concat('0x', substr(md5({x}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@register("f13_top_kmers", f"""
    WITH r AS (SELECT species, kmer, cnt, row_number() OVER (PARTITION BY species ORDER BY cnt DESC) AS n FROM fx_unique),
    c AS (SELECT species, cnt AS cutoff FROM r WHERE n = 501),
    s AS (SELECT u.species, cutoff, (501 - count(*) FILTER (WHERE cnt > cutoff)) / count(*) FILTER (WHERE cnt = cutoff) AS share
          FROM fx_unique u JOIN c ON c.species = u.species GROUP BY u.species, cutoff)
    SELECT u.species, kmer, cnt FROM fx_unique u LEFT JOIN s ON s.species = u.species
    WHERE cutoff IS NULL OR cnt > cutoff OR (cnt = cutoff AND {UNI.format(x='kmer')} < share)""")
def f13(fx):
    return S.top_kmers(fx.fx_unique, 500)


HITS = f"""
    SELECT read_id, arg_min(species, pos) AS species FROM (
      SELECT read_id, p AS pos, least(substr(seq, p, {KR}), translate(reverse(substr(seq, p, {KR})), 'ACGT', 'TGCA')) AS kmer
      FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {KR - 2})) AS p FROM {{src}}) z) q
    JOIN fx_owned u ON u.kmer = q.kmer GROUP BY read_id"""


@register("d11_first_hits", f"SELECT species, count(*) AS reads, CAST(sum(read_id) AS BIGINT) AS id_sum FROM ({HITS.format(src='fx_line_reads')}) h GROUP BY species")
def d11(fx):
    """The sum of read_ids leaves 64 bits near 1 GB of documents, where the SQL has no value; there it is an exact decimal."""
    h = S.first_hits(fx.fx_line_reads, fx.fx_owned, KR)
    d = cut(h.groupBy("species").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("read_id").cast("decimal(20,0)")).alias("id_sum")))  # one row per species
    low, high = d.agg(F.min("id_sum"), F.max("id_sum")).first()
    return d.withColumn("id_sum", F.col("id_sum").cast("bigint")) if low is None or -2 ** 63 <= low and high < 2 ** 63 else d


add_view("fx_first_umi", """SELECT barcode, umi, arg_min(read_id, read_id) AS read_id, arg_min(seq, read_id) AS seq FROM fx_line_reads GROUP BY barcode, umi""",
         lambda fx: S.first_per_umi(fx.fx_line_reads))
add_view("fx_species_counts", f"""
    SELECT barcode, species, count(*) AS cnt FROM ({HITS.format(src='fx_line_reads')}) h JOIN fx_line_reads USING (read_id) GROUP BY barcode, species""",
         lambda fx: cut(S.species_counts(fx.fx_line_reads, fx.fx_owned, KR, use_umis=False)))  # read again by every fit and curve


@register("e7_species_counts_by_umi", f"""
    SELECT f.barcode, h.species, count(*) AS cnt FROM ({HITS.format(src='fx_first_umi')}) h JOIN fx_first_umi f USING (read_id) GROUP BY f.barcode, h.species""")
def e7(fx):
    return S.species_counts(fx.fx_line_reads, fx.fx_owned, KR)


REFS = "concat(CASE CAST(barcode % 3 AS INT) WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END, '_', chrom)"


@register("e8_counts_by_reference", f"SELECT barcode, split_part({REFS}, '_', 1) AS species, count(*) AS cnt FROM fx_reads GROUP BY 1, 2")
def e8(fx):
    return S.counts_by_reference(fx.fx_reads.select("barcode", F.expr(REFS).alias("chrom")))


@register("e9_merge_counts", "SELECT barcode, species, cnt FROM fx_species_counts")
def e9(fx):
    """Two halves counted on their own and added up."""
    half, owned = F.col("read_id") % 2 == 0, cut(fx.fx_owned)
    return S.merge_species_counts([S.species_counts(fx.fx_line_reads.filter(c), owned, KR, use_umis=False) for c in (half, ~half)])


@register("e29_species_fractions", f"""
    SELECT barcode, species, {rq('cnt / sum(cnt) OVER (PARTITION BY barcode)', 6)} AS frac FROM fx_species_counts""")
def e29(fx):
    from pyspark.sql import Window as W
    w = W.partitionBy("barcode")  # one row per species
    return fx.fx_species_counts.select("barcode", "species", r(F.col("cnt") / F.sum("cnt").over(w), 6).alias("frac"))


add_view("fx_totals", "SELECT barcode, CAST(sum(cnt) AS BIGINT) AS tot FROM fx_species_counts GROUP BY barcode",
         lambda fx: fx.fx_species_counts.groupBy("barcode").agg(F.sum("cnt").alias("tot")))
add_view("fx_curve", "SELECT CAST(tot AS DOUBLE) AS x, (SELECT count(*) FROM fx_totals b WHERE b.tot >= a.tot) AS y FROM (SELECT DISTINCT tot FROM fx_totals) a",
         lambda fx: S.survivors(fx.fx_totals))


@register("f2_survivors", "SELECT x, y FROM fx_curve")
def f2(fx):
    return fx.fx_curve


def _knee_sql(frac: float) -> str:
    def slope(src, y, out):
        return f"""SELECT *, coalesce((({y} - lag({y}) OVER o) / (x - lag(x) OVER o) + (lead({y}) OVER o - {y}) / (lead(x) OVER o - x)) / 2,
                 ({y} - lag({y}) OVER o) / (x - lag(x) OVER o), (lead({y}) OVER o - {y}) / (lead(x) OVER o - x)) AS {out} FROM {src} WINDOW o AS (ORDER BY x)"""
    def smooth(src, y):
        return f"SELECT * EXCLUDE ({y}), avg({y}) OVER (ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {y} FROM {src}"
    return f"""
    WITH a1 AS ({slope('fx_curve', 'y', 'd1')}), a2 AS ({smooth('a1', 'd1')}), a3 AS ({slope('a2', 'd1', 'd2')}), a4 AS ({smooth('a3', 'd2')}),
    a5 AS (SELECT x, y, abs(d2) / pow(1 + d1 * d1, 1.5) AS curv FROM a4), a6 AS ({smooth('a5', 'curv')})
    SELECT x, {rq('curv', 8)} AS curv FROM a6 WHERE y >= {frac} * (SELECT max(y) FROM a6) ORDER BY round(a6.curv, 12) DESC, x LIMIT 1"""


@register("f3_knee", _knee_sql(0.1))
def f3(fx):
    return S.knee(fx.fx_curve, 0.1).select("x", r("curv", 8).alias("curv"))


RATE, TOL = 0.1, 1e-6


def _start_sql() -> str:
    """Counts x, start parameters p0(a, species, p) and components w0(a, b, w); the species come from the counts."""
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT c.barcode, c.species, c.cnt, t.tot FROM fx_species_counts c JOIN fx_totals t USING (barcode)),
    sp AS MATERIALIZED (SELECT species, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT DISTINCT species FROM fx_species_counts) d),
    p0 AS MATERIALIZED (SELECT s.species AS a, t.species, CASE WHEN s.species = t.species THEN {S.TARGET} ELSE {1 - S.TARGET!r} / (s.n - 1) END::DOUBLE AS p FROM sp s, sp t),
    w0 AS MATERIALIZED (SELECT s.species AS a, t.species AS b, CASE WHEN s.species = t.species THEN {1 - RATE!r} / s.n ELSE {RATE} / (s.n * (s.n - 1) / 2) END::DOUBLE AS w
      FROM sp s JOIN sp t ON s.species <= t.species)"""


def _model_sql() -> str:
    """The mixture passes as a recursion over (a, b, species, w, q), q being the component's share of the species; p holds the settled singlets."""
    return _start_sql() + f""",
    it AS (SELECT 0 AS k, w.a, w.b, p.species, w.w, (p.p + o.p) / 2 AS q, 1.0::DOUBLE AS moved FROM w0 w JOIN p0 p ON p.a = w.a JOIN p0 o ON o.a = w.b AND o.species = p.species
      UNION ALL (WITH now AS MATERIALIZED (SELECT * FROM it WHERE moved >= {TOL}),
      l AS (SELECT x.barcode, max(tot) AS tot, now.a, now.b, log2(greatest(max(w), 1e-300)) + sum(cnt * log2(greatest(q, 1e-12))) AS s FROM x JOIN now ON now.species = x.species GROUP BY x.barcode, now.a, now.b),
      e AS (SELECT *, pow(2, s - max(s) OVER (PARTITION BY barcode)) AS e FROM l),
      r AS MATERIALIZED (SELECT barcode, a, b, e / sum(e) OVER (PARTITION BY barcode) * tot AS r FROM e),
      w AS (SELECT a, b, sum(r) / (SELECT sum(r) FROM r) AS w FROM r GROUP BY a, b),
      n AS (SELECT r.a, x.species, sum(r * cnt) AS v FROM r JOIN x ON x.barcode = r.barcode WHERE r.a = r.b GROUP BY r.a, x.species),
      p AS MATERIALIZED (SELECT o.k, o.a, o.species, coalesce(v, 0) / sum(v) OVER (PARTITION BY o.a) AS p, o.q AS before FROM now o LEFT JOIN n ON n.a = o.a AND n.species = o.species WHERE o.a = o.b)
      SELECT p.k + 1, w.a, w.b, p.species, w.w, (p.p + o.p) / 2, (SELECT max(abs(p - before)) FROM p) FROM w JOIN p ON p.a = w.a JOIN p o ON o.a = w.b AND o.species = p.species)),
    p AS MATERIALIZED (SELECT a, species, q AS p FROM it WHERE a = b AND k = (SELECT max(k) FROM it))"""


def _species(fx) -> list[str]:
    from poolcall.session import collect_bounded
    return sorted(x.species for x in collect_bounded(fx.fx_species_counts.select("species").distinct(), 64))


def _model(fx):
    langs = _species(fx)
    cells = cut(S.wide_cells(fx.fx_species_counts, langs))
    p, w = S.fit_species(cells, len(langs), RATE, tol=TOL)
    return langs, cells, p, w


@register("i12_species_mixture", _model_sql() + f"\nSELECT a, species, {rq('p')} AS p FROM p")
def i12(fx):
    from poolcall.session import local_table
    langs, _, p, _ = _model(fx)
    t = local_table(fx.spark, [(a, s, v) for a, row in zip(langs, p) for s, v in zip(langs, row)], "a STRING, species STRING, p DOUBLE")
    return t.select("a", "species", r("p").alias("p"))


RANKED = _model_sql() + f"""
    , q AS (SELECT w.a, w.b, p.species, (p.p + o.p) / 2 AS p FROM w0 w JOIN p ON p.a = w.a JOIN p o ON o.a = w.b AND o.species = p.species),
    l AS (SELECT x.barcode, q.a, q.b, round(CASE WHEN q.a = q.b THEN {math.log2(1 - RATE)!r} ELSE {math.log2(RATE)!r} END + sum(cnt * log2(greatest(q.p, 1e-12))), 6) AS s
          FROM x JOIN q ON q.species = x.species GROUP BY x.barcode, q.a, q.b),
    n AS (SELECT *, CASE WHEN a = b THEN a ELSE a || '+' || b END AS id, CASE WHEN a = b THEN 'S' ELSE 'D' END AS type FROM l),
    t AS (SELECT *, lead(s) OVER o AS s2, lead(id) OVER o AS second, row_number() OVER o AS n FROM n WINDOW o AS (PARTITION BY barcode ORDER BY s DESC, a <> b, a, b))"""


@register("i13_species_calls", RANKED + f"""
    SELECT barcode, id, type, {rq('s - s2', 6)} AS llr FROM t WHERE n = 1 AND round(s - s2, 6) > 0""")
def i13(fx):
    langs, cells, p, _ = _model(fx)
    return S.call_species(cells, p, RATE, langs).select("barcode", "id", "type", r("llr", 6).alias("llr"))


@register("f8_best_two_fitted", RANKED + f"""
    SELECT barcode, id, type, second, {rq('s - s2', 6)} AS llr FROM t WHERE n = 1""")
def f8_fitted(fx):
    """Best two of the settled components, doublets included, for every cell."""
    langs, cells, p, _ = _model(fx)
    return S.best_components(cells, p, RATE, langs).select("barcode", "id", "type", "second", r("llr", 6).alias("llr"))


@register("f8_best_two", _start_sql() + f"""
    , l AS (SELECT x.barcode, p.a, round(sum(cnt * log2(p)), 6) AS s FROM x JOIN p0 p ON p.species = x.species GROUP BY x.barcode, p.a)
    SELECT barcode, arg_max(a, (s, a)) AS id, {rq('max(s) - max(s2)', 6)} AS llr FROM (
      SELECT *, lead(s) OVER (PARTITION BY barcode ORDER BY s DESC, a DESC) AS s2 FROM l) q GROUP BY barcode""")
def f8(fx):
    from poolcall.session import local_table
    langs = _species(fx)
    p, _ = S.start_model(len(langs), RATE)
    t = local_table(fx.spark, [(a, s, v) for a, row in zip(langs, p) for s, v in zip(langs, row)], "a STRING, species STRING, p DOUBLE")
    ll = fx.fx_species_counts.join(F.broadcast(t), "species").groupBy("barcode", "a").agg(F.round(F.sum(F.col("cnt") * F.log2("p")), 6).alias("s"))
    g = ll.groupBy("barcode").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "a")), False), 1, 2).alias("t"))  # one entry per species
    return g.select("barcode", F.col("t")[0]["a"].alias("id"), r(F.col("t")[0]["s"] - F.col("t")[1]["s"], 6).alias("llr"))


add_view("fx_depth_llr", """
    SELECT o_orderkey AS barcode, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_custkey % 4 ELSE 200 + o_custkey % 150 END AS BIGINT) AS tot,
           CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.5 + (o_custkey % 7) / 10.0 ELSE 20 + (o_custkey % 90) END AS DOUBLE) AS llr FROM orders""")


PARAMS = [f"{x}{c}" for c in (0, 1) for x in "wmab"]


def _filter_sql() -> str:
    l = [f"ln(w{c}) - m{c} + a{c} * ln(b{c}) - lgamma(a{c}) + tot * ln(m{c}) + (a{c} - 1) * ln(llr) - b{c} * llr" for c in (0, 1)]
    old = ", ".join(PARAMS)
    sums = ", ".join(f"sum({v}) AS r{c}, sum({v} * tot) AS t{c}, sum({v} * llr) AS x{c}, sum({v} * llr * llr) AS q{c}" for c, v in ((0, "(1 - r)"), (1, "r")))
    var = "(q{0} / r{0} - (x{0} / r{0}) * (x{0} / r{0}))"
    new = ", ".join(f"r{c} / n AS nw{c}, t{c} / r{c} AS nm{c}, (x{c} / r{c}) * (x{c} / r{c}) / {var.format(c)} AS na{c}, (x{c} / r{c}) / {var.format(c)} AS nb{c}" for c in (0, 1))
    moved = " OR ".join(f"abs(n{p} - {p}) > 1e-6 * (1 + abs({p}))" for p in PARAMS)
    return f"""WITH RECURSIVE it AS (SELECT 0 AS k, 0.5::DOUBLE AS w0, 1.0::DOUBLE AS m0, 1.0::DOUBLE AS a0, 1.0::DOUBLE AS b0, 0.5::DOUBLE AS w1, 1000.0::DOUBLE AS m1, 100.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, TRUE AS moved
      UNION ALL SELECT k + 1, {", ".join("n" + p for p in PARAMS)}, {moved} FROM (SELECT k, {old}, {new} FROM (
        SELECT k, {old}, count(*) AS n, {sums} FROM (SELECT *, 1 / (1 + exp(({l[0]}) - ({l[1]}))) AS r FROM fx_depth_llr, it WHERE moved) z1 GROUP BY k, {old}) z2) z3),
    s AS MATERIALIZED (SELECT * FROM it WHERE k = (SELECT max(k) FROM it))
    SELECT barcode, tot FROM fx_depth_llr, s WHERE {l[1]} > {l[0]}"""


@register("i14_real_cells", _filter_sql())
def i14(fx):
    return S.real_cells(cut(fx.fx_depth_llr))[0].select("barcode", "tot")


add_view("fx_mates", """
    SELECT read_id, barcode, corrected, mate, concat('ACGT', mate) AS seq, 'FFFFF' AS qual FROM fx_corrected,
    (SELECT 'R1' AS mate UNION ALL SELECT 'R2') m""",
         lambda fx: fx.fx_corrected.select("read_id", "barcode", "corrected", F.explode(F.array(F.lit("R1"), F.lit("R2"))).alias("mate")).select(
             "read_id", "barcode", "corrected", "mate", F.concat(F.lit("ACGT"), "mate").alias("seq"), F.lit("FFFFF").alias("qual")))
CELL_SPECIES = "SELECT barcode, CASE cell % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'de+en' END AS id, CASE WHEN cell % 4 = 3 THEN 'D' ELSE 'S' END AS type FROM fx_allow"


@register("b9_route_reads", f"""
    SELECT id AS species, 'rna' AS kind, mate, count(*) AS reads, count(DISTINCT corrected) AS cells FROM fx_mates m
    JOIN ({CELL_SPECIES}) c ON c.barcode = m.corrected WHERE type = 'S' GROUP BY id, mate""")
def b9(fx):
    path = fresh_path(fx.spark, "routed")
    sinks.route_reads(fx.fx_mates, fx.sql(CELL_SPECIES), path)
    return fx.spark.read.parquet(path).groupBy("species", "kind", "mate").agg(
        F.count(F.lit(1)).alias("reads"), F.countDistinct("barcode").alias("cells"))


@register("b10_preprocess_triplets", """
    SELECT concat(CAST(read_id AS VARCHAR), ' CB:Z:', corrected) AS name, mate, seq, qual FROM fx_mates""")
def b10(fx):
    return sinks.preprocess_triplets(fx.fx_mates)


@register("d14_convert_barcodes", """
    SELECT a.barcode, concat('X', a.barcode) AS converted FROM fx_allow a""")
def d14(fx):
    """Two written lists whose lines correspond."""
    pa, pb = fresh_path(fx.spark, "list"), fresh_path(fx.spark, "list")
    both = cut(fx.fx_allow.select("barcode").coalesce(1))  # one file fixes the order both lists are written in
    both.select("barcode").coalesce(1).write.text(pa)
    both.select(F.concat(F.lit("X"), "barcode")).coalesce(1).write.text(pb)
    return readers.paired_lists(fx.spark, pa, pb)
