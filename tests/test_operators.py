"""Operators against plain Python on small fixtures, hot keys included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poolcall import scaling as S
from poolcall.functions import cdf, expr
from poolcall.operators import contam, homology, joins, labels, likelihood as L, mito, pool, sites, species, tags


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(3)
    return spark.createDataFrame([(i, 7 if i % 3 == 0 else rng.randrange(50), rng.randrange(1000)) for i in range(3000)], "id INT, k INT, v INT")


def test_salted_join_equals_join(spark, skewed):
    small = spark.createDataFrame([(k, k * 10) for k in range(40)], "k INT, w INT")
    for how in ("inner", "left"):
        got = S.salted_join(skewed, small, ["k"], ["id"], how, floor=10).select("id", "k", "w")
        assert sorted(map(str, got.collect())) == sorted(map(str, skewed.join(small, "k", how).select("id", "k", "w").collect()))
    assert S.hot_keys(skewed, ["k"], floor=500)[0].k == 7


def test_running_totals(skewed):
    data = sorted((r.v, r.id) for r in skewed.collect())
    want, t = {}, 0
    for v, i in data:
        t += v
        want[i] = t
    got = S.running_totals(skewed, [F.col("v"), F.col("id")], {"run": F.col("v")})
    assert {r.id: r.run for r in got.collect()} == want


def test_rank_in_groups_with_a_hot_group(skewed):
    want = {}
    for k in {r.k for r in skewed.collect()}:
        for n, (v, i) in enumerate(sorted((r.v, r.id) for r in skewed.collect() if r.k == k), 1):
            want[i] = n
    got = S.rank_in_groups(skewed, ["k"], [F.col("v"), F.col("id")])
    assert {r.id: r.rank_ for r in got.collect()} == want


def test_grouped_totals(skewed):
    acc, want = {}, {}
    for k, v, i in sorted((r.k, r.v, r.id) for r in skewed.collect()):
        acc[k] = acc.get(k, 0) + v
        want[i] = acc[k]
    got = S.grouped_totals(skewed, ["k"], [F.col("v"), F.col("id")], {"run": F.col("v")})
    assert {r.id: r.run for r in got.collect()} == want


def test_range_join_equals_nested_loop(spark):
    rng = random.Random(1)
    reads = [(i, "c%d" % rng.randrange(2), p, p + rng.choice([10, 60, 5000])) for i, p in enumerate(rng.randrange(4000) for _ in range(300))]
    st = [(i, "c%d" % rng.randrange(2), rng.randrange(8000)) for i in range(200)]
    want = sorted((r[0], s[0]) for r in reads for s in st if r[1] == s[1] and r[2] <= s[2] <= r[3])
    a, b = spark.createDataFrame(reads, "read_id INT, chrom STRING, rstart INT, rend INT"), spark.createDataFrame(st, "site_id INT, chrom STRING, pos INT")
    assert rows(joins.range_join(a, b).select("read_id", "site_id")) == want
    assert rows(joins.range_join(a, b, salt_by=["read_id"]).select("read_id", "site_id")) == want


def test_barcode_correction_rules(spark):
    allow = spark.createDataFrame([("AAAA",), ("AAAT",), ("GGGG",)], "barcode STRING")
    reads = spark.createDataFrame([("AAAA",), ("AAAC",), ("GGGA",), ("TTTT",)], "barcode STRING")
    got = {r.barcode: (r.corrected, r.mismatches) for r in joins.match_allow_list(reads, allow).collect()}
    assert got == {"AAAA": ("AAAA", 0), "GGGA": ("GGGG", 1)}  # AAAC is one away from two entries


def brute_elimination(cmp):
    """The knock-out walk, written plainly."""
    gone, ids = set(), {x for c in cmp for x in c[:2]}
    for a, b, v in sorted(cmp, key=lambda c: (-abs(c[2]), c[0], c[1])):
        if a in gone or b in gone:
            continue
        win, lose = (a, b) if v > 0 else (b, a)
        if len(ids) - len(gone) == 2:
            return win, abs(v)
        gone.add(lose)
    return None


def test_elimination_against_plain_walk(spark):
    rng = random.Random(5)
    cells = {c: [(i, j, round(rng.uniform(-50, 50), 3)) for i in range(6) for j in range(i + 1, 6)] for c in range(20)}
    t = spark.createDataFrame([(c, 6, [(-abs(v), i, j, v) for i, j, v in x]) for c, x in cells.items()],
                              "barcode INT, n_ids INT, llrs ARRAY<STRUCT<key: DOUBLE, id1: INT, id2: INT, llr: DOUBLE>>")
    got = {r.barcode: (r.i, round(r.llr, 3)) for r in L.eliminate(t).collect()}
    assert got == {c: brute_elimination(x) for c, x in cells.items()}


def make_pairs(truth, n=400, missing=0.0, seed=2, members=4):
    """Pair-class counts of simulated cells."""
    rng = random.Random(seed)
    out = {}
    for c, (a, b) in truth.items():
        for _ in range(n):
            g = {m: rng.choice([0, 1, 2]) for m in range(members) if rng.random() >= missing}
            p = (rng.choice([0, 1, 2]) if a not in g else g[a]) / 4 + (rng.choice([0, 1, 2]) if b not in g else g[b]) / 4
            alt = int(rng.random() < 0.01 + 0.98 * p)
            for i in g:
                k = (c, i, g[i], -1, -1)
                out.setdefault(k, [0, 0])[alt] += 1000000
                for j in g:
                    if j > i:
                        out.setdefault((c, i, g[i], j, g[j]), [0, 0])[alt] += 1000000
    return [(*k, *v) for k, v in out.items()]


PAIRS = "barcode INT, i INT, ni INT, j INT, nj INT, ref_w BIGINT, alt_w BIGINT"


@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_planted_identities_are_found(spark, missing):
    truth = {0: (0, 0), 1: (3, 3), 2: (0, 2), 3: (1, 3)}
    pc = spark.createDataFrame(make_pairs(truth, missing=missing), PAIRS)
    got = {r.barcode: (r.i, r.j) for r in L.call_cells(pc, 0.01, 0.01).collect()}
    assert got == truth
    maxmin = L.max_min(L.margins(L.identity_table(L.cell_pairs(L.pair_llr(pc, 0.01, 0.01)))))
    assert {r.barcode: (r.i, r.j) for r in maxmin.collect()} == truth


def pruned_by_walk(truth_rows, called, keep):
    """Survivors of the knock-out walk over all pairs of members; (site, ref, alt) counts and a member's dosage by site."""
    def p(n):
        return n / 2 - n / 2 * 0.001 + (1 - n / 2) * 0.001
    cls, members = {}, sorted({m for s, *_ in truth_rows for m in called[s]})
    for s, ref, alt in truth_rows:
        g = sorted(called[s].items())
        for x, (i, ni) in enumerate(g):
            for j, nj in g[x + 1:]:
                if ni != nj:
                    c = cls.setdefault((i, j), {}).setdefault((ni, nj), [0, 0])
                    c[0] += ref
                    c[1] += alt
    llr = {k: sum(round(a / 1e6) * math.log2(p(ni) / p(nj)) + round(r_ / 1e6) * math.log2((1 - p(ni)) / (1 - p(nj)))
                  for (ni, nj), (r_, a) in v.items()) for k, v in cls.items()}
    alive = {m for k in llr for m in k}
    for (i, j), v in sorted(llr.items(), key=lambda x: (-abs(round(x[1], 6)), x[0])):
        if i in alive and j in alive and len(alive) > keep:
            alive.discard(j if round(v, 6) > 0 else i)
    return alive


@pytest.mark.parametrize("members, missing", [(300, 0.0), (12, 0.0), (12, 0.1)])
def test_pruning_before_pairs_equals_the_walk_over_all_pairs(spark, members, missing):
    rng = random.Random(members)
    n_sites, cells = 80, 4
    called = {s: {m: rng.choice([0, 0, 1, 2]) for m in range(members) if rng.random() >= missing} for s in range(n_sites)}
    counts = []
    for c in range(cells):
        for s in range(n_sites):
            for _ in range(rng.randrange(3)):
                g = called[s].get(c * 2, 0) / 2
                alt = int(rng.random() < 0.02 + 0.96 * g)
                w = rng.choice([999999, 999000, 990000])
                counts.append((c, s, w * (1 - alt), w * alt))
    cs = (spark.createDataFrame(counts, "barcode INT, site_id INT, ref_w BIGINT, alt_w BIGINT")
          .groupBy("barcode", "site_id").agg(F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w")))
    gt = spark.createDataFrame([(s, m, n) for s, x in called.items() for m, n in x.items()], "site_id INT, sample INT, nalt INT")
    got = {x.barcode: set(x.members) for x in L.pruned_cells(cs, gt, keep=5).select("barcode", "members").collect()}
    want = {c: pruned_by_walk([(s, r_, a) for b, s, r_, a in counts if b == c], called, 5) for c in range(cells)}
    assert got == want
    if members == 300:
        from poolcall.operators.counts import pattern_ids
        ids, pats = pattern_ids(gt)
        rows_ = cs.join(ids, "site_id").join(pats.withColumn("complete", F.lit(True)), "pattern_id")
        left = [len(x.members) for x in L.candidate_members(rows_, 5).collect()]
        assert max(left) < 150  # most members go without a pair being counted


def test_additive_path_agrees_without_missing_calls(spark):
    pc = spark.createDataFrame(make_pairs({0: (0, 0), 1: (1, 2)}), PAIRS)
    full = {r.barcode: r.llr for r in L.call_cells(pc, 0.01, 0.01).collect()}
    fast = {r.barcode: r.llr for r in L.best_two(L.additive_scores(pc, 0.01, 0.01)).collect()}
    assert all(abs(full[c] - fast[c]) < 1e-3 * abs(full[c]) for c in full)


def test_cdfs():
    assert abs(float(cdf.normal_p(1.96, 0, 1)) - 0.9750021) < 1e-6
    assert abs(float(cdf.poisson_p(3, 2.5)) - sum(math.exp(-2.5) * 2.5 ** k / math.factorial(k) for k in range(4))) < 1e-12
    for k in range(11):
        assert abs(float(cdf.binomial_p(k, 10, 0.3)) - sum(math.comb(10, x) * 0.3 ** x * 0.7 ** (10 - x) for x in range(k + 1))) < 1e-12


def test_sampling_exponent_hits_target(spark):
    c = spark.createDataFrame([("p%d" % i, n) for i, n in enumerate([5000, 3000, 800, 90, 40, 7, 3, 1, 1])], "pattern STRING, cnt BIGINT")
    x, cutoff = sites.sampling_exponent(c, 1000)
    kept = sum(n ** x if n >= cutoff else n for n in [5000, 3000, 800, 90, 40, 7, 3, 1, 1])
    assert 0 < x < 1 and abs(kept - 1000) < 1


@pytest.mark.parametrize("members, width", [(5, 6), (14, 6), (9, 2), (1, 6)])
def test_compatible_patterns_against_all_pairs(spark, members, width):
    rng = random.Random(members * 10 + width)
    full = {"".join(rng.choice("001") for _ in range(members)): rng.randrange(1, 9) for _ in range(40)}
    holes = {"".join(c if rng.random() < 0.6 else "-" for c in rng.choice(sorted(full))) for _ in range(60)} | {"-" * members}
    holes = {h: rng.randrange(1, 9) for h in holes if "-" in h}
    t = spark.createDataFrame([(p, True, n) for p, n in full.items()] + [(p, False, n) for p, n in holes.items()],
                              "pattern STRING, called BOOLEAN, cnt BIGINT")

    def fits(h, f):
        turned = f.translate(str.maketrans("01", "10"))
        return any(all(a in ("-", b) for a, b in zip(h, g)) for g in (f, turned))

    pairs = {(h, f) for h in holes for f in full if fits(h, f)}
    want = sorted((h, f, full[f], round(full[f] / sum(full[g] for k, g in pairs if k == h), 9)) for h, f in pairs)
    got = sites.compatible_patterns(t, members, width).select("partial", "full", "full_cnt", F.round("share", 9))
    assert rows(got) == want


def test_greedy_matching_equals_sorted_walk(spark):
    rng = random.Random(9)
    e = [("a%d" % i, "b%d" % j, rng.randrange(100)) for i in range(25) for j in range(25) if rng.random() < 0.5]
    used, want = set(), []
    for a, b, s in sorted(e, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    assert rows(homology.greedy_match(spark.createDataFrame(e, "src STRING, dst STRING, score INT"))) == sorted(want)


def test_ambient_removal_takes_the_exact_total(spark):
    rng = random.Random(4)
    c = [(b, g, rng.randrange(1, 60), 0.3) for b in range(4) for g in range(30)]
    amb = [(g, 1 / 30 * (2 if g < 10 else 0.5)) for g in range(30)]
    out = contam.remove_ambient(spark.createDataFrame(c, "barcode INT, gene INT, cnt BIGINT, c DOUBLE"), spark.createDataFrame(amb, "gene INT, a DOUBLE"))
    for r in out.groupBy("barcode").agg(F.sum("cnt").alias("t"), F.sum("remaining").alias("l"), F.min("remaining").alias("m")).collect():
        assert abs((r.t - r.l) - 0.3 * r.t) < 1e-6 and r.m >= 0


def test_skipped_genes_keep_their_counts(spark):
    """They count in the cell's total, which is taken out of the other genes."""
    c = spark.createDataFrame([(1, 1, 50, 0.2), (1, 2, 30, 0.2), (1, 3, 20, 0.2), (2, 3, 7, 0.5)], "barcode INT, gene INT, cnt BIGINT, c DOUBLE")
    amb = spark.createDataFrame([(1, 0.25), (2, 0.25)], "gene INT, a DOUBLE")  # fitted without gene 3
    got = {(r.barcode, r.gene): r.remaining for r in contam.remove_ambient(c, amb, spark.createDataFrame([(3,), (3,)], "gene INT")).collect()}
    assert got == {(1, 1): 40.0, (1, 2): 20.0, (1, 3): 20.0, (2, 3): 7.0}


def test_settled_shares_are_the_most_likely_ones(spark):
    """Two keys with different optima, one of them on the edge: no share vector near or far is more likely."""
    rng = random.Random(8)
    d = [(b, n, k, rng.choice([0.01, 0.5, 0.99]), [rng.choice([0.01, 0.5, 0.99]) for _ in range(3)]) for b in (1, 2) for n, k in [(100.0, float(rng.randrange(40, 60)))] * 25]
    rows = spark.createDataFrame(d, "b INT, n DOUBLE, k DOUBLE, pe DOUBLE, fr ARRAY<DOUBLE>")
    for c in (1.0, 0.3):
        def ll(b, s, c=c):
            ps = [(k, n, (1 - c) * pe + c * sum(f * x for f, x in zip(fr, s))) for key, n, k, pe, fr in d if key == b]
            return sum(k * math.log(p) + (n - k) * math.log(1 - p) for k, n, p in ps)
        got = contam.settle_shares(rows, {1: [1 / 3] * 3, 2: [0.9, 0.05, 0.05]}, c)
        for b, s in got.items():
            assert abs(sum(s) - 1) < 1e-9
            grid = [[x / 40, y / 40, 1 - (x + y) / 40] for x in range(41) for y in range(41 - x)]
            assert ll(b, s) >= max(ll(b, [max(v, 1e-12) for v in g]) for g in grid) - 1e-6


def test_a_round_that_lowers_the_likelihood_is_not_accepted():
    state = lambda ll: contam.Contamination(f"calls {ll}", None, None, ll)
    def run(*lls):
        seen = []
        return contam.best_round((seen.append(x) or state(x) for x in lls)).loglik, seen
    assert run(-50.0, -40.0, -45.0, -10.0) == (-40.0, [-50.0, -40.0, -45.0])
    assert run(-50.0, -40.0, -39.95, -10.0) == (-39.95, [-50.0, -40.0, -39.95])
    assert run(-50.0) == (-50.0, [-50.0])


def test_shares_likelihood_never_falls(spark):
    rng = random.Random(8)
    d = [(float(n), float(rng.randrange(n + 1)), 0.0, [rng.choice([0.01, 0.5, 0.99]) for _ in range(3)]) for n in (rng.randrange(5, 50) for _ in range(60))]
    df = spark.createDataFrame(d, "n DOUBLE, k DOUBLE, pe DOUBLE, fr ARRAY<DOUBLE>")
    def ll(s):
        ps = [sum(f * x for f, x in zip(fr, s)) for _, _, _, fr in d]
        return sum(k * math.log(p) + (n - k) * math.log(1 - p) for (n, k, _, _), p in zip(d, ps))
    s = [1 / 3] * 3
    for _ in range(4):
        new = contam.share_step(df, s, 1.0)
        assert abs(sum(new) - 1) < 1e-9 and ll(new) >= ll(s) - 1e-9
        s = new


def test_doublet_rate_recovers_truth():
    s, d, n = {"A": 0.5, "B": 0.3, "C": 0.2}, 0.15, 100000
    counts = [("x", a, n * ((1 - d) * p + d * p * p)) for a, p in s.items()]
    counts += [("x", f"{a}+{b}", n * 2 * d * s[a] * s[b]) for a in s for b in s if a < b]
    rate, shares, _ = pool.fit_doublets(counts, [0.05, 0.5], passes=2000, tol=1e-14)
    assert abs(rate - d) < 1e-3 and all(abs(shares["x"][m] - p) < 1e-3 for m, p in s.items())


def test_top_kmers_keeps_all_above_the_cut(spark):
    d = [("s", "k%d" % i, c) for i, c in enumerate([9] * 5 + [5] * 200 + [1] * 50)]
    got = species.top_kmers(spark.createDataFrame(d, "species STRING, kmer STRING, cnt BIGINT"), 100).collect()
    assert sum(r.cnt == 9 for r in got) == 5 and all(r.cnt >= 5 for r in got) and 60 < len(got) < 140


def test_mates_meet_by_chunk_and_record(spark):
    from poolcall.sources.readers import pair_mates
    def reads(*rows):
        return spark.createDataFrame([(c, n, x, x.upper(), "F") for c, n, x in rows], "chunk STRING, record INT, read_id STRING, seq STRING, qual STRING")
    one = reads(("a1", 0, "x"), ("a1", 1, "y"), ("a2", 0, "z"))
    two = reads(("b1", 0, "x"), ("b1", 1, "y"), ("b2", 0, "z"))
    swapped = reads(("c2", 0, "x"), ("c2", 1, "y"), ("c1", 0, "z"))
    assert sorted(tuple(r) for r in pair_mates(one, two).collect()) == [(x, x.upper(), "F", x.upper(), "F") for x in "xyz"]
    assert pair_mates(one, two, swapped, files=[("a1", "b1", "c2"), ("a2", "b2", "c1")]).count() == 3
    for bad in (reads(("b1", 0, "x"), ("b1", 1, "w"), ("b2", 0, "z")), reads(("b1", 0, "x"), ("b2", 0, "z")), reads(("b1", 0, "x"), ("b1", 1, "y"))):
        with pytest.raises(Exception, match="out of order"):
            pair_mates(one, bad).collect()
    with pytest.raises(Exception, match="no mates are listed"):
        pair_mates(one, two, files=[("a1", "b1")]).collect()


def test_repeated_tag_columns_are_an_error(spark, tmp_path):
    from poolcall.sources.readers import read_counts_wide
    (tmp_path / "c.tsv").write_text("barcode\tA\tA\nx\t1\t2\n")
    with pytest.raises(ValueError):
        read_counts_wide(spark, str(tmp_path / "c.tsv"))


def test_line_numbers_across_splits(spark, tmp_path):
    from poolcall.sources.readers import text_lines
    for f in ("a", "b"):
        (tmp_path / f).write_text("".join(f"{f}{i}\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000 and all(r.value[1:] == str(r.idx) for r in got)


def test_stream_resumes_without_recounting(spark, tmp_path):
    from poolcall.streaming import tag_counts as T
    src, uniq, ck = str(tmp_path / "in"), str(tmp_path / "uniq"), str(tmp_path / "ck")
    schema = "barcode INT, tag STRING, umi INT"
    for batch in ([(1, "a", 1), (1, "a", 1), (1, "a", 2)], [(1, "a", 1), (1, "a", 3), (2, "b", 1)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        T.dedupe_stream(spark.readStream.schema(schema).parquet(src), uniq, ck).awaitTermination()
    assert rows(spark.read.parquet(uniq).groupBy("barcode", "tag").count()) == [(1, "a", 3), (2, "b", 1)]


def test_stream_forgets_after_its_horizon(spark, tmp_path):
    from poolcall.streaming import tag_counts as T
    src, uniq, ck = str(tmp_path / "in"), str(tmp_path / "uniq"), str(tmp_path / "ck")
    schema = "barcode INT, tag STRING, umi INT, at TIMESTAMP"

    def feed(*batch):
        (spark.createDataFrame(batch, "barcode INT, tag STRING, umi INT, s INT").withColumn("at", F.timestamp_seconds("s")).drop("s")
         .write.mode("append").parquet(src))
        q = T.dedupe_stream(spark.readStream.schema(schema).parquet(src), uniq, ck, "at", "10 seconds")
        q.awaitTermination()
        return T.state_rows(q), T.late_rows(q)

    def found():
        return rows(spark.read.parquet(uniq).groupBy("barcode", "tag", "umi").count())

    sizes = [feed((1, "a", 1, 100), (1, "a", 2, 100), (1, "a", 1, 101))]
    sizes.append(feed((1, "a", 1, 105), (1, "a", 3, 108)))  # a new start of the query: 1 is known from before
    assert found() == [(1, "a", 1, 1), (1, "a", 2, 1), (1, "a", 3, 1)]
    for k in range(4, 12):  # far apart: what came before is forgotten each time
        sizes.append(feed((1, "a", k, 100 * k)))
    assert all(n <= 3 for n, _ in sizes) and sizes[-1][0] <= 2
    assert sum(late for _, late in sizes) == 0
    assert feed((2, "b", 1, 50))[1] == 1 and (2, "b", 1, 1) not in found()  # too late, counted and left out
    assert len(found()) == 11


def test_kmer_filter_keeps_all_that_are_known(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("ACGT") for _ in range(9)) for _ in range(200)})
    km = known * 2 + ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(2000)]
    df, kn = spark.createDataFrame([(x,) for x in km], "kmer STRING"), spark.createDataFrame([(x,) for x in known], "kmer STRING")
    got = [x.kmer for x in species.may_hold(df, kn, 1 << 14).collect()]
    assert sorted(x for x in got if x in set(known)) == sorted(x for x in km if x in set(known))
    assert len(got) < 400 + 2000 * 0.03
    assert [x.kmer for x in species.may_hold(df, kn.limit(0)).collect()] == []
    assert species.may_hold(df, kn, 64).count() >= 400  # nearly every bit set: only the filter is lost


def test_votes_carry_the_barcode(spark):
    rng = random.Random(8)
    uniq = {"ACGTA": "x", "CCCCA": "y", "TTGAC": "y"}
    turn = str.maketrans("ACGT", "TGCA")
    reads = [(i, rng.randrange(3), "A" * 30 if i % 3 == 0 else "".join(rng.choice("ACGT") for _ in range(60))) for i in range(300)]
    want = {}
    for _, b, seq in reads:
        hits = [uniq[m] for m in (min(seq[p:p + 5], seq[p:p + 5][::-1].translate(turn)) for p in range(len(seq) - 4)) if m in uniq]
        if hits:
            want[(b, hits[0])] = want.get((b, hits[0]), 0) + 1
    got = species.species_counts(spark.createDataFrame(reads, "read_id INT, barcode INT, seq STRING"),
                                 spark.createDataFrame(list(uniq.items()), "kmer STRING, species STRING"), 5, use_umis=False)
    assert {(x.barcode, x.species): x.cnt for x in got.collect()} == want and len(want) == 6


def test_axes_put_singlets_first_and_pairs_by_their_members(spark):
    rows_ = [("A", "S", "x", "S")] * 3 + [("B", "S", "y", "S")] * 5 + [("C", "S", "z", "S")] + [("C", "S", "x", "S")] * 4
    rows_ += [("A+B", "D", "x+y", "D"), ("A+C", "D", "y+z", "D"), ("B+C", "D", "x+z", "D"), ("Q+A", "D", "x", "S")]
    m = spark.createDataFrame([(k, *x) for k, x in enumerate(rows_)], "barcode INT, id1 STRING, type1 STRING, id2 STRING, type2 STRING")
    got = {}
    for x in labels.axis_order(m).orderBy("side", "position").collect():
        got.setdefault(x.side, []).append(x.id)
    assert got[1] == ["B", "C", "A", "B+C", "A+B", "A+C"]  # Q has no place, so Q+A has none
    assert got[2][:3] == ["y", "x", "z"] and got[2][3:] == ["x+y", "y+z", "x+z"]


def test_binomial_fold_against_plain_sums(spark):
    rng = random.Random(6)
    cases = [(0, 1, 0.5), (1, 1, 0.5), (0, 40, 0.01), (40, 40, 0.99), (39, 40, 0.3), (3000, 6000, 0.49)]
    cases += [(rng.randrange(n + 1), n, rng.uniform(0.01, 0.99)) for n in (rng.randrange(1, 200) for _ in range(40))]
    df = spark.createDataFrame([(i, float(k), float(n), q) for i, (k, n, q) in enumerate(cases)], "c INT, k DOUBLE, n DOUBLE, q DOUBLE")
    for x in df.withColumn("p", sites.binomial_two_sided("k", "n", "q")).collect():
        k, n, q = cases[x.c]
        low = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log(1 - q))
                        for i in range(k + 1))
        assert abs(x.p - 2 * min(low, 1 - low)) < 1e-8


def test_new_genotypes_of_planted_members(spark):
    geno = {0: 0, 1: 1, 2: 2}
    ident = [(0, 0), (1, 1), (2, 2), (0, 2), (1, 2)]
    rows_ = []
    for i, j in ident:
        a = int(400 * (geno[i] + geno[j]) / 4)
        rows_ += [(i, j, 1, (400 - a) * 1000000, a * 1000000), (i, j, 2, 400000000, 0)]  # nobody differs at site 2
        rows_.append((i, j, 3, *((400000000, 0) if (i, j) == (0, 0) else (240000000, 160000000))))
    got = rows(sites.regenotype(spark.createDataFrame(rows_, "i INT, j INT, site_id INT, ref_w BIGINT, alt_w BIGINT"), 0.01)
               .select("site_id", "sample", "nalt"))
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]  # the reads at site 3 fit no genotypes
    assert sites.regenotype(spark.createDataFrame([], "i INT, j INT, site_id INT, ref_w BIGINT, alt_w BIGINT")).count() == 0


def test_guides_may_have_no_tag(spark):
    fits = spark.createDataFrame([("a", 0.8, 3.0, 5.0, 60.0), ("b", 0.8, 3.0, 5.0, 60.0), ("c", 0.8, 3.0, 5.0, 60.0)], "tag STRING, w DOUBLE, lo DOUBLE, phi DOUBLE, hi DOUBLE")
    c = spark.createDataFrame([(1, "a", 60), (1, "b", 3), (1, "c", 2), (2, "a", 3), (2, "b", 3), (2, "c", 3), (3, "a", 70), (3, "b", 65), (3, "c", 2)], "barcode INT, tag STRING, cnt BIGINT")
    sets = tags.choose_sets(tags.growing_scores(c, fits), None, guides=True)
    got = {r.barcode: r.id for r in tags.label_rows(sets, guides=True).collect()}
    assert got == {1: "a", 2: "WT", 3: "a,b"}


def test_haplotypes_are_discovered(spark):
    """Three planted haplotypes over six sites."""
    haps = {0: [1, 1, 0, 0, 0, 0], 1: [0, 0, 1, 1, 0, 0], 2: [0, 0, 0, 0, 1, 1]}
    d = [(c, s, 12 if haps[c % 3][s] == 0 else 0, 0 if haps[c % 3][s] == 0 else 12) for c in range(90) for s in range(6)]
    hap_sites, calls = mito.discover_and_assign(spark.createDataFrame(d, "barcode INT, pos BIGINT, maj BIGINT, min BIGINT"))
    by = {}
    for r in calls.filter("i = j").collect():
        by.setdefault(r.i, set()).add(r.barcode % 3)
    assert len(by) == 3 and all(len(v) == 1 for v in by.values())


def test_counts_of_other_species_are_not_merged(spark):
    a = spark.createDataFrame([(1, "x", 2), (1, "y", 3)], "barcode INT, species STRING, cnt INT")
    assert sorted(tuple(r) for r in species.merge_species_counts([a, a]).collect()) == [(1, "x", 4), (1, "y", 6)]
    with pytest.raises(ValueError, match="other species"):
        species.merge_species_counts([a, a.filter("species = 'x'")])


def test_fits_raise_when_they_do_not_settle(spark):
    counts = spark.createDataFrame([(b, "t", c) for b, c in enumerate([1, 2, 2, 3, 1, 40, 55, 70, 2, 1])], "barcode INT, tag STRING, cnt LONG")
    with pytest.raises(RuntimeError, match="did not settle"):
        tags.fit_tags(counts, passes=1)
    assert tags.fit_tags(counts).count() == 1
    with pytest.raises(RuntimeError, match="did not settle"):
        pool.fit_doublets([("a", "x", 50), ("a", "y", 30), ("a", "x+y", 20)], [0.2], passes=1)
    rate, _, _ = pool.fit_doublets([("a", "x", 50), ("a", "y", 30), ("a", "x+y", 20)], [0.2])
    assert 0.2 < rate < 1
    with pytest.raises(Exception, match="member numbers"):
        spark.range(1).select(L.id_code(F.lit(L.SPAN), F.lit(0))).collect()


def test_site_groups_do_not_join_through_a_collapsed_site(spark):
    """A~B~C~D in a chain, A not alike to C: B joins A, C stands, D joins C. Some calls are missing; blocks of any width agree."""
    carriers = {10: range(1, 21), 20: range(2, 22), 30: range(4, 24), 40: range(6, 26), 50: range(40, 43), 60: []}
    haps = spark.createDataFrame([(c, p, int(c in has)) for p, has in carriers.items() for c in range(1, 61) if c < 45 or (c + p) % 7], "barcode BIGINT, pos BIGINT, allele INT")
    assert {r.pos: r.grp for r in mito.site_groups(haps).collect()} == {10: 10, 20: 10, 30: 30, 40: 30, 50: 50}
    narrow, wide = (rows(mito.co_occurrence(haps.repartition(3), k)) for k in (2, 256))
    assert narrow == wide
    seen = {(r.barcode, r.pos): r.allele for r in haps.collect()}
    for a, b, sa, sb, both in wide:
        pair = [(seen[c, a], seen[c, b]) for c in range(1, 61) if (c, a) in seen and (c, b) in seen]
        assert (sa, sb, both) == (sum(x for x, _ in pair), sum(y for _, y in pair), sum(x * y for x, y in pair))
    assert mito.site_groups(haps.limit(0)).count() == 0


def test_representatives_against_a_walk(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(1, 61), 2))) for _ in range(90)} | {(k, k + 1) for k in range(60, 90)}
    into, stands = {}, []
    for n in range(1, 91):
        hit = [a for a in stands if (a, n) in edges]
        if hit:
            into[n] = min(hit)
        else:
            stands.append(n)
    assert dict(rows(mito.representatives(spark.createDataFrame(sorted(edges), "ra INT, rb INT")))) == into


def test_sub_clusters_are_merged_and_called_anew(spark):
    """Two root clusters; the first holds two haplotypes that differ at sites 20-29, the second one. Cells 200-209 mix 0_0 with 1."""
    rng = random.Random(12)
    carried = {"a": set(range(0, 10)), "b": set(range(0, 10)) | set(range(20, 30)), "c": set(range(10, 20))}
    kind = {c: "a" if c < 50 else "b" if c < 100 else "c" for c in range(200)}
    data = []
    for c in range(210):
        for p in range(30):
            for _ in range(6):
                k = kind[c] if c < 200 else rng.choice("ac")
                data.append((c, p, p in carried[k]))
    counts = {}
    for c, p, minor in data:
        counts.setdefault((c, p), [0, 0])[minor] += 1
    counts = spark.createDataFrame([(c, p, *n) for (c, p), n in counts.items()], "barcode BIGINT, pos BIGINT, maj BIGINT, min BIGINT")
    root = spark.createDataFrame([(c, int(kind[c] == "c"), int(kind[c] == "c")) for c in range(200)] + [(c, 0, 1) for c in range(200, 210)], "barcode BIGINT, i INT, j INT")
    merged, calls = mito.sub_cluster_and_merge(counts, root, spark.createDataFrame([(0,), (1,)], "parent INT"))
    found = {}
    for r in merged.collect():
        if r.allele == 1:
            found.setdefault(r.cluster, set()).add(r.pos)
    assert found == {"0_0": carried["a"], "0_1": carried["b"], "1": carried["c"]}
    got = {r.barcode: (r.id, r.type) for r in calls.collect()}
    names = {"a": "0_0", "b": "0_1", "c": "1"}
    assert {c: got[c] for c in range(200)} == {c: (names[kind[c]], "S") for c in range(200)}
    assert {got[c] for c in range(200, 210)} == {("0_0+1", "D")}


def test_empty_tables_give_empty_results(spark):
    edges = spark.createDataFrame([("p", "x", "p", "y", 1.0)], "set_a STRING, a STRING, set_b STRING, b STRING, score DOUBLE")
    for e in (edges, edges.limit(0)):  # no edge between two sets, no edge
        got = homology.homology_groups(e)
        assert got.columns == ["grp", "tx"] and got.count() == 0
    some = spark.createDataFrame([(1, "S1", "S", 1.0), (2, "S2", "S", 100.0)], "barcode BIGINT, id STRING, type STRING, llr DOUBLE")
    full, none = labels.cutoff_curves(some), labels.cutoff_curves(some.limit(0))
    assert none.schema == full.schema and none.count() == 0 and full.count() > 0


def test_consensus_of_clusters_with_thousands_of_cells(spark):
    """The products behind log-gamma leave 64 bits from about 235 cells on."""
    cells = spark.range(5000).select(F.col("id").alias("barcode"), (F.col("id") % 2).alias("cluster"))
    haps = cells.filter("barcode % 10 <> 3").select("barcode", F.lit(7).alias("pos"), (F.col("cluster") == 1).cast("int").alias("allele"))
    got = rows(mito.consensus(haps, cells).select("cluster", "pos", "tot", "cells", "allele"))
    assert got == [(0, 7, 2500, 2500, 0), (1, 7, 2000, 2500, 1)]
    big = spark.range(1).select(*[F.round(expr.log_gamma(F.lit(x)), 6).alias(str(x)) for x in (1, 234, 235, 10**5, 10**8)]).first()
    assert list(big) == pytest.approx([math.lgamma(x) for x in (1, 234, 235, 10**5, 10**8)], rel=1e-12, abs=1e-6)


def test_scanned_kmers_equal_those_cut_out_one_by_one(spark, monkeypatch):
    rng = random.Random(12)
    letters = ["ACGT", "ACGTN", "ACGTNacé"]
    seqs = [(i, i % 7, rng.choice(["x", "y", None]), "".join(rng.choice(letters[i % 3]) for _ in range(rng.choice([0, 3, 5, 40, 300])))) for i in range(400)]
    df = spark.createDataFrame([*seqs, (400, 1, "x", None)], "read_id INT, barcode INT, species STRING, seq STRING").repartition(3)
    monkeypatch.setattr(species.kc, "PIECE", 64)  # texts reach over many pieces

    def plain(s, k, canonical):
        return [min(w, w[::-1].translate(species.kc.TURN)) if canonical else w for w in (s[p:p + k] for p in range(len(s) - k + 1)) if "N" not in w]

    for k, canonical in ((5, True), (9, False), (18, True)):
        want = {}
        for _, _, sp, s in seqs:
            for w in plain(s, k, canonical):
                want[(sp, w)] = want.get((sp, w), 0) + 1
        assert {(r.species, r.kmer): r.cnt for r in species.species_kmer_counts(df, k, canonical).collect()} == want
    for k in (5, 11):
        known = {w: rng.choice("xyz") for _, _, _, s in seqs for w in plain(s, k, True) if rng.random() < 0.02}
        want = [(i, b, next(known[w] for w in plain(s, k, True) if w in known)) for i, b, _, s in seqs if any(w in known for w in plain(s, k, True))]
        uniq = spark.createDataFrame(list(known.items()), "kmer STRING, species STRING")
        assert any(set(w) - set("ACGT") for w in known) and len(want) > 50
        got = species.scan_votes(df, uniq, k, ("barcode",)).collect()
        assert sorted((r.read_id, r.barcode, r.species) for r in got) == sorted(want)
        assert sorted((r.read_id, r.species) for r in species.first_hits(df, uniq, k).collect()) == sorted((i, s) for i, _, s in want)
    monkeypatch.setattr(species, "VOTE_TABLE", 3)
    assert species.scan_votes(df, uniq, 11) is None and species.first_hits(df, uniq, 11).count() == len(want)


def test_letters_are_recoded_one_by_one(spark):
    import pyarrow as pa
    texts = ["", "abc", None, "Aé b", "x\U0001f9ecy", "ÿ", "a\nb\x00"]
    table = bytes(c if chr(c) in "abxy" else ord("N") for c in range(128))
    want = [None if t is None else "".join(c if c in "abxy" else "N" for c in t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert species.kc.recoded(column, table, b"N").to_pylist() == want
        assert species.kc.recoded(column[2:5], table, b"N").to_pylist() == want[2:5]


def test_sums_of_read_ids_may_leave_64_bits(spark, tmp_path):
    from poolcall.plans import catalog
    d11 = catalog.queries()["d11_first_hits"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for shift in (0, 9 * 10 ** 12):
        docs.withColumn("doc_id", F.col("doc_id") + shift).write.parquet(f"{tmp_path}/{shift}/documents.parquet")
        found[shift] = d11(spark, f"{tmp_path}/{shift}")
    assert dict(found[0].dtypes)["id_sum"] == "bigint" and dict(found[9 * 10 ** 12].dtypes)["id_sum"].startswith("decimal")
    small, large = ({r.species: (r.reads, int(r.id_sum)) for r in f.collect()} for f in found.values())
    assert small and large == {s: (n, t + n * 9 * 10 ** 18) for s, (n, t) in small.items()}


def test_axes_of_a_matrix_are_written_and_read_in_parts(spark, tmp_path):
    from poolcall.sources import readers, sinks
    cells = [(f"c{i:05d}", f"g{(i * 7 + j) % 3000:05d}", "Gene Expression" if (i * 7 + j) % 2 else "Antibody Capture", 1 + j) for i in range(2000) for j in range(3)]
    mtx = spark.createDataFrame(cells, "barcode STRING, feature STRING, feature_type STRING, cnt BIGINT")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_mex(mtx, f"{tmp_path}/m")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    for axis, n in (("barcodes", 2000), ("features", 3000)):
        sizes = [sum(1 for _ in open(p)) for p in sorted((tmp_path / "m" / axis).glob("part-*"))]
        assert sum(sizes) == n and max(sizes) < n / 2  # before, one task wrote all of it
    assert rows(readers.read_mex(spark, f"{tmp_path}/m")) == sorted(cells)


def test_one_mismatch_may_be_any_letter(spark):
    allow = spark.createDataFrame([("GGNG",), ("TTTTT",), ("",)], "barcode STRING")
    reads = spark.createDataFrame([("GGGG",), ("TTTT",), ("NTTTT",), ("A",)], "barcode STRING")
    assert rows(joins.match_allow_list(reads, allow).select("barcode", "corrected", "mismatches")) == [("GGGG", "GGNG", 1), ("NTTTT", "TTTTT", 1)]


def test_base_texts_are_made_once_a_row(spark):
    """A barcode of n bases is one change of base in Spark, and a filter on it does not make it again."""
    from poolcall.plans import catalog
    from poolcall.plans.fixtures import SPARK_FORMS, Fixtures, acgt
    catalog.queries()
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    for view, col in (("fx_raw_barcodes", "barcode"), ("fx_seq_reads", "seq")):
        d = fx.view(view).filter(f"{col} IS NOT NULL")
        assert d._jdf.queryExecution().executedPlan().toString().count("conv(") == 1
    keys = [0, 1, 3, 4, 977, 4**16 - 1, 4**16 + 5]
    got = fx.spark.createDataFrame([(k,) for k in keys], "k BIGINT").selectExpr(SPARK_FORMS[acgt("k", 16)]).collect()
    assert [x[0] for x in got] == ["".join("ACGT"[k // 4**i % 4] for i in range(15, -1, -1)) for k in keys]



def plain_allocation(ids, tol):
    """Passes over one site's identities, written plainly."""
    f = {m: 0.5 for i, j, _, _ in ids for m in (i, j)}
    while True:
        a, n = dict.fromkeys(f, 0.0), dict.fromkeys(f, 0.0)
        for i, j, ref, alt in ids:
            p, q = f[i], f[j]
            ka, kr = (1.0, 1.0) if i == j else (p / (p + q) if p + q > 0 else 0.5, (1 - p) / (2 - p - q) if p + q < 2 else 0.5)
            for m, x, y in ((i, ka, kr), (j, 1 - ka, 1 - kr)):
                a[m], n[m] = a[m] + alt * x, n[m] + alt * x + ref * y
        new = {m: round(a[m] / n[m], 9) if n[m] > 0 else 0.5 for m in f}
        if max(abs(new[m] - f[m]) for m in f) < tol:
            return new
        f = new


def test_sites_of_a_batch_settle_each_by_itself(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2), (3, 4)]
    given = {s: [(i, j, float(rng.randrange(30)), float(rng.randrange(30) * rng.randrange(2))) for i, j in rng.sample(pairs, rng.randrange(1, 8))] for s in range(200)}
    given[7] = [(0, 0, 0.0, 0.0), (1, 2, 0.0, 5.0)]
    rows_ = [(i, j, s, int(r * 1e6), int(a * 1e6)) for s, ids in given.items() for i, j, r, a in ids]
    df = spark.createDataFrame(rows_, "i INT, j INT, site_id INT, ref_w BIGINT, alt_w BIGINT")
    for size in (500_000, 10):
        monkeypatch.setattr(sites, "IDS_A_STEP", size)
        got = {}
        for x in sites.member_allocation(df).collect():
            got.setdefault(x.site_id, {})[x.sample] = x.rate
        for s, ids in given.items():
            want = plain_allocation(ids, 1e-6)
            assert set(got[s]) == set(want) and all(abs(got[s][m] - want[m]) < 1e-6 for m in want)
    assert "transform(" not in sites.settled_sites(df)._jdf.queryExecution().executedPlan().toString()  # no pass is a column fold
    with pytest.raises(Exception, match="did not settle in 3 passes"):
        sites.settled_sites(df, limit=3).collect()


def test_sketched_counts_of_small_and_large_groups(spark):
    d = spark.range(60_000).selectExpr("IF(id < 50000, 0, id % 500 + 1) AS barcode", "'t' AS tag", "CAST(id % 40000 AS STRING) AS umi")
    d = d.unionByName(spark.createDataFrame([(900, "t", None), (901, "t", ""), (901, "t", "a")], "barcode BIGINT, tag STRING, umi STRING"))
    from poolcall.operators.counts import umi_counts_approx
    g = umi_counts_approx(d)
    got = {x.barcode: x.cnt for x in g.collect()}
    assert abs(got[0] - 40_000) < 0.06 * 40_000 and all(got[k] == 20 for k in range(1, 501)) and got[900] == 0 and got[901] == 2
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "approx_count_distinct" not in plan  # no buffer of all registers for a group of few


def test_base_counts_are_those_of_the_bases(spark, monkeypatch):
    from poolcall.sources import readers as R
    rng = random.Random(9)
    cigars = ["20M", "3S17M", "8M2I10M", "9M5D11M", "6M100N14M", "10M10S"]
    rows_ = [(f"r{k}", rng.choice("ab"), rng.randrange(-40, 200), rng.choice(cigars), "".join(rng.choice("ACGT") for _ in range(20 if k % 9 else 6))) for k in range(300)]
    d = spark.createDataFrame(rows_, "name STRING, chrom STRING, rstart BIGINT, cigar STRING, seq STRING")
    b = R.aligned_bases(d.withColumn("key", F.struct("chrom", "name")), "key")
    want = sorted(map(repr, b.groupBy("key.chrom", "pos", "base").count().collect()))
    got = R.base_counts(d, 16).withColumnRenamed("n", "count")
    assert sorted(map(repr, got.collect())) == want
    monkeypatch.setattr(R, "hot_keys", lambda df, keys: df.distinct().orderBy(*keys).limit(3).collect())
    assert sorted(map(repr, R.base_counts(d, 16).withColumnRenamed("n", "count").collect())) == want


def test_mates_are_moved_once(spark, tmp_path):
    from poolcall.sources import readers as R

    def put(mate, order):
        for c in range(2):
            text = "".join(f"@{n}/{mate} x\n{n}AC\n+\n@{mate}F\n" for n in order[c])
            (tmp_path / f"m{mate}").mkdir(exist_ok=True)
            (tmp_path / f"m{mate}" / f"c{c}.txt").write_text(text)
        return str(tmp_path / f"m{mate}")

    names = [["p", "q", "r"], ["s", "t"]]
    one, two, bad = put(1, names), put(2, names), put(3, [["p", "q", "r"], ["s", "u"]])
    got = R.read_mates(spark, one, two)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(pair") == 1
    assert rows(got) == rows(R.pair_mates(R.read_fastq(spark, one, "R1"), R.read_fastq(spark, two, "R2"))) and got.count() == 5
    assert R.read_mates(spark, one, two, files=[("c0.txt", "c0.txt"), ("c1.txt", "c1.txt")]).count() == 5
    with pytest.raises(Exception, match="no mates are listed"):
        R.read_mates(spark, one, two, files=[("c0.txt", "c0.txt")]).collect()
    with pytest.raises(Exception, match="mates out of order"):
        R.read_mates(spark, one, bad).collect()


def test_expression_passes_are_those_of_plain_sums(spark, monkeypatch):
    rng = random.Random(10)
    x = {(u, g, c): float(rng.randrange(1, 60)) for u in "pq" for g in range(12) for c in (0.02, 0.3, 0.6) if rng.random() < 0.8}
    pairs, genes = sorted({k[:2] for k in x}), sorted({k[1] for k in x})

    def shares(a, e):
        te = {u: sum(v for k, v in e.items() if k[0] == u) for u in "pq"}
        return {g: a[g] / sum(a.values()) for g in genes}, {k: e[k] / te[k[0]] for k in pairs}

    n = {k: sum(v for z, v in x.items() if z[:2] == k) for k in pairs}
    (a, e), last, passes = shares({g: sum(n.get((u, g), 0) for u in "pq") for g in genes}, n), None, 0
    while True:
        p = {k: k[2] * a[k[1]] + (1 - k[2]) * e[k[:2]] for k in x}
        ll = sum(v * math.log(p[k]) for k, v in x.items())
        if last is not None and abs(ll - last) <= 1e-6 * abs(last):
            break
        ga, y = dict.fromkeys(genes, 0.0), dict.fromkeys(pairs, 0.0)
        for k, v in x.items():
            r = k[2] * a[k[1]] / p[k]
            ga[k[1]], y[k[:2]] = ga[k[1]] + v * r, y[k[:2]] + v * (1 - r)
        (a, e), last, passes = shares(ga, y), ll, passes + 1
    assert passes > 4
    df = spark.createDataFrame([(*k, int(v)) for k, v in x.items()], "cluster STRING, gene INT, c DOUBLE, cnt BIGINT")
    for replayed in (1, 3, 1000):
        monkeypatch.setattr(contam, "REPLAYED", replayed)
        got = {(r.cluster, r.gene): (r.a, r.e) for r in contam.fit_expression(df, 1e-6).collect()}
        assert set(got) == set(pairs) and all(abs(got[k][0] - a[k[1]]) < 1e-9 and abs(got[k][1] - e[k]) < 1e-9 for k in pairs)
    assert contam.fit_expression(df.limit(0)).count() == 0
    seen = set()
    monkeypatch.setattr(contam, "_expression_passes", lambda past, want, was=contam._expression_passes: seen.add(len(past)) or was(past, want))
    contam.fit_expression(df, 1e-6)
    assert max(seen) == passes + 1  # no table is written in between


def test_shares_settle_in_few_passes(spark, monkeypatch):
    """At a small rate of contamination passes move shares little; the shares that made the counts are found all the same."""
    import numpy as np
    want, c = np.array([0.5, 0.3, 0.15, 0.05, 0.0]), 0.01
    rng = np.random.default_rng(3)
    f, pe = rng.choice([0.001, 0.4, 0.5, 0.6, 0.99], (60, 5)), rng.choice([0.001, 0.5, 0.999], 60)
    p = (1 - c) * pe + c * (f @ want)
    rows = spark.createDataFrame([(0, 1e6, float(1e6 * p[k]), float(pe[k]), f[k].tolist()) for k in range(60)], "b int, n double, k double, pe double, fr array<double>").cache()
    seen, one = [], contam.share_pass
    monkeypatch.setattr(contam, "share_pass", lambda *a: seen.append(1) or one(*a))
    got = contam.settle_shares(rows, {0: [0.01, 0.01, 0.01, 0.01, 0.96]}, c, limit=60)[0]
    assert np.abs(np.array(got) - want).max() < 1e-3 and len(seen) <= 20
