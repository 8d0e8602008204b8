"""From pair-class counts to a call per cell: pairwise log-likelihood ratios, pruning, elimination.

All ratios are log base 2. A cell's comparisons live in one array column, bounded by the pool size, so after
the per-cell grouping everything is a column expression and nothing is shuffled again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from poolcall.functions.expr import binom_llr2, err_adj, pin
from poolcall.operators.counts import expand_classes, pattern_ids
from poolcall.session import cut

E_REF, E_ALT, DOUBLET_RATE = 0.001, 0.001, 0.5
SPAN = 4096  # pools hold fewer members than this
DIGITS = 6  # ratios are compared at this precision, so equal evidence ties the same way everywhere


def id_code(i, j) -> Column:
    """One integer per identity: singlets first, then pairs i < j in order. A member number beyond the span is an error."""
    return (F.when((i >= SPAN) | (j >= SPAN), F.raise_error(F.lit(f"member numbers must be below {SPAN}")).cast("int"))
            .when(i == j, i).otherwise(SPAN + i * SPAN + j).cast("int"))


def id_pair(code: Column) -> Column:
    k = code - SPAN
    lo = F.when(code < SPAN, code).otherwise(F.floor(k / SPAN)).cast("int")
    hi = F.when(code < SPAN, code).otherwise(k % SPAN).cast("int")
    return F.struct(lo.alias("i"), hi.alias("j"))


def whole(micro) -> Column:
    """Class counts are whole reads when they are scored."""
    return F.round(F.col(micro) / 1000000.0)


def pair_llr(pair_counts: DataFrame, e_ref: float = E_REF, e_alt: float = E_ALT) -> DataFrame:
    """Per (barcode, i, j): i against j (l), i against i+j (si), j against i+j (sj)."""
    c = pair_counts.filter("j >= 0 AND ni <> nj")
    ref, alt = whole("ref_w"), whole("alt_w")
    pi = err_adj(F.col("ni") / 2.0, e_ref, e_alt)
    pj = err_adj(F.col("nj") / 2.0, e_ref, e_alt)
    pk = err_adj((F.col("ni") + F.col("nj")) / 4.0, e_ref, e_alt)
    return c.groupBy("barcode", "i", "j").agg(
        F.sum(binom_llr2(ref, alt, pi, pj)).alias("l"),
        F.sum(binom_llr2(ref, alt, pi, pk)).alias("si"),
        F.sum(binom_llr2(ref, alt, pj, pk)).alias("sj"))


def _comparison(x: Column, y: Column, llr: Column) -> Column:
    llr = F.round(llr, DIGITS) + F.lit(0.0)
    return F.struct((-F.abs(llr)).alias("key"), x.alias("id1"), y.alias("id2"), llr.alias("llr"))


def _fold(table: Column, n: Column, keep: int) -> Column:
    """Walk the comparisons by falling size; each knocks out its loser while more than ``keep`` are left.

    The first comparison between the last two names the winner when ``keep`` is two."""
    start = F.struct(n.cast("int").alias("left"), F.array().cast("array<int>").alias("gone"),
                     F.lit(None).cast("int").alias("win"), F.lit(None).cast("double").alias("llr"))

    def step(s, c):
        win = F.when(c["llr"] > 0, c["id1"]).otherwise(c["id2"])
        lose = F.when(c["llr"] > 0, c["id2"]).otherwise(c["id1"])
        live = ~(F.array_contains(s["gone"], c["id1"]) | F.array_contains(s["gone"], c["id2"]))
        knock = live & (s["left"] > keep)
        last = live & (s["left"] == 2) & s["win"].isNull() & F.lit(keep == 2)
        return F.struct((s["left"] - knock.cast("int")).alias("left"),
                        F.when(knock, F.array_append(s["gone"], lose)).otherwise(s["gone"]).alias("gone"),
                        F.when(last, win).otherwise(s["win"]).alias("win"),
                        F.when(last, F.abs(c["llr"])).otherwise(s["llr"]).alias("llr"))

    return F.aggregate(F.array_sort(table), start, step)


def cell_pairs(pairs: DataFrame, keep: int = 10, members: DataFrame | None = None) -> DataFrame:
    """One row per cell: its pair ratios and the members that survive pruning to ``keep`` singlets.

    ``members`` (barcode, members) names the members to start from; without it they are those of the pairs."""
    g = pairs.groupBy("barcode").agg(F.collect_list(F.struct("i", "j", "l", "si", "sj")).alias("pairs"))
    if members is None:
        g = pin(g, members=F.array_sort(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["i"], p["j"]))))))
    else:
        g = members.join(g, "barcode", "left").withColumn("pairs", F.coalesce("pairs", F.array()))
    singlets = F.transform("pairs", lambda p: _comparison(p["i"], p["j"], p["l"]))
    gone = _fold(singlets, F.size("members"), keep)["gone"]
    return pin(g, members=F.when(F.size("members") > keep, F.array_except("members", gone)).otherwise(F.col("members")))


def candidate_members(patterns: DataFrame, keep: int = 10, e_ref: float = E_REF, e_alt: float = E_ALT) -> DataFrame:
    """(barcode, members): the members that pruning to ``keep`` can leave, from one score per member and no pairs.

    ``patterns`` holds (barcode, ref_w, alt_w, calls, complete) rows whose calls are not all alike. A member's score s
    is its log-likelihood against one half. For a pair l(i,j) = s(i) - s(j), but for two things: class counts are
    rounded to whole reads, and sites at which one of the two is not called do not count. Both are bounded in each cell
    by some e: the rounding by the distance of the summed counts from whole ones, the missing calls by what members
    score at incomplete patterns. A comparison between the best member t and one with s < (s of number keep) - 2e is
    larger than any that knocks out one of the best ``keep``, so it comes before them; hence members below that line
    never survive and never decide between those above it, and the walk over the rest alone ends with the same ones.
    Without missing calls few members are left beside the kept ones; with many, the line may keep all of them."""
    lo, hi = max(e_ref, 1e-8), max(e_alt, 1e-8)
    up_alt, up_ref = math.log2((1 - e_alt) / lo), math.log2((1 - e_ref) / hi)  # largest weight of one read
    ref, alt = F.col("ref_w") / 1000000.0, F.col("alt_w") / 1000000.0
    off = F.abs(ref - F.round(ref)) * up_ref + F.abs(alt - F.round(alt)) * up_alt
    score = binom_llr2(F.col("ref"), F.col("alt"), err_adj(F.col("c.nalt") / 2.0, e_ref, e_alt), F.lit(0.5))
    d = patterns.select("barcode", ref.alias("ref"), alt.alias("alt"), off.alias("off"), "complete", F.posexplode("calls").alias("p", "c"))
    d = d.select("barcode", F.col("c.sample").alias("m"), score.alias("s"), "complete", F.when(F.col("p") == 0, F.col("off")).otherwise(0.0).alias("off"))
    g = d.groupBy("barcode", "m").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("complete"), 0.0).otherwise(F.abs("s"))).alias("x"),
                                      F.sum("off").alias("off"))
    g = g.groupBy("barcode").agg(F.collect_list(F.struct("s", "m")).alias("all"), F.max("x").alias("x"),  # at most the pool
                                 F.sum("off").alias("off"), F.max(F.abs("s")).alias("top"))
    e = F.least("off", F.lit(3 * (up_alt + up_ref))) + 2 * F.col("x") + F.lit(1e-3) + F.col("top") * 1e-9
    nth = F.get(F.sort_array("all", False), F.lit(keep - 1))["s"]
    line = F.when(F.size("all") > keep, nth - 2 * e)
    g = pin(g, line=line)
    return g.select("barcode", F.array_sort(F.transform(F.filter("all", lambda a: F.col("line").isNull() | (a["s"] >= F.col("line"))),
                                                        lambda a: a["m"])).alias("members"))


def pruned_cells(cell_site: DataFrame, genotypes: DataFrame, keep: int = 10, e_ref: float = E_REF, e_alt: float = E_ALT) -> DataFrame:
    """The rows of :func:`cell_pairs` straight from site counts: members first, then pairs among those left.

    Equal to counting all pair classes and pruning then, but a pool of n members costs n scores per (cell, pattern)
    instead of n * n / 2 classes. The counts per (cell, pattern) are written once and read twice."""
    ids, patterns = pattern_ids(genotypes)
    everyone = genotypes.agg(F.count_distinct("sample").alias("n_all"))  # one row
    known = patterns.filter(F.size(F.array_distinct(F.transform("calls", lambda c: c["nalt"]))) > 1)
    known = cut(known.join(F.broadcast(everyone)).select("pattern_id", "calls", (F.size("calls") == F.col("n_all")).alias("complete")))
    counts = cut(cell_site.join(ids, "site_id").groupBy("barcode", "pattern_id")
                 .agg(F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w")))
    rows = counts.join(known, "pattern_id")
    members = cut(candidate_members(rows, keep, e_ref, e_alt))
    own = rows.join(members, "barcode").select("barcode", "ref_w", "alt_w", F.filter(
        "calls", lambda c: F.array_contains("members", c["sample"])).alias("calls"))
    return cell_pairs(pair_llr(expand_classes(own), e_ref, e_alt), keep, members)


def call_from_counts(cell_site: DataFrame, genotypes: DataFrame, e_ref: float = E_REF, e_alt: float = E_ALT,
                     doublet_rate: float = DOUBLET_RATE, keep: int = 10) -> DataFrame:
    """(barcode, i, j, llr) from site counts and genotypes, pruned before pairs are counted."""
    return eliminate(identity_table(pruned_cells(cell_site, genotypes, keep, e_ref, e_alt), doublet_rate))


def identity_table(cells: DataFrame, doublet_rate: float = DOUBLET_RATE, allowed: list[int] | None = None,
                   prior: dict[int, float] | None = None) -> DataFrame:
    """Compare every two identities of each cell.

    With l(p,q) the ratio of two members and s(p,pq) that of a member against a pair holding it, the mean over
    the paths between unrelated identities ab and cd is
    (l(a,c)+l(a,d)+l(b,c)+l(b,d))/4 + (s(c,cd)+s(d,cd)-s(a,ab)-s(b,ab))/2; a singlet is ab with a = b. Where
    a member is shared the comparison is conditional on it. ``allowed`` lists identity codes (bounded by the
    pool), ``prior`` gives log2 weights per identity code."""
    m, prs = F.col("members"), F.col("pairs")
    n = F.size(m)
    pos = F.sequence(F.lit(0), n - 1)
    # dense rows over kept members; STRUCT<l, s> at p * n + q is (p against q, p against p+q)
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("s"))

    def cell(p, q):
        i, j = F.get(m, p), F.get(m, q)
        hit = F.get(F.filter(prs, lambda x: (x["i"] == F.least(i, j)) & (x["j"] == F.greatest(i, j))), F.lit(0))
        return F.when(hit.isNull(), zero).otherwise(F.when(
            i < j, F.struct(hit["l"].alias("l"), hit["si"].alias("s"))).otherwise(
            F.struct((-hit["l"]).alias("l"), hit["sj"].alias("s"))))

    c = pin(cells.filter(n >= 2), dense=F.flatten(F.transform(pos, lambda p: F.transform(pos, lambda q: cell(p, q)))),
            ids=F.concat(
                F.transform(pos, lambda p: F.struct(p.alias("a"), p.alias("b"))),
                F.flatten(F.transform(pos, lambda p: F.transform(F.filter(pos, lambda q: q > p),
                                                                 lambda q: F.struct(p.alias("a"), q.alias("b")))))))
    d = F.col("dense")

    def code(x):
        return id_code(F.get(m, x["a"]), F.get(m, x["b"]))

    def at(p, q, f):
        return F.get(d, p * n + q)[f]

    def both(x):  # s(a,ab) + s(b,ab)
        return at(x["a"], x["b"], "s") + at(x["b"], x["a"], "s")

    def llr(x, y):
        a, b, p, q = x["a"], x["b"], y["a"], y["b"]
        paths = (at(a, p, "l") + at(a, q, "l") + at(b, p, "l") + at(b, q, "l")) / 4 + (both(y) - both(x)) / 2
        shared = F.when((a == p) | (a == q), a).otherwise(b)
        other_x = F.when(shared == a, b).otherwise(a)
        other_y = F.when(shared == p, q).otherwise(p)
        cond = at(shared, other_y, "s") - at(shared, other_x, "s")
        has = (a == p) | (a == q) | (b == p) | (b == q)
        single_x, single_y = a == b, p == q
        v = F.when(has & single_x & ~single_y, at(a, F.when(p == a, q).otherwise(p), "s")) \
             .when(has & ~single_x & ~single_y, cond).otherwise(paths)
        if prior is not None:
            v = v + (weight(x) - weight(y))
        elif doublet_rate not in (0.0, 0.5, 1.0):
            v = v + F.when(single_x & ~single_y, F.lit(math.log2(1 - doublet_rate) - math.log2(doublet_rate))).otherwise(0.0)
        return _comparison(code(x), code(y), v)

    if prior is not None:
        c = c.withColumn("prior_", F.create_map(*[F.lit(v) for kv in prior.items() for v in kv]))

        def weight(x):
            return F.coalesce(F.col("prior_")[code(x)], F.lit(min(prior.values())))
    if doublet_rate == 0.0:
        c = c.withColumn("ids", F.filter("ids", lambda x: x["a"] == x["b"]))
    if doublet_rate == 1.0:
        c = c.withColumn("ids", F.filter("ids", lambda x: x["a"] != x["b"]))
    if allowed is not None:
        c = c.withColumn("ids", F.filter("ids", lambda x: code(x).isin(*allowed)))
    c = pin(c, llrs=F.flatten(F.transform("ids", lambda x, k: F.transform(
        F.slice("ids", k + 2, F.greatest(F.size("ids") - k - 1, F.lit(0))), lambda y: llr(x, y)))))
    return c.select("barcode", F.size("ids").alias("n_ids"), "llrs")


def restrict(table: DataFrame, allowed: list[int]) -> DataFrame:
    """Keep only comparisons between allowed identities (a list bounded by the pool)."""
    llrs = F.filter("llrs", lambda c: c["id1"].isin(*allowed) & c["id2"].isin(*allowed))
    t = pin(table, llrs=llrs)
    return pin(t, n_ids=F.size(F.array_distinct(F.flatten(F.transform("llrs", lambda c: F.array(c["id1"], c["id2"]))))))


def eliminate(table: DataFrame) -> DataFrame:
    """The last identity standing and its margin over the one before; no call unless the margin is positive."""
    return (pin(table, r=_fold(F.col("llrs"), F.col("n_ids"), 2)).filter("r.llr > 0")
            .select("barcode", id_pair(F.col("r.win")).alias("id"), F.col("r.llr").alias("llr"))
            .select("barcode", "id.i", "id.j", "llr"))


def margins(table: DataFrame) -> DataFrame:
    """Per (barcode, identity): the smallest ratio against any rival, and that rival."""
    both = table.select("barcode", F.explode("llrs").alias("c")).select("barcode", F.explode(F.array(
        F.struct(F.col("c.id1").alias("id"), F.col("c.id2").alias("rival"), F.col("c.llr").alias("llr")),
        F.struct(F.col("c.id2").alias("id"), F.col("c.id1").alias("rival"), (-F.col("c.llr")).alias("llr")))).alias("s"))
    return both.groupBy("barcode", "s.id").agg(F.min(F.struct("s.llr", "s.rival")).alias("m")).select(
        "barcode", "id", F.col("m.llr").alias("margin"), F.col("m.rival").alias("rival"))


def max_min(margin: DataFrame) -> DataFrame:
    """The identity whose worst comparison is best."""
    best = F.max_by(F.struct("id", "margin", "rival"), F.struct(F.col("margin"), (-F.col("id")).alias("o")))
    return (margin.groupBy("barcode").agg(best.alias("b")).filter("b.margin > 0")
            .select("barcode", id_pair(F.col("b.id")).alias("id"), F.col("b.margin").alias("llr"))
            .select("barcode", "id.i", "id.j", "llr"))


def winner_diagnostics(margin: DataFrame, close: float = 20.0) -> DataFrame:
    """The winner's margin, its worst rival and how many others come within ``close`` of it."""
    g = margin.groupBy("barcode").agg(
        F.max_by(F.struct("id", "margin", "rival"), F.struct(F.col("margin"), (-F.col("id")).alias("o"))).alias("b"),
        F.collect_list(F.struct("id", "margin")).alias("all"))
    near = F.size(F.filter("all", lambda x: (x["id"] != F.col("b.id")) & (F.col("b.margin") - x["margin"] < close)))
    return g.select("barcode", F.col("b.id").alias("winner"), F.col("b.margin").alias("min_margin"),
                    F.col("b.rival").alias("worst_rival"), near.alias("n_close"))


def runner_ups(margin: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` identities after the winner, by their own worst comparison."""
    g = margin.groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("margin")).alias("k"), "id", "margin", "rival"))).alias("all"))
    return g.select("barcode", F.posexplode(F.slice("all", 2, n)).alias("p", "x")).select(
        "barcode", (F.col("p") + 1).alias("rank"), "x.id", "x.margin")


def additive_scores(pair_counts: DataFrame, e_ref: float = E_REF, e_alt: float = E_ALT) -> DataFrame:
    """Log2 likelihood of each identity, from totals for singlets and pair classes for doublets.

    Equal to the pairwise path when no genotype call is missing."""
    from poolcall.functions.expr import binom_ll2
    single = F.col("j") < 0
    p = F.when(single, F.col("ni") / 2.0).otherwise((F.col("ni") + F.col("nj")) / 4.0)
    return (pair_counts.groupBy("barcode", F.when(single, F.col("i")).otherwise(id_code(F.col("i"), F.col("j"))).alias("id"))
            .agg(F.sum(binom_ll2(whole("ref_w"), whole("alt_w"), err_adj(p, e_ref, e_alt))).alias("ll")))


def best_two(scores: DataFrame) -> DataFrame:
    """Best identity and its gap to the second best; a cell has one score per identity."""
    s = F.struct(F.round("ll", DIGITS).alias("ll"), (-F.col("id")).alias("o"))
    top = scores.groupBy("barcode").agg(F.slice(F.sort_array(F.collect_list(s), False), 1, 2).alias("t"))
    return top.select("barcode", (-F.col("t")[0]["o"]).alias("id"),
                      (F.col("t")[0]["ll"] - F.get("t", F.lit(1))["ll"]).alias("llr"))


def call_cells(pair_counts: DataFrame, e_ref: float = E_REF, e_alt: float = E_ALT,
               doublet_rate: float = DOUBLET_RATE, keep: int = 10) -> DataFrame:
    """The whole chain from pair-class counts to (barcode, i, j, llr)."""
    return eliminate(identity_table(cell_pairs(pair_llr(pair_counts, e_ref, e_alt), keep), doublet_rate))


def name_identities(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Add the display name and S/D type. The member table is a dimension of at most SPAN rows."""
    from poolcall.functions.expr import identity_name
    a = samples.select(F.col("sample").alias("i"), F.col("name").alias("name_i"))
    b = samples.select(F.col("sample").alias("j"), F.col("name").alias("name_j"))
    return calls.join(a, "i").join(b, "j").select(
        "barcode", identity_name("name_i", "name_j").alias("id"),
        F.when(F.col("i") == F.col("j"), "S").otherwise("D").alias("type"), "llr", "i", "j")
