"""Label sets: members, composition, comparison and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def members(labels: DataFrame) -> DataFrame:
    """One row per member of a label; a doublet gives two rows of half weight."""
    parts = F.split("id", "\\+")
    return labels.withColumn("weight", 1.0 / F.size(parts)).withColumn("member", F.explode(parts))


def with_identity(reads: DataFrame, labels: DataFrame) -> DataFrame:
    """Give each read its cell's identity; reads of unlabelled cells are dropped. A cell holding a large share of
    the reads is spread over many tasks."""
    from poolcall.scaling import salted_join
    return salted_join(reads, labels.select("barcode", F.col("id").alias("identity")), ["barcode"], ["read_id"])


def merge_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reconcile two label sets: the only or the surer call wins; equal evidence for different labels gives none."""
    x = a.select("barcode", F.struct("id", "type", "llr").alias("x"))
    y = b.select("barcode", F.struct("id", "type", "llr").alias("y"))
    pick = (F.when(F.col("y").isNull(), F.col("x")).when(F.col("x").isNull(), F.col("y"))
            .when(F.col("x.llr") > F.col("y.llr"), F.col("x")).when(F.col("y.llr") > F.col("x.llr"), F.col("y"))
            .when(F.col("x.id") == F.col("y.id"), F.col("x")))
    return x.join(y, "barcode", "full").select("barcode", pick.alias("p")).filter("p.llr > 0").select("barcode", "p.id", "p.type", "p.llr")


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("barcode", F.col("id").alias("id1"), F.col("type").alias("type1")).join(
        b.select("barcode", F.col("id").alias("id2"), F.col("type").alias("type2")), "barcode")


def contingency(m: DataFrame) -> DataFrame:
    """Counts per label pair with margins; '(all)' marks a margin. Counts combine before the cube."""
    n = m.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("c"))
    return n.cube("id1", "id2").agg(F.sum("c").alias("n")).select(
        F.coalesce("id1", F.lit("(all)")).alias("id1"), F.coalesce("id2", F.lit("(all)")).alias("id2"), "n")


def jaccard(m: DataFrame, singlets_only: bool = False) -> DataFrame:
    """Jaccard index of each pair of labels that occur together; totals are over all matched cells."""
    n = m.groupBy("id1", "id2", "type1", "type2").agg(F.count(F.lit(1)).alias("n"))
    n = (n.withColumn("tot1", F.sum("n").over(W.partitionBy("id1")))  # one row per label pair
         .withColumn("tot2", F.sum("n").over(W.partitionBy("id2"))))
    if singlets_only:
        n = n.filter("type1 = 'S' AND type2 = 'S'")
    return n.select("id1", "id2", "n", (F.col("n") / (F.col("tot1") + F.col("tot2") - F.col("n"))).alias("jaccard"))


def display_order(j: DataFrame) -> DataFrame:
    """Rank of each label by its best Jaccard, per side; ties by name."""
    both = j.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("id1").alias("id"), "jaccard"),
                                      F.struct(F.lit(2).alias("side"), F.col("id2").alias("id"), "jaccard"))).alias("s"))
    best = both.groupBy("s.side", "s.id").agg(F.max("s.jaccard").alias("jaccard"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(F.desc("jaccard"), "id")))  # labels only


def axis_order(m: DataFrame, by_members: bool = True) -> DataFrame:
    """Place of every label on the axis of its side, (side, id, position), for a table of both label sets.

    Singlets come by their :func:`display_order`, then doublets by their better and their other member, so pairs that
    hold the best matched members stand together. A label whose first member has no place is left out; a second
    member without one counts as none. Without ``by_members`` each label is ranked as a whole, as for tables of
    doublets only. Ties by name."""
    if not by_members:
        return display_order(jaccard(m)).select("side", "id", F.col("rank").alias("position"))
    ranks = display_order(jaccard(m, singlets_only=True)).select("side", F.col("id").alias("one"), "rank")
    labels = m.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("id1").alias("id")),
                                        F.struct(F.lit(2).alias("side"), F.col("id2").alias("id")))).alias("s")).select("s.*").distinct()
    two = labels.withColumn("one", F.split_part("id", F.lit("+"), F.lit(1))).withColumn("two", F.split_part("id", F.lit("+"), F.lit(2)))
    r = (two.join(ranks.withColumnRenamed("rank", "r1"), ["side", "one"])
         .join(ranks.withColumnsRenamed({"one": "two", "rank": "r2"}), ["side", "two"], "left").fillna(0, ["r2"]))
    place = F.row_number().over(W.partitionBy("side").orderBy(F.least("r1", "r2"), F.greatest("r1", "r2"), "id"))  # labels only
    return r.select("side", "id", place.alias("position"))


def reciprocal_best(j: DataFrame) -> DataFrame:
    a, b = F.max("jaccard").over(W.partitionBy("id1")), F.max("jaccard").over(W.partitionBy("id2"))
    return j.withColumn("a_", a).withColumn("b_", b).filter("jaccard = a_ AND jaccard = b_").select("id1", "id2", "jaccard")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overall agreement, precision, recall, F1 with either set as truth, and agreement by type, as (metric, value)."""
    same = F.col("id1") == F.col("id2")
    m = matched(a, b).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("hit"),
        *[F.count_if(F.col(f"type{s}") == t).alias(f"n{s}{t}") for s in (1, 2) for t in "SD"],
        *[F.count_if((F.col(f"type{s}") == t) & same).alias(f"h{s}{t}") for s in (1, 2) for t in "SD"])
    t = m.join(F.broadcast(a.agg(F.count(F.lit(1)).alias("n1")))).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n2"))))  # one row each
    prec = F.col("hit") / F.col("n")
    out = {"overall": prec}
    for s in (1, 2):
        rec = F.col("hit") / F.col(f"n{s}")
        out[f"recall_truth{s}"] = rec
        out[f"f1_truth{s}"] = 2 * prec * rec / (prec + rec)
        out[f"missing_in{s}"] = (F.col(f"n{3 - s}") - F.col("n")) / F.col(f"n{3 - s}")
        out[f"singlet{s}"] = F.col(f"h{s}S") / F.col(f"n{s}S")
        out[f"doublet{s}"] = F.col(f"h{s}D") / F.col(f"n{s}D")
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in out.items()])).alias("x")) \
            .select("x.metric", "x.value")


def composition(labels: DataFrame) -> DataFrame:
    """Share of each member: a singlet counts 2, each member of a doublet 1."""
    per = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n"))  # cells combine before the members are split
    g = members(per).groupBy("member").agg(F.sum(F.col("n") * F.col("weight") * 2).alias("w"))
    return g.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy()))  # one row per member


def llr_weights(labels: DataFrame) -> DataFrame:
    """Mean LLR per identity and its share of the sum of means."""
    g = labels.groupBy("id").agg(F.avg("llr").alias("mean_llr"))
    return g.withColumn("weight", F.col("mean_llr") / F.sum("mean_llr").over(W.partitionBy()))  # one row per identity


def cutoff_curves(labels: DataFrame, steps: int = 100) -> DataFrame:
    """Labels above each of steps + 1 log-spaced cut-offs, by type and by identity.

    Each cell is binned once by how many cut-offs it passes, so the cells are never repeated per cut-off. No labels give no rows."""
    lo, hi = (x or 0.0 for x in labels.agg(F.min(F.log10("llr")), F.max(F.log10("llr"))).first())  # null only without labels
    cuts = [round(10 ** (lo + k * (hi - lo) / steps), 9) for k in range(steps + 1)]
    arr = F.array(*[F.lit(c) for c in cuts])
    passed = F.size(F.filter(arr, lambda c: c < F.col("llr")))
    per = labels.withColumn("bin", passed).groupBy("bin", "id", "type").agg(F.count(F.lit(1)).alias("n"))
    keyed = per.select("bin", "n", F.explode(F.array(F.struct(F.lit("type").alias("by"), F.col("type").alias("name")),
                                                     F.struct(F.lit("identity").alias("by"), F.col("id").alias("name")))).alias("k"))
    keyed = keyed.groupBy("k.by", "k.name", "bin").agg(F.sum("n").alias("n"))
    # at most steps + 1 bins per name
    out = keyed.select("by", "name", "n", F.explode(F.when(F.col("bin") > 0, F.sequence(F.lit(0), F.col("bin") - 1))).alias("cut"))
    return out.groupBy("by", "name", "cut").agg(F.sum("n").alias("n")).withColumn("cutoff", F.get(arr, F.col("cut")))


def composition_divergence(ambient: DataFrame, cells: DataFrame) -> DataFrame:
    """Normalised entropies, KL divergence and log ratios of two compositions (member, share), as (type, var, val)."""
    a = ambient.select("member", F.when(F.col("share") == 0, 1e-8).otherwise(F.col("share")).alias("pa"))
    a = a.withColumn("pa", F.col("pa") / F.sum("pa").over(W.partitionBy()))
    c = cells.select("member", F.col("share").alias("pc"))
    hmax = F.log2(F.count(F.lit(1)))
    ha = a.filter("member <> 'other_species'").agg((-F.sum(F.col("pa") * F.log2("pa"))).alias("h"), hmax.alias("m"))
    hc = c.agg((-F.sum(F.col("pc") * F.log2("pc"))).alias("h"))
    both = a.join(c, "member")
    one = F.lit("all").alias("type")
    return (ha.select(one, F.lit("H.amb").alias("var"), (F.col("h") / F.col("m")).alias("val"))
            .unionByName(hc.crossJoin(ha.select("m")).select(one, F.lit("H.cells").alias("var"), (F.col("h") / F.col("m")).alias("val")))
            .unionByName(both.agg(F.sum(F.col("pc") * F.log(F.col("pc") / F.col("pa"))).alias("val")).select(one, F.lit("KL.div").alias("var"), "val"))
            .unionByName(both.filter("member <> 'other_species'").select(
                F.col("member").alias("type"), F.lit("logdiff").alias("var"), (F.log("pa") - F.log("pc")).alias("val"))))


def run_summary(calls: DataFrame) -> DataFrame:
    """(section, key, value) rows: totals, doublet share, share of doublets with each member, cells per identity."""
    per = calls.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("type") == "D", F.col("n"))), F.lit(0)).alias("d"))
    res = tot.select(F.explode(F.array(
        F.struct(F.lit("result").alias("section"), F.lit("tot_cells").alias("key"), F.col("all").cast("double").alias("value")),
        F.struct(F.lit("result").alias("section"), F.lit("frac_doublets").alias("key"), (F.col("d") / F.col("all")).alias("value")))).alias("x")).select("x.*")
    inc = members(per.filter("type = 'D'")).groupBy("member").agg(F.sum("n").alias("n")).join(F.broadcast(tot)).select(  # one row
        F.lit("perc_doublets_include").alias("section"), F.col("member").alias("key"), (F.col("n") / F.col("d")).alias("value"))
    num = per.select(F.lit("num_cells").alias("section"), F.col("id").alias("key"), F.col("n").cast("double").alias("value"))
    return res.unionByName(inc).unionByName(num)


def with_fallback(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """A cell's supplied cluster, or its identity where none was supplied."""
    return labels.join(clusters, "barcode", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def same_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members found in only one of two composition tables; empty when they match."""
    x, y = a.select("member"), b.select("member")
    return x.exceptAll(y).withColumn("side", F.lit(1)).unionByName(y.exceptAll(x).withColumn("side", F.lit(2)))
