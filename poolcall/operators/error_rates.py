"""Misread rates of the reference and alternative allele, re-estimated from called cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from poolcall.session import collect_bounded

# (span, step) of each search level around the best point so far; fixed values
LEVELS = [(0.5, 0.01), (0.01, 0.0005), (0.0005, 0.000025)]


def expected_classes(pair_counts: DataFrame, calls: DataFrame) -> DataFrame:
    """LLR-weighted alt and total counts per expected alt rate: at most five rows, whatever the data.

    A singlet uses its totals, a doublet the classes of its two members."""
    c = calls.select("barcode", F.col("i").alias("ci"), F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("j")).alias("cj"), "llr")
    hit = pair_counts.join(c, "barcode").filter("i = ci AND j = cj")
    exp = F.when(F.col("j") < 0, F.col("ni") / 2.0).otherwise((F.col("ni") + F.col("nj")) / 4.0)
    return hit.groupBy(exp.alias("expected")).agg(
        F.sum(F.col("llr") * (F.col("ref_w") + F.col("alt_w")) / 1e6).alias("n"),
        F.sum(F.col("llr") * F.col("alt_w") / 1e6).alias("k"))


def fit_error_rates(classes: DataFrame, e_ref: float, e_alt: float, sigma: float) -> tuple[float, float]:
    """Most likely (e_ref, e_alt) under normal priors, by a three-level grid over the five class rows."""
    rows = collect_bounded(classes, 5)
    exp, n, k = (np.array([r[c] for r in rows], dtype=float) for c in ("expected", "n", "k"))
    best = None
    for span, step in LEVELS:
        steps = round(span / step)
        if best is None:
            gr = ga = np.arange(1, steps) * step
        else:
            off = np.arange(-steps, steps + 1) * step
            gr, ga = best[0] + off, best[1] + off
            gr, ga = gr[gr > 0], ga[ga > 0]
        r, a = np.meshgrid(gr, ga, indexing="ij")
        ll = -((r - e_ref) ** 2 + (a - e_alt) ** 2) / (2 * sigma * sigma)
        for e, ni, ki in zip(exp, n, k):
            p = e - e * a + (1 - e) * r
            ll = ll + ki * np.log(p) + (ni - ki) * np.log(1 - p)
        x = np.unravel_index(np.argmax(ll), ll.shape)
        best = (float(r[x]), float(a[x]))
    return best
