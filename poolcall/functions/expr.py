"""Scalar column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

P_FLOOR = 1e-8  # probabilities are kept inside [P_FLOOR, 1 - P_FLOOR] before taking logs
HALF_LOG_2PI = 0.9189385332046727


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters refer to by value.

    A filter moved below a projection repeats the projected expression, and a stack of array functions then
    repeats itself inside its own lambdas; a generator over a one-element array stops that."""
    one = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, one.alias("pin_")).select(*keep, *[f"pin_.{n}" for n in cols])


# --- identities -------------------------------------------------------------------------------

def identity_index(i, j, n_samples) -> Column:
    """Scalar index: singlets 0..S-1, then pairs i<j in row order."""
    i, j, n = col(i), col(j), n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    lo, hi = F.least(i, j), F.greatest(i, j)
    tri = n + lo * n - (lo * (lo + 1) / 2).cast("int") + hi - lo - 1
    return F.when(i == j, i).otherwise(tri).cast("int")


def identity_members(index, n_samples) -> Column:
    """Inverse of :func:`identity_index` as STRUCT<i, j>, in closed form."""
    k, n = col(index), n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    r = k - n
    b = F.lit(2.0) * n - 1
    i = F.floor((b - F.sqrt(b * b - 8.0 * r)) / 2).cast("int")
    j = (r - i * n + (i * (i + 1) / 2).cast("int") + i + 1).cast("int")
    return F.when(k < n, F.struct(k.cast("int").alias("i"), k.cast("int").alias("j"))) \
            .otherwise(F.struct(i.alias("i"), j.alias("j")))


def identity_name(a, b) -> Column:
    """Display name: one name, or both in alphabetical order joined by '+'."""
    a, b = col(a), col(b)
    return F.when(a == b, a).otherwise(F.array_join(F.array_sort(F.array(a, b)), "+"))


# --- likelihood pieces ------------------------------------------------------------------------

def phred_weight(q) -> Column:
    """Probability that a base or mapping of phred quality ``q`` is right."""
    return 1 - F.pow(F.lit(10.0), -col(q) / 10.0)


def micro(x) -> Column:
    """A weight as integer millionths, so sums do not depend on row order."""
    return F.round(col(x) * 1000000).cast("bigint")


def err_adj(p, e_ref, e_alt) -> Column:
    """Expected alt rate after misreads."""
    p = col(p)
    return p - p * e_alt + (1 - p) * e_ref


def clamp_p(p) -> Column:
    return F.greatest(F.least(col(p), F.lit(1 - P_FLOOR)), F.lit(P_FLOOR))


def binom_ll2(ref, alt, p) -> Column:
    """Binomial log2 likelihood without its coefficient (it cancels in every ratio)."""
    p = clamp_p(p)
    return col(alt) * F.log2(p) + col(ref) * F.log2(1 - p)


def binom_llr2(ref, alt, p1, p2) -> Column:
    p1, p2 = clamp_p(p1), clamp_p(p2)
    return col(alt) * F.log2(p1 / p2) + col(ref) * F.log2((1 - p1) / (1 - p2))


def log_gamma(x) -> Column:
    """Natural log-gamma for x > 0: Stirling series after shifting the argument by 8.

    In doubles: the product of eight whole numbers leaves 64 bits from about 235 on."""
    x = col(x).cast("double")
    z = x + 8
    series = (1 / (12 * z)) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (z - 0.5) * F.log(z) - z + HALF_LOG_2PI + series - F.log(shift)


def log_gamma_sql(x: str) -> str:
    """The SQL text of :func:`log_gamma`; parsing one text is much quicker than composing columns in a loop."""
    z = f"(({x}) + 8)"
    shift = " * ".join(f"(({x}) + {k})" for k in range(8))
    return (f"(({z} - 0.5D) * ln({z}) - {z} + {HALF_LOG_2PI}D + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) "
            f"+ 1 / (1260 * pow({z}, 5D)) - ln({shift}))")


def log_choose(n, k) -> Column:
    n, k = col(n), col(k)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def binom_logpmf(n, k, p) -> Column:
    """Natural-log binomial probability."""
    p, n, k = clamp_p(p), col(n), col(k)
    return log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)


def logit(p) -> Column:
    p = clamp_p(p)
    return F.log(p / (1 - p))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def log2_sum_exp2(xs: Column) -> Column:
    """log2 of the sum of 2^x over an array column, safe for large negative values."""
    m = F.array_max(xs)
    return m + F.log2(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), x - m)))


# --- moment fits --------------------------------------------------------------------------------

def nb_size(mean, var) -> Column:
    """Negative binomial size from moments; NULL when not over-dispersed."""
    mean, var = col(mean), col(var)
    return F.when(var > mean, mean * mean / (var - mean))


def beta_shape(mean, var) -> Column:
    """STRUCT<a, b> of a beta distribution from moments."""
    mean, var = col(mean), col(var)
    f = mean * (1 - mean) / var - 1
    return F.struct((mean * f).alias("a"), ((1 - mean) * f).alias("b"))


def gamma_shape(mean, var) -> Column:
    mean, var = col(mean), col(var)
    return F.struct((mean * mean / var).alias("shape"), (mean / var).alias("rate"))


# --- text ---------------------------------------------------------------------------------------

def revcomp(seq) -> Column:
    return F.translate(F.reverse(col(seq)), "ACGT", "TGCA")


def canonical_kmer(kmer) -> Column:
    k = col(kmer)
    return F.least(k, revcomp(k))


def kmers(seq, k: int) -> Column:
    """All windows of length k that hold no N, as an array in reading order.

    One lookahead match per position reads the text once; cutting windows out by position would start
    over at the first character each time."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?=([^N]{{{k}}}))"), F.lit(1))


def hamming(a, b) -> Column:
    """Mismatches between two strings of one length."""
    return F.aggregate(
        F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")),
        F.lit(0), lambda s, x: s + x)


def clean_barcode(text) -> Column:
    """The base sequence inside a decorated barcode."""
    return F.regexp_extract(col(text), "[ACGT]{16,}", 0)


def format_barcode(bc, lib, style: str) -> Column:
    """Library decoration: plain, -lib, _lib, lib_, -1, -1-lib, lib_bc-1."""
    bc, lib = col(bc), col(lib)
    forms = {
        "plain": bc,
        "suffix": F.concat(bc, F.lit("-"), lib),
        "underscore": F.concat(bc, F.lit("_"), lib),
        "prefix": F.concat(lib, F.lit("_"), bc),
        "one": F.concat(bc, F.lit("-1")),
        "one_suffix": F.concat(bc, F.lit("-1-"), lib),
        "prefix_one": F.concat(lib, F.lit("_"), bc, F.lit("-1")),
    }
    return forms[style]


def bin_id(chrom, pos, size: int) -> Column:
    return F.concat(col(chrom), F.lit(":"), F.floor(col(pos) / size).cast("string"))


def stochastic_round(x, *keys) -> Column:
    """Round up with probability equal to the fraction; the draw is a hash of the keys."""
    x = col(x)
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    return (F.floor(x) + (u < x - F.floor(x)).cast("int")).cast("bigint")


def uniform(*keys) -> Column:
    """A reproducible number in [0, 1) from the keys."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


# --- regression and adjustment --------------------------------------------------------------------

def weighted_line(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least-squares slope and intercept per group from five running sums."""
    x, y, w = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
                            F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    den = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    s = s.withColumn("slope", F.when(den != 0, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / den))
    return s.select(*by, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"))


_CLAMP = f"greatest(least({{p}}, {1 - P_FLOOR}D), {P_FLOOR}D)"
SQL_FUNCTIONS = {
    "err_adj": ("p DOUBLE, e_ref DOUBLE, e_alt DOUBLE", "DOUBLE", "p - p * e_alt + (1 - p) * e_ref"),
    "binom_llr2": ("ref_n DOUBLE, alt_n DOUBLE, p1 DOUBLE, p2 DOUBLE", "DOUBLE",
                   f"alt_n * log2({_CLAMP.format(p='p1')} / {_CLAMP.format(p='p2')}) + ref_n * log2((1 - {_CLAMP.format(p='p1')}) / (1 - {_CLAMP.format(p='p2')}))"),
    "canonical_kmer": ("k STRING", "STRING", "least(k, translate(reverse(k), 'ACGT', 'TGCA'))"),
    "identity_name": ("a STRING, b STRING", "STRING",
                      "CASE WHEN a = b THEN a ELSE concat(least(a, b), '+', greatest(a, b)) END"),
    "format_barcode": ("bc STRING, lib STRING", "STRING", "concat(bc, '-', lib)"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the core expressions to SQL text as plain SQL functions (no Python involved)."""
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
