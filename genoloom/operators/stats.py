"""Tests, corrections and effect sizes as aggregates, windows and, for tails, Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from genoloom.runtime import dense_ids

Z95 = 1.959963984540054

_log_factorials = np.zeros(1)


def _lf(n: int) -> np.ndarray:
    """ln(i!) for i = 0..n, kept by the worker."""
    global _log_factorials
    if len(_log_factorials) <= n:
        _log_factorials = np.r_[0.0, np.cumsum(np.log(np.arange(1, max(n, 1024) * 2)))]
    return _log_factorials


@F.pandas_udf(DoubleType())
def fisher_greater(k: pd.Series, size: pd.Series, query: pd.Series, background: pd.Series) -> pd.Series:
    """P(X >= k) of the hypergeometric law; 1 where a margin is empty. Equal tables of a batch are worked out once."""
    tables = pd.DataFrame({"k": k, "m": size, "q": query, "n": background})
    group = tables.groupby(["k", "m", "q", "n"], sort=False).ngroup()
    lf = _lf(int(background.max()) if len(background) else 0)
    out = []
    for a, m, q, n in tables.drop_duplicates().itertuples(index=False):
        if a <= 0:
            out.append(1.0)
            continue
        x = np.arange(a, min(m, q) + 1)
        x = x[n - m - q + x >= 0]
        logs = lf[m] - lf[x] - lf[m - x] + lf[n - m] - lf[q - x] - lf[n - m - q + x] - lf[n] + lf[q] + lf[n - q]
        out.append(min(1.0, float(np.exp(logs).sum())))
    return pd.Series(np.array(out)[group.to_numpy()] if len(out) else [], dtype="float64")


def fold_columns(k: Column, size: Column, query: Column, background: Column) -> dict[str, Column]:
    """Fold enrichment and its log interval with se 1 / sqrt(k); (0, 0) when nothing is shared."""
    expected = size * query / background
    fold = F.coalesce(F.try_divide(k.cast("double"), expected), F.lit(0.0))
    half = Z95 / F.sqrt(F.greatest(k, F.lit(1)))
    usable = (k > 0) & (expected > 0)
    return {
        "fold_enrichment": fold,
        "fold_enrichment_ci_lo": F.when(usable, F.exp(F.log(fold) - half)).otherwise(0.0),
        "fold_enrichment_ci_hi": F.when(usable, F.exp(F.log(fold) + half)).otherwise(0.0),
    }


def four_term_interval(k: Column, size: Column, query: Column, background: Column) -> tuple[Column, Column]:
    """The other interval of the fold: the log standard error has all four counts."""
    fold = F.try_divide(k * background, (size * query).cast("double"))
    inv = lambda x: 1 / F.greatest(x, F.lit(1)).cast("double")
    se = F.sqrt(F.greatest(inv(k) - inv(size) + inv(query) - inv(background), F.lit(0.0)))
    usable = (k > 0) & (size > 0) & (query > 0)
    return F.when(usable, F.exp(F.log(fold) - Z95 * se)).otherwise(0.0), F.when(usable, F.exp(F.log(fold) + Z95 * se)).otherwise(0.0)


def bh(df: DataFrame, p: str, out: str, groups: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg within groups (null groups are groups); null and NaN p-values stay null.

    Equal p-values get equal q-values, so the order among ties is free.
    """
    groups = groups or []
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    df = df.withColumn("_ok", F.when(finite, F.col(p)))
    part = Window.partitionBy(*groups, F.col("_ok").isNull())
    df = df.withColumn("_n", F.count("_ok").over(part)).withColumn("_r", F.row_number().over(part.orderBy("_ok", *(ties or []))))
    step = F.col("_ok") * F.col("_n") / F.col("_r")
    # from the largest p downwards, the smallest step so far
    back = part.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min(step).over(back), F.lit(1.0))
    return df.withColumn(out, F.when(F.col("_ok").isNotNull(), q)).drop("_ok", "_n", "_r")


def bh_distributed(df: DataFrame, p: str, out: str, block: int = 100_000) -> DataFrame:
    """Benjamini-Hochberg over a whole table without a one-task window.

    A global sort numbers the p-values; the smallest step from a place to the end is the smaller
    of that within the place's block and that of the later blocks, of which there are few.
    """
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    ok = dense_ids(df.where(finite).orderBy(p), "_r", 1)
    n = ok.agg(F.max("_r")).first()[0]
    rest = df.where(~finite | F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    if not n:
        return rest
    ok = ok.withColumn("_s", F.col(p) * F.lit(n) / F.col("_r")).withColumn("_b", F.floor((F.col("_r") - 1) / block).cast("int"))
    low, later = [], float("inf")
    for b, m in sorted(ok.groupBy("_b").agg(F.min("_s")).collect(), reverse=True):  # one row for each ``block`` rows
        low.append((b, later))
        later = min(later, m)
    table = df.sparkSession.createDataFrame(low, "_b int, _later double")
    back = Window.partitionBy("_b").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min("_s").over(back), F.col("_later"), F.lit(1.0))
    return ok.join(table, "_b").withColumn(out, q).select(*df.columns, out).unionByName(rest)


def storey(df: DataFrame, p: str, out: str) -> DataFrame:
    """Storey q-values: pi0 from the least-squares cubic over lambda 0.05..0.90 at its last point.

    The cubic is what a smoothing spline gives while its residual stays below the smoothing
    factor. Fewer than 10 values fall back to Benjamini-Hochberg. 18 counts come to the driver.
    """
    lam = np.arange(0.05, 0.95, 0.05)
    ok = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    row = ok.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(p) > float(x), 1)).alias(f"c{i}") for i, x in enumerate(lam)]).first()
    df = bh_distributed(df, p, out)
    if row["n"] < 10:
        return df
    pi = np.array([row[f"c{i}"] / (row["n"] * (1 - x)) for i, x in enumerate(lam)])
    pi0 = float(np.clip(np.polyval(np.polyfit(lam, pi, 3), lam[-1]), 0.01, 1.0))
    return df.withColumn(out, F.col(out) * pi0)


#: What the fitted cubic gives at its last point is a fixed weighted sum of the 18 shares.
STOREY_WEIGHTS = (lambda x: (x @ np.linalg.pinv(x))[-1])(np.vander(np.arange(0.05, 0.95, 0.05), 4))


def adjusted(df: DataFrame, p: str, out: str, method: str = "bh", groups: list[str] | None = None) -> DataFrame:
    """``p`` corrected by Benjamini-Hochberg (within groups, if any) or, over the whole table, by Storey's q-values."""
    if method not in ("bh", "storey"):
        raise ValueError(f"no correction {method!r}; there are 'bh' and 'storey'")
    if method == "storey":
        if groups:
            raise ValueError("q-values are of a whole table")
        return storey(df, p, out)
    return bh(df, p, out, groups) if groups else bh_distributed(df, p, out)


def average_rank(groups: list[str], value: str | Column, descending: bool = False) -> Column:
    """Rank with ties averaged."""
    v = F.col(value) if isinstance(value, str) else value
    part = Window.partitionBy(*groups)
    return F.rank().over(part.orderBy(v.desc() if descending else v.asc())) + (F.count("*").over(Window.partitionBy(*groups, v)) - 1) / 2.0


def _t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided Student tail for real degrees of freedom: the incomplete beta continued fraction."""
    x = df / (df + t * t)
    return np.array([_betainc(d / 2, 0.5, v) for d, v in zip(df, x)])


def _betainc(a: float, b: float, x: float) -> float:
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
            c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.to_numpy(float), df.to_numpy(float)
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out[ok] = _t_tail(t[ok], df[ok])
    return pd.Series(out).where(ok, None)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom; null when both variances are 0 or a group has fewer than 2 values."""
    a, b = v1 / n1, v2 / n2
    usable = (n1 > 1) & (n2 > 1) & (a + b > 0)
    t = F.when(usable, (m1 - m2) / F.sqrt(a + b))
    df = F.when(usable, (a + b) * (a + b) / (a * a / F.greatest(n1 - 1, F.lit(1)) + b * b / F.greatest(n2 - 1, F.lit(1))))
    return t, df


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Pooled d; 0 when a group has fewer than 2 values or the pooled deviation is below 1e-12."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.greatest(n1 + n2 - 2, F.lit(1)))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled >= 1e-12), (m1 - m2) / pooled).otherwise(0.0)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    z2 = Z95 * Z95
    p = F.try_divide(successes.cast("double"), n)
    mid, den = p + z2 / (2 * n), 1 + z2 / n
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest((mid - half) / den, F.lit(0.0)), F.least((mid + half) / den, F.lit(1.0))


@F.pandas_udf(DoubleType())
def sign_test_greater(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact binomial P(X >= wins) with a half chance; 1 without any difference."""
    out = []
    for w, l in zip(wins, losses):
        n = int(w + l)
        lf = _lf(n)
        x = np.arange(int(w), n + 1)
        out.append(min(1.0, float(np.exp(lf[n] - lf[x] - lf[n - x] - n * math.log(2)).sum())) if n else 1.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def sign_test_two_sided(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Sum of all outcomes no more likely than the observed one."""
    out = []
    for w, l in zip(wins, losses):
        n = int(w + l)
        lf = _lf(n)
        x = np.arange(0, n + 1)
        p = np.exp(lf[n] - lf[x] - lf[n - x] - n * math.log(2)) if n else np.ones(1)
        out.append(min(1.0, float(p[p <= p[int(w)] * (1 + 1e-7)].sum())))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_two_sided(w_plus: pd.Series, w_minus: pd.Series, squares: pd.Series) -> pd.Series:
    """Wilcoxon's signed-rank p: exact for up to 50 untied differences, else normal with the ranks' squares as variance; 1 without any."""
    out = []
    for up, down, sq in zip(w_plus, w_minus, squares):
        total = up + down
        n = round((math.sqrt(8 * total + 1) - 1) / 2)
        if total == 0:
            out.append(1.0)
        elif n <= 50 and sq == n * (n + 1) * (2 * n + 1) / 6:  # the squares of 1..n only without ties
            ways = np.zeros(int(total) + 1)
            ways[0] = 1.0
            for k in range(1, n + 1):
                ways[k:] = ways[k:] + ways[:-k].copy()
            out.append(min(1.0, 2 * float(ways[: int(min(up, down)) + 1].sum() / 2.0**n)))
        else:
            out.append(math.erfc(abs(up - total / 2) / (math.sqrt(sq) / 2) / math.sqrt(2)))
    return pd.Series(out, dtype="float64")


def paired_statistics(df: DataFrame, groups: list[str], delta: str) -> DataFrame:
    """Wins, losses, both rank-biserial effects, sign tests, dz and the signed-rank p of paired differences."""
    df = df.where(F.col(delta).isNotNull() & ~F.isnan(delta)).withColumn("d", F.col(delta).cast("double"))
    nonzero = df.where("d <> 0").withColumn("rank", average_rank(groups, F.abs("d")))
    ranks = nonzero.groupBy(*groups).agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sum(F.col("rank") * F.col("rank")).alias("sq"),
    )
    base = df.groupBy(*groups).agg(
        F.count("*").alias("n_pairs"),
        F.count(F.when(F.col("d") > 0, 1)).alias("wins"),
        F.count(F.when(F.col("d") < 0, 1)).alias("losses"),
        F.avg("d").alias("mean_delta"),
        F.stddev_samp("d").alias("sd"),
    )
    out = base.join(ranks, groups, "left").fillna(0.0, ["w_plus", "w_minus", "sq"])
    total = F.col("w_plus") + F.col("w_minus")
    return out.select(
        *groups, "n_pairs", "wins", "losses", "mean_delta",
        F.coalesce(F.try_divide(F.col("wins") - F.col("losses"), F.col("wins") + F.col("losses")), F.lit(0.0)).alias("rank_biserial"),
        F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_minus"), total), F.lit(0.0)).alias("signed_rank_biserial"),
        F.coalesce(F.try_divide("mean_delta", "sd"), F.lit(0.0)).alias("dz"),
        sign_test_greater("wins", "losses").alias("sign_p_greater"),
        sign_test_two_sided("wins", "losses").alias("sign_p"),
        signed_rank_two_sided("w_plus", "w_minus", "sq").alias("signed_rank_p"),
    )
