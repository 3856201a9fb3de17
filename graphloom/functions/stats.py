"""Report statistics (survey A11-A19, A23).

Defined results: nulls are left out of means, deviations and ranks; a group of nulls only has null ones. Empty tables give empty
results, or one row of nulls where one row is asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.ranks import running, running_count
from graphloom.functions.storage import materialise


def mean_sd(df: DataFrame, by: list[str], value: str, population: bool = False) -> DataFrame:
    """Mean and standard deviation by group; a sample deviation of one row is 0."""
    sd = F.stddev_pop(value) if population else F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("sd"), F.count(value).alias("n"))


def through_origin(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares slope of a line through the origin."""
    return df.agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def truncated_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of values cut to integers first, cut again."""
    return df.groupBy(*by).agg(F.floor(F.sum(F.floor(value)) / F.count(value)).cast("bigint").alias("mean"))


#: Steps of the recurrence by which an argument is raised before the series of ``_half_step`` is used.
RAISED = 16
#: Numbers closer to 0 than this would end a continued fraction.
TINY = 1e-300


def _half_step(a: Column) -> Column:
    """log of gamma(a + 1/2) / gamma(a), by its asymptotic series at a + RAISED."""
    z = a + RAISED
    series = 0.5 * F.log(z) - 1 / (8 * z) + 1 / (192 * F.pow(z, 3.0)) - 1 / (640 * F.pow(z, 5.0)) + 17 / (14336 * F.pow(z, 7.0))
    steps = F.transform(F.sequence(F.lit(0), F.lit(RAISED - 1)), lambda j: F.log((a + j) / (a + j + 0.5)))
    return series + F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its front: a fold over its steps."""
    safe = lambda c: F.when(F.abs(c) > TINY, c).otherwise(F.lit(TINY))
    made = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, num: Column) -> Column:
        d, c = 1 / safe(1 + num * s["d"]), safe(1 + num / s["c"])
        return made(c, d, s["h"] * d * c)

    def step(s: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(i % 2 == 1, even).otherwise(odd))

    d = 1 / safe(1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(1), F.least(F.lit(100_000), 200 + 8 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, made(F.lit(1.0), d, d), step, lambda s: s["h"])


def t_tail(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t, as a column: the incomplete beta function at freedom / (freedom + t^2). Null for a null or
    no degree of freedom, 0 for an infinite t."""
    v = freedom.cast("double")
    square = t * t
    x, y = v / (v + square), square / (v + square)
    a, half = v / 2, F.lit(0.5)
    front = F.exp(_half_step(a) - 0.5 * F.log(F.lit(math.pi)) + a * F.log(x) + 0.5 * F.log(y))
    near = front * _fraction(a, half, x) / a
    far = 1 - front * _fraction(half, a, y) / 0.5
    p = F.when(y <= 0, F.lit(1.0)).when(x <= 0, F.lit(0.0)).when(x < (a + 1) / (a + 2.5), near).otherwise(far)
    return F.when((v > 0) & t.isNotNull(), F.when(F.abs(t) == F.lit(float("inf")), F.lit(0.0)).otherwise(p))


def paired_t(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """A row, or one for each group: pairs, mean difference, t, Cohen's d over the population deviation, and two-sided p.

    Pairs with a null side are left out. t is null for fewer than two pairs, and so are t and p where no pair differs from another.
    """
    keys = by or []
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d")).groupBy(*keys)
    d = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("s"), F.stddev_pop("d").alias("p"))
    ratio = lambda x: F.when(x != 0, F.col("mean_diff") / x)
    t = d.select(*keys, "n", "mean_diff", ratio(F.col("s") / F.sqrt("n")).alias("t"), ratio(F.col("p")).alias("cohen_d"))
    return t.withColumn("p_value", t_tail(F.col("t"), F.col("n") - 1))


def _beta_tail(t: float, v: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = v / (v + t * t), v / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def p_value(t: float, n: int) -> float:
    """Two-sided p of a paired t-test over ``n`` pairs, of one number on the driver (``t_tail``: as a column)."""
    return _beta_tail(t, n - 1) if n > 1 else float("nan")


def profile(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """One row for each column: counts, distinct values and, if any value parses as a number, its moments.

    The columns are unpivoted as text. Moments and counts are partial sums. Distinct values are counted in two steps, by column
    and value and then by column; medians come from running counts over the distinct numbers of all columns in one order,
    dealt out by range: no task sees a whole column.
    """
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    filled = F.when(F.trim("v") != "", F.col("v"))
    # how often each value stands, and from here on only that
    values = long.select("column", filled.alias("v")).groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
    values = materialise(values.withColumn("x", F.expr("try_cast(trim(v) AS double)")), "profile")
    named = values.groupBy("column")
    counts = named.agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0)).alias("filled"), F.count("v").alias("distinct_values"),
        F.sum(F.when(F.col("x").isNotNull(), F.col("k")).otherwise(0)).alias("numeric"), F.sum(F.col("x") * F.col("k")).alias("sum"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    counts = materialise(counts.withColumn("mean", F.col("sum") / F.when(F.col("numeric") > 0, F.col("numeric"))), "profile-counts")  # a row for each column
    off = F.col("x") - F.col("mean")
    spread = values.join(F.broadcast(counts.select("column", "mean")), "column").groupBy("column").agg(F.sum(off * off * F.col("k")).alias("squares"))
    numbers = values.where("x IS NOT NULL").groupBy("column", "x").agg(F.sum("k").alias("k"))
    upto = running(numbers, "k", "upto", F.col("column"), F.col("x"))
    total = counts.select("column", "numeric", (F.sum("numeric").over(W.orderBy("column")) - F.col("numeric")).alias("base"))
    at = F.col("upto") - F.col("base")
    middle = upto.join(F.broadcast(total), "column").groupBy("column").agg(
        F.min(F.when(at > F.floor((F.col("numeric") - 1) / 2), F.col("x"))).alias("low"), F.min(F.when(at > F.floor(F.col("numeric") / 2), F.col("x"))).alias("high")
    )
    sd = F.when(F.col("numeric") > 1, F.sqrt(F.col("squares") / (F.col("numeric") - 1))).when(F.col("numeric") > 0, F.lit(0.0))
    out = counts.join(spread, "column").join(middle, "column", "left").withColumns({"median": (F.col("low") + F.col("high")) / 2, "sd": sd})
    return out.select("column", "filled", "numeric", "distinct_values", *(F.round(c, digits).alias(c) for c in ("mean", "median", "sd", "min", "max", "sum")))


def telling_columns(df: DataFrame, by: str, columns: list[str], digits: int = 3) -> DataFrame:
    """``(by, column, mean)`` of the numeric columns whose rounded means differ between groups."""
    long = df.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select(by, "s.*")
    means = long.groupBy(by, "column").agg(F.round(F.avg("x"), digits).alias("mean"))
    telling = means.groupBy("column").agg(F.count_distinct("mean").alias("k")).where("k > 1").select("column")
    return means.join(telling, "column", "left_semi")


def distribution(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values with count and percentage of all rows."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).select(F.col(column).alias("value"), "n", (F.col("n") * 100.0 / F.col("all")).alias("percent")).orderBy(F.desc("n"), "value").limit(top)


def pick(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics by index ``int(share * n)`` (from 0, the last at most); 0.5 is the upper median.

    Ranks are taken over the distinct values' counts, so the rows are never sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    upto = running_count(counts, value, "k")
    total = counts.agg(F.sum("k").alias("n"))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return upto.crossJoin(F.broadcast(total)).agg(*(F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()))


def best_parameter(df: DataFrame, parameter: str, value: str) -> DataFrame:
    """The parameter of greatest mean value, ties to the first: ``(parameter, mean)``."""
    return df.groupBy(parameter).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), parameter).limit(1)


def at_best_parameter(df: DataFrame, parameter: str, by: str, value: str) -> DataFrame:
    """``(by, mean)`` of each group at the parameter of greatest overall mean."""
    best = best_parameter(df, parameter, value).select(parameter)
    return df.join(F.broadcast(best), parameter, "left_semi").groupBy(by).agg(F.avg(value).alias("mean"))


def theory(n: Column, m: Column, k: Column | None = None) -> Column:
    """``(n + m) ln n``, plus ``m * k``."""
    t = (n + m) * F.log(n)
    return t if k is None else t + m * k
