"""Column functions on numbers: clips, ratios, normalisations and ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def log_share(c: Column, most: Column, scale: float = 1.0) -> Column:
    """ln(1 + c) as a share of ln(1 + most), times scale; 0 where most is 0 or null."""
    return F.when(most > 0, F.log1p(c.cast("double")) / F.log1p(most.cast("double")) * scale).otherwise(0.0)


def bounded_share(c: Column, most: Column) -> Column:
    return F.when(most > 0, clip(c / most, 0.0, 1.0)).otherwise(0.0)


def min_max(c: Column, over: WindowSpec) -> Column:
    """c between 0 and 1 within its window; 1 where all values are equal."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high <= low, 1.0).otherwise((c - low) / (high - low))


def bayesian(count: Column, mean: Column, overall: Column, prior: float) -> Column:
    """The mean of `count` values, drawn to the overall mean by `prior` values of it."""
    return (count * mean + prior * overall) / (count + prior)


def year_affinity(year: Column, mean: Column) -> Column:
    return F.coalesce(F.exp(-F.abs(year - mean) / 18), F.lit(0.0))


def rank_bonus(rank: Column, length: Column) -> Column:
    return F.when(length > 1, 1 - (rank - 1) / (length - 1)).otherwise(0.0)


def rank_percentile(order: WindowSpec, whole: WindowSpec) -> Column:
    """Position from the bottom, as a share; ties by the order's last key, a single row has 1."""
    n = F.count(F.lit(1)).over(whole)
    return F.when(n <= 1, 1.0).otherwise((F.row_number().over(order) - 1) / (n - 1))


def overlap_shrink(n: Column, by: float = 5.0) -> Column:
    return n / (n + by)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-clip(c, -35.0, 35.0)))


def logit(c: Column) -> Column:
    p = clip(c, 1e-6, 1 - 1e-6)
    return F.log(p / (1 - p))


def softplus(c: Column) -> Column:
    return F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))


def z_score(c: Column, over: WindowSpec) -> Column:
    std = F.stddev_pop(c).over(over)
    return (c - F.avg(c).over(over)) / F.when(std < 1e-6, 1.0).otherwise(std)


def top(df, group: str, order: list[Column], n: int, rank: str = "rank"):
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= n)


def top_split(df, group: str, order: list[Column], n: int, by: str, parts: int = 64, rank: str = "rank"):
    """top() for groups of any size: each is first cut in `parts` by the hash of `by`, so that no task sorts a whole group."""
    first = Window.partitionBy(group, F.pmod(F.xxhash64(by), F.lit(parts))).orderBy(*order)
    return top(df.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= n).drop(rank), group, order, n, rank)
