"""Trimming of outliers: bounds are small aggregates; those of years are joined back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import num, price_metric
from .quantiles import quantiles

BY_YEAR_K, GLOBAL_K, LEAST_ROWS, WIDEST = 2.5, 1.5, 10, 5


def year_bounds(df: DataFrame, col: str = "price_millions", k: float = BY_YEAR_K, least: int = LEAST_ROWS, widest: int = WIDEST) -> DataFrame:
    """``(year, width, rows, low, high)``: bounds of each year from the narrowest window around it.

    A window reaches as many years to each side as it takes to hold ``least`` rows, ``widest`` at
    most. Rows without a value count as rows but not for the quartiles.
    """
    rows = df.select(F.col("deal_year").cast("int").alias("y"), num(col).alias("v")).where("y is not null")
    counts = rows.groupBy("y").agg(F.count("*").alias("n"))  # one row per year
    near = counts.select(F.col("y").alias("y2"), "n", F.explode(F.sequence(F.lit(-widest), F.lit(widest))).alias("off"))
    near = near.select((F.col("y2") + F.col("off")).alias("y"), F.abs("off").alias("d"), "n").join(F.broadcast(counts.select("y")), "y")
    within = [F.sum(F.when(F.col("d") <= w, F.col("n"))).alias(f"n{w}") for w in range(widest + 1)]
    wide = near.groupBy("y").agg(*within)
    width = F.coalesce(*[F.when(F.col(f"n{w}") >= least, w) for w in range(widest + 1)], F.lit(widest))
    wide = wide.select(F.col("y").alias("year"), width.alias("width"))
    windows = wide.select("year", "width", F.explode(F.sequence(F.col("year") - F.col("width"), F.col("year") + F.col("width"))).alias("y"))
    q = quantiles(rows.where("v is not null"), ["y"], "v", [0.25, 0.75], windows)
    span = (F.col("q")[1] - F.col("q")[0]) * k
    return q.select("year", "width", "rows", (F.col("q")[0] - span).alias("low"), (F.col("q")[1] + span).alias("high"))


def trim_by_year(df: DataFrame, col: str = "price_millions", k: float = BY_YEAR_K, least: int = LEAST_ROWS, widest: int = WIDEST) -> DataFrame:
    """Rows within the bounds of their year; rows without a year or a value stay."""
    b = year_bounds(df, col, k, least, widest).select(F.col("year").alias("_y"), "low", "high")
    out = df.join(F.broadcast(b), F.col("deal_year").cast("int") == F.col("_y"), "left")
    inside = num(col).isNull() | F.col("_y").isNull() | num(col).between(F.col("low"), F.col("high"))
    return out.where(inside).select(*df.columns)


def trim_global(df: DataFrame, col: str = "price_millions", k: float = GLOBAL_K, keep_null: bool = False) -> DataFrame:
    """Rows within the bounds of the whole table; rows without a value go unless ``keep_null``.

    The two quartiles come to the driver, so a chain of trims stays a chain of plain filters.
    """
    low, high = quantiles(df.select(num(col).alias("v")), [], "v", [0.25, 0.75]).first()["q"]
    inside = F.lit(False) if low is None else num(col).between(low - (high - low) * k, high + (high - low) * k)
    return df.where(inside | num(col).isNull() if keep_null else inside)


def trim_metric(df: DataFrame, kind: str, by_year: bool = False) -> DataFrame:
    """Trim by price per m2 or per room after the price itself; rows without the ratio stay."""
    if kind not in ("per_m2", "per_room"):
        return df
    with_metric = df.withColumn("_metric", price_metric(kind))
    out = trim_by_year(with_metric, "_metric") if by_year else trim_global(with_metric, "_metric", keep_null=True)
    return out.select(*df.columns)


def trim_var(df: DataFrame, col: str = "area") -> DataFrame:
    return trim_global(df, col)


def trim(df: DataFrame, policy: str, metric: str = "price", area: bool = False) -> DataFrame:
    """The trimming of each view: ``deals``, ``areas``, ``cities``, ``gushes`` or ``options``."""
    if policy == "deals":
        out = trim_metric(trim_by_year(df), metric, by_year=True)
        return trim_var(out) if area else out
    if policy in ("areas", "cities"):
        return trim_metric(trim_global(df), metric)
    if policy == "gushes":
        return trim_var(trim_metric(trim_global(df), metric))
    if policy == "options":
        return trim_by_year(df)
    raise ValueError(f"no such trimming: {policy}")
