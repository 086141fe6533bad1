"""Rankings, growth and relative series over yearly summaries.

A summary has one row per place and year: ``deal_year``, ``n_deals`` and the value ``y``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import compact


def _positive(c: str = "y") -> Column:
    y = F.col(c)
    return F.coalesce((y > 0) & ~F.isnan(y) & (y != float("inf")), F.lit(False))


def shared_years(summary: DataFrame, key: str) -> DataFrame:
    """The years with a positive value in every place of the summary."""
    places = summary.agg(F.countDistinct(key).alias("places"))
    years = summary.where(_positive() & F.col("deal_year").isNotNull()).groupBy("deal_year").agg(F.countDistinct(key).alias("n"))
    return years.crossJoin(F.broadcast(places)).where("n = places").select("deal_year")


def rank_cities(summary: DataFrame, min_deals: int = 0, key: str = "city") -> DataFrame:
    """Change of each place between the first and last year that all places share; needs two."""
    s = summary.where((F.col("n_deals") >= min_deals) & F.col("deal_year").isNotNull()) if min_deals else summary.where("deal_year is not null")
    ends = shared_years(s, key).agg(F.min("deal_year").alias("first_year"), F.max("deal_year").alias("last_year")).where("first_year < last_year")
    at = s.crossJoin(F.broadcast(ends)).where(F.col("deal_year").between(F.col("first_year"), F.col("last_year")))
    pick = lambda end, c: F.max(F.when(F.col("deal_year") == F.col(end), F.col(c)))
    g = at.groupBy(key, "first_year", "last_year").agg(
        pick("first_year", "y").alias("first_value"), pick("last_year", "y").alias("last_value"), pick("first_year", "n_deals").alias("first_year_deals"),
        pick("last_year", "n_deals").alias("last_year_deals"), F.count("*").alias("years"), F.sum("n_deals").alias("total_deals"),
    )
    a, b = F.col("first_value"), F.col("last_value")
    g = g.withColumns({"absolute_change": compact(b - a), "pct_change": compact((b / a - 1) * 100), "avg_deals_per_year": compact(F.col("total_deals") / F.col("years"))})
    return g.orderBy(F.desc("pct_change"), key)


def city_cards(ranking: DataFrame, selected: int, key: str = "city") -> DataFrame:
    """One row: places chosen and ranked, the strongest change and the highest latest value."""
    best = F.min(F.struct((-F.col("pct_change")).alias("o"), key))
    high = F.min(F.struct((-F.col("last_value")).alias("o"), key))
    one = ranking.agg(F.count("*").alias("plotted"), best.alias("b"), high.alias("h"))
    return one.select(F.lit(selected).alias("selected"), "plotted", F.col(f"b.{key}").alias("strongest"), (-F.col("b.o")).alias("strongest_pct"), F.col(f"h.{key}").alias("highest"), (-F.col("h.o")).alias("highest_value"))


def comparison_period(summary: DataFrame, snapshot_year: int, bounds: tuple[float | None, float | None] = (None, None), include_partial: bool = False) -> DataFrame:
    """One row: first and last usable year and the years left out as unfinished."""
    years = summary.where("deal_year is not null").select(F.col("deal_year").cast("int").alias("y")).distinct()
    partial = F.col("y") >= snapshot_year
    ok = F.lit(True) if include_partial else ~partial
    if bounds[0] is not None:
        ok &= F.col("y") >= bounds[0]
    if bounds[1] is not None:
        ok &= F.col("y") <= bounds[1]
    one = years.agg(F.min(F.when(ok, F.col("y"))).alias("first_year"), F.max(F.when(ok, F.col("y"))).alias("last_year"), F.sort_array(F.collect_list(F.when(partial, F.col("y")))).alias("partial_years"))
    return one.select("first_year", "last_year", (F.col("last_year") - F.col("first_year")).alias("years_span"), "partial_years")


def growth(summary: DataFrame, period: DataFrame, min_deals: int = 5, keys: tuple[str, ...] = ("city", "gush")) -> DataFrame:
    """Yearly and total growth of places that have both endpoint years with enough deals, ranked.

    The rank follows the rounded yearly growth, then the place.
    """
    p = period.select("first_year", "last_year").where("first_year < last_year")
    rows = summary.crossJoin(F.broadcast(p)).where(F.col("deal_year").between(F.col("first_year"), F.col("last_year")))
    pick = lambda end, c: F.max(F.when(F.col("deal_year") == F.col(end), F.col(c)))
    g = rows.groupBy(*keys, "first_year", "last_year").agg(
        pick("first_year", "y").alias("first_y"), pick("last_year", "y").alias("last_y"), pick("first_year", "n_deals").alias("first_deals"), pick("last_year", "n_deals").alias("last_deals"),
        F.count("*").alias("year_count"), F.sum("n_deals").alias("total_deals"), F.median("n_deals").alias("median_deals"),
    )
    g = g.where((F.col("first_deals") >= min_deals) & (F.col("last_deals") >= min_deals) & _positive("first_y") & _positive("last_y"))
    ratio = F.col("last_y") / F.col("first_y")
    g = g.withColumns({"annualized_change": compact((F.pow(ratio, 1 / (F.col("last_year") - F.col("first_year"))) - 1) * 100), "price_change": compact((ratio - 1) * 100)})
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("annualized_change"), *keys)))


def pick_performers(ranked: DataFrame, top: int, typical: int, bottom: int) -> DataFrame:
    """The top ranks, the bottom ones of the rest from the last up, and the centre of what is between."""
    total = F.broadcast(ranked.agg(F.count("*").alias("total")))
    t = F.least(F.lit(top), F.col("total"))
    b = F.least(F.lit(bottom), F.col("total") - t)
    middle = F.col("total") - t - b
    m = F.least(F.lit(typical), middle)
    start = t + F.floor((middle - m) / 2)
    r = F.col("rank")
    group = F.when(r <= t, "top").when(r > F.col("total") - b, "bottom").when((r > start) & (r <= start + m), "typical")
    place = F.when(r <= t, r).when(r > F.col("total") - b, F.col("total") - r + 1).otherwise(r - start)
    return ranked.crossJoin(total).withColumns({"performance_group": group, "position_in_group": place.cast("int")}).where("performance_group is not null").drop("total")


def yoy(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Change from the year before that has a row, as a yearly rate over gaps."""
    w = W.partitionBy(*keys).orderBy("deal_year")
    rows = summary.where("deal_year is not null").select(*keys, F.col("deal_year").alias("to_year"), "y", F.lag("deal_year").over(w).alias("from_year"), F.lag("y").over(w).alias("previous_y"))
    gap = F.col("to_year") - F.col("from_year")
    rate = F.when(_positive() & _positive("previous_y") & (gap > 0), (F.pow(F.col("y") / F.col("previous_y"), 1 / gap) - 1) * 100)
    return rows.select(*keys, "from_year", "to_year", compact(F.col("previous_y")).alias("previous_y"), compact(F.col("y")).alias("current_y"), compact(rate).alias("yoy_pct_change"))


def index_overlay(yearly: DataFrame, index: DataFrame) -> DataFrame:
    """The first year's value carried on by an index; nothing where the index lacks that year."""
    first = yearly.where(F.col("y").isNotNull()).agg(F.min(F.struct("deal_year", "y")).alias("f"))
    i = index.select("year", "index_value")
    base = first.join(F.broadcast(i), F.col("f.deal_year") == F.col("year")).where("index_value > 0").select(F.col("f.y").alias("y0"), F.col("index_value").alias("i0"))
    years = yearly.select("deal_year").distinct().join(F.broadcast(i), F.col("deal_year") == F.col("year"))
    return years.crossJoin(F.broadcast(base)).select("deal_year", (F.col("y0") * F.col("index_value") / F.col("i0")).alias("y"))


def relative_series(series: DataFrame, key: str, mode: str = "indexed") -> DataFrame:
    """Values relative to the first year that is positive in every series."""
    if mode not in ("absolute", "indexed", "change"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "absolute":
        return series
    base = shared_years(series, key).agg(F.min("deal_year").alias("base_year")).where("base_year is not null")
    s = series.crossJoin(F.broadcast(base)).where("deal_year >= base_year")
    at = s.where("deal_year = base_year").select(F.col(key).alias("_k"), F.col("y").alias("_b"))
    r = F.col("y") / F.col("_b")
    value = r * 100 if mode == "indexed" else (r - 1) * 100
    return s.join(at, F.col(key) == F.col("_k")).select(key, "deal_year", "base_year", F.col("y").alias("raw_y"), F.round(value, 3).alias("y"))


def pack_series(summary: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series with its points in order of year."""
    return summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("deal_year", "n_deals", "y"))).alias("points"))


def top_categories(df: DataFrame, col: str, k: int, more: str = "more") -> DataFrame:
    """``category``: the first k values in natural order by name, all others in one, missing as itself."""
    kinds = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct()
    first = kinds.orderBy("_v").limit(k).withColumn("_own", F.lit(True))
    left = F.broadcast(kinds.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("_left")))
    label = F.when(F.col(col).isNull(), "missing").when(F.col("_own"), F.col(col)).otherwise(F.concat(F.lit(f"{more} ("), F.col("_left").cast("string"), F.lit(")")))
    return df.join(F.broadcast(first), F.col(col) == F.col("_v"), "left").crossJoin(left).withColumn("category", label).drop("_v", "_own", "_left")


def minmax_scale(df: DataFrame, col: str, low: float, high: float, constant: float) -> DataFrame:
    """``size``: the column stretched to ``low``..``high``; a constant column gets ``constant``."""
    ends = F.broadcast(df.agg(F.min(col).alias("_a"), F.max(col).alias("_b")))
    size = F.when(F.col("_a") == F.col("_b"), constant).otherwise(low + (F.col(col) - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low))
    return df.crossJoin(ends).withColumn("size", size).drop("_a", "_b")


def deal_classes(df: DataFrame, col: str = "n_deals") -> DataFrame:
    """``deal_class``: 0 to 4 by the column's share of its maximum: 5, 25, 50 and 75 %."""
    most = F.broadcast(df.agg(F.max(col).alias("_m")))
    share = F.col(col) / F.col("_m")
    return df.crossJoin(most).withColumn("deal_class", F.when(share < 0.05, 0).when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4)).drop("_m")
