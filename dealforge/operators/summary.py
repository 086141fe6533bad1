"""Summaries of deals by place and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import cadastral_key, num, price_metric, tri_state
from ..functions.schema import UNKNOWN
from .quantiles import medians, quantiles

KINDS = ("price", "per_m2", "per_room")


def middle(stat: str):
    if stat not in ("median", "mean"):
        raise ValueError(f"no such statistic: {stat}")
    return F.median if stat == "median" else F.avg


def summarize(df: DataFrame, keys: list[str], stat: str = "median") -> DataFrame:
    """Deals and the middle of price, price per m2 and per room of each group."""
    if stat == "median":
        return medians(df, keys, {f"{k}_y": price_metric(k) for k in KINDS}).withColumnRenamed("rows", "n_deals")
    return df.groupBy(*keys).agg(F.count("*").alias("n_deals"), *[middle(stat)(price_metric(k)).alias(f"{k}_y") for k in KINDS])


def selection_summary(df: DataFrame, kind: str = "price") -> DataFrame:
    rooms = F.when(num("rooms") != UNKNOWN, num("rooms"))
    measured = {"median_price": price_metric(kind), "median_area": num("area"), "median_rooms": rooms}
    mids = medians(df, [], measured).drop("rows")
    rest = df.agg(
        F.count("*").alias("n_deals"),
        F.min("deal_year").alias("first_year"), F.max("deal_year").alias("last_year"), F.min("deal_date").alias("first_date"), F.max("deal_date").alias("last_date"),
        F.countDistinct("city").alias("cities"), F.countDistinct("street").alias("streets"), F.countDistinct("gush").alias("gushes"),
    )
    return rest.crossJoin(F.broadcast(mids)).select("n_deals", *measured, *rest.columns[1:])


def yearly_values(df: DataFrame, kind: str = "price", stat: str = "median") -> DataFrame:
    dated = df.where("deal_year is not null")
    if stat == "median":
        return medians(dated, ["deal_year"], {"y": price_metric(kind)}).withColumnRenamed("rows", "n_deals")
    return dated.groupBy("deal_year").agg(F.count("*").alias("n_deals"), middle(stat)(price_metric(kind)).alias("y"))


def _dated() -> Column:
    y = num("deal_year")
    return F.coalesce(y.between(1900, 2100) & (y % 1 == 0), F.lit(False))


def annual_profile(df: DataFrame, kind: str = "price", least: int = 10) -> DataFrame:
    """Every year from the first to the last that has deals, with quartiles of the valid prices."""
    rows = df.where(_dated()).select(F.col("deal_year").cast("int").alias("year"), price_metric(kind).alias("v"))
    years = rows.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    got = quantiles(rows, ["year"], "v", [0.25, 0.5, 0.75])
    got = got.select("year", F.col("rows").alias("deals"), F.col("n").alias("valid_prices"), *[F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))])
    out = years.join(got, "year", "left").na.fill(0, ["deals", "valid_prices"])
    return out.withColumn("low_sample", F.col("valid_prices") < least)


def histogram(df: DataFrame, value: Column, most: int = 30) -> DataFrame:
    """``(bin, low, high, count)``: equal bins, as many as the root of the values, the last one closed."""
    rows = df.select(value.alias("v")).where("v is not null")
    s = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).where("n > 0")
    s = s.withColumn("bins", F.when(F.col("a") == F.col("b"), 1).otherwise(F.least(F.lit(most), F.ceil(F.sqrt("n")))).cast("int"))
    # a constant gets a bin one wide around it
    s = s.withColumns({"lo": F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")), "hi": F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b"))})
    s = s.select("bins", "lo", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("w"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int"), F.col("bins") - 1)
    got = rows.crossJoin(F.broadcast(s)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    every = s.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    every = every.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"))
    return every.join(got, "bin", "left").na.fill(0, ["count"])


def population(df: DataFrame, kind: str = "price") -> DataFrame:
    v = price_metric(kind)
    q = quantiles(df.select(v.alias("v")), [], "v", [0.25, 0.5, 0.75])
    q = q.select(F.col("rows").alias("matching_deals"), F.col("n").alias("valid_price_deals"), (F.col("rows") - F.col("n")).alias("missing_price_deals"), *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))])
    out = df.agg(F.count_if(~_dated()).alias("undated_deals")).crossJoin(F.broadcast(q))
    return out.select("matching_deals", "valid_price_deals", "missing_price_deals", "undated_deals", "p25", "median", "p75")


def _range_columns() -> dict[str, tuple[Column, Column]]:
    """Each filterable number and whether a value of it is a usable one."""
    cols = {c: num(c) for c in ("price_millions", "area", "rooms", "floor", "deal_year", "build_year", "building_age", "build_floors")}
    cols["price_per_m2"] = price_metric("per_m2")
    usable = {c: v.isNotNull() for c, v in cols.items()}
    for c in ("rooms", "floor", "build_floors"):
        usable[c] = cols[c] != UNKNOWN
    usable["build_year"] = cols["build_year"] >= 1900
    usable["building_age"] = cols["building_age"] <= 150
    return {c: (v, F.coalesce(usable[c], F.lit(False))) for c, v in cols.items()}


def column_ranges(df: DataFrame) -> DataFrame:
    """``(name, min, max, count, special_count)`` of each filterable number, in one pass."""
    aggs = []
    for c, (v, ok) in _range_columns().items():
        good = F.when(ok, v)
        low, high = F.floor(F.min(good) * 1000) / 1000, F.ceil(F.max(good) * 1000) / 1000
        aggs.append(F.struct(F.lit(c).alias("name"), low.cast("double").alias("min"), high.cast("double").alias("max"), F.count(good).alias("count"), F.count_if(~ok).alias("special_count")).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in _range_columns()])))


def filter_counts(df: DataFrame, trimmed: DataFrame) -> DataFrame:
    """Rows before and after trimming, and what the roof column says."""
    roof = tri_state("roof")
    a = df.agg(F.count("*").alias("before"), F.count_if(roof).alias("roof_yes"), F.count_if(~roof).alias("roof_no"), F.count_if(roof.isNull()).alias("roof_unknown"))
    return a.crossJoin(trimmed.agg(F.count("*").alias("after")))


def type_choices(df: DataFrame) -> DataFrame:
    return df.select(F.trim("apt_type").alias("apt_type")).where("apt_type <> ''").distinct().orderBy("apt_type")


def smart_rooms(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The room numbers chosen by default: the commonest until they cover four fifths.

    Up to three kinds are all chosen. Else, in order of count, a kind follows while the one before
    was chosen and it is among the first two, within 80 %, or has 8 % itself; six at most.
    """
    by = by or []
    r = num("rooms")
    rows = df.where(r.isNotNull() & (r != UNKNOWN)).groupBy(*by, (F.bround(r * 2) / 2).alias("room")).agg(F.count("*").alias("n"))
    group = W.partitionBy(*by)
    order = group.orderBy(F.desc("n"), "room")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(group)
    rows = rows.withColumns({"place": F.row_number().over(order), "kinds": F.count("*").over(group), "share": F.col("n") * 100 / total, "upto": F.sum("n").over(upto) * 100 / total})
    ok = (F.col("place") <= 2) | (F.col("upto") <= 80) | (F.col("share") >= 8)
    rows = rows.withColumn("chain", F.min(ok.cast("int")).over(upto))
    return rows.where((F.col("kinds") <= 3) | ((F.col("chain") == 1) & (F.col("place") <= 6))).select(*by, "room", "n", "place")


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """What is known of each group's rows; of scraping, enrichment and linkage where the table tells."""
    p = num("sale_portion")
    more = []
    if "scraped_at" in df.columns:
        more += [F.min("scraped_at").alias("scraped_from"), F.max("scraped_at").alias("scraped_to")]
    if "legacy_match" in df.columns:
        more.append(F.count_if(F.col("legacy_match") == "strict_transaction").alias("enriched_transactions"))
    if "location_basis" in df.columns:
        more.append(F.count_if(F.col("location_basis") == "property_reference").alias("linked_locations"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("deal_date").alias("first_date"), F.max("deal_date").alias("last_date"),
        F.count_if(p == 1).alias("full_sales"), F.count_if((p > 0) & (p < 1)).alias("partial_sales"), F.count_if(p.isNull() | (p <= 0) | (p > 1)).alias("unknown_share"),
        F.count_if(blank("full_address")).alias("missing_address"), F.count_if(num("floor").isNull() | (num("floor") == UNKNOWN)).alias("missing_floor"),
        F.count_if(num("area").isNull()).alias("missing_area"), F.count_if(num("rooms").isNull()).alias("missing_rooms"), F.count_if(cadastral_key("gush_code").isNull()).alias("missing_key"), *more,
    )


def coverage_pct(cov: DataFrame) -> DataFrame:
    """Shares of the rows in per cent, to one decimal."""
    parts = [c for c in cov.columns if c in ("full_sales", "partial_sales", "unknown_share") or c.startswith("missing_")]
    return cov.select(*[c for c in cov.columns if c not in parts], *[F.bround(F.col(c) * 100.0 / F.col("rows"), 1).alias(f"{c}_pct") for c in parts])


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """``(place, stage, rows)``: rows left after each condition and all before it, in one pass."""
    aggs, ok = [F.count("*").alias("_all")], F.lit(True)
    for i, c in enumerate(stages.values()):
        ok &= F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(ok).alias(f"_{i}"))
    names = [F.struct(F.lit(0).alias("place"), F.lit("all").alias("stage"), F.col("_all").alias("rows"))]
    names += [F.struct(F.lit(i + 1).alias("place"), F.lit(s).alias("stage"), F.col(f"_{i}").alias("rows")) for i, s in enumerate(stages)]
    return df.agg(*aggs).select(F.inline(F.array(*names)))
