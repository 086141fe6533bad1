"""Counts of overlapping conditions: rows are counted once by a bit mask, whatever the number of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import num, parse_date

#: Conditions of one mask, a long without its sign.
MOST = 63


def flag_masks(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``(*by, mask, n)``: rows of each group that meet exactly the conditions of the mask; null is not met."""
    if len(flags) > MOST:
        raise ValueError(f"more than {MOST} conditions")
    mask = F.lit(0).cast("long")
    for i, c in enumerate(flags.values()):
        mask = mask.bitwiseOR(F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.select(*(by or []), mask.alias("mask")).groupBy(*(by or []), "mask").agg(F.count("*").alias("n"))


def overlapping(masks: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``(*by, measure, n, pct)``: rows that meet each condition, ``rows`` for all of them; a row may count often."""
    keys = by or []
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    sums = [total.alias("_all")] + [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("n"))), F.lit(0)).cast("long").alias(f"_{i}") for i in range(len(flags))]
    each = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).alias("n")) for name, c in zip(["rows", *flags], ["_all", *[f"_{i}" for i in range(len(flags))]], strict=True)])
    out = masks.groupBy(*keys).agg(*sums).select(*keys, "_all", F.inline(each))
    return out.select(*keys, "measure", "n", F.bround(F.try_divide(F.col("n") * 100.0, F.col("_all")), 2).alias("pct"))


def count_flags(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    return overlapping(flag_masks(df, flags, by), flags, by)


#: Numbers of a raw snapshot of the second source, and what counts as odd in them.
RAW_NUMBERS = ("gush", "chelka", "sub_chelka", "deal_amount", "declared_amount", "portion", "year_built", "asset_area", "room_num")
FIRST_DAY, LARGE_AREA, MANY_ROOMS = "1998-01-01", 1000, 20


def raw_flags(columns: list[str], cutoff: str, residential: list[str]) -> dict[str, Column]:
    """The measures of a raw snapshot: numbers, dates, shares, contradictions and rows fit for use.

    Numbers and the day are read once, as ``_<name>`` and ``_day`` (``raw_profile``).
    """
    v = {c: F.col(f"_{c}") for c in RAW_NUMBERS}
    day, last = F.col("_day"), F.lit(cutoff).cast("date")
    share, home = v["portion"], F.col("deal_nature").isin(residential)
    usable = home & (share == 1) & (day <= last) & (v["deal_amount"] > 0) & (v["asset_area"] > 0)
    out = {"invalid_date": day.isNull(), "future_deal_date": day > last, "before_1998": day < F.lit(FIRST_DAY).cast("date")}
    for c in RAW_NUMBERS:
        out |= {f"{c}_missing_or_unparseable": v[c].isNull(), f"{c}_zero": v[c] == 0, f"{c}_negative": v[c] < 0}
    out |= {
        "partial_portion_0_to_1": (share > 0) & (share < 1), "whole_portion_1": share == 1, "portion_above_1": share > 1,
        "amounts_differ": v["deal_amount"].isNull() | v["declared_amount"].isNull() | (v["deal_amount"] != v["declared_amount"]),
        "subparcel_zero_or_missing": F.coalesce(v["sub_chelka"], F.lit(0.0)) == 0, "year_built_after_deal": v["year_built"] > F.year(day), "year_built_after_cutoff_year": v["year_built"] > F.year(last),
        "area_above_1000": v["asset_area"] > LARGE_AREA, "rooms_above_20": v["room_num"] > MANY_ROOMS, "residential_types_rows": home, "residential_rooms_positive": home & (v["room_num"] > 0),
        "whole_residential_positive_area_price_valid_date": usable, "whole_residential_usable_with_rooms": usable & (v["room_num"] > 0),
    }
    return out | {f"{c}_blank": F.coalesce(F.trim(c), F.lit("")) == "" for c in columns}


def raw_profile(raw: DataFrame, cutoff: str, residential: list[str], blanks: list[str] = ("settlement_code", "settlement", "deal_date", "deal_nature"), by: list[str] | None = None) -> DataFrame:
    """``(*by, measure, n, pct)`` of a raw snapshot, in one pass over its rows."""
    read = raw.withColumns({f"_{c}": num(c) for c in RAW_NUMBERS} | {"_day": parse_date("deal_date", "dd/MM/yyyy")})
    return count_flags(read, raw_flags(list(blanks), cutoff, residential), by)


def raw_extrema(raw: DataFrame) -> DataFrame:
    """First and last valid day of sale and time of scraping."""
    day, at = parse_date("deal_date", "dd/MM/yyyy"), F.try_to_timestamp("scraped_at")
    return raw.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.min(at).alias("scraped_from"), F.max(at).alias("scraped_to"))


def deal_flags(fields: list[str], cutoff: str) -> dict[str, Column]:
    """Coverage of fields, and what is odd in deals of either source."""
    filled = {f"has_{c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in fields}
    return filled | {
        "area <= 0": num("area") <= 0, "area > 1000": num("area") > LARGE_AREA, "rooms <= 0": num("rooms") <= 0, "rooms > 20": num("rooms") > MANY_ROOMS, "price <= 0": num("price_millions") <= 0,
        "build_year after deal": num("build_year") > num("deal_year"), "date after cutoff": F.col("deal_date") > F.lit(cutoff).cast("date"), "no date": F.col("deal_date").isNull(),
    }


def compare_flags(old: DataFrame, new: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Each measure of both snapshots, per group: ``old_n``, ``new_n``, their shares and the difference."""
    keys = by or []
    side = lambda df, name: count_flags(df, flags, keys).select(*keys, "measure", F.lit(name).alias("_s"), "n", "pct")
    both = side(old, "old").unionByName(side(new, "new"))
    of = lambda s, c: F.max(F.when(F.col("_s") == s, F.col(c)))
    out = both.groupBy(*keys, "measure").agg(*[of(s, c).alias(f"{s}_{c}") for c in ("n", "pct") for s in ("old", "new")])
    return out.na.fill(0, ["old_n", "new_n"]).withColumn("difference", F.col("new_n") - F.col("old_n"))
