"""Profiles of snapshots, repeat sales and comparisons of sources."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.clean import num
from ..sources.stage import Outputs, staged
from .flags import count_flags
from .linkage import unique_by


def profile(df: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    """``(name, missing, zero, negative)`` of each column, in one pass; texts have no zeros."""
    aggs = []
    for c in columns:
        v = num(c)
        blank = F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
        zero, negative = (F.count_if(v == 0), F.count_if(v < 0)) if c in numbers else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        aggs.append(F.struct(F.lit(c).alias("name"), F.count_if(blank).alias("missing"), zero.alias("zero"), negative.alias("negative")).alias(f"_{c}"))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{c}") for c in columns])))


def anomalies(df: DataFrame) -> DataFrame:
    """Counts of suspect rows and classes of shares, in one row."""
    p, y = num("sale_portion"), num("deal_year")
    return df.agg(
        F.count("*").alias("rows"), F.count_if(p == 1).alias("full"), F.count_if((p > 0) & (p < 1)).alias("partial"), F.count_if(p.isNull()).alias("unknown"), F.count_if(F.col("gush_code").endswith("-0")).alias("sub_parcel_zero"),
        F.count_if(num("build_year") > y).alias("built_after_deal"), F.count_if(num("area") > 1000).alias("large"), F.count_if(num("rooms") > 20).alias("many_rooms"),
        F.min("deal_date").alias("first_date"), F.max("deal_date").alias("last_date"),
    )


def value_counts(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """``(name, value, n)`` of each list of columns, its values joined by a bar."""
    out = None
    for cols in groups:
        v = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
        g = df.groupBy(F.lit("+".join(cols)).alias("name"), v.alias("value")).agg(F.count("*").alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


def duplicate_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, distinct contents, rows beyond the first of each, and rows whose content recurs."""
    g = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("unique"), (F.sum("n") - F.count("*")).alias("excess"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected"))


def compare_sets(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct contents that both tables have, and that only one has."""
    x, y = a.select(*cols).distinct().withColumn("a", F.lit(1)), b.select(*cols).distinct().withColumn("b", F.lit(1))
    same = x.unionByName(y, allowMissingColumns=True).groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return same.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


def canonical(df: DataFrame, numbers: list[str], dates: list[str], others: list[str]) -> DataFrame:
    """Numbers as doubles, dates as ISO, texts trimmed."""
    return df.select(*[num(c).alias(c) for c in numbers], *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in dates], *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in others])


def append_extras(snapshot: DataFrame, append: DataFrame, loose: list[str], weak: list[str]) -> DataFrame:
    """Rows of ``append`` that the snapshot lacks, and how near they come to one it has.

    ``loose`` are the columns without the place code, ``weak`` those of property and day.
    """
    cols = snapshot.columns
    same = F.lit(True)
    s = snapshot.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    extra = append.select(*cols).join(s, same, "left_anti")
    near = snapshot.select(*loose).distinct().withColumn("_loose", F.lit(True))
    day = snapshot.select(*weak).distinct().withColumn("_weak", F.lit(True))
    out = extra.join(near, loose, "left").join(day, weak, "left")
    kind = F.when(F.col("_loose"), "same_but_place").when(F.col("_weak"), "same_property_day").otherwise("none")
    return out.select(*cols, kind.alias("nearness"), F.coalesce("_weak", F.lit(False)).alias("property_day"))


def append_report(snapshot: DataFrame, append: DataFrame, place: str, name: str, loose: list[str], weak: list[str], day: str = "deal_date", samples: int = 20) -> Outputs:
    """What an append export has beyond a snapshot: counts, places, years, samples of each kind, and repeated contents.

    Both tables are canonical. ``place`` is the code of a place, which may be missing, ``name`` its
    name. Samples are the rows of least digest, so they do not depend on order; the ranks of a group
    are cut in each task before the shuffle.
    """
    cols = snapshot.columns
    extras = cache(lambda: staged(append_extras(snapshot, append, loose, weak)))
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    rank = F.row_number().over(W.partitionBy("nearness").orderBy("digest", *cols))
    match = F.col("nearness") == "same_but_place"
    flags = {"matching_without_place": match, "unmatched_without_place": ~match, "missing_place": F.coalesce(F.trim(place), F.lit("")) == "", "known_property_day": F.col("property_day"), "new_property_day": ~F.col("property_day")}

    def repeats() -> DataFrame:
        whole = append.groupBy(*cols).agg(F.count("*").alias("n"))
        part = whole.groupBy(*loose).agg(F.count("*").alias("u"), F.sum("n").alias("n"))
        one = lambda of, u: F.struct(F.lit(of).alias("content"), u.alias("unique"), F.coalesce(F.sum("n") - u, F.lit(0)).alias("excess"))
        return part.agg(F.array(one("all", F.coalesce(F.sum("u"), F.lit(0))), one("without_place", F.count("*"))).alias("r")).select(F.inline("r"))

    return Outputs({
        "counts": lambda: count_flags(extras(), flags), "places": lambda: extras().groupBy(place, name).agg(F.count("*").alias("extra_rows")), "years": lambda: extras().groupBy(F.year(F.col(day).cast("date")).alias("year")).agg(F.count("*").alias("extra_rows")),
        "samples": lambda: extras().withColumn("digest", digest).withColumn("rank", rank).where(F.col("rank") <= samples).drop("property_day"), "repeats": repeats,
    })


def repeat_sales(df: DataFrame, key: str = "unit_key") -> DataFrame:
    """One row of counts: a property sold twice on a day counts once for that day."""
    per, _ = _per_property(df, key)
    n, y = F.col("dates"), F.col("years")
    return per.agg(
        F.sum("rows").alias("rows"), F.sum("dates").alias("property_dates"), (F.sum("rows") - F.sum("dates")).alias("collapsed"), F.count("*").alias("properties"), F.count_if(n >= 2).alias("dates_2plus"), F.count_if(n >= 3).alias("dates_3plus"),
        F.count_if(n == 2).alias("dates_exactly_2"), F.count_if(y >= 2).alias("years_2plus"), F.count_if(y >= 3).alias("years_3plus"), F.max("dates").alias("most_dates"),
    )


def _per_property(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    events = df.where(F.col(key).isNotNull()).groupBy(key, "deal_date").agg(F.count("*").alias("n"))
    per = events.groupBy(key).agg(F.sum("n").alias("rows"), F.count("*").alias("dates"), F.countDistinct(F.year("deal_date")).alias("years"), F.min("deal_date").alias("first_date"), F.max("deal_date").alias("last_date"))
    return per, events


def repeat_sale_list(df: DataFrame, key: str = "unit_key") -> DataFrame:
    """Properties sold on two days or more."""
    return _per_property(df, key)[0].where("dates >= 2").select(key, "dates", "first_date", "last_date")


def repeat_sale_distribution(df: DataFrame, key: str = "unit_key") -> DataFrame:
    return _per_property(df, key)[0].groupBy("dates").agg(F.count("*").alias("properties"))


def scopes(residential: Column, apartment: Column) -> dict[str, Column]:
    """The five scopes of repeat sales; amounts must be positive but for the first."""
    paid, whole = num("price_millions") > 0, num("sale_portion") == 1
    return {"all": F.lit(True), "residential": residential & paid, "residential_whole": residential & paid & whole, "apartments": apartment & paid, "apartments_whole": apartment & paid & whole}


def repeat_sale_scopes(df: DataFrame, conditions: dict[str, Column], key: str = "unit_key") -> DataFrame:
    out = None
    for name, cond in conditions.items():
        one = repeat_sales(df.where(cond), key).withColumn("scope", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def city_conflicts(df: DataFrame, key: str = "unit_key") -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct("city").alias("n")).where("n > 1").select(key)


def stable_profiles(df: DataFrame, key: str = "unit_key") -> DataFrame:
    """Per property the most sale days of one (area, rooms) profile; keys of several cities are left out."""
    clean = df.where((num("area") > 0) & (num("rooms") > 0)).join(city_conflicts(df, key), key, "left_anti")
    return clean.groupBy(key, "area", "rooms").agg(F.countDistinct("deal_date").alias("dates")).groupBy(key).agg(F.max("dates").alias("dates"))


def consistent_units(df: DataFrame, key: str = "unit_key") -> DataFrame:
    """The rows of properties whose rows all have one positive area and number of rooms."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{p}") for c in ("area", "rooms") for p, f in (("n", F.count), ("d", F.countDistinct), ("min", F.min))])
    ok = F.lit(True)
    for c in ("area", "rooms"):
        ok &= (F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_d") == 1) & (F.col(f"{c}_min") > 0)
    return df.join(g.where(ok).select(key).join(city_conflicts(df, key), key, "left_anti"), key, "left_semi")


def reconcile_prices(current: DataFrame, legacy: DataFrame, key: str = "unit_key", by: str = "city") -> DataFrame:
    """Per place and share class: one-to-one matches whose amounts, and declared ones if there are, agree within steps."""
    on = [by, key, "deal_date"]
    declared = "declared_amount" in current.columns
    a = unique_by(legacy.select(*on, (num("price_millions") * 1e6).alias("old")), on)
    b = unique_by(current.select(*on, (num("price_millions") * 1e6).alias("new"), num("sale_portion").alias("p"), (num("declared_amount") if declared else F.lit(None).cast("double")).alias("declared")), on)
    m = a.join(b, on).withColumn("portion_group", F.when(F.col("p") == 1, "whole").when((F.col("p") > 0) & (F.col("p") < 1), "partial").when(F.col("p") == 0, "zero")).where("portion_group is not null")

    def grid(c: str, prefix: str) -> list[Column]:
        gap = F.abs(F.col("old") - F.col(c))
        scaled = F.abs(F.col("old") - F.try_divide(F.col(c), F.when(F.col("p") > 0, F.col("p"))))
        return [*[F.count_if(gap <= t).alias(f"{prefix}within_{t}") for t in (1, 500, 1000)], F.count_if(scaled <= 1000).alias(f"{prefix}by_portion_within_1000")]

    return m.groupBy(by, "portion_group").agg(F.count("*").alias("candidates"), *grid("new", ""), *(grid("declared", "declared_") if declared else []))


def compare_sources(current: DataFrame, legacy: DataFrame, recent: int, key: str = "unit_key", by: str = "city") -> DataFrame:
    """Per place: rows and recent rows of both, key matches, equal amounts, and new days of known units."""
    side = lambda df, p: df.groupBy(by).agg(F.count("*").alias(f"{p}_rows"), F.count_if(F.col("deal_year") >= recent).alias(f"{p}_recent"), F.max("deal_date").alias(f"{p}_last"))
    on = [by, key, "deal_date"]
    known = legacy.where(F.col(key).isNotNull()).select(by, key).distinct().withColumn("_unit", F.lit(True))
    days = legacy.where(F.col(key).isNotNull()).groupBy(*on).agg(F.min("price_millions").alias("_lo"), F.max("price_millions").alias("_hi"))
    m = current.where(F.col(key).isNotNull()).join(days, on, "left").join(known, [by, key], "left")
    there = F.col("_lo").isNotNull()
    equal = there & (F.abs(num("price_millions") - F.col("_lo")) <= 0.001) & (F.col("_lo") == F.col("_hi"))
    met = m.groupBy(by).agg(F.count_if(there).alias("key_matches"), F.count_if(F.coalesce(equal, F.lit(False))).alias("equal_amounts"), F.count_if(F.col("_unit") & ~there).alias("known_unit_new_day"))
    multi = current.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.countDistinct("deal_date").alias("d")).groupBy(by).agg(F.count_if(F.col("d") > 1).alias("multi_date_units"))
    return side(current, "current").join(side(legacy, "legacy"), by, "full").join(met, by, "left").join(multi, by, "left")


def link_waterfall(legacy: DataFrame, current: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Each legacy row and why it is or is not linked; of several reasons the later in the list holds.

    ``linked`` has the ``legacy_record_id`` of linked rows; ``key`` is null for an invalid one. Where
    ``linked`` has city, key and date too, of which it has one row each, it is met by them as all else is.
    """
    on = ["city", key, "deal_date"]
    facts = [F.max(num(c)).alias(f"_n_{c}") for c in ("price_millions", "area", "rooms", "build_year")]  # of the only row, where it is one
    new = current.where(F.col(key).isNotNull()).groupBy(*on).agg(F.count("*").alias("_new"), F.max("sale_portion").alias("_p"), *facts)
    if key in linked.columns:
        done = linked.select(*on, F.col("legacy_record_id").alias("_linked"))
        m = legacy.join(new, on, "left").join(done, on, "left").withColumn("_done", F.col("_linked") == F.col("record_id")).drop("_linked")
        # rows without a key, date or city have no such count
        m = m.withColumn("_old", F.when(F.col("_new").isNotNull(), F.count("*").over(W.partitionBy(*on, F.when(F.col("_new").isNull(), F.col("record_id"))))))
    else:
        old = legacy.where(F.col(key).isNotNull()).groupBy(*on).agg(F.count("*").alias("_old"))
        done = linked.select(F.col("legacy_record_id").alias("record_id")).distinct().withColumn("_done", F.lit(True))
        m = legacy.join(new, on, "left").join(old, on, "left").join(done, "record_id", "left")
    reason = (
        F.when(F.col("_done"), "enriched").when(F.col(key).isNull(), "invalid_key").when(F.col("_new").isNull(), "no_key_and_date").when(F.col("_new") > 1, "new_key_ambiguous")
        .when(F.col("_old") > 1, "legacy_key_ambiguous").when(F.col("_p").isNull() | (F.col("_p") != 1), "share_not_full").otherwise("attributes_disagree")
    )
    return m.withColumn("reason", reason)


def attribute_failures(waterfall: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of ``link_waterfall``'s rows whose attributes disagree: how many fail in each; a row may fail in several."""
    pair = lambda c: (num(c), F.col(f"_n_{c}"))
    (p0, p1), (a0, a1), (r0, r1), (y0, y1) = (pair(c) for c in ("price_millions", "area", "rooms", "build_year"))
    off = lambda x, y: x.isNull() | y.isNull() | (x <= 0) | (y <= 0)
    failed = {"price": F.abs(p0 - p1) * 1e6 > 1000.001, "area": off(a0, a1) | (F.abs(a0 - a1) > 0.5), "rooms": off(r0, r1) | (F.abs(r0 - r1) >= 0.001), "year": (y0 > 0) & (y1 > 0) & (y0 != y1)}
    return count_flags(waterfall.where(F.col("reason") == "attributes_disagree"), failed, by)


def compare_snapshots(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group in both snapshots and the difference."""
    a, b = old.groupBy(*by).agg(F.count("*").alias("old_rows")), new.groupBy(*by).agg(F.count("*").alias("new_rows"))
    out = a.join(b, by, "full").na.fill(0, ["old_rows", "new_rows"])
    return out.withColumn("difference", F.col("new_rows") - F.col("old_rows"))


def repeat_candidates(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose property is in the old source, but not on that day."""
    for k in key:
        new, old = new.where(F.col(k).isNotNull()), old.where(F.col(k).isNotNull())
    return new.join(old.select(*key).distinct(), key, "left_semi").join(old.select(*key, "deal_date").distinct(), [*key, "deal_date"], "left_anti")


#: Keys of a property from strict to loose, by columns of a deal; ``parcel`` is its code without the last part.
DEFINITIONS = {
    "strict": ["city", "gush_code", "full_address", "area", "rooms", "floor", "apt_type", "build_year"], "unit_like": ["city", "gush_code", "area", "rooms", "floor", "apt_type", "build_year"], "address_like": ["city", "gush_code", "full_address"],
    "parcel_street": ["city", "parcel", "street"], "parcel_address": ["city", "parcel", "full_address"], "parcel_unit_like": ["city", "parcel", "area", "rooms", "floor", "apt_type", "build_year"],
}


def with_parcel(df: DataFrame) -> DataFrame:
    return df.withColumn("parcel", F.regexp_extract("gush_code", r"^([^-]+-[^-]+)-[^-]+$", 1)).withColumn("parcel", F.nullif("parcel", F.lit("")))


def repeat_candidate_summary(old: DataFrame, new: DataFrame, definitions: dict[str, list[str]] = DEFINITIONS) -> DataFrame:
    """``(definition, candidate_rows, cities)`` of ``repeat_candidates`` under each definition.

    Rows are shuffled once by what all definitions have in common: those that say the same under one of
    them then lie together, and are counted there. A code tells its parcel, so it stands for both.
    """
    wide = [{*key, *(["_place"] if {"gush_code", "parcel"} & {*key} else [])} for key in definitions.values()]
    common = sorted(set.intersection(*wide))
    columns = sorted({c for key in definitions.values() for c in key} | {"city", "deal_date"})
    side = lambda df, is_new: with_parcel(df).withColumn("_place", F.coalesce("parcel", "gush_code")).select(*columns, "_place", F.lit(is_new).alias("_new"))
    both = side(old, False).unionByName(side(new, True))
    out = both.repartition(*common) if common else both
    for i, key in enumerate(definitions.values()):
        full = F.lit(True)
        for c in key:
            full &= F.col(c).isNotNull()
        known, group = F.count_if(~F.col("_new")), [*common, *[c for c in key if c not in common]]
        there, day = known.over(W.partitionBy(*group)) > 0, (known.over(W.partitionBy(*group, "deal_date")) > 0) & F.col("deal_date").isNotNull()
        out = out.withColumn(f"_c{i}", F.col("_new") & full & there & ~day)
    sums = out.groupBy("city").agg(*[F.count_if(f"_c{i}").alias(f"_c{i}") for i in range(len(definitions))])
    one = lambda i, name: F.struct(F.lit(name).alias("definition"), F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias("candidate_rows"), F.count_if((F.col(f"_c{i}") > 0) & F.col("city").isNotNull()).alias("cities"))
    return sums.agg(F.array(*[one(i, name) for i, name in enumerate(definitions)]).alias("r")).select(F.inline("r"))


def multi_date_groups(df: DataFrame, definitions: dict[str, list[str]] = DEFINITIONS) -> DataFrame:
    """``(definition, groups, cities, sale_days)``: properties sold on several days within one source; keys without nulls."""
    df, out = with_parcel(df), None
    for name, key in definitions.items():
        known = df.dropna(subset=[*key, "deal_date"])
        days = known.select(*key, "deal_date").distinct().groupBy(*key).agg(F.count("*").alias("days")).where("days > 1")
        one = days.agg(F.lit(name).alias("definition"), F.count("*").alias("groups"), F.countDistinct("city").alias("cities"), F.coalesce(F.sum("days"), F.lit(0)).alias("sale_days"))
        out = one if out is None else out.unionByName(one)
    return out
