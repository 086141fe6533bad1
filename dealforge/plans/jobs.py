"""Composed jobs: each takes tables and choices and returns its named DataFrames.

They are lazy, but for the quartiles of a global trimming and for the mix-adjusted index, which is made only if asked for.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, functions as F

from ..functions import clean, filters
from ..functions.filters import FilterSpec
from ..operators import addresses, flags, growth, linkage, outliers, quality, segments, summary
from ..sources import files, tables
from ..sources.stage import Outputs, staged


def deals_analysis(deals: DataFrame, spec: FilterSpec, kind: str = "price", sample: int = 2000, seed: int = 1, index: DataFrame | None = None, colour: str = "rooms", adjusted: bool = False) -> Outputs:
    """Population, yearly profile, distribution, segments, index, sample and overlays of a selection.

    The statistics cover the whole selection; the sample is drawn last.
    """
    place = deals.where(spec.location().column())
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_id")))
    rows = cache(lambda: outliers.trim(filters.apply_filters(place, spec.rest()), "deals", kind))
    yearly = cache(lambda: summary.yearly_values(rows(), kind))
    line = lambda: outliers.trim_by_year(filters.apply_filters(deals.where(FilterSpec(cities=spec.cities).column()), spec.rest()))
    out = {
        "funnel": lambda: summary.funnel(deals, {"place": spec.location().column(), "filters": replace(spec.rest(), share=spec.share or "full").column()}),
        "summary": lambda: summary.selection_summary(rows(), kind), "population": lambda: summary.population(rows(), kind), "annual": lambda: summary.annual_profile(rows(), kind),
        "distribution": lambda: summary.histogram(rows(), clean.price_metric(kind)), "segments": lambda: segments.segment_premium(rows()), "yearly": yearly, "city_line": lambda: summary.summarize(line(), ["city", "deal_year"]),
        "rows": lambda: segments.discretize(rows().where(clean.price_metric(kind).isNotNull()), colour).orderBy(order, "record_id").limit(sample),
    }
    if adjusted:
        out["index"] = lambda: segments.hedonic_index(rows())
    if index is not None:
        out["index_overlay"] = lambda: growth.index_overlay(yearly(), index)
    return Outputs(out)


def _metric_series(rows: DataFrame, keys: list[str], kind: str, stat: str) -> DataFrame:
    if kind == "n_deals":
        return rows.where("deal_year is not null").groupBy(*keys, "deal_year").agg(F.count("*").alias("n_deals"), F.count("*").cast("double").alias("y"))
    return summary.summarize(rows.where("deal_year is not null"), [*keys, "deal_year"], stat).select(*keys, "deal_year", "n_deals", F.col(f"{kind}_y").alias("y"))


def area_comparison(deals: DataFrame, descriptions: DataFrame, areas: DataFrame, spec: FilterSpec, kind: str = "price", stat: str = "median", index: DataFrame | None = None) -> Outputs:
    """Series of chosen blocks beside each other, with the line of their cities and an index laid over them."""
    chosen = deals.join(F.broadcast(areas.select("city", "gush").distinct()), ["city", "gush"], "left_semi")
    rows = cache(lambda: outliers.trim(filters.apply_filters(chosen, spec.rest()), "areas", kind))
    series = cache(lambda: linkage.with_label(_metric_series(rows(), ["city", "gush"], kind, stat), descriptions))
    cities = lambda: outliers.trim(filters.apply_filters(deals.join(F.broadcast(areas.select("city").distinct()), "city", "left_semi"), spec.rest()), "areas", kind)
    out = {"series": series, "packed": lambda: growth.pack_series(series(), ["city", "gush", "gush_label"]), "raw": rows, "city_line": lambda: _metric_series(cities(), ["city"], kind, stat)}
    if index is not None:
        out["index_overlay"] = lambda: growth.index_overlay(_metric_series(rows(), [], kind, stat), index)
    return Outputs(out)


def city_comparison(deals: DataFrame, spec: FilterSpec, kind: str = "price", stat: str = "median", min_deals: int = 0, skip_years: tuple[int, ...] = (), mode: str = "absolute") -> Outputs:
    """Series of cities, their ranking between two shared years and its cards."""
    rows = cache(lambda: outliers.trim(filters.apply_filters(filters.exclude_years(deals, list(skip_years)), spec), "cities", kind))
    series = cache(lambda: _metric_series(rows(), ["city"], kind, stat))
    ranking = cache(lambda: growth.rank_cities(series(), min_deals))
    return Outputs({"series": lambda: growth.relative_series(series(), "city", mode), "ranking": ranking, "cards": lambda: growth.city_cards(ranking(), len(spec.cities)), "raw": rows})


def gush_performance(deals: DataFrame, spec: FilterSpec, snapshot_year: int, kind: str = "price", stat: str = "median", min_deals: int = 5, picks: tuple[int, int, int] = (5, 5, 5), keys: tuple[str, ...] = ("city", "gush"), descriptions: DataFrame | None = None, index: DataFrame | None = None) -> Outputs:
    """Growth of blocks between the endpoints of the comparison period.

    With ``descriptions`` picks have labels and their series are packed; with ``index`` that index is
    laid over the yearly values. Lines and overlays keep to the years compared.
    """
    rows = cache(lambda: outliers.trim(filters.apply_filters(deals, spec), "gushes", kind))
    series = cache(lambda: _metric_series(rows(), list(keys), kind, stat))
    period = cache(lambda: growth.comparison_period(series(), snapshot_year, spec.years or (None, None)))
    ranked = cache(lambda: growth.growth(series(), period(), min_deals, keys))
    picked = cache(lambda: growth.pick_performers(ranked(), *picks))

    def within(df: DataFrame) -> DataFrame:
        years = period().select(F.col("first_year").alias("_a"), F.col("last_year").alias("_z"))
        return df.join(F.broadcast(years), F.col("deal_year").between(F.col("_a"), F.col("_z"))).drop("_a", "_z")

    def packed() -> DataFrame:
        shown = within(series()).join(picked().select(*keys, "performance_group", "rank"), list(keys))
        return growth.pack_series(linkage.with_label(shown, descriptions), [*keys, "gush_label", "performance_group", "rank"])

    out = {"series": series, "period": period, "ranking": ranked, "picks": picked, "yoy": lambda: growth.yoy(series(), list(keys)), "raw": rows, "city_line": lambda: _metric_series(within(rows()), ["city"], kind, stat)}
    if descriptions is not None:
        out |= {"picks": lambda: linkage.with_label(picked(), descriptions), "packed": packed}
    if index is not None:
        out["index_overlay"] = lambda: growth.index_overlay(_metric_series(within(rows()), [], kind, stat), index)
    return Outputs(out)


def filter_options(deals: DataFrame, spec: FilterSpec) -> dict[str, DataFrame]:
    """What the filters of a place may offer."""
    rows = deals.where(spec.location().column())
    return {"ranges": summary.column_ranges(rows), "rooms": summary.smart_rooms(rows), "types": summary.type_choices(rows), "counts": summary.filter_counts(rows, outliers.trim_by_year(rows))}


def scoped_export(rows: DataFrame, shown: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """An export of rows, only those of groups that a chart shows if it is given."""
    kept = rows if shown is None else filters.keep_groups(rows, shown, list(keys))
    return tables.export_columns(kept.withColumn("roof", F.when(clean.tri_state("roof"), "Yes").when(~clean.tri_state("roof"), "No").otherwise("")))


def _raw_export(rows: DataFrame) -> DataFrame:
    """Deals with their prices per m2 and room under a download's headers; all other columns follow."""
    roof = clean.tri_state("roof")
    out = rows.withColumns({"price_per_m2": clean.price_metric("per_m2"), "price_per_room": clean.price_metric("per_room"), "roof": F.when(roof, "Yes").when(~roof, "No").otherwise("")})
    return tables.export_columns(out, tables.RAW_HEADERS)


def _summary_export(rows: DataFrame, keys: list[str], kind: str, stat: str) -> DataFrame:
    got = summary.summarize(rows.where("deal_year is not null"), [*keys, "deal_year"], stat)
    value = F.col("n_deals").cast("double") if kind == "n_deals" else F.col(f"{kind}_y")
    return got.select(*keys, "deal_year", "n_deals", F.col("price_y").alias("price_millions"), F.col("per_m2_y").alias("price_per_m2"), F.col("per_room_y").alias("price_per_room"), value.alias("y"))


def scoped_exports(deals: DataFrame, descriptions: DataFrame, areas: DataFrame, spec: FilterSpec, snapshot_year: int, kind: str = "price", stat: str = "median", views: tuple[str, ...] = ("analysis", "compare", "cities", "gushes"), **choice) -> dict[str, DataFrame]:
    """The downloads of the asked views: the deals behind each and what it plots, each with its own trimming.

    Deals of the view of cities are those of plotted cities and years, deals of the view of blocks
    those of the chosen blocks within the compared years. ``choice`` goes to ``gush_performance``.
    """
    raws, plotted = {}, {}
    if "analysis" in views:
        raws["analysis"] = outliers.trim(filters.apply_filters(deals.where(spec.location().column()), spec.rest()), "deals", kind)
    if "compare" in views:
        raws["compare_raw"] = area_comparison(deals, descriptions, areas, spec, kind, stat)["raw"]
        plotted["compare_summary"] = linkage.with_label(_summary_export(raws["compare_raw"], ["city", "gush"], kind, stat), descriptions)
    if "cities" in views:
        cities = city_comparison(deals, spec, kind, stat)
        raws["cities_raw"] = filters.keep_groups(cities["raw"], cities["series"], ["city", "deal_year"])
        plotted["cities_summary"] = _summary_export(raws["cities_raw"], ["city"], kind, stat)
    if "gushes" in views:
        blocks, keys = gush_performance(deals, spec, snapshot_year, kind, stat, **choice), list(choice.get("keys", ("city", "gush")))
        plotted["gushes_summary"] = blocks["picks"]
        inside = blocks["raw"].join(blocks["picks"].select(*keys, "first_year", "last_year"), keys).where(F.col("deal_year").between(F.col("first_year"), F.col("last_year")))
        raws["gushes_raw"] = inside.drop("first_year", "last_year")
    return {n: _raw_export(d) for n, d in raws.items()} | {n: tables.export_columns(d, tables.SUMMARY_HEADERS) for n, d in plotted.items()}


def import_first(raw: DataFrame, existing: DataFrame | None = None, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Raw texts of the first source to deals and lookups; existing rows lose to new ones that say the same.

    Rows keep the order of their source rows; existing ones come after.
    """
    new = tables.transform_raw(raw, aliases).withColumn("seq", F.coalesce(F.regexp_extract("source_key", r"([0-9]+)$", 1).try_cast("long"), F.lit(0)))
    both = new if existing is None else tables.append_existing(new, existing.withColumn("seq", F.lit(-1)))
    deals = linkage.split_shared_gush(staged(linkage.dedupe(both).drop("seq")), counted=True)
    return {"deals": deals, "descriptions": tables.build_descriptions(deals), "streets": tables.build_streets(deals), "types": tables.build_types(deals), "coverage": summary.coverage(deals.withColumn("sale_portion", F.lit(None).cast("double")), ["city"])}


def import_second(raw: DataFrame, legacy: DataFrame, cutoff: str, types: list[str]) -> dict[str, DataFrame]:
    """Raw texts of the second source to deals, enriched where a sale is surely the same.

    Matching looks at all rows; the residential filter comes after it.
    """
    d = linkage.strict_enrich(tables.transform_raw2(raw), legacy)
    d = filters.import_valid(d, cutoff, types)
    d = staged(d.withColumn("quality_flags", clean.quality_flags(missing_address="full_address", missing_floor="floor", missing_area="area", missing_rooms="rooms")))
    return {"deals": d, "coverage": summary.coverage(d, ["city"]), "descriptions": tables.build_descriptions(d), "streets": tables.build_streets(d)}


def run_import_first(spark, paths: list[str], resources: dict[str, str], out: str, existing: DataFrame | None = None, aliases: dict[str, str] | None = None) -> None:
    """Read raw CSV files of the first source, transform them and publish deals, lookups and coverage, or nothing."""
    _publish(import_first(tables.read_raw_csv(spark, paths, resources), existing, aliases), out)


def run_import_second(spark, versions: list[dict], root: str, inventory: DataFrame, legacy: DataFrame, cutoff: str, types: list[str], out: str) -> None:
    """Check the files of the second source's latest version, transform, enrich and publish them, or nothing.

    Files that are missing, differ from the inventory or name several settlements refuse the import.
    """
    latest = max(versions, key=lambda v: v["version_number"])
    wrong = [r for name in latest["files"] for r in tables.check_files(spark, f"{root}/{name}", inventory.where(F.col("folder") == name).drop("folder")).take(5)]
    if wrong:
        raise files.Refused("; ".join(f"{r['file']}: {r['problem']}" for r in wrong))
    raw = tables.read_snapshot(spark, versions, root)
    if mixed := tables.one_settlement_per_file(raw).take(5):
        raise files.Refused("; ".join(f"{r['source_file']}: {r['settlements']} settlements" for r in mixed))
    _publish(import_second(raw, legacy, cutoff, types), out)


def _publish(made: dict[str, DataFrame], out: str) -> None:
    rest = {n: d for n, d in made.items() if n not in ("deals", "coverage")}
    tables.publish(made["deals"], made["coverage"], out, **rest)


def link_locations(current: DataFrame, legacy: DataFrame, key: str = "unit_key") -> dict[str, DataFrame]:
    linked = linkage.link_by_property(current, legacy, key)
    basis = linked.groupBy("city", "location_basis").agg(F.count("*").alias("rows"))
    return {"deals": linked, "basis": basis, "coverage": summary.coverage(linked, ["city"]), "descriptions": tables.build_descriptions(linked)}


def snapshot_quality(current: DataFrame, legacy: DataFrame, key: str, recent: int, cutoff: str = "2026-09-19") -> Outputs:
    """Profile of a snapshot, what it has beside an older source, and how far the two can be linked."""
    numbers = ["gush", "area", "rooms", "floor", "build_year", "sale_portion"]
    form = lambda df: quality.canonical(df, ["price_millions", "area"], ["deal_date"], ["gush_code", "city", "street"])
    extras = cache(lambda: quality.append_report(form(legacy), form(current), "city", "street", ["price_millions", "area", "deal_date", "gush_code", "street"], ["gush_code", "deal_date"]))
    waterfall = cache(lambda: quality.link_waterfall(legacy, current, linkage.strict_links(current, legacy), key))
    content = ["city", "gush_code", "deal_date", "price_millions"]
    return Outputs({
        "profile": lambda: quality.profile(current, ["city", "street", "roof", *numbers], numbers), "anomalies": lambda: quality.anomalies(current),
        "counts": lambda: quality.value_counts(current, [["city"], ["deal_year"], ["city", "deal_year"], ["apt_type"], ["sale_portion"]]),
        "duplicates": lambda: quality.duplicate_counts(current, content), "contents": lambda: quality.compare_sets(current, legacy, [*content, "area"]), "prices": lambda: quality.reconcile_prices(current, legacy, key),
        "sources": lambda: quality.compare_sources(current, legacy, recent, key), "snapshots": lambda: quality.compare_snapshots(legacy, current, ["city", "deal_year"]),
        "measures": lambda: flags.compare_flags(legacy, current, flags.deal_flags(COVERED, cutoff)), "candidates": lambda: quality.repeat_candidate_summary(legacy, current), "repeats": lambda: quality.multi_date_groups(current),
        "waterfall": lambda: waterfall().groupBy("reason").agg(F.count("*").alias("n")), "failures": lambda: quality.attribute_failures(waterfall()),
        **{f"append_{n}": lambda n=n: extras()[n] for n in ("counts", "places", "years", "samples", "repeats")},
    })


COVERED = ["city", "street", "gush", "gush_code", "full_address", "deal_date", "deal_year", "price_millions", "area", "rooms", "floor", "roof", "apt_type", "build_year", "building_age", "build_floors"]


def repeat_sales(rows: DataFrame, conditions: dict, key: str = "unit_key") -> dict[str, DataFrame]:
    whole = rows.where(list(conditions.values())[-1])
    return {"scopes": quality.repeat_sale_scopes(rows, conditions, key), "list": quality.repeat_sale_list(whole, key), "stable": quality.stable_profiles(whole, key), "consistent": quality.repeat_sales(quality.consistent_units(whole, key), key)}


def address_job(legacy: DataFrame, current: DataFrame, query: str, key: str = "unit_key", places: tuple[DataFrame, DataFrame] | None = None, city: str | None = None, chosen: tuple[float, ...] = (), **how) -> Outputs:
    """Lookup of an address, histories and pairs; with ``places`` (descriptions, polygons) and a city the map of its blocks."""
    history = cache(lambda: linkage.deal_history(current, legacy, key))
    out = {"history": history, "by_date": lambda: linkage.by_date(history(), key), "pairs": lambda: linkage.pair_parallel(current, legacy, key)}
    out["lookup"] = lambda: addresses.lookup_address(legacy, current, query, key, city, **how)
    if places is not None and city is not None:
        counts = current.where(F.col("city") == city).groupBy("gush").agg(F.count("*").alias("deals"))
        out["map"] = lambda: linkage.attach_polygons(places[0], places[1], city, list(chosen), counts)
    return Outputs(out)
