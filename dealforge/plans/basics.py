"""Queries of cleaning, filters, outliers and summaries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, filters
from ..functions.filters import FilterSpec
from ..operators import outliers, summary
from .fixtures import WITH, deals
from .registry import register

# SQL forms of the metrics, for the oracles
PLAUSIBLE = "(coalesce(area between 15 and 1000, false) and not coalesce(rooms > 0 and rooms < 20 and area < rooms * 8, false))"
PER_M2 = f"case when {PLAUSIBLE} then price_millions * 1000 / area end"
PER_ROOM = "case when rooms > 0 and rooms <> 999 then price_millions / rooms end"
HALF = "round_even(rooms * 2, 0) / 2"
KNOWN_ROOMS = "coalesce(rooms <> 999, false)"
TRI = "case when lower(trim(roof)) in ('true', 'yes') then true when lower(trim(roof)) in ('false', 'no') then false end"
KEY = "case when cast(split_part(gush_code, '-', 3) as int) > 0 then gush_code end"
ID = "record_id"


def column_query(name: str, columns, sql: str) -> None:
    """A projection of the deals."""

    def q(spark, sf_dir):
        return deals(spark, sf_dir).select(ID, *[c.alias(n) for n, c in columns().items()])

    register(name, f"{WITH} select record_id, {sql} from deals")(q)


column_query("B01_num", lambda: {"v": clean.num(F.concat(F.col("area").cast("string"), F.when(F.col("gush") == 2, "x").otherwise("")))}, "case when gush = 2 then null else area end as v")
column_query("B02_parse_number", lambda: {"v": clean.parse_number(F.concat(F.lit("₪ 1,2"), F.col("gush").cast("int").cast("string"), F.lit(".5 NIS")))}, "cast('12' || cast(cast(gush as int) as varchar) || '.5' as double) as v")
column_query("B03_parse_date", lambda: {"a": clean.parse_date(F.date_format("deal_date", "dd.MM.yyyy")), "b": clean.parse_date(F.date_format("deal_date", "dd/MM/yyyy")), "c": clean.parse_date(F.concat(F.lit("31/31/"), F.col("deal_year").cast("int")))}, "deal_date as a, deal_date as b, cast(null as date) as c")
column_query("B04_clean_text", lambda: {"v": clean.clean_text(F.concat(F.lit("  "), F.when(F.col("roof") == "TRUE", F.col("street")).otherwise(" ")))}, "case when roof = 'TRUE' then street end as v")
column_query("B05_city_name", lambda: {"v": clean.city_name("city", {"NATION_1": "First", "NATION_2": "Second"})}, "case city when 'NATION_1' then 'First' when 'NATION_2' then 'Second' else city end as v")
column_query("B06_gush_of", lambda: {"v": clean.gush_of("gush_code")}, "gush as v")
column_query("B09_first_nonempty", lambda: {"v": F.coalesce("roof", "apt_type")}, "coalesce(roof, apt_type) as v")
column_query("B10_address", lambda: {"v": clean.address_of(F.when(F.col("roof").isNotNull(), F.col("street")), "city")}, "case when roof is null then city else street || ', ' || city end as v")
column_query("B11_roof_flag", lambda: {"v": clean.roof_flag("apt_type", "street", "floor", F.col("floor") + 1, "build_floors", ["PROMO"], "red")}, "coalesce(apt_type = 'PROMO', false) or coalesce(contains(street, 'red'), false) or coalesce(floor = build_floors, false) or coalesce(floor + 1 = build_floors, false) as v")
column_query("B12_new_project", lambda: {"v": clean.new_project_flag("roof", "build_year", "deal_year")}, "case when coalesce(roof = 'TRUE', false) or coalesce(build_year >= deal_year, false) then 'New Project' else '2nd hand' end as v")
column_query("B13_building_age", lambda: {"v": clean.building_age("deal_year", F.when(F.col("gush") > 20, F.col("build_year")), "build_year")}, "deal_year - build_year as v")
column_query("B14_source_key", lambda: {"v": clean.source_key(F.when(F.col("gush") > 5, F.lit("r")), F.when(F.col("gush") > 5, F.col("source_key")))}, "case when gush > 5 then 'r:' || source_key end as v")
column_query("B15_story", lambda: {"v": clean.story(year="deal_year", type="apt_type", roof="roof")}, "'year: ' || cast(cast(deal_year as int) as varchar) || chr(10) || 'type: ' || apt_type || chr(10) || 'roof: ' || coalesce(roof, '-') as v")
column_query("B17_cadastral_key", lambda: {"v": clean.cadastral_key(F.concat(F.lit("0"), F.col("gush_code")))}, f"{KEY} as v")
column_query("B19_quality_flags", lambda: {"v": clean.quality_flags(missing_area="area", missing_rooms="rooms", missing_floor="floor", missing_roof="roof")}, "concat_ws(';', case when area is null then 'missing_area' end, case when rooms is null then 'missing_rooms' end, case when floor is null then 'missing_floor' end, case when roof is null then 'missing_roof' end) as v")
column_query("B20_price_metrics", lambda: {k: clean.price_metric(k) for k in summary.KINDS}, f"price_millions as price, {PER_M2} as per_m2, {PER_ROOM} as per_room")
column_query("B21_plausible_area", lambda: {"v": clean.plausible_area()}, f"{PLAUSIBLE} as v")
column_query("B23_price_ils", lambda: {"v": clean.price_ils(F.when(F.col("gush") > 10, F.lit(5.0)), "price_millions")}, "case when gush > 10 then 5.0 else price_millions * 1e6 end as v")
column_query("B24_display_address", lambda: {"v": clean.display_address(F.when(F.col("roof") == "TRUE", F.col("full_address")))}, "case when roof = 'TRUE' then full_address else street || ', ' || city end as v")
column_query("B25_compact", lambda: {"v": clean.compact(F.col("gush") / 16)}, "round_even(gush / 16, 3) as v")
column_query("B26_text_key", lambda: {"v": clean.text_key(F.concat(F.lit(" "), F.col("apt_type")))}, "lower(apt_type) as v")
column_query("B27_gush_key", lambda: {"a": clean.gush_key("gush"), "b": clean.gush_key(F.concat(F.lit(" "), F.col("city")))}, "cast(cast(gush as int) as varchar) as a, lower(city) as b")
column_query("B28_tri_state", lambda: {"v": clean.tri_state("roof")}, f"{TRI} as v")
column_query("B31_place_key", lambda: {"v": clean.place_key(F.concat("city", F.lit("-A 'b\"")))}, "replace(lower(city), '-', '') || 'ab' as v")
column_query("B32_suspect_flags", lambda: {"v": F.array_join(clean.suspect_flags(2001), ";")}, "concat_ws(';', case when rooms < 1 or rooms > 20 or (rooms * 2) % 1 <> 0 then 'rooms' end, case when area <= 0 or area > 1000 then 'area' end, case when build_year < 1800 or build_year > 2011 then 'build_year' end) as v")
column_query("B07_floor_number", lambda: {"v": clean.floor_number(F.when(F.col("gush") < 10, F.concat(F.lit("floor "), F.col("floor").cast("int").cast("string"))).when(F.col("gush") < 20, F.lit("ground")).otherwise(F.col("floor").cast("int").cast("string")), {"ground": 0}, "floor")}, "case when gush < 10 then floor when gush < 20 then 0.0 else floor end as v")
column_query("B08_high_floor", lambda: {"v": clean.high_floor(F.when(F.col("gush") < 10, F.lit("one and two")), {"one and two": 2}, "floor")}, "case when gush < 10 then 2.0 else floor end as v")
column_query("B33_address_tokens", lambda: {"v": F.array_join(F.regexp_extract_all(clean.cased_address("full_address"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")}, "array_to_string(regexp_extract_all(lower(full_address), '[a-z0-9]+'), ' ') as v")


@register("B22_with_metrics", f"{WITH} select record_id, deal_date, price_millions as price, {PER_M2} as per_m2, {PER_ROOM} as per_room from deals")
def b22(spark, sf_dir):
    d = deals(spark, sf_dir).withColumns({k: clean.price_metric(k) for k in summary.KINDS})
    return d.select(ID, "deal_date", *summary.KINDS).orderBy(F.col("deal_date").asc_nulls_last(), ID)


@register("B29_export_values", f"{WITH} select record_id, strftime(deal_date, '%Y-%m-%d') as deal_date, case {TRI} when true then 'Yes' when false then 'No' else '' end as roof, price_millions from deals")
def b29(spark, sf_dir):
    roof = clean.tri_state("roof")
    return deals(spark, sf_dir).select(ID, F.date_format("deal_date", "yyyy-MM-dd").alias("deal_date"), F.when(roof, "Yes").when(~roof, "No").otherwise("").alias("roof"), "price_millions")


@register("B30_raw_rows", f"{WITH} select record_id, city, street, gush, deal_date, price_millions, area, rooms from deals")
def b30(spark, sf_dir):
    d = deals(spark, sf_dir)
    wanted = ["record_id", "city", "street", "gush", "deal_date", "price_millions", "area", "rooms", "no_such_column"]
    return d.select(*[c for c in wanted if c in d.columns]).orderBy("deal_date", ID)


FILTERS = {
    "C01_text": (lambda: filters.in_text("city", [" nation_1", "NATION_7 "]), "lower(city) in ('nation_1', 'nation_7')"),
    "C02_gush": (lambda: filters.in_gush(["7", 12.0]), "gush in (7, 12)"),
    "C03_range": (lambda: filters.in_range("area", (30, 60)), "area between 30 and 60"),
    "C04_floor": (lambda: filters.floor_ok((2, 5), False), "floor <> 999 and floor between 2 and 5"),
    "C04_floor_unknown_kept": (lambda: filters.floor_ok((2, 5)), "floor between 2 and 5 or floor = 999 or floor is null"),
    "C04_floor_known_only": (lambda: filters.floor_ok(None, False), "floor <> 999"),
    "C05_rooms": (lambda: filters.rooms_ok([2, 3.5]), f"{HALF} in (2, 3.5) or not {KNOWN_ROOMS}"),
    "C05_rooms_known": (lambda: filters.rooms_ok([2, 3.5], False), f"{KNOWN_ROOMS} and {HALF} in (2, 3.5)"),
    "C06_per_m2": (lambda: filters.ppm_ok((10, 30)), f"({PER_M2}) between 10 and 30"),
    "C07_build_year": (lambda: filters.build_year_ok((1950, 1980)), "build_year between 1950 and 1980 or build_year is null or build_year < 1900"),
    "C08_age": (lambda: filters.age_ok((5, 25), False), "building_age <= 150 and building_age between 5 and 25"),
    "C09_build_floors": (lambda: filters.build_floors_ok((5, 8)), "build_floors between 5 and 8 or build_floors = 999 or build_floors is null"),
    "C10_roof": (lambda: filters.roof_ok("no"), f"coalesce(({TRI}) = false, false)"),
    "C11_project": (lambda: filters.project_ok("yes"), "new_project = 'New Project'"),
    "C12_address": (lambda: filters.address_ok("red 12"), "contains(lower(full_address), 'red') and regexp_matches(full_address, '(^|[^0-9])12($|[^0-9])')"),
    "C14_share": (lambda: filters.share_ok("partial"), "sale_portion > 0 and sale_portion < 1"),
    "C14_share_unknown": (lambda: filters.share_ok("unknown"), "sale_portion is null or sale_portion <= 0 or sale_portion > 1"),
    "C15_complete": (lambda: filters.complete_ok("both"), "full_address is not null and floor <> 999"),
}


def _filter_query(name: str, cond, sql: str) -> None:
    register(name, f"{WITH} select record_id, city, price_millions from deals where {sql}")(lambda spark, sf_dir: deals(spark, sf_dir).where(cond()).select(ID, "city", "price_millions"))


for _name, (_cond, _sql) in FILTERS.items():
    _filter_query(_name, _cond, _sql)

SPEC = FilterSpec(cities=("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"), years=(1993, 2000), floor=(0, 8), rooms=(1, 2, 3, 4), project="both", roof="both")
SPEC_SQL = f"sale_portion = 1 and city in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5') and deal_year between 1993 and 2000 and (floor between 0 and 8 or floor = 999 or floor is null) and ({HALF} in (1, 2, 3, 4) or not {KNOWN_ROOMS})"


@register("C13_location_basis", f"{WITH} select record_id from deals where gush < 10")
def c13(spark, sf_dir):
    d = deals(spark, sf_dir).withColumn("location_basis", F.when(F.col("gush") < 10, "strict_transaction").otherwise("unmatched"))
    return d.where(filters.basis_ok("verified")).select(ID)


@register("C16_full_sales_default", f"{WITH} select record_id from deals where sale_portion = 1")
def c16(spark, sf_dir):
    return filters.apply_filters(deals(spark, sf_dir), FilterSpec()).select(ID)


@register("C17_apply_filters", f"{WITH} select record_id, city, deal_year, rooms, floor from deals where {SPEC_SQL}")
def c17(spark, sf_dir):
    return filters.apply_filters(deals(spark, sf_dir), SPEC).select(ID, "city", "deal_year", "rooms", "floor")


@register("C18_location_split", f"{WITH} select count(*) filter (where city in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5')) as in_place, count(*) filter (where {SPEC_SQL}) as matching from deals")
def c18(spark, sf_dir):
    place, rest = SPEC.location().column(), filters.replace(SPEC.rest(), share="full").column()
    return deals(spark, sf_dir).agg(F.count_if(place).alias("in_place"), F.count_if(place & rest).alias("matching"))


@register("C19_exclude_years", f"{WITH} select record_id, deal_year from deals where deal_year is null or deal_year <> 1997")
def c19(spark, sf_dir):
    return filters.exclude_years(deals(spark, sf_dir), [1997]).select(ID, "deal_year")


@register("C20_import_valid", f"{WITH} select record_id from deals where apt_type = 'PROMO' and deal_date <= date '1999-06-30' and price_millions > 0")
def c20(spark, sf_dir):
    return filters.import_valid(deals(spark, sf_dir).withColumn("deal_amount", F.col("price_millions") * 1e6), "1999-06-30", ["PROMO"]).select(ID)


@register("C21_keep_groups", f"{WITH}, g as (select city, deal_year from deals group by all having count(*) > 20) select record_id from deals semi join g using (city, deal_year)")
def c21(spark, sf_dir):
    d = deals(spark, sf_dir)
    return filters.keep_groups(d, d.groupBy("city", "deal_year").count().where("count > 20"), ["city", "deal_year"]).select(ID)


@register("C22_search_rows", f"{WITH} select record_id, city, street, gush from deals where regexp_matches(city, '(^|[^0-9])1($|[^0-9])') and contains(lower(street), 'e') and gush between 3 and 30")
def c22(spark, sf_dir):
    d = deals(spark, sf_dir).select(ID, "city", "street", "gush")
    return filters.search_rows(d, "Nation_1", {"street": "E"}, {"gush": (3, 30)}, [F.desc("gush"), ID])


# year windows over one city, where years are sparse
SPARSE = "city = 'NATION_3' and gush = 7"
BOUNDS = """, rows_ as (select cast(deal_year as int) as y, price_millions as v from src where deal_year is not null),
counts as (select y, count(*) as n from rows_ group by y),
wide as (select a.y, {cases} from counts a join counts b on abs(a.y - b.y) <= 5 group by a.y),
chosen as (select y, case {whens} else 5 end as width from wide),
bounds as (select c.y as year, c.width, count(*) as rows, quantile_cont(v, 0.25) - {k} * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) as low,
           quantile_cont(v, 0.75) + {k} * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) as high
           from chosen c join rows_ r on abs(r.y - c.y) <= c.width and v is not null group by c.y, c.width)"""
BOUNDS = BOUNDS.replace("{cases}", ", ".join(f"sum(case when abs(a.y - b.y) <= {w} then b.n else 0 end) as n{w}" for w in range(6))).replace("{whens}", " ".join(f"when n{w} >= 10 then {w}" for w in range(6)))


def bounds_sql(source: str, value: str = "price_millions", k: float = 2.5) -> str:
    return f", src as (select *, {value} as _v from {source})" + BOUNDS.replace("price_millions as v", "_v as v").replace("{k}", str(k))


@register("D1_year_bounds", f"{WITH}, sparse as (select * from deals where {SPARSE}) {bounds_sql('sparse')} select year, width, rows, round(low, 6) as low, round(high, 6) as high from bounds")
def d1_bounds(spark, sf_dir):
    b = outliers.year_bounds(deals(spark, sf_dir).where(SPARSE))
    return b.select("year", "width", "rows", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("D1_trim_by_year", f"{WITH} {bounds_sql('deals')} select record_id, price_millions from deals left join bounds on deal_year = year where price_millions is null or year is null or price_millions between low and high")
def d1(spark, sf_dir):
    return outliers.trim_by_year(deals(spark, sf_dir)).select(ID, "price_millions")


def global_sql(source: str, value: str, keep_null: bool = False) -> str:
    q = f"select quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.75) as q3 from {source}"
    ok = f"({value}) between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"
    return f"select {source}.* from {source}, ({q}) where {ok}" + (f" or ({value}) is null" if keep_null else "")


D2 = global_sql("deals", "price_millions")


@register("D2_trim_global", f"{WITH}, d2 as ({D2}) select record_id, price_millions from d2")
def d2(spark, sf_dir):
    return outliers.trim_global(deals(spark, sf_dir)).select(ID, "price_millions")


@register("D3_trim_metric", f"{WITH}, d3 as ({global_sql('deals', PER_M2, True)}) select record_id, price_millions, area from d3")
def d3(spark, sf_dir):
    return outliers.trim_metric(deals(spark, sf_dir), "per_m2").select(ID, "price_millions", "area")


@register("D3_trim_metric_by_year", f"{WITH} {bounds_sql('deals', PER_ROOM)} select record_id, price_millions, rooms from src left join bounds on deal_year = year where _v is null or year is null or _v between low and high")
def d3_by_year(spark, sf_dir):
    return outliers.trim_metric(deals(spark, sf_dir), "per_room", by_year=True).select(ID, "price_millions", "rooms")


@register("D4_trim_area", f"{WITH}, d4 as ({global_sql('deals', 'area')}) select record_id, area from d4")
def d4(spark, sf_dir):
    return outliers.trim_var(deals(spark, sf_dir)).select(ID, "area")


GUSH_TRIM = f", d2 as ({D2}), d3 as ({global_sql('d2', PER_M2, True)}), trimmed as ({global_sql('d3', 'area')})"


@register("D5_trim_policy", f"{WITH} {GUSH_TRIM} select record_id, price_millions, area from trimmed")
def d5(spark, sf_dir):
    return outliers.trim(deals(spark, sf_dir), "gushes", "per_m2").select(ID, "price_millions", "area")


MEDIANS = f"count(*) as n_deals, median(price_millions) as price_y, median({PER_M2}) as per_m2_y, median({PER_ROOM}) as per_room_y"
FULL = f", full_sales as (select * from deals where sale_portion = 1), clean as ({global_sql('full_sales', 'price_millions')})"


@register("E1_city_year_summary", f"{WITH} {FULL} select city, deal_year, {MEDIANS} from clean group by city, deal_year")
def e1(spark, sf_dir):
    return summary.summarize(outliers.trim_global(filters.apply_filters(deals(spark, sf_dir), FilterSpec())), ["city", "deal_year"])


@register("E2_gush_year_summary", f"{WITH} select city, gush, deal_year, {MEDIANS} from deals group by city, gush, deal_year")
def e2(spark, sf_dir):
    return summary.summarize(deals(spark, sf_dir), ["city", "gush", "deal_year"])


@register("E3_mean_summary", f"{WITH} select city, deal_year, count(*) as n_deals, round(avg(price_millions), 6) as price_y, round(avg({PER_M2}), 6) as per_m2_y, round(avg({PER_ROOM}), 6) as per_room_y from deals group by city, deal_year")
def e3(spark, sf_dir):
    s = summary.summarize(deals(spark, sf_dir), ["city", "deal_year"], "mean")
    return s.select("city", "deal_year", "n_deals", *[F.round(f"{k}_y", 6).alias(f"{k}_y") for k in summary.KINDS])


@register("E4_selection_summary", f"{WITH} select count(*) as n_deals, median(price_millions) as median_price, median(area) as median_area, median(case when rooms <> 999 then rooms end) as median_rooms, min(deal_year) as first_year, max(deal_year) as last_year, min(deal_date) as first_date, max(deal_date) as last_date, count(distinct city) as cities, count(distinct street) as streets, count(distinct gush) as gushes from deals")
def e4(spark, sf_dir):
    return summary.selection_summary(deals(spark, sf_dir))


@register("E5_yearly_values", f"{WITH} select deal_year, count(*) as n_deals, median({PER_M2}) as y from deals where deal_year is not null group by deal_year")
def e5(spark, sf_dir):
    return summary.yearly_values(deals(spark, sf_dir), "per_m2")


QUART = "quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as p75"


@register("E6_annual_profile", f"{WITH}, s as (select cast(deal_year as int) as year, {PER_M2} as v from deals where {SPARSE}), g as (select year, count(*) as deals, count(v) as valid_prices, {QUART} from s group by year), ys as (select unnest(range(min(year), max(year) + 1)) as year from s) select cast(ys.year as int) as year, coalesce(deals, 0) as deals, coalesce(valid_prices, 0) as valid_prices, p25, median, p75, coalesce(valid_prices, 0) < 10 as low_sample from ys left join g on g.year = ys.year")
def e6(spark, sf_dir):
    return summary.annual_profile(deals(spark, sf_dir).where(SPARSE), "per_m2")


@register("E7_histogram", f"{WITH}, v as (select area as v from deals where area is not null), s as (select min(v) as lo, max(v) as hi, least(30, cast(ceil(sqrt(count(*))) as int)) as bins from v), h as (select cast(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) as int) as bin, count(*) as n from v, s group by 1), b as (select cast(unnest(range(bins)) as int) as bin, lo, (hi - lo) / bins as w from s) select b.bin, lo + b.bin * w as low, lo + (b.bin + 1) * w as high, coalesce(n, 0) as count from b left join h on h.bin = b.bin")
def e7(spark, sf_dir):
    return summary.histogram(deals(spark, sf_dir), F.col("area"))


@register("E8_population", f"{WITH}, s as (select {PER_M2} as v, deal_year from deals) select count(*) as matching_deals, count(v) as valid_price_deals, count(*) - count(v) as missing_price_deals, count(*) filter (where deal_year is null) as undated_deals, {QUART} from s")
def e8(spark, sf_dir):
    return summary.population(deals(spark, sf_dir), "per_m2")


def _range_sql(name: str, value: str, ok: str) -> str:
    return f"select '{name}' as name, floor(min(case when {ok} then {value} end) * 1000) / 1000 as min, ceil(max(case when {ok} then {value} end) * 1000) / 1000 as max, count(case when {ok} then {value} end) as count, count(*) - count(case when {ok} then {value} end) as special_count from deals"


RANGES_SQL = " union all ".join([
    *[_range_sql(c, c, f"{c} is not null") for c in ("price_millions", "area", "deal_year")], *[_range_sql(c, c, f"{c} <> 999") for c in ("rooms", "floor", "build_floors")],
    _range_sql("build_year", "build_year", "build_year >= 1900"), _range_sql("building_age", "building_age", "building_age <= 150"), _range_sql("price_per_m2", PER_M2, f"({PER_M2}) is not null"),
])


@register("E12_column_ranges", f"{WITH} {RANGES_SQL}")
def e12(spark, sf_dir):
    return summary.column_ranges(deals(spark, sf_dir))


@register("E12_filter_counts", f"{WITH} {bounds_sql('deals')} select count(*) as before, count(*) filter (where ({TRI})) as roof_yes, count(*) filter (where not ({TRI})) as roof_no, count(*) filter (where ({TRI}) is null) as roof_unknown, count(*) filter (where price_millions is null or year is null or price_millions between low and high) as after from deals left join bounds on deal_year = year")
def e12_counts(spark, sf_dir):
    d = deals(spark, sf_dir)
    return summary.filter_counts(d, outliers.trim_by_year(d))


@register("E12_type_choices", f"{WITH} select distinct trim(apt_type) as apt_type from deals where trim(apt_type) <> ''")
def e12_types(spark, sf_dir):
    return summary.type_choices(deals(spark, sf_dir))


@register("E13_smart_rooms", f"{WITH}, r as (select city, {HALF} as room, count(*) as n from deals where rooms <> 999 group by 1, 2), p as (select *, row_number() over o as place, count(*) over (partition by city) as kinds, n * 100 / sum(n) over (partition by city) as share, sum(n) over o * 100 / sum(n) over (partition by city) as upto from r window o as (partition by city order by n desc, room rows unbounded preceding)), c as (select *, min(case when place <= 2 or upto <= 80 or share >= 8 then 1 else 0 end) over (partition by city order by place rows unbounded preceding) as chain from p) select city, room, n, place from c where kinds <= 3 or (chain = 1 and place <= 6)")
def e13(spark, sf_dir):
    return summary.smart_rooms(deals(spark, sf_dir), ["city"])


COVER = "count(*) as rows, min(deal_date) as first_date, max(deal_date) as last_date, count(*) filter (where sale_portion = 1) as full_sales, count(*) filter (where sale_portion > 0 and sale_portion < 1) as partial_sales, count(*) filter (where sale_portion is null) as unknown_share, count(*) filter (where full_address is null) as missing_address, count(*) filter (where floor is null or floor = 999) as missing_floor, count(*) filter (where area is null) as missing_area, count(*) filter (where rooms is null) as missing_rooms, count(*) filter (where gush_code like '%-0') as missing_key"


@register("E14_coverage", f"{WITH} select city, {COVER} from deals group by city")
def e14(spark, sf_dir):
    return summary.coverage(deals(spark, sf_dir), ["city"])


PCT = ["full_sales", "partial_sales", "unknown_share", "missing_address", "missing_floor", "missing_area", "missing_rooms", "missing_key"]


@register("E15_coverage_pct", f"{WITH}, c as (select city, {COVER} from deals group by city) select city, rows, first_date, last_date, " + ", ".join(f"round_even({p} * 100.0 / rows, 1) as {p}_pct" for p in PCT) + " from c")
def e15(spark, sf_dir):
    return summary.coverage_pct(summary.coverage(deals(spark, sf_dir), ["city"]))


@register("E27_funnel", f"{WITH} select 0 as place, 'all' as stage, count(*) as rows from deals union all select 1, 'city', count(*) from deals where city = 'NATION_1' union all select 2, 'full', count(*) from deals where city = 'NATION_1' and sale_portion = 1 union all select 3, 'valid', count(*) from deals where city = 'NATION_1' and sale_portion = 1 and ({PER_M2}) is not null")
def e27(spark, sf_dir):
    return summary.funnel(deals(spark, sf_dir), {"city": filters.in_text("city", ["NATION_1"]), "full": filters.share_ok("full"), "valid": clean.price_metric("per_m2").isNotNull()})


@register("H1_date_order", f"{WITH} select record_id, deal_date from deals")
def h1(spark, sf_dir):
    return deals(spark, sf_dir).select(ID, "deal_date").orderBy(F.desc_nulls_last("deal_date"), ID)


@register("H2_seeded_sample", f"{WITH} select record_id, city from deals order by md5('1:' || record_id), record_id limit 2000")
def h2(spark, sf_dir):
    """A sampling operator: the 2,000 rows of least hash under the seed."""
    return deals(spark, sf_dir).select(ID, "city").orderBy(F.md5(F.concat(F.lit("1:"), F.col(ID))), ID).limit(2000)


@register("H3_top_k", f"{WITH} select city, street, count(*) as n from deals group by all order by n desc, city, street limit 25")
def h3(spark, sf_dir):
    return deals(spark, sf_dir).groupBy("city", "street").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city", "street").limit(25)
