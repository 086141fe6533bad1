"""One query for each composed job, over a named output of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import FilterSpec
from ..operators import quality
from ..sources import tables
from . import jobs
from .basics import FULL, bounds_sql, global_sql
from .fixtures import SNAPSHOT_YEAR, WITH, deals, joined, legacy_deals, units
from .links import CONFLICT, DESCR, STRICT, first_raw, old_units, second_raw
from .registry import register
from .trends import GROWTH

CITY = FilterSpec(cities=("NATION_3",))


@register("N01_deals_analysis", f"{WITH}, c as (select * from deals where city = 'NATION_3' and sale_portion = 1) {bounds_sql('c')}, d1 as (select c.* from c left join bounds on deal_year = year where price_millions is null or year is null or price_millions between low and high) select deal_year, count(*) as n_deals, median(price_millions) as y from d1 where deal_year is not null group by deal_year")
def n1(spark, sf_dir):
    return jobs.deals_analysis(deals(spark, sf_dir), CITY)["yearly"]


@register("N02_area_comparison", f"{WITH} {DESCR}, c as (select * from deals where gush = 7 and city in ('NATION_1', 'NATION_2', 'NATION_3') and sale_portion = 1), d2 as ({global_sql('c', 'price_millions')}), s as (select city, gush, deal_year, count(*) as n_deals, median(price_millions) as y from d2 group by all) select s.*, gush_desc as gush_label from s left join descr using (city, gush)")
def n2(spark, sf_dir):
    d = deals(spark, sf_dir)
    areas = d.where("gush = 7 and city in ('NATION_1', 'NATION_2', 'NATION_3')").select("city", "gush").distinct()
    return jobs.area_comparison(d, tables.build_descriptions(d), areas, FilterSpec())["series"]


@register("N03_city_comparison", f"{WITH} {FULL} select city, deal_year, count(*) as n_deals, median(price_millions) as y from clean where deal_year is not null group by all")
def n3(spark, sf_dir):
    return jobs.city_comparison(deals(spark, sf_dir), FilterSpec())["series"]


N4 = GROWTH.replace("from deals where deal_year is not null", "from trimmed where deal_year is not null")


@register("N04_gush_performance", f"{WITH}, f as (select * from deals where sale_portion = 1), d2 as ({global_sql('f', 'price_millions')}), trimmed as ({global_sql('d2', 'area')}) {N4} select gush, rank, annualized_change, price_change, total_deals, year_count from ranked")
def n4(spark, sf_dir):
    got = jobs.gush_performance(deals(spark, sf_dir), FilterSpec(), SNAPSHOT_YEAR, keys=("gush",))["ranking"]
    return got.select("gush", "rank", "annualized_change", "price_change", "total_deals", "year_count")


@register("N05_filter_options", f"{WITH} select distinct apt_type from deals where city = 'NATION_3'")
def n5(spark, sf_dir):
    return jobs.filter_options(deals(spark, sf_dir), CITY)["types"]


@register("N06_scoped_export", f"{WITH}, g as (select city, deal_year from deals group by all having count(*) > 25) select record_id as \"Record\", city as \"City\" from deals semi join g using (city, deal_year)")
def n6(spark, sf_dir):
    d = deals(spark, sf_dir)
    shown = d.groupBy("city", "deal_year").count().where("count > 25")
    return jobs.scoped_export(d, shown, ("city", "deal_year")).select("Record", "City")


AREAS = "gush = 7 and city in ('NATION_1', 'NATION_2', 'NATION_3')"
CITIES = FilterSpec(cities=("NATION_3", "NATION_7"))


def exports(spark, sf_dir, spec, view):
    d = deals(spark, sf_dir)
    return jobs.scoped_exports(d, tables.build_descriptions(d), d.where(AREAS).select("city", "gush").distinct(), spec, SNAPSHOT_YEAR, views=(view,), picks=(3, 3, 3), min_deals=1, keys=("city", "gush"))


RAW_SQL = "select record_id, city as \"City\", gush as \"Gush\", deal_year as \"Deal Year\", price_millions as \"Price Millions\", case lower(roof) when 'true' then 'Yes' when 'no' then 'No' else '' end as \"Roof\""
SUMS = "deal_year as \"Deal Year\", count(*) as \"Deals\", median(price_millions) as \"Selected Value\""
TWO = f", f2 as (select * from deals where city in ('NATION_3', 'NATION_7') and sale_portion = 1), c2 as ({global_sql('f2', 'price_millions')})"
AREA_ROWS = f", f7 as (select * from deals where {AREAS} and sale_portion = 1), c7 as ({global_sql('f7', 'price_millions')})"
PICKED = f"""{TWO}, t2 as ({global_sql('c2', 'area')}), s2 as (select city, gush, deal_year, count(*) as n, median(price_millions) as y from t2 where deal_year is not null group by all),
p2 as (select min(deal_year) as a, max(deal_year) as z from s2 where deal_year < {SNAPSHOT_YEAR}),
g2 as (select city, gush, a, z, max(case when deal_year = a then y end) as ya, max(case when deal_year = z then y end) as yz, sum(n)::bigint as total from s2, p2 where deal_year between a and z group by all),
r2 as (select *, round_even((pow(yz / ya, 1 / (z - a)) - 1) * 100, 3) as rate from g2 where ya > 0 and yz > 0),
k2 as (select *, row_number() over (order by rate desc, city, gush) as rank, count(*) over () as all_ from r2),
pick2 as (select * from k2 where rank <= 3 or rank > all_ - 3 or (rank > 3 + (all_ - 9) // 2 and rank <= 6 + (all_ - 9) // 2))"""
RAW_COLS = ["record_id", "City", "Gush", "Deal Year", "Price Millions", "Roof"]


@register("N06_export_analysis", f"{WITH}, c as (select * from deals where city = 'NATION_3' and sale_portion = 1) {bounds_sql('c')} {RAW_SQL} from c left join bounds on deal_year = year where price_millions is null or year is null or price_millions between low and high")
def n6_analysis(spark, sf_dir):
    return exports(spark, sf_dir, CITY, "analysis")["analysis"].select(*RAW_COLS)


@register("N06_export_compare_raw", f"{WITH} {AREA_ROWS} {RAW_SQL} from c7")
def n6_compare_raw(spark, sf_dir):
    return exports(spark, sf_dir, FilterSpec(), "compare")["compare_raw"].select(*RAW_COLS)


@register("N06_export_compare_summary", f"{WITH} {DESCR} {AREA_ROWS}, s as (select city, gush, {SUMS} from c7 where deal_year is not null group by city, gush, deal_year) select s.city as \"City\", s.gush as \"Gush\", gush_desc as \"Gush Label\", \"Deal Year\", \"Deals\", \"Selected Value\" from s left join descr using (city, gush)")
def n6_compare_summary(spark, sf_dir):
    return exports(spark, sf_dir, FilterSpec(), "compare")["compare_summary"].select("City", "Gush", "Gush Label", "Deal Year", "Deals", "Selected Value")


@register("N06_export_cities_raw", f"{WITH} {TWO} {RAW_SQL} from c2 where deal_year is not null")
def n6_cities_raw(spark, sf_dir):
    return exports(spark, sf_dir, CITIES, "cities")["cities_raw"].select(*RAW_COLS)


@register("N06_export_cities_summary", f"{WITH} {TWO} select city as \"City\", {SUMS} from c2 where deal_year is not null group by city, deal_year")
def n6_cities_summary(spark, sf_dir):
    return exports(spark, sf_dir, CITIES, "cities")["cities_summary"].select("City", "Deal Year", "Deals", "Selected Value")


@register("N06_export_gushes_raw", f"{WITH} {PICKED} {RAW_SQL} from t2 join pick2 using (city, gush) where deal_year between a and z")
def n6_gushes_raw(spark, sf_dir):
    return exports(spark, sf_dir, CITIES, "gushes")["gushes_raw"].select(*RAW_COLS)


@register("N06_export_gushes_summary", f"{WITH} {PICKED} select city as \"City\", gush as \"Gush\", rank as \"Rank\", rate as \"Annualized Change % (CAGR)\", total as \"Total Deals\" from pick2")
def n6_gushes_summary(spark, sf_dir):
    return exports(spark, sf_dir, CITIES, "gushes")["gushes_summary"].select("City", "Gush", "Rank", "Annualized Change % (CAGR)", "Total Deals")


SAID = "city, street, gush_code, deal_date, price_millions, area, rooms, floor, build_floors, apt_type"
IMPORTED = "fresh as (select distinct record_id, city, street, gush_code, deal_date, cast(round(price_millions * 1e6) as bigint) / 1e6 as price_millions, cast(area as double) as area, rooms, cast(null as double) as floor, build_floors, apt_type, gush from deals)"


@register("N07_import_first", f"{WITH}, {IMPORTED}, loose as (select {SAID}, min(gush) as gush from legacy group by all), here as (select city, gush from fresh union all select city, gush from loose l where not exists (select 1 from fresh f where {' and '.join(f'f.{c.strip()} is not distinct from l.{c.strip()}' for c in SAID.split(','))})), o as (select city, gush, count(*) as n from here group by all), p as (select *, count(*) over (partition by gush) as c, row_number() over (partition by gush order by city) as k from o) select city, case when c > 1 then gush * 10 + k else gush end as gush, sum(n)::bigint as n from p group by 1, 2")
def n7(spark, sf_dir):
    """All deals as raw texts beside existing rows; numbers of blocks in several cities get their place, and may meet."""
    base = joined(spark, sf_dir)
    raw = first_raw(deals(spark, sf_dir, base).withColumn("source_key", F.col("record_id")))
    return jobs.import_first(raw, legacy_deals(spark, sf_dir, base).withColumn("area", F.col("area").cast("double")))["deals"].groupBy("city", "gush").agg(F.count("*").alias("n"))


@register("N08_import_second", f"{WITH} {STRICT} select d.record_id, g.street, concat_ws(';', case when g.full_address is null then 'missing_address' end, case when g.floor is null then 'missing_floor' end, case when d.area is null then 'missing_area' end, case when d.rooms is null then 'missing_rooms' end) as quality_flags from deals d left join good g using (record_id) where apt_type <> 'PROMO' and deal_date <= date '1999-12-31' and price_millions > 0")
def n8(spark, sf_dir):
    types = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY"]
    d = deals(spark, sf_dir)
    got = jobs.import_second(second_raw(d), legacy_deals(spark, sf_dir), "1999-12-31", types)["deals"]
    return got.select("record_id", "street", "quality_flags")


@register("N09_link_locations", f"{WITH}, old as (select *, case when gush = 1 then gush_code else concat_ws('-', gush_code, substring(city, 8)) end as unit_key from legacy where gush_code not like '%-0'), rf as (select city, unit_key from old group by all having count(distinct street) = 1 and count(distinct full_address) = 1 and count(distinct case when floor between -10 and 200 then floor end) <= 1) select u.city, case when rf.unit_key is null then 'unmatched' else 'property_reference' end as location_basis, count(*) as rows from units u left join rf using (city, unit_key) group by all")
def n9(spark, sf_dir):
    blank = units(spark, sf_dir).withColumns({c: F.lit(None).cast(t) for c, t in (("street", "string"), ("full_address", "string"), ("floor", "double"), ("legacy_record_id", "string"))}).withColumn("legacy_match", F.lit("unmatched"))
    return jobs.link_locations(blank, old_units(spark, sf_dir))["basis"]


@register("N10_snapshot_quality", f"{WITH}, old as (select * from legacy where gush_code not like '%-0') select city, deal_year, coalesce(o, 0) as old_rows, n as new_rows, n - coalesce(o, 0) as difference from (select city, deal_year, count(*) as n from units group by all) left join (select city, deal_year, count(*) as o from old group by all) using (city, deal_year)")
def n10(spark, sf_dir):
    return jobs.snapshot_quality(units(spark, sf_dir), old_units(spark, sf_dir), "unit_key", 1997)["snapshots"]


@register("N11_repeat_sales", f"{WITH}, w as (select * from units where apt_type = 'STANDARD' and price_millions > 0 and sale_portion = 1) select unit_key, max(d) as dates from (select unit_key, area, rooms, count(distinct deal_date) as d from w where area > 0 and rooms > 0 and unit_key not in ({CONFLICT.replace('units', 'w')}) group by all) group by 1")
def n11(spark, sf_dir):
    return jobs.repeat_sales(units(spark, sf_dir), quality.scopes(F.col("apt_type") != "PROMO", F.col("apt_type") == "STANDARD"))["stable"]
