"""Queries of sources, linkage and quality, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import linkage, quality
from ..sources import files, tables
from ..sources.stage import scratch
from .basics import KEY
from .fixtures import WITH, bench_index, deals, gush_streets, joined, legacy_deals, units
from .registry import register

U = "city, unit_key, deal_date"
# the second source with property keys
OLD_UNITS = ", old as (select *, case when gush = 1 then gush_code else concat_ws('-', gush_code, substring(city, 8)) end as unit_key from legacy where gush_code not like '%-0')"


def old_units(spark, sf_dir, base=None):
    key = F.when(F.col("gush") == 1, F.col("gush_code")).otherwise(F.concat_ws("-", "gush_code", F.substr("city", F.lit(8))))
    return legacy_deals(spark, sf_dir, base).where(~F.col("gush_code").endswith("-0")).withColumn("unit_key", key)


@register("A03_lookup_rows", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'")
def a1(spark, sf_dir):
    return tables.read_lookup(spark, f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@register("A02_many_cities", f"{WITH} select city, count(*) as n from deals where city in ('NATION_2', 'NATION_9') group by city")
def a2(spark, sf_dir):
    return deals(spark, sf_dir).where(F.col("city").isin(sorted({"NATION_2", "NATION_9", "NATION_2"}))).groupBy("city").agg(F.count("*").alias("n"))


@register("A03_lookup", "select n_nationkey, n_name from nation")
def a3(spark, sf_dir):
    return tables.read_lookup(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


@register("A04_types", f"{WITH} select distinct apt_type from deals")
def a4(spark, sf_dir):
    path = scratch(spark)
    deals(spark, sf_dir).select("apt_type").distinct().agg(F.to_json(F.sort_array(F.collect_list("apt_type")))).write.text(path)
    return tables.read_types(spark, path)


@register("A05_polygons", f"{WITH} select distinct gush, city as poly_city, cast(gush * 100 as bigint) + cast(substring(city, 8) as bigint) as feature_id from deals")
def a5(spark, sf_dir):
    path, fid = scratch(spark), F.col("gush").cast("long") * 100 + F.substr("city", F.lit(8)).cast("long")
    blocks = deals(spark, sf_dir).select("gush", "city").distinct()
    props = F.struct(F.col("gush").alias("GUSH_NUM"), F.col("city").alias("LOCALITY_N"), fid.alias("FID"))
    one = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("gush", "gush").alias("coordinates")).alias("geometry"))
    blocks.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(one).alias("features")))).write.text(path)
    return tables.read_polygons(spark, path).select("gush", "poly_city", "feature_id")


def raw_csv(d, path):
    d.select("record_id", "city", "street", "roof", F.date_format("deal_date", "dd/MM/yyyy").alias("deal_date")).write.option("header", True).csv(path)


@register("A07_raw_csv", f"{WITH} select record_id, city, street, roof, strftime(deal_date, '%d/%m/%Y') as deal_date, 'one' as resource_id from deals")
def a7(spark, sf_dir):
    path = scratch(spark)
    raw_csv(deals(spark, sf_dir), path)
    names = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1)).collect()]  # one row per file
    return tables.read_raw_csv(spark, [path], dict.fromkeys(names, "one")).drop("source_file")


@register("A09_check_files", f"{WITH} select v.problem, case when v.problem = 'missing' then 0 else count(*) end as more from deals, (values ('missing'), ('rows')) v(problem) group by 1 union all select 'checksum', 0")
def a9(spark, sf_dir):
    """An inventory with a file that is gone, one of another checksum, and one of as many rows too many as there are deals."""
    path, parts = scratch(spark), max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw_csv(deals(spark, sf_dir).repartition(parts), path)
    there = files.digests(spark, path)  # large files are read as a stream, as no value holds them
    counts = spark.read.option("header", True).csv(path).groupBy(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("file")).agg(F.count("*").alias("rows"))
    total, ends = counts.agg(F.sum("rows").alias("total")), there.agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    known = there.select("file", F.col("got_sha256").alias("sha256")).join(counts, "file").crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(total))
    known = known.select("file", F.when(F.col("file") == F.col("lo"), "x").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("file") == F.col("hi"), F.col("rows") + F.col("total")).otherwise(F.col("rows")).alias("rows"))
    gone = spark.range(1).select(F.lit("gone.csv").alias("file"), F.lit("x").alias("sha256"), F.lit(0).cast("long").alias("rows"))
    return tables.check_files(spark, path, known.unionByName(gone)).select("problem", F.when(F.col("problem") == "rows", F.col("rows") - F.col("got_rows")).otherwise(0).alias("more"))


@register("A10_write_deals", f"{WITH} select record_id, city, price_millions from deals where city in ('NATION_2', 'NATION_9')")
def a10(spark, sf_dir):
    path = scratch(spark)
    tables.write_deals(deals(spark, sf_dir), path)
    return tables.read_deals(spark, path, ["NATION_9", "NATION_2"]).select("record_id", "city", "price_millions")


@register("A12_publish", f"{WITH} select city, count(*) as deals, min(deal_date) as first from deals group by city")
def a12(spark, sf_dir):
    path, d = scratch(spark), deals(spark, sf_dir)
    tables.publish(d, d.groupBy("city").agg(F.min("deal_date").alias("first")), path)
    deals_there = tables.read_deals(spark, f"{path}/cities").groupBy("city").agg(F.count("*").alias("deals"))
    return spark.read.parquet(f"{path}/coverage").join(deals_there, "city").select("city", "deals", "first")


@register("A15_report", f"{WITH} select city, count(*) as n from deals group by city union all select city, count(*) from legacy group by city")
def a15(spark, sf_dir):
    path = scratch(spark)
    for kind, d in (("json", deals(spark, sf_dir)), ("csv", legacy_deals(spark, sf_dir))):
        tables.write_report(d.groupBy("city").agg(F.count("*").alias("n")), f"{path}/{kind}", kind)
    schema = "city string, n long"
    return spark.read.schema(schema).json(f"{path}/json").unionByName(spark.read.schema(schema).option("header", True).csv(f"{path}/csv"))


@register("A06_index_series", f"{WITH} select year, index_value from bench")
def a6(spark, sf_dir):
    return bench_index(spark, sf_dir).select(clean.num("year").cast("int").alias("year"), clean.num("index_value").alias("index_value")).dropna()


DESCR = ", ds as (select city, gush, street, count(*) as n from deals group by all), dr as (select *, row_number() over (partition by city, gush order by n desc, street) as r, count(*) over (partition by city, gush) - 1 as k from ds), descr as (select city, gush, street, n, city || ' ' || cast(cast(gush as int) as varchar) || ' (' || street || case when k > 0 then ' and ' || cast(k as varchar) || ' other streets' else '' end || ')' as gush_desc from dr where r = 1)"


def descriptions(spark, sf_dir):
    return tables.build_descriptions(deals(spark, sf_dir))


@register("A13_descriptions", f"{WITH} {DESCR} select * from descr")
def a13(spark, sf_dir):
    return descriptions(spark, sf_dir)


@register("A13_streets", f"{WITH} select city, gush, street from gush_streets")
def a13_streets(spark, sf_dir):
    return tables.build_streets(deals(spark, sf_dir))


@register("A13_types", f"{WITH} select distinct apt_type from deals")
def a13_types(spark, sf_dir):
    return tables.build_types(deals(spark, sf_dir))


@register("A16_append_existing", f"{WITH} select record_id, source_key, sale_portion from deals union all select record_id, null, null from legacy")
def a16(spark, sf_dir):
    return tables.append_existing(deals(spark, sf_dir), legacy_deals(spark, sf_dir)).select("record_id", "source_key", "sale_portion")


@register("B16_transform_raw", f"{WITH} select source_key, city, gush, full_address, deal_date, deal_year, price_millions, rooms, build_floors, new_project from (select 'r:' || source_key as source_key, city, gush, full_address, deal_date, deal_year, cast(round(price_millions * 1e6) as bigint) / 1e6 as price_millions, rooms, build_floors, case when build_year >= deal_year then 'New Project' else '2nd hand' end as new_project from deals)")
def b16(spark, sf_dir):
    return tables.transform_raw(first_raw(deals(spark, sf_dir))).select("source_key", "city", "gush", "full_address", "deal_date", "deal_year", "price_millions", "rooms", "build_floors", "new_project")


def first_raw(d):
    """Deals as the first source's raw texts."""
    s = lambda c: F.col(c).cast("string")
    return d.select(
        F.lit("r").alias("resource_id"), F.col("source_key").alias("row_num"), F.col("city").alias("city_name"), F.lit(None).cast("string").alias("dealdatetime"), F.date_format("deal_date", "dd.MM.yyyy").alias("dealdate"),
        F.format_number(F.round(F.col("price_millions") * 1e6), 0).alias("dealamount"), s("area").alias("dealnature"), s("rooms").alias("assetroomno"), s("floor").alias("floorno"), s("build_floors").alias("buildingfloors"), s("build_year").alias("buildingyear"),
        F.lit(None).cast("string").alias("yearbuilt"), F.col("apt_type").alias("dealnaturedescription"), "street", F.col("gush_code").alias("gush"), F.col("full_address").alias("fulladdress"), F.lit("").alias("displayaddress"), F.lit("").alias("newprojectext"),
    )


@register("B18_transform_raw2", f"{WITH} select record_id, {KEY} as gush_code, deal_date, round(price_millions, 9) as price_millions, area, case when rooms > 0 then rooms end as rooms, case when build_year > 0 then build_year end as build_year, sale_portion from deals")
def b18(spark, sf_dir):
    out = tables.transform_raw2(second_raw(deals(spark, sf_dir)))
    return out.select("record_id", "gush_code", "deal_date", F.round("price_millions", 9).alias("price_millions"), "area", "rooms", "build_year", "sale_portion")


def second_raw(d):
    """Deals as the second source's raw texts."""
    p = F.split("gush_code", "-")
    s = lambda c: F.col(c).cast("string")
    return d.select(
        F.col("record_id").alias("source_id"), F.col("city").alias("settlement"), F.lit("1").alias("settlement_code"), p[0].alias("gush"), p[1].alias("chelka"), p[2].alias("sub_chelka"), F.date_format("deal_date", "dd/MM/yyyy").alias("deal_date"),
        (F.col("price_millions") * 1e6).cast("string").alias("deal_amount"), F.lit("").alias("declared_amount"), F.col("apt_type").alias("deal_nature"), s("sale_portion").alias("portion"), s("build_year").alias("year_built"), s("area").alias("asset_area"),
        s("rooms").alias("room_num"), F.lit("2026-01-02T03:04:05Z").alias("scraped_at"), F.lit(5).alias("source_version"), F.lit("f.csv").alias("source_file"), F.lit(2).alias("source_row"),
    )


STRICT = f""", ck as (select *, {KEY} as k from deals), lk as (select *, {KEY} as k from legacy),
cu as (select city, k, deal_date from ck where k is not null group by all having count(*) = 1), lu as (select city, k, deal_date from lk where k is not null group by all having count(*) = 1),
good as (select n.record_id, o.street, o.full_address, case when o.floor <> 999 then o.floor end as floor, case when o.build_floors <> 999 then o.build_floors end as build_floors, o.record_id as legacy_record_id from ck n join cu using (city, k, deal_date) join lk o using (city, k, deal_date) join lu using (city, k, deal_date)
 where n.sale_portion = 1 and abs(n.price_millions - o.price_millions) <= 0.001000001 and n.area > 0 and o.area > 0 and abs(n.area - o.area) <= 0.5 and n.rooms > 0 and o.rooms > 0 and abs(n.rooms - o.rooms) < 0.001 and not coalesce(n.build_year > 0 and o.build_year > 0 and n.build_year <> o.build_year, false)),
enriched as (select d.* exclude (street, full_address, floor, build_floors), g.street, g.full_address, g.floor, g.build_floors, g.legacy_record_id, case when g.legacy_record_id is null then 'unmatched' else 'strict_transaction' end as legacy_match from deals d left join good g using (record_id))"""


@register("F1_strict_enrich", f"{WITH} {STRICT} select record_id, street, full_address, floor, build_floors, legacy_record_id, legacy_match from enriched")
def f1(spark, sf_dir):
    return linkage.strict_enrich(deals(spark, sf_dir), legacy_deals(spark, sf_dir)).select("record_id", "street", "full_address", "floor", "build_floors", "legacy_record_id", "legacy_match")


UK = "case when gush = 1 then gush_code else concat_ws('-', gush_code, substring(city, 8)) end"


@register("F2_link_by_property", f"{WITH} {STRICT} {OLD_UNITS}, rf as (select city, unit_key, min(street) as s, min(full_address) as a, min(case when floor between -10 and 200 then floor end) as f, string_agg(record_id, ';' order by record_id) as ref from old group by all having count(distinct street) = 1 and count(distinct full_address) = 1 and count(distinct case when floor between -10 and 200 then floor end) <= 1), e as (select *, case when gush_code not like '%-0' then {UK} end as unit_key from enriched), j as (select e.*, s, a, f, ref, coalesce((street is null and s is not null) or (full_address is null and a is not null) or (floor is null and f is not null), false) as added from e left join rf using (city, unit_key)) select record_id, coalesce(street, s) as street, coalesce(floor, f) as floor, case when added then 'property_reference' else legacy_match end as location_basis, case when added then ref else legacy_record_id end as location_reference_id, concat_ws(';', case when coalesce(full_address, a) is null then 'missing_address' end, case when coalesce(floor, f) is null then 'missing_floor' end, case when area is null then 'missing_area' end, case when rooms is null then 'missing_rooms' end, case when added then 'location_reference' end) as quality_flags from j")
def f2(spark, sf_dir):
    base = joined(spark, sf_dir)
    cur = linkage.strict_enrich(deals(spark, sf_dir, base), legacy_deals(spark, sf_dir, base))
    key = F.when(~F.col("gush_code").endswith("-0"), F.when(F.col("gush") == 1, F.col("gush_code")).otherwise(F.concat_ws("-", "gush_code", F.substr("city", F.lit(8)))))
    out = linkage.link_by_property(cur.withColumn("unit_key", key), old_units(spark, sf_dir, base))
    return out.select("record_id", "street", "floor", "location_basis", "location_reference_id", "quality_flags")


@register("F3_labels", f"{WITH} {DESCR} select d.record_id, descr.gush_desc as gush_label from deals d join descr using (city, gush)")
def f3(spark, sf_dir):
    return linkage.with_label(deals(spark, sf_dir), descriptions(spark, sf_dir)).select("record_id", "gush_label")


@register("F4_navigation", f"{WITH} select 'city' as what, city as value from (select distinct city from gush_streets where gush = 7) union all select 'gush', cast(cast(gush as int) as varchar) from (select distinct gush from gush_streets where city = 'NATION_3')")
def f4(spark, sf_dir):
    s = gush_streets(spark, sf_dir)
    a = linkage.cities_of(s, [7.0]).select(F.lit("city").alias("what"), F.col("city").alias("value"))
    return a.unionByName(linkage.gushes_of(s, "NATION_3").select(F.lit("gush").alias("what"), F.col("gush").cast("int").cast("string").alias("value")))


@register("F5_search_gush", f"{WITH} {DESCR}, q as (select unnest(['nation_3 7', 'red', '12']) as query), own as (select query, city, gush, min(case when starts_with(t, query) then 0 else 1 end) as rank from q, (select city, gush, unnest([cast(cast(gush as int) as varchar), lower(gush_desc), lower(city), lower(street)]) as t from descr) where contains(t, query) group by all), st as (select query, city, gush, case when starts_with(lower(street), query) then 0 else 2 end as rank from q, gush_streets where contains(lower(street), query)), b as (select query, city, gush, min(rank) as rank from (select * from own union all select * from st) group by all), p as (select *, row_number() over (partition by query order by rank, city, gush) as place from b) select query, city, gush, rank, place, gush_desc as gush_label from p join descr using (city, gush) where place <= 25")
def f5(spark, sf_dir):
    q = spark.createDataFrame([("nation_3 7",), ("red",), ("12",)], "query string")
    return linkage.search_gush(q, descriptions(spark, sf_dir), gush_streets(spark, sf_dir))


@register("F6_search_street", f"{WITH} select city, street, string_agg(cast(cast(gush as int) as varchar), ',' order by gush) as gush_ids, case when starts_with(lower(street), 'red') then 0 else 1 end as rank from gush_streets where contains(lower(street), 'red') group by city, street order by rank, city, street limit 25")
def f6(spark, sf_dir):
    out = linkage.search_street(gush_streets(spark, sf_dir), "red", descriptions(spark, sf_dir))
    return out.select("city", "street", F.array_join(F.transform("gush_ids", lambda g: g.cast("int").cast("string")), ",").alias("gush_ids"), "rank")


@register("F7_polygons", f"{WITH} {DESCR}, asked as (select gush, min(gush_desc) as label from descr where city = 'NATION_3' or gush = 50 group by gush), poly as (select distinct gush, city as poly_city, city || ':' || cast(cast(gush as int) as varchar) as geometry from deals where gush % 3 <> 0), m as (select asked.*, poly_city, geometry, rank() over (partition by asked.gush order by coalesce(lower(poly_city) = 'nation_3', false) desc) as r from asked left join poly using (gush)), c as (select gush, count(*) as deals from deals where city = 'NATION_3' group by gush) select gush, label, geometry, coalesce(deals, 0) as deals, gush = 50 as selected, geometry is null as missing from m left join c using (gush) where r = 1")
def f7(spark, sf_dir):
    d = deals(spark, sf_dir)
    poly = d.where("gush % 3 <> 0").select("gush", F.col("city").alias("poly_city"), F.concat_ws(":", "city", F.col("gush").cast("int").cast("string")).alias("geometry")).distinct()
    counts = d.where("city = 'NATION_3'").groupBy("gush").agg(F.count("*").alias("deals"))
    return linkage.attach_polygons(descriptions(spark, sf_dir), poly, "NATION_3", [50.0], counts).select("gush", "label", "geometry", "deals", "selected", "missing")


@register("F8_dedupe", f"{WITH} select max(record_id) as record_id, source_key from deals group by source_key")
def f8(spark, sf_dir):
    d = deals(spark, sf_dir)
    seq = lambda n: F.concat(F.lit(n), "record_id")
    twice = d.withColumn("seq", seq("1")).unionByName(d.withColumn("seq", seq("2"))).unionByName(d.where("gush = 4").withColumns({"source_key": F.lit(None).cast("string"), "seq": seq("3")}))
    return linkage.dedupe(twice).select("record_id", "source_key")


@register("F9_shared_gush", f"{WITH}, p as (select distinct gush, city from deals), m as (select *, count(*) over (partition by gush) as n, row_number() over (partition by gush order by city) as k from p) select record_id, case when n > 1 then d.gush * 10 + k else d.gush end as gush from deals d join m on m.gush = d.gush and m.city = d.city")
def f9(spark, sf_dir):
    return linkage.split_shared_gush(deals(spark, sf_dir)).select("record_id", "gush")


HIST = f"{OLD_UNITS}, both_ as (select record_id, {U}, price_millions, 'current' as source from units union all select record_id, {U}, price_millions, 'legacy' from old)"


@register("F11_deal_history", f"{WITH} {HIST}, ds as (select city, unit_key, count(distinct deal_date) as dates from both_ group by all), nr as (select distinct x.record_id, x.source from both_ x join both_ y using ({U}) where x.source <> y.source and abs(x.price_millions * 1e6 - y.price_millions * 1e6) <= 1000) select b.record_id, b.source, b.city, b.unit_key, b.deal_date, count(*) over (partition by b.city, b.unit_key) as records, count(*) over (partition by b.city, b.unit_key, b.deal_date) > 1 as same_date, dates, nr.record_id is not null as parallel_source from both_ b join ds using (city, unit_key) left join nr on nr.record_id = b.record_id and nr.source = b.source")
def f11(spark, sf_dir):
    base = joined(spark, sf_dir)
    return linkage.deal_history(units(spark, sf_dir, base), old_units(spark, sf_dir, base)).drop("price_millions")


@register("F12_pair_parallel", f"{WITH} {OLD_UNITS}, n as (select {U}, c.record_id as current_id, o.record_id as legacy_id from units c join old o using ({U}) where c.sale_portion = 1 and abs(c.price_millions - o.price_millions) * 1e6 <= 1000) select * from n where current_id in (select current_id from n group by 1 having count(*) = 1) and legacy_id in (select legacy_id from n group by 1 having count(*) = 1)")
def f12(spark, sf_dir):
    base = joined(spark, sf_dir)
    return linkage.pair_parallel(units(spark, sf_dir, base), old_units(spark, sf_dir, base)).drop("price_millions", "legacy_price")


@register("F13_resolve_areas", f"{WITH} {DESCR} select distinct city, gush from gush_streets where gush in (7, 11) or (city = 'NATION_3' and street in (select min(street) from deals where city = 'NATION_3')) union select city, gush from descr where gush_desc in (select min(gush_desc) from descr)")
def f13(spark, sf_dir):
    """Blocks by number in all cities, by a street of one, and by a label."""
    d = descriptions(spark, sf_dir)
    label = d.agg(F.min("gush_desc")).first()[0]
    street = deals(spark, sf_dir).where("city = 'NATION_3'").agg(F.min("street")).first()[0]
    return linkage.resolve_areas(d, gush_streets(spark, sf_dir), ids=[7.0, 11.0], labels=[label], city_streets=[("NATION_3", street)], most=10_000)


@register("F14_by_date", f"{WITH} {HIST}, nr as (select distinct x.record_id, x.source from both_ x join both_ y using ({U}) where x.source <> y.source and abs(x.price_millions * 1e6 - y.price_millions * 1e6) <= 1000) select {U}, count(*) as records, string_agg(distinct b.source, ',' order by b.source) as sources, string_agg(b.source || ':' || b.record_id || ':' || case when nr.record_id is null then 'alone' else 'parallel' end, ';' order by b.source, b.record_id) as list from both_ b left join nr on nr.record_id = b.record_id and nr.source = b.source group by {U}")
def f14(spark, sf_dir):
    base = joined(spark, sf_dir)
    days = linkage.by_date(linkage.deal_history(units(spark, sf_dir, base), old_units(spark, sf_dir, base)))
    said = F.transform("list", lambda x: F.concat_ws(":", x["source"], x["record_id"], F.when(x["parallel_source"], "parallel").otherwise("alone")))
    return days.withColumn("list", F.array_join(said, ";"))


COLS = ["city", "street", "gush", "area", "rooms", "floor", "roof", "build_year", "sale_portion"]
NUMBERS = ["gush", "area", "rooms", "floor", "build_year", "sale_portion"]


def _profile_sql(c: str) -> str:
    z = f"count(*) filter (where {c} = 0), count(*) filter (where {c} < 0)" if c in NUMBERS else "null, null"
    return f"select '{c}', count(*) filter (where {c} is null), {z} from deals"


@register("E16_profile", f"{WITH} select * from (" + " union all ".join(map(_profile_sql, COLS)) + ") as t(name, missing, zero, negative)")
def e16(spark, sf_dir):
    return quality.profile(deals(spark, sf_dir), COLS, NUMBERS)


@register("E16_anomalies", f"{WITH} select count(*) as rows, count(*) filter (where sale_portion = 1) as \"full\", count(*) filter (where sale_portion > 0 and sale_portion < 1) as partial, count(*) filter (where sale_portion is null) as unknown, count(*) filter (where gush_code like '%-0') as sub_parcel_zero, count(*) filter (where build_year > deal_year) as built_after_deal, count(*) filter (where area > 1000) as large, count(*) filter (where rooms > 20) as many_rooms, min(deal_date) as first_date, max(deal_date) as last_date from deals")
def e16_anomalies(spark, sf_dir):
    return quality.anomalies(deals(spark, sf_dir))


@register("E16_value_counts", f"{WITH} select 'city' as name, city as value, count(*) as n from deals group by city union all select 'apt_type', apt_type, count(*) from deals group by apt_type union all select 'city+roof', city || '|' || coalesce(roof, ''), count(*) from deals group by city, roof")
def e16_counts(spark, sf_dir):
    return quality.value_counts(deals(spark, sf_dir), [["city"], ["apt_type"], ["city", "roof"]])


@register("E17_duplicates", f"{WITH}, g as (select city, gush_code, rooms, count(*) as n from deals group by all) select cast(sum(n) as bigint) as rows, count(*) as \"unique\", cast(sum(n) - count(*) as bigint) as excess, cast(sum(n) filter (where n > 1) as bigint) as affected from g")
def e17(spark, sf_dir):
    return quality.duplicate_counts(deals(spark, sf_dir), ["city", "gush_code", "rooms"])


@register("E18_compare_sets", f"{WITH}, a as (select distinct city, gush_code, area from deals), b as (select distinct city, gush_code, area from legacy) select (select count(*) from (select * from a intersect select * from b)) as shared, (select count(*) from (select * from a except select * from b)) as only_left, (select count(*) from (select * from b except select * from a)) as only_right")
def e18(spark, sf_dir):
    return quality.compare_sets(deals(spark, sf_dir), legacy_deals(spark, sf_dir), ["city", "gush_code", "area"])


@register("E19_append_extras", f"{WITH}, s as (select price_millions, area, strftime(deal_date, '%Y-%m-%d') as deal_date, gush_code, city from legacy), a as (select price_millions, area, strftime(deal_date, '%Y-%m-%d') as deal_date, gush_code, city from deals), x as (select a.* from a where not exists (select 1 from s where s.price_millions is not distinct from a.price_millions and s.area is not distinct from a.area and s.deal_date = a.deal_date and s.gush_code = a.gush_code and s.city = a.city)), l as (select distinct price_millions, area, deal_date, gush_code, 1 as l from s), w as (select distinct gush_code, deal_date, 1 as w from s) select x.*, case when l.l = 1 then 'same_but_place' when w.w = 1 then 'same_property_day' else 'none' end as nearness from x left join l using (price_millions, area, deal_date, gush_code) left join w using (gush_code, deal_date)")
def e19(spark, sf_dir):
    form = lambda df: quality.canonical(df, ["price_millions", "area"], ["deal_date"], ["gush_code", "city"])
    return quality.append_extras(form(legacy_deals(spark, sf_dir)), form(deals(spark, sf_dir)), ["price_millions", "area", "deal_date", "gush_code"], ["gush_code", "deal_date"]).drop("property_day")


def _repeat_sql(source: str, extra: str = "") -> str:
    return f"(with ev as (select unit_key, deal_date, count(*) as n from ({source}) group by all), pp as (select unit_key, sum(n) as r, count(*) as d, count(distinct year(deal_date)) as y from ev group by all) select cast(sum(r) as bigint) as rows, cast(sum(d) as bigint) as property_dates, cast(sum(r) - sum(d) as bigint) as collapsed, count(*) as properties, count(*) filter (where d >= 2) as dates_2plus, count(*) filter (where d >= 3) as dates_3plus, count(*) filter (where d = 2) as dates_exactly_2, count(*) filter (where y >= 2) as years_2plus, count(*) filter (where y >= 3) as years_3plus, max(d) as most_dates{extra} from pp)"


@register("E20_repeat_sales", f"{WITH} select * from {_repeat_sql('select * from units')}")
def e20(spark, sf_dir):
    return quality.repeat_sales(units(spark, sf_dir))


@register("E20_repeat_sale_list", f"{WITH} select unit_key, count(distinct deal_date) as dates, min(deal_date) as first_date, max(deal_date) as last_date from units group by 1 having count(distinct deal_date) >= 2")
def e20_list(spark, sf_dir):
    return quality.repeat_sale_list(units(spark, sf_dir))


@register("E20_repeat_sale_distribution", f"{WITH} select dates, count(*) as properties from (select unit_key, count(distinct deal_date) as dates from units group by 1) group by 1")
def e20_distribution(spark, sf_dir):
    return quality.repeat_sale_distribution(units(spark, sf_dir))


SCOPES = {"all": "true", "residential": "apt_type <> 'PROMO' and price_millions > 0", "residential_whole": "apt_type <> 'PROMO' and price_millions > 0 and sale_portion = 1", "apartments": "apt_type = 'STANDARD' and price_millions > 0", "apartments_whole": "apt_type = 'STANDARD' and price_millions > 0 and sale_portion = 1"}


@register("E21_repeat_sale_scopes", f"{WITH} " + " union all ".join("select * from " + _repeat_sql(f"select * from units where {c}", f", '{n}' as scope") for n, c in SCOPES.items()))
def e21(spark, sf_dir):
    return quality.repeat_sale_scopes(units(spark, sf_dir), quality.scopes(F.col("apt_type") != "PROMO", F.col("apt_type") == "STANDARD"))


CONFLICT = "select unit_key from units group by 1 having count(distinct city) > 1"


@register("E22_stable_profiles", f"{WITH} select unit_key, max(d) as dates from (select unit_key, area, rooms, count(distinct deal_date) as d from units where area > 0 and rooms > 0 and unit_key not in ({CONFLICT}) group by all) group by unit_key")
def e22(spark, sf_dir):
    return quality.stable_profiles(units(spark, sf_dir))


@register("E23_consistent_units", f"{WITH} select record_id, unit_key from units where unit_key in (select unit_key from units group by 1 having count(area) = count(*) and count(rooms) = count(*) and count(distinct area) = 1 and count(distinct rooms) = 1 and min(area) > 0 and min(rooms) > 0) and unit_key not in ({CONFLICT})")
def e23(spark, sf_dir):
    return quality.consistent_units(units(spark, sf_dir)).select("record_id", "unit_key")


@register("E24_reconcile_prices", f"{WITH} {OLD_UNITS}, a as (select {U}, min(price_millions) * 1e6 as o from old group by {U} having count(*) = 1), b as (select {U}, min(price_millions) * 1e6 as n, min(sale_portion) as p from units group by {U} having count(*) = 1) select city, case when p = 1 then 'whole' else 'partial' end as portion_group, count(*) as candidates, count(*) filter (where abs(o - n) <= 1) as within_1, count(*) filter (where abs(o - n) <= 500) as within_500, count(*) filter (where abs(o - n) <= 1000) as within_1000, count(*) filter (where abs(o - n / p) <= 1000) as by_portion_within_1000 from a join b using ({U}) where p is not null group by 1, 2")
def e24(spark, sf_dir):
    return quality.reconcile_prices(units(spark, sf_dir), old_units(spark, sf_dir))


@register("E25_compare_sources", f"{WITH} {OLD_UNITS}, c as (select city, count(*) as current_rows, count(*) filter (where deal_year >= 1997) as current_recent, max(deal_date) as current_last from units group by 1), l as (select city, count(*) as legacy_rows, count(*) filter (where deal_year >= 1997) as legacy_recent, max(deal_date) as legacy_last from old group by 1), ds as (select {U}, min(price_millions) as lo, max(price_millions) as hi from old group by {U}), ks as (select distinct city, unit_key, true as u from old), m as (select city, count(*) filter (where lo is not null) as key_matches, count(*) filter (where lo = hi and abs(price_millions - lo) <= 0.001) as equal_amounts, count(*) filter (where u and lo is null) as known_unit_new_day from units left join ds using ({U}) left join ks using (city, unit_key) group by 1), x as (select city, count(*) filter (where d > 1) as multi_date_units from (select city, unit_key, count(distinct deal_date) as d from units group by all) group by 1) select * from c full join l using (city) left join m using (city) left join x using (city)")
def e25(spark, sf_dir):
    return quality.compare_sources(units(spark, sf_dir), old_units(spark, sf_dir), 1997)


@register("E26_link_waterfall", f"{WITH} {STRICT}, n as (select city, k, deal_date, count(*) as nn, max(sale_portion) as p from ck where k is not null group by all), o as (select city, k, deal_date, count(*) as oo from lk where k is not null group by all), w as (select case when lk.record_id in (select legacy_record_id from good) then 'enriched' when lk.k is null then 'invalid_key' when nn is null then 'no_key_and_date' when nn > 1 then 'new_key_ambiguous' when oo > 1 then 'legacy_key_ambiguous' when p is null or p <> 1 then 'share_not_full' else 'attributes_disagree' end as reason from lk left join n using (city, k, deal_date) left join o using (city, k, deal_date)) select reason, count(*) as n from w group by 1")
def e26(spark, sf_dir):
    key, base = clean.cadastral_key("gush_code"), joined(spark, sf_dir)
    cur, old = deals(spark, sf_dir, base), legacy_deals(spark, sf_dir, base)
    linked = linkage.strict_links(cur, old).withColumnRenamed("_key", "k")
    return quality.link_waterfall(old.withColumn("k", key), cur.withColumn("k", key), linked, "k").groupBy("reason").agg(F.count("*").alias("n"))


@register("E40_compare_snapshots", f"{WITH}, a as (select city, deal_year, count(*) as o from legacy group by all), b as (select city, deal_year, count(*) as n from deals group by all) select city, deal_year, coalesce(o, 0) as old_rows, coalesce(n, 0) as new_rows, coalesce(n, 0) - coalesce(o, 0) as difference from a full join b using (city, deal_year)")
def e40(spark, sf_dir):
    return quality.compare_snapshots(legacy_deals(spark, sf_dir), deals(spark, sf_dir), ["city", "deal_year"])


DEFINITIONS = {"strict": ["city", "unit_key"], "parcel_street": ["city", "gush", "street"], "unit_like": ["city", "gush", "street", "floor"]}


def _candidate_sql(name: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    full = " and ".join(f"{c} is not null" for c in keys)
    return f"select '{name}' as definition, record_id from units semi join (select {k} from old) using ({k}) anti join (select {k}, deal_date from old) using ({k}, deal_date) where {full}"


@register("E41_repeat_candidates", f"{WITH} {OLD_UNITS} select definition, record_id from (" + " union all ".join(_candidate_sql(n, k) for n, k in DEFINITIONS.items()) + ")")
def e41(spark, sf_dir):
    old, new, out = old_units(spark, sf_dir), units(spark, sf_dir), None
    for name, keys in DEFINITIONS.items():
        one = quality.repeat_candidates(old, new, keys).select(F.lit(name).alias("definition"), "record_id")
        out = one if out is None else out.unionByName(one)
    return out


@register("I1_union", f"{WITH} select record_id from deals where city = 'NATION_1' union all select record_id from deals where city = 'NATION_2'")
def i1(spark, sf_dir):
    d = deals(spark, sf_dir)
    return d.where("city = 'NATION_1'").unionByName(d.where("city = 'NATION_2'")).select("record_id")


@register("I2_drop_duplicates", f"{WITH}, r as (select *, row_number() over (partition by city, gush order by deal_date, record_id) as r from deals) select city, gush, record_id from r where r = 1")
def i2(spark, sf_dir):
    first = deals(spark, sf_dir).groupBy("city", "gush").agg(F.min(F.struct("deal_date", "record_id")).alias("f"))
    return first.select("city", "gush", "f.record_id")


@register("I3_set_differences", f"{WITH} select 'both' as side, count(*) as n from (select city, gush from deals where deal_year < 1996 intersect select city, gush from deals where deal_year >= 1996) union all select 'left', count(*) from (select city, gush from deals where deal_year < 1996 except select city, gush from deals where deal_year >= 1996) union all select 'right', count(*) from (select city, gush from deals where deal_year >= 1996 except select city, gush from deals where deal_year < 1996)")
def i3(spark, sf_dir):
    d = deals(spark, sf_dir)
    a, b = d.where("deal_year < 1996").select("city", "gush"), d.where("deal_year >= 1996").select("city", "gush")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "left")).unionByName(count(b.subtract(a), "right"))


@register("I4_shared_by_all", f"{WITH} select deal_year from deals group by 1 having count(distinct city) = (select count(distinct city) from deals)")
def i4(spark, sf_dir):
    d = deals(spark, sf_dir)
    n = F.broadcast(d.agg(F.countDistinct("city").alias("cities")))
    return d.groupBy("deal_year").agg(F.countDistinct("city").alias("n")).crossJoin(n).where("n = cities").select("deal_year")
