"""Queries of address lookups and searches over tables of queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import addresses
from . import jobs
from .fixtures import WITH, legacy_deals, units
from .registry import register

#: The second source with property keys; rows without a valid one stay.
ALL_OLD = ", old as (select *, case when gush_code like '%-0' then null when gush = 1 then gush_code else concat_ws('-', gush_code, substring(city, 8)) end as unit_key from legacy)"


def all_old(spark, sf_dir) -> DataFrame:
    key = F.when(F.col("gush") == 1, F.col("gush_code")).otherwise(F.concat_ws("-", "gush_code", F.substr("city", F.lit(8))))
    return legacy_deals(spark, sf_dir).withColumn("unit_key", F.when(~F.col("gush_code").endswith("-0"), key))


def lookup_sql(queries: str, most: int) -> str:
    """CTEs up to ``rows``: each query against every address of its city."""
    holds = "len(list_filter(toks, lambda t: not case when regexp_full_match(t, '[0-9]+') then list_contains(regexp_extract_all(o.full_address, '[0-9]+'), t) else contains(lower(o.full_address), t) end)) = 0"
    listed = lambda c: f"coalesce(string_agg(distinct {c}, ' / ' order by {c}), '')"
    return f"""{WITH} {ALL_OLD}, q as ({queries}),
qs as (select query_id, city, floor as asked, year_from, year_to, trim(address) as address, list_filter(list_distinct(regexp_extract_all(lower(address), '[a-z0-9]+')), lambda t: true) as toks from q),
ql as (select *, case when city is null or len(address) not between 2 and 160 or len(toks) = 0 then 'no address' when not (1900 <= year_from and year_from <= year_to and year_to <= 2100) or not coalesce(asked between -10 and 200, true) then 'years or floor' end as refused from qs),
hit as (select query_id, asked, year_from, year_to, o.* from ql join old o on o.city = ql.city where refused is null and {holds} and (asked is null or o.floor = asked)),
fl as (select query_id, city, unit_key, string_agg(cast(floor as bigint), ' / ' order by floor) as fs from (select distinct query_id, city, unit_key, floor from hit where floor <> 999) group by all),
us as (select query_id, city, unit_key, {listed("full_address")} as ua, {listed("street")} as us_, count(*) as un from hit where unit_key is not null group by all),
ov as (select query_id from us group by query_id having count(*) > {most}),
found as (select * from hit anti join ov using (query_id)), uk as (select * from us anti join ov using (query_id)),
cn as (select units.* from units semi join uk using (city, unit_key)), od as (select old.* from old semi join uk using (city, unit_key)),
ca as (select city, unit_key, deal_date, min(record_id) as cid from cn group by all having count(*) = 1), oa as (select city, unit_key, deal_date, min(record_id) as lid from od group by all having count(*) = 1),
pr as (select cid, lid, o.full_address as da, o.street as ds, case when o.floor <> 999 then cast(cast(o.floor as bigint) as varchar) end as df, o.area as oar, o.rooms as oro, o.build_year as oby,
  concat_ws(',', case when abs(n.area - o.area) <= 0.5 then null else 'area' end, case when abs(n.rooms - o.rooms) <= 0.001 then null else 'rooms' end, case when n.build_year = o.build_year then null else 'build_year' end) as d
  from ca join oa using (city, unit_key, deal_date) join units n on n.record_id = cid join old o on o.record_id = lid where n.sale_portion = 1 and abs(n.price_millions - o.price_millions) <= 0.001000001),
su as (select found.query_id, pr.* from found join pr on found.record_id = pr.lid),
mx as (select city, unit_key, count(distinct full_address) > 1 or count(distinct floor) > 1 as mixed from od group by all),
rows as (
  select uk.query_id, case when lid is null then 'candidate' else 'confirmed' end as status, c.record_id, c.city, c.unit_key, c.deal_date, c.price_millions * 1e6 as price_ils, c.sale_portion, c.area, c.rooms, c.build_year, lid as legacy_record_id, oar as legacy_area, oro as legacy_rooms, oby as legacy_build_year,
    case when lid is null then ua else da end as reference_address, case when lid is null then us_ else ds end as reference_streets, coalesce(case when lid is null then fs else df end, '') as reference_floor, case when lid is null then un else 1 end as "references",
    coalesce(nullif(concat_ws(',', nullif(d, ''), case when mixed then 'references' end), ''), case when lid is null then 'unchecked' else 'none' end) as conflicts
  from uk join cn c using (city, unit_key) left join su on su.query_id = uk.query_id and su.cid = c.record_id left join fl on fl.query_id = uk.query_id and fl.city = uk.city and fl.unit_key = uk.unit_key left join mx on mx.city = uk.city and mx.unit_key = uk.unit_key
  union all select query_id, 'legacy', record_id, city, unit_key, deal_date, price_millions * 1e6, null, area, rooms, build_year, null, null, null, null, full_address, street, coalesce(cast(cast(floor as bigint) as varchar), ''), 1, 'share unknown' from found where (query_id, record_id) not in (select query_id, lid from su)
), shown as (
  select rows.* from rows join ql using (query_id) where year(deal_date) between year_from and year_to
  union all select query_id, 'refused', null, city, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, refused from ql where refused is not null
  union all select query_id, 'refused', null, city, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, 'too many properties' from ql semi join ov using (query_id)
)"""


RED = "select 'one:' || city as query_id, city, 'red 12' as address, null::double as floor, 1990 as year_from, 2026 as year_to from (select distinct city from legacy)"
#: Of each city: words with a number, part of a word, a floor, a whole address, and what is refused.
ASKED = [("red", "red 12", None, 1990, 2026), ("part", "lu 7", None, 1990, 1997), ("floor", " 12, RED", 3.0, 1990, 2026), ("street", "green 1", None, 1998, 2026), ("many", "ed", None, 1990, 2026), ("short", "e ", None, 1990, 2026), ("blank", "-- !", None, 1990, 2026), ("years", "red 12", None, 2001, 2000), ("high", "red 12", 201.0, 1990, 2026)]
_VALUES = ", ".join(f"('{n}', '{a}', {'null' if f is None else f}::double, {y}, {z})" for n, a, f, y, z in ASKED)
MANY = f"""select k || ':' || city as query_id, city, a as address, f as floor, y as year_from, z as year_to from (select distinct city from legacy), (values {_VALUES}) v(k, a, f, y, z)
union all select 'whole:' || city, city, min(full_address), null, 1990, 2026 from legacy group by city union all select 'nowhere', null, 'red 12', null, 1990, 2026"""


@register("F10_lookup_addresses", f"{lookup_sql(RED, 10**6)} select * from shown")
def f10(spark, sf_dir):
    return addresses.lookup_address(all_old(spark, sf_dir), units(spark, sf_dir), "red 12", years=(1990, 2026), most=10**6)


def many_queries(spark, sf_dir) -> DataFrame:
    old = legacy_deals(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("address"), F.lit(f).cast("double").alias("floor"), F.lit(y).alias("year_from"), F.lit(z).alias("year_to")) for n, a, f, y, z in ASKED])
    out = old.select("city").distinct().select("city", F.inline(each)).select(F.concat_ws(":", "n", "city").alias("query_id"), "city", "address", "floor", "year_from", "year_to")
    none = F.lit(None).cast("double").alias("floor")
    whole = old.groupBy("city").agg(F.min("full_address").alias("address")).select(F.concat_ws(":", F.lit("whole"), "city").alias("query_id"), "city", "address", none, F.lit(1990).alias("year_from"), F.lit(2026).alias("year_to"))
    nowhere = spark.range(1).select(F.lit("nowhere").alias("query_id"), F.lit(None).cast("string").alias("city"), F.lit("red 12").alias("address"), none, F.lit(1990).alias("year_from"), F.lit(2026).alias("year_to"))
    return out.unionByName(whole).unionByName(nowhere)


@register("F10_lookup_batch", f"{lookup_sql(MANY, 50)} select * from shown")
def f10_batch(spark, sf_dir):
    return addresses.lookup_addresses(all_old(spark, sf_dir), units(spark, sf_dir), many_queries(spark, sf_dir))


@register("N12_address_lookup", f"{lookup_sql(RED, 10**6)} select city, unit_key, deal_date, count(*) as n, count(*) filter (status = 'confirmed') as confirmed from shown group by all")
def n12(spark, sf_dir):
    rows = jobs.address_job(all_old(spark, sf_dir), units(spark, sf_dir), "red 12", years=(1990, 2026), most=10**6)["lookup"]
    return rows.groupBy("city", "unit_key", "deal_date").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
