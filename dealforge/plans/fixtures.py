"""The deals view over the star-schema tables, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stage import staged

TABLES = ("nation", "customer", "part", "orders", "lineitem")

DEALS = """
select md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
                     cast(l_suppkey as string), cast(cast(l_shipdate as date) as string),
                     cast(cast(l_quantity as int) as string))) as record_id,
       concat_ws(':', cast(l_orderkey as string), cast(l_linenumber as string)) as source_key,
       n_name as city, p_name as street, cast(p_size as double) as gush,
       concat_ws('-', cast(p_size as string), cast(l_partkey % 97 + 1 as string), cast(l_linenumber - 1 as string)) as gush_code,
       concat(p_name, ' ', cast(l_suppkey % 40 + 1 as string), ', ', n_name) as full_address,
       cast(l_shipdate as date) as deal_date, cast(year(l_shipdate) as double) as deal_year,
       cast(l_extendedprice * case when l_orderkey % 499 = 0 then 1000 else 40 end / 1e6 as double) as price_millions,
       case when l_quantity = 50 then null else l_quantity * 3 end as area,
       cast(case when l_linenumber = 7 then 999.0 when l_tax > 0.075 then null
                 else l_linenumber + case when l_suppkey % 4 = 0 then 0.5 else 0.0 end end as double) as rooms,
       case when l_suppkey % 13 = 0 then cast(999 as double) when l_suppkey % 17 = 0 then null
            else cast(l_partkey % 12 - 1 as double) end as floor,
       case when l_partkey % 19 = 0 then cast(999 as double) else cast(4 + l_partkey % 10 as double) end as build_floors,
       case l_returnflag when 'R' then 'TRUE' when 'A' then 'no' else null end as roof,
       p_type as apt_type, case l_linestatus when 'O' then 'New Project' else '2nd hand' end as new_project,
       case when l_partkey % 23 = 0 then cast(0 as double) when l_partkey % 29 = 0 then null
            else cast(year(o_orderdate) - l_partkey % 70 as double) end as build_year,
       case when l_partkey % 23 = 0 then cast(year(l_shipdate) as double) when l_partkey % 29 = 0 then null
            else cast(year(l_shipdate) - (year(o_orderdate) - l_partkey % 70) as double) end as building_age,
       cast(case when l_discount < 0.075 then 1.0 when l_discount < 0.095 then 0.5 else null end as double) as sale_portion
from lineitem
join orders on o_orderkey = l_orderkey
join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey
join part on p_partkey = l_partkey
"""
#: A second source: two thirds of the deals, some with a rounded price or another area.
LEGACY = """
select record_id, source_key, city, street, gush, gush_code, full_address, deal_date, deal_year,
       round(price_millions, 3) as price_millions, case when gush % 5 = 0 then area + 2 else area end as area,
       rooms, floor, build_floors, roof, apt_type, new_project, build_year, building_age
from deals where ascii(record_id) % 3 <> 0
"""
#: Deals with a property key that names one place, but for block 1, whose keys recur in many cities.
UNITS = """
select *, case when gush = 1 then gush_code else concat_ws('-', gush_code, substring(city, 8)) end as unit_key
from deals where gush_code not like '%-0'
"""
BENCH_INDEX = "select distinct cast(deal_year as int) as year, 100 + 10 * (deal_year - 1995) as index_value from deals where deal_year is not null"
STREETS = "select distinct city, gush, street from deals"
SNAPSHOT_YEAR = 2001

#: Start of every oracle: the views as common table expressions.
WITH = f"with deals as ({DEALS}), legacy as ({LEGACY}), units as ({UNITS}), bench as ({BENCH_INDEX}), gush_streets as ({STREETS})"


#: What the deals view reads, as one table; the small sides meet first, so that a row of lineitem is shuffled twice.
JOINED = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, o_orderdate, n_name, p_name, p_size, p_type
from {lineitem}
join (select o_orderkey, o_orderdate, n_name from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey) on o_orderkey = l_orderkey
join {part} on p_partkey = l_partkey
"""


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined tables as written once, for queries that read several views or one several times."""
    return staged(_joined(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOINED, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def _view(spark: SparkSession, sf_dir: str, sql: str, base: DataFrame | None) -> DataFrame:
    text = DEALS[: DEALS.index("from lineitem\n")] + "from {base}"
    return spark.sql(f"with deals as ({text}) {sql}", base=_joined(spark, sf_dir) if base is None else base)


def deals(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    return _view(spark, sf_dir, "select * from deals", base)


def legacy_deals(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    # DuckDB rounds the scaled double, Spark the decimal digits; prices halfway between two thousandths would differ
    return _view(spark, sf_dir, LEGACY.replace("round(price_millions, 3)", "round(price_millions * 1000) / 1000"), base)


def units(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    return _view(spark, sf_dir, UNITS, base)


def bench_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BENCH_INDEX, None)


def gush_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STREETS, None)
