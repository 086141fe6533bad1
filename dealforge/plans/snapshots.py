"""Queries of positions, publishing, snapshot measures and composed outputs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import clean
from ..functions.filters import FilterSpec
from ..operators import flags, linkage, quality, summary
from ..sources import tables
from ..sources.stage import scratch
from . import job_queries, jobs  # noqa: F401  the former registers the imports that are published here
from .basics import global_sql
from .fixtures import SNAPSHOT_YEAR, WITH, bench_index, deals, gush_streets, joined, legacy_deals, units
from .links import DESCR, OLD_UNITS, STRICT, U, descriptions, first_raw, old_units, raw_csv, second_raw
from .registry import ORACLES, register

# Sources -----------------------------------------------------------------------------------------


@register("A01_read_deals", f"{WITH} select city, price_millions, case when gush % 2 = 0 then source_key else 'legacy:' || city || ':' || (row_number() over (partition by city order by source_key, record_id) - 1) end as record_id from deals")
def a1(spark, sf_dir):
    """Half of the rows have a source id; the others get their place among their city's rows, of which equal ones stay apart."""
    path = scratch(spark)
    d = deals(spark, sf_dir).withColumn("source_id", F.when(F.col("gush") % 2 == 0, F.col("source_key")))
    d.repartition("city").sortWithinPartitions("city", "source_key", "record_id").drop("record_id").write.partitionBy("city").parquet(path)
    return tables.read_deals(spark, path).select("city", "price_millions", "record_id")


@register("A08_snapshot", f"{WITH} select record_id, city, 2 as source_version, true as in_order from deals where deal_year >= 1995")
def a8(spark, sf_dir):
    """Lines follow the order in which each file was written, from 2 on without gaps."""
    root, d = scratch(spark), deals(spark, sf_dir)
    raw_csv(d.where("deal_year < 1995"), f"{root}/v1")
    raw_csv(d.where("deal_year >= 1995").repartition(4, "city").sortWithinPartitions("record_id"), f"{root}/v2")
    got = tables.read_snapshot(spark, [{"version_number": 2, "files": ["v2"]}, {"version_number": 1, "files": ["v1"]}], root)
    line = F.row_number().over(W.partitionBy("source_file").orderBy("record_id", "source_row")) + 1
    return got.select("record_id", "city", "source_version", (line == F.col("source_row")).alias("in_order"))


@register("A11_roundtrip", f"{WITH} select city, count(*) as before_rows, count(*) as after_rows, 0 as lost, 0 as extra, true as same from deals group by city")
def a11(spark, sf_dir):
    """A table against itself as written and read back."""
    d, path = deals(spark, sf_dir, joined(spark, sf_dir)), scratch(spark)
    tables.write_deals(d, path)
    return tables.check_roundtrip(d, tables.read_deals(spark, path).select(*d.columns)).select("city", "before_rows", "after_rows", "lost", "extra", "same")


@register("A14_export", f"{WITH} select record_id as \"Record\", city as \"City\", price_millions as \"Price (millions)\", rooms as \"Rooms\", sale_portion from deals")
def a14(spark, sf_dir):
    """An export as its file tells, beside one without rows, whose file has the header alone."""
    d, path = deals(spark, sf_dir).select("sale_portion", "rooms", "record_id", "price_millions", "city"), scratch(spark)
    tables.write_export(d, f"{path}/all")
    tables.write_export(d.limit(0), f"{path}/none", single=True)
    schema = "`Record` string, `City` string, `Price (millions)` double, `Rooms` double, `sale_portion` double"
    read = lambda name: spark.read.schema(schema).option("header", True).csv(f"{path}/{name}")
    return read("all").unionByName(read("none"))


# Jobs that publish -------------------------------------------------------------------------------


@register("N07_published", f"select city, count(*) as blocks, sum(n)::bigint as n from ({ORACLES['N07_import_first']}) group by city")
def n7(spark, sf_dir):
    """The first import from raw files to published tables, as read back beside their coverage."""
    root, base = scratch(spark), joined(spark, sf_dir)
    raw = first_raw(deals(spark, sf_dir, base).withColumn("source_key", F.col("record_id"))).drop("resource_id")
    raw.write.option("header", True).csv(f"{root}/raw")
    names = [r[0] for r in spark.read.format("binaryFile").load(f"{root}/raw").select(F.element_at(F.split("path", "/"), -1)).collect()]  # one row per file
    jobs.run_import_first(spark, [f"{root}/raw"], dict.fromkeys(names, "r"), f"{root}/out", legacy_deals(spark, sf_dir, base).withColumn("area", F.col("area").cast("double")))
    there = tables.read_deals(spark, f"{root}/out/cities").groupBy("city").agg(F.countDistinct("gush").alias("blocks"), F.count("*").alias("n"))
    known = spark.read.parquet(f"{root}/out/coverage").select("city", F.col("rows").alias("n"))
    return there.join(known, ["city", "n"]).select("city", "blocks", "n")


@register("N08_published", f"select quality_flags, count(*) as n from ({ORACLES['N08_import_second']}) group by 1")
def n8(spark, sf_dir):
    """The second import of the latest version, its files checked against their inventory, as published."""
    root, base = scratch(spark), joined(spark, sf_dir)
    raw = second_raw(deals(spark, sf_dir, base)).drop("source_id", "source_version", "source_file", "source_row")
    raw.limit(0).write.option("header", True).csv(f"{root}/raw/v4")
    raw.write.option("header", True).csv(f"{root}/raw/v5")
    inventory = spark.read.format("binaryFile").load(f"{root}/raw/v5").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("header", True).csv(f"{root}/raw/v5").groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("rows"))
    inventory = inventory.join(rows, "file", "left").na.fill(0, ["rows"]).withColumn("folder", F.lit("v5"))
    types = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY"]
    jobs.run_import_second(spark, [{"version_number": 4, "files": ["v4"]}, {"version_number": 5, "files": ["v5"]}], f"{root}/raw", inventory, legacy_deals(spark, sf_dir, base), "1999-12-31", types, f"{root}/out")
    return tables.read_deals(spark, f"{root}/out/cities").groupBy("quality_flags").agg(F.count("*").alias("n"))


# Snapshot measures -------------------------------------------------------------------------------

CUTOFF, HOMES = "1999-12-31", ["STANDARD", "SMALL"]


def odd_raw(d):
    """Raw texts with what a profile looks for: days and numbers that are none, late days, odd shares, years, rooms and places."""
    g, paid = F.col("_g"), F.col("_paid")
    raw = second_raw(d).withColumns({"_g": F.col("gush").cast("int"), "_paid": F.col("deal_amount")})
    late = F.date_format(F.date_add(F.to_date("deal_date", "dd/MM/yyyy"), 10_000), "dd/MM/yyyy")
    other = F.when(F.col("room_num") == "2.0", "").when(F.col("room_num") == "3.0", paid).otherwise((paid.cast("double") + 1).cast("string"))
    return raw.withColumns({
        "declared_amount": other, "deal_amount": F.when(g == 8, "x").otherwise(paid), "deal_date": F.when(g == 3, "31/02/1999").when(g == 4, late).otherwise(F.col("deal_date")),
        "portion": F.when(g == 5, "1.5").otherwise(F.col("portion")), "room_num": F.when(g == 6, "-2").otherwise(F.col("room_num")), "year_built": F.when(g == 7, "2090").otherwise(F.col("year_built")),
        "settlement": F.when(g == 9, " ").otherwise(F.col("settlement")),
    }).drop("_g", "_paid")


ODD_RAW = """raw as (select case when gush = 3 then null when gush = 4 then deal_date + 10000 else deal_date end as day, gush, cast(split_part(gush_code, '-', 2) as double) as chelka, cast(split_part(gush_code, '-', 3) as double) as sub_chelka,
case when gush = 8 then null else price_millions * 1e6 end as deal_amount, case when rooms = 2 then null when rooms = 3 then price_millions * 1e6 else price_millions * 1e6 + 1 end as declared_amount, case when gush = 5 then 1.5 else sale_portion end as portion,
case when gush = 7 then 2090 else build_year end as year_built, area as asset_area, case when gush = 6 then -2 else rooms end as room_num, apt_type as deal_nature, gush = 9 as no_place from deals)"""
_USABLE = f"deal_nature in ('STANDARD', 'SMALL') and portion = 1 and day <= date '{CUTOFF}' and deal_amount > 0 and asset_area > 0"
MEASURES = {"rows": "true", "invalid_date": "day is null", "future_deal_date": f"day > date '{CUTOFF}'", "before_1998": "day < date '1998-01-01'"}
for _c in flags.RAW_NUMBERS:
    MEASURES |= {f"{_c}_missing_or_unparseable": f"{_c} is null", f"{_c}_zero": f"{_c} = 0", f"{_c}_negative": f"{_c} < 0"}
MEASURES |= {
    "partial_portion_0_to_1": "portion > 0 and portion < 1", "whole_portion_1": "portion = 1", "portion_above_1": "portion > 1", "amounts_differ": "deal_amount is null or declared_amount is null or deal_amount <> declared_amount", "subparcel_zero_or_missing": "coalesce(sub_chelka, 0) = 0",
    "year_built_after_deal": "year_built > year(day)", "year_built_after_cutoff_year": "year_built > 1999", "area_above_1000": "asset_area > 1000", "rooms_above_20": "room_num > 20", "residential_types_rows": "deal_nature in ('STANDARD', 'SMALL')",
    "residential_rooms_positive": "deal_nature in ('STANDARD', 'SMALL') and room_num > 0", "whole_residential_positive_area_price_valid_date": _USABLE, "whole_residential_usable_with_rooms": f"{_USABLE} and room_num > 0",
    "settlement_code_blank": "false", "settlement_blank": "no_place", "deal_date_blank": "false", "deal_nature_blank": "false",
}


def measured(conditions: dict[str, str], source: str, by: str = "") -> str:
    """One row per condition: rows of ``source`` that meet it and their share."""
    keys, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    return " union all ".join(f"select {keys}'{n}' as measure, count(*) filter (where {c}) as n, round_even(count(*) filter (where {c}) * 100.0 / count(*), 2)::double as pct from {source}{group}" for n, c in conditions.items())


@register("E16_raw_profile", f"{WITH}, {ODD_RAW} {measured(MEASURES, 'raw')}")
def e16_raw(spark, sf_dir):
    return flags.raw_profile(odd_raw(deals(spark, sf_dir)), CUTOFF, HOMES)


@register("E16_raw_extrema", f"{WITH}, {ODD_RAW} select min(day)::date as first_date, max(day)::date as last_date, timestamp '2026-01-02 03:04:05' as scraped_from, timestamp '2026-01-02 03:04:05' as scraped_to from raw")
def e16_extrema(spark, sf_dir):
    out = flags.raw_extrema(odd_raw(deals(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("scraped_from", "scraped_to")})


FIELDS = ["floor", "roof", "rooms", "area"]
SNAPSHOT_MEASURES = {"rows": "true"} | {f"has_{c}": f"{c} is not null" for c in FIELDS} | {
    "area <= 0": "area <= 0", "area > 1000": "area > 1000", "rooms <= 0": "rooms <= 0", "rooms > 20": "rooms > 20", "price <= 0": "price_millions <= 0", "build_year after deal": "build_year > deal_year", "date after cutoff": f"deal_date > date '{CUTOFF}'", "no date": "deal_date is null",
}


@register("E40_compare_measures", f"{WITH}, o as ({measured(SNAPSHOT_MEASURES, 'legacy', 'city')}), n as ({measured(SNAPSHOT_MEASURES, 'deals', 'city')}) select city, measure, coalesce(o.n, 0) as old_n, coalesce(n.n, 0) as new_n, o.pct as old_pct, n.pct as new_pct, coalesce(n.n, 0) - coalesce(o.n, 0) as difference from o full join n using (city, measure)")
def e40_measures(spark, sf_dir):
    return flags.compare_flags(legacy_deals(spark, sf_dir), deals(spark, sf_dir), flags.deal_flags(FIELDS, CUTOFF), ["city"])


WATERFALL = f"n as (select city, k, deal_date, count(*) as nn, max(sale_portion) as p, max(price_millions) as np, max(area) as na, max(rooms) as nr, max(build_year) as ny from ck where k is not null group by all), o as (select city, k, deal_date, count(*) as oo from lk where k is not null group by all), w as (select lk.*, nn, np, na, nr, ny from lk join n using (city, k, deal_date) join o using (city, k, deal_date) where nn = 1 and oo = 1 and p = 1 and lk.record_id not in (select legacy_record_id from good))"
FAILED = {"rows": "true", "price": "abs(price_millions - np) * 1e6 > 1000.001", "area": "area is null or na is null or area <= 0 or na <= 0 or abs(area - na) > 0.5", "rooms": "rooms is null or nr is null or rooms <= 0 or nr <= 0 or abs(rooms - nr) >= 0.001", "year": "build_year > 0 and ny > 0 and build_year <> ny"}


@register("E26_attribute_failures", f"{WITH} {STRICT}, {WATERFALL} {measured(FAILED, 'w', 'city')}")
def e26_failures(spark, sf_dir):
    key, base = clean.cadastral_key("gush_code"), joined(spark, sf_dir)
    cur, old = deals(spark, sf_dir, base), legacy_deals(spark, sf_dir, base)
    linked = linkage.strict_links(cur, old).withColumnRenamed("_key", "k")
    return quality.attribute_failures(quality.link_waterfall(old.withColumn("k", key), cur.withColumn("k", key), linked, "k"), ["city"])


DECLARED = "price_millions * 1e6 + case when rooms = 2 then 400 when rooms = 3 then 2000 else 0 end"


@register("E24_declared_amounts", f"{WITH} {OLD_UNITS}, a as (select {U}, min(price_millions) * 1e6 as o from old group by {U} having count(*) = 1), b as (select {U}, min({DECLARED}) as n, min(sale_portion) as p from units group by {U} having count(*) = 1) select city, case when p = 1 then 'whole' else 'partial' end as portion_group, count(*) as candidates, {', '.join(f'count(*) filter (where abs(o - n) <= {t}) as declared_within_{t}' for t in (1, 500, 1000))}, count(*) filter (where abs(o - n / p) <= 1000) as declared_by_portion_within_1000 from a join b using ({U}) where p is not null group by 1, 2")
def e24_declared(spark, sf_dir):
    got = quality.reconcile_prices(units(spark, sf_dir).withColumn("declared_amount", F.expr(DECLARED)), old_units(spark, sf_dir))
    return got.select("city", "portion_group", "candidates", *[c for c in got.columns if c.startswith("declared_")])


SCRAPED = "deal_date + cast(gush as int)"


@register("E14_coverage_enriched", f"{WITH} {STRICT}, e as (select *, cast({SCRAPED} as date) as scraped_at from enriched) select city, count(*) as rows, min(scraped_at) as scraped_from, max(scraped_at) as scraped_to, count(*) filter (where legacy_match = 'strict_transaction') as enriched_transactions, count(*) filter (where gush = 4) as linked_locations, count(*) filter (where full_address is null) as missing_address from e group by city")
def e14_enriched(spark, sf_dir):
    d = linkage.strict_enrich(deals(spark, sf_dir), legacy_deals(spark, sf_dir))
    d = d.withColumns({"scraped_at": F.expr("date_add(deal_date, cast(gush as int))"), "location_basis": F.when(F.col("gush") == 4, "property_reference")})
    return summary.coverage(d, ["city"]).select("city", "rows", "scraped_from", "scraped_to", "enriched_transactions", "linked_locations", "missing_address")


CONTENT = "price_millions, area, strftime(deal_date, '%Y-%m-%d') as deal_date, gush_code, {} as city, street"
EXTRAS = f"""s as (select {CONTENT.format('city')} from legacy), a as (select {CONTENT.format("case when gush = 9 then '' else city end")} from deals),
x as (select a.* from a where not exists (select 1 from s where s.price_millions is not distinct from a.price_millions and s.area is not distinct from a.area and s.deal_date = a.deal_date and s.gush_code = a.gush_code and s.city = a.city and s.street = a.street)),
l as (select distinct price_millions, area, deal_date, gush_code, street, 1 as l from s), w as (select distinct gush_code, deal_date, 1 as w from s),
e as (select x.*, l.l, w.w from x left join l using (price_millions, area, deal_date, gush_code, street) left join w using (gush_code, deal_date))"""
EXTRA_FLAGS = {"rows": "true", "matching_without_place": "l = 1", "unmatched_without_place": "l is null", "missing_place": "city = ''", "known_property_day": "w = 1", "new_property_day": "w is null"}


def extras(spark, sf_dir):
    form = lambda df: quality.canonical(df, ["price_millions", "area"], ["deal_date"], ["gush_code", "city", "street"])
    append = deals(spark, sf_dir).withColumn("city", F.when(F.col("gush") == 9, "").otherwise(F.col("city")))
    return quality.append_report(form(legacy_deals(spark, sf_dir)), form(append), "city", "street", ["price_millions", "area", "deal_date", "gush_code", "street"], ["gush_code", "deal_date"])


@register("E19_append_counts", f"{WITH}, {EXTRAS} {measured(EXTRA_FLAGS, 'e')}")
def e19_counts(spark, sf_dir):
    return extras(spark, sf_dir)["counts"]


@register("E19_append_places", f"{WITH}, {EXTRAS} select city, street, count(*) as extra_rows from e group by all")
def e19_places(spark, sf_dir):
    return extras(spark, sf_dir)["places"]


@register("E19_append_years", f"{WITH}, {EXTRAS} select year(deal_date::date) as year, count(*) as extra_rows from e group by all")
def e19_years(spark, sf_dir):
    return extras(spark, sf_dir)["years"]


@register("E19_append_samples", f"{WITH}, {EXTRAS} select case when l = 1 then 'same_but_place' when w = 1 then 'same_property_day' else 'none' end as nearness, least(20, count(*)) as samples, least(20, count(*)) as last_rank from e group by 1")
def e19_samples(spark, sf_dir):
    return extras(spark, sf_dir)["samples"].groupBy("nearness").agg(F.count("*").alias("samples"), F.max("rank").alias("last_rank"))


@register("E19_append_repeats", f"{WITH}, {EXTRAS}, u as (select count(*) as n from a group by price_millions, area, deal_date, gush_code, city, street), v as (select count(*) as n from a group by price_millions, area, deal_date, gush_code, street) select 'all' as content, count(*) as \"unique\", (sum(n) - count(*))::bigint as excess from u union all select 'without_place', count(*), (sum(n) - count(*))::bigint from v")
def e19_repeats(spark, sf_dir):
    return extras(spark, sf_dir)["repeats"]


_PARCEL = "nullif(regexp_extract(gush_code, '^([^-]+-[^-]+)-[^-]+$', 1), '') as parcel"


def _summary_sql(name: str, key: list[str]) -> str:
    k, full = ", ".join(key), " and ".join(f"{c} is not null" for c in key)
    return f"select '{name}' as definition, count(*) as candidate_rows, count(distinct city) as cities from n semi join (select {k} from o) using ({k}) anti join (select {k}, deal_date from o) using ({k}, deal_date) where {full}"


def _internal_sql(name: str, key: list[str]) -> str:
    k, full = ", ".join(key), " and ".join(f"{c} is not null" for c in key)
    return f"select '{name}' as definition, count(*) as groups, count(distinct city) as cities, coalesce(sum(d), 0)::bigint as sale_days from (select {k}, count(distinct deal_date) as d from n where {full} and deal_date is not null group by all having count(distinct deal_date) > 1)"


NEARBY = f"o as (select *, {_PARCEL} from legacy), n as (select *, {_PARCEL} from deals)"


@register("E41_candidate_summary", f"{WITH}, {NEARBY} " + " union all ".join(_summary_sql(n, k) for n, k in quality.DEFINITIONS.items()))
def e41_summary(spark, sf_dir):
    base = joined(spark, sf_dir)
    return quality.repeat_candidate_summary(legacy_deals(spark, sf_dir, base), deals(spark, sf_dir, base))


@register("E41_multi_date_groups", f"{WITH}, {NEARBY} " + " union all ".join(_internal_sql(n, k) for n, k in quality.DEFINITIONS.items()))
def e41_groups(spark, sf_dir):
    return quality.multi_date_groups(deals(spark, sf_dir))


# Composed outputs and searches -------------------------------------------------------------------

ASKED = ["red", "l", "dark 1", "RE", "black", "12", "nothing like it", "-"]
_Q = "q as (select unnest([" + ", ".join(f"'{a}'" for a in ASKED) + "]) as query)"
STREETS_FOUND = f"tk as (select query, regexp_extract_all(lower(query), '[a-z0-9]+') as toks from q), m as (select query, city, street, gush from tk, gush_streets where len(toks) > 0 and len(list_filter(toks, lambda t: not case when regexp_full_match(t, '[0-9]+') then list_contains(regexp_extract_all(street, '[0-9]+'), t) else contains(lower(street), t) end)) = 0), g as (select query, city, street, string_agg(cast(cast(gush as int) as varchar), ',' order by gush) as gush_ids, case when starts_with(lower(street), lower(query)) then 0 else 1 end as rank from m group by all), r as (select *, row_number() over (partition by query order by rank, city, street) as place from g)"


@register("F6_search_streets", f"{WITH}, {_Q}, {STREETS_FOUND} select * from r where place <= 25")
def f6_batch(spark, sf_dir):
    q = spark.createDataFrame([(a,) for a in ASKED], "query string")
    out = linkage.search_streets(q, gush_streets(spark, sf_dir), descriptions(spark, sf_dir))
    return out.select("query", "city", "street", F.array_join(F.transform("gush_ids", lambda g: g.cast("int").cast("string")), ",").alias("gush_ids"), "rank", "place")


@register("F5_search_gush_batch", f"{WITH} {DESCR}, {_Q}, own as (select query, city, gush, min(case when starts_with(t, lower(query)) then 0 else 1 end) as rank from q, (select city, gush, unnest([cast(cast(gush as int) as varchar), lower(gush_desc), lower(city), lower(street)]) as t from descr) where contains(t, lower(query)) group by all), st as (select query, city, gush, case when starts_with(lower(street), lower(query)) then 0 else 2 end as rank from q, gush_streets where contains(lower(street), lower(query))), b as (select query, city, gush, min(rank) as rank from (select * from own union all select * from st) group by all), p as (select *, row_number() over (partition by query order by rank, city, gush) as place from b) select query, city, gush, rank, place, gush_desc as gush_label from p join descr using (city, gush) where place <= 25")
def f5_batch(spark, sf_dir):
    q = spark.createDataFrame([(a,) for a in ASKED], "query string")
    return linkage.search_gush(q, descriptions(spark, sf_dir), gush_streets(spark, sf_dir))


BLOCKS = "gush = 7 and city in ('NATION_1', 'NATION_2', 'NATION_3')"


@register("N02_index_overlay", f"{WITH}, c as (select * from deals where {BLOCKS} and sale_portion = 1), t as ({global_sql('c', 'price_millions')}), y as (select deal_year, median(price_millions) as y from t where deal_year is not null group by 1), f as (select * from y order by deal_year limit 1) select y.deal_year, f.y * b.index_value / z.index_value as y from y join bench b on b.year = y.deal_year, f join bench z on z.year = f.deal_year")
def n2(spark, sf_dir):
    d = deals(spark, sf_dir)
    return jobs.area_comparison(d, descriptions(spark, sf_dir), d.where(BLOCKS).select("city", "gush").distinct(), FilterSpec(), index=bench_index(spark, sf_dir))["index_overlay"]


N4_ROWS = f"f as (select * from deals where city in ('NATION_3', 'NATION_7') and sale_portion = 1), d2 as ({global_sql('f', 'price_millions')}), t as ({global_sql('d2', 'area')}), pe as (select min(deal_year) as a, max(deal_year) as z from t where deal_year < {SNAPSHOT_YEAR})"
N4_SPEC = FilterSpec(cities=("NATION_3", "NATION_7"))


def performance(spark, sf_dir):
    return jobs.gush_performance(deals(spark, sf_dir), N4_SPEC, SNAPSHOT_YEAR, min_deals=1, picks=(3, 3, 3), descriptions=descriptions(spark, sf_dir), index=bench_index(spark, sf_dir))


@register("N04_city_line", f"{WITH}, {N4_ROWS} select city, deal_year, count(*) as n_deals, median(price_millions) as y from t, pe where deal_year between a and z group by all")
def n4_line(spark, sf_dir):
    return performance(spark, sf_dir)["city_line"]


@register("N04_index_overlay", f"{WITH}, {N4_ROWS}, y as (select deal_year, median(price_millions) as y from t, pe where deal_year between a and z group by 1), fy as (select * from y order by deal_year limit 1) select y.deal_year, fy.y * b.index_value / i.index_value as y from y join bench b on b.year = y.deal_year, fy join bench i on i.year = fy.deal_year")
def n4_overlay(spark, sf_dir):
    return performance(spark, sf_dir)["index_overlay"]


N4_PICKED = f"""s as (select city, gush, deal_year, count(*) as n, median(price_millions) as y from t where deal_year is not null group by all),
g as (select city, gush, max(case when deal_year = a then y end) as ya, max(case when deal_year = z then y end) as yz, any_value(a) as a, any_value(z) as z from s, pe where deal_year between a and z group by all),
k as (select *, round_even((pow(yz / ya, 1 / (z - a)) - 1) * 100, 3) as rate from g where ya > 0 and yz > 0), o as (select *, row_number() over (order by rate desc, city, gush) as rank, count(*) over () as total from k),
pk as (select *, case when rank <= 3 then 'top' when rank > total - 3 then 'bottom' else 'typical' end as performance_group from o where rank <= 3 or rank > total - 3 or (rank > 3 + (total - 9) // 2 and rank <= 6 + (total - 9) // 2))"""


@register("N04_packed_series", f"{WITH} {DESCR}, {N4_ROWS}, {N4_PICKED} select city, gush, gush_desc as gush_label, performance_group, rank, string_agg(cast(cast(deal_year as int) as varchar) || ':' || s.n, ',' order by deal_year) as points from pk join s using (city, gush) join descr using (city, gush) where deal_year between a and z group by all")
def n4_packed(spark, sf_dir):
    packed = performance(spark, sf_dir)["packed"]
    point = F.transform("points", lambda p: F.concat_ws(":", p["deal_year"].cast("int").cast("string"), p["n_deals"].cast("string")))
    return packed.select("city", "gush", "gush_label", "performance_group", "rank", F.array_join(point, ",").alias("points"))


@register("N10_measures", f"{WITH}, old as (select * from legacy where gush_code not like '%-0'), o as ({measured(SNAPSHOT_MEASURES, 'old')}), n as ({measured(SNAPSHOT_MEASURES, 'units')}) select measure, o.n as old_n, n.n as new_n, o.pct as old_pct, n.pct as new_pct, n.n - o.n as difference from o join n using (measure)")
def n10(spark, sf_dir):
    got = jobs.snapshot_quality(units(spark, sf_dir), old_units(spark, sf_dir), "unit_key", 1997, CUTOFF)["measures"]
    return got.where(F.col("measure").isin(list(SNAPSHOT_MEASURES)))


@register("N12_map", f"{WITH} {DESCR}, asked as (select gush, min(gush_desc) as label from descr where city = 'NATION_3' or gush = 50 group by gush), poly as (select distinct gush, city as poly_city, city || ':' || cast(cast(gush as int) as varchar) as geometry from deals where gush % 3 <> 0), m as (select asked.*, poly_city, geometry, rank() over (partition by asked.gush order by coalesce(lower(poly_city) = 'nation_3', false) desc) as r from asked left join poly using (gush)), c as (select gush, count(*) as deals from units where city = 'NATION_3' group by gush) select gush, label, geometry, coalesce(deals, 0) as deals, gush = 50 as selected, geometry is null as missing from m left join c using (gush) where r = 1")
def n12_map(spark, sf_dir):
    d = deals(spark, sf_dir)
    shapes = d.where("gush % 3 <> 0").select("gush", F.col("city").alias("poly_city"), F.concat_ws(":", "city", F.col("gush").cast("int").cast("string")).alias("geometry")).distinct()
    got = jobs.address_job(old_units(spark, sf_dir), units(spark, sf_dir), "red 12", city="NATION_3", places=(descriptions(spark, sf_dir), shapes), chosen=(50.0,))["map"]
    return got.select("gush", "label", "geometry", "deals", "selected", "missing")
