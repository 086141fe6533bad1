"""Queries of growth, rankings, bands and breaks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, filters
from ..operators import growth, outliers, segments, summary
from .basics import PER_M2, global_sql
from .fixtures import SNAPSHOT_YEAR, WITH, bench_index, deals
from .registry import register

CITY_Y = "cy as (select city, deal_year, count(*) as n_deals, median(price_millions) as y from deals where deal_year is not null group by all)"
GUSH_Y = "gy as (select city, gush, deal_year, count(*) as n_deals, median(price_millions) as y from deals where deal_year is not null group by all)"
# places are (block) over all cities where endpoints need many deals
BLOCK_Y = "by_ as (select gush, deal_year, count(*) as n_deals, median(price_millions) as y from deals where deal_year is not null group by all)"


def by_place(spark, sf_dir, *keys):
    d = deals(spark, sf_dir).where("deal_year is not null")
    return d.groupBy(*keys, "deal_year").agg(F.count("*").alias("n_deals"), F.median("price_millions").alias("y"))


def ranking(spark, sf_dir):
    return growth.rank_cities(by_place(spark, sf_dir, "city"), 2)


RANK = f""", {CITY_Y}, s as (select * from cy where n_deals >= 2), sh as (select deal_year from s where y > 0 group by deal_year having count(distinct city) = (select count(distinct city) from s)),
e as (select min(deal_year) as first_year, max(deal_year) as last_year from sh), g as (select city, first_year, last_year, max(case when deal_year = first_year then y end) as first_value, max(case when deal_year = last_year then y end) as last_value,
max(case when deal_year = first_year then n_deals end) as first_year_deals, max(case when deal_year = last_year then n_deals end) as last_year_deals, count(*) as years, cast(sum(n_deals) as bigint) as total_deals from s, e where first_year < last_year and deal_year between first_year and last_year group by all),
ranking as (select *, round_even(last_value - first_value, 3) as absolute_change, round_even((last_value / first_value - 1) * 100, 3) as pct_change, round_even(total_deals / years, 3) as avg_deals_per_year from g)"""


@register("E28_city_ranking", f"{WITH} {RANK} select * from ranking")
def e28(spark, sf_dir):
    return ranking(spark, sf_dir)


@register("E29_city_cards", f"{WITH} {RANK} select 25 as selected, count(*) as plotted, arg_min(city, {{'o': -pct_change, 'c': city}}) as strongest, max(pct_change) as strongest_pct, arg_min(city, {{'o': -last_value, 'c': city}}) as highest, max(last_value) as highest_value from ranking")
def e29(spark, sf_dir):
    return growth.city_cards(ranking(spark, sf_dir), 25)


@register("E30_comparison_period", f"{WITH}, y as (select distinct cast(deal_year as int) as y from deals) select min(y) filter (where y < {SNAPSHOT_YEAR} and y >= 1992.5) as first_year, max(y) filter (where y < {SNAPSHOT_YEAR} and y >= 1992.5) as last_year, max(y) filter (where y < {SNAPSHOT_YEAR} and y >= 1992.5) - min(y) filter (where y < {SNAPSHOT_YEAR} and y >= 1992.5) as years_span, array_to_string(list_sort(list(y) filter (where y >= {SNAPSHOT_YEAR})), ',') as partial_years from y")
def e30(spark, sf_dir):
    p = growth.comparison_period(by_place(spark, sf_dir, "city"), SNAPSHOT_YEAR, (1992.5, None))
    return p.withColumn("partial_years", F.concat_ws(",", F.col("partial_years").cast("array<string>")))


GROWTH = f""", {BLOCK_Y}, p as (select min(deal_year) as first_year, max(deal_year) as last_year from by_ where deal_year < {SNAPSHOT_YEAR}), g as (select gush, first_year, last_year, max(case when deal_year = first_year then y end) as first_y, max(case when deal_year = last_year then y end) as last_y,
max(case when deal_year = first_year then n_deals end) as first_deals, max(case when deal_year = last_year then n_deals end) as last_deals, count(*) as year_count, cast(sum(n_deals) as bigint) as total_deals, median(n_deals) as median_deals from by_, p where deal_year between first_year and last_year group by all),
growth as (select *, round_even((pow(last_y / first_y, 1 / (last_year - first_year)) - 1) * 100, 3) as annualized_change, round_even((last_y / first_y - 1) * 100, 3) as price_change from g where first_deals >= 5 and last_deals >= 5 and first_y > 0 and last_y > 0),
ranked as (select *, row_number() over (order by annualized_change desc, gush) as rank from growth)"""


def ranked(spark, sf_dir):
    s = by_place(spark, sf_dir, "gush")
    return growth.growth(s, growth.comparison_period(s, SNAPSHOT_YEAR), 5, ("gush",))


@register("E31_growth", f"{WITH} {GROWTH} select * from ranked")
def e31(spark, sf_dir):
    return ranked(spark, sf_dir)


@register("E32_performers", f"{WITH} {GROWTH}, t as (select *, count(*) over () as total from ranked) select gush, rank, case when rank <= 3 then 'top' when rank > total - 3 then 'bottom' else 'typical' end as performance_group, cast(case when rank <= 3 then rank when rank > total - 3 then total - rank + 1 else rank - 3 - (total - 6 - 3) // 2 end as int) as position_in_group from t where rank <= 3 or rank > total - 3 or (rank > 3 + (total - 9) // 2 and rank <= 6 + (total - 9) // 2)")
def e32(spark, sf_dir):
    return growth.pick_performers(ranked(spark, sf_dir), 3, 3, 3).select("gush", "rank", "performance_group", "position_in_group")


@register("E33_yoy", f"{WITH}, {GUSH_Y}, l as (select *, lag(deal_year) over w as from_year, lag(y) over w as previous from gy window w as (partition by city, gush order by deal_year)) select city, gush, from_year, deal_year as to_year, round_even(previous, 3) as previous_y, round_even(y, 3) as current_y, case when y > 0 and previous > 0 then round_even((pow(y / previous, 1 / (deal_year - from_year)) - 1) * 100, 3) end as yoy_pct_change from l")
def e33(spark, sf_dir):
    return growth.yoy(by_place(spark, sf_dir, "city", "gush"), ["city", "gush"])


@register("E34_index_overlay", f"{WITH}, ys as (select deal_year, median(price_millions) as y from deals group by 1), f as (select arg_min(y, deal_year) as y0, min(deal_year) as d0 from ys where y is not null) select deal_year, y0 * index_value / (select index_value from bench, f where year = d0) as y from ys join bench on year = deal_year, f")
def e34(spark, sf_dir):
    return growth.index_overlay(summary.yearly_values(deals(spark, sf_dir)), bench_index(spark, sf_dir))


@register("E35_city_line", f"{WITH}, c as (select * from deals where city = 'NATION_3' and sale_portion = 1), d2 as ({global_sql('c', 'price_millions')}), d3 as ({global_sql('d2', PER_M2, True)}) select city, deal_year, count(*) as n_deals, median({PER_M2}) as y from d3 group by all")
def e35(spark, sf_dir):
    """The city behind a chosen block: its filters without the block."""
    spec = filters.FilterSpec(cities=("NATION_3",), gushes=(7,))
    line = outliers.trim(filters.apply_filters(deals(spark, sf_dir), filters.replace(spec, gushes=())), "areas", "per_m2")
    return line.groupBy("city", "deal_year").agg(F.count("*").alias("n_deals"), F.median(clean.price_metric("per_m2")).alias("y"))


@register("E36_relative_series", f"{WITH}, {CITY_Y}, b as (select min(deal_year) as base_year from (select deal_year from cy where y > 0 group by 1 having count(distinct city) = (select count(distinct city) from cy))) select c.city, c.deal_year, base_year, c.y as raw_y, round(c.y / k.y * 100, 3) as y from cy c, b join cy k on k.deal_year = base_year and k.city = c.city where c.deal_year >= base_year")
def e36(spark, sf_dir):
    return growth.relative_series(by_place(spark, sf_dir, "city"), "city")


@register("E37_pack_series", f"{WITH}, {CITY_Y} select city, string_agg(cast(cast(deal_year as int) as varchar) || ':' || cast(n_deals as varchar), ',' order by deal_year) as points from cy group by city")
def e37(spark, sf_dir):
    p = growth.pack_series(by_place(spark, sf_dir, "city"), ["city"])
    return p.select("city", F.array_join(F.transform("points", lambda x: F.concat_ws(":", x["deal_year"].cast("int").cast("string"), x["n_deals"].cast("string"))), ",").alias("points"))


@register("E38_top_categories", f"{WITH}, k as (select distinct city from deals), f as (select city from k order by city limit 4) select case when city in (select city from f) then city else 'more (' || cast((select count(*) - 4 from k) as varchar) || ')' end as category, count(*) as n from deals group by 1")
def e38(spark, sf_dir):
    return growth.top_categories(deals(spark, sf_dir), "city", 4).groupBy("category").agg(F.count("*").alias("n"))


@register("E39_scaling", f"{WITH}, {GUSH_Y}, m as (select min(n_deals) as a, max(n_deals) as b from gy) select city, gush, deal_year, 4.0 + (n_deals - a) / (b - a) * 12.0 as size, case when n_deals / b < 0.05 then 0 when n_deals / b < 0.25 then 1 when n_deals / b < 0.5 then 2 when n_deals / b < 0.75 then 3 else 4 end as deal_class from gy, m")
def e39(spark, sf_dir):
    s = by_place(spark, sf_dir, "city", "gush")
    return growth.deal_classes(growth.minmax_scale(s, "n_deals", 4.0, 16.0, 8.0)).select("city", "gush", "deal_year", "size", "deal_class")


def _band_sql(key: str) -> str:
    c, bands = segments.BANDS[key]
    return "case " + " ".join(f"when {c} >= {a} and {c} < {b} then '{n}'" for a, b, n in bands) + " else 'unknown' end"


BANDED = ", tt as (select apt_type as t from deals group by 1 order by count(*) desc, 1 limit 6), banded as (select *, " + ", ".join(f"{_band_sql(k)} as band_{k}" for k in segments.BANDS) + ", case when apt_type in (select t from tt) then apt_type else 'other' end as band_type from deals)"


@register("E9_attribute_bands", f"{WITH} {BANDED} select record_id, band_rooms, band_floor, band_age, band_area, band_type from banded")
def e9(spark, sf_dir):
    return segments.with_bands(deals(spark, sf_dir)).select("record_id", *[f"band_{d}" for d in segments.DIMENSIONS])


@register("E10_segment_premium", f"{WITH} {BANDED}, v as (select *, {PER_M2} as v from banded), y as (select deal_year, median(v) as mid, count(*) as ny from v where v is not null group by 1), r as (select v.*, case when ny >= 5 then v / mid end as ratio from v left join y using (deal_year)), l as ("
          + " union all ".join(f"select v, ratio, '{d}' as dimension, band_{d} as label from r" for d in segments.DIMENSIONS)
          + ") select dimension, label, count(*) as deals, count(v) as valid_prices, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as p75, case when count(ratio) >= 10 then round_even((median(ratio) - 1) * 100, 1) + 0.0 end as premium_pct, count(v) < 10 as low_sample from l group by 1, 2")
def e10(spark, sf_dir):
    return segments.segment_premium(deals(spark, sf_dir))


@register("E11_hedonic_index")
def e11(spark, sf_dir):
    return segments.hedonic_index(deals(spark, sf_dir))


#: Rows of one band each, so that only years and log area are left: the slope is pooled within years.
ONE_BAND = "area >= 75 and area < 100"


def _within(name: str, rows: str) -> str:
    """CTEs of a fit of t on x and years in each city: years' means, slopes and residuals."""
    return f"""{name}_m as (select city, year, count(*) as n, avg(x) as mx, avg(t) as mt from {rows} group by all),
{name}_b as (select city, sum((x - mx) * (t - mt)) / sum((x - mx) * (x - mx)) as b, sum((x - mx) * (x - mx)) as sxx from {rows} join {name}_m using (city, year) group by city),
{name}_r as (select city, year, x, t, t - mt - b * (x - mx) as r from {rows} join {name}_m using (city, year) join {name}_b using (city))"""


INDEX_BY_CITY = f"""{WITH}, u as (select city, cast(deal_year as int) as year, ln(area) as x, ln(price_millions) as t, price_millions * 1000 / area as pm from deals where {ONE_BAND} and price_millions > 0 and deal_year between 1900 and 2100 and deal_year % 1 = 0),
yc as (select city, year, median(pm) as raw, count(*) as n from u group by all having count(*) >= 5), ok as (select city from yc group by 1 having count(*) >= 2 and sum(n) >= 30),
v as (select u.* from u semi join yc using (city, year) semi join ok using (city)), {_within("f", "v")},
md as (select city, median(r) as m from f_r group by 1), sp as (select city, 1.4826 * median(abs(r - m)) as s from f_r join md using (city) group by 1),
nr as (select f_r.*, s <= 0 or abs(r) <= 4 * s as near from f_r join sp using (city)), en as (select city, count(*) filter (near) >= 30 as enough, count(*) as n_all from nr group by 1),
k as (select city, year, x, t from nr join en using (city) where near or not enough), {_within("g", "k")},
st as (select city, count(*) as n, sum(r * r) as rss, var_pop(t) * count(*) as tss, count(distinct year) as ny from g_r group by 1),
fy as (select city, min(year) as y0 from yc semi join ok using (city) group by 1),
z as (select fy.city, g_m.n as n0, mx as x0, mt as t0, raw as raw0, y0 from fy join g_m on g_m.city = fy.city and year = y0 join yc on yc.city = fy.city and yc.year = y0),
e as (select m.city, m.year, m.n, (m.mt - b * m.mx) - (t0 - b * x0) as c, sqrt(rss / (st.n - st.ny - 1) * (1 / m.n + 1 / n0 + (m.mx - x0) * (m.mx - x0) / sxx)) as se, year = y0 as base, 100 * raw / raw0 as raw, n_all - st.n as excluded, 1 - rss / tss as r2
  from g_m m join g_b using (city) join st using (city) join z using (city) join yc using (city, year) join en using (city))
select city, year, n as observations, round(case when base then 100 else 100 * exp(c) end, 1) as adjusted, case when not base then round(100 * exp(c - 1.96 * se), 1) end as adjusted_low, case when not base then round(100 * exp(c + 1.96 * se), 1) end as adjusted_high, round(raw, 1) as raw, excluded, round(r2, 3) as r_squared from e"""


@register("E11_index_by_city", INDEX_BY_CITY)
def e11_by_city(spark, sf_dir):
    """The index of each city over rows of one band, where it has a closed form."""
    unknown = F.lit(None).cast("double")
    rows = deals(spark, sf_dir).where(ONE_BAND).withColumns({"rooms": unknown, "floor": unknown, "building_age": unknown, "apt_type": F.lit("flat")})
    return segments.hedonic_index(rows, ["city"])


@register("G_windows", f"{WITH} select record_id, row_number() over (partition by city order by deal_date desc, record_id) as place, lag(price_millions) over (partition by city, gush order by deal_date, record_id) as previous_price, count(*) over (partition by city, gush_code) as same_key, sum(gush) over (partition by city order by deal_date, record_id rows unbounded preceding) as running from deals")
def g_windows(spark, sf_dir):
    from pyspark.sql import Window as W

    late = W.partitionBy("city").orderBy(F.desc("deal_date"), "record_id")
    block = W.partitionBy("city", "gush").orderBy("deal_date", "record_id")
    upto = W.partitionBy("city").orderBy("deal_date", "record_id").rowsBetween(W.unboundedPreceding, 0)
    return deals(spark, sf_dir).select(
        "record_id", F.row_number().over(late).alias("place"), F.lag("price_millions").over(block).alias("previous_price"), F.count("*").over(W.partitionBy("city", "gush_code")).alias("same_key"),
        F.sum("gush").over(upto).alias("running"),
    )


@register("K1_discretize", f"{WITH} select record_id, case when rooms <> 999 then regexp_replace(cast(rooms as varchar), '\\.0$', '') end as label from deals")
def k1(spark, sf_dir):
    return segments.discretize(deals(spark, sf_dir), "rooms").select("record_id", "label")


#: The plain scale: of all readable steps the one with few enough bins, three at least, near the target, and finest.
BREAKS = """s as (select min(area) as a, max(area) as b, least(8, greatest(3, count(distinct area) // 2)) as target from deals), m as (select unnest([1, 2, 2.5, 5, 10]::double[]) as m),
w as (select pow(10, floor(log10((b - a) / target))) as p, (b - a) / target as x from s), r as (select min(p * m) as step from w, m where x / p <= m),
c as (select m * pow(10, floor(log10(r.step)) + i) as step, a, b, target from r, m, s, range(-2, 4) k(i)),
d as (select *, floor(a / step) as first, ceil(b / step) - floor(a / step) + case when ceil(b / step) * step <= b then 1 else 0 end as bins from c),
e as (select step, first, bins from d order by bins > 8, bins < 3, abs(bins - target), step limit 1),
g as (select round(first * step + i * step, 12) as lo, round(first * step + (i + 1) * step, 12) as hi from e, range(0, 100) k(i) where i < bins)"""
_SHORT = "rtrim(rtrim(format('{{:.3f}}', {}), '0'), '.')"


@register("K2_nice_breaks", f"{WITH}, {BREAKS} select {_SHORT.format('lo')} || '-' || {_SHORT.format('hi')} as label, count(*) as n, min(area) as low, max(area) as high from deals left join g on area >= lo and area < hi group by 1")
def k2(spark, sf_dir):
    """Deals in each readable area bin."""
    d = segments.discretize(deals(spark, sf_dir), "area")
    return d.groupBy("label").agg(F.count("*").alias("n"), F.min("area").alias("low"), F.max("area").alias("high"))


